"""New words go to the tokenizer in parts."""

import numpy as np
import pyarrow as pa

from newsloom.llm import word_ids as W


def test_words_are_learnt_in_parts(monkeypatch):
    words = [f"word{i}" for i in range(300)] + ["x" * 500]
    texts = pa.array([" ".join(words), " ".join(words[::-1])])
    want = W.WordIds(W.tokenizer_path())(texts, 1)
    monkeypatch.setattr(W, "LEARN_CHARS", 100)
    parts = list(W.WordIds._parts(words))
    assert [w for part in parts for w in part] == words
    assert all(sum(map(len, part)) <= 100 or len(part) == 1 for part in parts) and len(parts) > 15
    got = W.WordIds(W.tokenizer_path())(texts, 1)
    assert all(np.array_equal(a, b) for a, b in zip(got, want))
    assert list(W.WordIds._parts([])) == []
