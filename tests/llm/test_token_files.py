import zlib

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from rows import EDGES, documents
from tokenizers import Tokenizer

from newsloom.llm import token_files as T
from newsloom.llm.elias_fano import EliasFano
from newsloom.llm.word_ids import WordIds, tokenizer_path

ODD = [
    (20, "Don't STOP <|startoftext|> now <|STARTOFTEXT|>"), (21, "ΟΔΟΣ ΣΑΣ İstanbul"), (22, "a\x1cb x\x85y a b"),
    (23, "á ́b ½ ²x_y 12ab ’quoted’ “so”"), (24, "中文字 한국어 ไทย"), (25, "word " * 9000), (26, "ẞ ﬁ Ⅷ é"), (20, "same id"),
    (-(1 << 62), "small id"), (1 << 62, "large id"), (None, "and another without"),
]


@pytest.fixture(scope="module")
def encode():
    model = Tokenizer.from_file(tokenizer_path())
    return lambda text: model.encode(text or "", add_special_tokens=False).ids


@settings(max_examples=200, deadline=None)
@given(st.lists(st.integers(0, 2**64 - 1) | st.integers(0, 40), max_size=200))
def test_elias_fano_round_trip(values):
    values = sorted(values)
    coded, end = EliasFano.from_bytes(data := EliasFano.encode(np.array(values, np.uint64)).to_bytes())
    assert end == len(data) and coded.select(np.arange(len(values))).tolist() == values


def test_elias_fano_is_near_the_least_space():
    rng = np.random.default_rng(1)
    bounds = np.cumsum(rng.integers(1, 1200, 200_000))
    coded = EliasFano.encode(bounds)
    assert (coded.select(np.arange(0, 200_000, 7)) == bounds[::7]).all()
    # Two bits and the logarithm of the mean gap; a sixteenth more for the directory.
    assert len(coded.to_bytes()) * 8 / 200_000 < 2.6 + np.log2(bounds[-1] / 200_000)
    with pytest.raises(ValueError):
        EliasFano.encode(np.array([2, 1]))
    with pytest.raises(IndexError):
        coded.select(np.array([200_000]))


@settings(max_examples=150, deadline=None)
@given(st.lists(st.text(st.sampled_from("aB'sté ́ İß\x85\x1c\n\xa0<|>中1½.,-_’") | st.characters(codec="utf-8"), max_size=30), min_size=1, max_size=6))
def test_ids_are_the_tokenizers(encode, texts):
    ids, bounds = CODER(pa.array(texts), 1)
    assert [ids[a:b].tolist() for a, b in zip(bounds, bounds[1:])] == [[*encode(t), 1] for t in texts]


CODER = WordIds(tokenizer_path(), most_words=40)


def plain(rows, encode):
    """Rows in the order of ids, and by the ids of the text where those are equal; starts counted over all."""
    start, out = 0, []
    for i, text in sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0)):
        ids = [*encode(text), 1]
        out.append((i, start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        start += len(ids)
    return out


@pytest.mark.parametrize("shard_tokens", [7, 5000, T.SHARD_TOKENS])
def test_corpus_round_trip(spark, encode, tmp_path, shard_tokens):
    rows = EDGES + ODD + [(100 + i, f"text {i} of some words " * (i % 7)) for i in range(300)]
    folder = T.write_tokens(documents(spark, rows).repartition(5), f"file:{tmp_path}/corpus", shard_tokens=shard_tokens)
    got = T.read_tokens(spark, folder, with_ids=True).collect()
    want = plain(rows, encode)
    mine = sorted(got, key=lambda r: r.start)
    # Rows of one id may stand in any order.
    key = lambda r: (r[0] is None, r[0] or 0, r[2], r[3])
    assert sorted(((r.doc_id, 0, r.n_tokens, r.ids_crc32) for r in mine), key=key) == sorted(((r[0], 0, *r[2:]) for r in want), key=key)
    assert [r.doc_id for r in mine] == [r[0] for r in want]
    assert [r.start for r in mine] == np.cumsum([0, *(r.n_tokens for r in mine)])[:-1].tolist()
    assert all(zlib.crc32(bytes(r.ids)) == r.ids_crc32 and len(r.ids) == 4 * r.n_tokens for r in mine)
    shards = sorted(p.stem for p in (tmp_path / "corpus").glob("*.bin"))
    assert (len(shards) > 10) == (shard_tokens == 7) and not list((tmp_path / "corpus").glob("_*"))
    one = T.TokenFile(folder, shards[-1])
    assert one.doc(one.n_docs - 1).tolist() == np.frombuffer(mine[-1].ids, "<u4").tolist()


def test_empty_table(spark, tmp_path):
    folder = T.write_tokens(documents(spark, []), str(tmp_path / "none"))
    assert T.read_tokens(spark, folder).collect() == []


def test_staged_ids_are_compressed_well(spark, monkeypatch, tmp_path):
    from urllib.parse import urlparse

    import pyarrow.parquet as pq

    kept = []
    monkeypatch.setattr(T, "stage", lambda df, _f=T.stage, **o: (kept.append(_f(df, **o)), kept[-1])[1])
    monkeypatch.setattr(T, "unstage", lambda df: None)
    T.write_tokens(spark.createDataFrame([(i, "some words of a text") for i in range(20)], "doc_id long, text string"), str(tmp_path / "corpus"))
    group = pq.ParquetFile(urlparse(kept[0].inputFiles()[0]).path).metadata.row_group(0)
    assert {group.column(i).compression for i in range(group.num_columns)} == {"ZSTD"}
