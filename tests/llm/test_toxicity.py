import random

import numpy as np
from rows import EDGES, documents, held_out

from newsloom.llm import toxicity as T


def distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        now = [i]
        for j, y in enumerate(b, 1):
            now.append(min(now[-1] + 1, row[j] + 1, row[j - 1] + (x != y)))
        row = now
    return row[-1]


def test_trie_and_automaton_equal_brute_force():
    rng = random.Random(1)
    terms = {"".join(rng.choices("abcd", k=rng.randrange(3, 13))) for _ in range(60)}
    trie = T.LexiconTrie(terms)
    for _ in range(600):
        word = "".join(rng.choices("abcd", k=rng.randrange(3, 13)))
        if rng.random() < 0.6:
            word = list(rng.choice(sorted(terms)))
            for _ in range(rng.randrange(3)):
                word[rng.randrange(len(word))] = rng.choice("abcd")
            word = "".join(word)
        budget = T.error_budget(word)
        near = [(distance(word, t), t) for t in terms]
        near = [(d, t) for d, t in near if d <= min(budget, T.error_budget(t))]
        want = min(near, default=None)
        assert trie.nearest(word, budget) == (None if want is None else (want[1], want[0])), word
        if want is not None and want[0] > 0:
            assert trie.worth(word, budget), (word, want)


def test_context_tells_quotation_from_abuse():
    lexicon = T.Lexicon({"idiot": 5.0, "worthless": 5.0})
    abuse = T.features("you are an idiot and you know it", lexicon)
    quote = T.features('he said the word "idiot" in a report', lexicon)
    assert abuse[0] > quote[0] and quote[2] > abuse[2]
    for spelling in ("id1ot", "idi0t", "idiott", "iidiot", "w0rthl3ss", "wrthless"):
        assert T.features(f"what an {spelling} thing", lexicon)[1] > 0, spelling
    known = T.Lexicon({"idiot": 5.0, "worthless": 5.0}, frozenset({"idiom"}))
    assert T.features("an idiom of worth", known)[0] == T.features("", known)[0] == 0


def test_quotations_are_paired():
    inside = lambda text: [text[a + 1:b] for a, b in T.quotations(text)]
    assert inside('he said "one two" and “three” or „vier“ or «cinq» or \'six\'') == ["one two", "three", "vier", "cinq", "six"]
    assert inside("i don't care, you fool, it isn't fine") == [] == inside("the dogs' and the cats' fool")
    assert inside("she said ‘it isn’t so’ then") == ["it isn’t so"]
    assert inside('an open "mark\nand fool" here') == [] == inside('5" pipe')


def test_hits_stand_where_their_tokens_stand():
    lexicon = T.Lexicon({"scumbag": 5.0, "other": 2.0, "fool": 4.0}, frozenset({"scumbaggeries"}))
    parts = lambda text: dict(zip(T.SIGNALS, T.features(text, lexicon)))
    # A longer token in quotation marks that holds the term doesn't make the term a quoted one.
    longer = parts('all the "scumbaggeries" of a scumbag')
    assert longer["quoted"] == 0 < longer["plain"]
    apostrophes = parts("I don't care, fool, it isn't fine")
    assert apostrophes["quoted"] == 0 < apostrophes["plain"]
    assert parts('the term "scumbag" again')["plain"] == 0


def corpus(n=600):
    rng = random.Random(2)
    plain = [f"{a}{b}" for a in ("ba", "ke", "lo", "mi", "nu", "so") for b in ("ra", "te", "lim", "pon", "dak", "vis")]
    rows, labels = [], []
    for i in range(100, 100 + n):
        words = rng.choices(plain, k=40)
        toxic = i % 5 == 0
        if toxic:
            words[rng.randrange(40)] = rng.choice(["blockhead", "dimwitted", "blokchead" if i % 3 else "blockhead"])
        rows.append((i, " ".join(words)))
        labels.append((i, 1, int(toxic)))
    return rows, labels


def test_held_out_rows_are_told_apart(spark):
    rows, labels = corpus()
    toxic = {i: t for i, _, t in labels}
    table = spark.createDataFrame(labels + [(5, None, None), (None, 1, 1)], "doc_id long, quality int, toxic int")
    got = T.toxicity(documents(spark, rows + EDGES), table).collect()
    assert len(got) == len(rows) + len(EDGES)
    assert all(r.held_out == held_out(r.doc_id, 3, 1) and 0 <= r.score <= 1 and r.predicted == (r.score >= 0.7) for r in got)
    seen = [r for r in got if r.held_out and r.doc_id in toxic]
    assert len(seen) > 100 and np.mean([r.predicted == toxic[r.doc_id] for r in seen]) > 0.97


def test_labels_of_held_out_rows_are_not_used(spark):
    rows, labels = corpus(200)
    docs = documents(spark, rows)
    flipped = [(i, q, 1 - t if held_out(i, 3, 1) else t) for i, q, t in labels]
    a, b = (
        sorted((r.doc_id, r.score) for r in T.toxicity(docs, spark.createDataFrame(x, "doc_id long, quality int, toxic int")).collect())
        for x in (labels, flipped)
    )
    assert a == b


def test_without_labels(spark):
    none = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert {r.score for r in T.toxicity(documents(spark, EDGES), none).collect()} == {0.5}
    assert T.toxicity(documents(spark, []), none).count() == 0
