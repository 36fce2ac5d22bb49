import random
import re

from pyspark.sql import functions as F
from rows import EDGES, documents

from newsloom.llm import decontaminate


def words(text):
    low = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", low)


def grams(w, n):
    return {tuple(w[i: i + n]) for i in range(len(w) - n + 1)}


def plain(docs, items):
    out = []
    for i, text in docs:
        found = []
        for k, item in items:
            w = words(item)
            if w:
                need = grams(w, min(5, len(w)))
                share = len(need & grams(words(text), min(5, len(w)))) / len(need)
                if share >= 0.8:
                    found.append((k, share))
        out.append((i, sorted(found)))
    return out


def fixture():
    rng = random.Random(5)
    vocabulary = [f"w{i}" for i in range(60)] + ["Été", "中文"]
    items = [(k, " ".join(rng.choices(vocabulary, k=n))) for k, n in enumerate([3, 5, 6, 9, 12, 20, 31, 33, 64, 100])]
    items += [(50, None), (51, "..."), (52, items[4][1])]
    docs = []
    for d in range(60):
        w = rng.choices(vocabulary, k=rng.choice([0, 4, 30, 400]))
        for _ in range(rng.choice([0, 1, 2])):
            item = rng.choice(items[:10])[1].split()
            for _ in range(rng.choice([0, 0, 1, 2])):
                item[rng.randrange(len(item))] = "changed"
            at = rng.randrange(len(w) + 1)
            w[at:at] = item
        docs.append((d, rng.choice([" ", ", ", "\n"]).join(w).upper() if d % 2 else " ".join(w)))
    return docs + EDGES, items


def test_equals_all_pairs(spark):
    docs, items = fixture()
    bench = spark.createDataFrame(items, "item_id long, text string")
    got = decontaminate.find_items(documents(spark, docs), bench).collect()
    mine = [(r.doc_id, list(zip(r.item_ids, r.containment))) for r in got]
    order = lambda r: (r[0] is None, r[0] or 0, r[1])
    assert sorted(mine, key=order) == sorted(plain(docs, items), key=order)
    assert all(r.contaminated == bool(r.item_ids) for r in got) and any(r.contaminated for r in got)
    kept = decontaminate.keep_clean(documents(spark, docs), bench)
    assert sorted(r.doc_id or 0 for r in kept.collect()) == sorted(i or 0 for i, f in plain(docs, items) if not f)


def test_blocks_of_items_give_the_same(spark):
    docs, items = fixture()
    docs = docs + docs[:3]
    bench = spark.createDataFrame(items + [items[5]], "item_id long, text string")
    blocks = decontaminate.Blocks(bench, 5, 0.8, 2000)
    assert blocks.number > 1
    for k in range(blocks.number):
        share, _ = blocks.send(k)
        rows = blocks.table.where(blocks._block() == k).collect()
        assert sum(r.bytes for r in rows) <= 2000 or len({r.words for r in rows}) == 1
        share.destroy()
    want = decontaminate.find_items(documents(spark, docs), bench).collect()
    got = decontaminate.find_items(documents(spark, docs), bench, block_bytes=2000).collect()
    order = lambda r: (r.doc_id is None, r.doc_id or 0, r.item_ids, r.containment)
    assert sorted(map(tuple, got), key=str) == sorted(map(tuple, want), key=str) and any(len(r.item_ids) > 1 for r in sorted(want, key=order))
    clean = documents(spark, docs).withColumn("mark", F.lit("own"))
    one, several = decontaminate.keep_clean(clean, bench), decontaminate.keep_clean(clean, bench, block_bytes=2000)
    assert one.columns == several.columns and sorted(map(str, one.collect())) == sorted(map(str, several.collect()))


def test_classes_share_a_sketch_size_and_prune(spark):
    rng = random.Random(3)
    items = [(n, " ".join(rng.choices([f"v{i}" for i in range(10_000)], k=n + 4))) for n in range(1, 130)]
    rows = decontaminate.sketches(spark.createDataFrame(items, "item_id long, text string")).collect()
    for r in rows:
        largest = (2 << r["class"]) - 1
        assert r.n == r.item_id and 1 << r["class"] <= r.n <= largest
        assert len(r.hashes) == min(r.n, decontaminate.sketch_size(largest, 0.8))
    table = decontaminate.Blocks(spark.createDataFrame(items, "item_id long, text string"), 5, 0.8, 1 << 30).table.drop("bytes").toArrow()
    index, known = decontaminate.Index(table, 5, 0.8), decontaminate._WordHash()
    (row,) = [r for r in rows if r.item_id == 121]
    assert row.hits == 2
    whole, sketch = [w.encode() for w in items[120][1].split()], set(row.hashes)
    for n in range(len(whole) + 1):
        held = decontaminate.shingle_hashes(whole[:n], 5, known).view("int64").tolist()
        # Too few of the sketch, or fewer shingles than the class's smallest item (64) needs: no candidate.
        want = [121] if len(sketch & set(held)) >= 2 and len(held) >= 52 else []
        assert [index.ids[k] for k in index.candidates(whole[:n], known)] == want


def test_empty_tables(spark):
    none = spark.createDataFrame([], "item_id long, text string")
    assert decontaminate.find_items(documents(spark, []), none).count() == 0
    assert not any(r.contaminated for r in decontaminate.find_items(documents(spark, EDGES), none).collect())
