import random
import re
import time

from rows import EDGES, documents

from newsloom.llm import licenses


def base(text):
    low = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", low)
    places = []
    for phrase, label in licenses.PHRASES.items():
        p = phrase.split()
        places += [(i, label) for i in range(len(words)) if words[i: i + len(p)] == p]
    starts = [i for i, _ in places]
    return len(words), len(places), min(starts, default=None), max(starts, default=None), ",".join(sorted({b for _, b in places}))


def test_base_columns(spark):
    rng = random.Random(4)
    parts = list(licenses.PHRASES) + ["under", "the", "MIT", "License", "cc", "by", "nc", "apache", "ünder", "version", "2", "2.0", "x,"]
    rows = EDGES + [(100 + i, rng.choice([" ", "-", "\n"]).join(rng.choices(parts, k=40))) for i in range(80)]
    got = licenses.scan(documents(spark, rows)).collect()
    mine = [(r.doc_id, r.n_words, r.n_base, r.first_word, r.last_word, r.base_labels) for r in got]
    order = lambda r: (r[0] is None, r[0] or 0, r[1])
    assert sorted(mine, key=order) == sorted(((i, *base(t)) for i, t in rows), key=order)
    assert all(set(filter(None, r.base_labels.split(","))) <= set(r.labels.split(",")) for r in got)
    assert all(0 <= r.score <= 1 and (r.score == 1) >= (r.n_base > 0) for r in got)
    assert licenses.scan(documents(spark, [])).count() == 0


def test_edits_are_found_with_spans(spark):
    rows = [
        (1, "Licenced under the Apache Licence, Version 2.0 of it"), (2, "Relased under teh MIT license"),
        (3, "licensed under the GNU General Public License, version 3."), (4, "nothing of the kind, no licence"),
        (6, "Released under the BSD license"), (7, "Licensed under CC BY-SA 4.0."),
        (5, "x " * 5000 + "Redistribution and use in sorce and binary forms " + "y " * 5000),
    ]
    got = {r.doc_id: r for r in licenses.scan(documents(spark, rows)).collect()}
    assert got[1].labels == "apache-2" and got[1].base_labels == "" and 0 < got[1].score < 1
    assert got[2].labels == "mit" and got[3].labels == "gpl" and got[4].labels == "" and got[4].score == 0
    assert got[6].labels == "" and got[7].labels == "cc-by-sa"
    (hit,) = got[5].matches
    assert hit.label == "bsd" and hit.start == 10_000 and hit.edits == 1


def test_every_match_within_the_bound_is_found():
    rng = random.Random(8)
    search = licenses.NoticeSearch(licenses.NOTICES)
    for notice, (label, key) in licenses.NOTICES.items():
        for _ in range(20):
            text = list(notice)
            for _ in range(licenses.edits(notice)):
                at = rng.randrange(len(text))
                rng.choice([lambda: text.pop(at), lambda: text.insert(at, "q"), lambda: text.__setitem__(at, "q")])()
            if f" {key} " not in f" {''.join(text)} ":
                continue
            padded = "some words before " + "".join(text) + " some words behind"
            assert label in {m[0] for m in search(padded)}, (notice, "".join(text))


def distances(notice, text):
    """By plain dynamic programming, least edits of the notice to a piece of the text that ends at each place."""
    row = [0] * (len(text) + 1)
    for i, c in enumerate(notice, 1):
        diagonal, row[0] = row[0], i
        for j, d in enumerate(text, 1):
            diagonal, row[j] = row[j], min(diagonal + (c != d), row[j] + 1, row[j - 1] + 1)
    return row


def whole(notice, piece):
    """Edit distance of two texts."""
    row = list(range(len(piece) + 1))
    for i, c in enumerate(notice, 1):
        diagonal, row[0] = row[0], i
        for j, d in enumerate(piece, 1):
            diagonal, row[j] = row[j], min(diagonal + (c != d), row[j] + 1, row[j - 1] + 1)
    return row[-1]


def least_edits(notice, key, text):
    """Of every place that can match: the name's place (the match's end without a name), and least edits."""
    k = licenses.edits(notice)
    if not key:
        return {j: d for j, d in enumerate(distances(notice, text)) if d <= k}
    cut = f" {notice} ".index(f" {key} ")
    left, right, out = notice[:cut], notice[cut + len(key):], {}
    for m in re.finditer(f"(?=(?<![^ ]){re.escape(key)}(?![^ ]))", text):
        a, b = m.start(), m.start() + len(key)
        d = distances(left, text[:a])[-1] + distances(right[::-1], text[b:][::-1])[-1]
        if d <= k:
            out[a] = d
    return out


def test_spans_and_edits_equal_a_plain_scan():
    rng = random.Random(12)
    search = licenses.NoticeSearch(licenses.NOTICES)
    notices = list(licenses.NOTICES.items())
    for round_ in range(40):
        parts = []
        for notice, _ in rng.choices(notices, k=4):
            text = list(notice)
            for _ in range(rng.randint(0, licenses.edits(notice) + 1)):
                at = rng.randrange(len(text))
                rng.choice([lambda: text.pop(at), lambda: text.insert(at, rng.choice("aeq ")), lambda: text.__setitem__(at, "q")])()
            parts += [" ".join("".join(text).split()), rng.choice(["", "and", "all of these words between them"])]
        text = " ".join(" ".join(parts).split())
        for notice, (label, key) in notices:
            own = licenses.NoticeSearch({notice: (label, key)})(text)
            places = least_edits(notice, key, text)
            # Every match is one, of as few edits as its place allows, and none meets another.
            for _, start, stop, spent in own:
                assert whole(notice, text[start:stop]) == spent <= licenses.edits(notice)
                at = [p for p in places if start <= p and p + len(key) <= stop]
                assert at and min(places[p] for p in at) <= spent
            assert all(x[2] <= y[1] for x, y in zip(own, own[1:]))
            # A place without a match of its own is met by one of no more edits.
            for p, d in places.items():
                reach = len(notice) + licenses.edits(notice)
                assert any(s <= p + reach and p - reach <= t and e <= d for _, s, t, e in own), (notice, text, p, d)
            assert not own or label in {m[0] for m in search(text)}


def test_name_stands_as_whole_words():
    search = licenses.NoticeSearch(licenses.NOTICES)
    labels = lambda text: {m[0] for m in search(text)}
    assert labels("released under the permit license") == set() == labels("creative commons attribution commercial")
    assert labels("creative commons attribution non commercial") == labels("creative comons atribution noncommercial") == {"cc-by-nc"}
    assert labels("creative commons attribution share alike") == {"cc-by-sa"}
    assert labels("terms of the gnu affero general public license") == set()
    assert labels("released under the mit licence") == {"mit"}


def test_time_follows_the_length_of_a_repeated_notice():
    search = licenses.NoticeSearch(licenses.NOTICES)
    for notice, label in [
        ("licensed under the gnu lesser general public license ", "lgpl"), ("terms of the gnu affero general public license ", None),
        ("permission is hereby granted free of charge to any persn obtaining a copy ", "mit"),
        ("licensed under the apache licence version 2 0 ", "apache-2"),
    ]:
        times = 100_000 // len(notice)
        start = time.perf_counter()
        found = search((notice * times).strip())
        took = time.perf_counter() - start
        assert took < 2, (notice, took)
        assert sum(m[0] == label for m in found) == (times if label else 0)
