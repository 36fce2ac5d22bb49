"""Licence notices in texts, with the edits that typing, wrapping or scanning left in them.

Texts are brought to words (runs of ASCII letters, digits and non-ASCII characters, A-Z
lower-cased) joined by single blanks. Phrases are found word by word. Short notices are
found with up to ``edits(notice)`` errors: a notice is split into one part more than that, so
any occurrence holds one part unchanged (pigeonhole); an Aho-Corasick automaton over all parts
locates candidates, and the regex library's bounded-error matching verifies them and gives the
span and the number of edits. The words that name the licence must stand unchanged and as whole
words, so each such place near a seed is matched once, to its left and to its right; a notice
without a name is matched so from each of its seeds. A candidate's work is bounded by the
notice's length, so a text costs time in proportion to its seeds. Matches of one notice share no
character: those of fewer edits come first, then those that stand first.

Edge cases: a null text is an empty one: no words, no label, score 0. Repeated rows are returned
as often as they occur, an empty table gives no row; only id and text are read.
"""

from __future__ import annotations

import heapq
from bisect import bisect_right, insort

from pyspark.sql import DataFrame

from newsloom.llm.common import map_texts, word_runs

#: Phrases that must stand word by word, and their labels (fixed values).
PHRASES = {
    "under the mit license": "mit",
    "apache license version 2": "apache-2",
    "cc by nc": "cc-by-nc",
}
#: Short notices as their texts are commonly written, their labels, and the words that tell the licence
#: from others and so must stand unchanged (fixed values).
NOTICES = {
    "released under the mit license": ("mit", "mit"),
    "licensed under the mit license": ("mit", "mit"),
    "permission is hereby granted free of charge to any person obtaining a copy": ("mit", ""),
    "licensed under the apache license version 2 0": ("apache-2", "apache"),
    "you may not use this file except in compliance with the license": ("apache-2", ""),
    "licensed under cc by nc 4 0": ("cc-by-nc", "cc by nc"),
    "creative commons attribution noncommercial": ("cc-by-nc", "noncommercial"),
    "creative commons attribution non commercial": ("cc-by-nc", "non commercial"),
    "licensed under cc by sa 4 0": ("cc-by-sa", "cc by sa"),
    "creative commons attribution sharealike": ("cc-by-sa", "sharealike"),
    "creative commons attribution share alike": ("cc-by-sa", "share alike"),
    "licensed under the gnu general public license": ("gpl", "gnu general"),
    "terms of the gnu general public license": ("gpl", "gnu general"),
    "licensed under the gnu lesser general public license": ("lgpl", "lesser"),
    "licensed under the gnu affero general public license": ("agpl", "affero"),
    "redistribution and use in source and binary forms": ("bsd", ""),
    "subject to the terms of the mozilla public license": ("mpl", "mozilla"),
    "permission to use copy modify and or distribute this software": ("isc", ""),
    "this is free and unencumbered software released into the public domain": ("unlicense", ""),
}


def edits(notice: str) -> int:
    """Errors allowed in a notice: one in ten characters, so that a seed has seven or more."""
    return max(1, len(notice) // 10)


def seeds(notice: str) -> list[tuple[str, int]]:
    """(part, its place) of ``edits`` + 1 parts of about equal length."""
    k = edits(notice) + 1
    cuts = [len(notice) * i // k for i in range(k + 1)]
    return [(notice[a:b], a) for a, b in zip(cuts, cuts[1:])]


class NoticeSearch:
    """Fuzzy search of several notices in normalised texts."""

    def __init__(self, notices: dict[str, tuple[str, str]]):
        import ahocorasick
        import regex

        self.notices = list(notices.items())
        # Of each part that may stand unchanged, what is left and right of it; the left one is matched backwards.
        self.sides = []
        for text, (_, name) in self.notices:
            place = f" {text} ".find(f" {name} ")
            if name and place < 0:
                raise ValueError(f"{name!r} doesn't stand in {text!r} as words")
            sides = []
            for part, place in [(name, place)] if name else seeds(text):
                left, right = text[:place][::-1], text[place + len(part):]
                sides.append([
                    (len(x), regex.compile(f"(?b)(?:{regex.escape(x, literal_spaces=True)}){{e<={edits(text)}}}")) for x in (left, right)
                ])
            self.sides.append(sides)
        at: dict[str, list] = {}
        for n, (text, _) in enumerate(self.notices):
            for number, (part, place) in enumerate(seeds(text)):
                at.setdefault(part, []).append((n, number, place))
        self.automaton = ahocorasick.Automaton()
        for part, places in at.items():
            self.automaton.add_word(part, (len(part), places))
        self.automaton.make_automaton()

    def __call__(self, text: str) -> list[tuple[str, int, int, int]]:
        """(label, first character, character after the last, edits) of each match."""
        # By notice: its seeds, and where its text would start if they stood in place.
        hits: dict[int, set[tuple[int, int, int]]] = {}
        starts: dict[int, set[int]] = {}
        for end, (size, places) in self.automaton.iter(text):
            first = end + 1 - size
            for n, number, place in places:
                if self.notices[n][1][1]:
                    starts.setdefault(n, set()).add(first - place)
                else:
                    hits.setdefault(n, set()).add((first, end + 1, number))
        for n, firsts in starts.items():
            hits[n] = self.names(text, n, firsts)
        found, back = [], text[::-1]
        for n, anchors in hits.items():
            label = self.notices[n][1][0]
            found += [(label, *m) for m in settle(anchors, lambda c, a, b: self.around(text, back, n, c, a, b), len(text))]
        return sorted(found)

    def names(self, text: str, n: int, firsts: set[int]) -> set[tuple[int, int, int]]:
        """Places of the name as whole words, as near to its place as the edits allow."""
        notice, (_, name) = self.notices[n]
        k, place = edits(notice), f" {notice} ".find(f" {name} ")
        found, behind = set(), 0
        for first in sorted(firsts):
            last = max(0, first + place + k + len(name))
            at = text.find(name, max(0, first + place - k, behind), last)
            while at >= 0:
                stop = at + len(name)
                if (at == 0 or text[at - 1] == " ") and (stop == len(text) or text[stop] == " "):
                    found.add((at, stop, 0))
                behind = at + 1
                at = text.find(name, behind, last)
        return found

    def around(self, text: str, back: str, n: int, anchor: tuple[int, int, int], a: int, b: int) -> tuple[int, int, int] | None:
        """(edits, start, stop) of the best match in ``a`` to ``b`` that has the part ``anchor`` (start, stop, number) unchanged."""
        k, (start, stop, number) = edits(self.notices[n][0]), anchor
        if not a <= start <= stop <= b:
            return None
        (left, before), (right, behind) = self.sides[n][number]
        spent, turned = 0, len(text) - start
        if left:
            if not (m := before.match(back, turned, min(len(text) - a, turned + left + k))):
                return None
            start, spent = len(text) - m.end(), sum(m.fuzzy_counts)
        if right:
            if not (m := behind.match(text, stop, min(b, stop + right + k))):
                return None
            stop, spent = m.end(), spent + sum(m.fuzzy_counts)
        return (spent, start, stop) if spent <= k else None


def settle(candidates, find, end: int) -> list[tuple[int, int, int]]:
    """(start, stop, edits) of the candidates' best matches, taken in order of (edits, start), that share no character.

    ``find(candidate, a, b)`` gives (edits, start, stop) within a to b. A candidate whose match meets one
    taken before is tried again in what is left free around it.
    """
    queue = [(*m, c) for c in candidates if (m := find(c, 0, end))]
    heapq.heapify(queue)
    taken: list[tuple[int, int, int]] = []
    while queue:
        spent, start, stop, candidate = heapq.heappop(queue)
        at = bisect_right(taken, (start, end + 1, 0))
        met = [m for m in taken[max(0, at - 1):at] if m[1] > start]
        while at < len(taken) and taken[at][0] < stop:
            met.append(taken[at])
            at += 1
        if not met:
            insort(taken, (start, stop, spent))
            continue
        # Each gap beside the matches met, up to the next ones taken.
        low = bisect_right(taken, (met[0][0], -1, 0))
        edges = [taken[low - 1][1] if low else 0, *(e for m in met for e in m[:2]), taken[at][0] if at < len(taken) else end]
        for a, b in zip(edges[::2], edges[1::2]):
            if m := find(candidate, a, b):
                heapq.heappush(queue, (*m, candidate))
    return taken


def phrase_places(words: list[bytes], joined: bytes, phrases: dict[str, str]) -> dict[str, list[int]]:
    """Word numbers at which each phrase's words stand."""
    places: dict[str, list[int]] = {}
    framed = b" " + joined + b" "
    for phrase in phrases:
        needle = b" " + phrase.encode() + b" "
        at = framed.find(needle)
        while at >= 0:
            places.setdefault(phrase, []).append(framed.count(b" ", 0, at))
            at = framed.find(needle, at + 1)
    return places


def scan(docs: DataFrame, *, phrases: dict[str, str] | None = None, notices: dict[str, tuple[str, str]] | None = None) -> DataFrame:
    """Words, places, labels and fuzzy matches of every row of ``docs``.

    ``matches`` holds (label, start, stop, edits) in characters of the normalised text; the
    score is 1 with a phrase, else the best 1 - edits / (allowed edits + 1) of a match.
    """
    phrases = PHRASES if phrases is None else phrases
    notices = NOTICES if notices is None else notices
    allowed = {}
    for text, (label, _) in notices.items():
        allowed[label] = max(allowed.get(label, 0), edits(text))
    search = None

    def rows(ids, texts):
        nonlocal search
        if search is None:
            search = NoticeSearch(notices)
        for i, data in zip(ids, texts):
            words = word_runs(data)
            joined = b" ".join(words)
            places = phrase_places(words, joined, phrases)
            every = [p for found in places.values() for p in found]
            base = sorted({phrases[p] for p in places})
            matches = search(joined.decode()) if joined else []
            labels = sorted({*base, *(m[0] for m in matches)})
            score = 1.0 if base else max((1 - m[3] / (allowed[m[0]] + 1) for m in matches), default=0.0)
            yield (
                i, len(words), len(every), min(every, default=None), max(every, default=None), ",".join(base), ",".join(labels),
                score, [{"label": m[0], "start": m[1], "stop": m[2], "edits": m[3]} for m in matches],
            )

    return map_texts(
        docs,
        "doc_id long, n_words long, n_base long, first_word long, last_word long, base_labels string, labels string, "
        "score double, matches array<struct<label:string,start:long,stop:long,edits:int>>",
        rows, binary=True,
    )
