"""Tokens and ``word/nature`` terms."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

TOKEN = r"[\p{L}\p{N}]+"
NUMBER_WORD = "<num>"
NUMERIC = r"^[\d\p{Punct}]+$"
TERM = r"(?s)^(.+)/([^/]*)$"


def tokens(c: Column, lowercase: bool = True) -> Column:
    text = F.lower(c) if lowercase else c
    return F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(TOKEN), F.lit(0))


def text_lines(c: Column) -> Column:
    """Non-blank lines."""
    return F.filter(F.split(F.coalesce(c, F.lit("")), "\n"), lambda s: F.trim(s) != "")


def number_to_marker(word: Column) -> Column:
    return F.when(word.rlike(NUMERIC), F.lit(NUMBER_WORD)).otherwise(word)


def parse_terms(c: Column) -> Column:
    """``"w/n,w/v"`` as an array of (word, nature), cut at the last slash.

    Entries without a word before the slash are dropped.
    """
    parts = F.filter(F.split(F.coalesce(c, F.lit("")), ","), lambda t: t.rlike(TERM))
    return F.transform(
        parts,
        lambda t: F.struct(
            number_to_marker(F.regexp_extract(t, TERM, 1)).alias("word"),
            F.regexp_extract(t, TERM, 2).alias("nature"),
        ),
    )


def noun_words(terms: Column, min_len: int = 1) -> Column:
    kept = F.filter(
        terms, lambda t: t["nature"].startswith("n") & (F.length(t["word"]) >= min_len)
    )
    return F.transform(kept, lambda t: t["word"])


def is_vocabulary_nature(nature: Column) -> Column:
    """Natures that count as vocabulary nouns: n* and mz* and mbk, but not nx*."""
    noun = nature.startswith("n") & ~nature.startswith("nx")
    return noun | nature.startswith("mz") | (nature == "mbk")


def bind(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` over a value that is computed once per row."""
    return F.element_at(F.transform(F.array(value), lambda x: body(x)), 1)


def word_counts(words: Column) -> Column:
    """(word, n) of an array of words, counted inside the row.

    The sorted array is cut where the word changes, so an article's counts need no
    shuffle and no time beyond the sort, which is that of plain values: ``array_sort`` would
    call a comparing function for each two words.
    """

    def cut(s: Column) -> Column:
        starts = F.filter(
            F.sequence(F.lit(0), F.size(s) - 1),
            lambda i: (i == 0) | (F.get(s, i) != F.get(s, i - 1)),
        )
        return bind(starts, lambda at: runs(s, at))

    def runs(s: Column, at: Column) -> Column:
        ends = F.concat(F.slice(at, F.lit(2), F.size(at)), F.array(F.size(s)))
        return F.zip_with(
            at, ends, lambda a, b: F.struct(F.get(s, a).alias("word"), (b - a).cast("long").alias("n"))
        )

    none = F.array().cast("array<struct<word:string,n:bigint>>")
    return F.when(F.size(words) > 0, bind(F.sort_array(words), cut)).otherwise(none)


def distinct_terms(title: Column, content: Column) -> Column:
    """Distinct words in order of first occurrence, title first."""
    return F.array_distinct(F.concat(title, content))
