"""Body cleanup: markup removal, JSON bodies, character normalisation."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

# Boilerplate phrases of the news feeds.
BOILERPLATE = ("点击加载图片", "查看原文", "图片来源")


def strip_html(
    c: Column,
    *,
    single_line: bool = False,
    phrases: Sequence[str] = BOILERPLATE,
    phrase_fill: str | None = None,
) -> Column:
    """Plain text of a markup body, one line per paragraph.

    ``single_line`` joins the lines with blanks and by default leaves a blank
    where a boilerplate phrase stood.
    """
    fill = phrase_fill if phrase_fill is not None else (" " if single_line else "")
    steps = [
        (r"\n", " "),
        (r"<script>.*?</script>", ""),
        (r"(</p>|</br>)\n*", "\n"),
        (r"<[^>]+>", " "),
    ]
    if phrases:
        steps.append(("|".join(f"({p})" for p in phrases), fill))
    steps += [(r"\s*\n\s*", "\n"), (r"[ \t]+", " ")]
    if single_line:
        steps.append((r"\n", " "))
    text = F.coalesce(c, F.lit(""))
    for pattern, replacement in steps:
        text = F.regexp_replace(text, pattern, replacement)
    return text


def html_paragraphs(c: Column) -> Column:
    """Plain single-line texts of the parts between adjoining ``</p><p>`` tags."""
    parts = F.split(F.coalesce(c, F.lit("")), "</p><p>")
    return F.transform(parts, lambda s: strip_html(s, single_line=True, phrase_fill=""))


def is_json_object(c: Column) -> Column:
    # White space as JSON has it may stand in front.
    return c.rlike(r"^[ \t\r\n]*\{") & F.try_parse_json(c).isNotNull()


def json_descriptions(c: Column) -> Column:
    """``content[*].description`` of a JSON body, each followed by a newline."""
    parsed = F.from_json(c, "content array<struct<description: string>>")
    lines = F.transform(
        parsed["content"],
        lambda item: F.concat(F.coalesce(item["description"], F.lit("")), F.lit("\n")),
    )
    return F.coalesce(F.array_join(lines, ""), F.lit(""))


def body_text(c: Column) -> Column:
    """Descriptions of a JSON body; any other body as plain text of its markup."""
    return F.when(is_json_object(c), json_descriptions(c)).otherwise(strip_html(c))


def normalise_chars(
    c: Column, *, source: str = "", target: str = "", lowercase: bool = True
) -> Column:
    """Character-for-character mapping, then lower case."""
    text = F.translate(c, source, target) if source else c
    return F.lower(text) if lowercase else text
