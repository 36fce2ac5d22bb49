"""Text profiling and cleaning over whole tables."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from newsloom.functions import strings


def profile_text(df: DataFrame, col: str, by: str) -> DataFrame:
    """Per ``by`` value: texts, blanks, CJK and Latin characters, trailing digits."""
    c = F.col(col)
    return df.groupBy(by).agg(
        F.count(F.lit(1)).alias("texts"),
        F.count(F.when(strings.is_blank(c), 1)).alias("blank"),
        F.sum(strings.cjk_count(c)).alias("cjk"),
        F.count(F.when(strings.contains_cjk(c), 1)).alias("with_cjk"),
        F.sum(strings.latin_count(c)).alias("latin"),
        F.sum(strings.tail_digit_count(c)).alias("tail_digits"),
    )


def clean_text(df: DataFrame, cols: Sequence[str], *, tail_digits: int | None = 1) -> DataFrame:
    """Half-width form, outer punctuation trimmed, up to ``tail_digits`` end digits dropped."""
    out = {}
    for name in cols:
        value = strings.trim_punct(strings.to_halfwidth(F.col(name)))
        out[name] = value if tail_digits is None else strings.trim_tail_digits(value, tail_digits)
    return df.withColumns(out)
