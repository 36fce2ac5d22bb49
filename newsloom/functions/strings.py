"""String profiling and cleaning as native column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# The character ranges and punctuation sets the text rules are defined on.
CJK = "[一-鿋]"
NOT_CJK = "[^一-鿋]"
WIDE_PUNCT = "· ~（）『』【】；：’‘“”《》，。？/、… "
SEPARATORS = " !#^*(){}\t\n[]\\_|\";:,<>/?· ~（）『』【】；：’‘“”《》，。？/、…"
WORD_PATTERN = r"(\w[\-\w]+\w)|(\d+[-.]?\d+%?)|([a-zA-Z]+['-]?[a-zA-Z]+)"

EDGE_BLANKS = r"^[\x00-\x20]+|[\x00-\x20]+\z"
PUNCT_CLASS = r"[\p{Punct}" + WIDE_PUNCT + "]"


def char_class(chars: str, negate: bool = False) -> str:
    escaped = "".join("\\" + c if c in r"\[]^-&" else c for c in dict.fromkeys(chars))
    return f"[{'^' if negate else ''}{escaped}]"


def trim_blanks(c: Column) -> Column:
    """Drop leading and trailing characters up to U+0020."""
    return F.regexp_replace(c, EDGE_BLANKS, "")


def is_blank(c: Column) -> Column:
    return c.isNull() | (c == "")


def cjk_count(c: Column) -> Column:
    return F.regexp_count(c, F.lit(CJK))


def contains_cjk(c: Column) -> Column:
    return c.rlike(CJK)


def latin_count(c: Column) -> Column:
    return F.regexp_count(c, F.lit("[A-Za-z]"))


def tail_digit_count(c: Column) -> Column:
    return F.coalesce(F.length(F.regexp_extract(c, r"([0-9]*)\z", 1)), F.lit(0))


def trim_punct(c: Column) -> Column:
    head = F.regexp_replace(trim_blanks(c), f"^{PUNCT_CLASS}+", "")
    return F.regexp_replace(head, PUNCT_CLASS + r"+\z", "")


def to_halfwidth(c: Column) -> Column:
    """U+3000 becomes a blank; U+FF01..U+FF5E move down to ASCII."""
    wide = "　" + "".join(chr(i) for i in range(0xFF01, 0xFF5F))
    narrow = " " + "".join(chr(i - 65248) for i in range(0xFF01, 0xFF5F))
    return F.translate(c, wide, narrow)


def trim_tail_digits(c: Column, most: int = 1, head_cjk_min: int | None = None) -> Column:
    """Drop up to ``most`` trailing digits.

    With ``head_cjk_min`` the digits only go when the head has that many CJK
    characters and ends with one.
    """
    text = trim_blanks(c)
    n = tail_digit_count(text)
    head = trim_blanks(F.substring(text, F.lit(1), F.length(text) - n))
    drop = n <= most
    if head_cjk_min is not None:
        drop = drop & (cjk_count(head) >= head_cjk_min) & head.rlike(CJK + r"\z")
    return F.when(drop, head).otherwise(text)


def split_words(c: Column) -> Column:
    """Latin/number tokens, and each CJK character standing before the last token."""
    found = F.regexp_extract_all(c, F.lit(f"{WORD_PATTERN}|({CJK})"), F.lit(0))
    token_ends = F.transform(
        found, lambda t, i: F.when(t.rlike(f"^{CJK}\\z"), F.lit(0)).otherwise(i + 1)
    )
    return F.slice(found, F.lit(1), F.coalesce(F.array_max(token_ends), F.lit(0)))


def split_scripts(c: Column) -> Column:
    return F.regexp_extract_all(c, F.lit(f"{CJK}+|{NOT_CJK}+"), F.lit(0))


def split_scripts_words(c: Column) -> Column:
    """Cut at script changes and around separators; separators go, pieces are trimmed."""
    plain = char_class(SEPARATORS, negate=True)[:-1] + CJK[1:]
    pieces = F.regexp_extract_all(c, F.lit(f"{CJK}+|{plain}+"), F.lit(0))
    # Only pieces with something to trim pay for the trimming expressions.
    edge = rf"^[\x00-\x20]|^{PUNCT_CLASS}|{PUNCT_CLASS}\z|[\x00-\x20]\z"
    return F.transform(pieces, lambda p: F.when(p.rlike(edge), trim_punct(p)).otherwise(p))
