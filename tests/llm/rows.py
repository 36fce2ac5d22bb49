"""Small tables for the tests of this folder."""

import zlib

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, score string, component_id long, piece string, key string"


def documents(spark, rows):
    """Documents of (id, text), with other columns whose names operators use themselves."""
    return spark.createDataFrame([(i, t, "en", None, len(t or ""), "x", -1, "y", None) for i, t in rows], SCHEMA)


def held_out(doc_id, n, r):
    return doc_id is not None and zlib.crc32(str(doc_id).encode()) % n == r


EDGES = [(1, None), (2, ""), (3, "  \n\t"), (4, "!!! ... ***"), (5, "one"), (5, "one"), (None, "no id here at all"), (7, "ünï cödé ☃ 中文 文字")]
