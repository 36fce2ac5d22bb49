"""Cleanup, profiling and tokeniser queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from newsloom.functions import clean, strings, terms
from newsloom.operators.cooccurrence import cooccurrence_pairs
from newsloom.operators.profile import clean_text, profile_text
from newsloom.plans.staging import dealt
from newsloom.registry import corpus as c
from newsloom.registry import query
from newsloom.registry.stats import nature_rule
from newsloom.sources.articles import encode_segmented, segment_articles, segment_paragraphs, to_terms

# The corpus is in Latin script. Swapping some letters for CJK characters, full-width
# digits and punctuation over the whole texts gives the mixed-script rules work to do.
_FROM = "aeioukw-3"
_TO = "我们中国人。（　３"
MIXED_SQL = f"translate(text, '{_FROM}', '{_TO}')"

_CJK = strings.CJK
_PUNCT_SQL = "[[:punct:]" + strings.WIDE_PUNCT.replace("'", "''") + "]"
_WIDE = "　" + "".join(chr(i) for i in range(0xFF01, 0xFF5F))
_NARROW = (" " + "".join(chr(i - 65248) for i in range(0xFF01, 0xFF5F))).replace("'", "''")


def mixed():
    return F.translate(F.col("text"), _FROM, _TO)


def _trim_sql(x):
    return rf"regexp_replace({x}, '^[\x00-\x20]+|[\x00-\x20]+\z', '', 'g')"


def _count_sql(x, pattern):
    return f"len(regexp_extract_all({x}, '{pattern}'))"


def _punct_sql(x):
    return rf"regexp_replace(regexp_replace({_trim_sql(x)}, '^{_PUNCT_SQL}+', ''), '{_PUNCT_SQL}+\z', '')"


def _tail_sql(x):
    return rf"length(regexp_extract({x}, '([0-9]*)\z', 1))"


@query(
    "profile_text_by_lang",
    f"""WITH m AS (SELECT lang, {MIXED_SQL} AS t FROM documents)
        SELECT lang, count(*) AS texts, count(CASE WHEN t IS NULL OR t = '' THEN 1 END) AS blank,
               sum({_count_sql('t', _CJK)})::BIGINT AS cjk,
               count(CASE WHEN regexp_matches(t, '{_CJK}') THEN 1 END) AS with_cjk,
               sum({_count_sql('t', '[A-Za-z]')})::BIGINT AS latin,
               sum({_tail_sql('t')})::BIGINT AS tail_digits
        FROM m GROUP BY lang""",
)
def profile_text_by_lang(spark, sf):
    texts = c.documents(spark, sf).select("lang", mixed().alias("t"))
    return profile_text(texts, "t", "lang")


@query(
    "clean_text_columns",
    rf"""WITH m AS (SELECT doc_id, {MIXED_SQL} AS t FROM documents),
        p AS (SELECT doc_id, {_punct_sql(f"translate(t, '{_WIDE}', '{_NARROW}')")} AS t FROM m),
        d AS (SELECT doc_id, {_trim_sql('t')} AS t FROM p)
        SELECT doc_id, md5(CASE WHEN {_tail_sql('t')} <= 2
               THEN {_trim_sql(f"substr(t, 1, length(t) - {_tail_sql('t')})")} ELSE t END) AS cleaned,
               length(t) AS n FROM d""",
)
def clean_text_columns(spark, sf):
    texts = c.documents(spark, sf).select("doc_id", mixed().alias("t"))
    cleaned = clean_text(texts, ["t"], tail_digits=2)
    # The length before the digit rule is kept next to the result as a second check.
    before = clean_text(texts, ["t"], tail_digits=None)
    both = before.select("doc_id", F.length(strings.trim_blanks(F.col("t"))).alias("n"))
    return cleaned.select("doc_id", F.md5(F.encode("t", "utf-8")).alias("cleaned")).join(both, "doc_id")


@query(
    "trim_tail_digits_after_cjk",
    rf"""WITH s AS (SELECT doc_id, unnest(string_split({MIXED_SQL}, ' ')) AS w FROM documents),
        t AS (SELECT doc_id, {_trim_sql('w')} AS w FROM s),
        h AS (SELECT doc_id, w, {_tail_sql('w')} AS n,
                     {_trim_sql(f"substr(w, 1, length(w) - {_tail_sql('w')})")} AS head FROM t)
        SELECT w AS word, CASE WHEN n <= 1 AND {_count_sql('head', _CJK)} >= 2
                AND regexp_matches(head, '{_CJK}\z') THEN head ELSE w END AS trimmed,
               count(*) AS n FROM h GROUP BY 1, 2""",
)
def trim_tail_digits_after_cjk(spark, sf):
    words = c.documents(spark, sf).select(F.explode(F.split(mixed(), " ")).alias("w"))
    trimmed = strings.trim_tail_digits(F.col("w"), 1, head_cjk_min=2)
    return (
        words.select(strings.trim_blanks(F.col("w")).alias("word"), trimmed.alias("trimmed"))
        .groupBy("word", "trimmed")
        .agg(F.count(F.lit(1)).alias("n"))
    )


_SPLIT_WORDS_SQL = rf"""
    list_transform(regexp_extract_all(t, '{strings.WORD_PATTERN.replace("'", "''")}|{_CJK}'), lambda x: x)"""


@query(
    "split_words",
    rf"""WITH m AS (SELECT doc_id, {MIXED_SQL} AS t FROM documents),
        f AS (SELECT doc_id, {_SPLIT_WORDS_SQL} AS ws FROM m),
        e AS (SELECT doc_id, unnest(ws) AS word, generate_subscripts(ws, 1) AS i FROM f),
        l AS (SELECT doc_id, max(i) AS last FROM e WHERE NOT regexp_full_match(word, '{_CJK}') GROUP BY doc_id)
        SELECT word, count(*) AS n FROM e JOIN l USING (doc_id) WHERE i <= last GROUP BY word""",
)
def split_words(spark, sf):
    found = c.documents(spark, sf).select(F.explode(strings.split_words(mixed())).alias("word"))
    return found.groupBy("word").agg(F.count(F.lit(1)).alias("n"))


@query(
    "split_scripts",
    f"""WITH p AS (SELECT unnest(regexp_extract_all({MIXED_SQL}, '{_CJK}+|{strings.NOT_CJK}+')) AS piece
                   FROM documents) SELECT piece, count(*) AS n FROM p GROUP BY piece""",
)
def split_scripts(spark, sf):
    found = c.documents(spark, sf).select(F.explode(strings.split_scripts(mixed())).alias("piece"))
    return found.groupBy("piece").agg(F.count(F.lit(1)).alias("n"))


_SEP = strings.char_class(strings.SEPARATORS).replace("'", "''")
_PLAIN = (strings.char_class(strings.SEPARATORS, negate=True)[:-1] + _CJK[1:]).replace("'", "''")


@query(
    "split_scripts_words",
    rf"""WITH p AS (SELECT unnest(regexp_extract_all({MIXED_SQL}, '{_SEP}|{_CJK}+|{_PLAIN}+')) AS x
                   FROM documents)
        SELECT {_punct_sql('x')} AS piece, count(*) AS n FROM p
        WHERE NOT regexp_full_match(x, '{_SEP}') GROUP BY 1""",
)
def split_scripts_words(spark, sf):
    found = c.documents(spark, sf).select(
        F.explode(strings.split_scripts_words(mixed())).alias("piece")
    )
    return found.groupBy("piece").agg(F.count(F.lit(1)).alias("n"))


def _strip_sql(x, single_line=False, fill=None):
    out = rf"regexp_replace({x}, '\n', ' ', 'g')"
    phrases = "|".join(f"({p})" for p in clean.BOILERPLATE)
    steps = [
        (r"<script>.*?</script>", "''"), (r"(</p>|</br>)\n*", "chr(10)"), (r"<[^>]+>", "' '"),
        (phrases, fill or ("' '" if single_line else "''")), (r"[ \t\n\r\f\v]*\n[ \t\n\r\f\v]*", "chr(10)"),
        (r"[ \t]+", "' '"),
    ]
    if single_line:
        steps.append((r"\n", "' '"))
    for pattern, to in steps:
        out = f"regexp_replace({out}, '{pattern}', {to}, 'g')"
    return out


@query("page_plain_text", f"SELECT page_id, {_strip_sql('html')} AS body FROM pages")
def page_plain_text(spark, sf):
    return c.table(spark, sf, "pages").select("page_id", clean.strip_html(F.col("html")).alias("body"))


@query("page_single_line", f"SELECT page_id, {_strip_sql('html', True)} AS body FROM pages")
def page_single_line(spark, sf):
    return c.table(spark, sf, "pages").select(
        "page_id", clean.strip_html(F.col("html"), single_line=True).alias("body")
    )


@query(
    "page_paragraph_pairs",
    rf"""WITH p AS (SELECT page_id, unnest(string_split(html, '</p><p>')) AS part,
                       generate_subscripts(string_split(html, '</p><p>'), 1) AS paragraph FROM pages),
        w AS (SELECT page_id, paragraph,
                     regexp_extract_all(lower({_strip_sql('part', True, "''")}), '[\p{{L}}\p{{N}}]+') AS ws FROM p),
        t AS (SELECT page_id, paragraph, unnest(ws) AS word, generate_subscripts(ws, 1) AS pos FROM w)
        SELECT least(x.word, y.word) AS a, greatest(x.word, y.word) AS b, count(*) AS n
        FROM t x JOIN (SELECT unnest([1, 2, 3, 4]) AS d) ON true
        JOIN t y ON y.page_id = x.page_id AND y.paragraph = x.paragraph AND y.pos = x.pos + d
        WHERE x.word <> y.word GROUP BY 1, 2""",
)
def page_paragraph_pairs(spark, sf):
    pages = c.table(spark, sf, "pages").select(F.col("page_id").alias("id"), F.col("html").alias("content"))
    return cooccurrence_pairs(segment_paragraphs(dealt(pages)))


@query(
    "body_text_json_or_markup",
    f"""SELECT doc_id AS id, string_agg(line || chr(10), '' ORDER BY i) AS body
        FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS line,
                     generate_subscripts(string_split(text, chr(10)), 1) AS i FROM documents)
        GROUP BY doc_id
        UNION ALL SELECT -1 - page_id, {_strip_sql('html')} FROM pages""",
)
def body_text_json_or_markup(spark, sf):
    lines = F.transform(F.split("text", "\n"), lambda s: F.struct(s.alias("description")))
    wrapped = c.documents(spark, sf).select(
        F.col("doc_id").alias("id"), F.to_json(F.struct(lines.alias("content"))).alias("raw")
    )
    markup = c.table(spark, sf, "pages").select((-1 - F.col("page_id")).alias("id"), F.col("html").alias("raw"))
    return wrapped.unionByName(markup).select("id", clean.body_text(F.col("raw")).alias("body"))


@query(
    "normalise_chars",
    "SELECT doc_id, lower(translate(text, 'éèêçüñóí', 'eeecunoi')) AS t FROM documents",
)
def normalise_chars(spark, sf):
    text = clean.normalise_chars(F.col("text"), source="éèêçüñóí", target="eeecunoi")
    return c.documents(spark, sf).select("doc_id", text.alias("t"))


@query(
    "segment_articles",
    f"""WITH {c.with_bodies(c.TOKENS)}
        SELECT id, sentence::INT AS sentence, count(*) AS words, md5(string_agg(word, ' ' ORDER BY pos)) AS digest
        FROM tokens GROUP BY id, sentence""",
)
def segment_with_dedup(spark, sf):
    """Doubled input rows, as a table that holds articles twice delivers them."""
    rows = c.articles(spark, sf, c.HEADLINE)
    again = rows.withColumn("content", F.concat(F.col("content"), F.lit("\n~ reprinted")))
    long = segment_articles(rows.unionByName(again))
    parts = F.concat(F.array("title_words"), F.col("sentences"))
    return (
        long.select("id", F.posexplode(parts).alias("sentence", "words"))
        .where(F.size("words") > 0)
        .select(
            "id", "sentence", F.size("words").cast("long").alias("words"),
            F.md5(F.encode(F.array_join("words", " "), "utf-8")).alias("digest"),
        )
    )


@query(
    "noun_terms",
    f"""WITH {c.TOKENS}, t AS (SELECT id, sentence, pos, CASE WHEN regexp_full_match(word, '[0-9]+') THEN '<num>' ELSE word END AS word,
          CASE length(word) % 7 WHEN 0 THEN 'v' WHEN 1 THEN 'nx' WHEN 2 THEN 'mz'
            WHEN 3 THEN 'mbk' WHEN 4 THEN 'm' ELSE 'nz' END AS nature FROM tokens)
        SELECT id, word, count(*) AS n FROM t WHERE nature LIKE 'n%' GROUP BY id, word""",
)
def noun_terms(spark, sf):
    """Encoded terms of every article, parsed back and reduced to nouns."""
    encoded = encode_segmented(c.segmented(spark, sf), nature_rule)
    lines = F.split(F.concat_ws(",###,", "title", "content"), ",###,")
    words = F.flatten(F.transform(lines, lambda s: terms.noun_words(terms.parse_terms(s))))
    return (
        encoded.select("id", F.explode(words).alias("word"))
        .groupBy("id", "word").agg(F.count(F.lit(1)).alias("n"))
    )


@query(
    "lexicon_terms",
    f"""WITH {c.TOKENS}, lex AS (
          SELECT word, CASE WHEN count(*) > 100 THEN 'v' ELSE 'nz' END AS nature FROM tokens
          GROUP BY word HAVING count(*) > 1)
        SELECT coalesce(nature, 'n') AS nature, count(*) AS n, count(DISTINCT word) AS words
        FROM tokens LEFT JOIN lex USING (word) GROUP BY 1""",
)
def lexicon_terms(spark, sf):
    from newsloom.operators.stats import corpus_word_count

    seg = c.segmented(spark, sf)
    lexicon = corpus_word_count(seg).where("n > 1").select(
        "word", F.when(F.col("n") > 100, "v").otherwise("nz").alias("nature")
    )
    per_word = to_terms(seg, lexicon=lexicon).groupBy("nature", "word").agg(F.count(F.lit(1)).alias("n"))
    return per_word.groupBy("nature").agg(F.sum("n").alias("n"), F.count(F.lit(1)).alias("words"))


@query(
    "distinct_terms",
    f"""WITH {c.TOKENS}, f AS (SELECT id, word, min(sentence * 1000000 + pos) AS p FROM tokens GROUP BY id, word)
        SELECT id, count(*) AS n, md5(string_agg(word, ' ' ORDER BY p)) AS digest FROM f GROUP BY id""",
)
def distinct_terms(spark, sf):
    seg = c.segmented(spark, sf)
    words = terms.distinct_terms(F.col("title_words"), F.flatten("sentences"))
    return seg.select("id", words.alias("w")).where(F.size("w") > 0).select(
        "id", F.size("w").cast("long").alias("n"),
        F.md5(F.encode(F.array_join("w", " "), "utf-8")).alias("digest"),
    )
