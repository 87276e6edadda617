"""Line-first cleaning and the base quality statistics of a text, in built-in functions only.

Every line is judged on its own: by its share of punctuation, as navigation, or as boilerplate.
Failing lines are removed, and a document that loses too much of its text is rejected.

Defined results: texts of any length are judged whole; null text counts as empty; a text without words fails the base rule; repeated rows
are judged each; an empty table gives no rows.  Columns other than the text pass through unread,
except that those named like a result (base, clean, base_failed, kept) are replaced.
"""

from __future__ import annotations

import functools
import operator

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from drawlake.llm.common import WORD, documents, let, words_of

#: Percentages: punctuation in a line's characters, separators in its words, characters a document may lose.
MAX_PUNCTUATION, MIN_SEPARATORS, MAX_LOST = 15, 20, 40
#: A line without closing mark and with fewer words is a menu entry; boilerplate phrases count in lines of at most so many words.
MENU_WORDS, PHRASE_WORDS = 4, 25
# Phrases of lines that are not the page's own text.
PHRASES = ("all rights reserved", "privacy policy", "terms of service", "terms of use", "cookie policy", "we use cookies", "click here",
           "sign in", "log in", "subscribe to our", "share this", "read more", "skip to content", "enable javascript", "lorem ipsum", "powered by")
PUNCTUATION, SEPARATORS, CLOSING = r"[!-/:-@\[-`{-~]", r"[|»›•·]", r"[.!?:;…。！？][\x22'»”’)\]]*$"
BASE_SYMBOLS = r"[#*$%&|<>]"
RULES = ("punctuation", "navigation", "boilerplate")


def repeated_window_words(words: Column, width: int = 3) -> Column:
    """Number of words that lie in a ``width``-word window found twice or more in the text."""
    def windows(w: Column) -> Column:
        at = F.sequence(F.lit(1), F.size(w) - F.lit(width - 1))
        return F.transform(at, lambda i: F.xxhash64(*[F.element_at(w, i + F.lit(k)) for k in range(width)]))

    def covered(places: Column) -> Column:
        following = F.slice(places, F.lit(2), F.size(places))
        return F.aggregate(F.zip_with(places, following, lambda a, b: F.least(F.lit(width), b - a)), F.lit(0), lambda s, x: s + x)

    def repeated(hashes: Column) -> Column:
        keyed = F.sort_array(F.transform(hashes, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
        none = F.array().cast("array<int>")

        def places(s: Column) -> Column:
            pairs = F.zip_with(s, F.slice(s, F.lit(2), F.size(s)), lambda a, b: F.when(a["h"] == b["h"], F.array(a["i"], b["i"])).otherwise(none))
            return F.sort_array(F.array_distinct(F.flatten(pairs)))

        return F.when(F.size(F.array_distinct(hashes)) == F.size(hashes), F.lit(0)).otherwise(let(let(keyed, places), covered))

    return F.when(F.size(words) < width, F.lit(0)).otherwise(let(windows(words), repeated)).cast("long")


def base_statistics(text: Column) -> Column:
    """struct(n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words)."""
    text = F.coalesce(text, F.lit(""))
    lines = F.filter(F.split(text, "\n", -1), lambda x: x.rlike(WORD))
    duplicates = let(lines, lambda x: F.size(x) - F.size(F.array_distinct(x)))
    of_words = lambda w: F.struct(
        F.size(w).cast("long").alias("n_words"), F.aggregate(w, F.lit(0), lambda s, x: s + F.length(x)).cast("long").alias("word_chars"),
        F.regexp_count(text, F.lit(BASE_SYMBOLS)).cast("long").alias("n_symbols"), duplicates.cast("long").alias("n_dup_lines"),
        repeated_window_words(w).alias("n_repeat_words"))
    return let(words_of(text), of_words)


def line_rule(line: Column) -> Column:
    """The first rule that a line fails, numbered from 1 as in RULES; 0 for a line that stays or is blank."""
    chars = F.length(F.replace(line, F.lit(" "), F.lit("")))
    words = F.regexp_count(line, F.lit(WORD))
    punctuation = F.regexp_count(line, F.lit(PUNCTUATION)) * 100 > chars * MAX_PUNCTUATION
    navigation = (F.regexp_count(line, F.lit(SEPARATORS)) * 100 >= words * MIN_SEPARATORS) | ((words < MENU_WORDS) & ~line.rlike(CLOSING))
    phrase = let(F.lower(line), lambda t: functools.reduce(operator.or_, [t.contains(p) for p in PHRASES]))
    return F.when(~line.rlike(WORD), 0).when(punctuation, 1).when(navigation, 2).when((words <= PHRASE_WORDS) & phrase, 3).otherwise(0)


def cleaned(text: Column) -> Column:
    """struct(text, n_lines, n_removed_lines, chars, removed_chars): the text without its failing lines."""
    def judged(rows: Column) -> Column:
        chars = lambda which: F.aggregate(which, F.lit(0), lambda s, r: s + r["chars"]).cast("long")
        failing = F.filter(rows, lambda r: r["rule"] > 0)
        return F.struct(F.array_join(F.transform(F.filter(rows, lambda r: r["rule"] == 0), lambda r: r["line"]), "\n").alias("text"),
                        F.size(rows).cast("long").alias("n_lines"), F.size(failing).cast("long").alias("n_removed_lines"),
                        chars(rows).alias("chars"), chars(failing).alias("removed_chars"))

    lines = F.split(F.coalesce(text, F.lit("")), "\n", -1)
    return let(F.transform(lines, lambda x: F.struct(x.alias("line"), line_rule(x).alias("rule"), F.length(F.replace(x, F.lit(" "), F.lit(""))).alias("chars"))), judged)


def judge(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """``docs`` with ``base`` statistics, the ``clean`` struct, ``base_failed`` and ``kept``."""
    rows = docs.withColumn("base", base_statistics(F.col(text_col))).withColumn("clean", cleaned(F.col(text_col)))
    failed = (F.col("base.n_words") < 50) | (100 * F.col("base.n_repeat_words") > 50 * F.col("base.n_words"))
    lost = 100 * F.col("clean.removed_chars") > MAX_LOST * F.col("clean.chars")
    return rows.withColumn("base_failed", failed).withColumn("kept", ~failed & ~lost)


def op4_line_first(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = judge(documents(spark, sf_dir).select("doc_id", "text"))
    return rows.select("doc_id", "base.n_words", "base.word_chars", "base.n_symbols", "base.n_dup_lines", "base.n_repeat_words", "base_failed", "kept",
                       "clean.n_lines", "clean.n_removed_lines", "clean.removed_chars")


_PHRASE_SQL = " OR ".join(f"contains(lower(line), '{p}')" for p in PHRASES)
ORACLE = rf"""
WITH d AS (
  SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS text FROM documents
), w AS (
  SELECT r, regexp_extract_all(text, '[^\x20\x09-\x0D]+') AS w FROM d
), win AS (
  SELECT r, unnest(range(1, len(w) - 1)) AS i, w FROM w WHERE len(w) >= 3
), keyed AS (
  SELECT r, i, w[i] || ' ' || w[i + 1] || ' ' || w[i + 2] AS k FROM win
), many AS (
  SELECT r, i FROM (SELECT r, i, count(*) OVER (PARTITION BY r, k) AS n FROM keyed) WHERE n > 1
), covered AS (
  SELECT r, count(DISTINCT i + o) AS n FROM many, (SELECT unnest([0, 1, 2]) AS o) GROUP BY r
), lines AS (
  SELECT r, unnest(string_split(text, chr(10))) AS line FROM d
), judged AS (
  SELECT r, line, length(replace(line, ' ', '')) AS chars, len(regexp_extract_all(line, '[^\x20\x09-\x0D]+')) AS words,
    regexp_matches(line, '[^\x20\x09-\x0D]') AS has_word FROM lines
), ruled AS (
  SELECT r, line, chars, has_word, CASE WHEN NOT has_word THEN 0
    WHEN len(regexp_extract_all(line, '[!-/:-@\[-`{{-~]')) * 100 > chars * {MAX_PUNCTUATION} THEN 1
    WHEN len(regexp_extract_all(line, '[|»›•·]')) * 100 >= words * {MIN_SEPARATORS}
      OR (words < {MENU_WORDS} AND NOT regexp_matches(line, '[.!?:;…。！？][\x22\x27»”’)\]]*$')) THEN 2
    WHEN words <= {PHRASE_WORDS} AND ({_PHRASE_SQL}) THEN 3 ELSE 0 END AS rule FROM judged
), per AS (
  SELECT r, count(*) AS n_lines, count(*) FILTER (rule > 0) AS n_removed_lines, sum(chars) AS chars,
    coalesce(sum(chars) FILTER (rule > 0), 0) AS removed_chars,
    count(*) FILTER (has_word) - count(DISTINCT CASE WHEN has_word THEN line END) AS n_dup_lines FROM ruled GROUP BY r
), s AS (
  SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(list_sum(list_transform(w, lambda x: length(x))), 0) AS BIGINT) AS word_chars,
    CAST(len(regexp_extract_all(text, '[#*$%&|<>]')) AS BIGINT) AS n_symbols, n_dup_lines, coalesce(covered.n, 0) AS n_repeat_words,
    n_lines, n_removed_lines, CAST(chars AS BIGINT) AS chars, CAST(removed_chars AS BIGINT) AS removed_chars
  FROM d JOIN w USING (r) JOIN per USING (r) LEFT JOIN covered USING (r)
)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words,
  n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed,
  NOT (n_words < 50 OR 100 * n_repeat_words > 50 * n_words) AND 100 * removed_chars <= {MAX_LOST} * chars AS kept,
  n_lines, n_removed_lines, removed_chars FROM s
"""
