r"""Secret scan with corpus-wide ownership frequency, in built-in functions only.

Base patterns find assignments, access keys and long hexadecimal runs.  A wider pattern proposes
further candidates: long runs that mix letters and digits.  Every candidate's hash is counted by
distinct repositories and owners over the whole corpus.  A value that several owners or many repositories
hold is a widely copied example; any other that looks random is live.  Live candidates of the wider
pattern become spans of kind ``owned``; base spans always stay.  A repository is an id under its owner.

The scan of the texts is written once (ids, spans and hashes, never texts); counting and verdicts work
on that.  The counts by hash combine before the shuffle, and the join back is one that Spark splits.

Defined results: null text counts as empty; a null owner is an owner of its own; repeated rows get a
row each; an empty table gives no rows; columns other than those named are ignored.
"""

from __future__ import annotations

import functools
import operator

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from drawlake.llm.common import documents, let, staged

# The patterns of the base scan and the least length of what they must hold.
ASSIGN = r"""(?i)(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS, HEX, WIDE = r"AKIA[A-Z0-9]+", r"[0-9a-f]{32,}", r"[A-Za-z0-9+/_-]{20,}"
KEYWORDS = ("password", "passwd", "secret", "token", "apikey", "api_key")
ASSIGN_LEAST, ACCESS_LEAST = 8, 16
KINDS = ("assign", "access", "hex", "owned")
#: Owners, and repositories of whatever owners, from which a value is an example; digits, letters and different characters of a random-looking value.
EXAMPLE_OWNERS, EXAMPLE_REPOS, LIVE_DIGITS, LIVE_LETTERS, LIVE_DISTINCT = 3, 10, 4, 4, 10

_SPAN = "array<struct<start:int,kind:int,end:int,value:string>>"


def located(text: Column, pattern: str, kind: str, group: int = 0) -> Column:
    """All leftmost matches with their places in code points; ``value`` is the group.

    The texts between matches come from a split by the same pattern, so places are running lengths.
    """
    found = F.arrays_zip(F.split(text, pattern, -1).alias("gap"), F.regexp_extract_all(text, F.lit(pattern), F.lit(0)).alias("all"),
                         F.regexp_extract_all(text, F.lit(pattern), F.lit(group)).alias("value"))
    start = F.struct(F.lit(0).alias("at"), F.array().cast(_SPAN).alias("spans"))

    def step(acc: Column, m: Column) -> Column:
        first = acc["at"] + F.length(m["gap"])
        last = first + F.length(m["all"])
        span = F.struct(first.alias("start"), F.lit(KINDS.index(kind)).alias("kind"), last.alias("end"), m["value"].alias("value"))
        return F.struct(last.alias("at"), F.array_append(acc["spans"], span).alias("spans"))

    whole = F.filter(found, lambda m: m["all"].isNotNull())
    return F.aggregate(whole, start, step, lambda acc: acc["spans"])


def random_looking(value: Column) -> Column:
    digits = F.length(F.regexp_replace(value, "[^0-9]", ""))
    letters = F.length(F.regexp_replace(value, "[^A-Za-z]", ""))
    return (digits >= LIVE_DIGITS) & (letters >= LIVE_LETTERS) & (F.size(F.array_distinct(F.split(value, ""))) >= LIVE_DISTINCT)


def base_spans(text: Column) -> Column:
    """The spans of the three base kinds."""
    none = F.array().cast(_SPAN)
    keyed = let(F.lower(text), lambda t: functools.reduce(operator.or_, [t.contains(word) for word in KEYWORDS]))
    assign = F.filter(located(text, ASSIGN, "assign", 2), lambda s: F.length(s["value"]) >= ASSIGN_LEAST)
    access = F.filter(located(text, ACCESS, "access"), lambda s: F.length(s["value"]) >= ACCESS_LEAST)
    return F.concat(F.when(keyed, assign).otherwise(none), F.when(text.contains("AKIA"), access).otherwise(none),
                    F.when(text.rlike(HEX), located(text, HEX, "hex")).otherwise(none))


def wide_spans(text: Column, base: Column) -> Column:
    """Random-looking runs that touch no base span."""
    free = lambda s: ~F.exists(base, lambda b: (b["start"] < s["end"]) & (s["start"] < b["end"]))
    return F.when(text.rlike(r"[A-Za-z0-9+/_-]{20}") & text.rlike("[0-9]"), F.filter(located(text, WIDE, "owned"), lambda s: random_looking(s["value"]) & free(s))
                  ).otherwise(F.array().cast(_SPAN))


def joined(spans: Column) -> Column:
    """``kind:start:end`` by start and kind, comma-joined."""
    name = lambda s: F.element_at(F.array(*[F.lit(k) for k in KINDS]), s["kind"] + 1)
    return F.array_join(F.transform(F.sort_array(spans), lambda s: F.concat_ws(":", name(s), s["start"].cast("string"), s["end"].cast("string"))), ",")


def hashed(spans: Column) -> Column:
    """The spans with a hash in place of the value."""
    return F.transform(spans, lambda s: F.struct(s["start"].alias("start"), s["kind"].alias("kind"), s["end"].alias("end"),
                                                 F.sha2(s["value"], 256).alias("hash"), random_looking(s["value"]).alias("random")))


def scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", owner_col: str = "source", repo_col: str = "doc_id") -> DataFrame:
    """``(doc_id, row, owner, repo, base, wide)``: the candidates of every row, written once."""
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(owner_col).alias("owner"), F.col(repo_col).alias("repo"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    rows = rows.withColumn("row", F.xxhash64("text")).withColumn("base", base_spans(F.col("text")))
    rows = rows.withColumn("wide", wide_spans(F.col("text"), F.col("base")))
    return staged(rows.select("doc_id", "row", "owner", "repo", hashed(F.col("base")).alias("base"), hashed(F.col("wide")).alias("wide")), "secrets")


def ownership(rows: DataFrame) -> DataFrame:
    """``(hash, n_owners, n_repos)`` of every candidate value, by distinct repository and owner."""
    values = rows.select("owner", "repo", F.explode(F.array_distinct(F.transform(F.concat("base", "wide"), lambda s: s["hash"]))).alias("hash"))
    by_repo = values.groupBy("hash", "owner", "repo").agg(F.count("*").alias("rows"))
    by_owner = by_repo.groupBy("hash", "owner").agg(F.count("*").alias("repos"))
    return by_owner.groupBy("hash").agg(F.count("*").alias("n_owners"), F.sum("repos").alias("n_repos"))


def find(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", owner_col: str = "source", repo_col: str = "doc_id") -> DataFrame:
    """``(doc_id, base, spans)`` for every row of ``docs``.

    ``base`` holds the base spans with their hashes; ``spans`` holds these and the owned ones, each with
    its verdicts and the owners and repositories that hold its value.
    """
    rows = scan(docs, id_col, text_col, owner_col, repo_col)
    spans = rows.select("doc_id", "row", F.explode(F.concat("base", "wide")).alias("span")).withColumn("hash", F.col("span.hash"))
    judged = spans.join(ownership(rows), "hash")
    example = (F.col("n_owners") >= EXAMPLE_OWNERS) | (F.col("n_repos") >= EXAMPLE_REPOS)
    live = ~example & F.col("span.random")
    verdicts = judged.groupBy("doc_id", "row").agg(
        F.collect_set(F.when((F.col("span.kind") < 3) | live, F.struct("span.start", "span.kind", "span.end", example.alias("example"), live.alias("live"), "n_owners", "n_repos"))).alias("spans"))
    verdicts = verdicts.withColumnsRenamed({"doc_id": "d", "row": "r"})
    whole = rows.join(verdicts, F.col("doc_id").eqNullSafe(F.col("d")) & (F.col("row") == F.col("r")), "left")
    none = F.array().cast("array<struct<start:int,kind:int,end:int,example:boolean,live:boolean,n_owners:bigint,n_repos:bigint>>")
    return whole.select("doc_id", "base", F.coalesce("spans", none).alias("spans"))


def op1_secret_ownership(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Owners are the sources, repositories the documents."""
    found = find(documents(spark, sf_dir))
    count = lambda kind: F.size(F.filter("base", lambda s: s["kind"] == KINDS.index(kind))).cast("long").alias(f"n_{kind}")
    flagged = lambda name: F.size(F.filter("spans", lambda s: s[name])).cast("long").alias(f"n_{name}")
    return found.select("doc_id", count("assign"), count("access"), count("hex"), F.sha2(joined(F.col("base")), 256).alias("base_sha256"),
                        joined(F.col("spans")).alias("spans"), flagged("example"), flagged("live"))


def _places(pattern: str, kind: int, group: int, least: int) -> str:
    return rf"""
  SELECT r, {kind} AS kind, pos AS st, pos + length(whole) AS en, value FROM (
    SELECT r, found[i] AS whole, vals[i] AS value,
      CAST(list_sum(list_transform(gaps[1:i], lambda x: length(x))) + coalesce(list_sum(list_transform(found[1:i - 1], lambda x: length(x))), 0) AS INTEGER) AS pos
    FROM (SELECT r, gaps, found, vals, unnest(range(1, len(found) + 1)) AS i FROM (
      SELECT r, string_split_regex(text, '{pattern}') AS gaps, regexp_extract_all(text, '{pattern}') AS found, regexp_extract_all(text, '{pattern}', {group}) AS vals FROM d)))
  WHERE length(value) >= {least}"""


_ASSIGN_SQL = r"(?i)(password|passwd|secret|token|api_?key)[\x22\x27]?\x20*[:=]\x20*[\x22\x27]?([A-Za-z0-9+/_.=-]+)"
ORACLE = rf"""
WITH d AS (
  SELECT row_number() OVER () AS r, doc_id, source, coalesce(text, '') AS text FROM documents
), base AS ({_places(_ASSIGN_SQL, 0, 2, 8)} UNION ALL {_places(ACCESS, 1, 0, 16)} UNION ALL {_places(HEX, 2, 0, 32)}
), wide AS (
  SELECT * FROM ({_places(WIDE, 3, 0, 20)}) w WHERE NOT EXISTS (SELECT 1 FROM base b WHERE b.r = w.r AND b.st < w.en AND w.st < b.en)
), cand AS (
  SELECT *, length(regexp_replace(value, '[^0-9]', '', 'g')) >= 4 AND length(regexp_replace(value, '[^A-Za-z]', '', 'g')) >= 4
    AND len(list_distinct(string_split(value, ''))) >= 10 AS random FROM (SELECT * FROM base UNION ALL SELECT * FROM wide)
), own AS (
  SELECT value, count(DISTINCT coalesce(source, chr(0))) AS n_owners, count(DISTINCT (coalesce(source, chr(0)), doc_id)) AS n_repos FROM cand JOIN d USING (r) WHERE kind < 3 OR random GROUP BY value
), judged AS (
  SELECT r, kind, st, en, n_owners >= {EXAMPLE_OWNERS} OR n_repos >= {EXAMPLE_REPOS} AS example,
    n_owners < {EXAMPLE_OWNERS} AND n_repos < {EXAMPLE_REPOS} AND random AS live
  FROM cand JOIN own USING (value) WHERE kind < 3 OR random
), named AS (
  SELECT *, ['assign', 'access', 'hex', 'owned'][kind + 1] || ':' || st || ':' || en AS s FROM judged WHERE kind < 3 OR live
)
SELECT doc_id, count(*) FILTER (kind = 0) AS n_assign, count(*) FILTER (kind = 1) AS n_access, count(*) FILTER (kind = 2) AS n_hex,
  sha256(coalesce(string_agg(s, ',' ORDER BY st, kind) FILTER (kind < 3), '')) AS base_sha256,
  coalesce(string_agg(s, ',' ORDER BY st, kind), '') AS spans, count(*) FILTER (example) AS n_example, count(*) FILTER (live) AS n_live
FROM d LEFT JOIN named USING (r) GROUP BY r, doc_id
"""
