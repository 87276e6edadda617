"""Line de-duplication over the corpus by a deletion-neighbourhood join, in built-in functions only.

A line is removed if an equal line, or one within one edit (a character inserted, deleted or replaced),
stands earlier, by document id and then place.  Equal lines meet by hash.  For near lines every line
emits its variants with at most one deletion as hashed keys; equal keys of the same deletion place, or of
a line and a line that is one longer, prove one edit, which is then verified on the texts.

Emitting every variant of every line is not needed: one edit leaves either half of a line unchanged, and
seven of its eight parts.  So only lines that share a half with another line are fetched, and only the
part in which two lines can differ gets its deletions.  No case is lost by that.  Lines shorter than
``MIN_NEAR`` characters, and those of just that length that may be one longer, are not narrowed: their text
is kept beside their hash and all of it gets its deletions.  Groups are never listed: a key keeps the earliest line on either side, by an aggregate that combines before the shuffle.

Defined results: null text stays null; blank lines are never removed; a null id comes last in the order; rows that share id and text
share their result; an empty table gives no rows; all columns pass through.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from drawlake.llm.common import WORD, documents, let, runtime_filters, staged

#: Least length of a line whose edit is narrowed to halves and parts, and the number of parts.
MIN_NEAR, PARTS = 20, 8
_LAST = 2**63 - 1


def _half_keys(line: Column) -> Column:
    """Hashes of the halves: of half the length, and of half the length of a line that is one shorter."""
    n = F.length(line)
    key = lambda side, k, part: F.xxhash64(F.lit(side), k, part)
    both = lambda k: F.array(key("head", k, F.substring(line, F.lit(1), k)), key("tail", k, F.substring(line, n - k + 1, k)))
    a, b = F.floor(n / 2).cast("int"), F.floor((n - 1) / 2).cast("int")
    return F.when(n < MIN_NEAR, F.array().cast("array<bigint>")).when(a == b, both(a)).otherwise(F.concat(both(a), both(b)))


def lines_of(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """``(place, h, n, halves, short)`` of every line with a word, written once; ``place`` orders the lines of the corpus."""
    rows = docs.where(F.col(text_col).isNotNull()).select(F.col(id_col).cast("long").alias("doc_id"), F.xxhash64(F.col(text_col)).alias("row"),
                                                          F.posexplode(F.split(F.col(text_col), "\n", -1)).alias("pos", "line"))
    rows = rows.where(F.col("line").rlike(WORD))
    place = F.struct(F.coalesce("doc_id", F.lit(_LAST)).alias("doc_id"), "row", "pos")
    short = F.when(F.length("line") <= MIN_NEAR, F.col("line"))
    return staged(rows.select(place.alias("place"), F.xxhash64("line").alias("h"), F.length("line").alias("n"), _half_keys(F.col("line")).alias("halves"), short.alias("short")), "lines")


def _shared(rows: DataFrame, key: str) -> DataFrame:
    """The keys under which at least two different lines stand."""
    return rows.groupBy(key).agg(F.min("h").alias("low"), F.max("h").alias("high")).where("low <> high").select(key)


def _fetch(docs: DataFrame, wanted: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """``(h, n, place, line)`` of the wanted first places."""
    by_doc = wanted.groupBy("first.doc_id", "first.row").agg(F.collect_list(F.struct(F.col("first.pos").alias("pos"), "h", "n")).alias("own"), F.count("*").alias("many"))
    by_doc = staged(by_doc, "wanted").where("many > 0")
    rows = docs.select(F.coalesce(F.col(id_col).cast("long"), F.lit(_LAST)).alias("doc_id"), F.xxhash64(F.col(text_col)).alias("row"), F.col(text_col).alias("text"))
    found = by_doc.join(rows, ["doc_id", "row"]).dropDuplicates(["doc_id", "row"])
    each = found.select("doc_id", "row", F.explode(let(F.split("text", "\n", -1), lambda lines: F.transform(F.col("own"), lambda o: F.struct(
        o["pos"].alias("pos"), o["h"].alias("h"), o["n"].alias("n"), F.element_at(lines, o["pos"] + 1).alias("line"))))).alias("o"))
    return each.select("o.h", "o.n", F.struct("doc_id", "row", "o.pos").alias("place"), "o.line")


def _part_keys(near: DataFrame) -> DataFrame:
    """Every line with one part left out, for its own length and for the length of a line that is one shorter."""
    cell = F.explode(F.array(*[F.struct(F.lit(j).alias("j"), F.lit(d).alias("d")) for j in range(PARTS) for d in (0, 1)])).alias("cell")
    rows = near.select("h", "n", "place", "line", cell).select("h", "n", "place", "line", "cell.j", "cell.d").withColumn("base", F.col("n") - F.col("d"))
    low, high = F.floor(F.col("j") * F.col("base") / PARTS).cast("int"), F.floor((F.col("j") + 1) * F.col("base") / PARTS).cast("int")
    rows = rows.withColumn("low", low).withColumn("tail", F.col("base") - high)
    key = F.xxhash64("base", "j", F.substring("line", F.lit(1), F.col("low")), F.lit("|"), F.substring(F.col("line"), F.col("n") - F.col("tail") + 1, F.col("tail")))
    return rows.select("h", "place", "d", "low", key.alias("key"), F.substring(F.col("line"), F.col("low") + 1, F.col("n") - F.col("low") - F.col("tail")).alias("part"))


def _whole_keys(short: DataFrame) -> DataFrame:
    """Every short line as one part, for its own length and for the length of a line that is one shorter."""
    rows = short.select("h", "n", "place", "line", F.explode(F.array(F.lit(0), F.lit(1))).alias("d"))
    return rows.select("h", "place", "d", F.lit(0).alias("low"), F.xxhash64(F.col("n") - F.col("d"), F.lit("whole")).alias("key"), F.col("line").alias("part"))


def _variants(rows: DataFrame) -> DataFrame:
    """``(variant, side, h, place)``: the deletion neighbourhood of the part in which lines under one key differ.

    Side x: a line itself, and each of its deletions with their place.  Side y: the deletions of a line
    that is one longer, which are looked for among the lines themselves.
    """
    part = F.col("part")
    without = lambda i: F.concat(F.substring(part, F.lit(1), i - 1), F.substring(part, i + 1, F.length(part)))
    places = F.when(F.length(part) > 0, F.sequence(F.lit(1), F.length(part))).otherwise(F.array().cast("array<int>"))
    entry = lambda pair, place, text: F.struct(F.lit(pair).alias("pair"), F.xxhash64("key", F.lit(pair), place, text).alias("variant"))
    own = F.concat(F.array(entry("shift", F.lit(0), part)), F.transform(places, lambda i: entry("swap", i, without(i))))
    longer = F.array_distinct(F.transform(places, lambda i: entry("shift", F.lit(0), without(i))))
    rows = rows.select("h", "place", "d", F.explode(F.when(F.col("d") == 0, own).otherwise(longer)).alias("v"))
    return rows.select("v.variant", "v.pair", (F.col("d") == 0).alias("own"), "h", "place")


def near_removed(docs: DataFrame, lines: DataFrame, firsts: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """``(h, n)`` of the lines that have an earlier line within one edit."""
    halves = lines.select("h", "n", F.explode("halves").alias("key"))
    wanted = halves.join(_shared(halves, "key"), "key", "left_semi").select("h", "n").distinct().join(firsts.select("h", "n", "first"), ["h", "n"])
    with runtime_filters(docs.sparkSession):
        near = staged(_fetch(docs, wanted, id_col, text_col), "near-lines")
    parts = _part_keys(near)
    parts = parts.join(_shared(parts.select("h", "key"), "key"), "key", "left_semi")
    short = staged(lines.where("short is not null").groupBy("h", "n", F.col("short").alias("line")).agg(F.min("place").alias("place")), "short-lines")
    near = near.where(F.col("n") > MIN_NEAR).unionByName(short)
    variants = staged(_variants(parts).unionByName(_variants(_whole_keys(short))), "variants")
    earliest = variants.groupBy("variant").agg(F.min(F.when(F.col("own"), F.struct("place", "h"))).alias("x"), F.min(F.when(~F.col("own"), F.struct("place", "h"))).alias("y"),
                                               F.count("*").alias("many")).where("many > 1").drop("many")
    keeper = F.when(F.col("own") & (F.col("pair") == "shift"), F.col("y")).otherwise(F.col("x"))
    found = variants.join(earliest, "variant").withColumn("keeper", keeper).where(F.col("keeper.place") < F.col("place"))
    pairs = found.select("h", F.col("keeper.h").alias("kept_h")).distinct()
    texts = near.select(F.col("h").alias("kept_h"), F.col("line").alias("kept_line"))
    checked = pairs.join(near, "h").join(texts, "kept_h").where(F.levenshtein("line", "kept_line", 1).between(0, 1))
    return checked.select("h", "n").distinct()


def removals(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(doc_id, row, removed, n_exact, n_near)`` of the documents that lose lines; ``removed`` are line numbers from 0."""
    lines = lines_of(docs, id_col, text_col)
    firsts = staged(lines.groupBy("h", "n").agg(F.min("place").alias("first"), F.count("*").alias("many")), "first-lines")
    near = staged(near_removed(docs, lines, firsts, id_col, text_col), "near-removed").withColumn("near", F.lit(True))
    acts = firsts.join(near, ["h", "n"], "left").withColumn("near", F.coalesce("near", F.lit(False))).where("near or many > 1")
    gone = lines.select("h", "n", "place").join(acts, ["h", "n"]).where("near or place > first")
    return gone.groupBy("place.doc_id", "place.row").agg(F.collect_set("place.pos").alias("removed"), F.count_if(~F.col("near")).alias("n_exact"), F.count_if("near").alias("n_near"))


def dedup_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` with the text cleaned, and the struct ``line_dedup`` (n_lines, n_exact, n_near)."""
    gone = removals(docs, id_col, text_col).withColumnsRenamed({"doc_id": "__ld_doc", "row": "__ld_row", "removed": "__ld_removed", "n_exact": "__ld_exact", "n_near": "__ld_near"})
    joined = docs.join(gone, (F.coalesce(F.col(id_col).cast("long"), F.lit(_LAST)) == F.col("__ld_doc")) & (F.xxhash64(F.col(text_col)) == F.col("__ld_row")), "left")
    left = lambda lines: F.transform(F.array_except(F.sequence(F.lit(0), F.size(lines) - 1), F.col("__ld_removed")), lambda i: F.element_at(lines, i + 1))
    text = F.when(F.col("__ld_removed").isNull(), F.col(text_col)).otherwise(F.array_join(let(F.split(F.col(text_col), "\n", -1), left), "\n"))
    counts = F.struct(F.coalesce(F.regexp_count(F.col(text_col), F.lit("\n")) + 1, F.lit(0)).cast("long").alias("n_lines"),
                      *[F.coalesce(f"__ld_{c}", F.lit(0)).cast("long").alias(f"n_{c}") for c in ("exact", "near")])
    names = [c for c in docs.columns if c != "line_dedup"]
    return joined.withColumn("line_dedup", counts).withColumn(text_col, text).select(*names, "line_dedup")


def op8_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = dedup_lines(documents(spark, sf_dir).select("doc_id", "text"))
    return rows.select("doc_id", "line_dedup.n_lines", "line_dedup.n_exact", "line_dedup.n_near", F.length("text").cast("long").alias("chars"), F.md5("text").alias("text_md5"))


def stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pipeline stage: repeated lines go, and with them the documents that keep no word."""
    return dedup_lines(docs).where(F.col("text").rlike(WORD)).select(*docs.columns)


ORACLE = rf"""
WITH d AS (
  SELECT doc_id, text, string_split(text, chr(10)) AS ls FROM documents WHERE text IS NOT NULL
), l AS (
  SELECT doc_id, pos, line, length(line) AS n FROM (SELECT doc_id, unnest(range(len(ls))) AS pos, unnest(ls) AS line FROM d)
  WHERE regexp_matches(line, '[^\x20\x09-\x0D]')
), f AS (
  SELECT line, n, min((doc_id, pos)) AS first FROM l GROUP BY line, n
), k AS (
  SELECT line, n, first, h, unnest(['head', 'tail']) AS side, unnest([left(line, h), right(line, h)]) AS part
  FROM (SELECT *, unnest(list_distinct([n // 2, (n - 1) // 2])) AS h FROM f)
), pair AS (
  SELECT DISTINCT b.line, a.line AS earlier, greatest(a.n, b.n) AS longer FROM k a JOIN k b ON a.h = b.h AND a.side = b.side AND a.part = b.part
  WHERE a.line <> b.line AND abs(a.n - b.n) <= 1 AND a.first < b.first
), same AS (
  SELECT line, longer, list_transform(list_zip(x, y), lambda p: coalesce(p[1] = p[2], false)) AS head,
    list_transform(list_zip(list_reverse(x), list_reverse(y)), lambda p: coalesce(p[1] = p[2], false)) AS tail
  FROM (SELECT line, longer, string_split(line, '') AS x, string_split(earlier, '') AS y FROM pair)
), near AS (
  SELECT DISTINCT line FROM same WHERE list_position(head, false) - 1 + list_position(tail, false) - 1 >= longer - 1
), gone AS (
  SELECT l.doc_id, l.pos, near.line IS NOT NULL AS is_near
  FROM l JOIN f USING (line) LEFT JOIN near USING (line) WHERE near.line IS NOT NULL OR (l.doc_id, l.pos) > f.first
), per AS (
  SELECT doc_id, list(pos) AS removed, count(*) FILTER (NOT is_near) AS n_exact, count(*) FILTER (is_near) AS n_near FROM gone GROUP BY doc_id
), o AS (
  SELECT doc_id, CAST(len(ls) AS BIGINT) AS n_lines, coalesce(n_exact, 0) AS n_exact, coalesce(n_near, 0) AS n_near,
    array_to_string(list_transform(list_filter(range(len(ls)), lambda i: NOT coalesce(list_contains(removed, i), false)), lambda i: ls[i + 1]), chr(10)) AS t
  FROM d LEFT JOIN per USING (doc_id)
)
SELECT doc_id, n_lines, n_exact, n_near, length(t) AS chars, md5(t) AS text_md5 FROM o
"""
