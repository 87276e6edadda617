"""Requests in pages: whole groups of candidates, first-fit in order, within the limits of a page."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from drawlake.operators.prefix import rank_all, running_total

# Records and candidates of a page, and pages of a case.
PAGE_RECORDS, PAGE_CANDIDATES, MAX_PAGES = 16, 32, 4
#: Groups that are packed together.
BLOCK = 256


def _first_fit(groups: Column, records: int, candidates: int) -> Column:
    """The page of every group of an ordered array ``(place, size)``: the first that still has room."""
    page = lambda r, c: F.struct(r.cast("long").alias("r"), c.cast("long").alias("c"))
    start = F.struct(F.array().cast("array<struct<r:bigint,c:bigint>>").alias("pages"), F.array().cast("array<bigint>").alias("chosen"))

    def put(state: Column, group: Column) -> Column:
        room = F.transform(state["pages"], lambda p: (p["r"] < records) & (p["c"] + group["size"] <= candidates))
        at = F.coalesce(F.nullif(F.array_position(room, F.lit(True)), F.lit(0)), F.size(state["pages"]).cast("long") + 1)
        filled = F.transform(state["pages"], lambda p, i: F.when(i + 1 == at, page(p["r"] + 1, p["c"] + group["size"])).otherwise(p))
        pages = F.when(at > F.size(state["pages"]), F.concat(state["pages"], F.array(page(F.lit(1), group["size"])))).otherwise(filled)
        return F.struct(pages.alias("pages"), F.array_append(state["chosen"], at).alias("chosen"))

    return F.aggregate(groups, start, put, lambda s: s["chosen"])


def request_pages(groups: DataFrame, order: list[Column], records: int = PAGE_RECORDS, candidates: int = PAGE_CANDIDATES, pages: int = MAX_PAGES,
                  block: int = BLOCK) -> DataFrame:
    """``(case_id, record_id, size, page, reason)`` of groups ``(case_id, record_id, supported, size)``.

    In the given order, with ``record_id`` last, each group goes to the first page that has room for another record and all
    its candidates.  Groups are packed in blocks of ``block`` consecutive ones, whose pages follow those of earlier blocks, so a case
    of any size is dealt over many tasks; a case of one block is packed first-fit as a whole.  Page numbers start
    at 1 and depend on the rows alone.  Groups without a page say why: not supported, without candidates, larger
    than a page, or beyond the last page.
    """
    reason = (F.when(~F.coalesce("supported", F.lit(False)), "unsupported_or_unresolved_source_dimension").when(F.col("size") == 0, "no_source_candidate")
              .when(F.col("size") > candidates, "complete_candidate_group_exceeds_page_limit"))
    rows = groups.withColumn("reason", reason)
    ranked = rank_all(rows.where("reason is null"), ["case_id"], [*order, F.col("record_id").asc()], "_place")
    dealt = ranked.withColumn("_block", F.floor((F.col("_place") - 1) / block))
    listed = dealt.groupBy("case_id", "_block").agg(F.array_sort(F.collect_list(F.struct(F.col("_place").alias("place"), F.col("size").cast("long").alias("size"), "record_id"))).alias("_groups"))
    listed = listed.withColumn("_chosen", _first_fit(F.col("_groups"), records, candidates)).withColumn("_count", F.array_max("_chosen"))
    before = running_total(listed.select("case_id", "_block", "_count"), ["case_id"], [F.col("_block").asc()], F.col("_count")).select("case_id", "_block", F.col("_before").alias("_skip"))
    each = listed.join(before, ["case_id", "_block"]).select("case_id", "_skip", F.explode(F.arrays_zip("_groups", "_chosen")).alias("g"))
    placed = each.select("case_id", F.col("g._groups.record_id").alias("record_id"), F.col("g._groups.size").alias("size"), (F.col("_skip") + F.col("g._chosen")).cast("long").alias("page"))
    over = F.col("page") > pages
    placed = placed.select("case_id", "record_id", "size", F.when(~over, F.col("page")).alias("page"), F.when(over, "page_count_limit").alias("reason"))
    rest = rows.where("reason is not null").select("case_id", "record_id", F.col("size").cast("long").alias("size"), F.lit(None).cast("long").alias("page"), "reason")
    return placed.unionByName(rest)
