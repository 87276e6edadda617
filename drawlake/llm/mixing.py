"""Mixing sources to target weights by entropy balancing.

Of all document rates whose taken words meet every source's target, the one of largest entropy has
the form ``rate = min(3, exp(lambda * size / mean))`` with one multiplier per source, the solution of
a convex dual.  Newton's method, held inside a bracket, finds the multipliers of all sources at once:
each round is one aggregation per source over the histogram of ``(source, size)``, since documents of
equal size in a source share a rate.  Rates become copies by systematic rounding in the order of size,
so a source misses its target by about one document; one document of each source is then moved by a
copy to close that gap.  Sums are decimal, hence equal in every run.

Defined results: null or word-less text has size 0 and takes nothing; a null source is one source,
ordered last; a source without words has target 0; repeated rows are documents of their own; an
empty table gives no rows; very long texts are counted whole.  Other columns are ignored.
The water level of the targets is found over one row per source in one task, which is sound up to millions of
sources.
"""

from __future__ import annotations

from itertools import count

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from drawlake.llm.common import WORD, documents, staged

#: Weights by the rank of the source, repeating; the most of its source that a target may ask for.
WEIGHTS, CAP = (1, 2, 3), 3
#: Slices of a source in joins by source.
SLICES = 16
#: Relative miss of a target at which the Newton rounds end, and rows to a rounding bucket.
TOLERANCE, BUCKET_ROWS = 1e-7, 1000
_MONEY = "decimal(38,9)"


def sizes(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """``(doc_id, row, source, size)``: a hash of the text, and the number of words."""
    size = F.coalesce(F.regexp_count(F.col(text_col), F.lit(WORD)), F.lit(0)).cast("long")
    return docs.select(F.col(id_col).alias("doc_id"), F.xxhash64(F.col(text_col)).alias("row"), F.col(source_col).alias("source"), size.alias("size"))


def targets(per_source: DataFrame, weights: tuple = WEIGHTS, cap: int = CAP) -> DataFrame:
    """Adds ``target`` to ``(source, source_size)``: shares by weight, capped, the excess shared again.

    Sources fill up in the order of ``cap * size / weight``; the water level is where the words left,
    divided by the weights left, no longer lift the next source to its cap.  The rows are one per
    source, already summed.
    """
    by_name = Window.orderBy(F.col("source").asc_nulls_last())
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (F.pmod(F.row_number().over(by_name) - 1, F.lit(len(weights))) + 1).cast("int"))
    rows = per_source.withColumn("weight", weight).withColumn("full", F.lit(float(cap)) * F.col("source_size"))
    fill = Window.orderBy(F.col("full") / F.col("weight"), F.col("source").asc_nulls_last())
    before = fill.rowsBetween(Window.unboundedPreceding, -1)
    rest = fill.rowsBetween(0, Window.unboundedFollowing)
    total = F.sum("source_size").over(Window.orderBy(F.lit(0)).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))
    level = (total - F.coalesce(F.sum("full").over(before), F.lit(0.0))) / F.sum("weight").over(rest)
    rows = rows.withColumn("level", level)
    # The first source whose cap lies above its level fixes the level for all that follow.
    stop = F.min(F.when(F.col("full") > F.col("level") * F.col("weight"), F.struct("rank", "level"))).over(
        Window.orderBy(F.lit(0)).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))
    rows = rows.withColumn("rank", F.row_number().over(fill)).withColumn("stop", stop)
    return rows.select("source", "source_size", F.when(F.col("stop").isNull() | (F.col("rank") < F.col("stop.rank")), F.col("full"))
                       .otherwise(F.col("stop.level") * F.col("weight")).alias("target"))


def _rate(cap: int) -> Column:
    return F.least(F.lit(float(cap)), F.exp(F.least(F.lit(50.0), F.col("lam") * F.col("size") / F.col("mean"))))


def balance(histogram: DataFrame, goal: DataFrame, cap: int = CAP, tolerance: float = TOLERANCE) -> DataFrame:
    """``(source, mean, lam)`` that solve the dual of all sources; one job and one written table a round.

    Rounds go on until every source meets its target.  They end: a round that Newton's step does not serve halves the
    bracket, and a step that does shrinks it from one side; brackets narrower than ``1e-12`` are done.  A source whose
    bracket stays wide from one side is halved every fourth round.
    """
    facts = histogram.where("size > 0").groupBy("source").agg(F.sum("n").alias("docs"), F.min("size").alias("least"))
    ratio = F.col("target") / F.col("source_size")
    mean = F.col("source_size") / F.col("docs")
    state = goal.join(facts, goal.source.eqNullSafe(facts.source)).where("source_size > 0").select(
        goal.source, "target", mean.alias("mean"),
        # exp(lam * size / mean) is below the target at "lo" and at the cap for every size at "hi".
        (mean / F.col("least") * F.log(F.least(F.lit(1.0), ratio)) - 1).alias("lo"), (mean / F.col("least") * F.log(F.lit(float(cap))) + F.lit(1e-6)).alias("hi"),
        F.when(ratio >= cap, mean / F.col("least") * F.log(F.lit(float(cap))) + F.lit(1e-6)).otherwise(F.log(ratio)).alias("lam"),
        (ratio >= cap).alias("done"))
    state = staged(state, "mix-state")
    for number in count(1):
        rate = _rate(cap)
        at = histogram.join(state.select(F.col("source").alias("s"), "mean", "lam"), F.col("source").eqNullSafe(F.col("s")))
        sums = at.groupBy("s").agg(
            F.sum((rate * F.col("size") * F.col("n")).cast(_MONEY)).cast("double").alias("taken"),
            F.sum(F.when(rate < cap, rate * F.col("size") * F.col("n") * F.col("size") / F.col("mean")).otherwise(0.0).cast(_MONEY)).cast("double").alias("slope"))
        now = state.join(sums, F.col("source").eqNullSafe(F.col("s"))).withColumn("miss", F.col("taken") - F.col("target"))
        now = (now.withColumn("lo", F.when(F.col("miss") < 0, F.col("lam")).otherwise(F.col("lo")))
               .withColumn("hi", F.when(F.col("miss") > 0, F.col("lam")).otherwise(F.col("hi")))
               .withColumn("done", F.col("done") | (F.abs(F.col("miss")) <= F.lit(tolerance) * F.col("target")) | (F.col("hi") - F.col("lo") <= 1e-12 * F.greatest(F.lit(1.0), F.abs("lam")))))
        newton = F.col("lam") - F.col("miss") / F.col("slope")
        inside = (F.col("slope") > 0) & (newton > F.col("lo")) & (newton < F.col("hi")) & F.lit(number % 4 != 0)
        state = staged(now.select("source", "target", "mean", "lo", "hi", F.when(F.col("done"), F.col("lam")).when(inside, newton)
                                  .otherwise((F.col("lo") + F.col("hi")) / 2).alias("lam"), "done"), "mix-state")
        if state.where(~F.col("done")).isEmpty():
            return state.select("source", "mean", "lam")


def mix(docs: DataFrame, weights: tuple = WEIGHTS, cap: int = CAP, bucket_rows: int = BUCKET_ROWS,
        id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """``(doc_id, row, source, size, source_size, target, taken, copies, rate)`` for every row of ``docs``."""
    rows = staged(sizes(docs, id_col, text_col, source_col), "mix-sizes")
    histogram = staged(rows.groupBy("source", "size").agg(F.count("*").alias("n")), "mix-histogram")
    goal = staged(targets(histogram.groupBy("source").agg(F.sum(F.col("size") * F.col("n")).alias("source_size")), weights, cap), "mix-targets")
    lam = balance(histogram, goal, cap).withColumnRenamed("source", "s")
    wide = histogram.join(goal.withColumnRenamed("source", "g"), F.col("source").eqNullSafe(F.col("g"))).drop("g")
    wide = wide.join(lam, F.col("source").eqNullSafe(F.col("s")), "left").drop("s")
    rate = F.when((F.col("size") == 0) | F.col("lam").isNull(), 0.0).otherwise(_rate(cap))
    wide = wide.withColumn("rate", F.when(F.col("target") >= cap * F.col("source_size"), F.when(F.col("size") == 0, 0.0).otherwise(float(cap))).otherwise(rate))
    part = (F.col("rate") - F.floor("rate")).cast("decimal(20,12)")
    earlier = Window.partitionBy("source").orderBy("size").rowsBetween(Window.unboundedPreceding, -1)
    wide = wide.withColumn("part", part).withColumn("before", F.coalesce(F.sum((F.col("part") * F.col("n")).cast("decimal(38,12)")).over(earlier), F.lit(0).cast("decimal(38,12)")))
    wide = staged(wide.withColumn("buckets", F.ceil(F.col("n") / F.lit(bucket_rows)).cast("long")), "mix-rates").withColumnsRenamed({"source": "s", "size": "z"})
    dealt = rows.join(wide, F.col("source").eqNullSafe(F.col("s")) & (F.col("size") == F.col("z"))).drop("s", "z")
    dealt = dealt.withColumn("bucket", F.pmod(F.xxhash64("doc_id", "row"), F.col("buckets")))
    counted = dealt.groupBy("source", "size", "bucket").agg(F.count("*").alias("in_bucket"))
    skipped = counted.withColumn("skip", F.coalesce(F.sum("in_bucket").over(
        Window.partitionBy("source", "size").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    skipped = skipped.select(F.col("source").alias("s"), F.col("size").alias("z"), F.col("bucket").alias("b"), "skip")
    placed = dealt.join(skipped, F.col("source").eqNullSafe(F.col("s")) & (F.col("size") == F.col("z")) & (F.col("bucket") == F.col("b"))).drop("s", "z", "b")
    at = F.col("skip") + F.row_number().over(Window.partitionBy("source", "size", "bucket").orderBy(F.xxhash64("doc_id", "row"), "doc_id", "row"))
    reach = lambda n: F.floor(F.col("before") + (F.col("part") * n).cast("decimal(38,12)") + F.lit("0.5").cast("decimal(2,1)"))
    placed = placed.withColumn("at", at).withColumn("copies", (F.floor("rate") + reach(F.col("at")) - reach(F.col("at") - 1)).cast("long"))
    return repair(staged(placed.select("doc_id", "row", "source", "size", "source_size", "target", "rate", "copies", "bucket", "at"), "mix-copies"), cap)


def repair(placed: DataFrame, cap: int = CAP) -> DataFrame:
    """Moves one document of each source by one copy, the one whose size is nearest to the words still missing or too many.

    The table of sources is joined to the documents by source and slice, so that a source of a third of all rows is
    dealt over ``SLICES`` keys.
    """
    slices = F.array(*[F.lit(k) for k in range(SLICES)])
    placed = placed.withColumn("slice", F.pmod(F.xxhash64("doc_id", "row"), F.lit(SLICES)).cast("int"))

    def by_source(rows: DataFrame, facts: DataFrame, how: str = "inner") -> DataFrame:
        facts = facts.withColumnRenamed("source", "s").withColumn("k", F.explode(slices))
        return rows.join(facts, F.col("source").eqNullSafe(F.col("s")) & (F.col("slice") == F.col("k")), how).drop("s", "k")

    rest = placed.groupBy("source").agg((F.first("target") - F.sum(F.col("copies") * F.col("size"))).alias("rest"))
    with_rest = by_source(placed, rest)
    may = (F.col("size") > 0) & F.when(F.col("rest") > 0, F.col("copies") < cap).otherwise(F.col("copies") > 0)
    near = F.abs(F.abs("rest") - F.col("size"))
    key = F.struct(near.alias("near"), "size", "bucket", "at")
    moved = with_rest.where(may & (near < F.abs("rest"))).groupBy("source").agg(F.min(key).alias("key"))
    hit = (F.col("size") == F.col("key.size")) & (F.col("bucket") == F.col("key.bucket")) & (F.col("at") == F.col("key.at"))
    step = F.when(F.coalesce(hit, F.lit(False)), F.signum("rest").cast("long")).otherwise(0)
    done = by_source(with_rest, moved, "left").withColumn("copies", F.col("copies") + step)
    return done.select("doc_id", "row", "source", "size", "source_size", "target", (F.col("copies") * F.col("size")).alias("taken"), "copies", "rate")


def op5_entropy_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix(documents(spark, sf_dir)).drop("row", "source")


def stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pipeline stage: every document as often as the mix takes it.

    A row is named by id, text and source, any of which may be null, so texts that share an id keep their own copies.
    Rows that repeat all three appear as the first of them by their columns, with the copies of all.  Null, empty
    and word-less texts have size 0 and are taken 0 times; an empty table stays empty.
    """
    mixed = mix(docs).groupBy("doc_id", "row", "source").agg(F.sum("copies").alias("__mix_copies"), F.count("*").alias("rows"))
    chosen = staged(mixed.where("__mix_copies > 0").withColumnsRenamed({"doc_id": "__mix_id", "row": "__mix_row", "source": "__mix_source"}), "mix-taken")
    named = docs.withColumn("__mix_hash", F.xxhash64("text"))
    same = (F.col("__mix_hash") == F.col("__mix_row")) & F.col("doc_id").eqNullSafe(F.col("__mix_id")) & F.col("source").eqNullSafe(F.col("__mix_source"))
    taken = named.hint("merge").join(chosen, same)
    if not chosen.where("rows > 1").isEmpty():
        first = Window.partitionBy("__mix_hash", "doc_id", "source").orderBy(*docs.columns)
        taken = taken.withColumn("__mix_rank", F.row_number().over(first)).where("__mix_rank = 1")
    return taken.withColumn("__mix_copy", F.explode(F.sequence(F.lit(1).cast("long"), F.col("__mix_copies")))).select(*docs.columns)
