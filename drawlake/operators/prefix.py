"""Running totals and ranks within groups of any size.

Rows are dealt by range of (group, order), so one group may spread over many tasks; a task sums its own rows
and the totals of its earlier neighbours are added.  No task holds a whole group beyond a bounded size.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from drawlake.operators.spatial import MOST_POINTS, by_size, large_cases
from drawlake.session import checkpoint


def running_total(df: DataFrame, keys: list[str], order: list[Column], weight: Column) -> DataFrame:
    """``df`` with ``_before``, the weight of the group's earlier rows, and ``_total``, the weight of the group.

    ``order`` should be total within a group; rows that tie follow each other in any order.
    """
    by_key = [F.col(k).asc() for k in keys]
    dealt = df.withColumn("_weight", weight).repartitionByRange(*by_key, *order)
    dealt = checkpoint(dealt.withColumn("_part", F.spark_partition_id()))
    own = Window.partitionBy("_part", *keys).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    inside = dealt.withColumn("_inside", F.coalesce(F.sum("_weight").over(own), F.lit(0)))
    parts = dealt.groupBy("_part", *keys).agg(F.sum("_weight").alias("_sum"))
    group = Window.partitionBy(*keys)
    earlier = group.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    parts = parts.select(
        F.col("_part").alias("_p"), *[F.col(k).alias(f"_k_{k}") for k in keys],
        F.coalesce(F.sum("_sum").over(earlier), F.lit(0)).alias("_skip"), F.sum("_sum").over(group).alias("_total"),
    )
    same = F.col("_part") == F.col("_p")
    for k in keys:
        same = same & F.col(k).eqNullSafe(F.col(f"_k_{k}"))
    joined = inside.join(parts, same)
    return joined.withColumn("_before", F.col("_inside") + F.col("_skip")).select(*df.columns, "_before", "_total")


def rank_all(df: DataFrame, keys: list[str], order: list[Column], rank: str = "rank", sized: DataFrame | None = None) -> DataFrame:
    """Every row with its place in the group, from 1.

    Groups of bounded size are ranked in the task that holds them, larger ones by running totals.  ``sized``, with the keys of the
    same rows, is counted in place of ``df`` to find the large groups.
    """

    def inside(rows):
        return rows.withColumn(rank, F.row_number().over(Window.partitionBy(*keys).orderBy(*order)))

    def across(rows):
        ranked = running_total(rows, keys, order, F.lit(1).cast("long"))
        return ranked.withColumn(rank, F.col("_before").cast("int") + 1).drop("_before", "_total")

    if not keys:
        return across(df)
    return by_size(large_cases([(df if sized is None else sized, MOST_POINTS)], *keys), [df], inside, across)
