"""Exact linear-interpolated quantiles of groups of any size."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from drawlake.operators.prefix import running_total


def group_quantiles(df: DataFrame, keys: list[str], value: str, probs: dict[str, float]) -> DataFrame:
    """One row per group: count, minimum, maximum and the named quantiles.

    Built-in ``percentile`` keeps every distinct value of a group in one task.  Here equal values are
    counted first and their exact ranks come from running totals over ranges of values.
    """
    counted = df.where(F.col(value).isNotNull()).groupBy(*keys, value).agg(F.count("*").alias("_n"))
    ranked = running_total(counted, keys, [F.col(value).asc()], F.col("_n"))
    aggregates = []
    for name, p in probs.items():
        position = F.lit(p) * (F.col("_total") - 1)

        def at(rank):
            return F.max(F.when((F.col("_before") <= rank) & (rank < F.col("_before") + F.col("_n")), F.col(value)))

        low, high = at(F.floor(position)), at(F.ceil(position))
        aggregates.append((low + (high - low) * F.max(position - F.floor(position))).alias(name))
    return ranked.groupBy(*keys).agg(
        F.max("_total").alias("count"), F.min(value).alias("minimum"), F.max(value).alias("maximum"), *aggregates
    )
