"""Corpus hygiene: near duplicates, leakage-free splits, identity and review joins."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from drawlake.operators.prefix import running_total
from drawlake.operators.spatial import components, hamming_neighbours, star_edges
from drawlake.session import checkpoint

# Split shares and the near-duplicate limits.
TRAIN, VAL = 0.70, 0.85
HAMMING_LIMIT = 4
ASPECT_LIMIT = 1.03


def near_duplicates(rows: DataFrame) -> DataFrame:
    """Pairs within four signature bits and 3% aspect ratio.

    Copies of one (signature, aspect) are represented by their smallest id, so a hot signature does
    not pair with itself; :func:`duplicate_groups` ties the copies to that id.
    """
    unique = rows.groupBy("signature", "aspect").agg(F.min("id").alias("id"))
    ratio = F.greatest("l.aspect", "r.aspect") / F.least("l.aspect", "r.aspect") <= ASPECT_LIMIT
    return hamming_neighbours(unique, "id", "signature", HAMMING_LIMIT, ratio)


def duplicate_groups(rows: DataFrame) -> DataFrame:
    """Component of every item over equal and near-equal signatures, which are written once as several steps read them."""
    rows = checkpoint(rows.select("id", "signature", "aspect"))
    edges = near_duplicates(rows).select("a", "b").unionByName(star_edges(rows, ["signature", "aspect"], "id"))
    return components(edges, rows.select("id"), node="id")


def split_groups(groups: DataFrame, seed: str = "split", train_groups: DataFrame | None = None) -> DataFrame:
    """Whole groups to train/val/test by cumulative share, larger groups first.

    Sizes are few, so the running total goes over distinct sizes; groups of one size are placed by the share
    of their seeded digest within that size.  Groups of ``train_groups(component)`` are forced to train
    and still count in the shares.
    """
    sized = groups.groupBy("component").agg(F.count("*").alias("n"))
    per_size = sized.groupBy("n").agg((F.count("*") * F.col("n")).alias("rows"))
    shares = running_total(per_size, [], [F.desc("n")], F.col("rows"))
    digest = F.conv(F.substring(F.sha2(F.concat_ws(":", F.lit(seed), F.col("component").cast("string")), 256), 1, 8), 16, 10).cast("long")
    place = digest / F.lit(float(1 << 32))
    cut = sized.join(shares, "n").withColumn("_at", (F.col("_before") + place * F.col("rows")) / F.col("_total"))
    split = F.when(F.col("_at") < TRAIN, "train").when(F.col("_at") < VAL, "val").otherwise("test")
    if train_groups is not None:
        cut = cut.join(train_groups.select("component", F.lit(True).alias("_forced")).distinct(), "component", "left")
        split = F.when(F.col("_forced"), "train").otherwise(split)
    return cut.select("component", "n", split.alias("split"))


def leakage(manifest: DataFrame, key: str) -> DataFrame:
    """Values of ``key`` that occur in more than one split."""
    per = manifest.where(F.col(key).isNotNull()).groupBy(F.col(key).alias("value")).agg(F.count_distinct("split").alias("splits"), F.count("*").alias("n"))
    return per.where("splits > 1").withColumn("leak_key", F.lit(key))
