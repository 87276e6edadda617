"""Polylines and rings of any size: equal steps of length, and digests that do not depend on where a ring starts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from drawlake.operators.prefix import running_total
from drawlake.operators.spatial import MOST_SHAPES, by_size, large_cases
from drawlake.session import checkpoint


def resample(points: DataFrame, step: float, most: int = 30_000, keys: tuple[str, ...] = ("case_id",)) -> DataFrame:
    """``(*keys, i, x, y)``: polylines ``(*keys, ord, x, y)`` with ``ord`` from 0 at equal steps of length, both ends included.

    A path of length L gets ``min(most, max(2, ceil(L / step) + 1))`` points.  An edge is joined to its successor on its
    position; running lengths come from ranges of edges, so one long path is dealt over many tasks.  Every edge gives the
    points between its own running length and the next edge's, so each point comes from exactly one edge.  Edges without
    length give no point; a path without length or of one point keeps its first point.
    """
    keys = list(keys)
    here = points.select(*keys, "ord", "x", "y")
    after = points.select(*keys, (F.col("ord") - 1).alias("ord"), F.col("x").alias("nx"), F.col("y").alias("ny"))
    edges = here.join(after, [*keys, "ord"]).withColumn("_len", F.hypot(F.col("nx") - F.col("x"), F.col("ny") - F.col("y")))
    run = checkpoint(running_total(edges, keys, [F.col("ord").asc()], F.col("_len")))
    upto = run.select(*keys, (F.col("ord") - 1).alias("ord"), F.col("_before").alias("_next"))
    rows = run.join(upto, [*keys, "ord"], "left").where(F.col("_total") > 0)
    count = F.least(F.lit(most), F.greatest(F.lit(2), F.ceil(F.col("_total") / step) + 1))
    rows = rows.withColumn("_n", count).withColumn("_gap", F.col("_total") / (F.col("_n") - 1))
    first = F.ceil(F.col("_before") / F.col("_gap"))
    last = F.when(F.col("_next").isNull(), F.col("_n") - 1).otherwise(F.least(F.ceil(F.col("_next") / F.col("_gap")) - 1, F.col("_n") - 1))
    rows = rows.where(first <= last).withColumn("i", F.explode(F.sequence(first, last)))
    share = F.least(F.lit(1.0), F.greatest(F.lit(0.0), (F.col("i") * F.col("_gap") - F.col("_before")) / F.nullif(F.col("_len"), F.lit(0.0))))
    share = F.coalesce(share, F.lit(1.0))  # an edge without length at the very end stands for its point
    moved = rows.select(*keys, F.col("i").cast("long").alias("i"), (F.col("x") + share * (F.col("nx") - F.col("x"))).alias("x"), (F.col("y") + share * (F.col("ny") - F.col("y"))).alias("y"))
    still = points.where("ord = 0").join(run.where(F.col("_total") > 0).select(*keys).distinct(), keys, "left_anti")
    return moved.unionByName(still.select(*keys, F.lit(0).cast("long").alias("i"), F.col("x").cast("double").alias("x"), F.col("y").cast("double").alias("y")))


def ring_digest(rings: DataFrame, forward: Column, backward: Column, keys: tuple[str, ...] = ("case_id",)) -> DataFrame:
    """``(*keys, digest)``: a digest of each ring that all its rotations and both directions share.

    ``rings`` has ``ord`` from 0; ``forward`` and ``backward`` describe an element as it is met in either direction.  Round k joins
    the digests of stretches of 2^k elements to those that begin where they end, so after log2(n) rounds each position has
    the digest of a whole turn from there, and the smallest of them is the ring's.  A ring of bounded size does its rounds in
    its own row; those of a larger one are joins on (ring, position), and no row holds it.
    """
    keys = list(keys)
    large = large_cases([(rings, MOST_SHAPES)], *keys)
    return by_size(large, [rings], lambda r: _digest_in_row(r, forward, backward, keys), lambda r: _digest_by_joins(r, forward, backward, keys))


def _digest_in_row(rings: DataFrame, forward: Column, backward: Column, keys: list[str]) -> DataFrame:
    """Elements are shuffled once as they are; their texts are made where the ring is."""
    listed = F.sort_array(F.collect_list(F.struct("ord", forward.alias("f"), backward.alias("b"))))
    rows = rings.repartition(*[F.col(k) for k in keys]).groupBy(*keys).agg(listed.alias("_list"))
    rows = rows.select(*keys, F.explode(F.array("_list")).alias("_list")).withColumn("_n", F.size("_list"))

    def turn(name):
        texts = F.transform("_list", lambda e: F.sha2(F.concat_ws("|", F.col("_n").cast("string"), e[name]), 256))
        return texts if name == "f" else F.reverse(texts)

    def longer(digests, k):
        after = lambda i: F.get(digests, ((i + F.pow(F.lit(2.0), k)) % F.col("_n")).cast("int"))
        return F.transform(F.sequence(F.lit(0), F.col("_n") - 1), lambda i: F.sha2(F.concat(F.get(digests, i), after(i)), 256))

    rounds = F.sequence(F.lit(0), F.length(F.bin(F.col("_n") - 1)) - 1)  # all k with 2^k < n
    whole = lambda name: F.when(F.col("_n") > 1, F.aggregate(rounds, turn(name), longer)).otherwise(turn(name))
    return rows.select(*keys, F.array_min(F.concat(whole("f"), whole("b"))).alias("digest"))


def _digest_by_joins(rings: DataFrame, forward: Column, backward: Column, keys: list[str]) -> DataFrame:
    sizes = rings.groupBy(*keys).agg(F.count("*").alias("_n"))
    rows = rings.join(sizes, keys)
    both = rows.select(*keys, "_n", F.explode(F.array(
        F.struct(F.lit(0).alias("_way"), F.col("ord").cast("long").alias("_at"), forward.alias("_text")),
        F.struct(F.lit(1).alias("_way"), (F.col("_n") - 1 - F.col("ord")).cast("long").alias("_at"), backward.alias("_text")))).alias("e")).select(*keys, "_n", "e.*")
    now = checkpoint(both.select(*keys, "_way", "_at", "_n", F.sha2(F.concat_ws("|", F.col("_n").cast("string"), "_text"), 256).alias("_digest")))
    largest, reach = sizes.agg(F.max("_n")).first()[0] or 0, 1
    while reach < largest:
        other = now.select(*keys, "_way", F.pmod(F.col("_at") - reach, F.col("_n")).alias("_at"), F.col("_digest").alias("_more"))
        joined = F.when(F.col("_n") > reach, F.sha2(F.concat("_digest", "_more"), 256)).otherwise(F.col("_digest"))
        now = checkpoint(now.join(other, [*keys, "_way", "_at"]).select(*keys, "_way", "_at", "_n", joined.alias("_digest")))
        reach *= 2
    return now.groupBy(*keys).agg(F.min("_digest").alias("digest"))


def closed_rings(points: DataFrame, limit: float = 1e-10, keys: tuple[str, ...] = ("case_id",)) -> DataFrame:
    """``(*keys, ord, x, y, issue)``: contours ``(*keys, ord, x, y)`` with ``ord`` from 0 without repeated vertices, and what is wrong with them.

    A vertex within ``limit`` of the one before it goes, and so does the last one that is left if it closes the ring onto the
    first; predecessors are joined on their position.  ``issue`` names contours with a coordinate that is not finite, or
    with fewer than three vertices left; it is null for good ones.
    """
    keys = list(keys)
    before = points.select(*keys, (F.col("ord") + 1).alias("ord"), F.col("x").alias("_px"), F.col("y").alias("_py"))
    left = points.join(before, [*keys, "ord"], "left").where(F.col("_px").isNull() | ~(F.hypot(F.col("x") - F.col("_px"), F.col("y") - F.col("_py")) <= limit)).drop("_px", "_py")
    big = float("inf")
    finite = F.coalesce((F.abs("x") < big) & (F.abs("y") < big), F.lit(False))
    ends = left.groupBy(*keys).agg(F.min_by(F.struct("x", "y"), "ord").alias("_first"), F.max(F.struct("ord", "x", "y")).alias("_last"), F.count("*").alias("_n"), F.bool_and(finite).alias("_finite"))
    closes = (F.col("_n") > 1) & (F.hypot(F.col("_first.x") - F.col("_last.x"), F.col("_first.y") - F.col("_last.y")) <= limit)
    ends = ends.withColumn("_closes", F.coalesce(closes, F.lit(False)))
    issue = F.when(~F.col("_finite"), "not_finite").when(F.col("_n") - F.col("_closes").cast("int") < 3, "fewer_than_three_vertices")
    rows = left.join(ends.withColumn("issue", issue), keys).where(~F.col("_closes") | (F.col("ord") != F.col("_last.ord")))
    return rows.select(*keys, "ord", "x", "y", "issue")
