"""Leaders: the primitive that a leader's tip means, and whether the way to it is free."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from drawlake.operators.curves import SHAPE, distance, nearest_k
from drawlake.operators.spatial import cells_of_box

# Reach of a tip in pixels and in grid steps, and the least and relative support band of a target.
REACH_PX, REACH_GRIDS = 12.0, 2.25
BAND_PX, BAND_FACTOR = 10.0, 1.7


def nearest_entity(tips: DataFrame, curves: DataFrame) -> DataFrame:
    """The nearest curve of every tip ``(case_id, record_id, kind, px, py, arrowhead, grid)`` with its ring neighbours as alternatives.

    ``supported`` if the gap is within ``max(12, 2.25 grid)``; ``compatible`` unless a radius label meets a LINE.  A supported
    radius tip with a verified arrowhead keeps the two neighbours of its curve that are within 2.25 grid steps of it and of
    the best gap, in contours of more than two curves.  Tips of cases without curves keep null columns.
    """
    best = nearest_k(tips.select("case_id", "record_id", "px", "py"), curves, 1, ["record_id"]).select("case_id", "record_id", F.col("ord").alias("entity"), F.col("distance").alias("gap"))
    sizes = curves.groupBy("case_id").agg(F.count("*").alias("_n"))
    kinds = curves.select("case_id", F.col("ord").alias("entity"), F.col("kind").alias("entity_kind"))
    rows = tips.join(best, ["case_id", "record_id"], "left").join(kinds, ["case_id", "entity"], "left")
    supported = F.coalesce(F.col("gap") <= F.greatest(F.lit(REACH_PX), REACH_GRIDS * F.col("grid")), F.lit(False))
    compatible = F.coalesce((F.col("kind") != "radius") | (F.col("entity_kind") == "ARC"), F.lit(False))
    rows = rows.withColumns({"supported": supported, "compatible": compatible})
    asked = rows.where("kind = 'radius' and supported and arrowhead").join(sizes, "case_id").where("_n > 2")
    asked = asked.withColumn("neighbour", F.explode(F.array_distinct(F.array(F.pmod(F.col("entity") - 1, F.col("_n")), F.pmod(F.col("entity") + 1, F.col("_n"))))))
    shapes = curves.select("case_id", F.col("ord").alias("neighbour"), *SHAPE)
    near = asked.select("case_id", "record_id", "px", "py", "gap", "grid", "neighbour").join(shapes, ["case_id", "neighbour"])
    near = near.withColumn("_gap", distance(F.col("px"), F.col("py")))
    reach = REACH_GRIDS * F.col("grid")
    near = near.where((F.col("_gap") <= reach) & (F.col("_gap") - F.col("gap") <= reach))
    # Two neighbours at most, so the list is bounded.
    lists = near.groupBy("case_id", "record_id").agg(F.array_sort(F.collect_list("neighbour")).alias("alternatives"))
    rows = rows.join(lists, ["case_id", "record_id"], "left")
    return rows.withColumn("alternatives", F.coalesce("alternatives", F.array().cast("array<bigint>")))


def support_summary(rows: DataFrame) -> DataFrame:
    """Targets, targets reached and the share of compatible ones by case."""
    counts = rows.groupBy("case_id").agg(F.count("*").alias("targets"), F.count_if("supported").alias("reached"), F.count_if(F.col("supported") & F.col("compatible")).alias("compatible"))
    return counts.withColumn("fraction", F.col("compatible") / F.col("targets"))


def visibility(rays: DataFrame, edges: DataFrame) -> DataFrame:
    """First edge that a ray ``(case_id, record_id, ax, ay, tx, ty, band)`` meets, as a share of its length (null if none).

    Ray and edges meet in the cells that both touch; the cells of a case are sized by its number of edges, and a ray is cut
    into pieces of a cell's size, so it walks along its own cells only.  Touching an end or a joint is a hit; along an edge
    that lies on the ray the first common point counts; a ray without length meets nothing.  ``verified`` if what is left
    behind the first hit is within the support band of the target.
    """
    c = F.col
    box = edges.select("case_id", F.least("sx", "ex").alias("x0"), F.least("sy", "ey").alias("y0"), F.greatest("sx", "ex").alias("x1"), F.greatest("sy", "ey").alias("y1"))
    frame = box.groupBy("case_id").agg(
        (F.greatest(F.max("x1") - F.min("x0"), F.max("y1") - F.min("y0"), F.lit(1e-9)) / F.sqrt(F.count("*").cast("double"))).alias("_size"),
        F.min("x0").alias("_l"), F.min("y0").alias("_b"), F.max("x1").alias("_r"), F.max("y1").alias("_t"))

    def cells(rows: DataFrame, ax: str, ay: str, bx: str, by: str) -> DataFrame:
        dx, dy = c(bx) - c(ax), c(by) - c(ay)
        rows = rows.withColumn("_k", F.greatest(F.lit(1), F.ceil(F.hypot(dx, dy) / c("_size"))).cast("int"))
        rows = rows.withColumn("_i", F.explode(F.sequence(F.lit(0), c("_k") - 1)))
        at = lambda s, d, i: s + d * (i / c("_k"))
        xs, ys = (at(c(ax), dx, c("_i")), at(c(ax), dx, c("_i") + 1)), (at(c(ay), dy, c("_i")), at(c(ay), dy, c("_i") + 1))
        slack = c("_size") * 1e-6
        touched = cells_of_box(F.least(*xs) - slack, F.least(*ys) - slack, F.greatest(*xs) + slack, F.greatest(*ys) + slack, c("_size"))
        return rows.withColumn("_cell", F.explode(touched)).drop("_k", "_i")

    # Outside the box of all edges there is nothing to meet: the ray is clipped to it before it is cut.
    rayed = rays.join(frame, "case_id")
    dx, dy = c("tx") - c("ax"), c("ty") - c("ay")

    def clipped(start, step, low, high):
        a, b = (low - c("_size") - start) / F.nullif(step, F.lit(0.0)), (high + c("_size") - start) / F.nullif(step, F.lit(0.0))
        inside = start.between(low - c("_size"), high + c("_size"))
        return F.when(step == 0, F.when(inside, 0.0).otherwise(2.0)).otherwise(F.least(a, b)), F.when(step == 0, F.when(inside, 1.0).otherwise(-1.0)).otherwise(F.greatest(a, b))

    (x0, x1), (y0, y1) = clipped(c("ax"), dx, c("_l"), c("_r")), clipped(c("ay"), dy, c("_b"), c("_t"))
    rayed = rayed.withColumns({"_t0": F.greatest(F.lit(0.0), x0, y0), "_t1": F.least(F.lit(1.0), x1, y1)}).where((c("_t0") <= c("_t1")) & (F.hypot(dx, dy) > 1e-8))
    rayed = rayed.withColumns({"_ax": c("ax") + dx * c("_t0"), "_ay": c("ay") + dy * c("_t0"), "_bx": c("ax") + dx * c("_t1"), "_by": c("ay") + dy * c("_t1")})
    walk = cells(rayed, "_ax", "_ay", "_bx", "_by").select("case_id", "record_id", "ax", "ay", "tx", "ty", "_cell").distinct()
    placed = cells(edges.select("case_id", "sx", "sy", "ex", "ey").join(frame, "case_id"), "sx", "sy", "ex", "ey").select("case_id", "_cell", "sx", "sy", "ex", "ey").distinct()
    pairs = walk.join(placed, ["case_id", "_cell"])
    qx, qy, rx, ry = c("ex") - c("sx"), c("ey") - c("sy"), c("sx") - c("ax"), c("sy") - c("ay")
    cross = dx * qy - dy * qx
    t, u = (rx * qy - ry * qx) / cross, (rx * dy - ry * dx) / cross
    length2 = dx * dx + dy * dy
    ta, tb = (rx * dx + ry * dy) / length2, ((c("ex") - c("ax")) * dx + (c("ey") - c("ay")) * dy) / length2
    crossing = F.when(t.between(-1e-9, 1 + 1e-9) & u.between(-1e-9, 1 + 1e-9), t)
    along = F.when((F.abs(rx * dy - ry * dx) <= 1e-7) & (F.greatest(ta, tb) >= 0) & (F.least(ta, tb) <= 1), F.greatest(F.lit(0.0), F.least(ta, tb)))
    hit = F.least(F.lit(1.0), F.greatest(F.lit(0.0), F.when(F.abs(cross) > 1e-9, crossing).otherwise(along)))
    hit = F.when(F.when(F.abs(cross) > 1e-9, crossing).otherwise(along).isNotNull(), hit)
    first = pairs.groupBy("case_id", "record_id").agg(F.min(hit).alias("first"))
    rows = rays.join(first, ["case_id", "record_id"], "left")
    left = (1 - c("first")) * F.hypot(dx, dy)
    return rows.withColumns({"remaining": left, "verified": F.coalesce(left <= F.greatest(F.lit(BAND_PX), BAND_FACTOR * c("band")), F.lit(True))})
