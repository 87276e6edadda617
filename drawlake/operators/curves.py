"""Contours that mix LINE and ARC: one table for both kinds, and exact nearest curves by id.

A curve is a row ``kind, sx, sy, ex, ey, cx, cy, radius, start_angle, sweep, length``; angles are radians, a positive
sweep turns left, and the arc columns of a LINE are null.
"""

from __future__ import annotations

import math
from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from drawlake.operators.spatial import MOST_POINTS, MOST_SHAPES, by_size, cells_of_box, large_cases, segment_distance
from drawlake.session import checkpoint

SHAPE = ["kind", "sx", "sy", "ex", "ey", "cx", "cy", "radius", "start_angle", "sweep", "length"]
TURN = 2 * math.pi


def is_arc(of: Callable[[str], Column] = F.col) -> Column:
    return of("kind") == "ARC"


def point_at(share: Column) -> tuple[Column, Column]:
    """The point at a share of a curve's length."""
    angle = F.col("start_angle") + F.col("sweep") * share
    x = F.when(is_arc(), F.col("cx") + F.col("radius") * F.cos(angle)).otherwise(F.col("sx") + share * (F.col("ex") - F.col("sx")))
    y = F.when(is_arc(), F.col("cy") + F.col("radius") * F.sin(angle)).otherwise(F.col("sy") + share * (F.col("ey") - F.col("sy")))
    return x, y


def on_sweep(angle: Column, slack: float = 1e-12, of: Callable[[str], Column] = F.col) -> Column:
    """Whether a direction from the centre lies on the arc."""
    offset = F.when(of("sweep") >= 0, angle - of("start_angle")).otherwise(of("start_angle") - angle)
    return F.pmod(offset, F.lit(TURN)) <= F.abs(of("sweep")) + slack


def distance(px: Column, py: Column, of: Callable[[str], Column] = F.col) -> Column:
    """Distance of a point to a curve; ``of`` gives the curve's columns."""
    line = segment_distance(px, py, of("sx"), of("sy"), of("ex"), of("ey"))
    ends = F.least(F.hypot(px - of("sx"), py - of("sy")), F.hypot(px - of("ex"), py - of("ey")))
    round_ = F.abs(F.hypot(px - of("cx"), py - of("cy")) - of("radius"))
    return F.when(is_arc(of), F.when(on_sweep(F.atan2(py - of("cy"), px - of("cx")), of=of), round_).otherwise(ends)).otherwise(line)


def sample(curves: DataFrame, step: Column | float) -> DataFrame:
    """Samples at equal steps of arc length, both ends included."""
    count = F.greatest(F.lit(2), F.ceil(F.col("length") / step) + 1).cast("int")
    rows = curves.withColumn("_n", count).withColumn("sample", F.explode(F.sequence(F.lit(0), F.col("_n") - 1)))
    px, py = point_at(F.col("sample") / (F.col("_n") - 1))
    return rows.withColumns({"px": px, "py": py}).drop("_n")


def _boxes(curves: DataFrame, size: Column) -> DataFrame:
    """Curves cut into pieces not longer than ``size``, with the box of each piece (``_x0.._y1``)."""
    rows = curves.withColumn("_k", F.greatest(F.lit(1), F.ceil(F.col("length") / size)).cast("int"))
    rows = rows.withColumn("_i", F.explode(F.sequence(F.lit(0), F.col("_k") - 1)))
    (ax, ay), (bx, by) = point_at(F.col("_i") / F.col("_k")), point_at((F.col("_i") + 1) / F.col("_k"))
    # A piece of an arc leaves the box of its ends by its height over the chord at most, which is below half its length.
    bulge = F.when(is_arc(), F.least(F.col("length") / F.col("_k") / 2, 2 * F.col("radius"))).otherwise(0.0)
    return rows.withColumns({"_x0": F.least(ax, bx) - bulge, "_y0": F.least(ay, by) - bulge, "_x1": F.greatest(ax, bx) + bulge, "_y1": F.greatest(ay, by) + bulge}).drop("_k", "_i")


def nearest(points: DataFrame, curves: DataFrame, point_id: list[str], case: str = "case_id") -> DataFrame:
    """``(case, *point_id, distance)`` to the nearest curve; cases without curves give no rows.

    In cases of bounded size each point meets all curves in the task that holds the case; larger ones go through ``nearest_k``.
    """
    points, curves = points.select(case, *point_id, "px", "py"), curves.select(case, "ord", *SHAPE)

    def inside(points: DataFrame, curves: DataFrame) -> DataFrame:
        return points.join(curves.drop("ord").hint("merge"), case).groupBy(case, *point_id).agg(F.min(distance(F.col("px"), F.col("py"))).alias("distance"))

    large = large_cases([(points, MOST_POINTS), (curves, MOST_SHAPES)], case)
    if large is None:
        return inside(points, curves)
    rest = inside(*[rows.join(large, case, "left_anti") for rows in (points, curves)])
    return rest.unionByName(_nearest_by_cells(*[rows.join(large, case, "left_semi") for rows in (points, curves)], 1, point_id, "ord", case).select(*rest.columns))


def nearest_k(points: DataFrame, curves: DataFrame, k: int, point_id: list[str], curve_id: str = "ord", case: str = "case_id") -> DataFrame:
    """``(case, *point_id, curve_id, distance, rank)``: the ``k`` nearest curves of every point; all of a case with fewer.

    Distances that agree to nine decimals tie, and ties go by id.

    In cases of bounded size the curves are one list, which each point ranks in the task that holds the case; larger cases go
    through cells.  Cases without curves give no rows.
    """
    points, curves = points.select(case, *point_id, "px", "py"), curves.select(case, curve_id, *SHAPE)
    large = large_cases([(points, MOST_POINTS), (curves, MOST_SHAPES)], case)
    if large is None:
        return _nearest_in_list(points, curves, k, point_id, curve_id, case)
    rest = _nearest_in_list(*[rows.join(large, case, "left_anti") for rows in (points, curves)], k, point_id, curve_id, case)
    found = _nearest_by_cells(*[rows.join(large, case, "left_semi") for rows in (points, curves)], k, point_id, curve_id, case)
    return rest.unionByName(found.select(*rest.columns))


def _nearest_in_list(points: DataFrame, curves: DataFrame, k: int, point_id: list[str], curve_id: str, case: str) -> DataFrame:
    lists = curves.groupBy(case).agg(F.collect_list(F.struct(curve_id, *SHAPE)).alias("_curves"))
    ids = F.transform("_curves", lambda c: c[curve_id])
    lists = lists.withColumn("_plain", F.size("_curves") == F.size(F.array_distinct(ids)))
    far = lambda c: distance(F.col("px"), F.col("py"), lambda name: c[name])
    ways = F.array_sort(F.transform("_curves", lambda c: F.struct(far(c).alias("distance"), c[curve_id].alias("id"))))
    # All up to the k-th rounded distance stay, since ties go by id; all of them where an id has several curves.
    last = F.when(F.col("_plain"), F.round(F.element_at("_ways", F.least(F.lit(k), F.size("_ways")))["distance"], 9)).otherwise(float("inf"))
    near = points.join(lists.hint("merge"), case).withColumn("_ways", ways).withColumn("_last", last)
    near = near.select(case, *point_id, F.explode(F.filter("_ways", lambda w: F.round(w["distance"], 9) <= F.col("_last"))).alias("_w"))
    each = near.groupBy(case, *point_id, F.col("_w.id").alias(curve_id)).agg(F.min("_w.distance").alias("distance"))
    order = Window.partitionBy(case, *point_id).orderBy(F.round("distance", 9), curve_id)
    return each.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def _nearest_by_cells(points: DataFrame, curves: DataFrame, k: int, point_id: list[str], curve_id: str, case: str) -> DataFrame:
    """``nearest_k`` of cases of any size.

    A round looks for a point's curves in the 3x3 cells around it.  What lies outside them is further than a cell's size, so a
    point whose ``k`` nearest are within that is done; the others look again in cells of four times the size.  The
    first cells are sized by the case's number of curves, the last hold the whole case.  A round is one join on
    (case, cell), written to the shared checkpoint folder.
    """
    # An arc lies within twice its radius of its ends.
    wide = F.when(is_arc(), 2 * F.col("radius")).otherwise(0.0)
    spans = curves.select(case, (F.least("sx", "ex") - wide).alias("_l"), (F.greatest("sx", "ex") + wide).alias("_r"), (F.least("sy", "ey") - wide).alias("_b"),
                          (F.greatest("sy", "ey") + wide).alias("_t"), F.lit(1).alias("_n"))
    spots = points.select(case, F.col("px").alias("_l"), F.col("px").alias("_r"), F.col("py").alias("_b"), F.col("py").alias("_t"), F.lit(0).alias("_n"))
    frame = spans.unionByName(spots).groupBy(case).agg(
        F.min("_l").alias("_x"), F.min("_b").alias("_y"), F.greatest(F.max("_r") - F.min("_l"), F.max("_t") - F.min("_b"), F.lit(1e-9)).alias("_extent"),
        F.sum("_n").alias("_many")).where("_many > 0")
    frame = frame.withColumn("_first", F.col("_extent") / F.pow(F.lit(2.0), F.ceil(F.log2(F.sqrt(F.col("_many").cast("double"))))))
    left = checkpoint(points.select(case, *point_id, "px", "py").join(frame, case))
    shapes = curves.select(case, curve_id, *SHAPE).join(frame.drop("_many"), case)
    found, level = [], 0
    while not left.isEmpty():
        size = F.col("_first") * F.lit(4.0 ** level)
        cells = _boxes(shapes, size).withColumn("_cell", F.explode(F.array_distinct(cells_of_box(
            F.col("_x0") - F.col("_x"), F.col("_y0") - F.col("_y"), F.col("_x1") - F.col("_x"), F.col("_y1") - F.col("_y"), size))))
        cells = cells.select(case, "_cell", curve_id, *SHAPE).dropDuplicates([case, "_cell", curve_id])
        own = [F.floor((F.col(p) - F.col(o)) / size) for p, o in (("px", "_x"), ("py", "_y"))]
        around = F.array(*[F.struct((own[0] + dx).alias("cx"), (own[1] + dy).alias("cy")) for dx in (-1, 0, 1) for dy in (-1, 0, 1)])
        looks = left.withColumn("_cell", F.explode(around)).withColumnRenamed("_extent", "_far").withColumn("_size", size)
        pairs = looks.select(case, *point_id, "px", "py", "_far", "_size", "_cell").join(cells, [case, "_cell"])
        each = pairs.groupBy(case, *point_id, curve_id, "_far", "_size").agg(F.min(distance(F.col("px"), F.col("py"))).alias("distance"))
        point = Window.partitionBy(case, *point_id)
        ranked = each.withColumn("rank", F.row_number().over(point.orderBy(F.round("distance", 9), curve_id))).where(F.col("rank") <= k)
        whole = (F.count("*").over(point) == k) & (F.max("distance").over(point) <= F.col("_size"))
        ranked = checkpoint(ranked.withColumn("_done", whole | (F.col("_size") >= F.col("_far"))))
        found.append(ranked.where("_done").drop("_done", "_far", "_size"))
        left = checkpoint(left.join(found[-1].where("rank = 1").select(case, *point_id), [case, *point_id], "left_anti"))
        level += 1
    if not found:
        empty = left.select(case, *point_id).join(curves.select(F.col(case), curve_id), case)
        return empty.withColumns({"distance": F.lit(0.0), "rank": F.lit(0)}).where("false")
    return reduce(DataFrame.unionByName, found)


def signed_area(curves: DataFrame, case: str = "case_id") -> DataFrame:
    """``(case, area)``: signed area of closed contours, by Green's theorem on chords plus the segments of arcs."""
    chord = (F.col("sx") * F.col("ey") - F.col("ex") * F.col("sy")) / 2
    bow = F.when(is_arc(), F.col("radius") * F.col("radius") * (F.col("sweep") - F.sin("sweep")) / 2).otherwise(0.0)
    return curves.groupBy(case).agg(F.sum(chord + bow).alias("area"))


def turned(curves: DataFrame, matrix: tuple[float, float, float, float]) -> DataFrame:
    """Curves under a signed axis permutation ``(a, b, c, d)``; a reflection turns the direction of arcs."""
    a, b, c, d = (float(v) for v in matrix)
    if {abs(a * d - b * c)} != {1.0} or {abs(a) + abs(b), abs(c) + abs(d)} != {1.0}:
        raise ValueError("not a signed axis permutation")
    moved = {}
    for x, y in (("sx", "sy"), ("ex", "ey"), ("cx", "cy")):
        moved[x], moved[y] = a * F.col(x) + b * F.col(y), c * F.col(x) + d * F.col(y)
    moved["sweep"] = F.col("sweep") * (a * d - b * c)
    rows = curves.withColumns(moved)
    return rows.withColumn("start_angle", F.when(is_arc(), F.atan2(F.col("sy") - F.col("cy"), F.col("sx") - F.col("cx"))))


def _boxes_meet() -> Column:
    """Whether the boxes of curves ``a`` and ``b`` touch, with room for rounding; that of an arc holds its whole circle."""
    room = 1e-6 + 1e-8 * reduce(Column.__add__, [F.abs(f"{p}_{c}") for p in "ab" for c in ("sx", "sy", "ex", "ey")])

    def ends(p, x):
        arc, start, end, centre, radius = F.col(f"{p}_kind") == "ARC", *[F.col(f"{p}_{c}") for c in (f"s{x}", f"e{x}", f"c{x}", "radius")]
        return F.when(arc, centre - radius).otherwise(F.least(start, end)), F.when(arc, centre + radius).otherwise(F.greatest(start, end))

    meet = []
    for x in "xy":
        (low, high), (other_low, other_high) = ends("a", x), ends("b", x)
        meet.append((low <= other_high + room) & (other_low <= high + room))
    return meet[0] & meet[1]


def crossings(curves: DataFrame, cell: float, slack: float = 1e-9) -> DataFrame:
    """``(case_id, first, second, x, y)``: inner crossing points of two curves of one case.

    In cases of bounded size every curve meets the others of its case in the task that holds it; in larger ones curves meet in
    the cells that pieces of both touch.  Two lines cross once, a line and an arc or two arcs up to twice.
    Points that both curves have as an end are joints, not crossings; curves that overlap along a stretch
    are not reported here.
    """
    shape = lambda rows, p, key: rows.select("case_id", F.col("ord").alias(key), *[F.col(c).alias(f"{p}_{c}") for c in SHAPE])

    def inside(curves: DataFrame) -> DataFrame:
        pairs = shape(curves, "a", "first").join(shape(curves, "b", "second").hint("merge"), "case_id")
        return pairs.where((F.col("first") < F.col("second")) & _boxes_meet())

    def across(curves: DataFrame) -> DataFrame:
        pieces = _boxes(curves, F.lit(cell)).withColumn("_cell", F.explode(cells_of_box(F.col("_x0"), F.col("_y0"), F.col("_x1"), F.col("_y1"), cell)))
        placed = pieces.select("case_id", "_cell", "ord").distinct()
        met = placed.alias("a").join(placed.alias("b"), (F.col("a.case_id") == F.col("b.case_id")) & (F.col("a._cell") == F.col("b._cell")) & (F.col("a.ord") < F.col("b.ord")))
        pairs = met.select(F.col("a.case_id").alias("case_id"), F.col("a.ord").alias("first"), F.col("b.ord").alias("second")).distinct()
        return pairs.join(shape(curves, "a", "first"), ["case_id", "first"]).join(shape(curves, "b", "second"), ["case_id", "second"])

    rows = by_size(large_cases([(curves, MOST_SHAPES)], "case_id"), [curves], inside, across)
    c = F.col

    def line_line():
        rx, ry, qx, qy = c("a_ex") - c("a_sx"), c("a_ey") - c("a_sy"), c("b_ex") - c("b_sx"), c("b_ey") - c("b_sy")
        cross = rx * qy - ry * qx
        t = ((c("b_sx") - c("a_sx")) * qy - (c("b_sy") - c("a_sy")) * qx) / F.nullif(cross, F.lit(0.0))
        return F.array(F.struct((c("a_sx") + t * rx).alias("x"), (c("a_sy") + t * ry).alias("y")))

    def line_arc(p, q):
        dx, dy = c(f"{p}_ex") - c(f"{p}_sx"), c(f"{p}_ey") - c(f"{p}_sy")
        fx, fy = c(f"{p}_sx") - c(f"{q}_cx"), c(f"{p}_sy") - c(f"{q}_cy")
        A, B, C = dx * dx + dy * dy, fx * dx + fy * dy, fx * fx + fy * fy - c(f"{q}_radius") * c(f"{q}_radius")
        root = F.sqrt(F.when(B * B - A * C >= 0, B * B - A * C))
        at = lambda t: F.struct((c(f"{p}_sx") + t * dx).alias("x"), (c(f"{p}_sy") + t * dy).alias("y"))
        return F.array(at((-B - root) / A), at((-B + root) / A))

    def arc_arc():
        dx, dy = c("b_cx") - c("a_cx"), c("b_cy") - c("a_cy")
        d2 = F.nullif(dx * dx + dy * dy, F.lit(0.0))
        along = (d2 + c("a_radius") * c("a_radius") - c("b_radius") * c("b_radius")) / (2 * d2)
        h = F.sqrt(F.when(c("a_radius") * c("a_radius") / d2 - along * along >= 0, c("a_radius") * c("a_radius") / d2 - along * along))
        at = lambda s: F.struct((c("a_cx") + along * dx - s * h * dy).alias("x"), (c("a_cy") + along * dy + s * h * dx).alias("y"))
        return F.array(at(1.0), at(-1.0))

    arc_a, arc_b = c("a_kind") == "ARC", c("b_kind") == "ARC"
    spots = F.when(~arc_a & ~arc_b, line_line()).when(~arc_a & arc_b, line_arc("a", "b")).when(arc_a & ~arc_b, line_arc("b", "a")).otherwise(arc_arc())
    rows = rows.withColumn("_p", F.explode(spots)).where("_p.x is not null").withColumns({"x": F.col("_p.x"), "y": F.col("_p.y")})

    def on(p):
        dx, dy = c(f"{p}_ex") - c(f"{p}_sx"), c(f"{p}_ey") - c(f"{p}_sy")
        t = ((c("x") - c(f"{p}_sx")) * dx + (c("y") - c(f"{p}_sy")) * dy) / (dx * dx + dy * dy)
        offset = F.when(c(f"{p}_sweep") >= 0, F.atan2(c("y") - c(f"{p}_cy"), c("x") - c(f"{p}_cx")) - c(f"{p}_start_angle")).otherwise(
            c(f"{p}_start_angle") - F.atan2(c("y") - c(f"{p}_cy"), c("x") - c(f"{p}_cx")))
        turn = F.pmod(offset, F.lit(TURN))
        return F.when(c(f"{p}_kind") == "ARC", (turn <= F.abs(f"{p}_sweep") + slack) | (turn >= TURN - slack)).otherwise(t.between(-slack, 1 + slack))

    end = lambda p: F.least(F.hypot(c("x") - c(f"{p}_sx"), c("y") - c(f"{p}_sy")), F.hypot(c("x") - c(f"{p}_ex"), c("y") - c(f"{p}_ey"))) <= 1e-6
    return rows.where(on("a") & on("b") & ~(end("a") & end("b"))).select("case_id", "first", "second", "x", "y")
