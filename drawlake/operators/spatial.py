"""Within-case spatial joins on equi keys, connected components and Hamming neighbours.

No join here pairs all rows of a large case: every predicate is turned into bins or cells that take part
in the equi key, so one drawing that holds a large share of the rows still spreads over many tasks.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce
from itertools import combinations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from drawlake.session import checkpoint

#: Rows of a case up to which all its shapes meet all its points in one task.
MOST_SHAPES, MOST_POINTS = 1024, 65536


def bins(lo: Column, hi: Column, width: float) -> Column:
    return F.sequence(F.floor(lo / width), F.floor(hi / width))


def point_in_range(ranges: DataFrame, points: DataFrame, keys: list[str], lo: str, hi: str, at: str, width: float) -> DataFrame:
    """Rows with ``lo <= at <= hi``; the range side is cut into bins of ``width``."""
    left = ranges.where(F.col(lo) <= F.col(hi)).withColumn("_bin", F.explode(bins(F.col(lo), F.col(hi), width)))
    right = points.withColumn("_bin", F.floor(F.col(at) / width))
    return left.join(right, [*keys, "_bin"]).where(F.col(at).between(F.col(lo), F.col(hi))).drop("_bin")


def cells_of_box(x0: Column, y0: Column, x1: Column, y1: Column, size: Column | float) -> Column:
    """Every cell a bounding box touches, as ``struct(cx, cy)``."""
    ys = F.sequence(F.floor(y0 / size), F.floor(y1 / size))
    return F.flatten(
        F.transform(
            F.sequence(F.floor(x0 / size), F.floor(x1 / size)),
            lambda cx: F.transform(ys, lambda cy: F.struct(cx.alias("cx"), cy.alias("cy"))),
        )
    )


def grid_join(left: DataFrame, right: DataFrame, keys: list[str], lx: str, ly: str, rx: str, ry: str, tol: float) -> DataFrame:
    """Point pairs within ``tol``: one side is copied into its 3x3 neighbour cells."""
    spread = left.withColumn(
        "_cell", F.explode(cells_of_box(F.col(lx) - tol, F.col(ly) - tol, F.col(lx) + tol, F.col(ly) + tol, tol))
    )
    placed = right.withColumn("_cell", F.struct(F.floor(F.col(rx) / tol).alias("cx"), F.floor(F.col(ry) / tol).alias("cy")))
    near = F.hypot(F.col(lx) - F.col(rx), F.col(ly) - F.col(ry)) <= tol
    return spread.join(placed, [*keys, "_cell"]).where(near).drop("_cell")


def _way(px: Column, py: Column, sx: Column, sy: Column, ex: Column, ey: Column) -> tuple[Column, Column]:
    """From the nearest place of a segment to the point."""
    dx, dy = ex - sx, ey - sy
    squared = F.greatest(dx * dx + dy * dy, F.lit(1e-300))  # a point is a segment of length zero
    t = F.least(F.lit(1.0), F.greatest(F.lit(0.0), ((px - sx) * dx + (py - sy) * dy) / squared))
    return px - sx - t * dx, py - sy - t * dy


def segment_distance(px: Column, py: Column, sx: Column, sy: Column, ex: Column, ey: Column) -> Column:
    return F.hypot(*_way(px, py, sx, sy, ex, ey))


def large_cases(sides: list[tuple[DataFrame, int]], *case: str) -> DataFrame | None:
    """Cases (rows with the columns ``case``) in which one of the tables has more rows than its limit; None if there are none."""
    ones = [rows.select(*case, *[F.lit(int(i == k)).alias(f"_n{i}") for i in range(len(sides))]) for k, (rows, _) in enumerate(sides)]
    known = reduce(Column.__and__, [F.col(c).isNotNull() for c in case])
    counts = reduce(DataFrame.unionByName, ones).where(known).groupBy(*case).agg(*[F.sum(f"_n{i}").alias(f"_n{i}") for i in range(len(sides))])
    over = reduce(Column.__or__, [F.col(f"_n{i}") > limit for i, (_, limit) in enumerate(sides)])
    found = checkpoint(counts.where(over).select(*case))
    return None if found.isEmpty() else found


def by_size(large: DataFrame | None, tables: list[DataFrame], inside: Callable[..., DataFrame], across: Callable[..., DataFrame]) -> DataFrame:
    """``inside`` of the tables' cases of bounded size together with ``across`` of the large ones."""
    if large is None:
        return inside(*tables)
    rest = inside(*[rows.join(large, large.columns, "left_anti") for rows in tables])
    return rest.unionByName(across(*[rows.join(large, large.columns, "left_semi") for rows in tables]))


def nearest_segment(points: DataFrame, segments: DataFrame, case: str, point_id: list[str]) -> DataFrame:
    """Exact distance of every point to the nearest segment of its case; null in a case without segments.

    In cases of bounded size each point meets the segments of its case inside the task that holds the case, so only points
    and segments are shuffled; larger cases go through the pyramid of cells.
    """
    points, segments = points.select(case, *point_id, "px", "py"), segments.select(case, "sx", "sy", "ex", "ey")
    large = large_cases([(points, MOST_POINTS), (segments, MOST_SHAPES)], case)
    if large is None:
        return _nearest_in_case(points, segments, case, point_id)
    rest = _nearest_in_case(*[rows.join(large, case, "left_anti") for rows in (points, segments)], case, point_id)
    points, segments = (rows.join(large, case, "left_semi") for rows in (points, segments))
    found = _nearest_by_levels(points, segments, case, point_id)
    same = F.lit(True)
    for k in (case, *point_id):
        same = same & F.col(f"p.{k}").eqNullSafe(F.col(f"f.{k}"))
    kept = points.select(case, *point_id).distinct().alias("p").join(found.alias("f"), same, "left")
    return rest.unionByName(kept.select(*[F.col(f"p.{k}").alias(k) for k in (case, *point_id)], "f.distance"))


def _nearest_in_case(points: DataFrame, segments: DataFrame, case: str, point_id: list[str]) -> DataFrame:
    """Nearest segment among all of a case: the join and the minimum share the shuffle by case, pairs are never written."""
    wx, wy = _way(*[F.col(c) for c in ("px", "py", "sx", "sy", "ex", "ey")])
    pairs = points.join(segments.hint("merge"), case, "left")
    return pairs.groupBy(case, *point_id).agg(F.sqrt(F.min(wx * wx + wy * wy)).alias("distance"))


def nearest_ids(points: DataFrame, segments: DataFrame, case: str, point_id: list[str], segment_id: str, tie: float) -> DataFrame:
    """``nearest`` of every point: the sorted ids of all segments of its case that are at most ``tie`` farther than its ``distance``.

    ``distance`` is that of :func:`nearest_segment`.  Points meet segments as there: in the task of a case of bounded size, else in cells,
    which hold the nearest segment and those as near.
    """
    points, segments = points.select(case, *point_id, "px", "py", "distance"), segments.select(case, segment_id, "sx", "sy", "ex", "ey")
    known, far = [*point_id, "distance"], segment_distance(*[F.col(c) for c in ("px", "py", "sx", "sy", "ex", "ey")])

    def gathered(pairs: DataFrame) -> DataFrame:
        near = pairs.where(far <= F.col("distance") + tie)
        return near.groupBy(case, *point_id).agg(F.array_sort(F.collect_set(segment_id)).alias("nearest"))

    def inside(points: DataFrame, segments: DataFrame) -> DataFrame:
        return gathered(points.join(segments.hint("merge"), case))

    def across(points: DataFrame, segments: DataFrame) -> DataFrame:
        return gathered(_pairs_by_levels(points, segments, case, known))

    return by_size(large_cases([(points, MOST_POINTS), (segments, MOST_SHAPES)], case), [points, segments], inside, across)


def _nearest_by_levels(points: DataFrame, segments: DataFrame, case: str, point_id: list[str]) -> DataFrame:
    distance = segment_distance(F.col("px"), F.col("py"), F.col("sx"), F.col("sy"), F.col("ex"), F.col("ey"))
    return _pairs_by_levels(points, segments, case, point_id).groupBy(case, *point_id).agg(F.min(distance).alias("distance"))


def _pairs_by_levels(points: DataFrame, segments: DataFrame, case: str, point_id: list[str]) -> DataFrame:
    """Points with candidates for their nearest segments, which come with all their columns, through a pyramid of cells.

    Cells double in size per level and a case gets as many levels as its segment count asks for.
    Long segments are cut, so each piece touches few cells of every level.  A point first finds the
    smallest level whose 3x3 cells around it hold anything; its nearest segment then lies within
    2*sqrt(2) of that cell size, so the 3x3 cells two levels up must contain it.  At the top level
    the 3x3 cells cover the whole case, so no point is left over.
    """
    whole = [c for c in segments.columns if c != case]
    boxes = segments.select(case, F.least("sx", "ex").alias("x0"), F.least("sy", "ey").alias("y0"), F.greatest("sx", "ex").alias("x1"), F.greatest("sy", "ey").alias("y1"), F.lit(1).alias("seg"))
    boxes = boxes.unionByName(points.select(case, F.col("px").alias("x0"), F.col("py").alias("y0"), F.col("px").alias("x1"), F.col("py").alias("y1"), F.lit(0).alias("seg")))
    frame = boxes.groupBy(case).agg(
        F.min("x0").alias("_x"), F.min("y0").alias("_y"),
        F.greatest(F.max("x1") - F.min("x0"), F.max("y1") - F.min("y0"), F.lit(1e-9)).alias("_extent"),
        (F.ceil(F.log2(F.sqrt(F.sum("seg").cast("double") + 1))) + 1).cast("int").alias("_top"),
    )
    finest = F.col("_extent") / F.pow(F.lit(2.0), F.col("_top"))

    def size_of(level):
        return F.col("_extent") / F.pow(F.lit(2.0), F.col("_top") - level)

    cuts = F.greatest(F.lit(1), F.ceil(F.hypot(F.col("ex") - F.col("sx"), F.col("ey") - F.col("sy")) / (2 * finest))).cast("int")
    pieces = segments.join(frame, case).withColumn("_k", cuts).withColumn("_i", F.explode(F.sequence(F.lit(0), F.col("_k") - 1)))

    def along(start, end, i):
        return F.col(start) + (F.col(end) - F.col(start)) * (i / F.col("_k"))

    i = F.col("_i")
    ax, ay, bx, by = along("sx", "ex", i), along("sy", "ey", i), along("sx", "ex", i + 1), along("sy", "ey", i + 1)
    pieces = pieces.select(
        case, *whole, "_x", "_y", "_extent", "_top",
        F.least(ax, bx).alias("_x0"), F.least(ay, by).alias("_y0"), F.greatest(ax, bx).alias("_x1"), F.greatest(ay, by).alias("_y1"),
        F.explode(F.sequence(F.lit(0), F.col("_top") + 2)).alias("_level"),
    ).withColumn("_size", size_of(F.col("_level")))
    s = F.col("_size")
    spread = pieces.withColumn(
        "_cell",
        F.explode(cells_of_box(F.col("_x0") - F.col("_x"), F.col("_y0") - F.col("_y"), F.col("_x1") - F.col("_x"), F.col("_y1") - F.col("_y"), s)),
    ).select(case, "_level", "_cell", *whole)

    def around(cell):
        steps = [(dx, dy) for dx in (-1, 0, 1) for dy in (-1, 0, 1)]
        return F.explode(F.array(*[F.struct((cell["cx"] + dx).alias("cx"), (cell["cy"] + dy).alias("cy")) for dx, dy in steps]))

    # Cells are made distinct before they are copied to their neighbours: coarse levels hold few.
    occupied = spread.select(case, "_level", "_cell").distinct().select(case, "_level", around(F.col("_cell")).alias("_cell")).distinct()

    def own_cell(level):
        s = size_of(level)
        return F.struct(F.floor((F.col("px") - F.col("_x")) / s).alias("cx"), F.floor((F.col("py") - F.col("_y")) / s).alias("cy"))

    placed = points.select(case, *point_id, "px", "py").join(frame, case)
    levels = placed.withColumn("_level", F.explode(F.sequence(F.lit(0), F.col("_top"))))
    found = (
        levels.withColumn("_cell", own_cell(F.col("_level")))
        .join(occupied, [case, "_level", "_cell"], "left_semi")
        .groupBy(case, *point_id, "px", "py", "_x", "_y", "_extent", "_top")
        .agg(F.min("_level").alias("_level"))
    )
    looked = found.withColumn("_level", F.col("_level") + 2).withColumn("_own", own_cell(F.col("_level")))
    looked = looked.select(case, *point_id, "px", "py", "_level", around(F.col("_own")).alias("_cell"))
    return looked.join(spread, [case, "_level", "_cell"])


def components(edges: DataFrame, nodes: DataFrame, node: str = "node", a: str = "a", b: str = "b") -> DataFrame:
    """Smallest member of each node's component.

    Every round offers each neighbour's label to a node and to the node's current root, keeps the
    minimum (which combines on the map side) and then jumps to the label of that label, so the rounds
    grow with the logarithm of the diameter.  A round is written to the shared checkpoint folder.
    """
    both = checkpoint(
        edges.select(F.col(a).alias("_u"), F.col(b).alias("_v"))
        .unionByName(edges.select(F.col(b).alias("_u"), F.col(a).alias("_v")))
        .where("_u <> _v")
        .distinct()
    )
    labels = checkpoint(nodes.select(F.col(node).alias("_u"), F.col(node).alias("_l")).distinct())
    while True:
        other = labels.select(F.col("_u").alias("_v"), F.col("_l").alias("_o"))
        ends = both.join(labels, "_u").join(other, "_v").where("_o < _l").select(F.explode(F.array("_u", "_l")).alias("_u"), F.col("_o").alias("_l"))
        offers = ends.unionByName(labels).groupBy("_u").agg(F.min("_l").alias("_m"))
        jump = labels.select(F.col("_u").alias("_m"), F.col("_l").alias("_j"))
        fresh = offers.join(jump, "_m").select("_u", F.least("_m", "_j").alias("_n"))
        fresh = checkpoint(fresh.join(labels, "_u").select("_u", F.col("_n").alias("_l"), (F.col("_n") < F.col("_l")).alias("_moved")))
        labels = fresh.select("_u", "_l")
        if fresh.where("_moved").isEmpty():
            return labels.select(F.col("_u").alias(node), F.col("_l").alias("component"))


def star_edges(df: DataFrame, key: list[str], node: str) -> DataFrame:
    """Members of an equality group tied to their smallest member instead of to each other."""
    hub = df.groupBy(*key).agg(F.min(node).alias("a"))
    return df.join(hub, key).where(F.col(node) != F.col("a")).select("a", F.col(node).alias("b"))


def hamming_bands(signature: Column, limit: int, bits: int = 64) -> Column:
    """Bits of every two of ``limit + 2`` ranges of a signature; two signatures within ``limit`` bits agree on one entry at least."""
    width = -(-bits // (limit + 2))
    pieces = []
    for i in range(limit + 2):
        take = max(0, min(width, bits - i * width))
        pieces.append(F.shiftrightunsigned(signature, i * width).bitwiseAND(F.lit((1 << take) - 1)))
    both = [F.shiftleft(one, width).bitwiseOR(other) for one, other in combinations(pieces, 2)]
    return F.array(*[F.struct(F.lit(i).alias("band"), value.alias("bits")) for i, value in enumerate(both)])


def hamming_neighbours(df: DataFrame, node: str, signature: str, limit: int, extra: Column | None = None) -> DataFrame:
    """Pairs of distinct signatures within ``limit`` bits.

    Signatures meet where two of their ranges agree: a key of about a third of the bits (at four of 64) keeps the pairs that are
    compared few in tables of any size.
    Equal signatures are reduced to one representative first, so a hot signature yields no pairs of
    its own copies; tie those with :func:`star_edges`.
    """
    rows = df.withColumn("_band", F.explode(hamming_bands(F.col(signature), limit)))
    left, right = rows.alias("l"), rows.alias("r")
    xor = F.col(f"l.{signature}").bitwiseXOR(F.col(f"r.{signature}"))
    same_band = (F.col("l._band") == F.col("r._band")) & (F.col(f"l.{node}") < F.col(f"r.{node}"))
    # A pair counts at its first common band, so no duplicates need removing.
    earlier = F.exists(
        F.arrays_zip(hamming_bands(F.col(f"l.{signature}"), limit), hamming_bands(F.col(f"r.{signature}"), limit)),
        lambda z: (z["0"] == z["1"]) & (z["0"]["band"] < F.col("l._band.band")),
    )
    near = (F.bit_count(xor) <= limit) & ~earlier
    if extra is not None:
        near = near & extra
    return left.join(right, same_band).where(near).select(
        F.col(f"l.{node}").alias("a"), F.col(f"r.{node}").alias("b"), F.bit_count(xor).alias("distance")
    )
