"""Binary masks as pixel tables: overlap, boundaries, components, holes and erosion."""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from drawlake.operators.quantiles import group_quantiles
from drawlake.operators.spatial import components, large_cases, nearest_segment
from drawlake.session import checkpoint

#: Runs of a mask up to which it is labelled in one task, and boundary pixels up to which two are compared in one.
MOST_RUNS, MOST_PIXELS = 16384, 8192


def overlap_counts(predicted: DataFrame, target: DataFrame) -> DataFrame:
    """Pixel counts of both masks and of their intersection, one row per mask."""
    both = predicted.select("mask_id", "x", "y", F.lit(1).alias("p"), F.lit(0).alias("t")).unionByName(
        target.select("mask_id", "x", "y", F.lit(0).alias("p"), F.lit(1).alias("t"))
    )
    cells = both.groupBy("mask_id", "x", "y").agg(F.max("p").alias("p"), F.max("t").alias("t"))
    return cells.groupBy("mask_id").agg(F.sum("p").alias("predicted"), F.sum("t").alias("target"), F.sum(F.col("p") * F.col("t")).alias("shared"))


def region_metrics(counts: DataFrame) -> DataFrame:
    """IoU, Dice, precision and recall with the empty-mask rules."""
    p, t, s = F.col("predicted"), F.col("target"), F.col("shared")
    union = p + t - s

    def ratio(part, whole, empty):
        return F.round(F.coalesce(F.try_divide(part, whole), empty), 6)

    return counts.select(
        "mask_id", "predicted", "target", "shared",
        ratio(s, union, F.lit(1.0)).alias("iou"), ratio(2 * s, p + t, F.lit(1.0)).alias("dice"),
        ratio(s, p, F.when(t == 0, 1.0).otherwise(0.0)).alias("precision"), ratio(s, t, F.when(p == 0, 1.0).otherwise(0.0)).alias("recall"),
    )


def with_empty(counts: DataFrame, dims: DataFrame) -> DataFrame:
    """Overlap counts of every mask of ``dims``; a mask without foreground on either side counts zero."""
    zero = [F.coalesce(c, F.lit(0)).alias(c) for c in ("predicted", "target", "shared")]
    return dims.select("mask_id").join(counts, "mask_id", "left").select("mask_id", *zero)


def empty_case(predicted: Column, target: Column) -> Column:
    return (
        F.when((predicted == 0) & (target == 0), "both_empty").when(predicted == 0, "empty_prediction")
        .when(target == 0, "empty_target").otherwise("none")
    )


def boundary_metrics(predicted: DataFrame, target: DataFrame, dims: DataFrame, tolerance: float = 3.0) -> DataFrame:
    """Boundary agreement within ``tolerance`` pixels, mean distance, Hausdorff distance and HD95 of every mask.

    Two empty masks agree with distance 0; with one empty mask the scores are 0 and the distances null.
    """
    p, r = checkpoint(boundary(predicted)), checkpoint(boundary(target))
    both = distances_both_ways(p, r)
    mean = both.groupBy("mask_id", "side").agg(F.avg("distance").alias("mean"), F.avg((F.col("distance") <= tolerance).cast("int")).alias("near"))
    tail = group_quantiles(both, ["mask_id", "side"], "distance", {"q": 0.95})
    side = F.col("side") == "f"
    found = mean.join(tail, ["mask_id", "side"]).groupBy("mask_id").agg(
        F.max(F.when(side, F.col("near"))).alias("bp"), F.max(F.when(~side, F.col("near"))).alias("br"),
        F.avg("mean").alias("assd"), F.max("maximum").alias("hausdorff"), F.max("q").alias("hd95"),
    )
    rows = with_empty(overlap_counts(predicted, target), dims).join(found, "mask_id", "left")
    case = empty_case(F.col("predicted"), F.col("target"))
    f1 = F.coalesce(F.try_divide(2 * F.col("bp") * F.col("br"), F.col("bp") + F.col("br")), F.lit(0.0))

    def ruled(value, both_empty, one_empty):
        return F.round(F.when(case == "both_empty", both_empty).when(case != "none", one_empty).otherwise(value), 6)

    none = F.lit(None).cast("double")
    return rows.select(
        "mask_id", *[ruled(v, F.lit(1.0), F.lit(0.0)).alias(n) for v, n in ((F.col("bp"), "boundary_precision"), (F.col("br"), "boundary_recall"), (f1, "boundary_f1"))],
        *[ruled(F.col(n), F.lit(0.0), none).alias(n) for n in ("assd", "hausdorff", "hd95")], case.alias("empty_case"),
    )


def neighbour_counts(pixels: DataFrame) -> DataFrame:
    """Every foreground pixel with the number of foreground pixels in its 3x3 square."""
    offsets = F.array(*[F.struct(F.lit(dx).alias("dx"), F.lit(dy).alias("dy")) for dx in (-1, 0, 1) for dy in (-1, 0, 1)])
    votes = pixels.select("mask_id", "x", "y", F.explode(offsets).alias("o")).select(
        "mask_id", (F.col("x") + F.col("o.dx")).alias("x"), (F.col("y") + F.col("o.dy")).alias("y"),
        ((F.col("o.dx") == 0) & (F.col("o.dy") == 0)).alias("own"),
    )
    return votes.groupBy("mask_id", "x", "y").agg(F.count("*").alias("n"), F.bool_or("own").alias("own")).where("own")


def boundary(pixels: DataFrame) -> DataFrame:
    return neighbour_counts(pixels).where("n < 9").select("mask_id", "x", "y")


def erode(pixels: DataFrame) -> DataFrame:
    return neighbour_counts(pixels).where("n = 9").select("mask_id", "x", "y")


def boundary_distances(source: DataFrame, target: DataFrame) -> DataFrame:
    """Distance of each boundary pixel to the nearest boundary pixel of the other mask."""
    points = source.select("mask_id", F.col("x").cast("double").alias("px"), F.col("y").cast("double").alias("py"))
    dots = target.select("mask_id", *[F.col(c).cast("double").alias(n) for c, n in (("x", "sx"), ("y", "sy"), ("x", "ex"), ("y", "ey"))])
    keyed = points.withColumns({"ix": F.col("px"), "iy": F.col("py")})
    return nearest_segment(keyed, dots, "mask_id", ["ix", "iy"])


def distances_both_ways(a: DataFrame, b: DataFrame) -> DataFrame:
    """``(mask_id, distance, side)``: side f from each pixel of ``a`` to the nearest of ``b``, side b the other way; none with one side empty.

    Masks of bounded size have their pixels in two lists, which are compared in the task that holds the row.
    """
    large = large_cases([(a, MOST_PIXELS), (b, MOST_PIXELS)], "mask_id")
    if large is None:
        return _distances_in_lists(a, b)
    few, many = ([rows.join(large, "mask_id", how) for rows in (a, b)] for how in ("left_anti", "left_semi"))
    far = boundary_distances(*many).select("mask_id", "distance", F.lit("f").alias("side")).unionByName(
        boundary_distances(*many[::-1]).select("mask_id", "distance", F.lit("b").alias("side"))
    ).where(F.col("distance").isNotNull())
    return _distances_in_lists(*few).unionByName(far)


def _distances_in_lists(a: DataFrame, b: DataFrame) -> DataFrame:
    def spots(column: pa.Array) -> list[np.ndarray]:
        flat = column.flatten()
        each = np.stack([np.asarray(flat.field(c), dtype=float) for c in ("x", "y")], axis=1)
        return np.split(each, np.cumsum(np.asarray(pc.list_value_length(column)))[:-1])

    def compare(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            there, back = [], []
            for p, q in zip(spots(batch.column("a")), spots(batch.column("b"))):
                nearest, rows = np.full(len(q), np.inf), []
                for part in np.array_split(p, -(-len(p) // 256)):  # a bounded piece of all pairs
                    square = (part[:, None, 0] - q[:, 0]) ** 2 + (part[:, None, 1] - q[:, 1]) ** 2
                    rows.append(square.min(1))
                    nearest = np.minimum(nearest, square.min(0))
                there.append(np.sqrt(np.concatenate(rows)))
                back.append(np.sqrt(nearest))
            lists = [pa.array(v, pa.list_(pa.float64())) for v in (there, back)]
            yield pa.RecordBatch.from_arrays([batch.column("mask_id"), *lists], ["mask_id", "f", "b"])

    lists = [p.groupBy("mask_id").agg(F.collect_list(F.struct("x", "y")).alias(n)) for p, n in ((a, "a"), (b, "b"))]
    kind = a.schema["mask_id"].dataType.simpleString()
    found = lists[0].join(lists[1], "mask_id").mapInArrow(compare, f"mask_id {kind}, f array<double>, b array<double>")
    sides = F.explode(F.array(*[F.struct(F.lit(n).alias("side"), F.col(n).alias("d")) for n in "fb"])).alias("s")
    return found.select("mask_id", sides).select("mask_id", F.explode("s.d").alias("distance"), F.col("s.side").alias("side"))


def runs(pixels: DataFrame) -> DataFrame:
    """Horizontal runs of foreground; a window never holds more than one image row."""
    row = Window.partitionBy("mask_id", "y").orderBy("x")
    islands = pixels.withColumn("_g", F.col("x") - F.row_number().over(row))
    return islands.groupBy("mask_id", "y", "_g").agg(F.min("x").alias("x0"), F.max("x").alias("x1"), F.count("*").alias("area")).drop("_g")


def background_runs(foreground: DataFrame, width: int, height: int) -> DataFrame:
    """Gaps between the runs of each row of the mask padded by one pixel."""
    rows = foreground.select("mask_id").distinct().select("mask_id", F.explode(F.sequence(F.lit(-1), F.lit(height))).alias("y"))
    full = foreground.select("mask_id", "y", "x0", "x1").unionByName(rows.select("mask_id", "y", F.lit(-2).alias("x0"), F.lit(-2).alias("x1")))
    full = full.unionByName(rows.select("mask_id", "y", F.lit(width + 1).alias("x0"), F.lit(width + 1).alias("x1")))
    order = Window.partitionBy("mask_id", "y").orderBy("x0")
    gaps = full.withColumn("_next", F.lead("x0").over(order)).where(F.col("_next") - F.col("x1") > 1)
    return gaps.select("mask_id", "y", (F.col("x1") + 1).alias("x0"), (F.col("_next") - 1).alias("x1"))


def run_edges(run_rows: DataFrame, kind: str, diagonal: bool) -> tuple[DataFrame, DataFrame]:
    """Nodes and edges of one adjacency; runs of neighbouring rows touch when their spans overlap."""
    reach = 1 if diagonal else 0
    node = F.struct(F.lit(kind).alias("kind"), "mask_id", "y", "x0")
    here = run_rows.select("mask_id", "y", "x0", "x1", node.alias("a"))
    below = run_rows.select("mask_id", (F.col("y") - 1).alias("y"), F.col("x0").alias("z0"), F.col("x1").alias("z1"), node.alias("b"))
    touching = here.join(below, ["mask_id", "y"]).where((F.col("x0") <= F.col("z1") + reach) & (F.col("z0") <= F.col("x1") + reach))
    return run_rows.select(node.alias("node")), touching.select("a", "b")


def in_lists(run_rows: DataFrame) -> DataFrame:
    """``(mask_id, runs)``: the runs of each mask in one row, in order; for masks of bounded size."""
    return run_rows.groupBy("mask_id").agg(F.array_sort(F.collect_list(F.struct(*[F.col(c).cast("long").alias(c) for c in ("y", "x0", "x1")]))).alias("runs"))


def roots(run_list: list[tuple[int, int, int]], reach: int) -> list[int]:
    """For each of the ordered runs ``(y, x0, x1)`` of a mask, the place of the first run of its component."""
    parent, by_row, starts = list(range(len(run_list))), {}, {}

    def find(i: int) -> int:
        while parent[i] != i:
            parent[i] = i = parent[parent[i]]
        return i

    def tie(i: int, k: int) -> None:
        i, k = find(i), find(k)
        parent[max(i, k)] = min(i, k)

    for i, (y, x0, _) in enumerate(run_list):
        by_row.setdefault(y, []).append(i)
        tie(starts.setdefault((y, x0), i), i)  # runs with one start are one node
    for y, row in by_row.items():
        below, first = by_row.get(y + 1, ()), 0
        for i in row:
            _, x0, x1 = run_list[i]
            while first < len(below) and run_list[below[first]][2] + reach < x0:
                first += 1
            for k in below[first:]:
                if run_list[k][1] > x1 + reach:
                    break
                if run_list[k][2] + reach >= x0:
                    tie(i, k)
    return [find(i) for i in range(len(run_list))]


def gaps(run_list: list[tuple[int, int, int]], width: int, height: int) -> list[tuple[int, int, int]]:
    """Background runs of a mask padded by one pixel, in order."""
    by_row = {}
    for y, x0, x1 in run_list:
        by_row.setdefault(y, []).append((x0, x1))
    found = []
    for y in sorted({*by_row, *range(-1, height + 1)}):
        edge = [(-2, -2), (width + 1, width + 1)] if -1 <= y <= height else []
        row = sorted(by_row.get(y, []) + edge)
        found += [(y, here[1] + 1, after[0] - 1) for here, after in zip(row, row[1:]) if after[0] - here[1] > 1]
    return found


def as_tuples(runs: pa.Array) -> list[list[tuple[int, int, int]]]:
    flat = runs.flatten()
    ends = np.cumsum([0, *pc.list_value_length(runs).to_pylist()])
    rows = list(zip(*[flat.field(c).to_pylist() for c in ("y", "x0", "x1")]))
    return [rows[i:k] for i, k in zip(ends, ends[1:])]


def topology(pixels: DataFrame, width: int, height: int) -> DataFrame:
    """Components under both adjacencies, holes and Euler numbers, one row per mask.

    Runs of a mask of bounded size are one list, which is labelled in the task that holds the row; the four labellings of
    larger masks share one component run, in which the adjacency is part of the node.
    """
    rows = checkpoint(runs(pixels))
    large = large_cases([(rows, MOST_RUNS)], "mask_id")
    if large is None:
        counts = _counts_in_lists(rows, width, height)
    else:
        few, many = (rows.join(large, "mask_id", how) for how in ("left_anti", "left_semi"))
        counts = _counts_in_lists(few, width, height).unionByName(_counts_by_rounds(many, width, height))
    # The padded border belongs to one background component, which is not a hole.
    out = counts.select("mask_id", F.col("f4").alias("components_4"), F.col("f8").alias("components_8"), (F.col("b8") - 1).alias("holes_4"), (F.col("b4") - 1).alias("holes_8"))
    return out.withColumns({
        "euler_4": F.col("components_4") - F.col("holes_4"), "euler_8": F.col("components_8") - F.col("holes_8"),
        "diagonal_contact": F.col("components_4") != F.col("components_8"),
    })


def _counts_in_lists(rows: DataFrame, width: int, height: int) -> DataFrame:
    def count(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = {"f4": [], "f8": [], "b4": [], "b8": []}
            for front in as_tuples(batch.column("runs")):
                back = gaps(front, width, height)
                for name, run_list, reach in (("f4", front, 0), ("f8", front, 1), ("b4", back, 0), ("b8", back, 1)):
                    found[name].append(len(set(roots(run_list, reach))))
            yield pa.RecordBatch.from_arrays([batch.column("mask_id"), *[pa.array(v, pa.int64()) for v in found.values()]], ["mask_id", *found])

    kind = rows.schema["mask_id"].dataType.simpleString()
    return in_lists(rows).mapInArrow(count, f"mask_id {kind}, f4 long, f8 long, b4 long, b8 long")


def _counts_by_rounds(rows: DataFrame, width: int, height: int) -> DataFrame:
    back = checkpoint(background_runs(rows, width, height))
    graphs = [run_edges(rows, "f4", False), run_edges(rows, "f8", True), run_edges(back, "b4", False), run_edges(back, "b8", True)]
    nodes, edges = graphs[0]
    for more_nodes, more_edges in graphs[1:]:
        nodes, edges = nodes.unionByName(more_nodes), edges.unionByName(more_edges)
    labelled = components(edges, nodes)
    return labelled.groupBy(F.col("node.mask_id").alias("mask_id")).agg(
        *[F.count_if((F.col("node.kind") == k) & (F.col("node") == F.col("component"))).alias(k) for k in ("f4", "f8", "b4", "b8")]
    )
