"""Registration of two contours: axis orientation and translation, never scale."""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from drawlake.operators.curves import SHAPE, point_at
from drawlake.operators.prefix import running_total

#: The eight signed axis permutations ``(a, b, c, d)``: x' = a x + b y, y' = c x + d y.
TURNS = ((1, 0, 0, 1), (0, -1, 1, 0), (-1, 0, 0, -1), (0, 1, -1, 0), (-1, 0, 0, 1), (1, 0, 0, -1), (0, 1, 1, 0), (0, -1, -1, 0))
#: Samples of either contour, and rounds of alignment.
SAMPLES, ROUNDS = 32, 5
#: Cases that a task aligns at once.
ROWS = 2


def along(curves: DataFrame, samples: int) -> DataFrame:
    """``(case_id, i, x, y)``: ``samples`` points at equal steps along all curves of a case in the order of ``ord``.

    Running lengths come from ranges of curves, so a case of any size is dealt over many tasks and gives as many points.
    """
    run = running_total(curves.select("case_id", "ord", *SHAPE), ["case_id"], [F.col("ord").asc()], F.col("length")).where("_total > 0")
    run = run.withColumn("_gap", F.col("_total") / samples)
    place = lambda at: F.ceil(F.round(at / F.col("_gap"), 6))
    first, last = place(F.col("_before")), place(F.col("_before") + F.col("length")) - 1
    rows = run.where(first <= last).withColumn("i", F.explode(F.sequence(first, last)))
    x, y = point_at((F.col("i") * F.col("_gap") - F.col("_before")) / F.col("length"))
    return rows.select("case_id", "i", x.alias("x"), y.alias("y"))


def _listed(points: DataFrame, name: str) -> DataFrame:
    """The points of a contour in one row; their number is bounded by ``samples``."""
    return points.groupBy("case_id").agg(F.array_sort(F.collect_list(F.struct("i", "x", "y"))).alias(name))


def _nearest_ways(x: np.ndarray, y: np.ndarray, d: np.ndarray, axis: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Means of the ways with the least ``d`` along an axis, ties by x, then by y, and of their ``d``."""
    least = d.min(axis, keepdims=True)
    wx = np.where(d == least, x, np.inf)
    nx = wx.min(axis, keepdims=True)
    ny = np.where(wx == nx, y, np.inf).min(axis)
    return nx.squeeze(axis).mean(0), ny.mean(0), least.squeeze(axis).mean(0)


def _aligned(p: np.ndarray, r: np.ndarray, rounds: int, moves: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """``dx, dy, loss`` by (case, turn, start) of points ``(case, sample, 2)`` after all rounds."""
    p = np.einsum("kab,nsb->nksa", moves, p)
    middle, mean = lambda v: (v.min(-2) + v.max(-2)) / 2, lambda v: v.mean(-2)
    shift = [np.stack([f(r)[:, None, c] - f(p)[..., c] for f in (middle, mean)], axis=2) for c in (0, 1)]
    # Samples of both sides come first and jobs are one axis, so minima run over long stretches of jobs.
    shape = shift[0].shape
    shift = [v.ravel() for v in shift]
    gap = [np.repeat((r[..., c].T[None, :, :, None] - np.moveaxis(p[..., c], 2, 0)[:, None]).reshape(p.shape[2], r.shape[1], -1), 2, axis=2) for c in (0, 1)]
    for left in range(rounds, -1, -1):
        x, y = (gap[c] - shift[c] for c in (0, 1))
        d = x * x + y * y
        px, py, pd = _nearest_ways(x, y, d, 1)
        rx, ry, rd = _nearest_ways(-x, -y, d, 0)
        if left:
            shift = [shift[0] + (px - rx) / 2, shift[1] + (py - ry) / 2]
    return tuple(v.reshape(shape) for v in (*shift, (pd + rd) / 2))


def _points(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """First place of every list and all points."""
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    flat = column.flatten()
    size = np.asarray(pc.list_value_length(column))
    return np.concatenate([[0], np.cumsum(size)]), np.stack([np.asarray(flat.field(c)) for c in ("x", "y")], axis=1)


def register(predicted: DataFrame, reference: DataFrame, samples: int = SAMPLES, rounds: int = ROUNDS, turns: tuple = TURNS) -> DataFrame:
    """``(case_id, turn, start, dx, dy, loss)``: the best orientation and translation of each prediction onto its reference.

    Either contour is represented by ``samples`` points at equal steps of its length, whatever its number of curves.  Every
    orientation starts from the difference of box centres (start 0) and of centroids (start 1).  A round finds the nearest
    point on the other side for every sample, in either direction, and moves by the mean of both residuals, which is the
    least-squares translation for those neighbours; the mean squared distance of both directions never rises.  A case is one
    row of at most ``samples`` points a side, so all its rounds run in the task that holds the row and only points are
    shuffled.  The lowest loss after the last round wins, ties (to nine decimals) by orientation and start.  Cases
    with a contour on one side only, or without length, give no row.
    """
    both = _listed(along(predicted, samples), "p").join(_listed(along(reference, samples), "r"), "case_id")
    moves = np.array(turns, dtype=float).reshape(-1, 2, 2)
    jobs = len(moves) * 2

    def align(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start in range(0, batch.num_rows, ROWS):
                part = batch.slice(start, ROWS)
                (pa0, ps), (ra0, rs) = _points(part.column("p")), _points(part.column("r"))
                sizes = np.stack([np.diff(pa0), np.diff(ra0)], axis=1)
                found = np.empty((3, part.num_rows, len(moves), 2))
                for n, m in np.unique(sizes, axis=0):  # one pair of sizes, but for lengths that rounding moves
                    rows = np.flatnonzero((sizes == (n, m)).all(1))
                    found[:, rows] = _aligned(ps[pa0[rows, None] + np.arange(n)], rs[ra0[rows, None] + np.arange(m)], rounds, moves)
                turn, first = np.divmod(np.arange(part.num_rows * jobs) % jobs, 2)
                each = pa.StructArray.from_arrays([pa.array(turn.astype(np.int32)), pa.array(first.astype(np.int32)), *[pa.array(v.ravel()) for v in found]], ["turn", "start", "dx", "dy", "loss"])
                lists = pa.ListArray.from_arrays(pa.array(np.arange(part.num_rows + 1, dtype=np.int32) * np.int32(jobs)), each)
                yield pa.RecordBatch.from_arrays([part.column("case_id"), lists], ["case_id", "jobs"])

    kind = both.schema["case_id"].dataType.simpleString()
    rows = both.select("case_id", "p", "r").mapInArrow(align, f"case_id {kind}, jobs array<struct<turn:int,start:int,dx:double,dy:double,loss:double>>")
    best = F.array_min(F.transform("jobs", lambda j: F.struct(F.round(j["loss"], 9).alias("order"), *[j[c].alias(c) for c in ("turn", "start", "dx", "dy", "loss")])))
    return rows.select("case_id", best.alias("b")).select("case_id", "b.turn", "b.start", "b.dx", "b.dy", "b.loss")
