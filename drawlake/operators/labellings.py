"""Two labellings of one mask against each other: what survives, goes, splits and joins; and parts that hang on thin necks."""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from drawlake.operators import masks
from drawlake.operators.spatial import components, large_cases
from drawlake.session import checkpoint

#: Pixels of a stretch of an image row in which runs of two labellings meet.
STRETCH = 64


def labelled(pixels: DataFrame, diagonal: bool = False) -> DataFrame:
    """``(mask_id, y, x0, x1, label)``: horizontal runs with the first run of their component.

    Masks of bounded size are labelled as one list, larger ones in rounds over all their runs.
    """
    rows = checkpoint(masks.runs(pixels))
    large = large_cases([(rows, masks.MOST_RUNS)], "mask_id")
    if large is None:
        return _labelled_in_lists(rows, diagonal)
    few, many = (rows.join(large, "mask_id", how) for how in ("left_anti", "left_semi"))
    return _labelled_in_lists(few, diagonal).unionByName(_labelled_by_rounds(many, diagonal))


def _labelled_in_lists(rows: DataFrame, diagonal: bool) -> DataFrame:
    def label(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            named = []
            for run_list in masks.as_tuples(batch.column("runs")):
                named.append([f"{run_list[i][0]}:{run_list[i][1]}" for i in masks.roots(run_list, int(diagonal))])
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(named, pa.list_(pa.string()))], ["mask_id", "runs", "labels"])

    kind = {c: rows.schema[c].dataType.simpleString() for c in ("mask_id", "y", "x0", "x1")}
    run = "array<struct<y:bigint,x0:bigint,x1:bigint>>"
    found = masks.in_lists(rows).mapInArrow(label, f"mask_id {kind['mask_id']}, runs {run}, labels array<string>")
    each = found.select("mask_id", F.explode(F.arrays_zip("runs", "labels")).alias("r"))
    return each.select("mask_id", *[F.col(f"r.runs.{c}").cast(kind[c]).alias(c) for c in ("y", "x0", "x1")], F.col("r.labels").alias("label"))


def _labelled_by_rounds(rows: DataFrame, diagonal: bool) -> DataFrame:
    nodes, edges = masks.run_edges(rows, "c", diagonal)
    found = components(edges, nodes)
    name = F.concat_ws(":", F.col("component.y").cast("string"), F.col("component.x0").cast("string"))
    return found.select("node.mask_id", "node.y", "node.x0", name.alias("label")).join(rows, ["mask_id", "y", "x0"]).select("mask_id", "y", "x0", "x1", "label")


def overlaps(a: DataFrame, b: DataFrame) -> DataFrame:
    """``(mask_id, a, b, pixels)``: labels of two labellings that share pixels.

    Runs meet by image row and stretch of it, so a row of any width pairs only runs that lie close; two runs count in the
    first stretch that both touch.
    """
    def cut(rows: DataFrame, p: str) -> DataFrame:
        at = F.explode(F.sequence(F.floor(F.col("x0") / STRETCH), F.floor(F.col("x1") / STRETCH))).alias("_at")
        return rows.select("mask_id", "y", F.col("x0").alias(f"{p}0"), F.col("x1").alias(f"{p}1"), F.col("label").alias(p), at)

    met = cut(a, "a").join(cut(b, "b"), ["mask_id", "y", "_at"]).where((F.col("a0") <= F.col("b1")) & (F.col("b0") <= F.col("a1")))
    met = met.where(F.col("_at") == F.floor(F.greatest("a0", "b0") / STRETCH))
    return met.groupBy("mask_id", "a", "b").agg(F.sum(F.least("a1", "b1") - F.greatest("a0", "b0") + 1).alias("pixels"))


def component_sets(before: DataFrame, after: DataFrame, diagonal: bool = False) -> DataFrame:
    """``(mask_id, before, after, survived, deleted, split, joined, created)``: numbers of components.

    A component before survives if it shares a pixel with one after, is deleted if it does not, and split if it does with several; a
    component after is joined if it shares pixels with several before, and created if with none.  Masks that are
    empty on one side have zeros there; masks empty on both give no row.
    """
    sides = [checkpoint(labelled(p, diagonal)) for p in (before, after)]
    pairs = checkpoint(overlaps(*sides))

    def counted(side: DataFrame, own: str, total: str, many: str, none: str) -> DataFrame:
        partners = pairs.groupBy("mask_id", F.col(own).alias("label")).agg(F.count("*").alias("n"))
        rows = side.select("mask_id", "label").distinct().join(partners, ["mask_id", "label"], "left")
        return rows.groupBy("mask_id").agg(F.count("*").alias(total), F.count_if(F.col("n") > 1).alias(many), F.count_if(F.col("n").isNull()).alias(none))

    rows = counted(sides[0], "a", "before", "split", "deleted").join(counted(sides[1], "b", "after", "joined", "created"), "mask_id", "full")
    zero = {c: F.coalesce(c, F.lit(0)) for c in ("before", "after", "split", "deleted", "joined", "created")}
    return rows.withColumns(zero).select("mask_id", "before", "after", (F.col("before") - F.col("deleted")).alias("survived"), "deleted", "split", "joined", "created")


def thin_necks(pixels: DataFrame, radius: int = 1, least: int = 1) -> DataFrame:
    """``(mask_id, cores, candidates, extra)``: components that fall apart if ``radius`` pixels are taken off their edge.

    Cores are the components (diagonals included) of the eroded mask with at least ``least`` pixels.  Components with several
    cores are candidates, and ``extra`` counts their cores beyond the first.
    """
    whole = checkpoint(labelled(pixels, True))
    eroded = pixels
    for _ in range(radius):
        eroded = checkpoint(masks.erode(eroded))
    cores = overlaps(labelled(eroded, True), whole).where(F.col("pixels") >= least)
    per = cores.groupBy("mask_id", "b").agg(F.count("*").alias("n"))
    rows = per.groupBy("mask_id").agg(F.sum("n").alias("cores"), F.count_if(F.col("n") > 1).alias("candidates"), F.sum(F.col("n") - 1).alias("extra"))
    zero = {c: F.coalesce(c, F.lit(0)) for c in ("cores", "candidates", "extra")}
    return whole.select("mask_id").distinct().join(rows, "mask_id", "left").withColumns(zero)


def refinement_reasons(before: DataFrame, after: DataFrame, width: int, height: int, most_changed: float = 0.04) -> DataFrame:
    """``(mask_id, changed, reasons)``: why a proposal ``after`` for the material ``before`` is refused; null if it is not.

    Components are checked one by one besides their numbers, since a split and a join may cancel out.
    """
    cells = before.select("mask_id", "x", "y", F.lit(1).alias("p"), F.lit(0).alias("q")).unionByName(after.select("mask_id", "x", "y", F.lit(0).alias("p"), F.lit(1).alias("q")))
    cells = cells.groupBy("mask_id", "x", "y").agg(F.max("p").alias("p"), F.max("q").alias("q"))
    pixels = cells.groupBy("mask_id").agg(F.count_if(F.col("p") != F.col("q")).alias("changed"), F.sum("p").alias("_raw"), F.sum("q").alias("_new"))
    sides = [masks.topology(p, width, height).select("mask_id", *[F.col(c).alias(f"{s}_{c}") for c in ("components_4", "components_8", "holes_8")]) for p, s in ((before, "b"), (after, "a"))]
    rows = pixels.join(component_sets(before, after), "mask_id", "left").join(sides[0], "mask_id", "left").join(sides[1], "mask_id", "left")
    n = lambda c: F.coalesce(c, F.lit(0))
    reasons = F.concat_ws(
        ",", F.when(n("deleted") > 0, "deletes_components"), F.when(F.col("changed") > most_changed * F.greatest(F.lit(1), "_raw"), "changes_too_much"),
        F.when((n("a_components_4") > n("b_components_4")) | (n("a_components_8") > n("b_components_8")), "introduces_disconnected_regions"),
        F.when(n("a_holes_8") != n("b_holes_8"), "changes_holes"), F.when(F.col("_new") == 0, "erases_material"), F.when(n("split") > 0, "splits_components"), F.when(n("joined") > 0, "joins_components"))
    return rows.select("mask_id", "changed", F.nullif(reasons, F.lit("")).alias("reasons"))
