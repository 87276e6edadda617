"""Label-to-stroke association and the pixel scale independent dimensions agree on."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from drawlake.operators.spatial import MOST_POINTS, MOST_SHAPES, by_size, large_cases, point_in_range
from drawlake.session import checkpoint

# Association windows in label heights, span factors and the 3% ratio rule.
BELOW, ABOVE = 0.3, 1.3
AMBIGUITY = 0.25
SPREAD = 1.03
BIN = 16.0
MEMBER = ["record_id", "axis", "nominal", "lo", "hi", "cross_at", "pixels_per_mm"]


def _windowed(labels: DataFrame, strokes: DataFrame, finish: Callable[[DataFrame], DataFrame], finish_large: Callable[[DataFrame], DataFrame] | None = None) -> DataFrame:
    """``finish`` of the pairs of a label and a stroke in its window below and above.

    In cases of bounded size labels meet all strokes of their case in the task that holds it, so no row is copied into bins
    and what ``finish`` groups by case and record stays there; larger cases go through bins.
    """
    ranges = labels.withColumns(
        {"_lo": F.col("bottom") - BELOW * F.col("height"), "_hi": F.col("bottom") + ABOVE * F.col("height")}
    )

    def inside(left, right):
        pairs = left.join(right.hint("merge"), ["case_id", "axis"]).where(F.col("cross_at").between(F.col("_lo"), F.col("_hi")))
        return finish(pairs.drop("_lo", "_hi"))

    def across(left, right):
        return (finish_large or finish)(point_in_range(left, right, ["case_id", "axis"], "_lo", "_hi", "cross_at", BIN).drop("_lo", "_hi"))

    large = large_cases([(labels, MOST_POINTS), (strokes, MOST_SHAPES)], "case_id")
    return by_size(large, [ranges, strokes], inside, across)


def length_witnesses(labels: DataFrame, strokes: DataFrame) -> DataFrame:
    """Nearest stroke below each length label that spans the label's centre."""
    score = F.abs(F.col("cross_at") - F.col("bottom")) / F.col("height")
    best = F.min(F.struct(score.alias("distance"), "stroke_id", "lo", "hi", "cross_at", "span", "thickness"))

    def nearest(pairs):
        rows = pairs.where(F.col("center").between(F.col("lo"), F.col("hi")) & (F.col("span") >= 1.5 * F.greatest(F.lit(8.0), F.col("along"))))
        return rows.groupBy("case_id", "record_id", "axis", "nominal", "center", "along", "height").agg(best.alias("s"))

    return _windowed(labels, strokes, nearest).select("case_id", "record_id", "axis", "nominal", "center", "along", "height", "s.*").withColumn(
        "pixels_per_mm", (F.col("hi") - F.col("lo")) / F.col("nominal")
    )


def diameter_witnesses(labels: DataFrame, strokes: DataFrame) -> DataFrame:
    """Diameter labels allow some slack past the stroke and also weigh its span."""
    along = F.greatest(F.lit(8.0), F.col("along"))
    score = F.abs(F.col("cross_at") - F.col("bottom")) / F.col("height") + 0.15 * along / F.col("span")
    best = F.min(F.struct(score.alias("score"), "stroke_id", "lo", "hi", "cross_at"))

    def nearest(pairs):
        rows = pairs.where(F.col("center").between(F.col("lo") - 0.3 * along, F.col("hi") + 0.3 * along) & (F.col("span") >= 1.4 * along))
        return rows.groupBy("case_id", "record_id", "axis", "nominal").agg(best.alias("s"))

    return _windowed(labels, strokes, nearest).select("case_id", "record_id", "axis", "nominal", "s.*")


def split_chains(witnesses: DataFrame, crossings: DataFrame, labels: DataFrame | None = None) -> DataFrame:
    """Nearest crossing strictly before and strictly after the label cuts a chained stroke.

    ``labels``, from which the witnesses come, are counted in their place to find large cases.
    """
    margin = F.greatest(F.lit(3.0), 1.5 * F.col("thickness"))
    before = F.col("station") < F.col("center") - F.col("along") / 2 - margin
    after = F.col("station") > F.col("center") + F.col("along") / 2 + margin
    cuts = [F.max(F.when(before, F.struct("station", "v_thick"))).alias("b"), F.min(F.when(after, F.struct("station", "v_thick"))).alias("a")]
    reaches = F.col("cross_at").between(F.col("v_lo") - margin, F.col("v_hi") + margin) & (F.col("v_span") > 2 * F.col("height"))
    ranges = witnesses.withColumns({"_a": F.col("lo") - margin, "_b": F.col("hi") + margin})
    other = crossings.select(
        "case_id", F.col("cross_at").alias("station"), F.col("lo").alias("v_lo"), F.col("hi").alias("v_hi"),
        F.col("span").alias("v_span"), F.col("thickness").alias("v_thick"),
    )
    keys = [c for c in witnesses.columns if c in ("case_id", "record_id", "axis", "nominal", "center", "along", "height")]
    rest = [c for c in witnesses.columns if c not in keys]

    def inside(left, right):
        right = right.withColumnRenamed("case_id", "_case").hint("merge")
        near = (F.col("case_id") == F.col("_case")) & F.col("station").between(F.col("_a"), F.col("_b")) & reaches
        rows = left.join(right, near, "left").groupBy(*keys).agg(F.first(F.struct(*rest)).alias("_w"), *cuts)
        return rows.select(*keys, *[F.col(f"_w.{c}").alias(c) for c in rest], "b", "a")

    def across(left, right):
        hits = point_in_range(left, right, ["case_id"], "_a", "_b", "station", 64.0).where(reaches)
        cut = hits.groupBy("case_id", "record_id", "axis").agg(*cuts)
        return left.select(*keys, *rest).join(cut, ["case_id", "record_id", "axis"], "left").select(*keys, *rest, "b", "a")

    large = large_cases([(witnesses if labels is None else labels, MOST_POINTS), (crossings, MOST_SHAPES)], "case_id")
    rows = by_size(large, [ranges, other], inside, across).select(*witnesses.columns, "a", "b")

    def moved(end, side):
        far = F.abs(F.col(end) - F.col(f"{side}.station")) > 2 * F.greatest(margin, F.col(f"{side}.v_thick"))
        return F.when(far, F.col(f"{side}.station")).otherwise(F.col(end))

    return rows.withColumns({"seg_lo": moved("lo", "b"), "seg_hi": moved("hi", "a")}).drop("a", "b")


def tied_strokes(labels: DataFrame, strokes: DataFrame) -> DataFrame:
    """Strokes in a label's window within the margin of its nearest one, flagged ambiguous when more than one is."""
    score = F.abs(F.col("cross_at") - F.col("bottom")) / F.col("height")
    record = Window.partitionBy("case_id", "record_id")

    def options(pairs):
        return pairs.select("case_id", "record_id", "stroke_id", score.alias("distance"))

    def inside(pairs):
        kept = options(pairs).withColumn("_best", F.min("distance").over(record)).where(F.col("distance") < F.col("_best") + AMBIGUITY)
        return kept.withColumn("ambiguous", F.count("*").over(record) > 1).drop("_best")

    return _windowed(labels, strokes, inside, lambda pairs: near_ties(options(pairs)))


def near_ties(options: DataFrame) -> DataFrame:
    """Options within the margin of a record's best stay, flagged ambiguous when more than one does."""
    best = options.groupBy("case_id", "record_id").agg(F.min("distance").alias("_best"))
    kept = options.join(best, ["case_id", "record_id"]).where(F.col("distance") < F.col("_best") + AMBIGUITY)
    counts = kept.groupBy("case_id", "record_id").agg((F.count("*") > 1).alias("ambiguous"))
    return kept.join(counts, ["case_id", "record_id"]).drop("_best")


def ratio_windows(witnesses: DataFrame, labels: DataFrame | None = None) -> DataFrame:
    """Every qualifying 3% window of a case.

    Windows start at each distinct scale of the case.  The windows of a case of bounded size are found in its row; larger cases
    go through logarithmic bins.  ``labels``, from which the witnesses come, are counted in their place to find large cases.
    """
    usable = witnesses.where((F.col("pixels_per_mm") > 0) & (F.col("pixels_per_mm") < float("inf"))).select(
        "case_id", *MEMBER)
    if labels is None:
        labels = usable = checkpoint(usable)
    return by_size(large_cases([(labels, MOST_SHAPES)], "case_id"), [usable], _windows_in_row, _windows_by_bins)


def _windows_in_row(usable: DataFrame) -> DataFrame:
    """The witnesses of a case are listed once; those of each of its windows are sent on only if they are enough."""
    listed = usable.where("case_id is not null").groupBy("case_id").agg(F.collect_list(F.struct(*MEMBER)).alias("_all"))
    scales = F.array_distinct(F.transform("_all", lambda w: w["pixels_per_mm"]))
    ratio = lambda w: w["pixels_per_mm"] / F.col("seed")
    group = listed.select("case_id", F.explode(scales).alias("seed"), "_all").select(
        "case_id", "seed", F.explode(F.array(F.filter("_all", lambda w: (ratio(w) >= 1) & (ratio(w) <= SPREAD)))).alias("_in")).where(F.size("_in") >= 3)
    distinct = lambda c: F.size(F.array_distinct(F.array_compact(F.transform("_in", lambda w: w[c])))).cast("long")
    group = group.withColumns({"distinct_dimensions": distinct("nominal"), "distinct_records": distinct("record_id")}).where("distinct_dimensions >= 3 and distinct_records >= 3")
    window = ["case_id", "seed", "distinct_dimensions", "distinct_records"]
    per_line = group.select(*window, F.inline("_in")).groupBy(*window, "axis", "lo", "hi", "cross_at").agg(
        F.median("pixels_per_mm").alias("vote"), F.min("pixels_per_mm").alias("low"), F.max("pixels_per_mm").alias("high"),
    )
    return per_line.groupBy(*window).agg(
        F.count("*").alias("distinct_lines"), F.median("vote").alias("pixels_per_mm"), F.min("low").alias("low"), F.max("high").alias("high"),
    ).where("distinct_lines >= 3")


def _windows_by_bins(usable: DataFrame) -> DataFrame:
    """Logarithmic bins as wide as a window put a member into its own and the previous bin, so a window only meets witnesses it
    can contain; the witnesses are written once."""
    usable = checkpoint(usable)
    step = F.log(F.lit(SPREAD))
    placed = usable.withColumn("_bin", F.floor(F.log("pixels_per_mm") / step))
    seeds = placed.select("case_id", F.col("pixels_per_mm").alias("seed"), "_bin").distinct()
    members = placed.select("case_id", "record_id", "axis", "nominal", "lo", "hi", "cross_at", "pixels_per_mm", F.explode(F.array(F.col("_bin"), F.col("_bin") - 1)).alias("_bin"))
    group = seeds.join(members, ["case_id", "_bin"]).where(F.col("pixels_per_mm") / F.col("seed") >= 1).where(
        F.col("pixels_per_mm") / F.col("seed") <= SPREAD
    )
    line = ["case_id", "seed", "axis", "lo", "hi", "cross_at"]
    per_line = group.groupBy(*line).agg(
        F.median("pixels_per_mm").alias("vote"), F.min("pixels_per_mm").alias("low"), F.max("pixels_per_mm").alias("high"),
    )
    shape = group.groupBy("case_id", "seed").agg(
        F.count_distinct("nominal").alias("distinct_dimensions"), F.count_distinct("record_id").alias("distinct_records")
    )
    lines = per_line.groupBy("case_id", "seed").agg(
        F.count("*").alias("distinct_lines"), F.median("vote").alias("pixels_per_mm"), F.min("low").alias("low"), F.max("high").alias("high"),
    )
    return lines.join(shape, ["case_id", "seed"]).where("distinct_dimensions >= 3 and distinct_records >= 3 and distinct_lines >= 3")


def scale_modes(windows: DataFrame) -> DataFrame:
    """Status per case: one mode resolves the scale, several that cannot share 3% are ambiguous.

    The strongest window is the first mode.  Any window that does not fit 3% together with it is
    evidence of another mode, which is all the status depends on.
    """
    order = F.struct(
        F.col("distinct_dimensions").alias("d"), F.col("distinct_lines").alias("l"),
        (-(F.col("high") / F.col("low") - 1)).alias("s"), (-F.col("seed")).alias("first"),
    )
    best = windows.groupBy("case_id").agg(
        F.max_by(F.struct("pixels_per_mm", "low", "high", "distinct_dimensions", "distinct_lines"), order).alias("m"),
        F.max("high").alias("highest"), F.min("low").alias("lowest"),
    )
    # No window spans more than 3%, so a rival shows in the outermost ends.
    rival = (F.col("highest") / F.col("m.low") > SPREAD) | (F.col("m.high") / F.col("lowest") > SPREAD)
    status = best.withColumn("rivals", rival.cast("int"))
    return status.select(
        "case_id", F.when(F.col("rivals") > 0, "ambiguous").otherwise("resolved").alias("status"),
        F.when(F.col("rivals") == 0, F.col("m.pixels_per_mm")).alias("pixels_per_mm"),
        "m.distinct_dimensions", "m.distinct_lines",
    )


def adjacent_stations(stations: DataFrame, keys: list[str], at: str) -> DataFrame:
    """Each station with the next one along its shaft."""
    order = Window.partitionBy(*keys).orderBy(at)
    return stations.withColumn("next_at", F.lead(at).over(order)).where("next_at is not null")
