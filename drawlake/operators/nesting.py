"""Rings within rings: containers by ray parity, nesting depth, material and holes."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from drawlake.operators.spatial import MOST_SHAPES, by_size, cells_of_box, large_cases
from drawlake.session import checkpoint

#: A field of an edge or a ring by its name.
Fields = Callable[[str], Column]


def ring_facts(edges: DataFrame, *more: Column) -> DataFrame:
    """``(case_id, ring, area, px, py)``: absolute area of every closed ring and one of its corners; ``more`` are further aggregates."""
    twice = F.sum(F.col("sx") * F.col("ey") - F.col("ex") * F.col("sy"))
    corner = F.min(F.struct("sx", "sy"))
    rows = edges.groupBy("case_id", "ring").agg((F.abs(twice) / 2).alias("area"), corner.alias("_p"), *more)
    return rows.withColumns({"px": F.col("_p.sx"), "py": F.col("_p.sy")}).drop("_p")


def _sized(edges: DataFrame) -> DataFrame:
    """A cell's size by case: its extent over the root of its number of edges."""
    extent = F.greatest(F.max(F.greatest("sx", "ex")) - F.min(F.least("sx", "ex")), F.max(F.greatest("sy", "ey")) - F.min(F.least("sy", "ey")), F.lit(1e-9))
    return edges.groupBy("case_id").agg((extent / F.sqrt(F.count("*").cast("double"))).alias("_size"))


def touching(edges: DataFrame) -> DataFrame:
    """``(case_id, a, b)``: pairs of rings that cross, touch or share a stretch.

    In cases of bounded size the edges meet in the task that holds the case, in larger ones in the cells that both touch.
    """
    large = large_cases([(edges, MOST_SHAPES)], "case_id")
    if large is None:
        return _touching(edges.withColumn("_cell", F.lit(0)), ["case_id"])
    few, many = (edges.join(large, "case_id", how) for how in ("left_anti", "left_semi"))
    return _touching(few.withColumn("_cell", F.lit(0)), ["case_id"]).unionByName(_touching(_in_cells(many), ["case_id", "_cell"]))


def _in_cells(edges: DataFrame) -> DataFrame:
    sized = edges.join(_sized(edges), "case_id")
    return sized.withColumn("_cell", F.explode(cells_of_box(F.least("sx", "ex"), F.least("sy", "ey"), F.greatest("sx", "ex"), F.greatest("sy", "ey"), F.col("_size"))))


def _meet(a: Fields, b: Fields) -> Column:
    """Whether two edges cross, touch or share a stretch."""
    side = lambda p, q, x, y: (p("ex") - p("sx")) * (q(y) - p("sy")) - (p("ey") - p("sy")) * (q(x) - p("sx"))
    apart = (side(a, b, "sx", "sy") * side(a, b, "ex", "ey") > 0) | (side(b, a, "sx", "sy") * side(b, a, "ex", "ey") > 0)
    boxes = F.lit(True)
    for x, y in (("sx", "ex"), ("sy", "ey")):
        boxes = boxes & (F.least(a(x), a(y)) <= F.greatest(b(x), b(y))) & (F.least(b(x), b(y)) <= F.greatest(a(x), a(y)))
    return boxes & ~apart


def _crossed(corner: Fields, edge: Fields) -> Column:
    """Whether the way from a corner to the right meets an edge."""
    met = (edge("sy") > corner("py")) != (edge("ey") > corner("py"))
    at = edge("sx") + (corner("py") - edge("sy")) / (edge("ey") - edge("sy")) * (edge("ex") - edge("sx"))
    return met & (at > corner("px"))


def _touching(placed: DataFrame, keys: list[str]) -> DataFrame:
    a, b, c = placed.alias("a"), placed.alias("b"), F.col
    on = c("a.ring") < c("b.ring")
    for k in keys:
        on = on & (c(f"a.{k}") == c(f"b.{k}"))
    meet = _meet(lambda n: c(f"a.{n}"), lambda n: c(f"b.{n}"))
    return a.join(b, on).where(meet).select(c("a.case_id").alias("case_id"), c("a.ring").alias("a"), c("b.ring").alias("b")).distinct()


def containers(edges: DataFrame, facts: DataFrame) -> DataFrame:
    """``(case_id, ring, outer, outer_area)``: every ring with all rings around it.

    A corner of each ring looks to the right; an odd number of edges of another ring in its way means inside.  In cases of bounded
    size corner and edges meet in the task that holds the case; in larger ones they meet by horizontal band, so only edges
    at the corner's height are paired with it.  Rings that do not touch are inside with all their corners or with none.
    """
    area = facts.select("case_id", F.col("ring").alias("outer"), F.col("area").alias("outer_area"))

    def by_case(edges: DataFrame, facts: DataFrame) -> DataFrame:
        corners = facts.select("case_id", "ring", "px", "py")
        return _inside(corners.join(edges.where("sy <> ey").withColumnRenamed("ring", "outer").hint("merge"), "case_id"))

    large = large_cases([(edges, MOST_SHAPES)], "case_id")
    if large is None:
        return by_case(edges, facts).join(area, ["case_id", "outer"]).select("case_id", "ring", "outer", "outer_area")
    (few, few_facts), (many, many_facts) = ([rows.join(large, "case_id", how) for rows in (edges, facts)] for how in ("left_anti", "left_semi"))
    inside = by_case(few, few_facts).unionByName(_inside_by_bands(many, many_facts))
    return inside.join(area, ["case_id", "outer"]).select("case_id", "ring", "outer", "outer_area")


def _inside_by_bands(edges: DataFrame, facts: DataFrame) -> DataFrame:
    sized = _sized(edges)
    band = lambda y: F.floor(F.col(y) / F.col("_size"))
    spread = edges.join(sized, "case_id").where("sy <> ey").withColumn("_band", F.explode(F.sequence(F.least(band("sy"), band("ey")), F.greatest(band("sy"), band("ey")))))
    spread = spread.select("case_id", "_band", F.col("ring").alias("outer"), "sx", "sy", "ex", "ey")
    corners = facts.join(sized, "case_id").withColumn("_band", band("py")).select("case_id", "_band", "ring", "px", "py")
    return _inside(corners.join(spread, ["case_id", "_band"]))


def _inside(pairs: DataFrame) -> DataFrame:
    """``(case_id, ring, outer, _hits)`` of pairs of a corner and an edge of a ring around it."""
    hits = pairs.where((F.col("ring") != F.col("outer")) & _crossed(F.col, F.col))
    return hits.groupBy("case_id", "ring", "outer").agg(F.count("*").alias("_hits")).where("_hits % 2 = 1")


def nesting(edges: DataFrame) -> DataFrame:
    """``(case_id, ring, area, parent, depth, role, net_area, ambiguous)`` of rings ``(case_id, ring, sx, sy, ex, ey)``.

    The parent is the smallest container, ties by id.  Rings around one ring lie in each other, so the depth is their number.
    Even depths are material, odd ones holes; ``net_area`` of material is its area without its direct holes and of a hole null.
    Cases in which rings touch or overlap are ``ambiguous``, and their rings have no parent, depth or role.

    Cases of bounded size are shuffled once and done in a row of their own; larger ones go through cells and bands.  Rings
    without a case are alone.
    """
    known = edges.where("case_id is not null")
    rows = by_size(large_cases([(known, MOST_SHAPES)], "case_id"), [known], _in_case, _across)
    alone = ring_facts(edges.where("case_id is null"))
    return rows.unionByName(alone.select(
        "case_id", "ring", "area", F.lit(None).cast(rows.schema["parent"].dataType).alias("parent"), F.lit(0).cast("long").alias("depth"),
        F.lit("material").alias("role"), F.col("area").alias("net_area"), F.lit(False).alias("ambiguous")))


def _in_case(edges: DataFrame) -> DataFrame:
    """Nesting of cases of bounded size: edges are gathered by ring and rings by case in the task that holds the case."""
    least, most = lambda x, y: F.min(F.least(x, y)), lambda x, y: F.max(F.greatest(x, y))
    box = [least("sx", "ex").alias("x0"), least("sy", "ey").alias("y0"), most("sx", "ex").alias("x1"), most("sy", "ey").alias("y1")]
    rings = ring_facts(edges.repartition("case_id"), *box, F.collect_list(F.struct("sx", "sy", "ex", "ey")).alias("edges"))
    cases = rings.groupBy("case_id").agg(F.collect_list(F.struct(*[c for c in rings.columns if c != "case_id"])).alias("rings"))

    def meet(a: Column, b: Column) -> Column:
        near = (a["x0"] <= b["x1"]) & (b["x0"] <= a["x1"]) & (a["y0"] <= b["y1"]) & (b["y0"] <= a["y1"])
        edge = F.exists(a["edges"], lambda e: F.exists(b["edges"], lambda f: _meet(e.getField, f.getField)))
        return (a["ring"] < b["ring"]) & near & edge

    def around(ring: Column) -> Column:
        def inside(other: Column) -> Column:
            hits = F.filter(other["edges"], lambda e: (e["sy"] != e["ey"]) & _crossed(ring.getField, e.getField))
            return (ring["ring"] != other["ring"]) & ring["py"].between(other["y0"], other["y1"]) & (F.size(hits) % 2 == 1)

        return F.transform(F.filter("rings", inside), lambda o: F.struct(o["area"].alias("area"), o["ring"].alias("ring")))

    unsure = F.coalesce(F.exists("rings", lambda a: F.exists("rings", lambda b: meet(a, b))), F.lit(False))
    # Each step is a column of its own row of the case, so that none is evaluated again for every ring.
    cases = cases.withColumn("ambiguous", unsure)
    found = F.transform("rings", lambda r: F.struct(r["ring"].alias("ring"), r["area"].alias("area"), F.when(~F.col("ambiguous"), around(r)).alias("around")))
    nested = F.transform(found, lambda r: F.struct(
        r["ring"].alias("ring"), r["area"].alias("area"), F.array_min(r["around"])["ring"].alias("parent"), F.size(r["around"]).cast("long").alias("_depth")))
    cases = cases.select("case_id", "ambiguous", nested.alias("rings"))

    def holes(ring: Column) -> Column:
        own = F.filter("rings", lambda h: (h["_depth"] % 2 == 1) & (h["parent"] == ring["ring"]))
        return F.aggregate(own, F.lit(0.0), lambda total, h: total + F.coalesce(h["area"], F.lit(0.0)))

    rows = cases.select("case_id", "ambiguous", F.explode(F.transform("rings", lambda r: F.struct(r.alias("r"), holes(r).alias("holes")))).alias("_row"))
    rows = rows.select("case_id", "_row.r.*", F.when(~F.col("ambiguous"), F.col("_row.r._depth")).alias("depth"), F.col("_row.holes").alias("_holes"), "ambiguous")
    role = F.when(F.col("depth") % 2 == 0, "material").when(F.col("depth") % 2 == 1, "hole")
    net = F.when(F.col("depth") % 2 == 0, F.col("area") - F.col("_holes"))
    return rows.select("case_id", "ring", "area", "parent", "depth", role.alias("role"), net.alias("net_area"), "ambiguous")


def _across(edges: DataFrame) -> DataFrame:
    facts = checkpoint(ring_facts(edges))
    unsure = checkpoint(touching(edges).select("case_id").distinct())
    around = containers(edges, facts).groupBy("case_id", "ring").agg(F.count("*").alias("depth"), F.min_by("outer", F.struct("outer_area", "outer")).alias("parent"))
    rows = facts.join(around, ["case_id", "ring"], "left").join(unsure.withColumn("ambiguous", F.lit(True)), "case_id", "left")
    sure = F.col("ambiguous").isNull()
    rows = rows.select("case_id", "ring", "area", F.when(sure, F.col("parent")).alias("parent"), F.when(sure, F.coalesce("depth", F.lit(0))).alias("depth"), (~sure).alias("ambiguous"))
    rows = checkpoint(rows.withColumn("role", F.when(F.col("depth") % 2 == 0, "material").when(F.col("depth") % 2 == 1, "hole")))
    holes = rows.where("role = 'hole'").groupBy("case_id", F.col("parent").alias("ring")).agg(F.sum("area").alias("_holes"))
    net = F.when(F.col("role") == "material", F.col("area") - F.coalesce("_holes", F.lit(0.0)))
    return rows.join(holes, ["case_id", "ring"], "left").select("case_id", "ring", "area", "parent", "depth", "role", net.alias("net_area"), "ambiguous")
