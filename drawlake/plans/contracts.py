"""Registered queries: contracts over whole rings, refinement gate and acceptance."""

from pyspark.sql import functions as F

from drawlake.operators import compare
from drawlake.plans.certify import BOX, boxes
from drawlake.plans.geometry import GATE, NEXT
from drawlake.plans.registry import query

# How far a certified tangent may turn, in degrees, and how far its ends may lie apart.
TANGENT_DEGREES, ENDPOINT_GAP = 1e-7, 1e-7
TURN = "degrees(atan2((ex - sx) * (ney - nsy) - (ey - sy) * (nex - nsx), (ex - sx) * (nex - nsx) + (ey - sy) * (ney - nsy)))"
JOINED = f"sqrt(pow(nsx - ex, 2) + pow(nsy - ey, 2)) <= {ENDPOINT_GAP}"


@query(
    "tangent_checks",
    f"""SELECT case_id, count(*) AS joints, count(*) FILTER (abs({TURN}) < 90) AS forward, count(*) FILTER ({JOINED}) AS joined, count(*) FILTER ({JOINED} AND abs({TURN}) <= {TANGENT_DEGREES}) AS smooth,
       bool_and({JOINED} AND abs({TURN}) <= {TANGENT_DEGREES}) AS passed FROM ({NEXT}) q GROUP BY case_id""",
)
def tangent_checks(t):
    """Joints of a ring whose ends meet and whose directions agree; a case passes when all its joints do."""
    dx, dy, nx, ny = F.col("ex") - F.col("sx"), F.col("ey") - F.col("sy"), F.col("n_ex") - F.col("n_sx"), F.col("n_ey") - F.col("n_sy")
    turn = F.abs(F.degrees(F.atan2(dx * ny - dy * nx, dx * nx + dy * ny)))
    joined = F.hypot(F.col("n_sx") - F.col("ex"), F.col("n_sy") - F.col("ey")) <= ENDPOINT_GAP
    smooth = joined & (turn <= TANGENT_DEGREES)
    return compare.ring_next(t("reference_lines")).groupBy("case_id").agg(
        F.count("*").alias("joints"), F.count_if(turn < 90).alias("forward"), F.count_if(joined).alias("joined"), F.count_if(smooth).alias("smooth"), F.bool_and(smooth).alias("passed")
    )


@query(
    "reconstruction_contract",
    """SELECT case_id, concat_ws(',', CASE WHEN count(*) < 32 THEN 'missing_entities' END, CASE WHEN max(degree) > 2 THEN 'branched_joint' END, CASE WHEN min(degree) < 2 THEN 'open_joint' END,
       CASE WHEN min(length) < 3 THEN 'short_entity' END) AS reasons, count(*) AS ends FROM (SELECT a.case_id, a.ord, a.length, (SELECT count(*) FROM (
       SELECT case_id, round(sx, 4) AS x, round(sy, 4) AS y FROM {predicted_lines} UNION ALL SELECT case_id, round(ex, 4), round(ey, 4) FROM {predicted_lines}) e
       WHERE e.case_id = a.case_id AND e.x = round(a.sx, 4) AND e.y = round(a.sy, 4)) AS degree FROM {predicted_lines} a) q GROUP BY case_id""",
)
def reconstruction_contract(t):
    """Ordered reasons a ring is refused: missing entities, branched or open joints, short entities."""
    lines = t("predicted_lines")
    ends = lines.select("case_id", F.explode(F.array(
        F.struct(F.round("sx", 4).alias("x"), F.round("sy", 4).alias("y")), F.struct(F.round("ex", 4).alias("x"), F.round("ey", 4).alias("y")),
    )).alias("p"))
    degree = ends.groupBy("case_id", "p.x", "p.y").agg(F.count("*").alias("degree"))
    rows = lines.select("case_id", "length", F.round("sx", 4).alias("x"), F.round("sy", 4).alias("y")).join(degree, ["case_id", "x", "y"])
    reasons = F.concat_ws(
        ",", F.when(F.count("*") < 32, "missing_entities"), F.when(F.max("degree") > 2, "branched_joint"), F.when(F.min("degree") < 2, "open_joint"), F.when(F.min("length") < 3, "short_entity")
    )
    return rows.groupBy("case_id").agg(reasons.alias("reasons"), F.count("*").alias("ends"))


@query(
    "target_acceptance",
    f"""SELECT r.case_id, r.n = p.n AS same_count, coalesce(m.n, 0) = r.n AS all_matched, round(coalesce(m.n, 0) / r.n, 6) AS matched_share FROM (SELECT case_id, count(*) AS n FROM {{reference_lines}} GROUP BY 1) r
       JOIN (SELECT case_id, count(*) AS n FROM {{predicted_lines}} GROUP BY 1) p USING (case_id) LEFT JOIN (SELECT case_id, count(DISTINCT r) AS n FROM ({GATE}) g GROUP BY 1) m USING (case_id)""",
)
def target_acceptance(t):
    ref, pred = t("reference_lines"), t("predicted_lines")
    matched = compare.full_matches(pred, ref, 0.1).groupBy("case_id").agg(F.count_distinct("r").alias("m"))
    rows = ref.groupBy("case_id").agg(F.count("*").alias("n")).join(pred.groupBy("case_id").agg(F.count("*").alias("k")), "case_id").join(matched, "case_id", "left")
    m = F.coalesce("m", F.lit(0))
    return rows.select("case_id", (F.col("n") == F.col("k")).alias("same_count"), (m == F.col("n")).alias("all_matched"), F.round(m / F.col("n"), 6).alias("matched_share"))


FUSED = """SELECT mask_id, raw, fused, strong FROM (SELECT mask_id, coarse >= 0.5 AS raw, 0.75 * coarse + 0.25 * detail >= 0.5 AS fused, coarse >= 0.8 AS strong FROM (
  SELECT mask_id, CASE WHEN p = 1 THEN CASE WHEN (x + y) % 9 = 0 THEN 0.6 ELSE 0.9 END ELSE 0.3 END AS coarse, t * 1.0 AS detail FROM (
  SELECT mask_id, x, y, max(p) AS p, max(t) AS t FROM (SELECT mask_id, x, y, 1 AS p, 0 AS t FROM {mask_pixels} UNION ALL SELECT mask_id, x, y, 0, 1 FROM {target_pixels}) u GROUP BY 1, 2, 3) c) d) e"""


@query(
    "refinement_gate",
    f"""SELECT mask_id, count(*) FILTER (raw <> fused) AS changed_pixels, concat_ws(',', CASE WHEN count(*) FILTER (raw <> fused) > 0.04 * greatest(1, count(*) FILTER (raw)) THEN 'changes_too_much' END,
       CASE WHEN count(*) FILTER (strong AND NOT fused) > greatest(4, 0.002 * count(*) FILTER (raw)) THEN 'removes_confident_foreground' END, CASE WHEN NOT bool_or(fused) THEN 'erases_material' END) AS reasons FROM ({FUSED}) q GROUP BY mask_id""",
)
def refinement_gate(t):
    """Pixel gates of the 75/25 probability fusion: share changed, confident removals, erased material."""
    both = t("mask_pixels").select("mask_id", "x", "y", F.lit(1).alias("p"), F.lit(0).alias("t")).unionByName(t("target_pixels").select("mask_id", "x", "y", F.lit(0).alias("p"), F.lit(1).alias("t")))
    cells = both.groupBy("mask_id", "x", "y").agg(F.max("p").alias("p"), F.max("t").alias("t"))
    coarse = F.when(F.col("p") == 1, F.when((F.col("x") + F.col("y")) % 9 == 0, 0.6).otherwise(0.9)).otherwise(0.3)
    rows = cells.select("mask_id", (coarse >= 0.5).alias("raw"), (0.75 * coarse + 0.25 * F.col("t") >= 0.5).alias("fused"), (coarse >= 0.8).alias("strong"))
    raw, changed = F.count_if("raw"), F.count_if(F.col("raw") != F.col("fused"))
    removed = F.count_if(F.col("strong") & ~F.col("fused"))
    reasons = F.concat_ws(
        ",", F.when(changed > 0.04 * F.greatest(F.lit(1), raw), "changes_too_much"), F.when(removed > F.greatest(F.lit(4.0), 0.002 * raw), "removes_confident_foreground"),
        F.when(~F.bool_or("fused"), "erases_material"),
    )
    return rows.groupBy("mask_id").agg(changed.alias("changed_pixels"), reasons.alias("reasons"))


def ray_sql(gap: float) -> str:
    """Entry and exit per axis; an axis along which the shaft does not move only asks that it lies inside."""
    near = " , ".join(f"CASE WHEN abs(v{a}) < 1e-10 THEN 0 ELSE least(({a}0 - c{a}) / v{a}, ({a}1 - c{a}) / v{a}) END" for a in "xy")
    far = " , ".join(f"CASE WHEN abs(v{a}) < 1e-10 THEN {gap} ELSE greatest(({a}0 - c{a}) / v{a}, ({a}1 - c{a}) / v{a}) END" for a in "xy")
    beside = " AND ".join(f"(abs(v{a}) >= 1e-10 OR c{a} BETWEEN {a}0 AND {a}1)" for a in "xy")
    return f"""SELECT record_id, round(enter, 6) + 0.0 AS entry FROM (SELECT record_id, greatest(0, {near}) AS enter, least({gap}, {far}) AS leave
       FROM ({BOX}) b WHERE {beside}) q WHERE leave >= enter"""


def ray_entry(rows, gap: float):
    """``entry``, the way along (vx, vy) from (cx, cy) until the box (x0, y0, x1, y1) within ``gap``; rows that miss it go."""
    near, far = [], []
    for axis in "xy":
        at, speed, low, high = (F.col(c) for c in (f"c{axis}", f"v{axis}", f"{axis}0", f"{axis}1"))
        still = F.abs(speed) < 1e-10
        rows = rows.where(~still | at.between(low, high))
        ends = [F.try_divide(low - at, speed), F.try_divide(high - at, speed)]
        near.append(F.when(still, 0.0).otherwise(F.least(*ends)))
        far.append(F.when(still, gap).otherwise(F.greatest(*ends)))
    enter, leave = F.greatest(F.lit(0.0), *near), F.least(F.lit(gap), *far)
    return rows.where(leave >= enter).withColumn("entry", enter)


@query("label_ray_entry", ray_sql(2000.0))
def label_ray_entry(t, maximum_gap: float = 2000.0):
    """Length along a shaft until it enters its label's box, where it enters at all."""
    rows = boxes(t).withColumns({"vx": F.cos("angle"), "vy": F.sin("angle")})
    return ray_entry(rows, maximum_gap).select("record_id", F.round("entry", 6).alias("entry"))
