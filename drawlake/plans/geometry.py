"""Registered queries: curve geometry, comparison and certification of rings and arcs."""

import math

from pyspark.sql import functions as F

from drawlake.operators import compare, quantiles, report
from drawlake.plans.registry import query
from drawlake.session import checkpoint

STEP = 4.0


def r6(name, alias=None):
    return F.round(name, 6).alias(alias or name)


def samples_sql(source):
    return f"""SELECT case_id, ord, i AS sample, sx + (i / (n - 1)) * (ex - sx) AS px, sy + (i / (n - 1)) * (ey - sy) AS py FROM (
      SELECT *, unnest(range(0, n)) AS i FROM (SELECT *, CAST(greatest(2, ceil(length / 4.0) + 1) AS BIGINT) AS n FROM {source}) c) s"""


def directed_sql(source, target):
    """Brute force over every pair of one case."""
    return f"""SELECT p.case_id, p.ord, p.sample, min(sqrt(pow(px - sx - tt * (ex - sx), 2) + pow(py - sy - tt * (ey - sy), 2))) AS distance FROM (
      SELECT s.*, t.sx, t.sy, t.ex, t.ey, least(1.0, greatest(0.0, ((px - sx) * (ex - sx) + (py - sy) * (ey - sy)) / (pow(ex - sx, 2) + pow(ey - sy, 2)))) AS tt
      FROM ({samples_sql(source)}) s JOIN {target} t ON s.case_id = t.case_id) p GROUP BY 1, 2, 3"""


P2R, R2P = directed_sql("{predicted_lines}", "{reference_lines}"), directed_sql("{reference_lines}", "{predicted_lines}")


@query("sample_curve", f"SELECT case_id, ord, sample, round(px, 6) + 0.0 AS px, round(py, 6) + 0.0 AS py FROM ({samples_sql('{reference_lines}')}) q")
def sample_curve(t):
    return compare.sample_lines(t("reference_lines"), STEP).select("case_id", "ord", F.col("sample").cast("bigint").alias("sample"), r6("px"), r6("py"))


@query("point_curve_distance", f"SELECT case_id, ord, sample, round(distance, 6) + 0.0 AS distance FROM ({P2R}) q")
def point_curve_distance(t):
    rows = compare.directed(t("predicted_lines"), t("reference_lines"), STEP)
    return rows.select("case_id", "ord", F.col("sample").cast("bigint").alias("sample"), r6("distance"))


@query(
    "bidirectional_metrics",
    f"""SELECT d.case_id, round(max(distance), 6) + 0.0 AS max_error, round(quantile_cont(distance, 0.95), 6) + 0.0 AS p95_error, round(sqrt(avg(distance * distance)), 6) + 0.0 AS rms_error,
       round(max(distance) FILTER (side = 'p'), 6) + 0.0 AS prediction_max, round(max(distance) FILTER (side = 'r'), 6) + 0.0 AS reference_max, any_value(round(abs(pl - rl), 6)) + 0.0 AS length_error,
       max(distance) + 2 <= 2.5 AND any_value(abs(pl - rl) <= greatest(5.0, 0.001 * rl)) AS within
       FROM (SELECT *, 'p' AS side FROM ({P2R}) a UNION ALL SELECT *, 'r' AS side FROM ({R2P}) b) d
       JOIN (SELECT case_id, sum(length) AS pl FROM {{predicted_lines}} GROUP BY 1) p ON p.case_id = d.case_id
       JOIN (SELECT case_id, sum(length) AS rl FROM {{reference_lines}} GROUP BY 1) r ON r.case_id = d.case_id GROUP BY d.case_id""",
)
def bidirectional_metrics(t):
    """Maximum, 95th percentile and RMS over both directed distance sets, with the length check."""
    pred, ref = t("predicted_lines"), t("reference_lines")
    both = compare.directed(pred, ref, STEP).select("case_id", "distance", F.lit("p").alias("side")).unionByName(
        compare.directed(ref, pred, STEP).select("case_id", "distance", F.lit("r").alias("side"))
    )
    both = checkpoint(both)  # three aggregates read the distances; compute them once
    stats = both.groupBy("case_id").agg(
        F.max("distance").alias("max_error"), F.sqrt(F.avg(F.col("distance") * F.col("distance"))).alias("rms_error"),
        F.max(F.when(F.col("side") == "p", F.col("distance"))).alias("prediction_max"),
        F.max(F.when(F.col("side") == "r", F.col("distance"))).alias("reference_max"),
    )
    tail = quantiles.group_quantiles(both, ["case_id"], "distance", {"p95_error": 0.95}).select("case_id", "p95_error")
    lengths = pred.groupBy("case_id").agg(F.sum("length").alias("pl")).join(ref.groupBy("case_id").agg(F.sum("length").alias("rl")), "case_id")
    rows = stats.join(tail, "case_id").join(lengths, "case_id").withColumn("length_error", F.abs(F.col("pl") - F.col("rl")))
    within = (F.col("max_error") + STEP / 2 <= 2.5) & (F.col("length_error") <= F.greatest(F.lit(5.0), 0.001 * F.col("rl")))
    return rows.select(
        "case_id", r6("max_error"), r6("p95_error"), r6("rms_error"), r6("prediction_max"), r6("reference_max"), r6("length_error"), within.alias("within")
    )


@query(
    "unaligned_compare",
    f"""SELECT case_id, round(max(distance), 6) + 0.0 AS core_max, round(sqrt(avg(distance * distance)), 6) + 0.0 AS core_rms, count(*) AS core_samples
       FROM ({R2P}) q WHERE ord % 8 <> 0 GROUP BY case_id""",
)
def unaligned_compare(t):
    """Reference coverage without its assumed closure layers; extra prediction is not penalised here."""
    core = t("reference_lines").where("layer <> 'GT_CLOSURE'")
    return compare.directed(core, t("predicted_lines"), STEP).groupBy("case_id").agg(
        F.round(F.max("distance"), 6).alias("core_max"), F.round(F.sqrt(F.avg(F.col("distance") * F.col("distance"))), 6).alias("core_rms"), F.count("*").alias("core_samples")
    )


def curve_errors(t):
    return compare.directed(t("predicted_lines"), t("reference_lines"), STEP).groupBy("case_id", "ord").agg(
        F.round(F.max("distance"), 6).alias("max_error"), F.round(F.sqrt(F.avg(F.col("distance") * F.col("distance"))), 6).alias("rms_error"), F.count("*").alias("samples")
    )


BOTH = "SELECT 'prediction' AS side, * FROM ({p}) p UNION ALL SELECT 'reference' AS side, * FROM ({r}) r"
LINES = BOTH.format(p="SELECT case_id, ord, layer, sx, sy, ex, ey FROM {predicted_lines}", r="SELECT case_id, ord, layer, sx, sy, ex, ey FROM {reference_lines}")


@query(
    "error_localization",
    f"""WITH c AS ({LINES}), d AS (SELECT d.*, layer FROM ({BOTH.format(p=P2R, r=R2P)}) d JOIN c USING (side, case_id, ord)),
       l AS (SELECT case_id, side, 'curve' AS level, ord, layer AS name, distance FROM d UNION ALL SELECT case_id, side, 'layer', NULL, layer, distance FROM d WHERE side = 'reference'
         UNION ALL SELECT case_id, side, 'scope', NULL, CASE WHEN layer = 'GT_CLOSURE' THEN 'reference_assumptions' ELSE 'reference_core' END, distance FROM d WHERE side = 'reference'),
       e AS (SELECT case_id, side, level, ord, name, max(distance) AS max_error, quantile_cont(distance, 0.95) AS p95_error, sqrt(avg(distance * distance)) AS rms_error, count(*) AS samples FROM l GROUP BY 1, 2, 3, 4, 5),
       k AS (SELECT case_id, side, ord, max_error, row_number() OVER (PARTITION BY case_id, side ORDER BY round(max_error, 6) DESC, ord) AS place FROM e WHERE level = 'curve'),
       w AS (SELECT d.case_id, d.side, d.ord, min(sample) AS sample FROM d JOIN k ON k.case_id = d.case_id AND k.side = d.side AND k.ord = d.ord AND distance >= max_error - 1e-8 GROUP BY 1, 2, 3),
       p AS (SELECT w.case_id, w.side, w.ord, px, py FROM w JOIN ({BOTH.format(p=samples_sql('{predicted_lines}'), r=samples_sql('{reference_lines}'))}) s USING (case_id, side, ord, sample)),
       q AS (SELECT *, sqrt(pow(px - sx - tt * (ex - sx), 2) + pow(py - sy - tt * (ey - sy), 2)) AS far FROM (
         SELECT p.*, c.ord AS target, sx, sy, ex, ey, least(1.0, greatest(0.0, ((px - sx) * (ex - sx) + (py - sy) * (ey - sy)) / (pow(ex - sx, 2) + pow(ey - sy, 2)))) AS tt FROM p JOIN c ON c.case_id = p.case_id AND c.side <> p.side) u),
       n AS (SELECT case_id, side, ord, any_value(px) AS px, any_value(py) AS py, string_agg(CAST(target AS VARCHAR), ',' ORDER BY target) AS nearest FROM (
         SELECT *, min(far) OVER (PARTITION BY case_id, side, ord) AS least FROM q) v WHERE far <= least + 1e-8 GROUP BY 1, 2, 3)
       SELECT e.case_id, e.side, e.level, e.ord, e.name, round(e.max_error, 6) + 0.0 AS max_error, round(p95_error, 6) + 0.0 AS p95_error, round(rms_error, 6) + 0.0 AS rms_error, samples,
         round(px, 6) + 0.0 AS worst_x, round(py, 6) + 0.0 AS worst_y, nearest, CASE WHEN place <= 5 THEN place END AS worst_rank
       FROM e LEFT JOIN k ON k.case_id = e.case_id AND k.side = e.side AND k.ord = e.ord LEFT JOIN n ON n.case_id = e.case_id AND n.side = e.side AND n.ord = e.ord""",
)
def error_localization(t):
    """Errors of curves of both sides, and of layers and scopes of the reference; worst points with all curves nearest to them, and the five worst curves."""
    rows = compare.localized(t("predicted_lines"), t("reference_lines"), STEP, F.col("layer") == "GT_CLOSURE")
    nearest = F.array_join(F.transform("nearest", lambda x: x.cast("string")), ",")
    return rows.select(
        "case_id", "side", "level", "ord", "name", r6("max_error"), r6("p95_error"), r6("rms_error"), "samples",
        *[(F.round(c, 6) + F.lit(0.0)).alias(c) for c in ("worst_x", "worst_y")], nearest.alias("nearest"), F.col("worst_rank").cast("long").alias("worst_rank"),
    )


@query(
    "worst_curves",
    f"""SELECT case_id, ord, rank FROM (SELECT case_id, ord, row_number() OVER (PARTITION BY case_id ORDER BY round(max(distance), 6) DESC, ord) AS rank
       FROM ({P2R}) q GROUP BY case_id, ord) w WHERE rank <= 5""",
)
def worst_curves(t):
    rows = curve_errors(t)
    return report.top_per_group(rows, ["case_id"], [F.col("max_error").desc(), F.col("ord").asc()], 5).select("case_id", "ord", "rank")


NEXT = "SELECT a.*, b.sx AS nsx, b.sy AS nsy, b.ex AS nex, b.ey AS ney FROM {reference_lines} a JOIN {reference_lines} b ON a.case_id = b.case_id AND b.ord = (a.ord + 1) % 32"


@query(
    "ring_next",
    f"""SELECT case_id, ord, round(sqrt(pow(nsx - ex, 2) + pow(nsy - ey, 2)), 6) AS gap,
       round(degrees(acos(greatest(-1.0, least(1.0, ((ex - sx) * (nex - nsx) + (ey - sy) * (ney - nsy)) / (sqrt(pow(ex - sx, 2) + pow(ey - sy, 2)) * sqrt(pow(nex - nsx, 2) + pow(ney - nsy, 2))))))), 5) AS turn FROM ({NEXT}) q""",
)
def ring_next(t):
    rows = compare.ring_next(t("reference_lines"))
    dx, dy, nx, ny = F.col("ex") - F.col("sx"), F.col("ey") - F.col("sy"), F.col("n_ex") - F.col("n_sx"), F.col("n_ey") - F.col("n_sy")
    cosine = (dx * nx + dy * ny) / (F.hypot(dx, dy) * F.hypot(nx, ny))
    turn = F.degrees(F.acos(F.greatest(F.lit(-1.0), F.least(F.lit(1.0), cosine))))
    return rows.select("case_id", "ord", F.round(F.hypot(F.col("n_sx") - F.col("ex"), F.col("n_sy") - F.col("ey")), 6).alias("gap"), F.round(turn, 5).alias("turn"))


@query(
    "axis_relations",
    """SELECT case_id, ord, CASE WHEN abs(ey - sy) / length <= sin(radians(5)) THEN 'horizontal' ELSE 'vertical' END AS relation FROM {reference_lines}
       WHERE abs(ey - sy) / length <= sin(radians(5)) OR abs(ex - sx) / length <= sin(radians(5))""",
)
def axis_relations(t):
    limit = math.sin(math.radians(5))
    flat, upright = F.abs(F.col("ey") - F.col("sy")) / F.col("length") <= limit, F.abs(F.col("ex") - F.col("sx")) / F.col("length") <= limit
    return t("reference_lines").select("case_id", "ord", F.when(flat, "horizontal").when(upright, "vertical").alias("relation")).where("relation is not null")


@query(
    "turn_angle",
    f"""SELECT case_id, max_by(ord, (turn, -ord)) AS start_ord FROM (SELECT case_id, ord,
       round(acos(greatest(-1.0, least(1.0, ((ex - sx) * (nex - nsx) + (ey - sy) * (ney - nsy)) / (sqrt(pow(ex - sx, 2) + pow(ey - sy, 2)) * sqrt(pow(nex - nsx, 2) + pow(ney - nsy, 2)))))), 9) AS turn FROM ({NEXT}) q) w GROUP BY case_id""",
)
def turn_angle(t):
    """Position of the sharpest corner of every ring."""
    rows = compare.ring_next(t("reference_lines"))
    dx, dy, nx, ny = F.col("ex") - F.col("sx"), F.col("ey") - F.col("sy"), F.col("n_ex") - F.col("n_sx"), F.col("n_ey") - F.col("n_sy")
    turn = F.round(F.acos(F.greatest(F.lit(-1.0), F.least(F.lit(1.0), (dx * nx + dy * ny) / (F.hypot(dx, dy) * F.hypot(nx, ny))))), 9)
    return rows.groupBy("case_id").agg(F.max_by("ord", F.struct(turn, -F.col("ord"))).alias("start_ord"))


@query(
    "cycle_area",
    """SELECT case_id, round(sum(sx * ey - ex * sy) / 2, 6) + 0.0 AS signed_area, CASE WHEN sum(sx * ey - ex * sy) > 0 THEN 'ccw' ELSE 'cw' END AS orientation, count(*) AS edges
       FROM {reference_lines} GROUP BY case_id""",
)
def cycle_area(t):
    twice = F.sum(F.col("sx") * F.col("ey") - F.col("ex") * F.col("sy"))
    return t("reference_lines").groupBy("case_id").agg(
        F.round(twice / 2, 6).alias("signed_area"), F.when(twice > 0, "ccw").otherwise("cw").alias("orientation"), F.count("*").alias("edges")
    )


@query(
    "artifact_audit",
    """SELECT case_id, count(*) AS raw_count, count(*) FILTER (layer <> 'CONSTRUCTION') AS filtered_count, count(DISTINCT layer) AS layers,
       round(sum(length) FILTER (layer <> 'CONSTRUCTION'), 6) AS total_length, round(min(length), 6) AS shortest, round(max(length), 6) AS longest FROM {reference_lines} GROUP BY case_id""",
)
def artifact_audit(t):
    kept = F.col("layer") != "CONSTRUCTION"
    return t("reference_lines").groupBy("case_id").agg(
        F.count("*").alias("raw_count"), F.count_if(kept).alias("filtered_count"), F.count_distinct("layer").alias("layers"),
        F.round(F.sum(F.when(kept, F.col("length"))), 6).alias("total_length"), F.round(F.min("length"), 6).alias("shortest"), F.round(F.max("length"), 6).alias("longest"),
    )


@query("unit_factor", "SELECT case_id, ord, CASE unit_code WHEN 1 THEN 25.4 WHEN 4 THEN 1.0 END::DOUBLE AS factor, round(length * CASE unit_code WHEN 1 THEN 25.4 WHEN 4 THEN 1.0 END::DOUBLE, 6) AS length_mm FROM {reference_lines}")
def unit_factor(t):
    """Declared drawing unit to millimetres; an undeclared unit stays unknown."""
    # Unit codes and their millimetres.
    factors = {1: 25.4, 2: 304.8, 4: 1.0, 5: 10.0, 6: 1000.0}
    factor = F.coalesce(*[F.when(F.col("unit_code") == code, F.lit(mm)) for code, mm in factors.items()])
    return t("reference_lines").select("case_id", "ord", factor.alias("factor"), F.round(F.col("length") * factor, 6).alias("length_mm"))


@query(
    "endpoint_snap",
    """SELECT a.case_id, a.node, count(*) AS degree, min(b.node) AS joint FROM (SELECT case_id, ord * 2 AS node, sx AS x, sy AS y FROM {predicted_lines} UNION ALL SELECT case_id, ord * 2 + 1, ex, ey FROM {predicted_lines}) a
       JOIN (SELECT case_id, ord * 2 AS node, sx AS x, sy AS y FROM {predicted_lines} UNION ALL SELECT case_id, ord * 2 + 1, ex, ey FROM {predicted_lines}) b
       ON a.case_id = b.case_id AND sqrt(pow(a.x - b.x, 2) + pow(a.y - b.y, 2)) <= 0.00001 GROUP BY a.case_id, a.node""",
)
def endpoint_snap(t):
    return compare.endpoint_nodes(t("predicted_lines"), 1e-5).groupBy("case_id", "node").agg(F.count("*").alias("degree"), F.min("peer").alias("joint"))


GATE = """SELECT p.case_id, p.ord AS p, r.ord AS r FROM {predicted_lines} p JOIN {reference_lines} r ON p.case_id = r.case_id AND abs(p.length - r.length) <= 0.2 AND
  least(greatest(sqrt(pow(p.sx - r.sx, 2) + pow(p.sy - r.sy, 2)), sqrt(pow(p.ex - r.ex, 2) + pow(p.ey - r.ey, 2))),
  greatest(sqrt(pow(p.sx - r.ex, 2) + pow(p.sy - r.ey, 2)), sqrt(pow(p.ex - r.sx, 2) + pow(p.ey - r.sy, 2)))) <= 0.1"""


@query(
    "primitive_correspondence",
    f"""SELECT l.case_id, l.ord, CASE WHEN n = 1 AND m = 1 THEN 'unique_full_parameter_agreement' WHEN n >= 1 THEN 'ambiguous_multiple_full_candidates' ELSE 'unmatched_geometry' END AS status,
       CASE WHEN n = 1 AND m = 1 THEN r END AS reference_ord FROM {{predicted_lines}} l LEFT JOIN (
       SELECT case_id, p, max(n) AS n, max(m) AS m, min(r) AS r FROM (SELECT *, count(*) OVER (PARTITION BY case_id, p) AS n, count(*) OVER (PARTITION BY case_id, r) AS m FROM ({GATE}) g) w GROUP BY 1, 2) q
       ON q.case_id = l.case_id AND q.p = l.ord""",
)
def primitive_correspondence(t):
    pred = t("predicted_lines")
    pairs = compare.mutual_unique(compare.full_matches(pred, t("reference_lines"), 0.1), ["case_id"], "p", "r")
    per = pairs.groupBy("case_id", F.col("p").alias("ord")).agg(F.max("right_count").alias("n"), F.max("left_count").alias("m"), F.min("r").alias("r"))
    sole = (F.col("n") == 1) & (F.col("m") == 1)
    status = F.when(sole, "unique_full_parameter_agreement").when(F.col("n") >= 1, "ambiguous_multiple_full_candidates").otherwise("unmatched_geometry")
    return pred.select("case_id", "ord").join(per, ["case_id", "ord"], "left").select("case_id", "ord", status.alias("status"), F.when(sole, F.col("r")).alias("reference_ord"))


@query("mutual_unique", f"SELECT case_id, p, r FROM (SELECT *, count(*) OVER (PARTITION BY case_id, p) AS n, count(*) OVER (PARTITION BY case_id, r) AS m FROM ({GATE}) g) w WHERE n = 1 AND m = 1")
def mutual_unique(t):
    pairs = compare.full_matches(t("predicted_lines"), t("reference_lines"), 0.1)
    return compare.mutual_unique(pairs, ["case_id"], "p", "r").where("left_count = 1 and right_count = 1").select("case_id", "p", "r")


SIDE = "({q}x - {p}x) * ({r}y - {p}y) - ({q}y - {p}y) * ({r}x - {p}x)"


def _side(p, q, r):
    return SIDE.format(p=p, q=q, r=r)


@query(
    "self_intersection",
    f"""SELECT a.case_id, a.ord AS first, b.ord AS second FROM {{reference_lines}} a JOIN {{reference_lines}} b ON a.case_id = b.case_id AND a.ord < b.ord
       WHERE ({_side('a.s', 'a.e', 'b.s')}) * ({_side('a.s', 'a.e', 'b.e')}) < 0 AND ({_side('b.s', 'b.e', 'a.s')}) * ({_side('b.s', 'b.e', 'a.e')}) < 0""",
)
def self_intersection(t):
    return compare.crossings(t("reference_lines"), 8.0)


@query(
    "run_diff",
    """SELECT b.case_id, round(c.total - b.total, 6) + 0.0 AS length_delta, CASE WHEN b.case_id % 7 <> 0 THEN c.n - b.n END AS entity_delta FROM (SELECT case_id, sum(length) AS total, count(*) AS n FROM {reference_lines} GROUP BY 1) b
       JOIN (SELECT case_id, sum(length) AS total, count(*) AS n FROM {predicted_lines} GROUP BY 1) c USING (case_id)""",
)
def run_diff(t):
    """Deltas between two runs, shown only where both used the same reference."""
    def totals(rows, name):
        return rows.groupBy("case_id").agg(F.sum("length").alias(f"{name}_total"), F.count("*").alias(f"{name}_n"))

    rows = totals(t("reference_lines"), "b").join(totals(t("predicted_lines"), "c"), "case_id")
    same = F.col("case_id") % 7 != 0
    return rows.select("case_id", F.round(F.col("c_total") - F.col("b_total"), 6).alias("length_delta"), F.when(same, F.col("c_n") - F.col("b_n")).alias("entity_delta"))


# The eight signed axis permutations.
D4 = [
    ("identity", 1, 0, 0, 1), ("quarter_turn", 0, -1, 1, 0), ("half_turn", -1, 0, 0, -1), ("three_quarter_turn", 0, 1, -1, 0),
    ("reflect_x", -1, 0, 0, 1), ("reflect_y", 1, 0, 0, -1), ("swap_axes", 0, 1, 1, 0), ("swap_and_reflect", 0, -1, -1, 0),
]
D4_SQL = "(VALUES " + ", ".join(str(row) for row in D4) + ") AS m(axis_name, a, b, c, d)"


@query("d4_transform", f"SELECT case_id, ord, axis_name, round(a * sx + b * sy + 10, 6) + 0.0 AS x, round(c * sx + d * sy - 3, 6) + 0.0 AS y FROM {{reference_lines}} CROSS JOIN {D4_SQL}")
def d4_transform(t):
    images = F.array(*[F.struct(F.lit(n).alias("axis_name"), *[F.lit(v).alias(k) for k, v in zip("abcd", m)]) for n, *m in D4])
    rows = t("reference_lines").withColumn("m", F.explode(images))
    return rows.select(
        "case_id", "ord", "m.axis_name", F.round(F.col("m.a") * F.col("sx") + F.col("m.b") * F.col("sy") + 10, 6).alias("x"),
        F.round(F.col("m.c") * F.col("sx") + F.col("m.d") * F.col("sy") - 3, 6).alias("y"),
    )


ARC_BOX = """SELECT entity_id, case_id, min(x) AS x0, min(y) AS y0, max(x) AS x1, max(y) AS y1 FROM (
  SELECT entity_id, case_id, cx + radius * cos(th) AS x, cy + radius * sin(th) AS y FROM (SELECT *, unnest([angle, angle + sweep]) AS th FROM {arcs}) a
  UNION ALL SELECT entity_id, case_id, cx + radius * cos(th), cy + radius * sin(th) FROM (SELECT *, unnest([0, pi() / 2, pi(), 3 * pi() / 2]) AS th FROM {arcs}) b
  WHERE (th - angle) - floor((th - angle) / (2 * pi())) * 2 * pi() <= sweep + 1e-10) p GROUP BY 1, 2"""


def arc_box():
    """Bounds of an arc: its ends and the cardinal points inside its sweep, as array columns."""
    cardinal = F.filter(
        F.array(*[F.lit(k * math.pi / 2) for k in range(4)]),
        lambda th: F.pmod(th - F.col("angle"), F.lit(2 * math.pi)) <= F.col("sweep") + 1e-10,
    )
    angles = F.concat(F.array(F.col("angle"), F.col("angle") + F.col("sweep")), cardinal)
    xs = F.transform(angles, lambda th: F.col("cx") + F.col("radius") * F.cos(th))
    ys = F.transform(angles, lambda th: F.col("cy") + F.col("radius") * F.sin(th))
    return {"x0": F.array_min(xs), "y0": F.array_min(ys), "x1": F.array_max(xs), "y1": F.array_max(ys)}


@query("curve_bbox", f"SELECT case_id, round(min(x0), 6) + 0.0 AS x0, round(min(y0), 6) + 0.0 AS y0, round(max(x1), 6) + 0.0 AS x1, round(max(y1), 6) + 0.0 AS y1 FROM ({ARC_BOX}) q GROUP BY case_id")
def curve_bbox(t):
    rows = t("arcs").withColumns(arc_box())
    return rows.groupBy("case_id").agg(*[F.round(f(c), 6).alias(c) for c, f in (("x0", F.min), ("y0", F.min), ("x1", F.max), ("y1", F.max))])


@query(
    "normalise_display",
    """SELECT l.case_id, ord, round((sx - cx) / side, 6) + 0.0 AS x, round((sy - cy) / side, 6) + 0.0 AS y FROM {reference_lines} l JOIN (
       SELECT case_id, (min(least(sx, ex)) + max(greatest(sx, ex))) / 2 AS cx, (min(least(sy, ey)) + max(greatest(sy, ey))) / 2 AS cy,
       greatest(max(greatest(sx, ex)) - min(least(sx, ex)), max(greatest(sy, ey)) - min(least(sy, ey))) AS side FROM {reference_lines} GROUP BY 1) b USING (case_id)""",
)
def normalise_display(t):
    rows = t("reference_lines")
    x0, x1, y0, y1 = F.min(F.least("sx", "ex")), F.max(F.greatest("sx", "ex")), F.min(F.least("sy", "ey")), F.max(F.greatest("sy", "ey"))
    box = rows.groupBy("case_id").agg(((x0 + x1) / 2).alias("cx"), ((y0 + y1) / 2).alias("cy"), F.greatest(x1 - x0, y1 - y0).alias("side"))
    return rows.join(box, "case_id").select("case_id", "ord", F.round((F.col("sx") - F.col("cx")) / F.col("side"), 6).alias("x"), F.round((F.col("sy") - F.col("cy")) / F.col("side"), 6).alias("y"))
