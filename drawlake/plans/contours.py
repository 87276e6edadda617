"""Registered queries: contours of lines and arcs, registration, nesting, leaders, paths and request pages."""

from pyspark.sql import functions as F

from drawlake.functions import usage
from drawlake.operators import compare, curves, leaders, nesting, pages, paths, register
from drawlake.plans.registry import define_input, query

STEP = 4.0

# Every fifth edge of a ring is an arc between the same ends; odd ones turn right.
define_input(
    "reference_curves",
    """SELECT case_id, ord, kind, sx, sy, ex, ey,
       CASE WHEN kind = 'ARC' THEN mx - (ey - sy) / chord * h END AS cx, CASE WHEN kind = 'ARC' THEN my + (ex - sx) / chord * h END AS cy,
       CASE WHEN kind = 'ARC' THEN r END AS radius,
       CASE WHEN kind = 'ARC' THEN atan2(sy - (my + (ex - sx) / chord * h), sx - (mx - (ey - sy) / chord * h)) END AS start_angle,
       CASE WHEN kind = 'ARC' THEN sweep END AS sweep, CASE WHEN kind = 'ARC' THEN r * abs(sweep) ELSE chord END AS length, layer FROM (
       SELECT *, chord / (2 * sin(abs(sweep) / 2)) AS r, chord / (2 * tan(abs(sweep) / 2)) * sign(sweep) AS h FROM (
       SELECT case_id, ord, layer, sx, sy, ex, ey, length AS chord, (sx + ex) / 2 AS mx, (sy + ey) / 2 AS my,
       CASE WHEN ord % 5 = 2 THEN 'ARC' ELSE 'LINE' END AS kind, (CASE WHEN ord % 2 = 0 THEN 1 ELSE -1 END) * (0.6e0 + 0.2e0 * (ord % 3)) AS sweep
       FROM {reference_lines}) AS a) AS b""",
)
define_input(
    "predicted_curves",
    """SELECT case_id, ord, kind, sx + dx AS sx, sy + dy AS sy, ex + dx AS ex, ey + dy AS ey, cx + dx AS cx, cy + dy AS cy, radius, start_angle, sweep, length
       FROM (SELECT *, CASE WHEN case_id % 2 = 0 THEN 0.03e0 ELSE 0.6e0 END AS dx, CASE WHEN case_id % 5 = 0 THEN 0.4e0 ELSE -0.02e0 END AS dy FROM {reference_curves}) AS r
       WHERE NOT (case_id % 3 = 0 AND ord = 0)""",
)
# A prediction in another orientation and place: turn number case_id % 8, then a shift.
define_input(
    "turned_curves",
    """SELECT r.case_id, ord, kind, a * sx + b * sy + tx AS sx, c * sx + d * sy + ty AS sy, a * ex + b * ey + tx AS ex, c * ex + d * ey + ty AS ey,
       a * cx + b * cy + tx AS cx, c * cx + d * cy + ty AS cy, radius, CASE WHEN kind = 'ARC' THEN atan2(c * (sx - cx) + d * (sy - cy), a * (sx - cx) + b * (sy - cy)) END AS start_angle,
       sweep * (a * d - b * c) AS sweep, length FROM (SELECT *, 40e0 + case_id % 17 AS tx, -25e0 - case_id % 11 AS ty FROM {reference_curves}) AS r
       JOIN (""" + " UNION ALL ".join(f"SELECT {k} AS turn, {a} AS a, {b} AS b, {c} AS c, {d} AS d" for k, (a, b, c, d) in enumerate(register.TURNS)) + """) AS m ON m.turn = r.case_id % 8""",
)
# Squares, mostly around one centre; equal ones overlap.
define_input(
    "nested_rings",
    """SELECT case_id, ring, x0 + h * ax AS sx, y0 + h * ay AS sy, x0 + h * bx AS ex, y0 + h * by_ AS ey FROM (
       SELECT l_orderkey AS case_id,
       concat(l_orderkey, '-', l_linenumber, '-', l_partkey, '-', l_suppkey, '-', CAST(round(l_extendedprice * 100) AS BIGINT)) AS ring,
       100e0 - 12e0 * l_linenumber + l_partkey % 5 * 0.5e0 AS h, CASE WHEN l_suppkey % 4 = 0 THEN 300e0 * l_linenumber ELSE 0e0 END AS x0,
       CASE WHEN l_suppkey % 4 = 1 THEN 3e0 ELSE 0e0 END AS y0 FROM {lineitem}) AS s
       JOIN (SELECT -1 AS ax, -1 AS ay, 1 AS bx, -1 AS by_ UNION ALL SELECT 1, -1, 1, 1 UNION ALL SELECT 1, 1, -1, 1 UNION ALL SELECT -1, 1, -1, -1) AS e ON e.ax IS NOT NULL""",
)
# Leader tips beside the ring, some far away; their labels stand a good way off.
define_input(
    "leader_tips",
    """SELECT case_id, case_id * 100 + ord AS record_id, CASE WHEN ord % 3 = 0 THEN 'radius' ELSE 'length' END AS kind,
       (sx + ex) / 2 + (CASE WHEN ord % 7 = 0 THEN 400e0 ELSE 1.5e0 END) AS px, (sy + ey) / 2 - ord % 5 AS py, ord % 2 = 0 AS arrowhead, 3e0 + ord % 4 AS grid
       FROM {reference_lines} WHERE ord % 3 <> 1""",
)
define_input(
    "leader_rays",
    """SELECT case_id, record_id, px + (CASE WHEN record_id % 5 = 0 THEN 0e0 ELSE 35e0 + record_id % 60 END) AS ax, py + (CASE WHEN record_id % 5 = 0 THEN 0e0 ELSE 20e0 - record_id % 41 END) AS ay,
       px AS tx, py AS ty, 4e0 + record_id % 3 AS band FROM {leader_tips}""",
)
# Copies of rings that start elsewhere or run backwards; some differ in one place.
define_input(
    "ring_copies",
    """SELECT case_id, 0 AS copy, ord, sx, sy, ex, ey FROM {reference_lines}
       UNION ALL SELECT case_id, 1 AS copy, (ord + case_id % 31 + 1) % 32 AS ord, CASE WHEN case_id % 7 = 0 AND ord = 5 THEN sx + 1 ELSE sx END AS sx, sy, ex, ey FROM {reference_lines}
       UNION ALL SELECT case_id, 2 AS copy, (63 - ord - case_id % 29) % 32 AS ord, ex AS sx, ey AS sy, sx AS ex, sy AS ey FROM {reference_lines}""",
)
define_input(
    "candidate_groups",
    """SELECT o_custkey AS case_id, concat('r', o_orderkey) AS record_id, o_orderpriority NOT LIKE '5%' AS supported,
       CASE WHEN o_orderkey % 13 = 0 THEN 33 + o_orderkey % 3 ELSE o_orderkey % 12 END AS size, o_orderstatus = 'F' AS reliable FROM {orders}""",
)


def sampled(source, step="4.0"):
    share = "(i / (n - 1))"
    return f"""SELECT case_id, ord, i AS sample, CASE WHEN kind = 'ARC' THEN cx + radius * cos(start_angle + sweep * {share}) ELSE sx + {share} * (ex - sx) END AS px,
      CASE WHEN kind = 'ARC' THEN cy + radius * sin(start_angle + sweep * {share}) ELSE sy + {share} * (ey - sy) END AS py FROM (
      SELECT *, unnest(range(0, n)) AS i FROM (SELECT *, CAST(greatest(2, ceil(length / {step}) + 1) AS BIGINT) AS n FROM {source}) c) s"""


def far(px, py):
    """Distance of a point to the curve of the row, in SQL."""
    tau = "(2 * pi())"
    wrap = f"((CASE WHEN sweep >= 0 THEN 1 ELSE -1 END) * (atan2({py} - cy, {px} - cx) - start_angle))"
    t = f"least(1.0, greatest(0.0, (({px} - sx) * (ex - sx) + ({py} - sy) * (ey - sy)) / (pow(ex - sx, 2) + pow(ey - sy, 2))))"
    ends = f"least(sqrt(pow({px} - sx, 2) + pow({py} - sy, 2)), sqrt(pow({px} - ex, 2) + pow({py} - ey, 2)))"
    return f"""CASE WHEN kind = 'ARC' THEN CASE WHEN {wrap} - {tau} * floor({wrap} / {tau}) <= abs(sweep) THEN abs(sqrt(pow({px} - cx, 2) + pow({py} - cy, 2)) - radius) ELSE {ends} END
      ELSE sqrt(pow({px} - sx - {t} * (ex - sx), 2) + pow({py} - sy - {t} * (ey - sy), 2)) END"""


def all_pairs(source, target):
    return f"SELECT p.case_id, p.ord, p.sample, min({far('px', 'py')}) AS distance FROM ({sampled(source)}) p JOIN (SELECT * EXCLUDE (ord) FROM {target}) t ON p.case_id = t.case_id GROUP BY 1, 2, 3"


def mixed_distances(source, target):
    spots = curves.sample(source, STEP).select("case_id", "ord", "sample", "px", "py").withColumnRenamed("ord", "of")
    found = curves.nearest(spots, target, ["of", "sample"])
    return found.select("case_id", F.col("of").alias("ord"), "sample", "distance")


def r5(name, alias=None):
    return (F.round(name, 5) + F.lit(0.0)).alias(alias or name)


@query("point_curve_distance_mixed", f"SELECT case_id, ord, sample, round(distance, 5) + 0.0 AS distance FROM ({all_pairs('{predicted_curves}', '{reference_curves}')}) q")
def point_curve_distance_mixed(t):
    """Samples of predicted lines and arcs to the nearest reference line or arc."""
    return mixed_distances(t("predicted_curves"), t("reference_curves")).select("case_id", "ord", F.col("sample").cast("long").alias("sample"), r5("distance"))


@query(
    "bidirectional_metrics_mixed",
    f"""SELECT case_id, round(max(distance), 5) + 0.0 AS max_error, round(sqrt(avg(distance * distance)), 5) + 0.0 AS rms_error, round(max(distance) FILTER (side = 'p'), 5) + 0.0 AS prediction_max,
       round(max(distance) FILTER (side = 'r'), 5) + 0.0 AS reference_max, count(*) AS samples FROM (
       SELECT *, 'p' AS side FROM ({all_pairs('{predicted_curves}', '{reference_curves}')}) a UNION ALL SELECT *, 'r' AS side FROM ({all_pairs('{reference_curves}', '{predicted_curves}')}) b) d GROUP BY case_id""",
)
def bidirectional_metrics_mixed(t):
    pred, ref = t("predicted_curves"), t("reference_curves")
    both = mixed_distances(pred, ref).withColumn("side", F.lit("p")).unionByName(mixed_distances(ref, pred).withColumn("side", F.lit("r")))
    of = lambda side: F.max(F.when(F.col("side") == side, F.col("distance")))
    rows = both.groupBy("case_id").agg(F.max("distance").alias("max_error"), F.sqrt(F.avg(F.col("distance") * F.col("distance"))).alias("rms_error"), of("p").alias("prediction_max"),
                                       of("r").alias("reference_max"), F.count("*").alias("samples"))
    return rows.select("case_id", r5("max_error"), r5("rms_error"), r5("prediction_max"), r5("reference_max"), "samples")


@query(
    "top3_nearest",
    f"""SELECT case_id, p AS ord, ord AS near, rank, round(distance, 5) + 0.0 AS distance FROM (
       SELECT *, row_number() OVER (PARTITION BY case_id, p ORDER BY round(distance, 9), ord) AS rank FROM (
       SELECT p.case_id, p.ord AS p, t.ord, {far('px', 'py')} AS distance FROM (SELECT case_id, ord, (sx + ex) / 2 + CASE WHEN ord % 6 = 0 THEN 900 ELSE 0 END AS px, (sy + ey) / 2 AS py FROM {{predicted_curves}}) p
       JOIN {{reference_curves}} t ON p.case_id = t.case_id) d) r WHERE rank <= 3""",
)
def top3_nearest(t):
    """The three reference curves nearest to the middle of each predicted chord; every sixth point lies far outside."""
    spots = t("predicted_curves").select("case_id", F.col("ord").alias("p"), ((F.col("sx") + F.col("ex")) / 2 + F.when(F.col("ord") % 6 == 0, 900).otherwise(0)).alias("px"), ((F.col("sy") + F.col("ey")) / 2).alias("py"))
    rows = curves.nearest_k(spots, t("reference_curves"), 3, ["p"])
    return rows.select("case_id", F.col("p").alias("ord"), F.col("ord").alias("near"), F.col("rank").cast("long").alias("rank"), r5("distance"))


AREA = """sum((sx * ey - ex * sy) / 2 + CASE WHEN kind = 'ARC' THEN radius * radius * (sweep - sin(sweep)) / 2 ELSE 0 END)"""


@query("cycle_area_mixed", f"SELECT case_id, round({AREA}, 4) + 0.0 AS area FROM {{reference_curves}} GROUP BY case_id")
def cycle_area_mixed(t):
    return curves.signed_area(t("reference_curves")).select("case_id", (F.round("area", 4) + F.lit(0.0)).alias("area"))


@query("d4_transform_mixed", f"SELECT case_id, round(-({AREA}), 4) + 0.0 AS area, count(*) FILTER (sweep < 0) AS left_turns, round(sum(-sx + 2 * sy), 4) + 0.0 AS mark FROM {{reference_curves}} GROUP BY case_id")
def d4_transform_mixed(t):
    """A reflection: areas change sign and arcs their direction."""
    rows = curves.turned(t("reference_curves"), (-1, 0, 0, 1))
    spots = rows.groupBy("case_id").agg(F.count_if(F.col("sweep") > 0).alias("left_turns"), (F.round(F.sum(F.col("sx") + 2 * F.col("sy")), 4) + F.lit(0.0)).alias("mark"))
    return curves.signed_area(rows).select("case_id", (F.round("area", 4) + F.lit(0.0)).alias("area")).join(spots, "case_id")


def meeting_sql(source):
    """Inner crossing points of all pairs of curves of a case, in SQL."""
    shape = ["kind", "sx", "sy", "ex", "ey", "cx", "cy", "radius", "start_angle", "sweep"]
    pairs = f"SELECT a.case_id, a.ord AS first, b.ord AS second, {', '.join(f'a.{c} AS a_{c}, b.{c} AS b_{c}' for c in shape)} FROM {source} a JOIN {source} b ON a.case_id = b.case_id AND a.ord < b.ord"
    cross = "((a_ex - a_sx) * (b_ey - b_sy) - (a_ey - a_sy) * (b_ex - b_sx))"
    t = f"(((b_sx - a_sx) * (b_ey - b_sy) - (b_sy - a_sy) * (b_ex - b_sx)) / nullif({cross}, 0))"
    lines = f"SELECT *, a_sx + {t} * (a_ex - a_sx) AS x, a_sy + {t} * (a_ey - a_sy) AS y FROM pr WHERE a_kind = 'LINE' AND b_kind = 'LINE'"

    def line_arc(p, q):
        dx, dy, fx, fy = f"({p}_ex - {p}_sx)", f"({p}_ey - {p}_sy)", f"({p}_sx - {q}_cx)", f"({p}_sy - {q}_cy)"
        A, B, C = f"({dx} * {dx} + {dy} * {dy})", f"({fx} * {dx} + {fy} * {dy})", f"({fx} * {fx} + {fy} * {fy} - {q}_radius * {q}_radius)"
        at = f"((-{B} + s * sqrt({B} * {B} - {A} * {C})) / {A})"
        return f"SELECT * EXCLUDE (s), {p}_sx + {at} * {dx} AS x, {p}_sy + {at} * {dy} AS y FROM pr JOIN sg ON s <> 0 WHERE {p}_kind = 'LINE' AND {q}_kind = 'ARC' AND {B} * {B} - {A} * {C} >= 0"

    d2 = "(pow(b_cx - a_cx, 2) + pow(b_cy - a_cy, 2))"
    al = f"(({d2} + a_radius * a_radius - b_radius * b_radius) / (2 * {d2}))"
    h2 = f"(a_radius * a_radius / {d2} - {al} * {al})"
    arcs = f"""SELECT * EXCLUDE (s), a_cx + {al} * (b_cx - a_cx) - s * sqrt({h2}) * (b_cy - a_cy) AS x, a_cy + {al} * (b_cy - a_cy) + s * sqrt({h2}) * (b_cx - a_cx) AS y
      FROM pr JOIN sg ON s <> 0 WHERE a_kind = 'ARC' AND b_kind = 'ARC' AND {d2} > 0 AND CASE WHEN {d2} > 0 THEN {h2} >= 0 END"""

    def on(p):
        turn = f"((CASE WHEN {p}_sweep >= 0 THEN 1 ELSE -1 END) * (atan2(y - {p}_cy, x - {p}_cx) - {p}_start_angle))"
        turn = f"({turn} - 2 * pi() * floor({turn} / (2 * pi())))"
        dx, dy = f"({p}_ex - {p}_sx)", f"({p}_ey - {p}_sy)"
        share = f"(((x - {p}_sx) * {dx} + (y - {p}_sy) * {dy}) / ({dx} * {dx} + {dy} * {dy}))"
        return f"CASE WHEN {p}_kind = 'ARC' THEN {turn} <= abs({p}_sweep) + 1e-9 OR {turn} >= 2 * pi() - 1e-9 ELSE {share} BETWEEN -1e-9 AND 1 + 1e-9 END"

    end = lambda p: f"least(sqrt(pow(x - {p}_sx, 2) + pow(y - {p}_sy, 2)), sqrt(pow(x - {p}_ex, 2) + pow(y - {p}_ey, 2))) <= 1e-6"
    return f"""WITH pr AS ({pairs}), sg AS (SELECT 1 AS s UNION ALL SELECT -1), sp AS ({lines} UNION ALL {line_arc('a', 'b')} UNION ALL {line_arc('b', 'a')} UNION ALL {arcs})
      SELECT case_id, first, second, round(x, 4) + 0.0 AS x, round(y, 4) + 0.0 AS y FROM sp WHERE x IS NOT NULL AND {on('a')} AND {on('b')} AND NOT ({end('a')} AND {end('b')})"""


@query("self_intersection_mixed", meeting_sql("{reference_curves}"))
def self_intersection_mixed(t):
    """Crossings of lines and arcs of a ring with themselves and each other."""
    rows = curves.crossings(t("reference_curves"), 25.0)
    return rows.select("case_id", "first", "second", *[(F.round(c, 4) + F.lit(0.0)).alias(c) for c in ("x", "y")])


def along(source, samples):
    """Points at equal steps along all curves of a case in order."""
    share = "((i * gap - before) / length)"
    return f"""SELECT case_id, i, CASE WHEN kind = 'ARC' THEN cx + radius * cos(start_angle + sweep * {share}) ELSE sx + {share} * (ex - sx) END AS px,
      CASE WHEN kind = 'ARC' THEN cy + radius * sin(start_angle + sweep * {share}) ELSE sy + {share} * (ey - sy) END AS py FROM (
      SELECT *, unnest(range(CAST(ceil(round(before / gap, 6)) AS BIGINT), CAST(ceil(round((before + length) / gap, 6)) AS BIGINT))) AS i FROM (
      SELECT *, sum(length) OVER (PARTITION BY case_id) / {samples} AS gap, coalesce(sum(length) OVER (PARTITION BY case_id ORDER BY ord ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM {source}) c) s"""


def registration_sql(samples=register.SAMPLES, rounds=register.ROUNDS):
    """Every sample against every sample of the other side, in each round."""
    def near(points, targets, keys, p):
        x, y = ("x + dx", "y + dy") if p == "p" else ("x - dx", "y - dy")
        return f"""SELECT case_id, turn, start, avg(b.qx - ux) AS {p}x, avg(b.qy - uy) AS {p}y, avg(b.d) AS {p}d FROM (
          SELECT q.case_id, q.turn, q.start, q.i, q.ux, q.uy, min(struct_pack(d := pow(r.x - ux, 2) + pow(r.y - uy, 2), qx := r.x, qy := r.y)) AS b
          FROM (SELECT s.case_id, s.turn, s.start, o.i, {x} AS ux, {y} AS uy FROM {points}) q JOIN {targets} r ON {keys} GROUP BY q.case_id, q.turn, q.start, q.i, q.ux, q.uy) w GROUP BY 1, 2, 3"""

    ctes = [
        f"pp AS ({along('{turned_curves}', samples)})",
        f"fx AS (SELECT case_id, i, px AS x, py AS y FROM ({along('{reference_curves}', samples)}) z)",
        "tu AS (SELECT case_id, turn, i, a * px + b * py AS x, c * px + d * py AS y FROM pp CROSS JOIN (" + " UNION ALL ".join(
            f"SELECT {k} AS turn, {a} AS a, {b} AS b, {c} AS c, {d} AS d" for k, (a, b, c, d) in enumerate(register.TURNS)) + ") m)",
        """mi AS (SELECT p.case_id, turn, rcx - pcx AS cx, rcy - pcy AS cy, rmx - pmx AS mx, rmy - pmy AS my FROM
           (SELECT case_id, turn, (min(x) + max(x)) / 2 AS pcx, (min(y) + max(y)) / 2 AS pcy, avg(x) AS pmx, avg(y) AS pmy FROM tu GROUP BY 1, 2) p JOIN
           (SELECT case_id, (min(x) + max(x)) / 2 AS rcx, (min(y) + max(y)) / 2 AS rcy, avg(x) AS rmx, avg(y) AS rmy FROM fx GROUP BY 1) r USING (case_id))""",
        "s0 AS (SELECT case_id, turn, 0 AS start, cx AS dx, cy AS dy FROM mi UNION ALL SELECT case_id, turn, 1, mx, my FROM mi)",
    ]
    for k in range(rounds + 1):
        ctes.append(f"p{k} AS ({near(f's{k} s JOIN tu o ON s.case_id = o.case_id AND s.turn = o.turn', 'fx', 'r.case_id = q.case_id', 'p')})")
        ctes.append(f"r{k} AS ({near(f's{k} s JOIN fx o ON s.case_id = o.case_id', 'tu', 'r.case_id = q.case_id AND r.turn = q.turn', 'r')})")
        ctes.append(f"s{k + 1} AS (SELECT case_id, turn, start, dx + (px - rx) / 2 AS dx, dy + (py - ry) / 2 AS dy, (pd + rd) / 2 AS loss, dx AS ox, dy AS oy FROM s{k} JOIN p{k} USING (case_id, turn, start) JOIN r{k} USING (case_id, turn, start))")
    best = f"SELECT case_id, min(struct_pack(l := round(loss, 9), turn := turn, start := start, dx := ox, dy := oy)) AS b FROM s{rounds + 1} GROUP BY 1"
    return f"WITH {', '.join(ctes)} SELECT case_id, b.turn AS turn, round(b.dx, 4) + 0.0 AS dx, round(b.dy, 4) + 0.0 AS dy, round(b.l, 4) + 0.0 AS loss FROM ({best}) z"


@query("registration", registration_sql())
def registration(t):
    """Orientation and shift that bring each turned prediction back onto its reference."""
    rows = register.register(t("turned_curves"), t("reference_curves"))
    return rows.select("case_id", "turn", *[(F.round(c, 4) + F.lit(0.0)).alias(c) for c in ("dx", "dy", "loss")])


@query(
    "ring_containment",
    """WITH r AS (SELECT case_id, ring, abs(sum(sx * ey - ex * sy)) / 2 AS area, list(struct_pack(sx := sx, sy := sy, ex := ex, ey := ey) ORDER BY sx, sy, ex) AS es, min(struct_pack(x := sx, y := sy)) AS p,
         min(sx) AS x0, min(sy) AS y0, max(sx) AS x1, max(sy) AS y1 FROM {nested_rings} GROUP BY 1, 2),
       pr AS (SELECT a.case_id, a.ring, b.ring AS outer_ring, b.area AS outer_area,
         b.x0 < a.x0 AND a.x1 < b.x1 AND b.y0 < a.y0 AND a.y1 < b.y1 AS inside,
         NOT (a.x1 < b.x0 OR b.x1 < a.x0 OR a.y1 < b.y0 OR b.y1 < a.y0 OR (b.x0 < a.x0 AND a.x1 < b.x1 AND b.y0 < a.y0 AND a.y1 < b.y1) OR (a.x0 < b.x0 AND b.x1 < a.x1 AND a.y0 < b.y0 AND b.y1 < a.y1)) AS touch
         FROM r a JOIN r b ON a.case_id = b.case_id AND a.ring <> b.ring),
       am AS (SELECT DISTINCT case_id FROM pr WHERE touch),
       d AS (SELECT case_id, ring, count(*) AS depth, arg_min(outer_ring, (outer_area, outer_ring)) AS parent FROM pr WHERE inside GROUP BY 1, 2),
       n AS (SELECT r.case_id, r.ring, area, CASE WHEN am.case_id IS NULL THEN parent END AS parent, CASE WHEN am.case_id IS NULL THEN coalesce(depth, 0) END AS depth, am.case_id IS NOT NULL AS ambiguous
         FROM r LEFT JOIN d ON d.case_id = r.case_id AND d.ring = r.ring LEFT JOIN am ON am.case_id = r.case_id),
       h AS (SELECT case_id, parent, sum(area) AS holes FROM n WHERE depth % 2 = 1 GROUP BY 1, 2)
       SELECT n.case_id, ring, round(area, 4) AS area, n.parent, depth, CASE WHEN depth % 2 = 0 THEN 'material' WHEN depth % 2 = 1 THEN 'hole' END AS role,
         CASE WHEN depth % 2 = 0 THEN round(area - coalesce(holes, 0), 4) END AS net_area, ambiguous FROM n LEFT JOIN h ON h.case_id = n.case_id AND h.parent = n.ring""",
)
def ring_containment(t):
    """Nesting of square rings; the oracle compares their boxes."""
    rows = nesting.nesting(t("nested_rings"))
    return rows.select("case_id", "ring", F.round("area", 4).alias("area"), "parent", "depth", "role", F.round("net_area", 4).alias("net_area"), "ambiguous")


TIPS = f"""SELECT l.*, q.ord AS entity, q.kind AS entity_kind, q.distance AS gap FROM {{leader_tips}} l LEFT JOIN (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY case_id, record_id ORDER BY round(distance, 9), ord) AS r FROM (
  SELECT t.case_id, t.record_id, ord, kind, {far('px', 'py')} AS distance FROM (SELECT case_id, record_id, px, py FROM {{leader_tips}}) t JOIN {{reference_curves}} c ON c.case_id = t.case_id) d) e WHERE r = 1) q
  ON q.case_id = l.case_id AND q.record_id = l.record_id"""


@query(
    "leader_nearest_entity",
    f"""SELECT case_id, record_id, entity, round(gap, 5) + 0.0 AS gap, gap <= greatest(12.0, 2.25 * grid) AS supported, kind <> 'radius' OR entity_kind = 'ARC' AS compatible,
       coalesce((SELECT string_agg(CAST(n.ord AS VARCHAR), ',' ORDER BY n.ord) FROM (SELECT case_id AS k, ord, kind, sx, sy, ex, ey, cx, cy, radius, start_angle, sweep FROM {{reference_curves}}) n
         WHERE q.kind = 'radius' AND q.arrowhead AND q.gap <= greatest(12.0, 2.25 * q.grid) AND n.k = q.case_id AND n.ord IN ((q.entity + 31) % 32, (q.entity + 1) % 32)
         AND n.dist_ok), '') AS alternatives FROM ({TIPS}) q""".replace("n.dist_ok", "({d} <= 2.25 * q.grid AND {d} - q.gap <= 2.25 * q.grid)".format(
        d="(" + far("q.px", "q.py").replace("kind = 'ARC'", "n.kind = 'ARC'").replace("\n", " ") + ")")),
)
def leader_nearest_entity(t):
    rows = leaders.nearest_entity(t("leader_tips"), t("reference_curves"))
    return rows.select("case_id", "record_id", "entity", r5("gap"), "supported", "compatible", F.array_join(F.transform("alternatives", lambda x: x.cast("string")), ",").alias("alternatives"))


HITS = """SELECT case_id, record_id, min(hit) AS first FROM (SELECT *, CASE WHEN abs(cr) > 1e-9 THEN CASE WHEN t BETWEEN -1e-9 AND 1 + 1e-9 AND u BETWEEN -1e-9 AND 1 + 1e-9 THEN least(1.0, greatest(0.0, t)) END
  WHEN abs(off) <= 1e-7 AND greatest(ta, tb) >= 0 AND least(ta, tb) <= 1 THEN greatest(0.0, least(ta, tb)) END AS hit FROM (
  SELECT case_id, record_id, dx * qy - dy * qx AS cr, (rx * qy - ry * qx) / nullif(dx * qy - dy * qx, 0) AS t, (rx * dy - ry * dx) / nullif(dx * qy - dy * qx, 0) AS u, rx * dy - ry * dx AS off,
  (rx * dx + ry * dy) / (dx * dx + dy * dy) AS ta, ((rx + qx) * dx + (ry + qy) * dy) / (dx * dx + dy * dy) AS tb FROM (
  SELECT r.case_id, r.record_id, r.tx - r.ax AS dx, r.ty - r.ay AS dy, ex - sx AS qx, ey - sy AS qy, sx - r.ax AS rx, sy - r.ay AS ry
  FROM {leader_rays} r JOIN {reference_lines} e ON e.case_id = r.case_id WHERE sqrt(pow(r.tx - r.ax, 2) + pow(r.ty - r.ay, 2)) > 1e-8) a) b) c GROUP BY 1, 2"""


@query(
    "leader_visibility",
    f"""SELECT r.case_id, r.record_id, round(h.first, 5) + 0.0 AS first, round((1 - h.first) * sqrt(pow(tx - ax, 2) + pow(ty - ay, 2)), 5) + 0.0 AS remaining,
       coalesce((1 - h.first) * sqrt(pow(tx - ax, 2) + pow(ty - ay, 2)) <= greatest(10.0, 1.7 * band), true) AS verified FROM {{leader_rays}} r LEFT JOIN ({HITS}) h ON h.case_id = r.case_id AND h.record_id = r.record_id""",
)
def leader_visibility(t):
    rows = leaders.visibility(t("leader_rays"), t("reference_lines"))
    return rows.select("case_id", "record_id", r5("first"), r5("remaining"), "verified")


@query(
    "arclength_resample",
    """WITH e AS (SELECT case_id, ord, x, y, lead(x) OVER w AS nx, lead(y) OVER w AS ny FROM {ring_points} WINDOW w AS (PARTITION BY case_id ORDER BY ord)),
       l AS (SELECT *, sqrt(pow(nx - x, 2) + pow(ny - y, 2)) AS len FROM e WHERE nx IS NOT NULL),
       c AS (SELECT *, coalesce(sum(len) OVER (PARTITION BY case_id ORDER BY ord ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before, sum(len) OVER (PARTITION BY case_id) AS total FROM l),
       t AS (SELECT case_id, total, unnest(range(0, n)) AS i, n FROM (SELECT case_id, any_value(total) AS total, CAST(greatest(2, ceil(any_value(total) / 7.5) + 1) AS BIGINT) AS n FROM c GROUP BY 1) g),
       m AS (SELECT t.case_id, t.i, max(c.ord) AS ord, any_value(t.total * t.i / (t.n - 1)) AS d FROM t JOIN c ON c.case_id = t.case_id AND c.before <= t.total * t.i / (t.n - 1) + 1e-9 GROUP BY 1, 2)
       SELECT m.case_id, m.i, round(x + least(1.0, (d - before) / len) * (nx - x), 4) + 0.0 AS x, round(y + least(1.0, (d - before) / len) * (ny - y), 4) + 0.0 AS y FROM m JOIN c ON c.case_id = m.case_id AND c.ord = m.ord""",
)
def arclength_resample(t):
    rows = paths.resample(t("ring_points"), 7.5)
    return rows.select("case_id", "i", *[(F.round(c, 4) + F.lit(0.0)).alias(c) for c in ("x", "y")])


@query(
    "geometry_fingerprint",
    """WITH s AS (SELECT case_id, copy, list(concat(sx, ' ', sy, ' ', ex, ' ', ey) ORDER BY ord) AS f, list(concat(ex, ' ', ey, ' ', sx, ' ', sy) ORDER BY ord DESC) AS b FROM {ring_copies} GROUP BY 1, 2),
       c AS (SELECT case_id, copy, min(v) AS canon FROM (SELECT case_id, copy, unnest(list_concat(list_transform(range(1, 33), lambda i: array_to_string(list_concat(f[i:32], f[1:i - 1]), '|')),
         list_transform(range(1, 33), lambda i: array_to_string(list_concat(b[i:32], b[1:i - 1]), '|')))) AS v FROM s) u GROUP BY 1, 2)
       SELECT case_id, copy, CAST(min(case_id * 10 + copy) OVER (PARTITION BY canon) AS BIGINT) AS same_as FROM c""",
)
def geometry_fingerprint(t):
    """Rings with one fingerprint, named by the first of them."""
    text = lambda *names: F.concat_ws(" ", *[F.col(n).cast("string") for n in names])
    found = paths.ring_digest(t("ring_copies"), text("sx", "sy", "ex", "ey"), text("ex", "ey", "sx", "sy"), ("case_id", "copy"))
    first = found.groupBy("digest").agg(F.min(F.col("case_id") * 10 + F.col("copy")).cast("long").alias("same_as"))
    return found.join(first, "digest").select("case_id", "copy", "same_as")


@query(
    "request_pages",
    """WITH RECURSIVE g AS (SELECT *, CASE WHEN NOT supported THEN 'unsupported_or_unresolved_source_dimension' WHEN size = 0 THEN 'no_source_candidate'
         WHEN size > 32 THEN 'complete_candidate_group_exceeds_page_limit' END AS reason FROM {candidate_groups}),
       o AS (SELECT *, row_number() OVER (PARTITION BY case_id ORDER BY NOT reliable, record_id) AS k FROM g WHERE reason IS NULL),
       w(case_id, k, record_id, size, pages, page) AS (
         SELECT case_id, CAST(0 AS BIGINT), NULL::VARCHAR, CAST(0 AS BIGINT), []::STRUCT(r BIGINT, c BIGINT)[], CAST(0 AS BIGINT) FROM (SELECT DISTINCT case_id FROM o) z
         UNION ALL
         SELECT case_id, k, record_id, size, CASE WHEN spot > len(pages) THEN list_append(pages, struct_pack(r := CAST(1 AS BIGINT), c := size))
           ELSE list_transform(pages, lambda p, i: CASE WHEN i = spot THEN struct_pack(r := p.r + 1, c := p.c + size) ELSE p END) END, spot
         FROM (SELECT w.case_id, o.k, o.record_id, CAST(o.size AS BIGINT) AS size, w.pages, CAST(coalesce(nullif(list_position(list_transform(w.pages, lambda p: p.r < 16 AND p.c + o.size <= 32), true), 0), len(w.pages) + 1) AS BIGINT) AS spot
           FROM w JOIN o ON o.case_id = w.case_id AND o.k = w.k + 1) n)
       SELECT case_id, record_id, size, CASE WHEN page <= 4 THEN page END AS page, CASE WHEN page > 4 THEN 'page_count_limit' END AS reason FROM w WHERE k > 0
       UNION ALL SELECT case_id, record_id, CAST(size AS BIGINT), NULL, reason FROM g WHERE reason IS NOT NULL""",
)
def request_pages(t):
    """Reliable groups first; a customer is a case."""
    return pages.request_pages(t("candidate_groups"), [(~F.col("reliable")).asc()])


@query(
    "point_cloud_hausdorff",
    f"""SELECT case_id, round(greatest(a, b), 5) + 0.0 AS sampled, round(greatest(0, greatest(a, b) - 4), 5) + 0.0 AS lower, round(greatest(a, b) + 4, 5) + 0.0 AS upper FROM (
       SELECT p.case_id, max(d) AS a FROM (SELECT p.case_id, p.ord, p.sample, min(sqrt(pow(p.px - q.px, 2) + pow(p.py - q.py, 2))) AS d FROM ({sampled('{predicted_curves}', '8.0')}) p
         JOIN ({sampled('{reference_curves}', '8.0')}) q ON q.case_id = p.case_id GROUP BY 1, 2, 3) p GROUP BY 1) x JOIN (
       SELECT p.case_id, max(d) AS b FROM (SELECT p.case_id, p.ord, p.sample, min(sqrt(pow(p.px - q.px, 2) + pow(p.py - q.py, 2))) AS d FROM ({sampled('{reference_curves}', '8.0')}) p
         JOIN ({sampled('{predicted_curves}', '8.0')}) q ON q.case_id = p.case_id GROUP BY 1, 2, 3) p GROUP BY 1) y USING (case_id)""",
)
def point_cloud_hausdorff(t):
    rows = compare.hausdorff_bounds(t("predicted_curves"), t("reference_curves"), 8.0)
    return rows.select("case_id", r5("sampled"), r5("lower"), r5("upper"))


# Turned starts of a contour; some cases are bent out of an affine map, some have all points in one place of an axis.
define_input(
    "affine_pairs",
    """SELECT r.case_id, r.sx AS x, CASE WHEN r.case_id % 11 = 0 THEN 2 * r.sx + 1 ELSE r.sy END AS y,
       1.5e0 * p.sx + 0.25e0 * p.sy + (CASE WHEN r.case_id % 7 = 0 THEN 0.001e0 * r.ord * r.ord ELSE 0 END) AS u, p.sy AS v
       FROM {reference_curves} AS r JOIN {turned_curves} AS p ON p.case_id = r.case_id AND p.ord = r.ord""",
)


@query(
    "affine_fit_full",
    """WITH s AS (SELECT case_id, count(*) AS n, avg(x) AS mx, avg(y) AS my, avg(u) AS mu, avg(v) AS mv, var_pop(x) AS xx, covar_pop(x, y) AS xy, var_pop(y) AS yy, covar_pop(x, u) AS xu, covar_pop(y, u) AS yu,
         covar_pop(x, v) AS xv, covar_pop(y, v) AS yv, var_pop(u) AS uu, covar_pop(u, v) AS uv, var_pop(v) AS vv FROM {affine_pairs} GROUP BY 1),
       m AS (SELECT *, xx * yy - xy * xy AS w, xx * yy - xy * xy > 1e-9 * (xx + yy) * (xx + yy) AND uu * vv - uv * uv > 1e-9 * (uu + vv) * (uu + vv) AND n >= 3 AS ok FROM s),
       f AS (SELECT case_id, n, mx, my, mu, mv, CASE WHEN ok THEN (xu * yy - yu * xy) / w END AS a, CASE WHEN ok THEN (yu * xx - xu * xy) / w END AS b,
         CASE WHEN ok THEN (xv * yy - yv * xy) / w END AS c, CASE WHEN ok THEN (yv * xx - xv * xy) / w END AS d FROM m),
       g AS (SELECT *, mu - a * mx - b * my AS tx, mv - c * mx - d * my AS ty FROM f),
       e AS (SELECT case_id, max(sqrt(pow(a * x + b * y + tx - u, 2) + pow(c * x + d * y + ty - v, 2))) AS error FROM {affine_pairs} JOIN g USING (case_id) GROUP BY 1)
       SELECT case_id, n, round(a, 6) + 0.0 AS a, round(b, 6) + 0.0 AS b, round(c, 6) + 0.0 AS c, round(d, 6) + 0.0 AS d, round(tx, 4) + 0.0 AS tx, round(ty, 4) + 0.0 AS ty, round(a * d - b * c, 5) + 0.0 AS det,
         coalesce(error <= 1e-5, false) AS accepted FROM g JOIN e USING (case_id)""",
)
def affine_fit_full(t):
    """Rotated, sheared and degenerate point pairs, with the rank test and the gate on the residual."""
    rows = compare.affine_fit(t("affine_pairs"))
    r = lambda name, k: (F.round(name, k) + F.lit(0.0)).alias(name)
    return rows.select("case_id", "n", *[r(c, 6) for c in "abcd"], r("tx", 4), r("ty", 4), r("det", 5), "accepted")


# Usage documents with whole, negative, broken, textual and nested counters.
define_input(
    "usage_documents",
    """SELECT event_id, k, concat('{{"input_tokens": ', k, ', "output_tokens": ', k - 500, ', "total_tokens": ', k, '.5, "prompt_tokens": "', k, '", "completion_tokens": ', CASE WHEN k % 2 = 0 THEN 'true' ELSE '7' END,
       ', "secret_text": "x", "output_tokens_details": ', CASE WHEN k % 3 = 0 THEN concat('{{"reasoning_tokens": ', k % 10, '}}') ELSE '5' END, ', "input_tokens_details": {{"cached_tokens": -1, "other": 3}}',
       CASE WHEN k % 5 = 0 THEN '' ELSE '}}' END) AS document FROM (SELECT event_id, CAST(regexp_extract(props, '([0-9]+)', 1) AS BIGINT) AS k FROM {events}) AS e""",
)


@query(
    "token_usage_counters",
    """SELECT event_id, CASE WHEN k % 5 <> 0 THEN k END AS input_tokens, CASE WHEN k % 5 <> 0 AND k >= 500 THEN k - 500 END AS output_tokens, NULL::BIGINT AS total_tokens, NULL::BIGINT AS prompt_tokens,
       CASE WHEN k % 5 <> 0 AND k % 2 <> 0 THEN 7::BIGINT END AS completion_tokens, NULL::BIGINT AS cache_creation_input_tokens, NULL::BIGINT AS cache_read_input_tokens,
       CASE WHEN k % 5 <> 0 AND k % 3 = 0 THEN k % 10 END AS output_tokens_details__reasoning_tokens, NULL::BIGINT AS completion_tokens_details__reasoning_tokens,
       NULL::BIGINT AS input_tokens_details__cached_tokens, NULL::BIGINT AS prompt_tokens_details__cached_tokens FROM {usage_documents}""",
)
def token_usage_counters(t):
    """All eleven counters; documents that do not parse have none."""
    return t("usage_documents").select("event_id", *[value.alias(name) for name, value in usage.counters(F.col("document")).items()])


@query(
    "closed_ring",
    """WITH p AS (SELECT case_id, ord, CASE WHEN ord % 6 = 1 THEN sx ELSE x END AS x, CASE WHEN ord % 6 = 1 THEN sy ELSE y END AS y FROM (
         SELECT case_id, ord, sx AS x, sy AS y, lag(sx, 1, sx) OVER w AS sx, lag(sy, 1, sy) OVER w AS sy FROM {reference_lines} WINDOW w AS (PARTITION BY case_id ORDER BY ord)) q),
       l AS (SELECT *, lag(x) OVER w AS px, lag(y) OVER w AS py FROM p WINDOW w AS (PARTITION BY case_id ORDER BY ord))
       SELECT case_id, ord, round(x, 6) + 0.0 AS x, round(y, 6) + 0.0 AS y, NULL::VARCHAR AS issue FROM l WHERE px IS NULL OR sqrt(pow(x - px, 2) + pow(y - py, 2)) > 1e-10""",
)
def closed_ring(t):
    """Rings in which every sixth vertex repeats the one before it."""
    rows = t("reference_lines").select("case_id", "ord", F.col("sx").alias("x"), F.col("sy").alias("y"))
    before = rows.select("case_id", (F.col("ord") + 1).alias("ord"), F.col("x").alias("bx"), F.col("y").alias("by"))
    again = F.col("ord") % 6 == 1
    made = rows.join(before, ["case_id", "ord"], "left").select("case_id", "ord", F.when(again, F.col("bx")).otherwise(F.col("x")).alias("x"), F.when(again, F.col("by")).otherwise(F.col("y")).alias("y"))
    return paths.closed_rings(made).select("case_id", "ord", *[(F.round(c, 6) + F.lit(0.0)).alias(c) for c in ("x", "y")], "issue")
