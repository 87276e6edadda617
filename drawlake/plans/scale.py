"""Registered queries: label association and scale."""

from pyspark.sql import functions as F

from drawlake.operators import scale
from drawlake.plans.registry import query

LENGTHS = """SELECT case_id, record_id, axis, nominal, center, along, height, d AS distance, stroke_id, lo, hi, cross_at, span, thickness, (hi - lo) / nominal AS ppm FROM (
  SELECT l.case_id, l.record_id, l.axis, l.nominal, l.center, l.along, l.height, abs(s.cross_at - l.bottom) / l.height AS d, s.stroke_id, s.lo, s.hi, s.cross_at, s.span, s.thickness,
  row_number() OVER (PARTITION BY l.case_id, l.record_id, l.axis ORDER BY abs(s.cross_at - l.bottom) / l.height, s.stroke_id) AS r
  FROM {labels_px} l JOIN {strokes} s ON l.case_id = s.case_id AND l.axis = s.axis AND s.cross_at BETWEEN l.bottom - 0.3 * l.height AND l.bottom + 1.3 * l.height
  AND l.center BETWEEN s.lo AND s.hi AND s.span >= 1.5 * greatest(8.0, l.along) WHERE l.kind = 'length') q WHERE r = 1"""
DIAMETERS = """SELECT case_id, record_id, stroke_id, nominal, lo, hi, score FROM (
  SELECT l.case_id, l.record_id, l.nominal, s.stroke_id, s.lo, s.hi, abs(s.cross_at - l.bottom) / l.height + 0.15 * greatest(8.0, l.along) / s.span AS score,
  row_number() OVER (PARTITION BY l.case_id, l.record_id ORDER BY abs(s.cross_at - l.bottom) / l.height + 0.15 * greatest(8.0, l.along) / s.span, s.stroke_id) AS r
  FROM {labels_px} l JOIN {strokes} s ON l.case_id = s.case_id AND s.cross_at BETWEEN l.bottom - 0.3 * l.height AND l.bottom + 1.3 * l.height
  AND l.center BETWEEN s.lo - 0.3 * greatest(8.0, l.along) AND s.hi + 0.3 * greatest(8.0, l.along) AND s.span >= 1.4 * greatest(8.0, l.along) WHERE l.kind = 'diameter') q WHERE r = 1"""
WINDOWS = f"""SELECT case_id, seed, count(*) AS distinct_lines, median(vote) AS ppm, min(low) AS low, max(high) AS high, max(dims) AS dims, max(recs) AS recs FROM (
  SELECT case_id, seed, lo, hi, cross_at, median(ppm) AS vote, min(ppm) AS low, max(ppm) AS high, any_value(dims) AS dims, any_value(recs) AS recs FROM (
  SELECT g.*, d.dims, d.recs FROM (SELECT s.case_id, s.ppm AS seed, w.ppm, w.lo, w.hi, w.cross_at, w.nominal, w.record_id FROM (SELECT DISTINCT case_id, ppm FROM ({LENGTHS}) a) s
    JOIN ({LENGTHS}) w ON w.case_id = s.case_id AND w.ppm / s.ppm BETWEEN 1 AND 1.03) g
  JOIN (SELECT s.case_id, s.ppm AS seed, count(DISTINCT nominal) AS dims, count(DISTINCT record_id) AS recs FROM (SELECT DISTINCT case_id, ppm FROM ({LENGTHS}) a) s
    JOIN ({LENGTHS}) w ON w.case_id = s.case_id AND w.ppm / s.ppm BETWEEN 1 AND 1.03 GROUP BY 1, 2) d ON d.case_id = g.case_id AND d.seed = g.seed) x
  GROUP BY case_id, seed, lo, hi, cross_at) y GROUP BY case_id, seed HAVING count(*) >= 3 AND max(dims) >= 3 AND max(recs) >= 3"""
MODES = f"""SELECT case_id, CASE WHEN bool_or(rival) THEN 'ambiguous' ELSE 'resolved' END AS status, CASE WHEN NOT bool_or(rival) THEN round(max(m_ppm), 6) END AS pixels_per_mm,
  max(m_dims) AS distinct_dimensions, max(m_lines) AS distinct_lines FROM (
  SELECT w.*, greatest(w.high, m.high) / least(w.low, m.low) > 1.03 AS rival, m.ppm AS m_ppm, m.dims AS m_dims, m.distinct_lines AS m_lines FROM ({WINDOWS}) w JOIN (
  SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY case_id ORDER BY dims DESC, distinct_lines DESC, high / low - 1, seed) AS r FROM ({WINDOWS}) z) zz WHERE r = 1) m USING (case_id)) v GROUP BY case_id"""


def length_labels(t):
    return t("labels_px").where("kind = 'length'")


def lengths(t):
    return scale.length_witnesses(length_labels(t), t("strokes").drop("nominal", "ppm", "kind"))


def diameters(t):
    return scale.diameter_witnesses(t("labels_px").where("kind = 'diameter'"), t("strokes").drop("nominal", "ppm", "kind"))


@query("label_stroke_join", f"SELECT case_id, record_id, axis, stroke_id, round(distance, 9) AS distance, round(ppm, 9) AS pixels_per_mm FROM ({LENGTHS}) q")
def label_stroke_join(t):
    return lengths(t).select("case_id", "record_id", "axis", "stroke_id", F.round("distance", 9).alias("distance"), F.round("pixels_per_mm", 9).alias("pixels_per_mm"))


@query("diameter_stroke_join", f"SELECT case_id, record_id, stroke_id, round(score, 6) AS score FROM ({DIAMETERS}) q")
def diameter_stroke_join(t):
    return diameters(t).select("case_id", "record_id", "stroke_id", F.round("score", 6).alias("score"))


@query(
    "chain_split_asof",
    f"""SELECT record_id, round(CASE WHEN abs(lo - b) > 2 * greatest(m, bt) THEN b ELSE lo END, 6) AS seg_lo, round(CASE WHEN abs(hi - a) > 2 * greatest(m, aw) THEN a ELSE hi END, 6) AS seg_hi FROM (
       SELECT w.case_id, w.record_id, any_value(w.lo) AS lo, any_value(w.hi) AS hi, any_value(m) AS m,
       max((v.cross_at, v.thickness)) FILTER (v.cross_at < w.center - w.along / 2 - m) AS bs, bs[1] AS b, bs[2] AS bt,
       min((v.cross_at, v.thickness)) FILTER (v.cross_at > w.center + w.along / 2 + m) AS xs, xs[1] AS a, xs[2] AS aw
       FROM (SELECT *, greatest(3.0, 1.5 * thickness) AS m FROM ({LENGTHS}) q) w LEFT JOIN {{crossings}} v ON v.case_id = w.case_id AND w.cross_at BETWEEN v.lo - m AND v.hi + m
       AND v.cross_at BETWEEN w.lo - m AND w.hi + m AND v.span > 2 * w.height GROUP BY w.case_id, w.record_id) s""",
)
def chain_split_asof(t):
    rows = scale.split_chains(lengths(t), t("crossings"), length_labels(t))
    return rows.select("record_id", F.round("seg_lo", 6).alias("seg_lo"), F.round("seg_hi", 6).alias("seg_hi"))


ALL_OPTIONS = """SELECT l.case_id, l.record_id, s.stroke_id, abs(s.cross_at - l.bottom) / l.height AS distance FROM {labels_px} l JOIN {strokes} s
  ON l.case_id = s.case_id AND s.cross_at BETWEEN l.bottom - 0.3 * l.height AND l.bottom + 1.3 * l.height"""


@query(
    "near_tie_flag",
    f"""SELECT record_id, stroke_id, count(*) OVER (PARTITION BY case_id, record_id) > 1 AS ambiguous FROM (
       SELECT *, min(distance) OVER (PARTITION BY case_id, record_id) AS best FROM ({ALL_OPTIONS}) q) r WHERE distance < best + 0.25""",
)
def near_tie_flag(t):
    return scale.tied_strokes(t("labels_px").drop("kind", "nominal"), t("strokes")).select("record_id", "stroke_id", "ambiguous")


@query(
    "linear_scale_consensus",
    f"SELECT case_id, round(seed, 6) AS seed, distinct_lines, dims AS distinct_dimensions, recs AS distinct_records, round(ppm, 6) AS pixels_per_mm FROM ({WINDOWS}) w",
)
def linear_scale_consensus(t):
    return scale.ratio_windows(lengths(t), length_labels(t)).select(
        "case_id", F.round("seed", 6).alias("seed"), "distinct_lines", "distinct_dimensions", "distinct_records", F.round("pixels_per_mm", 6).alias("pixels_per_mm")
    )


@query("scale_modes", MODES)
def scale_modes(t):
    return scale.scale_modes(scale.ratio_windows(lengths(t), length_labels(t))).withColumn("pixels_per_mm", F.round("pixels_per_mm", 6))


@query(
    "witness_precedence",
    f"""SELECT record_id, stroke_id, 'legacy' AS origin FROM ({LENGTHS}) q WHERE record_id NOT IN (SELECT record_id FROM ({DIAMETERS}) d)
       AND record_id NOT IN (SELECT stroke_id FROM {{strokes}} WHERE thickness = 2)
       UNION ALL SELECT stroke_id, stroke_id, 'local' FROM {{strokes}} WHERE thickness = 2""",
)
def witness_precedence(t):
    """A locally observed pair replaces the record's unsplit stroke."""
    local = t("strokes").where("thickness = 2").select(F.col("stroke_id").alias("record_id"), "stroke_id", F.lit("local").alias("origin"))
    legacy = lengths(t).select("record_id", "stroke_id", F.lit("legacy").alias("origin"))
    return legacy.join(local.select("record_id"), "record_id", "left_anti").unionByName(local)


@query(
    "adjacent_stations",
    """SELECT case_id, station, next_at FROM (SELECT case_id, cross_at AS station, lead(cross_at) OVER (PARTITION BY case_id, lo ORDER BY cross_at) AS next_at, lo
       FROM (SELECT DISTINCT case_id, lo, cross_at FROM {crossings}) d) q WHERE next_at IS NOT NULL""",
)
def adjacent_stations(t):
    stations = t("crossings").select("case_id", "lo", F.col("cross_at").alias("station")).distinct()
    return scale.adjacent_stations(stations, ["case_id", "lo"], "station").select("case_id", "station", "next_at")
