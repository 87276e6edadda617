"""Drawing-shaped relations derived from the driver tables, in the SQL both engines share."""

from drawlake.plans.registry import define_input

define_input(
    "catalog",
    """SELECT o_orderkey AS case_id,
       CASE WHEN o_orderpriority LIKE '1-%' THEN 'calibration' ELSE 'holdout' END AS split,
       o_orderstatus AS template, o_custkey AS owner, o_totalprice AS size_hint
       FROM {orders}""",
)
# A line item is one trial; its key columns and price identify it, so no numbering pass is needed.
define_input(
    "trials",
    """SELECT l_orderkey AS case_id, l_linenumber AS repeat,
       concat(l_orderkey, '-', l_linenumber, '-', l_partkey, '-', l_suppkey, '-', CAST(round(l_extendedprice * 100) AS BIGINT)) AS trial_id,
       CASE WHEN l_returnflag = 'R' THEN 'failed' WHEN l_quantity < 3 THEN 'running' ELSE 'completed' END AS status,
       true AS attempted, l_returnflag <> 'R' AS artifact_completed, l_linestatus = 'F' AS geometry_valid,
       l_quantity > 10 AS scaled_mm, l_discount > 0.095 AS manual_intervention,
       l_returnflag <> 'N' AS reference_compared,
       CASE WHEN l_quantity = 25 THEN NULL ELSE l_tax < 0.03 END AS reference_within,
       CASE WHEN l_linestatus = 'O' THEN 'shape_diagnostic' ELSE 'declared_alignment' END AS alignment_kind,
       l_extendedprice / 1000 AS elapsed_seconds, l_partkey AS part_id, l_suppkey AS source_id
       FROM {lineitem}""",
)
define_input(
    "receipts",
    """SELECT attempt_id, run_id, stage, k, ts, value AS elapsed_seconds,
       CASE WHEN k % 7 = 0 THEN NULL ELSE k % 3 <> 0 END AS http_success,
       CASE WHEN k % 11 = 0 THEN NULL ELSE k % 2 = 0 END AS schema_success,
       CASE WHEN k % 5 = 0 THEN NULL ELSE k % 4 END AS network_requests,
       CASE WHEN k % 3 = 0 THEN 'match' WHEN k % 3 = 1 THEN 'mismatch' ELSE 'uncertain' END AS verdict,
       CASE WHEN k % 13 = 0 THEN 'rate_limited' END AS error_code
       FROM (SELECT event_id AS attempt_id, user_id AS run_id, event_type AS stage, ts, value,
             CAST(regexp_extract(props, '([0-9]+)', 1) AS INT) AS k FROM {events}) AS parsed""",
)
define_input(
    "job_events",
    """SELECT event_id, user_id AS job_id, event_id % 5 AS revision, ts, event_type AS stage,
       CASE WHEN event_type = 'error' THEN 'failed' WHEN event_type = 'purchase' THEN 'completed'
            WHEN event_type = 'signup' AND event_id % 97 = 0 THEN 'cancelled' ELSE 'running' END AS status,
       value FROM {events}""",
)
define_input(
    "ocr_records",
    """SELECT l_orderkey AS case_id,
       concat(l_orderkey, '-', l_linenumber, '-', l_partkey, '-', l_suppkey, '-', CAST(round(l_extendedprice * 100) AS BIGINT)) AS record_id,
       l_linenumber AS ord, l_partkey % 1000 * 1e0 AS x0, l_suppkey * 1e0 AS y0,
       20e0 + l_linenumber AS box_w, 8e0 AS box_h, l_discount * 10 AS score,
       CASE l_partkey % 24
         WHEN 0 THEN concat('R', q) WHEN 1 THEN concat('Ø', q) WHEN 2 THEN concat(q, '±', l_tax)
         WHEN 3 THEN concat(q, '°') WHEN 4 THEN concat('(', q, ')') WHEN 5 THEN concat('R', q, '+0.5')
         WHEN 6 THEN concat(q, '^', chr(123), '+3', chr(125), '_', chr(123), '-', l_tax, chr(125))
         WHEN 7 THEN concat('Ra ', q) WHEN 8 THEN concat('TAPER ', q, ' IN ', l_linenumber)
         WHEN 9 THEN concat('NOTE ', q) WHEN 10 THEN concat('Ｒ', q) WHEN 11 THEN 'Δ1'
         WHEN 12 THEN concat('R', q, '°') WHEN 13 THEN concat('4-Ø', q, 'HOLES')
         WHEN 14 THEN concat('WHEN ROUGH Ø', q) WHEN 15 THEN concat(' .', q, ' ')
         WHEN 16 THEN concat('R', q, 'x') WHEN 17 THEN concat('φ', q, '-0.2') WHEN 18 THEN concat(q, '-', l_linenumber)
         WHEN 19 THEN concat('−', q) WHEN 20 THEN concat(q, '^-1_-3') WHEN 21 THEN 'R0'
         WHEN 22 THEN concat('RaR', q) ELSE concat(q, '.50') END AS text
       FROM (SELECT *, CAST(CAST(l_quantity AS INT) AS STRING) AS q FROM {lineitem}) AS src""",
)
# One dimension label and one stroke per line item; three base scales plus competing-mode outliers.
define_input(
    "strokes",
    """SELECT case_id, stroke_id, 'x' AS axis, lo, lo + nominal * ppm AS hi, cross_at, nominal * ppm AS span,
       1e0 + thick AS thickness, nominal, ppm, kind FROM (
       SELECT l_orderkey AS case_id,
       concat(l_orderkey, '-', l_linenumber, '-', l_partkey, '-', l_suppkey, '-', CAST(round(l_extendedprice * 100) AS BIGINT)) AS stroke_id,
       l_partkey % 100 * 1e0 AS lo, 30e0 * l_linenumber + l_suppkey % 23 AS cross_at, l_quantity AS nominal,
       (2 + l_orderkey % 3) * (CASE WHEN l_suppkey % 4 = 0 THEN 1.5 ELSE 1 + l_tax / 8 END) AS ppm,
       l_suppkey % 3 AS thick,
       CASE WHEN l_partkey % 3 = 0 THEN 'diameter' ELSE 'length' END AS kind
       FROM {lineitem}) AS s""",
)
define_input(
    "labels_px",
    """SELECT case_id, stroke_id AS record_id, axis, kind, nominal, (lo + hi) / 2 AS center, span / 3 AS along,
       cross_at - 2 AS bottom, 8e0 AS height FROM {strokes}""",
)
# Vertical extension strokes that can split or delimit the dimension strokes above.
define_input(
    "crossings",
    """SELECT l_orderkey AS case_id,
       concat(l_orderkey, '-', l_linenumber, '-', l_partkey, '-', l_suppkey, '-', CAST(round(l_extendedprice * 100) AS BIGINT), 'v') AS crossing_id,
       l_partkey % 157 * 1e0 AS cross_at, 25e0 * l_linenumber AS lo, 25e0 * l_linenumber + 20 + l_quantity * 2 AS hi,
       20 + l_quantity * 2 AS span, 1e0 + l_suppkey % 3 AS thickness, l_suppkey % 2 = 0 AS arrow_low,
       l_suppkey % 3 <> 0 AS arrow_high FROM {lineitem}""",
)
# Closed LINE rings: 64 floats of a vector are 32 points.
define_input(
    "ring_points",
    """SELECT vec_id AS case_id, i AS ord, 100 * CAST(element_at(embedding, CAST(2 * i + 1 AS INT)) AS DOUBLE) AS x,
       100 * CAST(element_at(embedding, CAST(2 * i + 2 AS INT)) AS DOUBLE) AS y, label
       FROM (SELECT vec_id, label, embedding, explode(sequence(0, 31)) AS i FROM {embeddings}) AS p""",
    """SELECT vec_id AS case_id, i AS ord, 100 * CAST(embedding[2 * i + 1] AS DOUBLE) AS x,
       100 * CAST(embedding[2 * i + 2] AS DOUBLE) AS y, label
       FROM (SELECT vec_id, label, embedding, CAST(unnest(range(0, 32)) AS INT) AS i FROM {embeddings}) AS p""",
)
define_input(
    "reference_lines",
    """SELECT a.case_id, a.ord, a.x AS sx, a.y AS sy, b.x AS ex, b.y AS ey,
       sqrt((b.x - a.x) * (b.x - a.x) + (b.y - a.y) * (b.y - a.y)) AS length,
       CASE WHEN a.ord % 8 = 0 THEN 'GT_CLOSURE' WHEN a.ord % 11 = 0 THEN 'CONSTRUCTION' ELSE 'GT_MAIN' END AS layer,
       CASE WHEN a.case_id % 9 = 0 THEN 0 WHEN a.case_id % 4 = 0 THEN 1 ELSE 4 END AS unit_code
       FROM {ring_points} AS a JOIN {ring_points} AS b ON a.case_id = b.case_id AND b.ord = (a.ord + 1) % 32""",
)
# The prediction is the reference moved by a small offset; every third case has one split line.
define_input(
    "predicted_lines",
    """SELECT case_id, ord, sx + dx AS sx, sy + dy AS sy, ex + dx AS ex, ey + dy AS ey, length, 'MAIN' AS layer
       FROM (SELECT *, CASE WHEN case_id % 2 = 0 THEN 0.03 ELSE 0.6 END AS dx,
             CASE WHEN case_id % 5 = 0 THEN 0.4 ELSE -0.02 END AS dy FROM {reference_lines}) AS r
       WHERE NOT (case_id % 3 = 0 AND ord = 0)
       UNION ALL
       SELECT case_id, ord, sx, sy, (sx + ex) / 2 AS ex, (sy + ey) / 2 AS ey, length / 2 AS length, 'MAIN' AS layer
       FROM {reference_lines} WHERE case_id % 3 = 0 AND ord = 0
       UNION ALL
       SELECT case_id, 32 AS ord, (sx + ex) / 2 AS sx, (sy + ey) / 2 AS sy, ex, ey, length / 2 AS length, 'MAIN' AS layer
       FROM {reference_lines} WHERE case_id % 3 = 0 AND ord = 0""",
)
define_input(
    "arcs",
    """SELECT l_orderkey AS case_id,
       concat(l_orderkey, '-', l_linenumber, '-', l_partkey, '-', l_suppkey, '-', CAST(round(l_extendedprice * 100) AS BIGINT)) AS entity_id, l_linenumber AS ord,
       l_quantity AS cx, l_discount * 100 AS cy, 1e0 + l_linenumber AS radius, l_tax * 10 AS angle,
       1 + l_discount * 10 AS sweep, l_suppkey % 2 = 0 AS clockwise, l_partkey AS part_id, l_suppkey AS source_id,
       l_quantity AS q, l_tax AS tax
       FROM {lineitem}""",
)
# 8x8 sign cells drawn as 3x3 pixels.
define_input(
    "mask_cells",
    """SELECT vec_id AS mask_id, label, i % 8 AS cx, CAST(floor(i / 8) AS INT) AS cy
       FROM (SELECT vec_id, label, embedding, explode(sequence(0, 63)) AS i FROM {embeddings}) AS p
       WHERE element_at(embedding, i + 1) > 0""",
    """SELECT vec_id AS mask_id, label, i % 8 AS cx, CAST(floor(i / 8) AS INT) AS cy
       FROM (SELECT vec_id, label, embedding, CAST(unnest(range(0, 64)) AS INT) AS i FROM {embeddings}) AS p
       WHERE embedding[i + 1] > 0""",
)
define_input(
    "mask_pixels",
    """SELECT mask_id, label, cx * 3 + dx AS x, cy * 3 + dy AS y FROM {mask_cells}
       CROSS JOIN (SELECT 0 AS dx UNION ALL SELECT 1 UNION ALL SELECT 2) AS gx
       CROSS JOIN (SELECT 0 AS dy UNION ALL SELECT 1 UNION ALL SELECT 2) AS gy""",
)
define_input(
    "target_pixels",
    """SELECT mask_id, x + 1 AS x, y FROM {mask_pixels} WHERE label % 2 = 0
       UNION ALL
       SELECT mask_id + 1 AS mask_id, x, y FROM {mask_pixels} WHERE mask_id + 1 IN
         (SELECT vec_id FROM {embeddings} WHERE label % 2 <> 0)""",
)
define_input("mask_dims", "SELECT vec_id AS mask_id, 24 AS width, 24 AS height FROM {embeddings}")
# Some kinds of drawings lack a prediction, a target or both.
define_input("predicted_masks", "SELECT mask_id, x, y FROM {mask_pixels} WHERE label NOT IN (3, 5)")
define_input("target_masks", "SELECT t.mask_id, t.x, t.y FROM {target_pixels} AS t JOIN {embeddings} AS e ON e.vec_id = t.mask_id WHERE e.label NOT IN (7, 5)")
define_input(
    "manifest",
    """SELECT d.doc_id AS case_id, d.source AS group_id, sha2(d.text, 256) AS source_sha256,
       CASE WHEN d.doc_id % 10 < 7 THEN 'train' WHEN d.doc_id % 10 < 8 THEN 'val' ELSE 'test' END AS split,
       CASE WHEN d.doc_id % 7 = 0 THEN 'failed' ELSE 'ready' END AS state, d.lang AS label_source,
       d.n_chars AS n_chars FROM {documents} AS d""",
    """SELECT d.doc_id AS case_id, d.source AS group_id, sha256(d.text) AS source_sha256,
       CASE WHEN d.doc_id % 10 < 7 THEN 'train' WHEN d.doc_id % 10 < 8 THEN 'val' ELSE 'test' END AS split,
       CASE WHEN d.doc_id % 7 = 0 THEN 'failed' ELSE 'ready' END AS state, d.lang AS label_source,
       d.n_chars AS n_chars FROM {documents} AS d""",
)
