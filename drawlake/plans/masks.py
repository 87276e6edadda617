"""Registered queries: masks."""

from pyspark.sql import functions as F

from drawlake.operators import labellings, masks
from drawlake.plans.registry import define_input, query

COUNTS = """SELECT mask_id, coalesce(predicted, 0) AS predicted, coalesce(target, 0) AS target, coalesce(shared, 0) AS shared FROM {mask_dims} LEFT JOIN (
  SELECT mask_id, sum(p) AS predicted, sum(t) AS target, sum(p * t) AS shared FROM (SELECT mask_id, x, y, max(p) AS p, max(t) AS t FROM (
  SELECT mask_id, x, y, 1 AS p, 0 AS t FROM {predicted_masks} UNION ALL SELECT mask_id, x, y, 0, 1 FROM {target_masks}) u GROUP BY 1, 2, 3) c GROUP BY mask_id) k USING (mask_id)"""
EMPTY = "CASE WHEN predicted + target = 0 THEN 'both_empty' WHEN predicted = 0 THEN 'empty_prediction' WHEN target = 0 THEN 'empty_target' ELSE 'none' END"


@query(
    "mask_region_metrics",
    f"""SELECT mask_id, predicted::BIGINT AS predicted, target::BIGINT AS target, shared::BIGINT AS shared, round(CASE WHEN predicted + target > 0 THEN shared / (predicted + target - shared) ELSE 1 END, 6) AS iou,
       round(CASE WHEN predicted + target > 0 THEN 2 * shared / (predicted + target) ELSE 1 END, 6) AS dice, round(CASE WHEN predicted > 0 THEN shared / predicted ELSE CASE WHEN target = 0 THEN 1 ELSE 0 END END, 6) AS precision,
       round(CASE WHEN target > 0 THEN shared / target ELSE CASE WHEN predicted = 0 THEN 1 ELSE 0 END END, 6) AS recall FROM ({COUNTS}) q""",
)
def mask_region_metrics(t):
    return masks.region_metrics(masks.with_empty(masks.overlap_counts(t("predicted_masks"), t("target_masks")), t("mask_dims")))


def boundary_sql(source):
    return f"SELECT a.mask_id, a.x, a.y FROM {source} a JOIN {source} b ON a.mask_id = b.mask_id AND abs(a.x - b.x) <= 1 AND abs(a.y - b.y) <= 1 GROUP BY 1, 2, 3 HAVING count(*) < 9"


def nearest_sql(a, b):
    return f"SELECT s.mask_id, s.x, s.y, min(sqrt(pow(s.x - o.x, 2) + pow(s.y - o.y, 2))) AS d FROM ({boundary_sql(a)}) s JOIN ({boundary_sql(b)}) o ON s.mask_id = o.mask_id GROUP BY 1, 2, 3"


@query(
    "mask_boundary_metrics",
    f"""SELECT mask_id, round(CASE e WHEN 'both_empty' THEN 1 WHEN 'none' THEN bp ELSE 0 END, 6) AS boundary_precision, round(CASE e WHEN 'both_empty' THEN 1 WHEN 'none' THEN br ELSE 0 END, 6) AS boundary_recall,
       round(CASE WHEN e = 'both_empty' THEN 1 WHEN e = 'none' AND bp + br > 0 THEN 2 * bp * br / (bp + br) ELSE 0 END, 6) AS boundary_f1,
       CASE WHEN e = 'both_empty' THEN 0 ELSE round((fm + bm) / 2, 6) END AS assd, CASE WHEN e = 'both_empty' THEN 0 ELSE round(greatest(fx, bx), 6) END AS hausdorff,
       CASE WHEN e = 'both_empty' THEN 0 ELSE round(greatest(fq, bq), 6) END AS hd95, e AS empty_case FROM (SELECT mask_id, {EMPTY} AS e FROM ({COUNTS}) c) z LEFT JOIN (
       SELECT mask_id, avg(CASE WHEN d <= 3 THEN 1 ELSE 0 END) AS bp, avg(d) AS fm, max(d) AS fx, quantile_cont(d, 0.95) AS fq FROM ({nearest_sql('{predicted_masks}', '{target_masks}')}) f GROUP BY 1) f USING (mask_id)
       LEFT JOIN (SELECT mask_id, avg(CASE WHEN d <= 3 THEN 1 ELSE 0 END) AS br, avg(d) AS bm, max(d) AS bx, quantile_cont(d, 0.95) AS bq FROM ({nearest_sql('{target_masks}', '{predicted_masks}')}) b GROUP BY 1) b USING (mask_id)""",
)
def mask_boundary_metrics(t):
    """Boundary agreement at three pixels, mean distance, HD95 and Hausdorff distance, with the rules for empty masks."""
    return masks.boundary_metrics(t("predicted_masks"), t("target_masks"), t("mask_dims"))


GRID = "SELECT vec_id AS mask_id, x, y FROM (SELECT vec_id, unnest(range(-1, 9)) AS x FROM {embeddings}) a CROSS JOIN (SELECT unnest(range(-1, 9)) AS y) b"
# Each cell is drawn as 3x3 pixels, so cells and pixels have the same components.
TOPOLOGY = f"""WITH RECURSIVE fg AS (SELECT mask_id, CAST(cx AS BIGINT) AS x, CAST(cy AS BIGINT) AS y FROM {{mask_cells}}), bg AS (SELECT * FROM ({GRID}) g EXCEPT SELECT * FROM fg),
  f4 AS (SELECT mask_id, x, y, y * 100 + x AS r FROM fg UNION SELECT n.mask_id, n.x, n.y, f.r FROM f4 f JOIN fg n ON n.mask_id = f.mask_id AND abs(n.x - f.x) + abs(n.y - f.y) = 1),
  f8 AS (SELECT mask_id, x, y, y * 100 + x AS r FROM fg UNION SELECT n.mask_id, n.x, n.y, f.r FROM f8 f JOIN fg n ON n.mask_id = f.mask_id AND greatest(abs(n.x - f.x), abs(n.y - f.y)) = 1),
  b4 AS (SELECT mask_id, x, y, y * 100 + x AS r FROM bg UNION SELECT n.mask_id, n.x, n.y, f.r FROM b4 f JOIN bg n ON n.mask_id = f.mask_id AND abs(n.x - f.x) + abs(n.y - f.y) = 1),
  b8 AS (SELECT mask_id, x, y, y * 100 + x AS r FROM bg UNION SELECT n.mask_id, n.x, n.y, f.r FROM b8 f JOIN bg n ON n.mask_id = f.mask_id AND greatest(abs(n.x - f.x), abs(n.y - f.y)) = 1),
  c AS (SELECT mask_id, 'f4' AS k, count(DISTINCT m) AS n FROM (SELECT mask_id, min(r) AS m FROM f4 GROUP BY mask_id, x, y) z GROUP BY 1 UNION ALL
        SELECT mask_id, 'f8', count(DISTINCT m) FROM (SELECT mask_id, min(r) AS m FROM f8 GROUP BY mask_id, x, y) z GROUP BY 1 UNION ALL
        SELECT mask_id, 'b4', count(DISTINCT m) FROM (SELECT mask_id, min(r) AS m FROM b4 GROUP BY mask_id, x, y) z GROUP BY 1 UNION ALL
        SELECT mask_id, 'b8', count(DISTINCT m) FROM (SELECT mask_id, min(r) AS m FROM b8 GROUP BY mask_id, x, y) z GROUP BY 1)
  SELECT mask_id, c4 AS components_4, c8 AS components_8, h8 - 1 AS holes_4, h4 - 1 AS holes_8, c4 - h8 + 1 AS euler_4, c8 - h4 + 1 AS euler_8, c4 <> c8 AS diagonal_contact FROM (
  SELECT mask_id, max(n) FILTER (k = 'f4') AS c4, max(n) FILTER (k = 'f8') AS c8, max(n) FILTER (k = 'b4') AS h4, max(n) FILTER (k = 'b8') AS h8 FROM c GROUP BY mask_id) q"""


@query("mask_topology", TOPOLOGY)
def mask_topology(t):
    return masks.topology(t("mask_pixels"), 24, 24)


@query(
    "mask_erosion",
    """SELECT mask_id, count(*) AS core_pixels FROM (SELECT a.mask_id, a.x, a.y FROM {mask_pixels} a JOIN {mask_pixels} b ON a.mask_id = b.mask_id AND abs(a.x - b.x) <= 1 AND abs(a.y - b.y) <= 1
       GROUP BY 1, 2, 3 HAVING count(*) = 9) q GROUP BY mask_id""",
)
def mask_erosion(t):
    return masks.erode(t("mask_pixels")).groupBy("mask_id").agg(F.count("*").alias("core_pixels"))


@query("pixel_center_map", "SELECT mask_id, x, y, round((x + 0.5) * 850 / 24 - 0.5, 6) AS image_x, round((y + 0.5) * 1150 / 24 - 0.5, 6) AS image_y FROM {mask_pixels}")
def pixel_center_map(t):
    """Mask pixel centres in the original 850x1150 image."""
    return t("mask_pixels").select(
        "mask_id", "x", "y", F.round((F.col("x") + 0.5) * 850 / 24 - 0.5, 6).alias("image_x"), F.round((F.col("y") + 0.5) * 1150 / 24 - 0.5, 6).alias("image_y")
    )


# Cells as pixels, and a proposal that drops some and adds others.
define_input("cells_before", "SELECT mask_id, CAST(cx AS BIGINT) AS x, CAST(cy AS BIGINT) AS y FROM {mask_cells} WHERE mask_id % 10 <> 9")
define_input(
    "cells_after",
    """SELECT mask_id, CAST(cx AS BIGINT) AS x, CAST(cy AS BIGINT) AS y FROM {mask_cells} WHERE mask_id % 4 = 0 OR (cx * 3 + cy * 5 + mask_id) % 11 <> 0 AND mask_id % 10 <> 3
       UNION SELECT mask_id, CAST((cx + 3) % 8 AS BIGINT) AS x, CAST(cy AS BIGINT) AS y FROM {mask_cells} WHERE mask_id % 3 = 0 AND (cx + cy) % 6 = 0""",
)


def grown(source, name, near, width="8"):
    """Components by repeated growth: the smallest place that each cell is reached from."""
    return f"""{name} AS (SELECT mask_id, x, y, y * 100 + x AS r FROM {source} UNION SELECT n.mask_id, n.x, n.y, f.r FROM {name} f JOIN {source} n ON n.mask_id = f.mask_id AND {near}),
      {name}_l AS (SELECT mask_id, x, y, min(r) AS label FROM {name} GROUP BY 1, 2, 3)"""


FOUR, EIGHT = "abs(n.x - f.x) + abs(n.y - f.y) = 1", "greatest(abs(n.x - f.x), abs(n.y - f.y)) = 1"
SETS = f"""{grown('{cells_before}', 'ba', FOUR)}, {grown('{cells_after}', 'aa', FOUR)},
  pr AS (SELECT DISTINCT b.mask_id, b.label AS a, q.label AS b FROM ba_l b JOIN aa_l q ON q.mask_id = b.mask_id AND q.x = b.x AND q.y = b.y),
  bs AS (SELECT l.mask_id, count(*) AS before, count(*) FILTER (n > 1) AS split, count(*) FILTER (n IS NULL) AS deleted FROM (SELECT DISTINCT mask_id, label FROM ba_l) l
    LEFT JOIN (SELECT mask_id, a, count(*) AS n FROM pr GROUP BY 1, 2) p ON p.mask_id = l.mask_id AND p.a = l.label GROUP BY 1),
  cs AS (SELECT l.mask_id, count(*) AS after, count(*) FILTER (n > 1) AS joined, count(*) FILTER (n IS NULL) AS created FROM (SELECT DISTINCT mask_id, label FROM aa_l) l
    LEFT JOIN (SELECT mask_id, b, count(*) AS n FROM pr GROUP BY 1, 2) p ON p.mask_id = l.mask_id AND p.b = l.label GROUP BY 1),
  se AS (SELECT mask_id, coalesce(before, 0) AS before, coalesce(after, 0) AS after, coalesce(before, 0) - coalesce(deleted, 0) AS survived, coalesce(deleted, 0) AS deleted, coalesce(split, 0) AS split,
    coalesce(joined, 0) AS joined, coalesce(created, 0) AS created FROM bs FULL JOIN cs USING (mask_id))"""


@query("component_sets", f"WITH RECURSIVE {SETS} SELECT * FROM se")
def component_sets(t):
    """Components of a proposal against those of the material it replaces."""
    return labellings.component_sets(t("cells_before"), t("cells_after"))


@query(
    "thin_neck_cores",
    f"""WITH RECURSIVE cl AS (SELECT mask_id, CAST(cx AS BIGINT) AS x, CAST(cy AS BIGINT) AS y FROM {{mask_cells}}), {grown('cl', 'f4', FOUR)}, {grown('cl', 'f8', EIGHT)},
       p AS (SELECT f8_l.mask_id, f8_l.label, count(DISTINCT f4_l.label) AS n FROM f8_l JOIN f4_l USING (mask_id, x, y) GROUP BY 1, 2)
       SELECT mask_id, CAST(sum(n) AS BIGINT) AS cores, count(*) FILTER (n > 1) AS candidates, CAST(sum(n - 1) AS BIGINT) AS extra FROM p GROUP BY 1""",
)
def thin_neck_cores(t):
    """Cells of 3x3 pixels hang together by corners only, which erosion takes away: the oracle counts 4-components within 8-components."""
    return labellings.thin_necks(t("mask_pixels"))


@query(
    "refinement_components",
    f"""WITH RECURSIVE {SETS}, {grown('{cells_before}', 'be', EIGHT)}, {grown('{cells_after}', 'ae', EIGHT)},
       gr AS (SELECT mask_id, x, y FROM (SELECT DISTINCT mask_id FROM {{mask_cells}}) m, (SELECT unnest(range(-1, 9)) AS x) a, (SELECT unnest(range(-1, 9)) AS y) b),
       bb AS (SELECT * FROM gr WHERE mask_id IN (SELECT mask_id FROM {{cells_before}}) EXCEPT SELECT mask_id, x, y FROM {{cells_before}}),
       ab AS (SELECT * FROM gr WHERE mask_id IN (SELECT mask_id FROM {{cells_after}}) EXCEPT SELECT mask_id, x, y FROM {{cells_after}}),
       {grown('bb', 'bh', FOUR)}, {grown('ab', 'ah', FOUR)},
       n AS (SELECT mask_id, max(v) FILTER (k = 1) AS b8, max(v) FILTER (k = 2) AS a8, max(v) FILTER (k = 3) AS bh, max(v) FILTER (k = 4) AS ah FROM (
         SELECT mask_id, 1 AS k, count(DISTINCT label) AS v FROM be_l GROUP BY 1 UNION ALL SELECT mask_id, 2, count(DISTINCT label) FROM ae_l GROUP BY 1
         UNION ALL SELECT mask_id, 3, count(DISTINCT label) - 1 FROM bh_l GROUP BY 1 UNION ALL SELECT mask_id, 4, count(DISTINCT label) - 1 FROM ah_l GROUP BY 1) u GROUP BY 1),
       px AS (SELECT mask_id, count(*) FILTER (p <> q) AS changed, sum(p) AS raw, sum(q) AS fresh FROM (SELECT mask_id, x, y, max(p) AS p, max(q) AS q FROM (
         SELECT mask_id, x, y, 1 AS p, 0 AS q FROM {{cells_before}} UNION ALL SELECT mask_id, x, y, 0, 1 FROM {{cells_after}}) w GROUP BY 1, 2, 3) v GROUP BY 1)
       SELECT px.mask_id, changed, nullif(concat_ws(',', CASE WHEN deleted > 0 THEN 'deletes_components' END, CASE WHEN changed > 0.04 * greatest(1, raw) THEN 'changes_too_much' END,
         CASE WHEN after > before OR coalesce(a8, 0) > coalesce(b8, 0) THEN 'introduces_disconnected_regions' END, CASE WHEN coalesce(ah, 0) <> coalesce(bh, 0) THEN 'changes_holes' END,
         CASE WHEN fresh = 0 THEN 'erases_material' END, CASE WHEN split > 0 THEN 'splits_components' END, CASE WHEN joined > 0 THEN 'joins_components' END), '') AS reasons
       FROM px LEFT JOIN se USING (mask_id) LEFT JOIN n USING (mask_id)""",
)
def refinement_components(t):
    """The component rules of the refinement gate."""
    return labellings.refinement_reasons(t("cells_before"), t("cells_after"), 8, 8)
