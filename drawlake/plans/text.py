"""Registered queries: dimension text, tolerance policy, paths and response fields."""

from pyspark.sql import functions as F

from drawlake.functions import text, tolerance
from drawlake.operators import report
from drawlake.plans.registry import define_input, query

NUM = r"[+-]?(?:[0-9]+(?:\.[0-9]*)?|\.[0-9]+)"
PARSED = rf"""SELECT *, CASE WHEN finish THEN 'surface_finish' WHEN symbol THEN 'symbol' WHEN good AND angle THEN 'angle' WHEN good THEN mark ELSE 'unknown' END AS kind,
  CASE WHEN good THEN CAST(num AS DOUBLE) END AS nominal, CASE WHEN good THEN up END AS upper, CASE WHEN good THEN low END AS lower,
  CASE WHEN good THEN CASE WHEN angle THEN 'deg' ELSE 'mm' END END AS unit, wrapped AND NOT finish AND NOT symbol AS is_reference FROM (
  SELECT *, NOT finish AND NOT symbol AND num <> '' AND (suffix = '' OR (up IS NOT NULL AND up >= low)) AS good FROM (
  SELECT *, CASE WHEN sym <> '' THEN CAST(sym AS DOUBLE) WHEN a1 <> '' THEN CAST(replace(a1, '+', '') AS DOUBLE)
    WHEN mark <> 'length' AND NOT angle AND uni <> '' THEN CASE WHEN suffix LIKE '+%' THEN CAST(uni AS DOUBLE) ELSE 0 END END AS up,
    CASE WHEN sym <> '' THEN -CAST(sym AS DOUBLE) WHEN a1 <> '' THEN CAST(replace(a2, '+', '') AS DOUBLE)
    WHEN mark <> 'length' AND NOT angle AND uni <> '' THEN CASE WHEN suffix LIKE '+%' THEN 0 ELSE -CAST(uni AS DOUBLE) END END AS low FROM (
  SELECT *, regexp_extract(suffix, '^±({NUM})$', 1) AS sym, regexp_extract(suffix, '^\^\{{{{?({NUM})\}}}}?_\{{{{?({NUM})\}}}}?$', 1) AS a1,
    regexp_extract(suffix, '^\^\{{{{?({NUM})\}}}}?_\{{{{?({NUM})\}}}}?$', 2) AS a2, regexp_extract(suffix, '^[+-]((?:[0-9]+(?:\.[0-9]*)?|\.[0-9]+))$', 1) AS uni FROM (
  SELECT *, substr(val, length(num) + 1) AS suffix FROM (
  SELECT *, regexp_extract(val, '^({NUM})', 1) AS num FROM (
  SELECT *, CASE WHEN angle THEN left(rest, length(rest) - 1) ELSE rest END AS val FROM (
  SELECT *, ends_with(rest, '°') AS angle FROM (
  SELECT *, CASE WHEN mark = 'length' THEN body ELSE substr(body, 2) END AS rest FROM (
  SELECT *, CASE WHEN regexp_matches(body, '^[⌀ØøΦφ∅]') THEN 'diameter' WHEN regexp_matches(body, '^[Rr]') THEN 'radius' ELSE 'length' END AS mark FROM (
  SELECT *, CASE WHEN wrapped THEN substr(n, 2, length(n) - 2) ELSE n END AS body FROM (
  SELECT *, n LIKE '(%)' AS wrapped, regexp_matches(n, '^[rR][aA]') AS finish, regexp_full_match(n, '[δΔ][12]?') AS symbol FROM (
  SELECT *, replace(replace(translate(text, 'Ｒ', 'R'), ' ', ''), '−', '-') AS n FROM {{ocr_records}})))))))))))) q"""
FAMILY = r"""SELECT *, CASE WHEN ratio THEN 'inclination' WHEN regexp_matches(flat, 'ROUGH.?TURNED|WHENROUGH|MHENROUGH') THEN 'manufacturing_stage'
  WHEN regexp_full_match(flat, '[0-9]+[-X×][⌀ØΦ∅][0-9]+(?:\.[0-9]+)?HOLES?') THEN 'hole_feature'
  WHEN regexp_matches(flat, 'INCLINE|INCLINATION|SLOPE|TAPER|[0-9]IN[0-9]') THEN 'unresolved_inclination'
  WHEN kind = 'angle' AND flat LIKE 'R%' THEN 'conflicting_angle_prefix' WHEN regexp_matches(flat, 'RA.*R[0-9]') THEN 'mixed_radius_and_surface_glyphs'
  WHEN kind = 'unknown' AND regexp_matches(flat, 'R[0-9]') THEN 'unparsed_radius' WHEN kind = 'unknown' AND regexp_matches(flat, '[⌀ØΦ∅][0-9]') THEN 'compound_diameter' END AS family
  FROM (SELECT *, upper(n) AS flat, regexp_full_match(upper(n), '(?:INCLINE|INCLINATION|SLOPE|TAPER)?[0-9]+(?:\.[0-9]+)?IN[0-9]+(?:\.[0-9]+)?') AS ratio FROM (""" + PARSED + """) p) f"""
SEMANTIC = r"""CASE WHEN ratio THEN concat_ws('|', 'inclination_ratio', CAST(regexp_extract(flat, '([0-9.]+)IN([0-9.]+)', 1) AS DOUBLE), CAST(regexp_extract(flat, '([0-9.]+)IN([0-9.]+)', 2) AS DOUBLE))
  WHEN kind IN ('length', 'angle', 'radius', 'diameter', 'symbol') THEN concat_ws('|', kind, coalesce(CAST(nominal AS VARCHAR), '-'), coalesce(CAST(upper AS VARCHAR), '-'),
  coalesce(CAST(lower AS VARCHAR), '-'), is_reference, coalesce(unit, '-'), CASE WHEN kind = 'symbol' THEN regexp_replace(text, '\s', '', 'g') ELSE '-' END,
  CASE WHEN kind = 'angle' AND regexp_matches(text, '^\s*[Rr]') THEN 'conflicting_radius_angle_prefix' ELSE '-' END) END"""


def parsed(t):
    return text.with_dimension(t("ocr_records"))


def families(t):
    def read(texts):
        rows = text.with_family(text.with_dimension(texts, keep_form=True))
        return rows.withColumn("priority", text.review_priority(F.col("text"), F.col("dimension.kind"), F.col("family")))

    return text.once_per_text(t("ocr_records"), ["text"], read)


@query("parse_dimension", f"SELECT record_id, text, kind, nominal, upper + 0.0 AS upper, lower + 0.0 AS lower, unit, is_reference FROM ({PARSED}) q")
def parse_dimension(t):
    zero = F.lit(0.0)
    return parsed(t).select("record_id", "text", "dimension.*").withColumns({"upper": F.col("upper") + zero, "lower": F.col("lower") + zero})


@query("canonical_records", f"SELECT case_id, record_id, format('r{{{{:03d}}}}', ord - 1) AS canonical_id, kind, nominal FROM ({PARSED}) q")
def canonical_records(t):
    ids = F.format_string("r%03d", F.col("ord") - 1)
    return parsed(t).select("case_id", "record_id", ids.alias("canonical_id"), "dimension.kind", "dimension.nominal")


BAND = "kind <> 'radius' AND upper IS NOT NULL"


@query(
    "dimension_target",
    f"""SELECT record_id, CASE WHEN problem IS NULL THEN round(CASE WHEN {BAND} THEN nominal + (lower + upper) / 2 ELSE nominal END, 6) END AS target,
       CASE WHEN problem IS NULL AND {BAND} THEN round(nominal + lower, 6) END AS minimum, CASE WHEN problem IS NULL AND {BAND} THEN round(nominal + upper, 6) END AS maximum, problem
       FROM (SELECT *, CASE WHEN nominal IS NULL OR nominal <= 0 THEN 'invalid_source_dimension_nominal'
       WHEN {BAND} AND nominal + (lower + upper) / 2 <= 0 THEN 'nonpositive_source_tolerance_target' END AS problem FROM ({PARSED}) q) r""",
)
def dimension_target(t):
    rows = parsed(t).select("record_id", tolerance.target(F.col("dimension")).alias("v")).select("record_id", "v.*")
    return rows.withColumns({c: F.round(c, 6) for c in ("target", "minimum", "maximum")})


@query(
    "dimension_interval",
    f"""SELECT record_id, CASE WHEN problem IS NULL THEN nominal END AS nominal,
       CASE WHEN problem IS NULL AND {BAND} THEN round(nominal + lower, 6) END AS minimum, CASE WHEN problem IS NULL AND {BAND} THEN round(nominal + upper, 6) END AS maximum, problem
       FROM (SELECT *, CASE WHEN nominal IS NULL OR nominal <= 0 THEN 'invalid_source_dimension_nominal'
       WHEN {BAND} AND nominal + upper <= 0 THEN 'invalid_source_dimension_interval' END AS problem FROM ({PARSED}) q) r""",
)
def dimension_interval(t):
    rows = parsed(t).select("record_id", tolerance.interval(F.col("dimension")).alias("v")).select("record_id", "v.*")
    return rows.withColumns({c: F.round(c, 6) for c in ("minimum", "maximum")})


MEASURED = f"SELECT record_id, nominal + lower AS lo, nominal + upper AS hi, nominal + score - 0.45 AS actual FROM ({PARSED}) q WHERE {BAND} AND nominal > 0 AND nominal + upper > 0"


def measured(t):
    rows = parsed(t).withColumn("iv", tolerance.interval(F.col("dimension"))).where("iv.minimum is not null")
    return rows.select("record_id", F.col("iv.minimum").alias("lo"), F.col("iv.maximum").alias("hi"), (F.col("dimension.nominal") + F.col("score") - 0.45).alias("actual"))


@query("tolerance_check", f"SELECT record_id, abs(actual) BETWEEN lo - 1e-7 AND hi + 1e-7 AS passed FROM ({MEASURED}) m")
def tolerance_check(t):
    return measured(t).select("record_id", tolerance.inside(F.col("actual"), F.col("lo"), F.col("hi")).alias("passed"))


@query("tolerance_residual", f"SELECT record_id, round(abs(actual) - least(greatest(abs(actual), lo), hi), 6) + 0.0 AS residual FROM ({MEASURED}) m")
def tolerance_residual(t):
    return measured(t).select("record_id", F.round(tolerance.residual(F.col("actual"), F.col("lo"), F.col("hi")), 6).alias("residual"))


@query(
    "inclination_ratio",
    f"""SELECT record_id, CAST(regexp_extract(flat, '([0-9.]+)IN([0-9.]+)', 1) AS DOUBLE) AS numerator,
       CAST(regexp_extract(flat, '([0-9.]+)IN([0-9.]+)', 2) AS DOUBLE) AS denominator FROM ({FAMILY}) q WHERE ratio AND regexp_extract(flat, '([0-9.]+)IN', 1) <> '0'""",
)
def inclination_ratio(t):
    rows = text.with_inclination(t("ocr_records"))
    return rows.where("ratio is not null").select("record_id", "ratio.*")


@query("annotation_family", f"SELECT record_id, family FROM ({FAMILY}) q WHERE family IS NOT NULL")
def annotation_family(t):
    return families(t).where("family is not null").select("record_id", "family")


@query(
    "review_priority",
    f"""SELECT record_id, CAST(CASE WHEN family IN ('manufacturing_stage', 'hole_feature') THEN NULL WHEN family IS NOT NULL THEN 0
       WHEN kind = 'length' THEN 1 WHEN kind = 'unknown' AND regexp_matches(text, '[0-9]') THEN 2 END AS INT) AS priority FROM ({FAMILY}) q""",
)
def review_priority(t):
    return families(t).select("record_id", "priority")


@query(
    "radius_text_audit",
    f"""SELECT record_id, CASE WHEN kind <> 'radius' OR NOT coalesce(nominal > 0, false) THEN 'source_radius_text_invalid_or_nonpositive'
       WHEN ord = 3 THEN 'source_radius_parsed_metadata_mismatch' ELSE 'valid' END AS verdict
       FROM (SELECT *, regexp_replace(regexp_replace(n, '^\\(+', ''), '\\)+$', '') AS core FROM ({PARSED}) p) q
       WHERE kind = 'radius' OR (regexp_matches(core, '^[Rr]') AND NOT regexp_matches(core, '^[rR][aA]')
       AND (length(core) = 1 OR NOT regexp_matches(substr(core, 2), '^[A-Za-z]') OR lower(substr(core, 2)) IN ('o', 'i', 'l', 'nan', 'inf', 'infinity')))""",
)
def radius_text_audit(t):
    d = F.col("dimension")
    stored = F.when(F.col("ord") == 3, d["nominal"] + 1).otherwise(d["nominal"])
    verdict = text.radius_text_issue(F.col("text"), d["kind"], stored, d)
    return parsed(t).select("record_id", verdict.alias("verdict")).where("verdict is not null")


@query("semantic_key", f"SELECT record_id, {SEMANTIC} AS reading FROM ({FAMILY}) q")
def semantic_key(t):
    return text.with_inclination(parsed(t)).select("record_id", text.semantic_key(F.col("text"), F.col("dimension"), F.col("ratio")).alias("reading"))


@query(
    "annotation_counts",
    f"""SELECT case_id, count(*) AS records, count(*) FILTER (kind <> 'unknown') AS recognized, count(*) FILTER (kind <> 'unknown' AND score > 0.4) AS bound,
       count(*) FILTER (kind <> 'unknown' AND score <= 0.4) AS unbound, count(*) FILTER (family IS NOT NULL) AS families,
       count(*) FILTER (family NOT IN ('manufacturing_stage', 'hole_feature')) AS unresolved FROM ({FAMILY}) q GROUP BY case_id""",
)
def annotation_counts(t):
    known = F.col("dimension.kind") != "unknown"
    profile = F.coalesce(~F.col("family").isin("manufacturing_stage", "hole_feature"), F.lit(False))
    return families(t).groupBy("case_id").agg(
        F.count("*").alias("records"), F.count_if(known).alias("recognized"),
        F.count_if(known & (F.col("score") > 0.4)).alias("bound"), F.count_if(known & (F.col("score") <= 0.4)).alias("unbound"),
        F.count("family").alias("families"), F.count_if(profile).alias("unresolved"),
    )


@query(
    "review_selection",
    f"""SELECT case_id, record_id, rank FROM (SELECT *, row_number() OVER (PARTITION BY case_id ORDER BY score <= 0.4,
       CASE kind WHEN 'radius' THEN 0 WHEN 'diameter' THEN 1 WHEN 'length' THEN 2 WHEN 'angle' THEN 3 ELSE 4 END, record_id) AS rank
       FROM ({PARSED}) q WHERE kind <> 'unknown') r WHERE rank <= 16""",
)
def review_selection(t, shown: int = 16):
    """The ``shown`` records of a case that are most in need of a review."""
    kind = F.col("dimension.kind")
    order = [
        (F.col("score") <= 0.4).asc(),
        F.when(kind == "radius", 0).when(kind == "diameter", 1).when(kind == "length", 2).when(kind == "angle", 3).otherwise(4).asc(),
        F.col("record_id").asc(),
    ]
    return report.top_per_group(parsed(t).where(kind != "unknown"), ["case_id"], order, shown).select("case_id", "record_id", "rank")


# Two independent re-readings of every record: unchanged, altered or missing.
REREAD = """SELECT record_id, CASE WHEN view = 1 THEN CASE part WHEN 0 THEN NULL WHEN 1 THEN concat(text, '1') WHEN 2 THEN 'R77' ELSE text END
  ELSE CASE part WHEN 3 THEN NULL WHEN 1 THEN text WHEN 2 THEN 'R77' WHEN 4 THEN concat('R', text) ELSE text END END AS text, view, text AS original
  FROM (SELECT record_id, text, ord % 6 AS part, view FROM {ocr_records} CROSS JOIN (SELECT 1 AS view UNION ALL SELECT 2) AS v) AS s"""
define_input("rereads", REREAD)


def _read(source):
    return FAMILY.replace("{ocr_records}", source)


@query(
    "reread_consensus",
    f"""SELECT record_id, CASE WHEN v1 IS NOT NULL AND v1 = v2 AND v1 = orig THEN 'consensus_unchanged' WHEN v1 IS NOT NULL AND v1 = v2 THEN 'consensus_applied'
       WHEN orig_kind IN ('length', 'angle', 'radius', 'diameter') AND ((v1 IS NOT NULL AND v1 IS DISTINCT FROM orig) OR (v2 IS NOT NULL AND v2 IS DISTINCT FROM orig)) THEN 'withheld' ELSE 'unresolved' END AS status
       FROM (SELECT record_id, max(reading) FILTER (view = 1) AS v1, max(reading) FILTER (view = 2) AS v2 FROM (
         SELECT record_id, view, {SEMANTIC} AS reading FROM ({_read('{rereads}')}) q) r GROUP BY record_id) v
       JOIN (SELECT record_id, {SEMANTIC} AS orig, kind AS orig_kind FROM ({FAMILY}) q) o USING (record_id)""",
)
def reread_consensus(t):
    """A readable disagreement withholds the old value; two equal readings replace it."""
    views = text.with_inclination(text.with_dimension(t("rereads"))).withColumn("reading", text.semantic_key(F.col("text"), F.col("dimension"), F.col("ratio")))
    views = views.groupBy("record_id").agg(
        F.max(F.when(F.col("view") == 1, F.col("reading"))).alias("v1"), F.max(F.when(F.col("view") == 2, F.col("reading"))).alias("v2")
    )
    rows = text.with_inclination(parsed(t)).select("record_id", "dimension.kind", text.semantic_key(F.col("text"), F.col("dimension"), F.col("ratio")).alias("orig")).join(views, "record_id")
    agree = F.coalesce(F.col("v1") == F.col("v2"), F.lit(False))

    def disputes(view):
        return F.col(view).isNotNull() & ~F.col(view).eqNullSafe(F.col("orig"))

    numeric = F.col("kind").isin("length", "angle", "radius", "diameter")
    status = (
        F.when(agree & F.col("v1").eqNullSafe(F.col("orig")), "consensus_unchanged").when(agree, "consensus_applied")
        .when(numeric & (disputes("v1") | disputes("v2")), "withheld").otherwise("unresolved")
    )
    return rows.select("record_id", status.alias("status"))


AGREE = " AND ".join(f"o.{name} IS NOT DISTINCT FROM p.{name}" for name in ("kind", "nominal", "upper", "lower", "unit", "is_reference"))


@query(
    "dimension_agreement",
    f"""SELECT o.record_id, CASE WHEN p.record_id IS NOT NULL THEN {AGREE} END AS agrees FROM ({PARSED}) o
       LEFT JOIN (SELECT * FROM ({PARSED.replace('{ocr_records}', '{rereads}')}) z WHERE view = 1 AND text IS NOT NULL) p ON o.record_id = p.record_id WHERE o.kind <> 'unknown'""",
)
def dimension_agreement(t):
    """Whether an outside reading has all fields of the local one; null where it gave none."""
    other = t("rereads").where("view = 1 and text is not null").select("record_id", F.col("text").alias("reread"))
    rows = t("ocr_records").select("record_id", "text").join(other, "record_id", "left")
    agrees = F.lit(True)
    for name in ("kind", "nominal", "upper", "lower", "unit", "is_reference"):
        agrees = agrees & F.col(f"a.{name}").eqNullSafe(F.col(f"b.{name}"))

    def read(pairs):
        local = text.with_dimension(pairs, out="a").where("a.kind <> 'unknown'")
        return text.with_dimension(local, "reread", "b").select("text", "reread", F.when(F.col("reread").isNotNull(), agrees).alias("agrees"))

    return text.once_per_text(rows, ["text", "reread"], read).select("record_id", "agrees")


@query(
    "unresolved_records",
    f"""SELECT record_id, CASE WHEN kind = 'angle' THEN 'angle_unbound' WHEN kind <> 'radius' OR NOT coalesce(nominal > 0, false) THEN 'source_radius_text_requires_review'
       WHEN attempts >= 2 THEN 'attempt_budget_exhausted' ELSE 'requested' END AS decision FROM (
       SELECT q.*, coalesce(a.tries, 0) AS attempts FROM ({PARSED}) q LEFT JOIN (SELECT record_id, count(*) AS tries FROM {{rereads}} WHERE text IS NOT NULL AND text LIKE 'R%' GROUP BY record_id) a USING (record_id)
       WHERE (kind = 'angle' OR n LIKE 'R%') AND record_id NOT IN (SELECT trial_id FROM {{trials}} WHERE reference_within)) s""",
)
def unresolved_records(t):
    attempts = t("rereads").where("text like 'R%'").groupBy("record_id").agg(F.count("*").alias("attempts"))
    bound = t("trials").where("reference_within").select(F.col("trial_id").alias("record_id"))
    kind, nominal = F.col("dimension.kind"), F.col("dimension.nominal")
    marked = F.replace(text.compatibility_form(F.col("text")), F.lit(" "), F.lit("")).startswith("R")
    rows = parsed(t).where((kind == "angle") | marked).join(bound, "record_id", "left_anti").join(attempts, "record_id", "left")
    decision = (
        F.when(kind == "angle", "angle_unbound")
        .when((kind != "radius") | ~F.coalesce(nominal > 0, F.lit(False)), "source_radius_text_requires_review")
        .when(F.coalesce("attempts", F.lit(0)) >= 2, "attempt_budget_exhausted")
        .otherwise("requested")
    )
    return rows.select("record_id", decision.alias("decision"))


# ---- layers, paths and identifiers ---------------------------------------------------------

define_input(
    "layers",
    """SELECT concat(case_id, ':', ord) AS entity_id, CASE ord % 9 WHEN 0 THEN 'GT_CLOSURE' WHEN 1 THEN 'construction_1' WHEN 2 THEN 'Dimension'
       WHEN 3 THEN 'soft_edge' WHEN 4 THEN 'TREAD_GOST_A_REF' WHEN 5 THEN 'CenterLine' WHEN 6 THEN 'datum-a' ELSE layer END AS layer, unit_code, sx, sy, ex, ey, length FROM {reference_lines}""",
)
LAYER = "(?i)(CONSTRUCTION|CONSTRUCT|DEBUG|MEASURE|DIMENSION|ANNOTATION|CENTERLINE|CENTRELINE|DATUM|GUIDE|HATCH|META)"


@query("profile_layer_filter", f"SELECT entity_id, layer FROM {{layers}} WHERE NOT regexp_matches(layer, '{LAYER}')")
def profile_layer_filter(t):
    return t("layers").where(text.is_profile_layer(F.col("layer"))).select("entity_id", "layer")


@query("assumed_layer_flag", "SELECT entity_id, regexp_matches(layer, '(?i)(CLOSURE|SIMPLIFIED|FALLBACK|SOFT|TREAD_GOST.*REF)') AS assumed FROM {layers}")
def assumed_layer_flag(t):
    return t("layers").select("entity_id", text.is_assumed_layer(F.col("layer")).alias("assumed"))


define_input(
    "paths",
    """SELECT doc_id, CASE doc_id % 8 WHEN 0 THEN concat('/', source, '/a.dxf') WHEN 1 THEN concat('C:', source) WHEN 2 THEN concat('ok/../', source)
       WHEN 3 THEN concat('a..b/', source) WHEN 4 THEN '' WHEN 5 THEN concat('old/__dataset/GT/', source, '.dxf')
       ELSE concat('vis/img_000', doc_id % 300, '-main/', lang, '.dxf') END AS path,
       CASE doc_id % 3 WHEN 0 THEN concat('solid__img_000', doc_id % 300) WHEN 1 THEN concat('AB-', doc_id % 300, '-main') ELSE concat('gt-', source) END AS name,
       concat('key sk-', source, '_', doc_id, ' used') AS note FROM {documents}""",
)


@query(
    "safe_relative_path",
    """SELECT doc_id, CASE WHEN path = '' THEN 'empty' WHEN path LIKE '/%' THEN 'absolute' WHEN path LIKE '%:%' THEN 'drive'
       WHEN list_contains(string_split(path, '/'), '..') THEN 'traversal' END AS problem FROM {paths}""",
)
def safe_relative_path(t):
    return t("paths").select("doc_id", text.path_problem(F.col("path")).alias("problem"))


@query(
    "case_token",
    """SELECT doc_id, CASE WHEN regexp_matches(name, 'img_0*[0-9]+') THEN regexp_extract(name, 'img_0*([0-9]+)', 1)
       ELSE replace(replace(lower(name), '-main', ''), '-', '') END AS token FROM {paths}""",
)
def case_token(t):
    return t("paths").select("doc_id", text.case_token(F.col("name")).alias("token"))


@query("legacy_path_remap", "SELECT doc_id, CASE WHEN path LIKE '%/__dataset/%' THEN string_split(path, '/__dataset/')[-1] ELSE path END AS path FROM {paths}")
def legacy_path_remap(t):
    return t("paths").select("doc_id", text.after_anchor(F.col("path")).alias("path"))


@query("redact_secrets", "SELECT doc_id, 'key [REDACTED] used' AS note FROM {paths}")
def redact_secrets(t):
    return t("paths").select("doc_id", text.redact(F.col("note")).alias("note"))
