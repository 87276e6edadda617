"""Registered queries: evaluation reports, receipts, rankings and set operations."""

from pyspark.sql import functions as F

from drawlake.operators import prefix, quantiles, report
from drawlake.plans.registry import define_input, query

EXPECTED = 4

CASE_ROWS = """SELECT case_id, true AS attempted, count(*) AS trial_count,
  CASE WHEN count(*) = 4 AND bool_and(status = 'completed') THEN 'completed' WHEN count(*) = 4 THEN 'failed' ELSE 'running' END AS status,
  count(*) = 4 AND bool_and(artifact_completed) AS artifact_completed, count(*) = 4 AND bool_and(geometry_valid) AS geometry_valid,
  count(*) = 4 AND bool_and(scaled_mm) AS scaled_mm, bool_or(manual_intervention) AS manual_intervention,
  bool_or(reference_compared) AS reference_compared,
  count(*) = 4 AND bool_and(coalesce(reference_within, false)) AS reference_within,
  max_by(alignment_kind, (repeat, trial_id)) AS alignment_kind, sum(elapsed_seconds) AS elapsed_seconds
  FROM {trials} GROUP BY case_id"""
JOINED = f"""SELECT c.case_id, c.split, coalesce(r.attempted, false) AS attempted, coalesce(r.status, 'not_attempted') AS status,
  coalesce(artifact_completed, false) AS artifact_completed, coalesce(geometry_valid, false) AS geometry_valid,
  coalesce(scaled_mm, false) AS scaled_mm, coalesce(manual_intervention, false) AS manual_intervention,
  coalesce(reference_compared, false) AS reference_compared, coalesce(reference_within, false) AS reference_within, alignment_kind,
  trial_count, elapsed_seconds FROM {{catalog}} c LEFT JOIN ({CASE_ROWS}) r USING (case_id)"""


def joined(t):
    return report.catalog_results(t("catalog"), report.case_repeats(t("trials"), EXPECTED))


@query("case_repeat_rollup", f"SELECT * EXCLUDE (elapsed_seconds), round(elapsed_seconds, 6) AS elapsed_seconds FROM ({CASE_ROWS}) q")
def case_repeat_rollup(t):
    return report.case_repeats(t("trials"), EXPECTED).withColumn("elapsed_seconds", F.round("elapsed_seconds", 6))


@query("catalog_left_join", f"SELECT * EXCLUDE (elapsed_seconds), round(elapsed_seconds, 6) AS elapsed_seconds FROM ({JOINED}) q")
def catalog_left_join(t):
    return joined(t).withColumn("elapsed_seconds", F.round("elapsed_seconds", 6))


@query(
    "evaluation_summary",
    f"""SELECT *, total - attempted AS not_attempted, round(auto_generated / total, 6) AS auto_generated_rate,
  round(geometry_valid / total, 6) AS geometry_valid_rate, round(reference_within / total, 6) AS reference_within_rate,
  round(autonomous_within / total, 6) AS autonomous_within_rate FROM (
  SELECT coalesce(split, 'overall') AS scope, count(*) AS total, count(*) FILTER (attempted) AS attempted,
  count(*) FILTER (attempted AND artifact_completed) AS artifact_completed,
  count(*) FILTER (attempted AND artifact_completed AND NOT manual_intervention) AS auto_generated,
  count(*) FILTER (attempted AND geometry_valid) AS geometry_valid,
  count(*) FILTER (attempted AND artifact_completed AND scaled_mm) AS scaled_mm,
  count(*) FILTER (attempted AND reference_compared) AS reference_compared,
  count(*) FILTER (attempted AND reference_compared AND reference_within AND geometry_valid AND scaled_mm) AS reference_within,
  count(*) FILTER (attempted AND reference_compared AND reference_within AND geometry_valid AND scaled_mm AND NOT manual_intervention) AS autonomous_within,
  count(*) FILTER (manual_intervention) AS manual_interventions,
  count(*) FILTER (attempted AND reference_within AND alignment_kind = 'shape_diagnostic') AS searched_matches
  FROM ({JOINED}) j GROUP BY GROUPING SETS ((), (split))) s""",
)
def evaluation_summary(t):
    return report.evaluation_counts(joined(t))


@query(
    "status_histogram",
    f"SELECT split, status, count(*) AS n FROM ({JOINED}) j GROUP BY split, status",
)
def status_histogram(t):
    return joined(t).groupBy("split", "status").agg(F.count("*").alias("n"))


@query(
    "rate_columns",
    """SELECT template, total, round(ok / total, 6) AS frozen_rate,
       CASE WHEN unknown = 0 THEN round(ok / total, 6) END AS known_rate, unknown FROM (
       SELECT c.template, count(*) AS total, count(*) FILTER (t.reference_within) AS ok,
       count(*) FILTER (t.reference_within IS NULL) AS unknown
       FROM {catalog} c LEFT JOIN {trials} t USING (case_id) GROUP BY c.template) s""",
)
def rate_columns(t):
    rows = t("catalog").join(t("trials"), "case_id", "left")
    counted = rows.groupBy("template").agg(
        F.count("*").alias("total"),
        report.count_true("reference_within").alias("ok"),
        F.count_if(F.col("reference_within").isNull()).alias("unknown"),
    )
    return counted.select(
        "template", "total", "unknown",
        F.round(report.frozen_rate(F.col("ok"), F.col("total")), 6).alias("frozen_rate"),
        F.round(report.known_rate(F.col("ok"), F.col("total"), F.col("unknown")), 6).alias("known_rate"),
    )


@query(
    "strict_gate",
    f"""SELECT split, count(*) AS cases, count(*) FILTER (attempted) AS attempted_cases,
       bool_and(attempted AND status = 'completed' AND reference_within AND NOT manual_intervention) AS whole_scope_passed,
       coalesce(bool_and(status = 'completed' AND reference_within AND NOT manual_intervention) FILTER (attempted), false) AS requested_scope_passed,
       count(*) FILTER (attempted AND status = 'completed' AND reference_within AND NOT manual_intervention) AS passed_cases
       FROM ({JOINED}) j GROUP BY split""",
)
def strict_gate(t):
    passed = (F.col("status") == "completed") & F.col("reference_within") & ~F.col("manual_intervention")
    return joined(t).groupBy("split").agg(
        F.count("*").alias("cases"),
        F.count_if("attempted").alias("attempted_cases"),
        F.bool_and(F.col("attempted") & passed).alias("whole_scope_passed"),
        F.coalesce(F.bool_and(F.when(F.col("attempted"), passed)), F.lit(False)).alias("requested_scope_passed"),
        F.count_if(F.col("attempted") & passed).alias("passed_cases"),
    )


@query(
    "transport_summary",
    """SELECT * EXCLUDE (known_retries), CASE WHEN http_unknown = 0 THEN round(http_successful / calls, 6) END AS http_rate,
       CASE WHEN schema_unknown = 0 THEN round(schema_successful / calls, 6) END AS schema_rate,
       CASE WHEN missing_counts = 0 THEN known_total END AS attempts_total,
       CASE WHEN missing_counts = 0 THEN known_retries END AS retries FROM (
       SELECT run_id, stage, count(*) AS calls, count(*) FILTER (http_success) AS http_successful,
       count(*) FILTER (http_success IS NULL) AS http_unknown, count(*) FILTER (schema_success) AS schema_successful,
       count(*) FILTER (schema_success IS NULL) AS schema_unknown, count(*) FILTER (network_requests IS NULL) AS missing_counts,
       CAST(coalesce(sum(network_requests), 0) AS BIGINT) AS known_total, count(*) FILTER (network_requests > 0) AS calls_with_attempts,
       CAST(coalesce(sum(greatest(0, network_requests - 1)) FILTER (network_requests IS NOT NULL), 0) AS BIGINT) AS known_retries,
       count(*) FILTER (verdict = 'match') AS verdict_match, count(*) FILTER (verdict = 'mismatch') AS verdict_mismatch,
       count(*) FILTER (verdict = 'uncertain') AS verdict_uncertain FROM {receipts} GROUP BY run_id, stage) s""",
)
def transport_summary(t):
    return report.transport_counts(t("receipts"), ["run_id", "stage"])


@query(
    "binding_attempt_summary",
    """SELECT run_id, count(*) AS attempt_count, CAST(coalesce(sum(network_requests), 0) AS BIGINT) AS known_network_requests,
       count(*) FILTER (network_requests IS NULL) AS unknown_request_count_attempts,
       count(*) FILTER (http_success) AS http_successful_attempts, count(*) FILTER (NOT http_success) AS http_failed_attempts,
       count(*) FILTER (schema_success) AS schema_successful_attempts FROM {receipts} GROUP BY run_id""",
)
def binding_attempt_summary(t):
    return t("receipts").groupBy("run_id").agg(
        F.count("*").alias("attempt_count"),
        F.coalesce(F.sum("network_requests"), F.lit(0)).alias("known_network_requests"),
        F.count_if(F.col("network_requests").isNull()).alias("unknown_request_count_attempts"),
        report.count_true("http_success").alias("http_successful_attempts"),
        F.count_if(~F.coalesce("http_success", F.lit(True))).alias("http_failed_attempts"),
        report.count_true("schema_success").alias("schema_successful_attempts"),
    )


@query(
    "distribution",
    """SELECT stage, count(elapsed_seconds) AS count, min(elapsed_seconds) AS minimum, max(elapsed_seconds) AS maximum,
       round(quantile_cont(elapsed_seconds, 0.05), 6) AS p05, round(quantile_cont(elapsed_seconds, 0.5), 6) AS median,
       round(quantile_cont(elapsed_seconds, 0.95), 6) AS p95 FROM {receipts} GROUP BY stage""",
)
def distribution(t):
    wanted = {"p05": 0.05, "median": 0.5, "p95": 0.95}
    rows = quantiles.group_quantiles(t("receipts"), ["stage"], "elapsed_seconds", wanted)
    return rows.withColumns({name: F.round(name, 6) for name in wanted})


@query(
    "coverage_report",
    """SELECT coalesce(template, 'all') AS scope, count(*) AS total, count(*) FILTER (t.artifact_completed) AS readable,
       count(*) FILTER (t.scaled_mm) AS scaled, count(*) FILTER (t.geometry_valid) AS valid,
       count(*) FILTER (t.status = 'failed') AS failures, count(*) FILTER (t.case_id IS NULL) AS missing
       FROM {catalog} c LEFT JOIN {trials} t ON c.case_id = t.case_id GROUP BY GROUPING SETS ((), (template))""",
)
def coverage_report(t):
    rows = t("catalog").join(t("trials"), "case_id", "left")
    return (
        rows.groupingSets([[], ["template"]], "template")
        .agg(
            F.count("*").alias("total"),
            report.count_true("artifact_completed").alias("readable"),
            report.count_true("scaled_mm").alias("scaled"),
            report.count_true("geometry_valid").alias("valid"),
            F.count_if(F.col("status") == "failed").alias("failures"),
            F.count_if(F.col("trial_id").isNull()).alias("missing"),
        )
        .select(F.coalesce("template", F.lit("all")).alias("scope"), "total", "readable", "scaled", "valid", "failures", "missing")
    )


@query(
    "ablation_means",
    """SELECT alignment_kind, round(avg(elapsed_seconds), 6) AS raw_mean, count(elapsed_seconds) AS raw_defined,
       round(avg(CASE WHEN reference_within THEN elapsed_seconds END), 6) AS refined_mean,
       count(CASE WHEN reference_within THEN elapsed_seconds END) AS refined_defined, count(*) AS cases
       FROM {trials} GROUP BY alignment_kind""",
)
def ablation_means(t):
    refined = F.when(report.is_true("reference_within"), F.col("elapsed_seconds"))
    return t("trials").groupBy("alignment_kind").agg(
        F.round(F.avg("elapsed_seconds"), 6).alias("raw_mean"),
        F.count("elapsed_seconds").alias("raw_defined"),
        F.round(F.avg(refined), 6).alias("refined_mean"),
        F.count(refined).alias("refined_defined"),
        F.count("*").alias("cases"),
    )


@query(
    "parameter_accuracy",
    """SELECT split, CAST(sum(correct) AS BIGINT) AS correct, CAST(sum(scored) AS BIGINT) AS scored,
       round(sum(correct) / sum(scored), 6) AS accuracy FROM (
       SELECT c.split, CASE WHEN t.reference_within IS NOT NULL THEN CASE WHEN t.reference_within THEN t.repeat ELSE 0 END END AS correct,
       CASE WHEN t.reference_within IS NOT NULL THEN t.repeat END AS scored
       FROM {catalog} c LEFT JOIN {trials} t USING (case_id)) s GROUP BY split""",
)
def parameter_accuracy(t):
    scored = F.when(F.col("reference_within").isNotNull(), F.col("repeat"))
    correct = F.when(F.col("reference_within"), F.col("repeat"))
    rows = t("catalog").join(t("trials"), "case_id", "left").groupBy("split")
    return rows.agg(
        F.sum(F.when(F.col("reference_within").isNotNull(), F.coalesce(correct, F.lit(0)))).alias("correct"),
        F.sum(scored).alias("scored"),
    ).withColumn("accuracy", F.round(F.try_divide("correct", "scored"), 6))


@query(
    "version_compare",
    """SELECT *, CASE WHEN same_inputs AND prev_seconds IS NOT NULL THEN round(seconds - prev_seconds, 6) END AS delta FROM (
       SELECT v.version, v.case_id, coalesce(status, 'not_run') AS status, round(seconds, 6) AS seconds, source_id,
       round(lag(seconds) OVER w, 6) AS prev_seconds, coalesce(source_id = lag(source_id) OVER w, false) AS same_inputs
       FROM (SELECT case_id, unnest([1, 2, 3]) AS version FROM {catalog}) v LEFT JOIN (
         SELECT case_id, repeat % 3 + 1 AS version, max_by(status, (repeat, trial_id)) AS status,
         max_by(elapsed_seconds, (repeat, trial_id)) AS seconds, max_by(source_id % 2, (repeat, trial_id)) AS source_id
         FROM {trials} GROUP BY 1, 2) l ON l.case_id = v.case_id AND l.version = v.version
       WINDOW w AS (PARTITION BY v.case_id ORDER BY v.version)) s""",
)
def version_compare(t):
    """Latest attempt per (case, version), never the best; missing slots stay as not run."""
    latest = (
        t("trials")
        .groupBy("case_id", (F.col("repeat") % 3 + 1).alias("version"))
        .agg(F.max_by(F.struct("status", "elapsed_seconds", (F.col("source_id") % 2).alias("source_id")), F.struct("repeat", "trial_id")).alias("last"))
    )
    # A case has three slots at most, so one row per case holds them all.
    slots = latest.groupBy("case_id").agg(F.map_from_entries(F.collect_list(F.struct("version", "last"))).alias("runs"))
    rows = t("catalog").select("case_id").join(slots, "case_id", "left").select(
        "case_id", "runs", F.explode(F.array(F.lit(1), F.lit(2), F.lit(3))).alias("version")
    )
    current, before = F.try_element_at("runs", F.col("version")), F.try_element_at("runs", F.col("version") - 1)
    rows = rows.select(
        "version", "case_id",
        F.coalesce(current["status"], F.lit("not_run")).alias("status"),
        F.round(current["elapsed_seconds"], 6).alias("seconds"),
        current["source_id"].alias("source_id"),
        F.round(before["elapsed_seconds"], 6).alias("prev_seconds"),
        F.coalesce(current["source_id"] == before["source_id"], F.lit(False)).alias("same_inputs"),
        F.round(current["elapsed_seconds"] - before["elapsed_seconds"], 6).alias("change"),
    )
    return rows.withColumn("delta", F.when(F.col("same_inputs"), F.col("change"))).drop("change")


@query(
    "page_coverage",
    """SELECT run_id, count(DISTINCT stage) AS pages, count(*) AS eligible, count(*) FILTER (network_requests > 0) AS sent,
       count(*) FILTER (schema_success) AS answered, count(DISTINCT stage) FILTER (http_success) AS pages_succeeded,
       count(*) FILTER (coalesce(network_requests, 0) = 0) AS not_sent FROM {receipts} GROUP BY run_id""",
)
def page_coverage(t):
    return t("receipts").groupBy("run_id").agg(
        F.count_distinct("stage").alias("pages"),
        F.count("*").alias("eligible"),
        F.count_if(F.col("network_requests") > 0).alias("sent"),
        report.count_true("schema_success").alias("answered"),
        F.count_distinct(F.when(report.is_true("http_success"), F.col("stage"))).alias("pages_succeeded"),
        F.count_if(F.coalesce("network_requests", F.lit(0)) == 0).alias("not_sent"),
    )


@query(
    "corpus_counts",
    """SELECT count(*) AS total, count(*) FILTER (paired) AS paired, count(*) FILTER (NOT paired) AS missing_ocr,
       count(*) FILTER (template = 'F') AS supported, count(*) FILTER (split = 'calibration') AS calibration,
       count(*) FILTER (split = 'holdout') AS holdout FROM (
       SELECT c.*, EXISTS (SELECT 1 FROM {trials} t WHERE t.case_id = c.case_id) AS paired FROM {catalog} c) s""",
)
def corpus_counts(t):
    paired = t("trials").select("case_id").distinct().withColumn("paired", F.lit(True))
    return t("catalog").join(paired, "case_id", "left").agg(
        F.count("*").alias("total"),
        report.count_true("paired").alias("paired"),
        F.count_if(F.col("paired").isNull()).alias("missing_ocr"),
        F.count_if(F.col("template") == "F").alias("supported"),
        F.count_if(F.col("split") == "calibration").alias("calibration"),
        F.count_if(F.col("split") == "holdout").alias("holdout"),
    )


@query(
    "split_counts",
    """SELECT split, count(*) AS total, count(*) FILTER (state = 'ready') AS ready, count(*) FILTER (state = 'failed') AS failed,
       count(DISTINCT group_id) AS groups FROM {manifest} GROUP BY split""",
)
def split_counts(t):
    return t("manifest").groupBy("split").agg(
        F.count("*").alias("total"),
        F.count_if(F.col("state") == "ready").alias("ready"),
        F.count_if(F.col("state") == "failed").alias("failed"),
        F.count_distinct("group_id").alias("groups"),
    )


# ---- candidate ranking ---------------------------------------------------------------------

define_input(
    "candidates",
    """SELECT l_orderkey AS case_id,
       concat(l_orderkey, '-', l_linenumber, '-', l_partkey, '-', l_suppkey, '-', CAST(round(l_extendedprice * 100) AS BIGINT)) AS candidate_id,
       l_linestatus = 'F' AS closed, l_returnflag <> 'R' AS simple, l_suppkey % 10 <> 0 AS source_only,
       l_quantity / 50 AS support, CASE WHEN l_partkey % 17 = 0 THEN NULL ELSE l_discount * 10 END AS coverage,
       l_linenumber + 3 AS entity_count, l_suppkey % 4 AS unsupported,
       l_tax AS p90, l_extendedprice / 1000 AS deviation, l_partkey % 50 AS geometry_key, l_linenumber AS attempt
       FROM {lineitem}""",
)
SCORED = """SELECT *, CASE WHEN reasons = '' THEN round(0.5 * coverage + 0.3 * support + 0.2 * (1 - unsupported / entity_count), 9) END AS score FROM (
  SELECT *, concat_ws(',', CASE WHEN NOT closed THEN 'closed_validation_failed' END, CASE WHEN NOT simple THEN 'simple_validation_failed' END,
  CASE WHEN NOT source_only THEN 'source_only_provenance_missing' END, CASE WHEN support < 0.55 THEN 'insufficient_source_boundary_support' END,
  CASE WHEN coverage IS NULL THEN 'invalid_annotation_coverage' END,
  CASE WHEN unsupported > entity_count THEN 'invalid_unsupported_primitive_count' END) AS reasons FROM {candidates}) s"""


def round_binary(value, digits):
    """The binary value rounded, as SQL does: 0.575 * 100 is below 57.5, while F.round with digits takes the decimal ones.

    A value too large to be scaled has no digits to round and stays.
    """
    scaled = value * 10.0**digits
    return F.when(F.abs(scaled) == float("inf"), value).otherwise(F.round(scaled) / 10.0**digits)


def scored(t):
    """Hard reasons first; only an admissible candidate gets a score."""
    reasons = F.concat_ws(
        ",",
        F.when(~F.col("closed"), "closed_validation_failed"),
        F.when(~F.col("simple"), "simple_validation_failed"),
        F.when(~F.col("source_only"), "source_only_provenance_missing"),
        F.when(F.col("support") < 0.55, "insufficient_source_boundary_support"),
        F.when(F.col("coverage").isNull(), "invalid_annotation_coverage"),
        F.when(F.col("unsupported") > F.col("entity_count"), "invalid_unsupported_primitive_count"),
    )
    value = 0.5 * F.col("coverage") + 0.3 * F.col("support") + 0.2 * (1 - F.col("unsupported") / F.col("entity_count"))
    return t("candidates").withColumn("reasons", reasons).withColumn("score", F.when(F.col("reasons") == "", round_binary(value, 9)))


@query("candidate_score", f"SELECT candidate_id, reasons, score FROM ({SCORED}) q")
def candidate_score(t):
    return scored(t).select("candidate_id", "reasons", "score")


@query(
    "score_rank",
    f"""SELECT case_id, candidate_id, rank FROM (SELECT *, row_number() OVER (PARTITION BY case_id ORDER BY round(score, 2) DESC, unsupported,
       coverage DESC, entity_count, candidate_id) AS rank FROM ({SCORED}) q WHERE score IS NOT NULL) r WHERE rank <= 5""",
)
def score_rank(t):
    order = [round_binary(F.col("score"), 2).desc(), F.col("unsupported"), F.col("coverage").desc(), F.col("entity_count"), F.col("candidate_id")]
    ranked = report.top_per_group(scored(t).where(F.col("score").isNotNull()), ["case_id"], order, 5)
    return ranked.select("case_id", "candidate_id", "rank")


@query(
    "pareto_improves",
    """SELECT c.candidate_id, (c.deviation - i.deviation <= 1e-6 AND c.support - i.support >= -1e-6 AND c.p90 - i.p90 <= 1e-6
       AND (c.deviation - i.deviation < -1e-4 OR c.support - i.support > 1e-4 OR c.p90 - i.p90 < -1e-4)) AS improves
       FROM {candidates} c JOIN (SELECT case_id, min_by(deviation, (attempt, candidate_id)) AS deviation,
       min_by(support, (attempt, candidate_id)) AS support, min_by(p90, (attempt, candidate_id)) AS p90
       FROM {candidates} GROUP BY case_id) i USING (case_id)""",
)
def pareto_improves(t):
    """No worse on three source metrics than the case's first candidate and better on one."""
    rows = t("candidates")
    incumbent = rows.groupBy("case_id").agg(
        F.min_by(F.struct("deviation", "support", "p90"), F.struct("attempt", "candidate_id")).alias("i")
    )
    d = F.col("deviation") - F.col("i.deviation")
    s = F.col("support") - F.col("i.support")
    p = F.col("p90") - F.col("i.p90")
    improves = (d <= 1e-6) & (s >= -1e-6) & (p <= 1e-6) & ((d < -1e-4) | (s > 1e-4) | (p < -1e-4))
    return rows.join(incumbent, "case_id").select("candidate_id", improves.alias("improves"))


PRIORITY = """NOT closed, (CASE WHEN closed THEN entity_count ELSE 0 END) DESC, coverage DESC NULLS LAST, unsupported,
  CASE WHEN closed THEN p90 END ASC NULLS LAST, deviation, candidate_id"""


def priority():
    """Admission, verified records, coverage, structure, freedom, error, then the id."""
    closed = F.col("closed")
    return [
        (~closed).asc(),
        F.when(closed, F.col("entity_count")).otherwise(0).desc(),
        F.col("coverage").desc_nulls_last(),
        F.col("unsupported").asc(),
        F.when(closed, F.col("p90")).asc_nulls_last(),
        F.col("deviation").asc(),
        F.col("candidate_id").asc(),
    ]


@query(
    "candidate_priority",
    f"SELECT * FROM (SELECT case_id, candidate_id, row_number() OVER (PARTITION BY case_id ORDER BY {PRIORITY}) AS rank FROM {{candidates}}) q",
)
def candidate_priority(t):
    """Every candidate of a case by its priority."""
    return prefix.rank_all(t("candidates"), ["case_id"], priority()).select("case_id", "candidate_id", "rank")


@query(
    "retain_distinct",
    f"""SELECT case_id, candidate_id, rank FROM (SELECT *, row_number() OVER (PARTITION BY case_id ORDER BY {PRIORITY}) AS rank FROM (
       SELECT *, row_number() OVER (PARTITION BY case_id, geometry_key % 3 ORDER BY {PRIORITY}) AS dup FROM {{candidates}}) d WHERE dup = 1) q WHERE rank <= 3""",
)
def retain_distinct(t):
    """Best candidate per geometry first, then the best three geometries of the case."""
    shaped = t("candidates").withColumn("shape", F.col("geometry_key") % 3)
    best = report.top_per_group(shaped, ["case_id", "shape"], priority(), 1, "dup")
    return report.top_per_group(best, ["case_id"], priority(), 3).select("case_id", "candidate_id", "rank")


@query(
    "preflight_order",
    """SELECT case_id, candidate_id, rank FROM (SELECT *, row_number() OVER (PARTITION BY case_id ORDER BY
       CASE WHEN angular_slot THEN 0 WHEN combined_slot THEN 1 WHEN closed THEN 2 ELSE 3 END,
       CASE WHEN closed AND NOT angular_slot AND NOT combined_slot THEN unsupported ELSE 0 END DESC, attempt, candidate_id) AS rank FROM (
       SELECT c.*, c.candidate_id = coalesce(f.angular, '') AS angular_slot, c.candidate_id = coalesce(f.combined, '') AS combined_slot
       FROM {candidates} c JOIN (SELECT case_id,
       min_by(candidate_id, (attempt, candidate_id)) FILTER (closed AND geometry_key % 5 = 0) AS angular,
       min_by(candidate_id, (attempt, candidate_id)) FILTER (closed AND geometry_key % 5 = 1) AS combined
       FROM {candidates} GROUP BY case_id) f USING (case_id)) s) q""",
)
def preflight_order(t):
    """First angular and first combined repair get reserved slots; the rest follow by repair count."""
    rows = t("candidates")
    place = F.struct("attempt", "candidate_id")
    angular = F.col("closed") & (F.col("geometry_key") % 5 == 0)
    combined = F.col("closed") & (F.col("geometry_key") % 5 == 1)
    slots = rows.groupBy("case_id").agg(
        F.min_by(F.when(angular, F.col("candidate_id")), F.when(angular, place)).alias("angular"),
        F.min_by(F.when(combined, F.col("candidate_id")), F.when(combined, place)).alias("combined"),
    )
    sized, rows = rows, rows.join(slots, "case_id")
    is_angular = F.coalesce(F.col("candidate_id") == F.col("angular"), F.lit(False))
    is_combined = F.coalesce(F.col("candidate_id") == F.col("combined"), F.lit(False))
    tier = F.when(is_angular, 0).when(is_combined, 1).when(F.col("closed"), 2).otherwise(3)
    order = [tier.asc(), F.when(tier == 2, F.col("unsupported")).otherwise(0).desc(), F.col("attempt").asc(), F.col("candidate_id").asc()]
    return prefix.rank_all(rows, ["case_id"], order, sized=sized).select("case_id", "candidate_id", "rank")


@query(
    "profile_rank",
    """SELECT source, case_id, name FROM (SELECT source, doc_id AS case_id, concat(lang, '_v', n_chars % 7, CASE WHEN doc_id % 3 = 0 THEN '_profile' ELSE '' END,
       CASE WHEN doc_id % 5 = 0 THEN '_scored_only' ELSE '' END) AS name, n_chars % 7 AS version,
       row_number() OVER (PARTITION BY source ORDER BY doc_id % 5 = 0, doc_id % 3 <> 0, n_chars % 7 DESC, doc_id) AS rank FROM {documents}) q WHERE rank = 1""",
)
def profile_rank(t):
    """Complete references before partial ones, named profiles first, highest version, then the id."""
    partial, named = F.col("doc_id") % 5 == 0, F.col("doc_id") % 3 == 0
    name = F.concat(
        "lang", F.lit("_v"), F.col("n_chars") % 7, F.when(named, "_profile").otherwise(""), F.when(partial, "_scored_only").otherwise("")
    )
    files = t("documents").select("source", F.col("doc_id").alias("case_id"), name.alias("name"))
    versions = F.transform(F.regexp_extract_all("name", F.lit(r"_v(\d+)"), F.lit(1)), lambda v: v.cast("int"))
    key = F.struct(
        (~F.col("name").contains("_scored_only")).alias("complete"),
        F.col("name").contains("profile").alias("named"),
        F.array_max(versions).alias("version"),
        (-F.col("case_id")).alias("first_id"),
    )
    return files.groupBy("source").agg(F.max_by(F.struct("case_id", "name"), key).alias("best")).select("source", "best.*")


@query(
    "recent_jobs",
    """SELECT job_id, revision, status, last_event FROM (SELECT *, row_number() OVER (ORDER BY ts DESC, event_id DESC) AS r FROM (
       SELECT job_id, max_by(revision, (ts, event_id)) AS revision, max_by(status, (ts, event_id)) AS status, max(ts) AS ts,
       max_by(event_id, (ts, event_id)) AS event_id, max_by(event_id, (ts, event_id)) AS last_event
       FROM {job_events} GROUP BY job_id) s) q WHERE r <= 20""",
)
def recent_jobs(t):
    latest = t("job_events").groupBy("job_id").agg(F.max(F.struct("ts", "event_id", "revision", "status")).alias("last"))
    return latest.select("job_id", "last.*").orderBy(F.desc("ts"), F.desc("event_id")).limit(20).select(
        "job_id", "revision", "status", F.col("event_id").alias("last_event")
    )


@query(
    "issue_cap",
    """SELECT case_id, issue, trial_id, issue_count FROM (SELECT case_id, issue, trial_id, count(*) OVER (PARTITION BY case_id) AS issue_count,
       row_number() OVER (PARTITION BY case_id ORDER BY issue, trial_id) AS r FROM (
       SELECT case_id, trial_id, 'artifact_missing' AS issue FROM {trials} WHERE NOT artifact_completed
       UNION ALL SELECT case_id, trial_id, 'geometry_invalid' FROM {trials} WHERE NOT geometry_valid
       UNION ALL SELECT case_id, trial_id, 'unit_unknown' FROM {trials} WHERE NOT scaled_mm) u) q WHERE r <= 64""",
)
def issue_cap(t, shown_issues: int = 64):
    """The report shows the first ``shown_issues`` of a case beside the true count."""
    rows = t("trials")
    issues = F.array_compact(
        F.array(
            F.when(~F.col("artifact_completed"), "artifact_missing"),
            F.when(~F.col("geometry_valid"), "geometry_invalid"),
            F.when(~F.col("scaled_mm"), "unit_unknown"),
        )
    )
    exploded = rows.select("case_id", "trial_id", F.explode(issues).alias("issue"))
    totals = exploded.groupBy("case_id").agg(F.count("*").alias("issue_count"))
    shown = report.top_per_group(exploded, ["case_id"], [F.col("issue"), F.col("trial_id")], shown_issues)
    return shown.join(totals, "case_id").select("case_id", "issue", "trial_id", "issue_count")


# ---- set operations ------------------------------------------------------------------------


@query(
    "receipt_union",
    """SELECT run_id, stage, k, min(attempt_id) AS attempt_id FROM (SELECT * FROM {receipts} WHERE stage IN ('click', 'view')
       UNION ALL SELECT * FROM {receipts} WHERE stage IN ('view', 'purchase')) u GROUP BY run_id, stage, k""",
)
def receipt_union(t):
    """Mirrored winners of two ledgers count once, by identity and not by content."""
    rows = t("receipts").select("run_id", "stage", "k", "attempt_id")
    both = rows.where(F.col("stage").isin("click", "view")).unionByName(rows.where(F.col("stage").isin("view", "purchase")))
    return both.groupBy("run_id", "stage", "k").agg(F.min("attempt_id").alias("attempt_id"))


@query(
    "lost_ids",
    "SELECT DISTINCT part_id FROM {trials} WHERE repeat = 1 EXCEPT SELECT part_id FROM {trials} WHERE repeat = 2",
)
def lost_ids(t):
    rows = t("trials")
    before = rows.where(F.col("repeat") == 1).select("part_id").distinct()
    return before.join(rows.where(F.col("repeat") == 2).select("part_id").distinct(), "part_id", "left_anti")


@query(
    "adjacency_multiset",
    """SELECT case_id, bool_and(a = b) AS same FROM (SELECT case_id, part_id % 10 AS k, count(*) FILTER (repeat % 2 = 0) AS a,
       count(*) FILTER (repeat % 2 = 1) AS b FROM {trials} GROUP BY 1, 2) s GROUP BY case_id""",
)
def adjacency_multiset(t):
    """Two multisets agree when every element has the same count on both sides."""
    counted = t("trials").groupBy("case_id", (F.col("part_id") % 10).alias("k")).agg(
        F.count_if(F.col("repeat") % 2 == 0).alias("a"), F.count_if(F.col("repeat") % 2 == 1).alias("b")
    )
    return counted.groupBy("case_id").agg(F.bool_and(F.col("a") == F.col("b")).alias("same"))


@query(
    "unknown_cases",
    """SELECT case_id, 'outside_catalog' AS problem, count(*) AS n FROM {trials} WHERE case_id NOT IN (SELECT case_id FROM {catalog} WHERE template <> 'P') GROUP BY case_id
       UNION ALL SELECT case_id, 'duplicate_repeat', count(*) FROM {trials} GROUP BY case_id, repeat HAVING count(*) > 2""",
)
def unknown_cases(t):
    trials = t("trials")
    known = t("catalog").where(F.col("template") != "P").select("case_id")
    outside = trials.join(known, "case_id", "left_anti").groupBy("case_id").agg(F.count("*").alias("n"))
    repeated = trials.groupBy("case_id", "repeat").agg(F.count("*").alias("n")).where("n > 2")
    return outside.select("case_id", F.lit("outside_catalog").alias("problem"), "n").unionByName(
        repeated.select("case_id", F.lit("duplicate_repeat").alias("problem"), "n")
    )


@query(
    "distinct_ordered",
    """SELECT doc_id, CASE WHEN len(w) = 0 THEN '' ELSE array_to_string(w[1:8], ' ') END AS ids FROM (
       SELECT doc_id, list_transform(list_filter(list_zip(ws, range(1, len(ws) + 1)), lambda p: list_position(ws, p[1]) = p[2]), lambda p: p[1]) AS w FROM (
       SELECT doc_id, list_filter(string_split(text, ' '), lambda x: regexp_full_match(x, '[A-Za-z][A-Za-z0-9_.-]*')) AS ws FROM {documents}) a) b""",
)
def distinct_ordered(t, first: int = 8):
    """The ``first`` distinct well-formed identifiers of a list, in order of appearance."""
    words = F.filter(F.split("text", " "), lambda w: w.rlike(r"\A[A-Za-z][A-Za-z0-9_.-]*\z"))
    return t("documents").select("doc_id", F.concat_ws(" ", F.slice(F.array_distinct(words), 1, first)).alias("ids"))
