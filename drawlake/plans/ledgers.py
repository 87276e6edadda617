"""Registered queries: batch forms of the ledgers; the same functions run on streams in the tests."""

from pyspark.sql import functions as F

from drawlake.plans.registry import query
from drawlake.streaming import ledgers


def events(t):
    return ledgers.job_events(t("events"))


@query(
    "job_event_stream",
    "SELECT event_id, job_id, revision, stage, status FROM {job_events}",
)
def job_event_stream(t):
    return events(t).select("event_id", "job_id", "revision", "stage", "status")


@query(
    "stage_windows",
    "SELECT strftime(date_trunc('day', ts), '%Y-%m-%d') AS day, stage, count(*) AS events, round(sum(value), 6) AS seconds FROM {job_events} GROUP BY 1, 2",
)
def stage_windows(t):
    rows = ledgers.stage_windows(events(t))
    return rows.select(F.date_format("start", "yyyy-MM-dd").alias("day"), "stage", "events", F.round("seconds", 6).alias("seconds"))


@query(
    "job_sessions",
    """SELECT job_id, count(*) AS sessions, CAST(sum(n) AS BIGINT) AS events, max(n) AS longest FROM (SELECT job_id, s, count(*) AS n FROM (
       SELECT job_id, sum(fresh) OVER (PARTITION BY job_id ORDER BY ts, event_id) AS s FROM (SELECT *, CASE WHEN lag(ts) OVER w IS NULL OR ts - lag(ts) OVER w >= INTERVAL 6 HOUR THEN 1 ELSE 0 END AS fresh
       FROM {job_events} WINDOW w AS (PARTITION BY job_id ORDER BY ts, event_id)) a) b GROUP BY 1, 2) c GROUP BY job_id""",
)
def job_sessions(t):
    return ledgers.job_sessions(events(t)).groupBy("job_id").agg(F.count("*").alias("sessions"), F.sum("events").alias("events"), F.max("events").alias("longest"))


@query("trial_ledger", "SELECT stage, count(*) AS calls, count(*) FILTER (status = 'failed') AS failed FROM {job_events} GROUP BY stage")
def trial_ledger(t):
    return ledgers.ledger_totals(events(t))


@query("receipt_dedup", "SELECT job_id, count(DISTINCT event_id) AS receipts FROM {job_events} GROUP BY 1")
def receipt_dedup(t):
    """The ledger read twice, as mirrored copies are, still counts every receipt once."""
    twice = events(t).unionByName(events(t))
    return twice.select("job_id", "event_id").distinct().groupBy("job_id").agg(F.count("*").alias("receipts"))


@query("attempt_budget", "SELECT job_id, stage, count(*) AS attempts, count(*) >= 2 AS deferred FROM {job_events} WHERE status = 'failed' GROUP BY 1, 2")
def attempt_budget(t):
    rows = events(t).where("status = 'failed'").groupBy("job_id", "stage").agg(F.count("*").alias("attempts"))
    return rows.withColumn("deferred", F.col("attempts") >= 2)


@query(
    "latest_revision",
    """SELECT job_id, max_by(revision, (revision, ts, event_id)) AS revision, max_by(status, (revision, ts, event_id)) AS status, bool_or(status = 'cancelled') AS cancelled FROM {job_events} GROUP BY job_id""",
)
def latest_revision(t):
    last = F.max(F.struct("revision", "ts", "event_id", "status")).alias("last")
    rows = events(t).groupBy("job_id").agg(last, F.bool_or(F.col("status") == ledgers.TERMINAL).alias("cancelled"))
    return rows.select("job_id", "last.revision", "last.status", "cancelled")


@query(
    "interrupted_jobs",
    """SELECT job_id, last_status, CASE WHEN last_status = 'running' AND last_ts < TIMESTAMP '2024-01-30 00:00:00' THEN 'interrupted' ELSE last_status END AS status
       FROM (SELECT job_id, max(ts) AS last_ts, max_by(status, (ts, event_id)) AS last_status FROM {job_events} GROUP BY 1) q""",
)
def interrupted_jobs(t):
    """A running job silent since the cutoff is interrupted; its pending call count stays unknown."""
    last = events(t).groupBy("job_id").agg(F.max(F.struct("ts", "event_id", "status")).alias("e"))
    silent = (F.col("e.status") == "running") & (F.col("e.ts") < F.lit("2024-01-30 00:00:00").cast("timestamp"))
    return last.select("job_id", F.col("e.status").alias("last_status"), F.when(silent, "interrupted").otherwise(F.col("e.status")).alias("status"))


@query(
    "conversation_log",
    """SELECT conv_id, count(*) FILTER (role IN ('user', 'assistant')) AS messages, count(*) FILTER (role = 'user') AS turn_count, count(*) FILTER (role NOT IN ('user', 'assistant')) AS refused,
       max(length(substr(text, 1, 4000))) AS longest, max(turn) AS last_turn FROM {conversations} GROUP BY conv_id""",
)
def conversation_log(t):
    """Messages of known roles, stored text of at most 4000 characters, user turns per conversation."""
    known = F.col("role").isin("user", "assistant")
    return t("conversations").groupBy("conv_id").agg(
        F.count_if(known).alias("messages"), F.count_if(F.col("role") == "user").alias("turn_count"), F.count_if(~known).alias("refused"),
        F.max(F.length(F.substring("text", 1, 4000))).alias("longest"), F.max("turn").alias("last_turn"),
    )


@query(
    "failure_answer_code",
    """SELECT attempt_id, CASE WHEN schema_success THEN NULL WHEN error_code IS NOT NULL THEN error_code WHEN http_success THEN 'schema_validation_failed'
       WHEN NOT http_success THEN 'transport_failure_without_code' ELSE 'stage_receipt_incomplete' END AS code FROM {receipts}""",
)
def failure_answer_code(t):
    code = F.coalesce(
        "error_code", F.when(F.col("http_success"), "schema_validation_failed").when(~F.col("http_success"), "transport_failure_without_code").otherwise("stage_receipt_incomplete")
    )
    failed = ~F.coalesce("schema_success", F.lit(False))
    return t("receipts").select("attempt_id", F.when(failed, code).alias("code"))


@query("token_usage_fields", "SELECT event_id, CAST(regexp_extract(props, '([0-9]+)', 1) AS BIGINT) AS k, NULL::BIGINT AS output_tokens FROM {events}")
def token_usage_fields(t):
    """Whitelisted integer counters of a JSON document; any other JSON type reads as absent."""
    usage = F.try_parse_json("props")
    return t("events").select(
        "event_id", F.try_variant_get(usage, "$.k", "bigint").alias("k"), F.try_variant_get(usage, "$.output_tokens", "bigint").alias("output_tokens")
    )


@query(
    "preflight_admissible",
    """SELECT attempt_id, CASE WHEN NOT coalesce(http_success, true) THEN false WHEN NOT coalesce(schema_success, true) THEN false WHEN error_code = 'rate_limited' THEN false
       ELSE coalesce(network_requests, 0) = 0 OR verdict = 'match' END AS admissible FROM {receipts}""",
)
def preflight_admissible(t):
    refused = (
        ~F.coalesce("http_success", F.lit(True)) | ~F.coalesce("schema_success", F.lit(True)) | F.coalesce(F.col("error_code") == "rate_limited", F.lit(False))
    )
    free = (F.coalesce("network_requests", F.lit(0)) == 0) | (F.col("verdict") == "match")
    return t("receipts").select("attempt_id", F.when(refused, False).otherwise(free).alias("admissible"))


@query(
    "page_merge_conflicts",
    """SELECT run_id, k, count(DISTINCT verdict || ':' || coalesce(error_code, '')) AS readings, CASE WHEN count(DISTINCT verdict || ':' || coalesce(error_code, '')) > 1 THEN 'conflicting_page_selections' ELSE min(verdict) END AS decision
       FROM (SELECT run_id, k % 20 AS k, verdict, error_code FROM {receipts} WHERE schema_success) s GROUP BY 1, 2""",
)
def page_merge_conflicts(t):
    """A record answered differently on two verified pages is a conflict, never last write wins."""
    reading = F.concat_ws(":", "verdict", F.coalesce("error_code", F.lit("")))
    rows = t("receipts").where("schema_success").select("run_id", (F.col("k") % 20).alias("k"), "verdict", reading.alias("reading"))
    merged = rows.groupBy("run_id", "k").agg(F.count_distinct("reading").alias("readings"), F.min("verdict").alias("first"))
    return merged.select("run_id", "k", "readings", F.when(F.col("readings") > 1, "conflicting_page_selections").otherwise(F.col("first")).alias("decision"))
