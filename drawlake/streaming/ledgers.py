"""Structured Streaming forms of the job, receipt and conversation ledgers."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

JOB_EVENTS = "event_id BIGINT, ts TIMESTAMP, user_id BIGINT, event_type STRING, value DOUBLE, props STRING"
TERMINAL = "cancelled"


def read_events(spark: SparkSession, folder: str, pattern: str = "events*.parquet", per_trigger: int = 1000) -> DataFrame:
    """Append-only event files as a stream with a declared schema."""
    raw = spark.readStream.schema(JOB_EVENTS).option("pathGlobFilter", pattern).option("maxFilesPerTrigger", per_trigger).parquet(folder)
    return job_events(raw)


def job_events(raw: DataFrame) -> DataFrame:
    status = (
        F.when(F.col("event_type") == "error", "failed").when(F.col("event_type") == "purchase", "completed")
        .when((F.col("event_type") == "signup") & (F.col("event_id") % 97 == 0), TERMINAL).otherwise("running")
    )
    k = F.regexp_extract("props", "([0-9]+)", 1).cast("int")
    return raw.select(
        "event_id", F.col("user_id").alias("job_id"), (F.col("event_id") % 5).alias("revision"), F.col("ts").cast("timestamp").alias("ts"),
        F.col("event_type").alias("stage"), status.alias("status"), "value", k.alias("k"),
    )


def stage_windows(events: DataFrame, lateness: str = "1 hour", width: str = "1 day") -> DataFrame:
    """Events per stage in tumbling windows; rows later than the watermark are dropped."""
    return (
        events.withWatermark("ts", lateness).groupBy(F.window("ts", width).alias("w"), "stage")
        .agg(F.count("*").alias("events"), F.sum("value").alias("seconds"))
        .select(F.col("w.start").alias("start"), "stage", "events", "seconds")
    )


def job_sessions(events: DataFrame, gap: str = "6 hours", lateness: str = "1 hour") -> DataFrame:
    return (
        events.withWatermark("ts", lateness).groupBy(F.session_window("ts", gap).alias("w"), "job_id")
        .agg(F.count("*").alias("events")).select("job_id", F.col("w.start").alias("start"), F.col("w.end").alias("end"), "events")
    )


def unique_receipts(events: DataFrame, lateness: str = "1 hour") -> DataFrame:
    """Mirrored receipts count once by identity while the watermark still remembers it."""
    return events.withWatermark("ts", lateness).dropDuplicatesWithinWatermark(["event_id"])


def ledger_totals(events: DataFrame) -> DataFrame:
    """Totals recomputed after every trial; meant for complete output."""
    return events.groupBy("stage").agg(F.count("*").alias("calls"), F.count_if(F.col("status") == "failed").alias("failed"))


def conversation_turns(messages: DataFrame) -> DataFrame:
    """Running number of user turns per conversation; meant for update output."""
    return messages.groupBy("conv_id").agg(F.count_if(F.col("role") == "user").alias("turns"), F.max("turn").alias("last_turn"))


LATEST = "job_id BIGINT, revision BIGINT, status STRING, accepted BIGINT"
LATEST_STATE = "revision BIGINT, status STRING, accepted BIGINT"


def _keep_latest(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
    revision, status, accepted = state.get if state.exists else (-1, "", 0)
    for batch in batches:
        for row in batch.sort_values(["ts", "event_id"]).itertuples():
            if status != TERMINAL and row.revision >= revision:
                revision, status, accepted = int(row.revision), row.status, accepted + 1
    state.update((revision, status, accepted))
    yield pd.DataFrame({"job_id": [key[0]], "revision": [revision], "status": [status], "accepted": [accepted]})


def latest_jobs(events: DataFrame) -> DataFrame:
    """Keyed upsert: an older revision and anything after a cancellation leave the job untouched."""
    return events.groupBy("job_id").applyInPandasWithState(_keep_latest, LATEST, LATEST_STATE, "update", GroupStateTimeout.NoTimeout)


BUDGET = "job_id BIGINT, attempts BIGINT, deferred BOOLEAN"


def _count_attempts(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
    attempts = state.get[0] if state.exists else 0
    attempts += sum(len(batch) for batch in batches)
    state.update((attempts,))
    yield pd.DataFrame({"job_id": [key[0]], "attempts": [attempts], "deferred": [attempts >= 2]})


def attempt_budget(events: DataFrame) -> DataFrame:
    """Per-job attempt counter; a job is deferred after two."""
    return events.groupBy("job_id").applyInPandasWithState(_count_attempts, BUDGET, "attempts BIGINT", "update", GroupStateTimeout.NoTimeout)


def drain(stream: DataFrame, name: str, mode: str, checkpoint_folder: str) -> DataFrame:
    """Run a stream over what is available into an in-memory table; for tests and small reports."""
    query = (
        stream.writeStream.format("memory").queryName(name).outputMode(mode).option("checkpointLocation", checkpoint_folder)
        .trigger(availableNow=True).start()
    )
    query.awaitTermination()
    return stream.sparkSession.table(name)
