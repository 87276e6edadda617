import shutil

from pyspark.sql import functions as F

from drawlake.streaming import ledgers

SOURCE = "/root/testdata/sf0.001"


def stream(spark, tmp_path):
    folder = tmp_path / "in"
    folder.mkdir()
    shutil.copy(f"{SOURCE}/events.parquet", folder / "events.parquet")
    return ledgers.read_events(spark, str(folder)), ledgers.job_events(spark.read.parquet(f"{SOURCE}/events.parquet"))


def test_totals_match_batch(spark, tmp_path):
    live, batch = stream(spark, tmp_path)
    out = ledgers.drain(ledgers.ledger_totals(live), "totals", "complete", str(tmp_path / "c"))
    assert sorted(out.collect()) == sorted(ledgers.ledger_totals(batch).collect())


def test_windows_and_unique_receipts(spark, tmp_path):
    live, batch = stream(spark, tmp_path)
    out = ledgers.drain(ledgers.unique_receipts(live).select("event_id"), "unique_rows", "append", str(tmp_path / "c"))
    assert out.count() == batch.select("event_id").distinct().count()
    windows = ledgers.drain(ledgers.stage_windows(live), "windows", "append", str(tmp_path / "d"))
    assert windows.where("events < 1").count() == 0 and windows.count() > 0


def test_latest_job_ignores_old_revisions(spark, tmp_path):
    live, batch = stream(spark, tmp_path)
    rows = ledgers.drain(ledgers.latest_jobs(live), "latest", "update", str(tmp_path / "c")).collect()
    top = {r["job_id"]: r["m"] for r in batch.groupBy("job_id").agg(F.max("revision").alias("m"), F.bool_or(F.col("status") == "cancelled").alias("c")).where("not c").collect()}
    got = {r["job_id"]: r["revision"] for r in rows}
    assert top and all(got[job] == revision for job, revision in top.items())


def test_attempt_budget(spark, tmp_path):
    live, batch = stream(spark, tmp_path)
    rows = ledgers.drain(ledgers.attempt_budget(live.where("status = 'failed'")), "budget", "update", str(tmp_path / "c")).collect()
    want = {r["job_id"]: r["count"] for r in batch.where("status = 'failed'").groupBy("job_id").count().collect()}
    assert {r["job_id"]: r["attempts"] for r in rows} == want
    assert all(r["deferred"] == (r["attempts"] >= 2) for r in rows)
