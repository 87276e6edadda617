"""Evaluation reports: frozen denominators, repeat policy and null-aware rates."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def is_true(name: str) -> Column:
    """Unknown never counts as success."""
    return F.coalesce(F.col(name), F.lit(False))


def count_true(name: str) -> Column:
    return F.count_if(is_true(name))


def frozen_rate(part: Column, total: Column) -> Column:
    """Rate over the frozen denominator; an empty denominator scores zero."""
    return F.coalesce(F.try_divide(part, total), F.lit(0.0))


def known_rate(part: Column, total: Column, unknown: Column) -> Column:
    """Rate that stays null while any receipt is unknown."""
    return F.when(unknown == 0, F.try_divide(part, total))


def case_repeats(trials: DataFrame, expected: int) -> DataFrame:
    """One row per attempted case; a flag passes only when every planned repeat passes."""
    complete = F.count("*") == expected

    def every(name):
        return (complete & F.bool_and(is_true(name))).alias(name)

    return trials.groupBy("case_id").agg(
        F.lit(True).alias("attempted"),
        F.count("*").alias("trial_count"),
        F.when(complete & F.bool_and(F.col("status") == "completed"), "completed")
        .when(complete, "failed")
        .otherwise("running")
        .alias("status"),
        every("artifact_completed"),
        every("geometry_valid"),
        every("scaled_mm"),
        F.bool_or(is_true("manual_intervention")).alias("manual_intervention"),
        F.bool_or(is_true("reference_compared")).alias("reference_compared"),
        every("reference_within"),
        F.max_by("alignment_kind", F.struct("repeat", "trial_id")).alias("alignment_kind"),
        F.sum("elapsed_seconds").alias("elapsed_seconds"),
    )


def catalog_results(catalog: DataFrame, results: DataFrame) -> DataFrame:
    """Every catalog case with its result; a case without one stays as not attempted."""
    flags = [
        "attempted", "artifact_completed", "geometry_valid", "scaled_mm", "manual_intervention",
        "reference_compared", "reference_within",
    ]
    joined = catalog.select("case_id", "split").join(results, "case_id", "left")
    return joined.withColumns(
        {name: is_true(name) for name in flags} | {"status": F.coalesce("status", F.lit("not_attempted"))}
    )


def evaluation_counts(rows: DataFrame) -> DataFrame:
    """Counts and rates of the whole catalog and of both splits from one pass."""
    attempted, artifact, manual = F.col("attempted"), F.col("artifact_completed"), F.col("manual_intervention")
    exact = attempted & F.col("reference_compared") & F.col("reference_within") & F.col("geometry_valid") & F.col("scaled_mm")
    searched = attempted & F.col("reference_within") & (F.col("alignment_kind") == "shape_diagnostic")
    flags = {
        "attempted": attempted,
        "artifact_completed": attempted & artifact,
        "auto_generated": attempted & artifact & ~manual,
        "geometry_valid": attempted & F.col("geometry_valid"),
        "scaled_mm": attempted & artifact & F.col("scaled_mm"),
        "reference_compared": attempted & F.col("reference_compared"),
        "reference_within": exact,
        "autonomous_within": exact & ~manual,
        "manual_interventions": manual,
        "searched_matches": F.coalesce(searched, F.lit(False)),
    }
    counted = rows.groupingSets([[], ["split"]], "split").agg(
        F.count("*").alias("total"), *[F.count_if(flag).alias(name) for name, flag in flags.items()]
    )
    counted = counted.withColumn("scope", F.coalesce("split", F.lit("overall"))).drop("split")
    counted = counted.withColumn("not_attempted", F.col("total") - F.col("attempted"))
    for name in ("auto_generated", "geometry_valid", "reference_within", "autonomous_within"):
        counted = counted.withColumn(f"{name}_rate", F.round(frozen_rate(F.col(name), F.col("total")), 6))
    return counted


def transport_counts(receipts: DataFrame, keys: list[str]) -> DataFrame:
    """Logical calls and network attempts; totals are null while any attempt count is missing."""
    known = F.col("network_requests").isNotNull()
    counted = receipts.groupBy(*keys).agg(
        F.count("*").alias("calls"),
        count_true("http_success").alias("http_successful"),
        F.count_if(F.col("http_success").isNull()).alias("http_unknown"),
        count_true("schema_success").alias("schema_successful"),
        F.count_if(F.col("schema_success").isNull()).alias("schema_unknown"),
        F.count_if(~known).alias("missing_counts"),
        F.coalesce(F.sum("network_requests"), F.lit(0)).alias("known_total"),
        F.count_if(F.col("network_requests") > 0).alias("calls_with_attempts"),
        F.coalesce(F.sum(F.greatest(F.lit(0), F.col("network_requests") - 1)), F.lit(0)).alias("known_retries"),
        *[F.count_if(F.col("verdict") == v).alias(f"verdict_{v}") for v in ("match", "mismatch", "uncertain")],
    )
    complete = F.col("missing_counts") == 0
    return counted.select(
        "*",
        F.round(known_rate(F.col("http_successful"), F.col("calls"), F.col("http_unknown")), 6).alias("http_rate"),
        F.round(known_rate(F.col("schema_successful"), F.col("calls"), F.col("schema_unknown")), 6).alias("schema_rate"),
        F.when(complete, F.col("known_total")).alias("attempts_total"),
        F.when(complete, F.col("known_retries")).alias("retries"),
    ).drop("known_retries")


def top_per_group(df: DataFrame, keys: list[str], order: list[Column], k: int, rank: str = "rank") -> DataFrame:
    """First ``k`` rows per group; Spark limits each group before it shuffles."""
    window = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn(rank, F.row_number().over(window)).where(F.col(rank) <= k)
