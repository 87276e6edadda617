"""File sources of a drawing corpus: inventories, OCR documents, drawing files, receipts, reports."""

from __future__ import annotations

import io
import zipfile
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from drawlake.functions import text

# Suffixes, limits of an OCR document and words that mark non-reference drawings.
IMAGE_SUFFIXES = ["jpg", "jpeg", "png", "bmp", "tif", "tiff", "webp"]
MAX_RECORDS, MAX_TEXT, MAX_COORDINATE, MAX_SIDE = 20_000, 8_192, 1_000_000.0, 100_000.0
NOT_REFERENCE = "construction|debug|measurement_audit"

OCR_SCHEMA = """meta STRUCT<box_coord_space: STRING, original_size: STRUCT<width: DOUBLE, height: DOUBLE>>,
    records ARRAY<STRUCT<text: STRING, box: ARRAY<ARRAY<DOUBLE>>, score: DOUBLE>>, _corrupt STRING"""
RECEIPT_SCHEMA = "status STRING, http_success BOOLEAN, schema_success BOOLEAN, network_requests INT, elapsed_seconds DOUBLE, model STRING"


def _stem(path):
    return F.regexp_extract(path, r"([^/]+)\.[^./]+$", 1)


def _suffix(path):
    return F.lower(F.regexp_extract(path, r"\.([^./]+)$", 1))


def corpus_files(spark: SparkSession, folder: str) -> DataFrame:
    """One row per stem with its image and OCR file; the lexicographically first of several wins."""
    listed = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(folder).select("path")
    is_image = _suffix(F.col("path")).isin(IMAGE_SUFFIXES)
    is_json = _suffix(F.col("path")) == "json"
    return listed.where(is_image | is_json).groupBy(_stem(F.col("path")).alias("case_id")).agg(
        F.min(F.when(is_image, F.col("path"))).alias("image"), F.min(F.when(is_json, F.col("path"))).alias("ocr"), F.count_if(is_image).alias("images")
    )


def source_inventory(spark: SparkSession, folder: str) -> DataFrame:
    """Image rows with their content hash; ids that differ only in case are flagged."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(folder)
    rows = files.where(_suffix(F.col("path")).isin(IMAGE_SUFFIXES)).select(_stem(F.col("path")).alias("case_id"), "path", F.sha2("content", 256).alias("sha256"))
    clashes = rows.groupBy(F.lower("case_id").alias("folded")).agg((F.count("*") > 1).alias("duplicate_id"))
    return rows.withColumn("folded", F.lower("case_id")).join(clashes, "folded").drop("folded")


def _zip_members(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for batch in batches:
        rows = []
        for path, content in zip(batch["path"], batch["content"]):
            try:
                with zipfile.ZipFile(io.BytesIO(content)) as package:
                    rows += [(path, info.filename, None) for info in package.infolist() if not info.is_dir()]
            except zipfile.BadZipFile:
                rows.append((path, None, "invalid_archive"))
        yield pd.DataFrame(rows, columns=["path", "member", "problem"])


def reference_inventory(spark: SparkSession, folder: str) -> DataFrame:
    """Reference drawings, direct and inside archives; an invalid archive stays as a failed row."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(folder)
    direct = files.where(_suffix(F.col("path")) == "dxf").select("path", F.lit(None).cast("string").alias("member"), F.lit(None).cast("string").alias("problem"))
    packed = files.where(_suffix(F.col("path")) == "zip").select("path", "content").mapInPandas(_zip_members, "path STRING, member STRING, problem STRING")
    packed = packed.withColumn("problem", F.coalesce("problem", text.path_problem(F.col("member"))))
    name = F.lower(F.coalesce("member", "path"))
    wanted = F.col("problem").isNotNull() | (name.endswith(".dxf") & ~name.rlike(NOT_REFERENCE))
    return direct.unionByName(packed).where(wanted)


def ocr_documents(spark: SparkSession, folder: str) -> DataFrame:
    """OCR files with the first reason a document is refused as a whole, null when it is accepted."""
    docs = (
        spark.read.schema(OCR_SCHEMA).option("multiLine", "true").option("columnNameOfCorruptRecord", "_corrupt")
        .json(folder, pathGlobFilter="*.json").select("*", F.col("_metadata.file_path").alias("path"))
    )
    records = F.col("records")

    def bad_point(p):
        return (F.size(p) != 2) | F.exists(p, lambda v: v.isNull() | F.isnan(v) | (F.abs(v) > MAX_COORDINATE))

    bad_box = F.exists(records, lambda r: r["box"].isNull() | (F.size(r["box"]) != 4) | F.exists(r["box"], bad_point))
    bad_text = F.exists(records, lambda r: r["text"].isNull() | (F.length(r["text"]) > MAX_TEXT))
    bad_score = F.exists(records, lambda r: r["score"].isNotNull() & ~r["score"].between(0.0, 1.0))
    size = F.col("meta.original_size")
    bad_size = F.coalesce(~size["width"].between(1e-12, MAX_SIDE), F.lit(False)) | F.coalesce(~size["height"].between(1e-12, MAX_SIDE), F.lit(False))
    problem = (
        F.when(F.col("_corrupt").isNotNull(), "malformed_document").when(records.isNull() | (F.size(records) > MAX_RECORDS), "invalid_record_list")
        .when(F.coalesce(F.col("meta.box_coord_space"), F.lit("original_image")) != "original_image", "unsupported_coordinate_space")
        .when(bad_size, "invalid_image_size").when(bad_text, "invalid_text").when(bad_box, "invalid_box").when(bad_score, "invalid_score")
    )
    return docs.select(_stem(F.col("path")).alias("case_id"), "path", "records", problem.alias("problem"))


def ocr_records(spark: SparkSession, folder: str) -> DataFrame:
    """Records of accepted documents with stable ids by position."""
    docs = ocr_documents(spark, folder).where("problem is null")
    rows = docs.select("case_id", F.posexplode("records").alias("ord", "r"))
    box = F.transform("r.box", lambda p: F.struct(p[0].alias("x"), p[1].alias("y")))
    return rows.select("case_id", F.format_string("r%03d", "ord").alias("record_id"), "ord", F.col("r.text").alias("text"), box.alias("box"), F.col("r.score").alias("score"))


def drawing_entities(spark: SparkSession, folder: str) -> DataFrame:
    """LINE, ARC, CIRCLE and other entities of ASCII group-code drawings, one drawing per file."""
    files = spark.read.text(folder, wholetext=True, pathGlobFilter="*.dxf").select("value", F.col("_metadata.file_path").alias("path"))
    lines = F.transform(F.split("value", r"\r?\n"), lambda v: F.trim(v))
    files = files.select("path", lines.alias("lines")).where("size(lines) >= 2")
    # Codes and values alternate by line; a pair is kept as "code|value".
    last = F.floor(F.size("lines") / 2).cast("int") - 1
    pairs = F.transform(F.sequence(F.lit(0), last), lambda i: F.concat_ws("|", F.get("lines", 2 * i), F.get("lines", 2 * i + 1)))
    files = files.select("path", pairs.alias("pairs"))
    unit_at = F.array_position("pairs", "9|$INSUNITS").cast("int")
    unit = F.when(unit_at > 0, F.substring_index(F.get("pairs", unit_at), "|", -1).try_cast("int"))
    section = F.array_position("pairs", "2|ENTITIES").cast("int")
    rest = F.when(section > 0, F.slice("pairs", section + 1, F.size("pairs")))
    files = files.select("path", F.coalesce(unit, F.lit(0)).alias("unit_code"), rest.alias("rest"))
    end = F.array_position("rest", "0|ENDSEC").cast("int")
    files = files.select("path", "unit_code", F.when(end > 0, F.slice("rest", 1, end)).otherwise(F.col("rest")).alias("body"))
    # Every entity starts at group code 0 and runs to the next one.
    starts = F.filter(F.sequence(F.lit(1), F.size("body")), lambda i: F.get("body", i - 1).startswith("0|"))
    files = files.where("size(body) > 0").select("path", "unit_code", "body", starts.alias("starts"))
    blocks = F.transform("starts", lambda at, k: F.slice("body", at, F.coalesce(F.get("starts", k + 1), F.size("body") + 1) - at))
    rows = files.select("path", "unit_code", F.posexplode(blocks).alias("ord", "block"))
    kind = F.substring_index(F.get("block", 0), "|", -1)

    def group(code):
        pair = F.get(F.filter("block", lambda p: p.startswith(code + "|")), 0)
        return F.substring(pair, F.lit(len(code) + 2), F.length(pair))

    def number(code):
        return group(code).try_cast("double")

    return rows.where(kind != "ENDSEC").select(
        _stem(F.col("path")).alias("artifact_id"), "unit_code", "ord", kind.alias("kind"), F.coalesce(group("8"), F.lit("0")).alias("layer"),
        number("10").alias("x0"), number("20").alias("y0"), number("11").alias("x1"), number("21").alias("y1"),
        number("40").alias("radius"), number("50").alias("start_deg"), number("51").alias("end_deg"),
    )


def profile_entities(raw: DataFrame) -> DataFrame:
    """Profile curves with ends and length; everything left out carries its reason."""
    kind = F.col("kind")
    start = F.radians(F.when(kind == "ARC", F.col("start_deg")).otherwise(0.0))
    sweep = F.when(kind == "ARC", F.radians(F.pmod(F.col("end_deg") - F.col("start_deg"), F.lit(360.0)))).otherwise(F.radians(F.lit(360.0)))
    line = kind == "LINE"

    def on_arc(center, angle, f):
        return F.col(center) + F.col("radius") * f(angle)

    rows = raw.withColumns({
        "sx": F.when(line, F.col("x0")).otherwise(on_arc("x0", start, F.cos)), "sy": F.when(line, F.col("y0")).otherwise(on_arc("y0", start, F.sin)),
        "ex": F.when(line, F.col("x1")).otherwise(on_arc("x0", start + sweep, F.cos)), "ey": F.when(line, F.col("y1")).otherwise(on_arc("y0", start + sweep, F.sin)),
        "length": F.when(line, F.hypot(F.col("x1") - F.col("x0"), F.col("y1") - F.col("y0"))).otherwise(F.col("radius") * sweep),
        "assumed": text.is_assumed_layer(F.col("layer")),
    })
    skipped = (
        F.when(~text.is_profile_layer(F.col("layer")), F.concat(F.lit("layer:"), "layer"))
        .when(~kind.isin("LINE", "ARC", "CIRCLE"), F.concat(F.lit("type:"), "kind"))
        .when(F.col("length").isNull() | F.isnan("length") | (F.col("length") <= 0), "degenerate")
    )
    return rows.withColumn("skipped", skipped)


def receipt_files(spark: SparkSession, folder: str) -> DataFrame:
    """Call receipts; the path decides run and phase, so equal contents stay separate calls."""
    rows = spark.read.schema(RECEIPT_SCHEMA).option("multiLine", "true").option("recursiveFileLookup", "true").json(folder).select("*", F.col("_metadata.file_path").alias("path"))
    phase = (
        F.when(F.col("path").contains("post-solve-radius-retry"), "post_solve_radius_rebinding").when(F.col("path").contains("full-source-binding"), "radius_rebinding")
        .when(F.col("path").contains("fallback"), "fallback").otherwise("initial")
    )
    invoked = ~F.coalesce(F.col("status").isin("pending", "not_invoked"), F.lit(False)) & ~(
        F.coalesce(F.col("status").isin("disabled", "skipped", "not_configured"), F.lit(False)) & (F.coalesce("network_requests", F.lit(0)) == 0)
    )
    run = F.regexp_extract("path", r"/([^/]+)/[^/]+$", 1)
    return rows.where(invoked).withColumns({"run": run, "phase": phase}).dropDuplicates(["path"])


def latest_reports(spark: SparkSession, folder: str, schema: str, limit: int = 20) -> DataFrame:
    rows = spark.read.schema(f"{schema}, _corrupt STRING").option("mode", "PERMISSIVE").option("columnNameOfCorruptRecord", "_corrupt").option("multiLine", "true").json(folder)
    rows = rows.select("*", F.col("_metadata.file_name").alias("name")).where("_corrupt is null").drop("_corrupt")
    return rows.orderBy(F.desc("name")).limit(limit)


def write_report(rows: DataFrame, folder: str) -> None:
    """Frozen report, partitioned by run; an existing one is never overwritten."""
    rows.write.partitionBy("run_id").mode("errorifexists").parquet(folder)


def write_csv(rows: DataFrame, folder: str) -> None:
    rows.write.option("header", "true").mode("errorifexists").csv(folder)


def reuse_frozen(stored: DataFrame, fresh: DataFrame) -> DataFrame:
    """The stored rows if both signatures are equal as multisets, else an error."""
    if not stored.exceptAll(fresh).isEmpty() or not fresh.exceptAll(stored).isEmpty():
        raise ValueError("frozen output does not match its sources")
    return stored
