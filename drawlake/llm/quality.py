"""Held-out and fit figures of the fitted and packing operators: ``python -m drawlake.llm.quality [folder]``."""

from __future__ import annotations

import sys

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from drawlake.llm import byte_cnn, language_id, mixing, packing
from drawlake.session import local_session


def figures(spark: SparkSession, folder: str) -> dict[str, object]:
    docs = spark.read.parquet(f"{folder}/documents.parquet").select("doc_id", "lang")
    labels = spark.read.parquet(f"{folder}/labels.parquet").select("doc_id", "quality")
    spoken = language_id.op7_language_spans(spark, folder).where("held_out").join(docs.where("lang is not null"), "doc_id")
    right, held = spoken.agg(F.count_if(F.col("lang") == F.col("lang_pred")), F.count("*")).first()
    judged = byte_cnn.op2_byte_cnn(spark, folder).where("held_out").join(labels, "doc_id").select("score", "predicted", "quality").toPandas()
    ranks = judged["score"].rank()
    good, bad = int((judged["quality"] == 1).sum()), int((judged["quality"] == 0).sum())
    auc = (ranks[judged["quality"] == 1].sum() - good * (good + 1) / 2) / max(1, good * bad)
    packed = packing.op9_best_two_fit(spark, folder).agg(F.count_distinct("sequence_id"), F.sum("length")).first()
    mixed = mixing.mix(spark.read.parquet(f"{folder}/documents.parquet")).groupBy("source").agg(F.sum("taken").alias("taken"), F.first("target").alias("target"))
    miss = mixed.where("target > 0").agg(F.max(F.abs(F.col("taken") - F.col("target")) / F.col("target"))).first()[0]
    return {
        "op7 held out, right": (right, held), "op2 held out, rows": len(judged), "op2 accuracy": round(float((judged["predicted"] == judged["quality"]).mean()), 4),
        "op2 AUC": round(float(auc), 4), "op2 share of the larger class": round(max(good, bad) / max(1, len(judged)), 4),
        "op9 sequences, least possible": (packed[0], -(-(packed[1] or 0) // packing.CAPACITY)), "op5 largest miss of a target": round(miss or 0.0, 5),
    }


if __name__ == "__main__":
    session = local_session(app="quality")
    session.sparkContext.setLogLevel("ERROR")
    for name, value in figures(session, sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.1").items():
        print(f"{name}: {value}")
    session.stop()
