"""Queries on classifiers."""

from __future__ import annotations

from pyspark.sql import functions as F

from threadlens.llm.common import crc_fold
from threadlens.llm.language_id import fit_language_model, identify
from threadlens.llm.quality import classify, fit_quality_model
from threadlens.llm.registry import query


@query("op1_language_id")
def op1_language_id(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    fold = crc_fold(F.col("doc_id"), 4)
    model = fit_language_model(docs, fold != 2)
    return identify(docs.select("doc_id", "text"), model).select(
        "doc_id", (fold == 2).alias("held_out"), "lang_pred", "score")


@query("op9_quality_classifier")
def op9_quality_classifier(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    fold = crc_fold(F.col("doc_id"), 5)
    model = fit_quality_model(docs, labels.where(fold != 0))
    return classify(docs, model, threshold=0.3).select("doc_id", (fold == 0).alias("held_out"), "score", "predicted")
