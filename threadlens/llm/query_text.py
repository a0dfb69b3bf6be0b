"""Queries on passages and token counts."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import functions as F

from threadlens.llm.decontaminate import find_items
from threadlens.llm.registry import query
from threadlens.llm.token_count import count_tokens
from threadlens.llm.unit_dedup import dedup_units

PIECES = public_tokenizers.path("piece_bpe_32k.model")


@query("op2_decontamination")
def op2_decontamination(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    found = find_items(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
    return found.select("doc_id", (F.size("matches") > 0).alias("contaminated"), "matches")


@query("op7_token_count")
def op7_token_count(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return count_tokens(docs, PIECES).select("doc_id", "n_tokens")


@query("op8_substring_dedup")
def op8_substring_dedup(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return dedup_units(docs).select("doc_id", "n_units", "n_removed", "kept_spans",
                                    F.sha2("kept_text", 256).alias("kept_sha256"))
