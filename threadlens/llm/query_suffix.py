"""Query on repeated byte strings."""

from __future__ import annotations

from pyspark.sql import functions as F

from threadlens.llm.registry import query
from threadlens.llm.suffix_dedup import remove_repeats


@query("op6_suffix_dedup")
def op6_suffix_dedup(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return remove_repeats(docs, length=100).select(
        "doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))
