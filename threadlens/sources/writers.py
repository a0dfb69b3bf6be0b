"""Sinks."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def write_csv(df: DataFrame, path: str) -> None:
    """CSV with a header; values are kept as they are, outer blanks included."""
    (
        df.write.mode("overwrite").option("header", "true").option("quote", '"').option("escape", '"')
        .option("ignoreLeadingWhiteSpace", "false").option("ignoreTrailingWhiteSpace", "false").csv(path)
    )


def append_results(results: DataFrame, path: str) -> None:
    """Append thread results, mixed and single-label threads in separate partitions."""
    outcome = F.when(F.col("homophilous") == 1, F.lit("single_label")).otherwise(F.lit("mixed"))
    results.withColumn("outcome", outcome).write.mode("append").partitionBy("outcome").parquet(path)


def write_threads(threads: DataFrame, path: str, per_document: int = 64) -> None:
    """Nested threads as ``{results: [...]}`` lines with a bounded number of threads each."""
    lines = (
        threads.withColumn("_chunk", F.floor(F.col("thread_no") / F.lit(per_document)))
        .groupBy("_chunk")
        .agg(F.transform(
            F.array_sort(F.collect_list(F.struct("thread_no", "thread"))), lambda t: t["thread"]
        ).alias("results"))
        .select("results")
    )
    lines.write.mode("overwrite").json(path)


def write_reply_map(lists: DataFrame, root: str, reply_ids: str, path: str) -> None:
    """One JSON object per line, root -> [replies]."""
    line = F.to_json(F.create_map(F.col(root).cast("string"), F.col(reply_ids)))
    lists.select(line.alias("value")).write.mode("overwrite").text(path)
