"""Structured Streaming jobs: ingest filtered statuses, and score the features of new posts."""

from __future__ import annotations

import time
from collections.abc import Callable

from pyspark.errors import StreamingQueryException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from threadlens.functions import text as tx
from threadlens.operators import features as ft


def status_stream(spark: SparkSession, path: str, schema: T.StructType, files_per_trigger: int = 64) -> DataFrame:
    """JSON lines as they arrive in a folder; the raw line is kept next to the parsed status.

    Files are taken in bounded batches, so a backlog does not become one giant batch.
    """
    lines = spark.readStream.format("text").option("maxFilesPerTrigger", files_per_trigger).load(path)
    return lines.select(F.col("value").alias("raw"), F.from_json("value", schema).alias("status"))


def matching(statuses: DataFrame, keywords: list[str], language: str = "en") -> DataFrame:
    """Statuses in the language that hold a keyword. Stateless, so a batch frame gives the same rows."""
    return statuses.where(
        (F.col("status.lang") == language) & tx.keyword_match(F.col("status.text"), keywords)
    ).select(F.col("status.id").alias("id"), "raw")


def append_parquet(stream: DataFrame, path: str, checkpoint: str, available_now: bool = True):
    """Append to a table. A restart goes on from the checkpoint, and a file's batch is written once."""
    writer = stream.writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if available_now else writer).start()


def post_features(posts: DataFrame, key: list[str], text: str) -> DataFrame:
    """Readability, emotion and negation of each post; no state and no shuffle."""
    inline = {**ft.readability_columns(F.col(text)), **ft.emotion_columns(F.col(text))}
    return posts.select(*key, *[c.alias(n) for n, c in inline.items()])


def score_stream(stream: DataFrame, score, path: str, checkpoint: str, available_now: bool = True):
    """Score every micro-batch with ``score(batch) -> DataFrame`` and store it under its batch number.

    A batch replayed after a failure overwrites its own folder, so rows are not doubled.
    """

    def write(batch: DataFrame, number: int) -> None:
        score(batch).write.mode("overwrite").parquet(f"{path}/batch={number}")

    writer = stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if available_now else writer).start()


def append_batches(stream: DataFrame, path: str, checkpoint: str, available_now: bool = True,
                   check: Callable[[DataFrame, int], None] = lambda batch, number: None):
    """Append every micro-batch to a table as its own partition, so a batch that runs again replaces what it left.

    ``check(batch, number)`` runs behind the write; what it raises fails the batch, which is then not committed.
    """

    def write(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{path}/batch={number}")
        check(batch, number)

    writer = stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if available_now else writer).start()


def supervise(start: Callable, first_wait: float = 1.0, longest_wait: float = 300.0, attempts: int | None = None,
              wait: Callable[[float], None] = time.sleep) -> int:
    """Run ``start()``, a streaming query on a checkpoint, until it ends by itself; returns the number of restarts.

    A query that fails is started again, from its checkpoint, after a pause that doubles with each failure up to
    ``longest_wait`` and begins anew once a batch has been committed. Without ``attempts`` this goes on for ever; else
    the error of that many failures without a committed batch between them is raised. Exactly one copy of each row
    needs a sink that replaces a batch that runs again, as those of this module do.
    """
    pause, failures, restarts = first_wait, 0, 0
    while True:
        query = start()
        try:
            query.awaitTermination()
            return restarts
        except StreamingQueryException:
            if query.lastProgress is not None:
                pause, failures = first_wait, 0
            failures += 1
            if attempts is not None and failures >= attempts:
                raise
        wait(pause)
        pause, restarts = min(2 * pause, longest_wait), restarts + 1
