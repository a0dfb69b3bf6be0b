"""Helpers shared by the corpus operators: Arrow maps, written tables, connected components, stable sampling."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from threadlens.session import materialize, ship_package

__all__ = ["append_columns", "components", "crc_fold", "fresh", "map_rows", "materialize", "ship_package",
           "string_bytes", "two_level_sample"]


#: Bytes of a batch that a function sees at once, about; a task then holds a small multiple of that.
BATCH_BYTES = 16 << 20


def parts_of(batch: pa.RecordBatch, limit: int = BATCH_BYTES) -> Iterator[pa.RecordBatch]:
    """A batch in equal parts of about ``limit`` bytes."""
    step = max(1, -(-batch.num_rows // max(1, -(-batch.nbytes // limit))))
    for start in range(0, max(1, batch.num_rows), step):
        yield batch.slice(start, step)


def map_rows(df: DataFrame, fn: Callable[[pa.RecordBatch], pa.RecordBatch | None], schema: str | T.StructType,
             limit: int = BATCH_BYTES):
    """mapInArrow over single batches in parts of bounded size; fn may return None for a part without results."""

    def run(batches: Iterator[pa.RecordBatch]):
        for batch in batches:
            for part in parts_of(batch, limit):
                out = fn(part)
                if out is not None:
                    yield out

    return df.mapInArrow(run, schema)


def fresh(df: DataFrame, name: str) -> str:
    """A column name that df does not have yet."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name = "_" + name
    return name


def append_columns(df: DataFrame, inputs: list[str], fields: list[tuple[str, T.DataType]],
                   fn: Callable[..., list[pa.Array]], limit: int = BATCH_BYTES) -> DataFrame:
    """All columns of df, and behind them the fields that fn makes from the input columns of a batch. No shuffle."""
    places = [df.columns.index(c) for c in inputs]
    schema = T.StructType([*df.schema.fields, *[T.StructField(n, t) for n, t in fields]])

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        made = fn(*[batch.column(i) for i in places])
        return pa.RecordBatch.from_arrays([*batch.columns, *made], names=schema.names)

    return map_rows(df, run, schema, limit)


def string_bytes(column: pa.Array) -> list[bytes]:
    """UTF-8 of every text; null counts as empty."""
    return [x or b"" for x in column.cast(pa.binary()).to_pylist()]


def crc_fold(id_col: Column, folds: int) -> Column:
    """crc32 of the id as text, modulo folds. A null id counts as the empty text."""
    return F.pmod(F.crc32(F.coalesce(id_col.cast("string"), F.lit("")).cast("binary")), F.lit(folds))


def two_level_sample(rows: DataFrame, key: str, id_col: str, k: int, salts: int = 64) -> DataFrame:
    """At most k rows of each key, chosen by a hash of the id. No task sees more than a salted share of a key."""
    token = F.xxhash64(F.col(id_col), F.lit(17))
    share = Window.partitionBy(key, "_salt").orderBy("_token", id_col)
    whole = Window.partitionBy(key).orderBy("_token", id_col)
    return (
        rows.withColumn("_token", token).withColumn("_salt", F.pmod(F.xxhash64(F.col(id_col), F.lit(5)), F.lit(salts)))
        .withColumn("_rank", F.row_number().over(share)).where(F.col("_rank") <= k)
        .withColumn("_rank", F.row_number().over(whole)).where(F.col("_rank") <= k)
        .drop("_token", "_salt", "_rank")
    )


def components(edges: DataFrame, label: str) -> DataFrame:
    """(id, component) of every vertex of the undirected edges (a, b); component is the smallest id reachable.

    Alternating large-star and small-star steps. Each step is one aggregate and one join per side, so no vertex, however
    many links it has, is gathered in a task; the edges of a step are written, which cuts the lineage.
    """
    current = materialize(
        edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).where(F.col("a") != F.col("b"))
        .distinct(), f"{label}-edges")
    if current.isEmpty():
        return current.select(F.col("a").alias("id"), F.col("b").alias("component"))
    before = None
    while True:
        both = current.unionByName(current.select(F.col("b").alias("a"), F.col("a").alias("b")))
        lowest = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        large = (
            both.join(lowest, "a").where(F.col("b") > F.col("a")).select(F.col("b").alias("a"), F.col("m").alias("b"))
            .where(F.col("a") != F.col("b")).distinct()
        )
        root = large.groupBy("a").agg(F.min("b").alias("m"))
        small = (
            large.join(root, "a").where(F.col("b") != F.col("m")).select(F.col("b").alias("a"), F.col("m").alias("b"))
            .unionByName(root.select("a", F.col("m").alias("b"))).distinct()
        )
        current = materialize(small, f"{label}-edges")
        state = current.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if tuple(state) == before:
            break
        before = tuple(state)
    roots = current.select(F.col("b").alias("id"), F.col("b").alias("component")).distinct()
    return current.select(F.col("a").alias("id"), F.col("b").alias("component")).unionByName(roots)


def ragged(values: np.ndarray, lengths: np.ndarray) -> pa.Array:
    """A list array over flat values."""
    offsets = np.zeros(len(lengths) + 1, np.int32)
    np.cumsum(lengths, out=offsets[1:])
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(values))


def grouped(batches: Iterator[pa.RecordBatch], key: str, solve: Callable[[pa.Table], pa.RecordBatch],
            rows: int = 1 << 16) -> Iterator[pa.RecordBatch]:
    """Calls solve with whole groups of a partition that is sorted by key, about ``rows`` rows at a time."""
    held: list[pa.RecordBatch] = []
    waiting = 0
    for batch in batches:
        if batch.num_rows:
            held.append(batch)
            waiting += batch.num_rows
        if waiting < rows:
            continue
        table = pa.Table.from_batches(held).combine_chunks()
        last = table[key].to_numpy()
        cut = int(np.searchsorted(last, last[-1]))
        if cut:
            yield solve(table.slice(0, cut).combine_chunks())
        held = table.slice(cut).to_batches()
        waiting = 0 if cut else waiting
        rows = rows if cut else 2 * rows
    if held:
        yield solve(pa.Table.from_batches(held).combine_chunks())
