"""Near-dedup of embeddings by cross-polytope hashing.

A vector is rotated by three rounds of random signs and a fast Hadamard transform; its hash is the largest entry of the
result by amount, with its sign. A table joins two such hashes; a vector is put into the buckets of its best
combinations (multiprobe). Candidates of a bucket are verified by a matrix product in double precision, in blocks of
bounded size, and each pair counts in its first common bucket only.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from threadlens.llm.common import components, fresh, map_rows, materialize

TABLES, PROBES = 8, 3
SEED = 11
#: Vectors of a block.
BLOCK = 1024
_A = np.uint64(0x9E3779B97F4A7C15)


def hadamard(x: np.ndarray) -> np.ndarray:
    """Fast Walsh-Hadamard transform of the rows, whose length is a power of two."""
    n, d = x.shape
    step = 1
    while step < d:
        x = x.reshape(n, d // (2 * step), 2, step)
        x = np.stack([x[:, :, 0] + x[:, :, 1], x[:, :, 0] - x[:, :, 1]], axis=2)
        step *= 2
        x = x.reshape(n, d)
    return x


def corners(x: np.ndarray, table: int, part: int, k: int = 2) -> tuple[np.ndarray, np.ndarray]:
    """(the k best corners, their amounts) of the rotated rows; corner 2i + s is entry i with sign s."""
    n, d = x.shape
    size = 1 << max(1, int(d - 1).bit_length())
    turned = np.zeros((n, size))
    turned[:, :d] = x
    rng = np.random.default_rng((SEED, table, part, size))
    for _ in range(3):
        turned = hadamard(turned * rng.choice((-1.0, 1.0), size)) / np.sqrt(size)
    amount = np.abs(turned)
    if k > size:
        raise ValueError(f"{size} entries have no {k} corners: fewer probes")
    best = np.argpartition(-amount, k - 1, axis=1)[:, :k]
    held = np.take_along_axis(amount, best, 1)
    order = np.argsort(-held, axis=1, kind="stable")
    best, held = np.take_along_axis(best, order, 1), np.take_along_axis(held, order, 1)
    sign = np.take_along_axis(turned, best, 1) < 0
    return 2 * best + sign, held


def buckets(x: np.ndarray, group: np.ndarray, tables: int = TABLES, probes: int = PROBES) -> np.ndarray:
    """(n, tables * probes) bucket numbers of unit rows; ``group`` (equal labels) is part of each number. The probes of a
    table are the pairs of corners that lose least, out of as many corners a hash as give that many pairs."""
    k = max(2, math.isqrt(max(0, probes - 1)) + 1)
    both = [(i, j) for i in range(k) for j in range(k)]
    out = np.empty((len(x), tables, probes), np.uint64)
    for t in range(tables):
        (a, wa), (b, wb) = corners(x, t, 0, k), corners(x, t, 1, k)
        pairs = np.stack([a[:, i].astype(np.uint64) << np.uint64(28) | b[:, j].astype(np.uint64)
                          for i, j in both], 1)
        loss = np.stack([(wa[:, 0] - wa[:, i]) + (wb[:, 0] - wb[:, j]) for i, j in both], 1)
        chosen = np.take_along_axis(pairs, np.argsort(loss, axis=1, kind="stable")[:, :probes], 1)
        key = (chosen | np.uint64(t + 1) << np.uint64(56)) * _A + group[:, None]
        key = (key ^ (key >> np.uint64(31))) * np.uint64(0xBF58476D1CE4E5B9)
        out[:, t] = key ^ (key >> np.uint64(29))
    return out.reshape(len(x), tables * probes)


def link_block(here: np.ndarray, side: np.ndarray | None, bucket: np.uint64, x: np.ndarray, weight: np.ndarray,
               keys: np.ndarray, least: float, probes: int) -> tuple[np.ndarray, np.ndarray]:
    """(links of each row, root of each row) from the pairs of a block whose first common bucket is this one.

    side: None for all pairs, else only pairs of rows of different sides."""
    n = len(x)
    good = x @ x.T >= least
    a, b = np.nonzero(np.triu(good, 1))
    if side is not None:
        apart = side[a] != side[b]
        a, b = a[apart], b[apart]
    own = int(np.flatnonzero(keys[0] == bucket)[0]) // probes
    for t in range(own + 1):
        ka, kb = keys[a, t * probes:(t + 1) * probes], keys[b, t * probes:(t + 1) * probes]
        common = (ka[:, :, None] == kb[:, None, :]).any(2)
        if t < own:
            told = ~common.any(1)
        else:  # in its own table, a pair is told by the lowest bucket it shares
            told = np.where(common, ka, np.uint64(0xFFFFFFFFFFFFFFFF)).min(1, initial=np.uint64(0xFFFFFFFFFFFFFFFF)) == bucket
        a, b = a[told], b[told]
    links = np.bincount(a, weight[b], n) + np.bincount(b, weight[a], n)
    root = np.arange(n)
    while len(a):
        low = np.minimum(root[a], root[b])
        before = root.copy()
        np.minimum.at(root, a, low)
        np.minimum.at(root, b, low)
        root = root[root]
        if (root == before).all():
            break
    return links.astype(np.int64), here[root]


def link_groups(batches: Iterator[pa.RecordBatch], least: float, probes: int) -> Iterator[pa.RecordBatch]:
    """Verifies the blocks of a sorted partition; a block that goes on in the next batch waits for it."""
    names = ["owner", "links", "root"]

    def solve(table: pa.Table) -> pa.RecordBatch:
        bucket = table["bucket"].to_numpy().view(np.uint64)
        i, j, side = (table[c].to_numpy() for c in ("i", "j", "chunk"))
        owner, weight = table["owner"].to_numpy(), table["n"].to_numpy().astype(np.float64)
        vectors = [np.frombuffer(v, np.float64) for v in table["vec"].to_pylist()]
        keys = np.array([np.frombuffer(k, np.uint64) for k in table["keys"].to_pylist()])
        change = np.flatnonzero((bucket[1:] != bucket[:-1]) | (i[1:] != i[:-1]) | (j[1:] != j[:-1])) + 1
        out: list[tuple[np.ndarray, ...]] = []
        for a, b in zip([0, *change], [*change, len(bucket)], strict=True):
            if b - a < 2:
                continue
            order = a + np.argsort(owner[a:b])
            links, root = link_block(owner[order], None if i[a] == j[a] else side[order], bucket[a],
                                     np.array([vectors[k] for k in order]), weight[order], keys[order], least, probes)
            told = (links > 0)
            out.append((owner[order][told], links[told], root[told]))
        columns = [np.concatenate(c) for c in zip(*out, strict=True)] if out else [np.zeros(0, np.int64)] * 3
        return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], names=names)

    held: pa.Table | None = None
    for batch in batches:
        table = pa.Table.from_batches([batch])
        table = pa.concat_tables([held, table]) if held is not None else table
        if not len(table):
            continue
        bucket, i, j = (table[c].to_numpy() for c in ("bucket", "i", "j"))
        same = (bucket == bucket[-1]) & (i == i[-1]) & (j == j[-1])
        cut = len(same) - int(np.argmin(same[::-1])) if not same.all() else 0
        held = table.slice(cut)
        if cut:
            yield solve(table.slice(0, cut))
    if held is not None and len(held):
        yield solve(held)


def near_vectors(rows: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label",
                 cosine: float = 0.93, tables: int = TABLES, probes: int = PROBES, block: int = BLOCK) -> DataFrame:
    """All columns of rows, then n_links (other rows linked directly) and component_id (smallest id reachable).

    Two rows are linked if their labels are equal and not null, their vectors equally long, and the cosine of these in
    double precision is at least ``cosine``, when some table puts both into one bucket. A vector that is null, zero or
    holds a null or a component that is not finite is linked with nothing, nor is a row with a null id. Every row
    counts, also with an id or vector that others have. Names that rows has already get a leading underscore. An empty
    table gives an empty result.

    Equal vectors become one, with a weight. A bucket of any size is dealt into blocks of about ``block`` vectors, and
    every pair of blocks is a task of its own that returns counts and local roots, not pairs.
    """
    vector = F.col(vector_col)
    data = rows.select(F.col(id_col).cast("long").alias("id"), F.col(label_col).alias("label"),
                       vector.cast("array<double>").alias("vec"))
    sound = (
        F.col("id").isNotNull() & F.col("label").isNotNull() & (F.size("vec") > 0)
        & F.forall("vec", lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf")))
        & F.exists("vec", lambda v: v != 0)
    )
    keyed = data.withColumn("sound", F.coalesce(sound, F.lit(False))).withColumn(
        "first", F.xxhash64("label", "vec")).withColumn("second", F.xxhash64(F.reverse("vec"), "label"))
    reps = materialize(
        keyed.where("sound").groupBy("first", "second").agg(
            F.min("id").alias("owner"), F.count("*").alias("n"), F.first("vec").alias("vec"),
            F.xxhash64(F.first("label").cast("string"), F.size(F.first("vec"))).alias("part")), "vector-reps")

    def hashed(batch: pa.RecordBatch) -> pa.RecordBatch:
        owner, n, part = batch.column(0), batch.column(1), batch.column(3).to_numpy().view(np.uint64)
        lists = batch.column(2)
        flat, at = lists.flatten().to_numpy(), lists.offsets.to_numpy() - lists.offsets[0].as_py()
        size = np.diff(at)
        unit: list[bytes] = [b""] * len(size)
        keys = np.zeros((len(size), tables * probes), np.uint64)
        for d in np.unique(size):
            here = np.flatnonzero(size == d)
            x = np.stack([flat[at[k]:at[k + 1]] for k in here])
            x = x / np.abs(x).max(1, keepdims=True)
            x = x / np.sqrt((x * x).sum(1, keepdims=True))
            keys[here] = buckets(x, part[here], tables, probes)
            for k, row in zip(here, x, strict=True):
                unit[k] = row.tobytes()
        return pa.RecordBatch.from_arrays([owner, n, pa.array(unit, pa.binary()),
                                           pa.array([k.tobytes() for k in keys], pa.binary()),
                                           pa.array(list(keys.view(np.int64)), pa.list_(pa.int64()))],
                                          names=["owner", "n", "vec", "keys", "buckets"])

    points = materialize(map_rows(reps.select("owner", "n", "vec", "part"), hashed,
                                  "owner long, n long, vec binary, keys binary, buckets array<long>"), "vector-buckets")
    places = points.select("owner", F.explode("buckets").alias("bucket"))
    crowded = places.groupBy("bucket").agg(F.count("*").alias("n")).where("n > 1").select(
        "bucket", F.ceil(F.col("n") / block).cast("int").alias("chunks"))
    dealt = (
        places.join(crowded, "bucket").withColumn("chunk", F.pmod(F.xxhash64("owner"), "chunks").cast("int"))
        .withColumn("other", F.explode(F.sequence(F.lit(0), F.col("chunks") - 1)))
        .select("bucket", "owner", "chunk", F.least("chunk", "other").alias("i"), F.greatest("chunk", "other").alias("j"))
    )
    solved = materialize(
        dealt.join(points.drop("buckets"), "owner").repartition("bucket", "i", "j").sortWithinPartitions("bucket", "i", "j")
        .select("bucket", "i", "j", "chunk", "owner", "n", "vec", "keys")
        .mapInArrow(lambda batches: link_groups(batches, cosine, probes), "owner long, links long, root long"),
        "vector-links")
    links = solved.groupBy("owner").agg(F.sum("links").alias("links"))
    classes = components(solved.select(F.col("owner").alias("a"), F.col("root").alias("b")), "vectors")
    told = (
        reps.select("first", "second", "owner", "n").join(links, "owner", "left")
        .join(classes.withColumnRenamed("id", "owner"), "owner", "left")
        .select("first", "second", (F.col("n") - 1 + F.coalesce("links", F.lit(0))).alias("l"),
                F.coalesce("component", "owner").alias("c"))
    )
    own = [fresh(rows, n) for n in ("n_links", "component_id", "first", "second", "sound", "l", "c")]
    back = rows.withColumn("_row", F.struct(*rows.columns)).select("_row")
    vec, label, number = (F.col("_row").getField(c) for c in (vector_col, label_col, id_col))
    again = back.withColumn("id", number.cast("long")).withColumn("label", label).withColumn(
        "vec", vec.cast("array<double>")).withColumn("sound", F.coalesce(sound, F.lit(False)))
    again = again.select("_row", "id", F.when(F.col("sound"), F.xxhash64("label", "vec")).alias("first"),
                         F.when(F.col("sound"), F.xxhash64(F.reverse("vec"), "label")).alias("second"))
    return again.join(told, ["first", "second"], "left").select(
        "_row.*", F.coalesce("l", F.lit(0)).cast(T.LongType()).alias(own[0]), F.coalesce("c", "id").alias(own[1]))
