"""Line dedup: a sharded minimal perfect hash over line hashes, probed by the documents.

Lines that occur in many documents are removed from all but one of them. The line hashes that matter are counted by one
aggregate, cut into shards, and every shard becomes a minimal perfect hash with three arrays behind it: fingerprint,
number of documents and largest document id. Documents look their lines up in these arrays; lines are never joined.
"""

from __future__ import annotations

import pickle

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from threadlens.llm.common import append_columns, fresh, map_rows, materialize, string_bytes

#: Characters stripped from both ends of a line.
BLANK = b" \t\n\x0b\x0c\r"
#: Keys of a shard, about; the number of shards follows from the number of keys.
SHARD_KEYS = 1 << 16
#: Bytes of shards that one probing pass holds in memory, at most, beyond a single shard.
WAVE_BYTES = 128 << 20
NO_ID = -(1 << 63)
MIX = np.uint64(0x9E3779B97F4A7C15)


def line_key(line: bytes) -> bytes:
    """The line without blanks at its ends, A-Z in lower case."""
    return line.strip(BLANK).lower()


def code_points(key: bytes) -> int:
    return len(key) if key.isascii() else len(key.decode("utf-8", "replace"))


def long_keys(text: bytes, min_chars: int):
    """(line number, 128-bit hash) of every line whose key has min_chars code points."""
    for i, line in enumerate(text.split(b"\n")):
        if len(line) >= min_chars:
            key = line_key(line)
            if len(key) >= min_chars and code_points(key) >= min_chars:
                yield i, xxhash.xxh3_128_digest(key)


def _hash_of(keys: np.ndarray, level: int, size: int) -> np.ndarray:
    with np.errstate(over="ignore"):
        x = (keys ^ (keys >> np.uint64(29))) * MIX + np.uint64(level + 1) * np.uint64(0xD6E8FEB86659FD93)
        x = (x ^ (x >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
        return (x ^ (x >> np.uint64(31))) % np.uint64(size)


class PerfectHash:
    """Minimal perfect hash of distinct 64-bit keys.

    Each level is a bit array of twice the open keys; a key that meets no other one there is placed, the rest go to the
    next level. The rank of a key's bit over all levels is its number.
    """

    def __init__(self, keys: np.ndarray):
        self.bits, self.ranks, self.size = [], [], 0
        level = 0
        while len(keys):
            size = max(2 * len(keys), 8)
            at = _hash_of(keys, level, size)
            alone = np.bincount(at.astype(np.int64), minlength=size) == 1
            self.bits.append(alone)
            self.ranks.append((np.cumsum(alone) - 1 + self.size).astype(np.uint32))
            self.size += int(alone.sum())
            keys = keys[~alone[at.astype(np.int64)]]
            level += 1

    def __call__(self, keys: np.ndarray) -> np.ndarray:
        """The numbers of the keys. A key outside the set gets any number, or -1."""
        out = np.full(len(keys), -1, np.int64)
        open_ = np.arange(len(keys))
        for level, bits in enumerate(self.bits):
            at = _hash_of(keys[open_], level, len(bits)).astype(np.int64)
            hit = bits[at]
            out[open_[hit]] = self.ranks[level][at[hit]]
            open_ = open_[~hit]
        return out


def build_shard(first: np.ndarray, second: np.ndarray, count: np.ndarray, last: np.ndarray) -> bytes:
    """Perfect hash over ``first``; fingerprints ``second``, counts and largest ids at the numbers it gives."""
    # two lines could share the first 64 bits; the second half tells them apart, so both take part in the key
    keys = first ^ (second * MIX)
    perfect = PerfectHash(keys)
    at = perfect(keys)
    arrays = [np.empty(len(keys), x.dtype) for x in (second, count, last)]
    for to, x in zip(arrays, (second, count, last), strict=True):
        to[at] = x
    packed = [np.packbits(b) for b in perfect.bits]
    sizes = [len(b) for b in perfect.bits]
    return pickle.dumps((packed, sizes, *arrays), protocol=5)


class Shard:
    def __init__(self, blob: bytes):
        packed, sizes, self.prints, self.counts, self.last = pickle.loads(blob)
        self.perfect = PerfectHash(np.zeros(0, np.uint64))
        before = 0
        for bits, size in zip(packed, sizes, strict=True):
            alone = np.unpackbits(bits, count=size).astype(bool)
            self.perfect.bits.append(alone)
            self.perfect.ranks.append((np.cumsum(alone) - 1 + before).astype(np.uint32))
            before += int(alone.sum())

    def probe(self, first: np.ndarray, second: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(found, largest id) of each line hash."""
        with np.errstate(over="ignore"):
            at = self.perfect(first ^ (second * MIX))
        found = at >= 0
        found[found] = self.prints[at[found]] == second[found]
        return found, self.last[np.where(found, at, 0)] if len(self.last) else np.zeros(len(first), np.int64)


def count_lines(docs: DataFrame, id_col: str, text_col: str, min_chars: int, min_docs: int) -> DataFrame:
    """(first, second, n_docs, last_id) of every long line found in at least min_docs documents."""

    def keys(batch: pa.RecordBatch) -> pa.RecordBatch:
        halves, ids = [], []
        for doc, text in zip(batch.column(0).to_pylist(), string_bytes(batch.column(1)), strict=True):
            distinct = {h for _, h in long_keys(text, min_chars)}
            halves.extend(distinct)
            ids.extend([NO_ID if doc is None else doc] * len(distinct))
        pair = np.frombuffer(b"".join(halves), "<i8").reshape(-1, 2)
        return pa.RecordBatch.from_arrays(
            [pa.array(pair[:, 0].copy()), pa.array(pair[:, 1].copy()), pa.array(ids, pa.int64())],
            names=["first", "second", "doc"])

    lines = map_rows(docs.select(F.col(id_col).cast("long").alias("doc"), F.col(text_col).alias("text")), keys,
                     "first long, second long, doc long")
    return (
        lines.groupBy("first", "second").agg(F.count("*").alias("n_docs"), F.max("doc").alias("last_id"))
        .where(F.col("n_docs") >= min_docs)
    )


def build_index(counted: DataFrame, shard_keys: int = SHARD_KEYS) -> tuple[DataFrame, int]:
    """One row (shard, size, blob) per shard, written; and the number of shards. Shard sizes are even, as hashes are."""
    counted = materialize(counted, "line-counts")
    shards = max(1, -(-counted.count() // shard_keys))

    def build(key: tuple[pa.Scalar, ...], table: pa.Table) -> pa.Table:
        u = [table.column(c).to_numpy() for c in ("first", "second")]
        blob = build_shard(u[0].view(np.uint64), u[1].view(np.uint64),
                           table.column("n_docs").to_numpy().astype(np.uint32), table.column("last_id").to_numpy())
        return pa.table({"shard": [key[0].as_py()], "size": pa.array([len(blob)], pa.int64()), "blob": [blob]},
                        schema=pa.schema([("shard", pa.int64()), ("size", pa.int64()), ("blob", pa.binary())]))

    index = (
        counted.withColumn("shard", F.pmod(F.col("second"), F.lit(shards))).groupBy("shard")
        .applyInArrow(build, "shard long, size long, blob binary")
    )
    return materialize(index, "line-index"), shards


def dedup_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_chars: int = 40,
                min_docs: int = 5, shard_keys: int = SHARD_KEYS, wave_bytes: int = WAVE_BYTES) -> DataFrame:
    """All columns of docs, then n_lines, n_dropped (lines) and kept_text.

    A text is cut at \\n; null and empty texts are one empty line. Lines whose key has at least ``min_chars`` code
    points and is found in at least ``min_docs`` documents stay only in the document with the largest id that holds
    them, there with all repeats. Every row is a document; rows that share the largest id all keep the line, and a null
    id counts below all others. Added columns that docs has already get leading underscores. An empty table gives an
    empty result.

    Only lines found in ``min_docs`` documents are indexed. The shards are probed in waves of at most ``wave_bytes``
    (or one shard); between waves the documents are written with the line numbers found so far.
    """
    spark = docs.sparkSession
    index, shards = build_index(count_lines(docs, id_col, text_col, min_chars, min_docs), shard_keys)
    waves: list[list[int]] = [[]]
    held = 0
    for shard, size in sorted(map(tuple, index.select("shard", "size").collect())):
        if waves[-1] and held + size > wave_bytes:
            waves.append([])
            held = 0
        waves[-1].append(shard)
        held += size

    names = [fresh(docs, n) for n in ("n_lines", "n_dropped", "kept_text")]
    marks = fresh(docs, "line_marks")
    current = docs
    for wave, members in enumerate(waves):
        rows = index.where(F.col("shard").isin(members)).select("shard", "blob").collect() if members else []
        probe = _prober(spark.sparkContext.broadcast({r.shard: bytes(r.blob) for r in rows}), shards, min_chars)
        inputs = [id_col, text_col] + [marks] * (wave > 0)
        if wave < len(waves) - 1:
            marked = append_columns(current, inputs, [("line_marks_new", T.ArrayType(T.IntegerType()))],
                                    lambda *c, f=probe: [pa.array([sorted(x) for x in f(*c)], pa.list_(pa.int32()))])
            current = materialize(marked.drop(marks).withColumnRenamed("line_marks_new", marks), "line-marks")
            continue

        def finish(*columns: pa.Array, f=probe) -> list[pa.Array]:
            totals, dropped, kept = [], [], []
            for text, out in zip(string_bytes(columns[1]), f(*columns), strict=True):
                totals.append(text.count(b"\n") + 1)
                dropped.append(len(out))
                kept.append(b"\n".join(x for i, x in enumerate(text.split(b"\n")) if i not in out) if out else text)
            return [pa.array(totals, pa.int64()), pa.array(dropped, pa.int64()),
                    pa.array(kept, pa.binary()).cast(pa.string())]

        current = append_columns(current, inputs, [(names[0], T.LongType()), (names[1], T.LongType()),
                                                   (names[2], T.StringType())], finish)
    return current.drop(marks)


def _prober(shared, shards: int, min_chars: int):
    """A function of (ids, texts, marks) to one set of line numbers per document."""
    opened: dict[int, Shard] = {}

    def probe(ids: pa.Array, texts: pa.Array, marks: pa.Array | None = None) -> list[set[int]]:
        blobs = shared.value
        hashes, rows, lines = [], [], []
        for row, text in enumerate(string_bytes(texts)):
            for i, h in long_keys(text, min_chars):
                hashes.append(h)
                rows.append(row)
                lines.append(i)
        found_lines = [set(x or ()) for x in marks.to_pylist()] if marks is not None else [set() for _ in range(len(ids))]
        if not hashes:
            return found_lines
        pair = np.frombuffer(b"".join(hashes), "<u8").reshape(-1, 2)
        row_of, line_of = np.array(rows), np.array(lines)
        doc = np.array([NO_ID if x is None else x for x in ids.to_pylist()], np.int64)
        shard_of = pair[:, 1].view(np.int64) % shards
        for shard in np.unique(shard_of):
            if int(shard) not in blobs:
                continue
            if int(shard) not in opened:
                opened[int(shard)] = Shard(blobs[int(shard)])
            here = np.flatnonzero(shard_of == shard)
            found, last = opened[int(shard)].probe(pair[here, 0], pair[here, 1])
            gone = found & (last != doc[row_of[here]])
            for at in here[gone]:
                found_lines[row_of[at]].add(int(line_of[at]))
        return found_lines

    return probe
