"""Best-fit packing: token sequences of bounded length, as few as possible.

Only the number of pieces of each length matters for the plan, and there are at most ``capacity`` lengths. Spark cuts
the documents and counts lengths; the plan is made on that histogram (Martello-Toth dominance first, best fit decreasing
for what remains) and is a table of at most a few thousand patterns; every piece then finds its place from its rank
among the pieces of its length.
"""

from __future__ import annotations

import bisect
import zlib
from collections import defaultdict

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from threadlens.llm.common import append_columns, map_rows, materialize
from threadlens.llm.tokens import BatchEncoder

CAPACITY = 2048
END = 0
#: Shares into which the pieces of one length are dealt for ranking.
SHARES = 1024

PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long"


def cut(n: int, capacity: int) -> list[tuple[int, int]]:
    """(start, length) of the pieces of n ids: one, or whole pieces behind a shorter first one."""
    if n <= capacity:
        return [(0, n)]
    head = n % capacity
    pieces = [(0, head)] if head else []
    return pieces + [(s, capacity) for s in range(head, n, capacity)]


def token_pieces(docs: DataFrame, tokenizer: str, id_col: str = "doc_id", text_col: str = "text",
                 capacity: int = CAPACITY) -> DataFrame:
    """The pieces of every document: its ids by the tokenizer file, then id 0, cut to ``capacity``.

    A null text counts as empty, so it is the single id 0.
    """
    state: dict[str, BatchEncoder] = {}

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        if not state:
            state["encoder"] = BatchEncoder(tokenizer)
        rows: list[tuple] = []
        for doc, ids in zip(batch.column(0).to_pylist(), state["encoder"].batch(batch.column(1)), strict=True):
            ids = np.append(ids, np.uint32(END)).astype("<u4")
            for k, (start, length) in enumerate(cut(len(ids), capacity)):
                rows.append((doc, k, start, length, zlib.crc32(ids[start:start + length].tobytes())))
        columns = list(zip(*rows, strict=True)) or [()] * 5
        types = [pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64()]
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types, strict=True)],
                                          names=["doc_id", "piece", "start", "length", "ids_crc32"])

    source = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    return map_rows(source, run, PIECES)


class Plan:
    """Patterns of piece lengths, each with the number of sequences that take it."""

    def __init__(self, capacity: int):
        self.capacity = capacity
        self.patterns: list[tuple[tuple[int, ...], int]] = []

    def add(self, lengths: tuple[int, ...], times: int) -> None:
        if times:
            self.patterns.append((lengths, times))

    @property
    def sequences(self) -> int:
        return sum(n for _, n in self.patterns)

    def slots(self) -> dict[int, list[tuple[int, int, int]]]:
        """For each length: (first rank, first sequence, offset) of its slots, by rank. A slot has consecutive ranks
        and sequences."""
        out: dict[int, list[tuple[int, int, int]]] = defaultdict(list)
        ranks: dict[int, int] = defaultdict(int)
        sequence = 0
        for lengths, times in self.patterns:
            offset = 0
            for length in lengths:
                out[length].append((ranks[length], sequence, offset))
                ranks[length] += times
                offset += length
            sequence += times
        return out


def reduce_by_dominance(counts: dict[int, int], plan: Plan) -> dict[int, int]:
    """Fix sequences that some best packing must be able to hold; returns the counts that remain.

    For the longest open piece w and the room r beside it: alone if nothing fits; with the longest fitting piece x if x
    fills r, or if no two pieces fit r together, or if no three do and x is at least as long as the best pair. In each
    case whatever a packing holds beside w can change places with x, so nothing is lost. As dominance does not depend
    on pieces longer than w, all lengths are visited once, in falling order; a length for which nothing is proven
    stays.
    """
    left = {w: n for w, n in counts.items() if n}
    present = sorted(left)
    for w in sorted(left, reverse=True):
        while left.get(w):
            room = plan.capacity - w
            sizes = [x for x in present if left.get(x)]
            fits = sizes[:bisect.bisect_right(sizes, room)]
            spare = {x: left[x] - (x == w) for x in fits}
            fits = [x for x in fits if spare[x]]
            if not fits:
                plan.add((w,), left.pop(w))
                break
            x = fits[-1]
            low = [y for y in fits[:3] for _ in range(min(3, spare[y]))][:3]
            pair_free = len(low) < 2 or low[0] + low[1] > room
            triple_free = len(low) < 3 or sum(low) > room
            if not (x == room or pair_free or (triple_free and best_pair(fits, spare, room) <= x)):
                break
            if x == w:
                times = left[w] // 2
            else:
                # what is proven for one sequence may change once a shortest or longest length is used up
                times = min(left[w], left[x])
            plan.add((w, x), times)
            left[w] -= times
            left[x] -= times
            left = {k: n for k, n in left.items() if n}
    return left


def best_pair(fits: list[int], spare: dict[int, int], room: int) -> int:
    """The largest sum of two pieces that fits the room."""
    best, i, j = 0, 0, len(fits) - 1
    while i <= j:
        total = fits[i] + fits[j]
        if total > room or (i == j and spare[fits[i]] < 2):
            j -= 1
        else:
            best = max(best, total)
            i += 1
    return best


def best_fit(counts: dict[int, int], plan: Plan) -> None:
    """Best fit decreasing on counted lengths: the longest piece goes to the sequence with the least room that holds
    it. Sequences with equal content are kept as one group, so the work depends on the number of lengths only: each
    length splits at most one group and opens at most one."""
    rooms: dict[int, list[list]] = defaultdict(list)
    order: list[int] = []

    def put(room: int, lengths: tuple[int, ...], times: int) -> None:
        if not rooms[room]:
            bisect.insort(order, room)
        rooms[room].append([lengths, times])

    for w in sorted(counts, reverse=True):
        n = counts[w]
        while n:
            at = bisect.bisect_left(order, w)
            if at == len(order):
                per = plan.capacity // w
                # open the new sequences at once; each takes as many pieces of this length as fit
                whole, rest = divmod(n, per)
                if whole:
                    put(plan.capacity - per * w, (w,) * per, whole)
                if rest:
                    put(plan.capacity - rest * w, (w,) * rest, 1)
                n = 0
                continue
            room = order[at]
            lengths, times = rooms[room].pop()
            if not rooms[room]:
                order.pop(at)
            take = min(times, n)
            if times > take:
                put(room, lengths, times - take)
            put(room - w, (*lengths, w), take)
            n -= take
    for room in list(order):
        for lengths, times in rooms[room]:
            plan.add(lengths, times)


def make_plan(counts: dict[int, int], capacity: int = CAPACITY) -> Plan:
    plan = Plan(capacity)
    best_fit(reduce_by_dominance(counts, plan), plan)
    return plan


def lower_bound(counts: dict[int, int], capacity: int = CAPACITY) -> int:
    """Martello and Toth's second bound on the number of sequences."""
    sizes = sorted(counts)
    best = -(-sum(w * n for w, n in counts.items()) // capacity)
    for k in [0, *[w for w in sizes if w <= capacity // 2]]:
        big = sum(counts[w] for w in sizes if w > capacity - k)
        middle = [w for w in sizes if capacity // 2 < w <= capacity - k]
        n_middle, s_middle = sum(counts[w] for w in middle), sum(w * counts[w] for w in middle)
        small = sum(w * counts[w] for w in sizes if k <= w <= capacity // 2)
        best = max(best, big + n_middle + max(0, -(-(small - (n_middle * capacity - s_middle)) // capacity)))
    return best


def with_ranks(pieces: DataFrame) -> DataFrame:
    """Adds the 0-based rank of each piece among those of its length.

    A length is dealt into SHARES by a hash of the document; the sizes of the shares, at most SHARES per length, give
    the offsets. So a length that a third of the pieces has is ranked by many tasks.
    """
    dealt = pieces.withColumn("share", F.pmod(F.xxhash64("doc_id", "piece", "ids_crc32"), F.lit(SHARES)))
    before = Window.partitionBy("length").orderBy("share").rowsBetween(Window.unboundedPreceding, -1)
    offsets = dealt.groupBy("length", "share").agg(F.count("*").alias("n")).select(
        "length", "share", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base"))
    inside = Window.partitionBy("length", "share").orderBy("doc_id", "piece", "start", "ids_crc32")
    ranked = dealt.withColumn("inside", F.row_number().over(inside)).join(offsets, ["length", "share"])
    return ranked.withColumn("rank", F.col("base") + F.col("inside") - 1).drop("share", "base", "inside")


def pack(docs: DataFrame, tokenizer: str, id_col: str = "doc_id", text_col: str = "text",
         capacity: int = CAPACITY) -> DataFrame:
    """(doc_id, piece, start, length, ids_crc32, sequence_id, offset) of every piece of every row of docs.

    Null and empty texts are the single id 0. Repeated rows are packed each. An empty table gives an empty result.
    Other columns of docs are not read.
    """
    spark = docs.sparkSession
    pieces = materialize(token_pieces(docs, tokenizer, id_col, text_col, capacity), "pieces")
    counts = {r.length: r.n for r in pieces.groupBy("length").agg(F.count("*").alias("n")).collect()}
    slots = {w: np.array(s, np.int64) for w, s in make_plan(counts, capacity).slots().items()}
    # at most `capacity` lengths and a few thousand patterns
    shared = spark.sparkContext.broadcast(slots)

    def place(length: pa.Array, rank: pa.Array) -> list[pa.Array]:
        lengths, ranks = length.to_numpy(), rank.to_numpy()
        sequence, offset = np.empty(len(ranks), np.int64), np.empty(len(ranks), np.int64)
        for w in np.unique(lengths):
            here, table = np.flatnonzero(lengths == w), shared.value[int(w)]
            at = np.searchsorted(table[:, 0], ranks[here], side="right") - 1
            sequence[here] = table[at, 1] + ranks[here] - table[at, 0]
            offset[here] = table[at, 2]
        return [pa.array(sequence), pa.array(offset)]

    placed = append_columns(with_ranks(pieces), ["length", "rank"],
                            [("sequence_id", T.LongType()), ("offset", T.LongType())], place)
    return placed.select("doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset")
