"""Removal of long byte strings that occur earlier in the corpus, found by suffix sorting.

Every 100-byte string (window) of a text is assigned to its lowest 32-byte gram, in an order in which very frequent
grams come last. Equal windows have equal lowest grams, so only runs of windows with the same lowest gram have to
meet. Runs that are equal as a whole are settled by their digests. The windows of the others are suffix-sorted per
gram, deep-shallow: multikey partitioning to a shallow depth, then blind tries for groups that are still together.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from threadlens.llm.common import append_columns, fresh, grouped, map_rows, materialize, string_bytes

LENGTH = 100
GRAM = 32
#: Bytes that the multikey partitioning looks at before tries take over.
SHALLOW = 32
#: Frequent grams are looked for in this many texts, and are those found in that many of them.
SAMPLE, FREQUENT = 4096, 16
FILTER_BITS = 22
SLOT_BITS = 23
TOP = np.uint64(1 << 63)
_A, _B = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xBF58476D1CE4E5B9)


def gram_values(data: np.ndarray) -> np.ndarray:
    """A 63-bit value of every gram of a byte array."""
    h, n = data.astype(np.uint64) + _B, 1
    while n < GRAM and len(h) > n:
        h = h[:-n] * _A + (h[n:] ^ (h[n:] >> np.uint64(29))) * _B
        n *= 2
    h = (h ^ (h >> np.uint64(32))) * _A
    return (h ^ (h >> np.uint64(31))) >> np.uint64(1) if n == GRAM else h[:0]


class Order:
    """Puts frequent grams behind all others."""

    def __init__(self, frequent: np.ndarray):
        self.frequent = np.sort(frequent)
        self.filter = np.zeros(1 << FILTER_BITS, bool)
        self.filter[(frequent >> np.uint64(63 - FILTER_BITS)).astype(np.int64)] = True

    def __call__(self, values: np.ndarray) -> np.ndarray:
        if not len(self.frequent):
            return values
        at = np.flatnonzero(self.filter[(values >> np.uint64(63 - FILTER_BITS)).astype(np.int64)])
        place = np.minimum(np.searchsorted(self.frequent, values[at]), len(self.frequent) - 1)
        values[at[self.frequent[place] == values[at]]] |= TOP
        return values


def lowest(values: np.ndarray, width: int) -> np.ndarray:
    """Minimum of every ``width`` neighbouring values."""
    size, out = 1, values
    while 2 * size <= width:
        out = np.minimum(out[:-size], out[size:])
        size *= 2
    rest = width - size
    return np.minimum(out[:len(out) - rest], out[rest:]) if rest else out


def runs(text: bytes, order: Order, length: int) -> tuple[np.ndarray, ...]:
    """(lowest gram, first window, number of windows, digest, whether its gram stands in it twice) of every run of
    windows with one lowest gram. Windows of one run can only be equal if its gram stands there twice."""
    if len(text) < length:
        none = np.zeros(0, np.int64)
        return none, none, none, none, none.astype(bool)
    values, width = order(gram_values(np.frombuffer(text, np.uint8))), length - GRAM + 1
    low = lowest(values, width)
    start = np.concatenate([[0], np.flatnonzero(low[1:] != low[:-1]) + 1])
    count = np.diff(np.append(start, len(low)))
    view, digest = memoryview(text), xxhash.xxh3_64_intdigest
    marks = np.fromiter((digest(view[a:b]) for a, b in zip(start.tolist(), (start + count + length - 1).tolist(), strict=True)),
                        np.uint64, len(start))
    # a gram is the lowest of some window if it is as low as the highest of its windows' lowest; in the order of their
    # places, such grams change their value just where the runs change
    edge = np.full(width - 1, TOP - np.uint64(1) + TOP, np.uint64)
    highest = ~lowest(np.concatenate([edge, ~low, edge]), width)
    lows = values[values == highest]
    twice = np.bincount(np.concatenate([[0], np.cumsum(lows[1:] != lows[:-1])])) > 1
    return low[start].view(np.int64), start, count, marks.view(np.int64), twice


RUNS = ["part", "mark", "doc", "start", "count", "twice"]
RUN_SCHEMA = "part long, mark long, doc long, start int, count int, twice boolean"


def leaders(part: np.ndarray, mark: np.ndarray, doc: np.ndarray, start: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(sorted order, whether a run is the earliest of its equals, in that order). No two runs share (doc, start)."""
    order = np.lexsort((start, doc, mark, part))
    p, m = part[order], mark[order]
    return order, np.concatenate([[True], (p[1:] != p[:-1]) | (m[1:] != m[:-1])])[:len(p)]


def sort_group(strings: list[bytes], place: np.ndarray, length: int) -> list[list[int]]:
    """Groups of equal strings of ``length`` bytes among the open ones, by a blind trie. A node knows only at which
    byte its branches differ; a string goes down unseen, is compared once with the leaf it reaches, and is put in
    where the two part."""
    root: list | None = None
    leaves: list[list[int]] = []
    numbers = [int.from_bytes(s, "big") for s in strings]
    for i, s in enumerate(strings):
        if root is None:
            root = [length, [i]]
            leaves.append(root[1])
            continue
        node = root
        while node[0] < length:
            node = node[1].get(s[node[0]]) or next(iter(node[1].values()))
        other = node[1][0]
        differ = numbers[i] ^ numbers[other]
        if not differ:
            node[1].append(i)
            continue
        depth = length - (differ.bit_length() + 7) // 8
        leaf = [length, [i]]
        leaves.append(leaf[1])
        above, node = None, root
        while node[0] < depth:
            above, node = node, node[1][s[node[0]]]
        if node[0] == depth and node[0] < length:
            node[1][s[depth]] = leaf
            continue
        branch = [depth, {strings[other][depth]: node, s[depth]: leaf}]
        if above is None:
            root = branch
        else:
            above[1][s[above[0]]] = branch
    return [[int(place[i]) for i in x] for x in leaves if len(x) > 1]


def deep_shallow(data: np.ndarray, window: np.ndarray, group: np.ndarray, length: int) -> list[list[int]]:
    """Lists of windows (numbers into ``window``, which has their places in data) that are equal, in one group.

    Multikey partitioning, eight bytes a step, over all groups at once: windows are sorted by their next bytes inside
    their segment, a segment splits where these differ, and windows left alone are out. What is together at SHALLOW
    bytes goes to a blind trie."""
    padded = np.concatenate([data, np.zeros(8, np.uint8)])
    open_ = np.arange(len(window))
    segment = group
    for depth in range(0, min(SHALLOW, length // 8 * 8), 8):
        word = np.zeros(len(open_), np.uint64)
        for k in range(8):
            word = word << np.uint64(8) | padded[window[open_] + depth + k].astype(np.uint64)
        order = np.lexsort((word, segment))
        open_, word, segment = open_[order], word[order], segment[order]
        new = np.ones(len(open_), bool)
        new[1:] = (word[1:] != word[:-1]) | (segment[1:] != segment[:-1])
        segment = np.cumsum(new)
        alone = new & np.append(new[1:], True)
        open_, segment = open_[~alone], segment[~alone]
        if not len(open_):
            return []
    raw, out = data.tobytes(), []
    cuts = np.flatnonzero(np.diff(segment)) + 1
    for members in np.split(open_, cuts):
        out.extend(sort_group([raw[a:a + length] for a in window[members].tolist()], members, length))
    return out


def settle(table: pa.Table) -> pa.RecordBatch:
    """Runs of whole parts to verdicts: a run with an earlier equal is gone (part null); the others stay open with
    their part if it has several, or if a run may repeat itself; any other run is done with."""
    part, mark, doc, start, count, twice = (table[c].to_numpy() for c in RUNS)
    order, lead = leaders(part, mark, doc, start)
    part, doc, start, count = part[order], doc[order], start[order], count[order]
    edge = np.concatenate([[True], part[1:] != part[:-1]])
    number = np.cumsum(edge) - 1
    several = (np.bincount(number, lead)[number] > 1) | twice[order]
    told = ~lead | several
    return pa.RecordBatch.from_arrays(
        [pa.array(doc[told]), pa.array(start[told]), pa.array(count[told]), pa.array(part[told], mask=~lead[told])],
        names=["doc", "start", "count", "part"])


def compare(table: pa.Table, length: int) -> pa.RecordBatch:
    """Suffix-sorts the windows of whole parts; the windows that have an earlier equal, as runs."""
    part, doc, start, count = (table[c].to_numpy() for c in ("part", "doc", "start", "count"))
    pieces = table["content"].to_pylist()
    size = np.array([len(p) for p in pieces], np.int64)
    begin = np.cumsum(size) - size
    total = np.cumsum(count.astype(np.int64))
    inside = np.arange(total[-1]) - np.repeat(total - count, count)
    owner = np.repeat(np.arange(len(pieces)), count)
    data = np.frombuffer(b"".join(pieces), np.uint8)
    docs, starts = doc[owner], start[owner] + inside
    gone: list[int] = []
    for equal in deep_shallow(data, begin[owner] + inside, part[owner], length):
        first = min(equal, key=lambda w: (docs[w], starts[w]))
        gone.extend(w for w in equal if (docs[w], starts[w]) != (docs[first], starts[first]))
    at = np.array(gone, np.int64)
    return as_runs(docs[at], starts[at])


def as_runs(doc: np.ndarray, start: np.ndarray) -> pa.RecordBatch:
    """Neighbouring windows of a document as (doc, start, count)."""
    order = np.lexsort((start, doc))
    doc, start = doc[order], start[order]
    new = np.ones(len(doc), bool)
    new[1:] = (doc[1:] != doc[:-1]) | (start[1:] != start[:-1] + 1)
    first = np.flatnonzero(new)
    count = np.diff(np.append(first, len(doc)))
    return pa.RecordBatch.from_arrays([pa.array(doc[first], pa.int64()), pa.array(start[first].astype(np.int32)),
                                       pa.array(count.astype(np.int32))], names=["doc", "start", "count"])


def frequent_grams(source: DataFrame, sample: int, least: int) -> np.ndarray:
    """Grams found in at least ``least`` of about ``sample`` texts, which a hash of the id chooses. Only the order of
    the grams depends on them, not the result."""
    total = source.count()
    if not total:
        return np.zeros(0, np.uint64)
    share = min(1.0, sample / total)
    few = source.where(F.pmod(F.xxhash64("doc", F.lit(3)), F.lit(1 << 30)) < int(share * (1 << 30)))

    def count(batches: Iterator[pa.RecordBatch]):
        texts = [t for batch in batches for t in string_bytes(batch.column(0)) if len(t) >= GRAM]
        distinct = lambda t: np.unique(gram_values(np.frombuffer(t, np.uint8)))
        slot = lambda g: (g >> np.uint64(63 - SLOT_BITS)).astype(np.int64)
        # first the texts per slot, then the grams of full slots only, so that no table of all grams is held
        full = np.zeros(1 << SLOT_BITS, np.uint16)
        for text in texts:
            full[np.unique(slot(distinct(text)))] += 1
        found = [g[full[slot(g)] >= least] for g in map(distinct, texts)]
        kinds, times = np.unique(np.concatenate(found), return_counts=True) if found else (np.zeros(0, np.uint64), np.zeros(0))
        yield pa.RecordBatch.from_arrays([pa.array([kinds[times >= least].tobytes()], pa.binary())], names=["grams"])

    rows = few.select("text").repartition(1).mapInArrow(count, "grams binary").collect()
    return np.frombuffer(b"".join(bytes(r.grams) for r in rows), np.uint64)


def rows_apart(docs: DataFrame, id_col: str, text_col: str, number: str) -> DataFrame:
    """docs with a number of its own for every row, in the order of the ids, null first. Written, so that every later
    read sees the same numbers; the last key of the order keeps copies of a row from gathering in one task."""
    ordered = docs.orderBy(F.col(id_col).cast("long").asc_nulls_first(), F.xxhash64(text_col), F.monotonically_increasing_id())
    return materialize(ordered.withColumn(number, F.monotonically_increasing_id()), "suffix-rows")


def remove_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", length: int = LENGTH,
                   sample: int = SAMPLE, frequent: int = FREQUENT) -> DataFrame:
    """All columns of docs, then n_bytes, n_removed, n_spans (maximal removed runs) and kept (bytes, joined).

    Texts are UTF-8 bytes (null: empty). A byte goes if some string of ``length`` bytes over it also starts earlier: in
    a smaller id, or earlier in the same text. Strings are judged on the input. A null id ranks before all others.
    Rows that share an id, or have none, count apart, in the order of a hash of their texts: of a repeated row one copy
    stays. Only a table with such rows is sorted and written with a number for each row. An empty table gives an empty result. Names that docs has already get a leading underscore.

    Before anything is shuffled, a task drops the runs that its own batch has earlier. A gram that many texts have is
    the lowest one only of windows made of such grams, and those are equal runs, which a task sends once.
    """
    spark = docs.sparkSession
    doc, number = F.coalesce(F.col(id_col).cast("long"), F.lit(-(1 << 63))), fresh(docs, "suffix_row")
    if not docs.select(doc.alias("doc")).groupBy("doc").count().where("count > 1").isEmpty():
        docs, doc = rows_apart(docs, id_col, text_col, number), F.col(number)
    source = docs.select(doc.alias("doc"), F.col(text_col).alias("text"))
    shared = spark.sparkContext.broadcast(frequent_grams(source, sample, frequent))
    state: dict = {}

    def cut(batch: pa.RecordBatch) -> pa.RecordBatch:
        if not state:
            state["order"] = Order(shared.value)
        found: list[list[np.ndarray]] = [[], [], [], [], [], []]
        for doc, text in zip(batch.column(0).to_pylist(), string_bytes(batch.column(1)), strict=True):
            part, start, count, mark, twice = runs(text, state["order"], length)
            for to, x in zip(found, (part, mark, np.full(len(part), doc, np.int64), start, count, twice), strict=True):
                to.append(x)
        part, mark, doc, start, count, twice = (np.concatenate(x) if x else np.zeros(0, np.int64) for x in found)
        order, lead = leaders(part, mark, doc, start)
        # what this batch has earlier is gone for certain: told with the mark 0 and no part, neighbours joined
        late, first = order[~lead], order[lead]
        gone = np.lexsort((start[late], doc[late]))
        late = late[gone]
        new = np.ones(len(late), bool)
        new[1:] = (doc[late][1:] != doc[late][:-1]) | (start[late][1:] != (start[late] + count[late])[:-1])
        heads = np.flatnonzero(new)
        sums = np.add.reduceat(count[late], heads) if len(late) else np.zeros(0, np.int64)
        late = late[heads]
        none = np.concatenate([np.zeros(len(first), bool), np.ones(len(late), bool)])
        pick = np.concatenate([first, late])
        return pa.RecordBatch.from_arrays(
            [pa.array(part[pick], mask=none), pa.array(np.where(none, 0, mark[pick])), pa.array(doc[pick]),
             pa.array(start[pick].astype(np.int32)), pa.array(np.concatenate([count[first], sums]).astype(np.int32)),
             pa.array(twice[pick].astype(bool))], names=RUNS)

    cuts = map_rows(source, cut, RUN_SCHEMA)

    def settle_all(batches: Iterator[pa.RecordBatch]):
        for batch in batches:
            lone = batch.filter(batch.column(0).is_null())
            if lone.num_rows:
                yield pa.RecordBatch.from_arrays([lone.column(2), lone.column(3), lone.column(4), lone.column(0)],
                                                 names=["doc", "start", "count", "part"])
            batch = batch.filter(batch.column(0).is_valid())
            if batch.num_rows:
                yield batch

    def verdicts(batches: Iterator[pa.RecordBatch]):
        done: list[pa.RecordBatch] = []

        def split():
            for out in settle_all(batches):
                if out.schema.names == RUNS:
                    yield out
                else:
                    done.append(out)

        for out in grouped(split(), "part", settle):
            yield from done
            done.clear()
            yield out
        yield from done

    # rows without a part need no partner, so they are spread by their document
    target = F.coalesce("part", F.xxhash64("doc", "start"))
    settled = materialize(
        cuts.repartition(target).sortWithinPartitions("part").mapInArrow(
            verdicts, "doc long, start int, count int, part long"), "suffix-verdicts")
    open_ = settled.where("part is not null").groupBy("doc").agg(F.collect_list(F.struct("start", "count", "part")).alias("open"))

    def contents(batch: pa.RecordBatch) -> pa.RecordBatch:
        rows: list[tuple] = []
        for doc, text, own in zip(batch.column(0).to_pylist(), string_bytes(batch.column(1)), batch.column(2).to_pylist(), strict=True):
            for r in own:
                a, n = r["start"], r["count"]
                rows.append((r["part"], doc, a, n, text[a:a + n + length - 1]))
        kinds = [pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.binary()]
        return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], k) for i, k in enumerate(kinds)],
                                          names=["part", "doc", "start", "count", "content"])

    windows = map_rows(source.join(open_, "doc").select("doc", "text", "open"), contents,
                       "part long, doc long, start int, count int, content binary")
    compared = windows.repartition("part").sortWithinPartitions("part").mapInArrow(
        lambda batches: grouped(batches, "part", lambda t: compare(t, length), 1 << 13), "doc long, start int, count int")
    gone = (
        settled.where("part is null").select("doc", "start", "count").unionByName(compared)
        .groupBy("doc").agg(F.collect_list(F.struct("start", "count")).alias("gone"))
    )
    marks, key = fresh(docs, "gone_runs"), fresh(docs, "gone_doc")
    joined = docs.join(gone.select(F.col("doc").alias(key), F.col("gone").alias(marks)),
                       doc == F.col(key), "left").drop(key)

    def finish(texts: pa.Array, found: pa.Array) -> list[pa.Array]:
        sizes, removed, spans, kept = [], [], [], []
        for text, own in zip(string_bytes(texts), found.to_pylist(), strict=True):
            pieces, at, n = [], 0, 0
            for a, b in covered([(r["start"], r["start"] + r["count"] + length - 1) for r in own or ()], len(text)):
                pieces.append(text[at:a])
                at, n = b, n + 1
            pieces.append(text[at:])
            out = b"".join(pieces)
            sizes.append(len(text))
            removed.append(len(text) - len(out))
            spans.append(n)
            kept.append(out)
        return [pa.array(sizes, pa.int64()), pa.array(removed, pa.int64()), pa.array(spans, pa.int64()),
                pa.array(kept, pa.binary())]

    fields = [(fresh(docs, "n_bytes"), T.LongType()), (fresh(docs, "n_removed"), T.LongType()),
              (fresh(docs, "n_spans"), T.LongType()), (fresh(docs, "kept"), T.BinaryType())]
    return append_columns(joined, [text_col, marks], fields, finish).drop(marks, number)


def covered(intervals: list[tuple[int, int]], limit: int) -> list[tuple[int, int]]:
    """The union of intervals, as separate ones in order, cut at ``limit``."""
    out: list[tuple[int, int]] = []
    for a, b in sorted(intervals):
        b = min(b, limit)
        if a >= b:
            continue
        if out and a <= out[-1][1]:
            out[-1] = (out[-1][0], max(out[-1][1], b))
        else:
            out.append((a, b))
    return out
