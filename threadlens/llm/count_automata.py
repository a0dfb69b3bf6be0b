"""Phrase mining with weighted acyclic automata.

A shard's n-grams are sorted and become one automaton per prefix range, built from the last words to the first: equal
states are one state, and the weight on an arc is the count of the n-gram that ends with it. Automata of the same prefix
range are united and their weights summed. The phrases that occur often enough go through the united automata once more,
which yields the counts of their parts.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from threadlens.llm.common import materialize, parts_of
from threadlens.operators.skew import top_k

#: Bytes that end a piece, and bytes between words.
BREAKS = b".,;:!?\n\x0b\x0c\r"
BLANKS = b" \t"
#: Words of a phrase, at most.
LONGEST = 3
#: Words of a shard, at most; the number of a word then fits 20 bits.
SHARD_WORDS = (1 << 20) - 4
#: Words that a task holds over all languages before it closes its shards.
HELD_WORDS = 1 << 20
#: Bytes of texts that are cut into words at once, about.
PART_BYTES = 4 << 20
#: N-gram occurrences of a prefix range, about.
RANGE_GRAMS = 4_000_000
#: Bounds of ranges take this many bytes at most; ranges grow with larger tables.
BOUND_BYTES = 64 << 20
#: Share of the rows, and distance of the words in them, whose n-grams lay out the ranges. They decide no count.
SAMPLE_SHARE = 1 / 16
SAMPLE_STEP = 32

_KIND = np.zeros(256, np.uint8)
_KIND[list(BLANKS)] = 1
_KIND[list(BREAKS)] = 2


def words_of(texts: pa.Array) -> tuple[pa.Array, np.ndarray, np.ndarray]:
    """(words as binary, whether a piece starts with the word, row of the word). A-Z are lower-cased."""
    raw = [x.as_py() or b"" for x in texts.cast(pa.binary())]
    data = np.frombuffer(b"\n".join(raw) + b"\n", np.uint8)
    data = np.where((data >= 65) & (data <= 90), data + np.uint8(32), data)
    kind = _KIND[data]
    inside = kind == 0
    edge = np.flatnonzero(np.diff(np.concatenate([[False], inside]).astype(np.int8)))
    starts, ends = edge[0::2], edge[1::2]
    upto = np.searchsorted(np.flatnonzero(kind == 2), starts)
    first = np.concatenate([[True], upto[1:] != upto[:-1]])[:len(starts)]
    row = np.searchsorted(np.cumsum([len(x) + 1 for x in raw]), starts, side="right")
    offsets = np.concatenate([[0], np.cumsum(ends - starts)]).astype(np.int64)
    words = pa.Array.from_buffers(pa.large_binary(), len(starts), [None, pa.py_buffer(offsets), pa.py_buffer(data[inside])])
    return words, first, row


def numbered(words: pa.Array) -> tuple[np.ndarray, pa.Array]:
    """(number of each word, words in byte order)."""
    coded = words.dictionary_encode()
    order = pc.sort_indices(coded.dictionary).to_numpy()
    rank = np.empty(len(order), np.int64)
    rank[order] = np.arange(len(order))
    return rank[coded.indices.to_numpy()], coded.dictionary.take(pa.array(order))


def pack(first: np.ndarray, second: np.ndarray, third: np.ndarray) -> np.ndarray:
    """One number for three places, 0 where there is no word, that sorts as the n-grams do."""
    return (first << 42) | (second << 21) | third


def count_grams(words: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(packed n-grams ascending, counts) of numbered words. Word w stands as 2 w + 2, so a bound between fits."""
    w = 2 * words + 2
    none = np.zeros_like(w)
    grams = [pack(w, none, none)]
    if len(w) > 1:
        two = ~first[1:]
        grams.append(pack(w[:-1], w[1:], none[1:])[two])
        three = two[:-1] & two[1:]
        grams.append(pack(w[:-2], w[1:-1], w[2:])[three])
    keys = np.sort(np.concatenate(grams))
    heads = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]]))[:len(keys)]
    return keys[heads], np.diff(np.concatenate([heads, [len(keys)]]))


def register(heads: np.ndarray, total: int, columns: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """States given as runs of arcs that start at heads: (number of each state, first arc and number of arcs of each
    distinct one). States with the same arcs get the same number."""
    sizes = np.diff(np.concatenate([heads, [total]]))
    state = np.empty(len(heads), np.int64)
    single = np.flatnonzero(sizes == 1)
    order = np.lexsort([c[heads[single]] for c in columns[::-1]])
    ordered = np.stack([c[heads[single]][order] for c in columns])
    new = np.concatenate([[True], (ordered[:, 1:] != ordered[:, :-1]).any(0)])[:len(single)]
    state[single[order]] = np.cumsum(new) - 1
    kept = [single[order][new]]
    known: dict[bytes, int] = {}
    rows = np.ascontiguousarray(np.stack(columns, 1))
    extra = []
    for i in np.flatnonzero(sizes > 1).tolist():
        arcs = rows[heads[i]:heads[i] + sizes[i]].tobytes()
        at = known.get(arcs)
        if at is None:
            at = known[arcs] = int(new.sum()) + len(extra)
            extra.append(i)
        state[i] = at
    kept = np.concatenate([*kept, np.array(extra, np.int64)])
    return state, heads[kept], sizes[kept]


def spread(starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    return np.arange(int(sizes.sum())) - np.repeat(np.cumsum(sizes) - sizes, sizes) + np.repeat(starts, sizes)


class CountAutomaton:
    """Arcs in layers, one a word of the n-gram: label, weight and, but in the last layer, target state. State s of a
    layer has the arcs from ``starts[s]`` to ``starts[s + 1]``; state 0 of the lower layers has none. Weight 0 means that
    the n-gram that ends there is not in the automaton."""

    def __init__(self, words: pa.Array, layers: list[dict[str, np.ndarray]]):
        self.words, self.layers = words, layers

    @classmethod
    def from_sorted(cls, words: pa.Array, columns: list[np.ndarray], counts: np.ndarray) -> CountAutomaton:
        """From n-grams in order: columns of word numbers, 0 for none and w + 1 for word w, and counts. States are
        registered from the last layer to the first."""
        layers: list[dict[str, np.ndarray]] = []
        depth = len(columns)
        length = sum((c > 0).astype(np.int64) for c in columns)
        heads_of = []
        changed = np.zeros(len(counts), bool)
        changed[:1] = True
        for c in columns:
            changed = changed.copy()
            changed[1:] |= c[1:] != c[:-1]
            heads_of.append(np.flatnonzero(changed & (c > 0)))
        target = None
        for d in range(depth - 1, -1, -1):
            heads = heads_of[d]
            label = columns[d][heads] - 1
            weight = np.where(length[heads] == d + 1, counts[heads], 0) if len(heads) else np.zeros(0, np.int64)
            arcs = [label, weight] + ([] if target is None else [target])
            if d == 0:
                starts = np.array([0, len(heads)])
            else:
                parents = heads_of[d - 1]
                # arcs of a parent: those whose row is at or behind the parent's and before the next parent's
                of = np.searchsorted(parents, heads, side="right") - 1
                first = np.flatnonzero(np.concatenate([[True], of[1:] != of[:-1]]))[:len(of)]
                state, kept, sizes = register(first, len(heads), arcs)
                target = np.zeros(len(parents), np.int64)
                target[of[first]] = state + 1
                where = spread(kept, sizes)
                arcs = [a[where] for a in arcs]
                starts = np.concatenate([[0, 0], np.cumsum(sizes)])
            layers.insert(0, dict(zip(("label", "weight", "target"), arcs, strict=False)) | {"starts": starts})
        return cls(words, layers)

    def paths(self) -> Iterator[tuple[list[np.ndarray], np.ndarray, np.ndarray]]:
        """(word numbers in columns, weights, path above) of every path from the start, layer by layer."""
        state, columns = np.zeros(1, np.int64), []
        for layer in self.layers:
            sizes = np.diff(layer["starts"])[state]
            arcs = spread(layer["starts"][state], sizes)
            above = np.repeat(np.arange(len(state)), sizes)
            columns = [c[above] for c in columns] + [layer["label"][arcs]]
            yield columns, layer["weight"][arcs], above
            if "target" in layer:
                state = layer["target"][arcs]

    def lookup(self, grams: list[list[np.ndarray]]) -> np.ndarray:
        """Counts of n-grams given as columns of word numbers, -1 behind the end; 0 for those that are not there."""
        n = len(grams[0])
        state, out, alive = np.zeros(n, np.int64), np.zeros(n, np.int64), np.ones(n, bool)
        width = len(self.words) + 1
        for layer, label in zip(self.layers, grams, strict=True):
            here = label >= 0
            arcs = np.repeat(np.arange(len(layer["starts"]) - 1), np.diff(layer["starts"])) * width + layer["label"]
            want = state * width + label
            at = np.minimum(np.searchsorted(arcs, want), max(0, len(arcs) - 1))
            alive &= here & (arcs[at] == want if len(arcs) else False)
            out[here] = np.where(alive, layer["weight"][at], 0)[here] if len(arcs) else 0
            if "target" in layer:
                state = np.where(alive, layer["target"][at], 0) if len(arcs) else np.zeros(n, np.int64)
        return out

    def dump(self) -> bytes:
        fields, arrays = ["words"], [pa.ListArray.from_arrays(pa.array([0, len(self.words)], pa.int32()), self.words.cast(pa.binary()))]
        for d, layer in enumerate(self.layers):
            for name, x in layer.items():
                kind = next(k for k in (np.uint8, np.uint16, np.uint32, np.int64) if not len(x) or x.max() <= np.iinfo(k).max)
                fields.append(f"{d}{name}")
                arrays.append(pa.ListArray.from_arrays(pa.array([0, len(x)], pa.int32()), pa.array(x.astype(kind))))
        batch = pa.RecordBatch.from_arrays(arrays, names=fields)
        sink = pa.BufferOutputStream()
        with pa.ipc.new_stream(sink, batch.schema) as out:
            out.write_batch(batch)
        return sink.getvalue().to_pybytes()

    @classmethod
    def load(cls, blob: bytes) -> CountAutomaton:
        batch = pa.ipc.open_stream(blob).read_next_batch()
        layers: list[dict[str, np.ndarray]] = []
        for name, column in zip(batch.schema.names[1:], batch.columns[1:], strict=True):
            if int(name[0]) == len(layers):
                layers.append({})
            layers[-1][name[1:]] = column.values.to_numpy(zero_copy_only=False).astype(np.int64)
        return cls(batch.column(0).values, layers)


def positions(words: pa.Array, asked: pa.Array) -> np.ndarray:
    """Numbers of the asked words among the sorted words, -1 for those that are not there."""
    return pc.fill_null(pc.index_in(asked, words), -1).to_numpy().astype(np.int64)


def union(automata: list[CountAutomaton], min_count: int) -> tuple[CountAutomaton, int]:
    """(automaton of all n-grams with the summed weights of at least min_count, sum of the weights of single words).

    Layer by layer: arcs with the same label out of the same united state become one.
    """
    merged, ordered = numbered(pa.concat_arrays([a.words for a in automata]))
    cut = np.cumsum([0, *[len(a.words) for a in automata]])
    renumber = [merged[x:y] for x, y in zip(cut[:-1], cut[1:], strict=True)]
    walks = [list(a.paths()) for a in automata]
    width = len(ordered) + 1
    columns: list[np.ndarray] = []
    found: list[tuple[list[np.ndarray], np.ndarray]] = []
    total = 0
    state = [np.zeros(1, np.int64)] * len(automata)
    for d in range(LONGEST):
        keys = [before[walk[d][2]] * width + number[walk[d][0][-1]]
                for number, walk, before in zip(renumber, walks, state, strict=True)]
        values, at = np.unique(np.concatenate(keys), return_inverse=True)
        summed = np.bincount(at, np.concatenate([walk[d][1] for walk in walks]), len(values)).astype(np.int64)
        above, label = np.divmod(values, width)
        columns = [c[above] for c in columns] + [label]
        often = summed >= min_count
        found.append(([c[often] for c in columns], summed[often]))
        total += int(summed.sum()) if d == 0 else 0
        ends = np.cumsum([len(k) for k in keys])
        state = [at[e - len(k):e] for e, k in zip(ends, keys, strict=True)]
    return from_grams(ordered, found), total


def from_grams(ordered: pa.Array, found: list[tuple[list[np.ndarray], np.ndarray]]) -> CountAutomaton:
    """The automaton of n-grams given by length, in columns of numbers of the ordered words; only words in use stay."""
    none = np.zeros(0, np.int64)
    columns = [np.concatenate([none, *[(c[d] + 1 if d < len(c) else np.zeros(len(n), np.int64)) for c, n in found]])
               for d in range(LONGEST)]
    counts = np.concatenate([none, *[n for _, n in found]])
    used = np.unique(np.concatenate(columns))
    used = used[used > 0]
    rank = np.zeros(len(ordered) + 2, np.int64)
    rank[used] = np.arange(len(used)) + 1
    columns = [rank[c] for c in columns]
    order = np.lexsort(columns[::-1])
    return CountAutomaton.from_sorted(ordered.take(pa.array(used - 1)), [c[order] for c in columns], counts[order])


class Bounds:
    """Lower ends of the prefix ranges: (language, words) in order. N-grams before the first one are range 0."""

    def __init__(self, rows: list[tuple[str, tuple[bytes, ...]]]):
        self.of: dict[str, tuple[int, list[tuple[bytes, ...]]]] = {}
        self.langs = sorted({lang for lang, _ in rows}, key=str.encode)
        at = 0
        for lang in self.langs:
            mine = sorted({b for other, b in rows if other == lang})
            self.of[lang] = (at, mine)
            at += len(mine)
        self.size = at + 1

    def first(self, lang: str) -> int:
        """The range in which the n-grams of a language start."""
        if lang in self.of:
            return self.of[lang][0]
        before = [x for x in self.langs if x.encode() < lang.encode()]
        return self.of[before[-1]][0] + len(self.of[before[-1]][1]) if before else 0

    def packed(self, lang: str, words: pa.Array) -> np.ndarray:
        """The bounds of a language as packed n-grams over sorted words; a word that is not among them falls between."""
        mine = self.of.get(lang, (0, []))[1]
        if not mine:
            return np.zeros(0, np.int64)
        flat = sorted({w for b in mine for w in b})
        place = dict(zip(flat, word_places(words, flat), strict=True))
        rows = [[place[w] for w in b] + [0] * (LONGEST - len(b)) for b in mine]
        # behind a word that is not among them, the rest of the bound decides nothing
        rows = [[x if all(y % 2 == 0 for y in r[:i]) else 0 for i, x in enumerate(r)] for r in rows]
        return pack(*np.array(rows, np.int64).T)


def word_places(words: pa.Array, asked: list[bytes]) -> list[int]:
    """2 w + 2 for word w of the sorted words, and the odd number between for a word that is not there."""
    both, ordered = numbered(pa.concat_arrays([words.cast(pa.large_binary()), pa.array(asked, pa.large_binary())]))
    n = len(words)
    mine, theirs = both[:n], both[n:]
    at = np.searchsorted(mine, theirs)
    there = (at < n) & (mine[np.minimum(at, max(0, n - 1))] == theirs) if n else np.zeros(len(asked), bool)
    return np.where(there, 2 * at + 2, 2 * at + 1).tolist()


def close_shard(lang: str, words: pa.Array, first: np.ndarray, last: int, bounds: Bounds) -> Iterator[tuple[int, str, bytes]]:
    """(range, language, automaton) of the n-grams that start at the first ``last`` words."""
    numbers, ordered = numbered(words)
    # words behind the last start only end n-grams here; those that start with them are the next shard's
    keys, counts = count_grams(numbers, first)
    if last < len(numbers):
        more, less = count_grams(numbers[last:], first[last:])
        counts = counts.copy()
        np.subtract.at(counts, np.searchsorted(keys, more), less)
        keys, counts = keys[counts > 0], counts[counts > 0]
    at = np.searchsorted(keys, bounds.packed(lang, ordered))
    edges = [0, *at.tolist(), len(keys)]
    none = np.zeros(0, np.int64)
    for i, (x, y) in enumerate(zip(edges[:-1], edges[1:], strict=True)):
        if x == y:
            continue
        part = keys[x:y]
        columns = [(part >> shift & ((1 << 21) - 1)) for shift in (42, 21, 0)]
        columns = [c // 2 for c in columns]  # 2 w + 2 becomes w + 1, 0 stays
        used = np.unique(np.concatenate([none, *columns]))
        used = used[used > 0]
        rank = np.zeros(len(ordered) + 2, np.int64)
        rank[used] = np.arange(len(used)) + 1
        made = CountAutomaton.from_sorted(ordered.take(pa.array(used - 1)), [rank[c] for c in columns], counts[x:y])
        yield bounds.first(lang) + i, lang, made.dump()


SHARDS = "range long, lang string, blob binary"
SHARD_SCHEMA = pa.schema([("range", pa.int64()), ("lang", pa.string()), ("blob", pa.binary())])


def shard_automata(docs: DataFrame, bounds) -> DataFrame:
    """(range, lang, blob): the automata of every shard, cut at the bounds. docs has lang and text."""

    def run(batches: Iterator[pa.RecordBatch]):
        held: dict[str, list] = {}
        n = 0

        def close(lang: str) -> Iterator[pa.RecordBatch]:
            words = pa.concat_arrays([w for w, _ in held[lang]])
            first = np.concatenate([f for _, f in held[lang]])
            held[lang] = []
            step = SHARD_WORDS - LONGEST
            for start in range(0, len(words), step):
                stop = min(len(words), start + step)
                # n-grams that start in the shard may end behind it
                reach = min(len(words), stop + LONGEST - 1)
                rows = list(close_shard(lang, words.slice(start, reach - start), first[start:reach], stop - start, bounds.value))
                yield pa.RecordBatch.from_arrays([pa.array(x, f.type) for x, f in zip(zip(*rows, strict=True), SHARD_SCHEMA, strict=True)],
                                                 schema=SHARD_SCHEMA)

        for batch in batches:
            for part in parts_of(batch, PART_BYTES):
                langs = part.column(0).dictionary_encode()
                words, first, row = words_of(part.column(1))
                of = langs.indices.to_numpy()[row] if len(row) else np.zeros(0, np.int64)
                for i, lang in enumerate(langs.dictionary.to_pylist()):
                    mine = np.flatnonzero(of == i)
                    if len(mine):
                        held.setdefault(lang, []).append((words.take(pa.array(mine)), first[mine]))
                        n += len(mine)
                if n >= HELD_WORDS:
                    for lang in [x for x in held if held[x]]:
                        yield from close(lang)
                    n = 0
        for lang in [x for x in held if held[x]]:
            yield from close(lang)

    return docs.mapInArrow(run, SHARDS)


def find_bounds(docs: DataFrame, range_grams: int) -> Bounds:
    """Bounds of ranges of about ``range_grams`` n-gram occurrences, from a sample. They lay out the work only."""

    def run(batches: Iterator[pa.RecordBatch]):
        for batch in batches:
            for part in parts_of(batch, PART_BYTES):
                words, first, row = words_of(part.column(1))
                langs = part.column(0).take(pa.array(row[::SAMPLE_STEP]))
                columns = [langs]
                for d in range(LONGEST):
                    at = np.arange(0, len(words), SAMPLE_STEP) + d
                    columns.append(words.take(pa.array(np.minimum(at, max(0, len(words) - 1)))).cast(pa.binary()))
                yield pa.RecordBatch.from_arrays(columns, names=["lang", "a", "b", "c"])

    sample = docs.sample(SAMPLE_SHARE, seed=11).mapInArrow(run, "lang string, a binary, b binary, c binary")
    sample = materialize(sample, "gram-sample")
    n, size = sample.agg(F.count("*"), F.avg(F.length("a") + F.length("b") + F.length("c") + F.length("lang"))).first()
    grams = n * SAMPLE_STEP / SAMPLE_SHARE * LONGEST
    ranges = int(min(grams // range_grams, BOUND_BYTES // max(1, int(size or 1)))) + 1
    if ranges == 1:
        return Bounds([])
    key = F.struct("lang", "a", "b", "c")
    lowest = (
        sample.repartitionByRange(ranges, "lang", "a", "b", "c").groupBy(F.spark_partition_id().alias("p"))
        .agg(F.min(key).alias("low")).select("low.*").collect()
    )
    rows = sorted((r.lang, (bytes(r.a), bytes(r.b), bytes(r.c))) for r in lowest)
    return Bounds(rows[1:])


def united(shards: DataFrame, min_count: int) -> DataFrame:
    """(range, lang, words, blob): one automaton per range and language, n-grams of at least ``min_count``; words is the
    number of word occurrences that fall in the range."""

    def solve(key: tuple[pa.Scalar, ...], table: pa.Table) -> pa.Table:
        made, total = union([CountAutomaton.load(b.as_py()) for b in table.column("blob")], min_count)
        return pa.table({"range": [key[0].as_py()], "lang": [key[1].as_py()], "words": [total], "blob": [made.dump()]},
                        schema=pa.schema([("range", pa.int64()), ("lang", pa.string()), ("words", pa.int64()), ("blob", pa.binary())]))

    return materialize(
        shards.groupBy("range", "lang").applyInArrow(solve, "range long, lang string, words long, blob binary"), "phrase-automata")


def text_of(words: pa.Array, columns: list[np.ndarray]) -> pa.Array:
    """The n-grams with a space between words."""
    parts = [words.cast(pa.binary()).take(pa.array(c)) for c in columns]
    joined = parts[0] if len(parts) == 1 else pc.binary_join_element_wise(*parts, b" ")
    return joined.cast(pa.string())


def candidates_of(automata: DataFrame) -> DataFrame:
    """(lang, phrase, k, a) of all n-grams of two words and more in the automata."""

    def run(batches: Iterator[pa.RecordBatch]):
        for batch in batches:
            for lang, blob in zip(batch.column(0), batch.column(1), strict=True):
                made = CountAutomaton.load(blob.as_py())
                for columns, weights, _ in list(made.paths())[1:]:
                    there = weights > 0
                    text = text_of(made.words, [c[there] for c in columns])
                    yield pa.RecordBatch.from_arrays(
                        [pa.array([lang.as_py()] * len(text), pa.string()), text, pa.array([len(columns)] * len(text), pa.int32()),
                         pa.array(weights[there])], names=["lang", "phrase", "k", "a"])

    return automata.select("lang", "blob").mapInArrow(run, "lang string, phrase string, k int, a long")


def routed(parts: DataFrame, bounds) -> DataFrame:
    """parts (lang, part, more columns) with the range of the part in front."""
    schema = "range long, " + ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in parts.schema.fields)

    def run(batches: Iterator[pa.RecordBatch]):
        for batch in batches:
            out = np.zeros(batch.num_rows, np.int64)
            langs = batch.column(0).dictionary_encode()
            of = langs.indices.to_numpy()
            words = [x.split(b" ") for x in batch.column(1).cast(pa.binary()).to_pylist()]
            for i, lang in enumerate(langs.dictionary.to_pylist()):
                rows = np.flatnonzero(of == i)
                vocabulary = pa.array(sorted({w for r in rows for w in words[r]}), pa.large_binary())
                number = {w: j for j, w in enumerate(vocabulary.to_pylist())}
                keys = np.array([[2 * number[w] + 2 for w in words[r]] + [0] * (LONGEST - len(words[r])) for r in rows], np.int64)
                out[rows] = bounds.value.first(lang) + np.searchsorted(bounds.value.packed(lang, vocabulary), pack(*keys.T), side="right")
            yield pa.RecordBatch.from_arrays([pa.array(out), *batch.columns], names=["range", *batch.schema.names])

    return parts.mapInArrow(run, schema)


def compose(parts: DataFrame, automata: DataFrame) -> DataFrame:
    """parts (range, lang, part, longer) with f, the count that the automaton of their range gives them."""

    def solve(key: tuple[pa.Scalar, ...], left: pa.Table, right: pa.Table) -> pa.Table:
        if not left.num_rows or not right.num_rows:
            return left.select(["lang", "part", "longer"]).append_column("f", pa.array([0] * left.num_rows, pa.int64()))
        made = CountAutomaton.load(right.column("blob")[0].as_py())
        words = pc.split_pattern(left.column("part").combine_chunks().cast(pa.string()), " ")
        sizes = pc.list_value_length(words).to_numpy()
        flat = positions(made.words, words.flatten().cast(pa.binary()))
        starts = np.cumsum(sizes) - sizes
        columns = [np.where(sizes > d, flat[np.minimum(starts + d, len(flat) - 1)], -1) for d in range(LONGEST)]
        # a word that is not there must not count as the end of the n-gram
        lost = np.zeros(len(sizes), bool)
        for d in range(LONGEST):
            lost |= (sizes > d) & (columns[d] < 0)
        f = np.where(lost, 0, made.lookup(columns))
        return left.select(["lang", "part", "longer"]).append_column("f", pa.array(f, pa.int64()))

    return (
        parts.groupBy("range", "lang").cogroup(automata.groupBy("range", "lang"))
        .applyInArrow(solve, "lang string, part string, longer long, f long")
    )


def mine_phrases(docs: DataFrame, lang: str = "lang", text_col: str = "text", min_count: int = 10, top: int = 2000,
                 dominated: int = 50, range_grams: int = RANGE_GRAMS) -> DataFrame:
    """(lang, rank, phrase, a, l, r, n, score): each language's first ``top`` phrases of two and three words.

    Texts are cut into pieces at ``.,;:!?`` and line ends, pieces into words at spaces and tabs, A-Z in lower case; all
    other characters belong to words. a is the number of occurrences of the phrase inside pieces, overlaps included;
    phrases of at least ``min_count`` are candidates. A cut behind the first words gives the parts' counts l and r and
    the score floor(1000000 a a / (l r)); the lowest scoring cut counts, the first of equals. Candidates inside a longer
    one that has at least ``dominated`` percent of their occurrences go. n is the number of words of the language. Order:
    score, then a, both descending, then the phrase by its UTF-8 bytes.

    A null language is ``und``. Null and empty texts have no words. Texts are taken whole at any length. Repeated rows
    count each. Further columns are not used, whatever their names. An empty table gives no rows.
    """
    spark: SparkSession = docs.sparkSession
    source = docs.select(F.coalesce(F.col(lang).cast("string"), F.lit("und")).alias("lang"), F.col(text_col).alias("text"))
    bounds = spark.sparkContext.broadcast(find_bounds(source, range_grams))
    automata = united(shard_automata(source, bounds), min_count)
    candidates = materialize(candidates_of(automata), "phrases")
    cuts = cut_phrases(candidates)
    longer = F.when((F.col("k") > 2) & (F.size(F.split("part", " ")) > 1), F.col("a")).otherwise(0)
    parts = (
        cuts.select("lang", "k", "a", F.explode(F.array("left", "right")).alias("part"))
        .groupBy("lang", "part").agg(F.max(longer).alias("longer"))
    )
    counted = materialize(compose(routed(parts, bounds), automata), "phrase-parts")
    return rank_phrases(candidates, cuts, counted, automata, top, dominated)


def cut_phrases(candidates: DataFrame) -> DataFrame:
    """(lang, phrase, k, a, cut, left, right): every candidate at every cut."""
    words = F.split("phrase", " ")
    return candidates.withColumn("cut", F.explode(F.sequence(F.lit(1), F.col("k") - 1))).select(
        "lang", "phrase", "k", "a", "cut", F.array_join(F.slice(words, F.lit(1), F.col("cut")), " ").alias("left"),
        F.array_join(F.slice(words, F.col("cut") + 1, F.col("k") - F.col("cut")), " ").alias("right"))


def whole(value: Column) -> Column:
    return value.cast("decimal(14,0)")


def rank_phrases(candidates: DataFrame, cuts: DataFrame, counted: DataFrame, automata: DataFrame, top: int,
                 dominated: int) -> DataFrame:
    """Score, drop and rank. Counts are decimals of 14 digits, so a product with 1000000 has at most 36 and is exact."""
    left = counted.select("lang", F.col("part").alias("left"), F.col("f").alias("l"))
    right = counted.select("lang", F.col("part").alias("right"), F.col("f").alias("r"))
    scored = cuts.join(left, ["lang", "left"]).join(right, ["lang", "right"]).select(
        "lang", "phrase", "k", "a", "cut", "l", "r",
        F.expr("(cast(a as decimal(14,0)) * cast(a as decimal(14,0)) * cast(1000000 as decimal(7,0))) div "
               "(cast(l as decimal(14,0)) * cast(r as decimal(14,0)))").cast("long").alias("score"))
    lowest = scored.groupBy("lang", "phrase", "k", "a").agg(F.min(F.struct("score", "cut", "l", "r")).alias("low"))
    inside = counted.where("longer > 0").select("lang", F.col("part").alias("phrase"), "longer")
    kept = (
        lowest.join(inside, ["lang", "phrase"], "left")
        .where(whole(F.coalesce("longer", F.lit(0))) * 100 < whole(F.col("a")) * dominated)
        .select("lang", "phrase", "a", "low.l", "low.r", "low.score")
    )
    ranked = top_k(kept, ["lang"], [F.desc("score"), F.desc("a"), F.asc("phrase")], top, ["phrase"])
    totals = automata.groupBy("lang").agg(F.sum("words").alias("n"))
    return ranked.join(totals, "lang").select("lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", "l", "r", "n", "score")
