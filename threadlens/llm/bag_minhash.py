"""Near-dedup of documents by weighted Jaccard similarity of word shingles (BagMinHash).

A document is the multiset of its five-word shingles. Every shingle with weight w carries a Poisson process of marked
points over the weights (0, w]; two documents see the same points where their weights overlap, so the earliest points
of two documents agree with exactly the probability of their weighted Jaccard similarity. Weights are discretised to
whole numbers and arranged as a hierarchy of octaves (0, 1], (1, 2], (2, 4], ...: whole octaves are taken as they are,
the last one is thinned by the level of each point. Only points below a bound that fills all places of a signature are
drawn.

Bands of the signature give buckets. Buckets are never expanded into all pairs: all members are verified against one
head; what stays apart in a bucket after that is verified pair by pair.
"""

from __future__ import annotations

from fractions import Fraction

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from threadlens.llm.common import components, grouped, map_rows, materialize
from threadlens.llm.quality import mix, slices, words_of

SHINGLE = 5
BANDS, ROWS = 32, 6
PLACES = BANDS * ROWS
SIMILARITY = "0.8"
#: Rounds in which members outside the largest class of a bucket meet so many of that class, before the last step.
ROUNDS, HEADS = 1, 3
#: Documents of a block.
BLOCK = 512
#: Points drawn at once.
DRAW = 1 << 19
_A, _B = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xD6E8FEB86659FD93)


def shingles(texts: pa.Array, size: int = SHINGLE) -> tuple[np.ndarray, np.ndarray]:
    """(offsets, hash of every shingle) of texts in lower case, cut at blanks. A text with fewer words than a shingle
    has one, of all its words; a text without words has none."""
    offsets, at, words = words_of(pc.utf8_lower(texts))
    word = np.fromiter((xxhash.xxh3_64_intdigest(w.encode("utf-8", "surrogatepass")) for w in words), np.uint64, len(words))
    word = word[at] if len(at) else np.zeros(0, np.uint64)
    n = np.diff(offsets)
    out = np.maximum(n - size + 1, np.minimum(n, 1))
    ends = np.concatenate([[0], np.cumsum(out)])
    start = np.repeat(offsets[:-1] - ends[:-1], out) + np.arange(ends[-1])
    value = np.zeros(len(start), np.uint64)
    limit = np.repeat(offsets[1:], out)
    for k in range(size):
        place = start + k
        inside = place < limit
        own = np.where(inside, word[np.minimum(place, max(0, len(word) - 1))] if len(word) else value, np.uint64(0))
        value = mix(value * _A + own + np.uint64(k + 1) * inside)
    return ends, value


def bags(texts: pa.Array) -> list[tuple[np.ndarray, np.ndarray]]:
    """(distinct shingle hashes in order, weights) of every text."""
    out = []
    for part in slices(texts):
        ends, value = shingles(part)
        out.extend(np.unique(value[a:b], return_counts=True) for a, b in zip(ends[:-1], ends[1:], strict=True))
    return out


def processes(hashes: np.ndarray, weights: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(element, key, rate, levels taken) of the octaves of every weight. An octave has as many levels as its rate."""
    last = np.ceil(np.log2(weights)).astype(np.int64)
    last += (np.int64(1) << last) < weights
    element = np.repeat(np.arange(len(weights)), last + 1)
    octave = np.arange(len(element)) - np.repeat(np.cumsum(last + 1) - (last + 1), last + 1)
    rate = np.where(octave == 0, 1, np.int64(1) << np.maximum(octave - 1, 0))
    taken = np.where(octave == last[element], weights[element] - np.where(octave == 0, 0, rate), rate)
    return element, mix(hashes[element] * _A + (octave.astype(np.uint64) + np.uint64(1)) * _B), rate, taken


def signatures(items: list[tuple[np.ndarray, np.ndarray]], places: int = PLACES) -> np.ndarray:
    """One row of ``places`` numbers per multiset; of an empty one, zeros."""
    out = np.zeros((len(items), places), np.uint64)
    weight = np.array([w.sum() for _, w in items], np.int64)
    order = [i for i in np.argsort(weight, kind="stable") if weight[i]]
    start = 0
    while start < len(order):
        # documents of similar weight are drawn together
        lightest, stop, size = weight[order[start]], start, 0
        bound = places * (np.log(places) + 3) / lightest
        points = int(bound * 1.3) + 2
        while stop < len(order) and (stop == start or (size + len(items[order[stop]][0]) * points <= DRAW
                                                       and weight[order[stop]] <= 2 * lightest)):
            size += len(items[order[stop]][0]) * points
            stop += 1
        group = order[start:stop]
        out[group] = _draw([items[i] for i in group], weight[group], places)
        start = stop
    return out


def _draw(items: list[tuple[np.ndarray, np.ndarray]], weight: np.ndarray, places: int) -> np.ndarray:
    size = np.array([len(h) for h, _ in items])
    element, key, rate, taken = processes(np.concatenate([h for h, _ in items]), np.concatenate([w for _, w in items]))
    doc = np.repeat(np.arange(len(items)), size)[element]
    first = np.full((len(items), places), np.inf)
    found = np.zeros((len(items), places), np.uint64)
    bound = places * (np.log(places) + 3) / weight
    at, number = np.zeros(len(key)), np.zeros(len(key), np.uint64)
    open_ = np.arange(len(key))
    while True:
        while len(open_):
            # as many points as most processes need below the bound
            count = int(max(1, min(DRAW // len(open_), np.ceil(1.2 * np.mean((bound[doc[open_]] - at[open_]) * rate[open_])) + 1)))
            index = number[open_][:, None] + np.arange(1, count + 1, dtype=np.uint64)[None, :]
            token = mix(key[open_][:, None] + index * _A)
            token ^= token >> np.uint64(32)
            gap = -np.log(((token >> np.uint64(11)).astype(np.float64) + 0.5) * 2.0 ** -53) / rate[open_][:, None]
            x = at[open_][:, None] + np.cumsum(gap, axis=1)
            extra = mix(token + _B)
            place = (extra % np.uint64(places)).astype(np.int64)
            level = (extra >> np.uint64(16)) % rate[open_][:, None].astype(np.uint64)
            good = (level < taken[open_][:, None].astype(np.uint64)) & (x <= bound[doc[open_]][:, None])
            cell = (doc[open_][:, None] * places + place)[good]
            value, name = x[good], token[good]
            order = np.lexsort((value, cell))
            cell, value, name = cell[order], value[order], name[order]
            lead = np.concatenate([[True], cell[1:] != cell[:-1]]) if len(cell) else np.zeros(0, bool)
            cell, value, name = cell[lead], value[lead], name[lead]
            better = value < first.ravel()[cell]
            first.ravel()[cell[better]] = value[better]
            found.ravel()[cell[better]] = name[better]
            at[open_], number[open_] = x[:, -1], number[open_] + np.uint64(count)
            open_ = open_[x[:, -1] <= bound[doc[open_]]]
        missing = np.isinf(first).any(1)
        if not missing.any():
            return found
        # rarely, a place is still empty below the bound: draw these documents again up to twice the bound
        bound = np.where(missing, 2 * bound, bound)
        open_ = np.flatnonzero(missing[doc])
        at[open_], number[open_] = 0, 0


def band_keys(signature: np.ndarray, bands: int = BANDS) -> np.ndarray:
    """One number per band of every signature."""
    rows = signature.reshape(len(signature), bands, -1)
    key = np.broadcast_to(np.arange(1, bands + 1, dtype=np.uint64) * _B, rows.shape[:2]).copy()
    for k in range(rows.shape[2]):
        key = mix(key * _A + rows[:, :, k])
    return key


def overlap(a: tuple[np.ndarray, np.ndarray], b: tuple[np.ndarray, np.ndarray]) -> tuple[int, int]:
    """(sum of the smaller weights, sum of the larger weights)."""
    place = np.searchsorted(b[0], a[0])
    place[place == len(b[0])] = 0
    same = b[0][place] == a[0] if len(b[0]) else np.zeros(len(a[0]), bool)
    shared = int(np.minimum(a[1][same], b[1][place[same]]).sum())
    return shared, int(a[1].sum() + b[1].sum()) - shared


def profile(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(doc, first, second, bands): digest of the shingle multiset and band keys, both null for a text without words."""

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        items = bags(batch.column(1).fill_null(""))
        keys = band_keys(signatures(items)).view(np.int64)
        digests = [xxhash.xxh3_128_digest(h.tobytes() + w.astype("<i8").tobytes()) for h, w in items]
        pair = np.frombuffer(b"".join(digests), "<i8").reshape(-1, 2)
        none = np.array([not len(h) for h, _ in items])
        offsets = pa.array(np.arange(len(items) + 1, dtype=np.int32) * BANDS)
        lists = pa.ListArray.from_arrays(offsets, pa.array(keys.ravel()))
        return pa.RecordBatch.from_arrays(
            [batch.column(0), pa.array(pair[:, 0].copy(), mask=none), pa.array(pair[:, 1].copy(), mask=none),
             pc.if_else(pa.array(none), pa.nulls(len(items), lists.type), lists)],
            names=["doc", "first", "second", "bands"])

    source = docs.select(F.col(id_col).cast("long").alias("doc"), F.col(text_col).alias("text")).where("doc is not null")
    return map_rows(source, run, "doc long, first long, second long, bands array<long>")


def verified(pairs: DataFrame, texts: DataFrame, similarity: str) -> DataFrame:
    """The pairs (a, b) whose multisets overlap enough. texts: (doc, text), one row per doc."""
    least = Fraction(similarity)

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        left, right = batch.column(0).to_pylist(), batch.column(1).to_pylist()
        # pairs come sorted by their head, so a head's text is cut once per run of pairs
        heads = np.concatenate([[True], np.array(left[1:]) != np.array(left[:-1])]) if left else np.zeros(0, bool)
        own = bags(batch.column(2).filter(pa.array(heads)))
        at, other = np.cumsum(heads) - 1, bags(batch.column(3))
        good = []
        for i in range(len(left)):
            smaller, larger = overlap(own[at[i]], other[i])
            good.append(smaller * least.denominator >= larger * least.numerator)
        keep = pa.array(good, pa.bool_())
        return pa.RecordBatch.from_arrays([pa.array(left, pa.int64()).filter(keep), pa.array(right, pa.int64()).filter(keep)],
                                          names=["a", "b"])

    joined = (
        pairs.join(texts.select(F.col("doc").alias("b"), F.col("text").alias("text_b")), "b")
        .join(texts.select(F.col("doc").alias("a"), F.col("text").alias("text_a")), "a")
        .select("a", "b", "text_a", "text_b")
    )
    return map_rows(joined, run, "a long, b long")


def _mixed(shared: DataFrame, classes: DataFrame) -> DataFrame:
    """(band, doc, component, largest) of the buckets that hold several classes, with their largest class; written."""
    placed = shared.select("band", "doc").join(classes, "doc")
    sizes = placed.groupBy("band", "component").agg(F.count("*").alias("n"))
    mixed = sizes.groupBy("band").agg(
        F.count("*").alias("classes"), F.max_by("component", F.struct("n", "component")).alias("largest"))
    return materialize(placed.join(mixed.where("classes > 1").select("band", "largest"), "band"), "minhash-mixed")


def linked_in_blocks(within: DataFrame, texts: DataFrame, similarity: str, block: int = BLOCK) -> DataFrame:
    """Links (a, b) between documents of different classes of a bucket, at least one for each two classes that have any.

    within: (band, doc, component, largest). Members outside the largest class of a bucket are compared with all
    members; both sides are cut into blocks by hash, and a task compares two blocks and returns links, not pairs.
    """
    least = Fraction(similarity)

    def profiles(batch: pa.RecordBatch) -> pa.RecordBatch:
        items = bags(batch.column(1).fill_null(""))
        return pa.RecordBatch.from_arrays(
            [batch.column(0), pa.array([h.tobytes() for h, _ in items], pa.binary()),
             pa.array([w.astype(np.int64).tobytes() for _, w in items], pa.binary())], names=["doc", "hashes", "weights"])

    def compare(part: pa.Table, found: set[tuple[int, int]]) -> None:
        doc, component, outside = (part[c].to_numpy() for c in ("doc", "component", "outside"))
        hashes = [np.frombuffer(x, np.uint64) for x in part["hashes"].to_pylist()]
        weights = [np.frombuffer(x, np.int64) for x in part["weights"].to_pylist()]
        members = np.flatnonzero(~outside)
        if not len(members):
            return
        every = np.concatenate([hashes[i] for i in members])
        weight = np.concatenate([weights[i] for i in members])
        owner = np.repeat(np.arange(len(members)), [len(hashes[i]) for i in members])
        total = np.array([w.sum() for w in weights])
        for x in np.flatnonzero(outside):
            at = np.searchsorted(hashes[x], every)
            at[at == len(hashes[x])] = 0
            same = hashes[x][at] == every
            smaller = np.bincount(owner[same], np.minimum(weights[x][at[same]], weight[same]), len(members)).astype(np.int64)
            larger = total[members] + total[x] - smaller
            near = members[smaller * least.denominator >= larger * least.numerator]
            near = near[component[near] != component[x]]
            for y in near[np.unique(component[near], return_index=True)[1]]:
                found.add((min(int(doc[x]), int(doc[y])), max(int(doc[x]), int(doc[y]))))

    def solve(table: pa.Table) -> pa.RecordBatch:
        keys = np.stack([table[c].to_numpy() for c in ("band", "i", "j")])
        cuts = np.flatnonzero((keys[:, 1:] != keys[:, :-1]).any(0)) + 1
        found: set[tuple[int, int]] = set()
        for a, b in zip([0, *cuts.tolist()], [*cuts.tolist(), table.num_rows], strict=True):
            compare(table.slice(a, b - a).combine_chunks(), found)
        return pa.RecordBatch.from_arrays([pa.array([p[k] for p in found], pa.int64()) for k in (0, 1)], names=["a", "b"])

    bag = materialize(map_rows(texts.join(within.select("doc").distinct(), "doc", "left_semi").select("doc", "text"), profiles,
                               "doc long, hashes binary, weights binary"), "minhash-bags")
    counts = within.groupBy("band").agg(
        F.ceil(F.count("*") / block).cast("int").alias("rows"),
        F.ceil(F.count_if(F.col("component") != F.col("largest")) / block).cast("int").alias("columns"))
    sized = within.join(counts, "band")
    row, column = F.pmod(F.xxhash64("doc"), "rows").cast("int"), F.pmod(F.xxhash64("doc", F.lit(1)), "columns").cast("int")
    every = F.explode(F.sequence(F.lit(0), F.col("columns") - 1))
    members = sized.select("band", "doc", "component", F.lit(False).alias("outside"), row.alias("i"), every.alias("j"))
    outside = sized.where("component <> largest").select(
        "band", "doc", "component", F.lit(True).alias("outside"), F.explode(F.sequence(F.lit(0), F.col("rows") - 1)).alias("i"),
        column.alias("j"))
    cells = members.unionByName(outside).join(bag, "doc").withColumn("cell", F.xxhash64("band", "i", "j"))
    return cells.repartition("cell").sortWithinPartitions("cell", "band", "i", "j").mapInArrow(
        lambda batches: grouped(batches, "cell", solve, 1 << 12), "a long, b long").distinct()


def _merge(classes: DataFrame, links: DataFrame) -> DataFrame:
    """The classes (doc, component), joined where links (a, b) connect them; written."""
    of = classes.select(F.col("doc").alias("b"), F.col("component").alias("y"))
    edges = (
        links.join(classes.select(F.col("doc").alias("a"), F.col("component").alias("x")), "a").join(of, "b")
        .where("x <> y").select(F.col("x").alias("a"), F.col("y").alias("b"))
    )
    roots = components(edges, "minhash").select(F.col("id").alias("component"), F.col("component").alias("root"))
    return materialize(
        classes.join(roots, "component", "left").select("doc", F.coalesce("root", "component").alias("component")),
        "minhash-classes")


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                    similarity: str = SIMILARITY) -> DataFrame:
    """(doc, class_id) of every id that is not null: class_id is the smallest id reachable over links.

    Two documents are linked if the weighted Jaccard similarity of their multisets of five-word shingles (lower case,
    cut at blanks; shorter texts are one shingle) is at least ``similarity`` and a band of their signatures agrees: at
    0.8, all but one link in ten thousand. Null and empty texts, and texts of blanks, are linked with nothing. Rows that
    share an id count as one document: the smallest of their digests stands for it, and a link of any of their texts
    counts. An empty table gives an empty result.

    Documents with the same multiset become one first. In a bucket, every member is verified against the smallest one.
    Where a bucket then still holds several classes, the members outside its largest class are verified against a few
    members of that class, and what is left outside after that against all members of other classes, in blocks. So
    every pair of a bucket is verified or in one class already, no link of a bucket is lost, and a group of similar
    texts is not expanded into its pairs.
    """
    once = docs.select(F.col(id_col).alias("doc"), F.col(text_col).alias("text"))
    made = materialize(
        profile(once, "doc", "text").groupBy("doc").agg(F.min(F.struct("first", "second", "bands")).alias("p"))
        .select("doc", "p.*"), "minhash-profiles")
    known = made.where("first is not null")
    owners = known.groupBy("first", "second").agg(F.min("doc").alias("owner"))
    members = materialize(known.select("doc", "first", "second").join(owners, ["first", "second"]).select("doc", "owner"),
                          "minhash-members")
    alone = known.join(owners.select("first", "second", F.col("owner").alias("doc")), ["first", "second", "doc"])
    bands = materialize(alone.select("doc", F.explode("bands").alias("band")), "minhash-bands")
    heads = bands.groupBy("band").agg(F.min("doc").alias("head"), F.count("*").alias("n")).where("n > 1")
    shared = materialize(bands.join(heads.select("band", "head"), "band"), "minhash-shared")
    texts = materialize(
        once.where("doc is not null").select(F.col("doc").cast("long").alias("doc"), "text")
        .join(shared.select("doc").distinct(), "doc", "left_semi"), "minhash-texts")
    pairs = materialize(
        shared.where("doc <> head").select(F.col("head").alias("a"), F.col("doc").alias("b")).distinct(), "minhash-pairs")
    classes = _merge(shared.select("doc").distinct().select("doc", F.col("doc").alias("component")),
                     verified(pairs, texts, similarity))
    for round_ in range(ROUNDS):
        within = _mixed(shared, classes)
        chosen = within.where("component = largest").groupBy("band").agg(
            *[F.min_by("doc", F.xxhash64("doc", F.lit(HEADS * round_ + k))).alias(f"h{k}") for k in range(HEADS)])
        others = within.where("component <> largest").join(chosen, "band").select(
            "doc", F.explode(F.array_distinct(F.array(*[f"h{k}" for k in range(HEADS)]))).alias("head"))
        more = materialize(
            others.select(F.least("doc", "head").alias("a"), F.greatest("doc", "head").alias("b")).distinct()
            .join(pairs, ["a", "b"], "left_anti"), "minhash-pairs")
        classes = _merge(classes, verified(more, texts, similarity))
    classes = _merge(classes, linked_in_blocks(_mixed(shared, classes), texts, similarity))
    final = classes.select(F.col("doc").alias("id"), "component")
    found = members.join(final.select(F.col("id").alias("owner"), "component"), "owner", "left").select(
        "doc", F.coalesce("component", "owner").alias("class_id"))
    lone = made.where("first is null").select("doc", F.col("doc").alias("class_id"))
    return found.unionByName(lone)
