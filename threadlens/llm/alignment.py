"""Two tokenizers side by side: which tokens of one overlap which of the other, and in how many documents.

The first pass aligns every document and adds up, per task, in how many of its documents an id pair is linked. The
distinct pairs, cut into shards, get minimal perfect hashes; the tasks' counts become dense vectors indexed by the hash
and are summed as a tree. The second pass aligns the documents again and looks the counts up; the keys behind the hash
are compared.
"""

from __future__ import annotations

import dataclasses
import functools
import itertools
import json
import pickle
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from threadlens.llm.common import append_columns, fresh, materialize, parts_of
from threadlens.llm.line_dedup import PerfectHash
from threadlens.llm.tokens import _BLANK, byte_of_char, fast_encoder

#: Shards of the pairs, by the first id; the pairs are bounded by the two vocabularies.
SHARDS = 32
#: Vectors that one task of the tree sums.
FAN_IN = 64
#: Distinct pairs that a task of the first pass holds before it writes their counts.
HELD_PAIRS = 1 << 21
#: Bytes of texts that are aligned at once, about.
PART_BYTES = 6 << 20
#: Bytes of shards that one pass of the look-up holds in memory, at most, beyond a single shard.
WAVE_BYTES = 128 << 20
MARK = "▁"
#: A space between two characters that are no blanks: no token of either tokenizer reaches over it.
_INK = "(" + _BLANK.replace("[", "[^", 1) + ")"
CUT = f"{_INK} {_INK}"
#: A segment without a character, or with a blank at an end.
ODD_END = f"^$|^{_BLANK}|{_BLANK}$"


@dataclasses.dataclass
class Aligned:
    """The distinct segments of a batch (stretches that both tokenizers cut off), and where the texts have them."""

    sound: np.ndarray  # both tokenizers keep the bytes
    sums: dict[str, np.ndarray]  # n_a, n_b, n_groups, n_links of each segment
    groups: list[str]
    pairs: np.ndarray  # linked pairs of all segments in order, A id * base + B id
    owner: np.ndarray  # their segments
    places: np.ndarray  # segment at each place of the texts
    offsets: np.ndarray  # where each text starts among the places
    good: np.ndarray  # texts that are not empty and have only sound segments

    def by_text(self, values: np.ndarray) -> np.ndarray:
        """Sum over each good text of a number per segment, 0 for the others."""
        upto = np.concatenate([[0], np.cumsum(values[self.places])])
        return (upto[self.offsets[1:]] - upto[self.offsets[:-1]]) * self.good


def ranges(starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """starts[0], starts[0] + 1, ... for sizes[0] numbers, then the same for the next."""
    return np.arange(int(sizes.sum())) - np.repeat(np.cumsum(sizes) - sizes, sizes) + np.repeat(starts, sizes)


def distinct(values: np.ndarray) -> np.ndarray:
    """The distinct values, ascending, by sorting."""
    ordered = np.sort(values)
    return ordered[np.concatenate([[True], ordered[1:] != ordered[:-1]])] if len(ordered) else ordered


def listed(values: np.ndarray, sizes: np.ndarray) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(sizes)]), pa.int32()), pa.array(values).cast(pa.string()))


class TokenBytes:
    """The bytes of each id."""

    def __init__(self, tokens: list[bytes]):
        self.width = np.array([len(x) for x in tokens], np.int64)
        self.starts = np.cumsum(self.width) - self.width
        self.data = np.frombuffer(b"".join(tokens), np.uint8)

    def __getitem__(self, i: int) -> bytes:
        return self.data[self.starts[i]:self.starts[i] + self.width[i]].tobytes()

    def joined(self, ids: np.ndarray) -> np.ndarray:
        return self.data[ranges(self.starts[ids], self.width[ids])]


class Aligner:
    """Segments of texts by a byte-level BPE file and a sentencepiece model that puts a space before a text."""

    def __init__(self, a_path: str, b_path: str):
        import sentencepiece
        from tokenizers import Tokenizer

        with open(a_path, encoding="utf-8") as f:
            file = json.load(f)
        self.fast = fast_encoder(file)
        if self.fast is None:
            self.library = Tokenizer.from_file(a_path)
            self.library.encode_special_tokens = True
        of = byte_of_char()
        vocab = file["model"]["vocab"]
        a_bytes = [b""] * (max(vocab.values()) + 1)
        for token, i in vocab.items():
            a_bytes[i] = bytes(of[c] for c in token if c in of)
        self.b = sentencepiece.SentencePieceProcessor(model_file=b_path)
        self.base = self.b.get_piece_size()
        pieces = [self.b.id_to_piece(i) for i in range(self.base)]
        b_bytes = [bytes([int(p[3:5], 16)]) if self.b.is_byte(i) else p.replace(MARK, " ").encode("utf-8")
                   for i, p in enumerate(pieces)]
        self.a_table, self.b_table = TokenBytes(a_bytes), TokenBytes(b_bytes)
        #: whether texts may be cut at single spaces: no piece has a space behind another character
        self.cuts = self.fast is not None and not any(MARK in p.lstrip(MARK) for p in pieces)

    def first_ids(self, segments: pa.Array, width: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(ids of A of all segments, each behind a space; numbers of ids)."""
        if self.fast is None:
            ids = [e.ids for e in self.library.encode_batch([" " + t for t in segments.to_pylist()], add_special_tokens=False)]
            return np.array(list(itertools.chain.from_iterable(ids)), np.int64), np.array([len(x) for x in ids], np.int64)
        # segments without a blank at an end are encoded as one text, which is cut at them
        odd = pc.match_substring_regex(segments, ODD_END).to_numpy(zero_copy_only=False)
        ids, sizes = np.zeros(0, np.int64), np.zeros(len(segments), np.int64)
        if not odd.all():
            joined = " ".join(segments.filter(pa.array(~odd)).to_pylist())
            ids = np.array(self.fast.encode_ordinary(" " + joined), np.int64)
            ends = np.searchsorted(np.cumsum(self.a_table.width[ids]), np.cumsum(width[~odd]), side="right")
            sizes[~odd] = np.diff(np.concatenate([[0], ends]))
        if not odd.any():
            return ids, sizes
        own = [self.fast.encode_ordinary(" " + t) for t in segments.filter(pa.array(odd)).to_pylist()]
        sizes[odd] = [len(x) for x in own]
        starts = np.zeros(len(segments), np.int64)
        starts[~odd] = np.cumsum(sizes[~odd]) - sizes[~odd]
        starts[odd] = len(ids) + np.cumsum(sizes[odd]) - sizes[odd]
        both = np.concatenate([ids, np.array(list(itertools.chain.from_iterable(own)), np.int64)])
        return both[ranges(starts, sizes)], sizes

    @staticmethod
    def _written(a: np.ndarray, at_a: np.ndarray, b: np.ndarray, at_b: np.ndarray, n_groups: np.ndarray) -> list[str]:
        """The groups of each segment as text, from where they end."""
        sides = [pc.binary_join(listed(ids, np.diff(np.concatenate([[0], at]))), ",") for ids, at in ((a, at_a), (b, at_b))]
        offsets = pa.array(np.concatenate([[0], np.cumsum(n_groups)]), pa.int32())
        return pc.binary_join(pa.ListArray.from_arrays(offsets, pc.binary_join_element_wise(*sides, "|")), ";").to_pylist()

    def cut(self, texts: pa.Array) -> pa.Array:
        """The segments of each text. A text that holds the mark put at the cuts is one segment."""
        texts = texts.fill_null("").cast(pa.large_string())
        kind = pa.large_list(pa.large_string())
        if not self.cuts:
            return pa.array([[t] for t in texts.to_pylist()], kind)
        own = pc.match_substring(texts, "\x00").to_numpy(zero_copy_only=False)
        marked = texts
        for _ in range(2):  # neighbours share a character, as in "a b c": the second time finds those between
            marked = pc.replace_substring_regex(marked, CUT, "\\1\x00\\2")
        parts = pc.split_pattern(marked, "\x00")
        if not own.any():
            return parts
        return pa.array([[t] if o else p for t, o, p in zip(texts.to_pylist(), own, parts.to_pylist(), strict=True)], kind)

    def batch(self, texts: pa.Array, written: bool = True) -> Aligned:
        """The alignment of a space and each text. A null text is empty. The groups are written as text if asked for."""
        parts = self.cut(texts)
        coded = parts.flatten().dictionary_encode()
        places, offsets = coded.indices.to_numpy().astype(np.int64), parts.offsets.to_numpy().astype(np.int64)
        segments = coded.dictionary
        del parts, coded
        n = len(segments)
        spaced = pc.binary_join_element_wise(pa.scalar("", pa.large_string()), segments, pa.scalar(" ", pa.large_string()))
        width = pc.binary_length(spaced).to_numpy().astype(np.int64)
        raw = np.frombuffer(spaced.buffers()[2] or b"", np.uint8)[:int(width.sum())]
        a, n_a = self.first_ids(segments, width)
        by_segment = self.b.encode(segments.to_pylist(), num_threads=1) if n else []
        n_b = np.array([len(x) for x in by_segment], np.int64)
        b = np.fromiter(itertools.chain.from_iterable(by_segment), np.int64, int(n_b.sum()))
        del by_segment
        a_of, b_of = np.repeat(np.arange(n), n_a), np.repeat(np.arange(n), n_b)
        sound = np.ones(n, bool)
        of_byte = np.repeat(np.arange(n), width)
        for ids, of, table in ((a, a_of, self.a_table), (b, b_of, self.b_table)):
            sound &= np.bincount(of, table.width[ids], n).astype(np.int64) == width
            here = sound[of_byte]
            sound[of_byte[here][table.joined(ids[sound[of]]) != raw[here]]] = False
        a, a_of, b, b_of = a[sound[a_of]], a_of[sound[a_of]], b[sound[b_of]], b_of[sound[b_of]]
        # the sound segments laid end to end: each of them ends in both tokenizers
        a_ends, b_ends = np.cumsum(self.a_table.width[a]), np.cumsum(self.b_table.width[b])
        both = np.intersect1d(a_ends, b_ends, assume_unique=True)
        at_a, at_b = np.searchsorted(a_ends, both) + 1, np.searchsorted(b_ends, both) + 1
        group_of = a_of[at_a - 1]
        n_groups = np.bincount(group_of, minlength=n)
        groups = self._written(a, at_a, b, at_b, n_groups) if written else []
        # token k of A overlaps the tokens of B from the first that ends behind its start to the one that reaches its end
        first = np.searchsorted(b_ends, a_ends - self.a_table.width[a], side="right")
        sizes = np.searchsorted(b_ends, a_ends) - first + 1
        owner = np.repeat(a_of, sizes)
        empty = pc.equal(texts.fill_null(""), "").to_numpy(zero_copy_only=False)
        made = Aligned(sound, {"n_a": n_a, "n_b": n_b, "n_groups": n_groups, "n_links": np.bincount(owner, minlength=n)},
                       groups, np.repeat(a, sizes) * self.base + b[ranges(first, sizes)], owner,
                       places, offsets, ~empty)
        made.good = (made.by_text(1 - sound.astype(np.int64)) == 0) & ~empty
        return made


@functools.lru_cache(maxsize=2)
def load(a_path: str, b_path: str) -> Aligner:
    """The aligner of two files, kept by a worker over its tasks."""
    return Aligner(a_path, b_path)


def document_pairs(aligner: Aligner, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(pair, number of the texts in which it is linked) of a batch, pairs ascending."""
    made = aligner.batch(texts, written=False)
    n, none = max(1, len(made.sound)), np.zeros(0, np.int64)
    values, at = np.unique(made.pairs, return_inverse=True)
    if not len(values):
        return none, none
    segment, pair = np.divmod(distinct(made.owner * len(values) + at), len(values))
    many = np.bincount(segment, minlength=n)
    starts = np.cumsum(many) - many
    row = np.repeat(np.arange(len(texts)), np.diff(made.offsets))
    keep = made.good[row]
    row, place = np.divmod(distinct(row[keep] * n + made.places[keep]), n)  # a segment counts once a text
    linked = distinct(np.repeat(row, many[place]) * len(values) + pair[ranges(starts[place], many[place])])
    counts = np.bincount(linked % len(values), minlength=len(values))
    return values[counts > 0], counts[counts > 0]


def shard_of(pairs: np.ndarray, base: int, shards: int) -> np.ndarray:
    """By the first id, so that a shard has all pairs of an id."""
    return (pairs // base) * 2654435761 % (1 << 32) % shards


SPARSE = "shard int, pairs array<long>, counts array<long>"


def sparse_counts(texts: DataFrame, a_path: str, b_path: str, shards: int) -> DataFrame:
    """(shard, pairs, counts) of each task: in how many of its documents a pair is linked."""

    def rows(held: dict) -> pa.RecordBatch:
        pairs, at = np.unique(np.concatenate([p for p, _ in held["parts"]]), return_inverse=True)
        counts = np.bincount(at, np.concatenate([c for _, c in held["parts"]]).astype(np.float64), len(pairs)).astype(np.int64)
        held["parts"], held["n"] = [(pairs, counts)], len(pairs)
        return pairs, counts

    def flush(held: dict, base: int) -> pa.RecordBatch:
        pairs, counts = rows(held)
        of = shard_of(pairs, base, shards)
        names = np.unique(of)
        kind = pa.list_(pa.int64())
        out = pa.RecordBatch.from_arrays(
            [pa.array(names, pa.int32()), pa.array([pairs[of == s] for s in names], kind),
             pa.array([counts[of == s] for s in names], kind)], names=["shard", "pairs", "counts"])
        held["parts"], held["n"] = [], 0
        return out

    def run(batches: Iterator[pa.RecordBatch]):
        aligner = load(a_path, b_path)
        held = {"parts": [], "n": 0}
        for batch in batches:
            for part in parts_of(batch, PART_BYTES):
                found = document_pairs(aligner, part.column(0))
                if len(found[0]):
                    held["parts"].append(found)
                    held["n"] += len(found[0])
                if held["n"] > HELD_PAIRS:
                    rows(held)
                    if held["n"] > HELD_PAIRS // 2:
                        yield flush(held, aligner.base)
        if held["n"]:
            yield flush(held, aligner.base)

    return texts.mapInArrow(run, SPARSE)


def build_index(texts: DataFrame, a_path: str, b_path: str, shards: int = SHARDS, fan_in: int = FAN_IN) -> DataFrame:
    """One written row (shard, size, blob) per shard: perfect hash, keys, document counts, and whether a pair's count is
    the highest of its first id."""
    base = _pieces(b_path)
    sparse = materialize(sparse_counts(texts, a_path, b_path, shards), "pair-counts")

    def hash_shard(key: tuple[pa.Scalar, ...], table: pa.Table) -> pa.Table:
        pairs = np.sort(table.column("pair").to_numpy())
        perfect = PerfectHash(pairs.view(np.uint64))
        keys = np.empty_like(pairs)
        keys[perfect(pairs.view(np.uint64))] = pairs
        blob = pickle.dumps((perfect, keys), protocol=5)
        return pa.table({"shard": [key[0].as_py()], "blob": [blob]}, schema=pa.schema([("shard", pa.int32()), ("blob", pa.binary())]))

    hashes = materialize(
        sparse.select("shard", F.explode("pairs").alias("pair")).distinct().groupBy("shard")
        .applyInArrow(hash_shard, "shard int, blob binary"), "pair-hashes")

    # level 1 of the tree: at most about fan_in sparse counts of a shard become one dense vector
    vectors = sparse.groupBy("shard").count().agg(F.max("count")).first()[0] or 1
    groups = -(-vectors // fan_in)
    salted = sparse.withColumn("part", F.pmod(F.xxhash64("pairs", "counts"), F.lit(groups)).cast("int"))
    opened = hashes.withColumn("part", F.explode(F.sequence(F.lit(0), F.lit(groups - 1))))

    def dense(key: tuple[pa.Scalar, ...], left: pa.Table, right: pa.Table) -> pa.Table:
        if not left.num_rows:
            return pa.table({"shard": [], "part": [], "counts": []}, schema=VECTOR)
        perfect, keys = pickle.loads(right.column("blob")[0].as_py())
        total = np.zeros(len(keys), np.int64)
        for pairs, counts in zip(left.column("pairs"), left.column("counts"), strict=True):
            total[perfect(pairs.values.to_numpy().view(np.uint64))] += counts.values.to_numpy()
        return pa.table({"shard": [key[0].as_py()], "part": [key[1].as_py()], "counts": [total]}, schema=VECTOR)

    def add(key: tuple[pa.Scalar, ...], table: pa.Table) -> pa.Table:
        total = functools.reduce(np.add, (v.values.to_numpy() for v in table.column("counts")))
        return pa.table({"shard": [key[0].as_py()], "part": [key[1].as_py()], "counts": [total]}, schema=VECTOR)

    text = "shard int, part int, counts array<long>"
    summed = salted.groupBy("shard", "part").cogroup(opened.groupBy("shard", "part")).applyInArrow(dense, text)
    while groups > 1:
        groups = -(-groups // fan_in)
        summed = (summed.withColumn("part", F.pmod("part", F.lit(groups))).groupBy("shard", "part").applyInArrow(add, text))

    def finish(key: tuple[pa.Scalar, ...], left: pa.Table, right: pa.Table) -> pa.Table:
        perfect, keys = pickle.loads(left.column("blob")[0].as_py())
        counts = right.column("counts")[0].values.to_numpy()
        order = np.argsort(keys // base, kind="stable")
        ids = (keys // base)[order]
        heads = np.flatnonzero(np.concatenate([[True], ids[1:] != ids[:-1]]))
        best = np.empty(len(keys), bool)
        best[order] = counts[order] == np.repeat(np.maximum.reduceat(counts[order], heads), np.diff([*heads, len(ids)]))
        blob = pickle.dumps((perfect, keys, counts, best), protocol=5)
        return pa.table({"shard": [key[0].as_py()], "size": [len(blob)], "blob": [blob]},
                        schema=pa.schema([("shard", pa.int32()), ("size", pa.int64()), ("blob", pa.binary())]))

    return materialize(hashes.groupBy("shard").cogroup(summed.groupBy("shard"))
                       .applyInArrow(finish, "shard int, size long, blob binary"), "pair-index")


VECTOR = pa.schema([("shard", pa.int32()), ("part", pa.int32()), ("counts", pa.list_(pa.int64()))])


def _pieces(path: str) -> int:
    import sentencepiece

    return sentencepiece.SentencePieceProcessor(model_file=path).get_piece_size()


FIELDS = ["n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum"]


def align_tokenizers(docs: DataFrame, a_path: str, b_path: str, text_col: str = "text", shards: int = SHARDS,
                     fan_in: int = FAN_IN, wave_bytes: int = WAVE_BYTES) -> DataFrame:
    """All columns of docs, then n_a, n_b (tokens), n_groups, n_links, n_best, count_sum (long) and token_groups.

    A is a byte-level BPE file applied to a space and the text, B a sentencepiece model that puts the space there
    itself; strings of special tokens are ordinary text. Places where tokens of both end cut the tokens into groups,
    written ``a1,a2|b1;a3|b2``. A link is a pair of token occurrences whose bytes overlap, the count of an id pair the
    number of documents in which it is linked; n_best counts links whose count is the highest of their A id, ties
    included, and count_sum adds up the counts of all links.

    Null and empty texts, and texts of which a tokenizer does not keep the bytes (a text that holds U+2581), have
    zeros, the groups "" and count in no pair. Texts of any length are taken whole. Every row is a document, repeated
    rows, shared and null ids included. An empty table gives an empty result. Names that docs has already get a leading
    underscore.

    Shards of the index are looked up in waves of at most ``wave_bytes`` (or one shard); their results are sums, so a
    further wave adds to the written numbers of the ones before.
    """
    spark = docs.sparkSession
    index = build_index(docs.select(F.col(text_col).alias("text")), a_path, b_path, shards, fan_in)
    waves: list[list[int]] = [[]]
    held = 0
    for shard, size in sorted(map(tuple, index.select("shard", "size").collect())):
        if waves[-1] and held + size > wave_bytes:
            waves.append([])
            held = 0
        waves[-1].append(shard)
        held += size
    names = [fresh(docs, n) for n in FIELDS]
    groups = fresh(docs, "token_groups")
    current = docs
    for wave, members in enumerate(waves):
        blobs = index.where(F.col("shard").isin(members)).select("shard", "blob").collect() if members else []
        shared = spark.sparkContext.broadcast({r.shard: bytes(r.blob) for r in blobs})
        look = _lookup(shared, a_path, b_path, shards)
        if wave == 0:
            def first(texts: pa.Array, f=look) -> list[pa.Array]:
                made = load(a_path, b_path).batch(texts)
                sums = [pa.array(made.by_text(made.sums[n]), pa.int64()) for n in FIELDS[:4]]
                parts = [made.places[x:y].tolist() if ok else () for x, y, ok in
                         zip(made.offsets[:-1], made.offsets[1:], made.good, strict=True)]
                written = [";".join(map(made.groups.__getitem__, p)) for p in parts]
                return [*sums, *f(made), pa.array(written, pa.string())]

            kinds = [*[(n, T.LongType()) for n in names], (groups, T.StringType())]
            current = append_columns(current, [text_col], kinds, first, PART_BYTES)
        else:
            def more(texts: pa.Array, best: pa.Array, total: pa.Array, f=look) -> list[pa.Array]:
                added = f(load(a_path, b_path).batch(texts, written=False))
                return [pc.add(best, added[0]), pc.add(total, added[1])]

            order = current.columns
            current = (
                append_columns(current, [text_col, *names[4:]], [("_best_now", T.LongType()), ("_sum_now", T.LongType())], more, PART_BYTES)
                .drop(*names[4:]).withColumnsRenamed({"_best_now": names[4], "_sum_now": names[5]}).select(*order))
        if wave < len(waves) - 1:
            current = materialize(current, "pair-sums")
            shared.destroy()
    return current


def _lookup(shared, a_path: str, b_path: str, shards: int):
    """A function of aligned segments to (n_best, count_sum) of each text, over the shards at hand."""
    opened: dict[int, tuple] = {}

    def look(made: Aligned) -> list[pa.Array]:
        counts, best = np.zeros(len(made.pairs), np.int64), np.zeros(len(made.pairs), np.int64)
        of = shard_of(made.pairs, load(a_path, b_path).base, shards)
        for shard in np.unique(of).tolist():
            if shard not in shared.value:
                continue
            if shard not in opened:
                opened[shard] = pickle.loads(shared.value[shard])
            perfect, keys, numbers, tops = opened[shard]
            here = np.flatnonzero(of == shard)
            at = perfect(made.pairs[here].view(np.uint64))
            known = at >= 0
            known[known] = keys[at[known]] == made.pairs[here][known]
            counts[here[known]] = numbers[at[known]]
            best[here[known]] = tops[at[known]]
        # sums in whole numbers: segments stand in the order of their pairs
        ends = np.cumsum(np.bincount(made.owner, minlength=len(made.sound)))
        out = []
        for value in (best, counts):
            upto = np.concatenate([[0], np.cumsum(value)])
            out.append(pa.array(made.by_text(np.diff(upto[np.concatenate([[0], ends])])), pa.int64()))
        return out

    return look
