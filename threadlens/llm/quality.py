"""Quality classifier: supervised subword embeddings.

Every word, every character n-gram of it and every pair of neighbouring words is hashed to a learned vector. A text is
the mean of its vectors; a softmax layer reads the classes from it. Both are trained by stochastic gradient descent in
numpy on a bounded sample. Since scores are linear in the mean, scoring keeps one number per bucket.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from threadlens.llm.common import append_columns, fresh, map_rows, materialize, two_level_sample

#: Buckets of the vectors, their width, and the lengths of the character n-grams.
BUCKETS, WIDTH = 1 << 17, 16
GRAMS = (3, 4)
#: The fit uses at most so many labelled texts of each class.
TEXTS_PER_CLASS = 1500
EPOCHS, RATE = 6, 0.5
SEED = 7
#: UTF-8 bytes of texts handled at once.
SLICE = 8 << 20
_A, _B = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xBF58476D1CE4E5B9)


def mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(31))) * _B
    return x ^ (x >> np.uint64(29))


def slices(texts: pa.Array, limit: int = SLICE):
    """Parts of a batch with at most ``limit`` bytes, or one text."""
    sizes = np.concatenate([[0], np.cumsum(pc.binary_length(texts).to_numpy().astype(np.int64))])
    start = 0
    while start < len(texts):
        stop = max(start + 1, int(np.searchsorted(sizes, sizes[start] + limit, side="right")) - 1)
        yield texts.slice(start, stop - start)
        start = stop


def words_of(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, list[str]]:
    """(first word of each text, number of every word, distinct words) of texts cut at blanks."""
    parts = pc.utf8_split_whitespace(texts)
    coded = parts.flatten().dictionary_encode()
    at, words = coded.indices.to_numpy().astype(np.int64), coded.dictionary.to_pylist()
    offsets = parts.offsets.to_numpy().astype(np.int64)
    if "" in words:  # blanks at the ends leave empty words
        kept = at != words.index("")
        offsets = np.concatenate([[0], np.cumsum(kept)])[offsets]
        at = at[kept]
    return offsets, at, words


def word_features(words: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(hash of each word, owner, bucket) for the words themselves and their character n-grams, ends marked."""
    points = np.frombuffer(("\0" + "\0".join(words) + "\0").encode("utf-32-le", "surrogatepass"), np.uint32)
    ends = points == 0
    number = np.cumsum(ends) - 1  # a mark counts to the word behind it
    plain = points.astype(np.uint64)
    # the hash of a word: a sum over its characters, each with its place
    marks = np.flatnonzero(ends)
    place = np.arange(len(points)) - marks[number]
    hashes = mix(np.add.reduceat(mix(plain * _A + (place.astype(np.uint64) + np.uint64(1)) * _B), marks[:-1]))
    owners, buckets = [np.arange(len(words))], [hashes % np.uint64(BUCKETS)]
    before = np.concatenate([[0], np.cumsum(ends)])
    for n in GRAMS:
        m = len(points) - n + 1
        if m <= 0:
            continue
        # no mark inside, and not only the end of one word and the start of the next
        inside = before[n - 1:n - 1 + m] - before[1:1 + m]
        start = np.flatnonzero(inside == 0)
        value = np.full(len(start), n, np.uint64)
        for k in range(n):
            value = mix(value * _A + plain[start + k])
        owners.append(number[start + 1])
        # a gram whose second character is a mark cannot be (n > 2), so the second character tells the word
        buckets.append(value % np.uint64(BUCKETS))
    return hashes, np.concatenate(owners), np.concatenate(buckets).astype(np.int64)


def pair_buckets(hashes: np.ndarray, at: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(place of the second word, bucket) of neighbouring words of one text. The hash of a pair is the exclusive or of
    its words, so pairs of equal words share a bucket: repetition is something to learn from."""
    first = np.zeros(len(at) + 1, bool)
    first[offsets[:-1][offsets[:-1] < len(at)]] = True
    second = np.flatnonzero(~first[:len(at)])
    pair = mix((hashes[at[second]] ^ hashes[at[second - 1]]) * _A + np.uint64(1))
    return second, (pair % np.uint64(BUCKETS)).astype(np.int64)


def sums_by_text(values: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    upto = np.concatenate([[0], np.cumsum(values, dtype=np.float64)])
    return upto[offsets[1:]] - upto[offsets[:-1]]


def bags(texts: pa.Array) -> list[tuple[np.ndarray, np.ndarray]]:
    """(distinct buckets, their counts) of every text, for training."""
    out = []
    for part in slices(texts):
        offsets, at, words = words_of(part)
        if not len(at):
            out.extend([(np.zeros(0, np.int64), np.zeros(0, np.int64))] * len(part))
            continue
        hashes, owner, bucket = word_features(words)
        order = np.argsort(owner, kind="stable")
        bucket, starts = bucket[order], np.searchsorted(owner[order], np.arange(len(words) + 1))
        second, pairs = pair_buckets(hashes, at, offsets)
        for a, b in zip(offsets[:-1], offsets[1:], strict=True):
            used, times = np.unique(at[a:b], return_counts=True)
            size = starts[used + 1] - starts[used]
            where = np.repeat(starts[used] - (np.cumsum(size) - size), size) + np.arange(size.sum())
            lo, hi = np.searchsorted(second, [a, b])
            ids = np.concatenate([bucket[where], pairs[lo:hi]])
            weight = np.concatenate([np.repeat(times, size), np.ones(hi - lo, np.int64)])
            distinct, back = np.unique(ids, return_inverse=True)
            out.append((distinct, np.bincount(back, weight, len(distinct)).astype(np.int64)))
    return out


def train(examples: list[tuple[np.ndarray, np.ndarray]], labels: np.ndarray, classes: int,
          epochs: int = EPOCHS, rate: float = RATE) -> tuple[np.ndarray, np.ndarray]:
    """(vectors, output layer) by stochastic gradient descent, one text a step, with a falling rate."""
    rng = np.random.default_rng(SEED)
    vectors = ((rng.random((BUCKETS, WIDTH)) - 0.5) / WIDTH).astype(np.float32)
    output = np.zeros((WIDTH, classes), np.float32)
    steps, done = epochs * len(examples), 0
    for _ in range(epochs):
        for i in rng.permutation(len(examples)):
            ids, counts = examples[i]
            now = rate * (1 - done / steps)
            done += 1
            if not len(ids):
                continue
            share = (counts / counts.sum()).astype(np.float32)
            hidden = share @ vectors[ids]
            logits = hidden @ output
            error = np.exp(logits - logits.max())
            error /= error.sum()
            error[labels[i]] -= 1
            back = output @ error
            output -= now * np.outer(hidden, error)
            # the step of a vector follows its share of the text, relative to an even share
            vectors[ids] -= now * np.outer(np.sqrt(share), back)
    return vectors, output


@dataclass
class QualityModel:
    """The logit of a text is the mean of its buckets' values, plus the log odds of the labels in all labelled rows."""

    values: np.ndarray
    prior: float

    def score(self, texts: pa.Array) -> np.ndarray:
        texts = texts.fill_null("")
        parts = [self._slice(p) for p in slices(texts)]
        logits = np.concatenate(parts) if parts else np.zeros(0)
        return 1 / (1 + np.exp(-np.clip(logits + self.prior, -500, 500)))

    def _slice(self, texts: pa.Array) -> np.ndarray:
        offsets, at, words = words_of(texts)
        if not len(at):
            return np.zeros(len(texts))
        hashes, owner, bucket = word_features(words)
        total = np.bincount(owner, self.values[bucket], len(words))
        number = np.bincount(owner, minlength=len(words))
        second, pairs = pair_buckets(hashes, at, offsets)
        value, size = total[at], number[at].astype(np.float64)
        value[second] += self.values[pairs]
        size[second] += 1
        return sums_by_text(value, offsets) / np.maximum(1, sums_by_text(size, offsets))


def fit_quality_model(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                      label_col: str = "quality", per_class: int = TEXTS_PER_CLASS) -> QualityModel | None:
    """Learns from labelled rows (label 0 or 1, id not null); None unless both labels occur.

    At most ``per_class`` ids of each label are used, chosen by a hash of the id. Training runs in one task on this
    bounded sample. If an id is repeated, its smallest text counts; if its labels differ, the larger label.
    """
    spark = docs.sparkSession
    known = (
        labels.select(F.col(id_col).alias("id"), F.col(label_col).alias("label"))
        .where("id is not null and label in (0, 1)").groupBy("id").agg(F.max("label").alias("label")))
    counts = {r.label: r["n"] for r in known.groupBy("label").agg(F.count("*").alias("n")).collect()}
    if len(counts) < 2:
        return None
    # per_class ids for each of two labels
    chosen = two_level_sample(known, "label", "id", per_class)
    sample = materialize(
        docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
        .join(F.broadcast(chosen), "id").groupBy("id").agg(F.max("label").alias("label"), F.min("text").alias("text"))
        .repartition(32, "id"), "quality-sample")

    def features(batch: pa.RecordBatch) -> pa.RecordBatch:
        made = bags(batch.column(2))
        return pa.RecordBatch.from_arrays(
            [batch.column(0), batch.column(1), pa.array([a.astype(np.int32).tobytes() for a, _ in made], pa.binary()),
             pa.array([b.astype(np.int32).tobytes() for _, b in made], pa.binary())],
            names=["id", "label", "ids", "counts"])

    kinds = dict(sample.dtypes)
    rows = materialize(map_rows(sample, features, f"id {kinds['id']}, label {kinds['label']}, ids binary, counts binary"),
                       "quality-bags")

    def fit(batches):
        table = pa.Table.from_batches(list(batches)).sort_by("id").to_pydict()
        examples = [(np.frombuffer(a, np.int32).astype(np.int64), np.frombuffer(b, np.int32))
                    for a, b in zip(table["ids"], table["counts"], strict=True)]
        vectors, output = train(examples, np.array(table["label"], np.int64), 2)
        yield pa.RecordBatch.from_arrays(
            [pa.array([(vectors @ (output[:, 1] - output[:, 0])).astype(np.float64).tobytes()], pa.binary())],
            names=["values"])

    fitted = rows.repartition(1).mapInArrow(fit, "values binary").collect()[0]
    # the sample is even, or as even as the labels allow; the prior moves it to the labels' odds
    used = {k: min(n, per_class) for k, n in counts.items()}
    prior = np.log(counts[1] / counts[0]) - np.log(used[1] / used[0])
    return QualityModel(np.frombuffer(bytes(fitted["values"]), np.float64), float(prior))


def classify(docs: DataFrame, model: QualityModel | None, text_col: str = "text", threshold: float = 0.3) -> DataFrame:
    """All columns of docs, then score (0 to 1) and predicted (1 if score >= threshold, else 0).

    Null and empty texts, and texts of blanks, get the score of the labels' odds alone; 0.5 if there is no model. Whole
    texts are scored. An empty table gives an empty result. Names that docs has already get a leading underscore.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(texts: pa.Array) -> list[pa.Array]:
        score = np.full(len(texts), 0.5) if shared.value is None else shared.value.score(texts)
        return [pa.array(score), pa.array((score >= threshold).astype(np.int32))]

    return append_columns(docs, [text_col], [(fresh(docs, "score"), T.DoubleType()),
                                             (fresh(docs, "predicted"), T.IntegerType())], run)
