"""Language identification with a string kernel.

The blended-spectrum presence kernel of two texts is the number of distinct character n-grams (n = 1, 2, 3) they share,
divided by the root of the product of their own numbers. Landmark texts span a Nyström feature space, in which one
ridge regression per language is fitted. Both are linear in the n-gram presences, so a batch of texts is scored by one
product of its presence matrix with a matrix (n-grams of the landmarks) x (languages).
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from threadlens.llm.common import append_columns, fresh, map_rows, materialize, two_level_sample

UNKNOWN = "und"
#: n-grams of code points are hashed to 2 ** BITS numbers, whatever their script.
BITS = 22
ORDERS = (1, 2, 3)
#: The fit uses at most this many labelled texts per language, and of those so many as landmarks.
TEXTS_PER_LANGUAGE, LANDMARKS_PER_LANGUAGE = 400, 32
RIDGE = 1e-3
#: Turns margins, which are near -1 and 1, into a distribution.
SHARPNESS = 4.0
#: Texts of one presence matrix.
BLOCK = 256
#: Tasks that sum up the kernel of the labelled sample; each sends a matrix of landmarks x landmarks.
FIT_TASKS = 8
_STEP, _MIX = np.uint32(0x9E3779B1), np.uint32(0x85EBCA77)
HAS_LETTER = r"\p{L}"


def letters_of(text: str) -> np.ndarray:
    """Lower-case code points; everything but letters is 32, without repeats of 32."""
    raw = np.frombuffer(text.lower().encode("utf-32-le", "surrogatepass"), np.uint32)
    points = np.where(_letter_table()[raw], raw, np.uint32(32))
    blank = points == 32
    return points[~(blank & np.concatenate([[False], blank[:-1]]))]


_LETTERS: list[np.ndarray] = []


def _letter_table() -> np.ndarray:
    if not _LETTERS:
        _LETTERS.append(np.fromiter((chr(c).isalpha() for c in range(0x110000)), bool, 0x110000))
    return _LETTERS[0]


class Presence:
    """Distinct n-grams of a text as numbers below SIZE: hashes of their code points, with the order as seed."""

    SIZE = 1 << BITS

    def __init__(self):
        self.seen = np.zeros(self.SIZE, np.int32)

    def __call__(self, text: str | None) -> np.ndarray:
        if not text:
            return np.zeros(0, np.int64)
        points = letters_of(text)
        if not (points != 32).any():
            return np.zeros(0, np.int64)
        grams, parts = points * _STEP, []
        for n in ORDERS:
            mixed = (grams ^ (grams >> np.uint32(15))) * _MIX + np.uint32(n)
            parts.append(((mixed ^ (mixed >> np.uint32(13))) * _STEP) >> np.uint32(32 - BITS))
            if n < max(ORDERS):
                grams = (grams[:-1] ^ (grams[:-1] >> np.uint32(16))) * _MIX + points[n:] * _STEP
        grams = np.concatenate(parts)
        # of equal numbers, the one written last is the one read back
        place = np.arange(len(grams), dtype=np.int32)
        self.seen[grams] = place
        return grams[self.seen[grams] == place].astype(np.int64)


@dataclass
class LanguageModel:
    languages: list[str]
    #: number of each n-gram in the rows of ``weights``; n-grams that no landmark has go to the last row, which is zero
    rows: np.ndarray
    weights: np.ndarray
    bias: np.ndarray

    def scorer(self):
        presence = Presence()

        def score(texts: pa.Array) -> tuple[list[str], list[float]]:
            names, scores = [], []
            values = texts.to_pylist()
            for start in range(0, len(values), BLOCK):
                block = values[start:start + BLOCK]
                matrix = np.zeros((len(block), len(self.weights)), np.float32)
                norms = np.ones(len(block))
                empty = np.zeros(len(block), bool)
                for i, text in enumerate(block):
                    grams = presence(text)
                    empty[i] = not len(grams)
                    norms[i] = max(1, len(grams)) ** 0.5
                    matrix[i, self.rows[grams]] = 1
                margins = (matrix @ self.weights) / norms[:, None] + self.bias
                share = np.exp(SHARPNESS * (margins - margins.max(1, keepdims=True)))
                share /= share.sum(1, keepdims=True)
                best = share.argmax(1)
                for i in range(len(block)):
                    names.append(UNKNOWN if empty[i] else self.languages[best[i]])
                    scores.append(0.0 if empty[i] else float(share[i, best[i]]))
            return names, scores

        return score


def fit_language_model(docs: DataFrame, usable: Column, id_col: str = "doc_id", text_col: str = "text",
                       lang_col: str = "lang", per_language: int = TEXTS_PER_LANGUAGE,
                       landmarks: int = LANDMARKS_PER_LANGUAGE) -> LanguageModel | None:
    """Learns from rows for which ``usable`` holds and text, id and language are not null; None if there are none.

    At most ``per_language`` ids of each language are used, chosen by a hash of the id; these rows, not more, are
    gathered. If an id is repeated, its smallest (language, text) counts.
    """
    spark = docs.sparkSession
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"), F.col(lang_col).alias("lang"),
                       usable.alias("usable")).where("usable and id is not null and text is not null and lang is not null")
    chosen = two_level_sample(rows.select("id", "lang"), "lang", "id", per_language).select("id").distinct()
    # per_language ids for each language
    sample = materialize(
        rows.join(F.broadcast(chosen), "id").groupBy("id").agg(F.min(F.struct("lang", "text")).alias("row"))
        .select("id", "row.lang", "row.text").repartition(32, "id"), "language-sample")
    languages = [r.lang for r in sample.select("lang").distinct().orderBy("lang").collect()]
    if not languages:
        return None

    def gram_sets(batch: pa.RecordBatch) -> pa.RecordBatch:
        presence = Presence()
        sets = [presence(t).astype(np.int32).tobytes() for t in batch.column(2).to_pylist()]
        return pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(sets, pa.binary())],
                                          names=["id", "lang", "grams"])

    kind = docs.schema[id_col].dataType
    schema = T.StructType([T.StructField("id", kind), T.StructField("lang", T.StringType()),
                           T.StructField("grams", T.BinaryType())])
    picked = two_level_sample(sample, "lang", "id", landmarks).select("id", "lang", "text")
    found = sorted(map_rows(picked, gram_sets, schema).where(F.length("grams") > 0).collect(), key=lambda r: (r.lang, r.id))
    if not found:
        return None
    sets = [np.frombuffer(bytes(r.grams), np.int32) for r in found]
    vocabulary = np.unique(np.concatenate(sets))
    number = np.full(Presence.SIZE, len(vocabulary), np.int32)
    number[vocabulary] = np.arange(len(vocabulary))
    marks = np.zeros((len(vocabulary) + 1, len(sets)), np.float32)
    for j, grams in enumerate(sets):
        marks[number[grams], j] = len(grams) ** -0.5
    shared = spark.sparkContext.broadcast((number, marks))

    width = len(sets)

    def moments(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Of the kernel rows of a task: one row per landmark of their products, then sums per language."""
        rows_of, columns = shared.value
        presence, at = Presence(), {name: i for i, name in enumerate(languages)}
        products, sums, n = np.zeros((width, width)), np.zeros((len(languages), width)), np.zeros(len(languages))
        for batch in batches:
            names, texts = batch.column(0).to_pylist(), batch.column(1).to_pylist()
            for start in range(0, len(texts), BLOCK):
                part = [presence(t) for t in texts[start:start + BLOCK]]
                k = np.stack([columns[rows_of[g]].sum(0) / max(1, len(g)) ** 0.5 for g in part]).astype(np.float64)
                products += k.T @ k
                which = np.array([at[x] for x in names[start:start + BLOCK]])
                np.add.at(sums, which, k)
                np.add.at(n, which, 1.0)
        for first, table in ((0, products), (width, sums), (width + len(languages), n[None, :])):
            for start in range(0, len(table), BLOCK):
                part = table[start:start + BLOCK]
                yield pa.RecordBatch.from_arrays([
                    pa.array(np.arange(first + start, first + start + len(part))), pa.array(list(part), pa.list_(pa.float64()))],
                    names=["line", "v"])

    parts = sample.select("lang", "text").coalesce(FIT_TASKS).mapInArrow(moments, "line long, v array<double>")
    lines = parts.groupBy("line").applyInArrow(_add_lines, "line long, v binary").collect()
    shared.unpersist()
    total = {r.line: np.frombuffer(bytes(r.v)) for r in lines}
    products = np.stack([total[i] for i in range(width)])
    sums = np.stack([total[width + i] for i in range(len(languages))])
    n = total[width + len(languages)]
    among = marks.T.astype(np.float64) @ marks.astype(np.float64)
    beta, bias = kernel_ridge(products, sums, n, among)
    weights = (marks.astype(np.float64) @ beta).astype(np.float32)
    return LanguageModel(languages, number, weights, bias)


def _add_lines(table: pa.Table) -> pa.Table:
    """Sum of equally long lines; in the order of their values, so that the result does not depend on arrival."""
    values = np.stack([np.array(v) for v in table.column("v").to_pylist()])
    return pa.table({"line": table.column("line").slice(0, 1), "v": pa.array([np.sort(values, axis=0).sum(0).tobytes()], pa.binary())})


def kernel_ridge(products: np.ndarray, sums: np.ndarray, n: np.ndarray, among: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Weights on the landmarks and a bias per language: ridge regression of 1 (the language) and -1 on Nyström features.

    Of the kernel rows of texts with landmarks: products is the sum of their outer products, sums their sum by language,
    n the number of texts by language. among: kernel of the landmarks."""
    values, vectors = np.linalg.eigh(among)
    keep = values > 1e-8 * values.max()
    root = vectors[:, keep] / np.sqrt(values[keep])
    count, every = n.sum(), sums.sum(0)
    mean, middle = every @ root / count, 2 * n / count - 1
    inner = root.T @ products @ root - count * np.outer(mean, mean) + RIDGE * count * np.eye(root.shape[1])
    # sum of (feature - mean) (target - middle): the constant part of the target falls out
    right = root.T @ (2 * sums - 2 * np.outer(n / count, every)).T
    solved = np.linalg.solve(inner, right)
    return root @ solved, middle - mean @ solved


def identify(docs: DataFrame, model: LanguageModel | None, text_col: str = "text") -> DataFrame:
    """All columns of docs, then lang_pred and score (0 to 1).

    A text that is null or has no letter gets ``und`` and 0, as do all texts if there is no model. Whole texts are
    scored, of any length; an empty table gives an empty result. Names that docs has already get a leading underscore.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)
    state: dict = {}

    def run(texts: pa.Array) -> list[pa.Array]:
        if shared.value is None:
            return [pa.array([UNKNOWN] * len(texts)), pa.array([0.0] * len(texts))]
        if not state:
            state["score"] = shared.value.scorer()
        names, scores = state["score"](texts)
        return [pa.array(names, pa.string()), pa.array(scores, pa.float64())]

    return append_columns(docs, [text_col], [(fresh(docs, "lang_pred"), T.StringType()),
                                             (fresh(docs, "score"), T.DoubleType())], run)
