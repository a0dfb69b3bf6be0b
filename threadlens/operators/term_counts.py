"""Counts of n-grams over token lists: words once, then n-grams of frequent words as numbers.

Tokens are numbered by Arrow's dictionary encoding and n-grams are made, sketched and counted in numpy, so a string is
built for each different n-gram of a block and not for each occurrence.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from threadlens.operators.shared_tuning import tree_sum

#: Tokens that are counted at once; a longer text makes a block of its own.
BLOCK_TOKENS = 1 << 19
COUNTS = "term string, tf long, df long"


def _blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[np.ndarray, pa.Array, np.ndarray]]:
    """(number of each token in the dictionary, dictionary, text of each token)."""
    for batch in batches:
        lists = batch.column(0)
        ends = np.cumsum(pc.fill_null(pc.list_value_length(lists), 0).to_numpy(zero_copy_only=False).astype(np.int64))
        start = 0
        while start < len(ends):
            before = int(ends[start - 1]) if start else 0
            stop = max(start + 1, int(np.searchsorted(ends, before + BLOCK_TOKENS, side="right")))
            own = ends[start:stop]
            flat = lists.slice(start, stop - start).flatten().dictionary_encode()
            text = np.repeat(np.arange(stop - start), np.diff(own, prepend=before))
            yield flat.indices.to_numpy(zero_copy_only=False).astype(np.int64), flat.dictionary, text
            start = stop


def _rows(terms: pa.Array, tf: np.ndarray, df: np.ndarray) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([terms.cast(pa.string()), pa.array(tf, pa.int64()), pa.array(df, pa.int64())],
                                      names=["term", "tf", "df"])


def _texts_of(code: np.ndarray, text: np.ndarray, width: int) -> np.ndarray:
    """In how many texts each of the codes 0 to width - 1 is."""
    return np.bincount(np.unique(text * width + code) % width, minlength=width) if len(code) else np.zeros(width, np.int64)


def word_counts(tokens: DataFrame) -> DataFrame:
    """(term, tf, df) of every word of the token lists."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for code, words, text in _blocks(batches):
            yield _rows(words, np.bincount(code, minlength=len(words)), _texts_of(code, text, len(words)))

    return _summed(tokens.mapInArrow(run, COUNTS))


def _summed(parts: DataFrame) -> DataFrame:
    return parts.groupBy("term").agg(F.sum("tf").alias("tf"), F.sum("df").alias("df"))


def _numbered(code: np.ndarray, words: pa.Array, known: pa.Array) -> np.ndarray:
    """Position of each token among the known words, or -1."""
    return pc.fill_null(pc.index_in(words, value_set=known), -1).to_numpy(zero_copy_only=False).astype(np.int64)[code]


def _grams(ids: np.ndarray, text: np.ndarray, n: int) -> np.ndarray:
    """Where n-grams of known words inside one text start."""
    m = len(ids) - n + 1
    if m <= 0:
        return np.zeros(0, np.int64)
    ok = text[:m] == text[n - 1:]
    for j in range(n):
        ok &= ids[j:j + m] >= 0
    return np.flatnonzero(ok)


def _slots(ids: np.ndarray, at: np.ndarray, n: int, slots: int) -> np.ndarray:
    h = np.full(len(at), n, np.uint64)
    for j in range(n):
        h = (h ^ ids[at + j].astype(np.uint64)) * np.uint64(0x9E3779B97F4A7C15)
        h ^= h >> np.uint64(29)
    return (h % np.uint64(slots)).astype(np.int64)


def gram_counts(tokens: DataFrame, words: list[str], sizes: list[int], least: float, slots: int) -> DataFrame:
    """(term, tf, df) of the n-grams of these sizes, all of whose words are among ``words``.

    A first pass adds up in how many texts each of ``slots`` hash slots has an n-gram; n-grams of slots below ``least``
    are left out, which leaves out none that is in ``least`` texts. 0 slots: no such pass, all are counted.
    """

    def sketch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, known = np.zeros(slots), pa.array(words, pa.string())
        for code, own, text in _blocks(batches):
            ids = _numbered(code, own, known)
            starts = [(n, _grams(ids, text, n)) for n in sizes]
            total += _texts_of(np.concatenate([_slots(ids, at, n, slots) for n, at in starts]),
                               np.concatenate([text[at] for _, at in starts]), slots)
        yield pa.RecordBatch.from_arrays([pa.array([total.tobytes()], pa.binary())], names=["sums"])

    full = tree_sum(tokens.mapInArrow(sketch, "sums binary"), slots, finish=lambda t: t) >= least if slots else None

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = pa.array(words, pa.string())
        for code, own, text in _blocks(batches):
            ids = _numbered(code, own, known)
            for n in sizes:
                at = _grams(ids, text, n)
                if full is not None:
                    at = at[full[_slots(ids, at, n, slots)]]
                if not len(at):
                    continue
                key, span = ids[at], len(words)
                for j in range(1, n):
                    if span >= (1 << 62) // len(words):  # ranks instead of numbers that pass 64 bits
                        key = np.unique(key, return_inverse=True)[1]
                        span = len(key)
                    key, span = key * len(words) + ids[at + j], span * len(words)
                _, first, key, tf = np.unique(key, return_index=True, return_inverse=True, return_counts=True)
                parts = [known.take(pa.array(ids[at[first] + j])) for j in range(n)]
                yield _rows(pc.binary_join_element_wise(*parts, " "), tf, _texts_of(key, text[at], len(tf)))

    return _summed(tokens.mapInArrow(run, COUNTS))
