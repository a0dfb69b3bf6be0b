"""Benchmark decontamination with the q-gram lemma.

An item of m characters that occurs in a text with at most k edits shares m + 1 - q (k + 1) character q-grams with the
place where it occurs, on diagonals that differ by at most k. Shared q-grams are counted in overlapping diagonal bands;
only regions that reach the bound are aligned, within their band. Items too short for that bound are searched verbatim.
"""

from __future__ import annotations

import re

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from threadlens.llm.common import append_columns, fresh, materialize

Q = 8
#: Edits allowed per character of an item.
EDIT_SHARE = 0.1
#: Items with fewer characters share too few q-grams with a place that differs; they are searched verbatim.
MIN_CHARS = 40
#: Blocks of scripts written without blanks (first and last code point); each of their characters is a word.
UNSPACED = ((0x0E00, 0x0EFF), (0x1000, 0x109F), (0x1780, 0x17FF), (0x2E80, 0xABFF), (0xF900, 0xFAFF), (0x20000, 0x3FFFF))
#: Characters of items that one pass holds, about.
BLOCK_CHARS = 4 << 20
FILTER_BITS = 24
_A, _B = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xBF58476D1CE4E5B9)
MATCHES = T.ArrayType(T.StructType([T.StructField("item", T.LongType()), T.StructField("start", T.LongType()),
                                    T.StructField("end", T.LongType()), T.StructField("edits", T.IntegerType())]))


def normal(text: str) -> str:
    """Lower case, runs of blanks as one space."""
    return " ".join(text.lower().split())


def points(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)


def gram_hashes(p: np.ndarray) -> np.ndarray:
    """Hash of every q-gram: neighbouring halves are joined until they have q characters (q is a power of two)."""
    h = p.astype(np.uint64) + _B
    n = 1
    while n < Q and len(h) > n:
        h = h[:-n] * _A + (h[n:] ^ (h[n:] >> np.uint64(29))) * _B
        n *= 2
    return h if n == Q else h[:0]


def budget(m: int, share: float) -> int:
    """Edits allowed in an item of m characters: its share, but no more than the lemma can see."""
    return max(0, min(int(m * share), m // Q - 1))


def align(item: np.ndarray, text: np.ndarray, low: int, high: int, k: int) -> tuple[int, int] | None:
    """(end, edits) of the best occurrence of item in text with its path on diagonals low to high (place in text less
    place in item); None if it needs more than k edits. The occurrence may start and end anywhere."""
    width = high - low + 1
    at = np.arange(width)
    # places outside the text hold a letter that equals none: taking one costs what leaving out the item's letter costs
    room = np.full(len(item) + width, 0xFFFFFFFF, np.uint32)
    a, b = max(0, low), min(len(text), low + len(room))
    if b > a:
        room[a - low:b - low] = text[a:b]
    # row i, entry d: fewest edits for item[:i] against a piece of text that ends before place i + low + d
    row = np.zeros(width, np.int64)
    for i in range(len(item)):
        best = row + (room[i:i + width] != item[i])
        np.minimum(best[:-1], row[1:] + 1, out=best[:-1])
        row = np.minimum.accumulate(best - at) + at
        if i % 16 == 15 and row.min() > k:
            return None
    best = int(row.argmin())
    return (min(len(text), len(item) + low + best), int(row[best])) if row[best] <= k else None


def one_word(a: str, b: str) -> bool:
    """Whether no word ends between the neighbours a and b."""
    return a.isalnum() and b.isalnum() and not any(low <= ord(c) <= high for c in (a, b) for low, high in UNSPACED)


class VerbatimIndex:
    """Short items, found where they stand from word edge to word edge."""

    def __init__(self, items: list[tuple[int, str]]):
        self.automaton = ahocorasick.Automaton() if items else None
        for i, text in items:
            self.automaton.add_word(text, (i, len(text)))
        if items:
            self.automaton.make_automaton()

    def matches(self, text: str) -> list[tuple[int, int, int, int]]:
        """(item id, start, end, 0) of the first place of each item in the normal text."""
        first: dict[int, tuple[int, int]] = {}
        for last, (i, m) in self.automaton.iter(text) if self.automaton is not None else ():
            start, end = last + 1 - m, last + 1
            if i in first or start and one_word(text[start - 1], text[start]):
                continue
            if end == len(text) or not one_word(text[last], text[end]):
                first[i] = (start, end)
        return [(i, s, e, 0) for i, (s, e) in first.items()]


class ItemIndex:
    """The q-grams of items, with the items and places where they stand."""

    def __init__(self, items: list[tuple[int, str]], share: float):
        self.ids = [i for i, _ in items]
        self.texts = [t for _, t in items]
        self.points = [points(t) for t in self.texts]
        self.length = np.array([len(p) for p in self.points], np.int64)
        self.edits = np.array([budget(int(m), share) for m in self.length], np.int64)
        self.least = self.length + 1 - Q * (self.edits + 1)
        # bands are two steps wide and start at every step; a step is longer than the edits
        self.step = self.edits + 1
        hashes = [gram_hashes(p) for p in self.points]
        flat = np.concatenate(hashes) if hashes else np.zeros(0, np.uint64)
        owner = np.repeat(np.arange(len(items)), [len(h) for h in hashes])
        place = np.concatenate([np.arange(len(h)) for h in hashes]) if hashes else owner
        order = np.argsort(flat, kind="stable")
        self.owner, self.place = owner[order], place[order]
        self.grams, first = np.unique(flat[order], return_index=True)
        self.first = np.append(first, len(flat))
        self.hit = np.zeros(len(flat), bool)
        self.filter = np.zeros(1 << FILTER_BITS, bool)
        self.filter[(self.grams >> np.uint64(64 - FILTER_BITS)).astype(np.int64)] = True

    def regions(self, p: np.ndarray) -> list[tuple[int, int]]:
        """(item, first diagonal of the band) of every band that reaches the bound of its item."""
        h = gram_hashes(p)
        at = np.flatnonzero(self.filter[(h >> np.uint64(64 - FILTER_BITS)).astype(np.int64)])
        if len(at) == 0 or not len(self.grams):
            return []
        found = np.searchsorted(self.grams, h[at])
        found[found == len(self.grams)] = 0
        same = self.grams[found] == h[at]
        at, found = at[same], found[same]
        size = self.first[found + 1] - self.first[found]
        where = np.repeat(self.first[found] - (np.cumsum(size) - size), size) + np.arange(size.sum())
        item = self.owner[where]
        # an item needs hits at `least` of its places before its bands are looked at
        self.hit[where] = True
        enough = np.bincount(self.owner[np.flatnonzero(self.hit)], minlength=len(self.ids)) >= self.least
        self.hit[where] = False
        if not enough.any():
            return []
        keep = enough[item]
        item, place = item[keep], self.place[where][keep]
        band = (np.repeat(at, size)[keep] - place) // self.step[item]
        spread = np.int64(1) << 40
        code = np.concatenate([item * spread + band, item * spread + band - 1]) + (spread >> 1)
        # a place of the item counts once in a band
        order = np.lexsort((np.tile(place, 2), code))
        code, place = code[order], np.tile(place, 2)[order]
        new = np.concatenate([[True], (code[1:] != code[:-1]) | (place[1:] != place[:-1])])
        bands, count = np.unique(code[new], return_counts=True)
        owner = bands // spread
        full = count >= self.least[owner]
        return [(int(o), int((c - o * spread - (spread >> 1)) * self.step[o]))
                for o, c in zip(owner[full], bands[full], strict=True)]

    def matches(self, text: str) -> list[tuple[int, int, int, int]]:
        """(item id, start, end, edits) of the items found, at places of the normal text. An item is told once, with
        its best occurrence."""
        p = points(text)
        if not len(p):
            return []
        best: dict[int, tuple[int, int, int]] = {}
        for o, low in self.regions(p):
            if o in best and best[o][0] == 0:
                continue
            k, m = int(self.edits[o]), int(self.length[o])
            high = low + 2 * int(self.step[o]) - 1
            # the path may leave the first diagonals of its q-grams by the edits before and behind them
            begin, stop = max(0, low - k), min(len(p), high + m + k + 1)
            exact = text.find(self.texts[o], begin, stop)
            if exact >= 0:
                best[o] = (0, exact, exact + m)
                continue
            found = align(self.points[o], p[begin:stop], low - k - begin, high + k - begin, k)
            if found is not None and (o not in best or found[1] < best[o][0]):
                end = begin + found[0]
                best[o] = (found[1], max(0, end - m), end)
        return sorted((self.ids[o], s, e, d) for o, (d, s, e) in best.items())


def original_places(text: str) -> np.ndarray:
    """For each place of the normal text, and its end, the place in the text."""
    out: list[int] = []
    end = 0
    for word in re.finditer(r"\S+", text):
        if out:
            out.append(end)
        small = len(word.group().lower())
        last = word.end() - 1
        out.extend(min(word.start() + i, last) for i in range(small))
        end = word.end()
    return np.array([*out, end])


def find_items(docs: DataFrame, items: DataFrame, id_col: str = "item_id", item_col: str = "text",
               text_col: str = "text", share: float = EDIT_SHARE, min_chars: int = MIN_CHARS,
               block_chars: int = BLOCK_CHARS) -> DataFrame:
    """All columns of docs, then matches: array of (item, start, end, edits), at places of the text; empty if there
    are none. No shuffle of documents.

    Texts and items are compared in lower case with runs of blanks as one space. An item with at least ``min_chars``
    characters matches where it can be aligned with at most ``share`` of its length in edits (the start of an
    occurrence with edits is told as its end less the item's length). A shorter item matches where it stands verbatim
    between word edges, so an item of one word matches every text with that word. Null and blank items match nothing;
    items with equal text are told as the smallest id. Null and empty texts match nothing. Every row is searched by
    itself, so repeated rows get equal matches; a text of any length is searched whole, in memory of a few times its
    length. Items are searched in blocks of about ``block_chars`` characters, so any number can be searched; between
    blocks the documents are written.
    """
    spark = docs.sparkSession
    known = materialize(
        items.select(F.col(id_col).cast("long").alias("id"), F.col(item_col).alias("text"))
        .where("id is not null and text is not null").groupBy("text").agg(F.min("id").alias("id"))
        .withColumn("n", F.length("text")), "benchmark-items")
    total = known.agg(F.sum("n")).first()[0] or 0
    blocks = max(1, -(-total // block_chars))
    name, current, before = fresh(docs, "matches"), docs, None
    for block in range(blocks):
        own: dict[str, int] = {}
        for r in known.where(F.pmod(F.xxhash64("id"), F.lit(blocks)) == block).select("id", "text").collect():
            text = normal(r.text)
            if text:
                own[text] = min(own.get(text, r.id), r.id)
        shared = spark.sparkContext.broadcast(sorted((i, t) for t, i in own.items()))
        state: dict = {}

        def search(texts: pa.Array, before: pa.Array | None = None, shared=shared, state=state) -> list[pa.Array]:
            if not state:
                state["long"] = ItemIndex([x for x in shared.value if len(x[1]) >= min_chars], share)
                state["short"] = VerbatimIndex([x for x in shared.value if len(x[1]) < min_chars])
            out = []
            earlier = before.to_pylist() if before is not None else [[]] * len(texts)
            for text, old in zip(texts.to_pylist(), earlier, strict=True):
                plain = normal(text) if text else ""
                found = sorted(state["long"].matches(plain) + state["short"].matches(plain))
                if found:
                    at = original_places(text)
                    found = [{"item": i, "start": int(at[s]), "end": int(at[e - 1]) + 1, "edits": d}
                             for i, s, e, d in found]
                out.append([*old, *found])
            kind = pa.list_(pa.struct([("item", pa.int64()), ("start", pa.int64()), ("end", pa.int64()),
                                       ("edits", pa.int32())]))
            return [pa.array(out, kind)]

        if block == 0:
            current = append_columns(current, [text_col], [(name, MATCHES)], search)
        else:
            written = materialize(current, "benchmark-matches")
            before.destroy()
            more = append_columns(written, [text_col, name], [(fresh(written, "more"), MATCHES)], search)
            current = more.drop(name).withColumnRenamed(more.columns[-1], name)
        before = shared
    return current
