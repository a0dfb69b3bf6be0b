"""Substring dedup by hashed units: runs of sentences or lines that stand earlier in the corpus are removed.

Units are normalised and hashed; the earliest occurrence of each digest is found by one aggregate; every other
occurrence is marked. Marked units that form long runs are removed, and the places of what stays are kept.
"""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from threadlens.llm.common import append_columns, fresh, map_rows, materialize
from threadlens.llm.suffix_dedup import rows_apart

#: Ends of units: a line end, or a sentence end with blanks behind it.
ENDS = {"line": re.compile(r"\n+"), "paragraph": re.compile(r"\n[^\S\n]*\n\s*"),
        "sentence": re.compile(r"\n+|[.!?]+[^\S\n]+")}
#: Words of a run of neighbouring repeated units, at least, for it to be removed; a definition, not a limit of the search.
MIN_RUN_WORDS = 20
#: A digest is hot if it has more than this share of the occurrences of repeated digests, so at most 1 / HOT_SHARE are.
HOT_SHARE = 1 / 65536
#: A digest with fewer occurrences than this is never hot.
HOT_LEAST = 1000


def cut_units(text: str, unit: str) -> list[tuple[int, int]]:
    """(start, end) of the units, which cover the whole text; what ends a unit belongs to it."""
    out, start = [], 0
    for m in ENDS[unit].finditer(text):
        out.append((start, m.end()))
        start = m.end()
    if start < len(text):
        out.append((start, len(text)))
    return out


def unit_keys(text: str, unit: str) -> list[tuple[int, int, bytes | None]]:
    """(start, end, digest) of every unit, compared in lower case with runs of blanks as one space. None for a unit
    without a word."""
    out = []
    for start, end in cut_units(text, unit):
        own = text[start:end].lower().split()
        out.append((start, end, xxhash.xxh3_128_digest(" ".join(own).encode("utf-8", "surrogatepass")) if own else None))
    return out


def removed_units(sizes: list[int], marked: set[int], min_run_words: int) -> set[int]:
    """Units that go, from the units' numbers of words and the units that occur earlier.

    A run is a stretch of units of which those with words are marked, from a marked one to a marked one. It goes if it
    has ``min_run_words`` words, or if no unit with words is left outside."""
    if not marked:
        return set()
    if all(i in marked for i, n in enumerate(sizes) if n):
        return set(range(len(sizes)))
    out: set[int] = set()
    run, words = [], 0
    for i, n in enumerate([*sizes, 1]):
        if n and i not in marked:
            if words >= min_run_words:
                out.update(range(run[0], run[-1] + 1))
            run, words = [], 0
        elif n:
            run.append(i)
            words += n
    return out


SPANS = T.ArrayType(T.StructType([T.StructField("start", T.LongType()), T.StructField("end", T.LongType())]))


def merge(spans: list[tuple[int, int]]) -> list[dict]:
    out: list[dict] = []
    for start, end in spans:
        if out and out[-1]["end"] == start:
            out[-1]["end"] = end
        else:
            out.append({"start": start, "end": end})
    return out


def dedup_units(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", unit: str = "sentence",
                min_run_words: int = MIN_RUN_WORDS) -> DataFrame:
    """All columns of docs, then n_units, n_removed, kept_spans (places in the text, neighbours merged) and kept_text.

    Units are lines ("line"), paragraphs ("paragraph"), or lines cut further at sentence ends ("sentence"), so that a
    passage that starts inside a line is found as well. Of units with the same digest the one in the smallest id, there
    the first one, is the one that counts as new; all others occur earlier. Runs of neighbouring units that all occur
    earlier are removed if they have ``min_run_words`` words, and a document goes whole if all its units with words occur
    earlier. So exact copies and repeated passages go, and a short sentence that many documents have stays among new text.
    Units are judged on the input: the first occurrence of a digest is never removed.

    A null id ranks before all others. Rows that share an id, or have none, count apart, in the order of a hash of their
    texts: of a repeated row one copy stays. Only a table with such rows is sorted and written with a number for each
    row. Null and empty texts have no units and the kept text "". Texts of any length are taken whole. An empty table
    gives an empty result. Names that docs has already get a leading underscore.

    Only digests, ids and places are shuffled until it is known which documents lose something. Occurrences of hot
    digests, of which there are at most 1 / HOT_SHARE, are settled against a broadcast table of them; they take part in
    the join under keys of their own that match nothing, so no task gets them all.
    """
    doc, number = F.coalesce(F.col(id_col).cast("long"), F.lit(-(1 << 63))), fresh(docs, "unit_row")
    if not docs.select(doc.alias("doc")).groupBy("doc").count().where("count > 1").isEmpty():
        docs, doc = rows_apart(docs, id_col, text_col, number), F.col(number)

    def occurrences(batch: pa.RecordBatch) -> pa.RecordBatch:
        ids, numbers, halves = [], [], []
        for doc, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            for i, (_, _, digest) in enumerate(unit_keys(text, unit) if text else ()):
                if digest is not None:
                    ids.append(doc)
                    numbers.append(i)
                    halves.append(digest)
        pair = np.frombuffer(b"".join(halves), "<i8").reshape(-1, 2)
        return pa.RecordBatch.from_arrays(
            [pa.array(pair[:, 0].copy()), pa.array(pair[:, 1].copy()), pa.array(ids, pa.int64()),
             pa.array(numbers, pa.int32())], names=["first", "second", "doc", "number"])

    source = docs.select(doc.alias("doc"), F.col(text_col).alias("text"))
    units = map_rows(source, occurrences, "first long, second long, doc long, number int")
    repeated = materialize(
        units.groupBy("first", "second").agg(F.min(F.struct("doc", "number")).alias("keep"), F.count("*").alias("n"))
        .where("n > 1"), "unit-digests")
    least = max(HOT_LEAST, int((repeated.agg(F.sum("n")).first()[0] or 0) * HOT_SHARE))
    # at most 1 / HOT_SHARE rows of 36 bytes, by the choice of the least number
    hot = F.broadcast(repeated.where(F.col("n") > least).select("first", "second", F.col("keep").alias("hot_keep")))
    told = units.join(hot, ["first", "second"], "left")
    settled = F.col("hot_keep").isNotNull()
    keyed = told.select(
        F.when(settled, F.xxhash64("doc", "number")).otherwise(F.col("first")).alias("first"),
        F.when(~settled, F.col("second")).alias("second"), "doc", "number", "hot_keep")
    rest = repeated.where(F.col("n") <= least).select("first", "second", "keep")
    gone = (
        keyed.join(rest, ["first", "second"], "left").withColumn("keep", F.coalesce("hot_keep", "keep"))
        .where(F.col("keep").isNotNull() & (F.struct("doc", "number") != F.col("keep"))).groupBy("doc")
        .agg(F.array_sort(F.collect_set("number")).alias("_gone"))
    )
    marks, key = fresh(docs, "gone"), fresh(docs, "doc_of_gone")
    joined = docs.join(gone.select(F.col("doc").alias(key), F.col("_gone").alias(marks)), doc == F.col(key), "left").drop(key)

    def finish(texts: pa.Array, removed: pa.Array) -> list[pa.Array]:
        totals, numbers, spans, kept = [], [], [], []
        for text, out in zip(texts.to_pylist(), removed.to_pylist(), strict=True):
            cut = cut_units(text or "", unit)
            sizes = [len(text[a:b].split()) for a, b in cut] if out else []
            lost = removed_units(sizes, set(out or ()), min_run_words)
            stay = [s for i, s in enumerate(cut) if i not in lost]
            totals.append(len(cut))
            numbers.append(len(lost))
            spans.append(merge(stay))
            kept.append("".join(text[a:b] for a, b in stay) if lost else text or "")
        kind = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))
        return [pa.array(totals, pa.int64()), pa.array(numbers, pa.int64()), pa.array(spans, kind),
                pa.array(kept, pa.string())]

    fields = [(fresh(docs, "n_units"), T.LongType()), (fresh(docs, "n_removed"), T.LongType()),
              (fresh(docs, "kept_spans"), SPANS), (fresh(docs, "kept_text"), T.StringType())]
    return append_columns(joined, [text_col, marks], fields, finish).drop(marks, number)
