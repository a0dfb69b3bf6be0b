import hashlib
import random
import zlib

import numpy as np
import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from threadlens.llm import line_dedup as ld
from threadlens.llm import packing as pk
from threadlens.llm.tokens import BatchEncoder

TOKENIZER = public_tokenizers.path("byte_bpe_50k.json")
LONG = "this line is long enough to count for the removal %d"
ROWS = [
    (1, f"{LONG % 1}\nshort\n", "x", 1), (2, f"  {(LONG % 1).upper()}\t\nother", "x", 2), (3, LONG % 1, None, 3),
    (4, f"a\n{LONG % 1}\n{LONG % 1}", "y", 4), (5, f"{LONG % 1}\n{LONG % 2}\n{LONG % 1}", "z", 5),
    (6, None, None, 6), (7, "", "x", 7), (8, "\n\n", None, 8), (9, LONG % 2 + " " * 5000, "x", 9),
    (10, "é" * 39 + " ", "x", 9), (11, "w " * 40000, "x", 9),
]
SCHEMA = "doc_id long, text string, kept_text string, n_lines int"


def brute_lines(rows, min_chars=40, min_docs=5):
    keys = {}
    for doc, text, *_ in rows:
        for line in (text or "").split("\n"):
            k = ld.line_key(line.encode()).decode()
            if len(k) >= min_chars:
                keys.setdefault(k, set()).add(doc)
    out = []
    for doc, text, *_ in rows:
        lines = (text or "").split("\n")
        kept = [x for x in lines
                if len(h := keys.get(ld.line_key(x.encode()).decode(), ())) < min_docs or doc == max(h)]
        out.append((doc, len(lines), len(lines) - len(kept), "\n".join(kept)))
    return sorted(out)


def got_lines(spark, rows, **options):
    df = ld.dedup_lines(spark.createDataFrame(rows, SCHEMA), **options)
    assert df.columns[:4] == ["doc_id", "text", "kept_text", "n_lines"]
    return sorted((r["doc_id"], r["_n_lines"], r["n_dropped"], r["_kept_text"]) for r in df.collect())


def test_lines_match_brute_force(spark):
    assert got_lines(spark, ROWS) == brute_lines(ROWS)


@pytest.mark.parametrize("options", [{"shard_keys": 8, "wave_bytes": 1}, {"shard_keys": 16, "wave_bytes": 1 << 20}])
def test_lines_in_many_shards_and_waves(spark, options):
    rng = random.Random(3)
    pool = [LONG % i + "x" * (i % 3) for i in range(60)]
    rows = [(i, "\n".join(rng.choices(pool, k=rng.randrange(5))), None, 0) for i in range(90)]
    assert got_lines(spark, rows, **options) == brute_lines(rows)


def test_lines_of_an_empty_table(spark):
    assert got_lines(spark, []) == []


def test_perfect_hash_is_minimal():
    keys = np.unique(np.random.default_rng(0).integers(0, 1 << 63, 20000).astype(np.uint64))
    assert sorted(ld.PerfectHash(keys)(keys)) == list(range(len(keys)))


def test_batch_ids_equal_the_library():
    encoder = BatchEncoder(TOKENIZER, slice_bytes=60)
    texts = [None, "", " ", "a  b", "a b\n", "x\xa0 \xa0y", "don't <|endoftext|> stop", "\nfoo bar", "été 12 !!", "a a"] * 3
    import pyarrow as pa

    want = [encoder.tokenizer.encode(t or "", add_special_tokens=False).ids for t in texts]
    assert [x.tolist() for x in encoder.batch(pa.array(texts))] == want


@settings(max_examples=150, deadline=None)
@given(st.dictionaries(st.integers(1, 20), st.integers(1, 9), min_size=1, max_size=9))
def test_plans_are_whole_and_near_the_bound(counts):
    plan = pk.make_plan(counts, 20)
    held = {}
    for lengths, times in plan.patterns:
        assert sum(lengths) <= 20
        for w in lengths:
            held[w] = held.get(w, 0) + times
    assert held == counts
    bound = pk.lower_bound(counts, 20)
    assert bound <= plan.sequences <= max(bound + 1, 11 * bound / 9 + 1)


def fewest(sizes, capacity):
    """Exact number of sequences, by search."""
    sizes, best = sorted(sizes, reverse=True), [len(sizes)]

    def go(i, rooms):
        if len(rooms) >= best[0]:
            return
        if i == len(sizes):
            best[0] = len(rooms)
            return
        for room in set(rooms):
            if room >= sizes[i]:
                rest = list(rooms)
                rest.remove(room)
                go(i + 1, [*rest, room - sizes[i]])
        go(i + 1, [*rooms, capacity - sizes[i]])

    go(0, [])
    return best[0]


@settings(max_examples=100, deadline=None)
@given(st.lists(st.integers(1, 20), min_size=1, max_size=9))
def test_dominance_keeps_the_optimum(sizes):
    counts = {w: sizes.count(w) for w in set(sizes)}
    plan = pk.Plan(20)
    left = pk.reduce_by_dominance(dict(counts), plan)
    rest = [w for w, n in left.items() for _ in range(n)]
    assert plan.sequences + (fewest(rest, 20) if rest else 0) == fewest(sizes, 20)


def test_pack_round_trip(spark):
    rng = random.Random(1)
    rows = [(i, " ".join(rng.choices(["alpha", "été", "b", "\n", "9"], k=rng.choice([0, 3, 40, 700, 5000]))), i)
            for i in range(60)] + [(60, None, 0), (61, "", 0), (61, "", 0)]
    out = pk.pack(spark.createDataFrame(rows, "doc_id long, text string, sequence_id int"), TOKENIZER).toPandas()
    encoder = BatchEncoder(TOKENIZER)
    want = []
    for doc, text, _ in rows:
        ids = [*encoder.tokenizer.encode(text or "", add_special_tokens=False).ids, 0]
        sizes = [len(ids)] if len(ids) <= 2048 else [len(ids) % 2048] * (len(ids) % 2048 > 0) + [2048] * (len(ids) // 2048)
        start = 0
        for k, n in enumerate(sizes):
            want.append((doc, k, start, n, zlib.crc32(np.array(ids[start:start + n], "<u4").tobytes())))
            start += n
    assert sorted(map(tuple, out[["doc_id", "piece", "start", "length", "ids_crc32"]].values.tolist())) == sorted(want)
    for _, group in out.groupby("sequence_id"):
        group = group.sort_values("offset")
        assert group["length"].sum() <= 2048
        assert (group["offset"] == group["length"].cumsum() - group["length"]).all()
    assert out.sequence_id.nunique() <= pk.lower_bound(out.groupby("length").size().to_dict()) + 1


def test_pack_empty_table(spark):
    assert pk.pack(spark.createDataFrame([], "doc_id long, text string"), TOKENIZER).count() == 0


def test_query_digest(spark):
    from threadlens.llm.queries import all_queries

    out = {r.doc_id: r for r in all_queries()["op4_line_dedup"](spark, "/root/testdata/sf0.001").collect()}
    texts = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text").collect()
    for doc, lines, gone, kept in brute_lines([(r.doc_id, r.text) for r in texts]):
        assert (out[doc].n_lines, out[doc].n_dropped) == (lines, gone)
        assert out[doc].kept_sha256 == hashlib.sha256(kept.encode()).hexdigest()
