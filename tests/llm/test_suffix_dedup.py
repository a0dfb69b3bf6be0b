import hashlib
import random

import numpy as np
import pytest

from threadlens.llm import suffix_dedup as sd

SCHEMA = "doc_id long, text string, kept string, gone_runs int"


def brute(rows, length):
    seen, out = set(), []
    for doc, text, *_ in sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0)):
        data = (text or "").encode()
        gone = np.zeros(len(data), bool)
        for i in range(len(data) - length + 1):
            s = data[i:i + length]
            if s in seen:
                gone[i:i + length] = True
            seen.add(s)
        spans = int((gone & ~np.concatenate([[False], gone[:-1]])).sum()) if len(data) else 0
        out.append((doc, len(data), int(gone.sum()), spans, bytes(b for b, g in zip(data, gone, strict=True) if not g)))
    return sorted(out, key=str)


def got(spark, rows, length, **options):
    out = sd.remove_repeats(spark.createDataFrame(rows, SCHEMA), length=length, **options)
    assert out.columns[-4:] == ["n_bytes", "n_removed", "n_spans", "_kept"]
    return sorted(((r.doc_id, r.n_bytes, r.n_removed, r.n_spans, bytes(r["_kept"])) for r in out.collect()), key=str)


def make_rows(seed):
    rng = random.Random(seed)
    word = lambda: "".join(rng.choices("abcdeé", k=rng.randrange(1, 7)))
    pool = [" ".join(word() for _ in range(rng.randrange(5, 50))) for _ in range(12)]
    rows = []
    for i in range(40):
        text = " ".join(rng.choice(pool) if rng.random() < 0.6 else " ".join(word() for _ in range(20)) for _ in range(rng.randrange(6)))
        if rng.random() < 0.2:
            at = rng.randrange(len(text) + 1)
            text = text[:at] + "X" + text[at:]
        rows.append((i * 3 + 1, text, "k", 1))
    rows += [(500, "is " * 400, "", 0), (501, "is " * 200, "", 0), (502, None, None, None), (503, "", "", 0),
             (504, "é" * 49, "", 0), (505, "é" * 50, "", 0), (506, "é" * 51, "", 0), (None, pool[0] * 3, None, None)]
    rng.shuffle(rows)
    return rows


@pytest.mark.parametrize("seed", [1, 2])
def test_removed_bytes_match_brute_force(spark, seed):
    rows = make_rows(seed)
    assert got(spark, rows, 100) == brute(rows, 100)


def test_frequent_grams_do_not_change_the_result(spark):
    rows = make_rows(3)
    assert got(spark, rows, 64, frequent=2) == got(spark, rows, 64, frequent=10**6) == brute(rows, 64)


def test_rows_that_share_an_id_or_have_none(spark):
    rows = make_rows(5)
    long = [t for _, t, *_ in rows if t and len(t) > 300][:4]
    rows += [(2000, "only here " + long[0][::-1], "k", 1)] * 3 + [(2001, long[1][::-1], "k", 1), (2001, long[2][::-1] + long[1][::-1], "k", 1)]
    rows += [(None, long[3][::-1] + "a", None, None), (None, long[3][::-1] + "b", None, None), (None, "some other text " * 20, None, None),
             (None, None, None, None), (None, None, None, None)]
    by_hash = spark.createDataFrame(rows, SCHEMA).selectExpr("*", "xxhash64(text) AS h").collect()
    ordered = [tuple(r)[:4] for r in sorted(by_hash, key=lambda r: r.h)]
    out = got(spark, rows, 100)
    assert out == brute(ordered, 100)
    assert sorted(removed == 0 for doc, _, removed, *_ in out if doc == 2000) == [False, False, True]


def test_empty_table(spark):
    assert got(spark, [], 100) == []


def test_query_on_given_table(spark):
    from threadlens.llm.queries import all_queries

    rows = [tuple(r) for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text").collect()]
    out = all_queries()["op6_suffix_dedup"](spark, "/root/testdata/sf0.001").collect()
    want = [(d, n, r, s, hashlib.sha256(k).hexdigest()) for d, n, r, s, k in brute(rows, 100)]
    assert sorted((tuple(r) for r in out), key=str) == sorted(want, key=str)


def test_deep_shallow_groups():
    rng = random.Random(4)
    data = bytes(rng.choices(b"ab", k=3000)) + b"q" * 300 + bytes(rng.choices(b"ab", k=300)) * 4
    for length in (40, 100):
        window = np.arange(len(data) - length + 1)
        found = sd.deep_shallow(np.frombuffer(data, np.uint8), window, np.zeros(len(window), np.int64), length)
        want = {}
        for w in window.tolist():
            want.setdefault(data[w:w + length], []).append(w)
        assert sorted(sorted(g) for g in found) == sorted(g for g in want.values() if len(g) > 1)


def test_lowest():
    x = np.random.default_rng(0).integers(0, 99, 60).astype(np.uint64)
    for width in (1, 2, 5, 8, 13):
        assert sd.lowest(x, width).tolist() == [x[i:i + width].min() for i in range(60 - width + 1)]
