import itertools
import random
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark import cloudpickle

from threadlens.llm import bag_minhash as bm
from threadlens.llm.common import components


def bag(text):
    words = (text or "").lower().split()
    n = max(len(words) - 4, min(len(words), 1))
    return Counter(tuple(words[i:i + 5]) for i in range(n))


def similar(a, b):
    keys = set(a) | set(b)
    return keys and 5 * sum(min(a[k], b[k]) for k in keys) >= 4 * sum(max(a[k], b[k]) for k in keys)


def brute_classes(rows):
    of = {d: d for d, _ in rows}

    def root(x):
        while of[x] != x:
            x = of[x]
        return x

    bags = {d: bag(t) for d, t in rows}
    for (a, x), (b, y) in itertools.combinations(bags.items(), 2):
        if similar(x, y):
            r, s = sorted((root(a), root(b)))
            of[s] = r
    return {d: root(d) for d in of}


def make_rows(seed, groups=12):
    rng, rows = random.Random(seed), []
    word = lambda: rng.choice("abcdefghijkl") * rng.randrange(1, 4) + str(rng.randrange(50))
    for _ in range(groups):
        base = [word() for _ in range(rng.randrange(1, 120))]
        for _ in range(rng.randrange(1, 9)):
            copy = list(base)
            for _ in range(rng.choice([0, 0, 1, 2, 3])):
                copy[rng.randrange(len(copy))] = word()
            rows.append(" ".join(copy).upper() if rng.random() < 0.3 else "  ".join(copy))
    rows += ["is " * 300, "is " * 310, "is " * 900, "", None, "  ", "\n", "alone"]
    rng.shuffle(rows)
    return list(enumerate(rows, 10))


def test_shingles_are_multisets():
    texts = ["a b c d e f a b c d e", "x", "", "A B", "a b c d e", "is is is is is is is"]
    for text, (hashes, weights) in zip(texts, bm.bags(pa.array(texts)), strict=True):
        assert sorted(weights) == sorted(bag(text).values()) and len(set(hashes)) == len(hashes)


def test_signatures_are_unbiased():
    rng, z = np.random.default_rng(0), []
    for _ in range(40):
        n = rng.integers(2, 60)
        h = np.sort(rng.integers(0, 1 << 63, n).astype(np.uint64))
        a = rng.integers(1, 9, n)
        b = np.where(rng.random(n) < 0.7, a, rng.integers(1, 40, n))
        s = bm.signatures([(h, a), (h, b)], 512)
        j = np.minimum(a, b).sum() / np.maximum(a, b).sum()
        if j < 1:
            z.append(((s[0] == s[1]).mean() - j) / np.sqrt(j * (1 - j) / 512))
    assert abs(np.mean(z)) < 0.5 and np.std(z) < 1.3


def test_signature_does_not_depend_on_company():
    items = bm.bags(pa.array([t for _, t in make_rows(3)]).fill_null(""))
    together = bm.signatures(items)
    for i in (0, 5, 11):
        assert (bm.signatures([items[i]])[0] == together[i]).all()


def test_classes_match_brute_force(spark):
    for seed in (1, 2):
        rows = make_rows(seed)
        df = spark.createDataFrame([(d, t, 1, "x") for d, t in rows], "doc_id long, text string, band int, owner string")
        got = {r.doc: r.class_id for r in bm.near_duplicates(df).collect()}
        assert got == brute_classes(rows)


def test_strays_in_a_bucket_find_each_other(spark, monkeypatch):
    """With one band for all documents every class shares the bucket, so the second round has to find all links."""
    monkeypatch.setattr(bm, "band_keys", lambda signature: np.ones((len(signature), bm.BANDS), np.uint64))
    rows = make_rows(4, 6)
    cloudpickle.register_pickle_by_value(bm)
    try:
        df = spark.createDataFrame(rows, "doc_id long, text string")
        assert {r.doc: r.class_id for r in bm.near_duplicates(df).collect()} == brute_classes(rows)
    finally:
        cloudpickle.unregister_pickle_by_value(bm)


def test_edge_cases(spark):
    schema = "doc_id long, text string"
    assert bm.near_duplicates(spark.createDataFrame([], schema)).count() == 0
    rows = [(None, "a b c d e f"), (3, "a b c d e f"), (1, "a b c d e f"), (1, "a b c d e f"), (4, None), (4, None)]
    got = [tuple(r) for r in bm.near_duplicates(spark.createDataFrame(rows, schema)).collect()]
    assert sorted(got) == [(1, 1), (3, 1), (4, 4)]


def test_components(spark):
    rng = random.Random(2)
    edges = [(i, i + 1) for i in range(100, 140)] + [(5, x) for x in range(6, 60)] + [(rng.randrange(200, 260), rng.randrange(200, 260)) for _ in range(40)]
    of = {v: v for e in edges for v in e if e[0] != e[1]}
    for _ in range(200):
        for a, b in edges:
            if a != b:
                of[a] = of[b] = min(of[a], of[b])
    got = {r.id: r.component for r in components(spark.createDataFrame(edges, "a long, b long"), "t").collect()}
    assert got == of
