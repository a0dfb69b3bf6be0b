from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from threadlens.operators import features as ft
from threadlens.operators import term_counts as tc


@pytest.fixture(scope="module")
def texts(spark):
    rng = np.random.default_rng(5)
    lists = [[f"w{i}" for i in rng.integers(0, 12, n)] for n in rng.integers(0, 40, 60)] + [None, [], ["w1"]]
    return lists, spark.createDataFrame([(x,) for x in lists], "_tokens array<string>").repartition(3)


def plain(lists, sizes, known):
    tf, df = Counter(), Counter()
    for words in lists:
        grams = [w[i:i + n] for w in [words or []] for n in sizes for i in range(len(w) - n + 1)]
        grams = [" ".join(g) for g in grams if known.issuperset(g)]
        tf.update(grams)
        df.update(set(grams))
    return {t: (tf[t], df[t]) for t in tf}


def told(table):
    return {r.term: (r.tf, r.df) for r in table.collect()}


def test_counts_equal_plain_counts(texts, monkeypatch):
    lists, tokens = texts
    assert told(tc.word_counts(tokens)) == plain(lists, [1], {f"w{i}" for i in range(12)})
    known = [f"w{i}" for i in range(9)]
    want = plain(lists, [2, 3, 4], set(known))
    assert told(tc.gram_counts(tokens, known, [2, 3, 4], 0, 0)) == want
    monkeypatch.setattr(tc, "BLOCK_TOKENS", 7)
    assert told(tc.gram_counts(tokens, known, [2, 3, 4], 0, 0)) == want
    frequent = told(tc.gram_counts(tokens, known, [2, 3, 4], 5, 1 << 18))
    assert {t: c for t, c in want.items() if c[1] >= 5}.items() <= frequent.items() <= want.items()


def test_n_grams_of_words_outside_the_vocabulary_are_not_built(spark):
    df = spark.createDataFrame([("aa bb cc aa bb",)], "t string")
    grams = ft.with_grams(df, "t", 1, 2, None, words=["aa", "bb"]).first()["_grams"]
    assert sorted(grams) == ["aa", "aa", "aa bb", "aa bb", "bb", "bb"]
    model = ft.TfIdf(["aa bb", "bb"], [1.0, 1.0], 1, 2, [])
    seen = model.counts(df.select(F.lit("aa bb cc aa bb").alias("t")), "t", "v").first()["v"]
    assert list(seen.toArray()) == [2.0, 2.0]
