import math

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from threadlens.llm import language_id as li
from threadlens.llm import quality as ql
from threadlens.llm.common import crc_fold

SMALL = "/root/testdata/sf0.001"
ODD = [(None, None, "de", 1), (1, "", "en", 2), (2, "12 !! \n", None, 3), (3, "the of and " * 60000, "en", 4),
       (3, "the of and " * 60000, "en", 4), (4, "der die das und ü", "de", 5), (5, "Привет мир 中文字符", None, 6)]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.read.parquet(f"{SMALL}/documents.parquet")


@pytest.fixture(scope="module")
def model(docs):
    return li.fit_language_model(docs, crc_fold(F.col("doc_id"), 4) != 2, per_language=30, landmarks=6)


def grams(text):
    points = li.letters_of(text).tolist()
    return {tuple(points[i:i + n]) for n in li.ORDERS for i in range(len(points) - n + 1)}


def test_presence_equals_sets():
    for text in ["abc abd!!  é", "a", "zzz abc", "ABCabc 1 2", "東京都は日本の首都", "Привет мир", "\U00020000\U00020001 a"]:
        assert len(li.Presence()(text)) == len(grams(text))
    assert len(li.Presence()("1 !")) == 0


def test_letters_of_large_alphabets_stay_apart():
    """Texts that share no letter share no n-gram but the blank, in any script and whatever the corpus holds."""
    presence = li.Presence()
    for a, b in [("東京都日", "本首語文"), ("가나다라", "마바사아"), ("абвг", "деёж")]:
        assert not set(presence(a).tolist()) & set(presence(b).tolist())


def ridge_by_rows(cross, among, target):
    """The regression from explicit Nystrom features."""
    values, vectors = np.linalg.eigh(among)
    keep = values > 1e-8 * values.max()
    root = vectors[:, keep] / np.sqrt(values[keep])
    x = cross @ root
    mean, middle = x.mean(0), target.mean(0)
    inner = (x - mean).T @ (x - mean) + li.RIDGE * len(x) * np.eye(x.shape[1])
    solved = np.linalg.solve(inner, (x - mean).T @ (target - middle))
    return root @ solved, middle - mean @ solved


def test_ridge_from_sums_equals_ridge_from_rows():
    rng = np.random.default_rng(5)
    marks, which = rng.random((12, 6)), rng.integers(0, 3, 40)
    cross, among = rng.random((40, 12)) @ marks, marks.T @ marks
    sums = np.stack([cross[which == i].sum(0) for i in range(3)])
    beta, bias = li.kernel_ridge(cross.T @ cross, sums, np.bincount(which, minlength=3).astype(float), among)
    beta2, bias2 = ridge_by_rows(cross, among, np.where(which[:, None] == np.arange(3), 1.0, -1.0))
    assert np.allclose(cross @ beta + bias, cross @ beta2 + bias2, atol=1e-6)


def test_many_languages(spark):
    """A hundred languages with letters of their own: all told, and the fit gathers sums, not texts."""
    rng = np.random.default_rng(3)
    rows = []
    for i in range(100):
        alphabet = [chr(0x4E00 + 40 * i + j) for j in range(40)]
        rows += [(100 * d + i, "".join(rng.choice(alphabet, 60)), f"l{i:02d}") for d in range(9)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    fitted = li.fit_language_model(docs, F.col("doc_id") < 600, landmarks=3)
    told = li.identify(docs.where("doc_id >= 600"), fitted)
    assert told.where("lang <> lang_pred").count() == 0 and told.count() == 300


def test_scores_equal_explicit_kernels():
    """The folded product gives what kernels against every landmark give."""
    rng = np.random.default_rng(1)
    texts = ["".join(rng.choice(list("abcdefghij "), 80)) for _ in range(30)]
    sets = [grams(t) for t in texts]
    kernel = np.array([[len(a & b) / math.sqrt(len(a) * len(b)) for b in sets] for a in sets])
    target = np.where(rng.random((30, 1)) < 0.5, 1.0, -1.0) * [[1, -1]]
    beta, bias = ridge_by_rows(kernel[:, :8], kernel[:8, :8], target)
    presence = li.Presence()
    numbers = [presence(t) for t in texts]
    vocabulary = np.unique(np.concatenate(numbers[:8]))
    rows = np.full(li.Presence.SIZE, len(vocabulary), np.int32)
    rows[vocabulary] = np.arange(len(vocabulary))
    marks = np.zeros((len(vocabulary) + 1, 8))
    for j in range(8):
        marks[rows[numbers[j]], j] = len(numbers[j]) ** -0.5
    model = li.LanguageModel(["p", "q"], rows, (marks @ beta).astype(np.float32), bias)
    names, scores = model.scorer()(pa.array(texts))
    margins = kernel[:, :8] @ beta + bias
    assert names == [["p", "q"][i] for i in margins.argmax(1)]
    share = np.exp(li.SHARPNESS * margins)
    assert np.allclose(scores, share.max(1) / share.sum(1), atol=1e-4)


def test_languages_held_out(docs, model):
    out = li.identify(docs.where(crc_fold(F.col("doc_id"), 4) == 2), model).toPandas()
    long = out[out.text.str.len() > 60]
    assert (long.lang == long.lang_pred).mean() > 0.95
    assert out.score.between(0, 1).all()


def test_language_edge_cases(spark, model):
    df = spark.createDataFrame(ODD, "doc_id long, text string, lang_pred string, score int")
    out = li.identify(df, model).collect()
    assert df.columns + ["_lang_pred", "_score"] == li.identify(df, model).columns
    assert [r["_lang_pred"] == "und" for r in out] == [True, True, True, False, False, False, False]
    assert out[3]["_lang_pred"] == "en" and out[5]["_lang_pred"] == "de"
    assert li.identify(df.limit(0), model).count() == 0
    none = li.fit_language_model(df.limit(0).withColumn("lang", F.lit("x")), F.lit(True))
    assert none is None and {r["_lang_pred"] for r in li.identify(df, none).collect()} == {"und"}


def test_word_features_against_loops():
    words = ["ab", "abcd", "é", "the"]
    _, owner, _ = ql.word_features(words)
    for i, w in enumerate(words):
        marked = f"\0{w}\0"
        assert (owner == i).sum() == 1 + sum(max(0, len(marked) - n + 1) for n in ql.GRAMS)
    again = ql.word_features(["the"])
    hashes, owner, bucket = ql.word_features(words)
    assert again[0][0] == hashes[3] and sorted(again[2]) == sorted(bucket[owner == 3])


def test_score_equals_mean_of_bags():
    rng = np.random.default_rng(2)
    model = ql.QualityModel(rng.normal(size=ql.BUCKETS), 0.3)
    texts = ["a b b the", "", None, "  ", " lead and trail ", "word " * 50, "über ß"]
    want = []
    for t, (ids, counts) in zip(texts, ql.bags(pa.array([t or "" for t in texts])), strict=True):
        mean = (model.values[ids] * counts).sum() / counts.sum() if len(ids) else 0
        want.append(1 / (1 + math.exp(-mean - 0.3)))
    assert np.allclose(model.score(pa.array(texts)), want)


def test_quality_held_out(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    labels = spark.read.parquet("/root/testdata/sf0.01/labels.parquet")
    fold = crc_fold(F.col("doc_id"), 5)
    model = ql.fit_quality_model(docs, labels.where(fold != 0))
    out = ql.classify(docs.where(fold == 0), model).join(labels, "doc_id").toPandas()
    assert (out.predicted == out.quality).mean() > 0.93


def test_quality_edge_cases(spark):
    df = spark.createDataFrame(ODD, "doc_id long, text string, score string, predicted int")
    labels = spark.createDataFrame([(None, 1), (1, 1), (3, 0), (4, 1), (4, 0), (9, None)], "doc_id long, quality int")
    model = ql.fit_quality_model(df, labels)
    out = ql.classify(df, model)
    assert out.columns == df.columns + ["_score", "_predicted"]
    assert all(0 <= r["_score"] <= 1 for r in out.collect()) and out.count() == len(ODD)
    assert ql.fit_quality_model(df, labels.limit(0)) is None
    assert ql.classify(df.limit(0), model).count() == 0
    assert {r["_score"] for r in ql.classify(df, None).collect()} == {0.5}
