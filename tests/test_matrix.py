import numpy as np
import pytest
from pyspark.ml.linalg import Vectors
from pyspark.sql import functions as F

from threadlens.functions.vectors import as_vector
from threadlens.operators import shared_tuning as st
from threadlens.operators.traits import fit_traits
from threadlens.queries import matrix as mx
from threadlens.session import ship_package

SMALL = "/root/testdata/sf0.001"


def test_traits_equal_least_squares(spark):
    rng = np.random.default_rng(2)
    x, w = rng.normal(size=(300, 5)), rng.normal(size=(2, 5))
    y = x @ w.T + [1.0, -2.0]
    rows = [(i, x[i].tolist(), float(y[i, 0]), float(y[i, 1]) if i else None) for i in range(300)]
    df = spark.createDataFrame(rows, "id long, x array<double>, a double, b double").repartition(5)
    df = df.withColumn("features", as_vector(F.col("x")))
    model = fit_traits(df, ["a", "b"])
    assert np.allclose(model.weights[:, :-1], w, atol=1e-6) and np.allclose(model.weights[:, -1], [1.0, -2.0], atol=1e-6)
    got = {r.id: (r.a, r.b) for r in model.transform(df.drop("a", "b")).collect()}
    assert all(got[i] == pytest.approx(tuple(y[i]), abs=1e-5) for i in range(300))
    with pytest.raises(ValueError):
        fit_traits(df.where("id = 0"), ["a", "b"])


def test_sums_of_many_parts_meet_in_a_tree(spark):
    parts = spark.range(0, 150, 1, 150).mapInPandas(
        lambda it: (f.assign(sums=[np.full(3, float(i)).tobytes() for i in f["id"]])[["sums"]] for f in it), "sums binary")
    assert st.tree_sum(parts, 3, fan_in=4).tolist() == [float(sum(range(150)))] * 3


def test_whole_matrix_has_every_group_raw_and_scaled(spark):
    ship_package(spark)
    out = mx.feat_matrix_full(spark, SMALL)
    rows = out.collect()
    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    assert len(rows) == docs.count() == len({r.doc_id for r in rows})
    scalars = [c for c in out.columns if c.startswith("scaled_") and c != "scaled_tfidf"]
    assert {f"scaled_{c}" for c in (*mx.COUNTS, *mx.SEVEN, "gender", "Tone", "negation", "anger")} <= set(scalars)
    for r in rows:
        norm = np.linalg.norm(r.tfidf)
        assert norm == pytest.approx(1.0) or norm == 0.0
        assert all(-1e-9 <= v <= 1 + 1e-9 for v in r.scaled_tfidf)
    for c in scalars:
        raw = np.array([r[c[7:]] if r[c[7:]] is not None else np.nan for r in rows], float)
        low, high = np.nanmin(raw), np.nanmax(raw)
        for r, x in zip(rows, raw, strict=True):
            if np.isnan(x):
                assert r[c] is None or r[c] == 0
            else:
                assert r[c] == pytest.approx((x - low) / (high - low) if high > low else 0.0)


def test_text_traits_explain_unseen_documents(spark):
    ship_package(spark)
    rows = mx.planted(mx.text_features(spark, SMALL).join(spark.read.parquet(f"{SMALL}/labels.parquet").select("doc_id"), "doc_id", "left_anti"),
                      [f"true_{t}" for t in mx.SEVEN])
    both = rows.join(mx.feat_text_traits(spark, SMALL), "doc_id").collect()
    for t in mx.SEVEN:
        true, got = np.array([r[f"true_{t}"] for r in both]), np.array([r[t] for r in both])
        assert 1 - ((true - got) ** 2).sum() / ((true - true.mean()) ** 2).sum() > 0.9


def test_chain_trained_together_equals_label_by_label(spark):
    rng = np.random.default_rng(4)
    x = rng.normal(size=(200, 4))
    a = np.digitize(x[:, 0], [-0.5, 0.5])
    b = (a + (x[:, 1] > 0)) % 3
    rows = [(i, x[i].tolist(), int(a[i]), int(b[i])) for i in range(200)]
    df = spark.createDataFrame(rows, "id long, x array<double>, a int, b int").withColumn("features", as_vector(F.col("x"))).repartition(3)
    chain = st.fit_chain(df, ["a", "b"], tol=1e-7)
    for j, (label, seen) in enumerate((("a", x), ("b", np.hstack([x, a[:, None]])))):
        one = df.withColumn("features", as_vector(F.concat("x", *([F.array(F.col("a").cast("double"))] if j else []))))
        single, _ = st.fit_many(one, [st.Model(1.0, label=label, positive=v) for v in (0.0, 1.0, 2.0)])
        assert np.allclose(single, chain.weights[j], atol=1e-4) and single.shape[1] == seen.shape[1] + 1
    got = {r.id: r for r in chain.transform(df).collect()}
    assert np.mean([got[i].pred_a == a[i] for i in range(200)]) > 0.8
    told = np.array([[*x[i], got[i].pred_a] for i in range(200)])
    margin = told @ chain.weights[1][:, :-1].T + chain.weights[1][:, -1]
    assert all(got[i].pred_b == margin[i].argmax() for i in range(200))


def test_training_rows_keep_stored_entries_only(spark):
    rng = np.random.default_rng(6)
    x = np.where(rng.random((300, 40)) < 0.1, rng.normal(size=(300, 40)), 0.0)
    y, z = (x[:, 0] + x[:, 1] > 0).astype(int), rng.integers(0, 3, 300)
    vector = lambda i: Vectors.dense(x[i]) if i % 7 == 0 else Vectors.sparse(
        40, {int(j): float(x[i, j]) for j in np.flatnonzero(x[i])})
    df = spark.createDataFrame([(vector(i), int(y[i]), int(z[i]), float(i)) for i in range(300)],
                               ["features", "label", "fold", "more"]).repartition(4)
    models = [st.Model(1.0), st.Model(0.1, "fold", 1, leading=40)]
    rows = st.Rows(df, models, ["more"])
    assert rows.width == 42
    stored = sum(len(r.numbers) // 8 for r in rows.data.select("numbers").collect())
    assert stored == sum(40 if i % 7 == 0 else np.count_nonzero(x[i]) for i in range(300)) < 300 * 40 // 2
    sums = rows.passes(lambda v, label, mask: np.concatenate([v.sum(axis=0), label.sum(axis=0), mask.sum(axis=0)]), 46)
    assert np.allclose(sums, [*x.sum(axis=0), sum(range(300)), 300, y.sum(), y.sum(), 300, (z != 1).sum()])
    dense = spark.createDataFrame([(Vectors.dense(x[i]), int(y[i]), int(z[i])) for i in range(300)], ["features", "label", "fold"])
    assert np.allclose(st.fit_many(df, models)[0], st.fit_many(dense, models)[0], atol=1e-5)
    with pytest.raises(Exception, match="no features"):
        st.fit_many(df.withColumn("features", F.when(F.col("more") > 5, F.col("features"))), models)
