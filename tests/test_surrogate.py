import numpy as np
import pytest
from pyspark.sql import functions as F

from threadlens.operators import sparse_logistic as sl
from threadlens.operators import surrogate as sg


def dense_minimum(x, y, weight):
    """Plain Newton steps on the dense matrix."""
    z = np.hstack([x, np.ones((len(y), 1))])
    penalty = np.diag([1.0] * x.shape[1] + [0.0])
    theta = np.zeros(z.shape[1])
    for _ in range(60):
        p = 1 / (1 + np.exp(-(z @ theta)))
        gradient = z.T @ (weight * (p - y)) + penalty @ theta
        theta = theta - np.linalg.lstsq((z * (weight * p * (1 - p))[:, None]).T @ z + penalty, gradient, rcond=None)[0]
    return theta[:-1], theta[-1]


def problem(rng, n, m):
    x = np.where(rng.random((n, m)) < 0.3, rng.normal(size=(n, m)), 0.0)
    x[0] = 0.0
    y = (x[:, 0] + 0.3 * rng.normal(size=n) > 0).astype(float)
    return x, y, rng.uniform(0.5, 2.0, n)


def test_local_fit_reaches_the_minimum():
    for seed, n, m in ((0, 40, 90), (1, 200, 12)):
        x, y, w = problem(np.random.default_rng(seed), n, m)
        at = np.nonzero(x)
        coef, intercept, gradient = sl.fit_local(*at, x[at], m, y, w)
        want = dense_minimum(x, y, w)
        assert np.allclose(coef, want[0], atol=1e-6) and intercept == pytest.approx(want[1], abs=1e-6) and gradient < 1e-8


def test_fit_as_tables_equals_the_local_fit(spark):
    rng = np.random.default_rng(3)
    rows, entries, want = [], [], {}
    for key, n, m in (("a", 30, 6), ("b", 12, 15)):
        x, y, w = problem(rng, n, m)
        y[:2] = [0, 1]
        rows += [(key, i, float(y[i]), float(w[i])) for i in range(n)]
        entries += [(key, int(i), f"t{j:02}", float(x[i, j])) for i, j in zip(*np.nonzero(x), strict=True)]
        want[key] = dense_minimum(x, y, w)
    out = sl.fit_distributed(spark.createDataFrame(entries, "key string, row long, term string, value double"),
                             spark.createDataFrame(rows, "key string, row long, y double, weight double")).collect()
    for r in out:
        coef, intercept = want[r.key]
        assert r.beta == pytest.approx(intercept if r.term == sl.INTERCEPT else coef[int(r.term[1:])], abs=1e-6)
        assert r.gradient < 1e-6
    assert {r.key for r in out} == set(want)


def test_threads_of_any_size_have_the_same_surrogates(spark):
    rng = np.random.default_rng(5)
    posts, weights = [], []
    for thread, n in ((1, 80), (2, 9)):
        for pos in range(n + 1):
            posts.append((thread, pos, int(rng.random() < 0.4) if pos > 1 else pos))
            for t in set(rng.integers(0, 20, rng.integers(0, 6)).tolist()):
                weights.append((thread, pos, f"w{t}", float(rng.random())))
    posts = spark.createDataFrame(posts, "thread_id long, pos long, label int")
    weights = spark.createDataFrame(weights, "thread_id long, pos long, term string, weight double")
    small = {r.thread_id: r for r in sg.thread_surrogates(posts, weights).collect()}
    mixed = {r.thread_id: r for r in sg.thread_surrogates(posts, weights, local_entries=60).collect()}
    assert set(small) == set(mixed) == {1, 2}
    for thread, a in small.items():
        b = mixed[thread]
        assert b.margin == pytest.approx(a.margin, abs=1e-6) and b.surrogate_label == a.surrogate_label
        assert [w.word for w in a.words] == [w.word for w in b.words]
        assert [w.contribution for w in a.words] == pytest.approx([w.contribution for w in b.words], abs=1e-6)
    assert sg.thread_surrogates(posts.where(F.col("pos") == 0), weights).count() == 0


def test_models_fitted_together_equal_those_fitted_alone():
    rng = np.random.default_rng(8)
    parts, rows, terms, want = [], 0, 0, []
    for model, (n, m) in enumerate(((40, 25), (3, 2), (120, 7), (2, 0))):
        x, y, w = problem(rng, n, m + 1)
        x[:, m:] = 0.0
        y[:2] = [0, 1]
        at = np.nonzero(x[:, :m])
        parts.append((np.full(n, model), np.full(m, model), at[0] + rows, at[1] + terms, x[at], y, w))
        want.append(dense_minimum(x[:, :m], y, w))
        rows, terms = rows + n, terms + m
    coef, intercept, gradient = sl.fit_together(*[np.concatenate(c) for c in zip(*parts, strict=True)], models=4)
    assert np.allclose(coef, np.concatenate([c for c, _ in want]), atol=1e-6)
    assert np.allclose(intercept, [b for _, b in want], atol=1e-6) and (gradient < 1e-8).all()


def test_small_threads_share_calls(spark):
    """Forty threads come in few blocks, and a block of its own changes no thread."""
    posts = spark.createDataFrame([(t, p, (t + p) % 2) for t in range(40) for p in range(5)], "thread_id long, pos long, label int")
    weights = spark.createDataFrame([(t, p, f"w{(t * p) % 7}", 0.5 + p) for t in range(40) for p in range(5)],
                                    "thread_id long, pos long, term string, weight double")
    rows = posts.join(weights, ["thread_id", "pos"]).toPandas()
    whole = sg._explain_block(rows).set_index("thread_id")
    for thread, part in rows.groupby("thread_id"):
        alone = sg._explain_block(part).iloc[0]
        assert alone.margin == pytest.approx(whole.loc[thread].margin, abs=1e-7)
        assert [w["word"] for w in alone.words] == [w["word"] for w in whole.loc[thread].words]
    got = {r.thread_id: r.margin for r in sg.thread_surrogates(posts, weights).collect()}
    assert got == pytest.approx(whole.margin.to_dict(), abs=1e-7) and len(got) == 40
