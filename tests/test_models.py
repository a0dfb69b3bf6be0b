import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from threadlens.functions.vectors import as_vector
from threadlens.operators import classifiers as cl
from threadlens.operators import explain as ex
from threadlens.operators import splits as sp


@pytest.fixture(scope="module")
def planted(spark):
    """Eight features; the label follows the first three."""
    rng = np.random.default_rng(5)
    x = rng.normal(size=(400, 8))
    rows = [(i, [float(v) for v in r], int(r[0] + r[1] - r[2] > 0)) for i, r in enumerate(x)]
    df = spark.createDataFrame(rows, "id long, x array<double>, label int").repartition(4).cache()
    df.count()
    return df


def vectors(df):
    return df.select("id", as_vector(F.col("x")).alias("features"), F.col("label").cast("double").alias("label"))


def test_splits_are_stable_under_repartitioning(spark):
    ids = spark.range(2000)
    a = {r.id for r in sp.train_test(ids, ["id"]).where("is_test = 1").collect()}
    b = {r.id for r in sp.train_test(ids.repartition(7), ["id"]).where("is_test = 1").collect()}
    assert a == b and 300 < len(a) < 500


def test_folds_cover_and_balance(spark):
    ids = spark.range(1000).withColumn("label", (F.col("id") % 10 == 0).cast("int"))
    folds = sp.stratified_folds(ids, "label", ["id"], k=10, repeats=2)
    for i in range(2):
        counts = [r["count"] for r in folds.groupBy(f"fold_{i}", "label").count().where("label = 1").collect()]
        assert len(counts) == 10 and max(counts) - min(counts) <= 1
    splits = sp.shuffle_splits(ids, ["id"], 3, 33)
    assert 2 < splits.select("split_0", "split_1", "split_2").distinct().count() <= 8


@pytest.mark.parametrize("name, params", [
    ("logistic", {"c": 1.0}), ("svm_linear", {"c": 1.0}), ("random_forest", {"numTrees": 20, "maxDepth": 5}),
    ("gradient_boosting", {"maxIter": 10, "maxDepth": 3, "stepSize": 0.3}),
    ("neural_network", {"hidden": (8,), "maxIter": 40}), ("svm_rbf", {"c": 10.0, "gamma": 0.1, "maxIter": 20}),
    ("svm_poly", {"c": 1.0, "degree": 2, "maxIter": 20}),
])
def test_classifiers_beat_the_majority(planted, name, params):
    data = sp.train_test(vectors(planted), ["id"])
    test = data.where("is_test = 1")
    share = test.agg(F.avg("label")).first()[0]
    score = cl.accuracy_of(cl.fit(name, data.where("is_test = 0"), **params), test)
    assert score > max(share, 1 - share) + 0.1


@pytest.mark.parametrize("name, params", [("svm_rbf", {"gamma": 0.1, "maxIter": 5}), ("logistic", {"maxIter": 5}),
                                          ("naive_bayes", {}), ("svm_poly", {"degree": 2, "maxIter": 5})])
def test_saved_models_score_as_before(planted, tmp_path, name, params):
    from pyspark.ml import PipelineModel

    data = vectors(planted).withColumn("features", positive("features")) if name == "naive_bayes" else vectors(planted)
    fitted = cl.fit(name, data, **params)
    fitted.model.write().overwrite().save(str(tmp_path / name))
    again = cl.Fitted(name, PipelineModel.load(str(tmp_path / name)))
    before, after = (cl.predictions(f, data, ["id"]).orderBy("id").collect() for f in (fitted, again))
    assert before == after and len(before) == data.count()
    assert all((r.proba is None) == name.startswith("svm") for r in after)


def positive(column):
    from threadlens.functions.vectors import as_vector

    return as_vector(F.transform(cl.vector_to_array(F.col(column)), lambda v: F.abs(v)))


def test_classifiers_are_compared_reported_and_saved(spark, planted, tmp_path):
    data = vectors(planted)
    searches, best, rows = cl.compare_classifiers(data, ["id"], {"knn": {"n_neighbors": [1, 5]}, "logistic": {"c": [0.1, 1.0]}},
                                                  folds=2, cv=3)
    assert len(searches["knn"].rows) == 2 and all(0.5 < r[2] <= 1 for r in searches["knn"].rows)
    report = {r.classifier: r for r in spark.createDataFrame(rows, cl.REPORT_SCHEMA).collect()}
    assert sorted(r["rank"] for r in report.values()) == [1, 2]
    assert report[best.name].cv_accuracy == max(r.cv_accuracy for r in report.values()) and report[best.name]["rank"] == 1
    for r in report.values():
        hits = r.recall_1 * r.support_1 + r.recall_0 * r.support_0
        assert r.test_accuracy == pytest.approx(hits / (r.support_1 + r.support_0))
    knn = cl.fit("knn", data, n_neighbors=1)
    knn.save(str(tmp_path / "knn"))
    again = cl.predictions(cl.Fitted.load(spark, "knn", str(tmp_path / "knn")), data, ["id"])
    assert again.where("label <> prediction").count() == 0


def test_models_trained_together_equal_single_fits(planted):
    from threadlens.operators import shared_tuning as st

    tagged = sp.k_folds(vectors(planted), ["id"], 2).cache()
    models = [st.Model(0.1), st.Model(1.0, "fold", 0), st.Model(5.0, "fold", 1)]
    weights, counts = st.fit_many(tagged, models)
    for model, w, n in zip(models, weights, counts, strict=True):
        train = tagged if model.column is None else tagged.where(F.col(model.column) != model.value)
        single = cl.fit("logistic", train, c=model.c, maxIter=500).model.stages[0]
        assert np.allclose(single.coefficients.toArray(), w[:-1], atol=2e-3) and single.intercept == pytest.approx(w[-1], abs=2e-3)
        rows = [(r.features.toArray(), r.label) for r in train.collect()]
        p = np.array([1 / (1 + np.exp(-(x @ w[:-1] + w[-1]))) for x, _ in rows]) - np.array([y for _, y in rows])
        slope = np.array([x for x, _ in rows]).T @ p + w[:-1] / model.c
        assert np.abs(slope).max() < 1e-4 and abs(p.sum()) < 1e-4
        assert n[:4].sum() == len(rows) and n.sum() == 400
    alone, _ = st.fit_many(tagged, models[1:2])
    assert np.allclose(alone[0], weights[1], atol=1e-6)


def test_unknown_names_are_errors(planted):
    with pytest.raises(KeyError):
        cl.fit("KNN-typo", vectors(planted))
    with pytest.raises(KeyError):
        cl.compare_classifiers(vectors(planted), ["id"], {"typo": {"c": [1]}})


def test_grid_and_draws():
    assert len(cl.expand_grid(cl.GRIDS["logistic"])) == 10 and len(cl.NEIGHBOURS) == 70
    drawn = cl.draw_grid({"a": list(range(20)), "b": list(range(20))})
    assert len(drawn) == 50 and len({tuple(d.values()) for d in drawn}) == 50
    assert len(cl.draw_grid({"a": [1, 2]})) == 2


def test_select_best_tie_rules():
    scores = [("a", 0.7), ("b", 0.7), ("c", 0.6)]
    assert cl.select_best(scores)[0] == "b" and cl.select_best(scores, last_wins=False)[0] == "a"


def test_search_picks_the_table_maximum(planted, spark):
    found = cl.grid_search("logistic", vectors(planted), ["id"], {"c": [0.001, 1.0]}, n_splits=2)
    assert found.fitted.name == "logistic"
    assert found.best_score == max(r[2] for r in found.rows)
    assert found.table(spark).count() == 2


def test_elimination_keeps_the_signal(planted):
    kept = cl.eliminate_features(vectors(planted), keep=3)
    assert len(kept) == 3 and set(kept) == {0, 1, 2}


def test_learning_curve_rises(planted):
    rows = cl.learning_curve("logistic", vectors(planted), ["id"], fractions=(0.1, 1.0), n_splits=2, maxIter=10)
    assert len(rows) == 2 and rows[1][4] >= rows[0][4]


def test_chain_reads_earlier_predictions(spark, planted):
    base = vectors(planted).withColumn("a", F.col("label")).withColumn("b", 1 - F.col("label"))
    chain = cl.fit_chain(base.select("features", "a", "b"), ["a", "b"], max_iter=5)
    scored = chain.transform(base)
    assert chain.models[1].models[0].numFeatures == 9
    assert scored.where(F.col("pred_b") == 1 - F.col("pred_a")).count() > 380


def test_single_class_and_weights(spark):
    df = spark.createDataFrame([("x", 1), ("x", 1), ("y", 0), ("y", 1)], "g string, label int")
    assert {r.g: r.constant_label for r in cl.single_class_label(df, ["g"]).collect()} == {"x": 1, "y": None}
    assert {r.label: r.weight for r in cl.class_weights(df).collect()} == {0: 2.0, 1: pytest.approx(4 / 6)}


def brute_force(x, ids, q, k):
    d = np.sqrt(((x - q) ** 2).sum(axis=1))
    return [ids[i] for i in np.lexsort((ids, d))[:k]]


def test_neighbours_equal_brute_force(spark, planted):
    """Noise visits many cells; the second set has a hot cluster, copies and far outliers."""
    rng = np.random.default_rng(3)
    hot = np.vstack([rng.normal(0, 0.01, (200, 3)), np.ones((20, 3)), rng.normal(50, 5, (30, 3))])
    clustered = spark.createDataFrame(
        [(i, [float(v) for v in r], i % 2) for i, r in enumerate(hot)], "id long, x array<double>, label int")
    for df in (planted, clustered):
        rows = df.orderBy("id").collect()
        x, ids = np.array([r.x for r in rows if r.id % 8]), np.array([r.id for r in rows if r.id % 8])
        queries = df.where("id % 8 = 0").select(F.col("id").alias("query_id"), "x")
        train = df.where("id % 8 <> 0").select(F.col("id").alias("train_id"), "label", "x")
        near = cl.nearest_neighbours(queries, train, k=5, pivots=12, block=50, query_block=20)
        found = near.groupBy("query_id").agg(F.sort_array(F.collect_list(F.struct("rank", "train_id"))).alias("n")).collect()
        assert len(found) == queries.count()
        for q in found:
            assert [n.train_id for n in q.n] == brute_force(x, ids, np.array(rows[q.query_id].x), 5)
    tie = spark.createDataFrame([(1, 0, 1), (1, 1, 2)], "query_id long, label int, rank int")
    assert cl.vote(tie).first().prediction == 0


def boosted(planted):
    from pyspark.ml.classification import GBTClassifier

    return GBTClassifier(maxIter=5, maxDepth=3, seed=1).fit(vectors(planted))


def test_tree_attributions_add_up_and_match_enumeration(planted):
    from itertools import permutations

    model = boosted(planted)
    margins = {r.id: r.score for r in ex.model_scorer(model)(planted).collect()}
    reference = ex.mean_vector(planted, 8)
    out = {r.id: r for r in ex.tree_attributions(planted, model, reference).collect()}
    assert all(abs(r.base + sum(r.phi) - margins[i]) < 1e-9 for i, r in out.items())
    # against all orders of the three features that matter most, other features kept at the row's values
    table = ex.tree_table(planted.sparkSession, model)
    leaves = list(ex._leaves(table))

    def margin(v):
        return sum(val for val, box in leaves if all(lo < v[f] <= hi for f, (lo, hi) in box.items()))

    row = planted.where("id = 3").first()
    used = sorted({f for _, box in leaves for f in box})
    if len(used) <= 7:
        phi = np.zeros(8)
        orders = list(permutations(used))
        for order in orders:
            v = np.array(reference)
            before = margin(v)
            for f in order:
                v[f] = row.x[f]
                phi[f] += margin(v) - before
                before = margin(v)
        assert np.allclose(phi / len(orders), out[3].phi, atol=1e-9)


def test_path_contributions_add_up(planted):
    model = boosted(planted)
    margins = {r.id: r.score for r in ex.model_scorer(model)(planted).collect()}
    for r in ex.path_contributions(planted, model).collect():
        assert r.bias + sum(r.contributions) == pytest.approx(margins[r.id])


def test_permutation_ranks_the_planted_features_first(planted):
    scorer = ex.linear_scorer([1.0, 1.0, -1.0] + [0.0] * 5)
    drops = {r.feature: r["drop"] for r in ex.permutation_importance(planted, scorer, list(range(8))).collect()}
    assert min(drops[j] for j in range(3)) > 0.1
    assert all(drops[j] == 0 for j in range(3, 8))


def test_partial_dependence_of_a_linear_scorer_is_linear(planted):
    curve = ex.partial_dependence(planted, ex.linear_scorer([2.0] + [0.5] * 7), ex.quantile_grid(planted, [0], 5))
    points = curve.orderBy("value").collect()
    slopes = np.diff([p.mean_score for p in points]) / np.diff([p.value for p in points])
    assert np.allclose(slopes, 2.0)


def test_local_linear_recovers_coefficients(planted):
    weights = [3.0, -2.0, 1.0, 0.0, 0.0, 0.0, 0.0, 0.5]
    few = planted.where("id < 3")
    got = {(r.id, r.feature): r.weight for r in ex.local_linear(few, ex.linear_scorer(weights), samples=100, k=3).collect()}
    for i in range(3):
        assert got[(i, 0)] == pytest.approx(3.0, abs=0.05) and got[(i, 1)] == pytest.approx(-2.0, abs=0.05)


def test_expected_attributions_match_enumeration(planted):
    from itertools import permutations

    model = boosted(planted)
    margins = {r.id: r.score for r in ex.model_scorer(model)(planted).collect()}
    out = {r.id: r for r in ex.expected_attributions(planted, model).collect()}
    assert all(abs(r.base + sum(r.phi) - margins[i]) < 1e-9 for i, r in out.items())
    table = ex.tree_table(planted.sparkSession, model)

    def value(node, x, known):
        if table.left[node] < 0:
            return table.value[node]
        f, sides = table.feature[node], (table.left[node], table.right[node])
        if f in known:
            return value(sides[int(x[f] > table.threshold[node])], x, known)
        return sum(value(s, x, known) * table.cover[s] / table.cover[node] for s in sides)

    total = lambda x, known: sum(value(r, x, known) for r in table.roots)
    used = sorted({int(f) for f, left in zip(table.feature, table.left, strict=True) if left >= 0})
    orders = list(permutations(used)) if len(used) <= 5 else None
    for i in (0, 3):
        x = planted.where(F.col("id") == i).first().x
        assert out[i].base == pytest.approx(total(x, set()))
        sets = [(tuple(used[:k]), used[k]) for k in range(len(used))] if orders is None else None
        if orders:
            phi = np.zeros(8)
            for order in orders:
                for k, f in enumerate(order):
                    phi[f] += total(x, set(order[:k + 1])) - total(x, set(order[:k]))
            assert np.allclose(phi / len(orders), out[i].phi, atol=1e-9)
        else:
            from itertools import combinations
            from math import factorial

            d = len(used)
            for f in used:
                rest = [g for g in used if g != f]
                want = sum(factorial(k) * factorial(d - k - 1) / factorial(d) * (total(x, {*s, f}) - total(x, set(s)))
                           for k in range(d) for s in combinations(rest, k))
                assert out[i].phi[f] == pytest.approx(want, abs=1e-9)
            assert sets


def test_sampled_attributions_are_exact_for_a_linear_scorer(planted):
    weights = [3.0, -2.0, 1.0, 0.0, 0.0, 0.0, 0.0, 0.5]
    background = [[0.0] * 8, [1.0] * 8]
    rows = ex.sampled_attributions(planted.where("id < 5"), ex.linear_scorer(weights), background, rounds=4).collect()
    x = {r.id: r.x for r in planted.where("id < 5").collect()}
    for r in rows:
        assert r.base == pytest.approx(sum(weights) / 2)
        assert r.phi == pytest.approx([w * (v - 0.5) for w, v in zip(weights, x[r.id], strict=True)])
    with pytest.raises(ValueError):
        ex.sampled_attributions(planted, lambda df: df, background)


def test_trials_inside_the_batch_equal_trials_as_rows(planted):
    scorer = ex.model_scorer(boosted(planted))
    as_rows = lambda df: scorer(df)
    few = planted.where("id < 40")
    features = [0, 1, 5]
    for explain in (lambda s: ex.permutation_importance(few, s, features).orderBy("feature"),
                    lambda s: ex.partial_dependence(few, s, ex.range_grid(few, features, 3)).orderBy("feature", "point"),
                    lambda s: ex.local_linear(few.where("id < 4"), s, samples=50, k=3).orderBy("id", "rank")):
        inside, outside = explain(scorer).collect(), explain(as_rows).collect()
        assert len(inside) == len(outside) > 0
        for a, b in zip(inside, outside, strict=True):
            assert tuple(a) == pytest.approx(tuple(b), abs=1e-9)
    plan = ex.local_linear(few, scorer)._jdf.queryExecution().executedPlan().toString()
    assert "hashpartitioning" not in plan


# ---- sketched polynomial kernels --------------------------------------------------------------


@pytest.mark.parametrize("degree", [2, 3])
def test_sketched_kernel_is_unbiased_within_its_bound(spark, degree):
    rng = np.random.default_rng(2)
    x = rng.normal(size=(12, 6)) / 3
    df = spark.createDataFrame([(i, [float(v) for v in r]) for i, r in enumerate(x)], "id long, x array<double>")
    rows = df.select("id", as_vector(F.col("x")).alias("features"))
    exact = (x @ x.T + 1) ** degree
    size, runs = 512, []
    for seed in range(12):
        out = cl.TensorSketch(degree=degree, dim=6, size=size, seed=seed).transform(rows).orderBy("id").collect()
        z = np.stack([r.sketched.toArray() for r in out])
        runs.append(z @ z.T)
    spread = np.sqrt((3 ** degree - 1) / size * np.outer(np.diag(exact), np.diag(exact)))
    assert (np.abs(np.array(runs) - exact) < 5 * spread).all()
    assert (np.abs(np.mean(runs, axis=0) - exact) < 5 * spread / np.sqrt(len(runs))).all()


def test_wide_polynomial_kernels_are_sketched(spark, tmp_path):
    """A thousand features at degree 3 would be 180 million monomials."""
    rng = np.random.default_rng(4)
    x = np.where(rng.random((300, 1024)) < 0.02, 1.0, 0.0)
    x[:, :2] = rng.choice([-2.0, 2.0], (300, 2))
    rows = [(i, [float(v) for v in r], float(r[0] * r[1] > 0)) for i, r in enumerate(x)]
    df = spark.createDataFrame(rows, "id long, x array<double>, label double").select(
        "id", as_vector(F.col("x")).alias("features"), "label").cache()
    fitted = cl.fit("svm_poly", df, degree=3, c=1.0, maxIter=20)
    assert isinstance(fitted.model.stages[0], cl.TensorSketch)
    assert cl.accuracy_of(fitted, df) > 0.9
    fitted.save(str(tmp_path / "m"))
    again = cl.Fitted.load(spark, "svm_poly", str(tmp_path / "m"))
    assert again.transform(df).select("id", "prediction").exceptAll(fitted.transform(df).select("id", "prediction")).isEmpty()
    assert not isinstance(cl.make("svm_poly", 10, 64, degree=2).getStages()[0], cl.TensorSketch)


def test_sketched_rows_leave_in_blocks():
    rng = np.random.default_rng(3)
    rows = pd.Series(list(rng.normal(size=(1300, 5))))
    column, sign = rng.integers(0, 64, (3, 6)), rng.choice([-1.0, 1.0], (3, 6))
    blocks = list(cl._sketched(iter([rows]), column, sign, 64))
    assert [len(b) for b in blocks] == [512, 512, 276]
    alone = next(cl._sketched(iter([rows.iloc[600:601]]), column, sign, 64)).iloc[0]
    assert np.allclose(blocks[1].iloc[88], alone)


def test_neighbour_search_holds_blocks_of_rows():
    batches = iter([pd.Series(list(np.ones((600, 3)))), pd.Series(list(np.ones((10, 3))))])
    assert [x.shape for x in cl._in_blocks(batches)] == [(256, 3), (256, 3), (88, 3), (10, 3)]
