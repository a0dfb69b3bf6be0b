"""Global and per-row explanations of a scorer.

A scorer takes a DataFrame with an array column ``x`` and adds a double column ``score``. Where it can also score a
matrix (``batch_of``), trials are made, scored and added up inside a batch, and only sums leave it.
"""

from __future__ import annotations

import functools
from dataclasses import dataclass
from functools import reduce
from math import factorial

import numpy as np
import pandas as pd
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from threadlens.functions.vectors import as_vector
from threadlens.operators import splits as sp
from threadlens.operators.skew import hash_order
from threadlens.session import scratch_path



def linear_scorer(weights: list[float], intercept: float = 0.0):
    """Weighted sum of the components; zero weights cost nothing and the rest is generated code."""

    def score(df: DataFrame) -> DataFrame:
        terms = [F.get("x", F.lit(j)) * F.lit(float(w)) for j, w in enumerate(weights) if w]
        return df.withColumn("score", reduce(lambda a, b: a + b, terms, F.lit(float(intercept))))

    vector = np.array(weights, dtype=float)
    score.batch = lambda spark: lambda x: x[:, :len(vector)] @ vector + float(intercept)
    return score


def model_scorer(model, output: str = "rawPrediction"):
    """Scores with a fitted MLlib model; the margin or the probability of class 1."""

    def score(df: DataFrame) -> DataFrame:
        scored = model.transform(df.withColumn("features", as_vector(F.col("x"))))
        value = vector_to_array(output)[1] if output in scored.columns else F.col("prediction")
        return scored.withColumn("score", value).select(*df.columns, "score")

    name = type(model).__name__
    if output == "rawPrediction" and name.startswith("GBT"):
        score.batch = lambda spark: functools.partial(_margins, tree_table(spark, model))
    elif output == "rawPrediction" and name in ("LogisticRegressionModel", "LinearSVCModel"):
        weights, intercept = np.array(model.coefficients.toArray()), float(model.intercept)
        score.batch = lambda spark: lambda x: x @ weights + intercept
    return score


def batch_of(scorer, spark):
    """The scorer as a function of a matrix, or None if it only scores tables."""
    return scorer.batch(spark) if hasattr(scorer, "batch") else None


def _matrix(column: pd.Series) -> np.ndarray:
    return np.stack(column.to_numpy()).astype(float)


def replaced(x: Column, position: Column, value: Column) -> Column:
    """The array with one component exchanged; positions start at 0."""
    return F.concat(F.slice(x, F.lit(1), position), F.array(value), F.slice(x, position + 2, F.size(x)))


# ---- permutation importance and partial dependence -------------------------------------------


def permutation_importance(df: DataFrame, scorer, features: list[int], threshold: float = 0.0, seed: int = 7) -> DataFrame:
    """(feature, drop): accuracy lost when one feature takes the value of another row.

    df(id, x, label). Two hash orders of the ids are matched rank by rank, which is a permutation of
    the rows without a global sort.
    """
    size = sp.HASH_RANGE
    here = hash_order(df, [], sp.hash_token(["id"], seed, size), ["id"], size, out="_at")
    there = hash_order(df.select("id", F.col("x").alias("_other")), [], sp.hash_token(["id"], seed + 1, size), ["id"],
                       size, out="_at").drop("id")
    hit = ((F.col("score") > threshold).cast("int") == F.col("label")).cast("double")
    predict = batch_of(scorer, df.sparkSession)
    if predict is not None:
        scores = here.join(there, "_at").select("label", "x", "_other").mapInPandas(
            _permuted_hits(predict, features, threshold), "feature int, hits long, n long").groupBy("feature").agg(
            (F.sum("hits") / F.sum("n")).alias("accuracy"))
        return _dropped(scores)
    names = F.array(*[F.lit(j) for j in [-1, *features]])
    trials = here.join(there, "_at").select("id", "label", "x", "_other", F.explode(names).alias("feature"))
    changed = trials.withColumn("x", F.when(F.col("feature") < 0, F.col("x")).otherwise(
        replaced(F.col("x"), F.col("feature"), F.get("_other", F.col("feature"))))).drop("_other")
    return _dropped(scorer(changed).groupBy("feature").agg(F.avg(hit).alias("accuracy")))


def _dropped(scores: DataFrame) -> DataFrame:
    # one row per feature: the unchanged accuracy is taken from there, so nothing is scored twice
    base = F.max(F.when(F.col("feature") < 0, F.col("accuracy"))).over(Window.partitionBy(F.lit(0)))
    return scores.withColumn("_base", base).where(F.col("feature") >= 0).select(
        "feature", (F.col("_base") - F.col("accuracy")).alias("drop"))


def _permuted_hits(predict, features: list[int], threshold: float):
    """(feature, hits, n) of a batch; feature -1 is the unchanged batch."""

    def run(batches):
        for frame in batches:
            if not len(frame):
                continue
            x, other, label = _matrix(frame["x"]), _matrix(frame["_other"]), frame["label"].to_numpy()
            hits = [int(((predict(x) > threshold) == label).sum())]
            for j in features:
                own = x[:, j].copy()
                x[:, j] = other[:, j]
                hits.append(int(((predict(x) > threshold) == label).sum()))
                x[:, j] = own
            yield pd.DataFrame({"feature": np.array([-1, *features], "int32"), "hits": hits, "n": len(x)})

    return run


def range_grid(df: DataFrame, features: list[int], points: int = 5) -> dict[int, list[float]]:
    """Equally spaced values between the minimum and the maximum of each feature."""
    row = df.agg(*[f(F.get("x", F.lit(j))).alias(f"{f.__name__}{j}") for j in features for f in (F.min, F.max)]).first()
    return {j: [row[f"min{j}"] + (row[f"max{j}"] - row[f"min{j}"]) * i / (points - 1) for i in range(points)]
            for j in features}


def quantile_grid(df: DataFrame, features: list[int], points: int = 10) -> dict[int, list[float]]:
    """Distinct approximate quantiles of each feature."""
    steps = [i / (points - 1) for i in range(points)]
    row = df.agg(*[F.percentile_approx(F.get("x", F.lit(j)), steps).alias(f"q{j}") for j in features]).first()
    return {j: sorted(set(row[f"q{j}"])) for j in features}


def partial_dependence(df: DataFrame, scorer, grid: dict[int, list[float]]) -> DataFrame:
    """(feature, value, mean_score): mean score of all rows when one feature is forced to each grid value."""
    predict = batch_of(scorer, df.sparkSession)
    if predict is not None:
        sums = df.select("x").mapInPandas(_forced_sums(predict, grid), "feature int, point int, value double, total double, n long")
        return sums.groupBy("feature", "point", "value").agg((F.sum("total") / F.sum("n")).alias("mean_score"))
    cells = F.array(*[
        F.struct(F.lit(j).alias("feature"), F.lit(i).alias("point"), F.lit(float(v)).alias("value"))
        for j, values in grid.items() for i, v in enumerate(values)])
    trials = df.select("x", F.explode(cells).alias("c")).select("x", "c.*")
    forced = trials.withColumn("x", replaced(F.col("x"), F.col("feature"), F.col("value")))
    return scorer(forced).groupBy("feature", "point", "value").agg(F.avg("score").alias("mean_score"))


def _forced_sums(predict, grid: dict[int, list[float]]):
    cells = [(j, i, float(v)) for j, values in grid.items() for i, v in enumerate(values)]

    def run(batches):
        for frame in batches:
            if not len(frame):
                continue
            x, totals = _matrix(frame["x"]), []
            for j, _, v in cells:
                own = x[:, j].copy()
                x[:, j] = v
                totals.append(float(predict(x).sum()))
                x[:, j] = own
            out = pd.DataFrame(cells, columns=["feature", "point", "value"]).astype({"feature": "int32", "point": "int32"})
            yield out.assign(total=totals, n=len(x))

    return run


# ---- additive attributions -------------------------------------------------------------------


def mean_vector(df: DataFrame, size: int) -> list[float]:
    row = df.agg(*[F.avg(F.get("x", F.lit(j))).alias(f"m{j}") for j in range(size)]).first()
    return [float(v) for v in row]


def linear_attributions(df: DataFrame, weights: list[float]) -> DataFrame:
    """(id, feature, value, phi) of a linear scorer: weight times the distance from the mean."""
    means = mean_vector(df, len(weights))
    cells = F.transform(
        F.arrays_zip("x", F.array(*[F.lit(float(w)) for w in weights]).alias("w"),
                     F.array(*[F.lit(m) for m in means]).alias("m")),
        lambda c, i: F.struct(i.alias("feature"), c["x"].alias("value"), (c["w"] * (c["x"] - c["m"])).alias("phi")))
    return df.select("id", F.inline(cells))


def global_importance(attributions: DataFrame) -> DataFrame:
    """Mean absolute attribution per feature, largest first."""
    return attributions.groupBy("feature").agg(F.avg(F.abs("phi")).alias("importance")).orderBy(
        F.desc("importance"), "feature")


def dependence(attributions: DataFrame, feature: int) -> DataFrame:
    """(id, value, phi) of one feature."""
    return attributions.where(F.col("feature") == feature).select("id", "value", "phi")


@dataclass(frozen=True)
class TreeTable:
    """Nodes of a tree ensemble as arrays; children are row numbers, -1 at a leaf."""

    feature: np.ndarray
    threshold: np.ndarray
    left: np.ndarray
    right: np.ndarray
    value: np.ndarray
    roots: list[int]
    cover: np.ndarray  # training rows that reached the node, weighted


def tree_table(spark, model) -> TreeTable:
    """Reads the nodes of a saved MLlib tree ensemble. Values carry the tree weights; splits are continuous."""
    path = scratch_path(spark, "trees")
    model.write().overwrite().save(path)
    nodes = spark.read.parquet(f"{path}/data")
    if "nodeData" in nodes.columns:
        nodes = nodes.select("treeID", "nodeData.*")
    else:
        nodes = nodes.withColumn("treeID", F.lit(0))
    rows = nodes.select(
        "treeID", "id", F.col("split.featureIndex").alias("feature"),
        F.get("split.leftCategoriesOrThreshold", F.lit(0)).alias("threshold"), "leftChild", "rightChild",
        "prediction", "impurityStats", "rawCount",
    ).orderBy("treeID", "id").toPandas()  # bounded by the model: at most trees * 2 ** (depth + 1) nodes
    place = {(t, i): n for n, (t, i) in enumerate(zip(rows["treeID"], rows["id"]))}
    child = {side: np.array([place.get((t, c), -1) for t, c in zip(rows["treeID"], rows[side])])
             for side in ("leftChild", "rightChild")}
    weights = list(getattr(model, "treeWeights", [1.0]))
    boosted = type(model).__name__.startswith("GBT")
    if boosted:
        value = rows["prediction"].to_numpy(dtype=float)
    else:
        weights = [1.0 / len(weights)] * len(weights)
        value = np.array([s[1] / max(sum(s), 1e-300) for s in rows["impurityStats"]])
    value = value * np.array([weights[t] for t in rows["treeID"]])
    return TreeTable(rows["feature"].to_numpy(dtype=int), rows["threshold"].fillna(0.0).to_numpy(dtype=float),
                     child["leftChild"], child["rightChild"], value,
                     [place[(t, 0)] for t in sorted(rows["treeID"].unique())],
                     rows["rawCount"].to_numpy(dtype=float))


def _margins(table: TreeTable, x: np.ndarray) -> np.ndarray:
    """Sum of the trees' values for each row of a matrix."""
    total = np.zeros(len(x))
    for root in table.roots:
        node = np.full(len(x), root)
        moving = np.arange(len(x)) if table.left[root] >= 0 else np.zeros(0, int)
        while len(moving):
            at = node[moving]
            node[moving] = np.where(x[moving, table.feature[at]] <= table.threshold[at], table.left[at], table.right[at])
            moving = moving[table.left[node[moving]] >= 0]
        total += table.value[node]
    return total


def _leaves(table: TreeTable):
    """(value, {feature: (low, high)}) of every leaf; a row is in the leaf when low < x <= high throughout."""
    stack = [(root, {}) for root in table.roots]
    while stack:
        node, box = stack.pop()
        if table.left[node] < 0:
            yield float(table.value[node]), box
            continue
        f, t = int(table.feature[node]), float(table.threshold[node])
        low, high = box.get(f, (-np.inf, np.inf))
        stack.append((int(table.left[node]), {**box, f: (low, min(high, t))}))
        stack.append((int(table.right[node]), {**box, f: (max(low, t), high)}))


def _shapley(x: np.ndarray, reference: np.ndarray, leaves) -> np.ndarray:
    """Exact Shapley values of a tree ensemble against one reference row, leaf by leaf.

    On a leaf's path some features admit only the row, some only the reference; the rest admit both
    or neither. The leaf pays out when all of the first kind are taken from the row and all of the
    second from the reference, which fixes the weight of each feature.
    """
    phi = np.zeros_like(x)
    for value, box in leaves:
        if not box:
            continue
        features = list(box)
        low, high = np.array([box[f] for f in features]).T
        mine = (x[:, features] > low) & (x[:, features] <= high)
        theirs = (reference[features] > low) & (reference[features] <= high)
        alive = (mine | theirs).all(axis=1)
        if not alive.any():
            continue
        only_mine, only_theirs = mine & ~theirs, ~mine & theirs
        a, b = only_mine.sum(axis=1), only_theirs.sum(axis=1)
        d = len(features)
        gain = np.array([[factorial(i - 1) * factorial(j) / factorial(i + j) if i else 0.0
                          for j in range(d + 1)] for i in range(d + 1)])
        cost = np.array([[factorial(i) * factorial(j - 1) / factorial(i + j) if j else 0.0
                          for j in range(d + 1)] for i in range(d + 1)])
        part = only_mine * gain[a, b][:, None] - only_theirs * cost[a, b][:, None]
        phi[:, features] += value * part * alive[:, None]
    return phi


def tree_attributions(df: DataFrame, model, reference: list[float]) -> DataFrame:
    """(id, base, phi array): Shapley values of the ensemble's margin; base + sum(phi) is the row's margin."""
    table = tree_table(df.sparkSession, model)
    leaves = list(_leaves(table))
    point = np.array(reference, dtype=float)
    base = sum(v for v, box in leaves if all(lo < point[f] <= hi for f, (lo, hi) in box.items()))

    def run(batches):
        for frame in batches:
            if len(frame):
                x = np.stack(frame["x"].to_numpy())
                yield pd.DataFrame({"id": frame["id"], "base": base, "phi": list(_shapley(x, point, leaves))})

    return df.select("id", "x").mapInPandas(run, "id long, base double, phi array<double>")


def _covered_leaves(table: TreeTable):
    """(value, features, low, high, share) of every leaf: each feature of its path once, with the bounds that it sets and
    the share of the training rows that its splits pass on."""
    stack = [(root, {}) for root in table.roots]
    while stack:
        node, box = stack.pop()
        if table.left[node] < 0:
            features = np.array(list(box), dtype=int)
            low, high, share = np.array(list(box.values()), dtype=float).reshape(-1, 3).T
            yield float(table.value[node]), features, low, high, share
            continue
        f, t = int(table.feature[node]), float(table.threshold[node])
        low, high, share = box.get(f, (-np.inf, np.inf, 1.0))
        for child, lo, hi in ((table.left[node], low, min(high, t)), (table.right[node], max(low, t), high)):
            part = table.cover[child] / table.cover[node]
            stack.append((int(child), {**box, f: (lo, hi, share * part)}))


def _expected_shapley(x: np.ndarray, leaves) -> np.ndarray:
    """Shapley values where features that are not taken from the row follow the training rows of the tree.

    A leaf is worth its value times, for every feature on its path, 1 or 0 if the feature is known (does the row pass?)
    and the passed share if it is not. The product over the other features, as a polynomial in the number of known ones,
    gives all subsets of a size at once, so a leaf of d features takes d * d steps and not 2 ** d.
    """
    phi = np.zeros_like(x)
    for value, features, low, high, share in leaves:
        d = len(features)
        if not d:
            continue
        passes = ((x[:, features] > low) & (x[:, features] <= high)).astype(float)
        weight = np.array([factorial(k) * factorial(d - k - 1) / factorial(d) for k in range(d)])
        for i in range(d):
            sums = np.zeros((len(x), d))
            sums[:, 0] = 1.0
            for g in range(d):
                if g != i:
                    known = sums * passes[:, g][:, None]
                    sums = sums * share[g]
                    sums[:, 1:] += known[:, :-1]
            phi[:, features[i]] += value * (passes[:, i] - share[i]) * (sums @ weight)
    return phi


def expected_attributions(df: DataFrame, model) -> DataFrame:
    """(id, base, phi array): Shapley values of a tree ensemble's margin; base is its expected value over the training
    rows, by the numbers of rows that reached each node, and base + sum(phi) is the row's margin."""
    leaves = list(_covered_leaves(tree_table(df.sparkSession, model)))
    base = float(sum(value * np.prod(share) for value, _, _, _, share in leaves))

    def run(batches):
        for frame in batches:
            if len(frame):
                yield pd.DataFrame({"id": frame["id"], "base": base, "phi": list(_expected_shapley(_matrix(frame["x"]), leaves))})

    return df.select("id", "x").mapInPandas(run, "id long, base double, phi array<double>")


def sampled_attributions(df: DataFrame, scorer, background: list[list[float]], rounds: int = 32, seed: int = 42) -> DataFrame:
    """(id, base, phi array): Shapley values of any scorer that scores a matrix, from ``rounds`` seeded orders of the
    features, each run forwards and backwards; base is the mean score of the background rows (a bounded list), and
    base + sum(phi) is the row's score up to the difference of the background rows drawn.

    Each order starts at a background row and takes the row's features over one by one; a feature gets the changes of
    the score. Orders follow from the seed and the id. Every background row is started from equally often, which makes
    the sum exact when ``rounds`` is a multiple of their number.
    """
    predict = batch_of(scorer, df.sparkSession)
    if predict is None:
        raise ValueError("the scorer cannot score a matrix")
    rows = np.array(background, dtype=float)
    base = float(predict(rows).mean())

    def run(batches):
        for frame in batches:
            for row_id, x in zip(frame["id"], frame["x"]):
                x = np.asarray(x, dtype=float)
                d = len(x)
                rng = np.random.default_rng([seed, int(row_id) & ((1 << 63) - 1)])
                phi = np.zeros(d)
                for r in range(rounds):
                    order = rng.permutation(d)
                    for way in (order, order[::-1]):
                        trial = np.tile(rows[r % len(rows)], (d + 1, 1))
                        for step, j in enumerate(way):
                            trial[step + 1:, j] = x[j]
                        phi[way] += np.diff(predict(trial))
                yield pd.DataFrame({"id": [row_id], "base": [base], "phi": [phi / (2 * rounds)]})

    return df.select("id", "x").mapInPandas(run, "id long, base double, phi array<double>")


def path_contributions(df: DataFrame, model) -> DataFrame:
    """(id, bias, x, contributions): each split's change of the node value goes to its feature; x is the row itself."""
    table = tree_table(df.sparkSession, model)
    bias = float(sum(table.value[r] for r in table.roots))

    def run(batches):
        for frame in batches:
            if not len(frame):
                continue
            x = np.stack(frame["x"].to_numpy())
            out, rows = np.zeros_like(x), np.arange(len(x))
            for root in table.roots:
                node = np.full(len(x), root)
                while True:
                    moving = table.left[node] >= 0
                    if not moving.any():
                        break
                    at, r = node[moving], rows[moving]
                    f = table.feature[at]
                    below = np.where(x[r, f] <= table.threshold[at], table.left[at], table.right[at])
                    np.add.at(out, (r, f), table.value[below] - table.value[at])
                    node[moving] = below
            yield pd.DataFrame({"id": frame["id"], "bias": bias, "x": frame["x"], "contributions": list(out)})

    return df.select("id", "x").mapInPandas(run, "id long, bias double, x array<double>, contributions array<double>")


def long_attributions(df: DataFrame, array: str, out: str = "phi") -> DataFrame:
    others = [c for c in df.columns if c != array]
    return df.select(*others, F.posexplode(array).alias("feature", out))


# ---- local linear explanations ---------------------------------------------------------------


def _perturbed(row_id: int, x, samples: int, scale: float, seed: int) -> np.ndarray:
    """Trials around a row, the row itself first, drawn from a generator seeded by its id."""
    rng = np.random.default_rng([seed, int(row_id) & ((1 << 63) - 1)])
    x = np.asarray(x, dtype=float)
    noise = rng.normal(0.0, scale, (samples, len(x)))
    noise[0] = 0.0
    return x + noise


def _local_fit(x: np.ndarray, y: np.ndarray, scale: float, k: int, ridge: float) -> tuple[np.ndarray, np.ndarray]:
    """(features, weights) of the k strongest in a ridge fit, trials weighted by their nearness to the first."""
    offset = x - x[0]
    width = 0.75 * np.sqrt(x.shape[1]) * scale
    root = np.exp(-(offset ** 2).sum(axis=1) / (2 * width ** 2)) ** 0.5
    a = np.hstack([offset, np.ones((len(y), 1))]) * root[:, None]
    penalty = np.eye(a.shape[1]) * ridge * scale ** 2
    penalty[-1, -1] = 0.0
    coef = np.linalg.solve(a.T @ a + penalty, a.T @ (y * root))[:-1]
    order = np.lexsort((np.arange(len(coef)), -np.abs(coef)))[:k]
    return order, coef[order]


LOCAL = "id long, feature int, weight double, rank int"


def local_linear(df: DataFrame, scorer, samples: int = 200, scale: float = 0.1, k: int = 10, ridge: float = 1e-3,
                 seed: int = 42) -> DataFrame:
    """(id, feature, weight, rank): weighted ridge fit around each row, k strongest features.

    Trials are drawn from a generator seeded by the row id, so a re-run task draws the same. A scorer of matrices scores
    them where they are drawn and no trial leaves the batch; one of tables only needs them as rows, grouped by the id.
    """
    predict = batch_of(scorer, df.sparkSession)

    def found(row_id, features, weights) -> pd.DataFrame:
        return pd.DataFrame({"id": row_id, "feature": features.astype("int32"), "weight": weights,
                             "rank": np.arange(1, len(features) + 1, dtype="int32")})

    if predict is not None:
        def inside(batches):
            for frame in batches:
                for row_id, x in zip(frame["id"], frame["x"]):
                    trials = _perturbed(row_id, x, samples, scale, seed)
                    yield found(row_id, *_local_fit(trials, predict(trials), scale, k, ridge))

        return df.select("id", "x").mapInPandas(inside, LOCAL)

    def perturb(batches):
        for frame in batches:
            for row_id, x in zip(frame["id"], frame["x"]):
                trials = _perturbed(row_id, x, samples, scale, seed)
                yield pd.DataFrame({"id": row_id, "trial": np.arange(samples), "x": list(trials)})

    def fit(frame: pd.DataFrame) -> pd.DataFrame:
        frame = frame.sort_values("trial")
        fitted = _local_fit(np.stack(frame["x"].to_numpy()), frame["score"].to_numpy(), scale, k, ridge)
        return found(frame["id"].iloc[0], *fitted)

    trials = df.select("id", "x").mapInPandas(perturb, "id long, trial int, x array<double>")
    return scorer(trials).groupBy("id").applyInPandas(fit, LOCAL)
