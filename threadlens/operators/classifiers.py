"""Classifiers, their parameter grids, tuning and selection on top of MLlib."""

from __future__ import annotations

import itertools
import math
import random
import time
from collections.abc import Iterator
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass, field
from functools import reduce

import numpy as np
import pandas as pd
from pyspark import keyword_only
from pyspark.ml import Pipeline, PipelineModel, Transformer
from pyspark.ml.classification import (
    DecisionTreeClassifier, GBTClassifier, LinearSVC, LogisticRegression, MultilayerPerceptronClassifier, NaiveBayes,
    OneVsRest, RandomForestClassifier,
)
from pyspark.ml.feature import PolynomialExpansion, VectorAssembler, VectorSlicer
from pyspark.ml.functions import vector_to_array
from pyspark.ml.param import Param, Params, TypeConverters
from pyspark.ml.param.shared import HasInputCol, HasOutputCol
from pyspark.ml.util import DefaultParamsReadable, DefaultParamsWritable
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from threadlens.functions.vectors import as_vector
from threadlens.operators import splits as sp
from threadlens.operators.deep_forest import DeepForest
from threadlens.operators.shared_tuning import Model, fit_many
from threadlens.operators.shared_tuning import scores as count_scores
from threadlens.operators.skew import top_k
from threadlens.session import materialize

# Search spaces.
TENTHS = [round(0.1 * i, 1) for i in range(1, 11)]
NEIGHBOURS = [int(x) for x in np.linspace(1, 100, 70)]
GRIDS = {
    "naive_bayes": {"smoothing": [0.0, 1.0], "fit_prior": [True, False]},
    "logistic": {"c": TENTHS},
    "svm_poly": {"c": [0.0001, 0.001, 0.01], "degree": [1, 2, 3]},
    "svm_rbf": {"c": [0.0001, 0.001, 0.01], "gamma": [0.1, 1.0, 10.0]},
    "random_forest": {"numTrees": [200], "maxDepth": [10, 20, 30], "minInstancesPerNode": [1, 2, 4]},
    "gradient_boosting": {"maxIter": [800], "stepSize": [0.1], "subsamplingRate": [0.5], "maxDepth": [10, 20, 30],
                          "minInstancesPerNode": [1, 2, 4]},
    "neural_network": {"hidden": [(100, 100, 100), (50, 50), (100,)], "maxIter": [200]},
    "knn": {"n_neighbors": NEIGHBOURS},
}
#: Spaces of the random search, in MLlib's parameters. Depths above 30 and without a limit are 30; the smallest node to
#: split has no equal and is left out; solvers of the logistic model reach the same minimum.
RANDOM_SPACES = {
    "knn": {"n_neighbors": NEIGHBOURS},
    "naive_bayes": {"smoothing": [0.0, 1.0], "fit_prior": [True, False]},
    "logistic": {"c": TENTHS, "solver": ["liblinear", "newton-cg", "sag", "saga", "lbfgs"]},
    "svm": {"c": [0.0001, 0.001, 0.01], "kernel": ["linear", "rbf", "poly"], "gamma": [0.0001, 0.001, 0.01, 0.1, 1, 10, 100],
            "degree": [1, 2, 3, 4, 5], "probability": [True, False]},
    "random_forest": {"numTrees": [200, 450, 700, 950, 1200], "featureSubsetStrategy": ["auto", "sqrt"],
                      "maxDepth": [20, 30], "minInstancesPerNode": [1, 2, 4], "bootstrap": [True, False]},
    "gradient_boosting": {"maxIter": [200, 800], "featureSubsetStrategy": ["all", "sqrt"], "maxDepth": [10, 30],
                          "minInstancesPerNode": [1, 2, 4], "stepSize": [0.1, 0.5], "subsamplingRate": [0.5, 1.0]},
    "neural_network": {"hidden": [(100, 100, 100), (50, 50), (100,)], "solver": ["gd", "l-bfgs"], "maxIter": [200]},
}
RANDOM_DRAWS = 50
#: Pivots of the neighbour search, which every task holds.
MAX_PIVOTS = 2048
#: Rows whose distances to all pivots are held at once.
NEIGHBOUR_ROWS = 256
#: Monomials up to which polynomial kernels are expanded; wider ones are sketched.
MAX_EXPANDED = 16384
#: Nodes, at most as many as rows in each tree, up to which MLlib's random forest is used.
MAX_FOREST_NODES = 1 << 20
#: Rows that are sketched at once.
SKETCH_ROWS = 512


def expand_grid(grid: dict[str, list]) -> list[dict]:
    names = list(grid)
    return [dict(zip(names, values)) for values in itertools.product(*grid.values())]


def draw_grid(grid: dict[str, list], draws: int = RANDOM_DRAWS, seed: int = 42) -> list[dict]:
    """Distinct random candidates; a grid smaller than the number of draws is taken whole."""
    candidates = expand_grid(grid)
    return candidates if len(candidates) <= draws else random.Random(seed).sample(candidates, draws)


# ---- estimators ------------------------------------------------------------------------------


class RandomFourierFeatures(Transformer, HasInputCol, HasOutputCol, DefaultParamsReadable, DefaultParamsWritable):
    """Cosine features whose inner products approximate exp(-gamma * squared distance).

    A pipeline stage: its weights follow from its parameters, so a saved pipeline scores as the fitted one does.
    """

    gamma = Param(Params._dummy(), "gamma", "width of the kernel", TypeConverters.toFloat)
    dim = Param(Params._dummy(), "dim", "number of input features", TypeConverters.toInt)
    size = Param(Params._dummy(), "size", "number of cosine features", TypeConverters.toInt)
    seed = Param(Params._dummy(), "seed", "seed of the weights", TypeConverters.toInt)

    @keyword_only
    def __init__(self, *, gamma=1.0, dim=1, size=256, seed=42, inputCol="features", outputCol="rff"):
        super().__init__()
        self._set(**self._input_kwargs)
        self._setDefault(gamma=1.0, dim=1, size=256, seed=42, inputCol="features", outputCol="rff")

    def _transform(self, df: DataFrame) -> DataFrame:
        gamma, dim, size = (self.getOrDefault(p) for p in (self.gamma, self.dim, self.size))
        rng = np.random.default_rng(self.getOrDefault(self.seed))
        weights = rng.normal(0.0, np.sqrt(2 * gamma), (dim, size))
        shift = rng.uniform(0.0, 2 * np.pi, size)
        scale = np.sqrt(2.0 / size)

        @F.pandas_udf("array<double>")
        def project(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
            for x in batches:
                for start in range(0, len(x), SKETCH_ROWS):
                    rows = np.stack(x.iloc[start:start + SKETCH_ROWS].to_numpy())
                    yield pd.Series(list(scale * np.cos(rows @ weights + shift)))

        return df.withColumn(self.getOutputCol(), as_vector(project(vector_to_array(F.col(self.getInputCol())))))


def _sketched(batches: Iterator[pd.Series], column: np.ndarray, sign: np.ndarray, size: int) -> Iterator[pd.Series]:
    """Tensor sketches of the rows of each batch. Rows leave as soon as they are done, so a task holds SKETCH_ROWS of them,
    however large its batches."""
    # rows of each sketch ordered by column, so that a column is the sum of one run
    order = np.argsort(column, axis=1, kind="stable")
    for x in batches:
        for start in range(0, len(x), SKETCH_ROWS):
            rows = np.stack(x.iloc[start:start + SKETCH_ROWS].to_numpy())
            rows = np.hstack([rows, np.ones((len(rows), 1))])
            product = 1.0
            for d in range(len(column)):
                own = column[d, order[d]]
                first = np.flatnonzero(np.concatenate([[True], own[1:] != own[:-1]]))
                counts = np.zeros((len(rows), size))
                counts[:, own[first]] = np.add.reduceat((rows * sign[d])[:, order[d]], first, axis=1)
                product = product * np.fft.rfft(counts, axis=1)
            yield pd.Series(list(np.fft.irfft(product, size, axis=1)))


class TensorSketch(Transformer, HasInputCol, HasOutputCol, DefaultParamsReadable, DefaultParamsWritable):
    """Features whose inner products are unbiased estimates of (x . y + 1) ** degree, in ``size`` columns for any width.

    Each of ``degree`` count sketches adds every input feature, with a random sign, to a random column; their circular
    convolution, a product after the Fourier transform, is the count sketch of the tensor power. The variance of an
    inner product is at most (3 ** degree - 1) / size times the kernel's values of x and of y with themselves. The
    hashes follow from the parameters, so a saved pipeline scores as the fitted one does.
    """

    degree = Param(Params._dummy(), "degree", "power of the kernel", TypeConverters.toInt)
    dim = Param(Params._dummy(), "dim", "number of input features", TypeConverters.toInt)
    size = Param(Params._dummy(), "size", "number of columns", TypeConverters.toInt)
    seed = Param(Params._dummy(), "seed", "seed of the hashes", TypeConverters.toInt)

    @keyword_only
    def __init__(self, *, degree=2, dim=1, size=2048, seed=42, inputCol="features", outputCol="sketched"):
        super().__init__()
        self._set(**self._input_kwargs)
        self._setDefault(degree=2, dim=1, size=2048, seed=42, inputCol="features", outputCol="sketched")

    def _transform(self, df: DataFrame) -> DataFrame:
        degree, dim, size = (self.getOrDefault(p) for p in (self.degree, self.dim, self.size))
        rng = np.random.default_rng(self.getOrDefault(self.seed))
        column = rng.integers(0, size, (degree, dim + 1))
        sign = rng.choice([-1.0, 1.0], (degree, dim + 1))

        @F.pandas_udf("array<double>")
        def sketch(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
            yield from _sketched(batches, column, sign, size)

        return df.withColumn(self.getOutputCol(), as_vector(sketch(vector_to_array(F.col(self.getInputCol())))))


class NeighbourModel:
    """Votes of the k nearest training rows; scores like an MLlib model."""

    def __init__(self, train: DataFrame, k: int):
        self.train = materialize(
            train.select(F.monotonically_increasing_id().alias("train_id"), F.col("label").cast("int").alias("label"),
                         vector_to_array("features").alias("x")), "neighbours")
        self.k = k

    def save(self, path: str) -> None:
        """The training rows under path, k beside them."""
        self.train.write.mode("overwrite").parquet(f"{path}/rows")
        self.train.sparkSession.createDataFrame([(self.k,)], "k int").write.mode("overwrite").parquet(f"{path}/k")

    @classmethod
    def load(cls, spark, path: str) -> NeighbourModel:
        self = cls.__new__(cls)
        self.train, self.k = spark.read.parquet(f"{path}/rows"), spark.read.parquet(f"{path}/k").first()["k"]
        return self

    def transform(self, df: DataFrame) -> DataFrame:
        rows = materialize(df.withColumn("_query", F.monotonically_increasing_id()), "neighbour-queries")
        near = nearest_neighbours(rows.select(F.col("_query").alias("query_id"), vector_to_array("features").alias("x")),
                                  self.train, self.k)
        share = near.groupBy("query_id").agg(F.avg((F.col("label") == 1).cast("double")).alias("_share"))
        voted = vote(near).join(share, "query_id").select(
            F.col("query_id").alias("_query"), F.col("prediction").cast("double").alias("prediction"),
            as_vector(F.array(1 - F.col("_share"), F.col("_share"))).alias("probability"))
        return rows.join(voted, "_query").drop("_query")


def make(name: str, n_rows: int, n_features: int, **p) -> Pipeline:
    """A pipeline for a registered name. ``c`` is the inverse penalty summed over rows; MLlib averages over rows."""
    c = p.get("c", 1.0)
    cols = {"featuresCol": "features", "labelCol": "label"}
    if name == "svm":
        name = f"svm_{p.get('kernel', 'rbf')}"
    if name == "logistic":
        stages = [LogisticRegression(regParam=1.0 / (c * n_rows), elasticNetParam=0.0, standardization=False,
                                     maxIter=p.get("maxIter", 100), **cols)]
    elif name in ("svm_linear", "svm_poly", "svm_rbf"):
        svc = LinearSVC(regParam=1.0 / (c * n_rows), standardization=False, maxIter=p.get("maxIter", 50), **cols)
        degree = p.get("degree", 1) if name == "svm_poly" else 1
        stages = [svc]
        if degree > 1:
            svc = svc.copy({svc.featuresCol: "expanded"})
            # monomials of degree 1 to `degree`; beyond the bound the kernel is sketched
            wide = math.comb(n_features + degree, degree) - 1 > p.get("max_expanded", MAX_EXPANDED)
            stages = [TensorSketch(degree=degree, dim=n_features, size=p.get("sketch_size", 2048), outputCol="expanded")
                      if wide else PolynomialExpansion(degree=degree, inputCol="features", outputCol="expanded"), svc]
        elif name == "svm_rbf":
            stages = [RandomFourierFeatures(gamma=p.get("gamma", 1.0), dim=n_features), svc.copy({svc.featuresCol: "rff"})]
    elif name == "random_forest":
        own = {"numTrees": p.get("numTrees", 200), "maxDepth": p.get("maxDepth", 10),
               "bootstrap": p.get("bootstrap", True), "minInstancesPerNode": p.get("minInstancesPerNode", 2),
               "featureSubsetStrategy": p.get("featureSubsetStrategy", "sqrt"), "seed": 42}
        # MLlib moves a histogram for every node; beyond the bound small nodes are finished where their rows are
        many = own["numTrees"] * min(2 ** own["maxDepth"], n_rows) > p.get("max_nodes", MAX_FOREST_NODES)
        stages = [DeepForest(**own) if many else RandomForestClassifier(**own, **cols)]
    elif name == "gradient_boosting":
        stages = [GBTClassifier(
            maxIter=p.get("maxIter", 800), maxDepth=p.get("maxDepth", 5), stepSize=p.get("stepSize", 0.1),
            subsamplingRate=p.get("subsamplingRate", 0.5), minInstancesPerNode=p.get("minInstancesPerNode", 2),
            featureSubsetStrategy=p.get("featureSubsetStrategy", "sqrt"), seed=42, **cols)]
    elif name == "naive_bayes":
        prior = {} if p.get("fit_prior", True) else {"weightCol": "balance"}
        stages = [NaiveBayes(modelType="multinomial", smoothing=p.get("smoothing", 1.0), **prior, **cols)]
    elif name == "neural_network":
        layers = [n_features, *p.get("hidden", (100,)), 2]
        stages = [MultilayerPerceptronClassifier(layers=layers, maxIter=p.get("maxIter", 200),
                                                 solver=p.get("solver", "l-bfgs"), seed=42, **cols)]
    elif name == "decision_tree":
        stages = [DecisionTreeClassifier(maxDepth=p.get("maxDepth", 10), seed=42, **cols)]
    else:
        raise KeyError(f"unknown classifier: {name}")
    return Pipeline(stages=stages)


def class_weights(df: DataFrame, label: str = "label") -> DataFrame:
    """(label, weight) with weight n / (k * n_label)."""
    counts = df.groupBy(label).agg(F.count("*").alias("n"))
    totals = counts.agg(F.struct(F.sum("n").alias("n"), F.count("*").alias("k")).alias("t")).scalar()
    return counts.withColumn("_t", totals).select(
        label, (F.col("_t.n") / (F.col("_t.k") * F.col("n"))).alias("weight"))


def with_balance(df: DataFrame, label: str = "label") -> DataFrame:
    """Adds the class weight as column balance: a look-up in a map with one entry per class, so no row is moved."""
    entries = class_weights(df, label).agg(F.map_from_entries(F.collect_list(F.struct(label, "weight")))).scalar()
    return df.withColumn("balance", F.element_at(entries, F.col(label)))


@dataclass(frozen=True)
class Fitted:
    name: str
    model: PipelineModel | NeighbourModel

    def transform(self, df: DataFrame) -> DataFrame:
        return self.model.transform(df)

    def save(self, path: str) -> None:
        """Any model under path; ``load`` gives it back."""
        if isinstance(self.model, NeighbourModel):
            self.model.save(path)
        else:
            self.model.write().overwrite().save(path)

    @classmethod
    def load(cls, spark, name: str, path: str) -> Fitted:
        return cls(name, NeighbourModel.load(spark, path) if name == "knn" else PipelineModel.load(path))


def fit(name: str, train: DataFrame, n_rows: int | None = None, n_features: int | None = None, **params) -> Fitted:
    n_rows = n_rows or train.count()
    n_features = n_features or len(train.first()["features"])
    if name == "knn":
        return Fitted(name, NeighbourModel(train, params.get("n_neighbors", 5)))
    if name == "naive_bayes" and not params.get("fit_prior", True):
        train = with_balance(train)
    return Fitted(name, make(name, n_rows, n_features, **params).fit(train))


def predictions(fitted: Fitted, df: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, label, prediction, proba): proba is P(1), or null for a model without one."""
    scored = fitted.transform(df)
    proba = vector_to_array("probability")[1] if "probability" in scored.columns else F.lit(None).cast("double")
    kept = keys + (["label"] if "label" in df.columns else [])
    return scored.select(*kept, F.col("prediction").cast("int").alias("prediction"), proba.alias("proba"))


def accuracy_of(fitted: Fitted, df: DataFrame) -> float:
    scored = fitted.transform(df)
    return scored.agg(F.avg((F.col("label") == F.col("prediction")).cast("double"))).first()[0] or 0.0


# ---- tuning ----------------------------------------------------------------------------------


@dataclass
class Search:
    """Scores of every candidate and split, and the winner."""

    name: str
    rows: list[tuple] = field(default_factory=list)
    best: dict = field(default_factory=dict)
    best_score: float = 0.0
    fitted: Fitted | None = None  # the winner, refitted on all rows

    def table(self, spark) -> DataFrame:
        return spark.createDataFrame(self.rows, "position int, params string, mean double, std double")


def search(name: str, df: DataFrame, candidates: list[dict], split_columns: list[tuple[str, int]],
           parallelism: int = 4) -> Search:
    """Score each candidate on each split; a split is (column, value) and its rows with that value are the test side.

    Logistic models are trained together, one pass over the rows per step for all candidates and splits. Fits of other
    classifiers are distributed MLlib jobs; ``parallelism`` of them are submitted at a time.
    """
    if name == "logistic":
        return _searched(name, candidates, shared_scores(df, candidates, split_columns)["accuracy"])
    df = df.persist()
    width = len(df.first()["features"])
    sides = []
    for column, value in split_columns:
        train, test = df.where(F.col(column) != value), df.where(F.col(column) == value)
        sides.append((train, test, train.count()))

    def run(job):
        candidate, (train, test, n) = job
        return accuracy_of(fit(name, train, n, width, **candidate), test)

    with ThreadPoolExecutor(parallelism) as pool:
        scores = list(pool.map(run, [(c, s) for c in candidates for s in sides]))
    df.unpersist()
    return _searched(name, candidates, np.array(scores).reshape(len(candidates), len(sides)))


def shared_scores(df: DataFrame, candidates: list[dict], split_columns: list[tuple[str, int]]) -> dict[str, np.ndarray]:
    """Test scores (candidate, split) of logistic models; candidates with the same penalty are one model."""
    penalties = sorted({float(c.get("c", 1.0)) for c in candidates})
    models = [Model(c, column, value) for c in penalties for column, value in split_columns]
    _, counts = fit_many(df, models, rounds=100, tol=1e-5)
    at = [penalties.index(float(c.get("c", 1.0))) for c in candidates]
    return {n: s.reshape(len(penalties), len(split_columns))[at] for n, s in count_scores(counts[:, 4:]).items()}


def _searched(name: str, candidates: list[dict], scores: np.ndarray) -> Search:
    result = Search(name)
    for i, candidate in enumerate(candidates):
        own = scores[i]
        result.rows.append((i, repr(candidate), float(np.mean(own)), float(np.std(own))))
    top = max(result.rows, key=lambda r: (r[2], -r[0]))
    result.best, result.best_score = candidates[top[0]], top[2]
    return result


def grid_search(name: str, df: DataFrame, unique: list[str], grid: dict | None = None, n_splits: int = 3,
                test_percent: int = 33, seed: int = 42) -> Search:
    """Every candidate on independent random splits; the winner is refitted on all rows."""
    tagged = sp.shuffle_splits(df, unique, n_splits, test_percent, seed)
    found = search(name, tagged, expand_grid(grid or GRIDS[name]), [(f"split_{i}", 1) for i in range(n_splits)])
    found.fitted = fit(name, df, **found.best)
    return found


def random_search(name: str, df: DataFrame, unique: list[str], grid: dict | None = None, draws: int = RANDOM_DRAWS,
                  folds: int = 3, seed: int = 42) -> Search:
    """Random distinct candidates on k folds; the winner is refitted on all rows."""
    tagged = sp.k_folds(df, unique, folds, seed)
    found = search(name, tagged, draw_grid(grid or RANDOM_SPACES[name], draws, seed), [("fold", i) for i in range(folds)])
    found.fitted = fit(name, df, **found.best)
    return found


def select_best(scores: list[tuple[str, float]], last_wins: bool = True) -> tuple[str, float]:
    """Best name; on a tie the last candidate, or the first."""
    best = ("", 0.0)
    for name, score in scores:
        if score > best[1] or (last_wins and score == best[1]):
            best = (name, score)
    return best


def cross_validate(name: str, df: DataFrame, unique: list[str], params: dict, folds: int = 10, seed: int = 7,
                   parallelism: int = 4) -> dict[str, float]:
    """Mean accuracy, precision, recall and F1 of class 1 over the folds."""
    tagged = sp.k_folds(df, unique, folds, seed)
    sides = [("fold", i) for i in range(folds)]
    if name == "logistic":
        return {n: float(s.mean()) for n, s in shared_scores(tagged, [params], sides).items()}
    tagged = tagged.persist()
    width = len(tagged.first()["features"])

    def run(i: int) -> list[float]:
        train = tagged.where(F.col("fold") != i)
        return confusion(fit(name, train, train.count(), width, **params), tagged.where(F.col("fold") == i))

    with ThreadPoolExecutor(parallelism) as pool:
        counts = np.array(list(pool.map(run, range(folds))))
    tagged.unpersist()
    return {n: float(s.mean()) for n, s in count_scores(counts).items()}


def confusion(fitted: Fitted, df: DataFrame) -> list[float]:
    """True and false positives, true and false negatives."""
    guess, true = F.col("prediction") > 0.5, F.col("label") > 0.5
    cells = [guess & true, guess & ~true, ~guess & ~true, ~guess & true]
    return [float(v) for v in fitted.transform(df).agg(*[F.count_if(c).alias(f"n{i}") for i, c in enumerate(cells)]).first()]


REPORT_SCHEMA = ("classifier string, params string, search_score double, train_accuracy double, test_accuracy double, "
                 "precision_1 double, recall_1 double, f1_1 double, precision_0 double, recall_0 double, f1_0 double, "
                 "support_1 long, support_0 long, cv_accuracy double, cv_precision double, cv_recall double, cv_f1 double, rank int")


def compare_classifiers(df: DataFrame, unique: list[str], grids: dict[str, dict | None], folds: int = 3, seed: int = 42,
                        cv: int = 10, test_percent: int = 20) -> tuple[dict[str, Search], Fitted, list[tuple]]:
    """Tune each named classifier on the training side, report it, rank all by the mean accuracy of ``cv`` folds over all
    rows, and refit the best (the last of equals) on all rows. Returns searches, the refitted model and rows of
    REPORT_SCHEMA. A grid of None is the name's random-search space."""
    known = [n for n in grids if n not in RANDOM_SPACES and n not in GRIDS and grids[n] is None]
    known += [n for n in grids if n not in RANDOM_SPACES and n not in GRIDS and n not in ("svm_linear", "decision_tree")]
    if known:
        raise KeyError(f"unknown classifiers: {known}")
    tagged = sp.train_test(df, unique, test_percent, seed)
    train, test = tagged.where("is_test = 0"), tagged.where("is_test = 1")
    searches, rows = {}, []
    for name, grid in grids.items():
        found = searches[name] = random_search(name, train, unique, grid, folds=folds, seed=seed)
        seen, told = confusion(found.fitted, train), confusion(found.fitted, test)
        one, zero = (count_scores(np.array([c])) for c in (told, [told[2], told[3], told[0], told[1]]))
        means = cross_validate(name, df, unique, found.best, cv, seed)
        rows.append((name, repr(found.best), found.best_score, float(count_scores(np.array([seen]))["accuracy"][0]),
                     float(one["accuracy"][0]), *[float(x[n][0]) for x in (one, zero) for n in ("precision", "recall", "f1")],
                     int(told[0] + told[3]), int(told[1] + told[2]), *[means[n] for n in ("accuracy", "precision", "recall", "f1")]))
    order = sorted(range(len(rows)), key=lambda i: (-rows[i][13], -i))
    ranked = [(*row, order.index(i) + 1) for i, row in enumerate(rows)]
    best, _ = select_best([(r[0], r[13]) for r in rows])
    return searches, fit(best, df, **searches[best].best), ranked


# ---- feature elimination, learning curves, chains -------------------------------------------


def eliminate_features(df: DataFrame, keep: int, step: int = 1, max_depth: int = 10) -> list[int]:
    """Indices that survive when the least important features of a decision tree go, ``step`` per round."""
    df = df.select("features", "label").persist()
    left = list(range(len(df.first()["features"])))
    while len(left) > keep:
        sliced = VectorSlicer(inputCol="features", outputCol="sliced", indices=left).transform(df)
        tree = DecisionTreeClassifier(featuresCol="sliced", labelCol="label", maxDepth=max_depth, seed=42).fit(sliced)
        importance = tree.featureImportances.toArray()
        gone = set(np.argsort(importance, kind="stable")[:min(step, len(left) - keep)].tolist())
        left = [f for i, f in enumerate(left) if i not in gone]
    df.unpersist()
    return left


def learning_curve(name: str, df: DataFrame, unique: list[str], fractions=(0.1, 0.325, 0.55, 0.775, 1.0),
                   n_splits: int = 3, test_percent: int = 20, seed: int = 0, **params) -> list[tuple]:
    """(fraction, rows, mean and deviation of train score, test score and fit seconds)."""
    tagged = sp.shuffle_splits(df, unique, n_splits, test_percent, seed).withColumn(
        "_share", sp.hash_token(unique, seed + 1000)).persist()
    width, out = len(tagged.first()["features"]), []
    for fraction in fractions:
        trains, tests, seconds, sizes = [], [], [], []
        for i in range(n_splits):
            train = tagged.where((F.col(f"split_{i}") == 0) & (F.col("_share") < int(sp.HASH_RANGE * fraction)))
            rows, start = train.count(), time.time()
            fitted = fit(name, train, rows, width, **params)
            seconds.append(time.time() - start)
            sizes.append(rows)
            trains.append(accuracy_of(fitted, train))
            tests.append(accuracy_of(fitted, tagged.where(F.col(f"split_{i}") == 1)))
        out.append((float(fraction), int(np.mean(sizes)), float(np.mean(trains)), float(np.std(trains)),
                    float(np.mean(tests)), float(np.std(tests)), float(np.mean(seconds)), float(np.std(seconds))))
    tagged.unpersist()
    return out


LEARNING_CURVE_SCHEMA = ("fraction double, n_rows int, train_mean double, train_std double, test_mean double, "
                         "test_std double, fit_seconds_mean double, fit_seconds_std double")


@dataclass(frozen=True)
class Chain:
    """One multi-class model per label column; model j sees the features and labels before j."""

    labels: list[str]
    models: list

    def transform(self, df: DataFrame) -> DataFrame:
        for j, (label, model) in enumerate(zip(self.labels, self.models)):
            earlier = [f"pred_{c}" for c in self.labels[:j]]
            ready = VectorAssembler(inputCols=["features"] + earlier, outputCol="chained").transform(df)
            df = model.transform(ready).drop("chained", "rawPrediction").withColumnRenamed("prediction", f"pred_{label}")
        return df


def fit_chain(df: DataFrame, labels: list[str], max_iter: int = 20) -> Chain:
    """Trains on the true earlier labels; prediction feeds the predicted ones."""
    df, models = df.persist(), []
    for j, label in enumerate(labels):
        ready = VectorAssembler(inputCols=["features"] + labels[:j], outputCol="chained").transform(df)
        svc = LinearSVC(featuresCol="chained", maxIter=max_iter)
        models.append(OneVsRest(classifier=svc, featuresCol="chained", labelCol=label).fit(ready))
    df.unpersist()
    return Chain(labels, models)


# ---- rules and counts ------------------------------------------------------------------------


def single_class_label(df: DataFrame, keys: list[str], label: str = "label") -> DataFrame:
    """Per group: the label to predict when all training labels agree, else null."""
    return df.groupBy(*keys).agg(
        F.when(F.min(label) == F.max(label), F.min(label)).alias("constant_label"), F.count("*").alias("n"))


def naive_bayes_counts(occurrences: DataFrame, alpha: float = 1.0, classes=(0, 1)) -> DataFrame:
    """log P(term | class) from occurrences (label, term, tf).

    Occurrences are summed per term in one aggregate and written once; the rest works on that table, whose size is the
    vocabulary's. Labels belong to the documents before these are cut into terms, so terms are never joined.
    """
    by_term = materialize(
        occurrences.groupBy("term").agg(
            *[F.sum(F.when(F.col("label") == c, F.col("tf")).otherwise(0)).alias(f"n_{c}") for c in classes]),
        "term-counts")
    totals = by_term.agg(F.struct(
        F.count("*").alias("v"), *[F.sum(f"n_{c}").alias(f"n_{c}") for c in classes]).alias("t")).scalar()
    tagged = by_term.withColumn("_t", totals)
    cells = F.array(*[
        F.struct(F.lit(c).alias("label"),
                 F.log((F.col(f"n_{c}") + alpha) / (F.col(f"_t.n_{c}") + alpha * F.col("_t.v"))).alias("log_likelihood"))
        for c in classes])
    return tagged.select("term", F.inline(cells))


# ---- exact nearest neighbours ---------------------------------------------------------------


def _distances(x: np.ndarray, points: np.ndarray) -> np.ndarray:
    """Distances from plain differences; the expanded square would lose the digits the bounds rest on."""
    return np.stack([np.sqrt(((x - p) ** 2).sum(axis=1)) for p in points], axis=1)


def _in_blocks(batches: Iterator[pd.Series]) -> Iterator[np.ndarray]:
    """The vectors of all batches, NEIGHBOUR_ROWS at a time: what a task holds follows from the pivots, not the batches."""
    for x in batches:
        for start in range(0, len(x), NEIGHBOUR_ROWS):
            yield np.stack(x.iloc[start:start + NEIGHBOUR_ROWS].to_numpy())


def nearest_neighbours(queries: DataFrame, train: DataFrame, k: int = 5, pivots: int | None = None, block: int = 4096,
                       query_block: int = 16384) -> DataFrame:
    """(query_id, train_id, label, distance, rank): the exact k nearest rows, ties by id.

    queries(query_id, x), train(train_id, label, x). Training rows belong to the cell of their
    nearest pivot. A query's k-th distance is at most the k-th smallest of (distance to a pivot +
    distance of one of that cell's first members to it), and by the triangle inequality it visits
    only cells that can hold something nearer. Large cells and large query sets are cut into
    blocks by hash; a task compares one block with one block in numpy and returns k rows per query.
    A block of training rows goes only to the query blocks that ask for it. There are about as many
    pivots as the root of the training rows, at most MAX_PIVOTS. On rows without clusters most cells
    stay open and the work is quadratic.
    """
    pivots = pivots or int(min(MAX_PIVOTS, max(8, train.count() ** 0.5)))
    chosen = train.orderBy(F.xxhash64("train_id"), "train_id").limit(pivots).select("x").collect()
    centres = np.array([r["x"] for r in chosen], dtype=float)
    q_blocks = max(1, -(-queries.count() // query_block))

    @F.pandas_udf("cell int, reach double")
    def assign(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for x in _in_blocks(batches):
            d = _distances(x, centres)
            yield pd.DataFrame({"cell": d.argmin(axis=1).astype("int32"), "reach": d.min(axis=1)})

    cells = materialize(train.withColumn("_a", assign("x")).select("train_id", "label", "x", "_a.*"), "cells")
    stats = cells.groupBy("cell").agg(F.max("reach").alias("radius"), F.count("*").alias("n")).orderBy("cell").collect()
    first = top_k(cells.select("cell", "reach", "train_id"), ["cell"], [F.col("reach"), F.col("train_id")], k,
                  ["train_id"]).select("cell", "reach").collect()
    ids = np.array([r["cell"] for r in stats])
    radius = np.array([r["radius"] for r in stats])
    parts = {r["cell"]: -(-r["n"] // block) for r in stats}
    near_cell, near_reach = np.array([r["cell"] for r in first]), np.array([r["reach"] for r in first])

    # one number for each part of each cell
    owner = np.repeat(np.arange(len(ids)), [parts[int(c)] for c in ids])
    codes = np.array([int(c) << 32 | p for c in ids for p in range(parts[int(c)])], np.int64)

    @F.pandas_udf("array<long>")
    def visits(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for x in _in_blocks(batches):
            d = _distances(x, centres)
            upper = d[:, near_cell] + near_reach
            bound = np.partition(upper, k - 1, axis=1)[:, k - 1] if upper.shape[1] >= k else np.full(len(d), np.inf)
            open_cells = d[:, ids] - radius <= (bound + 1e-6 * (1.0 + bound))[:, None]
            yield pd.Series([codes[row[owner]] for row in open_cells])

    q = queries.select(
        "query_id", F.col("x").alias("qx"), F.pmod(F.xxhash64("query_id"), F.lit(q_blocks)).cast("int").alias("qb"),
        F.explode(visits("x")).alias("_code")).select(
        "query_id", "qx", "qb", F.shiftright("_code", 32).cast("int").alias("cell"),
        F.col("_code").bitwiseAND(F.lit((1 << 32) - 1)).cast("int").alias("part"))
    # at most `pivots` rows, so the broadcast is bounded
    sizes = F.broadcast(train.sparkSession.createDataFrame(list(parts.items()), "cell int, parts long"))
    # aliases give the right side attributes of its own when both inputs share a lineage
    t = cells.join(sizes, "cell").select(
        F.col("train_id").alias("near_id"), F.col("label").alias("near_label"), F.col("x").alias("tx"),
        F.col("cell").alias("cell2"), F.pmod(F.xxhash64("train_id"), F.col("parts")).cast("int").alias("part2"))
    asked = q.select(F.col("cell").alias("cell2"), F.col("part").alias("part2"), F.col("qb").alias("qb2")).distinct()
    t = t.join(asked, ["cell2", "part2"])

    def closest(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        columns = ["query_id", "train_id", "label", "distance"]
        if left.empty or right.empty:
            return pd.DataFrame(columns=columns)
        a, b = np.stack(left["qx"].to_numpy()), np.stack(right["tx"].to_numpy())
        near_ids, labels = right["near_id"].to_numpy(), right["near_label"].to_numpy()
        count = min(k, len(b))
        chosen, values = np.empty((len(a), count), np.int64), np.empty((len(a), count))
        for i, row in enumerate(a):
            distance = np.sqrt(((b - row) ** 2).sum(axis=1))
            chosen[i] = np.lexsort((near_ids, distance))[:count]
            values[i] = distance[chosen[i]]
        flat = chosen.ravel()
        return pd.DataFrame({"query_id": np.repeat(left["query_id"].to_numpy(), count), "train_id": near_ids[flat],
                             "label": labels[flat], "distance": values.ravel()})[columns]

    schema = "query_id long, train_id long, label int, distance double"
    candidates = q.groupBy("cell", "part", "qb").cogroup(t.groupBy("cell2", "part2", "qb2")).applyInPandas(closest, schema)
    return top_k(candidates, ["query_id"], [F.col("distance"), F.col("train_id")], k, ["train_id"])


def vote(neighbours: DataFrame) -> DataFrame:
    """Most frequent label among the neighbours; the smallest label wins a tie."""
    votes = neighbours.groupBy("query_id", "label").agg(F.count("*").alias("n"))
    return votes.groupBy("query_id").agg(F.max_by("label", F.struct("n", -F.col("label"))).alias("prediction"))


def stack(tables: list[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, tables)
