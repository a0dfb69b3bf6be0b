"""Logistic models of many candidates and folds, trained together: one pass over the rows per step for all of them.

Every model has its penalty and its training rows (all, or those outside a fold). A batch of rows meets the weights of
all models in one matrix product, and rows of a model's test side have weight 0 there. Losses and gradients are added up
in the task, then in a tree, and the driver, which holds one weight vector per model, takes the quasi-Newton steps.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from threadlens.session import materialize

#: Partial sums that one task of the tree adds up.
FAN_IN = 64
#: Pairs of steps and gradient changes that direct the next step.
MEMORY = 10
#: Rows that meet the weights at once.
ROWS = 2048


@dataclass(frozen=True)
class Model:
    """c is the inverse penalty summed over the training rows: those whose ``column`` is not ``value``; all without one.
    The model tells whether ``label`` is ``positive``, from the first ``leading`` features; from all without a number."""

    c: float
    column: str | None = None
    value: int = 0
    label: str = "label"
    positive: float = 1.0
    leading: int | None = None


def tree_sum(parts: DataFrame, width: int, fan_in: int = FAN_IN, finish: Callable | None = None) -> np.ndarray:
    """Sum of the arrays of float64 bytes in the column ``sums``; the driver receives at most ``fan_in`` of them.

    With ``finish`` the last sum is made in a task as well, and the driver receives finish(sum) alone.
    """

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = None
        for batch in batches:
            for x in batch.column(0):
                own = np.frombuffer(x.as_py(), np.float64)
                total = own.copy() if total is None else total + own
        if total is not None:
            yield pa.RecordBatch.from_arrays([pa.array([total.tobytes()], pa.binary())], names=["sums"])

    n = parts.rdd.getNumPartitions()
    if n > fan_in:
        parts = materialize(parts, "partial-sums")
    while n > fan_in:
        n = -(-n // fan_in)
        parts = parts.repartition(n).mapInArrow(add, "sums binary")
    if finish is not None:
        def last(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in add(batches):
                done = finish(np.frombuffer(batch.column(0)[0].as_py(), np.float64))
                yield pa.RecordBatch.from_arrays([pa.array([done.tobytes()], pa.binary())], names=["sums"])

        found = (parts if n == 1 else parts.repartition(1)).mapInArrow(last, "sums binary").collect()
        return np.frombuffer(bytes(found[0].sums), np.float64) if found else finish(np.zeros(width))
    total = np.zeros(width)
    for r in parts.collect():
        total = total + np.frombuffer(bytes(r.sums), np.float64)
    return total


def packed(batch: pa.RecordBatch) -> tuple[int, np.ndarray | None, np.ndarray, np.ndarray]:
    """(size, positions or None, numbers, numbers of each row) of a batch's first column, MLlib vectors; without positions
    the vectors are dense."""
    column = batch.column(0)
    if column.null_count:
        raise ValueError("a row has no features")
    kind, size, indices, values = (column.field(i) for i in range(4))
    own = pc.list_value_length(values).to_numpy(zero_copy_only=False).astype(np.int64)
    sparse = kind.to_numpy() == 0
    sizes = np.where(sparse, pc.fill_null(size, -1).to_numpy(zero_copy_only=False), own)
    if (sizes != sizes[0]).any():
        raise ValueError("vectors differ in size")
    numbers = values.flatten().to_numpy(zero_copy_only=False)
    if not sparse.any():
        return int(sizes[0]), None, numbers, own
    at = np.empty(len(numbers), np.int32)
    inside = np.repeat(sparse, own)
    at[inside] = indices.filter(pa.array(sparse)).flatten().to_numpy(zero_copy_only=False)
    at[~inside] = np.tile(np.arange(sizes[0], dtype=np.int32), int((~sparse).sum()))
    return int(sizes[0]), at, numbers, own


def unpacked(size: int, at: np.ndarray | None, numbers: np.ndarray, own: np.ndarray, behind: np.ndarray) -> np.ndarray:
    """The vectors as rows of a table with the columns ``behind`` and a column of ones after them."""
    x = np.zeros((len(own), size + behind.shape[1] + 1))
    if at is None:
        x[:, :size] = numbers.reshape(len(own), size)
    else:
        x[np.repeat(np.arange(len(own)), own), at] = numbers
    x[:, size:-1] = behind
    x[:, -1] = 1.0
    return x


BLOCK = "size int, behind int, positions binary, numbers binary, own binary, others binary"


class Rows:
    """The training table in blocks of rows, written once, with the folds of all models; vectors keep their stored entries.

    The columns ``behind`` follow the features as further ones.
    """

    def __init__(self, df: DataFrame, models: list[Model], behind: list[str] | None = None):
        self.models, behind = models, behind or []
        self.columns = sorted({m.column for m in models if m.column is not None})
        self.labels = sorted({m.label for m in models})
        parts = [len(behind), len(self.columns), len(self.labels)]

        def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for start in range(0, batch.num_rows, ROWS):
                    block = batch.slice(start, ROWS)
                    size, at, numbers, own = packed(block)
                    others = [np.asarray(c.to_numpy(zero_copy_only=False), float) for c in block.columns[1:]]
                    if any(c.null_count for c in block.columns[1:1 + parts[0]]):
                        raise ValueError("a row has no value behind its features")
                    told = [None if at is None else at.tobytes(), numbers.tobytes(), own.tobytes(), np.array(others).tobytes()]
                    yield pa.RecordBatch.from_arrays(
                        [pa.array([size], pa.int32()), pa.array([parts[0]], pa.int32()), *[pa.array([x], pa.binary()) for x in told]],
                        names=["size", "behind", "positions", "numbers", "own", "others"])

        self.data = materialize(df.select(
            F.unwrap_udt("features").alias("x"), *[F.col(c).cast("double").alias(f"_{k}{i}") for k, names in (
                ("b", behind), ("f", self.columns), ("y", self.labels)) for i, c in enumerate(names)]).mapInArrow(pack, BLOCK), "tuning-rows")
        first = self.data.select("size").first()
        self.width = first["size"] + len(behind) + 1 if first else 1

    def passes(self, fn, width: int) -> np.ndarray:
        """Sum over all rows of fn(x with a column of ones, y by model, mask of training rows by model)."""
        models, columns = self.models, self.columns
        of = [self.labels.index(m.label) for m in models]
        positive = np.array([m.positive for m in models])

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            total = np.zeros(width)
            for batch in batches:
                for i in range(batch.num_rows):
                    size, behind = batch.column(0)[i].as_py(), batch.column(1)[i].as_py()
                    at, numbers, own, others = (
                        np.frombuffer(c[i].as_buffer(), t) if c[i].is_valid else None
                        for c, t in zip(batch.columns[2:], (np.int32, np.float64, np.int64, np.float64), strict=True))
                    n, others = len(own), others.reshape(-1, len(own))
                    x = unpacked(size, at, numbers, own, others[:behind].T)
                    folds = dict(zip(columns, others[behind:], strict=False))
                    mask = np.stack([np.ones(n) if m.column is None else (folds[m.column] != m.value).astype(float)
                                     for m in models], axis=1)
                    y = others[behind + len(columns):].T[:, of] == positive
                    total = total + fn(x, y.astype(float), mask)
            yield pa.RecordBatch.from_arrays([pa.array([total.tobytes()], pa.binary())], names=["sums"])

        return tree_sum(self.data.mapInArrow(run, "sums binary"), width)


def _losses(x: np.ndarray, y: np.ndarray, mask: np.ndarray, weights: np.ndarray) -> np.ndarray:
    z = x @ weights.T
    loss = (mask * (np.logaddexp(0.0, z) - y * z)).sum(axis=0)
    gradient = (mask * (1.0 / (1.0 + np.exp(-z)) - y)).T @ x
    return np.concatenate([loss, gradient.ravel()])


def _counts(x: np.ndarray, y: np.ndarray, mask: np.ndarray, weights: np.ndarray) -> np.ndarray:
    """Per model: true and false positives, true and false negatives of the training rows, then of the others."""
    guess, true = (x @ weights.T) > 0, y > 0.5
    cells = [guess & true, guess & ~true, ~guess & ~true, ~guess & true]
    return np.concatenate([(c * side).sum(axis=0) for side in (mask, 1.0 - mask) for c in cells])


def _direction(gradient: np.ndarray, history: list[tuple[np.ndarray, np.ndarray]]) -> np.ndarray:
    q, kept = gradient.copy(), []
    for s, d in reversed(history):
        a = s @ q / (d @ s)
        q -= a * d
        kept.append(a)
    if history:
        s, d = history[-1]
        q *= (s @ d) / (d @ d)
    for (s, d), a in zip(history, reversed(kept), strict=True):
        q += s * (a - d @ q / (d @ s))
    return -q


def fit_many(df: DataFrame, models: list[Model], rounds: int = 200, tol: float = 1e-7,
             behind: list[str] | None = None) -> tuple[np.ndarray, np.ndarray]:
    """(weights, counts) of each model: coefficients with the intercept last, which minimise mean log loss +
    |coef|^2 / (2 c n) over the model's n training rows; and the eight counts of ``_counts``.

    df has features, the labels and the fold columns; the columns ``behind`` follow the features. A model stops when its gradient is below ``tol``; the pass then goes on
    for the others. The result follows from the rows alone, so it does not depend on the other models in the pass.
    """
    rows, m = Rows(df, models, behind), len(models)
    width = rows.width
    sizes = np.maximum(rows.passes(lambda x, y, mask: mask.sum(axis=0), m), 1.0)
    penalty = 1.0 / (np.array([model.c for model in models]) * sizes)
    ridge = np.ones(width)
    ridge[-1] = 0.0
    used = np.ones((m, width))
    for i, model in enumerate(models):
        if model.leading is not None:
            used[i, model.leading:-1] = 0.0

    def evaluate(weights: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        sums = rows.passes(lambda x, y, mask: _losses(x, y, mask, weights), m * (1 + width))
        loss = sums[:m] / sizes + 0.5 * penalty * (ridge * weights ** 2).sum(axis=1)
        return loss, used * (sums[m:].reshape(m, width) / sizes[:, None] + penalty[:, None] * ridge * weights)

    weights = np.zeros((m, width))
    loss, gradient = evaluate(weights)
    history: list[list] = [[] for _ in models]
    way, rate = -gradient, np.ones(m)
    for _ in range(rounds):
        open_ = np.linalg.norm(gradient, axis=1) > tol
        open_ &= rate > 1e-10
        if not open_.any():
            break
        trial = weights + np.where(open_, rate, 0.0)[:, None] * way
        new_loss, new_gradient = evaluate(trial)
        slope = (gradient * way).sum(axis=1)
        for i in np.flatnonzero(open_):
            if new_loss[i] > loss[i] + 1e-4 * rate[i] * slope[i] + 1e-15:
                rate[i] /= 2
                continue
            s, d = trial[i] - weights[i], new_gradient[i] - gradient[i]
            if s @ d > 1e-18:
                history[i] = [*history[i], (s, d)][-MEMORY:]
            weights[i], loss[i], gradient[i], rate[i] = trial[i], new_loss[i], new_gradient[i], 1.0
            way[i] = _direction(gradient[i], history[i])
    counts = rows.passes(lambda x, y, mask: _counts(x, y, mask, weights), 8 * m)
    return weights, counts.reshape(8, m).T


def scores(counts: np.ndarray) -> dict[str, np.ndarray]:
    """Accuracy, precision, recall and F1 of rows of four counts; 0 where undefined."""
    tp, fp, tn, fn = counts.T
    ratio = lambda a, b: np.divide(a, b, out=np.zeros_like(a, dtype=float), where=b > 0)
    return {"accuracy": ratio(tp + tn, tp + fp + tn + fn), "precision": ratio(tp, tp + fp), "recall": ratio(tp, tp + fn),
            "f1": ratio(2 * tp, 2 * tp + fp + fn)}


@dataclass(frozen=True)
class Chain:
    """Models of several labels in order; each sees the features and the labels before it."""

    labels: list[str]
    classes: list[list[float]]
    weights: list[np.ndarray]  # of each label: (class, features and earlier labels, intercept)

    def transform(self, df: DataFrame, features: str = "features") -> DataFrame:
        """Adds pred_<label> for every label; predictions feed the models behind them."""
        classes, weights = [np.array(c) for c in self.classes], self.weights

        @F.pandas_udf("array<double>")
        def predict(x: pd.Series) -> pd.Series:
            seen = np.stack(x.to_numpy())
            told = np.zeros((len(x), 0))
            for own, w in zip(classes, weights, strict=True):
                margin = np.hstack([seen, told]) @ w[:, :-1].T + w[:, -1]
                told = np.hstack([told, own[margin.argmax(axis=1)][:, None]])
            return pd.Series(list(told))

        out = df.withColumn("_told", predict(vector_to_array(features)))
        return out.withColumns({f"pred_{c}": F.get("_told", F.lit(i)) for i, c in enumerate(self.labels)}).drop("_told")


def fit_chain(df: DataFrame, labels: list[str], c: float = 1.0, rounds: int = 100, tol: float = 1e-5) -> Chain:
    """One model per label and class, all trained in the same passes: training uses the true earlier labels, so no model
    waits for another one. The largest margin gives the class, the first of equals."""
    classes = [sorted(float(v) for v in row) for row in df.agg(*[F.collect_set(F.col(x).cast("double")) for x in labels]).first()]
    width = len(df.first()["features"])
    models = [Model(c, label=x, positive=v, leading=width + j) for j, x in enumerate(labels) for v in classes[j]]
    weights, _ = fit_many(df.select("features", *labels), models, rounds, tol, labels)
    out, at = [], 0
    for j, own in enumerate(classes):
        part = weights[at:at + len(own)]
        out.append(np.hstack([part[:, :width + j], part[:, -1:]]))
        at += len(own)
    return Chain(list(labels), classes, out)
