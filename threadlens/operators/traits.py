"""Trait scores from features: one ridge regressor per trait, all fitted from one pass over the rows."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from threadlens.operators.shared_tuning import ROWS, tree_sum


@dataclass(frozen=True)
class TraitModel:
    """Weights (trait, feature) with the intercept last."""

    traits: list[str]
    weights: np.ndarray

    def transform(self, df: DataFrame, features: str = "features") -> DataFrame:
        """Adds one double per trait. A row without features gets nulls."""
        weights = self.weights

        @F.pandas_udf("array<double>")
        def score(x: pd.Series) -> pd.Series:
            there = np.flatnonzero(x.notna().to_numpy())
            out: list[np.ndarray | None] = [None] * len(x)
            if len(there):
                values = np.stack([x.iloc[i] for i in there]) @ weights[:, :-1].T + weights[:, -1]
                for i, row in zip(there, values, strict=True):
                    out[i] = row
            return pd.Series(out, dtype=object)

        scored = df.withColumn("_scores", score(vector_to_array(features)))
        return scored.withColumns({t: F.get("_scores", F.lit(i)) for i, t in enumerate(self.traits)}).drop("_scores")


def fit_traits(df: DataFrame, traits: list[str], features: str = "features", penalty: float = 1e-6) -> TraitModel:
    """Least squares with a small penalty on the weights, the intercept free. Only rows with features and all traits take
    part.

    Tasks add up the products of the features with each other and with the traits; the sums, whose size follows from the
    number of features, meet in a tree and are solved on the driver.
    """
    data = df.select(vector_to_array(features).alias("x"), F.array(*[F.col(t).cast("double") for t in traits]).alias("y")).where(
        F.col(features).isNotNull() & ~F.exists("y", lambda v: v.isNull()))
    first = data.first()
    if first is None:
        raise ValueError("no row has all traits")
    d, k = len(first["x"]) + 1, len(traits)

    def run(batches: Iterator[pd.DataFrame]):
        total = np.zeros((d, d + k))
        for frame in batches:
            for start in range(0, len(frame), ROWS):
                part = frame.iloc[start:start + ROWS]
                x = np.hstack([np.stack(part["x"].to_numpy()), np.ones((len(part), 1))])
                total += x.T @ np.hstack([x, np.stack(part["y"].to_numpy())])
        yield pd.DataFrame({"sums": [total.tobytes()]})

    total = tree_sum(data.mapInPandas(run, "sums binary"), d * (d + k)).reshape(d, d + k)
    ridge = np.full(d, penalty)
    ridge[-1] = 0.0
    solved = np.linalg.lstsq(total[:, :d] + np.diag(ridge), total[:, d:], rcond=None)[0]
    return TraitModel(list(traits), solved.T)
