"""Many sparse logistic models at once.

Every key has a model of its own: minimise sum(weight * log loss) + |coef|^2 / 2 over the key's rows, with a free
intercept. Both solvers take Newton steps found by preconditioned conjugate gradients and never build a dense matrix.
``fit_local`` holds one model's entries in arrays, ``fit_together`` those of many small ones; ``fit_distributed`` keeps entries, rows and coefficients as tables, so
a model may be as large as the table itself: products with the matrix are joins on (key, term) and (key, row) followed
by sums, which are combined before they are shuffled.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from threadlens.session import materialize

#: The intercept is the entry 1 of every row at this term, which no text has.
INTERCEPT = ""
#: Halvings of a Newton step that are tried, all in one aggregate.
HALVINGS = 12
#: A step has to lower the loss by this share of what its slope promises.
SLOPE_SHARE = 1e-4


def fit_local(row: np.ndarray, term: np.ndarray, value: np.ndarray, n_terms: int, y: np.ndarray, weight: np.ndarray,
              rounds: int = 50, products: int = 200, tol: float = 1e-9) -> tuple[np.ndarray, float, float]:
    """(coefficients, intercept, gradient norm) from the entries value at (row, term)."""
    coef, intercept, gradient = fit_together(
        np.zeros(len(y), np.int64), np.zeros(n_terms, np.int64), row, term, value, y, weight, 1, rounds, products, tol)
    return coef, float(intercept[0]), float(gradient[0])


def fit_together(model_of_row: np.ndarray, model_of_term: np.ndarray, row: np.ndarray, term: np.ndarray, value: np.ndarray,
                 y: np.ndarray, weight: np.ndarray, models: int, rounds: int = 50, products: int = 200,
                 tol: float = 1e-9) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(coefficients, intercepts, gradient norms) of many models that share no row and no term.

    Each model has its own rates and its own end; one operation on the arrays serves them all, so a small model costs its
    entries and no calls.
    """
    n, n_terms = len(y), len(model_of_term)
    row, term = np.concatenate([row, np.arange(n)]), np.concatenate([term, n_terms + model_of_row])
    value = np.concatenate([value, np.ones(n)])
    own = np.concatenate([model_of_term, np.arange(models)])
    width = n_terms + models
    penalty = np.concatenate([np.ones(n_terms), np.zeros(models)])
    forward = lambda v: np.bincount(row, value * v[term], n)
    backward = lambda u: np.bincount(term, value * u[row], width)
    per_model = lambda v: np.bincount(own, v, models)
    loss = lambda z, b: (np.bincount(model_of_row, weight * (np.logaddexp(0.0, z) - y * z), models)
                         + 0.5 * per_model(penalty * b * b))
    beta, size = np.zeros(width), np.zeros(models)
    for _ in range(rounds):
        z = forward(beta)
        p = 1.0 / (1.0 + np.exp(-z))
        gradient = backward(weight * (p - y)) + penalty * beta
        size = np.sqrt(per_model(gradient * gradient))
        open_ = size >= tol
        if not open_.any():
            break
        curve = weight * p * (1 - p)
        diagonal = np.bincount(term, value * value * curve[row], width) + penalty
        goal = np.minimum(0.1, size) * size * 0.1
        going, step, rest = open_.copy(), np.zeros(width), np.where(open_[own], -gradient, 0.0)
        way = near = rest / diagonal
        product = per_model(rest * near)
        for _ in range(products):
            bent = backward(curve * forward(way)) + penalty * way
            rate = np.divide(product, per_model(way * bent), out=np.zeros(models), where=going)[own]
            step, rest = step + rate * way, rest - rate * bent
            going = going & (np.sqrt(per_model(rest * rest)) > goal)
            if not going.any():
                break
            near = rest / diagonal
            product, before = per_model(rest * near), product
            turn = np.divide(product, before, out=np.zeros(models), where=going)
            way = np.where(going[own], near + turn[own] * way, 0.0)
        along, start, slope = forward(step), loss(z, beta), per_model(gradient * step)
        rate, waiting = np.ones(models), open_.copy()
        for _ in range(HALVINGS):
            waiting = waiting & ~(loss(z + rate[model_of_row] * along, beta + rate[own] * step) <= start + SLOPE_SHARE * rate * slope)
            if not waiting.any():
                break
            rate = np.where(waiting, rate / 2, rate)
        beta = beta + rate[own] * step
    return beta[:n_terms], beta[n_terms:], size


def _forward(entries: DataFrame, vectors: DataFrame, column: str, out: str) -> DataFrame:
    """(key, row, out): the matrix times a column of the coefficient table."""
    return (
        entries.join(vectors.select("key", "term", F.col(column).alias("_v")), ["key", "term"])
        .groupBy("key", "row").agg(F.sum(F.col("value") * F.col("_v")).alias(out))
    )


def _backward(entries: DataFrame, rows: DataFrame, **sums: Column) -> DataFrame:
    """(key, term, sums): sums over the rows of a term; value and the columns of rows may be used."""
    return entries.join(rows, ["key", "row"]).groupBy("key", "term").agg(*[F.sum(c).alias(n) for n, c in sums.items()])


def _log_loss(z: Column, y: Column) -> Column:
    return F.greatest(z, F.lit(0.0)) + F.log1p(F.exp(-F.abs(z))) - y * z


def fit_distributed(entries: DataFrame, rows: DataFrame, rounds: int = 30, products: int = 60, tol: float = 1e-7) -> DataFrame:
    """(key, term, beta, gradient): the coefficients of every key's model, the intercept at the term INTERCEPT, and the
    norm of the key's gradient.

    entries(key, row, term, value), rows(key, row, y, weight). A key whose gradient is below ``tol`` stays as it is while
    others go on. One product with the curvature is two joins and two sums over the entries; the written tables of a step
    cut its lineage. The driver learns only whether any key is still open.
    """
    rows = materialize(rows.select("key", "row", F.col("y").cast("double").alias("y"), "weight"), "fit-rows")
    ones = rows.select("key", "row", F.lit(INTERCEPT).alias("term"), F.lit(1.0).alias("value"))
    entries = materialize(entries.select("key", "row", "term", "value").unionByName(ones), "fit-entries")
    state = entries.select("key", "term").distinct().withColumn("beta", F.lit(0.0))
    penalty = (F.col("term") != INTERCEPT).cast("double")
    for _ in range(rounds):
        p = 1.0 / (1.0 + F.exp(-F.col("z")))
        told = rows.join(_forward(entries, state, "beta", "z"), ["key", "row"])
        told = materialize(told.select(
            "key", "row", "y", "weight", "z", (F.col("weight") * (p - F.col("y"))).alias("u"),
            (F.col("weight") * p * (1 - p)).alias("curve")), "fit-margins")
        sums = _backward(entries, told.select("key", "row", "u", "curve"), g=F.col("value") * F.col("u"),
                         h=F.col("value") * F.col("value") * F.col("curve"))
        state = materialize(state.select("key", "term", "beta").join(sums, ["key", "term"]).select(
            "key", "term", "beta", (F.col("g") + penalty * F.col("beta")).alias("g"),
            (F.col("h") + penalty).alias("diagonal")), "fit-state")
        sizes = state.groupBy("key").agg(F.sqrt(F.sum(F.col("g") * F.col("g"))).alias("size"))
        state = state.join(sizes, "key")
        open_ = state.where(F.col("size") >= tol)
        if open_.isEmpty():
            break
        step = materialize(_newton_step(entries, told, open_, penalty, products), "fit-step")
        rates = _step_rates(entries, told, step, penalty)
        state = state.join(step.select("key", "term", "step"), ["key", "term"], "left").join(rates, "key", "left").select(
            "key", "term", (F.col("beta") + F.coalesce(F.col("rate") * F.col("step"), F.lit(0.0))).alias("beta"), "size")
        state = materialize(state, "fit-state")
    return state.select("key", "term", "beta", F.col("size").alias("gradient"))


def _newton_step(entries: DataFrame, told: DataFrame, open_: DataFrame, penalty: Column, products: int) -> DataFrame:
    """(key, term, beta, g, step) of the open keys: conjugate gradients until the rest is a small share of the gradient."""
    curve = told.select("key", "row", "curve")
    current = materialize(open_.select(
        "key", "term", "beta", "g", "diagonal", "size", F.lit(0.0).alias("step"), (-F.col("g")).alias("rest"),
        (-F.col("g") / F.col("diagonal")).alias("way"), F.lit(False).alias("done")), "fit-way")
    goal = F.least(F.lit(0.1), F.col("size")) * F.col("size") * 0.1
    for _ in range(products):
        going = current.where(~F.col("done"))
        bent = _backward(entries, _forward(entries, going, "way", "z").join(curve, ["key", "row"]),
                         bent=F.col("value") * F.col("curve") * F.col("z"))
        next_ = materialize(going.join(bent, ["key", "term"]).withColumn("bent", F.col("bent") + penalty * F.col("way")), "fit-bent")
        scalars = next_.groupBy("key").agg(
            F.sum(F.col("rest") * F.col("rest") / F.col("diagonal")).alias("product"),
            F.sum(F.col("way") * F.col("bent")).alias("bend"))
        moved = next_.join(scalars, "key").withColumn("_rate", F.col("product") / F.col("bend")).withColumn(
            "step", F.col("step") + F.col("_rate") * F.col("way")).withColumn(
            "rest", F.col("rest") - F.col("_rate") * F.col("bent"))
        after = moved.groupBy("key").agg(
            F.sum(F.col("rest") * F.col("rest") / F.col("diagonal")).alias("_after"),
            F.sqrt(F.sum(F.col("rest") * F.col("rest"))).alias("_norm"))
        moved = moved.join(after, "key").withColumn("done", F.col("_norm") <= goal).withColumn(
            "way", F.col("rest") / F.col("diagonal") + F.col("_after") / F.col("product") * F.col("way"))
        current = materialize(moved.select(*current.columns).unionByName(current.where("done")), "fit-way")
        if current.where(~F.col("done")).isEmpty():
            break
    return current.select("key", "term", "beta", "g", "step")


def _step_rates(entries: DataFrame, told: DataFrame, step: DataFrame, penalty: Column) -> DataFrame:
    """(key, rate): the longest of the halved steps that lowers the key's loss enough. All lengths come from one pass, as
    margins are linear in the length."""
    rates = [0.0, *[2.0 ** -i for i in range(HALVINGS)]]
    along = told.join(_forward(entries, step, "step", "along"), ["key", "row"])
    losses = along.groupBy("key").agg(*[
        F.sum(F.col("weight") * _log_loss(F.col("z") + r * F.col("along"), F.col("y"))).alias(f"l{i}") for i, r in enumerate(rates)])
    squares = step.groupBy("key").agg(F.sum(F.col("g") * F.col("step")).alias("slope"), *[
        (0.5 * F.sum(penalty * F.pow(F.col("beta") + r * F.col("step"), F.lit(2.0)))).alias(f"s{i}") for i, r in enumerate(rates)])
    both = losses.join(squares, "key")
    start = F.col("l0") + F.col("s0")
    good = [F.when(F.col(f"l{i}") + F.col(f"s{i}") <= start + SLOPE_SHARE * r * F.col("slope"), F.lit(r))
            for i, r in enumerate(rates) if i]
    return both.select("key", F.coalesce(*good, F.lit(rates[-1])).alias("rate"))
