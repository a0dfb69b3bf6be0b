"""Train/test splits and folds. All depend on ids and a seed, never on row order or partitioning."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from threadlens.operators.skew import hash_order

HASH_RANGE = 1 << 20


def hash_token(unique: list[str], seed: int = 42, modulus: int = HASH_RANGE) -> Column:
    return F.pmod(F.xxhash64(F.lit(seed), *unique), F.lit(modulus))


def train_test(df: DataFrame, unique: list[str], test_percent: int = 20, seed: int = 42, token: Column | None = None,
               modulus: int = HASH_RANGE) -> DataFrame:
    """Adds is_test. The share is met on average, and a row keeps its side when the table grows."""
    token = hash_token(unique, seed, modulus) if token is None else token
    return df.withColumn("is_test", (token < F.lit(modulus * test_percent // 100)).cast("int"))


def shuffle_splits(df: DataFrame, unique: list[str], n_splits: int = 3, test_percent: int = 33, seed: int = 42,
                   token=None, modulus: int = HASH_RANGE) -> DataFrame:
    """Independent random splits as columns split_0 .. split_{n-1}; 1 marks a test row."""
    token = token or (lambda i: hash_token(unique, seed + i, modulus))
    return df.withColumns({
        f"split_{i}": (token(i) < F.lit(modulus * test_percent // 100)).cast("int") for i in range(n_splits)
    })


def k_folds(df: DataFrame, unique: list[str], k: int = 3, seed: int = 42, token: Column | None = None) -> DataFrame:
    token = hash_token(unique, seed) if token is None else token
    return df.withColumn("fold", (token % k).cast("int"))


def stratified_folds(df: DataFrame, label: str, unique: list[str], k: int = 10, repeats: int = 3, seed: int = 1,
                     token=None, modulus: int = HASH_RANGE) -> DataFrame:
    """Adds fold_0 .. fold_{repeats-1}; class counts differ by at most one between the folds of a repeat.

    The rank inside a class comes from hash buckets, so a class of any size is ranked in parallel.
    """
    token = token or (lambda i: hash_token(unique, seed + i, modulus))
    for i in range(repeats):
        df = hash_order(df, [label], token(i), unique, modulus, out="_rank_in_class")
        df = df.withColumn(f"fold_{i}", (F.col("_rank_in_class") % k).cast("int")).drop("_rank_in_class")
    return df
