"""Ranking, prefix sums and top-k that never gather a whole group, or the whole table, in one task."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def position_in_group(df: DataFrame, keys: list[str], order: str, width: int = 65536, out: str = "pos") -> DataFrame:
    """0-based rank of a unique integer ``order`` inside each group.

    A group is cut into ranges of ``width`` order values. Rows are ranked inside their range; a
    second table of range sizes, one row per range, supplies the offset. A group that holds a third
    of the table is spread over as many tasks as it has ranges.
    """
    ranged = df.withColumn("_range", F.floor(F.col(order) / F.lit(width)))
    parts = keys + ["_range"]
    before = Window.partitionBy(*keys).orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    offsets = (
        ranged.groupBy(*parts).agg(F.count("*").alias("_n"))
        .select(*parts, F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_offset"))
    )
    inside = Window.partitionBy(*parts).orderBy(order)
    return (
        ranged.withColumn("_rank", F.row_number().over(inside))
        .join(offsets, parts)
        .withColumn(out, F.col("_offset") + F.col("_rank") - 1)
        .drop("_range", "_rank", "_offset")
    )


def hash_order(df: DataFrame, strata: list[str], token: Column, unique: list[str], modulus: int,
               buckets: int = 1024, out: str = "pos") -> DataFrame:
    """0-based rank by (token, unique) inside each stratum, for a token spread evenly over [0, modulus).

    The even token makes buckets of equal size, however large a stratum is.
    """
    step = -(-modulus // buckets)
    spread = df.withColumn("_token", token).withColumn("_bucket", F.floor(F.col("_token") / F.lit(step)))
    parts = strata + ["_bucket"]
    before = Window.partitionBy(*(strata or [F.lit(0)])).orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    offsets = (
        spread.groupBy(*parts).agg(F.count("*").alias("_n"))
        .select(*parts, F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_offset"))
    )
    inside = Window.partitionBy(*parts).orderBy("_token", *unique)
    return (
        spread.withColumn("_rank", F.row_number().over(inside))
        .join(offsets, parts)
        .withColumn(out, F.col("_offset") + F.col("_rank") - 1)
        .drop("_token", "_bucket", "_rank", "_offset")
    )


def with_range_bucket(df: DataFrame, order: str, buckets: int = 1024, out: str = "_bucket") -> DataFrame:
    """Adds a bucket number from approximate quantiles of ``order``; ``buckets`` is a power of two.

    The bounds come from one aggregate row. Each row finds its bucket by halving steps over them,
    ten array look-ups for 1024 buckets, all inside generated code.
    """
    steps = [i / buckets for i in range(1, buckets)]
    bounds = df.agg(F.percentile_approx(order, steps, F.lit(20 * buckets)).alias("b")).scalar()
    found = df.withColumn("_bounds", bounds).withColumn(out, F.lit(0))
    step = buckets // 2
    while step:
        passed = F.get("_bounds", F.col(out) + (step - 1)) < F.col(order)
        found = found.withColumn(out, F.col(out) + F.when(passed, step).otherwise(0))
        step //= 2
    return found.drop("_bounds")


def running_totals(df: DataFrame, order: str, values: list[str], descending: bool = False,
                   buckets: int = 1024) -> DataFrame:
    """Adds cum_<value> over the whole table in the order of a unique column.

    Bucket totals (at most ``buckets`` rows) carry the sums across buckets; the windows run inside
    one bucket each.
    """
    ranged = with_range_bucket(df, order, buckets)
    direction = (lambda c: F.col(c).desc()) if descending else (lambda c: F.col(c).asc())
    before = Window.partitionBy(F.lit(0)).orderBy(direction("_bucket")).rowsBetween(Window.unboundedPreceding, -1)
    totals = ranged.groupBy("_bucket").agg(*[F.sum(v).alias(f"_total_{v}") for v in values])
    offsets = totals.select(
        "_bucket", *[F.coalesce(F.sum(f"_total_{v}").over(before), F.lit(0)).alias(f"_offset_{v}") for v in values]
    )
    upto = Window.partitionBy("_bucket").orderBy(direction(order)).rowsBetween(Window.unboundedPreceding, 0)
    summed = ranged.select("*", *[F.sum(v).over(upto).alias(f"_inside_{v}") for v in values])
    # offsets has at most `buckets` rows, so the broadcast is bounded by construction
    joined = summed.join(F.broadcast(offsets), "_bucket")
    return joined.select(
        *df.columns, *[(F.col(f"_offset_{v}") + F.col(f"_inside_{v}")).alias(f"cum_{v}") for v in values]
    )


def global_position(df: DataFrame, order: str, buckets: int = 1024, out: str = "pos") -> DataFrame:
    """0-based rank of a unique column over the whole table."""
    counted = running_totals(df.withColumn("_one", F.lit(1).cast("long")), order, ["_one"], buckets=buckets)
    return counted.withColumn(out, F.col("cum__one") - 1).drop("_one", "cum__one")


def top_k(df: DataFrame, keys: list[str], order: list[Column], k: int, salt_on: list[str], salts: int = 32,
          out: str = "rank") -> DataFrame:
    """The first k rows of each group.

    Each salted share of a group keeps its own first k, and the final choice sees at most
    k * salts rows per group.
    """
    share = Window.partitionBy(*keys, "_salt").orderBy(*order)
    whole = Window.partitionBy(*keys).orderBy(*order)
    return (
        df.withColumn("_salt", F.pmod(F.xxhash64(*salt_on), F.lit(salts)))
        .withColumn("_share_rank", F.row_number().over(share)).where(F.col("_share_rank") <= k)
        .withColumn(out, F.row_number().over(whole)).where(F.col(out) <= k)
        .drop("_salt", "_share_rank")
    )
