"""A small linear model per thread that imitates the big model on the replies and explains the root."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from threadlens.operators import relational as rel
from threadlens.operators import threads as th
from threadlens.operators.sparse_logistic import INTERCEPT, fit_distributed, fit_together
from threadlens.session import materialize


#: Threads with more term weights than this are fitted as tables, the others in blocks of about BLOCK_ENTRIES weights.
LOCAL_ENTRIES, BLOCK_ENTRIES = 500_000, 100_000


def _explain_block(rows: pd.DataFrame) -> pd.DataFrame:
    """Long rows (thread_id, pos, label, term, weight) of whole threads to their surrogates and the roots' contributions."""
    thread, threads = pd.factorize(rows["thread_id"])
    rows = rows.assign(thread=thread)
    n = len(threads)
    replies = rows[rows["pos"] > 0].drop_duplicates(["thread", "pos"]).sort_values(["thread", "pos"])
    own, y = replies["thread"].to_numpy(), replies["label"].to_numpy(dtype=float)
    if not np.isin(y, (0.0, 1.0)).all():
        raise ValueError("labels must be 0 or 1")
    size, ones = np.bincount(own, minlength=n), np.bincount(own, y, n)
    weight = size[own] / (2.0 * np.maximum(1, np.where(y == 1, ones[own], size[own] - ones[own])))
    found = rows.dropna(subset=["term"])
    word, words = pd.factorize(found["term"])
    # (thread, term) as one number, and so (thread, pos)
    found = found.assign(pair=found["thread"].to_numpy() * max(1, len(words)) + word)
    inside, root = found[found["pos"] > 0], found[found["pos"] == 0]
    pairs, column = np.unique(inside["pair"].to_numpy(), return_inverse=True)
    places = np.unique(replies["pos"].to_numpy())
    number = lambda part: part["thread"].to_numpy() * max(1, len(places)) + np.searchsorted(places, part["pos"].to_numpy())
    line = np.searchsorted(number(replies), number(inside))
    coef, intercept, gradient = fit_together(
        own, pairs // max(1, len(words)), line, column, inside["weight"].to_numpy(dtype=float), y, weight, n)
    at = np.minimum(np.searchsorted(pairs, root["pair"].to_numpy()), max(0, len(pairs) - 1))
    known = pairs[at] == root["pair"].to_numpy() if len(pairs) else np.zeros(len(root), bool)
    root = root[known]
    contribution = coef[at[known]] * root["weight"].to_numpy(dtype=float)
    margin = np.bincount(root["thread"].to_numpy(), contribution, n) + intercept
    listed: list[list[dict]] = [[] for _ in range(n)]
    shown = root.assign(contribution=contribution)[contribution != 0].sort_values("term", kind="stable")
    for t, w, c in zip(shown["thread"], shown["term"], shown["contribution"], strict=True):
        listed[t].append({"word": w, "contribution": c})
    return pd.DataFrame({
        "thread_id": threads, "surrogate_label": (margin > 0).astype(np.int32), "surrogate_proba": 1.0 / (1.0 + np.exp(-margin)),
        "margin": margin, "intercept": intercept, "gradient": gradient, "words": listed})


def _explain_large(rows: DataFrame) -> DataFrame:
    """The same rows of all threads that are fitted as tables, one row per thread. A root bounds its list of words."""
    replies = rows.where(F.col("pos") > 0)
    labels = replies.select("thread_id", "pos", "label").distinct()
    counts = labels.groupBy("thread_id").agg(
        F.count("*").alias("n"), F.count_if(F.col("label") == 1).alias("ones"), F.count_if(F.col("label") == 0).alias("zeros"))
    weight = F.col("n") / (2.0 * F.greatest(F.lit(1), F.when(F.col("label") == 1, F.col("ones")).otherwise(F.col("zeros"))))
    fitted = materialize(fit_distributed(
        replies.where(F.col("term").isNotNull()).select(
            F.col("thread_id").alias("key"), F.col("pos").alias("row"), "term", F.col("weight").alias("value")),
        labels.join(counts, "thread_id").select(
            F.col("thread_id").alias("key"), F.col("pos").alias("row"), F.col("label").alias("y"), weight.alias("weight"))), "surrogate-fit")
    fitted = fitted.withColumnRenamed("key", "thread_id")
    root = rows.where((F.col("pos") == 0) & F.col("term").isNotNull()).join(fitted, ["thread_id", "term"]).select(
        "thread_id", F.struct(F.col("term").alias("word"), (F.col("beta") * F.col("weight")).alias("contribution")).alias("w"))
    words = root.where(F.col("w.contribution") != 0).groupBy("thread_id").agg(F.array_sort(F.collect_list("w")).alias("words"))
    base = fitted.where(F.col("term") == INTERCEPT).select("thread_id", F.col("beta").alias("intercept"), "gradient")
    none = F.array().cast("array<struct<word:string,contribution:double>>")
    total = F.aggregate("words", F.lit(0.0), lambda acc, w: acc + w["contribution"])
    margin = F.col("margin")
    return (
        base.join(words, "thread_id", "left").withColumn("words", F.coalesce("words", none))
        .withColumn("margin", total + F.col("intercept"))
        .select("thread_id", (margin > 0).cast("int").alias("surrogate_label"), (1.0 / (1.0 + F.exp(-margin))).alias("surrogate_proba"),
                "margin", "intercept", "gradient", "words")
    )


def mixed_threads(posts: DataFrame) -> DataFrame:
    """Thread ids whose replies carry both labels."""
    flags = rel.thread_homophily(posts, "thread_id", "pos", "label")
    return flags.where(F.col("homophilous") == 0).select("thread_id")


def distinct_posts(posts: DataFrame, columns: list[str]) -> DataFrame:
    """Exact copies inside a thread collapse to the first of them."""
    first = posts.groupBy("thread_id", *columns).agg(F.min("pos").alias("pos"))
    return posts.join(first.select("thread_id", "pos"), ["thread_id", "pos"], "left_semi")


def thread_surrogates(posts: DataFrame, weights: DataFrame, local_entries: int = LOCAL_ENTRIES,
                      block_entries: int = BLOCK_ENTRIES) -> DataFrame:
    """One row per mixed thread: surrogate label, probability, margin, intercept and the root's word contributions.

    posts(thread_id, pos, label), weights(thread_id, pos, term, weight). Threads may have any size: those of at most
    ``local_entries`` term weights are fitted in blocks of whole threads, of about ``block_entries`` weights, each in one
    call on arrays; the larger ones together by sums over their tables.
    Both reach the same minimum. Single-label threads are removed before the fit.
    """
    kept = posts.select("thread_id", "pos", "label").join(mixed_threads(posts), "thread_id", "left_semi")
    rows = materialize(kept.join(weights, ["thread_id", "pos"], "left"), "surrogate-rows")
    large = rows.groupBy("thread_id").count().where(F.col("count") > local_entries).select("thread_id")
    key = posts.schema["thread_id"].dataType
    schema = T.StructType([
        T.StructField("thread_id", key), T.StructField("surrogate_label", T.IntegerType()),
        T.StructField("surrogate_proba", T.DoubleType()), T.StructField("margin", T.DoubleType()),
        T.StructField("intercept", T.DoubleType()), T.StructField("gradient", T.DoubleType()),
        T.StructField("words", T.ArrayType(T.StructType([
            T.StructField("word", T.StringType()), T.StructField("contribution", T.DoubleType())]))),
    ])

    def run(frame: pd.DataFrame) -> pd.DataFrame:
        return _explain_block(frame.drop(columns="_block"))[schema.names]

    blocks = max(8 * posts.sparkSession.sparkContext.defaultParallelism, -(-rows.count() // block_entries))
    small = rows.join(large, "thread_id", "left_anti").withColumn("_block", F.pmod(F.xxhash64("thread_id"), F.lit(blocks)))
    small = small.groupBy("_block").applyInPandas(run, schema)
    if large.isEmpty():
        return small
    return small.unionByName(_explain_large(materialize(rows.join(large, "thread_id", "left_semi"), "surrogate-rows")))


def explain_threads(posts: DataFrame, surrogates: DataFrame) -> DataFrame:
    """Result table of mixed threads: root text, surrogate and black-box label, replies before copies collapse."""
    roots = posts.where(F.col("pos") == 0).select(
        "thread_id", F.col("text").alias("tweet_text"), F.col("label").alias("bb_pred"),
        F.col("proba").alias("bb_proba"))
    sizes = rel.thread_sizes(posts, "thread_id", F.col("pos") > 0)
    return surrogates.join(roots, "thread_id").join(sizes, "thread_id").select(
        "thread_id", "tweet_text", F.col("surrogate_label").alias("lr_pred"), "bb_pred",
        F.col("surrogate_proba").alias("lr_proba"), "bb_proba", F.col("n_replies").alias("replies"), "margin",
        "intercept", "gradient")


def word_table(surrogates: DataFrame, k: int = 20) -> DataFrame:
    """The k strongest words per thread with the sum, the intercept and the decision line."""
    words = surrogates.select(
        "thread_id", "intercept", (F.col("margin") - F.col("intercept")).alias("total"), "margin",
        F.inline("words"))
    line = F.when(F.col("margin") > 0, " > 0 -> 1").otherwise(" <= 0 -> 0")
    return th.top_words(words.withColumn("decision", line), k)


def homophily_report(posts: DataFrame) -> DataFrame:
    """Threads whose replies carry one label: root text, that label, the black box's label, reply count."""
    flags = rel.thread_homophily(posts, "thread_id", "pos", "label").where(F.col("homophilous") == 1)
    roots = posts.where(F.col("pos") == 0).select(
        "thread_id", F.col("text").alias("tweet_text"), F.col("label").alias("bb_pred"))
    return flags.join(roots, "thread_id").select(
        "thread_id", "tweet_text", F.col("first_label").alias("homophily_pred"), "bb_pred",
        F.col("n_replies").alias("replies"))
