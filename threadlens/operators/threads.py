"""Per-thread term weights and exemplars, of threads of any size."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from threadlens.functions import text as tx
from threadlens.operators.skew import top_k


def term_counts(posts: DataFrame, keys: list[str], text: str, stop_words: list[str] | None = None) -> DataFrame:
    """(keys, term, tf). Counts are complete within the task that reads a post, so the shuffle is combined."""
    terms = posts.select(*keys, F.explode(tx.word_tokens(F.col(text), stop_words)).alias("term"))
    return terms.groupBy(*keys, "term").agg(F.count("*").alias("tf"))


def thread_tfidf(posts: DataFrame, text: str, stop_words: list[str] | None = None) -> DataFrame:
    """(thread_id, pos, term, weight): per-thread tf-idf fitted on the replies and applied to all posts.

    Threads may have any size. The document frequencies of (thread, term) are summed before they are shuffled and joined
    back, so a term that most replies of a large thread have is no group of one task; the norm's window is one post.
    """
    counts = term_counts(posts, ["thread_id", "pos"], text, stop_words)
    replies = posts.groupBy("thread_id").agg(F.count_if(F.col("pos") > 0).alias("n"))
    frequency = counts.groupBy("thread_id", "term").agg(F.count_if(F.col("pos") > 0).alias("df")).where("df > 0")
    idf = F.log((F.col("n") + 1) / (F.col("df") + 1)) + 1
    weighted = (
        counts.join(frequency, ["thread_id", "term"]).join(replies, "thread_id")
        .select("thread_id", "pos", "term", (F.col("tf") * idf).alias("_w"))
    )
    post = Window.partitionBy("thread_id", "pos")
    return weighted.select(
        "thread_id", "pos", "term",
        (F.col("_w") / F.sqrt(F.sum(F.col("_w") * F.col("_w")).over(post))).alias("weight"))


def reply_similarity(posts: DataFrame, weights: DataFrame) -> DataFrame:
    """Cosine of the root with every reply of its thread; 0 when they share no term.

    The weights are unit vectors, so the cosine is the sum of products over shared terms. A root
    holds a term once, so the term join adds no rows.
    """
    root = weights.where(F.col("pos") == 0).select("thread_id", "term", F.col("weight").alias("_root"))
    products = (
        weights.where(F.col("pos") > 0).join(root, ["thread_id", "term"])
        .groupBy("thread_id", "pos").agg(F.sum(F.col("weight") * F.col("_root")).alias("similarity"))
    )
    return posts.where(F.col("pos") > 0).join(products, ["thread_id", "pos"], "left").withColumn(
        "similarity", F.coalesce("similarity", F.lit(0.0)))


def exemplars(similar: DataFrame, label: str = "label", k: int = 2, decimals: int = 9) -> DataFrame:
    """The k replies of each label that are most like the root; ties go to the later reply.

    Similarities are rounded before ranking, so equal texts tie whatever the order of their sums.
    """
    ranked = similar.withColumn("_sim", F.round("similarity", decimals))
    return top_k(ranked, ["thread_id", label], [F.desc("_sim"), F.desc("pos")], k, ["pos"]).drop("_sim")


def top_words(contributions: DataFrame, k: int = 20) -> DataFrame:
    """The k non-zero contributions of each thread with the largest absolute value; ties go to the word."""
    return top_k(contributions.where(F.col("contribution") != 0), ["thread_id"],
                 [F.desc(F.abs("contribution")), F.col("word")], k, ["word"])


def fidelity(threads: DataFrame, surrogate: str, black_box: str) -> DataFrame:
    """Share of threads on which the surrogate's label equals the black box's."""
    return threads.agg(
        F.avg((F.col(surrogate) == F.col(black_box)).cast("double")).alias("fidelity"), F.count("*").alias("n_threads"))
