"""Thread explanation: nested threads to result tables, word weights and example replies."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from threadlens import lexicons as lex
from threadlens.functions import text as tx
from threadlens.operators import metrics as mt
from threadlens.operators import surrogate as sg
from threadlens.operators import threads as th
from threadlens.session import materialize


def explain(posts: DataFrame, black_box: Callable[[DataFrame], DataFrame]) -> dict:
    """Tables of one run over posts(thread_id, pos, user_id, tweet_text, text).

    ``black_box`` adds label and proba from ``text``, the author's history, and runs once over all
    posts; the per-thread part then works on ``tweet_text``. Threads of any size are explained; the size filter
    belongs to the collection.
    """
    scored = materialize(
        black_box(posts).select("thread_id", "pos", "user_id", "tweet_text", "text", "label", "proba"), "scored-posts")
    distinct = sg.distinct_posts(scored, ["user_id", "tweet_text", "text"]).withColumn(
        "clean", tx.clean_text_for_linear(F.col("tweet_text")))
    weights = materialize(th.thread_tfidf(distinct, "clean", lex.english_stop_words()), "term-weights")
    surrogates = materialize(sg.thread_surrogates(distinct, weights), "surrogates")
    shown = scored.select("thread_id", "pos", F.col("tweet_text").alias("text"), "label", "proba")
    results = sg.explain_threads(shown, surrogates)
    mixed = distinct.select("thread_id", "pos", F.col("tweet_text").alias("text"), "label").join(
        sg.mixed_threads(distinct), "thread_id", "left_semi")
    return {
        "results": results,
        "homophily": sg.homophily_report(shown),
        "words": sg.word_table(surrogates),
        "exemplars": th.exemplars(th.reply_similarity(mixed, weights)),
        "fidelity": th.fidelity(results, "lr_pred", "bb_pred"),
        "agreement": mt.probability_agreement(results, "bb_proba", "lr_proba"),
    }
