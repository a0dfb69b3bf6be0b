"""Collection: statuses and posts to nested threads with the authors' history."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from threadlens.functions import text as tx
from threadlens.operators import relational as rel


def candidate_roots(statuses: DataFrame, min_followers: int = 5000) -> DataFrame:
    """(root_id, user_id, root_date) of dated statuses by accounts with enough followers."""
    dated = statuses.na.drop(subset=["created_at"])
    return rel.filter_min_followers(dated, "followers_count", min_followers).select(
        F.col("id").alias("root_id"), "user_id", tx.post_date(F.col("created_at")).alias("root_date"))


def collect_threads(roots: DataFrame, posts: DataFrame, low: int = 10, high: int = 200, history: int = 100) -> DataFrame:
    """Long threads (thread_id, pos, user_id, tweet_text, text) of the roots.

    roots(root_id, conversation_id, root_date), posts(post_id, conversation_id, user_id, ts, text).
    ``text`` is the author's latest posts; posts of authors without history are dropped.
    """
    replies = rel.match_replies(
        roots, posts.select(F.col("post_id").alias("reply_id"), "conversation_id", "ts")
    ).select(F.col("root_id").alias("thread_id"), F.col("reply_id").alias("post_id"))
    members = replies.unionByName(roots.select(F.col("root_id").alias("thread_id"), F.col("root_id").alias("post_id")))
    sized = rel.filter_thread_size(members, "thread_id", F.col("post_id") != F.col("thread_id"), low, high)
    past = rel.recent_history(posts, "user_id", [F.desc("ts"), F.desc("post_id")], ["post_id"], "text", history)
    full = sized.join(posts.select("post_id", "user_id", "ts", F.col("text").alias("tweet_text")), "post_id")
    # threads hold at most `high` replies here, so the rank inside a thread is a small window
    is_reply = (F.col("post_id") != F.col("thread_id")).cast("int")
    order = Window.partitionBy("thread_id").orderBy(is_reply, "ts", "post_id")
    return rel.attach_history(full, past.select("user_id", F.col("history").alias("text")), "user_id").select(
        "thread_id", (F.row_number().over(order) - 1).cast("long").alias("pos"), "user_id", "tweet_text", "text",
        "post_id")
