"""Projections, filters, joins, aggregates and set operations over posts, users and threads."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from threadlens.functions import text as tx
from threadlens.operators.skew import global_position, top_k

# Names of the trait scores in the feature matrix.
TRAIT_NAMES = {
    "ANXIETY": "anxiety", "E": "extraversion", "A": "agreeableness", "O": "openness", "C": "conscientiousness",
    "N": "neuroticism", "AVOIDANCE": "avoidance",
}

# Feature groups of the matrix.
FEATURE_GROUPS = {
    "tfidf": ["tfidf"],
    "readability": ["avg_word_count", "emoji_count", "slang_count", "capitalized_count", "full_capitalized_count",
                    "retweets_count", "user_mentions_count", "hashtags_count", "url_count"],
    "sentiment": ["anger", "fear", "joy", "sadness", "negation", "vader_compound_score", "textblob_polarity_score"],
    "personality": ["extraversion", "avoidance", "conscientiousness", "openness", "neuroticism", "agreeableness",
                    "anxiety"],
    "gender": ["gender"],
    "liwc": ["Analytic", "Clout", "Authentic", "Tone"],
}


def rename_traits(df: DataFrame, drop: list[str] = ()) -> DataFrame:
    return df.withColumnsRenamed(TRAIT_NAMES).drop(*drop)


def group_columns(groups: list[str]) -> list[str]:
    unknown = [g for g in groups if g not in FEATURE_GROUPS]
    if unknown:
        raise KeyError(f"unknown feature groups: {unknown}")
    return [c for g in groups for c in FEATURE_GROUPS[g]]


def select_feature_groups(df: DataFrame, key: str, groups: list[str], label: str | None = None) -> DataFrame:
    return df.select(key, *group_columns(groups), *([label] if label else []))


def thread_sizes(posts: DataFrame, thread: str, is_reply: Column) -> DataFrame:
    return posts.groupBy(thread).agg(F.count_if(is_reply).alias("n_replies"))


def filter_thread_size(posts: DataFrame, thread: str, is_reply: Column, low: int = 10, high: int = 200) -> DataFrame:
    """Rows of the threads with low <= replies <= high; adds n_replies.

    Counts are combined before the shuffle, so an oversized thread costs one row per task here, and
    everything downstream sees at most ``high`` replies per thread.
    """
    kept = thread_sizes(posts, thread, is_reply).where(F.col("n_replies").between(low, high))
    return posts.join(kept, thread)


def filter_nested_thread_size(threads: DataFrame, replies: str = "replies", low: int = 10, high: int = 200):
    return threads.where(F.size(replies).between(low, high))


def filter_min_followers(df: DataFrame, followers: str, minimum: float = 5000) -> DataFrame:
    return df.where(F.col(followers) >= minimum)


def filter_language_keywords(df: DataFrame, lang: str, text: str, keywords: list[str], language: str = "en"):
    return df.where((F.col(lang) == language) & tx.keyword_match(F.col(text), keywords))


def fill_id(value: Column) -> Column:
    """Missing ids become 0; ids are long."""
    return F.coalesce(value, F.lit("0")).cast("long")


def slice_rows(df: DataFrame, order: str, start: int, stop: int) -> DataFrame:
    """Rows start..stop-1 in the order of a unique column, without sorting the table in one place."""
    return global_position(df, order).where((F.col("pos") >= start) & (F.col("pos") < stop))


def full_outer_features(tables: list[DataFrame], key: str) -> DataFrame:
    """Full outer join of tables that hold each key at most once.

    All tables go through one shuffle: their rows are stacked and folded per key. A key that
    occurs twice in one table is an error.
    """
    stacked = reduce(
        lambda a, b: a.unionByName(b, allowMissingColumns=True),
        [t.withColumn(f"_in_{i}", F.lit(1)) for i, t in enumerate(tables)],
    )
    values = [c for t in tables for c in t.columns if c != key]
    folded = stacked.groupBy(key).agg(
        *[F.any_value(c, F.lit(True)).alias(c) for c in values],
        F.greatest(*[F.count(f"_in_{i}") for i in range(len(tables))], F.lit(0)).alias("_copies"),
    )
    checked = F.when(F.col("_copies") > 1, F.raise_error(F.lit(f"duplicate {key}")).cast("boolean")).otherwise(True)
    return folded.where(checked).select(key, *values)


def match_replies(roots: DataFrame, posts: DataFrame, days: int = 5) -> DataFrame:
    """Replies of each root: same conversation, another id, dated from the root's day until ``days`` later.

    roots(root_id, conversation_id, root_date), posts(reply_id, conversation_id, ts). A conversation
    has one root, so the output is linear in the posts and AQE may split a hot conversation.
    """
    until = F.date_add("root_date", days)
    return (
        posts.join(roots, "conversation_id")
        .where((F.col("reply_id") != F.col("root_id"))
               & (F.to_date("ts") >= F.col("root_date")) & (F.to_date("ts") < until))
    )


def lexicon_hits(df: DataFrame, key: str, text: str, lexicon: DataFrame, word: str) -> DataFrame:
    """Tokens found in a lexicon, counted per key; keys without hits count 0.

    Tokens are counted per key before they meet the lexicon, so a word that every text has is one row per key there;
    keys without hits are added afterwards.
    """
    tokens = df.select(key, F.explode(tx.whitespace_tokens(F.lower(text))).alias("_token"))
    entries = lexicon.select(F.col(word).alias("_token")).distinct()
    counts = tokens.groupBy(key, "_token").agg(F.count("*").alias("_n"))
    hits = counts.join(entries, "_token").groupBy(key).agg(F.sum("_n").alias("hits"))
    return df.select(key).distinct().join(hits, key, "left").select(key, F.coalesce("hits", F.lit(0)).alias("hits"))


def recent_history(posts: DataFrame, author: str, order: list[Column], unique: list[str], text: str, k: int = 100):
    """Text of each author's k latest posts, latest first, as one string of bounded length."""
    latest = top_k(posts, [author], order, k, unique)
    return latest.groupBy(author).agg(
        F.concat_ws("", F.transform(
            F.array_sort(F.collect_list(F.struct("rank", text))), lambda p: p[text]
        )).alias("history"),
        F.count("*").alias("n_posts"),
    )


def attach_history(posts: DataFrame, history: DataFrame, author: str) -> DataFrame:
    """Authors without history are dropped."""
    return posts.join(history, author)


def nest_replies(posts: DataFrame, thread: str, pos: str, columns: list[str]) -> DataFrame:
    """One row per thread with its replies as an ordered array, empty for a root without replies."""
    return posts.groupBy(thread).agg(
        F.array_sort(F.collect_list(F.when(F.col(pos) > 0, F.struct(pos, *columns)))).alias("replies"),
        F.count_if(F.col(pos) > 0).alias("n_replies"),
        *[F.max(F.when(F.col(pos) == 0, F.col(c))).alias(c) for c in columns],
    )


def _in_order(rows: DataFrame, key: str, order: str, value: str, width: int) -> DataFrame:
    """(key, _items): the values of a key in order. Ranges of ``width`` order values are sorted apart, so the sorting
    of a hot key is shared by many tasks; its last step only puts sorted ranges one behind the other."""
    ranges = rows.groupBy(key, F.floor(F.col(order) / F.lit(width)).alias("_range")).agg(
        F.transform(F.array_sort(F.collect_list(F.struct(order, value))), lambda p: p[value]).alias("_part"))
    return ranges.groupBy(key).agg(
        F.flatten(F.transform(F.array_sort(F.collect_list(F.struct("_range", "_part"))), lambda r: r["_part"]))
        .alias("_items"))


def ordered_parts(rows: DataFrame, key: str, order: str, columns: list[str], width: int = 4096) -> DataFrame:
    """(key, part, items, n): the rows of a key in order, in parts of at most ``width`` rows.

    ``order`` is a whole number that is unique inside a key; part p holds the orders from p * width on, so parts one
    behind the other are the whole group, a row's part follows from the row alone, and no cell or task holds a key of any
    size. Rows without an order are in no part's range: they form the part null, which is as large as there are of them.
    """
    return rows.groupBy(key, F.floor(F.col(order) / F.lit(width)).alias("part")).agg(
        F.array_sort(F.collect_list(F.struct(order, *columns))).alias("items"), F.count("*").alias("n"))


def concat_parts(posts: DataFrame, user: str, order: str, text: str, width: int = 4096) -> DataFrame:
    """(user, part, corpus, n_posts): the posts of a user in order, concatenated part by part; a null text adds nothing."""
    return ordered_parts(posts, user, order, [text], width).select(
        user, "part", F.array_join(F.transform("items", lambda p: p[text]), "").alias("corpus"), F.col("n").alias("n_posts"))


def nest_parts(posts: DataFrame, thread: str, pos: str, columns: list[str], width: int = 4096) -> DataFrame:
    """(thread, part, replies, n_replies): the replies of a thread as ordered arrays, part by part; the root is no reply."""
    return ordered_parts(posts.where(F.col(pos) > 0), thread, pos, columns, width).withColumnsRenamed(
        {"items": "replies", "n": "n_replies"})


def concat_posts(posts: DataFrame, user: str, order: str, text: str, width: int = 4096) -> DataFrame:
    """All posts of a user in order, with nothing between them; one row per user, however many posts."""
    return _in_order(posts, user, order, text, width).select(
        user, F.array_join("_items", "").alias("corpus"), F.size("_items").cast("long").alias("n_posts"))


def list_replies(replies: DataFrame, root: str, order: str, reply_id: str, width: int = 65536) -> DataFrame:
    """Ordered reply ids, one row per root."""
    return _in_order(replies, root, order, reply_id, width).withColumnRenamed("_items", "reply_ids")


def last_per_key(df: DataFrame, key: str, order: str) -> DataFrame:
    """The last row of each key; later entries replace earlier ones."""
    others = [c for c in df.columns if c != key]
    return df.groupBy(key).agg(F.max_by(F.struct(*others), order).alias("_last")).select(key, "_last.*")


def distinct_first(df: DataFrame, columns: list[str], order: str) -> DataFrame:
    """One row per distinct value of the columns, the first by ``order``.

    Rows are shuffled by a 256-bit digest of the values, their length and presence, and collapse before that; the
    values of the winner travel with it once per task.
    """
    values = F.struct(*columns)
    digest = F.sha2(F.to_json(values, {"ignoreNullFields": "false"}), 256)
    return df.groupBy(digest.alias("_digest")).agg(F.min(order).alias(order), F.any_value(values).alias("_values")).select(
        "_values.*", order)


def reply_stats(sizes: DataFrame) -> DataFrame:
    return sizes.agg(
        F.count("*").alias("n_threads"), F.sum("n_replies").alias("n_replies"), F.avg("n_replies").alias("mean_replies")
    )


def thread_homophily(posts: DataFrame, thread: str, pos: str, label: str) -> DataFrame:
    """Per thread: distinct reply labels, whether there are other than two, and the first reply's label."""
    replies = posts.where(F.col(pos) > 0)
    return replies.groupBy(thread).agg(
        F.count_distinct(label).alias("n_labels"), F.min_by(label, pos).alias("first_label"),
        F.count("*").alias("n_replies"),
    ).withColumn("homophilous", (F.col("n_labels") != 2).cast("int"))


def min_max(df: DataFrame, columns: list[str]) -> DataFrame:
    return df.agg(*[f(c).alias(f"{f.__name__}_{c}") for c in columns for f in (F.min, F.max)])


def best_by(df: DataFrame, score: str, position: str, name: str, last_wins: bool = True) -> DataFrame:
    """The best-scored row; ties go to the last position, or to the first."""
    tie = F.col(position) if last_wins else -F.col(position)
    return df.agg(F.max_by(name, F.struct(F.col(score), tie)).alias("best"), F.max(score).alias("best_score"))


def stratified_sample(df: DataFrame, label: str, token: Column, unique: str, n: int = 100) -> DataFrame:
    """Exactly n rows per class (all rows of a smaller class), chosen by the smallest tokens."""
    tagged = df.withColumn("_token", token)
    picked = top_k(tagged, [label], [F.col("_token"), F.col(unique)], n, [unique])
    return picked.drop("_token", "rank")


def with_grid(df: DataFrame, grid: list[float], name: str) -> DataFrame:
    """Each row once per grid value. The grid is a literal array, so this is a generator and not a join."""
    return df.withColumn(name, F.explode(F.array(*[F.lit(float(g)) for g in grid])))
