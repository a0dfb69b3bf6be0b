"""Feature build: posts and labels to the behavioural matrix, raw and scaled."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from threadlens import lexicons as lex
from threadlens.functions import text as tx
from threadlens.operators import features as ft
from threadlens.operators import relational as rel


@dataclass
class Lexicons:
    """Word lists in use; tables of word scores are DataFrames (word, valence, polarity)."""

    word_scores: DataFrame
    slang: list[str] = field(default_factory=lambda: lex.SEED_SLANG)
    emoji: list[tuple] = field(default_factory=lambda: lex.SEED_EMOJI)


def user_corpora(posts: DataFrame, truth: DataFrame) -> DataFrame:
    """(user_id, corpus, n_posts, ground_truth) from posts(user_id, post_pos, text) and labels."""
    return rel.concat_posts(posts, "user_id", "post_pos", "text").join(truth, "user_id")


def build_matrix(users: DataFrame, lexicons: Lexicons, raw_path: str, scaled_path: str,
                 extra: list[DataFrame] = (), tfidf: ft.TfIdf | None = None) -> ft.TfIdf:
    """Write the raw and the scaled matrix of users(user_id, text, ground_truth); returns the TF-IDF model.

    Readability counts see the text as it is, sentiment sees it without markers, TF-IDF sees the
    cleaned text. ``extra`` tables (trait scores, gender, external scores) join by user_id. The raw
    matrix is written once and scaled from there; label and key are not scaled.
    """
    spark = users.sparkSession
    text = F.col("text")
    cleaned = users.select("user_id", tx.clean_text(tx.clean_relics(text)).alias("text"))
    tfidf = tfidf or ft.fit_tfidf(cleaned, "text", 1, 3, lex.english_stop_words())
    counts = users.select(
        "user_id", "ground_truth",
        *[c.alias(n) for n, c in ft.readability_columns(text, lexicons.slang).items()],
        *[c.alias(n) for n, c in ft.emotion_columns(tx.clean_relics(text), lexicons.emoji).items()])
    bare = users.select("user_id", tx.clean_relics(text).alias("text"))
    scores = ft.word_scores(bare, "user_id", "text", lexicons.word_scores).drop("scored_words")
    vectors = tfidf.transform(cleaned, "text").drop("text")
    rel.full_outer_features([vectors, counts, scores, *extra], "user_id").write.mode("overwrite").parquet(raw_path)
    raw = spark.read.parquet(raw_path)
    scalars = [f.name for f in raw.schema if f.name not in ("user_id", "ground_truth", "tfidf")]
    ft.min_max_scale(raw, scalars).write.mode("overwrite").parquet(scaled_path)
    return tfidf
