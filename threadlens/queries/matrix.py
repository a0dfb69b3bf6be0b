"""The whole feature matrix and what is learned from text for it, over every document."""

from __future__ import annotations

from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.ml.stat import Summarizer
from pyspark.sql import functions as F

from threadlens import lexicons as lex
from threadlens.functions import text as tx
from threadlens.operators import features as ft
from threadlens.operators import relational as rel
from threadlens.operators import splits as sp
from threadlens.operators.shared_tuning import fit_chain
from threadlens.operators.traits import fit_traits
from threadlens.queries import features, models
from threadlens.queries import fixtures as fx
from threadlens.queries.registry import query
from threadlens.session import materialize

COUNTS = ["avg_word_count", "emoji_count", "slang_count", "capitalized_count", "full_capitalized_count", "retweets_count",
          "user_mentions_count", "hashtags_count", "url_count"]
SEVEN = rel.group_columns(["personality"])
TEN = [*SEVEN, "admiration", "narcissism", "rivalry"]


def text_features(spark, sf_dir):
    """(doc_id, tfidf, features, counts): TF-IDF of the cleaned text, and it together with the counts of the text."""
    posts = fx.posts(spark, sf_dir)
    columns = ft.readability_columns(F.col("text"))
    cleaned = tx.clean_text(tx.clean_relics(F.col("text")))
    base = materialize(posts.select("doc_id", *[columns[n].cast("double").alias(n) for n in COUNTS], cleaned.alias("text")), "matrix-text")
    tfidf = ft.fit_tfidf(base, "text", 1, 3, lex.english_stop_words())
    vectors = tfidf.transform(base, "text").drop("text")
    whole = VectorAssembler(inputCols=["tfidf", *COUNTS], outputCol="features").transform(vectors)
    return materialize(whole, "matrix-features")


def planted(rows, names):
    """Trait values of a row: sums of its counts with weights that differ by trait."""
    return rows.withColumns({
        name: sum((F.col(c) * (((3 * k + 5 * j) % 7 - 3) * 0.25) for j, c in enumerate(COUNTS)), F.lit(float(k)))
        for k, name in enumerate(names)})


def trait_scores(spark, sf_dir, rows):
    """(doc_id, seven traits) of every document, fitted on the labelled ones."""
    labelled = rows.join(fx.table(spark, sf_dir, "labels").select("doc_id"), "doc_id", "left_semi")
    return fit_traits(planted(labelled, SEVEN), SEVEN).transform(rows).select("doc_id", *SEVEN)


@query("feat_text_traits")
def feat_text_traits(spark, sf_dir):
    """Seven trait scores of every document from its TF-IDF and counts."""
    return trait_scores(spark, sf_dir, text_features(spark, sf_dir))


@query("clf_chain_text")
def clf_chain_text(spark, sf_dir):
    """Ten traits in three bins as chained labels over the TF-IDF of the text; predictions for the held-out quarter."""
    rows = planted(text_features(spark, sf_dir), TEN)
    binned = ft.equal_width_bins(rows, TEN, 3).select("doc_id", F.col("tfidf").alias("features"), *[F.col(t).cast("double") for t in TEN])
    data = materialize(sp.train_test(binned, ["doc_id"], 25), "text-traits")
    chain = fit_chain(data.where("is_test = 0"), TEN)
    scored = chain.transform(data.where("is_test = 1"))
    return scored.select("doc_id", *[F.col(t).cast("int").alias(t) for t in TEN],
                         *[F.col(f"pred_{t}").cast("int").alias(f"pred_{t}") for t in TEN])


def scaled_terms(matrix, column):
    """A vector column as an array with every component scaled to [0, 1]; a constant one is 0. The ranges are two arrays
    as long as the vocabulary."""
    low, high = (list(map(float, v)) for v in matrix.select(
        Summarizer.metrics("min", "max").summary(F.col(column)).alias("s")).select("s.min", "s.max").first())
    ranges = [F.array(*[F.lit(v) for v in x]) for x in (low, [h - a for a, h in zip(low, high, strict=True)])]
    moved = F.zip_with(vector_to_array(column), ranges[0], lambda x, a: x - a)
    return F.zip_with(moved, ranges[1], lambda x, w: F.when(w > 0, x / w).otherwise(F.lit(0.0)))


@query("feat_matrix_full")
def feat_matrix_full(spark, sf_dir):
    """All feature groups of every document with its label, raw and scaled (scaled_ in front): TF-IDF, readability,
    sentiment, traits, gender and external scores. Key and label are not scaled; what a group lacks is null."""
    rows = text_features(spark, sf_dir)
    posts = fx.posts(spark, sf_dir)
    sentiment = ft.sentiment(posts, "doc_id", "text", fx.word_scores(spark)).select("doc_id", *rel.group_columns(["sentiment"]))
    traits = trait_scores(spark, sf_dir, rows)
    gender = models.feat_gender_predict(spark, sf_dir)
    external = features.feat_external_scores(spark, sf_dir).drop("size_k")
    labels = fx.table(spark, sf_dir, "labels").select("doc_id", F.col("quality").cast("double").alias("ground_truth"))
    counts = rows.select("doc_id", "tfidf", *COUNTS)
    raw = materialize(rel.full_outer_features([counts, sentiment, traits, gender, external, labels], "doc_id"), "raw-matrix")
    scalars = [c for c in raw.columns if c not in ("doc_id", "tfidf", "ground_truth")]
    copies = raw.select("*", *[F.col(c).cast("double").alias(f"scaled_{c}") for c in scalars])
    scaled = ft.min_max_scale(copies, [f"scaled_{c}" for c in scalars])
    return scaled.withColumn("scaled_tfidf", scaled_terms(raw, "tfidf")).withColumn("tfidf", vector_to_array("tfidf"))
