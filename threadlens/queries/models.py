"""Splits, classifiers, tuning and selection over every vector and labelled document.

Learned weights have no SQL equivalent; rules and counts do. Grids are small here, the full search
spaces are ``classifiers.GRIDS``.
"""

from __future__ import annotations

from pyspark.ml import PipelineModel
from pyspark.ml.regression import LinearRegression
from pyspark.sql import functions as F

from threadlens import lexicons as lex
from threadlens.functions import text as tx
from threadlens.functions.vectors import as_vector
from threadlens.operators import classifiers as cl
from threadlens.operators import features as ft
from threadlens.operators import shared_trees as st
from threadlens.operators import splits as sp
from threadlens.queries import fixtures as fx
from threadlens.queries.registry import query
from threadlens.sources.readers import spread
from threadlens.session import materialize, scratch_path

M = fx.ARITHMETIC


def vectors(spark, sf_dir):
    """(id, features, label): the label follows from the first three components."""
    x = F.col("embedding")
    return spread(fx.table(spark, sf_dir, "embeddings")).select(
        F.col("vec_id").alias("id"), as_vector(x).alias("features"),
        (x[0] + x[1] - x[2] > 0).cast("double").alias("label"))


def counts_matrix(spark, sf_dir):
    """(id, features, label): non-negative text counts of the labelled documents."""
    posts = ft.readability(fx.posts(spark, sf_dir), ["doc_id"], "text")
    names = ["emoji_count", "slang_count", "capitalized_count", "full_capitalized_count", "retweets_count"]
    labels = fx.table(spark, sf_dir, "labels").select("doc_id", F.col("quality").cast("double").alias("label"))
    return posts.join(labels, "doc_id").select(
        F.col("doc_id").alias("id"), as_vector(F.array(*[F.col(n).cast("double") for n in names])).alias("features"),
        "label")


# ---- splits ----------------------------------------------------------------------------------


@query("split_train_test", f"""SELECT vec_id AS id, CAST({fx.arithmetic_sql('vec_id', 42)} < {M * 20 // 100} AS INTEGER) AS is_test,
  CAST({fx.arithmetic_sql('vec_id', 7)} < {M * 25 // 100} AS INTEGER) AS is_quarter FROM embeddings""")
def split_train_test(spark, sf_dir):
    ids = fx.table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"))
    fifth = sp.train_test(ids, ["id"], 20, token=fx.arithmetic_token("id", 42), modulus=M)
    quarter = sp.train_test(fifth.withColumnRenamed("is_test", "_fifth"), ["id"], 25,
                            token=fx.arithmetic_token("id", 7), modulus=M)
    return quarter.select("id", F.col("_fifth").alias("is_test"), F.col("is_test").alias("is_quarter"))


@query("split_shuffle_cv", "SELECT vec_id AS id, " + ", ".join(
    f"CAST({fx.arithmetic_sql('vec_id', i)} < {M * 33 // 100} AS INTEGER) AS split_{i}" for i in range(3))
    + " FROM embeddings")
def split_shuffle_cv(spark, sf_dir):
    ids = fx.table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"))
    return sp.shuffle_splits(ids, ["id"], 3, 33, token=lambda i: fx.arithmetic_token("id", i), modulus=M)


@query("split_kfold", f"SELECT vec_id AS id, CAST({fx.arithmetic_sql('vec_id')} % 10 AS INTEGER) AS fold FROM embeddings")
def split_kfold(spark, sf_dir):
    ids = fx.table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"))
    return sp.k_folds(ids, ["id"], 10, token=fx.arithmetic_token("id"))


@query("split_repeated_stratified", "SELECT doc_id, quality, " + ", ".join(
    f"CAST((row_number() OVER (PARTITION BY quality ORDER BY {fx.arithmetic_sql('doc_id', i)}, doc_id) - 1) % 10 AS INTEGER)"
    f" AS fold_{i}" for i in range(3)) + " FROM labels")
def split_repeated_stratified(spark, sf_dir):
    labels = fx.table(spark, sf_dir, "labels").select("doc_id", "quality")
    return sp.stratified_folds(labels, "quality", ["doc_id"], 10, 3,
                               token=lambda i: fx.arithmetic_token("doc_id", i), modulus=M)


# ---- classifiers -----------------------------------------------------------------------------


def _held_out(spark, sf_dir, name, data=None, **params):
    """Predictions for the held-out fifth of a fit on the rest."""
    data = sp.train_test(vectors(spark, sf_dir) if data is None else data, ["id"])
    fitted = cl.fit(name, data.where("is_test = 0"), **params)
    return cl.predictions(fitted, data.where("is_test = 1"), ["id"])


@query("clf_logistic")
def clf_logistic(spark, sf_dir):
    return _held_out(spark, sf_dir, "logistic", c=1.0, maxIter=30)


@query("clf_linear_svm")
def clf_linear_svm(spark, sf_dir):
    """Linear, polynomial and radial margins side by side."""
    runs = {"svm_linear": {"c": 1.0}, "svm_poly": {"c": 1.0, "degree": 2}, "svm_rbf": {"c": 1.0, "gamma": 1.0}}
    return cl.stack([
        _held_out(spark, sf_dir, name, maxIter=10, **p).withColumn("kernel", F.lit(name)) for name, p in runs.items()])


@query("clf_svm_poly_sketch")
def clf_svm_poly_sketch(spark, sf_dir):
    """Margins of the polynomial kernel of degree 3, sketched instead of expanded to 47,904 monomials."""
    return _held_out(spark, sf_dir, "svm_poly", c=1.0, degree=3, maxIter=10)


@query("clf_random_forest")
def clf_random_forest(spark, sf_dir):
    return _held_out(spark, sf_dir, "random_forest", numTrees=200, maxDepth=20)


@query("clf_gradient_boosting")
def clf_gradient_boosting(spark, sf_dir):
    return _held_out(spark, sf_dir, "gradient_boosting", maxIter=15, maxDepth=3, stepSize=0.3)


@query("clf_mlp")
def clf_mlp(spark, sf_dir):
    return _held_out(spark, sf_dir, "neural_network", hidden=(100, 100, 100), maxIter=200)


@query("clf_naive_bayes", f"""WITH {fx.POSTS_SQL},
tok AS (SELECT doc_id, unnest({fx.sql_word_tokens('text', lex.english_stop_words())}) AS term FROM posts),
n AS (SELECT quality AS label, term, count(*) AS n FROM tok JOIN labels USING (doc_id) GROUP BY ALL),
t AS (SELECT label, sum(n) AS total FROM n GROUP BY label), v AS (SELECT count(DISTINCT term) AS v FROM n),
g AS (SELECT DISTINCT label, term FROM (SELECT DISTINCT term FROM n) CROSS JOIN (VALUES (0), (1)) AS c(label))
SELECT g.label, term, round(ln((coalesce(n, 0) + 1.0) / (total + 1.0 * v)), 6) AS log_likelihood
FROM g LEFT JOIN n USING (label, term) JOIN t ON t.label = g.label, v""")
def clf_naive_bayes(spark, sf_dir):
    """Word likelihoods per class of the labelled documents."""
    words = tx.word_tokens(F.col("text"), lex.english_stop_words())
    labels = fx.table(spark, sf_dir, "labels").selectExpr("doc_id", "quality AS label")
    occurrences = fx.posts(spark, sf_dir).join(labels, "doc_id").select(
        "label", F.explode(words).alias("term"), F.lit(1).alias("tf"))
    return cl.naive_bayes_counts(occurrences).withColumn("log_likelihood", F.round("log_likelihood", 6))


@query("clf_naive_bayes_model")
def clf_naive_bayes_model(spark, sf_dir):
    """Multinomial model on text counts with a uniform class prior."""
    return _held_out(spark, sf_dir, "naive_bayes", data=counts_matrix(spark, sf_dir), smoothing=1.0, fit_prior=False)


@query("clf_knn", f"""WITH v AS (SELECT vec_id AS id, CAST(embedding AS DOUBLE[]) AS x,
  CAST(embedding[1] + embedding[2] - embedding[3] > 0 AS INTEGER) AS label,
  {fx.arithmetic_sql('vec_id', 42)} < {M * 20 // 100} AS is_test FROM embeddings),
d AS (SELECT q.id AS query_id, t.id, t.label, row_number() OVER (PARTITION BY q.id ORDER BY list_distance(q.x, t.x), t.id) AS r
  FROM v q, v t WHERE q.is_test AND NOT t.is_test),
n AS (SELECT query_id, label, count(*) AS n FROM d WHERE r <= 5 GROUP BY ALL)
SELECT query_id, arg_max(label, n * 10 - label) AS prediction FROM n GROUP BY query_id""")
def clf_knn(spark, sf_dir):
    rows = fx.table(spark, sf_dir, "embeddings").select(
        F.col("vec_id").alias("id"), F.col("embedding").cast("array<double>").alias("x"),
        (F.col("embedding")[0] + F.col("embedding")[1] - F.col("embedding")[2] > 0).cast("int").alias("label"))
    rows = sp.train_test(rows, ["id"], 20, token=fx.arithmetic_token("id", 42), modulus=M)
    near = cl.nearest_neighbours(rows.where("is_test = 1").select(F.col("id").alias("query_id"), "x"),
                                 rows.where("is_test = 0").select(F.col("id").alias("train_id"), "label", "x"), 5)
    return cl.vote(near)


# ---- tuning and selection --------------------------------------------------------------------


@query("tune_grid")
def tune_grid(spark, sf_dir):
    """The whole grid of the logistic model on three random splits, trained together."""
    return cl.grid_search("logistic", vectors(spark, sf_dir), ["id"]).table(spark)


@query("tune_random")
def tune_random(spark, sf_dir):
    """Fifty draws from the random-search space of the logistic model on three folds, trained together."""
    return cl.random_search("logistic", vectors(spark, sf_dir), ["id"]).table(spark)


#: Classifiers that are compared; the logistic model's space is whole, the others' are smaller than theirs.
COMPARED = {"svm_linear": {"c": [0.01], "maxIter": [10]}, "decision_tree": {"maxDepth": [5, 10]}, "logistic": None}


@query("select_classifier_report")
def select_classifier_report(spark, sf_dir):
    """Accuracy, class report and ten-fold means of each classifier, ranked."""
    _, _, rows = cl.compare_classifiers(materialize(vectors(spark, sf_dir), "vectors"), ["id"], COMPARED)
    return spark.createDataFrame(rows, cl.REPORT_SCHEMA)


@query("select_best_classifier")
def select_best_classifier(spark, sf_dir):
    """The best of the compared classifiers refitted on all rows, saved, loaded and applied."""
    data = materialize(vectors(spark, sf_dir), "vectors")
    _, best, rows = cl.compare_classifiers(data, ["id"], COMPARED)
    path = scratch_path(spark, "best-model")
    best.save(path)
    scores = ", ".join(f"{r[0]}={r[13]:.4f}" for r in rows)
    again = cl.Fitted.load(spark, best.name, path)
    return cl.predictions(again, data, ["id"]).withColumn("best", F.lit(best.name)).withColumn("scores", F.lit(scores))


@query("select_rfe")
def select_rfe(spark, sf_dir):
    kept = cl.eliminate_features(materialize(vectors(spark, sf_dir), "vectors"), keep=16, step=16, max_depth=6)
    return spark.createDataFrame([(i, f) for i, f in enumerate(kept)], "position int, feature int")


@query("select_rfe_curve")
def select_rfe_curve(spark, sf_dir):
    """Elimination inside each of 10 x 3 stratified folds down to all sizes, one feature a step, boosted trees on each
    (25 rounds at rate 0.3; the operator's default is 100 at 0.1)."""
    tagged = materialize(sp.stratified_folds(vectors(spark, sf_dir), "label", ["id"], 10, 3), "vectors")
    rows = st.elimination_curve(tagged, [(f"fold_{r}", v) for r in range(3) for v in range(10)], depth=6,
                                rounds=25, rate=0.3)
    return spark.createDataFrame(rows, st.CURVE_SCHEMA)


@query("learning_curve_table")
def learning_curve_table(spark, sf_dir):
    rows = cl.learning_curve("logistic", materialize(vectors(spark, sf_dir), "vectors"), ["id"], n_splits=2, maxIter=5)
    return spark.createDataFrame(rows, cl.LEARNING_CURVE_SCHEMA)


@query("clf_chain_multioutput")
def clf_chain_multioutput(spark, sf_dir):
    """Three binned components as chained labels with three classes each."""
    x = F.col("embedding")
    raw = fx.table(spark, sf_dir, "embeddings").select(
        F.col("vec_id").alias("id"), as_vector(x).alias("features"),
        *[x[i].cast("double").alias(f"trait_{i}") for i in range(3)])
    traits = [f"trait_{i}" for i in range(3)]
    binned = ft.equal_width_bins(raw, traits, 3)
    data = materialize(sp.train_test(binned, ["id"], 25), "traits")
    chain = cl.fit_chain(data.where("is_test = 0").select("id", "features", *[F.col(t).cast("double") for t in traits]),
                         traits, max_iter=3)
    scored = chain.transform(data.where("is_test = 1"))
    return scored.select("id", *traits, *[F.col(f"pred_{t}").cast("int").alias(f"pred_{t}") for t in traits])


@query("clf_single_class_fallback", f"""WITH {fx.THREADS_SQL}
SELECT thread_id, CAST(CASE WHEN min(label) = max(label) THEN min(label) ELSE -1 END AS INTEGER) AS constant_label, count(*) AS n
FROM threads WHERE pos > 0 GROUP BY thread_id""")
def clf_single_class_fallback(spark, sf_dir):
    replies = fx.thread_posts(spark, sf_dir).where("pos > 0")
    return cl.single_class_label(replies, ["thread_id"]).withColumn(
        "constant_label", F.coalesce("constant_label", F.lit(-1)))


@query("clf_class_weights", """SELECT quality AS label, round((SELECT count(*) FROM labels)::DOUBLE /
  ((SELECT count(DISTINCT quality) FROM labels) * count(*)), 6) AS weight FROM labels GROUP BY quality""")
def clf_class_weights(spark, sf_dir):
    labels = fx.table(spark, sf_dir, "labels").selectExpr("quality AS label")
    return cl.class_weights(labels).withColumn("weight", F.round("weight", 6))


@query("model_score_batch")
def model_score_batch(spark, sf_dir):
    """Label and probability of every vector from a saved and reloaded model."""
    data = vectors(spark, sf_dir)
    path = scratch_path(spark, "model")
    cl.fit("logistic", data, maxIter=10).model.write().overwrite().save(path)
    return cl.predictions(cl.Fitted("logistic", PipelineModel.load(path)), data, ["id"])


@query("model_save_load", "SELECT vec_id AS id, TRUE AS equal FROM embeddings")
def model_save_load(spark, sf_dir):
    """Whether each prediction is the same before saving and after loading."""
    data = vectors(spark, sf_dir)
    fitted = cl.fit("random_forest", data, numTrees=5, maxDepth=4)
    path = scratch_path(spark, "model")
    fitted.model.write().overwrite().save(path)
    before = cl.predictions(fitted, data, ["id"]).select("id", F.col("proba").alias("before"))
    after = cl.predictions(cl.Fitted("random_forest", PipelineModel.load(path)), data, ["id"]).select(
        "id", F.col("proba").alias("after"))
    return before.join(after, "id").select("id", (F.col("before") == F.col("after")).alias("equal"))


# ---- model-based features --------------------------------------------------------------------


@query("feat_trait_scores", f"""SELECT vec_id AS id,
  round(embedding[1]::DOUBLE - embedding[2]::DOUBLE, 4) + 0.0 AS extraversion,
  round(embedding[3]::DOUBLE + 2 * embedding[4]::DOUBLE, 4) + 0.0 AS openness
FROM embeddings WHERE {fx.arithmetic_sql('vec_id', 42)} < {M * 20 // 100}""")
def feat_trait_scores(spark, sf_dir):
    """One linear regressor per trait, applied to the held-out vectors; the planted traits are linear."""
    x = F.col("embedding").cast("array<double>")
    data = spread(fx.table(spark, sf_dir, "embeddings")).select(
        F.col("vec_id").alias("id"), as_vector(x).alias("features"),
        (x[0] - x[1]).alias("extraversion"), (x[2] + x[3] * 2).alias("openness"))
    data = sp.train_test(data, ["id"], 20, token=fx.arithmetic_token("id", 42), modulus=M)
    scored = data.where("is_test = 1")
    traits = ["extraversion", "openness"]
    for trait in traits:
        model = LinearRegression(labelCol=trait, predictionCol=f"pred_{trait}", solver="normal")
        scored = model.fit(data.where("is_test = 0")).transform(scored)
    return scored.select("id", *[(F.round(f"pred_{t}", 4) + 0.0).alias(t) for t in traits])


@query("feat_gender_predict")
def feat_gender_predict(spark, sf_dir):
    """TF-IDF without stop list and the scalar counts, scaled with the stored ranges, through a naive Bayes model."""
    posts = fx.posts(spark, sf_dir)
    tfidf = ft.fit_tfidf(posts, "text", 1, 4)
    names = ["avg_word_count", "slang_count", "emoji_count", "capitalized_count", "full_capitalized_count",
             "retweets_count", "url_count"]
    columns = ft.readability_columns(F.col("text"))
    base = tfidf.transform(posts.select("doc_id", "text", *[columns[n].alias(n) for n in names]), "text").drop("text")
    scaled = ft.min_max_scale(materialize(base, "gender-base"), names)
    labels = fx.table(spark, sf_dir, "labels").select("doc_id", F.col("quality").cast("double").alias("label"))
    from pyspark.ml.feature import VectorAssembler

    assembled = VectorAssembler(inputCols=["tfidf", *names], outputCol="features").transform(scaled)
    fitted = cl.fit("naive_bayes", assembled.join(labels, "doc_id"), smoothing=1.0)
    return fitted.transform(assembled).select("doc_id", F.col("prediction").cast("int").alias("gender"))
