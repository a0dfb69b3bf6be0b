"""Explanations of threads and of scorers over every thread and vector."""

from __future__ import annotations

from pyspark.ml.classification import GBTClassifier, LogisticRegression
from pyspark.sql import functions as F

from threadlens import lexicons as lex
from threadlens.functions import text as tx
from threadlens.operators import explain as ex
from threadlens.operators import features as ft
from threadlens.operators import surrogate as sg
from threadlens.operators import threads as th
from threadlens.queries import fixtures as fx
from threadlens.queries.registry import query
from threadlens.queries.relational import WORD_WEIGHTS_SQL
from threadlens.sources.readers import spread
from threadlens.session import materialize

def scored_threads(spark, sf_dir):
    """Every post with the label and probability of a model trained on the role of the writer."""
    posts = fx.thread_posts(spark, sf_dir)
    posts = posts.withColumn("clean", tx.clean_text_for_linear(F.col("text")))
    tfidf = ft.fit_tfidf(posts, "clean", 1, 1, lex.english_stop_words())
    features = materialize(tfidf.transform(posts, "clean", "features"), "thread-features").withColumn(
        "role_label", (F.col("role") == "user").cast("double"))
    model = LogisticRegression(labelCol="role_label", regParam=0.05, maxIter=20).fit(features)
    scored = model.transform(features)
    return materialize(scored.select(
        "thread_id", "pos", "text", "clean", F.col("prediction").cast("int").alias("label"),
        ex.vector_to_array("probability")[1].alias("proba")), "scored-threads")


def _surrogates(posts):
    distinct = sg.distinct_posts(posts, ["text"])
    weights = th.thread_tfidf(distinct, "clean", lex.english_stop_words())
    return sg.thread_surrogates(distinct, weights)


@query("explain_thread_surrogate")
def explain_thread_surrogate(spark, sf_dir):
    posts = scored_threads(spark, sf_dir)
    return sg.explain_threads(posts, _surrogates(posts))


@query("explain_thread_words")
def explain_thread_words(spark, sf_dir):
    return sg.word_table(_surrogates(scored_threads(spark, sf_dir)), 20)


@query("explain_thread_exemplars", f"""WITH {WORD_WEIGHTS_SQL},
mixed AS (SELECT thread_id FROM threads WHERE pos > 0 GROUP BY thread_id HAVING count(DISTINCT label) = 2),
s AS (SELECT a.thread_id, a.pos, sum(a.weight * b.weight) AS s FROM weights a JOIN weights b
  ON a.thread_id = b.thread_id AND a.term = b.term AND a.pos > 0 AND b.pos = 0 GROUP BY ALL),
r AS (SELECT t.thread_id, t.pos, t.label, t.text, row_number() OVER (
  PARTITION BY t.thread_id, t.label ORDER BY round(coalesce(s, 0), 9) DESC, t.pos DESC) AS rank
  FROM threads t JOIN mixed USING (thread_id) LEFT JOIN s ON s.thread_id = t.thread_id AND s.pos = t.pos WHERE t.pos > 0)
SELECT thread_id, label, CAST(rank AS INTEGER) AS rank, text FROM r WHERE rank <= 2""")
def explain_thread_exemplars(spark, sf_dir):
    posts = fx.thread_posts(spark, sf_dir)
    kept = posts.join(sg.mixed_threads(posts), "thread_id", "left_semi")
    weights = materialize(th.thread_tfidf(kept, "text", lex.english_stop_words()), "weights")
    return th.exemplars(th.reply_similarity(kept, weights)).select("thread_id", "label", "rank", "text")


@query("explain_homophily_report", f"""WITH {fx.THREADS_SQL}
SELECT thread_id, max(text) FILTER (pos = 0) AS tweet_text, arg_min(label, pos) FILTER (pos > 0) AS homophily_pred,
  max(label) FILTER (pos = 0) AS bb_pred, count(*) FILTER (pos > 0) AS replies
FROM threads GROUP BY thread_id HAVING count(DISTINCT label) FILTER (pos > 0) <> 2 AND replies > 0""")
def explain_homophily_report(spark, sf_dir):
    return sg.homophily_report(fx.thread_posts(spark, sf_dir))


# ---- scorers on vectors ----------------------------------------------------------------------

SIZE = 64
WEIGHTS = [((j * 7) % 5 - 2) * 0.25 for j in range(SIZE)]
WEIGHTS_SQL = "[" + ", ".join(f"{w}::DOUBLE" for w in WEIGHTS) + "]"
VECTORS_SQL = f"""v AS (SELECT vec_id AS id, CAST(embedding AS DOUBLE[]) AS x,
  list_dot_product(CAST(embedding AS DOUBLE[]), {WEIGHTS_SQL}) AS score FROM embeddings),
cells AS (SELECT id, score, unnest(range({SIZE})) AS j, unnest(x) AS value, unnest({WEIGHTS_SQL}) AS w FROM v)"""


def vectors(spark, sf_dir):
    """(id, x, label) with a label that follows from the first three components."""
    return spread(fx.table(spark, sf_dir, "embeddings")).select(
        F.col("vec_id").alias("id"), F.col("embedding").cast("array<double>").alias("x")
    ).withColumn("label", (F.col("x")[0] + F.col("x")[1] - F.col("x")[2] > 0).cast("int"))


def _boosted(data):
    train = data.select(ft_vector().alias("features"), F.col("label").cast("double").alias("label"))
    return GBTClassifier(maxIter=10, maxDepth=3, stepSize=0.3, seed=42).fit(train)


def ft_vector():
    return ex.as_vector(F.col("x"))


@query("explain_permutation_importance")
def explain_permutation_importance(spark, sf_dir):
    data = vectors(spark, sf_dir)
    model = LogisticRegression(maxIter=20, regParam=0.001).fit(
        data.select(ft_vector().alias("features"), F.col("label").cast("double").alias("label")))
    return ex.permutation_importance(data, ex.model_scorer(model), list(range(SIZE))).orderBy(F.desc("drop"), "feature")


@query("explain_partial_dependence", f"""WITH {VECTORS_SQL},
m AS (SELECT j, avg(value) AS mean, min(value) AS lo, max(value) AS hi, any_value(w) AS w FROM cells GROUP BY j),
g AS (SELECT j, p, lo + (hi - lo) * p / 4 AS value, mean, w FROM m, (SELECT unnest(range(5)) AS p))
SELECT CAST(j AS INTEGER) AS feature, CAST(p AS INTEGER) AS point, round(value, 6) + 0.0 AS value,
  round((SELECT avg(score) FROM v) + w * (value - mean), 6) + 0.0 AS mean_score FROM g""")
def explain_partial_dependence(spark, sf_dir):
    data = vectors(spark, sf_dir)
    curve = ex.partial_dependence(data, ex.linear_scorer(WEIGHTS), ex.range_grid(data, list(range(SIZE))))
    return curve.withColumns({c: F.round(c, 6) + 0.0 for c in ("value", "mean_score")})


ATTRIBUTIONS_SQL = f"""{VECTORS_SQL}, a AS (
  SELECT id, j, value, w * (value - avg(value) OVER (PARTITION BY j)) AS phi FROM cells)"""


@query("explain_shap_values")
def explain_shap_values(spark, sf_dir):
    """Shapley values of a boosted ensemble for every vector and feature, against its expected value."""
    data = vectors(spark, sf_dir)
    return ex.long_attributions(ex.expected_attributions(data, _boosted(data)), "phi")


@query("explain_shap_global", f"""WITH {ATTRIBUTIONS_SQL}
SELECT CAST(j AS INTEGER) AS feature, round(avg(abs(phi)), 6) + 0.0 AS importance FROM a GROUP BY j""")
def explain_shap_global(spark, sf_dir):
    ranked = ex.global_importance(ex.linear_attributions(vectors(spark, sf_dir), WEIGHTS))
    return ranked.withColumn("importance", F.round("importance", 6) + 0.0)


@query("explain_shap_dependence", f"""WITH {ATTRIBUTIONS_SQL}
SELECT id, round(value, 6) + 0.0 AS value, round(phi, 6) + 0.0 AS phi FROM a WHERE j = 3""")
def explain_shap_dependence(spark, sf_dir):
    pairs = ex.dependence(ex.linear_attributions(vectors(spark, sf_dir), WEIGHTS), 3)
    return pairs.withColumns({c: F.round(c, 6) + 0.0 for c in ("value", "phi")})


@query("explain_lime_local")
def explain_lime_local(spark, sf_dir):
    """The trained ensemble explained around every vector."""
    data = vectors(spark, sf_dir)
    return ex.local_linear(data, ex.model_scorer(_boosted(data)))


@query("explain_prediction_contrib")
def explain_prediction_contrib(spark, sf_dir):
    data = vectors(spark, sf_dir)
    parts = ex.path_contributions(data, _boosted(data)).select(
        "id", "bias", F.posexplode(F.arrays_zip("contributions", "x")).alias("feature", "p"))
    return parts.where(F.col("p.contributions") != 0).select(
        "id", "bias", "feature", F.col("p.contributions").alias("contribution"), F.col("p.x").alias("value"))


def _adds_up(data, model, total):
    """Whether a total per row is the model's margin."""
    margin = ex.model_scorer(model)(data).select("id", F.col("score").alias("_margin"))
    return total.join(margin, "id").select("id", (F.abs(F.col("_total") - F.col("_margin")) < 1e-6).alias("adds_up"))


def _sum(array):
    return F.aggregate(array, F.lit(0.0), lambda acc, v: acc + v)


@query("explain_contrib_additive", "SELECT vec_id AS id, TRUE AS adds_up FROM embeddings")
def explain_contrib_additive(spark, sf_dir):
    """Bias and path contributions of every vector add up to its margin."""
    data = vectors(spark, sf_dir)
    model = _boosted(data)
    parts = ex.path_contributions(data, model)
    return _adds_up(data, model, parts.select("id", (F.col("bias") + _sum("contributions")).alias("_total")))


@query("explain_shap_additive", "SELECT vec_id AS id, TRUE AS adds_up FROM embeddings")
def explain_shap_additive(spark, sf_dir):
    """Base and Shapley values of every vector add up to its margin."""
    data = vectors(spark, sf_dir)
    model = _boosted(data)
    values = ex.expected_attributions(data, model)
    return _adds_up(data, model, values.select("id", (F.col("base") + _sum("phi")).alias("_total")))
