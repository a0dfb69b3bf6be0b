"""Metrics over every labelled document."""

from __future__ import annotations

from pyspark.sql import functions as F

from threadlens.operators import metrics as mt
from threadlens.operators import relational as rel
from threadlens.operators import threads as th
from threadlens.queries import fixtures as fx
from threadlens.queries.registry import query


def _rounded(df, columns, digits=6):
    return df.withColumns({c: F.round(c, digits) + 0.0 for c in columns})


def _pairs(spark, sf_dir):
    return fx.table(spark, sf_dir, "labels").selectExpr("doc_id", "quality AS label", "toxic AS prediction")


@query("eval_confusion", """SELECT count(*) FILTER (quality = 1 AND toxic = 1) AS tp,
  count(*) FILTER (quality = 0 AND toxic = 1) AS fp, count(*) FILTER (quality = 0 AND toxic = 0) AS tn,
  count(*) FILTER (quality = 1 AND toxic = 0) AS fn FROM labels""")
def eval_confusion(spark, sf_dir):
    return mt.confusion(_pairs(spark, sf_dir))


@query("eval_accuracy", "SELECT round(avg(CAST(quality = toxic AS INTEGER)), 6) AS accuracy FROM labels")
def eval_accuracy(spark, sf_dir):
    return _rounded(mt.accuracy(_pairs(spark, sf_dir)), ["accuracy"])


@query("eval_class_report", """WITH c AS (SELECT k AS class, count(*) FILTER (quality = k) AS support,
  count(*) FILTER (quality = k AND toxic = k) AS hits, count(*) FILTER (toxic = k) AS predicted
  FROM labels, (VALUES (0), (1)) AS v(k) GROUP BY k),
s AS (SELECT class, support, coalesce(hits / nullif(predicted, 0), 0) AS p, coalesce(hits / nullif(support, 0), 0) AS r FROM c),
f AS (SELECT *, coalesce(2 * p * r / nullif(p + r, 0), 0) AS f FROM s)
SELECT CAST(class AS VARCHAR) AS class, round(p, 6) AS precision, round(r, 6) AS recall, round(f, 6) AS f1, support FROM f
UNION ALL SELECT 'macro', round(avg(p), 6), round(avg(r), 6), round(avg(f), 6), CAST(sum(support) AS BIGINT) FROM f
UNION ALL SELECT 'weighted', round(sum(p * support) / sum(support), 6), round(sum(r * support) / sum(support), 6),
  round(sum(f * support) / sum(support), 6), CAST(sum(support) AS BIGINT) FROM f""")
def eval_class_report(spark, sf_dir):
    return _rounded(mt.class_report(_pairs(spark, sf_dir)), ["precision", "recall", "f1"])


@query("eval_cv_summary", f"""WITH f AS (SELECT {fx.arithmetic_sql('doc_id')} % 10 AS fold,
  avg(CAST(quality = toxic AS INTEGER)) AS a,
  coalesce(count(*) FILTER (quality = 1 AND toxic = 1) / nullif(count(*) FILTER (toxic = 1), 0), 0) AS p,
  coalesce(count(*) FILTER (quality = 1 AND toxic = 1) / nullif(count(*) FILTER (quality = 1), 0), 0) AS r
  FROM labels GROUP BY 1), g AS (SELECT *, coalesce(2 * p * r / nullif(p + r, 0), 0) AS f FROM f)
SELECT round(avg(a), 6) AS mean_accuracy, round(stddev_pop(a), 6) AS std_accuracy,
  round(avg(p), 6) AS mean_precision, round(stddev_pop(p), 6) AS std_precision,
  round(avg(r), 6) AS mean_recall, round(stddev_pop(r), 6) AS std_recall,
  round(avg(f), 6) AS mean_f1, round(stddev_pop(f), 6) AS std_f1 FROM g""")
def eval_cv_summary(spark, sf_dir):
    folds = _pairs(spark, sf_dir).withColumn("fold", fx.arithmetic_token("doc_id") % 10)
    summary = mt.cv_summary(folds, "fold")
    return _rounded(summary, summary.columns)


SCORED_SQL = """scored AS (SELECT l.doc_id, quality AS label,
  round(1 - length(regexp_replace(text, '[^A-Z]', '', 'g')) / greatest(length(text), 1), 4) AS score
  FROM labels l JOIN documents d ON l.doc_id = d.doc_id)"""


def _scored(spark, sf_dir):
    """Quality label and the share of characters that are no capitals, with ties."""
    documents = fx.table(spark, sf_dir, "documents").select("doc_id", "text")
    labels = fx.table(spark, sf_dir, "labels").selectExpr("doc_id", "quality AS label")
    capitals = F.regexp_count("text", F.lit("[A-Z]"))
    return documents.join(labels, "doc_id").select(
        "doc_id", "label", F.round(1 - capitals / F.greatest(F.length("text"), F.lit(1)), 4).alias("score"))


CURVE_SQL = f"""{SCORED_SQL}, g AS (SELECT score, count(*) FILTER (label = 1) AS pos, count(*) FILTER (label <> 1) AS neg
  FROM scored GROUP BY score),
c AS (SELECT *, sum(pos) OVER (ORDER BY score DESC) AS tp, sum(neg) OVER (ORDER BY score DESC) AS fp,
  sum(pos) OVER () AS p, sum(neg) OVER () AS n FROM g)"""


@query("eval_roc_curve", f"""WITH {CURVE_SQL}
SELECT score AS threshold, round(fp / n, 6) AS fpr, round(tp / p, 6) AS tpr FROM c""")
def eval_roc_curve(spark, sf_dir):
    return _rounded(mt.roc_curve(_scored(spark, sf_dir)), ["fpr", "tpr"])


@query("eval_roc_auc", f"""WITH {SCORED_SQL}, r AS (SELECT label,
  rank() OVER (ORDER BY score) + (count(*) OVER (PARTITION BY score) - 1) / 2.0 AS rank FROM scored)
SELECT round((sum(rank) FILTER (label = 1) - count(*) FILTER (label = 1) * (count(*) FILTER (label = 1) + 1) / 2.0)
  / (count(*) FILTER (label = 1) * count(*) FILTER (label <> 1)), 6)::DOUBLE AS auc FROM r""")
def eval_roc_auc(spark, sf_dir):
    return _rounded(mt.roc_auc(_scored(spark, sf_dir)), ["auc"])


@query("eval_youden_threshold", f"""WITH {CURVE_SQL}
SELECT score AS threshold, round(tp / p - fp / n, 6) AS j, round(tp / p, 6) AS tpr, round(fp / n, 6) AS fpr
FROM c ORDER BY round(tp / p - fp / n, 12) DESC, score DESC LIMIT 1""")
def eval_youden_threshold(spark, sf_dir):
    return _rounded(mt.youden_threshold(_scored(spark, sf_dir)), ["j", "tpr", "fpr"])


@query("eval_pr_curve", f"""WITH {CURVE_SQL}
SELECT score AS threshold, round(tp / (tp + fp), 6) AS precision, round(tp / p, 6) AS recall FROM c WHERE tp - pos < p""")
def eval_pr_curve(spark, sf_dir):
    return _rounded(mt.pr_curve(_scored(spark, sf_dir)), ["precision", "recall"])


@query("eval_pr_auc", f"""WITH {CURVE_SQL}, k AS (SELECT score, tp / (tp + fp) AS y, tp / p AS x FROM c),
l AS (SELECT x, y, coalesce(lag(x) OVER (ORDER BY score DESC), 0) AS x0, coalesce(lag(y) OVER (ORDER BY score DESC), 1) AS y0 FROM k)
SELECT round(sum((x - x0) * (y + y0) / 2), 6) AS pr_auc FROM l""")
def eval_pr_auc(spark, sf_dir):
    return _rounded(mt.pr_auc(_scored(spark, sf_dir)), ["pr_auc"])


@query("eval_fidelity", f"""WITH {fx.THREADS_SQL}, t AS (SELECT thread_id, arg_max(label, pos) AS surrogate,
  max(label) FILTER (pos = 0) AS black_box, count(DISTINCT label) FILTER (pos > 0) AS n_labels FROM threads GROUP BY thread_id)
SELECT round(avg(CAST(surrogate = black_box AS INTEGER)), 6) AS fidelity, count(*) AS n_threads FROM t WHERE n_labels = 2""")
def eval_fidelity(spark, sf_dir):
    """The last post's label stands in for the surrogate; threads with one reply label are left out."""
    posts = fx.thread_posts(spark, sf_dir)
    threads = posts.groupBy("thread_id").agg(
        F.max_by("label", "pos").alias("surrogate"), F.max(F.when(F.col("pos") == 0, F.col("label"))).alias("black_box"),
        F.count_distinct(F.when(F.col("pos") > 0, F.col("label"))).alias("n_labels"))
    return th.fidelity(threads.where(F.col("n_labels") == 2), "surrogate", "black_box").withColumn(
        "fidelity", F.round("fidelity", 6))


@query("sample_stratified", f"""WITH r AS (SELECT doc_id, quality, toxic, row_number() OVER (
  PARTITION BY quality ORDER BY {fx.arithmetic_sql('doc_id', 42)}, doc_id) AS r FROM labels)
SELECT doc_id AS idx, quality AS bb_pred, toxic AS lr_pred, md5(text) AS digest FROM r JOIN documents d USING (doc_id)
WHERE r <= 100 ORDER BY idx""")
def sample_stratified(spark, sf_dir):
    picked = rel.stratified_sample(
        fx.table(spark, sf_dir, "labels"), "quality", fx.arithmetic_token("doc_id", 42), "doc_id", 100)
    texts = fx.table(spark, sf_dir, "documents").select("doc_id", F.md5("text").alias("digest"))
    return picked.join(texts, "doc_id").select(
        F.col("doc_id").alias("idx"), F.col("quality").alias("bb_pred"), F.col("toxic").alias("lr_pred"), "digest"
    ).orderBy("idx")


@query("eval_proba_agreement", """WITH v AS (SELECT 1 / (1 + exp(-(embedding[1] + embedding[2])::DOUBLE)) AS a,
  1 / (1 + exp(-(embedding[1] - embedding[3])::DOUBLE)) AS b FROM embeddings)
SELECT round(avg(abs(a - b)), 6) AS mean_abs_difference, round(corr(a, b), 6) AS correlation FROM v""")
def eval_proba_agreement(spark, sf_dir):
    pairs = fx.table(spark, sf_dir, "embeddings").selectExpr(
        "1 / (1 + exp(-CAST(embedding[0] + embedding[1] AS DOUBLE))) AS a",
        "1 / (1 + exp(-CAST(embedding[0] - embedding[2] AS DOUBLE))) AS b")
    agreement = mt.probability_agreement(pairs, "a", "b")
    return _rounded(agreement, agreement.columns)


@query("eval_score_quartiles", f"""WITH f AS (SELECT l_returnflag AS config, {fx.arithmetic_sql('l_orderkey')} % 30 AS fold,
  avg(CAST(l_linestatus = 'O' AS INTEGER) * 0.5 + l_discount) AS score FROM lineitem GROUP BY ALL)
SELECT config, round(min(score), 6) AS lowest, round(quantile_cont(score, 0.25), 6) AS q1,
  round(quantile_cont(score, 0.5), 6) AS median, round(quantile_cont(score, 0.75), 6) AS q3,
  round(max(score), 6) AS highest, round(avg(score), 6) AS mean FROM f GROUP BY config""")
def eval_score_quartiles(spark, sf_dir):
    rows = fx.table(spark, sf_dir, "lineitem").select(
        F.col("l_returnflag").alias("config"), (fx.arithmetic_token("l_orderkey") % 30).alias("fold"),
        ((F.col("l_linestatus") == "O").cast("int") * 0.5 + F.col("l_discount")).alias("v"))
    folds = rows.groupBy("config", "fold").agg(F.avg("v").alias("score"))
    summary = mt.quartiles(folds, "config", "score")
    return _rounded(summary, [c for c in summary.columns if c != "config"])
