"""Evaluation metrics over (label, prediction) or (label, score) rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from threadlens.operators.skew import running_totals
from threadlens.session import materialize


def ratio(a: Column, b: Column) -> Column:
    """a / b, and 0 where b is 0."""
    return F.coalesce(F.try_divide(a, b), F.lit(0.0))


def confusion(df: DataFrame, label: str = "label", prediction: str = "prediction") -> DataFrame:
    y, p = F.col(label), F.col(prediction)
    return df.agg(
        F.count_if((y == 1) & (p == 1)).alias("tp"), F.count_if((y != 1) & (p == 1)).alias("fp"),
        F.count_if((y == 0) & (p == 0)).alias("tn"), F.count_if((y != 0) & (p == 0)).alias("fn"),
    )


def accuracy(df: DataFrame, label: str = "label", prediction: str = "prediction") -> DataFrame:
    return df.agg(F.avg((F.col(label) == F.col(prediction)).cast("double")).alias("accuracy"))


def class_report(df: DataFrame, label: str = "label", prediction: str = "prediction") -> DataFrame:
    """One row per class, then the plain and the support-weighted averages; one pass over the input.

    Counts per (label, prediction) are all the report needs. Each counts once for its true class and
    once for the predicted one; each class then counts for itself and for both averages.
    """
    y, p, n = F.col(label), F.col(prediction), F.col("n")
    zero = F.lit(0).cast("long")
    sides = F.array(
        F.struct(y.alias("class"), n.alias("support"), F.when(y == p, n).otherwise(zero).alias("hits"),
                 zero.alias("predicted")),
        F.struct(p.alias("class"), zero.alias("support"), zero.alias("hits"), n.alias("predicted")))
    counts = df.groupBy(label, prediction).agg(F.count("*").alias("n")).select(F.inline(sides))
    per_class = counts.groupBy("class").agg(*[F.sum(c).alias(c) for c in ("support", "hits", "predicted")])
    scored = per_class.withColumn("precision", ratio(F.col("hits"), F.col("predicted"))).withColumn(
        "recall", ratio(F.col("hits"), F.col("support")))
    precision, recall = F.col("precision"), F.col("recall")
    scored = scored.withColumn("f1", ratio(2 * precision * recall, precision + recall))
    rows = F.array(
        F.struct(F.col("class").cast("string").alias("name"), F.lit(1).cast("long").alias("w")),
        F.struct(F.lit("macro").alias("name"), F.lit(1).cast("long").alias("w")),
        F.struct(F.lit("weighted").alias("name"), F.col("support").alias("w")))
    names = ["precision", "recall", "f1"]
    return scored.select(*names, "support", F.inline(rows)).groupBy(F.col("name").alias("class")).agg(
        *[ratio(F.sum(F.col(c) * F.col("w")), F.sum("w")).alias(c) for c in names], F.sum("support").alias("support"))


def cv_summary(df: DataFrame, fold: str, label: str = "label", prediction: str = "prediction") -> DataFrame:
    """Mean and population deviation over the folds of accuracy and of class 1's precision, recall and F1."""
    y, p = F.col(label) == 1, F.col(prediction) == 1
    folds = df.groupBy(fold).agg(
        F.avg((F.col(label) == F.col(prediction)).cast("double")).alias("accuracy"),
        ratio(F.count_if(y & p), F.count_if(p)).alias("precision"),
        ratio(F.count_if(y & p), F.count_if(y)).alias("recall"))
    precision, recall = F.col("precision"), F.col("recall")
    folds = folds.withColumn("f1", ratio(2 * precision * recall, precision + recall))
    names = ["accuracy", "precision", "recall", "f1"]
    return folds.agg(*[f(n).alias(f"{prefix}_{n}") for n in names for prefix, f in (("mean", F.avg), ("std", F.stddev_pop))])


def score_totals(df: DataFrame, label: str = "label", score: str = "score", buckets: int = 1024) -> DataFrame:
    """Per distinct score, from the highest: positives and negatives here and up to here.

    Rows are folded per score and written once, so the scoring behind ``df`` runs a single time; the
    running sums then go bucket by bucket over the folded table.
    """
    folded = materialize(df.groupBy(score).agg(
        F.count_if(F.col(label) == 1).alias("pos"), F.count_if(F.col(label) != 1).alias("neg")), "score-totals")
    totals = folded.agg(F.struct(F.sum("pos").alias("p"), F.sum("neg").alias("n")).alias("t")).scalar()
    running = running_totals(folded, score, ["pos", "neg"], descending=True, buckets=buckets)
    return running.withColumn("_t", totals).select(
        score, "pos", "neg", F.col("cum_pos").alias("tp"), F.col("cum_neg").alias("fp"),
        F.col("_t.p").alias("positives"), F.col("_t.n").alias("negatives"))


def roc_curve(df: DataFrame, label: str = "label", score: str = "score") -> DataFrame:
    t = score_totals(df, label, score)
    return t.select(F.col(score).alias("threshold"), ratio(F.col("fp"), F.col("negatives")).alias("fpr"),
                    ratio(F.col("tp"), F.col("positives")).alias("tpr"))


def roc_auc(df: DataFrame, label: str = "label", score: str = "score") -> DataFrame:
    """Area by trapezoids: each group of equal scores adds its negatives times the mean true-positive count."""
    t = score_totals(df, label, score)
    area = F.sum(F.col("neg") * (F.col("tp") - F.col("pos") / 2.0))
    return t.agg(ratio(area, F.max("positives") * F.max("negatives")).alias("auc"))


def youden_threshold(df: DataFrame, label: str = "label", score: str = "score") -> DataFrame:
    """Threshold with the largest tpr - fpr; the highest such score wins."""
    curve = roc_curve(df, label, score).withColumn("j", F.col("tpr") - F.col("fpr"))
    best = curve.agg(F.max_by(F.struct("threshold", "j", "tpr", "fpr"), F.struct(F.round("j", 12), "threshold")).alias("b"))
    return best.select("b.*")


def pr_curve(df: DataFrame, label: str = "label", score: str = "score") -> DataFrame:
    """Precision and recall per threshold, from the highest down to the first with full recall."""
    t = score_totals(df, label, score).where(F.col("tp") - F.col("pos") < F.col("positives"))
    return t.select(F.col(score).alias("threshold"),
                    ratio(F.col("tp"), F.col("tp") + F.col("fp")).alias("precision"),
                    ratio(F.col("tp"), F.col("positives")).alias("recall"))


def pr_auc(df: DataFrame, label: str = "label", score: str = "score") -> DataFrame:
    """Trapezoids over recall, starting at (0, 1). The previous point follows from the row's own counts."""
    t = score_totals(df, label, score)
    tp, fp, pos, neg = (F.col(c) for c in ("tp", "fp", "pos", "neg"))
    here = ratio(tp, tp + fp)
    before = F.when(tp + fp == pos + neg, F.lit(1.0)).otherwise(ratio(tp - pos, tp - pos + fp - neg))
    return t.agg(F.sum(ratio(pos, F.col("positives")) * (here + before) / 2).alias("pr_auc"))


def probability_agreement(df: DataFrame, a: str, b: str) -> DataFrame:
    return df.agg(F.avg(F.abs(F.col(a) - F.col(b))).alias("mean_abs_difference"), F.corr(a, b).alias("correlation"))


def quartiles(scores: DataFrame, config: str, score: str) -> DataFrame:
    """Five-number summary and mean of the fold scores of each configuration, a bounded number each."""
    q = F.percentile(score, F.array(*[F.lit(x) for x in (0.0, 0.25, 0.5, 0.75, 1.0)]))
    summary = scores.groupBy(config).agg(q.alias("q"), F.avg(score).alias("mean"))
    return summary.select(config, *[F.col("q")[i].alias(n) for i, n in enumerate(
        ["lowest", "q1", "median", "q3", "highest"])], "mean")
