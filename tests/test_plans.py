from datetime import datetime, timedelta

from pyspark.sql import functions as F

from threadlens.plans import collection, feature_build, thread_explanation


def test_feature_build(spark, tmp_path):
    posts = spark.createDataFrame(
        [(f"u{u}", p, f"RT good day {u} {'abc'[u % 3] * 4} #URL# NASA ") for u in range(6) for p in range(4)],
        "user_id string, post_pos long, text string")
    truth = spark.createDataFrame([(f"u{u}", u % 2) for u in range(6)], "user_id string, ground_truth int")
    users = feature_build.user_corpora(posts, truth).withColumnRenamed("corpus", "text")
    scores = spark.createDataFrame([("good", 2.0, 0.5)], "word string, valence double, polarity double")
    extra = truth.select("user_id", F.lit(3.0).alias("Tone"))
    model = feature_build.build_matrix(users, feature_build.Lexicons(scores), str(tmp_path / "raw"),
                                       str(tmp_path / "scaled"), [extra])
    assert "bbbb" in model.terms
    raw, scaled = spark.read.parquet(str(tmp_path / "raw")), spark.read.parquet(str(tmp_path / "scaled"))
    row = raw.where("user_id = 'u1'").first()
    assert row.retweets_count == 4 and row.url_count == 4 and row.full_capitalized_count == 4 and row.ground_truth == 1
    assert row.textblob_polarity_score == 0.5 and row.tfidf.size == len(model.terms)
    assert {(r.Tone, r.ground_truth) for r in scaled.collect()} == {(0.0, 0), (0.0, 1)}


def test_collection_and_explanation(spark):
    start = datetime(2024, 1, 1)
    rows = [(c * 100 + i, c, f"user{i}", start + timedelta(hours=i), f"post {'cats' if i % 2 else 'dogs'} number{i}")
            for c in (1, 2) for i in range(13 if c == 1 else 4)]
    rows.append((199, 1, "late", start + timedelta(days=6), "too late"))
    posts = spark.createDataFrame(rows, "post_id long, conversation_id long, user_id string, ts timestamp, text string")
    statuses = spark.createDataFrame(
        [(100, "Mon Jan 01 00:00:00 +0000 2024", 1, 9000), (200, "Mon Jan 01 00:00:00 +0000 2024", 1, 9000),
         (300, None, 2, 9000), (400, "Mon Jan 01 00:00:00 +0000 2024", 3, 10)],
        "id long, created_at string, user_id long, followers_count long")
    roots = collection.candidate_roots(statuses)
    assert {r.root_id for r in roots.collect()} == {100, 200}
    roots = roots.select("root_id", (F.col("root_id") / 100).cast("long").alias("conversation_id"), "root_date")
    threads = collection.collect_threads(roots, posts)
    got = threads.orderBy("pos").collect()
    assert [r.post_id for r in got] == list(range(100, 113))  # conversation 2 is too small, the late post is out
    assert got[1].text.startswith("post cats") and got[1].tweet_text == "post cats number1"

    def black_box(df):
        return df.withColumn("label", F.col("tweet_text").contains("cats").cast("int")).withColumn("proba", F.lit(0.7))

    out = thread_explanation.explain(threads, black_box)
    result = out["results"].first()
    assert result.replies == 12 and result.bb_pred == 0 and result.lr_pred == 0
    assert out["words"].orderBy("rank").first().word == "dogs"
    assert out["homophily"].count() == 0
    assert out["exemplars"].count() == 4
    assert out["fidelity"].first().fidelity == 1.0
    assert out["agreement"].first().mean_abs_difference > 0
