"""Streaming jobs run to the end of what is available, over every event and post."""

from __future__ import annotations

from pyspark.ml import PipelineModel
from pyspark.sql import functions as F

from threadlens import schemas
from threadlens.functions import emoji as em
from threadlens.functions.vectors import as_vector
from threadlens.operators import classifiers as cl
from threadlens.operators import features as ft
from threadlens.queries import fixtures as fx
from threadlens.queries.features import EMOTIONS_SQL, READABILITY_SQL, REAL, sql_rounded
from threadlens.queries.registry import query
from threadlens.queries.text import NEGATION_SQL
from threadlens.session import scratch_path
from threadlens.sources.readers import spread
from threadlens.streaming import ingest

KEYWORDS = ["purchase", "err"]


INGESTED_SQL = """SELECT event_id AS id, event_type, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k
FROM events WHERE value >= 10 AND (contains(event_type, 'purchase') OR contains(event_type, 'err'))"""


def _statuses(spark, sf_dir):
    """Folder of events as JSON statuses: the type is the text, and low values stand for another language."""
    source = scratch_path(spark, "statuses")
    lang = F.when(F.col("value") < 10, "fr").otherwise("en")
    status = F.struct(F.col("event_id").alias("id"), F.col("event_type").alias("text"), lang.alias("lang"),
                      F.struct(F.col("user_id").alias("id"),
                               F.from_json("props", "k bigint")["k"].alias("followers_count")).alias("user"))
    spread(fx.table(spark, sf_dir, "events")).select(F.to_json(status).alias("value")).write.text(source)
    return source


def _stored(spark, sink):
    stored = spark.read.schema("id bigint, raw string").parquet(sink)
    parsed = F.from_json("raw", "text string, user struct<followers_count: bigint>")
    return stored.select("id", parsed["text"].alias("event_type"), parsed["user"]["followers_count"].alias("k"))


@query("stream_filter_ingest", INGESTED_SQL)
def stream_filter_ingest(spark, sf_dir):
    """Statuses in the language that hold a keyword, appended as they arrive."""
    sink = scratch_path(spark, "ingested")
    stream = ingest.status_stream(spark, _statuses(spark, sf_dir), schemas.RAW_STATUS)
    ingest.append_parquet(ingest.matching(stream, KEYWORDS), sink, sink + "-checkpoint").awaitTermination()
    return _stored(spark, sink)


@query("stream_supervised_ingest", INGESTED_SQL)
def stream_supervised_ingest(spark, sf_dir):
    """The same ingest with every other batch failing once behind its write, and restarted by the supervisor."""
    sink, failed = scratch_path(spark, "ingested"), set()
    stream = ingest.status_stream(spark, _statuses(spark, sf_dir), schemas.RAW_STATUS, files_per_trigger=2)

    def fail_once(batch, number):
        if number % 2 == 0 and number not in failed:
            failed.add(number)
            raise RuntimeError(f"batch {number} is to be restarted")

    ingest.supervise(lambda: ingest.append_batches(ingest.matching(stream, KEYWORDS), sink, sink + "-checkpoint", check=fail_once),
                     first_wait=0.05, longest_wait=1.0, attempts=5)
    return _stored(spark, sink)


@query("stream_score_features", f"""WITH {fx.POSTS_SQL}, r AS ({READABILITY_SQL}),
s AS (SELECT doc_id, {EMOTIONS_SQL}, {NEGATION_SQL} AS negation FROM posts)
SELECT r.* EXCLUDE (source) REPLACE (round(avg_word_count, 6) AS avg_word_count), negation, {sql_rounded(REAL[:4])},
  TRUE AS as_in_batch FROM r JOIN s USING (doc_id)""")
def stream_score_features(spark, sf_dir):
    """Features of arriving posts, scored batch by batch with a model that was fitted, saved and loaded; as_in_batch
    tells whether the stream's prediction is that of the same model over the whole table."""
    source, sink = scratch_path(spark, "posts"), scratch_path(spark, "scored")
    fx.posts(spark, sf_dir).select("doc_id", "text").write.parquet(source)
    stream = spark.readStream.schema("doc_id bigint, text string").option("maxFilesPerTrigger", 4).parquet(source)

    inputs = ["avg_word_count", "slang_count", "emoji_count", "capitalized_count", "full_capitalized_count"]
    features = as_vector(F.array(*[F.col(c).cast("double") for c in inputs]))
    posts = ingest.post_features(spark.read.parquet(source), ["doc_id"], "text").withColumn("features", features)
    labelled = posts.join(fx.table(spark, sf_dir, "labels").selectExpr("doc_id", "CAST(quality AS DOUBLE) AS label"), "doc_id")
    path = scratch_path(spark, "stream-model")
    cl.fit("logistic", labelled, maxIter=10).model.write().overwrite().save(path)
    model = cl.Fitted("logistic", PipelineModel.load(path))

    def score(batch):
        rows = ingest.post_features(batch, ["doc_id"], "text").withColumn("features", features)
        told = model.transform(rows)
        return told.select(*[c for c in rows.columns if c != "features"], "prediction")

    ingest.score_stream(stream, score, sink, sink + "-checkpoint").awaitTermination()
    whole = model.transform(posts).select("doc_id", F.col("prediction").alias("_whole"))
    scored = spark.read.parquet(sink).drop("batch").join(whole, "doc_id").withColumn(
        "as_in_batch", F.col("prediction") == F.col("_whole")).drop("prediction", "_whole")
    return scored.withColumns({c: F.round(c, 6) for c in ["avg_word_count", *em.EMOTIONS]})
