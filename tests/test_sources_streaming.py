import json
import os

import pytest
from pyspark.errors import StreamingQueryException
from pyspark.sql import functions as F

from threadlens import schemas
from threadlens.operators import features as ft
from threadlens.operators import relational as rel
from threadlens.sources import readers, writers
from threadlens.streaming import ingest


def test_author_files_keep_order_and_stem(spark, tmp_path):
    (tmp_path / "u1.xml").write_text(
        "<author lang='en'><documents><document><![CDATA[ first & <b> ]]></document>"
        "<document>second</document></documents></author>")
    (tmp_path / "u2.xml").write_text("<author><documents><document>only</document></documents></author>")
    rows = readers.read_author_xml(spark, str(tmp_path)).orderBy("user_id", "post_pos").collect()
    assert [(r.user_id, r.post_pos, r.text) for r in rows] == [
        ("u1", 0, " first & <b> "), ("u1", 1, "second"), ("u2", 0, "only")]


def test_truth_lines_use_the_first_character(spark, tmp_path):
    (tmp_path / "truth.txt").write_text("a:::1\nb:::0 extra\n")
    rows = readers.read_truth_labels(spark, str(tmp_path / "truth.txt")).orderBy("user_id").collect()
    assert [tuple(r) for r in rows] == [("a", 1), ("b", 0)]


def test_csv_keeps_newlines_quotes_and_blanks(spark, tmp_path):
    texts = ['a "quoted", text', "two\nlines", "  outer  "]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "id long, text string")
    writers.write_csv(df, str(tmp_path / "c"))
    back = readers.read_header_csv(spark, str(tmp_path / "c"), df.schema).orderBy("id").collect()
    assert [r.text for r in back] == texts


def test_threads_in_one_document_and_slang(spark, tmp_path):
    reply = {"tweet_id": "11", "user_id": "b", "tweet_text": "yes", "text": "h"}
    root = {"tweet_id": "1", "user_id": "a", "tweet_text": "hi", "text": "h", "replies": [reply]}
    lonely = {"tweet_id": "2", "user_id": "c", "tweet_text": "alone", "text": "", "replies": []}
    (tmp_path / "t.json").write_text(json.dumps({"results": [root, lonely]}, indent=1))
    rows = readers.read_threads(spark, str(tmp_path / "t.json"), multi_line=True).orderBy("thread_id", "pos").collect()
    assert [(r.thread_id, r.pos, r.tweet_id, r.is_root) for r in rows] == [
        ("1", 0, "1", True), ("1", 1, "11", False), ("2", 0, "2", True)]
    (tmp_path / "slang.txt").write_text("LOL: laugh\nb/c: because\ntwo words: x\n")
    assert {r.slang for r in readers.read_slang(spark, str(tmp_path / "slang.txt")).collect()} == {"lol", "b/c", "two words"}


def test_nested_projection_reads_only_the_leaves(spark, tmp_path):
    spark.createDataFrame([(1, "d", "t", "en", (7, "n", 9))], schemas.RAW_STATUS).write.parquet(str(tmp_path / "s"))
    out = readers.read_statuses(spark, str(tmp_path / "s"))
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert "user:struct<id:bigint,screen_name:string,followers_count:bigint>" in plan and "text:string" not in plan
    assert tuple(out.first()) == (1, "d", "n", 7, 9)


def test_appends_add_up(spark, tmp_path):
    flags = spark.createDataFrame([(1, 0), (2, 1)], "thread_id long, homophilous int")
    for _ in range(2):
        writers.append_results(flags, str(tmp_path / "r"))
    counts = {r.outcome: r["count"] for r in spark.read.parquet(str(tmp_path / "r")).groupBy("outcome").count().collect()}
    assert counts == {"mixed": 2, "single_label": 2}


def test_stream_equals_batch_and_resumes(spark, tmp_path):
    source, sink = str(tmp_path / "in"), str(tmp_path / "out")
    os.makedirs(source)

    def put(name, *statuses):
        with open(f"{source}/{name}.json", "w") as out:
            for i, lang, text in statuses:
                out.write(json.dumps({"id": i, "lang": lang, "text": text}) + "\n")

    def run():
        stream = ingest.matching(ingest.status_stream(spark, source, schemas.RAW_STATUS), ["covid"])
        ingest.append_parquet(stream, sink, sink + "-cp").awaitTermination()
        return sorted(r.id for r in spark.read.schema("id long, raw string").parquet(sink).collect())

    put("a", (1, "en", "COVID news"), (2, "fr", "covid"), (3, "en", "other"))
    assert run() == [1]
    put("b", (4, "en", "about covid19"))
    assert run() == [1, 4]
    assert run() == [1, 4]


def test_stream_features_equal_batch_features(spark, tmp_path):
    posts = spark.createDataFrame([(i, f"RT Hello NO{i} 😀 not") for i in range(20)], "doc_id long, text string")
    posts.repartition(5).write.parquet(str(tmp_path / "p"))
    stream = spark.readStream.schema(posts.schema).option("maxFilesPerTrigger", 2).parquet(str(tmp_path / "p"))
    ingest.score_stream(stream, lambda b: ingest.post_features(b, ["doc_id"], "text"), str(tmp_path / "o"),
                        str(tmp_path / "cp")).awaitTermination()
    got = spark.read.parquet(str(tmp_path / "o")).drop("batch").orderBy("doc_id").collect()
    want = ingest.post_features(posts, ["doc_id"], "text").orderBy("doc_id").collect()
    assert got == want


def test_plan_shapes(spark, tmp_path):
    """Readability and TF-IDF scoring add no shuffle; only the needed columns are read."""
    spark.createDataFrame([(1, "a b", "x")], "doc_id long, text string, other string").write.parquet(str(tmp_path / "d"))
    table = spark.read.parquet(str(tmp_path / "d"))
    plan = ft.readability(table, ["doc_id"], "text")._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and "other" not in plan
    model = ft.TfIdf(["aa"], [1.0], 1, 1, [])
    assert "Exchange" not in model.transform(table, "text")._jdf.queryExecution().executedPlan().toString()
    roots = spark.createDataFrame([(1, 1)], "conversation_id long, root_id long").withColumn("root_date", F.current_date())
    posts = spark.createDataFrame([(1, 2)], "conversation_id long, reply_id long").withColumn("ts", F.current_timestamp())
    assert "Cartesian" not in rel.match_replies(roots, posts)._jdf.queryExecution().executedPlan().toString()


def _batches(spark, folder, check):
    stream = spark.readStream.schema("id long").option("maxFilesPerTrigger", 1).json(str(folder / "in"))
    return lambda: ingest.append_batches(stream, str(folder / "out"), str(folder / "state"), check=check)


def test_supervisor_restarts_killed_batches_without_loss_or_doubles(spark, tmp_path):
    spark.range(60).repartition(6).write.json(str(tmp_path / "in"))
    tried, waits = {}, []

    def check(batch, number):
        tried[number] = tried.get(number, 0) + 1
        if tried[number] <= number % 3:
            raise RuntimeError("killed behind the write")

    restarts = ingest.supervise(_batches(spark, tmp_path, check), first_wait=1.0, longest_wait=3.0, wait=waits.append)
    assert restarts == len(waits) == sum(n % 3 for n in tried) == 6
    assert sorted(r.id for r in spark.read.parquet(str(tmp_path / "out")).collect()) == list(range(60))
    assert waits[0] == 1.0 and max(waits) <= 3.0


def test_supervisor_backs_off_and_gives_up(spark, tmp_path):
    spark.range(3).coalesce(1).write.json(str(tmp_path / "in"))
    waits = []

    def check(batch, number):
        raise RuntimeError("always")

    with pytest.raises(StreamingQueryException):
        ingest.supervise(_batches(spark, tmp_path, check), first_wait=1.0, longest_wait=3.0, attempts=5, wait=waits.append)
    assert waits == [1.0, 2.0, 3.0, 3.0]
