"""Readers and sinks: the tables are written in each format to the shared folder and read back."""

from __future__ import annotations

from pyspark.sql import functions as F

from threadlens import lexicons as lex
from threadlens import schemas
from threadlens.functions import emoji as em
from threadlens.operators import relational as rel
from threadlens.queries import features  # noqa: F401  (registers the SQL of the emotion means)
from threadlens.queries import fixtures as fx
from threadlens.queries.registry import SQL, query
from threadlens.session import scratch_path
from threadlens.sources import readers, writers


@query("scan_xml_posts", f"""WITH {fx.POSTS_SQL}
SELECT source AS user_id, CAST(row_number() OVER (PARTITION BY source ORDER BY doc_id) - 1 AS INTEGER) AS post_pos,
  md5(replace(text, chr(13), chr(10))) AS digest FROM posts""")
def scan_xml_posts(spark, sf_dir):
    """Several authors per file, each with an id of its own."""
    authors = fx.posts(spark, sf_dir).groupBy("source").agg(
        F.array_sort(F.collect_list(F.struct("doc_id", "text"))).alias("p")
    ).select(F.col("source").alias("_id"), F.struct(F.transform("p", lambda d: d["text"]).alias("document")).alias("documents"))
    path = scratch_path(spark, "xml")
    authors.write.format("xml").option("rootTag", "authors").option("rowTag", "author").save(path)
    return readers.read_author_xml(spark, path).select("user_id", "post_pos", F.md5("text").alias("digest"))


@query("scan_truth_labels", "SELECT 'user' || doc_id AS user_id, quality AS ground_truth FROM labels")
def scan_truth_labels(spark, sf_dir):
    path = scratch_path(spark, "truth")
    line = F.concat(F.lit("user"), "doc_id", F.lit(":::"), "quality", F.lit(" "))
    fx.table(spark, sf_dir, "labels").select(line.alias("value")).write.text(path)
    return readers.read_truth_labels(spark, path)


@query("scan_csv_header", f"""WITH {fx.POSTS_SQL} SELECT doc_id, source, md5(text) AS digest FROM posts""")
def scan_csv_header(spark, sf_dir):
    path = scratch_path(spark, "csv")
    writers.write_csv(fx.posts(spark, sf_dir).select("doc_id", "source", "text"), path)
    table = readers.read_header_csv(spark, path, "doc_id bigint, source string, text string")
    return table.select("doc_id", "source", F.md5("text").alias("digest"))


@query("scan_tsv_traits", """SELECT c_custkey AS twitter_uid, c_acctbal AS "ADMIRATION", CAST(c_nationkey AS DOUBLE) AS "AGRE"
FROM customer""")
def scan_tsv_traits(spark, sf_dir):
    path = scratch_path(spark, "tsv")
    traits = fx.table(spark, sf_dir, "customer").select(
        F.col("c_acctbal").alias("ADMIRATION"), F.col("c_nationkey").cast("double").alias("AGRE"),
        F.col("c_custkey").alias("twitter_uid"))
    traits.write.option("sep", "\t").option("header", "true").csv(path)
    return readers.read_trait_tsv(spark, path, traits.schema)


def _nested_threads(spark, sf_dir):
    """Nested threads from the conversations: ids as strings, the author is the role."""
    posts = fx.thread_posts(spark, sf_dir).select(
        "thread_id", "pos", (F.col("thread_id") * 100 + F.col("pos")).cast("string").alias("tweet_id"),
        F.col("role").alias("user_id"), F.col("text").alias("tweet_text"), F.upper("role").alias("text"))
    nested = rel.nest_replies(posts, "thread_id", "pos", ["tweet_id", "user_id", "tweet_text", "text"])
    replies = F.transform("replies", lambda r: r.dropFields("pos"))
    return nested.select(F.col("thread_id").alias("thread_no"), F.struct(
        "tweet_id", "user_id", "tweet_text", "text", replies.alias("replies")).alias("thread"))


_LONG_SQL = """SELECT CAST(conv_id * 100 AS VARCHAR) AS thread_id, CAST(turn AS INTEGER) AS pos,
  CAST(conv_id * 100 + turn AS VARCHAR) AS tweet_id, role AS user_id, md5(text) AS digest
FROM conversations"""


def _thread_round_trip(spark, sf_dir):
    path = scratch_path(spark, "threads")
    writers.write_threads(_nested_threads(spark, sf_dir), path)
    return readers.read_threads(spark, path)


@query("scan_thread_json", _LONG_SQL)
def scan_thread_json(spark, sf_dir):
    return _thread_round_trip(spark, sf_dir).select(
        "thread_id", "pos", "tweet_id", "user_id", F.md5("tweet_text").alias("digest"))


@query("sink_thread_json", f"""SELECT thread_id, count(*) AS n_posts, md5(string_agg(digest, '' ORDER BY pos)) AS digest
FROM ({_LONG_SQL}) GROUP BY thread_id""")
def sink_thread_json(spark, sf_dir):
    long = _thread_round_trip(spark, sf_dir).select("thread_id", "pos", F.md5("tweet_text").alias("digest"))
    return long.groupBy("thread_id").agg(
        F.count("*").alias("n_posts"),
        F.md5(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("pos", "digest"))),
                                       lambda p: p["digest"]), "")).alias("digest"))


@query("scan_reply_map", """SELECT CAST(conv_id * 100 AS VARCHAR) AS root_id, conv_id * 100 + turn AS reply_id
FROM conversations WHERE turn > 0""")
def scan_reply_map(spark, sf_dir):
    replies = fx.table(spark, sf_dir, "conversations").where("turn > 0").selectExpr(
        "conv_id * 100 AS root_id", "turn", "conv_id * 100 + turn AS reply_id")
    path = scratch_path(spark, "reply-map")
    writers.write_reply_map(rel.list_replies(replies, "root_id", "turn", "reply_id"), "root_id", "reply_ids", path)
    return readers.read_reply_map(spark, path)


@query("scan_lexicon", f"""WITH {fx.POSTS_SQL}, slang(s) AS (SELECT unnest({fx.sql_list(s.lower() for s in lex.SEED_SLANG)})),
t AS (SELECT unnest({fx.sql_whitespace_tokens('lower(text)')}) AS w FROM posts)
SELECT s AS slang, (SELECT count(*) FROM t WHERE w = s) AS hits FROM slang""")
def scan_lexicon(spark, sf_dir):
    """A colon-separated lexicon is read back and its hits in the posts are counted; unused keys count 0."""
    from threadlens.functions import text as tx

    path = scratch_path(spark, "slang")
    spark.createDataFrame([(f"{s.upper()}: meaning",) for s in lex.SEED_SLANG], "value string").write.text(path)
    keys = readers.read_slang(spark, path)
    tokens = fx.posts(spark, sf_dir).select(F.explode(tx.whitespace_tokens(F.lower("text"))).alias("slang"))
    counts = tokens.join(keys, "slang", "left_semi").groupBy("slang").agg(F.count("*").alias("hits"))
    return keys.join(counts, "slang", "left").select("slang", F.coalesce("hits", F.lit(0).cast("long")).alias("hits"))


@query("scan_emoji_lexicon", SQL["agg_emotion_mean"])
def scan_emoji_lexicon(spark, sf_dir):
    """Emotion means of every post by an emoji lexicon that is written as a tab-separated file and read back."""
    path = scratch_path(spark, "emoji")
    fields = [f.name for f in schemas.EMOJI_LEXICON.fields]
    rows = [dict(zip(["emoji", "name", *em.EMOTIONS], e, strict=True)) for e in lex.gated_emoji(lex.SEED_EMOJI, True)]
    spark.createDataFrame([tuple(r[f] for f in fields) for r in rows], schemas.EMOJI_LEXICON).write.option("header", "true").option(
        "sep", "\t").csv(path)
    means = em.emotion_means_by(fx.posts(spark, sf_dir), "doc_id", "text", readers.read_emoji_lexicon(spark, path))
    return means.select("doc_id", *[(F.round(n, 6) + 0.0).alias(n) for n in em.EMOTIONS])


@query("scan_nested_projection", """SELECT event_id AS id, strftime(ts, '%Y-%m-%d') AS created_at,
  'user' || user_id AS screen_name, user_id, CAST(json_extract_string(props, '$.k') AS BIGINT) AS followers_count FROM events""")
def scan_nested_projection(spark, sf_dir):
    """Statuses with a nested user; only the five projected leaves are read back."""
    path = scratch_path(spark, "statuses")
    fx.table(spark, sf_dir, "events").select(
        F.col("event_id").alias("id"), F.date_format("ts", "yyyy-MM-dd").alias("created_at"),
        F.col("props").alias("text"), F.lit("en").alias("lang"),
        F.struct(F.col("user_id").alias("id"), F.concat(F.lit("user"), "user_id").alias("screen_name"),
                 F.from_json("props", "k bigint")["k"].alias("followers_count")).alias("user"),
    ).write.parquet(path)
    return readers.read_statuses(spark, path)


@query("sink_csv", "SELECT l_orderkey, l_linenumber, round(l_discount, 6) AS l_discount, l_returnflag FROM lineitem")
def sink_csv(spark, sf_dir):
    path = scratch_path(spark, "csv")
    rows = fx.table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_discount", "l_returnflag")
    writers.write_csv(rows, path)
    return readers.read_header_csv(spark, path, rows.schema).withColumn("l_discount", F.round("l_discount", 6))


@query("sink_append_results", f"""WITH {fx.THREADS_SQL}
SELECT thread_id, arg_min(label, pos) AS first_label, count(*) AS n_replies,
  CASE WHEN count(DISTINCT label) <> 2 THEN 'single_label' ELSE 'mixed' END AS outcome
FROM threads WHERE pos > 0 GROUP BY thread_id""")
def sink_append_results(spark, sf_dir):
    """Two appends to one result table, one per outcome."""
    flags = rel.thread_homophily(fx.thread_posts(spark, sf_dir), "thread_id", "pos", "label")
    path = scratch_path(spark, "results")
    for kind in (0, 1):
        writers.append_results(flags.where(F.col("homophilous") == kind), path)
    return spark.read.parquet(path).select("thread_id", "first_label", "n_replies", "outcome")
