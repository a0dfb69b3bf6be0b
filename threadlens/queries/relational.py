"""Projections, filters, joins, aggregates and set operations."""

from __future__ import annotations

from pyspark.sql import functions as F

from threadlens import lexicons as lex
from threadlens.functions import text as tx
from threadlens.operators import features as ft
from threadlens.operators import relational as rel
from threadlens.operators import threads as th
from threadlens.operators.skew import position_in_group
from threadlens.queries import fixtures as fx
from threadlens.queries.registry import query
from threadlens.session import materialize

LOW, HIGH = 3, 7
TOKEN_SQL = fx.arithmetic_sql("doc_id")
SIZES_SQL = f"""{fx.THREADS_SQL},
sizes AS (SELECT thread_id, count(*) FILTER (pos > 0) AS n_replies FROM threads GROUP BY thread_id)"""


# ---- projections and filters ----------------------------------------------------------------


@query("project_rename_drop", """
SELECT c_custkey AS user_id, c_acctbal AS extraversion, c_acctbal / 2 AS agreeableness, c_acctbal + 1 AS openness,
  c_acctbal * 3 AS conscientiousness, c_acctbal - 5 AS neuroticism, CAST(c_nationkey AS BIGINT) AS anxiety,
  CAST(c_nationkey * 2 AS BIGINT) AS avoidance FROM customer""")
def project_rename_drop(spark, sf_dir):
    raw = fx.table(spark, sf_dir, "customer").selectExpr(
        "c_custkey AS user_id", "c_acctbal AS E", "c_acctbal / 2 AS A", "c_acctbal + 1 AS O", "c_acctbal * 3 AS C",
        "c_acctbal - 5 AS N", "CAST(c_nationkey AS BIGINT) AS ANXIETY", "CAST(c_nationkey * 2 AS BIGINT) AS AVOIDANCE",
        "c_name AS text")
    return rel.rename_traits(raw, ["text"])


@query("filter_thread_size", f"""WITH {SIZES_SQL}
SELECT thread_id, pos, n_replies FROM threads JOIN sizes USING (thread_id) WHERE n_replies BETWEEN {LOW} AND {HIGH}""")
def filter_thread_size(spark, sf_dir):
    posts = fx.thread_posts(spark, sf_dir).select("thread_id", "pos")
    return rel.filter_thread_size(posts, "thread_id", F.col("pos") > 0, LOW, HIGH).select("thread_id", "pos", "n_replies")


@query("filter_min_followers", "SELECT event_id, user_id, round(value, 6) AS followers FROM events WHERE value >= 25")
def filter_min_followers(spark, sf_dir):
    events = fx.table(spark, sf_dir, "events").select(
        "event_id", "user_id", F.col("value").alias("followers"))
    return rel.filter_min_followers(events, "followers", 25).withColumn("followers", F.round("followers", 6))


KEYWORDS = ["Theou", "edly", "can't"]


@query("filter_lang_keywords", f"""WITH {fx.POSTS_SQL}
SELECT doc_id, source FROM posts WHERE lang = 'en' AND (""" + " OR ".join(
    f"contains(lower(text), {fx.sql_string(k.lower())})" for k in KEYWORDS) + ")")
def filter_lang_keywords(spark, sf_dir):
    return rel.filter_language_keywords(fx.posts(spark, sf_dir), "lang", "text", KEYWORDS).select("doc_id", "source")


def _labelled(spark, sf_dir):
    return fx.table(spark, sf_dir, "documents").select("doc_id", "source").join(
        fx.table(spark, sf_dir, "labels"), "doc_id", "left")


@query("drop_missing", """SELECT d.doc_id, source, quality, toxic FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id
WHERE quality IS NOT NULL AND toxic IS NOT NULL""")
def drop_missing(spark, sf_dir):
    return _labelled(spark, sf_dir).na.drop("any")


@query("fill_cast_id", """SELECT d.doc_id, coalesce(CAST(l.doc_id AS BIGINT), 0) AS status_id
FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id""")
def fill_cast_id(spark, sf_dir):
    found = fx.table(spark, sf_dir, "labels").select("doc_id", F.col("doc_id").cast("string").alias("raw_id"))
    return fx.table(spark, sf_dir, "documents").select("doc_id").join(found, "doc_id", "left").select(
        "doc_id", rel.fill_id(F.col("raw_id")).alias("status_id"))


@query("slice_offset_limit", "SELECT o_orderkey, o_custkey FROM orders ORDER BY o_orderkey LIMIT 6000 OFFSET 2500")
def slice_offset_limit(spark, sf_dir):
    return rel.slice_rows(fx.table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey"),
                          "o_orderkey", 2500, 8500).select("o_orderkey", "o_custkey")


@query("split_root_replies", f"""WITH {fx.THREADS_SQL}
SELECT thread_id, pos, CASE WHEN pos = 0 THEN 'root' ELSE 'reply' END AS part FROM threads""")
def split_root_replies(spark, sf_dir):
    return fx.thread_posts(spark, sf_dir).select(
        "thread_id", "pos", F.when(F.col("pos") > 0, "reply").otherwise("root").alias("part"))


@query("recode_category", """SELECT l_orderkey, l_linenumber,
  CAST(CASE l_returnflag WHEN 'A' THEN 0 WHEN 'N' THEN 1 WHEN 'R' THEN 2 END AS INTEGER) AS code FROM lineitem""")
def recode_category(spark, sf_dir):
    return fx.table(spark, sf_dir, "lineitem").select(
        "l_orderkey", "l_linenumber", tx.recode(F.col("l_returnflag"), {"A": 0, "N": 1, "R": 2}).alias("code"))


@query("surrogate_row_key", """SELECT user_id AS thread_id, event_id,
  row_number() OVER (PARTITION BY user_id ORDER BY event_id) - 1 AS row_key FROM events""")
def surrogate_row_key(spark, sf_dir):
    events = fx.table(spark, sf_dir, "events").select(F.col("user_id").alias("thread_id"), "event_id")
    return position_in_group(events, ["thread_id"], "event_id", 4096, "row_key")


@query("single_line_text", f"""WITH {fx.POSTS_SQL}
SELECT doc_id, replace(replace(text, chr(10), chr(13) || chr(10)), chr(13) || chr(10), ' ') AS line FROM posts""")
def single_line_text(spark, sf_dir):
    broken = F.replace("text", F.lit("\n"), F.lit("\r\n"))
    return fx.posts(spark, sf_dir).select("doc_id", tx.single_line(broken).alias("line"))


# ---- joins ----------------------------------------------------------------------------------


@query("join_features_full_outer", """SELECT coalesce(d.doc_id, l.doc_id, v.vec_id) AS user_id,
  CAST(n_chars AS DOUBLE) AS n_chars, CAST(quality AS DOUBLE) AS quality, round(e, 6) AS e0
FROM documents d FULL JOIN labels l ON d.doc_id = l.doc_id
FULL JOIN (SELECT vec_id, embedding[1]::DOUBLE AS e FROM embeddings) v ON v.vec_id = coalesce(d.doc_id, l.doc_id)""")
def join_features_full_outer(spark, sf_dir):
    sizes = fx.table(spark, sf_dir, "documents").selectExpr("doc_id AS user_id", "CAST(n_chars AS DOUBLE) AS n_chars")
    labels = fx.table(spark, sf_dir, "labels").selectExpr("doc_id AS user_id", "CAST(quality AS DOUBLE) AS quality")
    vectors = fx.table(spark, sf_dir, "embeddings").selectExpr(
        "vec_id AS user_id", "round(CAST(embedding[0] AS DOUBLE), 6) AS e0")
    return rel.full_outer_features([sizes, labels, vectors], "user_id")


@query("join_inner_labels",
       "SELECT d.doc_id, source, quality, toxic FROM documents d JOIN labels l ON d.doc_id = l.doc_id")
def join_inner_labels(spark, sf_dir):
    return fx.table(spark, sf_dir, "documents").select("doc_id", "source").join(
        fx.table(spark, sf_dir, "labels"), "doc_id")


@query("concat_columns_aligned", f"""WITH {fx.POSTS_SQL} SELECT doc_id, round(embedding[1]::DOUBLE, 6) AS e0,
  {fx.sql_count('text', tx.EMOJI)} AS emoji_count FROM posts JOIN embeddings ON doc_id = vec_id""")
def concat_columns_aligned(spark, sf_dir):
    """Columns of two tables side by side, always by key and never by position."""
    left = fx.table(spark, sf_dir, "embeddings").selectExpr(
        "vec_id AS doc_id", "round(CAST(embedding[0] AS DOUBLE), 6) AS e0")
    right = fx.posts(spark, sf_dir).select("doc_id", tx.emoji_count(F.col("text")).alias("emoji_count"))
    return left.join(right, "doc_id")


@query("join_thread_replies", """WITH e AS (SELECT event_id, ts, user_id * 1000 + event_id // 2000 AS conversation_id FROM events),
roots AS (SELECT conversation_id, min(event_id) AS root_id, CAST(arg_min(ts, event_id) AS DATE) AS day FROM e GROUP BY ALL)
SELECT root_id, event_id AS reply_id FROM e JOIN roots USING (conversation_id)
WHERE event_id <> root_id AND CAST(ts AS DATE) >= day AND CAST(ts AS DATE) < day + 5""")
def join_thread_replies(spark, sf_dir):
    """A user's events within one span are a conversation whose first event is the root."""
    posts = fx.table(spark, sf_dir, "events").select(
        F.col("event_id").alias("reply_id"), "ts",
        (F.col("user_id") * 1000 + F.floor(F.col("event_id") / 2000)).alias("conversation_id"))
    roots = posts.groupBy("conversation_id").agg(
        F.min("reply_id").alias("root_id"), F.to_date(F.min_by("ts", "reply_id")).alias("root_date"))
    return rel.match_replies(roots, posts, 5).select("root_id", "reply_id")


@query("join_lexicon_count", f"""WITH {fx.POSTS_SQL}, t AS (
  SELECT source, unnest({fx.sql_whitespace_tokens('lower(text)')}) AS w FROM posts)
SELECT source, count(*) FILTER (list_contains({fx.sql_list(lex.SEED_SLANG)}, w)) AS hits FROM t GROUP BY source""")
def join_lexicon_count(spark, sf_dir):
    lexicon = spark.createDataFrame([(s,) for s in lex.SEED_SLANG], "slang string")
    return rel.lexicon_hits(fx.posts(spark, sf_dir), "source", "text", lexicon, "slang")


@query("join_author_history", """WITH r AS (SELECT source, doc_id, text,
  row_number() OVER (PARTITION BY source ORDER BY doc_id DESC) AS rank FROM documents),
h AS (SELECT source, string_agg(text, '' ORDER BY rank) AS history, count(*) AS n_posts FROM r WHERE rank <= 100 GROUP BY source)
SELECT doc_id, source, md5(history) AS digest, CAST(length(history) AS BIGINT) AS n_chars, n_posts
FROM documents JOIN h USING (source)""")
def join_author_history(spark, sf_dir):
    documents = fx.table(spark, sf_dir, "documents")
    history = rel.recent_history(
        documents.select("source", "doc_id", "text"), "source", [F.desc("doc_id")], ["doc_id"], "text", 100)
    digest = history.select("source", F.md5("history").alias("digest"),
                            F.length("history").cast("long").alias("n_chars"), "n_posts")
    return rel.attach_history(documents.select("doc_id", "source"), digest, "source")


@query("join_nest_replies", f"""WITH {SIZES_SQL}
SELECT thread_id, coalesce(any_value(n_replies), 0) AS n_replies,
  coalesce(string_agg(pos::VARCHAR, ',' ORDER BY pos) FILTER (pos > 0), '') AS reply_positions,
  md5(coalesce(string_agg(text, '|' ORDER BY pos) FILTER (pos > 0), '')) AS digest, md5(max(text) FILTER (pos = 0)) AS root_digest
FROM threads LEFT JOIN sizes USING (thread_id) GROUP BY thread_id""")
def join_nest_replies(spark, sf_dir):
    nested = rel.nest_replies(fx.thread_posts(spark, sf_dir), "thread_id", "pos", ["text"])
    return nested.select(
        "thread_id", "n_replies", F.array_join(F.transform("replies", lambda r: r["pos"]), ",").alias("reply_positions"),
        F.md5(F.array_join(F.transform("replies", lambda r: r["text"]), "|")).alias("digest"),
        F.md5("text").alias("root_digest"))


def _sampled_ids_sql(n: int) -> str:
    return f"""picked AS (SELECT doc_id, quality AS label FROM (SELECT *, row_number() OVER (
  PARTITION BY quality ORDER BY {TOKEN_SQL}, doc_id) AS r FROM labels) WHERE r <= {n})"""


@query("semi_join_sample", f"""WITH {_sampled_ids_sql(30)}
SELECT doc_id, source, lang FROM documents WHERE doc_id IN (SELECT doc_id FROM picked)""")
def semi_join_sample(spark, sf_dir):
    labels = fx.table(spark, sf_dir, "labels").select("doc_id", "quality")
    picked = rel.stratified_sample(labels, "quality", fx.arithmetic_token("doc_id"), "doc_id", 30)
    return fx.table(spark, sf_dir, "documents").select("doc_id", "source", "lang").join(picked, "doc_id", "left_semi")


GRID = [-0.2, -0.1, 0.0, 0.1, 0.2]


@query("cross_join_grid", f"""SELECT vec_id, g AS forced, round((embedding[1] + embedding[2])::DOUBLE * g, 6) + 0.0 AS product
FROM embeddings, (SELECT unnest([{', '.join(f'{g}::DOUBLE' for g in GRID)}]) AS g)""")
def cross_join_grid(spark, sf_dir):
    vectors = fx.table(spark, sf_dir, "embeddings").selectExpr(
        "vec_id", "CAST(embedding[0] + embedding[1] AS DOUBLE) AS e")
    return rel.with_grid(vectors, GRID, "forced").select(
        "vec_id", "forced", (F.round(F.col("e") * F.col("forced"), 6) + 0.0).alias("product"))


# ---- aggregates -----------------------------------------------------------------------------


@query("agg_concat_posts", f"""WITH {fx.POSTS_SQL}
SELECT source AS user_id, md5(string_agg(text, '' ORDER BY doc_id)) AS digest,
  CAST(sum(length(text)) AS BIGINT) AS n_chars, count(*) AS n_posts FROM posts GROUP BY source""")
def agg_concat_posts(spark, sf_dir):
    posts = fx.posts(spark, sf_dir).withColumnRenamed("source", "user_id")
    corpus = rel.concat_posts(posts, "user_id", "doc_id", "text")
    return corpus.select("user_id", F.md5("corpus").alias("digest"),
                         F.length("corpus").cast("long").alias("n_chars"), "n_posts")


PART_POSTS, PART_REPLIES = 256, 2


@query("agg_concat_parts", f"""WITH {fx.POSTS_SQL}
SELECT source AS user_id, doc_id // {PART_POSTS} AS part, md5(string_agg(text, '' ORDER BY doc_id)) AS digest,
  CAST(sum(length(text)) AS BIGINT) AS n_chars, count(*) AS n_posts FROM posts GROUP BY ALL""")
def agg_concat_parts(spark, sf_dir):
    """Posts concatenated in ordered parts: no cell holds a user of any size."""
    posts = fx.posts(spark, sf_dir).withColumnRenamed("source", "user_id")
    return rel.concat_parts(posts, "user_id", "doc_id", "text", PART_POSTS).select(
        "user_id", "part", F.md5("corpus").alias("digest"), F.length("corpus").cast("long").alias("n_chars"), "n_posts")


@query("join_nest_parts", f"""WITH {fx.THREADS_SQL}
SELECT thread_id, pos // {PART_REPLIES} AS part, count(*) AS n_replies, string_agg(pos::VARCHAR, ',' ORDER BY pos) AS reply_positions,
  md5(string_agg(text, '|' ORDER BY pos)) AS digest FROM threads WHERE pos > 0 GROUP BY ALL""")
def join_nest_parts(spark, sf_dir):
    """Replies nested in ordered parts: no cell holds a thread of any size."""
    return rel.nest_parts(fx.thread_posts(spark, sf_dir), "thread_id", "pos", ["text"], PART_REPLIES).select(
        "thread_id", "part", "n_replies", F.array_join(F.transform("replies", lambda r: r["pos"]), ",").alias("reply_positions"),
        F.md5(F.array_join(F.transform("replies", lambda r: r["text"]), "|")).alias("digest"))


@query("agg_post_count", "SELECT user_id, count(*) AS tweets FROM events GROUP BY user_id")
def agg_post_count(spark, sf_dir):
    return fx.table(spark, sf_dir, "events").groupBy("user_id").agg(F.count("*").alias("tweets"))


@query("agg_reply_stats", f"""WITH {SIZES_SQL} SELECT count(*) AS n_threads, CAST(sum(n_replies) AS BIGINT) AS n_replies,
  round(avg(n_replies), 6) AS mean_replies FROM sizes""")
def agg_reply_stats(spark, sf_dir):
    sizes = rel.thread_sizes(fx.thread_posts(spark, sf_dir), "thread_id", F.col("pos") > 0)
    return rel.reply_stats(sizes).withColumn("mean_replies", F.round("mean_replies", 6))


@query("agg_value_counts", "SELECT quality, count(*) AS n FROM labels GROUP BY quality ORDER BY n DESC")
def agg_value_counts(spark, sf_dir):
    return fx.table(spark, sf_dir, "labels").groupBy("quality").agg(F.count("*").alias("n")).orderBy(F.desc("n"))


@query("agg_label_homophily", f"""WITH {fx.THREADS_SQL}
SELECT thread_id, count(DISTINCT label) AS n_labels, arg_min(label, pos) AS first_label, count(*) AS n_replies,
  CAST(count(DISTINCT label) <> 2 AS INTEGER) AS homophilous FROM threads WHERE pos > 0 GROUP BY thread_id""")
def agg_label_homophily(spark, sf_dir):
    return rel.thread_homophily(fx.thread_posts(spark, sf_dir), "thread_id", "pos", "label")


@query("agg_group_to_list", """SELECT conv_id AS root_id,
  string_agg((conv_id * 100 + turn)::VARCHAR, ',' ORDER BY turn) AS reply_ids
FROM conversations WHERE turn > 0 GROUP BY conv_id""")
def agg_group_to_list(spark, sf_dir):
    replies = fx.table(spark, sf_dir, "conversations").where("turn > 0").selectExpr(
        "conv_id AS root_id", "turn", "conv_id * 100 + turn AS reply_id")
    return rel.list_replies(replies, "root_id", "turn", "reply_id").withColumn(
        "reply_ids", F.array_join("reply_ids", ","))


@query("agg_last_per_key", """SELECT user_id, max(event_id) AS event_id, arg_max(event_type, event_id) AS event_type
FROM events GROUP BY user_id""")
def agg_last_per_key(spark, sf_dir):
    events = fx.table(spark, sf_dir, "events").select("user_id", "event_id", "event_type")
    return rel.last_per_key(events.withColumn("seq", F.col("event_id")), "user_id", "seq").select(
        "user_id", "event_id", "event_type")


@query("distinct_rows", """SELECT lang, md5(text) AS digest, min(doc_id) AS doc_id FROM documents GROUP BY lang, text""")
def distinct_rows(spark, sf_dir):
    kept = rel.distinct_first(fx.table(spark, sf_dir, "documents").select("lang", "text", "doc_id"),
                              ["lang", "text"], "doc_id")
    return kept.select("lang", F.md5("text").alias("digest"), "doc_id")


_MEASURES = ["l_quantity", "l_extendedprice", "l_discount", "l_tax"]


@query("agg_column_minmax", "SELECT " + ", ".join(
    f"round({f}({c}), 6) AS {f}_{c}" for c in _MEASURES for f in ("min", "max")) + " FROM lineitem")
def agg_column_minmax(spark, sf_dir):
    stats = rel.min_max(fx.table(spark, sf_dir, "lineitem"), _MEASURES)
    return stats.select(*[F.round(c, 6).alias(c) for c in stats.columns])


@query("agg_class_count", """SELECT count(*) AS n_rows, CAST(5 AS INTEGER) AS n_categories,
  'l_quantity, l_extendedprice, l_discount, l_tax, l_returnflag' AS categories FROM lineitem""")
def agg_class_count(spark, sf_dir):
    rows = fx.table(spark, sf_dir, "lineitem").select(*_MEASURES, "l_returnflag")
    return rows.agg(F.count("*").alias("n_rows")).select(
        "n_rows", F.lit(len(rows.columns)).alias("n_categories"), F.lit(", ".join(rows.columns)).alias("categories"))


# ---- ranking and set operations -------------------------------------------------------------


WORD_WEIGHTS_SQL = f"""{fx.THREADS_SQL},
tok AS (SELECT thread_id, pos, unnest({fx.sql_word_tokens('text', lex.english_stop_words())}) AS term FROM threads),
tf AS (SELECT thread_id, pos, term, count(*) AS tf FROM tok GROUP BY ALL),
n AS (SELECT thread_id, count(*) AS n FROM threads WHERE pos > 0 GROUP BY thread_id),
df AS (SELECT thread_id, term, count(*) AS df FROM tf WHERE pos > 0 GROUP BY ALL),
w AS (SELECT thread_id, pos, term, tf * (ln((n + 1.0) / (df + 1.0)) + 1) AS w
  FROM tf JOIN df USING (thread_id, term) JOIN n USING (thread_id)),
weights AS (SELECT thread_id, pos, term, w / sqrt(sum(w * w) OVER (PARTITION BY thread_id, pos)) AS weight FROM w)"""


@query("topk_word_weights", f"""WITH {WORD_WEIGHTS_SQL},
c AS (SELECT thread_id, term AS word,
  round(weight * (length(term) % 5 - 2), 6) + 0.0 AS contribution FROM weights WHERE pos = 0),
r AS (SELECT *, row_number() OVER (PARTITION BY thread_id ORDER BY abs(contribution) DESC, word) AS rank
  FROM c WHERE contribution <> 0)
SELECT thread_id, word, contribution, CAST(rank AS INTEGER) AS rank FROM r WHERE rank <= 20""")
def topk_word_weights(spark, sf_dir):
    """Contribution of the root's words under a fixed weight per word."""
    posts = fx.thread_posts(spark, sf_dir)
    weights = th.thread_tfidf(posts, "text", lex.english_stop_words())
    contributions = weights.where(F.col("pos") == 0).select(
        "thread_id", F.col("term").alias("word"),
        (F.round(F.col("weight") * (F.length("term") % 5 - 2), 6) + 0.0).alias("contribution"))
    return th.top_words(contributions, 20)


@query("topk_exemplar_replies", f"""WITH {WORD_WEIGHTS_SQL},
s AS (SELECT a.thread_id, a.pos, sum(a.weight * b.weight) AS s FROM weights a JOIN weights b
  ON a.thread_id = b.thread_id AND a.term = b.term AND a.pos > 0 AND b.pos = 0 GROUP BY ALL),
r AS (SELECT t.thread_id, t.pos, t.label, t.text, coalesce(s, 0) AS similarity, row_number() OVER (
  PARTITION BY t.thread_id, t.label ORDER BY round(coalesce(s, 0), 9) DESC, t.pos DESC) AS rank
  FROM threads t LEFT JOIN s ON s.thread_id = t.thread_id AND s.pos = t.pos WHERE t.pos > 0)
SELECT thread_id, label, CAST(rank AS INTEGER) AS rank, pos, text, round(similarity, 6) + 0.0 AS similarity FROM r WHERE rank <= 2""")
def topk_exemplar_replies(spark, sf_dir):
    posts = fx.thread_posts(spark, sf_dir)
    weights = materialize(th.thread_tfidf(posts, "text", lex.english_stop_words()), "weights")
    return th.exemplars(th.reply_similarity(posts, weights)).select(
        "thread_id", "label", "rank", "pos", "text", (F.round("similarity", 6) + 0.0).alias("similarity"))


@query("argmax_best_model", """WITH s AS (SELECT l_returnflag AS name, round(avg(l_discount), 2) AS score,
  CASE l_returnflag WHEN 'A' THEN 0 WHEN 'N' THEN 1 ELSE 2 END AS position FROM lineitem GROUP BY ALL)
SELECT 'last' AS tie_rule, arg_max(name, score * 1000 + position) AS best, max(score) AS best_score FROM s
UNION ALL SELECT 'first', arg_max(name, score * 1000 - position), max(score) FROM s""")
def argmax_best_model(spark, sf_dir):
    """Scores of three candidates, equal after rounding, under both tie rules."""
    scores = fx.table(spark, sf_dir, "lineitem").groupBy(F.col("l_returnflag").alias("name")).agg(
        F.round(F.avg("l_discount"), 2).alias("score")
    ).withColumn("position", tx.recode(F.col("name"), {"A": 0, "N": 1, "R": 2}))
    last = rel.best_by(scores, "score", "position", "name", last_wins=True)
    first = rel.best_by(scores, "score", "position", "name", last_wins=False)
    return last.select(F.lit("last").alias("tie_rule"), "*").unionByName(
        first.select(F.lit("first").alias("tie_rule"), "*"))


@query("union_append_rows", """SELECT doc_id AS row_id, text FROM documents
UNION ALL SELECT conv_id * 100 + turn, text FROM conversations""")
def union_append_rows(spark, sf_dir):
    return fx.table(spark, sf_dir, "documents").selectExpr("doc_id AS row_id", "text").unionByName(
        fx.table(spark, sf_dir, "conversations").selectExpr("conv_id * 100 + turn AS row_id", "text"))


@query("union_distinct_ids", """SELECT doc_id AS row_id FROM labels WHERE quality = 1
UNION SELECT doc_id FROM labels WHERE toxic = 1""")
def union_distinct_ids(spark, sf_dir):
    labels = fx.table(spark, sf_dir, "labels")
    return labels.where("quality = 1").selectExpr("doc_id AS row_id").union(
        labels.where("toxic = 1").selectExpr("doc_id AS row_id")).distinct()
