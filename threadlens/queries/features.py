"""Feature groups over every post, document, thread and vector."""

from __future__ import annotations

from pyspark.sql import functions as F

from threadlens import lexicons as lex
from threadlens.functions import text as tx
from threadlens.functions import vectors as vec
from threadlens.operators import features as ft
from threadlens.operators import relational as rel
from threadlens.operators import threads as th
from threadlens.queries import fixtures as fx
from threadlens.queries.registry import query
from threadlens.session import materialize
from threadlens.queries.text import (
    CAPITALIZED_SQL, FULL_CAPITALIZED_SQL, NEGATION_SQL, RELICS_SQL, SLANG_SQL,
)

STOP = lex.english_stop_words()
REAL = ["anger", "fear", "joy", "sadness", "vader_compound_score", "textblob_polarity_score"]
# polarities are short decimals, which six digits would cut exactly half way
DIGITS = {"textblob_polarity_score": 9}
TOKENS_SQL = fx.sql_word_tokens("text", STOP)

READABILITY_SQL = f"""SELECT doc_id, source,
  len({fx.sql_whitespace_tokens('text')}) / 300.0::DOUBLE AS avg_word_count,
  {fx.sql_count('text', tx.EMOJI)} AS emoji_count, {SLANG_SQL} AS slang_count,
  {CAPITALIZED_SQL} AS capitalized_count, {FULL_CAPITALIZED_SQL} AS full_capitalized_count, {RELICS_SQL}
FROM posts"""


@query("feat_readability", f"""WITH {fx.POSTS_SQL}, r AS ({READABILITY_SQL})
SELECT * EXCLUDE (source) REPLACE (round(avg_word_count, 6) AS avg_word_count) FROM r""")
def feat_readability(spark, sf_dir):
    return ft.readability(fx.posts(spark, sf_dir), ["doc_id"], "text").withColumn(
        "avg_word_count", F.round("avg_word_count", 6))


def _grams(low, high):
    return fx.sql_ngrams("toks", low, high)


@query("feat_ngrams", f"""WITH {fx.POSTS_SQL},
t AS (SELECT doc_id, {TOKENS_SQL} AS toks, {fx.sql_word_tokens('text')} AS all_toks FROM posts),
g AS (SELECT doc_id, {_grams(1, 3)} AS grams, {fx.sql_ngrams('all_toks', 1, 4)} AS wide FROM t)
SELECT doc_id, CAST(len(grams) AS BIGINT) AS n_grams, md5(array_to_string(grams, '|')) AS digest,
       CAST(len(wide) AS BIGINT) AS n_wide, md5(array_to_string(wide, '|')) AS wide_digest FROM g""")
def feat_ngrams(spark, sf_dir):
    posts = fx.posts(spark, sf_dir).select("doc_id", "text")
    grams = ft.with_grams(ft.with_grams(posts, "text", 1, 3, STOP, "grams"), "text", 1, 4, None, "wide")
    return grams.select(
        "doc_id", F.size("grams").cast("long").alias("n_grams"), F.md5(F.array_join("grams", "|")).alias("digest"),
        F.size("wide").cast("long").alias("n_wide"), F.md5(F.array_join("wide", "|")).alias("wide_digest"))


def _vocabulary_sql(source: str, low=1, high=3, k=1000) -> str:
    """CTEs grams, counts and vocab over a relation (doc_id, text)."""
    return f"""t AS (SELECT doc_id, {TOKENS_SQL} AS toks FROM {source}),
grams AS (SELECT doc_id, unnest({_grams(low, high)}) AS term FROM t),
counts AS (SELECT doc_id, term, count(*) AS tf FROM grams GROUP BY ALL),
vocab AS (SELECT term, sum(tf) AS tf, count(*) AS df, (SELECT count(*) FROM {source}) AS n
  FROM counts GROUP BY term HAVING df >= 0.01 * n AND df <= 0.9 * n ORDER BY 2 DESC, 1 LIMIT {k}),
idf AS (SELECT term, ln((n + 1.0) / (df + 1.0)) + 1 AS idf FROM vocab)"""


def _weights_sql(counts: str) -> str:
    return f"""w AS (SELECT c.doc_id, c.term, c.tf * i.idf AS w FROM {counts} c JOIN idf i USING (term))
SELECT doc_id, term, round(w / sqrt(sum(w * w) OVER (PARTITION BY doc_id)), 6) AS weight FROM w"""


@query("topk_vocabulary", f"""WITH {fx.POSTS_SQL}, {_vocabulary_sql('posts')}
SELECT term, CAST(tf AS BIGINT) AS tf, CAST(df AS BIGINT) AS df FROM vocab""")
def topk_vocabulary(spark, sf_dir):
    return ft.vocabulary(fx.posts(spark, sf_dir), "text", 1, 3, STOP).select("term", "tf", "df")


@query("feat_tfidf_fit", f"WITH {fx.POSTS_SQL}, {_vocabulary_sql('posts')}, {_weights_sql('counts')}")
def feat_tfidf_fit(spark, sf_dir):
    posts = fx.posts(spark, sf_dir)
    model = ft.fit_tfidf(posts, "text", 1, 3, STOP)
    vectors = model.transform(posts.select("doc_id", "text"), "text")
    return model.long_form(vectors, "tfidf", ["doc_id"]).withColumn("weight", F.round("weight", 6))


@query("feat_tfidf_transform", f"""WITH {fx.POSTS_SQL}, {_vocabulary_sql('posts')},
turns AS (SELECT conv_id * 100 + turn AS doc_id, {fx.sql_word_tokens('text', STOP)} AS toks FROM conversations),
new_grams AS (SELECT doc_id, unnest({_grams(1, 3)}) AS term FROM turns),
new_counts AS (SELECT doc_id, term, count(*) AS tf FROM new_grams GROUP BY ALL), {_weights_sql('new_counts')}""")
def feat_tfidf_transform(spark, sf_dir):
    """A vocabulary fitted on the posts weighs the turns of the conversations."""
    model = ft.fit_tfidf(fx.posts(spark, sf_dir), "text", 1, 3, STOP)
    turns = fx.thread_posts(spark, sf_dir).select((F.col("thread_id") * 100 + F.col("pos")).alias("doc_id"), "text")
    return model.long_form(model.transform(turns, "text"), "tfidf", ["doc_id"]).withColumn(
        "weight", F.round("weight", 6))


@query("feat_bow", f"""WITH c AS (SELECT conv_id AS thread_id, turn AS pos, unnest({TOKENS_SQL}) AS term FROM conversations)
SELECT thread_id, pos, term, count(*) AS tf FROM c GROUP BY ALL""")
def feat_bow(spark, sf_dir):
    return th.term_counts(fx.thread_posts(spark, sf_dir), ["thread_id", "pos"], "text", STOP)


_SCALED = ["c_acctbal", "n_orders", "total", "constant"]


@query("feat_minmax_scale", """WITH c AS (SELECT c_custkey, c_acctbal, count(o_orderkey) AS n_orders,
  max(o_totalprice) AS total, 7 AS constant FROM customer LEFT JOIN orders ON c_custkey = o_custkey GROUP BY ALL),
r AS (SELECT min(c_acctbal) a0, max(c_acctbal) a1, min(n_orders) n0, max(n_orders) n1, min(total) t0, max(total) t1 FROM c)
SELECT c_custkey, round((c_acctbal - a0) / (a1 - a0), 6) AS c_acctbal,
  round((n_orders - n0) / (n1 - n0), 6) AS n_orders,
  round((total - t0) / (t1 - t0), 6) AS total, 0.0::DOUBLE AS constant FROM c, r""")
def feat_minmax_scale(spark, sf_dir):
    orders = fx.table(spark, sf_dir, "orders").groupBy(F.col("o_custkey").alias("c_custkey")).agg(
        F.count("*").alias("n_orders"), F.max("o_totalprice").alias("total"))
    base = fx.table(spark, sf_dir, "customer").select("c_custkey", "c_acctbal").join(orders, "c_custkey", "left").select(
        "c_custkey", "c_acctbal", F.coalesce("n_orders", F.lit(0)).alias("n_orders"), "total",
        F.lit(7).alias("constant"))
    scaled = ft.min_max_scale(base, _SCALED)
    return scaled.select("c_custkey", *[F.round(c, 6).alias(c) for c in _SCALED])


def _bins_sql(column: str) -> str:
    low, width = f"(SELECT min({column}) FROM base)", f"(SELECT (max({column}) - min({column})) / 3.0 FROM base)"
    return (f"CAST(CASE WHEN {column} <= {low} + {width} THEN 0 WHEN {column} <= {low} + {width} * 2 THEN 1 "
            f"ELSE 2 END AS INTEGER) AS {column}")


_TRAIT_SOURCES = {
    "ADMIRATION": "o_totalprice", "AGRE": "o_totalprice * 0.5", "ANXIETY": "o_totalprice + o_custkey",
    "AVOIDANCE": "o_custkey * 1.5", "CONS": "o_orderkey % 977", "EXTR": "o_orderkey % 613 + 0.25",
    "NARCISSISM": "o_custkey % 101 * 1.0", "NEUR": "sqrt(o_totalprice)", "OPEN": "o_totalprice - o_custkey",
    "RIVALRY": "ln(o_totalprice + 1)",
}


@query("feat_equal_width_bins",
       "WITH base AS (SELECT o_orderkey AS twitter_uid, "
       + ", ".join(f"CAST({e} AS DOUBLE) AS {n}" for n, e in _TRAIT_SOURCES.items())
       + " FROM orders) SELECT twitter_uid, " + ", ".join(_bins_sql(n) for n in _TRAIT_SOURCES) + " FROM base")
def feat_equal_width_bins(spark, sf_dir):
    base = fx.table(spark, sf_dir, "orders").select(
        F.col("o_orderkey").alias("twitter_uid"),
        *[F.expr(e).cast("double").alias(n) for n, e in _TRAIT_SOURCES.items()])
    return ft.equal_width_bins(base, list(_TRAIT_SOURCES), 3)


def _emotion_sql(position: int, name: str) -> str:
    kept = lex.gated_emoji(lex.SEED_EMOJI)
    pattern = "[" + "".join(e[0] for e in kept) + "]"
    values = f"map({fx.sql_list(e[0] for e in kept)}, [{', '.join(str(e[position]) + '::DOUBLE' for e in kept)}])"
    found = f"regexp_extract_all(text, {fx.sql_string(pattern)})"
    return f"coalesce(list_avg(list_transform({found}, lambda c: ({values})[c])), 0.0) AS {name}"


def sql_rounded(columns) -> str:
    return ", ".join(f"round({c}, {DIGITS.get(c, 6)}) + 0.0 AS {c}" for c in columns)


EMOTIONS_SQL = ", ".join(_emotion_sql(i + 2, n) for i, n in enumerate(["anger", "fear", "joy", "sadness"]))


@query("agg_emotion_mean", f"WITH {fx.POSTS_SQL}, e AS (SELECT doc_id, {EMOTIONS_SQL} FROM posts) SELECT doc_id, "
       + sql_rounded(REAL[:4]) + " FROM e")
def agg_emotion_mean(spark, sf_dir):
    means = ft.emotion_means(F.col("text"))
    return fx.posts(spark, sf_dir).select("doc_id", *[F.round(c, 6).alias(n) for n, c in means.items()])


WORD_SCORE_SQL = f"""{fx.WORD_SCORES_SQL},
toks AS (SELECT doc_id, {fx.sql_word_tokens('text')} AS toks FROM posts),
found AS (SELECT doc_id, unnest(toks) AS word, unnest(range(1, len(toks) + 1)) AS i, toks FROM toks),
scored AS (SELECT doc_id, valence, polarity,
  list_has_any(list_slice(toks, greatest(i - 3, 1), i - 1), {fx.sql_list(lex.NEGATIONS)}) AND i > 1 AS negated
  FROM found JOIN lexicon USING (word)),
sums AS (SELECT doc_id, sum(CASE WHEN negated THEN -0.74 * valence ELSE valence END) AS s, avg(polarity) AS p,
  count(*) AS n FROM scored GROUP BY doc_id),
word_scores AS (SELECT p.doc_id, coalesce(s / sqrt(s * s + 15), 0) AS vader_compound_score,
  coalesce(sums.p, 0) AS textblob_polarity_score, coalesce(n, 0) AS scored_words
  FROM posts p LEFT JOIN sums USING (doc_id))"""


def _word_scores(spark, sf_dir):
    return ft.word_scores(fx.posts(spark, sf_dir), "doc_id", "text", fx.word_scores(spark))


@query("feat_valence_compound", f"""WITH {fx.POSTS_SQL}, {WORD_SCORE_SQL}
SELECT doc_id, {sql_rounded(["vader_compound_score"])}, scored_words FROM word_scores""")
def feat_valence_compound(spark, sf_dir):
    return _word_scores(spark, sf_dir).select(
        "doc_id", (F.round("vader_compound_score", 6) + 0.0).alias("vader_compound_score"), "scored_words")


@query("feat_polarity_mean", f"""WITH {fx.POSTS_SQL}, {WORD_SCORE_SQL}
SELECT doc_id, {sql_rounded(["textblob_polarity_score"])} FROM word_scores""")
def feat_polarity_mean(spark, sf_dir):
    return _word_scores(spark, sf_dir).select(
        "doc_id", (F.round("textblob_polarity_score", 9) + 0.0).alias("textblob_polarity_score"))


SENTIMENT_SQL = f"SELECT doc_id, {EMOTIONS_SQL}, {NEGATION_SQL} AS negation, vader_compound_score, " \
    "textblob_polarity_score FROM posts JOIN word_scores USING (doc_id)"


def _rounded(df, columns):
    return df.withColumns({c: F.round(c, DIGITS.get(c, 6)) + 0.0 for c in columns})


@query("feat_sentiment", f"WITH {fx.POSTS_SQL}, {WORD_SCORE_SQL}, s AS ({SENTIMENT_SQL}) "
       f"SELECT doc_id, negation, {sql_rounded(REAL)} FROM s")
def feat_sentiment(spark, sf_dir):
    return _rounded(ft.sentiment(fx.posts(spark, sf_dir), "doc_id", "text", fx.word_scores(spark)), REAL)


_MATRIX = rel.group_columns(["readability", "sentiment"])


@query("feat_matrix_assemble", f"""WITH {fx.POSTS_SQL}, {WORD_SCORE_SQL},
r AS ({READABILITY_SQL}), s AS ({SENTIMENT_SQL}),
m AS (SELECT * EXCLUDE (source) FROM r JOIN s USING (doc_id))
SELECT doc_id, CAST(quality AS DOUBLE) AS ground_truth, """ + ", ".join(
    f"round(coalesce(({c} - min({c}) OVER ())::DOUBLE / nullif(max({c}) OVER () - min({c}) OVER (), 0), 0), {DIGITS.get(c, 6)}) + 0.0 AS {c}"
    for c in _MATRIX) + " FROM m LEFT JOIN labels USING (doc_id)")
def feat_matrix_assemble(spark, sf_dir):
    """Scalar groups of every post with its label, scaled; the label and the key are not scaled."""
    posts = fx.posts(spark, sf_dir)
    inline = {**ft.readability_columns(F.col("text")), **ft.emotion_columns(F.col("text"))}
    base = posts.select("doc_id", *[c.alias(n) for n, c in inline.items()])
    scores = ft.word_scores(posts, "doc_id", "text", fx.word_scores(spark)).drop("scored_words")
    labels = fx.table(spark, sf_dir, "labels").select("doc_id", F.col("quality").cast("double").alias("ground_truth"))
    matrix = materialize(rel.full_outer_features([base, scores, labels], "doc_id"), "raw-matrix")
    scaled = ft.min_max_scale(matrix, _MATRIX)
    return scaled.select("doc_id", "ground_truth", *[(F.round(c, DIGITS.get(c, 6)) + 0.0).alias(c) for c in _MATRIX])


@query("feature_group_select", f"""WITH {fx.POSTS_SQL}, {WORD_SCORE_SQL}, r AS ({READABILITY_SQL}), s AS ({SENTIMENT_SQL})
SELECT r.* EXCLUDE (source) REPLACE (round(avg_word_count, 6) AS avg_word_count), negation, {sql_rounded(REAL)}
FROM r JOIN s USING (doc_id)""")
def feature_group_select(spark, sf_dir):
    posts = fx.posts(spark, sf_dir)
    wide = ft.readability(posts, ["doc_id", "source"], "text").join(
        ft.sentiment(posts, "doc_id", "text", fx.word_scores(spark)), "doc_id")
    return _rounded(rel.select_feature_groups(wide, "doc_id", ["readability", "sentiment"]), REAL + ["avg_word_count"])


@query("feat_external_scores", f"""WITH {fx.POSTS_SQL} SELECT p.doc_id, round(length(p.text) / 1000.0::DOUBLE, 6) AS size_k,
  quality * 10.0::DOUBLE AS Analytic, toxic * 5.0::DOUBLE AS Clout, (quality + toxic)::DOUBLE AS Authentic,
  (quality - toxic)::DOUBLE AS Tone FROM posts p JOIN labels l ON p.doc_id = l.doc_id""")
def feat_external_scores(spark, sf_dir):
    """Four scores computed elsewhere join the posts by key; other columns of the score table are ignored."""
    scores = fx.table(spark, sf_dir, "labels").selectExpr(
        "doc_id", "quality", "quality * 10.0D AS Analytic", "toxic * 5.0D AS Clout",
        "CAST(quality + toxic AS DOUBLE) AS Authentic", "CAST(quality - toxic AS DOUBLE) AS Tone"
    ).select("doc_id", *rel.group_columns(["liwc"]))
    posts = fx.posts(spark, sf_dir).select("doc_id", F.round(F.length("text") / 1000.0, 6).alias("size_k"))
    return posts.join(scores, "doc_id")


@query("feat_cosine_pairs", """WITH v AS (SELECT vec_id, label, CAST(embedding AS DOUBLE[]) AS e FROM embeddings),
r AS (SELECT label, arg_min(e, vec_id) AS root, min(vec_id) AS root_id FROM v GROUP BY label)
SELECT root_id, vec_id, round(list_dot_product(e, root) /
  (sqrt(list_dot_product(e, e)) * sqrt(list_dot_product(root, root))), 6) + 0.0 AS similarity
FROM v JOIN r USING (label) WHERE vec_id <> root_id""")
def feat_cosine_pairs(spark, sf_dir):
    """Cosine of each group's first vector with every other vector of the group."""
    vectors = fx.table(spark, sf_dir, "embeddings").select(
        "vec_id", "label", F.col("embedding").cast("array<double>").alias("e"))
    roots = vectors.groupBy("label").agg(
        F.min_by("e", "vec_id").alias("root"), F.min("vec_id").alias("root_id"))
    pairs = vectors.join(roots, "label").where(F.col("vec_id") != F.col("root_id"))
    return pairs.select(
        "root_id", "vec_id", (F.round(vec.cosine(F.col("root"), F.col("e")), 6) + 0.0).alias("similarity"))
