"""Inputs shared by the registered queries: tables in the roles of posts, threads and events.

``POSTS_SQL`` and ``posts()`` build the same rows: every document, led by one of a few openings with
the marks (emoji, links, markers, contractions) that the generated prose lacks.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from threadlens import lexicons as lex
from threadlens.functions import text as tx
from threadlens.sources.readers import spread

OPENINGS = [
    "RT #USER# look #URL# #HASHTAG# ARTICLE via amp",
    "😀😀 LOCKED 🔒 good 💔🎱 🇬🇷 not bad",
    "see https://a.example/x and www.b.example CamelCase APple",
    "I can't, i'd've gone; she's not here. BTW lol the plant's great",
    "@name hello!!! (happy/sad), \"one|two\" 'three' #four no good vibes",
    "",
]

ARITHMETIC = 1000003


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def sql_string(value: str) -> str:
    return "'" + value.replace("'", "''") + "'"


def sql_list(values) -> str:
    return "[" + ", ".join(sql_string(v) for v in values) + "]"


def sql_map(entries: dict[str, str]) -> str:
    return f"map({sql_list(entries)}, {sql_list(entries.values())})"


def posts(spark: SparkSession, sf_dir: str) -> DataFrame:
    openings = F.array(*[F.lit(o) for o in OPENINGS])
    opening = F.element_at(openings, (F.col("doc_id") % len(OPENINGS) + 1).cast("int"))
    return spread(table(spark, sf_dir, "documents")).select(
        "doc_id", "source", "lang", F.concat(opening, F.lit(" "), F.col("text")).alias("text")
    )


POSTS_SQL = f"""posts AS (
  SELECT doc_id, source, lang,
         list_extract({sql_list(OPENINGS)}, CAST(doc_id % {len(OPENINGS)} + 1 AS INTEGER)) || ' ' || text AS text
  FROM documents)"""


def thread_posts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Long form of the threads: turn 0 is the root. The label needs no model."""
    return spread(table(spark, sf_dir, "conversations")).select(
        F.col("conv_id").alias("thread_id"), F.col("turn").alias("pos"), "role", "text",
        (F.length("text") % 2).cast("int").alias("label"),
    )


THREADS_SQL = """threads AS (
  SELECT conv_id AS thread_id, turn AS pos, role, text, CAST(length(text) % 2 AS INTEGER) AS label
  FROM conversations)"""


def arithmetic_token(column: str, seed: int = 0) -> Column:
    """Spread of an id over [0, ARITHMETIC) that any SQL engine computes alike."""
    return (F.col(column) * F.lit(2654435761) + F.lit(seed * 7919)) % F.lit(ARITHMETIC)


def arithmetic_sql(column: str, seed: int = 0) -> str:
    return f"(({column} * 2654435761 + {seed * 7919}) % {ARITHMETIC})"


def word_scores(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(lex.SEED_WORD_SCORES, "word string, valence double, polarity double")


WORD_SCORES_SQL = "lexicon(word, valence, polarity) AS (VALUES " + ", ".join(
    f"({sql_string(w)}, {v}::DOUBLE, {p}::DOUBLE)" for w, v, p in lex.SEED_WORD_SCORES
) + ")"


def sql_delete(expr: str, pattern: str) -> str:
    return f"regexp_replace({expr}, {sql_string(pattern)}, '', 'g')"


def sql_count(expr: str, pattern: str) -> str:
    return f"CAST(len(regexp_extract_all({expr}, {sql_string(pattern)})) AS BIGINT)"


def sql_whitespace_tokens(expr: str) -> str:
    return f"list_filter(regexp_split_to_array({expr}, {sql_string(tx.SPACES)}), lambda w: w <> '')"


def sql_word_tokens(expr: str, stop_words: list[str] | None = None) -> str:
    tokens = f"regexp_extract_all(lower({expr}), {sql_string(tx.WORD)})"
    if not stop_words:
        return tokens
    return f"list_filter({tokens}, lambda w: NOT list_contains({sql_list(stop_words)}, w))"


def sql_ngrams(tokens: str, low: int, high: int) -> str:
    parts = [
        f"list_transform(range(1, len({tokens}) - {n - 2}), "
        f"lambda i: array_to_string(list_slice({tokens}, i, i + {n - 1}), ' '))"
        for n in range(low, high + 1)
    ]
    joined = parts[0]
    for part in parts[1:]:
        joined = f"list_concat({joined}, {part})"
    return joined


def sql_relics_gone(expr: str) -> str:
    for relic in lex.RELICS:
        expr = f"replace({expr}, {sql_string(relic)}, '')"
    return expr


def sql_replace_matches(expr: str, pattern: str, mapping: str) -> str:
    return (
        f"array_to_string(list_transform(list_zip(regexp_split_to_array({expr}, {sql_string(pattern)}), "
        f"regexp_extract_all({expr}, {sql_string(pattern)})), "
        f"lambda z: z[1] || coalesce(({mapping})[z[2]], z[2], '')), '')"
    )
