"""Scalar text functions over every post."""

from __future__ import annotations

import re

from pyspark.sql import functions as F

from threadlens import lexicons as lex
from threadlens.functions import emoji as em
from threadlens.functions import text as tx
from threadlens.queries import fixtures as fx
from threadlens.queries.registry import query

def _select(sql_columns: str) -> str:
    return f"WITH {fx.POSTS_SQL} SELECT doc_id, {sql_columns} FROM posts"


def _row_query(name: str, columns, sql_columns: str):
    """Register a projection of the posts; ``columns`` maps the text column to named columns."""

    @query(name, _select(sql_columns))
    def run(spark, sf_dir):
        named = columns(F.col("text"))
        return fx.posts(spark, sf_dir).select("doc_id", *[c.alias(n) for n, c in named.items()])

    return run


_row_query("txt_word_rate", lambda t: {"avg_word_count": F.round(tx.word_rate(t), 6)},
           f"round(len({fx.sql_whitespace_tokens('text')}) / 300.0::DOUBLE, 6) AS avg_word_count")

_row_query("txt_emoji_count", lambda t: {"emoji_count": tx.emoji_count(t)},
           f"{fx.sql_count('text', tx.EMOJI)} AS emoji_count")

SLANG_SQL = (
    f"CAST(len(list_filter({fx.sql_whitespace_tokens('lower(text)')}, "
    f"lambda w: list_contains({fx.sql_list(lex.SEED_SLANG)}, w))) AS BIGINT)"
)
_row_query("txt_slang_count", lambda t: {"slang_count": tx.slang_count(t)}, f"{SLANG_SQL} AS slang_count")

CAPITALIZED_SQL = fx.sql_count(fx.sql_relics_gone("text"), tx.CAPITALIZED)
FULL_CAPITALIZED_SQL = fx.sql_count(fx.sql_relics_gone("text"), tx.FULL_CAPITALIZED)
_row_query("txt_capitalized_count", lambda t: {"capitalized_count": tx.capitalized_count(t)},
           f"{CAPITALIZED_SQL} AS capitalized_count")
_row_query("txt_full_capitalized_count", lambda t: {"full_capitalized_count": tx.full_capitalized_count(t)},
           f"{FULL_CAPITALIZED_SQL} AS full_capitalized_count")

RELICS_SQL = ", ".join(
    f"CAST((length(text) - length(replace(text, {fx.sql_string(relic)}, ''))) / {len(relic)} AS BIGINT) AS {name}"
    for name, relic in zip(["retweets_count", "user_mentions_count", "hashtags_count", "url_count"], lex.RELICS)
)
_row_query("txt_relic_counts", tx.relic_counts, RELICS_SQL)

NEGATION_SQL = f"CAST(list_has_any({fx.sql_whitespace_tokens('text')}, {fx.sql_list(lex.NEGATIONS)}) AS INTEGER)"
_row_query("txt_negation_flag", lambda t: {"negation": tx.negation_flag(tx.whitespace_tokens(t))},
           f"{NEGATION_SQL} AS negation")

_row_query("txt_clean_relics", lambda t: {"cleaned": tx.clean_relics(t)}, f"{fx.sql_relics_gone('text')} AS cleaned")


def _strip_sql(expr: str) -> str:
    return fx.sql_delete(expr, f"^{tx.SPACES}|{tx.SPACES}$")


_spaced = f"regexp_replace({fx.sql_delete('text', tx.DROPPED_MARKS)}, {fx.sql_string(tx.SPACED_MARKS)}, ' ', 'g')"
_row_query("txt_clean_punc", lambda t: {"cleaned": tx.clean_punctuation(t)},
           f"replace({_strip_sql(_spaced)}, chr(10), ' ') AS cleaned")

_row_query("txt_strip_links", lambda t: {"stripped": tx.strip_links(t)}, f"{fx.sql_delete('text', tx.LINK)} AS stripped")

_row_query("txt_remove_punct", lambda t: {"bare": tx.remove_punctuation(t)},
           f"{fx.sql_delete(fx.sql_delete('text', tx.MENTION), tx.PUNCT_CLASS)} AS bare")


def _contractions_sql(expr: str, contractions: dict[str, str]) -> str:
    return fx.sql_replace_matches(expr, tx.contraction_pattern(contractions), fx.sql_map(contractions))


_row_query("txt_expand_contractions", lambda t: {"expanded": tx.expand_contractions(F.lower(t))},
           f"{_contractions_sql('lower(text)', lex.CONTRACTIONS)} AS expanded")


def _ascii_sql(links: bool) -> str:
    expr = fx.sql_delete("text", tx.LINK) if links else "text"
    expr = f"lower({fx.sql_delete(fx.sql_delete(expr, tx.MENTION), tx.PUNCT_CLASS)})"
    for part in lex.CLEAN_SUBSTRINGS:
        expr = f"replace({expr}, {fx.sql_string(part)}, '')"
    return fx.sql_delete(expr, tx.NON_ASCII)


# Each step names its result once; nesting the expressions would repeat them in the SQL text.
CLEAN_STEPS_SQL = f"""WITH {fx.POSTS_SQL},
ascii_text AS (SELECT doc_id, {_ascii_sql(True)} AS a FROM posts),
expanded AS (SELECT doc_id, a, {_contractions_sql('a', lex.CONTRACTIONS)} AS e FROM ascii_text),
tokens AS (SELECT doc_id, {fx.sql_whitespace_tokens('a')} AS raw_tokens,
  list_transform({fx.sql_whitespace_tokens('e')}, lambda w: {fx.sql_delete('w', tx.NON_ALPHA)}) AS tokens FROM expanded)
"""


@query("txt_clean_text", CLEAN_STEPS_SQL + "SELECT doc_id, array_to_string(tokens, ' ') AS cleaned FROM tokens")
def txt_clean_text(spark, sf_dir):
    return fx.posts(spark, sf_dir).select("doc_id", tx.clean_text(F.col("text")).alias("cleaned"))


@query("txt_clean_for_linear",
       CLEAN_STEPS_SQL + "SELECT doc_id, array_to_string(raw_tokens, ' ') AS cleaned FROM tokens")
def txt_clean_for_linear(spark, sf_dir):
    return fx.posts(spark, sf_dir).select("doc_id", tx.clean_text_for_linear(F.col("text")).alias("cleaned"))


_row_query("txt_only_alpha", lambda t: {"letters": F.array_join(tx.only_alpha(tx.whitespace_tokens(t)), "|")},
           f"array_to_string(list_transform({fx.sql_whitespace_tokens('text')}, "
           f"lambda w: {fx.sql_delete('w', tx.NON_ALPHA)}), '|') AS letters")

_PUNCT_SQL = "'!\"#$%&''()*+,-./:;<=>?@[\\]^_`{|}~'"


def _filter_sql() -> str:
    dropped = lex.english_stop_words() + lex.EXTRA_STOP_WORDS + tx.emoticon_list()
    return f"""WITH {fx.POSTS_SQL}
SELECT doc_id, array_to_string(list_filter({fx.sql_whitespace_tokens('lower(text)')}, lambda w:
  (NOT list_contains({fx.sql_list(dropped)}, w) AND NOT contains({_PUNCT_SQL}, w)
   AND NOT regexp_matches(w, {fx.sql_string('^' + tx.SPACES + '$')}) AND length(w) > 2 AND length(w) < 42)
  OR list_contains({fx.sql_list(lex.KEEP_WORDS)}, w)), ' ') AS kept
FROM posts"""


@query("txt_join_tokens",
       f"WITH {fx.POSTS_SQL} SELECT doc_id, array_to_string({fx.sql_whitespace_tokens('text')}, ',') AS joined FROM posts")
def txt_join_tokens(spark, sf_dir):
    return fx.posts(spark, sf_dir).select("doc_id", tx.join_tokens(tx.whitespace_tokens(F.col("text"))).alias("joined"))


def _demoji_sql() -> str:
    expr = "text"
    for row in lex.SEED_EMOJI:
        expr = f"replace({expr}, {fx.sql_string(row[0])}, {fx.sql_string(row[1])})"
    return expr


_row_query("txt_demoji", lambda t: {"described": em.demojize(t), "names": F.array_join(em.emoji_names(t), " ")},
           f"{_demoji_sql()} AS described, array_to_string(list_transform(regexp_extract_all(text, "
           + fx.sql_string("[" + "".join(e[0] for e in lex.gated_emoji(lex.SEED_EMOJI)) + "]")
           + f"), lambda c: ({fx.sql_map({e[0]: e[1] for e in lex.SEED_EMOJI})})[c]), ' ') AS names")


@query("ts_parse_post_time", """
SELECT event_id, strftime(ts, '%Y-%m-%d') AS created_at,
       strftime(CAST(ts AS DATE) + INTERVAL 5 DAY, '%Y-%m-%d') AS created_at_limit
FROM events""")
def ts_parse_post_time(spark, sf_dir):
    stamped = fx.table(spark, sf_dir, "events").select(
        "event_id", F.date_format("ts", "EEE MMM dd HH:mm:ss '+0000' yyyy").alias("created_at"))
    day = tx.post_date(F.col("created_at"))
    return stamped.select(
        "event_id", F.date_format(day, "yyyy-MM-dd").alias("created_at"),
        F.date_format(F.date_add(day, 5), "yyyy-MM-dd").alias("created_at_limit"))


@query("json_field_extract",
       "SELECT event_id, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k FROM events")
def json_field_extract(spark, sf_dir):
    return fx.table(spark, sf_dir, "events").select(
        "event_id", F.from_json("props", "k bigint")["k"].alias("k"))


@query("txt_filter_tokens", _filter_sql())
def txt_filter_tokens(spark, sf_dir):
    tokens = tx.filter_tokens(tx.whitespace_tokens(F.lower(F.col("text"))), lex.english_stop_words())
    return fx.posts(spark, sf_dir).select("doc_id", F.array_join(tokens, " ").alias("kept"))
