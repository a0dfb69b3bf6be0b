"""Emoji names and emotions. The lexicon is a small list of rows (emoji, name, anger, fear, joy, sadness)."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from threadlens import lexicons as lex
from threadlens.functions.text import replace_matches, string_map

EMOTIONS = ["anger", "fear", "joy", "sadness"]


def _char_class(entries) -> str:
    return "[" + "".join(re.escape(e[0]) for e in entries) + "]"


def demojize(text: Column, entries=lex.SEED_EMOJI) -> Column:
    """Each known emoji character becomes its :name:."""
    return replace_matches(text, _char_class(entries), string_map({e[0]: e[1] for e in entries}))


def emoji_names(text: Column, entries=lex.SEED_EMOJI, name_gate: bool = True) -> Column:
    """Names of the known emoji characters in order, only readable names by default."""
    kept = lex.gated_emoji(entries, name_gate)
    names = string_map({e[0]: e[1] for e in kept})
    return F.transform(
        F.regexp_extract_all(text, F.lit(_char_class(kept)), F.lit(0)), lambda c: F.element_at(names, c)
    )


def emotion_means(text: Column, entries=lex.SEED_EMOJI, name_gate: bool = True) -> dict[str, Column]:
    """Mean of each emotion over the matched emoji; 0 when none matches. No shuffle, no join."""
    kept = lex.gated_emoji(entries, name_gate)
    found = F.regexp_extract_all(text, F.lit(_char_class(kept)), F.lit(0))

    values = F.map_from_arrays(
        F.array(*[F.lit(e[0]) for e in kept]),
        F.array(*[F.struct(*[F.lit(float(v)).alias(n) for n, v in zip(EMOTIONS, e[2:6])]) for e in kept]))
    scores = F.transform(found, lambda c: F.element_at(values, c))
    total = F.aggregate(scores, F.struct(*[F.lit(0.0).alias(n) for n in EMOTIONS]),
                        lambda acc, s: F.struct(*[(acc[n] + s[n]).alias(n) for n in EMOTIONS]))
    mean = F.when(F.size(found) > 0, total)
    return {n: F.coalesce(mean[n] / F.size(found), F.lit(0.0)) for n in EMOTIONS}


def emotion_means_by(df: DataFrame, key: str, text: str, lexicon: DataFrame) -> DataFrame:
    """The same means from a table (emoji, name, anger, fear, joy, sadness) of any length, one row per key.

    Emoji are counted per key before they meet the table; names are taken as they are. Keys without a known emoji get 0.
    """
    marks = df.select(key, F.explode(F.regexp_extract_all(text, F.lit(r"([^\x00-\x7F])"))).alias("emoji"))
    counts = marks.groupBy(key, "emoji").agg(F.count("*").alias("_n"))
    sums = counts.join(lexicon.select("emoji", *EMOTIONS).dropDuplicates(["emoji"]), "emoji").groupBy(key).agg(
        *[(F.sum(F.col(n) * F.col("_n")) / F.sum("_n")).alias(n) for n in EMOTIONS])
    return df.select(key).distinct().join(sums, key, "left").select(
        key, *[F.coalesce(n, F.lit(0.0)).alias(n) for n in EMOTIONS])
