"""Feature groups of the behavioural matrix."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.ml.feature import CountVectorizerModel, ElementwiseProduct, Normalizer
from pyspark.ml.linalg import Vectors
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from threadlens import lexicons as lex
from threadlens.functions import text as tx
from threadlens.functions.emoji import emotion_means
from threadlens.functions.vectors import sparse_entries
from threadlens.operators import term_counts as tc
from threadlens.session import materialize, ship_package


#: Words of a score table that every task holds, and texts that are scored at once.
LEXICON_WORDS, SCORED_ROWS = 100_000, 256
#: Hash slots of the filter that keeps rare words out of n-grams.
SLOTS = 1 << 16
#: Hash slots of the n-gram sketch. A text adds a few hundred n-grams and a slot passes at 1 % of the texts, so some ten
#: thousand slots would be full on average, whatever the number of texts; these are several times as many.
SKETCH_SLOTS = 1 << 18


def readability_columns(text: Column, slang: list[str] = lex.SEED_SLANG) -> dict[str, Column]:
    return {
        "avg_word_count": tx.word_rate(text),
        "emoji_count": tx.emoji_count(text),
        "slang_count": tx.slang_count(text, slang),
        "capitalized_count": tx.capitalized_count(text),
        "full_capitalized_count": tx.full_capitalized_count(text),
        **tx.relic_counts(text),
    }


def readability(df: DataFrame, key: list[str], text: str, slang: list[str] = lex.SEED_SLANG) -> DataFrame:
    """Nine counts per row in one projection; no shuffle."""
    return df.select(*key, *[c.alias(n) for n, c in readability_columns(F.col(text), slang).items()])


def word_scores(df: DataFrame, key: str, text: str, lexicon: DataFrame, damping: float = -0.74,
                alpha: float = 15.0, reach: int = 3, max_words: int = LEXICON_WORDS) -> DataFrame:
    """Valence compound and mean polarity per key from a table (word, valence, polarity).

    A valence is multiplied by ``damping`` when one of the ``reach`` tokens before it negates. Each
    text's tokens are summed in the task that read it; the shuffle carries about one row per text.
    A lexicon of at most ``max_words`` words goes to all tasks, a longer one is joined with the tokens.
    """
    tokens = df.select(key, tx.word_tokens(F.col(text)).alias("_tokens"))
    words = lexicon.where(F.col("word").isNotNull()).groupBy("word").agg(
        *[f(F.col(c).cast("double")).cast("double") for c in ("valence", "polarity") for f in (F.sum, F.count)])
    known = words.limit(max_words + 1).collect()
    found = (_joined_sums(tokens, key, lexicon, damping, reach) if len(known) > max_words
             else _token_sums(tokens, key, known, damping, reach))
    sums = found.groupBy(key).agg(*[F.sum(c).alias(c) for c in ("_s", "_p", "_np", "scored_words")])
    s = F.col("_s")
    return sums.select(
        key, F.greatest(F.least(s / F.sqrt(s * s + alpha), F.lit(1.0)), F.lit(-1.0)).alias("vader_compound_score"),
        F.when(F.col("_np") > 0, F.col("_p") / F.col("_np")).otherwise(F.lit(0.0)).alias("textblob_polarity_score"),
        "scored_words",
    )


def _joined_sums(tokens: DataFrame, key: str, lexicon: DataFrame, damping: float, reach: int) -> DataFrame:
    flags = tokens.withColumn("_neg", F.transform("_tokens", lambda t: t.isin(lex.NEGATIONS)))

    def entry(t: Column, i: Column) -> Column:
        before = [F.coalesce(F.get("_neg", i - d), F.lit(False)) for d in range(1, reach + 1)]
        return F.struct(t.alias("word"), reduce(lambda a, b: a | b, before).alias("negated"))

    found = (
        flags.select(key, F.inline_outer(F.transform("_tokens", entry)))
        .join(lexicon, "word", "left")
    )
    return found.groupBy(key).agg(
        F.coalesce(F.sum(F.col("valence") * F.when(F.col("negated"), damping).otherwise(1.0)), F.lit(0.0)).alias("_s"),
        F.coalesce(F.sum("polarity"), F.lit(0.0)).alias("_p"), F.count("polarity").alias("_np"),
        F.count("valence").alias("scored_words"),
    )


def _token_sums(tokens: DataFrame, key: str, known: list, damping: float, reach: int) -> DataFrame:
    """The sums of each row's tokens; tokens are numbered by Arrow's dictionary encoding and looked up once per block."""
    names = [r[0] for r in known]
    numbers = np.array([[x or 0.0 for x in r[1:]] for r in known], float).reshape(-1, 4)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start in range(0, batch.num_rows, SCORED_ROWS):
                part = batch.slice(start, SCORED_ROWS)
                n = part.num_rows
                lists = part.column(1)
                text = np.repeat(np.arange(n), pc.fill_null(pc.list_value_length(lists), 0).to_numpy(zero_copy_only=False))
                flat = lists.flatten().dictionary_encode()
                code = flat.indices.to_numpy(zero_copy_only=False)
                look = lambda values: pc.fill_null(pc.index_in(flat.dictionary, pa.array(values, flat.dictionary.type)), -1).to_numpy(  # noqa: E731, B023
                    zero_copy_only=False)
                negates = (look(lex.NEGATIONS) >= 0)[code]
                place = look(names)[code]
                at = np.flatnonzero(place >= 0)
                negated = np.zeros(len(at), bool)
                for d in range(1, reach + 1):
                    before = np.maximum(at - d, 0)
                    negated |= (at >= d) & negates[before] & (text[before] == text[at])
                own, found = text[at], numbers[place[at]]
                valence = found[:, 0] * np.where(negated, damping, 1.0)
                columns = [np.bincount(own, w, n) for w in (valence, found[:, 2], found[:, 3], found[:, 1])]
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), *[pa.array(c.astype(t)) for c, t in zip(columns, (float, float, np.int64, np.int64), strict=True)]],
                    names=[key, "_s", "_p", "_np", "scored_words"])

    schema = T.StructType([tokens.schema[key], *[
        T.StructField(c, t) for c, t in (("_s", T.DoubleType()), ("_p", T.DoubleType()), ("_np", T.LongType()),
                                         ("scored_words", T.LongType()))]])
    ship_package(tokens.sparkSession)
    return tokens.mapInArrow(run, schema)


def emotion_columns(text: Column, entries=lex.SEED_EMOJI) -> dict[str, Column]:
    return {**emotion_means(text, entries), "negation": tx.has_negation(text)}


def sentiment(df: DataFrame, key: str, text: str, lexicon: DataFrame, entries=lex.SEED_EMOJI) -> DataFrame:
    """Emotions, negation, compound and polarity per key."""
    inline = df.select(key, *[c.alias(n) for n, c in emotion_columns(F.col(text), entries).items()])
    return inline.join(word_scores(df, key, text, lexicon).drop("scored_words"), key)


# ---- TF-IDF ---------------------------------------------------------------------------------


def with_grams(df: DataFrame, text: str, low: int, high: int, stop_words: list[str] | None, out: str = "_grams",
               words: list[str] | None = None):
    """Adds the n-grams of a text column; tokens get a projection of their own so they are cut once. With ``words``, only
    n-grams of these words."""
    tokens = df.withColumn("_tokens", tx.word_tokens(F.col(text), stop_words))
    if words is not None:
        tokens = tokens.withColumn("_tokens", F.transform("_tokens", lambda t: F.when(t.isin(words), t)))
    return tokens.withColumn(out, tx.ngrams(F.col("_tokens"), low, high)).drop("_tokens")


def frequent_slots(tokens: DataFrame, min_count: Column, slots: int = SLOTS) -> Column:
    """Array of booleans over hash slots, true where a token of at least ``min_count`` texts falls; one row.

    Its size is fixed. A slot that an infrequent token shares lets that token pass, so the array may only be used to
    leave work out, never to decide.
    """
    frequent = (
        tokens.select(F.explode(F.array_distinct("_tokens")).alias("t")).groupBy("t").agg(F.count("*").alias("df"))
        .where(F.col("df") >= min_count).select(slot_of(F.col("t"), slots).alias("slot")).distinct()
    )
    every = tokens.sparkSession.range(slots).select(F.col("id").cast("int").alias("slot"))
    hit = every.join(frequent.withColumn("_hit", F.lit(True)), "slot", "left").select(
        "slot", F.coalesce("_hit", F.lit(False)).alias("hit"))
    return hit.agg(F.transform(F.array_sort(F.collect_list(F.struct("slot", "hit"))), lambda s: s["hit"])).scalar()


def slot_of(token: Column, slots: int = SLOTS) -> Column:
    return F.pmod(F.xxhash64(token), F.lit(slots)).cast("int")


def vocabulary(df: DataFrame, text: str, low: int = 1, high: int = 3, stop_words: list[str] | None = None,
               min_df: float = 0.01, max_df: float = 0.90, k: int = 1000, sketch_slots: int = SKETCH_SLOTS) -> DataFrame:
    """The k terms with the largest corpus frequency among those inside the document-frequency range.

    An n-gram is in no more texts than each of its words, so only n-grams of words that reach the lower bound are made. A
    first pass sketches in how many texts n-grams are, a second one counts those whose slot reaches the bound
    (``sketch_slots`` = 0 leaves the sketch out; the result is the same). Texts are cut into tokens once. The words that
    reach the bound, at most 1 / min_df times the different words of an average text, come to the driver.
    """
    tokens = df.select(tx.word_tokens(F.col(text), stop_words).alias("_tokens"))
    if high > 1 and min_df > 0:
        tokens = materialize(tokens, "tokens")
        n_docs = F.lit(tokens.count()).cast("long")
        words = materialize(tc.word_counts(tokens), "word-counts")
        frequent = [r["term"] for r in words.where(F.col("df") >= n_docs * min_df).select("term").orderBy("term").collect()]
        least = tokens.sparkSession.range(1).select(n_docs * min_df).first()[0]
        counted = words if low <= 1 else words.limit(0)
        if frequent:
            counted = counted.unionByName(
                tc.gram_counts(tokens, frequent, list(range(max(low, 2), high + 1)), least, sketch_slots))
    else:
        n_docs = df.agg(F.count("*").alias("n")).scalar()
        counted = tokens.select(tx.ngrams(F.col("_tokens"), low, high).alias("_grams")).select(F.inline(F.concat(
            F.transform("_grams", lambda g: F.struct(g.alias("term"), F.lit(1).alias("tf"), F.lit(0).alias("df"))),
            F.transform(F.array_distinct("_grams"),
                        lambda g: F.struct(g.alias("term"), F.lit(0).alias("tf"), F.lit(1).alias("df"))),
        ))).groupBy("term").agg(F.sum("tf").alias("tf"), F.sum("df").alias("df"))
    return (
        counted.withColumn("n_docs", n_docs)
        .where((F.col("df") >= F.col("n_docs") * min_df) & (F.col("df") <= F.col("n_docs") * max_df))
        .orderBy(F.desc("tf"), "term").limit(k)
    )


@dataclass(frozen=True)
class TfIdf:
    """A fitted vocabulary with its inverse document frequencies; at most max_features entries."""

    terms: list[str]
    idf: list[float]
    low: int
    high: int
    stop_words: list[str]

    def counts(self, df: DataFrame, text: str, out: str) -> DataFrame:
        """Raw term counts as a sparse vector, counted inside the row; words of no term are blanked before n-grams are built."""
        counter = CountVectorizerModel.from_vocabulary(self.terms, "_grams", out)
        words = sorted({w for t in self.terms for w in t.split(" ")})
        return counter.transform(with_grams(df, text, self.low, self.high, self.stop_words, words=words)).drop("_grams")

    def transform(self, df: DataFrame, text: str, out: str = "tfidf") -> DataFrame:
        """L2-normalised tf-idf as a sparse vector; unknown terms are dropped. No join, no shuffle."""
        counted = self.counts(df, text, "_tf")
        weighted = ElementwiseProduct(
            scalingVec=Vectors.dense(self.idf), inputCol="_tf", outputCol="_tfidf"
        ).transform(counted)
        return Normalizer(p=2.0, inputCol="_tfidf", outputCol=out).transform(weighted).drop("_tf", "_tfidf")

    def long_form(self, df: DataFrame, vector: str, keys: list[str], value: str = "weight") -> DataFrame:
        """(keys, term, weight) for the stored entries of the vectors."""
        names = F.array(*[F.lit(t) for t in self.terms])
        entries = df.select(*keys, F.explode(sparse_entries(F.col(vector))).alias("_e"))
        return entries.select(*keys, F.get(names, F.col("_e.index")).alias("term"), F.col("_e.value").alias(value))

    def as_table(self, spark) -> DataFrame:
        return spark.createDataFrame(
            [(i, t, float(w)) for i, (t, w) in enumerate(zip(self.terms, self.idf))],
            "position int, term string, idf double",
        )


def fit_tfidf(df: DataFrame, text: str, low: int = 1, high: int = 3, stop_words: list[str] | None = None,
              min_df: float = 0.01, max_df: float = 0.90, max_features: int = 1000) -> TfIdf:
    """Fit on a text column. Only the chosen vocabulary, max_features rows, reaches the driver."""
    stop_words = stop_words or []
    chosen = vocabulary(df, text, low, high, stop_words, min_df, max_df, max_features)
    idf = F.log((F.col("n_docs") + 1) / (F.col("df") + 1)) + 1
    rows = chosen.select("term", idf.alias("idf")).orderBy("term").collect()
    if not rows:
        raise ValueError("no term lies inside the document-frequency range")
    return TfIdf([r["term"] for r in rows], [r["idf"] for r in rows], low, high, stop_words)


# ---- scaling and binning --------------------------------------------------------------------


def scale_with(df: DataFrame, ranges: Column, columns: list[str]) -> DataFrame:
    """(x - min) / (max - min); a constant column becomes 0, null stays null."""

    def scaled(name: str) -> Column:
        low, high, x = ranges[f"min_{name}"], ranges[f"max_{name}"], F.col(name)
        return F.when(x.isNull(), None).when(high > low, (x - low) / (high - low)).otherwise(F.lit(0.0)).alias(name)

    return df.select(*[c for c in df.columns if c not in columns], *[scaled(c) for c in columns])


def range_table(df: DataFrame, columns: list[str]) -> DataFrame:
    """One row with a struct of min_<c>, max_<c>; store it to apply the same scaling later."""
    return df.agg(F.struct(*[
        f(F.col(c)).cast("double").alias(f"{f.__name__}_{c}") for c in columns for f in (F.min, F.max)
    ]).alias("ranges"))


def min_max_scale(df: DataFrame, columns: list[str]) -> DataFrame:
    """Two passes over the input and no join: the ranges are a scalar subquery."""
    tagged = df.withColumn("_ranges", range_table(df, columns).scalar())
    return scale_with(tagged, F.col("_ranges"), columns).drop("_ranges")


def equal_width_bins(df: DataFrame, columns: list[str], bins: int = 3) -> DataFrame:
    """Right-closed bins of equal width, numbered from 0; the minimum belongs to the first."""
    tagged = df.withColumn("_ranges", range_table(df, columns).scalar())
    ranges = F.col("_ranges")

    def binned(name: str) -> Column:
        low, high, x = ranges[f"min_{name}"], ranges[f"max_{name}"], F.col(name)
        width = (high - low) / bins
        result = F.when(x.isNull(), None)
        for i in range(bins - 1):
            result = result.when(x <= low + width * (i + 1), F.lit(i))
        # equal minimum and maximum: the edges widen to both sides, the value lies in the middle
        return F.when(x.isNotNull() & (high == low), F.lit((bins - 1) // 2)).otherwise(
            result.otherwise(F.lit(bins - 1))).alias(name)

    return tagged.select(*[c for c in df.columns if c not in columns], *[binned(c) for c in columns])
