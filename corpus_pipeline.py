"""Corpus pipeline: documents to packed training sequences, in stages that are each written and read again."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from threadlens.llm.bag_minhash import near_duplicates
from threadlens.llm.common import crc_fold, fresh, materialize, ship_package
from threadlens.llm.decontaminate import find_items
from threadlens.llm.language_id import UNKNOWN, fit_language_model, identify
from threadlens.llm.line_dedup import dedup_lines
from threadlens.llm.packing import pack

TOKENIZER = public_tokenizers.path("byte_bpe_50k.json")
#: A language is rejected if its share is below this many times that of an even choice between the model's languages.
LEAST_LANGUAGE_SHARE = 1.2


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a letter, or without any likely language, go. The columns stay as they are."""
    ship_package(spark)
    model = fit_language_model(docs, crc_fold(F.col("doc_id"), 4) != 2)
    lang, score = fresh(docs, "lang_pred"), fresh(docs, "score")
    told = identify(docs, model)
    least = LEAST_LANGUAGE_SHARE / max(2, len(model.languages) if model else 0)
    return told.where((F.col(lang) != UNKNOWN) & (F.col(score) >= least)).select(*docs.columns)


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Lines of at least 40 characters found in five documents or more stay in one of them. text and n_chars are those
    of the lines that stay; no document goes; a null text stays null."""
    ship_package(spark)
    kept, dropped = fresh(docs, "kept_text"), fresh(docs, "n_dropped")
    done = dedup_lines(docs, min_chars=40, min_docs=5)
    changed = F.col(dropped) > 0
    new = {"text": F.when(changed, F.col(kept)).otherwise(F.col("text"))}
    if "n_chars" in docs.columns:
        new["n_chars"] = F.when(changed, F.length(kept).cast(docs.schema["n_chars"].dataType)).otherwise(F.col("n_chars"))
    return done.withColumns(new).select(*docs.columns)


def minhash_near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of every class of near-duplicates the document with the smallest id stays. Rows with a null id stay."""
    ship_package(spark)
    lost = fresh(docs, "lost")
    gone = near_duplicates(docs).where("doc <> class_id").select(F.col("doc").alias(lost))
    return docs.join(gone, F.col("doc_id").cast("long") == F.col(lost), "left_anti")


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a benchmark item, whole and within its edit budget, go."""
    ship_package(spark)
    matches = fresh(docs, "matches")
    found = find_items(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
    return found.where(F.size(matches) == 0).select(*docs.columns)


def best_fit_packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all documents with their places in sequences of 2048 tokens."""
    ship_package(spark)
    return pack(docs, TOKENIZER)


STAGES = [("language ID", language_id), ("line dedup", line_dedup), ("MinHash near-dedup", minhash_near_dedup),
          ("benchmark decontamination", decontaminate), ("best-fit packing", best_fit_packing)]

#: No SQL: the language model, signatures and packing are beyond it; tests/llm compare the stages with plain versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages on the documents of sf_dir; what each stage returns is written and reread by the next one."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = materialize(stage(spark, docs, sf_dir), "stage-" + name.replace(" ", "-"))
    return STAGES[-1][1](spark, docs, sf_dir)
