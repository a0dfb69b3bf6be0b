"""Readers. Every input has a declared schema; nothing is inferred."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from threadlens import schemas


def spread(df: DataFrame) -> DataFrame:
    """Repartition an input whose files give fewer tasks than there are cores.

    Text work is bound by the processor, and one small file is one task. Inputs with enough splits,
    which is every large one, are returned as they are and pay no shuffle.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if df.rdd.getNumPartitions() < cores else df


def read_author_xml(spark: SparkSession, path: str, user: Column | None = None) -> DataFrame:
    """(user_id, post_pos, text): one row per document element of each author element.

    The user is the author element's ``id``, or the file's stem where there is none, unless another expression over
    ``_metadata`` or the partition columns is given.
    """
    authors = (
        spark.read.format("xml").option("rowTag", "author").option("ignoreSurroundingSpaces", "false")
        .schema(schemas.AUTHOR_XML).load(path)
    )
    stem = F.substring_index(F.col("_metadata.file_name"), ".", 1)
    return authors.select(
        (F.coalesce("_id", stem) if user is None else user).alias("user_id"), F.posexplode("documents.document").alias("post_pos", "text")
    )


def read_truth_labels(spark: SparkSession, path: str) -> DataFrame:
    """(user_id, ground_truth) from ``user:::label`` lines; the label is the first character."""
    lines = spark.read.schema(schemas.TRUTH).option("sep", ":::").csv(path)
    return lines.select("user_id", F.substring("label_text", 1, 1).cast("int").alias("ground_truth"))


def read_header_csv(spark: SparkSession, path: str, schema: T.StructType | str) -> DataFrame:
    """CSV with a header; quoted text may hold line breaks and doubled quotes."""
    return (
        spark.read.schema(schema).option("header", "true").option("multiLine", "true")
        .option("quote", '"').option("escape", '"').csv(path)
    )


def read_trait_tsv(spark: SparkSession, path: str, schema: T.StructType = schemas.TRAITS) -> DataFrame:
    return spark.read.schema(schema).option("sep", "\t").option("header", "true").csv(path)


def flatten_threads(documents: DataFrame) -> DataFrame:
    """Long form of nested threads: position 0 is the root, its replies follow in order."""
    threads = documents.select(F.explode("results").alias("t")).select("t.*")
    root = F.struct("tweet_id", "user_id", "tweet_text", "text")
    return (
        threads.select(
            F.col("tweet_id").alias("thread_id"),
            F.posexplode(F.concat(F.array(root), F.coalesce("replies", F.array().cast(
                T.ArrayType(schemas.REPLY))))).alias("pos", "p"))
        .select("thread_id", "pos", "p.*", (F.col("pos") == 0).alias("is_root"))
    )


def read_threads(spark: SparkSession, path: str, multi_line: bool = False) -> DataFrame:
    """Threads from ``{results: [...]}`` documents, one per line, or one pretty-printed document per file."""
    raw = spark.read.schema(schemas.THREADS).option("multiLine", str(multi_line).lower()).json(path)
    return flatten_threads(raw)


def read_reply_map(spark: SparkSession, path: str) -> DataFrame:
    """(root_id, reply_id) from lines that hold one JSON object root -> [replies]."""
    lines = spark.read.text(path)
    parsed = lines.select(F.from_json("value", schemas.REPLY_MAP).alias("m"))
    return parsed.select(F.explode("m").alias("root_id", "ids")).select("root_id", F.explode("ids").alias("reply_id"))


def read_slang(spark: SparkSession, path: str) -> DataFrame:
    """First ``:`` field of each line, lower-cased and not stripped."""
    lines = spark.read.schema("slang string, definition string").option("sep", ":").csv(path)
    return lines.select(F.lower("slang").alias("slang"))


def read_emoji_lexicon(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(schemas.EMOJI_LEXICON).option("header", "true").option("sep", "\t").csv(path)


def read_statuses(spark: SparkSession, path: str) -> DataFrame:
    """Raw statuses, reduced to the nested fields the collection step needs."""
    raw = spark.read.schema(schemas.RAW_STATUS).parquet(path)
    return project_status(raw)


def project_status(raw: DataFrame) -> DataFrame:
    return raw.select(
        "id", "created_at", F.col("user.screen_name").alias("screen_name"), F.col("user.id").alias("user_id"),
        F.col("user.followers_count").alias("followers_count"),
    )
