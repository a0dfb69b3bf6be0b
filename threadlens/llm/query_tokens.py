"""Queries on two tokenizers side by side and on encoding and decoding."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import functions as F

from threadlens.llm.alignment import FIELDS, align_tokenizers
from threadlens.llm.prefix_bpe import decode_ids, encode_texts
from threadlens.llm.registry import query

BYTE_BPE = public_tokenizers.path("byte_bpe_50k.json")
PIECES = public_tokenizers.path("piece_bpe_32k.model")
MULTI = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")


@query("op11_tokenizer_alignment")
def op11_tokenizer_alignment(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    groups = F.col("token_groups")
    return align_tokenizers(docs, BYTE_BPE, PIECES).select(
        "doc_id", *FIELDS, F.when(groups == "", "").otherwise(F.sha2(groups, 256)).alias("groups_sha256"))


@query("op12_byte_bpe")
def op12_byte_bpe(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    coded = encode_texts(docs, MULTI, public_tokenizers.PATTERN).select("doc_id", "token_ids")
    return decode_ids(coded, MULTI, public_tokenizers.PATTERN).select(
        "doc_id", F.size("token_ids").cast("long").alias("n_tokens"),
        F.sha2(F.concat_ws(",", F.col("token_ids").cast("array<string>")), 256).alias("ids_sha256"),
        F.sha2("token_bytes", 256).alias("decoded_sha256"))
