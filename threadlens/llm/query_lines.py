"""Queries on repeated lines and on packing."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import functions as F

from threadlens.llm.line_dedup import dedup_lines
from threadlens.llm.packing import pack
from threadlens.llm.registry import query

TOKENIZER = public_tokenizers.path("byte_bpe_50k.json")

LINE_SQL = r"""
WITH lines AS (
  SELECT doc_id, i, line, lower_key AS k FROM (
    SELECT doc_id, generate_subscripts(parts, 1) AS i, unnest(parts) AS line,
           unnest(list_transform(parts, lambda x: translate(regexp_replace(x, '^[\x20\x09-\x0D]+|[\x20\x09-\x0D]+$', '', 'g'),
             'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'))) AS lower_key
    FROM (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS parts FROM documents))
), hot AS (
  SELECT k, max(doc_id) AS last FROM lines WHERE length(k) >= 40 GROUP BY k HAVING count(DISTINCT doc_id) >= 5
), marked AS (
  SELECT l.doc_id, l.i, l.line, (h.k IS NOT NULL AND l.doc_id <> h.last) AS gone FROM lines l LEFT JOIN hot h ON l.k = h.k
)
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (gone) AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY i) FILTER (NOT gone), '')) AS kept_sha256
FROM marked GROUP BY doc_id
"""


@query("op4_line_dedup", LINE_SQL)
def op4_line_dedup(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return dedup_lines(docs, min_chars=40, min_docs=5).select(
        "doc_id", "n_lines", "n_dropped", F.sha2("kept_text", 256).alias("kept_sha256"))


@query("op10_best_fit_packing")
def op10_best_fit_packing(spark, sf_dir):
    return pack(spark.read.parquet(f"{sf_dir}/documents.parquet"), TOKENIZER)
