"""Queries on near-duplicates."""

from __future__ import annotations

from pyspark.sql import functions as F

from threadlens.llm.bag_minhash import near_duplicates
from threadlens.llm.cross_polytope import near_vectors
from threadlens.llm.registry import query

VECTOR_SQL = """
WITH RECURSIVE good AS (
  SELECT vec_id, label, embedding::DOUBLE[] AS v FROM embeddings
  WHERE label IS NOT NULL AND embedding IS NOT NULL AND len(embedding) > 0
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
    AND len(list_filter(embedding, lambda x: x <> 0)) > 0
), links AS (
  SELECT a.vec_id AS a, b.vec_id AS b FROM good a JOIN good b ON a.label = b.label AND a.vec_id <> b.vec_id
    AND len(a.v) = len(b.v) AND list_cosine_similarity(a.v, b.v) >= 0.93
), reach AS (
  SELECT vec_id AS a, vec_id AS b FROM embeddings UNION SELECT r.a, l.b FROM reach r JOIN links l ON r.b = l.a
), low AS (SELECT a, min(b) AS c FROM reach GROUP BY a),
n AS (SELECT a, count(*) AS n FROM links GROUP BY a)
SELECT e.vec_id, coalesce(n.n, 0)::BIGINT AS n_links, low.c AS component_id, e.vec_id = low.c AS kept
FROM embeddings e JOIN low ON e.vec_id = low.a LEFT JOIN n ON n.a = e.vec_id
"""


@query("op3_minhash_near_dedup")
def op3_minhash_near_dedup(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return near_duplicates(docs).select(
        F.col("doc").alias("doc_id"), "class_id", (F.col("doc") == F.col("class_id")).alias("kept"))


@query("op5_embedding_near_dedup", VECTOR_SQL)
def op5_embedding_near_dedup(spark, sf_dir):
    vectors = spark.read.parquet(f"{sf_dir}/embeddings.parquet").select("vec_id", "embedding", "label")
    return near_vectors(vectors, cosine=0.93).select(
        "vec_id", "n_links", "component_id", (F.col("vec_id") == F.col("component_id")).alias("kept"))
