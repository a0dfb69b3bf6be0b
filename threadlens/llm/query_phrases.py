"""Query on phrases."""

from __future__ import annotations

from threadlens.llm.count_automata import mine_phrases
from threadlens.llm.registry import query

PHRASE_SQL = r"""
WITH pieces AS (
  SELECT lang, doc, generate_subscripts(p, 1) AS piece, unnest(p) AS part FROM (
    SELECT coalesce(lang, 'und') AS lang, row_number() OVER () AS doc,
           string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                              '[.,;:!?\x0A-\x0D]') AS p FROM documents)
), words AS (
  SELECT lang, doc, piece, generate_subscripts(w, 1) AS i, unnest(w) AS word
  FROM (SELECT lang, doc, piece, regexp_extract_all(part, '[^\x20\x09]+') AS w FROM pieces)
), three AS (
  SELECT lang, word AS w1, lead(word, 1) OVER p AS w2, lead(word, 2) OVER p AS w3 FROM words
  WINDOW p AS (PARTITION BY doc, piece ORDER BY i)
), grams AS (
  SELECT lang, phrase, k, count(*) AS f FROM (
    SELECT lang, w1 AS phrase, 1 AS k FROM three
    UNION ALL SELECT lang, w1 || ' ' || w2, 2 FROM three WHERE w2 IS NOT NULL
    UNION ALL SELECT lang, w1 || ' ' || w2 || ' ' || w3, 3 FROM three WHERE w3 IS NOT NULL) GROUP BY lang, phrase, k
), total AS (SELECT lang, sum(f)::BIGINT AS n FROM grams WHERE k = 1 GROUP BY lang),
cand AS (SELECT lang, phrase, k, f AS a, string_split(phrase, ' ') AS w FROM grams WHERE k > 1 AND f >= 10),
cuts AS (
  SELECT lang, phrase, k, a, 1 AS cut, w[1] AS x, array_to_string(w[2:], ' ') AS y FROM cand
  UNION ALL SELECT lang, phrase, k, a, 2, w[1] || ' ' || w[2], w[3] FROM cand WHERE k = 3
), scored AS (
  SELECT c.lang, c.phrase, c.a, l.f AS l, r.f AS r, cut,
         ((1000000::HUGEINT * c.a * c.a) // (l.f::HUGEINT * r.f))::BIGINT AS score
  FROM cuts c JOIN grams l ON l.lang = c.lang AND l.phrase = c.x JOIN grams r ON r.lang = c.lang AND r.phrase = c.y
), lowest AS (
  SELECT * FROM scored QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, cut) = 1
), inside AS (
  SELECT lang, part, max(a) AS longer FROM (
    SELECT lang, w[1] || ' ' || w[2] AS part, a FROM cand WHERE k = 3
    UNION ALL SELECT lang, w[2] || ' ' || w[3], a FROM cand WHERE k = 3) GROUP BY lang, part
), kept AS (
  SELECT s.lang, s.phrase, s.a, s.l, s.r, s.score FROM lowest s LEFT JOIN inside i ON i.lang = s.lang AND i.part = s.phrase
  WHERE i.longer IS NULL OR 100 * i.longer < 50 * s.a
)
SELECT k.lang, row_number() OVER (PARTITION BY k.lang ORDER BY score DESC, a DESC, phrase) AS rank, phrase, a, l, r, n, score
FROM kept k JOIN total t ON t.lang = k.lang QUALIFY rank <= 2000
"""


@query("op13_phrases", PHRASE_SQL)
def op13_phrases(spark, sf_dir):
    return mine_phrases(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "lang", "text"))
