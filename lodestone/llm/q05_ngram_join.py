"""op5: groups of documents whose 3-word shingle sets have a Jaccard similarity of 0.9."""

from __future__ import annotations

from fractions import Fraction

from pyspark.sql import DataFrame, SparkSession

from lodestone.llm import ngramjoin, shared


def op5_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngramjoin.join(shared.table(spark, sf_dir, "documents"), k=3, threshold=Fraction(9, 10))


QUERIES = {"op5_ngram_jaccard_join": op5_ngram_jaccard_join}


#: All pairs that share a shingle, counted; labels spread over links until none is less.
ORACLES = {
    "op5_ngram_jaccard_join": r"""
WITH RECURSIVE words AS (
  SELECT doc_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents
), sets AS (
  SELECT doc_id, CASE WHEN len(w) >= 3 THEN list_distinct([array_to_string(w[i:i + 2], ' ') FOR i IN range(1, len(w) - 1)]) WHEN len(w) > 0 THEN [array_to_string(w, ' ')] ELSE [] END AS s FROM words
), shingles AS (
  SELECT doc_id, len(s) AS n, md5_number_lower(unnest(s)) AS h FROM sets
), links AS (
  SELECT a.doc_id AS a, b.doc_id AS b FROM shingles a JOIN shingles b ON a.h = b.h AND a.doc_id < b.doc_id
  GROUP BY a.doc_id, b.doc_id, a.n, b.n HAVING 100 * count(*) >= 90 * (a.n + b.n - count(*))
), ways AS (
  SELECT a, b FROM links UNION ALL SELECT b, a FROM links
), reach AS (
  SELECT a AS doc_id, a AS label FROM ways UNION SELECT ways.b, least(reach.label, ways.b) FROM reach JOIN ways ON ways.a = reach.doc_id
), least_ AS (
  SELECT doc_id, min(label) AS component_id FROM reach GROUP BY doc_id
)
SELECT doc_id, len(s)::BIGINT AS n_shingles, coalesce(component_id, doc_id) AS component_id FROM sets LEFT JOIN least_ USING (doc_id)
"""
}
