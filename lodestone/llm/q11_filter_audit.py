"""op11: five filters in every order, by language."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestone.llm import filteraudit, shared

LETTERS = "ABCDE"


def op11_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    text, words = F.col("_text"), F.col("_words")
    conditions = {
        "A": filteraudit.few_words(words, 100),
        "B": filteraudit.repetitive(words, 80),
        "C": filteraudit.class_share_above(text, "[A-Z]", 10),
        "D": filteraudit.holds(text, "[#$%&*|]"),
    }
    counted = filteraudit.masks(shared.table(spark, sf_dir, "documents"), shared.table(spark, sf_dir, "labels"), conditions, copy="E")
    return filteraudit.audit(counted, LETTERS)


QUERIES = {"op11_filter_audit": op11_filter_audit}

#: Documents are counted step by step in each order; no polynomial.
ORACLES = {
    "op11_filter_audit": r"""
WITH marks AS (
  SELECT doc_id, max((quality = 1)::INT) AS good, max((toxic = 1)::INT) AS toxic FROM labels GROUP BY doc_id
), read AS (
  SELECT doc_id, coalesce(lang, '') AS part, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents
), judged AS (
  SELECT part, coalesce(good, 0) AS good, coalesce(toxic, 0) AS toxic,
         CASE WHEN len(w) < 100 THEN 'A' ELSE '' END || CASE WHEN 100 * len(list_distinct(w)) < 80 * len(w) THEN 'B' ELSE '' END
         || CASE WHEN 100 * length(regexp_replace(t, '[^A-Z]', '', 'g')) > 10 * length(t) THEN 'C' ELSE '' END
         || CASE WHEN regexp_matches(t, '[#$%&*|]') THEN 'D' ELSE '' END
         || CASE WHEN doc_id > min(doc_id) OVER (PARTITION BY t) THEN 'E' ELSE '' END AS fails
  FROM read LEFT JOIN marks USING (doc_id)
), counted AS (
  SELECT part, fails, count(*) AS n, sum(good) AS good, sum(toxic) AS toxic FROM judged GROUP BY part, fails
), letters AS (
  SELECT unnest(['A', 'B', 'C', 'D', 'E']) AS l
), orders AS (
  SELECT a.l || b.l || c.l || d.l || e.l AS filter_order FROM letters a, letters b, letters c, letters d, letters e
  WHERE len(list_distinct([a.l, b.l, c.l, d.l, e.l])) = 5
), steps AS (
  SELECT filter_order, s AS step, filter_order[s:s] AS l, filter_order[1:s - 1] AS earlier, filter_order[1:s] AS upto FROM orders, range(1, 6) t(s)
), met AS (
  SELECT part, filter_order, step, l, n, good, toxic, contains(fails, l) AS fails_it,
         len(list_filter(string_split(earlier, ''), lambda x: x <> '' AND contains(fails, x))) > 0 AS gone,
         len(list_filter(string_split(upto, ''), lambda x: contains(fails, x))) = 0 AS stays, fails = l AS alone
  FROM steps, counted
), summed AS (
  SELECT part, filter_order, step, l, sum(CASE WHEN stays THEN n ELSE 0 END) AS kept, sum(CASE WHEN fails_it AND NOT gone THEN n ELSE 0 END) AS removed,
         sum(CASE WHEN fails_it AND gone THEN n ELSE 0 END) AS redundant, sum(CASE WHEN alone THEN n ELSE 0 END) AS unique_fails,
         sum(CASE WHEN fails_it AND NOT gone THEN good ELSE 0 END) AS good_lost, sum(CASE WHEN fails_it AND NOT gone THEN toxic ELSE 0 END) AS toxic_lost
  FROM met GROUP BY ALL
)
SELECT part, filter_order, step::INTEGER AS step, kept::BIGINT AS kept, removed::BIGINT AS removed, redundant::BIGINT AS redundant, unique_fails::BIGINT AS unique_fails,
       good_lost::BIGINT AS good_lost, toxic_lost::BIGINT AS toxic_lost, (sum(removed) OVER (PARTITION BY part, l))::BIGINT AS shapley
FROM summed
"""
}
