"""op13: every document as a fill-in-the-middle example by lines."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestone.llm import fillmiddle, shared


def _sha(text):
    return F.sha2(text.cast("binary"), 256)


def op13_fill_in_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = shared.table(spark, sf_dir, "documents").select("doc_id", "text")
    made = fillmiddle.transform(docs, "doc_id", "text", fillmiddle.LINES, seed=7, fim_percent=100, spm_percent=50)
    output, form = F.col("fim.output"), F.col("fim.form")
    return made.select(
        "doc_id",
        F.col("fim.n").alias("n"),
        form.alias("form"),
        F.length("fim.prefix").cast("long").alias("prefix_chars"),
        F.length("fim.middle").cast("long").alias("middle_chars"),
        _sha(output).alias("output_sha256"),
        _sha(fillmiddle.restored(output, form)).alias("restored_sha256"),
    )


QUERIES = {"op13_fill_in_middle": op13_fill_in_middle}


def _group(i: int) -> str:
    return f"('0x' || substr(sha256('7:' || coalesce(doc_id::VARCHAR, '')), {8 * i + 1}, 8))::BIGINT"


#: Units by matching, where the operator splits between them.
ORACLES = {
    "op13_fill_in_middle": f"""
WITH cut AS (
  SELECT doc_id, coalesce(text, '') AS whole, regexp_extract_all(coalesce(text, ''), '[^\\n]*\\n|[^\\n]+') AS units,
         {_group(0)} AS h1, {_group(1)} AS h2, {_group(2)} AS h3, {_group(3)} AS h4
  FROM documents
), placed AS (
  SELECT *, len(units)::BIGINT AS n, least(h1 % (len(units) + 1), h2 % (len(units) + 1)) AS a, greatest(h1 % (len(units) + 1), h2 % (len(units) + 1)) AS b,
         CASE WHEN whole = '' OR contains(whole, '<P>') OR contains(whole, '<S>') OR contains(whole, '<M>') OR h3 % 100 >= 100 THEN 'plain' WHEN h4 % 100 < 50 THEN 'spm' ELSE 'psm' END AS form
  FROM cut
), parted AS (
  SELECT *, array_to_string(units[1:a], '') AS prefix, array_to_string(units[a + 1:b], '') AS middle, array_to_string(units[b + 1:n], '') AS suffix
  FROM placed
)
SELECT doc_id, n, form, CASE WHEN form <> 'plain' THEN length(prefix) END AS prefix_chars, CASE WHEN form <> 'plain' THEN length(middle) END AS middle_chars,
       sha256(CASE form WHEN 'psm' THEN '<P>' || prefix || '<S>' || suffix || '<M>' || middle WHEN 'spm' THEN '<S>' || suffix || '<P>' || prefix || '<M>' || middle ELSE whole END) AS output_sha256,
       sha256(whole) AS restored_sha256
FROM parted
"""
}
