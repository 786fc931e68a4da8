"""op3: every page written to WARC archives and read back."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestone.llm import shared, warc


def op3_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    archives = warc.write(shared.table(spark, sf_dir, "pages"), least=0)
    files = archives.count()
    found = warc.read(archives.repartition(max(1, files), F.xxhash64("archive")))
    return found.filter("kind = 'record'").select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


QUERIES = {"op3_warc": op3_warc}


def _base32(digest: str) -> str:
    """Five hex digits are four letters of base 32."""
    letters = "'ABCDEFGHIJKLMNOPQRSTUVWXYZ234567'"
    groups = [f"('0x' || substr({digest}, {5 * i + 1}, 5))::INTEGER" for i in range(8)]
    return " || ".join(f"substr({letters}, (({g} >> {shift}) & 31) + 1, 1)" for g in groups for shift in (15, 10, 5, 0))


#: What the records say, without archives.
ORACLES = {
    "op3_warc": f"""
WITH read AS (SELECT page_id, coalesce(html, '') AS payload, sha1(coalesce(html, '')) AS h FROM pages),
named AS (SELECT *, max(page_id) OVER (PARTITION BY payload) AS last FROM read)
SELECT page_id, octet_length(encode(payload))::BIGINT AS payload_bytes, {_base32("h")} AS payload_digest,
       CASE WHEN page_id = last THEN 'response' ELSE 'revisit' END AS record_type, CASE WHEN page_id <> last THEN last END AS refers_to
FROM named
"""
}
