"""op9: every document placed on one of 64 shards, 100 slots a shard."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestone.llm import shared, sharding

SHARDS = [f"shard-{i:02d}" for i in range(64)]
SIZE = sharding.prime_from(100 * len(SHARDS))


def op9_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = shared.table(spark, sf_dir, "documents").select("doc_id")
    return sharding.place(docs, F.col("doc_id"), SHARDS, SIZE)


QUERIES = {"op9_sharding": op9_sharding}



def _hash(text: str) -> str:
    return f"('0x' || substr(md5({text}), 1, 15))::BIGINT"


_TURN = f"(b.turn % {len(SHARDS)} + 1)"


def _at(j: str) -> str:
    """Slot j of the order of the shard whose turn it is, from 0."""
    return f"(first[{_TURN}] + step[{_TURN}] * {j}) % {SIZE}"


_FREE = f"list_filter(range({SIZE}), lambda j: a.slots[({_at('j')}) + 1] < 0)[1]"
_SLOT = f"({_at(_FREE)})"
_DOC = f"{_hash("coalesce(d.doc_id::VARCHAR, '')")} % {SIZE}"

#: The same table filled turn by turn in one fold over the turns.
ORACLES = {
    "op9_sharding": f"""
WITH shards AS (
  SELECT i, 'shard-' || lpad(i::VARCHAR, 2, '0') AS name FROM range({len(SHARDS)}) t(i)
), orders AS (
  SELECT list(name ORDER BY i) AS names,
         list({_hash("name || '#first'")} % {SIZE} ORDER BY i) AS first,
         list({_hash("name || '#step'")} % {SIZE - 1} + 1 ORDER BY i) AS step
  FROM shards
), filled AS (
  SELECT names, list_reduce(
    list_transform(range({SIZE}), lambda s: {{'turn': s, 'slots': []::BIGINT[]}}),
    lambda a, b: {{
      'turn': b.turn,
      'slots': list_concat(list_concat(a.slots[1:{_SLOT}], [{_TURN} - 1]), a.slots[{_SLOT} + 2:])
    }},
    {{'turn': 0::BIGINT, 'slots': list_transform(range({SIZE}), lambda s: -1::BIGINT)}}
  ).slots AS slots
  FROM orders
)
SELECT d.doc_id, {_DOC} AS slot, f.names[f.slots[{_DOC} + 1] + 1] AS shard
FROM documents d, filled f
"""
}
