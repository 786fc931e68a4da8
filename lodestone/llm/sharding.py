"""Shard placement by a permutation-filled lookup table.

Every shard has its own preference order over the slots of a prime-sized table: a first
slot and a step, both hashed from its name. Shards take turns; at its turn a shard
claims the next slot of its order that is still free. Placement hashes a key to a slot
and looks the slot up, so it costs one broadcast hash join against a table whose size is
a parameter, whatever the number of rows. When a shard leaves, almost only its own slots
change hands.

The table has ``size`` entries, a parameter, and is filled on the driver from the shard
names alone. Rows are touched by DataFrame functions only.

Defined results: a null key is placed as the empty string. Repeated rows are placed
alike. An empty table gives no rows. Other columns are kept; a column named like one of
the two results is replaced.
"""

from __future__ import annotations

import hashlib
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: The broadcast table stays under this many slots (at most about 20 MB).
MOST_SLOTS = 1_000_003


def is_prime(n: int) -> bool:
    return n > 1 and all(n % d for d in range(2, int(n**0.5) + 1))


def prime_from(n: int) -> int:
    """The least prime that is n or more."""
    while not is_prime(n):
        n += 1
    return n


def hashed(text: str) -> int:
    """60 bits of MD5, as SQL engines compute it too."""
    return int(hashlib.md5(text.encode()).hexdigest()[:15], 16)


def fill(shards: Sequence[str], size: int) -> list[int]:
    """The shard number of each slot."""
    if not shards:
        raise ValueError("no shards")
    if not is_prime(size) or len(shards) > size or size > MOST_SLOTS:
        raise ValueError(f"the table's size must be a prime of {len(shards)} to {MOST_SLOTS}")
    start = [hashed(f"{s}#first") % size for s in shards]
    step = [hashed(f"{s}#step") % (size - 1) + 1 if size > 2 else 1 for s in shards]
    slots, at, left, turn = [-1] * size, start[:], size, 0
    while left:
        slot = at[turn]
        while slots[slot] >= 0:
            slot = (slot + step[turn]) % size
        slots[slot] = turn
        at[turn] = (slot + step[turn]) % size
        left -= 1
        turn = (turn + 1) % len(shards)
    return slots


def slot_of(key: Column, size: int) -> Column:
    digest = F.md5(F.coalesce(key.cast("string"), F.lit("")).cast("binary"))
    return F.conv(F.substring(digest, 1, 15), 16, 10).cast("long") % size


def lookup(spark: SparkSession, shards: Sequence[str], size: int) -> DataFrame:
    """(slot, shard) as a DataFrame of ``size`` rows."""
    numbers = F.split(F.lit(",".join(map(str, fill(shards, size)))), ",")
    names = F.array(*[F.lit(s) for s in shards])
    return spark.range(1).select(F.posexplode(numbers).alias("slot", "n")).select(F.col("slot").cast("long").alias("slot"), F.element_at(names, F.col("n").cast("int") + 1).alias("shard"))


def place(df: DataFrame, key: Column, shards: Sequence[str], size: int) -> DataFrame:
    """df with ``slot`` and ``shard``."""
    table = F.broadcast(lookup(df.sparkSession, shards, size))
    kept = df.drop("slot", "shard")
    return kept.withColumn("slot", slot_of(key, size)).join(table, "slot").select(*kept.columns, "slot", "shard")


def place_groups(df: DataFrame, group: str, row: str, shards: Sequence[str], size: int) -> DataFrame:
    """Like place(), with the rows of a group kept together unless the group has more
    rows than a shard's fair share: such a group is dealt by group and row instead. At
    most as many groups as shards can be so large, so the list of them is bounded."""
    fair = df.agg(F.count(F.lit(1)).alias("n")).select((F.col("n") / len(shards)).alias("fair"))
    counts = df.groupBy(F.col(group).alias("_group")).agg(F.count(F.lit(1)).alias("_n"))
    large = counts.join(F.broadcast(fair), F.col("_n") > F.col("fair")).select("_group", F.lit(True).alias("_large"))
    marked = df.join(F.broadcast(large), F.col(group).eqNullSafe(F.col("_group")), "left")
    key = F.when(F.col("_large"), F.concat_ws("#", F.col(group).cast("string"), F.col(row).cast("string"))).otherwise(F.col(group).cast("string"))
    return place(marked.withColumn("_key", key).drop("_group", "_large"), F.col("_key"), shards, size).drop("_key")
