"""Placing rows on shards with a permutation-filled lookup table, in DataFrame operations only."""

from __future__ import annotations

import hashlib

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import table

SHARDS = [f"shard-{i:03d}" for i in range(64)]
#: A prime over 100 times the number of shards: no shard's share is off by more than about 1 %.
TABLE_SIZE = 16411


def _number(text: str) -> int:
    return int(hashlib.md5(text.encode()).hexdigest()[:13], 16)


def lookup_table(shards: list[str], size: int) -> list[int]:
    """The shard's index for each of ``size`` slots.

    A shard prefers the slots offset, offset + skip, ... (mod size), a permutation as size is prime.
    In turn, each shard claims the first slot of its order that is still free, until none is.
    Taking a shard away moves its own slots and few others. ``size`` bounds the table, whatever the data.
    """
    if not shards or len(set(shards)) < len(shards) or size < len(shards) or any(size % d == 0 for d in range(2, int(size**0.5) + 1)):
        raise ValueError("shards must be distinct, and the size a prime of at least their number")
    place = [_number(f"offset {s}") % size for s in shards]
    skip = [_number(f"skip {s}") % (size - 1) + 1 for s in shards]
    slots, left = [-1] * size, size
    while left:
        for i in range(len(shards)):
            if not left:
                break
            while slots[place[i]] >= 0:
                place[i] = (place[i] + skip[i]) % size
            slots[place[i]] = i
            left -= 1
    return slots


def slot_of(key: Column, size: int) -> Column:
    """Null keys share the slot of the empty text."""
    return F.conv(F.substring(F.md5(F.coalesce(key.cast("string"), F.lit(""))), 1, 13), 16, 10).cast("long") % size


def place(df: DataFrame, key: Column, shards: list[str] = SHARDS, size: int = TABLE_SIZE, slot_col: str = "slot", shard_col: str = "shard") -> DataFrame:
    """Adds each row's slot and shard. The table of ``size`` rows is broadcast; rows are not shuffled,
    so a key with many rows does not matter here. Columns of these names in ``df`` are replaced.
    Empty table: no rows."""
    slots = ",".join(map(str, lookup_table(shards, size)))
    lookup = df.sparkSession.range(1).select(F.posexplode(F.split(F.lit(slots), ",")).alias("maglev slot", "i"))
    lookup = lookup.select("maglev slot", F.element_at(F.array(*map(F.lit, shards)), F.col("i").cast("int") + 1).alias("maglev shard"))
    rows = df.withColumn("maglev key", slot_of(key, size)).drop(slot_col, shard_col)
    joined = rows.join(F.broadcast(lookup), F.col("maglev key") == F.col("maglev slot"))
    return joined.withColumn(slot_col, F.col("maglev key")).withColumn(shard_col, F.col("maglev shard")).drop("maglev key", "maglev slot", "maglev shard")


def op4_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "source", "n_chars")
    return place(docs, F.col("doc_id")).select("doc_id", "source", "n_chars", "slot", "shard")


def sql() -> str:
    slots = ",".join(map(str, lookup_table(SHARDS, TABLE_SIZE)))
    return f"""
WITH placed AS (
  SELECT doc_id, source, n_chars, ('0x' || substr(md5(coalesce(doc_id::VARCHAR, '')), 1, 13))::BIGINT % {TABLE_SIZE} AS slot FROM documents),
lookup AS (SELECT unnest(range({TABLE_SIZE})) AS slot, unnest(string_split('{slots}', ','))::BIGINT AS i)
SELECT doc_id, source, n_chars, slot, printf('shard-%03d', i) AS shard FROM placed JOIN lookup USING (slot)
"""
