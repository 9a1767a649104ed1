"""Sharding by a permutation-filled lookup table.

Each shard has its own preference order over a prime number of slots, (offset + j * skip) mod size. Shards
take turns claiming their next free slot until the table is full, so all shares differ by at most one slot
and the loss of one shard moves few other slots. The table has ``size`` rows whatever the data: it is
broadcast, and each row finds its shard by one hash and one lookup.
"""

from __future__ import annotations

import hashlib

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

TABLE_SIZE = 65_537
MAX_TABLE = 5_000_011  # slots; the proven bound of what is broadcast


def _is_prime(n: int) -> bool:
    return n > 1 and all(n % k for k in range(2, int(n**0.5) + 1))


def preference(shard: str, size: int) -> tuple[int, int]:
    """Offset and skip of a shard's preference order."""
    digest = hashlib.sha256(shard.encode()).digest()
    return int.from_bytes(digest[:8], "big") % size, int.from_bytes(digest[8:16], "big") % (size - 1) + 1


def lookup_table(shards: list[str], size: int = TABLE_SIZE) -> list[str]:
    """The shard of each slot. ``size`` is a prime of at most MAX_TABLE and not below the number of shards;
    names are distinct and not empty in number."""
    if not _is_prime(size) or size > MAX_TABLE or not 0 < len(shards) <= size or len(set(shards)) < len(shards):
        raise ValueError("size must be a prime up to MAX_TABLE; shards distinct, 1 to size of them")
    if len(shards) == 1:
        return shards * size
    slots: list[str | None] = [None] * size
    turns = [preference(s, size) for s in shards]
    place = [offset for offset, _ in turns]
    left = size
    while True:
        for k, (_, skip) in enumerate(turns):
            while slots[place[k]] is not None:
                place[k] = (place[k] + skip) % size
            slots[place[k]] = shards[k]
            left -= 1
            if not left:
                return slots


def slot_of(key: Column, size: int = TABLE_SIZE) -> Column:
    """The slot of a key column: null keys share the slot of the empty string."""
    return F.pmod(F.xxhash64(F.coalesce(key.cast("string"), F.lit(""))), F.lit(size)).cast("int")


def table_frame(spark: SparkSession, shards: list[str], size: int = TABLE_SIZE) -> DataFrame:
    return spark.createDataFrame(list(enumerate(lookup_table(shards, size))), "slot int, shard string")


def assign_shards(rows: DataFrame, shards: list[str], key: str = "doc_id", size: int = TABLE_SIZE, slot_col: str = "slot", shard_col: str = "shard") -> DataFrame:
    """rows with a slot and a shard. No shuffle. Equal keys go to one shard; every row, repeated or with a
    null key, gets one. Columns of rows that are named slot_col or shard_col are replaced."""
    table = table_frame(rows.sparkSession, shards, size).toDF("_pm_slot", "_pm_shard")
    keyed = rows.withColumn("_pm_at", slot_of(F.col(key), size))
    out = keyed.join(F.broadcast(table), keyed["_pm_at"] == table["_pm_slot"], "left")
    keep = [c for c in rows.columns if c not in (slot_col, shard_col)]
    return out.select(*keep, F.col("_pm_at").alias(slot_col), F.col("_pm_shard").alias(shard_col))
