"""Sharding by a permutation-filled lookup table.

Each shard has its own permutation of the slots of a table of prime size (an offset and a step from hashes of its
name). The shards take turns; at its turn a shard claims the first slot of its permutation that is
still free, until all are claimed. Shares differ by at most one slot, and adding or
removing a shard moves few slots. The table is bounded by its size parameter, so it goes to all
tasks, and placing a row is one lookup by the hash of its key: no shuffle, no skew, any number of rows.

A null key counts as the empty text. Equal keys meet in one shard. Extra columns are carried.
"""

from __future__ import annotations

import hashlib

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

SHARDS, SLOTS = 32, 5003


def _number(text: str) -> int:
    return int(hashlib.md5(text.encode()).hexdigest()[:15], 16)


def fill(shards: list[str], slots: int) -> list[int]:
    """Shard number of each slot."""
    if not shards or slots <= len(shards) or any(slots % p == 0 for p in range(2, int(slots**0.5) + 1)):
        raise ValueError("the table needs shards and a prime size above their number")
    start = [_number(f"offset:{s}") % slots for s in shards]
    step = [_number(f"step:{s}") % (slots - 1) + 1 for s in shards]
    owner, turn, at = [-1] * slots, 0, [0] * len(shards)
    for _ in range(slots):
        i = turn % len(shards)
        while owner[slot := (start[i] + at[i] * step[i]) % slots] >= 0:
            at[i] += 1
        owner[slot] = i
        turn += 1
    return owner


def slot_of(key: Column, slots: int) -> Column:
    text = F.coalesce(key.cast("string"), F.lit(""))
    return (F.conv(F.substring(F.md5(text), 1, 15), 16, 10).cast("long") % slots).cast("long")


def table(spark: SparkSession, shards: list[str], slots: int = SLOTS) -> DataFrame:
    """(slot, shard) of the filled table, `slots` rows."""
    return spark.createDataFrame([(s, i) for s, i in enumerate(fill(shards, slots))], "slot long, shard int")


def names(count: int) -> list[str]:
    return [f"shard-{i:05d}" for i in range(count)]


def place(df: DataFrame, key: str = "doc_id", shards: list[str] | None = None, slots: int = SLOTS) -> DataFrame:
    """`df` with `slot` and `shard`."""
    owners = table(df.sparkSession, shards or names(SHARDS), slots)
    kept = df.select(*[F.col(c) for c in df.columns if c not in ("slot", "shard")])
    return kept.withColumn("slot", slot_of(F.col(key), slots)).join(F.broadcast(owners), "slot").select(*kept.columns, "slot", "shard")
