"""Sharding by a permutation-filled lookup table.

Each shard has its own preference order over the slots of a prime-sized table, and the
shards take turns claiming their next free slot until the table is full. A row's slot
is a hash of its key; its shard is one look-up. Shards hold nearly equal numbers of
slots, and when a shard joins or leaves, few slots of the others change hands.
"""

from __future__ import annotations

import hashlib
import json
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import col, free_name

TABLE_SIZE = 65537


def _is_prime(n: int) -> bool:
    return n > 1 and all(n % k for k in range(2, int(n ** 0.5) + 1))


def fill(shards: Sequence[str], size: int = TABLE_SIZE) -> list[int]:
    """The shard number that owns each slot. ``size`` must be prime, so that every
    step length visits all slots; the order of ``shards`` only breaks ties of turns."""
    if not shards or len(set(shards)) != len(shards):
        raise ValueError("shards must be distinct and at least one")
    if not _is_prime(size) or size < len(shards):
        raise ValueError("the table size must be a prime of at least the number of shards")
    start, step = [], []
    for name in shards:
        digest = hashlib.sha256(name.encode()).digest()
        start.append(int.from_bytes(digest[:8], "big") % size)
        step.append(int.from_bytes(digest[8:16], "big") % (size - 1) + 1)
    owner, at, free = [-1] * size, start[:], size
    while free:
        for k in range(len(shards)):
            while owner[at[k]] >= 0:
                at[k] = (at[k] + step[k]) % size
            owner[at[k]] = k
            free -= 1
            if not free:
                break
    return owner


def lookup_table(spark: SparkSession, shards: Sequence[str], size: int = TABLE_SIZE) -> DataFrame:
    """(slot int, shard string): ``size`` rows, whatever is to be placed."""
    owner = json.dumps([shards[k] for k in fill(shards, size)])
    return spark.range(1).select(F.posexplode(F.from_json(F.lit(owner), "array<string>")).alias("slot", "shard"))


def slot_of(key: Column, spread: Column, size: int = TABLE_SIZE) -> Column:
    """Slot of a key; rows without a key are spread by another column."""
    return F.pmod(F.coalesce(F.when(key.isNotNull(), F.xxhash64(key)), F.xxhash64(F.lit("no key"), spread)),
                  F.lit(size)).cast("int")


def shard(rows: DataFrame, shards: Sequence[str], key_col: str = "doc_id", spread_col: str = "text",
          size: int = TABLE_SIZE, slot_name: str = "slot", shard_name: str = "shard") -> DataFrame:
    """``rows`` with the columns ``slot`` and ``shard``, without a shuffle: the look-up
    table has a fixed number of rows and is broadcast.

    Rows of one key share a shard, so ``key_col`` should be nearly unique; to shard by
    a column with a hot value, make the key of that column and an id.

    Defined cases: a null key is placed by ``spread_col`` (null there too: all such rows
    share a slot); repeated rows share a shard; an empty table gives an empty result;
    other columns pass through, and a column of ``rows`` that is called like a result
    column is an error.
    """
    clash = {slot_name.lower(), shard_name.lower()} & {c.lower() for c in rows.columns}
    if clash:
        raise ValueError(f"the rows already have {sorted(clash)}; choose other names")
    at = free_name(rows, "at")
    table = lookup_table(rows.sparkSession, shards, size).select(F.col("slot").alias(at), F.col("shard").alias(shard_name))
    return (rows.withColumn(slot_name, slot_of(col(key_col), col(spread_col), size))
            .join(F.broadcast(table), F.col(slot_name) == F.col(at), "left").drop(at))
