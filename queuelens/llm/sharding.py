"""Sharding by a permutation-filled lookup table.

Every shard prefers the slots of a table of prime size in an order of its own: an offset and
a skip, both hashes of its name.  Shards take turns, each claiming its most preferred free
slot, until the table is full; so shares differ by one slot at most, and when shards
come or go most slots stay where they were.  A row goes to the shard of the slot that its
key hashes to.

Plan
----
The table has a fixed size and depends on the shard names alone, so it is filled once on
the driver and broadcast; placement is a hash and a lookup in the scan, with no shuffle.
``write_shards`` deals the rows of a shard over as many tasks as its size asks for.

Defined results: rows with equal keys share a shard; a null key hashes like an empty
string; every row is placed once, repeated rows too; an empty table gives an empty
result.  Columns of the input are passed on; slot and shard are added, or replaced if there.
"""

from __future__ import annotations

import hashlib

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from queuelens.llm.stages import free_name

SLOTS = 65_537


def _is_prime(n: int) -> bool:
    return n > 1 and all(n % k for k in range(2, int(n**0.5) + 1))


def _number(name: str, use: str) -> int:
    return int(hashlib.md5(f"{use}:{name}".encode()).hexdigest()[:15], 16)


def lookup_table(shards: list[str], slots: int = SLOTS) -> np.ndarray:
    """Number of the shard in each slot; ``slots`` is a prime over the number of shards."""
    if not _is_prime(slots) or len(shards) > slots or len(set(shards)) != len(shards):
        raise ValueError("shards need distinct names, and a prime number of slots that is not smaller")
    if not shards:
        raise ValueError("no shards")
    # the order of turns is that of the names' hashes, not that of the list
    turns = sorted(range(len(shards)), key=lambda k: (_number(shards[k], "turn"), shards[k]))
    at = [_number(shards[k], "offset") % slots for k in turns]
    skip = [_number(shards[k], "skip") % (slots - 1) + 1 for k in turns]
    table = np.full(slots, -1, np.int64)
    left = slots
    while left:
        for place, shard in enumerate(turns):
            while table[at[place]] >= 0:
                at[place] = (at[place] + skip[place]) % slots
            table[at[place]] = shard
            left -= 1
            if not left:
                break
    return table


def slot_of(key: Column, slots: int = SLOTS) -> Column:
    """Slot of a key: the leading 60 bits of the MD5 digest of its text."""
    digest = F.md5(F.coalesce(key.cast("string"), F.lit("")).cast("binary"))
    return F.conv(F.substring(digest, 1, 15), 16, 10).cast("long") % slots


def place(
    rows: DataFrame, shards: list[str], key_col: str = "doc_id", slots: int = SLOTS
) -> DataFrame:
    """``rows`` with the columns slot and shard."""
    table = lookup_table(shards, slots)
    at, slot, shard = (free_name(rows, c) for c in ("_at", "_slot", "_shard"))
    schema = T.StructType([T.StructField(slot, T.LongType()), T.StructField(shard, T.StringType())])
    # one short row per slot, a number that is fixed beforehand
    lookup = rows.sparkSession.createDataFrame(
        [(n, shards[int(k)]) for n, k in enumerate(table)], schema
    )
    placed = rows.withColumn(at, slot_of(F.col(key_col), slots)).join(
        F.broadcast(lookup), F.col(at) == F.col(slot)
    )
    return placed.withColumns({"slot": F.col(slot), "shard": F.col(shard)}).drop(at, slot, shard)


def write_shards(placed: DataFrame, path: str) -> None:
    """One folder per shard; a shard's rows are dealt by size, not gathered in one task."""
    placed.hint("rebalance", "shard").write.partitionBy("shard").parquet(path)


def manifest(placed: DataFrame) -> DataFrame:
    """Rows of each shard."""
    return placed.groupBy("shard").agg(F.count(F.lit(1)).alias("rows"))
