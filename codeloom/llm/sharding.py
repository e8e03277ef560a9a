"""Placement by a permutation-filled lookup table.

Each shard has a preference order over the slots of a table of prime size: an
offset and a step from two hashes of its name.  Shards take turns claiming their
next free slot until the table is full, so every shard holds almost the same
number of slots, and few slots change hands when a shard is added or removed.
The table has ``SLOTS`` rows whatever the data's size; it is broadcast, and a row
is placed by one look at the slot that its key hashes to.

Defined results: a null key has a slot like any other key; equal keys go to the
same shard.
"""

from __future__ import annotations

import hashlib

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

SLOTS = 65_537


def _number(name: str, salt: str) -> int:
    return int.from_bytes(hashlib.blake2b(name.encode(), digest_size=8, salt=salt.encode()).digest(), "big")


def fill(shards: list[str], slots: int = SLOTS) -> list[int]:
    """The index of the shard that holds each slot."""
    if not shards or len(set(shards)) != len(shards):
        raise ValueError("shards must be named, each once")
    if slots < len(shards) or any(slots % k == 0 for k in range(2, int(slots**0.5) + 1)):
        raise ValueError("slots must be a prime of at least the number of shards")
    at = [_number(s, "offset") % slots for s in shards]
    step = [_number(s, "step") % (slots - 1) + 1 if slots > 2 else 1 for s in shards]
    held, free = [-1] * slots, slots
    while free:
        for i in range(len(shards)):
            while held[at[i]] >= 0:
                at[i] = (at[i] + step[i]) % slots
            held[at[i]] = i
            free -= 1
            if not free:
                break
    return held


def lookup(spark: SparkSession, shards: list[str], slots: int = SLOTS) -> DataFrame:
    """The table as rows (slot, shard)."""
    return spark.createDataFrame(list(enumerate(shards[i] for i in fill(shards, slots))), "slot int, shard string")


def slot(column, slots: int = SLOTS):
    return F.pmod(F.xxhash64(column.cast("string")), F.lit(slots)).cast("int")


def place(df: DataFrame, shards: list[str], key: str = "doc_id", slots: int = SLOTS) -> DataFrame:
    """``df`` with the columns slot and shard (which replace any of those names)."""
    df = df.drop("slot", "shard").withColumn("slot", slot(F.col(key), slots))
    return df.join(F.broadcast(lookup(df.sparkSession, shards, slots)), "slot", "left")


def write(df: DataFrame, shards: list[str], path: str, key: str = "doc_id", files: int = 8, slots: int = SLOTS) -> None:
    """Write ``df`` to one folder a shard, each in up to ``files`` files."""
    placed = place(df, shards, key, slots)
    part = F.pmod(F.xxhash64(F.col("slot")), F.lit(files))
    placed.repartition(F.col("shard"), part).drop("slot").write.partitionBy("shard").parquet(path)
