"""Shard placement by a permutation-filled lookup table.

Each shard has a preference order over the slots of a table of prime size: from a hashed offset in
steps of a hashed skip. Shards take turns and claim the first free slot of their order until the table
is full, so shares differ by one slot at most and few slots move when a shard comes or goes. A key's
shard is the entry at its hash modulo the size: one look into a broadcast table.
"""

from __future__ import annotations

import hashlib

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

SHARDS = 32
#: Prime, and over a hundred times the shards: shares differ by under one percent. The largest table
#: that is accepted bounds what is broadcast.
TABLE_SIZE = 4099
LARGEST_TABLE = 1_000_003


def _hash(name: str, salt: str) -> int:
    return int(hashlib.md5(f"{salt}:{name}".encode()).hexdigest()[:15], 16)


def lookup_table(shards: list[str], size: int = TABLE_SIZE) -> list[int]:
    """For each slot, the number of the shard that claimed it."""
    if size > LARGEST_TABLE or size < 2 or any(size % d == 0 for d in range(2, int(size**0.5) + 1)):
        raise ValueError(f"the table's size has to be a prime up to {LARGEST_TABLE}")
    if not 0 < len(shards) <= size or len(set(shards)) < len(shards):
        raise ValueError("shards have to differ and to be one to as many as the table has slots")
    place = [_hash(x, "offset") % size for x in shards]
    skip = [_hash(x, "skip") % (size - 1) + 1 for x in shards]
    table = [-1] * size
    claimed = 0
    while True:
        for shard in range(len(shards)):
            while table[place[shard]] >= 0:
                place[shard] = (place[shard] + skip[shard]) % size
            table[place[shard]] = shard
            claimed += 1
            if claimed == size:
                return table


def slot(key: Column, size: int) -> Column:
    """The key's slot: the first 60 bits of its MD5 modulo the size."""
    return (F.conv(F.substring(F.md5(key), 1, 15), 16, 10).cast("long") % size).cast("int")


def shard_names(n: int = SHARDS) -> list[str]:
    return [f"shard-{i:05d}" for i in range(n)]


def table_frame(spark: SparkSession, shards: list[str], size: int = TABLE_SIZE) -> DataFrame:
    """(slot int, shard int): the table as a frame of `size` rows."""
    listed = ",".join(map(str, lookup_table(shards, size)))
    return spark.range(1).select(F.posexplode(F.split(F.lit(listed), ",").cast("array<int>")).alias("slot", "shard"))


def place(df: DataFrame, shards: list[str], key: str = "doc_id", spread: str = "text", size: int = TABLE_SIZE) -> DataFrame:
    """df's key with its slot and shard.

    Equal keys share a shard. A null key is placed by the column `spread` instead, so rows without a key
    don't meet in one shard; rows null in both go by the empty text. Nothing is shuffled.
    """
    by = F.coalesce(F.col(key).cast("string"), F.md5(F.col(spread).cast("string")), F.lit(""))
    keyed = df.select(F.col(key), slot(by, size).alias("slot"))
    return keyed.join(F.broadcast(table_frame(df.sparkSession, shards, size)), "slot").select(key, "slot", "shard")
