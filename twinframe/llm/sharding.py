"""Sharding by a permutation-filled lookup table.

Every shard has a preference order over the slots of a prime-sized table: offset, offset + skip, offset + 2 skip, ...
(a permutation, as the size is prime). The shards take turns; at each turn one claims its first slot that is free.
All shards so get the same number of slots within one, and when a shard leaves, few slots of the others move.
A row's slot is a hash of its key modulo the size; the table of `size` rows, a constant, is broadcast.
"""

from __future__ import annotations

import hashlib

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ._io import without

SIZE = 65537


def _number(text: str) -> int:
    return int(hashlib.md5(text.encode()).hexdigest()[:15], 16)


def is_prime(n: int) -> bool:
    return n > 1 and all(n % d for d in range(2, int(n**0.5) + 1))


def lookup_table(shards: list[str], size: int = SIZE) -> list[int]:
    """For each slot the index of the shard that claimed it."""
    if not shards or len(set(shards)) != len(shards):
        raise ValueError("shards must be distinct names, one at least")
    if not is_prime(size) or size < len(shards):
        raise ValueError("size must be a prime number, no smaller than the number of shards")
    at = [_number(f"offset {s}") % size for s in shards]
    skip = [_number(f"skip {s}") % (size - 1) + 1 for s in shards]
    table, left = [-1] * size, size
    while left:
        for k in range(len(shards)):
            while table[at[k]] >= 0:
                at[k] = (at[k] + skip[k]) % size
            table[at[k]] = k
            left -= 1
            if not left:
                break
    return table


def slot(key, size: int = SIZE, spread=None):
    """Slot of a key column. `spread`, a column of small integers, deals the rows of one key over that many slots."""
    text = F.coalesce(key.cast("string"), F.lit(""))
    if spread is not None:
        text = F.concat(text, F.lit("#"), spread.cast("string"))
    return F.conv(F.substring(F.md5(text.cast("binary")), 1, 15), 16, 10).cast("bigint") % size


def table_frame(spark: SparkSession, shards: list[str], size: int = SIZE) -> DataFrame:
    """(slot, shard) rows; `size` bounds them."""
    packed = F.split(F.lit(",".join(map(str, lookup_table(shards, size)))), ",")
    names = F.split(F.lit("\n".join(shards)), "\n")
    return spark.range(0, size, 1, 1).select(F.col("id").alias("slot"), F.get(names, F.get(packed, F.col("id").cast("int")).cast("int")).alias("shard"))


def place(df: DataFrame, key: str, shards: list[str], size: int = SIZE, spread=None) -> DataFrame:
    """Adds `slot` and `shard` to every row.

    Rows with equal keys share a shard; where a key may hold a large part of all rows, give `spread` (say, another
    column's hash modulo 64). A null key counts as an empty text. Columns of `df` named slot or shard are replaced;
    an empty table gives an empty result.
    """
    placed = df.select(*[df[c] for c in without(df, "slot", "shard")], slot(df[key], size, spread).alias("slot"))
    return placed.join(F.broadcast(table_frame(df.sparkSession, shards, size)), "slot")


def write_shards(df: DataFrame, path: str, key: str, shards: list[str], size: int = SIZE, tasks_per_shard: int = 8) -> None:
    """A Parquet folder for each shard. Each shard is dealt over several tasks, so that no task gets a whole large one."""
    placed = place(df, key, shards, size)
    deal = F.pmod(F.xxhash64(*[placed[c] for c in placed.columns if not placed.schema[c].dataType.typeName().startswith("map")]), F.lit(tasks_per_shard))
    placed.repartition("shard", deal).write.partitionBy("shard").parquet(path)
