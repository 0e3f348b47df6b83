"""Sharding by a permutation-filled lookup table.

Every shard has its own preference order of the slots of a prime-sized table. The shards take turns, each
claiming the first free slot of its order, until the table is full. A key goes to the shard at its hash modulo
the table size: constant time, nearly equal shares, and few keys move when a shard comes or goes.
"""

from __future__ import annotations

import hashlib

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: A prime well above a hundred times the usual number of shards; also the bound of what is broadcast.
TABLE_SIZE = 65_537


def _is_prime(n: int) -> bool:
    return n > 1 and all(n % d for d in range(2, int(n**0.5) + 1))


def preference(shard: str, size: int) -> tuple[int, int]:
    """Offset and stride of a shard's order of the slots; any stride below a prime visits every slot."""
    digest = hashlib.sha256(shard.encode()).digest()
    return int.from_bytes(digest[:8], "big") % size, int.from_bytes(digest[8:16], "big") % (size - 1) + 1


def fill_table(shards: list[str], size: int = TABLE_SIZE) -> list[int]:
    """Shard index of each slot. Order and repeats of the shard names do not matter for which name gets a slot."""
    if not shards:
        raise ValueError("no shards")
    if len(set(shards)) != len(shards):
        raise ValueError("shard names repeat")
    if not _is_prime(size) or size < len(shards):
        raise ValueError("the table size must be a prime that is not below the number of shards")
    table = [-1] * size
    turns = sorted(range(len(shards)), key=lambda i: shards[i])
    orders = {i: preference(shards[i], size) for i in turns}
    steps = dict.fromkeys(turns, 0)
    free = size
    while True:
        for i in turns:
            offset, stride = orders[i]
            while table[slot := (offset + steps[i] * stride) % size] >= 0:
                steps[i] += 1
            table[slot] = i
            free -= 1
            if not free:
                return table


def slot_of(key: Column, size: int = TABLE_SIZE) -> Column:
    """Slot of a key: 60 bits of its MD5, modulo the table size. A null key counts as the empty text."""
    digest = F.md5(F.coalesce(key.cast("string"), F.lit("")).cast("binary"))
    return F.pmod(F.conv(F.substring(digest, 1, 15), 16, 10).cast("long"), F.lit(size)).cast("int")


def assign_shards(docs: DataFrame, shards: list[str], key: str = "doc_id", size: int = TABLE_SIZE) -> DataFrame:
    """key, slot and shard of every row; the table of `size` slots (its proven bound) is broadcast, nothing is shuffled.

    Equal keys share a slot whatever their number; null keys go to the slot of the empty text; other columns
    are ignored; no rows give no rows.
    """
    table = fill_table(shards, size)
    lookup = docs.sparkSession.createDataFrame([(slot, shards[i]) for slot, i in enumerate(table)], "slot int, shard string")
    return docs.select(F.col(key), slot_of(F.col(key), size).alias("slot")).join(F.broadcast(lookup), "slot").select(key, "slot", "shard")


def write_shards(docs: DataFrame, shards: list[str], path: str, key: str = "doc_id", salts: int = 16) -> None:
    """Write whole rows into one folder for each shard; `salts` tasks share a shard, so that a hot key splits.

    The task follows from the row's values alone, so that a retried task writes the same rows.
    """
    table = fill_table(shards)
    lookup = docs.sparkSession.createDataFrame([(slot, shards[i]) for slot, i in enumerate(table)], "__slot int, __shard string")
    placed = docs.withColumn("__slot", slot_of(F.col(key))).join(F.broadcast(lookup), "__slot").drop("__slot")
    placed.repartition(len(shards) * salts, "__shard", F.pmod(F.xxhash64(*docs.columns), F.lit(salts))).write.partitionBy("__shard").parquet(path)
