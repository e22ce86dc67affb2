"""Sharding by a permutation-filled lookup table.

Each shard has its own permutation of a prime number of slots (an offset and a
skip from hashes of its name). Shards take turns; each claims the first slot of
its permutation that is still free, until the table is full, so shares differ
by at most one slot and losing a shard moves few keys. The table's size is a
parameter, so it may be broadcast; a row finds its shard by one lookup.

Defined cases: a null key counts as the empty text; rows of one key share a
shard; columns named slot or shard are replaced; an empty table gives no rows.
"""

from __future__ import annotations

import hashlib

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from graphlens.llm import common

SHARDS = 64
SLOTS_PER_SHARD = 100


def next_prime(n: int) -> int:
    while n < 2 or any(n % k == 0 for k in range(2, int(n**0.5) + 1)):
        n += 1
    return n


def fill_table(shards: list[str], size: int) -> list[int]:
    """Slot -> index of its shard."""
    digest = [hashlib.md5(name.encode()).digest() for name in shards]
    place = [int.from_bytes(d[:8], "big") % size for d in digest]
    skip = [int.from_bytes(d[8:], "big") % (size - 1) + 1 for d in digest]
    owner, free = [-1] * size, size
    while free:
        for k in range(len(shards)):
            while owner[place[k]] >= 0:
                place[k] = (place[k] + skip[k]) % size
            owner[place[k]] = k
            free -= 1
            if not free:
                break
    return owner


def shard_names(n: int) -> list[str]:
    return [f"shard-{k:05d}" for k in range(n)]


def assign_shards(df: DataFrame, key: str = "doc_id", shards: list[str] | None = None, size: int | None = None) -> DataFrame:
    """df plus slot (long) and shard (int)."""
    shards = shards or shard_names(SHARDS)
    size = size or next_prime(SLOTS_PER_SHARD * len(shards))
    if not 1 <= len(shards) <= size:
        raise ValueError("the table needs a slot for each shard")
    spark = df.sparkSession
    slot, shard = common.unused(df, "slot_", "shard_")
    owner = spark.createDataFrame(list(enumerate(fill_table(shards, size))), f"{slot} long, {shard} int")
    keep = [c for c in df.columns if c.lower() not in ("slot", "shard")]
    slotted = df.select(*keep, (common.hash_key(F.col(key)) % size).alias("slot"))
    return slotted.join(F.broadcast(owner), F.col("slot") == F.col(slot)).select(*keep, "slot", F.col(shard).alias("shard"))


def op9_sharding(spark, sf_dir: str) -> DataFrame:
    return assign_shards(common.table(spark, sf_dir, "documents").select("doc_id", "source"))


def oracle() -> str:
    size = next_prime(SLOTS_PER_SHARD * SHARDS)
    owner = ",".join(map(str, fill_table(shard_names(SHARDS), size)))
    return f"""
WITH slotted AS (
  SELECT doc_id, source, ('0x' || substr(md5(coalesce(doc_id::VARCHAR, '')), 1, 15))::BIGINT % {size} AS slot FROM documents)
SELECT doc_id, source, slot, (string_split('{owner}', ',')[(slot + 1)::INT])::INT AS shard FROM slotted
"""
