"""Shards claim the slots of a prime-sized table in turns; a key's hash picks its slot.

Every shard has its own order of preference over all slots, a walk from a hashed offset in
steps of a hashed skip. In turns the shards claim the best slot still free, so each gets
the same share within one slot, and when a shard comes or goes few slots change hands.
"""

from __future__ import annotations

import numpy as np
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Slots of the table: a prime well above a hundred times the number of shards.
SLOTS = 65537


def _prime(n: int) -> bool:
    return n > 1 and all(n % d for d in range(2, int(n**0.5) + 1))


def slot_table(shards: list[str], slots: int = SLOTS) -> np.ndarray:
    """Which shard (its number in ``shards``) owns each slot."""
    if not shards or len(set(shards)) != len(shards) or len(shards) > slots:
        raise ValueError("give distinct shard names, no more than there are slots")
    if not _prime(slots):
        raise ValueError("the number of slots must be prime")
    names = [s.encode() for s in shards]
    at = [xxhash.xxh64_intdigest(s, 1) % slots for s in names]
    skip = [xxhash.xxh64_intdigest(s, 2) % (slots - 1) + 1 if slots > 2 else 1 for s in names]
    owner = [-1] * slots
    left = slots
    while True:
        for k in range(len(names)):
            while owner[at[k]] >= 0:
                at[k] = (at[k] + skip[k]) % slots
            owner[at[k]] = k
            left -= 1
            if not left:
                return np.array(owner, np.int32)


def slot_of(key: Column, slots: int = SLOTS) -> Column:
    """Slot of a key; the text of the key is hashed, a null key counts as the empty text."""
    text = F.coalesce(key.cast("string"), F.lit(""))
    return F.pmod(F.conv(F.substring(F.md5(text), 1, 15), 16, 10).cast("long"), F.lit(slots)).cast("int")


def assign_shards(df: DataFrame, key: str, shards: list[str], slots: int = SLOTS) -> DataFrame:
    """Add ``slot`` and ``shard`` (replacing columns of these names) by the key column.

    The table has a fixed size and is broadcast: one lookup a row, no shuffle. Equal keys share
    a shard, so repeated rows stay together; null keys share the shard of the empty text.
    """
    owner = slot_table(shards, slots)
    session = df.sparkSession
    table = session.createDataFrame(
        [(k, shards[o]) for k, o in enumerate(owner.tolist())], "slot int, shard string"
    )
    kept = df.select(*[c for c in df.columns if c not in ("slot", "shard")], slot_of(F.col(key), slots).alias("slot"))
    return kept.join(F.broadcast(table), "slot").select(*[c for c in kept.columns if c != "slot"], "slot", "shard")


def write_shards(df: DataFrame, key: str, shards: list[str], path: str, files: int = 1, slots: int = SLOTS) -> None:
    """Write one folder a shard. A shard's rows go to ``files`` tasks by key, so a large shard is not one task."""
    placed = assign_shards(df, key, shards, slots)
    part = F.pmod(F.xxhash64(key), F.lit(files))
    placed.repartition(len(shards) * files, "shard", part).write.partitionBy("shard").parquet(path)
