"""Even and stable placement of rows on shards by a lookup table that the shards fill in turn."""

from __future__ import annotations

import hashlib
from collections.abc import Sequence

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kinname.llm.common import boxed, of_doc

#: The slots of the table: a prime, so that every shard's walk visits every slot.
SLOTS = 65_537


def preference(shard: str, slots: int) -> tuple[int, int]:
    """Where a shard's walk over the slots starts, and its stride; both depend on its name alone."""
    digest = hashlib.sha256(shard.encode()).digest()
    return int.from_bytes(digest[:8], "big") % slots, int.from_bytes(digest[8:16], "big") % (slots - 1) + 1


def lookup_table(shards: Sequence[str], slots: int = SLOTS) -> list[int]:
    """The shard number of each slot. In turn, each shard claims the next free slot on its walk.

    So the shards' shares differ by one slot at most, and when a shard comes or goes, few slots of the
    others change hands. The size is fixed, whatever the number of rows.
    """
    if not shards or len(set(shards)) < len(shards):
        raise ValueError("shards need distinct names, one at least")
    if slots < len(shards) or any(slots % k == 0 for k in range(2, int(slots**0.5) + 1)):
        raise ValueError("slots must be a prime that is not below the number of shards")
    walks = [preference(s, slots) for s in shards]
    steps, owner, free = [0] * len(shards), [-1] * slots, slots
    while free:
        for i, (start, stride) in enumerate(walks):
            if not free:
                break
            slot = (start + steps[i] * stride) % slots
            while owner[slot] >= 0:
                steps[i] += 1
                slot = (start + steps[i] * stride) % slots
            owner[slot] = i
            steps[i] += 1
            free -= 1
    return owner


def place(df: DataFrame, keys: Sequence[str], shards: Sequence[str], *, slots: int = SLOTS, slot_col: str = "slot", shard_col: str = "shard") -> DataFrame:
    """``df`` with each row's slot and shard.

    The table, of ``slots`` rows and thus of proven size, is broadcast; a row finds its shard by one
    hash and one look-up, without a shuffle, so neither hot keys nor large groups matter. Rows with
    equal keys share a shard. Null keys hash like any value (a row of null keys has a place too);
    repeated rows stay repeated; an empty table stays empty. slot_col and shard_col replace columns of
    the same names.
    """
    table = df.sparkSession.createDataFrame(pa.table({"at": pa.array(range(slots), pa.int32()), "owner": pa.array(lookup_table(shards, slots), pa.int32())}))
    marked = boxed(df).withColumn("slot", F.pmod(F.xxhash64(*[of_doc(k) for k in keys]), F.lit(slots)).cast("int"))
    kept = [c for c in df.columns if c not in (slot_col, shard_col)]
    placed = marked.join(F.broadcast(table), F.col("slot") == F.col("at"))
    return placed.select(*[of_doc(c).alias(c) for c in kept], F.col("slot").alias(slot_col), F.col("owner").alias(shard_col))
