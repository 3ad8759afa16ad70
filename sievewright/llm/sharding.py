"""Sharding by a permutation-filled lookup table.

Every shard orders the slots of a table of prime size by a permutation of its own (an offset and a step drawn from its
name) and the shards take turns, each claiming its next free slot, until the table is full. A row's key hashes to a
slot, the slot names the shard. Each shard gets its share of slots within one claim, and when shards come or go few
slots change hands. The table is the only thing broadcast: its size is a parameter and does not grow with the data.

Defined cases: a row with a null key is placed by its text; repeated rows fall to one shard; a null key with null text
goes where the empty text goes; texts of any length are hashed whole, where they stand in for a key; an empty table
gives an empty result; columns named ``slot`` or ``shard`` in the input give way to the result.
"""

from __future__ import annotations

import hashlib

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

TABLE_SIZE = 65_537
SHARDS = tuple(f"shard-{i:03d}" for i in range(64))


def _draw(name: str, salt: str) -> int:
    return int.from_bytes(hashlib.sha256(f"{salt}|{name}".encode()).digest()[:8], "big")


def fill_table(shards: tuple[str, ...] | list[str], size: int = TABLE_SIZE) -> list[int]:
    """For each slot, the index of the shard that claimed it."""
    if not shards or len(set(shards)) != len(shards):
        raise ValueError("shard names must be there and distinct")
    if size < len(shards) or any(size % d == 0 for d in range(2, int(size**0.5) + 1)):
        raise ValueError("the table's size must be a prime and no less than the number of shards")
    at = [_draw(s, "offset") % size for s in shards]
    step = [_draw(s, "step") % (size - 1) + 1 if size > 2 else 1 for s in shards]
    table, free = [-1] * size, size
    while True:
        for i in range(len(shards)):
            while table[at[i]] >= 0:
                at[i] = (at[i] + step[i]) % size
            table[at[i]] = i
            free -= 1
            if not free:
                return table


def slot_of(key: Column, text: Column, size: int = TABLE_SIZE) -> Column:
    stands_in = F.sha2(F.coalesce(text, F.lit("")), 256)
    return F.pmod(F.xxhash64(F.coalesce(key.cast("string"), stands_in)), F.lit(size)).cast("int")


def assign_shards(docs: DataFrame, shards: tuple[str, ...] | list[str] = SHARDS, *, key_col: str = "doc_id", text_col: str = "text", size: int = TABLE_SIZE) -> DataFrame:
    """docs with the columns slot and shard."""
    owners = fill_table(shards, size)
    slots = docs.sparkSession.createDataFrame(pa.table({"slot": pa.array(range(size), pa.int32()), "shard": [shards[i] for i in owners]}))
    rows = docs.drop("slot", "shard").withColumn("slot", slot_of(F.col(key_col), F.col(text_col), size))
    return rows.join(F.broadcast(slots), "slot").select(*(F.col(f"`{c}`") for c in rows.columns), "shard")
