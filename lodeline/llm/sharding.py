"""Placement by a permutation-filled lookup table.

Each shard has a preference order over the slots of a prime-sized table, from
two hashes of its name. Shards take turns, and each claims the first free slot
it prefers, until the table is full: all get an equal share within one slot,
and a shard that leaves or joins moves few other slots. A key's hash names its
slot, so placement is one look-up; the table has a fixed size and is broadcast.

Defined results: rows without an id are placed by their text, rows without
both by the hash of nothing. Repeated ids meet in one shard. An empty table
gives an empty result. Output columns replace none of the input's: a clashing
name gets an underscore.
"""

from __future__ import annotations

import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodeline.llm.common import free_name

SLOTS = 65_537  # prime; at least a hundred slots for each shard keep shares even
SHARDS = 256


def is_prime(n: int) -> bool:
    return n > 1 and all(n % k for k in range(2, int(n**0.5) + 1))


def lookup_table(names: list[str], slots: int = SLOTS) -> list[int]:
    """The shard (place in ``names``) of each slot. The order of names doesn't
    matter for who owns which share; turns go by name."""
    if not is_prime(slots) or not 0 < len(names) <= slots or len(set(names)) < len(names):
        raise ValueError("slots must be prime and hold all shards, whose names differ")
    order = sorted(range(len(names)), key=lambda k: names[k])
    start = {k: xxhash.xxh64_intdigest(names[k], 1) % slots for k in order}
    step = {k: xxhash.xxh64_intdigest(names[k], 2) % (slots - 1) + 1 for k in order}
    table, free = [-1] * slots, slots
    while free:
        for k in order:
            at = start[k]
            while table[at] >= 0:
                at = (at + step[k]) % slots
            table[at], free = k, free - 1
            start[k] = (at + step[k]) % slots
            if not free:
                break
    return table


def slot_of(key: Column, text: Column, slots: int) -> Column:
    return F.pmod(F.when(key.isNotNull(), F.xxhash64(key)).otherwise(F.xxhash64(text)), F.lit(slots))


def place(docs: DataFrame, names: list[str], slots: int = SLOTS, key: str = "doc_id", text: str = "text") -> DataFrame:
    """The rows with their slot and shard: a broadcast look-up, no shuffle."""
    slot, shard = free_name(docs, "slot"), free_name(docs, "shard")
    at, to = free_name(docs, "table_slot"), free_name(docs, "table_shard")
    table = docs.sparkSession.createDataFrame(list(enumerate(lookup_table(names, slots))), "slot int, place int").toDF(at, to)
    placed = docs.withColumn(slot, slot_of(F.col(f"`{key}`"), F.col(f"`{text}`"), slots).cast("int"))
    return placed.join(F.broadcast(table), F.col(slot) == F.col(at), "left").withColumn(shard, F.col(to)).drop(at, to)


def write_shards(placed: DataFrame, path: str, shard: str = "shard", parts: int = 1) -> None:
    """One folder for each shard; ``parts`` splits large ones over tasks."""
    salt = free_name(placed, "part")
    spread = placed.withColumn(salt, F.pmod(F.xxhash64(*(F.col(f"`{c}`") for c in placed.columns if c != shard)), F.lit(parts)))
    spread.repartition(F.col(shard), F.col(salt)).drop(salt).write.mode("overwrite").partitionBy(shard).parquet(path)
