"""Jump consistent hashing of stable keys to shards (Lamping and Veach, 2014), as column expressions only."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sluicebox.llm.common import numbered

#: Fixed value: the multiplier of the published generator, in limbs of 24, 24 and 16 bits.
MULTIPLIER = 2862933555777941757
LIMB = (1 << 24) - 1


def jump_shard(key: Column, shards: int) -> Column:
    """The shard, 0 to ``shards`` - 1, of a 64-bit key that is spread evenly over all its bits.

    The generator's 64-bit state is kept in three limbs, so that no product overflows. A key jumps to ever larger
    shards until it would leave the last one: after about ln(shards) jumps on the average, and ``shards`` at most. A
    first run has room for nearly all keys and a second one for the rest, so that the result is exact for each.
    """
    if shards < 1:
        raise ValueError("there must be one shard at least")
    c0, c1, c2 = MULTIPLIER & LIMB, MULTIPLIER >> 24 & LIMB, MULTIPLIER >> 48
    limb = F.lit(LIMB).cast("long")

    def state(a0: Column, a1: Column, a2: Column, shard: Column, jump: Column) -> Column:
        names = ("a0", "a1", "a2", "shard", "jump")
        return F.struct(*(c.cast("long").alias(n) for c, n in zip((a0, a1, a2, shard, jump), names)))

    def step(s: Column, _: Column) -> Column:
        r0 = s["a0"] * c0 + 1
        r1 = s["a0"] * c1 + s["a1"] * c0 + F.shiftright(r0, 24)
        r2 = s["a0"] * c2 + s["a1"] * c1 + s["a2"] * c0 + F.shiftright(r1, 24)
        a0, a1, a2 = r0.bitwiseAND(limb), r1.bitwiseAND(limb), r2.bitwiseAND(F.lit(65535).cast("long"))
        high = F.shiftleft(a2, 15) + F.shiftright(a1, 9) + 1
        jump = (s["jump"] + 1).cast("double") * (F.lit(float(1 << 31)) / high.cast("double"))
        return F.when(s["jump"] >= shards, s).otherwise(state(a0, a1, a2, s["jump"], F.floor(jump)))

    none = F.lit(0)
    begin = state(
        key.bitwiseAND(limb),
        F.shiftrightunsigned(key, 24).bitwiseAND(limb),
        F.shiftrightunsigned(key, 48),
        none,
        none,
    )
    likely = min(shards, 16 + 4 * math.ceil(math.log(shards)))
    after = F.aggregate(F.sequence(F.lit(1), F.lit(likely)), begin, step)
    if likely < shards:
        rest = F.when(after["jump"] < shards, F.sequence(F.lit(1), F.lit(shards))).otherwise(F.array().cast("array<int>"))
        after = F.aggregate(rest, after, step)
    return after["shard"].cast("int")


def stable_key(*columns: Column) -> Column:
    """64 evenly spread bits of the columns; a null key is a key like any other."""
    return F.xxhash64(*columns)


def shard_documents(docs: DataFrame, shards: int, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Shard and slot of every row, by its key alone.

    One more shard takes rows from all others only into itself; ``grown_shard`` says where each row goes then. Rows with
    the same key share a shard. Slots count gaplessly from 0 in each shard, by key, text checksum and size; equal rows
    take consecutive slots. A null text counts as empty, a null key is one key of its own, an empty table gives no row.
    Only the named columns are read.
    """
    body = F.encode(F.coalesce(F.col(text), F.lit("")), "UTF-8")
    bits = stable_key(F.col(key))
    rows = docs.select(
        F.col(key),
        (F.octet_length(body) + 1).cast("long").alias("size"),
        F.crc32(body).alias("text_crc32"),
        jump_shard(bits, shards).alias("shard"),
        jump_shard(bits, shards + 1).alias("grown_shard"),
    )
    return numbered(rows, ["shard"], [key, "text_crc32", "size"], "slot")
