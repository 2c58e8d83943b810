"""Shards by jump consistent hashing, in DataFrame functions alone.

The jump hash walks a fixed random sequence of its key: of n shards it needs no table, and with
one shard more it moves the 1/(n+1) of the keys that go to the new shard, and no others.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from trendlake.llm.common import column
from trendlake.storage import materialize

SHARDS = 16
#: Mean rows that are numbered together, and slots that one row is laid out to at once.
BLOCK_ROWS, RUN, LEAST_BLOCKS = 50_000, 10_000, 8
# Fixed value: the multiplier of the published algorithm's generator.
_MULTIPLIER = 2862933555777941757
_LIMB = 22
_LOW = (1 << _LIMB) - 1


def _step(key: Column) -> Column:
    """key * multiplier + 1 modulo 2^64, in limbs of 22 bits that cannot overflow a long."""
    a = [key.bitwiseAND(F.lit(_LOW)), F.shiftrightunsigned(key, _LIMB).bitwiseAND(F.lit(_LOW)), F.shiftrightunsigned(key, 2 * _LIMB)]
    b = [_MULTIPLIER & _LOW, _MULTIPLIER >> _LIMB & _LOW, _MULTIPLIER >> 2 * _LIMB]
    low = a[0] * F.lit(b[0]) + F.lit(1)
    middle = a[0] * F.lit(b[1]) + a[1] * F.lit(b[0]) + F.shiftrightunsigned(low, _LIMB)
    high = a[0] * F.lit(b[2]) + a[1] * F.lit(b[1]) + a[2] * F.lit(b[0]) + F.shiftrightunsigned(middle, _LIMB)
    out = F.shiftleft(high, 2 * _LIMB)
    out = out.bitwiseOR(F.shiftleft(middle.bitwiseAND(F.lit(_LOW)), _LIMB))
    return out.bitwiseOR(low.bitwiseAND(F.lit(_LOW)))


def jump(key: Column, shards: int) -> Column:
    """The shard (int) of a long key; a null key is hashed as 0."""
    start = F.struct(F.coalesce(key, F.lit(0)).cast("long").alias("k"), F.lit(-1).cast("long").alias("b"), F.lit(0).cast("long").alias("j"))

    def walk(s: Column, _: Column) -> Column:
        following = _step(s["k"])
        jumped = F.floor((s["j"] + 1) * (F.lit(float(1 << 31)) / (F.shiftrightunsigned(following, 33) + 1))).cast("long")
        return F.when(
            s["j"] < shards, F.struct(following.alias("k"), s["j"].alias("b"), jumped.alias("j"))
        ).otherwise(s)

    return F.aggregate(F.sequence(F.lit(1), F.lit(shards)), start, walk, lambda s: s["b"].cast("int"))


def _running(sizes: DataFrame, keys: list[str], block: str, blocks: int) -> DataFrame:
    """``before``: the sum of ``n`` over the lower blocks of the same key, by two levels of blocks."""
    step = max(1, math.isqrt(blocks))
    grouped = sizes.withColumn("__over", F.floor(F.col(block) / step))
    over = grouped.groupBy(*keys, "__over").agg(F.sum("n").alias("__n"))
    earlier = Window.partitionBy(*keys).orderBy("__over").rowsBetween(Window.unboundedPreceding, -1)
    over = over.select(*keys, "__over", F.coalesce(F.sum("__n").over(earlier), F.lit(0)).alias("__start"))
    earlier = Window.partitionBy(*keys, "__over").orderBy(block).rowsBetween(Window.unboundedPreceding, -1)
    within = grouped.withColumn("__within", F.coalesce(F.sum("n").over(earlier), F.lit(0)))
    return within.join(over, [*keys, "__over"]).select(*keys, block, (F.col("__start") + F.col("__within")).alias("before"))


def assign(docs: DataFrame, shards: int = SHARDS, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Shard, slot and grown shard of every row of ``docs``, under the law ``key``.

    The id and the number of shards decide the shard. Slots are gapless from 0 in each shard: rows are
    dealt into blocks by a hash, and within a block follow id, checksum and size, nulls first; rows equal in
    all three take neighbouring slots. A null text has no bytes, so size 1 and checksum 0; a null id is
    hashed as 0. Texts of any length stay where they are read: only groups of equal numbers and their
    counts are shuffled, so an id or text that a third of all rows share is one row until its slots
    are laid out, ``RUN`` at a time. The result depends on the rows alone, not on how they are
    partitioned. Other columns are not read; an empty table gives no rows.
    """
    content = F.coalesce(column(text).cast("string"), F.lit(""))
    rows = docs.select(
        column(key).cast("long").alias("id"),
        (F.octet_length(content).cast("long") + 1).alias("size"),
        F.crc32(content.cast("binary")).alias("crc"),
    )
    same = rows.groupBy("id", "size", "crc").agg(F.count("*").alias("n"))
    same = same.withColumn("shard", jump(F.col("id"), shards)).withColumn("grown", jump(F.col("id"), shards + 1))
    same = materialize(same, "sharded")
    blocks = max(LEAST_BLOCKS, -(-same.count() // (BLOCK_ROWS * shards)))
    same = same.withColumn("block", F.pmod(F.xxhash64("id", "crc", "size"), F.lit(blocks)))

    offsets = _running(same.groupBy("shard", "block").agg(F.sum("n").alias("n")), ["shard"], "block", blocks)
    lower = Window.partitionBy("shard", "block").orderBy("id", "crc", "size").rowsBetween(Window.unboundedPreceding, -1)
    placed = same.withColumn("lower", F.coalesce(F.sum("n").over(lower), F.lit(0))).join(offsets, ["shard", "block"])
    first = F.col("before") + F.col("lower")
    runs = placed.withColumn("run", F.explode(F.sequence(first, first + F.col("n") - 1, F.lit(RUN)))).withColumn("end", first + F.col("n"))
    if same.where(F.col("n") > RUN).limit(1).count():
        runs = runs.repartition(F.xxhash64("shard", "run"))
    slots = F.sequence(F.col("run"), F.least(F.col("run") + RUN, F.col("end")) - 1)
    return runs.select(
        F.col("id").alias(key),
        "size",
        F.col("crc").alias("text_crc32"),
        F.lit("key").alias("law"),
        "shard",
        F.explode(slots).alias("slot"),
        F.col("grown").alias("grown_shard"),
    )
