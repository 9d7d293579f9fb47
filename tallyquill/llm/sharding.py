"""Sharding by jump consistent hashing.

A stable key and the number of shards decide the shard; no table of the ring is kept. With one
more shard, the rows that move all move into the new one, and they are the expected share.

The hash walks from bucket to bucket with the published generator ``x -> a x + 1`` modulo 2^64.
Spark's longs raise an error on overflow, so the product is put together from 16-bit and 32-bit parts.

Slots number the rows of a shard from 0 without gaps. They follow the order of a digest of the
id, cut into blocks: counts of the blocks give each block's first slot, and only the rows
of one block are numbered together, so that a shard of any size is dealt over many tasks. Equal
rows are counted before the shuffle.

Defined results. A null id is a key of its own. A null text has no bytes: size 1, checksum 0.
Rows with the same id share a shard; ties in the order are broken by size and checksum. Equal
rows get different slots. An empty table gives an empty result. Columns besides id and text are
not looked at, and texts of any length are only measured.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tallyquill.llm.exprs import digest_bits, let

#: Fixed value: the multiplier of the generator.
MULTIPLIER = 2862933555777941757
#: Hexadecimal digits of the digest that name a block: 4,096 blocks in each shard.
BLOCK_DIGITS = 3
KEY_DIGITS = 15
FIRST_STEPS = 40


def _next(high: Column, low: Column) -> tuple[Column, Column]:
    """Upper and lower 32 bits of ``MULTIPLIER * x + 1`` modulo 2^64, for x in two parts."""
    mask = F.lit((1 << 32) - 1)
    c_high, c_low = MULTIPLIER >> 32, MULTIPLIER & ((1 << 32) - 1)

    def by_low(x: Column) -> tuple[Column, Column]:
        """x * c_low for 32-bit x, as a sum of ``part << 16`` and ``rest``, both below 2^49."""
        return F.shiftright(x, 16) * c_low, x.bitwiseAND(F.lit(0xFFFF)) * c_low

    part, rest = by_low(low)
    lower = rest + F.shiftleft(part.bitwiseAND(F.lit(0xFFFF)), 16) + 1
    h_part, h_rest = by_low(high)
    upper = (
        F.shiftright(lower, 32)
        + F.shiftright(part, 16)
        + (low * c_high).bitwiseAND(mask)
        + F.shiftleft(h_part.bitwiseAND(F.lit(0xFFFF)), 16)
        + h_rest
    )
    return upper.bitwiseAND(mask), lower.bitwiseAND(mask)


def jump(key: Column, shards: int) -> Column:
    """The shard of a non-negative long key, an int from 0 to ``shards`` - 1."""
    if shards < 1:
        raise ValueError("at least one shard is needed")

    def step(state: Column, _: Column) -> Column:
        def walked(drawn: Column) -> Column:
            # (j + 1) * 2^31 / ((x >> 33) + 1), cut to an integer
            far = ((state["next"] + 1) * float(1 << 31)) / (F.shiftright(drawn["high"], 1) + 1).cast("double")
            return F.struct(
                state["next"].alias("shard"),
                F.floor(far).cast("long").alias("next"),
                drawn["high"].alias("high"),
                drawn["low"].alias("low"),
            )

        high, low = _next(state["high"], state["low"])
        drawn = F.struct(high.alias("high"), low.alias("low"))
        return F.when(state["next"] < shards, let(drawn, walked)).otherwise(state)

    start = F.struct(
        F.lit(0).cast("long").alias("shard"),
        F.lit(0).cast("long").alias("next"),
        F.shiftright(key, 32).alias("high"),
        key.bitwiseAND(F.lit((1 << 32) - 1)).alias("low"),
    )
    # Each step moves to a higher shard, so there are as many steps as shards at most; a walk has
    # about log(shards) of them, and only one that is not done after FIRST_STEPS goes on.
    walk = lambda state, steps: F.aggregate(F.sequence(F.lit(1), F.lit(steps)), state, step)
    ended = walk(start, min(shards, FIRST_STEPS))
    if shards > FIRST_STEPS:
        ended = let(ended, lambda s: F.when(s["next"] >= shards, s).otherwise(walk(s, shards)))
    return ended["shard"].cast("int")


def key_of(id: Column) -> Column:
    return digest_bits(id, KEY_DIGITS)


def place(docs: DataFrame, shards: int, id: str = "doc_id") -> DataFrame:
    """``docs`` with a column ``shard``; an own column of that name is replaced."""
    return docs.withColumn("shard", jump(key_of(F.col(id)), shards))


def assign(docs: DataFrame, shards: int = 16, id: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per row of ``docs``: id, size, text_crc32, law, shard, slot, grown_shard."""
    bytes_of = F.coalesce(F.col(text), F.lit("")).cast("binary")
    order = F.coalesce(F.md5(F.col(id).cast("string")), F.lit(""))
    block = F.substring(order, 1, BLOCK_DIGITS)
    key = key_of(F.col(id))

    def keyed(*more: Column) -> DataFrame:
        return docs.select(
            F.col(id).alias("id"), order.alias("digest"), block.alias("block"),
            jump(key, shards).alias("shard"), jump(key, shards + 1).alias("grown_shard"), *more,
        )

    blocks = keyed().groupBy("shard", "block").count()
    # At most 4,097 rows in each shard, and 4,097 times the shards in all.
    before = Window.partitionBy("shard").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    firsts = blocks.select(
        F.col("shard").alias("of_shard"),
        F.col("block").alias("of_block"),
        F.coalesce(F.sum("count").over(before), F.lit(0)).alias("first"),
    )
    rows = keyed(
        (F.octet_length(bytes_of) + F.lit(1)).cast("long").alias("size"), F.crc32(bytes_of).alias("text_crc32")
    )
    same = rows.groupBy("shard", "block", "digest", "id", "size", "text_crc32", "grown_shard").agg(
        F.count(F.lit(1)).alias("copies")
    )
    earlier = (
        Window.partitionBy("shard", "block")
        .orderBy("digest", F.col("id").asc_nulls_last(), "size", "text_crc32")
        .rowsBetween(Window.unboundedPreceding, -1)
    )
    slots = (
        same.join(firsts, (F.col("shard") == F.col("of_shard")) & (F.col("block") == F.col("of_block")))
        .withColumn("from", F.col("first") + F.coalesce(F.sum("copies").over(earlier), F.lit(0)))
        .select("*", F.explode(F.sequence(F.col("from"), F.col("from") + F.col("copies") - 1)).alias("slot"))
    )
    return slots.select(
        F.col("id").alias(id), "size", "text_crc32", F.lit("key").alias("law"), "shard", "slot", "grown_shard"
    )
