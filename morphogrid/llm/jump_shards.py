"""Sharding by jump consistent hashing, in DataFrame functions only.

The 64-bit linear congruential generator of the published algorithm runs on two 32-bit halves, so that no product leaves the range
of a long. A key's shard is its last jump below the number of shards; one more shard takes keys only into itself.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import durable

#: The generator's multiplier 2862933555777941757 as high and low 32 bits.
HIGH, LOW = 2862933555777941757 >> 32, 2862933555777941757 & 0xFFFFFFFF
MASK = 0xFFFFFFFF


def _step(high: Column, low: Column) -> tuple[Column, Column]:
    """The halves of (high:low) * 2862933555777941757 + 1 modulo 2^64."""
    times = lambda x, m: (x * (m & 0xFFFF), x * (m >> 16))  # noqa: E731  each below 2^48
    a, b = times(low, LOW)
    c, d = times(high, LOW)
    e, f = times(low, HIGH)
    lower = a + F.shiftleft(b.bitwiseAND(0xFFFF), 16) + F.lit(1)
    carry = F.shiftright(lower, 32) + F.shiftright(b, 16)
    upper = carry + c.bitwiseAND(MASK) + F.shiftleft(d.bitwiseAND(0xFFFF), 16) + e.bitwiseAND(MASK) + F.shiftleft(f.bitwiseAND(0xFFFF), 16)
    return upper.bitwiseAND(MASK), lower.bitwiseAND(MASK)


def jump(key: Column, shards: int) -> tuple[Column, Column]:
    """Shards of a long `key` among `shards`, and among one more."""

    def hop(state: Column, _: Column) -> Column:
        high, low = _step(state["high"], state["low"])
        new = F.floor((state["next"] + 1) * (F.lit(float(1 << 31)) / (F.shiftright(high, 1) + 1))).cast("long")
        going = state["next"] < F.lit(shards + 1)
        return F.struct(
            F.when(going, high).otherwise(state["high"]).alias("high"), F.when(going, low).otherwise(state["low"]).alias("low"),
            F.when(state["next"] < F.lit(shards), state["next"]).otherwise(state["at"]).alias("at"),
            F.when(state["next"] < F.lit(shards + 1), state["next"]).otherwise(state["grown"]).alias("grown"),
            F.when(going, new).otherwise(state["next"]).alias("next"),
        )

    zero = F.lit(0).cast("long")
    seed = F.struct(F.shiftrightunsigned(key, 32).alias("high"), key.bitwiseAND(MASK).alias("low"), zero.alias("at"), zero.alias("grown"), zero.alias("next"))
    last = F.aggregate(F.sequence(F.lit(1), F.lit(shards + 2)), seed, hop)
    return last["at"].cast("int"), last["grown"].cast("int")


def shard(docs: DataFrame, shards: int = 24, id_col: str = "doc_id", text_col: str = "text", extra_bytes: int = 8, buckets: int = 1024, most: int = 65_536) -> DataFrame:
    """One row for each row of `docs`: doc_id, size, text_crc32, law ('key'), shard, slot, grown_shard.

    size: UTF-8 bytes of the text (null: none) plus `extra_bytes`; text_crc32 of a null text is that of an empty one. doc_id and the
    number of shards decide the shard; a null id goes where id -1 goes. Slots run from 0 without a gap in each shard, and the rows'
    contents alone decide them. Rows alike in doc_id, size and crc are counted before any shuffle, and a shard is numbered in `buckets`
    parts, whose sizes are summed first, so no task orders a whole shard; more than `most` like rows are dealt to several tasks.
    Repeated rows get slots of their own.
    """
    text = F.coalesce(F.col(text_col), F.lit("")).cast("binary")
    small = docs.select(F.col(id_col).alias("doc_id"), (F.octet_length(text) + extra_bytes).cast("long").alias("size"), F.crc32(text).alias("text_crc32"))
    alike = small.groupBy("doc_id", "size", "text_crc32").agg(F.count("*").alias("rows"))
    at, grown = jump(F.coalesce(F.col("doc_id").cast("long"), F.lit(-1).cast("long")), shards)
    alike = alike.withColumn("both", F.struct(at.alias("shard"), grown.alias("grown_shard"))).select("*", "both.*").drop("both")
    alike = durable(alike.withColumn("part", F.pmod(F.xxhash64("doc_id", "size", "text_crc32"), F.lit(buckets)).cast("int")))
    sizes = alike.groupBy("shard", "part").agg(F.sum("rows").alias("rows"))  # at most shards x buckets rows
    before = lambda w: F.coalesce(F.sum("rows").over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    starts = sizes.select("shard", "part", before(Window.partitionBy("shard").orderBy("part")).alias("start"))
    own = Window.partitionBy("shard", "part").orderBy("doc_id", "size", "text_crc32")
    placed = alike.withColumn("place", before(own)).join(F.broadcast(starts), ["shard", "part"]).withColumn("slot", F.col("start") + F.col("place"))
    few = placed.where(F.col("rows") <= most).withColumn("copy", F.explode(F.sequence(F.lit(0).cast("long"), F.col("rows") - 1)))
    many = placed.where(F.col("rows") > most).withColumn("lot", F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col("rows") - 1) / most)))).repartition("doc_id", "text_crc32", "lot")
    many = many.withColumn("copy", F.explode(F.sequence(F.col("lot") * most, F.least(F.col("rows"), (F.col("lot") + 1) * most) - 1))).drop("lot")
    numbered = few.union(many.select(*few.columns))
    return numbered.select("doc_id", "size", "text_crc32", F.lit("key").alias("law"), "shard", (F.col("slot") + F.col("copy")).cast("long").alias("slot"), "grown_shard")
