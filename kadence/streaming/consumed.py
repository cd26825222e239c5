"""Which messages a job has taken: consumed offsets of each topic partition, as intervals.

The set grows with the gaps between offsets (and by one for every million of them), not with the messages, so it is
kept for good and a message that comes again after any time is known.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from kadence.sinks.kept import KeptTable

CONSUMED = T.StructType(
    [
        T.StructField("topic", T.StringType()),
        T.StructField("partition", T.IntegerType()),
        T.StructField("first", T.LongType()),
        T.StructField("last", T.LongType()),
    ]
)
SOURCE = ["topic", "partition"]
#: Offsets whose order is settled in one task, as a power of two.
BLOCK_BITS = 20


#: Buckets of the kept intervals; a batch replaces those of the blocks it has offsets in.
BUCKETS = 32


def _block(offset: str) -> Column:
    return F.shiftright(offset, BLOCK_BITS)


def consumed_table(root: str) -> KeptTable:
    """Intervals within blocks of offsets, in buckets by block, so that a large partition is in many."""
    dealt = F.pmod(F.xxhash64(*SOURCE, _block("first")), F.lit(BUCKETS).cast("bigint")).cast("int")
    return KeptTable(f"{root}/consumed_blocks", CONSUMED, dealt)


def positions(messages: DataFrame) -> DataFrame:
    """Where messages stand, as intervals of one offset; those without a position are left out."""
    placed = messages.where(F.col("offset").isNotNull())
    return placed.select(*SOURCE, F.col("offset").alias("first"), F.col("offset").alias("last"))


def _by_block(intervals: DataFrame) -> DataFrame:
    """Intervals with their block, cut where one ends."""
    start = F.shiftleft("block", BLOCK_BITS)
    blocks = F.explode(F.sequence(_block("first"), _block("last"))).alias("block")
    return intervals.select(*CONSUMED.fieldNames(), blocks).select(
        *SOURCE, "block", F.greatest("first", start).alias("first"),
        F.least("last", start + F.lit((1 << BLOCK_BITS) - 1)).alias("last"),
    )


def unseen(messages: DataFrame, consumed: DataFrame, placed: DataFrame | None = None) -> DataFrame:
    """Messages whose offset is in no consumed interval of their topic partition.

    Only intervals that meet the offsets of the batch are looked at; in order, as a rule, there is none and
    nothing is shuffled but two numbers per topic partition. Otherwise each position (``placed``, by default
    taken from ``messages``) finds the last interval that starts at or before it, within a block of offsets, so
    that a large partition is many tasks and no interval meets another block's messages. Messages
    without a position are never seen. Runs a job when it is built.
    """
    placed = positions(messages) if placed is None else placed
    reach = placed.groupBy(*SOURCE).agg(F.min("first").alias("low"), F.max("last").alias("high"))
    met = consumed.join(F.broadcast(reach), SOURCE)  # one row per topic partition
    met = met.where((F.col("first") <= F.col("high")) & (F.col("last") >= F.col("low")))
    met = met.select(*CONSUMED.fieldNames()).persist()
    try:
        if met.isEmpty():
            return messages
        asked = placed.select(*SOURCE, _block("first").alias("block"), F.col("first"), F.lit(None).cast("long").alias("last"))
        order = Window.partitionBy(*SOURCE, "block").orderBy("first", F.col("last").isNull())
        reached = F.last("last", ignorenulls=True).over(order.rowsBetween(Window.unboundedPreceding, 0))
        judged = _by_block(met).unionByName(asked).withColumn("reached", reached)
        seen = judged.where(F.col("last").isNull() & (F.col("reached") >= F.col("first")))
        seen = seen.select(*SOURCE, F.col("first").alias("offset"))
        return messages.join(seen, [*SOURCE, "offset"], "left_anti").select(messages.columns)
    finally:
        met.unpersist()


def _runs(df: DataFrame, within: list[str]) -> DataFrame:
    """Intervals joined where they overlap or follow each other, ``within`` equal columns."""
    before = Window.partitionBy(*within).orderBy("first").rowsBetween(Window.unboundedPreceding, -1)
    upto = before.rowsBetween(Window.unboundedPreceding, 0)
    starts = F.coalesce(F.col("first") > F.max("last").over(before) + 1, F.lit(True))
    marked = df.withColumn("starts", starts.cast("int"))
    grouped = marked.withColumn("run", F.sum("starts").over(upto)).groupBy(*within, "run")
    return grouped.agg(F.min("first").alias("first"), F.max("last").alias("last")).drop("run")


def in_blocks(consumed: DataFrame, placed: DataFrame) -> DataFrame:
    """``consumed`` with positions, as it is kept: joined within a block, each in a task of its own."""
    both = _by_block(consumed.unionByName(placed))
    return _runs(both, [*SOURCE, "block"]).select(*CONSUMED.fieldNames())


def whole(pieces: DataFrame) -> DataFrame:
    """Intervals within blocks as whole ones. Only those that reach an end of their block meet, two per block at most."""
    mask = F.lit((1 << BLOCK_BITS) - 1)
    edge = (F.col("first").bitwiseAND(mask) == 0) | (F.col("last").bitwiseAND(mask) == mask)
    return pieces.where(~edge).unionByName(_runs(pieces.where(edge), SOURCE).select(*CONSUMED.fieldNames()))


def with_offsets(consumed: DataFrame, messages: DataFrame) -> DataFrame:
    """``consumed`` with the offsets of ``messages``, as whole intervals."""
    return whole(in_blocks(consumed, positions(messages)))


def consumed_offsets(spark: SparkSession, root: str) -> DataFrame:
    """What the job under ``root`` has taken so far."""
    return whole(consumed_table(root).rows(spark))
