"""Kept tables, compaction and consumed offsets: by themselves, and what a batch reads through them."""

import random

import pytest
from conftest import rows
from pyspark.sql import functions as F
from pyspark.sql import types as T

from kadence.sinks.compaction import compact, planned
from kadence.sinks.kept import KeptTable, bucket_of
from kadence.sinks.tables import Unit, append_batch, read_batches, units
from kadence.streaming.consumed import CONSUMED, consumed_table, unseen, with_offsets

KEYED = T.StructType([T.StructField("k", T.LongType()), T.StructField("v", T.LongType())])
ONE = T.StructType([T.StructField("v", T.LongType())])


def by_repr(data):
    return sorted(data, key=repr)


def frame(spark, data):
    return spark.createDataFrame(data, KEYED)


def test_a_batch_rewrites_only_its_buckets(spark, tmp_path):
    table = KeptTable(str(tmp_path), KEYED, bucket_of("k", 10, 100))
    table.replace(frame(spark, [(1, 0), (11, 0), (21, 0)]), [0, 1, 2], 0)
    table.replace(frame(spark, [(11, 5), (12, 5)]), [1], 1)
    assert rows(table.rows(spark)) == [(1, 0), (11, 5), (12, 5), (21, 0)]
    assert sorted(p.name for p in (tmp_path / "epoch=1").glob("bucket=*")) == ["bucket=1"]
    # As of the state before, and by bucket.
    assert rows(table.rows(spark, before=1)) == [(1, 0), (11, 0), (21, 0)]
    assert rows(table.rows(spark, [1, 7])) == [(11, 5), (12, 5)]


def test_a_replayed_epoch_replaces_itself_and_one_taken_back_is_gone(spark, tmp_path):
    table = KeptTable(str(tmp_path), KEYED, bucket_of("k", 10, 100))
    table.replace(frame(spark, [(1, 0), (11, 0)]), [0, 1], 0)
    table.replace(frame(spark, [(1, 1)]), [0], 1, note="first")
    table.replace(frame(spark, [(11, 2)]), [1], 1, note="again")
    assert rows(table.rows(spark)) == [(1, 0), (11, 2)]
    assert table.state(spark)[1]["note"] == "again"
    table.take_back(spark, 1)
    assert rows(table.rows(spark)) == [(1, 0), (11, 0)]
    # A touched bucket without rows becomes empty, and so may the table.
    table.replace(frame(spark, []), [0, 1], 2)
    assert table.rows(spark).isEmpty()


def test_kept_files_do_not_pile_up(spark, tmp_path):
    table = KeptTable(str(tmp_path), KEYED, bucket_of("k", 10, 100))
    for epoch in range(6):
        table.replace(frame(spark, [(1, epoch), (11, epoch)]), [0, 1], epoch)
    assert len(list(tmp_path.glob("epoch=*/bucket=*"))) == 4
    assert len(list((tmp_path / "_index").glob("[0-9]*.json"))) == 2
    assert rows(table.rows(spark)) == [(1, 5), (11, 5)]


@pytest.mark.parametrize("key,bucket", [(None, 0), (-1, 0), (-10, 99), (0, 0), (9, 0), (10, 1), (1000, 0), (2**62, 2**62 // 10 % 100)])
def test_buckets(spark, key, bucket):
    assert spark.createDataFrame([(key, 0)], KEYED).select(bucket_of("k", 10, 100)).first()[0] == bucket


def test_merges_cascade():
    closed = [Unit(i, i, 0, "") for i in range(8)]
    assert planned(closed[:1], 2) == []
    assert [(level, len(made)) for level, made in planned(closed[:7], 2)] == [(2, 4), (1, 2)]
    assert [(level, len(made)) for level, made in planned(closed, 2)] == [(3, 8)]
    assert planned([Unit(0, 7, 1, ""), Unit(8, 8, 0, "")], 2) == []


def test_compaction_bounds_folders_and_loses_nothing(spark, tmp_path):
    path, most = str(tmp_path), 0
    for epoch in range(20):
        append_batch(spark.createDataFrame([(epoch,)], ONE), path, epoch)
        compact(spark, path, epoch, fan=3)
        most = max(most, len(units(spark, path)))
        assert rows(read_batches(spark, path, ONE)) == by_repr((i,) for i in range(epoch + 1))
    # Two units of each of three levels, and the running epoch.
    assert most <= 7
    # The newest epoch still replaces itself.
    append_batch(spark.createDataFrame([(99,)], ONE), path, 19)
    assert rows(read_batches(spark, path, ONE)) == by_repr([*((i,) for i in range(19)), (99,)])
    # Epochs from one on do not read folders that lie wholly before it.
    late = read_batches(spark, path, ONE, 18)
    assert rows(late) == [(18,), (99,)]
    assert len(late.inputFiles()) <= 4
    kept = read_batches(spark, path, ONE, 0, keep_epoch=True).where("v < 99")
    assert kept.where("v != epoch_id").isEmpty()


def test_readers_and_failed_runs_do_not_disturb_compaction(spark, tmp_path):
    path = str(tmp_path)
    for epoch in range(4):
        append_batch(spark.createDataFrame([(epoch,)], ONE), path, epoch)
    listed = read_batches(spark, path, ONE)
    # A span that never was completed does not count.
    spark.createDataFrame([(-1, 0)], "v bigint, epoch_id bigint").write.parquet(f"{path}/_spans/1-0-2")
    (tmp_path / "_spans" / "1-0-2" / "_SUCCESS").unlink()
    assert rows(read_batches(spark, path, ONE)) == [(0,), (1,), (2,), (3,)]
    assert compact(spark, path, 3, fan=3) == 1
    # Whoever planned before still finds the files; the next run removes them.
    assert rows(listed) == [(0,), (1,), (2,), (3,)]
    assert len(units(spark, path, covered=True)) == 3
    compact(spark, path, 3, fan=3)
    assert not (tmp_path / "epoch_id=0").exists()
    assert rows(read_batches(spark, path, ONE)) == [(0,), (1,), (2,), (3,)]


MESSAGES = "value string, topic string, partition int, offset bigint"


def test_offsets_as_intervals_against_sets(spark):
    chance = random.Random(5)
    consumed, seen = spark.createDataFrame([], CONSUMED), set()
    for _ in range(6):
        # Far apart, so that blocks differ too.
        lot = [("v", t, p, chance.randrange(40) + chance.choice((0, 1 << 20, 5 << 20))) for t in "ab" for p in (0, 1) for _ in range(15)]
        batch = spark.createDataFrame(lot, MESSAGES)
        want = by_repr(m for m in lot if m[1:] not in seen)
        assert rows(unseen(batch, consumed)) == want
        consumed = spark.createDataFrame(with_offsets(consumed, batch).collect(), CONSUMED)
        seen |= {m[1:] for m in lot}
        held = sorted((t, p, o) for t, p, a, b in consumed.collect() for o in range(a, b + 1))
        assert held == sorted(seen)


def test_the_set_grows_with_gaps_and_not_with_messages(spark):
    many = spark.range(3_000_000).select(F.lit("v").alias("value"), F.lit("t").alias("topic"), F.lit(0).alias("partition"), F.col("id").alias("offset"))
    once = with_offsets(spark.createDataFrame([], CONSUMED), many.where("offset != 7 and offset != 2000000"))
    assert sorted(rows(once)) == [("t", 0, 0, 6), ("t", 0, 8, 1_999_999), ("t", 0, 2_000_001, 2_999_999)]
    left = unseen(many, spark.createDataFrame(once.collect(), CONSUMED))
    assert sorted(rows(left, "offset")) == [(7,), (2_000_000,)]


def test_no_interval_meets_messages_of_another_block(spark):
    """Every other offset of 64 blocks is taken: messages find theirs by block, and each block is a bucket's."""
    taken = spark.range(64 * 16).select(
        F.lit("t").alias("topic"), F.lit(0).alias("partition"),
        (F.floor(F.col("id") / 16) * (1 << 20) + F.col("id") % 16 * 2).alias("first"),
    ).withColumn("last", F.col("first"))
    batch = taken.select(F.lit("v").alias("value"), "topic", "partition", (F.col("first") + F.col("first") % 4 / 2).cast("long").alias("offset"))
    left = unseen(batch, taken)
    assert left.where("offset % 2 = 0").isEmpty() and left.count() == 64 * 8
    # A join of intervals and blocks by partition would let each meet every other.
    plan = left._jdf.queryExecution().optimizedPlan().toString()
    assert "LeftAnti" in plan and plan.count("Join Inner") == 1
    assert len(consumed_table("/nowhere").touched(taken)) > 16


def test_messages_without_a_position_are_never_seen(spark):
    batch = spark.createDataFrame([("v", "t", 0, None), ("v", None, 0, 1), ("v", "t", 0, 1)], MESSAGES)
    consumed = spark.createDataFrame([("t", 0, 0, 5)], CONSUMED)
    assert unseen(batch, consumed).count() == 2
    assert rows(with_offsets(consumed, batch.where("topic = 't'"))) == [("t", 0, 0, 5)]
    assert rows(unseen(batch.limit(0), consumed)) == []
