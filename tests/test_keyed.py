"""Keyed state, keys across batches and mergeable durations."""

import random

import pytest
from conftest import rows
from pyspark.sql import functions as F
from pyspark.sql import types as T

from kadence.operators.history import scd2_intervals
from kadence.sinks.kept import bucket_of
from kadence.streaming.keyed import interval_revisions, intervals_of
from kadence.streaming.monitor import hourly_sketches, merged_quantiles
from kadence.streaming.state import ORDER, STATE_LOG
from kadence.streaming.unique import SeenKeys


@pytest.mark.parametrize("shuffled", [False, True])
def test_state_of_lots_equals_the_intervals_of_the_log(spark, tmp_path, shuffled):
    """Lots in order or not, with copies of rows, over a restart between them."""
    chance, log, offset = random.Random(7), [], 0
    for k in range(12):
        for step in range(chance.randrange(7)):
            kind = "close" if chance.random() < 0.2 else "open"
            day = 86_400_000_000 * (20_000 + 5 * step + k)
            log.append((k, kind == "open" and chance.random() < 0.5 if kind == "open" else None, day, kind, day, "ab"[k % 2], k % 3, offset))
            offset += 1
    frame = spark.createDataFrame(log, "id_salarie bigint, est_eligible_prime_annuel boolean, us bigint, kind string, at_us bigint, topic string, partition int, offset bigint")
    frame = frame.withColumn("valid_from", F.timestamp_micros("us")).select(STATE_LOG.fieldNames())
    lots = sorted(log, key=lambda r: r[4]) if not shuffled else chance.sample(log, len(log))
    places = [lots[: len(lots) // 2], lots[len(lots) // 2 :] + lots[:3]]
    for lot in places:
        ids = spark.createDataFrame([(r[7],) for r in lot], "offset bigint")
        frame.join(ids, "offset").select(STATE_LOG.fieldNames()).coalesce(1).write.mode("append").parquet(f"{tmp_path}/log")
        stream = spark.readStream.schema(STATE_LOG).parquet(f"{tmp_path}/log")
        query = interval_revisions(stream).writeStream.option("checkpointLocation", f"{tmp_path}/c").trigger(availableNow=True)
        query.format("parquet").outputMode("append").start(f"{tmp_path}/out").awaitTermination()
    got = intervals_of(spark.read.parquet(f"{tmp_path}/out"))
    assert rows(got) == rows(scd2_intervals(frame, order=ORDER))


def test_keys_of_earlier_batches_are_reported(spark, tmp_path):
    keys = T.StructType([T.StructField("k", T.LongType()), T.StructField("y", T.IntegerType())])
    seen = SeenKeys(str(tmp_path), keys, bucket_of("k", 10, 100))
    frame = lambda data: spark.createDataFrame(data, "k bigint, y int, v string")
    lots = [[(1, 1, "a"), (11, 1, "b"), (2, None, "c"), (None, None, "d")], [(1, 2, "e"), (2, None, "f"), (None, None, "g")], [(1, 1, "h"), (1, 2, "i"), (12, 1, "j")]]
    want = [[], [(2, None, "f", 0)], [(1, 1, "h", 0), (1, 2, "i", 1)]]
    for epoch, lot in enumerate(lots):
        for _ in range(2):  # a replay reports and adds the same
            assert rows(seen.repeated(frame(lot), epoch)) == want[epoch]
            seen.remember(frame(lot), epoch)
    assert seen.rows(spark).count() == 5
    # The last lot has nothing to do with bucket 20.
    seen.remember(frame([(205, 1, "k")]), 3)
    assert sorted(seen.table.state(spark)[1]["buckets"].items()) == [(0, 2), (1, 2), (20, 3)]


def test_quantiles_of_merged_hours(spark):
    chance = random.Random(3)
    values = [("a" if chance.random() < 0.7 else "b", chance.randrange(40), chance.expovariate(0.01)) for _ in range(20_000)]
    events = spark.createDataFrame(values, "query string, h int, ms double").withColumn("at", F.timestamp_seconds(F.col("h") * 3600 + 5))
    hours = hourly_sketches(events, ["query"], F.col("at"), "ms")
    assert hours.count() == 80
    shares = [0.1, 0.5, 0.95]
    for name, n, quantiles in (tuple(r) for r in merged_quantiles(hours, ["query"], shares).collect()):
        mine = sorted(v for q, _, v in values if q == name)
        assert n == len(mine)
        for share, found in zip(shares, quantiles):
            rank = sum(v <= found for v in mine) / len(mine)
            assert abs(rank - share) < 0.02


def test_employees_of_a_bucket_share_the_calls_of_the_store():
    import pandas as pd

    from kadence.streaming.keyed import History

    class Kept:
        def __init__(self):
            self.value, self.values, self.calls = None, [], 0

        def getValueState(self, *_):  # noqa: N802
            return self

        getListState = getValueState  # noqa: N815

        def exists(self):
            return self.value is not None

        def get(self):
            self.calls += 1
            return self.value if self.value is not None else iter(self.values)

        def update(self, value):
            self.calls, self.value = self.calls + 1, value

        def appendValue(self, value):  # noqa: N802
            self.calls += 1
            self.values.append(value)

    history, newest, listed = History(), Kept(), Kept()
    history.newest, history.rows = newest, listed

    def lot(ids, day):
        names = ["bucket", "id_salarie", "at_us", "topic", "partition", "offset", "valid_us", "flag", "opens"]
        return pd.DataFrame([(0, i, day, "t", 0, 1000 * day + i, day, i % 2 == 0, True) for i in ids], columns=names)

    def sent(*parts):
        found = pd.concat([*history.handleInputRows((0,), iter(parts), None)])
        return sorted((r.id_salarie, r.debut_us, None if pd.isna(r.fin_us) else r.fin_us, r.revision) for r in found.itertuples())

    assert sent(lot(range(200), 5), lot(range(200, 300), 5)) == [(i, 5, None, 0) for i in range(300)]
    assert sent(lot(range(300), 8)) == sorted(
        [(i, 5, 8, 1) for i in range(300)] + [(i, 8, None, 1) for i in range(300)], key=lambda r: (r[0], r[1])
    )
    assert newest.calls == 3 and listed.calls == 2
    # One row comes late, one again, and one is in time: only the first has its employee's rows read and sent anew.
    assert sent(pd.concat([lot([7], 6), lot([9], 5), lot([11], 9)])) == [
        (7, 5, 6, 2), (7, 6, 8, 2), (7, 8, None, 2), (11, 8, 9, 2), (11, 9, None, 2),
    ]
    assert list(history.handleInputRows((0,), iter([lot(range(300), 5)]), None)) == []
