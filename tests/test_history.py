import datetime as dt
import random

import pytest
from conftest import rows
from pyspark.sql import Window
from pyspark.sql import functions as F

from kadence.operators.history import active_rows, as_of, latest_state, scd2_intervals, state_log
from kadence.operators.skew import _chunked, chunk_cuts, hot_keys, with_neighbours

SCHEMA = (
    "id_salarie int, route string, elig_before boolean, elig_after boolean, ts timestamp, "
    "seq bigint"
)


def day(n):
    return dt.datetime(2026, 1, 1) + dt.timedelta(days=n)


def history(spark, data, **options):
    log = state_log(spark.createDataFrame(data, SCHEMA))
    return scd2_intervals(log, **options)


def test_flips_within_a_batch_close_each_other(spark):
    got = history(
        spark,
        [
            (1, "created", None, True, day(0), 1),
            (1, "updated", True, False, day(5), 2),
            (1, "updated", False, False, day(6), 3),
            (1, "updated", False, True, day(5), 4),
            (1, "deleted", True, None, day(9), 5),
            (2, "created", None, False, day(3), 6),
        ],
    )
    assert rows(got) == [
        (1, False, day(5), day(5), 0),
        (1, True, day(0), day(5), 5),
        (1, True, day(5), day(9), 4),
        (2, False, day(3), None, None),
    ]


def test_fixed_creation_time_and_rehire(spark):
    data = [
        (1, "created", None, True, day(10), 1),
        (1, "deleted", True, None, day(20), 2),
        (1, "created", None, True, day(30), 3),
    ]
    start = F.lit("2026-01-01").cast("timestamp")
    log = state_log(spark.createDataFrame(data, SCHEMA), initial_valid_from=start)
    assert rows(scd2_intervals(log), "date_debut", "date_fin") == [
        (day(0), None),
        (day(0), day(20)),
    ]
    clamped = scd2_intervals(log, clamp=True)
    assert rows(clamped, "date_debut", "date_fin") == [(day(0), day(20)), (day(20), None)]


def test_active_and_as_of(spark):
    got = history(
        spark,
        [(1, "created", None, True, day(0), 1), (1, "updated", True, False, day(5), 2)],
    )
    assert rows(active_rows(got), "date_debut") == [(day(5),)]
    at = as_of(got, F.lit(day(5)))
    assert rows(at, "est_eligible_prime_annuel") == [(False,)]
    assert as_of(got, F.lit(day(-1))).count() == 0


def test_latest_state_drops_deleted_keys(spark):
    df = spark.createDataFrame(
        [(1, 1, "c", ("a",)), (1, 2, "u", ("b",)), (2, 1, "c", ("c",)), (2, 3, "d", None)],
        "k int, seq int, op string, after struct<v: string>",
    )
    assert rows(latest_state(df, "k", "seq")) == [("b",)]


def random_changes(seed):
    rng = random.Random(seed)
    data, seq = [], 0
    for _ in range(600):
        seq += rng.randint(1, 50)
        # A third of all rows belong to one key.
        key = 0 if rng.random() < 0.34 else rng.randint(1, 40)
        route = rng.choice(["created", "updated", "updated", "updated", "deleted"])
        flag = rng.random() < 0.5
        before = None if route == "created" else not flag
        after = None if route == "deleted" else flag
        data.append((key, route, before, after, day(len(data) / 7), seq))
    return data


@pytest.mark.parametrize("seed", range(3))
def test_intervals_of_a_key_never_overlap(spark, seed):
    got = history(spark, random_changes(seed), min_rows=20, chunk_rows=2).collect()
    by_key = {}
    for r in got:
        by_key.setdefault(r["id_salarie"], []).append((r["date_debut"], r["date_fin"]))
    for spans in by_key.values():
        spans.sort(key=lambda s: s[0])
        assert sum(end is None for _, end in spans) <= 1
        for (_, end), (start, _) in zip(spans, spans[1:], strict=False):
            assert end is not None
            assert end <= start


@pytest.mark.parametrize(("min_rows", "chunk_rows"), [(10**6, 10**6), (50, 10), (2, 1)])
def test_chunked_neighbours_equal_a_plain_window(spark, min_rows, chunk_rows):
    data = [(d[0], d[5], d[1]) for d in random_changes(7)]
    df = spark.createDataFrame(data, "k int, seq bigint, v string")
    got = with_neighbours(
        df, ["k"], "seq", ["seq", "v"],
        following="nx", preceding="pv", min_rows=min_rows, chunk_rows=chunk_rows,
    )
    w = Window.partitionBy("k").orderBy("seq")
    row = F.struct("seq", "v")
    want = df.select("*", F.lead(row).over(w).alias("nx"), F.lag(row).over(w).alias("pv"))
    assert rows(got) == rows(want)


@pytest.mark.parametrize("shape", ["far", "near", "small"])
def test_chunks_are_even_however_positions_lie(spark, shape):
    position = {
        "far": F.when(F.col("id") == 0, F.lit(10**15)).otherwise(F.col("id")),
        "near": F.floor(F.col("id") / 50_000) * 10**12 + F.col("id"),
        "small": F.col("id"),
    }[shape]
    # "small": a key just below a thousandth of the table, far above the size of a chunk.
    rows_ = 200_000
    key = F.when(F.col("id") < 190, F.lit(0)).otherwise(F.col("id")) if shape == "small" else F.lit(0)
    df = spark.range(rows_).select(key.alias("k"), position.alias("seq"))
    size = 50 if shape == "small" else 1_000
    cuts = chunk_cuts(df, ["k"], "seq", size, size)
    chunks = _chunked(df, ["k"], "seq", cuts, "inner").groupBy("k", "__chunk").count()
    assert chunks.agg(F.max("count")).first()[0] <= 2 * size
    got = with_neighbours(df, ["k"], "seq", ["seq"], following="nx", min_rows=size, chunk_rows=size)
    hot = 190 if shape == "small" else rows_
    assert got.filter("k = 0").agg(F.count("nx")).first()[0] == hot - 1
    assert got.filter("nx.seq <= seq").isEmpty()


def test_further_columns_decide_between_equal_positions(spark):
    df = spark.range(600).select(F.lit(1).alias("k"), F.floor(F.col("id") / 3).alias("seq"), "id")
    got = with_neighbours(df, ["k"], "seq", ["id"], then=["id"], following="nx", preceding="pv", min_rows=50, chunk_rows=20)
    assert got.filter("nx.id <> id + 1 or pv.id <> id - 1").isEmpty()
    assert got.filter("nx is null or pv is null").count() == 2


def test_hot_key_is_spread_over_many_tasks(spark):
    """The window of a key with most rows runs in chunks, none with more than a small part."""
    df = spark.range(20_000).select(
        F.when(F.col("id") % 3 == 0, F.lit(0)).otherwise(F.col("id")).alias("k"),
        F.col("id").alias("seq"),
    )
    assert rows(hot_keys(df, ["k"], 100), "k") == [(0,)]
    got = with_neighbours(
        df, ["k"], "seq", ["seq"], following="nx", min_rows=100, chunk_rows=10
    )
    assert got.filter("k = 0").agg(F.count("nx")).first()[0] == 6666
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert "__chunk" in plan
