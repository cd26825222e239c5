import datetime as dt

import pytest
from pyspark.sql import functions as F

from kadence.functions import scalars as S
from kadence.functions.geodesy import linear_distance
from kadence.rules import Rules

RULES = Rules()


def value(spark, column):
    return spark.range(1).select(column.alias("v")).first()["v"]


@pytest.mark.parametrize(
    ("text", "mode"),
    [
        ("Marche/running", "walk"),
        ("RUNNING", "walk"),
        ("Vélo/Trottinette/Autres", "drive"),
        ("trottinette", "drive"),
        ("vélo puis marche", "walk"),
        ("véhicule thermique/électrique", None),
        ("Transports en commun", None),
        (None, None),
    ],
)
def test_commute_mode(spark, text, mode):
    assert value(spark, S.commute_mode(F.lit(text).cast("string"))) == mode


@pytest.mark.parametrize(
    ("mode", "metres", "eligible"),
    [
        ("walk", 15000.0, True),
        ("walk", 15000.1, False),
        ("drive", 25000.0, True),
        ("drive", 25001.0, False),
        ("walk", None, False),
        (None, 10.0, False),
    ],
)
def test_eligibility_limits_are_inclusive(spark, mode, metres, eligible):
    column = S.is_bonus_eligible(
        F.lit(mode).cast("string"), F.lit(metres).cast("double"), RULES
    )
    assert value(spark, column) is eligible


@pytest.mark.parametrize(
    ("seconds", "text"),
    [
        (None, "0min"), (-5, "0min"), (0, "0min"), (29, "0min"), (30, "0min"), (90, "2min"),
        (150, "2min"), (3600, "1h"), (3690, "1h2min"), (5400, "1h30min"), (7200, "2h"),
    ],
)
def test_format_duration_rounds_half_to_even(spark, seconds, text):
    assert value(spark, S.format_duration(F.lit(seconds).cast("bigint"))) == text


@pytest.mark.parametrize(
    ("metres", "km"), [(0, None), (None, None), (1250, 1.2), (1350, 1.4), (49, 0.0), (10000, 10.0)]
)
def test_distance_km(spark, metres, km):
    assert value(spark, S.distance_km(F.lit(metres).cast("bigint"))) == km


@pytest.mark.parametrize(("year", "days"), [(1900, 365), (2000, 366), (2023, 365), (2024, 366)])
def test_days_in_year(spark, year, days):
    assert value(spark, S.days_in_year(F.lit(year))) == days


@pytest.mark.parametrize(
    ("income", "ratio", "flag", "bonus"),
    [
        (None, 100.0, True, None),
        (30000, 80.0, True, 0.0),
        (30000, 80.01, True, 1500.0),
        (30000, 100.0, False, 0.0),
        (30001, 100.0, True, 1500.05),
        (30000, None, True, 0.0),
    ],
)
def test_bonus_amount(spark, income, ratio, flag, bonus):
    column = S.bonus_amount(
        F.lit(income).cast("int"), F.lit(ratio).cast("double"), F.lit(flag), RULES
    )
    assert value(spark, column) == bonus


def test_open_year_counts_every_day(spark):
    start = F.lit("2026-01-01 00:00:00").cast("timestamp")
    assert value(spark, S.days_between(start, S.end_of_year(2026))) == 365.0


def test_whole_days_are_complete_days(spark):
    def days(start, end):
        return value(
            spark, S.whole_days(F.lit(start).cast("timestamp"), F.lit(end).cast("timestamp"))
        )

    assert days("2024-01-01 23:00:00", "2024-01-02 00:00:00") == 0
    assert days("2024-01-01 23:00:00", "2024-01-02 23:00:00") == 1
    assert days("2024-01-01 23:00:00", None) is None


@pytest.mark.parametrize(
    ("text", "date"),
    [
        ("6/7/1990", dt.date(1990, 7, 6)),
        ("14/12/2020", dt.date(2020, 12, 14)),
        ("31/2/2020", None),
        ("x", None),
        (None, None),
    ],
)
def test_text_date(spark, text, date):
    assert value(spark, S.text_date(F.lit(text).cast("string"))) == date


def test_picks_are_repeatable_and_within_bounds(spark):
    options = F.array(*(F.lit(x) for x in "abc"))
    picked = spark.range(60).select(
        S.pick_variant(options, F.col("id"), 7).alias("one"),
        S.pick_some(options, F.col("id"), 13).alias("some"),
    )
    found = picked.collect()
    assert {r["one"] for r in found} == set("abc")
    for r in found:
        parts = r["some"].split(" ")
        assert 1 <= len(parts) <= 2
        assert len(set(parts)) == len(parts)


def test_comment_suffix(spark):
    assert value(spark, S.comment_suffix(F.lit("Top"))) == ' ("Top")'
    assert value(spark, S.comment_suffix(F.lit(""))) == ""


@pytest.mark.parametrize(
    ("points", "metres"),
    [
        ((48.8566, 2.3522, 51.5074, -0.1278), 343923.12),  # Paris, London
        ((0.0, 0.0, 0.0, 1.0), 111319.491),  # a degree on the equator
        ((0.0, 0.0, 1.0, 0.0), 110574.389),  # a degree on a meridian
        ((43.57, 3.9, 43.57, 3.9), 0.0),
        ((0.0, 0.0, 0.5, 179.5), 19936288.579),  # nearly antipodal
        ((0.0, 0.0, 0.5, 179.7), 19944127.421),
        ((0.0, 0.0, 0.0, 180.0), 20003931.459),  # over a pole
        ((0.0, -170.0, 0.0, 170.0), 2226389.816),  # over the date line
    ],
)
def test_geodesic(spark, points, metres):
    got = value(spark, linear_distance(*(F.lit(p) for p in points)))
    assert got == pytest.approx(metres, abs=1e-2)


@pytest.mark.parametrize("method", ["haversine", "wgs84"])
def test_distance_needs_all_coordinates(spark, method):
    missing = F.lit(None).cast("double")
    column = linear_distance(missing, F.lit(1.0), F.lit(2.0), F.lit(3.0), method)
    assert value(spark, column) is None
