import datetime as dt
import json

from conftest import rows

from kadence.operators import constraints as K
from kadence.operators import quality as Q
from kadence.operators import registry as R
from pyspark.sql import functions as F


def frame(spark):
    return spark.createDataFrame(
        [(1, "a", 5.0), (1, "a", -1.0), (2, None, 0.0), (None, None, None), (3, "z", 200.0)],
        "k int, v string, x double",
    )


def suite():
    return [
        Q.not_null("v"),
        Q.in_set("v", ["a", "b"]),
        Q.between("x", 0, 100),
        Q.null_or_positive("x"),
        Q.compound_unique(["k", "v"]),
        Q.of_type("x", "double"),
        Q.of_type("x", "int"),
    ]


def test_validate_counts_evaluated_and_unexpected(spark):
    got = {
        (r["expectation"], r["column_name"], i): (r["evaluated"], r["unexpected"], r["success"])
        for i, r in enumerate(sorted(Q.validate(frame(spark), suite()).collect(), key=repr))
    }
    assert sorted((k[0], v) for k, v in got.items()) == sorted(
        [
            ("not_null", (5, 2, False)),
            ("in_set", (3, 1, False)),
            ("between", (4, 2, False)),
            ("null_or_positive", (4, 2, False)),
            ("compound_unique", (4, 2, False)),
            ("of_type", (5, 0, True)),
            ("of_type", (5, 5, False)),
        ]
    )


def test_validate_an_empty_frame(spark):
    got = Q.validate(frame(spark).limit(0), suite()).collect()
    assert all(r["success"] and r["evaluated"] == 0 for r in got)


def test_failed_rows_carry_the_row(spark):
    checks = [Q.not_null("v"), Q.compound_unique(["k", "v"])]
    got = Q.failed_rows(frame(spark), checks, "b", "d").collect()
    assert sorted((r["expectation"], json.loads(r["row_json"])["x"] or 0) for r in got) == [
        ("compound_unique", -1.0),
        ("compound_unique", 5.0),
        ("not_null", 0),
        ("not_null", 0.0),
    ]
    assert {(r["batch_id"], r["dataset"]) for r in got} == {("b", "d")}


def test_gate_splits_every_row_once(spark):
    passing, failing = Q.quality_gate(frame(spark), suite()[:4])
    assert rows(passing) == [(1, "a", 5.0)]
    assert passing.count() + failing.count() == 5


def test_shipped_suites_cover_every_layer(spark):
    suites = Q.shipped_suites()
    assert set(suites) == {
        "silver_new", "registry_insert", "registry_delete", "incoherences",
        "notification_errors", "silver_before_fill", "silver_after_fill", "gold_bonus",
    }
    strict = Q.shipped_suites(open_rows_allowed=False)["silver_before_fill"]
    assert len(strict) == len(suites["silver_before_fill"]) + 1


def test_activity_checks(spark):
    at = dt.datetime(2026, 1, 1)
    later = dt.datetime(2026, 1, 2)
    df = spark.createDataFrame(
        [
            (1, 1, at, later, "s", None),
            (2, 1, at, at, "s", 0),
            (3, 1, later, at, "s", -1),
            (4, None, at, later, None, 5),
        ],
        "id int, salarie_id int, date_debut_activite timestamp, date_fin_activite timestamp, "
        "sport_type string, distance_m int",
    )
    good, bad = K.enforce_checks(df)
    assert rows(good, "id") == [(1,)]
    assert dict(rows(bad, "id", "violations")) == {
        2: ["end before start"],
        3: ["end before start", "negative distance"],
        4: ["salarie_id is null", "sport_type is null"],
    }


def test_employee_dates_have_a_default(spark):
    df = spark.createDataFrame(
        [(1, "6/7/1990", None), (2, "x", "14/12/2020")],
        "k int, ddn_as_text string, date_embauche_as_text string",
    )
    got = K.normalise_employee(df)
    assert got.columns == ["k", "ddn", "date_embauche"]
    default = dt.date(2000, 1, 1)
    assert rows(got) == [
        (1, dt.date(1990, 7, 6), default),
        (2, default, dt.date(2020, 12, 14)),
    ]


def test_registry_insert_twice_changes_nothing(spark):
    at = F.lit("2026-01-01").cast("timestamp")
    empty = spark.createDataFrame(
        [], "id_salarie int, created_at timestamp, deleted_at timestamp"
    )
    ids = spark.createDataFrame([(1,), (2,), (2,)], "id_salarie int")
    once = R.registry_insert(empty, ids, at)
    twice = R.registry_insert(once, ids, F.lit("2027-01-01").cast("timestamp"))
    assert once.count() == 2
    assert rows(once) == rows(twice)
    gone = spark.createDataFrame(
        [(2, dt.datetime(2026, 5, 1)), (9, dt.datetime(2026, 5, 1))],
        "id_salarie int, deleted_at timestamp",
    )
    left = R.registry_soft_delete(twice, gone)
    assert rows(left, "id_salarie", "deleted_at") == [(1, None), (2, dt.datetime(2026, 5, 1))]
