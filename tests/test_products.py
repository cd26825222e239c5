import datetime as dt

from conftest import rows

from kadence.operators import gold as G
from kadence.rules import Rules

RULES = Rules(min_activities=2)


def activities(spark, data):
    return spark.createDataFrame(
        [(i, k, dt.datetime(*d)) for i, (k, d) in enumerate(data)],
        "id_evenement_sport int, salarie_id int, date_fin_activite timestamp",
    )


def test_threshold_is_strict_and_years_are_apart(spark):
    df = activities(spark, [(1, (2025, 12, 31)), (1, (2026, 1, 1)), (1, (2026, 2, 1)),
                            (2, (2026, 1, 1)), (2, (2026, 1, 2)), (2, (2026, 1, 3))])
    got = G.sort_gold(G.yearly_activity_eligibility(df, RULES), "salarie_id").collect()
    assert [tuple(r) for r in got] == [
        (1, 2025, 1, False, 0),
        (1, 2026, 2, False, 0),
        (2, 2026, 3, True, 5),
    ]


def test_refresh_equals_a_full_computation(spark):
    old = [(1, (2026, 1, 1)), (2, (2026, 1, 2)), (2, (2025, 1, 2))]
    new = [(2, (2026, 1, 3)), (2, (2026, 1, 4)), (3, (2026, 1, 4))]
    every = activities(spark, old + new)
    batch = every.filter("id_evenement_sport >= 3")
    gold = G.yearly_activity_eligibility(activities(spark, old), RULES)
    fresh = G.refresh_wellbeing(gold, every, G.touched_keys(batch), RULES)
    assert rows(fresh) == rows(G.yearly_activity_eligibility(every, RULES))


def test_bonus(spark):
    silver = spark.createDataFrame(
        [
            (1, True, dt.datetime(2026, 1, 1), None),
            (2, True, dt.datetime(2026, 1, 1), dt.datetime(2026, 7, 1)),
            (2, False, dt.datetime(2026, 7, 1), None),
            (3, True, dt.datetime(2025, 1, 1), None),
            (4, True, dt.datetime(2026, 1, 1), None),
        ],
        "id_salarie int, est_eligible_prime_annuel boolean, date_debut timestamp, "
        "date_fin timestamp",
    )
    incomes = spark.createDataFrame(
        [(1, 30000), (2, 30000), (3, 40000)], "id_salarie int, salaire_brut int"
    )
    got = rows(G.annual_bonus(silver, incomes, Rules(), 2026))
    assert got == [
        (1, 2026, True, 365.0, 100.0, 1500.0),
        (2, 2026, False, 184.0, 50.41, 0.0),
        (2, 2026, True, 181.0, 49.59, 0.0),
        # An interval over two years is booked to the last one.
        (3, 2026, True, 730.0, 200.0, 2000.0),
        (4, 2026, True, 365.0, 100.0, None),
    ]
