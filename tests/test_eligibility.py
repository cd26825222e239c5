import pytest
from pyspark.sql import functions as F

from kadence.operators.eligibility import split_quarantine
from kadence.plans.commute import with_outcome
from kadence.rules import Rules

COLUMNS = (
    "adresse_domicile string, moyen_deplacement string, geo_error string, lat double, "
    "lon double, linear_m double, road_m double, road_error string"
)
WALK, RIDE, CAR = "Marche/running", "Vélo/Trottinette/Autres", "véhicule thermique/électrique"

CASES = [
    ((None, None, None, None, None, None, None, None), None, "adresse manquante"),
    (("x", None, None, None, None, None, None, None), None, "moyen_deplacement manquant"),
    (("x", CAR, "e", None, None, None, None, None), None, None),
    (("x", WALK, "e", None, None, None, None, None), None, "Erreur geocode : e"),
    (("x", WALK, None, None, 3.0, None, None, None), None, "Erreur geocode inconnue"),
    (("x", WALK, None, 43.0, 3.0, 15000.5, 1.0, None), None, "linear distance > 15.0 kms"),
    (("x", RIDE, None, 43.0, 3.0, 25001.0, 1.0, None), None, "linear distance > 25.0 kms"),
    (("x", WALK, None, 43.0, 3.0, 10.0, None, "boom"), None, "Erreur trajet : boom"),
    (("x", WALK, None, 43.0, 3.0, 9.0, 15010.0, None), 15010.0, "distance hors règle : 15.01 kms"),
    (("x", WALK, None, 43.0, 3.0, 9.0, 16000.0, None), 16000.0, "distance hors règle : 16.0 kms"),
    (("x", WALK, None, 43.0, 3.0, 15000.0, 15000.0, None), 15000.0, None),
    (("x", RIDE, None, 43.0, 3.0, 9.0, 24999.0, None), 24999.0, None),
]


@pytest.mark.parametrize(("row", "distance", "reason"), CASES)
def test_first_matching_case_decides(spark, row, distance, reason):
    got = with_outcome(spark.createDataFrame([row], COLUMNS), Rules()).first()
    assert (got["distance_m"], got["reason"]) == (distance, reason)


def test_quarantined_rows_still_open_an_interval(spark):
    df = spark.createDataFrame(
        [(1, False, "why"), (2, True, None)],
        "id_salarie int, est_eligible_prime_annuel boolean, reason string",
    )
    silver, incoherences = split_quarantine(df, F.lit("2026-01-01").cast("timestamp"))
    assert silver.count() == 2
    assert [r["raison_incoherence"] for r in incoherences.collect()] == ["why"]
