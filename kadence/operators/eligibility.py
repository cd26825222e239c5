"""From commute distances to eligibility, incoherences and flips."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kadence.functions.scalars import commute_mode, differs, is_bonus_eligible, mode_limit
from kadence.rules import Rules


def _kilometres(metres: Column) -> Column:
    return F.bround(metres / F.lit(1000.0), 2).cast("string")


def distance_outcome(
    *,
    address: Column,
    mode_text: Column,
    geo_error: Column,
    lat: Column,
    lon: Column,
    linear_m: Column,
    road_m: Column,
    road_error: Column,
    rules: Rules,
) -> Column:
    """Struct ``(distance_m, reason)``: the first of nine cases that applies.

    ``road_error`` tells why a path is missing; a missing path without one counts as unknown.
    """
    mode = commute_mode(mode_text)
    limit = mode_limit(mode, rules)

    def outcome(reason: Column, distance: Column | None = None) -> Column:
        kept = F.lit(None) if distance is None else distance
        return F.struct(
            kept.cast("double").alias("distance_m"), reason.cast("string").alias("reason")
        )

    too_far = F.concat(
        F.lit("linear distance > "),
        (limit / F.lit(1000.0)).cast("string"),
        F.lit(" kms"),
    )
    off_rule = F.concat(F.lit("distance hors règle : "), _kilometres(road_m), F.lit(" kms"))
    no_path = F.concat(F.lit("Erreur trajet : "), F.coalesce(road_error, F.lit("inconnue")))
    return (
        F.when(address.isNull(), outcome(F.lit("adresse manquante")))
        .when(mode_text.isNull(), outcome(F.lit("moyen_deplacement manquant")))
        .when(mode.isNull(), outcome(F.lit(None)))
        .when(geo_error.isNotNull(), outcome(F.concat(F.lit("Erreur geocode : "), geo_error)))
        .when(lat.isNull() | lon.isNull(), outcome(F.lit("Erreur geocode inconnue")))
        .when(linear_m > limit, outcome(too_far))
        .when(road_m.isNull(), outcome(no_path))
        .when(road_m > limit, outcome(off_rule, road_m))
        .otherwise(outcome(F.lit(None), road_m))
    )


def with_eligibility(df: DataFrame, rules: Rules, mode_text: str, distance_m: str) -> DataFrame:
    flag = is_bonus_eligible(commute_mode(F.col(mode_text)), F.col(distance_m), rules)
    return df.withColumn("est_eligible_prime_annuel", flag)


def split_quarantine(df: DataFrame, at: Column) -> tuple[DataFrame, DataFrame]:
    """(interval rows, incoherence records).

    A row with a reason is reported and still opens an interval, as not eligible: the history
    of a key stays without gaps.
    """
    silver = df.select("id_salarie", "est_eligible_prime_annuel")
    incoherences = df.filter(F.col("reason").isNotNull()).select(
        "id_salarie", F.col("reason").alias("raison_incoherence"), at.alias("timestamp")
    )
    return silver, incoherences


def eligibility_flips(df: DataFrame) -> DataFrame:
    """Updates whose eligibility differs before and after."""
    return df.filter(differs(F.col("elig_before"), F.col("elig_after")))
