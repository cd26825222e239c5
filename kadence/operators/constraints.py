"""Rules a relational source would enforce, as splits and violation reports."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kadence.functions.scalars import text_date

# Fixed value: what a date column holds when the source gives none.
DEFAULT_DATE = "2000-01-01"

REQUIRED = ("salarie_id", "date_debut_activite", "date_fin_activite", "sport_type")


def activity_violations(required: Sequence[str] = REQUIRED) -> Column:
    """Array of the broken rules of an activity; a null makes a comparison hold, as in SQL."""
    found = [F.when(F.col(c).isNull(), F.lit(f"{c} is null")) for c in required]
    found.append(
        F.when(
            ~(F.col("date_fin_activite") > F.col("date_debut_activite")), F.lit("end before start")
        )
    )
    found.append(F.when(~(F.col("distance_m") >= 0), F.lit("negative distance")))
    return F.array_compact(F.array(*found))


def enforce_checks(df: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(valid activities, violating ones with their reasons)."""
    checked = df.withColumn("violations", activity_violations())
    broken = F.size("violations") > 0
    return checked.filter(~broken).drop("violations"), checked.filter(broken)


def orphan_activities(activities: DataFrame, registry: DataFrame) -> DataFrame:
    """Activities of unknown employees."""
    known = registry.select(F.col("id_salarie").alias("salarie_id"))
    return activities.join(known, "salarie_id", "left_anti")


def primary_key_violations(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Keys that occur more than once, with their number of rows."""
    counts = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("occurrences"))
    return counts.filter(F.col("occurrences") > 1)


def normalise_employee(df: DataFrame) -> DataFrame:
    """Typed dates in place of the two text columns; the default where there is none."""

    def typed(text: str) -> Column:
        return F.coalesce(text_date(F.col(text)), F.lit(DEFAULT_DATE).cast("date"))

    return df.withColumns(
        {"ddn": typed("ddn_as_text"), "date_embauche": typed("date_embauche_as_text")}
    ).drop("ddn_as_text", "date_embauche_as_text")
