"""Identity lookup and notification texts for activities."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kadence.functions.messages import INTERJECTIONS
from kadence.functions.scalars import (
    activity_seconds,
    activity_year,
    comment_suffix,
    distance_km,
    format_duration,
    pick_some,
    pick_variant,
)


def activity_measures(df: DataFrame) -> DataFrame:
    """Duration, kilometres and year from an activity image with microsecond times."""
    return df.withColumns(
        {
            "duree_s": activity_seconds(
                F.col("date_debut_activite"), F.col("date_fin_activite")
            ),
            "distance_km": distance_km(F.col("distance_m")),
            "annee": activity_year(F.col("date_fin_activite")),
        }
    )


def enrich_identity(activities: DataFrame, employees: DataFrame) -> DataFrame:
    """Activities with name and first name, null for an unknown employee.

    A plain equi-join on a unique key: the staff table grows with the data, so whether to
    broadcast it is left to the size checks of the optimizer, and an employee with a large
    part of all activities to its splitting of skewed partitions.
    """
    staff = employees.select(
        F.col("id_salarie").alias("salarie_id"), "nom", "prenom", F.lit(True).alias("connu")
    )
    joined = activities.join(staff, "salarie_id", "left")
    return joined.withColumn("connu", F.coalesce("connu", F.lit(False)))


def identity_misses(activities: DataFrame, employees: DataFrame) -> DataFrame:
    staff = employees.select(F.col("id_salarie").alias("salarie_id"))
    return activities.join(staff, "salarie_id", "left_anti")


def with_templates(activities: DataFrame, templates: DataFrame) -> DataFrame:
    """Activities with the texts of their sport: a table of fixed size, broadcast."""
    return activities.join(F.broadcast(templates), "sport_type", "left")


def message_text(seed: Column) -> Column:
    """The notification of an enriched activity. The seed makes the choice of texts repeatable."""
    kilometres = F.coalesce(
        F.col("distance_km").cast("decimal(18,1)").cast("string"), F.lit("None")
    )
    phrase = pick_variant(F.col("phrases"), seed, 7)
    phrase = F.replace(phrase, F.lit("{distance_km}"), kilometres)
    phrase = F.replace(phrase, F.lit("{duree_formate}"), format_duration(F.col("duree_s")))
    openings = F.array(*(F.lit(t) for t in INTERJECTIONS))
    return F.concat(
        pick_variant(openings, seed, 5),
        F.lit(" "), "prenom", F.lit(" "), "nom", F.lit(" ! "),
        phrase, F.lit(" ! "),
        pick_variant(F.col("cheers"), seed, 11), F.lit(" ! "),
        pick_some(F.col("emojis"), seed, 13), F.lit(" "),
        comment_suffix(F.coalesce("commentaire", F.lit(""))), F.lit(". "),
    )


def _enriched(activities: DataFrame, employees: DataFrame, templates: DataFrame) -> DataFrame:
    return with_templates(enrich_identity(activities, employees), templates)


def build_messages(activities: DataFrame, employees: DataFrame, templates: DataFrame) -> DataFrame:
    """One notification per activity of a known employee in a known sport."""
    rows = _enriched(activities, employees, templates)
    message = message_text(F.col("id_evenement_sport")).alias("message")
    sendable = rows.filter(F.col("connu") & F.col("phrases").isNotNull())
    return sendable.select("id_evenement_sport", "salarie_id", message)


def message_errors(
    activities: DataFrame, employees: DataFrame, templates: DataFrame, at: Column
) -> DataFrame:
    """The activities without a notification, and what was missing: the sport is looked up last."""
    rows = _enriched(activities, employees, templates)
    error = F.when(~F.col("connu"), F.lit("'prenom'")).when(
        F.col("phrases").isNull(), F.concat(F.lit("'"), "sport_type", F.lit("'"))
    )
    return (
        rows.withColumn("error", error)
        .filter(F.col("error").isNotNull())
        .select(F.col("salarie_id").alias("salarie"), "error", at.alias("timestamp"))
    )
