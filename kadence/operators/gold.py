"""The two yearly products: wellbeing days and the annual bonus."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kadence.functions.scalars import (
    bonus_amount,
    days_between,
    days_in_year,
    end_of_year,
    percentage,
)
from kadence.rules import Rules


def activity_counts(activities: DataFrame) -> DataFrame:
    """Activities per employee and year of the end time; counts combine before the shuffle."""
    return activities.groupBy("salarie_id", F.year("date_fin_activite").alias("annee")).agg(
        F.count("id_evenement_sport").alias("nb_activites")
    )


def wellbeing_from_counts(counts: DataFrame, rules: Rules) -> DataFrame:
    """Days off for strictly more activities than the threshold."""
    enough = F.col("nb_activites") > F.lit(rules.min_activities)
    return counts.select(
        "salarie_id",
        "annee",
        "nb_activites",
        enough.alias("est_eligible"),
        F.when(enough, F.lit(rules.wellbeing_days)).otherwise(F.lit(0)).alias("nb_jour_bien_etre"),
    )


def yearly_activity_eligibility(activities: DataFrame, rules: Rules) -> DataFrame:
    return wellbeing_from_counts(activity_counts(activities), rules)


def touched_keys(activities: DataFrame) -> DataFrame:
    """Employee and year pairs a batch of activities touches."""
    return activities.select(
        "salarie_id", F.year("date_fin_activite").alias("annee")
    ).distinct()


def refresh_wellbeing(
    gold: DataFrame, activities: DataFrame, touched: DataFrame, rules: Rules
) -> DataFrame:
    """Gold table with the touched pairs recomputed and all other rows kept.

    ``touched`` is distinct. Activities are counted first and matched after, so that only
    partial counts are shuffled and an employee with a large part of all activities stays
    cheap. The match is an inner join: a semi join would be moved below the counting.
    """
    keys = ["salarie_id", "annee"]
    counts = activity_counts(activities).join(touched, keys)
    fresh = wellbeing_from_counts(counts, rules)
    return gold.join(touched, keys, "left_anti").unionByName(fresh)


def sort_gold(df: DataFrame, key: str) -> DataFrame:
    """Order by year. The key breaks ties, so that one year spreads over many sort partitions."""
    return df.orderBy("annee", key)


def eligible_days(silver: DataFrame, as_of_year: int) -> DataFrame:
    """Days per employee, year of the interval's end, and flag; open ends last to year's end."""
    end = F.coalesce(F.col("date_fin"), end_of_year(as_of_year))
    days = silver.select(
        "id_salarie",
        F.year(end).alias("annee"),
        "est_eligible_prime_annuel",
        days_between(F.col("date_debut"), end).alias("duree"),
    )
    return days.groupBy("id_salarie", "annee", "est_eligible_prime_annuel").agg(
        F.sum("duree").alias("duree")
    )


def scan_incomes(employees: DataFrame) -> DataFrame:
    return employees.select("id_salarie", "salaire_brut")


def enrich_income(gold: DataFrame, incomes: DataFrame) -> DataFrame:
    """Gross salary beside each row, null where there is none."""
    return gold.join(incomes, "id_salarie", "left")


def annual_bonus(
    silver: DataFrame, incomes: DataFrame, rules: Rules, as_of_year: int
) -> DataFrame:
    """Share of the year with each flag, and the bonus.

    Incomes meet the already summed rows, a few per employee, so no key of that join is hot.
    """
    return bonus_of_days(eligible_days(silver, as_of_year), incomes, rules)


def bonus_of_days(days: DataFrame, incomes: DataFrame, rules: Rules) -> DataFrame:
    """The bonus from days per employee, year and flag."""
    summed = enrich_income(days, incomes)
    ratio = percentage(F.col("duree"), days_in_year(F.col("annee")))
    return summed.withColumn("ratio_jours", ratio).select(
        "id_salarie",
        "annee",
        "est_eligible_prime_annuel",
        "duree",
        "ratio_jours",
        bonus_amount(
            F.col("salaire_brut"),
            F.col("ratio_jours"),
            F.col("est_eligible_prime_annuel"),
            rules,
        ).alias("montant_prime"),
    )
