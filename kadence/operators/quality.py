"""Declarative expectations on a DataFrame.

Every row-level check of a suite is part of one aggregate, so a suite costs one pass, plus
one grouping per uniqueness check.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Expectation:
    """``kind`` names the check; ``columns`` what it looks at; ``broken`` is true on a failure.

    ``applies`` tells which rows are evaluated. ``of_type`` checks the schema, not rows.
    """

    kind: str
    columns: tuple[str, ...]
    applies: Column | None = field(default=None, compare=False)
    broken: Column | None = field(default=None, compare=False)
    type_name: str | None = None

    @property
    def label(self) -> str:
        return ",".join(self.columns)


def not_null(column: str) -> Expectation:
    return Expectation("not_null", (column,), F.lit(True), F.col(column).isNull())


def of_type(column: str, type_name: str) -> Expectation:
    """The column has a Spark type, named as in DDL (``"timestamp"``, ``"boolean"``)."""
    return Expectation("of_type", (column,), type_name=type_name)


def in_set(column: str, values: Sequence) -> Expectation:
    """Nulls are not evaluated."""
    known = F.col(column).isNotNull()
    return Expectation("in_set", (column,), known, known & ~F.col(column).isin(list(values)))


def between(column: str, low=None, high=None) -> Expectation:
    """Both ends inclusive, either may be open; nulls are not evaluated."""
    known = F.col(column).isNotNull()
    outside = F.lit(False)
    if low is not None:
        outside = outside | (F.col(column) < F.lit(low))
    if high is not None:
        outside = outside | (F.col(column) > F.lit(high))
    return Expectation("between", (column,), known, known & outside)


def null_or_positive(column: str) -> Expectation:
    known = F.col(column).isNotNull()
    return Expectation("null_or_positive", (column,), known, known & (F.col(column) <= 0))


def compound_unique(columns: Sequence[str]) -> Expectation:
    """Rows that share their values with another row fail; rows of only nulls are not evaluated."""
    return Expectation("compound_unique", tuple(columns))


def _some_key(check: Expectation) -> Column:
    known = F.lit(False)
    for column in check.columns:
        known = known | F.col(column).isNotNull()
    return known


def _has_type(df: DataFrame, check: Expectation) -> bool:
    return df.schema[check.columns[0]].dataType.simpleString() == check.type_name


def validate(df: DataFrame, suite: Sequence[Expectation]) -> DataFrame:
    """One row per expectation: ``expectation, column_name, evaluated, unexpected, success``."""
    row_checks = [c for c in suite if c.kind != "compound_unique"]
    results = []
    if row_checks:
        totals, lines = [F.count(F.lit(1)).alias("n")], []
        for i, check in enumerate(row_checks):
            if check.kind == "of_type":
                bad = F.lit(0).cast("bigint") if _has_type(df, check) else F.col("n")
                lines.append((check, F.col("n"), bad))
                continue
            totals.append(F.count_if(check.applies).alias(f"seen{i}"))
            totals.append(F.count_if(check.broken).alias(f"bad{i}"))
            lines.append((check, F.col(f"seen{i}"), F.col(f"bad{i}")))
        rows = F.array(
            *(
                F.struct(
                    F.lit(c.kind).alias("expectation"),
                    F.lit(c.label).alias("column_name"),
                    seen.alias("evaluated"),
                    bad.alias("unexpected"),
                )
                for c, seen, bad in lines
            )
        )
        results.append(df.agg(*totals).select(F.inline(rows)))
    for check in suite:
        if check.kind == "compound_unique":
            sizes = (
                df.filter(_some_key(check))
                .groupBy(*check.columns)
                .agg(F.count(F.lit(1)).alias("size"))
            )
            results.append(
                sizes.agg(
                    F.lit(check.kind).alias("expectation"),
                    F.lit(check.label).alias("column_name"),
                    F.coalesce(F.sum("size"), F.lit(0).cast("bigint")).alias("evaluated"),
                    F.coalesce(
                        F.sum(F.when(F.col("size") > 1, F.col("size"))), F.lit(0).cast("bigint")
                    ).alias("unexpected"),
                )
            )
    out = results[0]
    for more in results[1:]:
        out = out.unionByName(more)
    return out.withColumn("success", F.col("unexpected") == 0)


FAILURES = "__failures"


def with_failures(df: DataFrame, suite: Sequence[Expectation]) -> DataFrame:
    """Each row with an array of ``(expectation, column_name)`` it breaks.

    Uniqueness is settled by counting keys and joining the repeated ones back; a window over
    the key would hold a whole group in one task.
    """
    out = df
    found = []

    def failure(check: Expectation, broken: Column) -> Column:
        return F.when(
            broken,
            F.struct(
                F.lit(check.kind).alias("expectation"), F.lit(check.label).alias("column_name")
            ),
        )

    for i, check in enumerate(suite):
        if check.kind == "of_type":
            found.append(failure(check, F.lit(not _has_type(df, check))))
        elif check.kind == "compound_unique":
            names = [f"__key{i}_{j}" for j in range(len(check.columns))]
            repeated = (
                df.filter(_some_key(check))
                .groupBy(*(F.col(c).alias(n) for c, n in zip(check.columns, names, strict=True)))
                .agg(F.count(F.lit(1)).alias(f"__size{i}"))
                .filter(F.col(f"__size{i}") > 1)
            )
            same = F.lit(True)
            for column, name in zip(check.columns, names, strict=True):
                same = same & F.col(column).eqNullSafe(F.col(name))
            out = out.join(repeated, same, "left").drop(*names)
            found.append(failure(check, F.col(f"__size{i}").isNotNull()))
        else:
            found.append(failure(check, F.coalesce(check.broken, F.lit(False))))
    return out.select(*df.columns, F.array_compact(F.array(*found)).alias(FAILURES))


def failed_rows(
    df: DataFrame, suite: Sequence[Expectation], batch_id: str, dataset: str
) -> DataFrame:
    """One row per failing row and expectation, with the row as JSON."""
    # Only failing rows are expanded and turned into text.
    broken = with_failures(df, suite).filter(F.size(FAILURES) > 0)
    row = F.to_json(F.struct(*df.columns), {"ignoreNullFields": "false"}).alias("row_json")
    return broken.select(row, F.inline(FAILURES)).select(
        F.lit(batch_id).alias("batch_id"),
        F.lit(dataset).alias("dataset"),
        "expectation",
        "column_name",
        "row_json",
    )


def quality_gate(
    df: DataFrame, suite: Sequence[Expectation]
) -> tuple[DataFrame, DataFrame]:
    """(rows that pass every check, rows that fail with their failures)."""
    checked = with_failures(df, suite)
    passing = checked.filter(F.size(FAILURES) == 0).drop(FAILURES)
    failing = checked.filter(F.size(FAILURES) > 0).withColumnRenamed(FAILURES, "failures")
    return passing, failing


def shipped_suites(*, open_rows_allowed: bool = True) -> dict[str, list[Expectation]]:
    """The checks of every layer, by dataset."""
    before_fill = [not_null("date_debut"), in_set("est_eligible_prime_annuel", [True, False])]
    if not open_rows_allowed:
        before_fill.insert(1, not_null("date_fin"))
    return {
        "silver_new": [
            not_null("id_salarie"),
            not_null("date_debut"),
            of_type("date_debut", "timestamp"),
            null_or_positive("duree"),
            of_type("est_eligible_prime_annuel", "boolean"),
        ],
        "registry_insert": [not_null("id_salarie")],
        "registry_delete": [not_null("id_salarie")],
        "incoherences": [
            not_null("id_salarie"),
            not_null("raison_incoherence"),
            not_null("timestamp"),
            of_type("timestamp", "timestamp"),
        ],
        "notification_errors": [
            not_null("salarie"),
            not_null("error"),
            not_null("timestamp"),
            of_type("timestamp", "timestamp"),
        ],
        "silver_before_fill": before_fill,
        "silver_after_fill": [between("duree", low=0)],
        "gold_bonus": [
            not_null("id_salarie"),
            not_null("annee"),
            between("ratio_jours", low=0, high=100),
            between("montant_prime", low=0),
            compound_unique(["id_salarie", "annee"]),
        ],
    }
