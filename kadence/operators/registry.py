"""Registry of employee ids with soft deletion."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def registry_insert(registry: DataFrame, ids: DataFrame, at: Column) -> DataFrame:
    """Registry with new ids added. Known ids are left alone, so a replay changes nothing."""
    new = ids.select("id_salarie").distinct().join(registry, "id_salarie", "left_anti")
    return registry.select("id_salarie", "created_at", "deleted_at").unionByName(
        new.select(
            "id_salarie",
            at.cast("timestamp").alias("created_at"),
            F.lit(None).cast("timestamp").alias("deleted_at"),
        )
    )


def registry_soft_delete(registry: DataFrame, deletions: DataFrame) -> DataFrame:
    """Registry with ``deleted_at`` set for the given ``id_salarie, deleted_at``."""
    given = deletions.groupBy("id_salarie").agg(F.max("deleted_at").alias("__deleted"))
    return registry.join(given, "id_salarie", "left").select(
        "id_salarie", "created_at", F.coalesce("__deleted", "deleted_at").alias("deleted_at")
    )


def registry_from_log(log: DataFrame) -> DataFrame:
    """Registry from logged ``id_salarie, event ('insert' | 'delete'), at``.

    An id exists from its first insert; a deletion without one adds nothing, and one that a later
    insert follows no longer holds.
    """
    inserted = F.when(F.col("event") == "insert", F.col("at"))
    deleted = F.when(F.col("event") == "delete", F.col("at"))
    ids = log.groupBy("id_salarie").agg(
        F.min(inserted).alias("created_at"),
        F.max(inserted).alias("__last"),
        F.max(deleted).alias("__gone"),
    )
    holds = F.when(F.col("__gone") >= F.col("__last"), F.col("__gone"))
    return ids.filter(F.col("created_at").isNotNull()).select(
        "id_salarie", "created_at", holds.alias("deleted_at")
    )
