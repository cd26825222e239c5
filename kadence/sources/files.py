"""Readers for employee files, rules and road tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kadence.functions.geodesy import haversine
from kadence.rules import Rules, Site
from kadence.schemas import (
    ACTIVITY,
    EMPLOYEE_CSV,
    ROAD_EDGES,
    ROAD_NODES,
    RULE_FILE,
    SILVER,
)


def read_employee_csv(spark: SparkSession, path: str) -> DataFrame:
    """Employee file with a header line, quoted addresses (quotes doubled inside) and an optional
    byte-order mark."""
    return (
        spark.read.schema(EMPLOYEE_CSV)
        .option("header", True)
        .option("enforceSchema", True)
        .option("escape", '"')
        .option("mode", "FAILFAST")
        .csv(path)
    )


def read_rules(spark: SparkSession, path: str) -> tuple[Rules, DataFrame]:
    """(rule values, site table) of the JSON rule file."""
    raw = spark.read.schema(RULE_FILE).option("multiLine", True).json(path)
    p = raw.select("parametres_regles.*").first()
    rules = Rules(
        min_eligible_percent=p["%_jours_eligibles_par_an"],
        bonus_percent=p["prime_annuelle_%_brut"],
        wellbeing_days=p["nb_journee_bien_etre_gagnees"],
        min_activities=p["nb_activite_physique_min"],
        walk_limit_m=p["marche_running_distance_max_m"],
        drive_limit_m=p["velo_trottinette_distance_max_m"],
    )
    return rules, raw.select(F.inline("entreprises"))


def read_road_graph(
    spark: SparkSession,
    nodes: str,
    edges: str,
    *,
    around: Site | None = None,
    reach_m: dict[str, float] | None = None,
) -> tuple[DataFrame, DataFrame]:
    """(nodes, edges) of all travel networks.

    With a site, a network reaches as far around it as ``reach_m`` says for its name, and roads
    keep both their ends inside; snapping and searching then stay in that area.
    """
    all_nodes = spark.read.schema(ROAD_NODES).parquet(nodes)
    all_edges = spark.read.schema(ROAD_EDGES).parquet(edges)
    if around is None:
        return all_nodes, all_edges
    metres = haversine(F.col("lat"), F.col("lon"), F.lit(around.lat), F.lit(around.lon))
    reach = F.lit(None).cast("double")
    for network, limit in (reach_m or {}).items():
        reach = F.when(F.col("network") == network, F.lit(float(limit))).otherwise(reach)
    near = all_nodes.filter(metres <= reach)
    inside = near.select("network", "node_id").distinct()
    for end in ("u", "v"):
        ends = inside.withColumnRenamed("node_id", end)
        all_edges = all_edges.join(ends, ["network", end], "left_semi")
    return near, all_edges.select(ROAD_EDGES.fieldNames())


def scan_activities(spark: SparkSession, path: str) -> DataFrame:
    """The fact table; a query that counts reads three of its columns."""
    return spark.read.schema(ACTIVITY).parquet(path)


def scan_silver(spark: SparkSession, path: str) -> DataFrame:
    """A stored interval table."""
    return spark.read.schema(SILVER).parquet(path)


def read_jdbc(
    spark: SparkSession, url: str, table: str, properties: dict[str, str], **partitioning
) -> DataFrame:
    """A relational table; ``column, lowerBound, upperBound, numPartitions`` split the read."""
    return spark.read.jdbc(url, table, properties=properties, **partitioning)
