"""Home-to-work distances: address, straight line, road node, road distance, verdict."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kadence.functions.geodesy import haversine, linear_distance
from kadence.functions.scalars import commute_mode, is_bonus_eligible, mode_limit
from kadence.operators.changes import has_relevant_change
from kadence.operators.eligibility import distance_outcome
from kadence.operators.places import (
    NO_CANDIDATE,
    address_key,
    best_candidates,
    left_join_known,
    nearest_node,
)
from kadence.operators.roads import distances_to
from kadence.rules import Rules, Site
from kadence.sinks.compaction import FAN, compact
from kadence.sinks.tables import append_batch, read_batches
from kadence.workspace import checkpointed, work_dir


def with_site(df: DataFrame, site: Site) -> DataFrame:
    """The workplace beside every row, as literals: no join is needed."""
    return df.withColumns({"site_lat": F.lit(site.lat), "site_lon": F.lit(site.lon)})


def with_linear_distance(df: DataFrame, site: Site, method: str = "wgs84") -> DataFrame:
    here = with_site(df, site)
    metres = linear_distance(
        F.col("lat"), F.col("lon"), F.col("site_lat"), F.col("site_lon"), method
    )
    return here.withColumn("linear_m", metres).drop("site_lat", "site_lon")


def within_limit(df: DataFrame, rules: Rules) -> DataFrame:
    """Rows near enough for the path search; ``network`` tells the limit."""
    return df.filter(F.col("linear_m") <= mode_limit(F.col("network"), rules))


def site_nodes(nodes: DataFrame, site: Site) -> DataFrame:
    """``network, node_id`` nearest to the workplace: one pass, as the point is a literal."""
    metres = haversine(F.col("lat"), F.col("lon"), F.lit(site.lat), F.lit(site.lon))
    best = F.min(F.struct(metres.alias("snap_m"), "node_id"))
    return nodes.groupBy("network").agg(best.alias("best")).select("network", "best.node_id")


def address_distances(
    wanted: DataFrame,
    addresses: DataFrame,
    nodes: DataFrame,
    edges: DataFrame,
    site: Site,
    rules: Rules,
    method: str = "wgs84",
) -> DataFrame:
    """Everything known about each wanted ``address_key, network``, found once per pair.

    However many employees share an address, it is located, snapped and measured once.
    """
    located = (
        wanted.select("address_key", "network")
        .distinct()
        .join(best_candidates(addresses).withColumn("__found", F.lit(True)), "address_key", "left")
        .withColumn("geo_error", F.when(F.col("__found").isNull(), F.lit(NO_CANDIDATE)))
        .drop("__found")
    )
    # Read by the search and by the result.
    measured = checkpointed(with_linear_distance(located, site, method))
    near = within_limit(measured, rules)
    snapped = nearest_node(near, nodes).select("network", "lat", "lon", "node_id")
    office = site_nodes(nodes, site)
    roads = distances_to(edges, office)
    targets = office.select("network", F.col("node_id").alias("target_id"))
    path_error = F.when(
        F.col("node_id").isNotNull() & F.col("road_m").isNull(),
        F.concat(
            F.lit("No path between "), "node_id", F.lit(" and "), "target_id", F.lit(".")
        ),
    )
    return (
        measured.join(snapped, ["network", "lat", "lon"], "left")
        .join(roads, ["network", "node_id"], "left")
        .join(F.broadcast(targets), "network", "left")  # one row per network
        .withColumn("road_error", path_error)
        .select(
            "address_key", "network", "lat", "lon", "geo_error", "linear_m", "road_m", "road_error"
        )
    )


def commute_distance(
    people: DataFrame,
    addresses: DataFrame,
    nodes: DataFrame,
    edges: DataFrame,
    site: Site,
    rules: Rules,
    method: str = "wgs84",
) -> DataFrame:
    """``people`` (with address and commute text) plus ``distance_m`` and ``reason``."""
    asked = people.withColumns(
        {
            "address_key": address_key(F.col("adresse_domicile")),
            "network": commute_mode(F.col("moyen_deplacement")),
        }
    )
    wanted = asked.filter(F.col("address_key").isNotNull() & F.col("network").isNotNull())
    known = address_distances(wanted, addresses, nodes, edges, site, rules, method)
    return _verdict(left_join_known(asked, known, ["address_key", "network"]), people, rules)


def with_outcome(df: DataFrame, rules: Rules) -> DataFrame:
    """Apply the decision list to rows that carry everything it looks at."""
    outcome = distance_outcome(
        address=F.col("adresse_domicile"),
        mode_text=F.col("moyen_deplacement"),
        geo_error=F.col("geo_error"),
        lat=F.col("lat"),
        lon=F.col("lon"),
        linear_m=F.col("linear_m"),
        road_m=F.col("road_m"),
        road_error=F.col("road_error"),
        rules=rules,
    )
    return (
        df.withColumn("outcome", outcome)
        .withColumns({"distance_m": F.col("outcome.distance_m"), "reason": F.col("outcome.reason")})
        .drop("outcome")
    )


def _verdict(rows: DataFrame, people: DataFrame, rules: Rules) -> DataFrame:
    given = [c for c in people.columns if c not in ("distance_m", "reason")]
    return with_outcome(rows, rules).select(*given, "distance_m", "reason")


Evaluate = Callable[[DataFrame], DataFrame]


def evaluator(
    known: DataFrame, rules: Rules, lookup: Callable[[DataFrame], DataFrame] | None = None
) -> Evaluate:
    """A function that adds ``distance_m, reason`` from stored address distances.

    Streams use it: ``known`` is stored once, here, and joined per batch. ``lookup`` (for instance
    ``address_distances`` with its tables) is asked once for each ``address_key, network`` that
    appears later, and its answers are added to what is stored; without it, or without an answer, an
    address counts as not found.
    """
    spark, schema, answers = known.sparkSession, known.schema, [0]
    folder = work_dir(spark, "addresses")
    append_batch(known, folder, 0)

    def evaluate(people: DataFrame) -> DataFrame:
        asked = people.withColumns(
            {
                "address_key": address_key(F.col("adresse_domicile")),
                "network": commute_mode(F.col("moyen_deplacement")),
            }
        )
        keys = ["address_key", "network"]
        table = read_batches(spark, folder, schema)
        if lookup is not None:
            whole = F.col("address_key").isNotNull() & F.col("network").isNotNull()
            new = asked.filter(whole).select(keys).distinct().join(table, keys, "left_anti")
            new = checkpointed(new)
            if not new.isEmpty():
                answers[0] += 1
                append_batch(lookup(new).select(schema.fieldNames()), folder, answers[0])
                if answers[0] % FAN == 0:
                    compact(spark, folder, answers[0])
                table = read_batches(spark, folder, schema)
        rows = left_join_known(asked, table.withColumn("__known", F.lit(True)), keys)
        missing = F.col("__known").isNull() & F.col("address_key").isNotNull()
        rows = rows.withColumn(
            "geo_error", F.when(missing, F.lit(NO_CANDIDATE)).otherwise(F.col("geo_error"))
        )
        return _verdict(rows, people, rules)

    return evaluate


def evaluated_images(
    changes: DataFrame, evaluate: Evaluate, rules: Rules, *, log_all: bool = False
) -> DataFrame:
    """Routed changes with ``elig_before, elig_after, reason``.

    A change is known by its full position: topic, partition and offset. Updates without a change in a watched column are dropped first. Both images of the rest are
    stacked into one column, so that the evaluation runs once.
    """
    key = ["topic", "partition", "offset"]
    changes = changes.filter((F.col("route") != "updated") | has_relevant_change())
    sides = F.explode(
        F.array_compact(
            F.array(
                F.when(
                    (F.col("route") == "updated"),
                    F.struct(F.lit("before").alias("side"), F.col("before").alias("image")),
                ),
                F.when(
                    F.col("route").isin("created", "updated"),
                    F.struct(F.lit("after").alias("side"), F.col("after").alias("image")),
                ),
            )
        )
    )
    images = changes.select(*key, sides.alias("s")).select(*key, "s.side", "s.image.*")
    judged = evaluate(images)
    flag = is_bonus_eligible(
        commute_mode(F.col("moyen_deplacement")), F.col("distance_m"), rules
    )

    def on(side: str, value: Column) -> Column:
        return F.max(F.when(F.col("side") == side, value))

    verdicts = judged.groupBy(*key).agg(
        on("before", flag).alias("elig_before"),
        on("after", flag).alias("elig_after"),
        on("after", F.col("reason")).alias("reason"),
    )
    rows = changes.join(verdicts, key, "left")
    counts = (F.col("route") == "created") | ~F.col("elig_before").eqNullSafe(F.col("elig_after"))
    kept = F.col("reason") if log_all else F.when(counts, F.col("reason"))
    return rows.withColumn("reason", kept)
