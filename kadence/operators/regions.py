"""Road distances over a network cut into regions: rounds go over region borders only.

Border nodes are the ends of roads between regions, and the target. One pass over the regions finds the
ways between the borders of each, which with the roads between regions make a small overlay network. That is cut
into larger regions again, until one is left or cutting does not pay; there, distances are found in rounds as ever
(``roads.distances_to``). Passes back carry them into the regions, level by level. So the passes follow the logarithm
of the number of regions a way crosses.
"""

from __future__ import annotations

import sys
from heapq import heappop, heappush

import pandas as pd
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kadence.operators.roads import _reversed_edges, distances_to
from kadence.workspace import checkpointed, remove, work_dir

# What tasks run travels by value, so executors need not have this library.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

#: Roads of a region, which one task searches, and the share of roads that may lead out of regions.
REGION_EDGES = 1_000_000
CROSSING = 0.25
#: Neighbouring regions that make one on the next level.
FAN = 64


def _roads_back(inner: pd.DataFrame) -> dict[int, list[tuple[int, float]]]:
    back: dict[int, list[tuple[int, float]]] = {}
    for node, prev, length in zip(inner["node"].tolist(), inner["prev"].tolist(), inner["length"].tolist(), strict=True):
        back.setdefault(node, []).append((prev, length))
    return back


def _walk(
    back: dict, start: list[tuple[float, int]], stops: frozenset | set, ends: bool = True
) -> dict[int, float]:
    """Shortest ways back from labelled nodes; a stop that is reached is labelled and not passed.

    Without ``ends``, nodes that are no stop and that no road leads to are left out: no way goes on from there.
    """
    labels: dict[int, float] = {}
    heap = sorted(start)
    first = {node for _, node in start}
    while heap:
        dist, node = heappop(heap)
        if node in labels:
            continue
        labels[node] = dist
        if node in stops and node not in first:
            continue
        for prev, length in back.get(node, ()):
            if prev not in labels and (ends or prev in back or prev in stops):
                heappush(heap, (dist + length, prev))
    return labels


def border_ways(inner: pd.DataFrame, borders: pd.DataFrame) -> pd.DataFrame:
    """Shortest ways inside a region from border to border that pass no third one: ``network, u, v, length``."""
    back, stops = _roads_back(inner), set(borders["node"].tolist())
    out = [
        (u, v, dist) for v in sorted(stops) for u, dist in _walk(back, [(0.0, v)], stops, ends=False).items() if u != v and u in stops
    ]
    ways = pd.DataFrame(out, columns=["u", "v", "length"])
    ways.insert(0, "network", borders["network"].iloc[0] if len(borders) else None)
    return ways.astype({"u": "int64", "v": "int64", "length": "float64"})


def carried_in(inner: pd.DataFrame, labelled: pd.DataFrame) -> pd.DataFrame:
    """Distances of all nodes of a region from those of its borders: ``network, node_id, road_m``."""
    start = list(zip(labelled["road_m"].tolist(), labelled["node"].tolist(), strict=True))
    found = list(_walk(_roads_back(inner), start, frozenset()).items())
    out = pd.DataFrame(found, columns=["node_id", "road_m"])
    out.insert(0, "network", labelled["network"].iloc[0] if len(labelled) else None)
    return out.astype({"node_id": "int64", "road_m": "float64"})


def region_distances(
    edges: DataFrame,
    targets: DataFrame,
    region: Column,
    *,
    region_edges: int = REGION_EDGES,
    crossing: float = CROSSING,
    fan: int = FAN,
    **rounds,
) -> DataFrame:
    """``network, node_id, road_m`` as ``distances_to`` finds them, for networks in which ways are long.

    ``region`` names the region of a ``node`` (whole number), for instance its cube or a range of its number. If a
    region has more than ``region_edges`` roads, or more than the share ``crossing`` of all leads out of regions,
    cutting does not pay and the network is solved as a whole; the answer is the same. ``fan`` regions of
    neighbouring numbers make a region of the overlay. ``rounds`` go to ``distances_to``.
    """
    spark = edges.sparkSession
    folder = work_dir(spark, "regions")

    def placed(df: DataFrame, node: str, name: str) -> DataFrame:
        # The expression is over ``node``, so the column goes by that name for a moment.
        if node == "node":
            return df.withColumn(name, region)
        swapped = df.withColumnsRenamed({"node": "_node", node: "node"}).withColumn(name, region)
        return swapped.withColumnsRenamed({"node": node, "_node": "node"})

    placed(placed(_reversed_edges(edges), "node", "region"), "prev", "other").write.parquet(f"{folder}/roads")
    roads = spark.read.parquet(f"{folder}/roads")
    leads_out = ~F.col("region").eqNullSafe(F.col("other"))
    by_region = roads.groupBy("network", "region").agg(
        F.count("*").alias("n"), F.count_if(leads_out).alias("out"), F.min("length").alias("least")
    )
    most, total, out, least, widest = by_region.agg(
        F.max("n"), F.sum("n"), F.sum("out"), F.min("least"), F.max(F.abs("region"))
    ).first()
    if not total or least < 0 or most > region_edges or out > crossing * total:
        remove(spark, folder)
        return distances_to(edges, targets, **rounds)
    inner, between = roads.where(~leads_out).drop("other"), roads.where(leads_out)
    goals = placed(targets.select("network", F.col("node_id").alias("node")), "node", "region")
    ends = [
        between.select("network", "node", "region"),
        between.select("network", F.col("prev").alias("node"), F.col("other").alias("region")),
        goals,
    ]
    borders = ends[0].unionByName(ends[1]).unionByName(ends[2]).distinct()
    keys = ["network", "region"]
    ways = (
        inner.groupBy(*keys).cogroup(borders.groupBy(*keys))
        .applyInPandas(lambda a, b: border_ways(a, b), "network string, u long, v long, length double")
    )
    overlay = ways.unionByName(between.select("network", F.col("prev").alias("u"), F.col("node").alias("v"), F.col("length").cast("double")))
    overlay.write.parquet(f"{folder}/overlay")
    overlay = spark.read.parquet(f"{folder}/overlay")
    if widest:
        larger = F.call_function("div", region, F.lit(fan))
        options = {"region_edges": region_edges, "crossing": crossing, "fan": fan}
        reached = region_distances(overlay, targets, larger, **options, **rounds)
    else:
        reached = distances_to(overlay, targets, **rounds)
    labelled = placed(reached.withColumnRenamed("node_id", "node"), "node", "region")
    found = (
        inner.groupBy(*keys).cogroup(labelled.groupBy(*keys))
        .applyInPandas(lambda a, b: carried_in(a, b), "network string, node_id long, road_m double")
    )
    solved = checkpointed(found)
    remove(spark, folder)
    return solved
