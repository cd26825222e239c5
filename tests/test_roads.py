import heapq
import random
from pathlib import Path

import pytest
from conftest import rows
from pyspark.sql import functions as F

from kadence.functions.geodesy import haversine
from kadence.operators import places as P
from kadence.operators import roads as R
from kadence.operators.places import best_candidates, geocode_join, nearest_node
from kadence.operators.roads import distances_to


def shortest(edges, target):
    back = {}
    for u, v, length in edges:
        back.setdefault(v, []).append((u, length))
    dist, heap = {}, [(0.0, target)]
    while heap:
        d, node = heapq.heappop(heap)
        if node in dist:
            continue
        dist[node] = d
        for u, length in back.get(node, []):
            heapq.heappush(heap, (d + length, u))
    return dist


@pytest.mark.parametrize(("hops", "hub_edges"), [(1, 10**6), (2, 10**6), (3, 10)])
def test_distances_equal_a_search_per_node(spark, hops, hub_edges):
    rng = random.Random(hops)
    # Node 0 holds a third of all edges; nodes from 200 on have no way out.
    edges = [(rng.randint(1, 199), rng.randint(0, 250), float(rng.randint(0, 99))) for _ in range(400)]
    edges += [(rng.randint(1, 199), 0, float(rng.randint(50, 500))) for _ in range(200)]
    roads = spark.createDataFrame(
        [("walk", *e) for e in edges] + [("drive", v, u, x) for u, v, x in edges],
        "network string, u int, v int, length double",
    )
    targets = spark.createDataFrame([("walk", 0), ("drive", 0)], "network string, node_id int")
    got = distances_to(roads, targets, hops=hops, hub_edges=hub_edges)
    want = [("walk", n, d) for n, d in shortest(edges, 0).items()]
    want += [("drive", n, d) for n, d in shortest([(v, u, x) for u, v, x in edges], 0).items()]
    assert rows(got) == sorted(want, key=repr)


def test_many_labels_are_sent_shortest_first_and_hardly_twice(spark, monkeypatch):
    rng = random.Random(3)
    # Ways over many short roads are shorter than those over few long ones, so early labels are poor.
    edges = [(rng.randint(0, 299), rng.randint(0, 299), rng.choice([10.0, 12.0, 15.0, 90.0])) for _ in range(3000)]
    roads = spark.createDataFrame([("walk", *e) for e in edges], "network string, u int, v int, length double")
    targets = spark.createDataFrame([("walk", 0)], "network string, node_id int")
    sent, passed_on = [], R._sent

    def counted(labels, hubs):
        sent.append(labels.count())
        return passed_on(labels, hubs)

    monkeypatch.setattr(R, "FEW", 20, raising=False)
    monkeypatch.setattr(R, "_sent", counted)
    got = distances_to(roads, targets)
    want = shortest(edges, 0)
    assert rows(got) == sorted((("walk", n, d) for n, d in want.items()), key=repr)
    assert sum(sent) <= 1.5 * len(want)


def test_roads_are_shuffled_once(spark, monkeypatch):
    """What is kept of the roads reads them through one exchange, and hubs are not counted node by node."""
    roads = spark.range(5000).selectExpr("'walk' network", "id u", "id div 3 v", "1d length")
    targets = spark.createDataFrame([("walk", 0)], "network string, node_id int")
    plans, persist = [], type(roads).persist

    def kept(df, *level):
        plans.append(df._jdf.queryExecution().optimizedPlan().toString())
        return persist(df, *level)

    monkeypatch.setattr(type(roads), "persist", kept)
    assert distances_to(roads, targets).count() == 5000
    assert len(plans) == 1 and plans[0].count("Repartition") == 1 and "Sort" in plans[0] and "Range" in plans[0]


def test_a_bounded_search_never_returns_part_of_the_answer(spark):
    roads = spark.createDataFrame(
        [("walk", i, i + 1, 1.0) for i in range(9)], "network string, u int, v int, length double"
    )
    targets = spark.createDataFrame([("walk", 9)], "network string, node_id int")
    with pytest.raises(RuntimeError):
        distances_to(roads, targets, hops=1, max_rounds=3)


def test_a_negative_length_is_refused(spark):
    roads = spark.createDataFrame([("walk", 1, 2, -1.0)], "network string, u int, v int, length double")
    targets = spark.createDataFrame([("walk", 2)], "network string, node_id int")
    with pytest.raises(ValueError):
        distances_to(roads, targets)


def test_long_ways_are_compacted_and_cleared(spark):
    n = 40
    roads = spark.createDataFrame(
        [("walk", i, i + 1, 1.0) for i in range(n)], "network string, u int, v int, length double"
    )
    targets = spark.createDataFrame([("walk", n)], "network string, node_id int")
    before = set(Path(spark.conf.get("spark.checkpoint.dir")).glob("roads-*"))
    got = distances_to(roads, targets, hops=1)
    assert rows(got, "node_id", "road_m") == [(i, float(n - i)) for i in sorted(range(n + 1), key=lambda i: repr((i, float(n - i))))]
    assert set(Path(spark.conf.get("spark.checkpoint.dir")).glob("roads-*")) == before


def brute(points, nodes):
    there = nodes.select("network", "node_id", F.col("lat").alias("a"), F.col("lon").alias("b"))
    d = haversine(F.col("lat"), F.col("lon"), F.col("a"), F.col("b"))
    return (
        points.distinct()
        .join(there, "network")
        .groupBy("network", "lat", "lon")
        .agg(F.min(F.struct(d.alias("d"), "node_id")).alias("best"))
        .select("network", "lat", "lon", "best.node_id")
    )


@pytest.mark.parametrize("seed", range(2))
def test_nearest_node_equals_a_full_comparison(spark, seed):
    rng = random.Random(seed)
    # A town, a street with a third of all nodes, and nodes all over the globe.
    town = [("w", i, 43 + rng.random() / 2, 3.5 + rng.random() / 2) for i in range(600)]
    street = [("w", 1000 + i, 43.2 + rng.random() * 1e-4, 3.6) for i in range(400)]
    globe = [("d", i, rng.uniform(-90, 90), rng.uniform(-180, 180)) for i in range(200)]
    same = [("d", 900, 0.0, 0.0), ("d", 901, 0.0, 0.0)]
    nodes = spark.createDataFrame(
        town + street + globe + same, "network string, node_id int, lat double, lon double"
    )
    points = [("w", 43 + rng.random() * 2, 3 + rng.random()) for _ in range(150)]
    points += [("w", 43.2, 3.6)] * 20 + [("d", 0.0, 0.0), ("d", 90.0, 0.0), ("d", 10.0, 180.0)]
    points += [("d", rng.uniform(-90, 90), rng.uniform(-180, 180)) for _ in range(150)]
    asked = spark.createDataFrame(points, "network string, lat double, lon double")
    got = nearest_node(asked.union(spark.createDataFrame([("w", None, 1.0), ("x", 1.0, 1.0)], asked.schema)), nodes)
    assert rows(got.drop("snap_m")) == rows(brute(asked, nodes))
    assert got.filter("network = 'd' and lat = 0 and lon = 0").first()["node_id"] == 900


def test_uneven_nodes_never_make_long_lists(spark):
    """A dense town among scattered places: no cube has many cubes inside on the next step."""
    rng = random.Random(5)
    town = [("w", i, 43 + rng.random() / 200, 3.5 + rng.random() / 200) for i in range(6000)]
    wide = [("w", 10_000 + i, rng.uniform(-60, 60), rng.uniform(-180, 180)) for i in range(500)]
    nodes = spark.createDataFrame(town + wide, "network string, node_id int, lat double, lon double")
    spots = nodes.withColumns(P._on_sphere(F.col("lat"), F.col("lon"))).withColumn("home", P._cube(F.lit(P.MAX_LEVEL)))
    steps = [level for level, _ in P._levels(spots, "network")]
    for coarse, fine in zip(steps, steps[1:], strict=False):
        cubes = spots.select(*(P._around(F.col("home"), F.lit(P.MAX_LEVEL - i)).alias(n) for i, n in ((coarse, "c"), (fine, "f"))))
        longest = cubes.distinct().groupBy("c").count().agg(F.max("count")).first()[0]
        assert longest <= P.CHILDREN
    points = nodes.sample(0.02, 1).select("network", (F.col("lat") + 0.0003).alias("lat"), "lon")
    assert rows(nearest_node(points, nodes).drop("snap_m")) == rows(brute(points, nodes))


def test_rows_without_a_key_keep_their_place(spark):
    df = spark.createDataFrame([(1, "a"), (2, None), (3, "z")], "k int, address_key string")
    other = spark.createDataFrame([("a", 1.0)], "address_key string, lat double")
    assert rows(P.left_join_known(df, other, ["address_key"]), "k", "lat") == [(1, 1.0), (2, None), (3, None)]


def test_best_candidate_and_misses(spark):
    addresses = spark.createDataFrame(
        [("1  Rue A ", 1.0, 2.0, 0.5), ("1 rue a", 3.0, 4.0, 0.9), ("2 rue b", None, 1.0, 1.0)],
        "adresse string, lat double, lon double, score double",
    )
    assert best_candidates(addresses).count() == 2
    people = spark.createDataFrame(
        [(1, "1 RUE A"), (2, "2 Rue B"), (3, "nowhere"), (4, None)], "k int, adresse_domicile string"
    )
    got = geocode_join(people, addresses)
    assert rows(got, "k", "lat", "lon", "geo_error") == [
        (1, 3.0, 4.0, None),
        (2, None, 1.0, None),
        (3, None, None, "Erreur : features empty"),
        (4, None, None, None),
    ]
