"""Road distances by regions: the same answers, in far fewer rounds."""

import random

import pytest
from conftest import rows
from pyspark.sql import functions as F

from kadence.operators.regions import region_distances
from kadence.operators.roads import distances_to

EDGES = "network string, u bigint, v bigint, length double"


def frames(spark, roads, targets):
    edges = spark.createDataFrame([(*r[:3], float(r[3])) for r in roads], EDGES)
    return edges, spark.createDataFrame(targets, "network string, node_id bigint")


def by_range(width):
    return F.floor(F.col("node") / width)


def relaxed(roads, targets):
    """All labels, by relaxing every road until nothing changes."""
    dist = {t: 0.0 for t in targets}
    changed = True
    while changed:
        changed = False
        for network, u, v, length in roads:
            new = dist.get((network, v), float("inf")) + length
            if new < dist.get((network, u), float("inf")):
                dist[network, u], changed = new, True
    return sorted(((n, i, d) for (n, i), d in dist.items()), key=repr)


@pytest.mark.parametrize("seed,width", [(1, 10), (2, 25), (3, 1000)])
def test_grids_with_one_way_roads_and_shortcuts(spark, seed, width):
    chance, roads = random.Random(seed), []
    for network, size in (("walk", 8), ("drive", 7)):
        for x in range(size):
            for y in range(size):
                for dx, dy in ((1, 0), (0, 1)):
                    if x + dx < size and y + dy < size:
                        a, b = x * size + y, (x + dx) * size + y + dy
                        roads.append((network, a, b, chance.randrange(10)))
                        if chance.random() < 0.8:
                            roads.append((network, b, a, chance.randrange(10)))
        # A road that leaves a region and comes back may be the shortest way inside it; parallel ones differ.
        roads += [(network, 0, size * size - 1, 3), (network, size * size - 1, 1, 0), (network, 0, 1, 90), (network, 500, 501, 1)]
    targets = [("walk", 9), ("drive", 0)]
    edges, goal = frames(spark, roads, targets)
    got = region_distances(edges, goal, by_range(width), crossing=1.0)
    assert rows(got) == relaxed(roads, targets)


def test_a_long_chain_takes_few_rounds(spark):
    roads = [("walk", i, i + 1, 1) for i in range(240)] + [("walk", i + 1, i, 2) for i in range(240)]
    edges, goal = frames(spark, roads, [("walk", 240)])
    # As a whole it takes 120 rounds of two hops.
    with pytest.raises(RuntimeError, match="still improve"):
        distances_to(edges, goal, max_rounds=9)
    got = region_distances(edges, goal, by_range(30), max_rounds=30)
    assert rows(got) == sorted((("walk", i, 240.0 - i) for i in range(241)), key=repr)


def test_where_cutting_does_not_pay_and_empty_networks(spark):
    roads = [("walk", i, (i * 7 + 1) % 50, 1) for i in range(50)]
    edges, goal = frames(spark, roads, [("walk", 3)])
    whole = rows(distances_to(edges, goal))
    for options in ({"crossing": 0.0}, {"region_edges": 1}, {"crossing": 1.0}):
        assert rows(region_distances(edges, goal, by_range(10), **options)) == whole
    assert rows(region_distances(edges.limit(0), goal, by_range(10))) == [("walk", 3, 0.0)]
    lonely = goal.limit(0)
    assert rows(region_distances(edges, lonely, by_range(10), crossing=1.0)) == []
    negative, _ = frames(spark, [("walk", 1, 2, -1)], [])
    with pytest.raises(ValueError, match="negative"):
        region_distances(negative, goal, by_range(10))


@pytest.mark.parametrize("options", [{}, {"fan": 4}])
def test_regions_of_regions_keep_the_rounds_few(spark, options):
    """Thirty regions in a row, with side roads: the overlay is cut again, so rounds do not follow them."""
    roads = [("walk", i + 1, i, 1 + i % 3) for i in range(-60, 60)] + [("walk", 1000 + i, i, 5) for i in range(0, 60, 7)]
    roads += [("walk", 40, 52, 2), ("walk", -50, 7, 1)]
    edges, goal = frames(spark, roads, [("walk", -60)])
    place = F.when(F.col("node") >= 1000, F.col("node") - 1000).otherwise(F.col("node"))
    got = region_distances(edges, goal, F.floor(place / 4), max_rounds=8, crossing=0.5, **options)
    assert rows(got) == relaxed(roads, [("walk", -60)])
