"""Address lookup and snapping of points to road nodes."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kadence.functions.geodesy import haversine
from kadence.workspace import checkpointed

# Fixed value: what the lookup reports for an address without a candidate.
NO_CANDIDATE = "Erreur : features empty"


def address_key(address: Column) -> Column:
    """Addresses meet on lower-case text with single spaces."""
    return F.lower(F.trim(F.regexp_replace(address, r"\s+", " ")))


def best_candidates(addresses: DataFrame) -> DataFrame:
    """``address_key, lat, lon`` of the highest scored candidate; combines before the shuffle."""
    key = address_key(F.col("adresse")).alias("address_key")
    keyed = addresses.select(key, "lat", "lon", "score")
    best = F.max_by(F.struct("lat", "lon"), F.struct("score", "lat", "lon"))
    return keyed.groupBy("address_key").agg(best.alias("best")).select("address_key", "best.*")


def geocode_join(
    df: DataFrame, addresses: DataFrame, address: str = "adresse_domicile"
) -> DataFrame:
    """Rows with ``lat, lon, geo_error``; an address without a candidate has the error."""
    found = best_candidates(addresses).withColumn("__found", F.lit(True))
    missed = F.col("__found").isNull() & F.col(address).isNotNull()
    keyed = df.withColumn("address_key", address_key(F.col(address)))
    return (
        left_join_known(keyed, found, ["address_key"])
        .withColumn("geo_error", F.when(missed, F.lit(NO_CANDIDATE)))
        .drop("__found", "address_key")
    )


def left_join_known(df: DataFrame, other: DataFrame, keys: list[str]) -> DataFrame:
    """A left join in which rows without a key are set aside: they would all meet in one task."""
    whole = F.lit(True)
    for key in keys:
        whole = whole & F.col(key).isNotNull()
    met = df.filter(whole).join(other, keys, "left")
    return met.unionByName(df.filter(~whole), allowMissingColumns=True)


# Nearest node. Points and nodes lie on the unit sphere, in cubes of side 2**-level. A search goes
# from coarse to fine cubes: a point keeps the cubes that lie no farther than a node it has seen
# (each cube shows one of its nodes), and looks only into those. No point meets all nodes of a cell,
# however many a cell holds, and the answer is exact.

MAX_LEVEL = 20  # cubes of 6 m; three indices of 21 bits fit in one number
LEAF_NODES = 16
CHILDREN = 64  # cubes within a cube on the next step at most; two levels never have more
SMALL_CUBES = 200_000
AXES = ("x", "y", "z")
SLACK = 1e-14  # in squared radii: half a metre, well above rounding


def _on_sphere(lat: Column, lon: Column) -> dict[str, Column]:
    rlat, rlon = F.radians(lat), F.radians(lon)
    return {
        "x": F.cos(rlat) * F.cos(rlon),
        "y": F.cos(rlat) * F.sin(rlon),
        "z": F.sin(rlat),
    }


def _cube(level: Column) -> Column:
    """Number of the cube around ``x, y, z`` on a level."""
    packed = F.lit(0).cast("bigint")
    for axis in AXES:
        finest = F.floor((F.col(axis) + F.lit(1.0)) * F.lit(float(2**MAX_LEVEL)))
        # 1.0 itself belongs to the last cube.
        index = F.least(finest, F.lit(2 ** (MAX_LEVEL + 1) - 1).cast("bigint"))
        packed = F.call_function("shiftleft", packed, F.lit(MAX_LEVEL + 1)) + F.call_function(
            "shiftright", index, F.lit(MAX_LEVEL) - level
        )
    return packed


BITS = MAX_LEVEL + 1


def _indices(cube: Column) -> list[Column]:
    mask = F.lit(2**BITS - 1).cast("bigint")
    return [
        F.call_function("shiftright", cube, F.lit(shift)).bitwiseAND(mask)
        for shift in (2 * BITS, BITS, 0)
    ]


def _around(cube: Column, levels: Column) -> Column:
    """The cube that many levels coarser around a cube."""
    packed = F.lit(0).cast("bigint")
    for index in _indices(cube):
        packed = F.call_function("shiftleft", packed, F.lit(BITS)) + F.call_function(
            "shiftright", index, levels
        )
    return packed


def _corner(cube: Column, level: int) -> list[Column]:
    """Low corner of a cube, as ``low_x, low_y, low_z``."""
    return [
        (i * F.lit(2.0**-level) - F.lit(1.0)).alias(f"low_{a}")
        for i, a in zip(_indices(cube), AXES, strict=True)
    ]


def _weigh(level: int) -> Callable[[Column], Column]:
    """A child cube with the squared chord from ``x, y, z`` to its nearest part, 0 inside."""

    def weigh(child: Column) -> Column:
        squared = F.lit(0.0)
        for axis in AXES:
            below = child[f"low_{axis}"] - F.col(axis)
            gap = F.greatest(below, -below - F.lit(2.0**-level), F.lit(0.0))
            squared = squared + gap * gap
        return F.struct(child["child"].alias("cube"), squared.alias("least"))

    return weigh


def _chord(node: Column) -> Column:
    """Squared chord from ``x, y, z`` to a node."""
    parts = [(F.col(a) - node[a]) * (F.col(a) - node[a]) for a in AXES]
    return parts[0] + parts[1] + parts[2]


def _levels(spots: DataFrame, group: str) -> list[tuple[int, int]]:
    """``(level, cubes)`` per search step, from the whole globe to cubes with few nodes.

    Cubes of every second level are counted once, with their nodes and with the cubes two, four
    and six levels finer inside them. A step goes as deep as no cube has more than ``CHILDREN``
    cubes inside, however unevenly nodes lie. Only numbers per level come to the driver.
    """
    every = list(range(0, MAX_LEVEL + 1, 2))
    level = F.explode(F.array(*map(F.lit, every))).alias("level")
    cubes = checkpointed(
        spots.select(group, "home", level)
        .groupBy("level", group, _around(F.col("home"), F.lit(MAX_LEVEL) - F.col("level")).alias("cube"))
        .agg(F.count(F.lit(1)).alias("n"))
    )
    sizes = {
        r["level"]: (r["cubes"], r["fullest"])
        for r in cubes.groupBy("level")
        .agg(F.count(F.lit(1)).alias("cubes"), F.max("n").alias("fullest"))
        .collect()
    }
    inside = (
        cubes.select(group, "level", "cube", F.explode(F.array(*map(F.lit, (2, 4, 6)))).alias("up"))
        .filter(F.col("level") >= F.col("up"))
        .groupBy((F.col("level") - F.col("up")).alias("level"), "up", group, _around(F.col("cube"), F.col("up")))
        .agg(F.count(F.lit(1)).alias("n"))
    )
    children = {
        (r["level"], r["up"]): r["n"]
        for r in inside.groupBy("level", "up").agg(F.max("n").alias("n")).collect()
    }
    leaf = next((i for i in every if sizes.get(i, (0, 0))[1] <= LEAF_NODES), MAX_LEVEL)
    steps = [0]
    while steps[-1] < leaf:
        here = steps[-1]
        deep = [d for d in (6, 4) if here + d <= leaf and children.get((here, d), 0) <= CHILDREN]
        steps.append(here + (deep[0] if deep else 2))
    return [(i, sizes.get(i, (0, 0))[0]) for i in steps]


def _sized(cubes: DataFrame, count: int) -> DataFrame:
    """Broadcast a cube table only if the counted number of cubes is small.

    Coarse cubes are few and each is met by many points; fine cubes are many and spread.
    """
    return F.broadcast(cubes) if count <= SMALL_CUBES else cubes


def nearest_node(points: DataFrame, nodes: DataFrame, group: str = "network") -> DataFrame:
    """``group, lat, lon, node_id, snap_m``: the closest node of the same group per point.

    ``points`` has ``group, lat, lon``; equal points are searched once. Distance is along the
    sphere, the lowest node id wins a tie. Points of a group without nodes are absent.
    """
    here = [group, "lat", "lon", "x", "y", "z", "reach"]
    sought = (
        points.select(group, "lat", "lon")
        .filter(F.col("lat").isNotNull() & F.col("lon").isNotNull())
        .distinct()
        .withColumns(_on_sphere(F.col("lat"), F.col("lon")))
    )
    # Nodes at one place are one candidate.
    spots = checkpointed(
        nodes.groupBy(group, "lat", "lon")
        .agg(F.min("node_id").alias("node_id"))
        .withColumns(_on_sphere(F.col("lat"), F.col("lon")))
        .withColumn("home", _cube(F.lit(MAX_LEVEL)))
    )
    steps = _levels(spots, group)

    def cubes_of(level: int, name: str) -> Column:
        return _around(F.col("home"), F.lit(MAX_LEVEL - level)).alias(name)

    first, count = steps[0]
    roots = spots.select(group, cubes_of(first, "cube")).distinct()
    search = sought.withColumn("reach", F.lit(4.0)).join(_sized(roots, count), group)
    for (coarse, _), (fine, count) in zip(steps, steps[1:], strict=False):
        # The cubes within a cube, each with one of its nodes: CHILDREN at most.
        member = F.struct(*AXES)
        inside = (
            spots.groupBy(group, cubes_of(coarse, "cube"), cubes_of(fine, "child"))
            .agg(F.min(member).alias("member"))
            .groupBy(group, "cube")
            .agg(
                F.collect_list(
                    F.struct("child", "member", *_corner(F.col("child"), fine))
                ).alias("inside")
            )
        )
        # No nearest node is farther than any node already seen.
        seen = F.array_min(F.transform("inside", lambda c: _chord(c["member"])))
        opened = search.join(_sized(inside, count), [group, "cube"]).withColumn(
            "reach", F.least("reach", seen)
        )
        weighed = F.transform("inside", _weigh(fine))
        possible = F.filter(weighed, lambda c: c["least"] <= F.col("reach") + F.lit(SLACK))
        kept = (
            opened.select(*here, possible.alias("cubes"))
            .groupBy(group, "lat", "lon")
            .agg(
                *(F.min(c).alias(c) for c in (*AXES, "reach")),
                F.flatten(F.collect_list("cubes")).alias("cubes"),
            )
        )
        last = F.filter("cubes", lambda c: c["least"] <= F.col("reach") + F.lit(SLACK))
        search = kept.select(*here, F.explode(last).alias("c")).select(*here, "c.cube")

    leaves = spots.select(
        group,
        cubes_of(steps[-1][0], "cube"),
        "node_id",
        F.col("lat").alias("node_lat"),
        F.col("lon").alias("node_lon"),
    )
    metres = haversine(F.col("lat"), F.col("lon"), F.col("node_lat"), F.col("node_lon"))
    return (
        search.join(leaves, [group, "cube"])
        .groupBy(group, "lat", "lon")
        .agg(F.min(F.struct(metres.alias("snap_m"), "node_id")).alias("best"))
        .select(group, "lat", "lon", "best.node_id", "best.snap_m")
    )
