"""Road distances to one fixed node per network."""

from __future__ import annotations

import math

from pyspark import StorageLevel
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kadence.workspace import checkpointed, remove, work_dir

HOPS = 2
PIECES = 32
HUB_EDGES = 100_000
COMPACT_EVERY = 8
#: Hashes by which the roads of nodes are counted first.
CELLS = 1 << 16
#: Labels that are all sent on at once; of more, the shortest go first.
FEW = 100_000


def _backwards(edges: DataFrame) -> DataFrame:
    """``network, node, prev, length``: roads walked backwards."""
    return edges.select("network", F.col("v").alias("node"), F.col("u").alias("prev"), "length")


def _reversed_edges(edges: DataFrame) -> DataFrame:
    """The same, the shortest of parallel ones."""
    return _backwards(edges).groupBy("network", "node", "prev").agg(F.min("length").alias("length"))


def _hubs(incoming: DataFrame, hub_edges: int) -> tuple[float | None, DataFrame | None]:
    """The shortest length, and nodes with more than ``hub_edges`` roads, None if there is none.

    Roads are counted by a hash of their node, so as many rows as there are hashes are shuffled, and then by node
    where a hash has enough of them.
    """
    cell = F.pmod(F.xxhash64("network", "node"), F.lit(CELLS).cast("bigint")).cast("int")
    counts = incoming.groupBy(cell.alias("cell")).agg(F.count(F.lit(1)).alias("n"), F.min("length").alias("shortest"))
    counts = checkpointed(counts)
    shortest = counts.agg(F.min("shortest")).first()[0]
    full = counts.filter(F.col("n") > hub_edges).select("cell")
    if full.isEmpty():
        return shortest, None
    nodes = incoming.withColumn("cell", cell).join(F.broadcast(full), "cell").groupBy("network", "node")
    counted = nodes.agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") > hub_edges)
    hubs = checkpointed(counted.select("network", "node", F.lit(True).alias("hub")))
    return shortest, None if hubs.isEmpty() else hubs


def _in_pieces(incoming: DataFrame, hubs: DataFrame | None) -> DataFrame:
    """Edges with a piece number: those of a hub are cut into pieces by their other end.

    A node with a large part of all edges would make one task of each round. Its edges spread
    over the pieces, and the frontier visits every piece.
    """
    if hubs is None:
        return incoming
    cut = F.pmod(F.xxhash64("prev"), F.lit(PIECES).cast("bigint")).cast("int")
    marked = incoming.join(F.broadcast(hubs), ["network", "node"], "left")
    return marked.withColumn("piece", F.when(F.col("hub"), cut).otherwise(F.lit(0))).drop("hub")


def _sent(labels: DataFrame, hubs: DataFrame | None) -> DataFrame:
    """Labels with the pieces of edges they go to."""
    if hubs is None:
        return labels
    all_pieces = F.sequence(F.lit(0), F.lit(PIECES - 1))
    pieces = F.when(F.col("hub"), all_pieces).otherwise(F.array(F.lit(0)))
    return labels.join(F.broadcast(hubs), ["network", "node"], "left").select(
        "network", "node", "dist", F.explode(pieces).alias("piece")
    )


def distances_to(
    edges: DataFrame,
    targets: DataFrame,
    *,
    hops: int = HOPS,
    hub_edges: int = HUB_EDGES,
    max_rounds: int | None = None,
) -> DataFrame:
    """``network, node_id, road_m``: shortest directed length from each node to its target.

    ``edges`` has ``network, u, v, length`` with lengths of at least 0; ``targets`` one
    ``network, node_id`` per network. Nodes without a path are absent.

    All nodes are solved at once by walking back from the target. A round sends on the labels that
    improved and have not been sent, and appends the labels that improve thereby to a table in the
    shared folder. Up to ``FEW`` labels all go, ``hops`` roads far. Of more, those below a limit go, one road far: a
    label less than the shortest road above the least one cannot improve any more, so it is sent once, and
    a quarter of the labels goes at least, so that short roads do not make many rounds. Every ``COMPACT_EVERY``
    rounds the best label of each node is written anew and the rounds before are deleted, so a round reads one
    label per node and the few rounds since. The table cuts the lineage and survives lost executors. The
    loop ends when no label is left to send, or raises after ``max_rounds``: a partial answer is never
    returned. A negative length, which could shorten a way without end, raises too.
    """
    spark = edges.sparkSession
    folder = work_dir(spark, "roads")
    # Parallel roads stay: the shortest wins when labels meet, before they are shuffled.
    reversed_edges = _backwards(edges)
    shortest, hubs = _hubs(reversed_edges, hub_edges)
    if shortest is not None and shortest < 0:
        raise ValueError(f"a road has the negative length {shortest}")
    meet = ["network", "node"] if hubs is None else ["network", "node", "piece"]
    # Shuffled and sorted once and kept, so that a round only moves labels. A lost block is computed again.
    incoming = (
        _in_pieces(reversed_edges, hubs)
        .repartition(int(spark.conf.get("spark.sql.shuffle.partitions")), *meet)
        .sortWithinPartitions(*meet)
        .persist(StorageLevel.MEMORY_AND_DISK)
    )

    def sent_on(labels: DataFrame) -> DataFrame:
        ways = _sent(labels, hubs).join(incoming, meet)
        return ways.select("network", F.col("prev").alias("node"), (F.col("dist") + F.col("length")).alias("dist"))

    def shortest_of(found: DataFrame) -> DataFrame:
        return found.groupBy("network", "node").agg(F.min("dist").alias("dist"))

    schema = "network string, node bigint, dist double, round int"

    def labels() -> DataFrame:
        kept = [*base, *(f"{folder}/labels/round={r}" for r in range(first, done + 1))]
        return spark.read.schema(schema).option("basePath", f"{folder}/labels").parquet(*kept)

    def unsent() -> Column:
        """Labels of the last round, and those since round ``all_sent`` that no limit has reached."""
        later = F.col("round") > all_sent
        if merged_unsent:
            later |= F.col("round") < 0
        return (F.col("round") == done) | (later & (F.col("dist") >= limit))

    start = targets.select(
        "network", F.col("node_id").alias("node"), F.lit(0.0).alias("dist")
    ).distinct()
    start.write.parquet(f"{folder}/labels/round=0")

    # Rounds from ``first`` on stand by themselves; those before, in ``base``.
    done, first, base = 0, 0, []
    all_sent, merged_unsent, limit = -1, False, float("-inf")
    while True:
        stored = labels()
        left, least, quarter = (
            stored.filter(unsent())
            .agg(F.count(F.lit(1)), F.min("dist"), F.percentile_approx("dist", 0.25, 1000))
            .first()
        )
        if left == 0:
            break
        if max_rounds is not None and done >= max_rounds:
            raise RuntimeError(f"labels still improve after {done} rounds")
        # A node's labels fall from round to round, so its last one is its best.
        best = stored.groupBy("network", "node").agg(F.min("dist").alias("dist"), F.max("round").alias("round"))
        frontier = best.filter(unsent())
        if left <= FEW:
            frontier, all_sent, merged_unsent, limit = frontier.drop("round"), done, False, float("-inf")
            sent = reached = sent_on(frontier)
            for _ in range(hops - 1):
                sent = sent_on(shortest_of(sent))
                reached = reached.unionByName(sent)
        else:
            limit = max(limit, least + (shortest or 0.0), quarter, math.nextafter(least, math.inf))
            reached = sent_on(frontier.filter(F.col("dist") < limit).drop("round"))
        known = stored.select("network", "node", F.lit(None).cast("double").alias("dist"), F.col("dist").alias("known"))
        improved = (
            reached.withColumn("known", F.lit(None).cast("double"))
            .unionByName(known)
            .groupBy("network", "node")
            .agg(F.min("dist").alias("dist"), F.min("known").alias("known"))
            .filter(F.col("dist").isNotNull() & (F.col("known").isNull() | (F.col("dist") < F.col("known"))))
        )
        done += 1
        improved.drop("known").write.parquet(f"{folder}/labels/round={done}")
        if done - first >= COMPACT_EVERY:
            # The last round stays apart: all of it is to be sent. Merged ones have a number below all rounds.
            older = [*base, *(f"{folder}/labels/round={r}" for r in range(first, done))]
            merged = spark.read.schema(schema).option("basePath", f"{folder}/labels").parquet(*older)
            base, first = [f"{folder}/labels/round={-done}"], done
            merged_unsent = all_sent < done - 1
            shortest_of(merged).write.parquet(base[0])
            for path in older:
                remove(spark, path)
    found = checkpointed(
        shortest_of(labels()).select("network", F.col("node").alias("node_id"), F.col("dist").alias("road_m"))
    )
    incoming.unpersist()
    remove(spark, folder)
    return found
