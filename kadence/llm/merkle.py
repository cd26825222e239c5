"""Merkle manifest of a dataset: leaf digests, a tree per group, and the proof of every leaf.

A leaf partition is an aligned run of at most 2 ** ``levels`` leaves of one tree. It climbs to its own
root, says once which nodes of other partitions its leaves' proofs lack together (an octopus multiproof:
the union of missing coordinates, none of which can be derived from what is known), gets them in
one fetch, derives the interiors that its leaves share and expands the proof of each leaf.
"""

from __future__ import annotations

from hashlib import sha256

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import positions, shipped, stored

#: Levels inside a leaf partition: at most 4,096 leaves.
LEVELS = 12


def digest(*values: Column) -> Column:
    """Hex SHA-256 of values, each as byte count, colon and text; ``-`` for null."""

    def framed(value: Column) -> Column:
        text = value.cast("string")
        return F.coalesce(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text), F.lit("-"))

    return F.sha2(F.concat(*(framed(v) for v in values)), 256)


def joined(left: str, right: str = "") -> str:
    """Digest of the hex texts of a run of nodes, in hex."""
    return sha256((left + right).encode()).hexdigest()


def parents(nodes: list[str]) -> list[str]:
    """The next level: every two consecutive nodes become one, and so does a last one by itself."""
    above = [joined(a, b) for a, b in zip(nodes[::2], nodes[1::2])]
    return above + [joined(nodes[-1])] if len(nodes) % 2 else above


def depth(leaves: int) -> int:
    """Levels above the leaves of a tree: until one node remains."""
    return max(int(leaves) - 1, 0).bit_length()


def missing(known: np.ndarray, leaves: int) -> list[tuple[int, int]]:
    """Coordinates (level, position) that the proofs of ``known`` leaves (sorted) lack together.

    A level's siblings are missing if they exist and are neither known nor derived from known nodes.
    """
    found, level = [], 0
    while leaves > 1:
        siblings = known ^ 1
        lacking = siblings[(siblings < leaves) & ~np.isin(siblings, known)]
        found.extend((level, int(p)) for p in lacking)
        known, leaves, level = np.unique(known >> 1), (leaves + 1) // 2, level + 1
    return found


_NODES = "tree long, leaves long, level int, pos long, hash string"
_ROOTS = _NODES + ", lacks array<struct<level:int,at:long>>"


def _in_order(table: pa.Table) -> pa.Table:
    return table.take(pa.array(np.argsort(table["pos"].to_numpy(), kind="stable")))


def partition_root(table: pa.Table, levels: int) -> pa.Table:
    """The root of a leaf partition, and the coordinates its proofs lack."""
    rows = _in_order(table)
    at, leaves = rows["pos"].to_numpy(), rows["leaves"][0].as_py()
    nodes, level = rows["hash"].to_pylist(), 0
    for level in range(1, min(levels, depth(leaves)) + 1):
        nodes = parents(nodes)
    lacks = [{"level": lv, "at": p} for lv, p in missing(at, leaves)]
    row = {"tree": rows["tree"][0].as_py(), "leaves": leaves, "level": level, "pos": int(at[0]) >> level}
    return pa.Table.from_pylist([row | {"hash": nodes[0], "lacks": lacks}], _ARROW_ROOTS)


def upper_nodes(table: pa.Table, levels: int) -> pa.Table:
    """All nodes above an aligned run of nodes of one level, at most ``levels`` levels up."""
    rows = _in_order(table)
    tree, leaves, base = (rows[c][0].as_py() for c in ("tree", "leaves", "level"))
    nodes, first, found = rows["hash"].to_pylist(), rows["pos"][0].as_py(), []
    for level in range(base + 1, min(base + levels, depth(leaves)) + 1):
        nodes, first = parents(nodes), first >> 1
        found += [(tree, leaves, level, first + i, h) for i, h in enumerate(nodes)]
    names = _ARROW_NODES.names
    return pa.Table.from_pylist([dict(zip(names, f)) for f in found], _ARROW_NODES)


_ARROW_NODES = pa.schema(
    [("tree", pa.int64()), ("leaves", pa.int64()), ("level", pa.int32()), ("pos", pa.int64()), ("hash", pa.string())]
)
_ARROW_ROOTS = _ARROW_NODES.append(
    pa.field("lacks", pa.list_(pa.struct([("level", pa.int32()), ("at", pa.int64())])))
)


def expanded(rows: pa.Table, fetched: pa.Table) -> pa.Table:
    """``rows`` of a leaf partition with the proof of each: a sibling per level, null where there is none."""
    rows = _in_order(rows)
    at, leaves = rows["pos"].to_numpy(), rows["leaves"][0].as_py()
    got = {(f["level"], f["at"]): f["hash"] for f in fetched["nodes"][0].as_py() or []}
    nodes, first, columns = rows["hash"].to_pylist(), int(at[0]), []
    for level in range(depth(leaves)):
        # Known here: [first, first + len(nodes)); all else was fetched.
        here = dict(zip(range(first, first + len(nodes)), nodes))
        for (lv, p), value in got.items():
            if lv == level:
                here[p] = value
        beside = {p: here.get(p ^ 1) for p in range(first, first + len(nodes))}
        columns.append([beside[p] for p in (at >> level).tolist()])
        span = [here[p] for p in range(first & ~1, first + len(nodes) + 1) if p in here]
        nodes, first = parents(span), first >> 1
    above, root = fetched["above"][0].as_py() or [], fetched["root"][0].as_py() or nodes[0]
    proofs = [[*own, *above] for own in zip(*columns)] if columns else [above] * len(at)
    last = [proofs, [len(columns)] * len(at), nodes[:1] * len(at), [root] * len(at)]
    for field, values in zip(_ARROW_PROOF, last):
        rows = rows.append_column(field, pa.array(values, field.type))
    return rows


_PROOF = "proof array<string>, depth int, subroot string, root string"
_ARROW_PROOF = pa.schema(
    [("proof", pa.list_(pa.string())), ("depth", pa.int32()), ("subroot", pa.string()), ("root", pa.string())]
)


def _forest(placed: DataFrame, most: int, levels: int) -> tuple[DataFrame, DataFrame]:
    """Leaf partitions with what they lack, and all nodes from their roots up, both written.

    ``placed`` has ``tree, leaves, pos, hash``; ``most`` is the largest number of leaves of a tree.
    """
    slim = placed.select("tree", "leaves", "pos", "hash", F.shiftright("pos", levels).alias("part"))
    roots = stored(slim.groupBy("tree", "part").applyInArrow(lambda t: partition_root(t, levels), _ROOTS))
    nodes = [roots.drop("lacks")]
    base = nodes[0]
    for level in range(levels, depth(most), levels):
        # Trees that have ended have no nodes on this level.
        run = base.where(F.col("level") == level).withColumn("run", F.shiftright("pos", levels))
        base = stored(run.groupBy("tree", "run").applyInArrow(lambda t: upper_nodes(t, levels), _NODES))
        nodes.append(base)
    whole = nodes[0]
    for more in nodes[1:]:
        whole = whole.unionByName(more)
    return roots, whole


def _proofs(
    placed: DataFrame, roots: DataFrame, nodes: DataFrame, levels: int, above: DataFrame | None = None
) -> DataFrame:
    """``placed`` with ``proof, depth, subroot, root``; ``above`` has what follows by tree: ``t, above, root``."""
    # The root of a partition stands where the partition does: on its level, or alone in its tree.
    wanted = roots.select("tree", F.col("pos").alias("part"), F.explode("lacks").alias("lack")).select(
        "tree", "part", "lack.*"
    )
    known = nodes.select(F.col("tree").alias("t"), F.col("level").alias("lv"), F.col("pos").alias("p"), "hash")
    on = (F.col("tree") == F.col("t")) & (F.col("level") == F.col("lv")) & (F.col("at") == F.col("p"))
    # At most one node per level and partition.
    fetched = wanted.join(known, on).groupBy("tree", "part").agg(
        F.collect_list(F.struct("level", "at", "hash")).alias("nodes")
    )
    # Partitions that lack nothing are there too.
    every = roots.select("tree", F.col("pos").alias("part")).join(fetched, ["tree", "part"], "left")
    if above is None:
        every = every.withColumns(
            {"above": F.lit(None).cast("array<string>"), "root": F.lit(None).cast("string")}
        )
    else:
        every = every.join(above, F.col("tree") == F.col("t")).drop("t")
    rows = placed.withColumn("part", F.shiftright("pos", levels))
    schema = T.StructType([*rows.schema.fields, *T.StructType.fromDDL(_PROOF).fields])
    left, right = rows.groupBy("tree", "part"), every.groupBy("tree", "part")
    return left.cogroup(right).applyInArrow(lambda a, b: expanded(a, b), schema).drop("part")


def manifest(
    docs: DataFrame, leaf: Column, group: str, order: str, *, levels: int = LEVELS, **carried: Column
) -> DataFrame:
    """The proof of every row of ``docs`` in a tree of trees.

    ``leaf`` is the hex digest of a row. Rows with equal ``group`` (null too) are a tree, ascending
    by ``order`` (null first), then by digest. Trees ascend by ``group`` (null first) and their roots are
    the leaves of the tree whose root stands for the dataset. Every two consecutive nodes become the
    digest of their hex texts, a last one by itself likewise, until one remains; a lone leaf is its root.

    Returns a row per row: ``group``, ``order``, the ``carried`` columns, ``hash`` (the leaf), ``tree`` and
    ``pos`` (places from 0), ``depth`` (levels of its tree), ``proof`` (a sibling per level up to ``root``,
    null where a node stands alone), ``subroot`` and ``root``. Repeated rows are leaves of their own.
    No rows in, none out. Other columns of ``docs`` play no part, whatever their names.
    """
    shipped(docs.sparkSession)
    extra = F.struct(*(c.alias(n) for n, c in carried.items())) if carried else F.lit(None).cast("string")
    rows = docs.select(
        F.col(group).alias("group"), F.col(order).alias("order"), leaf.alias("hash"), extra.alias("extra"),
        F.monotonically_increasing_id().alias("tie"),
    )
    ranked, runs = positions(rows, ["group"], ["order", "hash", "tie"])
    # One row per tree: how many leaves, and its place among the trees.
    trees, _ = positions(runs.groupBy("group").agg(F.sum("size").alias("leaves")), [], ["group"])
    trees = stored(trees.select("group", "leaves", F.col("pos").alias("tree"), F.col("n").alias("trees")))
    sizes = trees.agg(F.max("leaves"), F.count("*")).first()
    most, count = sizes[0] or 0, sizes[1]
    named = trees.select(F.col("group").alias("g"), F.col("leaves"), "tree")
    # Joined to the runs of a partition first, so that a tree with most rows is not one key.
    tree_of = runs.join(named, F.col("group").eqNullSafe(F.col("g"))).select(
        F.col("group").alias("g"), F.col("range").alias("r"), "tree", "leaves"
    )
    placed = ranked.join(tree_of, (F.col("range") == F.col("r")) & F.col("group").eqNullSafe(F.col("g")))
    placed = stored(placed.select("group", "order", "extra", "hash", "tree", "leaves", "pos"))
    roots, nodes = _forest(placed, most, levels)
    subroots = nodes.where(F.col("level") == _depth(F.col("leaves"))).select(
        F.lit(0).cast("long").alias("tree"), F.lit(count).cast("long").alias("leaves"),
        F.col("tree").alias("pos"), "hash",
    )
    subroots = stored(subroots)
    top = _proofs(subroots, *_forest(subroots, count, levels), levels)
    above = stored(top.select(F.col("pos").alias("t"), F.col("proof").alias("above"), "root"))
    return _proofs(placed, roots, nodes, levels, above).select(
        F.col("group").alias(group), F.col("order").alias(order), *(F.col(f"extra.{n}").alias(n) for n in carried),
        "hash", "tree", "pos", "depth", "proof", "subroot", "root",
    )


def _depth(leaves: Column) -> Column:
    """``depth`` as an expression: binary digits of one less."""
    return F.when(leaves <= 1, F.lit(0)).otherwise(F.length(F.bin(leaves - 1)))


def folded(leaf: Column) -> Column:
    """The root that ``leaf`` gives with the siblings of a row of ``manifest``."""
    side = lambda i: F.when(i < F.col("depth"), F.getbit("pos", i)).otherwise(
        F.getbit("tree", F.greatest(i - F.col("depth"), F.lit(0)))
    )
    steps = F.transform("proof", lambda h, i: F.struct(h.alias("hash"), (side(i) == 1).alias("right")))

    def step(node: Column, s: Column) -> Column:
        other = F.coalesce(s["hash"], F.lit(""))
        return F.sha2(F.when(s["right"], F.concat(other, node)).otherwise(F.concat(node, other)), 256)

    return F.aggregate(steps, leaf, step)
