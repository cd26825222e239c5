"""Embedding near-dedup with navigable small-world graphs per shard."""

from __future__ import annotations

import math
import pickle

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import checkpointed
from .components import connected_components
from .repeats import NO_ID
from .sequences import mixed

#: Vectors in a graph, and queries in a task, about.
SHARD = 8192
QUERIES = 2048
COSINE = 0.93
#: Links per node and layer (twice as many on the lowest), and the width of the first beam.
NEIGHBOURS = 12
BEAM = 64
#: Room in a node's list beyond its links, so that it is pruned seldom.
SPARE = 16
#: Queries that a task compares with brute force (twice: of all, and of those with links), and the
#: share of their links that must be found.
AUDITED = 48
RECALL = 0.995
#: Single-precision cosines this close to the limit are checked.
_SLACK = 1e-3
#: A full beam is widened over all nodes that are at most this far below the limit.
MARGIN = 0.02


def unit(rows: np.ndarray) -> np.ndarray:
    rows = rows / np.abs(rows).max(axis=1, keepdims=True)
    return rows / np.linalg.norm(rows, axis=1, keepdims=True)


class SmallWorld:
    """A hierarchical navigable small world; batches of queries walk it in step."""

    def __init__(self, vectors: np.ndarray, ids: np.ndarray, neighbours: int = NEIGHBOURS, beam: int = BEAM):
        self.vectors = vectors.astype(np.float32)
        self.neighbours = neighbours
        n = len(vectors)
        share = (mixed(ids.astype(np.uint64)) >> np.uint64(11)).astype(np.float64) / (1 << 53)
        self.levels = np.minimum(-np.log(share + 2.0**-54) / math.log(neighbours), 8).astype(int)
        layers = range(int(self.levels.max(initial=0)) + 1)
        self.links = [np.full((n, neighbours * (1 if layer else 2) + SPARE), -1, np.int32) for layer in layers]
        self.used = [np.zeros(n, np.int32) for _ in layers]
        self.entry, self.top = -1, -1
        order = np.argsort(mixed(ids.astype(np.uint64) + np.uint64(1)), kind="stable")
        done = 0
        while done < n:
            size = min(256, max(32, done // 4))
            self._insert(order[done : done + size], beam)
            done += size
        self._reach_all()
        del self.used

    def _reach_all(self) -> None:
        """Pruning may leave a node that no other leads to: its nearest node with room gets a link."""
        n = len(self.vectors)
        links = self.links[0] = np.concatenate((self.links[0], np.full((n, 8), -1, np.int32)), axis=1)
        reached, wave = np.zeros(n, bool), np.array([self.entry])
        while True:
            while len(wave):
                reached[wave] = True
                wave = np.unique(links[wave])
                wave = wave[(wave >= 0) & ~reached[wave]]
            lost = np.flatnonzero(~reached)
            if not len(lost):
                return
            room = np.flatnonzero(reached & (links[:, -1] < 0))
            if not len(room):
                links = self.links[0] = np.concatenate((links, np.full((n, 8), -1, np.int32)), axis=1)
                continue
            node = room[np.argmax(self.vectors[room] @ self.vectors[lost[0]])]
            links[node, np.flatnonzero(links[node] < 0)[0]] = lost[0]
            wave = lost[:1]

    def beam(self, layer: int, queries: np.ndarray, entries: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
        """Best ``width`` nodes for each query (-1 where there are fewer), falling by cosine."""
        q, links, every = len(queries), self.links[layer], np.arange(len(queries))
        nodes = np.full((q, width), -1, np.int64)
        cosines = np.full((q, width), -np.inf, np.float32)
        open_ = np.zeros((q, width), bool)
        seen = np.zeros((q, len(self.vectors) + 1), bool)
        seen[:, -1] = True  # where -1 points
        fresh, rows = entries, every
        while True:
            first = np.where(seen[rows[:, None], fresh], -1, fresh)
            # The same node may come from several neighbours.
            at = np.sort(first, axis=1)
            at[:, 1:][at[:, 1:] == at[:, :-1]] = -1
            seen[rows[:, None], at] = True
            near = np.einsum("abd,ad->ab", self.vectors[at], queries[rows])
            near[at < 0] = -np.inf
            all_nodes = np.concatenate((nodes[rows], at), axis=1)
            all_near = np.concatenate((cosines[rows], near), axis=1)
            all_open = np.concatenate((open_[rows], at >= 0), axis=1)
            best = np.argsort(-all_near, axis=1, kind="stable")[:, :width]
            nodes[rows] = np.take_along_axis(all_nodes, best, 1)
            cosines[rows] = np.take_along_axis(all_near, best, 1)
            open_[rows] = np.take_along_axis(all_open, best, 1) & (nodes[rows] >= 0)
            rows = every[open_.any(axis=1)]
            if not len(rows):
                return nodes, cosines
            # Open the best few of each beam at once.
            few = min(4, width)
            pick = np.argsort(~open_[rows], axis=1, kind="stable")[:, :few]
            chosen = np.where(np.take_along_axis(open_[rows], pick, 1), np.take_along_axis(nodes[rows], pick, 1), -1)
            open_[rows[:, None], pick] = False
            fresh = np.where(chosen[:, :, None] >= 0, links[chosen], -1).reshape(len(rows), -1)

    def flood(self, query: np.ndarray, nodes: np.ndarray, least: float) -> np.ndarray:
        """All nodes of at least that cosine that are reached from ``nodes`` over such nodes."""
        seen = np.zeros(len(self.vectors) + 1, bool)
        seen[-1] = True
        seen[nodes] = True
        found, wave = [nodes], nodes
        while len(wave):
            near = np.unique(self.links[0][wave])
            near = near[~seen[near]]
            seen[near] = True
            wave = near[self.vectors[near] @ query >= least]
            found.append(wave)
        return np.concatenate(found)

    def search(self, queries: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
        entries = np.full((len(queries), 1), self.entry)
        for layer in range(self.top, 0, -1):
            entries = self.beam(layer, queries, entries, 4)[0]
        return self.beam(0, queries, entries, width)

    def _spread(self, nodes: np.ndarray, cosines: np.ndarray, most: int) -> np.ndarray:
        """The nearest nodes, half of ``most``, then near ones that lead elsewhere.

        The first half keeps groups of near copies together, however alike they are; the second
        takes nodes that are not nearer to a chosen one than to the centre.
        """
        order = np.argsort(-cosines, kind="stable")
        nodes, cosines = nodes[order], cosines[order]
        half = most // 2
        if len(nodes) <= half:
            return nodes
        among = self.vectors[nodes] @ self.vectors[nodes].T
        blocked = (among[:half] > cosines).any(axis=0)
        chosen = list(range(half))
        for i in range(half, len(nodes)):
            if not blocked[i]:
                chosen.append(i)
                if len(chosen) == most:
                    break
                blocked |= among[i] > cosines
        return nodes[chosen]

    def _tie(self, layer: int, node: int, nodes: np.ndarray, cosines: np.ndarray) -> None:
        links, used = self.links[layer], self.used[layer]
        width = links.shape[1]
        for other in self._spread(nodes, cosines, self.neighbours).tolist():
            for a, b in ((node, other), (other, node)):
                if used[a] == width:
                    row = links[a].copy()
                    kept = self._spread(row, self.vectors[row] @ self.vectors[a], width - SPARE)
                    links[a] = -1
                    links[a, : len(kept)] = kept
                    used[a] = len(kept)
                links[a, used[a]] = b
                used[a] += 1

    def _insert(self, batch: np.ndarray, width: int) -> None:
        queries = self.vectors[batch]
        top = int(self.levels[batch].max())
        entries = np.full((len(batch), 1), self.entry)
        peers = queries @ queries.T
        found = {}
        for layer in range(self.top, -1, -1):
            found[layer] = self.beam(layer, queries, entries, width if layer <= top else 4)
            entries = found[layer][0][:, :4]
        for layer in range(top, -1, -1):
            here = np.flatnonzero(self.levels[batch] >= layer)
            for i in here.tolist():
                earlier = here[here < i]
                nodes, cosines = batch[earlier], peers[i][earlier]
                if layer in found:
                    old = found[layer][0][i] >= 0
                    nodes = np.concatenate((found[layer][0][i][old], nodes))
                    cosines = np.concatenate((found[layer][1][i][old], cosines))
                if len(nodes):
                    self._tie(layer, int(batch[i]), nodes, cosines)
        if top > self.top:
            self.top = top
            self.entry = int(batch[np.argmax(self.levels[batch])])


def links_of(
    graph: SmallWorld, vectors: np.ndarray, queries: np.ndarray, cosine: float, recall: float = RECALL
) -> tuple[list[np.ndarray], float, int]:
    """Members that each query links to, the recall of the audit, and the width it took.

    A beam whose worst entry still links is widened for its query until it holds all that is
    connected to it above the limit. The audit compares some queries and some of those with links,
    evenly spread, with all members; below ``recall`` all beams are widened.
    """
    n = len(vectors)
    width = min(BEAM, n)
    while True:
        out: list[np.ndarray] = []
        # Beams and visits of a portion stay within some ten megabytes.
        portion = max(16, min(512, (1 << 22) // (n + 64 * width)))
        for a in range(0, len(queries), portion):
            some = queries[a : a + portion]
            nodes, cosines = graph.search(some.astype(np.float32), width)
            for query, row, near in zip(some, nodes, cosines, strict=True):
                row = row[near >= cosine - _SLACK]
                if len(row) == width < n:
                    row = graph.flood(query.astype(np.float32), row, cosine - MARGIN)
                out.append(np.sort(row[vectors[row] @ query >= cosine]))
        linked = np.flatnonzero([len(row) > 1 for row in out])
        few = np.linspace(0, len(queries) - 1, AUDITED).astype(int)
        few = np.union1d(few, linked[np.linspace(0, len(linked) - 1, AUDITED).astype(int)] if len(linked) else few)
        exact = queries[few] @ vectors.T >= cosine
        expected = int(exact.sum())
        hits = sum(int(exact[k][out[i]].sum()) for k, i in enumerate(few.tolist()))
        if hits >= recall * expected or width >= n:
            return out, hits / expected if expected else 1.0, width
        width = min(2 * width, n)


def vector_groups(
    vectors: DataFrame,
    cosine: float = COSINE,
    id_col: str = "vec_id",
    vector_col: str = "embedding",
    label_col: str = "label",
    shard: int = SHARD,
) -> DataFrame:
    """One row per input row: ``id_col`` (long), n_links, component_id, kept.

    Vectors of one label link from ``cosine`` on, in double precision. Equal vectors of a label
    count as one of that weight. Each label is dealt into shards of about ``shard`` vectors, a
    graph is built for each and stored, and all vectors of the label ask every shard, in blocks.
    n_links sums the weights of what they link to; only links that join components are moved on.
    kept says that the id is the smallest of its component.

    A vector links with nothing if it is null, empty or zero, holds null or non-finite numbers, or
    has no label or no id; vectors of different length do not link. Then component_id is its own
    id, and kept is true; without an id both are null. Rows that repeat an id are one node whose
    rows count each. No rows give none; other columns are ignored.
    """
    x = vectors.select(
        F.col(id_col).cast("long").alias("id"), F.col(label_col).alias("label"), F.col(vector_col).cast("array<double>").alias("v")
    )
    finite = F.forall("v", lambda c: F.coalesce(F.abs(c) < float("inf"), F.lit(False)))
    usable = F.coalesce(
        F.col("id").isNotNull() & F.col("label").isNotNull() & finite & F.exists("v", lambda c: c != 0), F.lit(False)
    )
    x = x.withColumn("usable", usable)
    keys = ["label", "dim", "shard", "part"]
    classes = checkpointed(
        x.where("usable").groupBy("label", "v").agg(F.min("id").alias("first"), F.count("*").alias("weight"))
        .withColumn("dim", F.size("v"))
    )
    sizes = classes.groupBy("label", "dim").agg(
        F.ceil(F.count("*") / shard).cast("int").alias("shards"), F.ceil(F.count("*") / QUERIES).cast("int").alias("parts")
    )
    dealt = classes.join(sizes, ["label", "dim"])
    members = dealt.withColumn("shard", F.pmod(F.xxhash64("first"), F.col("shards")).cast("int"))

    def build(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("first")
        ids = pdf["first"].to_numpy(np.int64)
        rows = unit(np.stack(pdf["v"].to_numpy()))
        graph = SmallWorld(rows, ids)
        head = pdf.iloc[:1]
        blob = pickle.dumps((ids, pdf["weight"].to_numpy(np.int64), rows, graph))
        return head[["label", "dim", "shard", "parts"]].assign(graph=[blob])

    label_type = dict(classes.dtypes)["label"]
    graphs = checkpointed(
        members.select("label", "dim", "shard", "parts", "first", "weight", "v")
        .groupBy("label", "dim", "shard")
        .applyInPandas(build, f"label {label_type}, dim int, shard int, parts int, graph binary")
    )
    asked = graphs.withColumn("part", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
    queries = (
        dealt.withColumn("part", F.pmod(F.xxhash64("first", F.lit(1)), F.col("parts")).cast("int"))
        .withColumn("shard", F.explode(F.sequence(F.lit(0), F.col("shards") - 1)))
        .select(*keys, "first", "v")
    )

    def ask(pdf: pd.DataFrame, stored: pd.DataFrame) -> pd.DataFrame:
        columns = ["id", "n", "a"]
        if not len(pdf) or not len(stored):
            return pd.DataFrame([], columns=columns)
        ids, weights, rows, graph = pickle.loads(stored["graph"].iloc[0])
        mine = pdf["first"].to_numpy(np.int64)
        found, _, _ = links_of(graph, rows, unit(np.stack(pdf["v"].to_numpy())), cosine)
        parent: dict[int, int] = {}

        def root(node: int) -> int:
            while (up := parent.setdefault(node, node)) != node:
                node = parent[node] = parent[up]
            return node

        out = []
        for me, near in zip(mine.tolist(), found, strict=True):
            others = near[ids[near] != me]
            if not len(others):
                continue
            out.append((me, int(weights[others].sum()), None))
            for other in ids[others].tolist():
                a, b = root(me), root(other)
                if a != b:
                    parent[max(a, b)] = min(a, b)
                    out.append((me, 0, other))
        result = pd.DataFrame(out, columns=columns)
        return result.astype({"id": "int64", "n": "int64", "a": "Int64"})

    found = checkpointed(
        queries.groupBy(*keys).cogroup(asked.select(*keys, "graph").groupBy(*keys)).applyInPandas(ask, "id long, n long, a long")
    )
    counts = found.groupBy("id").agg(F.sum("n").alias("others"))
    joined = connected_components(found.where("a is not null").select(F.col("id").alias("b"), "a"))
    judged = (
        classes.join(counts, F.col("first") == F.col("id"), "left").drop("id")
        .join(joined, F.col("first") == F.col("node"), "left")
        .select(
            F.col("label").alias("l"), F.col("v").alias("w"),
            (F.coalesce("others", F.lit(0)) + F.col("weight") - 1).alias("links"),
            F.coalesce("component", "first").alias("group"),
        )
    )
    on = F.col("usable") & (F.col("label") == F.col("l")) & (F.col("v") == F.col("w"))
    component = F.coalesce("group", "id")
    return x.join(judged, on, "left").select(
        F.col("id").alias(id_col),
        F.coalesce("links", F.lit(0)).cast("long").alias("n_links"),
        component.alias("component_id"),
        (F.col("id") == component).alias("kept"),
    )
