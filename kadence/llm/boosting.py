"""Gradient-boosted trees for two classes, with numpy; fitted to arrays, or to all rows of a DataFrame by Spark."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
from pyspark import StorageLevel
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from kadence.workspace import checkpointed

#: Slopes are summed as whole numbers of this part of one, so no order of rows changes a sum.
UNIT = 2.0**28
#: Different binned rows that are kept together as one block of arrays.
BLOCK = 50_000

#: Binned rows, how many rows are equal to each, and how many of these are right.
Block = tuple[np.ndarray, np.ndarray, np.ndarray]


def _leaves(tree: list, binned: np.ndarray) -> np.ndarray:
    """The node of ``tree`` in which each binned row ends."""
    at = np.zeros(len(binned), np.int64)
    feature, cut, left, right = (np.array([node[i] for node in tree]) for i in range(4))
    rows = np.flatnonzero(feature[at] >= 0)
    while len(rows):
        node = at[rows]
        at[rows] = np.where(binned[rows, feature[node]] <= cut[node], left[node], right[node])
        rows = rows[feature[at[rows]] >= 0]
    return at


def _sums(block: Block, start: float, trees: list, tree: list, frontier: list[int], size: int) -> np.ndarray:
    """Slopes and bends of the rows of ``block`` by node of ``frontier``, feature and bin, in units."""
    binned, n, right = block
    margin = np.full(len(binned), start)
    for done in trees:
        margin += np.array([node[4] for node in done])[_leaves(done, binned)]
    p = 1 / (1 + np.exp(-margin))
    slope, bend = (np.rint(v * UNIT).astype(np.int64) for v in (right - n * p, n * p * (1 - p)))
    place = np.full(len(tree), -1)
    place[frontier] = np.arange(len(frontier))
    node = place[_leaves(tree, binned)]
    mine = np.flatnonzero(node >= 0)
    out = np.zeros((len(frontier), binned.shape[1], size, 2), np.int64)
    for feature in range(binned.shape[1]):
        np.add.at(out[:, feature, :, 0], (node[mine], binned[mine, feature]), slope[mine])
        np.add.at(out[:, feature, :, 1], (node[mine], binned[mine, feature]), bend[mine])
    return out


class BoostedTrees:
    """Shallow trees fitted one after the other to the gradient of the logistic loss.

    Splits are searched over quantiles of each feature; leaves take Newton steps. Everything is
    deterministic.
    """

    def __init__(self, rounds: int = 60, depth: int = 3, rate: float = 0.2, bins: int = 32, ridge: float = 1.0):
        self.rounds, self.depth, self.rate, self.bins, self.ridge = rounds, depth, rate, bins, ridge
        self.start, self.trees = 0.0, []

    def fit(self, x: np.ndarray, y: np.ndarray) -> BoostedTrees:
        cuts = [np.unique(np.quantile(column, np.linspace(0, 1, self.bins + 1)[1:-1])) for column in x.T]
        binned = np.stack([np.searchsorted(c, column, "left") for c, column in zip(cuts, x.T, strict=True)], axis=1)
        cells, at = np.unique(binned, axis=0, return_inverse=True)
        block = (cells, np.bincount(at).astype(float), np.bincount(at, y))
        return self._fit(cuts, float(y.mean()), lambda *work: _sums(block, *work))

    def fit_rows(self, rows: DataFrame) -> BoostedTrees:
        """Fit to all rows of ``x array<double>, y int``, as ``fit`` does to arrays.

        Rows are binned and equal ones counted once, by a shuffle; what is left is kept in blocks on the
        executors. A level of a tree is one pass over these, from which only sums by node, feature and bin come back.
        """
        n, right = rows.agg(F.count(F.lit(1)), F.sum("y")).first()
        cuts = self._cuts(rows, n)
        below = lambda cuts, value: F.size(F.filter(F.array(*map(F.lit, cuts)), lambda c: c < value))
        binned = F.array(*(below(c.tolist(), F.col("x")[i]) for i, c in enumerate(cuts)))
        cells = checkpointed(rows.groupBy(binned.alias("bins")).agg(F.count(F.lit(1)).alias("n"), F.sum("y").alias("y")))

        def blocks(rows: Iterator) -> Iterator[Block]:
            some: list = []
            for row in rows:
                some.append(row)
                if len(some) == BLOCK:
                    yield packed(some)
                    some = []
            if some:
                yield packed(some)

        def packed(some: list) -> Block:
            binned = np.array([r["bins"] for r in some], np.uint8 if self.bins <= 256 else np.int32)
            return binned, np.array([r["n"] for r in some], float), np.array([r["y"] for r in some], float)

        # As many tasks a pass as there are blocks, however many the shuffle dealt the rows over.
        dealt = cells.coalesce(-(-cells.count() // BLOCK)).rdd
        kept = dealt.mapPartitions(blocks).persist(StorageLevel.MEMORY_AND_DISK)
        self._fit(cuts, right / n, lambda *work: kept.map(lambda block: _sums(block, *work)).treeReduce(np.add))
        kept.unpersist()
        return self

    def _cuts(self, rows: DataFrame, n: int) -> list[np.ndarray]:
        """Quantiles of each feature over all rows, between neighbouring ranks as numpy takes them."""
        places = np.linspace(0, 1, self.bins + 1)[1:-1] * (n - 1)
        lows = np.floor(places).astype(np.int64)
        ranks = sorted({*lows.tolist(), *np.minimum(lows + 1, n - 1).tolist()})
        # Different values of a feature, counted; a feature is a window of these.
        counts = rows.select(F.posexplode("x").alias("feature", "value")).groupBy("feature", "value").agg(F.count(F.lit(1)).alias("n"))
        upto = F.sum("n").over(Window.partitionBy("feature").orderBy("value"))
        hit = F.filter(F.array(*map(F.lit, ranks)), lambda r: (r >= F.col("upto") - F.col("n")) & (r < F.col("upto")))
        found = counts.withColumn("upto", upto).select("feature", "value", hit.alias("ranks")).filter(F.size("ranks") > 0)
        at: dict[int, dict[int, float]] = {}
        for row in found.collect():
            at.setdefault(row["feature"], {}).update(dict.fromkeys(row["ranks"], row["value"]))
        cuts = []
        for feature in sorted(at):
            low = np.array([at[feature][r] for r in lows.tolist()])
            high = np.array([at[feature][r] for r in np.minimum(lows + 1, n - 1).tolist()])
            cuts.append(np.unique(low + (places - lows) * (high - low)))
        return cuts

    def _fit(self, cuts: list[np.ndarray], share: float, summed: Callable[..., np.ndarray]) -> BoostedTrees:
        """Grow trees level by level, from the sums that ``summed`` brings of all rows.

        A node is (feature, bin, left, right, value); a leaf has feature -1.
        """
        share = min(max(share, 1e-3), 1 - 1e-3)
        self.start = float(np.log(share / (1 - share)))
        size, trees = self.bins, []
        for _ in range(self.rounds):
            tree, frontier = [(-1, 0, 0, 0, 0.0)], [0]
            for level in range(self.depth):
                sums = summed(self.start, trees, tree, frontier, size) / UNIT
                following = []
                for at, mine in zip(frontier, sums, strict=True):
                    if level == 0:
                        tree[0] = (-1, 0, 0, 0, self._step(*mine[0].sum(axis=0)))
                    split = self._split(mine, cuts)
                    if split:
                        feature, k, left, right = split
                        tree[at] = (feature, k, len(tree), len(tree) + 1, 0.0)
                        following += [len(tree), len(tree) + 1]
                        tree += [(-1, 0, 0, 0, self._step(*left)), (-1, 0, 0, 0, self._step(*right))]
                frontier = following
                if not frontier:
                    break
            trees.append(tree)
        self.trees = [
            [(None, v) if f < 0 else (f, float(cuts[f][k]), a, b) for f, k, a, b, v in tree] for tree in trees
        ]
        return self

    def _step(self, g: float, h: float) -> float:
        return float(self.rate * g / (h + self.ridge))

    def _split(self, sums: np.ndarray, cuts: list[np.ndarray]) -> tuple | None:
        """Feature, bin and the sums on both sides of the best split, if one gains anything."""
        g, h = sums[0].sum(axis=0)
        best, found = 1e-6, None
        for feature, c in enumerate(cuts):
            gs, hs = np.cumsum(sums[feature], axis=0)[: len(c)].T
            if len(c):
                gain = gs**2 / (hs + self.ridge) + (g - gs) ** 2 / (h - hs + self.ridge) - g**2 / (h + self.ridge)
                k = int(np.argmax(gain))
                if gain[k] > best:
                    best, found = float(gain[k]), (feature, k, (gs[k], hs[k]), (g - gs[k], h - hs[k]))
        return found

    def score(self, row: list[float]) -> float:
        margin = self.start
        for tree in self.trees:
            node = tree[0]
            while node[0] is not None:
                node = tree[node[2] if row[node[0]] <= node[1] else node[3]]
            margin += node[1]
        return float(1 / (1 + np.exp(-margin)))
