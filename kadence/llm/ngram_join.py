"""N-gram Jaccard join by T-occurrence search with DivideSkip."""

from __future__ import annotations

import hashlib
import heapq
import math
from collections import Counter

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import checkpointed, tidy
from .components import connected_components
from .repeats import BLOCK_BYTES, NO_ID, text_blocks
from .sequences import SLICE, Rolling, words

#: Words of a shingle.
SHINGLE = 4
#: Documents link from this similarity on, in percent.
PERCENT = 85
#: Shingles whose frequency is counted: hashes below this, a third of all.
_COUNTED = np.uint64((1 << 64) // 3)
#: Texts and shingles of a chunk of a candidate group; two chunks are searched in one task.
CHUNK_TEXTS = 1024
CHUNK_SHINGLES = 1 << 20
#: Cost of merging against probing, in the rule for the number of long lists.
MU = 0.0085
#: Postings from which short lists are merged by counting instead of on a heap.
DENSE = 4096


def shingle_set(text: bytes, size: int = SHINGLE) -> np.ndarray:
    """Sorted hashes of the distinct shingles; a shorter text is one shingle, without words none."""
    _, _, hashes = words(text, lower=True)
    if len(hashes) < size:
        return Rolling(hashes).grams(len(hashes)) if len(hashes) else hashes
    parts = [
        Rolling(hashes[i : i + SLICE + size - 1]).grams(size) for i in range(0, len(hashes) - size + 1, SLICE)
    ]
    return np.unique(np.concatenate(parts))


def needed(n: int, percent: int = PERCENT) -> int:
    """Shingles that a set of ``n`` shares at least with any set it links to."""
    return -(-percent * n // 100)


class _Groups:
    """Sets of a block: equal ones once, with the tokens whose frequency is counted."""

    def __init__(self, pdf: pd.DataFrame, shards: int, size: int):
        self.ids = pdf["id"].to_numpy(np.int64)
        sets = [shingle_set(t, size) for t in pdf["text"]]
        self.sizes = np.array([len(s) for s in sets], np.int64)
        self.keys = [
            hashlib.blake2b(s.tobytes(), digest_size=16).digest() if len(s) and i != NO_ID else None
            for s, i in zip(sets, self.ids.tolist(), strict=True)
        ]
        first: dict[bytes, int] = {}
        for row in np.argsort(self.ids, kind="stable").tolist():
            if self.keys[row] is not None:
                first.setdefault(self.keys[row], row)
        self.rows = sorted(first.values(), key=lambda r: self.keys[r])
        self.sets = [sets[r] for r in self.rows]
        counted = [s[s < _COUNTED] for s in self.sets]
        flat = np.concatenate(counted) if counted else np.empty(0, np.uint64)
        full = (flat >> np.uint64(32)) % np.uint64(shards) << np.uint64(32) | flat & np.uint64(0xFFFFFFFF)
        self.tokens, self.of, self.times = np.unique(full, return_inverse=True, return_counts=True)
        self.edges = np.cumsum([0, *map(len, counted)])


def _search(sets: list[np.ndarray], percent: int) -> list[tuple[int, int]]:
    """Links that join the sets (sorted by size) to components, by T-occurrence search.

    For a query of n shingles, a larger set shares at least T of them. Its longest inverted lists,
    fewer than T, are put aside; the short ones are merged, and sets met T minus their number
    times are probed for the shingles of the long lists by binary search. Sets that are in one
    component already need no probe.
    """
    sizes = np.array([len(s) for s in sets])
    tokens = np.concatenate(sets)
    owner = np.repeat(np.arange(len(sets)), sizes)
    order = np.argsort(tokens, kind="stable")
    postings = owner[order]
    starts = np.flatnonzero(np.concatenate(([True], np.diff(tokens[order]) != 0)))
    lengths = np.diff(np.append(starts, len(order)))
    list_of = np.empty(len(order), np.int64)
    list_of[order] = np.repeat(np.arange(len(starts)), lengths)
    edges = np.cumsum([0, *sizes])
    parent = list(range(len(sets)))

    def root(x: int) -> int:
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    links, groups = [], len(sets)
    for x in range(len(sets)):
        n = int(sizes[x])
        t = -(-2 * percent * n // (100 + percent))
        lists = list_of[edges[x] : edges[x + 1]]
        some = lengths[lists] > 1
        if int(some.sum()) < t:
            continue
        shared, elements = lists[some], sets[x][some]
        by_length = np.argsort(lengths[shared], kind="stable")
        longest = int(lengths[shared[by_length[-1]]])
        n_long = min(t - 1, int(t / (MU * math.log2(longest) + 1)))
        cut = len(by_length) - n_long
        short, long = shared[by_length[:cut]], np.sort(elements[by_length[cut:]])
        if int(lengths[short].sum()) <= DENSE:
            merged = heapq.merge(*(postings[a : a + k].tolist() for a, k in zip(starts[short].tolist(), lengths[short].tolist(), strict=True)))
            met = Counter(merged)
            found = [(y, c) for y, c in met.items() if y > x and c >= t - n_long]
        else:
            met = np.bincount(np.concatenate([postings[a : a + k] for a, k in zip(starts[short], lengths[short], strict=True)]))
            found = [(y, int(met[y])) for y in (np.flatnonzero(met[x + 1 :] >= t - n_long) + x + 1).tolist()]
        for y, c in found:
            if sizes[y] * percent > 100 * n:
                continue
            a, b = root(x), root(y)
            if a == b:
                continue
            at = np.minimum(np.searchsorted(sets[y], long), len(sets[y]) - 1)
            both = c + int(np.count_nonzero(sets[y][at] == long))
            if (100 + percent) * both >= percent * (n + int(sizes[y])):
                parent[max(a, b)] = min(a, b)
                links.append((x, y))
                groups -= 1
        if groups == 1:
            break
    return links


def jaccard_groups(
    docs: DataFrame,
    percent: int = PERCENT,
    shingle: int = SHINGLE,
    id_col: str = "doc_id",
    text_col: str = "text",
    block_bytes: int = BLOCK_BYTES,
    unique_ids: bool = False,
) -> DataFrame:
    """One row per input row: ``id_col`` (long), n_shingles, component_id.

    Documents link when 100 * shared >= ``percent`` * united distinct shingles; component_id is
    the smallest id reachable by links, itself included. No link is missed:

    1. Equal sets are one. A third of all shingles (by hash) is counted across the corpus. A set
       with more shingles that stand nowhere else than a link allows has no links.
    2. The others meet by their rarest shingles, as many as guarantee that linked sets share one.
       Sets that meet, directly or over others, are a candidate group.
    3. Each candidate group is searched in a task (see ``_search``), large ones chunk by chunk, two at a time.
       Only links that join components leave the task.

    A text with fewer words is one shingle; null, empty and blank texts have none and link with
    nothing, and so does a row without an id, whose component is null. Rows that repeat an id
    are one node. No rows give none; other columns are ignored. ``unique_ids`` says that no id is null
    or repeated, which the dealing into blocks then relies on, though not the result.
    """
    blocks, n = text_blocks(docs, id_col, text_col, block_bytes, unique_ids)

    def tell(pdf: pd.DataFrame) -> pd.DataFrame:
        block = int(pdf["block"].iloc[0])
        groups = _Groups(pdf, n, shingle)
        shard = (groups.tokens >> np.uint64(32)).astype(np.int64)
        cuts = np.flatnonzero(np.diff(shard, prepend=-1))
        rows = [
            (int(shard[a]), block, (groups.tokens[a:b] & np.uint64(0xFFFFFFFF)).astype(np.uint32).tobytes(), np.minimum(groups.times[a:b], 255).astype(np.uint8).tobytes())
            for a, b in zip(cuts, [*cuts[1:], len(shard)], strict=False)
        ]
        return pd.DataFrame(rows, columns=["shard", "block", "tokens", "times"])

    def count(pdf: pd.DataFrame) -> pd.DataFrame:
        tokens = np.concatenate([np.frombuffer(t, np.uint32) for t in pdf["tokens"]])
        times = np.concatenate([np.frombuffer(t, np.uint8) for t in pdf["times"]]).astype(np.int64)
        _, of = np.unique(tokens, return_inverse=True)
        total = np.bincount(of, weights=times)
        # 0 for a single place, then steps of a quarter power of two.
        code = np.minimum(255, np.ceil(4 * np.log2(total))).astype(np.uint8)[of]
        edges = np.cumsum([0, *(len(t) // 4 for t in pdf["tokens"])])
        return pdf[["block", "shard"]].assign(codes=[code[a:b].tobytes() for a, b in zip(edges, edges[1:], strict=False)])

    def screen(pdf: pd.DataFrame, counted: pd.DataFrame) -> pd.DataFrame:
        columns = ["id", "n_shingles", "set_key", "prefix", "shingles"]
        if not len(pdf):
            return pd.DataFrame([], columns=columns)
        groups = _Groups(pdf, n, shingle)
        by_shard = counted.sort_values("shard")["codes"]
        codes = np.frombuffer(b"".join(by_shard), np.uint8)[groups.of]
        prefix: list = [None] * len(pdf)
        shingles: list = [None] * len(pdf)
        for g, row in enumerate(groups.rows):
            mine, code = groups.sets[g], codes[groups.edges[g] : groups.edges[g + 1]]
            spare = len(mine) - needed(len(mine), percent)
            if np.count_nonzero(code == 0) > spare:
                continue
            # The global order: counted shingles by frequency, then the others; both by hash.
            rare = np.concatenate((np.argsort(code, kind="stable"), np.arange(len(code), len(mine))))
            prefix[row] = mine[rare[: spare + 1]].view(np.int64).tolist()
            shingles[row] = mine.tobytes()
        return pd.DataFrame(
            {"id": groups.ids, "n_shingles": groups.sizes, "set_key": groups.keys, "prefix": prefix, "shingles": shingles}
        )

    def search(pdf: pd.DataFrame) -> pd.DataFrame:
        sets = [np.frombuffer(s, np.uint64) for s in pdf["shingles"]]
        ids = pdf["id"].tolist()
        order = sorted(range(len(sets)), key=lambda i: (len(sets[i]), ids[i]))
        links = _search([sets[i] for i in order], percent)
        return pd.DataFrame([(ids[order[a]], ids[order[b]]) for a, b in links], columns=["a", "b"])

    told = blocks.groupBy("block").applyInPandas(tidy(tell), "shard long, block long, tokens binary, times binary")
    counted = told.groupBy("shard").applyInPandas(tidy(count), "block long, shard long, codes binary")
    rows = checkpointed(
        blocks.groupBy("block").cogroup(counted.groupBy("block"))
        .applyInPandas(tidy(screen), "id long, n_shingles long, set_key binary, prefix array<long>, shingles binary")
    )

    classes = rows.where("set_key is not null").groupBy("set_key").agg(F.min("id").alias("first"))
    carried = rows.where("shingles is not null")
    # Of equal sets in several blocks, the row of the smallest id goes on.
    keep = classes.select(F.col("set_key").alias("k"), "first")
    own = carried.join(keep, (F.col("set_key") == F.col("k")) & (F.col("id") == F.col("first")), "left_semi")

    places = own.select("id", F.explode("prefix").alias("token"))
    meet = places.groupBy("token").agg(F.min("id").alias("hub"), F.count("*").alias("n")).where("n > 1")
    ties = places.join(meet.drop("n"), "token").where("id <> hub").select(F.col("id").alias("a"), F.col("hub").alias("b"))
    groups = checkpointed(connected_components(ties))
    chunk_n = F.greatest(
        F.ceil(F.count("*") / CHUNK_TEXTS), F.ceil(F.sum("n_shingles") / CHUNK_SHINGLES)
    )
    sized = rows.join(groups, rows["id"] == groups["node"]).where("shingles is not null")
    chunks = sized.groupBy("component").agg(chunk_n.cast("int").alias("chunks"))
    members = (
        own.select("id", "shingles").join(groups, F.col("id") == F.col("node")).join(chunks, "component")
        .withColumn("mine", F.pmod(F.xxhash64("id"), F.col("chunks")).cast("int"))
        .withColumn("other", F.explode(F.sequence(F.lit(0), F.col("chunks") - 1)))
        .where("chunks = 1 or other <> mine")
        .select("component", F.least("mine", "other").alias("low"), F.greatest("mine", "other").alias("high"), "id", "shingles")
    )
    # Dealt by chunk pair: after the join by component a group would stay in one task.
    dealt = members.repartition("component", "low", "high")
    links = dealt.groupBy("component", "low", "high").applyInPandas(tidy(search), "a long, b long")
    joined = connected_components(links)

    labels = classes.join(joined, F.col("first") == F.col("node"), "left").select(
        F.col("set_key").alias("k"), F.coalesce("component", "first").alias("component_id")
    )
    real_id = F.nullif("id", F.lit(NO_ID))
    return rows.join(labels, F.col("set_key") == F.col("k"), "left").select(
        real_id.alias(id_col),
        "n_shingles",
        F.when(real_id.isNotNull(), F.coalesce("component_id", "id")).alias("component_id"),
    )
