"""Importance resampling towards a target corpus: hashed n-gram counts, log-ratio gains, Gumbel top-k.

Each slice of a batch interns its n-grams in an open-addressed table of NumPy arrays: the keys are xxhash64,
bytes decide on equality, and each slot has a bucket and a count. Occurrences carry slot numbers, by
which gains are gathered.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator
from zlib import crc32

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import positions, shipped, stored

_U = np.uint64
#: The primes of xxhash64: fixed values of the public algorithm.
_P1, _P2, _P3 = _U(0x9E3779B185EBCA87), _U(0xC2B2AE3D27D4EB4F), _U(0x165667B19E3779F9)
_P4, _P5 = _U(0x85EBCA77C2B2AE63), _U(0x27D4EB2F165667C5)
#: Bytes of texts that share a table (a longer text has its own), and occurrences interned at once.
SLICE, CHUNK = 1 << 22, 1 << 16
#: Letters in lower case, digits and all beyond ASCII; a space for any other byte.
_PLAIN = np.full(256, 32, np.uint8)
_PLAIN[48:58], _PLAIN[97:123], _PLAIN[128:] = np.arange(48, 58), np.arange(97, 123), np.arange(128, 256)
_PLAIN[65:91] = np.arange(97, 123)


def _rotated(h: np.ndarray, bits: int) -> np.ndarray:
    return (h << _U(bits)) | (h >> _U(64 - bits))


def _lanes(data: np.ndarray, width: int) -> np.ndarray:
    """A view of the ``width`` bytes from each position on; ``data`` ends with 8 bytes to spare."""
    return np.ndarray(len(data) - 7, f"<u{width}", buffer=data, strides=(1,))


def xxh64(data: np.ndarray, starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """xxhash64 of each run of bytes: those under 32 bytes together by length, longer ones one by one."""
    eight, four = _lanes(data, 8), _lanes(data, 4)
    found = np.empty(len(starts), _U)
    order = np.argsort(np.minimum(lengths, 32).astype(np.uint8), kind="stable")
    cuts = np.searchsorted(lengths[order], np.arange(1, 34))
    for length in range(1, 32):
        rows = order[cuts[length - 1] : cuts[length]]
        if not len(rows):
            continue
        at = starts[rows]
        h, done = np.full(len(rows), _P5 + _U(length), _U), 0
        while length - done >= 8:
            h = _rotated(h ^ (_rotated(eight[at + done] * _P2, 31) * _P1), 27) * _P1 + _P4
            done += 8
        if length - done >= 4:
            h = _rotated(h ^ (four[at + done].astype(_U) * _P1), 23) * _P2 + _P3
            done += 4
        for i in range(done, length):
            h = _rotated(h ^ (data[at + i].astype(_U) * _P5), 11) * _P1
        h = (h ^ (h >> _U(33))) * _P2
        h = (h ^ (h >> _U(29))) * _P3
        found[rows] = h ^ (h >> _U(32))
    for row in order[cuts[31] :]:
        found[row] = xxhash.xxh64_intdigest(data[starts[row] : starts[row] + lengths[row]])
    return found


class NgramTable:
    """Open addressing with linear probing over runs of bytes of ``data``; a slot is empty while its length is 0."""

    def __init__(self, data: np.ndarray, buckets: int, capacity: int = 1 << 12):
        self.data, self.buckets, self.used = data, buckets, 0
        self.lanes = _lanes(data, 8)
        self._empty(capacity)

    def _empty(self, capacity: int) -> None:
        self.mask = capacity - 1
        self.keys, self.starts = np.zeros(capacity, _U), np.zeros(capacity, np.int64)
        self.lengths, self.counts = np.zeros(capacity, np.int64), np.zeros(capacity, np.int64)
        self.bucket, self.owner = np.zeros(capacity, np.int32), np.zeros(capacity, np.int64)

    def _equal(self, a: np.ndarray, b: np.ndarray, lengths: np.ndarray) -> np.ndarray:
        """Whether the bytes from ``a`` and ``b`` on agree, eight at a time."""
        same, live, at = np.ones(len(a), bool), np.arange(len(a)), 0
        while len(live):
            spare = np.clip(8 - (lengths[live] - at), 0, 7).astype(_U) * _U(8)
            apart = ((self.lanes[a[live] + at] ^ self.lanes[b[live] + at]) << spare) != 0
            same[live[apart]] = False
            at += 8
            live = live[~apart & (lengths[live] > at)]
        return same

    def _place(self, keys: np.ndarray, starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
        """The slot of each run, new ones included."""
        slots = (keys & _U(self.mask)).astype(np.int64)
        pending = np.arange(len(keys))
        while len(pending):
            at = slots[pending]
            free = pending[self.lengths[at] == 0]
            if len(free):
                # Several may want a slot: the one that is left as its owner gets it.
                self.owner[slots[free]] = free
                won = free[self.owner[slots[free]] == free]
                here = slots[won]
                self.keys[here], self.starts[here], self.lengths[here] = keys[won], starts[won], lengths[won]
                self.used += len(won)
            same = (self.keys[at] == keys[pending]) & (self.lengths[at] == lengths[pending])
            alike = np.flatnonzero(same)
            same[alike] = self._equal(starts[pending[alike]], self.starts[at[alike]], lengths[pending[alike]])
            pending = pending[~same]
            slots[pending] = (slots[pending] + 1) & self.mask
        return slots

    def reserve(self, more: int) -> np.ndarray | None:
        """Room for ``more`` runs at half load at most; where each slot has moved to, if any has."""
        capacity = self.mask + 1
        if capacity >= 2 * (self.used + more):
            return None
        while capacity < 2 * (self.used + more):
            capacity *= 2
        full, moved = np.flatnonzero(self.lengths), np.zeros(self.mask + 1, np.int64)
        old = [a[full] for a in (self.keys, self.starts, self.lengths)]
        self.used = 0
        self._empty(capacity)
        moved[full] = self._place(*old)
        return moved

    def intern(self, starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
        """The slot of each occurrence; counts are added, and each run's bucket is set. Once per table."""
        keys, found = xxh64(self.data, starts, lengths), np.empty(len(starts), np.int64)
        for i in range(0, len(starts), CHUNK):
            part = slice(i, i + CHUNK)
            if (moved := self.reserve(len(starts[part]))) is not None:
                found[:i] = moved[found[:i]]
            found[part] = self._place(keys[part], starts[part], lengths[part])
        self.counts += np.bincount(found, minlength=len(self.counts))
        new = np.flatnonzero(self.lengths)
        raw = self.data.tobytes()
        ends = self.starts[new] + self.lengths[new]
        self.bucket[new] = [crc32(raw[a:b]) % self.buckets for a, b in zip(self.starts[new].tolist(), ends.tolist())]
        return found


class Grams:
    """The n-grams of some texts: plain bytes with words one space apart, and where each word stands."""

    def __init__(self, raw: np.ndarray, offsets: np.ndarray):
        """``raw`` holds texts, each followed by a byte that is in no word; ``offsets`` where each starts, and the end."""
        plain = _PLAIN[raw]
        inside = plain != 32
        after = np.zeros(len(raw), bool)
        after[1:] = inside[:-1]
        # A word's bytes and the first byte after it, which is a space by now.
        kept = plain[inside | after]
        self.ends = np.flatnonzero(kept == 32)
        self.starts = np.concatenate(([0], self.ends[:-1] + 1))[: len(self.ends)].astype(np.int64)
        self.data = np.concatenate((kept, np.zeros(8, np.uint8)))
        #: Words of text i: from bounds[i] to bounds[i + 1].
        self.bounds = np.searchsorted(np.flatnonzero(after & ~inside), offsets)

    def of(self, size: int) -> np.ndarray:
        """First words of all runs of ``size`` words of one text."""
        words = np.diff(self.bounds)
        last = np.repeat(self.bounds[1:], words)
        first = np.arange(len(self.starts))
        return first[first + size <= last]


def _slices(texts: pa.Array) -> Iterator[tuple[int, int, Grams]]:
    """Runs of texts of about ``SLICE`` bytes, whole texts each; a null text is empty."""
    wide = texts.cast(pa.large_string()).fill_null("")
    ended = pc.binary_join_element_wise(wide, *(pa.scalar(s, pa.large_string()) for s in ("", "\0")))
    _, offsets, data = ended.buffers()
    offsets = np.frombuffer(offsets, np.int64)[ended.offset : ended.offset + len(ended) + 1]
    raw = np.frombuffer(data, np.uint8)
    first = 0
    while first < len(texts):
        past = max(int(np.searchsorted(offsets, offsets[first] + SLICE, side="right")) - 1, first + 1)
        own = offsets[first : past + 1]
        yield first, past, Grams(raw[own[0] : own[-1]], own - own[0])
        first = past


def bucket_counts(batches: Iterator[pa.RecordBatch], sizes: range, buckets: int) -> Iterator[pa.RecordBatch]:
    """Features per bucket of all texts of a task."""
    total = np.zeros(buckets, np.int64)
    for batch in batches:
        for _, _, grams in _slices(batch.column(0)):
            table = NgramTable(grams.data, buckets)
            first = [grams.of(n) for n in sizes]
            starts = np.concatenate([grams.starts[f] for f in first])
            ends = np.concatenate([grams.ends[f + n - 1] for f, n in zip(first, sizes)])
            table.intern(starts, ends - starts)
            np.add.at(total, table.bucket, table.counts)
    held = np.flatnonzero(total)
    yield pa.RecordBatch.from_arrays([pa.array(held), pa.array(total[held])], ["bucket", "n"])


def weighed(texts: pa.Array, sizes: range, gains: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Words, features and sum of gains of each text."""
    words, features, weights = (np.zeros(len(texts), np.int64) for _ in range(3))
    for first, past, grams in _slices(texts):
        table = NgramTable(grams.data, len(gains))
        starts = [grams.of(n) for n in sizes]
        lengths = [grams.ends[f + n - 1] - grams.starts[f] for f, n in zip(starts, sizes)]
        slots = table.intern(grams.starts[np.concatenate(starts)], np.concatenate(lengths))
        by_slot, done, own = gains[table.bucket], 0, grams.bounds
        words[first:past] = np.diff(own)
        for f in starts:
            gained = np.zeros(len(grams.starts) + 1, np.int64)
            gained[f + 1] = by_slot[slots[done : done + len(f)]]
            there = np.zeros(len(grams.starts) + 1, np.int64)
            there[f + 1] = 1
            weights[first:past] += np.diff(np.cumsum(gained)[own])
            features[first:past] += np.diff(np.cumsum(there)[own])
            done += len(f)
    return words, features, weights


def bucket_gains(source: dict[int, int], target: dict[int, int], buckets: int) -> np.ndarray:
    """Per bucket, floor(1000 ln of the smoothed ratio of target to source share)."""
    s_all, t_all = float(sum(source.values()) + buckets), float(sum(target.values()) + buckets)
    ratio = lambda b: (target.get(b, 0) + 1.0) * s_all / ((source.get(b, 0) + 1.0) * t_all)
    return np.array([math.floor(1000 * math.log(ratio(b))) for b in range(buckets)], np.int64)


def _counted(texts: DataFrame, sizes: range, buckets: int) -> dict[int, int]:
    """Features per bucket; at most ``buckets`` rows come to the driver."""
    schema = "bucket long, n long"
    parts = texts.mapInArrow(lambda batches: bucket_counts(batches, sizes, buckets), schema)
    return {r["bucket"]: r["n"] for r in parts.groupBy("bucket").agg(F.sum("n").alias("n")).collect()}


def gumbel(h: Column) -> Column:
    """Noise of a uniform 32-bit number, in thousandths, rounded down."""
    share = (h + F.lit(0.5)) / F.lit(4294967296.0)
    return F.floor(F.lit(-1000.0) * F.log(-F.log(share)))


def resample(
    docs: DataFrame,
    target: DataFrame,
    *,
    most_words: int = 1,
    buckets: int = 10_000,
    least_words: int = 20,
    percent: int = 10,
    seed: int = 2024,
    id_col: str = "doc_id",
    text_col: str = "text",
    noise: Callable[[Column], Column] = gumbel,
) -> DataFrame:
    """One row per input row: ``id_col``, n_words, n_features, weight, score, rank (long).

    Features are runs of 1 to ``most_words`` words, hashed to ``buckets`` by CRC-32. Weight is the sum of
    the gains of a text's features, score adds Gumbel noise of the id (a null id counts as an empty
    one). Of the texts of ``least_words`` words or more, ``percent`` percent of highest score get a rank from 1,
    ties to the smaller id (null last); repeated rows are ranked each. A null or empty text has no features
    and weighs 0. Without a target every gain follows the source alone; no rows in, none out.
    """
    shipped(docs.sparkSession)
    sizes = range(1, most_words + 1)
    texts = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    source = _counted(texts.select("text"), sizes, buckets)
    wanted = _counted(target.select(F.col(text_col).alias("text")), sizes, buckets)
    gains = bucket_gains(source, wanted, buckets)

    def weigh(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = weighed(batch.column(1), sizes, gains)
            yield pa.RecordBatch.from_arrays([batch.column(0), *map(pa.array, found)], names)

    names = ["id", "n_words", "n_features", "weight"]
    schema = T.StructType([texts.schema["id"], *(T.StructField(n, T.LongType()) for n in names[1:])])
    weights = texts.mapInArrow(weigh, schema)
    key = F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("id").cast("string"), F.lit("")))
    h = F.conv(F.substring(F.sha2(key, 256), 1, 8), 16, 10).cast("long")
    # Written once: the ranges of the ranking are sampled before they are dealt.
    scored = stored(weights.withColumn("score", (F.col("weight") + noise(h)).cast("long")))
    able = F.col("n_words") >= least_words
    quota = scored.where(able).count() * percent // 100
    order = scored.where(able).withColumns({"down": -F.col("score"), "none": F.col("id").isNull()})
    ranked, _ = positions(order, [], ["down", "none", "id"])
    rank = F.when(F.col("pos") < quota, F.col("pos") + 1)
    chosen = ranked.select(*scored.columns, rank.alias("rank"))
    rest = scored.where(~able).withColumn("rank", F.lit(None).cast("long"))
    return chosen.unionByName(rest).withColumnRenamed("id", id_col)
