"""Best-fit packing by linear grouping."""

from __future__ import annotations

import struct
import zlib
from bisect import bisect_left, insort
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import checkpointed, released, with_rank
from .token_counts import default_path

#: Tokens in a sequence at most.
LIMIT = 2048
#: Pieces longer than this part of a sequence are large.
SMALL = 1 / 8
#: Groups of equal cardinality among the large pieces.
GROUPS = 192
#: Pieces that a Python worker remembers, in some 200 bytes each.
_KEPT = 800_000
#: Texts that are encoded together, and their characters, at most.
_ROWS, _CHARS = 512, 1 << 21


def _packed(ids: list[int]) -> bytes:
    """Unsigned 32-bit little-endian numbers."""
    return struct.pack(f"<{len(ids)}I", *ids)


class Encoder:
    """Token ids of whole texts by the tokenizers library, as little-endian bytes.

    With a byte-level tokenizer, a word starts at each space before a character that is none. A
    text is cut there; pieces not seen lately are encoded, many at a time. Beyond ``remembered`` pieces, those of
    the last texts stay.
    """

    def __init__(self, path: str, remembered: int = _KEPT):
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_file(path)
        self.library.no_truncation()
        self.library.no_padding()
        self.remembered, self.known = remembered, {}
        line = self.library.encode("\n", add_special_tokens=False).ids
        self.line = line[0] if len(line) == 1 else None

    def pieces(self, text: str) -> tuple[str, list[str]]:
        """What stands before the first cut, and the pieces behind it without their space."""
        first, *rest = text.split(" ")
        if "" not in rest and not any(map(str.isspace, {p[0] for p in rest})):
            return first, rest
        out = [first]
        for p in rest:
            if p and not p[0].isspace():
                out.append(p)
            else:  # more white space: the space belongs to what stands before it
                out[-1] += " " + p
        return out[0], out[1:]

    def answers(self, pieces: list[str]) -> Iterator[tuple[str, bytes]]:
        """Ids of pieces behind a space."""
        for i in range(0, len(pieces), 4096):
            some = pieces[i : i + 4096]
            joined = "\n ".join(some)
            # A line end before a space is a token of its own, so pieces without white space are encoded as lines.
            if joined.split() == some:
                ids = np.array(self.library.encode_batch_fast([" " + joined], add_special_tokens=False)[0].ids, "<u4")
                ends = np.flatnonzero(ids == self.line)
                if self.line is not None and len(ends) == len(some) - 1:
                    data, at = ids.tobytes(), 0
                    for p, end in zip(some, [*(4 * ends).tolist(), len(data)], strict=True):
                        yield p, data[at:end]
                        at = end + 4
                    continue
            found = self.library.encode_batch_fast([" " + p for p in some], add_special_tokens=False)
            for p, encoded in zip(some, found, strict=True):
                yield p, _packed(encoded.ids)

    def encode(self, texts: list[str]) -> list[bytes]:
        cut = [self.pieces(t) for t in texts]
        heads = self.library.encode_batch_fast([h for h, _ in cut], add_special_tokens=False)
        here, known = set().union(*(rest for _, rest in cut)), self.known
        plain, other = [], []
        for p in here.difference(known):
            (plain if len(p.split()) == 1 else other).append(p)
        for new in (plain, other):
            known.update(self.answers(new))
        ids = [
            _packed(head.ids) + b"".join(map(known.__getitem__, rest)) for head, (_, rest) in zip(heads, cut, strict=True)
        ]
        if len(known) > self.remembered:
            self.known = {p: known[p] for p in here if len(p) <= 64}
        else:
            for p in (*plain, *other):
                if len(p) > 64:
                    del known[p]
        return ids


@lru_cache(maxsize=2)
def encoder(path: str, remembered: int = _KEPT) -> Encoder:
    import os

    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    return Encoder(path, remembered)


def _parts(texts: pd.Series) -> Iterator[tuple[int, int]]:
    """Runs of texts that are encoded together: ``_ROWS`` at most, and ``_CHARS`` unless one text has more."""
    first = size = 0
    for i, text in enumerate(texts):
        n = len(text) if text else 0
        if i > first and (i - first >= _ROWS or size + n > _CHARS):
            yield first, i
            first, size = i, 0
        size += n
    if len(texts) > first:
        yield first, len(texts)


def token_pieces(
    docs: DataFrame,
    tokenizer: str | None = None,
    limit: int = LIMIT,
    separator: int = 0,
    id_col: str = "doc_id",
    text_col: str = "text",
    remembered: int = _KEPT,
) -> DataFrame:
    """Tokenized documents, cut only if longer than ``limit``: ``id_col``, piece, start, length, ids_crc32.

    The separator id ends each document. A longer one is cut into pieces of ``limit`` tokens, of
    which the first may be shorter. ids_crc32 is that of the unsigned 32-bit little-endian ids.
    """
    id_type = docs.select(id_col).dtypes[0][1]
    end = np.array([separator], "<u4").tobytes()

    def cut(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        library = encoder(tokenizer or default_path("byte_bpe_50k.json"), remembered)
        for batch in batches:
            out = []
            for a, b in _parts(batch["text"]):
                part = batch.iloc[a:b]
                texts = [t or "" for t in part["text"]]
                for doc, ids in zip(part["id"].tolist(), library.encode(texts), strict=True):
                    ids = memoryview(ids + end)
                    n = len(ids) // 4
                    first = n % limit or limit
                    edges = [0, *range(first, n + 1, limit)]
                    for k, (low, high) in enumerate(zip(edges, edges[1:], strict=False)):
                        out.append((doc, k, low, high - low, zlib.crc32(ids[4 * low : 4 * high])))
            yield pd.DataFrame(out, columns=["id", "piece", "start", "length", "ids_crc32"])
            released()

    # The id travels as text: a null among whole numbers would turn them into floating point.
    rows = docs.select(F.col(id_col).cast("string").alias("id"), F.col(text_col).alias("text"))
    pieces = rows.mapInPandas(cut, "id string, piece int, start long, length long, ids_crc32 long")
    return pieces.withColumn("id", F.col("id").cast(id_type)).withColumnRenamed("id", id_col)


def _filled(capacity: int, sizes: list[int], counts: list[int]) -> dict[int, int]:
    """Numbers of each size that fill ``capacity`` best; sizes fall, and larger ones win ties."""
    reach = np.full(capacity + 1, -1, np.int64)  # index of the size that was put last
    used = np.zeros(capacity + 1, np.int64)
    reach[0] = len(sizes)
    for i, (size, count) in enumerate(zip(sizes, counts, strict=True)):
        if size > capacity or not count:
            continue
        had = reach >= 0
        for k in range(1, min(count, capacity // size) + 1):
            new = np.zeros(capacity + 1, bool)
            new[size:] = (reach[:-size] >= 0) & (reach[size:] < 0)
            # After the first copy, only sums that ended with k - 1 copies go on.
            if k == 1:
                new[size:] &= had[:-size]
            else:
                new[size:] &= (reach[:-size] == i) & (used[:-size] == k - 1)
            if not new.any():
                break
            reach[new], used[new] = i, k
        if reach[capacity] >= 0:
            break
    at, out = int(np.flatnonzero(reach >= 0)[-1]), {}
    while at:
        i = int(reach[at])
        out[i] = out.get(i, 0) + 1
        at -= sizes[i]
    return out


def plan_packing(
    histogram: dict[int, int], limit: int = LIMIT, small: float = SMALL, groups: int = GROUPS
) -> list[tuple[int, int, int, int, int]]:
    """Rows (length, first rank, number, first sequence, offset) for ``histogram`` (length: count).

    Pieces of ranks first .. first + number - 1 within their length go to as many consecutive
    sequences, at ``offset``. Work and result depend on ``limit`` and ``groups``, not on the
    counts: there are at most ``limit`` lengths, and pieces of one length are alike.

    Large lengths are sorted and dealt into groups of equal cardinality, rounded up to the longest
    of their group. Configurations of these few sizes are filled to the brim, always with the
    largest that is left, and repeated while their sizes last. Documents take the places of the
    rounded sizes, and what is small goes, longest first, where it fits best.
    """
    left = dict(sorted(((n, c) for n, c in histogram.items() if c), reverse=True))
    rank = dict.fromkeys(left, 0)
    # Bins of one content: (number, free, slots), with slots as (length, offset).
    bins: list[tuple[int, int, tuple]] = []
    if left.get(limit):
        bins.append((left.pop(limit), 0, ((limit, 0),)))
    large = [(n, c) for n, c in left.items() if n > small * limit]
    total = sum(c for _, c in large)
    each = max(1, -(-total // groups))
    grouped: list[list[list[int]]] = []  # per group: [length, count], falling
    room = 0
    for n, c in large:
        while c:
            if not room:
                grouped.append([])
                room = each
            k = min(c, room)
            grouped[-1].append([n, k])
            c, room = c - k, room - k
    sizes = [g[0][0] for g in grouped]
    counts = [sum(k for _, k in g) for g in grouped]
    while any(counts):
        top = next(i for i, c in enumerate(counts) if c)
        rest = [c - (i == top) for i, c in enumerate(counts)]
        need = _filled(limit - sizes[top], sizes, rest)
        need[top] = need.get(top, 0) + 1
        times = min(counts[i] // k for i, k in need.items())
        # Substitute actual pieces: a slot takes the next ones of its group, longest first.
        slots = []
        for i, k in sorted(need.items()):
            counts[i] -= k * times
            for _ in range(k):
                runs, want = [], times
                while want:
                    n, c = grouped[i][0]
                    take = min(c, want)
                    runs.append((n, take))
                    want -= take
                    if take == c:
                        grouped[i].pop(0)
                    else:
                        grouped[i][0][1] -= take
                slots.append(runs)
        while times:
            take = min(runs[0][1] for runs in slots)
            offset, content = 0, []
            for runs in slots:
                n, c = runs[0]
                content.append((n, offset))
                offset += n
                runs[0] = (n, c - take)
                if c == take:
                    runs.pop(0)
            bins.append((take, limit - offset, tuple(content)))
            times -= take
    open_: list[tuple[int, int]] = sorted((free, i) for i, (_, free, _) in enumerate(bins) if free)
    for n, c in left.items():
        if n > small * limit:
            continue
        while c:
            at = bisect_left(open_, (n, -1))
            if at == len(open_):
                per = min(c, limit // n)
                number = max(1, c // per)
                bins.append((number, limit, ()))
                insort(open_, (limit, len(bins) - 1))
                continue
            free, i = open_.pop(at)
            number, _, slots = bins[i]
            per = min(c, free // n)
            take = min(number, c // per)
            if take < number:
                bins.append((number - take, free, slots))
                insort(open_, (free, len(bins) - 1))
            offset = limit - free
            bins[i] = (take, free - per * n, slots + tuple((n, offset + k * n) for k in range(per)))
            c -= take * per
            if bins[i][1]:
                insort(open_, (bins[i][1], i))
    plan, sequence = [], 0
    for number, _, slots in bins:
        for n, offset in slots:
            plan.append((n, rank.setdefault(n, 0), number, sequence, offset))
            rank[n] += number
        sequence += number
    return plan


def pack_documents(
    docs: DataFrame,
    tokenizer: str | None = None,
    limit: int = LIMIT,
    id_col: str = "doc_id",
    text_col: str = "text",
    remembered: int = _KEPT,
) -> DataFrame:
    """Pack whole tokenized texts into few sequences of at most ``limit`` tokens.

    One row per piece: ``id_col``, piece, start, length, ids_crc32, sequence_id, offset. Places
    are planned on the driver from the number of pieces of each length, of which there are at most
    ``limit``; pieces are numbered within their length in parallel and look up their place in
    that plan, whose size is bound by ``limit`` too. The pieces of a sequence follow each other
    without gaps from offset 0.

    A null text counts as empty and has one piece, the separator. Each input row is packed, also
    if it repeats another or its id is null. No rows give none; other columns are ignored.
    ``remembered`` pieces of words are kept by a Python worker: fewer take less memory and more time.
    """
    spark = docs.sparkSession
    pieces = checkpointed(token_pieces(docs, tokenizer, limit, 0, id_col, text_col, remembered))
    histogram = {
        r["length"]: r["n"] for r in pieces.groupBy("length").agg(F.count("*").alias("n")).collect()
    }
    plan = spark.createDataFrame(
        plan_packing(histogram, limit) or [],
        "p_length long, p_first long, p_number long, p_sequence long, p_offset long",
    )
    keyed = pieces.withColumn("_order", F.struct(id_col, "piece", "ids_crc32"))
    ranked = with_rank(keyed, ["length"], "_order").drop("_order")
    placed = ranked.join(
        F.broadcast(plan),
        (F.col("length") == F.col("p_length"))
        & (F.col("rank") >= F.col("p_first"))
        & (F.col("rank") < F.col("p_first") + F.col("p_number")),
    )
    return placed.select(
        id_col, "piece", "start", "length", "ids_crc32",
        (F.col("p_sequence") + F.col("rank") - F.col("p_first")).alias("sequence_id"),
        F.col("p_offset").alias("offset"),
    )
