"""Find repeated windows of texts: blocks of documents exchange what recurs with shards of anchors.

Documents are dealt into blocks of bounded size. Windows are grouped by their anchor (see
``sequences.anchored``), and

1. each block tells each shard which of its anchors it has, once each, and in how many stretches;
2. shards answer which of them recur, and which are hot: in more stretches than a task should get;
3. blocks send what stands around recurring anchors, each distinct stretch once, with a number
   that the caller chooses (its first document, how often it stands there);
4. shards judge the windows of these stretches and answer with a bit for each;
5. blocks apply the answers to their documents.

The stretches of a hot anchor are cut into their windows, and each window goes to the shard of its
own hash, as equal windows do. So what stands around a short line of many documents is spread.

A stretch that fills a third of the corpus thus reaches a shard once per block. Texts are shuffled
once, into blocks, and that exchange is read again by steps 3 and 5.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import row_place, shipped, tidy
from .sequences import SLICE, Rolling, anchored

#: Bytes of text in a block, about; a longer document is a block's only one.
BLOCK_BYTES = 4 << 20
#: Distinct stretches of an anchor, summed over the blocks, from which it is hot.
HOT_STRETCHES = 8192
#: Stands for a null id, which thereby comes after all others.
NO_ID = 2**63 - 1


@dataclass(frozen=True)
class Stretches:
    """Anchored stretches of a block, one per run of windows."""

    ids: np.ndarray
    doc: np.ndarray
    first: np.ndarray
    last: np.ndarray
    anchor: np.ndarray
    content: np.ndarray

    def where(self, some: np.ndarray) -> Stretches:
        return Stretches(self.ids[some], self.doc[some], self.first[some], self.last[some], self.anchor[some], self.content[some])


@dataclass(frozen=True)
class Rule:
    """What the two operators do in their own ways."""

    window: int
    gram: int
    #: Elements of one text.
    elements: Callable[[bytes], np.ndarray]
    #: Bytes of windows first..last of a text, for many stretches.
    cut: Callable[[bytes, np.ndarray, np.ndarray], list[bytes]]
    #: Whether an anchor recurs inside a block: by other documents only, or anywhere.
    other_documents: bool
    #: (contents, numbers, rows) of a shard to a bit mask for each row; rows name a content.
    judge: Callable[[list[bytes], np.ndarray, np.ndarray], np.ndarray]
    #: Documents of a block and their repeated windows to result rows.
    finish: Callable[[np.ndarray, list[bytes], list[np.ndarray]], pd.DataFrame]


def _stretches(rule: Rule, ids: np.ndarray, texts: list[bytes]) -> Stretches:
    doc, first, last, anchor, content = anchored([rule.elements(t) for t in texts], rule.window, rule.gram)
    return Stretches(ids[doc], doc, first, last, anchor, content)


def _without_hot(rule: Rule, of: Stretches, texts: list[bytes], hot: np.ndarray) -> Stretches:
    """The stretches with those of ``hot`` anchors, sorted, as one per window, under the window's own hash."""
    if not len(hot):
        return of
    at = np.minimum(np.searchsorted(hot, of.anchor), len(hot) - 1)
    is_hot = hot[at] == of.anchor
    rows = np.flatnonzero(is_hot)
    parts = [(of.ids[~is_hot], of.doc[~is_hot], of.first[~is_hot], of.last[~is_hot], of.anchor[~is_hot], of.content[~is_hot])]
    runs = _firsts(of.doc[rows])
    for a, b in zip(runs, [*runs[1:], len(rows)], strict=False):
        mine = rows[a:b]
        elements = rule.elements(texts[of.doc[mine[0]]])
        low = 0
        while low < len(mine):
            # Stretches are by place; a slice takes those that begin and end in it.
            base = int(of.first[mine[low]])
            end = low + int(np.searchsorted(of.last[mine[low:]], base + SLICE - rule.window, "right"))
            some, low = mine[low:end], end
            widths = of.last[some] - of.first[some] + 1
            start = np.repeat(of.first[some] - np.cumsum(widths) + widths, widths) + np.arange(widths.sum())
            rolling = Rolling(elements[base : base + SLICE])
            hashes = rolling.hashes(start - base, start - base + rule.window)
            of_doc = np.repeat(some, widths)
            parts.append((of.ids[of_doc], of.doc[of_doc], start, start, hashes, hashes))
    return Stretches(*map(np.concatenate, zip(*parts, strict=True)))


def _shard_and_key(anchor: np.ndarray, shards: int) -> tuple[np.ndarray, np.ndarray]:
    return (anchor >> np.uint64(32)) % np.uint64(shards), (anchor & np.uint64(0xFFFFFFFF)).astype(np.uint32)


def _firsts(values: np.ndarray) -> np.ndarray:
    """Where runs of sorted values begin."""
    return np.flatnonzero(np.concatenate((np.ones(min(1, len(values)), bool), values[1:] != values[:-1])))


def _numbers(rule: Rule, of: Stretches, order: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """Per run of equal contents: the first document, or the number of places."""
    if rule.other_documents:
        return np.minimum.reduceat(of.ids[order], starts) if len(starts) else of.ids[:0]
    return np.diff(np.append(starts, len(order)))


def text_blocks(
    docs: DataFrame, id_col: str, text_col: str, block_bytes: int, unique_ids: bool = False
) -> tuple[DataFrame, int]:
    """Rows (block, id, text as bytes) and the number of blocks, which follows the size of the texts.

    Rows are dealt by their place in the files they are read from, so that rows without or with
    the same id spread as well; with ``unique_ids``, or if there are no files, by id and text.
    """
    shipped(docs.sparkSession)
    text = F.coalesce(F.col(text_col), F.lit(""))
    total = docs.agg(F.sum(F.octet_length(text).cast("long"))).first()[0] or 0
    n = max(1, -(-total // block_bytes))
    ids = F.coalesce(F.col(id_col).cast("long"), F.lit(NO_ID))
    place = F.xxhash64(ids) if unique_ids else row_place(docs)
    if place is None:
        place = F.xxhash64(ids, text)
    block = F.pmod(place, F.lit(n)).cast("long")
    return docs.select(block.alias("block"), ids.alias("id"), text.cast("binary").alias("text")), n


def repeated_windows(
    docs: DataFrame, rule: Rule, schema: str, id_col: str, text_col: str, block_bytes: int = BLOCK_BYTES,
    hot_stretches: int | None = None,
) -> DataFrame:
    """``rule.finish`` over all documents; a null text counts as empty, a null id as the last one."""
    blocks, n = text_blocks(docs, id_col, text_col, block_bytes)
    hot_stretches = HOT_STRETCHES if hot_stretches is None else hot_stretches

    def load(pdf: pd.DataFrame) -> tuple[np.ndarray, list[bytes]]:
        return pdf["id"].to_numpy(np.int64), pdf["text"].tolist()

    def tell(pdf: pd.DataFrame) -> pd.DataFrame:
        block = int(pdf["block"].iloc[0])
        found = _stretches(rule, *load(pdf))
        shard, key = _shard_and_key(found.anchor, n)
        order = np.lexsort((found.content, key, shard))
        shard, key, ids = shard[order], key[order], found.ids[order]
        full = shard << np.uint64(32) | key
        starts = _firsts(full)
        distinct = np.ones(len(full), np.int64)
        distinct[1:] = (full[1:] != full[:-1]) | (np.diff(found.content[order]) != 0)
        spread = (np.add.reduceat(distinct, starts) if len(starts) else distinct).astype(np.uint32)
        if rule.other_documents:
            many = np.minimum.reduceat(ids, starts) != np.maximum.reduceat(ids, starts) if len(starts) else ids[:0] > 0
        else:
            many = np.diff(np.append(starts, len(order))) > 1
        shard, key = shard[starts], key[starts]
        cuts = _firsts(shard)
        rows = [
            (int(shard[a]), block, key[a:b].tobytes(), np.packbits(many[a:b]).tobytes(), spread[a:b].tobytes())
            for a, b in zip(cuts, [*cuts[1:], len(shard)], strict=False)
        ]
        return pd.DataFrame(rows, columns=["shard", "block", "keys", "many", "spread"])

    def answer(pdf: pd.DataFrame) -> pd.DataFrame:
        rows = [np.frombuffer(k, np.uint32) for k in pdf["keys"]]
        many = np.concatenate([np.unpackbits(np.frombuffer(m, np.uint8), count=len(k)) for m, k in zip(pdf["many"], rows, strict=True)])
        keys = np.concatenate(rows)
        order = np.argsort(keys, kind="stable")
        starts = _firsts(keys[order])
        sizes = np.diff(np.append(starts, len(order)))
        recurs = (sizes > 1) | (np.maximum.reduceat(many[order], starts) > 0)
        spread = np.concatenate([np.frombuffer(x, np.uint32) for x in pdf["spread"]]).astype(np.int64)
        hot = recurs & (np.add.reduceat(spread[order], starts) > hot_stretches)
        flags = np.empty(len(keys), bool)
        flags[order] = np.repeat(recurs, sizes)
        is_hot = np.empty(len(keys), bool)
        is_hot[order] = np.repeat(hot, sizes)
        edges = np.cumsum([0, *map(len, rows)])
        kept = [k[flags[a:b]] for k, a, b in zip(rows, edges, edges[1:], strict=False)]
        split = [k[is_hot[a:b]] for k, a, b in zip(rows, edges, edges[1:], strict=False)]
        out = pdf[["block", "shard"]].assign(keys=[k.tobytes() for k in kept], hot=[k.tobytes() for k in split])
        return out[[len(k) > 0 for k in kept]]

    def send(pdf: pd.DataFrame, told: pd.DataFrame) -> pd.DataFrame:
        columns = ["shard", "block", "content", "number", "length", "data", "hot"]
        if not len(pdf) or not len(told):
            return pd.DataFrame([], columns=columns)
        block = int(pdf["block"].iloc[0])
        ids, texts = load(pdf)
        found = _stretches(rule, ids, texts)
        wanted, hot = (
            np.sort(
                np.concatenate([np.frombuffer(k, np.uint32).astype(np.uint64) | np.uint64(s << 32) for s, k in zip(told["shard"].tolist(), told[name], strict=True)])
            )
            for name in ("keys", "hot")
        )
        shard, key = _shard_and_key(found.anchor, n)
        full = shard << np.uint64(32) | key
        at = np.minimum(np.searchsorted(wanted, full), len(wanted) - 1)
        found = found.where(wanted[at] == full)
        # By whole anchors from here on: two that share a key are hot together.
        anchors = np.unique(found.anchor[np.isin(full[wanted[at] == full], hot)])
        found = _without_hot(rule, found, texts, anchors)
        shard, _ = _shard_and_key(found.anchor, n)
        order = np.lexsort((found.content, shard))
        starts = _firsts(found.content[order])
        number = _numbers(rule, found, order, starts)
        heads = order[starts]
        data: list[bytes] = [b""] * len(heads)
        by_doc = np.argsort(found.doc[heads], kind="stable")
        runs = _firsts(found.doc[heads][by_doc])
        for a, b in zip(runs, [*runs[1:], len(by_doc)], strict=False):
            some = by_doc[a:b]
            pieces = rule.cut(texts[found.doc[heads[some[0]]]], found.first[heads[some]], found.last[heads[some]])
            for i, piece in zip(some.tolist(), pieces, strict=True):
                data[i] = piece
        cuts = _firsts(shard[heads])
        rows = []
        for a, b in zip(cuts, [*cuts[1:], len(heads)], strict=False):
            rows.append(
                (
                    int(shard[heads[a]]), block, found.content[heads[a:b]].tobytes(), number[a:b].astype(np.int64).tobytes(),
                    np.array([len(d) for d in data[a:b]], np.int64).tobytes(), b"".join(data[a:b]), b"",
                )
            )
        if len(anchors):
            # Comes back to the block, for the last step.
            rows.append((block % n, block, b"", b"", b"", b"", anchors.tobytes()))
        return pd.DataFrame(rows, columns=columns)

    def judge(pdf: pd.DataFrame) -> pd.DataFrame:
        content = np.concatenate([np.frombuffer(c, np.uint64) for c in pdf["content"]])
        number = np.concatenate([np.frombuffer(c, np.int64) for c in pdf["number"]])
        lengths = np.concatenate([np.frombuffer(c, np.int64) for c in pdf["length"]])
        data = b"".join(pdf["data"])
        ends = np.cumsum(lengths)
        out = [(block, b"", b"", hot) for block, hot in zip(pdf["block"], pdf["hot"], strict=True) if len(hot)]
        if not len(content):
            return pd.DataFrame(out, columns=["block", "content", "mask", "hot"])
        _, heads, rows = np.unique(content, return_index=True, return_inverse=True)
        contents = [data[ends[i] - lengths[i] : ends[i]] for i in heads.tolist()]
        masks = rule.judge(contents, number, rows)
        edges = np.cumsum([0, *(len(c) // 8 for c in pdf["content"])])
        for block, a, b in zip(pdf["block"], edges, edges[1:], strict=False):
            hit = np.flatnonzero(masks[a:b]) + a
            if len(hit):
                out.append((block, content[hit].tobytes(), masks[hit].tobytes(), b""))
        return pd.DataFrame(out, columns=["block", "content", "mask", "hot"])

    def finish(pdf: pd.DataFrame, judged: pd.DataFrame) -> pd.DataFrame:
        if not len(pdf):
            return pd.DataFrame([], columns=[c.split()[0] for c in schema.split(", ")])
        ids, texts = load(pdf)
        found = _stretches(rule, ids, texts)
        if len(judged):
            hot = np.sort(np.concatenate([np.frombuffer(h, np.uint64) for h in judged["hot"]]))
            found = _without_hot(rule, found, texts, hot)
        masks = np.zeros(len(found.doc), np.uint64)
        if len(judged) and any(map(len, judged["content"])):
            content = np.concatenate([np.frombuffer(c, np.uint64) for c in judged["content"]])
            mask = np.concatenate([np.frombuffer(c, np.uint64) for c in judged["mask"]])
            order = np.argsort(content)
            content, mask = content[order], mask[order]
            at = np.minimum(np.searchsorted(content, found.content), len(content) - 1)
            masks = np.where(content[at] == found.content, mask[at], np.uint64(0))
        if rule.other_documents:
            # Later documents of the block that have the same stretch.
            order = np.argsort(found.content, kind="stable")
            starts = _firsts(found.content[order])
            least = _numbers(rule, found, order, starts)
            first_id = np.empty(len(order), np.int64)
            first_id[order] = np.repeat(least, np.diff(np.append(starts, len(order))))
            masks = np.where(found.ids > first_id, ~np.uint64(0), masks)
        widths = found.last - found.first + 1
        hit = np.flatnonzero(masks)
        row = np.repeat(hit, widths[hit])
        step = np.arange(len(row)) - np.repeat(np.cumsum(widths[hit]) - widths[hit], widths[hit])
        bit = (masks[row] >> step.astype(np.uint64)) & np.uint64(1) == 1
        doc, start = found.doc[row[bit]], (found.first[row] + step)[bit]
        order = np.argsort(doc, kind="stable")
        edges = np.searchsorted(doc[order], np.arange(len(texts) + 1))
        starts = [start[order[a:b]] for a, b in zip(edges, edges[1:], strict=False)]
        return rule.finish(ids, texts, starts)

    told = blocks.groupBy("block").applyInPandas(tidy(tell), "shard long, block long, keys binary, many binary, spread binary")
    recurring = told.groupBy("shard").applyInPandas(tidy(answer), "block long, shard long, keys binary, hot binary")
    sent = (
        blocks.groupBy("block").cogroup(recurring.groupBy("block"))
        .applyInPandas(tidy(send), "shard long, block long, content binary, number binary, length binary, data binary, hot binary")
    )
    judged = sent.groupBy("shard").applyInPandas(tidy(judge), "block long, content binary, mask binary, hot binary")
    return blocks.groupBy("block").cogroup(judged.groupBy("block")).applyInPandas(tidy(finish), schema)
