"""Suffix-array dedup with longest-previous-factor arrays."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .repeats import NO_ID, Rule, repeated_windows
from .sequences import byte_elements, covered

#: Bytes that must match an earlier document.
LENGTH = 50
#: Bytes of an anchor.
GRAM = 16


def common_lengths(ordered: np.ndarray, length: int) -> np.ndarray:
    """Bytes that each of the sorted suffixes (``length`` bytes each) shares with the one before it."""
    common = np.zeros(len(ordered), np.int64)
    rows = np.ndarray((len(ordered), length), np.uint8, buffer=np.ascontiguousarray(ordered))
    for i in range(1, len(ordered), 1 << 16):
        apart = rows[i - 1 : i - 1 + (1 << 16)][: len(rows[i : i + (1 << 16)])] != rows[i : i + (1 << 16)]
        common[i : i + (1 << 16)] = np.where(apart.any(axis=1), apart.argmax(axis=1), length)
    return common


def _before(docs: np.ndarray, common: np.ndarray, least: int) -> np.ndarray:
    """Length that each suffix shares with the nearest one before it of a smaller document, if ``least`` at least.

    The nearest smaller entry, as a stack finds it, for all suffixes at once: a candidate that is not smaller
    hands over its own candidate, with the least common length on the way. All between the two is not
    smaller either, so none is skipped; chains halve each time. What falls below ``least`` is given up.
    """
    at, shared = np.arange(len(docs)) - 1, common.copy()
    live = np.flatnonzero(shared >= least)
    live = live[live > 0]
    shared[np.setdiff1d(np.arange(len(docs)), live, assume_unique=True)] = 0
    while len(live):
        live = live[docs[at[live]] >= docs[live]]
        passed = at[live]
        there, both = at[passed], np.minimum(shared[live], shared[passed])
        at[live], shared[live] = there, np.where((there < 0) | (both < least), 0, both)
        live = live[shared[live] > 0]
    return shared


def factor_lengths(docs: np.ndarray, common: np.ndarray, least: int = 1) -> np.ndarray:
    """Longest previous factors, in suffix order: what each suffix shares at most with one of a smaller document.

    ``docs`` are the suffixes' documents, ``common`` as of ``common_lengths``. Of all suffixes of smaller
    documents, the previous and the next smaller entry in suffix order share most. Lengths below ``least`` are 0.
    """
    after = np.append(common[1:], 0)[::-1]
    return np.maximum(_before(docs, common, least), _before(docs[::-1], after, least)[::-1])


def factor_masks(contents: list[bytes], firsts: np.ndarray, rows: np.ndarray, length: int) -> np.ndarray:
    """Masks of the windows of each row's stretch whose longest previous factor is ``length`` or more.

    Suffixes that start a window are sorted by their first ``length`` bytes, so factors are cut there. Equal
    stretches are one, of their first document: a later one has all of it as its factor.
    """
    least = np.full(len(contents), NO_ID, np.int64)
    np.minimum.at(least, rows, firsts)
    sizes = np.array([len(c) for c in contents])
    widths = sizes - length + 1
    buffer = np.frombuffer(b"".join(contents), np.uint8)
    edges = np.cumsum(widths) - widths
    step = np.arange(widths.sum()) - np.repeat(edges, widths)
    starts = np.repeat(np.cumsum(sizes) - sizes, widths) + step
    suffixes = np.ndarray(len(buffer) - length + 1, f"S{length}", buffer=buffer, strides=(1,))[starts]
    order = np.argsort(suffixes, kind="stable")
    factors = np.empty(len(order), np.int64)
    factors[order] = factor_lengths(
        np.repeat(least, widths)[order], common_lengths(suffixes[order], length), least=length
    )
    # The rows of a stretch differ in their own first document.
    each = widths[rows]
    window = np.arange(each.sum()) - np.repeat(np.cumsum(each) - each, each)
    copied = np.repeat(least[rows] < firsts, each)
    earlier = copied | (factors[np.repeat(edges[rows], each) + window] >= length)
    masks = np.zeros(len(rows), np.uint64)
    np.bitwise_or.at(masks, np.repeat(np.arange(len(rows)), each)[earlier], np.uint64(1) << window[earlier].astype(np.uint64))
    return masks


def drop_earlier_copies(
    docs: DataFrame, length: int = LENGTH, gram: int = GRAM, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """One row per input row: ``id_col`` (long), n_bytes, n_removed, n_spans, kept (binary).

    Removes each byte of a string of ``length`` bytes that also starts in a document of smaller
    id, so the first copy stays; strings are judged on the input and never cross documents.
    n_spans counts maximal removed runs. The suffixes that can match, those around recurring
    anchors, are sorted in shards; their longest previous factors decide.

    A null text counts as empty. Texts of any length are read whole. Rows that repeat an id are
    one document and remove nothing from each other; null ids count as larger than all others and
    come back as null. No rows give none; other columns are ignored.
    """
    if not 0 < length - gram < 64:
        raise ValueError("length must be longer than gram, by less than 64")

    def finish(ids: np.ndarray, texts: list[bytes], repeated: list[np.ndarray]) -> pd.DataFrame:
        out = []
        for doc, text, starts in zip(ids.tolist(), texts, repeated, strict=True):
            if len(starts):
                gone = covered(len(text), starts, length)
                spans = int(np.count_nonzero(np.diff(gone.astype(np.int8), prepend=0) == 1))
                kept = np.frombuffer(text, np.uint8)[~gone].tobytes()
            else:
                spans, kept = 0, text
            out.append((doc, len(text), len(text) - len(kept), spans, kept))
        return pd.DataFrame(out, columns=["id", "n_bytes", "n_removed", "n_spans", "kept"])

    rule = Rule(
        length, gram,
        elements=byte_elements,
        cut=lambda text, first, last: [text[a : b + length] for a, b in zip(first.tolist(), last.tolist(), strict=True)],
        other_documents=True,
        judge=lambda contents, numbers, rows: factor_masks(contents, numbers, rows, length),
        finish=finish,
    )
    found = repeated_windows(
        docs, rule, "id long, n_bytes long, n_removed long, n_spans long, kept binary", id_col, text_col
    )
    return found.select(F.nullif("id", F.lit(NO_ID)).alias(id_col), "n_bytes", "n_removed", "n_spans", "kept")
