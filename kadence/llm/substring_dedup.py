"""Substring dedup with repeated-phrase automata."""

from __future__ import annotations

import ahocorasick
import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .repeats import NO_ID, Rule, repeated_windows
from .sequences import Rolling, covered, mixed, words

#: Words of a passage that must recur as a whole.
WINDOW = 35
#: Words of an anchor.
GRAM = 8


def _cut(text: bytes, first: np.ndarray, last: np.ndarray, window: int) -> list[bytes]:
    starts, ends, _ = words(text)
    return [
        b" ".join(text[starts[a + i] : ends[a + i]] for i in range(b - a + window))
        for a, b in zip(first.tolist(), last.tolist(), strict=True)
    ]


def automaton_masks(contents: list[bytes], counts: np.ndarray, rows: np.ndarray, window: int) -> np.ndarray:
    """Masks of recurring windows of each row's stretch of words.

    Confirms the windows that recur, joins neighbours to phrases, compiles them into an
    Aho-Corasick automaton over word numbers and streams every stretch through it.
    """
    number: dict[bytes, int] = {}
    texts = [tuple(number.setdefault(w, len(number)) for w in c.split(b" ")) for c in contents]
    times = np.bincount(rows, weights=counts, minlength=len(texts)).astype(np.int64)
    # Hashes of windows, in portions that fit a slice.
    hashes, portion = [], []
    portions, size = [], 0
    for t in texts:
        if size + len(t) > 1 << 20:
            portions.append(portion)
            portion, size = [], 0
        portion.append(t)
        size += len(t)
    for some in [*portions, portion]:
        flat = np.fromiter((w for t in some for w in t), np.uint64)
        rolling = Rolling(mixed(flat + np.uint64(1)))
        edges = np.cumsum([0, *map(len, some)])
        starts = np.concatenate([np.arange(a, b - window + 1) for a, b in zip(edges, edges[1:], strict=False)])
        hashes.append(rolling.hashes(starts, starts + window))
    widths = np.array([len(t) - window + 1 for t in texts])
    _, same = np.unique(np.concatenate(hashes), return_inverse=True)
    recurs = np.bincount(same, weights=np.repeat(times, widths))[same] > 1
    edges = np.cumsum([0, *widths])
    automaton = ahocorasick.Automaton(ahocorasick.STORE_INTS, ahocorasick.KEY_SEQUENCE)
    for t, a, b in zip(texts, edges.tolist(), edges[1:].tolist(), strict=False):
        steps = np.flatnonzero(np.diff(recurs[a:b], prepend=False, append=False))
        for first, end in zip(steps[::2].tolist(), steps[1::2].tolist(), strict=True):
            phrase = t[first : end + window - 1]
            automaton.add_word(phrase, len(phrase))
    masks = np.zeros(len(texts), np.uint64)
    if len(automaton):
        automaton.make_automaton()
        for i, t in enumerate(texts):
            mask = 0
            for end, length in automaton.iter(t):
                mask |= ((1 << (length - window + 1)) - 1) << (end + 1 - length)
            masks[i] = mask
    return masks[rows]


def drop_repeated_passages(
    docs: DataFrame, window: int = WINDOW, gram: int = GRAM, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """One row per input row: ``id_col``, n_words, n_removed, kept (the words that stay).

    Each word of a window of ``window`` words that starts in at least two places, in one document
    or several, is removed; windows are judged on the input. Passages are confirmed per shard of
    anchors, compiled into that shard's automaton, and every document is streamed through the
    automata of its anchors, as the distinct stretches around them, to locate every occurrence.

    A null text counts as empty and has no words. Texts of any length are read whole. Rows that
    repeat a text make all its windows recur, so each loses them; null ids come back as null. No
    rows give none; other columns are ignored.
    """
    if not 0 < window - gram < 64:
        raise ValueError("window must be longer than gram, by less than 64")

    def finish(ids: np.ndarray, texts: list[bytes], repeated: list[np.ndarray]) -> pd.DataFrame:
        out = []
        for doc, text, starts in zip(ids.tolist(), texts, repeated, strict=True):
            first, end, _ = words(text)
            gone = covered(len(first), starts, window)
            kept = b" ".join([text[a:b] for a, b in zip(first[~gone].tolist(), end[~gone].tolist(), strict=True)])
            out.append((doc, len(first), int(gone.sum()), kept.decode()))
        return pd.DataFrame(out, columns=["id", "n_words", "n_removed", "kept"])

    rule = Rule(
        window, gram,
        elements=lambda text: words(text)[2],
        cut=lambda text, first, last: _cut(text, first, last, window),
        other_documents=False,
        judge=lambda contents, numbers, rows: automaton_masks(contents, numbers, rows, window),
        finish=finish,
    )
    found = repeated_windows(docs, rule, "id long, n_words long, n_removed long, kept string", id_col, text_col)
    return found.select(F.nullif("id", F.lit(NO_ID)).alias(id_col), "n_words", "n_removed", "kept")


