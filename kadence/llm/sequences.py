"""Hashes of words and grams, and anchors that repeated windows share, with numpy."""

from __future__ import annotations

from functools import lru_cache

import numpy as np

_U = np.uint64
_BASE = 0x9E3779B97F4A7C15 | 1
#: Elements handled at once; positions in a slice need 24 bits.
SLICE = 1 << 20
_MASK = _U((1 << 24) - 1)
_SPACE = np.zeros(256, bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32


def mixed(h: np.ndarray) -> np.ndarray:
    """Spread the bits of 64-bit numbers."""
    h = (h ^ (h >> _U(30))) * _U(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> _U(27))) * _U(0x94D049BB133111EB)
    return h ^ (h >> _U(31))


_BYTE = mixed(np.arange(1, 257, dtype=_U) * _U(_BASE))


def words(data: bytes, lower: bool = False) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start, end and 64-bit hash of each word of UTF-8 bytes; words stand between ASCII white space.

    ``lower`` hashes A-Z as a-z.
    """
    raw = np.frombuffer(data + bytes(8), np.uint8)
    inside = ~_SPACE[raw]
    inside[-8:] = False
    edges = np.flatnonzero(np.diff(inside, prepend=False))
    starts, ends = edges[::2], edges[1::2]
    if lower:
        raw = _LOWER[raw]
    eight = np.ndarray(len(raw) - 7, "<u8", buffer=np.ascontiguousarray(raw), strides=(1,))
    lengths = ends - starts
    hashes = mixed(lengths.astype(_U) * _U(_BASE))
    live, at = np.arange(len(starts)), 0
    while len(live):
        rest = lengths[live] - at
        part = eight[starts[live] + at]
        short = rest < 8
        part = np.where(short, part & ((_U(1) << (_U(8) * np.minimum(rest, 7).astype(_U))) - _U(1)), part)
        hashes[live] = mixed(hashes[live] ^ part) + _U(_BASE)
        at += 8
        live = live[rest > 8]
    return starts, ends, hashes


@lru_cache(maxsize=1)
def _powers() -> tuple[np.ndarray, np.ndarray]:
    def powers(base: int) -> np.ndarray:
        row = np.full(SLICE * 2, base, _U)
        row[0] = 1
        return np.cumprod(row, dtype=_U)

    return powers(_BASE), powers(pow(_BASE, -1, 1 << 64))


class Rolling:
    """Hashes of stretches of a slice of elements."""

    def __init__(self, elements: np.ndarray):
        power, self.inverse = _powers()
        self.sums = np.concatenate(([_U(0)], np.cumsum(elements * power[: len(elements)], dtype=_U)))

    def hashes(self, starts, ends) -> np.ndarray:
        """Equal stretches have equal hashes; other lengths, other hashes."""
        lengths = np.asarray(ends - starts).astype(_U)
        return mixed((self.sums[ends] - self.sums[starts]) * self.inverse[starts] + lengths * _U(0xD6E8FEB86659FD93))

    def grams(self, length: int) -> np.ndarray:
        n = len(self.sums) - length
        return mixed((self.sums[length:] - self.sums[:n]) * self.inverse[:n])


def _minima(values: np.ndarray, width: int) -> np.ndarray:
    """Smallest value of each ``width`` neighbours."""
    span = 1
    while span * 2 <= width:
        values = np.minimum(values[:-span], values[span:])
        span *= 2
    return np.minimum(values[: len(values) - (width - span)], values[width - span :]) if width > span else values


def byte_elements(data: bytes) -> np.ndarray:
    return _BYTE[np.frombuffer(data, np.uint8)]


def anchored(elements: list[np.ndarray], window: int, gram: int):
    """Windows of ``window`` elements, grouped by the gram of smallest hash inside them.

    Equal windows have that gram, the anchor, at the same place, wherever they stand. Returns
    arrays with a row per run of windows of one anchor: number of the document, first and last
    window, hash of the anchor, hash of the elements the run covers. A document may be of any
    length.
    """
    pieces: list[tuple[int, int, np.ndarray]] = []
    size, out = 0, []

    def flush():
        nonlocal pieces, size
        if pieces:
            out.append(_anchored_slice(pieces, window, gram))
        pieces, size = [], 0

    for doc, row in enumerate(elements):
        for base in range(0, max(0, len(row) - window + 1), SLICE // 2):
            piece = row[base : base + SLICE // 2 + window - 1]
            if size + len(piece) > SLICE:
                flush()
            pieces.append((doc, base, piece))
            size += len(piece)
    flush()
    if not out:
        empty = np.empty(0, np.int64)
        return empty, empty, empty, empty.astype(_U), empty.astype(_U)
    return tuple(np.concatenate(parts) for parts in zip(*out, strict=True))


def _anchored_slice(pieces, window: int, gram: int):
    lengths = np.array([len(p) for _, _, p in pieces])
    starts = np.cumsum(lengths) - lengths
    rolling = Rolling(np.concatenate([p for _, _, p in pieces]))
    grams = rolling.grams(gram)
    least = _minima((grams & ~_MASK) | np.arange(len(grams), dtype=_U), window - gram + 1)
    valid = np.concatenate(
        [np.arange(s, s + n - window + 1) for s, n in zip(starts.tolist(), lengths.tolist(), strict=True)]
    )
    anchor = (least[valid] & _MASK).astype(np.int64)
    first = np.flatnonzero(np.concatenate(([True], (np.diff(anchor) != 0) | (np.diff(valid) != 1))))
    last = np.concatenate((first[1:], [len(valid)])) - 1
    lo, hi = valid[first], valid[last]
    piece = np.searchsorted(starts, lo, "right") - 1
    doc = np.array([d for d, _, _ in pieces])[piece]
    base = np.array([b for _, b, _ in pieces])[piece] - starts[piece]
    return doc, lo + base, hi + base, grams[anchor[first]], rolling.hashes(lo, hi + window)


def covered(length: int, first: np.ndarray, width: int) -> np.ndarray:
    """Which of ``length`` elements lie in a window of ``width`` that starts at one of ``first``."""
    steps = np.zeros(length + 1, np.int64)
    np.add.at(steps, first, 1)
    np.add.at(steps, first + width, -1)
    return np.cumsum(steps[:-1]) > 0
