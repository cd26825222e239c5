"""Token counts by byte-pair merging with a heap and a linked list; no identifiers are made."""

from __future__ import annotations

import json
import re
from collections.abc import Iterator
from functools import lru_cache
from heapq import heapify, heappop, heappush

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Memo

#: Counts that a Python worker remembers, twice over and per level.
_KEPT = 200_000


def merged_length(symbols: list[int], merges: dict[int, tuple[int, int]]) -> int:
    """Symbols left after merging: pop the pair of the lowest rank, the leftmost of equals.

    ``merges`` maps a pair, as left * 2**32 + right, to its rank and the symbol it becomes.
    """
    n = len(symbols)
    heap = []
    for i in range(n - 1):
        if (found := merges.get(symbols[i] << 32 | symbols[i + 1])) is not None:
            heap.append((found[0], i, found[1]))
    if not heap:
        return n
    heapify(heap)
    after = list(range(1, n + 1))
    ahead = list(range(-1, n - 1))
    done = 0
    while heap:
        rank, i, became = heappop(heap)
        j = after[i]
        # A pair that has changed since it was pushed is stale.
        if j >= n or symbols[i] < 0:
            continue
        now = merges.get(symbols[i] << 32 | symbols[j])
        if now is None or now[0] != rank:
            continue
        symbols[i], symbols[j] = became, -1
        done += 1
        k = after[i] = after[j]
        if k < n:
            ahead[k] = i
            if (found := merges.get(became << 32 | symbols[k])) is not None:
                heappush(heap, (found[0], i, found[1]))
        h = ahead[i]
        if h >= 0 and (found := merges.get(symbols[h] << 32 | became)) is not None:
            heappush(heap, (found[0], h, found[1]))
    return n - done


def _plain_rule(data: dict) -> re.Pattern | None:
    """The word rule for printable ASCII, if that needs no more than lower case and one pattern."""
    import regex

    steps = (data["normalizer"] or {}).get("normalizers", [])
    cuts = (data["pre_tokenizer"] or {}).get("pretokenizers", [])
    if {s["type"] for s in steps} != {"NFC", "Replace", "Lowercase"} or len(cuts) != 2:
        return None
    split, level = cuts
    kept = split["type"] == "Split" and split["behavior"] == "Removed" and split["invert"]
    if not kept or level["type"] != "ByteLevel" or level["use_regex"] or level["add_prefix_space"]:
        return None
    return regex.compile(split["pattern"]["Regex"])


class MergeCounter:
    """Counts as the tokenizers library does for a JSON file of a BPE model.

    Normalising and cutting into words is left to the library; the merging is done here. A text
    is cut at single spaces first, which no normaliser or word rule of these files looks across,
    and counts of pieces and words are remembered.
    """

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        with open(path, encoding="utf-8") as file:
            data = json.load(file)
        model = data["model"]
        odd = [k for k in ("dropout", "unk_token", "continuing_subword_prefix", "byte_fallback", "ignore_merges") if model.get(k)]
        if model["type"] != "BPE" or odd:
            raise ValueError(f"not a plain BPE model: {path} {odd}")
        pairs = (tuple(m.split(" ")) if isinstance(m, str) else tuple(m) for m in model["merges"])
        ids = self.ids = model["vocab"]
        self.merges = {ids[a] << 32 | ids[b]: (i, ids[a + b]) for i, (a, b) in enumerate(pairs)}
        self.suffix = model["end_of_word_suffix"] or ""
        library = Tokenizer.from_file(path)
        self.plain = _plain_rule(data)
        self.normalizer, self.words = library.normalizer, library.pre_tokenizer
        specials = sorted((t["content"] for t in data["added_tokens"]), key=len, reverse=True)
        if any(t["normalized"] or t["single_word"] or t["lstrip"] or t["rstrip"] or " " in t["content"] for t in data["added_tokens"]):
            raise ValueError(f"special tokens with white space or rules of their own: {path}")
        self.special = re.compile("|".join(map(re.escape, specials))) if specials else None
        self.pieces, self.counted = Memo(_KEPT), Memo(_KEPT)

    def word(self, word: str) -> int:
        if word in self.counted:
            return self.counted[word]
        symbols = [*word[:-1], word[-1] + self.suffix]
        # A symbol outside the vocabulary has no token and no merge, but keeps others apart.
        known = [self.ids.get(s, -1) for s in symbols]
        n, start = 0, 0
        for i in [*(i for i, s in enumerate(known) if s < 0), len(known)]:
            n += merged_length(known[start:i], self.merges)
            start = i + 1
        if len(word) <= 64:
            self.counted.put(word, n)
        return n

    def piece(self, piece: str) -> int:
        parts, n = [piece], 0
        if self.special is not None:
            parts = self.special.split(piece)
            n = len(parts) - 1
        for part in parts:
            if self.plain is not None and part.isascii() and part.isprintable():
                n += sum(map(self.word, self.plain.findall(part.lower())))
            elif part:
                plain = self.normalizer.normalize_str(part) if self.normalizer else part
                n += sum(self.word(w) for w, _ in self.words.pre_tokenize_str(plain))
        return n

    def count(self, text: str | None) -> int:
        total, known = 0, self.pieces
        for piece in (text or "").split(" "):
            try:
                total += known[piece]
            except KeyError:
                n = self.piece(piece)
                total += n
                if len(piece) <= 64:
                    known.put(piece, n)
        return total


@lru_cache(maxsize=2)
def counter(path: str) -> MergeCounter:
    return MergeCounter(path)


def default_path(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def count_tokens(
    docs: DataFrame,
    tokenizer: str | None = None,
    limit: int = 2048,
    id_col: str = "doc_id",
    text_col: str = "text",
) -> DataFrame:
    """One row per input row: ``id_col``, n_bytes (UTF-8), n_tokens, over_limit.

    ``tokenizer`` is the path of a JSON file, on every executor; the default is
    ``word_bpe_49k.json``. It must drop white space between words, as that file does. Whole texts
    count, strings of special tokens inside them as one token each. A null text counts as empty:
    0 bytes, 0 tokens. Repeated rows are counted each; no rows give none; other columns are ignored.
    """

    @F.pandas_udf("long")
    def n_tokens(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        merges = counter(tokenizer or default_path("word_bpe_49k.json"))
        for batch in batches:
            yield batch.map(merges.count)

    text = F.coalesce(F.col(text_col), F.lit(""))
    return docs.select(
        F.col(id_col),
        F.octet_length(text).cast("long").alias("n_bytes"),
        n_tokens(text).alias("n_tokens"),
    ).withColumn("over_limit", F.col("n_tokens") > limit)
