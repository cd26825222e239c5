"""Language identification with hyperdimensional profiles."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import released, shipped

#: Dimensions of a vector.
DIMENSIONS = 512
#: Letters bound into one n-gram vector.
GRAM = 3
SEED = 20_231
#: Learning more labels than this raises; their profiles are sent to all executors.
MAX_LANGUAGES = 4_096
#: n-gram vectors that a Python worker keeps (a byte for each dimension).
_KEPT = 16_384
#: n-grams and texts that are multiplied at once; n-grams of labelled texts counted before they are summed up.
_SLAB = 1_024
_TEXTS = 128
_PENDING = 1 << 20
#: A limit is this part of the score that all but ``LOW`` of the labelled texts of like length reach.
SHARE = 0.5
LOW = 0.05
#: No limit lies within so many standard deviations of chance.
CHANCE = 3.0


class GramSpace:
    """Vectors of letters and n-grams, made from ``seed`` alone, so each worker makes the same."""

    def __init__(self, dimensions: int = DIMENSIONS, gram: int = GRAM, seed: int = SEED):
        self.dimensions, self.gram, self.seed = dimensions, gram, seed
        self.is_letter = np.fromiter((chr(c).isalpha() for c in range(0x110000)), bool, 0x110000)
        self.letters: dict[int, np.ndarray] = {}
        self.rows: dict[int, int] = {}
        self.grams = np.empty((_KEPT, dimensions), np.int8)

    def letter(self, code: int) -> np.ndarray:
        """A random vector of +1 and -1; code 0 is the gap between words."""
        if code not in self.letters:
            bits = np.random.default_rng([self.seed, code]).integers(0, 2, self.dimensions)
            self.letters[code] = (2 * bits - 1).astype(np.float32)
        return self.letters[code]

    def bound(self, key: int) -> np.ndarray:
        """Letters of an n-gram, each permuted by its place, multiplied elementwise."""
        out = np.ones(self.dimensions, np.float32)
        for place in range(self.gram):
            out = out * np.roll(self.letter(key & 0x1FFFFF), place)
            key >>= 21
        return out

    def vectors(self, keys: np.ndarray) -> np.ndarray:
        if len(self.rows) + len(keys) > _KEPT:
            self.rows.clear()
        if len(keys) > _KEPT:
            return np.stack([self.bound(k) for k in keys.tolist()])
        at = []
        for k in keys.tolist():
            row = self.rows.get(k)
            if row is None:
                row = self.rows[k] = len(self.rows)
                self.grams[row] = self.bound(k)
            at.append(row)
        return self.grams[at].astype(np.float32)

    def counted(self, text: str | None) -> tuple[np.ndarray, np.ndarray] | None:
        """Distinct n-grams of a text's lower-case letters, sorted, and their counts; None without a letter."""
        if not text:
            return None
        codes = np.frombuffer(text.lower().encode("utf-32-le", "replace"), "<u4").astype(np.int64)
        codes = np.where(self.is_letter[codes], codes, 0)
        if not codes.any():
            return None
        codes = np.concatenate(([0], codes, [0]))
        codes = codes[(codes != 0) | np.concatenate(([True], codes[:-1] != 0))]
        n = len(codes) - self.gram + 1
        keys = sum(codes[i : n + i] << (21 * (self.gram - 1 - i)) for i in range(self.gram))
        return np.unique(keys, return_counts=True)

    def bundles(self, texts: list[tuple[np.ndarray, np.ndarray]]) -> np.ndarray:
        """The bundle of each text's counted n-grams, a row each; whole numbers, so exact."""
        out = np.zeros((len(texts), self.dimensions))
        keys = np.unique(np.concatenate([k for k, _ in texts]))
        # Single precision holds sums of this size.
        kind = np.float32 if max(int(c.sum()) for _, c in texts) < 1 << 24 else np.float64
        for i in range(0, len(keys), _SLAB):
            slab = keys[i : i + _SLAB]
            dense = np.zeros((len(texts), len(slab)), kind)
            for row, (mine, counts) in enumerate(texts):
                a, b = np.searchsorted(mine, slab[0]), np.searchsorted(mine, slab[-1], "right")
                dense[row, np.searchsorted(slab, mine[a:b])] = counts[a:b]
            out += dense @ self.vectors(slab)
        return out

    def profile(self, text: str | None) -> np.ndarray | None:
        """The bundle of a text's n-grams over lower-case letters; None without a letter."""
        counted = self.counted(text)
        return None if counted is None else self.bundles([counted])[0]


_SPACES: dict[tuple, GramSpace] = {}


def space(*settings) -> GramSpace:
    """One per Python worker and setting."""
    if settings not in _SPACES:
        _SPACES[settings] = GramSpace(*settings)
    return _SPACES[settings]


def forgotten() -> None:
    """Drop the vectors at the end of a task: they are large in many dimensions, and workers stay for other work."""
    _SPACES.clear()
    released()


class LanguageProfiles:
    """Learned prototypes: ``languages`` and one vector each."""

    def __init__(self, languages: list[str], vectors: np.ndarray, settings: tuple):
        self.languages, self.settings = languages, settings
        self.norms = np.linalg.norm(vectors, axis=1)
        self.vectors = vectors / np.where(self.norms > 0, self.norms, 1.0)[:, None]

    def predict(self, text: str | None) -> tuple[str, float, bool]:
        """Label, cosine cut to 0..1, and whether the text has a letter."""
        return self.predict_all([text])[0][:3]

    def predict_all(self, texts: list, labels: list | None = None) -> list[tuple[str, float, bool, int, float | None]]:
        """For each text what ``predict`` tells, the number of its distinct n-grams, and its clean score.

        The clean score is the largest cosine once the text itself is taken out of the profile of its
        label; None if it has no learned label, or is all that its label has.
        """
        found = space(*self.settings)
        row = {lang: i for i, lang in enumerate(self.languages)}
        out = []
        for i in range(0, len(texts), _TEXTS):
            counted = [found.counted(t) for t in texts[i : i + _TEXTS]]
            full = [c for c in counted if c is not None]
            bundles = iter(found.bundles(full) if full and self.languages else ())
            for k, c in enumerate(counted):
                if c is None or not self.languages:
                    out.append(("und", 0.0, c is not None, 0 if c is None else len(c[0]), None))
                    continue
                bundle = next(bundles)
                norm = np.linalg.norm(bundle) or 1.0
                cosines = self.vectors @ bundle / norm
                best = int(np.argmax(cosines))  # ties: the first label by code point
                own = row.get(labels[i + k]) if labels is not None else None
                clean = None if own is None else self._without(cosines, own, norm)
                out.append((self.languages[best], float(min(1.0, max(0.0, cosines[best]))), True, len(c[0]), clean))
        return out

    def _without(self, cosines: np.ndarray, own: int, norm: float) -> float | None:
        dot = cosines[own] * norm * self.norms[own]
        rest = self.norms[own] ** 2 - 2 * dot + norm**2
        if rest < 0.5:  # sums are whole numbers
            return None
        return float(max((dot - norm**2) / np.sqrt(rest) / norm, *np.delete(cosines, own), -1.0))


def learn_profiles(
    labelled: DataFrame,
    text_col: str = "text",
    lang_col: str = "lang",
    dimensions: int = DIMENSIONS,
    gram: int = GRAM,
    seed: int = SEED,
) -> LanguageProfiles:
    """Bundle all texts of each non-null label into its prototype.

    Tasks send one vector of sums per label, so what is moved does not grow with the texts. The
    sums are whole numbers, so their order does not matter. Rows without a label or a letter
    teach nothing; without any, there are no languages and every text is ``und``.
    """
    settings = (dimensions, gram, seed)

    def sums(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        # n-grams are counted per label first: bundling is a sum, so each is multiplied once.
        per: dict[str, list] = {}
        pending = 0

        def merged(lang: str) -> tuple[np.ndarray, np.ndarray]:
            keys, of = np.unique(np.concatenate([k for k, _ in per[lang]]), return_inverse=True)
            counts = np.bincount(of, weights=np.concatenate([c for _, c in per[lang]]))
            return keys, counts.astype(np.int64)

        def bundled() -> Iterator[pd.DataFrame]:
            for lang in per:
                vector = space(*settings).bundles([merged(lang)])[0]
                yield pd.DataFrame({"lang": lang, "dim": np.arange(dimensions), "value": vector})

        for batch in batches:
            for text, lang in zip(batch["text"], batch["lang"], strict=True):
                counted = space(*settings).counted(text)
                if counted is None:
                    continue
                per.setdefault(lang, []).append(counted)
                pending += len(counted[0])
                if pending > _PENDING:
                    per = {lang: [merged(lang)] for lang in per}
                    pending = sum(len(c[0][0]) for c in per.values())
                    if pending > _PENDING // 2:
                        yield from bundled()
                        per, pending = {}, 0
        yield from bundled()
        forgotten()

    shipped(labelled.sparkSession)
    rows = labelled.select(F.col(text_col).alias("text"), F.col(lang_col).alias("lang"))
    rows = rows.where("lang is not null and text is not null")
    summed = rows.mapInPandas(sums, "lang string, dim int, value double")
    summed = summed.groupBy("lang", "dim").agg(F.sum("value").alias("value"))
    if rows.select("lang").distinct().limit(MAX_LANGUAGES + 1).count() > MAX_LANGUAGES:
        raise ValueError(f"more than {MAX_LANGUAGES} labels")
    got = summed.collect()
    languages = sorted({r["lang"] for r in got}, key=lambda s: s.encode())
    vectors = np.zeros((len(languages), dimensions))
    row = {lang: i for i, lang in enumerate(languages)}
    for r in got:
        vectors[row[r["lang"]], r["dim"]] = r["value"]
    return LanguageProfiles(languages, vectors, settings)


def identify(
    docs: DataFrame, profiles: LanguageProfiles, text: str | Column = "text", label: str | Column | None = None
) -> Column:
    """A column of struct<lang_pred string, score double, has_letter boolean> of a text.

    ``lang_pred`` is ``und`` with score 0 for a text that is null or has no letter, and for every
    text if nothing was learned. Whole texts are compared; ties go to the first label. The text is
    the only input, unless a ``label`` is given: then n_grams and clean_score are added (see
    ``LanguageProfiles.predict_all``), which ``limits`` needs.
    """
    shared = docs.sparkSession.sparkContext.broadcast(profiles)
    names = ["lang_pred", "score", "has_letter"]
    if label is None:

        @F.pandas_udf("lang_pred string, score double, has_letter boolean")
        def predicted(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
            for texts in batches:
                yield pd.DataFrame([f[:3] for f in shared.value.predict_all(texts.tolist())], columns=names)
            forgotten()

        return predicted(text)

    @F.pandas_udf("lang_pred string, score double, has_letter boolean, n_grams int, clean_score double")
    def with_clean(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.DataFrame]:
        for texts, labels in batches:
            found = shared.value.predict_all(texts.tolist(), labels.tolist())
            yield pd.DataFrame(found, columns=[*names, "n_grams", "clean_score"])
        forgotten()

    return with_clean(text, label)


def _band(n_grams: Column) -> Column:
    return F.floor(F.log2(F.greatest(n_grams, F.lit(1)))).cast("int")


def limits(found: DataFrame, column: str, dimensions: int) -> Column:
    """The least score of a text in a learned language, by the number of its distinct n-grams.

    ``found`` has what ``identify`` tells of labelled texts as ``column``. Texts are alike in length if
    their numbers of n-grams have the same power of two. Their limit is ``SHARE`` of the clean
    score that all but ``LOW`` of them reach, of the next shorter ones if there are none, and
    never within ``CHANCE`` standard deviations of what chance gives.
    """
    clean = found.where(F.col(column)["clean_score"].isNotNull()).groupBy(_band(F.col(column)["n_grams"]).alias("band"))
    rows = clean.agg(F.percentile_approx(F.col(column)["clean_score"], F.lit(LOW), F.lit(1000)).alias("low")).collect()
    out = least = F.lit(CHANCE / dimensions**0.5)
    for r in sorted(rows, key=lambda r: r["band"]):
        limit = F.greatest(least, F.lit(SHARE * r["low"]))
        out = F.when(_band(F.col(column)["n_grams"]) >= r["band"], limit).otherwise(out)
    return out
