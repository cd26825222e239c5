"""Licence scans over a positional index of rare words, with DataFrame functions only.

Templates and phrases are indexed by word and position. For each file the licence words it holds of highest
IDF are looked up; a posting at template position p and file position i says that the template starts at
i - p. Postings of different words are intersected by that start, and the mandatory phrases are verified in place.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass
from functools import reduce
from itertools import combinations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import shipped

#: A word: letters, digits and all beyond ASCII.
WORDS = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
_UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"

#: Phrases that name a licence, and its label.
PHRASES = {
    "gnu general public license": "gpl",
    "apache license": "apache",
    "cc by": "cc-by",
    "mit license": "mit",
}

#: Sentences of public licences and notices. Words in brackets are mandatory where they stand.
TEMPLATES = (
    ("mit", "permission is hereby granted [free of charge] to any person obtaining a copy of this software and associated documentation files"),
    ("mit", "the above copyright notice and this permission notice [shall be included in all copies] or substantial portions of the software"),
    ("bsd", "[redistribution and use in source and binary forms] with or without modification are permitted provided that the following conditions are met"),
    ("isc", "permission to use copy modify and or distribute this software [for any purpose with or without fee] is hereby granted"),
    ("apache", "you may not use this file except in compliance with the license you may obtain a copy of the license at http www [apache org licenses] license 2 0"),
    ("gpl", "this program is free software you can redistribute it and or modify it under the terms of the [gnu general public license] as published by the free software foundation"),
    ("lgpl", "under the terms of the [gnu lesser general public license] as published by the free software foundation"),
    ("agpl", "under the terms of the [gnu affero general public license] as published by the free software foundation"),
    ("mpl", "this source code form is subject to the terms of the [mozilla public license] v 2 0"),
    ("epl", "this program and the accompanying materials are made available under the terms of the [eclipse public license]"),
    ("cc-by", "this work is licensed under a [creative commons attribution] 4 0 international license"),
    ("cc-by-sa", "this work is licensed under a [creative commons attribution sharealike] 4 0 international license"),
    ("cc0", "to the extent possible under law the author has [waived all copyright and related] or neighboring rights to this work"),
    ("unlicense", "this is free and unencumbered software [released into the public domain]"),
    ("mit", "[released under the mit] license"),
    ("apache", "[licensed under the apache] license version 2 0"),
    ("bsd", "use of this source code is governed by a [bsd style license] that can be found in the license file"),
)


@dataclass(frozen=True)
class Template:
    """Words of a licence text; ``must`` are the positions of its mandatory words."""

    label: str
    words: tuple[str, ...]
    must: tuple[int, ...]

    @staticmethod
    def of(label: str, text: str) -> Template:
        words, must, inside = [], [], False
        for token in text.split():
            inside |= token.startswith("[")
            if inside:
                must.append(len(words))
            inside &= not token.endswith("]")
            words.append(token.strip("[]"))
        return Template(label, tuple(words), tuple(must))


SHIPPED = tuple(Template.of(*t) for t in TEMPLATES)


def plain_words(text: Column) -> Column:
    """Words of a text, A-Z in lower case; a null text has none."""
    return F.regexp_extract_all(F.translate(F.coalesce(text, F.lit("")), _UPPER, _UPPER.lower()), F.lit(WORDS), 0)


def bound(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use(value)`` with ``value`` computed once for the row, however often it is used."""
    return F.transform(F.array(value), use)[0]


def _words(words) -> Column:
    return F.array(*(F.lit(w) for w in words))


def ranked_words(texts: DataFrame, vocabulary: list[str]) -> list[str]:
    """Licence words by falling IDF: by documents that hold them, rising, ties by word.

    All texts are read; a row per word of the vocabulary comes to the driver.
    """
    held = F.explode(F.array_intersect(plain_words(F.col("text")), _words(vocabulary)))
    counts = texts.select(held.alias("word")).groupBy("word").count()
    found = {r["word"]: r["count"] for r in counts.collect()}
    return sorted(vocabulary, key=lambda w: (found.get(w, 0), w.encode()))


def _starts(spots: Column, words: tuple[str, ...], word: Column) -> Column:
    """Starts that the places of ``word`` give a template of ``words``; ``spots`` are (at, word), the file's licence words."""
    at = F.transform(F.filter(spots, lambda s: s["word"] == word), lambda s: s["at"])
    pairs = F.array(*(F.struct(F.lit(p).alias("p"), F.lit(w).alias("w")) for p, w in enumerate(words)))
    postings = F.filter(pairs, lambda t: t["w"] == word)
    return F.flatten(F.transform(postings, lambda t: F.transform(at, lambda i: i - t["p"])))


def _places(spots: Column, phrase: tuple[str, ...], order: list[str], label: str) -> Column:
    """Where all words of a phrase stand one after the other: postings intersected, the rarest first."""
    first, *rest = sorted(range(len(phrase)), key=lambda p: order.index(phrase[p]))

    def of(p: int) -> Column:
        return F.transform(F.filter(spots, lambda s: s["word"] == phrase[p]), lambda s: s["at"] - F.lit(p))

    starts = of(first)
    for p in rest:
        starts = F.array_intersect(starts, of(p))
    return F.transform(
        F.array_distinct(starts),
        lambda i: F.struct(i.alias("start"), F.lit(len(phrase)).alias("words"), F.lit(label).alias("label")),
    )


def _aligned(spots: Column, words: Column, present: Column, template: Template, order: list[str], lookups: int) -> Column:
    """Shares of the template's words that stand in place, for each verified start; see ``scan_licences``."""
    ranked = _words([w for w in order if w in template.words])
    rarest = F.slice(F.array_intersect(ranked, present), 1, lookups)
    none = F.array().cast("array<int>")

    def agreed(rare: Column) -> Column:
        lists = [F.when(F.size(rare) > r, _starts(spots, template.words, F.get(rare, F.lit(r)))).otherwise(none) for r in range(lookups)]
        pairs = lambda found: F.array_distinct(
            F.concat(*(F.array_intersect(found[a], found[b]) for a, b in combinations(range(lookups), 2)))
        )
        return bound(F.array(*lists), pairs)

    expected = F.array(
        *(F.struct(F.lit(p).alias("p"), F.lit(w).alias("w")) for p, w in enumerate(template.words))
    )
    must = F.array(*(F.struct(F.lit(p).alias("p"), F.lit(template.words[p]).alias("w")) for p in template.must))

    def there(start: Column, t: Column) -> Column:
        return F.coalesce(F.get(words, start + t["p"]) == t["w"], F.lit(False))

    verified = F.filter(bound(rarest, agreed), lambda start: F.forall(must, lambda t: there(start, t)))
    shares = F.transform(
        verified, lambda start: F.size(F.filter(expected, lambda t: there(start, t))) / F.lit(float(len(template.words)))
    )
    return F.transform(shares, lambda share: F.struct(F.lit(template.label).alias("label"), share.alias("share")))


def scan_licences(
    docs: DataFrame,
    *,
    phrases: dict[str, str] = PHRASES,
    templates: tuple[Template, ...] = SHIPPED,
    least: float = 0.8,
    lookups: int = 3,
    id_col: str = "doc_id",
    text_col: str = "text",
) -> DataFrame:
    """One row per input row: ``id_col``, n_words, places, base_labels, labels, score.

    ``places`` holds the start (word from 0), words and label of each phrase that stands in the text, by
    start and label, overlapping ones too; ``base_labels`` their labels, distinct and sorted. A template
    adds its label if two of its ``lookups`` words of highest IDF in the file agree on a start, all mandatory
    words stand in place from there, and so do at least the share ``least`` of all its words. ``score`` is 1 with a
    phrase, else the best such share, else 0. A null or empty text has no words, places or labels; rows
    without or with repeated ids are rows of their own; no rows in, none out. Columns beside id and text
    play no part. A row is judged by itself, whatever its length: nothing is shuffled but word counts.
    """
    shipped(docs.sparkSession)
    cut = {tuple(p.split(" ")): label for p, label in phrases.items()}
    vocabulary = sorted({w for p in cut for w in p} | {w for t in templates for w in t.words})
    texts = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    order = ranked_words(texts.select("text"), vocabulary)

    def judged(words: Column) -> Column:
        # The licence words of a file, once each.
        return bound(F.array_intersect(_words(vocabulary), words), lambda present: matched(words, present))

    def matched(words: Column, present: Column) -> Column:
        # A file without all mandatory words of anything holds nothing, so its words need no places.
        def able(needed) -> Column:
            needed = sorted(set(needed))
            return F.size(F.array_intersect(_words(needed), present)) == len(needed)

        any_phrase = reduce(Column.__or__, (able(p) for p in cut), F.lit(False))
        any_template = reduce(Column.__or__, (able(t.words[p] for p in t.must) for t in templates), F.lit(False))
        spots = F.filter(
            F.transform(words, lambda w, i: F.struct(i.alias("at"), w.alias("word"))), lambda s: s["word"].isin(vocabulary)
        )

        def found(spots: Column) -> Column:
            base = [F.when(able(p), _places(spots, p, order, label)).otherwise(no_place) for p, label in cut.items()]
            more = [
                F.when(
                    able(t.words[p] for p in t.must),
                    F.filter(_aligned(spots, words, present, t, order, lookups), lambda m: m["share"] >= least),
                ).otherwise(no_more)
                for t in templates
            ]
            return F.struct(
                F.size(words).cast("long").alias("n_words"),
                F.array_sort(F.concat(no_place, *base)).alias("places"),
                F.concat(no_more, *more).alias("more"),
            )

        no_spot = F.array().cast("array<struct<at:int,word:string>>")
        return bound(F.when(any_phrase | any_template, spots).otherwise(no_spot), found)

    no_place = F.array().cast("array<struct<start:int,words:int,label:string>>")
    no_more = F.array().cast("array<struct<label:string,share:double>>")
    found = texts.select("id", bound(plain_words(F.col("text")), judged).alias("found")).select("id", "found.*")
    base = F.array_sort(F.array_distinct(F.transform("places", lambda p: p["label"])))
    named = F.transform("more", lambda m: m["label"])
    share = F.coalesce(F.array_max(F.transform("more", lambda m: m["share"])), F.lit(0.0))
    return found.select(
        F.col("id").alias(id_col), "n_words", "places", base.alias("base_labels"),
        F.array_sort(F.array_union(base, named)).alias("labels"),
        F.when(F.size("places") > 0, F.lit(1.0)).otherwise(share).alias("score"),
    )
