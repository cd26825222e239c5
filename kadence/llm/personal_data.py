"""Personal data: generators propose spans, boosted trees and calibrated thresholds select them."""

from __future__ import annotations

import ipaddress
import re
import zlib
from collections.abc import Iterator
from dataclasses import dataclass, field

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .boosting import BoostedTrees
from .common import checkpointed, shipped

KINDS = ("email", "ip", "card", "phone")
#: The precision a threshold must reach.
PRECISION = 0.98
#: Cells of equal width that scores are summed up by.
CELLS = 4096
#: Context that features see on either side of a span.
CONTEXT = 24

_LOCAL = frozenset("abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789._%+-")
_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
# A match starts where a run of digits does, so none is tried from inside one.
_IP = re.compile(r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_HINT = re.compile(r"[0-9@]|[(\[]at[)\]]| at ", re.IGNORECASE)

#: Wider patterns of the generators, by kind. Runs are taken whole and never tried from inside.
_PROPOSED = (
    re.compile(
        r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]++(?:@|\x20?[(\[]at[)\]]\x20?|\x20at\x20)[A-Za-z0-9-]++"
        r"(?:(?:\.|\x20?[(\[]dot[)\]]\x20?|\x20dot\x20)[A-Za-z0-9-]++)+",
        re.IGNORECASE,
    ),
    re.compile(r"(?<![0-9A-Fa-f:.])(?:[0-9]++(?:\.[0-9]++){3}|[0-9A-Fa-f]{1,4}(?::[0-9A-Fa-f]{0,4}){3,7})(?![0-9A-Fa-f:])"),
    re.compile(r"(?<![0-9])[0-9](?:[\x20./_-]{0,2}[0-9]){11,18}(?![0-9])"),
    re.compile(r"(?<![0-9+])(?:\+|00)?[(]?[0-9](?:[\x20()./-]{0,2}[0-9]){6,14}(?![0-9])"),
)
_WORDS = tuple(
    re.compile(w, re.IGNORECASE)
    for w in (
        r"mail|contact|write|schreib|escrib|[ée]cri",
        r"\bip\b|host|server|addr|login",
        r"card|visa|credit|karte|carte|tarjeta|pay",
        r"phone|call|tel|fax|mobil|cell|ruf|appel|llam",
    )
)
_AT, _DOT = re.compile(r"\x20?[(\[]at[)\]]\x20?|\x20at\x20", re.I), re.compile(r"\x20?[(\[]dot[)\]]\x20?|\x20dot\x20", re.I)
N_FEATURES = 4 + 15 + 4


def luhn(digits: str) -> bool:
    """Whether the check digit of a card number is right."""
    total = 0
    for i, d in enumerate(reversed(digits)):
        n = ord(d) - 48
        total += n if i % 2 == 0 else (2 * n - 9 if n > 4 else 2 * n)
    return total % 10 == 0


def _part_fits(part: str) -> bool:
    part = part.lstrip("0")
    return len(part) <= 3 and int(part or 0) <= 255


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, kind, end) of the fixed patterns, leftmost and non-overlapping within each kind.

    Matches that fail the check of their kind are dropped without another try. Work grows with
    the length of the text.
    """
    out, last = [], 0
    at = text.find("@")
    while at >= 0:
        start = at
        while start > last and text[start - 1] in _LOCAL:
            start -= 1
        domain = _DOMAIN.match(text, at + 1) if start < at else None
        if domain:
            last = domain.end()
            out.append((start, 0, last))
        at = text.find("@", at + 1)
    for m in _IP.finditer(text):
        if all(map(_part_fits, m.group().split("."))):
            out.append((m.start(), 1, m.end()))
    for m in _CARD.finditer(text):
        digits = re.sub("[^0-9]", "", m.group())
        if 12 <= len(digits) <= 19 and luhn(digits):
            out.append((m.start(), 2, m.end()))
    if "+" in text:
        for m in _PHONE.finditer(text):
            if 9 <= sum(c.isdigit() for c in m.group()) <= 15:
                out.append((m.start(), 3, m.end()))
    return sorted(out)


def proposed_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, kind, end) of all generators; spans of different kinds may overlap."""
    out = [(m.start(), k, m.end()) for k, rule in enumerate(_PROPOSED) for m in rule.finditer(text)]
    return sorted(out)


def features(text: str, start: int, kind: int, end: int) -> list[float]:
    """Format of a span and what stands around it."""
    span = text[start:end]
    digits = re.sub("[^0-9]", "", span)
    groups = re.findall("[0-9]+", span) or [""]
    before, after = text[max(0, start - CONTEXT) : start], text[end : end + CONTEXT]
    dotted = span.split(".")
    return [
        *(float(kind == k) for k in range(4)),
        float(len(span)), float(len(digits)), len(digits) / len(span), float(len(groups)),
        float(max(map(len, groups))), float(min(map(len, groups))), float(len(set(digits))),
        float(luhn(digits)) if digits else 0.0,
        float(len(dotted) == 4 and all(p.isdecimal() and _part_fits(p) for p in dotted)),
        float("+" in span), float("@" in span or _AT.search(span) is not None),
        float(re.search(r"[(\[](at|dot)[)\]]", span, re.I) is not None),
        float(_AT.search(span) is not None and _DOT.search(span) is None),
        float(bool(before) and before[-1].isalnum()), float(bool(after) and after[0].isalnum()),
        *(float(bool(rule.search(before))) for rule in _WORDS),
    ]


def _disguises(text: str, start: int, kind: int, end: int) -> list[tuple[str, int, int, int]]:
    """The same span in other common forms, so the trees do not hang on one format."""
    span, forms = text[start:end], []
    if kind == 0:
        local, _, domain = span.partition("@")
        for at, dot in ((" (at) ", " (dot) "), ("[at]", "[dot]"), (" at ", " dot ")):
            forms.append(local + at + domain.replace(".", dot))
    elif kind == 2:
        digits = re.sub("[^0-9]", "", span)
        forms = [sep.join(re.findall(".{1,4}", digits)) for sep in "./_"]
    elif kind == 3:
        plain = span.lstrip("+")
        forms = [plain.replace(" ", "-"), "00" + plain, plain.replace(" ", ".")]
    return [(text[:start] + f + text[end:], start, kind, start + len(f)) for f in forms]


def _spoiled(text: str, start: int, kind: int, end: int) -> list[tuple[str, int, int, int]]:
    """Near misses of a base span: spans that look like one and are none."""
    span = text[start:end]
    if kind == 0:
        local, _, domain = span.partition("@")
        forms = [f"{local} at {domain}", f"{local} at 10.30"]
    elif kind == 1:
        forms = [span.replace(".", "00.", 1), span + "999"]
    elif kind == 2:
        forms = [span[:-1] + str((int(span[-1]) + 1) % 10)]
    else:
        digits = re.sub("[^0-9]", "", span)
        forms = [f"{digits[:2]}.{digits[2:4]}.{digits[4:8]}", digits[:8]]
    return [(text[:start] + f + text[end:], start, kind, start + len(f)) for f in forms]


def only_formatted(text: str, start: int, kind: int, end: int) -> bool:
    """Whether nothing but its format keeps a proposal from being a base span, so it is no example of a wrong one."""
    span = text[start:end]
    digits = re.sub("[^0-9]", "", span)
    if kind == 0:
        plain, found = _DOT.sub(".", _AT.sub("@", span, count=1)), _AT.search(span) or _DOT.search(span)
        # In prose an "at" is followed by all sorts of things, but not by a domain with a name at its end.
        return found is not None and plain.rpartition(".")[2].isalpha() and [(0, 0, len(plain))] == base_spans(plain)
    if kind == 1:
        return ":" in span and _is_ipv6(span)
    if kind == 2:
        return 12 <= len(digits) <= 19 and luhn(digits)
    return 9 <= len(digits) <= 15 and bool(_WORDS[3].search(text[max(0, start - CONTEXT) : start]) or span.startswith("00"))


def _is_ipv6(span: str) -> bool:
    try:
        return bool(ipaddress.IPv6Address(span))
    except ValueError:
        return False


@dataclass
class SpanModel:
    """Fitted trees and a threshold per kind; above 1 the kind gets no further spans."""

    trees: BoostedTrees | None = None
    thresholds: list[float] = field(default_factory=lambda: [2.0] * 4)

    def spans(self, text: str | None) -> list[tuple[str, int, int, bool, float]]:
        """(kind, start, end, base, score): the base spans and what is selected beside them."""
        if not text or not _HINT.search(text):
            return []
        base = base_spans(text)
        taken = [(a, b) for a, _, b in base]
        out = [(a, k, b, True, 1.0) for a, k, b in base]
        if self.trees is not None and min(self.thresholds) <= 1:
            scored = [
                (self.trees.score(features(text, a, k, b)), a, k, b)
                for a, k, b in proposed_spans(text)
                if (a, k, b) not in base
            ]
            # The best candidate wins where several overlap; what is taken already stays.
            for score, a, k, b in sorted(scored, key=lambda s: (-s[0], s[1:])):
                if score >= self.thresholds[k] and all(b <= c or d <= a for c, d in taken):
                    taken.append((a, b))
                    out.append((a, k, b, False, score))
        return [(KINDS[k], a, b, fixed, score) for a, k, b, fixed, score in sorted(out)]


def _examples(text: str) -> list[tuple[list[float], int, int]]:
    """Rows (features, label, kind): a base span is right, and so is it in a disguise; other proposals are wrong.

    Proposals that only their format keeps from being base spans, and those that lie inside one, teach nothing.
    """
    base = base_spans(text)
    out = []
    for span in proposed_spans(text):
        a, kind, b = span
        if span in base:
            out.append((features(text, *span), 1, kind))
            out += [(features(*form), 1, kind) for form in _disguises(text, *span)]
            out += [(features(*form), 0, kind) for form in _spoiled(text, *span)]
        elif not only_formatted(text, *span) and all(b <= c or d <= a for c, _, d in base):
            out.append((features(text, *span), 0, kind))
    return out


def _thresholds(scored: DataFrame, precision: float) -> dict[int, float]:
    """By kind, a threshold from all rows of ``kind, score, y``.

    It lies halfway between the lowest score from which on ``precision`` of the rows are right and the next wrong one below, at 0.5
    at least. Scores are counted, then summed up by cells, so the rows of a kind do not meet in one task.
    """
    counts = scored.groupBy("kind", "score").agg(F.count(F.lit(1)).alias("n"), F.sum("y").alias("right"))
    counts = checkpointed(counts.withColumn("cell", F.floor(F.col("score") * CELLS)))
    above = Window.partitionBy("kind").orderBy(F.desc("cell")).rowsBetween(Window.unboundedPreceding, -1)
    cells = counts.groupBy("kind", "cell").agg(F.sum("n").alias("n"), F.sum("right").alias("right"))
    cells = cells.select("kind", "cell", *(F.coalesce(F.sum(c).over(above), F.lit(0)).alias(f"{c}_above") for c in ("n", "right")))
    inside = Window.partitionBy("kind", "cell").orderBy(F.desc("score"))
    from_here = counts.join(cells, ["kind", "cell"]).withColumns(
        {c: F.col(f"{c}_above") + F.sum(c).over(inside) for c in ("n", "right")}
    )
    good = (F.col("right") >= F.lit(precision) * F.col("n")) & (F.col("right") > 0)
    lows = from_here.filter(good).groupBy("kind").agg(F.min("score").alias("low"))
    wrong = F.max(F.when((F.col("right") < F.col("n")) & (F.col("score") < F.col("low")), F.col("score")))
    found = counts.join(F.broadcast(lows), "kind").groupBy("kind", "low").agg(F.coalesce(wrong, F.lit(0.0)).alias("wrong"))
    return {r["kind"]: max(0.5, (r["low"] + r["wrong"]) / 2) for r in found.collect()}


def learn_spans(docs: DataFrame, text_col: str = "text", precision: float = PRECISION) -> SpanModel:
    """Fit the trees on the candidates of all documents, equal ones counted once.

    Candidates that the fixed patterns confirm are right, as is each of them in disguised forms; near misses
    made of them and candidates that they do not confirm are wrong, unless only their format does it (see ``only_formatted``): such
    ones are what is to be found, however frequent. A fifth, by hash, is held out for the thresholds; a kind's lies
    halfway between the lowest score from which on that fifth reaches ``precision`` and the next wrong one
    below, at 0.5 at least. Without candidates of both sorts
    the model adds nothing. Candidates stay with Spark: sums by node, feature and bin come back, and a few numbers a kind.
    """

    def examples(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for text in batch["text"]:
                if text and _HINT.search(text):
                    for x, y, kind in _examples(text):
                        around = zlib.crc32(repr(x).encode())
                        rows.append((x, y, kind, around))
            yield pd.DataFrame(rows, columns=["x", "y", "kind", "hash"])

    shipped(docs.sparkSession)
    found = docs.select(F.col(text_col).alias("text")).mapInPandas(examples, "x array<double>, y int, kind int, hash long")
    # Equal examples are one, so that copies do not outweigh the rest.
    rows = checkpointed(found.distinct())
    is_held = F.col("hash") % 5 == 0
    held, fitted = rows.filter(is_held), rows.filter(~is_held)
    parts = {r["held"]: r["sorts"] for r in rows.groupBy(is_held.alias("held")).agg(F.count_distinct("y").alias("sorts")).collect()}
    if parts.get(True, 0) == 0 or parts.get(False, 0) < 2:
        return SpanModel()
    model = SpanModel(BoostedTrees().fit_rows(fitted))
    shared = docs.sparkSession.sparkContext.broadcast(model.trees)

    @F.pandas_udf("double")
    def score(xs: pd.Series) -> pd.Series:
        return pd.Series([shared.value.score(x) for x in xs.map(list)], dtype=float)

    for kind, threshold in _thresholds(held.select("kind", "y", score("x").alias("score")), precision).items():
        model.thresholds[kind] = threshold
    return model


def find_personal_data(
    docs: DataFrame, model: SpanModel, id_col: str = "doc_id", text_col: str = "text", redact: bool = True
) -> DataFrame:
    """One row per input row: ``id_col``, spans, and with ``redact`` the text with [KIND] in their places.

    spans is an array of struct<kind, start, end, base, score> by start, then kind in the order of
    ``KINDS``; places are code points, ends exclusive. Base spans always stay; the model adds others that
    overlap none of them. Whole texts are read. A null text counts as empty and has no spans.
    Repeated rows are judged each; no rows give none; other columns are ignored.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)
    span = "struct<kind:string, start:int, end:int, base:boolean, score:double>"

    @F.pandas_udf(f"spans array<{span}>")
    def spans(texts: pd.Series) -> pd.DataFrame:
        names = ("kind", "start", "end", "base", "score")
        return pd.DataFrame({"spans": [[dict(zip(names, s, strict=True)) for s in shared.value.spans(t)] for t in texts]})

    found = docs.select(F.col(id_col), F.col(text_col).alias("_text"), spans(F.col(text_col))["spans"].alias("_spans"))
    out = found.select(id_col, F.col("_spans").alias("spans"), *([F.col("_text")] if redact else []))
    if not redact:
        return out
    text = F.coalesce("_text", F.lit(""))

    # Overlapping base spans of different kinds are covered once, under the first.
    def step(done, s):
        begins = F.greatest(s["start"], done["at"])
        more = s["end"] > done["at"]
        piece = F.concat(
            done["text"], F.substring(text, done["at"] + 1, begins - done["at"]),
            F.when(s["start"] >= done["at"], F.concat(F.lit("["), F.upper(s["kind"]), F.lit("]"))).otherwise(F.lit("")),
        )
        return F.struct(F.when(more, s["end"]).otherwise(done["at"]).alias("at"), F.when(more, piece).otherwise(done["text"]).alias("text"))

    start = F.struct(F.lit(0).alias("at"), F.lit("").alias("text"))
    rest = lambda done: F.concat(done["text"], F.substring(text, done["at"] + 1, F.char_length(text)))
    return out.select(id_col, "spans", F.aggregate("spans", start, step, rest).alias("redacted"))
