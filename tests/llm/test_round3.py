"""Manifest, importance resampling, licence scans; factor arrays, blocks without ids, disguised spans."""

import random
import re
import zlib
from collections import Counter
from hashlib import sha256
from math import floor, log

import numpy as np
import pyarrow as pa
import pytest
import xxhash
from pyspark.sql import functions as F

from kadence.llm.importance import NgramTable, resample, weighed, xxh64
from kadence.llm.licences import Template, scan_licences
from kadence.llm.merkle import depth, digest, folded, manifest, missing
from kadence.llm.mixing import balanced_rates, mix_to_targets
from kadence.llm.personal_data import find_personal_data, learn_spans
from kadence.llm.repeats import text_blocks
from kadence.llm.suffix_dedup import common_lengths, drop_earlier_copies, factor_lengths

ODD = "doc_id long, text string, lang string, source string, n_chars long, tree string, pos string, hash string, words string"


def odd(spark, rows):
    return spark.createDataFrame([(*r, "x", "y", "z", "w") for r in rows], ODD)


def H(*parts):  # noqa: N802
    return sha256("".join(parts).encode()).hexdigest()


def framed(v):
    return "-" if v is None else f"{len(str(v).encode())}:{v}"


def brute_manifest(rows):
    """(doc_id, leaf, subroot, root, siblings) of rows (doc_id, text, lang)."""

    def levels(nodes):
        out = [nodes]
        while len(out[-1]) > 1:
            out.append([H(*out[-1][i : i + 2]) for i in range(0, len(out[-1]), 2)])
        return out

    def siblings(of, i):
        return [lv[(i >> k) ^ 1] if (i >> k) ^ 1 < len(lv) else None for k, lv in enumerate(of[:-1])]

    leaf = lambda r: H(*map(framed, r))
    names = sorted({r[2] for r in rows}, key=lambda x: (x is not None, (x or "").encode()))
    own = {n: sorted((r for r in rows if r[2] == n), key=lambda r: (r[0] is not None, r[0] or 0, leaf(r))) for n in names}
    trees = {n: levels([leaf(r) for r in own[n]]) for n in names}
    top = levels([trees[n][-1][0] for n in names])
    return [
        (r[0], leaf(r), trees[n][-1][0], top[-1][0], siblings(trees[n], i) + siblings(top, t))
        for t, n in enumerate(names) for i, r in enumerate(own[n])
    ]


@pytest.mark.parametrize("levels", [2, 12])
def test_manifest(spark, levels):
    chance = random.Random(3)
    # Trees of 1, 2, 5 and 37 leaves, one without a name, repeated rows and ids, null and empty texts.
    rows = [(k, chance.choice(("a", "", None, "é" * 50)), lang, None, None) for lang, n in (("x", 1), (None, 2), ("é", 5), ("en", 35)) for k in range(n)]
    rows += [(None, "t", "en", None, None), (3, "t", "en", None, None)]
    docs = odd(spark, rows)
    leaf = digest(F.col("doc_id"), F.col("text"), F.col("lang"))
    found = manifest(docs, leaf, "lang", "doc_id", levels=levels, claimed=F.sha2(F.lit("forged"), 256))
    found = found.withColumns({"true": folded(F.col("hash")), "forged": folded(F.col("claimed"))}).collect()
    got = [(r["doc_id"], r["hash"], r["subroot"], r["root"], r["proof"]) for r in found]
    assert sorted(got, key=repr) == sorted(brute_manifest([r[:3] for r in rows]), key=repr)
    assert all(r["true"] == r["root"] != r["forged"] for r in found)


def test_manifest_of_nothing_and_of_one(spark):
    leaf = F.sha2(F.coalesce("text", F.lit("")), 256)
    assert manifest(odd(spark, []), leaf, "lang", "doc_id").count() == 0
    (one,) = manifest(odd(spark, [(None, None, None, None, None)]), leaf, "lang", "doc_id").collect()
    assert one["root"] == one["subroot"] == one["hash"] == H("") and one["proof"] == []


def test_missing_coordinates_are_minimal():
    chance = random.Random(1)
    for _ in range(200):
        n = chance.randrange(1, 70)
        known = sorted(chance.sample(range(n), chance.randrange(1, n + 1)))
        found = missing(np.array(known), n)
        have = {(0, p) for p in known} | set(found)
        size = n
        for level in range(depth(n)):
            # All that is known has its sibling, and none is fetched that could be derived.
            here = {p for lv, p in have if lv == level}
            assert all(p ^ 1 in here or p ^ 1 >= size for p in here)
            derived = {(level + 1, p >> 1) for p in here}
            assert not derived & set(found)
            have |= derived
            size = (size + 1) // 2
        assert (depth(n), 0) in have


WORDS = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def plain(text):
    return WORDS.findall(re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))


def grams(text, most):
    words = plain(text)
    return [" ".join(words[i : i + n]) for n in range(1, most + 1) for i in range(len(words) - n + 1)]


def test_hashes_equal_the_library_and_bytes_decide():
    chance = random.Random(2)
    data = np.frombuffer(bytes(chance.randrange(256) for _ in range(3000)) + bytes(8), np.uint8)
    starts = np.array([chance.randrange(2900) for _ in range(400)])
    lengths = np.array([chance.randrange(1, 80) for _ in range(400)])
    want = [xxhash.xxh64_intdigest(data[a : a + n].tobytes()) for a, n in zip(starts, lengths)]
    assert xxh64(data, starts, lengths).tolist() == want
    # All keys alike: only the bytes tell runs apart, also over growth of the table.
    words = [f"w{k % 700:06d}".encode() for k in range(2000)]
    data = np.frombuffer(b"".join(words) + bytes(8), np.uint8)
    table = NgramTable(data, 97, capacity=4)
    table_starts, sizes = np.arange(2000) * 7, np.full(2000, 7)
    assert table.reserve(2000) is not None
    slots = table._place(np.zeros(2000, np.uint64), table_starts, sizes)
    assert len(set(slots.tolist())) == 700 and (slots[:700] == slots[700:1400]).all()


@pytest.mark.parametrize("most", [1, 3])
def test_weights_against_dictionaries(most):
    chance = random.Random(4)
    texts = ["".join(chance.choice("abAB é1 ,.\0\n") for _ in range(chance.randrange(2000))) for _ in range(40)]
    texts += [None, "", "a" * 5000 + " " + "b" * 33, " . "]
    gains = np.arange(97) * 3 - 100
    words, features, weights = weighed(pa.array(texts), range(1, most + 1), gains)
    for i, text in enumerate(texts):
        found = grams(text, most)
        assert (words[i], features[i]) == (len(plain(text)), len(found))
        assert weights[i] == sum(int(gains[zlib.crc32(g.encode()) % 97]) for g in found)


def test_resample_against_brute_force(spark):
    chance = random.Random(6)
    rows = [(k, " ".join(chance.choice(("Sun", "moon", "é", "x1", "of")) for _ in range(chance.randrange(40))), None, None, None) for k in range(150)]
    rows += [(7, rows[7][1], None, None, None), (None, "of " * 30, None, None, None), (200, None, None, None, None), (201, "", None, None, None)]
    target = ["sun and moon", "Sun", None]
    docs = odd(spark, rows)
    wanted = spark.createDataFrame([(t,) for t in target], "text string")
    got = resample(docs, wanted, buckets=50, least_words=10, percent=20).collect()
    bucket = lambda g: zlib.crc32(g.encode()) % 50
    s = Counter(bucket(g) for r in rows for g in grams(r[1], 1))
    t = Counter(bucket(g) for x in target for g in grams(x, 1))
    ratio = lambda b: (t[b] + 1) * (s.total() + 50) / ((s[b] + 1) * (t.total() + 50))
    want = []
    for i, text, *_ in rows:
        found = grams(text, 1)
        weight = sum(floor(1000 * log(ratio(bucket(g)))) for g in found)
        h = int(sha256(f"2024:{'' if i is None else i}".encode()).hexdigest()[:8], 16)
        want.append((i, len(found), weight, weight + floor(-1000 * log(-log((h + 0.5) / 4294967296)))))
    assert sorted(((r["doc_id"], r["n_features"], r["weight"], r["score"]) for r in got), key=repr) == sorted(want, key=repr)
    able = sorted((w for w in want if w[1] >= 10), key=lambda w: (-w[3], w[0] is None, w[0] or 0))
    drawn = sorted((r for r in got if r["rank"] is not None), key=lambda r: r["rank"])
    assert [r["rank"] for r in drawn] == list(range(1, len(able) * 20 // 100 + 1))
    assert [r["score"] for r in drawn] == [w[3] for w in able[: len(drawn)]]
    assert resample(docs.limit(0), wanted).count() == 0
    assert resample(docs, wanted.limit(0)).count() == len(rows)


def test_licences_against_brute_force(spark):
    mit = "Permission is hereby granted, free of charge, to any person obtaining a copy\n * of this software and associated documentation files"
    texts = [
        None, "", "no words of law", "The MIT License. MIT  license; mit-license", "GNU General Public License GNU general public",
        "cc by cc by-sa BY", f"# {mit} (the Software)", mit.replace("free of charge", "for a fee"), mit.replace("hereby", "thereby"),
        "word " * 3000 + mit + " under the Apache License", "permission charge free of granted",
    ]
    docs = odd(spark, [(k if k else None, t, None, None, None) for k, t in enumerate(texts)])
    got = {r["doc_id"]: r for r in scan_licences(docs).collect()}
    phrases = {"gnu general public license": "gpl", "apache license": "apache", "cc by": "cc-by", "mit license": "mit"}
    for k, text in enumerate(texts):
        words, row = plain(text), got[k or None]
        want = sorted(
            (i, len(p.split()), label) for p, label in phrases.items() for i in range(len(words)) if words[i : i + len(p.split())] == p.split()
        )
        assert (row["n_words"], [tuple(p) for p in row["places"]]) == (len(words), want)
        assert row["base_labels"] == sorted({w[2] for w in want})
    assert got[6]["labels"] == ["mit"] and got[6]["base_labels"] == [] and got[6]["score"] == 1.0
    # Without a mandatory phrase there is no label, with another word changed there is.
    assert got[7]["labels"] == [] and got[7]["score"] == 0.0
    assert got[8]["labels"] == ["mit"] and 0.8 <= got[8]["score"] < 1
    assert got[9]["labels"] == ["apache", "mit"] and got[10]["labels"] == []
    assert scan_licences(docs.limit(0)).count() == 0
    only = scan_licences(docs, phrases={}, templates=(Template.of("own", "no [words of] law"),)).where("size(labels) > 0")
    assert [(r["doc_id"], r["labels"], r["score"]) for r in only.collect()] == [(2, ["own"], 1.0)]


# --- mended operators ---------------------------------------------------------------------


@pytest.mark.parametrize("letters", ["a", "ab", "abcdefgh"])
def test_factors_against_brute_force(letters):
    """Longest previous factors of suffixes by document, cut at 20 bytes, ties and repeated documents included."""
    chance = random.Random(9)
    for _ in range(30):
        texts = ["".join(chance.choice(letters) for _ in range(20 + chance.randrange(12))) for _ in range(8)]
        suffixes = [(t[i : i + 20], d) for d, t in enumerate(texts) for i in range(len(t) - 19)]
        chance.shuffle(suffixes)
        suffixes.sort(key=lambda s: s[0])
        ordered = np.array([s.encode() for s, _ in suffixes], "S20")
        docs = np.array([d for _, d in suffixes])

        def shared(a, b):
            return next((i for i, (x, y) in enumerate(zip(a, b)) if x != y), 20)

        want = [max([shared(s, r) for r, e in suffixes if e < d], default=0) for s, d in suffixes]
        common = common_lengths(ordered, 20)
        assert factor_lengths(docs, common).tolist() == want
        assert factor_lengths(docs, common, least=20).tolist() == [w if w >= 20 else 0 for w in want]


def test_long_chains_of_factors():
    """Falling and rising documents in one run of equal suffixes: all but the smallest have the whole as a factor."""
    n = 200_000
    common = np.full(n, 50)
    common[0] = 0
    for docs in (np.arange(n), np.arange(n)[::-1].copy(), np.arange(n) % 1000):
        assert (factor_lengths(docs, common, least=50) == np.where(docs == 0, 0, 50)).all()


def test_rows_without_id_fill_all_blocks(spark, tmp_path):
    rows = spark.range(4000).select(F.lit(None).cast("long").alias("doc_id"), F.lpad(F.col("id").cast("string"), 4000, "ab ").alias("text"))
    tmp_path = tmp_path / "t"
    rows.write.parquet(str(tmp_path))
    blocks, n = text_blocks(spark.read.parquet(str(tmp_path)), "doc_id", "text", 1 << 20)
    sizes = [r["count"] for r in blocks.groupBy("block").count().collect()]
    assert n == len(sizes) == 16 and max(sizes) < 2 * 4000 / 16
    copies = spark.range(4000).select(F.lit(None).cast("long").alias("doc_id"), F.lit("same " * 800).alias("text"))
    copies.write.mode("overwrite").parquet(str(tmp_path))
    blocks, n = text_blocks(spark.read.parquet(str(tmp_path)), "doc_id", "text", 1 << 20)
    sizes = [r["count"] for r in blocks.groupBy("block").count().collect()]
    assert n == len(sizes) and max(sizes) < 2 * 4000 / n


def test_copies_without_id_against_brute_force(spark, tmp_path):
    part = "0123456789" * 6
    rows = [(None, part), (None, "x" + part), (4, part + "y"), (None, None), (None, "q" * 49)]
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(f"{tmp_path}/t")
    got = drop_earlier_copies(spark.read.parquet(f"{tmp_path}/t")).collect()
    assert sorted((r["n_bytes"], r["n_removed"]) for r in got) == [(0, 0), (49, 0), (60, 60), (61, 0), (61, 60)]


def planted(kind, chance):
    digits = lambda n: "".join(str(chance.randrange(10)) for _ in range(n))
    if kind == "email":
        return f"{chance.choice('abc')}{digits(2)}.{chance.choice(('kim', 'lee'))}@{chance.choice(('mail', 'post'))}.{chance.choice(('org', 'com'))}"
    if kind == "phone":
        return f"+{chance.randrange(20, 60)} {digits(3)} {digits(3)} {digits(3)}"
    body = "4" + digits(14)
    return next(body + c for c in "0123456789" if sum((int(d) if i % 2 == 0 else (2 * int(d) - 9 if int(d) > 4 else 2 * int(d))) for i, d in enumerate(reversed(body + c))) % 10 == 0)


HIDES = {
    "email": lambda s: s.replace("@", " (at) ").replace(".", " (dot) "),
    "card": lambda s: "/".join(re.findall(".{4}", s)),
    "phone": lambda s: "00" + s.lstrip("+"),
}


def test_frequent_disguised_spans_are_found(spark):
    """Of each kind as many disguised spans as plain ones; recall and precision on other rows, clean texts untouched."""
    chance = random.Random(8)
    says = {"email": "please write to {} soon", "card": "the card {} was charged", "phone": "you may call {} today"}

    def texts(n):
        out = []
        for k in range(n):
            kind = ("email", "card", "phone")[k % 3]
            value = planted(kind, chance)
            out.append((kind, value, HIDES[kind](value)))
        return out

    rows = []
    for kind, value, hidden in texts(600):
        rows += [says[kind].format(value), says[kind].format(hidden)]
    clean = ["In 1999 the house had 12 rooms and 3.5 floors, at 10:30 it was sold for 250,000.", "We met at noon. Nothing else, 12.10.2023."]
    docs = spark.createDataFrame([(k, t) for k, t in enumerate(rows + clean * 20)], "doc_id long, text string")
    model = learn_spans(docs)
    held = texts(300)
    fresh = spark.createDataFrame([(k, says[kind].format(hidden)) for k, (kind, _, hidden) in enumerate(held)], "doc_id long, text string")
    got = {r["doc_id"]: r["redacted"] for r in find_personal_data(fresh, model).collect()}
    for kind in HIDES:
        mine = [k for k, h in enumerate(held) if h[0] == kind]
        hit = [k for k in mine if held[k][2] not in got[k]]
        assert len(hit) >= 0.9 * len(mine), kind
        # What was found is the span and not its surroundings.
        assert all(got[k].startswith(says[kind].split("{")[0]) for k in hit)
    assert all(model.spans(t) == [] for t in clean)
    long = "a" * 300 + " (at) " + "b" * 200 + " (dot) org"
    assert [s[1:3] for s in model.spans("write to " + long)] == [(9, 9 + len(long))]


def test_mixing_ends_where_nothing_moves_and_never_silently(spark):
    """More classes than the loop had steps before: no class fits what is left of any source."""
    chance = random.Random(5)
    rows = [(k, "w " * chance.choice([3, 7, 11, 50, 170, 400 + k % 90]), None, "ab"[k % 2], None) for k in range(400)]
    mixed = mix_to_targets(odd(spark, rows)).collect()
    for source in "ab":
        mine = [r for r in mixed if rows[r["doc_id"]][3] == source]
        left = mine[0]["target"] - sum(r["taken"] for r in mine)
        assert abs(left) < 3 or all(r["size"] > abs(left) for r in mine if (0 < r["copies"] if left < 0 else r["copies"] < 3))
    classes = spark.createDataFrame([("a", 3, 5), ("a", 9, 4)], "source string, size long, n long")
    targets = spark.createDataFrame([("a", 51, 40.0)], "source string, source_size long, target double")
    with pytest.raises(RuntimeError, match="still move"):
        balanced_rates(classes, targets, rounds=1)


def newton(sizes, target, most):
    """Tilt of one source by bisection over plain floats."""
    low, high = -50.0, 50.0
    mean = sum(sizes) / len(sizes)
    rate = lambda t, s: min(most, np.exp(min(t * s / mean, 50.0)))
    for _ in range(200):
        middle = (low + high) / 2
        low, high = (middle, high) if sum(s * rate(middle, s) for s in sizes) < target else (low, middle)
    return [rate(low, s) for s in sizes]


def test_rates_against_bisection(spark):
    chance = random.Random(2)
    rows = [(k, "w " * chance.randrange(1, 60), None, chance.choice("abc"), None) for k in range(200)]
    mixed = mix_to_targets(odd(spark, rows)).collect()
    for source in "abc":
        mine = [r for r in mixed if rows[r["doc_id"]][3] == source]
        want = newton([r["size"] for r in mine], mine[0]["target"], 3)
        assert [r["rate"] for r in mine] == pytest.approx(want, rel=1e-5)
