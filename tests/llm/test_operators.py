"""Operators over small tables: brute force, nulls, empty and long texts, ties, repeats, odd columns."""

import json
import random
from dataclasses import replace

import numpy as np
import pytest
from tokenizers import Tokenizer

from kadence.llm import exact_dedup, repeats, substring_dedup, suffix_dedup
from kadence.llm.components import connected_components
from kadence.llm.exact_dedup import exact_duplicates
from kadence.llm.language import identify, learn_profiles
from kadence.llm.mixing import mix_to_targets, source_targets
from kadence.llm.ngram_join import jaccard_groups
from kadence.llm.packing import default_path, pack_documents
from kadence.llm.personal_data import find_personal_data, learn_spans
from kadence.llm.substring_dedup import drop_repeated_passages
from kadence.llm.suffix_dedup import drop_earlier_copies
from kadence.llm.token_counts import count_tokens
from kadence.llm.vector_dedup import vector_groups

from . import brute

SCHEMA = (
    "doc_id long, text string, lang string, source string, id string, block string, size string, kept string, "
    "component_id string, rank string, start string, n string, v string, label string, first string, _text string"
)
LONG = " ".join(f"w{k % 5003}" for k in range(60_000))


def frame(spark, rows):
    """(doc_id, text, lang, source) with more columns whose names the operators use inside."""
    return spark.createDataFrame([(*r, *["x"] * 12) for r in rows], SCHEMA)


def odd_rows():
    rng = random.Random(7)
    base = [f"w{rng.randrange(300)}" for _ in range(90)]
    texts = [None, "", " \t\n", "one", "two words", " ".join(base), " ".join(base), " ".join(base[:80] + ["x", "y"])]
    texts += [" ".join(base[10:60] + [f"z{k}" for k in range(40)]), LONG, LONG, "a " * 400, "b" * 300, "É日 Word wOrd é"]
    rows = [(10 * k + 3, t, ("en", "de", None)[k % 3], ("s1", "s2", None)[k % 3]) for k, t in enumerate(texts)]
    return [*rows, (None, "one", None, None), (None, None, None, None), (53, texts[5], "en", "s1")]


OPERATORS = {
    "exact": lambda df: exact_duplicates(df),
    "exact_all": lambda df: exact_duplicates(df, digests="all"),
    "mix": mix_to_targets,
    "jaccard": jaccard_groups,
    "pack": pack_documents,
    "passages": drop_repeated_passages,
    "suffix": drop_earlier_copies,
    "count": count_tokens,
    "personal": lambda df: find_personal_data(df, learn_spans(df)),
    "language": lambda df: df.select("doc_id", identify(df, learn_profiles(df)).alias("found")),
}


@pytest.mark.parametrize("name", OPERATORS)
def test_empty_tables(spark, name):
    assert OPERATORS[name](frame(spark, [])).collect() == []


@pytest.mark.parametrize("name", sorted(set(OPERATORS) - {"pack"}))
def test_a_row_per_input_row(spark, name):
    rows = odd_rows()
    got = OPERATORS[name](frame(spark, rows)).collect()
    key = lambda i: (i is None, i or 0)
    assert sorted((r["doc_id"] for r in got), key=key) == sorted((r[0] for r in rows), key=key)


@pytest.mark.parametrize("name", ["exact", "count", "passages", "suffix", "jaccard", "personal"])
def test_all_texts_null(spark, name):
    assert len(OPERATORS[name](frame(spark, [(k, None, None, None) for k in range(3)])).collect()) == 3


def distinct_docs():
    return [(i, t) for i, t, *_ in odd_rows()[:-3]]


def test_passages(spark):
    expected = brute.passages(distinct_docs(), 35)
    rows = [(i, t, None, None) for i, t in distinct_docs()]
    got = drop_repeated_passages(frame(spark, rows)).collect()
    assert {r["doc_id"]: (r["n_words"], r["n_removed"], r["kept"]) for r in got} == expected


def test_earlier_copies(spark):
    docs = [d for d in distinct_docs() if d[1] != LONG]
    got = drop_earlier_copies(frame(spark, [(i, t, None, None) for i, t in docs])).collect()
    mine = {r["doc_id"]: (r["n_bytes"], r["n_removed"], r["n_spans"], bytes(r["kept"])) for r in got}
    assert mine == brute.earlier_copies(docs, 50)


def test_repeated_ids_do_not_remove_from_each_other(spark):
    text = "some text that is clearly longer than fifty bytes, twice"
    got = drop_earlier_copies(frame(spark, [(1, text, None, None), (1, text, None, None), (None, text, None, None)])).collect()
    assert sorted((r["doc_id"] or 9, r["n_removed"]) for r in got) == [(1, 0), (1, 0), (9, len(text))]


def test_random_texts_against_brute_force(spark):
    rng = random.Random(11)
    docs, pool = [], [" ".join(f"w{rng.randrange(40)}" for _ in range(60)) for _ in range(6)]
    for i in range(80):
        parts = [rng.choice(pool)[rng.randrange(60) :] for _ in range(rng.randrange(1, 4))]
        docs.append((i * 7 % 83, " ".join(parts) + rng.choice(["", " é日", "\n\nend"])))
    df = frame(spark, [(i, t, None, None) for i, t in docs])
    got = drop_repeated_passages(df, window=12, gram=4).collect()
    assert {r["doc_id"]: (r["n_words"], r["n_removed"], r["kept"]) for r in got} == brute.passages(docs, 12)
    got = drop_earlier_copies(df, length=20, gram=6).collect()
    mine = {r["doc_id"]: (r["n_bytes"], r["n_removed"], r["n_spans"], bytes(r["kept"])) for r in got}
    assert mine == brute.earlier_copies(docs, 20)
    got = jaccard_groups(df, percent=40).collect()
    assert {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in got} == brute.jaccard(docs, 40)


def test_jaccard_over_the_tables(spark, sf_dir):
    df = spark.read.parquet(f"{sf_dir}/documents.parquet")
    docs = [(r["doc_id"], r["text"]) for r in df.select("doc_id", "text").collect()]
    got = jaccard_groups(df).collect()
    assert {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in got} == brute.jaccard(docs)


def test_jaccard_in_chunks(spark, monkeypatch):
    import kadence.llm.ngram_join as module

    monkeypatch.setattr(module, "CHUNK_TEXTS", 4)
    rng = random.Random(3)
    base = [f"w{k}" for k in range(200)]
    docs = []
    for i in range(40):
        copy = list(base)
        for _ in range(rng.randrange(9)):
            copy[rng.randrange(200)] = f"x{i}"
        docs.append((i, " ".join(copy)))
    got = jaccard_groups(frame(spark, [(i, t, None, None) for i, t in docs]), block_bytes=3000).collect()
    assert {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in got} == brute.jaccard(docs)


def test_rows_without_id_link_with_nothing(spark):
    text = " ".join(f"w{k}" for k in range(30))
    got = jaccard_groups(frame(spark, [(5, text, None, None), (7, text, None, None), (None, text, None, None)])).collect()
    assert sorted((str(r["doc_id"]), r["component_id"]) for r in got) == [("5", 5), ("7", 5), ("None", None)]


def test_exact_levels_agree(spark):
    rows = odd_rows()
    largest, size = {}, {}
    for i, t, *_ in rows:
        t = t or ""
        largest[t] = max(largest.get(t, -1), -1 if i is None else i)
        size[t] = size.get(t, 0) + 1
    for digests in ("all", "surviving"):
        got = exact_duplicates(frame(spark, rows), digests=digests).collect()
        mine = sorted((str(r["doc_id"]), r["keep_id"], r["group_size"], r["kept"]) for r in got)
        assert mine == sorted((str(i), largest[t or ""], size[t or ""], i == largest[t or ""]) for i, t, *_ in rows)
    hashed = {r["text_sha256"] for r in exact_duplicates(frame(spark, rows)).collect()}
    assert brute.sha("two words") not in hashed and brute.sha(LONG) in hashed


def test_targets_are_reshared(spark):
    totals = spark.createDataFrame([("a", 100), ("b", 1), ("ä", 100), (None, 10), ("c", 0)], "source string, source_size long")
    got = {r["source"]: (r["weight"], r["target"]) for r in source_targets(totals).collect()}
    # By code point: a 1, b 2, c 3, ä 1, null 2. b stops at 3, c at 0, null at 30; a and ä share the rest.
    assert got == {"a": (1, 89.0), "b": (2, 3.0), "c": (3, 0.0), "ä": (1, 89.0), None: (2, 30.0)}


def test_mix_meets_targets(spark, sf_dir):
    df = spark.read.parquet(f"{sf_dir}/documents.parquet")
    got = mix_to_targets(df).collect()
    sizes = {r["doc_id"]: len(brute.WORD.findall(r["text"] or "")) for r in df.collect()}
    taken, target = {}, {}
    for r in got:
        assert r["size"] == sizes[r["doc_id"]] and 0 <= r["copies"] <= 3 and r["taken"] == r["copies"] * r["size"]
        taken[r["source"]] = taken.get(r["source"], 0) + r["taken"]
        target[r["source"]] = r["target"]
    assert sum(target.values()) == pytest.approx(sum(sizes.values()))
    for source, words in taken.items():
        assert words == pytest.approx(target[source], rel=0.01)
    again = mix_to_targets(df.repartition(5)).collect()
    assert sorted((r["doc_id"], r["taken"]) for r in again) == sorted((r["doc_id"], r["taken"]) for r in got)


def test_mix_of_one_hot_source(spark):
    rows = [(i, "same words here", None, "hot") for i in range(3000)] + [(9000, "a b", None, "z")]
    got = mix_to_targets(frame(spark, rows)).collect()
    by = {s: sum(r["taken"] for r in got if r["source"] == s) for s in ("hot", "z")}
    assert by == {"hot": 8997, "z": 6}


def test_language_is_learned(spark, sf_dir):
    df = spark.read.parquet(f"{sf_dir}/documents.parquet")
    profiles = learn_profiles(df.where("doc_id % 5 <> 0"))
    held = df.where("doc_id % 5 = 0")
    got = held.select("lang", identify(held, profiles).alias("f")).collect()
    assert np.mean([r["lang"] == r["f"]["lang_pred"] for r in got]) > 0.97
    assert all(0 <= r["f"]["score"] <= 1 for r in got)


def test_token_counts(spark, sf_dir):
    df = spark.read.parquet(f"{sf_dir}/documents.parquet")
    texts = {r["doc_id"]: r["text"] or "" for r in df.collect()}
    library = Tokenizer.from_file(default_path("word_bpe_49k.json"))
    for r in count_tokens(df).collect():
        text = texts[r["doc_id"]]
        n = len(library.encode(text, add_special_tokens=False).ids)
        assert (r["n_bytes"], r["n_tokens"], r["over_limit"]) == (len(text.encode()), n, n > 2048)


def test_packing(spark):
    import zlib

    docs = [(i, t) for i, t, *_ in odd_rows()]
    got = pack_documents(frame(spark, odd_rows())).collect()
    library = Tokenizer.from_file(default_path("byte_bpe_50k.json"))
    expected = []
    for i, t in docs:
        ids = [*library.encode(t or "", add_special_tokens=False).ids, 0]
        at, piece = 0, 0
        while at < len(ids):
            n = len(ids) % 2048 or 2048 if not at else 2048
            expected.append((str(i), piece, at, n, zlib.crc32(np.array(ids[at : at + n], "<u4").tobytes())))
            at, piece = at + n, piece + 1
    assert sorted((str(r["doc_id"]), r["piece"], r["start"], r["length"], r["ids_crc32"]) for r in got) == sorted(expected)
    sequences = {}
    for r in got:
        sequences.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for content in sequences.values():
        at = 0
        for offset, length in sorted(content):
            assert offset == at
            at += length
        assert at <= 2048
    assert len(sequences) <= -(-sum(r["length"] for r in got) // 2048) + 1


def test_personal_data_is_redacted(spark, sf_dir):
    df = spark.read.parquet(f"{sf_dir}/documents.parquet")
    model = learn_spans(df)
    texts = {r["doc_id"]: r["text"] or "" for r in df.collect()}
    for r in find_personal_data(df, model).collect():
        text = texts[r["doc_id"]]
        base = [(s["start"], ["email", "ip", "card", "phone"].index(s["kind"]), s["end"]) for s in r["spans"] if s["base"]]
        assert base == brute.personal(text)
        at, out = 0, ""
        for s in r["spans"]:
            if s["end"] > at:
                out += text[at : max(at, s["start"])] + (f"[{s['kind'].upper()}]" if s["start"] >= at else "")
                at = s["end"]
        assert r["redacted"] == out + text[at:]


def test_the_model_finds_disguised_forms(spark, sf_dir):
    df = spark.read.parquet(f"{sf_dir}/documents.parquet")
    model = learn_spans(df)
    found = {t[0] for t in model.spans("write to jane.doe (at) example (dot) org today")}
    assert found == {"email"}
    clean = "In 1999 the house had 12 rooms and 3.5 floors, at 10:30 it was sold for 250,000."
    assert model.spans(clean) == []


VECTORS = "vec_id long, embedding array<float>, label int, id string, v string, first string, shard string, n string"


def test_vectors(spark, sf_dir):
    df = spark.read.parquet(f"{sf_dir}/embeddings.parquet")
    rows = [(r["vec_id"], np.array(r["embedding"], float), r["label"]) for r in df.collect()]
    links = [
        (a, b)
        for k, (a, v, x) in enumerate(rows)
        for b, w, y in rows[k + 1 :]
        if x == y and v @ w / np.linalg.norm(v) / np.linalg.norm(w) >= 0.93
    ]
    groups = brute.components([r[0] for r in rows], links)
    n = {r[0]: 0 for r in rows}
    for a, b in links:
        n[a] += 1
        n[b] += 1
    got = vector_groups(df).collect()
    assert {r["vec_id"]: (r["n_links"], r["component_id"], r["kept"]) for r in got} == {
        i: (n[i], groups[i], i == groups[i]) for i in n
    }


def test_odd_vectors(spark):
    one, far = [1.0, 0.0, 0.5], [0.0, 1.0, 0.0]
    rows = [
        (1, one, 0), (2, one, 0), (3, [2.0, 0.0, 1.0], 0), (4, one, 1), (5, one, None), (6, None, 0), (7, [0.0, 0.0, 0.0], 0),
        (8, [1.0, None, 0.5], 0), (9, [float("nan"), 0.0, 0.5], 0), (10, [float("inf"), 0.0, 0.5], 0), (11, [], 0),
        (12, [1.0, 0.0], 0), (13, far, 0), (13, far, 0), (None, one, 0),
    ]
    got = vector_groups(spark.createDataFrame([(*r, *["x"] * 5) for r in rows], VECTORS)).collect()
    mine = sorted((str(r["vec_id"]), r["n_links"], r["component_id"], r["kept"]) for r in got)
    alone = [(str(k), 0, k, True) for k in (4, 5, 6, 7, 8, 9, 10, 11, 12)]
    linked = [("1", 2, 1, True), ("2", 2, 1, False), ("3", 2, 1, False), ("13", 1, 13, True), ("13", 1, 13, True)]
    assert mine == sorted([*alone, *linked, ("None", 0, None, None)])
    assert vector_groups(spark.createDataFrame([], VECTORS)).collect() == []


def test_vectors_in_shards(spark):
    rng = np.random.default_rng(8)
    centres = rng.normal(size=(20, 8))
    rows = [(i, [float(x) for x in centres[i % 20] + 0.1 * rng.normal(size=8)], 0, *["x"] * 5) for i in range(200)]
    df = spark.createDataFrame(rows, VECTORS)
    whole, cut = vector_groups(df).collect(), vector_groups(df, shard=60).collect()
    assert sorted(whole) == sorted(cut)
    assert sum(r["n_links"] for r in whole) > 500


@pytest.mark.parametrize("links", [[], [(i, i + 1) for i in range(60)], [(0, i) for i in range(1, 30)] + [(50, 51), (51, 50), (7, 7)]])
def test_components(spark, links):
    got = connected_components(spark.createDataFrame(links, "a long, b long")).collect()
    real = [e for e in links if e[0] != e[1]]
    assert {r["node"]: r["component"] for r in got} == brute.components({n for e in real for n in e}, real)
    assert len({r["node"] for r in got}) == len(got)


def test_tokenizer_rules_are_checked(tmp_path):
    from kadence.llm.token_counts import MergeCounter

    data = json.load(open(default_path("word_bpe_49k.json"), encoding="utf-8"))
    data["model"]["dropout"] = 0.5
    path = tmp_path / "odd.json"
    path.write_text(json.dumps(data))
    with pytest.raises(ValueError):
        MergeCounter(str(path))


@pytest.mark.parametrize("module", [suffix_dedup, substring_dedup])
def test_short_line_of_many_documents_is_spread(spark, monkeypatch, module):
    rng = random.Random(11)
    some = lambda k: " ".join(f"{rng.randrange(10**7):07d}" for _ in range(k))
    line = "all rights are reserved to them"
    texts = [f"{some(9)} {line} {some(9)}" for _ in range(1500)]
    # What stands around the line is whole copied in a few, within a block and across blocks.
    texts += [f"{some(3)} {t[40:150]} {some(rng.randrange(9))}" for t in texts[:40] for _ in range(2)]
    docs = list(enumerate(texts))

    def guarded(docs, rule, *args):
        def judge(contents, numbers, rows):
            assert len(rows) < 700, "too much in one task"
            return rule.judge(contents, numbers, rows)

        return repeats.repeated_windows(docs, replace(rule, judge=judge), *args, block_bytes=2_000)

    monkeypatch.setattr(repeats, "HOT_STRETCHES", 100, raising=False)
    monkeypatch.setattr(module, "repeated_windows", guarded)
    df = frame(spark, [(i, t, None, None) for i, t in docs])
    if module is suffix_dedup:
        got = drop_earlier_copies(df, length=40, gram=16).collect()
        mine = {r["doc_id"]: (r["n_bytes"], r["n_removed"], r["n_spans"], bytes(r["kept"])) for r in got}
        assert mine == brute.earlier_copies(docs, 40)
    else:
        got = drop_repeated_passages(df, window=9, gram=4).collect()
        assert {r["doc_id"]: (r["n_words"], r["n_removed"], r["kept"]) for r in got} == brute.passages(docs, 9)
    assert sum(r["n_removed"] > 0 for r in got) >= 40


def test_digests_are_alike_at_every_size(spark, monkeypatch):
    df = frame(spark, odd_rows())
    few = sorted(map(repr, exact_duplicates(df).collect()))
    monkeypatch.setattr(exact_dedup, "MAX_KEYS", 0)
    assert sorted(map(repr, exact_duplicates(df).collect())) == few
