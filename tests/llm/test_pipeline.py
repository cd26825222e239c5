"""The corpus pipeline, stage by stage and as a whole; queries with SQL against DuckDB."""

import duckdb
import pytest

import corpus_pipeline
from kadence.llm.queries import ORACLES, QUERIES

from . import brute

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_agrees_with_sql(spark, sf_dir, name):
    con = duckdb.connect()
    con.execute(f"create view documents as select * from '{sf_dir}/documents.parquet'")
    result = con.execute(ORACLES[name])
    order = [d[0] for d in result.description]
    got = QUERIES[name](spark, sf_dir)
    assert sorted(got.columns) == sorted(order)
    mine = sorted(repr(tuple(r[c] for c in order)) for r in got.collect())
    assert mine == sorted(map(repr, result.fetchall()))


def test_stages(spark, sf_dir):
    stages = dict(corpus_pipeline.STAGES)
    assert list(stages) == ["language", "exact_dedup", "ngram_join", "mixing", "packing"]
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    rows = {r["doc_id"]: r for r in docs.collect()}

    kept = corpus_pipeline.stored(stages["language"](spark, docs, sf_dir))
    assert kept.columns == COLUMNS
    ids = {r["doc_id"] for r in kept.collect()}
    assert len(ids) > 0.98 * len(rows)

    unique = corpus_pipeline.stored(stages["exact_dedup"](spark, kept, sf_dir))
    last = {}
    for i in sorted(ids):
        last[rows[i]["text"] or ""] = i
    assert unique.columns == COLUMNS
    assert sorted(r["doc_id"] for r in unique.collect()) == sorted(last.values())

    single = corpus_pipeline.stored(stages["ngram_join"](spark, unique, sf_dir))
    groups = brute.jaccard([(i, rows[i]["text"]) for i in last.values()])
    assert single.columns == COLUMNS
    assert sorted(r["doc_id"] for r in single.collect()) == sorted(i for i, (_, c) in groups.items() if i == c)

    mixed = corpus_pipeline.stored(stages["mixing"](spark, single, sf_dir))
    assert mixed.columns == COLUMNS
    words = {}
    for r in mixed.collect():
        words[r["source"]] = words.get(r["source"], 0) + len(brute.WORD.findall(r["text"] or ""))
    total = sum(len(brute.WORD.findall(r["text"] or "")) for r in single.collect())
    assert sum(words.values()) == pytest.approx(total, rel=0.01)

    packed = stages["packing"](spark, mixed, sf_dir).collect()
    assert sum(r["piece"] == 0 for r in packed) == mixed.count()


def test_run(spark, sf_dir):
    got = corpus_pipeline.run(spark, sf_dir)
    assert {"doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"} <= set(got.columns)
    assert got.count() > 500


def test_stages_take_odd_rows(spark, sf_dir):
    schema = "doc_id long, text string, lang string, source string, n_chars long, _copies string, _id string, found string"
    rows = [(1, "words of a text", "en", "a", 1), (1, "words of a text", "en", "a", 1), (2, None, None, None, None), (None, "ein text", "de", None, 2), (3, "12 34", "en", "a", 3)]
    for some in (rows, []):
        docs = spark.createDataFrame([(*r, "x", "y", "z") for r in some], schema)
        for name, stage in corpus_pipeline.STAGES:
            docs = corpus_pipeline.stored(stage(spark, docs, sf_dir))
            if name != "packing":
                assert docs.columns == [c.split()[0] for c in schema.split(", ")]
        if not some:
            assert docs.count() == 0


def test_language_drops_foreign_texts_and_keeps_short_ones(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select(*COLUMNS)
    foreign = [
        "Съешь ещё этих мягких французских булок да выпей же чаю. Москва является столицей России.",
        "Kaikki ihmiset syntyvät vapaina ja tasavertaisina arvoltaan ja oikeuksiltaan. Heille on annettu järki ja "
        "omatunto, ja heidän on toimittava toisiaan kohtaan veljeyden hengessä.",
        "Minden emberi lény szabadon születik és egyenlő méltósága és joga van. Az emberek, ésszel és lelkiismerettel "
        "bírván, egymással szemben testvéri szellemben kell hogy viseltessenek.",
        "すべての人間は、生れながらにして自由であり、かつ、尊厳と権利とについて平等である。",
    ]
    short = ["Von.", "That it.", "Erinst resh.", "Des enberge die enver.", "Pachque çaneux et."]
    planted = [(10**9 + k, t, None, "planted", len(t)) for k, t in enumerate([*foreign, *short])]
    got = dict(corpus_pipeline.STAGES)["language"](spark, docs.union(spark.createDataFrame(planted, docs.schema)), sf_dir)
    assert sorted(r["text"] for r in got.where("source = 'planted'").collect()) == sorted(short)


def test_rows_without_id_or_with_the_same_are_told_apart(spark, sf_dir):
    stages = dict(corpus_pipeline.STAGES)
    schema = "doc_id long, text string, lang string, source string, n_chars long"

    def run(name, rows):
        docs = spark.createDataFrame([(i, t, "en", s, len(t)) for i, t, s in rows], schema)
        return [(r["doc_id"], r["text"], r["source"]) for r in stages[name](spark, docs, sf_dir).collect()]

    rows = [(5, "A"), (5, "B"), (9, "A"), (None, "A"), (None, "C"), (None, "C"), (7, "D"), (7, "D"), (None, "E")]
    got = run("exact_dedup", [(*r, "s") for r in rows])
    assert sorted((r[:2] for r in got), key=repr) == sorted([(9, "A"), (5, "B"), (None, "C"), (7, "D"), (None, "E")], key=repr)

    near = lambda w, k: " ".join([*(f"{w}{i}" for i in range(80)), f"end{k}"])
    rows = [(None, near("a", 1)), (4, near("a", 2)), (6, near("a", 3)), (None, near("b", 1)), (None, near("b", 2)), (8, near("c", 1)), (8, near("c", 2)), (8, near("d", 1))]
    got = run("ngram_join", [(*r, "s") for r in rows])
    assert sorted((repr(i), t[0]) for i, t, _ in got) == [("4", "a"), ("8", "c"), ("8", "d"), ("None", "b")]

    words = lambda n: " ".join(["w"] * n)
    rows = [(None if k % 3 == 0 else k // 2, words(5 + k * 7 % 36), "ab"[k % 2]) for k in range(600)]
    got = run("mixing", rows)
    total = sum(len(t.split()) for _, t, _ in rows)
    for source, share in (("a", 1 / 3), ("b", 2 / 3)):
        assert sum(len(t.split()) for _, t, s in got if s == source) == pytest.approx(share * total, rel=0.01)
