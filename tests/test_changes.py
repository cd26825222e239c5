import json

import pytest
from conftest import rows
from pyspark.sql import functions as F

from kadence.operators import changes as C
from kadence.plans.views import IMAGE
from kadence.sinks.tables import spooled

A = {
    "id_salarie": 1, "nom": "N", "adresse_domicile": "1 Rue A",
    "moyen_deplacement": "Marche/running", "distance_m": 10,
}
B = {**A, "moyen_deplacement": None}


def message(op, before, after):
    return json.dumps({"payload": {"op": op, "before": before, "after": after}})


MESSAGES = [
    message("r", None, A),
    message("c", None, A),
    message("u", A, B),
    message("u", A, {**A, "distance_m": 11}),
    message("u", None, A),
    message("d", A, None),
    message("d", None, None),
    None,
    "no json",
    "{}",
    '{"schema": 1}',
    '{"payload": {"op": "c", "after": {"id_salarie": "text"}}}',
]


@pytest.fixture(scope="module")
def topic(spark):
    data = [(m, "t", i % 2, i) for i, m in enumerate(MESSAGES)]
    return spark.createDataFrame(data, "value string, topic string, partition int, offset bigint")


def test_tombstones_and_malformed(topic):
    assert C.drop_tombstones(topic).count() == len(MESSAGES) - 1
    good, bad = C.split_malformed(topic, IMAGE)
    assert rows(bad, "offset") == [(11,), (8,)]
    assert good.count() == len(MESSAGES) - 3


def test_routes(topic):
    routed = C.route_state_changes(C.unwrap_envelope(topic, IMAGE))
    assert dict(rows(routed, "offset", "route")) == {
        0: "created", 1: "created", 2: "updated", 3: "updated", 5: "deleted",
    }


def test_relevant_change_is_null_safe(topic):
    changes = C.unwrap_envelope(topic, IMAGE).filter(C.has_relevant_change())
    assert rows(changes, "offset") == [(2,)]


def test_facts_count_only_when_inserted(topic):
    inserts = C.route_fact_inserts(C.unwrap_envelope(topic, IMAGE))
    assert rows(inserts, "offset") == [(1,)]


def test_bronze_keeps_nulls_and_drops_personal_fields(topic):
    changes = C.unwrap_envelope(topic, IMAGE).filter("offset = 2")
    at = F.lit("2026-01-01").cast("timestamp")
    full = C.to_bronze(changes, at).first()
    assert json.loads(full["after"]) == B
    lean = C.to_bronze(C.drop_pii(changes), at).first()
    assert json.loads(lean["after"]) == {"id_salarie": 1, "moyen_deplacement": None}
    deleted = C.to_bronze(C.unwrap_envelope(topic, IMAGE).filter("offset = 5"), at).first()
    assert deleted["after"] is None


def test_redelivered_messages_count_once(topic):
    assert C.dedupe_redelivered(topic.union(topic)).count() == len(MESSAGES)


def test_a_spooled_batch_is_split_like_the_decoded_one(topic, tmp_path):
    """Only what is no JSON keeps its text, and missing images stay missing."""
    decoded = C.decode(topic, IMAGE)
    light = spooled(C.without_text(decoded), str(tmp_path / "batch"))
    assert rows(C.malformed_of(light)) == rows(C.malformed_of(decoded))
    assert rows(C.changes_of(light)) == rows(C.changes_of(decoded))
    texts = {r["offset"]: r["value"] for r in light.collect()}
    assert texts[0] == "" and texts[7] is None and texts[8] == "no json"


def test_batch_id(topic):
    got = C.batch_offset_ranges(topic, F.lit(1768571234567)).first()["batch_id"]
    assert got == "1768571234567_p0:0-10_p1:1-11"


def test_snapshot_diff(spark):
    old = spark.createDataFrame([(1, "a"), (2, "b"), (3, None)], "k int, v string")
    new = spark.createDataFrame([(2, "c"), (3, None), (4, "d")], "k int, v string")
    diff = C.diff_to_changes(old, new, "k", ["v"])
    got = {(r["op"], (r["before"] or r["after"])["k"]) for r in diff.collect()}
    assert got == {("d", 1), ("u", 2), ("c", 4)}


def test_snapshot_is_read_changes(spark):
    first = C.snapshot_to_changes(spark.createDataFrame([(1, "a")], "k int, v string")).first()
    assert (first["op"], first["before"], first["after"]["v"]) == ("r", None, "a")
