import json

import pytest
from conftest import rows
from pyspark.sql import functions as F

from kadence.functions.messages import templates
from kadence.operators.changes import dedupe_redelivered_stream
from kadence.operators.gold import yearly_activity_eligibility
from kadence.plans import queries as P
from kadence.plans.views import IMAGE, Views, as_topic
from kadence.rules import Rules
from kadence.schemas import ACTIVITY_IMAGE
from kadence.sinks.tables import read_batches
from kadence.sources.streams import FileTopic, read_change_stream
from kadence.streaming import batches, facts, state
from kadence.streaming.monitor import Heartbeat

ONCE = {"availableNow": True}
SF = "/root/testdata/sf0.001"


def from_image(people):
    return people.withColumn(
        "reason", F.when(F.col("adresse_domicile").isNull(), F.lit("adresse manquante"))
    )


@pytest.fixture(scope="module")
def landed(spark, tmp_path_factory):
    """State messages in five files, so that changes of a key fall into several batches."""
    folder = str(tmp_path_factory.mktemp("topic"))
    topic = as_topic(Views(spark, SF).fx_topic)
    topic.repartitionByRange(5, "offset").write.parquet(f"{folder}/t")
    return FileTopic(f"{folder}/t", topic.schema)


def run_state(spark, landed, root, files=2, **options):
    state.run_state_stream(
        read_change_stream(spark, landed, files_per_trigger=files), IMAGE, from_image, P.RULES,
        f"{root}/lake", f"{root}/offsets", at=F.col("ts"), trigger=ONCE, **options,
    ).awaitTermination()
    return f"{root}/lake"


def lake(spark, root):
    names = ["bronze", "malformed", "state_log", "incoherences", "registry_log"]
    return {n: rows(spark.read.parquet(f"{root}/{n}").drop("epoch_id")) for n in names}


def test_stream_equals_batch(spark, landed, tmp_path):
    root = run_state(spark, landed, str(tmp_path))
    views = Views(spark, SF)
    # As in the stream, without the distances' own reasons.
    assert rows(state.stored_intervals(spark, root)) == rows(P.intervals(views))
    changes = P.changes(views)
    bronze = spark.read.parquet(f"{root}/bronze")
    assert bronze.select("epoch_id").distinct().count() > 1
    assert "adresse" not in bronze.filter("after is not null").first()["after"]
    created = changes.filter("op in ('r', 'c')")
    registry = state.stored_registry(spark, root)
    assert registry.count() == created.select("id_salarie").distinct().count()
    deleted = changes.filter("op = 'd'").select("id_salarie").distinct()
    assert registry.filter("deleted_at is not null").count() == deleted.count()
    counts = read_batches(spark, f"{root}/counts", batches.COUNTS)
    total = counts.filter("dataset = 'state_log'").agg(F.sum("rows")).first()[0]
    assert total == spark.read.parquet(f"{root}/state_log").count()


def test_replay_converges(spark, landed, tmp_path):
    root = run_state(spark, landed, str(tmp_path))
    before = lake(spark, root)
    commits = sorted((tmp_path / "offsets" / "commits").glob("[0-9]*"), key=lambda p: int(p.name))
    commits[-1].unlink()
    (commits[-1].parent / f".{commits[-1].name}.crc").unlink(missing_ok=True)
    run_state(spark, landed, str(tmp_path))
    assert lake(spark, root) == before


def test_incoherences_of_updates_without_flip_are_optional(spark, landed, tmp_path):
    few = run_state(spark, landed, f"{tmp_path}/a", files=None)
    many = run_state(spark, landed, f"{tmp_path}/b", files=None, log_all_incoherences=True)
    def count(r):
        return read_batches(spark, f"{r}/incoherences", state.INCOHERENCES).count()

    assert count(few) <= count(many)
    assert lake(spark, few)["state_log"] == lake(spark, many)["state_log"]


def run_with(spark, landed, tmp_path, evaluate):
    state.run_state_stream(
        read_change_stream(spark, landed), IMAGE, evaluate, P.RULES,
        f"{tmp_path}/lake", f"{tmp_path}/offsets", at=F.col("ts"), trigger=ONCE,
    ).awaitTermination()


def test_rejected_batch_goes_to_the_dead_letters(spark, landed, tmp_path):
    reason = "no such place " * 1_000

    def rejects(people):
        raise batches.Rejected(reason)

    run_with(spark, landed, tmp_path, rejects)
    dead = spark.read.parquet(f"{tmp_path}/lake/dead_letter")
    assert dead.count() == spark.read.parquet(landed.path).count()
    assert dead.first()["error"] == reason
    # Rows written before the failure are taken back.
    assert spark.read.parquet(f"{tmp_path}/lake/bronze").isEmpty()


@pytest.mark.parametrize("error", [ValueError("no lookup today"), batches.Rejected("no")])
def test_a_failure_stops_the_query_and_a_restart_delivers_again(spark, landed, tmp_path, monkeypatch, error):
    def fails(people):
        raise error

    def no_disk(*args):
        raise OSError("no disk for dead letters")

    with monkeypatch.context() as patched:
        patched.setattr(batches, "dead_letter", no_disk)
        with pytest.raises(Exception, match="no "):
            run_with(spark, landed, tmp_path, fails)
    assert not list((tmp_path / "offsets" / "commits").glob("[0-9]*"))
    run_with(spark, landed, tmp_path, from_image)
    root = f"{tmp_path}/lake"
    assert rows(state.stored_intervals(spark, root)) == rows(P.intervals(Views(spark, SF)))
    assert not (tmp_path / "lake" / "dead_letter").exists()


def test_a_new_checkpoint_does_not_overwrite_the_lake(spark, landed, tmp_path):
    root = run_state(spark, landed, str(tmp_path), files=None)
    before = lake(spark, root)
    with pytest.raises(Exception, match="belong to query"):
        state.run_state_stream(
            read_change_stream(spark, landed), IMAGE, from_image, P.RULES,
            root, f"{tmp_path}/other", at=F.col("ts"), trigger=ONCE,
        ).awaitTermination()
    assert lake(spark, root) == before


def change(op, before, after, topic, partition, offset, ts):
    payload = json.dumps({"payload": {"op": op, "before": before, "after": after}})
    return (payload, topic, partition, offset, ts)


def employee(k, metres, mode="Marche/running"):
    return {"id_salarie": k, "nom": "N", "adresse_domicile": f"{metres} x", "moyen_deplacement": mode, "distance_m": metres}


POSITIONS = "value string, topic string, partition int, offset bigint, ts string"


def run_changes(spark, folder, lots, **options):
    for lot in lots:
        df = spark.createDataFrame(lot, POSITIONS).withColumn("ts", F.to_timestamp("ts"))
        df.coalesce(1).write.mode("append").parquet(f"{folder}/topic")
    return run_state(spark, FileTopic(f"{folder}/topic", df.schema), folder, files=1, **options)


def test_changes_that_move_between_partitions_and_topics(spark, tmp_path):
    near, far = employee(1, 100), employee(1, 90_000)
    lots = [
        [change("c", None, near, "a", 0, 900, "2026-01-01"), change("c", None, employee(2, 5), "b", 0, 900, "2026-01-01")],
        # The key moved to a partition whose offsets are lower, and to a topic with equal ones.
        [change("u", near, far, "a", 1, 3, "2026-01-05")],
        [change("u", far, near, "b", 1, 3, "2026-01-09"), change("u", near, far, "a", 0, 901, "2026-01-11")],
        [change("u", far, near, "b", 1, 3, "2026-01-09")],
    ]
    root = run_changes(spark, str(tmp_path), lots)
    got = state.stored_intervals(spark, root).filter("id_salarie = 1")
    spans = sorted((str(r["date_debut"])[:10], str(r["date_fin"])[:10], r["est_eligible_prime_annuel"]) for r in got.collect())
    assert spans == [
        ("2026-01-01", "2026-01-05", True), ("2026-01-05", "2026-01-09", False),
        ("2026-01-09", "2026-01-11", True), ("2026-01-11", "None", False),
    ]


def test_gate_moves_failing_rows_to_quarantine(spark, tmp_path):
    nobody, known = employee(None, 100), employee(1, 100)
    homeless = {**known, "id_salarie": None, "adresse_domicile": None}
    lot = [
        change("c", None, known, "a", 0, 1, "2026-01-01"),
        change("c", None, nobody, "a", 0, 2, "2026-01-01"),
        change("c", None, homeless, "a", 0, 3, "2026-01-01"),
        change("d", nobody, None, "a", 0, 4, "2026-01-02"),
        change("d", known, None, "a", 0, 5, "2026-01-03"),
    ]
    root = run_changes(spark, str(tmp_path), [lot], gate=True)
    failed = spark.read.parquet(f"{root}/quarantine").groupBy("dataset").count()
    assert {r["dataset"]: r["count"] for r in failed.collect()} == {
        "silver_new": 2, "incoherences": 1, "registry_insert": 2, "registry_delete": 1
    }
    log = spark.read.parquet(f"{root}/state_log")
    # A closing without an id has no interval to end.
    assert log.filter("id_salarie is not null").count() == 2
    assert log.filter("id_salarie is null and kind = 'open'").isEmpty()
    assert spark.read.parquet(f"{root}/incoherences").isEmpty()
    assert rows(state.stored_registry(spark, root), "id_salarie") == [(1,)]
    open_root = run_changes(spark, f"{tmp_path}/open", [lot])
    assert spark.read.parquet(f"{open_root}/quality").count() == 6
    assert spark.read.parquet(f"{open_root}/registry_log").count() == 5


def test_gate_and_bonus_refresh(spark, landed, tmp_path):
    incomes = Views(spark, SF).fx_employee.select("id_salarie", "salaire_brut")
    root = run_state(
        spark, landed, str(tmp_path), files=100, gate=True, incomes=incomes, as_of_year=P.YEAR
    )
    gold = spark.read.parquet(f"{root}/gold_bonus/version=0")
    assert gold.count() == P.QUERIES["annual_bonus"](spark, SF).count()
    assert rows(spark.read.parquet(f"{root}/export/gold_bonus")) == rows(gold)
    suites = spark.read.parquet(f"{root}/gold_quality").select("dataset").distinct()
    assert {r[0] for r in suites.collect()} <= {"silver_before_fill", "silver_after_fill", "gold_bonus"}


def test_failing_refresh_is_recorded(spark, landed, tmp_path):
    wrong = spark.createDataFrame([(1,)], "other int")
    root = run_state(spark, landed, str(tmp_path), files=100, incomes=wrong, as_of_year=P.YEAR)
    errors = read_batches(spark, f"{root}/gold_errors", batches.ERRORS)
    assert errors.count() == 1
    assert state.stored_log(spark, root).count() > 0


ACTIVITY = {
    "id_evenement_sport": 1, "salarie_id": 7, "date_debut_activite": 1_767_225_600_000_000,
    "date_fin_activite": 1_767_231_000_000_000, "sport_type": "Runing", "distance_m": 12_340,
    "commentaire": "Top",
}


def fact(op, after, offset, before=None):
    return (json.dumps({"payload": {"op": op, "before": before, "after": after}}), "facts", 0, offset)


@pytest.fixture
def activity_stream(spark, tmp_path):
    messages = [
        fact("c", ACTIVITY, 0),
        fact("c", ACTIVITY, 0),
        fact("c", {**ACTIVITY, "id_evenement_sport": 2, "sport_type": "Curling"}, 1),
        fact("c", {**ACTIVITY, "id_evenement_sport": 3, "salarie_id": 8}, 2),
        fact("r", {**ACTIVITY, "id_evenement_sport": 4}, 3),
        fact("d", None, 4),
        (None, "facts", 0, 5),
        ("broken", "facts", 0, 6),
    ]
    schema = "value string, topic string, partition int, offset bigint"
    spark.createDataFrame(messages, schema).coalesce(1).write.parquet(f"{tmp_path}/facts")
    return FileTopic(f"{tmp_path}/facts")


def test_activities_become_messages_errors_and_days(spark, activity_stream, tmp_path):
    staff = spark.createDataFrame([(7, "Petit", "Ana")], "id_salarie bigint, nom string, prenom string")
    rules = Rules(min_activities=1)
    facts.run_fact_stream(
        read_change_stream(spark, activity_stream), staff, templates(spark), rules,
        f"{tmp_path}/lake", f"{tmp_path}/offsets", trigger=ONCE,
    ).awaitTermination()
    sent = spark.read.parquet(f"{tmp_path}/lake/notifications").collect()
    assert len(sent) == 1
    assert " Ana Petit ! " in sent[0]["message"]
    assert "12.3 km" in sent[0]["message"]
    assert sent[0]["message"].endswith(' ("Top"). ')
    errors = spark.read.parquet(f"{tmp_path}/lake/notification_errors")
    assert rows(errors, "salarie", "error") == [(7, "'Curling'"), (8, "'prenom'")]
    gold = facts.stored_wellbeing(spark, f"{tmp_path}/lake")
    # The row that the snapshot read counts as well.
    assert rows(gold) == [(7, 2026, 3, True, 5), (8, 2026, 1, False, 0)]
    assert rows(spark.read.parquet(f"{tmp_path}/lake/export/gold_wellbeing")) == rows(gold)
    kept = facts.stored_facts(spark, f"{tmp_path}/lake")
    assert kept.count() == 4
    assert rows(yearly_activity_eligibility(kept, rules)) == rows(gold)
    assert set(kept.columns) == set(ACTIVITY_IMAGE.fieldNames())


def test_days_follow_what_is_stored(spark, tmp_path):
    """Copies in later batches, moves between years and deletions, a batch each."""
    later = {**ACTIVITY, "date_fin_activite": ACTIVITY["date_fin_activite"] + 366 * 86_400_000_000}
    second = {**ACTIVITY, "id_evenement_sport": 2}
    batches_ = [
        ([fact("c", ACTIVITY, 0), fact("r", second, 1)], {(7, 2026): 2}),
        ([fact("c", ACTIVITY, 0)], {(7, 2026): 2}),
        ([fact("u", later, 2, ACTIVITY)], {(7, 2026): 1, (7, 2027): 1}),
        ([fact("d", None, 3, second)], {(7, 2027): 1}),
    ]
    staff = spark.createDataFrame([(7, "Petit", "Ana")], "id_salarie bigint, nom string, prenom string")
    schema = "value string, topic string, partition int, offset bigint"
    for messages, want in batches_:
        spark.createDataFrame(messages, schema).coalesce(1).write.mode("append").parquet(f"{tmp_path}/t")
        facts.run_fact_stream(
            read_change_stream(spark, FileTopic(f"{tmp_path}/t"), files_per_trigger=1), staff, templates(spark),
            Rules(min_activities=1), f"{tmp_path}/lake", f"{tmp_path}/offsets", trigger=ONCE,
        ).awaitTermination()
        gold = facts.stored_wellbeing(spark, f"{tmp_path}/lake").filter("nb_activites > 0").collect()
        assert {(r["salarie_id"], r["annee"]): r["nb_activites"] for r in gold} == want


def test_either_stream_refreshes_the_bonus(spark, landed, activity_stream, tmp_path):
    incomes = Views(spark, SF).fx_employee.select("id_salarie", "salaire_brut")
    root = run_state(spark, landed, str(tmp_path), files=None)
    assert not (tmp_path / "lake" / "gold_bonus").exists()
    staff = spark.createDataFrame([(7, "Petit", "Ana")], "id_salarie bigint, nom string, prenom string")
    facts.run_fact_stream(
        read_change_stream(spark, activity_stream), staff, templates(spark), P.RULES,
        f"{tmp_path}/facts_lake", f"{tmp_path}/facts_offsets", trigger=ONCE,
        after_refresh=lambda batch, writer, batch_id: state.refresh_bonus(
            spark, root, incomes, P.RULES, P.YEAR, batch_id
        ),
    ).awaitTermination()
    gold = spark.read.parquet(f"{root}/gold_bonus/version=0")
    assert gold.count() == P.QUERIES["annual_bonus"](spark, SF).count()


def test_redelivery_in_a_later_batch_is_dropped(spark, tmp_path):
    schema = "value string, topic string, partition int, offset bigint, ts timestamp"
    for i in range(2):
        data = [("v", "t", 0, 1, None), ("v", "t", 0, i + 5, None)]
        df = spark.createDataFrame(data, schema).withColumn("ts", F.lit("2026-01-01").cast("timestamp"))
        df.coalesce(1).write.parquet(f"{tmp_path}/in/{i}")
    stream = read_change_stream(spark, FileTopic(f"{tmp_path}/in/*", df.schema), files_per_trigger=1)
    once = dedupe_redelivered_stream(stream, "ts", "1 day")
    q = (
        once.writeStream.format("parquet")
        .option("checkpointLocation", f"{tmp_path}/c")
        .trigger(availableNow=True)
        .start(f"{tmp_path}/out")
    )
    q.awaitTermination()
    assert rows(spark.read.parquet(f"{tmp_path}/out"), "offset") == [(1,), (5,), (6,)]


def test_heartbeat(spark, landed, tmp_path):
    beat = Heartbeat(spark, f"{tmp_path}/events", flush_every=2)
    spark.streams.addListener(beat)
    try:
        run_state(spark, landed, str(tmp_path), files=None, name="beating")
        spark.sparkContext._jsc.sc().listenerBus().waitUntilEmpty()
        for _ in range(50):
            if beat.alive.get("beating") is False:
                break
            __import__("time").sleep(0.1)
    finally:
        spark.streams.removeListener(beat)
    kept = beat.rows()
    events = [r["event"] for r in kept.filter("query = 'beating'").collect()]
    assert {"started", "progress", "ended"} <= set(events)
    assert kept.filter("event = 'progress'").agg(F.sum("input_rows")).first()[0] > 0
    # Nothing is dropped, however many events there are.
    beat.events = [("many", "idle", None, None, None)] * 25_000
    assert beat.rows().filter("query = 'many'").count() == 25_000
