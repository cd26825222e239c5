"""Products kept by deltas: equal to a full count whatever fails, and their work follows the batch."""

import json
import random

import pytest
from conftest import rows
from pyspark.sql import functions as F
from test_streams import ACTIVITY, POSITIONS, change, employee, from_image

from kadence.functions.messages import templates
from kadence.operators.gold import annual_bonus, yearly_activity_eligibility
from kadence.plans import queries as P
from kadence.plans.views import IMAGE
from kadence.rules import Rules
from kadence.schemas import ACTIVITY_IMAGE
from kadence.sinks.tables import read_batches, units, versions
from kadence.sources.streams import FileTopic, read_change_stream
from kadence.streaming import batches, facts, state
from kadence.streaming.consumed import consumed_table

DAY = 86_400_000_000
ONCE = {"availableNow": True}
FACTS = "value string, topic string, partition int, offset bigint, ts timestamp"


def activity(i, who, day=0):
    end = ACTIVITY["date_fin_activite"] + day * DAY
    return {**ACTIVITY, "id_evenement_sport": i, "salarie_id": who, "date_fin_activite": end}


def lots_of_activities(seed, lots=3, each=16):
    """Lots of creations, moves and deletions, mostly of other employees in each lot, with copies of older messages."""
    chance, live, messages, out, offset = random.Random(seed), {}, [], [], 0
    for lot in range(lots):
        made = []
        for _ in range(each):
            pick = chance.random()
            if pick < 0.15 and messages:
                made.append(chance.choice(messages))
                continue
            if pick < 0.7 or not live:
                key = len(live) + offset + 1
                before, after = None, activity(key, lot * 10 + chance.randrange(4), chance.randrange(800))
                live[key] = after
            elif pick < 0.85:
                key = chance.choice(list(live))
                before, after = live[key], activity(key, chance.randrange(50), chance.randrange(800))
                live[key] = after
            else:
                key = chance.choice(list(live))
                before, after = live.pop(key), None
            op = "c" if before is None else "u" if after else "d"
            payload = json.dumps({"payload": {"op": op, "before": before, "after": after}})
            made.append((payload, "facts", key % 2, offset, None))
            offset += 1
        messages += made
        out.append(made)
    return out, live


def land(spark, folder, lot, schema=FACTS):
    spark.createDataFrame(lot, schema).coalesce(1).write.mode("append").parquet(f"{folder}/t")
    return FileTopic(f"{folder}/t", spark.createDataFrame([], schema).schema)


def run_facts(spark, folder, topic, **options):
    staff = spark.createDataFrame([(7, "Petit", "Ana")], "id_salarie bigint, nom string, prenom string")
    facts.run_fact_stream(
        read_change_stream(spark, topic, files_per_trigger=1), staff, templates(spark), Rules(min_activities=2),
        f"{folder}/lake", f"{folder}/offsets", trigger=ONCE, width=5, **options,
    ).awaitTermination()
    return f"{folder}/lake"


def counted_anew(spark, live):
    images = spark.createDataFrame([tuple(a[c] for c in ACTIVITY_IMAGE.fieldNames()) for a in live.values()], ACTIVITY_IMAGE)
    timed = images.withColumn("date_fin_activite", F.timestamp_micros("date_fin_activite"))
    return rows(yearly_activity_eligibility(timed, Rules(min_activities=2)))


def failing(monkeypatch, which):
    """Let the refreshes of the given numbers fail."""
    calls, real = [], facts.refresh_wellbeing_table

    def refresh(*args, **options):
        calls.append(1)
        if len(calls) in which:
            raise OSError("no disk for the product")
        return real(*args, **options)

    monkeypatch.setattr(facts, "refresh_wellbeing_table", refresh)


@pytest.mark.parametrize("which", [{1}, {2}, {3}])
def test_pairs_of_a_failed_refresh_are_made_up_for(spark, tmp_path, monkeypatch, which):
    lots, live = lots_of_activities(1)
    failing(monkeypatch, which)
    for lot in lots:
        topic = land(spark, tmp_path, lot)
    lake = run_facts(spark, tmp_path, topic)
    assert rows(facts.stored_wellbeing(spark, lake)) == counted_anew(spark, live)
    assert read_batches(spark, f"{lake}/gold_errors", batches.ERRORS).count() == len(which)
    assert rows(spark.read.parquet(f"{lake}/export/gold_wellbeing")) == counted_anew(spark, live)


def test_the_tail_of_a_run_is_refreshed(spark, tmp_path):
    lots, live = lots_of_activities(2)
    for lot in lots:
        topic = land(spark, tmp_path, lot)
    lake = run_facts(spark, tmp_path, topic, refresh_every=2)
    assert rows(facts.stored_wellbeing(spark, lake)) == counted_anew(spark, live)


def test_rows_of_a_batch_are_not_held_in_memory(spark, tmp_path, monkeypatch):
    """Messages, their images and texts are as many as a batch has: they are read from files, not persisted."""
    lots, live = lots_of_activities(8)
    for lot in lots:
        topic = land(spark, tmp_path, lot)
    held, frame = [], type(spark.range(0))
    real = frame.persist
    monkeypatch.setattr(frame, "persist", lambda df, *level: held.append(set(df.columns)) or real(df, *level))
    lake = run_facts(spark, tmp_path, topic)
    assert rows(facts.stored_wellbeing(spark, lake)) == counted_anew(spark, live)
    assert held and all(h <= {"topic", "partition", "first", "last", "salarie_id", "annee", "by"} for h in held)
    assert not (tmp_path / "lake/_decoded").exists()


def test_empty_and_rejected_epochs_lose_no_pairs(spark, tmp_path, monkeypatch):
    lots, live = lots_of_activities(3)
    # All of the second lot comes again as the third, so its epoch, which should refresh, is empty.
    lots = [lots[0], lots[1], lots[1], lots[2]]
    real, calls = facts.build_messages, []

    def rejects(activities, *args):
        calls.append(1)
        if len(calls) == 1:
            raise batches.Rejected("first attempt")
        return real(activities, *args)

    for lot in lots:
        topic = land(spark, tmp_path, lot)
    monkeypatch.setattr(facts, "build_messages", rejects)
    lake = run_facts(spark, tmp_path, topic, refresh_every=3)
    assert rows(facts.stored_wellbeing(spark, lake)) == counted_anew(spark, live)


def test_kept_facts_equal_the_log(spark, tmp_path):
    lots, _ = lots_of_activities(4)
    for lot in lots:
        topic = land(spark, tmp_path, lot)
    lake = run_facts(spark, tmp_path, topic, compact_fan=2)
    log = read_batches(spark, f"{lake}/facts", facts.FACT_LOG)
    assert rows(facts.stored_facts(spark, lake)) == rows(facts.current_facts(log))
    assert any(u.level for u in units(spark, f"{lake}/facts"))
    # Copies of older messages are logged and notified once.
    positions = log.select("topic", "partition", "offset")
    assert positions.count() == positions.distinct().count()


def test_a_copy_after_any_time_is_not_notified_again(spark, tmp_path):
    known = activity(1, 7)
    first = (json.dumps({"payload": {"op": "c", "before": None, "after": known}}), "facts", 0, 0, None)
    topic = land(spark, tmp_path, [first])
    lake = run_facts(spark, tmp_path, topic)
    for k in range(1, 4):
        other = (json.dumps({"payload": {"op": "c", "before": None, "after": activity(k + 1, 7)}}), "facts", 0, k, None)
        run_facts(spark, tmp_path, land(spark, tmp_path, [first, other]))
    sent = spark.read.parquet(f"{lake}/notifications")
    assert rows(sent, "id_evenement_sport") == [(1,), (2,), (3,), (4,)]
    assert rows(consumed_table(lake).rows(spark)) == [("facts", 0, 0, 3)]


def test_rows_and_files_read_per_batch_are_flat(spark, tmp_path):
    """Eight lots of new activities of the same staff: the kept rows a batch reads stay what they were."""
    lake, read, folders = f"{tmp_path}/lake", [], []
    latest, pairs = facts.last_table(lake, 5), facts.pair_table(lake, 5)
    for lot in range(8):
        made = [activity(lot * 5 + i, i) for i in range(5)]
        messages = [(json.dumps({"payload": {"op": "c", "before": None, "after": a}}), "facts", 0, a["id_evenement_sport"], None) for a in made]
        topic = land(spark, tmp_path, messages)
        new = spark.createDataFrame([(a["id_evenement_sport"], a["salarie_id"]) for a in made], "id_evenement_sport bigint, salarie_id bigint")
        rows_read = latest.rows(spark, latest.touched(new)).count() + pairs.rows(spark, pairs.touched(new)).count()
        read.append(rows_read)
        if lot in (1, 3, 7):
            run_facts(spark, tmp_path, topic, compact_fan=2)
            folders.append(len(units(spark, f"{lake}/facts")))
    assert read[4] <= 10 and read[7] <= 10
    assert max(folders) <= 6
    assert rows(facts.stored_wellbeing(spark, lake), "salarie_id", "nb_activites") == [(i, 8) for i in range(5)]


# --- the bonus ----------------------------------------------------------------------------


def run_bonus(spark, folder, lots, incomes, **options):
    for lot in lots:
        df = spark.createDataFrame(lot, POSITIONS).withColumn("ts", F.to_timestamp("ts"))
        df.coalesce(1).write.mode("append").parquet(f"{folder}/topic")
    state.run_state_stream(
        read_change_stream(spark, FileTopic(f"{folder}/topic", df.schema), files_per_trigger=1), IMAGE, from_image,
        P.RULES, f"{folder}/lake", f"{folder}/offsets", at=F.col("ts"), trigger=ONCE, incomes=incomes,
        as_of_year=2026, width=3, **options,
    ).awaitTermination()
    return f"{folder}/lake"


def random_moves(seed, people=9, lots=3):
    """Creations, flips, updates without one, deletions and rehires; some changes come one lot late."""
    chance, now, late, out, offset = random.Random(seed), {}, [], [], 0
    for lot in range(lots):
        made = late
        late = []
        for k in range(people):
            for step in range(chance.randrange(3)):
                day = f"2026-{1 + lot * 2:02d}-{1 + 9 * step + k % 8:02d}"
                old, new = now.get(k), employee(k, chance.choice((100, 90_000)))
                if old is not None and chance.random() < 0.2:
                    new = None
                op = "c" if old is None else "u" if new else "d"
                message = change(op, old, new, "a", 0, offset, day)
                offset += 1
                now[k] = new
                (late if chance.random() < 0.1 else made).append(message)
        out.append(made)
    return [lot for lot in [*out, late] if lot]


@pytest.mark.parametrize("seed,every", [(1, 1), (2, 2)])
def test_bonus_by_deltas_equals_the_bonus_of_all_intervals(spark, tmp_path, seed, every):
    incomes = spark.createDataFrame([(k, 1000.0 * (k + 1)) for k in range(9)], "id_salarie bigint, salaire_brut double")
    lake = run_bonus(spark, str(tmp_path), random_moves(seed), incomes, refresh_every=every)
    silver = state.stored_intervals(spark, lake)
    want = rows(annual_bonus(silver, incomes, P.RULES, 2026))
    newest = versions(spark, f"{lake}/gold_bonus")[-1]
    assert rows(spark.read.parquet(f"{lake}/gold_bonus/version={newest}")) == want


def test_a_failed_bonus_refresh_is_made_up_for(spark, tmp_path, monkeypatch):
    incomes = spark.createDataFrame([(k, 1000.0) for k in range(9)], "id_salarie bigint, salaire_brut double")
    real, calls = state.days_table, []

    class Broken:
        def __init__(self, table):
            self.table = table

        def replace(self, *args):
            calls.append(1)
            self.table.replace(*args)
            if len(calls) == 2:
                # After the sums were written, before the open intervals were.
                raise OSError("no disk")

        def __getattr__(self, name):
            return getattr(self.table, name)

    monkeypatch.setattr(state, "days_table", lambda *args: Broken(real(*args)))
    lake = run_bonus(spark, str(tmp_path), random_moves(3), incomes)
    monkeypatch.undo()
    want = rows(annual_bonus(state.stored_intervals(spark, lake), incomes, P.RULES, 2026))
    newest = versions(spark, f"{lake}/gold_bonus")[-1]
    assert rows(spark.read.parquet(f"{lake}/gold_bonus/version={newest}")) == want
    assert read_batches(spark, f"{lake}/gold_errors", batches.ERRORS).count() == 1


def test_untouched_employees_are_not_read(spark, tmp_path):
    incomes = spark.createDataFrame([(k, 1000.0) for k in range(40)], "id_salarie bigint, salaire_brut double")
    first = [change("c", None, employee(k, 100), "a", 0, k, "2026-01-01") for k in range(40)]
    second = [change("u", employee(4, 100), employee(4, 90_000), "a", 0, 40, "2026-03-01")]
    lake = run_bonus(spark, str(tmp_path), [first, second], incomes)
    table = state.open_table(lake, 3)
    held = table.state(spark)[1]["buckets"]
    # Of fourteen buckets the second batch rewrote one.
    newest = max(held.values())
    assert len(held) == 14 and [b for b, e in held.items() if e == newest] == [1]


# --- dead letters -------------------------------------------------------------------------


def test_single_bad_messages_are_found_and_can_come_again(spark, tmp_path):
    """Two messages of a batch are rejected, all others are stored; once mended, the dead letters give the rest."""
    lot = [change("c", None, employee(k, 100, "curse" if k in (7, 29) else "Marche/running"), "ab"[k % 2], k % 3, k, "2026-01-01") for k in range(40)]

    def strict(people):
        checked = people.withColumn("bad", F.col("moyen_deplacement") == "curse")
        if not checked.where("bad").isEmpty():
            raise batches.Rejected("cannot tell what a curse is")
        return from_image(people)

    def run(evaluate):
        state.run_state_stream(
            read_change_stream(spark, topic), IMAGE, evaluate, P.RULES, f"{tmp_path}/lake", f"{tmp_path}/offsets",
            at=F.col("ts"), trigger=ONCE,
        ).awaitTermination()

    df = spark.createDataFrame(lot, POSITIONS).withColumn("ts", F.to_timestamp("ts"))
    df.coalesce(1).write.parquet(f"{tmp_path}/topic")
    topic, lake = FileTopic(f"{tmp_path}/topic", df.schema), f"{tmp_path}/lake"
    run(strict)
    dead = spark.read.parquet(f"{lake}/dead_letter")
    assert sorted(rows(dead, "offset", "error")) == [(7, "cannot tell what a curse is"), (29, "cannot tell what a curse is")]
    assert state.stored_intervals(spark, lake).count() == 38
    assert batches.readmit(spark, lake, topic.path, df.schema) == 2
    run(from_image)
    assert state.stored_intervals(spark, lake).count() == 40
    # They are landed once.
    assert batches.readmit(spark, lake, topic.path, df.schema) == 0


def test_a_cause_outside_single_messages_ends_the_search(spark):
    batch = spark.createDataFrame([("v", "t", 0, k) for k in range(64)], "value string, topic string, partition int, offset bigint")
    tried = []

    def never(part):
        tried.append(1)
        raise batches.Rejected("never")

    found = batches.blamed(batch, never, "at first", patience=4)
    assert len(tried) <= 6
    offsets = sorted(o for (_, _, a, b), _ in found for o in range(a, b + 1))
    assert offsets == list(range(64))
