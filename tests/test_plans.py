"""Physical plans: what is read, shuffled and spread."""

import re

import pytest
from pyspark.sql import functions as F

from kadence.operators.gold import refresh_wellbeing, touched_keys, yearly_activity_eligibility
from kadence.operators.notify import enrich_identity
from kadence.plans.queries import QUERIES
from kadence.plans.views import Views
from kadence.rules import Rules


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


# The others return what a job has stored.
STORED = ("stream_", "sink_", "scan_", "quality_table", "layer_counts", "road_graph")
PLAIN = sorted(q for q in QUERIES if not q.startswith(STORED))


@pytest.mark.parametrize("name", PLAIN)
def test_no_query_pairs_everything_with_everything(spark, name):
    text = plan(QUERIES[name](spark, "/root/testdata/sf0.001"))
    assert "CartesianProduct" not in text
    assert "BroadcastNestedLoopJoin" not in text


def test_only_needed_columns_are_read(spark, sf_dir):
    text = plan(QUERIES["wellbeing_days"](spark, sf_dir))
    schemas = re.findall(r"ReadSchema: struct<([^>]*)>", text)
    assert [sorted(c.split(":")[0] for c in s.split(",")) for s in schemas] == [
        ["event_id", "ts", "user_id"]
    ]


def test_counts_are_combined_before_the_shuffle(spark, sf_dir):
    text = plan(QUERIES["wellbeing_days"](spark, sf_dir))
    assert text.count("Exchange hashpartitioning") == 1
    assert "partial_count" in text


def test_history_needs_one_shuffle(spark, sf_dir):
    """Before images, the log and the intervals share a partitioning by employee."""
    text = plan(QUERIES["scd2_intervals"](spark, sf_dir))
    assert text.count("Exchange hashpartitioning") == 1


def test_refresh_counts_before_it_matches(spark, sf_dir):
    activities = Views(spark, sf_dir).fx_activity
    gold = yearly_activity_eligibility(activities, Rules())
    with_conf = {"spark.sql.autoBroadcastJoinThreshold": "-1"}
    old = {k: spark.conf.get(k) for k in with_conf}
    try:
        for k, x in with_conf.items():
            spark.conf.set(k, x)
        text = plan(refresh_wellbeing(gold, activities, touched_keys(activities), Rules()))
    finally:
        for k, x in old.items():
            spark.conf.set(k, x)
    # Nothing but partial counts and distinct pairs is shuffled.
    for part in re.split(r"Exchange hashpartitioning[^\n]*\n", text)[1:]:
        assert part.strip(" :+-|").startswith("HashAggregate")


def test_join_splits_a_hot_employee(spark):
    """A third of all activities belongs to one employee: the join cuts that partition."""
    settings = {
        "spark.sql.autoBroadcastJoinThreshold": "-1",
        "spark.sql.adaptive.autoBroadcastJoinThreshold": "-1",
        "spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes": "20k",
        "spark.sql.adaptive.skewJoin.skewedPartitionFactor": "2",
        "spark.sql.adaptive.advisoryPartitionSizeInBytes": "20k",
        "spark.sql.adaptive.coalescePartitions.minPartitionSize": "1k",
    }
    old = {k: spark.conf.get(k, None) for k in settings}
    activities = spark.range(0, 90_000, 1, 8).select(
        F.when(F.col("id") % 3 == 0, F.lit(7)).otherwise(F.col("id")).alias("salarie_id"),
        F.col("id").alias("id_evenement_sport"),
    )
    staff = spark.range(60_000).select(
        F.col("id").alias("id_salarie"), F.lit("n").alias("nom"), F.lit("p").alias("prenom")
    )
    try:
        for k, x in settings.items():
            spark.conf.set(k, x)
        joined = enrich_identity(activities, staff)
        found = joined.collect()
        assert len(found) == 90_000
        assert sum(r["connu"] for r in found) > 30_000
        assert "skew=true" in plan(joined)
    finally:
        for k, x in old.items():
            if x is None:
                spark.conf.unset(k)
            else:
                spark.conf.set(k, x)


def test_addresses_that_appear_later_are_looked_up_once(spark):
    from kadence.plans.commute import evaluator
    from kadence.rules import Rules

    schema = (
        "address_key string, network string, lat double, lon double, geo_error string, "
        "linear_m double, road_m double, road_error string"
    )
    asked = []

    def lookup(wanted):
        asked.append(sorted(r["address_key"] for r in wanted.collect()))
        return wanted.selectExpr(
            "address_key", "network", "1d lat", "1d lon", "cast(null as string) geo_error",
            "900d linear_m", "1000d road_m", "cast(null as string) road_error",
        )

    evaluate = evaluator(spark.createDataFrame([], schema), Rules(), lookup)
    rows = [(1, "1 rue a", "Marche/running"), (2, None, "Marche/running"), (3, "2 rue b", "Marche/running")]
    people = "id_salarie int, adresse_domicile string, moyen_deplacement string"
    first = evaluate(spark.createDataFrame(rows[:2], people)).collect()
    second = evaluate(spark.createDataFrame(rows, people)).collect()
    assert asked == [["1 rue a"], ["2 rue b"]]
    assert {r["id_salarie"]: r["distance_m"] for r in first} == {1: 1000.0, 2: None}
    assert {r["id_salarie"]: r["distance_m"] for r in second} == {1: 1000.0, 2: None, 3: 1000.0}
