"""Employee changes: bronze, history, incoherences and registry in one micro-batch."""

from __future__ import annotations

from datetime import UTC, datetime
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from kadence.functions.scalars import days_between, end_of_year
from kadence.operators.changes import (
    LAKE_FIELDS,
    batch_offset_ranges,
    changes_of,
    decode,
    dedupe_redelivered,
    dedupe_redelivered_stream,
    drop_pii,
    first_delivery,
    malformed_of,
    route_state_changes,
    to_bronze,
)
from kadence.operators.gold import bonus_of_days, eligible_days, sort_gold
from kadence.operators.history import scd2_intervals, state_log
from kadence.operators.quality import failed_rows, quality_gate, shipped_suites
from kadence.operators.registry import registry_from_log
from kadence.plans.commute import Evaluate, evaluated_images
from kadence.rules import Rules
from kadence.sinks.compaction import FAN
from kadence.sinks.kept import WIDTH, KeptTable, bucket_of
from kadence.sinks.tables import (
    append_batch,
    export_copy,
    is_non_empty,
    overwrite_table,
    read_batches,
    units,
)
from kadence.streaming.batches import BatchWriter, SettledQuery, gold_error_row, guarded
from kadence.workspace import checkpointed

POSITIONED = ("value", "topic", "partition", "offset")

STATE_LOG = T.StructType(
    [
        T.StructField("id_salarie", T.LongType()),
        T.StructField("est_eligible_prime_annuel", T.BooleanType()),
        T.StructField("valid_from", T.TimestampType()),
        T.StructField("kind", T.StringType()),
        T.StructField("at_us", T.LongType()),
        T.StructField("topic", T.StringType()),
        T.StructField("partition", T.IntegerType()),
        T.StructField("offset", T.LongType()),
    ]
)
# Offsets restart per partition and topic, so a change is ordered by its time first and known by
# its full position.
IDENTITY = ("topic", "partition", "offset")
ORDER = ("at_us", *IDENTITY)
REGISTRY_LOG = T.StructType(
    [
        T.StructField("id_salarie", T.LongType()),
        T.StructField("event", T.StringType()),
        T.StructField("at", T.TimestampType()),
    ]
)
INCOHERENCES = T.StructType(
    [
        T.StructField("id_salarie", T.LongType()),
        T.StructField("raison_incoherence", T.StringType()),
        T.StructField("timestamp", T.TimestampType()),
    ]
)


def run_state_stream(
    stream: DataFrame,
    image: T.StructType,
    evaluate: Evaluate,
    rules: Rules,
    root: str,
    checkpoint: str,
    *,
    at: Column | None = None,
    initial_valid_from: Column | None = None,
    lake_fields: tuple[str, ...] | None = LAKE_FIELDS,
    log_all_incoherences: bool = False,
    gate: bool = False,
    incomes: DataFrame | None = None,
    as_of_year: int | None = None,
    refresh_every: int = 1,
    dedupe_on: tuple[str, str] | None = None,
    width: int = WIDTH,
    compact_fan: int | None = FAN,
    trigger: dict | None = None,
    name: str = "state_changes",
) -> SettledQuery:
    """Start the job. ``root`` holds its tables; offsets live in ``checkpoint``.

    ``at`` is the time of a change, by default the time of its batch; changes of a key are ordered
    by it, then by topic, partition and offset. ``evaluate`` adds ``distance_m, reason`` to images.
    ``lake_fields=None`` keeps full images in bronze. With ``gate`` rows that fail their suite go to
    ``quarantine`` instead of their table, by default they are only reported. With ``incomes`` the
    bonus product is refreshed every ``refresh_every`` batches, for ``as_of_year`` or the current
    year, from interval sums that are kept per employee (in buckets of ``width`` neighbouring ids) and moved on by
    what a batch opens and closes; what no refresh has covered is made up for by the next one, and by
    ``awaitTermination`` of a query that ends. A message that comes again, after any time, counts for nothing;
    ``dedupe_on`` (time column, span) drops it before it reaches a batch. Tables of earlier epochs are
    compacted by ``compact_fan`` folders.
    """

    def work(batch: DataFrame, writer: BatchWriter) -> None:
        time = F.current_timestamp() if at is None else at
        # A refresh may have read this batch's log already when it is rejected.
        writer.kept += [open_table(root, width), days_table(root, width)]
        # Decoded once; five tables are cut from it.
        decoded = decode(dedupe_redelivered(batch), image).persist()
        judged = None
        try:
            writer.write("malformed", malformed_of(decoded).select(*POSITIONED))
            changes = changes_of(decoded)
            lake = changes if lake_fields is None else drop_pii(changes, lake_fields)
            writer.write("bronze", to_bronze(lake, time))
            batch_id = batch_offset_ranges(
                decoded, F.unix_millis(F.current_timestamp())
            ).first()["batch_id"]
            judged = evaluated_images(
                route_state_changes(changes), evaluate, rules, log_all=log_all_incoherences
            ).persist()
            _write_layers(judged, writer, batch_id, time, initial_valid_from, gate)
        finally:
            decoded.unpersist()
            if judged is not None:
                judged.unpersist()
        if incomes is not None and writer.epoch_id % refresh_every == 0:
            writer.then(lambda: refresh(batch, writer, batch_id))

    def year() -> int:
        return as_of_year or datetime.now(UTC).year

    def refresh(batch: DataFrame, writer: BatchWriter, batch_id: str) -> None:
        """A product that cannot be refreshed is recorded and made up for by the next; the changes are stored."""
        try:
            failures = refresh_bonus(
                batch.sparkSession, root, incomes, rules, year(), batch_id, writer.epoch_id, width=width
            )
            if failures is not None:
                writer.write("gold_quality", failures)
            reached["epoch"] = writer.epoch_id
        except Exception as error:
            gold_error_row(batch, root, writer.epoch_id, batch_id, str(error))

    def settle() -> None:
        """After the last batch of a query that ends: what later batches than the last refresh brought."""
        epochs = [u.last for u in units(spark, f"{root}/state_log")]
        if incomes is None or not epochs or epochs[-1] <= reached["epoch"]:
            return
        try:
            failures = refresh_bonus(spark, root, incomes, rules, year(), "settled", width=width)
            if failures is not None:
                append_batch(failures, f"{root}/gold_quality", epochs[-1])
        except Exception as error:
            gold_error_row(stream, root, epochs[-1], "settled", str(error))

    # The epoch of this run's last good refresh.
    spark, reached = stream.sparkSession, {"epoch": -1}

    if dedupe_on:
        stream = dedupe_redelivered_stream(stream, *dedupe_on)
    query = stream.writeStream.queryName(name).option("checkpointLocation", checkpoint)
    if trigger:
        query = query.trigger(**trigger)
    started = query.foreachBatch(guarded(root, work, compact_fan=compact_fan)).start()
    return SettledQuery(started, settle)


def _write_layers(
    judged: DataFrame,
    writer: BatchWriter,
    batch_id: str,
    time: Column,
    initial_valid_from: Column | None,
    gate: bool,
) -> None:
    keyed = judged.withColumns(
        {
            "id_salarie": F.coalesce("after.id_salarie", "before.id_salarie"),
            "ts": time,
            "at_us": F.unix_micros(time),
        }
    )
    log = state_log(keyed, initial_valid_from=initial_valid_from, order=ORDER)
    incoherences = keyed.filter(F.col("reason").isNotNull()).select(
        "id_salarie", F.col("reason").alias("raison_incoherence"), F.col("ts").alias("timestamp")
    )
    event = F.when(F.col("route") == "created", F.lit("insert")).otherwise(F.lit("delete"))
    registry = keyed.filter(F.col("route").isin("created", "deleted")).select(
        "id_salarie", event.alias("event"), F.col("ts").alias("at")
    )
    suites = shipped_suites()
    # An opening is checked as the interval it starts; a closing carries no state to check.
    opened = log.filter(F.col("kind") == "open").withColumns(
        {"date_debut": F.col("valid_from"), "duree": F.lit(None).cast("int")}
    )
    is_insert = F.col("event") == "insert"
    checked = [
        ("silver_new", opened, "state_log"),
        ("incoherences", incoherences, "incoherences"),
        ("registry_insert", registry.filter(is_insert), "registry_log"),
        ("registry_delete", registry.filter(~is_insert), "registry_log"),
    ]
    report = [failed_rows(df, suites[name], batch_id, name) for name, df, _ in checked]
    failures = reduce(DataFrame.unionByName, report)
    writer.write("quality", failures)
    kept = {"state_log": [log.filter(F.col("kind") != "open")], "incoherences": [], "registry_log": []}
    for name, df, table in checked:
        passing = quality_gate(df, suites[name])[0] if gate else df
        kept[table].append(passing)
    if gate:
        writer.write("quarantine", failures)
    columns = {"state_log": log.columns, "incoherences": incoherences.columns, "registry_log": registry.columns}
    for table, parts in kept.items():
        writer.write(table, reduce(DataFrame.unionByName, (p.select(columns[table]) for p in parts)))


def open_table(root: str, width: int = WIDTH) -> KeptTable:
    """The newest log row of each employee: the interval that is open, or where history has ended."""
    return KeptTable(f"{root}/open_state", STATE_LOG, bucket_of("id_salarie", width))


DAYS = T.StructType(
    [
        T.StructField("id_salarie", T.LongType()),
        T.StructField("annee", T.IntegerType()),
        T.StructField("est_eligible_prime_annuel", T.BooleanType()),
        T.StructField("duree", T.DoubleType()),
    ]
)


def days_table(root: str, width: int = WIDTH) -> KeptTable:
    """Days of closed intervals per employee, year of the end, and flag."""
    return KeptTable(f"{root}/closed_days", DAYS, bucket_of("id_salarie", width))


def advance_days(
    spark: SparkSession, root: str, epoch_id: int | None = None, *, width: int = WIDTH
) -> DataFrame | None:
    """Bring open intervals and closed days up to an epoch of the log, by default its newest.

    Reads the log since the epoch they cover, and their buckets that it touches. The kept row of an employee and
    the new ones form a chain: what lies between two of its rows is closed by now and adds its days. An
    employee with a row older than the kept one, which comes late, is summed anew from the whole log.
    Rows without an employee count for nobody. Returns the intervals of the chains, persisted; None if
    there is no log.
    """
    epochs = [u.last for u in units(spark, f"{root}/state_log")]
    if not epochs:
        return None
    reached = epochs[-1] if epoch_id is None else epoch_id
    opened, days = open_table(root, width), days_table(root, width)
    covered, _ = opened.state(spark, reached)
    # The open intervals are written last; sums beyond them stem from a run that failed.
    days.take_back(spark, covered + 1)
    known = F.col("id_salarie").isNotNull()
    log = read_batches(spark, f"{root}/state_log", STATE_LOG, covered + 1).where(known)
    # Persisted only: all of it can be computed again from what is stored.
    new = first_delivery(log, "id_salarie", "at_us").persist()
    buckets = opened.touched(new)
    ids = new.groupBy("id_salarie").agg(F.min(F.struct(*ORDER)).alias("earliest"))
    kept = opened.rows(spark, buckets, before=reached)
    held = kept.join(ids, "id_salarie")
    late = held.where(F.col("earliest") < F.struct(*ORDER)).select("id_salarie").persist()
    # A copy of the kept row itself is no late one.
    chain = held.drop("earliest").unionByName(new)
    summed = days.rows(spark, buckets)
    if late.isEmpty():
        base = summed
    else:
        base = summed.join(late, "id_salarie", "left_anti")
        everything = stored_log(spark, root).join(late, "id_salarie", "left_semi")
        chain = chain.join(late, "id_salarie", "left_anti").unionByName(everything)
    chain = first_delivery(chain, "id_salarie", "at_us").persist()
    intervals = scd2_intervals(chain, order=ORDER).persist()
    closed = intervals.where(F.col("date_fin").isNotNull())
    # Without open ends the year they would be filled up to plays no part.
    fresh = eligible_days(closed, 1970)
    total = base.unionByName(fresh.select(DAYS.fieldNames())).groupBy(*DAYS.fieldNames()[:3]).agg(
        F.sum("duree").alias("duree")
    )
    days.replace(total, buckets, reached)
    rest = [c for c in STATE_LOG.fieldNames() if c != "id_salarie"]
    newest = chain.groupBy("id_salarie").agg(F.max_by(F.struct(*rest), F.struct(*ORDER)).alias("last"))
    newest = newest.select("id_salarie", "last.*").select(STATE_LOG.fieldNames())
    untouched = kept.join(ids, "id_salarie", "left_anti")
    opened.replace(untouched.unionByName(newest), buckets, reached)
    for frame in (new, late, chain):
        frame.unpersist()
    return intervals


def bonus_from_days(
    spark: SparkSession, root: str, incomes: DataFrame, rules: Rules, year: int, *, width: int = WIDTH
) -> DataFrame:
    """The bonus of every employee: closed days, and open intervals up to the end of ``year``."""
    last = open_table(root, width).rows(spark).where(F.col("kind") == "open")
    still = last.select(
        "id_salarie", "est_eligible_prime_annuel", F.col("valid_from").alias("date_debut"),
        F.lit(None).cast("timestamp").alias("date_fin"),
    )
    days = days_table(root, width).rows(spark).unionByName(eligible_days(still, year).select(DAYS.fieldNames()))
    summed = days.groupBy(*DAYS.fieldNames()[:3]).agg(F.sum("duree").alias("duree"))
    return bonus_of_days(summed, incomes, rules)


def refresh_bonus(
    spark: SparkSession,
    root: str,
    incomes: DataFrame,
    rules: Rules,
    year: int,
    batch_id: str,
    epoch_id: int | None = None,
    *,
    width: int = WIDTH,
) -> DataFrame | None:
    """Replace the bonus table from the history so far; None while there is no history.

    History is not read again: interval sums are brought up to the log's newest epoch (or ``epoch_id``), and
    what is left is a row per employee, year and flag. Returns the failures of the suites: the intervals that
    opened or closed since the last refresh are checked before and after open ones are filled, the
    product as it is written.
    """
    silver = advance_days(spark, root, epoch_id, width=width)
    if silver is None:
        return None
    suites = shipped_suites()
    end = F.coalesce("date_fin", end_of_year(year))
    filled = silver.withColumns({"date_fin": end, "duree": days_between(F.col("date_debut"), end)})
    gold = checkpointed(bonus_from_days(spark, root, incomes, rules, year, width=width))
    if not is_non_empty(gold):
        return None
    overwrite_table(sort_gold(gold, "id_salarie"), f"{root}/gold_bonus")
    export_copy(gold, f"{root}/export/gold_bonus")
    checked = {"silver_before_fill": silver, "silver_after_fill": filled, "gold_bonus": gold}
    return reduce(
        DataFrame.unionByName,
        (failed_rows(df, suites[name], batch_id, name) for name, df in checked.items()),
    )


def stored_log(spark: SparkSession, root: str) -> DataFrame:
    """The state log; a change that was delivered in two batches counts once."""
    log = read_batches(spark, f"{root}/state_log", STATE_LOG)
    return first_delivery(log, "id_salarie", "at_us")


def stored_intervals(spark: SparkSession, root: str, **options) -> DataFrame:
    """History so far, as intervals."""
    return scd2_intervals(stored_log(spark, root), order=ORDER, **options)


def stored_registry(spark: SparkSession, root: str) -> DataFrame:
    return registry_from_log(read_batches(spark, f"{root}/registry_log", REGISTRY_LOG))
