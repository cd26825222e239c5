"""Activity inserts: notifications, their errors, facts and wellbeing days."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from kadence.operators.changes import (
    batch_offset_ranges,
    changes_of,
    decode,
    dedupe_redelivered,
    dedupe_redelivered_stream,
    first_delivery,
    malformed_of,
    route_fact_inserts,
    without_text,
)
from kadence.operators.gold import sort_gold, wellbeing_from_counts
from kadence.operators.notify import activity_measures, build_messages, message_errors
from kadence.operators.quality import failed_rows, shipped_suites
from kadence.rules import Rules
from kadence.schemas import ACTIVITY_IMAGE
from kadence.sinks.compaction import FAN
from kadence.sinks.kept import WIDTH, KeptTable, bucket_of
from kadence.sinks.tables import (
    export_copy,
    notification_table,
    overwrite_table,
    read_batches,
    read_table,
    spooled,
    units,
)
from kadence.streaming.batches import BatchWriter, SettledQuery, gold_error_row, guarded
from kadence.workspace import remove

# Every change of an activity: what counts is the last one of an id.
FACT_LOG = T.StructType(
    [
        T.StructField("op", T.StringType()),
        *ACTIVITY_IMAGE.fields,
        T.StructField("at_us", T.LongType()),
        T.StructField("topic", T.StringType()),
        T.StructField("partition", T.IntegerType()),
        T.StructField("offset", T.LongType()),
    ]
)
TOUCHED = T.StructType(
    [T.StructField("salarie_id", T.LongType()), T.StructField("annee", T.IntegerType())]
)
GOLD = T.StructType(
    [
        *TOUCHED.fields,
        T.StructField("nb_activites", T.LongType()),
        T.StructField("est_eligible", T.BooleanType()),
        T.StructField("nb_jour_bien_etre", T.IntegerType()),
    ]
)
FACT_COLUMNS = ACTIVITY_IMAGE.fieldNames()
ORDER = ("at_us", "topic", "partition", "offset")


def activity_rows(decoded: DataFrame) -> DataFrame:
    """Inserted activities of decoded messages, with their measures."""
    return activity_measures(route_fact_inserts(changes_of(decoded)).select("after.*"))


def fact_changes(decoded: DataFrame, at: Column) -> DataFrame:
    """Log rows of snapshot reads, inserts, updates and deletions; a deletion keeps the old image."""
    changes = changes_of(decoded).filter(F.col("op").isin("r", "c", "u", "d"))
    image = F.when(F.col("op") == "d", F.coalesce("before", "after")).otherwise(F.col("after"))
    rows = changes.withColumns({"image": image, "at_us": F.unix_micros(at)})
    return rows.filter(F.col("image.id_evenement_sport").isNotNull()).select("op", "image.*", *ORDER)


def _timed(images: DataFrame) -> DataFrame:
    return images.withColumn("date_fin_activite", F.timestamp_micros("date_fin_activite"))


def current_facts(log: DataFrame) -> DataFrame:
    """Stored activities: the last change of each id, without deleted ones.

    A message that comes again changes nothing, in whichever batch it comes.
    """
    once = first_delivery(log, "id_evenement_sport", "at_us")
    last = once.groupBy("id_evenement_sport").agg(
        F.max_by(F.struct("op", *FACT_COLUMNS[1:]), F.struct(*ORDER)).alias("last")
    )
    kept = last.filter(F.col("last.op") != "d").select("id_evenement_sport", "last.*")
    return _timed(kept.drop("op"))


#: Which pair an activity counts for: that of its employee and the year of its end.
LAST = T.StructType([*FACT_LOG.fields])
PAIRS = T.StructType([*TOUCHED.fields, T.StructField("nb_activites", T.LongType())])


def last_table(root: str, width: int = WIDTH) -> KeptTable:
    """The last change of each activity, deletions included, so that an older one is known to be older."""
    return KeptTable(f"{root}/last_change", LAST, bucket_of("id_evenement_sport", width))


def pair_table(root: str, width: int = WIDTH) -> KeptTable:
    """Activities per employee and year."""
    return KeptTable(f"{root}/pair_counts", PAIRS, bucket_of("salarie_id", width))


def last_changes(log: DataFrame) -> DataFrame:
    """The last change of each activity; changes combine before the shuffle."""
    rest = [c for c in LAST.fieldNames() if c != "id_evenement_sport"]
    last = log.groupBy("id_evenement_sport").agg(
        F.max_by(F.struct(*rest), F.struct(*ORDER)).alias("last")
    )
    return last.select("id_evenement_sport", "last.*").select(*LAST.fieldNames())


def pair_deltas(before: DataFrame, after: DataFrame) -> DataFrame:
    """Change of activities per employee and year between two states of the same activities."""

    def counted(state: DataFrame, by: int) -> DataFrame:
        rows = _timed(state.where(F.col("op") != "d"))
        pairs = rows.select("salarie_id", F.year("date_fin_activite").alias("annee"), F.lit(by).alias("by"))
        return pairs.where(F.col("salarie_id").isNotNull() & F.col("annee").isNotNull())

    both = counted(before, -1).unionByName(counted(after, 1))
    return both.groupBy(*TOUCHED.fieldNames()).agg(F.sum("by").alias("by"))


def run_fact_stream(
    stream: DataFrame,
    employees: DataFrame,
    templates: DataFrame,
    rules: Rules,
    root: str,
    checkpoint: str,
    *,
    at: Column | None = None,
    refresh_every: int = 1,
    after_refresh: Callable[[DataFrame, BatchWriter, str], None] | None = None,
    dedupe_on: tuple[str, str] | None = None,
    width: int = WIDTH,
    compact_fan: int | None = FAN,
    trigger: dict | None = None,
    name: str = "activities",
) -> SettledQuery:
    """Start the job. ``root`` holds its tables; offsets live in ``checkpoint``.

    Every change of an activity is logged, once: messages whose offsets an earlier batch took are left out.
    Inserts are notified; the product counts what is stored. The last change of each activity is kept in
    buckets (of ``width`` neighbouring ids), and so are counts per employee and year: a batch reads and rewrites the
    buckets it touches, takes what its activities counted for before and adds what they count for now, so
    snapshot rows count, deleted ones stop counting, and the log is not read again. After every
    ``refresh_every`` batches the product is published from the counts, a row per employee and year; a failed,
    skipped or rejected refresh is so made up for by the next one, and by ``awaitTermination`` of a
    query that ends. ``after_refresh`` runs then, for instance to refresh the other product. ``at`` is the time of a
    change, which orders the changes of an id before topic, partition and offset; by default that of its
    batch. ``dedupe_on`` (time column, span) drops copies before they reach a batch. Tables of earlier
    epochs are compacted by ``compact_fan`` folders.
    """

    def work(batch: DataFrame, writer: BatchWriter) -> None:
        spark = batch.sparkSession
        time = F.current_timestamp() if at is None else at
        # Rows of a batch are many: what several tables need is read from files, and nothing of it stays in memory.
        spool = f"{root}/_decoded"
        light = without_text(decode(dedupe_redelivered(batch), ACTIVITY_IMAGE))
        try:
            decoded = spooled(light, spool)
            rows = activity_rows(decoded)
            messages = build_messages(rows, employees, templates)
            errors = message_errors(rows, employees, templates, time)
            bad = malformed_of(decoded)
            writer.write("malformed", bad.select("value", "topic", "partition", "offset"))
            changes = writer.written("facts", fact_changes(decoded, time))
            writer.write("notifications", notification_table(messages, time))
            errors = writer.written("notification_errors", errors)
            batch_id = batch_offset_ranges(
                decoded, F.unix_millis(F.current_timestamp())
            ).first()["batch_id"]
            suite = shipped_suites()["notification_errors"]
            writer.write("quality", failed_rows(errors, suite, batch_id, "notification_errors"))
            _count(spark, writer, changes, width)
        finally:
            remove(spark, spool)
        if writer.epoch_id % refresh_every == refresh_every - 1:
            writer.then(lambda: refresh(batch, writer, batch_id))

    def refresh(batch: DataFrame, writer: BatchWriter, batch_id: str) -> None:
        try:
            refresh_wellbeing_table(batch.sparkSession, root, rules, width=width)
            reached["epoch"] = writer.epoch_id
        except Exception as error:
            gold_error_row(batch, root, writer.epoch_id, batch_id, str(error))
        if after_refresh is not None:
            after_refresh(batch, writer, batch_id)

    # The epoch of this run's last good refresh.
    spark, reached = stream.sparkSession, {"epoch": -1}
    if dedupe_on:
        stream = dedupe_redelivered_stream(stream, *dedupe_on)
    query = stream.writeStream.queryName(name).option("checkpointLocation", checkpoint)
    if trigger:
        query = query.trigger(**trigger)
    started = query.foreachBatch(guarded(root, work, compact_fan=compact_fan)).start()

    def finish() -> None:
        """After the last batch of a query that ends: what later batches than the last refresh brought."""
        epochs = [u.last for u in units(spark, f"{root}/facts")]
        if not epochs or epochs[-1] <= reached["epoch"]:
            return
        try:
            refresh_wellbeing_table(spark, root, rules, width=width)
        except Exception as error:
            gold_error_row(stream, root, epochs[-1], "settled", str(error))

    return SettledQuery(started, finish)


def _count(spark: SparkSession, writer: BatchWriter, changes: DataFrame, width: int) -> None:
    """Bring last changes and pair counts up to a batch: what its activities counted for goes, what they do comes."""
    latest, pairs = last_table(writer.root, width), pair_table(writer.root, width)
    # By the position that a log row carries, the kept row may well be the later one.
    buckets = latest.touched(changes)
    before = latest.rows(spark, buckets, before=writer.epoch_id)
    after = writer.held(latest, last_changes(before.unionByName(changes)), buckets)
    # All of a bucket is counted: what the batch leaves as it is goes and comes, so no ids are matched.
    changed = pair_deltas(before, after).where(F.col("by") != 0).persist()
    try:
        buckets = pairs.touched(changed)
        counted = pairs.rows(spark, buckets, before=writer.epoch_id).withColumnRenamed("nb_activites", "by")
        total = counted.unionByName(changed).groupBy(*TOUCHED.fieldNames()).agg(F.sum("by").alias("nb_activites"))
        writer.keep(pairs, total.where(F.col("nb_activites") != 0), buckets)
    finally:
        changed.unpersist()


def stored_facts(spark: SparkSession, root: str) -> DataFrame:
    """Activities as they stand after all batches."""
    kept = last_table(root).rows(spark).where(F.col("op") != "d")
    return _timed(kept.select(*FACT_COLUMNS))


def stored_wellbeing(spark: SparkSession, root: str) -> DataFrame:
    """The product as of its last refresh."""
    return read_table(spark, f"{root}/gold_wellbeing", GOLD)


def refresh_wellbeing_table(spark: SparkSession, root: str, rules: Rules, *, width: int = WIDTH) -> None:
    """Publish the product from the counts so far, with a copy for reporting tools."""
    fresh = wellbeing_from_counts(pair_table(root, width).rows(spark), rules)
    overwrite_table(sort_gold(fresh, "salarie_id"), f"{root}/gold_wellbeing")
    export_copy(stored_wellbeing(spark, root), f"{root}/export/gold_wellbeing")
