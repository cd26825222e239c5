"""What every micro-batch does: replayable writes, counts, dead letters."""

from __future__ import annotations

import logging
from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery

from kadence.sinks.compaction import FAN, compact
from kadence.sinks.kept import KeptTable
from kadence.sinks.tables import EPOCH, append_batch, exists, names_in, read_batches
from kadence.streaming.consumed import SOURCE, consumed_table, in_blocks, positions, unseen

log = logging.getLogger(__name__)

COUNTS = T.StructType(
    [T.StructField("dataset", T.StringType()), T.StructField("rows", T.LongType())]
)
ERRORS = T.StructType(
    [T.StructField("batch_id", T.StringType()), T.StructField("error", T.StringType())]
)
#: Pieces of a rejected batch that may fail one after the other before the rest is rejected as it is.
PATIENCE = 16


class BatchWriter:
    """Writes the tables of one batch, counts their rows, and can take them back."""

    def __init__(self, root: str, epoch_id: int):
        self.root, self.epoch_id = root, epoch_id
        self.counts: dict[str, Observation] = {}
        self.started: dict[str, T.StructType] = {}
        self.kept: list[KeptTable] = []

    def write(self, dataset: str, df: DataFrame) -> None:
        seen = Observation()
        counted = df.observe(seen, F.count(F.lit(1)).alias("rows"))
        self.started[dataset] = df.schema
        append_batch(counted, f"{self.root}/{dataset}", self.epoch_id)
        self.counts[dataset] = seen

    def written(self, dataset: str, df: DataFrame) -> DataFrame:
        """Write rows and give them as they are stored, so that what follows from them neither computes nor holds them."""
        self.write(dataset, df)
        return df.sparkSession.read.schema(df.schema).parquet(f"{self.root}/{dataset}/{EPOCH}={self.epoch_id}")

    def keep(self, table: KeptTable, df: DataFrame, touched: list[int], note: object = None) -> None:
        """Replace buckets of a kept table, as of this batch."""
        self.kept.append(table)
        table.replace(df, touched, self.epoch_id, note)

    def held(self, table: KeptTable, df: DataFrame, touched: list[int]) -> DataFrame:
        """Replace buckets of a kept table and give their rows as they are stored."""
        self.keep(table, df, touched)
        return table.rows(df.sparkSession, touched, before=self.epoch_id + 1)

    def then(self, act: Callable[[], None]) -> None:
        """Do what follows from a stored batch, such as refreshing a product."""
        act()

    def write_counts(self, df: DataFrame) -> None:
        """Rows per written table, counted while they were written."""
        rows = [(d, int(seen.get["rows"])) for d, seen in self.counts.items()]
        frame = df.sparkSession.createDataFrame(rows, COUNTS)
        append_batch(frame, f"{self.root}/counts", self.epoch_id)

    def take_back(self, df: DataFrame) -> None:
        """Leave none of a failed batch's rows behind."""
        for dataset, schema in self.started.items():
            empty = df.sparkSession.createDataFrame([], schema)
            append_batch(empty, f"{self.root}/{dataset}", self.epoch_id)
        for table in self.kept:
            table.take_back(df.sparkSession, self.epoch_id)


class Probe(BatchWriter):
    """Computes what a batch would write, and writes nothing."""

    def write(self, dataset: str, df: DataFrame) -> None:
        df.write.format("noop").mode("overwrite").save()

    def written(self, dataset: str, df: DataFrame) -> DataFrame:
        self.write(dataset, df)
        return df

    def keep(self, table: KeptTable, df: DataFrame, touched: list[int], note: object = None) -> None:
        pass

    def held(self, table: KeptTable, df: DataFrame, touched: list[int]) -> DataFrame:
        return df

    def then(self, act: Callable[[], None]) -> None:
        pass


def claim(spark: SparkSession, root: str) -> None:
    """Refuse tables of another query: its epochs have the same numbers and would be overwritten.

    A query keeps its identity with its checkpoint. If that is lost, start with a new root.
    """
    query = spark.sparkContext.getLocalProperty("sql.streaming.queryId")
    if exists(spark, f"{root}/_owner"):
        owner = spark.read.text(f"{root}/_owner").first()[0]
        if owner != query:
            raise ValueError(f"the tables in {root} belong to query {owner}, not {query}")
    else:
        spark.createDataFrame([(query,)], "value string").coalesce(1).write.text(f"{root}/_owner")


class Rejected(Exception):
    """Raised by work on a batch that will fail again however often it is tried."""


Work = Callable[[DataFrame, BatchWriter], None]
#: Offsets of a topic partition, both ends included.
Span = tuple[str, int, int, int]


def guarded(root: str, work: Work, *, once: bool = True, compact_fan: int | None = FAN):
    """A ``foreachBatch`` function that stores a batch, or stops the query before its offsets count.

    With ``once`` messages whose offsets were taken by an earlier batch are left out. If a batch is
    ``Rejected``, the messages to blame are found by halving its offsets and go to the dead letters, each
    with its reason, what the batch wrote is taken back, and the rest is worked on as if it had come alone.
    Any other failure, also of the dead letters themselves, is raised: Spark does not commit the
    offsets, and a restart delivers the batch again. Tables of earlier epochs are compacted by
    ``compact_fan`` folders; None leaves them as they are.
    """

    def process(batch: DataFrame, epoch_id: int) -> None:
        spark = batch.sparkSession
        claim(spark, root)
        if batch.isEmpty():
            return
        if compact_fan:
            # What has an epoch is appended; earlier epochs are committed and will not come again.
            if epoch_id % compact_fan == 0:
                for dataset in appended(spark, root):
                    compact(spark, f"{root}/{dataset}", epoch_id, fan=compact_fan)
        if not once:
            store_or_blame(batch, epoch_id, batch, None)
            return
        if exists(spark, f"{root}/consumed/_index"):
            raise ValueError(f"the consumed offsets in {root} are of an earlier form: start with a new root")
        taken = consumed_table(root)
        placed = positions(batch).persist()
        try:
            buckets = taken.touched(placed)
            earlier = taken.rows(spark, buckets, before=epoch_id)
            fresh = unseen(batch, earlier, placed)
            if fresh is not batch and fresh.isEmpty():
                return

            def keep(writer: BatchWriter, left_out: list[Span]) -> None:
                # What an earlier batch took is among the intervals already.
                stored = placed.where(~_inside(left_out, "first")) if left_out else placed
                writer.keep(taken, in_blocks(earlier, stored), buckets)

            store_or_blame(batch, epoch_id, fresh, keep)
        finally:
            placed.unpersist()

    def store_or_blame(
        batch: DataFrame, epoch_id: int, fresh: DataFrame, keep: Callable[[BatchWriter, list[Span]], None] | None
    ) -> None:
        writer = BatchWriter(root, epoch_id)

        def store(part: DataFrame, left_out: list[Span]) -> None:
            work(part, writer)
            if keep:
                keep(writer, left_out)
            writer.write_counts(batch)

        try:
            store(fresh, [])
        except Rejected as error:
            log.exception("batch %s is rejected", epoch_id)
            writer.take_back(batch)
            bad = blamed(fresh, lambda part: work(part, Probe(root, epoch_id)), str(error))
            if bad:
                letters = [fresh.where(_inside([span])).withColumn("error", F.lit(why)) for span, why in bad]
                dead_letter(reduce(DataFrame.unionByName, letters), f"{root}/dead_letter", epoch_id)
            spans = [span for span, _ in bad]
            rest = fresh.where(~_inside(spans))
            writer = BatchWriter(root, epoch_id)
            if not rest.isEmpty():
                try:
                    store(rest, spans)
                except Rejected as again:
                    # Messages that pass piece by piece and fail together.
                    writer.take_back(batch)
                    together = fresh.withColumn("error", F.lit(str(again)))
                    dead_letter(together, f"{root}/dead_letter", epoch_id)

    return process


def appended(spark: SparkSession, root: str) -> list[str]:
    """Names of the tables under ``root`` that grow by epochs."""
    kept = lambda name: exists(spark, f"{root}/{name}/_index")
    return [
        n for n in names_in(spark, root)
        if not n.startswith(("_", ".")) and not kept(n)
        and any(u.startswith("epoch_id=") for u in names_in(spark, f"{root}/{n}"))
    ]


def _inside(spans: list[Span], offset: str = "offset") -> Column:
    """Whether a message's position is in one of ``spans``."""
    inside = F.lit(False)
    for topic, partition, low, high in spans:
        at = F.col("topic").eqNullSafe(F.lit(topic)) & F.col("partition").eqNullSafe(F.lit(partition))
        if low is None:
            inside |= at & F.col(offset).isNull()
        else:
            inside |= F.coalesce(at & F.col(offset).between(low, high), F.lit(False))
    return inside


def _halves(spans: list[Span]) -> list[list[Span]]:
    if len(spans) > 1:
        return [spans[: len(spans) // 2], spans[len(spans) // 2 :]]
    topic, partition, low, high = spans[0]
    middle = (low + high) // 2
    return [[(topic, partition, low, middle)], [(topic, partition, middle + 1, high)]]


def blamed(
    batch: DataFrame, attempt: Callable[[DataFrame], None], reason: str, patience: int = PATIENCE
) -> list[tuple[Span, str]]:
    """Spans of messages that are rejected by themselves, with their reasons.

    Halves the offsets of the batch (two numbers per topic partition come to the driver) and tries the
    pieces, until a piece is one message. If ``patience`` pieces fail and none between them passes, the
    cause is not in single messages: what has failed and not been halved is blamed as it is.
    """
    ranges = batch.groupBy(*SOURCE).agg(F.min("offset"), F.max("offset")).orderBy(*SOURCE)
    waiting = [([tuple(r)], reason) for r in ranges.collect()]
    if len(waiting) > 1:
        waiting = [([span for spans, _ in waiting for span in spans], reason)]
    found, failures = [], 0
    while waiting:
        spans, why = waiting.pop()
        single = len(spans) == 1 and (spans[0][2] is None or spans[0][2] == spans[0][3])
        if single or failures >= patience:
            found += [(span, why) for span in spans]
            continue
        for half in _halves(spans):
            part = batch.where(_inside(half))
            if part.isEmpty():
                continue
            try:
                attempt(part)
                failures = 0
            except Rejected as error:
                waiting.append((half, str(error)))
                failures += 1
    return found


def dead_letter(df: DataFrame, path: str, epoch_id: int) -> None:
    """Keep messages that could not be processed, with the reason in ``error``."""
    append_batch(df, path, epoch_id)


def readmit(spark: SparkSession, root: str, topic_folder: str, schema: T.StructType) -> int:
    """Land the dead letters of ``root`` once more, as messages of a landed topic; returns how many.

    ``schema`` is the topic's. They keep their positions, which no batch has taken, so the job treats them as
    new. A dead letter is landed once: the epoch that was reached is kept beside the letters.
    """
    done = f"{root}/readmitted"
    reached = spark.read.parquet(done).agg(F.max("epoch")).first()[0] if exists(spark, done) else -1
    letters = read_batches(spark, f"{root}/dead_letter", schema, reached + 1, keep_epoch=True)
    newest, count = letters.agg(F.max("epoch_id"), F.count("*")).first()
    if count:
        letters.select(*schema.fieldNames()).write.mode("append").parquet(topic_folder)
        spark.createDataFrame([(newest,)], "epoch bigint").coalesce(1).write.mode("append").parquet(done)
    return count


def gold_error_row(df: DataFrame, root: str, epoch_id: int, batch_id: str, error: str) -> None:
    """Record a failing product refresh; the stream goes on."""
    frame = df.sparkSession.createDataFrame([(batch_id, error)], ERRORS)
    append_batch(frame, f"{root}/gold_errors", epoch_id)


class SettledQuery:
    """A streaming query whose ``awaitTermination`` also brings its product up to date once it has ended well."""

    def __init__(self, query: StreamingQuery, finish: Callable[[], object]):
        self._query, self._finish = query, finish

    def awaitTermination(self, timeout: int | None = None) -> bool | None:  # noqa: N802
        done = self._query.awaitTermination(timeout)
        if not self._query.isActive:
            self._finish()
        return done

    def __getattr__(self, name: str):
        return getattr(self._query, name)
