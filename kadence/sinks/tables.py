"""Lake tables as parquet directories: replayable appends and versioned overwrites."""

from __future__ import annotations

from functools import reduce
from typing import NamedTuple

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

EPOCH = "epoch_id"


def append_batch(df: DataFrame, path: str, epoch_id: int) -> None:
    """Add the rows of a micro-batch under its epoch.

    A replayed batch replaces its own rows, also if it is empty now, and touches no others: an
    append that may be repeated. Epochs count per checkpoint, so a table belongs to one.
    """
    df.write.mode("overwrite").parquet(f"{path}/{EPOCH}={epoch_id}")


def spooled(df: DataFrame, path: str) -> DataFrame:
    """The rows of ``df``, computed once and read from ``path``, where they replace what is there.

    For rows that several tables are made of: unlike persisted ones they take no memory, however many they are, and
    a reader takes only the columns it needs.
    """
    df.write.mode("overwrite").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def _file_system(spark: SparkSession, path: str):
    jvm = spark._jvm
    where = jvm.org.apache.hadoop.fs.Path(path)
    return where.getFileSystem(spark._jsc.hadoopConfiguration()), where, jvm


def exists(spark: SparkSession, path: str) -> bool:
    fs, where, _ = _file_system(spark, path)
    return fs.exists(where)


def names_in(spark: SparkSession, path: str) -> list[str]:
    """Names of what lies directly in a folder; a missing folder is empty."""
    fs, where, _ = _file_system(spark, path)
    return [s.getPath().getName() for s in fs.listStatus(where)] if fs.exists(where) else []


def read_batches(
    spark: SparkSession, path: str, schema: T.StructType, since: int = 0, *, keep_epoch: bool = False
) -> DataFrame:
    """Epochs of an appended table from ``since`` on; a missing table is an empty one.

    Closed epochs may have been compacted (``sinks.compaction``): folders wholly before ``since`` are
    not listed any further.
    """
    full = T.StructType([*schema.fields, T.StructField(EPOCH, T.LongType())])
    found = [u for u in units(spark, path) if u.last >= since]
    if not found:
        return spark.createDataFrame([], full if keep_epoch else schema)
    parts = []
    if single := [u.folder for u in found if not u.level]:
        parts.append(spark.read.schema(full).option("basePath", path).parquet(*single))
    if spans := [u.folder for u in found if u.level]:
        parts.append(spark.read.schema(full).parquet(*spans))
    rows = reduce(DataFrame.unionByName, parts)
    rows = rows.filter(F.col(EPOCH) >= since) if since else rows
    return rows if keep_epoch else rows.drop(EPOCH)


class Unit(NamedTuple):
    """A folder of an appended table: one epoch (level 0), or a span of compacted ones."""

    first: int
    last: int
    level: int
    folder: str


SPANS = "_spans"


def units(spark: SparkSession, path: str, *, covered: bool = False) -> list[Unit]:
    """Folders that hold the table, in order of their epochs; with ``covered`` those that do not count any more.

    A span counts once it is complete, and what it covers then does not.
    """
    found = []
    for name in names_in(spark, path):
        if name.startswith(f"{EPOCH}="):
            epoch = int(name.split("=")[1])
            found.append(Unit(epoch, epoch, 0, f"{path}/{name}"))
    for name in names_in(spark, f"{path}/{SPANS}"):
        folder = f"{path}/{SPANS}/{name}"
        if exists(spark, f"{folder}/_SUCCESS"):
            level, first, last = map(int, name.split("-"))
            found.append(Unit(first, last, level, folder))
    current, hidden, reach = [], [], -1
    # Of units that start together the widest comes first; spans nest, as they are made of whole units.
    for unit in sorted(found, key=lambda u: (u.first, -u.last, -u.level)):
        (current if unit.last > reach else hidden).append(unit)
        reach = max(reach, unit.last)
    return hidden if covered else current


def is_non_empty(df: DataFrame) -> bool:
    return not df.isEmpty()


def versions(spark: SparkSession, path: str) -> list[int]:
    """Complete versions of an overwritten table, oldest first."""
    fs, where, jvm = _file_system(spark, path)
    if not fs.exists(where):
        return []
    found = []
    for status in fs.listStatus(where):
        name = status.getPath().getName()
        if name.startswith("version=") and fs.exists(
            jvm.org.apache.hadoop.fs.Path(status.getPath(), "_SUCCESS")
        ):
            found.append(int(name.split("=")[1]))
    return sorted(found)


def overwrite_table(df: DataFrame, path: str, keep: int = 3) -> int:
    """Replace a table in full: write the next version, which counts once it is complete.

    Readers of an older version are not disturbed, and the table may be part of its own
    input. Older versions beyond ``keep`` are removed.
    """
    spark = df.sparkSession
    older = versions(spark, path)
    version = older[-1] + 1 if older else 0
    df.write.mode("overwrite").parquet(f"{path}/version={version}")
    fs, _, jvm = _file_system(spark, path)
    for old in [*older, version][:-keep]:
        fs.delete(jvm.org.apache.hadoop.fs.Path(f"{path}/version={old}"), True)
    return version


def read_table(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    """The newest complete version; a missing table is an empty one."""
    found = versions(spark, path)
    if not found:
        return spark.createDataFrame([], schema)
    return spark.read.schema(schema).parquet(f"{path}/version={found[-1]}")


def export_copy(df: DataFrame, path: str, *, single_file: bool = False) -> int:
    """Copy for reporting tools, returning the number of rows, counted while they are written.

    Partitioned files, whatever the size. ``single_file`` is for products known to be small: all
    rows then pass through one task.
    """
    seen = Observation()
    copy = df.coalesce(1) if single_file else df
    copy.observe(seen, F.count(F.lit(1)).alias("rows")).write.mode("overwrite").parquet(path)
    return int(seen.get["rows"])


def append_facts(df: DataFrame, path: str, epoch_id: int) -> None:
    """Add activities to the fact table, without an index column."""
    columns = [c for c in df.columns if not c.startswith("__index")]
    append_batch(df.select(*columns), path, epoch_id)


def append_facts_jdbc(df: DataFrame, url: str, table: str, properties: dict[str, str]) -> None:
    """The same into a relational table; rows are sent by the executors."""
    df.write.mode("append").jdbc(url, table, properties=properties)


NOTIFICATIONS = T.StructType(
    [
        T.StructField("id_evenement_sport", T.LongType()),
        T.StructField("salarie_id", T.LongType()),
        T.StructField("message", T.StringType()),
        T.StructField("created_at", T.TimestampType()),
    ]
)


def notification_table(messages: DataFrame, at: Column) -> DataFrame:
    """Built messages as they are kept; a delivery job reads them from the table."""
    return messages.withColumn("created_at", at).select(*NOTIFICATIONS.fieldNames())
