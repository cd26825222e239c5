"""Compaction of appended tables: many closed epochs become few files while readers and replays go on.

Level by level: ``fan`` folders of a level become one of the next, so a table of n epochs has some ``fan``
times log n folders and a row is rewritten log n times. A span is written beside what it covers and counts
once complete. What it covers is removed by the next run, so that whoever listed it can still read it.
"""

from __future__ import annotations

import math
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kadence.sinks.tables import EPOCH, SPANS, Unit, _file_system, units

FAN = 8
#: Bytes of a compacted file.
FILE_BYTES = 128 << 20


def planned(closed: list[Unit], fan: int) -> list[tuple[int, list[Unit]]]:
    """Spans to write: (level, the units they are made of), by merging the newest ``fan`` of a level.

    Merges that follow from each other are one, so no row is written twice in a run.
    """
    stack: list[tuple[int, list[Unit]]] = []
    for unit in closed:
        stack.append((unit.level, [unit]))
        while len(stack) >= fan and len({level for level, _ in stack[-fan:]}) == 1:
            tail, stack = stack[-fan:], stack[:-fan]
            stack.append((tail[0][0] + 1, [u for _, made in tail for u in made]))
    return [(level, made) for level, made in stack if len(made) > 1]


def compact(
    spark: SparkSession, path: str, before: int, *, fan: int = FAN, file_bytes: int = FILE_BYTES
) -> int:
    """Compact the epochs of a table that are earlier than ``before``; returns the number of spans written.

    Only epochs that cannot be replayed may be given: those earlier than the one that runs now.
    Rows keep their epoch. A run that fails leaves a span that does not count and is written anew.
    """
    fs, _, jvm = _file_system(spark, path)
    for gone in units(spark, path, covered=True):
        fs.delete(jvm.org.apache.hadoop.fs.Path(gone.folder), True)
    spans = planned([u for u in units(spark, path) if u.last < before], fan)
    for level, made in spans:
        size = sum(fs.getContentSummary(jvm.org.apache.hadoop.fs.Path(u.folder)).getLength() for u in made)
        rows = _rows(spark, path, made).coalesce(max(1, math.ceil(size / file_bytes)))
        rows.write.mode("overwrite").parquet(f"{path}/{SPANS}/{level}-{made[0].first}-{made[-1].last}")
    return len(spans)


def _rows(spark: SparkSession, path: str, made: list[Unit]) -> DataFrame:
    parts = []
    if single := [u.folder for u in made if not u.level]:
        parts.append(spark.read.option("basePath", path).parquet(*single))
    if spans := [u.folder for u in made if u.level]:
        parts.append(spark.read.parquet(*spans))
    numbered = [p.withColumn(EPOCH, F.col(EPOCH).cast("long")) for p in parts]
    return reduce(DataFrame.unionByName, numbered)
