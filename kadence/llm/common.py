"""Small helpers that the operators of this package share."""

from __future__ import annotations

import ctypes
import functools
import inspect
import tempfile
import zipfile
from collections.abc import Callable
from pathlib import Path

import pyarrow as pa
from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from kadence.workspace import checkpointed, work_dir

__all__ = ["WORD", "Memo", "checkpointed", "positions", "shipped", "stored", "table", "tidy", "with_rank", "word_count"]

#: A word: whatever stands between ASCII white space.
WORD = r"[^\x20\x09-\x0D]+"


def stored(df: DataFrame) -> DataFrame:
    """The rows of ``df``, as a table written in the shared folder."""
    path = work_dir(df.sparkSession, "stored")
    df.write.parquet(path)
    return df.sparkSession.read.parquet(path)


_SHIPPED: set[str] = set()


def shipped(spark: SparkSession) -> None:
    """Send this library to the executors, as Python tasks import it by name.

    Once per application, as a Python file of the session; nothing else needs it installed there.
    """
    context = spark.sparkContext
    if context.applicationId in _SHIPPED:
        return
    package = Path(__file__).resolve().parents[1]
    archive = Path(tempfile.mkdtemp(prefix="kadence-")) / "kadence.zip"
    with zipfile.ZipFile(archive, "w") as file:
        for source in sorted(package.rglob("*.py")):
            file.write(source, Path(package.name) / source.relative_to(package))
    context.addPyFile(str(archive))
    _SHIPPED.add(context.applicationId)


def released() -> None:
    """Give back memory that was freed: Python workers stay for later tasks, beside a JVM that wants it."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL("libc.so.6").malloc_trim(0)
    except (OSError, AttributeError):
        pass  # another C library keeps what it keeps


def tidy(work: Callable) -> Callable:
    """A function of one or two groups that gives back the memory it no longer needs."""
    if len(inspect.signature(work).parameters) == 1:

        @functools.wraps(work)
        def one(group):
            found = work(group)
            released()
            return found

        return one

    @functools.wraps(work)
    def two(left, right):
        found = work(left, right)
        released()
        return found

    return two


def row_place(docs: DataFrame) -> Column | None:
    """A hash of where a row of ``docs`` stands in the files it reads, the same whoever reads it; None if it reads none."""
    try:
        place = docs.metadataColumn("_metadata")
        docs.select(place["row_index"])
    except AnalysisException:
        return None
    return F.xxhash64(place["file_path"], place["row_index"])


class Memo(dict):
    """Answers for recent keys, in two generations of at most ``size``; the older one is dropped."""

    def __init__(self, size: int):
        super().__init__()
        self.size, self.old = size, {}

    def __missing__(self, key):
        value = self.old[key]  # KeyError if unknown
        self.put(key, value)
        return value

    def __contains__(self, key) -> bool:
        return dict.__contains__(self, key) or key in self.old

    def put(self, key, value) -> None:
        if len(self) >= self.size:
            self.old = dict(self)
            self.clear()
        self[key] = value


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    shipped(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def word_count(text: Column) -> Column:
    """Number of words; a null text has none."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def positions(df: DataFrame, keys: list[str], order: list[str]) -> tuple[DataFrame, DataFrame]:
    """``df`` with ``range`` and ``pos``: 0, 1, ... along ``order`` within equal ``keys``; and the runs.

    Rows are dealt by ranges of all these columns, sorted and written, so a hot key is many ranges and no task
    holds more than its own. A run is what a range holds of a key (``range``, keys, ``size``, ``n`` of
    the key): there are about as many as ranges and keys. Ascending, nulls first.
    """
    from pyspark.sql import Window

    by = [F.col(c).asc_nulls_first() for c in [*keys, *order]]
    rows = stored(
        df.repartitionByRange(*by).sortWithinPartitions(*by).withColumn("_row", F.monotonically_increasing_id())
    ).withColumn("range", F.shiftright("_row", 33))
    runs = rows.groupBy("range", *keys).agg(F.min("_row").alias("_first"), F.count("*").alias("size"))
    same = Window.partitionBy(*keys) if keys else Window.partitionBy(F.lit(0))
    before = same.orderBy("range").rowsBetween(Window.unboundedPreceding, -1)
    runs = runs.withColumns(
        {"_before": F.coalesce(F.sum("size").over(before), F.lit(0)), "n": F.sum("size").over(same)}
    )
    runs = stored(runs)
    ranked = _join(rows, runs.select("range", *keys, "_first", "_before", "n"), ["range", *keys])
    ranked = ranked.withColumn("pos", F.col("_row") - F.col("_first") + F.col("_before"))
    return ranked.drop("_row", "_first", "_before"), runs.drop("_first", "_before")


def with_rank(
    df: DataFrame, keys: list[str], order: str, rows_per_task: int = 512, spread: Column | None = None
) -> DataFrame:
    """Add ``rank``: 0, 1, ... within equal ``keys``; hot keys are numbered in many tasks.

    A key is cut into cells of about ``rows_per_task`` rows by ``spread``, a hash of ``order``. Cells are
    counted (combined before the shuffle) and their counts summed up within the key; a row's
    rank is the sum before its cell plus its number inside. Rows that are equal in ``order``
    share a cell; the numbers among them are exchangeable. Keys may be null.
    """
    from pyspark.sql import Window

    sized = df.groupBy(*keys).agg(F.ceil(F.count("*") / rows_per_task).alias("_cells"))
    celled = _join(df, sized, keys).withColumn(
        "_cell", F.pmod(F.xxhash64(F.col(order)) if spread is None else spread, F.col("_cells"))
    )
    counts = celled.groupBy(*keys, "_cell").agg(F.count("*").alias("_n"))
    before = Window.partitionBy(*keys).orderBy("_cell").rowsBetween(Window.unboundedPreceding, -1)
    starts = counts.withColumn("_start", F.coalesce(F.sum("_n").over(before), F.lit(0))).drop("_n")
    inside = Window.partitionBy(*keys, "_cell").orderBy(order)
    return (
        _join(celled, starts, [*keys, "_cell"])
        .withColumn("rank", F.col("_start") + F.row_number().over(inside) - 1)
        .drop("_cells", "_cell", "_start")
    )


def _join(left: DataFrame, right: DataFrame, keys: list[str]) -> DataFrame:
    """Inner join in which null keys meet."""
    renamed = right.select(
        *(F.col(k).alias(f"_r_{k}") for k in keys), *(c for c in right.columns if c not in keys)
    )
    on = [F.col(k).eqNullSafe(F.col(f"_r_{k}")) for k in keys]
    return left.join(renamed, on).drop(*(f"_r_{k}" for k in keys))
