"""Neighbouring rows within a key, when one key may hold a large part of all rows.

A window over a key puts the whole key into one task. Here keys above a size are cut into
chunks along their order, and the window runs per chunk. The first row of a chunk also visits
the chunk before, and the last row the chunk after, so that no row misses its neighbour. Keys
below that size stay in one piece; without larger ones the plan is a plain window.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from kadence.workspace import checkpointed

HOT_ROWS = 2_000_000
CHUNK_ROWS = 500_000
# A table of cuts or chunk ends is sent to all tasks up to this many rows; a larger one is joined.
SMALL = 10_000
# Bounds are searched in two steps: every so many, then those between.
STRIDE = 64

CHUNK = "__chunk"


def hot_keys(df: DataFrame, keys: Sequence[str], min_rows: int = HOT_ROWS) -> DataFrame:
    """Keys with more than ``min_rows`` rows, and their number.

    Counts are combined before the shuffle, and only the keys are read.
    """
    counts = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("__rows"))
    return counts.filter(F.col("__rows") > min_rows)


def _sent(df: DataFrame, rows: int) -> DataFrame:
    return F.broadcast(df) if rows <= SMALL else df


def chunk_cuts(
    df: DataFrame, keys: Sequence[str], position: str, min_rows: int, chunk_rows: int
) -> tuple[DataFrame, int] | None:
    """Per hot key the positions where it is cut, by rank: chunks are even however positions lie.

    Quantiles are sketched per hot key, with an error of a tenth of a chunk. Only the number of
    hot keys and the size of the largest come to the driver. None if no key is hot.
    """
    narrow = df.select(*keys, F.col(position).cast("bigint").alias("__position"))
    found = checkpointed(hot_keys(narrow, keys, min_rows))
    seen = found.agg(F.count(F.lit(1)).alias("n"), F.max("__rows").alias("most")).first()
    if not seen["n"]:
        return None
    pieces = max(2, -(-seen["most"] // chunk_rows))
    shares = [i / pieces for i in range(1, pieces)]
    mine = narrow.join(_sent(found, seen["n"]), list(keys))
    # A smaller hot key uses every so many of the quantiles only.
    step = F.greatest(F.floor(F.lit(chunk_rows * pieces) / F.col("__rows")), F.lit(1))
    bounds = F.array_distinct(
        F.filter("__all", lambda _, i: (i + F.lit(1)) % F.col("__step") == F.lit(0))
    )
    cuts = (
        mine.groupBy(*keys)
        .agg(
            F.percentile_approx("__position", shares, 10 * pieces).alias("__all"),
            F.max(step).alias("__step"),
        )
        .select(*keys, bounds.alias("__bounds"))
        .withColumn(
            "__coarse",
            F.filter("__bounds", lambda _, i: (i + F.lit(1)) % F.lit(STRIDE) == F.lit(0)),
        )
    )
    return checkpointed(cuts), seen["n"]


def _chunked(
    df: DataFrame, keys: Sequence[str], position: str, cuts: tuple[DataFrame, int], how: str
) -> DataFrame:
    """Rows with a chunk number that grows with the position, from 1; 0 for a key in one piece."""
    here = F.col("__position")
    whole = F.size(F.filter("__coarse", lambda bound: bound < here)) * F.lit(STRIDE)
    rest = F.filter(
        F.slice("__bounds", whole + F.lit(1), F.lit(STRIDE)), lambda bound: bound < here
    )
    number = F.when(F.col("__bounds").isNull(), F.lit(0)).otherwise(
        whole + F.size(rest) + F.lit(1)
    )
    frame, rows = cuts
    return (
        df.withColumn("__position", F.col(position).cast("bigint"))
        .join(_sent(frame, rows), list(keys), how)
        .withColumn(CHUNK, number)
        .drop("__bounds", "__coarse")
    )


def with_neighbours(
    df: DataFrame,
    keys: Sequence[str],
    position: str,
    columns: Sequence[str],
    *,
    then: Sequence[str] = (),
    following: str | None = None,
    preceding: str | None = None,
    sizes: DataFrame | None = None,
    min_rows: int = HOT_ROWS,
    chunk_rows: int = CHUNK_ROWS,
) -> DataFrame:
    """Add the next and / or previous row of the same key as struct columns, null at the ends.

    ``position`` is a whole number. With the columns ``then``, which decide where it is equal, it
    is unique per key. ``sizes`` is a cheaper frame with the keys and the position, and at least
    the rows of ``df``, to find hot keys in.
    """
    row = F.struct(*columns)
    order = [position, *then]
    place = F.struct(F.col("__position"), *then)

    def neighbours(window) -> list[Column]:
        found = []
        if following:
            found.append(F.lead(row).over(window).alias(following))
        if preceding:
            found.append(F.lag(row).over(window).alias(preceding))
        return found

    cuts = chunk_cuts(df if sizes is None else sizes, keys, position, min_rows, chunk_rows)
    if cuts is None:
        return df.select("*", *neighbours(Window.partitionBy(*keys).orderBy(*order)))

    along = Window.partitionBy(*keys).orderBy(CHUNK)
    ends = checkpointed(
        _chunked(df.select(*dict.fromkeys([*keys, *order])), keys, position, cuts, "inner")
        .groupBy(*keys, CHUNK)
        .agg(F.min(place).alias("__head"), F.max(place).alias("__tail"))
        .withColumn("__before", F.lag(CHUNK).over(along))
        .withColumn("__after", F.lead(CHUNK).over(along))
    )
    visits = [F.col(CHUNK)]
    if following:
        visits.append(F.when(place == F.col("__head"), F.col("__before")))
    if preceding:
        visits.append(F.when(place == F.col("__tail"), F.col("__after")))
    visiting = (
        _chunked(df, keys, position, cuts, "left")
        .join(_sent(ends, ends.count()), [*keys, CHUNK], "left")
        .select(*df.columns, CHUNK, F.explode(F.array_compact(F.array(*visits))).alias("__visited"))
    )
    within = Window.partitionBy(*keys, "__visited").orderBy(*order)
    return (
        visiting.select("*", *neighbours(within))
        .filter(F.col("__visited") == F.col(CHUNK))
        .drop(CHUNK, "__visited")
    )
