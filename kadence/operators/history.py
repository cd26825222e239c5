"""Slowly changing history kept as an append-only log and read as intervals.

The log has one row per opening or closing of a key's state:
``key, flag, valid_from, kind ('open' | 'close'), seq``. Intervals are a view over it, so a
batch only appends, never reads or rewrites what is stored, and a replay changes nothing.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kadence.functions.scalars import whole_days
from kadence.operators.skew import CHUNK_ROWS, HOT_ROWS, with_neighbours


# Fixed value: when the states of newly seen employees begin, for ``initial_valid_from``.
CREATED_FROM = "2026-01-01 00:00:00"


def state_log(
    routed: DataFrame,
    *,
    initial_valid_from: Column | None = None,
    order: Sequence[str] = ("seq",),
) -> DataFrame:
    """Log rows from routed changes with ``id_salarie, route, elig_before, elig_after, ts``.

    ``order`` names the columns that order the changes of a key; the log keeps them. A creation opens, a deletion closes, an update counts only if eligibility flips. Creations
    start at ``initial_valid_from``, or at their own time if that is None.
    """
    start = F.col("ts")
    if initial_valid_from is not None:
        start = F.when(F.col("route") == "created", initial_valid_from).otherwise(F.col("ts"))
    flips = ~F.col("elig_before").eqNullSafe(F.col("elig_after"))
    counts = F.col("route").isin("created", "deleted") | (
        (F.col("route") == "updated") & flips
    )
    return routed.filter(counts).select(
        "id_salarie",
        F.when(F.col("route") != "deleted", F.col("elig_after")).alias("est_eligible_prime_annuel"),
        start.alias("valid_from"),
        F.when(F.col("route") == "deleted", F.lit("close")).otherwise(F.lit("open")).alias("kind"),
        *order,
    )


def scd2_intervals(
    log: DataFrame,
    *,
    clamp: bool = False,
    order: Sequence[str] = ("seq",),
    sizes: DataFrame | None = None,
    min_rows: int = HOT_ROWS,
    chunk_rows: int = CHUNK_ROWS,
) -> DataFrame:
    """Intervals of a state log: an opening lasts until the next row of its key.

    ``clamp`` moves a start that lies before the end of the previous interval to that end.
    ``order`` is unique per key and orders it, its first column being a whole number; times are
    taken as given. ``sizes`` is an optional cheaper frame with ``id_salarie`` and that column of
    at least the log's rows, to look for hot keys in.
    """
    rows = with_neighbours(
        log,
        ["id_salarie"],
        order[0],
        ["valid_from"],
        then=order[1:],
        following="next_row",
        preceding="prev_row" if clamp else None,
        sizes=sizes,
        min_rows=min_rows,
        chunk_rows=chunk_rows,
    )
    start = F.col("valid_from")
    if clamp:
        start = F.greatest(F.col("valid_from"), F.col("prev_row.valid_from"))
    end = F.col("next_row.valid_from")
    return rows.filter(F.col("kind") == "open").select(
        "id_salarie",
        "est_eligible_prime_annuel",
        start.alias("date_debut"),
        end.alias("date_fin"),
        whole_days(start, end).cast("int").alias("duree"),
    )


def active_rows(scd2: DataFrame) -> DataFrame:
    return scd2.filter(F.col("date_fin").isNull())


def as_of(scd2: DataFrame, at: Column) -> DataFrame:
    """State valid at a time; an end is exclusive."""
    return scd2.filter(
        (F.col("date_debut") <= at) & (F.col("date_fin").isNull() | (at < F.col("date_fin")))
    )


def latest_state(changes: DataFrame, key: str, seq: str) -> DataFrame:
    """Current row per key from ``op, before, after``; deleted keys are absent.

    Keeps the last change with ``max_by``, which combines before the shuffle, where a ranking
    window would sort each key in one task.
    """
    last = changes.groupBy(key).agg(F.max_by(F.struct("op", "after"), F.col(seq)).alias("last"))
    return last.filter(F.col("last.op") != "d").select("last.after.*")
