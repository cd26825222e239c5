"""Scalar rules as native column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from kadence.rules import Rules

# Substrings that mark a commute mode.
WALK_MARKS = ("marche", "running")
RIDE_MARKS = ("vélo", "trottinette")

WALK = "walk"
DRIVE = "drive"


def _mentions(text: Column, marks: tuple[str, ...]) -> Column:
    low = F.lower(text)
    found = low.contains(marks[0])
    for mark in marks[1:]:
        found = found | low.contains(mark)
    return found


def commute_mode(text: Column) -> Column:
    """Road network a commute text belongs to: ``walk``, ``drive`` (bike, scooter) or null."""
    return F.when(_mentions(text, WALK_MARKS), F.lit(WALK)).when(
        _mentions(text, RIDE_MARKS), F.lit(DRIVE)
    )


def mode_limit(mode: Column, rules: Rules) -> Column:
    """Longest commute in metres that still counts for a mode."""
    return F.when(mode == WALK, F.lit(rules.walk_limit_m)).when(
        mode == DRIVE, F.lit(rules.drive_limit_m)
    )


def is_bonus_eligible(mode: Column, distance_m: Column, rules: Rules) -> Column:
    """Within the limit of the mode, inclusive. Any unknown makes it false, never null."""
    return F.coalesce(distance_m <= mode_limit(mode, rules), F.lit(False))


def bonus_amount(income: Column, ratio: Column, flag: Column, rules: Rules) -> Column:
    """Null without an income, a percentage of it above the yearly ratio, else 0."""
    earned = F.coalesce((ratio > F.lit(rules.min_eligible_percent)) & flag, F.lit(False))
    return (
        F.when(income.isNull(), F.lit(None).cast("double"))
        .when(earned, F.bround(F.lit(rules.bonus_percent) * income / F.lit(100.0), 2))
        .otherwise(F.lit(0.0))
        .cast("double")
    )


def format_duration(seconds: Column) -> Column:
    """``1h30min``, ``2h``, ``45min``; nothing or less is ``0min``. Minutes round half to even."""
    minutes = F.bround(seconds / F.lit(60.0), 0).cast("bigint")
    hours = F.floor(minutes / F.lit(60))
    rest = F.pmod(minutes, F.lit(60).cast("bigint"))
    return (
        F.when(seconds.isNull() | (seconds <= 0), F.lit("0min"))
        .when((hours > 0) & (rest > 0), F.concat(hours, F.lit("h"), rest, F.lit("min")))
        .when(hours > 0, F.concat(hours, F.lit("h")))
        .otherwise(F.concat(rest, F.lit("min")))
    )


def activity_seconds(start_us: Column, end_us: Column) -> Column:
    """Whole seconds between two instants in microseconds, truncated towards zero."""
    return ((end_us - start_us) / F.lit(1_000_000.0)).cast("bigint")


def distance_km(metres: Column) -> Column:
    """Kilometres with one decimal; null for no distance."""
    return F.when(metres != 0, F.bround(metres / F.lit(1000.0), 1))


def activity_year(end_us: Column) -> Column:
    return F.year(F.timestamp_micros(end_us))


def days_in_year(year: Column) -> Column:
    first = F.make_date(year, F.lit(1), F.lit(1))
    following = F.make_date(year + F.lit(1), F.lit(1), F.lit(1))
    return F.date_diff(following, first)


def end_of_year(year: int) -> Column:
    return F.make_timestamp(*(F.lit(n) for n in (year, 12, 31, 23, 59, 59)))


def days_between(start: Column, end: Column) -> Column:
    """Elapsed days as a number rounded half to even: a full open year gives 365.0."""
    micros = F.unix_micros(end) - F.unix_micros(start)
    return F.bround(micros / F.lit(86_400_000_000.0), 0)


def whole_days(start: Column, end: Column) -> Column:
    """Complete days between two instants; null while the end is unknown."""
    return F.timestamp_diff("DAY", start, end)


def percentage(part: Column, whole: Column) -> Column:
    return F.bround(F.lit(100.0) * part / whole, 2)


def text_date(text: Column) -> Column:
    """Day, month and year with one or two digits; null if it is no date."""
    return F.try_to_date(text, "d/M/yyyy")


def differs(left: Column, right: Column) -> Column:
    """Null-safe inequality."""
    return ~left.eqNullSafe(right)


def pick_variant(options: Column, seed: Column, stride: int) -> Column:
    """One entry, chosen repeatably by a seed."""
    size = F.size(options).cast("bigint")
    return F.element_at(
        options, (F.pmod(seed * F.lit(stride), size) + F.lit(1)).cast("int")
    )


def pick_some(options: Column, seed: Column, stride: int) -> Column:
    """1 to n-1 different entries joined by a space, chosen repeatably by a seed."""
    size = F.size(options).cast("bigint")
    turn = F.pmod(seed * F.lit(stride), size).cast("int")
    many = (F.pmod(seed, size - F.lit(1)) + F.lit(1)).cast("int")
    doubled = F.concat(options, options)
    return F.array_join(F.slice(doubled, turn + F.lit(1), many), " ")


def comment_suffix(comment: Column) -> Column:
    return F.when(F.length(comment) > 0, F.concat(F.lit(' ("'), comment, F.lit('")'))).otherwise(
        F.lit("")
    )
