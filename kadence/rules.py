"""Business parameters: six numbers and the sites."""

from __future__ import annotations

from dataclasses import dataclass


@dataclass(frozen=True)
class Rules:
    """Thresholds of the two products. Defaults are the values of the shipped rule file."""

    min_eligible_percent: float = 80
    bonus_percent: float = 5
    wellbeing_days: int = 5
    min_activities: int = 15
    walk_limit_m: int = 15_000
    drive_limit_m: int = 25_000


@dataclass(frozen=True)
class Site:
    """A workplace. One fixed pair of coordinates, so it enters plans as literals."""

    lat: float
    lon: float
    site_id: int = 0
