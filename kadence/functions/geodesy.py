"""Distances on the earth."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Mean earth radius, and the WGS84 ellipsoid.
EARTH_RADIUS_M = 6_371_008.8
WGS84_A = 6_378_137.0
WGS84_F = 1 / 298.257223563
WGS84_B = WGS84_A * (1 - WGS84_F)

# Each step of the longitude correction shrinks the error by about the flattening (1/300), but
# for nearly antipodal points, where it settles late or never. Else it is about 0.01 at most.
WGS84_STEPS = 8
WGS84_MORE_STEPS = 200
WGS84_NEAR = 1e-12
WGS84_CORRECTION = 0.02


def haversine(lat1: Column, lon1: Column, lat2: Column, lon2: Column) -> Column:
    """Great-circle distance in metres, as a native expression."""
    dlat = F.radians(lat2 - lat1) / F.lit(2.0)
    dlon = F.radians(lon2 - lon1) / F.lit(2.0)
    h = F.sin(dlat) * F.sin(dlat) + F.cos(F.radians(lat1)) * F.cos(F.radians(lat2)) * F.sin(
        dlon
    ) * F.sin(dlon)
    return F.lit(2 * EARTH_RADIUS_M) * F.asin(F.sqrt(F.when(h > 1, F.lit(1.0)).otherwise(h)))


def wgs84(lat1: Column, lon1: Column, lat2: Column, lon2: Column) -> Column:
    """Geodesic metres on the ellipsoid: Vincenty's inverse formula over whole Arrow batches.

    The iteration has no closed form, and unrolled as an expression it grows with each step.
    Points where it does not settle are nearly antipodal; they are measured in two legs.
    """

    # Local functions travel to the workers by value: they need no copy of this package.
    def vincenty(u1, u2, span, steps=WGS84_STEPS):
        """Metres between reduced latitudes, and which of them have settled."""
        f, b = WGS84_F, WGS84_B
        s1, c1, s2, c2 = np.sin(u1), np.cos(u1), np.sin(u2), np.cos(u2)
        lam = before = span
        with np.errstate(divide="ignore", invalid="ignore"):
            for _ in range(steps):
                before = lam
                ss = np.hypot(c2 * np.sin(lam), c1 * s2 - s1 * c2 * np.cos(lam))
                cs = s1 * s2 + c1 * c2 * np.cos(lam)
                sigma = np.arctan2(ss, cs)
                sa = np.where(ss == 0, 0.0, c1 * c2 * np.sin(lam) / ss)
                c2a = 1 - sa * sa
                c2m = np.where(c2a == 0, 0.0, cs - 2 * s1 * s2 / c2a)
                c = f / 16 * c2a * (4 + f * (4 - 3 * c2a))
                lam = span + (1 - c) * f * sa * (sigma + c * ss * (c2m + c * cs * (2 * c2m**2 - 1)))
            settled = ~(
                (np.abs(lam - before) > WGS84_NEAR) | (np.abs(lam - span) > WGS84_CORRECTION)
            )
        usq = c2a * (WGS84_A**2 - b**2) / b**2
        big_a = 1 + usq / 16384 * (4096 + usq * (-768 + usq * (320 - 175 * usq)))
        big_b = usq / 1024 * (256 + usq * (-128 + usq * (74 - 47 * usq)))
        third = big_b / 6 * c2m * (4 * ss**2 - 3) * (4 * c2m**2 - 3)
        delta = big_b * ss * (c2m + big_b / 4 * (cs * (2 * c2m**2 - 1) - third))
        return b * big_a * (sigma - delta), settled

    def halfway(u1, azimuth):
        """Reduced latitude and longitude a quarter turn of the great circle from ``u1``.

        The leg to it is measured on the ellipsoid, so any point will do that is antipodal to
        neither end.
        """
        s = np.clip(np.cos(u1) * np.cos(azimuth), -1, 1)
        return np.arcsin(s), np.arctan2(np.sin(azimuth) * np.cos(u1), -np.sin(u1) * s)

    def in_two_legs(u1, u2, span):
        """Shortest way over a point between, by its azimuth; the shortest way of all is one."""

        def way(azimuth):
            mid, lon = halfway(u1, azimuth)
            rest = np.remainder(span - lon + np.pi, 2 * np.pi) - np.pi
            return vincenty(u1, mid, lon)[0] + vincenty(mid, u2, rest)[0]

        grid = np.linspace(0, 2 * np.pi, 360, endpoint=False)
        best = grid[np.argmin([way(np.full(len(u1), a)) for a in grid], axis=0)]
        low, high = best - grid[1], best + grid[1]
        for _ in range(60):
            a, b = low + (high - low) * 0.382, high - (high - low) * 0.382
            left = way(a) < way(b)
            low, high = np.where(left, low, a), np.where(left, b, high)
        return way((low + high) / 2)

    def inverse(lat1: pd.Series, lon1: pd.Series, lat2: pd.Series, lon2: pd.Series) -> pd.Series:
        u1, u2 = (
            np.arctan((1 - WGS84_F) * np.tan(np.radians(x.to_numpy(float)))) for x in (lat1, lat2)
        )
        span = np.radians(lon2.to_numpy(float) - lon1.to_numpy(float))
        metres, settled = vincenty(u1, u2, span)
        far = np.flatnonzero(~settled)
        if len(far):
            metres[far], late = vincenty(u1[far], u2[far], span[far], WGS84_MORE_STEPS)
            far = far[~late]
        if len(far):
            turn = np.remainder(span[far] + np.pi, 2 * np.pi) - np.pi
            metres[far] = in_two_legs(u1[far], u2[far], turn)
        return pd.Series(metres)

    return F.pandas_udf(inverse, T.DoubleType())(lat1, lon1, lat2, lon2)


METHODS = {"haversine": haversine, "wgs84": wgs84}


def linear_distance(
    lat1: Column, lon1: Column, lat2: Column, lon2: Column, method: str = "wgs84"
) -> Column:
    """Straight-line metres between two points; null if a coordinate is."""
    return METHODS[method](lat1, lon1, lat2, lon2)
