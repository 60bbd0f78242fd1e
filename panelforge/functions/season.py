"""Closed-form season and sun expressions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Day of year of leaf-out and leaf-fall, and the width of both transitions.
LEAF_OUT_DAY = 90
LEAF_FALL_DAY = 320
LEAF_WIDTH_DAYS = 25.0


def leaf_season(day: str | Column) -> Column:
    """Share of leaves on the trees, 0..1: a logistic rise in spring times a logistic fall in autumn."""
    n = F.dayofyear(day).cast("double")
    rise = 1.0 / (1.0 + F.exp((F.lit(float(LEAF_OUT_DAY)) - n) / F.lit(LEAF_WIDTH_DAYS)))
    fall = 1.0 / (1.0 + F.exp((n - F.lit(float(LEAF_FALL_DAY))) / F.lit(LEAF_WIDTH_DAYS)))
    return F.least(F.greatest(rise * fall, F.lit(0.0)), F.lit(1.0))


def solar_geometry(latitude: str | Column, day: str | Column) -> dict[str, Column]:
    """Declination, day length in hours and noon elevation in degrees."""
    lat = F.col(latitude) if isinstance(latitude, str) else latitude
    declination = 23.45 * F.sin(F.radians(360.0 * (284.0 + F.dayofyear(day)) / 365.0))
    cos_hour = -F.tan(F.radians(lat)) * F.tan(F.radians(declination))
    hour_angle = F.acos(F.least(F.greatest(cos_hour, F.lit(-1.0)), F.lit(1.0)))
    return {
        "declination": declination,
        "day_length_hours": 2.0 * F.degrees(hour_angle) / 15.0,
        "noon_elevation": 90.0 - F.abs(lat - declination),
    }


def add_solar_features(df: DataFrame, latitude: str, day: str) -> DataFrame:
    return df.withColumns(solar_geometry(latitude, day))


def clearness_index(observed: str, clear_sky: str, epsilon: float = 1e-6) -> Column:
    """Observed over clear-sky irradiance, NULL at or below `epsilon`."""
    den = F.col(clear_sky)
    return F.when(den > epsilon, F.col(observed) / F.when(den > epsilon, den))


def regime_number(day: str | Column, breaks: list[str]) -> Column:
    """1 plus the number of break dates that have passed."""
    d = F.to_date(day)
    out = F.lit(1)
    for b in breaks:
        out = out + (d >= F.lit(b).cast("date")).cast("int")
    return out
