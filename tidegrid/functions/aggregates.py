"""Aggregates with a stated rule for missing values, and coordinate helpers.

Missing is NULL throughout; ``present`` turns NaN and infinities into NULL once, at ingestion.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def present(v: Column) -> Column:
    v = v.cast("double")
    return F.when(F.abs(v) < F.lit(float("inf")), v)


def avg_strict(v: Column) -> Column:
    """Mean, missing if any value is."""
    return F.when(F.count(v) == F.count(F.lit(1)), F.avg(v))


def std_pop_strict(v: Column) -> Column:
    return F.when(F.count(v) == F.count(F.lit(1)), F.stddev_pop(v))


def mean_of_all(v: Column, members: int) -> Column:
    """Sum over ``members`` values divided by their number; missing if fewer are there."""
    return F.when(F.count(v) == members, F.sum(v) / members)


def wrap_longitude(lon: Column) -> Column:
    """Longitude in [0, 360)."""
    return F.pmod(lon, F.lit(360.0))


def sign_of_mode(v: Column) -> Column:
    """-1 if more values are negative than not, else 1."""
    return F.when(F.count_if(v < 0) > F.count_if(v >= 0), -1).otherwise(1)


def pretty_latitude(lat: Column, zero: str = "") -> Column:
    """``30N``, ``12.5S``, ``0`` followed by ``zero``; an error beyond the poles."""
    size = F.abs(lat)
    text = F.when(size == F.floor(size), F.floor(size).cast("string")).otherwise(size.cast("string"))
    checked = F.when(size > 90, F.raise_error(F.lit("latitude beyond a pole"))).otherwise(text)
    return F.concat(checked, F.when(lat > 0, "N").when(lat < 0, "S").otherwise(zero))


def pretty_longitude(lon: Column) -> Column:
    """``120E``, ``150W`` of any longitude; 0 and 180 have no side."""
    east = wrap_longitude(lon)
    size = F.when(east > 180, F.lit(360.0) - east).otherwise(east)
    text = F.when(size == F.floor(size), F.floor(size).cast("string")).otherwise(size.cast("string"))
    return F.concat(text, F.when((east == 0) | (east == 180), "").when(east < 180, "E").otherwise("W"))
