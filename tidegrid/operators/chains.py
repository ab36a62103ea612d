"""Whole chains that a user calls: a box on a new grid, its profile along an axis, the profile's spectrum."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidegrid.operators import grids, series

Range = tuple[float, float]


def box_weights(spark: SparkSession, axis: list[float], within: Range, step: float, name: str) -> tuple[DataFrame, list[float]]:
    """Interpolation weights from the points of an ascending ``axis`` inside a range to every ``step`` of it, and those targets.

    Targets beyond the last point inside have no rows, as the points outside are cropped first.
    """
    inside = [i for i, x in enumerate(axis) if within[0] <= x <= within[1]]
    targets = grids.axis(*within, step)
    weights = grids.axis_weights(spark, [axis[i] for i in inside], targets if inside else [], name)
    return weights.withColumn(f"{name}_s", F.col(f"{name}_s") + (inside[0] if inside else 0)), targets


def _placed(rows: DataFrame, index: str, name: str, targets: list[float]) -> DataFrame:
    return rows.withColumn(name, F.get(F.array(*[F.lit(float(t)) for t in targets]), F.col(index)))  # an axis long


def crop_regrid(fields: DataFrame, keys: list[str], axes: dict[str, list[float]], lat: Range, lon: Range, step: float) -> DataFrame:
    """keys, lat_i, lon_i, lat, lon, v: fields cropped to a box and interpolated to a grid of ``step`` from its lower corner.

    ``axes`` are the source's lat and lon.  One shuffle: cells meet the two weight tables, which crop
    them, and are summed by target.
    """
    spark = fields.sparkSession
    by_lat, lats = box_weights(spark, axes["lat"], lat, step, "lat")
    by_lon, lons = box_weights(spark, axes["lon"], lon, step, "lon")
    out = grids.regrid(fields, keys, by_lat, by_lon)
    return _placed(_placed(out, "lat_i", "lat", lats), "lon_i", "lon", lons)


def profile(fields: DataFrame, keys: list[str], axes: dict[str, list[float]], lat: Range, lon: Range, along: str) -> DataFrame:
    """keys, axis_i, v: means of a box's present values over the other axis than ``along``."""
    inside = F.lit(True)
    for name, within in (("lat", lat), ("lon", lon)):
        kept = [i for i, x in enumerate(axes[name]) if within[0] <= x <= within[1]]
        inside = inside & F.col(f"{name}_i").between(min(kept, default=0), max(kept, default=-1))
    return fields.where(inside).groupBy(*keys, F.col(f"{along}_i").alias("axis_i")).agg(F.avg("v").alias("v"))


def crop_profile(fields: DataFrame, keys: list[str], axes: dict[str, list[float]], lat: Range, lon: Range, along: str, step: float) -> DataFrame:
    """keys, x_i, x, v: a box's profile along an axis, interpolated to every ``step`` of it."""
    weights, targets = box_weights(fields.sparkSession, axes[along], {"lat": lat, "lon": lon}[along], step, "x")
    out = grids.interpolate(profile(fields, keys, axes, lat, lon, along), keys, weights)
    return _placed(out.withColumnRenamed("axis_i", "x_i"), "x_i", "x", targets)


def spectrum(fields: DataFrame, keys: list[str], axes: dict[str, list[float]], lat: Range, lon: Range, along: str) -> DataFrame:
    """keys, k, re, im, radius, phase, wvlen of a box's profile along an axis, its line removed.

    Wavelengths are in the axis's unit; profiles with a missing value are left out.
    """
    points = [x for x in axes[along] if {"lat": lat, "lon": lon}[along][0] <= x <= {"lat": lat, "lon": lon}[along][1]]
    start = axes[along].index(points[0])
    rows = profile(fields, keys, axes, lat, lon, along).where(F.col("v").isNotNull())
    rows = rows.select(F.struct(*keys).alias("t"), (F.col("axis_i") - start).alias("x"), "v")
    waves = series.dft(series.detrend(rows), "v_detrended", len(points), points[1] - points[0])
    return waves.select("t.*", "k", "re", "im", "radius", "phase", "wvlen")
