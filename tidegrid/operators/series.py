"""Operators on series along one axis: rows (t, x, v) with integer positions x from 0."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

# Wavelength bands, each [low, high).
BANDS = [(0.0, 2.0), (2.0, 5.0), (5.0, 360.0)]
SUMMED = 256  # longest series whose transform is summed term by term


def detrend(rows: DataFrame) -> DataFrame:
    """t, x, v_detrended (least-squares line removed), v_minus_intercept."""
    own = Window.partitionBy("t")
    slope, intercept = F.regr_slope("v", "x").over(own), F.regr_intercept("v", "x").over(own)
    return rows.select(
        "t", "x", (F.col("v") - (slope * F.col("x") + intercept)).alias("v_detrended"), (F.col("v") - intercept).alias("v_minus_intercept")
    )


def dft(rows: DataFrame, value: str, n: int, dx: float = 1.0) -> DataFrame:
    """t, k, re, im, radius, phase, wvlen for k below n / 2, coefficients divided by n.

    Series are gathered into arrays of ``n`` values once, so no row is multiplied before a shuffle.
    Short series are summed inside the row; beyond ``SUMMED`` values, where that would take n^2
    steps, blocks of series go through a fast transform.  Series with a missing value are left out.
    wvlen is null for k = 0, and phase where the radius is only rounding noise.
    """
    series = rows.groupBy("t").agg(F.sort_array(F.collect_list(F.struct("x", F.col(value).alias("v")))).alias("s")).where(
        (F.size("s") == n) & F.forall("s", lambda e: e["v"].isNotNull())
    )
    parts = _summed(series, n) if n <= SUMMED else _transformed(series, n)
    parts = parts.withColumn("radius", F.sqrt(F.col("re") * F.col("re") + F.col("im") * F.col("im")))
    return parts.select(
        "t", "k", "re", "im", "radius", F.when(F.col("radius") > 1e-9, F.atan2("im", "re")).alias("phase"),
        F.when(F.col("k") > 0, F.lit(n * dx) / F.col("k")).alias("wvlen"),
    )


def _summed(series: DataFrame, n: int) -> DataFrame:
    waves = series.select("t", "s", F.explode(F.sequence(F.lit(0), F.lit(n // 2 - 1))).alias("k"))
    turn = lambda e: F.lit(2 * math.pi) * F.pmod(F.col("k") * e["x"], F.lit(n)) / n
    add = lambda f: F.aggregate("s", F.lit(0.0), lambda a, e: a + e["v"] * f(turn(e))) / n
    return waves.select("t", "k", add(F.cos).alias("re"), (-add(F.sin)).alias("im"))


def _transformed(series: DataFrame, n: int) -> DataFrame:
    half = n // 2

    @F.pandas_udf("array<struct<k: int, re: double, im: double>>")
    def waves(values: pd.Series) -> pd.Series:
        out = []
        for at in range(0, len(values), 256):
            found = np.fft.rfft(np.stack(values.iloc[at : at + 256].to_list()), axis=1)[:, :half] / n
            out += [[{"k": k, "re": c.real, "im": c.imag} for k, c in enumerate(row)] for row in found]
        return pd.Series(out)

    return series.select("t", F.inline(waves(F.col("s.v"))))


def chunk_amplitudes(spectrum: DataFrame, chunk: Column) -> DataFrame:
    """t (the chunk), k, radius, wvlen: mean amplitude of each harmonic over the series of a chunk."""
    rows = spectrum.select(chunk.alias("t"), "k", "radius", "wvlen").where("t IS NOT NULL")
    return rows.groupBy("t", "k").agg(F.avg("radius").alias("radius"), F.first("wvlen").alias("wvlen"))


def spectral_density(fields: DataFrame, keys: list[str], n_lon: int, dx: float, longest: float) -> DataFrame:
    """keys, k, wvlen, density, log_density: mean over rows of |DFT|^2 along longitude, not normalised.

    Each row's own mean is taken off first; wavelengths of ``longest`` and more, and rows with a
    missing value, are left out.
    """
    line = F.struct(*[F.col(c) for c in keys], F.col("lat_i"))
    rows = fields.select(line.alias("t"), F.col("lon_i").alias("x"), "v")
    rows = rows.withColumn("v", F.col("v") - F.avg("v").over(Window.partitionBy("t")))
    waves = dft(rows, "v", n_lon, dx).where((F.col("k") > 0) & (F.col("wvlen") < longest))
    size = F.col("radius") * n_lon
    out = waves.groupBy(*[F.col("t")[c].alias(c) for c in keys], "k").agg(F.first("wvlen").alias("wvlen"), F.avg(size * size).alias("density"))
    return out.withColumn("log_density", F.when(F.col("density") > 0, F.log10("density")))


def variance_fraction(spectrum: DataFrame, drop: int = 0) -> DataFrame:
    """t, k, frac, log_amp: share of each harmonic above ``drop`` in their total variance."""
    kept = spectrum.where(F.col("k") > drop)
    power = F.col("radius") * F.col("radius")
    return kept.select(
        "t", "k", F.try_divide(power, F.sum(power).over(Window.partitionBy("t"))).alias("frac"),
        F.when(F.col("radius") > 0, F.ln("radius")).alias("log_amp"),
    )


def band_of(wvlen: Column, bands: list[tuple[float, float]] = BANDS) -> Column:
    band = F.lit("no_group")
    for low, high in reversed(bands):
        band = F.when((wvlen >= low) & (wvlen < high), f"{low:g}-{high:g}").otherwise(band)
    return band


def band_variance(spectrum: DataFrame) -> DataFrame:
    """t, band, frac: share of each wavelength band in the total variance of k > 0."""
    rows = spectrum.where("k > 0").groupBy("t", band_of(F.col("wvlen")).alias("band")).agg(F.sum(F.col("radius") * F.col("radius")).alias("p"))
    return rows.select("t", "band", F.try_divide(F.col("p"), F.sum("p").over(Window.partitionBy("t"))).alias("frac"))


def gradient(rows: DataFrame, dx: float = 1.0) -> DataFrame:
    """t, x_mid, g: forward differences at middles."""
    ahead = Window.partitionBy("t").orderBy("x")
    made = rows.select(
        "t", ((F.lead("x").over(ahead) + F.col("x")) / 2.0).alias("x_mid"), ((F.lead("v").over(ahead) - F.col("v")) / dx).alias("g")
    )
    return made.where("x_mid IS NOT NULL")


def histogram(rows: DataFrame, value: str, width: float) -> DataFrame:
    return rows.where(F.col(value).isNotNull()).groupBy(F.floor(F.col(value) / width).cast("int").alias("bin")).agg(F.count("*").alias("n"))


def fill_ends(rows: DataFrame) -> DataFrame:
    """t, x, v: values before the first and after the last present one take its value; gaps inside stay."""
    whole = Window.partitionBy("t").orderBy("x").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    here = F.when(F.col("v").isNotNull(), F.col("x"))
    first_x, last_x = F.min(here).over(whole), F.max(here).over(whole)
    first_v, last_v = F.first("v", ignorenulls=True).over(whole), F.last("v", ignorenulls=True).over(whole)
    filled = F.when(F.col("x") < first_x, first_v).when(F.col("x") > last_x, last_v).otherwise(F.col("v"))
    return rows.select("t", "x", filled.alias("v"))


def autocorrelation(rows: DataFrame, lags: int) -> DataFrame:
    """s, lag, c: sums of products of the unit-norm series s at each lag; rows (s, t, v) with whole t.

    A series is one row: padded with as many zeros as there are lags, its power spectrum turned back
    gives all lags at once.  Lags at which no two values meet have no row; missing values count as
    absent, and c is null where the norm is 0.
    """

    @F.pandas_udf("array<struct<lag: int, c: double>>")
    def turned(places: pd.Series, values: pd.Series) -> pd.Series:
        out = []
        for t, v in zip(places, values):
            t = np.asarray(t) - min(t)
            n = int(t.max()) + 1
            size = 1 << int(n + min(lags, n)).bit_length()
            series, held = np.zeros(n), np.zeros(n)
            np.add.at(series, t, v)
            held[t] = 1.0
            at = np.arange(min(lags, n - 1) + 1)
            both = lambda x: np.fft.irfft(np.abs(np.fft.rfft(x, size)) ** 2, size)[at]
            norm = float(series @ series)
            sums = both(series) / norm if norm else np.full(len(at), np.nan)
            met = both(held) > 0.5
            out.append([{"lag": int(k), "c": float(c) if norm else None} for k, c in zip(at[met], sums[met])])
        return pd.Series(out)

    line = F.sort_array(F.collect_list(F.struct(F.col("t").cast("long").alias("t"), F.col("v").cast("double").alias("v"))))
    series = rows.where(F.col("v").isNotNull()).groupBy("s").agg(line.alias("line"))
    return series.select("s", F.inline(turned(F.col("line.t"), F.col("line.v"))))
