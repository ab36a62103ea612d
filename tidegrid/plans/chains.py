"""Registered queries of whole chains, modes on fields, axes and spans, with their oracle SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidegrid.functions import pentad
from tidegrid.operators import chains, eof, fields, series
from tidegrid.plans import adapters as a
from tidegrid.plans.oracles import NUDGE, _r as rounded, _with
from tidegrid.sources import tiers
from tidegrid.sources.shared import work_folder

AXES = {"lat": [10.0 + 2.0 * i for i in range(10)], "lon": [120.0 + 2.5 * i for i in range(7)]}
BOX_LAT, BOX_LON, STEP = (12.0, 27.0), (122.0, 134.0), 0.8
MODES, TURNS = 3, 400
LAGS = 300
APART = 0.01


def _round(df: DataFrame, *columns: str) -> DataFrame:
    return df.withColumns({c: F.round(F.col(c) + F.lit(NUDGE), 6) + F.lit(0.0) for c in columns})


def _yearly(spark: SparkSession, sf_dir: str) -> DataFrame:
    """ds, pentadstamp (first of the year), lat_i, lon_i from 0, v."""
    rows = a.obs(spark, sf_dir).groupBy("ds", (F.year("d") * pentad.PENTADS).alias("pentadstamp"), "lat_i", (F.col("lon_i") - 1).alias("lon_i"))
    return rows.agg(F.avg("v").alias("v"))


def crop_regrid(spark, sf_dir):
    """Yearly fields cropped, interpolated, stored as a cropped tier and read back."""
    rows = chains.crop_regrid(_yearly(spark, sf_dir), ["ds", "pentadstamp"], AXES, BOX_LAT, BOX_LON, STEP)
    path = tiers.tier_path(work_folder(spark), "cropped", "sst", "box")
    tiers.write_tier(rows.withColumnRenamed("ds", "dataset"), path)
    back = spark.read.parquet(path).withColumn("pentadstamp", (F.col("year") * pentad.PENTADS + F.col("pentad")).cast("int"))
    return _round(back.select(F.col("dataset").cast("string").alias("dataset"), "pentadstamp", "lat_i", "lon_i", "lat", "lon", "v"), "lat", "lon", "v")


def crop_profile(spark, sf_dir):
    rows = chains.crop_profile(_yearly(spark, sf_dir), ["ds", "pentadstamp"], AXES, BOX_LAT, BOX_LON, "lat", STEP)
    return _round(rows, "x", "v")


def _mean_year(spark, sf_dir):
    """ds, pentadstamp (pentad of the mean year), lat_i, lon_i, v."""
    rows = a.clim(spark, sf_dir)
    return rows.select("ds", F.col("lat_i").alias("pentadstamp"), F.floor(F.col("lon_i") / 7).cast("int").alias("lat_i"), F.pmod("lon_i", F.lit(7)).cast("int").alias("lon_i"), "v")


def field_spectrum(spark, sf_dir):
    """Spectra of the fields' profiles along latitude, stored as a spectral tier and read back."""
    rows = chains.spectrum(_mean_year(spark, sf_dir), ["ds", "pentadstamp"], AXES, (10.0, 28.0), (120.0, 130.0), "lat")
    path = tiers.tier_path(work_folder(spark), "spectral", "sst", "lat")
    tiers.write_tier(rows.withColumnRenamed("ds", "dataset"), path)
    back = spark.read.parquet(path).withColumn("pentadstamp", (F.col("year") * pentad.PENTADS + F.col("pentad")).cast("int"))
    return _round(back.select(F.col("dataset").cast("string").alias("dataset"), "pentadstamp", "k", "re", "im", "radius", "wvlen"), "re", "im", "radius", "wvlen")


def _pair(spark, sf_dir, most_samples: int = eof.MOST_SAMPLES):
    rows = _yearly(spark, sf_dir)
    return eof.of_differences(rows, ["A", "N"], rows, MODES, "all", 0, None, most_samples)


def eof_pair_variance(spark, sf_dir):
    """Shares of the leading modes of one pair's differences, not smoothed."""
    return _round(_pair(spark, sf_dir)[2].select("mode", "share", "share_of_kept"), "share", "share_of_kept")


def eof_pair_pcs(spark, sf_dir):
    """The first mode's amplitude in each sample, in thousands."""
    return _round(_pair(spark, sf_dir)[1].where("mode = 0").select("sample", (F.col("pc") / 1e3).alias("pc")), "pc")


def eof_pair_view(spark, sf_dir):
    """The first mode as it is displayed: over three standard deviations, on the whole grid."""
    maps = _pair(spark, sf_dir)[0].where("mode = 0").withColumn("cell", F.struct("lat_i", "lon_i"))
    return _round(eof.normalised(maps.select("mode", "cell", "v")).select("cell.*", "v"), "v")


def eof_random_range(spark, sf_dir):
    """The same shares when every sample count is too many for the Gram matrix."""
    return _round(_pair(spark, sf_dir, 0)[2].select("mode", "share"), "share")


def autocorr_long(spark, sf_dir):
    """Hourly counts of each event type over hundreds of lags."""
    hours = a.events(spark, sf_dir).groupBy(F.col("ds").alias("s"), pentad.hours_since(F.date_trunc("HOUR", "ts")).alias("t")).agg(F.count("*").cast("double").alias("v"))
    return _round(series.autocorrelation(hours, LAGS), "c")


def interval_orders(spark, sf_dir):
    """Every order is a span of days; each shipping day gets the first order that holds it."""
    key = F.col("o_orderkey")
    orders = spark.read.parquet(f"{sf_dir}/orders.parquet")
    beg = F.to_date("o_orderdate")
    order = F.pmod(key * 7919, F.lit(1_000_003)) * 10_000_000 + key
    spans = orders.select(order.alias("ord"), key.cast("string").alias("name"), beg.alias("beg"), F.date_add(beg, F.pmod(key, F.lit(90)).cast("int")).alias("end"))
    return fields.first_interval(a.obs(spark, sf_dir).select("d").distinct(), spans, strict=False)


def axis_findings(spark, sf_dir):
    """Axes of two datasets, one for each pentad of the mean year; the second's are stretched a little."""
    rows = a.clim(spark, sf_dir).where("ds IN ('A', 'R') AND NOT (ds = 'R' AND (lat_i + lon_i) % 9 = 4) AND NOT (ds = 'A' AND (lat_i * 3 + lon_i) % 11 = 5)")
    c = 120.0 + 2.0 * F.col("lon_i") + F.when((F.col("ds") == "R") & (F.col("lon_i") % 5 == 0), 0.004).otherwise(0.0)
    ranks = F.row_number().over(fields.Window.partitionBy("ds", "lat_i").orderBy("lon_i")) - 1
    axes = rows.select("ds", F.col("lat_i").alias("axis"), c.alias("c"), ranks.alias("i"))
    own = lambda ds: axes.where(F.col("ds") == ds).drop("ds")
    found = fields.match_axes(own("A"), own("R"), ["axis"], APART)
    none = lambda c: F.coalesce(c, F.lit(-1)).alias(c)
    return _round(found.select("axis", none("ours_i"), none("theirs_i"), none("ours"), none("theirs"), "finding"), "ours", "theirs")


QUERIES = {
    "crop_regrid": crop_regrid,
    "crop_profile": crop_profile,
    "field_spectrum": field_spectrum,
    "eof_pair_variance": eof_pair_variance,
    "eof_pair_pcs": eof_pair_pcs,
    "eof_pair_view": eof_pair_view,
    "eof_random_range": eof_random_range,
    "autocorr_long": autocorr_long,
    "interval_orders": interval_orders,
    "axis_findings": axis_findings,
}


def _weights(name: str, low: float, high: float, origin: float, step: float) -> str:
    """t, s, w of the points low, low + STEP, ... below high on the axis origin + step * s, cropped to [low, high]."""
    first, last = f"ceil(({low} - {origin}) / {step}::DOUBLE)", f"floor(({high} - {origin}) / {step}::DOUBLE)"
    return (
        f"{name}0 AS (SELECT CAST(t AS INTEGER) AS t, ({low} + t * {STEP} - {origin})::DOUBLE / {step} AS pos FROM range(1000) r(t) WHERE {low} + t * {STEP} < {high} - 1e-9), "
        f"{name}1 AS (SELECT t, pos, least(floor(pos + 1e-9), {last} - 1) AS f FROM {name}0 WHERE pos >= {first} - 1e-9 AND pos <= {last} + 1e-9), "
        f"{name} AS (SELECT * FROM (SELECT t, f AS s, 1 - (pos - f) AS w FROM {name}1 UNION ALL SELECT t, f + 1, pos - f FROM {name}1) q WHERE abs(w) > 1e-9)"
    )


_YEARS = "fy AS (SELECT ds, CAST(yr * 73 AS INTEGER) AS pentadstamp, lat_i, CAST(lon_i - 1 AS INTEGER) AS lon_i, v FROM yearly)"
_WHOLE = rounded("CASE WHEN sum(CASE WHEN v IS NOT NULL THEN {w} END) > 1 - 1e-6 THEN sum({w} * v) END", "v")
_PAIR = (
    "dd AS MATERIALIZED (SELECT CAST(s.rank AS INTEGER) AS sample, a.lat_i, a.lon_i - 1 AS lon_i, b.v - a.v AS v FROM yearly a JOIN yearly b ON a.ds = 'A' AND b.ds = 'N' AND b.yr = a.yr AND b.lat_i = a.lat_i AND b.lon_i = a.lon_i JOIN stamps s ON s.yr = a.yr), "
    "an AS MATERIALIZED (SELECT sample, lat_i, lon_i, v - avg(v) OVER cell AS v FROM dd WINDOW cell AS (PARTITION BY lat_i, lon_i) QUALIFY count(*) OVER cell = (SELECT max(n) FROM stamps)), "
    "pg AS MATERIALIZED (SELECT a.sample AS s, b.sample AS t, sum(a.v * b.v) / 1e6 AS g FROM an a JOIN an b ON b.lat_i = a.lat_i AND b.lon_i = a.lon_i GROUP BY ALL), "
    "rows0(s, r) AS MATERIALIZED (SELECT s, list(g ORDER BY t) FROM pg GROUP BY s), whole AS (SELECT sum(g) AS total FROM pg WHERE s = t)"
)


def _mode(k: int) -> str:
    """Mode k by power iteration on what the modes before it leave of the Gram matrix."""
    return (
        f"m{k}(r) AS MATERIALIZED (SELECT list(r ORDER BY s) FROM rows{k}), "
        f"it{k}(n, x, size) AS (SELECT 0, list_transform(range(CAST(len(r) AS BIGINT)), lambda i: 1.0::DOUBLE + i % 3), 0.0::DOUBLE FROM m{k} UNION ALL SELECT n + 1, list_transform(y, lambda e: e / sqrt(list_dot_product(y, y))), sqrt(list_dot_product(y, y)) FROM (SELECT n, list_transform(r, lambda g: list_dot_product(g, x)) AS y FROM it{k}, m{k} WHERE n < {TURNS * 10})), "
        f"u{k} AS MATERIALIZED (SELECT x, size FROM it{k} WHERE n = {TURNS * 10}), "
        f"rows{k + 1}(s, r) AS MATERIALIZED (SELECT s, list_transform(r, lambda g, i: g - size * x[s + 1] * x[i]) FROM rows{k}, u{k})"
    )


_MODES = ", ".join(_mode(k) for k in range(MODES))
_FIRST = (
    "p AS (SELECT lat_i, lon_i, sum(v * x[sample + 1]) / sqrt(any_value(size) * 1e6) AS v FROM an, u0 GROUP BY ALL), "
    "sg AS (SELECT CASE WHEN count(*) FILTER (v < 0) > count(*) FILTER (v >= 0) THEN -1 ELSE 1 END AS sign FROM p)"
)
_SHARES = " UNION ALL ".join(f"SELECT {k} AS mode, size / total AS share, size AS own FROM u{k}, whole" for k in range(MODES))


def _recursive(text: str) -> str:
    return "WITH RECURSIVE " + text.removeprefix("WITH ")


ORACLES = {
    "crop_regrid": _with("yearly", more=_YEARS + ", " + _weights("wy", *BOX_LAT, 10, 2) + ", " + _weights("wx", *BOX_LON, 120, 2.5),
        body=f"SELECT ds AS dataset, pentadstamp, y.t AS lat_i, x.t AS lon_i, {rounded(f'any_value({BOX_LAT[0]} + y.t * {STEP})::DOUBLE', 'lat')}, {rounded(f'any_value({BOX_LON[0]} + x.t * {STEP})::DOUBLE', 'lon')}, {_WHOLE.format(w='y.w * x.w')} FROM fy JOIN wy y ON y.s = lat_i JOIN wx x ON x.s = lon_i GROUP BY ds, pentadstamp, y.t, x.t"),
    "crop_profile": _with("yearly", more=_YEARS + ", " + _weights("wy", *BOX_LAT, 10, 2) + f", prof AS (SELECT ds, pentadstamp, lat_i, avg(v) AS v FROM fy WHERE 120 + 2.5 * lon_i BETWEEN {BOX_LON[0]} AND {BOX_LON[1]} AND 10 + 2 * lat_i BETWEEN {BOX_LAT[0]} AND {BOX_LAT[1]} GROUP BY ALL)",
        body=f"SELECT ds, pentadstamp, t AS x_i, {rounded(f'any_value({BOX_LAT[0]} + t * {STEP})::DOUBLE', 'x')}, {_WHOLE.format(w='w')} FROM prof JOIN wy ON s = lat_i GROUP BY ds, pentadstamp, t"),
    "field_spectrum": _with("clim", more="pr AS (SELECT ds, lat_i AS p, lon_i // 7 AS x, avg(v) AS v FROM clim WHERE lon_i % 7 <= 4 GROUP BY ALL), full_ AS (SELECT ds, p FROM pr GROUP BY ALL HAVING count(*) = 10), "
        "de AS (SELECT ds, p, x, v - (regr_slope(v, x) OVER w * x + regr_intercept(v, x) OVER w) AS v FROM pr SEMI JOIN full_ USING (ds, p) WINDOW w AS (PARTITION BY ds, p)), "
        "sp AS (SELECT ds, p, CAST(k AS INTEGER) AS k, sum(v * cos(2 * pi() * ((k * x) % 10) / 10)) / 10 AS re, -sum(v * sin(2 * pi() * ((k * x) % 10) / 10)) / 10 AS im FROM de, range(5) r(k) GROUP BY ALL)",
        body=f"SELECT ds AS dataset, p AS pentadstamp, k, {rounded('re')}, {rounded('im')}, {rounded('sqrt(re * re + im * im)', 'radius')}, {rounded('CASE WHEN k > 0 THEN 20.0::DOUBLE / k END', 'wvlen')} FROM sp"),
    "eof_pair_variance": _recursive(_with("yearly", "stamps", more=_PAIR + ", " + _MODES + f", sh AS ({_SHARES})", body=f"SELECT CAST(mode AS INTEGER) AS mode, {rounded('share')}, {rounded('own / sum(own) OVER ()', 'share_of_kept')} FROM sh")),
    "eof_pair_pcs": _recursive(_with("yearly", "stamps", more=_PAIR + ", " + _MODES + ", " + _FIRST, body=f"SELECT CAST(i AS INTEGER) AS sample, {rounded('sqrt(size) * x[i + 1] * sign', 'pc')} FROM u0, sg, range(1000) r(i) WHERE i < len(x)")),
    "eof_pair_view": _recursive(_with("yearly", "stamps", more=_PAIR + ", " + _MODES + ", " + _FIRST, body=f"SELECT CAST(g.lat_i AS INTEGER) AS lat_i, CAST(g.lon_i AS INTEGER) AS lon_i, {rounded('p.v * sign / (3 * stddev_pop(p.v) OVER ())', 'v')} FROM (SELECT DISTINCT lat_i, lon_i - 1 AS lon_i FROM yearly) g LEFT JOIN p ON p.lat_i = g.lat_i AND p.lon_i = g.lon_i, sg")),
    "eof_random_range": _recursive(_with("yearly", "stamps", more=_PAIR + ", " + _MODES + f", sh AS ({_SHARES})", body=f"SELECT CAST(mode AS INTEGER) AS mode, {rounded('share')} FROM sh")),
    "autocorr_long": _with("ev", more="n AS (SELECT ds, date_diff('hour', TIMESTAMP '2000-01-01', date_trunc('hour', ts)) AS t, count(*)::DOUBLE AS v FROM ev GROUP BY ALL), u AS (SELECT ds, t, v / sqrt(sum(v * v) OVER (PARTITION BY ds)) AS u FROM n)",
        body=f"SELECT a.ds AS s, CAST(b.t - a.t AS INTEGER) AS lag, {rounded('sum(a.u * b.u)', 'c')} FROM u a JOIN u b ON a.ds = b.ds AND b.t - a.t BETWEEN 0 AND {LAGS} GROUP BY ALL"),
    "interval_orders": _with("obs", more="s AS (SELECT CAST(o_orderkey AS VARCHAR) AS name, o_orderkey * 7919 % 1000003 * 10000000 + o_orderkey AS ord, CAST(o_orderdate AS DATE) AS beg, CAST(o_orderdate AS DATE) + CAST(o_orderkey % 90 AS INTEGER) AS fin FROM orders), p AS (SELECT DISTINCT d FROM obs)",
        body="SELECT d, arg_min(name, ord) AS name FROM p LEFT JOIN s ON d BETWEEN beg AND fin GROUP BY d"),
    "axis_findings": _with("clim", more="c AS (SELECT ds, lat_i AS axis, lon_i, 120.0::DOUBLE + 2 * lon_i + CASE WHEN ds = 'R' AND lon_i % 5 = 0 THEN 0.004 ELSE 0 END AS c, CAST(row_number() OVER (PARTITION BY ds, lat_i ORDER BY lon_i) - 1 AS INTEGER) AS i FROM clim "
        "WHERE ds IN ('A', 'R') AND NOT (ds = 'R' AND (lat_i + lon_i) % 9 = 4) AND NOT (ds = 'A' AND (lat_i * 3 + lon_i) % 11 = 5)), a AS (SELECT * FROM c WHERE ds = 'A'), b AS (SELECT * FROM c WHERE ds = 'R')",
        body=f"SELECT coalesce(a.axis, b.axis) AS axis, coalesce(a.i, -1) AS ours_i, coalesce(b.i, -1) AS theirs_i, {rounded('coalesce(a.c, -1)', 'ours')}, {rounded('coalesce(b.c, -1)', 'theirs')}, CASE WHEN b.i IS NULL THEN 'gap' WHEN a.i IS NULL THEN 'extra' WHEN a.i <> b.i THEN 'shifted' WHEN a.c <> b.c THEN 'moved' ELSE 'same' END AS finding FROM a FULL JOIN b ON a.axis = b.axis AND a.lon_i = b.lon_i"),
}
