"""Registered queries through files, tiers, units of work and streams, with their oracle SQL."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidegrid.functions import pentad
from tidegrid.operators import fields
from tidegrid.plans import adapters as a
from tidegrid.plans.oracles import NUDGE, _r as rounded, _with
from tidegrid.sources import clustered, matfile, netcdf, rawgrid, tiers, units
from tidegrid.sources.shared import work_folder
from tidegrid.streaming import strict

LAT, LON = [10.0 + 2.0 * i for i in range(10)], [120.0 + 2.5 * i for i in range(7)]
CROP_LAT, CROP_LON = (14.0, 22.0), (127.0, 133.0)  # places 2 to 6 and 3 to 5
TILE_LEVEL = 4
BOX_LAT, BOX_LON = (20, 45), (10, 40)
TOO_HIGH, TOO_LOW, HELD_UNTIL = 103500.0, 2500.0, 1997
DELAY_DAYS, RUNS = 400, 5


def _round(df: DataFrame, *columns: str) -> DataFrame:
    return df.withColumns({c: F.round(F.col(c) + F.lit(NUDGE), 6) + F.lit(0.0) for c in columns})


def _pen(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fields.pentad_mean(a.obs(spark, sf_dir)).withColumn("lon_i", F.col("lon_i") - 1)


def _netcdf(spark: SparkSession, sf_dir: str) -> str:
    """A file for each dataset and year, pentads as records, latitudes and longitudes as axes."""
    path = work_folder(spark)
    rows = _pen(spark, sf_dir).withColumn("file", F.concat("ds", F.lit("_"), pentad.year_of(F.col("pentadstamp"))))
    netcdf.write_netcdf(rows.withColumn("time", F.col("pentadstamp")), path, {"lat": LAT, "lon": LON}, "sst")
    return path


def _cropped(rows: DataFrame) -> DataFrame:
    return rows.where(F.col("lat").between(*CROP_LAT) & F.col("lon").between(*CROP_LON))


def netcdf_crop(spark, sf_dir):
    """A box of all files' fields, read by its byte ranges."""
    rows = _cropped(netcdf.read_netcdf(spark, _netcdf(spark, sf_dir), "sst")).where("v IS NOT NULL")
    return _round(rows.select(F.substring("file", 1, 1).alias("ds"), F.col("time").cast("int").alias("pentadstamp"), "lat_i", "lon_i", "lat", "lon", "v"), "v")


def netcdf_bytes(spark, sf_dir):
    """Bytes of values that each file has, and that a box of it takes when no gap is read over."""
    path = _netcdf(spark, sf_dir)
    cells = netcdf.read_netcdf(spark, path, "sst").groupBy("file").agg(F.count("*").alias("whole_cells"))
    box = netcdf.read_box_report(spark, path, "sst", {"lat": CROP_LAT, "lon": CROP_LON}, gap=0, piecebytes=2048)
    box = box.groupBy("file").agg(F.sum("cells").alias("cells"), F.sum("bytes").alias("bytes"))
    return cells.join(box, "file").select(F.split("file", "[.]")[0].alias("file"), "whole_cells", "cells", "bytes")


def netcdf_pentads(spark, sf_dir):
    """Pentad means of daily fields that come as files: a file a dataset and year, days as records, read whole."""
    path = work_folder(spark)
    days = a.obs(spark, sf_dir).groupBy("ds", "d", "lat_i", (F.col("lon_i") - 1).alias("lon_i")).agg(F.avg("v").alias("v"))
    days = days.withColumns({"file": F.concat("ds", F.lit("_"), F.year("d")), "time": F.datediff("d", F.lit("1990-01-01").cast("date"))})
    netcdf.write_netcdf(days, path, {"lat": LAT, "lon": LON}, "sst")
    back = netcdf.read_netcdf(spark, path, "sst").where("v IS NOT NULL")
    daily = back.select(F.substring("file", 1, 1).alias("ds"), F.date_add(F.lit("1990-01-01").cast("date"), F.col("time").cast("int")).alias("d"), "lat_i", "lon_i", "v")
    return _round(fields.pentad_mean(daily), "v")


def _levels(spark, sf_dir):
    """ds, step (year), k (halves of the year), lat_i, lon_i, v."""
    rows = a.obs(spark, sf_dir).groupBy("ds", F.year("d").alias("step"), F.floor((F.month("d") - 1) / 6).cast("int").alias("k"), "lat_i", (F.col("lon_i") - 1).alias("lon_i"))
    return rows.agg(F.avg("v").alias("v"))


def raw_roundtrip(spark, sf_dir):
    """A raw file for each dataset and year with its metadata, of which a box is read back."""
    path = work_folder(spark)
    rows = _levels(spark, sf_dir).withColumnRenamed("ds", "variable")
    rawgrid.write_raw(rows, path, {"k": 2, "lat_i": len(LAT), "lon_i": len(LON)})
    back = rawgrid.read_raw(spark, path).where("lat_i BETWEEN 3 AND 7 AND lon_i >= 2 AND k_i = 1")
    name = F.split("file", "[.]")
    return back.select(name[0].alias("ds"), name[1].cast("int").alias("step"), "lat_i", "lon_i", F.round("v", 1).alias("v"))


def mat_roundtrip(spark, sf_dir):
    """A MATLAB file for each dataset and year with two fields and a bottom level, of which a box is read back."""
    path = work_folder(spark)
    rows = _levels(spark, sf_dir).select(F.col("ds").alias("name"), F.col("step").alias("date"), "k", "lat_i", "lon_i", "v")
    both = F.explode(F.array(F.struct(F.lit("water_temp").alias("n"), F.col("v").alias("v")), F.struct(F.lit("salinity").alias("n"), (F.col("v") / 1000).alias("v"))))
    rows = rows.withColumn("f", both).select("name", "date", F.col("f.n").alias("variable"), "k", "lat_i", "lon_i", F.col("f.v").alias("v"))
    matfile.write_mat(rows, path, {"depth": [0.0, -10.0], "lat": LAT, "lon": LON}, ["water_temp", "salinity"])
    back = matfile.read_mat(spark, path, "salinity").where(F.col("lat").between(*CROP_LAT) & (F.col("depth") <= -10.0))
    name = F.split("file", "[.]")
    return _round(back.select(name[0].alias("ds"), name[1].cast("int").alias("step"), "depth", "lat_i", "lon_i", "v"), "v")


def _unit_work(rows: pd.DataFrame) -> pd.DataFrame:
    """Means of the cells of a pentad; a value that cannot be is an error, a mean that is too low is left out."""
    if (rows["v"] > TOO_HIGH).any():
        raise ValueError(f"values above {TOO_HIGH:.0f}")
    out = rows.groupby(["lat_i", "lon_i"], as_index=False).agg(v=("v", "mean"), n=("v", "count"))
    return out[out["v"] >= TOO_LOW]


def unit_manifest(spark, sf_dir):
    """Every pentad of every dataset worked on alone; early years are committed, one year is half written."""
    path = work_folder(spark)
    rows = a.obs(spark, sf_dir).withColumn("pentadstamp", pentad.stamp_of(F.col("d"))).where("pentadstamp IS NOT NULL").withColumnRenamed("ds", "dataset")
    rows = rows.withColumn("part", (F.col("lat_i") >= 5).cast("int"))
    planned = rows.select("dataset", "pentadstamp", "lat_i", "lon_i").distinct().groupBy("dataset", "pentadstamp").agg(F.count("*").alias("cells"))
    before = F.col("pentadstamp") < HELD_UNTIL * pentad.PENTADS
    fill = lambda plan: units.fill_units(plan, rows, path, _unit_work, "lat_i int, lon_i int, v double, n long")
    fill(planned.where(before))
    half = rows.where(~before & (F.col("pentadstamp") < (HELD_UNTIL + 1) * pentad.PENTADS) & (F.col("part") == 0)).groupBy("dataset", "pentadstamp", "lat_i", "lon_i")
    tiers.write_tier(half.agg(F.avg("v").alias("v"), F.count("v").alias("n")), path, overwrite=True)
    manifest = fill(planned)
    held = units.read_units(spark, path).groupBy("dataset", "pentadstamp").agg(F.count("*").alias("stored"), F.sum("v").alias("total"))
    out = manifest.join(held, ["dataset", "pentadstamp"], "left")
    return _round(out.select("dataset", "pentadstamp", "status", "reason", F.coalesce("stored", F.lit(0).cast("long")).alias("stored"), (F.col("total") / 1e6).alias("total")), "total")


def _arrivals(spark, sf_dir):
    """Days with the run that brings them: two years a run, every fifth day a run later."""
    rows = a.obs(spark, sf_dir)
    run = F.floor((F.year("d") - 1995) / 2) + F.when(F.pmod(F.dayofyear("d") * 7 + F.ascii("ds"), F.lit(5)) == 0, 1).otherwise(0)
    return rows.withColumn("run", run.cast("int"))


def strict_stream(spark, sf_dir):
    """Strict pentads from out-of-order files in five runs."""
    path = work_folder(spark)
    arrivals = _arrivals(spark, sf_dir)
    schema = arrivals.drop("run").schema
    for n in range(RUNS):
        arrivals.where(F.col("run") == n).drop("run").write.mode("append").parquet(f"{path}/in")
        strict.run(spark.readStream.schema(schema).parquet(f"{path}/in"), path, f"{DELAY_DAYS} days", blocks=2)
    out = spark.read.parquet(f"{path}/pentads")
    none = lambda c, v: F.when(F.col("status") == "dropped", F.lit(v)).otherwise(F.col(c)).alias(c)
    return _round(out.select("ds", "pentadstamp", "status", none("lat_i", -1), none("lon_i", -1), none("v", 0.0), none("n", 0), "days"), "v")


def _clustered(spark, sf_dir) -> str:
    path = work_folder(spark)
    rows = a.dense(spark, sf_dir).where("v IS NOT NULL").withColumn("pentadstamp", F.lit(2000 * pentad.PENTADS + 7)).withColumnRenamed("ds", "dataset")
    clustered.write_clustered(rows, path, TILE_LEVEL)
    return path


def clustered_crop(spark, sf_dir):
    rows = clustered.read_box(spark, _clustered(spark, sf_dir), BOX_LAT, BOX_LON, TILE_LEVEL)
    return _round(rows.select(F.col("dataset").cast("string").alias("dataset"), "pentadstamp", "lat_i", "lon_i", "v"), "v")


def clustered_files(spark, sf_dir):
    """Files of a tier and those that a box of it reads."""
    path = _clustered(spark, sf_dir)
    names = lambda rows, name: rows.select("dataset", F.input_file_name().alias("file")).groupBy("dataset").agg(F.count_distinct("file").alias(name))
    box = clustered.read_box(spark, path, BOX_LAT, BOX_LON, TILE_LEVEL)
    files = clustered.files_of(spark, path).groupBy("dataset").agg(F.count("*").alias("files"), F.max("rows").alias("most_rows"))
    return files.join(names(box, "files_read"), "dataset").select(F.col("dataset").cast("string").alias("dataset"), "files", "most_rows", "files_read")


def _two_years(spark, sf_dir) -> str:
    """A cropped tier with the mean year as 2000, and doubled as 2001."""
    rows = a.clim(spark, sf_dir).select(F.col("ds").alias("dataset"), F.col("lat_i").alias("p"), F.col("lon_i"), "v")
    rows = rows.select("dataset", F.explode(F.array(F.lit(0), F.lit(1))).alias("y"), "p", "lon_i", "v")
    rows = rows.select("dataset", ((F.lit(2000) + F.col("y")) * pentad.PENTADS + F.col("p")).cast("int").alias("pentadstamp"), "lon_i", (F.col("v") * (F.col("y") + 1)).alias("v"))
    path = tiers.tier_path(work_folder(spark), "cropped", "sst", "year")
    tiers.write_tier(rows, path)
    return path


def _plain(rows: DataFrame) -> DataFrame:
    return _round(rows.select(F.col("dataset").cast("string").alias("dataset"), "pentadstamp", "lon_i", "v"), "v")


def _stamped(spark, path) -> DataFrame:
    return spark.read.parquet(path).withColumn("pentadstamp", (F.col("year") * pentad.PENTADS + F.col("pentad")).cast("int"))


def tier_range(spark, sf_dir):
    """Two datasets' pentads across a new year."""
    return _plain(tiers.read_range(spark, _two_years(spark, sf_dir), "2000P60", "2001P10", "left", ["A", "R"]))


def tier_year(spark, sf_dir):
    return _plain(tiers.read_year(spark, _two_years(spark, sf_dir), 2001))


def tier_many(spark, sf_dir):
    """Fields of two tiers as one table; the second has a column more."""
    first = _two_years(spark, sf_dir)
    rows = _stamped(spark, first).where("year = 2001")
    second = tiers.tier_path(work_folder(spark), "physical", "sst")
    tiers.write_tier(rows.select("dataset", (F.col("pentadstamp") + 73).alias("pentadstamp"), "lon_i", "v", F.lit(1).alias("more")), second)
    both = tiers.read_many(spark, [first, second])
    return both.groupBy(F.col("dataset").cast("string").alias("dataset"), "year").agg(F.count("*").alias("n"), F.count("more").alias("more"), F.round(F.sum("v") / 1e6, 4).alias("total"))


def whole_output(spark, sf_dir):
    """An output that is one unit: written, left alone when it is there, replaced on demand."""
    path = work_folder(spark)
    rows = a.clim(spark, sf_dir).groupBy("ds").agg(F.avg("v").alias("v"))
    tagged = lambda name: rows.withColumn("made_by", F.lit(name))
    tiers.write_whole(tagged("first"), path)
    tiers.write_whole(tagged("second"), path)
    kept = spark.read.parquet(path).select("ds", "v", F.col("made_by").alias("kept"))
    other = f"{path}-other"
    tiers.write_whole(tagged("first"), other)
    tiers.write_whole(tagged("third"), other, overwrite=True)
    return _round(kept.join(spark.read.parquet(other).select("ds", F.col("made_by").alias("replaced")), "ds"), "v")


QUERIES = {
    "netcdf_crop": netcdf_crop,
    "netcdf_bytes": netcdf_bytes,
    "netcdf_pentads": netcdf_pentads,
    "raw_roundtrip": raw_roundtrip,
    "mat_roundtrip": mat_roundtrip,
    "unit_manifest": unit_manifest,
    "strict_stream": strict_stream,
    "clustered_crop": clustered_crop,
    "clustered_files": clustered_files,
    "tier_range": tier_range,
    "tier_year": tier_year,
    "tier_many": tier_many,
    "whole_output": whole_output,
}

_TWO = "two AS (SELECT ds AS dataset, CAST((2000 + y) * 73 + lat_i AS INTEGER) AS pentadstamp, lon_i, v * (y + 1) AS v FROM clim, range(2) r(y))"
_TWO_OUT = f"SELECT dataset, pentadstamp, lon_i, {rounded('v')} FROM two WHERE "
_ARRIVED = "arrived AS (SELECT *, (year(d) - 1995) // 2 + CASE WHEN (dayofyear(d) * 7 + ascii(ds)) % 5 = 0 THEN 1 ELSE 0 END AS run FROM obs)"
_TILE = lambda y, x: f"(({y}) // 16) * 100 + ({x}) // 16"

ORACLES = {
    "netcdf_crop": _with("pen", body=f"SELECT ds, pentadstamp, lat_i, CAST(lon_i - 1 AS INTEGER) AS lon_i, 10.0::DOUBLE + 2 * lat_i AS lat, 120.0::DOUBLE + 2.5 * (lon_i - 1) AS lon, {rounded('v')} FROM pen WHERE lat_i BETWEEN 2 AND 6 AND lon_i BETWEEN 4 AND 6"),
    "netcdf_bytes": _with("pen", body="SELECT ds || '_' || pentadstamp // 73 AS file, count(DISTINCT pentadstamp) * 70 AS whole_cells, CAST(count(DISTINCT pentadstamp) * 15 AS BIGINT) AS cells, CAST(count(DISTINCT pentadstamp) * 15 * 8 AS BIGINT) AS bytes FROM pen GROUP BY ds, pentadstamp // 73"),
    "netcdf_pentads": _with("inyear", more="dm AS (SELECT ds, d, p, lat_i, lon_i - 1 AS lon_i, avg(v) AS v FROM inyear GROUP BY ALL)", body=f"SELECT ds, CAST(year(d) * 73 + p AS INTEGER) AS pentadstamp, lat_i, CAST(lon_i AS INTEGER) AS lon_i, {rounded('avg(v)', 'v')}, count(v) AS n FROM dm GROUP BY ds, year(d) * 73 + p, lat_i, lon_i"),
    "raw_roundtrip": _with("obs", more="m AS (SELECT ds, year(d) AS step, (month(d) - 1) // 6 AS k, lat_i, lon_i - 1 AS lon_i, avg(v) AS v FROM obs GROUP BY ALL), f AS (SELECT DISTINCT ds, step FROM m)",
        body="SELECT f.ds, CAST(f.step AS INTEGER) AS step, CAST(y AS INTEGER) AS lat_i, CAST(x AS INTEGER) AS lon_i, round(coalesce(v, 0)::FLOAT::DOUBLE, 1) AS v FROM f, range(3, 8) a(y), range(2, 7) b(x) LEFT JOIN m ON m.ds = f.ds AND m.step = f.step AND k = 1 AND lat_i = y AND lon_i = x"),
    "mat_roundtrip": _with("obs", more="m AS (SELECT ds, year(d) AS step, (month(d) - 1) // 6 AS k, lat_i, lon_i - 1 AS lon_i, avg(v) AS v FROM obs GROUP BY ALL), f AS (SELECT DISTINCT ds, step FROM m)",
        body=f"SELECT f.ds, CAST(f.step AS INTEGER) AS step, depth, CAST(y AS INTEGER) AS lat_i, CAST(x AS INTEGER) AS lon_i, {rounded('coalesce(v, 0) / 1000', 'v')} FROM f, range(2, 7) a(y), range(7) b(x), (VALUES (-10.0::DOUBLE), (-6500.0::DOUBLE)) z(depth) LEFT JOIN m ON m.ds = f.ds AND m.step = f.step AND k = 1 AND lat_i = y AND lon_i = x"),
    "unit_manifest": _with("inyear", more="cells AS (SELECT ds AS dataset, CAST(year(d) * 73 + p AS INTEGER) AS pentadstamp, lat_i, lon_i, avg(v) AS v, max(v) AS top FROM inyear GROUP BY ALL), "
        f"u AS (SELECT dataset, pentadstamp, count(*) AS planned, count(*) FILTER (v >= {TOO_LOW}) AS got, max(top) > {TOO_HIGH} AS bad, sum(v) AS total FROM cells GROUP BY ALL), "
        f"s AS (SELECT *, CASE WHEN bad OR got = 0 THEN 'failed' WHEN got < planned THEN 'partial' WHEN pentadstamp < {HELD_UNTIL} * 73 THEN 'skipped' ELSE 'made' END AS status FROM u)",
        body=f"SELECT dataset, pentadstamp, status, CASE WHEN bad THEN 'ValueError: values above {TOO_HIGH:.0f}' WHEN got = 0 THEN 'no cells' WHEN got < planned THEN got || ' of ' || planned || ' cells' END AS reason, "
        f"CASE WHEN status IN ('made', 'skipped') THEN got ELSE 0 END AS stored, {rounded('CASE WHEN status IN (' + chr(39) + 'made' + chr(39) + ', ' + chr(39) + 'skipped' + chr(39) + ') THEN total / 1e6 END', 'total')} FROM s"),
    "strict_stream": _with("obs", more=_ARRIVED + f", marks AS (SELECT run, max(max(d)) OVER (ORDER BY run ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) - {DELAY_DAYS} AS mark FROM arrived WHERE dayofyear(d) <= 365 GROUP BY run), "
        f"kept AS (SELECT ds, CAST(year(d) * 73 + (dayofyear(d) - 1) // 5 AS INTEGER) AS pentadstamp, d, lat_i, lon_i, v, mark IS NULL OR d > mark AS intime FROM arrived JOIN marks USING (run) WHERE dayofyear(d) <= 365), "
        f"whole AS (SELECT ds, pentadstamp, count(DISTINCT d) AS days, make_date(pentadstamp // 73, 1, 1) + CAST(pentadstamp % 73 * 5 + 5 AS INTEGER) AS ends FROM kept WHERE intime GROUP BY ALL)",
        body=f"SELECT k.ds, k.pentadstamp, 'complete' AS status, lat_i, lon_i, {rounded('avg(v)', 'v')}, count(v) AS n, CAST(5 AS INTEGER) AS days FROM kept k JOIN whole w ON w.ds = k.ds AND w.pentadstamp = k.pentadstamp WHERE intime AND days = 5 GROUP BY ALL "
        f"UNION ALL SELECT ds, pentadstamp, 'dropped', -1, -1, 0.0::DOUBLE, 0, CAST(days AS INTEGER) FROM whole WHERE days < 5 AND ends < (SELECT max(d) - {DELAY_DAYS} FROM arrived WHERE dayofyear(d) <= 365)"),
    "clustered_crop": _with("dense", body=f"SELECT ds AS dataset, CAST(2000 * 73 + 7 AS INTEGER) AS pentadstamp, lat_i, lon_i, {rounded('v')} FROM dense WHERE v IS NOT NULL AND lat_i BETWEEN 20 AND 45 AND lon_i BETWEEN 10 AND 40"),
    "clustered_files": _with("dense", more=f"t AS (SELECT ds, {_TILE('lat_i', 'lon_i')} AS tile, count(*) AS n, count(*) FILTER (lat_i BETWEEN 20 AND 45 AND lon_i BETWEEN 10 AND 40) AS inside FROM dense WHERE v IS NOT NULL GROUP BY ALL)",
        body="SELECT ds AS dataset, count(*) AS files, max(n) AS most_rows, count(*) FILTER (inside > 0) AS files_read FROM t GROUP BY ds"),
    "tier_range": _with("clim", more=_TWO, body=_TWO_OUT + "pentadstamp >= 2000 * 73 + 60 AND pentadstamp < 2001 * 73 + 10 AND dataset IN ('A', 'R')"),
    "tier_year": _with("clim", more=_TWO, body=_TWO_OUT + "pentadstamp // 73 = 2001"),
    "tier_many": _with("clim", more=_TWO, body="SELECT dataset, CAST(pentadstamp // 73 AS INTEGER) AS year, count(*) AS n, CAST(0 AS BIGINT) AS more, round(sum(v) / 1e6, 4) AS total FROM two GROUP BY ALL UNION ALL SELECT dataset, CAST(2002 AS INTEGER), count(*), count(*), round(sum(v) / 1e6, 4) FROM two WHERE pentadstamp // 73 = 2001 GROUP BY ALL"),
    "whole_output": _with("clim", body=f"SELECT ds, {rounded('avg(v)', 'v')}, 'first' AS kept, 'third' AS replaced FROM clim GROUP BY ds"),
}
