"""The driver's tables as daily observations, sub-daily values, layers and series."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidegrid.functions import pentad
from tidegrid.functions.aggregates import present

DATASETS = ["A", "N", "R"]
N_LAT, N_LON = 73, 70
WIDTH = 64
#: Cells of the climatology as places: one degree of latitude, two of longitude from 120 East.
LAT0, D_LAT, LON0, D_LON = 0.0, 1.0, 120.0, 2.0


def daily_of(lineitem: DataFrame) -> DataFrame:
    return lineitem.select(
        F.col("l_returnflag").alias("ds"),
        F.to_date("l_shipdate").alias("d"),
        F.pmod("l_suppkey", F.lit(10)).cast("int").alias("lat_i"),
        F.col("l_linenumber").cast("int").alias("lon_i"),
        present(F.col("l_extendedprice")).alias("v"),
    )


def obs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return daily_of(spark.read.parquet(f"{sf_dir}/lineitem.parquet"))


def clim(spark: SparkSession, sf_dir: str) -> DataFrame:
    """ds, lat_i (pentad of the year), lon_i (cell), v: the mean year, with gaps as absent rows."""
    rows = obs(spark, sf_dir).withColumn("p", pentad.pentad_of(F.col("d"))).where("p IS NOT NULL")
    return rows.groupBy("ds", F.col("p").alias("lat_i"), (F.col("lat_i") * 7 + F.col("lon_i") - 1).alias("lon_i")).agg(F.avg("v").alias("v"))


def dense(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same with a row for every cell of the grid and NULL for gaps."""
    names = spark.createDataFrame([(d,) for d in DATASETS], "ds string")
    cells = spark.range(N_LAT * N_LON).select(F.floor(F.col("id") / N_LON).cast("int").alias("lat_i"), F.pmod("id", F.lit(N_LON)).cast("int").alias("lon_i"))
    grid = cells.crossJoin(F.broadcast(names))  # three names
    return grid.join(clim(spark, sf_dir), ["ds", "lat_i", "lon_i"], "left")


def places(rows: DataFrame) -> DataFrame:
    return rows.withColumns({"lat": LAT0 + F.col("lat_i") * D_LAT, "lon": LON0 + F.col("lon_i") * D_LON})


def events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/events.parquet").select(F.col("event_type").alias("ds"), "ts", present(F.col("value")).alias("v"))


def vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """t, x, v: every embedding as a series of 64 values."""
    rows = spark.read.parquet(f"{sf_dir}/embeddings.parquet")
    return rows.select(F.col("vec_id").alias("t"), F.posexplode("embedding").alias("x", "v")).select("t", "x", present(F.col("v")).alias("v"))
