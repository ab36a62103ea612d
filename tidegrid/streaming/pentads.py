"""Incremental pentad means from a growing folder of daily observations.

Each micro-batch adds mergeable partial aggregates (sum, count, days seen) under its batch number,
so a repeated batch replaces itself and late days are simply added.  The means are an aggregation
of the partials; with the strict rule a dataset's pentad appears once its five days are there.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidegrid.functions import pentad

KEYS = ["ds", "pentadstamp", "lat_i", "lon_i"]


def ingest(source: DataFrame, to_daily: Callable[[DataFrame], DataFrame], path: str) -> None:
    """Process all new files of a streaming ``source`` into partials under ``path`` and stop."""

    def add(batch: DataFrame, number: int) -> None:
        daily = to_daily(batch).withColumn("pentadstamp", pentad.stamp_of(F.col("d"))).where("pentadstamp IS NOT NULL")
        cells = daily.groupBy(*KEYS).agg(F.sum("v").alias("s"), F.count("v").alias("c"))
        cells.write.mode("overwrite").parquet(f"{path}/cells/batch={number}")
        daily.select("ds", "pentadstamp", "d").distinct().write.mode("overwrite").parquet(f"{path}/days/batch={number}")

    query = source.writeStream.foreachBatch(add).option("checkpointLocation", f"{path}/progress").trigger(availableNow=True).start()
    query.awaitTermination()


def means(spark: SparkSession, path: str, strict_days: bool = False) -> DataFrame:
    cells = spark.read.parquet(f"{path}/cells").groupBy(*KEYS).agg(F.sum("s").alias("s"), F.sum("c").alias("n"))
    out = cells.select(*KEYS, F.try_divide("s", "n").alias("v"), "n")
    if strict_days:
        days = spark.read.parquet(f"{path}/days").groupBy("ds", "pentadstamp").agg(F.count_distinct("d").alias("days"))
        out = out.join(days.where(F.col("days") == pentad.DAYS).select("ds", "pentadstamp"), ["ds", "pentadstamp"], "left_semi")
    return out
