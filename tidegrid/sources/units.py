"""Units of work that fail alone, and tiers whose units count only once they are committed.

A unit is a pentad of a dataset.  Its inputs may be dealt into parts, which different tasks work on;
an error in a part is kept as the unit's reason and stops no other unit.  Whole units are written
first, their markers after them: what a lost run has left without a marker is done again and never read.
"""

from __future__ import annotations

from collections.abc import Callable

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidegrid.functions.pentad import PENTADS
from tidegrid.sources.shared import delete_folder, materialize
from tidegrid.sources.tiers import PARTITIONS, exists, write_tier

UNIT = ["dataset", "pentadstamp"]
COMMITS = "_commits"  # below the tier's folder; the name hides it from readers of the tier


def committed(spark: SparkSession, path: str) -> DataFrame:
    """dataset, pentadstamp, cells of the units that are whole."""
    if not exists(spark, f"{path}/{COMMITS}"):
        return spark.createDataFrame([], "dataset string, pentadstamp int, cells long")
    return spark.read.parquet(f"{path}/{COMMITS}").groupBy(*UNIT).agg(F.max_by("cells", "at").alias("cells"))


def read_units(spark: SparkSession, path: str) -> DataFrame:
    """The fields of a tier's committed units."""
    rows = spark.read.parquet(path).withColumns({"dataset": F.col("dataset").cast("string"), "pentadstamp": (F.col("year") * PENTADS + F.col("pentad")).cast("int")})
    return rows.join(committed(spark, path).select(*UNIT), UNIT, "left_semi").drop("year", "pentad")


def isolated(work: Callable[[pd.DataFrame], pd.DataFrame], columns: list[str]) -> Callable[[tuple, pd.DataFrame], pd.DataFrame]:
    """``work`` on a part of a unit; an error becomes a row that names it."""

    def run(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        try:
            out = work(rows)[columns].assign(error=None)
        except Exception as error:  # the unit's own, whatever it is
            out = pd.DataFrame({**{c: [None] for c in columns}, "error": [f"{type(error).__name__}: {error}"]})
        return out.assign(dataset=key[0], pentadstamp=key[1])[[*UNIT, *columns, "error"]]

    return run


def fill_units(planned: DataFrame, inputs: DataFrame, path: str, work: Callable[[pd.DataFrame], pd.DataFrame], schema: str) -> DataFrame:
    """Work on the planned units that a tier lacks, commit those that are whole, and tell how each fared.

    ``planned`` has dataset, pentadstamp, cells (how many a whole unit has).  ``inputs`` has dataset,
    pentadstamp, ``part`` and what ``work`` needs: it gets the rows of a part at a time, so parts bound
    its memory, and returns rows of ``schema``.  Returns dataset, pentadstamp, status, reason:
    ``skipped`` (committed before), ``made`` (committed now), ``partial`` (fewer cells than planned),
    ``failed`` (an error, or no cells).  Partial and failed units leave nothing behind and are tried
    again by the next run.
    """
    spark = planned.sparkSession
    units = planned.groupBy(*UNIT).agg(F.max("cells").alias("cells"))
    done, done_at = materialize(committed(spark, path).select(*UNIT))
    todo = units.join(done, UNIT, "left_anti")
    columns = [f.name for f in spark.createDataFrame([], schema).schema.fields]
    applied = (
        inputs.join(todo.select(*UNIT), UNIT, "left_semi")
        .groupBy(*UNIT, "part")
        .applyInPandas(isolated(work, columns), f"dataset string, pentadstamp int, {schema}, error string")
    )
    staged, staged_at = materialize(applied)
    fared = staged.groupBy(*UNIT).agg(F.count_if(F.col("error").isNull()).alias("got"), F.min("error").alias("error"))
    got = F.coalesce("got", F.lit(0))
    status = F.when(F.col("error").isNotNull() | (got == 0), "failed").when(got < F.col("cells"), "partial").otherwise("made")
    reason = F.when(F.col("error").isNotNull(), F.col("error")).when(got == 0, "no cells").when(got < F.col("cells"), F.concat(got, F.lit(" of "), F.col("cells"), F.lit(" cells")))
    tried, tried_at = materialize(todo.join(fared, UNIT, "left").select(*UNIT, "cells", status.alias("status"), reason.alias("reason")))
    made = tried.where("status = 'made'")
    write_tier(staged.join(made.select(*UNIT), UNIT, "left_semi").drop("error"), path, overwrite=True)
    made.select(*UNIT, "cells", F.current_timestamp().alias("at")).write.mode("append").parquet(f"{path}/{COMMITS}")
    skipped = units.join(done, UNIT, "left_semi").select(*UNIT, F.lit("skipped").alias("status"), F.lit(None).cast("string").alias("reason"))
    manifest, _ = materialize(skipped.unionByName(tried.drop("cells")))
    for folder in (done_at, staged_at, tried_at):
        delete_folder(spark, folder)
    return manifest


def half_written(spark: SparkSession, path: str) -> DataFrame:
    """dataset, pentadstamp of units that have files but no marker."""
    if not exists(spark, path):
        return spark.createDataFrame([], "dataset string, pentadstamp int")
    held = spark.read.parquet(path).select(*PARTITIONS).distinct()
    held = held.select(F.col("dataset").cast("string").alias("dataset"), (F.col("year") * PENTADS + F.col("pentad")).cast("int").alias("pentadstamp"))
    return held.join(committed(spark, path).select(*UNIT), UNIT, "left_anti")

