"""Tiers whose cells lie along a space-filling curve: tiles of bounded size, of which a crop reads few.

The bits of both indices take turns in a cell's place on the curve, so a square of ``2 ** LEVEL`` cells
a side is one run of it, a tile.  A tile of a pentad is a folder with files of its own: many tasks write
a pentad, and a box of cells becomes a few ranges of tiles, which Spark prunes by their names.
"""

from __future__ import annotations

import itertools

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidegrid.functions.pentad import PENTADS, pentad_in_year, year_of
from tidegrid.sources.tiers import PARTITIONS, exists, missing_work, stored

LEVEL = 8  # tiles of 256 x 256 cells
FILE_ROWS = 1 << 22  # rows of a file at most
# Masks that spread 16 bits to every second of 32.
SPREAD = [(8, 0x00FF00FF), (4, 0x0F0F0F0F), (2, 0x33333333), (1, 0x55555555)]


def _spread(x):
    """The low 16 bits of a column or a number, a zero between each two."""
    for by, mask in SPREAD:
        x = (x.bitwiseOR(F.shiftleft(x, by))).bitwiseAND(F.lit(mask)) if isinstance(x, Column) else (x | x << by) & mask
    return x


def curve(lat_i, lon_i):
    """Place on the curve of a cell: the bits of both indices, latitude first; columns or numbers below 65,536."""
    return _spread(lat_i) * 2 + _spread(lon_i)


def write_clustered(field: DataFrame, path: str, level: int = LEVEL, overwrite: bool = False) -> None:
    """Write ``field`` (dataset, pentadstamp, lat_i, lon_i, ...) by year, pentad and tile, along the curve inside.

    Pentads of a dataset that are there already are replaced with ``overwrite`` and else left alone.
    """
    at = lambda c, by: F.shiftright(F.col(c).cast("long"), by)
    rows = field.withColumns({
        "year": year_of(F.col("pentadstamp")), "pentad": pentad_in_year(F.col("pentadstamp")), "tile": curve(at("lat_i", level), at("lon_i", level)), "_z": curve(at("lat_i", 0), at("lon_i", 0)),
    })
    if not overwrite and exists(field.sparkSession, path):
        rows = missing_work(rows, stored(field.sparkSession, path), PARTITIONS)
    keys = [*PARTITIONS, "tile"]
    rows = rows.repartition(*keys).sortWithinPartitions(*keys, "_z").drop("_z")
    writer = rows.write.partitionBy(*keys).option("maxRecordsPerFile", FILE_ROWS)
    if overwrite:
        writer.option("partitionOverwriteMode", "dynamic").mode("overwrite").parquet(path)
    else:
        writer.mode("append").parquet(path)


def tile_ranges(lat: tuple[int, int], lon: tuple[int, int], level: int = LEVEL) -> list[tuple[int, int]]:
    """Runs of tiles that a box of cells, ends included, meets."""
    tiles = sorted(curve(y, x) for y in range(lat[0] >> level, (lat[1] >> level) + 1) for x in range(lon[0] >> level, (lon[1] >> level) + 1))
    runs = []
    for _, run in itertools.groupby(enumerate(tiles), key=lambda p: p[1] - p[0]):
        run = [t for _, t in run]
        runs.append((run[0], run[-1]))
    return runs


def read_box(spark: SparkSession, path: str, lat: tuple[int, int], lon: tuple[int, int], level: int = LEVEL) -> DataFrame:
    """The cells of a box of indices, ends included: only folders of tiles that it meets are read.

    Inside a file the order along the curve keeps the row groups' ranges of both indices narrow.
    """
    held = F.lit(False)
    for low, high in tile_ranges(lat, lon, level):
        held = held | F.col("tile").between(low, high)
    rows = spark.read.parquet(path).where(held)
    rows = rows.where(F.col("lat_i").between(*lat) & F.col("lon_i").between(*lon))
    return rows.withColumn("pentadstamp", (F.col("year") * PENTADS + F.col("pentad")).cast("int")).drop("year", "pentad", "tile")


def files_of(spark: SparkSession, path: str) -> DataFrame:
    """dataset, year, pentad, tile, file, rows of a tier: a row a file."""
    rows = spark.read.parquet(path).select(*PARTITIONS, "tile", F.col("_metadata.file_path").alias("file"))
    return rows.groupBy(*PARTITIONS, "tile", "file").agg(F.count("*").alias("rows"))
