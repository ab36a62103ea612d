"""Tiers of stored fields: Parquet partitioned by year and pentad, read and filled by ranges."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tidegrid.functions.pentad import DAYS, PENTADS, begin_of, parse_label, pentad_in_year, pentad_range, year_of
from tidegrid.sources.shared import materialize

PARTITIONS = ["dataset", "year", "pentad"]
# Daily products with the time and the name that their files carry.
PRODUCTS = [
    ("OSTIA_UKMO", "120000", "UKMO-L4_GHRSST-SSTfnd-OSTIA-GLOB-v02.0-fv02.0"),
    ("GAMSSA_ABOM", "120000", "ABOM-L4_GHRSST-SSTfnd-GAMSSA_28km-GLOB-v02.0-fv01.0"),
    ("DMIOI_DMI", "000000", "DMI-L4_GHRSST-SSTfnd-DMI_OI-GLOB-v02.0-fv01.0"),
    ("GPBN_OSPO", "000000", "OSPO-L4_GHRSST-SSTfnd-Geo_Polar_Blended_Night-GLOB-v02.0-fv01.0"),
    ("MUR_JPL", "090000", "JPL-L4_GHRSST-SSTfnd-MUR-GLOB-v02.0-fv04.1"),
    ("K10SST_NAVO", "000000", "NAVO-L4_GHRSST-SST1m-K10_SST-GLOB-v02.0-fv01.0"),
]
MOST_PRODUCTS = 10_000
TIERS = {"physical": False, "cropped": True, "spectral": True}  # whether a label is needed


def tier_path(root: str, tier: str, varname: str, label: str | None = None) -> str:
    if tier not in TIERS:
        raise ValueError(f"unknown tier {tier}")
    if TIERS[tier] and not label:
        raise ValueError(f"tier {tier} needs a label")
    return "/".join([root.rstrip("/"), tier, *([label] if TIERS[tier] else []), varname])


def write_tier(field: DataFrame, path: str, overwrite: bool = False) -> None:
    """Write ``field`` (dataset, pentadstamp, ...) by year and pentad.

    Pentads of a dataset that are there already are replaced with ``overwrite`` and else left as
    they are, so running it again changes nothing.
    """
    rows = field.withColumns({"year": year_of(F.col("pentadstamp")), "pentad": pentad_in_year(F.col("pentadstamp"))})
    if not overwrite and exists(field.sparkSession, path):
        rows = missing_work(rows, stored(field.sparkSession, path), PARTITIONS)
    writer = rows.hint("rebalance", *PARTITIONS).write.partitionBy(*PARTITIONS)
    if overwrite:
        writer.option("partitionOverwriteMode", "dynamic").mode("overwrite").parquet(path)
    else:
        writer.mode("append").parquet(path)


def exists(spark: SparkSession, path: str) -> bool:
    """Whether ``path`` holds something, in any store that Spark reads."""
    target = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    store = target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    return store.exists(target) and any(not s.getPath().getName().startswith(("_", ".")) for s in store.listStatus(target))


def stored(spark: SparkSession, path: str) -> DataFrame:
    """dataset, year, pentad of what a tier holds; partition columns only, so no data page is read."""
    if not exists(spark, path):
        return spark.createDataFrame([], "dataset string, year int, pentad int")
    return spark.read.parquet(path).select(F.col("dataset").cast("string").alias("dataset"), "year", "pentad").distinct()


def fill_tier(planned: DataFrame, path: str, work: Callable[[DataFrame], DataFrame], overwrite: bool = False) -> DataFrame:
    """Detect what a tier lacks, work on that alone, write it, and tell how each unit fared.

    ``planned`` has dataset, pentadstamp; ``work`` gets the units to do and returns their fields
    (dataset, pentadstamp, ...).  Returns dataset, pentadstamp, status: ``skipped`` for units that
    were there, ``made``, or ``failed`` for units of which ``work`` returned nothing.
    """
    spark = planned.sparkSession
    units = planned.select("dataset", "pentadstamp").distinct()
    stamp = (F.col("year") * PENTADS + F.col("pentad")).cast("int").alias("pentadstamp")
    had, _ = materialize(stored(spark, path).select("dataset", stamp))
    todo = units if overwrite else missing_work(units, had, ["dataset", "pentadstamp"])
    write_tier(work(todo).join(todo, ["dataset", "pentadstamp"], "left_semi"), path, overwrite)
    mark = lambda df, name: df.select("dataset", "pentadstamp", F.lit(True).alias(name))
    now = stored(spark, path).select("dataset", stamp)
    both = units.join(mark(had, "_had"), ["dataset", "pentadstamp"], "left").join(mark(now, "_now"), ["dataset", "pentadstamp"], "left")
    kept = F.lit(False) if overwrite else F.col("_had").isNotNull()
    status = F.when(kept, "skipped").when(F.col("_now").isNotNull(), "made").otherwise("failed")
    return both.select("dataset", "pentadstamp", status.alias("status"))


def write_whole(df: DataFrame, path: str, overwrite: bool = False) -> None:
    """Write an output that is one unit: replaced with ``overwrite``, else left alone if it is there."""
    df.write.mode("overwrite" if overwrite else "ignore").parquet(path)


def read_year(spark: SparkSession, path: str, year: int, datasets: list[str] | None = None) -> DataFrame:
    """All 73 pentads of a year; a pentad that a dataset lacks is an error."""
    return read_range(spark, path, f"{year}P0", f"{year}P{PENTADS - 1}", "both", datasets)


def read_many(spark: SparkSession, paths: list[str]) -> DataFrame:
    """Fields of several folders as one table, columns by name."""
    out = spark.read.parquet(paths[0])
    for path in paths[1:]:
        out = out.unionByName(spark.read.parquet(path), allowMissingColumns=True)
    return out


def required_files(pentads: DataFrame, products: DataFrame) -> DataFrame:
    """dataset, pentadstamp, d, file: the five daily files that each pentad of each product needs.

    ``products`` has dataset, timestr, suffix: a catalogue of at most ``MOST_PRODUCTS`` rows.
    """
    if products.limit(MOST_PRODUCTS + 1).count() > MOST_PRODUCTS:
        raise ValueError(f"more than {MOST_PRODUCTS} products")
    first = begin_of(F.col("pentadstamp"))
    days = F.explode(F.sequence(first, F.date_add(first, DAYS - 1), F.expr("interval 1 day"))).alias("d")
    rows = pentads.select("pentadstamp").distinct().select("pentadstamp", days).join(F.broadcast(products), F.lit(True))
    name = F.concat(F.date_format("d", "yyyyMMdd"), "timestr", F.lit("-"), "suffix", F.lit(".nc"))
    return rows.select("dataset", "pentadstamp", "d", name.alias("file"))


def write_catalogue(rows: DataFrame, path: str) -> None:
    """A catalogue as JSON lines."""
    rows.write.mode("overwrite").json(path)


def read_catalogue(spark: SparkSession, path: str, schema: str) -> DataFrame:
    return spark.read.schema(schema).json(path)


def read_range(spark: SparkSession, path: str, begin: str, end: str, inclusive: str = "left", datasets: list[str] | None = None) -> DataFrame:
    """Fields of a range of pentads; an error names pentads that a dataset lacks.

    The predicates on year and pentad prune directories.
    """
    wanted = pentad_range(spark, begin, end, inclusive)
    first, last = parse_label(begin), parse_label(end)
    rows = spark.read.parquet(path).where(F.col("year").between(first // PENTADS, last // PENTADS))
    if datasets:
        rows = rows.where(F.col("dataset").isin(datasets))
    rows = rows.where((F.col("year") * PENTADS + F.col("pentad")).between(first, last))
    rows = rows.join(F.broadcast(wanted.select("pentadstamp")), "pentadstamp", "left_semi")
    held = rows.select("dataset", "pentadstamp").distinct()
    names = spark.createDataFrame([(d,) for d in datasets], "dataset string") if datasets else held.select("dataset").distinct()
    missing = missing_work(names.crossJoin(wanted.select("pentadstamp")), held, ["dataset", "pentadstamp"]).take(5)
    if missing:
        raise FileNotFoundError(f"missing pentads: {[(r.dataset, r.pentadstamp) for r in missing]}")
    return rows


def missing_work(planned: DataFrame, done: DataFrame, keys: list[str]) -> DataFrame:
    """Planned units of work that are not done yet."""
    return planned.join(done.select(*keys).distinct(), keys, "left_anti")


def write_binary(field: DataFrame, path: str, order: list[str]) -> None:
    """Big-endian 32-bit floats of ``v``, NULL as 0, as rows (part, seq, packed).

    Put together in the order of part and seq, the pieces hold the values in the order of ``order``.
    """
    values = field.repartitionByRange(*order).sortWithinPartitions(*order)

    def pack(batches):
        from pyspark import TaskContext

        part = TaskContext.get().partitionId()
        for seq, pdf in enumerate(batches):
            packed = pdf["v"].fillna(0.0).to_numpy().astype(np.dtype(">f4")).tobytes()
            yield pd.DataFrame({"part": [part], "seq": [seq], "packed": [packed]})

    values.select("v").mapInPandas(pack, "part int, seq int, packed binary").write.mode("overwrite").parquet(path)


def read_binary(spark: SparkSession, path: str) -> DataFrame:
    """at, v: the values of ``write_binary`` and their places in its order, from 0."""

    def unpack(batches):
        for pdf in batches:
            for start, packed in zip(pdf["start"], pdf["packed"]):
                v = np.frombuffer(packed, dtype=">f4").astype(np.float32)
                yield pd.DataFrame({"at": np.arange(len(v)) + start, "v": v})

    rows = spark.read.parquet(path)
    sizes = rows.select("part", "seq", (F.octet_length("packed") / 4).cast("long").alias("n"))  # a row a piece
    earlier = lambda w: F.coalesce(F.sum("n").over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    parts = sizes.groupBy("part").agg(F.sum("n").alias("n")).select("part", earlier(Window.orderBy("part")).alias("_base"))  # a row a part
    starts = sizes.select("part", "seq", earlier(Window.partitionBy("part").orderBy("seq")).alias("_at"))
    starts = starts.join(F.broadcast(parts), "part").select("part", "seq", (F.col("_base") + F.col("_at")).alias("start"))
    return rows.join(starts, ["part", "seq"]).select("start", "packed").mapInPandas(unpack, "at long, v float")
