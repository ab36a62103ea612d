"""Raw model grids: big-endian floats at a fixed stride in a ``.data`` file, described by a ``.meta`` file.

This is what an ocean model reads and writes: one file a variable and time step, the last axis fastest.
"""

from __future__ import annotations

import json
import math
import re

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource

from tidegrid.sources.slabs import REPORT_SCHEMA, Bytes, GridWriter, Slab, SlabReader, allow_pushdown, cell_schema, list_files, store_of

# Words of the metadata and the precisions they name.
PRECISIONS = {"float32": ">f4", "real*4": ">f4", "float64": ">f8", "real*8": ">f8"}
AXES = ["lon", "lat", "k", "more"]  # names of the axes, fastest first


def parse_meta(text: str) -> dict:
    """shape (slowest first), dtype, records and time steps from a metadata file.

    An axis is given as its whole length and the part that the file holds; files of a part of an axis,
    as each tile of a model writes them, have an ``origin`` that is not 0.
    """
    fields = {k: v for k, v in re.findall(r"(\w+)\s*=\s*[\[{]([^\]}]*)[\]}]", text)}
    numbers = lambda key: [int(x) for x in re.findall(r"-?\d+", fields.get(key, ""))]
    dims = numbers("nDims")[0]
    sizes = numbers("dimList")
    if len(sizes) != 3 * dims:
        raise ValueError("dimList has three numbers for each dimension")
    kind = re.search(r"[a-z]+\*?\d+", fields.get("dataprec") or fields.get("format") or "float32")[0]
    parts = [(sizes[3 * i + 1] - 1, sizes[3 * i + 2]) for i in range(dims)]
    return {
        "shape": [last - first for first, last in reversed(parts)],
        "origin": [first for first, _ in reversed(parts)],
        "dtype": PRECISIONS[kind],
        "records": (numbers("nrecords") or [1])[0],
        "step": (numbers("timeStepNumber") or [0])[0],
    }


def meta_text(shape: list[int], dtype: str, step: int) -> str:
    kind = next(k for k, v in PRECISIONS.items() if v == dtype)
    rows = ",\n".join(f" {n:6d}, {1:6d}, {n:6d}" for n in reversed(shape))
    return (
        f" nDims = [ {len(shape):3d} ];\n dimList = [\n{rows}\n ];\n dataprec = [ '{kind}' ];\n"
        f" nrecords = [ {1:5d} ];\n timeStepNumber = [ {step:10d} ];\n"
    )


class RawReader(SlabReader):
    def open_slab(self, path: str) -> Slab:
        with Bytes(path.removesuffix(".data") + ".meta") as source:
            meta = parse_meta(source.at(0, source.size).decode())
        names = list(reversed(AXES[: len(meta["shape"])]))
        axes = {n: np.arange(size) + first for n, size, first in zip(names, meta["shape"], meta["origin"])}
        stride = np.dtype(meta["dtype"]).itemsize * math.prod(meta["shape"])
        slab = Slab(path, 0, meta["dtype"], {"record": np.arange(meta["records"]), **axes}, stride, name=path.rsplit("/", 1)[-1].removesuffix(".data"))
        if (size := self._size(path)) != stride * meta["records"]:
            raise ValueError(f"{path} has {size} bytes, its metadata says {stride * meta['records']}")
        return slab

    @staticmethod
    def _size(path: str) -> int:
        store, inner = store_of(path)
        return store.get_file_info(inner).size


class RawWriter(GridWriter):
    dtype, fill, suffix = ">f4", 0.0, ".data"

    def beside(self, name: str, records: list) -> dict[str, bytes]:
        if len(records) != 1:
            raise ValueError(f"{name} has {len(records)} times; a file has one")
        return {".meta": meta_text(self.shape, self.dtype, int(records[0])).encode()}


class RawGrid(DataSource):
    """Options: path; for reading gap, piecebytes, report; for writing shape (slowest axis first)."""

    @classmethod
    def name(cls):
        return "raw_grid"

    def schema(self):
        if "report" in self.options:
            return REPORT_SCHEMA
        files = list_files(self.options["path"], ".data")
        if not files:
            raise FileNotFoundError(f"no .data files in {self.options['path']}")
        return cell_schema(list(RawReader(self.options, None, ".data").open_slab(files[0]).axes))

    def reader(self, schema):
        return RawReader(self.options, schema, ".data")

    def writer(self, schema, overwrite):
        return RawWriter(self.options, overwrite)


def read_raw(spark: SparkSession, path: str, report: bool = False, **options) -> DataFrame:
    """file, record, k, lat, lon and their indices (fewer axes in files that have fewer), v, of all grids of a folder.

    Zeros are values here: the format has no missing ones.  Filters prune what is read.
    """
    allow_pushdown(spark)
    spark.dataSource.register(RawGrid)
    reader = spark.read.format(RawGrid.name()).option("path", path)
    if report:
        reader = reader.option("report", "true")
    return reader.options(**options).load()


def write_raw(field: DataFrame, path: str, shape: dict[str, int], overwrite: bool = False) -> None:
    """Write ``field`` (variable, step, the indices in ``shape``, v) as ``variable.step`` files, null and absent cells as 0.

    ``shape`` names the index columns, slowest first, with their lengths.
    """
    field.sparkSession.dataSource.register(RawGrid)
    cell = F.lit(0).cast("long")
    for name, n in shape.items():
        cell = cell * n + F.col(name)
    file = F.format_string("%s.%010d", F.col("variable"), F.col("step").cast("long"))
    rows = field.select(file.alias("file"), F.col("step").cast("double").alias("record"), cell.alias("cell"), F.col("v").cast("double").alias("v"))
    rows = rows.repartition("file").sortWithinPartitions("file", "record", "cell")
    rows.write.format(RawGrid.name()).mode("overwrite" if overwrite else "append").options(path=path, shape=json.dumps(list(shape.values()))).save()
