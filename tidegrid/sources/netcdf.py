"""Classic-format NetCDF files (CDF-1, CDF-2, CDF-5) as a Spark source and sink.

``read_netcdf`` gives a row a cell; predicates on coordinates and indices decide which bytes are read.
``write_netcdf`` makes a file of each value of ``file``, with time as its record axis.
"""

from __future__ import annotations

import json
import math
import struct
from dataclasses import dataclass, field

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource

from tidegrid.sources.slabs import REPORT_SCHEMA, Bytes, GridWriter, Slab, SlabReader, allow_pushdown, cell_schema, list_files

# Fixed values of the file format: tags of the header's lists, and types by number.
DIMENSION, VARIABLE, ATTRIBUTE = 10, 11, 12
TYPES = {1: ">i1", 2: "S1", 3: ">i2", 4: ">i4", 5: ">f4", 6: ">f8", 7: ">u1", 8: ">u2", 9: ">u4", 10: ">i8", 11: ">u8"}
STREAMING = 0xFFFFFFFF  # number of records left open
MISSING = ("_FillValue", "missing_value")


@dataclass
class Variable:
    name: str
    dims: list[int]
    dtype: str
    size: int
    begin: int
    attributes: dict = field(default_factory=dict)


@dataclass
class Header:
    dims: list[tuple[str, int]]  # the record axis has its number of records
    variables: dict[str, Variable]
    attributes: dict
    record_size: int
    record_dim: int | None


class _Cursor:
    """The header's fields one after the other, read in chunks."""

    def __init__(self, source: Bytes, chunk: int = 8192):
        self.source, self.chunk, self.data, self.at = source, chunk, b"", 0

    def take(self, n: int) -> bytes:
        while self.at + n > len(self.data):
            more = min(self.chunk, self.source.size - len(self.data))
            if more <= 0:
                raise ValueError("the header ends too early")
            self.data += self.source.at(len(self.data), more)
        self.at += n
        return self.data[self.at - n : self.at]

    def number(self, wide: bool = False) -> int:
        return int.from_bytes(self.take(8 if wide else 4), "big")

    def text(self, wide: bool) -> str:
        n = self.number(wide)
        return self.take(n + -n % 4)[:n].decode()


def read_header(source: Bytes) -> Header:
    cursor = _Cursor(source)
    magic = cursor.take(4)
    if magic[:3] != b"CDF" or magic[3] not in (1, 2, 5):
        raise ValueError("not a classic-format file")
    wide, far = magic[3] == 5, magic[3] >= 2
    records = cursor.number(wide)

    def listed(tag: int, item):
        said, n = cursor.number(), cursor.number(wide)
        if said not in (0, tag) or (said == 0 and n):
            raise ValueError(f"list {said} where {tag} should be")
        return [item() for _ in range(n)]

    def attribute():
        name, kind, n = cursor.text(wide), cursor.number(), cursor.number(wide)
        size = n * np.dtype(TYPES[kind]).itemsize
        raw = cursor.take(size + -size % 4)[:size]
        return name, raw.decode() if kind == 2 else np.frombuffer(raw, dtype=TYPES[kind])

    def variable():
        name, rank = cursor.text(wide), cursor.number(wide)
        axes = [cursor.number(wide) for _ in range(rank)]
        attributes = dict(listed(ATTRIBUTE, attribute))
        kind, size = cursor.number(), cursor.number(wide)
        return Variable(name, axes, TYPES[kind], size, cursor.number(far), attributes)

    dims = listed(DIMENSION, lambda: (cursor.text(wide), cursor.number(wide)))
    attributes = dict(listed(ATTRIBUTE, attribute))
    variables = {v.name: v for v in listed(VARIABLE, variable)}
    record_dim = next((i for i, (_, n) in enumerate(dims) if n == 0), None)
    recorded = [v for v in variables.values() if v.dims and v.dims[0] == record_dim]
    for v in recorded:  # sizes in the header can overflow
        own = np.dtype(v.dtype).itemsize * math.prod(dims[d][1] for d in v.dims[1:])
        v.size = own if len(recorded) == 1 else own + -own % 4
    record_size = sum(v.size for v in recorded)
    if record_dim is not None:
        if records in (STREAMING, 0xFFFFFFFFFFFFFFFF) and recorded:
            records = (source.size - min(v.begin for v in recorded)) // record_size
        dims[record_dim] = (dims[record_dim][0], records)
    return Header(dims, variables, attributes, record_size, record_dim)


def open_variable(path: str, name: str) -> Slab:
    """The array of a variable, with the coordinates of its axes (their places where there are none)."""
    with Bytes(path) as source:
        header = read_header(source)
        if name not in header.variables:
            raise ValueError(f"{path} has no variable {name}")

        def slab(v: Variable, axes: dict[str, np.ndarray]) -> Slab:
            recorded = bool(v.dims) and v.dims[0] == header.record_dim
            size = np.dtype(v.dtype).itemsize
            stride = header.record_size if recorded else size * math.prod(header.dims[d][1] for d in v.dims[1:])
            gone = tuple(float(x) for k in MISSING if k in v.attributes for x in np.atleast_1d(v.attributes[k]))
            number = lambda key, default: float(np.atleast_1d(v.attributes.get(key, default))[0])
            return Slab(path, v.begin, v.dtype, axes, stride, gone, number("scale_factor", 1.0), number("add_offset", 0.0), path.rsplit("/", 1)[-1])

        axes = {}
        for d in header.variables[name].dims:
            axis, n = header.dims[d]
            own = header.variables.get(axis)
            places = np.arange(n, dtype=np.float64)
            if own is not None and own.dims == [d] and n:
                of = slab(own, {axis: places})
                places = of.read(source, ((0, n),), 0).astype(np.float64) * of.scale + of.offset
            axes[axis] = places
        return slab(header.variables[name], axes)


def build_header(dims: list[tuple[str, int]], variables: list[tuple[str, list[int], str, dict]], attributes: dict | None = None) -> bytes:
    """A CDF-5 header with an open number of records; a dimension of length 0 is the record axis.

    ``variables`` are (name, dimensions, type, attributes), arrays without the record axis first:
    their values follow the header, each padded to 4 bytes, and the records follow them.
    """
    number = lambda n, wide=True: struct.pack(">q" if wide else ">i", n)
    padded = lambda raw: raw + b"\0" * (-len(raw) % 4)
    text = lambda s: number(len(s.encode())) + padded(s.encode())
    kinds = {t: k for k, t in TYPES.items()}

    def listed(tag: int, items: list[bytes]) -> bytes:
        return number(tag if items else 0, False) + number(len(items)) + b"".join(items)

    def attribute(name: str, value) -> bytes:
        if isinstance(value, str):
            return text(name) + number(2, False) + number(len(value.encode())) + padded(value.encode())
        raw = np.atleast_1d(np.asarray(value, dtype=">f8"))
        return text(name) + number(6, False) + number(len(raw)) + raw.tobytes()

    attributes_of = lambda a: listed(ATTRIBUTE, [attribute(k, v) for k, v in a.items()])

    def whole(begins: list[int]) -> bytes:
        items = []
        for (name, axes, dtype, more), begin in zip(variables, begins):
            size = np.dtype(dtype).itemsize * math.prod(dims[d][1] or 1 for d in axes)
            items.append(
                text(name) + number(len(axes)) + b"".join(number(d) for d in axes) + attributes_of(more)
                + number(kinds[dtype], False) + number(size + -size % 4) + number(begin)
            )
        listed_dims = listed(DIMENSION, [text(n) + number(size) for n, size in dims])
        return b"CDF\x05" + number(-1) + listed_dims + attributes_of(attributes or {}) + listed(VARIABLE, items)

    at, begins = len(whole([0] * len(variables))), []
    for _, axes, dtype, _ in variables:
        begins.append(at)
        size = np.dtype(dtype).itemsize * math.prod(dims[d][1] or 1 for d in axes)
        at += size + -size % 4
    return whole(begins)


class NetcdfReader(SlabReader):
    def open_slab(self, path: str) -> Slab:
        return open_variable(path, self.options["variable"])


class NetcdfWriter(GridWriter):
    suffix = ".nc"

    def head(self, name: str) -> bytes:
        axes = {k: np.asarray(v, dtype=">f8") for k, v in json.loads(self.options["axes"]).items()}
        dims = [("time", 0), *((k, len(v)) for k, v in axes.items())]
        variables = [(k, [i + 1], ">f8", {}) for i, k in enumerate(axes)]
        variables += [("time", [0], ">f8", {}), (self.options["variable"], list(range(len(dims))), ">f8", {"_FillValue": math.nan})]
        return build_header(dims, variables, {"title": name}) + b"".join(v.tobytes() for v in axes.values())

    def lead(self, record: float) -> bytes:
        return struct.pack(">d", record)


class Netcdf(DataSource):
    """Options: path, variable; for reading gap, piecebytes, report; for writing axes and shape."""

    @classmethod
    def name(cls):
        return "netcdf_classic"

    def schema(self):
        if "report" in self.options:
            return REPORT_SCHEMA
        files = list_files(self.options["path"], ".nc")
        if not files:
            raise FileNotFoundError(f"no .nc files in {self.options['path']}")
        return cell_schema(list(open_variable(files[0], self.options["variable"]).axes))

    def reader(self, schema):
        return NetcdfReader(self.options, schema, ".nc")

    def writer(self, schema, overwrite):
        return NetcdfWriter(self.options, overwrite)


def read_netcdf(spark: SparkSession, path: str, variable: str, report: bool = False, **options) -> DataFrame:
    """file, each axis and its index, v of the cells of a variable in all files of a folder; a missing value is null.

    Filters on the result prune what is read.  With ``report``: file, cells, bytes of each piece read.
    """
    allow_pushdown(spark)
    spark.dataSource.register(Netcdf)
    reader = spark.read.format(Netcdf.name()).option("path", path).option("variable", variable)
    if report:
        reader = reader.option("report", "true")
    return reader.options(**options).load()


def write_netcdf(field: DataFrame, path: str, axes: dict[str, list[float]], variable: str = "v", overwrite: bool = False) -> None:
    """Write ``field`` (file, time, an index ``<axis>_i`` for each of ``axes``, v), a classic file for each value of ``file``.

    Cells that are not there, or null, are missing values.  A file's records are sorted and streamed by
    one task, other files by others.
    """
    field.sparkSession.dataSource.register(Netcdf)
    shape = [len(a) for a in axes.values()]
    cell = F.lit(0).cast("long")
    for name, n in zip(axes, shape):
        cell = cell * n + F.col(f"{name}_i")
    rows = field.select("file", F.col("time").cast("double").alias("record"), cell.alias("cell"), F.col("v").cast("double").alias("v"))
    rows = rows.repartition("file").sortWithinPartitions("file", "record", "cell")
    options = {"path": path, "variable": variable, "shape": json.dumps(shape), "axes": json.dumps(axes)}
    rows.write.format(Netcdf.name()).mode("overwrite" if overwrite else "append").options(**options).save()


def read_box_report(spark: SparkSession, path: str, variable: str, box: dict[str, tuple[float, float]], **options) -> DataFrame:
    """file, cells, bytes of each piece that reading a box of coordinates, ends included, takes."""
    return read_netcdf(spark, path, variable, report=True, box=json.dumps(box), **options)
