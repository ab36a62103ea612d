"""MATLAB level-5 files on executors: a struct ``D`` of axes and fields, written and read without a library.

Fields are doubles of longitude by latitude by depth, the first fastest, with a bottom level below the
deepest one that repeats it; missing values are 0.
"""

from __future__ import annotations

import json
import struct

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource

from tidegrid.sources.slabs import REPORT_SCHEMA, Bytes, GridWriter, Slab, SlabReader, allow_pushdown, cell_schema, list_files

# Fixed values of the format: element types, array classes, the width of a field's name.
INT8, INT32, UINT32, DOUBLE, MATRIX = 1, 5, 6, 9, 14
STRUCT_CLASS, DOUBLE_CLASS = 2, 6
NAME_WIDTH = 32
BOTTOM = -6500.0  # depth of the appended level
AXES = ("Longitude", "Latitude", "Date", "Depth")


def element(kind: int, data: bytes) -> bytes:
    return struct.pack(">II", kind, len(data)) + data + b"\0" * (-len(data) % 8)


def array_head(shape: list[int], name: str, kind: int = DOUBLE_CLASS) -> bytes:
    dims = np.array(shape, dtype=">i4").tobytes()
    return element(UINT32, struct.pack(">II", kind, 0)) + element(INT32, dims) + element(INT8, name.encode())


def double_head(shape: list[int]) -> bytes:
    """All of a nameless array of doubles but its values."""
    size = 8 * int(np.prod(shape))
    inside = array_head(shape, "") + struct.pack(">II", DOUBLE, size)
    return struct.pack(">II", MATRIX, len(inside) + size) + inside


def array(values, shape: list[int]) -> bytes:
    return double_head(shape) + np.asarray(values, dtype=">f8").tobytes()


class MatWriter(GridWriter):
    """A file's name ends in its date; its records are the fields in the order of the option ``variables``."""

    suffix = ".mat"
    fill = 0.0

    def head(self, name: str) -> bytes:
        variables, axes = json.loads(self.options["variables"]), json.loads(self.options["axes"])
        lon, lat, depth = axes["lon"], axes["lat"], axes["depth"]
        fixed = array(lon, [1, len(lon)]) + array(lat, [1, len(lat)]) + array([float(name.rsplit(".", 1)[1])], [1, 1]) + array(depth, [len(depth), 1])
        names = b"".join(n.encode().ljust(NAME_WIDTH, b"\0") for n in [*AXES, *variables])
        inside = array_head([1, 1], "D", STRUCT_CLASS) + struct.pack(">HHI", 4, INT32, NAME_WIDTH) + element(INT8, names) + fixed
        size = len(inside) + len(variables) * (len(double_head(self.shape[::-1])) + 8 * int(np.prod(self.shape)))
        text = b"MATLAB 5.0 MAT-file".ljust(116) + b"\0" * 8 + struct.pack(">H", 0x0100) + b"MI"
        return text + struct.pack(">II", MATRIX, size) + inside

    def lead(self, record: float) -> bytes:
        return double_head(self.shape[::-1])

    def beside(self, name: str, records: list) -> dict[str, bytes]:
        if records != list(range(len(json.loads(self.options["variables"])))):
            raise ValueError(f"{name} lacks fields: it has {records}")
        return {}


def find_field(source: Bytes, wanted: str) -> tuple[list[int], int]:
    """Shape and first byte of the values of a field of the file's struct; only tags on the way are read."""

    def tag(at: int) -> tuple[int, int, int, int]:
        """Type, length, first byte of the data and of the next element."""
        first, second = struct.unpack(">II", source.at(at, 8))
        if first >> 16:  # a small element: length and type in one word, data in the other
            return first & 0xFFFF, first >> 16, at + 4, at + 8
        return first, second, at + 8, at + 8 + second + -second % 8

    if source.at(124, 4) != struct.pack(">H", 0x0100) + b"MI":
        raise ValueError("not a big-endian level-5 file")
    _, _, at, _ = tag(128)
    for _ in range(3):  # flags, dimensions, name
        _, _, _, at = tag(at)
    _, _, place, at = tag(at)
    width = struct.unpack(">I", source.at(place, 4))[0]
    _, length, place, at = tag(at)
    names = [source.at(place + i, width).split(b"\0")[0].decode() for i in range(0, length, width)]
    if wanted not in names:
        raise ValueError(f"no field {wanted} among {names}")
    for _ in range(names.index(wanted)):
        _, _, _, at = tag(at)
    _, _, at, _ = tag(at)
    _, _, _, at = tag(at)
    _, length, place, at = tag(at)
    shape = np.frombuffer(source.at(place, length), dtype=">i4").tolist()
    _, _, _, at = tag(at)
    _, _, place, _ = tag(at)
    return shape, place


class MatReader(SlabReader):
    def open_slab(self, path: str) -> Slab:
        with Bytes(path) as source:
            axes = {}
            for field, name in (("Depth", "depth"), ("Latitude", "lat"), ("Longitude", "lon")):
                shape, at = find_field(source, field)
                axes[name] = np.frombuffer(source.at(at, 8 * int(np.prod(shape))), dtype=">f8").astype(float)
            shape, begin = find_field(source, self.options["variable"])
        if shape != [len(a) for a in reversed(axes.values())]:
            raise ValueError(f"{path}: the field's shape {shape} is not that of its axes")
        return Slab(path, begin, ">f8", axes, 8 * shape[0] * shape[1], name=path.rsplit("/", 1)[-1].removesuffix(".mat"))


class MatFiles(DataSource):
    """Options: path; variable for reading; variables, axes and shape for writing."""

    @classmethod
    def name(cls):
        return "mat_level5"

    def schema(self):
        return REPORT_SCHEMA if "report" in self.options else cell_schema(["depth", "lat", "lon"])

    def reader(self, schema):
        return MatReader(self.options, schema, ".mat")

    def writer(self, schema, overwrite):
        return MatWriter(self.options, overwrite)


def write_mat(field: DataFrame, path: str, axes: dict[str, list[float]], variables: list[str], overwrite: bool = False) -> None:
    """Write ``field`` (name, date, variable, k, lat_i, lon_i, v) as ``name.date`` files with a bottom level.

    ``axes`` are depth (downwards negative), lat and lon; every file needs a row of each of ``variables``.
    """
    spark = field.sparkSession
    spark.dataSource.register(MatFiles)
    n_k, n_lat, n_lon = (len(axes[c]) for c in ("depth", "lat", "lon"))
    if list_files(path, ".mat") and not overwrite:
        raise FileExistsError(path)
    rows = field.unionByName(field.where(F.col("k") == n_k - 1).withColumn("k", F.lit(n_k)))
    order = F.array_position(F.array(*[F.lit(v) for v in variables]), F.col("variable")) - 1
    cell = (F.col("k").cast("long") * n_lat + F.col("lat_i")) * n_lon + F.col("lon_i")
    rows = rows.select(F.concat("name", F.lit("."), F.col("date").cast("long")).alias("file"), order.cast("double").alias("record"), cell.alias("cell"), F.col("v").cast("double").alias("v"))
    rows = rows.repartition("file").sortWithinPartitions("file", "record", "cell")
    options = {"path": path, "shape": json.dumps([n_k + 1, n_lat, n_lon]), "variables": json.dumps(variables), "axes": json.dumps({**axes, "depth": [*axes["depth"], BOTTOM]})}
    rows.write.format(MatFiles.name()).mode("overwrite" if overwrite else "append").options(**options).save()


def read_mat(spark: SparkSession, path: str, variable: str, **options) -> DataFrame:
    """file, depth, lat, lon and their indices, v of a field of all files of a folder; filters prune what is read."""
    allow_pushdown(spark)
    spark.dataSource.register(MatFiles)
    return spark.read.format(MatFiles.name()).options(path=path, variable=variable, **options).load()
