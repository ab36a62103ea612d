"""Dense arrays in files: hyperslabs by predicates, their byte ranges, and writers that commit in two phases.

A reader plans on the driver from headers and axes alone: predicates on coordinates and indices become
index runs along each axis, their product is cut into pieces of bounded size, and a task reads only the
byte ranges of its piece.  A writer streams sorted cells into files of its own attempt; files get their
names only when every task has succeeded.
"""

from __future__ import annotations

import itertools
import json
import math
import uuid
from collections.abc import Iterator
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark.sql import SparkSession
from pyspark.sql.datasource import (
    DataSourceArrowWriter, DataSourceReader, EqualTo, GreaterThan, GreaterThanOrEqual, In, InputPartition, LessThan, LessThanOrEqual, WriterCommitMessage,
)

PIECE_BYTES = 16 << 20  # of values that one task reads, about
GAP_BYTES = 1 << 16  # byte ranges closer than this are read as one
BATCH_CELLS = 65_536
PUSHDOWN = "spark.sql.python.filterPushdown.enabled"


def allow_pushdown(spark: SparkSession) -> None:
    spark.conf.set(PUSHDOWN, "true")


def store_of(path: str) -> tuple[fs.FileSystem, str]:
    """The store of a path as Spark spells it, and the path inside."""
    scheme, colon, rest = path.partition("://")
    return fs.FileSystem.from_uri(f"s3://{rest}" if colon and scheme in ("s3a", "s3n") else path)


def list_files(path: str, suffix: str) -> list[str]:
    """The files of a folder and below that end in ``suffix``, or ``path`` itself if it is one; hidden ones are left out."""
    store, inner = store_of(path)
    info = store.get_file_info(inner)
    if info.type == fs.FileType.File:
        return [path]
    if info.type == fs.FileType.NotFound:
        return []
    found = (f.path for f in store.get_file_info(fs.FileSelector(inner, recursive=True)) if f.type == fs.FileType.File)
    shown = (p for p in found if p.endswith(suffix) and not any(x[:1] in "._" for x in p[len(inner) :].strip("/").split("/")))
    prefix = path[: len(path) - len(inner)] if path.endswith(inner) else ""
    return sorted(prefix + p for p in shown)


class Bytes:
    """A file read at offsets, which counts the bytes it reads."""

    def __init__(self, path: str):
        store, inner = store_of(path)
        self.file, self.count = store.open_input_file(inner), 0
        self.size = self.file.size()

    def at(self, offset: int, n: int) -> bytes:
        out = self.file.read_at(n, offset)
        if len(out) != n:
            raise ValueError(f"{offset + n} bytes wanted, the file has {self.size}")
        self.count += n
        return out

    def __enter__(self):
        return self

    def __exit__(self, *_):
        self.file.close()


@dataclass
class Slab:
    """An array in a file: values of ``dtype`` from ``begin`` in the order of its axes.

    ``stride`` is the distance in bytes of neighbours on the first axis; it exceeds their size where
    records of several arrays take turns.  ``missing`` are stored values that stand for none.
    """

    path: str
    begin: int
    dtype: str
    axes: dict[str, np.ndarray]
    stride: int
    missing: tuple[float, ...] = ()
    scale: float = 1.0
    offset: float = 0.0
    name: str = ""

    @property
    def shape(self) -> list[int]:
        return [len(a) for a in self.axes.values()]

    def read(self, source: Bytes, ranges: tuple[tuple[int, int], ...], gap: int) -> np.ndarray:
        """The stored values of a box of index ranges; nothing else is read but gaps shorter than ``gap``."""
        size, shape, wanted = np.dtype(self.dtype).itemsize, [*self.shape, 1], [b - a for a, b in ranges]
        strides, ranges = [size * math.prod(shape[i + 1 :]) for i in range(len(shape))], (*ranges, (0, 1))
        strides[0] = self.stride
        inner = len(shape) - 1
        while inner > 0 and ranges[inner] == (0, shape[inner]) and not (inner == 1 and self.stride != strides[1] * shape[1]):
            inner -= 1
        run = strides[inner] * (ranges[inner][1] - ranges[inner][0])
        starts = np.array([self.begin + ranges[inner][0] * strides[inner]])
        for i in range(inner):
            starts = (starts[:, None] + (np.arange(*ranges[i]) * strides[i])[None, :]).reshape(-1)
        apart = np.flatnonzero(np.diff(starts) > run + gap) + 1
        parts = []
        for first, last in zip(np.concatenate([[0], apart]), np.concatenate([apart, [len(starts)]])):
            data = source.at(int(starts[first]), int(starts[last - 1] - starts[first]) + run)
            parts += [data[int(s - starts[first]) : int(s - starts[first]) + run] for s in starts[first:last]]
        return np.frombuffer(b"".join(parts), dtype=self.dtype).reshape(wanted)


def index_runs(axis: np.ndarray, keep: np.ndarray) -> list[tuple[int, int]]:
    """Runs of consecutive kept places of an axis: two where a box crosses the end of a longitude axis."""
    at = np.flatnonzero(keep)
    if not len(at):
        return []
    cuts = np.flatnonzero(np.diff(at) > 1) + 1
    return [(int(p[0]), int(p[-1]) + 1) for p in np.split(at, cuts)]


def pieces(ranges: tuple[tuple[int, int], ...], cell_bytes: int, most: int) -> Iterator[tuple[tuple[int, int], ...]]:
    """``ranges`` cut along their first long axes into boxes of at most ``most`` bytes, or one cell."""
    sizes = [b - a for a, b in ranges]
    if math.prod(sizes) * cell_bytes <= most or max(sizes) == 1:
        yield ranges
        return
    at = next(i for i, n in enumerate(sizes) if n > 1)
    step = max(1, most // (cell_bytes * max(1, math.prod(sizes[at + 1 :]))))
    a, b = ranges[at]
    for lo in range(a, b, step):
        yield from pieces((*ranges[:at], (lo, min(b, lo + step)), *ranges[at + 1 :]), cell_bytes, most)


@dataclass
class Piece(InputPartition):
    slab: Slab
    ranges: tuple[tuple[int, int], ...]


def _meets(f, values: np.ndarray) -> np.ndarray | None:
    """Where a pushed predicate holds, None for a kind that is left to Spark alone."""
    kinds = {EqualTo: np.equal, GreaterThan: np.greater, GreaterThanOrEqual: np.greater_equal, LessThan: np.less, LessThanOrEqual: np.less_equal}
    if type(f) in kinds and isinstance(f.value, (int, float)):
        return kinds[type(f)](values, f.value)
    if type(f) is In and all(isinstance(v, (int, float)) for v in f.value):
        return np.isin(values, list(f.value))
    return None


class SlabReader(DataSourceReader):
    """Rows (file, each axis and its index, v) of a folder's arrays; ``open_slab`` finds the array of a file.

    With the option ``report`` it gives a row (file, cells, bytes) for each piece in place of its
    cells: what was read, headers left out.  ``box`` (JSON: axis to least and largest coordinate) does
    what predicates do, where rows have no coordinates.
    """

    def __init__(self, options, schema, suffix: str):
        self.path, self.options, self.schema, self.suffix, self.filters = options["path"], dict(options), schema, suffix, []

    def open_slab(self, path: str) -> Slab:
        raise NotImplementedError

    def pushFilters(self, filters):
        self.filters = list(filters)
        return filters  # Spark looks again: whole runs of an axis are read

    def planned(self, slab: Slab) -> list[Piece]:
        kept = {name: np.ones(len(axis), dtype=bool) for name, axis in slab.axes.items()}
        for f in self.filters:
            column = getattr(f, "attribute", ("",))[0]
            if column == "file" and type(f) is EqualTo and f.value != slab.name:
                return []
            for name, axis in slab.axes.items():
                held = _meets(f, axis) if column == name else _meets(f, np.arange(len(axis))) if column == f"{name}_i" else None
                if held is not None:
                    kept[name] &= held
        for name, (low, high) in json.loads(self.options.get("box", "{}")).items():
            kept[name] &= (slab.axes[name] >= low) & (slab.axes[name] <= high)
        runs = [index_runs(slab.axes[n], kept[n]) for n in slab.axes]
        most = int(self.options.get("piecebytes", PIECE_BYTES))
        return [Piece(slab, p) for box in itertools.product(*runs) for p in pieces(box, np.dtype(slab.dtype).itemsize, most)]

    def partitions(self):
        files = list_files(self.path, self.suffix)
        with ThreadPoolExecutor(16) as pool:  # headers only
            found = [p for some in pool.map(lambda f: self.planned(self.open_slab(f)), files) for p in some]
        return found or [InputPartition(None)]

    def read(self, partition):
        if not isinstance(partition, Piece):
            return
        slab, ranges = partition.slab, partition.ranges
        with Bytes(slab.path) as source:
            raw = slab.read(source, ranges, int(self.options.get("gap", GAP_BYTES)))
        if "report" in self.options:
            yield pa.RecordBatch.from_arrays([pa.array([slab.name]), pa.array([raw.size], pa.int64()), pa.array([source.count], pa.int64())], ["file", "cells", "bytes"])
            return
        flat, shape = raw.reshape(-1), raw.shape
        for at in range(0, len(flat), BATCH_CELLS):
            part = flat[at : at + BATCH_CELLS]
            gone = ~np.isfinite(part) if part.dtype.kind == "f" else np.zeros(len(part), dtype=bool)
            for m in slab.missing:
                gone |= part == m
            value = part.astype(np.float64) * slab.scale + slab.offset
            columns = [pa.repeat(slab.name, len(part))]
            for (name, axis), (lo, _), place in zip(slab.axes.items(), ranges, np.unravel_index(np.arange(at, at + len(part)), shape)):
                columns += [pa.array(axis[place + lo].astype(np.float64)), pa.array((place + lo).astype(np.int32))]
            yield pa.RecordBatch.from_arrays([*columns, pa.array(value, mask=gone)], names=[*self.names()])

    def names(self) -> list[str]:
        return [f.name for f in self.schema.fields]


def cell_schema(axes: list[str]) -> str:
    return ", ".join(["file string", *(f"`{a}` double, `{a}_i` int" for a in axes), "v double"])


REPORT_SCHEMA = "file string, cells long, bytes long"


@dataclass
class Written(WriterCommitMessage):
    files: list[tuple[str, str]] = field(default_factory=list)


class GridWriter(DataSourceArrowWriter):
    """Cells (file, record, cell, v), sorted, as one array file each; cells that are not there get ``fill``.

    A task holds one batch, whatever a file's size.  It writes below ``_temporary``; ``commit`` moves
    the files to their names, so a lost task or a failed job leaves none of them half written.
    """

    dtype, fill, suffix = ">f8", np.nan, ""

    def __init__(self, options, overwrite: bool):
        self.path, self.options, self.overwrite = options["path"].rstrip("/"), dict(options), overwrite
        self.shape = json.loads(options["shape"])
        self.folder = f"{self.path}/_temporary/{uuid.uuid4().hex}"

    def head(self, name: str) -> bytes:
        """What stands before the first record."""
        return b""

    def lead(self, record: float) -> bytes:
        """What stands before the values of a record."""
        return b""

    def beside(self, name: str, records: list) -> dict[str, bytes]:
        """Small files that belong to a finished one, by suffix."""
        return {}

    def write(self, iterator) -> Written:
        store, inner = store_of(self.folder)
        mine, made, size = f"{inner}/{uuid.uuid4().hex}", Written(), math.prod(self.shape)
        out, name, records, at = None, None, [], size

        def skip(to: int) -> None:
            nonlocal at
            while at < to:
                n = min(BATCH_CELLS, to - at)
                out.write(np.full(n, self.fill, dtype=self.dtype).tobytes())
                at += n

        def finish() -> None:
            if out is None:
                return
            skip(size)
            out.close()
            for suffix, content in self.beside(name, records).items():
                with store.open_output_stream(f"{mine}/{name}{suffix}") as extra:
                    extra.write(content)
                made.files.append((f"{mine}/{name}{suffix}", f"{name}{suffix}"))

        for batch in iterator:
            if not batch.num_rows:
                continue
            files, record, cell = batch.column("file").to_pylist(), batch.column("record").to_numpy(zero_copy_only=False), batch.column("cell").to_numpy(zero_copy_only=False)
            v = batch.column("v").cast(pa.float64()).to_numpy(zero_copy_only=False)
            v = np.where(np.isfinite(v), v, self.fill)
            turns = [0, *(i for i in range(1, len(files)) if files[i] != files[i - 1] or record[i] != record[i - 1]), len(files)]
            for lo, hi in itertools.pairwise(turns):
                if files[lo] != name:
                    finish()
                    name, records, at = files[lo], [], size
                    store.create_dir(mine, recursive=True)
                    out = store.open_output_stream(f"{mine}/{name}{self.suffix}")
                    made.files.append((f"{mine}/{name}{self.suffix}", f"{name}{self.suffix}"))
                    out.write(self.head(name))
                if not records or records[-1] != record[lo]:
                    skip(size)
                    records.append(record[lo])
                    out.write(self.lead(record[lo]))
                    at = 0
                places = cell[lo:hi]
                if places[0] < at or places[-1] >= size or (np.diff(places) <= 0).any():
                    raise ValueError(f"cells of {name} come twice, out of order or outside the grid")
                for part in np.split(np.arange(hi - lo), np.flatnonzero(np.diff(places) > BATCH_CELLS) + 1):
                    skip(int(places[part[0]]))
                    dense = np.full(int(places[part[-1]]) + 1 - at, self.fill, dtype=self.dtype)
                    dense[places[part] - at] = v[lo:hi][part]
                    out.write(dense.tobytes())
                    at = int(places[part[-1]]) + 1
        finish()
        return made

    def commit(self, messages) -> None:
        store, inner = store_of(self.path)
        files = sorted((name, at) for m in messages if m is not None for at, name in m.files)
        taken = [name for (name, _), (other, _) in itertools.pairwise(files) if name == other]
        held = [] if self.overwrite else [i.base_name for i in store.get_file_info([f"{inner}/{name}" for name, _ in files]) if i.type != fs.FileType.NotFound]
        if taken or held:
            self.abort(messages)
            raise ValueError(f"files that several tasks made: {taken[:5]}; that are there already: {held[:5]}")
        for name, at in files:
            store.move(at, f"{inner}/{name}")
        self._clear(store, inner)

    def abort(self, messages) -> None:
        self._clear(*store_of(self.path))

    def _clear(self, store, inner: str) -> None:
        job = f"{inner}/_temporary/{self.folder.rsplit('/', 1)[1]}"
        if store.get_file_info(job).type != fs.FileType.NotFound:
            store.delete_dir(job)
        if not store.get_file_info(fs.FileSelector(f"{inner}/_temporary", allow_not_found=True)):
            store.delete_dir_contents(f"{inner}/_temporary", missing_dir_ok=True)
            if store.get_file_info(f"{inner}/_temporary").type != fs.FileType.NotFound:
                store.delete_dir(f"{inner}/_temporary")
