"""Strict pentads from a stream: each is given out once, when its five days are in, or dropped when late.

Days come in any order and in any number of runs.  The state of a pentad's block of cells holds sums,
counts and the days seen; the watermark decides what is too late, and a timer at the pentad's end drops
what can no longer be whole.  Rows are added up in their task, by dataset, day and cell over all of its
batches, before they are sent to the state, so what is sent grows with cells and days and not with rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from tidegrid.functions import pentad

BLOCKS = 16  # blocks that the cells of a pentad are dealt to
HELD = 1 << 20  # rows that a task holds before it adds them up; sums of more than half as many cells are sent on
NOWHERE = -(1 << 31)  # a null index
ALL_DAYS = (1 << pentad.DAYS) - 1
OUT = "ds string, pentadstamp int, status string, lat_i int, lon_i int, v double, n long, days int"
STATE = "days int, done boolean, cells binary, sums binary, counts binary"
_SENT = "ds string, d date, block int, cells binary, sums binary, counts binary"
_SENT_ARROW = pa.schema([("ds", pa.string()), ("d", pa.date32()), ("block", pa.int32()), ("cells", pa.binary()), ("sums", pa.binary()), ("counts", pa.binary())])


def _add_up(cells: np.ndarray, sums: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    own, place = np.unique(cells, return_inverse=True)
    return own, np.bincount(place, sums, len(own)), np.bincount(place, counts, len(own)).astype(np.int64)


def _packed(added: pa.Table, blocks: int) -> pa.RecordBatch:
    """A row for each dataset, day and block; every block hears of every day, as a day may have no cells in it."""
    names = added["ds"].combine_chunks().dictionary_encode()
    days = added["d"].cast(pa.int32()).to_numpy()
    own, place = np.unique((names.indices.fill_null(-1).to_numpy().astype(np.int64) << 32) | (days & np.int64(0xFFFFFFFF)), return_inverse=True)
    counts = added["count"].to_numpy()
    held = np.flatnonzero(counts)
    cells = added["cell"].to_numpy()[held]
    slot = place[held] * blocks + ((cells >> 32) * 31 + (cells & 0xFFFFFFFF)) % blocks
    order = np.argsort(slot, kind="stable")
    cuts = np.searchsorted(slot[order], np.arange(len(own) * blocks + 1))
    pack = lambda values: pa.array([values[i:j].tobytes() for i, j in zip(cuts[:-1], cuts[1:])], pa.binary())
    kinds = ((cells, np.int64), (added["total"].to_numpy()[held], np.float64), (counts[held], np.int64))
    codes, days = (np.repeat(c, blocks).astype(np.int32) for c in (own >> 32, own & 0xFFFFFFFF))
    ds = names.dictionary.take(pa.array(codes, mask=codes < 0)).cast(pa.string())
    block = pa.array(np.tile(np.arange(blocks, dtype=np.int32), len(own)))
    return pa.record_batch([ds, pa.array(days).cast(pa.date32()), block, *(pack(v[order].astype(k, copy=False)) for v, k in kinds)], schema=_SENT_ARROW)


def _combine(blocks: int, most: int = HELD):
    """Sums a task's rows up by dataset, day and cell, over its batches and in bounded memory."""

    def add(tables: list[pa.Table]) -> pa.Table:
        out = pa.concat_tables(tables).group_by(["ds", "d", "cell"], use_threads=False).aggregate([("total", "sum"), ("count", "sum")])
        return out.select(["ds", "d", "cell", "total_sum", "count_sum"]).rename_columns(["ds", "d", "cell", "total", "count"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tables, rows = [], 0
        for batch in batches:
            v = batch["v"]
            tables.append(pa.table([batch["ds"], batch["d"], batch["cell"], v, v.is_valid().cast(pa.int64())], ["ds", "d", "cell", "total", "count"]))
            rows += len(batch)
            if rows >= most:
                tables = [add(tables)]
                rows = len(tables[0])
                if rows > most // 2:
                    yield _packed(tables[0], blocks)
                    tables, rows = [], 0
        if rows:
            yield _packed(add(tables), blocks)

    return run


def _step(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
    ds, stamp, block = key
    days, done, *packed = state.get if state.exists else (0, False, b"", b"", b"")
    if state.hasTimedOut:
        state.remove()
        if not done and block == 0:
            yield pd.DataFrame({"ds": [ds], "pentadstamp": [stamp], "status": ["dropped"], "lat_i": [-1], "lon_i": [-1], "v": [0.0], "n": [0], "days": [bin(days).count("1")]})
        return
    kinds = (np.int64, np.float64, np.int64)
    parts, ends = [[np.frombuffer(p, k) for p, k in zip(packed, kinds)]], 0
    for pdf in batches:
        for r in pdf.itertuples():
            days |= 1 << r.day
            ends = r.ends
            parts.append([np.frombuffer(p, k) for p, k in zip((r.cells, r.sums, r.counts), kinds)])
    if done:
        return
    cells, sums, counts = _add_up(*(np.concatenate(c) for c in zip(*parts)))
    if days == ALL_DAYS:
        done = True
        if len(cells):
            yield pd.DataFrame({
                "ds": ds, "pentadstamp": stamp, "status": "complete", "lat_i": (cells >> 32).astype(np.int32), "lon_i": (cells & 0xFFFFFFFF).astype(np.int32),
                "v": sums / counts, "n": counts, "days": pentad.DAYS,
            })
        cells, sums, counts = cells[:0], sums[:0], counts[:0]
    state.update((int(days), done, cells.tobytes(), sums.tobytes(), counts.tobytes()))
    state.setTimeoutTimestamp(int(ends))


def strict_pentads(daily: DataFrame, delay: str, blocks: int = BLOCKS) -> DataFrame:
    """ds, pentadstamp, status, lat_i, lon_i, v, n, days from a stream of days (ds, d, lat_i, lon_i, v).

    A row a cell of ``complete`` pentads, given out once; a row without a cell of ``dropped`` ones with
    the days that they had.  A day is late, and left out, when a day more than ``delay`` after it was
    seen in an earlier batch.  Cells with null values count for their day only.
    """
    d = F.col("d").cast("date")
    index = lambda c: F.coalesce(F.col(c).cast("int"), F.lit(NOWHERE)).cast("long")
    cell = F.shiftleft(index("lat_i"), 32).bitwiseOR(index("lon_i").bitwiseAND(F.lit(0xFFFFFFFF)))
    v = F.col("v").cast("double")
    rows = daily.where(pentad.stamp_of(d).isNotNull()).select("ds", d.alias("d"), cell.alias("cell"), F.when(~F.isnan(v), v).alias("v"))
    stamp = pentad.stamp_of(F.col("d"))
    sums = rows.mapInArrow(_combine(blocks), _SENT).select(
        "ds", stamp.alias("pentadstamp"), "block", F.col("d").cast("timestamp").alias("t"), F.pmod(F.dayofyear("d") - 1, F.lit(pentad.DAYS)).cast("int").alias("day"),
        F.unix_millis(pentad.end_of(stamp).cast("timestamp")).alias("ends"), "cells", "sums", "counts",
    ).withWatermark("t", delay)
    out = sums.groupBy("ds", "pentadstamp", "block").applyInPandasWithState(_step, OUT, STATE, "append", GroupStateTimeout.EventTimeTimeout)
    whole = lambda c: F.when(F.col("status") == "complete", F.nullif(F.col(c), F.lit(NOWHERE)) if c in ("lat_i", "lon_i") else F.col(c)).alias(c)
    return out.select("ds", "pentadstamp", "status", whole("lat_i"), whole("lon_i"), whole("v"), whole("n"), "days")


def run(daily: DataFrame, path: str, delay: str, blocks: int = BLOCKS) -> None:
    """Process what has newly arrived, with the state of earlier runs, into Parquet below ``path``, and stop."""
    out = strict_pentads(daily, delay, blocks)
    query = out.writeStream.format("parquet").option("path", f"{path}/pentads").option("checkpointLocation", f"{path}/progress").outputMode("append").trigger(availableNow=True).start()
    query.awaitTermination()
