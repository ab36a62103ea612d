"""Operators on layers (key, lat_i, lon_i, v): interpolation, smoothing and filling."""

from __future__ import annotations

import bisect
import math

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tidegrid.sources.shared import delete_folder, materialize

LAYER_CELLS = 4_000_000  # a layer up to this size (32 MB) is swept inside one task
TILE, REACH = 1024, 32  # cells a side of a tile of a larger one, about, and sweeps between two exchanges


def axis(low: float, high: float, step: float) -> list[float]:
    """low, low + step, ... below high, safe against rounding at the end."""
    return [low + i * step for i in range(max(0, math.ceil((high - low) / step - 1e-9)))]


def axis_weights(spark: SparkSession, source: list[float], target: list[float], name: str, clamp: bool = False) -> DataFrame:
    """{name}_t, {name}_s, {name}_w: the source indices and weights of every target point of an axis.

    Points outside the source have no rows unless ``clamp`` moves them to the edge; weights of 0
    are left out.  The table is as long as an axis, never as a field.
    """
    order = sorted(range(len(source)), key=source.__getitem__)  # depths may descend
    points, rows = [source[i] for i in order], []
    for t, x in enumerate(target):
        x = min(max(x, points[0]), points[-1]) if clamp else x
        if not points[0] - 1e-9 <= x <= points[-1] + 1e-9:
            continue
        s = max(0, min(len(points) - 2, bisect.bisect_right(points, x + 1e-9) - 1))
        w = (x - points[s]) / (points[s + 1] - points[s]) if len(points) > 1 else 0.0
        rows += [(t, order[i], c) for i, c in ((s, 1.0 - w), (s + 1, w)) if abs(c) > 1e-9]
    return spark.createDataFrame(rows, f"{name}_t int, {name}_s int, {name}_w double")


def regrid(fields: DataFrame, keys: list[str], lat_weights: DataFrame, lon_weights: DataFrame) -> DataFrame:
    """Bilinear values on the target grid; missing if a corner with weight is.

    Rows are joined with the two axis tables (broadcast: an axis long) and summed once.
    """
    rows = fields.join(F.broadcast(lat_weights), F.col("lat_i") == F.col("lat_s")).join(F.broadcast(lon_weights), F.col("lon_i") == F.col("lon_s"))
    w = F.col("lat_w") * F.col("lon_w")
    out = rows.groupBy(*keys, "lat_t", "lon_t").agg(F.sum(F.when(F.col("v").isNotNull(), w)).alias("w"), F.sum(w * F.col("v")).alias("v"))
    whole = F.when(F.col("w") > 1.0 - 1e-6, F.col("v"))
    return out.select(*keys, F.col("lat_t").alias("lat_i"), F.col("lon_t").alias("lon_i"), whole.alias("v"))


def regrid_staggered(
    columns: DataFrame,
    keys: list[str],
    source: dict[str, list[float]],
    target: dict[str, list[float]],
    land: DataFrame,
    sweeps: int,
    extend_downward: bool = True,
    fill_value: float = 0.0,
    valid: tuple[float, float] = (float("-inf"), float("inf")),
) -> DataFrame:
    """keys, k, lat_i, lon_i, v, outside on the cells of one staggered target grid (T, U or V).

    ``source`` and ``target`` give the axes z, lat, lon; the target's are those of its staggering
    (a U grid takes the western faces' longitudes, a V grid the southern faces' latitudes).  In
    this order: gaps of each level are flooded from their neighbours, columns are carried down
    from their deepest value (``extend_downward``), each column is interpolated to the target's
    levels, and each level bilinearly with targets outside moved to the edge.  Target cells that
    ``land`` (k, lat_i, lon_i) lists are missing; other cells that are still missing take
    ``fill_value``.  ``outside`` tells whether an interpolated ocean value lies outside ``valid``.

    A target level outside the source's raises.  Axes are small lists; fields are shuffled for the
    flood and for each of the two interpolations, never joined with each other.
    """
    low, high = min(source["z"]), max(source["z"])
    if any(not low - 1e-9 <= z <= high + 1e-9 for z in target["z"]):
        raise ValueError("a target level lies outside the source's levels")
    spark = columns.sparkSession
    rows = flood_fill(columns.select(*keys, "k", "lat_i", "lon_i", "v"), [*keys, "k"], len(source["lat"]), len(source["lon"]), sweeps)
    if extend_downward:
        rows = fill_down(rows, [*keys, "lat_i", "lon_i"])
    levels = axis_weights(spark, source["z"], target["z"], "x")
    rows = interpolate(rows.withColumnRenamed("k", "axis_i"), [*keys, "lat_i", "lon_i"], levels).withColumnRenamed("axis_i", "k")
    lat, lon = (axis_weights(spark, source[c], target[c], c, clamp=True) for c in ("lat", "lon"))
    rows = regrid(rows, [*keys, "k"], lat, lon)
    rows = rows.join(land.select("k", "lat_i", "lon_i", F.lit(True).alias("_land")), ["k", "lat_i", "lon_i"], "left")
    wet = F.col("_land").isNull()
    outside = F.coalesce(wet & ((F.col("v") < valid[0]) | (F.col("v") > valid[1])), F.lit(False))
    return rows.select(*keys, "k", "lat_i", "lon_i", F.when(wet, F.coalesce("v", F.lit(fill_value))).alias("v"), outside.alias("outside"))


def interpolate(fields: DataFrame, keys: list[str], weights: DataFrame) -> DataFrame:
    """The same along one axis: rows (keys, axis_i, v) and weights named ``x``."""
    rows = fields.join(F.broadcast(weights), F.col("axis_i") == F.col("x_s"))
    out = rows.groupBy(*keys, "x_t").agg(F.sum(F.when(F.col("v").isNotNull(), F.col("x_w"))).alias("w"), F.sum(F.col("x_w") * F.col("v")).alias("v"))
    return out.select(*keys, F.col("x_t").alias("axis_i"), F.when(F.col("w") > 1.0 - 1e-6, F.col("v")).alias("v"))


def box_filter(fields: DataFrame, keys: list[str], half: int) -> DataFrame:
    """Mean of the present values in a (2 * half + 1)-wide square; the square is cut at the edges.

    Two passes of range windows over the indices, so gaps in the rows do not shift the square.
    """
    row = Window.partitionBy(*keys, "lat_i").orderBy("lon_i").rangeBetween(-half, half)
    column = Window.partitionBy(*keys, "lon_i").orderBy("lat_i").rangeBetween(-half, half)
    lines = fields.select(*keys, "lat_i", "lon_i", F.sum("v").over(row).alias("s"), F.count("v").over(row).alias("c"))
    return lines.select(
        *keys, "lat_i", "lon_i", F.try_divide(F.sum("s").over(column), F.sum("c").over(column)).alias("v")
    )


def kernel_filter(fields: DataFrame, keys: list[str], kernel: dict[tuple[int, int], float]) -> DataFrame:
    """Weighted mean of the present neighbours, by offsets; a cell without any stays missing.

    For any kernel; one that is a product of two axes' weights is cheaper with ``separable_filter``.
    """
    offsets = F.array(*[F.struct(F.lit(i).alias("di"), F.lit(j).alias("dj"), F.lit(w).alias("w")) for (i, j), w in kernel.items()])
    spread = fields.where(F.col("v").isNotNull()).select(*keys, "lat_i", "lon_i", "v", F.inline(offsets))
    spread = spread.groupBy(*keys, (F.col("lat_i") + F.col("di")).alias("lat_i"), (F.col("lon_i") + F.col("dj")).alias("lon_i")).agg(
        (F.sum(F.col("w") * F.col("v")) / F.sum("w")).alias("v")
    )
    return fields.select(*keys, "lat_i", "lon_i").join(spread, [*keys, "lat_i", "lon_i"], "left")


def separable_filter(fields: DataFrame, keys: list[str], weights: dict[int, float]) -> DataFrame:
    """The same for a kernel that is the product of ``weights`` (by offset) along both axes.

    Two passes, each of which sends a cell to as many cells as an axis has weights: 2 (2h+1)
    copies instead of (2h+1)^2.  Weighted sums and the weights of present cells go along together.
    """
    steps = F.array(*[F.struct(F.lit(i).alias("_d"), F.lit(w).alias("_w")) for i, w in weights.items()])
    present = fields.where(F.col("v").isNotNull()).select(*keys, "lat_i", "lon_i", F.col("v").alias("_s"), F.lit(1.0).alias("_c"))
    for axis_name, other in (("lon_i", "lat_i"), ("lat_i", "lon_i")):
        sent = present.select(*keys, "lat_i", "lon_i", "_s", "_c", F.inline(steps))
        present = sent.groupBy(*keys, other, (F.col(axis_name) + F.col("_d")).alias(axis_name)).agg(
            F.sum(F.col("_s") * F.col("_w")).alias("_s"), F.sum(F.col("_c") * F.col("_w")).alias("_c")
        )
    smooth = present.select(*keys, "lat_i", "lon_i", (F.col("_s") / F.col("_c")).alias("v"))
    return fields.select(*keys, "lat_i", "lon_i").join(smooth, [*keys, "lat_i", "lon_i"], "left")


def gauss_weights(half: int, sigma: float) -> dict[int, float]:
    return {i: math.exp(-(i * i) / (2 * sigma * sigma)) for i in range(-half, half + 1)}


def high_pass(fields: DataFrame, keys: list[str], n_lat: int, n_lon: int, half_lat: int, half_lon: int) -> DataFrame:
    """keys, lat_i, lon_i, v: the field less its mean over a window that is mirrored at the edges.

    A missing value counts as 0 in the mean and stays missing in the result.  Rows near an edge are
    repeated behind it (the edge cell first), so the mean is two passes of plain range windows.
    """

    def smoothed(rows: DataFrame, along: str, other: str, n: int, half: int) -> DataFrame:
        at = F.col(along)
        mirrors = F.filter(
            F.array(at, -at - 1, F.lit(2 * n - 1) - at), lambda x: x.between(-half, n - 1 + half)
        )
        window = Window.partitionBy(*keys, other).orderBy(along).rangeBetween(-half, half)
        spread = rows.select(*keys, other, F.explode(mirrors).alias(along), "_m", F.when(at >= 0, F.col("v")).alias("v"))
        return spread.select(*keys, "lat_i", "lon_i", "v", (F.sum("_m").over(window) / (2 * half + 1)).alias("_m")).where(
            F.col(along).between(0, n - 1)
        )

    if half_lat >= n_lat or half_lon >= n_lon:
        raise ValueError("a window reaches beyond the mirrored axis")
    rows = fields.select(*keys, "lat_i", "lon_i", "v", F.coalesce("v", F.lit(0.0)).alias("_m"))
    rows = smoothed(smoothed(rows, "lon_i", "lat_i", n_lon, half_lon), "lat_i", "lon_i", n_lat, half_lat)
    return rows.select(*keys, "lat_i", "lon_i", (F.col("v") - F.col("_m")).alias("v"))


def gauss_kernel(half: int, sigma: float) -> dict[tuple[int, int], float]:
    return {(i, j): math.exp(-(i * i + j * j) / (2 * sigma * sigma)) for i in range(-half, half + 1) for j in range(-half, half + 1)}


def fill_down(columns: DataFrame, keys: list[str]) -> DataFrame:
    """From the first gap below a present surface on, every deeper level takes the value above the gap.

    Rows (keys, k, v) with levels k from 0; a column whose surface is missing stays as it is.
    """
    own = Window.partitionBy(*keys)
    gap = F.min(F.when(F.col("v").isNull(), F.col("k"))).over(own)
    above = F.max(F.when(F.col("k") == F.col("_gap") - 1, F.col("v"))).over(own)
    rows = columns.withColumn("_gap", gap).withColumn("_above", above)
    filled = F.when((F.col("_gap") > 0) & (F.col("k") >= F.col("_gap")), F.col("_above")).otherwise(F.col("v"))
    return rows.select(*keys, "k", filled.alias("v"))


def flood_sweep(fields: DataFrame, keys: list[str], n_lat: int, n_lon: int, ocean: Column | None = None) -> DataFrame:
    """One sweep: missing ocean cells take the mean of their present four neighbours, both axes periodic.

    Each present value goes to its neighbours and is averaged there; a layer is never in one task.
    """
    steps = F.array(*[F.struct(F.lit(i).alias("di"), F.lit(j).alias("dj")) for i, j in ((1, 0), (-1, 0), (0, 1), (0, -1))])
    sent = fields.where(F.col("v").isNotNull()).select(*keys, "lat_i", "lon_i", "v", F.inline(steps))
    sent = sent.groupBy(
        *keys,
        F.pmod(F.col("lat_i") + F.col("di"), F.lit(n_lat)).alias("lat_i"),
        F.pmod(F.col("lon_i") + F.col("dj"), F.lit(n_lon)).alias("lon_i"),
    ).agg(F.avg("v").alias("_around"))
    rows = fields.join(sent, [*keys, "lat_i", "lon_i"], "left")
    fill = F.col("v").isNull() if ocean is None else F.col("v").isNull() & ocean
    return rows.select(*[c for c in fields.columns if c != "v"], F.when(fill, F.col("_around")).otherwise(F.col("v")).alias("v"))


def _flood_layers(fields: DataFrame, keys: list[str], n_lat: int, n_lon: int, sweeps: int) -> DataFrame:
    """Sweeps of whole layers, one layer a group: the grid's size bounds what a task holds."""

    def fill(pdf: pd.DataFrame) -> pd.DataFrame:
        at = (pdf["lat_i"].to_numpy(), pdf["lon_i"].to_numpy())
        values, wet = np.full((n_lat, n_lon), np.nan), np.zeros((n_lat, n_lon), dtype=bool)
        values[at], wet[at] = pdf["v"].to_numpy(dtype=float), pdf["_wet"].to_numpy(dtype=bool)
        for _ in range(sweeps):
            sides = np.stack([np.roll(values, step, axis) for axis in (0, 1) for step in (1, -1)])
            held = np.isfinite(sides)
            count = held.sum(axis=0)
            open_cells = wet & np.isnan(values) & (count > 0)
            if not open_cells.any():
                break
            values[open_cells] = np.where(held, sides, 0.0).sum(axis=0)[open_cells] / count[open_cells]
        out = pdf.drop(columns=["_wet"])
        out["v"] = pd.Series(values[at], index=pdf.index)
        return out

    schema = fields.drop("_wet").schema
    return fields.groupBy(*keys).applyInPandas(fill, schema).withColumn("v", F.nanvl("v", F.lit(None).cast("double")))


def _in_tiles(index: str, n: int, tiles: int, reach: int) -> Column:
    """(tile, local) of each tile that a place of a periodic axis of ``n`` lies in or within ``reach`` of.

    Tiles are ``n / tiles`` long, a place more or less; local counts from the tile's own first place.
    """
    at = F.col(index).cast("long")
    own = F.floor(((at + 1) * tiles - 1) / n)
    start = lambda t: F.floor(t * n / F.lit(tiles))

    def of(d):
        t = own + d
        local = at - start(t)
        near = (local >= -reach) & (local < start(t + 1) - start(t) + reach)
        return F.when(near, F.struct(F.pmod(t, F.lit(tiles)).cast("int").alias("tile"), local.cast("int").alias("local"), (d == 0).alias("own")))

    return F.filter(F.transform(F.array(F.lit(-1), F.lit(0), F.lit(1)), of), lambda e: e.isNotNull())


def _flood_tiles(fields: DataFrame, keys: list[str], n_lat: int, n_lon: int, sweeps: int, tile: int, reach: int) -> DataFrame:
    """Up to ``reach`` sweeps of tiles with a halo as wide: what is wrong at a halo's edge moves a cell a sweep."""
    tiles_lat, tiles_lon = max(1, n_lat // tile), max(1, n_lon // tile)
    rows = fields.withColumn("_y", F.explode(_in_tiles("lat_i", n_lat, tiles_lat, reach))).withColumn("_x", F.explode(_in_tiles("lon_i", n_lon, tiles_lon, reach)))
    columns = fields.columns
    flat = rows.select(*columns, "_y.tile", F.col("_x.tile").alias("tile_x"), F.col("_y.local").alias("y"), F.col("_x.local").alias("x"), (F.col("_y.own") & F.col("_x.own")).alias("_own"))

    def fill(pdf: pd.DataFrame) -> pd.DataFrame:
        y, x = pdf["y"].to_numpy() + reach, pdf["x"].to_numpy() + reach
        values, wet = np.full((y.max() + 1, x.max() + 1), np.nan), np.zeros((y.max() + 1, x.max() + 1), dtype=bool)
        values[y, x], wet[y, x] = pdf["v"].to_numpy(dtype=float), pdf["_wet"].to_numpy(dtype=bool)
        for _ in range(sweeps):
            around = np.pad(values, 1, constant_values=np.nan)
            sides = np.stack([around[:-2, 1:-1], around[2:, 1:-1], around[1:-1, :-2], around[1:-1, 2:]])
            held = np.isfinite(sides)
            count = held.sum(axis=0)
            open_cells = wet & np.isnan(values) & (count > 0)
            if not open_cells.any():
                break
            values[open_cells] = np.where(held, sides, 0.0).sum(axis=0)[open_cells] / count[open_cells]
        own = pdf["_own"].to_numpy()
        out = pdf.loc[own, columns].copy()
        out["v"] = values[y[own], x[own]]
        return out

    return flat.groupBy(*keys, "tile", "tile_x").applyInPandas(fill, fields.schema).withColumn("v", F.nanvl("v", F.lit(None).cast("double")))


def flood_fill(
    fields: DataFrame,
    keys: list[str],
    n_lat: int,
    n_lon: int,
    sweeps: int,
    ocean: Column | None = None,
    layer_cells: int = LAYER_CELLS,
    tile: int = TILE,
    reach: int = REACH,
) -> DataFrame:
    """``sweeps`` sweeps, or fewer where one changes nothing; a row a cell and layer.

    A grid of up to ``layer_cells`` cells is swept layer by layer after one shuffle.  Larger grids
    are cut into tiles of about ``tile`` cells a side, so a layer is many tasks; tiles get the cells
    within ``reach`` of them once for as many sweeps, and what they make is written to the shared
    folder before the next exchange.  Results are the same.
    """
    wet = F.lit(True) if ocean is None else F.coalesce(ocean, F.lit(False))
    columns, rows = fields.columns, fields.withColumn("_wet", wet)
    if n_lat * n_lon <= layer_cells:
        return _flood_layers(rows, keys, n_lat, n_lon, sweeps).select(*columns)
    reach = min(reach, max(1, n_lat // max(1, n_lat // tile)), max(1, n_lon // max(1, n_lon // tile)))
    spark, old, open_before = fields.sparkSession, None, None
    for done in range(0, sweeps, reach):
        rows, path = materialize(_flood_tiles(rows, keys, n_lat, n_lon, min(reach, sweeps - done), tile, reach))
        if old:
            delete_folder(spark, old)
        old, still_open = path, rows.where(F.col("_wet") & F.col("v").isNull()).count()
        if still_open in (0, open_before):
            break
        open_before = still_open
    return rows.select(*columns)
