"""Principal components of fields: by the snapshot method for few samples, by random ranges for many.

The Gram matrix of the samples is summed from per-task blocks; only that matrix (samples squared,
at most ``MOST_SAMPLES`` squared) reaches the driver.  Modes are then products of a block of cells
with the samples' eigenvectors.  Beyond that, a randomised range finder multiplies the cells by a few
vectors over the samples, and what reaches the driver grows with samples times modes.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidegrid.functions.aggregates import avg_strict, sign_of_mode, std_pop_strict
from tidegrid.operators import fields, grids
from tidegrid.sources.shared import materialize

MOST_SAMPLES = 2048


def anomalies(rows: DataFrame, samples: int) -> DataFrame:
    """cell, a: each cell's values of samples 0.. less their mean; cells that lack a sample are left out."""
    lined = rows.where(F.col("v").isNotNull()).groupBy("cell").agg(F.sort_array(F.collect_list(F.struct("sample", "v"))).alias("s"))
    lined = lined.where(F.size("s") == samples).select("cell", F.col("s.v").alias("a"))
    mean = F.aggregate("a", F.lit(0.0), lambda t, x: t + x) / samples
    return lined.withColumn("_mean", mean).select("cell", F.transform("a", lambda x: x - F.col("_mean")).alias("a"))


def gram(cells: DataFrame) -> DataFrame:
    """s, t, g for s <= t: sums over cells of the products of two samples."""

    def blocks(batches):
        total = None
        for pdf in batches:
            if len(pdf):
                x = _columns(pdf["a"])
                total = x.T @ x + (0 if total is None else total)
        if total is not None:
            s, t = np.triu_indices(len(total))
            yield pd.DataFrame({"s": s, "t": t, "g": total[s, t]})

    return cells.select("a").mapInPandas(blocks, "s int, t int, g double").groupBy("s", "t").agg(F.sum("g").alias("g"))


def decompose(products: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """(eigenvalues descending, eigenvectors as columns) of the samples' Gram matrix.

    Samples squared come to the driver, so ``modes`` asks for no more than ``MOST_SAMPLES``; no rows
    give an empty decomposition.
    """
    rows = products.toArrow()  # samples squared, as columns
    if not rows.num_rows:
        return np.zeros(0), np.zeros((0, 0))
    s, t, g = (rows.column(c).to_numpy() for c in ("s", "t", "g"))
    n = int(t.max()) + 1
    full = np.zeros((n, n))
    full[s, t] = full[t, s] = g
    values, vectors = np.linalg.eigh(full)
    return np.maximum(values[::-1], 0.0), vectors[:, ::-1]


def _columns(arrays: pd.Series) -> np.ndarray:
    return np.stack([np.asarray(a) for a in arrays])


def triangle(cells: DataFrame, by: np.ndarray) -> np.ndarray:
    """R of the QR decomposition of cells times ``by``: each task's own R first, theirs together after."""
    width = by.shape[1]

    def own(batches):
        r = np.zeros((0, width))
        for pdf in batches:
            if len(pdf):
                r = np.linalg.qr(np.concatenate([r, _columns(pdf["a"]) @ by]), mode="r")
        if len(r):
            yield pd.DataFrame({"r": [r.ravel().tolist()]})

    parts = cells.select("a").mapInPandas(own, "r array<double>").repartition(1).mapInPandas(
        lambda batches: _stacked(batches, width), "r array<double>"
    )  # a few numbers a task
    rows = parts.collect()
    return np.reshape(rows[0].r, (-1, width)) if rows else np.zeros((0, width))


def _stacked(batches, width: int):
    r = np.zeros((0, width))
    for pdf in batches:
        for one in pdf["r"]:
            r = np.linalg.qr(np.concatenate([r, np.reshape(one, (-1, width))]), mode="r")
    if len(r):
        yield pd.DataFrame({"r": [r.ravel().tolist()]})


def back_product(cells: DataFrame, by: np.ndarray) -> np.ndarray:
    """Transposed cells times (cells times ``by``): samples by vectors, each task's sum added up by sample."""

    def own(batches):
        total = None
        for pdf in batches:
            if len(pdf):
                x = _columns(pdf["a"])
                total = x.T @ (x @ by) + (0 if total is None else total)
        if total is not None:
            yield pd.DataFrame({"sample": np.arange(len(total)), "z": total.tolist()})

    width = by.shape[1]
    summed = cells.select("a").mapInPandas(own, "sample int, z array<double>").groupBy("sample").agg(F.array(*[F.sum(F.col("z")[i]) for i in range(width)]).alias("z"))
    out = np.zeros(by.shape)
    for r in summed.toLocalIterator():
        out[r.sample] = r.z
    return out


def random_range(cells: DataFrame, samples: int, n_modes: int, more: int = 10, powers: int = 4) -> tuple[np.ndarray, np.ndarray]:
    """Leading eigenvalues and eigenvectors of the samples' Gram matrix, which is never made.

    ``n_modes + more`` random vectors, turned ``powers`` times towards the leading ones by products with
    the cells; the triangle of their image has the singular values.  Errors fall with the ratio of an
    eigenvalue to the first one left out, to the power of ``2 * powers + 1``.
    """
    width = min(samples, n_modes + more)
    by = np.linalg.qr(np.random.default_rng(1).standard_normal((samples, width)))[0]
    for _ in range(powers):
        by = np.linalg.qr(back_product(cells, by))[0]
    r = triangle(cells, by)
    if not len(r):
        return np.zeros(0), np.zeros((samples, 0))
    _, singular, turn = np.linalg.svd(r)
    return singular**2, by @ turn.T[:, : len(singular)]


def modes(cells: DataFrame, n_modes: int, most_samples: int = MOST_SAMPLES) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(mode, cell, v), (mode, sample, pc) and (mode, variance, share, share_of_kept).

    Modes have unit length over cells; the sign makes at least half of the values nonnegative.
    share is of the total variance, share_of_kept of the modes returned.  An empty table and a
    single sample (which has no anomaly) give no modes.  The anomalies are written once to the
    shared folder, as the Gram matrix, the signs and the maps all read them.  More than
    ``most_samples`` samples are decomposed by ``random_range``.
    """
    spark = cells.sparkSession
    cells, _ = materialize(cells)
    first = cells.select(F.size("a").alias("n")).first()
    n = first.n if first else 0
    if n > most_samples:
        values, vectors = random_range(cells, n, n_modes)
        total = float(cells.agg(F.sum(F.aggregate("a", F.lit(0.0), lambda t, x: t + x * x)).alias("t")).first().t)
    else:
        values, vectors = decompose(gram(cells))
        total = float(values.sum())
    used = [k for k in range(min(n_modes, len(values))) if values[k] > 1e-10 * max(total, 1e-300)]
    factors = vectors[:, used] / np.sqrt(values[used])
    kind = cells.schema["cell"].dataType.simpleString()

    def project(batches):
        for pdf in batches:
            if len(pdf) and used:
                x = _columns(pdf["a"]) @ factors
                yield pd.DataFrame({"mode": np.tile(used, len(x)), "cell": pdf["cell"].repeat(len(used)).reset_index(drop=True), "v": x.ravel()})

    maps = cells.mapInPandas(project, f"mode int, cell {kind}, v double")
    signs = maps.groupBy("mode").agg(sign_of_mode(F.col("v")).alias("sign"))
    maps = maps.join(F.broadcast(signs), "mode").select("mode", "cell", (F.col("v") * F.col("sign")).alias("v"))  # a row a mode
    pcs = spark.createDataFrame(
        [(k, s, float(vectors[s, k] * np.sqrt(values[k]))) for k in used for s in range(n)], "mode int, sample int, pc double"
    ).join(F.broadcast(signs), "mode").select("mode", "sample", (F.col("pc") * F.col("sign")).alias("pc"))
    kept = sum(float(values[k]) for k in used)
    variance = spark.createDataFrame(
        [(k, float(values[k] / (n - 1)), float(values[k] / total), float(values[k] / kept)) for k in used],
        "mode int, variance double, share double, share_of_kept double",
    )
    return maps, pcs, variance


def normalised(maps: DataFrame) -> DataFrame:
    """Modes divided by three population standard deviations over cells, for display."""
    spread = maps.groupBy("mode").agg(F.stddev_pop("v").alias("std"))
    return maps.join(F.broadcast(spread), "mode").select("mode", "cell", F.try_divide(F.col("v"), 3 * F.col("std")).alias("v"))


def stacked_differences(rows: DataFrame, names: list[str], stamps: DataFrame, mode: str = "all", half: int = 0) -> tuple[DataFrame, int]:
    """(sample, lat_i, lon_i, v) of product differences, and the number of samples.

    Differences of the pairs of ``names`` (``mode`` as in ``fields.pairs``) at every pentad of
    ``stamps`` are smoothed by a box of ``half`` cells to each side (0: not) and stacked: sample =
    pair * number of pentads + rank of the pentad.  Cells without a value have no row.
    """
    order = [r.pentadstamp for r in stamps.select("pentadstamp").distinct().orderBy("pentadstamp").collect()]  # a time axis
    ranks = rows.sparkSession.createDataFrame(list(zip(order, range(len(order)))), "pentadstamp int, rank int")
    pairs = fields.pairs(names, mode)
    diff = fields.differences(rows.join(F.broadcast(ranks.select("pentadstamp")), "pentadstamp", "left_semi"), names, mode)
    pair = F.element_at(F.create_map(*[F.lit(x) for k, (i, j) in enumerate(pairs) for x in (i * len(names) + j, k)]), F.col("i") * len(names) + F.col("j"))
    diff = diff.join(F.broadcast(ranks), "pentadstamp")
    diff = diff.select((pair * len(order) + F.col("rank")).cast("int").alias("sample"), "lat_i", "lon_i", F.col("diff").alias("v"))
    if half:
        # the box reaches cells that have no difference of their own, so every cell needs a row
        cells = rows.select("lat_i", "lon_i").distinct()
        grid = diff.select("sample").distinct().crossJoin(cells)  # samples beside the grid: the size of the stacked field
        diff = grids.box_filter(grid.join(diff, ["sample", "lat_i", "lon_i"], "left"), ["sample"], half)
    return diff.where(F.col("v").isNotNull()), len(pairs) * len(order)


def cell_stats(stacked: DataFrame, samples: int) -> DataFrame:
    """lat_i, lon_i, mean, std: over all samples of a cell, missing where one is missing."""
    whole = F.count("v") == samples
    return stacked.groupBy("lat_i", "lon_i").agg(
        F.when(whole, avg_strict(F.col("v"))).alias("mean"), F.when(whole, std_pop_strict(F.col("v"))).alias("std")
    )


def as_cells(stacked: DataFrame, samples: int, mask: DataFrame | None = None) -> DataFrame:
    """Anomalies of the cells that have every sample and, with ``mask`` (lat_i, lon_i, mask), a mask of 1."""
    kept = stacked if mask is None else fields.compress(stacked, mask)
    cell = F.shiftleft(F.col("lat_i").cast("long"), 32) + F.col("lon_i")
    return anomalies(kept.select(cell.alias("cell"), "sample", "v"), samples)


def of_differences(
    rows: DataFrame, names: list[str], stamps: DataFrame, n_modes: int, mode: str = "all", half: int = 0, mask: DataFrame | None = None, most_samples: int = MOST_SAMPLES
) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
    """Modes of product differences: (mode, lat_i, lon_i, v on the whole grid), pcs, variance, cell stats.

    Differences, smoothing, stacking, centring, masking, decomposition and scattering back, with
    cells outside the mask missing.  Two names and ``half`` 0 give the modes of a single pair.
    """
    stacked, samples = stacked_differences(rows, names, stamps, mode, half)
    stacked, _ = materialize(stacked)
    maps, pcs, variance = modes(as_cells(stacked, samples, mask), n_modes, most_samples)
    low = F.col("cell").bitwiseAND(F.lit((1 << 32) - 1))
    flat = maps.select("mode", F.shiftright("cell", 32).cast("int").alias("lat_i"), low.cast("int").alias("lon_i"), "v")
    return fields.scatter(flat, rows, ["mode"]), pcs, variance, cell_stats(stacked, samples)
