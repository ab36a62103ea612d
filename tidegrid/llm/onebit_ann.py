"""Approximate nearest neighbours with randomly rotated one-bit codes.

Index: centroids fitted on a bounded sample split the vectors into lists; a vector is stored as the
signs of its randomly rotated offset from the centroid (one packed bit a dimension), the offset's
length, and the correction scalar <code, offset direction>.

Search: a query visits the nearest lists.  Its rotated offset is rounded to ``QUERY_BITS`` bits a
dimension, so the inner product with a code is a few ANDs and bit counts over packed words; the
scalars make it an unbiased estimate of the true one with a known error bound.  Codes alone decide
which vectors are read: first the ``k`` with the smallest estimates, whose exact distances bound the
k-th nearest, then those whose lower bound lies within.  A vector travels with its code to the block
of its list: where one row in a hundred is a query, every vector is a candidate of some query, and
looking candidates up by pairs moves many times more (README).
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tidegrid.llm.common import bound_batches, give_back, materialize, table

K = 10
QUERY_STEP = 100
FIT_SAMPLE = 20_000  # vectors that the centroids of a dimension are fitted on, about
MOST_DIMS = 16  # vector lengths that get centroids, those with the most rows; others have one list, in as many blocks as it needs
LIST_ROWS = 2048  # vectors of a list, about, up to MOST_LISTS lists: as many as the sample can tell apart
MOST_LISTS = 4096
PROBES = 256  # lists that a query visits at most, however many there are: about half a million vectors
QUERY_BITS = 4
BLOCK_ROWS = 4096  # codes in a block of a list, about
QUERY_ROWS = 1024  # queries that meet a block at once, about
ERROR_SIGMAS = 2.5  # of the estimate's error that a lower bound allows for
SEED = 20240229


def usable(vectors: DataFrame) -> DataFrame:
    """vec_id, embedding, row (a hash of both), dim of rows with an id and a finite vector that is not zero."""
    rows = vectors.select(
        F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>").alias("embedding")
    ).where(
        F.col("vec_id").isNotNull()
        & F.col("embedding").isNotNull()
        & F.forall("embedding", lambda x: x.isNotNull() & (F.abs(x) < F.lit(float("inf"))))
        & F.exists("embedding", lambda x: x != 0.0)
    )
    return rows.withColumns({"row": F.xxhash64("vec_id", "embedding"), "dim": F.size("embedding")})


def fit_centroids(sample: np.ndarray, lists: int, rounds: int = 8) -> np.ndarray:
    """Lloyd's iterations from distinct sample rows chosen by a fixed seed."""
    rng = np.random.default_rng(SEED)
    unique = np.unique(sample, axis=0)
    centers = unique[rng.permutation(len(unique))[:lists]].copy()
    for _ in range(rounds):
        near = nearest_lists(sample, centers, 1)[:, 0]
        for c in range(len(centers)):
            if (own := near == c).any():
                centers[c] = sample[own].mean(axis=0)
    return centers


def nearest_lists(rows: np.ndarray, centers: np.ndarray, n: int) -> np.ndarray:
    """Indices of the ``n`` nearest centers of each row, nearest first."""
    out = np.empty((len(rows), n), dtype=np.int64)
    for at in range(0, len(rows), 4096):
        part = rows[at : at + 4096]
        d = (centers**2).sum(axis=1)[None, :] - 2.0 * part @ centers.T
        some = np.argpartition(d, n - 1, axis=1)[:, :n]
        out[at : at + 4096] = np.take_along_axis(some, np.argsort(np.take_along_axis(d, some, 1), axis=1, kind="stable"), 1)
    return out


_ROTATIONS: dict[int, np.ndarray] = {}


def random_rotation(dim: int) -> np.ndarray:
    """The same random rotation wherever it is made; kept as long as the task runs."""
    if dim not in _ROTATIONS:
        q, r = np.linalg.qr(np.random.default_rng(SEED + 1).standard_normal((dim, dim)))
        _ROTATIONS[dim] = q * np.sign(np.diag(r))
    return _ROTATIONS[dim]


def _words(bits: np.ndarray) -> np.ndarray:
    """(rows, dim) truth values as packed 64-bit words."""
    packed = np.packbits(bits, axis=1)
    return np.pad(packed, ((0, 0), (0, -packed.shape[1] % 8))).view(np.uint64)


def encode(offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(codes as packed words, lengths, correction scalars) of offsets from a centroid."""
    turned = offsets @ random_rotation(offsets.shape[1])
    lengths = np.sqrt((offsets**2).sum(axis=1))
    correction = np.abs(turned).sum(axis=1) / np.where(lengths > 0, lengths, 1.0) / math.sqrt(offsets.shape[1])
    return _words(turned > 0), lengths, np.where(lengths > 0, correction, 1.0)


def estimate(codes, lengths, correction, offset: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(estimated squared distances, what they may lack) of coded vectors to one query's offset.

    sum(code * query) is taken from bit counts of the codes with the bit planes of the rounded query.
    """
    dim = len(offset)
    turned = offset @ random_rotation(dim)
    low, top = turned.min(), turned.max()
    step = (top - low) / ((1 << QUERY_BITS) - 1) or 1.0
    levels = np.rint((turned - low) / step).astype(np.int64)
    ones = np.bitwise_count(codes).sum(axis=1, dtype=np.int64)
    product = np.zeros(len(codes), dtype=np.int64)
    for bit in range(QUERY_BITS):
        plane = _words((levels >> bit & 1)[None, :] > 0)
        product += np.bitwise_count(codes & plane).sum(axis=1, dtype=np.int64) << bit
    dots = (2.0 * (step * product + low * ones) - turned.sum()) / math.sqrt(dim)
    size = math.sqrt(offset @ offset)
    about = lengths**2 + size**2 - 2.0 * lengths * dots / correction
    coded = size * np.sqrt(np.maximum(0.0, 1.0 - correction**2) / max(1, dim - 1))
    rounded = step / math.sqrt(3.0)
    return about, 2.0 * lengths / correction * ERROR_SIGMAS * np.hypot(coded, rounded)


def search_block(rows, codes, lengths, correction, ids, vectors, query_ids, query_rows, query_times, queries, center, k: int) -> pd.DataFrame:
    """query_id, query_row, times, vec_id, score: the ``k`` nearest of one block for every query.

    All rows tied with the k-th distance are compared, so ties go to the smaller vec_id.
    """
    asked, own_rows, times, found, scores = [], [], [], [], []
    for q_id, q_row, q_times, query in zip(query_ids, query_rows, query_times, queries):
        others = np.ones(len(ids), dtype=bool)
        others[np.flatnonzero((ids == q_id) & (rows == q_row))[:1]] = False  # the query's own row, one of equal ones
        others = np.flatnonzero(others)
        read = lambda at: ((vectors[at] - query) ** 2).sum(axis=1)
        chosen = others
        if len(others) > k:
            about, lack = estimate(codes, lengths, correction, query - center)
            first = others[np.argpartition(about[others], k - 1)[:k]]
            lower = (about - lack)[others]
            chosen = np.union1d(first, others[lower <= read(first).max() * (1 + 1e-9) + 1e-12])
        distance = np.sqrt(read(chosen))
        best = np.lexsort((ids[chosen], distance))[:k]
        for kept, value in ((asked, q_id), (own_rows, q_row), (times, q_times)):
            kept.append(np.full(len(best), value, dtype=np.int64))
        found.append(ids[chosen][best])
        scores.append(distance[best])
    joined = lambda parts, kind: np.concatenate(parts).astype(kind) if parts else np.zeros(0, kind)
    return pd.DataFrame({
        "query_id": joined(asked, np.int64), "query_row": joined(own_rows, np.int64), "times": joined(times, np.int64),
        "vec_id": joined(found, np.int64), "score": joined(scores, np.float64),
    })


def _fit(rows: DataFrame, n: int, dim: int, n_queries: int, probes: int) -> dict:
    """Centroids of one dimension, and how many blocks the codes and the queries of each list need."""
    own = rows.where(F.col("dim") == dim)
    drawn = own if n <= FIT_SAMPLE else own.where(F.pmod("row", F.lit(1 << 30)) < F.lit(int((1 << 30) * FIT_SAMPLE / n)))
    sample = np.array([r.embedding for r in drawn.orderBy("row").select("embedding").limit(2 * FIT_SAMPLE).collect()], dtype=np.float64)
    centers = fit_centroids(sample, min(MOST_LISTS, max(1, n // LIST_ROWS))) if len(sample) else np.zeros((1, dim))
    lists = len(centers)
    probes = min(lists, probes)
    seen = nearest_lists(sample, centers, probes) if len(sample) else np.zeros((1, 1), dtype=np.int64)
    share, visits = (np.bincount(x, minlength=lists) / len(seen) for x in (seen[:, 0], seen.ravel()))
    blocks = np.maximum(1, np.ceil(share * n / BLOCK_ROWS)).astype(int)
    q_blocks = np.maximum(1, np.ceil(visits * n_queries / QUERY_ROWS)).astype(int)
    return {"centers": centers, "probes": probes, "blocks": blocks, "q_blocks": q_blocks}


def search(vectors: DataFrame, is_query, k: int = K, probes: int = PROBES) -> DataFrame:
    """query_id, rank, vec_id, score: each query's ``k`` nearest other rows by Euclidean distance.

    ``is_query`` is a predicate on vec_id.  Null, zero, non-finite vectors and rows without a vec_id
    take no part; vectors are compared with those of their own length.  Every row that ``is_query`` takes
    is a query: an id with two vectors, or on two equal rows, has two results.  Only the query's own
    row is left out: rows that repeat it, or its id with another vector, are candidates like any other
    and count each.  Ties go to the smaller vec_id; fewer
    candidates than ``k`` in the lists visited are all returned; an empty table gives no rows; other
    columns are ignored, whatever their names.

    Every row is indexed, and a query visits the ``probes`` nearest lists: all of them in a table of up to
    half a million vectors, a fixed number of vectors up to ``LIST_ROWS * MOST_LISTS`` rows.  Lists are split into blocks by a hash of the row and queries into blocks
    as well, both sized from the fitted sample's shares, so a vector or list that holds a third of
    the rows is spread over many tasks.  The driver holds the sample and the centroids.
    """
    spark = vectors.sparkSession
    bound_batches(spark)
    rows = materialize(usable(vectors))  # a scan instead of the source for the fit, the codes and the look-ups
    result = "query_id long, rank int, vec_id long, score double"
    asked = rows.where(is_query).groupBy("vec_id", "row", "embedding", "dim").agg(F.count("*").alias("times"))
    counts = {r.dim: r["count"] for r in rows.groupBy("dim").count().collect()}  # a row a vector length
    if not counts:
        return spark.createDataFrame([], result)
    wanted = {r.dim: r["count"] for r in asked.groupBy("dim").count().collect()}
    common = sorted(wanted, key=lambda d: (-counts[d], d))[:MOST_DIMS]
    fitted = {d: _fit(rows, counts[d], d, wanted[d], probes) for d in common}
    parts = lambda n, size: np.full(1, max(1, -(-n // size)))
    one = lambda dim: {
        "centers": np.zeros((1, dim)), "probes": 1, "blocks": parts(counts.get(dim, 0), BLOCK_ROWS), "q_blocks": parts(wanted.get(dim, 0), QUERY_ROWS),
    }

    def index(batches):
        for pdf in batches:
            for dim, own in pdf.groupby("dim"):
                m = fitted.get(dim) or one(dim)
                x = np.array(own["embedding"].tolist(), dtype=np.float64)
                lst = nearest_lists(x, m["centers"], 1)[:, 0]
                codes, lengths, correction = encode(x - m["centers"][lst])
                out = pd.DataFrame(
                    {
                        "dim": own["dim"].to_numpy(), "list": lst, "block": own["row"].to_numpy() % m["blocks"][lst],
                        "vec_id": own["vec_id"].to_numpy(), "row": own["row"].to_numpy(), "embedding": own["embedding"].to_numpy(),
                        "code": [c.tobytes() for c in codes], "length": lengths, "correction": correction,
                    }
                )
                copies = m["q_blocks"][lst]
                out = out.loc[out.index.repeat(copies)]
                out["q_block"] = np.concatenate([np.arange(c) for c in copies])
                yield out
        give_back()

    def route(batches):
        for pdf in batches:
            for dim, own in pdf.groupby("dim"):
                m = fitted.get(dim) or one(dim)
                out = []
                x = np.array(own["embedding"].tolist(), dtype=np.float64)
                seen = nearest_lists(x, m["centers"], m["probes"])
                for vec_id, vector, row, times, visited in zip(own["vec_id"], own["embedding"], own["row"], own["times"], seen):
                    for lst in visited:
                        out += [(dim, lst, b, row % m["q_blocks"][lst], vec_id, row, times, vector) for b in range(m["blocks"][lst])]
                yield pd.DataFrame(out, columns=["dim", "list", "block", "q_block", "query_id", "row", "times", "embedding"])

    def meet(key, left, right):
        center = (fitted.get(key[0]) or one(key[0]))["centers"][key[1]]
        column = lambda df, c: df[c].to_numpy()
        matrix = lambda df: np.stack(df["embedding"].to_list()) if len(df) else np.zeros((0, len(center)))
        codes = np.frombuffer(b"".join(left["code"]), dtype=np.uint64).reshape(len(left), -1) if len(left) else np.zeros((0, 1), np.uint64)
        return search_block(
            column(left, "row"), codes, column(left, "length"), column(left, "correction"), column(left, "vec_id"), matrix(left),
            column(right, "query_id"), column(right, "row"), column(right, "times"), matrix(right), center, k,
        )

    coded = rows.mapInPandas(
        index,
        "dim int, list int, block long, vec_id long, row long, embedding array<double>, code binary, length double, correction double, q_block int",
    )
    routed = asked.mapInPandas(route, "dim int, list int, block long, q_block int, query_id long, row long, times long, embedding array<double>")
    keys = ["dim", "list", "block", "q_block"]
    near = coded.groupBy(*keys).cogroup(routed.groupBy(*keys)).applyInPandas(meet, "query_id long, query_row long, times long, vec_id long, score double")
    best = Window.partitionBy("query_id", "query_row").orderBy("score", "vec_id")
    near = near.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k)
    again = F.explode(F.array_repeat(F.lit(1), F.col("times").cast("int")))
    return near.select("query_id", "rank", "vec_id", "score", again.alias("_again")).drop("_again")


def op8_onebit_ann(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search(table(spark, sf_dir, "embeddings"), F.col("vec_id") % QUERY_STEP == 0)
