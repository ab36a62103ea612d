"""Small helpers shared by the training-data operators."""

from __future__ import annotations

import contextlib
import ctypes
import math
import tempfile
import uuid
from collections import Counter
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Tables made by ``materialize`` that are still there, by path.
live: dict[str, DataFrame] = {}

BATCH_LIMIT, BATCH_BYTES = "spark.sql.execution.arrow.maxBytesPerBatch", 4 << 20


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    bound_batches(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The cluster's shared checkpoint folder; a temporary one only where none is set."""
    conf = spark.sparkContext.getConf()
    path = conf.get("spark.checkpoint.dir", None) or spark.conf.get("spark.checkpoint.dir", None)
    if path:
        return path
    master = conf.get("spark.master", "")
    if not master.startswith("local[") and master != "local":
        raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
    path = spark.sparkContext._jsc.sc().getCheckpointDir()
    if path.isDefined():
        return path.get()
    made = tempfile.mkdtemp(prefix="tidegrid-")
    spark.sparkContext.setCheckpointDir(made)
    return made


def materialize(df: DataFrame, files: int | None = None, key: str = "") -> DataFrame:
    """Cut lineage: write ``df`` as Parquet to the shared folder and read it back.

    ``files`` gathers a table of bounded size in so many files, so that jobs over it are small; rows
    are dealt and sorted by ``key``, so their order does not hang on the session's settings.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark).rstrip('/')}/tidegrid-{uuid.uuid4().hex}"
    if files is not None:
        df = df.repartition(files, key).sortWithinPartitions(key)
    df.write.parquet(path)
    back = spark.read.schema(df.schema).parquet(path)
    back._tidegrid_path = path
    live[path] = back
    return back


def release(*tables: DataFrame) -> None:
    """Delete the files of tables made by ``materialize`` once nothing reads them any more."""
    for df in tables:
        spark = df.sparkSession
        live.pop(df._tidegrid_path, None)
        path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(df._tidegrid_path)
        path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def bound_batches(spark: SparkSession) -> None:
    """Bound what one Arrow batch holds, so that long texts do not meet by thousands in a worker.

    A limit that the session has set itself stays.
    """
    if spark.conf.get(BATCH_LIMIT, None) is None:
        spark.conf.set(BATCH_LIMIT, BATCH_BYTES)


def give_back() -> None:
    """Hand memory that this Python worker has freed back to the system; idle workers live on."""
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):
        ctypes.CDLL(None).malloc_trim(0)


def tidy(work):
    """``work`` over batches; its worker gives freed memory back when the task ends."""

    def run(batches):
        yield from work(batches)
        give_back()

    return run


def drawn(share, *columns) -> F.Column:
    """Whether a row is in the sample of this share: its hash decides, so any run draws the same rows."""
    return F.pmod(F.xxhash64(F.lit("draw"), *columns), F.lit(1 << 31)) < share * F.lit(float(1 << 31))


def crc_text(col) -> F.Column:
    """CRC-32 (unsigned) of the UTF-8 bytes of ``col``; null as empty."""
    return F.crc32(F.coalesce(col.cast("string"), F.lit("")).cast("binary"))


def chunk_of(col, bounds: list, inclusive: bool = False) -> F.Column:
    """Index of the run that ``col`` falls into: runs ascend with the key, nulls are in run 0.

    A run begins behind its bound, or with ``inclusive`` at it.  Looks up a coarse cut first and then
    the fine cuts behind it, so a row compares with about twice the square root of their number.
    """
    if not bounds:
        return F.lit(0)
    passed = lambda some: F.array_size(F.filter(some, lambda b: b <= col if inclusive else b < col))
    step = max(1, math.isqrt(len(bounds)))
    groups = [bounds[i : i + step] for i in range(0, len(bounds), step)]
    coarse = F.array(*[F.lit(g[-1]) for g in groups])
    fine = F.array(*[F.array(*[F.lit(b) for b in g]) for g in groups])
    at = passed(coarse)
    found = F.when(at >= F.lit(len(groups)), F.lit(len(bounds))).otherwise(at * F.lit(step) + passed(F.get(fine, at)))
    return F.when(col.isNull(), F.lit(0)).otherwise(found)


RUN_PARTS = 1 << 20  # parts of a run at most


@dataclass
class Runs:
    """Where a sorted table is cut: bounds of the key, and in how many parts the rows of each run are dealt by a second number."""

    bounds: list
    parts: list[int]
    null_parts: int

    @property
    def tied(self) -> bool:
        """Whether some key, or no key, is on more rows than a run should have."""
        return self.null_parts > 1 or max(self.parts) > 1

    def of(self, key, tie) -> F.Column:
        """Number of a row's run: they ascend with the key, nulls first, and in it with ``tie`` (0 to 2 ** 32 - 1)."""
        run = chunk_of(key, self.bounds)
        parts = F.get(F.array(*[F.lit(p) for p in self.parts]), run) if max(self.parts) > 1 else F.lit(1)
        part = lambda n: F.floor(tie * n / F.lit(float(1 << 32))).cast("long")
        return F.when(key.isNull(), part(F.lit(self.null_parts))).otherwise((run.cast("long") + 1) * RUN_PARTS + part(parts))


def sorted_runs(df: DataFrame, key: str, rows_per_run: int, most: int = 32768) -> Runs:
    """Runs of about ``rows_per_run`` rows by a whole-number key; a key on more rows than that is a run of its own, in parts.

    Such a key is told by its coming up more than once among the quantiles.  Only these few numbers (at
    most ``most``) reach the driver; they come from Spark's mergeable quantile summary, so no row is
    sorted or gathered for them.
    """
    n, held = df.agg(F.count("*"), F.count(key)).first()
    k = min(most, held // rows_per_run)
    got: list = []
    if k:
        got = df.agg(F.percentile_approx(key, [i / (k + 1) for i in range(1, k + 1)], max(10000, 10 * k)).alias("q")).first().q
    several = {value: times + 1 for value, times in Counter(got).items() if times > 1}
    bounds = sorted({*got, *several, *(value - 1 for value in several)})
    parts = [1] * (len(bounds) + 1)
    for value, times in several.items():
        parts[bounds.index(value)] = times  # the run behind value - 1, up to value
    return Runs(bounds, parts, max(1, -(-(n - held) // rows_per_run)))
