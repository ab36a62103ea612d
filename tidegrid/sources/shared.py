"""The folder that the driver and all executors share, and intermediate tables in it."""

from __future__ import annotations

import atexit
import contextlib
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


#: Work folders of this process that are still there, with their session.
made: dict[str, SparkSession] = {}


def work_folder(spark: SparkSession) -> str:
    """A new folder under spark.checkpoint.dir; a temporary one only in local mode without that setting.

    What is still there when the process ends is deleted, as nothing can read it any more.
    """
    conf = spark.sparkContext.getConf()
    root = conf.get("spark.checkpoint.dir", None) or spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not conf.get("spark.master", "").startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        root = tempfile.gettempdir()
    if not made:
        atexit.register(delete_all)  # after the session's own handler was registered, so before it runs
    path = f"{root.rstrip('/')}/fields-{uuid.uuid4().hex}"
    made[path] = spark
    return path


def materialize(df: DataFrame) -> tuple[DataFrame, str]:
    """``df`` written as Parquet to a new work folder and read again, and that folder."""
    path = work_folder(df.sparkSession)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path), path


def delete_all() -> None:
    for path, spark in list(made.items()):
        with contextlib.suppress(Exception):  # a session that was stopped before
            delete_folder(spark, path)


def delete_folder(spark: SparkSession, path: str) -> None:
    made.pop(path, None)
    target = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(target, True)
