"""Intermediate tables in the folder that all executors share."""

from __future__ import annotations

import atexit
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_left: dict[str, SparkSession] = {}


def shared_dir(spark: SparkSession) -> str:
    """The folder of spark.checkpoint.dir. Where that is unset, a new folder of
    this machine, if all executors are on it; on a cluster it's an error."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        folder = "file://" + tempfile.mkdtemp(prefix="geoloom-")
        spark.conf.set("spark.checkpoint.dir", folder)
    return folder.rstrip("/")


def cut(df: DataFrame, name: str = "step") -> DataFrame:
    """df as a written table in the shared folder, so that a lost executor costs
    no recomputation. `discard` deletes it; what a result still reads goes when
    the session's process ends."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/geoloom/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._cut_path = path
    if not _left:
        atexit.register(_sweep)
    _left[path] = spark
    return out


def _delete(spark: SparkSession, path: str) -> None:
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)


def discard(*tables: DataFrame) -> None:
    """Delete tables of `cut` that nothing will read again."""
    for df in tables:
        if _left.pop(df._cut_path, None):
            _delete(df.sparkSession, df._cut_path)


def _sweep() -> None:
    for path, spark in _left.items():
        try:
            _delete(spark, path)
        except Exception:  # the session ended before
            return
