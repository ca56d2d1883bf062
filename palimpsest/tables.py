"""Reading the named tables of a data folder and keeping intermediate tables where every executor sees them."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager
from contextvars import ContextVar

from pyspark.sql import DataFrame, SparkSession


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One Parquet table of a data folder, read by Spark so that any file system Spark knows will do."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder the cluster names in spark.checkpoint.dir; a fresh temporary one only where none is set and all runs on one machine."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share; a temporary one would be the driver's alone")
        spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="spark-"))
        found = spark.sparkContext.getCheckpointDir()
    return found.rstrip("/")


#: Folders written in the innermost scratch of this thread; None outside of any.
_WRITTEN: ContextVar[list[str] | None] = ContextVar("written", default=None)


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Cut the lineage: write df as Parquet in the shared folder and read it back.

    A lost executor then costs a re-read of the files, not a recomputation, and several
    readers share one evaluation.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{spark.sparkContext.applicationId}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out.kept_at = path
    if (own := _WRITTEN.get()) is not None:
        own.append(path)
    return out


def _delete(spark: SparkSession, path: str) -> None:
    """Delete a folder; one that is gone already is left alone."""
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True)


def discard(*tables: DataFrame) -> None:
    """Delete materialised tables that nothing will read any more; other DataFrames are left alone."""
    for df in tables:
        if path := getattr(df, "kept_at", None):
            _delete(df.sparkSession, path)


@contextmanager
def scratch(spark: SparkSession) -> Iterator[Callable[[DataFrame], DataFrame]]:
    """Tables that this thread materialises within are deleted at the end, but for those handed to the function that is given.

    For work whose result is written before the end; what was only planned within can't be read afterwards. What an inner scratch
    keeps belongs to the outer one.
    """
    outer, own, kept = _WRITTEN.get(), [], set()

    def keep(df: DataFrame) -> DataFrame:
        kept.add(df.kept_at)
        return df

    before = _WRITTEN.set(own)
    try:
        yield keep
    finally:
        _WRITTEN.reset(before)
    for path in own:
        if path not in kept:
            _delete(spark, path)
        elif outer is not None:
            outer.append(path)
