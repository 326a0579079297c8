"""Intermediate tables in the folder that a cluster's executors share."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable
from concurrent.futures import ThreadPoolExecutor
from contextlib import contextmanager
from functools import reduce
from threading import Lock

from pyspark.sql import DataFrame, SparkSession

#: Spark's own setting that removes a query's shuffle files when the query ends.
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


_lock, _writers = Lock(), {}


@contextmanager
def _cleaning(spark: SparkSession):
    """The clean-up setting is on while any thread writes, and as it was once none does."""
    key = spark.sparkContext.applicationId
    with _lock:
        n, before = _writers.get(key) or (0, spark.conf.get(CLEANUP, "false"))
        _writers[key] = (n + 1, before)
        spark.conf.set(CLEANUP, "true")
    try:
        yield
    finally:
        with _lock:
            n, before = _writers[key]
            _writers[key] = (n - 1, before) if n > 1 else None
            if n == 1:
                spark.conf.set(CLEANUP, before)


def at_once(jobs: list[Callable[[], DataFrame]], most: int = 2) -> list[DataFrame]:
    """Results of jobs that Spark may run side by side, in their order; two are planned at a time, as the driver holds the plans of all that run."""
    with ThreadPoolExecutor(max_workers=most) as pool:
        return list(pool.map(lambda job: job(), jobs))


def scratch_dir(spark: SparkSession) -> str:
    """The folder all executors share (``spark.checkpoint.dir``); a local one is set only where none is named, as in tests."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named
    held = spark.sparkContext.getCheckpointDir()
    if held is None:
        spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="girder-"))
        held = spark.sparkContext.getCheckpointDir()
    return held


def tidy(spark: SparkSession) -> None:
    """Collect the driver's garbage once its heap has grown to two thirds of what it may take.

    Plans and their updates are short-lived, yet a heap that grew for them is
    only given back by a full collection, which also lets Spark drop the
    broadcasts and shuffles of queries that are over.
    """
    heap = spark._jvm.Runtime.getRuntime()
    if 3 * heap.totalMemory() > 2 * heap.maxMemory():
        spark._jvm.System.gc()


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` as Parquet in the shared folder and read it back: lineage is cut, lost executors cost no recomputation.

    The shuffle files that the write needed go with it. ``discard`` removes the
    table once what reads it has been written; tables that a returned DataFrame
    still reads stay until the folder's owner clears it.
    """
    spark = df.sparkSession
    path = f"{scratch_dir(spark)}/girder-{name}-{uuid.uuid4().hex}"
    schema = df.schema
    with _cleaning(spark):
        df.write.option("compression", "zstd").parquet(path)
    tidy(spark)
    out = spark.read.schema(schema).parquet(path)
    out.scratch_path, out.parts = path, [out]
    return out


def made_of(df: DataFrame, *tables: DataFrame) -> DataFrame:
    """``df``, which reads nothing but tables that ``materialize`` wrote, with those as its ``parts``."""
    df.parts = [part for t in tables for part in t.parts]
    return df


def together(*tables: DataFrame) -> DataFrame:
    """The rows of tables that ``materialize`` wrote: those of the same columns are one scan, not one each in every plan that reads them."""
    alike: dict[tuple, list[DataFrame]] = {}
    for t in tables:
        alike.setdefault(tuple(t.dtypes), []).append(t)
    scans = [own[0].sparkSession.read.schema(own[0].schema).parquet(*[t.scratch_path for t in own]) for own in alike.values()]
    return made_of(reduce(DataFrame.unionByName, scans), *tables)


def _at(df: DataFrame) -> tuple:
    path = df.sparkSession._jvm.org.apache.hadoop.fs.Path(df.scratch_path)
    return path, path.getFileSystem(df.sparkSession._jsc.hadoopConfiguration())


def exists(df: DataFrame) -> bool:
    """Whether a table that ``materialize`` wrote is still there."""
    path, files = _at(df)
    return files.exists(path)


def discard(*tables: DataFrame) -> None:
    """Remove tables that ``materialize`` wrote, through the file system that holds them."""
    for df in tables:
        if hasattr(df, "scratch_path"):
            path, files = _at(df)
            files.delete(path, True)
