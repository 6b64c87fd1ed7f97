"""Scratch tables in the folder that the driver and all executors share.

A table written here cuts the lineage of an iterative job and survives the loss of an executor. The folder is the
session's ``spark.checkpoint.dir``; where that is unset, a session on one machine uses a folder of its own, and any other
ends with an error.
"""

from __future__ import annotations

import itertools
import tempfile
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

_NUMBERS = itertools.count()
_LEFT: dict[str, Callable[[], None]] = {}


def in_worker(owner: str, free: Callable[[], None] | None = None) -> None:
    """To be called where an operator starts in a Python worker: frees the lookup tables that others have left there.

    Workers live on from stage to stage, and with them what an earlier stage has kept; ``free`` empties the owner's.
    """
    for name in [n for n in _LEFT if n != owner]:
        _LEFT.pop(name)()
    if free is not None:
        _LEFT[owner] = free
    pa.default_memory_pool().release_unused()


def shared_root(spark: SparkSession) -> str:
    """The shared folder named by the session; where none is named, one of this machine, if it is the only one."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        root = f"{tempfile.gettempdir()}/cuelight-shared"
    return root.rstrip("/")


class Scratch:
    """Tables of one operator call. ``drop`` deletes one that nothing reads any longer; the rest go when the JVM ends."""

    def __init__(self, spark: SparkSession, name: str):
        self.spark = spark
        self.base = f"{shared_root(spark)}/cuelight/{name}-{uuid.uuid4().hex}"
        path = spark._jvm.org.apache.hadoop.fs.Path(self.base)
        self._fs = path.getFileSystem(spark._jsc.hadoopConfiguration())
        self._fs.deleteOnExit(path)

    def table(self, df: DataFrame, label: str = "t", **options: str) -> DataFrame:
        """Write ``df`` as Parquet and return the stored table. Shuffle files of the job go when it ends."""
        path = f"{self.base}/{label}-{next(_NUMBERS)}"
        with _setting(self.spark, "spark.sql.classic.shuffleDependency.fileCleanup.enabled", "true"):
            df.write.options(**options).parquet(path)
        out = self.spark.read.schema(df.schema).parquet(path)
        out.scratch_path = path
        return out

    def drop(self, *tables: DataFrame) -> None:
        for t in tables:
            self._fs.delete(self.spark._jvm.org.apache.hadoop.fs.Path(t.scratch_path), True)


@contextmanager
def _setting(spark: SparkSession, name: str, value: str) -> Iterator[None]:
    before = spark.conf.get(name)
    spark.conf.set(name, value)
    try:
        yield
    finally:
        spark.conf.set(name, before)


def small_batches(spark: SparkSession, most: str = "4m"):
    """Jobs that run inside send Python at most about ``most`` bytes at a time: for rows that hold whole blocks."""
    return _setting(spark, "spark.sql.execution.arrow.maxBytesPerBatch", most)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One input table of a registered query."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
