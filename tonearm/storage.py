"""Where intermediate tables live: the shared folder that the cluster names."""

from __future__ import annotations

import ctypes
import gc
import tempfile
from collections.abc import Iterator
from contextlib import contextmanager, suppress

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
BATCH_CONF = {"spark.sql.execution.arrow.maxRecordsPerBatch": ("10000", "4000"), "spark.sql.execution.arrow.maxBytesPerBatch": ("268435456", "8388608")}


def shared_dir(spark: SparkSession) -> None:
    """Make ``checkpoint()`` usable: keep the cluster's folder; only a session in one process gets one of our own."""
    sc = spark.sparkContext
    if sc._jsc.sc().getCheckpointDir().isEmpty():
        folder = spark.conf.get("spark.checkpoint.dir", None)
        if not folder and not sc.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        sc.setCheckpointDir(folder or tempfile.mkdtemp(prefix="checkpoints-"))  # one process: any folder is shared


def checkpointed(df: DataFrame) -> DataFrame:
    """Lineage cut in the shared folder."""
    shared_dir(df.sparkSession)
    return df.checkpoint()


@contextmanager
def freeing(spark: SparkSession) -> Iterator[None]:
    """Within it, Spark deletes a query's shuffle files when the query ends; the caller's setting comes back afterwards."""
    before = spark.conf.get(CLEANUP, None)
    spark.conf.set(CLEANUP, "true")
    try:
        yield
    finally:
        spark.conf.unset(CLEANUP) if before is None else spark.conf.set(CLEANUP, before)


def settled(df: DataFrame) -> DataFrame:
    """``checkpointed``, with the shuffles that led to it deleted."""
    with freeing(df.sparkSession):
        return checkpointed(df.select("*"))  # a new query, as the setting holds for those made under it


def small_batches(spark: SparkSession) -> None:
    """Arrow batches of long arrays are cut by bytes as well as by rows, unless the session says otherwise."""
    for name, (default, ours) in BATCH_CONF.items():
        if spark.conf.get(name, default).rstrip("bB") in (default, "256m"):
            spark.conf.set(name, ours)


def trim() -> None:
    """Give free memory of a reused Python worker back, where the C library can."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    with suppress(OSError, AttributeError):
        ctypes.CDLL("libc.so.6").malloc_trim(0)
