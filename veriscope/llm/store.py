"""Tables that cut lineage, kept in the folder that driver and executors share."""

from __future__ import annotations

import gc
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

_CONF = "spark.checkpoint.dir"


def shared_folder(spark: SparkSession) -> str:
    """The cluster's ``spark.checkpoint.dir``; where it is unset, a temporary folder on a local master, and an error on a cluster."""
    folder = spark.conf.get(_CONF, None)
    if not folder:
        if not spark.sparkContext.master.startswith("local") or spark.sparkContext.master.startswith("local-cluster"):
            raise ValueError(f"{_CONF} names no folder that driver and executors share")
        folder = "file://" + tempfile.mkdtemp(prefix="veriscope-")
        spark.conf.set(_CONF, folder)
    return folder.rstrip("/")


@contextmanager
def small_batches(spark: SparkSession, rows: int = 1000) -> Iterator[None]:
    """Arrow batches of ``rows`` rows for what runs inside: few where rows hold long texts, so that they fill little memory outside the heap."""
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(name)
    spark.conf.set(name, str(rows))
    try:
        yield
    finally:
        spark.conf.set(name, before)


def keep(df: DataFrame, rows: int = 1000) -> DataFrame:
    """Write ``df`` once as Parquet in the shared folder and return a scan of it; ``rows`` go to Python at once.

    A lost executor costs only the re-read of its splits; nothing upstream runs twice.
    """
    path = f"{shared_folder(df.sparkSession)}/veriscope-{uuid.uuid4().hex}"
    with small_batches(df.sparkSession, rows):
        df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def discard(*frames: DataFrame) -> None:
    """Delete tables written by :func:`keep` that nothing will read again."""
    for df in frames:
        spark = df.sparkSession
        for name in {f.rpartition("/")[0] for f in df.inputFiles()}:
            if "/veriscope-" in name:
                path = spark._jvm.org.apache.hadoop.fs.Path(name)
                path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def tidy(spark: SparkSession) -> None:
    """Let Spark delete the shuffle files of steps that nothing refers to any more.

    It does so when the driver collects garbage, which may otherwise not happen before the job ends.
    """
    gc.collect()
    spark._jvm.System.gc()
