"""Tables that grow by whole commits: the data first, then one row that names it.

Each commit writes its rows to a folder of its own and then one row to the log, in a folder of its own too. A reader
sees a commit whole or not at all, writers at the same time never meet, and nothing is overwritten.
"""

from __future__ import annotations

import tempfile
import time
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

_CONF = "spark.checkpoint.dir"
_LOG = "name string, part string, seq bigint, replaces array<string>, info map<string, string>"


def work_folder(spark: SparkSession, purpose: str) -> str:
    """A new folder name below ``spark.checkpoint.dir``; where that is unset, in a temporary folder of a local master."""
    base = spark.conf.get(_CONF, None)
    if not base:
        master = spark.sparkContext.master
        if not master.startswith("local") or master.startswith("local-cluster"):
            raise ValueError(f"{_CONF} names no folder that driver and executors share")
        base = "file://" + tempfile.mkdtemp(prefix="veriscope-")
        spark.conf.set(_CONF, base)
    return f"{base.rstrip('/')}/{purpose}-{uuid.uuid4().hex}"


def exists(spark: SparkSession, path: str) -> bool:
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    return place.getFileSystem(spark._jsc.hadoopConfiguration()).exists(place)


def remove(spark: SparkSession, path: str) -> None:
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    place.getFileSystem(spark._jsc.hadoopConfiguration()).delete(place, True)


def publish(rows: DataFrame, root: str, name: str, info: dict[str, str] | None = None, replaces: list[str] | None = None) -> str:
    """Write ``rows`` with their commit's number in ``_seq``, then the commit; returns the folder of the data."""
    spark, part = rows.sparkSession, f"{root}/data/{name}/{uuid.uuid4().hex}"
    seq = time.time_ns()
    rows.withColumn("_seq", F.lit(seq).cast("bigint")).write.parquet(part)
    commit = spark.createDataFrame([(name, part, seq, replaces or [], info or {})], _LOG)
    commit.coalesce(1).write.parquet(f"{root}/log/{uuid.uuid4().hex}")
    return part


def commits(spark: SparkSession, root: str, name: str | None = None) -> DataFrame:
    """The commits that count, as a table: those that no other commit replaces."""
    if not exists(spark, f"{root}/log"):
        return spark.createDataFrame([], _LOG)
    log = spark.read.schema(_LOG).option("recursiveFileLookup", True).parquet(f"{root}/log")
    log = log if name is None else log.where(F.col("name") == name)
    return log.join(log.select(F.explode("replaces").alias("part")), "part", "left_anti").select("name", "part", "seq", "replaces", "info")


def read(spark: SparkSession, root: str, name: str, schema: str, parts: list[str] | None = None) -> DataFrame:
    """Rows of all commits of ``name`` with ``_seq``. The list of commits, which compaction keeps short, passes through the driver."""
    if parts is None:
        parts = [r["part"] for r in commits(spark, root, name).select("part").collect()]
    schema = f"{schema}, _seq bigint"
    return spark.read.schema(schema).parquet(*parts) if parts else spark.createDataFrame([], schema)


def latest(rows: DataFrame, key: list[str]) -> DataFrame:
    """Merge on read: of each key the row of the last commit; rows of one commit that share a key leave the largest."""
    rest = [c for c in rows.columns if c not in key and c != "_seq"]
    best = F.max(F.struct("_seq", *rest)).alias("_best")
    return rows.groupBy(*key).agg(best).select(*key, *[F.col(f"_best.{c}").alias(c) for c in rest], F.col("_best._seq").alias("_seq"))


def compact(spark: SparkSession, root: str, name: str, schema: str, key: list[str]) -> None:
    """One commit in place of those that count now, with the last row of each key at its old number. Commits made meanwhile stay beside it.

    Two compactions at once leave two equal snapshots, which merging on read makes one.
    """
    parts = [r["part"] for r in commits(spark, root, name).select("part").collect()]
    if len(parts) < 2:
        return
    kept = latest(read(spark, root, name, schema, parts), key)
    part, seq = f"{root}/data/{name}/{uuid.uuid4().hex}", time.time_ns()
    kept.write.parquet(part)
    spark.createDataFrame([(name, part, seq, parts, {})], _LOG).coalesce(1).write.parquet(f"{root}/log/{uuid.uuid4().hex}")


def sweep(spark: SparkSession, root: str) -> int:
    """Delete the data of replaced commits once no reader needs them; returns how many folders went."""
    if not exists(spark, f"{root}/log"):
        return 0
    log = spark.read.schema(_LOG).option("recursiveFileLookup", True).parquet(f"{root}/log")
    gone = [r["part"] for r in log.select(F.explode("replaces").alias("part")).distinct().collect() if exists(spark, r["part"])]
    for part in gone:
        remove(spark, part)
    return len(gone)
