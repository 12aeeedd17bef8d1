"""Decisions that depend on earlier ones, settled over whole tables by rounds of joins."""

from __future__ import annotations

import tempfile
import uuid
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

_CONF = "spark.checkpoint.dir"


def _folder(spark) -> str:
    """The folder that ``spark.checkpoint.dir`` names; where it is unset, a temporary one of a local master."""
    folder = spark.conf.get(_CONF, None)
    if not folder:
        master = spark.sparkContext.master
        if not master.startswith("local") or master.startswith("local-cluster"):
            raise ValueError(f"{_CONF} names no folder that driver and executors share")
        folder = "file://" + tempfile.mkdtemp(prefix="veriscope-rounds-")
        spark.conf.set(_CONF, folder)
    return folder.rstrip("/")


def cut(df: DataFrame) -> DataFrame:
    """``df`` written once as a Parquet table in the shared folder, and a scan of it.

    Unlike a checkpoint, which hands the statistics and constraints of all it came from to every later plan, a scan
    knows nothing of its past, so that plans do not grow from round to round.
    """
    path = f"{_folder(df.sparkSession)}/rounds-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def dealt(df: DataFrame, *keys: str, rows: int = 500_000, n: int | None = None) -> DataFrame:
    """``df``, of ``n`` rows if that is known, dealt by ``keys``, about ``rows`` rows to a task and no fewer tasks than shuffles have, for groups so small that counting before the shuffle would only hold each task's whole input in memory."""
    parts = max(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-(df.count() if n is None else n) // rows))
    return df.repartition(parts, *keys)


def gathered(parts: list[DataFrame], most: int = 8) -> list[DataFrame]:
    """The same rows in fewer tables: more than ``most`` tables become one, so that a plan over all of them stays small."""
    return parts if len(parts) <= most else [cut(reduce(DataFrame.unionByName, parts))]


def attached(pairs: DataFrame) -> DataFrame:
    """(id) of the rows that join an earlier head, from pairs (a, b) with a before b in an order without ties.

    In that order a row becomes a head unless it pairs with an earlier head. Each round takes the rows without an
    undecided earlier partner as heads and all their later partners as attached; what is then left is undecided.
    """
    left = cut(pairs.select("a", "b").distinct())
    parts = [left.select(F.col("b").alias("id")).limit(0)]
    while not left.isEmpty():
        heads = left.join(left.select(F.col("b").alias("x")).distinct(), F.col("a") == F.col("x"), "left_anti")
        now = cut(heads.select(F.col("b").alias("id")).distinct())
        left = cut(left.join(now, F.col("a") == F.col("id"), "left_anti").join(now, F.col("b") == F.col("id"), "left_anti"))
        parts = gathered([*parts, now])
    return reduce(DataFrame.unionByName, parts)


def roots(parents: DataFrame) -> DataFrame:
    """(id, root) of (id, parent): the last row reached by following parents, where a row that is no id is a root. Halves the way in each round."""
    now = cut(parents.select("id", F.col("parent").alias("root")))
    while True:
        further = now.join(now.select(F.col("id").alias("via"), F.col("root").alias("next")), F.col("root") == F.col("via"), "left")
        more = cut(further.select("id", F.coalesce("next", "root").alias("root"), F.col("next").isNotNull().alias("moved")))
        now = more.drop("moved")
        if more.where("moved").isEmpty():
            return now
