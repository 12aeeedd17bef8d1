"""Families computed only where their rows have changed: results are kept under a fingerprint of each family's content."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources import commits
from .rounds import cut


def fingerprints(rows: DataFrame, key: str) -> DataFrame:
    """(key, fingerprint) of each group's rows without the key: their number and two sums over hashes, whatever their order.

    Equal groups have equal fingerprints; a null is told from an absent value. The sums are partial before the shuffle.
    """
    rest = [c for c in rows.columns if c != key]
    parts = [x for c in sorted(rest) for x in (F.col(f"`{c}`"), F.col(f"`{c}`").isNull())]
    one, two = F.xxhash64(F.lit(1), *parts), F.xxhash64(F.lit(2), *parts)
    sums = rows.groupBy(key).agg(F.count("*").alias("n"), F.sum(one.cast("decimal(20,0)")).alias("a"), F.sum(two.cast("decimal(20,0)")).alias("b"))
    return sums.select(key, F.sha2(F.concat_ws(":", *[F.col(c).cast("string") for c in ("n", "a", "b")]), 256).alias("fingerprint"))


def recompute(spark: SparkSession, root: str, name: str, rows: DataFrame, key: str, compute: Callable[[DataFrame], DataFrame], schema: str, version: str) -> tuple[DataFrame, DataFrame]:
    """(results, marks): ``compute`` of the groups of ``rows`` that ``root`` has no result for, united with the results it has.

    compute takes rows of whole groups and returns ``key`` and the columns of ``schema``, for each group independently of
    the others. Groups of equal content share a result, which is computed for the one of the least key. ``version`` names
    the code and settings; another one finds nothing. marks: (key, fingerprint, state), state ``reused``, ``computed``
    or ``shared`` (with a group computed now). A group whose result is no row is remembered too. A failure before the
    commit leaves ``root`` as it was.
    """
    held = f"{name}-{version}"
    marks = commits.latest(commits.read(spark, root, f"{held}-seen", "fingerprint string"), ["fingerprint"]).select("fingerprint")
    now = cut(fingerprints(rows, key))
    fresh = now.join(marks, "fingerprint", "left_anti").groupBy("fingerprint").agg(F.min(key).alias(key))
    part = commits.publish(fresh, root, f"{held}-fresh")
    fresh = spark.read.parquet(part).drop("_seq")
    if not fresh.isEmpty():
        live = rows.join(fresh.select(key), key, "left_semi")
        made = compute(live).join(fresh, key).drop(key)
        commits.publish(made, root, held)
        commits.publish(fresh.select("fingerprint"), root, f"{held}-seen")
    columns = [c.strip().split(" ")[0] for c in schema.split(",")]
    cached = commits.read(spark, root, held, f"fingerprint string, {schema}")
    # two runs at once may both compute a content: the later commit's rows count
    last = cached.groupBy("fingerprint").agg(F.max("_seq").alias("_seq"))
    results = now.join(cached.join(last, ["fingerprint", "_seq"]), "fingerprint").select(key, *columns)
    state = now.join(fresh.select("fingerprint", F.col(key).alias("_first")), "fingerprint", "left")
    state = state.select(key, "fingerprint", F.when(F.col("_first").isNull(), "reused").when(F.col("_first") == F.col(key), "computed").otherwise("shared").alias("state"))
    return results, state
