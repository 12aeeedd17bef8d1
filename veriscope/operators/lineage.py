"""Artifacts and what they were made of: which no longer hold since something before them has changed."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .rounds import cut, gathered


def stale_artifacts(manifests: DataFrame, current: DataFrame) -> DataFrame:
    """(artifact, state, depth, cause) for each artifact of ``manifests`` (artifact, source, sha256 of the source as it was read).

    An artifact is stale if a source is missing from ``current`` (artifact, sha256), has another checksum there, or is
    stale itself. depth counts steps from the nearest such source, cause names it (the least of equally near ones);
    both are null for artifacts that hold. One round for each step; a round joins only what it newly found, and an artifact
    is found once, so cycles end.
    """
    made = cut(manifests.select("artifact", "source", "sha256").distinct())
    now = current.select(F.col("artifact").alias("source"), F.col("sha256").alias("_now"))
    broken = made.join(now, "source", "left").where(F.col("_now").isNull() | (F.col("_now") != F.col("sha256")))
    found = cut(broken.groupBy("artifact").agg(F.lit(1).alias("depth"), F.min("source").alias("cause")))
    parts, edges, depth = [found], made.select("artifact", "source").distinct(), 1
    while not found.isEmpty():
        depth += 1
        next_ = edges.join(found.select(F.col("artifact").alias("source"), "cause"), "source").groupBy("artifact").agg(F.lit(depth).alias("depth"), F.min("cause").alias("cause"))
        known = reduce(DataFrame.unionByName, parts).select("artifact")
        found = cut(next_.join(known, "artifact", "left_anti"))
        parts = gathered([*parts, found])
    stale = reduce(DataFrame.unionByName, parts)
    j = made.select("artifact").distinct().join(stale, "artifact", "left")
    return j.select("artifact", F.when(F.col("depth").isNull(), "holds").otherwise("stale").alias("state"), "depth", "cause")
