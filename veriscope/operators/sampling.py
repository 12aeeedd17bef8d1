"""A balanced audit sample: quotas by mode, then the highest priorities."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

SHARES = (("fidelity_specific_claim", 0.3), ("fidelity_background_framing", 0.2), ("fidelity_bundled_use", 0.15), ("fidelity_methods_use", 0.2), ("review_transmission", 0.15))
AMBIGUOUS = "manual_review_role_ambiguous"


def targets(total: int, ambiguous: bool) -> list[tuple[str, int]]:
    """Quota of each mode in order: rounded shares, the remainder to the last; one for the ambiguous ones, taken from the largest."""
    out = [(mode, int(share * total + 0.5)) for mode, share in SHARES[:-1]]
    out.append((SHARES[-1][0], total - sum(n for _, n in out)))
    if ambiguous and total > 0:
        most = max(range(len(out)), key=lambda k: (out[k][1], -k))
        if out[most][1] > 0:
            out[most] = (out[most][0], out[most][1] - 1)
        out.append((AMBIGUOUS, 1))
    return out


def priority() -> tuple[Column, Column]:
    """(priority, tags) of a task."""
    rules = (
        (F.col("bundled") & (F.col("role") == "background_context"), 3, "bundled_background"),
        (F.col("review") & (F.col("role") == "substantive_attribution"), 3, "review_mediated_substantive"),
        ((F.col("status") == "retrieved") & (F.col("relevance") < 10), 2, "ambiguous_retrieval_fit"),
        ((F.col("mode") == AMBIGUOUS) & (F.col("confidence") == "high"), 2, "high_confidence_unclear"),
        (F.col("bundled"), 1, "bundled"),
    )
    total = sum((F.when(test, n).otherwise(0) for test, n, _ in rules), F.lit(0))
    return total, F.array_compact(F.array(*[F.when(test, F.lit(tag)) for test, _, tag in rules]))


def stratified_sample(tasks: DataFrame, by: str, total: int = 20) -> DataFrame:
    """(by, task_id, mode, priority, pass): for each group of ``by`` at most ``total`` tasks.

    Pass 1 fills the modes' quotas by priority, pass 2 the rest by priority alone; ambiguous ones take
    at most a quarter. Both take the first tasks of a mode by priority, so never one beyond the first ``total`` of its mode:
    the others go before anything is shuffled, and the windows over a group hold a bounded number of rows.
    """
    score, tags = priority()
    best = Window.partitionBy(by, "mode").orderBy(F.desc("priority"), "task_id")
    t = tasks.where("status <> 'not_attempted'").withColumn("priority", score).withColumn("tags", tags)
    t = t.withColumn("_best", F.row_number().over(best)).where(F.col("_best") <= total)
    group = Window.partitionBy(by)
    t = t.withColumn("some_ambiguous", F.bool_or(F.col("mode") == AMBIGUOUS).over(group))

    def quota(ambiguous: bool) -> Column:
        out = F.lit(0)
        for mode, n in targets(total, ambiguous):
            out = F.when(F.col("mode") == mode, n).otherwise(out)
        return out

    most = total // 4
    t = t.withColumn("quota", F.when(F.col("some_ambiguous"), quota(True)).otherwise(quota(False)))
    t = t.withColumn("first", F.col("_best") <= F.when(F.col("mode") == AMBIGUOUS, F.least(F.col("quota"), F.lit(most))).otherwise(F.col("quota")))
    taken = F.count_if(F.col("first")).over(group)
    taken_ambiguous = F.count_if(F.col("first") & (F.col("mode") == AMBIGUOUS)).over(group)
    t = t.withColumn("left", F.lit(total) - taken).withColumn("left_ambiguous", F.lit(most) - taken_ambiguous)
    rest = Window.partitionBy(by, "first", F.col("mode") == AMBIGUOUS).orderBy(F.desc("priority"), "task_id")
    t = t.withColumn("allowed", ~F.col("first") & ((F.col("mode") != AMBIGUOUS) | (F.row_number().over(rest) <= F.col("left_ambiguous"))))
    fill = F.row_number().over(Window.partitionBy(by, "allowed").orderBy(F.desc("priority"), "task_id"))
    t = t.withColumn("second", F.col("allowed") & (fill <= F.col("left")))
    return t.where("first or second").select(by, "task_id", "mode", "priority", F.array_join("tags", ",").alias("tags"), F.when(F.col("first"), 1).otherwise(2).alias("pass"))
