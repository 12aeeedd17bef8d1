"""Adjudicated datasets against each other: blind export, diff, summary, ranking, deltas, agreement."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: What an adjudicator, or a model in its place, adds to a record.
JUDGED = ("verdict", "rationale", "quality", "confidence", "adjudicator", "adjudicated_at", "telemetry", "vector_trace", "routing")
#: What comes from vectors, and no longer holds once a verdict is replaced.
FROM_VECTORS = ("vector_trace", "routing")


def adjacent(a: Column, b: Column) -> Column:
    """Equal verdicts, or supported and partially supported."""
    close = ("supported", "partially_supported")
    return (a == b) | (a.isin(*close) & b.isin(*close))


def blind(records: DataFrame) -> DataFrame:
    """Records without what an adjudicator said; excluded ones keep it."""
    return records.select(*[F.when(F.col("excluded"), F.col(c)).alias(c) if c in JUDGED else F.col(c) for c in records.columns])


def diff(base: DataFrame, candidate: DataFrame) -> DataFrame:
    """One row for each task of either side: what changed. Where either side is excluded, only the exclusion counts."""
    b, c = base.select(*[F.col(x).alias(f"b_{x}") for x in base.columns]), candidate.select(*[F.col(x).alias(f"c_{x}") for x in candidate.columns])
    j = b.join(c, F.col("b_task_id") == F.col("c_task_id"), "full_outer")
    ignored = F.coalesce("b_excluded", F.lit(False)) | F.coalesce("c_excluded", F.lit(False))
    changed = lambda x: ~ignored & ~F.col(f"b_{x}").eqNullSafe(F.col(f"c_{x}"))
    return j.select(
        F.coalesce("b_task_id", "c_task_id").alias("task_id"), F.coalesce("b_ord", "c_ord").alias("ord"), F.col("b_verdict").alias("base_verdict"), F.col("c_verdict").alias("candidate_verdict"),
        changed("verdict").alias("verdict_changed"), changed("rationale").alias("rationale_changed"), changed("quality").alias("quality_changed"),
        (~F.col("b_excluded").eqNullSafe(F.col("c_excluded")) | ~F.col("b_exclude_reason").eqNullSafe(F.col("c_exclude_reason"))).alias("exclusion_changed"),
        F.col("b_task_id").isNull().alias("missing_in_base"), F.col("c_task_id").isNull().alias("missing_in_candidate"),
    )


def summarize(base: DataFrame, candidates: DataFrame) -> DataFrame:
    """Agreement of each candidate (label, task_id, verdict) with the active records of ``base``; a missing verdict counts as a change."""
    active = base.where("not excluded and verdict is not null").select("task_id", F.col("verdict").alias("base_verdict"))
    size = active.agg(F.count("*").alias("active"))  # one row
    j = candidates.select("label", "task_id", "verdict").join(active, "task_id", "left")
    met = F.col("base_verdict").isNotNull()
    same = met & F.coalesce(F.col("verdict") == F.col("base_verdict"), F.lit(False))
    near = met & F.coalesce(adjacent(F.col("verdict"), F.col("base_verdict")), F.lit(False))
    own = j.groupBy("label").agg(F.count_if(same).alias("exact"), F.count_if(near).alias("adjacent"), F.count_if(met).alias("_known"))
    out = own.crossJoin(F.broadcast(size)).where("active > 0").select("label", "active", "exact", "adjacent", (F.col("active") - F.col("exact")).alias("changes"), (F.col("active") - F.col("_known")).alias("missing"))
    return out.withColumn("exact_rate", F.col("exact") / F.col("active")).withColumn("adjacent_rate", F.col("adjacent") / F.col("active"))


def apply_deltas(base: DataFrame, deltas: DataFrame) -> DataFrame:
    """``base`` with the final verdicts of ``deltas`` (task_id, final_verdict, rationale, quality, excluded, exclude_reason, allow_excluded, confidence where it is).

    Stops on a task with two deltas, on an unknown task, and on a delta that does not allow it but is for an excluded record or says anything of
    exclusion. Null fields of a delta leave the record's own; what came from vectors (``FROM_VECTORS``) goes from every record that a delta touches.
    """
    twice = deltas.groupBy("task_id").agg(F.count("*").alias("n")).where("n > 1")
    unknown = deltas.join(base, "task_id", "left_anti")
    strict = deltas.where("not coalesce(allow_excluded, false)")
    protected = strict.join(base.where("excluded").select("task_id"), "task_id", "left_semi")
    excluding = strict.where("excluded is not null or exclude_reason is not null")
    for name, bad in (("duplicate delta", twice), ("unknown task", unknown), ("excluded record", protected), ("exclusion not allowed", excluding)):
        if row := bad.select("task_id").head(1):
            raise ValueError(f"{name}: {row[0]['task_id']}")
    fields = [c for c in ("final_verdict", "rationale", "quality", "confidence", "excluded", "exclude_reason") if c in deltas.columns]
    d = deltas.select("task_id", *[F.col(c).alias(f"d_{c}") for c in fields], F.lit(True).alias("d_hit"))
    new = {"verdict" if c == "final_verdict" else c: f"d_{c}" for c in fields}

    def value(c: str) -> Column:
        if c in FROM_VECTORS:
            return F.when(F.col("d_hit").isNull(), F.col(c)).alias(c)
        return F.coalesce(F.col(new[c]), F.col(c)).alias(c) if c in new else F.col(c)

    return base.join(d, "task_id", "left").select(*[value(c) for c in base.columns], F.coalesce("d_hit", F.lit(False)).alias("touched"))


def agreement(human: DataFrame, machine: DataFrame) -> DataFrame:
    """Exact and adjacent agreement by mode, with a total row (mode ``all``)."""
    h = human.where("not excluded and verdict is not null").select("task_id", "mode", F.col("verdict").alias("h"))
    j = h.join(machine.where("verdict is not null").select("task_id", F.col("verdict").alias("m")), "task_id")
    out = j.rollup("mode").agg(F.count("*").alias("n"), F.count_if(F.col("h") == F.col("m")).alias("exact"), F.count_if(adjacent(F.col("h"), F.col("m"))).alias("adjacent"))
    return out.withColumn("mode", F.coalesce("mode", F.lit("all"))).withColumn("exact_rate", F.col("exact") / F.col("n"))
