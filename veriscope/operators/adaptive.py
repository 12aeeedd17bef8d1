"""Sampling in rounds with a stopping rule: each round draws only for records that are not yet decided."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import vectors
from .rounds import cut

# Fixed value: why a record without an answer goes to a categorical judge.
NO_VECTOR = "vector_trace_failed"

Draw = Callable[[DataFrame], DataFrame]


def replayed(samples: DataFrame) -> Draw:
    """Draws from a table of answers with (record_id, sample): the wanted (record_id, first, many) numbers, those that it has."""

    def draw(wanted: DataFrame) -> DataFrame:
        inside = (F.col("sample") >= F.col("first")) & (F.col("sample") < F.col("first") + F.col("many"))
        return samples.join(wanted, "record_id").where(inside).drop("first", "many")

    return draw


def adaptive_samples(records: DataFrame, draw: Draw, initial: int = 3, most: int = 8, step: int | None = None) -> tuple[DataFrame, DataFrame]:
    """(samples, rounds): samples drawn for each of ``records`` (record_id), and per record how and why drawing went on.

    The first round draws ``initial`` samples. A record is decided when its aggregate gives no reason for more, when it
    has ``most``, or when a draw gives nothing; the others draw ``step`` more (None: all that are left), from number to
    number, so draws are the same in any partitioning. rounds: (record_id, n, rounds, first_reasons, reasons, state),
    state ``decided``, ``exhausted`` or ``failed``. Only open records are aggregated again: each round reads what they drew.
    """
    if not 1 <= initial <= most:
        raise ValueError("initial must be at least 1 and at most the greatest number of samples")
    wanted = records.select("record_id").distinct().withColumn("first", F.lit(0)).withColumn("many", F.lit(initial))
    drawn = cut(draw(wanted))
    done_samples, done_rounds = [], []
    state = cut(records.select("record_id").distinct().withColumn("rounds", F.lit(1)).withColumn("asked", F.lit(initial)).withColumn("before", F.lit(0).cast("bigint")).withColumn("first_reasons", F.lit(None).cast("array<string>")))
    while True:
        judged = vectors.axis_verdict(vectors.aggregate_samples(drawn)).select("record_id", "n", vectors.adaptive_reasons().alias("reasons"))
        j = state.join(judged, "record_id", "left").withColumn("first_reasons", F.coalesce("first_reasons", "reasons"))
        n = F.coalesce("n", F.lit(0))
        dry = n == F.col("before")
        end = F.when(n == 0, "failed").when(F.size("reasons") == 0, "decided").when(dry | (F.col("asked") >= most), "exhausted")
        j = cut(j.withColumn("state", end))
        over = j.where("state is not null")
        done_rounds.append(over.select("record_id", F.coalesce("n", F.lit(0)).alias("n"), "rounds", F.coalesce("first_reasons", F.array()).alias("first_reasons"), F.coalesce("reasons", F.array()).alias("reasons"), "state"))
        done_samples.append(drawn.join(over.select("record_id"), "record_id", "left_semi"))
        open_ = j.where("state is null")
        if open_.isEmpty():
            break
        many = F.lit(most) - F.col("asked") if step is None else F.least(F.lit(step), F.lit(most) - F.col("asked"))
        next_ = open_.withColumn("many", many)
        new = draw(next_.select("record_id", F.col("asked").alias("first"), "many"))
        state = cut(next_.select("record_id", (F.col("rounds") + 1).alias("rounds"), (F.col("asked") + F.col("many")).alias("asked"), F.col("n").alias("before"), "first_reasons"))
        drawn = cut(drawn.join(open_.select("record_id"), "record_id", "left_semi").unionByName(new))
    samples, rounds = done_samples[0], done_rounds[0]
    for a, b in zip(done_samples[1:], done_rounds[1:], strict=True):
        samples, rounds = samples.unionByName(a), rounds.unionByName(b)
    return samples, rounds


def vector_first(records: DataFrame, draw: Draw, judge: Callable[[DataFrame], DataFrame], initial: int = 3, most: int = 8, step: int | None = None) -> DataFrame:
    """(record_id, verdict, source, n, rounds, adaptive, escalation, error): verdicts from vectors, a categorical judge for what they leave open.

    judge takes (record_id) and returns (record_id, verdict, error) for escalated records only. A record that the judge
    fails on keeps its axis verdict and the error; one without any vector and without a judgment cannot be determined.
    """
    samples, rounds = adaptive_samples(records, draw, initial, most, step)
    a = vectors.axis_verdict(vectors.aggregate_samples(samples)).select("record_id", "axis_verdict", vectors.escalation_reasons().alias("escalation"))
    j = cut(rounds.join(a, "record_id", "left").withColumn("escalation", F.coalesce("escalation", F.array(F.lit(NO_VECTOR)))))
    told = judge(j.where(F.size("escalation") > 0).select("record_id")).select("record_id", F.col("verdict").alias("_verdict"), F.col("error").alias("_error"))
    out = j.join(told, "record_id", "left")
    asked = F.size("escalation") > 0
    used = asked & F.col("_verdict").isNotNull()
    verdict = F.when(used, F.col("_verdict")).otherwise(F.coalesce("axis_verdict", F.lit("cannot_determine")))
    source = F.when(used, "categorical").when(F.col("axis_verdict").isNotNull(), "axis").otherwise("none")
    error = F.when(asked & ~used, F.coalesce("_error", F.lit("the judge gave no answer")))
    return out.select("record_id", verdict.alias("verdict"), source.alias("source"), "n", "rounds", F.col("first_reasons").alias("adaptive"), "escalation", error.alias("error"))
