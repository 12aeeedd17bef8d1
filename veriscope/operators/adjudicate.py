"""Around adjudication: questions, second looks, telemetry, refreshed records, tags."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

_ALL = "supported,partially_supported,overstated_or_generalized,not_supported,cannot_determine"
_PLAIN = "supported,partially_supported,not_supported,cannot_determine"
#: mode, question, verdicts that answer it. Modes and verdicts are fixed values.
RUBRICS = (
    ("fidelity_specific_claim", "Does the cited paper's evidence bear out what this citation says it found?", _ALL),
    ("fidelity_background_framing", "Is the cited paper's subject and scope given without distortion?", _ALL),
    ("fidelity_bundled_use", "Does the paper belong among those cited here, and does it bear out what they are cited for?", _PLAIN),
    ("fidelity_methods_use", "Does the method or material come from the cited paper?", _PLAIN),
    ("review_transmission", "Does the review pass on the cited paper's finding unchanged?", _ALL),
    ("skip_low_information", "Nothing is asked.", "skipped"),
    ("manual_review_role_ambiguous", "What does the citation do here, and does the cited paper bear it out?", _ALL),
    ("manual_review_extraction_limited", "Too little was extracted: read the text.", "needs_manual_inspection"),
)


def with_rubric(tasks: DataFrame) -> DataFrame:
    """Tasks with the question of their mode and the verdicts that answer it (array)."""
    dim = tasks.sparkSession.createDataFrame(RUBRICS, "mode string, question string, _options string")
    return tasks.join(F.broadcast(dim), "mode", "left").withColumn("options", F.split("_options", ",")).drop("_options")


def needs_advisor(records: DataFrame) -> DataFrame:
    """Active records whose first verdict needs a second look: low confidence, no verdict possible, or bundled with medium confidence."""
    unsure = (F.col("confidence") == "low") | (F.col("verdict") == "cannot_determine") | (F.col("bundled") & (F.col("confidence") == "medium"))
    return records.where(~F.col("excluded") & F.coalesce(unsure, F.lit(False)))


def run_telemetry(calls: DataFrame, by: str) -> DataFrame:
    """Calls, tokens and latency for each of ``by``; tokens and latency are those of successful calls, their mean latency is rounded half up."""
    won = F.col("successful")
    total = lambda c: F.coalesce(F.sum(F.when(won, F.coalesce(F.col(c), F.lit(0)))), F.lit(0)).alias(f"total_{c}")
    sums = [total(c) for c in ("input_tokens", "output_tokens", "reasoning_tokens", "latency_ms")]
    out = calls.groupBy(by).agg(F.count("*").alias("calls"), F.count_if(won).alias("successful"), F.count_if(~won).alias("failed"), *sums)
    return out.withColumn("mean_latency_ms", F.when(F.col("successful") > 0, F.floor(F.col("total_latency_ms") / F.col("successful") + 0.5)).otherwise(F.lit(0).cast("long")))


def refresh(records: DataFrame, evidence: DataFrame, columns: tuple[str, ...]) -> DataFrame:
    """Records with newer values of ``columns`` from ``evidence`` (task_id, ...), where it has the task."""
    new = evidence.select("task_id", *[F.col(c).alias(f"_new_{c}") for c in columns])
    return records.join(new, "task_id", "left").select(*[F.coalesce(F.col(f"_new_{c}"), F.col(c)).alias(c) if c in columns else F.col(c) for c in records.columns])


def excluded_last(records: DataFrame) -> DataFrame:
    """Adjudicated records in their order, then the excluded ones."""
    return records.orderBy(F.col("excluded"), "ord", "task_id")


def edge_tags(flags: dict[str, Column]) -> Column:
    """The names of the flags that hold, joined by commas; ``untagged`` if none does."""
    some = F.array_compact(F.array(*[F.when(flag, F.lit(name)) for name, flag in flags.items()]))
    return F.when(F.size(some) > 0, F.array_join(some, ",")).otherwise("untagged")


def diff_order(diffs: DataFrame) -> DataFrame:
    """Differences in order of their records: those of the base first, then those that only the candidate has."""
    return diffs.orderBy(F.col("missing_in_base"), "ord", "task_id")
