"""From mentions to roles, tasks and packets."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.rules import citation_role, context_type, evaluation_mode, marker_style, mention_confidence, role_signals
from ..functions.text import ascii_lower, local_window

EDGE = ("citing", "cited")


def annotate(mentions: DataFrame) -> DataFrame:
    """Mentions with style, kind, length and confidence."""
    # a column, so that it is made once; the rules look at no longer context
    m = mentions.withColumn("_low", F.when(F.length("context") < 600, F.lower("context")))
    m = m.withColumns({"style": marker_style(F.col("marker")), "kind": context_type(F.col("context"), F.coalesce("section", F.lit("")), F.col("_low")), "length": F.length("context")}).drop("_low")
    return m.withColumn("confidence", mention_confidence(F.col("style"), F.col("kind"), F.col("length")))


def dedup_mentions(mentions: DataFrame) -> DataFrame:
    """The first of the mentions that agree in reference, first 200 characters and offset (unknown ones agree), numbered anew from 0."""
    # in order of what is cheap to compare
    key = [F.coalesce("ref_id", F.lit("no-ref")), F.coalesce(F.col("at").cast("string"), F.lit("no-offset")), F.substring("context", 1, 200)]
    first = Window.partitionBy(*EDGE, *key).orderBy("ord")
    # dealt by edge once, which serves both windows, so that the contexts move once
    kept = mentions.repartition(*EDGE).withColumn("n", F.row_number().over(first)).where("n = 1").drop("n")
    return kept.withColumn("mention_index", F.row_number().over(Window.partitionBy(*EDGE).orderBy("ord")) - 1)


def edge_usability(annotated: DataFrame) -> DataFrame:
    """Whether an edge's mentions can ground a claim: true, false or unknown."""
    good = (F.col("kind") == "narrative_like") & (F.col("confidence") != "low")
    usable = F.when(F.bool_or(good), "true").when(F.bool_and(F.col("kind") == "bibliography_like"), "false").otherwise("unknown")
    return annotated.groupBy(*EDGE).agg(usable.alias("usable"), F.count("*").alias("n_mentions"), F.count_if(good).alias("n_usable"))


def with_roles(annotated: DataFrame) -> DataFrame:
    """Annotated mentions with the counts of their cues, role and evaluation mode."""
    near = annotated.withColumn("_near", ascii_lower(local_window(F.col("context"), F.col("marker"))))  # a column, so that it is cut once
    m = near.withColumns(role_signals(F.col("_near"), F.coalesce("section", F.lit("")))).drop("_near")
    m = m.withColumn("role", citation_role({k: F.col(k) for k in ("methods_section", "background_section", "methods_phrases", "attribution_verbs", "background_phrases")}, F.col("length"), F.col("confidence")))
    return m.withColumn("mode", evaluation_mode(F.col("role"), F.col("bundled"), F.col("review"), F.col("confidence")))


def build_tasks(classified: DataFrame) -> DataFrame:
    """One task for each edge and role, in order of its first mention."""
    best = F.min_by("confidence", F.struct(F.when(F.col("confidence") == "high", 0).when(F.col("confidence") == "medium", 1).otherwise(2), F.col("ord")))
    t = classified.groupBy(*EDGE, "role").agg(
        F.min("ord").alias("first"), F.count("*").alias("n_mentions"), F.bool_or("bundled").alias("bundled"), F.bool_or("review").alias("review"),
        F.max(F.when(F.col("bundle_size") > 1, F.col("bundle_size"))).alias("bundle_size"), best.alias("best_confidence"),
    )
    return t.withColumn("mode", evaluation_mode(F.col("role"), F.col("bundled"), F.col("review"), F.col("best_confidence")))


def packets(classified: DataFrame) -> DataFrame:
    """One row for each edge: roles, usable and bundled mentions, and whether someone has to look."""
    return classified.groupBy(*EDGE).agg(
        F.count("*").alias("n_mentions"), F.array_join(F.array_sort(F.collect_set("role")), ",").alias("roles"), F.count_if((F.col("confidence") != "low") | (F.col("kind") == "narrative_like")).alias("n_usable"),
        F.count_if("bundled").alias("n_bundled"), F.bool_or(F.startswith("mode", F.lit("manual_review"))).alias("manual_review"), F.when(F.count("*") >= 3, "high").otherwise("medium").alias("edge_confidence"),
    )


def dense_counts(df: DataFrame, column: str, values: tuple[str, ...]) -> DataFrame:
    """(column, n) for every one of ``values``, 0 included."""
    dim = df.sparkSession.createDataFrame([(v,) for v in values], f"{column} string")
    return dim.join(df.groupBy(column).agg(F.count("*").alias("n")), column, "left").select(column, F.coalesce("n", F.lit(0)).alias("n"))


def extraction_summary(edges: DataFrame) -> DataFrame:
    """One row from edges (outcome, success, usable, n_raw, n_deduped, n_usable)."""
    usable = F.col("usable") == "true"
    return edges.agg(
        F.count("*").alias("total_edges"), F.count_if(F.col("outcome") != "skipped_not_auditable").alias("attempted"), F.count_if("success").alias("successful"), F.count_if(F.col("success") & usable).alias("successful_usable"),
        F.sum("n_raw").alias("raw_mentions"), F.sum("n_deduped").alias("deduped_mentions"), F.sum(F.when(usable, F.col("n_usable")).otherwise(0)).alias("usable_mentions"),
    )
