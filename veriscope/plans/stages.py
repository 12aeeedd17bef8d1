"""The analysis stages as compositions of operators, DataFrame to DataFrame.

Each takes the relations of the stage before and returns its own; nothing runs until a sink asks.
Externally computed columns (claims, grounding, rerank scores, judgments) enter as frames to join.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import rules
from ..operators import classify, graph, retrieval, sampling, vectors


@dataclass
class Config:
    """Settings of a run."""

    probe_budget: int = 100
    least_auditable: int = 3
    auditable_share: float = 0.3
    relevance_share: float = 0.22
    evidence_candidates: int = 20
    evidence_spans: int = 5
    audit_size: int = 20


def discover(citing: DataFrame, config: Config) -> tuple[DataFrame, DataFrame]:
    """(neighbourhood counts, probe selection) of the citing papers (seed, citing, availability, year)."""
    return graph.neighborhood(citing), graph.probe_selection(citing, config.probe_budget)


def screen(edges: DataFrame, config: Config, blocked: DataFrame | None = None) -> DataFrame:
    """Screened families from unique edges; ``blocked`` (seed) lists seeds whose claim is not grounded."""
    metrics = graph.screen_metrics(edges)
    out = graph.screen(metrics)
    if blocked is not None:
        stop = blocked.select("seed").distinct().withColumn("blocked", F.lit(True))
        out = out.join(stop, "seed", "left")
        halted = F.coalesce("blocked", F.lit(False))
        out = out.withColumn("decision", F.when(halted, "deprioritize").otherwise(F.col("decision"))).withColumn("rule", F.when(halted, "claim_not_grounded").otherwise(F.col("rule"))).drop("blocked")
    return graph.assign_priorities(out)


def extract(mentions: DataFrame, screened: DataFrame, in_family: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """(mentions, edges) of greenlit seeds: annotated, deduplicated, usable or not; an edge known to be outside its claim family goes."""
    live = screened.where("decision = 'greenlight'").select(F.col("seed").alias("cited"))
    kept = mentions.join(live, "cited", "left_semi")
    if in_family is not None:
        kept = kept.join(in_family.where("not in_family").select("citing", "cited"), ["citing", "cited"], "left_anti")
    annotated = classify.annotate(classify.dedup_mentions(kept))
    return annotated, classify.edge_usability(annotated)


def classify_stage(annotated: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(tasks, packets) of the annotated mentions."""
    roled = classify.with_roles(annotated)
    return classify.build_tasks(roled), classify.packets(roled)


def evidence(tasks: DataFrame, blocks: DataFrame, config: Config, scores: DataFrame | None = None) -> DataFrame:
    """Spans for each task (task_id, cited, query) from the blocks (cited, block_id, text) of its cited paper.

    BM25's statistics are those of one cited paper, so the ranking is grouped by it. Rerank scores
    (task_id, block_id, score), where given, reorder the candidates.
    """
    first = retrieval.bm25(tasks, blocks, "task_id", "block_id", config.evidence_candidates, "query", "text", within="cited").select("task_id", "block_id", F.col("score").alias("bm25"))
    if scores is None:
        scores = first.select("task_id", "block_id", F.col("bm25").alias("score"))
    return retrieval.rerank(first, scores, "task_id", "block_id", config.evidence_spans)


def curate(tasks: DataFrame, config: Config, by: str = "seed") -> DataFrame:
    """The audit sample of tasks with status, mode, role, bundled, review, relevance and confidence."""
    return sampling.stratified_sample(tasks, by, config.audit_size)


def judge(samples: DataFrame) -> DataFrame:
    """Verdicts from judgment vectors, with why a record needs more samples or a categorical judge."""
    a = vectors.axis_verdict(vectors.aggregate_samples(samples))
    return a.withColumns({"adaptive": vectors.adaptive_reasons(), "escalation": vectors.escalation_reasons(), "retrieval_quality": vectors.retrieval_quality(), "confidence": vectors.judge_confidence()})


def merge_judged(vector_first: DataFrame, categorical: DataFrame, key: str = "record_id") -> DataFrame:
    """Final verdicts: the categorical one where a record was escalated and judged, else the axes' own."""
    c = categorical.select(key, F.col("verdict").alias("c_verdict"))
    j = vector_first.join(c, key, "left")
    used = (F.size("escalation") > 0) & F.col("c_verdict").isNotNull()
    return j.select(key, F.when(used, F.col("c_verdict")).otherwise(F.col("axis_verdict")).alias("verdict"), F.when(used, "categorical").otherwise("axis").alias("source"))


def auditable(edges: DataFrame) -> DataFrame:
    """Edges (availability, hint) with their auditability status."""
    return edges.withColumn("status", rules.auditability(F.col("availability"), F.col("hint")))
