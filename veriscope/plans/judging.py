"""Queries on evidence, sampling and judgment vectors."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import retrieval, sampling, vectors
from ..sources import testdata as td


def _tasks(spark, sf):
    t = td.tasks(spark, sf)
    return t.withColumn("status", retrieval.evidence_status(F.col("mode"), F.col("resolved"), F.col("fetched"), F.col("matches"), F.col("abstract_only")))


def evidence_status(spark, sf):
    return _tasks(spark, sf).select("task_id", "status")


def evidence_summary(spark, sf):
    spans = F.when(F.col("status").isin("retrieved", "abstract_only_matches"), F.least(F.col("matches"), F.lit(5))).otherwise(0)
    return _tasks(spark, sf).groupBy("mode", "status").agg(F.count("*").alias("tasks"), F.sum(spans).alias("spans"))


def rerank_merge(spark, sf):
    li = td.read(spark, sf, "lineitem").groupBy(F.col("l_orderkey").alias("task"), F.col("l_partkey").alias("block")).agg(F.max("l_quantity").alias("bm25"))
    scores = li.where("(task + block) % 3 <> 0").select("task", "block", ((F.col("block") * 7 + F.col("task")) % 100).alias("score"))
    stray = li.select("task", (F.col("block") + 10**9).alias("block"), F.lit(99).cast("long").alias("score"))
    return retrieval.rerank(li, scores.unionByName(stray), "task", "block", 3).select("task", "block", F.coalesce("score", F.lit(-1)).alias("score"), "rank")


def sample_targets(spark, sf):
    rows = [(total, amb, k, mode, n) for total in (4, 7, 10, 20, 50) for amb in (False, True) for k, (mode, n) in enumerate(sampling.targets(total, amb))]
    return spark.createDataFrame(rows, "total int, ambiguous boolean, place int, mode string, n int")


def task_priority(spark, sf):
    score, tags = sampling.priority()
    return _tasks(spark, sf).select("task_id", score.alias("priority"), F.array_join(tags, ",").alias("tags"))


def stratified_sample(spark, sf):
    return sampling.stratified_sample(_tasks(spark, sf), "seed", 20)


def _aggregate(spark, sf):
    return vectors.axis_verdict(vectors.aggregate_samples(td.vector_samples(spark, sf)))


def vector_mean_var(spark, sf):
    a = _aggregate(spark, sf)
    return a.select("record_id", *[F.round(c, 6).alias(c) for x in vectors.AXES for c in (x, f"var_{x}")])


def vector_entropy_mode(spark, sf):
    return _aggregate(spark, sf).select("record_id", "modal_verdict", "scope_direction", "certainty_direction", F.round("entropy", 6).alias("entropy"), F.round("overall_uncertainty", 6).alias("overall_uncertainty"))


def axis_verdict(spark, sf):
    return _aggregate(spark, sf).select("record_id", "axis_rule", "axis_verdict")


def adaptive_routing(spark, sf):
    return _aggregate(spark, sf).select("record_id", F.array_join(vectors.adaptive_reasons(), ",").alias("reasons"), vectors.retrieval_quality().alias("quality"), vectors.judge_confidence().alias("confidence"))


def escalation_routing(spark, sf):
    return _aggregate(spark, sf).select("record_id", F.array_join(vectors.escalation_reasons(), ",").alias("reasons"))


def routing_histogram(spark, sf):
    r = _aggregate(spark, sf).select("axis_verdict", F.explode(vectors.escalation_reasons()).alias("reason"))
    return r.rollup("axis_verdict", "reason").agg(F.count("*").alias("n")).select(F.coalesce("axis_verdict", F.lit("all")).alias("axis_verdict"), F.coalesce("reason", F.lit("all")).alias("reason"), "n")


_STATUS = """CASE WHEN mode IN ('skip_low_information', 'manual_review_extraction_limited') THEN 'not_attempted' WHEN NOT resolved THEN 'unresolved_cited_paper' WHEN NOT fetched THEN 'no_fulltext'
  WHEN matches = 0 THEN 'no_matches' WHEN abstract_only THEN 'abstract_only_matches' ELSE 'retrieved' END"""
_SCORE = """(CASE WHEN bundled AND role = 'background_context' THEN 3 ELSE 0 END + CASE WHEN review AND role = 'substantive_attribution' THEN 3 ELSE 0 END + CASE WHEN status = 'retrieved' AND relevance < 10 THEN 2 ELSE 0 END
  + CASE WHEN mode = 'manual_review_role_ambiguous' AND confidence = 'high' THEN 2 ELSE 0 END + CASE WHEN bundled THEN 1 ELSE 0 END)"""
_TAGS = """concat_ws(',', CASE WHEN bundled AND role = 'background_context' THEN 'bundled_background' END, CASE WHEN review AND role = 'substantive_attribution' THEN 'review_mediated_substantive' END,
  CASE WHEN status = 'retrieved' AND relevance < 10 THEN 'ambiguous_retrieval_fit' END, CASE WHEN mode = 'manual_review_role_ambiguous' AND confidence = 'high' THEN 'high_confidence_unclear' END, CASE WHEN bundled THEN 'bundled' END)"""
_STATUSED = f"{td.TASKS}, statused AS (SELECT *, {_STATUS} AS status FROM tasks), scored AS (SELECT *, {_SCORE}::INT AS priority, {_TAGS} AS tags FROM statused)"
_AMB = "manual_review_role_ambiguous"


def _mode_sql(column: str, order: tuple[str, ...]) -> str:
    counts = ", ".join(f"{{'n': count(*) FILTER (WHERE {column} = '{v}'), 'k': {-k}, 'v': '{v}'}}" for k, v in enumerate(order))
    return f"list_max([{counts}]).v"


_ENTROPY = "least(1.0, greatest(0.0, (" + " + ".join(f"CASE WHEN n_{v} > 0 THEN -(n_{v} / n) * ln(n_{v} / n) ELSE 0 END" for v in vectors.VERDICTS) + ") / ln(5)))"
_AGG = (
    f"{td.VECTOR_SAMPLES}, a1 AS (SELECT record_id, count(*) AS n, "
    + ", ".join(f"coalesce(avg({a}), 0) AS {a}, coalesce(var_samp({a}), 0) AS var_{a}" for a in vectors.AXES)
    + ", "
    + ", ".join(f"count(*) FILTER (WHERE verdict = '{v}') AS n_{v}" for v in vectors.VERDICTS)
    + f", {_mode_sql('verdict', vectors.CAUTIOUS)} AS modal_verdict, {_mode_sql('scope_direction', vectors.SCOPE_ORDER)} AS scope_direction, {_mode_sql('certainty_direction', vectors.CERTAINTY_ORDER)} AS certainty_direction, bool_or(bundled) AS bundled FROM samples GROUP BY record_id),"
    + f" a2 AS (SELECT *, {_ENTROPY} AS entropy, ("
    + " + ".join(f"var_{a}" for a in vectors.AXES)
    + ") / 8 AS mean_variance FROM a1), a3 AS (SELECT *, least(1.0, greatest(0.0, 0.5 * uncertainty + 0.3 * entropy + 0.2 * mean_variance)) AS overall_uncertainty FROM a2),"
    + """ a4 AS (SELECT *, greatest(uncertainty, overall_uncertainty) AS unsure, scope_direction = 'expansion' AND scope_match < 0.7 AS wide, certainty_direction = 'escalation' AND certainty_match < 0.7 AS loud FROM a3),
  a5 AS (SELECT *, CASE WHEN evidence_grounding < 0.45 OR unsure >= 0.75 THEN 'cannot_determine_low_grounding_or_high_uncertainty' WHEN directional_alignment < 0.45 AND evidence_grounding >= 0.6 THEN 'not_supported_directional_mismatch'
    WHEN support < 0.4 OR (claim_identity < 0.45 AND evidence_grounding >= 0.6) THEN 'not_supported_low_support_or_identity'
    WHEN support >= 0.75 AND evidence_grounding >= 0.8 AND claim_identity >= 0.8 AND directional_alignment >= 0.8 AND scope_match >= 0.8 AND certainty_match >= 0.75 AND unsure < 0.45 AND NOT wide AND NOT loud THEN 'supported_all_core_axes_strong'
    WHEN support >= 0.65 AND evidence_grounding >= 0.6 AND (wide OR loud) THEN 'overstated_scope_or_certainty_warning' WHEN support >= 0.65 AND evidence_grounding >= 0.6 THEN 'partially_supported_weakened_noncritical_axis' ELSE 'cannot_determine_insufficient_support_or_grounding' END AS axis_rule FROM a4),
  agg AS (SELECT *, CASE WHEN axis_rule IN ('not_supported_directional_mismatch', 'not_supported_low_support_or_identity') THEN 'not_supported' WHEN axis_rule = 'supported_all_core_axes_strong' THEN 'supported' WHEN axis_rule = 'overstated_scope_or_certainty_warning' THEN 'overstated_or_generalized'
    WHEN axis_rule = 'partially_supported_weakened_noncritical_axis' THEN 'partially_supported' ELSE 'cannot_determine' END AS axis_verdict FROM a5)"""
)
_NEAR = " OR ".join(f"{a} BETWEEN 0.55 AND 0.75" for a in vectors.CORE)
_ESCALATION = """list_filter([CASE WHEN axis_verdict = 'cannot_determine' THEN 'axis_verdict_cannot_determine' END, CASE WHEN unsure >= 0.65 THEN 'aggregate_uncertainty_high' END, CASE WHEN entropy >= 0.5 THEN 'sample_disagreement_high' END,
  CASE WHEN mean_variance >= 0.04 THEN 'axis_variance_high' END, CASE WHEN evidence_grounding < 0.65 THEN 'evidence_grounding_low' END, CASE WHEN claim_identity < 0.65 THEN 'claim_identity_low' END,
  CASE WHEN modal_verdict <> axis_verdict THEN 'modal_sampled_verdict_disagrees_with_axis' END, CASE WHEN bundled AND (modal_verdict <> axis_verdict OR overall_uncertainty >= 0.65) THEN 'bundled_citation_scope_ambiguous' END], lambda x: x IS NOT NULL)"""


def _targets_sql() -> str:
    rows = ", ".join(f"({k}, '{m}', {s})" for k, (m, s) in enumerate(sampling.SHARES))
    return f"""WITH totals AS (SELECT unnest([4, 7, 10, 20, 50]) AS total), m(place, mode, share) AS (VALUES {rows}),
      r AS (SELECT total, place, mode, CASE WHEN place < 4 THEN floor(share * total + 0.5)::INT END AS n FROM totals CROSS JOIN m), s AS (SELECT total, place, mode, coalesce(n, total - sum(n) OVER (PARTITION BY total))::INT AS n FROM r),
      t AS (SELECT *, row_number() OVER (PARTITION BY total ORDER BY n DESC, place) = 1 AS most FROM s)
      SELECT total::INT AS total, false AS ambiguous, place::INT AS place, mode, n FROM t UNION ALL SELECT total::INT, true, place::INT, mode, CASE WHEN most AND n > 0 THEN n - 1 ELSE n END FROM t UNION ALL SELECT total::INT, true, 5, '{_AMB}', 1 FROM totals"""


def _quota_case(ambiguous: bool) -> str:
    return "CASE mode " + " ".join(f"WHEN '{m}' THEN {n}" for m, n in sampling.targets(20, ambiguous)) + " ELSE 0 END"


_SAMPLE = f"""WITH {_STATUSED}, e AS (SELECT *, bool_or(mode = '{_AMB}') OVER (PARTITION BY seed) AS has_amb FROM scored WHERE status <> 'not_attempted'),
  q AS (SELECT *, CASE WHEN has_amb THEN {_quota_case(True)} ELSE {_quota_case(False)} END AS quota, row_number() OVER (PARTITION BY seed, mode ORDER BY priority DESC, task_id) AS rn FROM e),
  f AS (SELECT *, rn <= CASE WHEN mode = '{_AMB}' THEN least(quota, 5) ELSE quota END AS first FROM q),
  l AS (SELECT *, 20 - count(*) FILTER (WHERE first) OVER (PARTITION BY seed) AS lft, 5 - count(*) FILTER (WHERE first AND mode = '{_AMB}') OVER (PARTITION BY seed) AS lft_amb, row_number() OVER (PARTITION BY seed, first, mode = '{_AMB}' ORDER BY priority DESC, task_id) AS an FROM f),
  a AS (SELECT *, NOT first AND (mode <> '{_AMB}' OR an <= lft_amb) AS allowed FROM l), s AS (SELECT *, allowed AND row_number() OVER (PARTITION BY seed, allowed ORDER BY priority DESC, task_id) <= lft AS second FROM a)
  SELECT seed, task_id, mode, priority, tags, CASE WHEN first THEN 1 ELSE 2 END AS pass FROM s WHERE first OR second"""

QUERIES = {
    "evidence_status": (evidence_status, f"WITH {_STATUSED} SELECT task_id, status FROM statused"),
    "evidence_summary": (evidence_summary, f"WITH {_STATUSED} SELECT mode, status, count(*) AS tasks, sum(CASE WHEN status IN ('retrieved', 'abstract_only_matches') THEN least(matches, 5) ELSE 0 END)::BIGINT AS spans FROM statused GROUP BY mode, status"),
    "rerank_merge": (
        rerank_merge,
        """WITH li AS (SELECT l_orderkey AS task, l_partkey AS block, max(l_quantity) AS bm25 FROM lineitem GROUP BY ALL), r AS (SELECT *, CASE WHEN (task + block) % 3 <> 0 THEN (block * 7 + task) % 100 END AS score, row_number() OVER (PARTITION BY task ORDER BY bm25 DESC, block) AS b FROM li),
        k AS (SELECT *, row_number() OVER (PARTITION BY task ORDER BY score DESC NULLS LAST, bm25 DESC, block) AS rank FROM r WHERE score IS NOT NULL OR b = 1) SELECT task, block, coalesce(score, -1) AS score, rank::INT AS rank FROM k WHERE rank <= 3""",
    ),
    "sample_targets": (sample_targets, _targets_sql()),
    "task_priority": (task_priority, f"WITH {_STATUSED} SELECT task_id, priority, tags FROM scored"),
    "stratified_sample": (stratified_sample, _SAMPLE),
    "vector_mean_var": (vector_mean_var, f"WITH {_AGG} SELECT record_id, " + ", ".join(f"round({a}, 6) AS {a}, round(var_{a}, 6) AS var_{a}" for a in vectors.AXES) + " FROM agg"),
    "vector_entropy_mode": (vector_entropy_mode, f"WITH {_AGG} SELECT record_id, modal_verdict, scope_direction, certainty_direction, round(entropy, 6) AS entropy, round(overall_uncertainty, 6) AS overall_uncertainty FROM agg"),
    "axis_verdict": (axis_verdict, f"WITH {_AGG} SELECT record_id, axis_rule, axis_verdict FROM agg"),
    "adaptive_routing": (
        adaptive_routing,
        f"""WITH {_AGG} SELECT record_id, concat_ws(',', CASE WHEN axis_verdict = 'cannot_determine' THEN 'axis_verdict_cannot_determine' END, CASE WHEN unsure >= 0.55 THEN 'uncertainty_borderline' END, CASE WHEN {_NEAR} THEN 'core_axis_borderline' END,
        CASE WHEN modal_verdict <> axis_verdict THEN 'sampled_verdict_disagrees_with_axis' END, CASE WHEN bundled AND (modal_verdict <> axis_verdict OR overall_uncertainty >= 0.55) THEN 'bundled_citation_scope_ambiguous' END) AS reasons,
        CASE WHEN evidence_grounding >= 0.8 THEN 'high' WHEN evidence_grounding >= 0.6 THEN 'medium' ELSE 'low' END AS quality,
        CASE WHEN unsure <= 0.35 AND entropy <= 0.15 AND mean_variance <= 0.03 AND modal_verdict = axis_verdict THEN 'high' ELSE 'medium' END AS confidence FROM agg""",
    ),
    "escalation_routing": (escalation_routing, f"WITH {_AGG} SELECT record_id, array_to_string({_ESCALATION}, ',') AS reasons FROM agg"),
    "routing_histogram": (routing_histogram, f"WITH {_AGG}, r AS (SELECT axis_verdict, unnest({_ESCALATION}) AS reason FROM agg) SELECT coalesce(axis_verdict, 'all') AS axis_verdict, coalesce(reason, 'all') AS reason, count(*) AS n FROM r GROUP BY ROLLUP (axis_verdict, reason)"),
}
