"""Queries on summaries of samples, routing, classification and stages."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import rules
from ..operators import summaries
from ..sources import testdata as td
from . import answering

_SOURCES = ("axis_derived", "categorical", "axis_derived", "axis_derived")


def _sample(spark, sf):
    return td.audit_base(spark, sf).withColumn("seed", F.col("task_id") % 30)


def audit_summary(spark, sf):
    return summaries.audit_summary(_sample(spark, sf), "seed").withColumn("rate", F.round("rate", 6))


def routing_summary(spark, sf):
    k = F.col("task_id")
    none = F.array().cast("array<string>")
    records = _sample(spark, sf).where("not excluded and verdict is not null").select(
        "seed", td._pick(_SOURCES, k % 4).alias("source"), (k % 3 == 0).alias("adaptive"), F.when((k % 3 == 0) & (F.col("seed") != 7), F.array(F.lit("variance_high"), td._pick(("few", "split"), k % 2))).otherwise(none).alias("adaptive_reasons"),
        F.when(k % 4 == 1, F.array(F.lit("near_threshold"))).otherwise(none).alias("escalation_reasons"), (3 + k % 6).alias("calls"), ((k % 100).cast("decimal(28,6)") / 1000).cast("decimal(28,6)").alias("cost"),
    )
    costs = spark.range(0, 25).select(F.col("id").alias("seed"), (F.col("id").cast("decimal(28,6)") / 8).cast("decimal(28,6)").alias("cost"))
    return summaries.routing_summary(records, "seed", costs).withColumn("value", F.round(F.col("value").cast("double"), 5))


def _edges(spark, sf):
    k = F.col("citing") % 8
    m = td.mentions(spark, sf).groupBy("citing", "cited").agg(F.count("*").alias("n"), F.count_if("bundled").alias("b"), F.bool_or("review").alias("review"))
    return m.select(
        "citing", "cited", F.when(k < 5, "extracted").when(k == 5, "skipped").otherwise("failed").alias("state"), F.when(k < 5, "success").when(k == 5, "skipped_not_auditable").when(k == 6, "fail_http_403").otherwise("fail_no_reference_match").alias("outcome"),
        F.when(k < 5, F.col("n")).otherwise(0).alias("n_mentions"), F.when(k < 5, F.col("b")).otherwise(0).alias("n_bundled"), "review",
    )


def classification_layers(spark, sf):
    k = F.col("citing") + F.col("ord")
    tasks = td.mentions(spark, sf).where("ord % 2 = 0").select("citing", "cited", td._pick(rules.ROLES[:4], k % 4).alias("role"), td._pick(rules.MODES, k % 8).alias("mode"))
    return summaries.classification_layers(_edges(spark, sf), tasks, rules.ROLES, rules.MODES).withColumn("rate", F.round("rate", 6))


def stage_headlines(spark, sf):
    k = F.col("seq")
    e = td.stage_events(spark, sf)
    dull = "Command exited with code 1."
    message = F.when(k % 5 == 0, dull).when(k % 5 == 1, F.concat(F.lit(f" {dull}\r\n\n  disk "), (k % 7).cast("string"))).when(k % 5 == 2, "No seeds produced\nno doi").when(k % 10 == 3, " \n ")
    return e.select("seq", "stage_key", summaries.headline(F.col("stage_key"), F.col("status"), message, F.when(k % 3 == 0, "HTTP 529")).alias("headline"))


def stage_metrics(spark, sf):
    from ..operators.answers import discovered_claims

    found = discovered_claims(*answering._discovery(spark, sf)).withColumn("seed", F.col("paper_id") % 30)
    return summaries.stage_metrics("discover", found, "seed").unionByName(summaries.stage_metrics("adjudicate", _sample(spark, sf), "seed"))


_BASE = f"{td.AUDIT_BASE}, s AS (SELECT *, task_id % 30 AS seed, NOT excluded AND verdict IS NOT NULL AS judged FROM base), t AS (SELECT seed, count(*) FILTER (WHERE judged) AS total FROM s GROUP BY seed)"
_FOUR = "['total', 'supported', 'partially_supported', 'not_supported', 'cannot_determine']"
_K = "task_id"

QUERIES = {
    "audit_summary": (
        audit_summary,
        f"""WITH {_BASE}, r AS (
            SELECT seed, 'records' AS section, '' AS row, unnest(['all', 'excluded', 'adjudicated']) AS name, unnest([count(*), count(*) FILTER (WHERE excluded), count(*) FILTER (WHERE judged)]) AS n FROM s GROUP BY seed
            UNION ALL SELECT seed, 'verdict', '', 'total', total FROM t UNION ALL SELECT seed, 'verdict', '', verdict, count(*) FROM s WHERE judged GROUP BY ALL
            UNION ALL SELECT seed, 'quality', '', q, (SELECT count(*) FROM s WHERE s.seed = t.seed AND judged AND quality = q) FROM t, (SELECT unnest(['high', 'medium', 'low']) AS q)
            UNION ALL SELECT m.seed, 'mode', m.mode, v, count(*) FILTER (WHERE v = 'total' OR s.verdict = v) FROM (SELECT DISTINCT seed, mode FROM s WHERE judged) m CROSS JOIN (SELECT unnest({_FOUR}) AS v) JOIN s ON s.seed = m.seed AND s.mode = m.mode AND s.judged GROUP BY ALL)
          SELECT seed, section, row, name, n, CASE WHEN section IN ('verdict', 'quality') AND name <> 'total' AND total > 0 THEN round(n / total, 6) END AS rate FROM r JOIN t USING (seed)""",
    ),
    "routing_summary": (
        routing_summary,
        f"""WITH {_BASE}, v AS (SELECT seed, {_K}, {td._sql_list(_SOURCES)}[({_K} % 4 + 1)::INT] AS source, {_K} % 3 = 0 AS adaptive, CASE WHEN {_K} % 3 = 0 AND seed <> 7 THEN ['variance_high', ['few', 'split'][({_K} % 2 + 1)::INT]] ELSE [] END AS a,
              CASE WHEN {_K} % 4 = 1 THEN ['near_threshold'] ELSE [] END AS e, 3 + {_K} % 6 AS calls, ({_K} % 100) / 1000 AS cost FROM s WHERE judged),
            g AS (SELECT seed, count(*) AS records, count(*) FILTER (WHERE source = 'axis_derived') AS accepted, count(*) FILTER (WHERE adaptive) AS adaptive, sum(calls) AS calls, sum(cost) AS vector_cost, CASE WHEN seed < 25 THEN seed / 8 ELSE 0 END AS other FROM v GROUP BY seed),
            reasons AS (SELECT seed, 'adaptive_reason' AS section, unnest(a) AS name FROM v UNION ALL SELECT seed, 'escalation_reason', unnest(e) FROM v),
            counted AS (SELECT seed, section, name, count(*) AS n FROM reasons GROUP BY ALL),
            r AS (SELECT seed, 'metric' AS section, unnest(['records', 'accepted', 'escalated', 'adaptive', 'calls', 'vector_cost', 'calls_per_record', 'categorical_cost', 'cost']) AS name,
                unnest([records::DOUBLE, accepted::DOUBLE, (records - accepted)::DOUBLE, adaptive::DOUBLE, calls::DOUBLE, vector_cost::DOUBLE, calls / records, other::DOUBLE, vector_cost + other]) AS value FROM g
              UNION ALL SELECT seed, 'source', source, count(*) FROM v GROUP BY ALL UNION ALL SELECT * FROM counted
              UNION ALL SELECT g.seed, x.section, 'none', 0 FROM g, (SELECT unnest(['adaptive_reason', 'escalation_reason']) AS section) x WHERE NOT EXISTS (FROM counted c WHERE c.seed = g.seed AND c.section = x.section))
          SELECT seed, section, name, round(value, 5) AS value FROM r""",
    ),
    "classification_layers": (
        classification_layers,
        f"""WITH {td.MENTIONS}, e AS (SELECT citing, cited, citing % 8 AS k, count(*) AS n, count(*) FILTER (WHERE bundled) AS b, bool_or(review) AS review FROM mentions GROUP BY ALL),
            t AS (SELECT {td._sql_list(rules.ROLES[:4])}[((citing + ord) % 4 + 1)::INT] AS role, {td._sql_list(rules.MODES)}[((citing + ord) % 8 + 1)::INT] AS mode FROM mentions WHERE ord % 2 = 0 AND citing % 8 < 5),
            x AS (SELECT count(*) AS edges, count(*) FILTER (WHERE k < 5) AS extracted, count(*) FILTER (WHERE k > 5) AS failed, count(*) FILTER (WHERE k = 5) AS skipped, coalesce(sum(n) FILTER (WHERE k < 5), 0) AS mentions, coalesce(sum(b) FILTER (WHERE k < 5), 0) AS bundled, count(*) FILTER (WHERE k < 5 AND review) AS reviewed FROM e)
          SELECT 'extraction' AS section, unnest(['edges', 'extracted', 'failed', 'skipped']) AS name, unnest([edges, extracted, failed, skipped])::BIGINT AS n, NULL::DOUBLE AS rate FROM x
          UNION ALL SELECT 'failure', CASE k WHEN 6 THEN 'fail_http_403' ELSE 'fail_no_reference_match' END, count(*), NULL FROM e WHERE k > 5 GROUP BY k
          UNION ALL SELECT 'literature', unnest(['edges_with_mentions', 'mentions', 'bundled_mentions', 'review_edges']), unnest([extracted, mentions, bundled, reviewed])::BIGINT, unnest([NULL, NULL, round(bundled / greatest(mentions, 1), 6), round(reviewed / greatest(extracted, 1), 6)]) FROM x
          UNION ALL SELECT 'literature', unnest(['tasks', 'manual_review_tasks']), unnest([count(*), count(*) FILTER (WHERE starts_with(mode, 'manual_review'))]), NULL FROM t
          UNION ALL SELECT 'role', r, (SELECT count(*) FROM t WHERE role = r), NULL FROM (SELECT unnest({td._sql_list(rules.ROLES)}) AS r)
          UNION ALL SELECT 'mode', m, (SELECT count(*) FROM t WHERE mode = m), NULL FROM (SELECT unnest({td._sql_list(rules.MODES)}) AS m)""",
    ),
    "stage_headlines": (
        stage_headlines,
        f"""WITH {td.STAGE_EVENTS}, c AS (SELECT seq, stage_key, status, CASE seq % 5 WHEN 1 THEN 'disk ' || (seq % 7) WHEN 2 THEN 'no doi' END AS told FROM stage_events)
          SELECT seq, stage_key, coalesce(told, CASE WHEN stage_key = 'discover' AND status IN ('failed', 'cancelled', 'interrupted') THEN CASE WHEN seq % 3 = 0 THEN 'HTTP 529' ELSE '{summaries.STOPPED}' END
            ELSE CASE stage_key {" ".join(f"WHEN '{s}' THEN '{h}'" for s, h in summaries.HEADLINES.items())} END END) AS headline FROM c""",
    ),
    "stage_metrics": (
        stage_metrics,
        f"""WITH {answering._DISCOVERED}, {_BASE},
          m AS (SELECT paper_id % 30 AS seed, 'discover' AS stage, unnest([0, 1, 2, 3]) AS place, unnest(['Papers', 'Completed', 'Claims', 'Findings']) AS metric, unnest([count(*), count(*) FILTER (WHERE status = 'completed'), sum(n_claims), sum(n_findings)]) AS n FROM g GROUP BY 1
            UNION ALL SELECT seed, 'adjudicate', unnest([0, 1, 2, 3]), unnest(['Records', 'Active', 'Judged', 'Partial']), unnest([count(*), count(*) FILTER (WHERE NOT excluded), count(*) FILTER (WHERE judged), count(*) FILTER (WHERE judged AND verdict = 'partially_supported')]) FROM s GROUP BY seed)
          SELECT seed, stage, place, metric, n::BIGINT AS n FROM m""",
    ),
}
