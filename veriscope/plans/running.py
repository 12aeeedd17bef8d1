"""Queries on run state and on what surrounds adjudication."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import rules
from ..operators import adjudicate, compare, runs
from ..sources import testdata as td
from .comparing import _STAGES, _stages

_RUN_STATES = ("succeeded", "failed", "running", "queued", "cancelled", "interrupted")


def _runs(spark, sf):
    e = td.read(spark, sf, "events").groupBy("user_id").agg(F.max("event_id").alias("updated"), F.count_if(F.col("event_type") == "purchase").alias("judged"))
    return e.select(F.col("user_id").alias("run_id"), "updated", "judged", td._pick(_RUN_STATES, F.col("user_id") % 6).alias("status"))


def create_runs(spark, sf):
    wanted = td.read(spark, sf, "customer").select(F.col("c_custkey").alias("run_id"), F.when(F.col("c_custkey") % 3 == 0, F.col("c_name")).when(F.col("c_custkey") % 3 == 1, F.lit("")).alias("tracked_claim"))
    return runs.create_runs(wanted)


def _flat(spark, sf):
    return _stages(spark, sf).select("run_id", "stage_key", "stage_order", "family", "status")


def ensure_stages(spark, sf):
    wanted = td.read(spark, sf, "events").select(F.col("user_id").alias("run_id"), td._pick(runs.STAGES, (F.col("event_id") * 3) % 7).alias("stage_key"), (F.col("event_id") % 4).cast("int").alias("family"))
    return runs.ensure_stages(_flat(spark, sf), wanted)


def update_stages(spark, sf):
    s = _stages(spark, sf).select("run_id", "stage_key", "family", "status", "started", F.concat(F.lit("in/"), "stage_key").alias("input_path"), F.concat(F.lit("out/"), "stage_key").alias("output_path"))
    changes = s.where("run_id % 3 = 0").select("run_id", "stage_key", "family", F.lit("running").alias("status"), F.when(F.col("run_id") % 2 == 0, F.lit(7).cast("long")).alias("started"), F.when(F.col("family") == 1, F.lit("in/new")).alias("input_path"), F.when(F.col("family") == 2, F.lit("out/new")).alias("output_path"))
    return runs.update_stages(s, changes)


def active_run(spark, sf):
    return runs.active_run(_runs(spark, sf)).select("run_id", "status")


def stage_gates(spark, sf):
    return runs.gate(_flat(spark, sf))


def stage_groups(spark, sf):
    return runs.stage_groups(_flat(spark, sf)).select("run_id", "stage_key", "status", "members", "succeeded", "running", "failed", "headline")


def run_health(spark, sf):
    return runs.health(_flat(spark, sf))


def dashboard_stats(spark, sf):
    return runs.dashboard(_runs(spark, sf))


def run_cost(spark, sf):
    e = td.read(spark, sf, "events")
    reports = e.where("event_id % 40 = 7").select(F.col("user_id").alias("run_id"), F.col("event_id").alias("stamp"), F.col("value").alias("usd"))
    telemetry = e.where("user_id % 4 <> 3").select(F.col("user_id").alias("run_id"), F.col("value").alias("usd"))
    return runs.run_cost(_runs(spark, sf), reports, telemetry).withColumn("usd", F.round("usd", 4))


_DETAILS = ("No seeds produced.\n  the DOI is unknown ", "Command exited with code 2.", "Command exited with code 2.\r\n\r\nread timed out", " \n ", "disk full\nmore", "No seeds produced")


def failure_details(spark, sf):
    return td.read(spark, sf, "events").select("event_id", runs.failure_detail(td._pick(_DETAILS, F.col("event_id") % 6)).alias("detail"))


def rubric_options(spark, sf):
    t = adjudicate.with_rubric(td.tasks(spark, sf).select("task_id", "mode"))
    return t.groupBy("mode").agg(F.count("*").alias("n"), F.max(F.size("options")).alias("options"), F.min(F.array_join("options", ",")).alias("verdicts"))


def _records(spark, sf):
    b = td.audit_base(spark, sf)
    return b.withColumn("confidence", td._pick(("high", "medium", "low"), F.col("task_id") % 3)).withColumn("bundled", F.col("task_id") % 4 == 1)


def advisor_escalation(spark, sf):
    return adjudicate.needs_advisor(_records(spark, sf)).select("task_id", "verdict", "confidence", "bundled")


def run_telemetry(spark, sf):
    c = td.calls(spark, sf).withColumn("latency_ms", (F.col("event_id") * 37) % 1000)
    return adjudicate.run_telemetry(c, "model")


def refresh_records(spark, sf):
    newer = td.audit_base(spark, sf).where("task_id % 5 = 2").select("task_id", F.lit("reread").alias("rationale"), F.when(F.col("task_id") % 2 == 0, F.lit("high")).alias("quality"))
    return adjudicate.refresh(td.audit_base(spark, sf), newer, ("rationale", "quality")).select("task_id", "rationale", "quality", "verdict")


def edge_tags(spark, sf):
    p = td.papers(spark, sf)
    flags = rules.edge_flags(F.col("paper_type"), F.col("title"), F.col("refs"))
    names = {"review": "is_review", "commentary": "is_commentary", "letter": "is_letter", "chapter": "is_book_chapter", "preprint": "is_preprint", "many references": "high_reference_count"}
    return p.select("paper_id", adjudicate.edge_tags({k: flags[v] for k, v in names.items()}).alias("tags"))


def diff_order(spark, sf):
    return adjudicate.diff_order(compare.diff(td.audit_base(spark, sf), td.audit_candidate(spark, sf))).select("task_id", "missing_in_base")


def excluded_last(spark, sf):
    return adjudicate.excluded_last(td.audit_base(spark, sf)).select("task_id", "excluded")


_RUNS = f"runs AS (SELECT user_id AS run_id, max(event_id) AS updated, count(*) FILTER (WHERE event_type = 'purchase') AS judged, {td._sql_list(_RUN_STATES)}[(user_id % 6 + 1)::INT] AS status FROM events GROUP BY user_id)"
_DIM = f"dim AS (SELECT unnest({td._sql_list(runs.STAGES)}) AS stage_key, unnest(range(7))::INT AS stage_order)"
_ENDED = "status IN ('failed', 'cancelled', 'interrupted')"
_GROUPS = f"""{_STAGES}, grouped AS (SELECT run_id, stage_key, stage_order, count(*) AS members, count(*) FILTER (WHERE status = 'succeeded') AS succeeded, count(*) FILTER (WHERE status = 'running') AS running, count(*) FILTER (WHERE {_ENDED}) AS failed,
  count(*) FILTER (WHERE status = 'stale') AS stale, CASE WHEN bool_or(status = 'running') THEN 'running' WHEN bool_or({_ENDED}) THEN arg_min(status, family) FILTER (WHERE {_ENDED}) WHEN bool_and(status = 'succeeded') THEN 'succeeded'
  WHEN bool_or(status = 'stale') THEN 'stale' WHEN bool_or(status = 'blocked') THEN 'blocked' ELSE arg_min(status, family) END AS status FROM stages GROUP BY ALL)"""
_RUBRIC = "CASE mode " + " ".join(f"WHEN '{m}' THEN '{o}'" for m, _, o in adjudicate.RUBRICS) + " END"

QUERIES = {
    "create_runs": (create_runs, f"WITH {_DIM} SELECT c_custkey AS run_id, stage_key, stage_order, 0 AS family, CASE WHEN stage_key = 'discover' AND c_custkey % 3 = 0 THEN 'succeeded' ELSE 'not_started' END AS status FROM customer CROSS JOIN dim"),
    "ensure_stages": (
        ensure_stages,
        f"""WITH {_STAGES}, {_DIM}, w AS (SELECT DISTINCT user_id AS run_id, {td._sql_list(runs.STAGES)}[((event_id * 3) % 7 + 1)::INT] AS stage_key, (event_id % 4)::INT AS family FROM events)
        SELECT run_id, stage_key, stage_order, family, status FROM stages UNION ALL SELECT w.run_id, w.stage_key, dim.stage_order, w.family, 'not_started' FROM w JOIN dim USING (stage_key) LEFT JOIN stages s ON s.run_id = w.run_id AND s.stage_key = w.stage_key AND s.family = w.family WHERE s.run_id IS NULL""",
    ),
    "update_stages": (
        update_stages,
        f"""WITH {_STAGES} SELECT run_id, stage_key, family, CASE WHEN run_id % 3 = 0 THEN 'running' ELSE status END AS status, CASE WHEN run_id % 6 = 0 THEN 7 ELSE started END AS started,
        CASE WHEN run_id % 3 = 0 AND family = 1 THEN 'in/new' ELSE 'in/' || stage_key END AS input_path, CASE WHEN run_id % 3 = 0 THEN CASE WHEN family = 2 THEN 'out/new' END ELSE 'out/' || stage_key END AS output_path FROM stages""",
    ),
    "active_run": (active_run, f"WITH {_RUNS} SELECT run_id, status FROM runs WHERE status IN ('queued', 'running') ORDER BY updated DESC, run_id DESC LIMIT 1"),
    "stage_gates": (
        stage_gates,
        f"""WITH {_STAGES}, g AS (SELECT run_id, family, stage_key, arg_min(stage_key || ' is ' || status, stage_order) FILTER (WHERE status <> 'succeeded') OVER (PARTITION BY run_id, family ORDER BY stage_order ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS reason FROM stages)
        SELECT run_id, family, stage_key, reason IS NULL AS can_run, reason FROM g""",
    ),
    "stage_groups": (
        stage_groups,
        f"""WITH {_GROUPS} SELECT run_id, stage_key, status, members, succeeded, running, failed, CASE WHEN members = 1 THEN NULL WHEN running > 0 THEN running || ' running' WHEN failed > 0 THEN failed || ' ended with errors' WHEN stale > 0 THEN 'some are stale'
        WHEN succeeded = members THEN members || ' complete' ELSE succeeded || '/' || members || ' complete' END AS headline FROM grouped""",
    ),
    "run_health": (
        run_health,
        f"""WITH {_GROUPS}, r AS (SELECT run_id, arg_min(status || ' at ' || stage_key, stage_order * 1000 + family) FILTER (WHERE {_ENDED}) AS bad, arg_min(stage_key, stage_order * 1000 + family) FILTER (WHERE {_ENDED}) AS bad_key,
          arg_min(stage_key, stage_order * 1000 + family) FILTER (WHERE status = 'running') AS run, arg_max(stage_key, stage_order * 1000 + family) FILTER (WHERE status = 'succeeded') AS won, arg_min(stage_key, stage_order * 1000 + family) AS first FROM stages GROUP BY run_id),
        g AS (SELECT run_id, arg_min(stage_key, stage_order) FILTER (WHERE status = 'running') AS running, count(*) FILTER (WHERE status = 'succeeded') AS done, count(*) AS n FROM grouped GROUP BY run_id)
        SELECT run_id, coalesce(bad, 'running ' || running, done || '/' || n || ' stages complete') AS health, coalesce(run, bad_key, won, first) AS focus FROM r JOIN g USING (run_id)""",
    ),
    "dashboard_stats": (dashboard_stats, f"WITH {_RUNS} SELECT count(*) AS total, count(*) FILTER (WHERE status IN ('queued', 'running')) AS active, count(*) FILTER (WHERE status = 'succeeded') AS completed, count(*) FILTER (WHERE {_ENDED}) AS failed, sum(judged)::BIGINT AS judged FROM runs"),
    "run_cost": (
        run_cost,
        f"""WITH {_RUNS}, l AS (SELECT user_id AS run_id, arg_max(value, event_id) AS v FROM events WHERE event_id % 40 = 7 GROUP BY 1), s AS (SELECT user_id AS run_id, sum(value) AS v FROM events WHERE user_id % 4 <> 3 GROUP BY 1)
        SELECT run_id, round(coalesce(l.v, s.v, 0), 4) AS usd, CASE WHEN l.run_id IS NOT NULL THEN 'report' WHEN s.run_id IS NOT NULL THEN 'telemetry' ELSE 'none' END AS source FROM runs LEFT JOIN l USING (run_id) LEFT JOIN s USING (run_id)""",
    ),
    "failure_details": (failure_details, "SELECT event_id, ['the DOI is unknown', 'Command exited with code 2.', 'read timed out', chr(10), 'disk full', 'No seeds produced'][(event_id % 6 + 1)::INT] AS detail FROM events"),
    "rubric_options": (rubric_options, f"WITH {td.TASKS} SELECT mode, count(*) AS n, max(len(string_split({_RUBRIC}, ',')))::INT AS options, min({_RUBRIC}) AS verdicts FROM tasks GROUP BY mode"),
    "advisor_escalation": (
        advisor_escalation,
        f"""WITH {td.AUDIT_BASE}, r AS (SELECT *, ['high', 'medium', 'low'][(task_id % 3 + 1)::INT] AS confidence, task_id % 4 = 1 AS bundled FROM base)
        SELECT task_id, verdict, confidence, bundled FROM r WHERE NOT excluded AND coalesce(confidence = 'low' OR verdict = 'cannot_determine' OR (bundled AND confidence = 'medium'), false)""",
    ),
    "run_telemetry": (
        run_telemetry,
        f"""WITH {td.CALLS}, c AS (SELECT *, (event_id * 37) % 1000 AS latency_ms FROM calls), t AS (SELECT model, count(*) AS calls, count(*) FILTER (WHERE successful) AS successful, count(*) FILTER (WHERE NOT successful) AS failed,
        """ + ", ".join(f"coalesce(sum({x}) FILTER (WHERE successful), 0)::BIGINT AS total_{x}" for x in ("input_tokens", "output_tokens", "reasoning_tokens", "latency_ms")) + """ FROM c GROUP BY model)
        SELECT *, CASE WHEN successful > 0 THEN floor(total_latency_ms / successful + 0.5)::BIGINT ELSE 0 END AS mean_latency_ms FROM t""",
    ),
    "refresh_records": (refresh_records, f"WITH {td.AUDIT_BASE} SELECT task_id, CASE WHEN task_id % 5 = 2 THEN 'reread' ELSE rationale END AS rationale, CASE WHEN task_id % 5 = 2 AND task_id % 2 = 0 THEN 'high' ELSE quality END AS quality, verdict FROM base"),
    "edge_tags": (
        edge_tags,
        rf"""WITH {td.PAPERS}, k AS (SELECT paper_id, title, refs, lower(coalesce(paper_type, '')) AS t FROM papers)
        SELECT paper_id, coalesce(nullif(concat_ws(',', CASE WHEN t IN ('review', 'literature-review') THEN 'review' END, CASE WHEN t IN ('editorial', 'paratext', 'peer-review') OR regexp_matches(title, '(?i){'|'.join(rules.COMMENTARY_TITLES)}') THEN 'commentary' END,
        CASE WHEN t IN ('letter', 'erratum', 'correction') THEN 'letter' END, CASE WHEN t IN ('book-chapter', 'book-section') THEN 'chapter' END, CASE WHEN t IN ('posted-content', 'preprint') THEN 'preprint' END, CASE WHEN refs > 100 THEN 'many references' END), ''), 'untagged') AS tags FROM k""",
    ),
    "diff_order": (diff_order, f"WITH {td.AUDIT_BASE}, {td.audit_candidate_sql()} SELECT coalesce(b.task_id, c.task_id) AS task_id, b.task_id IS NULL AS missing_in_base FROM base b FULL JOIN cand c ON b.task_id = c.task_id ORDER BY missing_in_base, coalesce(b.ord, c.ord), 1"),
    "excluded_last": (excluded_last, f"WITH {td.AUDIT_BASE} SELECT task_id, excluded FROM base ORDER BY excluded, ord, task_id"),
}
