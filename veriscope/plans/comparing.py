"""Queries on adjudicated datasets, costs and run state."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import rules
from ..operators import compare, ledger
from ..sources import testdata as td


def blind_export(spark, sf):
    return compare.blind(td.audit_base(spark, sf))


def diff_full_outer(spark, sf):
    return compare.diff(td.audit_base(spark, sf), td.audit_candidate(spark, sf)).drop("ord")


def diff_summary(spark, sf):
    d = compare.diff(td.audit_base(spark, sf), td.audit_candidate(spark, sf))
    return d.agg(*[F.count_if(c).alias(c) for c in ("verdict_changed", "rationale_changed", "quality_changed", "exclusion_changed", "missing_in_base", "missing_in_candidate")])


def candidate_rank(spark, sf):
    parts = [td.audit_candidate(spark, sf, s).withColumn("label", F.lit(f"c{s}")) for s in (0, 1, 2)]
    out = compare.summarize(td.audit_base(spark, sf), parts[0].unionByName(parts[1]).unionByName(parts[2]))
    from pyspark.sql.window import Window

    place = F.row_number().over(Window.orderBy(F.desc("exact_rate"), F.desc("adjacent_rate"), "changes", "label"))  # a row for each candidate
    return out.select("label", "active", "exact", "adjacent", "changes", "missing", F.round("exact_rate", 6).alias("exact_rate"), place.alias("place"))


def apply_deltas(spark, sf):
    base = td.audit_base(spark, sf)
    deltas = base.where("task_id % 6 = 1 and not excluded").select("task_id", F.lit("not_supported").alias("final_verdict"), F.when(F.col("task_id") % 4 == 1, "checked").alias("rationale"), F.lit(None).cast("string").alias("quality"), F.when(F.col("task_id") % 10 == 1, True).alias("excluded"), F.when(F.col("task_id") % 10 == 1, "off topic").alias("exclude_reason"), (F.col("task_id") % 10 == 1).alias("allow_excluded"))
    return compare.apply_deltas(base, deltas).select("task_id", "verdict", "rationale", "quality", "excluded", "exclude_reason", "touched")


def agreement_by_mode(spark, sf):
    out = compare.agreement(td.audit_base(spark, sf), td.audit_candidate(spark, sf))
    return out.withColumn("exact_rate", F.round("exact_rate", 6))


def verdict_pivot(spark, sf):
    b = td.audit_base(spark, sf).where("not excluded and verdict is not null")
    return b.groupBy("mode").pivot("verdict", list(rules.VERDICTS)).agg(F.count(F.lit(1))).na.fill(0)


def cost_estimate(spark, sf):
    return ledger.priced(td.calls(spark, sf), td.prices(spark)).select("event_id", "model", F.round("micro_usd", 3).cast("double").alias("micro_usd"))


def ledger_by_purpose(spark, sf):
    return ledger.ledger_by_purpose(td.calls(spark, sf), td.prices(spark)).withColumn("usd", F.round("usd", 6))


def ledger_by_stage(spark, sf):
    return ledger.ledger_by_stage(td.calls(spark, sf), td.prices(spark)).withColumn("usd", F.round("usd", 6))


def _stages(spark, sf):
    e = td.stage_events(spark, sf).withColumn("started", F.col("seq"))
    return ledger.upsert(e, ["run_id", "stage_key", "stage_order", "family"], "seq", ("started",))


def stage_upsert(spark, sf):
    return _stages(spark, sf).select("run_id", "stage_key", "family", "started", F.col("seq").alias("last"), "status")


def stage_stale_cascade(spark, sf):
    s = _stages(spark, sf)
    changed = s.groupBy("run_id", "family").agg(F.min(F.when(F.col("status") == "failed", F.col("stage_order"))).alias("from_order"))
    return ledger.mark_stale(s, changed).select("run_id", "stage_key", "family", "status")


def stage_aggregate_status(spark, sf):
    return ledger.aggregate_status(_stages(spark, sf)).select("run_id", "stage_key", "members", "status")


def can_run_from(spark, sf):
    return ledger.can_run_from(_stages(spark, sf)).select("run_id", "stage_key", "family", "can_run")


def purge_old(spark, sf):
    e = td.read(spark, sf, "events")
    newest = e.agg(F.max("ts").alias("now"))
    return ledger.purge(e.crossJoin(F.broadcast(newest)), F.col("now"), 5).groupBy("event_type").agg(F.count("*").alias("n"))


def cache_antijoin(spark, sf):
    wanted = td.read(spark, sf, "documents").select(F.sha2("text", 256).alias("key"))
    cache = td.read(spark, sf, "documents").where("doc_id % 3 = 0").select(F.sha2("text", 256).alias("key"))
    return ledger.missing_from_cache(wanted, cache, "key")


_MESSAGES = ("Credit balance is too low", "Invalid API key", "403 Forbidden", "Too many requests", "Connection reset by peer", "odd answer", "quota exceeded: 429", "Permission denied: api key")


def error_class(spark, sf):
    m = td.read(spark, sf, "events").select("event_id", td._pick(_MESSAGES, F.col("event_id") % 8).alias("message"))
    out = m.withColumn("class", rules.provider_error(F.col("message")))
    return out.groupBy("message", "class", rules.is_fatal(F.col("class")).alias("fatal")).agg(F.count("*").alias("n"))


_PAIR = f"{td.AUDIT_BASE}, {td.audit_candidate_sql()}"
_DIFF = f"""WITH {_PAIR}, d AS (SELECT coalesce(b.task_id, c.task_id) AS task_id, b.verdict AS base_verdict, c.verdict AS candidate_verdict, NOT ig AND b.verdict IS DISTINCT FROM c.verdict AS verdict_changed,
  NOT ig AND b.rationale IS DISTINCT FROM c.rationale AS rationale_changed, NOT ig AND b.quality IS DISTINCT FROM c.quality AS quality_changed,
  b.excluded IS DISTINCT FROM c.excluded OR b.exclude_reason IS DISTINCT FROM c.exclude_reason AS exclusion_changed, b.task_id IS NULL AS missing_in_base, c.task_id IS NULL AS missing_in_candidate
  FROM base b FULL JOIN cand c ON b.task_id = c.task_id, LATERAL (SELECT coalesce(b.excluded, false) OR coalesce(c.excluded, false) AS ig))"""
_ADJ = "({0} = {1} OR ({0} IN ('supported', 'partially_supported') AND {1} IN ('supported', 'partially_supported')))"
_HELD_HOUR, _READ = "cache_write_hour_tokens::DECIMAL(15, 0)", "cache_read_tokens::DECIMAL(15, 0)"
_WRITE = "greatest(cache_write_tokens, cache_write_hour_tokens)::DECIMAL(15, 0)"
_MICRO = f"""((greatest(0::DECIMAL(15, 0), input_tokens::DECIMAL(15, 0) - {_READ} - {_WRITE}) + {_READ} * 0.1 + ({_WRITE} - {_HELD_HOUR}) * 1.25 + {_HELD_HOUR} * 2.0) * pi
  + (CASE WHEN output_tokens > 0 THEN output_tokens ELSE reasoning_tokens END)::DECIMAL(15, 0) * po)"""
_COSTED = f"{td.CALLS}, {td.PRICES}, priced AS (SELECT calls.*, coalesce(input_usd, {ledger.DEFAULT_PRICE[0]})::DECIMAL(12, 6) AS pi, coalesce(output_usd, {ledger.DEFAULT_PRICE[1]})::DECIMAL(12, 6) AS po FROM calls LEFT JOIN prices USING (model)), costed AS (SELECT *, {_MICRO} AS micro, micro::DOUBLE / 1000000 AS usd FROM priced)"
_SUMS = "count(*) AS attempted, count(*) FILTER (WHERE successful) AS successful, count(*) FILTER (WHERE failed) AS failed, count(*) FILTER (WHERE billable) AS billable, count(*) FILTER (WHERE hit) AS hit, sum(input_tokens)::BIGINT AS input_tokens, sum(output_tokens)::BIGINT AS output_tokens, sum(reasoning_tokens)::BIGINT AS reasoning_tokens, round(sum(usd), 6) AS usd"
_STAGES = f"{td.STAGE_EVENTS}, stages AS (SELECT run_id, stage_key, stage_order, family, min(seq) AS started, max(seq) AS last, arg_max(status, seq) AS status FROM stage_events GROUP BY ALL)"
_BAD = "status IN ('failed', 'cancelled', 'interrupted')"
_ERRORS = "CASE " + " ".join(f"WHEN regexp_matches(lower(message), '{p}') THEN '{n}'" for n, p in rules.PROVIDER_ERRORS) + " ELSE 'unknown' END"

QUERIES = {
    "blind_export": (blind_export, f"WITH {td.AUDIT_BASE} SELECT task_id, ord, CASE WHEN excluded THEN verdict END AS verdict, CASE WHEN excluded THEN rationale END AS rationale, CASE WHEN excluded THEN quality END AS quality, excluded, exclude_reason, mode FROM base"),
    "diff_full_outer": (diff_full_outer, f"{_DIFF} SELECT * FROM d"),
    "diff_summary": (diff_summary, f"{_DIFF} SELECT " + ", ".join(f"count(*) FILTER (WHERE {c}) AS {c}" for c in ("verdict_changed", "rationale_changed", "quality_changed", "exclusion_changed", "missing_in_base", "missing_in_candidate")) + " FROM d"),
    "candidate_rank": (
        candidate_rank,
        f"""WITH {td.AUDIT_BASE}, {td.audit_candidate_sql('c0', 0)}, {td.audit_candidate_sql('c1', 1)}, {td.audit_candidate_sql('c2', 2)}, c AS (SELECT 'c0' AS label, task_id, verdict FROM c0 UNION ALL SELECT 'c1', task_id, verdict FROM c1 UNION ALL SELECT 'c2', task_id, verdict FROM c2),
        j AS (SELECT l.label, b.task_id, b.verdict AS bv, c.verdict AS cv, c.task_id IS NULL AS gone FROM base b CROSS JOIN (SELECT unnest(['c0', 'c1', 'c2']) AS label) l LEFT JOIN c ON c.label = l.label AND c.task_id = b.task_id WHERE NOT b.excluded AND b.verdict IS NOT NULL),
        s AS (SELECT label, count(*) AS active, count(*) FILTER (WHERE coalesce(cv = bv, false)) AS exact, count(*) FILTER (WHERE coalesce({_ADJ.format('cv', 'bv')}, false)) AS adjacent, count(*) FILTER (WHERE NOT coalesce(cv = bv, false)) AS changes, count(*) FILTER (WHERE gone) AS missing FROM j GROUP BY label)
        SELECT label, active, exact, adjacent, changes, missing, round(exact / active, 6) AS exact_rate, (row_number() OVER (ORDER BY exact / active DESC, adjacent / active DESC, changes, label))::INT AS place FROM s""",
    ),
    "apply_deltas": (
        apply_deltas,
        f"""WITH {td.AUDIT_BASE} SELECT task_id, CASE WHEN hit THEN 'not_supported' ELSE verdict END AS verdict, CASE WHEN hit AND task_id % 4 = 1 THEN 'checked' ELSE rationale END AS rationale, quality,
        CASE WHEN hit AND task_id % 10 = 1 THEN true ELSE excluded END AS excluded, CASE WHEN hit AND task_id % 10 = 1 THEN 'off topic' ELSE exclude_reason END AS exclude_reason, hit AS touched FROM (SELECT *, task_id % 6 = 1 AND NOT excluded AS hit FROM base)""",
    ),
    "agreement_by_mode": (
        agreement_by_mode,
        f"""WITH {_PAIR}, j AS (SELECT b.mode, b.verdict AS h, c.verdict AS m FROM base b JOIN cand c USING (task_id) WHERE NOT b.excluded AND b.verdict IS NOT NULL AND c.verdict IS NOT NULL)
        SELECT coalesce(mode, 'all') AS mode, count(*) AS n, count(*) FILTER (WHERE h = m) AS exact, count(*) FILTER (WHERE {_ADJ.format('h', 'm')}) AS adjacent, round(count(*) FILTER (WHERE h = m) / count(*), 6) AS exact_rate FROM j GROUP BY ROLLUP (mode)""",
    ),
    "verdict_pivot": (verdict_pivot, f"WITH {td.AUDIT_BASE} SELECT mode, " + ", ".join(f"count(*) FILTER (WHERE verdict = '{v}') AS {v}" for v in rules.VERDICTS) + " FROM base WHERE NOT excluded AND verdict IS NOT NULL GROUP BY mode"),
    "cost_estimate": (cost_estimate, f"WITH {_COSTED} SELECT event_id, model, round(micro, 3)::DOUBLE AS micro_usd FROM costed"),
    "ledger_by_purpose": (ledger_by_purpose, f"WITH {_COSTED} SELECT coalesce(purpose, 'total') AS purpose, {_SUMS} FROM costed GROUP BY ROLLUP (purpose)"),
    "ledger_by_stage": (ledger_by_stage, f"WITH {_COSTED} SELECT coalesce(stage, 'unknown') AS stage, coalesce(family, 0) AS family, {_SUMS} FROM costed GROUP BY 1, 2"),
    "stage_upsert": (stage_upsert, f"WITH {_STAGES} SELECT run_id, stage_key, family, started, last, status FROM stages"),
    "stage_stale_cascade": (
        stage_stale_cascade,
        f"WITH {_STAGES}, ch AS (SELECT run_id, family, min(stage_order) FILTER (WHERE status = 'failed') AS f FROM stages GROUP BY ALL) SELECT run_id, stage_key, family, CASE WHEN coalesce(stage_order > f AND status = 'succeeded', false) THEN 'stale' ELSE status END AS status FROM stages JOIN ch USING (run_id, family)",
    ),
    "stage_aggregate_status": (
        stage_aggregate_status,
        f"""WITH {_STAGES} SELECT run_id, stage_key, count(*) AS members, CASE WHEN bool_or(status = 'running') THEN 'running' WHEN bool_or({_BAD}) THEN arg_min(status, family) FILTER (WHERE {_BAD}) WHEN bool_and(status = 'succeeded') THEN 'succeeded'
        WHEN bool_or(status = 'stale') THEN 'stale' WHEN bool_or(status = 'blocked') THEN 'blocked' ELSE arg_min(status, family) END AS status FROM stages GROUP BY run_id, stage_key""",
    ),
    "can_run_from": (can_run_from, f"WITH {_STAGES} SELECT run_id, stage_key, family, coalesce(bool_and(status = 'succeeded') OVER (PARTITION BY run_id, family ORDER BY stage_order ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), true) AS can_run FROM stages"),
    "purge_old": (purge_old, "SELECT event_type, count(*) AS n FROM events WHERE ts >= (SELECT max(ts) FROM events) - INTERVAL 5 DAYS GROUP BY event_type"),
    "cache_antijoin": (cache_antijoin, "SELECT DISTINCT sha256(text) AS key FROM documents WHERE sha256(text) NOT IN (SELECT sha256(text) FROM documents WHERE doc_id % 3 = 0)"),
    "error_class": (error_class, f"WITH m AS (SELECT {td._sql_list(_MESSAGES)}[(event_id % 8 + 1)::INT] AS message FROM events) SELECT message, {_ERRORS} AS class, {_ERRORS} IN ('billing_or_quota', 'authentication', 'authorization') AS fatal, count(*) AS n FROM m GROUP BY ALL"),
}
