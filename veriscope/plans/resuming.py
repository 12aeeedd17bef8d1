"""Queries on what goes in rounds or over several runs: resumed runs, fetching, resolving, reuse, caches, lineage, sampling."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import adaptive, frontier, graph, incremental, ledger, lineage, papercache, resolve
from ..sources import commits
from ..sources import testdata as td
from ..streaming import telemetry
from . import orchestrate, stages
from .comparing import _COSTED, _STAGES, _stages
from .judging import _AGG, _ESCALATION, _NEAR
from .screening import QUERIES as _SCREENING

# ---- relations in SQL that both engines read; {documents} is the table

_PLACES = """SELECT doc_id AS paper_id, 0 AS phase, 20 AS priority, CAST(1 AS BIGINT) AS ord, 'pmc_xml' AS kind, concat('pmc/', doc_id) AS url FROM {documents} WHERE doc_id % 3 = 0
  UNION ALL SELECT doc_id, 0, 70, 2, 'pdf', concat('pdf/', doc_id) FROM {documents} WHERE doc_id % 4 <> 0
  UNION ALL SELECT doc_id, 0, 60, 3, 'page', concat('page/', doc_id) FROM {documents} WHERE doc_id % 5 < 3
  UNION ALL SELECT doc_id, 1, 110, 4, 'page', concat('proxy/page/', doc_id) FROM {documents} WHERE doc_id % 5 < 3
  UNION ALL SELECT doc_id, 1, 120, 5, 'pdf', concat('proxy/pdf/', doc_id) FROM {documents} WHERE doc_id % 4 <> 0
  UNION ALL SELECT doc_id, 1, 115, 6, 'page', concat('proxy/doi/', doc_id) FROM {documents} WHERE doc_id % 6 <> 5"""
_ANSWERS = """SELECT concat('pmc/', doc_id) AS url, CASE WHEN n_chars % 2 = 0 THEN 200 ELSE 404 END AS status, 'xml' AS body, CAST(NULL AS VARCHAR(9)) AS error FROM {documents}
  UNION ALL SELECT concat('pdf/', doc_id), CASE WHEN n_chars % 7 = 0 THEN 200 ELSE 403 END, 'pdf', NULL FROM {documents} WHERE n_chars % 7 <> 1
  UNION ALL SELECT concat('page/', doc_id), CASE WHEN n_chars % 8 < 6 THEN 200 ELSE 500 END, CASE WHEN n_chars % 8 = 5 THEN 'pdf' ELSE 'html' END, CASE WHEN n_chars % 8 = 7 THEN 'bad gate' END FROM {documents}
  UNION ALL SELECT concat('xml/', doc_id), 200, CASE WHEN n_chars % 10 = 0 THEN 'xml' ELSE 'html' END, NULL FROM {documents}
  UNION ALL SELECT concat('link/', doc_id), CASE WHEN n_chars % 9 = 0 THEN 200 ELSE 404 END, 'pdf', NULL FROM {documents}
  UNION ALL SELECT concat('proxy/page/', doc_id), 200, 'html', NULL FROM {documents}
  UNION ALL SELECT concat('proxy/pdf/', doc_id), CASE WHEN n_chars % 11 = 0 THEN 200 ELSE 403 END, 'pdf', NULL FROM {documents}
  UNION ALL SELECT concat('proxy/doi/', doc_id), 200, 'html', NULL FROM {documents}
  UNION ALL SELECT concat('pxml/', doc_id), 200, CASE WHEN n_chars % 4 = 1 THEN 'xml' ELSE 'json' END, NULL FROM {documents}"""
_LINKS = """SELECT concat('page/', doc_id) AS url, CAST(0 AS BIGINT) AS pos, 'xml' AS kind, concat('xml/', doc_id) AS link FROM {documents} WHERE n_chars % 2 = 1
  UNION ALL SELECT concat('page/', doc_id), 1, 'pdf', concat('link/', doc_id) FROM {documents} WHERE n_chars % 3 = 0
  UNION ALL SELECT concat('proxy/page/', doc_id), 0, 'xml', concat('pxml/', doc_id) FROM {documents} WHERE n_chars % 5 = 1
  UNION ALL SELECT concat('proxy/page/', doc_id), 1, 'pdf', concat('link/', doc_id) FROM {documents} WHERE n_chars % 3 < 2
  UNION ALL SELECT concat('proxy/doi/', doc_id), 0, 'xml', concat('pxml/', doc_id) FROM {documents} WHERE n_chars % 13 < 6"""
_WANTED = "SELECT doc_id AS want, CASE WHEN doc_id % 3 = 0 THEN concat('d', doc_id) END AS doi, CASE WHEN doc_id % 4 = 1 THEN concat('p', doc_id) END AS pmid, CASE WHEN doc_id % 5 = 2 THEN concat('c', doc_id) WHEN doc_id % 5 = 3 THEN '' END AS pmcid FROM {documents}"
_ALPHA = """SELECT 'doi' AS by, concat('d', doc_id) AS key, doc_id AS paper_id, CAST(NULL AS VARCHAR(9)) AS error FROM {documents} WHERE n_chars % 3 = 0
  UNION ALL SELECT 'pmid', concat('p', doc_id), CASE WHEN n_chars % 4 = 0 THEN doc_id END, CASE WHEN n_chars % 4 = 1 THEN 'HTTP 500' END FROM {documents}
  UNION ALL SELECT 'pmcid', concat('c', doc_id), doc_id, NULL FROM {documents} WHERE n_chars % 5 = 0"""
_BETA = """SELECT 'doi' AS by, concat('d', doc_id) AS key, CASE WHEN n_chars % 5 < 2 THEN doc_id + 1000000 END AS paper_id, CASE WHEN n_chars % 5 = 2 THEN 'HTTP 429' END AS error FROM {documents} WHERE n_chars % 7 < 5
  UNION ALL SELECT 'pmid', concat('p', doc_id), doc_id + 1000000, NULL FROM {documents} WHERE n_chars % 3 = 1
  UNION ALL SELECT 'pmcid', concat('c', doc_id), doc_id + 1000000, NULL FROM {documents} WHERE n_chars % 2 = 1"""
_MADE = """SELECT doc_id AS artifact, CAST(floor(doc_id / 2) AS BIGINT) AS source, concat('v', n_chars % 40) AS sha256 FROM {documents} WHERE doc_id > 0
  UNION ALL SELECT doc_id, CAST(floor(doc_id / 3) AS BIGINT), concat('v', n_chars % 40) FROM {documents} WHERE doc_id > 2 AND doc_id % 2 = 0"""


def _sql(spark, sf, text):
    return spark.sql(text, documents=td.read(spark, sf, "documents"))


def _duck(text):
    return text.format(documents="documents")


# ---- resumed runs


def _steps(spark, sf):
    config = stages.Config()
    return [
        orchestrate.Step("discover", (), lambda f: graph.probe_selection(td.edges(spark, sf), config.probe_budget)),
        orchestrate.Step("screen", (), lambda f: stages.screen(td.edges(spark, sf), config)),
        orchestrate.Step("extract", ("screen",), lambda f: stages.extract(td.mentions(spark, sf), f["screen"])[0]),
        orchestrate.Step("classify", ("extract",), lambda f: f["extract"].groupBy("citing", "cited").agg(F.count("*").alias("n_mentions"), F.count_if(F.col("confidence") == "high").alias("n_sure"))),
    ]


def resumed_run(spark, sf):
    """States of a run that stopped after extraction, lost its driver in classification and was taken up again: what each stage holds and how often it began."""
    root, steps = commits.work_folder(spark, "runs"), _steps(spark, sf)
    orchestrate.run(spark, root, "r1", steps, stop_after="extract")
    orchestrate.Tracker(spark, root, "r1").start("classify")  # and then the driver was gone
    orchestrate.run(spark, root, "r1", steps)
    log = commits.read(spark, root, "states", orchestrate._STATE).where("stage_key <> ''")
    begun = log.groupBy("stage_key").agg(F.count_if(F.col("status") == "running").alias("begun"))
    return orchestrate.states(spark, root).where("stage_key <> ''").join(begun, "stage_key").select("stage_key", "status", "n_rows", "begun")


_LIVE = f"SELECT seed FROM ({_SCREENING['screen_decision'][1]}) WHERE decision = 'greenlight'"
_RESUMED = f"""WITH {td.MENTIONS}, kept AS (SELECT * FROM mentions WHERE cited IN ({_LIVE}) QUALIFY row_number() OVER (PARTITION BY citing, cited, coalesce(ref_id, 'no-ref'), left(context, 200), coalesce("at"::VARCHAR, 'no-offset') ORDER BY ord) = 1)
  SELECT 'discover' AS stage_key, 'succeeded' AS status, count(*) AS n_rows, 1 AS begun FROM ({_SCREENING['probe_selection'][1]}) UNION ALL SELECT 'screen', 'succeeded', count(*), 1 FROM ({_SCREENING['screen_decision'][1]})
  UNION ALL SELECT 'extract', 'succeeded', count(*), 1 FROM kept UNION ALL SELECT 'classify', 'succeeded', count(DISTINCT (citing, cited)), 2 FROM kept"""


# ---- fetching and resolving


def fetch_attempts(spark, sf):
    return frontier.search(_sql(spark, sf, _PLACES), _sql(spark, sf, _ANSWERS), _sql(spark, sf, _LINKS))


def fetch_winners(spark, sf):
    return frontier.acquired(td.read(spark, sf, "documents").select(F.col("doc_id").alias("paper_id")), fetch_attempts(spark, sf))


_TRIED = f"""places AS ({_duck(_PLACES)}), answers AS ({_duck(_ANSWERS)}), links AS ({_duck(_LINKS)}),
  spread AS (SELECT *, 0 AS sub FROM places UNION ALL SELECT p.paper_id, p.phase, greatest(p.priority, CASE WHEN l.kind = 'xml' THEN 65 ELSE 80 END), 1000000 * p.priority + 10 * p.ord + l.pos, 'page_' || l.kind, l.link, CASE WHEN l.kind = 'xml' THEN 65 ELSE 80 END
    FROM places p JOIN answers a ON a.url = p.url AND a.status < 400 AND a.body = 'html' JOIN links l ON l.url = p.url WHERE p.kind = 'page'),
  once AS (SELECT * FROM spread QUALIFY row_number() OVER (PARTITION BY paper_id, kind, url ORDER BY phase, CASE WHEN kind LIKE 'page_%' THEN ord ELSE priority END, ord) = 1),
  fate AS (SELECT o.*, a.error, CASE WHEN a.url IS NULL THEN 'network_error' WHEN a.status >= 400 THEN 'http_error'
      WHEN a.body <> CASE WHEN kind = 'page' THEN 'html' WHEN kind LIKE '%pdf' THEN 'pdf' ELSE 'xml' END THEN 'wrong_body' WHEN kind <> 'page' THEN 'selected' WHEN o.url IN (SELECT url FROM links) THEN 'links' ELSE 'no_links' END AS outcome
    FROM once o LEFT JOIN answers a ON a.url = o.url),
  ranked AS (SELECT *, (row_number() OVER w - 1)::INT AS attempt, coalesce(sum((outcome = 'selected')::INT) OVER (w ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM fate WINDOW w AS (PARTITION BY paper_id ORDER BY phase, priority, sub, ord)),
  log AS (SELECT paper_id, attempt, phase, kind, url, outcome, CASE WHEN outcome NOT IN ('selected', 'links') THEN coalesce(error, outcome || ' ' || url) END AS failure FROM ranked WHERE before = 0)"""
_WINNERS = f"""WITH {_TRIED}, g AS (SELECT paper_id, count(*) AS attempts, bool_or(outcome = 'selected') AS ok, max(kind) FILTER (WHERE outcome = 'selected') AS kind, max(url) FILTER (WHERE outcome = 'selected') AS url, max(phase) FILTER (WHERE outcome = 'selected') AS phase,
    arg_max(failure, attempt) FILTER (WHERE failure IS NOT NULL AND phase = 0) AS last FROM log GROUP BY 1)
  SELECT doc_id AS paper_id, coalesce(ok, false) AS ok, kind, url, CASE WHEN ok THEN CASE WHEN phase = 0 THEN 'open_access' ELSE 'institutional_proxy' END END AS channel, CASE WHEN ok THEN CASE WHEN kind LIKE '%pdf' THEN 'grobid_tei_xml' ELSE 'jats_xml' END END AS format,
    coalesce(attempts, 0) AS attempts, CASE WHEN NOT coalesce(ok, false) THEN coalesce(last, '{frontier.NOTHING_TO_TRY}') END AS failure FROM documents LEFT JOIN g ON g.paper_id = doc_id"""


def _resolved(spark, sf):
    papers = td.papers(spark, sf)
    wanted = _sql(spark, sf, _WANTED).join(papers.select(F.col("paper_id").alias("want"), "title", "authors", F.when(F.col("paper_id") % 6 != 0, F.col("year")).alias("year")), "want")
    held = {"alpha": papers.where("paper_id % 2 = 0"), "beta": papers.where("paper_id % 5 <> 1")}
    sources = {"alpha": _sql(spark, sf, _ALPHA), "beta": _sql(spark, sf, _BETA)}
    return resolve.resolve(wanted, sources, held)


def resolved_papers(spark, sf):
    return _resolved(spark, sf).withColumn("asked", F.array_join("asked", ",")).withColumn("paper_id", F.col("paper_id").cast("string"))


def cited_sources(spark, sf):
    d = td.read(spark, sf, "documents")
    known = d.select(F.col("doc_id").alias("paper_id"), "n_chars").unionByName(d.select((F.col("doc_id") + 1_000_000).alias("paper_id"), "n_chars"))
    papers = known.select("paper_id", td._pick(td.AVAILABILITY, F.col("n_chars") % 4).alias("availability"), F.when(F.col("n_chars") % 3 == 0, "embargo").alias("reason"))
    parsed = known.where("n_chars % 6 <> 0").select("paper_id", (F.col("n_chars") % 5 != 0).alias("ok"), F.when(F.col("n_chars") % 2 == 0, "jats_xml").otherwise("grobid_tei_xml").alias("format"), F.when(F.col("n_chars") % 5 == 0, "no body").alias("error"))
    out = resolve.cited_sources(d.select(F.col("doc_id").alias("want"), (F.col("doc_id") % 11 != 4).alias("located")), _resolved(spark, sf), papers, parsed)
    return out.withColumn("paper_id", F.col("paper_id").cast("string"))


def _by_key(by, letter):
    one = lambda source: f"(SELECT paper_id FROM {source} s WHERE s.by = '{by}' AND s.key = w.{by})"
    why = lambda source: f"coalesce((SELECT error FROM {source} s WHERE s.by = '{by}' AND s.key = w.{by}), '{source}: no answer for {by} ' || w.{by})"
    return f"CASE WHEN w.{by} <> '' THEN {one('alpha')} END AS a_{letter}, CASE WHEN w.{by} <> '' THEN {one('beta')} END AS b_{letter}, {why('beta')} AS e_{letter}"


_TITLES = "trim(regexp_replace(regexp_replace(lower({0}), '[^\\p{{L}}\\p{{N}}\\s]', '', 'g'), '\\s+', ' ', 'g'))"
_NAMES = "list_transform({0}, lambda v: lower(string_split(v, ' ')[-1]))"


def _fits(name, where):
    return f"""{name}_m AS (SELECT want, count(*) AS n, min(x.paper_id) AS paper_id FROM open o JOIN t x ON x.t = o.t AND o.t <> '' AND {where} AND coalesce(abs(o.year - x.year) <= 1, true) AND list_has_any(o.names, x.names) GROUP BY 1)"""


_RESOLVED = f"""wanted AS ({_duck(_WANTED)}), alpha AS ({_duck(_ALPHA)}), beta AS ({_duck(_BETA)}), {td.PAPERS},
  t AS (SELECT paper_id, {_TITLES.format('title')} AS t, year, {_NAMES.format('authors')} AS names FROM papers),
  k AS (SELECT w.*, {_by_key('doi', 'd')}, {_by_key('pmid', 'p')}, {_by_key('pmcid', 'c')} FROM wanted w),
  open AS (SELECT k.want, t.t, CASE WHEN k.want % 6 <> 0 THEN t.year END AS year, t.names FROM k JOIN t ON t.paper_id = k.want WHERE k.doi IS NULL),
  {_fits('am', 'x.paper_id % 2 = 0')}, {_fits('bm', 'x.paper_id % 5 <> 1')},
  r AS (SELECT k.*, am_m.n AS an, am_m.paper_id AS am, bm_m.n AS bn, bm_m.paper_id AS bm FROM k LEFT JOIN am_m USING (want) LEFT JOIN bm_m USING (want)),
  s AS (SELECT want, e_d, an, bn, CASE WHEN a_d IS NOT NULL THEN 'alpha:doi' WHEN doi IS NOT NULL THEN 'beta:doi' WHEN a_p IS NOT NULL THEN 'alpha:pmid' WHEN b_p IS NOT NULL THEN 'beta:pmid' WHEN a_c IS NOT NULL THEN 'alpha:pmcid' WHEN b_c IS NOT NULL THEN 'beta:pmcid' WHEN an = 1 THEN 'alpha:metadata' ELSE 'beta:metadata' END AS step,
    list_filter([CASE WHEN doi <> '' THEN 'alpha:doi' END, CASE WHEN doi <> '' THEN 'beta:doi' END, CASE WHEN doi IS NULL AND pmid <> '' THEN 'alpha:pmid' END, CASE WHEN doi IS NULL AND pmid <> '' THEN 'beta:pmid' END, CASE WHEN doi IS NULL AND pmcid <> '' THEN 'alpha:pmcid' END, CASE WHEN doi IS NULL AND pmcid <> '' THEN 'beta:pmcid' END,
      CASE WHEN doi IS NULL THEN 'alpha:metadata' END, CASE WHEN doi IS NULL THEN 'beta:metadata' END], lambda x: x IS NOT NULL) AS steps,
    CASE WHEN doi IS NOT NULL THEN coalesce(a_d, b_d) ELSE coalesce(a_p, b_p, a_c, b_c, CASE WHEN an = 1 THEN am WHEN bn = 1 THEN bm END) END AS paper_id FROM r),
  resolved AS (SELECT want, paper_id, step, CASE WHEN paper_id IS NULL THEN CASE step WHEN 'beta:doi' THEN e_d ELSE CASE WHEN bn > 1 THEN 'beta: ' || bn || ' papers fit' ELSE 'beta: no paper fits' END END END AS error,
    array_to_string(steps[1:list_position(steps, step)], ',') AS asked FROM s)"""
_CITED = f"""WITH {_RESOLVED}, known AS (SELECT doc_id AS paper_id, n_chars FROM documents UNION ALL SELECT doc_id + 1000000, n_chars FROM documents),
  j AS (SELECT w.doc_id AS want, w.doc_id % 11 <> 4 AS located, r.paper_id, r.error, k.n_chars % 4 < 2 AS open, k.n_chars % 4 = 2 AS short, CASE WHEN k.n_chars % 3 = 0 THEN 'embargo' END AS reason, coalesce(k.n_chars % 6 <> 0 AND k.n_chars % 5 <> 0, false) AS ok,
    CASE WHEN k.n_chars % 2 = 0 THEN 'jats_xml' ELSE 'grobid_tei_xml' END AS format, CASE WHEN k.n_chars % 6 <> 0 THEN 'no body' ELSE 'no parsed text' END AS failed FROM documents w LEFT JOIN resolved r ON r.want = w.doc_id LEFT JOIN known k ON k.paper_id = r.paper_id),
  l AS (SELECT *, located AND paper_id IS NOT NULL AS live FROM j)
  SELECT want, CASE WHEN live THEN 'resolved' ELSE 'resolution_failed' END AS resolution_status, CASE WHEN NOT located THEN '{resolve.NO_LOCATOR}' WHEN NOT live THEN error END AS resolution_error, CASE WHEN located THEN paper_id::VARCHAR END AS paper_id,
    CASE WHEN NOT live THEN 'not_attempted' WHEN NOT open THEN 'no_fulltext' WHEN NOT ok THEN 'fetch_failed' ELSE 'retrieved' END AS fetch_status,
    CASE WHEN NOT live THEN NULL WHEN NOT open THEN CASE WHEN short THEN '{resolve.ABSTRACT_ONLY}' ELSE coalesce(reason, '{resolve.NO_FULL_TEXT}') END WHEN NOT ok THEN failed END AS fetch_error, CASE WHEN live AND open AND ok THEN format END AS format FROM l"""


# ---- reuse, caches, lineage


def family_reuse(spark, sf):
    """Metrics of families after some of their edges changed: only changed families are computed, equal ones share."""
    root = commits.work_folder(spark, "families")
    columns = ["seed", "citing", "copies", "status", "paper_type", "title", "refs"]
    edges = td.edges(spark, sf).select(*columns)

    def compute(rows):
        m = graph.screen_metrics(rows)
        return m.select("seed", "unique_edges", F.round("auditable_coverage", 6).alias("coverage"))

    schema = "unique_edges bigint, coverage double"
    incremental.recompute(spark, root, "metrics", edges, "seed", compute, schema, "1")
    changed = edges.withColumn("status", F.when(F.col("seed") % 10 == 3, "not_auditable").otherwise(F.col("status")))
    results, marks = incremental.recompute(spark, root, "metrics", changed, "seed", compute, schema, "1")
    return results.join(marks.select("seed", "state"), "seed")


# a group's content without its key, as a sorted list of rows: what fingerprints stand for
_REUSE = f"""WITH {td.EDGES}, e AS (SELECT seed, citing, copies, status, paper_type, title, refs, CASE WHEN seed % 10 = 3 THEN 'not_auditable' ELSE status END AS status2 FROM edges),
  a AS (SELECT seed, list(row(citing, copies, status, paper_type, title, refs) ORDER BY citing, copies, status, paper_type, title, refs) AS c FROM e GROUP BY 1),
  b AS (SELECT seed, list(row(citing, copies, status2, paper_type, title, refs) ORDER BY citing, copies, status2, paper_type, title, refs) AS c, count(*) AS unique_edges, round(count(*) FILTER (WHERE status2 IN ('auditable_structured', 'auditable_pdf')) / count(*), 6) AS coverage FROM e GROUP BY 1),
  f AS (SELECT c, min(seed) AS first FROM b WHERE c NOT IN (SELECT c FROM a) GROUP BY 1)
  SELECT b.seed, unique_edges, coverage, CASE WHEN f.first IS NULL THEN 'reused' WHEN f.first = b.seed THEN 'computed' ELSE 'shared' END AS state FROM b LEFT JOIN f ON f.c = b.c"""

_NOW = "TIMESTAMP '2024-01-10 00:00:00'"


def parse_cache_hits(spark, sf):
    """Lookups in a cache after several writers, a compaction, tombstones and an eviction by age."""
    cache = papercache.PaperCache(spark, commits.work_folder(spark, "papers"))
    d, k = td.read(spark, sf, "documents"), F.col("doc_id")
    row = lambda version, kind, hash_, day: d.select(k.alias("paper_id"), F.lit(version).alias("parser_version"), kind.alias("parser_kind"), hash_.alias("content_hash"), F.concat(F.lit(version), F.lit(":"), "lang").alias("parsed"), F.expr(f"TIMESTAMP '2024-01-{day} 00:00:00'").alias("parsed_at"))
    format_ = F.when(k % 2 == 0, "jats_xml").otherwise("grobid_tei_xml")
    own, other = F.sha2("text", 256), F.sha2(F.concat("text", F.lit("!")), 256)
    cache.put("parsed", row("1", papercache.parser_kind(format_), own, "01").where(F.col("paper_id") % 3 < 2))
    cache.put("parsed", row("2", papercache.parser_kind(format_), F.when(k % 7 == 0, other).otherwise(own), "05").where(F.col("paper_id") % 4 < 3))
    cache.compact("parsed")
    cache.put("parsed", row("2", F.lit("legacy_pdf_text"), own, "08").where(F.col("paper_id") % 9 == 4))
    cache.evict("parsed", d.where(k % 11 == 6).select(k.alias("paper_id")))
    cache.evict_older("parsed", F.expr(f"{_NOW} - INTERVAL 7 DAYS"))
    wanted = d.select(k.alias("paper_id"), format_.alias("format"), own.alias("content_hash"))
    return cache.lookup(wanted, "2").select("paper_id", "state", "parsed")


_HITS = """WITH d AS (SELECT doc_id AS k, lang, doc_id % 4 < 3 AS two, doc_id % 9 = 4 AS three, doc_id % 11 = 6 AS gone FROM documents)
  SELECT k AS paper_id, CASE WHEN gone OR NOT (two OR three) THEN 'absent' WHEN three THEN 'kind' WHEN k % 7 = 0 THEN 'hash' ELSE 'hit' END AS state, CASE WHEN NOT gone AND two AND NOT three AND k % 7 <> 0 THEN '2:' || lang END AS parsed FROM d"""


def stale_lineage(spark, sf):
    made = _sql(spark, sf, _MADE)
    d = td.read(spark, sf, "documents")
    # the checksum of a source as its makers saw it differs from today's for some
    seen = made.join(d.select(F.col("doc_id").alias("source"), F.concat(F.lit("s"), "doc_id").alias("now")), "source").select("artifact", "source", F.when((F.col("artifact") * 7 + F.col("source")) % 61 == 5, F.lit("old")).otherwise(F.col("now")).alias("sha256"))
    current = d.where("doc_id % 83 <> 17").select(F.col("doc_id").alias("artifact"), F.concat(F.lit("s"), "doc_id").alias("sha256"))
    return lineage.stale_artifacts(seen, current).select("artifact", "state", F.concat_ws(" from ", F.col("depth").cast("string"), F.col("cause").cast("string")).alias("path"))


_LINEAGE = f"""WITH RECURSIVE m AS ({_duck(_MADE)}), e AS (SELECT DISTINCT artifact, source FROM m), bad AS (SELECT artifact, min(source) AS cause FROM e WHERE (artifact * 7 + source) % 61 = 5 OR source % 83 = 17 GROUP BY 1),
  r(artifact, depth, cause) AS (SELECT artifact, 1, cause FROM bad UNION SELECT e.artifact, r.depth + 1, r.cause FROM r JOIN e ON e.source = r.artifact),
  n AS (SELECT artifact, min(depth) AS depth FROM r GROUP BY 1), c AS (SELECT artifact, depth, min(cause) AS cause FROM r JOIN n USING (artifact, depth) GROUP BY 1, 2)
  SELECT a.artifact, CASE WHEN c.depth IS NULL THEN 'holds' ELSE 'stale' END AS state, coalesce(c.depth || ' from ' || c.cause, '') AS path FROM (SELECT DISTINCT artifact FROM e) a LEFT JOIN c ON c.artifact = a.artifact"""


def stale_pointers(spark, sf):
    s = _stages(spark, sf).withColumn("output_path", F.concat(F.lit("out/"), "stage_key")).withColumn("input_path", F.concat(F.lit("in/"), "stage_key"))
    changed = s.groupBy("run_id", "family").agg(F.min(F.when(F.col("status") == "failed", F.col("stage_order"))).alias("from_order"))
    return ledger.mark_stale(s, changed, ("output_path",), ("input_path",)).select("run_id", "stage_key", "family", "status", "output_path", "input_path")


# ---- sampling in rounds


def adaptive_draws(spark, sf):
    samples = td.vector_samples(spark, sf)
    _, rounds = adaptive.adaptive_samples(samples.select("record_id").distinct(), adaptive.replayed(samples), 2, 6, 2)
    return rounds.select("record_id", "n", "rounds", "state", F.array_join("first_reasons", ",").alias("first_reasons"), F.array_join("reasons", ",").alias("reasons"))


def vector_first(spark, sf):
    samples = td.vector_samples(spark, sf)

    def judge(asked):
        k = F.col("record_id")
        return asked.where(k % 7 != 2).select("record_id", F.when(k % 5 != 1, td._pick(td.VERDICTS, k % 5)).alias("verdict"), F.when(k % 5 == 1, "HTTP 529").alias("error"))

    records = samples.select("record_id").distinct()
    out = adaptive.vector_first(records, adaptive.replayed(samples.where("record_id % 13 <> 4")), judge, 3, 8)
    return out.withColumn("adaptive", F.array_join("adaptive", ",")).withColumn("escalation", F.array_join("escalation", ","))


def _prefixes(sizes, where="true"):
    """Aggregates of the first samples of each record, for each size; the record's number is then 10 * record_id + size."""
    return _AGG.replace("FROM samples GROUP BY record_id", f"FROM (SELECT s.* REPLACE (10 * s.record_id + p.p AS record_id) FROM samples s JOIN (SELECT unnest({list(sizes)}) AS p) p ON s.sample < p.p WHERE {where}) GROUP BY record_id") + f""",
  told AS (SELECT record_id // 10 AS record_id, record_id % 10 AS p, axis_verdict, array_to_string({_ESCALATION}, ',') AS escalation,
    concat_ws(',', CASE WHEN axis_verdict = 'cannot_determine' THEN 'axis_verdict_cannot_determine' END, CASE WHEN unsure >= 0.55 THEN 'uncertainty_borderline' END, CASE WHEN {_NEAR} THEN 'core_axis_borderline' END,
    CASE WHEN modal_verdict <> axis_verdict THEN 'sampled_verdict_disagrees_with_axis' END, CASE WHEN bundled AND (modal_verdict <> axis_verdict OR overall_uncertainty >= 0.55) THEN 'bundled_citation_scope_ambiguous' END) AS reasons FROM agg),
  ends AS (SELECT record_id, coalesce(min(p) FILTER (WHERE reasons = ''), {max(sizes)}) AS n, arg_min(reasons, p) AS first_reasons FROM told GROUP BY 1)"""


_DRAWS = f"""WITH {_prefixes((2, 4, 6))} SELECT e.record_id, n::BIGINT AS n, (n // 2)::INT AS rounds, CASE WHEN reasons = '' THEN 'decided' ELSE 'exhausted' END AS state, first_reasons, reasons FROM ends e JOIN told t ON t.record_id = e.record_id AND t.p = e.n"""
_VECTOR_FIRST = f"""WITH {_prefixes((3, 8), "s.record_id % 13 <> 4")}, j AS (SELECT v.vec_id AS record_id, coalesce(n, 0)::BIGINT AS n, CASE WHEN coalesce(n, 3) = 3 THEN 1 ELSE 2 END AS rounds, coalesce(first_reasons, '') AS adaptive, coalesce(t.escalation, '{adaptive.NO_VECTOR}') AS escalation, axis_verdict
    FROM embeddings v LEFT JOIN ends e ON e.record_id = v.vec_id LEFT JOIN told t ON t.record_id = e.record_id AND t.p = e.n),
  k AS (SELECT *, CASE WHEN escalation <> '' AND record_id % 7 <> 2 AND record_id % 5 <> 1 THEN {td._sql_list(td.VERDICTS)}[(record_id % 5 + 1)::INT] END AS judged FROM j)
  SELECT record_id, coalesce(judged, axis_verdict, 'cannot_determine') AS verdict, CASE WHEN judged IS NOT NULL THEN 'categorical' WHEN axis_verdict IS NOT NULL THEN 'axis' ELSE 'none' END AS source, n, rounds, adaptive, escalation,
    CASE WHEN escalation <> '' AND judged IS NULL THEN CASE WHEN record_id % 7 <> 2 THEN 'HTTP 529' ELSE 'the judge gave no answer' END END AS error FROM k"""

# ---- telemetry


def _calls(spark, sf):
    """Model calls at the events' times, some told twice."""
    c = ledger.priced(td.calls(spark, sf), td.prices(spark))
    e = td.read(spark, sf, "events").select("event_id", F.col("ts").alias("at"), F.col("user_id").alias("run_id"))
    c = c.join(e, "event_id").select("event_id", "run_id", "stage", "purpose", "model", "at", "successful", "input_tokens", "output_tokens", ((F.col("event_id") * 37) % 1000).alias("latency_ms"), "micro_usd")
    return c.unionByName(c.where("event_id % 7 = 0"))


def call_windows(spark, sf):
    w = telemetry.windows(_calls(spark, sf), "6 hours")
    return w.withColumn("start", F.date_format("start", "yyyy-MM-dd HH:mm")).withColumn("stage", F.coalesce("stage", F.lit("unknown"))).withColumn("micro_usd", F.round("micro_usd", 3).cast("double"))


def call_telemetry(spark, sf):
    return telemetry.telemetry(_calls(spark, sf), ("model", "purpose")).withColumn("micro_usd", F.round("micro_usd", 3).cast("double"))


_CALLED = f"""{_COSTED}, c AS (SELECT costed.*, ts, (event_id * 37) % 1000 AS latency_ms FROM costed JOIN (SELECT event_id, ts FROM events) USING (event_id))"""
_WON = ", ".join(f"coalesce(sum({c}) FILTER (WHERE successful), 0)::BIGINT AS {{0}}{c}" for c in ("input_tokens", "output_tokens", "latency_ms"))

QUERIES = {
    "call_windows": (
        call_windows,
        f"""WITH {_CALLED} SELECT strftime(time_bucket(INTERVAL 6 HOURS, ts, TIMESTAMP '2000-01-01'), '%Y-%m-%d %H:%M') AS start, coalesce(stage, 'unknown') AS stage, purpose, count(*) AS calls, count(*) FILTER (WHERE successful) AS successful, {_WON.format('')},
        round(sum(micro), 3)::DOUBLE AS micro_usd FROM c GROUP BY time_bucket(INTERVAL 6 HOURS, ts, TIMESTAMP '2000-01-01'), stage, purpose""",
    ),
    "call_telemetry": (
        call_telemetry,
        f"""WITH {_CALLED}, t AS (SELECT model, purpose, count(*) AS calls, count(*) FILTER (WHERE successful) AS successful, count(*) FILTER (WHERE NOT successful) AS failed, count(*) FILTER (WHERE purpose = 'fidelity-vector') AS vector_calls, {_WON.format('total_')}, round(sum(micro), 3)::DOUBLE AS micro_usd FROM c GROUP BY 1, 2)
        SELECT *, CASE WHEN successful > 0 THEN floor(total_latency_ms / successful + 0.5)::BIGINT ELSE 0 END AS mean_latency_ms FROM t""",
    ),
    "resumed_run": (resumed_run, _RESUMED),
    "fetch_attempts": (fetch_attempts, f"WITH {_TRIED} SELECT * FROM log"),
    "fetch_winners": (fetch_winners, _WINNERS),
    "resolved_papers": (resolved_papers, f"WITH {_RESOLVED} SELECT * REPLACE (paper_id::VARCHAR AS paper_id) FROM resolved"),
    "cited_sources": (cited_sources, _CITED),
    "family_reuse": (family_reuse, _REUSE),
    "parse_cache_hits": (parse_cache_hits, _HITS),
    "stale_lineage": (stale_lineage, _LINEAGE),
    "stale_pointers": (
        stale_pointers,
        f"""WITH {_STAGES}, ch AS (SELECT run_id, family, min(stage_order) FILTER (WHERE status = 'failed') AS f FROM stages GROUP BY ALL), j AS (SELECT *, coalesce(stage_order > f, false) AS later FROM stages JOIN ch USING (run_id, family))
        SELECT run_id, stage_key, family, CASE WHEN later AND status = 'succeeded' THEN 'stale' ELSE status END AS status, CASE WHEN NOT (later AND status = 'succeeded') THEN 'out/' || stage_key END AS output_path, CASE WHEN NOT later THEN 'in/' || stage_key END AS input_path FROM j""",
    ),
    "adaptive_draws": (adaptive_draws, _DRAWS),
    "vector_first": (vector_first, _VECTOR_FIRST),
}
