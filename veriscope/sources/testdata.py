"""The engine's relations, derived from the supplied tables; each with the same derivation in SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.rounds import dealt


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


PAPER_TYPES = ("article", "review", "book-chapter", "letter", "editorial", "preprint", "journal-article", "Posted-Content")
TITLE_ENDINGS = ("", " review", " News", " in brief", "", " Overview", "", "", "", "", "", "", "")
HINTS = ("pmc_xml", "biorxiv_xml", "oa_link", "repository_pdf")
AVAILABILITY = ("available", "available", "abstract_only", "unavailable")


def _pick(values: tuple[str, ...], key) -> F.Column:
    return F.element_at(F.array(*[F.lit(v) for v in values]), (key + 1).cast("int"))


def _sql_list(values: tuple[str, ...]) -> str:
    return "[" + ", ".join(f"'{v}'" for v in values) + "]"


def papers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """paper_id, doi, title, abstract, authors, source, paper_type, year, refs, availability, hint."""
    d = read(spark, sf_dir, "documents")
    k = F.col("doc_id")
    return d.select(
        k.alias("paper_id"),
        F.concat(F.lit("10.1234/"), (k % 900).cast("string")).alias("doi"),
        F.concat(F.split("text", "\n")[0], _pick(TITLE_ENDINGS, k % 13)).alias("title"),
        F.col("text").alias("abstract"),
        F.array(F.concat(F.lit("A. "), "source"), F.concat(F.lit("B "), "lang")).alias("authors"),
        "source",
        F.when(k % 9 < 8, _pick(PAPER_TYPES, k % 9 % 8)).alias("paper_type"),
        F.when(k % 7 != 6, 2000 + k % 25).cast("int").alias("year"),
        (F.col("n_chars") % 250).cast("int").alias("refs"),
        _pick(AVAILABILITY, k % 4).alias("availability"),
        F.when(k % 5 < 4, _pick(HINTS, k % 5 % 4)).alias("hint"),
    )


PAPERS = f"""papers AS (
  SELECT doc_id AS paper_id, '10.1234/' || (doc_id % 900) AS doi,
    string_split(text, chr(10))[1] || {_sql_list(TITLE_ENDINGS)}[(doc_id % 13 + 1)::INT] AS title,
    text AS abstract, ['A. ' || source, 'B ' || lang] AS authors, source,
    CASE WHEN doc_id % 9 < 8 THEN {_sql_list(PAPER_TYPES)}[(doc_id % 9 + 1)::INT] END AS paper_type,
    CASE WHEN doc_id % 7 <> 6 THEN (2000 + doc_id % 25)::INT END AS year, (n_chars % 250)::INT AS refs,
    {_sql_list(AVAILABILITY)}[(doc_id % 4 + 1)::INT] AS availability,
    CASE WHEN doc_id % 5 < 4 THEN {_sql_list(HINTS)}[(doc_id % 5 + 1)::INT] END AS hint
  FROM documents)"""


def edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """seed, citing, status, paper_type, title, refs, availability, year: a star of citing papers around each seed, without duplicates.

    Suppliers give further seeds, of none to four citing papers.
    """
    raw = read(spark, sf_dir, "lineitem").select(F.col("l_partkey").alias("seed"), F.col("l_orderkey").alias("citing"), F.lit(False).alias("small"))
    small = read(spark, sf_dir, "supplier").where("s_suppkey % 5 > 0").select((10_000_000 + F.col("s_suppkey")).alias("seed"), F.explode(F.sequence(F.lit(1).cast("long"), F.col("s_suppkey") % 5)).alias("citing"), F.lit(True).alias("small"))
    # dealt by seed, as what reads edges groups them by seed next
    e = dealt(raw.unionByName(small), "seed").groupBy("seed", "citing", "small").agg(F.count("*").alias("copies"))
    good = (F.col("citing") * 7 + F.col("seed") * 3) % 10 < F.col("seed") % 10
    status = F.when(good, F.when(F.col("citing") % 2 == 0, "auditable_structured").otherwise("auditable_pdf")).otherwise(F.when(F.col("citing") % 3 == 0, "partially_auditable").otherwise("not_auditable"))
    c = F.col("citing")
    return e.select(
        "seed", "citing", "copies", status.alias("status"),
        F.when(c % 9 < 8, _pick(PAPER_TYPES, c % 9 % 8)).alias("paper_type"),
        F.concat(F.lit("Study "), c.cast("string"), _pick(TITLE_ENDINGS, c % 13)).alias("title"),
        (c % 250).cast("int").alias("refs"),
        _pick(AVAILABILITY, c % 4).alias("availability"),
        F.when(c % 7 != 6, 2000 + c % 25).cast("int").alias("year"),
    )


EDGES = f"""edges AS (
  SELECT seed, citing, copies,
    CASE WHEN (citing * 7 + seed * 3) % 10 < seed % 10 THEN CASE WHEN citing % 2 = 0 THEN 'auditable_structured' ELSE 'auditable_pdf' END
         WHEN citing % 3 = 0 THEN 'partially_auditable' ELSE 'not_auditable' END AS status,
    CASE WHEN citing % 9 < 8 THEN {_sql_list(PAPER_TYPES)}[(citing % 9 + 1)::INT] END AS paper_type,
    'Study ' || citing || {_sql_list(TITLE_ENDINGS)}[(citing % 13 + 1)::INT] AS title, (citing % 250)::INT AS refs,
    {_sql_list(AVAILABILITY)}[(citing % 4 + 1)::INT] AS availability,
    CASE WHEN citing % 7 <> 6 THEN (2000 + citing % 25)::INT END AS year
  FROM (SELECT l_partkey AS seed, l_orderkey AS citing, count(*) AS copies FROM lineitem GROUP BY 1, 2
        UNION ALL SELECT 10000000 + s_suppkey, unnest(range(1, (s_suppkey % 5 + 1)::BIGINT)), 1 FROM supplier))"""


#: Endings of mention contexts with their markers: every branch of the mention rules occurs.
TEMPLATES = (
    (" It was shown and demonstrated that growth rose (Smith et al. 2010).", "(Smith et al. 2010)"),
    (" Cells were cultured as described by [12].", "12"),
    (" This factor is known to play a key role (Lee and Park 2015).", "Lee and Park 2015"),
    (" See 1999.", "1999"),
    (" using the protocol of earlier work [7].", "7"),
    ("", "n/a"),
    (" References 10.1000/a 10.1000/b 10.1000/c (2001) (2002) (2003) Nature 2004", "3"),
    (" A screen revealed a defect that has been well established [44; 45].", "[44; 45]"),
    (" The assay is widely used for a review (Kim et al. 2018).", "(Kim et al. 2018)"),
    (" Others suggested that loss was confirmed (Diaz et al. 2020).", "(Diaz et al. 2020)"),
)
SECTIONS = ("Introduction", "Methods", "Results", "Discussion", "Materials and Methods")


def mentions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """citing, cited, ord, context, marker, section, ref_id, at, bundled, bundle_size, review: one for each line of a document, some repeated."""
    lines = read(spark, sf_dir, "documents").select(F.col("doc_id").alias("citing"), F.split("text", "\n").alias("lines"))
    m = lines.select("citing", "lines", F.explode(F.sequence(F.lit(0), F.size("lines") - 1)).alias("ord"))
    m = m.withColumn("j", F.when(F.col("ord") % 3 == 2, F.col("ord") - 1).otherwise(F.col("ord")))
    k = F.col("citing") + F.col("j")
    return m.select(
        "citing", (F.col("citing") % 50).alias("cited"), "ord",
        F.concat(F.element_at("lines", F.col("j") + 1), _pick(tuple(t for t, _ in TEMPLATES), k % 10)).alias("context"),
        _pick(tuple(t for _, t in TEMPLATES), k % 10).alias("marker"),
        F.when(k % 6 < 5, _pick(SECTIONS, k % 6 % 5)).alias("section"),
        F.when(F.col("j") % 4 != 3, F.concat(F.lit("r"), (F.col("j") % 5).cast("string"))).alias("ref_id"),
        F.when(F.col("j") % 7 != 0, F.col("j") * 100).cast("long").alias("at"),
        (k % 10 == 7).alias("bundled"), F.when(k % 10 == 7, 2).otherwise(1).alias("bundle_size"), (F.col("citing") % 9 == 1).alias("review"),
    )


MENTIONS = f"""mentions AS (
  SELECT citing, citing % 50 AS cited, ord, lines[j + 1] || {_sql_list(tuple(t for t, _ in TEMPLATES))}[((citing + j) % 10 + 1)::INT] AS context,
    {_sql_list(tuple(t for _, t in TEMPLATES))}[((citing + j) % 10 + 1)::INT] AS marker,
    CASE WHEN (citing + j) % 6 < 5 THEN {_sql_list(SECTIONS)}[((citing + j) % 6 + 1)::INT] END AS section,
    CASE WHEN j % 4 <> 3 THEN 'r' || (j % 5) END AS ref_id, CASE WHEN j % 7 <> 0 THEN (j * 100)::BIGINT END AS at,
    (citing + j) % 10 = 7 AS bundled, CASE WHEN (citing + j) % 10 = 7 THEN 2 ELSE 1 END AS bundle_size, citing % 9 = 1 AS review
  FROM (SELECT citing, lines, ord, CASE WHEN ord % 3 = 2 THEN ord - 1 ELSE ord END AS j
        FROM (SELECT citing, lines, unnest(range(len(lines)))::INT AS ord FROM (SELECT doc_id AS citing, string_split(text, chr(10)) AS lines FROM documents))))"""


VERDICTS = ("supported", "partially_supported", "overstated_or_generalized", "not_supported", "cannot_determine")


def _tasks(spark: SparkSession, sf_dir: str, every: int, part: int) -> DataFrame:
    """o_orderkey: all orders, and one more task, which the other dataset lacks, for each key divisible by ``every``."""
    keys = read(spark, sf_dir, "orders").select("o_orderkey")
    return keys.unionByName(keys.where(F.col("o_orderkey") % every == 0).select((F.col("o_orderkey") + part * 1_000_000_000).alias("o_orderkey")))


def _tasks_sql(every: int, part: int) -> str:
    return f"(SELECT o_orderkey FROM orders UNION ALL SELECT o_orderkey + {part * 1_000_000_000} FROM orders WHERE o_orderkey % {every} = 0)"


def audit_base(spark: SparkSession, sf_dir: str) -> DataFrame:
    """task_id, ord, verdict, rationale, quality, excluded, exclude_reason, mode of an adjudicated sample."""
    o = _tasks(spark, sf_dir, 13, 1)
    k = F.col("o_orderkey")
    return o.select(
        k.alias("task_id"), k.alias("ord"), F.when(k % 17 != 0, _pick(VERDICTS, k % 5)).alias("verdict"), F.concat(F.lit("r"), (k % 4).cast("string")).alias("rationale"),
        _pick(("high", "medium", "low"), k % 3).alias("quality"), (k % 11 == 0).alias("excluded"), F.when(k % 11 == 0, F.lit("off topic")).alias("exclude_reason"), _pick(("a", "b", "c", "d"), k % 4).alias("mode"),
    )


def audit_candidate(spark: SparkSession, sf_dir: str, shift: int = 0) -> DataFrame:
    """The same columns from another adjudicator; ``shift`` gives different ones."""
    o = _tasks(spark, sf_dir, 19 + shift, 2)
    k = F.col("o_orderkey")
    code = F.when((k + shift) % 3 == 0, (k * 7 + shift) % 5).otherwise(k % 5)
    return o.select(
        k.alias("task_id"), k.alias("ord"), F.when((k + shift) % 23 != 0, _pick(VERDICTS, code)).alias("verdict"), F.concat(F.lit("r"), (k % (5 + shift)).cast("string")).alias("rationale"),
        _pick(("high", "medium", "low"), (k + k % 2) % 3).alias("quality"), ((k % 11 == 0) | (k % 29 == 0)).alias("excluded"),
        F.when(k % 11 == 0, F.lit("off topic")).when(k % 29 == 0, F.lit("duplicate")).alias("exclude_reason"), _pick(("a", "b", "c", "d"), k % 4).alias("mode"),
    )


AUDIT_BASE = f"""base AS (
  SELECT o_orderkey AS task_id, o_orderkey AS ord, CASE WHEN o_orderkey % 17 <> 0 THEN {_sql_list(VERDICTS)}[(o_orderkey % 5 + 1)::INT] END AS verdict, 'r' || (o_orderkey % 4) AS rationale,
    ['high', 'medium', 'low'][(o_orderkey % 3 + 1)::INT] AS quality, o_orderkey % 11 = 0 AS excluded, CASE WHEN o_orderkey % 11 = 0 THEN 'off topic' END AS exclude_reason,
    ['a', 'b', 'c', 'd'][(o_orderkey % 4 + 1)::INT] AS mode
  FROM {_tasks_sql(13, 1)})"""


def audit_candidate_sql(name: str = "cand", shift: int = 0) -> str:
    return f"""{name} AS (
  SELECT o_orderkey AS task_id, o_orderkey AS ord,
    CASE WHEN (o_orderkey + {shift}) % 23 <> 0 THEN {_sql_list(VERDICTS)}[(CASE WHEN (o_orderkey + {shift}) % 3 = 0 THEN (o_orderkey * 7 + {shift}) % 5 ELSE o_orderkey % 5 END + 1)::INT] END AS verdict,
    'r' || (o_orderkey % (5 + {shift})) AS rationale, ['high', 'medium', 'low'][((o_orderkey + o_orderkey % 2) % 3 + 1)::INT] AS quality,
    o_orderkey % 11 = 0 OR o_orderkey % 29 = 0 AS excluded, CASE WHEN o_orderkey % 11 = 0 THEN 'off topic' WHEN o_orderkey % 29 = 0 THEN 'duplicate' END AS exclude_reason,
    ['a', 'b', 'c', 'd'][(o_orderkey % 4 + 1)::INT] AS mode
  FROM {_tasks_sql(19 + shift, 2)})"""


AXES = ("support", "evidence_grounding", "claim_identity", "directional_alignment", "scope_match", "certainty_match", "attribution_directness", "uncertainty")
SCOPES = ("none", "expansion", "contraction", "shift", "unclear")
CERTAINTIES = ("none", "escalation", "deflation", "shift", "unclear")
_BASE_OFFSET = (0.45, 0.4, 0.3, 0.3, 0.3, 0.25, 0.05, -0.15)


def _offset_sql(axis: int) -> str:
    """Offset of an axis by vec_id, the same text for both engines."""
    if axis == 7:
        return "(-0.2 + 0.1 * (vec_id % 4))"
    base = "CASE vec_id % 8 " + " ".join(f"WHEN {k} THEN {v}" for k, v in enumerate(_BASE_OFFSET)) + " END"
    special = {3: "WHEN vec_id % 8 = 2 THEN -0.3", 0: "WHEN vec_id % 8 = 3 THEN -0.3", 4: "WHEN vec_id % 8 = 4 THEN 0.1", 5: "WHEN vec_id % 8 = 4 THEN 0.1"}.get(axis)
    return f"(CASE {special} ELSE {base} END)" if special else f"({base})"


def vector_samples(spark: SparkSession, sf_dir: str) -> DataFrame:
    """record_id, sample, the eight axes, verdict, scope_direction, certainty_direction, bundled: eight judgments of each record."""
    v = read(spark, sf_dir, "embeddings").select("vec_id", "embedding", F.explode(F.sequence(F.lit(0), F.lit(7))).alias("sample"))
    axis = [
        F.least(F.lit(1.0), F.greatest(F.lit(0.0), 0.5 + F.element_at("embedding", 8 * F.col("sample") + a + 1).cast("double") + F.expr(_offset_sql(a)).cast("double"))).alias(name)
        for a, name in enumerate(AXES)
    ]
    code = F.when(F.col("vec_id") % 5 == 0, F.col("vec_id") % 3).otherwise((F.col("vec_id") + F.floor(F.col("sample") / (1 + F.col("vec_id") % 4))) % 5)
    return v.select(
        F.col("vec_id").alias("record_id"), "sample", *axis, _pick(VERDICTS, code).alias("verdict"),
        F.when(F.col("vec_id") % 3 == 0, F.lit("expansion")).otherwise(_pick(SCOPES, (F.col("vec_id") + F.col("sample")) % 5)).alias("scope_direction"),
        F.when(F.col("vec_id") % 4 == 0, F.lit("escalation")).otherwise(_pick(CERTAINTIES, (F.col("vec_id") + 2 * F.col("sample")) % 5)).alias("certainty_direction"),
        (F.col("vec_id") % 7 == 0).alias("bundled"),
    )


VECTOR_SAMPLES = (
    "samples AS (SELECT vec_id AS record_id, sample, "
    + ", ".join(f"least(1.0::DOUBLE, greatest(0.0::DOUBLE, 0.5::DOUBLE + embedding[8 * sample + {a + 1}]::DOUBLE + {_offset_sql(a)}::DOUBLE)) AS {name}" for a, name in enumerate(AXES))
    + f""",
    {_sql_list(VERDICTS)}[(CASE WHEN vec_id % 5 = 0 THEN vec_id % 3 ELSE (vec_id + sample // (1 + vec_id % 4)) % 5 END + 1)::INT] AS verdict,
    CASE WHEN vec_id % 3 = 0 THEN 'expansion' ELSE {_sql_list(SCOPES)}[((vec_id + sample) % 5 + 1)::INT] END AS scope_direction,
    CASE WHEN vec_id % 4 = 0 THEN 'escalation' ELSE {_sql_list(CERTAINTIES)}[((vec_id + 2 * sample) % 5 + 1)::INT] END AS certainty_direction,
    vec_id % 7 = 0 AS bundled
  FROM (SELECT vec_id, embedding, unnest(range(8))::INT AS sample FROM embeddings))"""
)

MODELS = ("alpha-large", "alpha-mid", "alpha-small", "beta-unknown")


def prices(spark: SparkSession) -> DataFrame:
    """model, input_usd, output_usd: an invented price list, in which the last model is missing."""
    return spark.sql(f"SELECT * FROM VALUES {_PRICE_ROWS} AS p(model, input_usd, output_usd)")


_PRICE_ROWS = "('alpha-large', 11.5D, 41.0D), ('alpha-mid', 2.5D, 9.5D), ('alpha-small', 0.75D, 4.25D)"
PRICES = f"prices AS (SELECT * FROM (VALUES {_PRICE_ROWS.replace('D', '')}) AS p(model, input_usd, output_usd))"


def calls(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Model calls: purpose, model, stage, family, successful, failed, billable, hit, and token counts."""
    e = read(spark, sf_dir, "events")
    k = F.coalesce(F.get_json_object("props", "$.k").cast("long"), F.lit(0))
    return e.select(
        "event_id", F.col("event_type").alias("purpose"), _pick(MODELS, F.col("event_id") % 4).alias("model"), F.when(F.col("user_id") % 8 < 7, F.concat(F.lit("stage"), (F.col("user_id") % 8).cast("string"))).alias("stage"),
        F.when(F.col("user_id") % 5 != 4, F.col("user_id") % 5).cast("int").alias("family"), (F.col("event_type") != "error").alias("successful"), (F.col("event_type") == "error").alias("failed"),
        (F.col("event_id") % 6 != 0).alias("billable"), (F.col("event_id") % 6 == 0).alias("hit"), (100 + k * 10).alias("input_tokens"), F.when(F.col("event_id") % 9 == 0, 0).otherwise(20 + k).alias("output_tokens"),
        (F.col("event_id") % 50).alias("reasoning_tokens"), (k % 40).alias("cache_read_tokens"), (F.col("event_id") % 30).alias("cache_write_tokens"), (F.col("event_id") % 7).alias("cache_write_hour_tokens"),
    )


CALLS = f"""calls AS (
  SELECT event_id, event_type AS purpose, {_sql_list(MODELS)}[(event_id % 4 + 1)::INT] AS model, CASE WHEN user_id % 8 < 7 THEN 'stage' || (user_id % 8) END AS stage,
    CASE WHEN user_id % 5 <> 4 THEN (user_id % 5)::INT END AS family, event_type <> 'error' AS successful, event_type = 'error' AS failed, event_id % 6 <> 0 AS billable, event_id % 6 = 0 AS hit,
    100 + k * 10 AS input_tokens, CASE WHEN event_id % 9 = 0 THEN 0 ELSE 20 + k END AS output_tokens, event_id % 50 AS reasoning_tokens, k % 40 AS cache_read_tokens, event_id % 30 AS cache_write_tokens, event_id % 7 AS cache_write_hour_tokens
  FROM (SELECT *, coalesce(json_extract_string(props, '$.k')::BIGINT, 0) AS k FROM events))"""

STATUSES = ("not_started", "running", "succeeded", "failed", "stale", "blocked", "succeeded", "succeeded")
STAGES = ("discover", "screen", "extract", "classify", "evidence", "curate", "adjudicate")


def stage_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """run_id, stage_key, stage_order, family, seq, status: successive states of the runs' stages."""
    e = read(spark, sf_dir, "events")
    k = F.col("event_id")
    return e.select(F.col("user_id").alias("run_id"), _pick(STAGES, k % 7).alias("stage_key"), (k % 7).cast("int").alias("stage_order"), (k % 3).cast("int").alias("family"), k.alias("seq"), "ts", _pick(STATUSES, (k * 3 + F.col("user_id")) % 8).alias("status"))


STAGE_EVENTS = f"""stage_events AS (
  SELECT user_id AS run_id, {_sql_list(STAGES)}[(event_id % 7 + 1)::INT] AS stage_key, (event_id % 7)::INT AS stage_order, (event_id % 3)::INT AS family, event_id AS seq, ts,
    {_sql_list(STATUSES)}[((event_id * 3 + user_id) % 8 + 1)::INT] AS status FROM events)"""

TASK_MODES = ("fidelity_specific_claim", "fidelity_background_framing", "fidelity_bundled_use", "fidelity_methods_use", "review_transmission", "manual_review_role_ambiguous", "manual_review_extraction_limited", "skip_low_information")
TASK_ROLES = ("substantive_attribution", "background_context", "methods_materials", "unclear")


def tasks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """task_id, seed, ord, role, mode, bundled, review, resolved, fetched, matches, abstract_only, relevance, confidence."""
    keys = ("l_orderkey", "l_partkey", "l_suppkey", "l_linenumber")
    li = dealt(read(spark, sf_dir, "lineitem").select(*keys, "l_quantity"), *keys).groupBy(*keys).agg(F.max("l_quantity").alias("q"))
    k = F.col("l_orderkey") * 31 + F.col("l_partkey") * 7 + F.col("l_linenumber")
    return li.select(
        F.concat_ws("-", F.col("l_orderkey").cast("string"), F.col("l_partkey").cast("string"), F.col("l_suppkey").cast("string"), F.col("l_linenumber").cast("string")).alias("task_id"), (F.col("l_partkey") % 40).alias("seed"),
        _pick(TASK_ROLES, k % 4).alias("role"), _pick(TASK_MODES, k % 8).alias("mode"), (k % 5 == 0).alias("bundled"), (k % 6 == 0).alias("review"), (k % 17 != 0).alias("resolved"), (k % 13 != 0).alias("fetched"),
        (k % 7).cast("int").alias("matches"), (k % 11 == 0).alias("abstract_only"), F.col("q").alias("relevance"), _pick(("high", "medium", "low"), k % 3).alias("confidence"),
    )


TASKS = f"""tasks AS (
  SELECT l_orderkey || '-' || l_partkey || '-' || l_suppkey || '-' || l_linenumber AS task_id, l_partkey % 40 AS seed, {_sql_list(TASK_ROLES)}[(k % 4 + 1)::INT] AS role, {_sql_list(TASK_MODES)}[(k % 8 + 1)::INT] AS mode,
    k % 5 = 0 AS bundled, k % 6 = 0 AS review, k % 17 <> 0 AS resolved, k % 13 <> 0 AS fetched, (k % 7)::INT AS matches, k % 11 = 0 AS abstract_only, q AS relevance, ['high', 'medium', 'low'][(k % 3 + 1)::INT] AS confidence
  FROM (SELECT l_orderkey, l_partkey, l_suppkey, l_linenumber, max(l_quantity) AS q, l_orderkey * 31 + l_partkey * 7 + l_linenumber AS k FROM lineitem GROUP BY ALL))"""


def families(spark: SparkSession, sf_dir: str) -> DataFrame:
    """family_id, doi, tracked, normalized, support, status, citing_ids, n_mentions: claim families of seeds, whose number follows the table's.

    Claims are the first line of a document and its first sentence, the support is its whole text.
    """
    d = read(spark, sf_dir, "documents")
    d = d.crossJoin(F.broadcast(d.agg(F.greatest(F.lit(30), F.floor(F.count("*") / 33)).alias("seeds"))))
    k, line = F.col("doc_id"), F.split("text", "\n")[0]
    return d.select(
        F.concat(F.lit("fam-"), F.lpad(k.cast("string"), 9, "0")).alias("family_id"), (k % F.col("seeds")).alias("doi"), line.alias("tracked"), F.when(k % 3 != 0, F.regexp_extract(line, "^[^.!?]*", 0)).alias("normalized"), F.translate("text", "\n", " ").alias("support"),
        _pick(("grounded", "ambiguous", "not_attempted", "not_found", "no_seed_fulltext"), k % 5).alias("status"), F.array((k % 40).cast("string"), (k % 31).cast("string"), (k % 7).cast("string")).alias("citing_ids"), (1 + k % 6).cast("int").alias("n_mentions"),
    )


FAMILIES = """families AS (
  SELECT 'fam-' || lpad(doc_id::VARCHAR, 9, '0') AS family_id, doc_id % (SELECT greatest(30, count(*) // 33) FROM documents) AS doi, line AS tracked, CASE WHEN doc_id % 3 <> 0 THEN regexp_extract(line, '^[^.!?]*') END AS normalized,
    translate(text, chr(10), ' ') AS support, ['grounded', 'ambiguous', 'not_attempted', 'not_found', 'no_seed_fulltext'][(doc_id % 5 + 1)::INT] AS status,
    [(doc_id % 40)::VARCHAR, (doc_id % 31)::VARCHAR, (doc_id % 7)::VARCHAR] AS citing_ids, (1 + doc_id % 6)::INT AS n_mentions
  FROM (SELECT doc_id, text, string_split(text, chr(10))[1] AS line FROM documents))"""
