"""Queries on documents, mentions and retrieval."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import rules, text
from ..operators import classify, graph, retrieval
from ..operators.rounds import cut
from ..sources import testdata as td

_WORDS = "[" + ",".join(f"'{w}'" for w in text.STOP_WORDS) + "]"
_TOKENS = rf"list_filter(regexp_extract_all(lower(coalesce(text, '')), '(\b[\p{{L}}\p{{N}}][\p{{L}}\p{{N}}-]{{1,}}\b)', 1), lambda x: NOT list_contains({_WORDS}, x))"
_INDEX = f"""d AS (SELECT doc_id, {_TOKENS} AS t FROM documents), q AS (SELECT item_id, {_TOKENS} AS t FROM benchmark),
  stats AS (SELECT count(*) AS n_docs, avg(len(t)) AS mean_length FROM d),
  tf AS (SELECT doc_id, term, length, count(*) AS tf FROM (SELECT doc_id, len(t) AS length, unnest(t) AS term FROM d) GROUP BY ALL),
  qtf AS (SELECT item_id, term, count(*) AS qtf FROM (SELECT item_id, unnest(t) AS term FROM q) GROUP BY ALL),
  df AS (SELECT term, count(*) AS df FROM tf GROUP BY term),
  scored AS (SELECT item_id, doc_id, sum(qtf * ln(1 + (n_docs - df + 0.5) / (df + 0.5)) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * length / mean_length))) AS score
    FROM qtf JOIN tf USING (term) JOIN df USING (term) CROSS JOIN stats GROUP BY ALL)"""


def bm25_topk(spark, sf):
    out = retrieval.bm25(td.read(spark, sf, "benchmark"), td.read(spark, sf, "documents"), "item_id", "doc_id", 5)
    return out.select("item_id", "doc_id", F.round("score", 6).alias("score"), "rank")


def bm25_index_stats(spark, sf):
    p = retrieval.postings(td.read(spark, sf, "documents"), "doc_id")
    return p.groupBy("term").agg(F.count("*").alias("df"), F.sum("tf").alias("occurrences"))


def query_tokens(spark, sf):
    q = td.read(spark, sf, "benchmark").select("item_id", F.explode(text.tokens(F.col("text"))).alias("term"))
    return q.groupBy("item_id", "term").agg(F.count("*").alias("n"))


def claim_relevance_filter(spark, sf):
    bench = td.read(spark, sf, "benchmark")
    docs = td.read(spark, sf, "documents")
    scored = cut(retrieval.bm25(bench, docs, "item_id", "doc_id", None))  # read twice
    best = scored.groupBy("item_id").agg(F.max("score").alias("best"))
    return scored.join(best, "item_id").groupBy("item_id").agg(F.count("*").alias("n_scored"), F.count_if(F.col("score") >= 0.22 * F.col("best")).alias("n_in_family"))


def claim_family_papers(spark, sf):
    bench = td.read(spark, sf, "benchmark").withColumn("seed", F.col("item_id") % 20)
    docs = td.read(spark, sf, "documents").withColumn("seed", F.col("doc_id") % 20)
    scored = retrieval.bm25(bench, docs, "item_id", "doc_id", None, within="seed")
    pairs = bench.select("seed", "item_id").join(docs.select("seed", "doc_id"), "seed")
    return retrieval.in_claim_family(scored, pairs, "item_id", "doc_id").select("item_id", "doc_id", F.round("score", 6).alias("score"), "in_family")


def title_normalize(spark, sf):
    return td.papers(spark, sf).select("paper_id", text.normalize_title(F.col("title")).alias("title"), text.surname(F.col("authors")[0]).alias("surname"))


def content_hash(spark, sf):
    return td.read(spark, sf, "documents").select("doc_id", text.content_hash(F.col("text")).alias("hash"), text.cache_key(F.lit("purpose"), F.col("lang"), F.col("source")).alias("cache_key"))


def sentence_split(spark, sf):
    s = td.read(spark, sf, "documents").select("doc_id", text.sentences(F.col("text")).alias("s"))
    return s.select("doc_id", F.size("s").alias("n"), F.aggregate("s", F.lit(0), lambda a, x: a + F.length(x)).alias("chars"))


def evidence_truncation(spark, sf):
    return td.read(spark, sf, "documents").select("doc_id", text.truncate_at_sentence(F.col("text")).alias("cut")).select("doc_id", F.length("cut").alias("chars"), F.md5("cut").alias("digest"))


def block_offsets(spark, sf):
    blocks = td.read(spark, sf, "documents").select("doc_id", F.posexplode(F.split("text", r"\n+")).alias("ord", "text"))
    return graph.block_offsets(blocks).select("doc_id", F.col("block").cast("int").alias("block"), F.col("start").cast("long").alias("start"), F.col("end").cast("long").alias("end"))


def html_sniff(spark, sf):
    h = F.col("html")
    return td.read(spark, sf, "pages").select("page_id", rules.looks_like_html(h).alias("html"), rules.looks_like_xml(h).alias("xml"), rules.html_kind(h).alias("kind"))


def html_links(spark, sf):
    links = F.regexp_extract_all("html", F.lit(r"(?i)<a[^>]+href=[\"']([^\"']+)[\"']"), F.lit(1))
    return td.read(spark, sf, "pages").select("page_id", F.explode(F.array_distinct(links)).alias("link")).groupBy("page_id").agg(F.count("*").alias("links"), F.min("link").alias("first"), F.max("link").alias("last"))


def inverted_index_text(spark, sf):
    words = F.split(F.translate("text", "\n", " "), " ")
    index = td.read(spark, sf, "documents").select("doc_id", text.inverted_index(words).alias("m"))
    return index.select("doc_id", text.abstract_text(F.col("m")).alias("abstract")).where("abstract is not null")


def marker_style(spark, sf):
    return td.mentions(spark, sf).select("marker", rules.marker_style(F.col("marker")).alias("style")).groupBy("marker", "style").agg(F.count("*").alias("n"))


def _annotated(spark, sf):
    return classify.annotate(td.mentions(spark, sf))


def context_type(spark, sf):
    return _annotated(spark, sf).select("citing", "ord", "kind")


def mention_confidence(spark, sf):
    return _annotated(spark, sf).groupBy("style", "kind", "confidence").agg(F.count("*").alias("n"))


def mention_dedup(spark, sf):
    m = classify.dedup_mentions(td.mentions(spark, sf))
    return m.select("citing", "cited", "ord", F.col("mention_index").cast("int").alias("mention_index"))


def edge_usability(spark, sf):
    return classify.edge_usability(_annotated(spark, sf))


def _roles(spark, sf):
    return classify.with_roles(_annotated(spark, sf))


def role_signals(spark, sf):
    return _roles(spark, sf).select("citing", "ord", "methods_section", "background_section", "methods_phrases", "attribution_verbs", "background_phrases")


def citation_role(spark, sf):
    return _roles(spark, sf).select("citing", "ord", "role")


def evaluation_mode(spark, sf):
    return _roles(spark, sf).select("citing", "ord", "mode")


def task_rollup(spark, sf):
    return classify.build_tasks(_roles(spark, sf)).select("citing", "cited", "role", "n_mentions", "bundled", F.coalesce("bundle_size", F.lit(1)).alias("bundle_size"), "first")


def packet_summary(spark, sf):
    return classify.packets(_roles(spark, sf))


def mode_histogram(spark, sf):
    return classify.dense_counts(_roles(spark, sf), "mode", rules.MODES)


def extraction_summary(spark, sf):
    u = classify.edge_usability(_annotated(spark, sf))
    raw = td.mentions(spark, sf).groupBy("citing", "cited").agg(F.count("*").alias("n_raw"))
    dedup = classify.dedup_mentions(td.mentions(spark, sf)).groupBy("citing", "cited").agg(F.count("*").alias("n_deduped"))
    k = F.col("citing") % 8
    e = u.join(raw, ["citing", "cited"]).join(dedup, ["citing", "cited"])
    e = e.withColumn("success", k < 5).withColumn("outcome", F.when(k < 5, "success").when(k == 5, "skipped_not_auditable").when(k == 6, "fail_http_403").otherwise("fail_no_reference_match"))
    return classify.extraction_summary(e)




def _any(column: str, patterns, flags: str = "(?i)") -> str:
    return "(" + " OR ".join(f"regexp_matches({column}, '{flags}{p}')" for p in patterns) + ")"


def _count(column: str, patterns, flags: str = "(?i)") -> str:
    return "(" + " + ".join(f"regexp_matches({column}, '{flags}{p}')::INT" for p in patterns) + ")"


_KIND = f"""CASE WHEN len(regexp_extract_all(context, '\\b10\\.\\d{{4,}}/')) >= 3 OR ({_count('context', rules.BIBLIOGRAPHY_SIGNALS, '')} >= 2 AND len(regexp_extract_all(context, '\\(\\d{{4}}\\)')) >= 3) THEN 'bibliography_like'
  WHEN {_any("coalesce(section, '')", rules.METHODS_SECTIONS)} THEN 'methods_like' WHEN {_any('context', rules.METHODS_SECTIONS)} AND length(context) < 600 THEN 'methods_like'
  WHEN length(context) >= 80 THEN 'narrative_like' ELSE 'unknown' END"""
_STYLE = r"CASE WHEN regexp_matches(marker, '[A-Z][a-z]+.*(?:et\s+al\.?|and\s+[A-Z]).*\d{4}') THEN 'author_year' WHEN regexp_matches(trim(marker), '^\d{1,3}$') THEN 'numeric' WHEN regexp_matches(trim(marker), '^\d{4}$') THEN 'year_only' ELSE 'unknown' END"
_ANNOTATED = f"""{td.MENTIONS}, kinds AS (SELECT *, {_STYLE} AS style, {_KIND} AS kind, length(context) AS length FROM mentions),
 annotated AS (SELECT *, CASE WHEN kind = 'bibliography_like' THEN 'low' WHEN style = 'author_year' AND kind = 'narrative_like' AND length >= 100 THEN 'high'
   WHEN style IN ('author_year', 'numeric') AND length >= 80 THEN 'medium' ELSE 'low' END AS confidence FROM kinds)"""
_NEAR = "CASE WHEN instr(context, marker) > 0 THEN substring(context, greatest(instr(context, marker) - 200, 1), instr(context, marker) + length(marker) + 200 - greatest(instr(context, marker) - 200, 1)) ELSE context END"
_ROLES = f"""{_ANNOTATED}, near AS (SELECT *, {_NEAR} AS near, coalesce(section, '') AS sec FROM annotated),
 signals AS (SELECT *, {_any('sec', rules.METHODS_SECTIONS)} AS methods_section, {_any('sec', [rules.BACKGROUND_SECTION])} AS background_section, {_count('near', rules.METHODS_PHRASES)} AS methods_phrases,
   {_count('near', rules.ATTRIBUTION_VERBS)} AS attribution_verbs, {_count('near', rules.BACKGROUND_PHRASES)} AS background_phrases FROM near),
 totals AS (SELECT *, methods_section::INT + methods_phrases AS m, background_section::INT + background_phrases AS b, attribution_verbs AS v,
   CASE WHEN length < 100 AND confidence = 'low' THEN 'acknowledgment_or_low_information' ELSE 'unclear' END AS thin FROM signals),
 roled AS (SELECT *, CASE WHEN m + b + v = 0 THEN thin WHEN methods_section AND v <= 1 THEN 'methods_materials' WHEN v >= 2 OR (v >= 1 AND b = 0 AND m = 0) THEN 'substantive_attribution'
   WHEN b >= 1 AND v = 0 THEN 'background_context' WHEN v >= 1 AND b >= 1 THEN 'substantive_attribution' WHEN m >= 1 THEN 'methods_materials' ELSE thin END AS role FROM totals),
 classified AS (SELECT *, CASE WHEN review THEN 'review_transmission' WHEN bundled AND role IN ('substantive_attribution', 'background_context') THEN 'fidelity_bundled_use'
   WHEN role = 'unclear' THEN CASE WHEN confidence = 'low' THEN 'manual_review_extraction_limited' ELSE 'manual_review_role_ambiguous' END
   WHEN role = 'substantive_attribution' THEN 'fidelity_specific_claim' WHEN role = 'background_context' THEN 'fidelity_background_framing' WHEN role = 'methods_materials' THEN 'fidelity_methods_use' ELSE 'skip_low_information' END AS mode FROM roled)"""
_USABILITY = """usability AS (SELECT citing, cited, CASE WHEN bool_or(kind = 'narrative_like' AND confidence <> 'low') THEN 'true' WHEN bool_and(kind = 'bibliography_like') THEN 'false' ELSE 'unknown' END AS usable,
   count(*) AS n_mentions, count(*) FILTER (WHERE kind = 'narrative_like' AND confidence <> 'low') AS n_usable FROM annotated GROUP BY citing, cited)"""
_KEPT = """kept AS (SELECT * FROM mentions QUALIFY row_number() OVER (PARTITION BY citing, cited, coalesce(ref_id, 'no-ref'), left(context, 200), coalesce("at"::VARCHAR, 'no-offset') ORDER BY ord) = 1)"""
_SENTENCES = r"(SELECT doc_id, CASE WHEN length(trim(regexp_extract(text, '([^.!?]*)$', 1))) > 20 THEN list_append(regexp_extract_all(text, '([^.!?]*[.!?]+)', 1), regexp_extract(text, '([^.!?]*)$', 1)) ELSE regexp_extract_all(text, '([^.!?]*[.!?]+)', 1) END AS s FROM documents)"

QUERIES = {
    "bm25_topk": (bm25_topk, f"WITH {_INDEX} SELECT item_id, doc_id, round(score, 6) AS score, rank::INT AS rank FROM (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY round(score, 9) DESC, doc_id) AS rank FROM scored WHERE score > 0) WHERE rank <= 5"),
    "bm25_index_stats": (bm25_index_stats, f"WITH {_INDEX} SELECT term, count(*) AS df, sum(tf)::BIGINT AS occurrences FROM tf GROUP BY term"),
    "query_tokens": (query_tokens, f"WITH {_INDEX} SELECT item_id, term, qtf AS n FROM qtf"),
    "claim_relevance_filter": (claim_relevance_filter, f"WITH {_INDEX} SELECT item_id, count(*) AS n_scored, count(*) FILTER (WHERE score >= 0.22 * best) AS n_in_family FROM (SELECT *, max(score) OVER (PARTITION BY item_id) AS best FROM scored WHERE score > 0) GROUP BY item_id"),
    "claim_family_papers": (
        claim_family_papers,
        f"""WITH d AS (SELECT doc_id, doc_id % 20 AS seed, {_TOKENS} AS t FROM documents), q AS (SELECT item_id, item_id % 20 AS seed, {_TOKENS} AS t FROM benchmark),
          stats AS (SELECT seed, count(*) AS n_docs, avg(len(t)) AS mean_length FROM d GROUP BY seed),
          tf AS (SELECT seed, doc_id, term, length, count(*) AS tf FROM (SELECT seed, doc_id, len(t) AS length, unnest(t) AS term FROM d) GROUP BY ALL),
          qtf AS (SELECT seed, item_id, term, count(*) AS qtf FROM (SELECT seed, item_id, unnest(t) AS term FROM q) GROUP BY ALL), df AS (SELECT seed, term, count(*) AS df FROM tf GROUP BY ALL),
          scored AS (SELECT item_id, doc_id, sum(qtf * ln(1 + (n_docs - df + 0.5) / (df + 0.5)) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * length / mean_length))) AS score
            FROM qtf JOIN tf USING (seed, term) JOIN df USING (seed, term) JOIN stats USING (seed) GROUP BY ALL),
          e AS (SELECT item_id, doc_id, coalesce(score, 0) AS score FROM q JOIN d USING (seed) LEFT JOIN scored USING (item_id, doc_id))
          SELECT item_id, doc_id, round(score, 6) AS score, max(score) OVER w > 0 AND score >= 0.22 * max(score) OVER w AS in_family FROM e WINDOW w AS (PARTITION BY item_id)""",
    ),
    "title_normalize": (title_normalize, rf"WITH {td.PAPERS} SELECT paper_id, trim(regexp_replace(regexp_replace(lower(title), '[^\p{{L}}\p{{N}}\s]', '', 'g'), '\s+', ' ', 'g')) AS title, lower(regexp_extract(trim(authors[1]), '(\S+)$', 1)) AS surname FROM papers"),
    "content_hash": (content_hash, "SELECT doc_id, left(sha256(text), 16) AS hash, sha256('purpose' || chr(0) || lang || chr(0) || source) AS cache_key FROM documents"),
    "sentence_split": (sentence_split, f"SELECT doc_id, len(s)::INT AS n, coalesce(list_sum(list_transform(s, lambda x: length(x))), 0)::INT AS chars FROM {_SENTENCES}"),
    "evidence_truncation": (
        evidence_truncation,
        r"""WITH marks AS (SELECT doc_id, text, CASE WHEN length(text) > 600 THEN list_filter(range(0, 720), lambda k: regexp_matches(substring(text, (k + 1)::BIGINT, 2), '[.!?](?:\s|$)')) ELSE []::BIGINT[] END AS m FROM documents),
        cuts AS (SELECT doc_id, text, coalesce(list_max(list_filter(m, lambda k: k <= 600)) + 1, list_min(list_filter(m, lambda k: k >= 600 AND k < least(720, length(text)))) + 1, 600) AS c FROM marks)
        SELECT doc_id, length(cut)::INT AS chars, md5(cut) AS digest FROM (SELECT doc_id, CASE WHEN length(text) <= 600 THEN text WHEN length(rtrim(left(text, c::BIGINT))) < length(text) THEN rtrim(left(text, c::BIGINT)) || ' ...' ELSE rtrim(left(text, c::BIGINT)) END AS cut FROM cuts)""",
    ),
    "block_offsets": (
        block_offsets,
        r"""WITH b AS (SELECT doc_id, unnest(string_split_regex(text, '\n+')) AS t, unnest(range(len(string_split_regex(text, '\n+')))) AS ord FROM documents), k AS (SELECT * FROM b WHERE length(t) >= 30)
        SELECT doc_id, (row_number() OVER w)::INT AS block, (coalesce(sum(length(t) + 2) OVER (PARTITION BY doc_id ORDER BY ord ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))::BIGINT AS start,
        (coalesce(sum(length(t) + 2) OVER (PARTITION BY doc_id ORDER BY ord ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) + length(t))::BIGINT AS "end" FROM k WINDOW w AS (PARTITION BY doc_id ORDER BY ord)""",
    ),
    "html_sniff": (
        html_sniff,
        """SELECT page_id, contains(lower(left(html, 512)), '<html') OR contains(lower(left(html, 512)), '<!doctype html') OR contains(lower(left(html, 512)), '<head') AS html,
        contains(lower(left(html, 1024)), '<?xml') OR contains(lower(left(html, 1024)), '<article') OR contains(lower(left(html, 1024)), '<pmc-articleset') OR contains(lower(left(html, 1024)), '<tei') AS xml,
        CASE WHEN regexp_matches(lower(html), 'pow_challenge|cloudpmc|captcha|challenge') THEN 'html_challenge' WHEN contains(lower(html), 'preparing to download') THEN 'html_interstitial' ELSE 'html_landing_page' END AS kind FROM pages""",
    ),
    "html_links": (html_links, """SELECT page_id, count(*) AS links, min(link) AS first, max(link) AS last FROM (SELECT page_id, unnest(list_distinct(regexp_extract_all(html, '(?i)<a[^>]+href=["'']([^"'']+)["'']', 1))) AS link FROM pages) GROUP BY page_id"""),
    "inverted_index_text": (
        inverted_index_text,
        """SELECT doc_id, array_to_string(w[1:len(w) - coalesce(list_position(list_transform(list_reverse(w), lambda x: x <> ''), true), 1) + 1], ' ') AS abstract
        FROM (SELECT doc_id, string_split(translate(text, chr(10), ' '), ' ') AS w FROM documents) WHERE len(list_filter(w, lambda x: x <> '')) > 0""",
    ),
    "marker_style": (marker_style, f"WITH {td.MENTIONS} SELECT marker, {_STYLE} AS style, count(*) AS n FROM mentions GROUP BY ALL"),
    "context_type": (context_type, f"WITH {_ANNOTATED} SELECT citing, ord, kind FROM annotated"),
    "mention_confidence": (mention_confidence, f"WITH {_ANNOTATED} SELECT style, kind, confidence, count(*) AS n FROM annotated GROUP BY ALL"),
    "mention_dedup": (mention_dedup, f"WITH {td.MENTIONS}, {_KEPT} SELECT citing, cited, ord, (row_number() OVER (PARTITION BY citing, cited ORDER BY ord) - 1)::INT AS mention_index FROM kept"),
    "edge_usability": (edge_usability, f"WITH {_ANNOTATED}, {_USABILITY} SELECT * FROM usability"),
    "role_signals": (role_signals, f"WITH {_ROLES} SELECT citing, ord, methods_section, background_section, methods_phrases, attribution_verbs, background_phrases FROM signals"),
    "citation_role": (citation_role, f"WITH {_ROLES} SELECT citing, ord, role FROM roled"),
    "evaluation_mode": (evaluation_mode, f"WITH {_ROLES} SELECT citing, ord, mode FROM classified"),
    "task_rollup": (task_rollup, f"WITH {_ROLES} SELECT citing, cited, role, count(*) AS n_mentions, bool_or(bundled) AS bundled, coalesce(max(bundle_size) FILTER (WHERE bundle_size > 1), 1) AS bundle_size, min(ord) AS first FROM classified GROUP BY citing, cited, role"),
    "packet_summary": (
        packet_summary,
        f"""WITH {_ROLES} SELECT citing, cited, count(*) AS n_mentions, array_to_string(list_sort(list_distinct(list(role))), ',') AS roles, count(*) FILTER (WHERE confidence <> 'low' OR kind = 'narrative_like') AS n_usable,
        count(*) FILTER (WHERE bundled) AS n_bundled, bool_or(starts_with(mode, 'manual_review')) AS manual_review, CASE WHEN count(*) >= 3 THEN 'high' ELSE 'medium' END AS edge_confidence FROM classified GROUP BY citing, cited""",
    ),
    "mode_histogram": (mode_histogram, f"WITH {_ROLES} SELECT m.mode, count(c.mode) AS n FROM (SELECT unnest({td._sql_list(rules.MODES)}) AS mode) m LEFT JOIN classified c USING (mode) GROUP BY m.mode"),
    "extraction_summary": (
        extraction_summary,
        f"""WITH {_ANNOTATED}, {_USABILITY}, {_KEPT}, e AS (SELECT u.*, r.n AS n_raw, k.n AS n_deduped FROM usability u JOIN (SELECT citing, cited, count(*) AS n FROM mentions GROUP BY ALL) r USING (citing, cited) JOIN (SELECT citing, cited, count(*) AS n FROM kept GROUP BY ALL) k USING (citing, cited))
        SELECT count(*) AS total_edges, count(*) FILTER (WHERE citing % 8 <> 5) AS attempted, count(*) FILTER (WHERE citing % 8 < 5) AS successful, count(*) FILTER (WHERE citing % 8 < 5 AND usable = 'true') AS successful_usable,
        sum(n_raw)::BIGINT AS raw_mentions, sum(n_deduped)::BIGINT AS deduped_mentions, sum(CASE WHEN usable = 'true' THEN n_usable ELSE 0 END)::BIGINT AS usable_mentions FROM e""",
    ),
}
