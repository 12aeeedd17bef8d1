"""Queries on harvesting and discovery."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import discovery, harvest
from ..sources import testdata as td

_KINDS = ("abstract", "body", "figure_caption", "table_caption", "body")


def edge_papers(spark, sf):
    papers = td.papers(spark, sf).select("paper_id", "year", F.size("authors").alias("n_authors"))
    out = harvest.edge_papers(td.edges(spark, sf).select("seed", "citing"), papers)
    return out.select("seed", "citing", F.coalesce("year", F.lit(0)).alias("year"), F.coalesce("n_authors", F.lit(0)).alias("n_authors"))


def _references(spark, sf):
    listed = td.mentions(spark, sf).where("ref_id is not null and citing % 10 <> 9").select("citing", "ref_id")
    return listed.unionByName(td.papers(spark, sf).where("paper_id % 4 = 0").select(F.col("paper_id").alias("citing"), F.lit("r9").alias("ref_id"))).distinct()


def _harvested(spark, sf):
    k = F.col("paper_id")
    papers = td.papers(spark, sf).select(k.alias("citing"), "availability", F.when(k % 11 == 3, "HTTP 403").when(k % 11 == 5, "GROBID gave nothing").when(k % 11 == 7, "odd answer").alias("error"))
    matched = td.papers(spark, sf).select(k.alias("citing"), F.when(k % 8 == 0, "r9").otherwise(F.concat(F.lit("r"), (k % 6).cast("string"))).alias("ref_id"))
    return harvest.harvest(papers, _references(spark, sf), matched, td.mentions(spark, sf))


def harvest_outcomes(spark, sf):
    source = td._pick(("grobid_tei", "jats_xml", "plain"), F.col("citing") % 3)
    return _harvested(spark, sf).withColumn("extraction", harvest.extraction_outcome(F.col("outcome"), source))


def extraction_failures(spark, sf):
    return harvest.failure_histogram(harvest_outcomes(spark, sf).select("citing", F.col("extraction").alias("outcome")))


def probe_stats(spark, sf):
    return harvest.probe_stats(_harvested(spark, sf).withColumn("seed", F.col("citing") % 50), "seed").withColumn("rate", F.round("rate", 6))


def harvest_presence(spark, sf):
    edges = td.edges(spark, sf).select("seed", "citing")
    held = _harvested(spark, sf).where("outcome <> 'no_fulltext'")
    return harvest.with_harvest(edges, held).groupBy("seed").agg(F.count_if("harvested").alias("harvested"), F.count_if(F.col("held") == 0).alias("empty"), F.count_if(F.col("held").isNull()).alias("absent"))


def matched_mentions(spark, sf):
    matched = td.papers(spark, sf).select(F.col("paper_id").alias("citing"), F.concat(F.lit("r"), (F.col("paper_id") % 5).cast("string")).alias("ref_id"))
    return harvest.matched_mentions(td.mentions(spark, sf), matched).select("citing", "ref_id", "ord")


def section_titles(spark, sf):
    return harvest.mentions_by_paper(td.mentions(spark, sf)).withColumn("sections", F.array_join("sections", ";"))


def inspection_top(spark, sf):
    m = td.mentions(spark, sf).withColumn("confidence", td._pick(("medium", "high", "low"), (F.col("citing") + F.col("ord")) % 3))
    return harvest.best_examples(m, "cited", ("citing", "ord")).select("cited", "citing", "ord", "place")


def three_way(spark, sf):
    m = td.mentions(spark, sf).groupBy("citing", "cited").agg(F.count("*").alias("n_mentions"))
    classified = td.mentions(spark, sf).where("citing % 3 <> 0").groupBy("citing", "cited").agg(F.count_if("bundled").alias("n_bundled"))
    screened = td.papers(spark, sf).where("paper_id % 4 <> 1").select(F.col("paper_id").alias("citing"), (F.col("paper_id") % 50).alias("cited"), "availability")
    return harvest.three_way(m, classified, screened).withColumn("n_bundled", F.coalesce("n_bundled", F.lit(-1)))


def _blocks(spark, sf):
    m = td.mentions(spark, sf)
    return m.select("citing", "ord", td._pick(_KINDS, (F.col("citing") + F.col("ord")) % 5).alias("kind"), "section", F.col("context").alias("text"))


def claim_blocks(spark, sf):
    return _blocks(spark, sf).withColumn("bearing", harvest.claim_bearing(F.col("kind"), F.col("section"))).groupBy("kind", "section").agg(F.count_if("bearing").alias("n_bearing"), F.count("*").alias("n"))


def manuscript(spark, sf):
    b = _blocks(spark, sf)
    return harvest.manuscript(b.where(harvest.claim_bearing(F.col("kind"), F.col("section"))), "citing").select("citing", F.length("manuscript").alias("chars"), F.md5("manuscript").alias("digest"))


def retrieval_query(spark, sf):
    m = td.mentions(spark, sf)
    return m.select("citing", "ord", F.md5(harvest.retrieval_query(F.col("context"), F.col("section"), F.col("marker"))).alias("digest"))


_MARKS = tuple((marker, f"m{k % 4}") for k, (_, marker) in enumerate(td.TEMPLATES))


def bundle_detection(spark, sf):
    markers = F.array(*[F.struct(F.lit(m).alias("marker"), F.array(F.lit(r)).alias("refs")) for m, r in _MARKS])
    b = td.mentions(spark, sf).withColumn("b", harvest.detect_bundle(F.col("marker"), markers, F.col("context")))
    return b.select("citing", "ord", F.col("b.size").cast("int").alias("size"), F.array_join(F.array_sort("b.refs"), ",").alias("refs"), F.col("b.pattern").alias("pattern"))


def marker_position(spark, sf):
    m = td.mentions(spark, sf).withColumn("wanted", F.when(F.col("ord") % 3 == 1, F.concat(F.col("marker"), F.lit(" ;"))).when(F.col("ord") % 5 == 4, F.lit("Smith et al. 2010")).otherwise(F.col("marker")))
    return m.select("citing", "ord", harvest.marker_position(F.col("context"), F.col("wanted")).alias("at"))


def citing_windows(spark, sf):
    return harvest.citing_window(td.mentions(spark, sf), "context", "marker", "window", 200).select("citing", "ord", F.length("window").alias("chars"), F.md5("window").alias("digest"))


def annotated_contexts(spark, sf):
    label = F.when(F.col("ord") % 2 == 0, F.regexp_extract("context", r"(\w+ \w+ \w+)\.", 1))
    m = td.mentions(spark, sf).withColumn("label", F.nullif(label, F.lit("")))
    return harvest.annotate_context(m, "context", "marker", "label", "out").select("citing", "ord", F.contains("out", F.lit("<<")).alias("marked"), F.md5("out").alias("digest"))


def _claims(spark, sf):
    m = td.mentions(spark, sf)
    return m.select(
        F.concat_ws("-", F.col("citing").cast("string"), F.col("ord").cast("string")).alias("record_id"), F.concat_ws(":", F.col("citing").cast("string"), (F.col("ord") + F.when(F.col("ord") % 9 == 8, 1000).otherwise(0)).cast("string")).alias("mention_id"),
        "citing", F.col("cited").alias("seed"), (F.col("ord") % 4 != 3).alias("in_scope"), F.when(F.col("ord") % 5 != 4, F.col("context")).alias("claim"),
    )


def claim_mentions(spark, sf):
    m = td.mentions(spark, sf).select(F.concat_ws(":", F.col("citing").cast("string"), F.col("ord").cast("string")).alias("mention_id"), "marker", "section")
    return discovery.claim_mentions(_claims(spark, sf), m).groupBy("seed").agg(F.count("*").alias("n"), F.count_if(F.col("marker").isNull()).alias("unknown"), F.count_if(F.col("section").isNotNull()).alias("placed"))


def singleton_families(spark, sf):
    stats = harvest.probe_stats(_harvested(spark, sf).where("citing % 50 <> 7").withColumn("seed", F.col("citing") % 50), "seed")
    f = discovery.singleton_families(_claims(spark, sf), stats)
    return f.select("family_id", "seed", F.md5("tracked").alias("tracked"), F.element_at("mentions", 1).alias("mention"), "probed", "successful", F.round("rate", 6).alias("rate"))


def _engagement(spark, sf):
    claims = td.read(spark, sf, "part").select((F.col("p_partkey") % 20).alias("seed"), F.col("p_partkey").alias("claim_index"), F.when(F.col("p_partkey") % 4 == 0, "method").otherwise("finding").alias("claim_type"))
    k = F.col("l_orderkey") + F.col("l_linenumber")
    matches = td.read(spark, sf, "lineitem").where((F.col("l_partkey") % 9 != 0) & (k % 3 != 2)).select((F.col("l_partkey") % 20).alias("seed"), F.col("l_partkey").alias("claim_index"), (k % 3 == 0).alias("direct"), F.concat(F.lit("Study "), F.col("l_orderkey").cast("string")).alias("title"))
    return discovery.engagement(claims, matches)


def claim_engagement(spark, sf):
    return _engagement(spark, sf).withColumn("titles", F.md5(F.array_join("titles", ";")))


def discovery_seeds(spark, sf):
    s = spark.range(20).select(F.col("id").alias("seed"), F.when(F.col("id") % 5 == 4, "failed").otherwise("completed").alias("status"), (F.col("id") % 3 != 1).alias("ranked"))
    return discovery.discovery_seeds(_engagement(spark, sf), s, 7)


def grounding_lookup(spark, sf):
    f = td.families(spark, sf)
    traces = f.where("doi % 4 <> 2").select("family_id", "tracked", "status", F.col("family_id").alias("ord"))
    seeds = f.select(F.col("family_id").alias("seed_id"), F.when(F.col("doi") % 3 != 0, F.col("family_id")).alias("family_id"), "tracked")
    return discovery.grounding(seeds, traces).select("seed_id", "status")


def relevance_filter(spark, sf):
    answers = td.papers(spark, sf).where("paper_id % 7 <> 0").select("paper_id", F.when(F.col("paper_id") % 5 != 0, F.col("paper_id") % 3 == 0).alias("relevant"))
    return discovery.keep_relevant(td.papers(spark, sf).select("paper_id", "source"), answers)


def cluster_merge(spark, sf):
    f = td.families(spark, sf).select(F.substring("family_id", 5, 9).cast("long").alias("index"), "family_id", F.col("citing_ids").alias("papers"), (F.col("status") != "not_attempted").alias("traced"))
    k = F.col("doc_id")
    clusters = td.read(spark, sf, "documents").select(F.floor(k / 4).alias("cluster"), k.alias("index"), ((k % 4 == 0) & (k % 16 != 12)).alias("representative"))
    return discovery.merge_clusters(f, clusters).withColumn("papers", F.array_join("papers", ","))


def family_metrics(spark, sf):
    own = td.edges(spark, sf).where("citing % 2 = 0")
    whole = td.edges(spark, sf).groupBy("seed").agg(F.sum("copies").alias("total_edges"), (F.sum("copies") - F.count("*")).alias("collapsed"))
    family = own.groupBy("seed").agg(F.count("*").alias("total_edges"), F.lit(0).cast("long").alias("collapsed"), F.count("*").alias("unique_edges"))
    return discovery.family_metrics(whole, family)


def readded_papers(spark, sf):
    p = td.papers(spark, sf)
    groups = p.select("paper_id", (F.col("paper_id") - F.col("paper_id") % 3).alias("representative"))
    return discovery.readd_collapsed(groups.where("paper_id = representative and paper_id % 9 <> 3").select("paper_id"), groups)


_REFS = """refs AS (SELECT DISTINCT citing, ref_id FROM (SELECT citing, ref_id FROM mentions WHERE ref_id IS NOT NULL AND citing % 10 <> 9 UNION ALL SELECT doc_id, 'r9' FROM documents WHERE doc_id % 4 = 0))"""
_OUT = f"""{td.MENTIONS}, {_REFS}, p AS (SELECT doc_id AS citing, {td._sql_list(td.AVAILABILITY)}[(doc_id % 4 + 1)::INT] AS availability, CASE doc_id % 11 WHEN 3 THEN 'HTTP 403' WHEN 5 THEN 'GROBID gave nothing' WHEN 7 THEN 'odd answer' END AS error,
    CASE WHEN doc_id % 8 = 0 THEN 'r9' ELSE 'r' || (doc_id % 6) END AS wanted FROM documents),
  x AS (SELECT p.*, (SELECT count(*) FROM refs r WHERE r.citing = p.citing) AS n_references, (SELECT count(*) FROM refs r WHERE r.citing = p.citing AND r.ref_id = p.wanted) AS hit, (SELECT count(*) FROM mentions m WHERE m.citing = p.citing AND m.ref_id = p.wanted) AS n FROM p),
  harvested AS (SELECT citing, n_references, n, CASE WHEN availability <> 'available' THEN 'no_fulltext' WHEN error LIKE '%403%' THEN 'http_403' WHEN error LIKE 'GROBID%' THEN 'parse_failed' WHEN error IS NOT NULL THEN 'unknown_failure' WHEN n_references = 0 THEN 'ref_list_empty'
    WHEN hit = 0 THEN 'no_reference_match' WHEN n = 0 THEN 'ref_found_but_no_in_text_xref' ELSE 'success' END AS outcome FROM x),
  extracted AS (SELECT citing, outcome, n_references, CASE WHEN outcome = 'success' THEN n ELSE 0 END AS n_mentions, CASE WHEN outcome = 'success' THEN ['success_grobid', 'success_structured', 'success_pdf'][(citing % 3 + 1)::INT]
    ELSE CASE outcome {' '.join(f"WHEN '{a}' THEN '{b}'" for a, b in harvest.FAILURES.items())} ELSE 'fail_unknown' END END AS extraction FROM harvested)"""
_BLOCKS = f"""{td.MENTIONS}, blocks AS (SELECT citing, ord, {td._sql_list(_KINDS)}[((citing + ord) % 5 + 1)::INT] AS kind, section, context AS text FROM mentions),
  bearing AS (SELECT *, CASE WHEN kind = 'abstract' THEN true WHEN kind IN ('figure_caption', 'table_caption') THEN false ELSE NOT regexp_matches(coalesce(section, ''), '(?i){'|'.join(harvest.NO_CLAIM_SECTIONS)}') END AS bearing FROM blocks)"""
_CLAIMS = f"""{td.MENTIONS}, claims AS (SELECT citing || '-' || ord AS record_id, citing || ':' || (ord + CASE WHEN ord % 9 = 8 THEN 1000 ELSE 0 END) AS mention_id, citing, cited AS seed, ord % 4 <> 3 AS in_scope, CASE WHEN ord % 5 <> 4 THEN context END AS claim FROM mentions)"""
_ENGAGED = """m AS (SELECT l_partkey AS claim_index, (l_orderkey + l_linenumber) % 3 = 0 AS direct, 'Study ' || l_orderkey AS title FROM lineitem WHERE l_partkey % 9 <> 0 AND (l_orderkey + l_linenumber) % 3 <> 2),
  e AS (SELECT p_partkey % 20 AS seed, p_partkey AS claim_index, CASE WHEN p_partkey % 4 = 0 THEN 'method' ELSE 'finding' END AS claim_type, count(*) FILTER (WHERE direct) AS n_direct, count(*) FILTER (WHERE NOT direct) AS n_indirect,
    coalesce(string_agg(title, ';' ORDER BY title) FILTER (WHERE direct), '') AS titles FROM part LEFT JOIN m ON m.claim_index = p_partkey GROUP BY ALL),
  engaged AS (SELECT *, (row_number() OVER (PARTITION BY seed ORDER BY n_direct DESC, n_indirect DESC, claim_index))::INT AS rank FROM e)"""
_MARK_ROWS = "[" + ", ".join("{'marker': '%s', 'ref': '%s'}" % m for m in _MARKS) + "]"

QUERIES = {
    "edge_papers": (edge_papers, f"WITH {td.EDGES}, {td.PAPERS} SELECT seed, citing, coalesce(p.year, 0)::INT AS year, coalesce(len(authors), 0)::INT AS n_authors FROM edges e LEFT JOIN papers p ON p.paper_id = e.citing"),
    "harvest_outcomes": (harvest_outcomes, f"WITH {_OUT} SELECT * FROM extracted"),
    "extraction_failures": (extraction_failures, f"WITH {_OUT} SELECT extraction AS outcome, count(*) AS n FROM extracted WHERE NOT starts_with(extraction, 'success') GROUP BY 1"),
    "probe_stats": (probe_stats, f"WITH {_OUT} SELECT citing % 50 AS seed, count(*) AS probed, count(*) FILTER (WHERE outcome = 'success') AS successful, round(count(*) FILTER (WHERE outcome = 'success') / count(*), 6) AS rate FROM harvested GROUP BY 1"),
    "harvest_presence": (
        harvest_presence,
        f"WITH {_OUT}, {td.EDGES}, h AS (SELECT citing, n_mentions FROM extracted WHERE outcome <> 'no_fulltext') SELECT seed, count(h.citing) AS harvested, count(*) FILTER (WHERE n_mentions = 0) AS empty, count(*) FILTER (WHERE n_mentions IS NULL) AS absent FROM edges LEFT JOIN h USING (citing) GROUP BY seed",
    ),
    "matched_mentions": (matched_mentions, f"WITH {td.MENTIONS} SELECT citing, ref_id, ord FROM mentions WHERE ref_id = 'r' || (citing % 5)"),
    "section_titles": (section_titles, f"WITH {td.MENTIONS} SELECT citing, count(*) AS n_mentions, coalesce(array_to_string(list_sort(list(DISTINCT section) FILTER (WHERE section IS NOT NULL)), ';'), '') AS sections FROM mentions GROUP BY citing"),
    "inspection_top": (
        inspection_top,
        f"WITH {td.MENTIONS}, r AS (SELECT cited, citing, ord, (row_number() OVER (PARTITION BY cited ORDER BY CASE (citing + ord) % 3 WHEN 1 THEN 0 WHEN 0 THEN 1 ELSE 2 END, citing, ord))::INT AS place FROM mentions) SELECT * FROM r WHERE place <= 10",
    ),
    "three_way": (
        three_way,
        f"""WITH {td.MENTIONS}, m AS (SELECT citing, cited, count(*) AS n_mentions, count(*) FILTER (WHERE bundled) AS b FROM mentions GROUP BY ALL)
        SELECT citing, cited, n_mentions, CASE WHEN citing % 3 <> 0 THEN b ELSE -1 END AS n_bundled, CASE WHEN citing % 4 <> 1 THEN {td._sql_list(td.AVAILABILITY)}[(citing % 4 + 1)::INT] END AS availability FROM m""",
    ),
    "claim_blocks": (claim_blocks, f"WITH {_BLOCKS} SELECT kind, section, count(*) FILTER (WHERE bearing) AS n_bearing, count(*) AS n FROM bearing GROUP BY ALL"),
    "manuscript": (
        manuscript,
        f"""WITH {_BLOCKS}, t AS (SELECT citing, ord, CASE WHEN length(section) > 0 THEN '[' || section || ']' || chr(10) ELSE '' END || trim(text) AS t FROM bearing WHERE bearing),
        s AS (SELECT citing, left(coalesce(string_agg(t, chr(10) || chr(10) ORDER BY ord) FILTER (WHERE t <> ''), ''), 150000) AS m FROM t GROUP BY citing) SELECT citing, length(m)::INT AS chars, md5(m) AS digest FROM s""",
    ),
    "retrieval_query": (retrieval_query, f"WITH {td.MENTIONS} SELECT citing, ord, md5(array_to_string(list_filter([trim(context), trim(coalesce(section, '')), trim(marker)], lambda x: x <> ''), ' ')) AS digest FROM mentions"),
    "bundle_detection": (
        bundle_detection,
        f"""WITH {td.MENTIONS}, a AS (SELECT *, instr(context, marker) AS i FROM mentions), r AS (SELECT citing, ord, context, marker, i, CASE WHEN i > 0 THEN list_sort(list_distinct(list_transform(list_filter({_MARK_ROWS}, lambda m: instr(context, m.marker) > 0 AND abs(instr(context, m.marker) - i) <= 80), lambda m: m.ref))) ELSE [] END AS refs FROM a)
        SELECT citing, ord, CASE WHEN len(refs) > 1 THEN len(refs) ELSE 1 END::INT AS size, CASE WHEN len(refs) > 1 THEN array_to_string(refs, ',') ELSE '' END AS refs,
        CASE WHEN len(refs) <= 1 THEN 'single' WHEN contains(substring(context, greatest(i - 80, 1), i + length(marker) + 80 - greatest(i - 80, 1)), ';') THEN 'semicolon_separated' ELSE 'parenthetical_group' END AS pattern FROM r""",
    ),
    "marker_position": (
        marker_position,
        rf"""WITH {td.MENTIONS}, w AS (SELECT citing, ord, context, CASE WHEN ord % 3 = 1 THEN marker || ' ;' WHEN ord % 5 = 4 THEN 'Smith et al. 2010' ELSE marker END AS w FROM mentions),
        v AS (SELECT *, trim(regexp_replace(regexp_replace(w, '\s+', ' ', 'g'), '[,;:]+$', '')) AS v FROM w), n AS (SELECT *, regexp_extract(v, '[A-Za-z0-9_]+\s+et\s+al\.?,?\s*[0-9]{{4}}') AS n FROM v)
        SELECT citing, ord, CASE WHEN instr(context, w) > 0 THEN instr(context, w) - 1 WHEN instr(context, v) > 0 THEN instr(context, v) - 1 WHEN n <> '' AND instr(context, n) > 0 THEN instr(context, n) - 1 ELSE length(context) // 2 END::INT AS "at" FROM n""",
    ),
    "citing_windows": (citing_windows, None),
    "annotated_contexts": (annotated_contexts, None),
    "claim_mentions": (
        claim_mentions,
        f"WITH {_CLAIMS} SELECT seed, count(*) AS n, count(*) FILTER (WHERE m.marker IS NULL) AS unknown, count(*) FILTER (WHERE m.section IS NOT NULL) AS placed FROM claims c LEFT JOIN (SELECT citing || ':' || ord AS mention_id, marker, section FROM mentions) m USING (mention_id) GROUP BY seed",
    ),
    "singleton_families": (
        singleton_families,
        f"""WITH {_OUT}, claims AS (SELECT citing || '-' || ord AS record_id, citing || ':' || (ord + CASE WHEN ord % 9 = 8 THEN 1000 ELSE 0 END) AS mention_id, cited AS seed, ord % 4 <> 3 AS in_scope, CASE WHEN ord % 5 <> 4 THEN context END AS claim FROM mentions),
        s AS (SELECT citing % 50 AS seed, count(*) AS probed, count(*) FILTER (WHERE outcome = 'success') AS successful FROM harvested WHERE citing % 50 <> 7 GROUP BY 1)
        SELECT 'fam-' || record_id AS family_id, seed, md5(claim) AS tracked, mention_id AS mention, coalesce(probed, 0) AS probed, coalesce(successful, 0) AS successful, round(coalesce(successful / probed, 0), 6) AS rate FROM claims LEFT JOIN s USING (seed) WHERE in_scope AND length(claim) > 0""",
    ),
    "claim_engagement": (claim_engagement, f"WITH {_ENGAGED} SELECT seed, claim_index, claim_type, n_direct, n_indirect, md5(titles) AS titles, rank FROM engaged"),
    "discovery_seeds": (
        discovery_seeds,
        f"""WITH {_ENGAGED}, f AS (SELECT seed, claim_index, seed % 3 <> 1 AS ranked, row_number() OVER (PARTITION BY seed ORDER BY CASE WHEN seed % 3 <> 1 THEN rank ELSE claim_index END) AS place FROM engaged WHERE seed % 5 <> 4 AND claim_type = 'finding' AND (seed % 3 = 1 OR n_direct > 0))
        SELECT seed, claim_index, place::INT AS place, ranked FROM f WHERE place <= 7""",
    ),
    "grounding_lookup": (
        grounding_lookup,
        f"""WITH {td.FAMILIES}, t AS (SELECT * FROM families WHERE doi % 4 <> 2), c AS (SELECT tracked, arg_min(status, family_id) AS s FROM t GROUP BY 1)
        SELECT f.family_id AS seed_id, coalesce(CASE WHEN f.doi % 3 <> 0 THEN t.status ELSE c.s END, 'not_attempted') AS status FROM families f LEFT JOIN t ON t.family_id = f.family_id LEFT JOIN c ON c.tracked = f.tracked""",
    ),
    "relevance_filter": (relevance_filter, "SELECT doc_id AS paper_id, source FROM documents WHERE doc_id % 7 = 0 OR doc_id % 5 = 0 OR doc_id % 3 = 0"),
    "cluster_merge": (
        cluster_merge,
        f"""WITH {td.FAMILIES}, f AS (SELECT substring(family_id, 5, 9)::BIGINT AS idx, family_id, citing_ids, status <> 'not_attempted' AS traced FROM families), g AS (SELECT idx // 4 AS cluster, idx % 4 = 0 AND idx % 16 <> 12 AS rep, * FROM f),
        m AS (SELECT cluster, max(family_id) FILTER (WHERE rep) AS family_id, array_to_string(list_sort(list_distinct(flatten(list(citing_ids)))), ',') AS papers, count(*) AS members, bool_or(rep AND traced) AS own, arg_min(family_id, idx) FILTER (WHERE traced AND NOT rep) AS heir, count(*) FILTER (WHERE traced AND NOT rep) AS others FROM g GROUP BY cluster)
        SELECT cluster, family_id, papers, members, CASE WHEN own THEN family_id ELSE heir END AS trace_of, CASE WHEN own THEN others ELSE 0 END AS dropped_traces FROM m WHERE family_id IS NOT NULL""",
    ),
    "family_metrics": (
        family_metrics,
        f"WITH {td.EDGES}, w AS (SELECT seed, sum(copies)::BIGINT AS t, (sum(copies) - count(*))::BIGINT AS c FROM edges GROUP BY seed) SELECT seed, t AS total_edges, c AS collapsed, u AS unique_edges FROM w JOIN (SELECT seed, count(*) AS u FROM edges WHERE citing % 2 = 0 GROUP BY seed) USING (seed)",
    ),
    "readded_papers": (readded_papers, "SELECT doc_id AS paper_id, doc_id - doc_id % 3 AS stands_for FROM documents WHERE (doc_id - doc_id % 3) % 9 <> 3"),
}
