"""Queries on the citation graph and claim families."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import rules, text
from ..operators import claims, graph
from ..sources import testdata as td


def edge_classify(spark, sf):
    p = td.papers(spark, sf)
    flags = rules.edge_flags(F.col("paper_type"), F.col("title"), F.col("refs"))
    return p.select("paper_id", *[c.alias(n) for n, c in flags.items()])


def auditability(spark, sf):
    return td.papers(spark, sf).select("paper_id", rules.auditability(F.col("availability"), F.col("hint")).alias("status"))


def neighborhood_counts(spark, sf):
    return graph.neighborhood(td.edges(spark, sf))


def probe_selection(spark, sf):
    return graph.probe_selection(td.edges(spark, sf), 10).select("seed", "citing", "selected", "reason")


def _metrics(spark, sf):
    return graph.screen_metrics(td.edges(spark, sf))


def screen_metrics(spark, sf):
    m = _metrics(spark, sf)
    return m.select(*[F.round(c, 6).alias(c) if t == "double" else F.col(c) for c, t in m.dtypes])


def screen_decision(spark, sf):
    return graph.screen(_metrics(spark, sf)).select("seed", "auditable", "decision", "rule")


def family_profile(spark, sf):
    return graph.screen(_metrics(spark, sf)).select("seed", F.array_join("profile", ",").alias("profile"))


def priority_rank(spark, sf):
    return graph.assign_priorities(graph.screen(_metrics(spark, sf))).select("seed", "metric_priority", "priority")


def bigram_jaccard_pairs(spark, sf):
    p = td.papers(spark, sf).select("paper_id", text.bigrams(text.normalize_title(F.col("title"))).alias("grams"))
    return graph.similar_sets(p, 0.3).withColumn("jaccard", F.round("jaccard", 6))


def dup_pairs_by_rule(spark, sf):
    return graph.duplicate_pairs(td.papers(spark, sf))


def greedy_paper_groups(spark, sf):
    p = td.papers(spark, sf).withColumn("seed", F.col("paper_id") % 20).withColumn("ord", F.col("paper_id"))
    return graph.duplicate_groups(p, "seed")


def ref_match_priority(spark, sf):
    """For each wanted paper (doi, title) the best reference: by DOI first, then by title."""
    p = td.papers(spark, sf).select("paper_id", "doi", text.normalize_title(F.col("title")).alias("t"))
    wanted = p.where("paper_id % 4 = 0").select(F.col("paper_id").alias("want"), F.when(F.col("paper_id") % 8 != 0, F.col("doi")).alias("w_doi"), F.col("t").alias("w_t"))
    refs = p.where("paper_id % 4 <> 0").select(F.col("paper_id").alias("ref"), "doi", "t")
    # the best reference of a DOI or title is its least: one row of each is joined, however many share it
    by_doi = wanted.join(refs.groupBy("doi").agg(F.min("ref").alias("ref")), F.col("w_doi") == F.col("doi")).select("want", "ref", F.lit(1).alias("by_doi"))
    by_title = wanted.join(refs.groupBy("t").agg(F.min("ref").alias("ref")), F.col("w_t") == F.col("t")).select("want", "ref", F.lit(0).alias("by_doi"))
    best = by_doi.unionByName(by_title).groupBy("want").agg(F.min(F.struct(-F.col("by_doi"), "ref", "by_doi")).alias("m"))
    return best.select("want", "m.ref", "m.by_doi")


def claim_exact_collapse(spark, sf):
    return claims.exact_collapse(td.families(spark, sf)).select("doi", "claim", "family_id", "members", "n_mentions")


def claim_merge_rollup(spark, sf):
    return claims.exact_collapse(td.families(spark, sf)).select("family_id", "n_papers", "papers", "merged")


def claim_near_pairs(spark, sf):
    return claims.near_duplicate_pairs(td.families(spark, sf))


def greedy_claim_families(spark, sf):
    f = td.families(spark, sf)
    return claims.greedy_families(f, claims.near_duplicate_pairs(f))


def shortlist_rank(spark, sf):
    return claims.shortlist(td.families(spark, sf))


def diverse_shortlist(spark, sf):
    return claims.diverse_shortlist(td.families(spark, sf))


def _any(patterns) -> str:
    return "(" + " OR ".join(f"regexp_matches(title, '(?i){p}')" for p in patterns) + ")"


_FLAGS = f"""lower(coalesce(paper_type, '')) IN ('review', 'literature-review') AS is_review,
  lower(coalesce(paper_type, '')) IN ('editorial', 'paratext', 'peer-review') OR {_any(rules.COMMENTARY_TITLES)} AS is_commentary,
  lower(coalesce(paper_type, '')) IN ('letter', 'erratum', 'correction') AS is_letter, lower(coalesce(paper_type, '')) IN ('book-chapter', 'book-section') AS is_book_chapter,
  lower(coalesce(paper_type, '')) IN ('posted-content', 'preprint') AS is_preprint, lower(coalesce(paper_type, '')) IN ('article', 'journal-article') AS is_journal_article,
  NOT (lower(coalesce(paper_type, '')) IN ('review', 'literature-review', 'editorial', 'paratext', 'peer-review', 'letter', 'erratum', 'correction', 'book-chapter', 'book-section') OR {_any(rules.COMMENTARY_TITLES)}) AS is_primary_like,
  coalesce(refs > 100, false) AS high_reference_count"""
_KINDS = ("primary_like", "review", "commentary", "letter", "book_chapter", "journal_article", "preprint")
_METRICS = (
    f"{td.EDGES}, flagged AS (SELECT *, {_FLAGS} FROM edges), metrics AS (SELECT seed, sum(copies)::BIGINT AS total_edges, count(*) AS unique_edges, "
    + ", ".join(f"count(*) FILTER (WHERE status = '{s}') AS n_{s}" for s in graph.STATUSES)
    + ", "
    + ", ".join(f"count(*) FILTER (WHERE is_{k}) AS n_{k}" for k in _KINDS)
    + ", sum(copies)::BIGINT - count(*) AS collapsed, count(*) FILTER (WHERE status IN ('auditable_structured', 'auditable_pdf')) / count(*) AS auditable_coverage, "
    + ", ".join(f"count(*) FILTER (WHERE is_{k}) / count(*) AS {k}_rate" for k in _KINDS)
    + " FROM flagged GROUP BY seed)"
)
_SCREENED = f"""{_METRICS}, screened AS (SELECT *, n_auditable_structured + n_auditable_pdf AS auditable,
  CASE WHEN unique_edges = 0 THEN 'no_edges' WHEN n_auditable_structured + n_auditable_pdf < 3 THEN 'too_few_auditable' WHEN auditable_coverage < 0.3 THEN 'low_coverage' ELSE 'greenlight' END AS rule FROM metrics),
  decided AS (SELECT *, CASE WHEN rule = 'greenlight' THEN 'greenlight' ELSE 'deprioritize' END AS decision FROM screened)"""
_NORM = "trim(regexp_replace(regexp_replace(lower({0}), '[^\\p{{L}}\\p{{N}}\\s]', '', 'g'), '\\s+', ' ', 'g'))"
_CLAIM = "trim(regexp_replace(regexp_replace(lower({0}), '[^a-z0-9\\s]', ' ', 'g'), '\\s+', ' ', 'g'))"
_GRAMS = "list_distinct(list_transform(range(1, len(string_split({0}, ' '))), lambda k: string_split({0}, ' ')[k] || ' ' || string_split({0}, ' ')[k + 1]))"
_PAPERS = f"{td.PAPERS}, p AS (SELECT *, {_NORM.format('title')} AS t FROM papers), g AS (SELECT *, {_GRAMS.format('t')} AS grams FROM p)"
_WORDS = "list_distinct(list_filter(string_split({0}, ' '), lambda x: length(x) >= 3))"
_OPERATORS = "[" + ", ".join(f"'{w}'" for w in claims.OPERATORS) + "]"
_ORDER = "CASE status WHEN 'grounded' THEN 0 WHEN 'ambiguous' THEN 1 ELSE 2 END, -n_mentions, -len(citing_ids), family_id"
_RANK = "CASE status WHEN 'grounded' THEN 0 WHEN 'ambiguous' THEN 1 WHEN 'not_attempted' THEN 2 WHEN 'not_found' THEN 3 WHEN 'no_seed_fulltext' THEN 4 ELSE 9 END"

QUERIES = {
    "edge_classify": (edge_classify, f"WITH {td.PAPERS} SELECT paper_id, {_FLAGS} FROM papers"),
    "auditability": (
        auditability,
        f"""WITH {td.PAPERS} SELECT paper_id, CASE WHEN availability = 'unavailable' THEN 'not_auditable' WHEN availability = 'abstract_only' THEN 'partially_auditable'
        WHEN coalesce(hint IN ('biorxiv_xml', 'pmc_xml', 'pubmed_xml', 'jats_xml'), false) THEN 'auditable_structured' ELSE 'auditable_pdf' END AS status FROM papers""",
    ),
    "neighborhood_counts": (neighborhood_counts, f"WITH {td.EDGES} SELECT seed, count(*) AS total, count(*) FILTER (WHERE availability = 'available') AS available, count(*) FILTER (WHERE availability = 'abstract_only') AS abstract_only, count(*) FILTER (WHERE availability NOT IN ('available', 'abstract_only')) AS unavailable FROM edges GROUP BY seed"),
    "probe_selection": (
        probe_selection,
        f"""WITH {td.EDGES}, r AS (SELECT seed, citing, availability = 'available' AS has, row_number() OVER (PARTITION BY seed ORDER BY availability = 'available' DESC, coalesce(year, 0) DESC, citing) AS rank, count(*) OVER (PARTITION BY seed) AS n FROM edges)
        SELECT seed, citing, has AND (n <= 10 OR rank <= 10) AS selected, CASE WHEN has AND n <= 10 THEN 'selected_all_auditable' WHEN has AND rank <= 10 THEN 'selected_full_text_available' WHEN NOT has THEN 'excluded_no_full_text' ELSE 'excluded_probe_budget' END AS reason FROM r""",
    ),
    "screen_metrics": (
        screen_metrics,
        f"WITH {_METRICS} SELECT * REPLACE (round(auditable_coverage, 6) AS auditable_coverage, " + ", ".join(f"round({k}_rate, 6) AS {k}_rate" for k in _KINDS) + ") FROM metrics",
    ),
    "screen_decision": (screen_decision, f"WITH {_SCREENED} SELECT seed, auditable, decision, rule FROM decided"),
    "family_profile": (
        family_profile,
        f"""WITH {_SCREENED} SELECT seed, concat_ws(',', CASE WHEN unique_edges <= 5 THEN 'small_family' END, CASE WHEN primary_like_rate >= 0.7 THEN 'primary_empirical_heavy'
        WHEN review_rate >= 0.4 AND primary_like_rate >= 0.2 THEN 'mixed_primary_review' WHEN review_rate >= 0.5 THEN 'review_mediated' END, CASE WHEN collapsed / total_edges >= 0.2 THEN 'duplicate_heavy' END, CASE WHEN auditable_coverage < 0.5 THEN 'low_access' END) AS profile FROM decided""",
    ),
    "priority_rank": (
        priority_rank,
        f"""WITH {_SCREENED}, best AS (SELECT seed AS b FROM decided WHERE decision = 'greenlight' ORDER BY round(auditable * primary_like_rate, 9) DESC, seed LIMIT 1)
        SELECT seed, CASE WHEN decision = 'deprioritize' THEN 'not_now' WHEN auditable >= 10 AND primary_like_rate >= 0.5 THEN 'first' WHEN auditable >= 5 THEN 'later' ELSE 'caution' END AS metric_priority,
        CASE WHEN decision = 'deprioritize' THEN 'not_now' WHEN seed = b THEN 'first' WHEN auditable >= 5 THEN 'later' ELSE 'caution' END AS priority FROM decided CROSS JOIN best""",
    ),
    "bigram_jaccard_pairs": (
        bigram_jaccard_pairs,
        f"""WITH {_PAPERS}, c AS (SELECT paper_id, grams, len(grams) AS n, min(paper_id) OVER (PARTITION BY list_sort(grams)) AS rep FROM g WHERE len(grams) > 0),
        s AS (SELECT paper_id, n, unnest(grams) AS gram FROM c WHERE paper_id = rep), m AS (SELECT a.paper_id AS a, b.paper_id AS b, a.n AS na, b.n AS nb, count(*) AS shared FROM s a JOIN s b ON a.gram = b.gram AND a.paper_id < b.paper_id GROUP BY ALL)
        SELECT a, b, shared, round(shared / (na + nb - shared), 6) AS jaccard FROM m WHERE shared / (na + nb - shared) >= 0.3 UNION ALL SELECT rep, paper_id, n, 1 FROM c WHERE paper_id <> rep""",
    ),
    "dup_pairs_by_rule": (
        dup_pairs_by_rule,
        f"""WITH {_PAPERS}, e AS (SELECT *, lower(string_split(authors[1], ' ')[-1]) AS f, lower(string_split(authors[-1], ' ')[-1]) AS l FROM g), k AS (SELECT *, min(paper_id) OVER (PARTITION BY t, f, l, year) AS rep FROM e),
        u AS (SELECT paper_id, unnest(list_distinct(['doi:' || doi, 'title:' || f || '|' || t, 'title:' || l || '|' || t])) AS key FROM e), s AS (SELECT paper_id, unnest(grams) AS gram FROM k WHERE paper_id = rep),
        n AS (SELECT a.paper_id AS a, b.paper_id AS b, count(*) AS shared FROM s a JOIN s b ON a.gram = b.gram AND a.paper_id < b.paper_id GROUP BY ALL),
        m AS (SELECT min(paper_id) OVER (PARTITION BY key) AS a, paper_id AS b FROM u UNION SELECT rep, paper_id FROM k WHERE len(grams) > 0
          UNION SELECT a, b FROM n JOIN e x ON x.paper_id = a JOIN e y ON y.paper_id = b WHERE x.t <> y.t AND list_has_any([x.f, x.l], [y.f, y.l]) AND coalesce(abs(x.year - y.year) <= 2, true) AND shared / (len(x.grams) + len(y.grams) - shared) >= 0.7)
        SELECT a, b, CASE WHEN x.doi = y.doi THEN 'doi' WHEN x.t = y.t AND list_has_any([x.f, x.l], [y.f, y.l]) THEN 'title' ELSE 'similar_title' END AS reason FROM m JOIN e x ON x.paper_id = a JOIN e y ON y.paper_id = b WHERE a < b""",
    ),
    "greedy_paper_groups": (greedy_paper_groups, None),
    "ref_match_priority": (
        ref_match_priority,
        f"""WITH {_PAPERS}, w AS (SELECT paper_id AS want, CASE WHEN paper_id % 8 <> 0 THEN doi END AS w_doi, t AS w_t FROM p WHERE paper_id % 4 = 0), f AS (SELECT paper_id AS ref, doi, t FROM p WHERE paper_id % 4 <> 0),
        m AS (SELECT want, ref, 1 AS by_doi FROM w JOIN f ON w_doi = doi UNION ALL SELECT want, ref, 0 FROM w JOIN f ON w_t = t)
        SELECT want, ref, by_doi::INT AS by_doi FROM m QUALIFY row_number() OVER (PARTITION BY want ORDER BY by_doi DESC, ref) = 1""",
    ),
    "claim_exact_collapse": (claim_exact_collapse, f"WITH {td.FAMILIES} SELECT doi, {_CLAIM.format('tracked')} AS claim, first(family_id ORDER BY {_ORDER}) AS family_id, count(*) AS members, sum(n_mentions)::BIGINT AS n_mentions FROM families GROUP BY 1, 2"),
    "claim_merge_rollup": (
        claim_merge_rollup,
        f"""WITH {td.FAMILIES}, c AS (SELECT doi, {_CLAIM.format('tracked')} AS claim, first(family_id ORDER BY {_ORDER}) AS family_id, list_sort(list_distinct(flatten(list(citing_ids)))) AS p, list_sort(list(family_id)) AS ids FROM families GROUP BY 1, 2)
        SELECT family_id, len(p)::INT AS n_papers, array_to_string(p, ',') AS papers, array_to_string(list_filter(ids, lambda x: x <> family_id), ',') AS merged FROM c""",
    ),
    "claim_near_pairs": (
        claim_near_pairs,
        f"""WITH {td.FAMILIES}, f AS (SELECT doi, family_id, {_CLAIM.format("coalesce(normalized, tracked)")} AS claim, {_CLAIM.format("coalesce(support, '')")} AS support FROM families WHERE status IN ('grounded', 'ambiguous')),
        t AS (SELECT *, {_WORDS.format('claim')} AS words, {_WORDS.format('support')} AS sw FROM f),
        j AS (SELECT a.doi, a.family_id AS a, b.family_id AS b, a.claim = b.claim AS same, a.support <> '' AND b.support <> '' AND NOT list_has_any(list_concat(list_filter(a.words, lambda x: NOT list_contains(b.words, x)), list_filter(b.words, lambda x: NOT list_contains(a.words, x))), {_OPERATORS}) AS clear,
          CASE WHEN len(a.sw) = 0 AND len(b.sw) = 0 THEN 1 ELSE len(list_intersect(a.sw, b.sw)) / (len(a.sw) + len(b.sw) - len(list_intersect(a.sw, b.sw))) END AS jac, contains(a.support, b.claim) OR contains(b.support, a.claim) AS holds FROM t a JOIN t b ON a.doi = b.doi AND a.family_id < b.family_id)
        SELECT doi, a, b, CASE WHEN same THEN 'equal_claim' WHEN clear AND jac >= 0.6 THEN 'similar_support' ELSE 'contained' END AS reason FROM j WHERE same OR (clear AND (jac >= 0.6 OR holds))""",
    ),
    "greedy_claim_families": (greedy_claim_families, None),
    "shortlist_rank": (shortlist_rank, f"WITH {td.FAMILIES} SELECT doi, family_id, status, n_mentions, (row_number() OVER (PARTITION BY doi ORDER BY {_RANK}, n_mentions DESC, family_id))::INT AS rank FROM families QUALIFY row_number() OVER (PARTITION BY doi ORDER BY {_RANK}, n_mentions DESC, family_id) <= 5"),
    "diverse_shortlist": (diverse_shortlist, None),
}
