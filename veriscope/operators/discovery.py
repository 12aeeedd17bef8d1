"""From claims to families: engagement, discovery seeds, single families, clusters, filters."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def claim_mentions(claims: DataFrame, mentions: DataFrame) -> DataFrame:
    """Claim records with the mention they come from, where it is known."""
    return claims.join(mentions, "mention_id", "left")


def singleton_families(claims: DataFrame, stats: DataFrame) -> DataFrame:
    """One family for each record of ``claims`` (record_id, mention_id, citing, seed, in_scope, claim) that is in scope and has a claim, with its seed's probe figures."""
    own = claims.where(F.col("in_scope") & (F.length("claim") > 0))
    one = F.lit(1)
    return own.join(stats, "seed", "left").select(
        F.concat(F.lit("fam-"), F.col("record_id").cast("string")).alias("family_id"), "seed", F.col("claim").alias("tracked"), F.array("record_id").alias("records"), F.array("mention_id").alias("mentions"), F.array("citing").alias("papers"),
        F.lit("not_attempted").alias("status"), F.coalesce("probed", F.lit(0)).alias("probed"), F.coalesce("successful", F.lit(0)).alias("successful"), F.coalesce("rate", F.lit(0.0)).alias("rate"), one.alias("n_mentions"), one.alias("n_papers"), one.alias("n_auditable"),
    )


def comparison_text(grounded: F.Column, tracked: F.Column) -> F.Column:
    """The claim by which families are compared: the grounded one, else the tracked one."""
    return F.coalesce(F.nullif(F.trim(grounded), F.lit("")), tracked)


def engagement(claims: DataFrame, matches: DataFrame) -> DataFrame:
    """``claims`` (seed, claim_index, ...) with direct and indirect counts of ``matches`` (seed, claim_index, direct, title), titles of the direct ones, and rank in the seed.

    Claims without matches count 0; more direct ones come first, then more indirect ones, then the earlier claim.
    """
    counted = matches.groupBy("seed", "claim_index").agg(F.count_if("direct").alias("n_direct"), F.count_if(~F.col("direct")).alias("n_indirect"), F.array_sort(F.collect_list(F.when(F.col("direct"), F.col("title")))).alias("titles"))
    zero = F.lit(0).cast("long")
    out = claims.join(counted, ["seed", "claim_index"], "left").withColumns({"n_direct": F.coalesce("n_direct", zero), "n_indirect": F.coalesce("n_indirect", zero), "titles": F.coalesce("titles", F.array().cast("array<string>"))})
    return out.withColumn("rank", F.row_number().over(Window.partitionBy("seed").orderBy(F.desc("n_direct"), F.desc("n_indirect"), "claim_index")))


def discovery_seeds(ranked: DataFrame, results: DataFrame, top: int) -> DataFrame:
    """(seed, claim_index, place) of up to ``top`` findings of each completed seed of ``results`` (seed, status, ranked).

    Of a ranked seed those with a direct engagement count, in order of rank; of another one the first findings.
    """
    j = ranked.join(results.where("status = 'completed'"), "seed").where((F.col("claim_type") == "finding") & (~F.col("ranked") | (F.col("n_direct") > 0)))
    place = F.row_number().over(Window.partitionBy("seed").orderBy(F.when(F.col("ranked"), F.col("rank")).otherwise(F.col("claim_index"))))
    return j.withColumn("place", place).where(F.col("place") <= top).select("seed", "claim_index", "place", "ranked")


def grounding(seeds: DataFrame, traces: DataFrame) -> DataFrame:
    """``seeds`` (seed_id, family_id, tracked) with status of a trace (family_id, tracked, status, ord): by the family's id if there is one, else the first of its claim; without one ``not_attempted``."""
    by_id = traces.groupBy("family_id").agg(F.min_by("status", "ord").alias("s"))
    by_claim = traces.groupBy("tracked").agg(F.min_by("status", "ord").alias("t"))
    j = seeds.join(by_id, "family_id", "left").join(by_claim, "tracked", "left")
    status = F.when(F.col("family_id").isNotNull(), F.col("s")).otherwise(F.col("t"))
    return j.select("seed_id", "family_id", "tracked", F.coalesce(status, F.lit("not_attempted")).alias("status"))


def keep_relevant(papers: DataFrame, answers: DataFrame) -> DataFrame:
    """``papers`` without those that an answer (paper_id, relevant) calls irrelevant; no answer, or an unreadable one, keeps a paper."""
    out = answers.where(~F.col("relevant")).select("paper_id").distinct()
    return papers.join(out, "paper_id", "left_anti")


def merge_clusters(candidates: DataFrame, clusters: DataFrame) -> DataFrame:
    """One family for each cluster: the representative's id with the members' papers, and what becomes of the grounding.

    candidates (index, family_id, papers, traced), clusters (cluster, index, representative: whether the member is it). A family
    keeps its representative's trace, inherits that of its first member that has one, or has none; a cluster whose representative is unknown is left out.
    """
    j = clusters.join(candidates, "index")
    first = F.min_by(F.when(F.col("traced"), F.col("family_id")), F.when(F.col("traced") & ~F.col("representative"), F.col("index")))
    merged = j.groupBy("cluster").agg(
        F.max(F.when(F.col("representative"), F.col("family_id"))).alias("family_id"), F.array_sort(F.array_distinct(F.flatten(F.collect_list("papers")))).alias("papers"), F.count("*").alias("members"),
        F.bool_or(F.col("representative") & F.col("traced")).alias("own"), first.alias("heir"), F.count_if(F.col("traced") & ~F.col("representative")).alias("others"),
    )
    merged = merged.where("family_id is not null")
    trace = F.when(F.col("own"), F.col("family_id")).otherwise(F.col("heir"))
    return merged.select("cluster", "family_id", "papers", "members", trace.alias("trace_of"), F.when(F.col("own"), F.col("others")).otherwise(F.lit(0)).cast("long").alias("dropped_traces"))


def family_metrics(neighbourhood: DataFrame, family: DataFrame, seed: str = "seed") -> DataFrame:
    """The metrics of a claim's own edges, but total and collapsed edges of the whole neighbourhood."""
    whole = neighbourhood.select(seed, F.col("total_edges").alias("_total"), F.col("collapsed").alias("_collapsed"))
    return family.join(whole, seed).withColumns({"total_edges": F.col("_total"), "collapsed": F.col("_collapsed")}).drop("_total", "_collapsed")


def readd_collapsed(kept: DataFrame, groups: DataFrame) -> DataFrame:
    """(paper_id, stands_for): every kept paper, and each collapsed one with the paper that stands for it."""
    gone = groups.where(F.col("paper_id") != F.col("representative")).join(kept.select(F.col("paper_id").alias("representative")), "representative", "left_semi")
    return kept.select("paper_id", F.col("paper_id").alias("stands_for")).unionByName(gone.select("paper_id", F.col("representative").alias("stands_for")))
