"""BM25 retrieval and evidence selection."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.text import counts, tokens
from .rounds import cut, dealt

K1, B = 1.2, 0.75


#: The term under which a document's own row stands among its postings; no token is empty.
_OWN = ""


def postings(docs: DataFrame, key: str, text: str = "text") -> DataFrame:
    """(key, term, tf, length) of every document; length counts tokens without stop words."""
    split = docs.select(key, tokens(F.coalesce(F.col(text), F.lit(""))).alias("t")).withColumn("length", F.size("t"))
    return split.select(key, "length", F.explode("t").alias("term")).groupBy(key, "term", "length").agg(F.count("*").alias("tf"))


def asked_postings(docs: DataFrame, asked: DataFrame, key: str, text: str, by: list[str], most: int = 500_000) -> DataFrame:
    """(by, key, term, length, tf) of the terms of ``asked`` (by, term), and under ``_OWN`` one row for each document of its groups.

    The only reading of the texts: counts, lengths, document frequencies and scores all come from what is returned. A text's terms
    are counted inside its row and dealt by document, so that no task holds the counts of its whole split. Up to ``most`` different
    terms are broadcast (they are counted first), so that other terms go before anything is shuffled.
    """
    split = docs.select(*by, key, tokens(F.coalesce(F.col(text), F.lit(""))).alias("t"))
    own = F.struct(F.lit(_OWN).alias("term"), F.lit(1).cast("long").alias("tf"))
    each = split.select(*by, key, F.size("t").alias("length"), F.inline(F.array_insert(counts(F.col("t")), 1, own)))
    groups = asked.select(*by).distinct() if by else docs.sparkSession.range(1).select()
    wanted = asked.select(*by, "term").distinct().unionByName(groups.withColumn("term", F.lit(_OWN)))
    few = wanted.count() <= most
    each = each.join(F.broadcast(wanted) if few else wanted, [*by, "term"], "left_semi")
    # rows of one key and length are one document
    return dealt(each, key, rows=5_000, n=docs.count()).groupBy(*by, key, "term", "length").agg(F.sum("tf").alias("tf"))


def bm25(queries: DataFrame, docs: DataFrame, query_key: str, doc_key: str, limit: int | None = 5, query_text: str = "text", doc_text: str = "text", within: str | None = None, most: int = 500_000) -> DataFrame:
    """(query_key, doc_key, score, rank): documents by BM25 for each query, those of score 0 left out.

    Texts are tokenised once into a kept table of the terms asked for; document frequencies and lengths are its aggregates, the
    rest is one equi-join on terms. A query term that occurs twice counts twice. Ties go to the lower key. With
    ``within``, a column of both sides, documents of each of its values are a collection with statistics of its
    own, and a query meets those of its value alone; rows without a value meet nothing. Up to ``most`` rows (query, term) are broadcast.
    """
    by = [within] if within else []
    asked = cut(queries.select(*by, query_key, F.explode(tokens(F.coalesce(F.col(query_text), F.lit("")))).alias("term")).groupBy(*by, query_key, "term").agg(F.count("*").alias("qtf")))
    kept = cut(asked_postings(docs, asked, doc_key, doc_text, by))
    held = kept.where(F.col("term") != _OWN)
    stats = kept.where(F.col("term") == _OWN).groupBy(*by).agg(F.sum("tf").alias("n_docs"), (F.sum(F.col("tf") * F.col("length")) / F.sum("tf")).alias("mean_length"))
    df = held.groupBy(*by, "term").agg(F.sum(F.lit(1)).alias("df"))
    idf = F.log(1 + (F.col("n_docs") - F.col("df") + 0.5) / (F.col("df") + 0.5))
    known = df.join(stats, by) if by else df.crossJoin(F.broadcast(stats))  # without ``by`` one row
    weighted = known.select(*by, "term", idf.alias("idf"), F.when(F.col("mean_length") == 0, 1.0).otherwise(F.col("mean_length")).alias("mean_length"))
    part = F.col("qtf") * F.col("idf") * F.col("tf") * (K1 + 1) / (F.col("tf") + K1 * (1 - B + B * F.col("length") / F.col("mean_length")))
    known = asked.join(weighted, [*by, "term"])
    if asked.count() <= most:  # then a document's terms meet them where its scores are added up, and no task adds up those of its whole split
        held, known = dealt(held, doc_key, rows=200_000), F.broadcast(known)
    scored = held.join(known, [*by, "term"]).groupBy(*by, query_key, doc_key).agg(F.sum(part).alias("score")).where("score > 0")
    scored = scored.drop(*[c for c in by if c not in (query_key, doc_key)])
    if limit is None:
        return scored
    order = Window.partitionBy(query_key).orderBy(F.desc(F.round("score", 9)), doc_key)
    return scored.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= limit)


def in_claim_family(scored: DataFrame, papers: DataFrame, claim_key: str, paper_key: str, share: float = 0.22) -> DataFrame:
    """Every (claim, paper) with its score and whether it reaches ``share`` of the claim's best; papers without a hit score 0."""
    best = scored.groupBy(claim_key).agg(F.max("score").alias("best"))
    every = papers.select(claim_key, paper_key).join(scored.select(claim_key, paper_key, "score"), [claim_key, paper_key], "left").join(best, claim_key, "left")
    score, best_score = F.coalesce("score", F.lit(0.0)), F.coalesce("best", F.lit(0.0))
    return every.select(claim_key, paper_key, score.alias("score"), ((best_score > 0) & (score >= share * best_score)).alias("in_family"))


def evidence_status(mode: Column, resolved: Column, fetched: Column, matches: Column, abstract_only: Column) -> Column:
    """How evidence retrieval for a task ended."""
    return (
        F.when(mode.isin("skip_low_information", "manual_review_extraction_limited"), "not_attempted")
        .when(~resolved, "unresolved_cited_paper")
        .when(~fetched, "no_fulltext")
        .when(matches == 0, "no_matches")
        .when(abstract_only, "abstract_only_matches")
        .otherwise("retrieved")
    )


def rerank(candidates: DataFrame, scores: DataFrame, group: str, key: str, limit: int = 5) -> DataFrame:
    """Candidates (group, key, bm25) in order of replayed scores (group, key, score); BM25's first stays as a floor.

    Scores of unknown keys are dropped; a floor without score comes last.
    """
    first = Window.partitionBy(group).orderBy(F.desc("bm25"), key)
    ranked = candidates.withColumn("bm25_rank", F.row_number().over(first)).join(scores, [group, key], "left")
    kept = ranked.where(F.col("score").isNotNull() | (F.col("bm25_rank") == 1))
    order = Window.partitionBy(group).orderBy(F.col("score").desc_nulls_last(), F.desc("bm25"), key)
    return kept.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= limit)
