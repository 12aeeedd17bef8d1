"""Papers by identifiers and metadata: sources are asked in waves, each only for what earlier ones left."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import normalize_title, surname, years_close
from .rounds import cut

# The identifiers in the order in which they are asked for, and the text for a paper without locator.
IDENTIFIERS = ("doi", "pmid", "pmcid")
NO_LOCATOR = "Cited paper metadata is missing from the classification artifact"
ABSTRACT_ONLY, NO_FULL_TEXT = "Only abstract text is available", "No open-access full text available"

Sources = dict[str, DataFrame]


def _ask(open_: DataFrame, by: str, name: str, source: DataFrame) -> DataFrame:
    """``open_`` with (paper_id, error) of a source's answers to one kind of key; a key without answer is an error too."""
    held = source.where(F.col("by") == by).select(F.col("key").alias(by), F.col("paper_id").alias("_paper"), F.col("error").alias("_error"))
    j = open_.join(held, by, "left")
    missed = F.when(F.col("_paper").isNull(), F.coalesce("_error", F.concat(F.lit(f"{name}: no answer for {by} "), F.col(by).cast("string"))))
    return j.withColumn("paper_id", F.col("_paper")).withColumn("step", F.lit(f"{name}:{by}")).withColumn("error", missed).withColumn("asked", F.array_append("asked", F.lit(f"{name}:{by}"))).drop("_paper", "_error")


def resolve(wanted: DataFrame, sources: Sources, candidates: Sources) -> DataFrame:
    """(want, paper_id, step, error, asked) for each of ``wanted`` (want, doi, pmid, pmcid, title, authors, year).

    sources: by name, in order, the answers (by, key, paper_id, error) of a provider, one row for each key. With a DOI
    only the DOI is asked for, and the last source's error stands. Otherwise come the other identifiers that are known and
    then titles among ``candidates`` (paper_id, title, authors, year) of each source, where exactly one must fit.

    Each wave joins only the rows that are open and have the key, so no join carries null keys; ``step`` is the one that
    decided, ``error`` why it failed, ``asked`` all steps in order.
    """
    start = wanted.select("want", *[F.col(k).cast("string").alias(k) for k in IDENTIFIERS], "title", "authors", "year", F.lit(None).cast("bigint").alias("paper_id"), F.lit(None).cast("string").alias("step"), F.lit(None).cast("string").alias("error"), F.array().cast("array<string>").alias("asked"))
    done, open_ = [], cut(start)
    for by in IDENTIFIERS:
        for name, source in sources.items():
            has = F.col(by).isNotNull() & (F.col(by) != "")
            answered = cut(_ask(open_.where(has), by, name, source))
            done.append(answered.where("paper_id is not null"))
            open_ = cut(answered.where("paper_id is null").unionByName(open_.where(~F.coalesce(has, F.lit(False)))))
        if by == "doi":
            final = F.col("doi").isNotNull() & (F.col("doi") != "")
            done.append(open_.where(final))
            open_ = open_.where(~F.coalesce(final, F.lit(False)))
    for name, papers in candidates.items():
        answered = cut(_by_metadata(open_, name, papers))
        done.append(answered.where("paper_id is not null"))
        open_ = answered.where("paper_id is null")
    out = open_
    for part in done:
        out = out.unionByName(part)
    return out.select("want", "paper_id", "step", "error", "asked")


def _by_metadata(open_: DataFrame, name: str, papers: DataFrame) -> DataFrame:
    """One paper of the same normalised title, a year at most one off, and an author in common where both have some."""
    t = lambda c: normalize_title(F.col(c))
    w = open_.select("want", t("title").alias("_t"), F.nullif(F.col("year"), F.lit(0)).alias("_wy"), F.transform("authors", surname).alias("_wn")).where("_t <> ''")
    p = papers.select(F.col("paper_id").alias("_paper"), t("title").alias("_t"), F.nullif(F.col("year"), F.lit(0)).alias("_py"), F.transform("authors", surname).alias("_pn")).where("_t <> ''")
    some = (F.coalesce(F.size("_wn"), F.lit(0)) <= 0) | (F.coalesce(F.size("_pn"), F.lit(0)) <= 0) | F.arrays_overlap("_wn", "_pn")
    hits = w.join(p, "_t").where(years_close(F.col("_wy"), F.col("_py"), 1) & some).groupBy("want").agg(F.count("*").alias("_n"), F.min("_paper").alias("_paper"))
    j = open_.join(hits, "want", "left")
    one = F.col("_n") == 1
    error = F.when(one, None).when(F.col("_n") > 1, F.concat(F.lit(f"{name}: "), F.col("_n").cast("string"), F.lit(" papers fit"))).otherwise(f"{name}: no paper fits")
    return j.withColumn("paper_id", F.when(one, F.col("_paper"))).withColumn("step", F.lit(f"{name}:metadata")).withColumn("error", error).withColumn("asked", F.array_append("asked", F.lit(f"{name}:metadata"))).drop("_n", "_paper")


def cited_sources(wanted: DataFrame, resolved: DataFrame, papers: DataFrame, parsed: DataFrame) -> DataFrame:
    """(want, resolution_status, resolution_error, paper_id, fetch_status, fetch_error, format) for each of ``wanted`` (want, located).

    The ladder: no locator or no paper fails the resolution and nothing is fetched; a paper (paper_id, availability,
    reason) that is not available has no full text; else ``parsed`` (paper_id, ok, format, error) decides.
    """
    j = wanted.select("want", "located").join(resolved.select("want", "paper_id", F.col("error").alias("_error")), "want", "left")
    j = j.join(papers.select("paper_id", "availability", "reason"), "paper_id", "left").join(parsed.select("paper_id", "ok", "format", F.col("error").alias("_parse_error")), "paper_id", "left")
    located, found = F.coalesce("located", F.lit(False)), F.col("paper_id").isNotNull()
    live = located & found
    open_ = F.coalesce(F.col("availability") == "available", F.lit(False))
    read = F.coalesce("ok", F.lit(False))

    def ladder(gone: Column | None, closed: Column, failed: Column, got: Column | None) -> Column:
        none = F.lit(None)
        return F.when(~live, none if gone is None else gone).when(~open_, closed).when(~read, failed).otherwise(none if got is None else got)

    reason = F.when(F.col("availability") == "abstract_only", ABSTRACT_ONLY).otherwise(F.coalesce("reason", F.lit(NO_FULL_TEXT)))
    return j.select(
        "want", F.when(live, "resolved").otherwise("resolution_failed").alias("resolution_status"), F.when(~located, NO_LOCATOR).when(~found, F.col("_error")).alias("resolution_error"), F.when(located, F.col("paper_id")).alias("paper_id"),
        ladder(F.lit("not_attempted"), F.lit("no_fulltext"), F.lit("fetch_failed"), F.lit("retrieved")).alias("fetch_status"), ladder(None, reason, F.coalesce("_parse_error", F.lit("no parsed text")), None).alias("fetch_error"), F.when(live & open_ & read, F.col("format")).alias("format"),
    )
