"""Full texts by best-first search: each paper's places are tried in order, and pages that answer add the places they link to."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .rounds import cut

# What a place of each kind must answer with, and the priorities of places that pages link to.
WANTED = {"preprint_xml": "xml", "pmc_xml": "xml", "page_xml": "xml", "pdf": "pdf", "page_pdf": "pdf", "page": "html"}
LINKED = {"xml": ("page_xml", 65), "pdf": ("page_pdf", 80)}
NOTHING_TO_TRY = "No fetchable full text candidates"

PLACE = "paper_id bigint, phase int, priority int, ord bigint, kind string, url string"
_PLACE = ("phase", "priority", "ord", "kind", "url")
_ATTEMPT = ("paper_id", "attempt", "phase", "kind", "url", "outcome", "failure")


def _outcome(has_links: Column) -> Column:
    """What an answer means for a place: ``selected``, ``links``, or why it failed."""
    wanted = F.create_map(*[F.lit(x) for kind in WANTED.items() for x in kind])[F.col("kind")]
    return (
        F.when(F.col("status").isNull(), "network_error")
        .when(F.col("status") >= 400, "http_error")
        .when(~F.col("body").eqNullSafe(wanted), "wrong_body")
        .when(F.col("kind") != "page", "selected")
        .when(has_links, "links")
        .otherwise("no_links")
    )


def search(places: DataFrame, answers: DataFrame, links: DataFrame) -> DataFrame:
    """The log of attempts (paper_id, attempt, phase, kind, url, outcome, failure) over ``places`` (paper_id, phase, priority, ord, kind, url).

    answers: (url, status, body, error) of fetched urls, one row each; a url without one is a network error. links: (url,
    pos, kind, link) of pages, kind xml or pdf. Each round tries the best place left of every paper that has nothing yet,
    by phase (a later one only when the earlier is used up), priority and order; a page adds its links to its phase, each
    kind and url of a paper once. A paper is done at its first ``selected``. There are as many rounds as the longest list
    of attempts; each keeps only papers that are still open, and only their places.
    """
    linked = links.groupBy("url").agg(F.lit(True).alias("has_links"))

    def answered(asked: DataFrame) -> DataFrame:
        """``asked`` (kind, url, ...) with outcome and failure: what each place will answer is looked up once, not in each round."""
        out = asked.join(answers.select("url", "status", "body", "error"), "url", "left").join(linked, "url", "left").withColumn("outcome", _outcome(F.coalesce("has_links", F.lit(False))))
        why = F.when(F.col("outcome").isin("selected", "links"), None).otherwise(F.coalesce("error", F.concat_ws(" ", "outcome", "url")))
        return out.select(*asked.columns, "outcome", why.alias("failure"))

    def once(found: DataFrame, *more: str) -> DataFrame:
        return found.groupBy("paper_id", "kind", "url").agg(F.min(F.struct("phase", "priority", "ord", *more)).alias("p")).select("paper_id", "p.phase", "p.priority", "p.ord", "kind", "url", *[f"p.{c}" for c in more])

    queue = cut(answered(once(places)))
    target = lambda k: F.when(F.col("kind") == "xml", F.lit(LINKED["xml"][k])).otherwise(F.lit(LINKED["pdf"][k]))
    told = cut(answered(links.select(F.col("url").alias("page"), "pos", target(1).alias("priority"), target(0).alias("kind"), F.col("link").alias("url"))))
    seen, logs, round_ = [queue.select("paper_id", "kind", "url")], [], 0
    while not queue.isEmpty():
        # kind and url of a paper stand once in its queue, so that what comes after them in the order decides nothing
        best = queue.groupBy("paper_id").agg(F.min(F.struct(*_PLACE, "outcome", "failure")).alias("b")).select("paper_id", "b.*")
        tried = cut(best.withColumn("attempt", F.lit(round_)).select(*_ATTEMPT, "priority", "ord"))
        logs.append(tried.select(*_ATTEMPT))
        open_ = queue.join(tried.select("paper_id", "kind", "url"), ["paper_id", "kind", "url"], "left_anti").join(tried.where("outcome = 'selected'").select("paper_id"), "paper_id", "left_anti")
        new = tried.where("outcome = 'links'").select("paper_id", "phase", F.col("url").alias("page")).join(told, "page")
        new = cut(once(new.withColumn("ord", (F.lit((round_ + 1) * 1_000_000) + F.col("pos")).cast("bigint")), "outcome", "failure"))
        if not new.isEmpty():
            for known in seen:
                new = new.join(known, ["paper_id", "kind", "url"], "left_anti")
            new = cut(new)
            seen.append(new.select("paper_id", "kind", "url"))
            open_ = open_.unionByName(new)
        queue, round_ = cut(open_), round_ + 1
    if not logs:
        return places.sparkSession.createDataFrame([], "paper_id bigint, attempt int, phase int, kind string, url string, outcome string, failure string")
    return reduce(DataFrame.unionByName, logs)


def acquired(papers: DataFrame, log: DataFrame) -> DataFrame:
    """(paper_id, ok, kind, url, channel, format, attempts, failure) for each of ``papers`` (paper_id) from the log of attempts.

    ``failure`` is that of the last open attempt of the first phase that failed, also where a proxy was tried after it.
    """
    won = F.col("outcome") == "selected"
    of = lambda c: F.max(F.when(won, F.col(c)))
    last = F.max_by("failure", F.when(F.col("failure").isNotNull() & (F.col("phase") == 0), F.col("attempt")))
    by = log.groupBy("paper_id").agg(F.bool_or(won).alias("ok"), of("kind").alias("kind"), of("url").alias("url"), of("phase").alias("phase"), F.count("*").alias("attempts"), last.alias("last"))
    j = papers.select("paper_id").join(by, "paper_id", "left")
    ok = F.coalesce("ok", F.lit(False))
    channel = F.when(ok, F.when(F.col("phase") == 0, "open_access").otherwise("institutional_proxy"))
    format_ = F.when(ok, F.when(F.col("kind").isin("pdf", "page_pdf"), "grobid_tei_xml").otherwise("jats_xml"))
    return j.select("paper_id", ok.alias("ok"), "kind", "url", channel.alias("channel"), format_.alias("format"), F.coalesce("attempts", F.lit(0)).alias("attempts"), F.when(~ok, F.coalesce("last", F.lit(NOTHING_TO_TRY))).alias("failure"))
