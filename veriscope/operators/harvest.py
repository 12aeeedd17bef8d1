"""From citing papers to harvested mentions: joins, the outcome ladder, citation windows."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.text import sentences

# Sections that carry no claims, and the names of outcomes.
NO_CLAIM_SECTIONS = ("method", "material", "supplement", "acknowledg", "appendix", "reference", r"data\s*availability", r"author\s*contrib", "funding", r"competing\s*interest", "conflict")
CAPTIONS = ("figure_caption", "table_caption")
FAILURES = {
    "no_fulltext": "skipped_not_auditable",
    "http_403": "fail_http_403",
    "parse_failed": "fail_pdf_parse_error",
    "ref_list_empty": "fail_ref_list_empty",
    "no_reference_match": "fail_no_reference_match",
    "ref_found_but_no_in_text_xref": "fail_ref_found_but_no_in_text_xref",
}
SUCCESSES = {"grobid_tei": "success_grobid", "jats_xml": "success_structured"}


def edge_papers(edges: DataFrame, papers: DataFrame) -> DataFrame:
    """Edges with what is known of their citing paper (paper_id, ...); an unknown paper leaves nulls."""
    return edges.join(papers, edges["citing"] == papers["paper_id"], "left").drop("paper_id")


def error_outcome(error: Column) -> Column:
    """Outcome of a harvest that ended in an error message."""
    return F.when(error.rlike("403"), "http_403").when(error.rlike(r"(?i)pdf\s*parse|invalid\s*pdf|html_instead_of_pdf|invalid_pdf_payload|grobid"), "parse_failed").otherwise("unknown_failure")


def matched_mentions(mentions: DataFrame, matched: DataFrame) -> DataFrame:
    """Mentions of the one reference of their paper that ``matched`` (citing, ref_id) names."""
    return mentions.join(matched.select("citing", "ref_id"), ["citing", "ref_id"], "left_semi")


def harvest(papers: DataFrame, references: DataFrame, matched: DataFrame, mentions: DataFrame) -> DataFrame:
    """(citing, outcome, n_references, n_mentions) of each of ``papers`` (citing, availability, error): the first rung of the ladder that stops it.

    references (citing, ref_id) are the parsed lists, matched (citing, ref_id) the seed's place in them, mentions (citing, ref_id) the citations in the texts.
    """
    listed = references.groupBy("citing").agg(F.count("*").alias("n_references"))
    found = matched.join(references, ["citing", "ref_id"], "left_semi").dropDuplicates(["citing"])
    cited = matched_mentions(mentions, found).groupBy("citing").agg(F.count("*").alias("n_mentions"))
    j = papers.join(listed, "citing", "left").join(found.select("citing", F.lit(True).alias("_found")), "citing", "left").join(cited, "citing", "left")
    zero = F.lit(0).cast("long")
    outcome = (
        F.when(F.col("availability") != "available", "no_fulltext")
        .when(F.col("error").isNotNull(), error_outcome(F.col("error")))
        .when(F.coalesce("n_references", zero) == 0, "ref_list_empty")
        .when(F.col("_found").isNull(), "no_reference_match")
        .when(F.coalesce("n_mentions", zero) == 0, "ref_found_but_no_in_text_xref")
        .otherwise("success")
    )
    return j.select("citing", outcome.alias("outcome"), F.coalesce("n_references", zero).alias("n_references"), F.when(outcome == "success", F.col("n_mentions")).otherwise(zero).alias("n_mentions"))


def extraction_outcome(outcome: Column, source: Column) -> Column:
    """What a harvest's outcome is called for an edge; a success is named by the kind of document."""
    failed, won = F.lit("fail_unknown"), F.lit("success_pdf")
    for name, text in FAILURES.items():
        failed = F.when(outcome == name, text).otherwise(failed)
    for name, text in SUCCESSES.items():
        won = F.when(source == name, text).otherwise(won)
    return F.when(outcome == "success", won).otherwise(failed)


def failure_histogram(edges: DataFrame) -> DataFrame:
    """(outcome, n) of the edges that failed."""
    return edges.where(~F.startswith("outcome", F.lit("success"))).groupBy("outcome").agg(F.count("*").alias("n"))


def probe_stats(harvested: DataFrame, by: str) -> DataFrame:
    """Papers probed, successful harvests and their rate, for each of ``by``."""
    return harvested.groupBy(by).agg(F.count("*").alias("probed"), F.count_if(F.col("outcome") == "success").alias("successful")).withColumn("rate", F.col("successful") / F.col("probed"))


def with_harvest(edges: DataFrame, harvested: DataFrame) -> DataFrame:
    """Edges with the mentions of an earlier harvest; harvested says whether there was one, even if it found nothing."""
    known = harvested.select("citing", F.col("n_mentions").alias("held"), F.lit(True).alias("_known"))
    return edges.join(known, "citing", "left").withColumn("harvested", F.col("_known").isNotNull()).drop("_known")


def mentions_by_paper(mentions: DataFrame) -> DataFrame:
    """(citing, n_mentions, sections): the distinct section titles in order."""
    return mentions.groupBy("citing").agg(F.count("*").alias("n_mentions"), F.array_sort(F.collect_set("section")).alias("sections"))


def best_examples(rows: DataFrame, by: str, order: Sequence[str], most: int = 10) -> DataFrame:
    """The first ``most`` rows of each of ``by``: high confidence before medium before low, then ``order``."""
    place = F.when(F.col("confidence") == "high", 0).when(F.col("confidence") == "medium", 1).otherwise(2)
    w = Window.partitionBy(by).orderBy(place, *order)
    return rows.withColumn("place", F.row_number().over(w)).where(F.col("place") <= most)


def three_way(extracted: DataFrame, classified: DataFrame, screened: DataFrame) -> DataFrame:
    """Extraction edges with their classification and their screening, where there are any."""
    return extracted.join(classified, ["citing", "cited"], "left").join(screened, ["citing", "cited"], "left")


def claim_bearing(kind: Column, section: Column) -> Column:
    """Whether a block may hold claims: abstracts do, captions and some sections do not."""
    title = F.coalesce(section, F.lit(""))
    return F.when(kind == "abstract", True).when(kind.isin(*CAPTIONS), False).otherwise(~title.rlike("(?i)" + "|".join(NO_CLAIM_SECTIONS)))


def manuscript(blocks: DataFrame, by: str, most: int = 150_000) -> DataFrame:
    """(by, manuscript): trimmed texts in order of ``ord``, under their section titles, with blank lines between, cut at ``most`` characters."""
    text = F.concat(F.when(F.length("section") > 0, F.concat(F.lit("["), "section", F.lit("]\n"))).otherwise(F.lit("")), F.trim("text"))
    parts = F.transform(F.array_sort(F.collect_list(F.struct("ord", text.alias("t")))), lambda x: x["t"])
    return blocks.groupBy(by).agg(parts.alias("_parts")).select(by, F.substring(F.array_join(F.filter("_parts", lambda x: x != ""), "\n\n"), 1, most).alias("manuscript"))


def retrieval_query(*parts: Column) -> Column:
    """The trimmed parts that are not empty, joined by spaces."""
    return F.array_join(F.filter(F.transform(F.array(*parts), lambda x: F.trim(F.coalesce(x, F.lit("")))), lambda x: x != ""), " ")


def detect_bundle(marker: Column, markers: Column, context: Column, radius: int = 80) -> Column:
    """struct(bundled, size, refs, pattern): the references of all ``markers`` (marker, refs) that first stand within ``radius`` characters of this one."""
    at = F.position(marker, context)
    near = F.filter(markers, lambda m: (F.position(m["marker"], context) > 0) & (F.abs(F.position(m["marker"], context) - at) <= radius))
    refs = F.when(at > 0, F.filter(F.array_distinct(F.flatten(F.transform(near, lambda m: m["refs"]))), lambda r: r != "")).otherwise(F.array().cast("array<string>"))
    first = F.greatest(at - radius, F.lit(1))
    window = F.substring(context, first, at + F.length(marker) + radius - first)
    many = F.size(refs) > 1
    pattern = F.when(many, F.when(F.contains(window, F.lit(";")), "semicolon_separated").otherwise("parenthetical_group")).otherwise("single")
    return F.struct(many.alias("bundled"), F.when(many, F.size(refs)).otherwise(1).alias("size"), F.when(many, refs).otherwise(F.array().cast("array<string>")).alias("refs"), pattern.alias("pattern"))


def _tidy(marker: Column) -> Column:
    return F.trim(F.regexp_replace(F.regexp_replace(marker, r"\s+", " "), "[,;:]+$", ""))


def marker_position(text: Column, marker: Column) -> Column:
    """Where (from 0) a marker stands: as it is, tidied, by its surname and year, or else the middle."""
    found = lambda x: F.when((F.length(x) > 0) & (F.position(x, text) > 0), F.position(x, text) - 1)
    named = F.regexp_extract(_tidy(marker), r"[A-Za-z0-9_]+\s+et\s+al\.?,?\s*[0-9]{4}", 0)
    return F.coalesce(found(marker), found(_tidy(marker)), found(named), F.floor(F.length(text) / 2).cast("int"))


def _spans(text: Column) -> Column:
    """Sentences with start and end; an unmarked rest is trimmed."""
    s = sentences(text)
    ends = F.aggregate(s, F.array(F.lit(0)), lambda acc, x: F.array_append(acc, F.element_at(acc, -1) + F.length(x)))
    return F.zip_with(s, F.slice(ends, F.lit(1), F.size(s)), lambda x, at: F.struct(x.alias("text"), at.alias("start"), (at + F.length(x)).alias("end")))


def citing_window(df: DataFrame, context: str, marker: str, to: str, most: int = 600) -> DataFrame:
    """``df`` with column ``to``: the sentences around the marker, grown to the left and then to the right as long as ``most`` characters hold.

    A context of at most ``most`` characters stays whole; one without sentences gives ``most`` characters around the marker.
    """
    names = ("_window_spans", "_window_at", "_window_range")
    c = F.col(context)
    df = df.withColumn(names[0], _spans(c)).withColumn(names[1], marker_position(c, F.col(marker)))
    spans, at = F.col(names[0]), F.col(names[1])
    away = lambda x: F.when(at < x["start"], x["start"] - at).when(at > x["end"], at - x["end"]).otherwise(0)
    anchor = F.array_min(F.transform(spans, lambda x, k: F.struct(away(x).alias("d"), k.alias("k"))))["k"]
    size = lambda k: F.length(F.get(spans, k)["text"])
    begin = F.struct(anchor.alias("lo"), anchor.alias("hi"), size(anchor).alias("n"))

    def grow(acc: Column, _: Column) -> Column:
        left = (acc["lo"] > 0) & (acc["n"] + F.coalesce(size(acc["lo"] - 1), F.lit(0)) <= most)
        n = acc["n"] + F.when(left, size(acc["lo"] - 1)).otherwise(0)
        right = (acc["hi"] < F.size(spans) - 1) & (n + F.coalesce(size(acc["hi"] + 1), F.lit(0)) <= most)
        return F.struct((acc["lo"] - left.cast("int")).alias("lo"), (acc["hi"] + right.cast("int")).alias("hi"), (n + F.when(right, size(acc["hi"] + 1)).otherwise(0)).alias("n"))

    df = df.withColumn(names[2], F.when((F.length(c) > most) & (F.size(spans) > 1), F.aggregate(F.sequence(F.lit(1), F.least(F.size(spans), F.lit(most))), begin, grow)))
    grown = F.col(names[2])
    chosen = F.trim(F.array_join(F.transform(F.slice(spans, grown["lo"] + 1, grown["hi"] - grown["lo"] + 1), lambda x: x["text"]), ""))
    start = F.greatest(at - most // 2, F.lit(0))
    around = F.trim(F.substring(c, start + 1, F.lit(most)))
    return df.withColumn(to, F.when(F.length(c) <= most, c).otherwise(F.coalesce(F.nullif(chosen, F.lit("")), around))).drop(*names)


def annotate_context(df: DataFrame, context: str, marker: str, label: str, to: str, opened: str = "<<", closed: str = ">>") -> DataFrame:
    """``df`` with column ``to``: the context with runs of sentences between ``opened`` and ``closed`` that hold the reference's label, or else the marker.

    Unchanged if there is one sentence, or if none or all of them do.
    """
    names = ("_mark_sentences", "_mark_tries", "_marks")
    s, tries, marks = (F.col(x) for x in names)
    first = F.coalesce(F.col(label), F.col(marker))
    df = df.withColumn(names[0], sentences(F.col(context)))
    df = df.withColumn(names[1], F.array(first, _tidy(first), F.when(F.col(label).isNotNull(), F.col(marker))))

    def holding(k: int) -> Column:
        what = F.get(tries, F.lit(k))
        return F.transform(s, lambda x: F.coalesce((F.length(what) > 0) & F.contains(x, what), F.lit(False)))

    df = df.withColumn(names[2], holding(0))
    df = df.withColumn(names[2], F.when(F.array_contains(marks, True), marks).otherwise(F.zip_with(holding(1), holding(2), lambda a, b: a | b)))
    before = F.concat(F.array(F.lit(False)), marks)  # one longer: its last pair closes what is open
    parts = F.zip_with(F.arrays_zip(s.alias("s"), marks.alias("m")), before, lambda x, was: F.struct(x["s"].alias("s"), x["m"].alias("m"), was.alias("was")))
    after = F.concat(F.slice(marks, F.lit(2), F.size(marks)), F.array(F.lit(False)))
    ends = F.zip_with(parts, after, lambda x, later: F.struct(x["s"].alias("s"), x["m"].alias("m"), x["was"].alias("was"), later.alias("later")))
    shown = F.transform(
        F.filter(ends, lambda x: x["s"].isNotNull()),
        lambda x: F.concat(F.when(x["m"] & ~x["was"], F.lit(f"{opened} ")).otherwise(F.lit("")), F.when(x["m"] & ~x["later"], F.concat(F.rtrim(x["s"]), F.lit(f" {closed} "))).otherwise(x["s"])),
    )
    marked = F.array_join(shown, "")
    marked = F.when(F.element_at(marks, -1), F.rtrim(marked)).otherwise(marked)
    some, every = F.array_contains(marks, True), ~F.array_contains(marks, False)
    return df.withColumn(to, F.when((F.size(s) > 1) & some & ~every, marked).otherwise(F.col(context))).drop(*names)
