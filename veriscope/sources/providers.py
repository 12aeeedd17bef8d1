"""Papers from metadata providers' JSON, and where their full text may be."""

from __future__ import annotations

from urllib.parse import urljoin

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import abstract_text, normalize_title, surname, years_close

WORK = (
    "id string, doi string, ids struct<pmid:string,pmcid:string>, display_name string, authorships array<struct<author:struct<display_name:string>>>, abstract_inverted_index map<string,array<int>>, "
    "open_access struct<is_oa:boolean,oa_url:string>, primary_location struct<source:struct<display_name:string,type:string>,pdf_url:string,landing_page_url:string>, type string, referenced_works_count int, publication_year int"
)
#: Order in which places of a full text are tried.
PLACES = (("preprint_xml", 10), ("pmc_oai", 20), ("pmc_efetch", 30), ("pmc_id_search", 40), ("pmc_html", 50), ("landing_page", 60), ("landing_xml", 65), ("pdf", 70), ("landing_pdf", 80), ("proxy_landing", 110), ("proxy_pdf", 115), ("proxy_doi", 120))


def doi_of(value: Column) -> Column:
    """A DOI without its resolver, trimmed and lower-cased."""
    return F.lower(F.trim(F.regexp_replace(value, r"^(?i)https?://(?:dx\.)?doi\.org/", "")))


def hint(work: Column) -> Column:
    """Where a work's full text is likely to be: by its source, identifiers and links."""
    source = F.lower(F.coalesce(work["primary_location"]["source"]["display_name"], F.lit("")))
    pdf = work["primary_location"]["pdf_url"]
    return (
        F.when(F.contains(source, F.lit("biorxiv")), "biorxiv_xml")
        .when(work["ids"]["pmcid"].isNotNull(), "pmc_xml")
        .when(pdf.isNotNull() & (work["primary_location"]["source"]["type"] == "repository"), "repository_pdf")
        .when(pdf.isNotNull(), "pdf")
        .when(work["open_access"]["oa_url"].isNotNull(), "oa_link")
    )


def to_papers(works: DataFrame) -> DataFrame:
    """Papers from works of the schema WORK, in a struct column ``work``."""
    w = F.col("work")
    abstract = F.when(F.size(w["abstract_inverted_index"]) > 0, abstract_text(w["abstract_inverted_index"]))
    available = F.when(hint(w).isNotNull(), "available").when(abstract.isNotNull(), "abstract_only").otherwise("unavailable")
    return works.select(
        w["id"].alias("paper_id"), doi_of(w["doi"]).alias("doi"), w["ids"]["pmcid"].alias("pmcid"), w["ids"]["pmid"].alias("pmid"), w["display_name"].alias("title"),
        F.transform(w["authorships"], lambda a: a["author"]["display_name"]).alias("authors"), abstract.alias("abstract"), w["type"].alias("paper_type"), w["referenced_works_count"].alias("refs"),
        w["publication_year"].alias("year"), available.alias("availability"), hint(w).alias("hint"), w["primary_location"]["landing_page_url"].alias("landing"), w["primary_location"]["pdf_url"].alias("pdf"),
    )


def match_by_metadata(wanted: DataFrame, papers: DataFrame) -> DataFrame:
    """(want, paper_id) where exactly one paper has the wanted title, a year at most one off, and an author in common (none known counts as any)."""
    w = wanted.select("want", normalize_title(F.col("title")).alias("t"), F.col("year").alias("w_year"), F.transform("authors", surname).alias("w_names"))
    p = papers.select("paper_id", normalize_title(F.col("title")).alias("t"), "year", F.transform("authors", surname).alias("names"))
    zero = lambda c: F.nullif(F.col(c), F.lit(0))
    some = (F.size("w_names") <= 0) | (F.size("names") <= 0) | F.arrays_overlap("w_names", "names")
    hits = w.join(p, "t").where(years_close(zero("w_year"), zero("year"), 1) & some)
    return hits.groupBy("want").agg(F.count("*").alias("n"), F.min("paper_id").alias("paper_id")).where("n = 1").drop("n")


def candidates(papers: DataFrame) -> DataFrame:
    """(paper_id, place, url, priority): where to look for full texts, each url once at its best priority."""
    rank = dict(PLACES)
    doi = F.col("doi")
    found = [
        (F.when(F.col("hint") == "biorxiv_xml", F.concat(F.lit("biorxiv:"), doi)), "preprint_xml"),
        *[(F.when(F.col("pmcid").isNotNull(), F.concat(F.lit(f"{p}:"), F.col("pmcid"))), p) for p in ("pmc_oai", "pmc_efetch", "pmc_html")],
        (F.when(F.col("pmcid").isNull() & doi.isNotNull(), F.concat(F.lit("pmc:"), doi)), "pmc_id_search"),
        (F.col("landing"), "landing_page"),
        (F.col("pdf"), "pdf"),
    ]
    rows = F.array_compact(F.array(*[F.when(url.isNotNull(), F.struct(F.lit(p).alias("place"), url.alias("url"), F.lit(rank[p]).alias("priority"))) for url, p in found]))
    spread = papers.select("paper_id", F.explode(rows).alias("c")).select("paper_id", "c.*")
    return spread.groupBy("paper_id", "url").agg(F.min_by("place", "priority").alias("place"), F.min("priority").alias("priority"))


_LINKS = (
    ("xml", r"(?i)<meta[^>]+name=[\"']citation_xml_url[\"'][^>]+content=[\"']([^\"']+)[\"']"),
    ("pdf", r"(?i)<meta[^>]+name=[\"']citation_pdf_url[\"'][^>]+content=[\"']([^\"']+)[\"']"),
    ("xml", r"(?i)<link[^>]+type=[\"']application/xml[\"'][^>]+href=[\"']([^\"']+)[\"']"),
    ("pdf", r"(?i)<link[^>]+type=[\"']application/pdf[\"'][^>]+href=[\"']([^\"']+)[\"']"),
    ("pdf", r"(?i)<a[^>]+href=[\"']([^\"']+\.pdf(?:\?[^\"']*)?)[\"']"),
)


def landing_links(pages: DataFrame) -> DataFrame:
    """(page_id, kind, url): links to XML and PDF full texts on landing pages, resolved against the page's own url."""

    @F.pandas_udf("string")
    def resolve(base: pd.Series, link: pd.Series) -> pd.Series:
        return pd.Series([urljoin(b or "", x) for b, x in zip(base, link, strict=True)])

    def named(kind: str, source: str) -> Column:
        return F.transform(F.regexp_extract_all("html", F.lit(source), F.lit(1)), lambda u: F.struct(F.lit(kind).alias("kind"), u.alias("link")))

    found = F.flatten(F.array(*[named(kind, source) for kind, source in _LINKS]))
    spread = pages.select("page_id", F.col("url").alias("base"), F.explode(found).alias("f"))
    return spread.select("page_id", "f.kind", resolve("base", "f.link").alias("url")).distinct()
