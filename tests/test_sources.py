"""Parsers, providers, artifacts, replay and progress on small fixtures."""

import json

import pytest
from pyspark.sql import functions as F

from veriscope.functions import text
from veriscope.operators import parse, replay
from veriscope.sources import artifacts, providers
from veriscope.streaming import progress

TEI = """<TEI xmlns="http://www.tei-c.org/ns/1.0"><teiHeader><abstract><p>An abstract that is long enough to count as a block.</p></abstract></teiHeader><text><body>
<div><head>Results</head><p>Growth rose in all of the samples <ref type="bibr" target="#b0">(Hale, 2011)</ref> that we saw.</p><figure type="table"><figDesc>Table of all of the measured growth rates.</figDesc></figure></div>
<div><p>Short.</p></div></body><back><listBibl><biblStruct xml:id="b0"><analytic><title>Growth</title><author><persName><surname>Hale</surname></persName></author><idno type="DOI">10.1/x</idno></analytic><monogr><imprint><date when="2011-05"/></imprint></monogr></biblStruct></listBibl></back></text></TEI>"""
JATS = """<article><front><abstract><p>A second abstract that is long enough to count.</p></abstract></front><body><sec><title>Methods</title><p>Cells were kept as in earlier work <xref ref-type="bibr" rid="r1">1</xref> at all times.</p>
<sec><title>Imaging</title><p>Nested sections carry their own title down to blocks.</p></sec></sec></body><back><ref-list><ref id="r1"><element-citation><name><surname>Moss</surname></name><article-title>Cells</article-title><year>1999</year><pub-id pub-id-type="doi">10.2/y</pub-id></element-citation></ref></ref-list></back></article>"""


def documents(spark):
    rows = [(1, TEI), (2, JATS), (3, "One paragraph that is long enough to be kept.\n\nshort\n\nAnother   paragraph with spaces to fold in it."), (4, "<broken"), (5, None), (6, "")]
    return spark.createDataFrame(rows, "paper_id long, content string")


def test_blocks(spark):
    got = [(r["paper_id"], r["kind"], r["section"], r["text"][:20]) for r in parse.blocks(documents(spark)).orderBy("paper_id", "ord").collect()]
    assert got == [
        (1, "abstract", None, "An abstract that is "), (1, "body", "Results", "Growth rose in all o"), (1, "table_caption", "Results", "Table of all of the "),
        (2, "abstract", None, "A second abstract th"), (2, "body", "Methods", "Cells were kept as i"), (2, "body", "Imaging", "Nested sections carr"),
        (3, "body", None, "One paragraph that i"), (3, "body", None, "Another paragraph wi"),
    ]


def test_references_and_mentions(spark):
    refs = {r["paper_id"]: (r["ref_id"], r["doi"], r["title"], r["surnames"], r["year"]) for r in parse.references(documents(spark)).collect()}
    assert refs == {1: ("b0", "10.1/x", "Growth", ["Hale"], 2011), 2: ("r1", "10.2/y", "Cells", ["Moss"], 1999)}
    found = {r["paper_id"]: (r["ref_id"], r["marker"], r["section"]) for r in parse.mentions(documents(spark)).collect()}
    assert found == {1: ("b0", "(Hale, 2011)", "Results"), 2: ("r1", "1", "Methods")}


def test_provider_papers(spark):
    work = {
        "id": "W1", "doi": "https://doi.org/10.5/ABC", "ids": {"pmid": None, "pmcid": "PMC7"}, "display_name": "On Growth", "authorships": [{"author": {"display_name": "Ann Hale"}}],
        "abstract_inverted_index": {"growth": [0, 3], "rose": [1]}, "open_access": {"is_oa": True, "oa_url": "http://x"}, "primary_location": {"source": {"display_name": "J", "type": "journal"}, "pdf_url": "http://p", "landing_page_url": "http://l"},
        "type": "article", "referenced_works_count": 12, "publication_year": 2011,
    }
    raw = spark.createDataFrame([(json.dumps(work),)], "j string").select(F.from_json("j", providers.WORK).alias("work"))
    papers = providers.to_papers(raw).cache()
    row = papers.first()
    assert (row["doi"], row["abstract"], row["hint"], row["availability"], row["authors"]) == ("10.5/abc", "growth rose  growth", "pmc_xml", "available", ["Ann Hale"])
    wanted = spark.createDataFrame([(1, "on growth!", 2012, ["B. Hale"]), (2, "on growth", 2013, ["B. Hale"]), (3, "On Growth", None, [])], "want long, title string, year int, authors array<string>")
    assert sorted(r["want"] for r in providers.match_by_metadata(wanted, papers).collect()) == [1, 3]
    assert [r["place"] for r in providers.candidates(papers).orderBy("priority").collect()][0] == "pmc_oai"


def test_landing_links(spark):
    html = '<meta name="citation_pdf_url" content="/a.pdf"><link type="application/xml" href="b.xml"><a class=x href="c.pdf?d=1">'
    got = {(r["kind"], r["url"]) for r in providers.landing_links(spark.createDataFrame([(1, "http://h/p/q", html)], "page_id long, url string, html string")).collect()}
    assert got == {("pdf", "http://h/a.pdf"), ("xml", "http://h/p/b.xml"), ("pdf", "http://h/p/c.pdf?d=1")}, got


def test_artifacts(spark, tmp_path):
    good, bad, empty = (tmp_path / f"{n}.json" for n in ("good", "bad", "empty"))
    good.write_text('{"id": 1, "extra": 2}')
    bad.write_text("{")
    empty.write_text("")
    assert artifacts.load_json(spark, str(good), "id long", "run").collect()[0]["id"] == 1
    for path, message in ((bad, "no valid JSON"), (empty, "empty file"), (tmp_path / "none.json", "no file")):
        with pytest.raises(artifacts.ArtifactError, match=message):
            artifacts.load_json(spark, str(path), "id long", "run")
    with pytest.raises(artifacts.ArtifactError, match="positive"):
        artifacts.load_json(spark, str(good), "id long", "run", {"positive": F.col("id") > 1})
    m = artifacts.manifest(spark, str(good), [str(bad)], "run", "test").collect()
    assert {r["role"] for r in m} == {"artifact", "source"} and all(len(r["sha256"]) == 64 for r in m)
    stems = spark.createDataFrame([("2026-01-02_003",), ("2026-01-02_011_family-2",), ("2026-01-01_099",)], "stem string")
    assert artifacts.next_stamp(stems, "2026-01-02").first()["stamp"] == "2026-01-02_012"


def test_replay(spark):
    requests = spark.createDataFrame([("k1",), ("k2",), ("k3",)], "cache_key string")
    answers = spark.createDataFrame([("k1", 'Sure: ```json\n{"a": 1}\n```', 1), ("k1", '{"a": 2}', 2), ("k2", "nothing", 1)], "cache_key string, response_text string, created_at int")
    got = {r["cache_key"]: (r["state"], r["answer"] and r["answer"]["a"]) for r in replay.replay(requests, answers, "a int").collect()}
    assert got == {"k1": ("answered", 2), "k2": ("malformed", None), "k3": ("missing", None)}
    assert [r["cache_key"] for r in replay.to_compute(requests, answers).collect()] == ["k3"]


def test_verified_quotes(spark):
    c = spark.createDataFrame([(1, ["rose", "fell"], "it rose"), (2, ["rose"], "it rose"), (3, ["fell"], "it rose")], "id int, quotes array<string>, manuscript string")
    assert {r["id"]: r["status"] for r in replay.verified_quotes(c, "quotes", "manuscript").collect()} == {1: "ambiguous", 2: "grounded", 3: "not_found"}


def test_scalar_text(spark):
    df = spark.createDataFrame([("A b. C d 3.5 tail that is long enough to keep", ["Ann Bo", "C D", "E F"], 2001)], "t string, a array<string>, y int")
    row = df.select(text.sentences(F.col("t")).alias("s"), text.reference_label(F.col("a"), F.col("y")).alias("l"), text.truncate_at_sentence(F.col("t"), 6).alias("c"), text.bigrams(F.lit("a b a b")).alias("g")).first()
    assert row["s"] == ["A b.", " C d 3.", "5 tail that is long enough to keep"]
    assert row["l"] == "Ann Bo et al., 2001" and row["c"] == "A b. ..." and row["g"] == ["a b", "b a"]


def events(spark):
    lines = [
        ("r1", 1, 'CF_PROGRESS {"stage":"screen","step":"load","status":"running"}'), ("r1", 2, "plain line"), ("r1", 3, 'CF_PROGRESS {"stage":"screen","step":"classify","status":"running","current":1}'),
        ("r1", 4, 'CF_PROGRESS {"stage":"screen","step":"classify","status":"running","current":1,"total":2,"detail":"half"}'), ("r1", 5, 'CF_PROGRESS {"stage":"screen","step":"decide","status":"failed"}'),
        ("r1", 6, 'CF_PROGRESS {"stage":"screen","step":"dedupe","status":"running"}'),
    ]
    return spark.createDataFrame(lines, "run_id string, seq long, value string")


WANTED = [("load", "completed"), ("dedupe", "running"), ("classify", "pending"), ("decide", "failed")]


def test_progress_batch(spark):
    got = progress.snapshot(progress.parse_log(events(spark))).orderBy("place").collect()
    assert [(r["step"], r["status"]) for r in got] == WANTED
    assert progress.log_tail(events(spark)).count() == 1


def test_progress_stream(spark, tmp_path):
    source = tmp_path / "in"
    progress.parse_log(events(spark)).repartition(1).write.parquet(str(source))
    s = spark.readStream.schema(spark.read.parquet(str(source)).schema).parquet(str(source))
    q = progress.stream(s).writeStream.outputMode("update").format("memory").queryName("progress_test").option("checkpointLocation", str(tmp_path / "cp")).start()
    q.processAllAvailable()
    q.stop()
    got = spark.table("progress_test").orderBy("place").collect()
    assert [(r["step"], r["status"]) for r in got] == WANTED
