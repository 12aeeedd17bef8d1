"""The stages chained on the derived relations."""

from pyspark.sql import functions as F

from veriscope.operators import retrieval
from veriscope.plans import stages
from veriscope.sources import testdata as td


def test_screen_to_packets(spark, sf):
    config = stages.Config()
    counts, probes = stages.discover(td.edges(spark, sf), config)
    assert counts.agg(F.sum("total")).first()[0] == probes.count()
    screened = stages.screen(td.edges(spark, sf), config, spark.createDataFrame([(7,)], "seed long")).cache()
    assert screened.where("priority = 'first'").count() == 1
    assert {r["rule"] for r in screened.select("rule").distinct().collect()} >= {"greenlight", "too_few_auditable", "claim_not_grounded"}
    mentions, edges = stages.extract(td.mentions(spark, sf), screened)
    live = {r["seed"] for r in screened.where("decision = 'greenlight'").collect()}
    assert {r["cited"] for r in edges.select("cited").distinct().collect()} <= live
    tasks, packets = stages.classify_stage(mentions)
    assert packets.agg(F.sum("n_mentions")).first()[0] == mentions.count() == tasks.agg(F.sum("n_mentions")).first()[0]


def test_evidence_ranks_within_the_cited_paper(spark):
    blocks = spark.createDataFrame([(1, "a", "growth rose in all samples"), (1, "b", "nothing of note here"), (1, "c", "growth growth growth"), (2, "d", "growth rose")], "cited long, block_id string, text string")
    tasks = spark.createDataFrame([("t1", 1, "growth rose"), ("t2", 2, "absent words")], "task_id string, cited long, query string")
    got = stages.evidence(tasks, blocks, stages.Config()).orderBy("rank").collect()
    assert [(r["task_id"], r["block_id"]) for r in got] == [("t1", "a"), ("t1", "c")]


def test_categorical_verdicts_override_only_escalated(spark, sf):
    judged = stages.judge(td.vector_samples(spark, sf)).cache()
    categorical = judged.select("record_id", F.lit("overridden").alias("verdict"))
    merged = stages.merge_judged(judged, categorical)
    assert merged.where("source = 'categorical'").count() == judged.where(F.size("escalation") > 0).count()


def test_bm25_within_groups_is_bm25_of_each_group(spark):
    words = "cell growth factor receptor kinase signal pathway tumor mouse brain".split()
    docs = [(g, 10 * g + k, " ".join(words[(k * 3 + j * (g + 1)) % 10] for j in range(k % 5))) for g in range(3) for k in range(8)] + [(None, 99, "cell growth"), (2, 98, None)]
    asked = [(g, 10 * g + k, f"{words[k]} {words[(k + g) % 10]} {words[k]}") for g in range(3) for k in range(3)] + [(None, 97, "cell"), (7, 96, "cell"), (1, 95, None)]
    docs = spark.createDataFrame(docs, "g int, doc int, text string")
    asked = spark.createDataFrame(asked, "g int, query int, text string")
    rows = lambda df: {(r["query"], r["doc"]): (round(r["score"], 9), r["rank"]) for r in df.collect()}
    got = rows(retrieval.bm25(asked, docs, "query", "doc", 3, within="g"))
    wanted = {}
    for g in range(3):
        wanted |= rows(retrieval.bm25(asked.where(f"g = {g}"), docs.where(f"g = {g}"), "query", "doc", 3))
    assert got == wanted and len(got) > 10
    assert retrieval.bm25(asked, docs.limit(0), "query", "doc").count() == 0 == retrieval.bm25(asked.limit(0), docs, "query", "doc", within="g").count()
