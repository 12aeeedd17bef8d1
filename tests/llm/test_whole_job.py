"""What an earlier version of the corpus operators left out."""

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from tests.llm.test_text_ops import corpus, frame, line_classes
from veriscope.llm import linededup, toxicity
from veriscope.llm.queries import queries

SHORT = ["All rights reserved.\nw1 w2 w3 w4 w5 tail\nand", "all RIGHTS reserved.\nx\n\nx x\n \nrights all reserved.", "and\nw1 w2 w3 w4\nw1 w2 w3\nw1 w2 w4 w9", "a b c d e", "a b c d\na b c", "A b c"]


@pytest.mark.parametrize("few", [200, 3])
def test_short_lines_are_matched(spark, few):
    texts = corpus(2) + SHORT * 2
    gone = line_classes(texts, least=1)
    assert sum(map(len, gone.values())) > sum(map(len, line_classes(texts).values())) + 20
    got = {r["doc_id"]: r for r in linededup.dedup_lines(frame(spark, texts), min_tokens=1, limits=linededup.Limits(few=few)).collect()}
    for k, t in enumerate(texts):
        assert got[k]["text"] == (None if t is None else "\n".join(x for n, x in enumerate(t.split("\n")) if n not in gone[k])), k
        assert got[k]["removed_count"] == len(gone[k])


def test_short_lines_of_the_query_and_the_stage(spark, sf, tmp_path):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    two = docs.limit(2).withColumn("doc_id", F.monotonically_increasing_id()).withColumn("text", F.concat(F.lit("All rights reserved.\n\nown"), F.col("doc_id").cast("string"))).cache()
    two.write.parquet(f"{tmp_path}/documents.parquet")
    assert sorted(r["removed_count"] for r in queries()["op5_line_dedup"](spark, str(tmp_path)).collect()) == [0, 1]
    assert sorted(len(r["text"].split("\n")) for r in corpus_pipeline.line_dedup(spark, two, sf).collect()) == [2, 3]


def test_signs_are_read_as_i_and_as_l(spark):
    lexicon = toxicity.Lexicon({" idiot": 3.0, " shit ": 2.0, " bitch ": 2.0, " kill": 2.0, " skill": 1.0, " trash": 1.5})
    for plain, forms in {"idiot": "id1ot 1diot 1d!0t !diot |D1OT", "shit": "sh1t SH!T sh|t", "bitch": "b1tch", "killing": "k1lling ki11ing k111ing k!11ing k|!ling", "skill": "sk1l1 ski1| sk111"}.items():
        for form in forms.split():
            assert lexicon.strength(f"such a {form} here") == lexicon.strength(f"such a {plain} here".ljust(len(form) + 12)) > 0, form
    assert [lexicon.strength(t) for t in ("ldlot", "shlt", "stop! It is 1 | 2", "trash b1n")] == [0, 0, 0, 0]
    assert lexicon.strength("idiot!you") > 0
    docs = spark.createDataFrame([(k, f"you are an {'idiot' if k % 2 else 'author'} number{k}") for k in range(40)] + [(100, "you are an id1ot here"), (101, "you are an author here")], "doc_id long, text string")
    labels = spark.createDataFrame([(k, k % 2) for k in range(40)], "doc_id long, toxic int")
    got = {r["doc_id"]: r["score"] for r in toxicity.score_toxicity(docs, labels).collect()}
    assert got[100] > 0.5 > got[101]
