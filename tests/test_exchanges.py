"""How often rows move between tasks on the way through discovery, screening and extraction."""

from pyspark.sql import functions as F

from veriscope.functions import rules, text
from veriscope.operators import classify, graph
from veriscope.sources import testdata as td

SF = "/root/testdata/sf0.001"


def planned(df, spark):
    before = spark.conf.get("spark.sql.adaptive.enabled")
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        lines = [x.lstrip(" :+-*") for x in df._jdf.queryExecution().executedPlan().toString().split("\n")]
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", before)
    lines = [x.split(") ", 1)[-1] if x.startswith("(") else x for x in lines]
    return sum(x.startswith("Exchange") for x in lines), sum(x.startswith("Window ") for x in lines)


def test_edges_move_once_for_all_that_groups_them_by_seed(spark):
    edges = td.edges(spark, SF)
    assert planned(graph.probe_selection(edges, 3), spark) == (1, 1)
    assert planned(graph.screen_metrics(edges), spark)[0] == 1


def test_families_are_screened_once(spark):
    assert planned(graph.assign_priorities(graph.screen(graph.screen_metrics(td.edges(spark, SF)))), spark)[0] <= 2  # the best one's row, and its broadcast


def test_contexts_move_once_when_mentions_are_deduplicated(spark):
    assert planned(classify.dedup_mentions(td.mentions(spark, SF)), spark) == (1, 2)


def test_edges_of_suppliers_stay_apart_from_equal_ones_of_parts(spark, tmp_path):
    spark.sql("SELECT * FROM VALUES (10000001L, 1L), (10000001L, 1L), (5L, 2L) AS t(l_partkey, l_orderkey)").write.parquet(f"{tmp_path}/lineitem.parquet")
    spark.sql("SELECT 1L AS s_suppkey").write.parquet(f"{tmp_path}/supplier.parquet")
    got = sorted((r["seed"], r["citing"], r["copies"]) for r in td.edges(spark, str(tmp_path)).collect())
    assert got == [(5, 2, 1), (10000001, 1, 1), (10000001, 1, 2)]


def test_where_to_look_for_a_cue_does_not_depend_on_how_letters_are_lowered(spark):
    said = ["WESTERN  Blot", "İmage ANALYSIS İ", "Key resources table", "ΣMicroscopyΣ", "Éanimal", "animal É", "METHODS", "methodical", "", None]
    df = spark.createDataFrame([(t,) for t in said], "t string")
    plain = F.coalesce(F.col("t").rlike("(?i)" + text.alternation(rules.METHODS_SECTIONS)), F.lit(False))
    got = df.select("t", F.coalesce(rules._any_hit(F.col("t"), rules.METHODS_SECTIONS), F.lit(False)).alias("hit"), plain.alias("plain")).collect()
    assert [r["t"] for r in got if r["hit"] != r["plain"]] == [] and sum(r["hit"] for r in got) >= 4
