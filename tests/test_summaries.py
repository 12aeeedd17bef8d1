"""Summaries on small rows: nulls, empty groups and empty tables; headlines of errors."""

from pyspark.sql import functions as F

from veriscope.functions import rules
from veriscope.operators import summaries

SAMPLE = "seed int, excluded boolean, verdict string, quality string, mode string"


def test_audit_summary_of_odd_records(spark):
    rows = [(1, None, "supported", None, None), (1, True, "supported", "high", "m"), (1, False, None, "low", "m"), (2, True, None, None, None)]
    got = {(r["seed"], r["section"], r["row"], r["name"]): (r["n"], r["rate"]) for r in summaries.audit_summary(spark.createDataFrame(rows, SAMPLE), "seed").collect()}
    assert got[1, "records", "", "all"] == (3, None) and got[1, "records", "", "excluded"] == (1, None) and got[1, "records", "", "adjudicated"] == (1, None)
    assert got[1, "verdict", "", "supported"] == (1, 1.0) and got[1, "verdict", "", "total"] == (1, None)
    assert got[1, "quality", "", "high"] == (0, 0.0) and got[1, "mode", "unknown", "supported"] == (1, None) and (1, "mode", "m", "total") not in got
    assert got[2, "verdict", "", "total"] == (0, None) and got[2, "quality", "", "low"] == (0, None)
    assert summaries.audit_summary(spark.createDataFrame([], SAMPLE), "seed").count() == 0


def test_routing_without_reasons_or_costs(spark):
    schema = "seed int, source string, adaptive boolean, adaptive_reasons array<string>, escalation_reasons array<string>, calls int, cost decimal(10,4)"
    rows = [(1, "axis_derived", None, None, ["a", "b"], 4, None), (1, None, True, [], ["a"], None, None)]
    got = {(r["section"], r["name"]): float(r["value"]) for r in summaries.routing_summary(spark.createDataFrame(rows, schema), "seed").collect()}
    assert got == {
        ("metric", "records"): 2, ("metric", "accepted"): 1, ("metric", "escalated"): 1, ("metric", "adaptive"): 1, ("metric", "calls"): 4, ("metric", "vector_cost"): 0, ("metric", "calls_per_record"): 2,
        ("metric", "categorical_cost"): 0, ("metric", "cost"): 0, ("source", "axis_derived"): 1, ("source", "unknown"): 1, ("adaptive_reason", "none"): 0, ("escalation_reason", "a"): 2, ("escalation_reason", "b"): 1,
    }


def test_layers_of_empty_tables_list_every_role_of_tasks(spark):
    packets = spark.createDataFrame([(1, 1, "failed", None, 0, 0, None), (1, 2, "extracted", "success", 2, 1, None)], "citing int, cited int, state string, outcome string, n_mentions int, n_bundled int, review boolean")
    tasks = spark.createDataFrame([(1, 2, "unclear", "skip_low_information"), (1, 1, "unclear", "skip_low_information")], "citing int, cited int, role string, mode string")
    got = {(r["section"], r["name"]): (r["n"], r["rate"]) for r in summaries.classification_layers(packets, tasks, rules.ROLES, rules.MODES).collect()}
    assert got["failure", "unknown"] == (1, None) and got["literature", "tasks"] == (1, None) and got["literature", "bundled_mentions"] == (1, 0.5)
    assert got["role", "unclear"] == (1, None) and got["role", "background_context"] == (0, None) and got["literature", "review_edges"] == (0, 0.0)
    assert summaries.classification_layers(packets.limit(0), tasks, rules.ROLES, rules.MODES).count() == 0


def test_headlines(spark):
    rows = [("screen", "failed", "No seeds produced.\n x \ny"), ("screen", "failed", "Command exited with code 2."), ("discover", "failed", None), ("discover", "succeeded", None), ("extract", "failed", "Command exited with code 2.\nlost"), ("curate", None, "  ")]
    df = spark.createDataFrame(rows, "stage string, status string, message string")
    got = [r[0] for r in df.select(summaries.headline(F.col("stage"), F.col("status"), F.col("message"), F.lit(None).cast("string"))).collect()]
    assert got == ["x", "Family viability and auditability", summaries.STOPPED, "Discovered claim units", "lost", "Audit sample"]
