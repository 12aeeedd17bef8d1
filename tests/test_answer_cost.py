"""Answers that fit are passed at a glance, with the same verdict on them as when they are taken apart."""

import json

from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from veriscope.functions import shapes
from veriscope.functions.text import json_from_answer, variant_from_answer
from veriscope.operators import answers

FLAT = shapes.fields(t=shapes.string(2), n=shapes.one_of("x", "4", "true"), b=shapes.boolean(), d=shapes.string(optional=True), z=shapes.one_of("x", nullable=True))
VALUE = st.one_of(st.none(), st.booleans(), st.sampled_from([4, 0.5, "", "x", "4", "true", "yyy", [], ["x"], {}, {"x": 1}]))
FITS = st.fixed_dictionaries({"t": st.sampled_from(["yy", "yyy"]), "n": st.sampled_from(["x", "4", "true"]), "b": st.booleans(), "d": st.just(""), "z": st.just("x")}, optional={"extra": VALUE})
NEAR = st.fixed_dictionaries({}, optional={k: st.one_of(st.just("x"), VALUE) for k in ("t", "n", "b", "d", "z", "extra")})


def test_a_fault_of_a_flat_shape_is_the_first_error(spark):
    values = []

    @settings(max_examples=300, deadline=None, database=None, derandomize=True)
    @given(st.one_of(FITS, NEAR, VALUE, st.tuples(FITS, st.sampled_from("tnbdz"), VALUE).map(lambda x: x[0] | {x[1]: x[2]})))
    def gather(v):
        values.append(json.dumps(v))

    gather()
    df = spark.createDataFrame([(v,) for v in values], "t string").withColumn("v", F.parse_json("t"))
    got = df.select("t", shapes.first_fault(F.col("v"), FLAT).alias("fault"), shapes.first_error(F.col("v"), FLAT).alias("error"), shapes._fits(F.col("v"), FLAT).alias("fits")).collect()
    assert [r["t"] for r in got if r["fault"] != r["error"] or (r["fits"] and r["error"])] == []
    assert any(r["fits"] for r in got) and any(r["error"] for r in got) and any(r["error"] is None and not r["fits"] for r in got)


def test_an_answer_is_parsed_once_as_before(spark):
    texts = ["", "  ", "no", "null", "4", '"x"', ' {"a": 1} ', 'well {"a": 1} so', "[1]", "so [1, 2] {", "{]", 'x\n```json\n{"a": 2}\n``` {"a": 3}', '```\n\n``` {"a": 3}', "``` {", '{"a": 1} {"b": 2}', '[{"a": 1}]', '{"a": 1, "a": 2}', None]
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    told = df.select("t", F.to_json(variant_from_answer(F.col("t"))).alias("now"), F.to_json(F.try_parse_json(json_from_answer(F.col("t")))).alias("before")).collect()
    assert [r for r in told if r["now"] != r["before"]] == []


def test_what_all_answers_run_is_compiled(spark):
    """The JVM compiles no method beyond 8,000 bytes; what is longer is interpreted, row by row."""
    call = "task_id long, model string, response_text string, failure string"
    calls = lambda k: spark.range(k).select("id", F.lit("a"), F.concat(F.lit('{"verdict": "'), F.col("id")), F.when(F.col("id") > 1, "x")).toDF(*[c.split()[0] for c in call.split(", ")])
    records = spark.range(3).select(F.col("id").alias("task_id"), (F.col("id") == 1).alias("bundled"), F.lit(False).alias("excluded"))
    before = spark.conf.get("spark.sql.adaptive.enabled")
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        plan = answers.adjudicate(records, calls(3), calls(2))._jdf.queryExecution().executedPlan()
        code = getattr(getattr(spark._jvm.org.apache.spark.sql.execution.debug, "package$"), "MODULE$").codegenStringSeq(plan)
        sizes = [code.apply(k)._3().maxMethodCodeSize() for k in range(code.size())]
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", before)
    assert sizes and max(sizes) <= 8000


def test_answers_are_held_against_their_shape_in_as_many_tasks_as_shuffles_have(spark):
    calls = spark.range(100).select(F.col("id").alias("task_id"), F.lit("a").alias("model"), F.lit("{}").alias("response_text"), F.lit(None).cast("string").alias("failure"))
    records = spark.range(0, 100, 1, 1).select(F.col("id").alias("task_id"), F.lit(False).alias("bundled"), F.lit(False).alias("excluded"))
    out = answers.adjudicate(records, calls, calls)
    assert out.rdd.getNumPartitions() == int(spark.conf.get("spark.sql.shuffle.partitions"))
