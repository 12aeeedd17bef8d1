"""Shapes of answers against a plain checker, and what each stage does with an answer that breaks them."""

import json

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from veriscope.functions import shapes
from veriscope.operators import answers
from veriscope.sources import artifacts

ALL = {"string": str, "boolean": bool, "array": list, "object": dict}


def plain_kind(v, there=True):
    if not there:
        return "undefined"
    if v is None:
        return "null"
    return next((k for k, t in ALL.items() if isinstance(v, t)), "number")


def plain_error(v, shape, path=(), there=True):
    """All errors of a value in order; the first is the operator's."""
    got, at = plain_kind(v, there), ".".join(map(str, path)) + ": "
    if (got == "null" and shape.nullable) or (got == "undefined" and shape.optional):
        return []
    if shape.options:
        return [] if got == "string" and v in shape.options else [at + "Invalid option: expected one of " + "|".join(f'"{o}"' for o in shape.options)]
    if shape.kind == "int":
        if got != "number":
            return [f"{at}Invalid input: expected number, received {got}"]
        return [] if v == int(v) else [f"{at}Invalid input: expected int, received number"]
    if got != shape.kind:
        return [f"{at}Invalid input: expected {shape.kind}, received {got}"]
    out = []
    for name, part in shape.fields.items():
        out += plain_error(v.get(name), part, (*path, name), name in v)
    if shape.item is not None:
        for k, x in enumerate(v):
            out += plain_error(x, shape.item, (*path, k))
    if shape.least and len(v) < shape.least:
        out.append(f"{at}Too small: expected {shape.kind} to have >={shape.least} {'items' if shape.kind == 'array' else 'characters'}")
    return out


SHAPE = shapes.fields(
    a=shapes.many(shapes.fields(t=shapes.string(2), n=shapes.one_of("x", "yy", nullable=True), w=shapes.many(shapes.whole(), 1, nullable=True))),
    b=shapes.boolean(nullable=True),
    c=shapes.number(),
    d=shapes.string(optional=True),
)
LEAF = st.one_of(st.none(), st.booleans(), st.integers(-5, 5), st.sampled_from([0.5, -2.25]), st.sampled_from(["", "x", "yy", "zzz"]))
ANY = st.recursive(LEAF, lambda x: st.one_of(st.lists(x, max_size=3), st.dictionaries(st.sampled_from("abctnw"), x, max_size=3)), max_leaves=6)
ENTRY = st.fixed_dictionaries({}, optional={"t": st.one_of(st.just("yy"), ANY), "n": st.one_of(st.sampled_from(["x", "yy", None]), ANY), "w": st.one_of(st.lists(st.integers(0, 3), min_size=1, max_size=2), ANY)})
NEAR = st.fixed_dictionaries({"a": st.one_of(st.lists(ENTRY, max_size=3), ANY), "c": st.one_of(st.integers(0, 9), ANY)}, optional={"b": st.one_of(st.booleans(), ANY), "d": st.one_of(st.just("x"), ANY)})

FITS = st.fixed_dictionaries(
    {"a": st.lists(st.fixed_dictionaries({"t": st.just("yy"), "n": st.sampled_from(["x", "yy", None]), "w": st.one_of(st.none(), st.lists(st.integers(0, 3), min_size=1, max_size=2))}), max_size=2), "c": st.integers(0, 9), "b": st.sampled_from([True, None])},
    optional={"d": st.just("")},
)


def test_first_error_is_that_of_a_plain_checker(spark):
    values = []

    @settings(max_examples=400, deadline=None, database=None, derandomize=True)
    @given(st.one_of(NEAR, ANY, FITS))
    def gather(v):
        values.append(v)

    gather()
    df = spark.createDataFrame([(k, json.dumps(v)) for k, v in enumerate(values)], "k int, t string").repartition(4)
    got = {r["k"]: r["e"] for r in df.select("k", shapes.first_error(F.parse_json("t"), SHAPE).alias("e")).collect()}
    wanted = {k: next(iter(plain_error(v, SHAPE)), None) for k, v in enumerate(values)}
    assert got == wanted
    assert sum(w is None for w in wanted.values()) > 5 and len(set(wanted.values())) > 20


CALL = "citing long, seed long, model string, response_text string, failure string"


def item(mention, inside=True, **other):
    return {"mentionId": mention, "inScopeEmpiricalAttribution": inside, "attributedClaimText": "c" if inside else None, "supportSpanText": None, "confidence": "high" if inside else None, "reasonIfExcluded": None if inside else "vague"} | other


def test_one_record_for_each_mention(spark):
    mentions = spark.createDataFrame([("m1", 1, 9), ("m2", 1, 9), ("m3", 1, 9), ("m1", 1, 8), ("m4", 2, 9), ("m5", 3, 9), ("m6", 4, 9), ("m7", None, 9), ("m8", 5, 9)], "mention_id string, citing long, seed long")
    said = {"extractions": [item("m1"), item("m2", False), item("m1", False, reasonIfExcluded="second"), item("m4"), item("unknown")]}
    calls = spark.createDataFrame(
        [
            (1, 9, "x", "```json\n" + json.dumps(said) + "\n```", None),
            (1, 8, "x", json.dumps({"extractions": [], "more": 1}), None),
            (2, 9, "x", json.dumps({"extractions": [item("m4", confidence="sure")]}), None),
            (3, 9, "x", json.dumps(said), "HTTP 500"),
            (4, 9, "x", None, None),
        ],
        CALL,
    )
    got = {(r["mention_id"], r["citing"], r["seed"]): (r["in_scope"], r["claim"], r["confidence"], r["reason"]) for r in answers.attributed_claims(mentions, calls).collect()}
    nothing = (False, None, None)
    assert got == {
        ("m1", 1, 9): (*nothing, "second"),
        ("m2", 1, 9): (*nothing, "vague"),
        ("m3", 1, 9): (*nothing, "LLM did not return a result for this mention"),
        ("m1", 1, 8): (*nothing, "LLM did not return a result for this mention"),
        ("m4", 2, 9): (*nothing, 'LLM returned invalid JSON: extractions.0.confidence: Invalid option: expected one of "high"|"medium"|"low"'),
        ("m5", 3, 9): (*nothing, "HTTP 500"),
        ("m6", 4, 9): (*nothing, "LLM returned invalid JSON: No valid JSON found in LLM response (0 chars). First 200 chars: "),
        ("m7", None, 9): (*nothing, "No call covers this mention"),
        ("m8", 5, 9): (*nothing, "No call covers this mention"),
    }
    assert answers.attributed_claims(mentions.limit(0), calls).count() == 0
    assert answers.attributed_claims(mentions, calls.limit(0)).count() == 9


def test_clusters_stop_the_job_on_a_bad_answer(spark):
    families = spark.createDataFrame([(1, 0), (2, 0), (2, 1)], "seed long, index long")
    good = '{"clusters": [{"cluster": 1, "memberIndices": [0, 1], "representativeIndex": 1, "reasoning": "r"}]}'
    schema = "seed long, response_text string, failure string"
    got = answers.claim_clusters(families, spark.createDataFrame([(2, good, None)], schema)).collect()
    assert {(r["seed"], r["cluster"], r["index"], r["representative"]) for r in got} == {(1, 1, 0, True), (2, 1, 0, False), (2, 1, 1, True)}
    for text, failure, message in ((good.replace("1,", '"one",', 1), None, "clusters.0.cluster"), ("no", None, "No valid JSON"), (good, "HTTP 529", "HTTP 529")):
        with pytest.raises(Exception, match=message):
            answers.claim_clusters(families, spark.createDataFrame([(2, text, failure)], schema)).collect()
    with pytest.raises(Exception, match="No call covers"):
        answers.claim_clusters(families, spark.createDataFrame([], schema)).collect()


def test_second_look_takes_over_only_where_the_first_is_unsure(spark):
    def said(verdict="supported", confidence="high", **other):
        return json.dumps({"comparison": "c", "verdict": verdict, "rationale": "r", "retrievalQuality": "low", "judgeConfidence": confidence} | other)

    records = spark.createDataFrame([(1, False, False), (2, False, False), (3, True, False), (4, False, False), (5, False, True), (6, None, None), (7, False, False)], "task_id long, bundled boolean, excluded boolean")
    call = "task_id long, model string, response_text string, failure string"
    first = spark.createDataFrame([(1, "a", said(), None), (2, "a", said(confidence="low"), None), (3, "a", said(confidence="medium"), None), (4, "a", said("maybe"), None), (5, "a", said(), None), (6, "a", said(confidence="medium"), None)], call)
    second = spark.createDataFrame([(k, "b", said("not_supported"), "HTTP 500" if k == 4 else None) for k in (1, 2, 3, 4, 5, 6)], call)
    got = {r["task_id"]: (r["verdict"], r["adjudicator"], r["passes"]) for r in answers.adjudicate(records, first, second).collect()}
    assert got == {
        1: ("supported", "llm:a:thinking", 1),
        2: ("not_supported", "llm:b", 2),
        3: ("not_supported", "llm:b", 2),
        4: ("cannot_determine", "llm:b:error", 2),
        5: (None, None, 0),
        6: ("supported", "llm:a:thinking", 1),
        7: ("cannot_determine", "llm:none:error", 2),
    }
    one = {r["task_id"]: (r["verdict"], r["rationale"]) for r in answers.adjudicate(records, first).collect()}
    assert one[2] == ("supported", "r") and one[4][0] == "cannot_determine" and "verdict: Invalid option" in one[4][1]


def test_artifacts_name_the_first_broken_place(spark, tmp_path):
    shape = shapes.fields(runs=shapes.many(shapes.fields(id=shapes.whole())))
    good, bad, root = tmp_path / "good.json", tmp_path / "bad.json", tmp_path / "root.json"
    good.write_text('{"runs": [{"id": 1}]}')
    bad.write_text('{"runs": [{"id": 1}, {"id": "2"}]}')
    root.write_text("[1]")
    assert artifacts.load_json(spark, str(good), "runs array<struct<id:long>>", "run", shape=shape).count() == 1
    with pytest.raises(artifacts.ArtifactError, match=r"Invalid run artifact at .*bad.json: runs.1.id Invalid input: expected number, received string"):
        artifacts.load_json(spark, str(bad), "runs array<struct<id:long>>", "run", shape=shape)
    with pytest.raises(artifacts.ArtifactError, match="<root> Invalid input: expected object, received array"):
        artifacts.load_json(spark, str(root), "runs array<struct<id:long>>", "run", shape=shape)
