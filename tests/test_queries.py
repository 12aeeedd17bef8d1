"""Every registered query of the reference's operators against DuckDB on the same tables."""

import random

import duckdb
import pytest

from veriscope.operators import retrieval
from veriscope.plans import registry

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
#: One category is all that these can have on the test tables.
ONE_CATEGORY = {"diff_summary", "extraction_summary", "claim_near_pairs", "active_run", "dashboard_stats"}


@pytest.fixture(scope="module")
def duck(sf):
    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"CREATE VIEW {t} AS FROM '{sf}/{t}.parquet'")
    return con


def rows(df):
    df = df[sorted(df.columns)].copy()
    for c in df.columns:
        if df[c].dtype.kind == "f":
            df[c] = df[c].round(5)
    return sorted(map(str, df.astype(object).where(df.notna(), None).itertuples(index=False, name=None)))


@pytest.mark.parametrize("name", sorted(registry.oracle_sql()))
def test_matches_sql(spark, sf, duck, name):
    got, wanted = registry.queries()[name](spark, sf).toPandas(), duck.sql(registry.oracle_sql()[name]).df()
    assert sorted(got.columns) == sorted(wanted.columns)
    assert len(got) > 0
    assert rows(got) == rows(wanted)
    if name not in ONE_CATEGORY:
        assert len(set(rows(got))) > 1


def test_papers_without_titles_do_not_meet(spark):
    from veriscope.operators import graph

    rows = [(k, None if k % 2 else "", [f"A {k}"] if k % 3 else [], None, "" if k % 5 else None) for k in range(3000)] + [(9001, "", ["B Same"], 2000, "!"), (9002, "", ["C Other", "D same"], 2001, "")]
    papers = spark.createDataFrame(rows, "paper_id long, doi string, authors array<string>, year int, title string")
    assert [tuple(r) for r in graph.duplicate_pairs(papers).collect()] == [(9001, 9002, "title")]


def test_greedy_paper_groups_follow_heads(spark, sf):
    from veriscope.operators import graph
    from veriscope.sources import testdata as td

    pairs = {(r["a"], r["b"]): r["reason"] for r in graph.duplicate_pairs(td.papers(spark, sf)).where("a % 20 = b % 20").collect()}
    heads: dict[int, list[int]] = {}
    wanted = {}
    for paper in sorted(r["paper_id"] for r in td.papers(spark, sf).select("paper_id").collect()):
        mine = heads.setdefault(paper % 20, [])
        head = next((h for h in mine if (h, paper) in pairs), None)
        if head is None:
            mine.append(paper)
        wanted[paper] = (paper, "original") if head is None else (head, pairs[head, paper])
    got = {r["paper_id"]: (r["head"], r["reason"]) for r in registry.queries()["greedy_paper_groups"](spark, sf).collect()}
    assert got == wanted


def test_diverse_shortlist_is_greedy(spark):
    from veriscope.operators.claims import diverse_shortlist

    f = spark.createDataFrame([(1, "a", ["1", "2", "3"], "grounded", 9), (1, "b", ["1", "2", "3"], "grounded", 8), (1, "c", ["4"], "ambiguous", 7), (1, "d", [], "not_found", 1)], "doi long, family_id string, citing_ids array<string>, status string, n_mentions int")
    assert [r["family_id"] for r in diverse_shortlist(f, cap=3).orderBy("rank").collect()] == ["a", "c", "d"]


def test_greedy_families_use_exact_before_near(spark):
    from veriscope.operators.claims import greedy_families

    f = spark.createDataFrame([(1, "f1", "X rises", None), (1, "f2", "x  rises!", None), (1, "f3", "other", None), (1, "f4", "third", None)], "doi long, family_id string, tracked string, normalized string")
    near = spark.createDataFrame([("f1", "f3")], "a string, b string")
    got = {r["family_id"]: (r["head"], r["strategy"]) for r in greedy_families(f, near).collect()}
    assert got == {"f1": ("f1", "none"), "f2": ("f1", "exact_normalized_claim"), "f3": ("f1", "near_duplicate_claim"), "f4": ("f4", "none")}


def greedy(families, pairs):
    """{family: (head, strategy)} by a fold in order of id, one seed after the other."""
    out = {}
    for seed in {f[0] for f in families}:
        exact, heads = {}, []
        for _, name, tracked, canonical in sorted(f for f in families if f[0] == seed):
            head, how = exact.get(("t", tracked)) or exact.get(("c", canonical)), "exact_normalized_claim"
            if head is None:
                head, how = next((h for h in heads if (h, name) in pairs), None), "near_duplicate_claim"
            if head is None:
                head, how = name, "none"
                heads.append(name)
            exact.setdefault(("t", tracked), head)
            exact.setdefault(("c", canonical), head)
            out[name] = (head, how)
    return out


def test_greedy_families_against_a_fold(spark):
    from veriscope.operators.claims import greedy_families

    draw = random.Random(7)
    families = [(k % 3, f"f{k:03}", f"t{draw.randrange(40)}", f"c{draw.randrange(40)}") for k in range(150)]
    pairs = {tuple(sorted(draw.sample([f[1] for f in families], 2))) for _ in range(2500)}
    f = spark.createDataFrame(families, "doi long, family_id string, tracked string, normalized string")
    got = {r["family_id"]: (r["head"], r["strategy"]) for r in greedy_families(f, spark.createDataFrame(list(pairs), "a string, b string")).collect()}
    assert got == greedy(families, pairs)
    assert len({how for _, how in got.values()}) == 3


def test_near_pairs_lose_no_contained_claim(spark):
    from veriscope.operators.claims import near_duplicate_pairs

    claims = ["", "a", "row", "arrows fly", "ows fl", "s", "flies over the narrow", "ies over the narr", "the narrow flies over the hill", "is of no"]
    rows = [(1, f"g{k}", c, None, s, "grounded") for k, (c, s) in enumerate((c, s) for c in claims for s in ("", "an arrows fly", "it flies over the narrow hill", "to of"))] + [(2, "z", "row", None, "an arrows fly", "grounded")]
    f = spark.createDataFrame(rows, "doi long, family_id string, tracked string, normalized string, support string, status string")
    got = {(r["a"], r["b"]) for r in near_duplicate_pairs(f).collect()}
    words = lambda x: {w for w in x.split() if len(w) >= 3}
    wanted = set()
    for _, a, ca, _, sa, _ in rows[:-1]:
        for _, b, cb, _, sb, _ in rows[:-1]:
            either, both = words(sa) | words(sb), words(sa) & words(sb)
            alike = len(both) / len(either) >= 0.6 if either else True
            if a < b and (ca == cb or (sa and sb and (alike or cb in sa or ca in sb))):
                wanted.add((a, b))
    assert got == wanted


def test_deltas_are_checked(spark, sf):
    from veriscope.operators.compare import apply_deltas
    from veriscope.sources import testdata as td

    base = td.audit_base(spark, sf)
    excluded = base.where("excluded").first()["task_id"]
    active = base.where("not excluded").first()["task_id"]
    schema = "task_id long, final_verdict string, rationale string, quality string, excluded boolean, exclude_reason string, allow_excluded boolean"
    make = lambda *ids: spark.createDataFrame([(i, "supported", None, None, None, None, False) for i in ids], schema)
    for ids, message in (((active, active), "duplicate delta"), ((10**12,), "unknown task"), ((excluded,), "excluded record")):
        with pytest.raises(ValueError, match=message):
            apply_deltas(base, make(*ids))
    assert apply_deltas(base, make(active)).where("touched").count() == 1
    with pytest.raises(ValueError, match="exclusion not allowed"):
        apply_deltas(base, spark.createDataFrame([(active, "supported", None, None, True, None, None)], schema))


def test_deltas_and_blinding_reach_every_field(spark):
    from veriscope.operators.compare import JUDGED, apply_deltas, blind

    told = "verdict string, rationale string, quality string, confidence string, adjudicator string, adjudicated_at string, telemetry string, vector_trace string, routing string"
    base = spark.createDataFrame([(k, k == 2, "why" if k == 2 else None, *"abcdefghi") for k in (1, 2, 3)], f"task_id long, excluded boolean, exclude_reason string, {told}")
    seen = {r["task_id"]: [r[c] for c in JUDGED] for r in blind(base).collect()}
    assert seen == {1: [None] * 9, 2: list("abcdefghi"), 3: [None] * 9}
    deltas = spark.createDataFrame([(1, "x", None, "y", "z", None, None, None), (2, "x", None, None, None, False, None, True)], "task_id long, final_verdict string, rationale string, quality string, confidence string, excluded boolean, exclude_reason string, allow_excluded boolean")
    got = {r["task_id"]: [r[c] for c in (*JUDGED, "excluded", "exclude_reason", "touched")] for r in apply_deltas(base, deltas).collect()}
    assert got[1] == ["x", "b", "y", "z", "e", "f", "g", None, None, False, None, True]
    assert got[2] == ["x", "b", "c", "d", "e", "f", "g", None, None, False, "why", True]
    assert got[3] == [*"abcdefghi", False, None, False]


def test_bm25_plan_prunes_before_the_join(spark, sf):
    plan = registry.queries()["bm25_topk"](spark, sf)._jdf.queryExecution().explainString(spark._jvm.org.apache.spark.sql.execution.ExplainMode.fromString("formatted"))
    assert "WindowGroupLimit" in plan and "CartesianProduct" not in plan
    docs, asked = spark.read.parquet(f"{sf}/documents.parquet"), spark.createDataFrame([("cell",)], "term string")
    read = retrieval.asked_postings(docs, asked, "doc_id", "text", [])._jdf.queryExecution().explainString(spark._jvm.org.apache.spark.sql.execution.ExplainMode.fromString("formatted"))
    assert "ReadSchema: struct<doc_id:bigint,text:string>" in read and "LeftSemi" in read
    assert read.count("Scan parquet") == 2  # in the tree and in the details: the texts are read once
    assert read.index("BroadcastHashJoin LeftSemi") > read.index("HashAggregate")  # the tree lists parents first: terms go before they are counted
    many = retrieval.asked_postings(docs, asked, "doc_id", "text", [], most=0)
    assert sorted(map(str, many.collect())) == sorted(map(str, retrieval.asked_postings(docs, asked, "doc_id", "text", []).collect()))
