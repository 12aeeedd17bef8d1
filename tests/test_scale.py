"""What grows with the tables: rounds, copies and hot keys, on small tables made for it."""

import random
import re

from pyspark.sql import functions as F

from __spark_entry__ import queries
from veriscope.functions import text
from veriscope.operators import graph, lineage


def leaves(df):
    plan = df._jdf.queryExecution().optimizedPlan().toString()
    return plan.count("LogicalRDD") + plan.count("Relation")


def test_lineage_plans_stay_small_in_many_rounds(spark):
    made = spark.createDataFrame([(k + 1, k, "now") for k in range(14)], "artifact long, source long, sha256 string")
    current = spark.createDataFrame([(k, "changed" if k == 0 else "now") for k in range(15)], "artifact long, sha256 string")
    out = lineage.stale_artifacts(made, current)
    assert leaves(out) < 12
    assert sorted(tuple(r) for r in out.collect()) == [(k, "stale", k, 0) for k in range(1, 15)]


def plan(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


def test_copies_of_titles_are_not_multiplied(spark):
    papers = spark.createDataFrame([(k, ["a b", "b c"] if k % 2 else ["b c", "a b", "c d"]) for k in range(60)], "paper_id long, grams array<string>")
    out = {(r["a"], r["b"]): (r["shared"], round(r["jaccard"], 6)) for r in graph.similar_sets(papers, 0.3).collect()}
    assert out == {(0, 1): (2, 0.666667)} | {(k % 2, k): (2 if k % 2 else 3, 1.0) for k in range(2, 60)}


def test_groups_without_pairs_equal_the_greedy_ones(spark):
    random.seed(5)
    titles = ["one two three four five six seven eight", "one two three four five six seven eight nine", "other words stand here now", "One two, three four five six seven eight!", ""]
    rows = [(k, random.choice([None, "", "x", "y", *[f"d{i}" for i in range(40)]]), random.choice([["A P", "B Q"], ["A Q", "B R"], ["A S"], []]), random.choice([None, 2000, 2002, 2005]), random.choice(titles), k % 3, k, random.choice(["article", "review"])) for k in range(150)]
    papers = spark.createDataFrame(rows, "paper_id long, doi string, authors array<string>, year int, title string, seed int, ord int, paper_type string")
    words = lambda t: "".join(c for c in t.lower() if c.isalnum() or c == " ").split()
    grams = lambda t: set(zip(words(t), words(t)[1:], strict=False))
    ends = lambda a: {a[0].split()[-1], a[-1].split()[-1]} if a else set()

    def reason(a, b):
        if a[1] and a[1] == b[1]:
            return "doi"
        if not ends(a[2]) & ends(b[2]):
            return None
        if words(a[4]) == words(b[4]):
            return "title"
        both, near = grams(a[4]) | grams(b[4]), a[3] is None or b[3] is None or abs(a[3] - b[3]) <= 2
        return "similar_title" if both and near and len(grams(a[4]) & grams(b[4])) / len(both) >= 0.7 else None

    heads, wanted = [], {}
    for r in rows:
        met = next(((h[0], why) for h in heads if h[5] == r[5] and (why := reason(h, r))), None)
        wanted[r[0]] = met or (r[0], "original")
        if not met:
            heads.append(r)
    assert {r["paper_id"]: (r["head"], r["reason"]) for r in graph.duplicate_groups(papers, "seed").collect()} == wanted
    pairs = {(r["a"], r["b"]): r["reason"] for r in graph.duplicate_pairs(papers).collect()}
    every = {(a[0], b[0]): why for k, b in enumerate(rows) for a in rows[:k] if (why := reason(a, b))}
    assert pairs.items() <= every.items() and len(pairs) < len(every) / 2

    def classes(links):
        of = {r[0]: r[0] for r in rows}
        for a, b in links:
            of = {k: of[a] if v == of[b] else v for k, v in of.items()}
        return {k: min(x for x in of if of[x] == v) for k, v in of.items()}

    assert classes(pairs) == classes(every)


def test_evidence_is_cut_as_mark_by_mark(spark):
    random.seed(3)
    texts = ["".join(random.choice("ab .!?\n é"[: random.choice((3, 9, 9))]) for _ in range(random.randrange(0, 26))) for _ in range(600)] + ["a" * 30, ".a" + "b" * 20, None]

    def plain(t, budget=8):
        if t is None or len(t) <= budget:
            return t
        mark = lambda k: re.search(r"[.!?](?:[ \t\n\x0b\f\r ]|$)", t[k : k + 2])
        limit = min(round(budget * 1.2), len(t))
        ks = [k for k in range(budget + 1) if mark(k)]
        ahead = [k for k in range(budget, limit) if mark(k)]
        kept = t[: ks[-1] + 1 if ks else ahead[0] + 1 if ahead else budget].rstrip(" ")
        return kept + " ..." if len(kept) < len(t) else kept

    df = spark.createDataFrame([(k, t) for k, t in enumerate(texts)], "k int, t string").select("k", text.truncate_at_sentence(F.col("t"), 8).alias("c"))
    assert "sequence" not in plan(df)
    assert {r["k"]: r["c"] for r in df.collect()} == {k: plain(t) for k, t in enumerate(texts)}


def test_steps_need_no_shuffle_pairs_or_python(spark, sf):
    found = queries()
    assert "Aggregate" not in plan(found["inverted_index_text"](spark, sf))
    assert "MapInArrow" not in plan(found["edited_texts"](spark, sf))
    assert "Window" not in plan(found["ref_match_priority"](spark, sf))
    assert all("rounds-" in f for f in found["claim_near_pairs"](spark, sf).inputFiles())
