"""Steps whose cost a row is bounded: cheap tests before patterns, tables read once."""

import random
import re

from pyspark.sql import functions as F

from __spark_entry__ import queries
from veriscope.functions import rules, text
from veriscope.operators import frontier, retrieval, rounds, sampling


def plan(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


LISTS = (rules.METHODS_SECTIONS, rules.METHODS_PHRASES, rules.ATTRIBUTION_VERBS, rules.BACKGROUND_PHRASES, rules.COMMENTARY_TITLES, (rules.BACKGROUND_SECTION,))


def passages():
    random.seed(7)
    words = sorted({w for patterns in LISTS for p in patterns for w in re.findall(r"[A-Za-z-]{2,}", re.sub(r"\\[bs]", " ", p))})
    words += ["a", "is", "well-studied", "showed", "showe", "review", "reviewed", "played", "plays", "methods", "Key", "protoſol", "x_role", "Role,", "10.1234/", "(2001)", "references", "Nature 2004"]
    cases = (str, str.upper, str.title, lambda w: w + "s", lambda w: w + "\n", lambda w: "é" + w)
    out = [" ".join(random.choice(cases if random.random() < 0.5 else cases[:1])(random.choice(words)) for _ in range(random.randrange(0, 30))) for _ in range(1500)]
    return out + ["as described in", "Has been WELL-studied", "plays a key role", "play role", "were fixed and data analysis", "RNA-SEQ", "a 10.1234/ 10.12345/ 10.1234/", "References (2001) (2002) (2003) Nature 2004", None]


def test_patterns_are_looked_for_only_where_they_may_occur(spark):
    rows = list(enumerate(passages()))
    found = lambda p, t: t is not None and re.search("(?i)" + p, t, re.A) is not None
    for patterns in LISTS:
        for p in patterns:
            assert all(any(x in m.group().lower() for x in text.literals(p)) for _, t in rows if t for m in re.finditer("(?i)" + p, t, re.A))
            assert min(map(len, text.literals(p))) >= 3
    df = spark.createDataFrame(rows, "k int, t string").withColumn("low", text.ascii_lower(F.col("t")))
    signals = rules.role_signals(F.col("low"), F.coalesce("t", F.lit("")))
    got = {r["k"]: tuple(r)[1:] for r in df.select("k", *[signals[n] for n in signals], rules._any_hit(F.col("t"), rules.COMMENTARY_TITLES), rules.context_type(F.col("t"), F.lit(""))).collect()}

    def kind(t):
        if t is None:
            return "unknown"
        signs = sum(re.search(p, t, re.A) is not None for p in rules.BIBLIOGRAPHY_SIGNALS)
        if len(re.findall(r"\b10\.\d{4,}/", t, re.A)) >= 3 or (signs >= 2 and len(re.findall(r"\(\d{4}\)", t, re.A)) >= 3):
            return "bibliography_like"
        if len(t) < 600 and any(found(p, t) for p in rules.METHODS_SECTIONS):
            return "methods_like"
        return "narrative_like" if len(t) >= 80 else "unknown"

    count = lambda patterns, t: sum(found(p, t) for p in patterns)
    for k, t in rows:
        wanted = (count(rules.METHODS_SECTIONS, t) > 0, found(rules.BACKGROUND_SECTION, t), *[count(p, t) for p in LISTS[1:4]], count(rules.COMMENTARY_TITLES, t) > 0, kind(t))
        assert got[k] == wanted, (t, got[k], wanted)
    assert len({v[-1] for v in got.values()}) == 4 and max(v[3] for v in got.values()) > 3


def test_roles_ask_for_texts_before_patterns(spark, sf):
    shown = plan(queries()["citation_role"](spark, sf))
    assert shown.count("Contains(") > 40


def test_rows_are_dealt_by_their_number(spark):
    df = spark.range(1000).withColumn("k", F.col("id") % 100)
    parts = rounds.dealt(df, "k", rows=50)
    assert parts.rdd.getNumPartitions() == 20 and rounds.dealt(df, "k").rdd.getNumPartitions() == 4
    assert plan(queries()["rubric_options"](spark, "/root/testdata/sf0.001")).count("RepartitionByExpression") == 1
    keys = parts.select("k", F.spark_partition_id().alias("p")).distinct()
    assert keys.count() == 100 and parts.count() == 1000


def plain_sample(tasks, total):
    """The two passes over one group, row by row."""
    quota = dict(sampling.targets(total, any(t[1] == sampling.AMBIGUOUS for t in tasks)))
    ranked, most, out = sorted(tasks, key=lambda t: (-t[2], t[0])), total // 4, {}
    for t in ranked:
        room = min(quota.get(t[1], 0), most if t[1] == sampling.AMBIGUOUS else total)
        if sum(m == t[1] for m, _ in out.values()) < room:
            out[t[0]] = (t[1], 1)
    for t in ranked:
        full = t[1] == sampling.AMBIGUOUS and sum(m == t[1] for m, _ in out.values()) >= most
        if t[0] not in out and not full and len(out) < total:
            out[t[0]] = (t[1], 2)
    return out


def test_samples_need_only_the_first_tasks_of_a_mode(spark, sf):
    random.seed(11)
    modes = [m for m, _ in sampling.SHARES] + [sampling.AMBIGUOUS, "skip_low_information"]
    rows = []
    for seed in range(12):
        some = random.sample(modes, random.randrange(1, 8))
        rows += [(seed, f"{seed}-{k:03d}", random.choice(some), random.random() < 0.4, random.random() < 0.3, random.choice(["background_context", "substantive_attribution"]), "retrieved", random.choice([5, 50]), "high") for k in range(random.choice([3, 15, 90]))]
    df = spark.createDataFrame(rows, "seed int, task_id string, mode string, bundled boolean, review boolean, role string, status string, relevance int, confidence string")
    score = {r["task_id"]: r["p"] for r in df.select("task_id", sampling.priority()[0].alias("p")).collect()}
    for total in (0, 4, 9, 20):
        got = {r["task_id"]: (r["mode"], r["pass"]) for r in sampling.stratified_sample(df, "seed", total).collect()}
        wanted = {}
        for seed in range(12):
            wanted |= plain_sample([(r[1], r[2], score[r[1]]) for r in rows if r[0] == seed], total)
        assert got == wanted
    assert "WindowGroupLimit" in plan(queries()["stratified_sample"](spark, sf))


def test_answers_of_places_are_looked_up_once(spark):
    places = spark.createDataFrame([(1, 0, k, k, "pdf", f"u{k}") for k in range(4)] + [(2, 0, 1, 1, "page", "page"), (2, 0, 90, 2, "pdf", "none")], frontier.PLACE)
    reads = spark.sparkContext.accumulator(0)
    rows = [("u3", 200, "pdf", None), ("u1", 500, "pdf", "gone"), ("page", 200, "html", None), ("x", 404, "xml", None)]

    def counted(batches):
        for b in batches:
            reads.add(b.num_rows)
            yield b

    answers = spark.createDataFrame(rows, "url string, status int, body string, error string").coalesce(1).mapInArrow(counted, "url string, status int, body string, error string")
    links = spark.createDataFrame([("page", 0, "xml", "x"), ("page", 1, "pdf", "x")], "url string, pos bigint, kind string, link string")
    log = {(r["paper_id"], r["attempt"]): (r["kind"], r["url"], r["outcome"], r["failure"]) for r in frontier.search(places, answers, links).collect()}
    assert log == {
        (1, 0): ("pdf", "u0", "network_error", "network_error u0"), (1, 1): ("pdf", "u1", "http_error", "gone"), (1, 2): ("pdf", "u2", "network_error", "network_error u2"), (1, 3): ("pdf", "u3", "selected", None),
        (2, 0): ("page", "page", "links", None), (2, 1): ("page_xml", "x", "http_error", "http_error x"), (2, 2): ("page_pdf", "x", "http_error", "http_error x"), (2, 3): ("pdf", "none", "network_error", "network_error none"),
    }
    assert reads.value <= 2 * len(rows)


def test_postings_are_dealt_by_document(spark, sf):
    docs = spark.createDataFrame([(k % 90, "alpha beta alpha-x " * (k % 4) + "beta") for k in range(100)] + [(91, None)], "doc_id int, text string")
    want = {}
    for r in docs.collect():
        words = (r["text"] or "").split()
        for w in ["", *words]:
            key = (r["doc_id"], w, len(words))
            want[key] = want.get(key, 0) + 1
    got = retrieval.asked_postings(docs, docs.select(F.explode(F.split("text", " ")).alias("term")), "doc_id", "text", [])
    assert {(r["doc_id"], r["term"], r["length"]): r["tf"] for r in got.collect()} == want
    # counted inside rows, then dealt by document alone: no aggregation of exploded terms before the exchange
    shown = got._jdf.queryExecution().executedPlan().toString()
    assert "partial_sum(tf" in shown and shown.index("partial_sum(tf") < shown.index("hashpartitioning(doc_id")
    shown = plan(retrieval.bm25(docs.withColumnRenamed("doc_id", "q").limit(2), docs, "q", "doc_id", 2))
    assert "RepartitionByExpression [doc_id" in shown
