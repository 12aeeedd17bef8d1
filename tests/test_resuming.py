"""Runs that die and go on, writers at once, best-first search, waves of sources, reuse and adaptive rounds, against plain versions."""

import random
import threading
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from veriscope.operators import adaptive, frontier, incremental, lineage, papercache, resolve, vectors
from veriscope.plans import orchestrate
from veriscope.sources import commits
from veriscope.sources import testdata as td


def rows(df):
    return sorted(map(repr, (r.asDict() for r in df.collect())))


# ---- runs


class Killed(BaseException):
    """The driver is gone: nothing catches it."""


def steps(spark, calls, die_in=None, raise_in=None):
    def step(key, needs, compute):
        def run(frames):
            calls.append(key)
            if key == raise_in:
                raise ValueError(f"{key} broke\nsecond line")
            out = compute(frames)
            if key == die_in:
                out.write.parquet(f"{calls.root}/data/r/{key}/lost")  # written, never committed
                raise Killed
            return out

        return orchestrate.Step(key, needs, run)

    return [
        step("discover", (), lambda f: spark.range(100).withColumnRenamed("id", "seed")),
        step("screen", ("discover",), lambda f: f["discover"].where("seed % 3 = 0")),
        step("extract", ("discover", "screen"), lambda f: f["screen"].join(f["discover"].withColumnRenamed("seed", "other"), F.col("other") < F.col("seed"))),
        step("classify", ("extract",), lambda f: f["extract"].groupBy("seed").agg(F.count("*").alias("n"))),
    ]


class Calls(list):
    root = ""


@pytest.mark.parametrize("dies", ["discover", "screen", "extract", "classify"])
def test_a_killed_run_goes_on_where_it_was(spark, tmp_path, dies):
    whole = orchestrate.run(spark, f"{tmp_path}/whole", "r", steps(spark, Calls()))
    calls = Calls()
    calls.root = root = f"{tmp_path}/killed"
    with pytest.raises(Killed):
        orchestrate.run(spark, root, "r", steps(spark, calls, die_in=dies))
    state = {r["stage_key"]: r["status"] for r in orchestrate.states(spark, root).collect()}
    assert state[dies] == "running" and state[""] == "running"
    before = list(calls)
    again = orchestrate.run(spark, root, "r", steps(spark, calls))
    assert calls[len(before) :] == [k for k in ("discover", "screen", "extract", "classify") if k not in before[:-1]]
    for key, frame in whole.items():
        assert rows(again[key]) == rows(frame)
    keep = ["stage_key", "family", "status", "n_rows", "error"]
    assert rows(orchestrate.states(spark, root).select(*keep)) == rows(orchestrate.states(spark, f"{tmp_path}/whole").select(*keep))
    log = commits.read(spark, root, "states", orchestrate._STATE).where(F.col("stage_key") == dies).orderBy("_seq")
    assert [r["status"] for r in log.collect()] == ["running", "interrupted", "running", "succeeded"]


def test_a_failing_stage_ends_the_run(spark, tmp_path):
    root, calls = f"{tmp_path}/r", Calls()
    with pytest.raises(ValueError, match="screen broke"):
        orchestrate.run(spark, root, "r", steps(spark, calls, raise_in="screen"))
    state = {r["stage_key"]: (r["status"], r["error"]) for r in orchestrate.states(spark, root).collect()}
    assert state == {"discover": ("succeeded", None), "screen": ("failed", "screen broke"), "": ("failed", "screen broke")}
    orchestrate.run(spark, root, "r", steps(spark, calls))
    assert calls == ["discover", "screen", "screen", "extract", "classify"]


def test_stages_after_a_changed_one_are_computed_anew(spark, tmp_path):
    root, calls = f"{tmp_path}/r", Calls()
    orchestrate.run(spark, root, "r", steps(spark, calls))
    tracker = orchestrate.Tracker(spark, root, "r")
    tracker.invalidate("screen")
    state = {r["stage_key"]: (r["status"], r["part"]) for r in tracker.states().where("stage_key in ('extract', 'classify', 'screen')").collect()}
    assert state == {"extract": ("stale", None), "classify": ("stale", None), "screen": ("not_started", None)}
    calls.clear()
    orchestrate.run(spark, root, "r", steps(spark, calls))
    assert calls == ["screen", "extract", "classify"]


def test_families_of_a_run(spark, tmp_path):
    tracker = orchestrate.Tracker(spark, f"{tmp_path}/r", "r")
    tracker.start("extract", [0, 1, 2])
    tracker.success("extract", "p", 5, 1)
    tracker.blocked("evidence", "no quota", 2)
    tracker.block_pending(spark.range(3).select(F.col("id").alias("family")), "provider is gone")
    got = defaultdict(set)
    for r in tracker.states().where("stage_key <> ''").collect():
        got[r["stage_key"]].add((r["family"], r["status"], r["error"]))
    assert got["extract"] == {(0, "running", None), (1, "succeeded", None), (2, "running", None)}
    assert got["evidence"] == {(2, "blocked", "no quota"), (0, "blocked", "provider is gone"), (1, "blocked", "provider is gone")} and len(got["curate"]) == 3
    tracker.end("interrupted", orchestrate.INTERRUPTED)
    assert {r["status"] for r in tracker.states().where("stage_key = 'extract'").collect()} == {"interrupted", "succeeded"}


def test_migrations_apply_once_in_order(spark, tmp_path):
    root, seen = f"{tmp_path}/m", []
    one = {"002_b": lambda s, r: seen.append("b"), "001_a": lambda s, r: seen.append("a")}
    assert orchestrate.migrate(spark, root, one) == ["001_a", "002_b"] and seen == ["a", "b"]

    def broken(s, r):
        raise RuntimeError("no")

    with pytest.raises(RuntimeError):
        orchestrate.migrate(spark, root, one | {"003_c": lambda s, r: seen.append("c"), "004_d": broken})
    assert orchestrate.migrate(spark, root, one | {"003_c": lambda s, r: seen.append("c"), "004_d": lambda s, r: seen.append("d")}) == ["004_d"] and seen == ["a", "b", "c", "d"]


# ---- commits and the cache


def test_writers_at_once_lose_nothing(spark, tmp_path):
    root = f"{tmp_path}/c"
    threads = [threading.Thread(target=lambda k=k: commits.publish(spark.range(k * 10, k * 10 + 10).withColumn("v", F.lit(k)), root, "t")) for k in range(6)]
    compactor = threading.Thread(target=lambda: commits.compact(spark, root, "t", "id bigint, v int", ["id"]))
    for t in [*threads[:3], compactor, *threads[3:]]:
        t.start()
    for t in [*threads, compactor]:
        t.join()
    read = lambda: rows(commits.latest(commits.read(spark, root, "t", "id bigint, v int"), ["id"]).drop("_seq"))
    wanted = sorted(repr({"id": k * 10 + j, "v": k}) for k in range(6) for j in range(10))
    assert read() == wanted
    commits.compact(spark, root, "t", "id bigint, v int", ["id"])
    assert read() == wanted and commits.commits(spark, root, "t").count() == 1
    assert commits.sweep(spark, root) >= 6 and read() == wanted
    assert commits.read(spark, f"{tmp_path}/none", "t", "id bigint").count() == 0


def test_last_writer_stays_after_compaction(spark, tmp_path):
    root = f"{tmp_path}/c"
    for v in range(3):
        commits.publish(spark.range(2).withColumn("v", F.lit(v)), root, "t")
    commits.compact(spark, root, "t", "id bigint, v int", ["id"])
    commits.publish(spark.range(1).withColumn("v", F.lit(9)), root, "t")
    assert {r["id"]: r["v"] for r in commits.latest(commits.read(spark, root, "t", "id bigint, v int"), ["id"]).collect()} == {0: 9, 1: 2}


def test_papers_are_parsed_only_where_the_cache_does_not_fit(spark, tmp_path):
    cache, parsed = papercache.PaperCache(spark, f"{tmp_path}/p"), []

    def parse(df):
        parsed.extend(sorted(r["paper_id"] for r in df.select("paper_id").collect()))
        return df.where("paper_id <> 4").select("paper_id", F.when(F.col("content") != "bad", F.upper("content")).alias("parsed"), F.when(F.col("content") == "bad", "no body").alias("error"))

    def go(contents, version="1", policy="prefer_cache", format_="jats_xml"):
        parsed.clear()
        papers = spark.createDataFrame([(k, format_, c) for k, c in contents.items()], "paper_id bigint, format string, content string")
        return {r["paper_id"]: (r["state"], r["parsed"], r["error"]) for r in cache.materialize(papers, parse, version, F.current_timestamp(), policy).collect()}

    assert go({1: "a", 2: "b", 3: "bad", 4: "gone"}) == {1: ("parsed", "A", None), 2: ("parsed", "B", None), 3: ("parsed", None, "no body"), 4: ("parsed", None, "the parser gave nothing")}
    assert go({1: "a", 2: "c", 3: "bad"}) == {1: ("cached", "A", None), 2: ("parsed", "C", None), 3: ("parsed", None, "no body")} and parsed == [2, 3]
    assert go({1: "a", 2: "c"}) and parsed == []
    assert go({1: "a"}, version="2")[1][0] == "parsed" and go({1: "a"}, version="2")[1][0] == "cached"
    assert go({2: "c"}, format_="grobid_tei_xml")[2][0] == "parsed" and go({1: "a"}, "2", "force_refresh")[1][0] == "parsed"
    cache.evict("parsed", spark.createDataFrame([(2,)], "paper_id bigint"))
    cache.compact("parsed")
    assert {r["paper_id"] for r in cache.rows("parsed").collect()} == {1}
    with pytest.raises(ValueError):
        cache.lookup(spark.createDataFrame([], "paper_id bigint, format string, content_hash string"), "1", "guess")


# ---- search and resolution


def plain_search(places, answers, links):
    log = []
    for paper in {p[0] for p in places}:
        queue, seen = [], set()
        for _, *p in sorted((p for p in places if p[0] == paper), key=lambda p: p[1:4]):
            if (p[3], p[4]) not in seen:
                seen.add((p[3], p[4]))
                queue.append(tuple(p))
        attempt = 0
        while queue:
            queue.sort()
            phase, _, _, kind, url = queue.pop(0)
            status, body, error = answers.get(url, (None, None, None))
            if status is None:
                outcome = "network_error"
            elif status >= 400:
                outcome = "http_error"
            elif body != frontier.WANTED[kind]:
                outcome = "wrong_body"
            elif kind != "page":
                outcome = "selected"
            else:
                outcome = "links" if links.get(url) else "no_links"
            log.append((paper, attempt, phase, kind, url, outcome, None if outcome in ("selected", "links") else error or f"{outcome} {url}"))
            if outcome == "selected":
                break
            if outcome == "links":
                for pos, (target, link) in enumerate(links[url]):
                    name, priority = frontier.LINKED[target]
                    if (name, link) not in seen:
                        seen.add((name, link))
                        queue.append((phase, priority, (attempt + 1) * 1_000_000 + pos, name, link))
            attempt += 1
    return sorted(map(repr, log))


def test_search_against_a_plain_queue(spark):
    rng = random.Random(3)
    places, answers, links = [], {}, defaultdict(list)
    for paper in range(60):
        for k in range(rng.randint(0, 7)):
            kind = rng.choice(list(frontier.WANTED))
            url = f"u{paper}/{rng.randint(0, 9)}"
            places.append((paper, rng.randint(0, 1), rng.choice([10, 20, 60, 70, 110]), k, kind, url))
        for j in range(10):
            if rng.random() < 0.8:
                answers[f"u{paper}/{j}"] = (rng.choice([200, 200, 200, 404, 500]), rng.choice(["xml", "pdf", "html", "html", "json", None]), rng.choice([None, None, "slow"]))
            for _ in range(rng.choice([0, 0, 1, 3])):
                links[f"u{paper}/{j}"].append((rng.choice(["xml", "pdf"]), f"u{paper}/{rng.randint(0, 9)}"))
    log = frontier.search(
        spark.createDataFrame(places + places[:3], frontier.PLACE),
        spark.createDataFrame([(u, *a) for u, a in answers.items()], "url string, status int, body string, error string"),
        spark.createDataFrame([(u, pos, kind, link) for u, found in links.items() for pos, (kind, link) in enumerate(found)], "url string, pos bigint, kind string, link string"),
    )
    got = sorted(repr(tuple(r)) for r in log.collect())
    assert got == plain_search(places, answers, links) and len({r.split("'")[5] for r in got}) == 6
    papers = spark.createDataFrame([(k,) for k in range(61)], "paper_id bigint")
    ended = {r["paper_id"]: r for r in frontier.acquired(papers, log).collect()}
    assert len(ended) == 61 and ended[60]["failure"] == frontier.NOTHING_TO_TRY and not ended[60]["ok"]
    assert sum(r["ok"] for r in ended.values()) == sum("'selected'" in r for r in got)
    none = frontier.search(spark.createDataFrame([], frontier.PLACE), spark.createDataFrame([], "url string, status int, body string, error string"), spark.createDataFrame([], "url string, pos bigint, kind string, link string"))
    assert none.count() == 0


def test_each_source_is_asked_only_for_what_is_left(spark):
    wanted = spark.createDataFrame(
        [(1, "d1", "p1", None, "t", ["A B"], 2000), (2, None, "p2", "c2", "t", ["A B"], 2000), (3, None, None, "", "Same title", ["X Yu"], 2001), (4, None, None, None, "Two fit", [], None), (5, None, None, None, None, None, None), (6, "dx", None, None, "Same title", ["X Yu"], 2001)],
        "want bigint, doi string, pmid string, pmcid string, title string, authors array<string>, year int",
    )
    answer = "by string, key string, paper_id bigint, error string"
    sources = {"one": spark.createDataFrame([("doi", "d1", 11, None), ("pmid", "p2", None, "HTTP 500")], answer), "two": spark.createDataFrame([("pmcid", "c2", 22, None), ("doi", "dx", None, "HTTP 404")], answer)}
    papers = spark.createDataFrame([(31, "same TITLE!", ["Q Yu"], 2002), (41, "two fit", ["A"], 1), (42, "Two fit", [], 9), (51, "", [], 0)], "paper_id bigint, title string, authors array<string>, year int")
    got = {r["want"]: (r["paper_id"], r["step"], r["error"], r["asked"]) for r in resolve.resolve(wanted, sources, {"one": papers.where("paper_id = 42"), "two": papers}).collect()}
    assert got[1] == (11, "one:doi", None, ["one:doi"])
    assert got[2] == (22, "two:pmcid", None, ["one:pmid", "two:pmid", "one:pmcid", "two:pmcid"])
    assert got[3] == (31, "two:metadata", None, ["one:metadata", "two:metadata"])
    assert got[4][:2] == (42, "one:metadata") and got[5][:3] == (None, "two:metadata", "two: no paper fits")
    assert got[6] == (None, "two:doi", "HTTP 404", ["one:doi", "two:doi"])
    assert resolve.resolve(wanted.limit(0), sources, {"one": papers}).count() == 0


# ---- reuse, lineage, rounds


def test_only_changed_families_are_computed(spark, tmp_path):
    root, computed = f"{tmp_path}/f", []
    edges = spark.range(3000).select((F.col("id") % 300).alias("seed"), F.col("id").alias("citing"), F.when(F.col("id") % 7 != 0, F.col("id") % 5).alias("w"))
    edges = edges.unionByName(edges.where("seed < 2").withColumn("seed", F.col("seed") + 900))  # families of equal content

    def compute(df):
        out = df.groupBy("seed").agg(F.sum("w").alias("total"), F.count("*").alias("n")).where("seed % 50 <> 7")  # some families give no row
        computed.append((df.select("seed").distinct().count(), df.count()))
        return out

    def go(df, version="1"):
        return incremental.recompute(spark, root, "m", df, "seed", compute, "total bigint, n bigint", version)

    first, marks = go(edges)
    assert computed == [(300, 3000)] and {r["state"]: r["count"] for r in marks.groupBy("state").count().collect()} == {"computed": 300, "shared": 2}
    assert rows(first) == rows(edges.groupBy("seed").agg(F.sum("w").alias("total"), F.count("*").alias("n")).where("seed % 50 <> 7"))
    again, marks = go(edges.orderBy(F.desc("citing")).repartition(3))
    assert len(computed) == 1 and {r["state"] for r in marks.collect()} == {"reused"} and rows(again) == rows(first)
    changed = edges.withColumn("w", F.when((F.col("seed") % 100 == 5) & (F.col("citing") < 1000), None).otherwise(F.col("w")))
    third, marks = go(changed)
    assert computed[1:] == [(3, 30)] and marks.where("state = 'computed'").count() == 3
    assert rows(third) == rows(changed.groupBy("seed").agg(F.sum("w").alias("total"), F.count("*").alias("n")).where("seed % 50 <> 7"))
    go(changed.where("seed < 10"), "2")
    assert computed[2] == (10, 100)

    def broken(df):
        raise RuntimeError

    with pytest.raises(RuntimeError):
        incremental.recompute(spark, root, "m", edges.withColumn("w", F.lit(1)), "seed", broken, "total bigint, n bigint", "1")
    assert rows(go(edges)[0]) == rows(first) and len(computed) == 3


def test_fingerprints_tell_nulls_and_copies_apart(spark):
    groups = {1: [("a", None)], 2: [(None, "a")], 3: [("a", None), ("a", None)], 4: [("a", "b"), ("c", "d")], 5: [("c", "d"), ("a", "b")], 6: [("a", "d"), ("c", "b")]}
    df = spark.createDataFrame([(k, *r) for k, rs in groups.items() for r in rs], "k bigint, x string, y string")
    got = {r["k"]: r["fingerprint"] for r in incremental.fingerprints(df, "k").collect()}
    assert got[4] == got[5] and len(set(got.values())) == 5


def test_staleness_runs_down_and_ends_in_cycles(spark):
    made = spark.createDataFrame([("b", "a", "1"), ("c", "b", "1"), ("d", "c", "1"), ("d", "x", "1"), ("e", "y", "1"), ("p", "q", "1"), ("q", "p", "1"), ("p", "gone", "1")], "artifact string, source string, sha256 string")
    now = spark.createDataFrame([("a", "2"), ("b", "1"), ("c", "1"), ("x", "1"), ("y", "1"), ("p", "1"), ("q", "1")], "artifact string, sha256 string")
    got = {r["artifact"]: tuple(r)[1:] for r in lineage.stale_artifacts(made, now).collect()}
    assert got == {"b": ("stale", 1, "a"), "c": ("stale", 2, "a"), "d": ("stale", 3, "a"), "e": ("holds", None, None), "p": ("stale", 1, "gone"), "q": ("stale", 2, "gone")}


@pytest.mark.parametrize(("initial", "most", "step"), [(3, 8, None), (2, 8, 1), (1, 7, 3), (8, 8, None)])
def test_draws_against_a_plain_loop(spark, sf, initial, most, step):
    samples = td.vector_samples(spark, sf).where("not (record_id % 11 = 3 and sample >= 4) and record_id % 17 <> 5").persist()
    sizes = spark.createDataFrame([(p,) for p in range(1, 9)], "p int")
    keyed = samples.crossJoin(sizes).where("sample < p").withColumn("record_id", F.col("record_id") * 10 + F.col("p"))
    reasons = {(r["record_id"] // 10, r["record_id"] % 10): list(r["r"]) for r in vectors.axis_verdict(vectors.aggregate_samples(keyed)).select("record_id", vectors.adaptive_reasons().alias("r")).collect()}
    have = {r["record_id"]: r["count"] for r in samples.groupBy("record_id").count().collect()}
    ids = sorted(r["record_id"] for r in td.vector_samples(spark, sf).select("record_id").distinct().collect())
    wanted = {}
    for k in ids:
        asked, n, rounds, first = initial, 0, 1, None
        while True:
            before, n = n, min(asked, have.get(k, 0))
            why = reasons.get((k, n))
            first = why if first is None else first
            state = "failed" if n == 0 else "decided" if not why else "exhausted" if n == before or asked >= most else None
            if state:
                wanted[k] = (n, rounds, first or [], why or [], state)
                break
            asked += (most - asked) if step is None else min(step, most - asked)
            rounds += 1
    drawn, told = adaptive.adaptive_samples(spark.createDataFrame([(k,) for k in ids], "record_id bigint"), adaptive.replayed(samples), initial, most, step)
    assert {r["record_id"]: tuple(r)[1:] for r in told.collect()} == wanted
    assert {r["record_id"]: r["count"] for r in drawn.groupBy("record_id").count().collect()} == {k: w[0] for k, w in wanted.items() if w[0]}
    samples.unpersist()


def test_bounds_of_samples(spark):
    with pytest.raises(ValueError):
        adaptive.adaptive_samples(spark.createDataFrame([], "record_id bigint"), lambda w: w, 4, 3)
