"""Pre-screening and extraction of many seeds, call telemetry and log files as streams."""

import random

import pytest
from pyspark.sql import functions as F

from veriscope.plans import prescreen, screening_chain
from veriscope.sources import commits
from veriscope.streaming import logsource, progress, telemetry


def rows(df):
    return sorted(map(repr, (tuple(r) for r in df.collect())))


# ---- chains


def test_a_broken_seed_leaves_the_others_as_they_were(spark, sf):
    seeds, resolved, grounded, citing, published, scores, answers = screening_chain._inputs(spark, sf)
    families, edges = prescreen.prescreen(seeds, resolved, grounded, citing, published, scores, answers)
    some = [r["seed"] for r in families.where("decision = 'greenlight' and priority <> 'first'").orderBy("seed").limit(2).collect()]
    assert len(some) == 2
    hit = F.col("seed").isin(some)
    broken = resolved.where(~hit).unionByName(spark.createDataFrame([(some[0], None, "HTTP 500")], "seed bigint, paper_id bigint, error string"))
    odd = grounded.where(F.col("seed") != some[0]).unionByName(spark.createDataFrame([(some[0], None, None, None), (some[0], None, "x" * 1000, "grounded")], "seed bigint, ok boolean, error string, status string"))
    after, edges_after = prescreen.prescreen(seeds, broken, odd, citing, published, scores, answers)
    assert rows(after.where(~hit)) == rows(families.where(~hit)) and rows(edges_after.where(~hit)) == rows(edges.where(~hit))
    told = {r["seed"]: (r["decision"], r["rule"], r["reason"], r["total_edges"]) for r in after.where(hit).collect()}
    assert told == {some[0]: ("deprioritize", "seed_unresolved", "Seed could not be resolved: HTTP 500", 0), some[1]: ("deprioritize", "seed_unresolved", "Seed could not be resolved: no answer", 0)}
    assert edges_after.where(hit).count() == 0
    none = prescreen.prescreen(*[x.limit(0) for x in (seeds, resolved, grounded, citing, published, scores, answers)])
    assert none[0].count() == 0 and none[1].count() == 0


def test_the_filter_can_be_skipped_and_fails_open(spark):
    edges = spark.createDataFrame([(1, k) for k in range(6)], "seed bigint, citing bigint")
    scores = spark.createDataFrame([(1, 0, 10.0), (1, 1, 2.2), (1, 2, 2.1), (1, 3, 9.0), (1, 4, 8.0), (9, 5, 50.0)], "seed bigint, citing bigint, score double")
    answers = spark.createDataFrame([(1, 3, False), (1, 3, False), (1, 4, None), (1, 2, True)], "seed bigint, citing bigint, relevant boolean")
    got = {r["citing"]: (r["score"], r["in_family"]) for r in prescreen.claim_family(edges, scores, answers).collect()}
    assert got == {0: (10.0, True), 1: (2.2, True), 2: (2.1, False), 3: (9.0, False), 4: (8.0, True), 5: (0.0, False)}
    assert {(r["score"], r["in_family"]) for r in prescreen.claim_family(edges, scores, answers, skip=True).collect()} == {(1.0, True)}


def test_extraction_takes_earlier_harvests_and_skips_with_a_reason(spark):
    families = spark.createDataFrame([(1, False), (2, True)], "seed bigint, blocked boolean")
    edges = spark.createDataFrame([(1, 10, "auditable_pdf", True), (1, 11, "auditable_pdf", False), (1, 12, "not_auditable", True), (1, 13, "partially_auditable", True), (1, 14, "auditable_pdf", True), (1, 15, "auditable_pdf", True), (2, 10, "auditable_pdf", True)], "seed bigint, citing bigint, status string, in_family boolean")
    harvested = spark.createDataFrame([(10, "success", "jats_xml"), (13, "success", "grobid_tei"), (14, "http_403", None)], "citing bigint, outcome string, source string")
    long = "It was shown and demonstrated in detail that growth rose in all of the samples (Smith et al. 2010)."
    mention = "cited bigint, citing bigint, ord int, context string, marker string, section string, ref_id string, at bigint, bundled boolean, bundle_size int, review boolean"
    mentions = spark.createDataFrame([(1, 10, k, long, "(Smith et al. 2010)", "Results", "r1", 5, False, 1, False) for k in range(2)] + [(1, 14, 0, long, "m", None, None, None, False, 1, False)], mention)
    held = spark.createDataFrame([(1, 13, 0, long, "(Smith et al. 2010)", "Results", "r1", 5, False, 1, False), (None, 15, None, None, None, None, None, None, None, None, None)], mention)
    results, kept = prescreen.extract_edges(families, edges, harvested, mentions, held)
    got = {(r["seed"], r["citing"]): (r["outcome"], r["n_raw"], r["n_deduped"], r["failure"]) for r in results.collect()}
    assert got == {
        (1, 10): ("success_structured", 2, 1, None), (1, 11): ("skipped_not_auditable", 0, 0, prescreen.OUTSIDE), (1, 12): ("skipped_not_auditable", 0, 0, prescreen.NOT_AUDITABLE), (1, 13): ("success_pdf", 1, 1, None),
        (1, 14): ("fail_http_403", 0, 0, "http_403"), (1, 15): ("fail_ref_found_but_no_in_text_xref", 0, 0, "ref_found_but_no_in_text_xref"), (2, 10): ("skipped_not_auditable", 0, 0, prescreen.NOT_GROUNDED),
    }
    assert kept.count() == 3
    summary = {r["seed"]: r for r in prescreen.family_summary(results).collect()}
    assert (summary[1]["attempted"], summary[1]["successful"], summary[1]["raw_mentions"], summary[2]["attempted"]) == (4, 2, 3, 0)


# ---- telemetry


def calls(seed=1, n=400):
    rng = random.Random(seed)
    out = []
    for k in range(n):
        minute = k // 4 + rng.randint(0, 5)  # out of order by less than the watermark allows
        out.append((k, k % 3, rng.choice(["extract", "screen", None]), rng.choice(["fidelity-vector", "rerank"]), "m", f"2024-01-01 {minute // 60:02d}:{minute % 60:02d}:00", rng.random() < 0.9, rng.randint(1, 99), rng.randint(1, 99), rng.randint(1, 999)))
    return [x for c in out for x in ([c, c] if rng.random() < 0.2 else [c])]


def frame(spark, part):
    df = spark.createDataFrame(part, "event_id bigint, run_id bigint, stage string, purpose string, model string, at string, successful boolean, input_tokens bigint, output_tokens bigint, latency_ms bigint")
    return df.withColumn("at", F.to_timestamp("at")).withColumn("micro_usd", (F.col("input_tokens") * 3).cast("decimal(38,8)"))


def test_a_restarted_stream_equals_the_batch(spark, tmp_path, monkeypatch):
    source, root, told = f"{tmp_path}/in", f"{tmp_path}/out", calls()
    closing = (10**6, 0, "end", "rerank", "m", "2024-01-02 00:00:00", True, 1, 1, 1)  # moves the watermark past every window
    parts = [told[:150], told[150:300], [*told[300:], closing], [(10**6 + 1, *closing[1:5], "2024-01-03 00:00:00", *closing[6:])]]
    publish, published = commits.publish, []

    def go(stream, name):
        q = telemetry.append(stream, root, name, f"{tmp_path}/cp-{name}")
        q.awaitTermination(120)

    def streamed():
        return spark.readStream.schema(frame(spark, []).schema).parquet(source)

    def dies(rows_, root_, name, info=None, replaces=None):
        if name == "windows" and "died" not in published:
            published.append("died")
            part = publish(rows_, root_, name, info, replaces)  # committed, but the stream does not learn of it
            raise RuntimeError(f"gone after {part}")
        published.append(name)
        return publish(rows_, root_, name, info, replaces)

    monkeypatch.setattr(commits, "publish", dies)
    for part in parts:
        frame(spark, part).coalesce(1).write.mode("append").parquet(source)
        for name, make in (("windows", telemetry.windows), ("calls", telemetry.once)):
            try:
                go(make(streamed()), name)
            except Exception as error:
                assert "gone after" in str(error)
                go(make(streamed()), name)
    assert "died" in published
    schema = "start timestamp, stage string, purpose string, calls bigint, successful bigint, input_tokens bigint, output_tokens bigint, latency_ms bigint, micro_usd decimal(38,8)"
    batch = telemetry.windows(frame(spark, told)).select("start", "stage", "purpose", "calls", "successful", "input_tokens", "output_tokens", "latency_ms", F.col("micro_usd").cast("decimal(38,8)"))
    assert rows(commits.read(spark, root, "windows", schema).drop("_seq").where("stage is null or stage <> 'end'")) == rows(batch)
    wanted = telemetry.telemetry(frame(spark, told))
    assert rows(telemetry.telemetry(telemetry.read_calls(spark, root)).where("calls > 0").join(wanted.select("run_id", "model"), ["run_id", "model"], "left_semi").select("run_id", "vector_calls")) == rows(wanted.select("run_id", "vector_calls"))
    assert telemetry.read_calls(spark, root).count() == telemetry.read_calls(spark, root).select("event_id").distinct().count() == 402


# ---- log files


@pytest.mark.parametrize("stretch", [1 << 20, 40])
def test_lines_of_growing_files_come_once_in_their_order(spark, tmp_path, monkeypatch, stretch):
    monkeypatch.setattr(logsource, "STRETCH", stretch)
    folder, out = tmp_path / "logs", f"{tmp_path}/lines"
    folder.mkdir()
    logsource.register(spark)
    written = {"a.log": [], "b.log": []}

    def write(name, *lines, end=b"\n"):
        with open(folder / name, "ab") as file:
            for line in lines:
                file.write(line.encode() + end)

    def go():
        q = spark.readStream.format("run_logs").load(str(folder)).writeStream.format("parquet").option("checkpointLocation", f"{tmp_path}/cp").trigger(availableNow=True).start(out)
        q.awaitTermination(120)
        got = {}
        for r in sorted(spark.read.parquet(out).collect(), key=lambda r: (r["file"], r["seq"])):
            got.setdefault(r["file"], []).append(r["value"])
        return got

    for k in range(3):  # a restart of the query each time
        for name in written:
            new = [f"{name} line {k}-{j} " + "é" * (7 * j) for j in range(6)]
            write(name, *new)
            written[name] += new
        with open(folder / "a.log", "ab") as file:
            file.write(b"half")  # not a line yet
        assert go() == written
        write("a.log", " of a line")
        written["a.log"].append("half of a line")
    write("c.log", "", "late file", end=b"\r\n")
    assert go() == written | {"c.log": ["", "late file"]}
    assert spark.read.format("run_logs").load(str(folder)).count() == sum(map(len, written.values())) + 2


def test_progress_from_log_files(spark, tmp_path):
    folder = tmp_path / "logs"
    folder.mkdir()
    event = lambda step, status: progress.PREFIX + f'{{"stage": "extract", "step": "{step}", "status": "{status}"}}'
    (folder / "r1.log").write_text("hello\n" + event("fetch", "running") + "\n" + event("fetch", "completed") + "\n" + event("parse", "running") + "\n")
    (folder / "r2.log").write_text(event("parse", "running") + "\n" + event("fetch", "running") + "\n")
    states = {(r["run_id"], r["step"]): r["status"] for r in progress.snapshot(progress.from_logs(spark, str(folder), streaming=False)).collect()}
    assert states == {("r1", "fetch"): "completed", ("r1", "parse"): "running", ("r1", "mentions"): "pending", ("r2", "fetch"): "running", ("r2", "parse"): "pending", ("r2", "mentions"): "pending"}
    q = progress.stream(progress.from_logs(spark, str(folder))).writeStream.outputMode("update").format("memory").queryName("from_logs").option("checkpointLocation", f"{tmp_path}/cp").trigger(availableNow=True).start()
    q.awaitTermination(120)
    assert {(r["run_id"], r["step"]): r["status"] for r in spark.table("from_logs").collect()} == states
    assert spark.read.format("run_logs").load(str(tmp_path / "none")).count() == 0


def test_texts_that_edges_share_are_looked_at_once(spark):
    families = spark.createDataFrame([(s, False) for s in (1, 2)], "seed bigint, blocked boolean")
    edges = spark.createDataFrame([(s, c, "auditable_pdf", c != 12) for s in (1, 2) for c in range(10, 17)], "seed bigint, citing bigint, status string, in_family boolean")
    harvested = spark.createDataFrame([(c, "success", "jats_xml") for c in range(10, 16)], "citing bigint, outcome string, source string")
    long = "It was shown and demonstrated in detail that growth rose in all of the samples (Smith et al. 2010)."
    text = [(t, k, long if k < 2 else f"{long} {k}", "(Smith et al. 2010)", "Results", "r1", 5, False, 1, False) for t in (7, 8) for k in range(2 + t % 2)]
    texts = spark.createDataFrame(text, "text bigint, ord int, context string, marker string, section string, ref_id string, at bigint, bundled boolean, bundle_size int, review boolean")
    named = spark.createDataFrame([(s, c, 7 + c % 2) for s in (1, 2) for c in (10, 11, 12, 13, 14)], "cited bigint, citing bigint, text bigint")
    held = spark.createDataFrame([(1, 13, 7), (None, 14, None), (2, 16, 8)], "cited bigint, citing bigint, text bigint")
    whole = lambda df: df.join(texts, "text", "left").drop("text")
    plain = prescreen.extract_edges(families, edges, harvested, whole(named), whole(held))
    once = prescreen.extract_edges(families, edges, harvested, named, held, texts)
    assert rows(once[0]) == rows(plain[0]) and rows(once[1].select(plain[1].columns)) == rows(plain[1]) and once[1].count() > 0
    bare = [prescreen.extract_edges(families, edges, harvested, *x)[0] for x in ((whole(named),), (named, None, texts))]
    assert rows(bare[0]) == rows(bare[1])


def test_edges_scores_and_answers_meet_in_one_exchange(spark):
    edges = spark.createDataFrame([(s, c, "x" if c % 2 else None) for s in range(5) for c in range(6)], "seed bigint, citing bigint, title string")
    scores = spark.createDataFrame([(s, c, float(c + s)) for s in range(1, 6) for c in range(1, 9)] + [(1, 1, 2.0)], "seed bigint, citing bigint, score double")
    answers = spark.createDataFrame([(s, 3, s % 2 == 0) for s in range(6)], "seed bigint, citing bigint, relevant boolean")
    out = prescreen.claim_family(edges, scores, answers)
    assert out._jdf.queryExecution().executedPlan().toString().count("Exchange") == 1
    got = {(r["seed"], r["citing"]): (r["title"], r["score"], r["in_family"]) for r in out.collect()}
    score = lambda s, c: float(c + s) if s and c else 0.0
    assert out.count() == 30 and got == {(s, c): ("x" if c % 2 else None, score(s, c), s > 0 and score(s, c) >= 0.22 * (5 + s) and not (c == 3 and s % 2)) for s in range(5) for c in range(6)}
