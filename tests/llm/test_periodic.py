"""Periodic runs against a plain scan of every period, the planted tails, odd inputs, and the query against DuckDB."""

import hashlib
import random
import zlib
from fractions import Fraction

import numpy as np
import pytest
from pyspark.sql import functions as F

from veriscope.llm import periodic
from veriscope.llm.queries import queries


def plain_runs(words, least=24, times=3):
    """Every period by a scan of all neighbours at its distance."""
    found = {}
    for p in range(1, len(words) // times + 1):
        i = 0
        while i + p < len(words):
            j = i
            while j + p < len(words) and words[j] == words[j + p]:
                j += 1
            length = j - i + p
            if j > i and length >= max(least, times * p):
                found.setdefault((i, length), p)
            i = j + 1
    return sorted(((s, n, p) for (s, n), p in found.items()), key=lambda r: (r[0], r[2]))


def plain_row(doc_id, text):
    words = (text or "").encode().split()
    h = zlib.crc32(str(doc_id).encode())
    g, n = h // 10, len(words)
    if h % 10 == 0 and n:
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        words = [words[a + (i - a) % p] if i >= a else words[i] for i in range(n)]
    runs = plain_runs(words)
    gone = {k for s, m, p in runs for k in range(s + p, s + m)}
    best = min(runs, key=lambda r: (-Fraction(r[1], r[2]), r[0], r[2]), default=None)
    lines = "".join(f"{s},{m},{p}\n" for s, m, p in runs)
    left = b" ".join(w for k, w in enumerate(words) if k not in gone)
    milli = None if best is None else 1000 * best[1] // best[2]
    return (len(runs), *(best or (None,) * 3), milli, hashlib.sha256(lines.encode()).hexdigest(), hashlib.sha256(left).hexdigest())


def texts(seed=4):
    rng = random.Random(seed)
    out = [None, "", " \n\t", "one", "x " * 400, "a b " * 90 + "a", "a b a b c " * 30, "x " * 23, "x " * 24, " x " * 30]
    for _ in range(120):
        words = []
        while len(words) < rng.randint(1, 400):
            kind = rng.random()
            if kind < 0.5:
                words += [rng.choice("abc") for _ in range(rng.randint(1, 60))]
            elif kind < 0.8:
                piece = [rng.choice("abcdefgh") for _ in range(rng.randint(1, 30))]
                words += (piece * 9)[: rng.randint(1, 9 * len(piece))]
            else:
                words += ["ab"[k] for k in map(int, f"{rng.getrandbits(20):b}" * 3)]
        out.append(rng.choice([" ", "\n", " \t "]).join(words))
    return out + [out[40], out[40]]


@pytest.mark.parametrize("batch", [1 << 17, 50])
def test_runs_against_a_plain_scan(batch, monkeypatch):
    rows = [(t or "").encode().split() for t in texts()]
    for part in (rows[k : k + 40] for k in range(0, len(rows), 40)):
        part = part if batch > 100 else part[:12]
        known = {}
        codes = np.array([known.setdefault(w, len(known)) for r in part for w in r], np.int64)
        got = periodic.runs_of(codes, np.cumsum([0, *map(len, part)]), 24, 3)
        assert [[tuple(map(int, r)) for r in g] for g in got] == [plain_runs(r) for r in part]


def test_other_lengths_and_repeats():
    rng = np.random.default_rng(3)
    for least, times in ((1, 3), (5, 3), (10, 4), (6, 5)):
        for _ in range(30):
            codes = rng.integers(0, 3, rng.integers(1, 120))
            got = periodic.runs_of(codes, np.array([0, len(codes)]), least, times)[0]
            assert [tuple(map(int, r)) for r in got] == plain_runs(codes.tolist(), least, times)


def test_extensions_against_a_loop():
    rng = np.random.default_rng(5)
    for n in (1, 2, 3, 17, 40, 300):
        codes = np.concatenate([rng.integers(0, 2, n), [9]])
        if n == 300:
            codes[:200] = 1
        ext = periodic.Extensions(codes)
        a, b = (x.ravel() for x in np.meshgrid(np.arange(n + 2), np.arange(n + 2)))
        a, b = a[a != b], b[a != b]
        for x, y, got in zip(a, b, ext.of(a, b), strict=True):
            k = 0
            while max(x, y) + k < len(codes) and codes[x + k] == codes[y + k]:
                k += 1
            assert got == k


def test_query_rows_and_odd_inputs(spark, tmp_path):
    schema = "doc_id long, text string, runs string, best int, g long, w string, lang string"
    rows = [(k, t, "x", 1, 2, "y", None) for k, t in enumerate(texts())]
    rows += [(3, rows[30][1], None, None, None, None, None), (None, "a b c " * 20, None, None, None, None, None), (7, None, "x", 1, 2, "y", "z")]
    spark.createDataFrame(rows, schema).write.parquet(f"{tmp_path}/documents.parquet")
    got = queries()["op11_periodic_runs"](spark, str(tmp_path)).collect()
    names = ("n_runs", "start", "length", "period", "exponent_milli", "runs_sha256", "collapsed_sha256")
    wanted = [(d, *plain_row("" if d is None else d, t)) if d is not None else (None, 1, 0, 60, 3, 20000, hashlib.sha256(b"0,60,3\n").hexdigest(), hashlib.sha256(b"a b c").hexdigest()) for d, t, *_ in rows]
    assert sorted(map(repr, wanted)) == sorted(repr((r["doc_id"], *(r[c] for c in names))) for r in got)
    assert sum(zlib.crc32(str(d).encode()) % 10 == 0 for d, *_ in rows) > 5
    none = spark.createDataFrame([], schema)
    assert periodic.periodic_runs(none).count() == 0 and periodic.repeat_tails(none).count() == 0


def test_real_outputs(spark):
    docs = spark.createDataFrame([(1, "so  " + "buy now or never " * 8 + "\nend")], "doc_id long, text string")
    row = periodic.periodic_runs(docs).first()
    assert (row["n_words"], row["collapsed"]) == (34, "so buy now or never end")
    assert [tuple(r) for r in row["runs"]] == [(1, 32, 4)] and tuple(row["best"]) == (1, 32, 4)


def test_a_very_long_text(spark):
    words = [f"w{k % 977}" for k in range(60_000)] + [f"v{k}" for k in range(150_000)] + ["z"] * 90_000
    docs = spark.createDataFrame([(1, " ".join(words)), (2, "short one")], "doc_id long, text string")
    got = {r["doc_id"]: r for r in periodic.periodic_runs(docs).drop("collapsed").collect()}
    assert [tuple(r) for r in got[1]["runs"]] == [(0, 60_000, 977), (210_000, 90_000, 1)] and got[2]["runs"] == []


def test_lost_work_is_only_recomputed(spark):
    docs = spark.createDataFrame([(k, t) for k, t in enumerate(texts())], "doc_id long, text string")
    plan = periodic.periodic_runs(docs)._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and "MapInArrow" in plan
    assert periodic.run_digests(periodic.periodic_runs(docs)).where(F.length("runs_sha256") != 64).count() == 0
