"""Divergence of sources against a plain computation, with held sums and stretches cut small, and odd rows."""

import random
import re
from collections import Counter, defaultdict

import numpy as np
import pytest

from veriscope.llm import divergence as dv

TERM = re.compile(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+")
SCHEMA = "doc_id long, text string, lang string, source string, n int, term string, df string, document string"


def plain(rows, least, top):
    docs = [(t or "", lang or "", s or "") for _, t, lang, s, *_ in rows]
    df, counts = defaultdict(Counter), defaultdict(Counter)
    for t, lang, s in docs:
        own = TERM.findall("".join(c.lower() if "A" <= c <= "Z" else c for c in t))
        counts[lang, s].update(own)
        df[lang].update(set(own))
    out = []
    for lang in {lang for _, lang, _ in docs}:
        kept = [t for t, n in df[lang].items() if n >= least]
        groups = sorted({s for _, other, s in docs if other == lang})
        whole = sum((counts[lang, s] for s in groups), Counter())

        def share(own, kept=kept):
            total = sum(own[t] for t in kept) + 5 * len(kept)
            return {t: 1 + 10**9 * (own[t] + 5) // total for t in kept}

        p, q = {s: share(counts[lang, s]) for s in groups}, share(whole)
        for s in groups:
            pair = [(sum(abs(p[s][t] - p[o][t]) for t in kept), o) for o in groups if o != s]
            term = [(p[s][t] - q[t], t) for t in kept if counts[lang, s][t] and p[s][t] > q[t]]
            for part, found, most in (("pair", pair, 10**9), ("term", term, top)):
                found.sort(key=lambda x: (-x[0], x[1].encode()))
                out += [(lang, s, part, item, value, k + 1) for k, (value, item) in enumerate(found[:most])]
    return sorted(out)


def corpus(seed=2, sources=7):
    rng = random.Random(seed)
    vocabulary = ["the", "The", "über", "ñandú", "漢字", "a-b", "x1y", "Ärger", "ÄRGER", "don't", "é"] + [f"w{chr(97 + k)}{chr(97 + j)}" for k in range(8) for j in range(8)]
    rows = []
    for k in range(400):
        lang, s = rng.choice(["en", "en", "fr", None, ""]), rng.choice([f"s{j}" for j in range(sources)] + ["hot"] * 5 + [None])
        words = [rng.choice(vocabulary[: rng.randint(5, len(vocabulary))]) for _ in range(rng.randint(0, 40))]
        rows.append((k if k % 50 else None, rng.choice([" ", "\n", " 12 "]).join(words) if k % 31 else None, lang, s, 1, "x", "y", "z"))
    rows += [(1000 + k, "rare words here", "de", f"s{k % 3}", None, None, None, None) for k in range(6)]
    rows += [(2000, "only one source", "xx", "s1", None, None, None, None), (2001, "", "en", "empty", None, None, None, None), (2002, " \u0085  ", "en", "blank", None, None, None, None)]
    return rows + rows[:20]


@pytest.mark.parametrize(("held", "cells", "spread"), [(300_000, 1 << 20, 8), (50, 200, 3), (7, 20, 1)])
def test_against_a_plain_computation(spark, held, cells, spread, monkeypatch):
    monkeypatch.setattr(dv, "SPREAD", spread)
    monkeypatch.setattr(dv, "HELD", held)
    monkeypatch.setattr(dv, "CELLS", cells)
    rows = corpus()
    got = dv.source_divergence(spark.createDataFrame(rows, SCHEMA), least=9, top=5)
    assert got.columns == ["lang", "source", "part", "item", "value", "rank"] and got.schema["value"].dataType.simpleString() == "bigint" and got.schema["rank"].dataType.simpleString() == "int"
    wanted = plain(rows, 9, 5)
    assert sorted(map(tuple, got.collect())) == wanted and {r[2] for r in wanted} == {"pair", "term"}


@pytest.mark.parametrize(("held", "cells"), [(300_000, 1 << 20), (50, 200), (5, 20)])
def test_parts_in_small_pieces(held, cells, monkeypatch):
    """The same scans without Spark, where the limits surely hold."""
    monkeypatch.setattr(dv, "HELD", held)
    monkeypatch.setattr(dv, "CELLS", cells)
    import pyarrow as pa

    rows = [r for r in corpus(5) if r[2] == "en"]
    columns = [pa.array(x, t) for x, t in zip(zip(*[(r[0] or 0, r[1] or "", r[2], r[3] or "") for r in rows], strict=True), (pa.int64(), pa.string(), pa.string(), pa.string()), strict=True)]
    parts = pa.Table.from_batches(list(dv._combined(iter([pa.RecordBatch.from_arrays(columns, ["doc_id", "text", "lang", "source"])]))))
    parts = parts.sort_by([(c, "ascending") for c in ("lang", "term", "source", "document")])
    merged = pa.concat_tables(dv._merged(iter(parts.to_batches(max_chunksize=3))))
    wanted, df = Counter(), Counter()
    for r in rows:
        own = [t.decode() for t in dv.terms(r[1])]
        wanted.update((t, r[3] or "") for t in own)
        df.update({(t, r[3] or "") for t in own})
    assert {(r["term"], r["source"]): (r["n"], r["df"]) for r in merged.to_pylist()} == {k: (n, df[k]) for k, n in wanted.items()} and len(merged) == len(wanted)
    whole = list(dv._whole_terms(iter([merged.slice(k, 4) for k in range(0, len(merged), 4)])))
    assert sum(len(t.column("term").unique()) for t in whole) == len({t for t, _ in wanted})


def test_shares_are_exact():
    rng = random.Random(1)
    for _ in range(2000):
        total = rng.randint(1, 2 ** rng.randint(1, 52))
        count = rng.randint(0, total)
        assert int(dv.milliardths(np.array([count]), total)[0]) == 10**9 * count // total


def test_no_rows(spark):
    assert dv.source_divergence(spark.createDataFrame([], SCHEMA)).count() == 0
