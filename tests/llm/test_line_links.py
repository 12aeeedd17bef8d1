"""Line deduplication: link counts, large groups, rows that share ids, clashing columns."""

import random
from collections import defaultdict

import pytest

from tests.llm.test_text_ops import ODD, WORD, corpus, frame, line_classes
from veriscope.llm import linededup
from veriscope.llm.linededup import Limits, dedup_lines


def links(texts, threshold=80):
    """For each text the other line sets with which its lines are linked, summed over its lines."""
    own = [[frozenset(WORD.findall(x.encode().lower())) for x in (t.split("\n") if t is not None else [])] for t in texts]
    sets = {s for lines in own for s in lines if s}
    degree = {s: sum(100 * len(s & o) >= threshold * len(s | o) for o in sets) - 1 for s in sets}
    times = defaultdict(int)
    for lines in own:
        for s in lines:
            times[s] += 1
    return [sum(degree.get(s, 0) for s in lines) for lines in own]


def groups(seed=3):
    """Two large groups of near copies that share their rarest tokens, and a loose crowd around them."""
    rng = random.Random(seed)
    words = [f"v{k}" for k in range(60)]
    out = []
    for base in (rng.sample(words, 18) + ["rare1", "rare2"], rng.sample(words, 18) + ["rare1", "rare2"]):
        for _ in range(70):
            line = base[:]
            for _ in range(rng.randint(0, 4)):
                line[rng.randrange(18)] = rng.choice(words)
            out.append(" ".join(line))
    return out + [" ".join(rng.sample(words, 12) + ["rare1"]) for _ in range(60)]


@pytest.mark.parametrize("limits", [Limits(), Limits(few=6), Limits(few=30, dense=1, lines=16, tokens=200), Limits(few=10_000, dense=0, lines=7)])
def test_links_and_classes(spark, limits):
    texts = groups() + corpus(6)
    wanted, gone = links(texts), line_classes(texts, least=1)
    got = {r["doc_id"]: r for r in dedup_lines(frame(spark, texts), min_tokens=1, limits=limits).collect()}
    for k, t in enumerate(texts):
        assert (got[k]["line_links"], got[k]["removed_count"]) == (wanted[k], len(gone[k])), (k, t)


def test_rows_that_share_an_id(spark):
    rows = [(1, "kept line of this one row here\nan own second line of the first row"), (1, "something else on line one now\nkept line of this one row here"), (1, None), (None, "kept line of this one row here"), (2, "kept line of this one row HERE"), (2, "kept line of this one row HERE")]
    got = [(r["doc_id"], r["text"]) for r in dedup_lines(spark.createDataFrame(rows, "doc_id long, text string"), min_tokens=1).collect()]
    assert len(got) == len(rows) and (1, None) in got and (None, "kept line of this one row here") in got
    own = sorted(t for d, t in got if d == 1 and t is not None)
    assert sum("kept line" in t for t in own) == 1 and sum("own second line" in t for t in own) == 1 and sum("something else" in t for t in own) == 1
    assert [t for d, t in got if d == 2] == ["", ""]


def test_clashing_columns_and_odd_texts(spark):
    df = spark.createDataFrame([(k, t, k, "g", "f", 3) for k, t in enumerate(ODD)], "doc_id int, text string, _gone int, gone string, found string, line_count int")
    out = dedup_lines(df.withColumnRenamed("found", "number"), min_tokens=1)
    assert out.columns == ["doc_id", "text", "_gone", "gone", "number", "line_count", "removed_count", "lines_left", "line_classes", "line_links"]
    assert out.count() == len(ODD) and out.agg({"_gone": "sum"}).first()[0] == sum(range(len(ODD)))


def test_very_long_text(spark):
    rng = random.Random(1)
    long = "\n".join(f"line {k} with {rng.random()} and {rng.random()} in it" for k in range(60_000)) + "\n" + " ".join(f"word{k}" for k in range(30_000))
    got = {r["doc_id"]: r for r in dedup_lines(spark.createDataFrame([(1, long), (2, "line 5\n" + long)], "doc_id long, text string"), min_tokens=1).collect()}
    assert got[1]["removed_count"] == 0 and got[2]["text"] == "line 5"


def test_limits_are_no_part_of_the_result():
    assert linededup._least_joined(80) == 4
