"""Near-duplicates: rows that share ids, several large groups in one bucket, small blocks."""

import random

import pytest

from tests.llm.test_entry import near_classes
from tests.llm.test_text_ops import corpus, frame
from veriscope.llm.minhash import drop_near_duplicates, near_duplicates


def test_rows_that_share_an_id(spark):
    rng = random.Random(4)
    text = lambda: [f"t{rng.randrange(10**6)}" for _ in range(80)]
    a, b = text(), text()
    near = lambda t: " ".join([*t[:-1], "end"])
    rows = [(4, " ".join(a)), (4, " ".join(b)), (7, near(a)), (9, near(b)), (11, " ".join(text())), (None, near(a)), (4, " ".join(a))]
    got = sorted((str(r["doc_id"]), r["component_id"], r["kept"]) for r in near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect())
    assert got == [("11", 11, True), ("4", 4, True), ("4", 4, True), ("4", 4, True), ("7", 4, False), ("9", 4, False), ("None", None, True)]
    left = drop_near_duplicates(spark.createDataFrame([(*r, 1, "x") for r in rows], "doc_id int, text string, component_id int, kept string"))
    assert left.columns == ["doc_id", "text", "component_id", "kept"] and left.count() == 5


@pytest.mark.parametrize("limits", [{}, {"block": 8, "elements": 600, "large": 4}])
def test_chains_and_groups_in_one_bucket(spark, limits):
    rng = random.Random(8)
    stem = [f"s{k}" for k in range(120)]
    texts = []
    for part in range(4):  # groups of near copies of four texts that are loosely similar to each other
        base = stem[:90] + [f"g{part}-{k}" for k in range(30)]
        for _ in range(25):
            words = base[:]
            for _ in range(rng.randint(0, 2)):
                words[rng.randrange(120)] = f"e{rng.randrange(10**6)}"
            texts.append(" ".join(words))
    chain = stem[:]
    for k in range(60):  # each is near the one before, the ends are not near each other
        chain[2 * k % 120] = f"c{k}"
        texts.append(" ".join(chain))
    texts += corpus(9, 40)
    rng.shuffle(texts)
    c, sets = near_classes(dict(enumerate(texts)))
    for r in near_duplicates(frame(spark, texts), **limits).collect():
        assert (r["n_shingles"], r["component_id"]) == (len(sets[r["doc_id"]]), c.find(r["doc_id"]))
