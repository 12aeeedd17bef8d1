"""Long pages and texts, other capitals, items of numbers, clashing columns, tables without rows."""

import random
import time

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from veriscope.llm import html, pii, urlrules
from veriscope.llm.decontaminate import drop_leaks, find_leaks
from veriscope.llm.quality import drop_low_quality
from veriscope.llm.toxicity import score_toxicity


@pytest.mark.parametrize("piece", ["<div>", "<b>x</i>", "<p><b>", "</div><span>", "<a href='", '<i "', "<li>y", "<!-- ", "<td>z</th>"])
def test_pages_of_unclosed_markup_take_linear_time(piece):
    page = "<article><p>before it all</p></article>" + piece * (500_000 // len(piece))
    began = time.process_time()
    assert html.main_text(page).startswith("before it all")
    assert time.process_time() - began < 8


def test_article_around_furniture_and_pages_without_one():
    inside = "<article><nav><a href='/'>Home</a> Menu</nav><h1>Title</h1><p>First <b>part</b> of it.</p><aside>Advert</aside><p>Second.</p><div class='comments'>Nice!</div></article><footer>Legal</footer>"
    assert html.main_text(inside) == "Title\nFirst part of it.\nSecond."
    two = "<main><p>One.</p></main><div>noise</div><article><p>Two.</p></article>"
    assert html.main_text(two) == "One.\nTwo."
    plain = "<body><ul class=menu><li>Home</ul><div>" + "A long paragraph of the text. " * 8 + "</div><p>And a second " + "one of it. " * 12 + "</p><div class=footer>(c)</div></body>"
    assert html.main_text(plain).startswith("A long paragraph") and html.main_text(plain).endswith("one of it.") and "Home" not in html.main_text(plain) and "(c)" not in html.main_text(plain)
    assert html.main_text("<p>open <p>next</div> rest") == "open\nnext\nrest"


def test_leaks_in_other_capitals_and_of_numbers(spark):
    items = spark.createDataFrame([(1, "Alice has 3 red apples and gives 2 apples to Bob before she walks home to eat them"), (2, "3 + 4 = 7 and 8 + 9 = 17 and 12 + 5 = 17"), (3, "NEW YORK CITY POLICE MET LONDON TOWN MAYOR JOHN SMITH TODAY")], "item_id long, text string")
    filler = " ".join(f"f{k}" for k in range(80))
    texts = ["Maria has 5 red apples and gives 4 apples to Tom before she walks home to eat them", "alice has 3 red apples and gives 2 apples to bob before she walks home to eat them", "ALICE HAS 9 RED APPLES AND GIVES 1 APPLES TO BOB BEFORE SHE WALKS HOME TO EAT THEM",
             "3 + 4 = 7 and 8 + 9 = 17 and 12 + 5 = 17", "1 + 4 = 5 and 2 + 9 = 11 and 13 + 5 = 18", "new york city police met london town mayor john smith today", "red apples and gives home to eat"]
    docs = spark.createDataFrame([(k, f"{filler} {t} {filler}", "x") for k, t in enumerate(texts)] + [(None, texts[0], "y"), (90, None, "y"), (91, "", "y"), (0, f"{filler} {texts[0]} {filler}", "x")], "doc_id long, text string, reading string")
    got = {(r["doc_id"], r["item_id"]) for r in find_leaks(docs, items).collect()}
    assert got == {(0, 1), (1, 1), (2, 1), (3, 2), (5, 3)}
    left = drop_leaks(docs, items)
    # the row without doc_id leaks item 1 too, and goes
    assert left.columns == docs.columns and sorted((r["doc_id"], r["text"] or "") for r in left.collect()) == sorted([(4, f"{filler} {texts[4]} {filler}"), (6, f"{filler} {texts[6]} {filler}"), (90, ""), (91, "")])


def test_reparameterised_copies_in_other_capitals(spark):
    question = "{} has {} red apples and gives {} of them to {} near the old town hall before {} walks home with {} apples"
    trade = "A car costs {} {} and {} buys it with {} {} from {} at the market in {}"
    items = spark.createDataFrame([(1, question.format("Alice", 3, 2, "Bob", "Bob", 1)), (2, trade.format(500, "dollars", "Henry", 450, "dollars", "Anna", "Boston"))], "item_id long, text string")
    other = question.format("Maria", 5, 4, "Tom", "Tom", 9), trade.format(700, "euros", "Peter", 600, "euros", "Clara", "Turin")
    # Bob stands for two values in most windows' diagonal; a text that shares too little
    clean = question.format("Maria", 5, 4, "Tom", "Eve", 9).replace("red apples", "green pears").replace("old town", "new city").replace("walks home", "runs off"), "He has 5 red cars and gives 4 of them to me near the sea"
    docs = [f(t) for t in other for f in (str, str.lower, str.upper, str.title)] + list(clean)
    df = spark.createDataFrame([(k, t) for k, t in enumerate(docs)], "doc_id long, text string")
    got = {(r["doc_id"], r["item_id"]): r for r in find_leaks(df, items).collect()}
    assert set(got) == {(k, 1 + k // 4) for k in range(8)}
    assert all(r["changed"] > 0 for r in got.values())


def windows_by_hand(items, docs, size=6, literals=4, coverage=0.5, conflicts=0.2):
    """Leaks by comparing every window with every window, for texts of lower-case words w*, names N* and numbers."""
    kind = lambda t, named: "#" if t[0].isdigit() else "@" if named and t[0] == "N" else t.lower()
    found = set()
    for item, text in items.items():
        a = text.split()
        for doc, other in docs.items():
            b, best = other.split(), 0.0
            for named in (True, False):
                inner = [named and k > 0 for k in range(len(a))]
                shape = [kind(t, n) for t, n in zip(a, inner, strict=True)]
                starts = [i for i in range(len(a) - size + 1) if sum(s not in "#@" for s in shape[i : i + size]) >= literals]
                places, meanings = {}, {}
                for i in starts:
                    for j in range(len(b) - size + 1):
                        if all(s == "@" or s == kind(t, False) for s, t in zip(shape[i : i + size], b[j : j + size], strict=True)) and sum(not t[0].isdigit() for t in b[j : j + size]) >= literals:
                            places.setdefault(j - i, set()).add(i)
                            for k in range(size):
                                if shape[i + k] in "#@":
                                    meanings.setdefault(j - i, {}).setdefault(a[i + k].lower(), set()).add(b[j + k].lower())
                sound = set()
                for d, at in places.items():
                    told = meanings.get(d, {})
                    if sum(len(v) > 1 for v in told.values()) <= conflicts * len(told):
                        sound |= at
                best = max(best, len(sound) / len(starts) if starts else 0)
            if best >= coverage:
                found.add((doc, item))
    return found


def test_leaks_against_all_windows(spark):
    rng = random.Random(21)
    names = [f"N{c}x" for c in "abcdefghij"]
    word = lambda: rng.choice(names) if (x := rng.random()) < 0.12 else str(rng.randrange(90)) if x < 0.22 else f"w{rng.randrange(40)}"
    items = {k: " ".join(["w0", *[word() for _ in range(rng.randint(9, 24))]]) for k in range(12)}
    docs = {}
    for k in range(60):
        new, tokens = {}, []
        for t in items[rng.randrange(12)].split():
            swap = t[0] != "w" and rng.random() < 0.9
            tokens.append(new.setdefault(t, word() if rng.random() < 0.05 else rng.choice(names) if t[0] == "N" else str(rng.randrange(90))) if swap else t)
            if rng.random() < 0.06:
                tokens.append(word())
        text = " ".join([word() for _ in range(15)] + tokens + [word() for _ in range(15)])
        docs[k] = rng.choice([str, str.lower, str.upper])(text)
    wanted = windows_by_hand(items, docs)
    got = find_leaks(spark.createDataFrame(list(docs.items()), "doc_id long, text string"), spark.createDataFrame(list(items.items()), "item_id long, text string"))
    assert {(r["doc_id"], r["item_id"]) for r in got.collect()} == wanted and 10 < len(wanted) < 60


def test_quality_goes_by_rows(spark):
    rng = random.Random(4)
    good = [" ".join(f"w{rng.randrange(300)}" for _ in range(60)) + "." for _ in range(300)]
    junk = ["## %% " * 40 + str(k) for k in range(100)]
    rows = [(k, t) for k, t in enumerate(good + junk)]
    told = spark.createDataFrame([(k, int(k < 300), 0) for k in range(400)], "doc_id long, quality int, toxic int")
    more = [(5, junk[0]), (None, good[7]), (None, junk[1]), (None, junk[1]), (399, good[8])]
    left = drop_low_quality(spark.createDataFrame(rows + more, "doc_id long, text string").withColumn("low", F.lit(1)).withColumn("place", F.lit(2)), told)
    assert left.columns == ["doc_id", "text", "low", "place"]
    assert sorted((r["text"], r["doc_id"] or -1) for r in left.collect()) == sorted([(t, k or -1) for k, t in enumerate(good)] + [(good[7], -1), (good[8], 399)])


def test_spans_of_a_text_of_many_matches(spark):
    text = "ab@c.de " * 20_000
    began = time.time()
    row = pii.find_personal(spark.createDataFrame([(1, text)], "doc_id long, text string")).first()
    assert row["n_email"] == 20_000 and (row["base"][-1]["start"], row["base"][-1]["end"]) == (8 * 19_999, 8 * 19_999 + 7)
    assert time.time() - began < 60
    df = spark.createDataFrame([(1, "to ab@c.de now", 5), (2, None, 6)], "doc_id long, text string, spans int")
    assert sorted(map(tuple, pii.redact(df, pii.find_personal(df)).collect())) == [(1, "to [email] now", 5), (2, None, 6)]


def test_redaction_keeps_to_rows(spark):
    df = spark.createDataFrame([(1, "mail a@b.co"), (1, "no mail here at all"), (None, "to c@d.ef"), (None, "and x@y.zz, c@d.ef"), (1, "mail a@b.co"), (2, None)], "doc_id long, text string")
    got = sorted(repr(tuple(r)) for r in pii.redact(df, pii.find_personal(df)).collect())
    assert got == sorted(map(repr, [(1, "mail [email]"), (1, "no mail here at all"), (None, "to [email]"), (None, "and [email], [email]"), (1, "mail [email]"), (2, None)]))


def test_tables_without_rows_and_a_hot_url(spark):
    labels = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    pages = spark.createDataFrame([(k, "https://hot.net/a/b.html") for k in range(50)] + [(50, None), (51, "no url"), (50, None)], "page_id long, url string")
    assert urlrules.judge_urls(pages.where("page_id < 0"), labels).count() == 0
    told = spark.createDataFrame([(k, 0, 0) for k in range(20)], "doc_id long, quality int, toxic int")
    more = pages.unionByName(spark.createDataFrame([(100 + k, f"https://bad{k % 2}.net/x/{k}") for k in range(20)], "page_id long, url string"))
    got = urlrules.judge_urls(more, told).groupBy("verdict").count().collect()
    assert {r["verdict"]: r["count"] for r in got} == {"allow": 53, "block": 20}
    docs = spark.createDataFrame([], "doc_id long, text string")
    assert score_toxicity(docs, labels).count() == 0


def test_stages_on_nulls_ties_and_no_rows(spark, sf):
    rng = random.Random(2)
    text = " ".join(f"w{rng.randrange(900)}" for _ in range(60))
    rows = [(1, text, "en", "a", 1), (1, text, "en", "a", 1), (None, text, None, None, None), (3, None, "en", "a", 0), (4, "", "en", "a", 0), (5, text + "\n" + text, "en", "b", 2)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    for _, stage in corpus_pipeline.STAGES[:4]:
        out = stage(spark, docs, sf)
        assert out.columns == docs.columns and out.where("doc_id is null").count() == 1
        assert stage(spark, docs.where(F.lit(False)), sf).count() == 0
    packed = corpus_pipeline.packing(spark, docs, sf)
    assert packed.count() == len(rows) and corpus_pipeline.packing(spark, docs.where(F.lit(False)), sf).count() == 0


def test_quality_shuffles_no_texts(spark):
    docs = spark.createDataFrame([(k, f"some words about thing {k} and its uses. " * (1 + k % 3) if k % 4 else "## %% " * 40) for k in range(200)], "doc_id long, text string")
    left = drop_low_quality(docs, spark.createDataFrame([(k, int(k % 4 > 0), 0) for k in range(200)], "doc_id long, quality int, toxic int"))
    plan = left._jdf.queryExecution().optimizedPlan().toString()
    assert "Join" not in plan and plan.count("ArrowEvalPython") == 1
    assert 0 < left.count() < 200
