"""HTML extraction, toxicity, personal data, URL rules and quality."""

import random
import re
import zlib

import pytest
from pyspark.sql import functions as F

from veriscope.llm import html, pii, quality, toxicity, urlrules

ODD = [None, "", " \n\t ", "1", "x " * 5000, "é ñ ü ß 😀"]


def test_main_text():
    page = """<!DOCTYPE html><html><head><title>T</title><style>p{x:1}</style><script>var a="</p>";</script></head><body><nav><a href=/>Home</a></nav><!-- ad --><div class="ad">Buy a thing now, it is cheap and good.</div>
    <article><h1>The &amp; title</h1><p><b>First   paragraph<br>goes on.</b><p>Second &lt;one&gt;.</p><aside>Side note of no use</aside><form><input><button>Send it</button></form><ul><li>Item</ul><section class="comments"><p>Nice post, I liked it very much!</p></section></article>
    <footer>&copy; someone</footer>"""
    assert html.main_text(page) == "The & title\nFirst paragraph goes on.\nSecond <one>.\nItem"
    divs = "<div id=menu><a>One</a> <a>Two</a></div><div><h2>Heading words</h2><p>A paragraph that is long enough to surge over the others by far.<p>And more.</div><div class='cookie-notice'>We use cookies on this site, do you agree?</div>"
    assert html.main_text(divs) == "Heading words\nA paragraph that is long enough to surge over the others by far.\nAnd more."
    assert [html.main_text(x) for x in (None, "", "<p>", "<nav>only</nav>", "plain text")] == ["", "", "", "", "plain text"]


def test_extract_main_text_of_tables(spark, sf):
    pages = spark.createDataFrame([(1, "u", "<article><p>é 😀</p></article>", 5), (2, None, None, 6), (2, None, None, 6)], "page_id long, url string, html string, n_chars int")
    got = sorted((r["page_id"], r["text"], r["n_chars"]) for r in html.extract_main_text(pages).collect())
    assert got == [(1, "é 😀", 3), (2, "", 0), (2, "", 0)]
    assert html.extract_main_text(pages.where("page_id < 0")).count() == 0


def articles(page: str) -> str:
    """A page of the test tables by plain string surgery."""
    import html as entities

    inner = page.split("<article>")[1].split("</article>")[0]
    blocks = (re.sub(r"\s+", " ", entities.unescape(re.sub(r"</?b>", "", b).replace("<br>", " "))).strip() for b in re.split(r"</?(?:p|h1)>", inner))
    return "\n".join(b for b in blocks if b)


def test_extraction_of_the_test_pages(spark, sf):
    for r in html.extract_main_text(spark.read.parquet(f"{sf}/pages.parquet")).collect():
        assert r["text"] == articles(r["html"])


PATTERNS = {"email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]"}


def valid(kind, text):
    digits = re.sub(r"\D", "", text)
    if kind == "ip":
        return all(int(x) <= 255 for x in text.split("."))
    if kind == "phone":
        return 9 <= len(digits) <= 15
    if kind == "card":
        total = sum(sum(divmod(2 * int(c), 10)) if k % 2 else int(c) for k, c in enumerate(reversed(digits)))
        return 13 <= len(digits) <= 19 and total % 10 == 0
    return True


def brute(text):
    return [(k, m.start(), m.end()) for k, p in PATTERNS.items() for m in re.finditer(p, text or "") if valid(k, m.group())]


def private_texts():
    rng = random.Random(3)
    parts = ["a@b.c", "a@b.c@d.ef", "x_y@q.r.", "1.2.3.4.5", "256.1.1.1", "010.0.0.255", "4111 1111 1111 1111", "4111-1111-1111-1112", "+1 (980) 555-6268", "+44-20 7946.0958-", "+12", "é", "😀", "12", "@", "+", ".", "-", "\n", "4539 578763621486", "9" * 25]
    out = ["".join(rng.choice(parts) + rng.choice(["", " ", ", "]) for _ in range(rng.randint(1, 30))) for _ in range(300)]
    return out + ODD + ["z" * 50_000 + "@", "1" * 50_000, "1.2.3." * 5000, "+1" * 10_000, "4111 1111 1111 1111 " * 200]


def test_personal_data_base_spans(spark):
    texts = private_texts()
    df = spark.createDataFrame([(k, t, "x") for k, t in enumerate(texts)], "doc_id long, text string, spans string")
    got = {r["doc_id"]: r for r in pii.find_personal(df).collect()}
    for k, t in enumerate(texts):
        assert [(s["kind"], s["start"], s["end"]) for s in got[k]["base"]] == brute(t), t and t[:80]
        assert got[k]["n_card"] == sum(x[0] == "card" for x in brute(t))
        assert [tuple(s) for s in got[k]["spans"]][: len(got[k]["base"])] == [tuple(s) for s in got[k]["base"]]
    assert pii.find_personal(df.where("doc_id < 0")).count() == 0


def test_personal_data_method_adds_keys_and_redacts(spark):
    rng = random.Random(5)
    hexes = lambda n: "".join(rng.choice("0123456789abcdef") for _ in range(n))
    rows = [(k, f'é start token = "{hexes(40)}" and mail a@b.co or AKIA{"".join(rng.choice("ABCDEFGHIJKLMNOPQRSTUVWXYZ234567") for _ in range(16))} end') for k in range(40)] + [(k, f"plain words section{k}paragraphs only {k}") for k in range(100, 140)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    found = pii.find_personal(df).cache()
    counts = {r["doc_id"]: r["n_secret"] for r in found.collect()}
    assert all(counts[k] == 2 for k in range(40))
    assert sum(counts[k] for k in range(100, 140)) == 0
    text = pii.redact(df, found).where("doc_id = 3").first()["text"]
    assert text == 'é start token = "[secret]" and mail [email] or [secret] end'


def test_em_finds_the_bad_labeler():
    rng = random.Random(1)
    counts = {}
    for _ in range(3000):
        true = rng.random() < 0.4
        v = {"good": int(rng.random() < (0.9 if true else 0.05)), "fair": int(rng.random() < (0.8 if true else 0.1)), "coin": int(rng.random() < 0.5)}
        key = tuple(sorted(v.items()))
        counts[key] = counts.get(key, 0) + 1
    model = pii.fit([(dict(k), {}, n) for k, n in counts.items()])
    assert model.reliability["good"][0] > 0.8 > 0.2 > model.reliability["good"][1]
    assert abs(model.reliability["coin"][0] - model.reliability["coin"][1]) < 0.1


RULES = [("org/", "allow"), ("example.org/es/", "block"), ("example.org/en/1", "block"), ("com/fr/", "allow"), ("com/de/", "block")]


def plain_rule(url):
    if url is None or "://" not in url:
        return "", "", None
    rest = url.split("://", 1)[1]
    host = re.match(r"[^/?#]*", rest).group()
    path = re.match(r"[^?#]*", rest[len(host) :]).group()
    host = "".join(c.lower() if "A" <= c <= "Z" else c for c in host)
    fits = [r for r, _ in RULES if (host == r.split("/")[0] or host.endswith("." + r.split("/")[0])) and path.startswith("/" + r.split("/", 1)[1])]
    return host, path, max(fits, key=len, default=None)


def test_url_rules(spark):
    hosts = ["example.org", "Blog.EXAMPLE.org", "x.com", "com", "notexample.org", "org", "Ünï.com", "a.b.net:80", ""]
    urls = [f"{s}{h}{p}" for s in ("http://", "HTTPS://") for h in hosts for p in ("", "/", "/es/1", "/en/1", "/en/12?q=1#f", "/fr/", "/de/x.html", "?u=/de/", "#/fr/")] + [None, "", "x", "a/b://c.com/de/", "mailto:a@b.com", "http://a\n.com/de/"]
    pages = spark.createDataFrame([(k, u, "v") for k, u in enumerate(urls)], "page_id long, url string, verdict string")
    labels = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    got = {r["page_id"]: r for r in urlrules.judge_urls(pages, labels).collect()}
    for k, u in enumerate(urls):
        host, path, rule = plain_rule(u)
        assert (got[k]["host"], got[k]["path"], got[k]["rule"]) == (host, path, rule), u
        assert got[k]["verdict"] == (dict(RULES)[rule] if rule else "allow")


def test_url_rules_mined(spark):
    rows, labels = [], []
    for k in range(400):
        bad = k % 4 == 0
        rows.append((k, f"http://{'cheap-pills' if bad else 'good'}{k % 3}.example.net/{'buy' if bad else 'read'}/{k}.html?{'aff=1' if bad else 'page=2'}"))
        if k % 2 == 0:
            labels.append((k, 0 if bad else 1, 0))
    pages, told = spark.createDataFrame(rows, "page_id long, url string"), spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    for r in urlrules.judge_urls(pages, told).collect():
        assert r["verdict"] == ("block" if r["page_id"] % 4 == 0 else "allow")
    labelled = pages.join(told, pages["page_id"] == told["doc_id"]).select(urlrules.url_tokens(F.col("url"), urlrules.host_of(F.col("url")), urlrules.path_of(F.col("url"))).alias("tokens"), (F.col("quality") == 0).alias("bad"))
    mined = urlrules.mine_rules(labelled, urlrules.token_classes(labelled, 4))
    assert mined.where("confidence < 0.6").count() == 0 and mined.where("size(classes) > 1").count() == 0


def held(doc_id, modulus, rest):
    return zlib.crc32(str(doc_id).encode()) % modulus == rest


def prose(rng, n):
    return " ".join("".join(rng.choice(["ka", "lo", "mi", "ne", "ru", "so", "ta"]) for _ in range(rng.randint(1, 4))) for _ in range(n))


def test_toxicity_held_out(spark):
    rng = random.Random(4)
    stems = ["vexor", "gromp", "zilk", "quade"]
    rows, labels = [], []
    for k in range(800):
        words = prose(rng, rng.randint(5, 300)).split()
        toxic = k % 5 == 0
        if toxic:
            for _ in range(rng.randint(1, 3)):
                words.insert(rng.randrange(len(words)), rng.choice(stems) + rng.choice(["", "ed", "ing", "isch"]))
        rows.append((k, " ".join(words)))
        labels.append((k, int(toxic)))
    rows += [(1000, "ka lo VEX0R mi"), (1001, "ka lo vехоr mi"), (1002, "ka v-exor lo"), *[(2000 + k, t) for k, t in enumerate(ODD)], (None, "vexor")]
    docs, told = spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(labels, "doc_id long, toxic int")
    got = [r for r in toxicity.held_out_toxicity(docs, told).collect()]
    assert len(got) == len(rows)
    by = {r["doc_id"]: r for r in got}
    assert all(by[k]["held_out"] == held(k, 4, 2) and 0 <= by[k]["score"] <= 1 and by[k]["predicted"] == int(by[k]["score"] >= 0.3) for k in by if k is not None)
    test = [k for k in range(800) if held(k, 4, 2)]
    assert sum(by[k]["predicted"] == int(k % 5 == 0) for k in test) >= 0.97 * len(test)
    assert by[1000]["predicted"] == by[1001]["predicted"] == by[None]["predicted"] == 1
    assert by[1002]["predicted"] == by[2000]["predicted"] == by[2001]["predicted"] == 0


def test_toxicity_exceptions():
    lexicon = toxicity.Lexicon({" trash": 3.0})
    assert lexicon.strength("put it in the trash can now") == 0
    assert lexicon.strength("you trash, can you") == 0 or lexicon.strength("you are trash") > 0
    assert lexicon.strength("you are TR4SH") == lexicon.strength("you are trash") > lexicon.strength("you are trash " + "and so on " * 500) > 0


def test_toxicity_without_labels(spark):
    docs = spark.createDataFrame([(1, "a"), (2, None)], "doc_id long, text string")
    none = spark.createDataFrame([], "doc_id long, toxic int")
    assert {r["predicted"] for r in toxicity.held_out_toxicity(docs, none).collect()} == {0}
    assert toxicity.held_out_toxicity(docs.where("doc_id < 0"), none).count() == 0


def test_quality_held_out(spark):
    rng = random.Random(6)
    rows, labels = [], []
    for k in range(900):
        text, kind = prose(rng, rng.randint(20, 200)), k % 9
        if kind == 0:
            text = " ".join(f"{w}{rng.choice(['###', '&&&', '%%%'])}" for w in text.split())
        elif kind == 1:
            text = " ".join([prose(rng, 1)] * 80)
        rows.append((k, text.capitalize() + "."))
        labels.append((k, int(kind > 1)))
    rows += [(2000 + k, t) for k, t in enumerate(ODD)] + [(None, "some text")]
    docs, told = spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(labels, "doc_id long, quality int")
    by = {r["doc_id"]: r for r in quality.held_out_scores(docs, told).collect()}
    assert len(by) == len(rows)
    test = [k for k in range(900) if held(k, 3, 1)]
    assert all(by[k]["held_out"] for k in test) and all(0 <= r["score"] <= 1 for r in by.values())
    assert sum(by[k]["predicted"] == int(k % 9 > 1) for k in test) >= 0.95 * len(test)
    blind = told.withColumn("quality", F.when(quality.held_out(3, 1), 1 - F.col("quality")).otherwise(F.col("quality")))
    again = {r["doc_id"]: r["score"] for r in quality.held_out_scores(docs, blind).collect()}
    assert all(again[k] == pytest.approx(by[k]["score"], abs=1e-9) for k in again)
    assert quality.drop_low_quality(docs, told).count() < len(rows)
    assert {r["score"] for r in quality.held_out_scores(docs, told.where("doc_id < 0")).collect()} == {0.5}
    assert quality.held_out_scores(docs.where("doc_id < -5"), told).count() == 0
