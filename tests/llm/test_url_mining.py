"""The mined half of the URL rules against a search through all token sets, and what grows with repeated rows."""

import random
import time
from itertools import combinations

from pyspark.sql import functions as F

from veriscope.llm import urlrules


def plain_rules(rows, least=4, confidence=0.6):
    """Every token set with its rows: those that are rules and beat each rule that lacks one of their tokens."""
    frequent = {t for tokens, _ in rows for t in tokens if sum(t in x for x, bad in rows if bad) >= least}
    sets = {c for tokens, bad in rows if bad for n in range(1, len(tokens & frequent) + 1) for c in combinations(sorted(tokens & frequent), n)}
    found = {}
    for c in sets:
        seen = [bad for tokens, bad in rows if tokens.issuperset(c)]
        if sum(seen) >= least and sum(seen) / len(seen) >= confidence:
            found[c] = sum(seen) / len(seen)
    return [set(c) for c, x in found.items() if all(found.get(c[:k] + c[k + 1 :], -1) < x for k in range(len(c)))]


def test_verdicts_against_all_token_sets(spark):
    rng = random.Random(8)
    urls = []
    for k in range(260):
        host = rng.choice(["shop.cheap-pills.net", "news.net", "a.b.press.net", "x-y.net"])
        part = rng.choice(["buy", "read", "top/list", ""])
        keys = "&".join(f"{x}=1" for x in ["aff", "utm", "ref"] if rng.random() < 0.4)
        both = "&left=1&right=2" if rng.random() < 0.3 else ""  # two keys that always stand together
        urls.append(f"http://{host}/{part}/{k}{rng.choice(['', '.html', '.php'])}?{keys}{both}")
    pages = spark.createDataFrame([(k, u) for k, u in enumerate(urls)] + [(900, "http://new.net/?right=2"), (901, "http://new.net/?left=1&aff=3")], "page_id long, url string")
    labels = spark.createDataFrame([(k, 0 if ("cheap" in u and rng.random() < 0.7) or ("left" in u and "aff" in u) or rng.random() < 0.1 else 1, 0) for k, u in enumerate(urls) if k % 3], "doc_id long, quality int, toxic int")
    host, path = urlrules.host_of(F.col("url")), urlrules.path_of(F.col("url"))
    tokens = {r["page_id"]: set(r["t"]) for r in pages.select("page_id", urlrules.url_tokens(F.col("url"), host, path).alias("t")).collect()}
    bad = {r["doc_id"]: r["quality"] == 0 for r in labels.collect()}
    rules = plain_rules([(tokens[k], b) for k, b in bad.items()])
    assert any(len(r) > 1 for r in rules)
    got = {r["page_id"]: r["verdict"] for r in urlrules.judge_urls(pages, labels, rules=()).collect()}
    assert got == {k: "block" if any(r <= t for r in rules) else "allow" for k, t in tokens.items()} and len(set(got.values())) == 2


def test_many_equal_urls_of_many_keys(spark):
    url = "http://hot.net/a/%d?" + "&".join(f"key{k}=1" for k in range(200))
    pages = spark.createDataFrame([(k, url % k) for k in range(1000)] + [(k, f"http://other.net/b/{k}") for k in range(1000, 1400)], "page_id long, url string")
    labels = spark.createDataFrame([(k, int(k >= 1000), 0) for k in range(1400)], "doc_id long, quality int, toxic int")
    began = time.time()
    got = urlrules.judge_urls(pages, labels).groupBy((F.col("page_id") < 1000).alias("hot"), "verdict", "mined_rules").count().collect()
    assert {tuple(r) for r in got} == {(True, "block", 1, 1000), (False, "allow", 0, 400)}
    assert time.time() - began < 40  # a set of 2**200 tokens otherwise


def test_without_labels_nothing_is_mined(spark, sf):
    pages = spark.read.parquet(f"{sf}/pages.parquet")
    none = urlrules.judge_urls(pages, spark.read.parquet(f"{sf}/labels.parquet").where(F.lit(False)), rules=())
    assert none.where("verdict = 'block'").count() == 0
