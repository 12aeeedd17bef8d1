"""URL filtering with fixed rules and association rules mined by FP-growth."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.ml.fpm import FPGrowth
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .store import keep

_BAD = "label:block"
_SALTS = 16
_CAPITALS = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"

# Fixed values of the query's contract.
RULES = (("org/", "allow"), ("example.org/es/", "block"), ("example.org/en/1", "block"), ("com/fr/", "allow"), ("com/de/", "block"))


def host_of(url: Column) -> Column:
    """What stands after the first ``://`` up to ``/``, ``?``, ``#`` or the end, A-Z lower-cased; empty without ``://``."""
    return F.translate(F.coalesce(F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1), F.lit("")), _CAPITALS, _CAPITALS.lower())


def path_of(url: Column) -> Column:
    """What follows the host up to ``?``, ``#`` or the end."""
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def fitting_rule(host: Column, path: Column, rules: Sequence[tuple[str, str]]) -> Column:
    """struct(rule, verdict) of the longest rule that fits; null if none does."""
    out = F.lit(None).cast("struct<rule:string,verdict:string>")
    for rule, verdict in sorted(rules, key=lambda r: len(r[0])):
        name, slash, rest = rule.partition("/")
        fits = ((host == name) | F.endswith(host, F.lit(f".{name}"))) & F.startswith(path, F.lit(slash + rest))
        out = F.when(fits, F.struct(F.lit(rule).alias("rule"), F.lit(verdict).alias("verdict"))).otherwise(out)
    return out


def url_tokens(url: Column, host: Column, path: Column) -> Column:
    """Distinct tokens of a URL: host, its domain, first label and hyphenated words, path parts without digits, extension, query keys, fragment."""
    labels = F.split(host, r"\.")
    n = F.size(labels)
    query = F.regexp_extract(url, r"\?([^#]*)", 1)
    fragment = F.regexp_extract(url, r"#(.*)$", 1)
    extension = F.regexp_extract(path, r"\.([A-Za-z0-9]{1,5})$", 1)
    parts = F.filter(F.split(path, "/"), lambda x: (x != "") & ~x.rlike("[0-9]"))
    words = F.when(F.contains(host, F.lit("-")), F.filter(F.split(host, r"[.-]"), lambda x: x != "")).otherwise(F.array().cast("array<string>"))
    keys = F.filter(F.transform(F.split(query, "&"), lambda x: F.split(x, "=")[0]), lambda x: x != "")
    single = F.array(
        F.when(host != "", F.concat(F.lit("host:"), host)),
        F.when(n > 2, F.concat(F.lit("domain:"), F.array_join(F.slice(labels, -2, 2), "."))),
        F.when(n > 3, F.concat(F.lit("first:"), labels[0])),
        F.when(extension != "", F.concat(F.lit("extension:"), F.lower(extension))),
        F.when(fragment != "", F.concat(F.lit("fragment:"), fragment)),
    )
    named = lambda kind, values: F.transform(values, lambda x: F.concat(F.lit(f"{kind}:"), x))
    return F.array_sort(F.array_distinct(F.array_compact(F.concat(single, named("part", parts), named("word", words), named("key", keys)))))


def token_classes(labelled: DataFrame, least: int) -> DataFrame:
    """(token, class): tokens of at least ``least`` bad rows of ``labelled`` (tokens, bad); those that stand in the same rows share a class.

    Which rows hold a token is told by their number and two sums of hashes, so no list of rows is gathered.
    """
    sets = labelled.groupBy("tokens").agg(F.count_if("bad").alias("bad"))
    one, two = F.xxhash64(F.lit(1), "tokens").cast("decimal(20,0)"), F.xxhash64(F.lit(2), "tokens")
    held = sets.select(F.explode("tokens").alias("token"), "bad", one.alias("one"), two.alias("two"))
    told = held.groupBy("token").agg(F.sum("bad").alias("bad"), F.count("*").alias("n"), F.sum("one").alias("one"), F.bit_xor("two").alias("two")).where(F.col("bad") >= least)
    same = told.groupBy("n", "one", "two").agg(F.min("token").alias("class"))
    return told.join(same, ["n", "one", "two"]).select("token", "class")


def mine_rules(labelled: DataFrame, classes: DataFrame, least: int = 4, confidence: float = 0.6) -> DataFrame:
    """(rule_id, classes, support, confidence) from ``labelled`` (tokens, bad): sets of token classes after which ``bad`` is likely.

    FP-growth finds the sets of at least ``least`` rows, at every size of the table; a rule needs ``least`` bad rows,
    ``confidence``, and more confidence than each rule that lacks one of its classes. Tokens that always stand together
    (a url's many query keys, a host and its words) enter as one class, as any choice of them has the same rows: their
    number does not multiply the sets. Classes that overlap in irregular ways still do.
    """
    sets = labelled.groupBy("tokens").agg(F.count("*").alias("n"), F.count_if("bad").alias("bad")).withColumn("set_id", F.struct(F.xxhash64(F.lit(1), "tokens"), F.xxhash64(F.lit(2), "tokens")))
    spread = sets.select("set_id", "n", "bad", F.explode("tokens").alias("token")).join(classes, "token")
    rows = spread.groupBy("set_id", "n", "bad").agg(F.array_sort(F.collect_set("class")).alias("items"))
    copies = rows.select(F.explode(F.sequence(F.lit(1).cast("bigint"), "n")).alias("k"), "bad", "items").select(F.when(F.col("k") <= F.col("bad"), F.array_append("items", F.lit(_BAD))).otherwise(F.col("items")).alias("items"))
    copies = keep(copies)
    kept = copies.count()
    if not kept:
        return copies.sparkSession.createDataFrame([], "rule_id long, classes array<string>, support long, confidence double")
    model = FPGrowth(itemsCol="items", minSupport=min(1.0, (least - 0.5) / kept), numPartitions=int(labelled.sparkSession.conf.get("spark.sql.shuffle.partitions"))).fit(copies)
    found = keep(model.freqItemsets.select(F.array_sort("items").alias("items"), "freq"))
    plain = found.where(~F.array_contains("items", _BAD)).select(F.col("items").alias("classes"), F.col("freq").alias("seen"))
    bad = found.where(F.array_contains("items", _BAD) & (F.size("items") > 1)).select(F.array_remove("items", _BAD).alias("classes"), F.col("freq").alias("support"))
    rules = bad.join(plain, "classes").withColumn("confidence", F.col("support") / F.col("seen")).where((F.col("support") >= least) & (F.col("confidence") >= confidence))
    rules = keep(rules.select("classes", "support", "confidence"))
    shorter = rules.select("classes", "confidence", F.explode("classes").alias("out")).select("classes", "confidence", F.array_remove(F.col("classes"), F.col("out")).alias("less"))
    beaten = shorter.join(rules.select(F.col("classes").alias("less"), F.col("confidence").alias("base")), "less").where("base >= confidence").select("classes").distinct()
    return rules.join(beaten, "classes", "left_anti").select(F.xxhash64("classes").alias("rule_id"), "classes", "support", "confidence")


def judge_urls(pages: DataFrame, labels: DataFrame, rules: Sequence[tuple[str, str]] = RULES, **mining) -> DataFrame:
    """(page_id, host, path, rule, verdict, mined_rules) of every row of ``pages`` (page_id, url, ...).

    The longest fixed rule that fits decides; elsewhere a URL is blocked if an association rule
    matches. Those are mined from the pages whose last number in the path is the doc_id of a
    row of ``labels``; a page counts as bad if that document is toxic or of quality 0. Matching goes
    through an inverted index: tokens of the distinct token sets join the tokens of the rules' classes, and a rule
    matches a set in which a token of each of its classes was met. mined_rules counts the matches.

    Defined cases: a null url, or one without ``://``, has an empty host and path and no tokens and
    is allowed; without labels nothing is mined; repeated rows are each judged; other columns are
    ignored; an empty table gives an empty table.
    """
    host, path = host_of(F.col("url")), path_of(F.col("url"))
    rows = pages.select("page_id", F.col("url").cast("string").alias("url")).withColumns({"host": host, "path": path})
    rows = rows.withColumn("tokens", F.when(F.col("host") == "", F.array().cast("array<string>")).otherwise(url_tokens(F.coalesce("url", F.lit("")), F.col("host"), F.col("path"))))
    rows = rows.withColumn("set_id", F.xxhash64("tokens"))
    number = F.try_to_number(F.regexp_extract("path", r"/([0-9]{1,18})(?:[^0-9/][^/]*)?/?$", 1), F.lit("9" * 18)).cast("long")
    told = labels.select(F.col("doc_id").cast("long").alias("doc_id"), ((F.coalesce("toxic", F.lit(0)) == 1) | (F.coalesce("quality", F.lit(1)) == 0)).alias("bad")).where("doc_id is not null")
    told = told.groupBy("doc_id").agg(F.bool_or("bad").alias("bad"))
    labelled = keep(rows.where(F.size("tokens") > 0).select(number.alias("doc_id"), "tokens").join(told, "doc_id").select("tokens", "bad"))
    judged = rows.withColumn("fixed", fitting_rule(F.col("host"), F.col("path"), rules))
    if labelled.isEmpty():
        found = judged.withColumn("mined_rules", F.lit(0).cast("long"))
    else:
        classes = keep(token_classes(labelled, mining.get("least", 4)))
        mined = mine_rules(labelled, classes, **mining)
        each = F.explode(F.sequence(F.lit(0), F.lit(_SALTS - 1)))
        index = mined.select("rule_id", F.size("classes").alias("need"), F.explode("classes").alias("class")).join(classes, "class").withColumn("part", each)
        sets = rows.where(F.size("tokens") > 0).select("set_id", "tokens").distinct().select("set_id", F.explode("tokens").alias("token"), F.pmod("set_id", F.lit(_SALTS)).cast("int").alias("part"))
        # a token of a rule that millions of sets hold is dealt over _SALTS tasks; one token of each class is enough
        met = sets.join(index, ["token", "part"]).select("set_id", "rule_id", "need", "class").distinct().groupBy("set_id", "rule_id", "need").agg(F.count("*").alias("n")).where("n = need")
        # a set that many pages share is dealt over _SALTS tasks; pages without tokens need no join
        hit = met.groupBy("set_id").agg(F.count("*").alias("mined_rules")).withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(_SALTS - 1))))
        some = judged.where(F.size("tokens") > 0).withColumn("salt", F.pmod(F.xxhash64("page_id", "url"), F.lit(_SALTS)).cast("int"))
        found = some.join(hit, ["set_id", "salt"], "left").withColumn("mined_rules", F.coalesce("mined_rules", F.lit(0))).drop("salt")
        found = found.unionByName(judged.where(F.size("tokens") == 0).withColumn("mined_rules", F.lit(0).cast("long")))
    verdict = F.coalesce("fixed.verdict", F.when(F.col("mined_rules") > 0, F.lit("block")).otherwise(F.lit("allow")))
    return found.select("page_id", "host", "path", F.col("fixed.rule").alias("rule"), verdict.alias("verdict"), "mined_rules")
