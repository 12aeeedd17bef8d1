"""Claim families: collapse, merge, near-duplicates, shortlist."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.text import claim_tokens, jaccard, normalize_claim
from .graph import similar_grams
from .rounds import attached, cut, roots

# Words that change a claim's meaning.
OPERATORS = ("required", "necessary", "sufficient", "increase", "increases", "decrease", "decreases", "promotes", "promote", "inhibits", "inhibit", "prevents", "prevent", "causes", "cause")
STATUS_RANK = {"grounded": 0, "ambiguous": 1, "not_attempted": 2, "not_found": 3, "no_seed_fulltext": 4, "materialize_failed": 5}


def _rank(status: Column, known: dict[str, int], other: int) -> Column:
    out = F.lit(other)
    for name, k in known.items():
        out = F.when(status == name, k).otherwise(out)
    return out


def canonical_order() -> Column:
    """Sorts a group's best family first: grounded, then ambiguous, more mentions, more citing papers, id."""
    return F.struct(_rank(F.col("status"), {"grounded": 0, "ambiguous": 1}, 2), -F.col("n_mentions"), -F.size("citing_ids"), F.col("family_id"))


def exact_collapse(families: DataFrame) -> DataFrame:
    """One row for each seed and normalised tracked claim: the canonical family, the merged ones, unions and sums."""
    f = families.withColumn("claim", normalize_claim(F.col("tracked")))
    out = f.groupBy("doi", "claim").agg(
        F.min_by("family_id", canonical_order()).alias("family_id"), F.count("*").alias("members"), F.sum("n_mentions").alias("n_mentions"),
        F.array_sort(F.array_distinct(F.flatten(F.collect_list("citing_ids")))).alias("citing_ids"), F.array_sort(F.collect_list("family_id")).alias("ids"),
    )
    merged = F.array_remove(F.col("ids"), F.col("family_id"))
    return out.select("doi", "claim", "family_id", "members", "n_mentions", F.size("citing_ids").alias("n_papers"), F.array_join("citing_ids", ",").alias("papers"), F.array_join(merged, ",").alias("merged"))


def _holders(f: DataFrame) -> DataFrame:
    """(a, b) where the support of one family of a seed may hold the claim of the other; all that do are among them.

    A claim of three words or more meets supports that have its longest inner word; one of two words those with a word
    that ends as its first one does; one of a single word those with its first letters in a word; an empty claim all.
    """
    words = F.split("claim", " ")
    n = F.when(F.col("claim") == "", 0).otherwise(F.size(words))
    inner = F.slice(words, F.lit(2), F.greatest(F.size(words) - 2, F.lit(0)))
    longest = F.element_at(F.array_sort(F.transform(inner, lambda w: F.struct((-F.length(w)).alias("size"), w.alias("word")))), 1)["word"]
    end = F.get(words, F.lit(0))
    wanted = f.select(
        "doi", F.col("family_id").alias("x"), F.least(n, F.lit(3)).alias("kind"),
        F.when(n >= 3, longest).when(n == 2, F.right(end, F.lit(4))).when(n == 1, F.substring(end, 1, 4)).otherwise("").alias("key"),
    )
    word = F.explode(F.array_distinct(F.split("support", " "))).alias("word")
    whole = f.select("doi", F.col("family_id").alias("y"), F.lit(3).alias("kind"), word).withColumnRenamed("word", "key")
    short = wanted.where("kind < 3").select("doi", "kind", F.length("key").alias("size")).distinct()
    few = f.select("doi", F.col("family_id").alias("y"), word).join(short, "doi").where("length(word) >= size")
    starts = F.sequence(F.lit(1), F.length("word") - F.col("size") + 1)
    parts = F.when(F.col("kind") == 1, F.transform(starts, lambda s: F.substr("word", s, "size"))).otherwise(F.array(F.right("word", F.col("size"))))
    met = wanted.join(whole.unionByName(few.select("doi", "y", "kind", F.explode(parts).alias("key")).distinct()), ["doi", "kind", "key"]).where("x <> y")
    return met.select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b"))


def near_duplicate_pairs(families: DataFrame, threshold: float = 0.6) -> DataFrame:
    """Pairs (doi, a, b, reason) of grounded or ambiguous families of one seed that say the same.

    Equal normalised claims, or, where no operator word differs, similar support or support that
    holds the other's claim. Candidates meet on the claim, on rare support words or on a word of the claim.
    """
    text = F.coalesce("normalized", "tracked")
    f = families.where(F.col("status").isin("grounded", "ambiguous")).select("doi", "family_id", normalize_claim(text).alias("claim"), claim_tokens(text).alias("words"), normalize_claim(F.coalesce("support", F.lit(""))).alias("support"))
    f = cut(f.withColumn("support_words", claim_tokens(F.col("support"))))  # each text is split once
    told = f.where("support <> ''")
    keys = f.select("doi", F.col("family_id").alias("x"), F.explode(F.array_compact(F.array(F.concat(F.lit("claim:"), "claim"), F.when((F.col("support") != "") & (F.size("support_words") == 0), F.lit("wordless"))))).alias("key"))
    same = keys.join(keys.withColumnRenamed("x", "y"), ["doi", "key"]).where("x < y").select(F.col("x").alias("a"), F.col("y").alias("b"))
    spread = told.select("family_id", F.transform("support_words", lambda w: F.concat_ws("|", F.col("doi").cast("string"), w)).alias("grams"))
    met = same.unionByName(similar_grams(spread, threshold, "family_id").select("a", "b")).unionByName(_holders(told)).distinct()
    sides = [f.select(F.col("family_id").alias(s), *([F.col("doi")] if s == "a" else []), *[F.col(c).alias(f"{s}_{c}") for c in ("claim", "words", "support", "support_words")]) for s in "ab"]
    j = met.join(sides[0], "a").join(sides[1], "b")
    differing = F.array_union(F.array_except("a_words", "b_words"), F.array_except("b_words", "a_words"))
    both = (F.length("a_support") > 0) & (F.length("b_support") > 0)
    clear = ~F.arrays_overlap(differing, F.array(*[F.lit(w) for w in OPERATORS])) & both
    reason = (
        F.when(F.col("a_claim") == F.col("b_claim"), "equal_claim")
        .when(clear & (jaccard(F.col("a_support_words"), F.col("b_support_words")) >= threshold), "similar_support")
        .when(clear & (F.contains("a_support", "b_claim") | F.contains("b_support", "a_claim")), "contained")
    )
    return j.select("doi", "a", "b", reason.alias("reason")).where("reason is not null")


def greedy_families(families: DataFrame, pairs: DataFrame) -> DataFrame:
    """(doi, family_id, head, strategy): in order of id a family joins the exact group of its claim, else its first near-duplicate head.

    A family whose claim stood earlier follows the first family with it; rounds of joins settle the others. Null claims count as equal.
    """
    none = F.lit("?")  # no normalised claim has it
    t, c = F.coalesce(normalize_claim(F.col("tracked")), none), F.coalesce(normalize_claim(F.coalesce("normalized", "tracked")), none)
    f = families.select("doi", "family_id", F.struct("doi", "family_id").alias("id"), t.alias("t"), c.alias("c"))
    firsts = [f.groupBy("doi", x).agg(F.min("id").alias(f"first_{x}")) for x in "tc"]
    f = f.join(firsts[0], ["doi", "t"]).join(firsts[1], ["doi", "c"])
    f = cut(f.select("doi", "family_id", "id", F.when(F.col("first_t") != F.col("id"), F.col("first_t")).when(F.col("first_c") != F.col("id"), F.col("first_c")).alias("parent")))
    lone = f.where("parent is null")
    near = pairs.select("a", "b").where("a < b").join(lone.select(F.col("doi").alias("d"), F.col("family_id").alias("a"), F.col("id").alias("from")), "a")
    near = near.join(lone.select(F.col("doi").alias("e"), F.col("family_id").alias("b"), F.col("id").alias("to")), "b").where("d = e")
    near = cut(near.select(F.col("from").alias("a"), F.col("to").alias("b")))
    joins = near.join(attached(near), F.col("a") == F.col("id"), "left_anti").groupBy(F.col("b").alias("root")).agg(F.min("a").alias("joined"))
    follow = roots(f.where("parent is not null").select("id", "parent"))
    out = f.join(follow, "id", "left").withColumn("root", F.coalesce("root", "id")).join(joins, "root", "left")
    strategy = F.when(F.col("parent").isNotNull(), "exact_normalized_claim").when(F.col("joined").isNotNull(), "near_duplicate_claim").otherwise("none")
    return out.select("doi", "family_id", F.coalesce("joined", "root")["family_id"].alias("head"), strategy.alias("strategy"))


def shortlist(families: DataFrame, cap: int = 5) -> DataFrame:
    """The ``cap`` best families of each seed: by grounding, then mentions, then id."""
    order = Window.partitionBy("doi").orderBy(_rank(F.col("status"), STATUS_RANK, 9), F.desc("n_mentions"), "family_id")
    return families.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= cap).select("doi", "family_id", "status", "n_mentions", "rank")


def diverse_shortlist(families: DataFrame, cap: int = 5, overlap: float = 0.85) -> DataFrame:
    """(doi, family_id, rank): in shortlist order, families whose citing papers overlap less than ``overlap`` with each one taken.

    Each of ``cap`` rounds takes the best family left of every seed as one aggregate.
    """
    order = F.struct(_rank(F.col("status"), STATUS_RANK, 9).alias("status"), (-F.col("n_mentions")).alias("mentions"), "family_id", F.array_distinct("citing_ids").alias("ids"))
    ranked = families.select("doi", order.alias("best"))
    taken = ranked.select("doi").distinct().withColumn("taken", F.array().cast(f"array<{ranked.schema['best'].dataType.simpleString()}>"))
    for _ in range(cap):
        fits = F.forall("taken", lambda t: (jaccard(t["ids"], F.col("best.ids")) < overlap) & (t["family_id"] != F.col("best.family_id")))
        best = ranked.join(taken, "doi").groupBy("doi").agg(F.min(F.when(fits, F.col("best"))).alias("best"), F.first("taken").alias("taken"))
        taken = best.select("doi", F.array_compact(F.array_append("taken", F.col("best"))).alias("taken"))
    return taken.select("doi", F.posexplode("taken").alias("place", "best")).select("doi", "best.family_id", (F.col("place") + 1).alias("rank"))
