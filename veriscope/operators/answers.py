"""Answers of models, held against the shape that their stage asks for, and what each stage does with one that breaks it."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import shapes
from ..functions.shapes import Shape
from ..functions.text import variant_from_answer
from .rounds import dealt

_LEVELS = ("high", "medium", "low")
#: Field names and values are fixed: they are what the models are asked for.
ATTRIBUTIONS = shapes.fields(
    extractions=shapes.many(
        shapes.fields(
            mentionId=shapes.string(), inScopeEmpiricalAttribution=shapes.boolean(), attributedClaimText=shapes.string(nullable=True),
            supportSpanText=shapes.string(nullable=True), confidence=shapes.one_of(*_LEVELS, nullable=True), reasonIfExcluded=shapes.string(nullable=True),
        )
    )
)
CLAIM_TYPES = ("finding", "interpretation", "methodological")
VERDICTS = ("supported", "partially_supported", "overstated_or_generalized", "not_supported", "cannot_determine")
DISCOVERY = shapes.fields(
    claims=shapes.many(
        shapes.fields(
            claimText=shapes.string(1), sourceSpans=shapes.many(shapes.string(1), 1), section=shapes.string(1), citedReferences=shapes.many(shapes.string()),
            claimType=shapes.one_of(*CLAIM_TYPES), confidence=shapes.one_of("high", "medium"),
        )
    )
)
GROUNDING = shapes.fields(
    status=shapes.one_of("grounded", "ambiguous", "not_found"), normalizedClaim=shapes.string(1),
    supportSpans=shapes.many(shapes.fields(verbatimQuote=shapes.string(1), sectionHint=shapes.string(optional=True))), detailReason=shapes.string(1),
)
CLUSTERS = shapes.fields(clusters=shapes.many(shapes.fields(cluster=shapes.number(), memberIndices=shapes.many(shapes.number()), representativeIndex=shapes.number(), reasoning=shapes.string())))
#: Grounding states with which nothing downstream can go on.
BLOCKING = ("not_attempted", "no_seed_fulltext", "materialize_failed")
VERDICT = shapes.fields(comparison=shapes.string(), verdict=shapes.one_of(*VERDICTS), rationale=shapes.string(), retrievalQuality=shapes.one_of(*_LEVELS), judgeConfidence=shapes.one_of(*_LEVELS))


def validated(calls: DataFrame, shape: Shape, text: str = "response_text", failure: str = "failure", invalid: str = "LLM returned invalid JSON: ", failed: str = "") -> DataFrame:
    """``calls`` with ``answer`` (VARIANT, null unless it fits ``shape``) and ``problem`` (null if it fits), without ``text`` and ``failure``.

    A call's own failure (after ``failed``) comes before what is wrong with its text (after ``invalid``); a null text is an empty one.
    """
    said = F.coalesce(F.col(text), F.lit(""))
    nothing = F.concat(F.lit("No valid JSON found in LLM response ("), F.length(said).cast("string"), F.lit(" chars). First 200 chars: "), F.substring(said, 1, 200))
    parsed = calls.withColumn("answer", F.when(F.col(failure).isNull(), variant_from_answer(said)))
    wrong = F.when(F.col("answer").isNull(), nothing).otherwise(shapes.first_fault(F.col("answer"), shape))
    problem = F.coalesce(F.concat(F.lit(failed), F.col(failure)), F.concat(F.lit(invalid), wrong))
    out = parsed.withColumn("problem", problem).withColumn("answer", F.when(F.col("problem").isNull(), F.col("answer")))
    return out.drop(text, failure)


def required(answers: DataFrame, label: str) -> DataFrame:
    """Answers of a stage that cannot go on without them: the job fails with the first problem it meets."""
    stop = F.raise_error(F.concat(F.lit(f"{label}: "), F.col("problem"))).cast("boolean")
    return answers.where(F.when(F.col("problem").isNotNull(), stop).otherwise(True))


def attributed_claims(mentions: DataFrame, calls: DataFrame) -> DataFrame:
    """One record for each mention: whether the citing paper attributes a finding to the seed, the claim, its support, or the reason why not.

    mentions (mention_id, citing, seed); calls (citing, seed, model, response_text, failure), one for each pair of papers. An answer
    that breaks its shape puts all mentions of its call out of scope with the problem as reason, as do a failed call and
    one that is not there; a mention that the answer leaves out says so. Of several entries for a mention the last
    counts, entries for mentions of other calls do not. Mentions without papers are records too (no call).
    """
    checked = validated(calls, ATTRIBUTIONS)
    item = F.col("item")
    get = lambda name, kind="string": F.try_variant_get(item, f"$.{name}", kind)
    entries = checked.select("citing", "seed", F.posexplode(F.try_variant_get("answer", "$.extractions", "array<variant>")).alias("pos", "item")).select(
        "citing", "seed", get("mentionId").alias("mention_id"), "pos",
        F.struct(get("inScopeEmpiricalAttribution", "boolean").alias("in_scope"), get("attributedClaimText").alias("claim"), get("supportSpanText").alias("support"), get("confidence").alias("confidence"), get("reasonIfExcluded").alias("reason")).alias("entry"),
    )
    last = entries.groupBy("citing", "seed", "mention_id").agg(F.max_by("entry", "pos").alias("entry"))
    state = checked.select("citing", "seed", "model", "problem", F.lit(True).alias("called"))
    j = mentions.select("mention_id", "citing", "seed").join(state, ["citing", "seed"], "left").join(last, ["citing", "seed", "mention_id"], "left")
    reason = (
        F.when(F.col("called").isNull(), "No call covers this mention")
        .when(F.col("problem").isNotNull(), F.col("problem"))
        .when(F.col("entry").isNull(), "LLM did not return a result for this mention")
        .otherwise(F.col("entry.reason"))
    )
    return j.select(
        F.concat(F.lit("rec-"), F.col("mention_id")).alias("record_id"), "mention_id", "citing", "seed", "model", F.coalesce("entry.in_scope", F.lit(False)).alias("in_scope"),
        F.col("entry.claim").alias("claim"), F.col("entry.support").alias("support"), F.col("entry.confidence").alias("confidence"), reason.alias("reason"),
    )


def discovered_claims(papers: DataFrame, calls: DataFrame) -> DataFrame:
    """Papers with ``status`` (completed, llm_failed, no_fulltext), ``detail``, ``claims`` (array), ``n_claims`` and ``n_findings``.

    papers (paper_id, title, manuscript); calls (paper_id, response_text, failure). A claim keeps those of its spans that the
    manuscript holds word for word, and goes without one. A paper without a manuscript needs no call.
    """
    checked = validated(calls, DISCOVERY).select("paper_id", "answer", "problem", F.lit(True).alias("called"))
    kind = "array<struct<claimText:string,sourceSpans:array<string>,section:string,citedReferences:array<string>,claimType:string,confidence:string>>"
    given = F.coalesce(F.try_variant_get("answer", "$.claims", kind), F.array().cast(kind))
    held = lambda c: F.filter(c["sourceSpans"], lambda s: F.contains(F.col("manuscript"), s))
    claims = F.filter(F.transform(given, lambda c: c.withField("sourceSpans", held(c))), lambda c: F.size(c["sourceSpans"]) > 0)
    empty = F.coalesce(F.length("manuscript"), F.lit(0)) == 0
    failed = F.col("called").isNull() | F.col("problem").isNotNull()
    status = F.when(empty, "no_fulltext").when(failed, "llm_failed").otherwise("completed")
    j = papers.join(checked, "paper_id", "left").withColumn("status", status)
    j = j.withColumn("claims", F.when(F.col("status") == "completed", claims).otherwise(F.array().cast(kind)))
    j = j.withColumn("n_claims", F.size("claims")).withColumn("n_findings", F.size(F.filter("claims", lambda c: c["claimType"] == "finding")))
    done = F.format_string("Extracted %d claims (%d findings) from %s.", "n_claims", "n_findings", "title")
    detail = F.when(empty, "No claim-bearing text blocks found in parsed document.").when(failed, F.coalesce("problem", F.lit("No call covers this paper"))).otherwise(done)
    return j.withColumn("detail", detail).drop("answer", "problem", "called", "manuscript")


def _stripped(text: Column) -> Column:
    return F.regexp_replace(text, r"^\s+|\s+$", "")


def _short(text: Column, most: int, mark: str) -> Column:
    return F.when(F.length(text) > most, F.concat(F.substring(text, 1, 797 if most == 800 else 197), F.lit(mark))).otherwise(text)


def ground_claims(families: DataFrame, calls: DataFrame, most: int = 8) -> DataFrame:
    """Families with ``status`` of their claim in the seed's text, ``normalized``, ``spans`` (text, section), ``failures`` (quotes not found), ``blocks`` and ``detail``.

    families (family_id, tracked, manuscript); calls (family_id, response_text, failure). Only the first ``most`` spans of an answer count. A
    quote that the manuscript does not hold word for word stays a span, but turns grounded into ambiguous. No text: no_seed_fulltext;
    a failed, missing or broken answer: not_attempted; both block what follows, not_found does not.
    """
    checked = validated(calls, GROUNDING, invalid="LLM returned invalid grounding JSON: ", failed="LLM claim grounding failed: ").select("family_id", "answer", "problem", F.lit(True).alias("called"))
    claim, empty = _stripped(F.col("tracked")), F.coalesce(F.length("manuscript"), F.lit(0)) == 0
    kind = "array<struct<verbatimQuote:string,sectionHint:string>>"
    get = lambda name: F.try_variant_get("answer", f"$.{name}", "string")
    j = families.join(checked, "family_id", "left")
    ok = ~empty & F.col("answer").isNotNull()
    given = F.when(ok, F.slice(F.try_variant_get("answer", "$.supportSpans", kind), 1, most)).otherwise(F.array().cast(kind))
    lost = F.filter(F.transform("_given", lambda x: _stripped(x["verbatimQuote"])), lambda q: (F.length(q) > 0) & ~F.contains(F.col("manuscript"), q))
    j = j.withColumn("_given", given).withColumn("_lost", lost)
    bad = F.size("_lost") > 0
    status = F.when(empty, "no_seed_fulltext").when(~ok, "not_attempted").when(bad & (get("status") == "grounded"), "ambiguous").otherwise(get("status"))
    note = F.lit(" (verification: a quoted passage was not found verbatim in the manuscript — possible paraphrase or model error; first issue: Not found as a contiguous substring of the manuscript text.)")
    detail = (
        F.when(empty, "No manuscript text to send to the LLM (empty parsed document).")
        .when(~ok, F.coalesce("problem", F.lit("LLM claim grounding failed: No call covers this family")))
        .otherwise(F.concat(get("detailReason"), F.when(bad, note).otherwise("")))
    )
    spans = F.transform("_given", lambda x: F.struct(_short(x["verbatimQuote"], 800, "...").alias("text"), F.nullif(_stripped(x["sectionHint"]), F.lit("")).alias("section")))
    out = j.withColumns({"status": status, "normalized": F.coalesce(F.when(ok, F.nullif(_stripped(get("normalizedClaim")), F.lit(""))), claim), "spans": spans, "failures": F.transform("_lost", lambda q: _short(q, 200, "…")), "detail": detail})
    return out.withColumn("blocks", F.col("status").isin(*BLOCKING)).drop("_given", "_lost", "answer", "problem", "called", "manuscript")


def claim_clusters(families: DataFrame, calls: DataFrame) -> DataFrame:
    """(seed, cluster, index, representative, reasoning): which families of a seed say the same, by an answer for each seed.

    families (seed, index); calls (seed, response_text, failure). A seed of one family needs no call; for another one a failed,
    missing or broken answer stops the job. Clusters can leave families out and name ones that are not there.
    """
    sizes = families.groupBy("seed").agg(F.count("*").alias("n"), F.min("index").alias("only"))
    j = sizes.where("n > 1").join(validated(calls, CLUSTERS), "seed", "left")
    j = j.withColumn("problem", F.when(F.col("answer").isNull(), F.coalesce("problem", F.lit("No call covers this seed"))))
    kind = "array<struct<cluster:bigint,memberIndices:array<bigint>,representativeIndex:bigint,reasoning:string>>"
    told = required(j, "Family consolidation").select("seed", F.inline(F.try_variant_get("answer", "$.clusters", kind)))
    members = told.select("seed", "cluster", F.explode("memberIndices").alias("index"), "representativeIndex", "reasoning")
    members = members.select("seed", "cluster", "index", (F.col("index") == F.col("representativeIndex")).alias("representative"), "reasoning")
    alone = sizes.where("n = 1").select("seed", F.lit(1).cast("long").alias("cluster"), F.col("only").cast("long").alias("index"), F.lit(True).alias("representative"), F.lit("Single family — no consolidation needed.").alias("reasoning"))
    return members.unionByName(alone)


def _verdicts(calls: DataFrame, label: str, name: str) -> DataFrame:
    """``calls`` with ``name``, the verdict of each call as a struct, ``cannot_determine`` with the problem if it has none, in place of the call's columns."""
    get = lambda field: F.try_variant_get("answer", f"$.{field}", "string")
    bad = F.col("problem").isNotNull()
    who = F.concat(F.lit("llm:"), F.col("model"), F.lit(label), F.when(bad, ":error").otherwise(""))
    entry = F.struct(
        get("comparison").alias("comparison"), F.when(bad, "cannot_determine").otherwise(get("verdict")).alias("verdict"),
        F.when(bad, F.concat(F.lit("LLM error: "), F.col("problem"))).otherwise(get("rationale")).alias("rationale"),
        get("retrievalQuality").alias("quality"), get("judgeConfidence").alias("confidence"), who.alias("adjudicator"), (~bad).alias("successful"),
    )
    return validated(calls, VERDICT).withColumn(name, entry).drop("model", "answer", "problem")


def unsure(verdict: Column, confidence: Column, bundled: Column) -> Column:
    """Whether a first verdict needs a second look: low confidence, no verdict, or medium confidence on a bundled citation."""
    return F.coalesce((confidence == "low") | (verdict == "cannot_determine") | (bundled & (confidence == "medium")), F.lit(False))


def adjudicate(records: DataFrame, first: DataFrame, second: DataFrame | None = None) -> DataFrame:
    """Active records with the verdicts of ``first``; with ``second``, those of which the first is unsure take its verdicts instead.

    records (task_id, bundled, excluded, ...); first, second (task_id, model, response_text, failure), one for each task. A broken
    answer is a verdict too: ``cannot_determine`` with the error as rationale, so it asks for a second look. A record that no
    call covers is one with a broken answer. Excluded records stay as they are, without a verdict. ``passes`` counts the looks at a record.
    Answers are held against their shape after the join, only those that count.
    """
    told = ("model", "response_text", "failure")
    records = dealt(records, "task_id")  # answers cost more than their bytes tell, by which adaptive execution would gather them in a few tasks

    def looked(calls: DataFrame, label: str, name: str, base: DataFrame, asked: Column) -> DataFrame:
        of = calls.select("task_id", F.struct(*told).alias("_call"))
        rest = F.struct(*[c for c in base.columns if c != "task_id"])  # apart from a call's columns
        held = base.select("task_id", rest.alias("_held"), asked.alias("_asked")).join(of, "task_id", "left").withColumn("_call", F.when(F.col("_asked"), F.col("_call")))
        got = _verdicts(held.select("task_id", "_held", F.col("_call").isNotNull().alias("_called"), *[F.col(f"_call.{c}").alias(c) for c in told]), label, name)
        got = got.select("task_id", "_held.*", F.when(F.col("_called"), F.col(name)).alias(name))
        none = F.struct(
            F.lit(None).cast("string").alias("comparison"), F.lit("cannot_determine").alias("verdict"), F.lit("LLM error: No call covers this record").alias("rationale"),
            F.lit(None).cast("string").alias("quality"), F.lit(None).cast("string").alias("confidence"), F.lit("llm:none:error").alias("adjudicator"), F.lit(False).alias("successful"),
        )
        return got.withColumn(name, F.coalesce(F.col(name), none))

    active = ~F.coalesce(F.col("excluded"), F.lit(False))
    out = looked(first, ":thinking" if second is not None else "", "_first", records, active)
    again = F.lit(False)
    if second is not None:
        again = unsure(F.col("_first.verdict"), F.col("_first.confidence"), F.col("bundled"))
        out = looked(second, "", "_second", out.withColumn("_again", again), active & again)
        again = F.col("_again")
    taken = F.when(again, F.col("_second")) if second is not None else F.lit(None)
    final = F.when(active, F.coalesce(taken, F.col("_first")))
    out = out.withColumn("_final", final).withColumn("passes", F.when(~active, 0).when(again, 2).otherwise(1))
    names = ("comparison", "verdict", "rationale", "quality", "confidence", "adjudicator", "successful")
    return out.select(*[c for c in records.columns if c not in names], *[F.col(f"_final.{c}").alias(c) for c in names], "passes")
