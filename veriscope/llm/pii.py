"""Personal data by weak supervision: labelers vote, EM weighs them, a span classifier decides."""

from __future__ import annotations

import math
from collections import defaultdict
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

BASE = ("email", "ip", "card", "phone")
SECRET = "secret"
_SPANS = "array<struct<start:int,end:int,text:string>>"
_PART = 256

# The patterns of the base spans. Quantifiers are possessive, and a run that failed at
# its start is not tried again inside, so that each takes linear time; what they match is the same.
_LOCAL = "A-Za-z0-9._%+-"
PATTERNS = {
    "email": rf"(?:(?<![{_LOCAL}])|\G)[{_LOCAL}]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?:(?<![0-9])|\G)[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"[0-9](?:[ -]?[0-9]){12,}+",
    "phone": r"\+[0-9][ ().0-9-]+[0-9]",
}
#: Runs of at least 12 letters, digits and marks with a letter and a digit: candidates beyond the base.
CANDIDATE = r"(?<![A-Za-z0-9_+/=-])(?=[A-Za-z_+/=-]*[0-9])(?=[0-9_+/=-]*[A-Za-z])[A-Za-z0-9_+/=-]{12,}+"

# The gazetteer's beginnings of keys, and the words that introduce one.
_KNOWN = r"^(?:AKIA|ASIA|AIza|ghp_|gho_|github_pat_|glpat-|sk-|sk_live_|pk_live_|xox[abp]-|eyJ|SG)"
_CONTEXT = r"(?i)(?:password|passwd|pwd|passphrase|token|secret|api[ _-]?key|access[ _-]?key|private[ _-]?key|key|credential|ssn|iban|passport|account)[\x20\"'=:]{1,5}$"


def _numbered(text: Column, pattern: str) -> Column:
    """Leftmost non-overlapping matches of ``pattern`` as structs of start, end and text."""
    found, between = F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), F.split(text, pattern, -1)
    zero = F.struct(F.lit(0).alias("at"), F.array().cast(_SPANS).alias("spans"))

    # found and between are bound as one struct, so that the text is searched once
    def walked(both: Column) -> Column:
        def step(acc: Column, k: Column) -> Column:
            start = acc["at"] + F.length(F.get(both["between"], k))
            end = start + F.length(F.get(both["found"], k))
            span = F.struct(start.alias("start"), end.alias("end"), F.get(both["found"], k).alias("text"))
            return F.struct(end.alias("at"), F.array_append(acc["spans"], span).alias("spans"))

        def part(acc: Column, first: Column) -> Column:
            own = F.aggregate(F.sequence(first, F.least(first + _PART - 1, F.size(both["found"]) - 1)), F.struct(acc["at"].alias("at"), F.array().cast(_SPANS).alias("spans")), step)
            return F.get(F.transform(F.array(own), lambda x: F.struct(x["at"].alias("at"), F.concat(acc["spans"], x["spans"]).alias("spans"))), F.lit(0))

        # an array grows by a copy: lists of _PART spans are joined, so that a text of many matches takes little more than linear time
        return F.aggregate(F.sequence(F.lit(0), F.size(both["found"]) - 1, F.lit(_PART)), zero, part, lambda acc: acc["spans"])

    both = F.array(F.struct(found.alias("found"), between.alias("between")))
    return F.coalesce(F.get(F.transform(both, lambda x: F.when(F.size(x["found"]) > 0, walked(x))), F.lit(0)), F.array().cast(_SPANS))


def _digits(text: Column) -> Column:
    return F.regexp_replace(text, "[^0-9]", "")


def _luhn(digits: Column) -> Column:
    """Luhn's sum over the digits, from the right, is a multiple of ten."""
    back = F.reverse(digits)

    def step(total: Column, k: Column) -> Column:
        digit = F.substring(back, k, F.lit(1)).cast("int")
        twice = F.when(digit > 4, 2 * digit - 9).otherwise(2 * digit)
        return total + F.when(k % 2 == 0, twice).otherwise(digit)

    return F.aggregate(F.sequence(F.lit(1), F.length(digits)), F.lit(0), step) % 10 == 0


def base_spans(text: Column, kind: str) -> Column:
    """The spans of one base kind that pass its check."""
    part = r"0*(?:25[0-5]|2[0-4][0-9]|1[0-9]{2}|[0-9]{1,2})"
    checks = {
        "email": lambda x: F.lit(True),
        "ip": lambda x: x["text"].rlike(rf"^{part}(?:\.{part}){{3}}$"),
        "card": lambda x: F.length(_digits(x["text"])).between(13, 19) & _luhn(_digits(x["text"])),
        "phone": lambda x: F.length(_digits(x["text"])).between(9, 15),
    }
    needs = {"email": "@", "ip": ".", "card": None, "phone": "+"}
    spans = F.filter(_numbered(text, PATTERNS[kind]), checks[kind])
    if needs[kind] is None:
        return spans
    return F.when(F.contains(text, F.lit(needs[kind])), spans).otherwise(F.array().cast(_SPANS))


def candidates(text: Column) -> Column:
    """Candidate spans with the 24 code points before them."""
    def described(x: Column) -> Column:
        first = F.greatest(x["start"] - 24, F.lit(0))
        return F.struct(x["start"].alias("start"), x["end"].alias("end"), x["text"].alias("text"), F.substring(text, first + 1, x["start"] - first).alias("before"))

    return F.when(text.rlike("[0-9]"), F.transform(_numbered(text, CANDIDATE), described)).otherwise(F.array().cast("array<struct<start:int,end:int,text:string,before:string>>"))


def votes(x: Column) -> dict[str, Column]:
    """The labelers' votes on a candidate: a format, a gazetteer, the context, and two on the characters."""
    text = x["text"]
    return {
        "format": text.rlike(r"^(?:[A-Z0-9]{16,24}|[0-9a-f]{16,64}|[A-Za-z0-9+/_-]{28,}=*)$"),
        "gazetteer": text.rlike(_KNOWN),
        "context": x["before"].rlike(_CONTEXT) | text.rlike(r"(?i)^(?:password|passwd|pwd|token|secret|api_?key|key)=."),
        "mixed": F.length(F.regexp_replace(text, "[^0-9]", "")) * 8 >= F.length(text),
        "wordless": ~text.rlike("[A-Za-z]{7,}"),
    }


#: Rates of the labelers on true and on false spans that EM starts from and, with a tenth of the weight, is held to.
PRIOR_RATES = {"format": (0.8, 0.2), "gazetteer": (0.5, 0.02), "context": (0.6, 0.05), "mixed": (0.8, 0.4), "wordless": (0.7, 0.3)}


def traits(x: Column) -> dict[str, Column]:
    """What the classifier sees besides the votes, each in a few classes."""
    text = x["text"]
    return {
        "length": F.least(F.floor(F.log2(F.length(text))), F.lit(7)).cast("int"),
        "upper": text.rlike("[A-Z]").cast("int"),
        "lower": text.rlike("[a-z]").cast("int"),
        "marks": text.rlike("[_+/=-]").cast("int"),
    }


@dataclass
class SpanModel:
    """A logit of each class of each feature; a span is personal if the sum with the prior's is above 0."""

    prior: float
    weights: dict[str, dict[int, float]]
    reliability: dict[str, tuple[float, float]]

    def accept(self, x: Column) -> Column:
        total = F.lit(self.prior)
        for name, column in {**{k: v.cast("int") for k, v in votes(x).items()}, **traits(x)}.items():
            chain = F.lit(0.0)
            for value, weight in self.weights[name].items():
                chain = F.when(column == value, F.lit(weight)).otherwise(chain)
            total = total + chain
        return total > 0


def fit(groups: list[tuple[dict[str, int], dict[str, int], int]], rounds: int = 50) -> SpanModel:
    """EM over counts of equal votes: how often each labeler votes on true and on false spans; then naive Bayes on its soft labels.

    groups: (votes, traits, count) for each combination met. Their number is bounded by the labelers
    and classes, not by the data.
    """
    names = list(groups[0][0])
    total = sum(n for _, _, n in groups)
    start = {name: PRIOR_RATES.get(name, (0.7, 0.3)) for name in names}
    rates, yes, no = dict(start), total / 2, total / 2

    def expect() -> list[float]:
        out = []
        for v, _, _ in groups:
            logit = math.log(yes / no)
            for name in names:
                hit, false = rates[name]
                logit += math.log(hit / false) if v[name] else math.log((1 - hit) / (1 - false))
            out.append(1 / (1 + math.exp(-max(-30.0, min(30.0, logit)))))
        return out

    soft = expect()
    for _ in range(rounds):
        yes = sum(p * n for p, (_, _, n) in zip(soft, groups, strict=True)) + 1
        no = total - yes + 2
        held = 0.1 * total + 1
        for name in names:
            rates[name] = (
                (sum(p * n * v[name] for p, (v, _, n) in zip(soft, groups, strict=True)) + start[name][0] * held) / (yes + held),
                (sum((1 - p) * n * v[name] for p, (v, _, n) in zip(soft, groups, strict=True)) + start[name][1] * held) / (no + held),
            )
        soft = expect()
    seen: dict[str, dict[int, list[float]]] = defaultdict(lambda: defaultdict(lambda: [0.5, 0.5]))
    for p, (v, t, n) in zip(soft, groups, strict=True):
        for name, value in {**v, **t}.items():
            seen[name][value][0] += p * n
            seen[name][value][1] += (1 - p) * n
    weights = {name: {value: math.log((a / (yes + 1)) / (b / (no + 1))) for value, (a, b) in classes.items()} for name, classes in seen.items()}
    return SpanModel(math.log(yes / no), weights, rates)


def train(docs: DataFrame) -> SpanModel | None:
    """Span classifier from all candidates in ``docs``; None if there is none."""
    x = F.col("x")
    v, t = votes(x), traits(x)
    exploded = docs.select(F.explode(candidates(F.col("text"))).alias("x"))
    counted = exploded.select(*[c.cast("int").alias(f"v_{k}") for k, c in v.items()], *[c.alias(f"t_{k}") for k, c in t.items()])
    rows = counted.groupBy(*counted.columns).agg(F.count("*").alias("n")).toLocalIterator()
    groups = [({k: r[f"v_{k}"] for k in v}, {k: r[f"t_{k}"] for k in t}, r["n"]) for r in rows]
    return fit(sorted(groups, key=str)) if groups else None


def find_personal(docs: DataFrame) -> DataFrame:
    """Personal data in every whole text of ``docs`` (doc_id, text, ...).

    Returns (doc_id, n_email, n_ip, n_card, n_phone, n_secret, base, spans): base and spans are arrays
    of structs (kind, start, end) in code points, end exclusive, by kind in the order email, ip, card,
    phone, secret, then start; base has the first four kinds.

    Defined cases: null and empty texts have no spans; a table without candidates trains nothing and
    adds nothing; repeated rows and null ids are each searched; other columns are ignored; an empty
    table gives an empty table.
    """
    texts = docs.select("doc_id", F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    model = train(texts)
    found = texts.select("doc_id", F.xxhash64("text").alias("text_hash"), *[base_spans(F.col("text"), kind).alias(kind) for kind in BASE], *([] if model is None else [F.filter(candidates(F.col("text")), model.accept).alias(SECRET)]))
    if model is None:
        found = found.withColumn(SECRET, F.array().cast(_SPANS))

    def named(kind: str) -> Column:
        return F.transform(kind, lambda x: F.struct(F.lit(kind).alias("kind"), x["start"].alias("start"), x["end"].alias("end")))

    base = F.concat(*[named(kind) for kind in BASE])
    return found.select("doc_id", "text_hash", *[F.size(kind).cast("long").alias(f"n_{kind}") for kind in (*BASE, SECRET)], base.alias("base"), F.concat(base, named(SECRET)).alias("spans"))


def redact(docs: DataFrame, found: DataFrame) -> DataFrame:
    """``docs`` with each span of ``found`` replaced by its kind in square brackets; where spans overlap, the first stays.

    found: what :func:`find_personal` gives for these rows. A row meets its spans by doc_id, null too, and the hash of its
    text, so rows that share a doc_id keep to their own spans. Rows without spans, also those with a null text, stay as
    they are; columns of any name pass unchanged.
    """
    zero = F.struct(F.lit("").alias("out"), F.lit(0).alias("at"))

    def step(acc: Column, x: Column) -> Column:
        piece = F.concat(acc["out"], F.substring("text", acc["at"] + 1, x["start"] - acc["at"]), F.lit("["), x["kind"], F.lit("]"))
        return F.when(x["start"] < acc["at"], acc).otherwise(F.struct(piece.alias("out"), x["end"].alias("at")))

    def redacted(spans: Column) -> Column:
        ordered = F.array_sort(F.transform(spans, lambda x: F.struct(x["start"].alias("start"), x["end"].alias("end"), x["kind"].alias("kind"))))
        return F.aggregate(ordered, zero, step, lambda acc: F.concat(acc["out"], F.substring("text", acc["at"] + 1, F.length("text"))))
    of = "_" * (1 + max(len(c) for c in docs.columns))  # begins no column of the input
    spans = found.where(F.size("spans") > 0).groupBy(F.col("doc_id").alias(f"{of}d"), F.col("text_hash").alias(f"{of}h")).agg(F.first("spans").alias(of))
    joined = docs.join(spans, F.col("doc_id").eqNullSafe(F.col(f"{of}d")) & (F.xxhash64(F.coalesce(F.col("text").cast("string"), F.lit(""))) == F.col(f"{of}h")), "left")
    return joined.select(*[F.when(F.size(of) > 0, redacted(F.col(of))).otherwise(F.col("text")).alias("text") if c == "text" else F.col(f"`{c}`") for c in docs.columns])


def digest(spans: str) -> Column:
    """``kind:start:end`` of an array of spans, comma-joined."""
    return F.array_join(F.transform(spans, lambda x: F.concat_ws(":", x["kind"], x["start"].cast("string"), x["end"].cast("string"))), ",")
