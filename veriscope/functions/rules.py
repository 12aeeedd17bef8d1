"""The rule engines as chains of conditions on columns."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import alternation, literals, pattern

# The pattern lists of the rules. \b is an ASCII word boundary.
COMMENTARY_TITLES = (
    r"\breview\b", r"\bcommentary\b", r"\beditorial\b", r"\bperspective\b", r"\bnews\b", r"\binterview\b", r"\bthe people behind the papers\b", r"\bletter to the editor\b", r"\bcorrigendum\b",
    r"\berratum\b", r"\bretraction\b", r"\bin brief\b", r"\bhighlights?\b", r"\bposition statement\b", r"\bguidance\b", r"\bhow much does that matter\b", r"\boverview\b",
)
METHODS_SECTIONS = (
    r"\bmethods?\b", r"\bmaterials?\s+and\s+methods?\b", r"\bprotocol\b", r"\bsupplemental\b", r"\bexperimental\s+procedures?\b", r"\bdata\s+analysis\b", r"\bstatistical\b", r"\bRNA-seq\b",
    r"\bimmunofluorescence\b", r"\bwestern\s+blot\b", r"\bkey\s+resources?\s+table\b", r"\bhepatoblast\s+isolation\b", r"\bimage\s+analysis\b", r"\bquantification\b", r"\bcell\s+culture\b",
    r"\banimal\b", r"\bmicroscopy\b", r"\bcloning\b",
)
BACKGROUND_SECTION = r"\b(?:introduction|background|overview|context|related\s+work|literature)\b"
BIBLIOGRAPHY_SIGNALS = (r"(?i)\breferences\b", r"(?i)\bbibliography\b", r"(?m)^\s*\d+\.\s+[A-Z][a-z]+\s+[A-Z]", r"(?:Lancet|Nature|Science|Cell|PNAS|eLife|PLoS|J\s+Cell\s+Biol)\b.*\d{4}")
METHODS_PHRASES = (
    r"\bas\s+(?:described|reported)\s+(?:in|by|previously)\b", r"\bfollowing\s+(?:the\s+)?protocol\b", r"\bwas\s+performed\s+as\s+(?:described|in)\b",
    r"\busing\s+(?:the\s+)?(?:method|protocol|approach|procedure|data|software|tool)\b", r"\baccording\s+to\b", r"\bmodified\s+from\b", r"\bpreviously\s+described\b",
    r"\bwere?\s+(?:cultured|isolated|extracted|prepared|stained|fixed|imaged|analyzed|quantified)\b",
)
ATTRIBUTION_VERBS = (
    r"\b(?:showed?|shown)\b", r"\b(?:found|finding)\b", r"\brevealed\b", r"\bdemonstrated\b", r"\bidentified\b", r"\breported\s+that\b", r"\bdiscovered\b", r"\buncovered\b", r"\bconfirmed\b",
    r"\bprovided\s+evidence\b", r"\bsuggested\s+that\b", r"\bproposed\s+that\b", r"\bimplicated\b",
)
BACKGROUND_PHRASES = (
    r"\b(?:is|are)\s+(?:known|thought|believed|considered|essential|important|critical|key|involved|implicated)\b",
    r"\bhas\s+been\s+(?:well[-\s])?(?:characterized|established|studied|documented|recognized)\b",
    r"\bplay(?:s|ed)?\s+(?:a\s+)?(?:key|critical|important|essential|central|major)?\s*role\b", r"\breviewed?\s+(?:in|by)\b", r"\bfor\s+(?:a\s+)?review\b", r"\bwidely\s+(?:used|studied|reported)\b",
)
PROVIDER_ERRORS = (
    ("billing_or_quota", "credit balance|insufficient credit|insufficient funds|billing|quota|payment required|usage limit"),
    ("authentication", "unauthorized|authentication|invalid api key|api key|401"),
    ("authorization", "forbidden|permission|access denied|403"),
    ("rate_limit", "rate limit|too many requests|429|overloaded"),
    ("network_or_transport", "network|socket|econn|etimedout|timed out|connection reset|transport"),
)
STRUCTURED_HINTS = ("biorxiv_xml", "pmc_xml", "pubmed_xml", "jats_xml")
ROLES = ("substantive_attribution", "background_context", "methods_materials", "acknowledgment_or_low_information", "unclear")
MODES = ("fidelity_specific_claim", "fidelity_background_framing", "fidelity_bundled_use", "fidelity_methods_use", "review_transmission", "skip_low_information", "manual_review_role_ambiguous", "manual_review_extraction_limited")
VERDICTS = ("supported", "partially_supported", "overstated_or_generalized", "not_supported", "cannot_determine")


def _hits(text: Column, patterns: Iterable[str], any_case: bool = True) -> list[Column]:
    return [F.coalesce(text.rlike(("(?i)" if any_case else "") + pattern(p)), F.lit(False)) for p in patterns]


def _may_hit(low: Column, patterns: Iterable[str]) -> Column:
    """Whether ``low``, lower-cased, holds a text without which none of the patterns occurs: far cheaper than to look for them."""
    return F.coalesce(any_of([F.contains(low, F.lit(x)) for x in dict.fromkeys(x for p in patterns for x in literals(p))]), F.lit(False))


def _any_hit(text: Column, patterns: Iterable[str], low: Column | None = None) -> Column:
    """Whether any of the patterns, all of which stand between word boundaries, occurs in any case: one pass over texts that may hold one.

    ``low`` is the text in lower case, where it is at hand. Only where to look depends on it, so lower case of any letters will do, which costs less than that of A-Z alone.
    """
    return F.when(_may_hit(F.lower(text) if low is None else low, patterns), text.rlike("(?i)" + alternation(patterns))).otherwise(F.lit(False))


def _hit_count(low: Column, patterns: Iterable[str]) -> Column:
    """How many of the patterns occur in a text in lower case; each is looked for only where it may occur."""
    return count_of([F.when(_may_hit(low, [p]), low.rlike("(?i)" + pattern(p))).otherwise(F.lit(False)) for p in patterns])


def any_of(flags: list[Column]) -> Column:
    out = F.lit(False)
    for f in flags:
        out = out | f
    return out


def count_of(flags: list[Column]) -> Column:
    return sum((f.cast("int") for f in flags), F.lit(0))


def edge_flags(paper_type: Column, title: Column, references: Column) -> dict[str, Column]:
    """What kind of citing paper an edge comes from."""
    kind = F.lower(F.coalesce(paper_type, F.lit("")))
    review, chapter = kind.isin("review", "literature-review"), kind.isin("book-chapter", "book-section")
    letter = kind.isin("letter", "erratum", "correction")
    commentary = kind.isin("editorial", "paratext", "peer-review") | _any_hit(title, COMMENTARY_TITLES)
    return {
        "is_review": review,
        "is_commentary": commentary,
        "is_letter": letter,
        "is_book_chapter": chapter,
        "is_preprint": kind.isin("posted-content", "preprint"),
        "is_journal_article": kind.isin("article", "journal-article"),
        "is_primary_like": ~(review | chapter | letter | commentary),
        "high_reference_count": F.coalesce(references > 100, F.lit(False)),
    }


def auditability(availability: Column, hint: Column) -> Column:
    """How well a paper's text can be audited."""
    return (
        F.when(availability == "unavailable", "not_auditable")
        .when(availability == "abstract_only", "partially_auditable")
        .when(F.coalesce(hint.isin(*STRUCTURED_HINTS), F.lit(False)), "auditable_structured")
        .otherwise("auditable_pdf")
    )


def marker_style(marker: Column) -> Column:
    """Style of a citation marker."""
    return (
        F.when(marker.rlike(r"[A-Z][a-z]+.*(?:et\s+al\.?|and\s+[A-Z]).*\d{4}"), "author_year")
        .when(F.trim(marker).rlike(r"^\d{1,3}$"), "numeric")
        .when(F.trim(marker).rlike(r"^\d{4}$"), "year_only")
        .otherwise("unknown")
    )


def context_type(context: Column, section: Column, low: Column | None = None) -> Column:
    """What kind of passage a mention stands in; ``low`` is the context in lower case, where it is at hand (one of 600 characters needs none)."""
    dois = F.when(F.contains(context, F.lit("10.")), F.regexp_count(context, F.lit(pattern(r"\b10\.\d{4,}/")))).otherwise(F.lit(0))
    years = F.when(F.contains(context, F.lit("(")), F.regexp_count(context, F.lit(r"\(\d{4}\)"))).otherwise(F.lit(0))
    signals = count_of(_hits(context, BIBLIOGRAPHY_SIGNALS, any_case=False))
    # signals are looked for only amid three years
    return (
        F.when((dois >= 3) | ((years >= 3) & (signals >= 2)), "bibliography_like")
        .when(_any_hit(section, METHODS_SECTIONS), "methods_like")
        .when((F.length(context) < 600) & _any_hit(context, METHODS_SECTIONS, low), "methods_like")
        .when(F.length(context) >= 80, "narrative_like")
        .otherwise("unknown")
    )


def mention_confidence(style: Column, kind: Column, length: Column) -> Column:
    """Confidence in an extracted mention."""
    return (
        F.when(kind == "bibliography_like", "low")
        .when((style == "author_year") & (kind == "narrative_like") & (length >= 100), "high")
        .when(style.isin("author_year", "numeric") & (length >= 80), "medium")
        .otherwise("low")
    )


def role_signals(near: Column, section: Column) -> dict[str, Column]:
    """Counts of role cues: sections by their title, phrases in ``near``, what stands within 200 characters of the marker, in lower case."""
    return {
        "methods_section": _any_hit(section, METHODS_SECTIONS),
        "background_section": _any_hit(section, [BACKGROUND_SECTION]),
        "methods_phrases": _hit_count(near, METHODS_PHRASES),
        "attribution_verbs": _hit_count(near, ATTRIBUTION_VERBS),
        "background_phrases": _hit_count(near, BACKGROUND_PHRASES),
    }


def citation_role(signals: dict[str, Column], length: Column, confidence: Column) -> Column:
    """What a citation does in its passage."""
    methods = signals["methods_section"].cast("int") + signals["methods_phrases"]
    background = signals["background_section"].cast("int") + signals["background_phrases"]
    verbs = signals["attribution_verbs"]
    thin = F.when((length < 100) & (confidence == "low"), "acknowledgment_or_low_information").otherwise("unclear")
    return (
        F.when(methods + background + verbs == 0, thin)
        .when(signals["methods_section"] & (verbs <= 1), "methods_materials")
        .when((verbs >= 2) | ((verbs >= 1) & (background == 0) & (methods == 0)), "substantive_attribution")
        .when((background >= 1) & (verbs == 0), "background_context")
        .when((verbs >= 1) & (background >= 1), "substantive_attribution")
        .when(methods >= 1, "methods_materials")
        .otherwise(thin)
    )


def evaluation_mode(role: Column, bundled: Column, review: Column, confidence: Column) -> Column:
    """How a citation is to be evaluated."""
    return (
        F.when(review, "review_transmission")
        .when(bundled & role.isin("substantive_attribution", "background_context"), "fidelity_bundled_use")
        .when(role == "unclear", F.when(confidence == "low", "manual_review_extraction_limited").otherwise("manual_review_role_ambiguous"))
        .when(role == "substantive_attribution", "fidelity_specific_claim")
        .when(role == "background_context", "fidelity_background_framing")
        .when(role == "methods_materials", "fidelity_methods_use")
        .otherwise("skip_low_information")
    )


def provider_error(message: Column) -> Column:
    """Class of a provider's error message."""
    out = F.lit("unknown")
    for name, source in reversed(PROVIDER_ERRORS):
        out = F.when(F.lower(message).rlike(source), name).otherwise(out)
    return out


def is_fatal(error_class: Column) -> Column:
    return error_class.isin("billing_or_quota", "authentication", "authorization")


def looks_like_html(body: Column) -> Column:
    head = F.lower(F.substring(body, 1, 512))
    return F.contains(head, F.lit("<html")) | F.contains(head, F.lit("<!doctype html")) | F.contains(head, F.lit("<head"))


def looks_like_xml(body: Column) -> Column:
    head = F.lower(F.substring(body, 1, 1024))
    return any_of([F.contains(head, F.lit(x)) for x in ("<?xml", "<article", "<pmc-articleset", "<tei")])


def html_kind(body: Column) -> Column:
    low = F.lower(body)
    return (
        F.when(any_of([F.contains(low, F.lit(x)) for x in ("pow_challenge", "cloudpmc", "captcha", "challenge")]), "html_challenge")
        .when(F.contains(low, F.lit("preparing to download")), "html_interstitial")
        .otherwise("html_landing_page")
    )


def decision(unique: Column, auditable: Column, coverage: Column, resolved: Column | None = None, blocked: Column | None = None, least: int = 3, share: float = 0.3) -> Column:
    """Whether a claim family is worth analysing, with the rule that decided."""
    rule = (
        F.when(F.lit(False) if resolved is None else ~resolved, "seed_unresolved")
        .when(F.lit(False) if blocked is None else blocked, "claim_not_grounded")
        .when(unique == 0, "no_edges")
        .when(auditable < least, "too_few_auditable")
        .when(coverage < share, "low_coverage")
        .otherwise("greenlight")
    )
    return F.struct(F.when(rule == "greenlight", "greenlight").otherwise("deprioritize").alias("decision"), rule.alias("rule"))


def family_profile(unique: Column, total: Column, primary: Column, review: Column, coverage: Column) -> Column:
    """Tags that describe a family's neighbourhood, in display order."""
    some = unique > 0
    mix = (
        F.when(some & (primary >= 0.7), "primary_empirical_heavy")
        .when(some & (review >= 0.4) & (primary >= 0.2), "mixed_primary_review")
        .when(some & (review >= 0.5), "review_mediated")
    )
    return F.array_compact(
        F.array(
            F.when(some & (unique <= 5), "small_family"),
            mix,
            F.when((total > 0) & ((total - unique) / total >= 0.2), "duplicate_heavy"),
            F.when(some & (coverage < 0.5), "low_access"),
        )
    )


def metric_priority(decided: Column, auditable: Column, primary: Column) -> Column:
    """Priority of one family by its own metrics."""
    return F.when(decided == "deprioritize", "not_now").when((auditable >= 10) & (primary >= 0.5), "first").when(auditable >= 5, "later").otherwise("caution")
