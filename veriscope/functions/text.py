"""Scalar text functions as Spark columns."""

from __future__ import annotations

import re
from collections.abc import Iterable

from pyspark.sql import Column
from pyspark.sql import functions as F

# Words that retrieval ignores.
STOP_WORDS = (
    "the a an and or but in on at to for of with by from is are was were be been being have has had do does did will would could should may might shall can "
    "this that these those it its we our they their not also et al figure fig table"
).split()

#: An ASCII word boundary: Java's own \b follows Unicode, the rules' patterns do not.
BOUNDARY = r"(?:(?<![A-Za-z0-9_])(?=[A-Za-z0-9_])|(?<=[A-Za-z0-9_])(?![A-Za-z0-9_]))"


def pattern(source: str) -> str:
    """A pattern with ASCII word boundaries where ``source`` has \\b; one that begins or ends with it must go on with a word character there."""
    begin, end = source.startswith(r"\b"), source.endswith(r"\b")
    middle = source[2 * begin : len(source) - 2 * end].replace(r"\b", BOUNDARY)
    return "(?<![A-Za-z0-9_])" * begin + middle + "(?![A-Za-z0-9_])" * end


def alternation(sources: Iterable[str]) -> str:
    """One pattern for any of ``sources``, each between word boundaries."""
    inner = [s.removeprefix(r"\b").removesuffix(r"\b") for s in sources]
    return "(?<![A-Za-z0-9_])(?:" + "|".join(x.replace(r"\b", BOUNDARY) for x in inner) + ")(?![A-Za-z0-9_])"


def ascii_lower(text: Column) -> Column:
    """A-Z lower-cased, all else as it is: what (?i) makes no difference of."""
    return F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def _top_level(source: str, mark: str) -> list[str]:
    """Parts of ``source`` between the places of ``mark`` outside its groups."""
    parts, depth = [""], 0
    for c in source:
        depth += (c == "(") - (c == ")")
        parts = [*parts, ""] if c == mark and depth == 0 else [*parts[:-1], parts[-1] + c]
    return parts


def literals(source: str) -> list[str]:
    """Lower-case texts, one of which stands in every match of ``source``: a run of its letters or one from each alternative of a group.

    ``source`` is made of letters, hyphens, \\b, \\s, groups (?:...) and the marks ? + *. Of several choices the one whose
    shortest text is longest counts.
    """
    rest, groups = source, []
    while (at := rest.find("(?:")) >= 0:
        depth, end = 1, at + 3
        while depth:
            depth += (rest[end] == "(") - (rest[end] == ")")
            end += 1
        if rest[end : end + 1] not in ("?", "*"):
            groups.append([x for part in _top_level(rest[at + 3 : end - 1], "|") for x in literals(part)])
        rest = rest[:at] + " " + rest[end:].removeprefix("?").removeprefix("*")
    plain = re.sub(r"\\[bs][?+*]?|\[[^]]*\][?+*]?|[^ ][?*]", " ", rest)
    return max([[x.lower()] for x in plain.split()] + groups, key=lambda choice: min(map(len, choice)), default=[""])


def tokens(text: Column) -> Column:
    """Retrieval tokens in order: lower-cased runs of letters, digits and hyphens of two or more, without stop words."""
    found = F.regexp_extract_all(F.lower(text), F.lit(pattern(r"(\b[\p{L}\p{N}][\p{L}\p{N}-]{1,}\b)")), F.lit(1))
    return F.filter(found, lambda t: ~t.isin(STOP_WORDS))


def normalize_title(title: Column) -> Column:
    """Lower-cased letters, digits and single spaces."""
    kept = F.regexp_replace(F.lower(title), r"[^\p{L}\p{N}\s]", "")
    return F.trim(F.regexp_replace(kept, r"(?U)\s+", " "))


def normalize_claim(text: Column) -> Column:
    """Lower-cased ASCII letters and digits, all else a space."""
    return F.trim(F.regexp_replace(F.regexp_replace(F.lower(text), r"[^a-z0-9\s]", " "), r"\s+", " "))


def claim_tokens(text: Column) -> Column:
    """Distinct claim words of three or more letters."""
    return F.array_distinct(F.filter(F.split(normalize_claim(text), " "), lambda t: F.length(t) >= 3))


def bigrams(text: Column) -> Column:
    """Distinct pairs of neighbouring words."""
    words = F.split(text, " ")
    after = F.slice(words, F.lit(2), F.size(words))
    return F.array_distinct(F.zip_with(F.slice(words, F.lit(1), F.size(words) - 1), after, lambda a, b: F.concat_ws(" ", a, b)))


def jaccard(a: Column, b: Column) -> Column:
    """Jaccard similarity of two arrays of distinct values; 1 if both are empty."""
    shared = F.size(F.array_intersect(a, b))
    return F.when((F.size(a) == 0) & (F.size(b) == 0), 1.0).otherwise(shared / (F.size(a) + F.size(b) - shared))


def surname(name: Column) -> Column:
    """The last word of a name, lower-cased."""
    return F.lower(F.element_at(F.split(F.trim(name), r"\s+"), -1))


def authors_overlap(a: Column, b: Column) -> Column:
    """First or last surnames meet; false if either list is empty."""
    ends = lambda x: F.array(surname(F.element_at(x, 1)), surname(F.element_at(x, -1)))
    return (F.size(a) > 0) & (F.size(b) > 0) & F.arrays_overlap(ends(a), ends(b))


def years_close(a: Column, b: Column, most: int = 2) -> Column:
    """At most ``most`` years apart; an unknown year is close to any."""
    return F.coalesce(F.abs(a - b) <= most, F.lit(True))


def sentences(text: Column) -> Column:
    """Sentences with their marks; an unmarked rest counts if it is longer than 20."""
    whole = F.regexp_extract_all(text, F.lit(r"([^.!?]*+[.!?]++)"), F.lit(1))
    rest = F.regexp_replace(text, r"(?s)^.*[.!?]", "")
    return F.when(F.length(F.trim(rest)) > 20, F.array_append(whole, rest)).otherwise(whole)


def inverted_index(words: Column) -> Column:
    """Map of each word to its positions from 0, ascending, without empty words; made inside the row, in the time of one sort."""
    placed = F.filter(F.transform(words, lambda w, k: F.struct(w.alias("word"), k.alias("at"))), lambda x: x["word"] != "")

    def grouped(s: Column) -> Column:
        new = F.transform(s, lambda x, k: F.when((k == 0) | (F.get(s, k - 1)["word"] != x["word"]), k))
        return _let(F.array_append(F.array_compact(new), F.size(s)), lambda at: F.transform(F.sequence(F.lit(1), F.size(at) - 1), lambda j: run(s, F.get(at, j - 1), F.get(at, j))))

    def run(s: Column, begin: Column, end: Column) -> Column:
        return F.struct(F.get(s, begin)["word"].alias("word"), F.transform(F.sequence(begin, end - 1), lambda k: F.get(s, k)["at"]).alias("at"))

    return F.when(F.size(placed) > 0, F.map_from_entries(_let(F.sort_array(placed), grouped)))


def counts(words: Column) -> Column:
    """Array of struct(term, tf): how often each word occurs; made inside the row, in the time of one sort."""

    def grouped(s: Column) -> Column:
        new = F.transform(s, lambda x, k: F.when((k == 0) | (F.get(s, k - 1) != x), k))
        return _let(F.array_append(F.array_compact(new), F.size(s)), lambda at: F.transform(F.slice(at, F.lit(1), F.size(at) - 1), lambda k, j: F.struct(F.get(s, k).alias("term"), (F.get(at, j + 1) - k).cast("long").alias("tf"))))

    return _let(F.sort_array(words), grouped)


def _let(value: Column, then) -> Column:
    """``then`` of ``value``, which is computed once however often ``then`` names it."""
    return F.element_at(F.transform(F.array(value), then), 1)


def abstract_text(inverted: Column) -> Column:
    """Text of an inverted index (word to positions); missing positions are empty words."""
    placed = F.sort_array(F.flatten(F.transform(F.map_entries(inverted), lambda e: F.transform(e["value"], lambda p: F.struct(p.alias("at"), e["key"].alias("word"))))))
    gap = lambda s, x, k: x["at"] - F.when(k == 0, 0).otherwise(F.get(s, k - 1)["at"])
    return _let(placed, lambda s: F.array_join(F.transform(s, lambda x, k: F.concat(F.repeat(F.lit(" "), gap(s, x, k)), x["word"])), ""))


def content_hash(text: Column) -> Column:
    """First 16 hexadecimal digits of SHA-256."""
    return F.substring(F.sha2(text, 256), 1, 16)


def cache_key(*parts: Column) -> Column:
    """SHA-256 of the parts, joined by NUL."""
    return F.sha2(F.concat_ws("\0", *parts), 256)


def local_window(context: Column, marker: Column, radius: int = 200) -> Column:
    """``radius`` characters on both sides of the marker's first place; all of the context without it."""
    at = F.position(marker, context)
    first = F.greatest(at - radius, F.lit(1))
    size = at + F.length(marker) + radius - first
    return F.when(at > 0, F.substring(context, first, size)).otherwise(context)


def truncate_at_sentence(text: Column, budget: int = 600, extra: float = 0.2) -> Column:
    """At most about ``budget`` characters, cut after the last sentence mark within it, else the next one soon after, else hard.

    A mark counts if a space follows it or if it ends the two characters looked at.
    """
    # places count from 0; of any two neighbouring characters the second may be the mark, so a mark at m counts for m - 1, and
    # for m itself where a space or nothing follows: the last mark near the budget, or the first one beyond it, decides
    unmarked = lambda s: F.regexp_extract(s, "^[^.!?]*", 0)
    head = F.substring(text, 1, budget + 2)
    after = F.reverse(unmarked(F.reverse(head)))
    last = F.length(head) - F.length(after) - 1
    ends = last.between(0, budget) & ((after == "") | after.rlike(r"^(?:\s|[\u0085\u2028\u2029])"))
    back = F.when(ends, last + 1).when(last > 0, last)
    limit = F.least(F.lit(round(budget * (1 + extra))), F.length(text))
    tail = F.substring(text, F.lit(budget + 3), limit - budget - 1)
    free = F.length(unmarked(tail))
    ahead = F.when(free < F.length(tail), free + budget + 2)
    cut = F.coalesce(back, ahead, F.lit(budget))
    kept = F.rtrim(F.substring(text, F.lit(1), cut))
    out = F.when(F.length(kept) < F.length(text), F.concat(kept, F.lit(" ..."))).otherwise(kept)
    return F.when(F.length(text) <= budget, text).otherwise(out)


def json_from_answer(text: Column) -> Column:
    """The JSON that an answer holds: in a fence, between braces, between brackets, or all of it; null if none parses."""
    tries = [F.regexp_extract(text, r"(?s)```(?:json)?\s*(.*?)```", 1), F.regexp_extract(text, r"(?s)(\{.*\})", 1), F.regexp_extract(text, r"(?s)(\[.*\])", 1), text]
    return F.coalesce(*[F.when(F.try_parse_json(F.nullif(F.trim(t), F.lit(""))).isNotNull(), F.trim(t)) for t in tries])


def variant_from_answer(text: Column) -> Column:
    """The VARIANT of the JSON that ``json_from_answer`` finds, parsed once and looked for only where its marks stand."""
    tries = [("```", r"(?s)```(?:json)?\s*(.*?)```"), ("{", r"(?s)(\{.*\})"), ("[", r"(?s)(\[.*\])")]
    found = [F.when(F.contains(text, F.lit(mark)), F.try_parse_json(F.trim(F.regexp_extract(text, source, 1)))) for mark, source in tries]
    return F.coalesce(*found, F.when(F.trim(text) != "", F.try_parse_json(F.trim(text))))


def reference_label(authors: Column, year: Column) -> Column:
    """A reference's label: one surname, two with "and", or the first with "et al.", and the year."""
    names = (
        F.when(F.size(authors) == 0, F.lit(None).cast("string"))
        .when(F.size(authors) == 1, authors[0])
        .when(F.size(authors) == 2, F.concat_ws(" and ", authors))
        .otherwise(F.concat(authors[0], F.lit(" et al.")))
    )
    return F.concat_ws(", ", names, year.cast("string"))
