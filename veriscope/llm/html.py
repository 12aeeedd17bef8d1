"""Main text of HTML pages by line-block distribution."""

from __future__ import annotations

import html as entities
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

_TAG = re.compile(r"""<!--.*?(?:-->|\Z)|<!\[CDATA\[(?P<cdata>.*?)(?:\]\]>|\Z)|<[!?][^>]*(?:>|\Z)|<(?P<close>/?)(?P<name>[a-zA-Z][a-zA-Z0-9:-]*)(?P<attrs>(?:[^<>"']++|"[^"]*"|'[^']*')*+)(?:>|(?=<)|\Z)""", re.S)
_ATTR = re.compile(r"""([a-zA-Z_:-]+)\s*=\s*("[^"]*"|'[^']*'|[^\s"'>]+)""")
_SPACE = re.compile(r"\s+")

# Element names by their part in a page.
RAW = frozenset("script style noscript template textarea title svg math iframe object canvas".split())
CHROME = frozenset("nav header footer aside form menu dialog button select datalist head".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
INLINE = frozenset("a abbr acronym b bdi bdo big br cite code data del dfn em font i img ins kbd label mark q s samp small span strike strong sub sup td th time tt u var wbr".split())
CONTENT = frozenset("article main".split())
#: Words in the class, id or role of an element that make it page furniture.
FURNITURE = re.compile(
    r"(?:^|[\s_-])(?:ad|ads|advert\w*|banner|sponsor\w*|promo\w*|cookies?|consent|gdpr|notices?|alert|newsletter|subscri\w*|popup|modal|overlay|sidebar|widgets?|related|recommend\w*|share|sharing|social|"
    r"breadcrumbs?|menu|nav|navbar|navigation|topbar|toolbar|footer|header|masthead|comments?|disqus|repl(?:y|ies)|respond|pagination|pager|login|signup|search|copyright|legal|disclaimer|complementary|contentinfo|skip)(?=$|[\s_-])",
    re.I,
)


@dataclass
class Line:
    """A block's text; linked is how many of its characters are links, inside says that an article holds it."""

    text: str
    linked: int
    inside: bool


def lines(page: str) -> list[Line]:
    """The blocks of a page in order, those of page furniture as empty lines.

    Markup goes: comments, raw elements, tags; character references are decoded; white space in a
    block becomes one space. Unclosed elements end with the element around them, and an open
    paragraph at the next block.
    """
    out: list[Line] = []
    stack: list[tuple[str, bool, bool]] = []  # name, furniture at or above it, article at or above it
    open_names: Counter[str] = Counter()  # of the stack, so that a stray end tag costs no look through it
    blocks: list[int] = []  # places in the stack of what is not inline
    parts: list[str] = []
    linked = links = 0

    def flush() -> None:
        nonlocal linked
        text = _SPACE.sub(" ", "".join(parts)).strip()
        parts.clear()
        if text:
            hidden, inside = (stack[-1][1], stack[-1][2]) if stack else (False, False)
            out.append(Line("" if hidden else text, linked, inside))
        linked = 0

    def say(raw: str) -> None:
        nonlocal linked
        if raw:
            text = entities.unescape(raw)
            parts.append(text)
            if links:
                linked += len(text.strip())

    def leave(depth: int) -> None:
        nonlocal links
        if blocks and blocks[-1] >= depth:
            flush()
        while len(stack) > depth:
            name = stack.pop()[0]
            open_names[name] -= 1
            links -= name == "a"
        while blocks and blocks[-1] >= depth:
            blocks.pop()

    at = 0
    while tag := _TAG.search(page, at):
        say(page[at : tag.start()])
        at = tag.end()
        if tag["cdata"] is not None:
            say(tag["cdata"])
        if not tag["name"]:
            continue
        name = tag["name"].lower()
        if name in VOID:
            if name in INLINE:
                parts.append(" ")
            else:
                flush()
            continue
        if tag["close"]:
            if open_names[name]:
                leave(next(k for k in range(len(stack) - 1, -1, -1) if stack[k][0] == name))
            elif name not in INLINE:
                flush()
            if name in ("td", "th"):
                parts.append(" ")
            continue
        if name in RAW:
            if not tag["attrs"].rstrip().endswith("/"):
                end = re.compile(rf"</{name}\b[^>]*(?:>|\Z)", re.I).search(page, at)
                at = end.end() if end else len(page)
            continue
        if name not in INLINE:
            flush()
            if blocks and stack[blocks[-1]][0] == "p":
                leave(blocks[-1])
            elif name in ("li", "dt", "dd", "tr", "option") and stack and stack[-1][0] == name:
                leave(len(stack) - 1)
        hidden, inside = (stack[-1][1], stack[-1][2]) if stack else (False, False)
        if name not in ("html", "body") and not hidden:
            marks = " ".join(v.strip("\"'") for k, v in _ATTR.findall(tag["attrs"]) if k.lower() in ("class", "id", "role"))
            hidden = name in CHROME or bool(FURNITURE.search(marks)) or bool(re.search(r"(?:^|\s)hidden(?:\s|=|$)|display:\s*none", tag["attrs"], re.I))
        if name not in INLINE:
            blocks.append(len(stack))
        open_names[name] += 1
        stack.append((name, hidden, inside or name in CONTENT))
        links += name == "a"
    say(page[at:])
    flush()
    return out


def surges(weights: list[int], window: int, least: int) -> list[tuple[int, int]]:
    """Stretches [surge, dive) of lines, from where the sum of a sliding window rises over ``least`` to where it falls to 0."""
    n = len(weights)
    sums, total = [0] * n, 0
    for k in range(n - 1, -1, -1):
        total += weights[k] - (weights[k + window] if k + window < n else 0)
        sums[k] = total
    least = min(least, max(sums, default=0))
    found, k = [], 0
    while k < n:
        if sums[k] >= max(least, 1) or (weights[k] and weights[k] >= least):
            end = k
            while end < n and sums[end]:
                end += 1
            start = k
            while start and weights[start - 1]:  # short lines that touch the surge belong to it
                start -= 1
            while not weights[start]:
                start += 1
            last = end
            while not weights[last - 1]:
                last -= 1
            found.append((start, last))
            k = end
        else:
            k += 1
    return found


def main_text(page: str | None, window: int = 3, least: int = 40, share: float = 0.3, enough: int = 200) -> str:
    """The article of a page: its blocks joined by newlines, without page furniture.

    A line weighs its characters outside links; furniture weighs nothing, nor does what stands outside the article
    elements of a page that has some. What stays are the lines between surges and dives of the sums over ``window``
    lines, those of no weight between them too: short or linked lines amid text stay, runs of linked lines at its edges
    or of a window's length within it go. In an article element any weight is a surge and all
    stretches stay; elsewhere a surge takes ``least`` characters, and stretches of ``share`` of the heaviest's weight or
    of ``enough`` characters stay.
    """
    if not page:
        return ""
    found = lines(page)
    article = any(x.inside and x.text for x in found)
    weights = [0 if article and not x.inside else max(0, len(x.text) - x.linked) for x in found]
    if not any(weights):  # all that there is are links
        weights = [0 if article and not x.inside else len(x.text) for x in found]
    stretches = surges(weights, window, 1 if article else least)
    heaviest = max((sum(weights[a:b]) for a, b in stretches), default=0)
    kept = [(a, b) for a, b in stretches if article or sum(weights[a:b]) >= min(share * heaviest, enough)]
    return "\n".join(x.text for a, b in kept for x in found[a:b] if x.text and (x.inside or not article))


def extract_main_text(pages: DataFrame, column: str = "html", **options) -> DataFrame:
    """``pages`` with text and n_chars (code points) of each page's article; columns of these names are replaced.

    A page is read in time linear in its length. Defined cases: null, empty or text-free html gives an empty text; markup that never closes ends
    with the page, however long it is; repeated rows each give their row; other columns pass unchanged; an empty table
    gives an empty table.
    """

    @F.pandas_udf("string")
    def text(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for batch in batches:
            yield batch.map(lambda page: main_text(page, **options))

    out = pages.withColumn("text", text(F.col(column).cast("string")))
    return out.withColumn("n_chars", F.length("text").cast("long"))
