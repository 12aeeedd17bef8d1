"""Papers as XML or plain text into blocks, references and mentions."""

from __future__ import annotations

import re
import xml.etree.ElementTree as ET
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

BLOCKS = "paper_id long, ord int, kind string, section string, text string"
REFERENCES = "paper_id long, ord int, ref_id string, doi string, title string, surnames array<string>, year int"
MENTIONS = "paper_id long, ord int, ref_id string, marker string, section string, context string"
LEAST = 30


def _name(e: ET.Element) -> str:
    return e.tag.rpartition("}")[2] if isinstance(e.tag, str) else ""


def _text(e: ET.Element | None) -> str:
    return re.sub(r"\s+", " ", "".join(e.itertext())).strip() if e is not None else ""


def _all(e: ET.Element, name: str) -> Iterator[ET.Element]:
    return (x for x in e.iter() if _name(x) == name)


def _first(e: ET.Element, name: str) -> ET.Element | None:
    return next(_all(e, name), None)


def _year(text: str) -> int | None:
    found = re.search(r"(?<!\d)(?:19|20)\d{2}(?!\d)", text)
    return int(found.group()) if found else None


class Paper:
    """Blocks (kind, section, text), references and mentions of one parsed document.

    Two dialects share the walk: sections nest and pass their title down, captions are blocks of
    their own, and each mention is a cross-reference inside a paragraph.
    """

    def __init__(self, root: ET.Element) -> None:
        self.blocks: list[tuple[str, str | None, str]] = []
        self.references: list[tuple[str, str | None, str | None, list[str], int | None]] = []
        self.mentions: list[tuple[str, str, str | None, str]] = []
        tei = _name(root) == "TEI" or _first(root, "listBibl") is not None
        for part in _all(root, "abstract"):
            for p in list(_all(part, "p")) or [part]:
                self._block("abstract", None, p)
        body = _first(root, "body")
        if body is not None:
            self._walk(body, None, tei)
        for number, e in enumerate(_all(root, "biblStruct") if tei else _all(root, "ref")):
            if tei and not any(e in list(_all(x, "biblStruct")) for x in _all(root, "listBibl")):
                continue
            self._reference(e, tei, number)

    def _block(self, kind: str, section: str | None, e: ET.Element) -> None:
        text = _text(e)
        if len(text) >= LEAST:
            self.blocks.append((kind, section, text))

    def _walk(self, e: ET.Element, section: str | None, tei: bool) -> None:
        for child in e:
            name = _name(child)
            if name in ("sec", "div"):
                head = next((x for x in child if _name(x) in ("title", "head")), None)
                self._walk(child, _text(head) or section, tei)
            elif name == "p":
                self._block("body", section, child)
                self._mention(child, section, tei)
            elif name in ("fig", "table-wrap", "figure"):
                table = name == "table-wrap" or child.get("type") == "table"
                caption = _first(child, "caption") if not tei else (_first(child, "figDesc") if _first(child, "figDesc") is not None else child)
                if caption is not None:
                    self._block("table_caption" if table else "figure_caption", section, caption)
            else:
                self._walk(child, section, tei)

    def _mention(self, p: ET.Element, section: str | None, tei: bool) -> None:
        for x in _all(p, "ref" if tei else "xref"):
            if (x.get("type") if tei else x.get("ref-type")) == ("bibr" if tei else "bibr"):
                target = (x.get("target") or "").lstrip("#") if tei else x.get("rid")
                if target:
                    self.mentions.append((target, _text(x), section, _text(p)))

    def _reference(self, e: ET.Element, tei: bool, number: int) -> None:
        ident = e.get("{http://www.w3.org/XML/1998/namespace}id") or e.get("id") or f"ref-{number}"
        if tei:
            doi = next((_text(x) for x in _all(e, "idno") if (x.get("type") or "").upper() == "DOI"), None)
            date = _first(e, "date")
            title, year = _text(_first(e, "title")), _year((date.get("when") or _text(date)) if date is not None else "")
        else:
            doi = next((_text(x) for x in _all(e, "pub-id") if x.get("pub-id-type") == "doi"), None)
            title, year = _text(_first(e, "article-title")), _year(_text(_first(e, "year")))
        self.references.append((ident, doi, title or None, [_text(x) for x in _all(e, "surname")], year))


def parse(text: str | None) -> Paper | None:
    """A parsed XML document; None where it is no XML."""
    try:
        return Paper(ET.fromstring(text)) if text and text.lstrip().startswith("<") else None
    except ET.ParseError:
        return None


def _table(documents: DataFrame, schema: str, rows) -> DataFrame:
    names = [x.strip().split()[0] for x in schema.split(", ")]

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in frames:
            out = [(pid, k, *row) for pid, text in zip(pdf["paper_id"], pdf["content"], strict=True) if (p := parse(text)) for k, row in enumerate(rows(p))]
            yield pd.DataFrame(out, columns=names)

    return documents.select("paper_id", "content").mapInPandas(run, schema)


def blocks(documents: DataFrame) -> DataFrame:
    """Blocks of documents (paper_id, content): XML by its elements, plain text by its paragraphs, of 30 characters or more."""
    marked = _table(documents, BLOCKS, lambda p: p.blocks)
    plain = documents.where(~F.startswith(F.ltrim("content"), F.lit("<"))).select(F.col("paper_id").cast("long").alias("paper_id"), F.posexplode(F.split("content", r"\n{2,}")).alias("ord", "raw"))
    text = F.trim(F.regexp_replace("raw", r"\s+", " "))
    return marked.unionByName(plain.select("paper_id", "ord", F.lit("body").alias("kind"), F.lit(None).cast("string").alias("section"), text.alias("text")).where(F.length("text") >= LEAST))


def references(documents: DataFrame) -> DataFrame:
    return _table(documents, REFERENCES, lambda p: p.references)


def mentions(documents: DataFrame) -> DataFrame:
    return _table(documents, MENTIONS, lambda p: p.mentions)
