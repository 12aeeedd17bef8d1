"""Toxicity by a weighted lexicon, matched with an Aho-Corasick automaton on folded text."""

from __future__ import annotations

import re
import unicodedata
from bisect import bisect_left
from collections import defaultdict
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .quality import _sample
from .store import discard, keep

# Letters of other scripts that look like Latin ones, and digits used for letters.
HOMOGLYPHS = dict(zip("аеорсухівкмнтѕјԁɡӏαεορτυνκιχ", "aeopcyxibkmhtsjdglaeoptuvkix", strict=True))
DIGITS = dict(zip("013457@$", "oleastas", strict=True))
#: Phrases in which a lexicon term is harmless.
EXCEPTIONS = ("trash can", "trash bin", "trash bag", "pond scum")

_SUBSTITUTED = re.compile(r"(?<=[^\W\d_])[013457@$]|[013457@$](?=[^\W\d_])")
#: Runs in which 1, ! and | are read as i or as l: those before a letter, and 1 and | after one (a final ! ends a sentence).
_UNSURE = re.compile(r"(?<![013457@$!|])[013457@$!|]++(?=[^\W\d_])|(?<=[^\W\d_])[1|]++")

_BYTES = bytes(ord(c.lower()) if (c := chr(k)).isalpha() and len(c.lower()) == 1 and ord(c.lower()) < 256 else 32 for k in range(256))
_WIDE = {ord(k): v for k, v in HOMOGLYPHS.items()} | {ord(k.upper()): v for k, v in HOMOGLYPHS.items() if len(k.upper()) == 1}
_WIDE |= {c: base for c in range(256, 592) if (base := unicodedata.normalize("NFD", chr(c).lower())[0]).isascii()}


def _latin(text: str) -> str:
    return text if text.isascii() else unicodedata.normalize("NFC", text).translate(_WIDE)


def fold(text: str, unsure: str | None = None) -> str:
    """``text`` in lower-case Latin letters and spaces, between two spaces.

    Homoglyphs of other scripts and digits that touch letters become the letters they stand for; all else a space.
    unsure: the letter for 1, ! and | inside words; without it 1 is l and the others are spaces.
    """
    text = _latin(text)
    if unsure:
        text = _UNSURE.sub(lambda m: re.sub("[1!|]", unsure, m.group()), text)
    text = _SUBSTITUTED.sub(lambda m: DIGITS[m.group()], text)
    return " " + text.encode("latin-1", "replace").translate(_BYTES).decode("latin-1") + " "


def _blur(folded: str) -> str:
    """i and l as one letter."""
    return folded.replace("i", "l")


def _terms(folded: str, prefixes: range) -> set[str]:
    """Candidate terms: whole words, and word beginnings, each marked by the spaces around it."""
    out = set()
    for word in set(folded.split()):
        if len(word) >= 3:
            out.add(f" {word} ")
        out.update(f" {word[:k]}" for k in prefixes if len(word) > k)
    return out


@dataclass
class Lexicon:
    """weights: of terms (a leading space is a word's begin, a final one its end); score = sigmoid(bias + slope * hits / length)."""

    weights: dict[str, float]
    exceptions: tuple[str, ...] = EXCEPTIONS
    bias: float = -4.0
    slope: float = 1.0
    _machine: object = field(default=None, repr=False, compare=False)
    _blurred: object = field(default=None, repr=False, compare=False)

    def __getstate__(self) -> dict:
        return self.__dict__ | {"_machine": None, "_blurred": None}

    @property
    def machine(self):
        if self._machine is None:
            import ahocorasick

            self._machine = ahocorasick.Automaton()
            for term, weight in self.weights.items():
                self._machine.add_word(term, (len(term), weight))
            for phrase in self.exceptions:
                self._machine.add_word(fold(phrase), (len(fold(phrase)), None))
            if len(self._machine):
                self._machine.make_automaton()
        return self._machine

    @property
    def blurred(self):
        """The machine for text in which i and l are one letter."""
        if self._blurred is None:
            import ahocorasick

            terms: dict[str, float | None] = {}
            for term, weight in self.weights.items():
                terms[_blur(term)] = max(weight, terms.get(_blur(term), weight))
            terms |= {_blur(fold(phrase)): None for phrase in self.exceptions}
            self._blurred = ahocorasick.Automaton()
            for term, weight in terms.items():
                self._blurred.add_word(term, (len(term), weight))
            if len(self._blurred):
                self._blurred.make_automaton()
        return self._blurred

    def hits(self, folded: str, text: str = "") -> dict[int, float]:
        """Weight of the heaviest term at each word that has one and does not stand in an exception phrase.

        With ``text``, of which ``folded`` is the folded form, signs that may be i or l are read as each.
        """
        if not len(self.machine):
            return {}
        found: dict[int, float] = {}
        spared: list[tuple[int, int]] = []
        for end, (size, weight) in self.machine.iter(folded):
            start = end - size + 1
            if weight is None:
                spared.append((start, end))
            else:
                found[start] = max(weight, found.get(start, 0.0))
        signs = [m.start() + k + 1 for m in _UNSURE.finditer(_latin(text)) for k, c in enumerate(m.group()) if c in "1!|"] if any(c in text for c in "1!|") else []
        if signs:
            for end, (size, weight) in self.blurred.iter(_blur(fold(text, "l"))):
                start = end - size + 1
                at = bisect_left(signs, start)
                if at == len(signs) or signs[at] > end:
                    continue
                if weight is None:
                    spared.append((start, end))
                else:
                    found[start] = max(weight, found.get(start, 0.0))
        for a, b in spared:
            for k in [k for k in found if a <= k < b]:
                del found[k]
        return found

    def strength(self, text: str | None) -> float:
        """Total weight of the hits over the logarithm of the length."""
        if not text:
            return 0.0
        total = sum(self.hits(fold(text), text).values())
        return total / (1 + np.log2(1 + len(text) / 400)) if total else 0.0


def learn(docs: DataFrame, labels: DataFrame, most: int = 20_000, prefixes: range = range(4, 9), precision: float = 0.7, support: int = 3, cover: int = 3) -> Lexicon:
    """Lexicon from labelled texts: a bounded sample of at most about ``most`` rows (a bound of the fit alone).

    Spark counts in how many toxic and other texts each word and word beginning stands. Of those that
    are mostly in toxic ones, the lexicon takes the one that explains most texts not yet explained
    ``cover`` times, and so on: words that merely surround toxic ones add little and stay out.
    """
    chosen = _sample(labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("toxic").cast("int").alias("toxic")).where("doc_id is not null and toxic is not null").dropDuplicates(["doc_id"]), most)
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).where("text is not null")

    def spell(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in frames:
            yield pd.DataFrame({"toxic": pdf["toxic"], "terms": [sorted(_terms(fold(t), prefixes) | (_terms(fold(t, "i"), prefixes) if _UNSURE.search(_latin(t)) else set())) for t in pdf["text"]]})

    spelt = keep(texts.join(F.broadcast(chosen), "doc_id").dropDuplicates(["text"]).mapInPandas(spell, "toxic int, terms array<string>"))
    counted = spelt.select("toxic", F.explode("terms").alias("term")).groupBy("term").agg(F.sum("toxic").alias("t"), F.count("*").alias("n"))
    base = spelt.agg(F.sum("toxic"), F.count("*")).first()
    toxic, total = int(base[0] or 0), int(base[1] or 0)
    kept = counted.where((F.col("t") >= support) & (F.col("t") >= precision * F.col("n"))).orderBy(F.desc("t"), "term").collect()  # of the sample alone
    stats = {r["term"]: (r["t"], r["n"]) for r in kept}
    rows = [[t for t in r["terms"] if t in stats] for r in spelt.where("toxic = 1").select("terms").toLocalIterator()] if stats else []
    discard(spelt)
    covers: dict[str, set[int]] = defaultdict(set)
    for k, terms in enumerate(rows):
        for t in terms:
            covers[t].add(k)
    weights: dict[str, float] = {}
    left = {t: len(ks) for t, ks in covers.items()}
    times = [0] * len(rows)
    gain = lambda t: left[t] - 1.5 * (stats[t][1] - stats[t][0])  # noqa: E731  texts explained, against others hit
    while left:
        best = max(left, key=lambda t: (gain(t), len(t), t))
        if gain(best) < support:
            break
        t, n = stats[best]
        weights[best] = float(np.log((t + 0.5) / (n - t + 0.5)) + np.log((total - toxic + 1) / (toxic + 1)))
        for k in covers[best]:
            times[k] += 1
            if times[k] == cover:
                for other in rows[k]:
                    if other in left:
                        left[other] -= 1
        stem = best.strip()
        same = lambda t: t.strip().startswith(stem) or (stem.startswith(t.strip()) and len(covers[t]) <= 1.1 * len(covers[best]))
        left = {t: n for t, n in left.items() if not same(t)}
        left = {t: n for t, n in left.items() if n >= support}
    return Lexicon(weights)


def _calibrate(lexicon: Lexicon, strength: np.ndarray, toxic: np.ndarray) -> None:
    """Logistic regression of the label on the strength, with a small ridge, by Newton steps."""
    x = np.column_stack([np.ones(len(strength)), strength])
    w = np.array([-2.0, 1.0])
    for _ in range(25):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        h = x.T @ (x * (p * (1 - p))[:, None]) + 0.5 * np.eye(2)
        w += np.clip(np.linalg.solve(h, x.T @ (toxic - p) - 0.5 * (w - [-2.0, 1.0])), -2, 2)
    lexicon.bias, lexicon.slope = float(w[0]), float(max(w[1], 0.05))


def strengths(docs: DataFrame, lexicon: Lexicon) -> DataFrame:
    """(doc_id, strength) of the whole text of each row."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in frames:
            yield pd.DataFrame({"doc_id": pdf["doc_id"].astype("Int64"), "strength": [lexicon.strength(t) for t in pdf["text"]]})

    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return docs.mapInPandas(run, "doc_id long, strength double")


def score_toxicity(docs: DataFrame, labels: DataFrame, usable: Column | None = None, most: int = 20_000) -> DataFrame:
    """(doc_id, score): how likely the whole text of each row of ``docs`` is toxic.

    Lexicon and calibration are fitted on a sample of about ``most`` rows of ``labels`` (doc_id,
    toxic) for which ``usable`` holds. The score uses the text alone.

    Defined cases: null and empty texts have strength 0; without labels the lexicon is empty and all
    scores are the same and low; a null doc_id is scored; repeated rows are each scored; other columns
    are ignored; an empty table gives an empty table.
    """
    usable_labels = labels.where(usable) if usable is not None else labels
    lexicon = learn(docs, usable_labels, most)
    told = _sample(usable_labels.select(F.col("doc_id").cast("long").alias("doc_id"), "toxic").where("doc_id is not null and toxic is not null").dropDuplicates(["doc_id"]), most)
    sample = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").join(F.broadcast(told), "doc_id")
    fit = strengths(sample, lexicon).join(told, "doc_id").select("strength", "toxic").toPandas()
    if len(fit):
        _calibrate(lexicon, fit["strength"].to_numpy(float), fit["toxic"].to_numpy(float))
    return strengths(docs, lexicon).select("doc_id", (1 / (1 + F.exp(-(F.lit(lexicon.bias) + F.lit(lexicon.slope) * F.col("strength"))))).alias("score"))


def held_out_toxicity(docs: DataFrame, labels: DataFrame, threshold: float = 0.3) -> DataFrame:
    """(doc_id, held_out, score, predicted): labels of rows with crc32(doc_id) mod 4 = 2 are never used."""
    held = F.pmod(F.crc32(F.col("doc_id").cast("string").cast("binary")), F.lit(4)) == 2
    scored = score_toxicity(docs, labels, ~held)
    return scored.select("doc_id", F.coalesce(held, F.lit(False)).alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))
