"""Periodic runs of words: stretches that repeat the same words at a fixed distance.

Harmonic grid: a stretch of at least three periods p covers two neighbouring points jp and (j + 1)p of the grid of
p, so for each p the common extensions of these pairs, forward and backward, give all such stretches. Extensions are
range minima over the longest common prefixes of a suffix array, of the words and of the words in reverse.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Words whose suffixes are sorted at once; a longer text is sorted alone.
BATCH = 1 << 17
_BLOCK = 16

Run = tuple[int, int, int]


def _dense(codes: np.ndarray) -> np.ndarray:
    """For each code the number of smaller ones in the array."""
    order = np.argsort(codes, kind="stable")
    ranked = codes[order]
    first = np.concatenate([[True], ranked[1:] != ranked[:-1]])
    out = np.empty(len(codes), np.int64)
    out[order] = np.maximum.accumulate(np.where(first, np.arange(len(codes)), 0))
    return out


class Extensions:
    """Longest common extensions of pairs of places of one array of codes."""

    def __init__(self, codes: np.ndarray) -> None:
        self.n = len(codes)
        levels = self._sort(codes)
        self.rank = levels[-1]
        places = np.empty(self.n, np.int64)
        places[self.rank] = np.arange(self.n)
        self._minima(self._neighbours(levels, places))

    def _sort(self, codes: np.ndarray) -> list[np.ndarray]:
        """Ranks by the first 1, 2, 4, ... codes, until all differ. Only suffixes that still tie are sorted again."""
        rank = _dense(codes)
        levels = [rank.astype(np.int32)]
        open_ = np.flatnonzero(np.bincount(rank, minlength=self.n)[rank] > 1)
        step = 1
        while len(open_):
            ahead = open_ + step
            after = np.where(ahead < self.n, rank[np.minimum(ahead, self.n - 1)] + 1, 0)
            key = rank[open_] * np.int64(self.n + 1) + after
            order = np.argsort(key)
            key, open_ = key[order], open_[order]
            at = np.arange(len(open_))
            group = rank[open_]
            new_group = np.concatenate([[True], group[1:] != group[:-1]])
            new_key = np.concatenate([[True], key[1:] != key[:-1]])
            rank = rank.copy()
            rank[open_] = group + np.maximum.accumulate(np.where(new_key, at, 0)) - np.maximum.accumulate(np.where(new_group, at, 0))
            levels.append(rank.astype(np.int32))
            single = new_key & np.concatenate([new_key[1:], [True]])
            open_ = open_[~single]
            step *= 2
        return levels

    def _neighbours(self, levels: list[np.ndarray], places: np.ndarray) -> np.ndarray:
        """Common prefix of each suffix and the one before it in sorted order, from the ranks, long steps first."""
        common = np.zeros(self.n, np.int64)
        pair = np.arange(1, self.n)
        for k in range(len(levels) - 2, -1, -1):  # ranks of the last level all differ
            a, b = places[pair - 1] + common[pair], places[pair] + common[pair]
            inside = (a < self.n) & (b < self.n)
            same = np.zeros(len(pair), bool)
            same[inside] = levels[k][a[inside]] == levels[k][b[inside]]
            common[pair[same]] += 1 << k
        return common.astype(np.int32)

    def _minima(self, common: np.ndarray) -> None:
        """Minima of the first and last part of each block and, at distances of powers of two, over whole blocks."""
        blocks = -(-self.n // _BLOCK)
        padded = np.full(blocks * _BLOCK, np.iinfo(np.int32).max, np.int32)
        padded[: self.n] = common
        square = padded.reshape(blocks, _BLOCK)
        self.common = padded
        self.up_to = np.minimum.accumulate(square, axis=1).ravel()
        self.onward = np.minimum.accumulate(square[:, ::-1], axis=1)[:, ::-1].ravel()
        self.table = [square.min(axis=1)]
        while 2 << (len(self.table) - 1) <= blocks:
            last, half = self.table[-1], 1 << (len(self.table) - 1)
            self.table.append(np.minimum(last[: len(last) - half], last[half:]))

    def _least(self, lo: np.ndarray, hi: np.ndarray) -> np.ndarray:
        """Minimum of common[lo..hi] for each pair, lo <= hi."""
        first, last = lo // _BLOCK, hi // _BLOCK
        out = np.minimum(self.onward[lo], self.up_to[hi])
        near = np.flatnonzero(first == last)
        if len(near):
            cells = lo[near, None] + np.arange(_BLOCK)
            out[near] = np.where(cells <= hi[near, None], self.common[np.minimum(cells, len(self.common) - 1)], np.iinfo(np.int32).max).min(axis=1)
        far = np.flatnonzero(last - first > 1)
        if len(far):
            a, b = first[far] + 1, last[far]
            level = np.frexp(b - a)[1] - 1
            for k in np.unique(level):
                own = level == k
                at = far[own]
                out[at] = np.minimum(out[at], np.minimum(self.table[k][a[own]], self.table[k][b[own] - (1 << int(k))]))
        return out

    def of(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """How many codes from a and from b on are the same; a and b differ, and n has no code."""
        out = np.zeros(len(a), np.int64)
        inside = np.flatnonzero((a < self.n) & (b < self.n))
        if len(inside):
            x, y = self.rank[a[inside]].astype(np.int64), self.rank[b[inside]].astype(np.int64)
            out[inside] = self._least(np.minimum(x, y) + 1, np.maximum(x, y))
        return out


def runs_of(codes: np.ndarray, bounds: np.ndarray, least: int, times: int) -> list[np.ndarray]:
    """Runs (start, length, period) of each row, by start, then period; row k holds codes[bounds[k]:bounds[k + 1]].

    ``codes`` are not negative. Rows are held apart by codes of their own, so that no extension leaves a row.
    """
    rows = len(bounds) - 1
    size = np.diff(bounds)
    at = bounds[:-1] + np.arange(rows)  # where a row begins, a mark behind each row
    text = np.empty(int(bounds[-1]) + rows, np.int64)
    text[at + size] = codes.max(initial=0) + 1 + np.arange(rows)
    inner = np.ones(len(text), bool)
    inner[at + size] = False
    text[inner] = codes
    forward, backward = Extensions(text), Extensions(text[::-1])
    n = len(text)
    found = [np.zeros((0, 3), np.int64)]
    for p in range(1, int(size.max(initial=0)) // times + 1):
        near = np.flatnonzero(text[: n - p : p] == text[p::p]) * p  # other pairs of the grid extend by nothing
        if not len(near):
            continue
        ahead = forward.of(near, near + p)
        near, ahead = near[ahead >= (times - 2) * p], ahead[ahead >= (times - 2) * p]  # the first grid point of a run sees as much
        if not len(near):
            continue
        back = backward.of(n - near, n - near - p)
        length = ahead + back + p
        enough = length >= max(least, times * p)
        start = near[enough] - back[enough]
        found.append(np.stack([start, length[enough], np.full(len(start), p)], axis=1))
    all_runs = np.concatenate(found)
    order = np.lexsort((all_runs[:, 2], all_runs[:, 1], all_runs[:, 0]))
    all_runs = all_runs[order]
    # a stretch found under multiples of its period, or at several grid points, counts once, under the least period
    keep = np.concatenate([[True], (all_runs[1:, :2] != all_runs[:-1, :2]).any(axis=1)]) if len(all_runs) else np.zeros(0, bool)
    all_runs = all_runs[keep]
    row = np.searchsorted(at, all_runs[:, 0], "right") - 1
    all_runs[:, 0] -= at[row]
    all_runs = all_runs[np.lexsort((all_runs[:, 2], all_runs[:, 0], row))]
    return np.split(all_runs, np.searchsorted(np.sort(row), np.arange(1, rows)))


def kept_words(n: int, runs: np.ndarray) -> np.ndarray:
    """Flags of the words that stay: those outside every run, and the first period of each run where no other run has them."""
    edge = np.zeros(n + 1, np.int64)
    np.add.at(edge, runs[:, 0] + runs[:, 2], 1)
    np.add.at(edge, runs[:, 0] + runs[:, 1], -1)
    return np.cumsum(edge)[:n] == 0


def _best(runs: np.ndarray) -> Run | None:
    """The run of most repeats; ties go to the smallest start, then period. Quotients of numbers below 2**26 differ as doubles where they differ."""
    if not len(runs):
        return None
    return tuple(int(x) for x in runs[np.lexsort((runs[:, 2], runs[:, 0], -(runs[:, 1] / runs[:, 2])))[0]])


def _made(rows: list[tuple[object, list[bytes]]], least: int, times: int) -> pd.DataFrame:
    """Output rows for (doc_id, words) rows whose suffixes are sorted together."""
    known: dict[bytes, int] = {}
    bounds = np.cumsum([0, *[len(w) for _, w in rows]])
    codes = np.fromiter((known.setdefault(w, len(known)) for _, words in rows for w in words), np.int64, int(bounds[-1]))
    out = []
    for (doc_id, words), runs in zip(rows, runs_of(codes, bounds, least, times), strict=True):
        left = words if not len(runs) else [words[k] for k in np.flatnonzero(kept_words(len(words), runs))]
        made = [dict(zip(("start", "length", "period"), map(int, r), strict=True)) for r in runs]
        best = _best(runs)
        out.append((doc_id, len(words), made, None if best is None else dict(zip(("start", "length", "period"), best, strict=True)), b" ".join(left).decode()))
    return pd.DataFrame(out, columns=["doc_id", "n_words", "runs", "best", "collapsed"])


_RUN = "struct<start: bigint, length: bigint, period: bigint>"
_SCHEMA = f"doc_id bigint, n_words bigint, runs array<{_RUN}>, best {_RUN}, collapsed string"
_ARROW_RUN = pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())])
_ARROW = pa.schema([("doc_id", pa.int64()), ("n_words", pa.int64()), ("runs", pa.list_(_ARROW_RUN)), ("best", _ARROW_RUN), ("collapsed", pa.string())])


def periodic_runs(docs: DataFrame, least: int = 24, times: int = 3) -> DataFrame:
    """(doc_id, n_words, runs, best, collapsed) of each whole ``text`` of ``docs``.

    Words are what stands between ASCII white space, case kept, numbered from 0. A run is a stretch of consecutive
    words with smallest period q and at least max(least, times * q) words that cannot be extended keeping q; ``runs``
    has all of them as (start, length, period) by start, then period, ``best`` the one of most repeats (length / period,
    then least start, then least period; null without runs). ``collapsed`` is the text without what a run holds after
    its first period, one space between words.

    Nothing is shuffled: rows stay where they are read. A task sorts the words of about BATCH words of texts at once;
    a longer text needs some 4 * log2(longest repeat) + 100 bytes for each of its words.

    Defined cases: null, empty and blank texts have no words, no runs and an empty ``collapsed``; repeated rows and rows
    without doc_id are treated one by one; other columns are ignored; an empty table gives an empty table.
    """
    if times < 3:
        raise ValueError("runs of fewer than three periods need not cover two points of the grid")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def made() -> pa.RecordBatch:
            return pa.RecordBatch.from_pandas(_made(held, least, times), _ARROW, preserve_index=False)

        for batch in batches:
            held, size = [], 0
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                words = (text.as_py() or "").encode().split()
                if held and size + len(words) > BATCH:
                    yield made()
                    held, size = [], 0
                held.append((doc_id, words))
                size += len(words)
            if held:
                yield made()

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(run, _SCHEMA)


def repeat_tails(docs: DataFrame) -> DataFrame:
    """(doc_id, text) with tails that repeat, planted in about a tenth of the documents, chosen by h = crc32(doc_id as text).

    Where h % 10 = 0 and there are n > 0 words, each word i >= a becomes word a + (i - a) % p, with g = floor(h / 10),
    a = g % n and p = 1 + floor((n - a) / (3 + g % 8)). Null texts stay null, rows without doc_id as they are.
    """
    h = F.crc32(F.col("doc_id").cast("string"))
    words = F.filter(F.split(F.coalesce(F.col("text"), F.lit("")), "[\\x20\\x09-\\x0D]+"), lambda w: w != "")
    split = docs.select("doc_id", "text", F.floor(h / 10).alias("g"), F.when(h % 10 == 0, words).alias("w")).withColumn("n", F.size("w").cast("long"))
    a = F.when(F.col("n") > 0, F.col("g") % F.col("n"))
    placed = split.withColumn("a", a).withColumn("p", 1 + F.floor((F.col("n") - F.col("a")) / (3 + F.col("g") % 8)))
    source = F.transform(F.sequence(F.col("a"), F.col("n") - 1), lambda i: (F.col("a") + (i - F.col("a")) % F.col("p")).cast("int"))
    edited = F.concat(F.slice("w", F.lit(1), F.col("a").cast("int")), F.transform(source, lambda i: F.get("w", i)))
    return placed.select("doc_id", F.when(F.col("n") > 0, F.array_join(edited, " ")).otherwise(F.col("text")).alias("text"))


def _lines(runs: Column) -> Column:
    """A line ``start,length,period`` for each run, each ended by a line feed."""
    line = lambda r: F.concat(r["start"].cast("string"), F.lit(","), r["length"].cast("string"), F.lit(","), r["period"].cast("string"), F.lit("\n"))
    return F.array_join(F.transform(runs, line), "")


def run_digests(found: DataFrame) -> DataFrame:
    """Per document the number of runs, the best one, its repeats in thousandths, and SHA-256 digests of all runs and of the collapsed text."""
    best = [F.col(f"best.{c}").alias(c) for c in ("start", "length", "period")]
    milli = F.expr("1000 * best.length div best.period").alias("exponent_milli")
    return found.select("doc_id", F.size("runs").cast("long").alias("n_runs"), *best, milli, F.sha2(_lines(F.col("runs")), 256).alias("runs_sha256"), F.sha2("collapsed", 256).alias("collapsed_sha256"))
