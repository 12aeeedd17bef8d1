"""How far the sources of a language differ in their use of terms: scans of sorted runs of (lang, term, source, document)."""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .store import keep

#: Counts that a task holds before it sends them on.
HELD = 600_000
#: Cells of terms by sources, and of sources by sources, that a task holds.
CELLS = 1 << 20
#: Tasks over which the frequent terms of a language are first spread.
SPREAD = 8

_TERM = bytearray(b" " * 256)
for _b in range(256):
    if 65 <= _b <= 90:
        _TERM[_b] = _b + 32
    elif 97 <= _b <= 122 or _b >= 128:
        _TERM[_b] = _b
_TERM = bytes(_TERM)

_COUNTS = "lang string, term string, source string, document bigint, df bigint, n bigint"
_NAMES = ("lang", "term", "source", "document", "df", "n")


def terms(text: str | None) -> list[bytes]:
    """Maximal runs of ASCII letters and of characters beyond ASCII, A-Z lower-cased."""
    return (text or "").encode().translate(_TERM).split()


def _combined(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Document frequency and count of each (lang, source, term) over some documents of a task; ``document`` is the least of these."""
    held: dict[tuple[str, str], tuple[Counter, Counter]] = {}
    size, document = 0, None

    def flush() -> Iterator[pa.RecordBatch]:
        for (lang, source), (n, df) in held.items():
            many = len(n)
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array([lang], pa.string()).take(pa.array(np.zeros(many, np.int64))), pa.array(list(n), pa.binary()).cast(pa.string()), pa.array([source], pa.string()).take(pa.array(np.zeros(many, np.int64))),
                    pa.array(np.full(many, document or 0)), pa.array([df[t] for t in n], pa.int64()), pa.array(list(n.values()), pa.int64()),
                ],
                _NAMES,
            )

    for batch in batches:
        for doc_id, text, lang, source in zip(batch.column(0).to_pylist(), batch.column(1), batch.column(2).to_pylist(), batch.column(3).to_pylist(), strict=True):
            n, df = held.setdefault((lang, source), (Counter(), Counter()))
            own, before = terms(text.as_py()), len(n)
            n.update(own)
            df.update(set(own))
            size += len(n) - before
            document = doc_id if document is None else min(document, doc_id)
            if size > HELD:
                yield from flush()
                held, size, document = {}, 0, None
    yield from flush()


def _starts(table: pa.Table, keys: tuple[str, ...]) -> np.ndarray:
    """Where runs of equal keys begin."""
    new = np.ones(len(table), bool)
    new[1:] = False
    for key in keys:
        column = table.column(key).combine_chunks()
        if isinstance(column, pa.ChunkedArray):
            column = column.chunk(0)
        new[1:] |= pc.not_equal(column[1:], column[:-1]).to_numpy(zero_copy_only=False)
    return np.flatnonzero(new)


def _merged(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.Table]:
    """Run-length scan: one row for each run of (lang, term, source), with the sums of its document frequencies and counts. Holds one row back."""
    held = None
    for batch in batches:
        if not batch.num_rows:
            continue
        table = pa.Table.from_batches([batch])
        if held is not None:
            table = pa.concat_tables([held, table])
        starts = _starts(table, ("lang", "term", "source"))
        sums = [np.add.reduceat(table.column(c).to_numpy(), starts) for c in ("df", "n")]
        table = table.take(pa.array(starts))
        for name, values in zip(("df", "n"), sums, strict=True):
            table = table.set_column(table.column_names.index(name), name, pa.array(values, pa.int64()))
        if len(table) > 1:
            yield table.slice(0, len(table) - 1)
        held = table.slice(len(table) - 1)
    if held is not None:
        yield held


def _whole_terms(tables: Iterator[pa.Table]) -> Iterator[pa.Table]:
    """Tables in which no term of a language is cut. Holds one term's rows back: at most one for each source."""
    held = None
    for table in tables:
        if held is not None:
            table = pa.concat_tables([held, table])
        last = int(_starts(table, ("lang", "term"))[-1])
        if last:
            yield table.slice(0, last)
        held = table.slice(last)
    if held is not None:
        yield held


def _run_lengths(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for table in _merged(batches):
        yield from table.to_batches()


def kept_terms(docs: DataFrame, least: int) -> DataFrame:
    """(lang, term, source, n, head) of the terms in at least ``least`` documents of a language; ``head`` is 1 in one row of each term.

    Counts meet in each task first. Then runs of (lang, term, source, document) are scanned in sorted order, frequent
    terms spread over SPREAD tasks by document, and once more by term alone, so that no task reads a term whole.
    """

    def enough(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in _whole_terms(_merged(batches)):
            starts = _starts(table, ("lang", "term"))
            size = np.diff(np.append(starts, len(table)))
            good = np.repeat(np.add.reduceat(table.column("df").to_numpy(), starts) >= least, size)
            head = np.zeros(len(table), np.int64)
            head[starts] = 1
            yield from table.select(["lang", "term", "source", "n"]).append_column("head", pa.array(head)).filter(pa.array(good)).to_batches()

    parts, key = docs.mapInArrow(_combined, _COUNTS), F.xxhash64("lang", "term")  # numbers first: they sort by radix
    salt = F.when(F.col("df") >= 4, F.pmod(F.xxhash64("document"), F.lit(SPREAD))).otherwise(0)
    once = parts.repartition("lang", "term", salt).sortWithinPartitions(key, "lang", "term", "source", "document").mapInArrow(_run_lengths, _COUNTS)
    again = once.repartition("lang", "term").sortWithinPartitions(key, "lang", "term", "source", "document")
    return again.mapInArrow(enough, "lang string, term string, source string, n bigint, head bigint")


def milliardths(count: np.ndarray, total: np.ndarray | int) -> np.ndarray:
    """floor(10**9 * count / total), exact for count <= total < 2**53: three digits at a time."""
    out, rest = count // total, count % total
    for _ in range(3):
        rest = rest * 1000
        out = out * 1000 + rest // total
        rest = rest % total
    return out


class Shares:
    """The groups of each language: sources in order, their counts of kept terms and the number of these."""

    def __init__(self, rows: list[tuple[str, str, int, int]]) -> None:
        self.sources: dict[str, list[str]] = {}
        self.n: dict[str, np.ndarray] = {}
        self.kept = {lang: kept for lang, _, _, kept in rows}
        counts: dict[str, dict[str, int]] = {}
        for lang, source, n, _ in rows:
            counts.setdefault(lang, {})[source] = n
        for lang, own in counts.items():
            self.sources[lang] = sorted(own)
            self.n[lang] = np.array([own[s] for s in self.sources[lang]], np.int64)


_PARTS = "lang string, source string, part string, item string, value bigint"


def _rows(lang: str, source: list[str] | pa.Array, part: str, item: list[str] | pa.Array, value: np.ndarray) -> pa.RecordBatch:
    many = len(value)
    same = lambda x: pa.array([x], pa.string()).take(pa.array(np.zeros(many, np.int64)))
    return pa.RecordBatch.from_arrays([same(lang), pa.array(source, pa.string()), same(part), pa.array(item, pa.string()), pa.array(value, pa.int64())], ["lang", "source", "part", "item", "value"])


def _compare(batches: Iterator[pa.RecordBatch], shares: Shares) -> Iterator[pa.RecordBatch]:
    """Partial sums over runs of terms: for pairs of sources their distance, for a source the terms it has more of than its language.

    Sums of a language's pairs are held while they fit in CELLS; with more sources each stretch of terms sends its own.
    """
    held: dict[str, np.ndarray] = {}

    def pairs(lang: str, k: int, value: np.ndarray) -> pa.RecordBatch:
        names = shares.sources[lang]
        return _rows(lang, [names[k]] * len(value), "pair", names[k + 1 :], value)

    for table in _whole_terms(pa.Table.from_batches([b]) for b in batches if b.num_rows):
        langs = np.append(_starts(table, ("lang",)), len(table))
        for a, b in zip(langs, langs[1:], strict=False):
            lang = table.column("lang")[int(a)].as_py()
            names, totals, kept = shares.sources[lang], shares.n[lang], shares.kept[lang]
            own = table.slice(a, b - a)
            starts = np.append(_starts(own, ("term",)), len(own))
            step = max(1, CELLS // len(names))
            for first in range(0, len(starts) - 1, step):
                cuts = starts[first : first + step + 1]
                part = own.slice(cuts[0], cuts[-1] - cuts[0])
                term = np.repeat(np.arange(len(cuts) - 1), np.diff(cuts))
                source = pc.index_in(part.column("source").combine_chunks(), value_set=pa.array(names, pa.string())).to_numpy(zero_copy_only=False).astype(np.int64)
                counts = np.zeros((len(cuts) - 1, len(names)), np.int64)
                counts[term, source] = part.column("n").to_numpy()
                share = 1 + milliardths(counts + 5, totals + 5 * kept)
                whole = 1 + milliardths(counts.sum(axis=1) + 5, totals.sum() + 5 * kept)
                more = share[term, source] - whole[term]
                if (more > 0).any():
                    chosen = part.filter(pa.array(more > 0)).combine_chunks()
                    yield _rows(lang, chosen.column("source").to_pylist(), "term", chosen.column("term").to_pylist(), more[more > 0])
                if len(names) ** 2 <= CELLS and lang not in held:
                    for other, sums in held.items():  # sorted rows: the language before is done
                        yield from (pairs(other, k, sums[k, k + 1 :]) for k in range(len(sums) - 1))
                    held = {lang: np.zeros((len(names), len(names)), np.int64)}
                for k in range(len(names) - 1):
                    value = np.abs(share[:, k + 1 :] - share[:, k : k + 1]).sum(axis=0)
                    if lang in held:
                        held[lang][k, k + 1 :] += value
                    else:
                        yield pairs(lang, k, value)
    for lang, sums in held.items():
        yield from (pairs(lang, k, sums[k, k + 1 :]) for k in range(len(sums) - 1))


def source_divergence(docs: DataFrame, least: int = 30, top: int = 50) -> DataFrame:
    """(lang, source, part, item, value, rank) for each group (lang, source) of ``docs``.

    A language keeps the terms in at least ``least`` of its documents (rows). A group with count c of a kept term and N
    of all V of them gives it the share 1 + floor(10**9 * (c + 5) / (N + 5 * V)); so does a language as a whole. Part
    ``pair``: ``item`` is each other source of the language, ``value`` the sum of the differences of shares over the kept
    terms. Part ``term``: the ``top`` kept terms that the group has and whose share is above the language's, by this
    difference. Ranks go by value descending, then item ascending. Sums are integers, exact below 2**53 terms.

    The table of groups (lang, source, N, V) is broadcast. The result has a row for each ordered pair of sources, so the
    table is no larger than the square root of the result times the number of languages.

    Defined cases: null text, lang and source count as empty; a group without terms takes part with counts of 0; a
    language that keeps no term has pairs of value 0 and no terms, one of a single source neither; repeated rows count as
    documents of their own; doc_id only orders rows, null as 0; other columns are ignored; an empty table gives an
    empty table.
    """
    text = lambda c: F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c)
    docs = docs.select(F.coalesce(F.col("doc_id").cast("long"), F.lit(0)).alias("doc_id"), text("text"), text("lang"), text("source"))
    kept = keep(kept_terms(docs, least))
    sums = kept.groupBy("lang", "source").agg(F.sum("n").alias("n"))
    sizes = kept.groupBy("lang").agg(F.sum("head").alias("kept"))
    groups = keep(docs.select("lang", "source").distinct().join(sums, ["lang", "source"], "left").join(sizes, "lang", "left").na.fill(0, ["n", "kept"]))
    shares = docs.sparkSession.sparkContext.broadcast(Shares([tuple(r) for r in groups.select("lang", "source", "n", "kept").toLocalIterator()]))
    ordered = kept.repartition("lang", "term").sortWithinPartitions("lang", "term", "source")
    found = keep(ordered.mapInArrow(lambda batches: _compare(batches, shares.value), _PARTS))

    sides = groups.select("lang", "source").join(groups.select("lang", F.col("source").alias("item")), "lang").where("source <> item").withColumn("value", F.lit(0).cast("long"))
    pairs = found.where("part = 'pair'").select("lang", "source", "item", "value").groupBy("lang", "source", "item").agg(F.sum("value").alias("value"))
    both = pairs.unionByName(pairs.select("lang", F.col("item").alias("source"), F.col("source").alias("item"), "value")).unionByName(sides)
    order = Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item")
    far = both.groupBy("lang", "source", "item").agg(F.sum("value").alias("value")).select("lang", "source", F.lit("pair").alias("part"), "item", "value", F.row_number().over(order).alias("rank"))
    most = found.where("part = 'term'").withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= top)
    return far.unionByName(most.select(*far.columns))
