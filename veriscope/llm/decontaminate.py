"""Benchmark decontamination by template windows: re-parameterised questions match their originals."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .hashing import STEP, list_column, mix, pieces, text_buffers, words
from .idfilter import cells, id_filter
from .store import keep

# Words taken as numbers, and as units where a number stands before them.
NUMBER_WORDS = ("zero one two three four five six seven eight nine ten eleven twelve thirteen fourteen fifteen sixteen seventeen eighteen nineteen twenty thirty forty fifty sixty seventy eighty ninety hundred thousand million billion half dozen").split()
UNITS = (
    "mm cm m km inch inches foot feet yard yards mile miles mg g kg gram grams kilogram kilograms ton tons tonne tonnes ounce ounces pound pounds ml l litre litres liter liters gallon gallons "
    "second seconds minute minutes hour hours day days week weeks month months year years cent cents dollar dollars euro euros usd eur gbp percent degree degrees mph kmh kph w kw watt watts v volt volts hz joule joules"
).split()

_SPLIT = np.array([not (chr(c).isalnum() and c < 128 or c >= 128) for c in range(256)])
_DIGIT = np.array([48 <= c <= 57 for c in range(256)])
_STOP = np.array([chr(c) in ".!?:;\n" for c in range(256)])
_UPPER = np.array([65 <= c <= 90 for c in range(256)])
_BITS = 24
#: Hashes of the placeholders.
_NUMBER, _NAME, _UNIT = np.uint64(0x1111), np.uint64(0x2222), np.uint64(0x3333)


def _word_hashes(texts: list[str]) -> np.ndarray:
    data, at = text_buffers(pa.array(texts))
    return words(data, at, _SPLIT)[0]


_NUMBER_HASHES, _UNIT_HASHES = _word_hashes(NUMBER_WORDS), _word_hashes(UNITS)


def templates(column: pa.Array) -> Iterator[tuple[list[tuple[np.ndarray, np.ndarray]], np.ndarray]]:
    """Pieces as (readings, bounds by row); a reading has the template hash of each token and its slot or 0.

    The first reading has placeholders for numbers, units and names; the second for numbers and units
    alone; the third, for items that are mostly such things, has none. Letters are folded in all. A token is a run of letters and digits; a point or comma between digits belongs to the number. A
    token that begins with a digit and a number word are numbers; a unit after a number is a unit; a capitalised
    token inside a sentence is a name, and where it begins another sentence of the row too. The slot of such a placeholder is the hash of what it replaced.
    """
    data, at = text_buffers(column)
    for i, j in pieces(data, at):
        lo, hi = int(at[i]), int(at[j])
        raw = data[lo:hi]
        flat, bounds_at = raw.copy(), at[i : j + 1] - lo
        digit = _DIGIT[raw]
        if len(raw) > 2:
            point = np.flatnonzero(((raw[1:-1] == 46) | (raw[1:-1] == 44)) & digit[:-2] & digit[2:]) + 1
            flat[point] = 48
            wide = np.flatnonzero((raw[:-1] == 0xC3) & (raw[1:] >= 0x80) & (raw[1:] <= 0x9E) & (raw[1:] != 0x97)) + 1
            flat[wide] += 0x20
        hashes, starts, ends = words(flat, bounds_at, _SPLIT)
        bounds = np.searchsorted(starts, bounds_at)
        if not len(hashes):
            yield [(hashes, hashes)] * 3, bounds
            continue
        number = digit[starts] | np.isin(hashes, _NUMBER_HASHES)
        unit = np.zeros(len(hashes), bool)
        unit[1:] = number[:-1] & ~number[1:] & np.isin(hashes[1:], _UNIT_HASHES)
        stops = np.concatenate([[0], np.cumsum(_STOP[flat])])
        opens = np.ones(len(hashes), bool)
        opens[1:] = stops[starts[1:]] > stops[ends[:-1]]
        opens[bounds[:-1][bounds[:-1] < len(hashes)]] = True
        second = raw[np.minimum(starts + 1, len(raw) - 1)]
        capital = _UPPER[raw[starts]] | ((raw[starts] == 0xC3) & (second >= 0x80) & (second <= 0x9E))
        capital &= ~number & ~unit
        name = capital & ~opens
        own = mix(hashes + np.repeat(np.arange(len(bounds) - 1), np.diff(bounds)).astype(np.uint64))
        name |= capital & np.isin(own, own[name])
        slot = hashes | np.uint64(1)
        folded = np.select([number, unit], [_NUMBER, _UNIT], hashes), np.where(number | unit, slot, np.uint64(0))
        named = np.where(name, _NAME, folded[0]), np.where(name, slot, folded[1])
        yield [named, folded, (hashes, np.zeros(len(hashes), np.uint64))], bounds


def _inside(bounds: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """(row, first token) of each window of ``size`` tokens that lies inside one row."""
    row = np.repeat(np.arange(len(bounds) - 1), np.diff(bounds))
    first = np.flatnonzero(row[: max(0, len(row) - size + 1)] == row[size - 1 :])
    return row[first], first


def _sums(hashes: np.ndarray, first: np.ndarray, size: int, reading: int) -> np.ndarray:
    """Sums of the windows at ``first``; what :func:`mix` makes of one is the window's hash."""
    out = np.full(max(0, len(hashes) - size + 1), size + 1000 * reading, np.uint64)
    for j in range(size):
        out += hashes[j : j + len(out)] * STEP[j]
    return out[first]


def _plain(slot: np.ndarray, first: np.ndarray, size: int) -> np.ndarray:
    upto = np.concatenate([[0], np.cumsum(slot == 0)])
    return upto[first + size] - upto[first]


def _texts(df: DataFrame, key: str) -> DataFrame:
    return df.select(F.col(key).cast("long").alias(key), F.col("text").cast("string").alias("text")).where(f"{key} is not null")


def _item_windows(items: DataFrame, size: int, literals: int) -> DataFrame:
    """(item_id, reading, size, mask, pos, window, slots, total): windows with at least ``literals`` plain tokens.

    mask has a bit for each place where a name stands (first reading only); total is how many windows the item has in
    that reading. An item of fewer tokens than ``size`` is itself one window, of its own size.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            row0 = 0
            for readings, bounds in templates(batch.column(1)):
                n = np.diff(bounds)
                for width in range(literals, size + 1):
                    row, first = _inside(bounds, width)
                    fits = n[row] >= size if width == size else n[row] == width
                    for reading, (hashes, slot) in enumerate(readings):
                        ok = fits & (_plain(slot, first, width) >= literals)
                        at, of = first[ok], row[ok]
                        if not len(at):
                            continue
                        mask = sum((hashes[at + j] == _NAME).astype(np.int32) << j for j in range(width))
                        made = mix(_sums(hashes, at, width, reading)).view(np.int64)
                        slots = list(slot[at[:, None] + np.arange(width)].view(np.int64))
                        flat = [np.full(len(at), reading, np.int32), np.full(len(at), width, np.int32), mask, at - bounds[of], made]
                        columns = [batch.column(0).take(pa.array(of + row0)), *[pa.array(c) for c in flat], list_column(slots, pa.int64()), pa.array(np.bincount(of)[of])]
                        yield pa.RecordBatch.from_arrays(columns, ["item_id", "reading", "size", "mask", "pos", "window", "slots", "total"])
                row0 += len(bounds) - 1

    return _texts(items, "item_id").mapInArrow(run, "item_id long, reading int, size int, mask int, pos long, window long, slots array<long>, total long")


def _doc_windows(docs: DataFrame, looks: list[tuple[int, int, int]], literals: int, allowed) -> DataFrame:
    """(doc_id, window, doc_pos, doc_slots): windows that may be an item's, for each look (reading, size, mask).

    In the first reading the places of names come from the item: a window is taken once for each mask of that size, with
    the placeholder at its bits, whatever stands there. So names are found in any capitals.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            row0 = 0
            for (_, folded, literal), bounds in templates(batch.column(1)):
                for reading, size in sorted({look[:2] for look in looks}):
                    hashes, slot = literal if reading == 2 else folded
                    row, first = _inside(bounds, size)
                    ok = _plain(slot, first, size) >= literals
                    row, first = row[ok], first[ok]
                    sums = _sums(hashes, first, size, reading)
                    masks = [m for r, s, m in looks if (r, s) == (reading, size)]
                    change = {j: (_NAME - hashes[first + j]) * STEP[j] for j in range(size) if any(m >> j & 1 for m in masks)}
                    for mask in masks:
                        hidden = [j for j in range(size) if mask >> j & 1]
                        made = mix(sum((change[j] for j in hidden), sums))
                        hit = np.flatnonzero(allowed.value[cells(made, _BITS)])
                        if not len(hit):
                            continue
                        at = first[hit][:, None] + np.arange(size)
                        slots = slot[at]
                        slots[:, hidden] = literal[0][at[:, hidden]] | np.uint64(1)
                        columns = [batch.column(0).take(pa.array(row[hit] + row0)), pa.array(made[hit].view(np.int64)), pa.array(at[:, 0] - bounds[row[hit]]), list_column(list(slots.view(np.int64)), pa.int64())]
                        yield pa.RecordBatch.from_arrays(columns, ["doc_id", "window", "doc_pos", "doc_slots"])
                row0 += len(bounds) - 1

    return _texts(docs, "doc_id").mapInArrow(run, "doc_id long, window long, doc_pos long, doc_slots array<long>")


def find_leaks(docs: DataFrame, benchmark: DataFrame, size: int = 6, coverage: float = 0.5, literals: int = 4, conflicts: float = 0.2) -> DataFrame:
    """Pairs (doc_id, item_id, covered, windows, coverage, slots, changed) of documents and the items they leak.

    Numbers, names and units of both sides become typed placeholders; windows of ``size`` template
    tokens with at least ``literals`` plain ones are joined by hash. On one diagonal (document position
    minus item position) each slot value of the item must stand for one value of the document, but for
    a share of ``conflicts``; windows on diagonals that fail do not count. A pair is a leak if
    ``coverage`` of the item's windows occur. slots counts the item's different slot values
    found, changed those for which the document has another value: over 0 marks a re-parameterised copy. Where names stand is
    read from the item alone, so the document's may be in any capitals. The same is done with windows in
    which names, and in which all tokens, stand as they are; a pair counts by the reading that covers most of the item.

    Defined cases: null ids and null or empty texts match nothing; an item shorter than ``size`` tokens is one window of its own length,
    and one of fewer than ``literals`` tokens is never matched; a very long text is one like any other; repeated rows count once; other
    columns are ignored; an empty table gives no pairs.
    """
    items = keep(_item_windows(benchmark, size, literals))
    looks = sorted(map(tuple, items.select("reading", "size", "mask").distinct().toLocalIterator()))  # at most some 60: places of names in a window
    left = _doc_windows(docs, looks, literals, id_filter(items.select("window").distinct(), "window", _BITS))
    met = keep(left.join(items, "window").select("doc_id", "item_id", "reading", "pos", (F.col("doc_pos") - F.col("pos")).alias("diagonal"), "slots", "doc_slots", "total"))
    pairs = met.select("doc_id", "item_id", "reading", "diagonal", F.explode(F.filter(F.arrays_zip("slots", "doc_slots"), lambda x: x["slots"] != 0)).alias("p"))
    values = pairs.select("doc_id", "item_id", "reading", "diagonal", "p.slots", "p.doc_slots").distinct().groupBy("doc_id", "item_id", "reading", "diagonal", "slots").agg(F.count("*").alias("meanings"), F.min((F.col("slots") == F.col("doc_slots")).cast("int")).alias("same"))
    by_diagonal = values.groupBy("doc_id", "item_id", "reading", "diagonal").agg(F.count("*").alias("values"), F.sum((F.col("meanings") > 1).cast("int")).alias("odd"), F.sum(1 - F.col("same")).alias("changed"))
    joined = met.select("doc_id", "item_id", "reading", "diagonal", "pos", "total").join(by_diagonal, ["doc_id", "item_id", "reading", "diagonal"], "left")
    sound = joined.where(F.coalesce(F.col("odd") <= conflicts * F.col("values"), F.lit(True)))
    counted = sound.groupBy("doc_id", "item_id", "reading", "pos").agg(F.max("total").alias("windows"), F.max("values").alias("slots"), F.max("changed").alias("changed"))
    out = counted.groupBy("doc_id", "item_id", "reading").agg(F.count("*").alias("covered"), F.max("windows").alias("windows"), F.coalesce(F.max("slots"), F.lit(0)).alias("slots"), F.coalesce(F.max("changed"), F.lit(0)).alias("changed"))
    out = out.withColumn("coverage", F.col("covered") / F.col("windows")).where(F.col("coverage") >= coverage)
    best = F.max_by(F.struct("covered", "windows", "slots", "changed", "coverage"), F.struct("coverage", (-F.col("reading")).alias("r")))
    return out.groupBy("doc_id", "item_id").agg(best.alias("best")).select("doc_id", "item_id", "best.*")


def drop_leaks(docs: DataFrame, benchmark: DataFrame, **options) -> DataFrame:
    """``docs`` without the rows whose text leaks an item; all columns as they were.

    Each row is judged by its own text, also where rows share a doc_id or have none; rows with null or empty texts stay, an
    empty table stays empty. Rows are named by a 64-bit hash of doc_id and text.
    """
    place = F.xxhash64(docs["doc_id"].cast("long"), docs["text"].cast("string"))
    told = docs.select(place.alias("doc_id"), docs["text"])
    leaks = keep(find_leaks(told, benchmark, **options).select(F.col("doc_id").alias("leaked")).distinct())  # a table of known size, so that a short list spares the texts a shuffle
    return docs.join(leaks, place == leaks["leaked"], "left_anti")
