"""Line deduplication by an exact set-similarity join on line tokens.

The tokens of a line are ordered by rarity. A similar pair has a first common token in that order, and
it lies in the prefix of both lines; each pair is looked at under the key of that token alone (or, where
more than ``Limits.few`` lines have it, under the key of the first two common tokens), so no pair is counted twice.
Keys under which few pairs survive the length, positional and bitmap filters give these pairs for exact
verification. Keys under which most pairs survive (groups of near copies) are verified in blocks inside
tasks, which return link counts and a spanning forest instead of pairs.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.broadcast import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .hashing import SPACE, mix, pieces, text_buffers, words
from .idfilter import SPARSE, cells, counts, id_filter, merged, step
from .links import components, forest, shared, similar
from .store import discard, keep, tidy

_ID_BITS = 22
#: Words of 64 bits in the bitmap that is looked at before two lines' tokens are.
_WIDE = 8


@dataclass(frozen=True)
class Limits:
    """How the work is cut; results do not depend on it.

    few: lines of a token above which a key takes the next common token too, and rows of a key that a task compares at
    once. dense: surviving pairs for each row of a key above which the key's lines are verified in blocks of at most
    about ``lines`` lines and ``tokens`` tokens.
    """

    few: int = 4096
    dense: int = 12
    lines: int = 512
    tokens: int = 16_384


def _distinct_tokens(line: np.ndarray, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(line, hash) of the distinct tokens, a line's adjacent and ascending."""
    if not len(line):
        return line, hashes
    order = None
    if line[-1] < 1 << 24:
        key = (line.astype(np.uint64) << np.uint64(40)) | (hashes >> np.uint64(24))
        order = np.argsort(key)
        line, hashes, key = line[order], hashes[order], key[order]
        same = key[1:] == key[:-1]
        if (hashes[1:][same] != hashes[:-1][same]).any():
            order = None  # then the whole hash decides
    if order is None:
        order = np.lexsort((hashes, line))
        line, hashes = line[order], hashes[order]
    new = np.concatenate([[True], (line[1:] != line[:-1]) | (hashes[1:] != hashes[:-1])])
    return line[new], hashes[new]


def _lines(column: pa.Array) -> Iterator[tuple[int, int, np.ndarray, np.ndarray, np.ndarray]]:
    """Pieces as (first row, last row, line of each distinct token, token, (row, number) of each line).

    Tokens are 64-bit hashes of the distinct words of a line, A-Z lower-cased; a line's tokens are adjacent.
    """
    data, at = text_buffers(column)
    for i, j in pieces(data, at):
        lo, hi = int(at[i]), int(at[j])
        breaks = np.flatnonzero(data[lo:hi] == 10) + lo + 1
        starts = np.union1d(at[i:j], breaks)
        # an empty row shares its start with the next one, and a final break starts a last empty line
        row = np.searchsorted(at[i : j + 1], starts, "right") - 1
        real = row < j - i
        starts, row = starts[real], row[real]
        number = np.arange(len(starts)) - np.searchsorted(starts, at[i:j], "left")[row]
        hashes, where, _ = words(data, at[i : j + 1], SPACE)
        line, token = _distinct_tokens(np.searchsorted(starts, where, "right") - 1, hashes)
        yield i, j, line, token, np.stack([row + i, number])


def _line_sets(line: np.ndarray, token: np.ndarray, min_tokens: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(line, first token's place, number of tokens) of the lines that are long enough."""
    first = np.flatnonzero(np.diff(line, prepend=-1))
    size = np.diff(np.append(first, len(line)))
    ok = size >= min_tokens
    return line[first[ok]], first[ok], size[ok]


def _set_hash(token: np.ndarray, first: np.ndarray, size: np.ndarray) -> np.ndarray:
    total = np.concatenate([np.zeros(1, np.uint64), np.cumsum(mix(token + np.uint64(1)))])
    return mix((total[first + size] - total[first]) ^ size.astype(np.uint64)).view(np.int64)


def _least_joined(threshold: int) -> int:
    """Tokens of the smallest set that can reach ``threshold`` % with a different one: n of n + 1."""
    return next((n for n in range(1, 100) if 100 * n >= threshold * (n + 1)), 100)


def _ranges(starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """The integers of all ranges [start, start + size), one range after the other."""
    return np.repeat(starts - np.cumsum(sizes) + sizes, sizes) + np.arange(int(sizes.sum()))


def rarity_bits(docs: DataFrame) -> int:
    """log2 of the cells of the token table: grows as vocabularies do, with the square root of the text, within 16 kB and 64 MB.

    The text is reckoned as the rows times the mean length of a few of them; only the order of tokens depends on it.
    """
    some = [r["n"] for r in docs.select(F.length("text").alias("n")).limit(200).collect() if r["n"]]
    return int(np.clip(np.ceil(np.log2(256 * np.sqrt(sum(some) / max(1, len(some)) * docs.count()) + 1)), 14, 26))


def token_rarity(docs: DataFrame, bits: int) -> Broadcast:
    """Occurrences of hashed tokens over the whole corpus, in steps of one byte, in a table of 2**bits cells."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def found() -> Iterator[np.ndarray]:
            for batch in batches:
                data, at = text_buffers(batch.column(0))
                for i, j in pieces(data, at):
                    yield cells(words(data, at[i : j + 1], SPACE)[0], bits)

        yield from counts(found(), bits)

    return merged(docs.select("text").mapInArrow(run, SPARSE), bits)


def _ordered(token: np.ndarray, which: np.ndarray, count: np.ndarray) -> np.ndarray:
    """Order of the tokens by line, then rarity, then hash."""
    if len(which) and which[-1] < 1 << 24:
        key = (which.astype(np.uint64) << np.uint64(40)) | (count.astype(np.uint64) << np.uint64(32)) | (token >> np.uint64(32))
        order = np.argsort(key)
        if not (key[order][1:] == key[order][:-1]).any():
            return order
    return np.lexsort((token, count, which))


def _prefix_lengths(size: np.ndarray, threshold: int) -> np.ndarray:
    """Tokens of the rarest n - ceil(t n) + 1, of which a similar set must have one; 0 for sets too small to resemble any other."""
    return np.where(size >= _least_joined(threshold), size - -(-threshold * size // 100) + 1, 0)


def _token_pairs(token: np.ndarray, frequent: np.ndarray, prefix: np.ndarray, which: np.ndarray, rank: np.ndarray) -> tuple[np.ndarray, ...]:
    """(line, key, place of the second token, token before it) of each frequent prefix token with each later one of the prefix that is one longer."""
    more = np.flatnonzero(frequent)
    width = prefix[which[more]] - rank[more]
    first, second = np.repeat(more, width), _ranges(more + 1, width)
    key = mix(token[first]) ^ (token[second] * np.uint64(0x9E3779B97F4A7C15) + np.uint64(1))
    return which[first], key, rank[second], np.where(second == first + 1, np.uint64(0), token[second - 1])


def index_lines(docs: DataFrame, rarity: Broadcast, bits: int, threshold: int, min_tokens: int, few: int) -> DataFrame:
    """(line, doc_id, text_id, number, n, bitmap, prefix, pairs): each document's lines as token sets.

    line is a hash of the set of n tokens; bitmap the exclusive or of one bit for each token, whose Hamming distance never
    exceeds the symmetric difference. With the first occurrence of a line in a task stand its prefix, the last bit of a
    token set if it is a key of its own, and the keys of token pairs, as key, place and token before it.
    """
    frequent = int(step(np.array([few]))[0])

    def lists(of: np.ndarray, values: np.ndarray, lines: int, each: int = 1) -> pa.ListArray:
        ends = np.concatenate([[0], np.cumsum(np.bincount(of, minlength=lines))])
        return pa.ListArray.from_arrays(pa.array(each * ends, pa.int32()), pa.array(values.view(np.int64)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rare = rarity.value
        seen: set[int] = set()  # at most the lines of one split
        for batch in batches:
            ids, names = (batch.column(k).to_numpy(zero_copy_only=False) for k in (0, 1))
            for _, _, line, token, places in _lines(batch.column(2)):
                own, first, size = _line_sets(line, token, min_tokens)
                if not len(own):
                    continue
                line_id = _set_hash(token, first, size)
                fresh = np.zeros(len(own), bool)
                fresh[np.unique(line_id, return_index=True)[1]] = True
                fresh &= np.array([x not in seen for x in line_id.tolist()])
                seen.update(line_id[fresh].tolist())
                rows, n = np.flatnonzero(fresh), size[fresh]
                mine, which = token[_ranges(first[fresh], n)], np.repeat(np.arange(len(n)), n)
                begin = np.cumsum(n) - n
                bitmap = np.zeros(len(own), np.uint64)
                if len(n):
                    bitmap[rows] = np.bitwise_xor.reduceat(np.uint64(1) << (mix(mine + np.uint64(7)) & np.uint64(63)), begin)
                count = rare[cells(mine, bits)]
                order = _ordered(mine, which, count)
                mine, count, rank, prefix = mine[order], count[order], np.arange(len(mine)) - begin[which], _prefix_lengths(n, threshold)
                inside = rank < prefix[which]
                marked = mine & ~np.uint64(1) | ((count > 1) & (count <= frequent)).astype(np.uint64)
                of, *pairs = _token_pairs(mine, inside & (count > frequent), prefix, which, rank)
                columns = [
                    pa.array(line_id), pa.array(ids[places[0][own]], pa.int64()), pa.array(names[places[0][own]], pa.int64()), pa.array(places[1][own], pa.int32()), pa.array(size, pa.int32()), pa.array(bitmap.view(np.int64)),
                    lists(rows[which[inside]], marked[inside], len(own)), lists(rows[of], np.stack([x.astype(np.uint64) for x in pairs], axis=1).ravel(), len(own), 3),
                ]
                yield pa.RecordBatch.from_arrays(columns, ["line", "doc_id", "text_id", "number", "n", "bitmap", "prefix", "pairs"])

    return docs.select("doc_id", "text_id", "text").mapInArrow(run, "line long, doc_id long, text_id long, number int, n int, bitmap long, prefix array<long>, pairs array<long>")


def _key_rows(lines: DataFrame) -> DataFrame:
    """(key, id, info, bitmap, previous): info holds the set's size, the place of the key's last token and the number of its tokens; previous is the token before that place, or 0."""
    info = lambda place, tokens: F.shiftleft(F.col("n").cast("long"), 32).bitwiseOR(F.shiftleft(place.cast("long"), 2)).bitwiseOR(F.lit(tokens))
    one = lines.where("size(prefix) > 0").select(F.col("line").alias("id"), "n", "bitmap", "prefix", F.posexplode("prefix")).where("col % 2 <> 0")
    before = F.when(F.col("pos") > 0, F.shiftright(F.get("prefix", F.col("pos") - 1), 1)).otherwise(F.lit(0).cast("long"))
    one = one.select(F.shiftright("col", 1).alias("key"), "id", info(F.col("pos"), 1).alias("info"), "bitmap", before.alias("previous"))
    two = lines.where("size(pairs) > 0").select(F.col("line").alias("id"), "n", "bitmap", "pairs", F.explode(F.sequence(F.lit(0), F.size("pairs") - 3, F.lit(3))).alias("k"))
    two = two.select(F.get("pairs", F.col("k")).alias("key"), "id", info(F.get("pairs", F.col("k") + 1), 2).alias("info"), "bitmap", F.shiftright(F.get("pairs", F.col("k") + 2), 1).alias("previous"))
    return one.unionByName(two)


class _Rows:
    """Rows of whole keys: sorted by key and id, without repeats."""

    def __init__(self, columns: list[np.ndarray], threshold: int):
        self.key, self.id, info, bitmap, self.previous = columns
        self.n, self.place, self.tokens = info >> 32, (info >> 2) & ((1 << 30) - 1), info & 3
        self.bitmap, self.threshold = bitmap.view(np.uint64), threshold

    def apart(self, total: np.ndarray) -> np.ndarray:
        """Greatest symmetric difference of similar sets of ``total`` tokens together."""
        return total - 2 * -(-self.threshold * total // (100 + self.threshold))

    def sift(self, x: np.ndarray, y: np.ndarray) -> np.ndarray:
        """Which pairs of rows pass the length and positional filters, and have no common token just before the key's."""
        n, m = self.n[x], self.n[y]
        needed = -(-self.threshold * (n + m) // (100 + self.threshold))
        ok = 100 * np.minimum(n, m) >= self.threshold * np.maximum(n, m)
        ok &= self.tokens[x] + np.minimum(n - self.place[x], m - self.place[y]) - 1 >= needed
        return ok & ((self.previous[x] != self.previous[y]) | (self.previous[x] == 0))

    def small(self, starts: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Surviving pairs of keys of few rows each, by their distance."""
        x = _ranges(starts, sizes)
        last = np.repeat(starts + sizes, sizes)
        xs, ys = [x[:0]], [x[:0]]
        for off in range(1, int(sizes.max(initial=1))):
            more = x + off < last
            x, last = x[more], last[more]
            y = x + off
            near = np.bitwise_count(self.bitmap[x] ^ self.bitmap[y]) <= self.apart(self.n[x] + self.n[y])
            a, b = x[near], y[near]
            ok = self.sift(a, b)
            xs.append(a[ok])
            ys.append(b[ok])
        return np.concatenate(xs), np.concatenate(ys)

    def even(self, starts: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Surviving pairs of keys of ``size`` rows each, by key, and how many each key has."""
        xs, ys, many = [starts[:0]], [starts[:0]], [starts[:0]]
        few = max(1, (1 << 19) // size**2)
        for k in range(0, len(starts), few):
            own = starts[k : k + few, None] + np.arange(size)
            n, bitmap = self.n[own], self.bitmap[own]
            table = self.apart(np.arange(2 * int(n.max()) + 1)) if n.max() < 1 << 16 else None
            total = n[:, :, None] + n[:, None, :]
            near = np.bitwise_count(bitmap[:, :, None] ^ bitmap[:, None, :]) <= (table[total] if table is not None else self.apart(total))
            of, a, b = np.nonzero(near & np.triu(np.ones((size, size), bool), 1))
            x, y = own[of, a], own[of, b]
            ok = self.sift(x, y)
            xs.append(x[ok])
            ys.append(y[ok])
            many.append(np.bincount(of[ok], minlength=len(own)))
        return np.concatenate(xs), np.concatenate(ys), np.concatenate(many)

    def large(self, start: int, size: int) -> tuple[np.ndarray, np.ndarray]:
        """Surviving pairs of one key, in blocks."""
        n, bitmap = self.n[start : start + size], self.bitmap[start : start + size]
        table = self.apart(np.arange(2 * int(n.max()) + 1)) if n.max() < 1 << 16 else None
        xs, ys = [], []
        for k in range(0, size, 128):
            total = n[k : k + 128, None] + n[None, k:]
            near = np.bitwise_count(bitmap[k : k + 128, None] ^ bitmap[None, k:]) <= (table[total] if table is not None else self.apart(total))
            a, b = np.nonzero(near)
            a, b = a[b > a] + k + start, b[b > a] + k + start
            ok = self.sift(a, b)
            xs.append(a[ok])
            ys.append(b[ok])
        return np.concatenate(xs), np.concatenate(ys)


def _by_key(key: np.ndarray, ids: np.ndarray) -> np.ndarray:
    """Order by key, then id, of rows in which equal keys are adjacent."""
    run = np.cumsum(np.concatenate([[False], key[1:] != key[:-1]]))
    if run[-1] < 1 << 24:
        both = (run.astype(np.uint64) << np.uint64(40)) | ((ids.view(np.uint64) ^ np.uint64(1 << 63)) >> np.uint64(24))
        order = np.argsort(both)
        same = both[order][1:] == both[order][:-1]
        if (ids[order][1:][same] == ids[order][:-1][same]).all():  # else the whole id decides
            return order
    return np.lexsort((ids, run))


def _meet(batches: Iterator[pa.RecordBatch], threshold: int, limits: Limits) -> Iterator[pa.RecordBatch]:
    """Pairs (a, b, place_a, place_b, tokens), and as rows without b the lines of keys to be verified in blocks, with their size as place_b.

    The rows come sorted by key; a task holds one batch, and of a key that goes on in the next one at most ``limits.few`` rows.
    """
    names = ["key", "a", "b", "place_a", "place_b", "tokens"]

    def dense(r: _Rows, rows: np.ndarray) -> pa.RecordBatch:
        none = pa.nulls(len(rows), pa.int64())
        return pa.RecordBatch.from_arrays([pa.array(r.key[rows]), pa.array(r.id[rows]), none, pa.array(r.place[rows]), pa.array(r.n[rows]), pa.array(r.tokens[rows])], names)

    held, endless = None, None
    for batch in _with_end(batches):
        columns = [batch.column(k).to_numpy(zero_copy_only=False) for k in range(5)] if batch is not None else None
        if columns is not None and held is not None:
            columns = [np.concatenate([a, b]) for a, b in zip(held, columns, strict=True)]
        columns = held if columns is None else columns
        if columns is None or not len(columns[0]):
            continue
        order = _by_key(*columns[:2])
        key, ids = columns[0][order], columns[1][order]
        r = _Rows([c[order[np.concatenate([[True], (key[1:] != key[:-1]) | (ids[1:] != ids[:-1])])]] for c in columns], threshold)
        held = None
        starts = np.flatnonzero(np.concatenate([[True], r.key[1:] != r.key[:-1]]))
        sizes = np.diff(np.append(starts, len(r.key)))
        blocks = (sizes > limits.few) | (r.key[starts] == endless if endless is not None else np.zeros(len(starts), bool))
        if batch is not None:  # the last key may go on
            if blocks[-1]:
                endless = r.key[-1]
            else:
                held, endless = [c[columns[0] == key[-1]] for c in columns], None
                starts, sizes, blocks = starts[:-1], sizes[:-1], blocks[:-1]
        little = np.flatnonzero((sizes > 1) & (sizes <= 24) & ~blocks)
        pairs = [r.small(starts[little], sizes[little])]
        middle = np.flatnonzero((sizes > 24) & (sizes <= 128) & ~blocks)
        for size in np.unique(sizes[middle]).tolist():
            own = middle[sizes[middle] == size]
            x, y, many = r.even(starts[own], size)
            blocks[own] = full = many > limits.dense * size
            pairs.append((x[~np.repeat(full, many)], y[~np.repeat(full, many)]))
        for k in np.flatnonzero((sizes > 128) & ~blocks):
            x, y = r.large(starts[k], sizes[k])
            if len(x) > limits.dense * sizes[k]:
                blocks[k] = True
            else:
                pairs.append((x, y))
        x, y = (np.concatenate(z) for z in zip(*pairs, strict=True))
        if len(x):
            yield pa.RecordBatch.from_arrays([pa.array(r.key[x]), pa.array(r.id[x]), pa.array(r.id[y]), pa.array(r.place[x]), pa.array(r.place[y]), pa.array(r.tokens[x])], names)
        for k in np.flatnonzero(blocks):
            yield dense(r, np.arange(starts[k], starts[k] + sizes[k]))


def _with_end(batches: Iterator) -> Iterator:
    yield from batches
    yield None


def line_tokens(docs: DataFrame, wanted: DataFrame, rarity: Broadcast, bits: int, min_tokens: int) -> DataFrame:
    """(id, n, wide, tokens), the n tokens in order of rarity and a bitmap of 64 * _WIDE bits, of the lines ``wanted`` (id, doc_id, text_id, number): id as found at that place."""
    places = wanted.select(F.xxhash64("doc_id", "text_id").alias("place"))
    rows, allowed = id_filter(places, "place", _ID_BITS), id_filter(wanted, "id", _ID_BITS)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            batch = batch.filter(pa.array(rows.value[cells(batch.column(3).to_numpy(zero_copy_only=False), _ID_BITS)] > 0))
            if not batch.num_rows:
                continue
            ids, names = (batch.column(k).to_numpy(zero_copy_only=False) for k in (0, 1))
            for _, _, line, token, places in _lines(batch.column(2)):
                own, first, size = _line_sets(line, token, min_tokens)
                line_id = _set_hash(token, first, size)
                hit = np.flatnonzero(allowed.value[cells(line_id, _ID_BITS)] > 0)
                if not len(hit):
                    continue
                n = size[hit]
                mine, which = token[_ranges(first[hit], n)], np.repeat(np.arange(len(hit)), n)
                mixed = mix(mine + np.uint64(11))
                wide = np.zeros((len(hit), _WIDE), np.uint64)
                np.bitwise_xor.at(wide, (which, ((mixed >> np.uint64(6)) % np.uint64(_WIDE)).astype(np.int64)), np.uint64(1) << (mixed & np.uint64(63)))
                mine = mine[_ordered(mine, which, rarity.value[cells(mine, bits)])].view(np.int64)
                lists = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(n)]), pa.int32()), pa.array(mine, pa.int64()))
                at = places[0][own[hit]]
                yield pa.RecordBatch.from_arrays([pa.array(line_id[hit]), pa.array(ids[at], pa.int64()), pa.array(names[at], pa.int64()), pa.array(places[1][own[hit]], pa.int32()), pa.array(n, pa.int32()), pa.FixedSizeListArray.from_arrays(pa.array(wide.view(np.int64).ravel()), _WIDE).cast(pa.list_(pa.int64())), lists], ["id", "doc_id", "text_id", "number", "n", "wide", "tokens"])

    found = docs.select("doc_id", "text_id", "text", F.xxhash64("doc_id", "text_id").alias("place")).mapInArrow(run, "id long, doc_id long, text_id long, number int, n int, wide array<long>, tokens array<long>")
    place = F.struct("doc_id", "text_id", "number")
    met = found.withColumn("at", place).join(wanted.select("id", place.alias("first")), "id").where("at = first")
    return met.select("id", "n", "wide", "tokens").dropDuplicates(["id"])  # the join has dealt the rows by id already


def _verify_block(pdf: pd.DataFrame, threshold: int) -> pd.DataFrame:
    """(id, links, root) of the lines of two blocks of a key: links to lines of the other block, and a forest over them.

    A pair counts here if the key's tokens are its first common ones.
    """
    left, right = pdf[pdf["side"] == 0], pdf[pdf["side"] == 1]
    same = not len(right)
    right = left if same else right
    heads = [[t[: p + 1] for t, p in zip(x["tokens"], x["place"], strict=True)] for x in (left, right)]
    linked = similar(left["tokens"], right["tokens"], threshold) & (shared(*heads) == pdf["tokens_in_key"].iloc[0])
    x, y = left["id"].to_numpy(), right["id"].to_numpy()
    linked &= x[:, None] != y[None, :]
    ids, links, root = forest(x, y, linked, same)
    return pd.DataFrame({"id": ids, "links": links, "root": root})[links > 0]


def _dense_links(rows: DataFrame, tokens: DataFrame, threshold: int, limits: Limits) -> DataFrame:
    """(id, links, root) over the keys of ``rows`` (key, id, place, n, tokens_in_key), by pairs of blocks of lines."""
    sizes = rows.groupBy("key").agg(F.ceil(F.greatest(F.count("*") / limits.lines, F.sum("n") / limits.tokens)).cast("int").alias("blocks"))
    dealt = rows.join(sizes, "key").withColumn("block", F.pmod(F.xxhash64("id"), F.col("blocks")).cast("int"))
    others = F.transform(F.sequence(F.lit(0), F.col("blocks") - 1), lambda o: F.struct(F.least(o, "block").alias("i"), F.greatest(o, "block").alias("j"), (F.col("block") > o).cast("int").alias("side")))
    dealt = dealt.join(tokens.select("id", "tokens"), "id").select("key", "id", "place", "tokens_in_key", "tokens", F.explode(others).alias("o")).select("key", "id", "place", "tokens_in_key", "tokens", "o.*")
    return dealt.groupBy("key", "i", "j").applyInPandas(lambda pdf: _verify_block(pdf, threshold), "id long, links long, root long")


def similar_lines(docs: DataFrame, threshold: int = 80, min_tokens: int = 5, limits: Limits = Limits(), bits: int = 22) -> DataFrame:
    """(line, doc_id, text_id, number, class_id, links, first_doc, first_text, first_number) of the lines of ``docs`` (doc_id, text_id, text) that occur more than once.

    class_id is a name shared by all lines that links of Jaccard >= threshold % join, links the number of all
    other token sets with which the line is linked, and first_* the first occurrence in the class. Token counts use 2**bits cells.
    """
    joined = max(min_tokens, _least_joined(threshold))
    rarity = token_rarity(docs, bits)
    lines = keep(index_lines(docs, rarity, bits, threshold, min_tokens, limits.few))
    place = F.struct("doc_id", "text_id", "number")
    seen = keep(lines.groupBy("line").agg(F.min(place).alias("first"), F.count("*").alias("times")))

    met = keep(_key_rows(lines).repartition("key").sortWithinPartitions("key").mapInArrow(lambda batches: _meet(batches, threshold, limits), "key long, a long, b long, place_a long, place_b long, tokens long"), 50_000)
    places = keep(lines.select("line", "doc_id", "text_id", "number"))
    discard(lines)
    tidy(docs.sparkSession)
    pairs = met.where("b is not null").select("a", "b", "place_a", "place_b", "tokens")
    dense = met.where("b is null").select("key", F.col("a").alias("id"), F.col("place_a").alias("place"), F.col("place_b").alias("n"), F.col("tokens").alias("tokens_in_key")).dropDuplicates(["key", "id"])

    ids = met.select(F.explode(F.array("a", "b")).alias("id")).where("id is not null").distinct()
    wanted = keep(ids.join(seen.select(F.col("line").alias("id"), "first.*"), "id"))
    tokens = keep(line_tokens(docs, wanted, rarity, bits, joined))
    wide = [tokens.select(F.col("id").alias(x), F.col("n").alias(f"n_{x}"), F.col("wide").alias(f"w_{x}")) for x in "ab"]
    apart = sum((F.bit_count(F.get("w_a", F.lit(k)).bitwiseXOR(F.get("w_b", F.lit(k)))) for k in range(_WIDE)), F.lit(0))
    total = F.col("n_a") + F.col("n_b")
    pairs = pairs.join(wide[0], "a").join(wide[1], "b").where(apart <= total - 2 * F.ceil(threshold * total / F.lit(100 + threshold))).select("a", "b", "place_a", "place_b", "tokens")
    both = pairs.join(tokens.select(F.col("id").alias("a"), F.col("tokens").alias("ta")), "a").join(tokens.select(F.col("id").alias("b"), F.col("tokens").alias("tb")), "b")
    common = F.size(F.array_intersect("ta", "tb"))
    heads = F.size(F.array_intersect(F.slice("ta", F.lit(1), F.col("place_a").cast("int") + 1), F.slice("tb", F.lit(1), F.col("place_b").cast("int") + 1)))
    near = (heads == F.col("tokens")) & (100 * common >= threshold * (F.size("ta") + F.size("tb") - common))
    single = keep(both.where(near).select("a", "b"))
    blocks = keep(_dense_links(dense, tokens, threshold, limits))
    discard(met, wanted, tokens)
    del pairs, dense, ids, both
    tidy(docs.sparkSession)

    found = components(single.unionByName(blocks.where("id <> root").select(F.col("id").alias("a"), F.col("root").alias("b"))))
    one = F.lit(1).cast("long").alias("links")
    degree = single.select(F.col("a").alias("line"), one).unionByName(single.select(F.col("b").alias("line"), one)).unionByName(blocks.select(F.col("id").alias("line"), "links"))
    degree = degree.groupBy("line").agg(F.sum("links").alias("links"))
    linked = found.select(F.col("id").alias("line"), "component").join(degree, "line", "left")
    named = seen.join(linked, "line", "left").where("times > 1 or component is not null")
    named = keep(named.select("line", F.coalesce("component", "line").alias("class_id"), F.coalesce("links", F.lit(0)).alias("links"), "first"))
    firsts = named.groupBy("class_id").agg(F.min("first").alias("first"))
    classes = named.drop("first").join(firsts, "class_id")
    classes = classes.select("line", "class_id", "links", F.col("first.doc_id").alias("first_doc"), F.col("first.text_id").alias("first_text"), F.col("first.number").alias("first_number"))
    hits = keep(places.join(classes, "line"))
    discard(places, seen, single, blocks, named)
    del found, degree, linked, firsts, classes
    tidy(docs.sparkSession)
    return hits


def dedup_lines(docs: DataFrame, threshold: int = 80, min_tokens: int = 5, limits: Limits = Limits()) -> DataFrame:
    """``docs`` with every line removed that repeats an earlier one, and what was found.

    A line is a stretch of text between newlines; its tokens are its distinct words (A-Z
    lower-cased), known by 64-bit hashes. Lines of at least ``min_tokens`` tokens whose sets have a Jaccard similarity of
    ``threshold`` % or more are linked; of each class that links join, the first line in order of
    (doc_id, hash of the text, line number) stays and all later ones go. Shorter lines stay; with 1 no line but blank ones is left out.

    Adds line_count, removed_count, lines_left (those of the rest that are not blank), line_classes (ids of the classes in which the row took part)
    and line_links (for each of its lines in such a class, all different lines with which it is linked). Input columns of these names
    are replaced; all others, of any name, pass unchanged.

    Defined cases: a null text stays null with 0 lines; an empty text has one empty line; rows
    without doc_id pass unchanged; rows that share a doc_id are told apart by their texts, and rows equal in both are
    treated alike; an empty table gives an empty table; a very long line or text is one like any other.
    """
    made = ("line_count", "removed_count", "lines_left", "line_classes", "line_links")
    base = docs.select(*[c for c in docs.columns if c not in made])
    clear = "_" * (1 + max((len(c) for c in base.columns), default=0))  # begins no column of the input
    doc, name, found, lines = (f"{clear}{x}" for x in ("doc", "text", "found", "lines"))
    rows = base.withColumns({doc: F.col("doc_id").cast("long"), name: F.xxhash64(F.col("text").cast("string"))})
    texts = rows.select(F.col(doc).alias("doc_id"), F.col(name).alias("text_id"), F.col("text").cast("string").alias("text")).where("doc_id is not null and text is not null")
    hits = similar_lines(texts, threshold, min_tokens, limits, rarity_bits(docs))
    later = (F.col("doc_id") != F.col("first_doc")) | (F.col("text_id") != F.col("first_text")) | (F.col("number") != F.col("first_number"))
    per_row = hits.groupBy("doc_id", "text_id").agg(
        F.struct(F.collect_set(F.when(later, F.col("number"))).alias("gone"), F.sort_array(F.collect_set("class_id")).alias("classes"), F.sum("links").alias("links")).alias(found)
    )
    out = rows.join(per_row.withColumnsRenamed({"doc_id": doc, "text_id": name}), [doc, name], "left")
    out = out.withColumn(lines, F.split(F.col("text"), "\n", -1))  # a column, so that it is split once
    parts, gone = F.col(lines), F.col(found)["gone"]
    kept = F.array_except(F.sequence(F.lit(0), F.size(parts) - 1), gone)
    text = F.when(F.size(gone) > 0, F.array_join(F.transform(kept, lambda k: F.get(parts, k)), "\n")).otherwise(F.col("text"))
    return out.select(
        *[text.alias("text") if c == "text" else F.col(f"`{c}`") for c in base.columns],
        F.when(F.col("text").isNull(), 0).otherwise(F.size(parts)).cast("long").alias("line_count"),
        F.greatest(F.size(gone), F.lit(0)).cast("long").alias("removed_count"),
        F.greatest(F.size(F.filter(F.when(F.size(gone) > 0, kept).otherwise(F.sequence(F.lit(0), F.size(parts) - 1)), lambda k: F.get(parts, k).rlike("[^ \t-\r]"))), F.lit(0)).cast("long").alias("lines_left"),
        F.coalesce(F.col(found)["classes"], F.array().cast("array<bigint>")).alias("line_classes"),
        F.coalesce(F.col(found)["links"], F.lit(0)).cast("long").alias("line_links"),
    )
