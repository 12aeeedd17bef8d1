"""Vectorised word, shingle and set hashing over the buffers of Arrow string columns.

Everything here runs inside Arrow tasks; Spark partitions and shuffles the work.
A word is a maximal run of bytes outside space and tab..carriage return, A-Z lower-cased.
Its hash is a polynomial over random byte codes modulo 2**64, so that one prefix sum over a
piece of text serves all of its words.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa

#: Bytes hashed at once; a longer text is cut at white space, so memory stays bounded.
PIECE = 1 << 18
_RNG = np.random.Generator(np.random.PCG64(20240229))
_CODE = _RNG.integers(1, 2**63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
for _b in range(ord("A"), ord("Z") + 1):
    _CODE[_b] = _CODE[_b + 32]
_BASE = 0x9E3779B97F4A7C15
_INVERSE = pow(_BASE, -1, 2**64)
STEP = _RNG.integers(1, 2**63, 8, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
SPACE = np.zeros(256, bool)
SPACE[[9, 10, 11, 12, 13, 32]] = True


def _powers(base: int, n: int) -> np.ndarray:
    out = np.full(n, base, np.uint64)
    out[:1] = 1
    return np.multiply.accumulate(out)


_UP = _powers(_BASE, 1 << 16)
_DOWN = _powers(_INVERSE, 1 << 16)


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective finaliser of 64 bits."""
    x = x ^ (x >> np.uint64(33))
    x = x * np.uint64(0xFF51AFD7ED558CCD)
    x ^= x >> np.uint64(29)
    x *= np.uint64(0xC4CEB9FE1A85EC53)
    x ^= x >> np.uint64(32)
    return x


def text_buffers(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets) of a string column; null counts as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = column.fill_null("")
    wide = pa.types.is_large_string(column.type)
    _, offsets, data = column.buffers()
    at = np.frombuffer(offsets, np.int64 if wide else np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    return (np.frombuffer(data, np.uint8) if data else np.zeros(0, np.uint8)), at


def pieces(data: np.ndarray, at: np.ndarray) -> Iterator[tuple[int, int]]:
    """Row ranges [i, j) with about PIECE bytes; at least one row each."""
    i, n = 0, len(at) - 1
    while i < n:
        j = max(i + 1, int(np.searchsorted(at, at[i] + PIECE, "right")) - 1)
        yield i, min(j, n)
        i = min(j, n)


def _hash_runs(data: np.ndarray, lo: int, hi: int, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Hashes of data[starts:ends] inside [lo, hi), the positions relative to lo."""
    global _UP, _DOWN
    n = hi - lo
    if n > len(_UP):
        _UP, _DOWN = _powers(_BASE, n), _powers(_INVERSE, n)
    sums = np.empty(n + 1, np.uint64)
    sums[0] = 0
    np.cumsum(_CODE[data[lo:hi]] * _UP[:n], out=sums[1:])
    return mix((sums[ends] - sums[starts]) * _DOWN[starts])


def words(data: np.ndarray, at: np.ndarray, separator: np.ndarray = SPACE, seams: Callable[[np.ndarray], np.ndarray] | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(hash, start, end) of each word of the rows that ``at`` bounds; no word crosses a row.

    seams: says for some bytes where, besides, a word ends and the next begins (a flag for each byte but the first).
    """
    lo, hi = int(at[0]), int(at[-1])
    cuts = [lo]
    while hi - cuts[-1] > 4 * PIECE:  # very long rows
        gap = np.flatnonzero(separator[data[cuts[-1] + PIECE : min(hi, cuts[-1] + 3 * PIECE)]])
        if not len(gap):
            break
        cuts.append(cuts[-1] + PIECE + int(gap[0]))
    cuts.append(hi)
    hashes, firsts, lasts = [], [], []
    for a, b in zip(cuts, cuts[1:], strict=False):
        if a == b:
            continue
        inside = ~separator[data[a:b]]
        edge = np.zeros(b - a + 1, bool)
        edge[at[(at >= a) & (at <= b)] - a] = True
        if seams is not None:
            edge[1:-1] |= seams(data[a:b])
        first = inside.copy()
        first[1:] &= ~inside[:-1] | edge[1:-1]
        last = inside
        last[:-1] &= ~inside[1:] | edge[1:-1] if len(last) > 1 else True
        starts = np.flatnonzero(first)
        ends = np.flatnonzero(last) + 1
        hashes.append(_hash_runs(data, a, b, starts, ends))
        firsts.append(starts + a)
        lasts.append(ends + a)
    if not hashes:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0, np.int64)
    return np.concatenate(hashes), np.concatenate(firsts), np.concatenate(lasts)


def shingles(hashes: np.ndarray, bounds: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """(shingle hashes, bounds by row). A row of fewer than ``size`` words gives its whole sequence once."""
    count = np.diff(bounds)
    n_out = np.where(count >= size, count - size + 1, (count > 0).astype(count.dtype))
    total = np.concatenate([[0], np.cumsum(n_out)])
    m = len(hashes)
    out = np.empty(int(total[-1]), np.uint64)
    rolled = hashes[: max(0, m - size + 1)] * STEP[0]
    for j in range(1, size):
        rolled += hashes[j : m - size + 1 + j] * STEP[j]
    long = count >= size
    index = np.arange(int(total[-1])) - np.repeat(total[:-1], n_out) + np.repeat(bounds[:-1], n_out)
    of_long = np.repeat(long, n_out)
    out[of_long] = rolled[index[of_long]]
    for row in np.flatnonzero((count > 0) & ~long):
        seq = hashes[bounds[row] : bounds[row + 1]]
        out[total[row]] = (seq * STEP[: len(seq)]).sum(dtype=np.uint64) ^ STEP[5 + len(seq) % 3]
    return mix(out), total


def shingle_sets(column: pa.Array, size: int = 5) -> Iterator[np.ndarray]:
    """For each row of a string column its sorted distinct shingle hashes."""
    data, at = text_buffers(column)
    for i, j in pieces(data, at):
        hashes, starts, _ = words(data, at[i : j + 1])
        bounds = np.searchsorted(starts, at[i : j + 1])
        made, total = shingles(hashes, bounds, size)
        for row in range(j - i):
            own = np.sort(made[total[row] : total[row + 1]])
            yield own[np.concatenate([[True], own[1:] != own[:-1]])] if len(own) else own


def list_column(arrays: list[np.ndarray], kind: pa.DataType) -> pa.ListArray:
    """Arrow list column of the given rows."""
    offsets = np.zeros(len(arrays) + 1, np.int32)
    np.cumsum([len(x) for x in arrays], out=offsets[1:])
    flat = np.concatenate(arrays) if arrays else np.zeros(0, np.int64)
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(flat.astype(np.int64, copy=False).view(np.int64), kind))
