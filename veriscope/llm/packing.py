"""Best-fit packing of token sequences, planned on the histogram of lengths."""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .hashing import SPACE, pieces, text_buffers, words
from .store import keep

_LETTER = np.zeros(256, bool)
_LETTER[[*range(65, 91), *range(97, 123)]] = True
_MARK = np.zeros(256, bool)
_MARK[[c for c in range(33, 127) if not chr(c).isalnum() and chr(c) != "'"]] = True
#: Different words remembered by a Python worker.
_REMEMBERED = 1_000_000
#: Segments of the plan up to which it is broadcast: about 10 MB.
_BROADCAST = 100_000


def _seams(data: np.ndarray) -> np.ndarray:
    """Between an ASCII letter and an ASCII mark that is no apostrophe, where the tokenizer's own splitting cuts too."""
    letter, mark = _LETTER[data], _MARK[data]
    return (letter[:-1] & mark[1:]) | (mark[:-1] & letter[1:])


@lru_cache(maxsize=2)
def _tokenizer(path: str):
    from tokenizers import Tokenizer

    return Tokenizer.from_file(path)


class WordIds:
    """Token ids of texts. The tokenizer drops white space and joins nothing across it, so each different word is encoded once."""

    def __init__(self, path: str) -> None:
        self.tokenizer = _tokenizer(path)
        self.seam, self.seam_id = next((t.content, k) for k, t in sorted(self.tokenizer.get_added_tokens_decoder().items()) if t.special)
        self.special = [t.content[:2].encode() for t in self.tokenizer.get_added_tokens_decoder().values()]
        self._forget()

    def _forget(self) -> None:
        self.names = np.zeros(0, np.uint64)
        self.index = np.zeros(0, np.int64)
        self.flat = np.zeros(1 << 16, np.uint32)
        self.first = np.zeros(1 << 16, np.int64)
        self.size = np.zeros(1 << 16, np.int64)
        self.end = 0

    def _learn(self, names: np.ndarray, texts: list[str]) -> None:
        """Encode new words, a special token between them, in one call; ``names`` ascend."""
        coded = np.array(self.tokenizer.encode(self.seam.join(texts), add_special_tokens=False).ids, np.uint32)
        cuts = np.flatnonzero(coded == self.seam_id)
        size = np.diff(np.concatenate([[-1], cuts, [len(coded)]])) - 1
        ids = np.delete(coded, cuts)
        known = len(self.names)
        while self.end + len(ids) > len(self.flat):
            self.flat = np.concatenate([self.flat, np.zeros_like(self.flat)])
        while known + len(names) > len(self.first):
            self.first, self.size = (np.concatenate([x, np.zeros_like(x)]) for x in (self.first, self.size))
        self.flat[self.end : self.end + len(ids)] = ids
        self.first[known : known + len(names)] = self.end + np.cumsum(size) - size
        self.size[known : known + len(names)] = size
        self.end += len(ids)
        at = np.searchsorted(self.names, names)
        self.names = np.insert(self.names, at, names)
        self.index = np.insert(self.index, at, np.arange(known, known + len(names)))

    def encode(self, column: pa.Array) -> Iterator[np.ndarray]:
        data, at = text_buffers(column)
        for i, j in pieces(data, at):
            raw = data[at[i] : at[j]].tobytes()
            if any(t in raw for t in self.special):  # spelt-out special tokens: upper and lower case apart
                for row in range(i, j):
                    text = data[at[row] : at[row + 1]].tobytes().decode()
                    yield np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, np.uint32)
                continue
            hashes, starts, ends = words(data, at[i : j + 1], SPACE, _seams)
            names, sample, which = np.unique(hashes, return_index=True, return_inverse=True)
            if len(self.names) + len(names) > max(_REMEMBERED, len(names)):
                self._forget()
            at_name = np.searchsorted(self.names, names)
            new = np.ones(len(names), bool)
            inside = at_name < len(self.names)
            new[inside] = self.names[at_name[inside]] != names[inside]
            if new.any():
                lo = int(at[i])
                self._learn(names[new], [raw[a - lo : b - lo].decode(errors="replace") for a, b in zip(starts[sample[new]].tolist(), ends[sample[new]].tolist(), strict=True)])
                at_name = np.searchsorted(self.names, names)
            place = self.index[at_name][which] if len(names) else at_name
            size = self.size[place]
            before = np.concatenate([[0], np.cumsum(size)])
            flat = self.flat[np.repeat(self.first[place] - before[:-1], size) + np.arange(int(before[-1]))]
            bounds = before[np.searchsorted(starts, at[i : j + 1])]
            for row in range(j - i):
                yield flat[bounds[row] : bounds[row + 1]]


@lru_cache(maxsize=1)
def _coder(path: str) -> WordIds:
    """One for each Python worker, which serves many tasks."""
    return WordIds(path)


def token_pieces(docs: DataFrame, tokenizer: str, capacity: int = 2048, end_id: int = 0, with_ids: bool = False) -> DataFrame:
    """(doc_id, piece, start, length, ids_crc32[, ids]): each document's ids and ``end_id``, cut into pieces of at most ``capacity``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = _coder(tokenizer)
        for batch in batches:
            row, piece, start, length, crc, ids = [], [], [], [], [], []
            for k, own in enumerate(coder.encode(batch.column(1))):
                own = np.append(own, np.uint32(end_id)).astype("<u4")
                for a in range(0, len(own), capacity):
                    part = own[a : a + capacity]
                    row.append(k)
                    piece.append(a // capacity)
                    start.append(a)
                    length.append(len(part))
                    crc.append(zlib.crc32(part.tobytes()))
                    if with_ids:
                        ids.append(part.astype(np.int64))
            columns = [batch.column(0).take(pa.array(row, pa.int64())), pa.array(piece, pa.int32()), pa.array(start, pa.int64()), pa.array(length, pa.int64()), pa.array(crc, pa.int64())]
            yield pa.RecordBatch.from_arrays(columns + ([pa.array(ids, pa.list_(pa.int64()))] if with_ids else []), names)

    names = ["doc_id", "piece", "start", "length", "ids_crc32", *["ids"] * with_ids]
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return docs.mapInArrow(run, "doc_id long, piece int, start long, length long, ids_crc32 long" + ", ids array<long>" * with_ids)


def plan(histogram: dict[int, int], capacity: int) -> list[tuple[int, int, int, int, int]]:
    """Best fit in decreasing length over counts: segments (length, first rank, count, first sequence, offset).

    All pieces of a length with ranks [first rank, first rank + count) go to consecutive sequences, at
    the same offset. Its work depends on the number of lengths, not on that of documents.
    """
    open_by_room: dict[int, list[list[int]]] = {}
    segments, sequences = [], 0
    for length in sorted((x for x, n in histogram.items() if n), reverse=True):
        left, rank = histogram[length], 0
        while left:
            room = min((r for r in open_by_room if r >= length), default=None)
            if room is None:
                fit = capacity // length
                first, many = sequences, -(-left // fit)
                sequences += many
                open_by_room.setdefault(capacity, []).append([first, many])
                room = capacity
            first, many = open_by_room[room].pop()
            fit = room // length
            used = min(many, left // fit)
            each = fit
            if not used:
                used, each = 1, left
            for k in range(each):
                segments.append((length, rank, used, first, capacity - room + k * length))
                rank += used
            left -= used * each
            if many > used:
                open_by_room[room].append([first + used, many - used])
            if not open_by_room[room]:
                del open_by_room[room]
            if after := room - each * length:
                open_by_room.setdefault(after, []).append([first, used])
    return segments


def pack(parts: DataFrame, capacity: int = 2048, rows_a_group: int = 20_000) -> DataFrame:
    """``parts`` (doc_id, piece, length, ...) with sequence_id and offset, each sequence filled from 0 without gaps.

    Only the histogram of lengths (at most ``capacity`` counts) reaches the driver. Ranks within a
    length are made in salted groups, so that a frequent length is spread over many tasks.
    """
    spark = parts.sparkSession
    histogram = {r["length"]: r["n"] for r in parts.groupBy("length").agg(F.count("*").alias("n")).toLocalIterator()}
    salts = max(1, -(-max(histogram.values(), default=1) // rows_a_group))
    segments = plan(histogram, capacity)
    parts = parts.withColumn("salt", F.pmod(F.xxhash64("doc_id", "piece", "start"), F.lit(salts)))
    sizes = parts.groupBy("length", "salt").agg(F.count("*").alias("n"))
    before = sizes.select("length", "salt", (F.sum("n").over(Window.partitionBy("length").orderBy("salt")) - F.col("n")).alias("before"))
    own = F.row_number().over(Window.partitionBy("length", "salt").orderBy("doc_id", "piece", "ids_crc32")) - 1
    ranked = parts.withColumn("own", own).join(before, ["length", "salt"]).withColumn("rank", F.col("own") + F.col("before"))
    planned = spark.createDataFrame(segments, "length long, first_rank long, many long, first_sequence long, offset long")
    if len(segments) <= _BROADCAST:
        planned = F.broadcast(planned)
    inside = (F.col("rank") >= F.col("first_rank")) & (F.col("rank") < F.col("first_rank") + F.col("many"))
    placed = ranked.join(planned, "length").where(inside).withColumn("sequence_id", F.col("first_sequence") + F.col("rank") - F.col("first_rank"))
    return placed.drop("salt", "own", "before", "rank", "first_rank", "many", "first_sequence")


def pack_documents(docs: DataFrame, tokenizer: str, capacity: int = 2048, end_id: int = 0, with_ids: bool = False, rows_a_group: int = 20_000) -> DataFrame:
    """Pack all of ``docs`` (doc_id, text, ...) into sequences of at most ``capacity`` tokens.

    Returns per piece (doc_id, piece, start, length, ids_crc32[, ids], sequence_id, offset). A
    document is its ids by the ``tokenizers`` file ``tokenizer`` followed by ``end_id``; only longer
    ones are cut, into pieces of ``capacity``.

    Defined cases: a null, empty or blank text is the one id ``end_id``; a null doc_id and repeated
    rows are packed like any others; other columns are ignored; an empty table gives an empty table.
    """
    return pack(keep(token_pieces(docs, tokenizer, capacity, end_id, with_ids)), capacity, rows_a_group)
