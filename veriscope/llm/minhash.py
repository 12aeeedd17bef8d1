"""MinHash near-duplicates with circulant signatures, banding and exact verification."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .hashing import list_column, mix, shingle_sets
from .idfilter import cells, id_filter
from .links import connect
from .store import discard, keep

_BITS = 22
#: Sets longer than this are hashed in blocks, so that the work table of a task stays small.
_BLOCK = 2048


def _permute(x: np.ndarray) -> np.ndarray:
    """The second permutation: a bijection of the 2**32 positions."""
    x ^= x >> np.uint32(16)
    x *= np.uint32(0x7FEB352D)
    x ^= x >> np.uint32(15)
    x *= np.uint32(0x846CA68B)
    x ^= x >> np.uint32(16)
    return x


def circulant_signature(shingles: np.ndarray, size: int) -> np.ndarray:
    """``size`` coordinates from two permutations.

    The first sends a shingle to a position among 2**32; coordinate k is the least image, under the
    second, of the positions shifted circularly by k.
    """
    position = (shingles >> np.uint64(32)).astype(np.uint32)
    out = np.full(size, 0xFFFFFFFF, np.uint32)
    shift = np.arange(size, dtype=np.uint32)[:, None]
    for a in range(0, len(position), _BLOCK):
        np.minimum(out, _permute(position[None, a : a + _BLOCK] + shift).min(axis=1), out=out)
    return out


def _band_keys(signature: np.ndarray, rows: int) -> np.ndarray:
    table = signature.reshape(-1, rows).astype(np.uint64)
    key = np.arange(len(table), dtype=np.uint64)
    for j in range(rows):
        key = mix(key * np.uint64(0x9E3779B97F4A7C15) + table[:, j])
    return key.view(np.int64)


#: Words of 64 bits in a set's bitmap.
_BITMAP = 16


def _bitmap(shingles: np.ndarray) -> np.ndarray:
    """Exclusive or of one bit for each shingle: its Hamming distance never exceeds the symmetric difference."""
    out = np.zeros(_BITMAP, np.uint64)
    np.bitwise_xor.at(out, ((shingles >> np.uint64(6)) % np.uint64(_BITMAP)).astype(np.int64), np.uint64(1) << (shingles & np.uint64(63)))
    return out.view(np.int64)


_FIRST = np.uint64(0xA5A5A5A5A5A5A5A5)


def _set_hash(shingles: np.ndarray, seed: np.uint64) -> int:
    return int(mix(shingles ^ seed).sum(dtype=np.uint64).view(np.int64))


def signatures(docs: DataFrame, shingle: int = 5, bands: int = 20, rows: int = 4) -> DataFrame:
    """(doc_id, place, n_shingles, h1, bands, bitmap): size and hash of each document's set, its band keys and bitmap.

    Equal sets have equal hashes h1; place tells rows of one doc_id but different texts apart. An empty set has no bands.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n, h1, keys, maps = [], [], [], []
            for own in shingle_sets(batch.column(2), shingle):
                n.append(len(own))
                h1.append(_set_hash(own, _FIRST))
                keys.append(_band_keys(circulant_signature(own, bands * rows), rows) if len(own) else own.view(np.int64))
                maps.append(_bitmap(own))
            columns = [pa.array(n, pa.int64()), pa.array(h1, pa.int64()), list_column(keys, pa.int64()), list_column(maps, pa.int64())]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), *columns], ["doc_id", "place", "n_shingles", "h1", "bands", "bitmap"])

    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    docs = docs.select("doc_id", F.xxhash64("doc_id", "text").alias("place"), "text")
    return docs.mapInArrow(run, "doc_id long, place long, n_shingles long, h1 long, bands array<long>, bitmap array<long>")


def shingle_table(docs: DataFrame, wanted: DataFrame, shingle: int = 5) -> DataFrame:
    """(id, shingles): the sets named ``wanted``.id, from the rows at ``wanted``.place; a bitmap of fixed size spares other rows the shuffle."""
    allowed = id_filter(wanted, "place", _BITS)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            batch = batch.filter(pa.array(allowed.value[cells(batch.column(0).to_numpy(zero_copy_only=False).astype(np.int64), _BITS)] > 0))
            if batch.num_rows:
                made = list(shingle_sets(batch.column(1), shingle))
                yield pa.RecordBatch.from_arrays([pa.array([_set_hash(x, _FIRST) for x in made], pa.int64()), list_column(made, pa.int64())], ["id", "shingles"])

    rows = docs.where("doc_id is not null").select(F.xxhash64(F.col("doc_id").cast("long"), F.col("text").cast("string")).alias("place"), F.col("text").cast("string").alias("text"))
    return rows.mapInArrow(run, "id long, shingles array<long>").join(wanted.select("id").distinct(), "id", "left_semi")


def near_duplicates(docs: DataFrame, threshold: int = 85, shingle: int = 5, bands: int = 20, rows: int = 4, large: int = 16, block: int = 2048, elements: int = 65_536) -> DataFrame:
    """Class of near-duplicates of every document of ``docs`` (doc_id, text, ...).

    Two documents are linked if 100 * |A & B| >= threshold * |A | B| on their full sets of distinct
    ``shingle``-word shingles (A-Z lower-cased, words split at space and tab..carriage return; fewer
    words: the whole sequence is the one shingle). Returns per input row (doc_id, n_shingles,
    component_id, kept): component_id is the least doc_id that links reach, kept says that it is
    the row's own.

    Defined cases: a null, empty or blank text has the empty set and is linked with nothing; equal
    sets are one node of the graph, named by a hash of 64 bits; a null doc_id takes no part, has a null component_id and is
    kept; rows that share a doc_id are each judged by their own text; other columns, of any name, are ignored; an empty
    table gives an empty table; a very long text is one like any other.

    The band keys of a pair at the threshold agree at least once with probability above
    1 - 4e-7 (20 bands of 4 coordinates, 0.85). In buckets of over ``large`` members each set's
    number of shingles that no other such set has bounds every pair's similarity, and in all buckets the
    sets' bitmaps do: both prune large groups of loosely similar texts exactly. block and elements: see :func:`connect`.
    """
    sig = keep(signatures(docs, shingle, bands, rows))
    real = sig.where("n_shingles > 0 and doc_id is not null")
    nodes = keep(real.groupBy("h1").agg(F.min(F.struct("doc_id", "place")).alias("rep")).select(F.col("h1").alias("id"), "rep.*"))
    one = real.join(nodes.select(F.col("id").alias("h1"), "place"), ["h1", "place"], "left_semi").dropDuplicates(["h1"])
    spread = one.select(F.explode("bands").alias("bucket"), F.col("h1").alias("id"), F.col("n_shingles").alias("n"), "bitmap")
    sizes = spread.groupBy("bucket").agg(F.count("*").alias("size")).where("size > 1")
    members = keep(spread.join(sizes, "bucket"))
    wanted = keep(members.select("id").distinct().join(nodes, "id").select("id", "place"))
    sets = keep(shingle_table(docs, wanted, shingle).dropDuplicates(["id"]))

    big = members.where(F.col("size") > large).select("id").distinct()
    owners = sets.join(big, "id", "left_semi").select("id", F.explode("shingles").alias("s")).groupBy("s").agg(F.min("id").alias("id"), F.count("*").alias("c"))
    own = owners.where("c = 1").groupBy("id").agg(F.count("*").alias("u"))
    told = keep(members.join(own, "id", "left").select("bucket", "id", "n", "bitmap", F.when(F.col("size") > large, F.coalesce("u", F.lit(0))).otherwise(F.lit(0)).cast("long").alias("u")))
    discard(members, wanted)

    found = connect(told, sets, threshold, block, elements)
    discard(told, sets)
    named = nodes.select("id", F.col("doc_id").alias("rep")).join(found, "id", "left").withColumn("class", F.coalesce("component", "id"))
    least = named.groupBy("class").agg(F.min("rep").alias("component"))
    classes = keep(named.select(F.col("id").alias("h1"), "class").join(least, "class").select("h1", "component"))
    discard(nodes)
    out = sig.select("doc_id", "n_shingles", "h1").join(classes, "h1", "left")
    component = F.when(F.col("n_shingles") > 0, F.coalesce("component", "doc_id")).otherwise(F.col("doc_id"))
    component = F.when(F.col("doc_id").isNotNull(), component)
    return out.select("doc_id", "n_shingles", component.alias("component_id"), F.coalesce(F.col("doc_id") == component, F.lit(True)).alias("kept"))


def drop_near_duplicates(docs: DataFrame, **options) -> DataFrame:
    """``docs`` with one document of each class of :func:`near_duplicates`, all columns as they were.

    Rows without doc_id and rows without words stay; rows that share a doc_id stay or go together; an empty table stays empty.
    """
    gone = keep(near_duplicates(docs, **options).where("not kept").select(F.col("doc_id").alias("gone")).distinct())  # a table of known size, so that a short list spares the texts a shuffle
    return docs.join(gone, docs["doc_id"].cast("long") == gone["gone"], "left_anti")
