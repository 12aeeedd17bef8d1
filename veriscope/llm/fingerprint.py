"""Bottom-k sketches of shingle hashes: document fingerprints that merge."""

from __future__ import annotations

import base64
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .hashing import shingle_sets

SIZE = 128


def encode(sketch: np.ndarray) -> str:
    """Text form of a sketch: its hashes, ascending, little-endian, in base 64."""
    return base64.b64encode(sketch.astype("<u8").tobytes()).decode()


def decode(text: str) -> np.ndarray:
    return np.frombuffer(base64.b64decode(text), "<u8")


def merge(a: np.ndarray, b: np.ndarray, size: int = SIZE) -> np.ndarray:
    """Sketch of the union of the two sketched sets."""
    return np.union1d(a, b)[:size]


def resemblance(a: np.ndarray, b: np.ndarray, size: int = SIZE) -> float:
    """Estimated Jaccard similarity; exact where the union has at most ``size`` shingles; 1 for two empty sets."""
    union = merge(a, b, size)
    if not len(union):
        return 1.0
    return len(np.intersect1d(np.intersect1d(a, b, True), union, True)) / len(union)


def distinct(a: np.ndarray, size: int = SIZE) -> float:
    """Estimated number of distinct shingles; exact below ``size``."""
    return float(len(a)) if len(a) < size else (size - 1) / ((float(a[-1]) + 1) / 2.0**64)


def containment(a: np.ndarray, b: np.ndarray, size: int = SIZE) -> float:
    """Estimated share of a's shingles that b has; 1 for an empty a.

    Judged on a's sketch below the hash up to which b's sketch is complete.
    """
    if not len(a):
        return 1.0
    known = a if len(b) < size else a[a <= b[-1]]
    if not len(known):
        return min(1.0, resemblance(a, b, size) * (distinct(a, size) + distinct(b, size)) / (1 + resemblance(a, b, size)) / distinct(a, size))
    return len(np.intersect1d(known, b, True)) / len(known)


def fingerprints(docs: DataFrame, key: str = "doc_id", size: int = SIZE, shingle: int = 5) -> DataFrame:
    """(key, fingerprint, distinct_shingles) of the whole ``text`` of each row; null counts as empty."""
    kind = docs.schema[key].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            made = [s[:size] for s in shingle_sets(batch.column(1), shingle)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([encode(s) for s in made], pa.string()), pa.array([distinct(s, size) for s in made], pa.float64())], [key, "fingerprint", "distinct_shingles"])

    return docs.select(key, F.col("text").cast("string").alias("text")).mapInArrow(run, f"`{key}` {kind}, fingerprint string, distinct_shingles double")


def merge_fingerprints(prints: DataFrame, by: str, size: int = SIZE, spread: int = 32) -> DataFrame:
    """(by, fingerprint, distinct_shingles) of the unions of the groups' texts.

    Sketches first merge within a partition and in ``spread`` salted parts, so that a group that
    holds most rows never meets in one task as more than ``spread`` sketches.
    """
    kind = prints.schema[by].dataType.simpleString()

    def partial(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: dict = {}
        for pdf in frames:
            for name, text in zip(pdf[by].astype(object).where(pdf[by].notna(), None), pdf["fingerprint"], strict=True):
                held[name] = merge(held.get(name, np.zeros(0, np.uint64)), decode(text or ""), size)
            if len(held) > 50_000:
                yield pd.DataFrame({by: list(held), "fingerprint": [encode(s) for s in held.values()]})
                held = {}
        yield pd.DataFrame({by: list(held), "fingerprint": [encode(s) for s in held.values()]})

    def whole(pdf: pd.DataFrame) -> pd.DataFrame:
        union = np.zeros(0, np.uint64)
        for text in pdf["fingerprint"]:
            union = merge(union, decode(text), size)
        return pd.DataFrame({by: [pdf[by].iloc[0]], "fingerprint": [encode(union)], "distinct_shingles": [distinct(union, size)]})

    parts = prints.select(by, "fingerprint").mapInPandas(partial, f"`{by}` {kind}, fingerprint string")
    salted = parts.withColumn("salt", F.pmod(F.xxhash64("fingerprint"), F.lit(spread)))
    schema = f"`{by}` {kind}, fingerprint string, distinct_shingles double"
    return salted.groupBy(by, "salt").applyInPandas(whole, schema).groupBy(by).applyInPandas(whole, schema)


def _with_next(docs: DataFrame, rows_a_bucket: int, most_buckets: int) -> DataFrame:
    """(doc_id, text, next_text), the next row in ascending (doc_id, hash of text), the first after the last.

    Rows are cut into ranges of doc_id; each range also gets the first row of the range after it, so
    no window spans the table. At most ``most_buckets`` range bounds reach the driver.
    """
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    n = docs.count()
    buckets = int(min(most_buckets, max(1, n // rows_a_bucket)))
    cuts = []
    if buckets > 1:
        cuts = docs.approxQuantile("doc_id", [k / buckets for k in range(1, buckets)], max(1e-4, 0.25 / buckets))
    cuts = sorted({int(c) for c in cuts})
    bucket = _bisect(cuts)
    ranged = docs.withColumn("bucket", bucket.cast("int"))
    order = F.struct(F.col("doc_id").isNotNull().alias("o"), F.col("doc_id"), F.xxhash64("text").alias("h"))
    firsts = [r for r in ranged.groupBy("bucket").agg(F.min(F.struct(F.col("doc_id").isNotNull().alias("o"), "doc_id")).alias("f")).orderBy("bucket").toLocalIterator()]
    if not firsts:
        return docs.withColumn("next_text", F.col("text"))
    at = {r["bucket"]: r["f"]["doc_id"] for r in firsts}
    names = list(at)
    follows = {names[k - 1]: at[b] for k, b in enumerate(names)}
    heads = docs.where(F.col("doc_id").isin([x for x in at.values() if x is not None]) | (F.col("doc_id").isNull() if None in at.values() else F.lit(False)))
    heads = heads.groupBy("doc_id").agg(F.min_by("text", F.xxhash64("text")).alias("text"))
    where = docs.sparkSession.createDataFrame([(b, x) for b, x in follows.items()], "bucket int, doc_id long")
    tails = where.join(heads, where["doc_id"].eqNullSafe(heads["doc_id"])).select(heads["doc_id"], "text", "bucket", F.lit(True).alias("tail"))
    rows = ranged.withColumn("tail", F.lit(False)).unionByName(tails)
    window = Window.partitionBy("bucket").orderBy("tail", order)
    return rows.withColumn("next_text", F.lead("text").over(window)).where("not tail").select("doc_id", "text", "next_text")


def _bisect(cuts: list[int]) -> Column:
    """Number of ``cuts`` not above doc_id, as a search tree of comparisons of depth log2."""

    def tree(lo: int, hi: int) -> Column:
        if lo == hi:
            return F.lit(lo)
        mid = (lo + hi) // 2
        return F.when(F.col("doc_id") >= cuts[mid], tree(mid + 1, hi)).otherwise(tree(lo, mid))

    return tree(0, len(cuts))


def edited(docs: DataFrame, rows_a_bucket: int = 2000, most_buckets: int = 4096) -> DataFrame:
    """(doc_id, n_chars, edited_sha256, text, edited, next_text) of each of ``docs``, without Python."""
    rows = _with_next(docs, rows_a_bucket, most_buckets).withColumn("n_chars", F.length("text").cast("long"))
    cut = F.floor(F.col("n_chars") / 4).cast("int")
    rows = rows.withColumn("edited", F.concat(F.substring("text", F.lit(1), F.col("n_chars").cast("int") - cut), F.substring("next_text", F.lit(1), cut)))
    return rows.select("doc_id", "n_chars", F.sha2("edited", 256).alias("edited_sha256"), "text", "edited", "next_text")


def edited_likeness(docs: DataFrame, size: int = SIZE, shingle: int = 5, rows_a_bucket: int = 2000, most_buckets: int = 4096) -> DataFrame:
    """Fingerprints of each text, of its edited text and their likeness to it and to the next document.

    The edited text is the text whose last floor(n_chars / 4) code points are replaced by the first
    as many (or all) of the next document's. Returns (doc_id, n_chars, edited_sha256, fingerprint,
    edited_fingerprint, near_edited, near_next, contained_edited, distinct_shingles), one row for
    each of ``docs``.

    Defined cases: null texts count as empty; empty texts have the empty fingerprint and likeness 1
    to each other, 0 to others; a null doc_id sorts first; rows that share a doc_id follow each other in
    order of a hash of their texts; a table of one row is its own next document; an empty table gives
    an empty table; other columns are ignored.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (whole.slice(k, 256) for whole in batches for k in range(0, whole.num_rows, 256)):  # sketches of few texts at once
            own, changed, after = ([s[:size] for s in shingle_sets(batch.column(k), shingle)] for k in (3, 4, 5))
            yield pa.RecordBatch.from_arrays(
                [
                    *batch.columns[:3],
                    pa.array([encode(s) for s in own], pa.string()),
                    pa.array([encode(s) for s in changed], pa.string()),
                    pa.array([resemblance(a, b, size) for a, b in zip(own, changed, strict=True)], pa.float64()),
                    pa.array([resemblance(a, b, size) for a, b in zip(own, after, strict=True)], pa.float64()),
                    pa.array([containment(a, b, size) for a, b in zip(own, changed, strict=True)], pa.float64()),
                    pa.array([distinct(a, size) for a in own], pa.float64()),
                ],
                ["doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next", "contained_edited", "distinct_shingles"],
            )

    rows = edited(docs, rows_a_bucket, most_buckets)
    return rows.mapInArrow(run, "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double, contained_edited double, distinct_shingles double")
