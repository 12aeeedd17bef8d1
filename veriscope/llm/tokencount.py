"""Token counts of texts through a cache of counts by digest of content and of tokenizer."""

from __future__ import annotations

import hashlib
import json
import os
import uuid
from collections.abc import Callable, Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .idfilter import cells, id_filter
from .store import keep, shared_folder, small_batches

#: Code points given to the tokenizer at once; a longer text is cut where that changes no count, if the tokenizer allows it.
PORTION = 1 << 18
#: Texts more frequent than one in so many rows get their count by a broadcast, so that none fills one task: fewer than so many.
HOT = 4096
_CACHED = "digest binary, n_tokens long"


def tokenizer_version(path: str) -> str:
    """SHA-256 of the tokenizer's file and of the name and version of the library that reads it."""
    if path.endswith(".model"):
        import sentencepiece as library
    else:
        import tokenizers as library
    with open(path, "rb") as file:
        return hashlib.sha256(f"{library.__name__} {library.__version__} ".encode() + hashlib.sha256(file.read()).digest()).hexdigest()


def cuts_at_blanks(path: str) -> bool:
    """Whether the tokenizer's own splitting always cuts before a blank between two letters: byte-level splitting without a prefix, no added token with blanks."""
    if not path.endswith(".json"):
        return False
    with open(path, encoding="utf-8") as file:
        told = json.load(file)
    splitter = told.get("pre_tokenizer") or {}
    plain = splitter.get("type") == "ByteLevel" and not splitter.get("add_prefix_space") and splitter.get("use_regex", True)
    return plain and told.get("normalizer") is None and not any(" " in t["content"] or t.get("lstrip") or t.get("rstrip") for t in told.get("added_tokens", []))


def portions(text: str, most: int = PORTION) -> Iterator[str]:
    """The text in parts of about ``most`` code points, each but the first beginning with a blank between two letters."""
    begin = 0
    while len(text) - begin > most:
        at = begin + most
        while at < len(text) - 1 and not (text[at] == " " and text[at - 1].isalpha() and text[at + 1].isalpha()):
            at += 1
        if at >= len(text) - 1:
            break
        yield text[begin:at]
        begin = at
    yield text[begin:]


@lru_cache(maxsize=2)
def counter(path: str) -> Callable[[list[str]], list[int]]:
    """Counts of tokens as the library gives them, without added begin or end, truncation or padding."""
    if path.endswith(".model"):
        import sentencepiece

        pieces = sentencepiece.SentencePieceProcessor(model_file=path)
        return lambda texts: [len(ids) for ids in pieces.encode(texts, num_threads=1)]
    os.environ["TOKENIZERS_PARALLELISM"] = "false"  # Spark's tasks are the parallel part
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(path)
    tokenizer.no_truncation()
    tokenizer.no_padding()
    return lambda texts: [len(e.ids) for e in tokenizer.encode_batch_fast(texts, add_special_tokens=False)]


def count_texts(texts: Iterator[str], path: str, cut: bool) -> Iterator[int]:
    """Counts of ``texts`` in order, with about PORTION code points in the tokenizer at a time."""
    count = counter(path)
    owners, held, size, totals, first = [], [], 0, {}, 0

    def flush() -> None:
        for owner, n in zip(owners, count(held), strict=True):
            totals[owner] = totals.get(owner, 0) + n

    for k, text in enumerate(texts):
        for part in portions(text) if cut else (text,):
            if held and size + len(part) > PORTION:
                flush()
                owners, held, size = [], [], 0
                for done in range(first, k):
                    yield totals.pop(done)
                first = k
            owners.append(k)
            held.append(part)
            size += len(part)
    if held:
        flush()
    for done in range(first, first + len(totals)):
        yield totals.pop(done)


def _folder(cache: str, version: str) -> str:
    return f"{cache.rstrip('/')}/version={version}"


def _exists(spark: SparkSession, path: str) -> bool:
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    return place.getFileSystem(spark._jsc.hadoopConfiguration()).exists(place)


def stored_counts(spark: SparkSession, cache: str, version: str) -> DataFrame:
    """(digest, n_tokens) of a tokenizer version. Runs that append at once may store a digest twice, which counts once."""
    path = _folder(cache, version)
    if not _exists(spark, path):
        return spark.createDataFrame([], _CACHED)
    return spark.read.schema(_CACHED).parquet(path).groupBy("digest").agg(F.max("n_tokens").alias("n_tokens"))


def append_counts(counts: DataFrame, cache: str, version: str) -> None:
    """Store (digest, n_tokens) in a folder of their own below the version's, so that runs that append at once do not meet."""
    with small_batches(counts.sparkSession):
        counts.write.parquet(f"{_folder(cache, version)}/batch={uuid.uuid4().hex}")


def compact_counts(spark: SparkSession, cache: str, version: str) -> None:
    """Write the stored batches of a version as one, then delete them; what others append meanwhile stays."""
    path = _folder(cache, version)
    if not _exists(spark, path):
        return
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    system = place.getFileSystem(spark._jsc.hadoopConfiguration())
    batches = [f.getPath() for f in system.listStatus(place) if f.getPath().getName().startswith("batch=")]
    rows = spark.read.schema(_CACHED).parquet(*[b.toString() for b in batches])
    append_counts(rows.groupBy("digest").agg(F.max("n_tokens").alias("n_tokens")), cache, version)
    for batch in batches:
        system.delete(batch, True)


def whole_content(text: Column) -> Column:
    """The content as it is."""
    return text


def single_blanks(text: Column) -> Column:
    """The content with one blank for each stretch of white space and none around it: for tokenizers that drop white space."""
    return F.trim(F.regexp_replace(text, "[\\x20\\x09-\\x0D]+", " "))


def content_digests(docs: DataFrame, normalise: Callable[[Column], Column] = whole_content) -> DataFrame:
    """(doc_id, n_bytes, digest): UTF-8 bytes of each text and the SHA-256 of its normalised content; null counts as empty."""
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.octet_length(text).cast("long").alias("n_bytes"), F.unhex(F.sha2(normalise(text), 256)).alias("digest"))


def _encode(docs: DataFrame, missing: DataFrame, tokenizer: str, normalise: Callable[[Column], Column], sieve: bool) -> DataFrame:
    """(digest, n_tokens) of the ``missing`` digests, each encoded once.

    With ``sieve``, texts that the cache has are left out by a bitmap of fixed size before texts are shuffled.
    """
    text = normalise(F.coalesce(F.col("text").cast("string"), F.lit("")))
    rows = docs.select(F.unhex(F.sha2(text, 256)).alias("digest"), text.alias("text"))
    if sieve:
        table = id_filter(missing.select(F.xxhash64("digest").alias("id")), "id")

        @F.pandas_udf("boolean")
        def maybe(ids: pd.Series) -> pd.Series:
            return pd.Series(table.value[cells(ids.to_numpy(np.int64), 22)] > 0)

        rows = rows.where(maybe(F.xxhash64("digest")))
    cut = cuts_at_blanks(tokenizer)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            counts = list(count_texts((x.as_py() for x in batch.column(1)), tokenizer, cut))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(counts, pa.int64())], ["digest", "n_tokens"])

    once = rows.groupBy("digest").agg(F.any_value("text").alias("text"))  # copies meet map-side first
    return once.join(missing.select("digest"), "digest", "left_semi").select("digest", "text").mapInArrow(run, _CACHED)


def token_counts(docs: DataFrame, tokenizer: str, cache: str | None = None, limit: int = 1024, normalise: Callable[[Column], Column] = whole_content) -> DataFrame:
    """(doc_id, n_bytes, n_tokens, over_limit) of each whole ``text`` of ``docs`` by the tokenizer file ``tokenizer``.

    Digests of all contents meet the counts that ``cache`` holds for this tokenizer version; only distinct contents
    that it lacks are encoded, once each, and appended. ``.json`` files are read by tokenizers, ``.model`` files by
    sentencepiece. ``normalise`` maps content to what is digested and encoded, and must leave counts as they are.
    Without ``cache`` a new one is made in the shared folder.

    Frequent contents, at most HOT of them, get their counts by a broadcast; for the others each digest has fewer than
    one in HOT rows, so no task of the join holds a large group.

    Defined cases: null texts count as empty, with 0 bytes and the tokens of the empty text; repeated rows and rows
    without doc_id give a row each; other columns are ignored; an empty table gives an empty table.
    """
    spark = docs.sparkSession
    cache = cache or f"{shared_folder(spark)}/veriscope-counts-{uuid.uuid4().hex}"
    version = tokenizer_version(tokenizer)
    keyed = keep(content_digests(docs, normalise))
    counts = keep(keyed.groupBy("digest").agg(F.count("*").alias("n")))
    sieve = _exists(spark, _folder(cache, version))
    missing = keep(counts.join(stored_counts(spark, cache, version), "digest", "left_anti"))
    if not missing.isEmpty():
        append_counts(_encode(docs, missing, tokenizer, normalise, sieve), cache, version)
    stored = stored_counts(spark, cache, version)
    often = counts.where(F.col("n") > F.lit(keyed.count() / HOT)).where("n > 1").select("digest")  # fewer than HOT digests
    hot = keyed.join(F.broadcast(stored.join(F.broadcast(often), "digest", "left_semi")), "digest")
    rest = keyed.join(F.broadcast(often), "digest", "left_anti").join(stored, "digest")
    return hot.unionByName(rest).select("doc_id", "n_bytes", "n_tokens", (F.col("n_tokens") > limit).alias("over_limit"))
