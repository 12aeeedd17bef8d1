"""Fetched and parsed papers as tables that merge on read: appended changes, tombstones, and a hit only where everything agrees."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources import commits

RAW = "paper_id bigint, format string, content string, content_hash string, source_url string, fetched_at timestamp, gone boolean"
PARSED = "paper_id bigint, parser_version string, parser_kind string, content_hash string, parsed string, parsed_at timestamp, gone boolean"
_SCHEMA = {"raw": RAW, "parsed": PARSED}

# Which parser reads which format.
PARSERS = {"jats_xml": "jats", "grobid_tei_xml": "grobid_tei", "pdf_text": "legacy_pdf_text"}
POLICIES = ("prefer_cache", "force_refresh")


def parser_kind(format_: Column) -> Column:
    return F.coalesce(*[F.when(format_ == f, k) for f, k in PARSERS.items()], F.lit("legacy_pdf_text"))


class PaperCache:
    """A cache under ``root``. Writers only append; two that write the same paper leave the later row, and neither loses others' rows."""

    def __init__(self, spark: SparkSession, root: str) -> None:
        self.spark, self.root = spark, root

    def put(self, table: str, rows: DataFrame) -> None:
        """Upsert rows of the table's columns; ``gone`` and missing columns are null."""
        schema = self.spark.createDataFrame([], _SCHEMA[table]).schema
        columns = [(F.col(f.name) if f.name in rows.columns else F.lit(None)).cast(f.dataType).alias(f.name) for f in schema]
        commits.publish(rows.select(*columns), self.root, table)

    def rows(self, table: str) -> DataFrame:
        """Current rows: of each paper the last, unless that is a tombstone."""
        merged = commits.latest(commits.read(self.spark, self.root, table, _SCHEMA[table]), ["paper_id"])
        return merged.where(~F.coalesce("gone", F.lit(False))).drop("gone", "_seq")

    def evict(self, table: str, papers: DataFrame) -> None:
        """Tombstones for ``papers`` (paper_id)."""
        self.put(table, papers.select("paper_id").distinct().withColumn("gone", F.lit(True)))

    def evict_older(self, table: str, before: Column) -> None:
        stamp = "fetched_at" if table == "raw" else "parsed_at"
        self.evict(table, self.rows(table).where(F.col(stamp) < before))

    def compact(self, table: str) -> None:
        commits.compact(self.spark, self.root, table, _SCHEMA[table], ["paper_id"])

    def lookup(self, wanted: DataFrame, version: str, policy: str = "prefer_cache") -> DataFrame:
        """``wanted`` (paper_id, format, content_hash, ...) with state and parsed.

        state: ``hit`` only if the stored parse has this parser version, the content's hash and the parser of its format;
        else the first that differs: ``absent``, ``version``, ``hash``, ``kind``; ``refresh`` where the policy asks for it.
        """
        if policy not in POLICIES:
            raise ValueError(f"no cache policy {policy}")
        held = self.rows("parsed").select("paper_id", "parser_version", "parser_kind", F.col("content_hash").alias("_hash"), "parsed")
        j = wanted.join(held, "paper_id", "left")
        state = F.when(F.lit(policy == "force_refresh"), "refresh").when(F.col("parser_version").isNull(), "absent").when(F.col("parser_version") != version, "version")
        state = state.when(~F.col("_hash").eqNullSafe(F.col("content_hash")), "hash").when(~F.col("parser_kind").eqNullSafe(parser_kind(F.col("format"))), "kind").otherwise("hit")
        j = j.withColumn("state", state)
        return j.select(*wanted.columns, "state", F.when(F.col("state") == "hit", F.col("parsed")).alias("parsed"))

    def materialize(self, papers: DataFrame, parse: Callable[[DataFrame], DataFrame], version: str, now: Column, policy: str = "prefer_cache") -> DataFrame:
        """(paper_id, state, parsed, error) for each of ``papers`` (paper_id, format, content): stored parses where they hit, else ``parse``.

        parse takes (paper_id, format, content) and returns (paper_id, parsed, error); what has no error is stored.
        """
        looked = self.lookup(papers.withColumn("content_hash", F.sha2("content", 256)), version, policy)
        missed = looked.where("state <> 'hit'").select("paper_id", "format", "content", "content_hash")
        made = missed.select("paper_id", "content_hash", "format").join(parse(missed.drop("content_hash")), "paper_id", "left")
        error = F.when(F.col("parsed").isNull(), F.coalesce("error", F.lit("the parser gave nothing")))
        part = commits.publish(made.withColumn("error", error), self.root, "answers")  # parsed once, read twice
        made = self.spark.read.parquet(part).drop("_seq")
        stored = made.where("error is null").select("paper_id", F.lit(version).alias("parser_version"), parser_kind(F.col("format")).alias("parser_kind"), "content_hash", "parsed", now.alias("parsed_at"))
        self.put("parsed", stored)
        kept = looked.where("state = 'hit'").select("paper_id", F.lit("cached").alias("state"), "parsed", F.lit(None).cast("string").alias("error"))
        return kept.unionByName(made.select("paper_id", F.lit("parsed").alias("state"), "parsed", "error"))
