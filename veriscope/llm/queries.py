"""The registered queries of the corpus operators, over whole tables, and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import pii, sql
from .decontaminate import find_leaks
from .divergence import source_divergence
from .fingerprint import edited, edited_likeness
from .html import extract_main_text
from .linededup import dedup_lines
from .minhash import near_duplicates
from .packing import pack_documents
from .periodic import periodic_runs, repeat_tails, run_digests
from .quality import held_out_scores
from .tokencount import content_digests, token_counts
from .toxicity import held_out_toxicity
from .urlrules import judge_urls


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def tokenizer_file(name: str = "word_bpe_49k.json") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return find_leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op2_html(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract_main_text(table(spark, sf_dir, "pages")).select("page_id", "url", "text", "n_chars")


def op3_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return held_out_toxicity(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op4_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = pii.find_personal(table(spark, sf_dir, "documents"))
    counts = [f"n_{kind}" for kind in (*pii.BASE, pii.SECRET)]
    return found.select("doc_id", *counts, F.sha2(pii.digest("base"), 256).alias("base_sha256"), pii.digest("spans").alias("spans"))


def op5_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = dedup_lines(table(spark, sf_dir, "documents"), min_tokens=1)
    return out.select("doc_id", "line_count", "removed_count", "line_classes", "line_links", F.sha2(F.col("text"), 256).alias("text_sha256"))


def op6_url_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judge_urls(table(spark, sf_dir, "pages"), table(spark, sf_dir, "labels"))


def op7_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack_documents(table(spark, sf_dir, "documents"), tokenizer_file())


def op8_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents"))


def op9_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return held_out_scores(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op10_fingerprint(spark: SparkSession, sf_dir: str) -> DataFrame:
    return edited_likeness(table(spark, sf_dir, "documents"))


def op11_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return run_digests(periodic_runs(repeat_tails(table(spark, sf_dir, "documents"))))


def op12_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """With a cache of its own, so that every distinct text is encoded."""
    return token_counts(table(spark, sf_dir, "documents"), tokenizer_file("byte_bpe_50k.json"))


def op13_source_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return source_divergence(table(spark, sf_dir, "documents"))


def personal_base(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The base spans of op4_pii."""
    return op4_pii(spark, sf_dir).select("doc_id", *[f"n_{kind}" for kind in pii.BASE], "base_sha256")


def url_parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Host, path and fixed rule of op6_url_rules."""
    return op6_url_rules(spark, sf_dir).select("page_id", "host", "path", "rule")


def edited_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lengths and edited texts of op10_fingerprint, by the same step; no fingerprint is made for them."""
    return edited(table(spark, sf_dir, "documents")).select("doc_id", "n_chars", "edited_sha256")


def text_digests(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sizes and digests by which op12_token_counts meets its cache."""
    return content_digests(table(spark, sf_dir, "documents")).withColumn("digest", F.lower(F.hex("digest")))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    ops = (op1_decontamination, op2_html, op3_toxicity, op4_pii, op5_line_dedup, op6_url_rules, op7_packing, op8_minhash, op9_quality, op10_fingerprint, op11_periodic_runs, op12_token_counts, op13_source_divergence, text_digests, personal_base, url_parts, edited_texts)
    return {f.__name__: f for f in ops}


def oracle_sql() -> dict[str, str]:
    return {"op8_minhash": sql.NEAR_DUPLICATES, "op11_periodic_runs": sql.PERIODIC_RUNS, "text_digests": sql.CONTENT_DIGESTS, "op13_source_divergence": sql.SOURCE_DIVERGENCE, "personal_base": sql.PERSONAL_BASE, "url_parts": sql.URL_PARTS, "edited_texts": sql.EDITED_TEXTS}
