"""Runs, stages and costs: state as tables, changes as joins."""

from __future__ import annotations

from decimal import Decimal

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

# USD per million tokens (input, output) of a model without a price, and the multiples of the input price for cached tokens.
DEFAULT_PRICE = (3.0, 15.0)
CACHE_READ, CACHE_WRITE, CACHE_WRITE_HOUR = Decimal("0.1"), Decimal("1.25"), Decimal("2.0")


def priced(calls: DataFrame, prices: DataFrame) -> DataFrame:
    """``calls`` with usd and micro_usd, its exact value in millionths, by ``prices`` (model, input_usd, output_usd per million tokens), the caller's table of a row for each model.

    Cached reads and writes cost multiples of the input price, writes kept for an hour (cache_write_hour_tokens, a part of
    cache_write_tokens) more than others; reasoning counts only if there is no output.
    """
    j = calls.join(prices.select("model", F.col("input_usd").alias("_in"), F.col("output_usd").alias("_out")), "model", "left")
    price = lambda c, default: F.coalesce(c, F.lit(default)).cast("decimal(12,6)")
    tokens = lambda c: F.coalesce(F.col(c), F.lit(0)).cast("decimal(15,0)")
    read, hour = tokens("cache_read_tokens"), tokens("cache_write_hour_tokens")
    write = F.greatest(tokens("cache_write_tokens"), hour)
    fresh = F.greatest(F.lit(0).cast("decimal(15,0)"), F.col("input_tokens").cast("decimal(15,0)") - read - write)
    out = F.when(F.col("output_tokens") > 0, F.col("output_tokens").cast("decimal(15,0)")).otherwise(tokens("reasoning_tokens"))
    weighted = fresh + read * F.lit(CACHE_READ) + (write - hour) * F.lit(CACHE_WRITE) + hour * F.lit(CACHE_WRITE_HOUR)
    micro = weighted * price("_in", DEFAULT_PRICE[0]) + out * price("_out", DEFAULT_PRICE[1])
    return j.withColumn("micro_usd", micro).select(*calls.columns, (F.col("micro_usd").cast("double") / 1_000_000).alias("usd"), "micro_usd")


MEASURES = ("successful", "failed", "billable", "hit")


def _sums() -> list[Column]:
    tokens = [F.sum(c).alias(c) for c in ("input_tokens", "output_tokens", "reasoning_tokens")]
    return [F.count("*").alias("attempted"), *[F.count_if(c).alias(c) for c in MEASURES], *tokens, F.sum("usd").alias("usd")]


def ledger_by_purpose(calls: DataFrame, prices: DataFrame) -> DataFrame:
    """Calls, tokens and cost by purpose, with a total row (purpose ``total``)."""
    out = priced(calls, prices).rollup("purpose").agg(*_sums())
    return out.withColumn("purpose", F.coalesce("purpose", F.lit("total")))


def ledger_by_stage(calls: DataFrame, prices: DataFrame) -> DataFrame:
    """The same by stage and family; an unknown stage is ``unknown``, an unknown family 0."""
    named = priced(calls, prices).withColumn("stage", F.coalesce("stage", F.lit("unknown"))).withColumn("family", F.coalesce("family", F.lit(0)))
    return named.groupBy("stage", "family").agg(*_sums())


def upsert(changes: DataFrame, key: list[str], order: str, keep_first: tuple[str, ...] = ()) -> DataFrame:
    """The last row of each key; columns in ``keep_first`` stay as the first row had them."""
    first = [F.min_by(c, F.col(order)).alias(c) for c in keep_first]
    rest = [c for c in changes.columns if c not in key and c not in keep_first]
    return changes.groupBy(*key).agg(*first, *[F.max_by(c, F.col(order)).alias(c) for c in rest])


def mark_stale(stages: DataFrame, changed: DataFrame, outputs: tuple[str, ...] = (), inputs: tuple[str, ...] = ()) -> DataFrame:
    """Stages after the changed one of their run and family (run_id, family, from_order) turn from succeeded to stale.

    Of later stages the columns ``inputs`` (paths of what they read, errors, processes) are emptied, and the columns
    ``outputs`` (paths of what they wrote, summaries, ends) of those that turn stale.
    """
    j = stages.join(changed, ["run_id", "family"], "left")
    later = F.coalesce(F.col("stage_order") > F.col("from_order"), F.lit(False))
    hit = later & (F.col("status") == "succeeded")
    value = {c: F.when(~hit, F.col(c)) for c in outputs} | {c: F.when(~later, F.col(c)) for c in inputs} | {"status": F.when(hit, "stale").otherwise(F.col("status"))}
    return j.select(*[value[c].alias(c) if c in value else F.col(c) for c in stages.columns])


def aggregate_status(stages: DataFrame) -> DataFrame:
    """One status for each run and stage over its families: running, else the first ended badly, all succeeded, stale, blocked, the first."""
    has = lambda s: F.bool_or(F.col("status") == s)
    ended = F.min_by("status", F.when(F.col("status").isin("failed", "cancelled", "interrupted"), F.col("family")))
    bad = F.bool_or(F.col("status").isin("failed", "cancelled", "interrupted"))
    agg = stages.groupBy("run_id", "stage_key", "stage_order").agg(
        has("running").alias("r"), bad.alias("b"), ended.alias("e"), F.bool_and(F.col("status") == "succeeded").alias("ok"), has("stale").alias("s"), has("blocked").alias("k"), F.min_by("status", "family").alias("f"), F.count("*").alias("members"),
    )
    status = F.when(F.col("r"), "running").when(F.col("b"), F.col("e")).when(F.col("ok"), "succeeded").when(F.col("s"), "stale").when(F.col("k"), "blocked").otherwise(F.col("f"))
    return agg.select("run_id", "stage_key", "stage_order", "members", status.alias("status"))


def can_run_from(stages: DataFrame) -> DataFrame:
    """Whether every earlier stage of the run (and family) has succeeded."""
    before = Window.partitionBy("run_id", "family").orderBy("stage_order").rowsBetween(Window.unboundedPreceding, -1)
    return stages.withColumn("can_run", F.coalesce(F.bool_and(F.col("status") == "succeeded").over(before), F.lit(True)))


def purge(rows: DataFrame, now: Column, days: int = 90, stamp: Column | None = None) -> DataFrame:
    """Rows younger than ``days`` by their last use, else their creation."""
    return rows.where((F.col("ts") if stamp is None else stamp) >= now - F.expr(f"INTERVAL {days} DAYS"))


def missing_from_cache(wanted: DataFrame, cache: DataFrame, key: str) -> DataFrame:
    """What has to be computed: wanted keys that the cache lacks, once each."""
    return wanted.select(key).distinct().join(cache, key, "left_anti")
