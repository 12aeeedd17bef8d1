"""Model calls as a stream: once each, in windows of event time, into a table that a restart does not double."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.query import StreamingQuery

from ..sources import commits

CALL = "event_id bigint, run_id bigint, stage string, purpose string, model string, at timestamp, successful boolean, input_tokens bigint, output_tokens bigint, latency_ms bigint, micro_usd decimal(38,8)"


def once(calls: DataFrame, lateness: str = "10 minutes") -> DataFrame:
    """Calls by event_id, each once. In a stream, state for an id is kept for ``lateness`` of event time after it; in a batch all ids are."""
    if calls.isStreaming:
        return calls.withWatermark("at", lateness).dropDuplicatesWithinWatermark(["event_id"])
    return calls.dropDuplicates(["event_id"])


def windows(calls: DataFrame, width: str = "1 hour", lateness: str = "10 minutes") -> DataFrame:
    """(start, stage, purpose, calls, successful, input_tokens, output_tokens, latency_ms, micro_usd) of calls once each.

    Tokens and latency are those of successful calls, costs those of all. A stream emits a window when the watermark has passed it; what comes
    later than ``lateness`` behind the newest call is dropped there, and only there.
    """
    won = F.col("successful")
    sums = [F.coalesce(F.sum(F.when(won, F.col(c))), F.lit(0)).alias(c) for c in ("input_tokens", "output_tokens", "latency_ms")]
    g = once(calls, lateness).groupBy(F.window("at", width), "stage", "purpose").agg(F.count("*").alias("calls"), F.count_if(won).alias("successful"), *sums, F.sum("micro_usd").alias("micro_usd"))
    return g.select(F.col("window.start").alias("start"), "stage", "purpose", "calls", "successful", "input_tokens", "output_tokens", "latency_ms", "micro_usd")


def append(rows: DataFrame, root: str, name: str, checkpoint: str, once_only: bool = True) -> StreamingQuery:
    """Write a stream to the table ``name`` under ``root``, a commit for each micro-batch that has rows.

    The commit carries the batch's number. A batch that runs again after a restart finds it and writes nothing; one that
    died between its data and its commit left data that no commit names, and is written anew. So rows count exactly once.
    """

    def write(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        seen = commits.commits(spark, root, name).where(F.col("info")["batch"] == str(number))
        if batch.isEmpty() or not seen.isEmpty():
            return
        commits.publish(batch, root, name, {"batch": str(number)})

    writer = rows.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).outputMode("append")
    return (writer.trigger(availableNow=True) if once_only else writer).start()


def telemetry(calls: DataFrame, by: tuple[str, ...] = ("run_id", "model")) -> DataFrame:
    """Calls, failures, tokens, mean latency (rounded half up) and cost of calls once each, by ``by``; calls for samples of judgment vectors apart."""
    c, won = once(calls), F.col("successful")
    total = lambda x: F.coalesce(F.sum(F.when(won, F.coalesce(F.col(x), F.lit(0)))), F.lit(0)).alias(f"total_{x}")
    vector = F.col("purpose") == "fidelity-vector"
    out = c.groupBy(*by).agg(F.count("*").alias("calls"), F.count_if(won).alias("successful"), F.count_if(~won).alias("failed"), F.count_if(vector).alias("vector_calls"), *[total(x) for x in ("input_tokens", "output_tokens", "latency_ms")], F.coalesce(F.sum("micro_usd"), F.lit(0)).cast("decimal(38,8)").alias("micro_usd"))
    return out.withColumn("mean_latency_ms", F.when(F.col("successful") > 0, F.floor(F.col("total_latency_ms") / F.col("successful") + 0.5)).otherwise(F.lit(0).cast("long")))


def read_calls(spark: SparkSession, root: str, name: str = "calls") -> DataFrame:
    return commits.read(spark, root, name, CALL).drop("_seq")
