"""Externally computed columns: answers enter by a join on a content key, never by a call."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import cache_key, json_from_answer


def request_key(purpose: str, model: Column, prompt: Column, settings: Column | None = None) -> Column:
    """Key of a request: purpose, model, settings and prompt."""
    return cache_key(F.lit(purpose), model, F.lit("") if settings is None else settings, prompt)


def replay(requests: DataFrame, answers: DataFrame, schema: str, key: str = "cache_key") -> DataFrame:
    """Requests with ``answer`` (parsed by ``schema``) and ``state``: answered, malformed or missing."""
    last = answers.groupBy(key).agg(F.max_by("response_text", "created_at").alias("response_text"))
    j = requests.join(last, key, "left")
    parsed = F.from_json(json_from_answer(F.col("response_text")), schema)
    state = F.when(F.col("response_text").isNull(), "missing").when(parsed.isNull(), "malformed").otherwise("answered")
    return j.withColumn("answer", parsed).withColumn("state", state).drop("response_text")


def to_compute(requests: DataFrame, answers: DataFrame, key: str = "cache_key") -> DataFrame:
    """Requests that no answer covers, once for each key."""
    return requests.dropDuplicates([key]).join(answers.select(key), key, "left_anti")


def verified_quotes(claims: DataFrame, quotes: str, manuscript: str, most: int = 8) -> DataFrame:
    """Keeps of each claim's quotes those that the manuscript holds word for word; status: grounded, ambiguous if some failed, not_found without any."""
    held = F.filter(quotes, lambda q: (F.length(F.trim(q)) > 0) & F.contains(F.col(manuscript), q))
    status = F.when(F.size(held) == 0, "not_found").when(F.size(held) < F.size(quotes), "ambiguous").otherwise("grounded")
    return claims.withColumn("status", status).withColumn(quotes, F.slice(held, 1, most))
