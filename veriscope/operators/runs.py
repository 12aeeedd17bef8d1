"""Runs and their stages: creation, updates, groups, health, and what a run has cost."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .ledger import aggregate_status

# The stages in order, and the states in which one has ended badly.
STAGES = ("discover", "screen", "extract", "classify", "evidence", "curate", "adjudicate")
ENDED_BADLY = ("failed", "cancelled", "interrupted")
ACTIVE = ("queued", "running")


def stage_table(spark) -> DataFrame:
    """(stage_key, stage_order): one row for each stage."""
    return spark.createDataFrame([(s, k) for k, s in enumerate(STAGES)], "stage_key string, stage_order int")


def create_runs(wanted: DataFrame) -> DataFrame:
    """The stage rows of new runs (run_id, tracked_claim): none has begun, but with a given claim there is nothing to discover."""
    given = (F.length("tracked_claim") > 0) & (F.col("stage_key") == "discover")
    rows = wanted.crossJoin(F.broadcast(stage_table(wanted.sparkSession)))
    return rows.select("run_id", "stage_key", "stage_order", F.lit(0).alias("family"), F.when(F.coalesce(given, F.lit(False)), "succeeded").otherwise("not_started").alias("status"))


def ensure_stages(stages: DataFrame, wanted: DataFrame) -> DataFrame:
    """``stages`` and a fresh row for each of ``wanted`` (run_id, stage_key, family) that it lacks."""
    key = ["run_id", "stage_key", "family"]
    fresh = wanted.select(*key).distinct().join(stages, key, "left_anti").join(F.broadcast(stage_table(stages.sparkSession)), "stage_key")
    return stages.unionByName(fresh.withColumn("status", F.lit("not_started")), allowMissingColumns=True)


def update_stages(stages: DataFrame, changes: DataFrame, held: tuple[str, ...] = ("input_path", "started")) -> DataFrame:
    """``stages`` with the values of ``changes`` (run_id, stage_key, family, ...): columns in ``held`` keep a value for which the change has none, others take the change's null too."""
    key = ["run_id", "stage_key", "family"]
    new = [c for c in changes.columns if c not in key]
    d = changes.select(*key, *[F.col(c).alias(f"_new_{c}") for c in new], F.lit(True).alias("_hit"))
    hit = F.col("_hit").isNotNull()
    value = lambda c: F.coalesce(F.col(f"_new_{c}"), F.col(c)) if c in held else F.when(hit, F.col(f"_new_{c}")).otherwise(F.col(c))
    return stages.join(d, key, "left").select(*[value(c).alias(c) if c in new else F.col(c) for c in stages.columns])


def active_run(runs: DataFrame) -> DataFrame:
    """The run that is queued or running and was changed last; no row if none is."""
    return runs.where(F.col("status").isin(*ACTIVE)).orderBy(F.desc("updated"), F.desc("run_id")).limit(1)


def gate(stages: DataFrame) -> DataFrame:
    """(run_id, family, stage_key, can_run, reason): the first earlier stage that has not succeeded is the reason."""
    w = Window.partitionBy("run_id", "family").orderBy("stage_order").rowsBetween(Window.unboundedPreceding, -1)
    open_ = F.first(F.when(F.col("status") != "succeeded", F.concat_ws(" is ", "stage_key", "status")), ignorenulls=True).over(w)
    out = stages.withColumn("reason", open_)
    return out.select("run_id", "family", "stage_key", F.col("reason").isNull().alias("can_run"), "reason")


def stage_groups(stages: DataFrame) -> DataFrame:
    """One row for each run and stage that has rows: state, counts and what to show of them."""
    bad = F.col("status").isin(*ENDED_BADLY)
    counted = stages.groupBy("run_id", "stage_key", "stage_order").agg(
        F.count_if(F.col("status") == "succeeded").alias("succeeded"), F.count_if(F.col("status") == "running").alias("running"), F.count_if(bad).alias("failed"), F.count_if(F.col("status") == "stale").alias("stale")
    )
    g = aggregate_status(stages).join(counted, ["run_id", "stage_key", "stage_order"])
    of = lambda c, text: F.concat(F.col(c).cast("string"), F.lit(text))
    headline = (
        F.when(F.col("members") == 1, F.lit(None).cast("string"))
        .when(F.col("running") > 0, of("running", " running"))
        .when(F.col("failed") > 0, of("failed", " ended with errors"))
        .when(F.col("stale") > 0, "some are stale")
        .when(F.col("succeeded") == F.col("members"), of("members", " complete"))
        .otherwise(F.concat(F.col("succeeded").cast("string"), F.lit("/"), F.col("members").cast("string"), F.lit(" complete")))
    )
    return g.withColumn("headline", headline)


def health(stages: DataFrame) -> DataFrame:
    """(run_id, health, focus): the first stage that ended badly, else the running one, else how many are complete; and the stage to look at.

    The focus is the first running row, else the first that ended badly, else the last that succeeded, else the first.
    """
    bad = F.col("status").isin(*ENDED_BADLY)
    at = F.struct("stage_order", "family")
    groups = aggregate_status(stages)
    of_groups = groups.groupBy("run_id").agg(F.min_by("stage_key", F.when(F.col("status") == "running", F.col("stage_order"))).alias("_running"), F.count_if(F.col("status") == "succeeded").alias("_done"), F.count("*").alias("_all"))
    rows = stages.groupBy("run_id").agg(
        F.min(F.when(bad, F.struct("stage_order", "family", "stage_key", "status"))).alias("_bad"), F.min_by("stage_key", F.when(F.col("status") == "running", at)).alias("_run"),
        F.max_by("stage_key", F.when(F.col("status") == "succeeded", at)).alias("_won"), F.min_by("stage_key", at).alias("_first"),
    )
    text = F.coalesce(
        F.when(F.col("_bad").isNotNull(), F.concat(F.col("_bad.status"), F.lit(" at "), F.col("_bad.stage_key"))), F.concat(F.lit("running "), "_running"), F.concat(F.col("_done").cast("string"), F.lit("/"), F.col("_all").cast("string"), F.lit(" stages complete"))
    )
    return rows.join(of_groups, "run_id").select("run_id", text.alias("health"), F.coalesce("_run", F.col("_bad.stage_key"), "_won", "_first").alias("focus"))


def dashboard(runs: DataFrame) -> DataFrame:
    """One row: runs by state, and how many citations have been judged."""
    s = F.col("status")
    return runs.agg(F.count("*").alias("total"), F.count_if(s.isin(*ACTIVE)).alias("active"), F.count_if(s == "succeeded").alias("completed"), F.count_if(s.isin(*ENDED_BADLY)).alias("failed"), F.coalesce(F.sum("judged"), F.lit(0)).alias("judged"))


def run_cost(runs: DataFrame, reports: DataFrame, telemetry: DataFrame) -> DataFrame:
    """(run_id, usd, source): what the latest cost report (run_id, stamp, usd) says, else the sum of the run's telemetry (run_id, usd), else 0."""
    latest = reports.groupBy("run_id").agg(F.max_by("usd", "stamp").alias("_reported"))
    summed = telemetry.groupBy("run_id").agg(F.sum("usd").alias("_summed"))
    j = runs.select("run_id").join(latest, "run_id", "left").join(summed, "run_id", "left")
    source = F.when(F.col("_reported").isNotNull(), "report").when(F.col("_summed").isNotNull(), "telemetry").otherwise("none")
    return j.select("run_id", F.coalesce("_reported", "_summed", F.lit(0.0)).alias("usd"), source.alias("source"))


def failure_detail(detail: Column) -> Column:
    """The line of an error text that says most: the first one, but the next after a general one."""
    lines = F.filter(F.transform(F.split(detail, r"\r?\n"), lambda x: F.trim(F.regexp_replace(x, r"^\s+|\s+$", ""))), lambda x: x != "")
    general = F.get(lines, F.lit(0)).rlike(r"^(?:No seeds produced\.?|Command exited with code [0-9]+\.)$")
    return F.when(F.size(lines) == 0, F.trim(detail)).when(general & (F.size(lines) > 1), F.get(lines, F.lit(1))).otherwise(F.get(lines, F.lit(0)))
