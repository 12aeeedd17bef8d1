"""Runs that resume: stages as published tables, their states as an appended table, changes of layout as named migrations."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.runs import STAGES
from ..sources import commits

Frames = dict[str, DataFrame]
_STATE = "run_id string, stage_key string, family int, status string, part string, n_rows bigint, error string, at timestamp"
_APPLIED = "name string"
_KEY = ["run_id", "stage_key", "family"]
RUN_ROW = ""  # the stage_key of a run's own row

# Stages that work on families, and the text for stages that a signal ended.
FAMILY_STAGES = ("extract", "classify", "evidence", "curate", "adjudicate")
INTERRUPTED = "Interrupted by signal."


@dataclass(frozen=True)
class Step:
    """A stage: its key, the stages it reads, and what it computes from their tables."""

    key: str
    needs: tuple[str, ...]
    compute: Callable[[Frames], DataFrame]


def migrate(spark: SparkSession, root: str, migrations: dict[str, Callable[[SparkSession, str], None]]) -> list[str]:
    """Apply the migrations that ``root`` has not seen, in order of their names, and note each once it is through; returns these names."""
    seen = {r["name"] for r in commits.read(spark, root, "migrations", _APPLIED).collect()}
    pending = sorted(set(migrations) - seen)
    for name in pending:
        migrations[name](spark, root)
        commits.publish(spark.createDataFrame([(name,)], _APPLIED), root, "migrations")
    return pending


class Tracker:
    """States of one run's stages and families under ``root``; each change is a commit, so a killed driver leaves the last whole state."""

    def __init__(self, spark: SparkSession, root: str, run_id: str) -> None:
        self.spark, self.root, self.run_id = spark, root, run_id

    def record(self, rows: list[tuple[str, int, str, str | None, int | None, str | None]]) -> None:
        """Append (stage, family, status, part, rows, error)."""
        frame = self.spark.createDataFrame([(self.run_id, *r) for r in rows], _STATE.removesuffix(", at timestamp"))
        commits.publish(frame.withColumn("at", F.current_timestamp()), self.root, "states")

    def states(self) -> DataFrame:
        """The last state of each stage and family of the run."""
        return states(self.spark, self.root).where(F.col("run_id") == self.run_id)

    def start(self, stage: str, families: list[int] | None = None) -> None:
        self.record([(RUN_ROW, 0, "running", None, None, stage)] * (not families) + [(stage, f, "running", None, None, None) for f in families or [0]])

    def success(self, stage: str, part: str | None, n_rows: int, family: int = 0) -> None:
        self.record([(stage, family, "succeeded", part, n_rows, None)])

    def blocked(self, stage: str, message: str, family: int = 0) -> None:
        self.record([(stage, family, "blocked", None, None, message)])

    def end(self, status: str, message: str | None = None) -> None:
        """The run is over; stages that still run end the same way."""
        open_ = self.states().where("status = 'running' and stage_key <> ''").select("stage_key", "family").collect()
        self.record([(r["stage_key"], r["family"], status, None, None, message) for r in open_] + [(RUN_ROW, 0, status, None, None, message)])

    def block_pending(self, families: DataFrame, message: str) -> None:
        """Family stages that have not begun are blocked, for each of ``families`` (family)."""
        begun = self.states().where("status <> 'not_started'").select("stage_key", "family")
        keys = self.spark.createDataFrame([(s,) for s in FAMILY_STAGES], "stage_key string")
        rows = families.select(F.col("family").cast("int").alias("family")).distinct().crossJoin(F.broadcast(keys)).join(begun, ["stage_key", "family"], "left_anti")
        none = F.lit(None)
        out = rows.select(F.lit(self.run_id).alias("run_id"), "stage_key", "family", F.lit("blocked").alias("status"), none.cast("string").alias("part"), none.cast("bigint").alias("n_rows"), F.lit(message).alias("error"), F.current_timestamp().alias("at"))
        commits.publish(out, self.root, "states")

    def artifact(self, stage: str) -> str | None:
        """Where the table of a stage that has succeeded is."""
        row = self.states().where((F.col("stage_key") == stage) & (F.col("family") == 0) & (F.col("status") == "succeeded")).select("part").first()
        return None if row is None else row["part"]

    def invalidate(self, stage: str) -> None:
        """Later stages than ``stage`` that have succeeded turn stale and lose their tables; the stage itself is to begin anew."""
        later = STAGES[STAGES.index(stage) + 1 :]
        rows = self.states().where(F.col("stage_key").isin(*later) & (F.col("status") == "succeeded")).select("stage_key", "family").collect()
        self.record([(r["stage_key"], r["family"], "stale", None, None, None) for r in rows] + [(stage, 0, "not_started", None, None, None)])


def states(spark: SparkSession, root: str) -> DataFrame:
    """The last state of each stage and family of every run."""
    return commits.latest(commits.read(spark, root, "states", _STATE), _KEY)


def run(spark: SparkSession, root: str, run_id: str, steps: list[Step], stop_after: str | None = None) -> Frames:
    """Compute the steps in order and publish each one's table; steps that have succeeded before are read back, not computed.

    A step that raises ends the run as failed. Stages that a killed driver left running are marked as interrupted when
    the run is taken up again, and are computed anew: what they may have written is no commit, so nothing reads it.
    """
    tracker = Tracker(spark, root, run_id)
    left = tracker.states().where("status = 'running' and stage_key <> ''").select("stage_key", "family").collect()
    if left:
        tracker.record([(r["stage_key"], r["family"], "interrupted", None, None, INTERRUPTED) for r in left])
    frames: Frames = {}
    for step in steps:
        part = tracker.artifact(step.key)
        if part is None:
            tracker.start(step.key)
            try:
                part = commits.publish(step.compute({k: frames[k] for k in step.needs}), root, f"{run_id}/{step.key}")
                tracker.success(step.key, part, spark.read.parquet(part).count())
            except Exception as error:
                tracker.end("failed", str(error).split("\n")[0])
                raise
        frames[step.key] = spark.read.parquet(part).drop("_seq")
        if step.key == stop_after:
            break
    tracker.record([(RUN_ROW, 0, "succeeded", None, None, None)])
    return frames
