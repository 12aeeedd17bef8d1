"""Progress events of a run: the state of each stage's steps, in batch and as a stream."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from . import logsource

EVENT = "stage string, step string, status string, detail string, current int, total int, summary string"
PREFIX = "CF_PROGRESS "
STEPS = {
    "discover": ("resolve", "parse", "probe", "extract", "ground", "shortlist"),
    "screen": ("load", "dedupe", "classify", "decide"),
    "extract": ("fetch", "parse", "mentions"),
    "classify": ("roles", "packets"),
    "evidence": ("index", "rank", "truncate"),
    "curate": ("prioritize", "sample"),
    "adjudicate": ("judge", "aggregate", "route"),
}
OUT = "run_id string, stage string, step string, place int, status string, detail string"


def parse_log(lines: DataFrame, column: str = "value") -> DataFrame:
    """Events among the lines of a log (run_id, seq, value); an event whose current and total do not come together is dropped."""
    e = lines.where(F.startswith(column, F.lit(PREFIX))).withColumn("e", F.from_json(F.expr(f"substring(`{column}`, {len(PREFIX) + 1})"), EVENT))
    keep = [c for c in lines.columns if c != column]
    return e.select(*keep, "e.*").where("stage is not null and step is not null and (current is null) = (total is null)")


def log_tail(lines: DataFrame, most: int = 400, column: str = "value") -> DataFrame:
    """The last ``most`` other lines of each run."""
    from pyspark.sql.window import Window

    w = Window.partitionBy("run_id").orderBy(F.desc("seq"))
    return lines.where(~F.startswith(column, F.lit(PREFIX))).withColumn("n", F.row_number().over(w)).where(F.col("n") <= most).drop("n")


def advance(states: dict[str, tuple[str, str | None]], steps: tuple[str, ...], step: str, status: str, detail: str | None) -> None:
    """One event: earlier steps that did not fail are complete, and a running step sets later ones that did not fail back to pending."""
    if step not in steps:
        return
    at = steps.index(step)
    for k, name in enumerate(steps):
        known = states.get(name, ("pending", None))
        if known[0] == "failed" and name != step:
            continue
        if k < at:
            states[name] = ("completed", known[1])
        elif k == at:
            states[name] = (status, detail if detail is not None else known[1])
        elif status == "running":
            states[name] = ("pending", None)


def _rows(run: str, stage: str, states: dict[str, tuple[str, str | None]]) -> pd.DataFrame:
    steps = STEPS.get(stage, ())
    return pd.DataFrame([(run, stage, s, k, *states.get(s, ("pending", None))) for k, s in enumerate(steps)], columns=[x.split()[0] for x in OUT.split(", ")])


def snapshot(events: DataFrame) -> DataFrame:
    """State of every step after all events (run_id, seq, stage, step, status, detail); one stage of a run is one group."""

    def fold(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        states: dict = {}
        for e in pdf.sort_values("seq").itertuples():
            advance(states, STEPS.get(key[1], ()), e.step, e.status, e.detail)
        return _rows(key[0], key[1], states)

    return events.groupBy("run_id", "stage").applyInPandas(fold, OUT)


def stream(events: DataFrame) -> DataFrame:
    """The same as a stream: emits a stage's steps whenever events of it arrive; late events of a batch are put in order by seq."""

    def update(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        states: dict = {}
        if state.exists:
            names, values, details = state.get
            states = {n: (v, d or None) for n, v, d in zip(names, values, details, strict=True)}
        pdf = pd.concat(list(frames))
        for e in pdf.sort_values("seq").itertuples():
            advance(states, STEPS.get(key[1], ()), e.step, e.status, e.detail)
        state.update((list(states), [v for v, _ in states.values()], [d or "" for _, d in states.values()]))
        yield _rows(key[0], key[1], states)

    return events.groupBy("run_id", "stage").applyInPandasWithState(update, OUT, "names array<string>, statuses array<string>, details array<string>", "update", GroupStateTimeout.NoTimeout)


def from_logs(spark: SparkSession, folder: str, streaming: bool = True) -> DataFrame:
    """Events of the log files of a folder, as a stream or a batch; the file's name is the run, the byte where a line begins its order."""
    logsource.register(spark)
    reader = spark.readStream if streaming else spark.read
    lines = reader.format("run_logs").load(folder)
    return parse_log(lines.select(F.regexp_extract("file", r"^(.+)\.log$", 1).alias("run_id"), "seq", "value"))
