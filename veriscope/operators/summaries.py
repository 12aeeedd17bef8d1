"""Summaries of samples, routing, classification and stages: every figure is the sum of weighted cells, so each takes one aggregation."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

# Names of verdicts, qualities and stages, and what a stage is headed by.
VERDICTS = ("supported", "partially_supported", "overstated_or_generalized", "not_supported", "cannot_determine")
QUALITIES = ("high", "medium", "low")
HEADLINES = {
    "discover": "Discovered claim units", "screen": "Family viability and auditability", "extract": "Citation extraction outcomes", "classify": "Evaluation task packets",
    "evidence": "Retrieved evidence blocks", "curate": "Audit sample", "adjudicate": "LLM verdicts",
}
STOPPED = "Claim discovery stopped before extraction could be finalized."


def _cell(section: str, row: Column | str, name: Column | str, weight: Column) -> Column:
    as_column = lambda x: F.lit(x) if isinstance(x, str) else x
    return F.struct(F.lit(section).alias("section"), as_column(row).alias("row"), as_column(name).alias("name"), F.coalesce(weight.cast("decimal(28,6)"), F.lit(0).cast("decimal(28,6)")).alias("weight"))


def tally(rows: DataFrame, cells: Column, by: list[str]) -> DataFrame:
    """(by, section, row, name, n): the sum of the cells' weights; one of weight 0 makes a row that is there without a hit."""
    c = rows.select(*by, F.explode(cells).alias("c"))
    return c.groupBy(*by, "c.section", "c.row", "c.name").agg(F.sum("c.weight").alias("n"))


def audit_summary(records: DataFrame, by: str) -> DataFrame:
    """(by, section, row, name, n, rate) of adjudicated samples (excluded, verdict, quality, mode).

    records: all, excluded and adjudicated ones; verdict: those that occur, and the total; mode: for each that occurs the
    total and four of the verdicts (not overstated ones); quality: all three. Rates are shares of the adjudicated ones, null without any.
    """
    active = ~F.coalesce(F.col("excluded"), F.lit(False))
    judged = active & F.col("verdict").isNotNull()
    whole = [_cell("records", "", "all", F.lit(1)), _cell("records", "", "excluded", (~active).cast("int")), _cell("records", "", "adjudicated", judged.cast("int")), _cell("verdict", "", "total", judged.cast("int"))]
    whole += [_cell("quality", "", q, (judged & F.coalesce(F.col("quality") == q, F.lit(False))).cast("int")) for q in QUALITIES]
    mode = F.coalesce("mode", F.lit("unknown"))
    own = [_cell("verdict", "", F.col("verdict"), F.lit(1)), _cell("mode", mode, "total", F.lit(1))] + [_cell("mode", mode, v, (F.col("verdict") == v).cast("int")) for v in VERDICTS if v != "overstated_or_generalized"]
    cells = F.when(judged, F.array(*whole, *own)).otherwise(F.array(*whole))
    n = tally(records, cells, [by]).withColumn("n", F.col("n").cast("long"))
    total = F.max(F.when((F.col("section") == "verdict") & (F.col("name") == "total"), F.col("n"))).over(Window.partitionBy(by))
    share = F.col("section").isin("verdict", "quality") & (F.col("name") != "total") & (F.col("_total") > 0)
    return n.withColumn("_total", total).withColumn("rate", F.when(share, F.col("n") / F.col("_total"))).drop("_total")


def routing_summary(records: DataFrame, by: str, costs: DataFrame | None = None) -> DataFrame:
    """(by, section, name, value) of records judged by vectors first (source, adaptive, adaptive_reasons, escalation_reasons, calls, cost).

    metric: records, accepted (source axis_derived), escalated, adaptive, calls, calls a record, costs by vectors, by categorical
    judges (``costs``: by, cost) and of both; then counts of sources (unknown where null) and of both
    kinds of reasons, one row ``none`` without any.
    """
    one = F.lit(1)
    accepted = F.coalesce(F.col("source") == "axis_derived", F.lit(False))
    cells = [
        _cell("metric", "", "records", one), _cell("metric", "", "accepted", accepted.cast("int")), _cell("metric", "", "escalated", (~accepted).cast("int")), _cell("metric", "", "adaptive", F.col("adaptive").cast("int")),
        _cell("metric", "", "calls", F.col("calls")), _cell("metric", "", "vector_cost", F.col("cost")), _cell("source", "", F.coalesce("source", F.lit("unknown")), one), _cell("adaptive_reason", "", "none", F.lit(0)), _cell("escalation_reason", "", "none", F.lit(0)),
    ]
    def told(kind: str) -> Column:
        return F.transform(F.coalesce(f"{kind}s", F.array().cast("array<string>")), lambda r: _cell(kind, "", F.coalesce(r, F.lit("unknown")), one))

    n = tally(records, F.concat(F.array(*cells), told("adaptive_reason"), told("escalation_reason")), [by]).drop("row").withColumnRenamed("n", "value")
    group = Window.partitionBy(by, "section")
    n = n.withColumn("_rows", F.count("*").over(group)).where((F.col("name") != "none") | (F.col("_rows") == 1)).drop("_rows")
    spent = n.where("section = 'metric'").groupBy(by).agg(*[F.max(F.when(F.col("name") == m, F.col("value"))).alias(m) for m in ("records", "calls", "vector_cost")])
    spent = spent.join(costs.select(by, F.col("cost").alias("_cost")), by, "left") if costs is not None else spent.withColumn("_cost", F.lit(None).cast("decimal(28,6)"))
    other = F.coalesce(F.col("_cost").cast("decimal(28,6)"), F.lit(0).cast("decimal(28,6)"))
    more = {"calls_per_record": F.col("calls") / F.col("records"), "categorical_cost": other, "cost": F.col("vector_cost") + other}
    pairs = F.array(*[F.struct(F.lit(k).alias("name"), v.cast("decimal(28,6)").alias("value")) for k, v in more.items()])
    extra = spent.select(by, F.lit("metric").alias("section"), F.inline(pairs))
    return n.unionByName(extra)


def classification_layers(packets: DataFrame, tasks: DataFrame, roles: tuple[str, ...], modes: tuple[str, ...]) -> DataFrame:
    """(section, name, n, rate): the extraction layer over all edges, and the literature layer over those with mentions.

    packets (citing, cited, state, outcome, n_mentions, n_bundled, review); tasks (citing, cited, role, mode). Roles and modes are listed
    in full; bundled mentions are a share of mentions, review edges of edges with mentions (0 without any).
    """
    state = lambda s: (F.col("state") == s).cast("int")
    with_mentions = (F.col("n_mentions") > 0).cast("int")
    failed = F.col("state") == "failed"
    edge = [
        _cell("extraction", "", "edges", F.lit(1)), *[_cell("extraction", "", s, state(s)) for s in ("extracted", "failed", "skipped")], _cell("literature", "", "edges_with_mentions", with_mentions),
        _cell("literature", "", "mentions", F.col("n_mentions")), _cell("literature", "", "bundled_mentions", with_mentions * F.col("n_bundled")), _cell("literature", "", "review_edges", with_mentions * F.coalesce("review", F.lit(False)).cast("int")),
    ]
    cells = F.when(failed, F.array(*edge, _cell("failure", "", F.coalesce("outcome", F.lit("unknown")), F.lit(1)))).otherwise(F.array(*edge))
    live = tasks.join(packets.where("n_mentions > 0").select("citing", "cited"), ["citing", "cited"], "left_semi")
    manual = F.col("mode").isin("manual_review_role_ambiguous", "manual_review_extraction_limited").cast("int")
    task = F.array(_cell("literature", "", "tasks", F.lit(1)), _cell("literature", "", "manual_review_tasks", manual), *[_cell("role", "", r, (F.col("role") == r).cast("int")) for r in roles], *[_cell("mode", "", m, (F.col("mode") == m).cast("int")) for m in modes])
    n = tally(packets, cells, []).unionByName(tally(live, task, [])).drop("row").withColumn("n", F.col("n").cast("long"))
    whole = lambda name: F.max(F.when(F.col("name") == name, F.col("n"))).over(Window.partitionBy("section"))
    base = F.when(F.col("name") == "bundled_mentions", whole("mentions")).when(F.col("name") == "review_edges", whole("edges_with_mentions"))
    return n.withColumn("rate", F.when(F.col("name").isin("bundled_mentions", "review_edges"), F.col("n") / F.greatest(base, F.lit(1))))


def failure_detail(message: Column) -> Column:
    """The line of an error message that says what happened: the first, or the second after one that only says that something did; null if it says nothing."""
    lines = F.filter(F.transform(F.split(message, r"\r?\n"), lambda x: F.regexp_replace(x, r"^\s+|\s+$", "")), lambda x: F.length(x) > 0)
    dull = F.get(lines, 0).isin("No seeds produced.", "No seeds produced") | F.get(lines, 0).rlike(r"^Command exited with code \d+\.$")
    told = F.when(dull & (F.size(lines) > 1), F.get(lines, 1)).otherwise(F.get(lines, 0))
    return F.when(message.isNull() | message.rlike(r"^Command exited with code \d+\.$"), None).otherwise(F.coalesce(told, F.lit("")))


def headline(stage: Column, status: Column, message: Column, first_failure: Column) -> Column:
    """What a stage's summary is headed by: its error, for a stopped discovery its first failed paper, else the stage's own words."""
    own = F.lit(None).cast("string")
    for name, words in HEADLINES.items():
        own = F.when(stage == name, words).otherwise(own)
    stopped = (stage == "discover") & status.isin("failed", "cancelled", "interrupted")
    return F.coalesce(F.nullif(failure_detail(message), F.lit("")), F.when(stopped, F.coalesce(first_failure, F.lit(STOPPED))).otherwise(own))


def stage_metrics(stage: str, rows: DataFrame, by: str) -> DataFrame:
    """(by, stage, place, metric, n): the figures that head a stage, from its rows.

    discover (status, n_claims, n_findings), screen (decision, n_edges), evidence (status, n_spans), curate and adjudicate (excluded, verdict).
    """
    active = ~F.coalesce(F.col("excluded"), F.lit(False)) if stage in ("curate", "adjudicate") else None
    count, yes = F.count("*"), lambda c: F.count_if(F.coalesce(c, F.lit(False)))
    sample = lambda: [("Records", count), ("Active", yes(active)), ("Judged", yes(active & F.col("verdict").isNotNull())), ("Partial", yes(active & (F.col("verdict") == "partially_supported")))]
    wanted = {
        "discover": lambda: [("Papers", count), ("Completed", yes(F.col("status") == "completed")), ("Claims", F.sum("n_claims")), ("Findings", F.sum("n_findings"))],
        "screen": lambda: [("Families", count), ("Greenlit", yes(F.col("decision") == "greenlight")), ("Edges", F.sum("n_edges"))],
        "evidence": lambda: [("Tasks", count), ("With evidence", yes(F.col("n_spans") > 0)), ("Evidence spans", F.sum("n_spans"))],
        "curate": sample,
        "adjudicate": sample,
    }[stage]()
    figures = [F.struct(F.lit(k).alias("place"), F.lit(name).alias("metric"), F.coalesce(c, F.lit(0)).cast("long").alias("n")) for k, (name, c) in enumerate(wanted)]
    return rows.groupBy(by).agg(F.array(*figures).alias("f")).select(by, F.lit(stage).alias("stage"), F.inline("f"))
