"""Stage artifacts: JSON in and out, manifests, run stamps."""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from ..functions.shapes import Shape, first_error


class ArtifactError(ValueError):
    """An artifact is missing, empty, no JSON, or breaks a rule; the message says which."""


def load_json(spark: SparkSession, path: str, schema: StructType | str, label: str, rules: dict[str, Column] | None = None, shape: Shape | None = None) -> DataFrame:
    """Rows of JSON documents under ``path``; fields beyond the schema are dropped.

    rules: conditions that every row must meet, by name. shape: what each file must look like; the error names the first
    place where one does not.
    """
    try:
        some = spark.read.format("binaryFile").load(path).select("path").head(1)  # Spark reads no rows from files of no bytes
    except AnalysisException as e:
        raise ArtifactError(f"{label}: no file at {path}") from e
    if not some:
        raise ArtifactError(f"{label}: empty file {path}")
    if spark.read.text(path, wholetext=True).where(F.try_parse_json("value").isNull()).head(1):
        raise ArtifactError(f"{label}: no valid JSON at {path}")
    if shape is not None:
        whole = spark.read.text(path, wholetext=True).select(first_error(F.try_parse_json("value"), shape).alias("error"))
        broken = whole.where(F.col("error").isNotNull()).head(1)
        if broken:
            where, _, message = broken[0]["error"].partition(": ")
            raise ArtifactError(f"Invalid {label} artifact at {path}: {where or '<root>'} {message}")
    rows = spark.read.schema(schema).option("multiLine", True).option("mode", "FAILFAST").json(path)
    for name, rule in (rules or {}).items():
        if rows.where(~F.coalesce(rule, F.lit(False))).head(1):
            raise ArtifactError(f"{label}: rule {name} is broken at {path}")
    return rows


def write_json(df: DataFrame, path: str, partitions: tuple[str, ...] = ()) -> None:
    """JSON lines, a folder for each run, stage and family where ``partitions`` names them."""
    df.write.mode("overwrite").partitionBy(*partitions).json(path)


def manifest(spark: SparkSession, artifact: str, sources: list[str], kind: str, generator: str) -> DataFrame:
    """(role, path, bytes, sha256, kind, generator) of an artifact's and its sources' files; the hashing is a Spark job over the files."""
    def files(role: str, path: str) -> DataFrame:
        return spark.read.format("binaryFile").load(path).select(F.lit(role).alias("role"), "path", F.col("length").alias("bytes"), F.sha2("content", 256).alias("sha256"))

    out = files("artifact", artifact)
    for path in sources:
        out = out.unionByName(files("source", path))
    return out.withColumn("kind", F.lit(kind)).withColumn("generator", F.lit(generator))


def next_stamp(stems: DataFrame, date: str, column: str = "stem") -> DataFrame:
    """One row: the next run stamp of ``date`` after those among the stems ``YYYY-MM-DD_NNN...``."""
    number = F.regexp_extract(column, rf"^{date}_(\d{{3}})", 1)
    top = stems.agg(F.max(F.when(number != "", number.cast("int"))).alias("n"))
    return top.select(F.concat(F.lit(f"{date}_"), F.lpad((F.coalesce("n", F.lit(0)) + 1).cast("string"), 3, "0")).alias("stamp"))


def newest(files: DataFrame, suffixes: list[str], column: str = "path") -> DataFrame:
    """(suffix, path): for each suffix the last file in lexical order."""
    dim = files.sparkSession.createDataFrame([(s,) for s in suffixes], "suffix string")
    return files.join(F.broadcast(dim), F.expr(f"endswith({column}, suffix)")).groupBy("suffix").agg(F.max(column).alias(column))
