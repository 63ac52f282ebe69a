"""Write, audit, publish: an output exists for readers once its manifest row is written.

Rows go to a folder of the run's own and are counted and judged while they are written.
Only a run without violations gets a row in the ``runs`` table beside the data, so a job
that is lost half way, or an output that breaks a rule, is never read by mistake.
"""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

RUNS = "run string, rows bigint, first_ns bigint, last_ns bigint, partial boolean, columns string"


def published(spark: SparkSession, root: str) -> DataFrame:
    """The manifest: a row per published run; empty where nothing was published."""
    try:
        return spark.read.schema(RUNS).parquet(f"{root}/runs")
    except AnalysisException as error:
        if error.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], RUNS)


def publish(df: DataFrame, root: str, run: str, partition_by: list[str], *, rules: dict[str, Column],
            provenance: dict[str, str], partial: bool = False) -> dict:
    """Write ``df`` as ``run`` under ``root`` and publish it; returns its manifest row.

    ``rules`` name the rows that must not occur (NULL counts as broken); ``provenance``
    becomes columns next to ``run`` and ``partial``.  Refused: an empty output, a broken
    rule, columns other than those of the runs published before, and a run that exists.
    """
    spark = df.sparkSession
    stamped = df.withColumns({**{name: F.lit(value) for name, value in provenance.items()}, "run": F.lit(run), "partial": F.lit(partial)})
    columns = ", ".join(sorted(f"{f.name} {f.dataType.simpleString()}" for f in stamped.schema.fields))
    for earlier in published(spark, root).select("columns").distinct().take(2):
        if earlier["columns"] != columns:
            raise ValueError(f"run {run} has other columns than the runs before it")
    seen = Observation(f"publish-{run}")
    # Rows are counted in the writing stage itself, where every task counts once.
    watched = stamped.observe(
        seen, F.count(F.lit(1)).alias("rows"), F.min("ts_ns").alias("first_ns"), F.max("ts_ns").alias("last_ns"),
        *[F.count_if(F.coalesce(rule, F.lit(True))).alias(f"rule_{name}") for name, rule in rules.items()])
    watched.write.option("compression", "zstd").partitionBy(*partition_by).mode("errorifexists").parquet(f"{root}/data/{run}")
    figures = seen.get
    if not figures["rows"]:
        raise ValueError(f"run {run} has no rows")
    broken = {name: figures[f"rule_{name}"] for name in rules if figures[f"rule_{name}"]}
    if broken:
        raise ValueError(f"run {run} breaks rules: {broken}")
    row = (run, figures["rows"], figures["first_ns"], figures["last_ns"], partial, columns)
    spark.createDataFrame([row], RUNS).coalesce(1).write.mode("append").parquet(f"{root}/runs")
    return dict(zip(["run", "rows", "first_ns", "last_ns", "partial", "columns"], row))


def read_run(spark: SparkSession, root: str, run: str, allow_partial: bool = False) -> DataFrame:
    """The rows of a published run; refuses unpublished runs and, unless allowed, partial ones."""
    found = published(spark, root).where(F.col("run") == run).take(2)
    if len(found) != 1:
        raise ValueError(f"run {run} is not published" if not found else f"run {run} is published twice")
    if found[0]["partial"] and not allow_partial:
        raise ValueError(f"run {run} is partial")
    rows = spark.read.parquet(f"{root}/data/{run}")
    kinds = dict(kind.split(" ", 1) for kind in found[0]["columns"].split(", ") if " " in kind)
    # folder names lose their type
    return rows.select(*[F.col(c).cast(kinds[c]).alias(c) if c in kinds else F.col(c) for c in rows.columns])
