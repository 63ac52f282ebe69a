"""Scans, sinks and catalogs of message files and prepared datasets."""

from __future__ import annotations

from functools import reduce
from operator import and_

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quotegrid.functions.book import finite
from quotegrid.operators.features import SESSION
from quotegrid.params import BASE_FEATURES, BOOK_COLUMNS, CLOCKS, MESSAGE_COLUMNS, MS, SECOND
from quotegrid.sources.runs import publish, read_run

# Catalog conditions a source may carry.
KNOWN_CONDITIONS = ("available", "degraded")


def read_book(spark: SparkSession, path: str, unit: str = "ns") -> DataFrame:
    """Only the needed message columns of the files under ``path``.

    Clocks become integer nanoseconds; ``seq`` is the row position inside the
    file, the order every sampling rule refers to; ``file_date`` comes from a
    ``YYYY-MM-DD`` in the file path.  Integer clocks count ``unit``; a file with
    nanosecond timestamps needs ``spark.sql.legacy.parquet.nanosAsLong=true``.
    """
    raw = spark.read.parquet(path)
    renamed = {"recv_ns": "ts_recv", "event_ns": "ts_event"}
    needed = {c: renamed.get(c, c) for c in MESSAGE_COLUMNS}
    missing = sorted(set(needed.values()) - set(raw.columns))
    if missing:
        raise ValueError(f"message files lack columns {missing}")
    scale = {"ns": 1, "us": 1000, "ms": MS}[unit]

    def clock(name):
        kind = raw.schema[name].dataType.typeName()
        if kind == "long":
            return F.col(name) * scale
        if kind == "timestamp":
            return F.unix_micros(name) * 1000
        return F.expr(f"timestampdiff(MICROSECOND, TIMESTAMP_NTZ'1970-01-01 00:00:00', {name})") * 1000

    columns = [clock(source).alias(name) if name in CLOCKS else F.col(source).alias(name) for name, source in needed.items()]
    date = F.regexp_extract(F.col("_metadata.file_path"), r"(\d{4}-\d{2}-\d{2})", 1)
    # without a date all such files would be sampled as one
    dated = F.when(date != "", date).otherwise(F.raise_error(F.concat(F.lit("no date in the path of "), F.col("_metadata.file_path"))).cast("string"))
    return raw.select(*columns, F.col("_metadata.row_index").alias("seq"), dated.alias("file_date"))


def null_audit(df: DataFrame, columns: list[str] | None = None) -> DataFrame:
    """Rows and NULLs per column in one aggregate pass."""
    columns = columns or df.columns
    counts = df.agg(F.count(F.lit(1)).alias("rows"), *[F.count_if(F.col(c).isNull()).alias(c) for c in columns])
    pairs = F.array(*[F.struct(F.lit(c).alias("column_name"), F.col(c).alias("nulls")) for c in columns])
    return counts.select("rows", F.inline(pairs))


def require_empty(violations: DataFrame, message: str) -> None:
    """Fail-fast form of an audit: raise when its violation table has a row."""
    if violations.take(1):
        raise ValueError(message)


def with_lineage(df: DataFrame) -> DataFrame:
    """Name of the file each row was read from."""
    return df.withColumn("source_file", F.element_at(F.split(F.col("_metadata.file_path"), "/"), -1))


def select_sources(catalog: DataFrame, dates: DataFrame, include_degraded: bool = False) -> DataFrame:
    """Verdict per wanted date: exactly one entry, known condition, degraded only if allowed."""
    entries = catalog.groupBy("file_date").agg(
        F.count(F.lit(1)).alias("entries"), F.max("condition").alias("condition"), F.sum("rows").alias("rows"))
    found = dates.select("file_date").distinct().join(entries, "file_date", "left")
    n = F.coalesce("entries", F.lit(0))
    verdict = (F.when(n == 0, "missing").when(n > 1, "ambiguous")
               .when(~F.col("condition").isin(*KNOWN_CONDITIONS), "unknown_condition")
               .when((F.col("condition") == "degraded") & F.lit(not include_degraded), "degraded_refused")
               .otherwise("selected"))
    return found.select("file_date", n.alias("entries"), "condition", "rows", verdict.alias("verdict"))


def reconcile_catalog(book: DataFrame, catalog: DataFrame) -> DataFrame:
    """Dates whose stored row count differs from the catalog, either way round."""
    stored = book.groupBy("file_date").agg(F.count(F.lit(1)).alias("stored_rows"))
    listed = catalog.select("file_date", F.col("rows").alias("catalog_rows"))
    return stored.join(listed, "file_date", "full").where(~F.col("stored_rows").eqNullSafe(F.col("catalog_rows")))


def write_snapshots(df: DataFrame, root: str, run: str, provenance: dict[str, str], partial: bool = False) -> dict:
    """Publish snapshots per age and source date; never overwrites, never empty, every quote causal and within its age."""
    spread = df.repartition("max_age_ms", "file_date", F.expr(f"ts_ns div {3600 * SECOND}L")).sortWithinPartitions("ts_ns")
    rules = {"not_causal": F.col("source_recv_ns") >= F.col("ts_ns"), "too_old": F.col("age_ms") > F.col("max_age_ms")}
    return publish(spread, root, run, ["max_age_ms", "file_date"], rules=rules, provenance=provenance, partial=partial)


def write_prepared(df: DataFrame, root: str, run: str, provenance: dict[str, str], partial: bool = False) -> dict:
    """Publish one folder per session, clustered by time inside so window scans skip row groups."""
    spread = df.repartition(*SESSION, F.expr(f"ts_ns div {3600 * SECOND}L")).sortWithinPartitions("session_id", "ts_ns")
    rules = {"outside_session": (F.col("ts_ns") <= F.col("open_ns")) | (F.col("ts_ns") > F.col("close_ns"))}
    return publish(spread, root, run, ["session_id"], rules=rules, provenance=provenance, partial=partial)


def read_window(spark: SparkSession, root: str, run: str, lo_ns: int, hi_ns: int, sessions: list[str] | None = None) -> DataFrame:
    """Rows of a published run with lo <= ts < hi: session folders prune, row groups skip by time."""
    rows = read_run(spark, root, run)
    if sessions:
        rows = rows.where(F.col("session_id").isin(*sessions))
    return rows.where((F.col("ts_ns") >= lo_ns) & (F.col("ts_ns") < hi_ns))


DECISION_COLUMNS = [
    "instrument_id", "symbol", "ts_ns", "source_event_ns", "source_recv_ns", "sequence", "source_flags", "age_ms",
    *BOOK_COLUMNS, "session_id", "segment_id", "continuous_block", "mid_price", "feature_valid", *BASE_FEATURES]


def decision_view(df: DataFrame) -> DataFrame:
    """What decision code may read: no column that looks into the future."""
    return df.select(*[c for c in DECISION_COLUMNS if c in df.columns])


def not_finite(df: DataFrame) -> DataFrame:
    """Rows holding NaN or infinity; NULL is a legal missing value."""
    doubles = [f.name for f in df.schema.fields if f.dataType.typeName() in ("double", "float")]
    if not doubles:
        return df.limit(0)
    return df.where(~reduce(and_, [F.col(c).isNull() | finite(F.col(c)) for c in doubles]))


def write_results(df: DataFrame, path: str, fmt: str = "parquet") -> None:
    """Result table sink: refuses NaN and infinity, refuses to overwrite."""
    require_empty(not_finite(df), "results contain NaN or infinite values")
    df.write.mode("errorifexists").format(fmt).save(path)
