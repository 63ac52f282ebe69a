"""JSON descriptions of the inputs: the catalog of message files and the session calendar."""

from __future__ import annotations

from datetime import date
from functools import reduce
from operator import or_

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quotegrid.operators.calendar import CalendarRules, Rule

CATALOG = ("dataset string, schema string, symbol string, stype_in string, "
           "files array<struct<date:string,condition:string,rows:bigint,parquet:string,parquet_bytes:bigint>>, _corrupt string")
_HOURS = "struct<open_day_offset:int,open:string,close:string,breaks:array<struct<day_offset:int,start:string,end:string>>>"
CALENDAR = (f"calendar_id string, symbol string, timezone string, valid_from string, valid_through string, sources array<string>, "
            f"regular {_HOURS}, closed_session_dates array<string>, overrides map<string,{_HOURS}>, _corrupt string")


def read_json(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """Documents under a fixed schema; one that doesn't fit is kept whole in ``_corrupt``."""
    reader = spark.read.schema(schema).option("multiLine", True).option("mode", "PERMISSIVE")
    return reader.option("columnNameOfCorruptRecord", "_corrupt").json(path)


def read_catalog(spark: SparkSession, path: str) -> DataFrame:
    """One row per listed file with the identity of its catalog; an unreadable catalog is one row."""
    rows = read_json(spark, path, CATALOG)
    rows = rows.select("dataset", "schema", "symbol", "stype_in", "_corrupt", F.explode_outer("files").alias("f"))
    return rows.select("dataset", "schema", "symbol", "stype_in", "_corrupt", F.col("f.date").alias("file_date"), "f.condition", "f.rows", "f.parquet", "f.parquet_bytes")


def audit_catalog(catalog: DataFrame, identity: dict[str, str]) -> DataFrame:
    """Violations (file_date, rule) of entries as read; several rules may hold for one entry.

    ``identity`` names the values a catalog must state; dates are written YYYY-MM-DD,
    row counts are positive, files are parquet.
    """
    readable = F.col("_corrupt").isNull()
    foreign = reduce(or_, [~F.col(name).eqNullSafe(F.lit(value)) for name, value in identity.items()], F.lit(False))
    plain = F.coalesce(F.date_format(F.try_to_date("file_date", "yyyy-MM-dd"), "yyyy-MM-dd"), F.lit(""))
    rules = {
        "unreadable": ~readable, "wrong_identity": readable & foreign, "bad_date": readable & (plain != F.coalesce("file_date", F.lit("-"))),
        "bad_rows": readable & ~F.coalesce(F.col("rows") > 0, F.lit(False)),
        "not_parquet": readable & ~F.coalesce(F.col("parquet").endswith(".parquet"), F.lit(False))}
    found = F.array_compact(F.array(*[F.when(rule, name) for name, rule in rules.items()]))
    return catalog.select("file_date", F.explode(found).alias("rule"))


def reconcile_files(spark: SparkSession, root: str, catalog: DataFrame) -> DataFrame:
    """Violations (file_date, rule) between the parquet files under ``root`` and the catalog.

    A date's rows and bytes are those of its files together, from a scan that reads no column;
    bytes are compared only where the catalog states them.
    """
    path = F.col("_metadata.file_path")
    files = spark.read.parquet(root).select(path.alias("path"), F.col("_metadata.file_size").alias("bytes")).groupBy("path", "bytes").agg(F.count(F.lit(1)).alias("n"))
    files = files.withColumn("file_date", F.regexp_extract("path", r"(\d{4}-\d{2}-\d{2})", 1))
    stored = files.groupBy("file_date").agg(F.sum("n").alias("_rows"), F.sum("bytes").alias("_bytes"))
    listed = catalog.select("file_date", "rows", "parquet_bytes", F.lit(True).alias("_listed"))
    both = stored.join(listed, "file_date", "full")
    rules = {
        "missing_file": F.col("_rows").isNull(), "unlisted_file": F.col("_listed").isNull(),
        "rows_differ": F.col("_rows").isNotNull() & F.col("_listed").isNotNull() & ~F.col("_rows").eqNullSafe(F.col("rows")),
        "bytes_differ": F.coalesce(F.col("_bytes") != F.col("parquet_bytes"), F.lit(False))}
    found = F.array_compact(F.array(*[F.when(rule, name) for name, rule in rules.items()]))
    return both.select("file_date", F.explode(found).alias("rule"))


def read_calendar(spark: SparkSession, path: str, symbol: str, zone: str) -> CalendarRules:
    """Session rules from the one calendar document at ``path``.

    Refused: an unreadable document, another symbol or zone, no identity or sources, a coverage
    that ends before it begins, and exceptions that are not covered weekdays or are both closed
    and overridden.
    """
    found = read_json(spark, path, CALENDAR).take(2)
    if len(found) != 1 or found[0]["_corrupt"] is not None:
        raise ValueError("the calendar is not one readable document")
    spec = found[0]
    if (spec["symbol"], spec["timezone"]) != (symbol, zone):
        raise ValueError(f"the calendar is for {spec['symbol']} in {spec['timezone']}")
    if not spec["calendar_id"] or not spec["sources"]:
        raise ValueError("the calendar has no identity or sources")
    first, last = date.fromisoformat(spec["valid_from"]), date.fromisoformat(spec["valid_through"])
    closed, overrides = tuple(spec["closed_session_dates"] or ()), spec["overrides"] or {}
    days = [date.fromisoformat(d) for d in {*closed, *overrides}]
    if first > last or any(not first <= d <= last or d.weekday() >= 5 for d in days) or set(closed) & set(overrides):
        raise ValueError("the calendar's dates contradict each other")
    rule = lambda hours: Rule(hours["open_day_offset"], hours["open"], hours["close"], tuple((b["day_offset"], b["start"], b["end"]) for b in hours["breaks"] or ()))
    return CalendarRules(zone=zone, valid_from=spec["valid_from"], valid_through=spec["valid_through"], regular=rule(spec["regular"]),
                         closed=closed, overrides={d: rule(hours) for d, hours in overrides.items()})
