"""Audits as violation tables, session quality, and dataset comparison."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quotegrid.functions.book import all_finite, has_bit, valid_book
from quotegrid.operators.calendar import assign_session, inline
from quotegrid.operators.ordered import row_numbers
from quotegrid.params import BASE_FEATURES, FLAG_BAD_CLOCK, FLAG_LAST, FLAG_MAYBE_BAD_BOOK, MS
from quotegrid.session import settle


def schema_check(df: DataFrame, expected: T.StructType, clocks: tuple = ()) -> DataFrame:
    """Missing columns and wrong types; a clock column may differ in time precision."""
    have = {f.name: f.dataType for f in df.schema.fields}
    rows = []
    for field in expected.fields:
        got = have.get(field.name)
        kind = got.simpleString() if got is not None else None
        clock_ok = field.name in clocks and kind in ("timestamp", "timestamp_ntz", "bigint")
        if got is None or (got != field.dataType and not clock_ok):
            rows.append((field.name, field.dataType.simpleString(), kind, "missing" if got is None else "wrong_type"))
    columns = "column_name, expected, actual, rule"
    return inline(df.sparkSession, columns, rows or [("", "", None, "")]).where("rule <> ''")


def rule_counts(df: DataFrame, rules: dict[str, Column]) -> DataFrame:
    """Violations per rule in one aggregate pass."""
    counts = df.agg(*[F.count_if(F.coalesce(rule, F.lit(True))).alias(name) for name, rule in rules.items()])
    return counts.select(F.inline(F.array(*[F.struct(F.lit(n).alias("rule"), F.col(n).alias("violations")) for n in rules])))


def audit_snapshots(df: DataFrame, interval_ns: int, max_age_ms: int, symbol: str) -> DataFrame:
    """Count per sampling rule of stored snapshots; NULL input breaks a rule."""
    age = (F.col("ts_ns") - F.col("source_recv_ns")) / MS
    flags = F.col("source_flags")
    return rule_counts(df, {
        "null_field": reduce(or_, [F.col(c).isNull() for c in df.columns]),
        "off_grid": F.col("ts_ns") % interval_ns != 0,
        "not_causal": age <= 0,
        "too_old": age > max_age_ms,
        "age_misstated": F.abs(age - F.col("age_ms")) > 1e-6,
        "unreliable_flags": ~has_bit(flags, FLAG_LAST) | has_bit(flags, FLAG_BAD_CLOCK) | has_bit(flags, FLAG_MAYBE_BAD_BOOK),
        "invalid_book": ~valid_book(),
        "wrong_symbol": F.col("symbol") != symbol})


def audit_order(df: DataFrame) -> DataFrame:
    """Duplicate grid times, and source files whose time ranges overlap."""
    twice = df.groupBy("instrument_id", "ts_ns").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    spans = df.groupBy("instrument_id", "file_date").agg(F.min("ts_ns").alias("lo"), F.max("ts_ns").alias("hi"))
    files = Window.partitionBy("instrument_id").orderBy("file_date").rowsBetween(Window.unboundedPreceding, -1)
    late = spans.withColumn("_hi", F.max("hi").over(files)).where("lo <= _hi")
    return twice.select(F.lit("duplicate_time").alias("rule"), F.col("ts_ns").cast("string").alias("item")).unionByName(
        late.select(F.lit("files_overlap").alias("rule"), F.col("file_date").alias("item")))


def audit_instrument(df: DataFrame) -> DataFrame:
    """Rows per instrument when there is more than one."""
    counts = df.groupBy("instrument_id").agg(F.count(F.lit(1)).alias("rows"))
    return counts.withColumn("_n", F.count(F.lit(1)).over(Window.partitionBy(F.lit(1)))).where("_n > 1").drop("_n")


def audit_sessions(df: DataFrame, segments: DataFrame) -> DataFrame:
    """Rows whose stored session or segment differs from the calendar's."""
    kept = [c for c in df.columns if c not in ("session_id", "segment_id", *segments.columns)]
    bare = df.select(*kept, F.col("session_id").alias("stored_session"), F.col("segment_id").alias("stored_segment"))
    again = assign_session(bare, segments)
    ok = (F.col("session_class") == "assigned") & F.col("session_id").eqNullSafe(F.col("stored_session")) & F.col("segment_id").eqNullSafe(F.col("stored_segment"))
    return again.where(~ok)


def audit_features(df: DataFrame) -> DataFrame:
    """Rows whose stored mid disagrees with the quotes or whose flag disagrees with the features."""
    mid = F.abs(F.col("mid_price") - (F.col("bid_px_00") + F.col("ask_px_00")) / 2) > 1e-9
    flag = ~F.col("feature_valid").eqNullSafe(all_finite(BASE_FEATURES))
    rule = F.when(F.coalesce(mid, F.lit(True)), "mid_price").when(flag, "feature_valid")
    return df.withColumn("rule", rule).where("rule is not null")


def audit_blocks(df: DataFrame, interval_ns: int) -> DataFrame:
    """Rows where the stored block changes without a gap, or does not change at one."""
    w = Window.partitionBy("instrument_id", "session_id").orderBy("ts_ns")
    actual = (F.col("ts_ns") - F.lag("ts_ns").over(w) != interval_ns) | (F.col("segment_id") != F.lag("segment_id").over(w))
    stored = F.col("continuous_block") != F.lag("continuous_block").over(w)
    rows = df.withColumns({"_actual": actual, "_stored": stored})
    return rows.where(F.col("_actual") != F.col("_stored")).drop("_actual", "_stored")


def audit_quotes(df: DataFrame, interval_ns: int) -> DataFrame:
    """Count per replay rule: causal receive time, sane quotes, on-grid times that increase strictly.

    The order is that of the messages behind the quotes (``sequence``, then time) within a source
    file; NULL input breaks a rule.
    """
    order = Window.partitionBy("instrument_id", "file_date").orderBy("sequence", "ts_ns")
    df = df.withColumn("_before", F.lag("ts_ns").over(order))
    return rule_counts(df, {
        "not_increasing": F.when(F.col("_before").isNull(), False).otherwise(F.col("ts_ns") <= F.col("_before")),
        "received_late": F.col("source_recv_ns") >= F.col("ts_ns"), "off_grid": F.col("ts_ns") % interval_ns != 0,
        "bad_bid": ~(F.col("bid_px_00") > 0), "crossed": F.col("ask_px_00") < F.col("bid_px_00"),
        "mid_mismatch": F.abs(F.col("mid_price") - (F.col("bid_px_00") + F.col("ask_px_00")) / 2) > 1e-9})


def expected_points(segments: DataFrame, interval_ns: int) -> DataFrame:
    points = F.expr(f"end_ns div {interval_ns}L - start_ns div {interval_ns}L")
    return segments.groupBy("session_id").agg(F.sum(points).alias("expected_grid_points"))


def session_quality(df: DataFrame, segments: DataFrame, interval_ns: int, ready: DataFrame) -> DataFrame:
    """Coverage and usability of each instrument's observed sessions; ``ready`` has learning_ready per row."""
    w = Window.partitionBy("instrument_id", "session_id", "segment_id").orderBy("ts_ns")
    gap = F.expr(f"(ts_ns - _before) div {interval_ns}L - 1")
    rows = df.withColumn("_before", F.lag("ts_ns").over(w)).withColumn("_gap", F.coalesce(gap, F.lit(0)))
    key = ["instrument_id", "session_id"]
    seen = rows.groupBy(*key).agg(
        F.count(F.lit(1)).alias("observed_snapshots"), F.sum("_gap").alias("internal_missing"),
        F.max("continuous_block").alias("continuous_blocks"), F.min("ts_ns").alias("first_ns"), F.max("ts_ns").alias("last_ns"),
        F.count_if("feature_valid").alias("feature_valid"))
    done = ready.groupBy(*key).agg(F.count_if("learning_ready").alias("learning_ready"))
    out = seen.join(expected_points(segments, interval_ns), "session_id").join(done, key, "left")
    return out.withColumns({
        "missing_grid_points": F.col("expected_grid_points") - F.col("observed_snapshots"),
        "coverage_complete": F.col("expected_grid_points") == F.col("observed_snapshots")})


def unobserved(df: DataFrame, segments: DataFrame, interval_ns: int) -> DataFrame:
    """Zero rows for calendar sessions inside the data's time range without any snapshot."""
    span = df.agg(F.min("ts_ns").alias("_lo"), F.max("ts_ns").alias("_hi"))
    inside = segments.select("session_id", "open_ns", "close_ns").distinct().join(
        span, (F.col("open_ns") < F.col("_hi")) & (F.col("close_ns") >= F.col("_lo")), "left_semi")
    gone = inside.join(df.select("session_id").distinct(), "session_id", "left_anti").select("session_id")
    zero = {c: F.lit(0).cast("bigint") for c in ("observed_snapshots", "internal_missing", "continuous_blocks", "feature_valid", "learning_ready")}
    rows = gone.join(expected_points(segments, interval_ns), "session_id").withColumns(zero)
    return rows.withColumns({"missing_grid_points": F.col("expected_grid_points"), "coverage_complete": F.lit(False)})


def exclusions(classed: DataFrame) -> DataFrame:
    return classed.agg(F.count_if(F.col("session_class") == "outside").alias("outside_trading"),
                       F.count_if(F.col("session_class") == "preopen").alias("preopen_source"),
                       F.count_if(F.col("session_class") == "uncovered").alias("uncovered_calendar"), F.count(F.lit(1)).alias("snapshots"))


def dataset_diff(a: DataFrame, b: DataFrame, key: list[str]) -> DataFrame:
    """Rows on one side only and rows whose columns differ (NULL equals NULL), by key."""
    if a.schema.simpleString() != b.schema.simpleString():
        raise ValueError("datasets differ in schema")
    columns = [c for c in a.columns if c not in key]
    # copies of a key are told apart by their place among them, so equal tables have no difference
    order = Window.partitionBy(*key).orderBy(*columns)
    left = a.select(*key, F.row_number().over(order).alias("_copy"), F.struct(*columns).alias("_a"))
    right = b.select(*key, F.row_number().over(order).alias("_copy"), F.struct(*columns).alias("_b"))
    rows = left.join(right, [*key, "_copy"], "full")
    wrong = F.array_compact(F.array(*[F.when(~F.col(f"_a.{c}").eqNullSafe(F.col(f"_b.{c}")), c) for c in columns]))
    kind = F.when(F.col("_a").isNull(), "only_right").when(F.col("_b").isNull(), "only_left").when(F.size(wrong) > 0, "changed")
    return rows.select(*key, kind.alias("kind"), F.when(kind == "changed", F.array_join(wrong, ",")).alias("columns")).where("kind is not null")


def ordered_diff(a: DataFrame, b: DataFrame, order: list[str]) -> DataFrame:
    """Positions at which two tables, each in its own ``order``, do not hold the same row (NULL equals NULL).

    Every row gets its position in the whole table and meets the row at the same position of the other table, so a row
    that is missing, added or moved shows at all positions it shifts.  ``order`` should end in a key: rows equal in it
    have no order between them, and are put in the order of their other columns."""
    if a.schema.simpleString() != b.schema.simpleString():
        raise ValueError("datasets differ in schema")
    rest = [c for c in a.columns if c not in order]
    placed = [row_numbers(t, *order, *rest, name="_position").select("_position", F.struct(*t.columns).alias(side)) for t, side in ((a, "_a"), (b, "_b"))]
    rows = placed[0].join(placed[1], "_position", "full")
    wrong = F.array_compact(F.array(*[F.when(~F.col(f"_a.{c}").eqNullSafe(F.col(f"_b.{c}")), c) for c in a.columns]))
    kind = F.when(F.col("_a").isNull(), "only_right").when(F.col("_b").isNull(), "only_left").when(F.size(wrong) > 0, "changed")
    found = rows.select(F.col("_position").alias("position"), kind.alias("kind"), F.when(kind == "changed", F.array_join(wrong, ",")).alias("columns"),
                        *[F.col(f"_a.{c}").alias(f"left_{c}") for c in order], *[F.col(f"_b.{c}").alias(f"right_{c}") for c in order])
    return found.where("kind is not null")


def first_mismatch(diff: DataFrame, key: list[str]) -> DataFrame:
    return diff.orderBy(*key).limit(1)


def diff_report(a: DataFrame, b: DataFrame, order: list[str]) -> DataFrame:
    """One row: the row counts of both sides, how many positions differ, and the first of them (NULL if equal)."""
    diff = settle(ordered_diff(a, b, order), "diff")
    counts = diff.agg(F.count("*").alias("different_positions")).withColumns({"left_rows": F.lit(a.count()), "right_rows": F.lit(b.count())})
    first = first_mismatch(diff, ["position"]).select(F.lit(True).alias("_one"), F.col("position").alias("first_position"), F.col("kind").alias("first_kind"), F.col("columns").alias("first_columns"))
    out = counts.withColumn("_one", F.lit(True)).join(first, "_one", "left").drop("_one")
    return out.select("left_rows", "right_rows", (F.col("left_rows") == F.col("right_rows")).alias("same_count"), "different_positions", "first_position", "first_kind", "first_columns")


def diff_except(a: DataFrame, b: DataFrame, key: list[str], drop: list[str]) -> DataFrame:
    return dataset_diff(a.drop(*drop), b.drop(*drop), key)


def fingerprint(df: DataFrame, columns: list[str]) -> DataFrame:
    """Row count and an order-free sum of row hashes (NULL and empty text stay apart)."""
    # values carry their length, so that no two rows have the same text
    sized = [F.concat(F.length(F.col(c).cast("string")).cast("string"), F.lit(":"), F.col(c).cast("string")) for c in columns]
    text = F.concat(*[F.coalesce(x, F.lit("-1:")) for x in sized])
    return df.agg(F.count(F.lit(1)).alias("rows"),
                  F.sum(F.conv(F.substring(F.md5(text), 1, 16), 16, 10).cast("decimal(20,0)")).cast("string").alias("fingerprint"))


def coverage_matrix(runs: DataFrame, dates: DataFrame, ages_ms: list[int]) -> DataFrame:
    """(age, date) pairs not verified exactly once in full."""
    ages = F.explode(F.array(*[F.lit(a).cast("bigint") for a in ages_ms]))
    wanted = dates.select("file_date").distinct().withColumn("max_age_ms", ages)
    seen = runs.groupBy("max_age_ms", "file_date").agg(F.count(F.lit(1)).alias("_n"), F.bool_or("partial").alias("_partial"))
    rows = wanted.join(seen, ["max_age_ms", "file_date"], "full")
    n = F.coalesce("_n", F.lit(0))
    rule = F.when(n == 0, "missing").when(n > 1, "repeated").when(F.col("_partial"), "partial")
    return rows.select("max_age_ms", "file_date", rule.alias("rule")).where("rule is not null")


def causal_diff(derive: Callable[[DataFrame], DataFrame], quotes: DataFrame, changed: DataFrame, until_ns: int, clock: str = "ts_ns") -> DataFrame:
    """Derived rows up to T that change when quotes after T do: empty for a causal operator."""
    before = derive(quotes).where(F.col(clock) <= until_ns)
    after = derive(changed).where(F.col(clock) <= until_ns)
    return before.exceptAll(after).unionByName(after.exceptAll(before))
