"""Trading-session calendars and the joins that attach them to clocks."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quotegrid.operators.ordered import asof, interval_join
from quotegrid.params import DAY, SECOND


@dataclass(frozen=True)
class Rule:
    """Local wall-clock hours of a session; offsets count days before its date."""

    open_offset: int
    open: str
    close: str
    breaks: tuple = ()  # (day offset, start, end)

    def segments(self):
        cursor = (self.open_offset, self.open)
        for number, (offset, start, end) in enumerate(self.breaks):
            yield number, *cursor, offset, start
            cursor = (offset, end)
        yield len(self.breaks), *cursor, 0, self.close


@dataclass(frozen=True)
class CalendarRules:
    zone: str
    valid_from: str
    valid_through: str
    regular: Rule
    closed: tuple = ()
    overrides: dict = field(default_factory=dict)


def inline(spark: SparkSession, columns: str, rows: list[tuple]) -> DataFrame:
    """Small configuration table as a local relation, so its size is known to the planner."""
    literal = lambda v: "array(" + ", ".join(map(literal, v)) + ")" if isinstance(v, list) else "NULL" if v is None else repr(v) if isinstance(v, str) else str(v).upper() if isinstance(v, bool) else str(v)
    values = ", ".join("(" + ", ".join(literal(v) for v in row) + ")" for row in rows)
    return spark.sql(f"SELECT * FROM VALUES {values} AS t({columns})")


def _clock_seconds(column: str) -> Column:
    part = lambda i: F.split(column, ":").getItem(i).cast("int")
    return part(0) * 3600 + part(1) * 60


def _utc_ns(day: Column, offset: str, clock: str, zone: str) -> Column:
    """Wall clock in ``zone`` to UTC; goes through plain day arithmetic so that the
    session time zone of the cluster never matters."""
    local = (F.unix_date(day).cast("bigint") + F.col(offset)) * 86_400 + _clock_seconds(clock)
    return F.unix_micros(F.to_utc_timestamp(F.timestamp_seconds(local), zone)) * 1000


def expand_calendar(spark: SparkSession, rules: CalendarRules) -> DataFrame:
    """Open segments in UTC: weekdays in range, minus closed dates, override or regular hours."""
    parts = [(key, *seg) for key, rule in {"regular": rules.regular, **rules.overrides}.items() for seg in rule.segments()]
    rule_table = inline(spark, "rule, number, start_offset, start_clock, end_offset, end_clock", parts)
    span = F.expr(f"sequence(DATE'{rules.valid_from}', DATE'{rules.valid_through}')")
    days = spark.range(1).select(F.explode(span).alias("day"))
    days = days.where((F.weekday("day") < 5) & ~F.col("day").cast("string").isin(*rules.closed))
    special = F.col("day").cast("string").isin(*rules.overrides)
    days = days.withColumn("rule", F.when(special, F.col("day").cast("string")).otherwise("regular"))
    segments = days.join(rule_table, "rule").select(
        F.col("day").cast("string").alias("session_id"), F.col("number").cast("bigint").alias("number"),
        _utc_ns(F.col("day"), "start_offset", "start_clock", rules.zone).alias("start_ns"),
        _utc_ns(F.col("day"), "end_offset", "end_clock", rules.zone).alias("end_ns"))
    session = Window.partitionBy("session_id")
    return segments.select(
        "session_id", F.concat_ws(":", "session_id", "number").alias("segment_id"), "start_ns", "end_ns",
        F.min("start_ns").over(session).alias("open_ns"), F.max("end_ns").over(session).alias("close_ns"))


def sessions(segments: DataFrame) -> DataFrame:
    return segments.select("session_id", "open_ns", "close_ns").distinct()


def audit_calendar(segments: DataFrame, rules: CalendarRules) -> DataFrame:
    """Violations: unordered or overlapping segments, exceptions outside covered weekdays."""
    # A calendar holds a few rows per day, so one window over it is small.
    order = Window.partitionBy(F.lit(1)).orderBy("start_ns")
    checked = segments.withColumn("_before", F.lag("end_ns").over(order))
    bad = checked.select(
        F.when(F.col("start_ns") >= F.col("end_ns"), "empty_segment").when(F.col("_before") > F.col("start_ns"), "overlap").alias("rule"),
        F.col("segment_id").alias("item")).where("rule is not null")
    spark = segments.sparkSession
    exceptions = [(d,) for d in {*rules.closed, *rules.overrides}]
    if not exceptions:
        return bad
    dates = inline(spark, "item", sorted(exceptions))
    wrong = (F.col("item") < rules.valid_from) | (F.col("item") > rules.valid_through) | (F.weekday(F.to_date("item")) >= 5)
    return bad.unionByName(dates.where(wrong).select(F.lit("exception_not_covered").alias("rule"), "item"))


def coverage_span(segments: DataFrame) -> DataFrame:
    return segments.agg(F.min("start_ns").alias("cover_start"), (F.max("end_ns") + 1).alias("cover_end"))


def out_of_coverage(df: DataFrame, segments: DataFrame) -> DataFrame:
    """Rows before the first open or after the last close: violations."""
    return interval_join(df, coverage_span(segments), "ts_ns", "cover_start", "cover_end").where(
        "cover_start is null").drop("cover_start", "cover_end")


def assign_session(df: DataFrame, segments: DataFrame) -> DataFrame:
    """Attach the segment with start < ts <= end; ``session_class`` tells assigned,
    outside (no open segment) or preopen (quote received before the segment opened)."""
    joined = interval_join(df, segments, "ts_ns", "start_ns", "end_ns", closed="right")
    kind = (F.when(F.col("start_ns").isNull(), "outside")
            .when(F.col("source_recv_ns") < F.col("start_ns"), "preopen").otherwise("assigned"))
    return joined.withColumn("session_class", kind)


def classify(df: DataFrame, segments: DataFrame) -> DataFrame:
    """assign_session for all rows: those the calendar doesn't cover are ``uncovered``, never left out."""
    spanned = interval_join(df, coverage_span(segments), "ts_ns", "cover_start", "cover_end")
    kind = F.when(F.col("cover_start").isNull(), "uncovered").otherwise(F.col("session_class"))
    return assign_session(spanned, segments).withColumn("session_class", kind).drop("cover_start", "cover_end")


def assigned(df: DataFrame, segments: DataFrame) -> DataFrame:
    """Snapshots of open segments only, with segment and session bounds."""
    rows = assign_session(df, segments).where("session_class = 'assigned'").drop("session_class")
    return rows.withColumnsRenamed({"start_ns": "segment_start_ns", "end_ns": "segment_end_ns"})


def required_partitions(session_table: DataFrame) -> DataFrame:
    """UTC dates whose files a session needs."""
    day = lambda c: F.date_from_unix_date(F.expr(f"CAST({c} div {DAY}L AS INT)"))
    dates = session_table.select("session_id", F.explode(F.sequence(day("open_ns"), day("close_ns"))).alias("file_date"))
    return dates.withColumn("file_date", F.col("file_date").cast("string"))


def coverage(session_table: DataFrame, parts: DataFrame, quality: DataFrame) -> DataFrame:
    """Per session: required and missing source dates, snapshots, usable or not."""
    present = parts.select("file_date").distinct().withColumn("_have", F.lit(1))
    need = required_partitions(session_table).join(present, "file_date", "left")
    need = need.groupBy("session_id").agg(
        F.count(F.lit(1)).alias("required"), F.count_if(F.col("_have").isNull()).alias("missing"))
    seen = quality.select("session_id", "observed_snapshots")
    out = need.join(seen, "session_id", "left").withColumn("observed_snapshots", F.coalesce("observed_snapshots", F.lit(0)))
    return out.withColumn("usable", (F.col("missing") == 0) & (F.col("observed_snapshots") >= 2))


def audit_phases(phases: DataFrame, session_table: DataFrame) -> DataFrame:
    """Violations of phase day lists: repeated day, unknown day, skipped session, phases out of order.

    ``phases`` has phase, phase_order, session_id.
    """
    days = phases.groupBy("session_id").agg(F.count(F.lit(1)).alias("_n"))
    repeated = days.where("_n > 1").select(F.lit("repeated_day").alias("rule"), "session_id")
    unknown = days.join(session_table, "session_id", "left_anti").select(F.lit("unknown_day").alias("rule"), "session_id")
    span = phases.agg(F.min("session_id").alias("_lo"), F.max("session_id").alias("_hi"))
    inside = session_table.join(span, (F.col("session_id") >= F.col("_lo")) & (F.col("session_id") <= F.col("_hi")), "left_semi")
    skipped = inside.join(days, "session_id", "left_anti").select(F.lit("skipped_session").alias("rule"), "session_id")
    order = Window.partitionBy(F.lit(1)).orderBy("session_id")
    mixed = phases.withColumn("_before", F.lag("phase_order").over(order)).where("phase_order < _before")
    return repeated.unionByName(unknown).unionByName(skipped).unionByName(
        mixed.select(F.lit("phase_out_of_order").alias("rule"), "session_id"))


def weekly_schedule(session_table: DataFrame, bootstrap: str, through: str) -> DataFrame:
    """Bootstrap session, then the first session of each later ISO week."""
    day = F.to_date("session_id")
    weeks = session_table.withColumns({
        "iso_year": F.extract(F.lit("YEAROFWEEK"), day).cast("bigint"), "iso_week": F.weekofyear(day).cast("bigint")})
    first = Window.partitionBy("iso_year", "iso_week").orderBy("session_id")
    weekly = weeks.withColumn("_first", F.row_number().over(first) == 1)
    is_boot = F.col("session_id") == bootstrap
    due = is_boot | (F.col("_first") & (F.col("session_id") > bootstrap) & (F.col("session_id") <= through))
    return weekly.where(due).select(
        F.col("session_id").alias("update_session"), F.col("open_ns").alias("available_at_ns"), "iso_year", "iso_week",
        F.when(is_boot, "bootstrap").otherwise("weekly_first_session").alias("update_kind"))


def training_days(schedule: DataFrame, session_table: DataFrame, counts: tuple, history_start: str) -> DataFrame:
    """The last k sessions before each update, one row per (update, k, session).

    Sessions are numbered once; the k sessions before an update are then an
    equality join on the number, so no session-by-session product is formed.
    """
    numbered = session_table.where(F.col("session_id") >= history_start).withColumn(
        "_n", F.row_number().over(Window.partitionBy(F.lit(1)).orderBy("session_id")))
    updates = schedule.join(numbered.select(F.col("session_id").alias("update_session"), "_n"), "update_session")
    ks = F.explode(F.array(*[F.lit(k) for k in counts]))
    wanted = updates.withColumn("history_count", ks).withColumn(
        "_n", F.explode(F.expr("sequence(_n - history_count, _n - 1)")))
    days = wanted.join(numbered.select("session_id", "_n"), "_n", "left")
    return days.select("update_session", "history_count", "available_at_ns", "session_id")


def missing_history(days: DataFrame) -> DataFrame:
    """Updates that ask for more history than exists."""
    return days.where("session_id is null").select("update_session", "history_count").distinct()


def period_of(df: DataFrame, at: str, open_ns: str, close_ns: str, width_ns: int) -> DataFrame:
    """Wall-clock period anchored at the session open; [start, end) with the end clipped at the close."""
    index = F.expr(f"({at} - {open_ns}) div {width_ns}L")
    inside = (F.col(at) >= F.col(open_ns)) & (F.col(at) < F.col(close_ns))
    start = F.col(open_ns) + index * F.lit(width_ns)
    return df.where(inside).withColumns({
        "period_index": index, "period_start_ns": start,
        "period_end_ns": F.least(start + F.lit(width_ns), F.col(close_ns))})


def split_bucket(at: Column, bounds: tuple) -> Column:
    """Number of split boundaries at or before the time."""
    if not bounds:
        return F.lit(0)
    return F.size(F.filter(F.array(*[F.lit(b).cast("bigint") for b in bounds]), lambda b: b <= at))


def asof_version(df: DataFrame, versions: DataFrame, until_ns: int) -> DataFrame:
    """Latest model version available at each row; NULL before the first one.

    Versions are few, so their validity intervals join by day instead of sending
    all rows through a shuffle.  ``until_ns`` closes the last interval; a row at or
    after it ends the job, for it would get no version.
    """
    late = F.raise_error(F.lit("a row lies past the end of the versions")).cast("bigint")
    df = df.withColumn("ts_ns", F.when(F.col("ts_ns") >= until_ns, late).otherwise(F.col("ts_ns")))
    nxt = F.lead("available_at_ns").over(Window.partitionBy(F.lit(1)).orderBy("available_at_ns"))
    spans = versions.select("version_id", "available_at_ns").distinct().select(
        "version_id", "available_at_ns", F.coalesce(nxt, F.lit(until_ns)).alias("_until"))
    return interval_join(df, spans, "ts_ns", "available_at_ns", "_until").drop("_until")


def next_quote(df: DataFrame, quotes: DataFrame, at: str, name: str, by: list[str], width: int = 3600 * SECOND) -> DataFrame:
    """First quote time at or after ``at``."""
    right = quotes.select(*by, F.col("ts_ns").alias(at)).distinct()
    found = asof(df, right, at, by, [], forward=True, width=width)
    return found.withColumnRenamed(f"matched_{at}", name)
