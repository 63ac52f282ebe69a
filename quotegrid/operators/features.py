"""Gap-aware features and exact-horizon labels of one trading session.

Grid snapshots are unique per (instrument, session, time), so a session holds at
most session length / interval rows per instrument.  Windows partitioned by
(instrument, session) are bounded by that number at any data volume.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quotegrid.functions import book as fx
from quotegrid.params import MS

SESSION = ["instrument_id", "session_id"]
BLOCK = [*SESSION, "continuous_block"]


def with_continuous_block(df: DataFrame, interval_ns: int, keys: list[str] = SESSION, segment: str | None = "segment_id") -> DataFrame:
    """Number runs of gap-free rows inside a session; a new segment starts a new run."""
    w = Window.partitionBy(*keys).orderBy("ts_ns")
    starts = F.lag("ts_ns").over(w).isNull() | (F.col("ts_ns") - F.lag("ts_ns").over(w) != interval_ns)
    if segment:
        starts = starts | (F.col(segment) != F.lag(segment).over(w))
    marked = df.withColumn("_start", starts.cast("int"))
    return marked.withColumn("continuous_block", F.sum("_start").over(w.rowsBetween(Window.unboundedPreceding, 0))).drop("_start")


def _block():
    return Window.partitionBy(*BLOCK).orderBy("ts_ns")


def full_frame(function, value: Column, rows: int) -> Column:
    """Aggregate over the last ``rows`` rows, NULL until that many values exist."""
    frame = _block().rowsBetween(1 - rows, 0)
    return F.when(F.count(value).over(frame) == rows, function(value).over(frame))


def with_returns(df: DataFrame, lags=(1, 5, 10, 30)) -> DataFrame:
    mid = F.col("mid_price")
    return df.withColumns({f"ret_lag_{k}": mid / F.lag(mid, k).over(_block()) - 1 for k in lags})


def with_volatility(df: DataFrame, windows=(10, 30)) -> DataFrame:
    """Sample deviation of one-step returns; expects ret_lag_1."""
    return df.withColumns({f"vol_{n}": full_frame(F.stddev_samp, F.col("ret_lag_1"), n) for n in windows})


def with_mid_rolling(df: DataFrame) -> DataFrame:
    mid = F.col("mid_price")
    return df.withColumns({
        "mid_ma_rel_10": full_frame(F.avg, mid, 10) / mid - 1,
        "mid_var_rel_10": full_frame(F.var_pop, mid, 10) / (mid * mid)})


def with_depth_rolling(df: DataFrame) -> DataFrame:
    depth = F.col("displayed_depth")
    return df.withColumns({"depth_ma_10": full_frame(F.avg, depth, 10), "depth_var_10": full_frame(F.var_pop, depth, 10)})


def with_depth_change(df: DataFrame, interval_ns: int) -> DataFrame:
    depth, w = F.col("displayed_depth"), _block()
    return df.withColumns({
        "depth_diff_1": depth - F.lag(depth, 1).over(w),
        "depth_speed_5": (depth - F.lag(depth, 5).over(w)) / F.lit(5 * interval_ns / 1e9)})


def with_price_volume(df: DataFrame) -> DataFrame:
    change = F.col("mid_price") - F.lag("mid_price").over(_block())
    depth = F.col("displayed_depth")
    return df.withColumns({"price_diff_1_x_depth": change * depth, "price_diff_1_div_depth": change / depth})


def base_features(df: DataFrame) -> DataFrame:
    for step in (fx.with_mid_spread, fx.with_obi_l1, fx.with_obi_multi, fx.with_micro_dev, with_returns, with_volatility):
        df = step(df)
    return fx.with_feature_valid(df)


def library_features(df: DataFrame, interval_ns: int) -> DataFrame:
    df = with_depth_rolling(with_mid_rolling(fx.with_displayed_depth(df)))
    return fx.with_library_valid(with_price_volume(with_depth_change(df, interval_ns)))


def with_change_reason(df: DataFrame, interval_ns: int, key: str = "instrument_id") -> DataFrame:
    """Why a row does not continue the one before: session change, break or gap.

    Looks back across sessions, so it is windowed per instrument and UTC day with
    the previous day's last row carried in: see ``previous`` for the chunking.
    """
    from quotegrid.operators.ordered import previous
    from quotegrid.params import DAY

    packed = df.withColumn("_here", F.struct("ts_ns", "session_id", "segment_id"))
    seen = previous(packed, [key], "ts_ns", DAY, "_before", "_here")
    reason = (F.when(F.col("_before").isNull(), F.lit(None))
              .when(F.col("_before.session_id") != F.col("session_id"), "session_transition")
              .when(F.col("_before.segment_id") != F.col("segment_id"), "scheduled_break")
              .when(F.col("ts_ns") - F.col("_before.ts_ns") != interval_ns, "gap"))
    return seen.withColumn("change_reason", reason).drop("_here", "_before")


def exact_targets(df: DataFrame, horizons_ms: tuple, values: list[str], keys: list[str] = SESSION, name: str = "targets") -> DataFrame:
    """Array of the rows exactly each horizon later in the same session, NULL where none.

    A RANGE frame of [h, h] on the integer clock holds exactly the row at t + h,
    so all horizons share one sort of the session and no join is needed.
    """
    clock = Window.partitionBy(*keys).orderBy("ts_ns")
    at = lambda h: F.first(F.struct(*values)).over(clock.rangeBetween(h * MS, h * MS))
    temps = {f"_t{h}": at(h) for h in horizons_ms}
    return df.withColumns(temps).withColumn(name, F.array(*temps)).drop(*temps)


def labels(df: DataFrame, horizons_ms: tuple, bounds: tuple = (), keep: list[str] | None = None) -> DataFrame:
    """Long labels: one row per snapshot and horizon with validity, reason, difference, return."""
    from quotegrid.operators.calendar import split_bucket

    keep = keep or ["instrument_id", "session_id", "segment_id", "ts_ns", "feature_valid"]
    rows = exact_targets(df, horizons_ms, ["mid_price", "continuous_block"])
    hs = F.array(*[F.lit(h).cast("bigint") for h in horizons_ms])
    rows = rows.withColumn("_h", F.explode(F.arrays_zip(hs.alias("h"), F.col("targets").alias("t"))))
    target, t = F.col("ts_ns") + F.col("_h.h") * MS, F.col("_h.t")
    reason = (F.when(target > F.col("close_ns"), "session_boundary")
              .when(target > F.col("segment_end_ns"), "scheduled_break")
              .when(split_bucket(F.col("ts_ns"), bounds) != split_bucket(target, bounds), "split_boundary")
              .when(t.isNull(), "missing_target")
              .when(t["continuous_block"] != F.col("continuous_block"), "gap")
              .otherwise("valid"))
    valid = F.col("label_reason") == "valid"
    diff = t["mid_price"] - F.col("mid_price")
    rows = rows.withColumns({"horizon_ms": F.col("_h.h"), "label_end_ns": target, "label_reason": reason})
    return rows.select(
        *keep, "horizon_ms", "label_end_ns", valid.alias("label_valid"), "label_reason",
        F.when(valid, diff).alias("future_price_diff"), F.when(valid, diff / F.col("mid_price")).alias("future_return"))


def wide_labels(long: DataFrame, horizons_ms: tuple) -> DataFrame:
    """One row per snapshot with five columns per horizon; rows meet again by key hash."""
    fields = ["label_end_ns", "label_valid", "label_reason", "future_price_diff", "future_return"]
    names = {"label_end_ns": "label_end"}
    pick = lambda f, h: F.max(F.when(F.col("horizon_ms") == h, F.col(f))).alias(f"{names.get(f, f)}_{h}ms")
    return long.groupBy(*SESSION, "ts_ns").agg(*[pick(f, h) for h in horizons_ms for f in fields])


def learning_ready(long: DataFrame) -> DataFrame:
    """Snapshots whose features and every horizon are valid."""
    return long.groupBy(*SESSION, "ts_ns").agg(
        F.bool_and(F.col("label_valid") & F.col("feature_valid")).alias("learning_ready"))


def label_quality(long: DataFrame) -> DataFrame:
    reasons = ["missing_target", "gap", "split_boundary", "scheduled_break", "session_boundary"]
    return long.groupBy(*SESSION, "horizon_ms").agg(
        F.count_if("label_valid").alias("valid"),
        F.count_if(F.col("label_valid") & F.col("feature_valid")).alias("feature_and_label_valid"),
        *[F.count_if(F.col("label_reason") == r).alias(r) for r in reasons])


def audit_horizons(df: DataFrame, horizons_ms: tuple) -> DataFrame:
    """Label availability recomputed without split boundaries, plus the joint count."""
    long = labels(df, horizons_ms)
    per_row = long.groupBy(*SESSION, "ts_ns").agg(
        F.first("feature_valid").alias("feature_valid"), F.bool_and("label_valid").alias("_all"),
        *[F.max(F.when(F.col("horizon_ms") == h, F.col("label_reason"))).alias(f"_r{h}") for h in horizons_ms])
    return per_row.groupBy("session_id").agg(
        F.count(F.lit(1)).alias("observed_rows"), F.count_if("feature_valid").alias("feature_valid_rows"),
        F.count_if(F.col("_all") & F.col("feature_valid")).alias("all_horizons_feature_valid_rows"),
        *[F.count_if(F.col(f"_r{h}") == "valid").alias(f"valid_{h}ms") for h in horizons_ms])


def training_samples(df: DataFrame, horizon_ms: int, purge_ms: int, keep: list[str]) -> DataFrame:
    """Rows usable for training: features valid, purge ends before the session does,
    target exists in the same block.  ``y`` is recomputed from prices."""
    rows = exact_targets(df, (horizon_ms,), ["mid_price", "continuous_block"]).withColumn("_t", F.col("targets")[0])
    purged = F.col("ts_ns") + F.lit(purge_ms * MS) < F.col("close_ns") + 1
    same = F.coalesce(F.col("_t.continuous_block") == F.col("continuous_block"), F.lit(False))
    rows = rows.where((F.col("ts_ns") >= F.col("open_ns")) & purged & F.col("feature_valid") & same)
    return rows.select(*keep, ((F.col("_t.mid_price") - F.col("mid_price")) / F.col("mid_price")).alias("y"))


def audit_labels(df: DataFrame, cached: DataFrame, horizon_ms: int) -> DataFrame:
    """Cached labels marked valid that disagree with the prices they claim to use.

    ``cached`` has the long label columns; tolerance rtol 1e-10 plus atol 1e-12.
    """
    rows = exact_targets(df, (horizon_ms,), ["mid_price", "continuous_block"]).withColumn("_t", F.col("targets")[0])
    rows = rows.select(*SESSION, "ts_ns", "mid_price", "continuous_block", "_t")
    claimed = cached.where((F.col("horizon_ms") == horizon_ms) & F.col("label_valid"))
    both = claimed.join(rows, [*SESSION, "ts_ns"])
    truth = (F.col("_t.mid_price") - F.col("mid_price")) / F.col("mid_price")
    close = F.abs(F.col("future_return") - truth) <= F.lit(1e-12) + F.lit(1e-10) * F.abs(truth)
    rule = (F.when(F.col("_t").isNull() | (F.col("_t.continuous_block") != F.col("continuous_block")), "no_exact_target")
            .when(F.col("label_end_ns") != F.col("ts_ns") + horizon_ms * MS, "wrong_end")
            .when(~F.coalesce(close, F.lit(False)), "wrong_return"))
    return both.select(*SESSION, "ts_ns", rule.alias("rule")).where("rule is not null")


def sample_counts(samples: DataFrame, session_table: DataFrame) -> DataFrame:
    """Training rows per session with first and last time; sessions without any stay with zero."""
    seen = samples.groupBy("session_id").agg(
        F.count(F.lit(1)).alias("_n"), F.min("ts_ns").alias("first_ns"), F.max("ts_ns").alias("last_ns"))
    return session_table.select("session_id").join(seen, "session_id", "left").select(
        "session_id", F.coalesce("_n", F.lit(0)).alias("samples"), "first_ns", "last_ns")


def bounded_sample(df: DataFrame, size: int, seed: int, key: str | list[str], by: list[str] | None = None, digits: int = 5) -> DataFrame:
    """The ``size`` rows of smallest hash priority (a uniform draw blind to labels).

    Ungrouped it is a distributed top-k.  Grouped, a histogram of the leading hex
    digits of the priority (map-side combined, at most 16^digits rows per group)
    tells below which value the first ``size`` rows must lie; only those rows are
    ranked.  However large a group is, its final ranking sees little more than
    ``size`` rows, and the result is exact.  ``key`` must name all columns that
    identify a row: rows alike in it would be drawn together.
    """
    key = [key] if isinstance(key, str) else key
    ranked = df.withColumn("priority", F.md5(F.concat_ws("|", *[F.col(k).cast("string") for k in key], F.lit(str(seed)))))
    if not by:
        return ranked.orderBy("priority", *key).limit(size)
    ranked = ranked.withColumn("_bin", F.substring("priority", 1, digits))
    bins = ranked.groupBy(*by, "_bin").agg(F.count(F.lit(1)).alias("_n"))
    before = Window.partitionBy(*by).orderBy("_bin").rowsBetween(Window.unboundedPreceding, -1)
    needed = bins.withColumn("_before", F.coalesce(F.sum("_n").over(before), F.lit(0))).where(F.col("_before") < size)
    cut = needed.groupBy(*by).agg(F.max("_bin").alias("_cut"))
    few = ranked.join(cut, by).where("_bin <= _cut").drop("_bin", "_cut")
    group = Window.partitionBy(*by).orderBy("priority", *key)
    return few.withColumn("_r", F.row_number().over(group)).where(F.col("_r") <= size).drop("_r")
