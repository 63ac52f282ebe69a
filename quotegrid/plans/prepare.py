"""Queries over sources, calendars and sampling."""

from __future__ import annotations

import uuid

from pyspark.sql import Window
from pyspark.sql import functions as F

from quotegrid.functions.book import r6, valid_book, with_mid_spread
from quotegrid.operators import calendar as cal
from quotegrid.operators import sampling as sm
from quotegrid.operators.ordered import asof, exact_offset, interval_join
from quotegrid.params import BOOK_COLUMNS, MESSAGE_COLUMNS
from quotegrid.plans import study
from quotegrid.plans.registry import cte, query
from quotegrid.plans.study import A, HORIZONS, I, RULES, SPLITS
from quotegrid.session import settle, shared_folder
from quotegrid.sources import catalog as listings
from quotegrid.sources import tables as src
from quotegrid.sources.bindings import STUDY, messages, table
from quotegrid.sources.runs import read_run

AGES = STUDY.ages_ms


def fresh_path(spark, name):
    return f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"


@query("flagship_daily_spread", """
SELECT file_date, count(*) AS snapshots, round(avg((ask_px_00 + bid_px_00) / 2), 6) + 0.0 AS mean_mid,
       round(avg(ask_px_00 - bid_px_00), 6) + 0.0 AS mean_spread
FROM snapshot GROUP BY file_date""")
def flagship(spark, sf):
    rows = with_mid_spread(study.snapshots(spark, sf, study.TOUCH))
    return rows.groupBy("file_date").agg(
        F.count(F.lit(1)).alias("snapshots"), r6(F.avg("mid_price")).alias("mean_mid"), r6(F.avg("spread")).alias("mean_spread"))


@query("s01_book_scan", " UNION ALL ".join(
    f"SELECT '{c}' AS column_name, count(*) AS rows, count(*) FILTER (WHERE {c if c != 'event_ns' else 'recv_ns'} IS NULL) AS nulls FROM book"
    for c in MESSAGE_COLUMNS))
def s01(spark, sf):
    return src.null_audit(messages(spark, sf), MESSAGE_COLUMNS)


def _catalog(spark, sf):
    day = F.substring("file_date", 9, 2).cast("int")
    counted = messages(spark, sf).groupBy("file_date").agg(F.count(F.lit(1)).alias("n")).where(day != 3)
    condition = F.when(day % 7 == 0, "degraded").when(day == 13, "pending").otherwise("available")
    copies = F.when(day == 5, 2).otherwise(1)
    listed = counted.withColumn("_copy", F.explode(F.sequence(F.lit(1), copies)))
    return listed.select("file_date", condition.alias("condition"), F.when(day % 5 == 1, F.col("n") + 1).otherwise(F.col("n")).alias("rows"))


cte("catalog", """
SELECT file_date, CASE WHEN d % 7 = 0 THEN 'degraded' WHEN d = 13 THEN 'pending' ELSE 'available' END AS condition,
       CASE WHEN d % 5 = 1 THEN n + 1 ELSE n END AS rows
FROM (SELECT file_date, CAST(substr(file_date, 9, 2) AS INT) AS d, count(*) AS n FROM book GROUP BY ALL) c
JOIN (VALUES (1), (2)) copies(copy) ON copy = 1 OR d = 5
WHERE d <> 3""")
cte("reqparts", """
SELECT session_id, strftime(unnest(generate_series(CAST(make_timestamp(open_ns // 1000) AS DATE), CAST(make_timestamp(close_ns // 1000) AS DATE), INTERVAL 1 DAY)), '%Y-%m-%d') AS file_date
FROM sess""")


@query("s02_select_sources", """
SELECT d.file_date, coalesce(entries, 0) AS entries, condition, rows,
       CASE WHEN entries IS NULL THEN 'missing' WHEN entries > 1 THEN 'ambiguous'
            WHEN condition NOT IN ('available', 'degraded') THEN 'unknown_condition'
            WHEN condition = 'degraded' THEN 'degraded_refused' ELSE 'selected' END AS verdict
FROM (SELECT DISTINCT file_date FROM reqparts) d
LEFT JOIN (SELECT file_date, count(*) AS entries, max(condition) AS condition, CAST(sum(rows) AS BIGINT) AS rows FROM catalog GROUP BY 1) c
  USING (file_date)""")
def s02(spark, sf):
    wanted = cal.required_partitions(cal.sessions(study.segments(spark)))
    return src.select_sources(_catalog(spark, sf), wanted)


@query("s03_reconcile_catalog", """
SELECT file_date, stored_rows, catalog_rows
FROM (SELECT file_date, count(*) AS stored_rows FROM book GROUP BY 1)
FULL JOIN (SELECT file_date, rows AS catalog_rows FROM catalog) USING (file_date)
WHERE stored_rows IS DISTINCT FROM catalog_rows""")
def s03(spark, sf):
    return src.reconcile_catalog(messages(spark, sf), _catalog(spark, sf))


@query("s03_reconcile_files", """
SELECT file_date, unnest(list_filter([CASE WHEN d % 9 = 4 THEN 'bad_rows' END, CASE WHEN d % 8 = 6 THEN 'not_parquet' END, CASE WHEN d = 3 THEN 'unlisted_file' END,
       CASE WHEN d <> 3 AND (d % 5 = 1 OR d % 9 = 4) THEN 'rows_differ' END, CASE WHEN d <> 3 AND d % 6 = 2 THEN 'bytes_differ' END], lambda rule: rule IS NOT NULL)) AS rule
FROM (SELECT DISTINCT file_date, CAST(substr(file_date, 9, 2) AS INT) AS d FROM book)
UNION ALL SELECT '2023-12-31', 'missing_file'""")
def s03_files(spark, sf):
    """Message files by date and a JSON catalog of them, with faults planted in the catalog."""
    root, listing = fresh_path(spark, "messages"), fresh_path(spark, "catalog")
    messages(spark, sf).repartition("file_date").write.partitionBy("file_date").parquet(root)
    d, path = F.substring("date", 9, 2).cast("int"), F.col("_metadata.file_path")
    files = spark.read.parquet(root).select(path.alias("parquet"), F.col("_metadata.file_size").alias("parquet_bytes")).groupBy("parquet", "parquet_bytes").agg(F.count(F.lit(1)).alias("rows"))
    files = files.groupBy(F.regexp_extract("parquet", r"(\d{4}-\d{2}-\d{2})", 1).alias("date")).agg(F.min("parquet").alias("parquet"), F.sum("rows").alias("rows"), F.sum("parquet_bytes").alias("parquet_bytes"))
    faulty = files.where(d != 3).select(
        "date", F.lit("available").alias("condition"), F.when(d % 9 == 4, -1).when(d % 5 == 1, F.col("rows") + 1).otherwise(F.col("rows")).alias("rows"),
        F.when(d % 8 == 6, "day.csv").otherwise(F.col("parquet")).alias("parquet"), (F.col("parquet_bytes") + F.when(d % 6 == 2, 1).otherwise(0)).alias("parquet_bytes"))
    absent = files.agg(F.lit("2023-12-31").alias("date"), F.lit("available").alias("condition"), F.lit(1).cast("bigint").alias("rows"), F.lit("gone.parquet").alias("parquet"), F.lit(1).cast("bigint").alias("parquet_bytes"))
    identity = {"dataset": "EVENTS", "schema": "book-10", "symbol": "EVT", "stype_in": "raw_symbol"}
    # an entry a day
    document = faulty.unionByName(absent).agg(F.collect_list(F.struct("date", "condition", "rows", "parquet", "parquet_bytes")).alias("files"))
    document.select(*[F.lit(v).alias(k) for k, v in identity.items()], "files").write.json(listing)
    catalog = settle(listings.read_catalog(spark, listing), "catalog")
    return listings.audit_catalog(catalog, identity).unionByName(listings.reconcile_files(spark, root, catalog))


@query("s04_prefix_scan", """
SELECT file_date, seq, record, true AS partial_prefix
FROM (SELECT *, row_number() OVER (PARTITION BY file_date ORDER BY seq) AS record FROM book) WHERE record <= 25""")
def s04(spark, sf):
    return sm.prefix(messages(spark, sf), 25).select("file_date", "seq", F.col("record").cast("bigint").alias("record"), "partial_prefix")


SOURCE_NAME = {"source_name": "events.parquet"}


@query("s05_snapshot_sink", """
SELECT a.age AS max_age_ms, file_date, 'events.parquet' AS source_name, 'grid' AS run, false AS partial, count(*) AS snapshots, min(ts_ns) AS first_ns
FROM snapshot JOIN (VALUES (60000), (300000), (1200000)) a(age) ON age_ms <= age GROUP BY ALL""")
def s05(spark, sf):
    root = fresh_path(spark, "snapshots")
    src.write_snapshots(sm.age_ladder(study.snapshots(spark, sf), AGES), root, "grid", SOURCE_NAME)
    back = read_run(spark, root, "grid")
    return back.groupBy(F.col("max_age_ms").cast("bigint").alias("max_age_ms"), "file_date", "source_name", "run", "partial").agg(
        F.count(F.lit(1)).alias("snapshots"), F.min("ts_ns").alias("first_ns"))


@query("s06_prepared_sink", """
SELECT session_id, 'events.parquet' AS source_name, 'features' AS run, false AS partial, count(*) AS rows, max(continuous_block) AS blocks,
       round(avg(mid_price), 6) + 0.0 AS mean_mid FROM feat GROUP BY 1""")
def s06(spark, sf):
    root = fresh_path(spark, "prepared")
    src.write_prepared(study.prepared(spark, sf), root, "features", SOURCE_NAME)
    back = read_run(spark, root, "features")
    return back.groupBy("session_id", "source_name", "run", "partial").agg(
        F.count(F.lit(1)).alias("rows"), F.max("continuous_block").alias("blocks"), r6(F.avg("mid_price")).alias("mean_mid"))


LO, HI = 1_704_880_800_000_000_000, 1_704_906_000_000_000_000  # 2024-01-10 10:00Z .. 17:00Z


@query("s07_window_scan", f"SELECT session_id, ts_ns, round(mid_price, 6) + 0.0 AS mid_price FROM blk WHERE ts_ns >= {LO} AND ts_ns < {HI}")
def s07(spark, sf):
    root = fresh_path(spark, "prepared")
    src.write_prepared(study.blocked(spark, sf), root, "blocks", SOURCE_NAME)
    sessions = study.cal.sessions(study.segments(spark)).where((F.col("open_ns") < HI) & (F.col("close_ns") >= LO))
    names = [r["session_id"] for r in sessions.select("session_id").collect()]  # calendar rows of seven hours
    return src.read_window(spark, root, "blocks", LO, HI, names).select("session_id", "ts_ns", r6(F.col("mid_price")).alias("mid_price"))


@query("s08_decision_view", "SELECT ts_ns, session_id, continuous_block, round(mid_price, 6) + 0.0 AS mid_price, feature_valid FROM feat")
def s08(spark, sf):
    from quotegrid.operators import features as ft

    future = ft.exact_targets(study.prepared(spark, sf), HORIZONS, ["mid_price"])
    view = src.decision_view(future)
    return view.select("ts_ns", "session_id", "continuous_block", r6(F.col("mid_price")).alias("mid_price"), "feature_valid")


@query("s09_source_lineage", "SELECT 'events.parquet' AS source_file, event_type, count(*) AS rows FROM events GROUP BY ALL")
def s09(spark, sf):
    return src.with_lineage(table(spark, sf, "events")).groupBy("source_file", "event_type").agg(F.count(F.lit(1)).alias("rows"))


@query("c01_calendar_expansion", """
SELECT segment_id, session_id, start_ns, end_ns, open_ns, close_ns, count(seq) AS messages
FROM seg LEFT JOIN book ON recv_ns >= start_ns AND recv_ns < end_ns GROUP BY ALL""")
def c01(spark, sf):
    seg = study.segments(spark)
    rows = interval_join(messages(spark, sf).select("recv_ns"), seg.select("segment_id", "start_ns", "end_ns"), "recv_ns", "start_ns", "end_ns", how="inner")
    counts = rows.groupBy("segment_id").agg(F.count(F.lit(1)).alias("n"))
    return seg.join(counts, "segment_id", "left").withColumn("messages", F.coalesce("n", F.lit(0))).drop("n")


@query("c02_calendar_audit", """
SELECT 'overlap' AS rule, file_date AS item
FROM (SELECT file_date, a, lag(b) OVER (ORDER BY a) AS before
      FROM (SELECT file_date, min(recv_ns) AS a, max(recv_ns) + (CAST(substr(file_date, 9, 2) AS INT) % 3) * 600000000000 AS b FROM book GROUP BY 1))
WHERE before > a""")
def c02(spark, sf):
    # Segments as the data shows them, stretched on some days so that they overlap.
    day = F.substring("file_date", 9, 2).cast("int")
    seen = messages(spark, sf).groupBy("file_date").agg(F.min("recv_ns").alias("start_ns"), F.max("recv_ns").alias("last"))
    seg = seen.select(F.col("file_date").alias("segment_id"), "start_ns", (F.col("last") + day % 3 * F.lit(600_000_000_000)).alias("end_ns"))
    return cal.audit_calendar(seg, RULES)


@query("c03_session_assignment", "SELECT ts_ns, session_class, session_id, segment_id FROM classed")
def c03(spark, sf):
    return study.classified(spark, sf).select("ts_ns", "session_class", "session_id", "segment_id")


@query("c04_out_of_coverage", "SELECT ts_ns, file_date FROM snapshot WHERE ts_ns < (SELECT min(start_ns) FROM seg) OR ts_ns > (SELECT max(end_ns) FROM seg)")
def c04(spark, sf):
    return cal.out_of_coverage(study.snapshots(spark, sf, ()), study.segments(spark)).select("ts_ns", "file_date")


cte("seen_sess", "SELECT * FROM sess WHERE session_id IN (SELECT session_id FROM asg)")


def seen_sessions(spark, sf):
    """Sessions the data has at least one snapshot in: a small table that schedules read several times."""
    return settle(study.in_session(spark, sf).select("session_id", "open_ns", "close_ns").distinct())


@query("c05_required_partitions", "SELECT session_id, file_date FROM reqparts WHERE session_id IN (SELECT session_id FROM seen_sess)")
def c05(spark, sf):
    return cal.required_partitions(seen_sessions(spark, sf))


@query("c06_coverage", """
SELECT r.session_id, count(*) AS required, count(*) FILTER (WHERE p.file_date IS NULL) AS missing,
       coalesce(any_value(n), 0) AS observed_snapshots,
       count(*) FILTER (WHERE p.file_date IS NULL) = 0 AND coalesce(any_value(n), 0) >= 2 AS usable
FROM reqparts r LEFT JOIN (SELECT DISTINCT file_date FROM book WHERE file_date <> '2024-01-10') p USING (file_date)
LEFT JOIN (SELECT session_id, count(*) AS n FROM asg GROUP BY 1) o USING (session_id) GROUP BY 1""")
def c06(spark, sf):
    parts = messages(spark, sf).where("file_date <> '2024-01-10'")
    quality = study.in_session(spark, sf).groupBy("session_id").agg(F.count(F.lit(1)).alias("observed_snapshots"))
    return cal.coverage(cal.sessions(study.segments(spark)), parts, quality)


cte("phase_list", """
SELECT session_id, CASE WHEN n = 4 THEN 3 WHEN n <= 5 THEN 0 WHEN n <= 10 THEN 1 WHEN n <= 15 THEN 2 ELSE 3 END AS phase_order
FROM (SELECT session_id, row_number() OVER (ORDER BY session_id) AS n FROM seen_sess) WHERE n <> 12
UNION ALL SELECT * FROM (SELECT session_id, 1 FROM seen_sess ORDER BY session_id LIMIT 1 OFFSET 6)""")


@query("c07_phase_audit", """
SELECT 'repeated_day' AS rule, session_id FROM phase_list GROUP BY 2 HAVING count(*) > 1
UNION ALL SELECT 'skipped_session', session_id FROM sess
  WHERE session_id BETWEEN (SELECT min(session_id) FROM phase_list) AND (SELECT max(session_id) FROM phase_list)
    AND session_id NOT IN (SELECT session_id FROM phase_list)
UNION ALL SELECT 'phase_out_of_order', session_id
  FROM (SELECT *, lag(phase_order) OVER (ORDER BY session_id) AS b FROM phase_list) WHERE phase_order < b""")
def c07(spark, sf):
    seen = seen_sessions(spark, sf).withColumn("n", F.row_number().over(Window.partitionBy(F.lit(1)).orderBy("session_id")))
    n = F.col("n")
    phase = F.when(n == 4, 3).when(n <= 5, 0).when(n <= 10, 1).when(n <= 15, 2).otherwise(3)
    lists = seen.where(n != 12).select("session_id", phase.alias("phase_order"))
    lists = lists.unionByName(seen.where(n == 7).select("session_id", F.lit(1).alias("phase_order")))
    return cal.audit_phases(lists, cal.sessions(study.segments(spark)))


cte("sched", """
SELECT session_id AS update_session, open_ns AS available_at_ns, iso_year, iso_week,
       CASE WHEN session_id = '2024-01-05' THEN 'bootstrap' ELSE 'weekly_first_session' END AS update_kind
FROM (SELECT *, row_number() OVER (PARTITION BY iso_year, iso_week ORDER BY session_id) AS rn
      FROM (SELECT *, isoyear(CAST(session_id AS DATE)) AS iso_year, weekofyear(CAST(session_id AS DATE)) AS iso_week FROM seen_sess))
WHERE session_id = '2024-01-05' OR (rn = 1 AND session_id > '2024-01-05' AND session_id <= '2024-01-30')""")


def schedule(spark, sf, seen=None):
    return cal.weekly_schedule(seen or seen_sessions(spark, sf), "2024-01-05", "2024-01-30")


@query("c08_weekly_schedule", "SELECT * FROM sched")
def c08(spark, sf):
    return schedule(spark, sf)


cte("tdays", """
SELECT update_session, history_count, available_at_ns, session_id
FROM (SELECT update_session, available_at_ns, k AS history_count, session_id,
             row_number() OVER (PARTITION BY update_session, k ORDER BY session_id DESC) AS rn
      FROM sched JOIN seen_sess ON session_id < update_session CROSS JOIN (VALUES (1), (2)) ks(k))
WHERE rn <= history_count""")


@query("c09_training_days", "SELECT * FROM tdays")
def c09(spark, sf):
    seen = seen_sessions(spark, sf)
    return cal.training_days(schedule(spark, sf, seen), seen, STUDY.history_counts, "2024-01-02")


@query("c10_session_periods", """
SELECT session_id, ts_ns, (ts_ns - open_ns) // 1800000000000 AS period_index,
       open_ns + (ts_ns - open_ns) // 1800000000000 * 1800000000000 AS period_start_ns,
       least(open_ns + ((ts_ns - open_ns) // 1800000000000 + 1) * 1800000000000, close_ns) AS period_end_ns
FROM asg WHERE ts_ns >= open_ns AND ts_ns < close_ns""")
def c10(spark, sf):
    rows = cal.period_of(study.in_session(spark, sf), "ts_ns", "open_ns", "close_ns", STUDY.period_ms * 1_000_000)
    return rows.select("session_id", "ts_ns", "period_index", "period_start_ns", "period_end_ns")


@query("c11_split_bucket", f"SELECT ts_ns, {' + '.join(f'CASE WHEN ts_ns >= {b} THEN 1 ELSE 0 END' for b in SPLITS)} AS split_bucket FROM asg")
def c11(spark, sf):
    return study.in_session(spark, sf).select("ts_ns", cal.split_bucket(F.col("ts_ns"), SPLITS).alias("split_bucket"))


UNTIL = 1_706_745_600_000_000_000  # 2024-02-01 00:00Z


@query("c12_version_asof", """
SELECT a.ts_ns, v.update_session AS version_id, v.available_at_ns FROM asg a ASOF LEFT JOIN sched v ON v.available_at_ns <= a.ts_ns""")
def c12(spark, sf):
    versions = schedule(spark, sf).select(F.col("update_session").alias("version_id"), "available_at_ns")
    return cal.asof_version(study.in_session(spark, sf), versions, UNTIL).select("ts_ns", "version_id", "available_at_ns")


def _purchases(spark, sf):
    return messages(spark, sf).where("event_type = 'purchase'").select("instrument_id", "file_date", "seq", F.col("recv_ns").alias("ts_ns"))


def _quotes(spark, sf):
    return settle(with_mid_spread(study.snapshots(spark, sf, study.TOUCH)).select("instrument_id", "file_date", "ts_ns", "mid_price"), "quotes")


@query("c13_asof_backward", """
SELECT p.seq, q.ts_ns AS matched_ts_ns, round(q.mid_price, 6) + 0.0 AS mid_price
FROM (SELECT seq, file_date, recv_ns FROM book WHERE event_type = 'purchase') p
ASOF LEFT JOIN (SELECT file_date, ts_ns, (bid_px_00 + ask_px_00) / 2 AS mid_price FROM snapshot) q
  ON q.file_date = p.file_date AND q.ts_ns <= p.recv_ns""")
def c13(spark, sf):
    found = asof(_purchases(spark, sf), _quotes(spark, sf), "ts_ns", ["instrument_id", "file_date"], ["mid_price"])
    return found.select("seq", "matched_ts_ns", r6(F.col("mid_price")).alias("mid_price"))


@query("c14_asof_forward", """
SELECT p.seq, q.ts_ns AS matched_ts_ns, round(q.mid_price, 6) + 0.0 AS mid_price
FROM (SELECT seq, file_date, recv_ns FROM book WHERE event_type = 'purchase') p
ASOF LEFT JOIN (SELECT file_date, ts_ns, (bid_px_00 + ask_px_00) / 2 AS mid_price FROM snapshot) q
  ON q.file_date = p.file_date AND q.ts_ns >= p.recv_ns""")
def c14(spark, sf):
    found = asof(_purchases(spark, sf), _quotes(spark, sf), "ts_ns", ["instrument_id", "file_date"], ["mid_price"], forward=True)
    return found.select("seq", "matched_ts_ns", r6(F.col("mid_price")).alias("mid_price"))


@query("c15_exact_offset", """
SELECT a.ts_ns, a.file_date, round((b.bid_px_00 + b.ask_px_00) / 2, 6) + 0.0 AS target_mid_price
FROM snapshot a LEFT JOIN snapshot b ON b.file_date = a.file_date AND b.ts_ns = a.ts_ns + 900000000000""")
def c15(spark, sf):
    rows = exact_offset(_quotes(spark, sf), ["instrument_id", "file_date"], "ts_ns", 900_000_000_000, ["mid_price"])
    return rows.select("ts_ns", "file_date", r6(F.col("target_mid_price")).alias("target_mid_price"))


@query("g01_message_class", "SELECT seq, cls AS class FROM msg")
def g01(spark, sf):
    return sm.classify(messages(spark, sf)).select("seq", "class")


@query("g02_valid_book", """
SELECT seq, bid_px_00 > 0 AND ask_px_00 >= bid_px_00 AND bid_sz_00 > 0 AND ask_sz_00 > 0 AS valid FROM book""")
def g02(spark, sf):
    return messages(spark, sf).select("seq", valid_book().alias("valid"))


_rounded = ", ".join(f"round({c}, 6) + 0.0 AS {c}" if "_px_" in c else c for c in BOOK_COLUMNS)


@query("g03_grid_snapshots", f"""
SELECT instrument_id, symbol, file_date, ts_ns, source_recv_ns, sequence, source_flags, round(age_ms, 6) + 0.0 AS age_ms, {_rounded} FROM snapshot""")
def g03(spark, sf):
    return study.snapshots(spark, sf).select(
        "instrument_id", "symbol", "file_date", "ts_ns", "source_recv_ns", "sequence", "source_flags", r6(F.col("age_ms")).alias("age_ms"),
        *[r6(F.col(c)).alias(c) if "_px_" in c else F.col(c) for c in BOOK_COLUMNS])


@query("g04_grid_ranges", f"""
SELECT file_date, ts_ns AS start_ns, ts_ns + {I} AS end_ns, 'emitted' AS status, source_recv_ns AS complete_recv_ns, source_recv_ns AS trusted_recv_ns FROM snapshot
UNION ALL
SELECT file_date, start_ns, hi + {I}, reason, done, eff
FROM (SELECT *, CASE WHEN ehi >= lo THEN ehi + {I} ELSE lo END AS start_ns,
             CASE WHEN cls = 'G' THEN recv_ns WHEN cls = 'O' AND settled = 'G' THEN good_recv END AS done FROM gov WHERE hi >= lo)
WHERE start_ns <= hi""")
def g04(spark, sf):
    return sm.grid_ranges(messages(spark, sf), I, A).select("file_date", "start_ns", "end_ns", "status", "complete_recv_ns", "trusted_recv_ns")


@query("g05_sampling_stats", f"""
SELECT r.*, coalesce(snapshots, 0) AS snapshots, coalesce(skipped_intervals, 0) AS skipped_intervals, {', '.join(f'coalesce({r}, 0) AS {r}' for r in sm.SKIP_REASONS)}
FROM (SELECT file_date, count(*) AS source_records, count(*) FILTER (WHERE cls = 'B' OR (cls = 'U' AND flags & 128 <> 0)) AS invalid_completed_books,
             count(*) FILTER (WHERE cls = 'U') AS unreliable_receive_records FROM msg GROUP BY 1) r
LEFT JOIN (SELECT file_date, CAST(sum(e) AS BIGINT) AS snapshots, CAST(sum(n - e) AS BIGINT) AS skipped_intervals,
                  {', '.join(f"CAST(sum(CASE WHEN reason = '{r}' THEN n - e ELSE 0 END) AS BIGINT) AS {r}" for r in sm.SKIP_REASONS)}
           FROM (SELECT *, (hi - lo) // {I} + 1 AS n, CASE WHEN ehi >= lo THEN (ehi - lo) // {I} + 1 ELSE 0 END AS e FROM gov WHERE hi >= lo) GROUP BY 1) s
USING (file_date)""")
def g05(spark, sf):
    return sm.sampling_stats(messages(spark, sf), I, A).drop("instrument_id")


@query("g06_receive_order_audit", """
SELECT seq, recv_ns, previous_recv_ns
FROM (SELECT seq, recv_ns, lag(recv_ns) OVER (PARTITION BY file_date ORDER BY seq) AS previous_recv_ns
      FROM (SELECT * REPLACE (recv_ns - CASE WHEN k % 10 = 9 THEN 300000000000 ELSE 0 END AS recv_ns) FROM book WHERE flags & 8 = 0))
WHERE recv_ns < previous_recv_ns""")
def g06(spark, sf):
    late = F.when(F.col("k") % 10 == 9, 300_000_000_000).otherwise(0)
    shaken = messages(spark, sf).withColumn("recv_ns", F.col("recv_ns") - late)
    return sm.order_violations(shaken).select("seq", "recv_ns", "previous_recv_ns")


@query("g07_age_ladder", """
SELECT a.age AS max_age_ms, ts_ns, sequence FROM snapshot JOIN (VALUES (60000), (300000), (1200000)) a(age) ON age_ms <= age""")
def g07(spark, sf):
    return sm.age_ladder(study.snapshots(spark, sf, ()), AGES).select("max_age_ms", "ts_ns", "sequence")
