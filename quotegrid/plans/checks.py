"""Queries over data quality, dataset comparison and set operations."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql import types as T

from quotegrid.functions import book as fx
from quotegrid.operators import calendar as cal
from quotegrid.operators import features as ft
from quotegrid.operators import quality as ql
from quotegrid.params import BOOK_COLUMNS
from quotegrid.plans import study
from quotegrid.plans.prepare import AGES
from quotegrid.plans.registry import cte, query
from quotegrid.plans.study import A, HORIZONS, I, SPLITS
from quotegrid.session import settle
from quotegrid.sources.bindings import messages, table

MAX_AGE_MS = A // 1_000_000


@query("v01_schema_check")
def v01(spark, sf):
    fields = [T.StructField("event_id", T.LongType()), T.StructField("ts", T.TimestampType()), T.StructField("value", T.FloatType()), T.StructField("flags", T.ShortType())]
    events = table(spark, sf, "events")
    wrong = ql.schema_check(events, T.StructType(fields), clocks=("ts",))
    rows = events.agg(F.count(F.lit(1)).alias("rows"), F.lit(1).alias("_j"))
    return wrong.withColumn("_j", F.lit(1)).join(rows, "_j").drop("_j")


cte("bad_snap", f"""
SELECT * REPLACE (ts_ns + CASE WHEN sequence % 50 = 0 THEN 1 ELSE 0 END AS ts_ns, CASE WHEN sequence % 53 = 0 THEN source_recv_ns + {10 * A} ELSE source_recv_ns END AS source_recv_ns,
                  age_ms + CASE WHEN sequence % 59 = 0 THEN 1.0 ELSE 0.0 END AS age_ms, CASE WHEN sequence % 61 = 0 THEN 4 ELSE source_flags END AS source_flags,
                  CASE WHEN sequence % 67 = 0 THEN 0.0 ELSE bid_px_00 END AS bid_px_00, CASE WHEN sequence % 71 = 0 THEN 'ALT' ELSE symbol END AS symbol,
                  CASE WHEN sequence % 73 = 0 THEN NULL ELSE ask_sz_04 END AS ask_sz_04) FROM snapshot""")


@query("v02_snapshot_rules", f"""
SELECT unnest(['null_field', 'off_grid', 'not_causal', 'too_old', 'age_misstated', 'unreliable_flags', 'invalid_book', 'wrong_symbol']) AS rule, unnest(v) AS violations
FROM (SELECT [count(*) FILTER (WHERE ask_sz_04 IS NULL), count(*) FILTER (WHERE ts_ns % {I} <> 0), count(*) FILTER (WHERE ts_ns <= source_recv_ns),
              count(*) FILTER (WHERE (ts_ns - source_recv_ns) / 1e6 > {MAX_AGE_MS}), count(*) FILTER (WHERE abs((ts_ns - source_recv_ns) / 1e6 - age_ms) > 1e-6),
              count(*) FILTER (WHERE source_flags & 128 = 0 OR source_flags & 12 <> 0),
              count(*) FILTER (WHERE ask_sz_04 IS NULL OR NOT (bid_px_00 > 0 AND ask_px_00 >= bid_px_00)), count(*) FILTER (WHERE symbol <> 'EVT')] AS v FROM bad_snap)""")
def v02(spark, sf):
    n = lambda d: F.col("sequence") % d == 0
    bad = study.snapshots(spark, sf).withColumns({
        "ts_ns": F.col("ts_ns") + F.when(n(50), 1).otherwise(0), "source_recv_ns": F.col("source_recv_ns") + F.when(n(53), F.lit(10 * A)).otherwise(0),
        "age_ms": F.col("age_ms") + F.when(n(59), 1.0).otherwise(0.0), "source_flags": F.when(n(61), 4).otherwise(F.col("source_flags")),
        "bid_px_00": F.when(n(67), 0.0).otherwise(F.col("bid_px_00")), "symbol": F.when(n(71), "ALT").otherwise(F.col("symbol")),
        "ask_sz_04": F.when(~n(73), F.col("ask_sz_04"))})
    return ql.audit_snapshots(bad, I, MAX_AGE_MS, "EVT")


cte("doubled", """
SELECT file_date, ts_ns FROM snapshot UNION ALL SELECT strftime(CAST(file_date AS DATE) + 1, '%Y-%m-%d'), ts_ns FROM snapshot WHERE sequence % 97 = 0""")


@query("v03_order_audit", """
SELECT 'duplicate_time' AS rule, CAST(ts_ns AS VARCHAR) AS item FROM doubled GROUP BY ts_ns HAVING count(*) > 1
UNION ALL SELECT 'files_overlap', file_date
FROM (SELECT file_date, lo, max(hi) OVER (ORDER BY file_date ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS before
      FROM (SELECT file_date, min(ts_ns) AS lo, max(ts_ns) AS hi FROM doubled GROUP BY 1)) WHERE lo <= before""")
def v03(spark, sf):
    rows = settle(study.snapshots(spark, sf, ()).select("instrument_id", "file_date", "ts_ns", "sequence"))
    again = rows.where("sequence % 97 = 0").withColumn("file_date", F.date_add(F.to_date("file_date"), 1).cast("string"))
    return ql.audit_order(rows.unionByName(again))


@query("v04_single_instrument", "SELECT CAST(1 + CASE WHEN k % 50 = 11 THEN 1 ELSE 0 END AS BIGINT) AS instrument_id, count(*) AS rows FROM book GROUP BY 1")
def v04(spark, sf):
    mixed = messages(spark, sf).withColumn("instrument_id", F.col("instrument_id") + F.when(F.col("k") % 50 == 11, 1).otherwise(0))
    return ql.audit_instrument(mixed)


@query("v05_session_disagreement", "SELECT ts_ns, session_id || ':9' AS stored_segment, segment_id FROM asg WHERE sequence % 41 = 0")
def v05(spark, sf):
    stored = study.in_session(spark, sf)
    changed = F.when(F.col("sequence") % 41 == 0, F.concat("session_id", F.lit(":9"))).otherwise(F.col("segment_id"))
    return ql.audit_sessions(stored.withColumn("segment_id", changed), study.segments(spark)).select("ts_ns", "stored_segment", "segment_id")


@query("v06_feature_disagreement", """
SELECT ts_ns, CASE WHEN sequence % 43 = 0 THEN 'mid_price' ELSE 'feature_valid' END AS rule FROM feat WHERE sequence % 43 = 0 OR sequence % 47 = 0""")
def v06(spark, sf):
    n = lambda d: F.col("sequence") % d == 0
    rows = study.prepared(spark, sf).withColumns({
        "mid_price": F.col("mid_price") + F.when(n(43), 0.01).otherwise(0.0), "feature_valid": F.when(n(47), ~F.col("feature_valid")).otherwise(F.col("feature_valid"))})
    return ql.audit_features(rows).select("ts_ns", "rule")


@query("w12_block_disagreement", f"""
SELECT ts_ns FROM (SELECT ts_ns, ts_ns - lag(ts_ns) OVER w <> {I} OR segment_id <> lag(segment_id) OVER w AS actual, b <> lag(b) OVER w AS stored
                   FROM (SELECT *, continuous_block // 2 AS b FROM blk) WINDOW w AS (PARTITION BY session_id ORDER BY ts_ns)) WHERE actual <> stored""")
def w12(spark, sf):
    rows = study.blocked(spark, sf).withColumn("continuous_block", F.expr("continuous_block div 2"))
    return ql.audit_blocks(rows, I).select("ts_ns")


QUALITY = ["session_id", "observed_snapshots", "expected_grid_points", "missing_grid_points", "coverage_complete", "internal_missing", "continuous_blocks", "first_ns", "last_ns",
           "feature_valid", "learning_ready"]
cte("expected", f"SELECT session_id, CAST(sum(end_ns // {I} - start_ns // {I}) AS BIGINT) AS expected_grid_points FROM seg GROUP BY 1")
cte("quality", f"""
SELECT session_id, observed_snapshots, expected_grid_points, expected_grid_points - observed_snapshots AS missing_grid_points, expected_grid_points = observed_snapshots AS coverage_complete,
       internal_missing, continuous_blocks, first_ns, last_ns, feature_valid, learning_ready
FROM (SELECT session_id, count(*) AS observed_snapshots, max(continuous_block) AS continuous_blocks, min(ts_ns) AS first_ns, max(ts_ns) AS last_ns, count(*) FILTER (WHERE feature_valid) AS feature_valid,
             CAST(sum(coalesce((ts_ns - before) // {I} - 1, 0)) AS BIGINT) AS internal_missing
      FROM (SELECT *, lag(ts_ns) OVER (PARTITION BY segment_id ORDER BY ts_ns) AS before FROM feat) GROUP BY 1)
JOIN expected USING (session_id)
JOIN (SELECT session_id, count(*) FILTER (WHERE ok) AS learning_ready FROM (SELECT session_id, ts_ns, bool_and(label_valid AND feature_valid) AS ok FROM lbl GROUP BY 1, 2) GROUP BY 1) USING (session_id)""")


def quality(spark, sf):
    rows = settle(study.prepared(spark, sf), "prepared")
    ready = ft.learning_ready(ft.labels(rows, HORIZONS, SPLITS))
    return ql.session_quality(rows, study.segments(spark), I, ready).select(*QUALITY)


@query("v07_session_quality", "SELECT * FROM quality")
def v07(spark, sf):
    return quality(spark, sf)


@query("v08_unobserved_sessions", f"""
SELECT session_id, expected_grid_points, expected_grid_points AS missing_grid_points, false AS coverage_complete, 0 AS observed_snapshots, 0 AS internal_missing, 0 AS continuous_blocks,
       0 AS feature_valid, 0 AS learning_ready
FROM expected JOIN sess USING (session_id), (SELECT min(ts_ns) AS lo, max(ts_ns) AS hi FROM asg WHERE session_id NOT IN ('2024-01-10', '2024-01-18'))
WHERE open_ns < hi AND close_ns >= lo AND session_id NOT IN (SELECT session_id FROM asg WHERE session_id NOT IN ('2024-01-10', '2024-01-18'))""")
def v08(spark, sf):
    rows = settle(study.in_session(spark, sf).where("session_id not in ('2024-01-10', '2024-01-18')").select("session_id", "ts_ns"))
    return ql.unobserved(rows, study.segments(spark), I)


@query("v09_exclusions", """
SELECT count(*) FILTER (WHERE session_class = 'outside') AS outside_trading, count(*) FILTER (WHERE session_class = 'preopen') AS preopen_source,
       count(*) FILTER (WHERE session_class = 'uncovered') AS uncovered_calendar, count(*) AS snapshots FROM classed""")
def v09(spark, sf):
    return ql.exclusions(study.classified(spark, sf))


@query("v10_quote_sanity", f"""
SELECT unnest(['not_increasing', 'received_late', 'off_grid', 'bad_bid', 'crossed', 'mid_mismatch']) AS rule, unnest(v) AS violations
FROM (SELECT [count(*) FILTER (WHERE ts_ns <= before), count(*) FILTER (WHERE recv >= ts_ns), count(*) FILTER (WHERE ts_ns % {I} <> 0),
              count(*) FILTER (WHERE bid IS NULL OR NOT bid > 0), count(*) FILTER (WHERE bid IS NULL OR ask < bid), count(*) FILTER (WHERE bid IS NULL OR abs(mid - (bid + ask) / 2) > 1e-9)] AS v
      FROM (SELECT *, lag(ts_ns) OVER (PARTITION BY file_date ORDER BY sequence, ts_ns) AS before
            FROM (SELECT file_date, sequence, ts_ns + CASE WHEN sequence % 50 = 0 THEN 1 WHEN sequence % 71 = 0 THEN {-3 * I} ELSE 0 END AS ts_ns,
                         source_recv_ns + CASE WHEN sequence % 53 = 0 THEN {10 * A} ELSE 0 END AS recv,
                         CASE WHEN sequence % 61 = 0 THEN NULL WHEN sequence % 67 = 0 THEN 0.0 WHEN sequence % 73 = 0 THEN ask_px_00 + 1 ELSE bid_px_00 END AS bid, ask_px_00 AS ask,
                         (ask_px_00 + bid_px_00) / 2 + CASE WHEN sequence % 79 = 0 THEN 0.01 ELSE 0 END AS mid FROM snapshot)))""")
def v10(spark, sf):
    n = lambda d: F.col("sequence") % d == 0
    bid = F.when(n(61), F.lit(None).cast("double")).when(n(67), 0.0).when(n(73), F.col("ask_px_00") + 1).otherwise(F.col("bid_px_00"))
    bad = fx.with_mid_spread(study.snapshots(spark, sf, study.TOUCH)).withColumns({
        "ts_ns": F.col("ts_ns") + F.when(n(50), 1).when(n(71), -3 * I).otherwise(0), "source_recv_ns": F.col("source_recv_ns") + F.when(n(53), F.lit(10 * A)).otherwise(0),
        "bid_px_00": bid, "mid_price": F.col("mid_price") + F.when(n(79), 0.01).otherwise(0.0)})
    return ql.audit_quotes(bad, I)


def altered_orders(spark, sf):
    rows = table(spark, sf, "orders").select("o_orderkey", "o_custkey", "o_orderstatus", "o_totalprice")
    k = F.col("o_orderkey")
    kept = rows.where(k % 1013 != 5).withColumns({
        "o_totalprice": F.when(k % 997 == 7, F.col("o_totalprice") + 999).otherwise(F.col("o_totalprice")), "o_orderstatus": F.when(k % 991 != 3, F.col("o_orderstatus"))})
    extra = rows.where(k % 1009 == 11).withColumn("o_orderkey", -k - 1)
    return rows, kept.unionByName(extra)


@query("v11_dataset_diff", """
SELECT o_orderkey, kind, columns FROM (
  SELECT o_orderkey, CASE WHEN o_orderkey % 1013 = 5 THEN 'only_left' WHEN o_orderkey % 997 = 7 OR (o_orderkey % 991 = 3 AND o_orderstatus IS NOT NULL) THEN 'changed' END AS kind,
         CASE WHEN o_orderkey % 1013 <> 5 THEN concat_ws(',', CASE WHEN o_orderkey % 991 = 3 AND o_orderstatus IS NOT NULL THEN 'o_orderstatus' END, CASE WHEN o_orderkey % 997 = 7 THEN 'o_totalprice' END) END AS columns
  FROM orders UNION ALL SELECT -o_orderkey - 1, 'only_right', NULL FROM orders WHERE o_orderkey % 1009 = 11) WHERE kind IS NOT NULL""")
def v11(spark, sf):
    a, b = altered_orders(spark, sf)
    return ql.dataset_diff(a, b, ["o_orderkey"])


cte("altered", """
SELECT o_orderkey, o_custkey, CASE WHEN o_orderkey % 991 <> 3 THEN o_orderstatus END AS o_orderstatus, o_totalprice + CASE WHEN o_orderkey % 997 = 7 THEN 999 ELSE 0 END AS o_totalprice
FROM orders WHERE o_orderkey % 1013 <> 5
UNION ALL SELECT -o_orderkey - 1, o_custkey, o_orderstatus, o_totalprice FROM orders WHERE o_orderkey % 1009 = 11""")
cte("ordered", """
SELECT coalesce(a.position, b.position) AS position, CASE WHEN a.position IS NULL THEN 'only_right' WHEN b.position IS NULL THEN 'only_left' ELSE 'changed' END AS kind,
       CASE WHEN a.position IS NOT NULL AND b.position IS NOT NULL THEN concat_ws(',', CASE WHEN a.o_orderkey IS DISTINCT FROM b.o_orderkey THEN 'o_orderkey' END, CASE WHEN a.o_custkey IS DISTINCT FROM b.o_custkey THEN 'o_custkey' END,
            CASE WHEN a.o_orderstatus IS DISTINCT FROM b.o_orderstatus THEN 'o_orderstatus' END, CASE WHEN a.o_totalprice IS DISTINCT FROM b.o_totalprice THEN 'o_totalprice' END) END AS columns,
       a.o_orderkey AS left_o_orderkey, b.o_orderkey AS right_o_orderkey
FROM (SELECT row_number() OVER (ORDER BY o_orderkey) AS position, o_orderkey, o_custkey, o_orderstatus, o_totalprice FROM orders) a
FULL JOIN (SELECT row_number() OVER (ORDER BY o_orderkey) AS position, * FROM altered) b ON a.position = b.position
WHERE a.position IS NULL OR b.position IS NULL OR (a.o_orderkey, a.o_custkey, a.o_orderstatus, a.o_totalprice) IS DISTINCT FROM (b.o_orderkey, b.o_custkey, b.o_orderstatus, b.o_totalprice)""")


@query("v11_ordered_diff", "SELECT * FROM ordered")
def v11_ordered(spark, sf):
    a, b = altered_orders(spark, sf)
    return ql.ordered_diff(a, b, ["o_orderkey"])


@query("v11_diff_report", """
SELECT l.n AS left_rows, r.n AS right_rows, l.n = r.n AS same_count, (SELECT count(*) FROM ordered) AS different_positions, f.position AS first_position, f.kind AS first_kind, f.columns AS first_columns
FROM (SELECT count(*) AS n FROM orders) l CROSS JOIN (SELECT count(*) AS n FROM altered) r CROSS JOIN (SELECT * FROM ordered ORDER BY position LIMIT 1) f""")
def v11_report(spark, sf):
    a, b = altered_orders(spark, sf)
    return ql.diff_report(a, b, ["o_orderkey"])


@query("v12_report_diff", "SELECT session_id, 'changed' AS kind, 'feature_valid' AS columns FROM quality WHERE session_id = '2024-01-09'")
def v12(spark, sf):
    a = settle(quality(spark, sf).withColumn("source_path", F.lit("a")))
    off = F.when(F.col("session_id") == "2024-01-09", 1).otherwise(0)
    b = a.withColumns({"source_path": F.lit("b"), "feature_valid": F.col("feature_valid") + off})
    return ql.diff_except(a, b, ["session_id"], ["source_path"])


@query("v13_fingerprint", """
SELECT count(*) AS rows, CAST(sum(CAST('0x' || substr(md5(concat(
  coalesce(length(CAST(o_orderkey AS VARCHAR)) || ':' || o_orderkey, '-1:'), coalesce(length(CAST(o_custkey AS VARCHAR)) || ':' || o_custkey, '-1:'),
  coalesce(length(o_orderstatus) || ':' || o_orderstatus, '-1:'), coalesce(length(o_orderpriority) || ':' || o_orderpriority, '-1:'))), 1, 16) AS UBIGINT)) AS VARCHAR) AS fingerprint FROM orders""")
def v13(spark, sf):
    return ql.fingerprint(table(spark, sf, "orders"), ["o_orderkey", "o_custkey", "o_orderstatus", "o_orderpriority"])


@query("v14_coverage_matrix", """
SELECT a.age AS max_age_ms, file_date, CASE WHEN d = 4 AND a.age = 60000 THEN 'missing' WHEN d = 9 THEN 'repeated' ELSE 'partial' END AS rule
FROM (SELECT DISTINCT file_date, CAST(substr(file_date, 9, 2) AS INT) AS d FROM book) CROSS JOIN (VALUES (60000), (300000), (1200000)) a(age)
WHERE (d = 4 AND a.age = 60000) OR d = 9 OR (d = 12 AND a.age = 300000)""")
def v14(spark, sf):
    dates = settle(messages(spark, sf).select("file_date").distinct())
    d, age = F.substring("file_date", 9, 2).cast("int"), F.col("max_age_ms")
    runs = dates.withColumn("max_age_ms", F.explode(F.array(*[F.lit(a).cast("bigint") for a in AGES])))
    runs = runs.where(~((d == 4) & (age == AGES[0]))).withColumn("partial", (d == 12) & (age == AGES[1]))
    return ql.coverage_matrix(runs.unionByName(runs.where(d == 9)), dates, list(AGES))


CUT = 1_705_600_800_000_000_000  # 2024-01-18 18:00Z


@query("v15_causality", f"""
SELECT 'labels' AS derived, count(*) AS changed FROM lbl0 WHERE ts_ns <= {CUT} AND label_valid AND label_end_ns > {CUT}
UNION ALL SELECT 'features', 0""")
def v15(spark, sf):
    rows = settle(ft.with_continuous_block(study.in_session(spark, sf), I), "blocks")
    late = F.when(F.col("ts_ns") > CUT, 100.0).otherwise(0.0)
    moved = rows.withColumns({c: F.col(c) + late for c in BOOK_COLUMNS if "_px_" in c})
    keep = ["ts_ns", "feature_valid", "mid_price", "ret_lag_30", "vol_30", "micro_dev"]
    features = ql.causal_diff(lambda q: ft.base_features(q).select(*keep), rows, moved, CUT)
    labels = ql.causal_diff(lambda q: ft.labels(ft.base_features(q), HORIZONS).select("ts_ns", "horizon_ms", "future_price_diff"), rows, moved, CUT)
    count = lambda df, name, per: df.agg(F.lit(name).alias("derived"), F.expr(f"count(1) div {per}").alias("changed"))
    # A changed label shows twice, as the old and as the new row.
    return count(features, "features", 1).unionByName(count(labels, "labels", 2))


@query("z01_union_pieces", "SELECT o_orderstatus, count(*) AS rows, CAST(sum(o_orderkey) AS BIGINT) AS keys FROM orders GROUP BY 1")
def z01(spark, sf):
    orders = table(spark, sf, "orders").select("o_orderkey", "o_orderstatus")
    odd = F.col("o_orderkey") % 2 == 1
    both = orders.where(odd).unionByName(orders.where(~odd).select("o_orderstatus", "o_orderkey"))
    return both.groupBy("o_orderstatus").agg(F.count(F.lit(1)).alias("rows"), F.sum("o_orderkey").alias("keys"))


@query("z02_union_missing_columns", """
SELECT 'customer' AS side, c_nationkey AS nationkey, count(*) AS rows, round(sum(c_acctbal), 2) + 0.0 AS balance FROM customer GROUP BY ALL
UNION ALL SELECT 'supplier', s_nationkey, count(*), NULL FROM supplier GROUP BY ALL""")
def z02(spark, sf):
    customers = table(spark, sf, "customer").select(F.lit("customer").alias("side"), F.col("c_nationkey").alias("nationkey"), F.col("c_acctbal").alias("balance"))
    suppliers = table(spark, sf, "supplier").select(F.lit("supplier").alias("side"), F.col("s_nationkey").alias("nationkey"))
    rows = customers.unionByName(suppliers, allowMissingColumns=True).groupBy("side", "nationkey")
    return rows.agg(F.count(F.lit(1)).alias("rows"), (F.round(F.sum("balance"), 2) + 0.0).alias("balance"))


@query("z03_except", """
SELECT c_custkey AS key, 'customer_without_orders' AS kind FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_custkey IS NOT NULL)
UNION ALL SELECT k, 'repeated_order' FROM (SELECT o_custkey AS k FROM orders EXCEPT ALL SELECT c_custkey FROM customer)""")
def z03(spark, sf):
    customers, orders = table(spark, sf, "customer"), table(spark, sf, "orders")
    keys, used = customers.select(F.col("c_custkey").alias("key")), orders.select(F.col("o_custkey").alias("key"))
    idle = keys.join(used, "key", "left_anti").withColumn("kind", F.lit("customer_without_orders"))
    return idle.unionByName(used.exceptAll(keys).withColumn("kind", F.lit("repeated_order")))


@query("z04_subset_test", """
SELECT count(*) AS allowed, count(*) FILTER (WHERE s_nationkey IN (SELECT c_nationkey FROM customer)) AS declared,
       count(*) = count(*) FILTER (WHERE s_nationkey IN (SELECT c_nationkey FROM customer)) AS is_subset FROM (SELECT DISTINCT s_nationkey FROM supplier)""")
def z04(spark, sf):
    allowed = table(spark, sf, "supplier").select(F.col("s_nationkey").alias("n")).distinct()
    inside = allowed.join(table(spark, sf, "customer").select(F.col("c_nationkey").alias("n")), "n", "left_semi").withColumn("hit", F.lit(1))
    rows = allowed.join(inside, "n", "left").agg(F.count(F.lit(1)).alias("allowed"), F.count("hit").alias("declared"))
    return rows.withColumn("is_subset", F.col("allowed") == F.col("declared"))


@query("z05_distinct", "SELECT DISTINCT o_orderstatus, o_orderpriority FROM orders")
def z05(spark, sf):
    return table(spark, sf, "orders").select("o_orderstatus", "o_orderpriority").distinct()


@query("z06_sort", "SELECT file_date, count(*) AS messages FROM book GROUP BY 1 ORDER BY 1")
def z06(spark, sf):
    return messages(spark, sf).groupBy("file_date").agg(F.count(F.lit(1)).alias("messages")).orderBy("file_date")


@query("z07_top_k", "SELECT l_orderkey, l_linenumber, round(l_extendedprice, 2) + 0.0 AS price FROM lineitem ORDER BY l_extendedprice DESC, l_orderkey, l_linenumber LIMIT 50")
def z07(spark, sf):
    rows = table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", "l_extendedprice")
    top = rows.orderBy(F.col("l_extendedprice").desc(), "l_orderkey", "l_linenumber").limit(50)
    return top.select("l_orderkey", "l_linenumber", (F.round("l_extendedprice", 2) + 0.0).alias("price"))
