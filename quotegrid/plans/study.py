"""The study's intermediate tables, each built by library operators from ``events``,
next to the SQL subquery the oracle side uses for the same table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quotegrid.functions import book as fx
from quotegrid.operators import calendar as cal
from quotegrid.operators import features as ft
from quotegrid.operators import sampling as sm
from quotegrid.params import ASK_PX, ASK_SZ, BID_PX, BID_SZ, BOOK_COLUMNS, LEVELS
from quotegrid.plans.registry import cte
from quotegrid.sources.bindings import STUDY, messages

I = STUDY.interval_ns
A = STUDY.max_age_ns
HORIZONS = STUDY.horizons_ms
SPLITS = (1_705_320_000_000_000_000, 1_706_011_200_000_000_000)  # 2024-01-15 12:00Z, 2024-01-23 12:00Z

# The study calendar.
_HOLIDAY = cal.Rule(-2, "17:00", "12:15", ((-1, "12:00", "17:00"),))
RULES = cal.CalendarRules(
    zone="America/Chicago", valid_from="2024-01-02", valid_through="2024-01-30",
    regular=cal.Rule(-1, "17:00", "16:00", ((0, "15:15", "15:30"),)),
    closed=("2024-01-15",), overrides={"2024-01-16": _HOLIDAY})


TOUCH = (BID_PX[0], ASK_PX[0])


def snapshots(spark: SparkSession, sf_dir: str, columns: tuple = tuple(BOOK_COLUMNS)) -> DataFrame:
    return sm.grid_snapshots(messages(spark, sf_dir), I, A, columns=columns)


def segments(spark: SparkSession) -> DataFrame:
    return cal.expand_calendar(spark, RULES)


def classified(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Snapshots without their books, each with its class."""
    return cal.classify(snapshots(spark, sf_dir, ()), segments(spark))


def in_session(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cal.assigned(snapshots(spark, sf_dir), segments(spark))


def blocked(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Session snapshots with gap-free block numbers and mid prices."""
    return fx.with_mid_spread(ft.with_continuous_block(in_session(spark, sf_dir), I))


def prepared(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ft.base_features(ft.with_continuous_block(in_session(spark, sf_dir), I))


def library(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ft.library_features(prepared(spark, sf_dir), I)


def long_labels(spark: SparkSession, sf_dir: str, bounds: tuple = SPLITS) -> DataFrame:
    return ft.labels(prepared(spark, sf_dir), HORIZONS, bounds)


_bid = ", ".join(f"px - {0.25 * i} AS {BID_PX[i]}" for i in range(LEVELS))
_ask = ", ".join(f"apx + {0.25 * i} AS {ASK_PX[i]}" for i in range(LEVELS))
_bsz = ", ".join(f"CAST(1 + (k + {3 * i}) % 7 AS BIGINT) AS {BID_SZ[i]}" for i in range(LEVELS))
_asz = ", ".join(f"CAST(1 + (k + {5 * i}) % 11 AS BIGINT) AS {ASK_SZ[i]}" for i in range(LEVELS))

cte("book", f"""
SELECT event_id AS seq, event_id AS sequence, CAST(1 AS BIGINT) AS instrument_id, 'EVT' AS symbol,
       strftime(ts, '%Y-%m-%d') AS file_date, epoch_us(ts) * 1000 AS recv_ns, k, user_id, event_type,
       CASE WHEN k % 25 = 0 THEN 136 WHEN k % 20 = 1 THEN 132 WHEN k % 10 = 3 THEN 0 ELSE 128 END AS flags,
       {_bid}, {_ask}, {_bsz}, {_asz}
FROM (SELECT *, px + CASE WHEN k % 33 = 7 THEN -0.25 ELSE 0.25 * (1 + k % 3) END AS apx
      FROM (SELECT *, CAST(json_extract_string(props, '$.k') AS INT) AS k, CAST(round(100 + value, 2) AS DOUBLE) AS px FROM events))
""")
cte("msg", """
SELECT *, CASE WHEN flags & 8 <> 0 THEN 'U' WHEN flags & 128 = 0 THEN 'O'
               WHEN flags & 4 <> 0 OR NOT (bid_px_00 > 0 AND ask_px_00 >= bid_px_00 AND bid_sz_00 > 0 AND ask_sz_00 > 0) THEN 'B'
               ELSE 'G' END AS cls
FROM book
""")
cte("state", """
SELECT *, last_value(CASE WHEN cls <> 'U' THEN recv_ns END IGNORE NULLS) OVER w AS eff,
       last_value(CASE WHEN cls <> 'O' THEN cls || CASE WHEN flags & 4 <> 0 THEN '4' ELSE '' END END IGNORE NULLS) OVER w AS settled,
       last_value(CASE WHEN cls = 'G' THEN recv_ns END IGNORE NULLS) OVER w AS good_recv
FROM msg WINDOW w AS (PARTITION BY file_date ORDER BY seq ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)
""")
cte("gov", f"""
SELECT *, (eff // {I} + 1) * {I} AS lo, (nxt // {I}) * {I} AS hi,
       CASE WHEN cls = 'G' THEN least((nxt // {I}) * {I}, ((eff + {A}) // {I}) * {I}) END AS ehi,
       CASE WHEN cls = 'G' THEN 'stale_completed_book' WHEN settled LIKE 'U%' THEN 'unreliable_receive_state'
            WHEN settled = 'B4' THEN 'bad_book_flag' WHEN settled = 'B' THEN 'invalid_completed_book'
            ELSE 'incomplete_event' END AS reason
FROM (SELECT *, lead(eff) OVER (PARTITION BY file_date ORDER BY seq) AS nxt FROM state)
WHERE eff IS NOT NULL AND nxt IS NOT NULL
""")
_books = ", ".join(BID_PX + ASK_PX + BID_SZ + ASK_SZ)
cte("snap", f"""
SELECT instrument_id, file_date, symbol, unnest(range(lo, ehi + 1, {I})) AS ts_ns, recv_ns AS source_event_ns,
       recv_ns AS source_recv_ns, sequence, flags AS source_flags, {_books}
FROM gov WHERE ehi >= lo
""")
cte("snapshot", "SELECT *, (ts_ns - source_recv_ns) / 1e6 AS age_ms FROM snap")
cte("seg0", """
SELECT strftime(d, '%Y-%m-%d') AS session_id, strftime(d, '%Y-%m-%d') || ':' || n AS segment_id,
       epoch_us(timezone('America/Chicago', CAST(d AS TIMESTAMP) + to_days(so) + to_seconds(ss))) * 1000 AS start_ns,
       epoch_us(timezone('America/Chicago', CAST(d AS TIMESTAMP) + to_days(eo) + to_seconds(es))) * 1000 AS end_ns
FROM (SELECT CAST(r AS DATE) AS d FROM range(DATE '2024-01-02', DATE '2024-01-31', INTERVAL 1 DAY) t(r)) days
JOIN (VALUES ('regular', 0, -1, 61200, 0, 54900), ('regular', 1, 0, 55800, 0, 57600),
             ('short', 0, -2, 61200, -1, 43200), ('short', 1, -1, 61200, 0, 44100)) rules(rule, n, so, ss, eo, es)
  ON rule = CASE WHEN d = DATE '2024-01-16' THEN 'short' ELSE 'regular' END
WHERE isodow(d) < 6 AND d <> DATE '2024-01-15'
""")
cte("seg", """
SELECT *, min(start_ns) OVER (PARTITION BY session_id) AS open_ns, max(end_ns) OVER (PARTITION BY session_id) AS close_ns FROM seg0
""")
cte("sess", "SELECT DISTINCT session_id, open_ns, close_ns FROM seg")
cte("span", "SELECT min(start_ns) AS cover_a, max(end_ns) AS cover_b FROM seg")
cte("classed", """
SELECT c.*, session_id, segment_id, start_ns, end_ns, open_ns, close_ns,
       CASE WHEN NOT (ts_ns BETWEEN cover_a AND cover_b) THEN 'uncovered' WHEN start_ns IS NULL THEN 'outside' WHEN source_recv_ns < start_ns THEN 'preopen' ELSE 'assigned' END AS session_class
FROM snapshot c CROSS JOIN span LEFT JOIN seg ON ts_ns > start_ns AND ts_ns <= end_ns
""")
cte("asg", "SELECT * FROM classed WHERE session_class = 'assigned'")
cte("blk", f"""
SELECT *, (ask_px_00 + bid_px_00) / 2 AS mid_price,
       CAST(sum(nb) OVER (PARTITION BY session_id ORDER BY ts_ns ROWS UNBOUNDED PRECEDING) AS BIGINT) AS continuous_block
FROM (SELECT *, CASE WHEN lag(ts_ns) OVER w IS NULL OR ts_ns - lag(ts_ns) OVER w <> {I} OR segment_id <> lag(segment_id) OVER w
                     THEN 1 ELSE 0 END AS nb
      FROM asg WINDOW w AS (PARTITION BY session_id ORDER BY ts_ns))
""")
_wb = "(bid_sz_00 * 1.0::DOUBLE + bid_sz_01 * 0.5::DOUBLE + bid_sz_02 * 0.33::DOUBLE + bid_sz_03 * 0.25::DOUBLE + bid_sz_04 * 0.2::DOUBLE)"
_wa = _wb.replace("bid", "ask")
cte("scalar", f"""
SELECT *, ask_px_00 - bid_px_00 AS spread, (ask_px_00 - bid_px_00) / mid_price AS rel_spread,
       (bid_sz_00 - ask_sz_00) / CAST(bid_sz_00 + ask_sz_00 AS DOUBLE) AS obi_l1,
       ({_wb} - {_wa}) / ({_wb} + {_wa}) AS obi_multi,
       ((ask_px_00 * bid_sz_00 + bid_px_00 * ask_sz_00) / (bid_sz_00 + ask_sz_00) - mid_price) / (ask_px_00 - bid_px_00 + 1e-8) AS micro_dev,
       CAST({" + ".join(BID_SZ + ASK_SZ)} AS DOUBLE) AS displayed_depth
FROM blk
""")
cte("ret", """
SELECT *, mid_price / lag(mid_price, 1) OVER b - 1 AS ret_lag_1, mid_price / lag(mid_price, 5) OVER b - 1 AS ret_lag_5,
       mid_price / lag(mid_price, 10) OVER b - 1 AS ret_lag_10, mid_price / lag(mid_price, 30) OVER b - 1 AS ret_lag_30,
       displayed_depth - lag(displayed_depth, 1) OVER b AS depth_diff_1,
       (displayed_depth - lag(displayed_depth, 5) OVER b) / 300.0 AS depth_speed_5,
       (mid_price - lag(mid_price) OVER b) * displayed_depth AS price_diff_1_x_depth,
       (mid_price - lag(mid_price) OVER b) / displayed_depth AS price_diff_1_div_depth
FROM scalar WINDOW b AS (PARTITION BY session_id, continuous_block ORDER BY ts_ns)
""")
cte("feat0", """
SELECT *,
       CASE WHEN count(ret_lag_1) OVER w10 = 10 THEN stddev_samp(ret_lag_1) OVER w10 END AS vol_10,
       CASE WHEN count(ret_lag_1) OVER w30 = 30 THEN stddev_samp(ret_lag_1) OVER w30 END AS vol_30,
       CASE WHEN count(*) OVER w10 = 10 THEN avg(mid_price) OVER w10 END / mid_price - 1 AS mid_ma_rel_10,
       CASE WHEN count(*) OVER w10 = 10 THEN var_pop(mid_price) OVER w10 END / (mid_price * mid_price) AS mid_var_rel_10,
       CASE WHEN count(*) OVER w10 = 10 THEN avg(displayed_depth) OVER w10 END AS depth_ma_10,
       CASE WHEN count(*) OVER w10 = 10 THEN var_pop(displayed_depth) OVER w10 END AS depth_var_10
FROM ret
WINDOW w10 AS (PARTITION BY session_id, continuous_block ORDER BY ts_ns ROWS BETWEEN 9 PRECEDING AND CURRENT ROW),
       w30 AS (PARTITION BY session_id, continuous_block ORDER BY ts_ns ROWS BETWEEN 29 PRECEDING AND CURRENT ROW)
""")
cte("feat", """
SELECT *, ret_lag_30 IS NOT NULL AND vol_30 IS NOT NULL AS feature_valid,
       ret_lag_30 IS NOT NULL AND vol_30 IS NOT NULL AS library_valid FROM feat0
""")
_splits = " + ".join(f"CASE WHEN {{t}} >= {b} THEN 1 ELSE 0 END" for b in SPLITS)
_label = """
SELECT *, ts_ns + horizon_ms * 1000000 AS label_end_ns, label_reason = 'valid' AS label_valid,
       CASE WHEN label_reason = 'valid' THEN tmid - mid_price END AS future_price_diff,
       CASE WHEN label_reason = 'valid' THEN (tmid - mid_price) / mid_price END AS future_return
FROM (SELECT q.instrument_id, q.session_id, q.segment_id, q.ts_ns, q.feature_valid, q.mid_price, q.continuous_block, h.horizon_ms,
             t.mid_price AS tmid, t.continuous_block AS tblock, q.open_ns, q.close_ns,
             CASE WHEN q.ts_ns + h.horizon_ms * 1000000 > q.close_ns THEN 'session_boundary'
                  WHEN q.ts_ns + h.horizon_ms * 1000000 > q.end_ns THEN 'scheduled_break'
                  {split}
                  WHEN t.ts_ns IS NULL THEN 'missing_target'
                  WHEN t.continuous_block <> q.continuous_block THEN 'gap' ELSE 'valid' END AS label_reason
      FROM feat q CROSS JOIN (VALUES (CAST(300000 AS BIGINT)), (900000), (2700000)) h(horizon_ms)
      LEFT JOIN feat t ON t.session_id = q.session_id AND t.ts_ns = q.ts_ns + h.horizon_ms * 1000000)
"""
_cross = f"WHEN {_splits.format(t='q.ts_ns')} <> {_splits.format(t='(q.ts_ns + h.horizon_ms * 1000000)')} THEN 'split_boundary'"
cte("lbl", _label.replace("{split}", _cross))
cte("lbl0", _label.replace("{split}", ""))
cte("train", """
SELECT f.*, (t.mid_price - f.mid_price) / f.mid_price AS y
FROM feat f JOIN feat t ON t.session_id = f.session_id AND t.ts_ns = f.ts_ns + 300000000000 AND t.continuous_block = f.continuous_block
WHERE f.feature_valid AND f.ts_ns >= f.open_ns AND f.ts_ns + 2700000000000 < f.close_ns + 1
""")
