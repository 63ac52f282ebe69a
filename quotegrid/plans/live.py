"""Queries over streams, drained with the available-now trigger."""

from __future__ import annotations

from pyspark.sql import functions as F

from quotegrid.functions.book import r6
from quotegrid.operators.calendar import period_of
from quotegrid.params import DAY
from quotegrid.plans.registry import query
from quotegrid.plans.study import A, HORIZONS, I
from quotegrid.plans.trading import LONGEST, PERIOD, U, Day, day_start, rounded_all, u_columns
from quotegrid.sources.bindings import message_stream
from quotegrid.streaming import live, orders

DELAY = "10 minutes"


def end_of(day: Day) -> int:
    """A time at which every day of the replayed tables is over."""
    last = day.quotes.agg(F.max("ts_ns")).first()[0]
    return (last or 0) + 4 * DAY


@query("t01_stream_grid", """
SELECT file_date, ts_ns, source_recv_ns, sequence, round(age_ms, 6) + 0.0 AS age_ms, round(bid_px_00, 6) + 0.0 AS bid_px_00, round(ask_px_04, 6) + 0.0 AS ask_px_04, bid_sz_03 FROM snapshot""")
def t01(spark, sf):
    rows = live.run_to_table(live.grid_stream(message_stream(spark, sf), I, A, columns=("bid_px_00", "ask_px_04", "bid_sz_03")), "grid").where("kind = 'snapshot'")
    return rows.select("file_date", "ts_ns", "source_recv_ns", "sequence", r6(F.col("age_ms")).alias("age_ms"), r6(F.col("bid_px_00")).alias("bid_px_00"),
                       r6(F.col("ask_px_04")).alias("ask_px_04"), "bid_sz_03")


@query("t02_stream_tumbling", """
SELECT recv_ns // 60000000000 * 60000000000 AS start_ns, round(arg_max(bid_px_00, seq) FILTER (WHERE cls = 'G'), 6) + 0.0 AS bid, round(arg_max(ask_px_00, seq) FILTER (WHERE cls = 'G'), 6) + 0.0 AS ask,
       count(*) FILTER (WHERE cls = 'G') AS good, count(*) FILTER (WHERE cls = 'B') AS bad, count(*) FILTER (WHERE cls = 'O') AS open, count(*) FILTER (WHERE cls = 'U') AS unreliable
FROM msg GROUP BY 1 HAVING recv_ns // 60000000000 * 60000000000 + 60000000000 <= (SELECT max(recv_ns) FROM msg) - 300000000000""".replace(
    "HAVING recv_ns // 60000000000 * 60000000000", "HAVING start_ns"))
def t02(spark, sf):
    rows = live.run_to_table(live.tumbling_grid(message_stream(spark, sf), "60 seconds", "300 seconds"), "tumbling")
    return rounded_all(rows.drop("instrument_id"))


@query("t03_stream_late_rows", """
SELECT seq AS sequence, recv_ns AS ts_ns
FROM (SELECT seq, recv_ns, max(recv_ns) OVER (PARTITION BY file_date ORDER BY seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS clock
      FROM (SELECT * REPLACE (recv_ns - CASE WHEN k % 10 = 9 THEN 300000000000 ELSE 0 END AS recv_ns) FROM book WHERE flags & 8 = 0)) WHERE recv_ns < clock""")
def t03(spark, sf):
    late = F.when(F.col("k") % 10 == 9, 300_000_000_000).otherwise(0)
    shaken = message_stream(spark, sf).withColumn("recv_ns", F.col("recv_ns") - late)
    return live.run_to_table(live.grid_stream(shaken, I, A, columns=()), "late").where("kind = 'late'").select("sequence", "ts_ns")


@query("t04_stream_maturity", f"SELECT strategy, seq, status, {U} FROM sc")
def t04(spark, sf):
    day = Day(spark, sf)
    close = (day_start() + DAY).alias("close_ns")
    until = end_of(day)
    fills = live.replay_in_time(spark, day.fills.select("instrument_id", "file_date", close, "strategy", "seq", "ts_ns", "side", "mid"), "ts_ns", until)
    quotes = live.replay_in_time(spark, day.quotes.select("instrument_id", "file_date", close, "ts_ns", "mid"), "ts_ns", until)
    return u_columns(live.run_to_table(orders.maturing_fills(fills, quotes, HORIZONS, I, DELAY), "maturity"), "strategy", "seq", "status")


@query("t05_stream_period_feedback", """
SELECT strategy, file_date, version_id, period_index, owner, observed_at_ns, status, orders, matured, round(reward, 6) + 0.0 AS reward FROM fbr""")
def t05(spark, sf):
    day = Day(spark, sf)
    opened = {"_open": day_start(), "close_ns": day_start() + DAY}
    end = F.least(F.col("_open") + (F.col("period_index") + 1) * PERIOD, F.col("close_ns"))
    bucket = ["instrument_id", "file_date", "close_ns", "strategy", "version_id", "period_index", "owner", end.alias("end_ns")]
    placed = period_of(day.scored.withColumns(opened), "ts_ns", "_open", "close_ns", PERIOD)
    until = end_of(day)
    told = live.replay_in_time(spark, placed.select(*bucket, "ts_ns", "status", "score"), "ts_ns", until)
    chosen = live.replay_in_time(spark, day.selections.withColumns(opened).select(*bucket, "selected_at_ns"), "selected_at_ns", until)
    quotes = live.replay_in_time(spark, day.quotes.withColumns(opened).select("instrument_id", "file_date", "close_ns", "ts_ns"), "ts_ns", until)
    rows = live.run_to_table(orders.period_feedback_stream(chosen, told, quotes, LONGEST, DELAY), "periods")
    return rounded_all(rows.select("strategy", "file_date", "version_id", "period_index", "owner", "observed_at_ns", "status", "orders", "matured", "reward"))


@query("t06_stream_sink", "SELECT file_date, event_type, count(*) AS messages FROM book GROUP BY ALL")
def t06(spark, sf):
    rows = live.run_batches(message_stream(spark, sf).select("file_date", "event_type", "seq"), "batches")
    return rows.groupBy("file_date", "event_type").agg(F.count(F.lit(1)).alias("messages"))
