"""Queries over signals, intents, fills, money, markouts and period feedback."""

from __future__ import annotations

from functools import cached_property

from pyspark.sql import Window
from pyspark.sql import functions as F

from quotegrid.operators import features as ft
from quotegrid.operators import ledger as lg
from quotegrid.operators import models as md
from quotegrid.operators import rewards as rw
from quotegrid.operators.calendar import asof_version, period_of
from quotegrid.operators.ordered import asof, ordinal
from quotegrid.params import DAY, MS, Contract
from quotegrid.plans import learning, study
from quotegrid.plans.learning import VERSION_TIMES, inline
from quotegrid.plans.prepare import UNTIL
from quotegrid.plans.registry import cte, query
from quotegrid.plans.study import HORIZONS, I
from quotegrid.session import settle
from quotegrid.sources.bindings import STUDY, messages

CONTRACT = Contract()
ACCOUNT = rw.ACCOUNT
WEIGHTS = (0.5, 0.3, 0.2)
ARMS = 3
PERIOD = STUDY.period_ms * MS
LONGEST = max(HORIZONS) * MS


def day_start():
    return F.expr("unix_date(CAST(file_date AS DATE))").cast("bigint") * DAY


RATIOS = ("drawdown", "max_drawdown", "net_return")


def rounded_all(df):
    """Doubles to six digits (ratios of money to capital to ten), everything else as is."""
    digits = lambda name: 10 if name in RATIOS else 6
    return df.select(*[(F.round(f.name, digits(f.name)) + F.lit(0.0)).alias(f.name) if f.dataType.typeName() == "double" else F.col(f.name)
                       for f in df.schema.fields])


class Day:
    """The trading tables of one query run.  Tables with several readers are written once."""

    def __init__(self, spark, sf):
        self.spark, self.sf = spark, sf

    @cached_property
    def quotes(self):
        """Quotes of each source day with exact targets; gaps alone split the blocks."""
        rows = study.snapshots(self.spark, self.sf, study.TOUCH).select(
            "instrument_id", "file_date", "ts_ns", F.col("bid_px_00").alias("bid"), F.col("ask_px_00").alias("ask"),
            ((F.col("bid_px_00") + F.col("ask_px_00")) / 2).alias("mid"))
        return settle(rw.quotes_with_targets(rows, HORIZONS, I), "quotes")

    @cached_property
    def routed(self):
        """Purchases play orders: alternating open and close per strategy and day, each with the next quote;
        no later quote leaves ``ts_ns`` and all that is quoted NULL, and the order ``unexecuted_at_end``."""
        bought = messages(self.spark, self.sf).where("event_type = 'purchase'").select(
            F.concat(F.lit("S"), F.col("user_id") % 4).alias("strategy"), "instrument_id", "file_date", "seq", "k",
            (F.col("user_id") % ARMS).cast("int").alias("owner"), "recv_ns", F.col("recv_ns").alias("ts_ns"))
        bought = ordinal(bought, ACCOUNT, "seq", lg.SEQ_CHUNK).withColumn("opening", F.col("rn") % 2 == 1)
        values = ["bid", "ask", "mid", "continuous_block", "targets", "last_ns"]
        found = asof(bought, self.quotes, "ts_ns", rw.DAY_KEYS, values, forward=True)
        found = found.withColumn("ts_ns", F.col("matched_ts_ns")).drop("matched_ts_ns")
        week = F.concat(F.lit("w"), F.weekofyear(F.to_date("file_date")))
        found = settle(found.withColumn("version_id", week), "orders")
        numbered = lg.with_trade_number(found, ACCOUNT)
        trade = Window.partitionBy(*ACCOUNT, "trade_number")
        first = F.max(F.when(F.col("opening"), F.when(F.col("k") % 2 == 0, 1).otherwise(-1))).over(trade)
        return numbered.withColumns({"side": F.when(F.col("opening"), first).otherwise(-first), "order_status": lg.order_status()})

    @cached_property
    def orders(self):
        """The orders that met a quote; the others have no price and are counted by ``k05_order_outcomes``."""
        return self.routed.where(F.col("order_status") == "executed")

    @cached_property
    def fills(self):
        return settle(lg.attribute(lg.price_fills(self.orders, CONTRACT), ACCOUNT, CONTRACT), "fills")

    @cached_property
    def marked(self):
        return rw.markout(self.fills, HORIZONS)

    @cached_property
    def scored(self):
        return rw.score_net(self.marked, WEIGHTS, CONTRACT)

    @cached_property
    def curve(self):
        return lg.equity(self.quotes, self.fills, ACCOUNT, CONTRACT)

    @cached_property
    def summaries(self):
        return lg.day_summary(self.curve, self.fills, lg.pair_trades(self.fills, ACCOUNT), ACCOUNT, CONTRACT.initial_capital)

    @cached_property
    def selections(self):
        """One selection per strategy, day and half hour that has a quote."""
        rows = self.quotes.select("instrument_id", "file_date", "ts_ns").withColumns({"_open": day_start(), "_close": day_start() + DAY})
        rows = period_of(rows, "ts_ns", "_open", "_close", PERIOD)
        first = rows.groupBy("instrument_id", "file_date", "period_index").agg(F.min("ts_ns").alias("selected_at_ns"))
        first = first.withColumn("strategy", F.explode(F.array(*[F.lit(f"S{i}") for i in range(4)])))
        day = F.dayofmonth(F.to_date("file_date"))
        return first.withColumns({
            "owner": ((F.col("period_index") + day) % ARMS).cast("int"),
            "version_id": F.concat(F.lit("w"), F.weekofyear(F.to_date("file_date")))})

    @cached_property
    def buckets(self):
        placed = self.scored.withColumns({"_open": day_start(), "_close": day_start() + DAY})
        return rw.period_buckets(self.selections, period_of(placed, "ts_ns", "_open", "_close", PERIOD))

    @cached_property
    def feedback(self):
        rows = settle(self.buckets, "buckets")
        return rw.period_feedback(rows, self.quotes, day_start(), PERIOD, day_start() + DAY, LONGEST)

    @cached_property
    def arms(self):
        return rw.arm_stats(self.selections, self.feedback, ARMS)


cte("fq", f"""
SELECT *, CAST(sum(nb) OVER (PARTITION BY file_date ORDER BY ts_ns ROWS UNBOUNDED PRECEDING) AS BIGINT) AS block,
       max(ts_ns) OVER (PARTITION BY file_date) AS last_ns
FROM (SELECT instrument_id, file_date, ts_ns, bid_px_00 AS bid, ask_px_00 AS ask, (bid_px_00 + ask_px_00) / 2 AS mid,
             CASE WHEN ts_ns - lag(ts_ns) OVER (PARTITION BY file_date ORDER BY ts_ns) = {I} THEN 0 ELSE 1 END AS nb FROM snapshot)""")
cte("buy", """
SELECT 'S' || (user_id % 4) AS strategy, file_date, seq, k, user_id % 3 AS raw_owner, recv_ns,
       row_number() OVER (PARTITION BY user_id % 4, file_date ORDER BY seq) AS rn FROM book WHERE event_type = 'purchase'""")
cte("fill0", """
SELECT b.*, q.ts_ns, bid, ask, mid, block, last_ns, rn % 2 = 1 AS opening, (rn + 1) // 2 AS trade_number,
       'w' || weekofyear(CAST(b.file_date AS DATE)) AS version_id
FROM buy b ASOF LEFT JOIN fq q ON q.file_date = b.file_date AND q.ts_ns >= b.recv_ns""")
cte("fill1", """
SELECT f.*, o.raw_owner AS owner, o.mid AS entry_mid, CASE WHEN o.k % 2 = 0 THEN 1 ELSE -1 END AS direction,
       CASE WHEN (o.k % 2 = 0) = f.opening THEN 1 ELSE -1 END AS side
FROM fill0 f JOIN fill0 o ON o.strategy = f.strategy AND o.file_date = f.file_date AND o.trade_number = f.trade_number AND o.opening""")
cte("fill2", "SELECT *, CASE WHEN side > 0 THEN ask ELSE bid END + side * 0.125 AS price FROM fill1")
cte("ord", """
SELECT *, side * (price - mid) * 50.0 + 1.25 AS cost_usd, CASE WHEN NOT opening THEN direction * (mid - entry_mid) * 50.0 END AS realised_usd,
       CASE WHEN ts_ns IS NULL THEN 'unexecuted_at_end' ELSE 'executed' END AS order_status FROM fill2""")
cte("fl", "SELECT * FROM ord WHERE order_status = 'executed'")
cte("tf", f"""
SELECT r.*, ts_ns < end_ns AS tradable, ts_ns < end_ns AND ts_ns + {I} >= end_ns AS scheduled_exit, v.version_id
FROM reasons r ASOF LEFT JOIN handver v ON v.available_at_ns <= r.ts_ns""")
cte("rr", """
SELECT *, CASE WHEN tradable AND ts_ns = (SELECT max(ts_ns) FROM tf) THEN 'replay_end' WHEN scheduled_exit THEN 'scheduled_exit'
               ELSE coalesce(change_reason, CASE WHEN NOT tradable THEN 'closed_boundary' END) END AS reset_reason,
       lag(ts_ns) OVER (ORDER BY ts_ns) IS NOT NULL AND version_id IS DISTINCT FROM lag(version_id) OVER (ORDER BY ts_ns) AS version_changed
FROM tf""")


def flagged(spark, sf):
    quotes = settle(study.blocked(spark, sf), "quotes")
    rows = lg.trade_flags(ft.with_change_reason(quotes, I), I)
    versions = inline(spark, "version_id, available_at_ns", list(VERSION_TIMES.items()))
    rows = settle(asof_version(rows, versions, UNTIL), "versioned")
    rows = lg.with_version_change(rows, ["instrument_id"])
    return settle(lg.reset_reason(rows, ["instrument_id"]), "flags")


@query("k01_trade_flags", "SELECT ts_ns, tradable, scheduled_exit FROM tf")
def k01(spark, sf):
    return lg.trade_flags(study.in_session(spark, sf), I).select("ts_ns", "tradable", "scheduled_exit")


@query("k02_reset_reason", "SELECT ts_ns, reset_reason, version_changed FROM rr")
def k02(spark, sf):
    return flagged(spark, sf).select("ts_ns", "reset_reason", "version_changed")


LATENCY = 150_000_000_000
cte("intent", f"""
SELECT r.ts_ns, r.ts_ns + {LATENCY} AS due_ns, q.ts_ns AS eligible_ns
FROM rr r ASOF LEFT JOIN (SELECT ts_ns FROM rr) q ON q.ts_ns >= r.ts_ns + {LATENCY} WHERE r.tradable AND NOT r.scheduled_exit""")


def intents(spark, sf, quotes):
    signals = quotes.where("tradable and not scheduled_exit").select("instrument_id", "ts_ns")
    return lg.route_intents(signals, quotes, LATENCY, ["instrument_id"])


@query("k03_route_intents", "SELECT * FROM intent")
def k03(spark, sf):
    return intents(spark, sf, flagged(spark, sf)).select("ts_ns", "due_ns", "eligible_ns")


cte("fate", """
SELECT ts_ns, eligible_ns, CASE WHEN dead THEN why WHEN eligible_ns IS NULL THEN 'unexecuted_at_end'
                                WHEN ts_ns < max(CASE WHEN NOT dead THEN ts_ns END) OVER (PARTITION BY eligible_ns) THEN 'superseded' ELSE 'executable' END AS fate
FROM (SELECT i.*, why, z.ts_ns IS NOT NULL AND (eligible_ns IS NULL OR z.ts_ns <= eligible_ns) AS dead
      FROM intent i ASOF LEFT JOIN (SELECT ts_ns, CASE WHEN version_changed THEN 'model_version_change' ELSE reset_reason END AS why
                                    FROM rr WHERE version_changed OR reset_reason IS NOT NULL) z ON z.ts_ns > i.ts_ns)""")


def fates(spark, sf):
    quotes = flagged(spark, sf)
    return lg.intent_fate(intents(spark, sf, quotes), quotes, ["instrument_id"])


@query("k04_intent_fate", "SELECT * FROM fate")
def k04(spark, sf):
    return fates(spark, sf).select("ts_ns", "eligible_ns", "fate")


@query("k09_fate_counts", "SELECT fate, count(*) AS intents FROM fate GROUP BY 1")
def k09(spark, sf):
    return lg.fate_counts(fates(spark, sf), ["instrument_id"]).select("fate", "intents")


@query("k05_price_fills", """
SELECT strategy, seq, side, order_status, ts_ns, round(price, 6) + 0.0 AS price, round(cost_usd, 6) + 0.0 AS cost_usd,
       round(cost_usd / (mid * 50.0), 6) + 0.0 AS cost_ratio, round(abs(price * 50.0), 6) + 0.0 AS turnover_usd FROM ord""")
def k05(spark, sf):
    rows = lg.price_fills(Day(spark, sf).routed, CONTRACT)
    return rounded_all(rows.select("strategy", "seq", "side", "order_status", "ts_ns", "price", "cost_usd", "cost_ratio", "turnover_usd"))


@query("k05_order_outcomes", """
SELECT strategy, file_date, count(*) AS orders, count(*) FILTER (WHERE order_status = 'executed') AS executed,
       count(*) FILTER (WHERE order_status <> 'executed') AS unexecuted_at_end FROM ord GROUP BY 1, 2""")
def k05_outcomes(spark, sf):
    return lg.order_outcomes(Day(spark, sf).routed, ACCOUNT).drop("instrument_id")


cte("trade", """
SELECT strategy, file_date, trade_number, any_value(owner) AS owner, any_value(direction) AS direction,
       max(ts_ns) FILTER (WHERE opening) AS entry_ns, max(ts_ns) FILTER (WHERE NOT opening) AS exit_ns,
       max(price) FILTER (WHERE opening) AS entry_price, max(price) FILTER (WHERE NOT opening) AS exit_price,
       max(realised_usd) AS gross_pnl_usd, sum(cost_usd) AS friction_usd, max(realised_usd) - sum(cost_usd) AS net_pnl_usd,
       (max(ts_ns) FILTER (WHERE NOT opening) - max(ts_ns) FILTER (WHERE opening)) / 1e6 AS holding_ms
FROM fl GROUP BY 1, 2, 3 HAVING count(*) = 2""")


@query("k06_pair_trades", """
SELECT * REPLACE (CAST(owner AS INT) AS owner, round(entry_price, 6) + 0.0 AS entry_price, round(exit_price, 6) + 0.0 AS exit_price, round(gross_pnl_usd, 6) + 0.0 AS gross_pnl_usd,
  round(friction_usd, 6) + 0.0 AS friction_usd, round(net_pnl_usd, 6) + 0.0 AS net_pnl_usd, round(holding_ms, 6) + 0.0 AS holding_ms) FROM trade""")
def k06(spark, sf):
    return rounded_all(lg.pair_trades(Day(spark, sf).fills, ACCOUNT).drop("instrument_id"))


cte("acct_quote", """
SELECT a.strategy, q.file_date, q.ts_ns, q.mid, f.cost, f.realised, f.position, f.entry
FROM (SELECT DISTINCT strategy, file_date FROM fl) a JOIN fq q USING (file_date)
LEFT JOIN (SELECT strategy, file_date, ts_ns, sum(cost_usd) AS cost, sum(realised_usd) AS realised,
                  arg_max(CASE WHEN opening THEN direction ELSE 0 END, seq) AS position, arg_max(entry_mid, seq) AS entry FROM fl GROUP BY 1, 2, 3) f
  ON f.strategy = a.strategy AND f.file_date = q.file_date AND f.ts_ns = q.ts_ns""")
cte("eq", """
SELECT strategy, file_date, ts_ns, realised_usd, cost_usd, position, realised_usd + CASE WHEN position <> 0 THEN position * (mid - entry) * 50.0 ELSE 0 END AS gross_usd,
       realised_usd + CASE WHEN position <> 0 THEN position * (mid - entry) * 50.0 ELSE 0 END - cost_usd AS net_usd
FROM (SELECT strategy, file_date, ts_ns, mid, coalesce(sum(realised) OVER w, 0.0) AS realised_usd, coalesce(sum(cost) OVER w, 0.0) AS cost_usd,
             coalesce(last_value(position IGNORE NULLS) OVER w, 0) AS position, last_value(entry IGNORE NULLS) OVER w AS entry
      FROM acct_quote WINDOW w AS (PARTITION BY strategy, file_date ORDER BY ts_ns ROWS UNBOUNDED PRECEDING))""")


EQ = "strategy, file_date, ts_ns, position, round(realised_usd, 6) + 0.0 AS realised_usd, round(cost_usd, 6) + 0.0 AS cost_usd, round(gross_usd, 6) + 0.0 AS gross_usd, round(net_usd, 6) + 0.0 AS net_usd"


@query("k07_mark_to_market", f"SELECT {EQ} FROM eq")
def k07(spark, sf):
    return rounded_all(Day(spark, sf).curve.drop("instrument_id"))


cte("dd", """
SELECT *, greatest(100000.0, max(100000.0 + net_usd) OVER (PARTITION BY strategy, file_date ORDER BY ts_ns ROWS UNBOUNDED PRECEDING)) AS peak_usd FROM eq""")


@query("w09_drawdown", """
SELECT strategy, file_date, ts_ns, round(peak_usd, 6) + 0.0 AS peak_usd, round(peak_usd - (100000.0 + net_usd), 6) + 0.0 AS drawdown_usd,
       round((peak_usd - (100000.0 + net_usd)) / peak_usd, 10) + 0.0 AS drawdown FROM dd""")
def w09(spark, sf):
    rows = lg.drawdown(Day(spark, sf).curve, ACCOUNT, CONTRACT.initial_capital)
    return rounded_all(rows.select("strategy", "file_date", "ts_ns", "peak_usd", "drawdown_usd", "drawdown"))


@query("w10_thin_curve", """
SELECT strategy, file_date, ts_ns, round(net_usd, 6) + 0.0 AS net_usd
FROM (SELECT *, row_number() OVER (PARTITION BY strategy, file_date ORDER BY ts_ns) - 1 AS i, count(*) OVER (PARTITION BY strategy, file_date) AS n FROM eq)
WHERE i = n - 1 OR i % greatest(1, n // 300) = 0""")
def w10(spark, sf):
    return rounded_all(lg.thin_curve(Day(spark, sf).curve, ACCOUNT).select("strategy", "file_date", "ts_ns", "net_usd"))


cte("daysum", """
SELECT e.strategy, e.file_date, total_fills, coalesce(n, 0) AS total_trades, gross_pnl_usd, friction_usd, net_pnl_usd, net_pnl_usd / 100000.0 AS net_return,
       max_drawdown, max_drawdown_usd, holding_ms_mean, terminal_position, terminal_position = 0 AS settled
FROM (SELECT strategy, file_date, arg_max(gross_usd, ts_ns) AS gross_pnl_usd, arg_max(cost_usd, ts_ns) AS friction_usd, arg_max(net_usd, ts_ns) AS net_pnl_usd,
             arg_max(position, ts_ns) AS terminal_position, max((peak_usd - (100000.0 + net_usd)) / peak_usd) AS max_drawdown, max(peak_usd - (100000.0 + net_usd)) AS max_drawdown_usd
      FROM dd GROUP BY 1, 2) e
JOIN (SELECT strategy, file_date, count(*) AS total_fills FROM fl GROUP BY 1, 2) f USING (strategy, file_date)
LEFT JOIN (SELECT strategy, file_date, count(*) AS n, avg(holding_ms) AS holding_ms_mean FROM trade GROUP BY 1, 2) t USING (strategy, file_date)""")
DAYSUM = ("* REPLACE (" + ", ".join(f"round({c}, {10 if c in RATIOS else 6}) + 0.0 AS {c}" for c in
          ["gross_pnl_usd", "friction_usd", "net_pnl_usd", "net_return", "max_drawdown", "max_drawdown_usd", "holding_ms_mean"]) + ")")


@query("k08_day_summary", f"SELECT {DAYSUM} FROM daysum")
def k08(spark, sf):
    return rounded_all(Day(spark, sf).summaries.drop("instrument_id"))


@query("k10_attribution", """
SELECT f.strategy, f.seq, f.opening, CAST(f.owner AS INT) AS owner, f.direction, round(f.entry_mid, 6) + 0.0 AS entry_mid, o.version_id, f.version_id AS trigger_version
FROM fl f JOIN fl o ON o.strategy = f.strategy AND o.file_date = f.file_date AND o.trade_number = f.trade_number AND o.opening""")
def k10(spark, sf):
    return rounded_all(Day(spark, sf).fills.select("strategy", "seq", "opening", "owner", "direction", "entry_mid", "version_id", "trigger_version"))


cte("mk", """
SELECT f.*, t1.mid AS m1, t2.mid AS m2, t3.mid AS m3,
       CASE WHEN f.last_ns < f.ts_ns + 2700000000000 THEN 'unmatured_at_end' WHEN t1.mid IS NULL OR t2.mid IS NULL OR t3.mid IS NULL THEN 'missing_target'
            WHEN t1.block <> f.block OR t2.block <> f.block OR t3.block <> f.block THEN 'crossed_gap_or_session' ELSE 'matured' END AS status
FROM fl f LEFT JOIN fq t1 ON t1.file_date = f.file_date AND t1.ts_ns = f.ts_ns + 300000000000
LEFT JOIN fq t2 ON t2.file_date = f.file_date AND t2.ts_ns = f.ts_ns + 900000000000
LEFT JOIN fq t3 ON t3.file_date = f.file_date AND t3.ts_ns = f.ts_ns + 2700000000000""")
cte("sc", """
SELECT *, cost_usd / 50.0 AS cost_price, raw_score - cost_usd / 50.0 AS score
FROM (SELECT *, CASE WHEN status = 'matured' THEN side * (m1 - mid) END AS u1, CASE WHEN status = 'matured' THEN side * (m2 - mid) END AS u2,
             CASE WHEN status = 'matured' THEN side * (m3 - mid) END AS u3,
             CASE WHEN status = 'matured' THEN side * (m1 - mid) * 0.5::DOUBLE + side * (m2 - mid) * 0.3::DOUBLE + side * (m3 - mid) * 0.2::DOUBLE END AS raw_score FROM mk)""")


def u_columns(df, *keep):
    return rounded_all(df.select(*keep, *[F.get("u", F.lit(i)).alias(f"u{i + 1}") for i in range(len(HORIZONS))]))


U = "round(u1, 6) + 0.0 AS u1, round(u2, 6) + 0.0 AS u2, round(u3, 6) + 0.0 AS u3"


@query("r01_fill_markout", f"SELECT strategy, seq, status, {U} FROM sc")
def r01(spark, sf):
    return u_columns(Day(spark, sf).marked, "strategy", "seq", "status")


@query("r02_signal_markout", """
SELECT model_id, ts_ns, side, status, CASE WHEN status = 'matured' THEN round(side * (m1 - mid), 6) + 0.0 END AS u1,
       CASE WHEN status = 'matured' THEN round(side * (m2 - mid), 6) + 0.0 END AS u2, CASE WHEN status = 'matured' THEN round(side * (m3 - mid), 6) + 0.0 END AS u3
FROM (SELECT p.*, f.mid, t1.mid AS m1, t2.mid AS m2, t3.mid AS m3,
             CASE WHEN f.last_ns < f.ts_ns + 2700000000000 THEN 'unmatured_at_end' WHEN t1.mid IS NULL OR t2.mid IS NULL OR t3.mid IS NULL THEN 'missing_target'
                  WHEN t1.block <> f.block OR t2.block <> f.block OR t3.block <> f.block THEN 'crossed_gap_or_session' ELSE 'matured' END AS status
      FROM (SELECT file_date, ts_ns, model_id, CASE WHEN yhat > 1.5e-5 THEN 1 WHEN yhat < -1.5e-5 THEN -1 ELSE 0 END AS side FROM pred WHERE yhat IS NOT NULL) p
      JOIN fq f ON f.ts_ns = p.ts_ns AND f.file_date = p.file_date
      LEFT JOIN fq t1 ON t1.file_date = f.file_date AND t1.ts_ns = f.ts_ns + 300000000000
      LEFT JOIN fq t2 ON t2.file_date = f.file_date AND t2.ts_ns = f.ts_ns + 900000000000
      LEFT JOIN fq t3 ON t3.file_date = f.file_date AND t3.ts_ns = f.ts_ns + 2700000000000)""")
def r02(spark, sf):
    signals = learning.predictions(spark, sf).where("yhat is not null").select(
        "instrument_id", "file_date", "ts_ns", "model_id", md.direction(F.col("yhat"), STUDY.threshold).alias("side"))
    rows = signals.join(Day(spark, sf).quotes, ["instrument_id", "file_date", "ts_ns"])
    return u_columns(rw.markout(rows, HORIZONS), "model_id", "ts_ns", "side", "status")


@query("r03_maturity", "SELECT strategy, status, count(*) AS fills FROM mk GROUP BY ALL")
def r03(spark, sf):
    rows = Day(spark, sf).orders.withColumn("status", rw.maturity(HORIZONS))
    return rows.groupBy("strategy", "status").agg(F.count(F.lit(1)).alias("fills"))


@query("r04_weighted_score", "SELECT strategy, seq, round(raw_score, 6) + 0.0 AS raw_score FROM sc")
def r04(spark, sf):
    return rounded_all(rw.score(Day(spark, sf).marked, WEIGHTS).select("strategy", "seq", "raw_score"))


@query("r05_friction_score", "SELECT strategy, seq, round(raw_score, 6) + 0.0 AS raw_score, round(cost_price, 6) + 0.0 AS cost_price, round(score, 6) + 0.0 AS score FROM sc")
def r05(spark, sf):
    return rounded_all(Day(spark, sf).scored.select("strategy", "seq", "raw_score", "cost_price", "score"))


cte("wts", """
SELECT strategy, h.horizon_ms, CASE h.horizon_ms WHEN 300000 THEN a1 WHEN 900000 THEN a2 ELSE a3 END / (a1 + a2 + a3) * CASE WHEN strategy = 'S2' THEN 1.1 ELSE 1.0 END AS weight
FROM (SELECT strategy, sum(abs(u1)) AS a1, sum(abs(u2)) AS a2, sum(abs(u3)) AS a3 FROM sc GROUP BY 1) CROSS JOIN (VALUES (300000), (900000), (2700000)) h(horizon_ms)
WHERE NOT (strategy = 'S1' AND h.horizon_ms = 900000)""")


@query("r06_weight_audit", """
SELECT strategy, CASE WHEN count(*) <> 3 THEN 'wrong_length' ELSE 'sum_not_one' END AS rule, round(sum(weight), 6) + 0.0 AS total
FROM wts GROUP BY 1 HAVING count(*) <> 3 OR abs(sum(weight) - 1) > 1e-8""")
def r06(spark, sf):
    return weight_audit(Day(spark, sf).marked)


def weight_audit(marked):
    """Weights from each strategy's absolute markouts, audited; one set loses a horizon, one is scaled."""
    size = marked.groupBy("strategy").agg(
        *[F.sum(F.abs(F.get("u", F.lit(i)))).alias(f"a{i}") for i in range(3)])
    whole = F.col("a0") + F.col("a1") + F.col("a2")
    # markouts that are all zero leave 0 / 0, which is NaN in SQL and an error in Spark
    share = lambda i: F.when(whole == 0, F.lit(float("nan"))).otherwise(F.col(f"a{i}") / whole)
    sets = F.array(*[F.struct(F.lit(h).cast("bigint").alias("horizon_ms"), share(i).alias("weight")) for i, h in enumerate(HORIZONS)])
    long = size.select("strategy", F.inline(sets)).where("not (strategy = 'S1' and horizon_ms = 900000)")
    long = long.withColumn("weight", F.col("weight") * F.when(F.col("strategy") == "S2", 1.1).otherwise(1.0))
    rows = rw.audit_weights(long, ["strategy"], len(HORIZONS))
    # the SQL has one rule for a total that is not one and one that is no number
    return rounded_all(rows.withColumn("rule", F.when(F.col("rule") == "not_finite", "sum_not_one").otherwise(F.col("rule"))))


cte("expect", """
SELECT strategy, file_date, count(*) FILTER (WHERE status = 'matured') AS matured, count(*) FILTER (WHERE status = 'matured') > 0 AS defined,
       coalesce(avg(u1), 0.0) AS mu1, coalesce(avg(u2), 0.0) AS mu2, coalesce(avg(u3), 0.0) AS mu3 FROM sc GROUP BY 1, 2""")


def mu_columns(df, *keep):
    return rounded_all(df.select(*keep, *[F.get("mu", F.lit(i)).alias(f"mu{i + 1}") for i in range(3)]))


MU = "round(mu1, 6) + 0.0 AS mu1, round(mu2, 6) + 0.0 AS mu2, round(mu3, 6) + 0.0 AS mu3"


@query("r07_expectation", f"SELECT strategy, file_date, matured, defined, {MU} FROM expect")
def r07(spark, sf):
    return mu_columns(rw.expectation(Day(spark, sf).marked, ACCOUNT, HORIZONS), "strategy", "file_date", "matured", "defined")


AUDIT = ["raw_sum", "cost_sum", "cost_usd_sum", "adjusted_sum", "raw_mean", "cost_mean", "adjusted_mean"]


@query("r08_friction_audit", f"""
SELECT strategy, file_date, matured_fills, {', '.join(f'round({c}, 6) + 0.0 AS {c}' for c in AUDIT)},
       abs(raw_sum - cost_sum - adjusted_sum) <= 1e-7 AND abs(cost_usd_sum / 50.0 - cost_sum) <= 1e-7 AS balanced
FROM (SELECT strategy, file_date, count(*) AS matured_fills, sum(raw_score) AS raw_sum, sum(cost_price) AS cost_sum, sum(cost_usd) AS cost_usd_sum, sum(score) AS adjusted_sum,
             avg(raw_score) AS raw_mean, avg(cost_price) AS cost_mean, avg(score) AS adjusted_mean FROM sc WHERE status = 'matured' GROUP BY 1, 2)
UNION ALL SELECT strategy, file_date, 0, 0.0, 0.0, 0.0, 0.0, NULL, NULL, NULL, true FROM expect WHERE NOT defined""")
def r08(spark, sf):
    return rounded_all(rw.friction_audit(Day(spark, sf).scored, ACCOUNT, CONTRACT).drop("instrument_id"))


cte("sel", """
SELECT 'S' || s AS strategy, file_date, period_index, CAST((period_index + day(CAST(file_date AS DATE))) % 3 AS INT) AS owner, 'w' || weekofyear(CAST(file_date AS DATE)) AS version_id, selected_at_ns
FROM (SELECT file_date, (ts_ns % 86400000000000) // 1800000000000 AS period_index, min(ts_ns) AS selected_at_ns FROM snapshot GROUP BY 1, 2) CROSS JOIN range(4) r(s)""")
cte("bucket", """
SELECT strategy, file_date, version_id, period_index, CAST(owner AS INT) AS owner, coalesce(selected, false) AS selected, coalesce(orders, 0) AS orders, coalesce(pending, 0) AS pending, coalesce(matured, 0) AS matured,
       coalesce(missing_target, 0) AS missing_target, coalesce(crossed_gap_or_session, 0) AS crossed_gap_or_session, coalesce(reward_sum, 0.0) AS reward_sum, last_origin_ns
FROM (SELECT strategy, file_date, version_id, period_index, owner, true AS selected FROM sel)
FULL JOIN (SELECT strategy, file_date, version_id, (ts_ns % 86400000000000) // 1800000000000 AS period_index, owner, count(*) AS orders, count(*) FILTER (WHERE status = 'unmatured_at_end') AS pending,
                  count(*) FILTER (WHERE status = 'matured') AS matured, count(*) FILTER (WHERE status = 'missing_target') AS missing_target,
                  count(*) FILTER (WHERE status = 'crossed_gap_or_session') AS crossed_gap_or_session, sum(score) AS reward_sum, max(ts_ns) AS last_origin_ns FROM sc GROUP BY ALL)
USING (strategy, file_date, version_id, period_index, owner)""")


@query("r09_period_buckets", "SELECT * REPLACE (round(reward_sum, 6) + 0.0 AS reward_sum) FROM bucket")
def r09(spark, sf):
    return rounded_all(Day(spark, sf).buckets.drop("instrument_id"))


cte("fb", """
SELECT b.strategy, b.file_date, version_id, period_index, owner, end_ns, due_ns, coalesce(q.ts_ns, l.last_ns) AS observed_at_ns, orders, pending, matured, missing_target, crossed_gap_or_session, reward_sum, last_origin_ns, selected,
       CASE WHEN coalesce(q.ts_ns, l.last_ns) < end_ns THEN 'incomplete_period' WHEN pending > 0 THEN 'pending_orders' WHEN orders = 0 THEN 'no_orders'
            WHEN matured <> orders THEN 'incomplete_orders' ELSE 'matured' END AS status
FROM (SELECT *, greatest(end_ns, coalesce(last_origin_ns + 2700000000000, end_ns)) AS due_ns
      FROM (SELECT *, epoch_us(CAST(file_date AS TIMESTAMP)) * 1000 + (period_index + 1) * 1800000000000 AS end_ns FROM bucket)) b
ASOF LEFT JOIN (SELECT file_date, ts_ns FROM fq) q ON q.file_date = b.file_date AND q.ts_ns >= b.due_ns
JOIN (SELECT DISTINCT file_date, last_ns FROM fq) l ON l.file_date = b.file_date""")
cte("fbr", "SELECT *, CASE WHEN status = 'matured' THEN reward_sum / orders END AS reward FROM fb")


@query("r10_period_feedback", "SELECT strategy, file_date, version_id, period_index, owner, observed_at_ns, status, round(reward, 6) + 0.0 AS reward FROM fbr")
def r10(spark, sf):
    return rounded_all(Day(spark, sf).feedback.select("strategy", "file_date", "version_id", "period_index", "owner", "observed_at_ns", "status", "reward"))


cte("arms", """
SELECT s.strategy, s.file_date, s.version_id, s.period_index, s.selected_at_ns, s.owner, a.arm,
       (SELECT count(*) FROM sel x WHERE x.strategy = s.strategy AND x.file_date = s.file_date AND x.owner = a.arm AND x.selected_at_ns < s.selected_at_ns) AS visits,
       (SELECT count(*) FROM fbr x WHERE x.strategy = s.strategy AND x.file_date = s.file_date AND x.owner = a.arm AND x.reward IS NOT NULL AND x.observed_at_ns <= s.selected_at_ns) AS feedback,
       coalesce((SELECT sum(reward) FROM fbr x WHERE x.strategy = s.strategy AND x.file_date = s.file_date AND x.owner = a.arm AND x.reward IS NOT NULL AND x.observed_at_ns <= s.selected_at_ns), 0.0) AS reward_sum
FROM sel s CROSS JOIN (SELECT CAST(range AS INT) AS arm FROM range(3)) a""")


@query("r11_arm_stats", "SELECT * REPLACE (round(reward_sum, 6) + 0.0 AS reward_sum) FROM arms")
def r11(spark, sf):
    return rounded_all(Day(spark, sf).arms.drop("instrument_id"))


@query("r12_ucb_scores", """
SELECT strategy, file_date, period_index, arm, visits, round(score, 6) + 0.0 AS score, best_arm, arm = best_arm AS is_best, owner = best_arm AS agrees
FROM (SELECT *, min(CASE WHEN key = top THEN arm END) OVER (PARTITION BY strategy, file_date, selected_at_ns) AS best_arm
      FROM (SELECT *, max(key) OVER (PARTITION BY strategy, file_date, selected_at_ns) AS top
            FROM (SELECT *, coalesce(score, CAST('inf' AS DOUBLE)) AS key
                  FROM (SELECT *, CASE WHEN visits > 0 THEN reward_sum / greatest(feedback, 1) + sqrt(2 * ln(greatest(total, 1)) / visits) END AS score
                        FROM (SELECT *, sum(visits) OVER (PARTITION BY strategy, file_date, selected_at_ns) AS total FROM arms)))))""")
def r12(spark, sf):
    rows = rw.ucb_scores(Day(spark, sf).arms, STUDY.exploration)
    return rounded_all(rows.select("strategy", "file_date", "period_index", "arm", "visits", "score", "best_arm", "is_best", "agrees"))


@query("r13_round_robin", """
SELECT strategy, file_date, period_index, CAST((row_number() OVER (PARTITION BY strategy, file_date ORDER BY selected_at_ns) - 1) % 3 AS INT) AS rotation_arm FROM sel""")
def r13(spark, sf):
    return rw.round_robin(Day(spark, sf).selections, ARMS).select("strategy", "file_date", "period_index", F.col("rotation_arm").cast("int").alias("rotation_arm"))


@query("r14_arm_summary", """
SELECT v.version_id, a.owner, coalesce(visits, 0) AS visits, coalesce(feedback, 0) AS feedback, round(mean_reward, 6) + 0.0 AS mean_reward
FROM (SELECT DISTINCT version_id FROM sel) v CROSS JOIN (SELECT CAST(range AS INT) AS owner FROM range(3)) a
LEFT JOIN (SELECT version_id, owner, count(*) AS visits FROM sel GROUP BY 1, 2) s ON s.version_id = v.version_id AND s.owner = a.owner
LEFT JOIN (SELECT version_id, owner, count(*) AS feedback, avg(reward) AS mean_reward FROM fbr WHERE reward IS NOT NULL GROUP BY 1, 2) f ON f.version_id = v.version_id AND f.owner = a.owner""")
def r14(spark, sf):
    day = Day(spark, sf)
    return rounded_all(rw.arm_summary(day.selections, settle(day.feedback), ARMS))


@query("k11_version_audit", """
SELECT version_id, (SELECT count(*) FROM sel x WHERE x.version_id = v.version_id) AS decisions, count(seq) AS fills, count(*) FILTER (WHERE status = 'matured') AS oe_matured,
       count(*) FILTER (WHERE status = 'missing_target') AS oe_missing_target, count(*) FILTER (WHERE status = 'crossed_gap_or_session') AS oe_crossed_gap_or_session,
       count(*) FILTER (WHERE status = 'unmatured_at_end') AS oe_unmatured_at_end
FROM (SELECT DISTINCT version_id FROM sel) v LEFT JOIN mk USING (version_id) GROUP BY 1""")
def k11(spark, sf):
    day = Day(spark, sf)
    return lg.version_audit(day.selections, day.marked)


@query("k12_selection_distribution", """
SELECT owner, count(s.owner2) AS decisions, round(count(s.owner2) / CAST((SELECT count(*) FROM sel) AS DOUBLE), 6) + 0.0 AS share
FROM (SELECT CAST(range AS INT) AS owner FROM range(4)) m LEFT JOIN (SELECT owner AS owner2 FROM sel) s ON s.owner2 = m.owner GROUP BY 1""")
def k12(spark, sf):
    models = inline(spark, "owner", [(i,) for i in range(4)])
    return rounded_all(lg.selection_distribution(Day(spark, sf).selections, models))
