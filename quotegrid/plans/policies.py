"""Queries over daily results: pooling, qualification, gating, comparison, reconciliation."""

from __future__ import annotations

from pyspark.sql import functions as F

from quotegrid.operators import ledger as lg
from quotegrid.operators import models as md
from quotegrid.operators import policy as po
from quotegrid.operators import rewards as rw
from quotegrid.plans import learning
from quotegrid.plans.prepare import AGES, fresh_path
from quotegrid.plans.registry import cte, query
from quotegrid.plans.study import HORIZONS
from quotegrid.plans.trading import ACCOUNT, DAYSUM, LONGEST, Day, inline, mu_columns, rounded_all
from quotegrid.session import settle
from quotegrid.sources import tables as src
from quotegrid.sources.bindings import STUDY

H = len(HORIZONS)
FIT_WEIGHTS = (1.2, -0.4, 0.2)
PHASE = "CASE WHEN file_date <= '2024-01-10' THEN 'calibration' WHEN file_date <= '2024-01-20' THEN 'validation' ELSE 'test' END"
KEYS = ["strategy", "file_date"]


def daily(day):
    """Executed strategy days plus cash."""
    unmatured = day.marked.groupBy(*ACCOUNT).agg(F.count_if(F.col("status") == "unmatured_at_end").alias("unmatured"))
    money = day.summaries.join(rw.expectation(day.marked, ACCOUNT, HORIZONS), ACCOUNT).join(unmatured, ACCOUNT)
    columns = ["strategy", "file_date", "total_fills", "total_trades", *po.MONEY, "settled", "matured", "unmatured", "mu"]
    zero = lambda kind: F.lit(0).cast(kind)
    cash = day.quotes.select("file_date").distinct().select(
        F.lit("cash").alias("strategy"), "file_date", *[zero("bigint").alias(c) for c in ("total_fills", "total_trades")],
        *[zero("double").alias(c) for c in po.MONEY], F.lit(True).alias("settled"), zero("bigint").alias("matured"), zero("bigint").alias("unmatured"),
        F.array(*[F.lit(0.0)] * H).alias("mu"))
    return money.select(*columns).unionByName(cash)


def with_gated(day):
    dates = day.quotes.select("file_date").distinct().select(F.lit("S9").alias("strategy"), "file_date")
    return po.with_blocked(daily(day), dates)


_money = ", ".join(po.MONEY)
cte("daily", f"""
SELECT d.strategy, d.file_date, total_fills, total_trades, {_money}, settled, matured, unmatured, mu1, mu2, mu3
FROM daysum d JOIN expect USING (strategy, file_date)
JOIN (SELECT strategy, file_date, count(*) FILTER (WHERE status = 'unmatured_at_end') AS unmatured FROM mk GROUP BY 1, 2) u USING (strategy, file_date)
UNION ALL SELECT 'cash', file_date, 0, 0, 0.0, 0.0, 0.0, true, 0, 0, 0.0, 0.0, 0.0 FROM (SELECT DISTINCT file_date FROM fq)""")
cte("dailyb", """
SELECT *, 'executed' AS run_status FROM daily
UNION ALL SELECT 'S9', file_date, NULL, NULL, NULL, NULL, NULL, false, NULL, NULL, NULL, NULL, NULL, 'blocked' FROM (SELECT DISTINCT file_date FROM fq)""")
_total = """
count(*) AS sessions, CAST(sum(total_trades) AS BIGINT) AS total_trades, CAST(sum(total_fills) AS BIGINT) AS total_fills, bool_and(settled) AS pnl_defined,
sum(friction_usd) AS friction_usd, coalesce(string_agg(CASE WHEN NOT settled THEN file_date END, ',' ORDER BY file_date), '') AS unsettled_days,
CAST(sum(matured) AS BIGINT) AS matured, CAST(sum(unmatured) AS BIGINT) AS unmatured,
CASE WHEN bool_and(settled) THEN sum(gross_pnl_usd) END AS gross_pnl_usd, CASE WHEN bool_and(settled) THEN sum(net_pnl_usd) END AS net_pnl_usd"""
cte("totals", f"SELECT strategy, {_total} FROM dailyb GROUP BY 1")
_r = ", ".join(f"round({c}, 6) + 0.0 AS {c}" for c in po.MONEY)


@query("s10_result_sink", f"SELECT {DAYSUM} FROM daysum")
def s10(spark, sf):
    path = fresh_path(spark, "results")
    src.write_results(Day(spark, sf).summaries, path)
    return rounded_all(spark.read.parquet(path).drop("instrument_id"))


cte("grid", """
SELECT 'cash' AS policy_id, NULL AS m, 1.5e-5::DOUBLE AS threshold, 0 AS idx
UNION ALL SELECT 'm0-x' || x, 0, 1.5e-5::DOUBLE * x, i FROM (VALUES (1, 1), (2, 2), (4, 3)) t(x, i)
UNION ALL SELECT 'm' || model_id, model_id, 1.5e-5::DOUBLE, row_number() OVER (ORDER BY model_id) + 3 FROM (SELECT DISTINCT model_id FROM pred)""")


@query("p01_policy_grid", """
SELECT policy_id, idx, round(threshold * 1e5, 6) + 0.0 AS threshold, count(*) FILTER (WHERE abs(yhat) > threshold) AS trades
FROM grid LEFT JOIN pred ON pred.model_id = grid.m GROUP BY ALL""")
def p01(spark, sf):
    signals = settle(learning.predictions(spark, sf).withColumn("model_id", F.concat(F.lit("m"), "model_id")), "signals")
    policies = po.policy_grid(signals.select("model_id").distinct(), STUDY.threshold, STUDY.threshold_multipliers, "m0")
    rows = policies.join(signals, "model_id", "left")
    hits = F.count_if(F.coalesce(md.direction(F.col("yhat"), F.col("threshold")) != 0, F.lit(False)))
    return rounded_all(rows.groupBy("policy_id", "idx", (F.col("threshold") * 1e5).alias("threshold")).agg(hits.alias("trades")))


@query("p02_cross_day_summary", f"SELECT * REPLACE ({_r}) FROM totals")
def p02(spark, sf):
    return rounded_all(po.summarize_days(with_gated(Day(spark, sf)), ["strategy"]))


_pool = ("CAST(sum(matured) AS BIGINT) AS matured, " + ", ".join(f"CASE WHEN sum(matured) > 0 THEN sum(mu{i} * matured) / sum(matured) END AS mu{i}" for i in (1, 2, 3))
         + ", CASE WHEN sum(total_fills) > 0 THEN sum(matured) / CAST(sum(total_fills) AS DOUBLE) END AS matured_fraction")


@query("p03_pooled_expectation", f"""
SELECT strategy, matured, round(mu1, 6) + 0.0 AS mu1, round(mu2, 6) + 0.0 AS mu2, round(mu3, 6) + 0.0 AS mu3, round(matured_fraction, 6) + 0.0 AS matured_fraction
FROM (SELECT strategy, {_pool} FROM dailyb GROUP BY 1)""")
def p03(spark, sf):
    rows = po.pooled_expectation(with_gated(Day(spark, sf)), ["strategy"], H)
    return mu_columns(rows, "strategy", "matured", "matured_fraction")


# Policies: cash, each strategy over the days it ended flat, one over all its days, one gated.
ORDER = {"cash": 0, "S0": 1, "S1": 2, "S2": 3, "S3": 4, "S1-all": 5, "S9": 6}
_idx = "CASE policy_id " + " ".join(f"WHEN '{p}' THEN {i}" for p, i in ORDER.items()) + " END"
cte("pdaily", """
SELECT strategy AS policy_id, * FROM dailyb WHERE strategy IN ('cash', 'S9') OR settled
UNION ALL SELECT 'S1-all', * FROM dailyb WHERE strategy = 'S1'""")
cte("pstat", f"""
SELECT *, {_idx} AS idx, policy_id = 'cash' AS cash,
       CASE WHEN NOT pnl_defined THEN 'unsettled_account' WHEN policy_id <> 'cash' AND coalesce(matured, 0) < 1 THEN 'insufficient_matured_orders' END AS exclusion
FROM (SELECT policy_id, {_total} FROM pdaily GROUP BY 1) JOIN (SELECT policy_id, {_pool.split(', ', 1)[1]} FROM pdaily GROUP BY 1) USING (policy_id)""")


def policy_stats(day):
    rows = with_gated(day)
    flat = rows.where(F.col("strategy").isin("cash", "S9") | F.col("settled")).withColumn("policy_id", F.col("strategy"))
    rows = flat.unionByName(rows.where("strategy = 'S1'").withColumn("policy_id", F.lit("S1-all")))
    stats = po.summarize_days(rows, ["policy_id"]).join(po.pooled_expectation(rows, ["policy_id"], H).drop("matured"), "policy_id")
    stats = stats.withColumns({"idx": F.expr(_idx), "cash": F.col("policy_id") == "cash"})
    return settle(po.eligibility(stats, 1), "policies")


def library(spark):
    return inline(spark, "policy_id", [(p,) for p in ("S0", "S1", "S2", "S3", "S9")])


@query("p04_eligibility", "SELECT policy_id, exclusion, matured FROM pstat")
def p04(spark, sf):
    return policy_stats(Day(spark, sf)).select("policy_id", "exclusion", "matured")


cte("expert", """
SELECT policy_id AS selected, net_pnl_usd AS best_score FROM pstat WHERE pnl_defined AND policy_id IN ('S0', 'S1', 'S2', 'S3', 'S9') ORDER BY net_pnl_usd DESC, idx LIMIT 1""")


@query("p05_reference_policy", "SELECT selected, selected AS tied, round(best_score, 6) + 0.0 AS best_score FROM expert")
def p05(spark, sf):
    return rounded_all(po.best_policy(policy_stats(Day(spark, sf)), library(spark), 1e-9))


cte("epool", "SELECT *, CASE WHEN cash THEN 0 ELSE mu1 END AS v1, CASE WHEN cash THEN 0 ELSE mu2 END AS v2, CASE WHEN cash THEN 0 ELSE mu3 END AS v3 FROM pstat WHERE exclusion IS NULL")
cte("qual", """
SELECT CASE WHEN expert IS NULL THEN 'blocked_no_settled_expert' WHEN trading = 0 THEN 'blocked_no_matured_trading_policy'
            WHEN expert NOT IN (SELECT policy_id FROM epool) THEN 'blocked_expert_reward_unobserved' WHEN spread <= 1e-8 THEN 'blocked_uninformative_expectations' ELSE 'qualified' END AS status,
       expert, eligible, trading
FROM (SELECT (SELECT selected FROM expert) AS expert, count(*) AS eligible, count(*) FILTER (WHERE NOT cash) AS trading,
             greatest(max(abs(v1 - f1)), max(abs(v2 - f2)), max(abs(v3 - f3))) AS spread
      FROM epool CROSS JOIN (SELECT arg_min(v1, idx) AS f1, arg_min(v2, idx) AS f2, arg_min(v3, idx) AS f3 FROM epool))""")


def qualified(spark, stats):
    return po.qualify(stats, po.best_policy(stats, library(spark), 1e-9), H, 1e-8)


@query("p06_qualification", "SELECT * FROM qual")
def p06(spark, sf):
    return qualified(spark, policy_stats(Day(spark, sf))).withColumn("eligible", F.col("eligible").cast("bigint"))


@query("p07_policy_scores", """
SELECT policy_id, idx, round(score, 6) + 0.0 AS score, round((v1 + v2 + v3) / 3, 6) + 0.0 AS equal_score, round(top - score, 6) + 0.0 AS margin
FROM (SELECT *, v1 * 1.2 - v2 * 0.4 + v3 * 0.2 AS score, max(CASE WHEN policy_id = (SELECT selected FROM expert) THEN v1 * 1.2 - v2 * 0.4 + v3 * 0.2 END) OVER () AS top FROM epool)""")
def p07(spark, sf):
    stats = policy_stats(Day(spark, sf))
    return rounded_all(po.policy_scores(stats, FIT_WEIGHTS, H, po.best_policy(stats, library(spark), 1e-9)))


@query("p08_gate", """
SELECT status = 'qualified' AND expert IN ('S0', 'S1', 'S2', 'S3', 'S9') AND miss = '' AS usable,
       concat_ws(',', CASE WHEN status <> 'qualified' THEN 'reward_not_fitted' END, CASE WHEN expert NOT IN ('S0', 'S1', 'S2', 'S3', 'S9') THEN 'expert_outside_online_library' END,
                 CASE WHEN miss <> '' THEN 'online_library_incomplete' END) AS reasons, expert, miss AS missing_policies
FROM qual, (SELECT coalesce(string_agg(p, ',' ORDER BY p), '') AS miss FROM (VALUES ('S0'), ('S1'), ('S2'), ('S3'), ('S9')) l(p) WHERE p NOT IN (SELECT policy_id FROM epool))""")
def p08(spark, sf):
    stats = policy_stats(Day(spark, sf))
    return po.gate(qualified(spark, stats), library(spark), stats)


@query("p09_blocked_rows", f"SELECT strategy, file_date, run_status, total_fills, settled, {_r} FROM dailyb")
def p09(spark, sf):
    return rounded_all(with_gated(Day(spark, sf)).select("strategy", "file_date", "run_status", "total_fills", "settled", *po.MONEY))


cte("aged", f"""
SELECT {PHASE} AS phase, a.age AS max_age_ms, strategy, count(*) AS total_fills, coalesce(sum(realised_usd), 0.0) AS gross_pnl_usd, sum(cost_usd) AS friction_usd,
       coalesce(sum(realised_usd), 0.0) - sum(cost_usd) AS net_pnl_usd, 'executed' AS run_status
FROM fl JOIN (VALUES (60000), (300000), (1200000)) a(age) ON ts_ns - recv_ns <= a.age * CAST(1000000 AS BIGINT) WHERE NOT (strategy = 'S3' AND a.age = 60000) GROUP BY ALL
UNION ALL SELECT phase, 60000, 'S3', NULL, NULL, NULL, NULL, 'blocked' FROM (VALUES ('calibration'), ('validation'), ('test')) p(phase)""")


def aged(day):
    """Money per phase, age bound (time from order to quote) and strategy; one strategy is gated at one age."""
    rows = day.fills.withColumn("age_ms", (F.col("ts_ns") - F.col("recv_ns")) / 1_000_000)
    ages = F.array(*[F.lit(a) for a in AGES])
    rows = rows.withColumns({"phase": F.expr(PHASE), "max_age_ms": F.explode(F.filter(ages, lambda a: F.col("age_ms") <= a))})
    gross, cost = F.coalesce(F.sum("realised_usd"), F.lit(0.0)), F.sum("cost_usd")
    gated = (F.col("strategy") == "S3") & (F.col("max_age_ms") == AGES[0])
    money = rows.where(~gated).groupBy("phase", "max_age_ms", "strategy").agg(
        F.count(F.lit(1)).alias("total_fills"), gross.alias("gross_pnl_usd"), cost.alias("friction_usd"), (gross - cost).alias("net_pnl_usd"))
    shut = rows.select("phase").distinct().select("phase", F.lit(AGES[0]).alias("max_age_ms"), F.lit("S3").alias("strategy"))
    return settle(po.with_blocked(money, shut), "aged")


@query("p10_paired_difference", """
SELECT t.phase, t.max_age_ms, round(t.gross_pnl_usd - c.gross_pnl_usd, 6) + 0.0 AS gross_pnl_usd_diff, round(t.friction_usd - c.friction_usd, 6) + 0.0 AS friction_usd_diff,
       round(t.net_pnl_usd - c.net_pnl_usd, 6) + 0.0 AS net_pnl_usd_diff, t.total_fills - c.total_fills AS total_fills_diff
FROM aged t JOIN aged c ON c.phase = t.phase AND c.max_age_ms = t.max_age_ms WHERE t.strategy = 'S3' AND c.strategy = 'S0'""")
def p10(spark, sf):
    return rounded_all(po.paired_diff(aged(Day(spark, sf)), ["phase", "max_age_ms"], "S3", "S0", [*po.MONEY, "total_fills"]))


@query("p11_pivot_ages", "SELECT strategy, phase, " + ", ".join(
    f"round(max(net_pnl_usd) FILTER (WHERE max_age_ms = {a}), 6) + 0.0 AS net_pnl_usd_{a}ms" for a in AGES) + " FROM aged GROUP BY 1, 2")
def p11(spark, sf):
    return rounded_all(po.pivot_ages(aged(Day(spark, sf)), ["strategy", "phase"], AGES, "net_pnl_usd"))


@query("p12_comparison", """
SELECT t.max_age_ms, round(c.net_pnl_usd, 6) + 0.0 AS control_net, round(t.net_pnl_usd, 6) + 0.0 AS treatment_net, round(t.gross_pnl_usd - c.gross_pnl_usd, 6) + 0.0 AS gross_pnl_usd_diff,
       round(t.friction_usd - c.friction_usd, 6) + 0.0 AS friction_usd_diff, round(t.net_pnl_usd - c.net_pnl_usd, 6) + 0.0 AS net_pnl_usd_diff, t.total_fills - c.total_fills AS total_fills_diff
FROM aged t JOIN aged c ON c.phase = t.phase AND c.max_age_ms = t.max_age_ms WHERE t.strategy = 'S3' AND c.strategy = 'S1' AND t.phase = 'test'""")
def p12(spark, sf):
    return rounded_all(po.comparison(aged(Day(spark, sf)), "test", "S3", "S1"))


cte("bent", "SELECT * REPLACE (net_pnl_usd + CASE WHEN file_date = '2024-01-07' THEN 1 ELSE 0 END AS net_pnl_usd) FROM daysum")


@query("p13_ledger_conservation", """
SELECT 'net_identity' AS rule, strategy || ' ' || file_date AS item FROM bent WHERE abs(gross_pnl_usd - friction_usd - net_pnl_usd) > 1e-6
UNION ALL SELECT 'trades_to_day', b.strategy || ' ' || b.file_date FROM bent b LEFT JOIN (SELECT strategy, file_date, sum(net_pnl_usd) AS n FROM trade GROUP BY 1, 2) t USING (strategy, file_date)
  WHERE settled AND abs(coalesce(n, 0) - net_pnl_usd) > 1e-6
UNION ALL SELECT 'days_to_total', strategy FROM (SELECT strategy, sum(friction_usd) AS f FROM bent GROUP BY 1) JOIN totals USING (strategy)
  WHERE abs(f - totals.friction_usd - CASE WHEN strategy = 'S2' THEN 1 ELSE 0 END) > 1e-6
UNION ALL SELECT 'period_orders', b.strategy || ' ' || b.file_date FROM bent b LEFT JOIN (SELECT strategy, file_date, sum(orders) AS o FROM bucket WHERE period_index <> 20 GROUP BY 1, 2) k USING (strategy, file_date)
  WHERE coalesce(o, 0) <> total_fills""")
def p13(spark, sf):
    # One day's net, one total and one period are wrong on purpose.
    day = Day(spark, sf)
    rows = settle(day.summaries, "daily")
    bent = rows.withColumn("net_pnl_usd", F.col("net_pnl_usd") + F.when(F.col("file_date") == "2024-01-07", 1.0).otherwise(0.0))
    total = rows.groupBy("strategy").agg((F.sum("friction_usd") + F.max(F.when(F.col("strategy") == "S2", 1.0).otherwise(0.0))).alias("friction_usd"))
    return po.audit_ledger(bent, lg.pair_trades(day.fills, ACCOUNT), total, day.buckets.where("period_index <> 20"), KEYS)


@query("p14_reward_conservation", """
SELECT strategy, file_date, period_index, owner, rule
FROM (SELECT *, CASE WHEN orders <> pending + matured + missing_target + crossed_gap_or_session THEN 'orders_lost' WHEN reward IS NOT NULL AND (matured <> orders OR pending <> 0) THEN 'subset_reported'
                     WHEN reward IS NOT NULL AND observed_at_ns < due_ns THEN 'reported_early' WHEN reward IS NOT NULL AND abs(reward * orders - reward_sum) > 1e-7 THEN 'reward_sum'
                     WHEN reward IS NULL AND status = 'matured' THEN 'matured_not_reported' END AS rule
      FROM (SELECT * REPLACE (CASE WHEN period_index % 7 = 1 THEN due_ns - 1 ELSE observed_at_ns END AS observed_at_ns, orders + CASE WHEN period_index % 7 = 2 THEN 1 ELSE 0 END AS orders,
                              CASE WHEN period_index % 7 = 3 THEN coalesce(reward, 0.0) ELSE reward END AS reward) FROM fbr))
WHERE rule IS NOT NULL""")
def p14(spark, sf):
    slot = F.col("period_index") % 7
    rows = Day(spark, sf).feedback.withColumns({
        "observed_at_ns": F.when(slot == 1, F.col("due_ns") - 1).otherwise(F.col("observed_at_ns")),
        "orders": F.col("orders") + F.when(slot == 2, 1).otherwise(0), "reward": F.when(slot == 3, F.coalesce("reward", F.lit(0.0))).otherwise(F.col("reward"))})
    return po.audit_periods(rows, LONGEST).select("strategy", "file_date", "period_index", "owner", "rule")


@query("p15_summary_reconciliation", """
SELECT strategy, CASE WHEN strategy = 'cash' THEN 'missing_in_summary'
                      WHEN strategy = 'S2' THEN 'total_fills' WHEN strategy = 'S9' THEN 'net_pnl_usd' END AS fields FROM totals WHERE strategy IN ('cash', 'S2', 'S9')""")
def p15(spark, sf):
    # The summary loses cash, miscounts one strategy and shows blocked money as zero.
    source = settle(po.summarize_days(with_gated(Day(spark, sf)), ["strategy"]), "totals")
    s = F.col("strategy")
    summary = source.where(s != "cash").withColumns({
        "total_fills": F.col("total_fills") + F.when(s == "S2", 1).otherwise(0), "net_pnl_usd": F.when(s == "S9", 0.0).otherwise(F.col("net_pnl_usd"))})
    return po.reconcile(summary, source, ["strategy"], ["total_fills", "matured", *po.MONEY])


@query("p16_status_rollup", """
SELECT phase, max_age_ms, grouping(phase, max_age_ms) AS level, count(*) FILTER (WHERE run_status = 'executed') AS executed, count(*) FILTER (WHERE run_status = 'blocked') AS blocked
FROM aged GROUP BY ROLLUP (phase, max_age_ms)""")
def p16(spark, sf):
    return po.status_rollup(aged(Day(spark, sf)))


@query("w11_rank_with_ties", """
SELECT file_date, arg_min(strategy, strategy) AS selected, string_agg(strategy, ',' ORDER BY strategy) AS tied, round(any_value(top), 6) + 0.0 AS best_score
FROM (SELECT *, max(net_pnl_usd) OVER (PARTITION BY file_date) AS top FROM daily) WHERE top - net_pnl_usd <= 500 GROUP BY 1""")
def w11(spark, sf):
    rows = daily(Day(spark, sf)).withColumn("idx", F.col("strategy"))
    return rounded_all(po.best_with_ties(rows, "net_pnl_usd", 500.0, "strategy", "idx", ["file_date"]))
