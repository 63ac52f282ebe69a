"""Policy statistics, qualification, gating and paired comparison.

Inputs are daily result rows (strategy x day), already tiny next to the quotes
they summarize.  NULL money means not executed or undefined and is never zero.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

MONEY = ["gross_pnl_usd", "friction_usd", "net_pnl_usd"]


def policy_grid(models: DataFrame, threshold: float, multipliers: tuple, reference: str) -> DataFrame:
    """Declared order: cash, the reference model at each threshold multiple, one policy per model."""
    n = len(multipliers)
    head = [F.struct(F.lit("cash").alias("policy_id"), F.lit(None).cast("string").alias("model_id"), F.lit(threshold).alias("threshold"), F.lit(0).alias("idx"))]
    head += [F.struct(F.lit(f"{reference}-x{m}").alias("policy_id"), F.lit(reference).alias("model_id"), F.lit(threshold * m).alias("threshold"),
                      F.lit(i + 1).alias("idx")) for i, m in enumerate(multipliers)]
    fixed = models.sparkSession.range(1).select(F.inline(F.array(*head)))
    order = Window.partitionBy(F.lit(1)).orderBy("model_id")
    library = models.select(F.col("model_id").alias("policy_id"), "model_id", F.lit(threshold).alias("threshold"),
                            (F.row_number().over(order) + n).alias("idx"))
    return fixed.unionByName(library)


def with_blocked(executed: DataFrame, blocked: DataFrame) -> DataFrame:
    """Add rows of gated strategies: keys only, all money NULL, never settled."""
    done = executed.withColumn("run_status", F.lit("executed"))
    rows = blocked.withColumns({"run_status": F.lit("blocked"), "settled": F.lit(False)})
    return done.unionByName(rows, allowMissingColumns=True)


def summarize_days(daily: DataFrame, by: list[str], day: str = "file_date") -> DataFrame:
    """Totals per strategy; gross and net only if every day ended flat, friction always."""
    flat = F.bool_and(F.coalesce("settled", F.lit(False)))
    rows = daily.groupBy(*by).agg(
        F.count(F.lit(1)).alias("sessions"), F.sum("total_trades").alias("total_trades"), F.sum("total_fills").alias("total_fills"),
        flat.alias("pnl_defined"), F.sum("gross_pnl_usd").alias("_gross"), F.sum("friction_usd").alias("friction_usd"), F.sum("net_pnl_usd").alias("_net"),
        F.array_join(F.array_sort(F.collect_list(F.when(~F.coalesce("settled", F.lit(False)), F.col(day)))), ",").alias("unsettled_days"),
        F.sum("matured").alias("matured"), F.sum("unmatured").alias("unmatured"))
    defined = lambda c: F.when(F.col("pnl_defined"), F.col(c))
    return rows.withColumns({"gross_pnl_usd": defined("_gross"), "net_pnl_usd": defined("_net")}).drop("_gross", "_net")


def pooled_expectation(daily: DataFrame, by: list[str], horizons: int) -> DataFrame:
    """Mean markout over all matured orders: days weigh by their matured count."""
    part = lambda i: F.sum(F.get("mu", F.lit(i)) * F.col("matured"))
    rows = daily.groupBy(*by).agg(
        F.sum("matured").alias("matured"), F.sum("total_fills").alias("_fills"), *[part(i).alias(f"_p{i}") for i in range(horizons)])
    mu = F.array(*[F.col(f"_p{i}") / F.col("matured") for i in range(horizons)])
    return rows.select(*by, "matured", F.when(F.col("matured") > 0, mu).alias("mu"),
                       F.when(F.col("_fills") > 0, F.col("matured") / F.col("_fills")).alias("matured_fraction"))


def best_with_ties(rows: DataFrame, value: str, tolerance: float, name: str, order: str, by: list[str] | None = None) -> DataFrame:
    """Best value, every row within tolerance of it, and the first of those in declared order."""
    group = by or []
    top = rows.where(F.col(value).isNotNull()).withColumn("_top", F.max(value).over(Window.partitionBy(*(group or [F.lit(1)]))))
    ties = top.where(F.col("_top") - F.col(value) <= tolerance)
    picked = F.array_sort(F.collect_list(F.struct(F.col(order).alias("o"), F.col(name).alias("n"))))
    out = ties.groupBy(*group).agg(picked.alias("_p"), F.max("_top").alias("best_score"))
    names = F.transform("_p", lambda p: p["n"])
    return out.select(*group, F.get(names, F.lit(0)).alias("selected"), F.array_join(names, ",").alias("tied"), "best_score")


def eligibility(stats: DataFrame, min_matured: int) -> DataFrame:
    """Exclusion reason per policy, NULL when eligible.  Expects pnl_defined, cash, matured."""
    reason = (F.when(~F.col("pnl_defined"), "unsettled_account")
              .when(~F.col("cash") & (F.coalesce("matured", F.lit(0)) < min_matured), "insufficient_matured_orders"))
    return stats.withColumn("exclusion", reason)


def best_policy(stats: DataFrame, allowed: DataFrame, tolerance: float) -> DataFrame:
    """Highest net among settled allowed policies, chosen before any maturity check."""
    pool = stats.where("pnl_defined").join(allowed.select("policy_id").distinct(), "policy_id", "left_semi")
    return best_with_ties(pool, "net_pnl_usd", tolerance, "policy_id", "idx")


def _vectors(stats: DataFrame, horizons: int):
    zero = F.array(*[F.lit(0.0)] * horizons)
    return stats.where("exclusion is null").withColumn("mu", F.when(F.col("cash"), zero).otherwise(F.col("mu")))


def qualify(stats: DataFrame, expert: DataFrame, horizons: int, tolerance: float) -> DataFrame:
    """One status row: may weights be fitted from these policies with this expert?

    ``stats`` comes from ``eligibility`` with pooled ``mu``; ``expert`` from ``best_policy``.
    """
    pool = _vectors(stats, horizons)
    away = F.array_max(F.zip_with("mu", "_first", lambda x, y: F.abs(x - y)))
    # distance from the first eligible vector, a one-row aggregate
    facts = pool.crossJoin(pool.agg(F.min_by("mu", "idx").alias("_first"))).agg(
        F.count_if(~F.col("cash")).alias("trading"), F.max(away).alias("spread"),
        F.collect_set("policy_id").alias("ids"))
    one = facts.withColumn("_j", F.lit(1)).join(expert.select("selected").withColumn("_j", F.lit(1)), "_j", "left")
    status = (F.when(F.col("selected").isNull(), "blocked_no_settled_expert")
              .when(F.col("trading") == 0, "blocked_no_matured_trading_policy")
              .when(~F.array_contains("ids", F.col("selected")), "blocked_expert_reward_unobserved")
              .when(F.col("spread") <= tolerance, "blocked_uninformative_expectations").otherwise("qualified"))
    return one.select(status.alias("status"), F.col("selected").alias("expert"), F.size("ids").alias("eligible"), "trading")


def policy_scores(stats: DataFrame, weights: tuple, horizons: int, expert: DataFrame) -> DataFrame:
    """mu . w per eligible policy, the expert's margin over it, and the equal-weight score."""
    from quotegrid.operators.rewards import dot

    pool = _vectors(stats, horizons).withColumns({"score": dot("mu", weights), "equal_score": dot("mu", (1 / horizons,) * horizons)})
    chosen = pool.join(expert.select(F.col("selected").alias("policy_id")), "policy_id", "left_semi").select(F.col("score").alias("_expert"), F.lit(1).alias("_j"))
    rows = pool.withColumn("_j", F.lit(1)).join(chosen, "_j", "left")
    return rows.select("policy_id", "idx", "score", "equal_score", (F.col("_expert") - F.col("score")).alias("margin"))


def gate(status: DataFrame, library: DataFrame, stats: DataFrame) -> DataFrame:
    """Usable only if fitted, expert in the library, every library policy eligible; else the reasons."""
    missing = library.join(stats.where("exclusion is null"), "policy_id", "left_anti").agg(
        F.count(F.lit(1)).alias("_missing"), F.array_join(F.array_sort(F.collect_list("policy_id")), ",").alias("missing_policies"))
    inside = status.join(library.select(F.col("policy_id").alias("expert")).distinct(), "expert", "left_semi").agg(F.count(F.lit(1)).alias("_in"))
    one = lambda df: df.withColumn("_j", F.lit(1))
    rows = one(status).join(one(missing), "_j").join(one(inside), "_j")
    reasons = F.array_compact(F.array(
        F.when(F.col("status") != "qualified", "reward_not_fitted"), F.when(F.col("_in") == 0, "expert_outside_online_library"),
        F.when(F.col("_missing") > 0, "online_library_incomplete")))
    return rows.select((F.size(reasons) == 0).alias("usable"), F.array_join(reasons, ",").alias("reasons"), "expert", "missing_policies")


def paired_diff(table: DataFrame, by: list[str], treatment: str, control: str, columns: list[str]) -> DataFrame:
    """Treatment minus control per group; NULL if either side is NULL."""
    pick = lambda s, p: table.where(F.col("strategy") == s).select(*by, *[F.col(c).alias(f"{p}{c}") for c in columns])
    both = pick(treatment, "_t_").join(pick(control, "_c_"), by)
    return both.select(*by, *[(F.col(f"_t_{c}") - F.col(f"_c_{c}")).alias(f"{c}_diff") for c in columns])


def pivot_ages(table: DataFrame, by: list[str], ages: list[int], value: str) -> DataFrame:
    """One column per age, NULL kept where nothing ran."""
    return table.groupBy(*by).agg(*[F.max(F.when(F.col("max_age_ms") == a, F.col(value))).alias(f"{value}_{a}ms") for a in ages])


def comparison(table: DataFrame, phase: str, treatment: str, control: str) -> DataFrame:
    """Per age: both nets and the net, gross, friction and fill differences."""
    rows = table.where(F.col("phase") == phase)
    diff = paired_diff(rows, ["max_age_ms"], treatment, control, [*MONEY, "total_fills"])
    net = lambda s, n: rows.where(F.col("strategy") == s).select("max_age_ms", F.col("net_pnl_usd").alias(n))
    return diff.join(net(control, "control_net"), "max_age_ms").join(net(treatment, "treatment_net"), "max_age_ms")


def audit_ledger(daily: DataFrame, trades: DataFrame, totals: DataFrame, buckets: DataFrame, by: list[str], tolerance: float = 1e-6) -> DataFrame:
    """Broken money identities: gross - friction = net, trades add up to settled days,
    days add up to totals, period orders equal fills."""
    off = lambda a, b: F.abs(a - b) > tolerance
    item = F.concat_ws(" ", "strategy", "file_date")
    net = daily.where(off(F.col("gross_pnl_usd") - F.col("friction_usd"), F.col("net_pnl_usd"))).select(F.lit("net_identity").alias("rule"), item.alias("item"))
    summed = trades.groupBy(*by).agg(F.sum("net_pnl_usd").alias("_net"))
    closed = daily.where("settled").join(summed, by, "left")
    trade = closed.where(off(F.coalesce("_net", F.lit(0.0)), F.col("net_pnl_usd"))).select(F.lit("trades_to_day").alias("rule"), item.alias("item"))
    days = daily.groupBy("strategy").agg(F.sum("friction_usd").alias("_f")).join(totals.select("strategy", "friction_usd"), "strategy")
    total = days.where(off(F.col("_f"), F.col("friction_usd"))).select(F.lit("days_to_total").alias("rule"), F.col("strategy").alias("item"))
    orders = buckets.groupBy(*by).agg(F.sum("orders").alias("_o"))
    fills = daily.join(orders, by, "left")
    period = fills.where(F.coalesce("_o", F.lit(0)) != F.col("total_fills")).select(F.lit("period_orders").alias("rule"), item.alias("item"))
    return net.unionByName(trade).unionByName(total).unionByName(period)


def audit_periods(feedback: DataFrame, horizon_ns: int, tolerance: float = 1e-7) -> DataFrame:
    """Buckets that lose orders, report too early, or report from a matured subset."""
    resolved = F.col("pending") + F.col("matured") + F.col("missing_target") + F.col("crossed_gap_or_session")
    deadline = F.greatest(F.col("end_ns"), F.coalesce(F.col("last_origin_ns") + horizon_ns, F.col("end_ns")))
    told = F.col("reward").isNotNull()
    rule = (F.when(F.col("orders") != resolved, "orders_lost")
            .when(told & ((F.col("matured") != F.col("orders")) | (F.col("pending") != 0)), "subset_reported")
            .when(told & (F.col("observed_at_ns") < deadline), "reported_early")
            .when(told & (F.abs(F.col("reward") * F.col("orders") - F.col("reward_sum")) > tolerance), "reward_sum")
            .when(~told & (F.col("status") == "matured"), "matured_not_reported"))
    return feedback.withColumn("rule", rule).where("rule is not null")


def reconcile(summary: DataFrame, source: DataFrame, by: list[str], columns: list[str]) -> DataFrame:
    """Fields of a summary that differ from its source rows, and rows on one side only."""
    a = summary.select(*by, F.struct(*columns).alias("_a"))
    b = source.select(*by, F.struct(*columns).alias("_b"))
    rows = a.join(b, by, "full")
    wrong = [F.when(~F.col(f"_a.{c}").eqNullSafe(F.col(f"_b.{c}")), c) for c in columns]
    fields = (F.when(F.col("_a").isNull(), F.lit("missing_in_summary")).when(F.col("_b").isNull(), F.lit("missing_in_source"))
              .otherwise(F.array_join(F.array_compact(F.array(*wrong)), ",")))
    return rows.select(*by, fields.alias("fields")).where("fields <> ''")


def status_rollup(daily: DataFrame) -> DataFrame:
    """Executed and blocked counts per phase and age, per phase, and overall."""
    return daily.rollup("phase", "max_age_ms").agg(
        F.grouping_id().alias("level"), F.count_if(F.col("run_status") == "executed").alias("executed"),
        F.count_if(F.col("run_status") == "blocked").alias("blocked"))
