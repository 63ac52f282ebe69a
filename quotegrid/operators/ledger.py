"""Signals, intents, fills and money as relations between tables.

Grid-level windows (quotes, equity) are bounded by the grid points of a day.
Fill-level state is keyed by the trade number, a chunked running count of
openings, so pairing and attribution are hash groups of two rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quotegrid.operators.ordered import asof, running_total
from quotegrid.params import DAY, MS, SECOND, Contract

SEQ_CHUNK = 1 << 18


def trade_flags(quotes: DataFrame, interval_ns: int) -> DataFrame:
    """tradable: before the segment end; scheduled_exit: last grid point before it."""
    tradable = F.col("ts_ns") < F.col("segment_end_ns")
    return quotes.withColumns({
        "tradable": tradable, "scheduled_exit": tradable & (F.col("ts_ns") + interval_ns >= F.col("segment_end_ns"))})


def reset_reason(quotes: DataFrame, by: list[str]) -> DataFrame:
    """Why waiting intents are dropped at a quote; expects change_reason and the trade flags.

    A change is overruled by the scheduled exit, that one by the end of the replay;
    a quote that is not tradable drops intents as ``closed_boundary``.
    """
    ends = quotes.groupBy(*by).agg(F.max("ts_ns").alias("_last"))
    reason = (F.when((F.col("ts_ns") == F.col("_last")) & F.col("tradable"), "replay_end")
              .when(F.col("scheduled_exit"), "scheduled_exit")
              .otherwise(F.coalesce("change_reason", F.when(~F.col("tradable"), "closed_boundary"))))
    return quotes.join(ends, by).withColumn("reset_reason", reason).drop("_last")


def with_version_change(quotes: DataFrame, by: list[str]) -> DataFrame:
    """Marks quotes whose visible model version differs from the quote before."""
    from quotegrid.operators.ordered import previous

    packed = quotes.withColumn("_v", F.struct("version_id"))
    seen = previous(packed, by, "ts_ns", DAY, "_before", "_v")
    changed = F.col("_before").isNotNull() & ~F.col("_before.version_id").eqNullSafe(F.col("version_id"))
    return seen.withColumn("version_changed", changed).drop("_v", "_before")


def route_intents(signals: DataFrame, quotes: DataFrame, latency_ns: int, by: list[str]) -> DataFrame:
    """Due time of each intent and the first quote at or after it."""
    due = signals.withColumn("due_ns", F.col("ts_ns") + latency_ns)
    times = quotes.select(*by, F.col("ts_ns").alias("due_ns"))
    return asof(due, times, "due_ns", by, [], forward=True).withColumnRenamed("matched_due_ns", "eligible_ns")


def intent_fate(intents: DataFrame, quotes: DataFrame, by: list[str]) -> DataFrame:
    """executable, superseded, unexecuted_at_end, or the reason of the reset that came first.

    A reset strictly after the decision and at or before the eligible quote wins;
    a version change on the same quote is named before any other reason.
    """
    reason = F.when(F.col("version_changed"), "model_version_change").otherwise(F.col("reset_reason"))
    resets = quotes.select(*by, "ts_ns", reason.alias("_why")).where("_why is not null")
    met = asof(intents, resets, "ts_ns", by, ["_why"], forward=True, strict=True).withColumnRenamed("matched_ts_ns", "_reset")
    cancelled = F.col("_reset").isNotNull() & (F.col("eligible_ns").isNull() | (F.col("_reset") <= F.col("eligible_ns")))
    rows = met.withColumn("_dead", cancelled)
    alive = F.when(~F.col("_dead"), F.col("ts_ns"))
    # Intents sharing an eligible quote: at most one per grid point inside the latency.
    shared = Window.partitionBy(*by, "eligible_ns")
    last = F.max(alive).over(shared)
    fate = (F.when(F.col("_dead"), F.col("_why")).when(F.col("eligible_ns").isNull(), "unexecuted_at_end")
            .when(F.col("ts_ns") < last, "superseded").otherwise("executable"))
    return rows.withColumn("fate", fate).drop("_reset", "_why", "_dead")


def fate_counts(fates: DataFrame, by: list[str]) -> DataFrame:
    return fates.groupBy(*by, "fate").agg(F.count(F.lit(1)).alias("intents"))


def price_fills(orders: DataFrame, contract: Contract) -> DataFrame:
    """Aggressive execution at the far quote plus slippage; all friction against mid."""
    side, mult = F.col("side"), contract.point_value * contract.quantity
    price = F.when(side > 0, F.col("ask")).otherwise(F.col("bid")) + side * F.lit(contract.slippage_ticks * contract.tick_size)
    cost = side * (F.col("price") - F.col("mid")) * mult + F.lit(contract.commission * contract.quantity)
    priced = orders.withColumn("price", price).withColumn("cost_usd", cost)
    return priced.withColumns({
        "cost_ratio": F.col("cost_usd") / (F.col("mid") * mult), "turnover_usd": F.abs(F.col("price") * mult)})


def order_status() -> Column:
    """Whether an order met a quote (``ts_ns``) before the end; prices and costs of the others are NULL."""
    return F.when(F.col("ts_ns").isNull(), "unexecuted_at_end").otherwise("executed")


def order_outcomes(orders: DataFrame, by: list[str]) -> DataFrame:
    """Orders, executed orders and unexecuted ones of each account; expects order_status."""
    met = F.col("order_status") == "executed"
    return orders.groupBy(*by).agg(F.count(F.lit(1)).alias("orders"), F.count_if(met).alias("executed"), F.count_if(~met).alias("unexecuted_at_end"))


def with_trade_number(fills: DataFrame, by: list[str], seq_chunk: int = SEQ_CHUNK) -> DataFrame:
    """Number trades by counting openings in fill order."""
    return running_total(fills, by, "seq", seq_chunk, trade_number=F.col("opening").cast("bigint"))


def attribute(fills: DataFrame, by: list[str], contract: Contract) -> DataFrame:
    """Give each fill the owner, version and entry of the trade's opening fill.

    The version that triggered an exit stays apart as ``trigger_version``.
    """
    trade = Window.partitionBy(*by, "trade_number")
    entry = lambda c: F.max(F.when(F.col("opening"), F.col(c))).over(trade)
    rows = fills.withColumns({
        "_owner": entry("owner"), "_version": entry("version_id"), "entry_mid": entry("mid"), "direction": entry("side")})
    gross = F.col("direction") * (F.col("mid") - F.col("entry_mid")) * F.lit(contract.point_value * contract.quantity)
    return rows.withColumns({
        "trigger_version": F.col("version_id"), "owner": F.col("_owner"), "version_id": F.col("_version"),
        "realised_usd": F.when(~F.col("opening"), gross)}).drop("_owner", "_version")


def pair_trades(fills: DataFrame, by: list[str]) -> DataFrame:
    """Closed trades from attributed fills: gross on mid prices, friction of both sides.

    Trades still open are not listed; one with two openings or closings ends the job.
    """
    opened = lambda c: F.max(F.when(F.col("opening"), F.col(c)))
    closed = lambda c: F.max(F.when(~F.col("opening"), F.col(c)))
    trades = fills.groupBy(*by, "trade_number").agg(
        F.first("owner").alias("owner"), F.first("direction").alias("direction"),
        opened("ts_ns").alias("entry_ns"), closed("ts_ns").alias("exit_ns"),
        opened("price").alias("entry_price"), closed("price").alias("exit_price"),
        closed("realised_usd").alias("gross_pnl_usd"), F.sum("cost_usd").alias("friction_usd"),
        F.count_if(~F.col("opening")).alias("_closings"), F.count_if("opening").alias("_openings"))
    doubled = F.raise_error(F.lit("a trade opens or closes twice")).cast("bigint")
    trades = trades.withColumn("exit_ns", F.when((F.col("_closings") > 1) | (F.col("_openings") > 1), doubled).otherwise(F.col("exit_ns")))
    trades = trades.where("_closings > 0").drop("_closings", "_openings")
    return trades.withColumns({
        "net_pnl_usd": F.col("gross_pnl_usd") - F.col("friction_usd"),
        "holding_ms": (F.col("exit_ns") - F.col("entry_ns")) / MS})


def equity(quotes: DataFrame, fills: DataFrame, by: list[str], contract: Contract) -> DataFrame:
    """Gross and net change of equity at every quote of a day an account traded.

    Fills are first folded to one state per account and quote; the windows then
    run over quotes only.
    """
    day = ["instrument_id", "file_date"]
    state = F.struct(F.when(F.col("opening"), F.col("direction")).otherwise(0).alias("position"), F.col("entry_mid").alias("entry"))
    folded = fills.groupBy(*by, "ts_ns").agg(
        F.sum("cost_usd").alias("_cost"), F.sum("realised_usd").alias("_gross"), F.max_by(state, "seq").alias("_state"),
        F.count(F.lit(1)).alias("_fills"))
    accounts = fills.select(*by).distinct()
    rows = quotes.select(*day, "ts_ns", "mid").join(accounts, day).join(folded, [*by, "ts_ns"], "left")
    past = Window.partitionBy(*by).orderBy("ts_ns").rowsBetween(Window.unboundedPreceding, 0)
    run = lambda c: F.coalesce(F.sum(c).over(past), F.lit(0.0))
    rows = rows.select(*by, "ts_ns", "mid", run("_gross").alias("realised_usd"), run("_cost").alias("cost_usd"),
                       F.last("_state", True).over(past).alias("_state"))
    position = F.coalesce(F.col("_state.position"), F.lit(0))
    marked = F.when(position != 0, position * (F.col("mid") - F.col("_state.entry")) * F.lit(contract.point_value * contract.quantity)).otherwise(0.0)
    rows = rows.withColumns({"position": position, "gross_usd": F.col("realised_usd") + marked})
    return rows.withColumn("net_usd", F.col("gross_usd") - F.col("cost_usd")).drop("_state", "mid")


def drawdown(curve: DataFrame, by: list[str], capital: float) -> DataFrame:
    """Running peak of equity (start capital included) and the fall from it."""
    past = Window.partitionBy(*by).orderBy("ts_ns").rowsBetween(Window.unboundedPreceding, 0)
    value = F.lit(capital) + F.col("net_usd")
    rows = curve.withColumn("equity_usd", value)
    rows = rows.withColumn("peak_usd", F.greatest(F.lit(capital), F.max("equity_usd").over(past)))
    return rows.withColumns({
        "drawdown_usd": F.col("peak_usd") - F.col("equity_usd"), "drawdown": (F.col("peak_usd") - F.col("equity_usd")) / F.col("peak_usd")})


def thin_curve(curve: DataFrame, by: list[str], points: int = 300) -> DataFrame:
    """First, last and every (n div points)-th row of each curve."""
    order = Window.partitionBy(*by).orderBy("ts_ns")
    whole = Window.partitionBy(*by)
    rows = curve.withColumns({"_i": F.row_number().over(order) - 1, "_n": F.count(F.lit(1)).over(whole)})
    step = F.greatest(F.lit(1), F.expr(f"_n div {points}"))
    return rows.where((F.col("_i") == F.col("_n") - 1) | (F.col("_i") % step == 0)).drop("_i", "_n")


def day_summary(curve: DataFrame, fills: DataFrame, trades: DataFrame, by: list[str], capital: float) -> DataFrame:
    """One row per account day: money, counts, drawdown, holding time, open position at the end."""
    last = F.struct("gross_usd", "cost_usd", "net_usd", "position")
    money = drawdown(curve, by, capital).groupBy(*by).agg(
        F.max_by(last, "ts_ns").alias("_l"), F.max("drawdown").alias("max_drawdown"), F.max("drawdown_usd").alias("max_drawdown_usd"))
    count = fills.groupBy(*by).agg(F.count(F.lit(1)).alias("total_fills"))
    done = trades.groupBy(*by).agg(F.count(F.lit(1)).alias("_trades"), F.avg("holding_ms").alias("holding_ms_mean"))
    rows = money.join(count, by).join(done, by, "left")
    return rows.select(
        *by, "total_fills", F.coalesce("_trades", F.lit(0)).alias("total_trades"),
        F.col("_l.gross_usd").alias("gross_pnl_usd"), F.col("_l.cost_usd").alias("friction_usd"), F.col("_l.net_usd").alias("net_pnl_usd"),
        (F.col("_l.net_usd") / F.lit(capital)).alias("net_return"), "max_drawdown", "max_drawdown_usd", "holding_ms_mean",
        F.col("_l.position").alias("terminal_position"), (F.col("_l.position") == 0).alias("settled"))


def version_audit(decisions: DataFrame, fills: DataFrame) -> DataFrame:
    """Decisions, fills and reward outcomes per model version."""
    kinds = decisions.select("version_id", F.lit("decisions").alias("kind"))
    kinds = kinds.unionByName(fills.select("version_id", F.lit("fills").alias("kind")))
    kinds = kinds.unionByName(fills.select("version_id", F.concat(F.lit("oe_"), "status").alias("kind")))
    names = ["decisions", "fills", "oe_matured", "oe_missing_target", "oe_crossed_gap_or_session", "oe_unmatured_at_end"]
    return kinds.groupBy("version_id").agg(*[F.count_if(F.col("kind") == n).alias(n) for n in names])


def selection_distribution(decisions: DataFrame, models: DataFrame, owner: str = "owner") -> DataFrame:
    """Share of decisions per model; models never chosen appear with zero."""
    counts = decisions.groupBy(owner).agg(F.count(F.lit(1)).alias("_n"))
    listed = models.join(counts, owner, "left").withColumn("decisions", F.coalesce("_n", F.lit(0))).drop("_n")
    everything = Window.partitionBy(F.lit(1))
    return listed.withColumn("share", F.col("decisions") / F.sum("decisions").over(everything))
