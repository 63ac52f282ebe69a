import random

import pytest
from pyspark.sql import functions as F

from quotegrid.operators import ledger as lg
from quotegrid.operators import policy as po
from quotegrid.operators import rewards as rw
from quotegrid.params import MS, Contract
from quotegrid.sources import tables as src


def fate_model(quotes, decisions, latency):
    """Intent queue replayed quote by quote."""
    waiting, fate = [], {}
    for t, why in quotes:
        if why:
            for origin in waiting:
                fate[origin] = why
            waiting = []
        else:
            due = [o for o in waiting if o + latency <= t]
            waiting = [o for o in waiting if o + latency > t]
            for o in due[:-1]:
                fate[o] = "superseded"
            if due:
                fate[due[-1]] = "executable"
        if t in decisions:
            waiting.append(t)
    fate.update({o: "unexecuted_at_end" for o in waiting})
    return fate


@pytest.mark.parametrize("seed", range(3))
def test_intent_fate_equals_replay(spark, seed):
    rng = random.Random(seed)
    quotes, intents, expected = [], [], {}
    for inst in range(40):
        times = sorted(rng.sample(range(0, 60), rng.randrange(2, 25)))
        marks = [(t, rng.choice([None, None, None, "gap", "model_version_change"])) for t in times]
        chosen = {t for t in times if rng.random() < 0.6}
        expected.update({(inst, o): f for o, f in fate_model(marks, chosen, 4).items()})
        quotes += [(inst, t, None if w == "model_version_change" else w, w == "model_version_change") for t, w in marks]
        intents += [(inst, t) for t in chosen]
    q = spark.createDataFrame(quotes, "instrument_id bigint, ts_ns bigint, reset_reason string, version_changed boolean")
    s = spark.createDataFrame(intents, "instrument_id bigint, ts_ns bigint")
    routed = lg.route_intents(s, q, 4, ["instrument_id"])
    got = {(r.instrument_id, r.ts_ns): r.fate for r in lg.intent_fate(routed, q, ["instrument_id"]).collect()}
    assert got == expected
    assert "superseded" in got.values()


def test_fill_cost_and_trade(spark):
    fills = spark.createDataFrame(
        [("S", 1, "d", 1, True, 1, 7, "v1", 100.0, 100.5, 100.25, 0), ("S", 1, "d", 2, False, -1, 9, "v2", 102.0, 102.5, 102.25, 60 * MS)],
        "strategy string, instrument_id bigint, file_date string, seq bigint, opening boolean, side int, owner int, version_id string, bid double, ask double, mid double, ts_ns bigint")
    done = lg.attribute(lg.with_trade_number(lg.price_fills(fills, Contract()), rw.ACCOUNT), rw.ACCOUNT, Contract()).orderBy("seq").collect()
    assert [r.price for r in done] == [100.625, 101.875]
    assert [r.cost_usd for r in done] == [0.375 * 50 + 1.25] * 2
    assert [(r.owner, r.version_id, r.trigger_version) for r in done] == [(7, "v1", "v1"), (7, "v1", "v2")]
    trade = lg.pair_trades(spark.createDataFrame(done), rw.ACCOUNT).collect()[0]
    assert (trade.gross_pnl_usd, trade.friction_usd, trade.net_pnl_usd, trade.holding_ms) == (100.0, 40.0, 60.0, 60.0)


def scored_fill(ts, status, score):
    return ("S", 1, "d", "v", ts // 50, 0, ts, status, score)


FILL = "strategy string, instrument_id bigint, file_date string, version_id string, period_index bigint, owner int, ts_ns bigint, status string, score double"


@pytest.mark.parametrize("fills,last,expected", [
    ([(10, "matured", 1.0), (40, "matured", 3.0)], 200, ("matured", 2.0, 70)),
    ([(10, "matured", 1.0), (40, "missing_target", None)], 200, ("incomplete_orders", None, 70)),
    ([(10, "matured", 1.0), (40, "unmatured_at_end", None)], 60, ("pending_orders", None, 60)),
    ([(10, "matured", 1.0)], 40, ("incomplete_period", None, 40)),
    ([], 200, ("no_orders", None, 50)),
])
def test_period_feedback_gate(spark, fills, last, expected):
    chosen = spark.createDataFrame([("S", 1, "d", "v", 0, 0)], "strategy string, instrument_id bigint, file_date string, version_id string, period_index bigint, owner int")
    rows = spark.createDataFrame([scored_fill(*f) for f in fills], FILL)
    quotes = spark.createDataFrame([(1, "d", t) for t in range(0, last + 1, 10)], "instrument_id bigint, file_date string, ts_ns bigint")
    out = rw.period_feedback(rw.period_buckets(chosen, rows), quotes, F.lit(0).cast("bigint"), 50, F.lit(1000).cast("bigint"), 30).collect()
    assert [(r.status, r.reward, r.observed_at_ns) for r in out] == [expected]
    assert po.audit_periods(rw.period_feedback(rw.period_buckets(chosen, rows), quotes, F.lit(0).cast("bigint"), 50, F.lit(1000).cast("bigint"), 30), 30).count() == 0


def test_costs_flip_the_best_arm(spark):
    def best(rewards):
        stats = spark.createDataFrame([("S", 1, "d", "v", 9, 0, a, 1, 1, r) for a, r in enumerate(rewards)],
                                      "strategy string, instrument_id bigint, file_date string, version_id string, selected_at_ns bigint, owner int, arm int, visits bigint, feedback bigint, reward_sum double")
        return {r.best_arm for r in rw.ucb_scores(stats, 0.0).collect()}
    assert best([1.0, 0.8]) == {0} and best([1.0 - 0.6, 0.8 - 0.1]) == {1}


def test_unvisited_arm_first(spark):
    stats = spark.createDataFrame([("S", 1, "d", "v", 9, 2, a, v, v, 5.0) for a, v in enumerate([3, 0, 0])],
                                  "strategy string, instrument_id bigint, file_date string, version_id string, selected_at_ns bigint, owner int, arm int, visits bigint, feedback bigint, reward_sum double")
    rows = rw.ucb_scores(stats, 1.0).collect()
    assert {r.best_arm for r in rows} == {1} and {r.score for r in rows if r.arm} == {None} and not any(r.agrees for r in rows)


def test_blocked_is_null_and_cash_is_zero(spark):
    daily = spark.createDataFrame([("cash", "d1", 0, 0, 0.0, 0.0, 0.0, True, 0, 0, [0.0]), ("A", "d1", 2, 1, 5.0, 1.0, 4.0, True, 1, 0, [2.0]),
                                   ("A", "d2", 3, 1, 9.0, 1.0, 8.0, False, 3, 0, [4.0])],
                                  "strategy string, file_date string, total_fills bigint, total_trades bigint, gross_pnl_usd double, friction_usd double, net_pnl_usd double, "
                                  "settled boolean, matured bigint, unmatured bigint, mu array<double>")
    rows = po.with_blocked(daily, spark.createDataFrame([("B", "d1")], "strategy string, file_date string"))
    total = {r.strategy: r for r in po.summarize_days(rows, ["strategy"]).collect()}
    assert (total["cash"].net_pnl_usd, total["cash"].pnl_defined) == (0.0, True)
    assert (total["B"].net_pnl_usd, total["B"].friction_usd, total["B"].total_fills) == (None, None, None)
    assert (total["A"].net_pnl_usd, total["A"].friction_usd, total["A"].unsettled_days) == (None, 2.0, "d2")
    pooled = {r.strategy: r for r in po.pooled_expectation(rows, ["strategy"], 1).collect()}
    assert pooled["A"].mu == [3.5] and pooled["cash"].mu is None and pooled["B"].mu is None
    diff = po.paired_diff(rows.where("file_date = 'd1'"), ["file_date"], "A", "B", ["net_pnl_usd"]).collect()
    assert [r.net_pnl_usd_diff for r in diff] == [None]


def test_sinks_refuse_overwrite_and_nan(spark, tmp_path):
    rows = spark.range(3).withColumn("x", F.col("id") * 1.0)
    src.write_results(rows, f"{tmp_path}/ok")
    with pytest.raises(Exception, match="(?i)exists"):
        src.write_results(rows, f"{tmp_path}/ok")
    with pytest.raises(ValueError):
        src.write_results(rows.withColumn("x", F.lit(float("nan"))), f"{tmp_path}/bad")
    empty = spark.createDataFrame([], "max_age_ms bigint, file_date string, ts_ns bigint, source_recv_ns bigint, age_ms double")
    with pytest.raises(ValueError):
        src.write_snapshots(empty, f"{tmp_path}", "none", {})


def test_book_scan(spark, tmp_path):
    from tests.helpers import BOOK_SCHEMA, message

    rows = spark.createDataFrame([message(i, 1000 + i) for i in range(5)], BOOK_SCHEMA)
    path = f"{tmp_path}/2024-01-02"
    rows.select(F.expr("timestamp_micros(recv_ns)").alias("ts_recv"), F.expr("timestamp_micros(event_ns)").alias("ts_event"),
                *[c for c in rows.columns if c not in ("recv_ns", "event_ns", "seq", "file_date")]).coalesce(1).write.parquet(path)
    book = src.read_book(spark, path)
    got = book.orderBy("seq").collect()
    assert [(r.seq, r.recv_ns, r.file_date) for r in got] == [(i, (1000 + i) * 1000, "2024-01-02") for i in range(5)]
    assert {r.nulls for r in src.null_audit(book).collect()} == {0}
    spark.range(3).write.parquet(f"{tmp_path}/other")
    with pytest.raises(ValueError, match="lack columns"):
        src.read_book(spark, f"{tmp_path}/other")


def test_orders_without_a_quote_are_counted(spark):
    rows = spark.createDataFrame([("S", 1, 10), ("S", 2, None), ("T", 3, None)], "strategy string, seq long, ts_ns long").withColumn("order_status", lg.order_status())
    got = {r["strategy"]: (r["orders"], r["executed"], r["unexecuted_at_end"]) for r in lg.order_outcomes(rows, ["strategy"]).collect()}
    assert got == {"S": (2, 1, 1), "T": (1, 0, 1)}


def test_weight_audit_equals_its_sql_without_markouts(spark):
    import duckdb

    from quotegrid.plans import trading
    from quotegrid.plans.registry import CTES, ORACLES

    body = ORACLES["r06_weight_audit"].rsplit(")\n", 1)[1]
    one, none, zero = [1.0, -2.0, 3.0], None, [0.0, 0.0, 0.0]
    for kinds in ([none] * 4, [one] * 4, [one, none, none, zero], [none, one, one, none], [zero, zero, zero, none]):
        rows = [(f"S{i}", kind) for i, kind in enumerate(kinds)] + [("S3", None)]
        got = trading.weight_audit(spark.createDataFrame(rows, "strategy string, u array<double>")).select("strategy", "rule", "total").collect()
        con = duckdb.connect()
        con.execute("CREATE TABLE sc (strategy VARCHAR, u1 DOUBLE, u2 DOUBLE, u3 DOUBLE)")
        con.executemany("INSERT INTO sc VALUES (?, ?, ?, ?)", [(s, *(u or [None] * 3)) for s, u in rows])
        want = con.execute(f"WITH wts AS ({CTES['wts']}) {body}").fetchall()
        assert sorted(map(repr, map(tuple, got))) == sorted(map(repr, want))


def test_weight_sets_that_were_never_fitted_are_judged_by_length(spark):
    sets = {"whole": [0.5, 0.3, 0.2], "unfitted": [None] * 3, "unfitted_short": [None] * 2, "partly": [0.5, None, 0.5], "nan": [float("nan"), 0.5, 0.5]}
    rows = spark.createDataFrame([(k, i, w) for k, ws in sets.items() for i, w in enumerate(ws)], "name string, horizon_ms long, weight double")
    got = {r["name"]: r["rule"] for r in rw.audit_weights(rows, ["name"], 3).collect()}
    assert got == {"unfitted_short": "wrong_length", "partly": "not_finite", "nan": "not_finite"}
