"""Rules that agree on easy inputs and differ on hard ones."""

import pytest
from pyspark.sql import functions as F

from quotegrid.operators import calendar, features, ledger, policy, quality, sampling


@pytest.mark.parametrize("values,status", [((0.0, 0.9e-8, -0.9e-8), "blocked_uninformative_expectations"), ((0.0, 2e-8, 0.0), "qualified")])
def test_spread_is_measured_from_the_first_vector(spark, values, status):
    rows = [(f"p{i}", i, False, None, [v]) for i, v in enumerate(values)]
    stats = spark.createDataFrame(rows, "policy_id string, idx int, cash boolean, exclusion string, mu array<double>")
    expert = spark.createDataFrame([("p0",)], "selected string")
    assert policy.qualify(stats, expert, 1, 1e-8).first()["status"] == status


def test_equal_tables_with_repeated_keys_do_not_differ(spark):
    a = spark.createDataFrame([(1, "x"), (1, "y"), (2, None)], "k int, v string")
    assert quality.dataset_diff(a, a.orderBy("v"), ["k"]).count() == 0
    b = spark.createDataFrame([(1, "x"), (1, "z"), (1, "z"), (2, None)], "k int, v string")
    assert sorted(r["kind"] for r in quality.dataset_diff(a, b, ["k"]).collect()) == ["changed", "only_right"]


def test_fingerprints_keep_columns_apart(spark):
    print_of = lambda *row: quality.fingerprint(spark.createDataFrame([row], "a string, b string"), ["a", "b"]).first()["fingerprint"]
    assert len({print_of("a|b", "c"), print_of("a", "b|c"), print_of(None, "c"), print_of("", "c"), print_of("-1:", "c")}) == 5


def test_a_message_without_flags_is_refused(spark):
    from pyspark.sql import functions as F
    book = spark.range(2).select(F.when(F.col("id") == 0, 1).cast("int").alias("flags"))
    assert sampling.flagged(book.where("id = 0")).count() == 1
    with pytest.raises(Exception, match="no flags"):
        sampling.flagged(book).collect()


def test_quotes_must_increase_in_the_order_of_their_messages(spark):
    quote = "instrument_id bigint, file_date string, sequence bigint, ts_ns bigint, source_recv_ns bigint, bid_px_00 double, ask_px_00 double, mid_price double"
    rows = [(1, "d", 1, 10, 9, 1.0, 1.5, 1.25), (1, "d", 2, 30, 19, 1.0, 1.5, 1.25), (1, "d", 3, 20, 19, 1.0, 1.5, 1.25), (1, "d", 3, 20, 19, 1.0, 0.5, 0.75),
            (2, "d", 1, 10, 9, -1.0, 1.5, 0.25), (1, "e", 4, 10, None, None, 1.5, 1.25)]
    got = {r["rule"]: r["violations"] for r in quality.audit_quotes(spark.createDataFrame(rows, quote), 10).collect()}
    assert got == {"not_increasing": 2, "received_late": 1, "off_grid": 0, "bad_bid": 2, "crossed": 2, "mid_mismatch": 1}


def test_session_counts_are_per_instrument(spark):
    rows = [(i, "s", "s:0", t, 0, True) for i, times in ((1, (10, 20, 40)), (2, (10, 20, 30, 40))) for t in times]
    df = spark.createDataFrame(rows, "instrument_id bigint, session_id string, segment_id string, ts_ns bigint, continuous_block int, feature_valid boolean")
    segments = spark.createDataFrame([("s", 0, 40)], "session_id string, start_ns bigint, end_ns bigint")
    ready = df.select("instrument_id", "session_id", "ts_ns", (F.col("ts_ns") > 10).alias("learning_ready"))
    got = {r["instrument_id"]: (r["missing_grid_points"], r["coverage_complete"], r["internal_missing"], r["learning_ready"]) for r in quality.session_quality(df, segments, 10, ready).collect()}
    assert got == {1: (1, False, 1, 2), 2: (0, True, 0, 3)}
    labels = df.select("instrument_id", "session_id", "feature_valid", F.lit(1).alias("horizon_ms"), F.lit(True).alias("label_valid"), F.lit("valid").alias("label_reason"))
    assert {r["instrument_id"]: r["valid"] for r in features.label_quality(labels).collect()} == {1: 3, 2: 4}


def test_rows_past_the_last_version_are_refused(spark):
    versions = spark.createDataFrame([("a", 5)], "version_id string, available_at_ns bigint")
    with pytest.raises(Exception, match="past the end"):
        calendar.asof_version(spark.createDataFrame([(100,)], "ts_ns bigint"), versions, 100).collect()


def test_a_trade_that_closes_twice_is_refused(spark):
    fill = "strategy string, trade_number int, owner int, direction int, opening boolean, ts_ns bigint, price double, realised_usd double, cost_usd double"
    rows = [("S", 1, 0, 1, True, 1, 9.0, None, 1.0), ("S", 1, 0, 1, False, 2, 9.0, 3.0, 1.0), ("S", 2, 0, 1, True, 3, 9.0, None, 1.0)]
    assert [(r["trade_number"], r["net_pnl_usd"]) for r in ledger.pair_trades(spark.createDataFrame(rows, fill), ["strategy"]).collect()] == [(1, 1.0)]
    with pytest.raises(Exception, match="closes twice"):
        ledger.pair_trades(spark.createDataFrame([*rows, ("S", 1, 0, 1, False, 4, 9.0, 3.0, 1.0)], fill), ["strategy"]).collect()


def test_ordered_diff_finds_the_first_position(spark):
    rows = [(i, i % 3, None if i % 5 == 0 else "x") for i in range(300)]
    a = spark.createDataFrame(rows, "k long, v int, t string").repartition(4)
    same = quality.diff_report(a, a.repartition(3), ["k"]).first()
    assert tuple(same) == (300, 300, True, 0, None, None, None)
    changed = spark.createDataFrame([(k, 9 if k == 299 else v, t) for k, v, t in rows], a.schema)
    assert tuple(quality.diff_report(a, changed, ["k"]).first()) == (300, 300, True, 1, 300, "changed", "v")
    short = quality.diff_report(a, a.where("k <> 100"), ["k"]).first()
    assert (short["left_rows"], short["right_rows"], short["different_positions"], short["first_position"]) == (300, 299, 200, 101)
    last = quality.ordered_diff(a, a.where("k < 299"), ["k"]).collect()
    assert [(r["position"], r["kind"], r["left_k"], r["right_k"]) for r in last] == [(300, "only_left", 299, None)]
    moved = a.withColumn("k", F.when(F.col("k") == 7, 8).when(F.col("k") == 8, 7).otherwise(F.col("k")))
    assert [r["position"] for r in quality.ordered_diff(a, moved, ["k"]).orderBy("position").collect()] == [8, 9]
    assert quality.ordered_diff(a.where("k < 0"), a.where("k < 0"), ["k"]).count() == 0
