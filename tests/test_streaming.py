"""Order state machines over several micro-batches against the batch operators."""

import random
import uuid
from collections import Counter

import pytest
from pyspark.sql import functions as F

from quotegrid.operators import rewards as rw
from quotegrid.operators.calendar import period_of
from quotegrid.params import MS
from quotegrid.streaming import live, orders

STEP = 1_000 * MS
HORIZONS = (2_000, 5_000)
PERIOD = 10 * STEP
DAYS = {"2024-01-01": 0, "2024-01-02": 100 * STEP}
LENGTH = 60 * STEP


@pytest.fixture(scope="module")
def book(spark):
    rng = random.Random(6)
    quotes, fills, chosen = [], [], []
    for date, start in DAYS.items():
        points = [i for i in range(1, 50 if date.endswith("1") else 24) if i not in (9, 20, 21, 33)]  # gaps; the second day breaks off
        quotes += [(1, date, start + i * STEP, 100.0 + rng.randrange(40) / 4) for i in points]
        for strategy in ("A", "B"):
            for seq, i in enumerate(sorted(rng.sample(points, 14))):
                fills.append((strategy, 1, date, seq, start + i * STEP, rng.choice([1, -1]), rng.randrange(2), 0.5))
            chosen += [(strategy, 1, date, p, rng.randrange(2), start + p * PERIOD + STEP) for p in range(5)]
    quotes = spark.createDataFrame(quotes, "instrument_id long, file_date string, ts_ns long, mid double")
    fills = spark.createDataFrame(fills, "strategy string, instrument_id long, file_date string, seq long, ts_ns long, side int, owner int, cost_usd double")
    chosen = spark.createDataFrame(chosen, "strategy string, instrument_id long, file_date string, period_index long, owner int, selected_at_ns long")
    return quotes, fills.join(quotes, ["instrument_id", "file_date", "ts_ns"]), chosen


def opened(rows):
    start = F.when(F.col("file_date") == "2024-01-02", DAYS["2024-01-02"]).otherwise(0).cast("long")
    return rows.withColumns({"open_ns": start, "close_ns": start + LENGTH})


def batch(book):
    quotes, fills, _ = book
    placed = rw.quotes_with_targets(quotes, HORIZONS, STEP)
    return rw.markout(fills.join(placed.drop("mid"), ["instrument_id", "file_date", "ts_ns"]), HORIZONS)


def drained(stream, spark):
    path = f"{live.shared_folder(spark)}/orders-{uuid.uuid4().hex}"
    run = stream.writeStream.format("parquet").outputMode("append").option("checkpointLocation", f"{path}-progress").trigger(availableNow=True).start(path)
    run.awaitTermination()
    return spark.read.schema(stream.schema).parquet(path), run.recentProgress


@pytest.mark.parametrize("slices", [1, 4])
def test_every_fill_gets_one_status(spark, book, slices):
    quotes, fills, _ = book
    replay = lambda rows: live.replay_in_time(spark, opened(rows), "ts_ns", 10**15, slices)
    rows, progress = drained(orders.maturing_fills(replay(fills.drop("owner", "cost_usd")), replay(quotes), HORIZONS, STEP, "1 second"), spark)
    key = lambda r: (r["file_date"], r["strategy"], r["seq"], r["status"], tuple(r["u"]) if r["u"] else None)
    got = Counter(map(key, rows.collect()))
    assert got == Counter(map(key, batch(book).collect())) and set(got.values()) == {1}
    assert {k[3] for k in got} == set(rw.STATUSES)
    assert len(progress) >= slices and progress[-1]["stateOperators"][0]["numRowsTotal"] == 0


@pytest.mark.parametrize("slices", [1, 4])
def test_period_feedback_is_that_of_the_batch(spark, book, slices):
    quotes, _, chosen = book
    scored = opened(batch(book)).withColumns({"score": F.get("u", F.lit(0)), "version_id": F.lit("v")})
    placed = period_of(scored, "ts_ns", "open_ns", "close_ns", PERIOD)
    chosen = chosen.withColumn("version_id", F.lit("v"))
    longest = max(HORIZONS) * MS
    start = F.when(F.col("file_date") == "2024-01-02", DAYS["2024-01-02"]).otherwise(0).cast("long")
    want = rw.period_feedback(rw.period_buckets(chosen, placed), quotes, start, PERIOD, start + LENGTH, longest)

    end = F.least(F.col("open_ns") + (F.col("period_index") + 1) * PERIOD, F.col("close_ns")).alias("end_ns")
    replay = lambda rows, at: live.replay_in_time(spark, rows, at, 10**15, slices)
    stream = orders.period_feedback_stream(replay(opened(chosen).select("*", end), "selected_at_ns"), replay(placed.select("*", end).drop("u", "mid"), "ts_ns"), replay(opened(quotes), "ts_ns"), longest, "1 second")
    rows, progress = drained(stream, spark)
    columns = ["file_date", *orders.BUCKET, "end_ns", "last_origin_ns", "orders", "pending", "matured", "missing_target", "crossed_gap_or_session", "observed_at_ns", "status", "reward"]
    got = Counter(tuple(r) for r in rows.select(columns).collect())
    assert got == Counter(tuple(r) for r in want.select(columns).collect())
    assert {k[columns.index("status")] for k in got} >= {"incomplete_period", "pending_orders", "no_orders", "incomplete_orders", "matured"}
    assert progress[-1]["stateOperators"][0]["numRowsTotal"] == 0


def test_streams_of_nothing(spark, book):
    quotes, fills, _ = book
    replay = lambda rows: live.replay_in_time(spark, opened(rows.where("ts_ns < 0")), "ts_ns", 10**15)
    rows, _ = drained(orders.maturing_fills(replay(fills), replay(quotes), HORIZONS, STEP, "1 second"), spark)
    assert rows.count() == 0
