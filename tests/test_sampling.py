import random
import tracemalloc
import uuid

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from tests.helpers import BOOK_SCHEMA, message, sample
from quotegrid.operators import sampling as sm
from quotegrid.params import BOOK_COLUMNS
from quotegrid.streaming import live

I, A = 10, 25


def random_files(seed, files=25, length=40):
    rng = random.Random(seed)
    rows = []
    for f in range(files):
        recv, day = rng.randrange(0, 30), f"d{f:03d}"
        for n in range(rng.randrange(1, length)):
            recv += rng.choice([0, 0, 1, 3, 7, 10, 20, 70])
            flags = rng.choice([128, 128, 128, 0, 132, 136, 8, 160])
            clock = recv + rng.choice([-50, 500]) if flags & 8 else recv
            rows.append(message(f * 1000 + n, clock, flags, rng.random() > 0.15, day))
    return rows


@pytest.mark.parametrize("seed,chunk,age", [(1, 1 << 18, A), (2, 3, A), (3, 2, 5)])
def test_grid_equals_sequential_model(spark, seed, chunk, age):
    rows = random_files(seed)
    days = sorted({r[4] for r in rows})
    expected, skips, ranges = set(), {}, set()
    for day in days:
        out, why, parts = sample([r for r in rows if r[4] == day], I, age)
        expected |= {(day, *o) for o in out}
        ranges |= {(day, *p) for p in parts}
        for k, v in why.items():
            skips[k] = skips.get(k, 0) + v
    book = spark.createDataFrame(rows, BOOK_SCHEMA)
    got = {(r.file_date, r.ts_ns, r.sequence) for r in sm.grid_snapshots(book, I, age, chunk).collect()}
    assert got == expected
    stats = sm.sampling_stats(book, I, age, chunk).collect()
    assert sum(r.source_records for r in stats) == len(rows)
    assert {k: sum(r[k] for r in stats) for k in sm.SKIP_REASONS if sum(r[k] for r in stats)} == skips
    found = {(r.file_date, r.start_ns, r.end_ns, r.status, r.complete_recv_ns, r.trusted_recv_ns) for r in sm.grid_ranges(book, I, age, chunk).collect()}
    assert found == ranges


@pytest.mark.parametrize("rows,expected", [
    ([message(0, 10), message(1, 25)], [(20, 0)]),                       # received on a grid point: next point sees it
    ([message(0, 5), message(1, 31)], [(10, 0), (20, 0), (30, 0)]),      # age exactly the bound still counts
    ([message(0, 5), message(1, 8, 0), message(2, 21)], []),             # open event blocks the quote before it
    ([message(0, 5), message(1, 999, 136), message(2, 12)], []),         # bad clock neither advances time nor keeps the book
    ([message(0, 5)], []),                                               # the last row of a file governs nothing
])
def test_boundary_rows(spark, rows, expected):
    book = spark.createDataFrame(rows, BOOK_SCHEMA)
    assert [(r.ts_ns, r.sequence) for r in sm.grid_snapshots(book, I, A).orderBy("ts_ns").collect()] == expected


def test_few_columns_give_the_same_grid(spark):
    book = spark.createDataFrame(random_files(7), BOOK_SCHEMA)
    wide = sm.grid_snapshots(book, I, A)
    narrow = sm.grid_snapshots(book, I, A, columns=("ask_px_00", "bid_sz_01"))
    columns = ["file_date", "ts_ns", "sequence", "source_flags", "age_ms", "ask_px_00", "bid_sz_01"]
    assert sorted(map(tuple, wide.select(*columns).collect())) == sorted(map(tuple, narrow.select(*columns).collect()))
    plan = sm.sampling_stats(book, I, A)._jdf.queryExecution().executedPlan().toString()
    assert "SortAggregate" not in plan


def test_a_second_symbol_in_a_file_is_refused(spark):
    book = spark.createDataFrame([message(0, 5), message(1, 31), message(2, 55)], BOOK_SCHEMA)
    mixed = book.withColumn("symbol", F.when(F.col("sequence") == 1, "ALT").otherwise(F.col("symbol")))
    for build in (sm.grid_snapshots, sm.grid_ranges, sm.sampling_stats):
        assert build(book, I, A).count() > 0
        with pytest.raises(Exception, match="two symbols"):
            build(mixed, I, A).collect()


def test_age_ladder_equals_resampling(spark):
    book = spark.createDataFrame(random_files(5), BOOK_SCHEMA)
    # Test ages are below a millisecond, so the ladder works on the recomputed age.
    wide = sm.grid_snapshots(book, I, A)
    for age in (10, 15):
        narrow = {(r.file_date, r.ts_ns) for r in sm.grid_snapshots(book, I, age).collect()}
        assert {(r.file_date, r.ts_ns) for r in wide.where(f"ts_ns - source_recv_ns <= {age}").collect()} == narrow


def test_order_violations_cross_chunks(spark):
    rows = [message(i, t) for i, t in enumerate([5, 9, 7, 12, 11, 30, 29])]
    book = spark.createDataFrame(rows, BOOK_SCHEMA)
    for chunk in (1, 2, 100):
        assert sorted(r.seq for r in sm.order_violations(book, chunk).collect()) == [2, 4, 6]


def test_stream_equals_batch_over_several_batches(spark):
    rows = random_files(7, files=6)
    book = spark.createDataFrame(rows, BOOK_SCHEMA)
    expected = {(r.file_date, r.ts_ns, r.sequence) for r in sm.grid_snapshots(book, I, A).collect()}
    source = f"{live.shared_folder(spark)}/stream-test-{uuid.uuid4().hex}"
    for part in range(4):
        book.where(f"seq % 1000 >= {part * 10} and seq % 1000 < {part * 10 + 10}").coalesce(1).write.mode("append").parquet(source)
    stream = spark.readStream.schema(book.schema).option("maxFilesPerTrigger", 1).parquet(source)
    out = live.run_to_table(live.grid_stream(stream, I, A), "stream-out").where("kind = 'snapshot'")
    assert {(r.file_date, r.ts_ns, r.sequence) for r in out.collect()} == expected


def test_stream_carries_only_the_columns_asked_for(spark):
    book = spark.createDataFrame(random_files(8, files=4), BOOK_SCHEMA)
    source = f"{live.shared_folder(spark)}/columns-test-{uuid.uuid4().hex}"
    for part in range(4):
        shaken = book.withColumn("recv_ns", F.col("recv_ns") - F.when(F.col("seq") % 7 == 3, 40).otherwise(0))
        shaken.where(f"seq % 1000 >= {part * 10} and seq % 1000 < {part * 10 + 10}").coalesce(1).write.mode("append").parquet(source)
    stream = spark.readStream.schema(book.schema).option("maxFilesPerTrigger", 1).parquet(source)
    full = live.run_to_table(live.grid_stream(stream, I, A), "stream-full")
    for columns in ((), ("ask_px_04", "bid_sz_03")):
        thin = live.grid_stream(stream, I, A, columns=columns)
        assert [c for c in thin.columns if c in BOOK_COLUMNS] == list(columns)
        got = sorted(map(repr, live.run_to_table(thin, "stream-thin").collect()))
        assert got == sorted(map(repr, full.select(thin.columns).collect()))
    assert {r["kind"] for r in full.select("kind").distinct().collect()} == {"late", "snapshot"}


def test_stream_holds_each_row_once(monkeypatch):
    """Peak of one micro-batch of a file: its columns, one more column while they are joined, and bounded frames."""
    rows, width, parts = 4_000, 44, 30
    names = ["recv_ns", "event_ns", "sequence", "flags", *[f"c{i}" for i in range(width)]]
    frames = (pd.DataFrame({c: np.arange(rows) + k * rows for c in names}) for k in range(parts))
    monkeypatch.setattr(live, "OUT_ROWS", 1_000)
    tracemalloc.start()
    data = live.columns_of(frames, names, None)
    out = sum(len(x) for x in live.rows_out(data, "late", (1, "d"), np.arange(rows * parts), None, names[4:]))
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert out == rows * parts and peak < 1.2 * rows * parts * len(names) * 8


def test_stream_states_of_finished_files_are_deleted(spark):
    rows = [r for r in random_files(9, files=3)]
    book = spark.createDataFrame(rows, BOOK_SCHEMA)
    days = {d: f"2024-02-0{i + 1}" for i, d in enumerate(sorted({r[4] for r in rows}))}
    dated = book.replace(days, subset=["file_date"])
    source = f"{live.shared_folder(spark)}/expiry-test-{uuid.uuid4().hex}"
    for part in range(4):
        dated.where(f"seq % 1000 >= {part * 10} and seq % 1000 < {part * 10 + 10}").coalesce(1).write.mode("append").parquet(source)
    dated.limit(1).replace({d: "2024-03-01" for d in days.values()}, subset=["file_date"]).coalesce(1).write.mode("append").parquet(source)
    stream = spark.readStream.schema(book.schema).option("maxFilesPerTrigger", 1).parquet(source)
    path = f"{live.shared_folder(spark)}/expiry-out-{uuid.uuid4().hex}"
    run = live.grid_stream(stream, I, A, "5 days").writeStream.format("parquet").option("checkpointLocation", f"{path}-progress").trigger(availableNow=True).start(path)
    run.awaitTermination()
    got = spark.read.parquet(path)
    assert {(r.file_date, r.ts_ns, r.sequence) for r in got.where("kind = 'snapshot'").collect()} == {(r.file_date, r.ts_ns, r.sequence) for r in sm.grid_snapshots(dated, I, A).collect()}
    assert run.recentProgress[-1]["stateOperators"][0]["numRowsTotal"] == 1  # the last file, whose day is not over
    assert len(run.recentProgress) >= 5


def test_replayed_batch_is_written_once(spark):
    path = f"{live.shared_folder(spark)}/once-{uuid.uuid4().hex}"
    write = live.once_per_batch(path)
    write(spark.range(3), 0)
    write(spark.range(5), 0)
    write(spark.range(2), 1)
    assert spark.read.parquet(path).count() == 5


@pytest.mark.parametrize("chunk", [3, 1 << 18])
def test_prefix_takes_the_first_records_of_each_file(spark, chunk):
    rows = random_files(11, files=8)
    got = sm.prefix(spark.createDataFrame(rows, BOOK_SCHEMA), 7, chunk).collect()
    expected = {(d, r[0], n + 1) for d in {r[4] for r in rows} for n, r in enumerate([r for r in rows if r[4] == d][:7])}
    assert {(r.file_date, r.seq, r.record) for r in got} == expected
