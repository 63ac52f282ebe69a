"""Structured Streaming forms of sampling, sinks, and replays of stored tables."""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from quotegrid.functions.book import FLAGGED, GOOD, INVALID, OPEN, UNRELIABLE, message_class
from quotegrid.params import BOOK_COLUMNS, MS
from quotegrid.session import shared_folder

KEYS = ["instrument_id", "file_date"]
CARRIED = ["recv_ns", "event_ns", "sequence", "flags"]
HEAD = ("kind string, instrument_id bigint, file_date string, ts_ns bigint, source_recv_ns bigint, source_event_ns bigint, sequence bigint, "
        "source_flags bigint, age_ms double")
STATE = "clock bigint, fresh boolean, heads array<bigint>, prices array<double>, sizes array<bigint>"
#: Rows of one frame that goes out.
OUT_ROWS = 50_000


def governed_points(kind: np.ndarray, recv: np.ndarray, clock: int | None, interval_ns: int, max_age_ns: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, int | None]:
    """(late rows, rows that stay, those that show on a grid point, these points, the clock after them), for messages
    in sequence; row 0 may be the book held before.

    A trusted row behind the clock is late and changes nothing, so the clock is the running maximum of the trusted
    rows.  A good book shows on the grid points from its own time to the next row's, if that row is trusted."""
    trusted = kind != UNRELIABLE
    low = np.iinfo(np.int64).min
    before = np.concatenate([[low if clock is None else clock], np.where(trusted, recv, low)])
    before = np.maximum.accumulate(before)
    late = trusted & (recv < before[:-1])
    kept = np.flatnonzero(~late)
    here, then = kept[:-1], kept[1:]
    shown = (kind[here] == GOOD) & trusted[then]
    here, then = here[shown], then[shown]
    first = recv[here] // interval_ns + 1
    times = np.maximum(0, np.minimum(recv[then], recv[here] + max_age_ns) // interval_ns - first + 1)
    rows = np.repeat(here, times)
    place = np.arange(len(rows)) - np.repeat(np.cumsum(times) - times, times)
    return late, kept, rows, (np.repeat(first, times) + place) * interval_ns, None if before[-1] == low else int(before[-1])


def columns_of(frames: Iterator[pd.DataFrame], names: list[str], first: list | None) -> dict[str, np.ndarray]:
    """The named columns of all frames as one array each, after the values of ``first``; no frame is kept whole."""
    parts = {c: [] if first is None else [np.array([v])] for c, v in zip(names, first or names)}
    for frame in frames:
        for c in names:
            parts[c].append(frame[c].to_numpy(copy=True))
    return {c: np.concatenate(parts.pop(c)) for c in names}


def rows_out(data: dict[str, np.ndarray], kind: str, key: tuple, place: np.ndarray, at: np.ndarray | None, book_columns: list[str]) -> Iterator[pd.DataFrame]:
    """The rows at ``place``, shown at ``at`` or at their own time, in frames of bounded size."""
    for start in range(0, len(place), OUT_ROWS):
        here = place[start:start + OUT_ROWS]
        recv = data["recv_ns"][here]
        ts = recv if at is None else at[start:start + OUT_ROWS]
        yield pd.DataFrame({
            "kind": kind, "instrument_id": key[0], "file_date": key[1], "ts_ns": ts, "source_recv_ns": recv, "source_event_ns": data["event_ns"][here],
            "sequence": data["sequence"][here], "source_flags": data["flags"][here], "age_ms": np.nan if at is None else (ts - recv) / MS,
            **{c: data[c][here] for c in book_columns}})


def grid_stream(book: DataFrame, interval_ns: int, max_age_ns: int, delay: str = "2 days", columns: tuple = tuple(BOOK_COLUMNS)) -> DataFrame:
    """Snapshots and late rows of a message stream, one state per source file, with the book ``columns`` asked for.

    State is the trusted clock and the last completed book (or that there is none to show).  A trusted row behind the
    clock goes to ``kind = late`` instead of failing the stream.  Event time is the end of a file's day, as a bad clock
    has none of its own; when the watermark (the latest file's day end less ``delay``) has passed it, the state is
    deleted and rows that still come for the file are dropped by Spark, which counts them; a file whose name is no
    date keeps its state.  The rows of a key in one
    micro-batch are handled by one task in array steps, eight bytes a row and column that travels; bound them with the
    source's files-per-trigger option.
    """
    prices, sizes = ([c for c in columns if part in c] for part in ("_px_", "_sz_"))
    book_columns = [*prices, *sizes]
    output = ", ".join([HEAD, *[f"{c} double" for c in prices], *[f"{c} bigint" for c in sizes]])
    needed = ["seq", "_class", *CARRIED, *book_columns]

    def advance(key, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        clock, first = None, None
        if state.exists:
            clock, fresh, *held = state.get
            first = [np.iinfo(np.int64).min, GOOD, *[v for values in held for v in values]] if fresh else None
        data = columns_of(frames, ["_end_ms", *needed], first and [np.int64(0), *first])
        end_ms = int(data.pop("_end_ms")[-1])
        order = np.argsort(data.pop("seq"), kind="stable")
        late, kept, source, points, clock = governed_points(data["_class"][order], data["recv_ns"][order].astype(np.int64, copy=False), clock, interval_ns, max_age_ns)
        yield from rows_out(data, "late", key, order[late], None, book_columns)
        yield from rows_out(data, "snapshot", key, order[source], points, book_columns)
        last = order[kept[-1]] if len(kept) else None
        fresh = last is not None and data["_class"][last] == GOOD
        held = [[kind(data[c][last]) for c in names] for kind, names in ((int, CARRIED), (float, prices), (int, sizes))] if fresh else [[], [], []]
        state.update((clock, bool(fresh), *held))
        if end_ms:
            state.setTimeoutTimestamp(max(end_ms, state.getCurrentWatermarkMs() + 1))

    end_ms = F.unix_date(F.date_add(F.expr("try_cast(file_date AS date)"), 1)).cast("bigint") * 86_400_000
    staged = book.select(*KEYS, "seq", message_class().alias("_class"), *CARRIED, *book_columns, F.coalesce(end_ms, F.lit(0)).alias("_end_ms"), F.timestamp_millis(end_ms).alias("_at"))
    return staged.withWatermark("_at", delay).groupBy(*KEYS).applyInPandasWithState(advance, output, STATE, "append", GroupStateTimeout.EventTimeTimeout)


def tumbling_grid(book: DataFrame, interval: str, delay: str) -> DataFrame:
    """Last good quote and message classes per interval, emitted once the watermark passes."""
    kind = message_class()
    rows = book.withColumns({"_at": F.timestamp_micros(F.expr("recv_ns div 1000")), "_class": kind})
    good = F.when(F.col("_class") == GOOD, F.col("seq"))
    is_ = lambda *codes: F.count_if(F.col("_class").isin(*codes))
    grouped = rows.withWatermark("_at", delay).groupBy("instrument_id", F.window("_at", interval).alias("_w")).agg(
        F.max_by("bid_px_00", good).alias("bid"), F.max_by("ask_px_00", good).alias("ask"), is_(GOOD).alias("good"),
        is_(FLAGGED, INVALID).alias("bad"), is_(OPEN).alias("open"), is_(UNRELIABLE).alias("unreliable"))
    return grouped.select("instrument_id", (F.unix_micros("_w.start") * 1000).alias("start_ns"), "bid", "ask", "good", "bad", "open", "unreliable")


def run_to_table(stream: DataFrame, name: str) -> DataFrame:
    """Drain the available input into a file table (exactly once) and read it back."""
    spark = stream.sparkSession
    path = f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"
    done = (stream.writeStream.format("parquet").outputMode("append").option("checkpointLocation", f"{path}-progress")
            .trigger(availableNow=True).start(path))
    done.awaitTermination()
    return spark.read.schema(stream.schema).parquet(path)


def once_per_batch(path: str):
    """foreachBatch writer: a batch id is a folder, and an existing folder is left alone,
    so a replayed batch changes nothing."""

    def write(batch: DataFrame, batch_id: int) -> None:
        folder = f"{path}/batch_id={batch_id}"
        spark = batch.sparkSession
        target = spark._jvm.org.apache.hadoop.fs.Path(f"{folder}/_SUCCESS")
        if not target.getFileSystem(spark._jsc.hadoopConfiguration()).exists(target):
            # A half-written folder of a failed attempt has no success marker and is replaced.
            batch.write.mode("overwrite").parquet(folder)

    return write


def run_batches(stream: DataFrame, name: str) -> DataFrame:
    spark = stream.sparkSession
    path = f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"
    done = (stream.writeStream.foreachBatch(once_per_batch(path)).option("checkpointLocation", f"{path}-progress")
            .trigger(availableNow=True).start())
    done.awaitTermination()
    return spark.read.parquet(path)


def table_stream(spark: SparkSession, table: DataFrame, files: int = 1) -> DataFrame:
    """Replay a stored table as a file stream."""
    path = f"{shared_folder(spark)}/replay-{uuid.uuid4().hex}"
    table.repartition(files).write.parquet(path)
    return spark.readStream.schema(table.schema).option("maxFilesPerTrigger", 1).parquet(path)


def replay_in_time(spark: SparkSession, table: DataFrame, at: str, until_ns: int, slices: int = 3) -> DataFrame:
    """Replay a stored table in the order of its time column, one slice of time per micro-batch.  A last row, marked
    ``beat``, says that nothing comes before ``until_ns`` any more."""
    path = f"{shared_folder(spark)}/replay-{uuid.uuid4().hex}"
    rows = table.withColumn("beat", F.lit(False))
    low, high = rows.agg(F.min(at), F.max(at)).first()
    width = max(1, -(-((high or 0) + 1 - (low or 0)) // slices))
    beat = spark.range(1).select(F.lit(-1).cast("bigint").alias("instrument_id"), F.lit("").alias("file_date"), F.lit(until_ns).cast("bigint").alias(at), F.lit(True).alias("beat"))
    for i in range(slices):
        start = (low or 0) + i * width
        part = rows.where((F.col(at) >= start) & (F.col(at) < start + width))
        part = part.unionByName(beat, allowMissingColumns=True) if i == slices - 1 else part
        part.select(rows.columns).coalesce(1).write.mode("append").parquet(path)  # file times keep the slices in order
    return spark.readStream.schema(rows.schema).option("maxFilesPerTrigger", 1).parquet(path)
