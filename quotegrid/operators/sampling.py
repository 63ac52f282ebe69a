"""Message stream to causal fixed-interval snapshots, in set form.

A grid point B may only see messages received strictly before B.  Between two
consecutive occupied cells (cell = receive time div interval) every grid point is
therefore governed by the state after the last message of the earlier cell.  So
the raw stream is first reduced to one row per occupied cell by a hash aggregate
with map-side combine; the shuffle carries at most one row per grid interval and
map task, however many messages one instrument or day holds, and every later
window is bounded by the number of grid points of a day.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quotegrid.functions.book import FLAGGED, GOOD, INVALID, OPEN, class_name, has_bit, message_class
from quotegrid.operators.ordered import chunk_of, previous
from quotegrid.params import BOOK_COLUMNS, FLAG_BAD_CLOCK, FLAG_LAST, MS

SOURCE = ["instrument_id", "file_date"]
SEQ_CHUNK = 1 << 18
HEAD = ["recv_ns", "event_ns", "flags", "sequence"]
# Up to so many carried columns fit generated hash aggregation as buffers of their own.
NARROW = 8

STALE = "stale_completed_book"
UNRELIABLE_STATE = "unreliable_receive_state"
BAD_FLAG = "bad_book_flag"
BAD_BOOK = "invalid_completed_book"
INCOMPLETE = "incomplete_event"
SKIP_REASONS = [STALE, UNRELIABLE_STATE, BAD_FLAG, BAD_BOOK, INCOMPLETE]


def classify(book: DataFrame) -> DataFrame:
    """Add the message class: U bad clock, O open event, B bad book, G good book."""
    return book.withColumn("class", class_name(message_class()))


def _bad_clock() -> Column:
    return has_bit(F.col("flags"), FLAG_BAD_CLOCK)


def flagged(book: DataFrame) -> DataFrame:
    """The messages, refusing any without flags: it would be neither trusted nor a bad clock."""
    missing = F.raise_error(F.lit("a message has no flags")).cast(book.schema["flags"].dataType)
    return book.withColumn("flags", F.coalesce("flags", missing))


def cells(book: DataFrame, interval_ns: int, carried: list[str]) -> DataFrame:
    """Last trusted message of every occupied cell, with its ``carried`` columns, plus the last completed one."""
    book = flagged(book)
    trusted = book.where(~_bad_clock()).withColumns({"_class": message_class(), "cell": chunk_of("recv_ns", interval_ns)})
    completed = F.when(F.col("_class") != OPEN, F.col("seq"))
    # Fixed-width buffers aggregate by hash without a sort.  A whole book as single buffers
    # exceeds what generated code can hold and runs interpreted, so it travels as a struct.
    fields = ["_class", *carried]
    narrow = len(carried) <= NARROW
    latest = [F.max_by(c, "seq").alias(f"_last_{c}") for c in fields] if narrow else [F.max_by(F.struct(*fields), "seq").alias("last")]
    rows = trusted.groupBy(*SOURCE, "symbol", "cell").agg(
        F.min("seq").alias("first_seq"), F.max("seq").alias("last_seq"), *latest,
        F.max(completed).alias("_done_seq"), F.max_by("_class", completed).alias("_done_class"), F.max_by("recv_ns", completed).alias("_done_recv"),
        F.count(F.lit(1)).alias("records"),
        F.count_if(F.col("_class").isin(FLAGGED, INVALID)).alias("bad_books"))
    last = F.struct(*[F.col(f"_last_{c}").alias(c) for c in fields]) if narrow else F.col("last")
    done = F.struct(F.col("_done_seq").alias("seq"), F.col("_done_class").alias("_class"), F.col("_done_recv").alias("recv_ns"))
    return rows.select(*SOURCE, "symbol", "cell", "first_seq", "last_seq", last.alias("last"),
                       F.when(F.col("_done_seq").isNotNull(), done).alias("done"), "records", "bad_books")


def governed(book: DataFrame, interval_ns: int, max_age_ns: int, seq_chunk: int = SEQ_CHUNK, carried: tuple = ("recv_ns",)) -> DataFrame:
    """Per occupied cell: the grid points it governs, how many emit, why the rest do not.

    ``lo``/``hi`` bound the governed points, ``emit_hi`` the last emitted one
    (NULL if none), ``skip_reason`` explains the points after it.  A file is one
    instrument's: trusted messages of a second symbol in it end the job.
    """
    occupied = cells(book, interval_ns, list(carried))
    book = flagged(book)
    # A cell becomes two marks on the sequence axis; only the later one carries the book.
    payload = ["last", "done", "records", "bad_books"]
    none = [F.lit(None).cast(occupied.schema[c].dataType).alias(c) for c in payload]
    mark = F.explode(F.array(
        F.struct(F.col("first_seq").alias("at"), F.lit(0).alias("kind"), *none),
        F.struct(F.col("last_seq").alias("at"), F.lit(1).alias("kind"), *payload)))
    marks = occupied.select(*SOURCE, "symbol", "cell", mark.alias("_mark")).select(*SOURCE, "symbol", "cell", "_mark.*")
    # Bad-clock rows have no usable time: place them among the cells by sequence.
    # Of a run of them only the last can matter, so runs collapse inside fixed
    # sequence chunks before anything is windowed per day.
    bad = book.where(_bad_clock()).select(*SOURCE, F.col("seq").alias("at"), F.lit(2).alias("kind"))
    events = marks.unionByName(bad, allowMissingColumns=True).withColumn("_chunk", chunk_of("at", seq_chunk))
    near = Window.partitionBy(*SOURCE, "_chunk").orderBy("at", "kind")
    events = events.withColumn("_next", F.lead("kind").over(near))
    events = events.where("kind <> 2 or _next is null or _next <> 2").drop("_next", "_chunk")

    day = Window.partitionBy(*SOURCE).orderBy("at", "kind")
    so_far = day.rowsBetween(Window.unboundedPreceding, 0)
    last = events.withColumns({
        "_bad_seq": F.max(F.when(F.col("kind") == 2, F.col("at"))).over(so_far),
        "_then": F.lead("kind").over(day)}).where("kind = 1")
    by_seq = Window.partitionBy(*SOURCE).orderBy("at")
    last = last.withColumns({
        "_done": F.last("done", True).over(by_seq.rowsBetween(Window.unboundedPreceding, 0)),
        "_next_cell": F.lead("cell").over(by_seq), "_symbol_before": F.lag("symbol").over(by_seq)})
    foreign = F.raise_error(F.lit("a source file holds messages of two symbols")).cast("bigint")
    last = last.withColumn("cell", F.when(F.col("_symbol_before") != F.col("symbol"), foreign).otherwise(F.col("cell")))
    last = last.select(*SOURCE, "symbol", "cell", "records", "bad_books", "last.*", "_done", "_next_cell", "_bad_seq", "_then")

    lost = F.coalesce(F.col("_bad_seq") > F.coalesce(F.col("_done.seq"), F.lit(-1)), F.lit(False))
    done_class = F.col("_done._class")
    book_reason = lambda code: F.when(code == FLAGGED, BAD_FLAG).when(code == INVALID, BAD_BOOK)
    reason = (F.when(F.col("_then") == 2, UNRELIABLE_STATE)
              .when(F.col("_class") == GOOD, STALE)
              .when(F.col("_class") != OPEN, book_reason(F.col("_class")))
              .when(lost, UNRELIABLE_STATE)
              .otherwise(F.coalesce(book_reason(done_class), F.lit(INCOMPLETE))))
    out = last.withColumns({
        "skip_reason": reason,
        "lo": (F.col("cell") + 1) * F.lit(interval_ns),
        "hi": F.col("_next_cell") * F.lit(interval_ns)})
    # least() skips NULL, and the last cell of a file (no next cell) governs nothing.
    fresh = F.when(F.col("hi").isNotNull(), F.least(
        F.col("hi"), F.expr(f"(recv_ns + {max_age_ns}L) div {interval_ns}L * {interval_ns}L")))
    complete_recv = (F.when(F.col("skip_reason") == STALE, F.col("recv_ns"))
                     .when((F.col("skip_reason") == INCOMPLETE) & (done_class == GOOD), F.col("_done.recv_ns")))
    out = out.withColumns({
        "emit_hi": F.when((F.col("skip_reason") == STALE) & (fresh >= F.col("lo")), fresh),
        "complete_recv_ns": complete_recv})
    return out.drop("_class", "_bad_seq", "_then", "_done", "_next_cell")


def grid_snapshots(book: DataFrame, interval_ns: int, max_age_ns: int, seq_chunk: int = SEQ_CHUNK, columns: tuple = tuple(BOOK_COLUMNS)) -> DataFrame:
    """One snapshot per grid point whose governing message is a fresh good book, with the given book columns."""
    rows = governed(book, interval_ns, max_age_ns, seq_chunk, (*HEAD, *columns)).where("emit_hi is not null")
    rows = rows.withColumn("ts_ns", F.explode(F.expr(f"sequence(lo, emit_hi, {interval_ns}L)")))
    return rows.select(
        *SOURCE, "symbol", "ts_ns", F.col("event_ns").alias("source_event_ns"), F.col("recv_ns").alias("source_recv_ns"),
        "sequence", F.col("flags").alias("source_flags"), ((F.col("ts_ns") - F.col("recv_ns")) / MS).alias("age_ms"),
        *columns)


def grid_ranges(book: DataFrame, interval_ns: int, max_age_ns: int, seq_chunk: int = SEQ_CHUNK) -> DataFrame:
    """Every grid point accounted for: emitted points one by one, missing runs as ranges."""
    rows = governed(book, interval_ns, max_age_ns, seq_chunk).where("hi >= lo")
    step = F.lit(interval_ns)
    piece = lambda start, end, status, done: F.struct(
        start.alias("start_ns"), end.alias("end_ns"), status.alias("status"), done.alias("complete_recv_ns"))
    points = F.transform(
        F.when(F.col("emit_hi").isNotNull(), F.expr(f"sequence(lo, emit_hi, {interval_ns}L)")).otherwise(F.array().cast("array<bigint>")),
        lambda b: piece(b, b + step, F.lit("emitted"), F.col("recv_ns")))
    gap_start = F.coalesce(F.col("emit_hi") + step, F.col("lo"))
    gap = F.when(gap_start <= F.col("hi"), F.array(
        piece(gap_start, F.col("hi") + step, F.col("skip_reason"), F.col("complete_recv_ns"))))
    pieces = F.when(gap.isNotNull(), F.concat(points, gap)).otherwise(points)
    return rows.select(*SOURCE, F.explode(pieces).alias("p"), F.col("recv_ns").alias("trusted_recv_ns")).select(
        *SOURCE, "p.*", "trusted_recv_ns")


def sampling_stats(book: DataFrame, interval_ns: int, max_age_ns: int, seq_chunk: int = SEQ_CHUNK) -> DataFrame:
    """Counts per source file: records, snapshots, skipped points by reason, bad messages."""
    rows = governed(book, interval_ns, max_age_ns, seq_chunk).withColumns({
        "emitted": F.coalesce(F.expr(f"(emit_hi - lo) div {interval_ns}L + 1"), F.lit(0)),
        "points": F.coalesce(F.expr(f"(hi - lo) div {interval_ns}L + 1"), F.lit(0))})
    skipped = F.col("points") - F.col("emitted")
    reliable = rows.groupBy(*SOURCE).agg(
        F.sum("records").alias("trusted"), F.sum("bad_books").alias("bad_books"),
        F.sum("emitted").alias("snapshots"), F.sum(skipped).alias("skipped_intervals"),
        *[F.sum(F.when(F.col("skip_reason") == r, skipped).otherwise(0)).alias(r) for r in SKIP_REASONS])
    bad = book.where(_bad_clock()).groupBy(*SOURCE).agg(
        F.count(F.lit(1)).alias("unreliable"), F.count_if(has_bit(F.col("flags"), FLAG_LAST)).alias("bad_last"))
    zero = lambda c: F.coalesce(F.col(c), F.lit(0).cast("bigint"))
    return reliable.join(bad, SOURCE, "full").select(
        *SOURCE, (zero("trusted") + zero("unreliable")).alias("source_records"), zero("snapshots").alias("snapshots"),
        zero("skipped_intervals").alias("skipped_intervals"),
        (zero("bad_books") + zero("bad_last")).alias("invalid_completed_books"),
        zero("unreliable").alias("unreliable_receive_records"), *[zero(r).alias(r) for r in SKIP_REASONS])


def order_violations(book: DataFrame, seq_chunk: int = SEQ_CHUNK) -> DataFrame:
    """Trusted messages received before the trusted message ahead of them."""
    trusted = book.where(~_bad_clock()).select(*SOURCE, "seq", "recv_ns")
    seen = previous(trusted, SOURCE, "seq", seq_chunk, "previous_recv_ns", "recv_ns")
    return seen.where("recv_ns < previous_recv_ns")


def age_ladder(snapshots: DataFrame, ages_ms: list[int]) -> DataFrame:
    """Copies of snapshots sampled at the widest age, one per age they satisfy."""
    ages = F.array(*[F.lit(a).cast("bigint") for a in ages_ms])
    return snapshots.withColumn("max_age_ms", F.explode(F.filter(ages, lambda a: F.col("age_ms") <= a)))


def prefix(book: DataFrame, count: int, seq_chunk: int = SEQ_CHUNK) -> DataFrame:
    """First ``count`` records of every source file, tagged as a partial input.

    Chunk sizes (a key-only aggregate) tell which chunks can hold them; other
    chunks are dropped by a join on small rows before anything is shuffled.
    """
    keyed = book.withColumn("_chunk", chunk_of("seq", seq_chunk))
    sizes = keyed.groupBy(*SOURCE, "_chunk").agg(F.count(F.lit(1)).alias("_n"))
    earlier = Window.partitionBy(*SOURCE).orderBy("_chunk").rowsBetween(Window.unboundedPreceding, -1)
    head = sizes.select(*SOURCE, "_chunk", F.coalesce(F.sum("_n").over(earlier), F.lit(0)).alias("_before")).where(F.col("_before") < count)
    local = Window.partitionBy(*SOURCE, "_chunk").orderBy("seq")
    rows = keyed.join(head, [*SOURCE, "_chunk"]).withColumn("record", F.row_number().over(local) + F.col("_before"))
    return rows.where(F.col("record") <= count).select(*book.columns, "record", F.lit(True).alias("partial_prefix"))
