"""Ordered computations over groups too large for one task.

A group (say one instrument on one day) is cut into chunks of its order column.
Each chunk is windowed on its own; one small row per chunk carries the state
over the chunk border.  Nothing is ever windowed by the whole group except those
chunk rows, so a group holding a third of the table still spreads over tasks.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quotegrid.params import SECOND
from quotegrid.session import settle

BEFORE = Window.unboundedPreceding


def chunk_of(on: str, width: int) -> Column:
    """Chunk number of an ordering value."""
    return F.expr(f"{on} div {int(width)}L")


def running_total(df: DataFrame, by: list[str], on: str, width: int, **totals: Column) -> DataFrame:
    """Add running sums (current row included) in ``on`` order within ``by``.

    ``on`` must be unique within ``by``.  The chunk totals come from a partial
    aggregate that reads only the key, order and summed columns.
    """
    keyed = df.withColumn("_chunk", chunk_of(on, width))
    for name, value in totals.items():
        keyed = keyed.withColumn(f"_v_{name}", F.coalesce(value, F.lit(0)))
    offsets = keyed.groupBy(*by, "_chunk").agg(*[F.sum(f"_v_{n}").alias(f"_s_{n}") for n in totals])
    earlier = Window.partitionBy(*by).orderBy("_chunk").rowsBetween(BEFORE, -1)
    offsets = offsets.select(
        *by, "_chunk",
        *[F.coalesce(F.sum(f"_s_{n}").over(earlier), F.lit(0)).alias(f"_o_{n}") for n in totals])
    local = Window.partitionBy(*by, "_chunk").orderBy(on).rowsBetween(BEFORE, 0)
    out = keyed.select("*", *[F.sum(f"_v_{n}").over(local).alias(f"_l_{n}") for n in totals])
    out = out.join(offsets, [*by, "_chunk"])
    return out.select(*df.columns, *[(F.col(f"_o_{n}") + F.col(f"_l_{n}")).alias(n) for n in totals])


def ordinal(df: DataFrame, by: list[str], on: str, width: int, name: str = "rn") -> DataFrame:
    """1-based position of each row within ``by``."""
    return running_total(df, by, on, width, **{name: F.lit(1)})


def row_numbers(df: DataFrame, *order: str | Column, name: str = "rn") -> DataFrame:
    """1-based position of each row in the order of the whole table.

    Rows are range partitioned and written with their range, each range is numbered on its own and moved by the rows
    of the ranges before it (one number per range, added up by the driver).  No window spans the table.  Rows equal in
    all of ``order`` share a range, so let a key stand at its end; their numbers are distinct but arbitrary.
    """
    placed = settle(df.repartitionByRange(*order).withColumn("_range", F.spark_partition_id()), "ranges")
    counts = {r["_range"]: r["count"] for r in placed.groupBy("_range").count().collect()}
    before, offsets = 0, [0]
    for i in range(max(counts, default=0) + 1):
        offsets.append(before)
        before += counts.get(i, 0)
    within = F.row_number().over(Window.partitionBy("_range").orderBy(*order))
    moved = within.cast("long") + F.element_at(F.lit(offsets).cast("array<bigint>"), F.col("_range") + 2)
    return placed.select(*df.columns, moved.alias(name))


def asof(left: DataFrame, right: DataFrame, on: str, by: list[str], values: list[str], *,
         forward: bool = False, strict: bool = False, width: int = 3600 * SECOND) -> DataFrame:
    """Left rows with the ``values`` of the nearest right row in time, else NULL.

    Backward takes the last right row with time <= left time, forward the first
    with time >= left time; ``strict`` leaves out equal times.  ``right`` must be
    unique per ``by`` and ``on``.  Both sides meet in a union that is windowed per
    (by, chunk); a chunk without a match takes the nearest earlier (later) chunk's
    edge row, so long gaps stay exact whatever the chunk width.
    """
    hit = F.struct(F.col(on).alias("_at"), *values)
    r = right.select(*by, F.col(on), chunk_of(on, width).alias("_chunk"), hit.alias("_hit"))
    edge = (F.min_by if forward else F.max_by)("_hit", on)
    nothing = F.lit(None).cast(r.schema["_hit"].dataType)

    edges = r.groupBy(*by, "_chunk").agg(edge.alias("_edge"))
    wanted = left.select(*by, chunk_of(on, width).alias("_chunk")).distinct().withColumn("_edge", nothing)
    chunks = edges.unionByName(wanted).groupBy(*by, "_chunk").agg(F.first("_edge", True).alias("_edge"))
    chunk_order = F.col("_chunk").desc() if forward else F.col("_chunk").asc()
    outside = Window.partitionBy(*by).orderBy(chunk_order).rowsBetween(BEFORE, -1)
    carry = chunks.select(*by, "_chunk", F.last("_edge", True).over(outside).alias("_carry"))

    right_first = 1 if strict else -1
    rows = left.withColumn("_chunk", chunk_of(on, width)).withColumn("_side", F.lit(0)).withColumn("_hit", nothing)
    both = rows.unionByName(r.withColumn("_side", F.lit(right_first)), allowMissingColumns=True)
    # The forward case walks time backwards: a frame ending at the current row is
    # updated in place, one reaching to the end would be recomputed for each row.
    order = [F.col(on).desc() if forward else F.col(on).asc(), F.col("_side").asc()]
    inside = Window.partitionBy(*by, "_chunk").orderBy(*order).rowsBetween(BEFORE, 0)
    found = both.withColumn("_hit", F.last("_hit", True).over(inside)).where("_side = 0")
    found = found.join(carry, [*by, "_chunk"]).withColumn("_hit", F.coalesce("_hit", "_carry"))
    return found.select(*left.columns, F.col("_hit._at").alias(f"matched_{on}"),
                        *[F.col(f"_hit.{v}").alias(v) for v in values])


def interval_join(left: DataFrame, intervals: DataFrame, at: str, start: str, end: str, *,
                  by: list[str] | None = None, closed: str = "left", how: str = "left",
                  bucket: int = 86_400 * SECOND) -> DataFrame:
    """Join rows to the interval holding ``at``: ``[start, end)`` or ``(start, end]``.

    Intervals are spread over the fixed time buckets they touch, which turns the
    range condition into an equality plus a residual filter.  No broadcast is
    forced: Spark broadcasts the interval side when its own size check allows, and
    otherwise runs a shuffled join whose skewed buckets adaptive execution splits.
    """
    by = by or []
    spread = intervals.withColumn(
        "_bucket", F.explode(F.expr(f"sequence({start} div {bucket}L, {end} div {bucket}L)")))
    right = spread.select(*[F.col(c).alias(f"_r_{c}") for c in spread.columns])
    keyed = left.withColumn("_bucket", chunk_of(at, bucket))
    t, lo, hi = F.col(at), F.col(f"_r_{start}"), F.col(f"_r_{end}")
    inside = (t >= lo) & (t < hi) if closed == "left" else (t > lo) & (t <= hi)
    on = (F.col("_bucket") == F.col("_r__bucket")) & inside
    for c in by:
        on = on & (F.col(c) == F.col(f"_r_{c}"))
    keep = [c for c in intervals.columns if c not in left.columns]
    return keyed.join(right, on, how).select(*left.columns, *[F.col(f"_r_{c}").alias(c) for c in keep])


def exact_offset(df: DataFrame, by: list[str], on: str, offset: int, values: list[str], prefix: str = "target_") -> DataFrame:
    """Join each row to the row exactly ``offset`` later in the same key, else NULL.

    The shifted time is part of the join key, so rows of a hot key still hash apart.
    """
    later = df.select(*by, (F.col(on) - F.lit(offset)).alias(on), *[F.col(v).alias(prefix + v) for v in values])
    return df.join(later, [*by, on], "left")


def previous(df: DataFrame, by: list[str], on: str, width: int, name: str, value: str) -> DataFrame:
    """Value of the row just before, in ``on`` order within ``by`` (``on`` unique)."""
    keyed = df.withColumn("_chunk", chunk_of(on, width))
    edges = keyed.groupBy(*by, "_chunk").agg(F.max_by(value, on).alias("_edge"))
    edges = edges.select(*by, "_chunk", F.lag("_edge").over(Window.partitionBy(*by).orderBy("_chunk")).alias("_carry"))
    place = Window.partitionBy(*by, "_chunk").orderBy(on)
    local = keyed.withColumns({"_head": F.row_number().over(place) == 1, "_prev": F.lag(value).over(place)})
    out = local.join(edges, [*by, "_chunk"])
    return out.select(*df.columns, F.when(F.col("_head"), F.col("_carry")).otherwise(F.col("_prev")).alias(name))
