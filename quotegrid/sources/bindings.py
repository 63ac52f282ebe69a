"""Order-book shaped views of the given tables.

``events`` plays the message file: one instrument, one source file per UTC day.
Every study table below is derived from it with the library's own operators.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quotegrid.params import ASK_PX, ASK_SZ, BID_PX, BID_SZ, LEVELS, Protocol

# Minutes stand in for the half seconds of a real message file.
STUDY = Protocol(
    interval_ms=60_000, ages_ms=(60_000, 300_000, 1_200_000), horizons_ms=(300_000, 900_000, 2_700_000),
    purge_ms=2_700_000, latency_ms=60_000, period_ms=1_800_000)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def epoch_ns(column: str):
    """Nanoseconds of a zone-less timestamp, independent of the session time zone."""
    return F.expr(f"timestampdiff(MICROSECOND, TIMESTAMP_NTZ'1970-01-01 00:00:00', CAST({column} AS TIMESTAMP_NTZ))") * 1000


def messages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Book messages with all columns of a ten-level file that sampling reads."""
    return as_messages(table(spark, sf_dir, "events"))


def message_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same messages as a file stream."""
    schema = table(spark, sf_dir, "events").schema
    return as_messages(spark.readStream.schema(schema).option("pathGlobFilter", "events.parquet").parquet(sf_dir))


def as_messages(events: DataFrame) -> DataFrame:
    k = F.get_json_object("props", "$.k").cast("int")
    keyed = events.select(
        F.col("event_id").alias("seq"), F.col("event_id").alias("sequence"), F.lit(1).cast("bigint").alias("instrument_id"),
        F.lit("EVT").alias("symbol"), F.col("ts").cast("date").cast("string").alias("file_date"),
        epoch_ns("ts").alias("recv_ns"), epoch_ns("ts").alias("event_ns"), k.alias("k"),
        F.round(F.lit(100) + F.col("value"), 2).alias("_px"), "user_id", "event_type")
    k = F.col("k")
    flags = F.when(k % 25 == 0, 136).when(k % 20 == 1, 132).when(k % 10 == 3, 0).otherwise(128)
    ask = F.col("_px") + F.when(k % 33 == 7, F.lit(-0.25)).otherwise(F.lit(0.25) * (1 + k % 3))
    levels = range(LEVELS)
    return keyed.select(
        "seq", "sequence", "instrument_id", "symbol", "file_date", "recv_ns", "event_ns", flags.alias("flags"), "k",
        "user_id", "event_type",
        *[(F.col("_px") - F.lit(0.25 * i)).alias(BID_PX[i]) for i in levels],
        *[(ask + F.lit(0.25 * i)).alias(ASK_PX[i]) for i in levels],
        *[(1 + (k + 3 * i) % 7).cast("bigint").alias(BID_SZ[i]) for i in levels],
        *[(1 + (k + 5 * i) % 11).cast("bigint").alias(ASK_SZ[i]) for i in levels])
