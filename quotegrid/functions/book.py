"""Book predicates and per-snapshot features as column expressions."""

from __future__ import annotations

from functools import reduce
from operator import add, and_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quotegrid.params import (ASK_PX, ASK_SZ, BASE_FEATURES, BID_PX, BID_SZ, FEATURE_GROUPS, FLAG_BAD_CLOCK, FLAG_LAST,
                              FLAG_MAYBE_BAD_BOOK, LEVEL_WEIGHTS, LIBRARY_FEATURES)

# Message classes: unreliable clock, open event, flagged book, invalid book, good book.
UNRELIABLE, OPEN, FLAGGED, INVALID, GOOD = 0, 1, 2, 3, 4
CLASS_NAMES = {UNRELIABLE: "U", OPEN: "O", FLAGGED: "B", INVALID: "B", GOOD: "G"}


def r6(value: Column) -> Column:
    """Round to six digits; adding zero removes a negative zero."""
    return F.round(value, 6) + F.lit(0.0)


def has_bit(flags: Column, bit: int) -> Column:
    return flags.bitwiseAND(F.lit(bit)) != 0


def finite(value: Column) -> Column:
    """Present, not NaN and not infinite; NULL counts as not finite."""
    return F.coalesce(F.abs(value) < F.lit(float("inf")), F.lit(False))


def valid_book() -> Column:
    """Ten finite prices and sizes, positive uncrossed best quotes, no negative size."""
    checks = [finite(F.col(c)) for c in BID_PX + ASK_PX]
    checks += [finite(F.col(c).cast("double")) & (F.col(c) >= 0) for c in BID_SZ + ASK_SZ]
    checks += [F.col(BID_PX[0]) > 0, F.col(ASK_PX[0]) >= F.col(BID_PX[0]),
               F.col(BID_SZ[0]) > 0, F.col(ASK_SZ[0]) > 0]
    return reduce(and_, checks)


def message_class() -> Column:
    flags = F.col("flags")
    return (F.when(has_bit(flags, FLAG_BAD_CLOCK), UNRELIABLE)
            .when(~has_bit(flags, FLAG_LAST), OPEN)
            .when(has_bit(flags, FLAG_MAYBE_BAD_BOOK), FLAGGED)
            .when(~valid_book(), INVALID)
            .otherwise(GOOD))


def class_name(code: Column) -> Column:
    return (F.when(code == UNRELIABLE, "U").when(code == OPEN, "O")
            .when(code.isin(FLAGGED, INVALID), "B").otherwise("G"))


def total(columns: list[str]) -> Column:
    return reduce(add, [F.col(c).cast("double") for c in columns])


def weighted(columns: list[str]) -> Column:
    return reduce(add, [F.col(c).cast("double") * F.lit(w) for c, w in zip(columns, LEVEL_WEIGHTS)])


def with_mid_spread(df: DataFrame) -> DataFrame:
    bid, ask = F.col(BID_PX[0]), F.col(ASK_PX[0])
    mid = (ask + bid) / 2
    return df.withColumns({"mid_price": mid, "spread": ask - bid, "rel_spread": (ask - bid) / mid})


def with_obi_l1(df: DataFrame) -> DataFrame:
    bid, ask = F.col(BID_SZ[0]).cast("double"), F.col(ASK_SZ[0]).cast("double")
    return df.withColumn("obi_l1", (bid - ask) / (bid + ask))


def with_obi_multi(df: DataFrame) -> DataFrame:
    bid, ask = weighted(BID_SZ), weighted(ASK_SZ)
    return df.withColumn("obi_multi", (bid - ask) / (bid + ask))


def with_micro_dev(df: DataFrame) -> DataFrame:
    """Expects mid_price and spread."""
    bid_px, ask_px = F.col(BID_PX[0]), F.col(ASK_PX[0])
    bid_sz, ask_sz = F.col(BID_SZ[0]), F.col(ASK_SZ[0])
    micro = (ask_px * bid_sz + bid_px * ask_sz) / (bid_sz + ask_sz)
    return df.withColumn("micro_dev", (micro - F.col("mid_price")) / (F.col("spread") + F.lit(1e-8)))


def with_displayed_depth(df: DataFrame) -> DataFrame:
    return df.withColumn("displayed_depth", total(BID_SZ + ASK_SZ))


def all_finite(columns: list[str]) -> Column:
    return reduce(and_, [finite(F.col(c)) for c in columns])


def with_feature_valid(df: DataFrame) -> DataFrame:
    return df.withColumn("feature_valid", all_finite(BASE_FEATURES))


def with_library_valid(df: DataFrame) -> DataFrame:
    return df.withColumn("library_valid", F.col("feature_valid") & all_finite(LIBRARY_FEATURES))


def with_feature_vectors(df: DataFrame) -> DataFrame:
    """One array column per library feature group."""
    return df.withColumns({f"x_{name}": F.array(*columns) for name, columns in FEATURE_GROUPS.items()})
