"""A bit filter of bounded size over 64-bit keys, built by tasks and combined in a tree.

It only spares moving rows that a later exact join would drop: it may let through keys it does not hold, never the
other way round.  Past ``MOST_BITS`` it lets more through, and the join has more to do.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from quotegrid.llm.arrays import mix

MOST_BITS = 1 << 28


def slots(keys: np.ndarray, bits: int) -> list[np.ndarray]:
    x = keys.view(np.uint64)
    return [(mix(x + np.uint64(k)) & np.uint64(bits - 1)).astype(np.int64) for k in (1, 2, 3)]


def contains(filter_: np.ndarray, keys: np.ndarray) -> np.ndarray:
    hit = np.ones(len(keys), bool)
    for at in slots(keys, len(filter_) * 8):
        hit &= (filter_[at >> 3] >> (at & 7).astype(np.uint8)) & 1 == 1
    return hit


def build(table: DataFrame, column: str) -> np.ndarray:
    """Filter of a written table's column, 16 bits a key up to ``MOST_BITS``."""
    bits = min(MOST_BITS, 1 << max(16, (16 * table.count()).bit_length()))

    def fill(batches):
        out = np.zeros(bits // 8, np.uint8)
        for batch in batches:
            for at in slots(batch.column(0).to_numpy(), bits):
                np.bitwise_or.at(out, at >> 3, (1 << (at & 7)).astype(np.uint8))
        yield pa.RecordBatch.from_arrays([pa.array([out.tobytes()], pa.binary())], names=["bits"])

    def join(batches):
        out = np.zeros(bits // 8, np.uint8)
        for batch in batches:
            for x in batch.column("bits"):
                out |= np.frombuffer(x.as_buffer(), np.uint8)
        yield pa.RecordBatch.from_arrays([pa.array([out.tobytes()], pa.binary())], names=["bits"])

    keys = table.select(column)
    n = keys.rdd.getNumPartitions()
    parts = keys.mapInArrow(fill, "bits binary")
    while n > 1:
        n = -(-n // 8)
        parts = parts.repartition(n).mapInArrow(join, "bits binary")
    out = np.zeros(bits // 8, np.uint8)
    for r in parts.collect():  # one filter of fixed size
        out |= np.frombuffer(r["bits"], np.uint8)
    return out
