"""CRC-32 of many byte ranges at once: ranges advance together, longest first, one table step a byte."""

from __future__ import annotations

import zlib

import numpy as np

_byte = np.arange(256, dtype=np.uint32)
for _ in range(8):
    _byte = np.where(_byte & 1, (_byte >> 1) ^ np.uint32(0xEDB88320), _byte >> 1)  # fixed value: the reflected polynomial
STEP = _byte.astype(np.uint32)
LONG = 64


def crc32_ranges(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, before: np.ndarray | int = 0) -> np.ndarray:
    """Checksum of each range ``data[starts:ends]``, continued from the checksum ``before`` of what precedes it."""
    lengths = ends - starts
    state = np.broadcast_to(np.asarray(before, np.uint32), lengths.shape) ^ np.uint32(0xFFFFFFFF)
    order = np.argsort(-lengths, kind="stable")
    lengths, starts, state = lengths[order], starts[order], state[order]
    most = int(lengths[0]) if len(lengths) else 0
    alive = np.searchsorted(-lengths, -np.arange(1, min(most, LONG) + 1), side="right")
    for j, n in enumerate(alive.tolist()):
        s = state[:n]
        state[:n] = STEP[(s ^ data[starts[:n] + j]) & np.uint32(255)] ^ (s >> np.uint32(8))
    out = np.empty(len(order), np.uint32)
    out[order] = state ^ np.uint32(0xFFFFFFFF)
    for i in np.flatnonzero(lengths > LONG).tolist():  # the rest of a long range in one call
        at = order[i]
        out[at] = zlib.crc32(data[starts[i] + LONG:starts[i] + lengths[i]].tobytes(), int(out[at]))
    return out
