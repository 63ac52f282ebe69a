"""Vectorised helpers over Arrow string columns: bytes, words, hashes."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

# The white space that separates words.
SPACE = np.zeros(256, dtype=bool)
SPACE[[0x20, *range(0x09, 0x0E)]] = True


def one_array(column) -> pa.Array:
    return column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column


def text_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes of all rows back to back and the n + 1 row borders; null is empty."""
    column = pc.fill_null(one_array(column), "").cast(pa.large_string())
    borders = np.frombuffer(column.buffers()[1], dtype=np.int64, count=column.offset + len(column) + 1)[column.offset:]
    raw = column.buffers()[2]
    data = np.frombuffer(raw, dtype=np.uint8) if raw is not None and raw.size else np.zeros(0, dtype=np.uint8)
    return data[borders[0]:borders[-1]], borders - borders[0]


def mix(x: np.ndarray) -> np.ndarray:
    """Splitmix64 finaliser."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def lower_ascii(data: np.ndarray) -> np.ndarray:
    return np.where((data >= 65) & (data <= 90), data + 32, data).astype(np.uint8)


def words_of(data: np.ndarray, borders: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start and end byte of every word and the n + 1 borders of the rows in the word list."""
    if not len(data):
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(len(borders), np.int64)
    inside = ~SPACE[data]
    first = inside.copy()
    first[1:] &= ~inside[:-1]
    last = inside.copy()
    last[:-1] &= ~inside[1:]
    edges = borders[(borders > 0) & (borders < len(data))]
    first[edges] = inside[edges]
    last[edges - 1] = inside[edges - 1]
    starts = np.flatnonzero(first)
    return starts, np.flatnonzero(last) + 1, np.searchsorted(starts, borders)


def word_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """64-bit hash of each byte range, by prefix sums of a polynomial modulo 2^64."""
    if not len(starts):
        return np.zeros(0, np.uint64)
    base = np.uint64(0x9E3779B97F4A7C15)
    inverse = np.uint64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))
    out = np.empty(len(starts), np.uint64)
    step = 1 << 18  # words at a time, so that the work arrays stay small
    for a in range(0, len(starts), step):
        s, e = starts[a:a + step], ends[a:a + step]
        lo, hi = int(s[0]), int(e[-1])
        powers = np.full(hi - lo, base, np.uint64)
        powers[0] = 1
        np.cumprod(powers, out=powers)
        total = np.zeros(hi - lo + 1, np.uint64)
        np.cumsum((data[lo:hi].astype(np.uint64) + np.uint64(1)) * powers, out=total[1:])
        back = np.full(hi - lo, inverse, np.uint64)
        back[0] = 1
        np.cumprod(back, out=back)
        out[a:a + step] = mix((total[e - lo] - total[s - lo]) * back[s - lo] + (e - s).astype(np.uint64) * np.uint64(0xD1B54A32D192ED03))
    return out


def shingle_sets(column: pa.Array, width: int) -> list[np.ndarray]:
    """Sorted distinct 64-bit hashes of each row's ``width``-word shingles; a shorter
    row has its whole sequence as one shingle, a row without words none."""
    data, borders = text_bytes(column)
    starts, ends, rows = words_of(data, borders)
    words = word_hashes(lower_ascii(data), starts, ends)
    factors = mix(np.arange(1, width + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)) | np.uint64(1)
    total = np.zeros(len(words), np.uint64)
    for j in range(width):
        total[:max(0, len(words) - j)] += words[j:] * factors[j]
    total = mix(total)
    out = []
    for a, b in zip(rows[:-1].tolist(), rows[1:].tolist()):
        n = b - a
        if n >= width:
            out.append(np.unique(total[a:b - width + 1]))
        elif n:
            short = (words[a:b] * factors[:n]).sum(dtype=np.uint64) + np.uint64(n)
            out.append(mix(np.array([short], np.uint64)))
        else:
            out.append(np.zeros(0, np.uint64))
    return out


def rows_by(batches, most_bytes: int = 4 << 20):
    """Cut Arrow batches so that the strings of one piece stay under ``most_bytes`` (one row at least)."""
    for batch in batches:
        rows = max(1, batch.num_rows if batch.nbytes <= most_bytes else batch.num_rows * most_bytes // batch.nbytes)
        for a in range(0, batch.num_rows, rows):
            yield batch.slice(a, rows)
        pa.default_memory_pool().release_unused()  # workers live on
