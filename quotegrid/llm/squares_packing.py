"""Sum-of-squares online packing of token sequences.

Each task packs its documents as they come.  Full windows of a document are sequences of their own; the rest goes
whole to the fill level, among those of the open sequences and an empty one, that minimises the sum over levels of the
squared number of open sequences.  Levels are kept in one array of counts.  When a task ends, or when ``MOST_OPEN``
sequences are open (a bound of memory, 8 kB each), open sequences are put into one another by the same rule; only the
gaps that are left then are filled by cutting the emptiest.  A task pads one sequence at most.

Defined results: null and empty texts are the end id alone.  Repeated rows and null ids are packed like any other;
other columns are ignored.  A very long text is held by one task with its ids; all but its last window are full.  An
empty table gives no rows.
``sequence_id`` is the partition number times 2^40 plus a running number: unique within one run, but not the same for
another partitioning of the input.
"""

from __future__ import annotations

import functools
import struct
import zlib

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame

from quotegrid.llm.arrays import rows_by
from quotegrid.llm.tokens import Cache, library, spaced_units, unit_ids, vocabulary

MOST_OPEN = 4096
SCHEMA = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"


@functools.lru_cache(maxsize=2)
def bytes_of_units(path: str) -> Cache:
    """unit -> little-endian unsigned 32-bit ids."""
    return Cache(lambda units: [struct.pack(f"<{len(ids)}I", *ids) for ids in unit_ids(path, units)])


class Packer:
    """Pieces are (doc_id, start, ids as bytes, doc_tokens); full sequences are handed to ``emit``.

    ``placed`` and ``cut`` count the ids placed and those that closing moved by cutting."""

    def __init__(self, size: int, emit):
        self.size, self.emit = size, emit
        self.count = np.zeros(size + 1, np.int64)
        self.open: list[list[list[tuple]]] = [[] for _ in range(size + 1)]
        self.held = self.placed = self.cut = 0

    def level_for(self, length: int, join: bool = False) -> int:
        """The level whose choice leaves the least sum of squares, of equal ones the fullest; 0 is an empty sequence,
        which ``join`` takes only where nothing else has room."""
        c, least = self.count, self.size - length
        levels = np.flatnonzero(c[:least + 1])  # level 0 has no count
        if not len(levels):
            return 0
        cost = 2 * (c[levels + length] - c[levels]) + 2
        if levels[-1] == least:
            cost[-1] = 1 - 2 * c[least]  # a sequence filled up counts no more
        at = len(levels) - 1 - int(np.argmin(cost[::-1]))
        return int(levels[at]) if join or cost[at] <= 2 * c[length] + 1 else 0

    def place(self, pieces: list[tuple], length: int, join: bool = False) -> None:
        level = self.level_for(length, join) if length < self.size else 0
        held = self.open[level].pop() if level else []
        if level:
            self.count[level] -= 1
            self.held -= 1
        held += pieces
        if level + length == self.size:
            self.emit(held)
        else:
            self.count[level + length] += 1
            self.held += 1
            self.open[level + length].append(held)

    def add(self, piece: tuple, length: int) -> None:
        self.placed += length
        self.place([piece], length)
        if self.held > MOST_OPEN:
            self.close(last=False)

    def close(self, last: bool = True) -> None:
        """Open sequences, the fullest first, go whole into others by the same rule; what has room nowhere is
        filled up by cutting the emptiest.  One sequence stays open, or ends padded if ``last``."""
        for level in range(self.size - 1, 0, -1):
            for _ in range(len(self.open[level])):
                self.count[level] -= 1
                self.held -= 1
                self.place(self.open[level].pop(0), level, join=True)
        left = [(level, held) for level in range(self.size - 1, 0, -1) for held in self.open[level]]
        self.open = [[] for _ in range(self.size + 1)]
        self.count[:] = self.held = 0
        while len(left) > 1:
            room, full = self.size - left[0][0], left[0][1]
            spare, given = left.pop()
            while room and given:
                doc_id, start, ids, total = given.pop()
                take = min(room, len(ids) // 4)
                full.append((doc_id, start, ids[:4 * take], total))
                if len(ids) > 4 * take:
                    given.append((doc_id, start + take, ids[4 * take:], total))
                room, spare, self.cut = room - take, spare - take, self.cut + take
            if given:
                left.append((spare, given))
            if room:
                left[0] = (self.size - room, full)
            else:
                self.emit(full)
                left.pop(0)
        for level, held in left:
            if last:
                self.emit(held)
            else:
                self.count[level] += 1
                self.held += 1
                self.open[level].append(held)


def pack(docs: DataFrame, size: int = 2048, end_id: int = 1, path: str | None = None) -> DataFrame:
    """One row per piece: which ids of which document stand where in which sequence."""
    path = path or vocabulary("byte_bpe_50k.json")
    end = np.array([end_id], dtype="<u4").tobytes()

    def run(batches):
        cache, tokenizer = bytes_of_units(path), library(path)
        out: list[tuple] = []
        number = TaskContext.get().partitionId() << 40

        def emit(held):
            nonlocal number
            at = 0
            for doc_id, start, ids, total in held:
                out.append((doc_id, start, len(ids) // 4, zlib.crc32(ids), total, number, at))
                at += len(ids) // 4
            number += 1

        def rows():
            batch = pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*out)], names=[f.split()[0] for f in SCHEMA.split(", ")])
            out.clear()
            return batch

        packer = Packer(size, emit)
        for batch in rows_by(batches):
            texts = [t or "" for t in batch.column("text").to_pylist()]
            units = list(map(spaced_units, texts))
            cache.load(set().union(*(x for x in units if x)))
            for doc_id, text, x in zip(batch.column("doc_id").to_pylist(), texts, units):
                if x is None:
                    ids = np.array(tokenizer.encode(text, add_special_tokens=False).ids, dtype="<u4").tobytes() + end
                else:
                    ids = b"".join(cache.of(x)) + end
                total = len(ids) // 4
                for start in range(0, total, size):
                    part = ids[4 * start:4 * (start + size)]
                    packer.add((doc_id, start, part, total), len(part) // 4)
            if out:
                yield rows()
        packer.close()
        if out:
            yield rows()

    return docs.selectExpr("cast(doc_id AS long) doc_id", "text").mapInArrow(run, SCHEMA)


def op10_query(spark, sf_dir: str) -> DataFrame:
    return pack(spark.read.parquet(f"{sf_dir}/documents.parquet"))
