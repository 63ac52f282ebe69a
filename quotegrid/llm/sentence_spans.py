"""Substring dedup by sliding sentence spans.

A text is cut into pieces: after sentence marks and line ends, and between them before each word whose hash is the
least among those of ``NEAR`` words on both sides.  Where a cut is depends on the words beside it only, so a passage
is cut alike wherever it stands, but for its first and last words.  From every piece the shortest run of at least
``SENTENCES`` consecutive ones with ``WORDS`` words is hashed, and the shortest one up to every piece.  Runs are joined
over all documents; every piece that a repeated run covers goes, except where the run stands first: in the document
with the least ``doc_id``, at its first place there.  Repeats inside a document that overlap that place stay.

Characters of scripts without blanks are words of half the weight, characters of words over ``LONG`` bytes words of a
sixth.  White space is no part of a run; it goes with the piece before it.

Runs of twelve words and more are joined on 64 bits of hash and not compared again: among a billion runs a chance
match is unlikely, far beyond that some will remove text that is not repeated.  Defined results: null text
stays null, empty text stays empty.  Rows with null ``doc_id`` stay as they are and take no part.  Rows that repeat a
``doc_id`` count as one document: each of them keeps what that document may keep.  Extra columns stay; those named n_sentences, n_removed or _drop are
replaced.  Empty tables give empty results.  Long texts are cut whole.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F, types as T

from quotegrid.llm.arrays import SPACE, mix, rows_by, text_bytes, word_hashes
from quotegrid.session import settle

SENTENCES, WORDS = 3, 12
NEAR, LONG = 2, 40
WEIGHT, HALF, SIXTH = 6, 3, 1  # of a word, of a character without blanks beside it, of one in a long word
# White space and sentence marks beyond ASCII as UTF-8, scripts without blanks by their first two bytes.
BLANKS = [c.encode() for c in "\x85\xa0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000"]
MARKS = [c.encode() for c in "…。！？｡．।॥؟۔։።፧။၊។៕།‼⁇⁈⁉"]
ENDS = np.isin(np.arange(256), list(b".!?"))
CLOSERS = np.isin(np.arange(256), list(b"\"')]}"))
DENSE = np.zeros(1 << 16, bool)
for _first, _last in ((0xE0B8, 0xE0BF), (0xE180, 0xE182), (0xE19E, 0xE19F), (0xE380, 0xE384), (0xE390, 0xE9BF), (0xEFA4, 0xEFAB), (0xEFBC, 0xEFBE), (0xF0A0, 0xF0B3)):
    DENSE[_first:_last + 1] = True


def places(data: np.ndarray, many: list[bytes]) -> list[tuple[np.ndarray, int]]:
    """(positions, length) of each of some characters of two and three bytes."""
    out = []
    for lead in {c[0] for c in many}:
        at = np.flatnonzero(data == lead)
        for c in many:
            if c[0] == lead and len(at):
                here = at[at + len(c) <= len(data)]
                for k in range(1, len(c)):
                    here = here[data[here + k] == c[k]]
                out.append((here, len(c)))
    return out


class Cut:
    """Words and pieces of all rows of a batch; ``first``: the first word of each piece."""

    def __init__(self, column):
        data, borders = text_bytes(column)
        data = np.ascontiguousarray(data)
        n, rows = len(data), len(borders) - 1
        self.data, self.borders = data, borders
        space = SPACE[data] | ((data >= 0x1C) & (data <= 0x1F))
        for at, length in places(data, BLANKS):
            for k in range(length):
                space[at + k] = True
        edge = np.zeros(n + 1, bool)
        edge[borders] = True
        inside = ~space
        opens, shuts = inside.copy(), inside.copy()
        opens[1:] &= space[:-1] | edge[1:-1]
        shuts[:-1] &= space[1:] | edge[1:-1]
        starts, ends = np.flatnonzero(opens), np.flatnonzero(shuts) + 1
        # characters that are words of their own
        dense = np.zeros(n, bool)
        lead = np.flatnonzero(data[:-1] >= 0xE0)
        dense[lead[DENSE[data[lead].astype(np.int64) << 8 | data[lead + 1]]]] = True
        long_ = np.zeros(n + 1, np.int64)
        wide = ends - starts > LONG
        long_[starts[wide]] = 1
        long_[ends[wide]] -= 1
        long_ = np.cumsum(long_[:-1]) > 0
        char = inside & ((data & 0xC0) != 0x80)
        last = np.flatnonzero(char)
        after = np.zeros(n, bool)
        after[last[1:]] = dense[last[:-1]]
        start = np.flatnonzero(opens | (char & (dense | after | long_)))
        # a word ends where the next one starts, or at white space or the row's end
        bound = np.minimum(np.append(start[1:], n), ends[np.searchsorted(ends, start, "right")] if len(start) else start)
        self.start = start
        self.row = np.searchsorted(borders, start, "right") - 1
        self.weight = np.where(dense[start], HALF, np.where(long_[start], SIXTH, WEIGHT))
        self.hash = word_hashes(data, start, bound)
        # sentence starts
        mark = ENDS[data]
        for at, length in places(data, MARKS):
            mark[at + length - 1] = True
        tail = bound - 1
        for _ in range(3):  # closing quotes and brackets
            back = (tail > start) & CLOSERS[data[tail]]
            tail = tail - back
        lines = np.concatenate([[0], np.cumsum(data == 10)])
        fresh = np.ones(len(start), bool)
        fresh[1:] = (self.row[1:] != self.row[:-1]) | mark[tail[:-1]] | (lines[start[1:]] != lines[bound[:-1]])
        level = np.where(fresh, np.uint64(0), self.hash | np.uint64(1))
        low = level.copy()
        top = ~np.uint64(0)
        for k in range(1, NEAR + 1):
            same = self.row[k:] == self.row[:-k]
            low[k:] = np.minimum(low[k:], np.where(same, level[:-k], top))
            low[:-k] = np.minimum(low[:-k], np.where(same, level[k:], top))
        self.first = np.flatnonzero(fresh | (level == low))
        self.rows = np.searchsorted(self.row[self.first], np.arange(rows + 1))  # borders of the rows in the pieces

    def piece_bytes(self) -> np.ndarray:
        """Byte each piece starts at; a row's first one has the white space before it."""
        at = self.start[self.first]
        opens = self.rows[:-1][np.diff(self.rows) > 0]
        at[opens] = self.borders[self.row[self.first[opens]]]
        return at

    def runs(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(hash, first piece, end piece) in order of the first piece."""
        n = len(self.first)
        here = np.arange(n + 1)
        word = np.append(self.first, len(self.start))
        weight = np.concatenate([[0], np.cumsum(self.weight)])[word]
        row = self.row[self.first]
        ends = np.maximum(np.searchsorted(weight, weight[:-1] + WORDS * WEIGHT), here[:-1] + SENTENCES)
        whole = ends <= self.rows[1:][row]
        begins = np.minimum(np.searchsorted(weight, weight[1:] - WORDS * WEIGHT, "right") - 1, here[1:] - SENTENCES)
        good = begins >= self.rows[:-1][row]
        good[good] = ends[begins[good]] != here[1:][good]
        a = np.concatenate([here[:-1][whole], begins[good]])
        b = np.concatenate([ends[whole], here[1:][good]])
        order = np.argsort(a, kind="stable")
        a, b = a[order], b[order]
        powers = np.full(len(self.start) + 1, 0x9E3779B97F4A7C15, np.uint64)
        powers[0] = 1
        powers = np.cumprod(powers)
        total = np.concatenate([np.zeros(1, np.uint64), np.cumsum(self.hash * powers[:-1])])
        back = np.full(len(self.start) + 1, pow(0x9E3779B97F4A7C15, -1, 1 << 64), np.uint64)
        back[0] = 1
        value = mix((total[word[b]] - total[word[a]]) * np.cumprod(back)[word[a]] + (word[b] - word[a]).astype(np.uint64))
        return value.view(np.int64), a, b


def sentences(text: str) -> list[str]:
    """Their concatenation is the text."""
    cut = Cut(pa.array([text]))
    at = cut.piece_bytes().tolist()
    raw = cut.data.tobytes()
    return [raw[a:b].decode() for a, b in zip(at, [*at[1:], len(raw)])] or ([text] if text else [])


def uncovered(cut: Cut, drop: list[np.ndarray | None], known: np.ndarray) -> np.ndarray:
    """Which pieces stay, given each row's hashes of runs that stand first in another document; rows not ``known``
    keep all."""
    value, a, b = cut.runs()
    row = cut.row[cut.first[a]]
    gone = np.zeros(len(value), bool)
    order = np.lexsort((a, value, row))
    if len(order):
        opens = np.concatenate([[True], (value[order][1:] != value[order][:-1]) | (row[order][1:] != row[order][:-1])])
        first_end = b[order][opens][np.cumsum(opens) - 1]
        gone[order] = ~opens & (a[order] >= first_end)
    limits = np.searchsorted(row, np.arange(len(drop) + 1))
    for r, hashes in enumerate(drop):
        if hashes is not None:
            gone[limits[r]:limits[r + 1]] |= np.isin(value[limits[r]:limits[r + 1]], hashes)
    gone &= known[row]
    change = np.zeros(len(cut.first) + 1, np.int64)
    np.add.at(change, a[gone], 1)
    np.add.at(change, b[gone], -1)
    return np.cumsum(change)[:-1] == 0


def run_table(docs: DataFrame) -> DataFrame:
    """(doc_id, run): the distinct runs of each row."""
    def cut(batches):
        for batch in rows_by(batches):
            made = Cut(batch.column("text"))
            value, a, _ = made.runs()
            row = made.row[made.first[a]]
            order = np.lexsort((value, row))
            value, row = value[order], row[order]
            fresh = np.ones(len(value), bool)
            fresh[1:] = (value[1:] != value[:-1]) | (row[1:] != row[:-1])
            yield pa.RecordBatch.from_arrays([pa.array(batch.column("doc_id").to_numpy()[row[fresh]]), pa.array(value[fresh])], names=["doc_id", "run"])

    return docs.where("doc_id is not null and text is not null").select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(cut, "doc_id long, run long")


def drop_repeats(docs: DataFrame) -> DataFrame:
    """The rows with ``text`` cut, and n_sentences, n_removed."""
    docs = docs.drop("n_sentences", "n_removed", "_drop")
    table = settle(run_table(docs), "runs")
    shared = table.groupBy("run").agg(F.min("doc_id").alias("first"), F.max("doc_id").alias("last")).where("first < last").select("run", "first")
    drop = table.join(shared, "run").where(F.col("doc_id") > F.col("first")).select("doc_id", "run").groupBy("doc_id").agg(F.collect_set("run").alias("_drop"))
    fields = T.StructType([*docs.schema.fields, T.StructField("n_sentences", T.LongType()), T.StructField("n_removed", T.LongType())])

    def cut(batches):
        for batch in rows_by(batches):
            made = Cut(batch.column("text"))
            drop = [x.values.to_numpy(zero_copy_only=False) if x.is_valid else None for x in batch.column("_drop")]
            stay = uncovered(made, drop, batch.column("doc_id").is_valid().to_numpy(zero_copy_only=False))
            at = np.append(made.piece_bytes(), 0)
            texts, n, removed = batch.column("text").to_pylist(), np.diff(made.rows), np.zeros(batch.num_rows, np.int64)
            n = np.where((n == 0) & (np.diff(made.borders) > 0), 1, n)  # nothing but white space
            np.add.at(removed, made.row[made.first[~stay]], 1)
            for r in np.flatnonzero(removed).tolist():
                a, b = made.rows[r], made.rows[r + 1]
                ends = np.append(at[a + 1:b], made.borders[r + 1])
                texts[r] = b"".join(made.data[x:y].tobytes() for x, y, s in zip(at[a:b].tolist(), ends.tolist(), stay[a:b].tolist()) if s).decode()
            batch = batch.drop_columns(["_drop"])
            at = batch.schema.get_field_index("text")
            yield pa.RecordBatch.from_arrays([*batch.set_column(at, "text", pa.array(texts, pa.string())).columns, pa.array(n, pa.int64()), pa.array(removed, pa.int64())],
                                             names=[*batch.schema.names, "n_sentences", "n_removed"])

    return docs.join(drop, docs["doc_id"] == drop["doc_id"], "left").select(*[docs[c] for c in docs.columns], "_drop").mapInArrow(cut, fields)


def op5_query(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return drop_repeats(docs)
