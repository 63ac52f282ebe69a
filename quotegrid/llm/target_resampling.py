"""Target-distribution importance resampling with deduplicated text segments.

Hashed word n-grams of a corpus are weighed against those of a target text set; documents are drawn by Gumbel
top-k.  New lines cut a text into lines, and equal lines have equal counts: lines are grouped over the whole corpus,
each distinct line's features are hashed once and multiplied by its occurrences.  The n-gram that joins the last word
of a line with the first one of the next line that has words lies in no line; these are counted apart, per document.
A document's weight is the sum over its distinct lines, hashed once per batch, and its joints.

Features are runs of one or two words.  Counts, gains and the bucket table have a fixed size.

Defined results: null text, or text without words, has no features and weight 0.  A null id counts as empty text in the
draw and comes first in ties.  Repeated rows count again and get ranks of their own.  Empty tables: without documents
an empty result, without target texts gains against a target of no features.  Extra columns are not read.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, functions as F

from quotegrid.llm.arrays import lower_ascii, one_array, rows_by, text_bytes
from quotegrid.llm.checksums import crc32_ranges
from quotegrid.operators.ordered import row_numbers

BUCKETS = 10_000
#: Bytes of words, that is a-z, 0-9 and everything outside ASCII (texts are lower-cased before).
WORD_BYTES = np.zeros(256, bool)
WORD_BYTES[0x30:0x3A] = WORD_BYTES[0x61:0x7B] = WORD_BYTES[0x80:] = True


class Text:
    """Words of some texts: row, line (its number among all lines) and checksum of each."""

    def __init__(self, column):
        data, self.borders = text_bytes(column)
        self.data = lower_ascii(data)
        inside = WORD_BYTES[self.data]
        first = inside.copy()
        first[1:] &= ~inside[:-1]
        last = inside.copy()
        last[:-1] &= ~inside[1:]
        cuts = self.borders[(self.borders > 0) & (self.borders < len(data))]
        first[cuts] = inside[cuts]
        last[cuts - 1] = inside[cuts - 1]
        self.starts, self.ends = np.flatnonzero(first), np.flatnonzero(last) + 1
        self.row = np.searchsorted(self.borders, self.starts, side="right") - 1
        breaks = np.cumsum(self.data == 10)
        self.line = breaks[self.starts] + self.row if len(self.starts) else np.zeros(0, np.int64)  # grows at both kinds of border

    def singles(self) -> np.ndarray:
        return crc32_ranges(self.data, self.starts, self.ends) % np.uint32(BUCKETS)

    def pairs(self, at: np.ndarray) -> np.ndarray:
        """Buckets of the words at ``at`` with the words after them."""
        used, place = np.unique(at, return_inverse=True)
        first = crc32_ranges(self.data, self.starts[used], self.ends[used])
        with_blank = crc32_ranges(np.array([32], np.uint8), np.zeros(len(used), np.int64), np.ones(len(used), np.int64), first)
        return crc32_ranges(self.data, self.starts[at + 1], self.ends[at + 1], with_blank[place]) % np.uint32(BUCKETS)

    def neighbours(self, same_line: bool) -> np.ndarray:
        """Places of words followed by one of their row: in the same line, or in a later one."""
        if not len(self.row):
            return np.zeros(0, np.int64)
        together = self.row[1:] == self.row[:-1]
        return np.flatnonzero(together & ((self.line[1:] == self.line[:-1]) == same_line))


def split_lines(column) -> tuple[np.ndarray, np.ndarray, pa.Array]:
    """Owner row and code of every line, and the distinct lines."""
    parts = pc.split_pattern(pc.fill_null(one_array(column), ""), "\n")
    coded = pc.dictionary_encode(parts.flatten())
    owner = np.repeat(np.arange(len(parts)), pc.list_value_length(parts).to_numpy(zero_copy_only=False))
    return owner, coded.indices.to_numpy(zero_copy_only=False).astype(np.int64), coded.dictionary


def line_features(lines) -> tuple[np.ndarray, np.ndarray]:
    """(line, bucket) of every feature within the given lines."""
    text = Text(lines)
    at = text.neighbours(True)
    return np.concatenate([text.row, text.row[at]]), np.concatenate([text.singles(), text.pairs(at)]).astype(np.int64)


def _table(sums: np.ndarray) -> pa.RecordBatch:
    at = np.flatnonzero(sums)
    return pa.RecordBatch.from_arrays([pa.array(at, pa.int32()), pa.array(sums[at], pa.int64())], names=["bucket", "n"])


def feature_counts(docs: DataFrame) -> np.ndarray:
    """Occurrences of each bucket over all texts; the table has ``BUCKETS`` entries."""

    def lines(batches):
        for batch in rows_by(batches):
            _, code, distinct = split_lines(batch.column("text"))
            yield pa.RecordBatch.from_arrays([distinct.cast(pa.string()), pa.array(np.bincount(code, minlength=len(distinct)))], names=["line", "times"])

    def within(batches):
        sums = np.zeros(BUCKETS, np.int64)
        for batch in rows_by(batches):
            line, bucket = line_features(batch.column("line"))
            times = batch.column("times").to_numpy()
            np.add.at(sums, bucket, times[line])
        yield _table(sums)

    def across(batches):
        sums = np.zeros(BUCKETS, np.int64)
        for batch in rows_by(batches):
            text = Text(batch.column("text"))
            sums += np.bincount(text.pairs(text.neighbours(False)), minlength=BUCKETS)
        yield _table(sums)

    texts = docs.select("text").where("text is not null")
    grouped = texts.mapInArrow(lines, "line string, times long").where("line <> ''").groupBy("line").agg(F.sum("times").alias("times"))
    counted = grouped.mapInArrow(within, "bucket int, n long").unionByName(texts.mapInArrow(across, "bucket int, n long"))
    out = np.zeros(BUCKETS, np.int64)
    for r in counted.groupBy("bucket").agg(F.sum("n").alias("n")).collect():  # BUCKETS rows at most
        out[r["bucket"]] = r["n"]
    return out


def bucket_gains(corpus: np.ndarray, target: np.ndarray) -> np.ndarray:
    """Floored thousandfold log ratio of smoothed shares, per bucket."""
    s_all, t_all = int(corpus.sum()) + BUCKETS, int(target.sum()) + BUCKETS
    return np.array([math.floor(1000 * math.log(float((t + 1) * s_all) / float((s + 1) * t_all))) for s, t in zip(corpus.tolist(), target.tolist())], np.int64)


def weigh_documents(docs: DataFrame, gains: np.ndarray) -> DataFrame:
    """doc_id, n_words, n_features, weight of every document."""
    shared = docs.sparkSession.sparkContext.broadcast(gains)  # BUCKETS numbers

    def weigh(batches):
        gain = shared.value
        for batch in rows_by(batches):
            owner, code, distinct = split_lines(batch.column("text"))
            line, bucket = line_features(distinct)
            of_line = np.zeros(len(distinct), np.int64)
            np.add.at(of_line, line, gain[bucket])
            total = np.zeros(batch.num_rows, np.int64)
            np.add.at(total, owner, of_line[code])
            text = Text(batch.column("text"))
            joint = text.neighbours(False)
            np.add.at(total, text.row[joint], gain[text.pairs(joint)])
            words = np.bincount(text.row, minlength=batch.num_rows)
            features = np.maximum(0, 2 * words - 1)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(words), pa.array(features), pa.array(total // np.maximum(1, features))], names=["doc_id", "n_words", "n_features", "weight"])

    id_type = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text").mapInArrow(weigh, f"doc_id {id_type}, n_words long, n_features long, weight long")


def resample(docs: DataFrame, target: DataFrame, share: int = 25, least_words: int = 20, seed: int = 7) -> DataFrame:
    """Every document with its weight, score and, where drawn, rank.  ``share`` percent of the documents of at least
    ``least_words`` words are drawn, by highest score."""
    weights = weigh_documents(docs, bucket_gains(feature_counts(docs), feature_counts(target)))
    name = F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("doc_id").cast("string"), F.lit("")))
    h = F.conv(F.substring(F.sha2(name.cast("binary"), 256), 1, 8), 16, 10).cast("double")
    noise = F.floor(-1000 * F.log(-F.log((h + 0.5) / F.lit(4294967296.0))))
    scored = weights.withColumns({"score": (F.col("weight") + noise).cast("long"), "_in": F.col("n_words") >= least_words})
    ranked = row_numbers(scored, F.col("_in").desc(), F.col("score").desc(), F.col("doc_id").asc(), name="_rank")
    drawn = ranked.where("_in").count() * share // 100
    return ranked.select("doc_id", "n_features", "weight", "score", F.when(F.col("_rank") <= drawn, F.col("_rank")).alias("rank"))


def op13_query(spark, sf_dir: str) -> DataFrame:
    return resample(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
