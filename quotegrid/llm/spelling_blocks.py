"""Spelling variant grouping by blocked Gram matrices.

Words with an edit of one code point between them keep one half whole: a bucket holds the words of one length and the
next with an equal first half, or an equal second half.  Buckets over ``BUCKET`` words are halved again in the part
still open, until every bucket is small or all but one code point is fixed, so no bucket grows with the data.  Inside
a bucket the words' letter counts form blocks; a NumPy product of two blocks gives all squared distances.  One edit
changes them by 1 (inserted, deleted) or 2 (replaced), so pairs of at most 2 are kept and their edits verified.  A pair
whose halves agree in several buckets is taken from the first only.

Defined results: null text has no words; a null id counts as empty text in the checksum; repeated rows count again;
extra columns are not read; empty tables give an empty result.  Very long runs are checksummed apart.  Ties of a form go
to the smaller word in code-point order.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, functions as F

from quotegrid.llm.arrays import lower_ascii, rows_by, text_bytes
from quotegrid.llm.checksums import crc32_ranges
from quotegrid.session import settle

BUCKET = 2048
#: Words of one Gram block.
BLOCK = 512
#: Columns of the letter counts: 26 letters and U+00C0 to U+00FF.
LETTERS = 26 + 64


def letter_runs(data: np.ndarray, borders: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start, end and row of every run of letters A-Z, a-z, U+00C0 to U+00FF in UTF-8 bytes."""
    inside = ((data | 32) >= 97) & ((data | 32) <= 122)
    inside |= data == 0xC3  # its continuation completes U+00C0 to U+00FF
    inside[1:] |= data[:-1] == 0xC3
    step = np.diff(np.concatenate([[0], inside.view(np.int8), [0]]))
    starts, ends = np.flatnonzero(step == 1), np.flatnonzero(step == -1)
    cuts = borders[1:-1]
    cuts = cuts[(cuts > 0) & (cuts < len(data))]
    cuts = cuts[inside[cuts] & inside[cuts - 1]]  # two texts that touch
    if len(cuts):
        cuts = np.unique(cuts)
        starts, ends = np.sort(np.concatenate([starts, cuts])), np.sort(np.concatenate([ends, cuts]))
    return starts, ends, np.searchsorted(borders, starts, side="right") - 1


def misspelt_words(docs: DataFrame, every: int = 97) -> DataFrame:
    """(word, n): lower-case runs of letters, where ``every`` divides the checksum of ``<doc_id>:<run>`` with one code
    point deleted.  Counts are added up per batch before they are shuffled."""

    def count(batches):
        for batch in rows_by(batches, 8 << 20):
            data, borders = text_bytes(batch.column("text"))
            data = lower_ascii(data)
            starts, ends, row = letter_runs(data, borders)
            ids = pc.fill_null(batch.column("doc_id").cast(pa.string()), "").to_pylist()
            heads = np.array([zlib.crc32(f"{i}:".encode()) for i in ids], np.uint32)
            sums = crc32_ranges(data, starts, ends, heads[row])
            raw = data.tobytes()
            hit = sums % np.uint32(every) == 0
            kept = pa.array(_slices(raw, starts[~hit], ends[~hit]), pa.string())
            deleted = []
            for a, b, h in zip(starts[hit].tolist(), ends[hit].tolist(), sums[hit].tolist()):
                run = raw[a:b].decode()
                at = h % len(run)
                deleted.append(run[:at] + run[at + 1:])
            words = pa.chunked_array([kept, pa.array(deleted, pa.string())]).combine_chunks()
            found = pc.value_counts(words)
            yield pa.RecordBatch.from_arrays([found.field("values"), found.field("counts")], names=["word", "n"])

    counted = docs.select("doc_id", "text").where("text is not null").mapInArrow(count, "word string, n long")
    return counted.where(F.length("word") > 0).groupBy("word").agg(F.sum("n").alias("n"))


def _slices(raw: bytes, starts: np.ndarray, ends: np.ndarray) -> pa.Array:
    """String array of byte ranges that follow each other in ``raw``."""
    if not len(starts):
        return pa.array([], pa.string())
    data = np.frombuffer(raw, np.uint8)
    inside = np.zeros(len(data) + 1, np.int8)
    inside[starts] += 1
    inside[ends] -= 1  # ranges may touch
    kept = data[np.cumsum(inside[:-1]).astype(bool)]
    offsets = np.concatenate([[0], np.cumsum(ends - starts)]).astype(np.int32)
    return pa.StringArray.from_buffers(len(starts), pa.py_buffer(offsets.tobytes()), pa.py_buffer(kept.tobytes()))


def half_buckets(words: DataFrame) -> DataFrame:
    """Rows (word, n, size, head, tail, below, bucket): the word among those of ``size`` and ``size + 1`` code points
    that share its first ``head`` and last ``tail`` ones; where ``below`` is set a pair must differ before it."""
    length = F.length("word")
    sized = words.where(length > 0).select("word", "n", F.explode(F.filter(F.array(length, length - 1), lambda x: x > 0)).alias("size"))
    return _buckets(_halves(sized.withColumns({"head": F.lit(0), "tail": F.lit(0), "below": F.lit(None).cast("int")})))


def _halves(rows: DataFrame) -> DataFrame:
    """Both halves of each row's open part."""
    cut = F.expr("head + (size - head - tail) div 2").cast("int")
    first = F.struct(cut.alias("head"), F.col("tail"), F.col("below"))
    second = F.struct(F.col("head"), (F.col("size") - cut).alias("tail"), cut.alias("below"))
    return rows.withColumn("_half", F.explode(F.array(first, second))).select("word", "n", "size", "_half.*").where("below is null or below > head")


def _buckets(rows: DataFrame) -> DataFrame:
    key = F.xxhash64("size", "head", "tail", "below", F.expr("substr(word, 1, head)"), F.expr("right(word, tail)"))
    return rows.withColumn("bucket", key)


def small_buckets(rows: DataFrame, most: int = BUCKET) -> DataFrame:
    """Buckets of at most ``most`` words, or with one open code point.  Lone words are dropped."""
    done = []
    while True:
        rows = settle(rows, "buckets")
        sizes = rows.groupBy("bucket").agg(F.count("*").alias("_in"), F.max(F.col("size") - F.col("head") - F.col("tail")).alias("_open")).where("_in > 1")
        sizes = settle(sizes.withColumn("_split", (F.col("_in") > most) & (F.col("_open") > 1)), "bucket-sizes")
        marked = rows.join(sizes.select("bucket", "_split"), "bucket")
        done.append(marked.where("not _split").select(*rows.columns))
        if sizes.where("_split").isEmpty():
            break
        rows = _buckets(_halves(marked.where("_split").select(*rows.columns)))
    out = done[0]
    for more in done[1:]:
        out = out.unionByName(more)
    return out


class Words:
    """Letter counts and codes of some words, sorted by bucket."""

    def __init__(self, batch):
        self.word = batch.column("word")
        points = "".join(self.word.to_pylist())
        codes = np.frombuffer(points.encode("utf-32-le"), np.uint32).astype(np.int64)
        self.length = pc.utf8_length(self.word).to_numpy(zero_copy_only=False).astype(np.int64)
        self.start = np.concatenate([[0], np.cumsum(self.length)])[:-1]
        self.codes = codes
        letter = np.where(codes < 128, codes - 97, codes - 0xC0 + 26)
        owner = np.repeat(np.arange(len(self.length)), self.length)
        self.counts = np.bincount(owner * LETTERS + np.clip(letter, 0, LETTERS - 1), minlength=len(self.length) * LETTERS).reshape(-1, LETTERS).astype(np.float64 if self.length.max(initial=0) > 2000 else np.float32)
        self.norm = (self.counts ** 2).sum(axis=1)
        get = lambda name: batch.column(name).fill_null(1 << 30).to_numpy(zero_copy_only=False).astype(np.int64)
        self.n, self.bucket, self.size, self.head, self.tail, self.below = map(get, ("n", "bucket", "size", "head", "tail", "below"))


def near_in(w: Words, block: int = BLOCK):
    """Pairs of places (i, j) of near words in equal buckets."""
    n = len(w.length)
    edges = np.flatnonzero(np.concatenate([[True], w.bucket[1:] != w.bucket[:-1], [True]]))
    ends = np.repeat(edges[1:], np.diff(edges))  # end of each word's bucket
    for a in range(0, n, block):
        b = min(n, a + block)
        for c in range(a, int(ends[b - 1]), block):  # only blocks that the last bucket of this one reaches
            d = min(int(ends[b - 1]), c + block)
            far = w.norm[a:b, None] + w.norm[None, c:d] - 2 * (w.counts[a:b] @ w.counts[c:d].T)
            far[w.bucket[a:b, None] != w.bucket[None, c:d]] = 9
            i, j = np.nonzero(far <= 2.5)
            i, j = i + a, j + c
            keep = i < j
            yield one_edit(w, i[keep], j[keep])


def one_edit(w: Words, i: np.ndarray, j: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Pairs that differ by exactly one code point and belong to the bucket they were found in."""
    short = np.minimum(w.length[i], w.length[j])
    keep = (short == w.size[i]) & (np.abs(w.length[i] - w.length[j]) <= 1)
    i, j, short = i[keep], j[keep], short[keep]
    out = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
    step = max(1, (1 << 22) // max(1, int(short.max(initial=1))))
    for a in range(0, len(i), step):
        x, y, m = i[a:a + step], j[a:a + step], short[a:a + step]
        at = np.arange(int(m.max()))
        within = at < m[:, None]
        ahead = w.codes[np.minimum(w.start[x][:, None] + at, len(w.codes) - 1)] == w.codes[np.minimum(w.start[y][:, None] + at, len(w.codes) - 1)]
        back = w.codes[np.maximum((w.start + w.length)[x][:, None] - 1 - at, 0)] == w.codes[np.maximum((w.start + w.length)[y][:, None] - 1 - at, 0)]
        head = np.where((ahead | ~within).all(axis=1), m, np.argmin(ahead & within, axis=1))
        tail = np.where((back | ~within).all(axis=1), m, np.argmin(back & within, axis=1))
        same = w.length[x] == w.length[y]
        edit = np.where(same, head + tail == m - 1, head + tail >= m) & (head >= w.head[x]) & (tail >= w.tail[x]) & (head < w.below[x])
        out[0].append(x[edit])
        out[1].append(y[edit])
    return np.concatenate(out[0]), np.concatenate(out[1])


def near_words(words: DataFrame, most: int = BUCKET) -> DataFrame:
    """(word, n, near, near_n): every pair of near words in both directions, once."""

    def compare(batches):
        held = []

        def solve(table):
            w = Words(table)
            pairs = list(near_in(w))
            i = np.concatenate([np.concatenate(p) for p in zip(*pairs)]) if pairs else np.zeros(0, np.int64)
            left, right = (np.concatenate(p) for p in zip(*pairs)) if pairs else (i, i)
            x, y = pa.array(np.concatenate([left, right])), pa.array(np.concatenate([right, left]))
            return pa.RecordBatch.from_arrays([w.word.take(x), table.column("n").take(x), w.word.take(y), table.column("n").take(y)], names=["word", "n", "near", "near_n"])

        for batch in batches:
            held.append(batch)
            if sum(b.num_rows for b in held) < 16384:
                continue
            table = pa.Table.from_batches(held).combine_chunks().to_batches()[0]
            keys = table.column("bucket").to_numpy()
            whole = int(np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]]))[-1])  # the last bucket may go on
            if whole:
                yield solve(table.slice(0, whole))
            held = [table.slice(whole)]
        rest = pa.Table.from_batches(held).combine_chunks().to_batches() if held else []
        if rest:
            yield solve(rest[0])

    rows = small_buckets(half_buckets(words), most)
    parts = rows.repartition("bucket").sortWithinPartitions("bucket", "word")
    return parts.mapInArrow(compare, "word string, n long, near string, near_n long")


def follow_forms(forms: DataFrame) -> DataFrame:
    """(word, root) of (word, form): pointers double until none moves; a form is at least twice as frequent as its
    word, so chains are as short as the logarithm of the largest count."""
    here = settle(forms.select("word", F.col("form").alias("root")), "forms")  # only words that have a form
    while True:
        ahead = here.select(F.col("word").alias("root"), F.col("root").alias("_next"))
        moved = settle(here.join(ahead, "root", "left").select("word", F.coalesce("_next", "root").alias("root"), F.col("_next").isNotNull().alias("_moved")), "forms")
        here = moved.drop("_moved")
        if moved.where("_moved").isEmpty():
            return here


def spelling_groups(docs: DataFrame, least_length: int = 5, least_count: int = 3, ratio: int = 2, most: int = BUCKET) -> DataFrame:
    """Per word: its count, form, root, number of near words and the form's count."""
    words = settle(misspelt_words(docs).where((F.length("word") >= least_length) & (F.col("n") >= least_count)), "words")
    best = F.min(F.struct((-F.col("near_n")).alias("less"), F.col("near")))
    near = near_words(words, most).groupBy("word").agg(F.count("*").alias("n_near"), best.alias("best"))
    joined = words.join(near, "word", "left")
    found = -F.col("best.less") >= ratio * F.col("n")
    rows = settle(joined.select("word", "n", F.coalesce("n_near", F.lit(0)).alias("n_near"), F.when(found, F.col("best.near")).alias("form"), F.when(found, -F.col("best.less")).alias("form_n")), "near-words")
    roots = follow_forms(rows.where("form is not null"))
    return rows.join(roots, "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")


def op11_query(spark, sf_dir: str) -> DataFrame:
    return spelling_groups(spark.read.parquet(f"{sf_dir}/documents.parquet"))
