"""Token counts with overlap resynchronisation.

A text over ``chunk`` characters is cut into overlapping chunks, which tasks encode apart with offsets.  Neighbours are
spliced at the last place in their overlap from which both saw the same run of ``RUN`` (offset, id) pairs and that is
stable by the argument below.  Where an overlap holds no such place, the text's overlaps (and chunks) are doubled and it
is encoded again; at last one chunk holds it all.

A place is stable if it lies behind the right chunk's start, ``MARGIN`` or more before the left chunk's end, opens a
pre-token in both, and no combining mark stands there.  The vocabulary's splitting rule scans from left to right, never
looks back, looks at most two characters past the start of what it takes, and keeps no state but its place; strings of
added tokens are shorter than ``MARGIN``; merges stay inside a pre-token; and composed characters have one offset, so none
reaches across the start of a token.  Then, from the first chunk on, (1) the left chunk's pre-tokens before the place are
the text's, because what was read to take them lies in the chunk, and (2) the right chunk's from there on are the text's,
because the scan of the text stands at the same place.  The tokens are those of the left before it, of the right after it.

Defined results: null text is empty (0 bytes, 0 tokens).  Repeated rows and null ids are kept; the splice key is a row
number, not the id.  Other columns are ignored, also those with names of results.  An empty table gives no rows.
"""

from __future__ import annotations

import functools
import unicodedata

import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F

from quotegrid.llm.arrays import rows_by
from quotegrid.llm.tokens import Cache, library, vocabulary, word_units
from quotegrid.session import settle

CHUNK, OVERLAP = 1 << 15, 256
#: Pairs that both sides must have in common, and characters before a chunk's end that are not trusted.
RUN, MARGIN = 3, 16


@functools.lru_cache(maxsize=2)
def counts_of_units(path: str) -> Cache:
    tokenizer = library(path)
    return Cache(lambda units: [len(e.ids) for e in tokenizer.encode_batch_fast(units, add_special_tokens=False)])


def count_short(docs: DataFrame, path: str) -> DataFrame:
    def count(batches):
        cache = counts_of_units(path)
        for batch in rows_by(batches):
            texts = [word_units(t or "") for t in batch.column("text").to_pylist()]
            cache.load([u for units in texts for u in units])
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("n_bytes"), pa.array([sum(map(cache.__getitem__, units)) for units in texts], pa.int64())],
                                             names=["doc_id", "n_bytes", "n_tokens"])

    return docs.mapInArrow(count, "doc_id long, n_bytes long, n_tokens long")


def cut_chunks(docs: DataFrame, chunk: int, overlap: int) -> DataFrame:
    """(row, k, start, last, text): ``k`` counts the chunks of a row."""
    def cut(batches):
        for batch in rows_by(batches):
            for row, text in zip(batch.column("row").to_pylist(), batch.column("text").to_pylist()):
                starts = range(0, max(1, len(text) - overlap), chunk - overlap)
                for k, s in enumerate(starts):
                    yield pa.RecordBatch.from_arrays([pa.array([row], pa.int64()), pa.array([k], pa.int32()), pa.array([s], pa.int64()), pa.array([s == starts[-1]]), pa.array([text[s:s + chunk]], pa.string())],
                                                     names=["row", "k", "start", "last", "text"])

    return docs.select("row", "text").mapInArrow(cut, "row long, k int, start long, last boolean, text string")


def stable_runs(text: str, start: int, offsets: list, ids: list, words: list) -> tuple[list, list]:
    """([offset, id, offset, id ...] of the ``RUN`` tokens from each stable place on, tokens of the chunk before it)."""
    runs, before = [], []
    for n in range(1, len(ids) - RUN + 1):
        at = offsets[n][0]
        if words[n] == words[n - 1] or at == offsets[n - 1][0] or at == 0 or unicodedata.combining(text[at]):
            continue
        runs.append([v for k in range(n, n + RUN) for v in (start + offsets[k][0], ids[k])])
        before.append(n)
    return runs, before


def encode_chunks(chunks: DataFrame, overlap: int, path: str) -> DataFrame:
    """Tokens of each chunk, and for both overlaps the runs at stable places with the tokens before them."""
    schema = "row long, k int, last boolean, n long, head array<array<long>>, head_n array<long>, tail array<array<long>>, tail_n array<long>"

    def encode(batches):
        tokenizer = library(path)
        runs, numbers = pa.list_(pa.list_(pa.int64())), pa.list_(pa.int64())
        kinds = [pa.int64(), pa.int32(), pa.bool_(), pa.int64(), runs, numbers, runs, numbers]
        for batch in rows_by(batches):
            rows = []
            for row, k, start, last, text in zip(*(batch.column(c).to_pylist() for c in ("row", "k", "start", "last", "text"))):
                found = tokenizer.encode(text, add_special_tokens=False)
                ids, offsets, words = found.ids, found.offsets, found.word_ids
                # tokens on both sides of a border are needed, so the overlaps are widened by a token
                low = next((n for n, (a, _) in enumerate(offsets) if a > overlap), len(ids))
                high = next((n for n in range(len(ids), 0, -1) if offsets[n - 1][0] < len(text) - overlap), 0)
                sides = []
                for a, b in ((0, min(len(ids), low + RUN)), (max(0, high - 1), len(ids))):
                    found_runs, before = stable_runs(text, start, offsets[a:b], ids[a:b], words[a:b])
                    kept = [(r, a + n) for r, n in zip(found_runs, before) if r[0] <= start + len(text) - MARGIN]
                    sides += [[r for r, _ in kept], [n for _, n in kept]]
                rows.append((row, k, last, len(ids), *sides))
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), kinds)], names=[f.split()[0] for f in schema.split(", ")])

    return chunks.mapInArrow(encode, schema)


def splice(encoded: DataFrame) -> DataFrame:
    """(row, n_tokens): null where some overlap has no common run at a stable place."""
    order = Window.partitionBy("row").orderBy("k")
    at = F.array_max(F.array_intersect("tail", "next_head"))
    left = F.element_at("tail_n", F.array_position("tail", at).cast("int"))
    right = F.element_at("next_head_n", F.array_position("next_head", at).cast("int"))
    joined = (encoded.withColumn("next_head", F.lead("head").over(order)).withColumn("next_head_n", F.lead("head_n").over(order))
              .withColumn("n_here", F.when(F.col("last"), F.col("n")).when(at.isNotNull(), left - right)))
    return joined.groupBy("row").agg(F.when(F.count_if(F.col("n_here").isNull()) == 0, F.sum("n_here")).alias("n_tokens"))


def count_long(docs: DataFrame, path: str, chunk: int, overlap: int) -> DataFrame:
    left = settle(docs.withColumn("row", F.monotonically_increasing_id()), "long-texts")
    done = None
    while True:
        pieces = cut_chunks(left, chunk, overlap)
        encoded = encode_chunks(pieces.repartition(F.xxhash64("row", "k")), overlap, path)
        counted = settle(left.select("row", "doc_id", "n_bytes").join(splice(encoded), "row"), "spliced")
        good = counted.where(F.col("n_tokens").isNotNull()).select("doc_id", "n_bytes", "n_tokens")
        done = good if done is None else done.unionByName(good)
        failed = counted.where(F.col("n_tokens").isNull()).select("row")
        if failed.isEmpty():
            return done
        left = settle(left.join(failed, "row", "left_semi"), "long-texts")
        chunk, overlap = (chunk, overlap * 2) if overlap * 4 <= chunk else (chunk * 2, overlap * 2)


def count_tokens(docs: DataFrame, path: str | None = None, limit: int = 2048, chunk: int = CHUNK, overlap: int = OVERLAP) -> DataFrame:
    """(doc_id, n_bytes, n_tokens, over_limit) per row."""
    path = path or vocabulary("word_bpe_49k.json")
    body = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text")).withColumn("n_bytes", F.octet_length("text").cast("long"))
    short = count_short(body.where(F.length("text") <= chunk), path)
    long = count_long(body.where(F.length("text") > chunk), path, chunk, overlap)
    return short.unionByName(long).withColumn("over_limit", F.col("n_tokens") > limit)


def op8_query(spark, sf_dir: str) -> DataFrame:
    return count_tokens(spark.read.parquet(f"{sf_dir}/documents.parquet"))
