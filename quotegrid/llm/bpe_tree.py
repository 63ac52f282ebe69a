"""Byte-pair encoding and decoding with a segment tree over adjacent pair ranks.

The leaves of a piece's tree hold (rank, position) of its adjacent pairs, so the root is the leftmost merge of lowest
rank; a merge changes three leaves, each in logarithmically many steps, until no mergeable pair is left.  Many
distinct pieces of similar length are merged together, one array row per tree.

The vocabulary file's normaliser and splitting rule come from the tokenizers library; merging, ids and decoding are
done here.  Defined results: null text is empty (0 tokens, hashes of the empty string); strings of special tokens in a
text become those tokens; repeated rows and null ids are kept.
"""

from __future__ import annotations

import functools
import hashlib
import json
import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from quotegrid.llm.arrays import rows_by
from quotegrid.llm.tokens import Cache, library, vocabulary, word_units

NONE = np.int64(2**62)
SHIFT = np.int64(32)
#: ASCII form of the file's splitting rule, after lower-casing.
ASCII = re.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[a-z]+|[0-9]|[^\sa-z0-9]+")


class Merger:
    """Merge table of a vocabulary file of the word-end kind."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model = spec["model"]
        self.vocab: dict[str, int] = model["vocab"]
        self.suffix = model.get("end_of_word_suffix") or ""
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.token = {i: t for t, i in self.vocab.items()} | {i: t for t, i in self.special.items()}
        self.cut = re.compile("(" + "|".join(map(re.escape, sorted(self.special, key=len, reverse=True))) + ")") if self.special else None
        pairs = [m if isinstance(m, list) else m.split(" ") for m in model["merges"]]
        code = np.array([(self.vocab[a] << 20) | self.vocab[b] for a, b in pairs], np.int64)
        self.merged = np.array([self.vocab[a + b] for a, b in pairs], np.int64)
        # of a pair listed twice the later rank counts, as in a map
        order = np.lexsort((-np.arange(len(code)), code))
        first = np.concatenate([[True], np.diff(code[order]) != 0]) if len(code) else np.zeros(0, bool)
        self.codes, self.ranks = code[order][first], order[first].astype(np.int64)
        self.library = library(path)

    def rank(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        want = (left << 20) | right
        at = np.minimum(np.searchsorted(self.codes, want), len(self.codes) - 1)
        return np.where((self.codes[at] == want) & (left >= 0) & (right >= 0), self.ranks[at], -1)

    def pieces(self, unit: str) -> list[str | int]:
        """Byte-level pieces of a unit, special tokens as ids."""
        out: list[str | int] = []
        for part in (self.cut.split(unit) if self.cut and "<|" in unit else [unit]):
            if part in self.special:
                out.append(self.special[part])
            elif part.isascii() and part.isprintable():
                out += ASCII.findall(part.lower())
            elif part:
                out += [p for p, _ in self.library.pre_tokenizer.pre_tokenize_str(self.library.normalizer.normalize_str(part))]
        return out

    def merge(self, pieces: list[str]) -> dict[str, list[int]]:
        """Ids of each distinct piece."""
        out: dict[str, list[int]] = {}
        by_size: dict[int, list[str]] = {}
        for p in dict.fromkeys(pieces):
            if len(p) == 1:
                out[p] = [self.vocab[p + self.suffix]]
            else:
                by_size.setdefault(1 << max(1, (len(p) - 2).bit_length()), []).append(p)
        for size, group in by_size.items():
            rows = max(1, (1 << 21) // size)
            for a in range(0, len(group), rows):
                part = group[a:a + rows]
                out.update(zip(part, self._merge(part, size)))
        return out

    def _merge(self, pieces: list[str], size: int) -> list[list[int]]:
        """Trees with ``size`` leaves, for pieces of at most size + 1 symbols."""
        w = len(pieces)
        symbol = np.full((w, size + 2), -1, np.int64)
        for r, p in enumerate(pieces):
            symbol[r, :len(p)] = [self.vocab[c] for c in p[:-1]] + [self.vocab[p[-1] + self.suffix]]
        following = np.tile(np.arange(1, size + 3), (w, 1))
        previous = np.tile(np.arange(-1, size + 1), (w, 1))
        tree = np.full((w, 2 * size), NONE, np.int64)
        rank = self.rank(symbol[:, :size], symbol[:, 1:size + 1])
        tree[:, size:] = np.where(rank >= 0, (rank << SHIFT) | np.arange(size), NONE)
        for node in range(size - 1, 0, -1):
            tree[:, node] = np.minimum(tree[:, 2 * node], tree[:, 2 * node + 1])

        def put(rows: np.ndarray, leaf: np.ndarray, value: np.ndarray) -> None:
            node = leaf + size
            tree[rows, node] = value
            while node.size and node[0] > 1:
                node = node >> 1
                tree[rows, node] = np.minimum(tree[rows, 2 * node], tree[rows, 2 * node + 1])

        def pair(rows: np.ndarray, left: np.ndarray, right: np.ndarray) -> None:
            r = self.rank(symbol[rows, left], symbol[rows, right])
            put(rows, left, np.where(r >= 0, (r << SHIFT) | left, NONE))

        rows = np.flatnonzero(tree[:, 1] < NONE)
        while len(rows):
            root = tree[rows, 1]
            left = root & ((1 << 32) - 1)
            right = following[rows, left]
            after = following[rows, right]
            symbol[rows, left] = self.merged[root >> SHIFT]
            symbol[rows, right] = -1
            following[rows, left] = after
            inner = after < size + 2
            previous[rows[inner], after[inner]] = left[inner]
            gone = right < size
            put(rows[gone], right[gone], np.full(int(gone.sum()), NONE))
            ahead = inner & (left < size)
            pair(rows[ahead], left[ahead], after[ahead])
            end = ~inner & (left < size)
            put(rows[end], left[end], np.full(int(end.sum()), NONE))
            before = previous[rows, left]
            has = before >= 0
            pair(rows[has], before[has], left[has])
            rows = rows[tree[rows, 1] < NONE]
        return [row[row >= 0].tolist() for row in symbol]

    def encode(self, units: list[str]) -> list[list[int]]:
        cut = [self.pieces(u) for u in units]
        ids = self.merge([p for c in cut for p in c if isinstance(p, str)])
        return [[i for p in c for i in (ids[p] if isinstance(p, str) else [p])] for c in cut]

    def decode(self, ids) -> str:
        """The file names no decoder: tokens joined by a blank."""
        return " ".join(self.token[i] for i in ids)


@functools.lru_cache(maxsize=2)
def merger(path: str) -> Merger:
    return Merger(path)


@functools.lru_cache(maxsize=2)
def texts_of_units(path: str) -> Cache:
    """unit -> (tokens, decimal ids, decoded)."""
    m = merger(path)
    return Cache(lambda units: [(len(ids), " ".join(map(str, ids)), m.decode(ids)) for ids in m.encode(units)])


def encode_texts(docs: DataFrame, path: str | None = None) -> DataFrame:
    """(doc_id, n_tokens, ids, decoded) per row; ids and decoded are the whole results."""
    path = path or vocabulary("word_bpe_49k.json")

    def encode(batches):
        m = merger(path)
        ids_of = Cache(m.encode)
        for batch in rows_by(batches):
            ids = []
            for text in batch.column("text").to_pylist():
                units = word_units(text or "")
                ids_of.load(units)
                ids.append([i for u in units for i in ids_of[u]])
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array([len(x) for x in ids], pa.int64()), pa.array(ids, pa.list_(pa.int32())), pa.array([m.decode(x) for x in ids], pa.string())],
                                             names=["doc_id", "n_tokens", "ids", "decoded"])

    return docs.selectExpr("cast(doc_id AS long) doc_id", "text").mapInArrow(encode, "doc_id long, n_tokens long, ids array<int>, decoded string")


def encode_digests(docs: DataFrame, path: str | None = None) -> DataFrame:
    """As ``encode_texts`` with the hashes of both results in their place."""
    path = path or vocabulary("word_bpe_49k.json")

    def digest(batches):
        cache = texts_of_units(path)
        for batch in rows_by(batches):
            texts = [word_units(t or "") for t in batch.column("text").to_pylist()]
            cache.load([u for units in texts for u in units])
            rows = []
            for units in texts:
                got = [x for x in map(cache.__getitem__, units) if x[0]]
                both = [hashlib.sha256(" ".join([x[k] for x in got]).encode()).hexdigest() for k in (1, 2)]
                rows.append((sum(x[0] for x in got), *both))
            n, ids, decoded = zip(*rows) if rows else ((), (), ())
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(n, pa.int64()), pa.array(ids, pa.string()), pa.array(decoded, pa.string())],
                                             names=["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    return docs.selectExpr("cast(doc_id AS long) doc_id", "text").mapInArrow(digest, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")


def op4_query(spark, sf_dir: str) -> DataFrame:
    return encode_digests(spark.read.parquet(f"{sf_dir}/documents.parquet"))
