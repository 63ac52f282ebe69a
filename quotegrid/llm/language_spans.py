"""Language identification: script ranges narrow the candidates, Viterbi over per-word scores with a switching
penalty labels spans of mixed-language text.

Model: naive Bayes over hashed byte n-grams (1 to 5, with word borders), learned from labelled texts.  Its size is
languages x ``BUCKETS`` counts, so it may go to every task.  Each distinct word of a batch is scored once; Viterbi
runs over all texts of a batch in lockstep, so its cost is a few array steps per word position.

Defined results: null text or text without a letter is ``und`` with score 0 and no spans.  Without labelled rows
every text is ``und``.  Equal letter counts go to the first language by name.  Repeated rows, null ids and extra
columns are kept as they are.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, functions as F, types as T

from quotegrid.llm.arrays import mix, one_array, rows_by, text_bytes

BUCKETS = 1 << 16
ORDERS = (1, 2, 3, 4, 5)
#: First and last code point of the scripts told apart, others are "other".
SCRIPTS = {
    "latin": [(0x41, 0x24F), (0x1E00, 0x1EFF)], "greek": [(0x370, 0x3FF), (0x1F00, 0x1FFF)], "cyrillic": [(0x400, 0x52F)],
    "armenian": [(0x530, 0x58F)], "hebrew": [(0x590, 0x5FF)], "arabic": [(0x600, 0x77F), (0x8A0, 0x8FF)], "devanagari": [(0x900, 0x97F)],
    "bengali": [(0x980, 0x9FF)], "tamil": [(0xB80, 0xBFF)], "thai": [(0xE00, 0xE7F)], "georgian": [(0x10A0, 0x10FF)],
    "hangul": [(0x1100, 0x11FF), (0xAC00, 0xD7AF)], "kana": [(0x3040, 0x30FF)], "han": [(0x3400, 0x4DBF), (0x4E00, 0x9FFF)],
}
SCRIPT_NAMES = [*SCRIPTS, "other"]


def split_words(column) -> tuple[np.ndarray, np.ndarray, pa.Array]:
    """Row borders, word codes, distinct words: runs of letters and marks, lower case."""
    text = pc.utf8_lower(pc.fill_null(one_array(column), ""))
    parts = pc.split_pattern(pc.utf8_trim(pc.replace_substring_regex(text, r"[^\p{L}\p{M}]+", " "), " "), " ")
    coded = pc.dictionary_encode(parts.flatten())
    counts = pc.list_value_length(parts).to_numpy(zero_copy_only=False)
    return np.concatenate([[0], np.cumsum(counts)]).astype(np.int64), coded.indices.to_numpy(zero_copy_only=False), coded.dictionary


def letters_in(words: pa.Array) -> np.ndarray:
    return pc.count_substring_regex(words, r"\p{L}").to_numpy(zero_copy_only=False).astype(np.int64)


def scripts_in(words: pa.Array) -> np.ndarray:
    """Script number of each word's first code point."""
    first = pc.utf8_slice_codeunits(words, 0, 1).to_pylist()
    points = np.array([ord(c) if c else 0 for c in first], dtype=np.int64)
    out = np.full(len(points), len(SCRIPTS), dtype=np.int64)
    for i, ranges in enumerate(SCRIPTS.values()):
        for a, b in ranges:
            out[(points >= a) & (points <= b)] = i
    return out


def gram_buckets(words: pa.Array):
    """For each n-gram order: (bucket, number of the word) of every n-gram."""
    data, borders = text_bytes(pc.binary_join_element_wise("\x02", words, "\x03", ""))
    owner = np.repeat(np.arange(len(words)), np.diff(borders))
    ends = borders[1:][owner] if len(words) else np.zeros(0, np.int64)
    rolling = np.zeros(len(data), np.uint64)
    for n in range(1, min(max(ORDERS), len(data)) + 1):
        rolling[:len(data) - n + 1] = rolling[:len(data) - n + 1] * np.uint64(0x100000001B3) + data[n - 1:].astype(np.uint64) + np.uint64(1)
        whole = np.flatnonzero(np.arange(len(data)) + n <= ends)
        if n in ORDERS:
            yield (mix(rolling[whole] + np.uint64(n << 40)) & np.uint64(BUCKETS - 1)).astype(np.int64), owner[whole]


class Model:
    def __init__(self, langs: list[str], counts: np.ndarray, scripts: np.ndarray, smoothing: float = 0.1, least_share: float = 0.01):
        """counts: languages x buckets; scripts: languages x scripts, in words."""
        self.langs = langs
        totals = counts.sum(axis=1, keepdims=True)
        self.logs = np.ascontiguousarray((np.log(counts + smoothing) - np.log(totals + smoothing * BUCKETS)).T.astype(np.float32))
        share = scripts / np.maximum(1, scripts.sum(axis=1, keepdims=True))
        self.allowed = share >= least_share
        self.allowed[:, ~self.allowed.any(axis=0)] = True  # a script that no language knows narrows nothing

    def scores(self, words: pa.Array) -> np.ndarray:
        """Distinct words x languages, best 0; languages outside the word's script get -1e4."""
        out = np.zeros((len(words), len(self.langs)), np.float64)
        for buckets, owner in gram_buckets(words):
            for l in range(len(self.langs)):
                out[:, l] += np.bincount(owner, weights=self.logs[buckets, l], minlength=len(words))
        out[~self.allowed[:, scripts_in(words)].T] = -1e4
        return (out - out.max(axis=1, keepdims=True)).astype(np.float32) if len(words) else out.astype(np.float32)


def viterbi(scores: np.ndarray, codes: np.ndarray, borders: np.ndarray, penalty: float) -> np.ndarray:
    """Best language of each word; texts advance together, longest first."""
    lengths = np.diff(borders)
    order = np.argsort(-lengths, kind="stable")
    starts, lengths = borders[:-1][order], lengths[order]
    most = int(lengths[0]) if len(lengths) else 0
    alive = np.searchsorted(-lengths, -np.arange(1, most + 1), side="right")
    states = np.zeros(len(codes), np.int16)
    switched = np.zeros((len(codes), scores.shape[1]), bool)
    before = np.zeros(len(codes), np.int16)  # best language of the word before
    value = np.zeros((len(order), scores.shape[1]), np.float32)
    for t in range(most):
        n = alive[t]
        at = starts[:n] + t
        v = value[:n]
        if t:
            top = v.argmax(axis=1)
            jump = (v[np.arange(n), top] - penalty)[:, None]
            before[at] = top
            switched[at] = v < jump
            np.maximum(v, jump, out=v)
        v += scores[codes[at]]
    last = value.argmax(axis=1) if len(order) else np.zeros(0, np.int64)
    for t in range(most - 1, -1, -1):
        n = alive[t]
        at = starts[:n] + t
        states[at] = last[:n]
        last[:n] = np.where(switched[at, last[:n]], before[at], last[:n])
    return states


def learn_languages(docs: DataFrame, max_rows: int = 10000) -> Model | None:
    """Fit on rows with text and non-null ``lang``.  Beyond ``max_rows`` such rows, an expected
    ``max_rows`` of them are drawn by hash of ``doc_id`` (the fit's documented bound)."""
    known = docs.where(F.col("lang").isNotNull() & F.col("text").isNotNull()).select("doc_id", "text", "lang")
    total = known.select("lang").count()
    if total > max_rows:
        known = known.where(F.pmod(F.xxhash64("doc_id", F.lit("sample")), F.lit(1 << 30)) < int((1 << 30) * max_rows / total))

    def count(batches):
        for batch in rows_by(batches):
            langs = pc.dictionary_encode(batch.column("lang"))
            lang_of = langs.indices.to_numpy(zero_copy_only=False)
            borders, codes, words = split_words(batch.column("text"))
            row = np.repeat(np.arange(len(borders) - 1), np.diff(borders))
            scripts, real = scripts_in(words), letters_in(words) > 0
            grams = list(gram_buckets(words))
            for l, lang in enumerate(langs.dictionary.to_pylist()):
                times = np.bincount(codes[lang_of[row] == l], minlength=len(words)) * real
                sums = np.zeros(BUCKETS)
                for buckets, owner in grams:
                    sums += np.bincount(buckets, weights=times[owner], minlength=BUCKETS)
                both = np.concatenate([sums, np.bincount(scripts, weights=times, minlength=len(SCRIPT_NAMES))]).astype(np.int64)
                at = np.flatnonzero(both)
                yield pa.RecordBatch.from_arrays([pa.array([lang] * len(at), pa.string()), pa.array(at, pa.int32()), pa.array(both[at])], names=["lang", "slot", "n"])

    table = known.mapInArrow(count, "lang string, slot int, n long").groupBy("lang", "slot").agg(F.sum("n").alias("n")).toArrow()
    langs = sorted(set(table.column("lang").to_pylist()))
    if not langs:
        return None
    dense = np.zeros((len(langs), BUCKETS + len(SCRIPT_NAMES)))
    place = pc.index_in(table.column("lang"), pa.array(langs)).to_numpy()
    dense[place, table.column("slot").to_numpy()] = table.column("n").to_numpy()
    return Model(langs, dense[:, :BUCKETS], dense[:, BUCKETS:])


SPAN = "array<struct<lang:string,first_word:int,n_words:int>>"


def label_languages(docs: DataFrame, model: Model | None, penalty: float = 12.0) -> DataFrame:
    """Every row with lang_pred, score and spans; score is the predicted language's share of letters.
    Columns of the same names are replaced."""
    if model is None:
        return docs.withColumns({"lang_pred": F.lit("und"), "score": F.lit(0.0), "spans": F.array().cast(SPAN)})
    shared = docs.sparkSession.sparkContext.broadcast(model)  # languages x BUCKETS floats

    def label(batches):
        model = shared.value
        names = pa.array([*model.langs, "und"])
        for batch in rows_by(batches):
            borders, codes, words = split_words(batch.column("text"))
            n, k = len(borders) - 1, len(model.langs)
            states = viterbi(model.scores(words), codes, borders, penalty)
            row = np.repeat(np.arange(n), np.diff(borders))
            letters = letters_in(words)[codes]
            share = np.bincount(row * k + states, weights=letters, minlength=n * k).reshape(n, k)
            total = share.sum(axis=1)
            best = np.where(total > 0, share.argmax(axis=1), k)
            score = np.where(total > 0, share.max(axis=1) / np.maximum(total, 1), 0.0)
            real = total[row] > 0
            opens = real & np.concatenate([[True], (states[1:] != states[:-1]) | (row[1:] != row[:-1])])[:len(codes)]
            at = np.flatnonzero(opens)
            ends = np.minimum(np.concatenate([at[1:], [len(codes)]])[:len(at)], borders[1:][row[at]])
            spans = pa.StructArray.from_arrays([names.take(pa.array(states[at])), pa.array(at - borders[row[at]], pa.int32()), pa.array(ends - at, pa.int32())], names=["lang", "first_word", "n_words"])
            cut = np.concatenate([[0], np.cumsum(np.bincount(row[at], minlength=n))]).astype(np.int32)
            yield pa.RecordBatch.from_arrays([*batch.columns, names.take(pa.array(best)), pa.array(score), pa.ListArray.from_arrays(pa.array(cut), spans)], names=[*batch.schema.names, "lang_pred", "score", "spans"])

    docs = docs.drop("lang_pred", "score", "spans")
    fields = T.StructType([*docs.schema.fields, *T.StructType.fromDDL(f"lang_pred string, score double, spans {SPAN}").fields])
    return docs.mapInArrow(label, fields)


def held_out():
    """Fold of a row by the checksum of its id; a null id is never held out."""
    return F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 3 == 1, F.lit(False))


def op3_query(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    model = learn_languages(docs.where(~held_out()))
    return label_languages(docs.select("doc_id", "text"), model).select("doc_id", held_out().alias("held_out"), "lang_pred", "score")
