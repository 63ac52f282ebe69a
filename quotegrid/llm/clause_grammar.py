"""Toxicity by a weighted finite-state grammar over clauses.

Words become symbols (insult, faint insult, threat, target, negation, report, filler) and marks become symbols (stop,
line, quote).  Three small transducers each annotate the offences they read: reported speech (after a verb of saying
up to the stop, or inside quotation marks), negation (the words after a negator), target (near a word for a person).
Composed into one table they turn a text into matched clause patterns such as "insult, at a target, not negated, not
reported"; words that lie in no matched pattern count for nothing.

Two things are learned from labelled rows, both from at most ``max_rows`` of them: which words, and which beginnings of
words, are insults (their share of toxic texts far above that of others), and the weight of each pattern (penalised
logistic regression on pattern counts).  Weights are fitted with insults that were learned on the other half of the
rows, so a pattern isn't trusted more than it deserves on unseen text.

Defined results: null and empty texts match nothing and get the score of a text without patterns.  Without labelled
rows of both kinds a fixed lexicon and fixed weights are used.  Labels that are null count as missing; a document with
two labels counts once for each.  Repeated rows and null ids are scored like others.  Long texts are read whole, in pieces
cut at white space; what is kept is a count per pattern.  Extra columns are kept; ``score`` and ``predicted`` are replaced.
"""

from __future__ import annotations

import re
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F, types as T

from quotegrid.llm.arrays import rows_by
from quotegrid.llm.language_spans import held_out

FILLER, INSULT, FAINT, THREAT, TARGET, NEGATION, REPORT, QUOTE, STOP, LINE = range(10)
OFFENCES = (INSULT, FAINT, THREAT)
TOKEN = re.compile(r"[^\W\d_]+(?:['’][^\W\d_]+)*|[.!?;\n\"“”„«»]")
PIECE = 1 << 20
#: Words of each symbol in four languages, lower case.
WORDS = {
    INSULT: "idiot idiots moron morons imbecile scumbag bastard arschloch vollidiot wichser connard salaud crétin cabrón gilipollas pendejo",
    FAINT: "stupid pathetic worthless disgusting loser losers scum trash clown dumb filthy dumm blöd widerlich abschaum nul débile stupide estúpido estúpida asqueroso basura inútil",
    THREAT: "kill murder strangle hurt destroy töten umbringen tuer massacrer matar destruir",
    TARGET: "you your you're he she they them him her his their people du ihr dich dir euch er sie tu vous toi il elle ils elles usted ustedes ellos ellas él ella",
    NEGATION: "not no never isn't aren't wasn't don't doesn't didn't won't nicht kein keine nie niemals pas jamais aucun nunca jamás ningún",
    REPORT: "said says say called calls wrote writes told quoted claimed reported sagte sagt nannte schrieb dit disait écrit appelé dijo dice llamó escribió",
}
MARKS = {**dict.fromkeys(".!?;", STOP), "\n": LINE, **dict.fromkeys('"“”„«»', QUOTE)}
NEGATION_REACH = 3
TARGET_REACH = 4
#: Lengths of the beginnings of words that may be learned.
STEMS = range(4, 9)
PATTERNS = [(kind, reported, negated, targeted) for kind in OFFENCES for reported in (0, 1) for negated in (0, 1) for targeted in (0, 1)]
NUMBER = {p: i for i, p in enumerate(PATTERNS)}
#: Weights without labels: a plain insult or threat counts, a faint one needs a target, negated and reported ones are nearly void.
PLAIN = np.array([(0.2 if reported or negated else 1.0) * (1 + targeted) * {INSULT: 2.0, FAINT: 1.0, THREAT: 1.0}[kind] for kind, reported, negated, targeted in PATTERNS])


class Transducer:
    """A finite-state transducer: ``step(state, symbol)`` gives the next state and the mark put on an offence."""

    def __init__(self, states: int, step):
        self.states, self.step = states, step


def _reported(state: int, symbol: int) -> tuple[int, int]:
    # 0 plain, 1 after a verb of saying, 2 inside quotation marks, 3 both
    if symbol == LINE:
        return 0, 0
    if symbol == STOP:
        return state & 2, 0
    if symbol == QUOTE:
        return state ^ 2, 0
    return state | (symbol == REPORT), int(state > 0)


def _within(opener: int, reach: int):
    def step(state: int, symbol: int) -> tuple[int, int]:
        # state: words that the opener still reaches
        if symbol in (STOP, LINE):
            return 0, 0
        if symbol == opener:
            return reach, 0
        return state if symbol == QUOTE else max(0, state - 1), int(state > 0)
    return step


REPORTED = Transducer(4, _reported)
NEGATED = Transducer(NEGATION_REACH + 1, _within(NEGATION, NEGATION_REACH))
TARGETED = Transducer(TARGET_REACH + 1, _within(TARGET, TARGET_REACH))


def compose(*parts: Transducer) -> list[list[tuple[int, int]]]:
    """One table of all parts run side by side: table[state][symbol] = (next state, pattern number or -1).  Only
    states that can be reached from the start are kept."""
    start = (0,) * len(parts)
    names, todo, table = {start: 0}, [start], []
    while todo:
        here = todo.pop(0)
        row = []
        for symbol in range(LINE + 1):
            moves = [p.step(s, symbol) for p, s in zip(parts, here)]
            there = tuple(m[0] for m in moves)
            if there not in names:
                names[there] = len(names)
                todo.append(there)
            row.append((names[there], NUMBER[(symbol, *(m[1] for m in moves))] if symbol in OFFENCES else -1))
        table.append(row)
    return table


GRAMMAR = compose(REPORTED, NEGATED, TARGETED)


class Lexicon(dict):
    """Symbol of a token; words not seen before are looked up by their beginnings and remembered, up to ``most``."""

    def __init__(self, learned: dict[str, int], most: int = 1 << 19):
        self.learned, self.most = learned, most
        self.fixed = {w: s for s, words in WORDS.items() for w in words.split()} | MARKS
        super().__init__(self.fixed)

    def __missing__(self, word: str) -> int:
        found = self.learned.get(word + "\n", FILLER)
        if found != INSULT:
            for k in STEMS:
                if k > len(word):
                    break
                stem = self.learned.get(word[:k], FILLER)
                if stem == INSULT or not found:
                    found = stem or found
                if found == INSULT:
                    break
        if len(self) > self.most:
            self.clear()
            self.update(self.fixed)
        self[word] = found
        return found


def pieces(text: str, size: int = PIECE):
    """Parts of a long text, cut at a blank or line end where there is one."""
    a = 0
    while len(text) - a > size:
        cut = max(text.rfind(" ", a + 1, a + size), text.rfind("\n", a + 1, a + size))
        cut = cut if cut > a else a + size
        yield text[a:cut]
        a = cut
    yield text[a:] if a else text


SEEN = re.compile(bytes([0x5B, *OFFENCES, 0x5D]))


def patterns_in(text: str, lexicon: Lexicon) -> tuple[np.ndarray, int]:
    """Times of each pattern in the text, and its number of words."""
    times, words, state = np.zeros(len(PATTERNS), np.int64), 0, 0
    for piece in pieces(text):
        symbols = bytes(map(lexicon.__getitem__, TOKEN.findall(piece.lower())))
        words += len(symbols) - symbols.count(STOP) - symbols.count(LINE) - symbols.count(QUOTE)
        if len(text) <= PIECE and not SEEN.search(symbols):
            break  # no offence in the whole text
        for symbol in symbols:
            state, found = GRAMMAR[state][symbol]
            if found >= 0:
                times[found] += 1
    return times, words


def features(times: np.ndarray, words: np.ndarray) -> np.ndarray:
    """Per text: log counts of the patterns, of each offence in all, and the faint ones by text length."""
    kinds = times.reshape(-1, len(OFFENCES), len(PATTERNS) // len(OFFENCES)).sum(axis=2)
    rate = 100.0 * kinds / np.maximum(50, words)[:, None]
    return np.hstack([np.log1p(times), np.log1p(kinds), np.minimum(rate, 20.0)])


def fit_logistic(x: np.ndarray, y: np.ndarray, penalty: float = 1.0, rounds: int = 30) -> tuple[np.ndarray, float]:
    """Penalised weights and intercept by Newton steps."""
    z = np.hstack([x, np.ones((len(x), 1))])
    w = np.zeros(z.shape[1])
    w[-1] = np.log((y.sum() + 1) / (len(y) - y.sum() + 1))
    ridge = np.full(len(w), penalty)
    ridge[-1] = 1e-3
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(z @ w, -30, 30)))
        step = np.linalg.solve(z.T @ (z * (p * (1 - p))[:, None]) + np.diag(ridge), z.T @ (y - p) - ridge * w)
        w += step
        if np.abs(step).max() < 1e-8:
            break
    return w[:-1], float(w[-1])


class Model:
    def __init__(self, learned: dict[str, int], weights: np.ndarray, intercept: float):
        self.learned, self.weights, self.intercept = learned, weights, intercept

    def score(self, times: np.ndarray, words: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(features(times, words) @ self.weights + self.intercept, -30, 30)))


def plain_model() -> Model:
    weights = np.concatenate([PLAIN, np.zeros(2 * len(OFFENCES))])
    return Model({}, weights, -2.0)


def _labelled(docs: DataFrame, labels: DataFrame, max_rows: int) -> DataFrame:
    """(doc_id, text, toxic, half) of at most an expected ``max_rows`` labelled rows, drawn by hash of the id."""
    known = labels.where("toxic is not null and doc_id is not null").select("doc_id", (F.col("toxic") == 1).alias("toxic"))
    total = known.count()
    if total > max_rows:
        known = known.where(F.pmod(F.xxhash64("doc_id", F.lit("toxic sample")), F.lit(1 << 30)) < int((1 << 30) * max_rows / total))
    rows = docs.where("text is not null").select("doc_id", "text").join(known.distinct(), "doc_id")
    return rows.withColumn("half", F.pmod(F.xxhash64("doc_id", F.lit("half")), F.lit(2)).cast("int"))


TERM = "array<long>"


def term_counts(rows: DataFrame) -> DataFrame:
    """(term, toxic_0, toxic_1, clean_0, clean_1): texts with each word (marked by a line end) or beginning, per half."""

    def count(batches):
        for batch in rows_by(batches):
            seen: dict[str, list[int]] = {}
            for text, toxic, half in zip(batch.column("text").to_pylist(), batch.column("toxic").to_pylist(), batch.column("half").to_pylist()):
                slot = (0 if toxic else 2) + half
                words = {w for piece in pieces(text) for w in TOKEN.findall(piece.lower()) if w not in MARKS}
                terms = {w[:k] for w in words for k in STEMS if k <= len(w)}
                terms.update(w + "\n" for w in words)
                for t in terms:
                    seen.setdefault(t, [0, 0, 0, 0])[slot] += 1
            if seen:
                yield pa.RecordBatch.from_arrays([pa.array(list(seen), pa.string()), *[pa.array([v[k] for v in seen.values()], pa.int64()) for k in range(4)]], names=["term", "toxic_0", "toxic_1", "clean_0", "clean_1"])

    sums = [F.sum(c).alias(c) for c in ("toxic_0", "toxic_1", "clean_0", "clean_1")]
    return rows.select("text", "toxic", "half").mapInArrow(count, "term string, toxic_0 long, toxic_1 long, clean_0 long, clean_1 long").groupBy("term").agg(*sums)


def evidence(a: int, b: int, toxic: int, clean: int) -> float:
    """Likelihood ratio statistic of ``a`` of ``toxic`` and ``b`` of ``clean`` texts against one common share."""
    share, n = toxic / (toxic + clean), a + b
    return 2 * ((a * np.log(a / (n * share)) if a else 0.0) + (b * np.log(b / (n * (1 - share))) if b else 0.0))


def insults(terms: list[tuple[str, int, int]], toxic: int, clean: int, least: float = 24.0, strong: float = 60.0, faint: float = 12.0) -> dict[str, int]:
    """Terms (text, toxic texts, clean texts) with an evidence of ``least`` whose smoothed share of toxic texts is
    ``faint`` or ``strong`` times that of clean ones.  Longer terms of a known insult's beginning are left out."""
    if not toxic or not clean:
        return {}
    ratio = {t: ((a + 0.5) / (toxic + 1)) / ((b + 0.5) / (clean + 1)) for t, a, b in terms if evidence(a, b, toxic, clean) >= least}
    out: dict[str, int] = {}
    for t in sorted(ratio, key=len):
        if ratio[t] < faint:
            continue
        symbol = INSULT if ratio[t] >= strong else FAINT
        known = max((out.get(t[:k], FILLER) == INSULT for k in STEMS if k < len(t)), default=False)
        if not known:
            out[t] = symbol
    return out


def learn_toxicity(docs: DataFrame, labels: DataFrame, max_rows: int = 10_000) -> Model:
    """Fit on rows of ``docs`` that ``labels`` marks; the bound ``max_rows`` holds for all that is learned from."""
    rows = _labelled(docs, labels, max_rows)
    sizes = {(r["toxic"], r["half"]): r["count"] for r in rows.groupBy("toxic", "half").count().collect()}
    toxic = [sizes.get((True, h), 0) for h in (0, 1)]
    clean = [sizes.get((False, h), 0) for h in (0, 1)]
    if not sum(toxic) or not sum(clean):
        return plain_model()
    # what can pass insults() on all rows or on one half; the texts behind it are bounded by max_rows
    worth = F.expr(f"toxic_0 + toxic_1 >= 3 and (toxic_0 + toxic_1 + 0.5) * {sum(clean) + 1} >= 4 * (clean_0 + clean_1 + 0.5) * {sum(toxic) + 1}")
    found = term_counts(rows).where(worth).collect()
    halves = [insults([(r["term"], r[f"toxic_{h}"], r[f"clean_{h}"]) for r in found], toxic[h], clean[h], 16.0) for h in (0, 1)]
    whole = insults([(r["term"], r["toxic_0"] + r["toxic_1"], r["clean_0"] + r["clean_1"]) for r in found], sum(toxic), sum(clean))
    shared = docs.sparkSession.sparkContext.broadcast(halves)

    def match(batches):
        lexicons = [Lexicon(shared.value[1]), Lexicon(shared.value[0])]  # the other half's insults
        for batch in rows_by(batches):
            got = [patterns_in(t, lexicons[h]) for t, h in zip(batch.column("text").to_pylist(), batch.column("half").to_pylist())]
            yield pa.RecordBatch.from_arrays([pa.array([g[0].tolist() for g in got], pa.list_(pa.int64())), pa.array([g[1] for g in got], pa.int64()), batch.column("toxic")], names=["times", "words", "toxic"])

    sample = rows.select("text", "toxic", "half").mapInArrow(match, f"times {TERM}, words long, toxic boolean").toPandas()
    x = features(np.array(sample["times"].tolist(), np.float64).reshape(-1, len(PATTERNS)), sample["words"].to_numpy(np.float64))
    weights, intercept = fit_logistic(x, sample["toxic"].to_numpy(np.float64))
    return Model(whole, weights, intercept)


def score_texts(docs: DataFrame, model: Model, threshold: float = 0.7) -> DataFrame:
    """Every row with its score and the decision ``predicted``."""
    shared = docs.sparkSession.sparkContext.broadcast(model)  # terms of max_rows texts

    def score(batches):
        lexicon = Lexicon(shared.value.learned)
        for batch in rows_by(batches):
            got = [patterns_in(t or "", lexicon) for t in batch.column("text").to_pylist()]
            s = shared.value.score(np.array([g[0] for g in got], np.float64).reshape(-1, len(PATTERNS)), np.array([g[1] for g in got], np.float64))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(s), pa.array((s >= threshold).astype(np.int32))], names=[*batch.schema.names, "score", "predicted"])

    docs = docs.drop("score", "predicted")
    return docs.mapInArrow(score, T.StructType([*docs.schema.fields, *T.StructType.fromDDL("score double, predicted int").fields]))


def op12_query(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    model = learn_toxicity(docs, labels.where(~held_out()))
    return score_texts(docs, model).select("doc_id", held_out().alias("held_out"), "score", "predicted")
