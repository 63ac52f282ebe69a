"""Spelling variants, toxicity and importance resampling against plain Python on small fixtures with hard rows."""

import collections
import hashlib
import math
import random
import re
import uuid
import zlib

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from quotegrid.llm import clause_grammar as cg, sentence_spans, spelling_blocks, target_resampling, warc_dictionary
from quotegrid.llm.checksums import crc32_ranges
from quotegrid.operators.ordered import row_numbers

LOWER = str.maketrans({chr(c): chr(c + 32) for c in range(65, 91)})


@pytest.fixture(scope="module")
def docs(spark):
    rng = random.Random(3)
    stems = ["colour", "color", "colors", "größe", "grösse", "GROSSE", "naïve", "naive", "naiv", "centre", "center", "ÀÉîÿ×÷ø", "theatre", "theater", "aaaaa", "aaaab", "aaabb"]
    text = lambda n: "".join(rng.choice(stems) + rng.choice([" ", "\n", "1", ". ", "日本", "\n\n", " 7 "]) for _ in range(n))
    rows = [(i, text(rng.choice([0, 1, 5, 19, 20, 60, 200]))) for i in range(60)]
    rows += [(70, None), (71, ""), (72, " \n\t "), (73, "z" * 3000 + " colour"), (74, ("x" * 300 + " ") * 4), (75, "colour " * 5000), (1, rows[1][1]), (None, "colour theatre"), (None, None), (76, "a\nb\n\nc d\n12 é\n")]
    return spark.createDataFrame([(i, t, "xx", 0.5, 3) for i, t in rows], "doc_id long, text string, word string, score double, n int").repartition(3).cache()


def empty(docs):
    return docs.where("doc_id = -5")


def test_checksums_of_ranges():
    rng = np.random.default_rng(0)
    data = rng.integers(0, 256, 5000).astype(np.uint8)
    starts = rng.integers(0, 4000, 300)
    ends = starts + np.concatenate([rng.integers(0, 20, 290), rng.integers(60, 900, 10)])
    before = rng.integers(0, 1 << 32, 300).astype(np.uint32)
    assert crc32_ranges(data, starts, ends, before).tolist() == [zlib.crc32(data[a:b].tobytes(), int(c)) for a, b, c in zip(starts, ends, before)]
    assert len(crc32_ranges(data, starts[:0], ends[:0])) == 0


def near(u, v):
    if len(u) > len(v):
        u, v = v, u
    if len(u) == len(v):
        return sum(a != b for a, b in zip(u, v)) == 1
    return len(v) == len(u) + 1 and any(v[:i] + v[i + 1:] == u for i in range(len(v)))


def plain_groups(rows):
    n = collections.Counter()
    for i, text in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = run.translate(LOWER)
            h = zlib.crc32(f"{'' if i is None else i}:{run}".encode())
            n[run if h % 97 else run[:h % len(run)] + run[h % len(run) + 1:]] += 1
    n = {w: k for w, k in n.items() if len(w) >= 5 and k >= 3}
    around = {w: [v for v in n if near(w, v)] for w in n}
    form = {}
    for w, others in around.items():
        best = min(others, key=lambda v: (-n[v], v), default=None)
        if best and n[best] >= 2 * n[w]:
            form[w] = best

    def root(w):
        while w in form:
            w = form[w]
        return w
    return {(w, form.get(w), root(w), n[w], len(around[w]), n.get(form.get(w))) for w in n}


@pytest.mark.parametrize("most", [2048, 3])
def test_spelling_groups(docs, most):
    got = spelling_blocks.spelling_groups(docs, most=most).collect()
    want = plain_groups([(r["doc_id"], r["text"]) for r in docs.collect()])
    assert {tuple(r) for r in got} == want and len(got) == len(want) > 10
    assert spelling_blocks.spelling_groups(empty(docs)).count() == 0


@pytest.mark.parametrize("most", [2048, 8, 2])
def test_near_words_are_found_once_however_buckets_split(spark, most):
    rng = random.Random(1)
    words = sorted({"".join(rng.choice("abé") for _ in range(rng.randint(1, 9))) for _ in range(700)})
    table = spark.createDataFrame([(w, 5) for w in words], "word string, n long")
    got = collections.Counter((r["word"], r["near"]) for r in spelling_blocks.near_words(table, most).collect())
    assert got == collections.Counter((u, v) for u in words for v in words if near(u, v))
    split = spelling_blocks.small_buckets(spelling_blocks.half_buckets(table), most)
    assert split.where("size - head - tail > 1").groupBy("bucket").count().where(F.col("count") > most).count() == 0


def test_resampling(docs, spark):
    target = spark.createDataFrame([(1, "Colour theatre é 12"), (2, None), (3, "centre")], "item_id long, text string")
    got = collections.Counter(tuple(r) for r in target_resampling.resample(docs, target).select("doc_id", "n_features", "weight", "score", "rank").collect())
    pattern = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")

    def features(text):
        words = pattern.findall((text or "").translate(LOWER))
        return len(words), [zlib.crc32(f.encode()) % 10000 for f in words + [a + " " + b for a, b in zip(words, words[1:])]]
    rows = [(r["doc_id"], *features(r["text"])) for r in docs.collect()]
    s, t = collections.Counter(b for r in rows for b in r[2]), collections.Counter(b for r in target.collect() for b in features(r["text"])[1])
    gain = [math.floor(1000 * math.log((t[b] + 1) * (s.total() + 10000) / ((s[b] + 1) * (t.total() + 10000)))) for b in range(10000)]
    scored = []
    for i, words, found in rows:
        weight = sum(gain[b] for b in found) // len(found) if found else 0
        h = int(hashlib.sha256(f"7:{'' if i is None else i}".encode()).hexdigest()[:8], 16)
        scored.append((i, len(found), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296))), words >= 20))
    order = sorted((r for r in scored if r[4]), key=lambda r: (-r[3], -1 if r[0] is None else r[0]))
    drawn = 25 * len(order) // 100
    want = collections.Counter((*r[:4], k + 1 if k < drawn else None) for k, r in enumerate(order)) + collections.Counter((*r[:4], None) for r in scored if not r[4])
    assert got == want and drawn > 3
    assert target_resampling.resample(empty(docs), target).count() == 0
    assert target_resampling.resample(docs, target.where("item_id = 9")).count() == len(rows)


def test_lines_are_hashed_once_and_multiplied(spark):
    lines = pa.array(["a b\na b\n\na b", "b\nb", None])
    owner, code, distinct = target_resampling.split_lines(lines)
    assert distinct.to_pylist() == ["a b", "", "b"] and owner.tolist() == [0, 0, 0, 0, 1, 1, 2]
    line, bucket = target_resampling.line_features(distinct)
    assert sorted(line.tolist()) == [0, 0, 0, 2]
    counts = target_resampling.feature_counts(spark.createDataFrame([("a b\na b\n\na b",), ("b\nb",), (None,)], "text string"))
    want = collections.Counter(zlib.crc32(f.encode()) % 10000 for f in ["a", "b", "a b"] * 3 + ["b a"] * 2 + ["b", "b", "b b"])
    assert {b: int(n) for b, n in enumerate(counts) if n} == want


def test_row_numbers_span_the_table(spark):
    rows = spark.range(5000).select((F.col("id") % 7).alias("k"), "id").repartition(5)
    got = [tuple(r) for r in row_numbers(rows, F.col("k").desc(), "id").orderBy("rn").collect()]
    assert [(k, i) for k, i, _ in got] == sorted(((i % 7, i) for i in range(5000)), key=lambda r: (-r[0], r[1]))
    assert [n for *_, n in got] == list(range(1, 5001))
    assert row_numbers(rows.where("id < 0"), "id").count() == 0


def test_cut_passages_beside_clashing_columns(spark):
    passage = " ".join(f"word{i}" for i in range(60))
    rows = [(1, "First here. " + passage + ". End of one.", 5), (2, "Second there. " + passage + ". End of two.", 6), (3, None, 7)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, n_chars long").withColumns({"lang": F.lit("a"), "source": F.lit("s"), "n_removed": F.lit(9), "n_sentences": F.lit("x"), "_drop": F.lit(1), "row": F.lit(2)})
    assert {r["doc_id"]: r["n_removed"] > 0 for r in sentence_spans.drop_repeats(docs).collect()} == {1: False, 2: True, 3: False}
    got = corpus_pipeline.substring_stage(spark, docs, "")
    assert got.columns == docs.columns
    out = {r["doc_id"]: r for r in got.collect()}
    assert out[1]["text"] == rows[0][1] and out[1]["n_chars"] == 5 and "word30" not in out[2]["text"] and out[2]["n_chars"] == len(out[2]["text"])
    assert all(r["n_removed"] == 9 and r["row"] == 2 and r["_drop"] == 1 for r in out.values())


def test_every_archive_can_be_read_by_a_task_of_its_own(spark):
    pages = spark.createDataFrame([(i, "u", f"page {i}") for i in range(64)], "page_id long, url string, html string").repartition(8)
    index = warc_dictionary.write_archives(warc_dictionary.mark_revisits(pages).repartition(8), f"{warc_dictionary.shared_folder(spark)}/warc-{uuid.uuid4().hex}")
    spark.conf.set("spark.sql.shuffle.partitions", str(index.select("archive").distinct().count()))  # as many as archives
    archives = warc_dictionary.archives_of(index)
    spark.conf.set("spark.sql.shuffle.partitions", "4")
    assert archives.rdd.getNumPartitions() == archives.count() > 1
    assert warc_dictionary.read_archives(archives).count() == 64


def found_in(text, learned=None):
    times, words = cg.patterns_in(text, cg.Lexicon(learned or {}))
    return {cg.PATTERNS[i]: int(n) for i, n in enumerate(times) if n}, words


def test_clause_patterns():
    insult = cg.INSULT
    assert found_in("You are an idiot.") == ({(insult, 0, 0, 1): 1}, 4)
    assert found_in("An idiot")[0] == {(insult, 0, 0, 0): 1}
    assert found_in("You are not an idiot")[0] == {(insult, 0, 1, 1): 1}
    assert found_in("not here now at all, idiot")[0] == {(insult, 0, 0, 0): 1}  # past the negator's reach
    assert found_in("She said an idiot came. An idiot came")[0] == {(insult, 1, 0, 1): 1, (insult, 0, 0, 0): 1}
    assert found_in('the word "idiot" here. idiot')[0] == {(insult, 1, 0, 0): 1, (insult, 0, 0, 0): 1}
    assert found_in('open " quote\nidiot')[0] == {(insult, 0, 0, 0): 1}  # a line ends what was left open
    assert found_in("I will kill you. They kill")[0] == {(cg.THREAT, 0, 0, 0): 1, (cg.THREAT, 0, 0, 1): 1}
    assert found_in("gruzzling grubs", {"gruz": insult})[0] == {(insult, 0, 0, 0): 1}
    assert found_in(None or "") == ({}, 0)
    long = "clean words " * 200000 + "you idiot"
    assert found_in(long)[0] == {(insult, 0, 0, 1): 1}
    assert len(list(cg.pieces(long))) > 1 and "".join(cg.pieces(long)) == long


def test_composed_grammar_equals_its_parts():
    rng = random.Random(2)
    parts = (cg.REPORTED, cg.NEGATED, cg.TARGETED)
    for _ in range(300):
        states, here = [0] * len(parts), 0
        for symbol in (rng.randrange(cg.LINE + 1) for _ in range(40)):
            moves = [p.step(s, symbol) for p, s in zip(parts, states)]
            states = [m[0] for m in moves]
            here, found = cg.GRAMMAR[here][symbol]
            assert found == (cg.NUMBER[(symbol, *(m[1] for m in moves))] if symbol in cg.OFFENCES else -1)


def test_toxicity_is_learned(spark):
    rng = random.Random(4)
    plain = ["house", "tree", "water", "market", "song", "bread", "window", "stone"]
    rude = ["gruzzle", "gruzzler", "gruzzling", "plonkish"]

    def text(toxic):
        words = [rng.choice(plain) + rng.choice(["", "s", "let"]) for _ in range(40)]
        for _ in range(3 if toxic else 0):
            words[rng.randrange(40)] = rng.choice(rude)
        return " ".join(words)
    rows = [(i, text(i % 6 == 0)) for i in range(900)]
    docs = spark.createDataFrame([(i, t, "mine", 1) for i, t in rows] + [(1000, None, "m", 1), (1001, "", "m", 1), (None, text(True), "m", 1), (0, rows[0][1], "m", 1)], "doc_id long, text string, score string, times int")
    labels = spark.createDataFrame([(i, int(i % 6 == 0)) for i in range(600)] + [(3, None), (None, 1), (2000, 1)], "doc_id long, toxic int")
    model = cg.learn_toxicity(docs, labels)
    assert all(any(w[:k] in model.learned or w + "\n" in model.learned for k in cg.STEMS) for w in rude)
    got = cg.score_texts(docs, model)
    assert got.columns == ["doc_id", "text", "times", "score", "predicted"]
    held = [r for r in got.collect() if r["doc_id"] is not None and 600 <= r["doc_id"] < 900]
    assert sum(r["predicted"] == (r["doc_id"] % 6 == 0) for r in held) >= 295
    scores = {r["doc_id"]: r["score"] for r in got.where("doc_id >= 1000").collect()}
    assert scores[1000] == scores[1001] < 0.3 and all(0 <= r["score"] <= 1 for r in held)
    bounded = cg.learn_toxicity(docs, labels, max_rows=300)
    assert any(k.startswith("gruz") for k in bounded.learned)
    none = cg.learn_toxicity(docs, labels.where("toxic = 0"))
    assert {r["text"]: r["predicted"] for r in cg.score_texts(spark.createDataFrame([(1, "you idiot, you moron"), (2, "a house")], "doc_id long, text string"), none).collect()} == {"you idiot, you moron": 1, "a house": 0}
    assert cg.score_texts(docs.where("doc_id = -1"), model).count() == 0


def test_logistic_fit_is_at_its_optimum():
    rng = np.random.default_rng(1)
    x, y = rng.normal(size=(200, 3)), (rng.random(200) < 0.3).astype(float)
    w, b = cg.fit_logistic(x, y)
    p = 1 / (1 + np.exp(-(x @ w + b)))
    assert np.abs(x.T @ (y - p) - w).max() < 1e-6 and abs((y - p).sum() - 1e-3 * b) < 1e-6
