"""Each dealt operator against brute force on small fixtures with hard rows."""

import collections
import hashlib
import random
import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from quotegrid.llm import (bpe_tree, cover_dedup, language_spans, multi_index, prefix_join, quality_rules, resync_counts, sentence_spans,
                           squares_packing, tokens, warc_dictionary)
from quotegrid.llm.arrays import shingle_sets

WORD = re.compile(r"[^\x20\x09-\x0D]+")
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, kept string, spans int"
PASSAGE = "alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu nu xi omicron pi rho sigma tau upsilon phi chi psi omega. "


@pytest.fixture(scope="module")
def docs(spark):
    rng = random.Random(5)
    vocabulary = ["the", "of", "and", "It's", "naïve", "Größe", "x1", "co-op", "end.", "Yes!", "#tag", "日本", "a", "in", "we'll"]
    text = lambda n: " ".join(rng.choice(vocabulary) + rng.choice(["", "", "a", "é", "ing"]) for _ in range(n))
    base = text(120)
    rows = [(i, text(rng.choice([1, 2, 3, 25, 60, 200]))) for i in range(40)]
    rows += [(50, base), (51, base), (51, base), (52, base + " tail"), (53, "Head " + base), (54, None), (55, ""), (56, " \n\t\x0b "), (57, "one two"), (58, "One TWO"), (None, base), (None, None)]
    rows += [(60, PASSAGE * 3 + "Something else. "), (61, "Own words first. " + PASSAGE * 3), (62, "loop again " * 4000), (63, "… \x00 ﬁ <|endoftext|> Σς " + "z" * 700), (64, "die der und " * 30), (65, "\n".join(["same line here"] * 4 + ["", "", "other"]))]
    return spark.createDataFrame([(i, t, "xx", "s", 1, "clash", 7) for i, t in rows], SCHEMA).repartition(3).cache()


def rows_of(df):
    return df.select("doc_id", "text").collect()


def empty(docs):
    return docs.where("doc_id = -5")


def repeat_words(words):
    seen = collections.Counter(tuple(words[i:i + 8]) for i in range(len(words) - 7))
    covered = {i + k for i in range(len(words) - 7) if seen[tuple(words[i:i + 8])] > 1 for k in range(8)}
    return len(covered)


def test_quality_statistics(docs):
    got = collections.Counter(tuple(r) for r in quality_rules.text_statistics(docs).select("doc_id", *quality_rules.BASE).collect())
    want = collections.Counter()
    for r in rows_of(docs):
        t = r["text"] or ""
        w = WORD.findall(t)
        lines = [x for x in t.split("\n") if WORD.search(x)]
        want[(r["doc_id"], len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in t), len(lines) - len(set(lines)), repeat_words(w))] += 1
    assert got == want
    assert quality_rules.text_statistics(empty(docs)).count() == 0


def test_quality_rules_reject_what_labels_reject(spark):
    rows = [(i, " ".join(f"w{i}x{k}" + ("###" if i % 4 == 0 else "") for k in range(40))) for i in range(400)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    labels = spark.createDataFrame([(i, 0 if i % 4 == 0 else 1, 0) for i in range(300)] + [(1, None, 0), (None, 0, 0)], "doc_id long, quality int, toxic int")
    got = {r["doc_id"]: r["kept"] for r in quality_rules.judge_quality(docs, labels).collect()}
    assert got == {i: i % 4 != 0 for i in range(400)}
    none = quality_rules.judge_quality(docs, labels.where("doc_id = -1"))
    assert none.where("kept").count() == 400
    clash = docs.withColumn("n_words", F.lit("mine")).withColumn("row", F.lit(1))
    assert quality_rules.good_documents(clash, labels).columns == clash.columns


def test_archives_round_trip(spark):
    pages = spark.createDataFrame([(1, "u", "a"), (2, "u", "b"), (3, None, "a"), (4, "u\r\nX: y", None), (5, "u", ""), (6, "u", "é" * 9000), (7, "u", "a"), (7, "u", "a"), (None, "u", "c")], "page_id long, url string, html string")
    index = warc_dictionary.write_archives(warc_dictionary.mark_revisits(pages), f"{warc_dictionary.shared_folder(spark)}/warc-test")
    got = warc_dictionary.read_archives(index.select("archive").distinct()).collect()
    assert len(got) == 9 == index.count()
    sums = collections.Counter((r["page_id"], r["record_type"], r["refers_to"], r["payload_bytes"]) for r in got)
    assert sums == collections.Counter([(1, "revisit", 7, 1), (3, "revisit", 7, 1), (7, "response", None, 1), (7, "revisit", 7, 1), (2, "response", None, 1), (4, "revisit", 5, 0), (5, "response", None, 0), (6, "response", None, 18000), (None, "response", None, 1)])
    assert next(r for r in got if r["page_id"] == 6)["payload"] == ("é" * 9000).encode()
    # a record alone, from its offset and the dictionary
    import struct
    import zstandard
    one = index.where("page_id = 6").first()
    files, path = warc_dictionary.file_system(one["archive"])
    data = files.open_input_stream(path).read()
    magic, n = struct.unpack("<II", data[:8])
    frame = data[one["frame_offset"]:one["frame_offset"] + one["frame_length"]]
    fields, _ = warc_dictionary.parse(zstandard.ZstdDecompressor(dict_data=zstandard.ZstdCompressionDict(data[8:8 + n])).decompress(frame))
    assert magic == warc_dictionary.DICTIONARY_MAGIC and fields["WARC-X-Page-Id"] == "6"
    assert warc_dictionary.archive_pages(spark, pages.where("page_id = -1")).count() == 0


def test_languages(spark, docs):
    words = {"aa": ["the", "and", "with", "thing"], "bb": ["der", "und", "mit", "ding"], "cc": ["это", "как", "так"]}
    rng = random.Random(1)
    say = lambda lang, n: " ".join(rng.choice(words[lang]) for _ in range(n))
    rows = [(i, say(lang, 30), lang) for i in range(60) for lang in words]
    model = language_spans.learn_languages(spark.createDataFrame(rows, "doc_id long, text string, lang string"))
    mixed = spark.createDataFrame([(1, say("aa", 30) + " " + say("bb", 60)), (2, "это"), (3, None), (4, "12 34 !"), (5, ""), (2, "это")], "doc_id long, text string").withColumn("score", F.lit("clash"))
    got = sorted(language_spans.label_languages(mixed, model).collect(), key=lambda r: r["doc_id"])
    assert [r["lang_pred"] for r in got] == ["bb", "cc", "cc", "und", "und", "und"]
    assert [(s["lang"], s["first_word"], s["n_words"]) for s in got[0]["spans"]] == [("aa", 0, 30), ("bb", 30, 60)]
    assert got[3]["score"] == 0 and got[1]["score"] == 1
    assert language_spans.learn_languages(empty(docs)) is None
    assert language_spans.label_languages(docs, None).where("lang_pred <> 'und'").count() == 0
    assert language_spans.label_languages(empty(docs), model).count() == 0


def test_viterbi_is_the_best_path():
    rng = np.random.default_rng(0)
    scores = -rng.random((5, 3)).astype(np.float32) * 4
    codes = rng.integers(0, 5, 7)
    got = language_spans.viterbi(scores, codes, np.array([0, 0, 7]), 1.5)
    cost = lambda path: sum(scores[c, s] for c, s in zip(codes, path)) - 1.5 * sum(a != b for a, b in zip(path, path[1:]))
    best = max(cost(p) for p in np.ndindex(*[3] * 7))
    assert abs(cost(got.tolist()) - best) < 1e-4


def encoded(docs, name):
    library = tokens.library(tokens.vocabulary(name))
    return library, [(r["doc_id"], r["text"] or "", library.encode(r["text"] or "", add_special_tokens=False).ids) for r in rows_of(docs)]


def test_bpe_tree(docs):
    library, want = encoded(docs, "word_bpe_49k.json")
    whole = collections.Counter((i, tuple(ids), library.decode(ids, skip_special_tokens=False)) for i, _, ids in want)
    assert collections.Counter((r["doc_id"], tuple(r["ids"]), r["decoded"]) for r in bpe_tree.encode_texts(docs).collect()) == whole
    sha = lambda x: hashlib.sha256(x.encode()).hexdigest()
    digests = collections.Counter((i, len(ids), sha(" ".join(map(str, ids))), sha(d)) for (i, ids, d), n in whole.items() for _ in range(n))
    assert collections.Counter(tuple(r) for r in bpe_tree.encode_digests(docs).collect()) == digests
    assert bpe_tree.encode_digests(empty(docs)).count() == 0


@pytest.mark.parametrize("chunk,overlap", [(1 << 15, 256), (64, 8)])
def test_resync_counts(docs, chunk, overlap):
    _, want = encoded(docs, "word_bpe_49k.json")
    got = resync_counts.count_tokens(docs, chunk=chunk, overlap=overlap).collect()
    assert collections.Counter(tuple(r) for r in got) == collections.Counter((i, len(t.encode()), len(ids), len(ids) > 2048) for i, t, ids in want)
    assert resync_counts.count_tokens(empty(docs), chunk=chunk, overlap=overlap).count() == 0


@pytest.mark.parametrize("chunk, overlap", [(48, 24), (200, 64)])
def test_splices_of_hard_texts(spark, chunk, overlap):
    """What the stability argument rests on: contractions, marks, digits, blanks, added tokens and composing characters on every border."""
    rng = random.Random(chunk)
    parts = ["'", "'ll", "'re", "l", "e", "It", "don't", " ", "  ", "\n", "\t\n ", "7", "42", "<|endoftext|>", "<|", "endoftext", "|>", "...", "?!", "\u0301", "e\u0301\u0327",
             "\u1100", "\u1161", "\u11a8", "İ", "Σ", "ς", "日本語", "\u00a0", "\u2028", "🙂", "wörter", "internationalisation"]
    texts = ["".join(rng.choice(parts) for _ in range(rng.randint(20, 400))) for _ in range(120)] + [" " * 500, "x" * 500, "<|endoftext|>" * 60, "e\u0301" * 300]
    table = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(4)
    got = {r["doc_id"]: r["n_tokens"] for r in resync_counts.count_tokens(table, chunk=chunk, overlap=overlap).collect()}
    tokenizer = tokens.library(tokens.vocabulary("word_bpe_49k.json"))
    assert got == {i: len(tokenizer.encode(t, add_special_tokens=False).ids) for i, t in enumerate(texts)}


def test_most_overlaps_splice_at_once(spark):
    """A prose text needs no second round: every border has a stable run that both sides saw."""
    rng = random.Random(3)
    text = " ".join("".join(rng.choice("abcdefghi") for _ in range(rng.randint(1, 9))) for _ in range(4000))
    rows = spark.createDataFrame([(0, text)], "row long, text string")
    encoded_chunks = resync_counts.encode_chunks(resync_counts.cut_chunks(rows, 1000, 128), 128, tokens.vocabulary("word_bpe_49k.json"))
    assert encoded_chunks.count() > 15
    tokenizer = tokens.library(tokens.vocabulary("word_bpe_49k.json"))
    assert resync_counts.splice(encoded_chunks).first()["n_tokens"] == len(tokenizer.encode(text, add_special_tokens=False).ids)


def test_sentence_spans(docs):
    got = sentence_spans.drop_repeats(docs)
    assert got.columns == [*docs.columns, "n_sentences", "n_removed"]
    text = {r["doc_id"]: r for r in got.where("doc_id in (50, 54, 55, 60, 61, 62)").collect()}
    assert text[60]["text"].count("alpha") == 1 and "Something else" in text[60]["text"]
    assert text[61]["text"] == "Own words first. " and text[54]["text"] is None and text[55]["text"] == ""
    assert {r["text"] for r in got.where("doc_id = 51").collect()} != {None}
    before = {r["text"] for r in rows_of(docs.where("doc_id is null"))}
    assert {r["text"] for r in got.where("doc_id is null").collect()} == before
    for r in rows_of(docs):
        assert "".join(sentence_spans.sentences(r["text"] or "")) == (r["text"] or "")
    assert sentence_spans.drop_repeats(empty(docs)).count() == 0


def test_repeated_passages_inside_sentences(spark):
    """Passages of 51 to 60 words in mid-sentence, without marks, go whole but for a few words at their ends."""
    rng = random.Random(9)
    word = lambda: "".join(rng.choice("abcdefghijklmnop") for _ in range(rng.randint(3, 8)))
    sign = lambda: chr(rng.randint(0x4E00, 0x9000))
    rows, planted = [], []
    for k in range(60):
        words = [word() for _ in range(51 + k % 10)]
        if k % 3 == 1:
            words = [w + rng.choice(["", "", "", "", ".", "?", ","]) for w in words]
        passage, glue = " ".join(words), " "
        if k % 3 == 2:
            passage, glue = "".join(sign() + ("。" if rng.random() < 0.03 else "") for _ in range(120)), ""
        own = [glue.join((word if glue else sign)() for _ in range(rng.randint(1, 40))) for _ in range(4)]
        planted.append((passage, own[2], own[3] + rng.choice(["", " ", "\n"])))
        rows += [(2 * k, own[0] + glue + passage + glue + own[1]), (2 * k + 1, own[2] + glue + passage + glue + planted[-1][2])]
    got = {r["doc_id"]: r["text"] for r in sentence_spans.drop_repeats(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    left = []
    for k, (passage, before, after) in enumerate(planted):
        assert got[2 * k] == rows[2 * k][1]
        text = got[2 * k + 1]
        assert text.startswith(before) and text.endswith(after)
        left.append((len(text) - len(before) - len(after)) / len(passage))
    assert max(left) < 0.5 and sum(left) / len(left) < 0.25, (max(left), sum(left) / len(left))


def test_multi_index(spark):
    rng = np.random.default_rng(3)
    centers = rng.normal(size=(30, 16))
    x = np.concatenate([centers[rng.integers(0, 30, 700)] + 0.12 * rng.normal(size=(700, 16)), np.repeat(centers[:1], 150, 0)])
    rows = [(i, v.tolist()) for i, v in enumerate(x)] + [(2000, None), (2001, [0.0] * 16), (2002, [float("nan")] * 16), (2003, [None] * 16), (2004, [1.0, 2.0]), (2005, [2.0, 4.0]), (None, x[0].tolist())]
    table = spark.createDataFrame(rows, "vec_id long, embedding array<double>").withColumn("component_id", F.lit(1))
    got = {r["vec_id"]: r for r in multi_index.near_duplicates(table).collect()}
    u = x / np.linalg.norm(x, axis=1)[:, None]
    near = u @ u.T >= 0.95
    np.fill_diagonal(near, False)
    found = sum(got[i]["n_links"] for i in range(len(x)))
    assert 0.97 * near.sum() <= found and all(got[i]["n_links"] <= near[i].sum() for i in range(len(x)))
    assert [got[i]["n_links"] for i in range(2000, 2006)] == [0, 0, 0, 0, 1, 1] and got[2005]["component_id"] == 2004 and got[2001]["kept"]
    assert got[None]["component_id"] is None
    assert multi_index.near_duplicates(table.where("vec_id = -1")).count() == 0
    assert multi_index.near_duplicates(table.where("vec_id = 2001")).count() == 1


@pytest.mark.parametrize("queries,most,hot", [(256, 1 << 15, 0), (16, 1 << 15, 300), (64, 64, 0)])
def test_multi_index_finds_rare_links(spark, monkeypatch, queries, most, hot):
    """About 1 % of the vectors are linked; a hot cluster does not outvote them."""
    monkeypatch.setattr(multi_index, "QUERIES", queries)
    monkeypatch.setattr(multi_index, "MOST_QUERIES", most)
    rng = np.random.default_rng(11)
    x = rng.normal(size=(6000, 64))
    x[30:60] = x[:30] + 0.29 * rng.normal(size=(30, 64))
    x[5000:5000 + hot] = x[4999] + 0.02 * rng.normal(size=(hot, 64))
    table = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<double>")
    got = {r["vec_id"]: r["n_links"] for r in multi_index.near_duplicates(table).collect()}
    u = x / np.linalg.norm(x, axis=1)[:, None]
    near = u @ u.T >= 0.95
    np.fill_diagonal(near, False)
    want = near[:60].sum()
    assert want > 40 and sum(got[i] for i in range(60)) >= (0.95 * want if hot else 0.99 * want)
    assert all(got[i] <= n for i, n in enumerate(near.sum(1)))


@pytest.mark.parametrize("width,percent", [(3, 90), (5, 80)])
def test_prefix_join(docs, width, percent):
    sets = collections.defaultdict(list)
    for r in rows_of(docs):
        w = WORD.findall(re.sub("[A-Z]", lambda m: m[0].lower(), r["text"] or ""))
        sets[r["doc_id"]].append({tuple(w[i:i + width]) for i in range(len(w) - width + 1)} if len(w) >= width else {tuple(w)} if w else set())
    label = {i: i for i in sets if i is not None}
    for _ in range(8):
        for a in label:
            for b in label:
                if any(s and t and 100 * len(s & t) >= percent * len(s | t) for s in sets[a] for t in sets[b]):
                    label[a] = label[b] = min(label[a], label[b])
    got = prefix_join.similar_components(docs, width, percent).collect()
    assert collections.Counter(tuple(r) for r in got) == collections.Counter((i, len(s), label.get(i)) for i, many in sets.items() for s in many)
    assert prefix_join.similar_components(empty(docs), width, percent).count() == 0


@pytest.mark.parametrize("members,visitors", [(1024, 512), (7, 3)])
def test_variants_that_meet_away_from_the_center(spark, monkeypatch, members, visitors):
    """Many variants of one text, some linked to each other only; blocks of any size find the same classes."""
    monkeypatch.setattr(prefix_join, "MEMBERS", members)
    monkeypatch.setattr(prefix_join, "VISITORS", visitors)
    rng = random.Random(8)
    base = [f"w{i}" for i in range(400)]
    rows = []
    for family in range(12):  # each moves away from the base, far from other families, near its own
        own = list(base)
        for k in rng.sample(range(0, 400, 4), 22):
            own[k] = f"f{family}x{k}"
        for _ in range(4):
            one = list(own)
            for k in rng.sample(range(400), 2):
                one[k] = f"y{rng.random()}"
            rows.append((len(rows), " ".join(one)))
    table = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    sets = [{tuple(w[i:i + 3]) for i in range(len(w) - 2)} for w in (t.split() for _, t in rows)]
    label = list(range(len(rows)))
    for _ in range(6):
        for a in label:
            for b in range(len(rows)):
                if 100 * len(sets[a] & sets[b]) >= 75 * len(sets[a] | sets[b]):
                    label[a] = label[b] = min(label[a], label[b])
    assert {r["doc_id"]: r["component_id"] for r in prefix_join.similar_components(table, 3, 75).collect()} == dict(enumerate(label))
    assert 4 < len(set(label)) < 40


def test_bitmaps_never_rule_out_what_is_common():
    rng = np.random.default_rng(3)
    for _ in range(200):
        pool = rng.integers(0, 2**63, 300).astype(np.uint64)
        x, y = (np.unique(rng.choice(pool, rng.integers(1, 300))) for _ in range(2))
        p = prefix_join.folded([prefix_join.bitmap(x), prefix_join.bitmap(y)])
        assert len(np.intersect1d(x, y)) <= prefix_join.most_common(p[0], len(x), p[1], len(y)) <= min(len(x), len(y))


def test_best_forest_spans_with_the_heaviest_edges():
    rng = np.random.default_rng(4)
    for n, m in ((2, 1), (6, 9), (30, 200)):
        a, b = rng.integers(0, n, (2, m))
        w = rng.permutation(m).astype(float)
        got = prefix_join.best_forest(a, b, w, n)
        label, want = list(range(n)), []
        for e in np.argsort(-w):
            x, y = label[a[e]], label[b[e]]
            if x != y:
                want.append(e)
                label = [x if v == y else v for v in label]
        assert sorted(got) == sorted(want)


def test_prefix_signatures_never_miss():
    """Similar sets share a signature also when every token is frequent."""
    rng = np.random.default_rng(0)
    order = prefix_join.Order(np.full(prefix_join.WIDTH, 1000), 10)
    order.frequent_from = 500
    some = prefix_join.Order(rng.integers(0, 1000, prefix_join.WIDTH), 10)
    some.frequent_from = 500
    for n in (4, 7, 8, 15, 16, 17, 33, 64, 200, 500):
        for o in (order, some):
            for percent in (80, 90):
                x = rng.integers(0, 2**63, n).astype(np.uint64)
                drop = n * (100 - percent) // 100 // 2
                y = np.unique(np.concatenate([x[drop:], rng.integers(0, 2**63, drop).astype(np.uint64)]))
                if 100 * len(np.intersect1d(x, y)) >= percent * len(np.union1d(x, y)):
                    assert len(np.intersect1d(prefix_join.signatures(np.unique(x), o, percent), prefix_join.signatures(y, o, percent)))


def removed(rows):
    first = {}
    for i, t in sorted((i, t) for i, t in rows if i is not None):
        for k in range(len(t) - 49):
            first.setdefault(t[k:k + 50], i)
    out = collections.Counter()
    for i, t in rows:
        gone = np.zeros(len(t), bool)
        for k in range(len(t) - 49):
            if i is not None and first[t[k:k + 50]] < i:
                gone[k:k + 50] = True
        spans = int(np.diff(np.concatenate([[0], gone.astype(int)])).clip(0).sum())
        out[(i, len(t), int(gone.sum()), spans, hashlib.sha256(np.frombuffer(t, np.uint8)[~gone].tobytes()).hexdigest())] += 1
    return out


@pytest.mark.parametrize("block", [1 << 20, 300])
def test_cover_dedup(docs, monkeypatch, block):
    monkeypatch.setattr(cover_dedup, "BLOCK", block)
    rows = [(r["doc_id"], (r["text"] or "").encode()) for r in rows_of(docs)]
    got = cover_dedup.drop_substrings(docs).drop("kept").collect()
    assert collections.Counter(tuple(r) for r in got) == removed(rows)
    assert cover_dedup.drop_substrings(empty(docs)).count() == 0


@pytest.mark.parametrize("place", [7, 9])
def test_cover_dedup_of_texts_longer_than_a_place(docs, monkeypatch, place):
    """Equal windows have equal anchors also where a text is longer than a place's bits reach."""
    data = np.random.default_rng(4).integers(97, 123, 4000).astype(np.uint8)
    data[3000:3600] = data[100:700]
    borders = np.array([0, 0, 1900, 1920, 4000])
    spread = lambda parts: [(h, r, f + k) for h, r, f, n in zip(*(p.tolist() for p in parts)) for k in range(n)]
    whole = spread(cover_dedup.anchors(data, borders))
    monkeypatch.setattr(cover_dedup, "PLACE", place)
    parts = spread(cover_dedup.anchors(data, borders))
    assert [x[1:] for x in parts] == [x[1:] for x in whole] == [(r, f) for r, n in ((1, 1900), (3, 2080)) for f in range(n - 49)]
    anchor = {x[1:]: x[0] for x in parts}
    assert all(anchor[1, 100 + k] == anchor[3, 1080 + k] for k in range(551))
    rows = [(r["doc_id"], (r["text"] or "").encode()) for r in rows_of(docs)]
    assert collections.Counter(tuple(r) for r in cover_dedup.drop_substrings(docs).drop("kept").collect()) == removed(rows)


def test_cover_dedup_bounds_buckets(spark, monkeypatch):
    """A short phrase with a low hash, each time in other surroundings, is not one bucket."""
    monkeypatch.setattr(cover_dedup, "BLOCK", 4000)
    rng = np.random.default_rng(6)
    letters = lambda n: rng.integers(97, 123, n).astype(np.uint8).tobytes().decode()
    pool = letters(60000)
    at = int(cover_dedup.gram_hashes(np.frombuffer(pool.encode(), np.uint8)).argmin())
    phrase = pool[at:at + 20]
    rows = [(i, letters(80) + phrase + letters(80)) for i in range(300)]
    rows += [(300 + i, letters(10) + rows[i][1][20:160] + letters(10)) for i in range(20)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    pieces, seen = cover_dedup.window_pieces, []
    monkeypatch.setattr(cover_dedup, "window_pieces", lambda *a: seen.append(pieces(*a)) or seen[-1])
    got = cover_dedup.drop_substrings(docs).drop("kept").collect()
    assert collections.Counter(tuple(r) for r in got) == removed([(i, t.encode()) for i, t in rows])
    sizes = seen[0].where("bytes is not null").select("anchor", "bytes").distinct().groupBy("anchor").agg(F.sum(F.length("bytes")).alias("size"))
    assert sizes.agg(F.max("size")).first()[0] <= cover_dedup.BLOCK


def test_suffixes_are_sorted():
    rng = np.random.default_rng(2)
    data = rng.integers(97, 99, 3000).astype(np.uint8)
    data[1000:1200] = data[100:300]
    data[2000:2200] = data[103:303]
    end = np.where(np.arange(3000) < 1500, 1500, 3000)
    suffix = np.flatnonzero(np.arange(3000) + 50 <= end)
    by, opens = cover_dedup.sort_suffixes(data, suffix, end)
    text = [data[s:s + 50].tobytes() for s in suffix[by]]
    assert text == sorted(text)
    assert [i == 0 or text[i] != text[i - 1] for i in range(len(text))] == opens.tolist()


def test_unit_ids_are_those_of_the_tokenizers_library():
    path = tokens.vocabulary("byte_bpe_50k.json")
    units = [" don't", "'ll", "it's3", " x" * 9, "\n\n  a", "  ", "\t", "\n", "ab<|endoftext|>c", " é漢字🙂", "e\u0301", "\x00\x7f\xad", "a" * 5000, "<|", " 12345", "--==", "naïve—word", "\u200b\ufeff", ""]
    assert tokens.rank_encoder(path) is not None
    assert tokens.unit_ids(path, units) == [tokens.library(path).encode(u, add_special_tokens=False).ids for u in units]
    assert tokens.rank_encoder(tokens.vocabulary("word_bpe_49k.json")) is None


def test_cache_holds_what_a_batch_wants(monkeypatch):
    monkeypatch.setattr(tokens, "CACHE", 5)
    asked = []
    cache = tokens.Cache(lambda units: asked.extend(units) or [len(u) for u in units])
    cache.load(["a", "bb", "ccc", "a"])
    cache.load({"bb", "dddd", "e", "ff"})
    assert cache == {"bb": 2, "dddd": 4, "e": 1, "ff": 2} and sorted(asked) == ["a", "bb", "ccc", "dddd", "e", "ff"]
    assert list(cache.of(["bb", "e", "bb"])) == [2, 1, 2] and list(cache.of(["e"])) == [1] and list(cache.of([])) == []


def test_packing(docs):
    _, want = encoded(docs, "byte_bpe_50k.json")
    ids = collections.defaultdict(list)
    for i, _, x in want:
        ids[i].append(x + [1])
    got = squares_packing.pack(docs.repartition(2), size=64).collect()
    fill = collections.defaultdict(list)
    for r in got:
        fill[r["sequence_id"]].append(r)
        assert any(len(x) == r["doc_tokens"] and zlib.crc32(np.array(x[r["start"]:r["start"] + r["length"]], "<u4").tobytes()) == r["ids_crc32"] for x in ids[r["doc_id"]])
    assert sum(r["length"] for r in got) == sum(len(x) for many in ids.values() for x in many)
    for pieces in fill.values():
        at = 0
        for r in sorted(pieces, key=lambda r: r["offset"]):
            assert r["offset"] == at
            at += r["length"]
        assert at <= 64
    assert sum(sum(r["length"] for r in p) < 64 for p in fill.values()) <= 2
    assert squares_packing.pack(empty(docs)).count() == 0


@pytest.mark.parametrize("most", [8, 4096])
def test_levels_of_least_squares(monkeypatch, most):
    """Each choice against all choices tried out; closing loses no id, pads one sequence and cuts little."""
    monkeypatch.setattr(squares_packing, "MOST_OPEN", most)
    rng, size, full = random.Random(most), 60, []
    packer = squares_packing.Packer(size, full.append)
    sent = collections.defaultdict(bytes)
    for i in range(400):
        length = rng.randint(1, size - 1)
        ids = np.arange(length, dtype="<u4").tobytes()
        sent[i] = ids
        counts, best = packer.count.copy(), []
        for level in range(size - length + 1):
            if level == 0 or counts[level]:
                after = counts.copy()
                after[level] -= level > 0
                after[level + length] += 1
                best.append((int((after[:size] ** 2).sum()), -level))
        assert packer.level_for(length) == -min(best)[1]
        packer.add((i, 0, ids, length), length)
        assert packer.count.sum() <= most and [len(x) for x in packer.open] == packer.count.tolist()
    packer.close()
    assert sum(sum(len(p[2]) for p in held) < 4 * size for held in full) <= 1 and all(sum(len(p[2]) for p in held) <= 4 * size for held in full)
    back = collections.defaultdict(list)
    for held in full:
        for doc, start, ids, _ in held:
            back[doc].append((start, ids))
    assert {d: b"".join(x for _, x in sorted(p)) for d, p in back.items()} == sent
    assert most < 100 or packer.cut < packer.placed // 20


def test_pipeline_stages(spark, docs):
    labels = spark.createDataFrame([(1, 1, 0)], "doc_id long, quality int, toxic int")
    folder = f"{corpus_pipeline.shared_folder(spark)}/stages"
    labels.write.mode("overwrite").parquet(f"{folder}/labels.parquet")
    for table in (docs, empty(docs)):
        here = table
        for name, stage in corpus_pipeline.STAGES[:-1]:
            out = stage(spark, here, folder)
            assert out.columns == docs.columns, name
            assert out.count() <= here.count()
            out.write.mode("overwrite").parquet(f"{folder}/{name}-{here is table}")
            here = spark.read.parquet(f"{folder}/{name}-{here is table}")
        assert corpus_pipeline.STAGES[-1][1](spark, here, folder).agg(F.coalesce(F.sum("length"), F.lit(0))).first()[0] >= here.count()
    assert [n for n, _ in corpus_pipeline.STAGES] == ["language", "quality", "jaccard", "substring", "packing"]
    assert shingle_sets is not None


def test_pipeline_substring_rows(spark):
    """The rows of the stage against plain Python runs over the same pieces."""
    rng = random.Random(13)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(rng.randint(2, 6))) + rng.choice(["", "", "", "", "", ".", "?"])
    passages = [" ".join(word() for _ in range(n)) for n in (15, 20, 30, 55, 80)]
    texts = [" ".join(rng.choice(passages) if rng.random() < 0.2 else word() for _ in range(rng.randint(1, 40))) for _ in range(80)]
    rows = [(i, t, "en", "s", -1) for i, t in enumerate(texts)]
    first, want = {}, collections.Counter()
    for i, t in enumerate(texts):
        parts = sentence_spans.sentences(t)
        words = [p.split() for p in parts]
        enough = lambda a, b: b - a >= 3 and sum(map(len, words[a:b])) >= 12
        spans = [(a, b) for a in range(len(parts)) for b in range(a + 1, len(parts) + 1) if enough(a, b) and not (enough(a + 1, b) and enough(a, b - 1))]
        gone = set()
        for a, b in spans:
            key = tuple(w for p in words[a:b] for w in p)
            doc, end = first.setdefault(key, (i, b))
            if doc < i or a >= end:
                gone.update(range(a, b))
        left = "".join(p for k, p in enumerate(parts) if k not in gone)
        want[(i, left, "en", "s", len(left) if gone else -1)] += 1
    table = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    got = collections.Counter(tuple(r) for r in corpus_pipeline.substring_stage(spark, table, "").collect())
    assert got == want and sum(r[4] >= 0 for r in want) > 20
