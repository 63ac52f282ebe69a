"""Exact substring dedup by blockwise suffix sorting with a difference cover.

A byte goes when a ``SPAN``-byte string that covers it also starts in a document with a smaller ``doc_id``.  Such
strings are found without an index of the whole corpus:

1. Every ``SPAN``-byte window has an anchor, the place of its least ``GRAM``-byte hash, so equal windows have equal
   anchors.  Anchors whose hash stands in one document only can't repeat; counting them moves 24 bytes per anchor.
2. For the others, the bytes of the windows they own are brought together by anchor hash: one suffix bucket.
3. Buckets are sorted one block at a time.  Suffixes are ordered by their first 16 bytes; longer ties are resolved by
   the ranks of a difference cover sample: positions modulo 13 in {0, 1, 3, 9}, sorted before, such that any two
   suffixes have a sampled position at one distance under 13.  The ranks' common prefixes tell whether the rest up to
   ``SPAN`` bytes is equal.  Memory is bounded by the block: distinct pieces of text of its buckets.  An anchor whose
   pieces could fill a block alone is no bucket: its windows go by the hash of all their bytes, one piece each.
4. The least ``doc_id`` of each run of equal suffixes decides.

A bit filter of bounded size keeps pieces of unshared anchors from being shuffled; where it lets some
through, sorting finds nothing equal.

Defined results: null text is empty.  Texts under ``SPAN`` bytes lose nothing.  Rows with a null id lose nothing and
take nothing away.  Rows that repeat an id are one document: they don't repeat each other and lose the same bytes.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from quotegrid.llm import bit_filter
from quotegrid.llm.arrays import mix, rows_by, text_bytes
from quotegrid.session import settle

SPAN, GRAM = 50, 20
REACH = SPAN - GRAM + 1  # grams in a window
# A perfect difference cover.
MODULUS, COVER = 13, (0, 1, 3, 9)
BLOCK = 2 << 20  # bytes of text sorted at once
PLACE = 22  # bits of a place beside an anchor's hash
#: DISTANCE[i, j]: a distance at which suffixes at residues i and j both meet the cover.
DISTANCE = np.array([[next(d for d in range(MODULUS) if (i + d) % MODULUS in COVER and (j + d) % MODULUS in COVER) for j in range(MODULUS)] for i in range(MODULUS)])


def every_word(data: np.ndarray, order: str) -> np.ndarray:
    """View of the 64-bit word at each byte position but the last seven."""
    return np.ndarray((max(0, len(data) - 7),), dtype=f"{order}u8", buffer=data, strides=(1,))


def words_at(data: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Big-endian 64-bit words at byte positions; ``data`` has 8 spare bytes."""
    return every_word(data, ">")[at].astype(np.uint64)


def gram_hashes(data: np.ndarray) -> np.ndarray:
    """Hash of the ``GRAM`` bytes from each position on."""
    n = len(data) - GRAM + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    one = every_word(np.ascontiguousarray(data), "<").astype(np.uint64)
    factors = mix(np.arange(1, 5, dtype=np.uint64)) | np.uint64(1)
    value = one[:n] * factors[0]
    for f, at in zip(factors[1:], (*range(8, GRAM - 7, 8), GRAM - 8)):
        word = one[at:at + n] * f
        word ^= word >> np.uint64(32)
        value += word * f
    return mix(value)


def anchors(data: np.ndarray, borders: np.ndarray):
    """(hash, row, first window, windows) of every anchor; positions within the row.

    Windows are taken 2^``PLACE`` bytes of text at a time, so that places fit beside the hash."""
    place = (1 << PLACE) - 1
    step = place - SPAN
    parts = []
    for a in range(0, max(0, len(data) - SPAN + 1), step):
        hashes = gram_hashes(data[a:a + step + SPAN - 1])
        low = (hashes & ~np.uint64(place)) | np.arange(len(hashes), dtype=np.uint64)
        windows = len(hashes) - REACH + 1
        width = 1
        while 2 * width <= REACH:
            low = np.minimum(low[:-width], low[width:])
            width *= 2
        low = np.minimum(low[:windows], low[REACH - width:REACH - width + windows])
        row = np.searchsorted(borders, np.arange(a, a + windows), "right") - 1
        starts = np.flatnonzero(np.arange(a, a + windows) + SPAN <= borders[1:][row])
        if not len(starts):
            continue
        at, row = (low[starts] & np.uint64(place)).astype(np.int64), row[starts]
        opens = np.flatnonzero(np.concatenate([[True], (at[1:] != at[:-1]) | (row[1:] != row[:-1])]))
        counts = np.diff(np.concatenate([opens, [len(at)]]))
        parts.append((hashes[at[opens]], row[opens], a + starts[opens] - borders[row[opens]], counts, a + at[opens]))
    if not parts:
        none = np.zeros(0, np.int64)
        return np.zeros(0, np.uint64), none, none, none
    hashes, row, first, counts, at = map(np.concatenate, zip(*parts))
    # an anchor may go on in the next part
    opens = np.flatnonzero(np.concatenate([[True], (at[1:] != at[:-1]) | (row[1:] != row[:-1])]))
    return hashes[opens], row[opens], first[opens], np.add.reduceat(counts, opens)


def window_hashes(data: np.ndarray) -> np.ndarray:
    """Hash of the ``SPAN`` bytes from each position on."""
    grams, n = gram_hashes(data), len(data) - SPAN + 1
    value = mix(grams[:n])
    for at in (*range(GRAM, SPAN - GRAM, GRAM), SPAN - GRAM):
        value = mix(value + grams[at:at + n])
    return value


def known_rows(docs: DataFrame) -> DataFrame:
    return docs.where("doc_id is not null and text is not null").select(F.col("doc_id").cast("long").alias("doc_id"), "text")


def shared_anchors(docs: DataFrame) -> DataFrame:
    """(anchor, n): anchor hashes that stand in two documents and more, and how often."""
    def run(batches):
        for batch in rows_by(batches, 3 << 20):
            ids = batch.column("doc_id").to_numpy()
            hashes, row, _, _ = anchors(*text_bytes(batch.column("text")))
            if not len(hashes):
                continue
            yield pa.RecordBatch.from_arrays([pa.array(hashes.view(np.int64)), pa.array(ids[row])], names=["anchor", "doc_id"])

    thin = known_rows(docs).mapInArrow(run, "anchor long, doc_id long")
    return thin.groupBy("anchor").agg(F.min("doc_id").alias("low"), F.max("doc_id").alias("high"), F.count("*").alias("n")).where("low < high").select("anchor", "n")


PIECES = "anchor long, doc_id long, first int, windows int, bytes binary"


def crowded_anchors(shared: DataFrame) -> np.ndarray:
    """Anchors whose pieces could hold more than a block; there is at most one to a block of text."""
    return np.sort(shared.where(F.col("n") > BLOCK // (SPAN + REACH - 1)).select("anchor").toArrow().column("anchor").to_numpy())


def window_pieces(docs: DataFrame, bits: np.ndarray, crowded: np.ndarray) -> DataFrame:
    """Bytes of the windows of shared anchors.  Of equal pieces in a batch only the least document's goes on to
    be sorted; the others are already decided (no bytes: all windows repeat)."""
    shared = docs.sparkSession.sparkContext.broadcast((bits, crowded))
    names = [f.split()[0] for f in PIECES.split(", ")]

    def run(batches):
        bits, crowded = shared.value
        for batch in rows_by(batches, 3 << 20):
            ids = batch.column("doc_id").to_numpy()
            data, borders = text_bytes(batch.column("text"))
            hashes, row, first, windows = anchors(data, borders)
            hit = bit_filter.contains(bits, hashes)
            hashes, row, first, windows = hashes[hit], row[hit], first[hit], windows[hit]
            if not len(hashes):
                continue
            doc, raw = ids[row], data.tobytes()
            least: dict[bytes, int] = {}
            pieces = []
            begin = borders[row] + first
            for d, at, n in zip(doc.tolist(), begin.tolist(), windows.tolist()):
                piece = raw[at:at + n + SPAN - 1]
                pieces.append(piece)
                if least.setdefault(piece, d) > d:
                    least[piece] = d
            own = np.fromiter((least[p] == d for p, d in zip(pieces, doc.tolist())), bool, len(pieces))
            split = own & np.isin(hashes.view(np.int64), crowded)
            keep = np.flatnonzero(~split)
            key = np.where(own, hashes.view(np.int64), mix(doc.view(np.uint64)).view(np.int64))
            yield pa.RecordBatch.from_arrays([pa.array(key[keep]), pa.array(doc[keep]), pa.array(first[keep], pa.int32()), pa.array(windows[keep], pa.int32()),
                                              pa.array([pieces[i] if own[i] else None for i in keep.tolist()], pa.binary())], names=names)
            if split.any():
                of = np.repeat(np.flatnonzero(split), windows[split])
                step = np.arange(len(of)) - np.repeat(np.cumsum(windows[split]) - windows[split], windows[split])
                every = window_hashes(data).view(np.int64)
                for a in range(0, len(of), 1 << 16):
                    o, k = of[a:a + (1 << 16)], step[a:a + (1 << 16)]
                    at = begin[o] + k
                    yield pa.RecordBatch.from_arrays([pa.array(every[at]), pa.array(doc[o]), pa.array(first[o] + k, pa.int32()), pa.array(np.ones(len(o)), pa.int32()),
                                                      pa.array([raw[x:x + SPAN] for x in at.tolist()], pa.binary())], names=names)

    return known_rows(docs).mapInArrow(run, PIECES)


def sort_suffixes(data: np.ndarray, suffix: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Order of the suffixes (positions in ``data``) by their first ``SPAN`` bytes, and where a new value begins.

    ``end``: for each byte the end of its piece; a sampled string stops there."""
    padded = np.concatenate([data, np.zeros(SPAN + 16, np.uint8)])
    # the cover sample: positions from which a suffix may need the rest, sorted by what is left of SPAN bytes
    here = np.arange(len(data))
    sample = here[np.isin(here % MODULUS, COVER) & (end - here >= SPAN - MODULUS + 1)]
    columns = []
    for k in range(0, SPAN, 8):
        word = words_at(padded, sample + k)
        room = np.clip(np.minimum(end[sample], sample + SPAN) - sample - k, 0, 8)
        keep = np.where(room >= 8, ~np.uint64(0), ~(~np.uint64(0) >> (np.uint64(8) * np.minimum(room, 7).astype(np.uint64))))
        columns.append(word & keep)
    order = np.lexsort(columns[::-1])
    rank = np.zeros(len(data), np.int64)
    rank[sample[order]] = np.arange(len(order))
    common = np.full(len(order), SPAN, np.int64)  # bytes shared with the sample before
    for k in range(len(columns) - 1, -1, -1):
        now = columns[k][order]
        diff = np.concatenate([[~np.uint64(0)], now[1:] ^ now[:-1]]) if len(now) else now
        differs = diff != 0
        lead = np.zeros(len(diff), np.int64)
        for b in range(8):
            lead += (diff >> np.uint64(56 - 8 * b) == 0) & differs
        common = np.where(differs, 8 * k + lead, common)
    classes = {}

    def rest(at: np.ndarray, distance: np.ndarray) -> np.ndarray:
        """Rank, among sampled strings cut to SPAN - distance bytes, of the suffix's rest."""
        out = np.zeros(len(at), np.int64)
        for d in np.unique(distance).tolist():
            if d not in classes:
                classes[d] = np.cumsum(common < SPAN - d)
            pick = distance == d
            out[pick] = classes[d][rank[at[pick] + d]]
        return out

    by = np.lexsort((words_at(padded, suffix + 8), words_at(padded, suffix)))
    now = suffix[by]
    a, b = words_at(padded, now), words_at(padded, now + 8)
    group = np.cumsum(np.concatenate([[True], (a[1:] != a[:-1]) | (b[1:] != b[:-1])])) - 1 if len(now) else np.zeros(0, np.int64)
    done = np.zeros(len(now), bool)
    while True:
        # ternary quicksort of all unfinished groups at once: the middle member is the pivot
        size = np.bincount(group)[group] if len(group) else group
        done |= size == 1
        open_ = np.flatnonzero(~done)
        if not len(open_):
            break
        ids, first, inverse, counts = np.unique(group[open_], return_index=True, return_inverse=True, return_counts=True)
        pivot = now[open_[first + counts // 2]][inverse]
        mine = now[open_]
        d = DISTANCE[mine % MODULUS, pivot % MODULUS]
        side = np.sign(rest(mine, d) - rest(pivot, d))
        move = np.lexsort((side, group[open_]))
        now[open_], by[open_], side = mine[move], by[open_][move], side[move]
        done[open_] = side == 0
        fresh = np.zeros(len(group), bool)
        fresh[0] = True
        fresh[1:] = group[1:] != group[:-1]
        change = np.concatenate([[False], (side[1:] != side[:-1])])
        fresh[open_[change]] = True
        group = np.cumsum(fresh) - 1
    opens = np.concatenate([[True], group[1:] != group[:-1]]) if len(group) else np.zeros(0, bool)
    return by, opens


class Block:
    """Distinct pieces of whole buckets, with the places of the least document that holds each."""

    def __init__(self):
        self.pieces: list[tuple[int, bytes, int, list[int]]] = []  # bucket, bytes, doc, firsts
        self.size = 0

    def solve(self):
        """(doc, start, end) of what goes, for the least documents of the pieces."""
        buckets = np.array([p[0] for p in self.pieces])
        alone = np.bincount(buckets)[buckets] == 1 if len(buckets) else np.zeros(0, bool)
        pieces = [p for p, a in zip(self.pieces, alone) if not a]
        self.pieces, self.size = [], 0
        if not pieces:
            return [], [], []
        sizes = np.array([len(p[1]) for p in pieces])
        data = np.frombuffer(b"".join(p[1] for p in pieces), np.uint8)
        starts = np.concatenate([[0], np.cumsum(sizes)])
        owner = np.repeat(np.arange(len(pieces)), sizes)
        suffix = np.flatnonzero(np.arange(len(data)) + SPAN <= starts[1:][owner])
        by, opens = sort_suffixes(data, suffix, starts[1:][owner])
        doc = np.array([p[2] for p in pieces], np.int64)[owner[suffix[by]]]
        at = np.flatnonzero(opens)
        least = np.repeat(np.minimum.reduceat(doc, at), np.diff(np.concatenate([at, [len(doc)]])))
        gone = np.sort(suffix[by][least < doc])
        docs, begins, ends = [], [], []
        if len(gone):
            run = np.flatnonzero(np.concatenate([[True], (np.diff(gone) != 1) | (owner[gone[1:]] != owner[gone[:-1]])]))
            last = gone[np.concatenate([run[1:], [len(gone)]]) - 1]
            for s, e in zip(gone[run].tolist(), last.tolist()):
                _, _, d, firsts = pieces[owner[s]]
                for f in firsts:
                    docs.append(d)
                    begins.append(f + s - int(starts[owner[s]]))
                    ends.append(f + e - int(starts[owner[s]]) + SPAN)
        return docs, begins, ends


def repeated_ranges(pieces: DataFrame) -> DataFrame:
    """(doc_id, begin, end) of removed bytes, overlapping ones not merged."""
    def run(batches):
        block, bucket, last_anchor, last_bytes, last_doc = Block(), -1, None, None, None

        def out(docs, begins, ends):
            return pa.RecordBatch.from_arrays([pa.array(docs, pa.int64()), pa.array(begins, pa.int64()), pa.array(ends, pa.int64())], names=["doc_id", "begin", "end"])

        for batch in batches:
            docs, begins, ends = [], [], []
            for anchor, doc, first, windows, data in zip(*(batch.column(c).to_pylist() for c in ("anchor", "doc_id", "first", "windows", "bytes"))):
                if data is None or (anchor == last_anchor and data == last_bytes and doc > last_doc):
                    docs.append(doc)
                    begins.append(first)
                    ends.append(first + windows + SPAN - 1)
                    continue
                if anchor != last_anchor:
                    if block.size >= BLOCK:
                        yield out(*block.solve())
                        bucket = -1
                    bucket += 1
                elif data == last_bytes:  # again in the same document
                    block.pieces[-1][3].append(first)
                    continue
                last_anchor, last_bytes, last_doc = anchor, data, doc
                block.pieces.append((bucket, data, doc, [first]))
                block.size += len(data)
            if docs:
                yield out(docs, begins, ends)
        yield out(*block.solve())

    near = pieces.repartition(F.col("anchor")).sortWithinPartitions("anchor", "bytes", "doc_id")
    return near.mapInArrow(run, "doc_id long, begin long, end long")


def cut_ranges(docs: DataFrame, ranges: DataFrame) -> DataFrame:
    """(doc_id, n_bytes, n_removed, n_spans, kept, kept_sha256): ``kept`` is the rest as bytes, for it
    may break a character."""
    lists = ranges.groupBy("doc_id").agg(F.collect_list(F.struct("begin", "end")).alias("ranges"))

    def run(batches):
        for batch in rows_by(batches):
            rows = []
            for doc_id, text, ranges in zip(batch.column("doc_id").to_pylist(), batch.column("text").to_pylist(), batch.column("ranges")):
                data = (text or "").encode()
                gone, spans, kept, at = 0, 0, [], 0
                if ranges.is_valid:
                    both = ranges.values
                    begin, end = (both.field(k).to_numpy() for k in (0, 1))
                    order = np.argsort(begin, kind="stable")
                    begin, reach = begin[order], np.minimum(np.maximum.accumulate(end[order]), len(data))
                    opens = np.flatnonzero(np.concatenate([[True], begin[1:] > reach[:-1]]))
                    for b, e in zip(begin[opens].tolist(), reach[np.concatenate([opens[1:], [len(begin)]]) - 1].tolist()):
                        if e > b:
                            kept.append(data[at:b])
                            at, gone, spans = e, gone + e - b, spans + 1
                kept.append(data[at:])
                rest = b"".join(kept)
                rows.append((doc_id, len(data), gone, spans, rest, hashlib.sha256(rest).hexdigest()))
            if rows:
                kinds = [pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.binary(), pa.string()]
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), kinds)], names=["doc_id", "n_bytes", "n_removed", "n_spans", "kept", "kept_sha256"])

    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    return texts.join(lists, "doc_id", "left").select("doc_id", "text", "ranges").mapInArrow(run, "doc_id long, n_bytes long, n_removed long, n_spans long, kept binary, kept_sha256 string")


def drop_substrings(docs: DataFrame) -> DataFrame:
    shared = settle(shared_anchors(docs), "shared-anchors")
    pieces = window_pieces(docs, bit_filter.build(shared, "anchor"), crowded_anchors(shared))
    return cut_ranges(docs, repeated_ranges(pieces))


def op9_query(spark, sf_dir: str) -> DataFrame:
    return drop_substrings(spark.read.parquet(f"{sf_dir}/documents.parquet")).drop("kept")
