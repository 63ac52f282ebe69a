"""N-gram Jaccard join with token-combination prefixes.

Tokens are a document's distinct word shingles.  All documents order their tokens alike: rare ones by hash, then
frequent ones by count.  Two sets that are similar enough differ in at most ``d`` tokens of either, so a prefix that
keeps a common signature after any ``d`` losses finds every pair: rare tokens are signatures alone; of frequent ones
the prefix is extended and every pair within the same hash class is a signature, a class of n tokens surviving n - 2
losses.  How many classes there are depends on the larger set's power of two, so both sides agree; a set near a power
of two emits for both.

Counts come from a sketch over all rows, of fixed size; it decides the order only, so it can't change a result.
Documents with equal sets are one node from the start.  In each signature's bucket every member is verified against
the bucket's first one.  Before sets are moved, bitmaps of four to eight bits a token rule out nearly all pairs that
are not similar: tokens whose bit the other set lacks are not common.  Buckets whose other members then lie in
different components are compared in blocks of bounded size, by bitmaps and between components only.  A block gives
back a spanning forest over its possible links, best first, never its pairs; these are verified and contracted.  Blocks
that held more possible links are compared once more, between the components still apart, and what is left is verified.
Buckets with the same members are compared once.

Defined results: null text, and text without words, is an empty set: linked with nothing, its own component.  A text
with fewer words than a shingle has its whole sequence as one.  Rows with equal text are linked, so a repeated row adds
nothing; rows with a null id are counted but linked with nothing, and their component is null.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from quotegrid.llm import bit_filter
from quotegrid.llm.arrays import mix, rows_by, shingle_sets
from quotegrid.llm.graph import components, forest
from quotegrid.session import settle

WIDTH = 1 << 20
#: Sets under this size use single tokens only.
SMALL_TIER = 3
#: Members and visitors of one block, about.
MEMBERS = 1024
VISITORS = 512


class Order:
    """The order of tokens that all documents share."""

    def __init__(self, counts: np.ndarray, rows: int, share: float = 0.0005):
        mean = float(counts.sum()) / WIDTH
        self.counts = counts
        self.frequent_from = mean + 6 * np.sqrt(mean) + max(64.0, share * rows)

    def split(self, tokens: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Rare tokens by hash, frequent ones by count and hash."""
        n = self.counts[(tokens >> np.uint64(44)).astype(np.int64)]
        often = n >= self.frequent_from
        frequent = tokens[often]
        return tokens[~often], frequent[np.lexsort((frequent, n[often]))]


def _sum_rows(parts: DataFrame) -> DataFrame:
    def add(batches):
        total = None
        for batch in batches:
            for x in batch.column("counts"):
                one = np.frombuffer(x.as_buffer(), np.uint32)
                total = one.copy() if total is None else total + one
        if total is not None:
            yield pa.RecordBatch.from_arrays([pa.array([total.tobytes()], pa.binary())], names=["counts"])

    return parts.mapInArrow(add, "counts binary")


def token_order(docs: DataFrame, shingle: int) -> Order:
    """Sketch of how many rows hold each token: one fixed array per task, added up in a tree."""
    def count(batches):
        total, rows = np.zeros(WIDTH + 1, np.uint32), 0
        for batch in rows_by(batches):
            sets = shingle_sets(batch.column("text"), shingle)
            rows += len(sets)
            if sets:
                total[:WIDTH] += np.bincount((np.concatenate(sets) >> np.uint64(44)).astype(np.int64), minlength=WIDTH).astype(np.uint32)
        total[WIDTH] = rows
        yield pa.RecordBatch.from_arrays([pa.array([total.tobytes()], pa.binary())], names=["counts"])

    parts = docs.select("text").mapInArrow(count, "counts binary")
    n = docs.rdd.getNumPartitions()
    while n > 1:
        n = -(-n // 8)
        parts = _sum_rows(parts.repartition(n))
    got = [np.frombuffer(r["counts"], np.uint32) for r in parts.collect()]  # one array of fixed size
    total = np.sum(got, axis=0, dtype=np.uint64) if got else np.zeros(WIDTH + 1, np.uint64)
    return Order(total[:WIDTH].astype(np.uint32), int(total[WIDTH]))


def losses(n: int, percent: int) -> int:
    """Most tokens of a set of n that a similar set can lack."""
    return n - (n * percent + 99) // 100


def signatures(tokens: np.ndarray, order: Order, percent: int) -> np.ndarray:
    n = len(tokens)
    rare, frequent = order.split(tokens)
    need = losses(n, percent) + 1
    out = []
    top = n * 100 // percent  # largest similar set
    for tier in range(n.bit_length() - 1, top.bit_length()):
        salt = np.uint64((tier + 1) << 48)
        if tier < SMALL_TIER:
            out.append(mix(np.concatenate([rare, frequent])[:need] + salt))
            continue
        out.append(mix(rare[:need] + salt))
        lack = need - len(rare)
        if lack <= 0:
            continue
        classes = (mix(frequent + np.uint64(1)) % np.uint64(max(1, (1 << tier) >> 4))).astype(np.int64)
        # a token adds one to what the prefix survives unless it is its class's first
        by = np.argsort(classes, kind="stable")
        opens = np.ones(len(by), bool)
        opens[1:] = classes[by][1:] != classes[by][:-1]
        adds = np.ones(len(by), np.int64)
        adds[by[opens]] = 0
        taken = int(np.searchsorted(np.cumsum(adds), lack)) + 1
        part, of = frequent[:taken], classes[:taken]
        for c in np.unique(of):
            one = np.sort(part[of == c])
            i, j = np.triu_indices(len(one), 1)
            out.append(mix(mix(one[i] + salt) * np.uint64(0x9E3779B97F4A7C15) + one[j]))
    return np.unique(np.concatenate(out))


def bitmap(tokens: np.ndarray) -> bytes:
    """Four to eight bits a token, set by the token's low bits."""
    bits = 1 << max(6, (4 * len(tokens)).bit_length())
    out = np.zeros(bits, np.uint8)
    out[(tokens & np.uint64(bits - 1)).astype(np.int64)] = 1
    return np.packbits(out, bitorder="little").tobytes()


def folded(maps: list[bytes]) -> np.ndarray:
    """Bitmaps as rows of 64-bit words, all folded to the size of the smallest."""
    words = min(map(len, maps)) // 8
    out = np.zeros((len(maps), words), np.uint64)
    for i, m in enumerate(maps):
        x = np.frombuffer(m, np.uint64)
        out[i] = x if len(x) == words else np.bitwise_or.reduce(x.reshape(-1, words), axis=0)
    return out


def most_common(x: np.ndarray, m: np.ndarray, y: np.ndarray, n: np.ndarray) -> np.ndarray:
    """Most tokens that sets of m and n tokens can share, row by row: of either, one token at least for each bit that
    the other lacks is not shared."""
    both = np.bitwise_count(x & y).sum(axis=-1, dtype=np.int64)
    alone = lambda z, k: k - np.bitwise_count(z).sum(axis=-1, dtype=np.int64)
    return both + np.minimum(alone(x, m), alone(y, n))


def digest(tokens: np.ndarray) -> tuple[int, int]:
    """128 bits of a set."""
    import hashlib

    return tuple(np.frombuffer(hashlib.blake2b(tokens.tobytes(), digest_size=16).digest(), np.int64).tolist())


def sketch_rows(docs: DataFrame, order: Order, shingle: int, percent: int) -> DataFrame:
    """(doc_id, n_shingles, d1, d2, bits, signatures) per row."""
    shared = docs.sparkSession.sparkContext.broadcast(order)  # WIDTH counts

    def run(batches):
        order = shared.value
        for batch in rows_by(batches):
            sets = shingle_sets(batch.column("text"), shingle)
            marks = [digest(s) if len(s) else (0, 0) for s in sets]
            sigs = [signatures(s, order, percent).view(np.int64) if len(s) else np.zeros(0, np.int64) for s in sets]
            cut = np.concatenate([[0], np.cumsum([len(s) for s in sigs])]).astype(np.int32)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array([len(s) for s in sets], pa.int64()), pa.array([m[0] for m in marks], pa.int64()), pa.array([m[1] for m in marks], pa.int64()), pa.array([bitmap(s) for s in sets], pa.binary()),
                                              pa.ListArray.from_arrays(pa.array(cut), pa.array(np.concatenate(sigs) if sigs else np.zeros(0, np.int64)))],
                                             names=["doc_id", "n_shingles", "d1", "d2", "bits", "signatures"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, "doc_id long, n_shingles long, d1 long, d2 long, bits binary, signatures array<long>")


def node_sets(docs: DataFrame, nodes: DataFrame, shingle: int) -> DataFrame:
    """(node, tokens) of the given nodes (node, doc_id, d1, d2), read again from the texts."""
    def run(batches):
        for batch in rows_by(batches):
            sets = shingle_sets(batch.column("text"), shingle)
            marks = [digest(s) for s in sets]
            yield pa.RecordBatch.from_arrays([pa.array([m[0] for m in marks], pa.int64()), pa.array([m[1] for m in marks], pa.int64()), pa.array([s.tobytes() for s in sets], pa.binary())], names=["d1", "d2", "tokens"])

    wanted = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").join(nodes.select("doc_id").distinct(), "doc_id", "left_semi")
    sets = wanted.select("text").mapInArrow(run, "d1 long, d2 long, tokens binary").dropDuplicates(["d1", "d2"])
    return sets.join(nodes.select("node", "d1", "d2"), ["d1", "d2"]).select("node", "tokens")


def screen(pairs: DataFrame, nodes: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, b) that can be similar by their bitmaps."""
    def run(batches):
        for batch in batches:
            m, n = (batch.column(c).to_numpy() for c in ("m", "n"))
            common = np.zeros(batch.num_rows, np.int64)
            for i, (p, q) in enumerate(zip(batch.column("p").to_pylist(), batch.column("q").to_pylist())):
                x, y = folded([p, q])
                common[i] = most_common(x, m[i], y, n[i])
            able = common * 100 >= (m + n - common) * percent
            yield batch.select(["a", "b"]).filter(pa.array(able))

    both = (pairs.join(nodes.select(F.col("node").alias("a"), F.col("n").alias("m"), F.col("bits").alias("p")), "a")
            .join(nodes.select(F.col("node").alias("b"), "n", F.col("bits").alias("q")), "b"))
    return both.select("a", "b", "m", "n", "p", "q").mapInArrow(run, "a long, b long")


def verify(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """(a, b, common, joint) of each pair, from the whole sets."""
    def run(batches):
        for batch in rows_by(batches):
            common, joint = [], []
            for x, y in zip(batch.column("x"), batch.column("y")):
                p, q = (np.frombuffer(v.as_buffer(), np.uint64) for v in (x, y))
                k = len(np.intersect1d(p, q, assume_unique=True))
                common.append(k)
                joint.append(len(p) + len(q) - k)
            yield pa.RecordBatch.from_arrays([batch.column("a"), batch.column("b"), pa.array(common, pa.int64()), pa.array(joint, pa.int64())], names=["a", "b", "common", "joint"])

    both = (pairs.join(sets.select(F.col("node").alias("a"), F.col("tokens").alias("x")), "a")
            .join(sets.select(F.col("node").alias("b"), F.col("tokens").alias("y")), "b"))
    return both.select("a", "b", "x", "y").mapInArrow(run, "a long, b long, common long, joint long")


def unsettled(members: DataFrame, parts: DataFrame) -> DataFrame:
    """Rows (sig, node, n, part, main, m_parts, q_parts) of the buckets whose members lie in several parts, buckets with
    the same members once.  Pairs of the bucket's center are known, so it is left out; ``main`` is the largest part."""
    rows = members.where("node <> center").join(parts, "node", "left").select("sig", "node", "n", F.coalesce("component", "node").alias("part"))
    mark = lambda salt: F.sum(F.pmod(F.xxhash64("node", F.lit(salt)), F.lit(1 << 40)))
    each = rows.groupBy("sig", "part").agg(F.count("*").alias("k"), mark("x").alias("x"), mark("y").alias("y"), F.min("node").alias("low"), F.max("node").alias("high"))
    whole = each.groupBy("sig").agg(F.count("*").alias("apart"), F.sum("k").alias("m"), F.max("k").alias("top"), F.max_by("part", F.struct("k", "part")).alias("main"),
                                    *[F.sum(c).alias(c) for c in ("x", "y")], F.min("low").alias("low"), F.max("high").alias("high")).where("apart > 1")
    once = whole.groupBy("m", "x", "y", "low", "high").agg(F.min_by(F.struct("sig", "main", "top"), "sig").alias("one"))
    parts_of = lambda n, most: F.ceil(n / most).cast("int")
    sizes = once.select("one.sig", "one.main", parts_of(F.col("m"), MEMBERS).alias("m_parts"), parts_of(F.col("m") - F.col("one.top"), VISITORS).alias("q_parts"))
    return rows.join(sizes, "sig")


def block_rows(rows: DataFrame, nodes: DataFrame) -> DataFrame:
    """Rows of blocks (sig, m_part, q_part): up to about ``MEMBERS`` members, and ``VISITORS`` of those outside the main
    part, each visitor meeting each member of its bucket in one block."""
    at = lambda m, q, member, visitor: F.struct(m.alias("m_part"), q.alias("q_part"), member.alias("member"), visitor.alias("visitor"))
    one = lambda parts, salt: F.pmod(F.xxhash64("node", F.lit(salt)), F.col(parts)).cast("int")
    each = lambda parts: F.sequence(F.lit(0), F.col(parts) - 1)
    outside, yes, no = F.col("part") != F.col("main"), F.lit(True), F.lit(False)
    alone = F.array(at(F.lit(0), F.lit(0), yes, outside))
    member = F.transform(each("q_parts"), lambda q: at(one("m_parts", "m"), q, yes, no))
    visitor = F.transform(each("m_parts"), lambda m: at(m, one("q_parts", "q"), no, yes))
    places = F.when((F.col("m_parts") == 1) & (F.col("q_parts") == 1), alone).when(outside, F.concat(member, visitor)).otherwise(member)
    spread = rows.select("sig", "node", "part", "main", F.explode(places).alias("at")).select("sig", "at.*", "node", "part", "main")
    return spread.join(nodes.select("node", "n", "bits"), "node")


def best_forest(a: np.ndarray, b: np.ndarray, weight: np.ndarray, n: int) -> np.ndarray:
    """Places of the edges (a, b) of a spanning forest over n points, heaviest first: every group takes its best edge
    to another one until none is left."""
    label, taken = np.arange(n), np.zeros(len(a), bool)
    order = np.argsort(-weight, kind="stable")
    while True:
        cross = order[label[a[order]] != label[b[order]]]
        if not len(cross):
            return np.flatnonzero(taken)
        _, i = np.unique(np.stack([label[a[cross]], label[b[cross]]], axis=1), return_index=True)
        taken[cross[i // 2]] = True
        at = np.flatnonzero(taken)
        label = forest(n, a[at], b[at])


def compare_block(block: pa.RecordBatch, percent: int, whole: bool) -> tuple[np.ndarray, np.ndarray, bool]:
    """Possible links (a, b) between different parts of a block, or a forest of them, and whether there were more."""
    node, part, main, n = (block.column(c).to_numpy() for c in ("node", "part", "main", "n"))
    member, visitor = (block.column(c).to_numpy(zero_copy_only=False) for c in ("member", "visitor"))
    bits = folded(block.column("bits").to_pylist())
    own = np.bitwise_count(bits).sum(axis=1, dtype=np.int64)
    members = np.flatnonzero(member)
    theirs, alone = bits[members], n[members] - own[members]
    inside = part[members] == main[members]
    found = []
    for v in np.flatnonzero(visitor):
        common = np.bitwise_count(theirs & bits[v]).sum(axis=1, dtype=np.int64) + np.minimum(alone, n[v] - own[v])
        joint = n[v] + n[members] - common
        # two visitors meet in two blocks, or twice in one
        hit = np.flatnonzero((common * 100 >= joint * percent) & (part[members] != part[v]) & (inside | (node[members] > node[v])))
        found.append((np.full(len(hit), v), members[hit], common[hit] / joint[hit]))
    a, b, weight = (np.concatenate(x) for x in zip(*found)) if found else (np.zeros(0, np.int64),) * 3
    if whole or not len(a):
        return node[a], node[b], False
    names, place = np.unique(part, return_inverse=True)
    at = best_forest(place[a], place[b], weight, len(names))
    return node[a[at]], node[b[at]], len(at) < len(a)


def possible_links(rows: DataFrame, nodes: DataFrame, percent: int, whole: bool) -> DataFrame:
    """(sig, a, b, more) of every block: its possible links between parts, all of them or a spanning forest."""
    keys = ["sig", "m_part", "q_part"]

    def blocks(batches):
        held = []
        for batch in batches:
            held.append(batch)
            table = pa.Table.from_batches(held).combine_chunks().to_batches()[0] if held and batch.num_rows else None
            if table is None:
                continue
            edges = np.zeros(table.num_rows, bool)
            edges[0] = True
            for k in keys:
                x = table.column(k).to_numpy()
                edges[1:] |= x[1:] != x[:-1]
            cuts = np.flatnonzero(edges).tolist()
            for a, b in zip(cuts, cuts[1:]):
                yield table.slice(a, b - a)
            held = [table.slice(cuts[-1])]  # the last block may go on
        if held and sum(b.num_rows for b in held):
            yield pa.Table.from_batches(held).combine_chunks().to_batches()[0]

    def run(batches):
        for block in blocks(batches):
            a, b, more = compare_block(block, percent, whole)
            if len(a):
                sig = np.full(len(a), block.column("sig")[0].as_py())
                yield pa.RecordBatch.from_arrays([pa.array(sig), pa.array(np.minimum(a, b)), pa.array(np.maximum(a, b)), pa.array(np.full(len(a), more))], names=["sig", "a", "b", "more"])

    dealt = block_rows(rows, nodes).repartition(*keys).sortWithinPartitions(*keys)
    return dealt.select(*keys, "member", "visitor", "node", "part", "main", "n", "bits").mapInArrow(run, "sig long, a long, b long, more boolean")


def meeting(rows: DataFrame, bits: np.ndarray) -> DataFrame:
    """The rows that have signatures in the filter, with these only."""
    held = rows.sparkSession.sparkContext.broadcast(bits)

    def run(batches):
        for batch in batches:
            column = batch.column("signatures")
            values = column.flatten().to_numpy()
            hit = bit_filter.contains(held.value, values)
            owner = np.repeat(np.arange(len(column)), column.value_lengths().to_numpy(zero_copy_only=False))
            n = np.bincount(owner[hit], minlength=len(column))
            lists = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(n)]).astype(np.int32)), pa.array(values[hit]))
            at = batch.schema.get_field_index("signatures")
            yield batch.set_column(at, "signatures", lists).filter(pa.array(n > 0))

    return rows.where("n_shingles > 0 AND doc_id IS NOT NULL").mapInArrow(run, rows.schema)


def ends_of(pairs: DataFrame, nodes: DataFrame) -> DataFrame:
    return nodes.join(pairs.select(F.explode(F.array("a", "b")).alias("node")).distinct(), "node", "left_semi").select("node", "doc_id", "d1", "d2")


def stars(parts: DataFrame) -> DataFrame:
    """Links (a, b) that give back known parts."""
    return parts.select(F.col("node").alias("a"), F.col("component").alias("b"))


def similar_components(docs: DataFrame, shingle: int = 5, percent: int = 80) -> DataFrame:
    """(doc_id, n_shingles, component_id) per row: the least doc_id reachable over pairs with
    100 * common >= percent * joint."""
    order = token_order(docs, shingle)
    rows = settle(sketch_rows(docs, order, shingle, percent), "sets")
    one = rows.where("n_shingles > 0 AND doc_id IS NOT NULL").groupBy("d1", "d2").agg(F.min("doc_id").alias("doc_id"))
    nodes = settle(one.withColumn("node", F.monotonically_increasing_id()), "nodes")
    # signatures of one row only can't meet another; the rest are few, and only they are moved with their rows
    lone = rows.where("doc_id IS NOT NULL").select("doc_id", F.explode("signatures").alias("sig")).groupBy("sig").agg(F.min("doc_id").alias("low"), F.max("doc_id").alias("high"))
    shared = settle(lone.where("low < high").select("sig"), "shared-signatures")
    first = meeting(rows.drop("bits"), bit_filter.build(shared, "sig")).join(nodes, ["d1", "d2", "doc_id"])
    tokens = first.select("node", F.col("n_shingles").alias("n"), F.explode("signatures").alias("sig"))
    buckets = tokens.groupBy("sig").agg(F.min("node").alias("center"), F.max("node").alias("last")).where("center < last").select("sig", "center")
    members = settle(tokens.join(buckets, "sig").select("sig", "node", "n", "center"), "members")

    needed = nodes.join(members.select("node").distinct(), "node", "left_semi")
    bits = settle(rows.select("doc_id", "d1", "d2", F.col("n_shingles").alias("n"), "bits").join(needed, ["d1", "d2", "doc_id"]).dropDuplicates(["node"]), "bitmaps")

    def linked(pairs: DataFrame) -> DataFrame:
        common = verify(pairs, node_sets(docs, ends_of(pairs, bits), shingle))
        return settle(common.where(F.col("common") * 100 >= F.col("joint") * percent).select("a", "b"), "linked")

    pairs = members.where("node <> center").select(F.col("center").alias("a"), F.col("node").alias("b")).distinct()
    links = linked(settle(screen(pairs, bits, percent), "stars"))
    parts = components(links)
    rows_apart = settle(unsettled(members, parts), "unsettled")
    possible = settle(possible_links(rows_apart, bits, percent, False), "possible")
    tried = settle(possible.select("a", "b").distinct(), "tried")
    joined = components(stars(parts).unionByName(linked(tried)))
    again = possible.where("more").select("sig").distinct()
    if not again.isEmpty():
        joined = settle(joined, "joined")
        left = rows_apart.join(again, "sig", "left_semi").join(joined, "node", "left").withColumn("part", F.coalesce("component", "node")).drop("component")
        rest = settle(possible_links(left, bits, percent, True).select("a", "b").distinct().join(tried, ["a", "b"], "left_anti"), "rest")
        joined = components(stars(joined).unionByName(linked(rest)))
    named = nodes.select("node", "d1", "d2", "doc_id").join(joined, "node", "left").withColumn("component", F.coalesce("component", "node"))
    least = named.groupBy("component").agg(F.min("doc_id").alias("component_id"))
    classes = settle(named.join(least, "component").select("d1", "d2", "component_id"), "classes")
    return (rows.select("doc_id", "n_shingles", "d1", "d2").join(classes, ["d1", "d2"], "left")
            .select("doc_id", "n_shingles", F.when(F.col("doc_id").isNotNull(), F.coalesce("component_id", "doc_id")).alias("component_id")))


def op7_query(spark, sf_dir: str) -> DataFrame:
    return similar_components(spark.read.parquet(f"{sf_dir}/documents.parquet"), shingle=3, percent=90)
