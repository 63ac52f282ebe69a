"""Embedding near-duplicates by an inverted multi-index.

Each half of the unit vectors has a codebook of its own; pairs of codes are the cells of a product grid.  A vector
lives in its nearest cell and visits the nearest cells in order of summed distance (multi-sequence traversal), as many
as a measured sample of queries that have links needs for the target recall; with too few of them, all cells.  Visitors are verified against the members by cosine in
double precision, so no link under the threshold is ever reported.

Equal vectors are one node with a multiplicity.  Cells are compared in blocks of bounded size, however many vectors
they hold; a block returns a count per node and a spanning forest of its links, never the pairs.

The codebooks are fitted on ``SAMPLE`` vectors and the number of visits on ``QUERIES`` queries with links, each against
all rows; every row is indexed and every row is a query.

Defined results: null, zero and non-finite vectors have no links and are their own component; vectors of different
length never link.  Rows with a null id have no links and a null component.  Rows that repeat an id are vectors of
their own and count as each other's links.  Labels and extra columns are not read.
"""

from __future__ import annotations

import hashlib
import heapq

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from quotegrid.llm.arrays import one_array
from quotegrid.llm.graph import components, forest
from quotegrid.session import settle

SAMPLE, QUERIES, MOST_QUERIES = 20000, 256, 1 << 15
CELL, MOST_CODES = 128, 256  # rows a cell should have; codes of a half, so cells are 65,536 at most
MEMBERS, VISITORS = 1024, 4096  # of one block


def unit_rows(rows: DataFrame) -> DataFrame:
    """(vec_id, size, d1, d2, unit): size 0 and no unit where a vector links with nothing."""
    def run(batches):
        for batch in batches:
            ids, sizes, marks, units = batch.column("vec_id"), [], [], []
            for known, x in zip(ids.is_valid(), batch.column("embedding")):
                v = np.array(x.as_py(), dtype=np.float64) if x.is_valid and known.as_py() and x.values.null_count == 0 else np.zeros(0)
                top = np.abs(v).max() if v.size and np.isfinite(v).all() else 0.0
                if top > 0:
                    v = v / top
                    v = v / np.sqrt((v * v).sum())
                    unit = v.tobytes()
                    units.append(unit)
                    marks.append(np.frombuffer(hashlib.blake2b(unit, digest_size=16).digest(), np.int64))
                    sizes.append(len(v))
                else:
                    units.append(None)
                    marks.append((0, 0))
                    sizes.append(0)
            yield pa.RecordBatch.from_arrays([ids, pa.array(sizes, pa.int32()), pa.array([m[0] for m in marks], pa.int64()), pa.array([m[1] for m in marks], pa.int64()), pa.array(units, pa.binary())],
                                             names=["vec_id", "size", "d1", "d2", "unit"])

    return rows.select(F.col("vec_id").cast("long").alias("vec_id"), "embedding").mapInArrow(run, "vec_id long, size int, d1 long, d2 long, unit binary")


def matrix(column) -> np.ndarray:
    column = one_array(column)
    return np.frombuffer(b"".join(x.as_py() for x in column), np.float64).reshape(len(column), -1)


def distances(x: np.ndarray, codes: np.ndarray) -> np.ndarray:
    return np.maximum(0, (x * x).sum(1)[:, None] - 2 * x @ codes.T + (codes * codes).sum(1)[None, :])


def codebook(x: np.ndarray, k: int, rounds: int = 8) -> np.ndarray:
    """Lloyd's k-means from rows spread over the sample."""
    codes = x[np.linspace(0, len(x) - 1, k).astype(int)].copy()
    for _ in range(rounds):
        near = distances(x, codes).argmin(1)
        n = np.bincount(near, minlength=k)
        for d in range(x.shape[1]):
            codes[n > 0, d] = np.bincount(near, weights=x[:, d], minlength=k)[n > 0] / n[n > 0]
    return codes


class Grid:
    def __init__(self, first: np.ndarray, second: np.ndarray):
        self.first, self.second = first, second

    def halves(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        h = x.shape[1] // 2
        return distances(x[:, :h], self.first), distances(x[:, h:], self.second)

    def home(self, x: np.ndarray) -> np.ndarray:
        a, b = self.halves(x)
        return a.argmin(1) * len(self.second) + b.argmin(1)

    def nearest(self, x: np.ndarray, visits: int) -> np.ndarray:
        """Multi-sequence traversal: a cell is reached only after its neighbours nearer on either half."""
        a, b = self.halves(x)
        ia, ib = a.argsort(1, kind="stable"), b.argsort(1, kind="stable")
        a, b = np.take_along_axis(a, ia, 1).tolist(), np.take_along_axis(b, ib, 1).tolist()
        visits = min(visits, len(self.first) * len(self.second))
        out = np.empty((len(x), visits), np.int64)
        for r, (da, db) in enumerate(zip(a, b)):
            heap, done = [(da[0] + db[0], 0, 0)], [0] * len(da)
            for t in range(visits):
                _, i, j = heapq.heappop(heap)
                out[r, t] = ia[r, i] * len(self.second) + ib[r, j]
                done[i] = j + 1
                if i + 1 < len(da) and (j == 0 or done[i + 1] > j - 1) and done[i + 1] == j:
                    heapq.heappush(heap, (da[i + 1] + db[j], i + 1, j))
                if j + 1 < len(db) and (i == 0 or done[i - 1] > j + 1):
                    heapq.heappush(heap, (da[i] + db[j + 1], i, j + 1))
        return out


def fit_grid(nodes: DataFrame, total: int) -> Grid:
    drawn = nodes.select("unit") if total <= SAMPLE else nodes.where(F.pmod(F.xxhash64("node"), F.lit(1 << 30)) < int((1 << 30) * SAMPLE / total)).select("unit")
    x = matrix(drawn.toArrow().column("unit"))
    k = max(1, min(MOST_CODES, int(np.ceil(np.sqrt(total / CELL))), len(x)))
    h = x.shape[1] // 2
    return Grid(codebook(x[:, :h], k), codebook(x[:, h:], k))


def link_ranks(nodes: DataFrame, drawn: pa.Table, grid: Grid, threshold: float) -> DataFrame:
    """(query, rank, n): links of each query, its own node left out, by the place of their cell in its traversal."""
    shared = nodes.sparkSession.sparkContext.broadcast((grid, drawn.column("node").to_numpy(), matrix(drawn.column("unit"))))

    def run(batches):
        grid, names, queries = shared.value
        cells = len(grid.first) * len(grid.second)
        for batch in batches:
            if not batch.num_rows:
                continue
            x, node = matrix(batch.column("unit")), batch.column("node").to_numpy()
            home = grid.home(x)
            for at in range(0, len(queries), 512):
                q, m = np.nonzero(queries[at:at + 512] @ x.T >= threshold)
                other = names[at + q] != node[m]
                q, m = q[other], m[other]
                if not len(q):
                    continue
                a, b = grid.halves(queries[at:at + 512])
                pairs, n = np.unique(q * cells + home[m], return_counts=True)
                q, cell = np.divmod(pairs, cells)
                ranks = [int(((a[i][:, None] + b[i][None, :]) < a[i][c // len(grid.second)] + b[i][c % len(grid.second)]).sum()) for i, c in zip(q, cell)]
                yield pa.RecordBatch.from_arrays([pa.array(names[at + q]), pa.array(ranks, pa.int32()), pa.array(n, pa.int64())], names=["query", "rank", "n"])

    return nodes.select("node", "unit").mapInArrow(run, "query long, rank int, n long").groupBy("query", "rank").agg(F.sum("n").alias("n"))


def visits_needed(nodes: DataFrame, total: int, grid: Grid, threshold: float, target: float) -> int:
    """Cells in traversal order that hold ``target`` of the links of sampled queries, by brute force.

    Recall is the mean over queries that have links, once with equal weights and once with 1 / (links + 1), so that
    a group counts once however large it is; both must reach the target.  Queries are drawn until ``QUERIES`` of them
    count (the weights' effective number) or none is left.  Where ``MOST_QUERIES`` are not enough: all cells."""
    cells = len(grid.first) * len(grid.second)
    sums: dict[int, np.ndarray] = {}  # rank: shares of the queries' links there, by power of the weight
    drawn, low, effective = QUERIES, 0, 0.0
    while True:
        high = min(1 << 30, max(low + 1, (1 << 30) * drawn // total))
        place = F.pmod(F.xxhash64("node", F.lit("q")), F.lit(1 << 30))
        queries = nodes.where((place >= low) & (place < high)).select("node", "unit").toArrow()
        if queries.num_rows:
            each = link_ranks(nodes, queries, grid, threshold).groupBy("query").agg(F.sum("n").alias("links"), F.collect_list(F.struct("rank", "n")).alias("at"))
            share = each.select("links", F.explode("at").alias("at")).select("at.rank", (F.col("at.n") / F.col("links")).alias("share"), (1 / (F.col("links") + 1)).alias("w"))
            for r in share.groupBy("rank").agg(*[F.sum(F.col("share") * F.pow("w", F.lit(p))).alias(f"w{p}") for p in range(3)]).collect():
                sums[r["rank"]] = sums.get(r["rank"], np.zeros(3)) + [r["w0"], r["w1"], r["w2"]]
        ranks = sorted(sums)
        held = np.array([sums[r] for r in ranks]).reshape(len(ranks), 3)
        count, weight, squares = held.sum(0)
        effective = weight * weight / squares if count else 0.0
        if high == 1 << 30 or effective >= QUERIES:
            break
        if drawn >= MOST_QUERIES:
            return cells
        drawn, low = min(4 * drawn, MOST_QUERIES), high
    if not ranks:
        return 1  # every node was a query: there are no links
    enough = (held.cumsum(0)[:, :2] >= target * held.sum(0)[:2] * (1 - 1e-12)).all(1)
    return ranks[int(np.argmax(enough))] + 1


def compare_block(table: pa.Table, threshold: float) -> pa.Table:
    """Links between a cell's members and visitors: (node, links, root) of every node that has any.

    A link found from both sides counts where the cell's number is less, or, inside one cell, once."""
    member = table.column("member").to_numpy().astype(bool)
    node, n, home = (table.column(c).to_numpy() for c in ("node", "n", "home"))
    unit = matrix(table.column("unit"))
    visits = [frozenset(v) for v in table.column("visits").to_pylist()]
    m, q = np.flatnonzero(member), np.flatnonzero(~member)
    weight = np.zeros(len(node), np.int64)
    left, right = [], []
    for a in range(0, len(q), 512):
        i, j = np.nonzero(unit[q[a:a + 512]] @ unit[m].T >= threshold)
        i, j = q[a + i], m[j]
        same = home[i] == home[j]
        ok = np.where(same, node[i] < node[j], True)
        both = np.flatnonzero(~same)
        if len(both):
            back = np.array([h in visits[y] for h, y in zip(home[i[both]].tolist(), j[both].tolist())], bool)
            ok[both] = ~back | (home[j[both]] < home[i[both]])
        left.append(i[ok])
        right.append(j[ok])
    i, j = (np.concatenate(x) if x else np.zeros(0, np.int64) for x in (left, right))
    np.add.at(weight, i, n[j])
    np.add.at(weight, j, n[i])
    # a node may be here as member and as visitor: links and roots are by node
    names, place = np.unique(node, return_inverse=True)
    root = names[forest(len(names), place[i], place[j])]
    links = np.bincount(place, weights=weight, minlength=len(names)).astype(np.int64)
    at = np.flatnonzero(links > 0)
    return pa.table({"node": pa.array(names[at], pa.int64()), "links": pa.array(links[at]), "root": pa.array(root[at], pa.int64())})


def link_nodes(nodes: DataFrame, threshold: float, target: float) -> DataFrame:
    """(node, links, root) of the blocks of one vector length."""
    total = nodes.count()
    grid = fit_grid(nodes, total)
    visits = visits_needed(nodes, total, grid, threshold, target)
    if 2 * visits > len(grid.first) * len(grid.second):  # one cell of all rows is cut into fewer blocks
        grid, visits = Grid(grid.first[:1], grid.second[:1]), 1
    shared = nodes.sparkSession.sparkContext.broadcast(grid)

    def place(batches):
        for batch in batches:
            if batch.num_rows:
                x = matrix(batch.column("unit"))
                near = shared.value.nearest(x, visits)
                yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(near[:, 0]), pa.array(list(near), pa.list_(pa.int64()))], names=["node", "n", "unit", "home", "visits"])

    placed = settle(nodes.select("node", "n", "unit").mapInArrow(place, "node long, n long, unit binary, home long, visits array<long>"), "placed")
    visitor = placed.withColumn("cell", F.explode("visits"))
    # rows per cell: at most MOST_CODES squared of them
    sizes = (placed.groupBy(F.col("home").alias("cell")).count().select("cell", F.ceil(F.col("count") / MEMBERS).cast("int").alias("m_parts"))
             .join(visitor.groupBy("cell").count().select("cell", F.ceil(F.col("count") / VISITORS).cast("int").alias("q_parts")), "cell"))
    sizes = F.broadcast(settle(sizes, "cells"))
    one = lambda parts, salt: F.pmod(F.xxhash64("node", F.lit(salt)), F.col(parts)).cast("int")
    each = lambda parts: F.explode(F.sequence(F.lit(0), F.col(parts) - 1))
    columns = ["cell", "m_part", "q_part", "member", "node", "n", "unit", "home", "visits"]
    members = placed.withColumn("cell", F.col("home")).join(sizes, "cell").withColumn("member", F.lit(True)).withColumn("m_part", one("m_parts", "m")).withColumn("q_part", each("q_parts")).select(columns)
    visitors = visitor.join(sizes, "cell").withColumn("member", F.lit(False)).withColumn("q_part", one("q_parts", "q")).withColumn("m_part", each("m_parts")).select(columns)
    return members.unionByName(visitors).groupBy("cell", "m_part", "q_part").applyInArrow(lambda t: compare_block(t, threshold), "node long, links long, root long")


def near_duplicates(rows: DataFrame, threshold: float = 0.95, target: float = 0.995) -> DataFrame:
    """(vec_id, n_links, component_id, kept) per row."""
    units = settle(unit_rows(rows), "units")
    nodes = settle(units.where("size > 0").groupBy("size", "d1", "d2").agg(F.min("vec_id").alias("first"), F.count("*").alias("n"), F.any_value("unit").alias("unit")).withColumn("node", F.monotonically_increasing_id()), "nodes")
    found = None
    for r in nodes.select("size").distinct().collect():  # vector lengths
        part = link_nodes(nodes.where(F.col("size") == r["size"]), threshold, target)
        found = part if found is None else found.unionByName(part)
    if found is None:
        return units.select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"), F.col("vec_id").isNotNull().alias("kept"))
    found = settle(found, "links")
    joined = components(found.select(F.col("node").alias("a"), F.col("root").alias("b")))
    links = found.groupBy("node").agg(F.sum("links").alias("links"))
    named = nodes.select("node", "d1", "d2", "n", "first").join(joined, "node", "left").join(links, "node", "left").withColumn("component", F.coalesce("component", "node"))
    least = named.groupBy("component").agg(F.min("first").alias("component_id"))
    classes = settle(named.join(least, "component").select("d1", "d2", (F.coalesce("links", F.lit(0)) + F.col("n") - 1).alias("n_links"), "component_id"), "classes")
    out = units.select("vec_id", "d1", "d2").join(classes, ["d1", "d2"], "left").select("vec_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), F.coalesce("component_id", "vec_id").alias("component_id"))
    return out.withColumn("kept", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(False)))


def op6_query(spark, sf_dir: str) -> DataFrame:
    return near_duplicates(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))
