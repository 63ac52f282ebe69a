"""Connected components over DataFrames of links."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from quotegrid.session import settle

#: Links that a task contracts at once.
CHUNK = 1 << 17


def forest(n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Least reachable index of each of n points, by repeated minimum over links."""
    label = np.arange(n)
    while True:
        low = np.minimum(label[a], label[b])
        fresh = label.copy()
        np.minimum.at(fresh, a, low)
        np.minimum.at(fresh, b, low)
        fresh = fresh[fresh]
        if (fresh == label).all():
            return label
        label = fresh


def contracted(links: DataFrame) -> DataFrame:
    """Links (a, b), a > b, with the same components: every chunk's nodes to the least node they reach inside it."""
    def one(chunk):
        node, at = np.unique(np.concatenate([np.concatenate([x.column(c).to_numpy() for x in chunk]) for c in ("a", "b")]), return_inverse=True)
        least = node[forest(len(node), at[:len(at) // 2], at[len(at) // 2:])]
        off = least != node
        return pa.RecordBatch.from_arrays([pa.array(node[off]), pa.array(least[off])], names=["a", "b"])

    def run(batches):
        chunk = []
        for batch in batches:
            if batch.num_rows:
                chunk.append(batch)
            if sum(x.num_rows for x in chunk) >= CHUNK:
                yield one(chunk)
                chunk = []
        if chunk:
            yield one(chunk)

    return links.select(F.col("a").cast("long").alias("a"), F.col("b").cast("long").alias("b")).mapInArrow(run, "a long, b long")


def all_stars(links: DataFrame) -> bool:
    """Whether every node either has one link down and none up, or is the least of its component."""
    side = lambda c: F.struct(F.col(c).alias("node"), F.lit(c == "a").alias("down"))
    ends = links.select(F.inline(F.array(side("a"), side("b"))))
    down, up = F.count_if("down"), F.count_if(~F.col("down"))
    return ends.groupBy("node").agg(down.alias("down"), up.alias("up")).where("down > 1 OR (down > 0 AND up > 0)").isEmpty()


def _star(links: DataFrame, large: bool) -> DataFrame:
    """One star step over links (a, b), a > b.  Large: neighbours above a node move to the least node
    around it; small: a node and its neighbours below move to the least of them."""
    around = links.select("a", "b") if not large else links.select("a", "b").unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b")))
    least = around.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
    joined = around.join(least, "a")
    if large:
        out = joined.where(F.col("b") > F.col("a")).select(F.col("b").alias("a"), F.col("m").alias("b"))
    else:
        out = joined.select(F.col("b").alias("a"), F.col("m").alias("b")).unionByName(least.select("a", F.col("m").alias("b")))
    return out.where(F.col("a") != F.col("b")).distinct()


def components(links: DataFrame) -> DataFrame:
    """(node, component): the least node reachable, for every node with a link in (a, b).

    Tasks contract their links first.  Alternating large and small star steps then need logarithmically many rounds;
    each round is written to the shared folder, so lineage stays short.  The end is reached when only stars are left."""
    here = settle(contracted(links.where("a <> b")).distinct(), "links")
    while not all_stars(here):
        here = settle(_star(_star(here, True), False), "links")
    return here.select(F.col("a").alias("node"), F.col("b").alias("component")).unionByName(here.select(F.col("b").alias("node"), F.col("b").alias("component"))).distinct()
