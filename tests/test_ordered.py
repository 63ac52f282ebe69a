import random

import pytest
from pyspark.sql import functions as F

from quotegrid.operators.ordered import asof, interval_join, ordinal, previous, running_total


def hot_rows(n=200, seed=3):
    rng = random.Random(seed)
    # One key holds most rows.
    return [(rng.choice(["a", "a", "a", "b"]), i, rng.randrange(0, 400), rng.randrange(10)) for i in range(n)]


@pytest.mark.parametrize("width", [1, 7, 1000])
def test_running_total_and_ordinal(spark, width):
    rows = hot_rows()
    df = spark.createDataFrame(rows, "k string, id bigint, t bigint, v bigint")
    got = {r.id: (r.total, r.rn) for r in running_total(ordinal(df, ["k"], "id", width), ["k"], "id", width, total=F.col("v")).collect()}
    total, seen = {}, {}
    for k, i, _, v in rows:
        total[k] = total.get(k, 0) + v
        seen[k] = seen.get(k, 0) + 1
        assert got[i] == (total[k], seen[k])


@pytest.mark.parametrize("width", [1, 7, 1000])
def test_previous(spark, width):
    rows = hot_rows()
    df = spark.createDataFrame(rows, "k string, id bigint, t bigint, v bigint")
    got = {r.id: r.before for r in previous(df, ["k"], "id", width, "before", "v").collect()}
    last = {}
    for k, i, _, v in rows:
        assert got[i] == last.get(k)
        last[k] = v


@pytest.mark.parametrize("width", [1, 13, 10_000])
@pytest.mark.parametrize("forward,strict", [(False, False), (False, True), (True, False), (True, True)])
def test_asof(spark, width, forward, strict):
    left = hot_rows()
    right = sorted({(k, t) for k, _, t, _ in hot_rows(60, 9)} | {("a", 395)})
    l = spark.createDataFrame(left, "k string, id bigint, t bigint, v bigint")
    r = spark.createDataFrame([(k, t, t * 10) for k, t in right], "k string, t bigint, w bigint")
    got = {x.id: (x.matched_t, x.w) for x in asof(l, r, "t", ["k"], ["w"], forward=forward, strict=strict, width=width).collect()}
    assert len(got) == len(left)
    for k, i, t, _ in left:
        fits = [u for kk, u in right if kk == k and (u > t if forward else u < t) or (kk == k and u == t and not strict)]
        best = (min(fits) if forward else max(fits)) if fits else None
        assert got[i] == (best, None if best is None else best * 10)


def test_interval_join_edges(spark):
    spans = spark.createDataFrame([("x", 10, 20), ("y", 20, 35)], "n string, lo bigint, hi bigint")
    points = spark.createDataFrame([(t,) for t in (9, 10, 11, 20, 21, 35, 36)], "t bigint")
    left = {r.t: r.n for r in interval_join(points, spans, "t", "lo", "hi", bucket=4).collect()}
    right = {r.t: r.n for r in interval_join(points, spans, "t", "lo", "hi", closed="right", bucket=4).collect()}
    assert left == {9: None, 10: "x", 11: "x", 20: "y", 21: "y", 35: None, 36: None}
    assert right == {9: None, 10: None, 11: "x", 20: "x", 21: "y", 35: "y", 36: None}
