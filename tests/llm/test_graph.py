"""Connected components against a plain search, and how often they are written."""

import random

import pytest

from quotegrid.llm import graph


def reached(links):
    near = {}
    for a, b in links:
        near.setdefault(a, set()).add(b)
        near.setdefault(b, set()).add(a)
    least = {}
    for start in sorted(n for n in near if near[n] - {n}):
        waiting = [start]
        while waiting:
            node = waiting.pop()
            if node not in least:
                least[node] = start
                waiting += near[node]
    return least


@pytest.mark.parametrize("chunk,most", [(1 << 17, 1), (5, 9)])
def test_components_need_few_rounds(spark, monkeypatch, chunk, most):
    monkeypatch.setattr(graph, "CHUNK", chunk)
    written = []
    monkeypatch.setattr(graph, "settle", lambda df, name, write=graph.settle: written.append(name) or write(df, name))
    rng = random.Random(3)
    path = list(range(1000, 1200))
    rng.shuffle(path)
    links = list(zip(path, path[1:])) + [(rng.randrange(300), rng.randrange(300)) for _ in range(200)] + [(900, 2000 + i) for i in range(50)] + [(7, 7)]
    rng.shuffle(links)
    got = graph.components(spark.createDataFrame(links, "a long, b long").coalesce(1)).collect()
    assert len(got) == len({r["node"] for r in got}) and {r["node"]: r["component"] for r in got} == reached(links)
    assert len(written) <= most


def test_components_of_nothing(spark):
    assert graph.components(spark.createDataFrame([(1, 1)], "a long, b long")).count() == 0
