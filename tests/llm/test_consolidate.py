import random

import pytest

from kgloom.llm.consolidate import groups


def brute(edges):
    parent = {}

    def find(x):
        parent.setdefault(x, x)
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in edges:
        if a is None or b is None:
            continue
        x, y = find(a), find(b)
        parent[max(x, y)] = min(x, y)
    return {(v, find(v)) for v in parent}


@pytest.mark.parametrize("bound", [3, 10, 1000])
@pytest.mark.parametrize("shape", ["random", "path", "star", "alone"])
def test_groups(spark, bound, shape):
    r = random.Random(bound)
    ids = r.sample(range(1, 10_000), 90)
    edges = {
        "random": [(r.choice(ids), r.choice(ids)) for _ in range(80)] + [(None, 5), (7, None)],
        "path": list(zip(ids, ids[1:], strict=False)),
        "star": [(ids[40], x) for x in ids] + [(x, ids[40]) for x in ids],
        "alone": [(x, x) for x in ids],
    }[shape]
    df = spark.createDataFrame(edges, "a long, b long").repartition(4)
    if bound == 3:
        df = df.limit(25) if shape != "random" else df.limit(30)
        edges = [tuple(x) for x in df.collect()]
        df = spark.createDataFrame(edges, "a long, b long")
    assert {tuple(x) for x in groups(df, bound).collect()} == brute(edges)


def test_no_edges(spark):
    assert groups(spark.createDataFrame([], "a long, b long")).count() == 0
