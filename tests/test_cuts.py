import random

import pytest

from kgloom.operators import cuts as C
from kgloom.operators import graph as G


def reach(edges, start, without=frozenset(), directed=False):
    seen, todo = {start}, [start]
    while todo:
        v = todo.pop()
        for a, b in edges:
            if (a, b) in without:
                continue
            for x, y in ((a, b),) if directed else ((a, b), (b, a)):
                if x == v and y not in seen:
                    seen.add(y)
                    todo.append(y)
    return seen


@pytest.fixture(scope="module")
def drawn():
    r = random.Random(4)
    e = {tuple(sorted(r.sample([f"n{i:02d}" for i in range(26)], 2))) for _ in range(24)} | {(f"p{i:02d}", f"p{i + 1:02d}") for i in range(9)} | {("n00", "p00")}
    return sorted(e)


@pytest.mark.parametrize("bound", [1000, 25])
def test_cuts_sides_and_crossing_pairs(spark, drawn, bound):
    df = spark.createDataFrame(drawn, "a string, b string")
    nodes = sorted({v for e in drawn for v in e})
    bridge = {e for e in drawn if e[1] not in reach(drawn, e[0], {e})}
    cuts, walk = C.bridge_cuts(df, bound)
    got = {}
    for x in C.side_members(cuts, walk).collect():
        got.setdefault((x.a, x.b), set()).add(x.node)
    assert set(got) == bridge
    for e, side in got.items():
        parts = [reach(drawn, v, {e}) for v in e]
        assert side in parts and len(side) == min(map(len, parts))
    r = random.Random(1)
    pairs = [(r.choice(nodes), "r", r.choice([*nodes, "out"])) for _ in range(40)]
    want = set()
    for h, _, t in set(pairs):
        if t in nodes and t in reach(drawn, h):
            want |= {(h, "r", t, *e) for e in bridge if t not in reach(drawn, h, {e})}
    k = spark.createDataFrame(sorted(set(pairs)), "h string, r string, t string")
    rows = [tuple(x) for x in C.crossing(k, df, bound=bound).collect()]
    assert len(rows) == len(set(rows)) and set(rows) == want
    if bound == 25:
        return
    some = sorted(bridge)[::2]
    assert {tuple(x) for x in C.crossing(k, df, spark.createDataFrame(some, "a string, b string"), bound).collect()} == {x for x in want if x[3:] in some}
    swaps = [(*r.choice(drawn), h, t) for h, _, t in pairs]
    out = C.connected_after_swaps(spark.createDataFrame(sorted(set(swaps)), "a string, b string, h string, t string"), df, bound)
    for x in out.collect():
        assert x.whole == (x.b in reach([*drawn, (x.h, x.t)] if x.h in nodes and x.t in nodes else drawn, x.a, {(x.a, x.b)} if (x.h, x.t) != (x.a, x.b) else set())), x


def test_bridge_tree_of_nothing(spark):
    df = spark.createDataFrame([], "a string, b string")
    member, tree = C.bridge_tree(df)
    assert member.count() == 0 and tree.count() == 0
    assert C.crossing(spark.createDataFrame([("x", "r", "y")], "h string, r string, t string"), df).count() == 0


def test_strong_components(spark):
    r = random.Random(2)
    arcs = sorted({(f"n{r.randrange(30):02d}", f"n{r.randrange(30):02d}") for _ in range(48)}) + [("x", "x"), ("y", "z"), ("z", "y"), ("z", "w")]
    nodes = {v for a in arcs for v in a}
    to = {v: reach(arcs, v, directed=True) for v in nodes}
    want = {(v, min(w for w in to[v] if v in to[w])) for v in nodes}
    df = spark.createDataFrame(arcs + [(None, "q")], "h string, t string")
    assert {tuple(x) for x in C.strong_components(df).collect()} == want
    assert C.strong_components(df.limit(0)).count() == 0
