import random

import pytest
from pyspark.sql import functions as F

from kgloom.operators import construct as B
from kgloom.operators import graph as G
from kgloom.operators import hops as H
from kgloom.operators import triples as T


def find(edges):
    parent = {}

    def root(x):
        parent.setdefault(x, x)
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in edges:
        x, y = root(a), root(b)
        parent[max(x, y)] = min(x, y)
    return {v: root(v) for v in parent}


def graph(seed, n=40, m=48):
    r = random.Random(seed)
    return sorted({(f"n{a:03d}", f"r{r.randrange(4)}", f"n{b:03d}") for a, b in ((r.randrange(n), r.randrange(n)) for _ in range(m))})


@pytest.mark.parametrize("shape", ["random", "path", "hub"])
def test_star_rounds_after_bounded_contraction(spark, shape):
    r = random.Random(5)
    edges = {"random": [(h, t) for h, _, t in graph(8, 60, 50)], "path": [(f"{i:03d}", f"{i + 1:03d}") for i in range(40)], "hub": [("m", f"{i:03d}") for i in range(30)] + [("zz", "z1")]}[shape]
    r.shuffle(edges)
    got = {tuple(x) for x in G.components(spark.createDataFrame(edges, "a string, b string"), bound=12).collect()}
    assert got == set(find(edges).items())


@pytest.mark.parametrize("seed", [1])
def test_components_and_bridges(spark, seed):
    k = graph(seed)
    df = spark.createDataFrame(k, "h string, r string, t string")
    e = G.simple_edges(df)
    pairs = {tuple(sorted((h, t))) for h, _, t in k if h != t}
    assert {tuple(x) for x in e.collect()} == pairs
    want = find([(h, t) for h, _, t in k])
    members = G.components(e, T.entities(df))
    assert {tuple(x) for x in members.collect()} == set(want.items())
    n = len(set(want.values()))
    nodes = [(v, v) for v in want]
    bridge = {p for p in pairs if len(set(find(nodes + list(pairs - {p})).values())) > n}
    got = {(x.a, x.b): (x.side, x.component_size) for x in G.bridges(e).collect()}
    assert set(got) == bridge
    assert {(x.a, x.b): (x.side, x.component_size) for x in G.bridges(e, bound=5).collect()} == got
    for p, (side, size) in got.items():
        cut = find(nodes + list(pairs - {p}))
        parts = sorted(sum(c == cut[end] for c in cut.values()) for end in p)
        assert side == parts[0] and size == sum(parts)
    two = {tuple(x) for x in G.two_edge_components(e).collect()}
    ends = {v for p in pairs for v in p}
    assert two == {(v, c) for v, c in find([(v, v) for v in ends] + list(pairs - bridge)).items()}


def test_bridges_beyond_half_a_million_edges_need_no_rounds(spark):
    from kgloom import session

    n = 520_000
    name = lambda i: F.format_string("%06d", i)
    edges = session.cut(spark.range(n).select(name(F.col("id")).alias("a"), name(F.col("id") + 1).alias("b")))
    written = len(session._written)
    x = G.bridges(edges).agg(F.count(F.lit(1)), F.sum("side"), F.min("component_size"), F.countDistinct("a")).collect()[0]
    assert tuple(x) == (n, sum(min(i, n + 1 - i) for i in range(1, n + 1)), n + 1, n) and len(session._written) == written


def test_articulation_points(spark):
    k = [("a", "b"), ("b", "c"), ("a", "c"), ("c", "d"), ("d", "e"), ("e", "f"), ("d", "f"), ("f", "g"), ("x", "y"), ("y", "z"), ("x", "z"), ("b", "z1"), ("b", "z2"), ("z1", "z2")]
    r = random.Random(3)
    k += [tuple(sorted(r.sample([f"n{i:02d}" for i in range(22)], 2))) for _ in range(26)]
    k = sorted(set(k))
    nodes = {v for e in k for v in e}
    n = len(set(find(k).values()))
    want = {v for v in nodes if len(set(find([(u, u) for u in nodes - {v}] + [e for e in k if v not in e]).values())) > n}
    # a node without neighbours left counts as a part less, so isolated ends don't make their neighbour's count wrong
    df = spark.createDataFrame(k, "a string, b string")
    got = {x.node: x.blocks for x in G.articulation_points(df).collect()}
    assert set(got) == want
    assert {x.node: x.blocks for x in G.articulation_points(df, bound=5).collect()} == got


@pytest.mark.parametrize("shape", ["random", "path", "none"])
def test_forests_are_the_same_at_any_bound(spark, shape):
    r = random.Random(7)
    name = [f"n{i:03d}" for i in range(24)]
    r.shuffle(name)
    pairs = {"random": [(r.randrange(24), r.randrange(24)) for _ in range(34)] + [(0, i) for i in range(1, 9)], "path": [(i, i + 1) for i in range(20)], "none": []}[shape]
    edges = sorted({tuple(sorted((name[a], name[b]))) for a, b in pairs if a != b})
    df = spark.createDataFrame(edges, "a string, b string")
    part, want = {}, set()
    for a, b in edges:
        if part.get(a, a) != part.get(b, b) or a not in part and b not in part:
            want.add((a, b))
            x, y = part.get(a, a), part.get(b, b)
            part.setdefault(a, a), part.setdefault(b, b)
            part = {k: y if v == x else v for k, v in part.items()}
    walks = []
    for bound in (1000, 9):
        tree = G.spanning_forest(df, bound)
        assert {tuple(x) for x in tree.collect()} == want
        walks.append({x.node: tuple(x)[1:] for x in G.rooted(tree, bound).collect()})
    assert walks[0] == walks[1] and set(walks[0]) == {v for e in edges for v in e}
    for v, (parent, root, pre, size) in walks[0].items():
        inside = {w for w, x in walks[0].items() if x[1] == root and pre <= x[2] < pre + size}
        assert len(inside) == size and (parent is None) == (v == root)
        assert parent is None or tuple(sorted((v, parent))) in want and v not in {root}
        assert all(walks[0][w][0] in inside for w in inside - {v})


def test_driver_side_exact_problems():
    from kgloom.operators.matching import best_subset, largest_matching

    r = random.Random(1)
    for _ in range(60):
        opt = {f"l{i}": [f"r{r.randrange(6)}" for _ in range(r.randrange(4))] for i in range(7)}
        m = largest_matching(opt)
        assert all(v in opt[k] for k, v in m.items()) and len(set(m.values())) == len(m)

        def most(keys, used=frozenset()):
            if not keys:
                return 0
            return max([most(keys[1:], used)] + [1 + most(keys[1:], used | {x}) for x in opt[keys[0]] if x not in used])

        assert len(m) == most(list(opt))
    assert best_subset([3, -1, 4, 2], 2, sum) == (3, 4)
    with pytest.raises(ValueError, match="at most"):
        best_subset(range(30), 2, sum)


def test_long_path_and_nothing(spark):
    path = [(f"{i:04d}", f"{i + 1:04d}") for i in range(60)]
    random.Random(1).shuffle(path)
    df = spark.createDataFrame(path, "a string, b string")
    assert {x.component for x in G.components(df).collect()} == {"0000"}
    assert G.components(df.limit(0)).count() == 0 and G.bridges(df.limit(0)).count() == 0


def test_hops_against_brute_force(spark):
    k = graph(3, 12, 60)
    df = spark.createDataFrame(k, "h string, r string, t string")
    total, loop, middle, bag, pairs = {}, {}, {}, 0, {}
    for x, r1, y in k:
        for y2, r2, z in k:
            if y != y2:
                continue
            middle.setdefault((r1, r2), set()).add(y)
            pairs.setdefault((r1, r2), set()).add((x, z))
            bag += x != y
            if x != y and y != z:
                total[r1, r2] = total.get((r1, r2), 0) + 1
                loop[r1, r2] = loop.get((r1, r2), 0) + (x == z)
    assert {(r.r1, r.r2): (r.loop, r.nonloop, r.total) for r in H.hop_support(df).collect()} == {p: (loop[p], n - loop[p], n) for p, n in total.items()}
    assert {(r.r1, r.r2): r.support for r in H.middle_support(df).collect()} == {p: len(v) for p, v in middle.items()}
    assert H.two_paths(df).count() == bag
    for r in H.composition(df).collect():
        direct = {(h, t) for h, x, t in k if x == r.r3}
        assert (r.examined, r.shortcuts) == (len(pairs[r.r1, r.r2]), len(pairs[r.r1, r.r2] & direct))


def test_common_neighbours(spark):
    k = graph(5, 15, 50)
    df = spark.createDataFrame(k, "h string, r string, t string")
    nb = {}
    for h, _, t in k:
        if h != t:
            nb.setdefault(h, set()).add(t)
            nb.setdefault(t, set()).add(h)
    ask = [(a, b) for a in sorted(nb)[:6] for b in sorted(nb)[3:9] if a < b] + [("n000", "zzz")]
    got = {(r.a, r.b): r.common for r in T.common_neighbours(df, spark.createDataFrame(ask, "a string, b string")).collect()}
    assert got == {(a, b): len(nb.get(a, set()) & nb.get(b, set())) for a, b in ask}


def test_greedy_matching_is_the_sequential_one(spark):
    r = random.Random(7)
    moves = [(i, r.randrange(8), r.choice(["x", "y", "z", "u", None]), r.randrange(5)) for i in range(80)]
    got = {x.i for x in B.greedy_matching(spark.createDataFrame(moves, "i int, l int, r string, s int"), "l", "r", [F.col("s").desc(), F.col("i")]).collect()}
    left, right, want = set(), set(), set()
    for i, a, b, _ in sorted(moves, key=lambda m: (-m[3], m[0])):
        if b is not None and a not in left and b not in right:
            want.add(i)
            left.add(a)
            right.add(b)
    assert got == want


def test_merge_components_is_the_sequential_one(spark):
    k = graph(11, 60, 35)
    r = random.Random(2)
    nodes = sorted({v for h, _, t in k for v in (h, t)})
    cand = sorted({(r.choice(nodes), "c", r.choice(nodes + ["new"])): r.randrange(6) for _ in range(90)}.items())
    cand = [(*c, s) for c, s in cand]
    df = spark.createDataFrame(k, "h string, r string, t string")
    got = {tuple(x)[:3] for x in B.merge_components(df, spark.createDataFrame(cand, "h string, r string, t string, s int"), "s").collect()}
    edges, want = [(h, t) for h, _, t in k], set()
    for h, x, t, _ in sorted(cand, key=lambda c: (-c[3], c[1], c[0], c[2])):
        label = find(edges)
        if h in label and t in label and label[h] != label[t]:
            want.add((h, x, t))
            edges.append((h, t))
    assert got == want


def test_safe_deletions_keep_what_they_promise(spark):
    k = graph(4, 20, 70)
    df = spark.createDataFrame(k, "h string, r string, t string")
    surplus = spark.createDataFrame([("r0", 5.5), ("r1", 100.0), ("r2", 0.4)], "relation string, surplus double")
    gone = {tuple(x) for x in B.safe_deletions(df, surplus, [F.col("h"), F.col("t")]).collect()}
    rest = set(k) - gone
    assert gone and find([(h, t) for h, _, t in rest]) == find([(h, t) for h, _, t in k])
    n = lambda s, r: sum(x[1] == r for x in s)
    assert n(gone, "r0") <= 5 and n(gone, "r2") == 0 and n(rest, "r1") >= 1
    pruned = B.prune(df, spark.createDataFrame([("p", "r0", 3.0), ("p", "r1", 2.0)], "pattern string, relation string, eta double"), 2, 3, [F.col("h"), F.col("t")])
    out = [tuple(x) for x in pruned.select("h", "r", "t").collect()]
    assert len(set(out)) == len(out) and find([(h, t) for h, _, t in set(k) - set(out)]) == find([(h, t) for h, _, t in k])


@pytest.mark.parametrize("seed", [4, 6])
def test_prune_runs_until_nothing_can_go(spark, seed):
    k = graph(seed, 20, 160) + [("lone", "r0", "lone"), ("lone", "r1", "lone")]
    eta = {"r0": 5.0, "r1": 2.5, "r2": 0.0}
    df = spark.createDataFrame(k, "h string, r string, t string")
    alloc = spark.createDataFrame([("p", r, e) for r, e in eta.items()], "pattern string, relation string, eta double")
    gone = [tuple(x) for x in B.prune(df, alloc, None, None, [F.col("h"), F.col("t")]).select("h", "r", "t").collect()]
    left = set(k) - set(gone)
    parts = find([(h, t) for h, _, t in k])
    n = lambda r: sum(x[1] == r for x in left)
    assert len(set(gone)) == len(gone) and find([(h, t) for h, _, t in left]) == parts
    assert all(n(r) >= max(1, e) for r, e in eta.items()) and n("r3") == sum(x[1] == "r3" for x in k)
    # whatever is still over its budget holds the graph together
    for x in left:
        if x[1] in eta and n(x[1]) > 1 and n(x[1]) - eta[x[1]] >= 1:
            assert find([(h, t) for h, _, t in left - {x}]) != parts


def test_grow_connected_reaches_the_end(spark):
    u = spark.createDataFrame([(f"{i}", "r", f"{i + 1}") for i in range(6)], "h string, r string, t string")
    got = B.grow_connected(spark.createDataFrame([("0",)], "e string"), u, spark.createDataFrame([("r", 9)], "relation string, quota int"))
    assert {(x.h, x.turn) for x in got.collect()} == {(f"{i}", i + 1) for i in range(6)}


def test_greedy_core_keeps_budgets(spark):
    k = graph(9, 25, 80)
    c = spark.createDataFrame([(*x, 0.1, 0.2, 0.8) for x in k], "h string, r string, t string, hub_penalty double, genericity_score double, quality_score double")
    alloc = spark.createDataFrame([("p", f"r{i}", float(3 + i)) for i in range(4)], "pattern string, relation string, eta double")
    got = B.greedy_core(c, alloc, 14, 3, c.limit(1)).collect()
    assert len(got) == 14 and len({(x.h, x.r, x.t) for x in got}) == 14
    assert all(sum(x.r == f"r{i}" for x in got) <= 3 + i for i in range(4))


def one_by_one(cand, quota, budget, seeds):
    """The sequential rule, every candidate scored again for every choice. ``cand``: (h, r, t) -> (hub, generic, quality)."""
    inc = {}
    for h, r, t in cand:
        inc.setdefault(h, set()).add(r)
        inc.setdefault(t, set()).add(r)
    chosen, deg, n = [], {}, {}

    def add(x):
        chosen.append(x)
        n[x[1]] = n.get(x[1], 0) + 1
        for e in (x[0], x[2]):
            deg[e] = deg.get(e, 0) + 1

    for x in sorted(seeds, key=lambda x: (x[1], x[0], x[2])):
        if n.get(x[1], 0) < quota.get(x[1], 0) and len(chosen) < budget:
            add(x)
    first = len(chosen)
    while len(chosen) < budget:
        label, top, best, done = find([(h, t) for h, _, t in chosen]), max(deg.values(), default=1), None, set(chosen)
        for (h, r, t), (hub, generic, quality) in cand.items():
            q, k = quota.get(r, 0), n.get(r, 0)
            if k >= q or (h, r, t) in done:
                continue
            known = (h in deg) + (t in deg)
            s = 3.0 * (q - k) / q + 8.0 * (k == 0) + 2.0 * (0.1, 0.6, 1.0)[known] + 2.0 * min(1.0, (len(inc[h]) + len(inc[t])) / 20.0)
            s += 3.0 * (known == 2 and label[h] != label[t]) - 1.5 * max(min(1.0, max(deg.get(h, 0), deg.get(t, 0)) / top), hub) - 1.25 * generic - 1.25 * (1.0 - quality)
            key = (-round(s, 9), r, h, t)
            best = key if best is None or key < best else best
        if best is None:
            break
        add((best[2], best[1], best[3]))
    return chosen[:first], chosen[first:]


def test_greedy_core_is_the_sequential_one(spark):
    r = random.Random(13)
    cand = {x: (r.random(), 0.25 * int(x[1][1]), r.random()) for x in graph(9, 25, 80)}
    quota = {"r0": 30, "r1": 4, "r2": 3, "r3": 0}
    c = spark.createDataFrame([(*x, *v) for x, v in cand.items()], "h string, r string, t string, hub_penalty double, genericity_score double, quality_score double")
    alloc = spark.createDataFrame([("p", x, float(q)) for x, q in quota.items()], "pattern string, relation string, eta double")
    seed = sorted(cand)[:2]
    seeds = spark.createDataFrame(seed, "h string, r string, t string")
    for budget, bound in ((60, 10**6), (6, 0)):
        start, want = one_by_one(cand, quota, budget, seed)
        got = B.greedy_core(c, alloc, budget, 1, seeds, bound=bound).collect()
        assert {(x.h, x.r, x.t) for x in got if x.turn == 0} == set(start)
        assert [(x.h, x.r, x.t) for x in sorted(got, key=lambda x: x.turn) if x.turn] == want


def test_registered_core_is_the_sequential_one(spark):
    from kgloom.plans import structure as S

    d = "/root/testdata/sf0.001"
    c, alloc = S.annotated(spark, d), S.allocations(spark, d)
    quota = {x.relation: int(x.eta) for x in alloc.groupBy("relation").agg(F.sum("eta").alias("eta")).collect()}
    cand = {(x.h, x.r, x.t): (x.hub_penalty, x.genericity_score, x.quality_score) for x in c.collect()}
    seeds = [(x.h, x.r, x.t) for x in S.N.seeds(c, alloc, 20, 2, 10).collect()]
    _, want = one_by_one(cand, quota, len(set(seeds)) + 60, seeds)
    got = S.QUERIES["greedy_core"](spark, d).where("turn > 0").orderBy("turn").limit(60).collect()
    assert [(x.h, x.r, x.t) for x in got][: len(want)] == want and want


def test_additions_are_those_of_the_sequential_pass(spark):
    r = random.Random(3)
    rows = sorted({(f"n{r.randrange(30)}", f"r{r.randrange(5)}", f"n{r.randrange(30)}") for _ in range(120)})
    rows = [(*x, r.randrange(6)) for x in rows]
    eta = {("composition", "r0"): 9.0, ("symmetric", "r0"): 6.0, ("composition", "r1"): 8.0, ("symmetric", "r2"): 3.0, ("composition", "r3"): 0.0}
    n = {"r0": 7, "r1": 2, "r4": 50}
    for budget in (500, 30):
        now, want, comp = dict(n), [], {x for p, x in eta if p == "composition"}
        every = {x: sum(e for (_, y), e in eta.items() if y == x) for _, x in eta}
        total = lambda: sum(round(now.get(x, 0) * (eta["composition", x] / every[x])) for x in comp if every[x])  # noqa: E731, B023
        for h, x, t, s in sorted(rows, key=lambda x: (-x[3], x[1], x[0], x[2])):
            if len(want) < budget and x in every and not (x in comp and total() >= 17.0):
                want.append((h, x, t, s))
                now[x] = now.get(x, 0) + 1
        got = B.select_additions(spark.createDataFrame(rows, "h string, r string, t string, s int"), spark.createDataFrame(list(n.items()), "relation string, n long"), spark.createDataFrame([(*k, v) for k, v in eta.items()], "pattern string, relation string, eta double"), budget, [F.col("s").desc(), F.col("r"), F.col("h"), F.col("t")])
        assert [tuple(x) for x in got.collect()] == want
        assert sum(x[1] in comp for x in want) < sum(x[1] in comp for x in rows)


def test_grow_connected(spark):
    u = spark.createDataFrame([("a", "r", "b"), ("b", "r", "c"), ("c", "s", "d"), ("x", "r", "y"), ("a", "r", "z")], "h string, r string, t string")
    q = spark.createDataFrame([("r", 2), ("s", 5)], "relation string, quota int")
    got = {tuple(x) for x in B.grow_connected(spark.createDataFrame([("a",)], "e string"), u, q, 5).collect()}
    assert got == {("a", "r", "b", 1), ("a", "r", "z", 1)}


def test_k_hop_and_summary(spark):
    df = spark.createDataFrame([("a", "r", "b"), ("b", "r", "c"), ("c", "r", "d"), ("a", "r", "b")], "h string, r string, t string")
    assert {tuple(x) for x in T.k_hop(df, spark.createDataFrame([("b",)], "e string"), 1).collect()} == {("b", 0), ("a", 1), ("c", 1)}
    assert tuple(T.summary(df).collect()[0]) == (4, 3, 1, 4, 1)
    assert tuple(T.summary(df.limit(0)).collect()[0]) == (0, 0, 0, 0, 0)
