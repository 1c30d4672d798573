import random
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from kgloom.operators import evaluate as E
from kgloom.operators import removal as Y
from kgloom.operators import repair as Z

K3 = "h string, r string, t string"
ALLOC = "pattern string, relation string, eta double"


def drawn(seed, n=16, m=60, relations=4):
    r = random.Random(seed)
    return sorted({(f"n{r.randrange(n):02d}", f"r{min(r.randrange(relations), r.randrange(relations))}", f"n{r.randrange(n):02d}") for _ in range(m)})


def parts(nodes, pairs):
    at = {v: v for v in nodes}
    for a, b in pairs:
        x, y = at[a], at[b]
        at = {v: min(x, y) if c in (x, y) else c for v, c in at.items()}
    return at


@pytest.mark.parametrize("seed", [1, 2])
def test_within_quotas_is_the_greedy_pass(spark, seed):
    r = random.Random(seed)
    ca, cb = {f"a{i}": r.randrange(0, 4) for i in range(5)}, {f"b{i}": r.randrange(0, 3) for i in range(8)}
    rows = [(i, a, ca[a], b, cb[b]) for i in range(60) for a, b in [(r.choice(list(ca)), r.choice(list(cb)))]]
    left_a, left_b, want = dict(ca), dict(cb), set()
    for i, a, _, b, _ in rows:
        if left_a[a] and left_b[b]:
            left_a[a] -= 1
            left_b[b] -= 1
            want.add(i)
    df = spark.createDataFrame(rows, "i int, a string, ca int, b string, cb int")
    assert {x.i for x in Y.within_quotas(df, "a", "ca", "b", "cb", [F.col("i")]).collect()} == want
    assert Y.within_quotas(df.limit(0), "a", "ca", "b", "cb", [F.col("i")]).count() == 0


def test_verified_deletions_keep_entities_support_and_budgets(spark):
    k = drawn(5, 9, 110)
    eta = [("p", "r0", 12.5), ("p", "r1", 9.0), ("q", "r2", 40.0)]
    support = k[::7]
    n, budget, pair = Counter(x[1] for x in k), {x[1]: x[2] for x in eta}, Counter(tuple(sorted((h, t))) for h, _, t in k)
    want, rel, pairs = [], Counter(n), Counter(pair)
    for h, r, t in sorted((x for x in k if n[x[1]] > budget.get(x[1], 1e9)), key=lambda x: (-(n[x[1]] - budget[x[1]]), x[1], x[0], x[2])):
        p = tuple(sorted((h, t)))
        if (h, r, t) in support or rel[r] <= 1 or rel[r] - 1 < budget[r] or pairs[p] <= 1:
            continue
        rel[r] -= 1
        pairs[p] -= 1
        want.append((h, r, t))
    got = Y.verified_deletions(spark.createDataFrame(k, K3), spark.createDataFrame(support, K3), spark.createDataFrame(eta, ALLOC)).collect()
    assert {tuple(x) for x in got} == set(want) and len(want) > 3


def test_removal_scores_and_projection(spark):
    k = drawn(3, 14, 70)
    eta = [("composition", "r0", 5.0), ("inverse", "r0", 3.0), ("inverse", "r1", 4.0), ("symmetric", "r2", 90.0), ("other", "r3", 1.0)]
    df, w = spark.createDataFrame(k, K3), Y.RemovalWeights(bridge=1000.0)
    got = {tuple(x)[:3]: x for x in Y.removal_scores(df, spark.createDataFrame(eta, ALLOC), w).collect()}
    nodes = {v for h, _, t in k for v in (h, t)}
    edges = {tuple(sorted((h, t))) for h, _, t in k if h != t}
    near = defaultdict(set)
    for a, b in edges:
        near[a].add(b)
        near[b].add(a)
    pair, n = Counter(tuple(sorted((h, t))) for h, _, t in k), Counter(x[1] for x in k)
    whole = len(set(parts(nodes, edges).values()))
    joint = {v for v in nodes if len(set(parts(nodes - {v}, [e for e in edges if v not in e]).values())) > whole - (not near[v])}
    total, want = defaultdict(float), defaultdict(float)
    for p, r, e in eta:
        want[p] += e
        total[p] += n[r]
    for h, r, t in k:
        own, p = [x[0] for x in eta if x[1] == r], tuple(sorted((h, t)))
        over = int(n[r] - sum(x[2] for x in eta if x[1] == r))
        gain = sum(10 * (total[x] > want[x]) - 25 * (total[x] < want[x]) - 40 * (x == "symmetric") for x in own) + (2 * over if over >= 1 else 0)
        asked = own and (any(total[x] > want[x] for x in own) or over >= 1) and not any(x == "symmetric" and total[x] < want[x] for x in own)
        d = {v: len(near[v]) + 2 * ((v, v) in pair) for v in (h, t)}
        common = len(near[h] & near[t]) if h != t else 0
        bridge = h != t and pair[p] == 1 and len(set(parts(nodes, edges - {p}).values())) > whole
        cost = 1000 * bridge + 50 * ((d[h] <= 2) + (d[t] <= 2)) + 20 * ((h in joint) + (t in joint)) - 5 * min(common, 10) - 2 * (4 if pair[p] > 1 else 3 if common else 0)
        if asked and gain > 0 and gain - cost > 0:
            x = got.pop((h, r, t))
            assert (x.balance_gain, x.structural_penalty, x.score) == (gain, cost, gain - cost)
    assert not got
    for x in Y.projected(df).collect():
        p = tuple(sorted((x.h, x.t)))
        d = {v: len(near[v]) + 2 * ((v, v) in pair) for v in {x.h, x.t}}
        gone = sum(y <= 1 for y in d.values()) if pair[p] == 1 else 0
        assert abs(x.triples_per_entity - (len(k) - 1) / (len(nodes) - gone)) < 1e-9
        assert x.two_paths_lost == (sum(max(0, d[v] - 1) for v in (x.h, x.t)) if pair[p] == 1 else 0)


def test_scored_pruning_stops_and_stays_whole(spark):
    k = drawn(9, 10, 90, 3)
    alloc = spark.createDataFrame([("p", "r0", 6.0), ("p", "r1", 4.0)], ALLOC)
    df = spark.createDataFrame(k, K3)
    gone = [tuple(x)[:3] for x in Y.prune_scored(df, alloc, batch=25).collect()]
    rest = set(k) - set(gone)
    assert len(gone) == len(set(gone)) > 10 and set(gone) <= set(k)
    n = Counter(x[1] for x in rest)
    assert n["r0"] >= 6 and n["r1"] >= 4 and n["r2"] == Counter(x[1] for x in k)["r2"]
    nodes = {v for h, _, t in k for v in (h, t)}
    assert {v for h, _, t in rest for v in (h, t)} == nodes
    assert len(set(parts(nodes, [(h, t) for h, _, t in rest]).values())) == len(set(parts(nodes, [(h, t) for h, _, t in k]).values()))
    held = Y.prune_scored(df, alloc, batch=7, guards=Y.Guards(min_triples_per_entity=(len(k) - 10) / len(nodes)))
    assert held.count() == 7
    assert Y.broken_guards(df, Y.Guards(True, 100.0, 0, 1.1)) == ["more_triples_than_entities", "min_triples_per_entity", "max_components", "min_largest_share"][1 if len(k) > len(nodes) else 0 :]
    with pytest.raises(ValueError, match="mode"):
        Y.excess_reward(F.lit(1), "cubic")


def test_absent_relations_fill_in_passes(spark):
    graph = spark.createDataFrame([("a", "r0", "b"), ("b", "r0", "c")], K3)
    universe = spark.createDataFrame([("b", "r1", "x"), ("c", "r1", "y"), ("q", "r1", "z"), ("x", "r2", "m"), ("n", "r2", "o"), ("s", "r3", "a"), ("y", "r4", "u")], K3)
    support = spark.createDataFrame([("r0", "r1", 5), ("r1", "r2", 2), ("r3", "r0", 1), ("r0", "r9", 4), ("r1", "r4", 0)], "r1 string, r2 string, total long")
    quota = spark.createDataFrame([("r0", 9.0), ("r1", 1.0), ("r2", 3.0), ("r3", 2.0), ("r4", 2.0)], "relation string, quota double")
    main = spark.createDataFrame([("a",), ("b",), ("c",)], "node string")
    got = {tuple(x) for x in Z.fill_absent(graph, universe, quota, support, main).collect()}
    assert got == {("b", "r1", "x", 1), ("s", "r3", "a", 1), ("x", "r2", "m", 2)}
    assert Z.fill_absent(graph, universe.limit(0), quota, support, main).count() == 0


def test_report_and_checks(spark):
    k = [("a", "r0", "b"), ("a", "r0", "b"), ("b", "r1", "c"), ("x", "r1", "x")]
    raw = spark.createDataFrame(k, K3)
    alloc = spark.createDataFrame([("p", "r0", 3.0), ("p", "r1", 1.0), ("q", "r1", 1.0), ("q", "r7", 2.0)], ALLOC)
    rep = E.report(raw, raw.distinct(), alloc)
    got = {(x.section, x.metric): x.value for x in rep.collect()}
    assert got["graph", "duplicate_rows"] == 1 and got["connectivity", "components"] == 2 and got["allocation", "zero_relations"] == 1 and got["pattern:q", "observed"] == 1
    rules = {("connectivity", "components"): ("=", 1), ("graph", "triples"): (">=", 3), ("allocation", "total_deficit"): ("<=", 10), ("graph", "nothing"): ("<=", 1)}
    assert {x.metric: x.passed for x in E.checks(rep, rules).collect()} == {"components": False, "triples": True, "total_deficit": True, "nothing": False}
    assert all(x.value == 0 for x in E.report(raw.limit(0), raw.limit(0), alloc).where("section IN ('graph', 'connectivity')").collect())


def test_inverse_candidates_move_no_implied_row(spark):
    from kgloom.operators.complete import inverse_candidates

    r = random.Random(4)
    base = sorted({(f"n{r.randrange(6)}", f"r{r.randrange(5)}", f"n{r.randrange(6)}") for _ in range(90)})
    seen = sorted({(f"n{r.randrange(6)}", f"r{r.randrange(5)}", f"n{r.randrange(6)}") for _ in range(20)})
    room = {f"r{i}": x for i, x in enumerate([(9.0, 4.0, 0.0), (9.0, 4.0, 0.0), (0.0, 0.0, 0.0), (5.0, 0.0, 3.0), (None, None, None)])}
    rules = [(s, t, c, *room[t]) for s in room for t in room if s != t and (c := r.choice([0.5, 0.5, 0.3, 0.01, None])) != 0.3 or t == "r0" and s != t]
    got = inverse_candidates(spark.createDataFrame(base, "h string, r string, t string"), spark.createDataFrame(rules, "source string, target string, confidence double, eta double, deficit double, surplus double"), spark.createDataFrame(seen, "h string, r string, t string"), 0.02)
    want, taken = [], set()
    for s, t, c, eta, deficit, surplus in sorted(rules, key=lambda x: (-(x[2] or 0), x[0])):
        for h, _, o in [k for k in base if k[1] == s]:
            new = (o, t, h)
            why = "already_present" if new in base else "already_observed" if new in seen else "low_confidence" if c is None or c < 0.02 else "not_allocated" if (eta or 0) <= 0 else "overfilled" if surplus > 0 else "no_room" if deficit <= 0 else "duplicate" if new in taken else "eligible"
            taken |= {new} if why == "eligible" else set()
            want.append((s, *new, c, deficit, why))
    assert sorted(map(tuple, got.collect()), key=str) == sorted(want, key=str) and {x[-1] for x in want} >= {"already_present", "already_observed", "low_confidence", "duplicate", "eligible"}
    # but for the pairs with several relations, which are few, nothing is moved once the pairs are gathered
    moves = [x for x in got._jdf.queryExecution().executedPlan().toString().splitlines() if "Exchange hashpartitioning" in x]
    assert all("REPARTITION_BY_COL" in x for x in moves)


def test_scored_removal_uses_the_searches_of_one_task():
    import inspect

    from kgloom.operators.unionfind import LEAN

    assert all(inspect.signature(f).parameters["bound"].default == LEAN for f in (Y.removal_scores, Y.prune_scored))


def test_a_round_of_pruning_is_searched_in_one_task(spark, monkeypatch):
    from kgloom import session
    from kgloom.operators import lowlink
    from kgloom.operators.construct import loose

    monkeypatch.setattr(lowlink, "_PROBES", 7)
    over = spark.createDataFrame([("r0",), ("r1",), ("r2",)], "relation string")
    for seed, (nodes, rows, relations) in enumerate([(12, 60, 4), (40, 45, 4), (25, 60, 3), (9, 90, 5)]):
        k = drawn(seed, nodes, rows, relations) + [("alone", "r1", "alone"), ("alone", "r0", "alone"), ("held", "r2", "held"), ("held", "r9", "held"), ("n1", "r0", "n1")]
        df = session.cut(spark.createDataFrame(sorted(set(k)), K3))
        alloc = spark.createDataFrame([("p", "r0", 2.0), ("p", "r1", 1.0), ("q", "r2", 3.0)], ALLOC)
        w = Y.RemovalWeights(pattern_surplus=200.0)
        written = len(session._written)
        got = sorted(map(tuple, Y.loose_scores(df, over, alloc, w).collect()))
        assert len(session._written) - written <= 4
        assert got == sorted(map(tuple, loose(df, over).join(Y.removal_scores(df, alloc, w), ["h", "r", "t"]).collect())) and got
    assert Y.loose_scores(df.limit(0), over, alloc).count() == 0
    assert "loose_scores" in Y.prune_scored.__code__.co_names
