import math

from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from kgloom.operators import allocate as A
from kgloom.operators import matrix as M
from kgloom.operators import patterns as P


@settings(max_examples=8, deadline=None)
@given(st.lists(st.floats(0, 20, allow_nan=False), min_size=1, max_size=12), st.integers(-3, 8))
def test_largest_remainder_adds_up(spark, xs, extra):
    floors = sum(math.floor(x) for x in xs)
    n = max(0, floors + 4 * extra)
    df = spark.createDataFrame([("g", i, x, n) for i, x in enumerate(xs)], "g string, i int, x double, n long")
    got = [r.apportioned for r in A.largest_remainder(df, ["g"], "x", "n", [F.col("i")]).orderBy("i").collect()]
    # one at a time, in turns
    want, frac = [math.floor(x) for x in xs], [round(x - math.floor(x), 12) for x in xs]
    while sum(want) != n:
        up = sum(want) < n
        for i in sorted(range(len(xs)), key=lambda i: (-frac[i] if up else frac[i], i)):
            if sum(want) != n and (up or want[i] > 0):
                want[i] += 1 if up else -1
    assert got == want


def test_ties_go_to_the_first(spark):
    df = spark.createDataFrame([("g", i, 1.5, 5) for i in range(4)] + [("h", 0, 2.5, 3)], "g string, i int, x double, n long")
    got = {(r.g, r.i): r.apportioned for r in A.largest_remainder(df, ["g"], "x", "n", [F.col("i")]).collect()}
    assert got == {("g", 0): 2, ("g", 1): 1, ("g", 2): 1, ("g", 3): 1, ("h", 0): 3}


def test_excess_is_taken_in_turns(spark):
    df = spark.createDataFrame([("g", 0, 5.0, 3), ("g", 1, 5.0, 3), ("z", 0, 1.2, 0), ("z", 1, 7.1, 0), ("k", 0, 4.5, 2), ("k", 1, 1.2, 2), ("k", 2, 1.1, 2)], "g string, i int, x double, n long")
    got = {(r.g, r.i): r.apportioned for r in A.largest_remainder(df, ["g"], "x", "n", [F.col("i")]).collect()}
    assert got == {("g", 0): 1, ("g", 1): 2, ("z", 0): 0, ("z", 1): 0, ("k", 0): 2, ("k", 1): 0, ("k", 2): 0}


def test_allocation_of_a_symmetric_square_is_even(spark):
    m = spark.createDataFrame([("a", "b", 1.0), ("b", "a", 1.0)], "row string, col string, value double")
    g = spark.createDataFrame([("p", "a"), ("p", "b"), ("p", "unknown"), ("q", "a")], "pattern string, relation string")
    got = {(r.pattern, r.relation): (r.eta_integer, round(r.p_avg, 9)) for r in A.allocate(m, g, 9, 1.0).collect()}
    assert got == {("p", "a"): (5, 0.5), ("p", "b"): (4, 0.5), ("q", "a"): (9, 1.0)}


def test_half_even_rounding_of_shares(spark):
    counts = spark.createDataFrame([("a", 5)], "r string, n long")
    alloc = spark.createDataFrame([("p", "a", 1.0), ("q", "a", 1.0)], "pattern string, relation string, eta double")
    assert {r.observed for r in A.by_rounded_share(counts, alloc).collect()} == {2}
    assert {(r.pattern, r.observed) for r in A.by_largest_remainder(counts, alloc).collect()} == {("p", 3), ("q", 2)}
    assert {r.observed for r in A.by_membership(counts, alloc).collect()} == {5}
    assert {r.observed for r in A.by_eta_share(counts, alloc).collect()} == {2.5}


def test_wilson_and_modes(spark):
    df = spark.createDataFrame([(0, 0), (5, 10), (10, 10)], "k long, n long")
    low, high = P.wilson(F.col("k"), F.col("n"), 1.96)
    got = [tuple(round(x, 4) for x in r) for r in df.orderBy("n", "k").select(low, high).collect()]
    assert got == [(0.0, 1.0), (0.2366, 0.7634), (0.7225, 1.0)]
    adj = spark.createDataFrame([("a", "b", 3.0), ("b", "c", 2.0)], "row string, col string, value double")
    assert {tuple(r) for r in M.weights(adj, "two_hop_log1p").collect()} == {("a", "c", math.log(7))}
    assert {r.row: r.cells for r in M.nested(adj).collect()} == {"a": {"b": 3.0}, "b": {"c": 2.0}, "c": {}}
