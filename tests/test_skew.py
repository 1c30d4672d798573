import random
from collections import Counter

from hypothesis import given, settings
from hypothesis import strategies as st

from pyspark.sql import functions as F

from kgloom.operators import skew

ROWS = st.lists(st.tuples(st.sampled_from(["hot"] * 4 + ["b", None]), st.sampled_from([1.0, 2.0, 2.5, None, float("nan"), -3.0])), max_size=60)


@settings(max_examples=5, deadline=None)
@given(ROWS)
def test_profile_and_percentiles(spark, rows):
    df = spark.createDataFrame(rows, "k string, v double").repartition(3)
    f = skew.value_frequencies(df, ["k"], "v")
    got = {r.k: r for r in skew.profile(f, ["k"], "v", numeric=True).collect()}
    assert set(got) == {k for k, _ in rows}
    for k, r in got.items():
        vals = [v for x, v in rows if x == k and v is not None and v == v]
        assert (r.n_rows, r.n_values, r.n_distinct) == (sum(x == k for x, _ in rows), len(vals), len(set(vals)))
        if vals:
            c = Counter(vals)
            assert r.mode_value == min(v for v in c if c[v] == max(c.values())) and abs(r.sum_value - sum(vals)) < 1e-9
    p = {(r.k, r.q): r.value for r in skew.weighted_percentiles(f, ["k"], "v", [0.0, 0.5, 0.9, 1.0]).collect()}
    for k in {k for k, _ in rows}:
        vals = sorted(v for x, v in rows if x == k and v is not None and v == v)
        for q in (0.0, 0.5, 0.9, 1.0):
            assert p.get((k, q)) == (vals[int(q * (len(vals) - 1))] if vals else None)


def test_text_mode_and_clashing_names(spark):
    df = spark.createDataFrame([("a", "y"), ("a", "x"), ("a", None), ("a", None), (None, "z")], "n_rows string, freq_ string")
    got = {tuple(r) for r in skew.profile(skew.value_frequencies(df, ["n_rows"], "freq_"), ["n_rows"], "freq_").toDF("k", "n", "v", "d", "m").collect()}
    assert got == {("a", 4, 2, 2, "x"), (None, 1, 1, 1, "z")}


def test_running_totals(spark):
    r = random.Random(3)
    rows = [(r.choice("aaab"), r.randrange(50), i, r.randrange(4)) for i in range(300)]
    df = spark.createDataFrame(rows, "g string, o int, i int, w long")
    from pyspark.sql import functions as F

    got = {x.i: x.t for x in skew.running_totals(df, ["g"], [F.col("o"), F.col("i")], F.col("w"), "t", pieces=7).collect()}
    for g in "ab":
        total = 0
        for x in sorted((x for x in rows if x[0] == g), key=lambda x: (x[1], x[2])):
            total += x[3]
            assert got[x[2]] == total


def test_heavy_keys(spark):
    df = spark.createDataFrame([("t", "a")] * 4 + [("t", None)] * 2 + [("t", f"x{i}") for i in range(94)], "tab string, k string")
    f = skew.value_frequencies(df, ["tab"], "k")
    assert [tuple(r) for r in skew.heavy_keys(f, "tab", "k", 4, 100).collect()] == [("t", "a", 4)]
    assert skew.heavy_keys(f.limit(0), "tab", "k", 4, 100).count() == 0


def test_skew_join(spark):
    left = spark.createDataFrame([("h", i % 3) for i in range(50)] + [(None, 1), ("c", 1)], "k string, n int")
    right = spark.createDataFrame([("h", 10), (None, 20)], "kk string, v int")
    assert Counter(tuple(r) for r in skew.skew_join(left, right, [("k", "kk")], "left").select("k", "v").collect()) == {("h", 10): 50, (None, 20): 1, ("c", None): 1}


def test_lookups_of_any_size_and_hot_keys(spark):
    left = spark.createDataFrame([("hot", i) for i in range(300)] + [(f"k{i % 40}", i) for i in range(80)] + [(None, 1), ("gone", 1)], "k string, x int")
    right = spark.createDataFrame([("hot", 1), *[(f"k{i}", i) for i in range(40)], (None, 7)], "b string, v int")
    for how, n in (("inner", 381), ("left", 382)):
        for small in (100, 5):
            got = skew.lookup(left, right, [("k", "b")], how, small=small)
            assert got.columns == ["k", "x", "v"] and got.count() == n
    assert [tuple(r) for r in skew.hot_keys(left, ["k"], 100).collect()] == [("hot", 300)]
    assert skew.hot_keys(left.limit(0), ["k"], 0).count() == 0
    big = spark.range(60_000).select(F.when(F.col("id") % 3 == 0, F.lit(0)).otherwise(F.col("id")).cast("long").alias("p"), "id")
    names = spark.range(50_000).select(F.col("id").alias("node"), (F.col("id") * 2).alias("g"))
    for how in ("inner", "left"):
        want = {tuple(r) for r in big.join(names, F.col("p") == F.col("node"), how).select("p", "id", "g").collect()}
        assert {tuple(r) for r in skew.hot_join(big, names, ("p", "node"), how).collect()} == want
