import random

from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from kgloom.llm import capping, topn

EDGE = "scope string, contributor string, score double, ident long"
LIMIT = "scope string, max_count int, max_share double"


def brute(edges, limits):
    lim = {s: (m, h) for s, m, h in limits}
    out = set()
    for s in {e[0] for e in edges}:
        n = sum(e[0] == s for e in edges)
        m, h = lim.get(s, (None, None)) if s is not None else (None, None)
        caps = [c for c in (m, None if h is None or h != h else max(1, int(h * n))) if c is not None]
        if not caps:
            continue
        for c in {e[1] for e in edges if e[0] == s} - {None}:
            own = sorted((e for e in edges if e[0] == s and e[1] == c), key=lambda e: (e[2] is None or e[2] != e[2], -(e[2] or 0) if e[2] == e[2] else 0, e[3]))
            out |= {(s, e[3]) for e in own[max(0, min(caps)) :]}
    return out


def sample(n, seed):
    r = random.Random(seed)
    return [(r.choice(["a", "a", "b", None]), r.choice(["P17", "P17", "P17", "x", "y", None]), r.choice([0.5, 0.25, None, float("nan"), r.random()]), i) for i in range(n)]


def test_excess_matches_brute_force(spark, monkeypatch):
    for seed, cap in ((1, 4096), (2, 3), (3, 4096)):
        monkeypatch.setattr(capping, "HEAP_CAP", cap)  # small: the range-piece path
        edges = sample(300, seed)
        limits = [("a", 7, 0.1), ("b", None, 0.05)] if seed != 3 else [("a", 0, None), ("b", None, None)]
        df = spark.createDataFrame(edges, EDGE).repartition(5)
        got = {tuple(r) for r in capping.excess(df, spark.createDataFrame(limits, LIMIT)).collect()}
        assert got == brute(edges, limits)


def test_empty_and_clashing_names(spark):
    assert capping.excess(spark.createDataFrame([], EDGE), spark.createDataFrame([], LIMIT)).count() == 0
    df = spark.createDataFrame(sample(40, 5), EDGE).withColumn("cap", F.lit(1)).withColumn("n", F.lit("x")).withColumn("max_count", F.lit(9))
    assert capping.excess(df, spark.createDataFrame([("a", 2, None)], LIMIT)).count() == len(brute(sample(40, 5), [("a", 2, None)]))


@settings(max_examples=4, deadline=None)
@given(st.lists(st.tuples(st.sampled_from([1, 1, 2, 3, None]), st.sampled_from([0.5, 1.0, None, float("nan"), -1.0]), st.integers(0, 10**6)), unique_by=lambda x: x[2], max_size=120))
def test_top_n(spark, rows):
    df = spark.createDataFrame(rows, "grp long, score double, ident long").repartition(6).withColumn("rank", F.lit("clash"))
    got = {tuple(r) for r in topn.top_n(df, 3).collect()}
    want = set()
    for g in {r[0] for r in rows} - {None}:
        own = sorted((r for r in rows if r[0] == g and r[1] is not None and r[1] == r[1]), key=lambda r: (-r[1], r[2]))
        want |= {(g, r[2], k) for k, r in enumerate(own[:3], 1)}
    assert got == want


def test_top_n_over_many_batches(spark):
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "7")
    try:
        df = spark.range(500).select(F.lit(1).alias("grp"), (F.col("id") % 50).cast("double").alias("score"), F.col("id").alias("ident"))
        assert [tuple(r) for r in topn.top_n(df, 12).orderBy("rank").collect()] == [(1, 49 + 50 * k, k + 1) for k in range(10)] + [(1, 48, 11), (1, 98, 12)]
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")


def test_latest_state(spark):
    df = spark.createDataFrame([(1, 5, 0.1, 10), (1, 9, 0.2, 10), (1, None, 0.3, 10), (2, None, None, None), (None, 4, 1.0, 1)], "ident long, at long, score double, cut long")
    assert {tuple(r) for r in topn.latest_state(df, "ident", "at", "cut", "score").collect()} == {(1, 10, 0.2), (2, None, None)}
