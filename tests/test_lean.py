"""Graphs of more than half a million edges that one task holds as arrays: right, and without a round of joins."""

import pytest
from pyspark.sql import functions as F

from kgloom import session
from kgloom.operators import graph as G

N = 510_000


@pytest.fixture(scope="module")
def path(spark):
    name = lambda i: F.format_string("%06d", i)
    return session.cut(spark.range(N).select(name(F.col("id")).alias("a"), name(F.col("id") + 1).alias("b")))


def test_articulation_points(path):
    written = len(session._written)
    x = G.articulation_points(path).agg(F.count(F.lit(1)), F.min("node"), F.max("node"), F.max("blocks")).collect()[0]
    assert tuple(x) == (N - 1, "000001", f"{N - 1:06d}", 2) and len(session._written) == written


def test_components(path):
    written = len(session._written)
    x = G.components(path).agg(F.count(F.lit(1)), F.max("component")).collect()[0]
    assert tuple(x) == (N + 1, "000000") and len(session._written) == written + 2


def test_rooted_spanning_forest(path):
    tree = session.cut(G.spanning_forest(path))
    written = len(session._written)
    x = G.rooted(tree).agg(F.count(F.lit(1)), F.max("root"), F.count_if((F.col("pre") != F.col("node").cast("long")) | (F.col("size") + F.col("pre") != N + 1)), F.count("parent")).collect()[0]
    assert tuple(x) == (N + 1, "000000", 0, N) and len(session._written) == written
