import duckdb
import pytest
from pyspark.sql import functions as F

from kgloom.functions.ids import id_long, plain_id, plain_id_sql
from kgloom.functions.labels import folded, folded_path, micros, usable

SAME = ["P17", " P17", "p17", "P17\t", "P17​", "wdt:P17", "Property:P17", "http://kg.example/prop/direct/P17", "<http://kg.example/entity/P17>", "https://kg.example/wiki/P17 ", "Ｐ１７", "ｐ１７", "P0017", "﻿P17"]
NONE = ["", " ", "P", "Q17", "unknown value", "_:b17", "XP17", "P17x", "P1 7", None, "P0"]


@pytest.mark.parametrize("engine", ["spark", "duckdb"])
def test_plain_ids(spark, engine):
    rows = SAME + NONE
    if engine == "spark":
        got = [r[0] for r in spark.createDataFrame(list(enumerate(rows)), "i int, v string").orderBy("i").select(plain_id("v", "P")).collect()]
    else:
        c = duckdb.connect()
        c.execute("CREATE TABLE x (i INT, v VARCHAR)")
        c.executemany("INSERT INTO x VALUES (?, ?)", list(enumerate(rows)))
        got = [r[0] for r in c.execute(f"SELECT {plain_id_sql('v', 'P')} FROM x ORDER BY i").fetchall()]
    assert got == ["P17"] * len(SAME) + [None] * len(NONE)


def test_long_ids(spark):
    df = spark.createDataFrame([("Q5",), ("Q" + "9" * 18,), ("Q" + "9" * 19,), (None,)], "v string")
    assert [r[0] for r in df.select(id_long("v", "Q")).collect()] == [5, 10**18 - 1, None, None]


def test_labels(spark):
    df = spark.createDataFrame([("Stage-11",), (" stage_11 ",), ("N/A",), ("-",), (None,), ("None",), ("n.a.",)], "v string")
    assert [tuple(r) for r in df.select(folded("v"), usable("v")).collect()] == [("stage11", True), ("stage11", True), ("na", False), ("", False), (None, False), ("none", False), ("na", False)]
    paths = spark.createDataFrame([("a\\b//C.jsonl",), ("./a/b/c.jsonl",), ("null",), (None,)], "v string")
    assert [r[0] for r in paths.select(folded_path("v")).collect()] == ["a/b/c.jsonl", "a/b/c.jsonl", None, None]


def test_time_stamps(spark):
    forms = ["2025-01-01T02:00:00+02:00", "2025-01-01T00:00:00Z", "2025-01-01 00:00:00", "1735689600", "1735689600.0", " 2024-12-31T18:30:00-05:30 ", "2025-01-01", "2025-01-01T02:00:00+0200"]
    df = spark.createDataFrame([(x,) for x in forms + ["soon", "", None, "2025-13-01"]], "v string")
    spark.conf.set("spark.sql.session.timeZone", "Asia/Tokyo")
    try:
        got = [r[0] for r in df.select(micros("v")).collect()]
    finally:
        spark.conf.set("spark.sql.session.timeZone", "UTC")
    assert got == [1735689600 * 10**6] * len(forms) + [None] * 4
    assert F is not None


def test_shards_take_sixteen_digits(spark):
    import hashlib

    from kgloom.operators.triples import shard

    names = ["P17", "P31", "P999", "", "é", "P279"]
    df = spark.createDataFrame([(x,) for x in names], "r string")
    for digest in ("sha1", "sha256"):
        want = {x: int(hashlib.new(digest, x.encode()).hexdigest()[:16], 16) % 7 for x in names}
        assert {r.r: r.s for r in df.select("r", shard("r", 7, digest).alias("s")).collect()} == want
    # fixed values
    assert df.where("r = 'P17'").select(shard("r", 8), shard("r", 8, "sha256")).collect()[0] == (7, 7)
