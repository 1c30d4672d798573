import json
from collections import Counter

import pytest

from kgloom.sources import readers as S
from kgloom.sources import writers as W
from kgloom.streaming import jobs


def put(tmp_path, name, text):
    (tmp_path / name).write_text(text, encoding="utf-8")
    return str(tmp_path / name)


def test_triple_formats(spark, tmp_path):
    rows = [("a", "r", "b"), ("b", "s", "c")]
    objs = [{"h": h, "r": r, "t": t, "x": 1} for h, r, t in rows]
    files = [
        put(tmp_path, "k.csv", "r,h,t,z\nr,a,b,1\ns,b,c,2\n"),
        put(tmp_path, "k.jsonl", "\n".join(map(json.dumps, objs)) + "\n\n"),
        put(tmp_path, "k.json", json.dumps(objs)),
        put(tmp_path, "w.json", json.dumps({"meta": 1, "triples": objs})),
        put(tmp_path, "o.json", json.dumps({"triples_out": objs})),
    ]
    for f in files:
        assert sorted(map(tuple, S.read_triples(spark, f).collect())) == rows, f
    other = put(tmp_path, "n.jsonl", '{"head": "a", "rel": 5, "tail": "b"}\n')
    assert S.read_triples(spark, other, "head", "rel", "tail").collect()[0].r == "5"


def test_triple_errors(spark, tmp_path):
    with pytest.raises(ValueError, match="suffix"):
        S.read_triples(spark, "k.xml")
    with pytest.raises(ValueError, match="lacks"):
        S.read_triples(spark, put(tmp_path, "a.csv", "h,r\n1,2\n"))
    for name, text in (("b.jsonl", '{"h": "a", "r": "r"}\n'), ("c.jsonl", "{broken\n"), ("d.json", '{"x": 1}')):
        with pytest.raises(Exception):  # noqa: B017, PT011
            S.read_triples(spark, put(tmp_path, name, text)).collect()


def test_lenient_folder_and_labels(spark, tmp_path):
    (tmp_path / "in" / "deep").mkdir(parents=True)
    put(tmp_path, "in/a.jsonl", '{"h":"a","r":"r","t":"b"}\nbroken\n{"h":"a","r":"r"}\n\n{"h":"a","r":"r","t":"b"}\n')
    put(tmp_path, "in/deep/b.jsonl", '{"h":"c","r":"s","t":"d"}\n')
    k, bad = S.read_triples_leniently(spark, str(tmp_path / "in"))
    assert k.count() == 2 and bad.collect()[0].malformed == 2
    assert {tuple(r) for r in S.merge_folder(spark, str(tmp_path / "in")).collect()} == {("a", "r", "b"), ("c", "s", "d")}
    assert S.merge_folder(spark, str(tmp_path / "in"), spark.createDataFrame([("s",)], "relation string")).count() == 1
    lab = put(tmp_path, "l.jsonl", '{"h":"a","r":"r","t":"b","edge_source":"x","score":0.5}\n{"h":"a","r":"r","t":"c","source":"y"}\n{"h":"a","r":"r","t":"d"}\n')
    got = {r.t: (r.source, r.provenance) for r in S.read_labelled(spark, lab).collect()}
    assert got == {"b": ("x", {"score": "0.5"}), "c": ("y", {}), "d": ("canonical_observed", {})}
    sh = S.read_candidate_shards(spark, put(tmp_path, "s.jsonl", '{"h":"a","relation":"r","t":"b","q":1}\n{"h":"a","t":"b"}\n{"h":"e","r":"r","t":"f"}\n'))
    assert {(r.h, r.source_line) for r in sh.collect()} == {("a", 1), ("e", 3)}


def test_lines_are_numbered_across_splits(spark, tmp_path):
    rows = [{"h": f"h{i}", "r": "r", "t": "t", "pad": "x" * (i % 90)} for i in range(400)]
    put(tmp_path, "a.jsonl", "\n".join(json.dumps(x) if i % 7 else "" for i, x in enumerate(rows)))
    put(tmp_path, "b.jsonl", json.dumps(rows[0]))
    before = spark.conf.get("spark.sql.files.maxPartitionBytes"), spark.conf.get("spark.sql.files.openCostInBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "3000")
    spark.conf.set("spark.sql.files.openCostInBytes", "10")
    try:
        got = S.read_candidate_shards(spark, str(tmp_path)).select("h", "source_line", "source_path").collect()
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before[0])
        spark.conf.set("spark.sql.files.openCostInBytes", before[1])
    assert {(r.h, r.source_line) for r in got if r.source_path.endswith("a.jsonl")} == {(f"h{i}", i + 1) for i in range(400) if i % 7}
    assert [r.source_line for r in got if r.source_path.endswith("b.jsonl")] == [1]


def test_type_closure(spark):
    direct = spark.createDataFrame([("e", "a"), ("f", "x"), (None, "a"), ("g", None), ("c", "y")], "entity string, type string")
    steps = spark.createDataFrame([(f"{i:02d}", f"{i + 1:02d}") for i in range(20)] + [("a", "00"), ("y", "z"), ("z", "y"), ("z", "z"), (None, "q"), ("a", None)], "type string, super string")
    got = {tuple(r) for r in S.type_closure(direct, steps).collect()}
    assert got == {("e", "a"), ("f", "x"), ("c", "y"), ("c", "z")} | {("e", f"{i:02d}") for i in range(21)}
    assert S.type_closure(direct, steps.limit(0)).count() == 3


def test_support_documents(spark, tmp_path):
    docs = [
        {"r1": "P1", "status": "SUCCESS", "support_data": {"P2": {"loop": 1, "nonloop": 2, "total": 0}, "x": {"loop": 1}, "P3": {"loop": "2", "nonloop": 3, "total": 9}}},
        {"r1": "P4", "status": "SUCCESS", "support_by_r2": {"P2": 7}},
        {"r1": "P5", "status": "SUCCESS", "top_support": [{"r2": "P6", "support": 8}]},
        {"r1": "P8", "status": "SUCCESS", "support": [{"r2": "P6", "support": 3}, {"r2": "P6", "support": 4}], "topk_support": [{"r2": "P9", "support": 1}]},
        {"r1": "P7", "status": "ERROR", "support_by_r2": {"P2": 1}},
        {"r1": "bad", "status": "SUCCESS", "support_by_r2": {"P2": 1}},
    ]
    f = put(tmp_path, "h.jsonl", "\n".join(map(json.dumps, docs)) + "\n{oops\n")
    assert {(r.r1, r.r2, r.loop, r.nonloop, r.total) for r in S.read_hop_support(spark, f).collect()} == {("P1", "P2", 1, 2, 3), ("P1", "P3", 2, 3, 9), ("P4", "P2", 0, 0, 7), ("P5", "P6", 0, 0, 8), ("P8", "P6", 0, 0, 3), ("P8", "P9", 0, 0, 1)}
    assert S.read_hop_support(spark, f, only_success=False).count() == 7
    comp = {"input_status": "SUCCESS", "r1": "P1", "r2": "P2", "support": 4, "rule_verification": {"composition": {"P3": {"chain_pairs_examined": 10, "chain_pairs_with_shortcut": 4}, "P9": {}}}}
    got = {r.r3: (r.support, r.examined, r.shortcuts, r.missing, r.confidence) for r in S.read_compositions(spark, put(tmp_path, "c.jsonl", json.dumps(comp))).collect()}
    assert got == {"P3": (4, 10, 4, 6, 0.4), "P9": (4, 0, 0, 0, 0.0)}


def test_allocations_matrix_types(spark, tmp_path):
    rows = [{"pattern": "p", "relation": "P1", "eta_integer": 3, "eta_expected": 2.7}, {"pattern": "p", "relation": "P2", "eta_integer": 0, "eta": 5}, {"pattern": "q", "relation": "P3", "eta": 1.5}]
    want = {("p", "P1", 3.0), ("q", "P3", 1.5)}
    for f in (put(tmp_path, "a.json", json.dumps({"allocations": rows})), put(tmp_path, "b.json", json.dumps(rows)), put(tmp_path, "c.jsonl", "\n".join(map(json.dumps, rows)))):
        assert {tuple(r) for r in S.read_allocations(spark, f).collect()} == want
    assert {tuple(r) for r in S.read_allocations(spark, put(tmp_path, "d.csv", "group,property_id,count\np,P1,3\nq,P3,1.5\n")).collect()} == want
    m = {("a", "b", 2.0)}
    assert {tuple(r) for r in S.read_matrix(spark, put(tmp_path, "m.json", '{"a": {"b": 2, "c": 0}, "d": {}}')).collect()} == m
    assert {tuple(r) for r in S.read_matrix(spark, put(tmp_path, "m.jsonl", '{"row":"a","col":"b","value":2}\n{"row":"a","col":"c","value":0}\n')).collect()} == m
    for f in (put(tmp_path, "t.json", '{"e": ["x", "y"]}'), put(tmp_path, "u.json", '[{"entity": "e", "types": ["x", "y"]}]'), put(tmp_path, "v.jsonl", '{"entity": "e", "types": ["x", "y"]}')):
        assert [(r.entity, r.types) for r in S.read_entity_types(spark, f).collect()] == [("e", ["x", "y"])]
    direct = spark.createDataFrame([("e", "x")], "entity string, type string")
    sub = spark.createDataFrame([("x", "y"), ("y", "z"), ("z", "x")], "type string, super string")
    assert {r.type for r in S.type_closure(direct, sub).collect()} == {"x", "y", "z"}


def test_round_trips(spark, tmp_path):
    df = spark.createDataFrame([("a", "r", "b", "p"), ("ü,\"", "r", "c", "q")], "h string, r string, t string, pattern string")
    k = Counter((r.h, r.r, r.t) for r in df.collect())
    W.write_jsonl(df, str(tmp_path / "x.jsonl"))
    W.write_csv(df, str(tmp_path / "x.csv"))
    W.write_by_relation(df, str(tmp_path / "x.parquet"), 4)
    for n in ("x.jsonl", "x.csv", "x.parquet"):
        assert Counter(map(tuple, S.read_triples(spark, str(tmp_path / n)).collect())) == k
    with pytest.raises(Exception, match="(?i)exists"):
        W.write_csv(df, str(tmp_path / "x.csv"))
    W.write_patterns(df, str(tmp_path / "pat"))
    assert sorted(p.name for p in (tmp_path / "pat").glob("pattern=*")) == ["pattern=p", "pattern=q"]
    edges = spark.createDataFrame([("a", "b<", 2.0)], "a string, b string, weight double")
    W.write_graphml(edges, str(tmp_path / "g.graphml"))
    import xml.etree.ElementTree as ET

    assert len(ET.parse(tmp_path / "g.graphml").getroot()[1]) == 3
    with pytest.raises(ValueError, match="at most"):
        W.write_graphml(edges, str(tmp_path / "g2.graphml"), 0)
    import hashlib

    f = put(tmp_path, "one.txt", "x")
    assert W.file_hashes(spark, f).collect()[0].sha256 == hashlib.sha256(b"x").hexdigest()


def test_merge_shards(spark):
    df = spark.createDataFrame([("P1", 1, "a"), ("P1", 2, "b"), ("P2", 1, "c")], "r1 string, line int, v string")
    assert W.merge_shards(df, "r1", "append").count() == 3
    assert {tuple(r) for r in W.merge_shards(df, "r1", "latest", ["line"]).collect()} == {("P1", 2, "b"), ("P2", 1, "c")}
    with pytest.raises(ValueError, match="repeated"):
        W.merge_shards(df, "r1", "fail")


def test_streams(spark, tmp_path):
    src = tmp_path / "shards"
    src.mkdir()
    put(src, "1.json", '{"r1":"P1","at":1,"v":"a"}\n{"r1":"P2","at":5,"v":"x"}\n')
    run = lambda: jobs.follow_shards(spark, str(src), "r1 string, at int, v string", str(tmp_path / "cp"), jobs.upsert_into(str(tmp_path / "tab"), "r1", ["at"]), 1).awaitTermination(60)
    run()
    put(src, "2.json", '{"r1":"P1","at":3,"v":"b"}\n{"r1":"P2","at":2,"v":"old"}\n')
    run()
    assert {tuple(r) for r in spark.read.parquet(str(tmp_path / "tab" / "v1")).collect()} == {("P1", 3, "b"), ("P2", 5, "x")}
    ev = spark.createDataFrame([("2025-01-01 00:10:00", "k"), ("2025-01-01 00:50:00", "k"), ("2025-01-01 01:00:00", "k")], "at string, k string").selectExpr("to_timestamp(at) AS at", "k")
    assert sorted(r.n for r in jobs.windowed_counts(ev, "at", ["k"]).collect()) == [1, 2]


def test_attempts_last_file_wins(spark, tmp_path):
    import os

    t = lambda *x: [dict(zip("hrt", y, strict=True)) for y in x]
    put(tmp_path, "a_attempt_1.json", json.dumps({"triples_out": t("arb", "brc")}))
    put(tmp_path, "b_attempt_1.json", json.dumps({"triples_out": t("xry")}))
    put(tmp_path, "c_attempt2.json", json.dumps(t("arb", "crd") + [{"h": "q"}]))
    put(tmp_path, "plain.json", json.dumps({"triples": t("crd")}))
    os.utime(tmp_path / "a_attempt_1.json", (2_000_000_000, 2_000_000_000))
    os.utime(tmp_path / "b_attempt_1.json", (1_000_000_000, 1_000_000_000))
    got = lambda n=None: {tuple(r) for r in S.read_attempts(spark, str(tmp_path / "*.json"), n).collect()}
    assert got() == {("a", "r", "b", 1), ("b", "r", "c", 1), ("c", "r", "d", 0)}
    assert got(2) == {("a", "r", "b", 2), ("c", "r", "d", 2)}


def test_discovery_documents(spark, tmp_path):
    docs = [
        {"r1": "P1", "status": "SUCCESS", "valid_r2": ["P3", "P2", ""], "failed_r2": ["P9", "P2"]},
        {"r1": "P2", "status": "ERROR", "support_by_r2": {"P5": 1, "P4": 2}},
        {"r1": "P3", "status": "SUCCESS", "support_data": {"P7": {"total": 3}}, "top_support": [{"r2": "P8", "support": 1}]},
        {"r1": "P4", "status": "X", "top_support": [{"r2": "P8"}, {"r2": "P6"}], "topk_support": [{"r2": "P8"}]},
    ]
    d = S.read_discovery(spark, put(tmp_path, "d.jsonl", "\n".join(map(json.dumps, docs)) + "\n{bad\n"))
    assert {r.r1: r.v for r in d.select("r1", S.valid_r2().alias("v")).collect()} == {"P1": ["P2", "P3"], "P2": ["P4", "P5"], "P3": ["P7"], "P4": ["P6", "P8"]}
    ok = spark.createDataFrame([("P1", "P2"), ("P2", "P4"), ("P4", "P6"), ("P1", None)], "r1 string, r2 string")
    got = {r.r1: r for r in S.filter_r2(d, ok).collect()}
    assert got["P1"].valid_r2 == ["P2"] and got["P1"].failed_r2 == ["P2"] and got["P1"].valid_r2_count == 1
    assert got["P2"].support_by_r2 == {"P4": "2"} and got["P3"].support_data == {} and [x.r2 for x in got["P4"].top_support] == ["P6"] and got["P4"].valid_r2 is None
    assert {r.r1 for r in S.failed_only(d, spark.createDataFrame([("P2",), ("P2",)], "x string")).collect()} == {"P2"}
    pairs = spark.createDataFrame([("P1", "P2", 5), ("P1", "P7", 0), ("P2", "x", 4), ("P3", "P1", 1)], "r1 string, r2 string, total long")
    assert {tuple(r) for r in S.to_discovery(pairs, d, 1).select("r1", "status", "valid_r2_count").collect()} == {("P1", "SUCCESS", 1), ("P2", "ERROR", 0), ("P3", "SUCCESS", 1), ("P4", "NOT_FOUND", 0)}


def test_ontology(spark, tmp_path):
    f = put(tmp_path, "o.json", json.dumps([{"relation": "P1", "subject_type": "a", "object_type": "b"}, {"relation": "P1"}]))
    rows = spark.createDataFrame([(1, "P1", "a", "b"), (2, "P1", "b", "a"), (3, "P1", None, "b"), (4, "P2", "a", "b")], "i int, r string, subject_type string, object_type string")
    table = S.read_ontology(spark, f)
    assert {x.i for x in S.ontology_ok(rows, table).where("ontology_ok").collect()} == {1, 3}
    assert S.ontology_ok(rows, None).where("ontology_ok").count() == 4
