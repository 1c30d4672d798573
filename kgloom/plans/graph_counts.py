"""Counting queries over the candidate graph (all of ``candidates``) and the pool and auxiliary graphs."""

from __future__ import annotations

from pyspark.sql import functions as F

from kgloom.operators import triples as T
from kgloom.plans.registry import Registry, rounded
from kgloom.sources.tables import AUX_SQL, POOL_SQL, RAW_SQL, TRIPLES_SQL, graph, raw_triples, triples

R = Registry()
K = f"WITH {TRIPLES_SQL}"
NB = "nb AS MATERIALIZED (SELECT DISTINCT h AS v, t AS w FROM k WHERE h <> t UNION SELECT t, h FROM k WHERE h <> t)"

R.add("graph_triples", triples, f"{K} SELECT * FROM k")
R.add("graph_summary", lambda s, d: T.summary(T.reject_nulls(raw_triples(s, d))), f"""{K} SELECT (SELECT count(*) FROM raw) AS raw_rows, (SELECT count(*) FROM k) AS triples, (SELECT count(*) FROM raw) - (SELECT count(*) FROM k) AS duplicate_rows,
  (SELECT count(*) FROM (SELECT h FROM k UNION SELECT t FROM k)) AS entities, (SELECT count(DISTINCT r) FROM k) AS relations""")
R.add("relation_counts", lambda s, d: T.relation_counts(triples(s, d)), f"{K} SELECT r, count(*) AS n FROM k GROUP BY r")
R.add("raw_relation_counts", lambda s, d: T.relation_counts(raw_triples(s, d)), f"WITH {RAW_SQL} SELECT r, count(*) AS n FROM raw GROUP BY r")
R.add("duplicate_triples", lambda s, d: T.duplicates(raw_triples(s, d)), f"WITH {RAW_SQL} SELECT h, r, t, count(*) AS n FROM raw GROUP BY h, r, t HAVING count(*) > 1")
R.add("triple_multiplicity", lambda s, d: T.multiplicity(raw_triples(s, d)), f"WITH {RAW_SQL} SELECT h, r, t, count(*) AS n FROM raw GROUP BY h, r, t")
_CASES = " ".join(f"WHEN n < {top} THEN '{name}'" for top, name in T.BUCKETS[:-1])
R.add("relation_count_histogram", lambda s, d: T.count_histogram(T.relation_counts(triples(s, d))), f"{K} SELECT CASE {_CASES} ELSE '1000+' END AS bucket, count(*) AS relations FROM (SELECT r, count(*) AS n FROM k GROUP BY r) GROUP BY 1")
R.add("relation_count_distribution", lambda s, d: T.count_distribution(T.relation_counts(triples(s, d))), f"{K} SELECT min(n) AS min_n, max(n) AS max_n, round(avg(n), 9) AS mean_n, quantile_cont(n, 0.5) AS median_n FROM (SELECT r, count(*) AS n FROM k GROUP BY r)")
R.add("entities", lambda s, d: T.entities(triples(s, d)), f"{K} SELECT h AS entity FROM k UNION SELECT t FROM k")
_DEG = "deg AS MATERIALIZED (SELECT entity, CAST(sum(o) AS BIGINT) AS out_degree, CAST(sum(i) AS BIGINT) AS in_degree, CAST(sum(o + i) AS BIGINT) AS degree FROM (SELECT h AS entity, 1 AS o, 0 AS i FROM k UNION ALL SELECT t, 0, 1 FROM k) GROUP BY entity)"
R.add("degrees", lambda s, d: T.degrees(triples(s, d)), f"{K}, {_DEG} SELECT * FROM deg")
R.add("pair_counts", lambda s, d: T.pair_counts(triples(s, d)), f"{K} SELECT least(h, t) AS a, greatest(h, t) AS b, count(*) AS n FROM k GROUP BY 1, 2")
_SD = "sd AS MATERIALIZED (SELECT v AS entity, CAST(sum(CASE WHEN v = w THEN 2 ELSE 1 END) AS BIGINT) AS degree FROM (SELECT h AS v, t AS w FROM k UNION SELECT t, h FROM k) GROUP BY v)"
R.add("two_path_proxy", lambda s, d: T.two_path_proxy(triples(s, d)), f"{K}, {_SD} SELECT CAST(sum(degree * (degree - 1) // 2) AS BIGINT) AS two_paths, count(*) FILTER (WHERE degree <= 1) AS low_degree_entities FROM sd")
R.add("entity_relation_incidence", lambda s, d: T.incidence(triples(s, d)), f"{K} SELECT entity, count(*) AS n_relations FROM (SELECT h AS entity, r FROM k UNION SELECT t, r FROM k) GROUP BY entity")
R.add("top_nodes_subgraph", lambda s, d: T.top_nodes_subgraph(triples(s, d), 300), f"{K}, {_DEG}, top AS (SELECT entity FROM deg ORDER BY degree DESC, entity LIMIT 300) SELECT h, r, t FROM k WHERE h IN (SELECT entity FROM top) AND t IN (SELECT entity FROM top)")


def _top_edges(s, d):
    """The 1000 triples whose ends have the highest summed degree; a report of that size is the feature."""
    k = graph(s, d)
    deg = T.degrees(k).select("entity", "degree")
    both = k.join(deg.select(F.col("entity").alias("h"), F.col("degree").alias("_a")), "h").join(deg.select(F.col("entity").alias("t"), F.col("degree").alias("_b")), "t")
    return both.withColumn("weight", F.col("_a") + F.col("_b")).orderBy(F.col("weight").desc(), "r", "h", "t").limit(1000).select("h", "r", "t", "weight")


R.add("top_edges", _top_edges, f"{K}, {_DEG} SELECT h, r, t, a.degree + b.degree AS weight FROM k JOIN deg a ON a.entity = h JOIN deg b ON b.entity = t ORDER BY weight DESC, r, h, t LIMIT 1000")


def _sample(s, d):
    """1000 triples in the order of a seeded hash: the same sample wherever it is drawn."""
    key = F.md5(F.concat_ws("|", F.lit("7"), "h", "r", "t"))
    return triples(s, d).orderBy(key, "h", "r", "t").limit(1000)


R.add("hash_sample", _sample, f"{K} SELECT h, r, t FROM k ORDER BY md5(concat_ws('|', '7', h, r, t)), h, r, t LIMIT 1000")


def _khop(s, d):
    """Everything within two hops of the entity of highest degree."""
    k = graph(s, d)
    centre = T.degrees(k).orderBy(F.col("degree").desc(), "entity").limit(1).select("entity")
    return T.k_hop(k, centre, 2)


R.add("k_hop", _khop, f"""{K}, {_DEG}, {NB}, c AS (SELECT entity FROM deg ORDER BY degree DESC, entity LIMIT 1),
one AS (SELECT w AS entity FROM nb WHERE v IN (SELECT entity FROM c)), two AS (SELECT w AS entity FROM nb WHERE v IN (SELECT entity FROM one))
SELECT entity, CAST(min(depth) AS INTEGER) AS depth FROM (SELECT entity, 0 AS depth FROM c UNION ALL SELECT entity, 1 FROM one UNION ALL SELECT entity, 2 FROM two) GROUP BY entity""")


def _aux_common(s, d):
    """Common neighbours in the candidate graph of the ends of every auxiliary edge."""
    p = triples(s, d, "aux_edges").select(F.least("h", "t").alias("a"), F.greatest("h", "t").alias("b"))
    return T.common_neighbours(graph(s, d), p)


R.add("common_neighbours", _aux_common, f"""{K}, {AUX_SQL}, {NB}, p AS (SELECT DISTINCT least(h, t) AS a, greatest(h, t) AS b FROM aux)
SELECT p.a, p.b, count(y.w) AS common FROM p LEFT JOIN nb x ON x.v = p.a LEFT JOIN nb y ON y.v = p.b AND y.w = x.w GROUP BY p.a, p.b""")


def _endpoint_class(s, d):
    """Auxiliary triples by how many of their ends the candidate graph knows."""
    e = T.entities(triples(s, d)).withColumn("_k", F.lit(True))
    a = triples(s, d, "aux_edges").join(e.select(F.col("entity").alias("h"), F.col("_k").alias("_h")), "h", "left").join(e.select(F.col("entity").alias("t"), F.col("_k").alias("_t")), "t", "left")
    both, one = F.col("_h").isNotNull() & F.col("_t").isNotNull(), F.col("_h").isNotNull() | F.col("_t").isNotNull()
    return a.select("h", "r", "t", F.when(both, "internal").when(one, "semi_internal").otherwise("external").alias("candidate_class"))


R.add("endpoint_class", _endpoint_class, f"""{K}, {AUX_SQL}, e AS MATERIALIZED (SELECT h AS entity FROM k UNION SELECT t FROM k)
SELECT h, r, t, CASE WHEN x.entity IS NOT NULL AND y.entity IS NOT NULL THEN 'internal' WHEN x.entity IS NOT NULL OR y.entity IS NOT NULL THEN 'semi_internal' ELSE 'external' END AS candidate_class
FROM aux LEFT JOIN e x ON x.entity = h LEFT JOIN e y ON y.entity = t""")
R.add("observed_in_pool", lambda s, d: triples(s, d, "aux_edges").join(triples(s, d, "pool_records"), ["h", "r", "t"], "left_semi"), f"WITH {AUX_SQL}, {POOL_SQL} SELECT * FROM aux INTERSECT SELECT * FROM pool")
R.add("reverse_in_graph", lambda s, d: triples(s, d, "aux_edges").join(triples(s, d).select(F.col("t").alias("h"), "r", F.col("h").alias("t")), ["h", "r", "t"], "left_semi"), f"{K}, {AUX_SQL} SELECT * FROM aux WHERE (t, r, h) IN (SELECT (h, r, t) FROM k)")
R.add("touching_graph", lambda s, d: _touch(s, d), f"""{K}, {AUX_SQL}, e AS MATERIALIZED (SELECT h AS entity FROM k UNION SELECT t FROM k)
SELECT r, count(*) AS n, count(*) FILTER (WHERE h IN (SELECT entity FROM e) OR t IN (SELECT entity FROM e)) AS touching FROM aux GROUP BY r""")


def _touch(s, d):
    c = _endpoint_class(s, d)
    return c.groupBy("r").agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("candidate_class") != "external").alias("touching"))


def _union_all(s, d):
    """Union of the three graphs, each triple once with the sources that hold it."""
    parts = [triples(s, d, n).withColumn("source", F.lit(n)) for n in ("candidates", "pool_records", "aux_edges")]
    u = parts[0].unionByName(parts[1]).unionByName(parts[2])
    return u.groupBy("h", "r", "t").agg(F.array_join(F.sort_array(F.collect_set("source")), "|").alias("sources"))


R.add("merged_graph", _union_all, f"""{K}, {POOL_SQL}, {AUX_SQL} SELECT h, r, t, string_agg(source, '|' ORDER BY source) AS sources FROM
(SELECT *, 'candidates' AS source FROM k UNION ALL SELECT *, 'pool_records' FROM pool UNION ALL SELECT *, 'aux_edges' FROM aux) GROUP BY h, r, t""")
R.add("new_in_aux", lambda s, d: triples(s, d, "aux_edges").join(triples(s, d), ["h", "r", "t"], "left_anti"), f"{K}, {AUX_SQL} SELECT * FROM aux EXCEPT SELECT * FROM k")


def _triple_ids(s, d):
    """Stable identifiers of triples and the shard of each relation."""
    shard = T.shard("r", 8)
    return triples(s, d).select("h", "r", "t", F.sha2(F.concat_ws("\t", "h", "r", "t"), 256).alias("triple_id"), shard.alias("shard"))


R.add("triple_ids", _triple_ids, f"{K} SELECT h, r, t, sha256(concat_ws(chr(9), h, r, t)) AS triple_id, CAST(('0x' || substr(sha1(r), 1, 16))::UBIGINT % 8 AS BIGINT) AS shard FROM k")

# statistics of relations in the graph itself
from kgloom.operators import hops as H  # noqa: E402

_SYM = """b AS (SELECT k.*, EXISTS (SELECT 1 FROM k j WHERE j.h = k.t AND j.r = k.r AND j.t = k.h) AS has FROM k)
SELECT r, count(*) AS n_pairs, round(count(*) FILTER (WHERE has) / count(*), 9) AS sym_score, round(count(*) FILTER (WHERE NOT has AND h <> t) / count(*), 9) AS anti_score FROM b GROUP BY r"""
R.add("kg_symmetry", lambda s, d: rounded(H.relation_symmetry(graph(s, d)), "sym_score", "anti_score"), f"{K}, {_SYM}")
R.add("kg_inverse", lambda s, d: rounded(H.relation_inverse(graph(s, d)), "score"), f"""{K}, n AS (SELECT r, count(*) AS n FROM k GROUP BY r), o AS (SELECT a.r AS r1, b.r AS r2, count(*) AS overlap FROM k a JOIN k b ON a.h = b.t AND a.t = b.h AND a.r <> b.r GROUP BY 1, 2)
SELECT r1, r2, overlap, round(overlap / n, 9) AS score FROM o JOIN n ON n.r = r1""")
_LOOPS = "lp AS (SELECT a.r AS r1, b.r AS r2, count(*) AS loop FROM k a JOIN k b ON a.t = b.h AND a.h = b.t AND a.h <> a.t GROUP BY 1, 2)"
R.add("hop_support", lambda s, d: H.hop_support(graph(s, d)), f"""{K}, {_LOOPS}, x AS (SELECT a.r AS r1, b.r AS r2, count(*) AS total FROM k a JOIN k b ON a.t = b.h WHERE a.h <> a.t AND b.h <> b.t GROUP BY 1, 2)
SELECT r1, r2, coalesce(loop, 0) AS loop, total - coalesce(loop, 0) AS nonloop, total FROM x LEFT JOIN lp USING (r1, r2)""")
R.add("hop_middle_support", lambda s, d: H.middle_support(graph(s, d)), f"{K} SELECT a.r AS r1, b.r AS r2, count(DISTINCT a.t) AS support FROM k a JOIN k b ON a.t = b.h GROUP BY 1, 2")
R.add("hop_loops", lambda s, d: H.loops(graph(s, d)), f"{K}, {_LOOPS} SELECT * FROM lp")
R.add("hop_top_total", lambda s, d: H.top_followers(H.hop_support(graph(s, d)), "total", 10), f"""{K}, x AS (SELECT a.r AS r1, b.r AS r2, count(*) AS total FROM k a JOIN k b ON a.t = b.h WHERE a.h <> a.t AND b.h <> b.t GROUP BY 1, 2)
SELECT r1, r2, total, CAST(row_number() OVER (PARTITION BY r1 ORDER BY total DESC, r2) AS INTEGER) AS place FROM x QUALIFY place <= 10""")
R.add("hop_top_loop", lambda s, d: H.top_followers(H.loops(graph(s, d)), "loop", 10), f"{K}, {_LOOPS} SELECT r1, r2, loop, CAST(row_number() OVER (PARTITION BY r1 ORDER BY loop DESC, r2) AS INTEGER) AS place FROM lp QUALIFY place <= 10")
R.add("hop_top_middle", lambda s, d: H.top_followers(H.middle_support(graph(s, d)), "support", 10), f"""{K}, x AS (SELECT a.r AS r1, b.r AS r2, count(DISTINCT a.t) AS support FROM k a JOIN k b ON a.t = b.h GROUP BY 1, 2)
SELECT r1, r2, support, CAST(row_number() OVER (PARTITION BY r1 ORDER BY support DESC, r2) AS INTEGER) AS place FROM x QUALIFY place <= 10""")
R.add("hop_followers", lambda s, d: H.followers(graph(s, d)), f"{K} SELECT DISTINCT a.r AS r1, b.r AS r2 FROM k a JOIN k b ON a.t = b.h")
R.add("two_paths", lambda s, d: H.two_paths(graph(s, d)), f"{K} SELECT a.h, a.r AS r1, b.r AS r2, b.t FROM k a JOIN k b ON a.t = b.h WHERE a.h <> a.t")

QUERIES, SQL = R.queries, R.sql
