"""Components, bridges and graph construction over the candidate, pool and auxiliary graphs."""

from __future__ import annotations

from pyspark.sql import functions as F

from kgloom.functions.ids import plain_id, plain_id_sql
from kgloom.operators import allocate as A
from kgloom.operators import audits as U
from kgloom.operators import candidates as N
from kgloom.operators import construct as B
from kgloom.operators import graph as G
from kgloom.operators import triples as T
from kgloom.operators import vectors as V
from kgloom.plans.evidence import annotated
from kgloom.plans.registry import Registry
from kgloom.session import cut
from kgloom.sources.tables import ALLOC_SQL, AUX_SQL, POOL_SQL, TRIPLES_SQL, allocations, graph, table, triples

R = Registry()


def cc_sql(name: str, source: str) -> str:
    return f"""e{name} AS MATERIALIZED (SELECT h AS a, t AS b FROM {source} UNION SELECT t, h FROM {source}),
{name}(v, label) USING KEY (v) AS (SELECT a, min(least(a, b)) FROM e{name} GROUP BY a UNION SELECT e.b, min(g.label) FROM {name} g JOIN e{name} e ON g.v = e.a JOIN recurring.{name} AS r ON r.v = e.b WHERE g.label < r.label GROUP BY e.b)"""


CC = f"WITH RECURSIVE {TRIPLES_SQL}, {cc_sql('cc', 'k')}"


def bridge_sql(source: str, cc: str) -> str:
    """Bridges by another way than the operator's: a breadth-first tree, and every edge outside of it walked up to where its ends meet; a tree
    edge that no such walk covers is a bridge. ``cc`` must hold the components of ``source``."""
    return f"""ed AS MATERIALIZED (SELECT DISTINCT least(h, t) AS a, greatest(h, t) AS b FROM {source} WHERE h <> t), eb AS MATERIALIZED (SELECT a AS v, b AS w FROM ed UNION ALL SELECT b, a FROM ed),
bf(v, dist) USING KEY (v) AS (SELECT v, 0 FROM {cc} WHERE v = label UNION SELECT eb.w, min(g.dist) + 1 FROM bf g JOIN eb ON eb.v = g.v LEFT JOIN recurring.bf AS o ON o.v = eb.w WHERE o.v IS NULL GROUP BY eb.w),
tp AS MATERIALIZED (SELECT x.v, x.dist, min(y.v) AS up FROM bf x LEFT JOIN eb ON eb.v = x.v LEFT JOIN bf y ON y.v = eb.w AND y.dist = x.dist - 1 GROUP BY x.v, x.dist),
cl(u, w) AS (SELECT a, b FROM ed WHERE NOT EXISTS (SELECT 1 FROM tp WHERE (v = a AND up = b) OR (v = b AND up = a)) UNION SELECT CASE WHEN p.dist >= q.dist THEN p.up ELSE cl.u END, CASE WHEN p.dist >= q.dist THEN cl.w ELSE q.up END FROM cl JOIN tp p ON p.v = cl.u JOIN tp q ON q.v = cl.w WHERE cl.u <> cl.w),
cv AS MATERIALIZED (SELECT DISTINCT CASE WHEN p.dist >= q.dist THEN u ELSE w END AS v FROM cl JOIN tp p ON p.v = u JOIN tp q ON q.v = w WHERE u <> w),
ac(v, top) AS (SELECT v, v FROM tp UNION ALL SELECT ac.v, tp.up FROM ac JOIN tp ON tp.v = ac.top WHERE tp.up IS NOT NULL), sz AS (SELECT top AS v, count(*) AS below FROM ac GROUP BY top), wh AS (SELECT label, count(*) AS whole FROM {cc} GROUP BY label),
br AS MATERIALIZED (SELECT least(tp.v, up) AS a, greatest(tp.v, up) AS b, least(below, whole - below) AS side, whole AS component_size FROM tp JOIN sz ON sz.v = tp.v JOIN {cc} m ON m.v = tp.v JOIN wh USING (label) WHERE up IS NOT NULL AND tp.v NOT IN (SELECT v FROM cv))"""


def members(s, d, name="candidates"):
    return parts(s, d, name)[1]


def parts(s, d, name="candidates"):
    """(triples, component of every entity)."""
    k = graph(s, d, name)
    return k, cut(G.components(G.simple_edges(k), T.entities(k)))


R.add("components", lambda s, d: members(s, d), f"{CC} SELECT v AS node, label AS component FROM cc")
R.add("component_sizes", lambda s, d: G.component_sizes(members(s, d)), f"{CC} SELECT label AS component, count(*) AS entities FROM cc GROUP BY 1")
R.add("connectivity", lambda s, d: G.connectivity(members(s, d)), f"{CC} SELECT count(*) AS components, max(n) AS largest, round(max(n) / sum(n), 9) AS largest_share FROM (SELECT count(*) AS n FROM cc GROUP BY label)")
_ST = "pr AS (SELECT label, r, count(*) AS n FROM k JOIN cc ON v = h GROUP BY 1, 2), sz AS (SELECT label, count(*) AS entities FROM cc GROUP BY 1)"
R.add("component_stats", lambda s, d: G.component_stats(*parts(s, d)), f"{CC}, {_ST} SELECT label AS component, entities, CAST(sum(n) AS BIGINT) AS triples, count(*) AS relations, arg_min(r, ROW(-n, r)) AS top_relation FROM pr JOIN sz USING (label) GROUP BY label, entities")
R.add("largest_component", lambda s, d: _largest(s, d), f"{CC}, big AS (SELECT label FROM cc GROUP BY 1 ORDER BY count(*) DESC, label LIMIT 1) SELECT h, r, t FROM k JOIN cc ON v = h WHERE label IN (SELECT label FROM big)")


def _largest(s, d):
    k, m = parts(s, d)
    big = G.component_sizes(m).orderBy(F.col("entities").desc(), "component").limit(1).select("component")
    inside = m.join(big, "component", "left_semi").select(F.col("node").alias("h"))
    return k.join(inside, "h", "left_semi").select("h", "r", "t")


R.add("weak_components_filtered", lambda s, d: G.without_weak_components(*parts(s, d), 5, 5), f"""{CC}, q AS (SELECT k.*, label FROM k JOIN cc ON v = h), keep AS (SELECT label FROM (SELECT label, count(*) AS t FROM q GROUP BY 1) JOIN (SELECT label, count(*) AS n FROM cc GROUP BY 1) USING (label) WHERE t >= 5 AND n >= 5
UNION SELECT label FROM q WHERE r IN (SELECT r FROM k GROUP BY r HAVING count(*) = 1)) SELECT h, r, t FROM q WHERE label IN (SELECT label FROM keep)""")
R.add("aux_connectivity", lambda s, d: G.connectivity(members(s, d, "aux_edges")), f"WITH RECURSIVE {AUX_SQL}, {cc_sql('cc', 'aux')} SELECT count(*) AS components, max(n) AS largest, round(max(n) / sum(n), 9) AS largest_share FROM (SELECT count(*) AS n FROM cc GROUP BY label)")


def _bridges(s, d, name="candidates"):
    return G.bridges(cut(G.simple_edges(triples(s, d, name))))


_BR = f"{CC}, {bridge_sql('k', 'cc')}"
R.add("bridges", lambda s, d: _bridges(s, d), f"{_BR} SELECT * FROM br")
R.add("bridges_aux", lambda s, d: _bridges(s, d, "aux_edges"), f"WITH RECURSIVE {AUX_SQL}, {cc_sql('ca', 'aux')}, {bridge_sql('aux', 'ca')} SELECT * FROM br")


def _two_edge(s, d):
    e = cut(G.simple_edges(triples(s, d)))
    b = cut(G.bridges(e))
    return cut(G.two_edge_components(e, b)), b


_TE = f"{_BR}, ne AS MATERIALIZED (SELECT v AS h, w AS t FROM eb WHERE (least(v, w), greatest(v, w)) NOT IN (SELECT (a, b) FROM br)), {cc_sql('ct', 'ne')}, te AS MATERIALIZED (SELECT x.v AS node, coalesce(ct.label, x.v) AS component FROM (SELECT DISTINCT v FROM eb) x LEFT JOIN ct ON ct.v = x.v)"
R.add("two_edge_components", lambda s, d: _two_edge(s, d)[0], f"{_TE} SELECT node, component FROM te")
R.add("bridge_forest", lambda s, d: G.bridge_forest(*_two_edge(s, d)), f"{_TE} SELECT a, b, side, x.component AS ca, y.component AS cb FROM br JOIN te x ON x.node = a JOIN te y ON y.node = b")


R.add("articulation_points", lambda s, d: G.articulation_points(cut(G.simple_edges(triples(s, d)))))
R.add("vector_centrality", lambda s, d: V.centrality(table(s, d, "embeddings"), "vec_id", "label", "embedding").withColumn("centrality", F.round("centrality", 5)), """WITH f AS (SELECT vec_id, label, unnest(embedding)::DOUBLE AS x, generate_subscripts(embedding, 1) AS i FROM embeddings),
m AS (SELECT label, i, avg(x) AS m FROM f GROUP BY 1, 2) SELECT vec_id, label, round(sum(x * m) / (sqrt(sum(x * x)) * sqrt(sum(m * m))), 5) AS centrality FROM f JOIN m USING (label, i) GROUP BY 1, 2""")
R.add("vectors_most_central", lambda s, d: V.most_central(table(s, d, "embeddings"), "vec_id", "label", "embedding", 5).select("vec_id", "label", "place"), """WITH f AS (SELECT vec_id, label, unnest(embedding)::DOUBLE AS x, generate_subscripts(embedding, 1) AS i FROM embeddings),
m AS (SELECT label, i, avg(x) AS m FROM f GROUP BY 1, 2), c AS (SELECT vec_id, label, round(sum(x * m) / (sqrt(sum(x * x)) * sqrt(sum(m * m))), 6) AS c FROM f JOIN m USING (label, i) GROUP BY 1, 2)
SELECT vec_id, label, CAST(row_number() OVER (PARTITION BY label ORDER BY c DESC, vec_id) AS INTEGER) AS place FROM c QUALIFY place <= 5""")


def _structure(s, d):
    """One row of structural measures of the candidate graph."""
    k = graph(s, d)
    e = cut(G.simple_edges(k))
    one = lambda df: df.withColumn("_k", F.lit(1))
    b = G.bridges(e).agg(F.count(F.lit(1)).alias("bridges"))
    return one(T.summary(k)).join(one(G.connectivity(G.components(e, T.entities(k)))), "_k").join(one(b), "_k").join(one(T.two_path_proxy(k)), "_k").drop("_k")


R.add("structural_metrics", _structure, f"""{_BR}, sd AS (SELECT v AS entity, sum(CASE WHEN v = w THEN 2 ELSE 1 END) AS degree FROM (SELECT h AS v, t AS w FROM k UNION SELECT t, h FROM k) GROUP BY v), n AS (SELECT count(*) AS c, max(n) AS m, sum(n) AS s FROM (SELECT count(*) AS n FROM cc GROUP BY label))
SELECT (SELECT count(*) FROM k) AS raw_rows, (SELECT count(*) FROM k) AS triples, CAST(0 AS BIGINT) AS duplicate_rows, (SELECT count(*) FROM cc) AS entities, (SELECT count(DISTINCT r) FROM k) AS relations, c AS components, m AS largest, round(m / s, 9) AS largest_share, (SELECT count(*) FROM br) AS bridges,
(SELECT CAST(sum(degree * (degree - 1) // 2) AS BIGINT) FROM sd) AS two_paths, (SELECT count(*) FROM sd WHERE degree <= 1) AS low_degree_entities FROM n""")


def _safe_rows(s, d):
    """Triples of overfilled relations with more than one triple, and whether deleting one keeps its component whole."""
    k = graph(s, d)
    over = A.compare_relations(T.relation_counts(k), allocations(s, d)).where("surplus > 0 AND observed > 1").select(F.col("relation").alias("r"), F.round("surplus", 6).alias("surplus"))
    b = G.bridges(cut(G.simple_edges(k))).select("a", "b", F.lit(True).alias("_bridge"))
    m = k.join(over, "r").withColumns({"a": F.least("h", "t"), "b": F.greatest("h", "t")}).join(T.pair_counts(k), ["a", "b"]).join(b, ["a", "b"], "left")
    return m.select("h", "r", "t", "surplus", F.col("n").alias("pair_count"), F.col("_bridge").isNotNull().alias("bridge"), ((F.col("n") > 1) | F.col("_bridge").isNull()).alias("safe"))


R.add("safe_deletion_candidates", _safe_rows, f"""{_BR}, {ALLOC_SQL}, c AS (SELECT r, count(*) AS n FROM k GROUP BY r HAVING count(*) > 1), ov AS (SELECT relation, round(any_value(n) - sum(eta), 6) AS surplus FROM alloc JOIN c ON r = relation GROUP BY relation HAVING any_value(n) > sum(eta)),
pc AS (SELECT least(h, t) AS a, greatest(h, t) AS b, count(*) AS n FROM k GROUP BY 1, 2) SELECT h, r, t, surplus, n AS pair_count, br.a IS NOT NULL AS bridge, n > 1 OR br.a IS NULL AS safe FROM k JOIN ov ON relation = r JOIN pc ON pc.a = least(h, t) AND pc.b = greatest(h, t) LEFT JOIN br ON br.a = pc.a AND br.b = pc.b""")


def _surplus(s, d):
    return A.compare_relations(T.relation_counts(triples(s, d)), allocations(s, d)).where("surplus > 0").select("relation", "surplus")


R.add("safe_deletions", lambda s, d: B.safe_deletions(graph(s, d), _surplus(s, d), [F.col("h"), F.col("t")]))
R.add("prune_rounds", lambda s, d: B.prune(triples(s, d), allocations(s, d), None, None, [F.col("h"), F.col("t")]))


def _core(s, d):
    """A core graph of at most 2,000 triples, chosen one by one; the budget is the operator's."""
    c = cut(annotated(s, d))
    return B.greedy_core(c, allocations(s, d), 2000, 1, N.seeds(c, allocations(s, d), 20, 2, 10))


R.add("greedy_core", _core)
R.add("component_merges", lambda s, d: B.merge_components(triples(s, d), _scored_aux(s, d), "score"))


def _scored_aux(s, d):
    """Auxiliary triples with their best quality score."""
    t = table(s, d, "aux_edges").select("h", plain_id("r", "P").alias("r"), "t", F.when(~F.isnan("quality_score"), F.col("quality_score")).alias("q")).where("h IS NOT NULL AND r IS NOT NULL AND t IS NOT NULL")
    return t.groupBy("h", "r", "t").agg(F.max("q").alias("score"))


def _swaps(s, d):
    """Moves accepted from the best score down when no cut and no candidate triple may be used twice."""
    raw = table(s, d, "cut_moves").where("move_id IS NOT NULL AND cut_id IS NOT NULL").select("move_id", "cut_id", F.concat_ws("|", "candidate_h", plain_id("candidate_r", "P"), "candidate_t").alias("candidate"), F.when(~F.isnan("candidate_score"), F.col("candidate_score")).alias("score"), "recorded_at").distinct()
    now = U.latest(raw, ["move_id"], [F.col("recorded_at").desc_nulls_last(), F.col("score").desc_nulls_last()]).where("score IS NOT NULL")
    return B.greedy_matching(now.select("move_id", "cut_id", "candidate", "score"), "cut_id", "candidate", [F.col("score").desc(), F.col("move_id")])


R.add("swap_matching", _swaps)


def _grown(s, d):
    """Pool triples reached from the entities of the auxiliary graph, quota by relation, until no quota is open or nothing more is reached."""
    quota = allocations(s, d).groupBy("relation").agg(F.ceil(F.sum("eta")).cast("long").alias("quota"))
    return B.grow_connected(T.entities(triples(s, d, "aux_edges")), triples(s, d), quota)


R.add("grown_graph", _grown)
R.add("missing_relations", lambda s, d: B.first_of_missing(triples(s, d, "aux_edges"), triples(s, d), allocations(s, d), [F.col("h"), F.col("t")]).select("h", "r", "t"), f"""WITH {TRIPLES_SQL}, {AUX_SQL} SELECT h, r, t FROM k WHERE r IN (SELECT relation FROM allocations WHERE coalesce(CAST(eta_integer AS DOUBLE), eta_total, eta_expected) > 0) AND r NOT IN (SELECT r FROM aux) QUALIFY row_number() OVER (PARTITION BY r ORDER BY h, t) = 1""")

QUERIES, SQL = R.queries, R.sql
