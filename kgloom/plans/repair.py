"""Repair of the auxiliary graph out of the candidates, selections of components and relations, reports on both."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from kgloom.operators import allocate as A
from kgloom.operators import candidates as N
from kgloom.operators import graph as G
from kgloom.operators import hops as H
from kgloom.operators import matrix as M
from kgloom.operators import patterns as P
from kgloom.operators import repair as Z
from kgloom.operators import triples as T
from kgloom.plans.evidence import GEN_SQL as _GEN
from kgloom.plans.evidence import generic
from kgloom.plans.patterns import COMP_SQL as _COMP
from kgloom.plans.patterns import K
from kgloom.plans.registry import Registry, rounded
from kgloom.plans.structure import CC, cc_sql, parts
from kgloom.session import cut
from kgloom.sources.tables import ALLOC_SQL, AUX_SQL, PAIRS_SQL, POOL_SQL, PROFILE_SQL, TRIPLES_SQL, allocations, constraints, graph, pair_rows, table, triples

R = Registry()
_AUX = f"WITH RECURSIVE {TRIPLES_SQL}, {AUX_SQL}, {cc_sql('ca', 'aux')}, mc AS MATERIALIZED (SELECT label FROM ca GROUP BY label ORDER BY count(*) DESC, label LIMIT 1), mn AS MATERIALIZED (SELECT v FROM ca WHERE label IN (SELECT label FROM mc))"
_DG = "dg AS MATERIALIZED (SELECT v, count(*) AS degree FROM (SELECT h AS v FROM aux UNION ALL SELECT t FROM aux) GROUP BY v), an AS MATERIALIZED (SELECT label AS component, v AS node, degree, CAST(row_number() OVER (PARTITION BY label ORDER BY degree DESC, v) AS INTEGER) AS place FROM ca JOIN dg USING (v) QUALIFY place <= 3)"
_ST = "st AS MATERIALIZED (SELECT h AS v, t AS w, k.* FROM k WHERE h <> t UNION ALL SELECT t, h, k.* FROM k WHERE h <> t), fr AS MATERIALIZED (SELECT * FROM an WHERE component NOT IN (SELECT label FROM mc))"


def _aux(s, d):
    """(auxiliary graph, its members, nodes of its main component, anchors of the other components)."""
    a, m = parts(s, d, "aux_edges")
    big = cut(Z.main_component(m))
    main = cut(m.join(big, "component", "left_semi").select("node"))
    return a, m, main, Z.component_anchors(a, m, 3).join(big, "component", "left_anti")


R.add("component_anchors", lambda s, d: Z.component_anchors(*parts(s, d, "aux_edges"), 3), f"{_AUX}, {_DG} SELECT * FROM an")


def _one_step(s, d):
    """The first triple, by relation, head and tail, that joins each smaller part of the auxiliary graph to its main part."""
    _, _, main, anchors = _aux(s, d)
    return Z.best_bridge(Z.one_step_bridges(triples(s, d), anchors, main), [F.col("r"), F.col("h"), F.col("t"), F.col("anchor")])


R.add("bridges_one_step", _one_step, f"{_AUX}, {_DG}, {_ST} SELECT component, node AS anchor, h, r, t FROM st JOIN fr ON node = st.v WHERE w IN (SELECT v FROM mn) QUALIFY row_number() OVER (PARTITION BY component ORDER BY r, h, t, node) = 1")
_KEYS = ("r1", "r2", "h1", "t1", "h2", "t2", "anchor")


def _two_steps(s, d):
    """The same for pairs of triples by a middle entity outside of the main part."""
    _, _, main, anchors = _aux(s, d)
    return Z.best_bridge(Z.two_step_bridges(triples(s, d), anchors, main), [F.col(c) for c in _KEYS])


R.add("bridges_two_steps", _two_steps, f"""{_AUX}, {_DG}, {_ST} SELECT component, node AS anchor, a.w AS middle, a.h AS h1, a.r AS r1, a.t AS t1, b.h AS h2, b.r AS r2, b.t AS t2 FROM st a JOIN fr ON node = a.v JOIN st b ON b.v = a.w
WHERE a.w NOT IN (SELECT v FROM mn) AND b.w IN (SELECT v FROM mn) QUALIFY row_number() OVER (PARTITION BY component ORDER BY a.r, b.r, a.h, a.t, b.h, b.t, node) = 1""")


def _absent(s, d, a):
    """Allocated relations that the auxiliary graph lacks, with their budget."""
    eta = allocations(s, d).groupBy("relation").agg(F.sum("eta").alias("priority"))
    return eta.join(a.select(F.col("r").alias("relation")).distinct(), "relation", "left_anti")


def _absent_pairs(s, d):
    a, _, main, _ = _aux(s, d)
    return Z.absent_pairs(_absent(s, d, a), a, P.pair_confidence(pair_rows(s, d)), main)


_ABS = f"""{PAIRS_SQL}, {ALLOC_SQL}, ab AS MATERIALIZED (SELECT relation, sum(eta) AS priority FROM alloc WHERE relation NOT IN (SELECT r FROM aux) GROUP BY 1),
ad AS (SELECT DISTINCT r AS realised, t AS node, 'after' AS orientation FROM aux UNION ALL SELECT DISTINCT r, h, 'before' FROM aux), ag AS MATERIALIZED (SELECT realised, orientation, count(*) AS anchors, count(mn.v) / count(*) AS share FROM ad LEFT JOIN mn ON v = node GROUP BY 1, 2),
sp AS (SELECT r1 AS realised, r2 AS missing, 'after' AS orientation, total AS support FROM pairs WHERE total > 0 UNION ALL SELECT r2, r1, 'before', total FROM pairs WHERE total > 0),
ap AS MATERIALIZED (SELECT missing, realised, orientation, support, anchors, share, round(greatest(priority, 1e-12) * ln(1 + support) * ln(1 + anchors) * (1 + share), 6) AS score FROM sp JOIN ab ON relation = missing JOIN ag USING (realised, orientation))"""
R.add("absent_relation_pairs", lambda s, d: rounded(rounded(_absent_pairs(s, d), "share"), "score", digits=6), f"{_AUX}, {_ABS} SELECT * REPLACE (round(share, 9) AS share) FROM ap")


def _absent_contexts(s, d):
    """Per absent relation, realised relation and orientation: the candidate triples that would join on, and at how many entities."""
    a, _, main, _ = _aux(s, d)
    pairs = cut(Z.absent_pairs(_absent(s, d, a), a, P.pair_confidence(pair_rows(s, d)), main))
    c = Z.absent_contexts(pairs, a, triples(s, d))
    at = F.when(F.col("orientation") == "after", F.col("h")).otherwise(F.col("t"))
    return c.groupBy("missing", "realised", "orientation").agg(F.count(F.lit(1)).alias("triples"), F.count_distinct(at).alias("contexts"))


R.add("absent_relation_contexts", _absent_contexts, f"""{_AUX}, {_ABS}, hit AS (SELECT missing, realised, orientation, h, t, h AS e FROM ap JOIN k ON k.r = missing WHERE orientation = 'after' AND (realised, h) IN (SELECT (realised, node) FROM ad WHERE orientation = 'after')
  UNION ALL SELECT missing, realised, orientation, h, t, t FROM ap JOIN k ON k.r = missing WHERE orientation = 'before' AND (realised, t) IN (SELECT (realised, node) FROM ad WHERE orientation = 'before'))
SELECT missing, realised, orientation, count(*) AS triples, count(DISTINCT e) AS contexts FROM hit GROUP BY 1, 2, 3""")


def _filled(s, d):
    """Candidate triples of allocated relations that the auxiliary graph lacks, up to their budget, pass by pass."""
    a, _, main, _ = _aux(s, d)
    quota = allocations(s, d).groupBy("relation").agg(F.sum("eta").alias("quota"))
    return Z.fill_absent(a, triples(s, d), quota, P.pair_confidence(pair_rows(s, d)), main)


R.add("absent_relations_filled", _filled)
R.add("attach_capacity", lambda s, d: rounded(Z.attach_capacity(graph(s, d, "aux_edges"), triples(s, d)), "overlap"), f"""WITH {TRIPLES_SQL}, {AUX_SQL}, e AS MATERIALIZED (SELECT h AS v FROM aux UNION SELECT t FROM aux), n AS (SELECT r, (h IN (SELECT v FROM e)) AS hh, (t IN (SELECT v FROM e)) AS tt FROM (SELECT * FROM k EXCEPT SELECT * FROM aux))
SELECT r, count(*) AS n, count(*) FILTER (WHERE hh AND tt) AS "both", count(*) FILTER (WHERE hh AND NOT tt) AS by_head, count(*) FILTER (WHERE tt AND NOT hh) AS by_tail, round(count(*) FILTER (WHERE hh OR tt) / count(*), 9) AS overlap FROM n GROUP BY r""")


def _balanced(s, d):
    """Per pattern three relations out of the ten that overlap most with the auxiliary graph, of those with 20 attachable triples or more."""
    cap = Z.attach_capacity(graph(s, d, "aux_edges"), triples(s, d)).where("both + by_head + by_tail >= 20").select(F.col("r").alias("relation"), F.round("overlap", 9).alias("overlap"))
    scored = allocations(s, d).select("pattern", "relation").distinct().join(cap, "relation").select("pattern", "relation", "overlap")
    return Z.restricted_picks(scored, "pattern", [F.col("overlap").desc(), F.col("relation")], 10, 3, "7", "relation")


R.add("balanced_relation_sets", _balanced, f"""WITH {TRIPLES_SQL}, {AUX_SQL}, {ALLOC_SQL}, e AS MATERIALIZED (SELECT h AS v FROM aux UNION SELECT t FROM aux), n AS (SELECT r, (h IN (SELECT v FROM e)) OR (t IN (SELECT v FROM e)) AS x FROM (SELECT * FROM k EXCEPT SELECT * FROM aux)),
c AS (SELECT r, round(count(*) FILTER (WHERE x) / count(*), 9) AS overlap FROM n GROUP BY r HAVING count(*) FILTER (WHERE x) >= 20), b AS (SELECT pattern, relation, overlap FROM (SELECT DISTINCT pattern, relation FROM alloc) JOIN c ON r = relation QUALIFY row_number() OVER (PARTITION BY pattern ORDER BY overlap DESC, relation) <= 10)
SELECT *, CAST(row_number() OVER (PARTITION BY pattern ORDER BY md5(concat_ws('|', '7', pattern, relation)), relation) AS INTEGER) AS pick FROM b QUALIFY pick <= 3""")


def _classes(s, d):
    """Why allocated relations are absent from the auxiliary graph; types fail where no supported pair with a relation of the graph is compatible."""
    a = graph(s, d, "aux_edges")
    absent = cut(_absent(s, d, a).select("relation"))
    return Z.absent_classes(absent, triples(s, d), a, _chained(s, d, a))


def _chained(s, d, a):
    """Relations whose domain fits the range of a relation of ``a``, or whose range fits the domain of one; unknown types fit all."""
    c = constraints(s, d)
    own = c.join(a.select(F.col("r").alias("relation")).distinct(), "relation", "left_semi")
    # one row: the types of a bounded number of relations
    flat = lambda x: F.array_distinct(F.flatten(F.collect_list(x)))
    whole = own.agg(flat("subjects").alias("_s"), flat("objects").alias("_o"), F.bool_or(F.col("subjects").isNull()).alias("_ns"), F.bool_or(F.col("objects").isNull()).alias("_no"), F.count(F.lit(1)).alias("_n"))
    m = c.join(F.broadcast(whole), F.lit(True))
    follows = F.col("subjects").isNull() | F.col("_no") | F.arrays_overlap("subjects", "_o")
    leads = F.col("objects").isNull() | F.col("_ns") | F.arrays_overlap("objects", "_s")
    return m.where((F.col("_n") > 0) & (follows | leads)).select("relation")


_CHA = f"""{PROFILE_SQL}, ow AS (SELECT * FROM prof WHERE relation IN (SELECT r FROM aux)), chd AS (SELECT DISTINCT p.relation FROM prof p JOIN ow o ON p.subjects IS NULL OR o.objects IS NULL OR list_has_any(p.subjects, o.objects) OR p.objects IS NULL OR o.subjects IS NULL OR list_has_any(p.objects, o.subjects))"""
R.add("absent_relation_classes", _classes, f"""WITH {TRIPLES_SQL}, {AUX_SQL}, {ALLOC_SQL}, {_CHA}, e AS MATERIALIZED (SELECT h AS v FROM aux UNION SELECT t FROM aux), ab AS (SELECT DISTINCT relation FROM alloc WHERE relation NOT IN (SELECT r FROM aux)),
n AS (SELECT r, count(*) AS n, count(*) FILTER (WHERE h IN (SELECT v FROM e) OR t IN (SELECT v FROM e)) AS k FROM k GROUP BY r)
SELECT relation, coalesce(n, 0) AS candidates, coalesce(k, 0) AS touching, CASE WHEN coalesce(n, 0) = 0 THEN 'no_candidates' WHEN relation NOT IN (SELECT relation FROM chd) THEN 'types_fail' WHEN k = 0 THEN 'untouched' ELSE 'touching' END AS class FROM ab LEFT JOIN n ON r = relation""")
R.add("chained_targets", lambda s, d: constraints(s, d).where(~F.col("target").eqNullSafe(F.lit("NO_WAY"))).join(_chained(s, d, graph(s, d, "aux_edges")), "relation", "left_semi").select("relation"), f"WITH {AUX_SQL}, {_CHA} SELECT relation FROM prof WHERE target IS DISTINCT FROM 'NO_WAY' AND relation IN (SELECT relation FROM chd)")
_SAMPLE = """att AS MATERIALIZED (SELECT * FROM k WHERE h IN (SELECT v FROM e) OR t IN (SELECT v FROM e)), pl AS (SELECT h, r, t, CAST(row_number() OVER (PARTITION BY r ORDER BY md5(concat_ws('|', '7', h, r, t)), h, t) AS INTEGER) AS place FROM att)"""
_ENT = f"WITH {TRIPLES_SQL}, {AUX_SQL}, e AS MATERIALIZED (SELECT h AS v FROM aux UNION SELECT t FROM aux), {_SAMPLE}"
R.add("attached_sample", lambda s, d: Z.attached_sample(triples(s, d), T.entities(triples(s, d, "aux_edges")), 20, "7"), f"{_ENT} SELECT * FROM pl WHERE place <= 20")
R.add("attached_exactly", lambda s, d: Z.attached_sample(triples(s, d), T.entities(triples(s, d, "aux_edges")), 50, "7", exact=True), f"{_ENT} SELECT * FROM pl WHERE place <= 50 AND r IN (SELECT r FROM pl WHERE place = 50)")


def _growth(s, d):
    """Candidate triples that the parts of the auxiliary graph with fewer than five entities could grow by."""
    a, m = parts(s, d, "aux_edges")
    small = m.join(G.component_sizes(m).where("entities < 5").select("component"), "component", "left_semi").select("node")
    return Z.touching_parts(triples(s, d), a, small)


R.add("small_parts_growth", _growth, f"{_AUX}, sm AS MATERIALIZED (SELECT v FROM ca WHERE label IN (SELECT label FROM ca GROUP BY label HAVING count(*) < 5)) SELECT h, r, t FROM k WHERE (h IN (SELECT v FROM sm) OR t IN (SELECT v FROM sm)) AND (h, r, t) NOT IN (SELECT (h, r, t) FROM aux)")


def _scope(s, d):
    """Candidate relations by whether they have a budget, only a profile, or neither."""
    k = triples(s, d).groupBy(F.col("r").alias("relation")).agg(F.count(F.lit(1)).alias("n"))
    known = lambda df, c: df.select("relation", F.lit(True).alias(c)).distinct()
    m = k.join(known(allocations(s, d), "_a"), "relation", "left").join(known(constraints(s, d), "_p"), "relation", "left")
    return m.select("relation", "n", F.when(F.col("_a"), "in_core").when(F.col("_p"), "in_universe").otherwise("out_of_scope").alias("scope"))


R.add("relation_scope", _scope, f"WITH {TRIPLES_SQL}, {ALLOC_SQL} SELECT r AS relation, count(*) AS n, CASE WHEN r IN (SELECT relation FROM alloc) THEN 'in_core' WHEN r IN (SELECT property_id FROM relation_profiles) THEN 'in_universe' ELSE 'out_of_scope' END AS scope FROM k GROUP BY r")
R.add("fetch_limits", lambda s, d: generic(s, d).join(allocations(s, d).groupBy("relation").agg(F.floor(F.sum("eta")).cast("long").alias("target")), "relation").select("relation", "target", N.fetch_limit(F.col("target"), F.col("genericity_bucket")).alias("fetch")), f"""WITH {_GEN} SELECT relation, CAST(floor(eta) AS BIGINT) AS target, CAST(least(20000, greatest(100, floor(eta) * CASE WHEN genericity_bucket = 'high' THEN 6 ELSE 3 END)) AS BIGINT) AS fetch FROM gen JOIN rel USING (relation)""")
R.add("weights_dense", lambda s, d: M.dense(M.adjacency(P.pair_confidence(pair_rows(s, d)), 3), allocations(s, d).select("relation"), 0.5, 1.0), f"WITH {PAIRS_SQL}, {ALLOC_SQL}, n AS (SELECT DISTINCT relation FROM alloc) SELECT a.relation AS \"row\", b.relation AS col, greatest(coalesce(CASE WHEN total >= 3 THEN total END, 0.5), 1.0) AS value FROM n a, n b LEFT JOIN pairs ON r1 = a.relation AND r2 = b.relation".replace("greatest(coalesce(CASE WHEN total >= 3 THEN total END, 0.5), 1.0)", "CAST(greatest(coalesce(CASE WHEN total >= 3 THEN CAST(total AS DOUBLE) END, 0.5), 1.0) AS DOUBLE)"))


# components
def _selected(s, d):
    """Triples of the components with 5 nodes and 5 triples or more, the largest component left out, at most the 50 largest of them."""
    k, m = parts(s, d)
    return G.select_components(k, m, 5, 5, without_largest=True, at_most=50)


_CS = "q AS MATERIALIZED (SELECT k.*, label FROM k JOIN cc ON v = h), cs AS MATERIALIZED (SELECT label, n, t, row_number() OVER (ORDER BY n DESC, t DESC, label) AS place FROM (SELECT label, count(*) AS n FROM cc GROUP BY 1) JOIN (SELECT label, count(*) AS t FROM q GROUP BY 1) USING (label))"
R.add("components_selected", _selected, f"{CC}, {_CS} SELECT h, r, t FROM q WHERE label IN (SELECT label FROM cs WHERE place > 1 AND n >= 5 AND t >= 5 ORDER BY place LIMIT 50)")
R.add("component_second", lambda s, d: G.component_of_rank(*parts(s, d), 2), f"{CC}, {_CS} SELECT h, r, t FROM q WHERE label IN (SELECT label FROM cs WHERE place = 2)")
R.add("component_top_relations", lambda s, d: G.component_top_relations(*parts(s, d), 10), f"{CC} SELECT label AS component, r, count(*) AS n, CAST(row_number() OVER (PARTITION BY label ORDER BY count(*) DESC, r) AS INTEGER) AS place FROM k JOIN cc ON v = h GROUP BY 1, 2 QUALIFY place <= 10")
_PE = "pe AS (SELECT r1 AS h, r2 AS t FROM pairs WHERE total >= 3)"


def _relation_components(s, d):
    """Components of the graph of relations that follow one another with support 3 or more."""
    e = P.pair_confidence(pair_rows(s, d)).where("total >= 3").select(F.col("r1").alias("h"), F.col("r2").alias("t"))
    return G.components(G.simple_edges(e), T.entities(e))


R.add("relation_components", _relation_components, f"WITH RECURSIVE {PAIRS_SQL}, {_PE}, {cc_sql('rc', 'pe')} SELECT v AS node, label AS component FROM rc")


def _relation_index(s, d):
    """Per relation: triples, subjects, objects, unordered pairs, and the share of its subjects in the largest component."""
    k, m = parts(s, d)
    main = m.join(Z.main_component(m), "component", "left_semi").select(F.col("node").alias("h"), F.lit(1).alias("_m"))
    heads = k.groupBy("r", "h").agg(F.count(F.lit(1)).alias("_n")).join(main, "h", "left").groupBy("r").agg(F.sum("_n").alias("n"), F.count(F.lit(1)).alias("subjects"), (F.count("_m") / F.count(F.lit(1))).alias("main_share"))
    tails = k.select("r", "t").distinct().groupBy("r").agg(F.count(F.lit(1)).alias("objects"))
    both = k.select("r", F.least("h", "t").alias("a"), F.greatest("h", "t").alias("b")).distinct().groupBy("r").agg(F.count(F.lit(1)).alias("pairs"))
    return heads.join(tails, "r").join(both, "r").select("r", "n", "subjects", "objects", "pairs", F.round("main_share", 9).alias("main_share"))


R.add("relation_index", _relation_index, f"""{CC}, mc AS (SELECT label FROM cc GROUP BY label ORDER BY count(*) DESC, label LIMIT 1), mn AS MATERIALIZED (SELECT v FROM cc WHERE label IN (SELECT label FROM mc))
SELECT r, count(*) AS n, count(DISTINCT h) AS subjects, count(DISTINCT t) AS objects, count(DISTINCT (least(h, t), greatest(h, t))) AS pairs, round(count(DISTINCT CASE WHEN h IN (SELECT v FROM mn) THEN h END) / count(DISTINCT h), 9) AS main_share FROM k GROUP BY r""")


# reports on allocation
def _final_audit(s, d):
    """Per allocated relation: budget, candidates, triples in the pool and in the auxiliary graph, and why it is missing."""
    eta = allocations(s, d).groupBy("relation").agg(F.round(F.sum("eta"), 6).alias("eta"))
    n = lambda name, c: T.relation_counts(triples(s, d, name)).select(F.col("r").alias("relation"), F.col("n").alias(c))
    m = eta.join(n("candidates", "candidates"), "relation", "left").join(n("pool_records", "pool"), "relation", "left").join(n("aux_edges", "auxiliary"), "relation", "left").na.fill(0, ["candidates", "pool", "auxiliary"])
    realised = (F.col("pool") > 0) | (F.col("auxiliary") > 0)
    return m.withColumns({"realised": realised, "reason": F.when(F.col("candidates") == 0, "NO_CANDIDATES").when(~realised, "NOT_SELECTED").otherwise("")})


R.add("final_audit", _final_audit, f"""WITH {TRIPLES_SQL}, {POOL_SQL}, {AUX_SQL}, {ALLOC_SQL}, x AS (SELECT relation, round(sum(eta), 6) AS eta, coalesce(any_value(a.n), 0) AS candidates, coalesce(any_value(b.n), 0) AS pool, coalesce(any_value(c.n), 0) AS auxiliary FROM alloc
LEFT JOIN (SELECT r, count(*) AS n FROM k GROUP BY r) a ON a.r = relation LEFT JOIN (SELECT r, count(*) AS n FROM pool GROUP BY r) b ON b.r = relation LEFT JOIN (SELECT r, count(*) AS n FROM aux GROUP BY r) c ON c.r = relation GROUP BY relation)
SELECT *, pool > 0 OR auxiliary > 0 AS realised, CASE WHEN candidates = 0 THEN 'NO_CANDIDATES' WHEN pool = 0 AND auxiliary = 0 THEN 'NOT_SELECTED' ELSE '' END AS reason FROM x""")
R.add("allocation_index", lambda s, d: A.allocation_index(table(s, d, "allocations")), """SELECT relation, sum(eta_integer)::BIGINT AS eta_sum, max(eta_integer) AS eta_max, string_agg(p, '|' ORDER BY p) AS by_pattern, max(f) AS forward_max, max(b) AS backward_max, count(*) AS patterns FROM
(SELECT relation, sum(eta_integer) AS eta_integer, pattern || '=' || coalesce(CAST(CAST(sum(eta_integer) AS BIGINT) AS VARCHAR), '') AS p, round(max(forward_score), 6) AS f, round(max(backward_score), 6) AS b FROM allocations GROUP BY relation, pattern) GROUP BY relation""".replace("sum(eta_integer)::BIGINT AS eta_sum, max(eta_integer) AS eta_max", "CAST(sum(eta_integer) AS BIGINT) AS eta_sum, CAST(max(eta_integer) AS BIGINT) AS eta_max"))
R.add("pattern_share_equal", lambda s, d: rounded(A.by_equal_share(T.relation_counts(triples(s, d)), allocations(s, d)), "observed", digits=6), f"""WITH {TRIPLES_SQL}, {ALLOC_SQL}, a AS (SELECT DISTINCT pattern, relation FROM alloc), c AS (SELECT r, count(*) AS n FROM k GROUP BY r)
SELECT pattern, round(sum(n / m), 6) AS observed FROM (SELECT *, count(*) OVER (PARTITION BY relation) AS m FROM a) JOIN c ON r = relation GROUP BY pattern""")


def _pool_status(s, d):
    """Pool triples by how far the candidate graph has filled their relation's budget, and by how many of their ends it knows."""
    k = graph(s, d)
    cmp = A.compare_relations(T.relation_counts(k), allocations(s, d)).select(F.col("relation").alias("r"), F.col("observed").alias("_o"), F.round("expected", 6).alias("_e"))
    e = lambda c: T.entities(k).select(F.col("entity").alias(c), F.lit(1).alias(f"_{c}"))
    m = triples(s, d, "pool_records").join(cmp, "r", "left").join(e("h"), "h", "left").join(e("t"), "t", "left")
    status = F.when(F.col("_e").isNull(), "unallocated").when(F.col("_o") < F.col("_e"), "underfilled").when(F.col("_o") == F.col("_e"), "near_target").otherwise("overfilled")
    ends = F.coalesce("_h", F.lit(0)) + F.coalesce("_t", F.lit(0))
    return m.groupBy(status.alias("relation_status"), F.when(ends == 2, "both").when(ends == 1, "one").otherwise("none").alias("overlap")).agg(F.count(F.lit(1)).alias("n"))


R.add("pool_status", _pool_status, f"""WITH {TRIPLES_SQL}, {POOL_SQL}, {ALLOC_SQL}, c AS (SELECT relation, round(sum(eta), 6) AS e FROM alloc GROUP BY 1), o AS (SELECT r, count(*) AS n FROM k GROUP BY r), v AS MATERIALIZED (SELECT h AS v FROM k UNION SELECT t FROM k),
x AS (SELECT CASE WHEN e IS NULL THEN 'unallocated' WHEN coalesce(n, 0) < e THEN 'underfilled' WHEN coalesce(n, 0) = e THEN 'near_target' ELSE 'overfilled' END AS relation_status, (h IN (SELECT v FROM v))::INT + (t IN (SELECT v FROM v))::INT AS ends FROM pool LEFT JOIN c ON relation = pool.r LEFT JOIN o ON o.r = pool.r)
SELECT relation_status, CASE ends WHEN 2 THEN 'both' WHEN 1 THEN 'one' ELSE 'none' END AS overlap, count(*) AS n FROM x GROUP BY 1, 2""")


def _top_entities(s, d):
    """The ten entities that each relation's distinct candidate triples name most often, ties by name."""
    f = triples(s, d).select("r", F.explode(F.array("h", "t")).alias("entity")).groupBy("r", "entity").agg(F.count(F.lit(1)).alias("n"))
    return f.withColumn("place", F.row_number().over(Window.partitionBy("r").orderBy(F.col("n").desc(), "entity"))).where("place <= 10")


R.add("candidate_top_entities", _top_entities, f"{K} SELECT r, entity, count(*) AS n, CAST(row_number() OVER (PARTITION BY r ORDER BY count(*) DESC, entity) AS INTEGER) AS place FROM (SELECT r, h AS entity FROM k UNION ALL SELECT r, t FROM k) GROUP BY 1, 2 QUALIFY place <= 10")


def _best_run(s, d):
    """The sweep run, as last reported, of least deficit, then surplus, then auxiliary edges."""
    last = table(s, d, "cap_sweep").where("run_id IS NOT NULL").groupBy("run_id").agg(F.max(F.struct("reported_at", "canonical_deficit_delta", "canonical_surplus_delta", "auxiliary_edges_selected")).alias("x")).select("run_id", "x.*")
    return last.orderBy(F.col("canonical_deficit_delta").asc_nulls_last(), F.col("canonical_surplus_delta").asc_nulls_last(), F.col("auxiliary_edges_selected").asc_nulls_last(), "run_id").limit(1).drop("reported_at")


R.add("sweep_best_run", _best_run, """WITH l AS (SELECT * FROM cap_sweep WHERE run_id IS NOT NULL QUALIFY row_number() OVER (PARTITION BY run_id ORDER BY reported_at DESC NULLS LAST, canonical_deficit_delta DESC NULLS LAST, canonical_surplus_delta DESC NULLS LAST, auxiliary_edges_selected DESC NULLS LAST) = 1)
SELECT run_id, canonical_deficit_delta, canonical_surplus_delta, auxiliary_edges_selected FROM l ORDER BY canonical_deficit_delta NULLS LAST, canonical_surplus_delta NULLS LAST, auxiliary_edges_selected NULLS LAST, run_id LIMIT 1""")
_RULE = "examined >= 2 AND shortcuts >= 2 AND confidence >= 0.2"


def _composed(s, d):
    """Triples that well-founded compositions imply and the candidate graph lacks, each with the number of rules that imply it."""
    k = graph(s, d)
    rules = cut(H.composition(k).where(_RULE).select("r1", "r2", "r3"))
    return H.composed(k, rules).join(k.select("h", "r", "t"), ["h", "r", "t"], "left_anti")


R.add("composition_completion", _composed, f"""{K}, {_COMP}, ru AS (SELECT r1, r2, r3 FROM comp WHERE {_RULE}), im AS (SELECT DISTINCT x AS h, r3 AS r, z AS t, r1, r2 FROM ru JOIN ch USING (r1, r2))
SELECT h, r, t, count(*) AS rules FROM im WHERE (h, r, t) NOT IN (SELECT (h, r, t) FROM k) GROUP BY 1, 2, 3""")


def _sampled_followers(s, d):
    """The ten relations that follow each relation most often from a sample of 200 of its middle entities, drawn by a seeded hash."""
    return H.top_followers(H.sampled_support(graph(s, d), 200, "7"), "support", 10)


R.add("hop_top_sampled", _sampled_followers, f"""{K}, m AS (SELECT DISTINCT r AS r1, t AS y FROM k QUALIFY dense_rank() OVER (PARTITION BY r ORDER BY md5(concat_ws('|', '7', r, t)), t) <= 200), x AS (SELECT r1, r AS r2, count(DISTINCT y) AS support FROM m JOIN k ON h = y GROUP BY 1, 2)
SELECT r1, r2, support, CAST(row_number() OVER (PARTITION BY r1 ORDER BY support DESC, r2) AS INTEGER) AS place FROM x QUALIFY place <= 10""")

QUERIES, SQL = R.queries, R.sql
