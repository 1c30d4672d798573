"""Evaluation report, checks, bridge cuts and scored removal over the candidate graph."""

from __future__ import annotations

from pyspark.sql import functions as F

from kgloom.operators import allocate as A
from kgloom.operators import cuts as C
from kgloom.operators import evaluate as E
from kgloom.operators import graph as G
from kgloom.operators import removal as Y
from kgloom.operators import triples as T
from kgloom.plans.evidence import symmetric
from kgloom.plans.registry import Registry
from kgloom.plans.structure import CC, bridge_sql
from kgloom.session import cut
from kgloom.sources.tables import ALLOC_SQL, AUX_SQL, TRIPLES_SQL, allocations, graph, raw_triples, triples

R = Registry()


def _report(s, d):
    """Named figures of the candidate graph and of its balance."""
    return E.report(raw_triples(s, d), graph(s, d), allocations(s, d))


_SUMS = "count(*) AS relations, count(*) FILTER (WHERE n > 0) AS observed_relations, count(*) FILTER (WHERE n = 0) AS zero_relations, sum(e) AS total_expected, sum(n) AS total_observed, sum(greatest(e - n, 0)) AS total_deficit, sum(greatest(n - e, 0)) AS total_surplus"
_UNPIVOT = "SELECT '{0}' AS section, metric, round(value, 6) AS value FROM (UNPIVOT (SELECT {1} FROM {2}) ON COLUMNS(*) INTO NAME metric VALUE value)"


def _cells(section: str, names: str, source: str) -> str:
    return _UNPIVOT.format(section, ", ".join(f"CAST({n} AS DOUBLE) AS {n}" for n in names.split()), source)


_REP = f"""{CC}, {ALLOC_SQL}, c AS (SELECT r, count(*) AS n FROM k GROUP BY r), rw AS (SELECT count(*) AS raw_rows FROM raw), en AS (SELECT count(*) AS entities FROM cc), tr AS (SELECT count(*) AS triples, count(DISTINCT r) AS relations FROM k),
g AS (SELECT raw_rows, triples, raw_rows - triples AS duplicate_rows, entities, relations, triples / entities AS triples_per_entity FROM rw, en, tr), cs AS (SELECT count(*) AS components, max(n) AS largest, max(n) / sum(n) AS largest_share FROM (SELECT count(*) AS n FROM cc GROUP BY label)),
sd AS (SELECT v AS entity, sum(CASE WHEN v = w THEN 2 ELSE 1 END) AS degree FROM (SELECT h AS v, t AS w FROM k UNION SELECT t, h FROM k) GROUP BY v), sp AS (SELECT sum(degree * (degree - 1) // 2) AS two_paths, count(*) FILTER (WHERE degree <= 1) AS low_degree_entities FROM sd),
al AS (SELECT {_SUMS} FROM (SELECT relation, sum(eta) AS e, coalesce(any_value(n), 0) AS n FROM alloc LEFT JOIN c ON r = relation GROUP BY relation)),
po AS (SELECT pattern, sum(round_even(round(part, 9), 0)) AS o FROM (SELECT pattern, n * (eta / sum(eta) OVER (PARTITION BY relation)) AS part FROM alloc JOIN c ON r = relation) GROUP BY 1), pe AS (SELECT pattern, sum(eta) AS e FROM alloc GROUP BY 1),
pp AS (SELECT 'pattern:' || pattern AS section, e AS expected, coalesce(o, 0) AS observed, greatest(e - coalesce(o, 0), 0) AS deficit, greatest(coalesce(o, 0) - e, 0) AS surplus FROM pe LEFT JOIN po USING (pattern)),
rep AS ({_cells("graph", "raw_rows triples duplicate_rows entities relations triples_per_entity", "g")} UNION ALL {_cells("connectivity", "components largest largest_share", "cs")} UNION ALL {_cells("structure", "two_paths low_degree_entities", "sp")}
UNION ALL {_cells("allocation", "relations observed_relations zero_relations total_expected total_observed total_deficit total_surplus", "al")}
UNION ALL SELECT section, metric, round(value, 6) FROM (UNPIVOT (SELECT section, CAST(expected AS DOUBLE) AS expected, CAST(observed AS DOUBLE) AS observed, CAST(deficit AS DOUBLE) AS deficit, CAST(surplus AS DOUBLE) AS surplus FROM pp) ON expected, observed, deficit, surplus INTO NAME metric VALUE value))"""
R.add("evaluation_report", _report, f"{_REP} SELECT * FROM rep")
BOUNDS = {("connectivity", "components"): ("=", 1), ("connectivity", "largest_share"): (">=", 0.9), ("allocation", "zero_relations"): ("=", 0), ("graph", "duplicate_rows"): ("=", 0), ("allocation", "total_deficit"): ("<=", 2000), ("allocation", "total_surplus"): ("<=", 6500), ("graph", "triples_per_entity"): (">=", 1)}
_BSQL = ", ".join(f"('{s}', '{m}', '{r}', CAST({b} AS DOUBLE))" for (s, m), (r, b) in BOUNDS.items())
R.add("constraint_checks", lambda s, d: E.checks(_report(s, d), BOUNDS), f"""{_REP}, b(section, metric, rule, bound) AS (VALUES {_BSQL}) SELECT section, metric, rule, bound, value AS actual,
coalesce(CASE rule WHEN '=' THEN abs(value - bound) < 1e-9 WHEN '<=' THEN value <= bound ELSE value >= bound END, false) AS passed FROM b LEFT JOIN rep USING (section, metric)""")


def _edges(s, d):
    k = graph(s, d)
    return k, cut(G.simple_edges(k))


def _overfilled_bridges(k, edges, s, d):
    """Bridges that a single triple of an overfilled relation makes."""
    over = A.compare_relations(T.relation_counts(k), allocations(s, d)).where("surplus > 0").select(F.col("relation").alias("r"))
    alone = T.pair_counts(k).where("n = 1 AND a <> b").select("a", "b")
    return k.join(over, "r", "left_semi").select(F.least("h", "t").alias("a"), F.greatest("h", "t").alias("b")).join(alone, ["a", "b"], "left_semi").distinct()


def _sides(s, d):
    """The smaller side, node by node, of every bridge that a single triple of an overfilled relation makes."""
    k, e = _edges(s, d)
    cuts, walk = C.bridge_cuts(e)
    return C.side_members(cuts.join(_overfilled_bridges(k, e, s, d), ["a", "b"], "left_semi"), walk)


def _crossing(s, d):
    """Auxiliary triples that the candidate graph lacks, with the bridges of overfilled relations that they would make up for."""
    k, e = _edges(s, d)
    new = triples(s, d, "aux_edges").join(k, ["h", "r", "t"], "left_anti")
    return C.crossing(cut(new), e, cut(_overfilled_bridges(k, e, s, d)))


R.add("bridge_sides", _sides)
R.add("cut_crossing", _crossing, f"""{CC}, {AUX_SQL}, {ALLOC_SQL}, {bridge_sql('k', 'cc')}, ov AS (SELECT relation FROM (SELECT relation, sum(eta) AS e FROM alloc GROUP BY 1) JOIN (SELECT r, count(*) AS n FROM k GROUP BY r) ON r = relation WHERE n > e),
te AS MATERIALIZED (SELECT least(h, t) AS a, greatest(h, t) AS b FROM k GROUP BY 1, 2 HAVING count(*) = 1 AND any_value(r) IN (SELECT relation FROM ov)), nw AS MATERIALIZED (SELECT * FROM aux EXCEPT SELECT * FROM k),
cm(h, t, u, w) AS (SELECT DISTINCT h, t, h, t FROM nw JOIN cc x ON x.v = h JOIN cc y ON y.v = t AND x.label = y.label WHERE h <> t UNION SELECT h, t, CASE WHEN p.dist >= q.dist THEN p.up ELSE u END, CASE WHEN p.dist >= q.dist THEN w ELSE q.up END FROM cm JOIN tp p ON p.v = u JOIN tp q ON q.v = w WHERE u <> w),
wy AS (SELECT DISTINCT h, t, CASE WHEN p.dist >= q.dist THEN u ELSE w END AS v, CASE WHEN p.dist >= q.dist THEN p.up ELSE q.up END AS up FROM cm JOIN tp p ON p.v = u JOIN tp q ON q.v = w WHERE u <> w)
SELECT nw.h, nw.r, nw.t, br.a, br.b FROM nw JOIN wy USING (h, t) JOIN br ON br.a = least(v, up) AND br.b = greatest(v, up) WHERE (br.a, br.b) IN (SELECT (a, b) FROM te)""")
R.add("bridge_tree", lambda s, d: C.bridge_tree(_edges(s, d)[1])[1])
R.add("strong_components", lambda s, d: C.strong_components(graph(s, d)))
R.add("removal_scores", lambda s, d: Y.removal_scores(graph(s, d), allocations(s, d)))
R.add("removal_projection", lambda s, d: Y.projected(graph(s, d)).withColumn("triples_per_entity", F.round("triples_per_entity", 9)), f"""WITH {TRIPLES_SQL}, pc AS (SELECT least(h, t) AS a, greatest(h, t) AS b, count(*) AS n FROM k GROUP BY 1, 2), sd AS MATERIALIZED (SELECT v, sum(CASE WHEN v = w THEN 2 ELSE 1 END) AS d FROM (SELECT h AS v, t AS w FROM k UNION SELECT t, h FROM k) GROUP BY v),
x AS (SELECT k.*, n <= 1 AS lost, p.d AS dh, q.d AS dt FROM k JOIN pc ON a = least(h, t) AND b = greatest(h, t) JOIN sd p ON p.v = h JOIN sd q ON q.v = t)
SELECT h, r, t, round(((SELECT count(*) FROM k) - 1) / ((SELECT count(*) FROM sd) - CASE WHEN lost THEN (dh <= 1)::INT + (dt <= 1 AND h <> t)::INT ELSE 0 END), 9) AS triples_per_entity, CASE WHEN lost THEN (dh = 3)::INT + (dt = 3 AND h <> t)::INT ELSE 0 END AS low_degree_made,
CAST(CASE WHEN lost THEN greatest(dh - 1, 0) + greatest(dt - 1, 0) ELSE 0 END AS INTEGER) AS two_paths_lost FROM x""")
R.add("prune_scored", lambda s, d: Y.prune_scored(graph(s, d), allocations(s, d)))


def _verified(s, d):
    """What may be deleted once the graph is completed by symmetry: nothing that a completed triple rests on."""
    k = graph(s, d)
    made = cut(symmetric(s, d, k).select("h", "r", "t"))
    rests = made.select(F.col("t").alias("h"), "r", F.col("h").alias("t"))
    return Y.verified_deletions(cut(k.unionByName(made)), rests, allocations(s, d))


R.add("verified_deletions", _verified)

QUERIES, SQL = R.queries, R.sql
