"""Pattern evidence, matrices, allocation and balance over ``hop_support``, ``allocations`` and the candidate graph."""

from __future__ import annotations

from pyspark.sql import functions as F

from kgloom.operators import allocate as A
from kgloom.operators import hops as H
from kgloom.operators import matrix as M
from kgloom.operators import patterns as P
from kgloom.operators import triples as T
from kgloom.plans.registry import Registry, rounded
from kgloom.sources.tables import ALLOC_SQL, PAIRS_SQL, TRIPLES_SQL, allocations, graph, pair_rows, triples

R = Registry()
Q = f"WITH {PAIRS_SQL}"


def pairs(s, d):
    return P.pair_confidence(pair_rows(s, d))


CONF = "round(conf_loop, 9) AS conf_loop, round(conf_nonloop, 9) AS conf_nonloop"
R.add("pair_confidence", lambda s, d: rounded(pairs(s, d), "conf_loop", "conf_nonloop"), f"{Q} SELECT r1, r2, loop, nonloop, total, {CONF} FROM pairs")
R.add("pair_universe", lambda s, d: rounded(P.within(pairs(s, d), 5, 1000), "conf_loop", "conf_nonloop"), f"{Q} SELECT r1, r2, loop, nonloop, total, {CONF} FROM pairs WHERE total BETWEEN 5 AND 1000")
R.add("pair_focus", lambda s, d: rounded(P.within(pairs(s, d), 1, 10**9, "P17"), "conf_loop", "conf_nonloop"), f"{Q} SELECT r1, r2, loop, nonloop, total, {CONF} FROM pairs WHERE total BETWEEN 1 AND 1000000000 AND 'P17' IN (r1, r2)")
R.add("symmetric_sel", lambda s, d: rounded(P.self_pairs(pairs(s, d), "conf_loop", 1, 0.2), "conf_loop", "conf_nonloop"), f"{Q} SELECT r1, r2, loop, nonloop, total, {CONF} FROM pairs WHERE r1 = r2 AND total >= 1 AND conf_loop >= 0.2")
R.add("antisymmetric_sel", lambda s, d: rounded(P.self_pairs(pairs(s, d), "conf_nonloop", 1, 0.8), "conf_loop", "conf_nonloop"), f"{Q} SELECT r1, r2, loop, nonloop, total, {CONF} FROM pairs WHERE r1 = r2 AND total >= 1 AND conf_nonloop >= 0.8")
_INV = """inv AS (SELECT a.r1, a.r2, a.loop, a.nonloop, a.total, a.conf_loop, coalesce(b.conf_loop, 0) AS reverse_conf_loop, coalesce(b.total, 0) AS reverse_total FROM pairs a LEFT JOIN pairs b ON a.r1 = b.r2 AND a.r2 = b.r1 WHERE a.r1 <> a.r2)"""
_INVC = "r1, r2, loop, nonloop, total, round(conf_loop, 9) AS conf_loop, round(reverse_conf_loop, 9) AS reverse_conf_loop, reverse_total, round(least(conf_loop, reverse_conf_loop), 9) AS conf_min, round((conf_loop + reverse_conf_loop) / 2, 9) AS conf_mean"
_IC = ("conf_loop", "reverse_conf_loop", "conf_min", "conf_mean")
R.add("inverse_table", lambda s, d: rounded(P.inverse_table(pairs(s, d)), *_IC), f"{Q}, {_INV} SELECT {_INVC} FROM inv")
R.add("inverse_sel", lambda s, d: rounded(P.inverse_pairs(pairs(s, d), 1, 0.01), *_IC), f"{Q}, {_INV} SELECT {_INVC}, least(total, reverse_total) AS support_min FROM inv WHERE least(total, reverse_total) >= 1 AND least(conf_loop, reverse_conf_loop) >= 0.01")
R.add("status_counts", lambda s, d: _status(s, d), """SELECT coalesce(upper(trim(status)), 'NO_STATUS') AS status, count(*) AS n FROM (SELECT DISTINCT support_id, status FROM hop_support) GROUP BY 1""")


def _status(s, d):
    t = s.read.parquet(f"{d}/hop_support.parquet").select("support_id", "status").distinct()
    return t.groupBy(F.coalesce(F.upper(F.trim("status")), F.lit("NO_STATUS")).alias("status")).agg(F.count(F.lit(1)).alias("n"))


# compositions in the candidate graph
K = f"WITH {TRIPLES_SQL}"
COMP_SQL = """ch AS MATERIALIZED (SELECT DISTINCT a.r AS r1, b.r AS r2, a.h AS x, b.t AS z FROM k a JOIN k b ON a.t = b.h),
ex AS (SELECT r1, r2, count(*) AS examined FROM ch GROUP BY 1, 2),
comp AS MATERIALIZED (SELECT s.r1, s.r2, s.r3, examined, shortcuts, examined - shortcuts AS missing, shortcuts / examined AS confidence FROM
  (SELECT r1, r2, k.r AS r3, count(*) AS shortcuts FROM ch JOIN k ON k.h = x AND k.t = z GROUP BY 1, 2, 3) s JOIN ex USING (r1, r2))"""
R.add("composition_evidence", lambda s, d: rounded(H.composition(graph(s, d)), "confidence"), f"{K}, {COMP_SQL} SELECT r1, r2, r3, examined, shortcuts, missing, round(confidence, 9) AS confidence FROM comp")
_W = """w AS (SELECT *, greatest(0, (confidence + 1.96*1.96/(2*examined)) / (1 + 1.96*1.96/examined) - 1.96/(1 + 1.96*1.96/examined) * sqrt(confidence*(1-confidence)/examined + 1.96*1.96/(4*examined*examined))) AS lo,
  least(1, (confidence + 1.96*1.96/(2*examined)) / (1 + 1.96*1.96/examined) + 1.96/(1 + 1.96*1.96/examined) * sqrt(confidence*(1-confidence)/examined + 1.96*1.96/(4*examined*examined))) AS hi FROM comp WHERE examined >= 2 AND shortcuts >= 1 AND confidence >= 0.05),
a AS MATERIALIZED (SELECT * FROM w WHERE lo >= 0.05)
SELECT r1, r2, r3, examined, shortcuts, missing, round(confidence, 9) AS confidence, round(lo, 9) AS wilson_low, round(hi, 9) AS wilson_high, (r2, r1, r3) IN (SELECT (r1, r2, r3) FROM a) AS swapped_too,
  CASE WHEN r1 = r2 AND r2 = r3 THEN 'transitive_self_composition' WHEN (r2, r1, r3) IN (SELECT (r1, r2, r3) FROM a) THEN 'non_transitive_commutative_composition' ELSE 'non_transitive_non_commutative_composition' END AS composition_class FROM a"""
R.add("composition_filter_wilson", lambda s, d: rounded(P.filter_compositions(H.composition(graph(s, d)), 2, 1, 0.05, by_bound=True), "confidence", "wilson_low", "wilson_high"), f"{K}, {COMP_SQL}, {_W}")


def _examples(s, d):
    """Up to three witness pairs of every composition, smallest first."""
    from pyspark.sql import Window

    short = H.shortcuts(graph(s, d)).groupBy("r1", "r2", "r3", "x", "z").agg(F.min("y").alias("witness"))
    w = Window.partitionBy("r1", "r2", "r3").orderBy("x", "z")
    return short.withColumn("place", F.row_number().over(w)).where("place <= 3")


R.add("composition_examples", _examples, f"""{K} SELECT a.r AS r1, b.r AS r2, c.r AS r3, a.h AS x, b.t AS z, min(a.t) AS witness, CAST(row_number() OVER (PARTITION BY a.r, b.r, c.r ORDER BY a.h, b.t) AS INTEGER) AS place
FROM k a JOIN k b ON a.t = b.h JOIN k c ON c.h = a.h AND c.t = b.t GROUP BY 1, 2, 3, 4, 5 QUALIFY place <= 3""")


def groups(s, d):
    p = pairs(s, d)
    comp = P.filter_compositions(H.composition(graph(s, d)), 2, 1, 0.05, by_bound=True)
    return P.pattern_groups(P.self_pairs(p, "conf_loop", 1, 0.2), P.self_pairs(p, "conf_nonloop", 1, 0.8), P.inverse_pairs(p, 1, 0.01), comp)


_G = f"""{PAIRS_SQL}, {_INV}, {TRIPLES_SQL}, {COMP_SQL}, acc AS (SELECT * FROM comp WHERE examined >= 2 AND shortcuts >= 1 AND confidence >= 0.05 AND
  greatest(0, (confidence + 1.96*1.96/(2*examined)) / (1 + 1.96*1.96/examined) - 1.96/(1 + 1.96*1.96/examined) * sqrt(confidence*(1-confidence)/examined + 1.96*1.96/(4*examined*examined))) >= 0.05),
sy AS (SELECT r1 FROM pairs WHERE r1 = r2 AND total >= 1 AND conf_loop >= 0.2), iv AS (SELECT * FROM inv WHERE least(total, reverse_total) >= 1 AND least(conf_loop, reverse_conf_loop) >= 0.01),
grp AS MATERIALIZED (SELECT 'symmetric' AS pattern, r1 AS relation FROM sy UNION SELECT 'anti_symmetric', r1 FROM pairs WHERE r1 = r2 AND total >= 1 AND conf_nonloop >= 0.8 AND r1 NOT IN (SELECT r1 FROM sy)
  UNION SELECT 'inverse', unnest([r1, r2]) FROM iv UNION SELECT 'composition', unnest([r1, r2, r3]) FROM acc)"""
R.add("pattern_groups", groups, f"WITH {_G} SELECT * FROM grp")
PATTERNS = ["symmetric", "anti_symmetric", "inverse", "composition"]
R.add("pattern_group_matrix", lambda s, d: P.group_matrix(groups(s, d), PATTERNS), f"WITH {_G} SELECT relation, " + ", ".join(f"max((pattern = '{p}')::INT) AS {p}" for p in PATTERNS) + " FROM grp GROUP BY relation")
R.add("kg_pattern_split", lambda s, d: T.pattern_split(triples(s, d), groups(s, d)), f"WITH {_G} SELECT pattern, h, r, t FROM k JOIN grp ON relation = r")

# matrices
_ADJ = "adj AS MATERIALIZED (SELECT r1 AS \"row\", r2 AS col, CAST(sum(total) AS DOUBLE) AS v FROM pairs GROUP BY 1, 2 HAVING sum(total) >= 3), lg AS (SELECT \"row\", col, ln(1 + v) AS v FROM adj)"
_MODE_SQL = {
    "adjacency_support": "SELECT \"row\", col, v AS value FROM adj",
    "adjacency_log1p": "SELECT \"row\", col, round(v, 9) AS value FROM lg",
    "two_hop_log1p": "SELECT a.\"row\", b.col, round(ln(1 + sum(a.v * b.v)), 9) AS value FROM adj a JOIN adj b ON a.col = b.\"row\" GROUP BY 1, 2",
    "log1p_row_norm": "SELECT \"row\", col, round(v / sum(v) OVER (PARTITION BY \"row\"), 9) AS value FROM lg",
    "log1p_col_norm": "SELECT \"row\", col, round(v / sum(v) OVER (PARTITION BY col), 9) AS value FROM lg",
    "log1p_balanced_norm": "SELECT \"row\", col, round((v / sum(v) OVER (PARTITION BY \"row\") + v / sum(v) OVER (PARTITION BY col)) / 2, 9) AS value FROM lg",
}
for _m, _sql in _MODE_SQL.items():
    R.add(f"weights_{_m}", lambda s, d, m=_m: rounded(M.weights(M.adjacency(pairs(s, d), 3), m), "value"), f"{Q}, {_ADJ} {_sql}")
R.add("weights_submatrix", lambda s, d: M.submatrix(M.adjacency(pairs(s, d), 3), allocations(s, d).select("relation")), f"{Q}, {_ADJ}, {ALLOC_SQL} SELECT \"row\", col, v AS value FROM adj WHERE \"row\" IN (SELECT relation FROM alloc) AND col IN (SELECT relation FROM alloc)")
R.add("weights_nested", lambda s, d: M.nested(M.adjacency(pairs(s, d), 3)).select("row", F.to_json("cells").alias("cells"), F.size("cells").alias("n")).drop("cells"), f"{Q}, {_ADJ} SELECT u.\"row\", CAST(count(a.col) AS INTEGER) AS n FROM (SELECT \"row\" FROM adj UNION SELECT col FROM adj) u LEFT JOIN adj a ON a.\"row\" = u.\"row\" GROUP BY 1")
R.add("weights_round_trip", lambda s, d: M.unnested(M.nested(M.adjacency(pairs(s, d), 3))), f"{Q}, {_ADJ} SELECT \"row\", col, v AS value FROM adj")


# allocation: the pattern groups of the allocations table over the log matrix
def _allocated(s, d):
    m = M.weights(M.adjacency(pairs(s, d), 1), "adjacency_log1p")
    return A.allocate(m, allocations(s, d).select("pattern", "relation"), 5000, 1.0, 0.01)


_ALC = f"""{PAIRS_SQL}, {ALLOC_SQL}, lg AS MATERIALIZED (SELECT r1, r2, ln(1 + sum(total)) AS v FROM pairs GROUP BY 1, 2 HAVING sum(total) >= 1), u AS (SELECT r1 AS relation FROM lg UNION SELECT r2 FROM lg),
g AS MATERIALIZED (SELECT DISTINCT pattern, relation, FROM alloc WHERE relation IN (SELECT relation FROM u)), gn AS (SELECT pattern, count(*) AS n FROM g GROUP BY 1),
ins AS MATERIALIZED (SELECT a.pattern, lg.* FROM lg JOIN g a ON a.relation = r1 JOIN g b ON b.relation = r2 AND b.pattern = a.pattern),
sc AS (SELECT g.pattern, g.relation, coalesce(f, 0) + 0.01 * n AS forward, coalesce(b, 0) + 0.01 * n AS backward FROM g JOIN gn USING (pattern)
  LEFT JOIN (SELECT pattern, r1, sum(v) AS f FROM ins GROUP BY 1, 2) x ON x.pattern = g.pattern AND x.r1 = g.relation LEFT JOIN (SELECT pattern, r2, sum(v) AS b FROM ins GROUP BY 1, 2) y ON y.pattern = g.pattern AND y.r2 = g.relation),
ex AS (SELECT *, exp(forward - max(forward) OVER w) AS ef, exp(backward - max(backward) OVER w) AS eb FROM sc WINDOW w AS (PARTITION BY pattern)),
pr AS (SELECT *, (ef / sum(ef) OVER w + eb / sum(eb) OVER w) / 2 AS p_avg FROM ex WINDOW w AS (PARTITION BY pattern)),
al AS (SELECT *, p_avg * 5000 AS e, floor(p_avg * 5000) AS fl FROM pr),
fin AS (SELECT *, CAST(fl + (row_number() OVER (PARTITION BY pattern ORDER BY round(e - fl, 12) DESC, relation) <= 5000 - sum(fl) OVER (PARTITION BY pattern))::INT AS BIGINT) AS eta_integer FROM al)"""
R.add("allocation_expected", lambda s, d: _allocated(s, d).select("pattern", "relation", *[F.round(c, 6).alias(c) for c in ("forward", "backward", "p_avg", "eta_expected")]), f"WITH {_ALC} SELECT pattern, relation, round(forward, 6) AS forward, round(backward, 6) AS backward, round(p_avg, 6) AS p_avg, round(e, 6) AS eta_expected FROM fin")
R.add("allocation_integer", lambda s, d: _allocated(s, d).select("pattern", "relation", "eta_integer"), f"WITH {_ALC} SELECT pattern, relation, eta_integer FROM fin")
R.add("allocation_totals", lambda s, d: _allocated(s, d).groupBy("pattern").agg(F.sum("eta_integer").alias("total"), F.count_if(F.col("eta_integer") > 0).alias("positive_relations")), f"WITH {_ALC} SELECT pattern, CAST(sum(eta_integer) AS BIGINT) AS total, count(*) FILTER (WHERE eta_integer > 0) AS positive_relations FROM fin GROUP BY 1")

# balance of the candidate graph against the allocations table
C = f"WITH {TRIPLES_SQL}, {ALLOC_SQL}, c AS MATERIALIZED (SELECT r, count(*) AS n FROM k GROUP BY r)"
_CMP = """cmp AS MATERIALIZED (SELECT relation, expected, coalesce(n, 0) AS observed, greatest(expected - coalesce(n, 0), 0) AS deficit, greatest(coalesce(n, 0) - expected, 0) AS surplus,
  CASE WHEN coalesce(n, 0) = 0 THEN 'zero' WHEN expected > n THEN 'under' WHEN expected < n THEN 'over' ELSE 'exact' END AS fulfilment, patterns
  FROM (SELECT relation, sum(eta) AS expected, string_agg(DISTINCT pattern, '|' ORDER BY pattern) AS patterns FROM alloc GROUP BY relation) LEFT JOIN c ON c.r = relation)"""


def counts(s, d):
    return T.relation_counts(triples(s, d))


def compared(s, d):
    return A.compare_relations(counts(s, d), allocations(s, d))


R.add("allocations_positive", lambda s, d: rounded(allocations(s, d), "eta", digits=6), f"WITH {ALLOC_SQL} SELECT pattern, relation, round(eta, 6) AS eta FROM alloc")
_E = ("expected", "deficit", "surplus")
R.add("quota_compare", lambda s, d: rounded(compared(s, d), *_E, digits=6), f"{C}, {_CMP} SELECT relation, round(expected, 6) AS expected, observed, round(deficit, 6) AS deficit, round(surplus, 6) AS surplus, fulfilment, patterns FROM cmp")
R.add("quota_totals", lambda s, d: A.balance_totals(compared(s, d)), f"""{C}, {_CMP} SELECT count(*) AS relations, count(*) FILTER (WHERE observed > 0) AS observed_relations, count(*) FILTER (WHERE observed = 0) AS zero_relations, round(sum(expected), 6) AS total_expected,
  CAST(sum(observed) AS BIGINT) AS total_observed, round(sum(deficit), 6) AS total_deficit, round(sum(surplus), 6) AS total_surplus FROM cmp""")
R.add("quota_top_overfilled", lambda s, d: rounded(compared(s, d), "surplus", digits=6).where("surplus > 0").orderBy(F.col("surplus").desc(), "relation").limit(25).select("relation", "surplus"), f"{C}, {_CMP} SELECT relation, round(surplus, 6) AS surplus FROM cmp WHERE surplus > 0 ORDER BY round(surplus, 6) DESC, relation LIMIT 25")
R.add("quota_top_underfilled", lambda s, d: rounded(compared(s, d), "deficit", digits=6).where("deficit > 0").orderBy(F.col("deficit").desc(), "relation").limit(25).select("relation", "deficit"), f"{C}, {_CMP} SELECT relation, round(deficit, 6) AS deficit FROM cmp WHERE deficit > 0 ORDER BY round(deficit, 6) DESC, relation LIMIT 25")
_SH = "sh AS MATERIALIZED (SELECT pattern, relation, n, n * (eta / sum(eta) OVER (PARTITION BY relation)) AS part FROM alloc JOIN c ON r = relation)"
R.add("pattern_share_float", lambda s, d: rounded(A.by_eta_share(counts(s, d), allocations(s, d)), "observed", digits=6), f"{C}, {_SH} SELECT pattern, round(sum(part), 6) AS observed FROM sh GROUP BY 1")
R.add("pattern_share_rounded", lambda s, d: A.by_rounded_share(counts(s, d), allocations(s, d)), f"{C}, {_SH} SELECT pattern, CAST(sum(round_even(round(part, 9), 0)) AS BIGINT) AS observed FROM sh GROUP BY 1")
R.add("pattern_share_lr", lambda s, d: A.by_largest_remainder(counts(s, d), allocations(s, d)), f"""{C}, sh AS (SELECT pattern, relation, n, n * (eta / sum(eta) OVER (PARTITION BY relation)) AS part FROM (SELECT pattern, relation, sum(eta) AS eta FROM alloc GROUP BY 1, 2) JOIN c ON r = relation),
l AS (SELECT pattern, floor(part) + (row_number() OVER (PARTITION BY relation ORDER BY round(part - floor(part), 12) DESC, pattern) <= n - sum(floor(part)) OVER (PARTITION BY relation))::INT AS x FROM sh) SELECT pattern, CAST(sum(x) AS BIGINT) AS observed FROM l GROUP BY 1""")
R.add("pattern_membership", lambda s, d: A.by_membership(counts(s, d), allocations(s, d)), f"{C} SELECT pattern, CAST(sum(n) AS BIGINT) AS observed FROM (SELECT DISTINCT pattern, relation FROM alloc) JOIN c ON r = relation GROUP BY 1")
R.add("pattern_combinations", lambda s, d: A.by_combination(counts(s, d), allocations(s, d)), f"""{C} SELECT coalesce(p, 'none') AS patterns, count(*) AS relations, CAST(sum(n) AS BIGINT) AS observed FROM c LEFT JOIN (SELECT relation, string_agg(DISTINCT pattern, '|' ORDER BY pattern) AS p FROM alloc GROUP BY 1) ON relation = r GROUP BY 1""")
R.add("pattern_compare", lambda s, d: rounded(A.compare_patterns(A.by_eta_share(counts(s, d), allocations(s, d)), allocations(s, d)), "observed", *_E, digits=6), f"""{C}, {_SH}, o AS (SELECT pattern, sum(part) AS o FROM sh GROUP BY 1), e AS (SELECT pattern, sum(eta) AS e FROM alloc GROUP BY 1)
SELECT pattern, round(coalesce(e, 0), 6) AS expected, round(coalesce(o, 0), 6) AS observed, round(greatest(coalesce(e, 0) - coalesce(o, 0), 0), 6) AS deficit, round(greatest(coalesce(o, 0) - coalesce(e, 0), 0), 6) AS surplus FROM e FULL JOIN o USING (pattern)""")
R.add("quota_rollup", lambda s, d: A.quotas(allocations(s, d)), f"WITH {ALLOC_SQL} SELECT relation, pattern, round(sum(eta), 6) AS eta, CAST(grouping(relation, pattern) AS BIGINT) AS level FROM alloc GROUP BY ROLLUP (relation, pattern)")

QUERIES, SQL = R.queries, R.sql
