"""Constraints, candidate annotation, census, completion and audit queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from kgloom.functions.ids import plain_id, plain_id_sql
from kgloom.functions.labels import folded
from kgloom.operators import allocate as A
from kgloom.operators import audits as U
from kgloom.operators import candidates as N
from kgloom.operators import complete as X
from kgloom.operators import constraints as C
from kgloom.operators import construct as B
from kgloom.operators import matrix as M
from kgloom.operators import patterns as P
from kgloom.operators import triples as T
from kgloom.operators.skew import running_totals
from kgloom.plans.registry import Registry, rounded
from kgloom.session import cut
from kgloom.sources.tables import ALLOC_SQL, AUX_SQL, PAIRS_SQL, POOL_SQL, PROFILE_SQL, TRIPLES_SQL, allocations, constraints, graph, pair_rows, raw_triples, table, triples

R = Registry()
K = f"WITH {TRIPLES_SQL}"


def pairs(s, d):
    return P.pair_confidence(pair_rows(s, d))


# domains and ranges
_COMPAT = "({0} IS NULL OR {1} IS NULL OR list_has_any({0}, {1}))"
R.add("domain_range_targets", lambda s, d: C.composition_targets(pairs(s, d), constraints(s, d)), f"""WITH {PAIRS_SQL}, {PROFILE_SQL}
SELECT p.r1, p.r2, t.relation AS target FROM (SELECT DISTINCT r1, r2 FROM pairs) p JOIN prof a ON a.relation = p.r1 JOIN prof b ON b.relation = p.r2 JOIN prof t ON {_COMPAT.format("a.subjects", "t.subjects")} AND {_COMPAT.format("b.objects", "t.objects")}
WHERE t.target IS DISTINCT FROM 'NO_WAY'""")


def _pair_reasons(s, d):
    """Why the range of r1 and the domain of r2 are compatible, for every supported pair."""
    p, c = pairs(s, d).select("r1", "r2"), constraints(s, d)
    m = p.join(c.select(F.col("relation").alias("r1"), F.col("objects").alias("_a")), "r1", "left").join(c.select(F.col("relation").alias("r2"), F.col("subjects").alias("_b")), "r2", "left")
    return m.select("r1", "r2", C.overlap_reason(F.col("_a"), F.col("_b"), "RANGE", "DOMAIN").alias("reason"))


R.add("domain_range_reasons", _pair_reasons, f"""WITH {PAIRS_SQL}, {PROFILE_SQL} SELECT r1, r2, CASE WHEN a.objects IS NULL AND b.subjects IS NULL THEN 'ANY_RANGE_AND_ANY_DOMAIN' WHEN a.objects IS NULL THEN 'ANY_RANGE' WHEN b.subjects IS NULL THEN 'ANY_DOMAIN'
  WHEN list_has_any(a.objects, b.subjects) THEN 'INTERSECT' ELSE 'EMPTY' END AS reason FROM pairs LEFT JOIN prof a ON a.relation = r1 LEFT JOIN prof b ON b.relation = r2""".replace("ANY_RANGE_AND_ANY_DOMAIN", "ANY_RANGE_AND_DOMAIN"))
R.add("relation_class", lambda s, d: C.relation_class(constraints(s, d)), f"WITH {PROFILE_SQL} SELECT relation, CASE WHEN subjects IS NULL AND objects IS NULL THEN 'ANY_BOTH' WHEN subjects IS NULL THEN 'ANY_SUBJECT' WHEN objects IS NULL THEN 'ANY_DOMAIN' ELSE 'FULL_BOTH' END AS dom_rng_class FROM prof")
_JAC = "SELECT a.relation AS a, b.relation AS b, len(list_intersect(a.{0}, b.{1})) / len(list_distinct(list_concat(a.{0}, b.{1}))) AS w FROM prof a JOIN prof b ON a.relation <> b.relation AND list_has_any(a.{0}, b.{1})"
R.add("unlock_graph", lambda s, d: rounded(C.unlock_graph(constraints(s, d)), "weight"), f"WITH {PROFILE_SQL} SELECT a, b, round(sum(w), 9) AS weight FROM ({_JAC.format('objects', 'subjects')} UNION ALL {_JAC.format('subjects', 'objects')}) GROUP BY a, b")
R.add("type_graph", lambda s, d: C.type_graph(constraints(s, d)), f"WITH {PROFILE_SQL} SELECT a.relation AS a, b.relation AS b, len(list_intersect(a.objects, b.subjects)) AS shared FROM prof a JOIN prof b ON a.relation <> b.relation AND list_has_any(a.objects, b.subjects)")
R.add("datatype_counts", lambda s, d: C.datatype_counts(pairs(s, d), constraints(s, d)), f"""WITH {PAIRS_SQL}, {PROFILE_SQL} SELECT r1, count(*) FILTER (WHERE p.relation IS NULL) AS missing, count(*) FILTER (WHERE datatype = 'wikibase-item') AS items,
  count(*) FILTER (WHERE datatype <> 'wikibase-item') AS others, count(*) FILTER (WHERE p.relation IS NOT NULL AND datatype IS NULL) AS unknown FROM (SELECT DISTINCT r1, r2 FROM pairs) LEFT JOIN prof p ON p.relation = r2 GROUP BY r1""")


def _follow_potential(s, d):
    """Future unlock of each allocated relation: Σ compatibility × remaining share of the relations it unlocks."""
    cmp = A.compare_relations(T.relation_counts(triples(s, d)), allocations(s, d)).where("deficit > 0").select(F.col("relation").alias("b"), (F.col("deficit") / F.col("expected")).alias("_rest"))
    return C.unlock_graph(constraints(s, d)).join(cmp, "b").groupBy(F.col("a").alias("relation")).agg(F.round(F.sum(F.col("weight") * F.col("_rest")), 9).alias("unlock_score"))


R.add("unlock_score", _follow_potential, f"""WITH {PROFILE_SQL}, {TRIPLES_SQL}, {ALLOC_SQL}, u AS (SELECT a, b, sum(w) AS weight FROM ({_JAC.format('objects', 'subjects')} UNION ALL {_JAC.format('subjects', 'objects')}) GROUP BY a, b),
c AS (SELECT r, count(*) AS n FROM k GROUP BY r), cmp AS (SELECT relation, (e - coalesce(n, 0)) / e AS rest FROM (SELECT relation, sum(eta) AS e FROM alloc GROUP BY 1) LEFT JOIN c ON r = relation WHERE e > coalesce(n, 0))
SELECT a AS relation, round(sum(weight * rest), 9) AS unlock_score FROM u JOIN cmp ON b = relation GROUP BY a""")

# genericity and annotation
GEN_SQL = f"""{PAIRS_SQL}, {ALLOC_SQL}, rel AS MATERIALIZED (SELECT relation, sum(eta) AS eta FROM alloc GROUP BY 1), cell AS (SELECT r1, r2, sum(total) AS v FROM pairs GROUP BY 1, 2 HAVING sum(total) >= 3),
ins AS (SELECT * FROM cell WHERE r1 IN (SELECT relation FROM rel) AND r2 IN (SELECT relation FROM rel)), en AS (SELECT r1 AS relation, r2 AS o, v FROM ins UNION ALL SELECT r2, r1, v FROM ins),
per AS (SELECT relation, count(DISTINCT CASE WHEN v > 1e-12 THEN o END) AS n, CAST(sum(v) AS DOUBLE) AS m FROM en GROUP BY 1), s0 AS (SELECT relation, eta, coalesce(n, 0) AS n, coalesce(m, 0) AS mass FROM rel LEFT JOIN per USING (relation)),
th AS (SELECT list_sort(list(mass))[CAST(floor(0.9 * (count(*) - 1)) AS INT) + 1] AS thr, max(mass) AS top, max(eta) AS me, count(*) AS c FROM s0),
s1 AS (SELECT relation, n / c AS coverage_score, mass / top AS mass_score, eta / me AS volume_score, mass >= thr AS heavy FROM s0, th),
gen AS MATERIALIZED (SELECT *, 0.35 * coverage_score + 0.25 * mass_score + 0.20 * volume_score AS genericity_score, CASE WHEN coverage_score >= 0.8 OR heavy THEN CASE WHEN round(0.35 * coverage_score + 0.25 * mass_score + 0.20 * volume_score, 12) >= 0.6 THEN 'high' ELSE 'medium' END
  WHEN round(0.35 * coverage_score + 0.25 * mass_score + 0.20 * volume_score, 12) >= 0.33 THEN 'medium' ELSE 'low' END AS genericity_bucket FROM s1)"""


def generic(s, d):
    return N.genericity(allocations(s, d), M.adjacency(pairs(s, d), 3))


R.add("genericity", lambda s, d: rounded(generic(s, d), "coverage_score", "mass_score", "volume_score", "genericity_score"), f"""WITH {GEN_SQL} SELECT relation, round(coverage_score, 9) AS coverage_score, round(mass_score, 9) AS mass_score, round(volume_score, 9) AS volume_score, CAST(0 AS DOUBLE) AS manual_risk,
  round(genericity_score, 9) AS genericity_score, genericity_bucket FROM gen""")
_ANN = f"""{TRIPLES_SQL}, {GEN_SQL}, tg AS (SELECT relation, genericity_score AS gs, genericity_bucket AS gb, least(5000, greatest(40, 5 * CAST(floor(eta) AS BIGINT) + 20)) AS target FROM rel JOIN gen USING (relation)),
ok AS MATERIALIZED (SELECT k.* FROM k JOIN tg ON relation = r WHERE h <> t), fr AS MATERIALIZED (SELECT r, e, count(*) AS f FROM (SELECT r, h AS e FROM ok UNION ALL SELECT r, t FROM ok) GROUP BY 1, 2),
pk AS (SELECT r, max(f) AS peak FROM fr GROUP BY 1), ac AS (SELECT r, count(*) AS accepted FROM ok GROUP BY 1),
pr AS (SELECT tg.*, peak, CASE WHEN gb = 'high' THEN least(target, 200) WHEN accepted <= 200 THEN accepted ELSE least(target, accepted) END AS keep, CASE WHEN gb = 'high' THEN 'graph_anchored' WHEN accepted <= 200 THEN 'small_full' ELSE 'normal' END AS mode FROM tg JOIN ac ON ac.r = relation JOIN pk ON pk.r = relation),
ann AS MATERIALIZED (SELECT o.h, o.r, o.t, gs AS genericity_score, gb AS genericity_bucket, mode AS collection_mode, CASE WHEN peak <= 1 THEN 0 ELSE least(1, greatest(a.f, b.f) / peak) END AS hub_penalty, CASE gb WHEN 'low' THEN 0.1 WHEN 'medium' THEN 0.4 ELSE 0.8 END AS shortcut_risk
  FROM (SELECT *, row_number() OVER (PARTITION BY r ORDER BY h, t) AS p FROM ok) o JOIN pr ON relation = o.r AND p <= keep JOIN fr a ON a.r = o.r AND a.e = o.h JOIN fr b ON b.r = o.r AND b.e = o.t)"""


def annotated(s, d):
    return N.annotate(raw_triples(s, d), allocations(s, d), generic(s, d))


R.add("candidate_annotate", lambda s, d: rounded(annotated(s, d), "genericity_score", "hub_penalty").withColumn("quality_score", F.round(F.col("quality_score") + 1e-9, 5)), f"""WITH {_ANN} SELECT h, r, t, round(genericity_score, 9) AS genericity_score, genericity_bucket, collection_mode, round(hub_penalty, 9) AS hub_penalty, CAST(shortcut_risk AS DOUBLE) AS shortcut_risk,
  round(greatest(0, round(1 - 0.3 * hub_penalty - 0.25 * shortcut_risk - 0.2 * genericity_score, 6)) + 1e-9, 5) AS quality_score FROM ann""")


def _audit(s, d):
    rows = table(s, d, "candidates").select(plain_id("h", "Q").alias("h"), plain_id("r", "P").alias("r"), plain_id("t", "Q").alias("t"), "quality_score", "genericity_score", "hub_penalty")
    rows = rows.where("h IS NOT NULL AND r IS NOT NULL AND t IS NOT NULL")
    return N.audit(rows, allocations(s, d).groupBy("relation").agg(F.sum("eta").alias("eta")))


_Z = "coalesce(CASE WHEN NOT isnan({0}) THEN {0} END, 0)"
R.add("candidate_audit", lambda s, d: _audit(s, d).withColumns({c: F.round(F.col(c) + 1e-9, 5) for c in ("avg_quality_score", "avg_genericity_score", "avg_hub_penalty")}), f"""WITH {ALLOC_SQL}, c AS MATERIALIZED (SELECT {plain_id_sql("h", "Q")} AS h, {plain_id_sql("r", "P")} AS r, {plain_id_sql("t", "Q")} AS t, quality_score, genericity_score, hub_penalty FROM candidates),
v AS MATERIALIZED (SELECT * FROM c WHERE h IS NOT NULL AND r IS NOT NULL AND t IS NOT NULL), f AS (SELECT r, e, count(*) AS f FROM (SELECT r, h AS e FROM v UNION ALL SELECT r, t FROM v) GROUP BY 1, 2),
x AS (SELECT r, count(*) AS entities, max(f) AS top_frequency FROM f GROUP BY 1), b AS (SELECT r, count(*) AS n, count(DISTINCT h) AS heads, count(DISTINCT t) AS tails, round(round(avg({_Z.format("quality_score")}), 6) + 1e-9, 5) AS avg_quality_score, round(round(avg({_Z.format("genericity_score")}), 6) + 1e-9, 5) AS avg_genericity_score, round(round(avg({_Z.format("hub_penalty")}), 6) + 1e-9, 5) AS avg_hub_penalty FROM v GROUP BY 1)
SELECT b.*, entities, top_frequency, round(top_frequency / (2 * n), 6) AS concentration, coalesce(n < eta, false) AS undercollected FROM b JOIN x USING (r) LEFT JOIN (SELECT relation, sum(eta) AS eta FROM alloc GROUP BY 1) ON relation = r""")
_INC = "inc AS MATERIALIZED (SELECT entity, count(*) AS n FROM (SELECT h AS entity, r FROM k UNION SELECT t, r FROM k) GROUP BY entity)"
R.add("seed_selection", lambda s, d: N.seeds(triples(s, d), allocations(s, d), 20, 2, 10), f"""{K}, {ALLOC_SQL}, {_INC}, p AS MATERIALIZED (SELECT *, row_number() OVER (PARTITION BY r ORDER BY h, t) AS p FROM k),
lo AS (SELECT h, r, t, 'hard' AS kind FROM p JOIN (SELECT relation, sum(eta) AS eta FROM alloc GROUP BY 1) ON relation = r WHERE p <= 2 ORDER BY eta, r, h, t LIMIT 20),
br AS (SELECT h, r, t, 'bridge' AS kind FROM p JOIN inc a ON a.entity = h JOIN inc b ON b.entity = t WHERE p <= 50 ORDER BY least(1, (a.n + b.n) / 20) DESC, r, h, t LIMIT 10)
SELECT h, r, t, max(kind) AS kind FROM (SELECT * FROM lo UNION ALL SELECT * FROM br) GROUP BY h, r, t""")

# census of auxiliary edges against the candidate graph
PATTERN_FLAGS = ("symmetric", "composition")


def census(s, d, k=None):
    """Every auxiliary triple with what decides on it: class, deficits, patterns, common neighbours, score."""
    k, alloc = graph(s, d) if k is None else k, allocations(s, d)
    counts = T.relation_counts(k)
    aux = graph(s, d, "aux_edges")
    ent = T.entities(k)
    cmp = A.compare_relations(counts, alloc).select(F.col("relation").alias("r"), F.col("expected").alias("_eta"), F.col("deficit").alias("_def"))
    pat = A.compare_patterns(A.by_eta_share(counts, alloc), alloc).select("pattern", (F.round("deficit", 6) > 0).alias("_under"), (F.round("surplus", 6) > 0).alias("_over"))
    flags = alloc.select("pattern", F.col("relation").alias("r")).distinct().join(pat, "pattern").groupBy("r").agg(F.bool_or("_under").alias("_under"), F.bool_or(F.col("pattern") == "symmetric").alias("_sym"), F.bool_or(F.col("pattern") == "composition").alias("_comp"), F.bool_or((F.col("pattern") == "composition") & F.col("_over")).alias("_over"))
    common = T.common_neighbours(k, aux.select(F.least("h", "t").alias("a"), F.greatest("h", "t").alias("b")))
    known = lambda c, n: ent.select(F.col("entity").alias(c), F.lit(1).alias(n))
    m = aux.join(known("h", "_h"), "h", "left").join(known("t", "_t"), "t", "left").join(cmp, "r", "left").join(flags, "r", "left")
    m = m.withColumns({"a": F.least("h", "t"), "b": F.greatest("h", "t")}).join(common, ["a", "b"], "left")
    no = lambda c: F.coalesce(c, F.lit(False))
    m = m.select("h", "r", "t", F.coalesce("_def", F.lit(0.0)).alias("relation_deficit"), F.coalesce("_eta", F.lit(0.0)).alias("relation_eta"), no("_under").alias("pattern_under"), no("_sym").alias("is_symmetric"), no("_comp").alias("is_composition"), no("_over").alias("composition_over"), (2 - F.coalesce("_h", F.lit(0)) - F.coalesce("_t", F.lit(0))).alias("new_entities"), F.coalesce("common", F.lit(0)).alias("common"), (F.col("r") == "P17").alias("is_generic"))
    return m.withColumn("score", N.census_score())


_CEN = f"""{TRIPLES_SQL}, {AUX_SQL}, {ALLOC_SQL}, c AS (SELECT r, count(*) AS n FROM k GROUP BY r), nb AS MATERIALIZED (SELECT h AS v, t AS w FROM k WHERE h <> t UNION SELECT t, h FROM k WHERE h <> t), en AS MATERIALIZED (SELECT h AS entity FROM k UNION SELECT t FROM k),
cm AS (SELECT relation, sum(eta) AS eta, greatest(sum(eta) - coalesce(any_value(n), 0), 0) AS def FROM alloc LEFT JOIN c ON r = relation GROUP BY relation),
sh AS (SELECT pattern, eta, coalesce(n, 0) * eta / sum(eta) OVER (PARTITION BY relation) AS part FROM alloc LEFT JOIN c ON r = relation), pt AS (SELECT pattern, round(sum(eta) - sum(part), 6) > 0 AS under, round(sum(part) - sum(eta), 6) > 0 AS over FROM sh GROUP BY 1),
fl AS (SELECT relation, bool_or(under) AS under, bool_or(pattern = 'symmetric') AS sym, bool_or(pattern = 'composition') AS comp, bool_or(pattern = 'composition' AND over) AS over FROM (SELECT DISTINCT pattern, relation FROM alloc) JOIN pt USING (pattern) GROUP BY 1),
pp AS (SELECT DISTINCT least(h, t) AS a, greatest(h, t) AS b FROM aux), co AS (SELECT pp.a, pp.b, count(y.w) AS common FROM pp LEFT JOIN nb x ON x.v = pp.a LEFT JOIN nb y ON y.v = pp.b AND y.w = x.w GROUP BY 1, 2),
cen AS MATERIALIZED (SELECT h, r, t, coalesce(def, 0) AS relation_deficit, coalesce(cm.eta, 0) AS relation_eta, coalesce(under, false) AS pattern_under, coalesce(sym, false) AS is_symmetric, coalesce(comp, false) AS is_composition, coalesce(over, false) AS composition_over,
  CAST((h NOT IN (SELECT entity FROM en))::INT + (t NOT IN (SELECT entity FROM en))::INT AS INTEGER) AS new_entities, common, r = 'P17' AS is_generic FROM aux LEFT JOIN cm ON cm.relation = r LEFT JOIN fl ON fl.relation = r JOIN co ON a = least(h, t) AND b = greatest(h, t)),
scored AS MATERIALIZED (SELECT *, 5 * least(relation_deficit / greatest(relation_eta, 1), 1) + 2.5 * pattern_under::INT + 4 * (is_symmetric AND pattern_under)::INT + CASE new_entities WHEN 0 THEN 1 WHEN 1 THEN 0.5 ELSE 0 END + least(common / 10, 1) + (common > 0)::INT
  - 6 * (is_composition AND composition_over)::INT - 1.5 * is_generic::INT - 2 * new_entities AS score FROM cen)"""
R.add("census", lambda s, d: rounded(census(s, d), "relation_deficit", "relation_eta", "score", digits=6), f"WITH {_CEN} SELECT * REPLACE (round(relation_deficit, 6) AS relation_deficit, round(relation_eta, 6) AS relation_eta, round(CAST(score AS DOUBLE), 6) AS score) FROM scored")
R.add("additions_ranked", lambda s, d: rounded(census(s, d), "score", "relation_deficit", digits=6).where("new_entities = 0 AND score > 0").orderBy(F.col("score").desc(), "new_entities", F.col("relation_deficit").desc(), "r", "h", "t").limit(500).select("h", "r", "t", "score"), f"WITH {_CEN} SELECT h, r, t, round(CAST(score AS DOUBLE), 6) AS score FROM scored WHERE new_entities = 0 AND round(score, 6) > 0 ORDER BY round(CAST(score AS DOUBLE), 6) DESC, new_entities, round(relation_deficit, 6) DESC, r, h, t LIMIT 500")


def _selected(s, d):
    """Additions a greedy pass accepts; 2,000 is the operator's budget. No end is new, so no addition makes a component."""
    k = graph(s, d)
    rows = rounded(census(s, d, k), "score", "relation_deficit", digits=6).where("new_entities = 0 AND score > 0").join(k, ["h", "r", "t"], "left_anti")
    order = [F.col("score").desc(), F.col("relation_deficit").desc(), F.col("r"), F.col("h"), F.col("t")]
    return B.select_additions(rows.select("h", "r", "t", "score", "relation_deficit"), T.relation_counts(k).withColumnRenamed("r", "relation"), allocations(s, d), 2000, order).drop("relation_deficit")


R.add("additions_selected", _selected)

# completion
_CMPQ = "c AS (SELECT r, count(*) AS n FROM k GROUP BY r), cm AS MATERIALIZED (SELECT relation, sum(eta) AS eta, greatest(sum(eta) - coalesce(any_value(n), 0), 0) AS deficit, greatest(coalesce(any_value(n), 0) - sum(eta), 0) AS surplus FROM alloc LEFT JOIN c ON r = relation GROUP BY relation)"


def symmetric(s, d, k=None):
    """Reverses that the symmetric relations of the candidate graph lack, with the relation's deficit."""
    k, alloc = graph(s, d) if k is None else k, allocations(s, d)
    sym = alloc.where("pattern = 'symmetric'").select("relation").distinct()
    meta = A.compare_relations(T.relation_counts(k), alloc).join(sym, "relation", "left_semi").select("relation", "deficit")
    return X.symmetric_completion(k, meta, triples(s, d, "aux_edges"))


_SYMC = f"{TRIPLES_SQL}, {ALLOC_SQL}, {AUX_SQL}, {_CMPQ}, sy AS MATERIALIZED (SELECT DISTINCT t AS h, r, h AS t, deficit FROM k JOIN cm ON relation = r WHERE relation IN (SELECT relation FROM alloc WHERE pattern = 'symmetric') AND (t, r, h) NOT IN (SELECT (h, r, t) FROM k) AND (t, r, h) NOT IN (SELECT (h, r, t) FROM aux))"
R.add("symmetric_completion", lambda s, d: symmetric(s, d).drop("deficit"), f"WITH {_SYMC} SELECT h, r, t FROM sy")
R.add("symmetric_completion_capped", lambda s, d: X.capped(symmetric(s, d), F.round("deficit", 6), [F.col("h"), F.col("t")]).drop("deficit"), f"WITH {_SYMC} SELECT h, r, t FROM sy QUALIFY row_number() OVER (PARTITION BY r ORDER BY h, t) <= floor(round(deficit, 6))")
R.add("completed_graph", lambda s, d: triples(s, d).withColumn("source", F.lit("base")).unionByName(symmetric(s, d).select("h", "r", "t", F.lit("symmetric").alias("source"))), f"WITH {_SYMC} SELECT h, r, t, 'base' AS source FROM k UNION ALL SELECT h, r, t, 'symmetric' FROM sy")


def _rules(s, d, k=None):
    """Inverse rules: supported pairs with the loop confidence of both directions, and what their target lacks."""
    inv = P.inverse_pairs(pairs(s, d), 1, 0.01).select(F.col("r1").alias("source"), F.col("r2").alias("target"), F.round("conf_min", 9).alias("confidence"))
    cmp = A.compare_relations(T.relation_counts(triples(s, d) if k is None else k), allocations(s, d)).select(F.col("relation").alias("target"), F.col("expected").alias("eta"), F.round("deficit", 6).alias("deficit"), F.round("surplus", 6).alias("surplus"))
    return inv.join(cmp, "target", "left").select("source", "target", "confidence", "eta", "deficit", "surplus")


def _inverse(s, d):
    k = graph(s, d)
    return X.inverse_candidates(k, cut(_rules(s, d, k)), triples(s, d, "aux_edges"), 0.02)


_INVS = f"""{PAIRS_SQL}, {TRIPLES_SQL}, {ALLOC_SQL}, {AUX_SQL}, {_CMPQ}, ru AS MATERIALIZED (SELECT a.r1 AS source, a.r2 AS target, round(least(a.conf_loop, b.conf_loop), 9) AS confidence, eta, round(deficit, 6) AS deficit, round(surplus, 6) AS surplus
  FROM pairs a JOIN pairs b ON a.r1 = b.r2 AND a.r2 = b.r1 AND a.r1 <> a.r2 LEFT JOIN cm ON relation = a.r2 WHERE least(a.total, b.total) >= 1 AND least(a.conf_loop, b.conf_loop) >= 0.01),
ge AS (SELECT source, t AS h, target AS r, h AS t, confidence, deficit, CASE WHEN (t, target, h) IN (SELECT (h, r, t) FROM k) THEN 'already_present' WHEN (t, target, h) IN (SELECT (h, r, t) FROM aux) THEN 'already_observed' WHEN confidence IS NULL OR confidence < 0.02 THEN 'low_confidence'
  WHEN coalesce(eta, 0) <= 0 THEN 'not_allocated' WHEN coalesce(surplus, 0) > 0 THEN 'overfilled' WHEN coalesce(deficit, 0) <= 0 THEN 'no_room' ELSE 'eligible' END AS reason FROM k JOIN ru ON source = r),
iv AS MATERIALIZED (SELECT source, h, r, t, confidence, deficit, CASE WHEN reason = 'eligible' AND row_number() OVER (PARTITION BY h, r, t, reason ORDER BY confidence DESC NULLS LAST, source) > 1 THEN 'duplicate' ELSE reason END AS reason FROM ge)"""
R.add("inverse_rules", lambda s, d: rounded(_rules(s, d), "eta", digits=6), f"WITH {_INVS} SELECT source, target, confidence, round(eta, 6) AS eta, deficit, surplus FROM ru")
R.add("inverse_completion", lambda s, d: _inverse(s, d), f"WITH {_INVS} SELECT * FROM iv")
R.add("inverse_completion_reasons", lambda s, d: _inverse(s, d).groupBy("reason").agg(F.count(F.lit(1)).alias("n")), f"WITH {_INVS} SELECT reason, count(*) AS n FROM iv GROUP BY 1")
R.add("inverse_completion_capped", lambda s, d: X.capped(_inverse(s, d).where("reason = 'eligible'"), F.col("deficit"), [F.col("confidence").desc(), F.col("source"), F.col("h"), F.col("t")]).select("h", "r", "t", "source", X.confidence_tier(F.col("confidence")).alias("tier")), f"""WITH {_INVS} SELECT h, r, t, source, CASE WHEN confidence >= 0.9 THEN '0.90+' WHEN confidence >= 0.8 THEN '0.80-0.89' WHEN confidence >= 0.7 THEN '0.70-0.79' ELSE 'below_0.70' END AS tier
FROM iv WHERE reason = 'eligible' QUALIFY row_number() OVER (PARTITION BY r ORDER BY confidence DESC, source, h, t) <= floor(deficit)""")

# audits
_NUM = ("loop", "nonloop", "total", "elapsed_sec")


def _hop_numbers(s, d):
    return U.numeric_summary(table(s, d, "hop_support").distinct(), _NUM)


R.add("numeric_summary", _hop_numbers, """WITH u AS (UNPIVOT (SELECT CAST(loop AS DOUBLE) AS loop, CAST(nonloop AS DOUBLE) AS nonloop, CAST(total AS DOUBLE) AS total, elapsed_sec FROM (SELECT DISTINCT * FROM hop_support)) ON loop, nonloop, total, elapsed_sec INTO NAME name VALUE x)
SELECT name, count(*) AS n, min(x) AS min_x, max(x) AS max_x, round(avg(x), 6) AS mean_x, round(stddev_pop(x), 6) AS stdev_pop, round(stddev_samp(x), 6) AS stdev_samp, """ + ", ".join(f"round(quantile_cont(x, {q}), 9) AS p{round(q * 100)}" for q in U.POINTS) + """
FROM u WHERE NOT isnan(x) GROUP BY name""")
R.add("support_shape", lambda s, d: rounded(U.support_shape(pairs(s, d)), "top1_share", "top10_share", "entropy", "self_share"), f"""WITH {PAIRS_SQL}, s AS (SELECT r1, r2, greatest(total, 0) AS c, sum(greatest(total, 0)) OVER (PARTITION BY r1) AS st, row_number() OVER (PARTITION BY r1 ORDER BY greatest(total, 0) DESC, r2) AS k FROM pairs)
SELECT r1, count(*) AS followers, count(*) FILTER (WHERE c > 0) AS followers_with_support, CAST(sum(c) AS BIGINT) AS support, coalesce(round(max(c) / nullif(max(st), 0), 9), 0) AS top1_share, coalesce(round(sum(c) FILTER (WHERE k <= 10) / nullif(max(st), 0), 9), 0) AS top10_share,
coalesce(round(-sum(CASE WHEN c > 0 THEN c / st * ln(c / st) END), 9), 0) AS entropy, coalesce(round(sum(CASE WHEN r1 = r2 THEN c ELSE 0 END) / nullif(max(st), 0), 9), 0) AS self_share FROM s GROUP BY r1""")


def _records(s, d, newest: bool):
    """One record per (r1, r2): the first or the last by updated_at, ties by support_id."""
    t = table(s, d, "hop_support").select("support_id", plain_id("r1", "P").alias("r1"), plain_id("r2", "P").alias("r2"), F.upper(F.trim("status")).alias("status"), "loop", F.coalesce(F.nullif(F.col("total"), F.lit(0)), F.coalesce("loop", F.lit(0)) + F.coalesce("nonloop", F.lit(0))).alias("total"), "updated_at")
    t = t.where("r1 IS NOT NULL AND r2 IS NOT NULL").distinct()
    order = [F.col("updated_at").desc_nulls_last(), F.col("support_id").desc()] if newest else [F.col("updated_at").asc_nulls_last(), F.col("support_id").asc()]
    return U.latest(t, ["r1", "r2"], order)


_REC = f"""rec AS MATERIALIZED (SELECT * FROM (SELECT DISTINCT support_id, {plain_id_sql("r1", "P")} AS r1, {plain_id_sql("r2", "P")} AS r2, upper(trim(status)) AS status, loop, coalesce(nullif(total, 0), coalesce(loop, 0) + coalesce(nonloop, 0)) AS total, updated_at FROM hop_support) WHERE r1 IS NOT NULL AND r2 IS NOT NULL),
fst AS MATERIALIZED (SELECT * FROM rec QUALIFY row_number() OVER (PARTITION BY r1, r2 ORDER BY updated_at NULLS LAST, support_id) = 1), lst AS MATERIALIZED (SELECT * FROM rec QUALIFY row_number() OVER (PARTITION BY r1, r2 ORDER BY updated_at DESC NULLS LAST, support_id DESC) = 1)"""
R.add("latest_records", lambda s, d: _records(s, d, True), f"WITH {_REC} SELECT * FROM lst")
R.add("rerun_upsert", lambda s, d: U.upsert(_records(s, d, False), _records(s, d, True), ["r1", "r2"], "status"), f"WITH {_REC} SELECT l.* FROM fst f JOIN lst l USING (r1, r2) WHERE NOT coalesce(f.status = 'ERROR' AND l.status = 'ERROR', false) UNION ALL SELECT f.* FROM fst f JOIN lst l USING (r1, r2) WHERE f.status = 'ERROR' AND l.status = 'ERROR'")
R.add("status_transitions", lambda s, d: U.transitions(_records(s, d, False), _records(s, d, True), ["r1", "r2"], "status"), f"WITH {_REC} SELECT coalesce(f.status, 'NO_STATUS') AS base_status, coalesce(l.status, 'NO_STATUS') AS rerun_status, count(*) AS n FROM fst f JOIN lst l USING (r1, r2) GROUP BY 1, 2")
R.add("rerun_support", lambda s, d: rounded(U.compare_support(_records(s, d, False), _records(s, d, True)), "mean_delta", "jaccard"), f"""WITH {_REC}, m AS (SELECT r1, r2, f.total AS b, l.total AS r FROM fst f FULL JOIN lst l USING (r1, r2)) SELECT r1, count(b) AS base_keys, count(r) AS rerun_keys, count(b - r) AS shared_keys, count(*) AS union_keys, coalesce(max(abs(b - r)), 0) AS max_delta, round(avg(abs(b - r)), 9) AS mean_delta,
round(count(b - r) / count(*), 9) AS jaccard, count(b - r) = count(*) AS same_keys, count(b - r) = count(*) AND coalesce(max(abs(b - r)), 0) = 0 AS exact_match, count(b - r) > 0 AND coalesce(max(abs(b - r)), 0) <= 1 AS near_match FROM m GROUP BY r1 HAVING count(b) > 0 AND count(r) > 0""")


def _audited(s, d):
    eta = table(s, d, "allocations").select("relation", F.col("eta_integer").alias("eta"))
    return U.relation_audit(T.relation_counts(triples(s, d)), eta)


_AUD = f"""{TRIPLES_SQL}, c AS (SELECT r, count(*) AS n FROM k GROUP BY r), a AS (SELECT relation, CAST(sum(eta_integer) AS BIGINT) AS eta, count(*) AS rows FROM allocations GROUP BY 1),
au AS MATERIALIZED (SELECT coalesce(relation, r) AS relation, coalesce(n, 0) AS actual, eta, coalesce(n, 0) - eta AS difference, CASE WHEN eta > 0 THEN coalesce(n, 0) / eta END AS ratio, CASE WHEN rows IS NULL THEN 'graph_only_missing_allocation' WHEN eta IS NULL THEN 'overlap_eta_missing' WHEN eta = 0 AND n > 0 THEN 'overlap_eta_zero_actual_present'
  WHEN eta = 0 THEN 'overlap_eta_zero_actual_absent' WHEN n IS NULL THEN 'allocation_only_absent_in_graph' WHEN n <> eta THEN 'overlap_mismatch' ELSE 'overlap_exact_match' END AS category FROM c FULL JOIN a ON relation = r),
aus AS (SELECT *, CASE WHEN category = 'overlap_exact_match' THEN 'ok' WHEN category IN ('overlap_mismatch', 'overlap_eta_zero_actual_absent') THEN 'warning' ELSE 'error' END AS status FROM au)"""
R.add("relation_audit", lambda s, d: rounded(_audited(s, d), "ratio"), f"WITH {_AUD} SELECT * REPLACE (round(ratio, 9) AS ratio) FROM aus")
R.add("relation_audit_summary", lambda s, d: U.audit_summary(_audited(s, d)), f"WITH {_AUD} SELECT status, category, count(*) AS relations, CAST(sum(actual) AS BIGINT) AS triples FROM aus GROUP BY ROLLUP (status, category)")
R.add("enriched_allocations", lambda s, d: table(s, d, "allocations").join(constraints(s, d).select("relation", "label", "datatype"), "relation", "left").select("pattern", "relation", "eta_integer", "label", "datatype"), f"WITH {PROFILE_SQL} SELECT pattern, relation, eta_integer, label, datatype FROM allocations LEFT JOIN prof USING (relation)")
R.add("composition_target_relations", lambda s, d: constraints(s, d).where(~F.col("target").eqNullSafe(F.lit("NO_WAY"))).select("relation"), f"WITH {PROFILE_SQL} SELECT relation FROM prof WHERE target IS DISTINCT FROM 'NO_WAY'")


def _provenance(s, d):
    """Pool triples by best trust: the record of lowest stage rank, how many records stand behind it."""
    rank = table(s, d, "source_trust").where("field_name = 'source_stage'").select(folded("field_value").alias("_v"), F.col("trust_rank").alias("_rk"))
    t = table(s, d, "pool_records").select("record_id", plain_id("h", "Q").alias("h"), plain_id("r", "P").alias("r"), plain_id("t", "Q").alias("t"), folded("source_stage").alias("_s")).where("h IS NOT NULL AND r IS NOT NULL AND t IS NOT NULL").distinct()
    m = t.join(rank, F.col("_s") == F.col("_v"), "left")
    return m.groupBy("h", "r", "t").agg(F.min(F.coalesce("_rk", F.lit(99))).alias("best_rank"), F.count(F.lit(1)).alias("records"))


R.add("pool_provenance", _provenance, f"""WITH p AS (SELECT DISTINCT record_id, {plain_id_sql("h", "Q")} AS h, {plain_id_sql("r", "P")} AS r, {plain_id_sql("t", "Q")} AS t, lower(regexp_replace(source_stage, '[^\\p{{L}}\\p{{M}}\\p{{N}}]+', '', 'g')) AS s FROM pool_records)
SELECT h, r, t, min(coalesce(trust_rank, 99)) AS best_rank, count(*) AS records FROM p LEFT JOIN source_trust ON field_name = 'source_stage' AND lower(regexp_replace(field_value, '[^\\p{{L}}\\p{{M}}\\p{{N}}]+', '', 'g')) = s WHERE h IS NOT NULL AND r IS NOT NULL AND t IS NOT NULL GROUP BY h, r, t""")
R.add("replacement_pool", lambda s, d: triples(s, d, "pool_records").join(triples(s, d), ["h", "r", "t"], "left_anti"), f"{K}, {POOL_SQL} SELECT * FROM pool EXCEPT SELECT * FROM k")

# swaps
def _moves(s, d):
    """Moves as last recorded, with the deficit and surplus change of removing the target and adding the candidate (independent effects)."""
    raw = table(s, d, "cut_moves").where("move_id IS NOT NULL AND cut_id IS NOT NULL").select("move_id", "cut_id", "target_r", plain_id("candidate_r", "P").alias("candidate_r"), F.when(~F.isnan("candidate_score"), F.col("candidate_score")).alias("score"), "recorded_at").distinct()
    m = U.latest(raw, ["move_id"], [F.col("recorded_at").desc_nulls_last(), F.col("score").desc_nulls_last()])
    cmp = A.compare_relations(T.relation_counts(triples(s, d)), allocations(s, d)).select("relation", (F.col("observed") - F.col("expected")).alias("_gap"))
    m = m.join(cmp.select(F.col("relation").alias("target_r"), F.col("_gap").alias("_g1")), "target_r", "left").join(cmp.select(F.col("relation").alias("candidate_r"), F.col("_gap").alias("_g2")), "candidate_r", "left")
    pos = lambda x: F.greatest(x, F.lit(0.0))
    delta = lambda g, by, sign: F.coalesce(pos(sign * (g + by)) - pos(sign * g), F.lit(0.0))
    deficit = delta(F.col("_g1"), -1, -1) + delta(F.col("_g2"), 1, -1)
    surplus = delta(F.col("_g1"), -1, 1) + delta(F.col("_g2"), 1, 1)
    return m.select("move_id", "cut_id", "target_r", "candidate_r", "score", F.round(deficit, 6).alias("deficit_delta"), F.round(surplus, 6).alias("surplus_delta"))


_MOV = f"""{TRIPLES_SQL}, {ALLOC_SQL}, c AS (SELECT r, count(*) AS n FROM k GROUP BY r), gp AS MATERIALIZED (SELECT relation, coalesce(any_value(n), 0) - sum(eta) AS g FROM alloc LEFT JOIN c ON r = relation GROUP BY relation),
mv AS (SELECT DISTINCT move_id, cut_id, target_r, {plain_id_sql("candidate_r", "P")} AS candidate_r, CASE WHEN NOT isnan(candidate_score) THEN candidate_score END AS score, recorded_at FROM cut_moves WHERE move_id IS NOT NULL AND cut_id IS NOT NULL),
la AS (SELECT * FROM mv QUALIFY row_number() OVER (PARTITION BY move_id ORDER BY recorded_at DESC NULLS LAST, score DESC NULLS LAST) = 1),
sw AS MATERIALIZED (SELECT move_id, cut_id, target_r, candidate_r, score, round(coalesce(greatest(-(a.g - 1), 0) - greatest(-a.g, 0), 0) + coalesce(greatest(-(b.g + 1), 0) - greatest(-b.g, 0), 0), 6) AS deficit_delta,
  round(coalesce(greatest(a.g - 1, 0) - greatest(a.g, 0), 0) + coalesce(greatest(b.g + 1, 0) - greatest(b.g, 0), 0), 6) AS surplus_delta FROM la LEFT JOIN gp a ON a.relation = target_r LEFT JOIN gp b ON b.relation = candidate_r)"""
R.add("swap_deltas", _moves, f"WITH {_MOV} SELECT * FROM sw")
_MORD = "deficit_delta, surplus_delta, score DESC NULLS LAST, move_id"


def _round_robin(s, d):
    """Moves in turns over their candidate relations: first the best of each relation, then the second of each, and so on."""
    order = [F.col("deficit_delta"), F.col("surplus_delta"), F.col("score").desc_nulls_last(), F.col("move_id")]
    placed = running_totals(_moves(s, d).where("candidate_r IS NOT NULL"), ["candidate_r"], order, total="turn")
    return placed.select("move_id", "candidate_r", F.col("turn").cast("int").alias("turn"))


R.add("swap_turns", _round_robin, f"WITH {_MOV} SELECT move_id, candidate_r, CAST(row_number() OVER (PARTITION BY candidate_r ORDER BY {_MORD}) AS INTEGER) AS turn FROM sw WHERE candidate_r IS NOT NULL")
R.add("swap_best", lambda s, d: _moves(s, d).orderBy("deficit_delta", "surplus_delta", F.col("score").desc_nulls_last(), "move_id").limit(1000), f"WITH {_MOV} SELECT * FROM sw ORDER BY {_MORD} LIMIT 1000")
R.add("swap_by_cut", lambda s, d: _moves(s, d).groupBy("cut_id").agg(F.count(F.lit(1)).alias("moves"), F.count_if((F.col("deficit_delta") <= 0) & (F.col("surplus_delta") <= 0)).alias("harmless_moves"), F.count_distinct("candidate_r").alias("candidate_relations")), f"WITH {_MOV} SELECT cut_id, count(*) AS moves, count(*) FILTER (WHERE deficit_delta <= 0 AND surplus_delta <= 0) AS harmless_moves, count(DISTINCT candidate_r) AS candidate_relations FROM sw GROUP BY cut_id")

QUERIES, SQL = R.queries, R.sql
