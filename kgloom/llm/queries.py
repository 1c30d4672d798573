"""The registered queries of the training-data operators and their SQL twins."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kgloom.functions.ids import id_long, plain_id, plain_id_sql
from kgloom.functions.labels import FILLERS
from kgloom.llm import capping, consolidate, fusion, leakage, mixing, sentences, topn
from kgloom.session import cut


def _table(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


# p1


def _edges(spark: SparkSession, d: str) -> DataFrame:
    """One row per move_id: scope (run), contributor (relation), score, ident, written once. Deliveries of one move that differ count as the
    greatest."""
    raw = _table(spark, d, "aux_edges").where(F.col("move_id").isNotNull())
    score = F.when(~F.isnan("quality_score"), F.col("quality_score"))
    raw = raw.select(F.col("move_id").cast("long").alias("ident"), F.col("run_id").alias("scope"), plain_id("r", "P").alias("contributor"), score.alias("score"))
    one = raw.groupBy("ident").agg(F.max(F.struct("scope", "contributor", "score")).alias("x"))
    return cut(one.select("ident", "x.scope", "x.contributor", "x.score"))


def _limits(spark: SparkSession, d: str) -> DataFrame:
    """Per run the limits of the report with the latest reported_at (NULL is earliest)."""
    raw = _table(spark, d, "cap_sweep").where(F.col("run_id").isNotNull())
    pick = F.max(F.struct(F.col("reported_at"), F.col("max_per_relation"), F.col("max_share")))
    return raw.groupBy(F.col("run_id").alias("scope")).agg(pick.alias("x")).select("scope", F.col("x.max_per_relation").alias("max_count"), F.col("x.max_share").alias("max_share"))


def p1_found(spark: SparkSession, d: str) -> DataFrame:
    """Edges in excess of the limits of their run."""
    return capping.excess(_edges(spark, d), _limits(spark, d)).select(F.col("scope").alias("run_id"), F.col("ident").alias("move_id"))


def p1_shares(spark: SparkSession, d: str) -> DataFrame:
    """Per run: edges before, edges kept, edges of P17 kept and their share of what is left (NULL for a run with nothing left)."""
    edges = _edges(spark, d)
    gone = capping.excess(edges, _limits(spark, d)).select(F.col("ident").alias("_gone"))
    mark = edges.join(gone, F.col("ident") == F.col("_gone"), "left").withColumn("kept", F.col("_gone").isNull())
    p17 = F.coalesce(F.col("contributor") == "P17", F.lit(False))
    out = mark.groupBy(F.col("scope").alias("run_id")).agg(F.count(F.lit(1)).alias("edges"), F.count_if("kept").alias("kept_edges"), F.count_if(F.col("kept") & p17).alias("p17_edges"))
    return out.withColumn("p17_share", F.round(F.col("p17_edges") / F.when(F.col("kept_edges") > 0, F.col("kept_edges")), 9))


def p1_kept(spark: SparkSession, d: str) -> DataFrame:
    """The full records of the edges that stay, one per move_id and content; a NaN score comes out as NULL."""
    gone = capping.excess(_edges(spark, d), _limits(spark, d)).select(F.col("ident").alias("_gone"))
    raw = _table(spark, d, "aux_edges").where(F.col("move_id").isNotNull()).withColumn("quality_score", F.when(~F.isnan("quality_score"), F.col("quality_score"))).distinct()
    return raw.join(gone, F.col("move_id") == F.col("_gone"), "left_anti")


_P1_SQL = f"""
raw AS (SELECT DISTINCT move_id, run_id, {plain_id_sql("r", "P")} AS r, CASE WHEN NOT isnan(quality_score) THEN quality_score END AS s FROM aux_edges WHERE move_id IS NOT NULL),
lim AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY run_id ORDER BY reported_at DESC NULLS LAST) AS k FROM cap_sweep WHERE run_id IS NOT NULL) WHERE k = 1),
e AS (SELECT raw.*, lim.max_per_relation AS mx, lim.max_share AS sh, count(*) OVER (PARTITION BY raw.run_id) AS n,
      row_number() OVER (PARTITION BY raw.run_id, raw.r ORDER BY s DESC NULLS LAST, move_id) AS k FROM raw LEFT JOIN lim ON raw.run_id = lim.run_id),
m AS (SELECT *, r IS NOT NULL AND coalesce(k > least(mx, CASE WHEN NOT isnan(sh) THEN greatest(floor(sh * n), 1) END), false) AS gone FROM e)"""


# p2


def _pairs(spark: SparkSession, d: str) -> DataFrame:
    """Edges (a, b) of entity numbers; a row that joins nothing still names its entities as (a, a)."""
    raw = _table(spark, d, "entity_matches").select(id_long("h", "Q").alias("h"), id_long("t", "Q").alias("t"), F.coalesce("accepted", F.lit(True)).alias("ok"))
    joins = F.col("ok") & F.col("h").isNotNull() & F.col("t").isNotNull()
    alone = F.array(F.struct(F.col("h").alias("a"), F.col("h").alias("b")), F.struct(F.col("t").alias("a"), F.col("t").alias("b")))
    pairs = F.when(joins, F.array(F.struct(F.col("h").alias("a"), F.col("t").alias("b")))).otherwise(alone)
    return raw.select(F.explode(pairs).alias("e")).select("e.a", "e.b")


def p2_found(spark: SparkSession, d: str) -> DataFrame:
    """Every entity with the smallest entity of its group."""
    name = lambda c: F.concat(F.lit("Q"), F.col(c).cast("string"))
    return consolidate.groups(_pairs(spark, d)).select(name("grp").alias("group_id"), name("node").alias("entity_id"))


def p2_sizes(spark: SparkSession, d: str) -> DataFrame:
    """How many groups there are of each size."""
    sizes = consolidate.groups(_pairs(spark, d)).groupBy("grp").agg(F.count(F.lit(1)).alias("group_size"))
    return sizes.groupBy("group_size").agg(F.count(F.lit(1)).alias("n_groups"))


_P2_SQL = f"""
RECURSIVE m AS MATERIALIZED (SELECT CAST(substr({plain_id_sql("h", "Q")}, 2) AS BIGINT) AS h, CAST(substr({plain_id_sql("t", "Q")}, 2) AS BIGINT) AS t, coalesce(accepted, true) AS ok FROM entity_matches),
n AS MATERIALIZED (SELECT h AS v FROM m WHERE h IS NOT NULL UNION SELECT t FROM m WHERE t IS NOT NULL),
e AS MATERIALIZED (SELECT h AS a, t AS b FROM m WHERE ok AND h <> t UNION SELECT t, h FROM m WHERE ok AND h <> t),
g(v, label) USING KEY (v) AS (
  SELECT v, v FROM n
  UNION
  SELECT e.b, min(g.label) FROM g JOIN e ON g.v = e.a JOIN recurring.g AS r ON r.v = e.b WHERE g.label < r.label GROUP BY e.b)"""


# p4


def _records(spark: SparkSession, d: str) -> DataFrame:
    raw = _table(spark, d, "pool_records")
    return raw.select(id_long("h", "Q").alias("g0"), id_long("r", "P").alias("g1"), id_long("t", "Q").alias("g2"), "record_id", "source_stage", "provenance_type", "source_path", "retrieved_at", "source_event_type")


def p4_found(spark: SparkSession, d: str) -> DataFrame:
    """The surviving record of each triple and the records its three fields are taken from."""
    return fusion.representatives(_records(spark, d), _table(spark, d, "source_trust"))


def p4_fused(spark: SparkSession, d: str) -> DataFrame:
    """The value of maximum posterior for each field of each triple, sources being the event types that report it."""
    out = fusion.fuse(_records(spark, d), "source_event_type")
    q = lambda c, x: F.concat(F.lit(x), F.col(c).cast("string"))
    return out.select(q("g0", "Q").alias("h"), q("g1", "P").alias("r"), q("g2", "Q").alias("t"), "field", "value", F.round("probability", 6).alias("probability"))


_FOLD = "lower(regexp_replace({0}, '[^\\p{{L}}\\p{{M}}\\p{{N}}]+', '', 'g'))"
_FILLERS = "(" + ", ".join(f"'{x}'" for x in FILLERS) + ")"


def _best_sql(ok: str, first: str) -> str:
    return f"coalesce(arg_max(record_id, ROW({first}, at_us, -record_id)) FILTER (WHERE {ok}), 0)"


_P4_SQL = f"""
WITH r0 AS (SELECT DISTINCT record_id, {plain_id_sql("h", "Q")} AS h, {plain_id_sql("r", "P")} AS r, {plain_id_sql("t", "Q")} AS t,
  {_FOLD.format("source_stage")} AS s, {_FOLD.format("provenance_type")} AS p, {_FOLD.format("source_path")} AS w,
  coalesce(CASE WHEN regexp_matches(trim(retrieved_at), '^[0-9.]+$') THEN CAST(CAST(retrieved_at AS DOUBLE) * 1000000 AS BIGINT)
       ELSE epoch_us(CAST(CASE WHEN regexp_matches(retrieved_at, '(Z|[+-][0-9]{{2}}:[0-9]{{2}})$') THEN retrieved_at ELSE retrieved_at || 'Z' END AS TIMESTAMPTZ)) END, -4611686018427387904) AS at_us
  FROM pool_records WHERE record_id IS NOT NULL),
r1 AS (SELECT r0.*, coalesce(s NOT IN {_FILLERS}, false) AS us, coalesce(p NOT IN {_FILLERS}, false) AS up, coalesce(w NOT IN {_FILLERS}, false) AS uw,
  coalesce(a.trust_rank, 1099511627776) AS rs, coalesce(b.trust_rank, 1099511627776) AS rp FROM r0
  LEFT JOIN source_trust a ON a.field_name = 'source_stage' AND {_FOLD.format("a.field_value")} = s
  LEFT JOIN source_trust b ON b.field_name = 'provenance_type' AND {_FOLD.format("b.field_value")} = p
  WHERE h IS NOT NULL AND r IS NOT NULL AND t IS NOT NULL)
SELECT min(record_id) AS group_record_id, {_best_sql("true", "us::INT + up::INT + uw::INT")} AS survivor_record_id, {_best_sql("us", "-rs")} AS stage_record_id,
  {_best_sql("up", "-rp")} AS provenance_record_id, {_best_sql("uw", "0")} AS path_record_id
FROM r1 GROUP BY h, r, t HAVING count(DISTINCT record_id) > 1"""


# p5


def p5_found(spark: SparkSession, d: str) -> DataFrame:
    """The up to five best moves of each cut, as last recorded."""
    raw = _table(spark, d, "cut_moves").where(F.col("cut_id").isNotNull())
    now = topn.latest_state(raw, "move_id", "recorded_at", "cut_id", "candidate_score")
    return topn.top_n(now, 5, "cut_id", "candidate_score", "move_id", "selection_rank")


# p6


def p6_found(spark: SparkSession, d: str) -> DataFrame:
    """Documents with the evaluation items that leaked into them."""
    return leakage.contaminated(_table(spark, d, "documents"), _table(spark, d, "eval_items"))


def p6_coverage(spark: SparkSession, d: str) -> DataFrame:
    """How much of each affected document is leaked, and whether to drop it or cut the runs out."""
    return leakage.coverage(_table(spark, d, "documents"), _table(spark, d, "eval_items"))


def p6_cleaned(spark: SparkSession, d: str) -> DataFrame:
    """Every affected document without its leaked runs; NULL text where so much is leaked that the document is to be dropped."""
    return leakage.cleaned(_table(spark, d, "documents"), _table(spark, d, "eval_items"))


# p7


def p7_mix(spark: SparkSession, d: str) -> DataFrame:
    """Every document of the mix with its tokens and how often it is used."""
    return mixing.mix(_table(spark, d, "documents"), _table(spark, d, "mix_targets"))[0]


def p7_shares(spark: SparkSession, d: str) -> DataFrame:
    """What each source was asked for and what it reached."""
    return mixing.mix(_table(spark, d, "documents"), _table(spark, d, "mix_targets"))[1]


# p8


def p8_found(spark: SparkSession, d: str) -> DataFrame:
    """Offsets of the sentence units of every document."""
    return sentences.sentences(_table(spark, d, "documents"))


SQL = {
    "p1_found": f"WITH {_P1_SQL} SELECT run_id, move_id FROM m WHERE gone",
    "p1_shares": f"""WITH {_P1_SQL} SELECT run_id, count(*) AS edges, count(*) FILTER (WHERE NOT gone) AS kept_edges, count(*) FILTER (WHERE NOT gone AND r = 'P17') AS p17_edges,
  round(count(*) FILTER (WHERE NOT gone AND r = 'P17') / nullif(count(*) FILTER (WHERE NOT gone), 0), 9) AS p17_share FROM m GROUP BY run_id""",
    "p1_kept": f"WITH {_P1_SQL} SELECT DISTINCT a.* REPLACE (CASE WHEN NOT isnan(quality_score) THEN quality_score END AS quality_score) FROM aux_edges a WHERE move_id IN (SELECT move_id FROM m WHERE NOT gone)",
    "p2_found": f"WITH {_P2_SQL} SELECT 'Q' || label AS group_id, 'Q' || v AS entity_id FROM g",
    "p2_sizes": f"WITH {_P2_SQL} SELECT group_size, count(*) AS n_groups FROM (SELECT label, count(*) AS group_size FROM g GROUP BY label) GROUP BY group_size",
    "p4_found": _P4_SQL,
    "p5_found": """
WITH l AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY move_id ORDER BY recorded_at DESC NULLS LAST, cut_id DESC NULLS LAST, candidate_score DESC NULLS LAST) AS k
  FROM cut_moves WHERE cut_id IS NOT NULL AND move_id IS NOT NULL) WHERE k = 1),
r AS (SELECT cut_id, move_id, row_number() OVER (PARTITION BY cut_id ORDER BY candidate_score DESC, move_id) AS selection_rank
  FROM l WHERE candidate_score IS NOT NULL AND NOT isnan(candidate_score))
SELECT * FROM r WHERE selection_rank <= 5""",
}

QUERIES = {f.__name__: f for f in (p1_found, p1_shares, p1_kept, p2_found, p2_sizes, p4_found, p4_fused, p5_found, p6_found, p6_coverage, p6_cleaned, p7_mix, p7_shares, p8_found)}
