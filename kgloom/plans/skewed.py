"""p3: per-relation results of ``candidates`` (by r) and ``hop_support`` (by r1), where a handful of relations hold most rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kgloom.functions.ids import plain_id, plain_id_sql
from kgloom.operators import skew


def _table(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


def _spellings(spark: SparkSession, d: str) -> DataFrame:
    """Frequencies of the relation as spelled, per table; each distinct spelling is read once, after compression."""
    both = _table(spark, d, "candidates").select(F.lit("candidates").alias("table_name"), F.col("r").alias("spelling")).unionByName(
        _table(spark, d, "hop_support").select(F.lit("hop_support").alias("table_name"), F.col("r1").alias("spelling"))
    )
    return skew.value_frequencies(both, ["table_name"], "spelling").withColumn("key_value", plain_id("spelling", "P"))


def p3_found(spark: SparkSession, d: str) -> DataFrame:
    """Relations that hold at least 4 of every 100 rows of their table."""
    return skew.heavy_keys(_spellings(spark, d), "table_name", "key_value", 4, 100).select("table_name", "key_value")


def _merged(spark: SparkSession, d: str, table: str, relation: str, value: str, letter: str | None = None) -> DataFrame:
    """(relation, value, freq): compressed as spelled, then named plainly and merged."""
    raw = skew.value_frequencies(_table(spark, d, table).select(F.col(relation).alias("_r"), F.col(value).alias("_v")), ["_r"], "_v")
    v = F.col("_v") if letter is None else plain_id("_v", letter)
    named = raw.select(plain_id("_r", "P").alias("relation"), v.alias("value"), "freq")
    return skew.merged_frequencies(named, ["relation"], "value")


def p3_candidate_entities(spark: SparkSession, d: str) -> DataFrame:
    """Per relation of ``candidates``: rows, rows with a head, exact distinct heads, the most frequent head; NULL relation is a row too."""
    out = skew.profile(_merged(spark, d, "candidates", "r", "h", "Q"), ["relation"], "value")
    return out.withColumnRenamed("n_values", "n_heads").withColumnRenamed("n_distinct", "n_distinct_heads").withColumnRenamed("mode_value", "top_head")


def p3_candidate_tails(spark: SparkSession, d: str) -> DataFrame:
    """The same for tails."""
    out = skew.profile(_merged(spark, d, "candidates", "r", "t", "Q"), ["relation"], "value")
    return out.withColumnRenamed("n_values", "n_tails").withColumnRenamed("n_distinct", "n_distinct_tails").withColumnRenamed("mode_value", "top_tail")


def p3_hop_support(spark: SparkSession, d: str) -> DataFrame:
    """Per r1 of ``hop_support``: rows, rows with a total, distinct totals, mode, sum, extremes of ``total`` as it stands."""
    out = skew.profile(_merged(spark, d, "hop_support", "r1", "total"), ["relation"], "value", numeric=True)
    return out.drop("mean_value")


POINTS = (0.0, 0.25, 0.5, 0.9, 0.99, 1.0)


def p3_quality_percentiles(spark: SparkSession, d: str) -> DataFrame:
    """Per relation of ``candidates`` the exact quality_score at six places, from weighted values in range pieces."""
    return skew.weighted_percentiles(_merged(spark, d, "candidates", "r", "quality_score"), ["relation"], "value", POINTS)


QUERIES = {f.__name__: f for f in (p3_found, p3_candidate_entities, p3_candidate_tails, p3_hop_support, p3_quality_percentiles)}


def _entities_sql(col: str, plural: str, one: str) -> str:
    return f"""
WITH c AS (SELECT {plain_id_sql("r", "P")} AS relation, {plain_id_sql(col, "Q")} AS v FROM candidates),
f AS (SELECT relation, v, count(*) AS n FROM c GROUP BY ALL),
m AS (SELECT relation, v, row_number() OVER (PARTITION BY relation ORDER BY n DESC, v) AS k FROM f WHERE v IS NOT NULL),
a AS (SELECT relation, count(*) AS n_rows, count(v) AS n_{plural}, count(DISTINCT v) AS n_distinct_{plural} FROM c GROUP BY relation)
SELECT a.*, m.v AS top_{one} FROM a LEFT JOIN m ON a.relation IS NOT DISTINCT FROM m.relation AND m.k = 1"""


SQL = {
    "p3_found": f"""
WITH u AS (SELECT 'candidates' AS table_name, {plain_id_sql("r", "P")} AS key_value FROM candidates
           UNION ALL SELECT 'hop_support', {plain_id_sql("r1", "P")} FROM hop_support),
t AS (SELECT table_name, count(*) AS total FROM u GROUP BY 1)
SELECT u.table_name, key_value FROM u JOIN t USING (table_name) WHERE key_value IS NOT NULL
GROUP BY u.table_name, key_value, total HAVING count(*) * 100 >= total * 4""",
    "p3_candidate_entities": _entities_sql("h", "heads", "head"),
    "p3_candidate_tails": _entities_sql("t", "tails", "tail"),
    "p3_hop_support": f"""
WITH c AS (SELECT {plain_id_sql("r1", "P")} AS relation, total AS v FROM hop_support),
f AS (SELECT relation, v, count(*) AS n FROM c GROUP BY ALL),
m AS (SELECT relation, v, row_number() OVER (PARTITION BY relation ORDER BY n DESC, v) AS k FROM f WHERE v IS NOT NULL),
a AS (SELECT relation, count(*) AS n_rows, count(v) AS n_values, count(DISTINCT v) AS n_distinct, CAST(sum(v) AS BIGINT) AS sum_value,
      min(v) AS min_value, max(v) AS max_value FROM c GROUP BY relation)
SELECT a.*, m.v AS mode_value FROM a LEFT JOIN m ON a.relation IS NOT DISTINCT FROM m.relation AND m.k = 1""",
    "p3_quality_percentiles": f"""
WITH c AS (SELECT {plain_id_sql("r", "P")} AS relation, quality_score AS v FROM candidates WHERE quality_score IS NOT NULL AND NOT isnan(quality_score)),
s AS (SELECT relation, v, row_number() OVER (PARTITION BY relation ORDER BY v) - 1 AS k, count(*) OVER (PARTITION BY relation) AS n FROM c),
q AS (SELECT unnest([{", ".join(f"{p}::DOUBLE" for p in POINTS)}]) AS q)
SELECT relation, q, v AS "value" FROM s, q WHERE k = CAST(floor(q * (n - 1)) AS BIGINT)""",
}
