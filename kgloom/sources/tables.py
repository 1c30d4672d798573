"""The driver's tables as the operators want them: triples, allocation rows, pair counts, relation profiles.

Each reader has a twin in DuckDB SQL (``*_SQL``), a common table expression that check queries start from.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kgloom.functions.ids import plain_id, plain_id_sql
from kgloom.functions.labels import folded
from kgloom.session import cut


def table(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


def raw_triples(spark: SparkSession, d: str, name: str = "candidates") -> DataFrame:
    """(h, r, t) as a bag, plainly named; rows in which one of them names nothing are dropped."""
    t = table(spark, d, name).select(plain_id("h", "Q").alias("h"), plain_id("r", "P").alias("r"), plain_id("t", "Q").alias("t"))
    return t.where(F.col("h").isNotNull() & F.col("r").isNotNull() & F.col("t").isNotNull())


def triples(spark: SparkSession, d: str, name: str = "candidates") -> DataFrame:
    """The same as a set."""
    return raw_triples(spark, d, name).distinct()


def graph(spark: SparkSession, d: str, name: str = "candidates") -> DataFrame:
    """The same, written once for queries that read it several times."""
    return cut(triples(spark, d, name))


def allocations(spark: SparkSession, d: str) -> DataFrame:
    """(pattern, relation, eta): rows of positive budget; eta is the first of eta_integer, eta_total, eta_expected that isn't NULL."""
    eta = F.coalesce(F.col("eta_integer").cast("double"), F.col("eta_total"), F.col("eta_expected"))
    return table(spark, d, "allocations").select("pattern", F.col("relation"), eta.alias("eta")).where(F.col("eta") > 0)


def pair_rows(spark: SparkSession, d: str) -> DataFrame:
    """(r1, r2, loop, nonloop, total) per successful support row, each support_id once; a total that is missing or 0 is loop + nonloop."""
    z = lambda c: F.coalesce(F.col(c), F.lit(0))
    t = table(spark, d, "hop_support").where(folded("status") == "success")
    t = t.select("support_id", plain_id("r1", "P").alias("r1"), plain_id("r2", "P").alias("r2"), z("loop").alias("loop"), z("nonloop").alias("nonloop"), F.coalesce(F.nullif(F.col("total"), F.lit(0)), z("loop") + z("nonloop")).alias("total"))
    return t.where(F.col("r1").isNotNull() & F.col("r2").isNotNull()).distinct().drop("support_id")


def constraints(spark: SparkSession, d: str) -> DataFrame:
    """(relation, label, datatype, target, subjects, objects); type arrays that are missing, empty or hold ANY are NULL: unknown."""
    known = lambda c: F.when((F.size(c) > 0) & ~F.array_contains(c, "ANY"), F.array_sort(F.array_distinct(c)))
    t = table(spark, d, "relation_profiles")
    return t.select(F.col("property_id").alias("relation"), "label", F.nullif(F.lower(F.trim("datatype")), F.lit("")).alias("datatype"), F.col("composition_target").alias("target"), known("valid_subject_type_ids").alias("subjects"), known("valid_object_type_ids").alias("objects"))


def _triples_sql(name: str) -> str:
    return f"SELECT {plain_id_sql('h', 'Q')} AS h, {plain_id_sql('r', 'P')} AS r, {plain_id_sql('t', 'Q')} AS t FROM {name}"


RAW_SQL = f"raw AS MATERIALIZED (SELECT * FROM ({_triples_sql('candidates')}) WHERE h IS NOT NULL AND r IS NOT NULL AND t IS NOT NULL)"
TRIPLES_SQL = f"{RAW_SQL}, k AS MATERIALIZED (SELECT DISTINCT h, r, t FROM raw)"
POOL_SQL = f"pool AS MATERIALIZED (SELECT DISTINCT * FROM ({_triples_sql('pool_records')}) WHERE h IS NOT NULL AND r IS NOT NULL AND t IS NOT NULL)"
AUX_SQL = f"aux AS MATERIALIZED (SELECT DISTINCT * FROM ({_triples_sql('aux_edges')}) WHERE h IS NOT NULL AND r IS NOT NULL AND t IS NOT NULL)"
ALLOC_SQL = "alloc AS (SELECT * FROM (SELECT pattern, relation, coalesce(CAST(eta_integer AS DOUBLE), eta_total, eta_expected) AS eta FROM allocations) WHERE eta > 0)"
PAIRS_SQL = f"""prow AS (SELECT DISTINCT support_id, {plain_id_sql("r1", "P")} AS r1, {plain_id_sql("r2", "P")} AS r2, coalesce(loop, 0) AS loop, coalesce(nonloop, 0) AS nonloop,
  coalesce(nullif(total, 0), coalesce(loop, 0) + coalesce(nonloop, 0)) AS total FROM hop_support WHERE lower(trim(status)) = 'success'),
pairs AS MATERIALIZED (SELECT *, CASE WHEN total > 0 THEN loop / total ELSE 0 END AS conf_loop, CASE WHEN total > 0 THEN nonloop / total ELSE 0 END AS conf_nonloop FROM
  (SELECT r1, r2, CAST(sum(loop) AS BIGINT) AS loop, CAST(sum(nonloop) AS BIGINT) AS nonloop, CAST(sum(total) AS BIGINT) AS total FROM prow WHERE r1 IS NOT NULL AND r2 IS NOT NULL GROUP BY r1, r2))"""
PROFILE_SQL = """prof AS (SELECT property_id AS relation, label, nullif(lower(trim(datatype)), '') AS datatype, composition_target AS target,
  CASE WHEN len(valid_subject_type_ids) > 0 AND NOT list_contains(valid_subject_type_ids, 'ANY') THEN list_sort(list_distinct(valid_subject_type_ids)) END AS subjects,
  CASE WHEN len(valid_object_type_ids) > 0 AND NOT list_contains(valid_object_type_ids, 'ANY') THEN list_sort(list_distinct(valid_object_type_ids)) END AS objects FROM relation_profiles)"""
