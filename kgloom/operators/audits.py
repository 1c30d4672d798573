"""Audits: numbers of a column, distributions per relation, base against rerun, graph against allocation."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from kgloom.operators.skew import value_frequencies, weighted_percentiles

POINTS = (0.1, 0.2, 0.25, 0.3, 0.4, 0.5, 0.6, 0.7, 0.75, 0.8, 0.9, 0.95, 0.99)


def numeric_summary(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Per column: count, min, linear percentiles, max, mean, population and sample deviation of its values (NULL and NaN left out).

    The columns become rows and these (column, value, frequency) first; percentiles come from range pieces of the values, so no task holds
    all values of a column."""
    flat = df.select(F.explode(F.array(*[F.struct(F.lit(c).alias("name"), F.col(c).cast("double").alias("x")) for c in columns])).alias("e")).select("e.*")
    flat = flat.where(F.col("x").isNotNull() & ~F.isnan("x"))
    out = flat.groupBy("name").agg(F.count(F.lit(1)).alias("n"), F.min("x").alias("min_x"), F.max("x").alias("max_x"), F.round(F.avg("x"), 6).alias("mean_x"), F.round(F.stddev_pop("x"), 6).alias("stdev_pop"), F.round(F.stddev_samp("x"), 6).alias("stdev_samp"))
    spread = weighted_percentiles(value_frequencies(flat, ["name"], "x"), ["name"], "x", POINTS, linear=True)
    wide = spread.groupBy(F.col("name").alias("_name")).agg(*[F.max(F.when(F.col("q") == q, F.round("value", 9))).alias(f"p{round(q * 100)}") for q in POINTS])
    return out.join(wide, F.col("name") == F.col("_name")).drop("_name")


def support_shape(pairs: DataFrame) -> DataFrame:
    """Per r1 over its r2 (r1, r2, total): followers, with support, total support, shares of the first and the ten strongest, entropy, self share.

    The ten strongest are cut map-side before the sum; entropy is ln(S) − Σ c·ln(c)/S, which adds up in any order.
    """
    c = F.greatest(F.col("total"), F.lit(0))
    pos = pairs.select("r1", "r2", c.alias("c"))
    base = pos.groupBy("r1").agg(F.count(F.lit(1)).alias("followers"), F.count_if(F.col("c") > 0).alias("followers_with_support"), F.sum("c").alias("support"), F.max("c").alias("_top"), F.sum(F.when(F.col("c") > 0, F.col("c") * F.log("c")).otherwise(F.lit(0.0))).alias("_cl"), F.sum(F.when(F.col("r1") == F.col("r2"), F.col("c")).otherwise(F.lit(0))).alias("_self"))
    place = F.row_number().over(Window.partitionBy("r1").orderBy(F.col("c").desc(), "r2"))
    ten = pos.withColumn("_k", place).where(F.col("_k") <= 10).groupBy(F.col("r1").alias("_r")).agg(F.sum("c").alias("_ten"))
    share = lambda x: F.when(F.col("support") > 0, F.col(x) / F.col("support")).otherwise(F.lit(0.0))
    ent = F.when(F.col("support") > 0, F.log("support") - F.col("_cl") / F.col("support")).otherwise(F.lit(0.0))
    return base.join(ten, F.col("r1") == F.col("_r")).select("r1", "followers", "followers_with_support", "support", share("_top").alias("top1_share"), share("_ten").alias("top10_share"), ent.alias("entropy"), share("_self").alias("self_share"))


def latest(df: DataFrame, keys: Sequence[str], order: Sequence[Column]) -> DataFrame:
    """The last row per key in the given order (given descending)."""
    return df.withColumn("_k", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where(F.col("_k") == 1).drop("_k")


def upsert(base: DataFrame, rerun: DataFrame, keys: Sequence[str], status: str, failed: str = "ERROR") -> DataFrame:
    """``base`` with the rows of ``rerun`` in place of those with the same keys, new keys added; a failure never replaces a failure."""
    b = base.select(F.struct(*base.columns).alias("_b"), *[F.col(k).alias(f"_k{i}") for i, k in enumerate(keys)])
    r = rerun.select(F.struct(*base.columns).alias("_r"), *[F.col(k).alias(f"_k{i}") for i, k in enumerate(keys)])
    both = b.join(r, [f"_k{i}" for i in range(len(keys))], "full")
    stay = F.col("_r").isNull() | (F.col("_b").isNotNull() & (F.col(f"_b.{status}") == failed) & (F.col(f"_r.{status}") == failed))
    return both.select(F.when(stay, F.col("_b")).otherwise(F.col("_r")).alias("x")).select("x.*")


def transitions(base: DataFrame, rerun: DataFrame, keys: Sequence[str], status: str) -> DataFrame:
    """(base_status, rerun_status, n) over the rerun keys; keys that base lacks have base_status MISSING."""
    b = base.select(*keys, F.col(status).alias("_b"))
    m = rerun.select(*keys, F.coalesce(F.col(status), F.lit("NO_STATUS")).alias("rerun_status")).join(b.withColumn("_has", F.lit(True)), list(keys), "left")
    base_status = F.when(F.col("_has").isNull(), "MISSING").otherwise(F.coalesce("_b", F.lit("NO_STATUS")))
    return m.groupBy(base_status.alias("base_status"), "rerun_status").agg(F.count(F.lit(1)).alias("n"))


def compare_support(base: DataFrame, rerun: DataFrame) -> DataFrame:
    """Per r1 present in both (r1, r2, total): key counts, shared, Jaccard, same keys, exact and ±1 match, largest and mean difference."""
    b, r = base.select("r1", "r2", F.col("total").alias("_b")), rerun.select("r1", "r2", F.col("total").alias("_r"))
    m = b.join(r, ["r1", "r2"], "full")
    d = F.abs(F.col("_b") - F.col("_r"))
    out = m.groupBy("r1").agg(F.count("_b").alias("base_keys"), F.count("_r").alias("rerun_keys"), F.count(d).alias("shared_keys"), F.count(F.lit(1)).alias("union_keys"), F.coalesce(F.max(d), F.lit(0)).alias("max_delta"), F.avg(d).alias("mean_delta"))
    out = out.where((F.col("base_keys") > 0) & (F.col("rerun_keys") > 0))
    same = F.col("shared_keys") == F.col("union_keys")
    return out.withColumns({"jaccard": F.col("shared_keys") / F.col("union_keys"), "same_keys": same, "exact_match": same & (F.col("max_delta") == 0), "near_match": (F.col("shared_keys") > 0) & (F.col("max_delta") <= 1)})


def relation_audit(counts: DataFrame, alloc: DataFrame) -> DataFrame:
    """Graph against allocation, full outer: category, status and difference. ``counts``: r, n; ``alloc``: relation, eta (NULL if none)."""
    c, a = counts.select(F.col("r").alias("relation"), "n"), alloc.groupBy("relation").agg(F.sum("eta").alias("eta"), F.count(F.lit(1)).alias("rows"))
    m = c.join(a, "relation", "full").withColumn("actual", F.coalesce("n", F.lit(0)))
    eta = F.col("eta")
    category = (
        F.when(F.col("rows").isNull(), "graph_only_missing_allocation")
        .when(eta.isNull(), "overlap_eta_missing")
        .when((eta == 0) & (F.col("actual") > 0), "overlap_eta_zero_actual_present")
        .when(eta == 0, "overlap_eta_zero_actual_absent")
        .when(F.col("actual") == 0, "allocation_only_absent_in_graph")
        .when(F.col("actual") != eta, "overlap_mismatch")
        .otherwise("overlap_exact_match")
    )
    m = m.withColumn("category", category)
    status = F.when(F.col("category").isin("overlap_exact_match"), "ok").when(F.col("category").isin("overlap_mismatch", "overlap_eta_zero_actual_absent"), "warning").otherwise("error")
    return m.select("relation", "actual", "eta", (F.col("actual") - eta).alias("difference"), F.when(eta > 0, F.col("actual") / eta).alias("ratio"), "category", status.alias("status"))


def audit_summary(audited: DataFrame) -> DataFrame:
    """Relations per status and category, per status and in all, in one pass."""
    return audited.rollup("status", "category").agg(F.count(F.lit(1)).alias("relations"), F.sum("actual").alias("triples"))
