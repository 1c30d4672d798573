"""Vectors of a group against their centre, inside the JVM."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def cosine(a: Column, b: Column) -> Column:
    """Cosine of two arrays; NULL if either is NULL, empty, of another length or zero."""
    dot = lambda x, y: F.aggregate(F.zip_with(x, y, lambda p, q: p.cast("double") * q.cast("double")), F.lit(0.0), lambda s, v: s + v)
    norm = F.sqrt(dot(a, a)) * F.sqrt(dot(b, b))
    return F.when((F.size(a) == F.size(b)) & (F.size(a) > 0) & (norm > 0), dot(a, b) / norm)


def centroids(df: DataFrame, group: str, vector: str) -> DataFrame:
    """(group, centre): mean per dimension. Averaged per (group, place), so a large group combines map-side; an array has as many elements
    as the vectors have dimensions."""
    flat = df.select(group, F.posexplode(vector).alias("_i", "_x")).groupBy(group, "_i").agg(F.avg(F.col("_x").cast("double")).alias("_m"))
    return flat.groupBy(group).agg(F.transform(F.sort_array(F.collect_list(F.struct("_i", "_m"))), lambda e: e["_m"]).alias("centre"))


def centrality(df: DataFrame, ident: str, group: str, vector: str) -> DataFrame:
    """(ident, group, centrality): cosine of each vector with the centre of its group."""
    c = centroids(df, group, vector)
    return df.join(c, group).select(ident, group, cosine(F.col(vector), F.col("centre")).alias("centrality"))


def most_central(df: DataFrame, ident: str, group: str, vector: str, k: int) -> DataFrame:
    """The ``k`` most central of each group, ties by ident."""
    m = centrality(df, ident, group, vector).where("centrality IS NOT NULL").withColumn("centrality", F.round("centrality", 6))
    return m.withColumn("place", F.row_number().over(Window.partitionBy(group).orderBy(F.col("centrality").desc(), ident))).where(F.col("place") <= k)
