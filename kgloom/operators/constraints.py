"""Domain and range constraints of relations; NULL arrays mean "unknown" and pass."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def overlap_reason(a: Column, b: Column, a_name: str, b_name: str) -> Column:
    """INTERSECT, EMPTY or which side is unknown."""
    return F.when(a.isNull() & b.isNull(), f"ANY_{a_name}_AND_{b_name}").when(a.isNull(), f"ANY_{a_name}").when(b.isNull(), f"ANY_{b_name}").when(F.arrays_overlap(a, b), "INTERSECT").otherwise("EMPTY")


def compatible(a: Column, b: Column) -> Column:
    return a.isNull() | b.isNull() | F.arrays_overlap(a, b)


def type_check(subject_types: Column, object_types: Column, head: Column, tail: Column) -> Column:
    """Three-valued: NULL if a constraint or an entity's types are unknown, else whether both sides overlap."""
    known = subject_types.isNotNull() & object_types.isNotNull() & head.isNotNull() & tail.isNotNull()
    return F.when(known, F.arrays_overlap(subject_types, head) & F.arrays_overlap(object_types, tail))


def _cells(profiles: DataFrame, side: str, relation: str, type_: str) -> DataFrame:
    """(relation, type) with one row of type NULL where the side is unknown."""
    return profiles.select(F.col("relation").alias(relation), F.explode_outer(side).alias(type_))


def _compatible_pairs(left: DataFrame, right: DataFrame, side_l: str, side_r: str) -> DataFrame:
    """(l, r) of compatible relations. Known sides meet in an equi-join on the type; unknown ones pass with everybody, which is what the
    rule says, so their number decides the size of the result."""
    a, b = _cells(left, side_l, "l", "_ta"), _cells(right, side_r, "r", "_tb")
    both = a.join(b, F.col("_ta") == F.col("_tb")).select("l", "r")
    free_l = left.where(F.col(side_l).isNull()).select(F.col("relation").alias("l"), F.lit(1).alias("_k"))
    free_r = right.where(F.col(side_r).isNull()).select(F.col("relation").alias("r"), F.lit(1).alias("_k"))
    all_l, all_r = left.select(F.col("relation").alias("l"), F.lit(1).alias("_k")), right.select(F.col("relation").alias("r"), F.lit(1).alias("_k"))
    return both.unionByName(free_l.join(all_r, "_k").drop("_k")).unionByName(all_l.join(free_r, "_k").drop("_k")).distinct()


def composition_targets(pairs: DataFrame, profiles: DataFrame) -> DataFrame:
    """(r1, r2, target): relations whose domain is compatible with r1's domain and whose range with r2's range.

    Targets are the profiles whose composition target isn't NO_WAY (NULL passes). Relations without profile have no constraints known. Both
    compatibilities are computed once between relations and then joined to the pairs; the pairs are never crossed with the targets.
    """
    t = profiles.where(~F.col("target").eqNullSafe(F.lit("NO_WAY")))
    dom = _compatible_pairs(profiles, t, "subjects", "subjects").select(F.col("l").alias("r1"), F.col("r").alias("target"))
    rng = _compatible_pairs(profiles, t, "objects", "objects").select(F.col("l").alias("r2"), F.col("r").alias("target"))
    return pairs.select("r1", "r2").distinct().join(dom, "r1").join(rng, ["r2", "target"]).select("r1", "r2", "target")


def relation_class(profiles: DataFrame) -> DataFrame:
    s, o = F.col("subjects").isNull(), F.col("objects").isNull()
    return profiles.select("relation", F.when(s & o, "ANY_BOTH").when(s, "ANY_SUBJECT").when(o, "ANY_DOMAIN").otherwise("FULL_BOTH").alias("dom_rng_class"))


def unlock_graph(profiles: DataFrame) -> DataFrame:
    """(a, b, weight): Jaccard of a's objects with b's subjects plus Jaccard of a's subjects with b's objects, a ≠ b, weight > 0.

    Overlaps come from an equi-join on the type, sizes from the arrays."""
    size = lambda c: F.coalesce(F.size(c), F.lit(0))

    def jaccard(x: str, y: str) -> DataFrame:
        a = profiles.where(F.col(x).isNotNull()).select(F.col("relation").alias("a"), F.explode(x).alias("_t"), size(x).alias("_na"))
        b = profiles.where(F.col(y).isNotNull()).select(F.col("relation").alias("b"), F.explode(y).alias("_t"), size(y).alias("_nb"))
        m = a.join(b, "_t").where("a <> b").groupBy("a", "b").agg(F.count(F.lit(1)).alias("_i"), F.first("_na").alias("_na"), F.first("_nb").alias("_nb"))
        return m.select("a", "b", (F.col("_i") / (F.col("_na") + F.col("_nb") - F.col("_i"))).alias("w"))

    return jaccard("objects", "subjects").unionByName(jaccard("subjects", "objects")).groupBy("a", "b").agg(F.sum("w").alias("weight"))


def type_graph(profiles: DataFrame) -> DataFrame:
    """(a, b, shared): number of types that are objects of a and subjects of b."""
    a = profiles.select(F.col("relation").alias("a"), F.explode("objects").alias("_t"))
    b = profiles.select(F.col("relation").alias("b"), F.explode("subjects").alias("_t"))
    return a.join(b, "_t").where("a <> b").groupBy("a", "b").agg(F.count(F.lit(1)).alias("shared"))


def datatype_counts(pairs: DataFrame, profiles: DataFrame) -> DataFrame:
    """Per r1 its distinct r2 by whether the profile is missing, an item relation, another or of unknown datatype."""
    p = profiles.select(F.col("relation").alias("r2"), "datatype", F.lit(True).alias("_has"))
    m = pairs.select("r1", "r2").distinct().join(p, "r2", "left")
    has = F.col("_has").isNotNull()
    item = F.coalesce(F.col("datatype") == "wikibase-item", F.lit(False))
    return m.groupBy("r1").agg(F.count_if(~has).alias("missing"), F.count_if(item).alias("items"), F.count_if(has & F.col("datatype").isNotNull() & ~item).alias("others"), F.count_if(has & F.col("datatype").isNull()).alias("unknown"))
