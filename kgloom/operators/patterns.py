"""Relation patterns from pair counts: confidences, selections, Wilson bounds, composition classes, pattern groups."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def pair_confidence(rows: DataFrame) -> DataFrame:
    """(r1, r2, loop, nonloop, total, conf_loop, conf_nonloop) from rows of counts; a confidence without total is 0."""
    s = rows.groupBy("r1", "r2").agg(*[F.sum(c).alias(c) for c in ("loop", "nonloop", "total")])
    share = lambda c: F.when(F.col("total") > 0, F.col(c) / F.col("total")).otherwise(F.lit(0.0))
    return s.withColumns({"conf_loop": share("loop"), "conf_nonloop": share("nonloop")})


def within(pairs: DataFrame, least: int, most: int, focus: str = "") -> DataFrame:
    """Pairs whose total lies in [least, most]; with ``focus`` only those that name it."""
    if most < least:
        raise ValueError("most must not be below least")
    out = pairs.where(F.col("total").between(least, most))
    return out.where((F.col("r1") == focus) | (F.col("r2") == focus)) if focus else out


def self_pairs(pairs: DataFrame, confidence: str, support: int, at_least: float) -> DataFrame:
    """Relations followed by themselves with enough support and ``confidence`` (conf_loop: symmetric, conf_nonloop: anti-symmetric)."""
    return pairs.where((F.col("r1") == F.col("r2")) & (F.col("total") >= support) & (F.col(confidence) >= at_least))


def inverse_table(pairs: DataFrame) -> DataFrame:
    """Pairs r1 ≠ r2 with the loop confidence and total of the reverse pair (0 if there is none), their minimum and mean."""
    base = pairs.where("r1 <> r2").select("r1", "r2", "loop", "nonloop", "total", "conf_loop")
    rev = base.select(F.col("r2").alias("r1"), F.col("r1").alias("r2"), F.col("conf_loop").alias("_c"), F.col("total").alias("_t"))
    out = base.join(rev, ["r1", "r2"], "left").withColumns({"reverse_conf_loop": F.coalesce("_c", F.lit(0.0)), "reverse_total": F.coalesce("_t", F.lit(0))})
    both = (F.col("conf_loop") + F.col("reverse_conf_loop")) / 2
    return out.drop("_c", "_t").withColumns({"conf_min": F.least("conf_loop", "reverse_conf_loop"), "conf_mean": both})


def inverse_pairs(pairs: DataFrame, support: int, at_least: float) -> DataFrame:
    t = inverse_table(pairs).withColumn("support_min", F.least("total", "reverse_total"))
    return t.where((F.col("support_min") >= support) & (F.col("conf_min") >= at_least))


def wilson(successes: Column, n: Column, z: float) -> tuple[Column, Column]:
    """Bounds of the Wilson score interval; (0, 1) for n ≤ 0."""
    n = n.cast("double")
    p = successes / n
    z2 = z * z
    centre = (p + z2 / (2 * n)) / (1 + z2 / n)
    margin = (z / (1 + z2 / n)) * F.sqrt(p * (1 - p) / n + z2 / (4 * n * n))
    low = F.when(n > 0, F.greatest(F.lit(0.0), centre - margin)).otherwise(F.lit(0.0))
    return low, F.when(n > 0, F.least(F.lit(1.0), centre + margin)).otherwise(F.lit(1.0))


def filter_compositions(comp: DataFrame, examined: int, shortcuts: int, at_least: float, z: float = 1.96, by_bound: bool = False, focus: str = "") -> DataFrame:
    """Composition rows over the thresholds with their Wilson bounds and class; ``by_bound``: the lower bound must reach ``at_least`` too."""
    low, high = wilson(F.col("shortcuts"), F.col("examined"), z)
    out = comp.where((F.col("examined") >= examined) & (F.col("shortcuts") >= shortcuts) & (F.col("confidence") >= at_least)).withColumns({"wilson_low": low, "wilson_high": high})
    if by_bound:
        out = out.where(F.col("wilson_low") >= at_least)
    if focus:
        out = out.where((F.col("r1") == focus) | (F.col("r2") == focus) | (F.col("r3") == focus))
    return classify(out)


def classify(comp: DataFrame) -> DataFrame:
    """Class of each accepted composition: of a relation with itself, order-free (the swapped pair is accepted for the same target), other."""
    swap = comp.select(F.col("r2").alias("r1"), F.col("r1").alias("r2"), "r3", F.lit(True).alias("_s"))
    out = comp.join(swap, ["r1", "r2", "r3"], "left").withColumn("swapped_too", F.coalesce("_s", F.lit(False))).drop("_s")
    same = (F.col("r1") == F.col("r2")) & (F.col("r2") == F.col("r3"))
    kind = F.when(same, "transitive_self_composition").when(F.col("swapped_too"), "non_transitive_commutative_composition").otherwise("non_transitive_non_commutative_composition")
    return out.withColumn("composition_class", kind)


def pattern_groups(symmetric: DataFrame, anti: DataFrame, inverse: DataFrame, comp: DataFrame) -> DataFrame:
    """(pattern, relation), each once; relations that are symmetric are left out of anti_symmetric."""
    named = lambda df, cols, p: df.select(F.explode(F.array(*cols)).alias("relation")).distinct().select(F.lit(p).alias("pattern"), "relation")
    sym = named(symmetric, ["r1"], "symmetric")
    non = named(anti, ["r1"], "anti_symmetric").join(sym.select("relation"), "relation", "left_anti").select("pattern", "relation")
    return sym.unionByName(non).unionByName(named(inverse, ["r1", "r2"], "inverse")).unionByName(named(comp, ["r1", "r2", "r3"], "composition"))


def group_matrix(groups: DataFrame, patterns: list[str]) -> DataFrame:
    """Relation × pattern as 0/1 columns."""
    return groups.groupBy("relation").agg(*[F.max((F.col("pattern") == p).cast("int")).alias(p) for p in patterns])
