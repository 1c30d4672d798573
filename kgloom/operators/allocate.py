"""Integer budgets: softmax shares, largest remainder, and the ways to attribute observed triples to patterns."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def softmax(x: Column, group: list[str], temperature: float) -> Column:
    """exp(x/τ) over its sum in the group, shifted by the maximum. Groups are patterns: windows of a few hundred relations."""
    w = Window.partitionBy(*group)
    e = F.exp(x / temperature - F.max(x / temperature).over(w))
    return e / F.sum(e).over(w)


def largest_remainder(df: DataFrame, group: list[str], expected: str, total: str, tie: list[Column], out: str = "apportioned") -> DataFrame:
    """``df`` with ``expected`` rounded to whole numbers that add up to ``total`` per group.

    Everybody gets the floor; what is missing goes to the largest fractions (equal at 12 digits: by ``tie``), one each, in turns; what is
    too much is taken in turns from the smallest fractions that have one left. A total below 0 counts as 0, a NULL total takes part in nothing.
    """
    base = F.floor(expected)
    frac = F.round(F.col(expected) - base, 12)
    w = Window.partitionBy(*group)
    df = df.withColumns({"_base": base, "_m": F.count(F.lit(1)).over(w), "_left": F.greatest(F.col(total).cast("long"), F.lit(0)) - F.sum(base).over(w)})
    m, left, need = F.col("_m"), F.col("_left"), -F.col("_left")
    df = df.withColumn("_place", F.row_number().over(w.orderBy(frac.desc(), *tie)))
    # whole turns of taking: the most that stay within the excess, whichever members run out before
    by_size = w.orderBy("_base", *tie)
    smaller = F.coalesce(F.sum("_base").over(by_size.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    df = df.withColumn("_turns", F.floor((need - smaller) / (m - F.row_number().over(by_size) + 1)))
    df = df.withColumn("_turns", F.greatest(F.max("_turns").over(w), F.lit(0)))
    df = df.withColumn("_rest", need - F.sum(F.least("_base", "_turns")).over(w))
    df = df.withColumn("_low", F.row_number().over(w.orderBy((F.col("_base") <= F.col("_turns")).cast("int"), frac, *tie)))
    given = F.floor(left / m) + (F.col("_place") <= F.pmod(left, m)).cast("long")
    taken = F.least("_base", "_turns") + ((F.col("_base") > F.col("_turns")) & (F.col("_low") <= F.col("_rest"))).cast("long")
    value = F.when(left >= 0, F.col("_base") + given).otherwise(F.col("_base") - taken)
    return df.withColumn(out, value.cast("long")).drop("_base", "_m", "_left", "_place", "_turns", "_rest", "_low")


def allocate(matrix: DataFrame, groups: DataFrame, eta: int, temperature: float, epsilon: float = 0.0) -> DataFrame:
    """Budget of each relation of each pattern: half from its row sums, half from its column sums inside the pattern.

    ``matrix``: row, col, value; ``groups``: pattern, relation. Relations that the matrix doesn't name take no part. ``epsilon`` is added
    to every cell of the pattern's square. Columns: pattern, relation, forward, backward, p_avg, eta_expected, eta_integer.
    """
    known = matrix.select(F.explode(F.array("row", "col")).alias("relation")).distinct()
    g = groups.select("pattern", "relation").distinct().join(known, "relation", "left_semi").select("pattern", "relation")
    sizes = Window.partitionBy("pattern")
    g = g.withColumn("_n", F.count(F.lit(1)).over(sizes))
    inside = matrix.join(g.select("pattern", F.col("relation").alias("row")), "row").join(g.select(F.col("pattern").alias("_p"), F.col("relation").alias("_c")), (F.col("pattern") == F.col("_p")) & (F.col("col") == F.col("_c")))
    value = F.greatest(F.col("value"), F.lit(0.0))
    side = lambda c, name: inside.groupBy("pattern", F.col(c).alias("relation")).agg(F.sum(value).alias(name))
    s = g.join(side("row", "_f"), ["pattern", "relation"], "left").join(side("col", "_b"), ["pattern", "relation"], "left")
    plus = epsilon * F.col("_n")
    s = s.withColumns({"forward": F.coalesce("_f", F.lit(0.0)) + plus, "backward": F.coalesce("_b", F.lit(0.0)) + plus})
    p = (softmax(F.col("forward"), ["pattern"], temperature) + softmax(F.col("backward"), ["pattern"], temperature)) / 2
    s = s.withColumn("p_avg", p).withColumn("eta_expected", F.col("p_avg") * eta).withColumn("_eta", F.lit(eta))
    out = largest_remainder(s, ["pattern"], "eta_expected", "_eta", [F.col("relation")], "eta_integer")
    return out.select("pattern", "relation", "forward", "backward", "p_avg", "eta_expected", "eta_integer")


def expected_by_relation(alloc: DataFrame) -> DataFrame:
    return alloc.groupBy("relation").agg(F.sum("eta").alias("expected"), F.sort_array(F.collect_set("pattern")).alias("patterns"))


def compare_relations(counts: DataFrame, alloc: DataFrame) -> DataFrame:
    """Allocated relations with expected and observed counts, deficit, surplus and fulfilment. ``counts``: r, n."""
    c = counts.select(F.col("r").alias("relation"), "n")
    out = expected_by_relation(alloc).join(c, "relation", "left").withColumn("observed", F.coalesce("n", F.lit(0)))
    gap = F.col("expected") - F.col("observed")
    status = F.when(F.col("observed") == 0, "zero").when(gap > 0, "under").when(gap < 0, "over").otherwise("exact")
    return out.select("relation", "expected", "observed", F.greatest(gap, F.lit(0.0)).alias("deficit"), F.greatest(-gap, F.lit(0.0)).alias("surplus"), status.alias("fulfilment"), F.array_join("patterns", "|").alias("patterns"))


def balance_totals(compared: DataFrame) -> DataFrame:
    """One row of totals over :func:`compare_relations`."""
    return compared.agg(
        F.count(F.lit(1)).alias("relations"),
        F.count_if(F.col("observed") > 0).alias("observed_relations"),
        F.count_if(F.col("observed") == 0).alias("zero_relations"),
        F.round(F.sum("expected"), 6).alias("total_expected"),
        F.sum("observed").alias("total_observed"),
        F.round(F.sum("deficit"), 6).alias("total_deficit"),
        F.round(F.sum("surplus"), 6).alias("total_surplus"),
    )


def _shares(counts: DataFrame, alloc: DataFrame) -> DataFrame:
    total = alloc.groupBy(F.col("relation").alias("_r")).agg(F.sum("eta").alias("_all"))
    rows = alloc.join(total, F.col("relation") == F.col("_r")).join(counts.select(F.col("r").alias("_c"), "n"), F.col("relation") == F.col("_c"))
    return rows.withColumn("part", F.col("n") * (F.col("eta") / F.col("_all")))


def by_eta_share(counts: DataFrame, alloc: DataFrame) -> DataFrame:
    """(pattern, observed): counts split over the rows of a relation by their share of its eta."""
    return _shares(counts, alloc).groupBy("pattern").agg(F.sum("part").alias("observed"))


def by_rounded_share(counts: DataFrame, alloc: DataFrame) -> DataFrame:
    """The same with each part rounded half to even before it is added."""
    return _shares(counts, alloc).groupBy("pattern").agg(F.sum(F.bround(F.round("part", 9), 0)).cast("long").alias("observed"))


def by_largest_remainder(counts: DataFrame, alloc: DataFrame) -> DataFrame:
    """The same with the counts of each relation apportioned to whole numbers (ties by pattern)."""
    parts = _shares(counts, alloc.groupBy("relation", "pattern").agg(F.sum("eta").alias("eta")))
    return largest_remainder(parts, ["relation"], "part", "n", [F.col("pattern")]).groupBy("pattern").agg(F.sum("apportioned").alias("observed"))


def by_membership(counts: DataFrame, alloc: DataFrame) -> DataFrame:
    """Every triple counts in every pattern of its relation."""
    return alloc.select("pattern", F.col("relation").alias("r")).distinct().join(counts, "r").groupBy("pattern").agg(F.sum("n").alias("observed"))


def by_equal_share(counts: DataFrame, alloc: DataFrame) -> DataFrame:
    """Every triple counts in equal parts in the patterns of its relation."""
    own = alloc.select("pattern", "relation").distinct()
    many = own.groupBy(F.col("relation").alias("r")).agg(F.count(F.lit(1)).alias("_m"))
    return own.withColumnRenamed("relation", "r").join(many, "r").join(counts, "r").groupBy("pattern").agg(F.sum(F.col("n") / F.col("_m")).alias("observed"))


def allocation_index(rows: DataFrame) -> DataFrame:
    """Per relation of allocation rows (pattern, relation, eta_integer, forward_score, backward_score): budget summed and at most, by pattern as
    ``pattern=budget`` in order, the highest scores, and the number of patterns."""
    per = rows.groupBy("relation", "pattern").agg(F.sum("eta_integer").alias("e"), F.max("forward_score").alias("f"), F.max("backward_score").alias("b"))
    text = F.concat(F.col("pattern"), F.lit("="), F.coalesce(F.col("e").cast("string"), F.lit("")))
    # as many entries as patterns
    out = per.groupBy("relation").agg(F.sum("e").alias("eta_sum"), F.max("e").alias("eta_max"), F.array_join(F.sort_array(F.collect_list(text)), "|").alias("by_pattern"), F.max("f").alias("f"), F.max("b").alias("b"), F.count(F.lit(1)).alias("patterns"))
    return out.select("relation", "eta_sum", "eta_max", "by_pattern", F.round("f", 6).alias("forward_max"), F.round("b", 6).alias("backward_max"), "patterns")


def by_combination(counts: DataFrame, alloc: DataFrame) -> DataFrame:
    """(patterns, relations, observed): triples per combination of patterns, ``none`` for relations without any."""
    combo = alloc.groupBy(F.col("relation").alias("r")).agg(F.array_join(F.sort_array(F.collect_set("pattern")), "|").alias("_p"))
    return counts.join(combo, "r", "left").groupBy(F.coalesce("_p", F.lit("none")).alias("patterns")).agg(F.count(F.lit(1)).alias("relations"), F.sum("n").alias("observed"))


def compare_patterns(observed: DataFrame, alloc: DataFrame) -> DataFrame:
    """Pattern totals expected and observed (full outer), deficit and surplus."""
    want = alloc.groupBy("pattern").agg(F.sum("eta").alias("_e"))
    got = observed.select("pattern", F.col("observed").alias("_o"))
    out = want.join(got, "pattern", "full").select("pattern", F.coalesce("_e", F.lit(0.0)).alias("expected"), F.coalesce(F.col("_o").cast("double"), F.lit(0.0)).alias("observed"))
    gap = F.col("expected") - F.col("observed")
    return out.withColumns({"deficit": F.greatest(gap, F.lit(0.0)), "surplus": F.greatest(-gap, F.lit(0.0))})


def quotas(alloc: DataFrame) -> DataFrame:
    """Σ eta per relation (pattern NULL), per pattern and relation, and in all, in one pass."""
    return alloc.rollup("relation", "pattern").agg(F.round(F.sum("eta"), 6).alias("eta"), F.grouping_id().alias("level"))
