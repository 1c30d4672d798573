"""Two-hop chains x -r1-> y -r2-> z.

Chains are never listed to be counted: per middle entity the incoming and outgoing relations are compressed to frequencies first, so a
hub with a million edges contributes at most relations² rows. Only chains that return to their start need both edges, and these join on
both ends at once.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def _ends(k: DataFrame) -> tuple[DataFrame, DataFrame]:
    into = k.groupBy(F.col("t").alias("y"), F.col("r").alias("r1")).agg(F.count(F.lit(1)).alias("n_in"))
    out = k.groupBy(F.col("h").alias("y"), F.col("r").alias("r2")).agg(F.count(F.lit(1)).alias("n_out"))
    return into, out


def loops(k: DataFrame) -> DataFrame:
    """(r1, r2, loop): chains that return to their start, x ≠ y."""
    a = k.select(F.col("h").alias("x"), F.col("t").alias("y"), F.col("r").alias("r1"))
    b = k.select(F.col("t").alias("x"), F.col("h").alias("y"), F.col("r").alias("r2"))
    return a.where("x <> y").join(b, ["x", "y"]).groupBy("r1", "r2").agg(F.count(F.lit(1)).alias("loop"))


def hop_support(triples: DataFrame) -> DataFrame:
    """(r1, r2, loop, nonloop, total): distinct chains with x ≠ y and y ≠ z, split by x = z. ``triples`` must be a set."""
    k = triples.where("h <> t")
    into, out = _ends(k)
    total = into.join(out, "y").groupBy("r1", "r2").agg(F.sum(F.col("n_in") * F.col("n_out")).alias("total"))
    back = F.coalesce("loop", F.lit(0))
    return total.join(loops(k), ["r1", "r2"], "left").select("r1", "r2", back.alias("loop"), (F.col("total") - back).alias("nonloop"), "total")


def middle_support(triples: DataFrame) -> DataFrame:
    """(r1, r2, support): distinct middle entities, self-loops included."""
    into, out = _ends(triples)
    return into.join(out, "y").groupBy("r1", "r2").agg(F.count(F.lit(1)).alias("support"))


def sampled_support(triples: DataFrame, middles: int, seed: str) -> DataFrame:
    """The same from at most ``middles`` middle entities of each r1, drawn by a seeded hash of (r1, entity)."""
    own = triples.select(F.col("r").alias("r1"), F.col("t").alias("y")).distinct()
    draw = Window.partitionBy("r1").orderBy(F.md5(F.concat_ws("|", F.lit(seed), "r1", "y")), "y")
    # ranks beyond the sample are cut before the shuffle
    few = own.withColumn("_p", F.row_number().over(draw)).where(F.col("_p") <= middles).select("r1", "y")
    out = triples.select(F.col("h").alias("y"), F.col("r").alias("r2")).distinct()
    return few.join(out, "y").groupBy("r1", "r2").agg(F.count(F.lit(1)).alias("support"))


def composed(triples: DataFrame, rules: DataFrame) -> DataFrame:
    """(h, r, t, rules): what the ``rules`` (r1, r2, r3) imply from chains, with the number of different (r1, r2) that imply it."""
    k = triples.select("h", "r", "t")
    first = k.join(rules.select(F.col("r1").alias("r")).distinct(), "r", "left_semi").select(F.col("h").alias("x"), F.col("r").alias("r1"), F.col("t").alias("y"))
    second = k.join(rules.select(F.col("r2").alias("r")).distinct(), "r", "left_semi").select(F.col("h").alias("y"), F.col("r").alias("r2"), F.col("t").alias("z"))
    # the rules decide which relations meet at a middle before the middles are joined
    led = first.join(rules, "r1")
    made = led.join(second, ["y", "r2"]).select(F.col("x").alias("h"), F.col("r3").alias("r"), F.col("z").alias("t"), "r1", "r2").distinct()
    return made.groupBy("h", "r", "t").agg(F.count(F.lit(1)).alias("rules"))


def top_followers(support: DataFrame, by: str, k: int) -> DataFrame:
    """The ``k`` r2 of highest ``by`` for each r1, ties by r2, ranked from 1; r2 without support are left out."""
    w = Window.partitionBy("r1").orderBy(F.col(by).desc(), "r2")
    return support.where(F.col(by) > 0).withColumn("place", F.row_number().over(w)).where(F.col("place") <= k).select("r1", "r2", by, "place")


def followers(triples: DataFrame) -> DataFrame:
    """(r1, r2) such that r2 can follow r1."""
    return middle_support(triples).select("r1", "r2")


def two_paths(triples: DataFrame) -> DataFrame:
    """Every (h, r1, r2, t) as a bag; chains whose first hop is a self-loop are skipped. The result is as large as the chains are many."""
    a = triples.where("h <> t").select("h", F.col("r").alias("r1"), F.col("t").alias("y"))
    b = triples.select(F.col("h").alias("y"), F.col("r").alias("r2"), "t")
    return a.join(b, "y").select("h", "r1", "r2", "t")


def shortcuts(triples: DataFrame) -> DataFrame:
    """(r1, r2, r3, x, y, z): every chain that an edge r3 joins directly, each edge looking for its middles from the end with fewer edges."""
    k = triples.select("h", "r", "t")
    d_out = k.groupBy(F.col("h").alias("x")).agg(F.count(F.lit(1)).alias("_o"))
    d_in = k.groupBy(F.col("t").alias("z")).agg(F.count(F.lit(1)).alias("_i"))
    direct = k.select(F.col("h").alias("x"), F.col("r").alias("r3"), F.col("t").alias("z")).join(d_out, "x").join(d_in, "z")
    first = k.select(F.col("h").alias("x"), F.col("r").alias("r1"), F.col("t").alias("y"))
    second = k.select(F.col("h").alias("y"), F.col("r").alias("r2"), F.col("t").alias("z"))
    found = direct.where("_o <= _i").join(first, "x").join(second, ["y", "z"]).select("r1", "r2", "r3", "x", "y", "z")
    return found.unionByName(direct.where("_o > _i").join(second, "z").join(first, ["x", "y"]).select("r1", "r2", "r3", "x", "y", "z"))


def composition(triples: DataFrame) -> DataFrame:
    """(r1, r2, r3, examined, shortcuts, missing, confidence): of the distinct (x, z) joined by r1 and r2, how many r3 joins directly.

    Only rows with a shortcut. Chains are counted by compression; two chains of r1 and r2 can only share both ends if the start has several
    r1 edges and the end several r2 edges, so only these are listed to be told apart. Shortcuts come from :func:`shortcuts`.
    """
    k = triples.select("h", "r", "t")
    into, out = _ends(k)
    total = into.join(out, "y").groupBy("r1", "r2").agg(F.sum(F.col("n_in") * F.col("n_out")).alias("_all"))
    many_out = k.groupBy("h", "r").agg(F.count(F.lit(1)).alias("_n")).where("_n > 1").drop("_n")
    many_in = k.groupBy("t", "r").agg(F.count(F.lit(1)).alias("_n")).where("_n > 1").drop("_n")
    a = k.join(many_out, ["h", "r"], "left_semi").select(F.col("h").alias("x"), F.col("r").alias("r1"), F.col("t").alias("y"))
    b = k.join(many_in, ["t", "r"], "left_semi").select(F.col("h").alias("y"), F.col("r").alias("r2"), F.col("t").alias("z"))
    per = a.join(b, "y").groupBy("r1", "r2", "x", "z").agg(F.count(F.lit(1)).alias("_n"))
    surplus = per.groupBy("r1", "r2").agg(F.sum(F.col("_n") - 1).alias("_more"))
    examined = total.join(surplus, ["r1", "r2"], "left").select("r1", "r2", (F.col("_all") - F.coalesce("_more", F.lit(0))).alias("examined"))

    short = shortcuts(k).select("r1", "r2", "r3", "x", "z").distinct().groupBy("r1", "r2", "r3").agg(F.count(F.lit(1)).alias("shortcuts"))
    m = short.join(examined, ["r1", "r2"])
    return m.select("r1", "r2", "r3", "examined", "shortcuts", (F.col("examined") - F.col("shortcuts")).alias("missing"), (F.col("shortcuts") / F.col("examined")).alias("confidence"))


def relation_symmetry(triples: DataFrame) -> DataFrame:
    """Per relation: pairs, share whose reverse holds too, share that is no loop and has no reverse."""
    back = triples.select(F.col("t").alias("h"), "r", F.col("h").alias("t"), F.lit(1).alias("_b"))
    m = triples.join(back, ["h", "r", "t"], "left")
    has = F.col("_b").isNotNull()
    return m.groupBy("r").agg(F.count(F.lit(1)).alias("n_pairs"), (F.count_if(has) / F.count(F.lit(1))).alias("sym_score"), (F.count_if(~has & (F.col("h") != F.col("t"))) / F.count(F.lit(1))).alias("anti_score"))


def relation_inverse(triples: DataFrame) -> DataFrame:
    """(r1, r2, overlap, score): pairs of r1 whose reverse is in r2, over the pairs of r1; r1 ≠ r2, overlap > 0."""
    n = triples.groupBy(F.col("r").alias("r1")).agg(F.count(F.lit(1)).alias("_n"))
    a, b = triples.select(F.col("r").alias("r1"), "h", "t"), triples.select(F.col("r").alias("r2"), F.col("t").alias("h"), F.col("h").alias("t"))
    m = a.join(b, ["h", "t"]).where("r1 <> r2").groupBy("r1", "r2").agg(F.count(F.lit(1)).alias("overlap"))
    return m.join(n, "r1").select("r1", "r2", "overlap", (F.col("overlap") / F.col("_n")).alias("score"))
