"""Counting operators over bags and sets of triples (h, r, t)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kgloom.session import cut


def shard(name: str, n: int, digest: str = "sha1") -> Column:
    """Which of ``n`` shards a name belongs to: the first 16 hexadecimal digits of its digest (sha1 or sha256), unsigned, modulo ``n``."""
    hashed = F.sha1(name) if digest == "sha1" else F.sha2(name, 256)
    # 64 bits don't fit a bigint
    return F.pmod(F.conv(F.substring(hashed, 1, 16), 16, 10).cast("decimal(20,0)"), F.lit(n).cast("decimal(20,0)")).cast("long")


def reject_nulls(df: DataFrame) -> DataFrame:
    """``df``, failing at run time on a row in which h, r or t is NULL."""
    bad = F.col("h").isNull() | F.col("r").isNull() | F.col("t").isNull()
    return df.where(F.when(bad, F.raise_error("triple with a NULL part").cast("boolean")).otherwise(F.lit(True)))


def entities(df: DataFrame) -> DataFrame:
    """Distinct endpoints as ``entity``."""
    return df.select(F.explode(F.array("h", "t")).alias("entity")).distinct()


def relation_counts(df: DataFrame) -> DataFrame:
    return df.groupBy("r").agg(F.count(F.lit(1)).alias("n"))


def duplicates(df: DataFrame) -> DataFrame:
    """Triples that occur more than once, with their multiplicity."""
    return multiplicity(df).where(F.col("n") > 1)


def multiplicity(df: DataFrame) -> DataFrame:
    return df.groupBy("h", "r", "t").agg(F.count(F.lit(1)).alias("n"))


def summary(df: DataFrame) -> DataFrame:
    """One row: rows, distinct triples, surplus copies, entities, relations. All zero for an empty table."""
    m = multiplicity(df)
    base = m.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("raw_rows"), F.count(F.lit(1)).alias("triples"), F.count_distinct("r").alias("relations"))
    ents = entities(m).agg(F.count(F.lit(1)).alias("entities"))
    both = base.withColumn("_k", F.lit(1)).join(ents.withColumn("_k", F.lit(1)), "_k")  # one row each
    return both.select("raw_rows", "triples", (F.col("raw_rows") - F.col("triples")).alias("duplicate_rows"), "entities", "relations")


# Upper ends (exclusive) and names of the buckets of triples per relation.
BUCKETS = ((10, "1-9"), (50, "10-49"), (100, "50-99"), (250, "100-249"), (500, "250-499"), (1000, "500-999"), (None, "1000+"))


def count_histogram(counts: DataFrame) -> DataFrame:
    """Relations per bucket of their number of triples."""
    bucket = F.lit(BUCKETS[-1][1])
    for top, name in reversed(BUCKETS[:-1]):
        bucket = F.when(F.col("n") < top, name).otherwise(bucket)
    return counts.groupBy(bucket.alias("bucket")).agg(F.count(F.lit(1)).alias("relations"))


def count_distribution(counts: DataFrame) -> DataFrame:
    """min, max, mean and median of the triples per relation. One value per relation, so the exact median holds few values."""
    return counts.agg(F.min("n").alias("min_n"), F.max("n").alias("max_n"), F.round(F.avg("n"), 9).alias("mean_n"), F.percentile("n", F.lit(0.5)).alias("median_n"))


def degrees(df: DataFrame) -> DataFrame:
    """Per entity in-, out- and total degree in triples; a self-loop counts on both sides."""
    ends = df.select(F.explode(F.array(F.struct(F.col("h").alias("entity"), F.lit(1).alias("o"), F.lit(0).alias("i")), F.struct(F.col("t").alias("entity"), F.lit(0).alias("o"), F.lit(1).alias("i")))).alias("x"))
    out = ends.groupBy(F.col("x.entity").alias("entity")).agg(F.sum("x.o").alias("out_degree"), F.sum("x.i").alias("in_degree"))
    return out.withColumn("degree", F.col("out_degree") + F.col("in_degree"))


def pair_counts(df: DataFrame) -> DataFrame:
    """Triples per unordered pair a ≤ b."""
    return df.groupBy(F.least("h", "t").alias("a"), F.greatest("h", "t").alias("b")).agg(F.count(F.lit(1)).alias("n"))


def neighbours(df: DataFrame, loops: bool = False) -> DataFrame:
    """Both directions (v, w) of the simple undirected graph; self-loops only if asked for."""
    p = pair_counts(df).select("a", "b")
    if not loops:
        p = p.where(F.col("a") != F.col("b"))
    both = p.select(F.col("a").alias("v"), F.col("b").alias("w")).unionByName(p.where(F.col("a") != F.col("b")).select(F.col("b").alias("v"), F.col("a").alias("w")))
    return both


def simple_degrees(df: DataFrame) -> DataFrame:
    """Distinct neighbours of each entity; a self-loop counts 2, as undirected graph libraries do."""
    weight = F.when(F.col("v") == F.col("w"), 2).otherwise(1)
    return neighbours(df, loops=True).groupBy(F.col("v").alias("entity")).agg(F.sum(weight).alias("degree"))


def two_path_proxy(df: DataFrame) -> DataFrame:
    """One row: Σ d·(d−1)/2 over the simple undirected graph, and entities of degree 1."""
    d = simple_degrees(df)
    return d.agg(F.coalesce(F.sum((F.col("degree") * (F.col("degree") - 1) / 2).cast("long")), F.lit(0)).alias("two_paths"), F.count_if(F.col("degree") <= 1).alias("low_degree_entities"))


def incidence(df: DataFrame) -> DataFrame:
    """Relations that touch each entity."""
    return df.select("r", F.explode(F.array("h", "t")).alias("entity")).distinct().groupBy("entity").agg(F.count(F.lit(1)).alias("n_relations"))


def k_hop(df: DataFrame, centre: DataFrame, hops: int) -> DataFrame:
    """(entity, depth) within ``hops`` of the entities in ``centre`` (one column), undirected; ``centre`` may be empty. Each hop joins the newest level only."""
    edges = cut(neighbours(df))
    levels = [cut(centre.select(F.col(centre.columns[0]).alias("entity"), F.lit(0).alias("depth")).distinct())]
    for depth in range(1, hops + 1):
        front = levels[-1].select(F.col("entity").alias("v"))
        found = edges.join(front, "v", "left_semi").select(F.col("w").alias("entity")).distinct()
        # a neighbour of the last level is at most one level away from it
        known = levels[-1].select("entity") if depth == 1 else levels[-1].select("entity").unionByName(levels[-2].select("entity"))
        levels.append(cut(found.join(known, "entity", "left_anti").select("entity", F.lit(depth).alias("depth"))))
    out = levels[0]
    for x in levels[1:]:
        out = out.unionByName(x)
    return out


def top_nodes_subgraph(df: DataFrame, n: int) -> DataFrame:
    """Triples between the ``n`` entities of highest degree (ties: smaller entity)."""
    top = degrees(df).orderBy(F.col("degree").desc(), "entity").limit(n).select("entity")
    return df.join(top.withColumnRenamed("entity", "h"), "h", "left_semi").join(top.withColumnRenamed("entity", "t"), "t", "left_semi").select("h", "r", "t")


def common_neighbours(df: DataFrame, pairs: DataFrame) -> DataFrame:
    """``pairs`` (a, b) with the number of common neighbours in the simple graph of ``df``; pairs without any have 0.

    The neighbours of the end with fewer of them are looked up and probed as edges to the other end, so a hub is never expanded.
    """
    p = cut(pairs.select("a", "b").distinct())
    ends = p.select(F.explode(F.array("a", "b")).alias("v")).distinct()
    # both steps start at an end of a pair: from the one to a neighbour, from the other to the same
    e = cut(neighbours(df).join(ends, "v", "left_semi"))
    d = cut(e.groupBy("v").agg(F.count(F.lit(1)).alias("degree")))
    da, db = d.select(F.col("v").alias("a"), F.col("degree").alias("_da")), d.select(F.col("v").alias("b"), F.col("degree").alias("_db"))
    both = p.join(da, "a").join(db, "b")
    swap = F.col("_da") > F.col("_db")
    probe = both.select("a", "b", F.when(swap, F.col("b")).otherwise(F.col("a")).alias("v"), F.when(swap, F.col("a")).otherwise(F.col("b")).alias("other"))
    wedge = probe.join(e, "v").select("a", "b", F.col("other").alias("v"), "w")
    hit = wedge.join(e, ["v", "w"], "left_semi").groupBy("a", "b").agg(F.count(F.lit(1)).alias("n"))
    return p.join(hit, ["a", "b"], "left").select("a", "b", F.coalesce("n", F.lit(0)).alias("common"))


def pattern_split(df: DataFrame, groups: DataFrame) -> DataFrame:
    """Triples with each pattern their relation belongs to. ``groups``: pattern, relation."""
    g = groups.select("pattern", F.col("relation").alias("r")).distinct()
    return df.join(g, "r").select("pattern", "h", "r", "t")
