"""p1: capping records per dominant contributor.

Mergeable bounded lists: each task folds its rows into one list per contributor that holds no more than the contributor's cap, before
anything is shuffled; lists are merged in a tree (first per contributor and branch, then per contributor), and the full records are told
apart by the last entry of their contributor's list. Caps that grow with the data (a share of a large run) would make such a list unbounded:
contributors whose cap exceeds ``HEAP_CAP`` are ranked exactly by range pieces instead (:func:`kgloom.operators.skew.running_totals`).
"""

from __future__ import annotations

import math
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kgloom.llm.heaps import heap_stream, place_stream
from kgloom.operators.skew import lookup, running_totals
from kgloom.session import cut

#: Longest list a contributor may have in one task.
HEAP_CAP = 4096


def contributor_caps(edges: DataFrame, limits: DataFrame) -> DataFrame:
    """Per (scope, contributor): rows and cap. ``edges``: scope, contributor, …, one row per item; ``limits``: scope, max_count, max_share.

    cap = the smaller of max_count and floor(max_share × rows of the scope), the latter at least 1; a missing limit doesn't bind, both
    missing or a scope without limits gives a NULL cap (no limit). A NULL scope has no limits. Rows without contributor belong to none.
    """
    every = edges.groupBy("scope", "contributor").agg(F.count(F.lit(1)).alias("n"))
    per = every.where(F.col("contributor").isNotNull())
    whole = every.groupBy(F.col("scope").alias("_s")).agg(F.sum("n").alias("n_scope"))
    bound = whole.join(limits.select(F.col("scope").alias("_l"), "max_count", "max_share"), F.col("_s") == F.col("_l"))
    share = F.when(F.col("max_share").isNotNull() & ~F.isnan("max_share"), F.greatest(F.floor(F.col("max_share") * F.col("n_scope")), F.lit(1)))
    bound = bound.select("_s", F.least(F.col("max_count").cast("long"), share).alias("cap"))  # least skips NULL
    return per.join(bound, F.col("scope") == F.col("_s"), "left").drop("_s")


def excess(edges: DataFrame, limits: DataFrame) -> DataFrame:
    """scope, ident of the rows in excess of their contributor's cap. ``edges``: scope, contributor, score, ident (unique), read several times:
    bring a written table.

    Kept are the highest scores (NULL and NaN last), ties by smaller ident; a negative cap keeps none. A row is in excess if it comes after
    the last entry of its contributor's full list, so no rows but the lists are moved.
    """
    caps = contributor_caps(edges, limits)
    over = cut(caps.where(F.col("n") > F.col("cap")).select(F.col("scope").alias("_c0"), F.col("contributor").alias("_c1"), F.greatest("cap", F.lit(0)).alias("cap")))
    own = edges.select("scope", "contributor", F.when(~F.isnan("score"), F.col("score")).alias("score"), "ident")
    rows = lookup(own, over, [("scope", "_c0"), ("contributor", "_c1")])
    keys = ["scope", "contributor"]
    ends = [_list_ends(rows.where(F.col("cap") <= HEAP_CAP), keys)]
    if not over.where(F.col("cap") > HEAP_CAP).isEmpty():
        large = rows.where(F.col("cap") > HEAP_CAP).withColumn("_worst", F.col("score").isNull()).withColumn("_neg", -F.col("score"))
        run = running_totals(large, keys, [F.col("_worst"), F.col("_neg"), F.col("ident")], total="_rank")
        ends.append(run.where(F.col("_rank") == F.col("cap")).select(*keys, "score", "ident"))
    last = reduce(DataFrame.unionByName, ends).select(F.col("scope").alias("_l0"), F.col("contributor").alias("_l1"), F.col("score").alias("_score"), F.col("ident").alias("_ident"))
    m = lookup(rows, cut(last), [("scope", "_l0"), ("contributor", "_l1")], "left")
    place = lambda s, i: F.struct(F.col(s).isNull(), -F.col(s), F.col(i))
    # a list of length 0 has no end
    return m.where(F.col("_ident").isNull() | (place("score", "ident") > place("_score", "_ident"))).select("scope", "ident")


def _list_ends(rows: DataFrame, keys: list[str]) -> DataFrame:
    """The last entry of each contributor's list of ``cap`` best rows (scope, contributor, score, ident, cap; all have more rows than that)."""
    fold = heap_stream(keys, "cap", "score", "ident")
    parts = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    branch = F.pmod(F.spark_partition_id(), F.lit(max(2, math.isqrt(parts))))
    lists = rows.mapInArrow(fold, rows.schema).withColumn("_branch", branch)
    merged = lists.repartition(parts, *keys, "_branch").drop("_branch").mapInArrow(fold, rows.schema)
    # the last merge reads sorted lists, at most branches × cap rows of a contributor, and keeps none of them
    final = merged.repartition(parts, *keys).sortWithinPartitions(*keys, F.col("score").desc_nulls_last(), "ident")
    return final.mapInArrow(place_stream(keys, "cap"), rows.schema).select(*keys, "score", "ident")
