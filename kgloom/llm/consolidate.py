"""p2: consolidating pairwise matches into groups.

Every round runs union-find inside bounded edge partitions and keeps only a spanning forest of stars (node to the smallest node it reaches
there). A node that several partitions reached links their roots; it then leaves the graph with its smallest root as parent, and only the
links between roots go on. Rounds repeat on fewer and fewer partitions until one bounded partition holds what is left; parents are then
followed back through the rounds. Should a round hardly shrink anything, large-star and small-star steps finish the rest. No task ever sees more than ``BOUND`` edges (plus a chance surplus of hashing) and nothing is collected.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kgloom.operators.graph import components
from kgloom.operators.skew import hot_join
from kgloom.operators.unionfind import BOUND, forest
from kgloom.session import cut, drop_cut

#: A round that leaves more than this share of its links is the last of its kind.
SHRINK = 0.9


def groups(edges: DataFrame, bound: int = BOUND) -> DataFrame:
    """``node``, ``grp`` for every node of ``edges`` (a bigint, b bigint): grp is the smallest node linked directly or through others.

    A row with a = b only names a node. Rows with NULL on either side are ignored. Repeats and reversed rows change nothing.
    """
    lo, hi = F.least("a", "b"), F.greatest("a", "b")
    todo = cut(edges.where(F.col("a").isNotNull() & F.col("b").isNotNull()).select(lo.alias("a"), hi.alias("b")).distinct())
    n = todo.count()
    rounds: list[DataFrame] = []
    while n:
        parts = -(-n // bound)
        # a range of the smaller end keeps neighbours together; odd rounds hash both ends, so no order of the keys is a worst case
        if parts == 1:
            spread = todo.coalesce(1)
        elif len(rounds) % 2:
            spread = todo.repartition(parts, "a", "b")
        else:
            spread = todo.repartitionByRange(parts, "a", "b")
        stars = spread.mapInArrow(forest, "node long, root long")
        if parts == 1:
            rounds.append(cut(stars.select("node", F.col("root").alias("parent"))))
            break
        # at most one root per partition and node
        met = cut(stars.groupBy("node").agg(F.sort_array(F.collect_set("root")).alias("roots")))
        rounds.append(met.select("node", F.col("roots")[0].alias("parent")))
        links = met.where(F.size("roots") > 1).select(F.col("roots")[0].alias("a"), F.explode(F.slice("roots", 2, F.size("roots"))).alias("b"))
        before = n
        drop_cut(todo)
        todo = cut(links.distinct())
        n = todo.count()
        if n > SHRINK * before:
            # hashing keeps what is left too far apart: star rounds shrink any graph
            rounds.append(cut(components(todo, bound=bound).select("node", F.col("component").alias("parent"))))
            break
    if not rounds:
        return edges.select(F.col("a").alias("node"), F.col("b").alias("grp")).where(F.lit(False))
    known = rounds[-1].select("node", F.col("parent").alias("grp"))
    for r in reversed(rounds[:-1]):
        # parents are skewed: a group may hold a third of all nodes
        up = known.select(F.col("node").alias("_parent"), "grp")
        known = hot_join(r, up, ("parent", "_parent"), "left").select("node", F.coalesce("grp", "parent").alias("grp"))
    return known
