"""Repairing a graph out of a larger universe of triples: anchors, bridges of one and two steps, relations that are absent, capacities."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from kgloom.operators.skew import running_totals
from kgloom.operators.triples import degrees, entities
from kgloom.session import cut


def main_component(members: DataFrame) -> DataFrame:
    """One row (component): the largest, the smallest name of those tied. ``members``: node, component."""
    return members.groupBy("component").agg(F.count(F.lit(1)).alias("_n")).orderBy(F.col("_n").desc(), "component").limit(1).select("component")


def component_anchors(graph: DataFrame, members: DataFrame, k: int) -> DataFrame:
    """(component, node, degree, place): the ``k`` nodes of highest degree of every component, ties by name."""
    d = degrees(graph).select(F.col("entity").alias("node"), "degree")
    w = Window.partitionBy("component").orderBy(F.col("degree").desc(), "node")
    # ranks beyond k are cut before the shuffle
    return members.join(d, "node").withColumn("place", F.row_number().over(w)).where(F.col("place") <= k).select("component", "node", "degree", "place")


def _steps(universe: DataFrame) -> DataFrame:
    """Every triple from both its ends: v, w and the triple."""
    x = F.array(F.struct(F.col("h").alias("v"), F.col("t").alias("w")), F.struct(F.col("t").alias("v"), F.col("h").alias("w")))
    return universe.where("h <> t").select("h", "r", "t", F.explode(x).alias("x")).select("x.v", "x.w", "h", "r", "t")


def one_step_bridges(universe: DataFrame, anchors: DataFrame, main: DataFrame) -> DataFrame:
    """(component, anchor, h, r, t): triples of ``universe`` that join an anchor (component, node) to a node of ``main`` (node)."""
    s = _steps(universe).join(anchors.select("component", F.col("node").alias("v")), "v").join(main.select(F.col("node").alias("w")), "w", "left_semi")
    return s.select("component", F.col("v").alias("anchor"), "h", "r", "t")


def two_step_bridges(universe: DataFrame, anchors: DataFrame, main: DataFrame) -> DataFrame:
    """(component, anchor, middle, h1, r1, t1, h2, r2, t2): two triples that join an anchor to ``main`` by a middle outside of it.

    The middles are few (next to an anchor and next to main), so hubs are only read where both sides meet."""
    s = cut(_steps(universe))
    target = main.select(F.col("node").alias("w"))
    first = s.join(anchors.select("component", F.col("node").alias("v")), "v").join(target, "w", "left_anti")
    first = first.select("component", F.col("v").alias("anchor"), F.col("w").alias("middle"), F.col("h").alias("h1"), F.col("r").alias("r1"), F.col("t").alias("t1"))
    second = s.join(target, "w", "left_semi").select(F.col("v").alias("middle"), F.col("h").alias("h2"), F.col("r").alias("r2"), F.col("t").alias("t2"))
    return first.join(second, "middle").select("component", "anchor", "middle", "h1", "r1", "t1", "h2", "r2", "t2")


def best_bridge(bridges: DataFrame, order: list[Column]) -> DataFrame:
    """The first bridge of every component in the given strict order."""
    return bridges.withColumn("_p", F.row_number().over(Window.partitionBy("component").orderBy(*order))).where("_p = 1").drop("_p")


def absent_pairs(absent: DataFrame, graph: DataFrame, support: DataFrame, main: DataFrame) -> DataFrame:
    """(missing, realised, orientation, support, anchors, share, score): which realised relation may lead to an absent one.

    ``absent``: relation, priority; ``support``: r1, r2, total; ``main``: node of the main component. In the orientation ``after`` the absent
    relation follows the realised one and its objects are the anchors, in ``before`` it goes before and its subjects are. The score is
    priority · ln(1 + support) · ln(1 + anchors) · (1 + share of the anchors in main); pairs without support or anchors are left out.
    """
    ends = lambda c, o: graph.select(F.col("r").alias("realised"), F.col(c).alias("node")).distinct().withColumn("orientation", F.lit(o))
    a = ends("t", "after").unionByName(ends("h", "before")).join(main.select("node", F.lit(1).alias("_main")), "node", "left")
    a = a.groupBy("realised", "orientation").agg(F.count(F.lit(1)).alias("anchors"), (F.count("_main") / F.count(F.lit(1))).alias("share"))
    s = support.where("total > 0")
    after = s.select(F.col("r1").alias("realised"), F.col("r2").alias("missing"), F.lit("after").alias("orientation"), F.col("total").alias("support"))
    before = s.select(F.col("r2").alias("realised"), F.col("r1").alias("missing"), F.lit("before").alias("orientation"), F.col("total").alias("support"))
    m = after.unionByName(before).join(absent.select(F.col("relation").alias("missing"), "priority"), "missing").join(a, ["realised", "orientation"])
    score = F.greatest(F.col("priority"), F.lit(1e-12)) * F.log1p("support") * F.log1p("anchors") * (1.0 + F.col("share"))
    return m.select("missing", "realised", "orientation", "support", "anchors", "share", score.alias("score"))


def absent_contexts(pairs: DataFrame, graph: DataFrame, universe: DataFrame) -> DataFrame:
    """(missing, realised, orientation, h, r, t): triples of an absent relation that the universe holds next to an edge of the realised one:
    after it (its subject is an object of the realised relation in ``graph``) or before it (its object is a subject)."""
    near = lambda c, o, e: graph.select(F.col("r").alias("realised"), F.col(c).alias(e)).distinct().join(pairs.where(F.col("orientation") == o).select("missing", "realised"), "realised")
    u = universe.join(pairs.select(F.col("missing").alias("r")).distinct(), "r", "left_semi").select("h", "r", "t")
    after = u.join(near("t", "after", "h").withColumnRenamed("missing", "r"), ["h", "r"]).withColumn("orientation", F.lit("after"))
    before = u.join(near("h", "before", "t").withColumnRenamed("missing", "r"), ["t", "r"]).withColumn("orientation", F.lit("before"))
    cols = [F.col("r").alias("missing"), "realised", "orientation", "h", "r", "t"]
    return after.select(*cols).unionByName(before.select(*cols))


def fill_absent(graph: DataFrame, universe: DataFrame, quota: DataFrame, support: DataFrame, main: DataFrame) -> DataFrame:
    """(h, r, t, turn): triples of allocated relations that ``graph`` lacks, taken in passes until one adds nothing.

    In each pass every relation that is still below its ``quota`` (relation, quota) takes triples next to an edge of a realised relation of
    supported order, those of the best pair first (ties by h, t), up to what its quota leaves. Relations filled in one pass are realised in
    the next, and their edges are new contexts."""
    want = cut(quota.join(graph.select(F.col("r").alias("relation")).distinct(), "relation", "left_anti").where("quota >= 1").select("relation", F.floor("quota").cast("long").alias("quota")))
    now, taken, turn = cut(graph.select("h", "r", "t")), None, 0
    pool = cut(universe.select("h", "r", "t").distinct().join(want.select(F.col("relation").alias("r")), "r", "left_semi"))
    while True:
        turn += 1
        open_ = want if taken is None else want.join(taken.groupBy(F.col("r").alias("relation")).agg(F.count(F.lit(1)).alias("_n")), "relation", "left").select("relation", (F.col("quota") - F.coalesce("_n", F.lit(0))).alias("quota")).where("quota > 0")
        pairs = cut(absent_pairs(open_.select("relation", F.col("quota").cast("double").alias("priority")), now, support, main))
        scored = absent_contexts(pairs, now, pool).join(pairs.select("missing", "realised", "orientation", "score"), ["missing", "realised", "orientation"])
        fresh = scored.groupBy("h", "r", "t").agg(F.max("score").alias("_s")).join(now, ["h", "r", "t"], "left_anti").join(open_.withColumnRenamed("relation", "r"), "r")
        placed = running_totals(fresh, ["r"], [F.round("_s", 9).desc(), F.col("h"), F.col("t")], total="_place").where("_place <= quota")
        new = cut(placed.select("h", "r", "t", F.lit(turn).alias("turn")))
        if new.isEmpty():
            return new if taken is None else taken
        taken = new if taken is None else cut(taken.unionByName(new))
        now = cut(now.unionByName(new.select("h", "r", "t")))


def attach_capacity(graph: DataFrame, universe: DataFrame) -> DataFrame:
    """Per relation of ``universe``: triples that ``graph`` lacks, of these with both ends, only the head and only the tail in it, and the share
    that touches it."""
    known = lambda c, n: entities(graph).select(F.col("entity").alias(c), F.lit(1).alias(n))
    m = universe.join(graph.select("h", "r", "t"), ["h", "r", "t"], "left_anti").join(known("h", "_h"), "h", "left").join(known("t", "_t"), "t", "left")
    h, t = F.col("_h").isNotNull(), F.col("_t").isNotNull()
    return m.groupBy("r").agg(F.count(F.lit(1)).alias("n"), F.count_if(h & t).alias("both"), F.count_if(h & ~t).alias("by_head"), F.count_if(t & ~h).alias("by_tail"), (F.count_if(h | t) / F.count(F.lit(1))).alias("overlap"))


def restricted_picks(scored: DataFrame, group: str, order: list[Column], top: int, picks: int, seed: str, name: str) -> DataFrame:
    """``picks`` of the ``top`` first rows of each group in the given strict order, drawn by a seeded hash of ``name``: the same wherever drawn."""
    best = scored.withColumn("_p", F.row_number().over(Window.partitionBy(group).orderBy(*order))).where(F.col("_p") <= top)
    draw = Window.partitionBy(group).orderBy(F.md5(F.concat_ws("|", F.lit(seed), group, name)), name)
    return best.withColumn("pick", F.row_number().over(draw)).where(F.col("pick") <= picks).drop("_p")


def absent_classes(absent: DataFrame, universe: DataFrame, graph: DataFrame, typed: DataFrame) -> DataFrame:
    """(relation, candidates, touching, class) of the ``absent`` relations (relation): none in the universe, none compatible with any relation of
    the graph by ``typed`` (relation), none that touches the graph, or some that do."""
    e = lambda c: entities(graph).select(F.col("entity").alias(c), F.lit(1).alias(f"_{c}"))
    u = universe.join(absent.select(F.col("relation").alias("r")), "r", "left_semi").join(e("h"), "h", "left").join(e("t"), "t", "left")
    n = u.groupBy(F.col("r").alias("_r")).agg(F.count(F.lit(1)).alias("_n"), F.count_if(F.col("_h").isNotNull() | F.col("_t").isNotNull()).alias("_k"))
    m = absent.select("relation").join(n, F.col("relation") == F.col("_r"), "left").join(typed.select(F.col("relation").alias("_t"), F.lit(True).alias("_ok")).distinct(), F.col("relation") == F.col("_t"), "left")
    count = lambda c: F.coalesce(c, F.lit(0))
    kind = F.when(count("_n") == 0, "no_candidates").when(F.col("_ok").isNull(), "types_fail").when(count("_k") == 0, "untouched").otherwise("touching")
    return m.select("relation", count("_n").alias("candidates"), count("_k").alias("touching"), kind.alias("class"))


def attached_sample(universe: DataFrame, reached: DataFrame, n: int, seed: str, exact: bool = False) -> DataFrame:
    """(h, r, t, place): of each relation at most ``n`` triples of ``universe`` that touch an entity of ``reached`` (one column), drawn by a seeded
    hash: the same wherever drawn. ``exact`` leaves out relations with fewer."""
    v = reached.select(F.col(reached.columns[0]).alias("v")).distinct()
    at = lambda c: universe.select("h", "r", "t").join(v.withColumnRenamed("v", c), c, "left_semi").select("h", "r", "t")
    key = F.md5(F.concat_ws("|", F.lit(seed), "h", "r", "t"))
    # ranks beyond n are cut before the shuffle
    out = at("h").unionByName(at("t")).distinct().withColumn("place", F.row_number().over(Window.partitionBy("r").orderBy(key, "h", "t"))).where(F.col("place") <= n)
    if exact:
        out = out.join(out.where(F.col("place") == n).select("r"), "r", "left_semi")
    return out.select("h", "r", "t", "place")


def touching_parts(universe: DataFrame, graph: DataFrame, nodes: DataFrame) -> DataFrame:
    """Triples of ``universe`` that ``graph`` lacks and that touch one of the ``nodes`` (node): what small components could grow by."""
    v = nodes.select("node").distinct()
    at = lambda c: universe.select("h", "r", "t").join(v.withColumnRenamed("node", c), c, "left_semi").select("h", "r", "t")
    return at("h").unionByName(at("t")).distinct().join(graph.select("h", "r", "t"), ["h", "r", "t"], "left_anti")
