"""Bridge cuts: where a pair of nodes lies to every bridge, which pairs cross a cut, the bridges on the way between two nodes.

A bridge cut is known by the lower node of its bridge in a rooted spanning forest: the nodes below are a stretch of places in the walk, so
sides are never stored to be looked up.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kgloom.operators.graph import bridges, components, rooted, spanning_forest, two_edge_components
from kgloom.operators.unionfind import BOUND, LEAN
from kgloom.session import cut


def bridge_cuts(edges: DataFrame, bound: int = LEAN) -> tuple[DataFrame, DataFrame]:
    """(cuts: a, b, root, pre, size, whole, side; walk: node, root, pre) of the ``edges``: below the bridge (a, b) lie the ``size`` nodes of the tree
    of ``root`` from place ``pre`` on, out of ``whole``; ``side`` is the smaller of both sides."""
    walk = cut(rooted(cut(spanning_forest(edges, bound)), bound))
    b = bridges(edges, bound)
    lower = walk.where("parent IS NOT NULL").withColumns({"a": F.least("node", "parent"), "b": F.greatest("node", "parent")})
    cuts = b.join(lower, ["a", "b"]).select("a", "b", "root", "pre", "size", F.col("component_size").alias("whole"), "side")
    return cut(cuts), walk.select("node", "root", "pre")


def side_members(cuts: DataFrame, walk: DataFrame) -> DataFrame:
    """(a, b, node): the nodes of the smaller side of each of the ``cuts`` (of two equal sides the lower one). As many rows as the sides hold."""
    low = F.when(F.col("size") * 2 <= F.col("whole"), F.sequence("pre", F.col("pre") + F.col("size") - 1))
    # else the places before and after
    before = F.when(F.col("pre") > 0, F.sequence(F.lit(0).cast("long"), F.col("pre") - 1)).otherwise(F.array().cast("array<bigint>"))
    end = F.col("pre") + F.col("size")
    after = F.when(end < F.col("whole"), F.sequence(end, F.col("whole") - 1)).otherwise(F.array().cast("array<bigint>"))
    places = cuts.select("a", "b", "root", F.explode(F.coalesce(low, F.concat(before, after))).alias("pre"))
    return places.join(walk, ["root", "pre"]).select("a", "b", "node")


def bridge_tree(edges: DataFrame, bound: int = LEAN) -> tuple[DataFrame, DataFrame]:
    """(member: node, part; tree: part, up, a, b, root, pre, size): the parts that no bridge holds together, and the forest that the bridges
    (a, b) make of them, each part with the part above it (NULL at a root), the place in the walk and the size of the subtree in parts."""
    found = cut(bridges(edges, bound).select("a", "b"))
    member = cut(two_edge_components(edges, found).select("node", F.col("component").alias("part")))
    at = lambda c: member.select(F.col("node").alias(c), F.col("part").alias(f"_{c}"))
    ends = cut(found.join(at("a"), "a").join(at("b"), "b").select("a", "b", F.least("_a", "_b").alias("x"), F.greatest("_a", "_b").alias("y")))
    walk = rooted(ends.select(F.col("x").alias("a"), F.col("y").alias("b")), bound)
    walk = walk.withColumns({"x": F.least("node", "parent"), "y": F.greatest("node", "parent")})
    tree = walk.where("parent IS NOT NULL").join(ends, ["x", "y"]).select(F.col("node").alias("part"), F.col("parent").alias("up"), "a", "b", "root", "pre", "size")
    none = F.lit(None).cast(edges.schema["a"].dataType)
    roots = walk.where("parent IS NULL").select(F.col("node").alias("part"), none.alias("up"), none.alias("a"), none.alias("b"), "root", "pre", "size")
    return member, cut(tree.unionByName(roots))


def bridge_paths(pairs: DataFrame, member: DataFrame, tree: DataFrame) -> DataFrame:
    """(h, t, a, b): the bridges between the ends of each of the ``pairs`` (h, t); none for pairs that share a part or lie in different components.

    Each end climbs towards the part where both ways meet by jumps of 2^k parts, which are then split in halves until they name single
    parts: the rounds grow with the logarithm of the longest way.
    """
    place = tree.select("part", F.col("root").alias("_root"), F.col("pre").alias("_pre"))
    end = lambda c: member.select(F.col("node").alias(c), "part").join(place, "part").select(c, F.col("part").alias(f"p_{c}"), F.col("_root").alias(f"r_{c}"), F.col("_pre").alias(f"q_{c}"))
    both = pairs.select("h", "t").distinct().join(end("h"), "h").join(end("t"), "t").where("r_h = r_t AND p_h <> p_t")
    # one row for each end: the part it climbs from, and the place it has to get above
    open_ = cut(both.select("h", "t", F.explode(F.array(F.struct(F.col("p_h").alias("at"), F.col("q_t").alias("to")), F.struct(F.col("p_t").alias("at"), F.col("q_h").alias("to")))).alias("x")).select("h", "t", "x.at", "x.to"))
    span = cut(tree.select(F.col("part").alias("_part"), "pre", "size"))
    over = lambda: (F.col("to") >= F.col("pre")) & (F.col("to") < F.col("pre") + F.col("size"))
    # an end that holds the other below it doesn't climb at all
    open_ = cut(open_.join(span, F.col("at") == F.col("_part")).where(~over()).select("h", "t", "at", "to"))
    jumps = [cut(tree.where("up IS NOT NULL").select("part", "up"))]
    while True:
        j = jumps[-1]
        twice = cut(j.join(j.select(F.col("part").alias("up"), F.col("up").alias("_up")), "up").select("part", F.col("_up").alias("up")))
        if twice.isEmpty():
            break
        jumps.append(twice)
    pieces: list[tuple[int, DataFrame]] = []
    for k in range(len(jumps) - 1, -1, -1):
        j = open_.join(jumps[k].select(F.col("part").alias("at"), "up"), "at", "left").join(span, F.col("up") == F.col("_part"), "left")
        j = cut(j.withColumn("_goes", F.col("up").isNotNull() & ~over()).select("h", "t", "at", "to", "up", F.coalesce("_goes", F.lit(False)).alias("_goes")))
        pieces.append((k, j.where("_goes").select("h", "t", "at")))
        open_ = cut(j.select("h", "t", F.when(F.col("_goes"), F.col("up")).otherwise(F.col("at")).alias("at"), "to"))
    ways = open_.select("h", "t", "at")
    rest: DataFrame | None = None
    for k, piece in pieces:
        rest = piece if rest is None else rest.unionByName(piece)
        if k:
            half = rest.join(jumps[k - 1].select(F.col("part").alias("at"), "up"), "at")
            rest = cut(half.select("h", "t", F.explode(F.array("at", "up")).alias("at")))
    every = ways if rest is None else ways.unionByName(rest)
    return every.join(tree.where("up IS NOT NULL").select(F.col("part").alias("at"), "a", "b"), "at").select("h", "t", "a", "b")


def crossing(candidates: DataFrame, edges: DataFrame, tested: DataFrame | None = None, bound: int = LEAN) -> DataFrame:
    """(h, r, t, a, b): candidates with both ends in one component of ``edges`` and the bridges (of ``tested`` (a, b), if given) whose sides they
    join. Adding the candidate makes up for the loss of any of these bridges."""
    member, tree = bridge_tree(edges, bound)
    way = bridge_paths(candidates.where("h <> t"), member, tree)
    if tested is not None:
        way = way.join(tested.select("a", "b").distinct(), ["a", "b"], "left_semi")
    return candidates.select("h", "r", "t").join(way, ["h", "t"]).select("h", "r", "t", "a", "b")


def connected_after_swaps(swaps: DataFrame, edges: DataFrame, bound: int = LEAN) -> DataFrame:
    """``swaps`` (a, b: an edge to remove; h, t: one to add) with ``whole``: do the ends of the removed edge stay connected? They do unless it is
    a bridge that the added edge doesn't make up for."""
    member, tree = bridge_tree(edges, bound)
    flat = swaps.withColumns({"_a": F.least("a", "b"), "_b": F.greatest("a", "b")})
    bridge = tree.where("up IS NOT NULL").select(F.col("a").alias("_a"), F.col("b").alias("_b"), F.lit(True).alias("_bridge"))
    way = bridge_paths(swaps.where("h <> t"), member, tree).select("h", "t", F.col("a").alias("_a"), F.col("b").alias("_b"), F.lit(True).alias("_joins"))
    m = flat.join(bridge, ["_a", "_b"], "left").join(way, ["h", "t", "_a", "_b"], "left")
    return m.withColumn("whole", F.col("_bridge").isNull() | F.col("_joins").isNotNull()).drop("_a", "_b", "_bridge", "_joins")


def strong_components(arcs: DataFrame, bound: int = BOUND) -> DataFrame:
    """(node, component) of directed ``arcs`` (h, t): component is the smallest node that reaches and is reached by the node.

    Every node takes the smallest name that reaches it; inside such a class what reaches its namesake backwards is a strong component. These
    are taken out with the arcs between classes, and so on until no arc is left. Nodes without an arc on either side are taken out first.
    """
    every = cut(arcs.where("h IS NOT NULL AND t IS NOT NULL").select("h", "t").distinct())
    nodes = every.select(F.explode(F.array("h", "t")).alias("node")).distinct()
    left = cut(every.where("h <> t"))
    done: list[DataFrame] = []
    while True:
        # what has no arc in or no arc out is alone
        while True:
            ends = left.select(F.col("h").alias("node")).distinct().join(left.select(F.col("t").alias("node")).distinct(), "node")
            kept = cut(left.join(ends.withColumnRenamed("node", "h"), "h", "left_semi").join(ends.withColumnRenamed("node", "t"), "t", "left_semi").select("h", "t"))
            same, left = kept.count() == left.count(), kept
            if same:
                break
        if left.isEmpty():
            break
        colour = _spread(left, left.select(F.explode(F.array("h", "t")).alias("node")).distinct().withColumn("c", F.col("node")))
        c = lambda e: colour.select(F.col("node").alias(e), F.col("c").alias(f"c_{e}"))  # noqa: E731, B023
        inside = cut(left.join(c("h"), "h").join(c("t"), "t").where("c_h = c_t").select("h", "t", F.col("c_h").alias("c")))
        back = _reached(inside.select(F.col("t").alias("h"), F.col("h").alias("t")), colour.where("node = c").select("node"))
        found = cut(back.join(colour, "node").select("node", F.col("c").alias("component")))
        done.append(found)
        gone = found.select("node")
        left = cut(inside.join(gone.withColumnRenamed("node", "h"), "h", "left_anti").join(gone.withColumnRenamed("node", "t"), "t", "left_anti").select("h", "t"))
    if not done:
        return nodes.select("node", F.col("node").alias("component"))
    return nodes.join(reduce(DataFrame.unionByName, done), "node", "left").select("node", F.coalesce("component", "node").alias("component"))


def _spread(arcs: DataFrame, colour: DataFrame) -> DataFrame:
    """The smallest ``c`` that reaches each node along the arcs; only what changed is handed on."""
    known = fresh = cut(colour)
    while not fresh.isEmpty():
        told = arcs.join(fresh.select(F.col("node").alias("h"), "c"), "h").groupBy(F.col("t").alias("node")).agg(F.min("c").alias("_c"))
        m = cut(known.join(told, "node", "left").select("node", F.least("c", "_c").alias("c"), (F.col("_c") < F.col("c")).alias("_new")))
        known, fresh = m.select("node", "c"), m.where("_new").select("node", "c")
    return known


def _reached(arcs: DataFrame, start: DataFrame) -> DataFrame:
    known = fresh = cut(start)
    while not fresh.isEmpty():
        fresh = cut(arcs.join(fresh.withColumnRenamed("node", "h"), "h", "left_semi").select(F.col("t").alias("node")).distinct().join(known, "node", "left_anti"))
        known = cut(known.unionByName(fresh))
    return known
