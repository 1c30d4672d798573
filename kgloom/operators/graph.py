"""Iterative graph operators on undirected edges (a, b): components, spanning forests, bridges, two-edge-connected parts.

Every loop keeps its state in tables written to the shared folder (:func:`kgloom.session.cut`), so the lineage stays short and a lost
executor costs one round. Nothing is collected but counts.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from kgloom.operators.lowlink import articulation_rows, bridge_rows, rooted_rows
from kgloom.operators.skew import hot_join, running_totals
from kgloom.operators.unionfind import BOUND, LEAN, LEAN_BYTES, first_kept, forest, kept
from kgloom.session import cut, drop_cut


def simple_edges(df: DataFrame, a: str = "h", b: str = "t") -> DataFrame:
    """Distinct pairs a < b; self-loops and NULL ends are dropped."""
    ends = df.where(F.col(a).isNotNull() & F.col(b).isNotNull())
    return ends.select(F.least(a, b).alias("a"), F.greatest(a, b).alias("b")).where("a < b").distinct()


def _state(df: DataFrame) -> tuple[int, int]:
    r = df.agg(F.count(F.lit(1)).alias("n"), F.coalesce(F.bit_xor(F.xxhash64(*df.columns)), F.lit(0)).alias("x")).collect()[0]
    return r.n, r.x


def components(edges: DataFrame, nodes: DataFrame | None = None, bound: int = LEAN) -> DataFrame:
    """(node, component): component is the smallest node that a node is linked to directly or through others.

    One task finds them by union-find for up to ``bound`` edges. Beyond, partitions of bounded size are contracted to stars first, then large-star and small-star
    steps alternate on what is left: every node links its larger neighbours to its smallest one, then its smaller neighbours to the smallest;
    the rounds grow with the logarithm of the graph. Hubs make skewed joins, which adaptive execution splits. ``nodes`` (one column) adds
    nodes that may have no edge.
    """
    first = e = cut(edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct())
    e = e.where("u <> v")
    one, parts = _small(e.select(F.col("u").alias("a"), F.col("v").alias("b")), bound), 1
    if one is None:
        parts = max(2, -(-e.count() // min(bound, BOUND)))
        one = e.repartitionByRange(parts, "v", "u")
    kind = e.schema["u"].dataType.simpleString()
    e = cut(one.mapInArrow(forest, f"u {kind}, v {kind}").where("u <> v"))
    seen = _state(e) if parts > 1 else (0, 0)
    while seen[0]:
        both = e.select(F.col("u").alias("x"), F.col("v").alias("y")).unionByName(e.select(F.col("v").alias("x"), F.col("u").alias("y")))
        low = both.groupBy("x").agg(F.min(F.least("x", "y")).alias("m"))
        # a node without larger neighbours is covered from their side
        large = cut(both.where("y > x").join(low, "x").select(F.col("y").alias("u"), F.col("m").alias("v")).distinct())
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        after = cut(small.unionByName(least.select("u", F.col("m").alias("v"))).distinct())
        now = _state(after)
        drop_cut(large)
        e = after
        if now == seen:
            break
        seen = now
    members = e.select(F.col("u").alias("node"), F.col("v").alias("component"))
    every = first.select(F.explode(F.array("u", "v")).alias("node"))
    if nodes is not None:
        every = every.unionByName(nodes.select(F.col(nodes.columns[0]).alias("node")))
    return every.distinct().join(members, "node", "left").select("node", F.coalesce("component", "node").alias("component"))


def component_sizes(members: DataFrame) -> DataFrame:
    return members.groupBy("component").agg(F.count(F.lit(1)).alias("entities"))


def connectivity(members: DataFrame) -> DataFrame:
    """One row: components, size of the largest, its share."""
    s = component_sizes(members)
    return s.agg(F.count(F.lit(1)).alias("components"), F.coalesce(F.max("entities"), F.lit(0)).alias("largest"), F.round(F.max("entities") / F.sum("entities"), 9).alias("largest_share"))


def component_stats(triples: DataFrame, members: DataFrame) -> DataFrame:
    """Per component: entities, triples, relations, its most frequent relation (ties: smaller)."""
    m = triples.join(members.select(F.col("node").alias("h"), "component"), "h")
    per = m.groupBy("component", "r").agg(F.count(F.lit(1)).alias("n"))
    top = Window.partitionBy("component").orderBy(F.col("n").desc(), "r")
    best = per.withColumn("_k", F.row_number().over(top)).where("_k = 1").select("component", F.col("r").alias("top_relation"))
    out = per.groupBy("component").agg(F.sum("n").alias("triples"), F.count(F.lit(1)).alias("relations"))
    return component_sizes(members).join(out, "component").join(best, "component").select("component", "entities", "triples", "relations", "top_relation")


def _sized(triples: DataFrame, members: DataFrame) -> tuple[DataFrame, DataFrame]:
    m = triples.join(members.select(F.col("node").alias("h"), "component"), "h")
    return m, m.groupBy("component").agg(F.count(F.lit(1)).alias("_t")).join(component_sizes(members), "component")


def select_components(triples: DataFrame, members: DataFrame, min_nodes: int = 1, min_triples: int = 1, largest_only: bool = False, without_largest: bool = False, at_most: int | None = None) -> DataFrame:
    """Triples of the components of that size; the largest (most nodes, then triples, then smallest name) alone or left out; ``at_most`` so many
    of the largest that are left."""
    m, size = _sized(triples, members)
    order = [F.col("entities").desc(), F.col("_t").desc(), F.col("component")]
    first = size.orderBy(*order).limit(1).select("component")
    if largest_only:
        size = size.join(first, "component", "left_semi")
    if without_largest:
        size = size.join(first, "component", "left_anti")
    keep = size.where((F.col("entities") >= min_nodes) & (F.col("_t") >= min_triples))
    if at_most is not None:
        keep = keep.orderBy(*order).limit(at_most)
    return m.join(keep.select("component"), "component", "left_semi").select("h", "r", "t")


def component_of_rank(triples: DataFrame, members: DataFrame, rank: int) -> DataFrame:
    """Triples of the component that comes ``rank``-th by nodes, then triples, then name; none if there are fewer."""
    m, size = _sized(triples, members)
    order = [F.col("entities").desc(), F.col("_t").desc(), F.col("component")]
    top = size.orderBy(*order).limit(rank)
    one = top.withColumn("_p", F.row_number().over(Window.orderBy(*order))).where(F.col("_p") == rank).select("component")  # ``rank`` rows
    return m.join(one, "component", "left_semi").select("h", "r", "t")


def component_top_relations(triples: DataFrame, members: DataFrame, k: int) -> DataFrame:
    """(component, r, n, place): the ``k`` most frequent relations of every component, ties by name."""
    per = triples.join(members.select(F.col("node").alias("h"), "component"), "h").groupBy("component", "r").agg(F.count(F.lit(1)).alias("n"))
    return per.withColumn("place", F.row_number().over(Window.partitionBy("component").orderBy(F.col("n").desc(), "r"))).where(F.col("place") <= k)


def without_weak_components(triples: DataFrame, members: DataFrame, min_triples: int, min_entities: int) -> DataFrame:
    """Triples of components that are large enough or hold the only triple of some relation."""
    m = triples.join(members.select(F.col("node").alias("h"), "component"), "h")
    only = triples.groupBy("r").agg(F.count(F.lit(1)).alias("_n")).where("_n = 1").select("r")
    needed = m.join(only, "r", "left_semi").select("component").distinct()
    size = m.groupBy("component").agg(F.count(F.lit(1)).alias("_t")).join(component_sizes(members), "component")
    keep = size.where((F.col("_t") >= min_triples) & (F.col("entities") >= min_entities)).select("component").unionByName(needed).distinct()
    return m.join(keep, "component", "left_semi").select("h", "r", "t")


def _small(edges: DataFrame, bound: int, *more: str) -> DataFrame | None:
    """The edges (a, b, ``more``) in one partition if they are at most ``bound`` and their names take no more than ``LEAN_BYTES``, which a single task can hold as
    arrays; else None. Bring a written table, as it is read twice."""
    name = lambda c: F.octet_length(F.col(c).cast("string"))
    n, size = edges.agg(F.count(F.lit(1)), F.coalesce(F.sum(name("a") + name("b")), F.lit(0))).collect()[0]
    return edges.select("a", "b", *more).coalesce(1) if n <= bound and size <= LEAN_BYTES else None


def spanning_forest(edges: DataFrame, bound: int = LEAN) -> DataFrame:
    """The edges (a, b) that stay if all ``edges`` (simple, a < b) come in order and each that closes a cycle is dropped.

    One task finds it for up to ``bound`` edges. Beyond, partitions of bounded size drop what closes a cycle inside them, which is never part of
    that forest. While more edges than one such partition are left, parts are joined in rounds: a coin decides for each part whether it may join another or be joined, and a joining part
    takes its first edge if that leads to one that may be joined. That edge belongs to the forest, and a quarter of the parts goes in each
    round on average. The forest is the same for any ``bound``.
    """
    edges = cut(edges.select("a", "b").distinct())
    if (one := _small(edges, bound)) is not None:
        return one.mapInArrow(first_kept, one.schema)
    e, bound = edges.select(F.col("a").alias("u"), F.col("b").alias("v"), "a", "b"), min(bound, BOUND)
    n, turn = e.count(), 0
    done: list[DataFrame] = []
    while n > bound:
        thin = cut(e.repartitionByRange(-(-n // bound), "u", "v").mapInArrow(kept, e.schema))
        drop_cut(e)
        e, n = thin, thin.count()
        if n <= bound:
            break
        coin = lambda c: F.pmod(F.xxhash64(F.lit(turn), F.col(c)), F.lit(2)) == 0  # noqa: E731, B023
        both = thin.select(F.col("u").alias("x"), F.col("v").alias("y"), "a", "b").unionByName(thin.select(F.col("v").alias("x"), F.col("u").alias("y"), "a", "b"))
        first = both.where(coin("x")).groupBy("x").agg(F.min(F.struct("a", "b", "y")).alias("e")).select("x", "e.*").where(~coin("y"))
        first = cut(first)
        done.append(first.select("a", "b"))
        to = first.select("x", F.col("y").alias("_to"))
        moved = hot_join(thin, to, ("u", "x"), "left").withColumn("u", F.coalesce("_to", "u")).drop("_to")
        moved = hot_join(cut(moved), to, ("v", "x"), "left").withColumn("v", F.coalesce("_to", "v")).drop("_to").where("u <> v")
        e = moved.groupBy(F.least("u", "v").alias("u"), F.greatest("u", "v").alias("v")).agg(F.min(F.struct("a", "b")).alias("e")).select("u", "v", "e.a", "e.b")
        e = cut(e)
        n, turn = e.count(), turn + 1
    done.append(e.coalesce(1).mapInArrow(kept, e.schema).select("a", "b"))
    return reduce(DataFrame.unionByName, done)


def rooted(tree: DataFrame, bound: int = LEAN) -> DataFrame:
    """(node, parent, root, pre, size) of a forest (a, b): each tree is walked depth first from its smallest node (its ``root``, parent NULL), at
    every node on from the neighbour that follows the parent in order, round and round. ``pre`` is the place in that walk from 0, ``size`` the
    nodes of the subtree.

    One task walks forests of up to ``bound`` edges. Beyond, the walk is a linked list of the edges in both directions, and places in it come
    from pointer jumping: the rounds grow with the logarithm of the largest tree, however deep it is. Both give the same.
    """
    kind = tree.schema["a"].dataType.simpleString()
    if (one := _small(tree, bound)) is not None:
        return one.mapInArrow(rooted_rows, f"node {kind}, parent {kind}, root {kind}, pre long, size long")
    arcs = tree.select(F.explode(F.array(F.struct(F.col("a").alias("v"), F.col("b").alias("w")), F.struct(F.col("b").alias("v"), F.col("a").alias("w")))).alias("x")).select("x.*")
    arcs = cut(running_totals(arcs, ["v"], [F.col("w")], total="i"))
    degree = arcs.groupBy(F.col("v").alias("_v")).agg(F.count(F.lit(1)).alias("n"))
    around = hot_join(arcs, degree, ("v", "_v"))
    # who comes into v from w goes on to the neighbour of v after w
    after = around.select("v", "w", (F.pmod(F.col("i"), F.col("n")) + 1).alias("i")).join(arcs.select("v", "i", F.col("w").alias("on")), ["v", "i"])
    start = components(tree).where("node = component").select(F.col("node").alias("_root"), F.lit(1).cast("long").alias("_i"))
    begin = start.join(arcs, (F.col("v") == F.col("_root")) & (F.col("i") == F.col("_i"))).select(F.col("v").alias("_bv"), F.col("w").alias("_bw"))
    # the list ends where it would begin again; that step comes back to the root
    step = after.join(begin, (F.col("v") == F.col("_bv")) & (F.col("on") == F.col("_bw")), "left")
    last = F.col("_bv").isNotNull()
    walk = cut(step.select(F.col("w").alias("x"), F.col("v").alias("y"), F.when(~last, F.col("v")).alias("nx"), F.when(~last, F.col("on")).alias("ny"), F.lit(1).cast("long").alias("left"), F.when(last, F.col("v")).alias("root")))
    while not walk.where("nx IS NOT NULL").isEmpty():
        ahead = walk.select(F.col("x").alias("_x"), F.col("y").alias("_y"), F.col("nx").alias("_nx"), F.col("ny").alias("_ny"), F.col("left").alias("_left"), F.col("root").alias("_root"))
        open_ = walk.where("nx IS NOT NULL").join(ahead, (F.col("nx") == F.col("_x")) & (F.col("ny") == F.col("_y")))
        walk, old = cut(walk.where("nx IS NULL").unionByName(open_.select("x", "y", F.col("_nx").alias("nx"), F.col("_ny").alias("ny"), (F.col("left") + F.col("_left")).alias("left"), F.col("_root").alias("root")))), walk
        drop_cut(old)
    back = walk.select(F.col("y").alias("x"), F.col("x").alias("y"), F.col("left").alias("_back"))
    # the longer way to the end is the way down
    down = walk.join(back, ["x", "y"]).where(F.col("left") > F.col("_back"))
    below = down.select(F.col("y").alias("node"), F.col("x").alias("parent"), "root", "left", F.floor((F.col("left") - F.col("_back") + 1) / 2).alias("size"))
    placed = running_totals(below, ["root"], [F.col("left").desc()], total="pre").drop("left")
    top = placed.groupBy("root").agg((F.count(F.lit(1)) + 1).alias("size")).select(F.col("root").alias("node"), F.lit(None).cast(kind).alias("parent"), "root", F.lit(0).cast("long").alias("pre"), "size")
    return placed.select("node", "parent", "root", "pre", "size").unionByName(top)


def reaches(edges: DataFrame, bound: int = LEAN) -> tuple[DataFrame, DataFrame]:
    """(forest with low and high, edges outside of the forest): a spanning forest as :func:`rooted` gives it, and for each node the smallest and
    largest ``pre`` that an edge outside of the forest reaches from its subtree, or the bounds of the subtree itself.

    A subtree is a stretch of places, so its bounds come from those of stretches of doubled length: rounds by the logarithm of the largest tree.
    """
    tree = cut(spanning_forest(edges, bound))
    walk = cut(rooted(tree, bound))
    at = lambda c: walk.select(F.col("node").alias(c), F.col("pre").alias(f"pre_{c}"), F.col("size").alias(f"size_{c}"))
    extra = cut(edges.select("a", "b").join(tree, ["a", "b"], "left_anti"))
    extra = cut(hot_join(cut(hot_join(extra, at("a").withColumnRenamed("a", "_a"), ("a", "_a"))), at("b").withColumnRenamed("b", "_b"), ("b", "_b")))
    ends = extra.select(F.explode(F.array(F.struct(F.col("a").alias("n"), F.col("pre_b").alias("p")), F.struct(F.col("b").alias("n"), F.col("pre_a").alias("p")))).alias("x"))
    seen = ends.groupBy(F.col("x.n").alias("_n")).agg(F.min("x.p").alias("_lo"), F.max("x.p").alias("_hi"))
    span = cut(walk.join(seen, F.col("node") == F.col("_n"), "left").select("root", "pre", F.least("pre", "_lo").alias("lo"), F.greatest("pre", "_hi").alias("hi")))
    found: list[DataFrame] = []
    length, open_ = 1, walk
    while True:
        mine = open_.where((F.col("size") >= length) & (F.col("size") < 2 * length))
        left = mine.join(span, ["root", "pre"])
        right = span.select("root", F.col("pre").alias("_p"), F.col("lo").alias("_lo"), F.col("hi").alias("_hi"))
        both = left.withColumn("_p", F.col("pre") + F.col("size") - length).join(right, ["root", "_p"])
        found.append(cut(both.select(*walk.columns, F.least("lo", "_lo").alias("low"), F.greatest("hi", "_hi").alias("high"))))
        open_ = open_.where(F.col("size") >= 2 * length)
        if open_.isEmpty():
            return reduce(DataFrame.unionByName, found), extra
        shifted = span.select("root", (F.col("pre") - length).alias("pre"), F.col("lo").alias("_lo"), F.col("hi").alias("_hi"))
        span, old = cut(span.join(shifted, ["root", "pre"]).select("root", "pre", F.least("lo", "_lo").alias("lo"), F.greatest("hi", "_hi").alias("hi"))), span
        drop_cut(old)
        length *= 2


def bridges(edges: DataFrame, bound: int = LEAN) -> DataFrame:
    """(a, b, side, component_size): edges (simple, a < b) whose removal parts their component; ``side`` is the size of the smaller part.

    Up to ``bound`` edges one task finds them by low points. Beyond, an edge of a spanning forest is a bridge if no other edge leaves its
    subtree (:func:`reaches`). Both are exact.
    """
    if (one := _small(edges, bound)) is not None:
        kind = edges.schema["a"].dataType.simpleString()
        return one.mapInArrow(bridge_rows, f"a {kind}, b {kind}, side long, component_size long")
    walk, _ = reaches(edges, bound)
    whole = walk.where("parent IS NULL").select(F.col("node").alias("_root"), F.col("size").alias("_whole"))
    inside = walk.where("parent IS NOT NULL AND low >= pre AND high < pre + size")
    found = hot_join(cut(inside), whole, ("root", "_root"))
    return found.select(F.least("node", "parent").alias("a"), F.greatest("node", "parent").alias("b"), F.least("size", F.col("_whole") - F.col("size")).alias("side"), F.col("_whole").alias("component_size"))


def two_edge_components(edges: DataFrame, bridge: DataFrame | None = None) -> DataFrame:
    """(node, component) of the graph without its bridges; a node between bridges only is a component of its own."""
    b = bridges(edges) if bridge is None else bridge
    nodes = edges.select(F.explode(F.array("a", "b")).alias("node")).distinct()
    return components(edges.join(b.select("a", "b"), ["a", "b"], "left_anti"), nodes)


def bridge_forest(members: DataFrame, bridge: DataFrame) -> DataFrame:
    """Bridges as edges (ca, cb) between two-edge components, with their ends."""
    return bridge.select("a", "b", "side").join(members.select(F.col("node").alias("a"), F.col("component").alias("ca")), "a").join(members.select(F.col("node").alias("b"), F.col("component").alias("cb")), "b")


def blocks(edges: DataFrame, bound: int = LEAN) -> DataFrame:
    """(node, block): the two-node-connected parts each node of an edge belongs to; a bridge is a block of its own.

    A tree edge is named by its lower node. Two tree edges share a block if an edge outside of the tree says so: one that leaves a subtree
    past its parent's, or one between unrelated subtrees.
    """
    walk, extra = reaches(edges, bound)
    walk = cut(walk)
    lower = walk.where("parent IS NOT NULL")
    up = walk.where("parent IS NOT NULL").select(F.col("node").alias("_q"), F.col("pre").alias("_qp"), F.col("size").alias("_qs"))
    inner = hot_join(cut(lower), up, ("parent", "_q"))
    leave = inner.where((F.col("low") < F.col("_qp")) | (F.col("high") >= F.col("_qp") + F.col("_qs"))).select(F.col("node").alias("a"), F.col("parent").alias("b"))
    apart = extra.where("pre_a + size_a <= pre_b OR pre_b + size_b <= pre_a").select("a", "b")
    named = components(leave.unionByName(apart), lower.select("node"))
    of = lower.select("node", "parent").join(named.withColumnRenamed("component", "block"), "node")
    return of.select(F.explode(F.array("node", "parent")).alias("node"), "block").distinct()


def articulation_points(edges: DataFrame, bound: int = LEAN) -> DataFrame:
    """(node, blocks): nodes whose removal parts their component, with the number of blocks that meet there.

    Up to ``bound`` edges (simple, a < b) one task finds them by low points; beyond, :func:`blocks` does.
    """
    if (one := _small(edges, bound)) is not None:
        return one.mapInArrow(articulation_rows, f"node {edges.schema['a'].dataType.simpleString()}, blocks long")
    return blocks(edges, bound).groupBy("node").agg(F.count(F.lit(1)).alias("blocks")).where("blocks > 1")
