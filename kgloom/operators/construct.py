"""Building and trimming graphs under budgets: greedy selection, component merging, safe deletion, conflict-free moves.

The sequential originals look at one edge at a time. Here each loop takes all edges of a round that cannot influence each other: the result
is the same where the order alone decides (merging, matching), and keeps the same guarantees where it depends on a running state.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from kgloom.operators.candidates import bridge_bonus
from kgloom.operators.graph import components, simple_edges, spanning_forest
from kgloom.operators.greedy import CANDIDATES, greedy_rows
from kgloom.operators.skew import running_totals
from kgloom.operators.triples import degrees, incidence
from kgloom.session import cut


# Weights of the selection score.
@dataclass(frozen=True)
class GreedyWeights:
    need: float = 3.0
    first: float = 8.0
    attach: float = 2.0
    bridge: float = 2.0
    merge: float = 3.0
    hub: float = 1.5
    generic: float = 1.25
    noise: float = 1.25


def greedy_core(candidates: DataFrame, alloc: DataFrame, budget: int, batch: int, seeds: DataFrame, weights: GreedyWeights = GreedyWeights(), bound: int = CANDIDATES) -> DataFrame:
    """(h, r, t, turn, score) of at most ``budget`` triples chosen by a score that depends on what is chosen already.

    ``candidates``: h, r, t, hub_penalty, genericity_score, quality_score, a set. Each turn scores all open candidates against the chosen
    graph (need of the relation, first of its relation, ends known, relations at the ends, components joined, degree) and takes the best
    ``batch`` of them, no relation beyond its budget, ties by (r, h, t). With ``batch`` = 1 the turns are those of a sequential greedy run.
    What is chosen is bounded by ``budget``; candidates are never collected to the driver. For ``batch`` = 1 one task takes all turns if there
    are at most ``bound`` candidates; beyond, every turn is a round of joins, with the same result.
    """
    c = cut(candidates.select("h", "r", "t", *[F.coalesce(F.when(~F.isnan(x), F.col(x)), F.lit(0.0)).alias(x) for x in ("hub_penalty", "genericity_score", "quality_score")]))
    inc = incidence(c)
    c = cut(c.join(inc.select(F.col("entity").alias("h"), F.col("n_relations").alias("_ih")), "h").join(inc.select(F.col("entity").alias("t"), F.col("n_relations").alias("_it")), "t"))
    quota = cut(alloc.groupBy(F.col("relation").alias("r")).agg(F.floor(F.sum("eta")).cast("long").alias("quota")))
    chosen = cut(seeds.select("h", "r", "t").distinct().join(quota, "r").withColumn("_p", F.row_number().over(Window.partitionBy("r").orderBy("h", "t"))).where("_p <= quota").orderBy("r", "h", "t").limit(budget).select("h", "r", "t", F.lit(0).alias("turn"), F.lit(0.0).alias("score")))
    turn, n = 0, chosen.count()
    if batch == 1:
        rows = c.join(quota.where("quota > 0").select("r"), "r", "left_semi").select("h", "r", "t", "hub_penalty", "genericity_score", "quality_score", bridge_bonus(F.col("_ih") + F.col("_it")).cast("double").alias("bridge"))
        if len(rows.select("r").take(bound + 1)) <= bound:
            # bounded by the budget and by the relations
            start, room = [(x.h, x.r, x.t) for x in chosen.collect()], {x.r: x.quota for x in quota.where("quota > 0").collect()}
            taken = rows.repartition(1).sortWithinPartitions("r", "h", "t").mapInArrow(greedy_rows(start, room, budget, weights), "h string, r string, t string, turn int, score double")
            return cut(chosen.unionByName(taken))
    while n < budget:
        turn += 1
        left = quota.join(chosen.groupBy("r").agg(F.count(F.lit(1)).alias("_n")), "r", "left").select("r", "quota", F.coalesce("_n", F.lit(0)).alias("_n")).where("_n < quota")
        deg = degrees(chosen).select("entity", "degree")
        comp = components(simple_edges(chosen), deg.select("entity"))
        node = cut(deg.join(comp.withColumnRenamed("node", "entity"), "entity"))
        top = node.agg(F.coalesce(F.max("degree"), F.lit(1)).alias("m")).collect()[0].m
        side = lambda e: node.select(F.col("entity").alias(e), F.col("degree").alias(f"_d{e}"), F.col("component").alias(f"_c{e}"))  # noqa: E731, B023
        s = c.join(left, "r").join(chosen.select("h", "r", "t"), ["h", "r", "t"], "left_anti").join(side("h"), "h", "left").join(side("t"), "t", "left")
        has_h, has_t = F.col("_ch").isNotNull(), F.col("_ct").isNotNull()
        attach = F.when(has_h & has_t, 1.0).when(has_h | has_t, 0.6).otherwise(0.1)
        merge = F.when(has_h & has_t & (F.col("_ch") != F.col("_ct")), 1.0).otherwise(0.0)
        crowd = F.least(F.lit(1.0), F.greatest(F.coalesce("_dh", F.lit(0)), F.coalesce("_dt", F.lit(0))) / top)
        w = weights
        score = (
            w.need * (F.col("quota") - F.col("_n")) / F.col("quota")
            + w.first * (F.col("_n") == 0).cast("double")
            + w.attach * attach
            + w.bridge * bridge_bonus(F.col("_ih") + F.col("_it"))
            + w.merge * merge
            - w.hub * F.greatest(crowd, "hub_penalty")
            - w.generic * F.col("genericity_score")
            - w.noise * (1.0 - F.col("quality_score"))
        )
        order = [F.col("score").desc(), F.col("r"), F.col("h"), F.col("t")]
        s = s.withColumn("score", F.round(score, 9)).withColumn("_p", F.row_number().over(Window.partitionBy("r").orderBy(*order)))
        # no more than a batch of any relation can be taken, so the window keeps bounded heads
        s = s.where((F.col("_p") <= batch) & (F.col("_p") <= F.col("quota") - F.col("_n")))
        new = cut(s.orderBy(*order).limit(min(batch, budget - n)).select("h", "r", "t", F.lit(turn).alias("turn"), "score"))
        got = new.count()
        if not got:
            break
        chosen = cut(chosen.unionByName(new))
        n += got
    return chosen


def first_of_missing(graph: DataFrame, candidates: DataFrame, alloc: DataFrame, order: list[Column]) -> DataFrame:
    """The best candidate of every allocated relation that the graph lacks."""
    missing = alloc.select(F.col("relation").alias("r")).distinct().join(graph.select("r").distinct(), "r", "left_anti")
    return candidates.join(missing, "r", "left_semi").withColumn("_p", F.row_number().over(Window.partitionBy("r").orderBy(*order))).where("_p = 1").drop("_p")


def select_additions(rows: DataFrame, counts: DataFrame, alloc: DataFrame, budget: int, order: list[Column], pattern: str = "composition") -> DataFrame:
    """The ``rows`` (h, r, t, ...) that a pass in the strict ``order`` accepts, at most ``budget``: of allocated relations, and of those in
    ``pattern`` only while the pattern's running total is below its budget.

    The total is the sum over relations of their triples times the pattern's share of their budget, rounded half to even, and counts every
    accepted row. It never falls, so the rows of the pattern that are accepted are the first ones, and no more than the first ``budget`` of
    either kind have to be looked at. ``counts``: relation, n of the graph; ``alloc``: pattern, relation, eta.
    """
    inside = F.sum(F.when(F.col("pattern") == pattern, F.col("eta")).otherwise(0.0))
    share = alloc.groupBy(F.col("relation").alias("r")).agg((F.max((F.col("pattern") == pattern).cast("int")) == 1).alias("_in"), F.coalesce(F.when(F.sum("eta") > 0, inside / F.sum("eta")), F.lit(0.0)).alias("_share"))
    share = cut(share.join(counts.select(F.col("relation").alias("r"), F.col("n").alias("_n")), "r", "left").withColumn("_n", F.coalesce("_n", F.lit(0))))
    total = lambda n: F.bround(n * F.col("_share"), 0)
    start = share.agg(F.coalesce(F.sum(total(F.col("_n"))), F.lit(0.0)).alias("s")).collect()[0].s
    expected = alloc.where(F.col("pattern") == pattern).agg(F.coalesce(F.sum("eta"), F.lit(0.0)).alias("e")).collect()[0].e
    open_ = rows.join(share, "r")
    heads = [cut(open_.where(side).orderBy(*order).limit(budget)) for side in (F.col("_in"), ~F.col("_in"))]
    k = F.row_number().over(Window.partitionBy("r").orderBy(*order))
    grown = heads[0].withColumn("_k", k).withColumn("_inc", total(F.col("_n") + F.col("_k")) - total(F.col("_n") + F.col("_k") - 1))
    # at most ``budget`` rows, so one task may sum them up
    before = F.coalesce(F.sum("_inc").over(Window.orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0))
    taken = grown.withColumn("_before", before).where(F.lit(float(start)) + F.col("_before") < F.lit(float(expected)))
    return taken.select(*rows.columns).unionByName(heads[1].select(*rows.columns)).orderBy(*order).limit(budget)


def merge_components(graph: DataFrame, candidates: DataFrame, score: str) -> DataFrame:
    """The candidates (h, r, t, ``score``) that a greedy pass from the best down would add because they join two components of ``graph``.

    Rounds of "every component takes its best edge" (ties by r, h, t) find the same edges as the pass in sorted order, since the order is
    strict, and at least halve the components that can still be joined.
    """
    members = cut(components(simple_edges(graph), graph.select(F.explode(F.array("h", "t")).alias("node")).distinct()))
    side = lambda e, m: m.select(F.col("node").alias(e), F.col("component").alias(f"_{e}"))
    open_ = cut(candidates.select("h", "r", "t", score).join(side("h", members), "h").join(side("t", members), "t").where("_h <> _t"))
    picked: DataFrame | None = None
    while not open_.isEmpty():
        ends = open_.select("*", F.explode(F.array("_h", "_t")).alias("_c"))
        w = Window.partitionBy("_c").orderBy(F.col(score).desc_nulls_last(), "r", "h", "t")
        best = cut(ends.withColumn("_p", F.row_number().over(w)).where("_p = 1").select("h", "r", "t", score, "_h", "_t").distinct())
        picked = best if picked is None else picked.unionByName(best)
        merged = cut(components(simple_edges(best.select(F.col("_h").alias("h"), F.col("_t").alias("t")))))
        to = lambda e: merged.select(F.col("node").alias(f"_{e}"), F.col("component").alias(f"_n{e}"))  # noqa: E731, B023
        open_ = cut(open_.join(to("h"), "_h", "left").join(to("t"), "_t", "left").select("h", "r", "t", score, F.coalesce("_nh", "_h").alias("_h"), F.coalesce("_nt", "_t").alias("_t")).where("_h <> _t"))
    if picked is None:
        return candidates.select("h", "r", "t", score).where(F.lit(False))
    return picked.select("h", "r", "t", score)


def safe_deletions(triples: DataFrame, surplus: DataFrame, order: list[Column]) -> DataFrame:
    """Triples that can all be deleted at once without parting a component, dropping an entity or a relation: of each relation at most its
    ``surplus`` (relation, surplus), in the given order.

    A spanning tree is kept; of the triples between two entities that the tree joins, the first by (r, h, t) stays. Everything else hangs
    on nothing. Self-loops are deletable unless their entity has no other triple.
    """
    edges = simple_edges(triples)
    members = cut(components(edges, triples.select(F.explode(F.array("h", "t")).alias("node")).distinct()))
    tree = spanning_forest(edges).select(F.col("a").alias("_a"), F.col("b").alias("_b"), F.lit(True).alias("_tree"))
    k = triples.withColumns({"_a": F.least("h", "t"), "_b": F.greatest("h", "t")}).join(tree, ["_a", "_b"], "left")
    single = members.groupBy("component").agg(F.count(F.lit(1)).alias("_n"), F.min("node").alias("_a")).where("_n = 1").select("_a", F.lit(True).alias("_alone"))
    k = k.join(single, "_a", "left")
    k = k.withColumn("_p", F.row_number().over(Window.partitionBy("_a", "_b").orderBy("r", "h", "t")))
    stays = (F.col("_tree").isNotNull() | F.col("_alone").isNotNull()) & (F.col("_p") == 1)
    free = k.where(~stays).select("h", "r", "t")
    total = triples.groupBy("r").agg(F.count(F.lit(1)).alias("_all"))
    limit = F.least(F.floor("surplus").cast("long"), F.col("_all") - 1)
    m = free.join(surplus.select(F.col("relation").alias("r"), "surplus"), "r").join(total, "r").withColumn("_cap", limit).where("_cap > 0")
    return running_totals(m, ["r"], order, total="_k").where("_k <= _cap").select("h", "r", "t")


def loose(triples: DataFrame, over: DataFrame) -> DataFrame:
    """The triples of the relations in ``over`` (relation) that can go together without parting a component or dropping an entity, as many as
    possible: all other relations stay, so what they join is contracted, and of the rest only a spanning tree of the contracted graph is kept
    (by its first triple by (r, h, t) between two parts)."""
    names = over.select(F.col("relation").alias("r"))
    mine, rest = cut(triples.join(names, "r", "left_semi").select("h", "r", "t")), triples.join(names, "r", "left_anti")
    ends = lambda df: df.select(F.explode(F.array("h", "t")).alias("node")).distinct()
    parts = cut(components(simple_edges(rest), ends(triples)))
    side = lambda e: parts.select(F.col("node").alias(e), F.col("component").alias(f"_{e}"))
    k = cut(mine.join(side("h"), "h").join(side("t"), "t").select("h", "r", "t", F.least("_h", "_t").alias("_a"), F.greatest("_h", "_t").alias("_b")))
    edges = cut(k.where("_a <> _b").select(F.col("_a").alias("a"), F.col("_b").alias("b")).distinct())
    members = cut(components(edges, parts.select(F.col("component").alias("node")).distinct()))
    tree = spanning_forest(edges).select(F.col("a").alias("_a"), F.col("b").alias("_b"))
    # an entity that no other triple holds keeps its first self-loop
    single = members.groupBy("component").agg(F.count(F.lit(1)).alias("_n"), F.min("node").alias("_a")).where("_n = 1").select("_a")
    alone = single.join(ends(rest).withColumnRenamed("node", "_a"), "_a", "left_anti")
    first = lambda df: df.groupBy("_a", "_b").agg(F.min(F.struct("r", "h", "t")).alias("x")).select("x.*")
    stays = first(k.where("_a <> _b").join(tree, ["_a", "_b"], "left_semi")).unionByName(first(k.where("_a = _b").join(alone, "_a", "left_semi")))
    return k.select("h", "r", "t").join(stays, ["h", "r", "t"], "left_anti")


def prune(triples: DataFrame, alloc: DataFrame, per_round: int | None, max_rounds: int | None, order: list[Column]) -> DataFrame:
    """(h, r, t, turn) removed in rounds: each deletes safely, in the given order, at most ``per_round`` triples of each relation that is over
    its budget (None: its whole surplus), until nothing more can go or ``max_rounds`` (None: no limit) is reached.

    What is left over budget after an unlimited run can't be deleted singly either: it is the last triple of its relation, or parts a
    component or drops an entity. No relation loses its last triple.
    """
    eta = cut(alloc.groupBy("relation").agg(F.sum("eta").alias("eta")))
    left, gone, turn = cut(triples.select("h", "r", "t")), None, 0
    while max_rounds is None or turn < max_rounds:
        turn += 1
        n = left.groupBy(F.col("r").alias("relation")).agg(F.count(F.lit(1)).alias("n"))
        room = F.least(F.floor(F.col("n") - F.col("eta")).cast("long"), F.col("n") - 1)
        over = cut(n.join(eta, "relation").select("relation", (room if per_round is None else F.least(room, F.lit(per_round))).alias("_cap")).where("_cap > 0"))
        if over.isEmpty():
            break
        m = loose(left, over).join(over.withColumnRenamed("relation", "r"), "r")
        cutting = cut(running_totals(m, ["r"], order, total="_k").where("_k <= _cap").select("h", "r", "t", F.lit(turn).alias("turn")))
        if cutting.isEmpty():
            break
        gone = cutting if gone is None else gone.unionByName(cutting)
        left = cut(left.join(cutting.select("h", "r", "t"), ["h", "r", "t"], "left_anti"))
    return gone if gone is not None else triples.select("h", "r", "t", F.lit(0).alias("turn")).where(F.lit(False))


def greedy_matching(moves: DataFrame, left: str, right: str, order: list[Column]) -> DataFrame:
    """The moves a greedy pass in the strict ``order`` accepts when no ``left`` and no ``right`` may be used twice.

    A move that is first at both its ends is accepted whatever comes later; these are taken together, their rivals dropped, and so on. NULL
    ends take no part.
    """
    open_ = cut(moves.where(F.col(left).isNotNull() & F.col(right).isNotNull()))
    accepted: DataFrame | None = None
    while not open_.isEmpty():
        a = F.row_number().over(Window.partitionBy(left).orderBy(*order))
        b = F.row_number().over(Window.partitionBy(right).orderBy(*order))
        win = cut(open_.withColumns({"_a": a, "_b": b}).where("_a = 1 AND _b = 1").drop("_a", "_b"))
        accepted = win if accepted is None else accepted.unionByName(win)
        open_ = cut(open_.join(win.select(left), left, "left_anti").join(win.select(right), right, "left_anti"))
    return accepted if accepted is not None else moves.where(F.lit(False))


def grow_connected(start: DataFrame, universe: DataFrame, per_relation: DataFrame, max_rounds: int | None = None) -> DataFrame:
    """(h, r, t, turn): triples of ``universe`` taken round by round because they touch an entity reached before, of each relation the first
    by (h, t) up to its quota (relation, quota), until a round adds nothing or ``max_rounds`` is reached. ``start``: one column of entities."""
    reached = cut(start.select(F.col(start.columns[0]).alias("entity")).distinct())
    chosen: DataFrame | None = None
    quota = cut(per_relation.select(F.col("relation").alias("r"), F.col("quota").cast("long").alias("quota")))
    rest = cut(universe.select("h", "r", "t").distinct().join(quota.select("r"), "r", "left_semi").select("h", "r", "t"))
    turn = 0
    while max_rounds is None or turn < max_rounds:
        turn += 1
        used = quota if chosen is None else quota.join(chosen.groupBy("r").agg(F.count(F.lit(1)).alias("_n")), "r", "left").select("r", (F.col("quota") - F.coalesce("_n", F.lit(0))).alias("quota"))
        at_h = rest.join(reached.withColumnRenamed("entity", "h"), "h", "left_semi").select("h", "r", "t")
        at_t = rest.join(reached.withColumnRenamed("entity", "t"), "t", "left_semi").select("h", "r", "t")
        touch = at_h.unionByName(at_t).distinct().join(used, "r")
        new = cut(running_totals(touch.where("quota > 0"), ["r"], [F.col("h"), F.col("t")], total="_p").where("_p <= quota").select("h", "r", "t", F.lit(turn).alias("turn")))
        if new.isEmpty():
            break
        chosen = new if chosen is None else cut(chosen.unionByName(new))
        rest = cut(rest.join(new.select("h", "r", "t"), ["h", "r", "t"], "left_anti"))
        reached = cut(reached.unionByName(new.select(F.explode(F.array("h", "t")).alias("entity"))).distinct())
    return chosen if chosen is not None else universe.select("h", "r", "t", F.lit(0).alias("turn")).where(F.lit(False))
