"""Scored removal: what deleting a triple gains for the balance and costs the structure, pruning by that score, deletions under quotas."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kgloom.operators.allocate import by_membership, compare_patterns, compare_relations
from kgloom.operators.construct import loose
from kgloom.operators.graph import _small, articulation_points, bridges, components, simple_edges
from kgloom.operators.lowlink import removal_rows
from kgloom.operators.skew import running_totals
from kgloom.operators.triples import common_neighbours, entities, pair_counts, relation_counts, simple_degrees
from kgloom.operators.unionfind import LEAN
from kgloom.session import cut


# Weights of the removal score.
@dataclass(frozen=True)
class RemovalWeights:
    pattern_surplus: float = 10.0
    pattern_deficit: float = 25.0
    protected_pattern: float = 40.0
    relation_excess: float = 2.0
    bridge: float = 1_000_000.0
    low_degree: float = 50.0
    articulation: float = 20.0
    common_neighbour: float = 5.0
    cycle: float = 2.0
    low_degree_threshold: int = 2
    common_neighbour_cap: int = 10
    protected: tuple[str, ...] = ("symmetric",)


def excess_reward(excess: Column, mode: str = "linear", weight: float = 2.0, at_least: int = 1, cap: float = 50.0) -> Column:
    """What a relation's triples over budget are worth: linear, sqrt, log1p or capped_linear; nothing below ``at_least``."""
    scaled = {"linear": excess, "sqrt": F.sqrt(excess), "log1p": F.log1p(excess), "capped_linear": F.least(excess, F.lit(cap))}
    if mode not in scaled:
        raise ValueError(f"unknown mode: {mode}")
    return F.when(excess >= at_least, weight * scaled[mode]).otherwise(F.lit(0.0))


def projected(triples: DataFrame) -> DataFrame:
    """``triples`` with the graph as it would be without each of them: triples per entity, low-degree nodes made, two-paths lost."""
    n, e = triples.count(), entities(triples).count()
    d = lambda c: simple_degrees(triples).select(F.col("entity").alias(c), F.col("degree").alias(f"_d{c}"))
    ends = {"a": F.least("h", "t"), "b": F.greatest("h", "t")}
    m = triples.withColumns(ends).join(pair_counts(triples).withColumnRenamed("n", "_n"), ["a", "b"]).join(d("h"), "h").join(d("t"), "t")
    lost, zero = F.col("_n") <= 1, F.lit(0)
    one = lambda c: F.col(c).cast("int")
    gone = F.when(lost, (F.col("_dh") <= 1).cast("int") + ((F.col("_dt") <= 1) & (F.col("h") != F.col("t"))).cast("int")).otherwise(zero)
    made = F.when(lost, (F.col("_dh") == 3).cast("int") + ((F.col("_dt") == 3) & (F.col("h") != F.col("t"))).cast("int")).otherwise(zero)
    paths = F.when(lost, F.greatest(one("_dh") - 1, zero) + F.greatest(one("_dt") - 1, zero)).otherwise(zero)
    left = F.lit(e) - gone
    return m.select("h", "r", "t", F.when(left > 0, F.lit(n - 1) / left).otherwise(F.lit(0.0)).alias("triples_per_entity"), made.alias("low_degree_made"), paths.alias("two_paths_lost"))


def removal_scores(triples: DataFrame, alloc: DataFrame, w: RemovalWeights = RemovalWeights(), bound: int = LEAN) -> DataFrame:
    """(h, r, t, balance_gain, structural_penalty, score) of the triples whose removal is worth something (score above 0).

    Only triples that lower a surplus of a pattern or of their relation come into question, none of a protected pattern that is short. The
    gain counts surplus patterns and the relation's excess, less patterns that are short or protected. The penalty counts bridges, ends of
    low degree and articulation points, less common neighbours and a short way round (another edge of the pair, or one common neighbour;
    longer ways aren't looked for). ``triples`` must be a set; bring a written table.
    """
    r = _worth(triples, alloc, w)
    m = triples.select("h", "r", "t").join(F.broadcast(r) if r.count() <= 100_000 else r, "r").withColumns({"a": F.least("h", "t"), "b": F.greatest("h", "t")})
    edges = cut(simple_edges(triples))
    d, cutting = cut(simple_degrees(triples)), cut(articulation_points(edges, bound).select("node"))
    m = m.join(pair_counts(triples), ["a", "b"]).join(bridges(edges, bound).select("a", "b", F.lit(True).alias("_bridge")), ["a", "b"], "left")
    m = m.join(common_neighbours(triples, m.where("a <> b").select("a", "b")), ["a", "b"], "left")
    for c in ("h", "t"):
        m = m.join(d.select(F.col("entity").alias(c), F.col("degree").alias(f"_d{c}")), c).join(cutting.select(F.col("node").alias(c), F.lit(True).alias(f"_a{c}")), c, "left")
    common, flag = F.coalesce("common", F.lit(0)), lambda c: F.col(c).isNotNull()
    return _scored(m, common, flag("_bridge") & (F.col("n") <= 1), flag("_ah"), flag("_at"), w)


def _scored(m: DataFrame, common: Column, bridge: Column, cuts_h: Column, cuts_t: Column, w: RemovalWeights) -> DataFrame:
    """(h, r, t, balance_gain, structural_penalty, score) of rows with pair count n and degrees _dh and _dt, if the score is above 0."""
    way = F.when(F.col("n") > 1, 1).when(common > 0, 2)
    penalty = (
        w.bridge * bridge.cast("int")
        + w.low_degree * ((F.col("_dh") <= w.low_degree_threshold).cast("int") + (F.col("_dt") <= w.low_degree_threshold).cast("int"))
        + w.articulation * (cuts_h.cast("int") + cuts_t.cast("int"))
        - w.common_neighbour * F.least(common, F.lit(w.common_neighbour_cap))
        - w.cycle * F.coalesce(5 - way, F.lit(0))
    )
    out = m.select("h", "r", "t", "balance_gain", penalty.cast("double").alias("structural_penalty"))
    return out.withColumn("score", F.round(F.col("balance_gain") - F.col("structural_penalty"), 6)).where("score > 0")


def _worth(triples: DataFrame, alloc: DataFrame, w: RemovalWeights) -> DataFrame:
    """(r, balance_gain) of the relations whose triples come into question."""
    counts = relation_counts(triples)
    rel = compare_relations(counts, alloc).select(F.col("relation").alias("r"), F.floor("surplus").alias("_over"))
    pat = compare_patterns(by_membership(counts, alloc), alloc).select("pattern", (F.col("surplus") > 0).alias("_s"), (F.col("deficit") > 0).alias("_d"))
    own = alloc.select("pattern", F.col("relation").alias("r")).distinct().join(pat, "pattern").withColumn("_p", F.col("pattern").isin(*w.protected))
    worth = F.sum(w.pattern_surplus * F.col("_s").cast("int") - w.pattern_deficit * F.col("_d").cast("int") - w.protected_pattern * F.col("_p").cast("int"))
    own = own.groupBy("r").agg(worth.alias("_gain"), F.bool_or("_s").alias("_helps"), F.bool_or(F.col("_p") & F.col("_d")).alias("_short"))
    r = own.join(rel, "r").where("(_helps OR _over >= 1) AND NOT _short")
    return cut(r.select("r", (F.col("_gain") + F.when(F.col("_over") >= 1, w.relation_excess * F.col("_over")).otherwise(F.lit(0.0))).alias("balance_gain")).where("balance_gain > 0"))


def loose_scores(triples: DataFrame, over: DataFrame, alloc: DataFrame, w: RemovalWeights = RemovalWeights(), bound: int = LEAN) -> DataFrame:
    """The rows of :func:`removal_scores` that :func:`loose` lets go for the relations in ``over`` (relation). ``triples`` must be a set.

    Up to ``bound`` pairs one task searches the graph for all of it. No loose triple is a bridge alone, so bridges needn't be found then.
    """
    names = over.select(F.col("relation").alias("r"), F.lit(True).alias("_mine"))
    k = triples.select("h", "r", "t", F.least("h", "t").alias("a"), F.greatest("h", "t").alias("b")).join(F.broadcast(names) if over.count() <= 100_000 else names, "r", "left")
    k = k.withColumn("_mine", F.col("_mine").isNotNull())
    pairs = cut(k.groupBy("a", "b").agg(F.count(F.lit(1)).alias("n"), F.bool_or("_mine").alias("mine"), F.bool_or(~F.col("_mine")).alias("rest")))
    if (one := _small(pairs, bound, "n", "mine", "rest")) is None:
        return loose(triples, over).join(removal_scores(triples, alloc, w, bound), ["h", "r", "t"])
    kind = pairs.schema["a"].dataType.simpleString()
    seen = cut(one.mapInArrow(removal_rows, f"a {kind}, b {kind}, n long, _a {kind}, _b {kind}, _stays boolean, common long, _dh long, _dt long, _ah boolean, _at boolean"))
    m = cut(k.where("_mine").drop("_mine").join(seen, ["a", "b"]).drop("a", "b"))
    stays = m.where("_stays").groupBy("_a", "_b").agg(F.min(F.struct("r", "h", "t")).alias("x")).select("x.*")
    r = _worth(triples, alloc, w)
    m = m.join(F.broadcast(r) if r.count() <= 100_000 else r, "r").join(stays, ["h", "r", "t"], "left_anti")
    return _scored(m, F.col("common"), F.lit(False), F.col("_ah"), F.col("_at"), w)


@dataclass(frozen=True)
class Guards:
    """What a round of pruning must leave; None doesn't bind."""

    more_triples_than_entities: bool = False
    min_triples_per_entity: float | None = None
    max_components: int | None = None
    min_largest_share: float | None = None


def snapshot(triples: DataFrame) -> DataFrame:
    """One row: triples, entities, triples_per_entity, components, largest_share."""
    k = triples.select("h", "r", "t")
    m = components(simple_edges(k), entities(k)).groupBy("component").agg(F.count(F.lit(1)).alias("n"))
    c = m.agg(F.count(F.lit(1)).alias("components"), F.coalesce(F.sum("n"), F.lit(0)).alias("entities"), F.coalesce(F.max("n"), F.lit(0)).alias("_top"))
    one = k.agg(F.count(F.lit(1)).alias("triples")).join(c, F.lit(True))  # one row each
    per = lambda x, y: F.when(F.col(y) > 0, F.col(x) / F.col(y)).otherwise(F.lit(0.0))
    return one.select("triples", "entities", per("triples", "entities").alias("triples_per_entity"), "components", per("_top", "entities").alias("largest_share"))


def broken_guards(triples: DataFrame, guards: Guards) -> list[str]:
    """Names of the guards that a graph breaks."""
    if guards == Guards():
        return []
    s = snapshot(triples).collect()[0]
    found = {
        "more_triples_than_entities": guards.more_triples_than_entities and s.triples <= s.entities,
        "min_triples_per_entity": guards.min_triples_per_entity is not None and s.triples_per_entity < guards.min_triples_per_entity,
        "max_components": guards.max_components is not None and s.components > guards.max_components,
        "min_largest_share": guards.min_largest_share is not None and s.largest_share < guards.min_largest_share,
    }
    return [k for k, v in found.items() if v]


def prune_scored(triples: DataFrame, alloc: DataFrame, batch: int | None = None, per_relation: int | None = None, guards: Guards = Guards(), w: RemovalWeights = RemovalWeights(), bound: int = LEAN) -> DataFrame:
    """(h, r, t, turn, score) removed in rounds by descending score, renewed each round, until nothing scores or a round would break a guard (that
    round isn't applied).

    A round takes at most ``batch`` triples (None: all), of each relation at most its surplus, never its last triple and at most
    ``per_relation``; ties by (r, h, t). All of a round can go together: a spanning forest of the graph stays.
    """
    left, gone, turn = cut(triples.select("h", "r", "t")), None, 0
    while True:
        turn += 1
        over = compare_relations(relation_counts(left), alloc)
        room = F.least(F.floor("surplus").cast("long"), F.col("observed") - 1, *([] if per_relation is None else [F.lit(per_relation)]))
        over = cut(over.select("relation", room.alias("_cap")).where("_cap > 0"))
        if over.isEmpty():
            break
        m = loose_scores(left, over, alloc, w, bound).join(over.withColumnRenamed("relation", "r"), "r")
        best = running_totals(m, ["r"], [F.col("score").desc(), F.col("h"), F.col("t")], total="_k").where("_k <= _cap").select("h", "r", "t", "score")
        if batch is not None:
            best = best.orderBy(F.col("score").desc(), "r", "h", "t").limit(batch)
        taken = cut(best.select("h", "r", "t", F.lit(turn).alias("turn"), "score"))
        if taken.isEmpty():
            break
        after = cut(left.join(taken.select("h", "r", "t"), ["h", "r", "t"], "left_anti"))
        if broken_guards(after, guards):
            break
        gone = taken if gone is None else gone.unionByName(taken)
        left = after
    return gone if gone is not None else triples.select("h", "r", "t", F.lit(0).alias("turn"), F.lit(0.0).alias("score")).where(F.lit(False))


def within_quotas(rows: DataFrame, a: str, a_cap: str, b: str, b_cap: str, order: list[Column]) -> DataFrame:
    """The rows that a pass in the strict ``order`` accepts while their ``a`` and their ``b`` have less than ``a_cap`` and ``b_cap`` accepted (each
    cap is the same in all rows of its key).

    A row that is among the first that both its keys can still take is accepted whatever comes before it; these are taken together, the keys
    that are full drop their rest, and so on. Keys of any size are ranked in range pieces.
    """
    done: DataFrame | None = None
    open_ = cut(rows.withColumns({"_ra": F.col(a_cap).cast("long"), "_rb": F.col(b_cap).cast("long")}).where("_ra > 0 AND _rb > 0"))
    while not open_.isEmpty():
        ranked = running_totals(running_totals(open_, [a], order, total="_pa"), [b], order, total="_pb")
        m = cut(ranked.withColumn("_win", (F.col("_pa") <= F.col("_ra")) & (F.col("_pb") <= F.col("_rb"))))
        win = m.where("_win")
        done = win.select(*rows.columns) if done is None else done.unionByName(win.select(*rows.columns))
        used = lambda c: win.groupBy(F.col(c).alias("_key")).agg(F.count(F.lit(1)).alias("_used"))  # noqa: E731, B023
        rest = m.where("NOT _win")
        for c, cap in ((a, "_ra"), (b, "_rb")):
            rest = rest.join(used(c), F.col(c) == F.col("_key"), "left").withColumn(cap, F.col(cap) - F.coalesce("_used", F.lit(0))).drop("_key", "_used")
        open_ = cut(rest.where("_ra > 0 AND _rb > 0").select(*rows.columns, "_ra", "_rb"))
    return done if done is not None else rows.where(F.lit(False))


def verified_deletions(triples: DataFrame, support: DataFrame, alloc: DataFrame) -> DataFrame:
    """(h, r, t): the triples that a greedy pass deletes, largest surplus of the relation first, ties by (r, h, t).

    Deleted are only triples of overfilled relations that leave another triple between their ends, that no kept synthetic triple rests on
    (``support``: h, r, t), that aren't the last of their relation and don't take it below its budget. So no entity, component or relation
    is lost and no deficit grows, whatever else is deleted.
    """
    over = compare_relations(relation_counts(triples), alloc).select(F.col("relation").alias("r"), F.round("surplus", 6).alias("_surplus"), F.least(F.floor(F.col("surplus") + 1e-9).cast("long"), F.col("observed") - 1).alias("_cap_r")).where("_cap_r > 0")
    m = triples.select("h", "r", "t").withColumns({"a": F.least("h", "t"), "b": F.greatest("h", "t")}).join(pair_counts(triples), ["a", "b"]).where("n > 1")
    m = m.join(over, "r").join(support.select("h", "r", "t"), ["h", "r", "t"], "left_anti")
    m = m.select("h", "r", "t", "_surplus", "_cap_r", F.concat_ws("|", "a", "b").alias("_pair"), (F.col("n") - 1).alias("_cap_p"))
    return within_quotas(m, "r", "_cap_r", "_pair", "_cap_p", [F.col("_surplus").desc(), F.col("r"), F.col("h"), F.col("t")]).select("h", "r", "t")
