"""Rule completion: triples that a symmetric or inverse rule implies and the graph lacks, with the reason why each is taken or not."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from kgloom.operators.skew import SMALL, running_totals, skew_join
from kgloom.session import cut


def symmetric_completion(base: DataFrame, meta: DataFrame, observed: DataFrame) -> DataFrame:
    """Reverses of the triples of the relations in ``meta`` (relation, deficit) that neither ``base`` nor ``observed`` holds, each once."""
    m = meta.select(F.col("relation").alias("r"), "deficit")
    rev = base.join(m, "r").select(F.col("t").alias("h"), "r", F.col("h").alias("t"), "deficit").distinct()
    return rev.join(base, ["h", "r", "t"], "left_anti").join(observed, ["h", "r", "t"], "left_anti")


def capped(edges: DataFrame, cap: Column, order: list[Column]) -> DataFrame:
    """At most floor(cap) edges per relation in the given order, which must be strict; a NULL or negative cap takes none. A relation may hold
    any share of the edges: it is ranked in range pieces."""
    placed = running_totals(edges.where(F.floor(cap) > 0), ["r"], order, total="_place")
    return placed.where(F.col("_place") <= F.floor(cap)).drop("_place")


def inverse_candidates(base: DataFrame, rules: DataFrame, observed: DataFrame, confidence: float) -> DataFrame:
    """(source, h, r, t, confidence, deficit, reason): every triple (t, target, h) that a rule implies, with the first rule it fails.

    ``rules``: source, target, confidence, eta, deficit, surplus. Reasons in order: already_present, already_observed, low_confidence,
    not_allocated, overfilled, no_room, duplicate (another rule implies it first: higher confidence, then smaller source), eligible.
    Triples are gathered by pair before the rules multiply them, so what is implied is never moved. ``rules`` must be a written table.
    """
    small = rules.count() <= SMALL
    few = F.broadcast if small else lambda df: df
    none = F.lit(None).cast("string")
    names = rules.select(F.col("source").alias("r"), F.lit(True).alias("_from"), F.lit(None).cast("boolean").alias("_to")).unionByName(rules.select(F.col("target").alias("r"), F.lit(None).cast("boolean").alias("_from"), F.lit(True).alias("_to")))
    names = few(cut(names.groupBy("r").agg(F.bool_or("_from").alias("_from"), F.bool_or("_to").alias("_to"))))
    # what a rule implies lies on the pair of its triple turned round: one row for each pair has the relations that imply, and those that are there
    row = lambda h, t, source, there, seen: F.struct(F.col(h).alias("h"), F.col(t).alias("t"), source.alias("source"), there.alias("there"), seen.alias("seen"))
    mine = base.select("h", "r", "t").join(names, "r").select(F.explode(F.array(F.when(F.col("_from"), row("t", "h", F.col("r"), none, none)), F.when(F.col("_to"), row("h", "t", none, F.col("r"), none)))).alias("x"))
    other = observed.select("h", "r", "t").join(names, "r").where("_to").select(row("h", "t", none, none, F.col("r")).alias("x"))
    lists = [F.collect_list(c).alias(c) for c in ("source", "there", "seen")]
    pairs = cut(mine.unionByName(other).where("x IS NOT NULL").select("x.*").groupBy("h", "t").agg(*lists).where(F.size("source") > 0))
    own = (
        F.when(F.col("confidence").isNull() | (F.col("confidence") < confidence), "low_confidence")
        .when(F.coalesce("eta", F.lit(0.0)) <= 0, "not_allocated")
        .when(F.coalesce("surplus", F.lit(0.0)) > 0, "overfilled")
        .when(F.coalesce("deficit", F.lit(0.0)) <= 0, "no_room")
        .otherwise("eligible")
    )
    told = rules.select(F.col("source").alias("_source"), F.col("target").alias("r"), "confidence", "deficit", own.alias("_own"))

    def implied(p: DataFrame) -> DataFrame:
        p = p.select("h", "t", "there", "seen", F.explode("source").alias("source"))
        m = p.join(F.broadcast(told), F.col("source") == F.col("_source")) if small else skew_join(p, told, [("source", "_source")])
        held = lambda c: (F.size(c) > 0) & F.array_contains(c, F.col("r"))
        return m.select("source", "h", "r", "t", "confidence", "deficit", F.when(held("there"), "already_present").when(held("seen"), "already_observed").otherwise(F.col("_own")).alias("reason"))

    # only pairs with several relations can have a triple implied twice; they are brought together before they are multiplied by the rules
    first = Window.partitionBy("h", "t", "r", "reason").orderBy(F.col("confidence").desc_nulls_last(), "source")
    several = implied(pairs.where(F.size("source") > 1).repartition("h", "t")).withColumn("_k", F.row_number().over(first))
    reason = F.when((F.col("reason") == "eligible") & (F.col("_k") > 1), "duplicate").otherwise(F.col("reason"))
    return implied(pairs.where(F.size("source") == 1)).unionByName(several.withColumn("reason", reason).drop("_k"))


def confidence_tier(c: Column) -> Column:
    return F.when(c >= 0.9, "0.90+").when(c >= 0.8, "0.80-0.89").when(c >= 0.7, "0.70-0.79").otherwise("below_0.70")
