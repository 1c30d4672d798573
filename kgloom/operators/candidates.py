"""Candidate triples: genericity of their relations, annotation and freezing, audits, seeds, census and scores."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from kgloom.operators.triples import incidence


# Thresholds and weights of the genericity score.
@dataclass(frozen=True)
class GenericitySettings:
    support: float = 1e-12
    coverage: float = 0.8
    mass_quantile: float = 0.9
    manual: tuple[str, ...] = ()
    weights: tuple[float, float, float, float] = (0.35, 0.25, 0.20, 0.20)


def genericity(alloc: DataFrame, matrix: DataFrame, settings: GenericitySettings = GenericitySettings()) -> DataFrame:
    """Per allocated relation: share of relations it is supported with, its support mass and budget (both over the largest), score, bucket.

    ``alloc``: relation, eta; ``matrix``: row, col, value. The mass threshold is the value at place floor(q·(n−1)) of the sorted masses.
    """
    rel = alloc.groupBy("relation").agg(F.sum("eta").alias("eta"))
    names = rel.select("relation")
    inside = matrix.join(names.withColumnRenamed("relation", "row"), "row", "left_semi").join(names.withColumnRenamed("relation", "col"), "col", "left_semi")
    ends = inside.select(F.explode(F.array(F.struct(F.col("row").alias("relation"), F.col("col").alias("other"), "value"), F.struct(F.col("col").alias("relation"), F.col("row").alias("other"), "value"))).alias("x")).select("x.*")
    per = ends.groupBy("relation").agg(F.count_distinct(F.when(F.col("value") > settings.support, F.col("other"))).alias("_n"), F.sum("value").alias("_m"))
    s = rel.join(per, "relation", "left").select("relation", "eta", F.coalesce("_n", F.lit(0)).alias("_n"), F.coalesce("_m", F.lit(0.0)).alias("mass"))
    # one row of totals: a value per relation is all that is sorted
    tot = s.agg(F.count(F.lit(1)).alias("_all"), F.max("mass").alias("_top"), F.max("eta").alias("_eta"), F.sort_array(F.collect_list("mass")).alias("_masses")).withColumn("_k", F.lit(1))
    place = F.floor(settings.mass_quantile * (F.size("_masses") - 1)).cast("int")
    s = s.withColumn("_k", F.lit(1)).join(tot.withColumn("_threshold", F.get("_masses", place)).drop("_masses"), "_k")
    cov = F.col("_n") / F.greatest(F.col("_all"), F.lit(1))
    mass = F.when(F.col("_top") > 0, F.col("mass") / F.col("_top")).otherwise(F.lit(0.0))
    volume = F.when(F.col("_eta") > 0, F.col("eta") / F.col("_eta")).otherwise(F.lit(0.0))
    manual = F.col("relation").isin(*settings.manual).cast("double") if settings.manual else F.lit(0.0)
    a, b, c, e = settings.weights
    s = s.withColumns({"coverage_score": cov, "mass_score": mass, "volume_score": volume, "manual_risk": manual})
    s = s.withColumn("genericity_score", a * F.col("coverage_score") + b * F.col("mass_score") + c * F.col("volume_score") + e * F.col("manual_risk"))
    wide = (F.col("manual_risk") >= 1) | (F.col("coverage_score") >= settings.coverage) | (F.col("mass") >= F.col("_threshold"))
    score = F.round("genericity_score", 12)
    bucket = F.when(wide, F.when((score >= 0.60) | (F.col("manual_risk") >= 1), "high").otherwise("medium")).when(score >= 0.33, "medium").otherwise("low")
    return s.select("relation", "coverage_score", "mass_score", "volume_score", "manual_risk", "genericity_score", bucket.alias("genericity_bucket"))


# How many candidates a relation may keep by its budget.
@dataclass(frozen=True)
class CollectionSettings:
    alpha: int = 5
    beta: int = 20
    floor: int = 40
    cap: int = 5000
    small: int = 200


# The risk of each bucket, and the weights of the quality score below.
def shortcut_risk(bucket: Column) -> Column:
    return F.when(bucket == "low", 0.1).when(bucket == "medium", 0.4).when(bucket == "high", 0.8)


def annotate(bag: DataFrame, alloc: DataFrame, generic: DataFrame, settings: CollectionSettings = CollectionSettings()) -> DataFrame:
    """The frozen candidates of every allocated relation with hub penalty, shortcut risk and quality.

    Of each relation the distinct triples that are no self-loop are accepted; the first of them in the order (h, t) are kept, as many as
    the relation's target allows: min(cap, max(floor, α·eta + β)), at least ``small`` unless the relation is highly generic. Entity
    frequencies count all accepted triples of the relation, not only the kept ones.
    """
    eta = alloc.groupBy(F.col("relation").alias("r")).agg(F.sum("eta").cast("long").alias("eta"))
    g = generic.select(F.col("relation").alias("r"), "genericity_score", "genericity_bucket")
    target = F.least(F.lit(settings.cap), F.greatest(F.lit(settings.floor), settings.alpha * F.col("eta") + settings.beta))
    rel = eta.join(g, "r").withColumn("target", target)
    ok = bag.where("h <> t").select("h", "r", "t").distinct().join(rel.select("r"), "r", "left_semi")
    freq = ok.select("r", F.explode(F.array("h", "t")).alias("e")).groupBy("r", "e").agg(F.count(F.lit(1)).alias("f"))
    peak = freq.groupBy("r").agg(F.max("f").alias("peak"))
    accepted = ok.groupBy("r").agg(F.count(F.lit(1)).alias("accepted"))
    high = F.col("genericity_bucket") == "high"
    small = ~high & (F.col("accepted") <= settings.small)
    keep = F.when(high, F.least(F.col("target"), F.lit(settings.small))).when(small, F.col("accepted")).otherwise(F.least("target", "accepted"))
    mode = F.when(high, "graph_anchored").when(small, "small_full").otherwise("normal")
    per = rel.join(accepted, "r").join(peak, "r").select("r", "genericity_score", "genericity_bucket", "peak", keep.alias("_keep"), mode.alias("collection_mode"))
    place = F.row_number().over(Window.partitionBy("r").orderBy("h", "t"))
    # the cap bounds what is kept of a relation, so ranks beyond it are cut map-side (window group limit) before the budget is looked at
    kept = ok.withColumn("_place", place).where(F.col("_place") <= settings.cap).join(per, "r").where(F.col("_place") <= F.col("_keep"))
    fh, ft = freq.select("r", F.col("e").alias("h"), F.col("f").alias("_fh")), freq.select("r", F.col("e").alias("t"), F.col("f").alias("_ft"))
    hub = F.when(F.col("peak") <= 1, F.lit(0.0)).otherwise(F.least(F.lit(1.0), F.greatest("_fh", "_ft") / F.col("peak")))
    out = kept.join(fh, ["r", "h"]).join(ft, ["r", "t"]).withColumns({"hub_penalty": hub, "shortcut_risk": shortcut_risk(F.col("genericity_bucket"))})
    quality = F.greatest(F.lit(0.0), F.round(1.0 - 0.30 * F.col("hub_penalty") - 0.25 * F.col("shortcut_risk") - 0.20 * F.col("genericity_score"), 6))
    return out.select("h", "r", "t", "genericity_score", "genericity_bucket", "collection_mode", "hub_penalty", "shortcut_risk", quality.alias("quality_score"))


def audit(rows: DataFrame, eta: DataFrame) -> DataFrame:
    """Per relation: rows, distinct heads, tails and entities, the most frequent entity's count and share, averages, under-collection.

    ``rows``: h, r, t, quality_score, genericity_score, hub_penalty (NULL or NaN counts as 0); ``eta``: relation, eta.
    """
    z = lambda c: F.coalesce(F.when(~F.isnan(c), F.col(c)), F.lit(0.0))
    base = rows.groupBy("r").agg(F.count(F.lit(1)).alias("n"), *[F.round(F.avg(z(c)), 6).alias(f"avg_{c}") for c in ("quality_score", "genericity_score", "hub_penalty")])
    # distinct counts from compressed pairs: a relation with a third of all rows is spread over its entities
    use = rows.select("r", F.explode(F.array(F.struct(F.col("h").alias("e"), F.lit(1).alias("is_h")), F.struct(F.col("t").alias("e"), F.lit(0).alias("is_h")))).alias("x")).groupBy("r", F.col("x.e").alias("e")).agg(F.sum("x.is_h").alias("_h"), F.sum(1 - F.col("x.is_h")).alias("_t"))
    ent = use.groupBy(F.col("r").alias("_r")).agg(F.count_if(F.col("_h") > 0).alias("heads"), F.count_if(F.col("_t") > 0).alias("tails"), F.count(F.lit(1)).alias("entities"), F.max(F.col("_h") + F.col("_t")).alias("top_frequency"))
    out = base.join(ent, F.col("r") == F.col("_r")).drop("_r").join(eta.select(F.col("relation").alias("_e"), "eta"), F.col("r") == F.col("_e"), "left").drop("_e")
    return out.withColumns({"concentration": F.round(F.col("top_frequency") / (2 * F.col("n")), 6), "undercollected": F.coalesce(F.col("n") < F.col("eta"), F.lit(False))}).drop("eta")


def bridge_bonus(n: Column) -> Column:
    """min(1, relations at both ends / 20)."""
    return F.least(F.lit(1.0), n / 20.0)


def seeds(candidates: DataFrame, alloc: DataFrame, hard: int, per_relation: int, bridging: int, pool: int = 50) -> DataFrame:
    """Seed triples: the first ``per_relation`` of the relations of smallest budget until ``hard`` are found, and the ``bridging`` of highest
    bridge bonus among the first ``pool`` of every relation; ties by (r, h, t)."""
    eta = alloc.groupBy(F.col("relation").alias("r")).agg(F.sum("eta").alias("eta"))
    first = candidates.withColumn("_p", F.row_number().over(Window.partitionBy("r").orderBy("h", "t"))).where(F.col("_p") <= max(pool, per_relation))
    low = first.where(F.col("_p") <= per_relation).join(eta, "r").orderBy("eta", "r", "h", "t").limit(hard).select("h", "r", "t", F.lit("hard").alias("kind"))
    inc = incidence(candidates)
    both = first.where(F.col("_p") <= pool).join(inc.select(F.col("entity").alias("h"), F.col("n_relations").alias("_a")), "h").join(inc.select(F.col("entity").alias("t"), F.col("n_relations").alias("_b")), "t")
    top = both.withColumn("_s", bridge_bonus(F.col("_a") + F.col("_b"))).orderBy(F.col("_s").desc(), "r", "h", "t").limit(bridging).select("h", "r", "t", F.lit("bridge").alias("kind"))
    return low.unionByName(top).groupBy("h", "r", "t").agg(F.max("kind").alias("kind"))


# Weights of the census score.
SCORE_WEIGHTS = {"relation": 5.0, "pattern": 2.5, "symmetric": 4.0, "reuse": 1.0, "density": 1.0, "redundancy": 1.0, "composition": 6.0, "generic": 1.5, "new_entity": 2.0}


def census_score(weights: dict[str, float] | None = None) -> Column:
    """Linear score of a census row (relation_deficit, relation_eta, pattern_under, is_symmetric, new_entities, common, is_composition,
    composition_over, is_generic)."""
    w = SCORE_WEIGHTS | (weights or {})
    c = F.col
    gain = F.least(c("relation_deficit") / F.greatest(c("relation_eta"), F.lit(1.0)), F.lit(1.0))
    one = lambda x: x.cast("double")
    reuse = F.when(c("new_entities") == 0, 1.0).when(c("new_entities") == 1, 0.5).otherwise(0.0)
    return (
        w["relation"] * gain
        + w["pattern"] * one(c("pattern_under"))
        + w["symmetric"] * one(c("is_symmetric") & c("pattern_under"))
        + w["reuse"] * reuse
        + w["density"] * F.least(c("common") / 10.0, F.lit(1.0))
        + w["redundancy"] * one(c("common") > 0)
        - w["composition"] * one(c("is_composition") & c("composition_over"))
        - w["generic"] * one(c("is_generic"))
        - w["new_entity"] * c("new_entities")
    )


def fetch_limit(target: Column, bucket: Column, factor: int = 3, least: int = 100, most: int = 20_000) -> Column:
    """How many raw rows to fetch for a relation that is to keep ``target``: ``factor`` times as many, twice that for highly generic ones, within
    bounds."""
    many = target * F.when(bucket == "high", 2 * factor).otherwise(factor)
    return F.least(F.lit(most), F.greatest(F.lit(least), many)).cast("long")
