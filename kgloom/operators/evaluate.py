"""Evaluating a graph against its allocation: one report of named figures, and checks against bounds."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kgloom.operators import allocate as A
from kgloom.operators import triples as T
from kgloom.operators.graph import components, connectivity, simple_edges


def _long(df: DataFrame, section: str) -> DataFrame:
    """The columns of a one-row table as rows (section, metric, value)."""
    cells = F.explode(F.array(*[F.struct(F.lit(c).alias("metric"), F.round(F.col(c).cast("double"), 6).alias("value")) for c in df.columns]))
    return df.select(F.lit(section).alias("section"), cells.alias("x")).select("section", "x.metric", "x.value")


def report(raw: DataFrame, triples: DataFrame, alloc: DataFrame) -> DataFrame:
    """(section, metric, value): figures of the graph, its connectivity, its balance by relation in sum and by pattern one by one.

    ``raw``: the triples as a bag, ``triples``: the same as a set (written). An empty graph has zeros."""
    counts = T.relation_counts(triples)
    g = T.summary(raw).withColumn("triples_per_entity", F.when(F.col("entities") > 0, F.col("triples") / F.col("entities")).otherwise(F.lit(0.0)))
    c = connectivity(components(simple_edges(triples), T.entities(triples))).na.fill(0.0, ["largest_share"])
    p = A.compare_patterns(A.by_rounded_share(counts, alloc), alloc)
    names = ("expected", "observed", "deficit", "surplus")
    per = p.select(F.concat(F.lit("pattern:"), "pattern").alias("section"), F.explode(F.array(*[F.struct(F.lit(n).alias("metric"), F.round(n, 6).alias("value")) for n in names])).alias("x")).select("section", "x.metric", "x.value")
    out = _long(g, "graph").unionByName(_long(c, "connectivity")).unionByName(_long(T.two_path_proxy(triples), "structure"))
    return out.unionByName(_long(A.balance_totals(A.compare_relations(counts, alloc)), "allocation")).unionByName(per)


def checks(figures: DataFrame, bounds: dict[tuple[str, str], tuple[str, float]]) -> DataFrame:
    """(section, metric, rule, bound, actual, passed) for ``bounds``: (section, metric) -> (one of ``=``, ``<=``, ``>=``, bound). A metric that the
    report lacks fails."""
    spark = figures.sparkSession
    want = spark.createDataFrame([(s, m, rule, float(b)) for (s, m), (rule, b) in bounds.items()], "section string, metric string, rule string, bound double")
    m = want.join(figures.withColumnRenamed("value", "actual"), ["section", "metric"], "left")
    passed = F.when(F.col("rule") == "=", F.abs(F.col("actual") - F.col("bound")) < 1e-9).when(F.col("rule") == "<=", F.col("actual") <= F.col("bound")).when(F.col("rule") == ">=", F.col("actual") >= F.col("bound"))
    return m.select("section", "metric", "rule", "bound", "actual", F.coalesce(passed, F.lit(False)).alias("passed"))
