"""Weight matrices in long form (row, col, value); zero cells are absent."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

MODES = ("adjacency_support", "adjacency_log1p", "two_hop_log1p", "log1p_row_norm", "log1p_col_norm", "log1p_balanced_norm")


def adjacency(pairs: DataFrame, support: int) -> DataFrame:
    """Totals of at least ``support``."""
    s = pairs.groupBy(F.col("r1").alias("row"), F.col("r2").alias("col")).agg(F.sum("total").cast("double").alias("value"))
    return s.where((F.col("value") >= support) & (F.col("value") != 0))


def universe(matrix: DataFrame) -> DataFrame:
    return matrix.select(F.explode(F.array("row", "col")).alias("relation")).distinct()


def _sums(m: DataFrame, by: str) -> DataFrame:
    return m.groupBy(by).agg(F.sum("value").alias(f"_{by}_sum"))


def weights(adj: DataFrame, mode: str) -> DataFrame:
    """One of ``MODES``; row and column sums are separate aggregates joined back, so they combine map-side."""
    logs = adj.withColumn("value", F.log1p("value"))
    if mode == "adjacency_support":
        return adj
    if mode == "adjacency_log1p":
        return logs
    if mode == "two_hop_log1p":
        a, b = adj.select("row", F.col("col").alias("_m"), F.col("value").alias("_a")), adj.select(F.col("row").alias("_m"), "col", F.col("value").alias("_b"))
        return a.join(b, "_m").groupBy("row", "col").agg(F.log1p(F.sum(F.col("_a") * F.col("_b"))).alias("value"))
    by_row = F.when(F.col("_row_sum") > 0, F.col("value") / F.col("_row_sum")).otherwise(F.lit(0.0))
    by_col = F.when(F.col("_col_sum") > 0, F.col("value") / F.col("_col_sum")).otherwise(F.lit(0.0))
    if mode == "log1p_row_norm":
        return logs.join(_sums(logs, "row"), "row").select("row", "col", by_row.alias("value"))
    if mode == "log1p_col_norm":
        return logs.join(_sums(logs, "col"), "col").select("row", "col", by_col.alias("value"))
    if mode == "log1p_balanced_norm":
        return logs.join(_sums(logs, "row"), "row").join(_sums(logs, "col"), "col").select("row", "col", ((by_row + by_col) / 2).alias("value"))
    raise ValueError(f"unknown mode: {mode}")


def submatrix(matrix: DataFrame, relations: DataFrame) -> DataFrame:
    """Cells whose row and column are both in ``relations`` (one column)."""
    name = relations.columns[0]
    r = relations.select(F.col(name).alias("row")).distinct()
    c = relations.select(F.col(name).alias("col")).distinct()
    return matrix.join(r, "row", "left_semi").join(c, "col", "left_semi").select("row", "col", "value")


def nested(matrix: DataFrame) -> DataFrame:
    """(row, cells): the cells of each row as a map; relations that occur as columns only have an empty one."""
    cells = matrix.groupBy("row").agg(F.map_from_entries(F.sort_array(F.collect_list(F.struct("col", "value")))).alias("cells"))
    empty = F.create_map().cast("map<string,double>")
    return universe(matrix).withColumnRenamed("relation", "row").join(cells, "row", "left").select("row", F.coalesce("cells", empty).alias("cells"))


def unnested(rows: DataFrame) -> DataFrame:
    """The reverse of :func:`nested`."""
    return rows.select("row", F.explode("cells").alias("col", "value"))


def dense(matrix: DataFrame, relations: DataFrame, default: float = 0.0, at_least: float | None = None) -> DataFrame:
    """(row, col, value) for every pair of ``relations`` (one column): ``default`` where ``matrix`` has no cell, nothing below ``at_least``."""
    names = relations.select(F.col(relations.columns[0]).alias("row")).where("row IS NOT NULL").distinct()
    # the square is the result; its side is the relations asked for
    side = names.agg(F.sort_array(F.collect_list("row")).alias("_all"))
    cells = names.join(F.broadcast(side), F.lit(True)).select("row", F.explode("_all").alias("col")).join(matrix.select("row", "col", F.col("value").alias("_v")), ["row", "col"], "left")
    v = F.coalesce("_v", F.lit(float(default)))
    return cells.select("row", "col", (v if at_least is None else F.greatest(v, F.lit(float(at_least)))).alias("value"))
