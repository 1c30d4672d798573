"""p5: top N items within every group by secondary sort.

Each task sorts its own rows by group, score and identifier and streams on the first N of each group, so at most N rows per group and task
are shuffled; these are hash-partitioned by group, sorted again and streamed with their final rank. A group of any size is never held.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from kgloom.llm.heaps import first_n_stream


def top_n(df: DataFrame, n: int, group: str = "grp", score: str = "score", ident: str = "ident", rank: str = "rank") -> DataFrame:
    """``group``, ``ident``, ``rank`` (from 1) of the up to ``n`` highest scores of each group, ties by smaller ident.

    All three columns must be numbers. Rows whose group, score or ident is NULL, or whose score is NaN, take no part. Rows that tie in
    everything are kept side by side; bring one row per item.
    """
    slim = df.select(F.col(group).cast("long").alias(group), F.col(score).cast("double").alias(score), F.col(ident).cast("long").alias(ident))
    slim = slim.where(F.col(group).isNotNull() & F.col(ident).isNotNull() & F.col(score).isNotNull() & ~F.isnan(score))
    order = [F.col(group), F.col(score).desc(), F.col(ident)]
    near = slim.sortWithinPartitions(*order).mapInArrow(first_n_stream(group, n), slim.schema)
    out = T.StructType([*slim.schema.fields, T.StructField(rank, T.LongType())])
    return near.repartition(F.col(group)).sortWithinPartitions(*order).mapInArrow(first_n_stream(group, n, rank), out).select(group, ident, rank)


def latest_state(df: DataFrame, ident: str, at: str, *columns: str) -> DataFrame:
    """One row per ``ident``: ``columns`` as of the latest ``at`` (NULL is earliest; of states at one moment the greatest values)."""
    pick = F.max_by(F.struct(*columns), F.struct(F.col(at), *[F.col(c) for c in columns]))
    out = df.where(F.col(ident).isNotNull()).groupBy(ident).agg(pick.alias("_state"))
    return out.select(ident, *[F.col(f"_state.{c}").alias(c) for c in columns])
