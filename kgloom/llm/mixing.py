"""p7: mixing sources to target weights with hash-threshold histograms.

Every document has a place between 0 and 1 by the hash of its identifier. A source that must give a part of its tokens gives those documents
whose place lies below a threshold; a source that must give more than it has repeats: its documents are all used k times and those below
the threshold once more. The thresholds come from histograms of tokens by source and hash bucket: the bucket that holds the threshold is
split again and again, and only its documents are looked at. No document is sorted, and a larger budget always keeps what a smaller one took.
The plan of the sources is a table: it may hold any number of them.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from kgloom.functions.labels import folded
from kgloom.llm.tokens import VOCABULARY, token_counts
from kgloom.operators.skew import lookup
from kgloom.session import cut, drop_cut

BITS, LEVELS = 12, 5


def place(ident: str, seed: int) -> Column:
    """60 bits of the hash of ``ident``."""
    return F.shiftrightunsigned(F.xxhash64(F.lit(seed), F.col(ident)), 64 - BITS * LEVELS)


def plans(sizes: DataFrame, targets: DataFrame, total: float) -> DataFrame:
    """``targets`` (source, share, repeats, one row per source) with budget, available, full, rest, threshold: what a source gives are all its
    documents ``full`` times and those with a place below ``threshold`` once more. ``sizes``: source, place, n_tokens (> 0), written."""
    have = sizes.groupBy("source").agg(F.sum("n_tokens").alias("_have"))
    plan = targets.join(have, "source", "left").select("source", "share", "repeats", (F.col("share") * total).alias("budget"), F.coalesce("_have", F.lit(0)).alias("available"))
    most = F.least(F.floor(F.col("budget") / F.col("available")), F.col("repeats")).cast("int")
    plan = plan.withColumn("full", F.when(F.col("available") > 0, most).otherwise(F.lit(0)))
    rest = F.when((F.col("available") > 0) & (F.col("full") < F.col("repeats")), F.col("budget") - F.col("full") * F.col("available")).otherwise(F.lit(0.0))
    zero = F.lit(0).cast("long")
    # while a source is open, its threshold lies in the bucket ``prefix`` and the documents before it hold ``below`` tokens
    plan = cut(plan.withColumn("rest", rest).withColumns({"prefix": zero, "below": zero, "threshold": zero, "open": F.col("rest") > 0}))
    for level in range(LEVELS):
        todo = plan.where("open")
        if todo.isEmpty():
            break
        shift = BITS * (LEVELS - 1 - level)
        want = cut(todo.select(F.col("source").alias("_source"), F.col("prefix").alias("_prefix")))
        near = lookup(sizes, want, [("source", "_source")], keep=True).where(F.shiftright("place", shift + BITS) == F.col("_prefix"))
        hist = near.groupBy(F.col("source").alias("_s"), F.shiftright("place", shift).alias("bucket")).agg(F.sum("n_tokens").alias("_n"), F.count(F.lit(1)).alias("_docs"))
        # at most 2^BITS buckets per source
        upto = F.sum("_n").over(Window.partitionBy("_s").orderBy("bucket").rowsBetween(Window.unboundedPreceding, 0))
        cells = hist.withColumn("_upto", upto).join(plan.select("source", "rest", "below"), F.col("_s") == F.col("source"))
        over = F.col("below") + F.col("_upto") > F.col("rest")
        cell = F.struct("bucket", "_n", "_docs", (F.col("_upto") - F.col("_n")).alias("_before"))
        edge = cells.groupBy("_s").agg(F.min(F.when(over, cell)).alias("_edge"), F.max(F.struct("bucket", "_upto")).alias("_last"))
        m = plan.join(edge, F.col("source") == F.col("_s"), "left")
        met, none = F.col("_edge").isNotNull(), F.col("_last").isNotNull()
        below = F.col("below") + F.col("_edge._before")
        n = F.col("_edge._n")
        split = (F.col("_edge._docs") > 1) & F.lit(level < LEVELS - 1)
        # one document, or several of one hash: the nearer side
        nearer = ~split & (below + n - F.col("rest") < F.col("rest") - below)
        one = lambda c: F.shiftleft(c + 1, shift)
        edged = F.when(nearer, one(F.col("_edge.bucket"))).otherwise(F.shiftleft(F.col("_edge.bucket"), shift))
        after = m.select(
            "source", "share", "repeats", "budget", "available", "full", "rest",
            F.when(F.col("open") & met, F.col("_edge.bucket")).otherwise(F.col("prefix")).alias("prefix"),
            F.when(F.col("open") & met, below + F.when(nearer, n).otherwise(0)).when(F.col("open") & none, F.col("below") + F.col("_last._upto")).otherwise(F.col("below")).alias("below"),
            F.when(F.col("open") & met, edged).when(F.col("open") & none, one(F.col("_last.bucket"))).otherwise(F.col("threshold")).alias("threshold"),
            (F.col("open") & met & F.coalesce(split, F.lit(False))).alias("open"),
        )
        plan, old = cut(after), plan
        drop_cut(old)
        drop_cut(want)
    return plan


def mix(documents: DataFrame, targets: DataFrame, total: float | None = None, seed: int = 7, vocabulary: str = VOCABULARY) -> tuple[DataFrame, DataFrame]:
    """(doc_id, source, n_tokens, uses of each document in the mix; per source what was asked and reached).

    ``documents``: doc_id (unique), source, text; ``targets``: source, target_share, max_repeats. Sources that differ in case, spaces or
    separators are one. ``total``: tokens that the shares refer to, all tokens of ``documents`` by default. Documents without doc_id or
    tokens, or of a source without target, aren't used. A NULL or negative share or repeat counts as 0. A source that can't reach its share
    within max_repeats gives all it may. The size reached misses a budget by at most half of one document.
    """
    slim = documents.where(F.col("doc_id").isNotNull()).select("doc_id", folded("source").alias("source"), "text")
    sizes = cut(token_counts(slim, vocabulary=vocabulary).where(F.col("n_tokens") > 0).withColumn("place", place("doc_id", seed)))
    wanted = targets.where(F.col("source").isNotNull()).groupBy(folded("source").alias("key")).agg(F.min("source").alias("target"), F.sum(F.greatest(F.coalesce("target_share", F.lit(0.0)), F.lit(0.0))).alias("share"), F.max(F.greatest(F.coalesce("max_repeats", F.lit(0)), F.lit(0))).alias("repeats"))
    wanted = cut(wanted)
    if total is None:
        total = float(sizes.agg(F.coalesce(F.sum("n_tokens"), F.lit(0)).alias("n")).collect()[0].n)
    plan = plans(sizes, wanted.select(F.col("key").alias("source"), "share", "repeats"), total)
    table = cut(plan.withColumnRenamed("source", "_key").join(wanted.select(F.col("key").alias("_name"), "target"), F.col("_key") == F.col("_name")).select("_key", "target", F.col("share").alias("target_share"), F.col("repeats").alias("max_repeats"), "budget", "available", "full", "threshold"))
    uses = F.col("full") + (F.col("place") < F.col("threshold")).cast("int")
    used = lookup(sizes, table, [("source", "_key")], keep=True).withColumn("uses", uses).where(F.col("uses") > 0)
    per = used.groupBy(F.col("_key").alias("_k")).agg(F.count(F.lit(1)).alias("documents"), F.sum(F.col("uses") * F.col("n_tokens")).alias("tokens"), F.max("uses").alias("most_uses"))
    whole = used.agg(F.sum(F.col("uses") * F.col("n_tokens")).alias("_all")).select("_all", F.lit(1).alias("_one"))
    report = table.join(per, F.col("_key") == F.col("_k"), "left").withColumn("_one", F.lit(1)).join(F.broadcast(whole), "_one")
    zero = lambda c: F.coalesce(F.col(c), F.lit(0))
    reached = F.round(zero("tokens") / F.col("_all"), 9)
    report = report.select(F.col("target").alias("source"), "target_share", "max_repeats", F.round("budget", 3).alias("budget_tokens"), F.col("available").alias("available_tokens"), zero("documents").alias("documents"), zero("most_uses").alias("most_uses"), zero("tokens").alias("tokens"), reached.alias("reached_share"))
    return used.select("doc_id", F.col("target").alias("source"), "n_tokens", "uses"), report
