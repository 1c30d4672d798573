"""Per-key results where a handful of keys hold most rows.

The rows are first compressed to (key, value, frequency). That group-by spreads a hot key over its values and combines map-side, so
no task sees more than its share of rows; the per-key results are then derived from the weighted values with aggregates that merge.
Where an order inside a key is needed (percentiles, ranks), :func:`running_totals` cuts each key into range pieces of bounded size.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from kgloom.session import cut, drop_cut


def value_frequencies(df: DataFrame, keys: Sequence[str], value: str, freq: str = "freq") -> DataFrame:
    """One row per key and distinct value with its number of rows. NULL keys and NULL values count as values of their own."""
    return df.groupBy(*keys, value).agg(F.count(F.lit(1)).alias(freq))


def merged_frequencies(freqs: DataFrame, keys: Sequence[str], value: str, freq: str = "freq") -> DataFrame:
    """Frequencies whose keys or values were renamed after compression, added up again."""
    return freqs.groupBy(*keys, value).agg(F.sum(freq).alias(freq))


def profile(freqs: DataFrame, keys: Sequence[str], value: str, freq: str = "freq", numeric: bool = False) -> DataFrame:
    """Per key: rows, non-null rows, exact distinct values and mode; for numbers also sum, mean, min and max.

    The mode is the most frequent non-null value, the smallest of those tied; NULL where a key has none. NaN counts as NULL.
    """
    v = F.col(value)
    if numeric:
        v = F.when(~F.isnan(v.cast("double")), v)
    n = F.col(freq)
    aggs: list[Column] = [
        F.sum(n).alias("n_rows"),
        F.coalesce(F.sum(F.when(v.isNotNull(), n)), F.lit(0)).alias("n_values"),
        F.count(v).alias("n_distinct"),
    ]
    if numeric:
        # one order key for "most frequent, then smallest"; both parts are numbers, so the aggregate stays a hash aggregate
        aggs += [F.max_by(v, F.when(v.isNotNull(), F.struct(n, -v))).alias("mode_value"), F.sum(v * n).alias("sum_value"), F.min(v).alias("min_value"), F.max(v).alias("max_value")]
        out = freqs.groupBy(*keys).agg(*aggs)
        return out.withColumn("mean_value", F.col("sum_value") / F.when(F.col("n_values") > 0, F.col("n_values")))
    # text can't be negated: take the highest frequency first, then the smallest value that has it, both mergeable
    inner = [F.col(k).alias(f"_k{i}") for i, k in enumerate(keys)]  # a key may be called like one of the results
    top = freqs.groupBy(*inner).agg(*aggs, F.max(F.when(v.isNotNull(), n)).alias("_top"))
    best = freqs.where(v.isNotNull()).groupBy(*inner, n.alias("_n")).agg(F.min(v).alias("mode_value"))
    cond = [top[f"_k{i}"].eqNullSafe(best[f"_k{i}"]) for i in range(len(keys))] + [top["_top"] == best["_n"]]
    joined = top.join(best, _all(cond), "left")
    return joined.select(*[top[f"_k{i}"].alias(k) for i, k in enumerate(keys)], "n_rows", "n_values", "n_distinct", best["mode_value"])


def _all(conds: list[Column]) -> Column:
    out = conds[0]
    for c in conds[1:]:
        out = out & c
    return out


#: Rows of a range piece.
PIECE = 2_000_000


def running_totals(df: DataFrame, group: Sequence[str], order: Sequence[Column], weight: Column | None = None, total: str = "running", pieces: int | None = None) -> DataFrame:
    """``df`` with the inclusive running sum of ``weight`` (rows if None) inside each group in the given order, exact.

    No group ends up in one task: rows are range-partitioned by group and order, so a group of any size is cut into pieces of about
    ``PIECE`` rows, or into as many as there are shuffle partitions if that makes them smaller; each piece is summed on its own and shifted by the totals of the pieces before it. ``order`` must end in a unique column, else
    rows that tie share pieces. The partitioned rows are written once (:func:`kgloom.session.cut`), so a repeated task sees the same pieces.
    """
    spark = df.sparkSession
    w = F.lit(1).cast("long") if weight is None else weight
    # written first, as rows are counted, sampled for the ranges and moved
    flat = cut(df.withColumn("__w", w))
    n = pieces or max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-flat.count() // PIECE))
    ranged = flat.repartitionByRange(n, *[F.col(g) for g in group], *order).withColumn("__piece", F.spark_partition_id())
    ranged = cut(ranged)
    drop_cut(flat)
    own = Window.partitionBy("__piece", *group).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    inside = ranged.withColumn(total, F.sum("__w").over(own))
    # at most one row per piece of a group, so this window never holds more than ``pieces`` rows of a group
    totals = ranged.groupBy("__piece", *group).agg(F.sum("__w").alias("__t"))
    before = Window.partitionBy(*group).orderBy("__piece").rowsBetween(Window.unboundedPreceding, -1)
    shift = totals.select(F.col("__piece").alias("__p"), *[F.col(g).alias(f"__g{i}") for i, g in enumerate(group)], F.coalesce(F.sum("__t").over(before), F.lit(0)).alias("__before"))
    cond = [F.col("__piece") == F.col("__p")] + [F.col(g).eqNullSafe(F.col(f"__g{i}")) for i, g in enumerate(group)]
    out = inside.join(shift, _all(cond)).withColumn(total, F.col(total) + F.col("__before"))
    return out.drop("__p", "__before", "__w", "__piece", *[f"__g{i}" for i in range(len(group))])


def weighted_percentiles(freqs: DataFrame, keys: Sequence[str], value: str, points: Sequence[float], freq: str = "freq", linear: bool = False) -> DataFrame:
    """Per key and point q the exact value at place floor(q·(n−1)) of its sorted values, from their frequencies; ``linear``: the value between
    that place and the next, in proportion.

    NULL and NaN values take no part; a key with no other value has no row. Columns: keys, ``q``, ``value``.
    """
    clean = freqs.where(F.col(value).isNotNull() & ~F.isnan(F.col(value).cast("double"))).groupBy(*keys, value).agg(F.sum(freq).alias(freq))
    run = running_totals(clean, keys, [F.col(value)], F.col(freq), "_upto")
    sizes = clean.groupBy(*[F.col(k).alias(f"_k{i}") for i, k in enumerate(keys)]).agg(F.sum(freq).alias("_n"))
    run = skew_join(run, sizes, [(k, f"_k{i}") for i, k in enumerate(keys)])
    q = F.explode(F.array(*[F.lit(float(p)) for p in points]))
    exact = F.round(F.col("q") * (F.col("_n") - 1), 9)
    place = F.floor(exact)
    covers = lambda p: (p < F.col("_upto")) & (p >= F.col("_upto") - F.col(freq))
    if not linear:
        return run.withColumn("q", q).where(covers(place)).select(*keys, "q", F.col(value).alias("value"))
    # the parts of both places add up
    part = exact - place
    run = run.withColumn("q", q).where(covers(place) | covers(F.ceil(exact)))
    weight = F.when(covers(place), 1.0 - part).otherwise(0.0) + F.when(covers(F.ceil(exact)), F.when(F.ceil(exact) > place, part).otherwise(0.0)).otherwise(0.0)
    return run.groupBy(*keys, "q").agg(F.sum(F.col(value) * weight).alias("value"))


def skew_join(left: DataFrame, right: DataFrame, on: Sequence[tuple[str, str]], how: str = "inner", salts: int = 16, keep: bool = False) -> DataFrame:
    """Join a skewed ``left`` to a ``right`` with one row per key, null-safe, without one task taking a hot key of ``left``.

    Rows of ``left`` get a salt, ``right`` is repeated once for each salt: a key that holds a third of all rows is spread over ``salts``
    tasks and AQE may split further. ``how``: inner or left.
    """
    salted = left.withColumn("_salt", F.pmod(F.xxhash64(F.spark_partition_id(), *[F.col(c) for c in left.columns]), F.lit(salts)).cast("int"))
    # Spark judges the repeated side by the size of the unrepeated one and would broadcast it
    many = right.withColumn("_rsalt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1)))).hint("merge")
    cond = [F.col("_salt") == F.col("_rsalt")] + [F.col(a).eqNullSafe(F.col(b)) for a, b in on]
    return salted.join(many, _all(cond), how).drop("_salt", "_rsalt", *([] if keep else [b for _, b in on]))


#: Rows of a written table that may be broadcast.
SMALL = 100_000


def lookup(left: DataFrame, right: DataFrame, on: Sequence[tuple[str, str]], how: str = "inner", small: int = SMALL, keep: bool = False) -> DataFrame:
    """Join a skewed ``left`` to a written ``right`` with one row per key, null-safe: broadcast if ``right`` has at most ``small`` rows, which
    are counted first; else :func:`skew_join`. The key columns of ``right`` go unless ``keep`` is set. ``how``: inner or left."""
    if len(right.select(on[0][1]).take(small + 1)) > small:
        return skew_join(left, right, on, how, keep=keep)
    cond = _all([F.col(a).eqNullSafe(F.col(b)) for a, b in on])
    return left.join(F.broadcast(right), cond, how).drop(*([] if keep else [b for _, b in on]))


def hot_keys(df: DataFrame, keys: Sequence[str], over: int) -> DataFrame:
    """(keys, n_rows) of the keys with more than ``over`` rows; there are fewer than rows/``over`` of them.

    Rows are counted by hash bucket first, which shuffles a bounded number of counts per task; keys are only told apart inside buckets that
    hold more than ``over`` rows, of which there are few as well."""
    bucket = F.pmod(F.xxhash64(*keys), F.lit(65_536)).cast("int")
    full = df.groupBy(bucket.alias("_b")).agg(F.count(F.lit(1)).alias("_n")).where(F.col("_n") > over).select("_b")
    near = df.select(*keys, bucket.alias("_hb")).join(F.broadcast(full), F.col("_hb") == F.col("_b"), "left_semi")
    return near.groupBy(*keys).agg(F.count(F.lit(1)).alias("n_rows")).where(F.col("n_rows") > over)


def hot_join(left: DataFrame, right: DataFrame, on: tuple[str, str], how: str = "inner") -> DataFrame:
    """Join a written, skewed ``left`` to ``right`` with one row per key on one column that is never NULL in ``left``. ``how``: inner or left.

    Keys that hold more than a quarter of an even partition's share of ``left`` (at most four times as many as partitions) meet their rows of
    ``right`` by broadcast; all others are joined as usual. The key column of ``right`` goes."""
    parts = int(left.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    a, b = on
    hot = cut(hot_keys(left, [a], max(10_000, left.count() // (4 * parts))).select(F.col(a).alias("_hot")))
    if hot.isEmpty():
        return left.join(right, F.col(a) == F.col(b), how).drop(b)
    few = F.broadcast(right.join(F.broadcast(hot), F.col(b) == F.col("_hot"), "left_semi"))
    known = left.join(F.broadcast(hot), F.col(a) == F.col("_hot"), "left_semi").join(few, F.col(a) == F.col(b), how).drop(b)
    rest = left.join(F.broadcast(hot), F.col(a) == F.col("_hot"), "left_anti").join(right, F.col(a) == F.col(b), how).drop(b)
    return known.unionByName(rest)


def heavy_keys(freqs: DataFrame, scope: str, key: str, parts: int, of: int, freq: str = "freq") -> DataFrame:
    """Keys that hold at least ``parts`` of every ``of`` rows of their ``scope`` (a table name, say), compared in whole numbers.

    Rows without a key count in the total but are no key. At most of/parts rows per scope come out.
    """
    # "has a key" is asked after aggregation: a filter pushed below it would make the total a second scan
    per = freqs.groupBy(scope, key).agg(F.sum(freq).alias("n_rows"), F.count(key).alias("_named"))
    total = per.groupBy(F.col(scope).alias("_scope")).agg(F.sum("n_rows").alias("_total"))
    out = per.where(F.col("_named") > 0).join(total, F.col(scope) == F.col("_scope"))
    return out.where(F.col("n_rows") * of >= F.col("_total") * parts).select(scope, key, "n_rows")
