"""p4: best representative of each duplicate group.

:func:`representatives` picks by given trust: which record survives and which record each field's value is taken from, with aggregates that
merge, so a group of any size is fine. The required p4_found is defined by given trust ranks alone, which estimated accuracies can't
reproduce; :func:`fuse` is Bayesian fusion with copy detection for values without such ranks.

Bayesian fusion here: every record claims a value of each field for its group on behalf of its source. Groups with the same picture of
claims are compressed to one *pattern* with a frequency, so estimation runs over patterns, not rows. In turns it estimates the probability
of each value from the accuracies of the sources that claim it (copied votes discounted), the accuracy of each source from the values it
claims, and for each pair of sources how likely one copies the other, from how often they share values that are probably false.
"""

from __future__ import annotations

import math
from collections import defaultdict
from collections.abc import Iterable, Iterator
from itertools import combinations

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kgloom.functions.labels import folded, folded_path, micros, usable
from kgloom.operators.skew import hot_keys, lookup
from kgloom.session import cut

FIELDS = ("source_stage", "provenance_type", "source_path")
#: Sources told apart at most; a source is a kind of reporter (say an event type), not a record.
MAX_SOURCES = 1_000
#: Accuracy of a source before the first estimate, and the share of its values that a copier copies.
START, COPIED = 0.8, 0.8


def representatives(records: DataFrame, trust: DataFrame) -> DataFrame:
    """One row per group with two or more different record_id.

    ``records``: key columns g0, g1, g2, record_id (bigint), source_stage, provenance_type, source_path, retrieved_at (text).
    ``trust``: field_name, field_value, trust_rank (1 is best). Rows with a NULL key or record_id belong to no group. Rows delivered twice
    change nothing. The survivor has the most usable fields; a ranked field is taken from the usable value of lowest rank (unlisted values
    after listed ones), the path from any usable one; ties go to the later retrieved_at (NULL or unreadable is earliest), then to the
    smaller record_id; 0 where no record has a usable value.
    """
    rank = trust.where(F.col("trust_rank").isNotNull()).select("field_name", folded("field_value").alias("v"), F.col("trust_rank").cast("long").alias("rk")).groupBy("field_name", "v").agg(F.min("rk").alias("rk"))
    slim = records.where(F.col("g0").isNotNull() & F.col("g1").isNotNull() & F.col("g2").isNotNull() & F.col("record_id").isNotNull()).select(
        "g0", "g1", "g2", F.col("record_id").cast("long").alias("id"), *[usable(f).alias(f"u_{f}") for f in FIELDS], folded("source_stage").alias("s"), folded("provenance_type").alias("p"), F.coalesce(micros("retrieved_at"), F.lit(-(2**62))).alias("at")
    )
    for short, field in (("s", "source_stage"), ("p", "provenance_type")):
        one = rank.where(F.col("field_name") == field).select(F.col("v").alias("_v"), F.col("rk").alias(f"rk_{short}"))
        # the trust table is fixed; it is broadcast only if Spark finds its size below the session's threshold
        slim = slim.join(one, F.col(short) == F.col("_v"), "left").drop("_v", short)
    last = F.lit(2**40)
    count = sum((F.col(f"u_{f}").cast("int") for f in FIELDS), F.lit(0))
    def best(where: Column, first: Column) -> Column:
        return F.max(F.when(where, F.struct(first.cast("long").alias("first"), F.col("at").alias("at"), (-F.col("id")).alias("id"))))

    out = slim.groupBy("g0", "g1", "g2").agg(
        F.min("id").alias("group_record_id"),
        F.max("id").alias("_most"),
        best(F.lit(True), count).alias("b_all"),
        best(F.col("u_source_stage"), -F.coalesce("rk_s", last)).alias("b_stage"),
        best(F.col("u_provenance_type"), -F.coalesce("rk_p", last)).alias("b_prov"),
        best(F.col("u_source_path"), F.lit(0)).alias("b_path"),
    )
    taken = lambda c: F.coalesce(-F.col(f"{c}.id"), F.lit(0))
    return out.where(F.col("group_record_id") != F.col("_most")).select(
        "group_record_id",
        taken("b_all").alias("survivor_record_id"),
        taken("b_stage").alias("stage_record_id"),
        taken("b_prov").alias("provenance_record_id"),
        taken("b_path").alias("path_record_id"),
    )


#: Rows of a group up to which one task reads its claims.
GROUP = 100_000
KEYS = ("g0", "g1", "g2")
Said = dict[str, dict[str, int]]


def spoken(records: DataFrame, source: str) -> DataFrame:
    """g0, g1, g2, src and the folded value of each field (NULL for filler) of every record with a whole key."""
    forms = [F.when(usable("source_stage"), folded("source_stage")).alias("source_stage"), F.when(usable("provenance_type"), folded("provenance_type")).alias("provenance_type"), folded_path("source_path").alias("source_path")]
    named = F.when(usable(source), folded(source)).otherwise(F.lit("unnamed"))
    return records.where(F.col("g0").isNotNull() & F.col("g1").isNotNull() & F.col("g2").isNotNull()).select(*KEYS, named.alias("src"), *forms)


def pattern_of(vectors: Iterable[tuple[tuple[tuple[str, int], ...], str, int]]) -> tuple[list[str], str]:
    """(values by place, pattern) from (rows per source that claim a value, the smallest such value, how many values are claimed so)."""
    vectors = sorted(vectors)
    total: dict[str, int] = defaultdict(int)
    for said, _, m in vectors:
        for s, n in said:
            total[s] += n * m
    # places follow what is claimed, never the values, so groups that look alike share a pattern
    entries = []
    for place, (said, _, m) in enumerate(vectors, 1):
        for s, n in said:
            entries.append(f"{s}={place}" + (f":{n / total[s]}" if n < total[s] else "") + (f"*{m}" if m > 1 else ""))
    return [v for _, v, _ in vectors], " ".join(entries)


def _vectors(said: Said) -> list[tuple[tuple[tuple[str, int], ...], str, int]]:
    out: dict[tuple[tuple[str, int], ...], list] = {}
    for value, by in said.items():
        known = out.setdefault(tuple(sorted(by.items())), [value, 0])
        known[0] = min(known[0], value)
        known[1] += 1
    return [(k, v, m) for k, (v, m) in out.items()]


_OUT = "g0 long, g1 long, g2 long, field string, values array<string>, pattern string"


def _arrow(rows: list[tuple]) -> pa.RecordBatch:
    g0, g1, g2, field, values, pattern = zip(*rows, strict=True)
    ids = [pa.array(x, pa.int64()) for x in (g0, g1, g2)]
    return pa.RecordBatch.from_arrays([*ids, pa.array(field, pa.string()), pa.array(values, pa.list_(pa.string())), pa.array(pattern, pa.string())], names=[*KEYS, "field", "values", "pattern"])


def _gathered(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """From rows of :func:`spoken` sorted by group: what is claimed for each field of each group. One group is held at a time."""
    key: tuple | None = None
    said: list[Said] = [{}, {}, {}]
    out: list[tuple] = []

    def close() -> None:
        for field, claims in zip(FIELDS, said, strict=True):
            if claims:
                out.append((*key, field, *pattern_of(_vectors(claims))))

    for b in batches:
        for g0, g1, g2, src, *values in zip(*(c.to_pylist() for c in b.columns), strict=True):
            if (g0, g1, g2) != key:
                if key is not None:
                    close()
                key, said = (g0, g1, g2), [{}, {}, {}]
            for claims, v in zip(said, values, strict=True):
                if v is not None:
                    by = claims.setdefault(v, {})
                    by[src] = by.get(src, 0) + 1
        if len(out) >= 5_000:
            yield _arrow(out)
            out.clear()
    if key is not None:
        close()
    if out:
        yield _arrow(out)


def _gathered_vectors(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        rows = [(g0, g1, g2, f, *pattern_of((tuple((x["src"], x["n"]) for x in v["said"]), v["value"], v["m"]) for v in vectors)) for g0, g1, g2, f, vectors in zip(*(c.to_pylist() for c in b.columns), strict=True)]
        if rows:
            yield _arrow(rows)


def patterns(records: DataFrame, source: str, group: int = GROUP) -> tuple[DataFrame, DataFrame]:
    """(values of each field of a group with the pattern of its claims, pattern frequencies).

    A pattern is which sources claim a value and how often: the estimates depend on nothing else. A source has one vote a field; where it
    claims several values, each is a vote with its share of the source's rows (``source=place:share``); values that are claimed alike are one
    place with their number (``*number``), for which the smallest stands. Groups of up to ``group`` rows are brought together in one shuffle
    and read one after the other. Larger ones are compressed first, by group, value and source, then by what is claimed for a value, so that
    no task holds their rows; both ways give the same patterns.
    """
    rows = cut(spoken(records, source))
    hot = cut(hot_keys(rows, list(KEYS), group).select(*KEYS))
    large = not hot.isEmpty()
    normal = rows.join(F.broadcast(hot), list(KEYS), "left_anti") if large else rows
    per = normal.repartition(*KEYS).sortWithinPartitions(*KEYS).mapInArrow(_gathered, _OUT)
    if large:
        # fewer than rows/``group`` groups
        entries = F.explode(F.array(*[F.struct(F.lit(f).alias("field"), F.col(f).alias("value")) for f in FIELDS]))
        said = rows.join(F.broadcast(hot), list(KEYS), "left_semi").select(*KEYS, "src", entries.alias("e")).where("e.value IS NOT NULL")
        by_source = said.groupBy(*KEYS, "e.field", "e.value", "src").agg(F.count(F.lit(1)).alias("n"))
        by_value = by_source.groupBy(*KEYS, "field", "value").agg(F.sort_array(F.collect_list(F.struct("src", "n"))).alias("said"))
        alike = by_value.groupBy(*KEYS, "field", "said").agg(F.min("value").alias("value"), F.count(F.lit(1)).alias("m"))
        per = per.unionByName(alike.groupBy(*KEYS, "field").agg(F.collect_list(F.struct("said", "value", "m")).alias("v")).mapInArrow(_gathered_vectors, _OUT))
    per = cut(per)
    return per, per.groupBy("field", "pattern").agg(F.count(F.lit(1)).alias("freq"))


#: Source, place of the value, share of the source's vote (1), number of values at that place (1).
Vote = tuple[str, int] | tuple[str, int, float] | tuple[str, int, float, int]


def _shares(votes: list[Vote]) -> dict[int, dict[str, float]]:
    """Place of a value -> the share of its vote that each source gives it."""
    out: dict[int, dict[str, float]] = defaultdict(dict)
    for s, at, *more in votes:
        out[at][s] = more[0] if more else 1.0
    return out


def _numbers(votes: list[Vote]) -> list[int]:
    """How many values stand at each place."""
    out = [1] * max(v[1] for v in votes)
    for _, at, *more in votes:
        out[at - 1] = more[1] if len(more) > 1 else 1
    return out


def _posterior(votes: list[Vote], accuracy: dict[str, float], copying: dict[tuple[str, str], float], n_false: int) -> list[float]:
    """Probability of each value (by place; of one of them where several stand there): independent votes weigh ln(n·A/(1−A)) times their share, a vote that may be copied weighs the
    part that isn't; of a vote no more can be copied than the other source gives the value."""
    shares = _shares(votes)
    score = [0.0] * max(shares)
    for place, said in shares.items():
        counted: list[str] = []
        for s in sorted(said, key=lambda s: (-accuracy[s], s)):
            alone = math.prod(1 - COPIED * copying.get((min(s, o), max(s, o)), 0.0) * min(1.0, said[o] / said[s]) for o in counted)
            score[place - 1] += said[s] * alone * math.log(n_false * accuracy[s] / (1 - accuracy[s]))
            counted.append(s)
    top = max(score)
    weight = [math.exp(x - top) for x in score]
    number = _numbers(votes)
    other = max(0, n_false + 1 - sum(number)) * math.exp(-top)
    whole = sum(w * m for w, m in zip(weight, number, strict=True)) + other
    return [w / whole for w in weight]


def _votes(pattern: str) -> list[Vote]:
    out: list[Vote] = []
    for x in pattern.split(" "):
        s, _, at = x.rpartition("=")
        at, _, number = at.partition("*")
        place, _, share = at.partition(":")
        out.append((s, int(place), float(share or 1), int(number or 1)))
    return out


State = dict[str, tuple[dict[str, float], dict[tuple[str, str], float]]]
NONE: tuple[dict[str, float], dict[tuple[str, str], float]] = ({}, {})


def evidence(rows: Iterable[tuple[str, str, int]], state: State, n_false: int) -> dict[tuple[str, str, str, str], float]:
    """Sums over (field, pattern, freq) rows, to be added up over partitions: (field, kind, a, b) -> weight.

    Kinds: right and told of a source a; true, false and differ of a pair of sources.
    """
    out: dict[tuple[str, str, str, str], float] = defaultdict(float)
    for field, pattern, n in rows:
        votes = _votes(pattern)
        if len({v[0] for v in votes}) < 2:
            continue  # a lone source says nothing about anybody's accuracy, whatever it claims
        accuracy, copying = state.get(field, NONE)
        truth = _posterior(votes, defaultdict(lambda: START, accuracy), copying, n_false)
        by_source: dict[str, dict[int, float]] = defaultdict(dict)
        number = _numbers(votes)
        for at, said in _shares(votes).items():
            for s, share in said.items():
                by_source[s][at] = share
                out[field, "right", s, ""] += n * number[at - 1] * share * truth[at - 1]
        for s in by_source:
            out[field, "told", s, ""] += n
        # of two votes, the part that falls on the same value is shared, the rest differs
        for a, b in combinations(sorted(by_source), 2):
            rest = 1.0
            for at in sorted(by_source[a].keys() & by_source[b].keys()):
                both = min(by_source[a][at], by_source[b][at]) * number[at - 1]
                out[field, "true", a, b] += n * both * truth[at - 1]
                out[field, "false", a, b] += n * both * (1 - truth[at - 1])
                rest -= both
            if rest > 1e-9:
                out[field, "differ", a, b] += n * rest
    return out


def updated(sums: dict[tuple[str, str, str, str], float], n_false: int, prior: float, first: bool = False) -> State:
    """Accuracies and copying probabilities of each field from the summed evidence.

    Copying is judged by how often two sources share values that are probably false: rare for independent sources, common for a copier.
    In the ``first`` round nothing is known of what is false (a clique of copiers may outvote everybody), so accuracies stay as they are
    and only agreement as such counts: copiers agree more often than independent sources can.
    """
    state: State = {}
    for field, kind, s, _ in sums:
        accuracy, _ = state.setdefault(field, ({}, {}))
        if kind == "told":
            accuracy[s] = START if first else min(0.99, max(0.05, (sums.get((field, "right", s, ""), 0.0) + 1.6) / (sums[field, "told", s, ""] + 2)))
    for field, a, b in {(f, a, b) for f, _, a, b in sums if b}:
        accuracy, copying = state[field]
        t, f = accuracy[a] * accuracy[b], (1 - accuracy[a]) * (1 - accuracy[b]) / n_false
        d, mean = max(1e-9, 1 - t - f), (accuracy[a] + accuracy[b]) / 2
        alone = (math.log(t), math.log(f), math.log(d))
        copied = (math.log(COPIED * mean + (1 - COPIED) * t), math.log(COPIED * (1 - mean) + (1 - COPIED) * f), math.log((1 - COPIED) * d))
        seen = [sums.get((field, k, a, b), 0.0) for k in ("true", "false", "differ")]
        if first:
            alone = (math.log(t + f),) * 2 + (math.log(d),)
            copied = (math.log(COPIED + (1 - COPIED) * (t + f)),) * 2 + (math.log((1 - COPIED) * d),)
        gap = math.log(prior / (1 - prior)) + sum(k * (y - x) for k, x, y in zip(seen, alone, copied, strict=True))
        copying[a, b] = 1 / (1 + math.exp(-max(-50.0, min(50.0, gap))))
    return state


def fuse(records: DataFrame, source: str, rounds: int = 6, n_false: int = 10, prior: float = 0.1) -> DataFrame:
    """g0, g1, g2, field, value, probability: the value of maximum posterior for each field of each group that has a usable one.

    ``n_false``: false values a field may take; ``prior``: probability that two sources depend on each other before any evidence; ties go
    to the smaller value. Each round is one pass over the claim patterns; only sums per source and pair of sources reach the driver, at most
    ``MAX_SOURCES`` squared a field, and more sources than that are refused.
    """
    per, freqs = patterns(records, source)
    freqs = cut(freqs)
    state: State = {}
    for turn in range(rounds):
        now = state

        def part(batches: Iterator[pd.DataFrame], now: State = now) -> Iterator[pd.DataFrame]:
            sums = evidence((x for b in batches for x in zip(b["field"], b["pattern"], b["freq"], strict=True)), now, n_false)
            yield pd.DataFrame([(*k, v) for k, v in sums.items()], columns=["field", "kind", "a", "b", "w"])

        sums = freqs.mapInPandas(part, "field string, kind string, a string, b string, w double").groupBy("field", "kind", "a", "b").agg(F.sum("w").alias("w"))
        got = {(r.field, r.kind, r.a, r.b): r.w for r in sums.limit(3 * 4 * MAX_SOURCES**2).collect()}
        if len({a for _, _, a, _ in got}) > MAX_SOURCES:
            raise ValueError(f"more than {MAX_SOURCES} sources: name kinds of sources, not records")
        state = updated(got, n_false, prior, first=turn == 0)
    done = state

    def judged(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            post = [[float(x) for x in _posterior(_votes(p), defaultdict(lambda: START, done.get(f, NONE)[0]), done.get(f, NONE)[1], n_false)] for f, p in zip(b["field"], b["pattern"], strict=True)]
            yield pd.DataFrame({"f": b["field"], "p": b["pattern"], "post": post})

    found = cut(freqs.mapInPandas(judged, "f string, p string, post array<double>"))
    # groups concentrate on few patterns ("one source, one value")
    out = lookup(per, found, [("field", "f"), ("pattern", "p")])
    place = F.expr("array_min(transform(post, (x, i) -> struct(-round(x, 9) AS neg, values[i] AS value)))")
    return out.withColumn("_best", place).select("g0", "g1", "g2", "field", F.col("_best.value").alias("value"), (-F.col("_best.neg")).alias("probability"))
