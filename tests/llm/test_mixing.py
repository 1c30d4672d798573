from pyspark.sql import functions as F

from kgloom.llm import mixing
from kgloom.llm.tokens import VOCABULARY, encoder, token_counts


def test_token_counts(spark):
    texts = ["", None, "Hello  world\n", "Prüfung 12", "割已经关闭。", "<|endoftext|>", "a" * 5000]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    enc = encoder(open(VOCABULARY, "rb").read())
    assert {r.doc_id: r.n_tokens for r in token_counts(df).collect()} == {i: len(enc.encode_ordinary(t)) if t else 0 for i, t in enumerate(texts)}
    assert all(enc.decode(enc.encode_ordinary(t)) == t for t in texts if t)


def docs(spark, n=400):
    src = F.when(F.col("id") % 10 < 6, "big").when(F.col("id") % 10 < 9, " Mid-Size").otherwise("small")
    return spark.range(n).select(F.col("id").alias("doc_id"), src.alias("source"), F.expr("repeat('word ', cast(1 + id % 37 as int))").alias("text"), F.lit(3).alias("n_tokens_"))


def test_mix_reaches_budgets(spark):
    targets = spark.createDataFrame([("big", 0.3, 1), ("mid_size", 0.4, 3), ("small", 0.3, 2), ("absent", 0.1, 2), ("zero", None, 2)], "source string, target_share double, max_repeats int")
    used, report = mixing.mix(docs(spark), targets)
    rows, rep = used.collect(), {r.source: r for r in report.collect()}
    assert len({r.doc_id for r in rows}) == len(rows)
    for s, r in rep.items():
        own = [x for x in rows if x.source == s]
        assert sum(x.uses * x.n_tokens for x in own) == r.tokens and len(own) == r.documents
        assert max([x.uses for x in own], default=0) <= r.max_repeats
        most = r.available_tokens * r.max_repeats
        if most <= r.budget_tokens:
            assert r.tokens == most
        else:
            assert abs(r.tokens - r.budget_tokens) <= 38 / 2
        assert len({x.uses for x in own}) <= 2 and (not own or max(x.uses for x in own) - min(x.uses for x in own) <= 1)
    assert rep["absent"].tokens == 0 and abs(sum(r.reached_share for r in rep.values()) - 1) < 1e-6


def test_thresholds_nest(spark):
    targets = spark.createDataFrame([("big", 0.2, 1), ("mid size", 0.1, 1)], "source string, target_share double, max_repeats int")
    small = {r.doc_id for r in mixing.mix(docs(spark), targets, total=4000.0)[0].collect()}
    large = {r.doc_id for r in mixing.mix(docs(spark), targets, total=9000.0)[0].collect()}
    assert small and small < large


def test_mix_of_nothing(spark):
    targets = spark.createDataFrame([("big", 0.2, 1)], "source string, target_share double, max_repeats int")
    used, report = mixing.mix(docs(spark, 0), targets)
    assert used.count() == 0 and report.collect()[0].tokens == 0
    assert mixing.mix(docs(spark), targets.limit(0))[0].count() == 0
    blank = docs(spark, 5).withColumn("text", F.lit("").cast("string")).unionByName(docs(spark, 5).withColumn("doc_id", F.lit(None).cast("long")))
    assert mixing.mix(blank, targets)[0].count() == 0
