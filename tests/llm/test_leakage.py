import random

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from kgloom.llm import leakage as L


@settings(max_examples=150, deadline=None)
@given(st.lists(st.text("abc", max_size=14), min_size=1, max_size=6), st.text("abcd", max_size=60), st.integers(1, 5))
def test_automaton_matches_brute_force(items, text, limit):
    found, spans = L.Automaton([(i, list(x)) for i, x in enumerate(items)], limit).matches(list(text))
    want = {i for i, x in enumerate(items) if any(x[k : k + limit] in text for k in range(len(x) - limit + 1))}
    covered = {k + j for k in range(len(text) - limit + 1) if any(text[k : k + limit] in x for x in items) for j in range(limit)}
    assert found == want
    assert {k for s, e in spans for k in range(s, e)} == covered
    assert spans == sorted(spans) and all(a[1] < b[0] for a, b in zip(spans, spans[1:], strict=False))


def test_normalisation():
    assert L.words(L.normalised("<b>Ab</b>c&nbsp;D­en ﻿x*y*")) == ["abc", "den", "xy"]
    assert L.words(L.normalised("ＡＢ１ ÉTE")) == ["ab1", "éte"]
    assert L.characters(L.normalised("น้ำ")) == list("น้ำ")
    assert L.is_unspaced(L.normalised("艾科P17的守灯人")) and not L.is_unspaced(L.normalised("Keeper 艾"))


def test_contaminated(spark):
    r = random.Random(4)
    word = lambda: "".join(r.choice("abcdefghij") for _ in range(6))
    a, b = [[word() for _ in range(30)] for _ in range(2)]
    zh = "艾科艾奥并入沙伦加哈时塔洛温伦的渡口局只留下九百四十四份契约并把其余交给内哈"
    items = spark.createDataFrame([(1, " ".join(a)), (2, " ".join(a[5:] + b)), (3, zh), (4, None), (5, "too short"), (6, "")], "item_id long, passage string")
    docs = [
        (1, "x " + ", ".join(a[10:20]).upper() + " y"),
        (2, " ".join(a[10:19])),
        (3, "见" + "，".join(zh[3:23]) + "。"),
        (4, zh[3:22]),
        (5, None),
        (6, ""),
        (7, "pad " * 200_000 + " ".join(b[:10])),
        (8, " ".join(a[:10])),
        (None, " ".join(a)),
    ]
    df = spark.createDataFrame(docs, "doc_id long, text string").withColumnRenamed("doc_id", "doc_id").selectExpr("*", "'x' AS item_id")
    assert {tuple(x) for x in L.contaminated(df, items).collect()} == {(1, 1), (1, 2), (3, 3), (7, 2), (8, 1)}
    got = {x.doc_id: (x.leaked_units, x.n_units, x.verdict) for x in L.coverage(df, items).collect()}
    assert got[1] == (10, 12, "drop") and got[8] == (10, 10, "drop") and got[7] == (10, 200_010, "cut") and got[3][0] == 20
    assert L.contaminated(df, items.limit(0)).count() == 0 and L.contaminated(df.limit(0), items).count() == 0


def test_blocks_find_the_same(spark, monkeypatch):
    items = spark.createDataFrame([(i, " ".join(f"w{i}x{k}" for k in range(12))) for i in range(9)], "item_id long, passage string")
    docs = spark.createDataFrame([(d, " ".join(f"w{d}x{k}" for k in range(1, 12))) for d in range(9)], "doc_id long, text string")
    monkeypatch.setattr(L, "BLOCK_UNITS", 30)
    assert {tuple(x) for x in L.contaminated(docs, items).collect()} == {(d, d) for d in range(9)}


def test_cutting(spark):
    a = [f"word{k}x" for k in range(30)]
    zh = "艾科艾奥并入沙伦加哈时塔洛温伦的渡口局只留下九百四十四份契约并把其余交给内哈"
    items = spark.createDataFrame([(1, " ".join(a)), (2, zh)], "item_id long, passage string")
    pad = "Something else entirely stands here and goes on for quite a while, so little of it is leaked. "
    leak = "<b>" + ",&nbsp;".join(x.upper() for x in a[3:15]) + "</b>"
    docs = spark.createDataFrame([(1, pad + leak + "! " + pad), (2, leak), (3, pad), (4, pad * 3 + "见“" + zh[2:24] + "”吗？"), (5, None)], "doc_id long, text string")
    got = {r.doc_id: r.text for r in L.cleaned(docs, items).collect()}
    assert got == {1: pad + "<b></b>! " + pad, 2: None, 4: pad * 3 + "见“”吗？"}


@settings(max_examples=200, deadline=None)
@given(st.text("aB é́ß&amp;<b>*`ﬁ각가​Å名ก้ำ", max_size=40))
def test_places_cover_the_text(text):
    norm, starts, ends = L.located(text)
    assert norm == L.normalised(text) and len(norm) == len(starts) == len(ends)
    assert all(0 <= s < e <= len(text) for s, e in zip(starts, ends, strict=True))


@settings(max_examples=300, deadline=None)
@given(st.text(st.one_of(st.sampled_from(list("aI&;lt<>b/*`#x3e \u200b\u0301\u0345ｶﾞﾟが\u0e4d\u0e32ำ\u0ecdາ각\u1100\u1161\u11a8\u09c7\u09beﬁßİ")), st.characters(codec="utf-8")), max_size=40))
def test_places_never_reach_over_the_text(text):
    norm, starts, ends = L.located(text)
    assert norm == L.normalised(text) and len(norm) == len(starts) == len(ends)
    assert all(0 <= s < e <= len(text) for s, e in zip(starts, ends, strict=True))


@pytest.mark.parametrize("odd", ["&lt;b&gt;bold&lt;/b&gt;", "ｶﾞｷﾞ", "น\u0e4d\u0e32", "e\u200b\u0301t"])
def test_cut_stays_small_with_odd_forms(odd):
    a = [f"word{k}x" for k in range(12)]
    pair = next(L.blocks([(1, " ".join(a))]))
    pad = f"Something else entirely {odd} stands here and goes on for quite a while, so little of it is leaked. "
    norm, starts, ends = L.located(pad)
    assert norm == L.normalised(pad) and max(e - s for s, e in zip(starts, ends, strict=True)) <= 9
    assert L.without_runs(pad + " ".join(a) + "! " + pad, pair) == pad + "! " + pad


def test_blocks_are_judged_together(spark, monkeypatch):
    item = lambda i: [f"w{i}x{k}" for k in range(12)]
    pad = lambda n: " ".join(f"pad{k}q" for k in range(n))
    items = spark.createDataFrame([(i, " ".join(item(i))) for i in range(4)], "item_id long, passage string")
    both = " ".join(item(0)) + ". " + pad(16) + " " + " ".join(item(3)) + "."
    docs = [
        (1, both),  # 12 of 40 words by either block
        (2, pad(20) + " " + " ".join(item(0)) + ". " + pad(20) + " " + " ".join(item(3)) + "."),
        (3, pad(40)),
        (4, pad(40) + " " + " ".join(item(3)[:6] + item(0) + item(3)[6:])),  # the cut joins a run of the other block
        (5, pad(40)),
        (5, pad(40) + " " + " ".join(item(2))),
    ]
    df = spark.createDataFrame(docs, "doc_id long, text string").repartition(2)
    got = []
    for size in (200_000, 12):
        monkeypatch.setattr(L, "BLOCK_UNITS", size)
        assert sum(1 for _ in L.blocks((i, " ".join(item(i))) for i in range(4))) == (1 if size > 12 else 4)
        got.append(({tuple(x) for x in L.coverage(df, items).collect()}, {tuple(x) for x in L.cleaned(df, items).collect()}))
    assert got[0] == got[1]
    assert (1, 24, 40, 0.6, "drop") in got[0][0] and dict(got[0][1]) == {1: None, 2: pad(20) + " . " + pad(20) + " .", 4: pad(40) + " ", 5: pad(40) + " "}
