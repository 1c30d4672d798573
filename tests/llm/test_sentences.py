import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from kgloom.llm.sentences import sentence_units, sentences


def split(text):
    return [text[s:e] for s, e in sentence_units(text)]


# units joined by "|" in the first, white space between them as written
CASES = [
    ("Dr. A. Vi compared P1 vs. P2.| The value was 0.741... and nobody noticed.|  It ended at 4 p.m. on node 5.",),
    ("Wait... the support of P17 is 0.7?!| v1.2 of the pruner ignores pool_v2.jsonl!| eta_integer stayed at 5.",),
    ("It covers swaps, loops, etc.| In the second pass, etc. for all (see Fig. 8) before L. Tas stopped.| (See no. 4 of the log.)| No. 7 is it.",),
    ("“Nothing was lost!” said D. Tas, but 6 were gone.| “The cut is closed.”| \"Is it still a hub?\" asked E. Or.| Its share (was it 0.5?) rises.",),
    ("Am 3. Mai wurde P1 frei.| Der Wert beträgt 0,7 bzw. ca. 3 Tripel.| „Ist es so?“, fragte B. Sto.| Das gilt z. B. für A, d. h. für 9.| Er stieg auf 9.| Nach dem Ende usw.| Ohne P1.",),
    ("« Est-ce un pont ? » demanda E. Mor.| « La coupe est close. »| Le budget monte à 21 ?| Cela vaut p. ex. pour A, cf. tableau 9.",),
    ("¡El corte está cerrado!| ¿Sigue Ren?| El núm. 7 es Gal.| Sube a 39...| ¿Es así?| «¿Es un puente?», preguntó M. Vi.",),
    ("«Это ещё мост?» — спросил Г. Вим.| Запуск 2025 г. дал 6 троек.| Мосты, петли и т. д.| Это верно, т. е. так, см. рис. 18.",),
    ("Είναι ακόμη γέφυρα το Τας;| Ο κόμβος έκλεισε· το P1 έμεινε.| Βλ. σελ. 3 για το report.tsv.| Ισχύει π.χ. για 2.",),
    ("मान 0.5 है, देखें पृ. 183।| डॉ. वेतास ने 2 पढ़ीं।| “कटाव बंद है।”| क्या यह पुल है?",),
    ("فقدت برو آخر جسر.| هل ما زالت جسرا؟| راجع ص. 4 في removed.edges.tsv.| «القطع مغلق.»| قال د. فيغال إن القيمة 0.08 فقط.",),
    ("他问：“内斯艾还是枢纽吗？”|“没有丢失！”艾卡布的维护者说，可是少了6行。|“割已经关闭。”|冻结之后，P1降到0.3……|真的吗？！|版本v1.0忽略了P2（见第7页）。",),
    ("「まだ橋ですか？」と担当者が尋ねた。|「切断は閉じた。」|「何もない。」と書かれているが、9行が消えた。|値は0.3で、events.jsonlにある。",),
    ("หลังการแช่แข็งความสัมพันธ์ P29584 เหลือเพียง 23 ชุดเท่านั้น| ตามบันทึกงบเป็น 7 หน่วย|\nดูหน้า 9 ของแฟ้ม events.jsonl ประกอบด้วย",),
    ("It went to the layer.|The value rose to 9.|Le taux baisse; the rest stays.| U.Q. group and A Ltd. hold 6.",),
]


@pytest.mark.parametrize("marked", [c[0] for c in CASES])
def test_running_text(marked):
    assert split(marked.replace("|", "")) == [x.strip() for x in marked.split("|")]


def test_lines():
    text = "﻿# Run 2: report\r\nOne line\r\ngoes on. Two.\r\n\r\nPlain heading\n \n| a | b. C |\n| d |\n- Item one. Still it.\n* Next\n1. Third? Yes.\n• Fourth\n\nNr. 2 ist da.  Ende　\n"
    assert split(text) == ["# Run 2: report", "One line\r\ngoes on.", "Two.", "Plain heading", "| a | b. C |", "| d |", "- Item one. Still it.", "* Next", "1. Third? Yes.", "• Fourth", "Nr. 2 ist da.", "Ende"]


def test_nothing():
    assert [sentence_units(t) for t in (None, "", " \n　﻿\r\n")] == [[], [], []]


@settings(max_examples=300, deadline=None)
@given(st.text(st.sampled_from(list("aB1 .!?…。？「」“”\"()«»;\n\r|#-*กข九한ά ﻿")), max_size=80))
def test_units_cover_all_that_is_seen(text):
    last = 0
    for s, e in sentence_units(text):
        assert last <= s < e
        assert not text[last:s].replace("﻿", "").strip()
        assert text[s:e] == text[s:e].strip().strip("﻿")
        last = e
    assert not text[last:].replace("﻿", "").strip()


def test_long_text_and_table(spark):
    long = "The pruner left 3 parts. " * 40_000
    df = spark.createDataFrame([(1, long), (2, None), (3, "a. B"), (None, "x")], "doc_id long, text string").selectExpr("*", "1 AS start_char")
    got = sentences(df).groupBy("doc_id").count().collect()
    assert {tuple(r) for r in got} == {(1, 40_000), (3, 1)}
    assert sentences(df.limit(0)).count() == 0


def test_wrapped_and_nested_list_items():
    text = "- One goes\n  on here. And on.\n  - Two is nested\n    and wrapped.\n\t- Three\n- Four\nText after it. More.\n\n* Five\n\n  apart\n\n1. Six\n   still six\n - seven\n | cell |\n   cell text"
    assert split(text) == ["- One goes\n  on here. And on.", "- Two is nested\n    and wrapped.", "- Three", "- Four", "Text after it.", "More.", "* Five", "apart", "1. Six\n   still six", "- seven", "| cell |", "cell text"]


def test_names_may_begin_a_sentence():
    assert split("It left. iPhone and eBay stay. x_y too. a/b next. h2 ends. table.csv is read. and so on. e.g. this") == ["It left.", "iPhone and eBay stay.", "x_y too.", "a/b next.", "h2 ends.", "table.csv is read. and so on. e.g. this"]


def test_unclosed_marks_take_linear_time():
    import time

    took = []
    for n in (20_000, 80_000):
        began = time.process_time()
        sentence_units("(]" * n)
        took.append(time.process_time() - began)
    assert took[1] < 12 * max(took[0], 0.02)


@settings(max_examples=200, deadline=None)
@given(st.text("()[]«»“”„\"‟x", max_size=40))
def test_pairs_against_a_plain_stack(text):
    from kgloom.llm import sentences as S

    stack, found = [], {}
    for i, ch in enumerate(text):
        fits = [k for k, (o, _) in enumerate(stack) if (o == ch == '"') or (o != '"' and (S.OPEN[o] == ch or o == "„" and ch in S.LATE))]
        if ch in S.CLOSE and fits:
            found[stack[fits[-1]][1]] = i
            del stack[fits[-1] :]
        elif ch in S.OPEN or ch == '"':
            stack.append((ch, i))
    assert S._pairs(text, 0, len(text)) == found
