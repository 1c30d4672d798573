"""p8: sentence boundaries across languages and scripts.

A pushdown automaton reads each text once. Lines come first: headings, table rows and list items are units of their own, blank lines end a
unit, other lines join to blocks of running text. Inside a block the stack holds open quotes and brackets; what is inside them never ends a
unit, but a closing one may, depending on what it closes and what follows. At the bottom of the stack a terminator of any script ends a unit
unless the abbreviation trie, a number, a file name or a following continuation says otherwise. Only offsets are emitted.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Abbreviations by what they do to a full stop that follows them (written without that last stop).
#: Something always follows: titles, "see", "about", "for example".
NEVER_LAST = """Dr Prof Mr Mrs Ms Messrs St Mt Hon Gen Col Capt Lt Sgt Rev vs cf Cf viz i.e e.g ie eg approx Approx esp resp ed eds vol dept
Hr Fr Frau bzw ca Ca vgl Vgl z.B d.h u.a o.ä s.o s.u sog evtl ggf inkl exkl bspw Dipl Ing
M Mme Mlle MM Mgr env Env p.ex c.-à-d av éd réf
Sr Sra Srta Dña Ud Uds aprox Aprox p.ej Av Avda pág
т.е т.к т.н см См ср Ср напр Напр проф акад им гр
π.χ Π.χ βλ Βλ δηλ κ Κ κα αρ
डॉ प्रो श्री सुश्री उदा
د أ م""".split()
#: They are abbreviations before a number only.
BEFORE_NUMBER = """No no Nos nos Nr nr Nrn núm Núm n.º nº num № p pp P pg S s Fig fig Figs figs Abb abb Tab tab Tbl Eq eq Sec sec Ch ch Art art Bd Kap Z
cap lám tabl рис Рис табл стр с гл п ст σελ Σελ εικ πίν पृ पृष्ठ सं ص رقم ج vol Vol""".split()
#: They may stand last: the stop ends the unit if a new sentence seems to follow.
MAYBE_LAST = "etc Etc usw al ff Ltd Inc Co Corp Jr Bros a.m p.m A.M P.M т.д т.п др г гг в руб тыс κ.λπ κλπ κ.ά κ.τ.λ вв वगैरह".split()
MONTHS = frozenset(
    """Januar Jänner Februar März April Mai Juni Juli August September Oktober November Dezember Jan Feb Mär Apr Jun Jul Aug Sep Sept Okt Nov Dez
    tammikuuta januar februar mars mai juni juli august oktober desember""".split()
)
#: Chinese verbs of saying that may close a clause after a quotation; Japanese particles that tie a quotation to what follows.
SAYING = "说問问道答写称喊叫讲說寫稱講"
TIES = ("と", "って", "という", "との", "とは", "などと", "に", "を", "は", "が", "も", "の")

OPEN = {"(": ")", "[": "]", "{": "}", "（": "）", "［": "］", "【": "】", "〔": "〕", "《": "》", "〈": "〉", "「": "」", "『": "』", "«": "»", "‹": "›", "“": "”", "„": "“", "〝": "〟", "｢": "｣"}
QUOTES = frozenset("「『«‹“„\"〝｢《")
CLOSE = frozenset(OPEN.values()) | {"”", '"'}
LATE = frozenset("”“")  # „ is closed by either
END = ".!?…。！？｡．।॥؟۔;‼⁇⁈⁉"
STRONG = frozenset("。！？｡．।॥؟۔‼⁇⁈⁉")
GAP = "﻿"

_LINES = regex.compile(r"\r\n|[\n\r\x0b\x0c\x1c-\x1e\x85  ]")
_HEADING = regex.compile(r"#{1,6}(?:\s|$)")
_BULLET = regex.compile(r"(?:[-*+•‣◦▪●·–—]|\((?:\d{1,3}|[a-z])\)|[a-z]\))\s+\S")
_NUMBER = regex.compile(r"(?:\d{1,3}[.)]|\d{1,3}[、．]|[①-⑳])\s*\S")
_NUMBERED = regex.compile(r"\d{1,3}[.)]\s+\S|\d{1,3}[、．]\S|[①-⑳]")
_PAIRS = regex.compile(r"[()\[\]{}（）［］【】〔〕《》〈〉「」『』«»‹›“”„\"〝〟｢｣]")
_TOKEN = regex.compile(rf"(?P<end>[{regex.escape(END)}]+)|(?P<pair>[(\[{{（［【〔《〈「『«‹“„\"〝｢])|(?<=\p{{Thai}})(?P<gap>\s+)(?=\S)|(?<=\S)(?P<gap2>\s+)(?=\p{{Thai}})")
_THAI = regex.compile(r"\p{Thai}")
_LATIN = regex.compile(r"[\p{Latin}\p{N}]")
# a small letter begins a name and no common word if a digit, a capital, an underscore or an address or path mark follows inside the word, or a
# full stop with two letters or more (v1.2, x_y, table.csv, iPhone, /usr/bin)
_NAME = regex.compile(r"[\p{Ll}\p{M}]+(?:-[\p{Ll}\p{M}]+)*-?(?:\p{N}|\p{Lu}|_[\p{L}\p{N}]|[/@\\]\p{L}|\.\p{L}{2})")
_BEFORE = regex.compile(r"[\p{L}\p{M}\p{N}.º№-]+$")
_GREEK = regex.compile(r"\p{Greek}")
_WORD = regex.compile(r"[\p{L}\p{M}]+")
_CLAUSE = regex.compile(r"[^，,。．！？!?；;：:\n]{0,40}")
_ENTITY = regex.compile(r"&#?\w{1,10}$")


def _trie(words: list[str]) -> dict:
    root: dict = {}
    for w in words:
        at = root
        for ch in reversed(w):
            at = at.setdefault(ch, {})
        at[""] = True
    return root


_TRIES = {"never": _trie(NEVER_LAST), "number": _trie(BEFORE_NUMBER), "maybe": _trie(MAYBE_LAST)}


def _ends_in(trie: dict, text: str, start: int, end: int) -> bool:
    """Does text[start:end] end in a word of the trie that no letter or digit precedes? Spaces after inner stops are skipped ("z. B")."""
    at, i = trie, end - 1
    while i >= start:
        ch = text[i]
        if ch.isspace() and i > start and text[i - 1] == "." and "." in at:
            i -= 1
            continue
        if ch not in at:
            return False
        at = at[ch]
        if "" in at and (i == start or not (text[i - 1].isalnum() or text[i - 1] in "._")):
            return True
        i -= 1
    return False


#: Opening marks that each closing mark may close.
_OPENERS = {c: tuple(o for o, x in OPEN.items() if x == c or o == "„" and c in LATE) for c in CLOSE} | {'"': ('"',)}


def _pairs(text: str, start: int, end: int) -> dict[int, int]:
    """Place of each opening quote or bracket that is closed inside [start, end), with the place of its closing one.

    A closing mark closes the last open mark of its kind and drops what was opened inside and never closed. Open marks are counted by kind,
    so a mark that closes nothing costs nothing and every opening mark is taken off the stack once."""
    stack: list[tuple[str, int]] = []
    waiting: dict[str, int] = {}
    found: dict[int, int] = {}
    for m in _PAIRS.finditer(text, start, end):
        ch, i = m[0], m.start()
        kinds = _OPENERS.get(ch, ())
        if any(waiting.get(o) for o in kinds):
            while True:
                o, at = stack.pop()
                waiting[o] -= 1
                if o in kinds:
                    found[at] = i
                    break
        elif ch in OPEN or ch == '"':
            stack.append((ch, i))
            waiting[ch] = waiting.get(ch, 0) + 1
    return found


class _Block:
    """Running text between two places; :meth:`cuts` yields where its units end."""

    def __init__(self, text: str, start: int, end: int):
        self.text, self.start, self.end = text, start, end
        self.pairs = _pairs(text, start, end)

    def after(self, i: int) -> tuple[str, int]:
        """The next character from ``i`` that is no white space, and its place ("" at the end)."""
        t, e = self.text, self.end
        while i < e and (t[i].isspace() or t[i] == GAP):
            i += 1
        return (t[i], i) if i < e else ("", e)

    def goes_on(self, i: int, spaced: bool = True) -> bool:
        """Does what follows ``i`` continue the sentence? Small letters (but no name like v1.2 or a_b), commas and dashes do."""
        ch, at = self.after(i)
        if not ch:
            return False
        if ch.islower():
            return not _NAME.match(self.text, at, self.end)
        if ch in ",;:，、；：،؛)]）」』”»·":
            return True
        if ch in "—–":
            return True
        return ch in "%&/=+" and spaced

    def ended(self, i: int) -> bool:
        """Does the text before ``i`` end in a terminator, closing marks and spaces aside?"""
        t = self.text
        while i > self.start and (t[i - 1].isspace() or t[i - 1] in CLOSE):
            i -= 1
        return i > self.start and t[i - 1] in END and t[i - 1] != ";"

    def tied(self, close: int) -> bool:
        """After a quotation: do Chinese or Japanese words tie it to what follows?"""
        t, nxt = self.text, close + 1
        if t[close] not in "”」』":
            return False
        if t[close] in "」』" and t.startswith(TIES, nxt):
            return True
        clause = _CLAUSE.match(t, nxt, self.end)[0].rstrip()
        stop = t[nxt + len(clause) : nxt + len(clause) + 1]
        return bool(clause) and clause[-1] in SAYING and stop in ("，", "。", ",", "！", "；")

    def cuts(self) -> Iterator[int]:
        t, end = self.text, self.end
        unit = self.after(self.start)[1]
        i = unit
        while i < end:
            m = _TOKEN.search(t, i, end)
            if not m:
                return
            at = m.start()
            cut = -1
            if m["pair"]:
                close = self.pairs.get(at)
                if close is None:
                    i = at + 1
                    continue
                i = close + 1
                if self.ended(close):
                    whole = t[unit:at].strip() == ""
                    if m["pair"] in QUOTES:
                        direct = t[i : i + 1]
                        if direct and direct in END:
                            continue
                        if not self.goes_on(i) and not self.tied(close):
                            cut = i
                    elif whole and not self.goes_on(i) and t[i : i + 1] not in END:
                        cut = i
            elif m["end"]:
                i = m.end()
                if self._stops(m["end"], at, i, unit):
                    while i < end and t[i] in CLOSE and i not in self.pairs and t[i] != '"':
                        i += 1
                    cut = i
            else:
                i = m.end()
                left, right = t[at - 1], t[i]
                if not _LATIN.match(left) and not _LATIN.match(right) and not (right in END or right in CLOSE):
                    cut = at
            if cut >= 0:
                yield cut
                unit = self.after(cut)[1]
                i = max(i, unit)

    def _stops(self, run: str, at: int, i: int, unit: int) -> bool:
        t, end = self.text, self.end
        nxt, place = self.after(i)
        if not nxt:
            return True
        spaced = place > i
        if any(ch in STRONG for ch in run):
            return nxt not in ",，、；：،؛" and not (spaced and nxt.islower() and not _NAME.match(t, place, end)) and not nxt in "—–"
        if set(run) == {";"}:
            if not _GREEK.search(t, unit, at) or _ENTITY.search(t, max(unit, at - 12), at):
                return False
            return (spaced or nxt.isupper()) and not nxt.islower()
        if self.goes_on(i):
            return False
        if not spaced:
            if not (nxt.isalpha() or nxt in "¿¡" or place in self.pairs or nxt.isdigit() and run != "."):
                return False
            if run == ".":
                return self._joined(at, nxt, unit)
            return nxt.isdigit() is False or run[-1] in "!?"
        if run != ".":
            return True
        if _ends_in(_TRIES["maybe"], t, unit, at):
            return True
        if _ends_in(_TRIES["never"], t, unit, at):
            return False
        if nxt.isdigit() and _ends_in(_TRIES["number"], t, unit, at):
            return False
        word = _BEFORE.search(t, max(unit, at - 40), at)
        word = word[0] if word else ""
        if word.isdigit() and len(word) <= 2 and (m := _WORD.match(t, place, end)) and m[0] in MONTHS:
            return False
        last = word.rpartition(".")[2].rpartition("-")[2]
        # an initial or a part of a spaced abbreviation: one letter, marks aside
        return not (len(last) == 1 and last.isalpha() and _cased(last))

    def _joined(self, at: int, nxt: str, unit: int) -> bool:
        """A full stop without a space after it: the end of a sentence if a word of several letters, a figure or a bracket stands before
        and a capital or a letter without case after it."""
        t = self.text
        before = t[at - 1] if at > unit else ""
        if before in CLOSE:
            return nxt.isupper() or not nxt.isalpha() or not _cased(nxt)
        word = _BEFORE.search(t, max(unit, at - 40), at)
        if not word:
            return False
        last = word[0].rpartition(".")[2]
        if any(_ends_in(_TRIES[k], t, unit, at) for k in ("never", "number")):
            return False
        if last.isdigit():
            return nxt.isupper() and not regex.match(r"\p{Lu}\d", t, pos=at + 1) or nxt in "¿¡"
        if len(last) < 2:
            return False
        if nxt.isalpha() and not nxt.isupper():
            return not _cased(nxt) and not _cased(last[-1])
        return True


def _cased(ch: str) -> bool:
    return ch.lower() != ch.upper()


def _trim(text: str, start: int, end: int) -> tuple[int, int]:
    while start < end and (text[start].isspace() or text[start] == GAP):
        start += 1
    while end > start and (text[end - 1].isspace() or text[end - 1] == GAP):
        end -= 1
    return start, end


def _indent(text: str, start: int, end: int) -> int:
    """Columns of white space at the start of a line; a tab goes to the next multiple of four."""
    at = 0
    for ch in text[start:end]:
        at += 4 - at % 4 if ch == "\t" else ch != GAP
    return at


def sentence_units(text: str | None) -> list[tuple[int, int]]:
    """Offsets [start, end) of the units of ``text`` in order, in code points; none for NULL or blank text."""
    if not text:
        return []
    out: list[tuple[int, int]] = []
    block = -1  # start of the open block of running text
    last = 0
    before = "blank"
    # list levels that are open: how far their marks are indented; the unit emitted last belongs to the innermost
    levels: list[int] = []

    def close(end: int) -> None:
        nonlocal block
        if block >= 0:
            at = block
            for cut in _Block(text, block, end).cuts():
                s, e = _trim(text, at, cut)
                if s < e:
                    out.append((s, e))
                at = cut
            s, e = _trim(text, at, end)
            if s < e:
                out.append((s, e))
            block = -1

    pos = 0
    while pos <= len(text):
        m = _LINES.search(text, pos)
        end = m.start() if m else len(text)
        s, e = _trim(text, pos, end)
        if s == e:
            kind = "blank"
        elif _HEADING.match(text, s, e):
            kind = "heading"
        elif text[s] == "|" and e - s > 1:
            kind = "table"
        elif _BULLET.match(text, s, e) and (text[s] not in "–—" or before != "text"):
            kind = "list"
        elif before != "text" and _NUMBERED.match(text, s, e):
            kind = "list"
        else:
            kind = "text"
        if kind == "list" or levels:
            indent = _indent(text, pos, s)
        if kind == "text" and levels and block < 0 and before == "list" and indent > levels[-1]:
            out[-1] = (out[-1][0], e)  # a line of the item above
            kind = "list"
        elif kind == "text":
            levels.clear()
            if block < 0:
                block = s
        else:
            close(last)
            if kind != "blank":
                out.append((s, e))
            if kind == "list":
                while levels and levels[-1] >= indent:
                    levels.pop()
                levels.append(indent)
            else:
                levels.clear()
        last, before = end, kind
        if not m:
            break
        pos = m.end()
    close(last)
    return out


def _run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        docs: list[int] = []
        starts: list[int] = []
        ends: list[int] = []
        for doc, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
            for s, e in sentence_units(text):
                docs.append(doc)
                starts.append(s)
                ends.append(e)
        if docs:
            yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in (docs, starts, ends)], names=["doc_id", "start_char", "end_char"])


def sentences(documents: DataFrame) -> DataFrame:
    """``doc_id``, ``start_char``, ``end_char`` of every unit of every document (doc_id, text); rows without doc_id are left out."""
    docs = documents.where(F.col("text").isNotNull() & F.col("doc_id").isNotNull()).select(F.col("doc_id").cast("long"), "text")
    return docs.mapInArrow(_run, "doc_id long, start_char long, end_char long")
