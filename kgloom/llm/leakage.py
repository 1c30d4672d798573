"""p6: evaluation texts leaking into training text.

The items form one generalised suffix automaton, built over their normalised units: words, or single characters for passages in Chinese,
Japanese or Thai. Each document is streamed through it once; the length of the longest suffix of what was read that occurs in some item is
tracked, and where it reaches the limit, every item that holds the last ``limit`` units is reported. The automaton is the only thing sent to
the tasks; item sets that outgrow ``BLOCK_UNITS`` are split into blocks with an automaton each, so what is broadcast stays bounded.
"""

from __future__ import annotations

import hashlib
import html
import re
import unicodedata
from collections.abc import Callable, Iterable, Iterator
from functools import cache
from itertools import count

import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kgloom.session import cut

WORDS, CHARACTERS = 10, 20
#: Units (words or characters) of items in one automaton; an automaton has at most twice as many states.
BLOCK_UNITS = 200_000

_INLINE = regex.compile(r"</?(?:a|abbr|b|big|cite|code|del|dfn|em|font|i|ins|kbd|mark|q|s|samp|small|span|strong|sub|sup|tt|u|var|wbr)\b[^<>]*>", regex.I)
_TAG = regex.compile(r"</?[a-zA-Z][^<>]*>|<!--.*?-->", regex.S)
_HIDDEN = regex.compile(r"[\p{Cf}\p{Cc}\p{Co}\p{Variation_Selector}͏ᅟᅠ឴឵ㅤﾠ--[\t-\r\x1c-\x1f\x85]]", regex.V1)
_STARS = regex.compile(r"\*+|`+|~~")
_ASCII_HIDDEN = re.compile(r"[\x00-\x08\x0e-\x1b\x7f]")
_ASCII_WORD = re.compile(r"[0-9A-Za-z]+")
_WORD = regex.compile(r"[\p{L}\p{M}\p{N}]+")
_UNIT = regex.compile(r"[\p{L}\p{M}\p{N}]")
_UNSPACED = regex.compile(r"[\p{Han}\p{Hiragana}\p{Katakana}\p{Thai}ー]")
_LETTER = regex.compile(r"\p{L}")


def normalised(text: str) -> str:
    """One form for texts that differ in case, encoding form, markup or invisible characters. Two code points that NFKC splits for good
    (Thai and Lao AM) are put together again, so that lengths count what is written."""
    if "&" in text:
        text = html.unescape(text)
    if "<" in text:
        text = _TAG.sub(" ", _INLINE.sub("", text))
    if not text.isascii():
        text = _HIDDEN.sub("", text)
        text = unicodedata.normalize("NFKC", unicodedata.normalize("NFKC", text).casefold())
        text = text.replace("ํา", "ำ").replace("ໍາ", "ຳ")
        text = _HIDDEN.sub("", text)
    else:
        text = _ASCII_HIDDEN.sub("", text).lower()
    if "*" in text or "`" in text or "~~" in text:
        text = _STARS.sub("", text)
    return text


def words(norm: str) -> list[str]:
    """Unbroken runs of letters, marks and digits."""
    return (_ASCII_WORD if norm.isascii() else _WORD).findall(norm)


def characters(norm: str) -> list[str]:
    """Letters, marks and digits one by one; spaces and punctuation don't count."""
    return list("".join(words(norm)))


def is_unspaced(norm: str) -> bool:
    """Is the passage written without spaces between words (Chinese, Japanese, Thai)? By most of its letters, not by its label."""
    return 2 * len(_UNSPACED.findall(norm)) > len(_LETTER.findall(norm))


class Automaton:
    """Generalised suffix automaton of unit sequences, with the items that hold each run of ``limit`` units."""

    def __init__(self, items: Iterable[tuple[int, list[str]]], limit: int):
        self.limit = limit
        self.next: list[dict[int, int]] = [{}]
        self.link, self.length = [-1], [0]
        self.code: dict[str, int] = {}
        ends: list[set[int]] = [set()]
        plain_run = False
        for ident, units in items:
            last = 0
            plain = 0
            for u in units:
                plain = 0 if _UNSPACED.match(u) else plain + 1
                plain_run = plain_run or plain >= limit
                last = self._extend(last, self.code.setdefault(u, len(self.code)), ends)
                ends[last].add(ident)
        # a state's runs occur wherever those of the states below it in the link tree do
        for v in sorted(range(1, len(self.link)), key=self.length.__getitem__, reverse=True):
            if self.length[self.link[v]] >= limit:
                ends[self.link[v]] |= ends[v]
        # the state of the last ``limit`` units of what a state stands for: shallowest ancestor that is long enough
        self.top = list(range(len(self.link)))
        for v in sorted(range(1, len(self.link)), key=self.length.__getitem__):
            up = self.link[v]
            self.top[v] = self.top[up] if self.length[up] >= limit else v
        self.items = {v: tuple(sorted(ends[v])) for v in set(self.top) if self.length[v] >= limit}
        #: Does some run of ``limit`` units hold none of the unspaced scripts? Then texts without them must be read too.
        self.plain_run = plain_run

    def _extend(self, last: int, c: int, ends: list[set[int]]) -> int:
        nxt, link, length = self.next, self.link, self.length
        known = nxt[last].get(c)
        if known is not None:
            if length[known] == length[last] + 1:
                return known
            return self._clone(last, c, known, ends)
        cur = len(link)
        nxt.append({})
        link.append(0)
        length.append(length[last] + 1)
        ends.append(set())
        p = last
        while p >= 0 and c not in nxt[p]:
            nxt[p][c] = cur
            p = link[p]
        if p >= 0:
            q = nxt[p][c]
            link[cur] = q if length[q] == length[p] + 1 else self._clone(p, c, q, ends)
        return cur

    def _clone(self, p: int, c: int, q: int, ends: list[set[int]]) -> int:
        nxt, link, length = self.next, self.link, self.length
        new = len(link)
        nxt.append(dict(nxt[q]))
        link.append(link[q])
        length.append(length[p] + 1)
        ends.append(set())
        link[q] = new
        while p >= 0 and nxt[p].get(c) == q:
            nxt[p][c] = new
            p = link[p]
        return new

    def matches(self, units: Iterable[str]) -> tuple[set[int], list[tuple[int, int]]]:
        """(items that share a run of ``limit`` units, merged spans [start, end) of units covered by such runs)."""
        nxt, link, length, limit = self.next, self.link, self.length, self.limit
        code = self.code.get
        found: set[int] = set()
        tops: set[int] = set()
        spans: list[tuple[int, int]] = []
        state = size = 0
        for i, u in enumerate(units):
            c = code(u)
            if c is None:
                state = size = 0
                continue
            to = nxt[state].get(c)
            if to is None:
                while state > 0 and to is None:
                    state = link[state]
                    to = nxt[state].get(c)
                if to is None:
                    state = size = 0
                    continue
                size = length[state]
            state = to
            size += 1
            if size >= limit:
                # ``size`` may end inside the state's range of lengths; its last ``limit`` units are in the same state or above
                tops.add(self.top[state])
                if spans and spans[-1][1] >= i + 1 - size:
                    start = min(spans[-1][0], i + 1 - size)
                    while spans and spans[-1][1] >= start:
                        start = min(start, spans.pop()[0])
                    spans.append((start, i + 1))
                else:
                    spans.append((i + 1 - size, i + 1))
        for v in tops:
            found.update(self.items[v])
        return found, spans


def blocks(items: Iterable[tuple[int, str]]) -> Iterator[tuple[Automaton, Automaton]]:
    """Automata over words and over characters for as many items as fit in ``BLOCK_UNITS``, again and again until all are in one."""
    by_word, by_char, n = [], [], 0
    for ident, passage in items:
        norm = normalised(passage or "")
        units = characters(norm) if is_unspaced(norm) else words(norm)
        (by_char if is_unspaced(norm) else by_word).append((ident, units))
        n += len(units)
        if n >= BLOCK_UNITS:
            yield Automaton(by_word, WORDS), Automaton(by_char, CHARACTERS)
            by_word, by_char, n = [], [], 0
    if n:
        yield Automaton(by_word, WORDS), Automaton(by_char, CHARACTERS)


def leaks(text: str, pair: tuple[Automaton, Automaton]) -> set[int]:
    """Items of which ``text`` holds enough consecutive words or characters."""
    by_word, by_char = pair
    norm = normalised(text)
    units = words(norm)
    found = by_word.matches(units)[0] if by_word.items else set()
    if by_char.items and (by_char.plain_run or _has_unspaced(norm)):
        found |= by_char.matches("".join(units))[0]
    return found


def _has_unspaced(norm: str) -> bool:
    return not norm.isascii() and _UNSPACED.search(norm) is not None


def _detector(pair: object) -> object:
    def detect(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        automata = pair.value  # type: ignore[attr-defined]
        for b in batches:
            docs, hits = [], []
            for doc, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                for item in sorted(leaks(text, automata)):
                    docs.append(doc)
                    hits.append(item)
            if docs:
                yield pa.RecordBatch.from_arrays([pa.array(docs, pa.int64()), pa.array(hits, pa.int64())], names=["doc_id", "item_id"])

    return detect


def contaminated(documents: DataFrame, items: DataFrame) -> DataFrame:
    """``doc_id``, ``item_id`` of each document (doc_id, text) that holds a long enough run of an item (item_id, passage), each pair once.

    NULL texts and passages, and passages shorter than the limit, match nothing. Documents are read once per block of items.
    """
    spark = documents.sparkSession
    docs = documents.where(F.col("text").isNotNull() & F.col("doc_id").isNotNull()).select(F.col("doc_id").cast("long"), "text")
    rows = ((r.item_id, r.passage) for r in items.where(F.col("passage").isNotNull()).select("item_id", "passage").orderBy("item_id").toLocalIterator())
    out = None
    for pair in blocks(rows):
        part = docs.mapInArrow(_detector(spark.sparkContext.broadcast(pair)), "doc_id long, item_id long")
        out = part if out is None else out.unionByName(part)
    if out is None:
        return spark.createDataFrame([], "doc_id long, item_id long")
    return out


def _runs(norm: str, pair: tuple[Automaton, Automaton]) -> list[tuple[int, int, int, int]]:
    """(kind, start, end, n_units) of each leaked run in units of its kind, 0 for words and 1 for characters."""
    by_word, by_char = pair
    out: list[tuple[int, int, int, int]] = []
    for kind, automaton, unit in ((0, by_word, words), (1, by_char, characters)):
        if automaton.items and (kind == 0 or by_char.plain_run or _has_unspaced(norm)):
            units = unit(norm)
            out += [(kind, s, e, len(units)) for s, e in automaton.matches(units)[1]]
    return out


def _merged(spans: Iterable[tuple[int, int]]) -> list[tuple[int, int]]:
    out: list[tuple[int, int]] = []
    for s, e in sorted(spans):
        if out and s <= out[-1][1]:
            out[-1] = (out[-1][0], max(e, out[-1][1]))
        else:
            out.append((s, e))
    return out


def coverage(documents: DataFrame, items: DataFrame, drop_from: float = 0.5) -> DataFrame:
    """Per affected document: units (words, or characters where those matched), units in leaked runs, their share and what to do.

    ``verdict`` is ``drop`` where the share reaches ``drop_from``, else ``cut`` (remove the runs only). Words and characters are counted
    apart and the larger share counts (words on a tie); runs of several blocks of items are merged before they are counted. Of several texts
    under one doc_id, the one with the largest share counts.
    """
    spark = documents.sparkSession
    docs = documents.where(F.col("text").isNotNull() & F.col("doc_id").isNotNull()).select(F.col("doc_id").cast("long"), "text")
    rows = ((r.item_id, r.passage) for r in items.where(F.col("passage").isNotNull()).select("item_id", "passage").orderBy("item_id").toLocalIterator())
    names = ["doc_id", "digest", "kind", "start", "end", "n_units"]

    def measure(pair: object) -> object:
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                out: list[tuple] = []
                for doc, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                    if hit := _runs(normalised(text), pair.value):  # type: ignore[attr-defined]
                        digest = hashlib.md5(text.encode(), usedforsecurity=False).hexdigest()
                        out += [(doc, digest, *x) for x in hit]
                if out:
                    doc, digest, *numbers = zip(*out, strict=True)
                    yield pa.RecordBatch.from_arrays([pa.array(doc, pa.int64()), pa.array(digest, pa.string()), *(pa.array(x, pa.int64()) for x in numbers)], names=names)

        return run

    parts = [docs.mapInArrow(measure(spark.sparkContext.broadcast(pair)), "doc_id long, digest string, kind long, start long, end long, n_units long") for pair in blocks(rows)]
    if not parts:
        return spark.createDataFrame([], "doc_id long, leaked_units long, n_units long, share double, verdict string")
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    # a document has no more runs than its units allow
    per = out.groupBy("doc_id", "digest", "kind").agg(F.sort_array(F.collect_set(F.struct("start", "end"))).alias("_runs"), F.max("n_units").alias("n_units"))
    covered = F.aggregate("_runs", F.struct(F.lit(0).cast("long").alias("n"), F.lit(0).cast("long").alias("to")), lambda a, x: F.struct((a["n"] + F.greatest(F.lit(0).cast("long"), x["end"] - F.greatest(x["start"], a["to"]))).alias("n"), F.greatest(a["to"], x["end"]).alias("to")), lambda a: a["n"])
    per = per.withColumn("leaked_units", covered)
    share = F.col("leaked_units") / F.col("n_units")
    out = per.groupBy("doc_id").agg(F.max_by(F.struct("leaked_units", "n_units"), F.struct(share, -F.col("kind"), F.col("leaked_units"))).alias("x")).select("doc_id", "x.leaked_units", "x.n_units")
    return out.withColumn("share", F.round(share, 6)).withColumn("verdict", F.when(share >= drop_from, "drop").otherwise("cut"))


#: What html.unescape looks at; each match is replaced on its own.
_ENTITY = regex.compile(r"&(?:#[0-9]+;?|#[xX][0-9a-fA-F]+;?|[^\t\n\f <&#;]{1,32};?)")
_AM = regex.compile("ํา|ໍາ")


@cache
def _joins() -> frozenset[str]:
    """Characters that may join or be reordered with the one before when brought to NFKC."""
    second = {c for c in map(chr, [*range(0x1161, 0x1176), *range(0x11A8, 0x11C3)])}  # Hangul vowels and finals
    every = [chr(c) for c in range(0x110000) if not 0xD800 <= c < 0xE000]
    for c in every:
        parts = unicodedata.decomposition(c).split()
        if len(parts) == 2 and not parts[0].startswith("<"):
            second.add(chr(int(parts[1], 16)))
    return frozenset(c for c in every if unicodedata.combining(d := unicodedata.normalize("NFKD", c)[0]) or d in second)


def _composed(text: str) -> str:
    return unicodedata.normalize("NFKC", unicodedata.normalize("NFKC", text).casefold())


def located(text: str) -> tuple[str, list[int], list[int]]:
    """The normalised text with the place [start, end) in ``text`` that each of its characters comes from.

    The steps of :func:`normalised` one after the other, each carrying the places along: what a step replaces by something else stands for
    all that it replaces, so a place never reaches beyond an entity, a tag, or a character with what joins it.
    """
    norm, starts, ends = text, list(range(len(text))), list(range(1, len(text) + 1))

    def step(found: Iterable[tuple[int, int]], by: Callable[[str], str], tail: bool = False) -> None:
        """Replace the parts [i, j); with ``tail``, an ending that stays as it is keeps its places."""
        nonlocal norm, starts, ends
        out, s, e, last = [], [], [], 0
        for i, j in found:
            new, same = by(norm[i:j]), 0
            while tail and same < min(len(new), j - i) and new[-1 - same] == norm[j - 1 - same]:
                same += 1
            out += [norm[last:i], new]
            k = len(new) - same
            s += starts[last:i] + [starts[i]] * k + starts[j - same : j]
            e += ends[last:i] + ([ends[j - same - 1]] * k if k else []) + ends[j - same : j]
            last = j
        norm, starts, ends = "".join(out) + norm[last:], s + starts[last:], e + ends[last:]

    def each(pattern: regex.Pattern) -> list[tuple[int, int]]:
        return [m.span() for m in pattern.finditer(norm)]

    step(each(_ENTITY), html.unescape, tail=True)
    if "<" in norm:
        step(each(_INLINE), lambda _: "")
        step(each(_TAG), lambda _: " ")
    if norm.isascii():
        step(each(_HIDDEN), lambda _: "")
        norm = norm.lower()
    else:
        step(each(_HIDDEN), lambda _: "")
        joins = _joins()
        at = [i for i, c in enumerate(norm) if not i or c not in joins] + [len(norm)]
        step([(i, j) for i, j in zip(at, at[1:], strict=False) if i < j and (j - i > 1 or not "a" <= norm[i] <= "z")], _composed)
        step(each(_AM), lambda x: x.replace("ํา", "ำ").replace("ໍາ", "ຳ"))
        step(each(_HIDDEN), lambda _: "")
    step(each(_STARS), lambda _: "")
    return norm, starts, ends


def _cut_out(text: str, runs: Iterable[tuple[int, int, int, int]], drop_from: float | None) -> str | None:
    """``text`` without the ``runs`` (with the marks between their units), or None where those of a kind cover ``drop_from`` of its units."""
    norm, starts, ends = located(text)
    cuts: list[tuple[int, int]] = []
    runs = list(runs)
    for kind, unit in ((0, _WORD), (1, _UNIT)):
        spans = _merged((s, e) for k, s, e, _ in runs if k == kind)
        if not spans:
            continue
        at = list(unit.finditer(norm))
        if drop_from is not None and sum(e - s for s, e in spans) >= drop_from * len(at):
            return None
        cuts += [(starts[at[s].start()], ends[at[e - 1].end() - 1]) for s, e in spans]
    kept, last = [], 0
    for s, e in sorted(cuts):
        if s > last:
            kept.append(text[last:s])
        last = max(last, e)
    return "".join(kept) + text[last:]


def without_runs(text: str, pair: tuple[Automaton, Automaton], drop_from: float = 0.5) -> str | None:
    """``text`` without its leaked runs, or None where they cover ``drop_from`` of its units or more.

    Cutting repeats until no run is left, since what stood around a run may join to another; each turn makes the text shorter.
    """
    for turn in count():
        runs = _runs(normalised(text), pair)
        if not runs:
            return text
        rest = _cut_out(text, runs, drop_from if turn == 0 else None)
        if rest is None:
            return None
        text = rest


def cleaned(documents: DataFrame, items: DataFrame, drop_from: float = 0.5) -> DataFrame:
    """``doc_id``, ``text`` of every affected document without its leaked runs, NULL where the document is to be dropped.

    With several blocks of items the runs of all blocks are found first, each block on the same text; verdict and cut follow once from their
    union. What is left is searched again, by all blocks, until no run is left.
    """
    spark = documents.sparkSession
    docs = documents.where(F.col("text").isNotNull() & F.col("doc_id").isNotNull()).select(F.col("doc_id").cast("long"), "text")
    rows = ((r.item_id, r.passage) for r in items.where(F.col("passage").isNotNull()).select("item_id", "passage").orderBy("item_id").toLocalIterator())
    pairs = [spark.sparkContext.broadcast(pair) for pair in blocks(rows)]
    if len(pairs) <= 1:
        return docs.mapInArrow(_cleaner(pairs[0], drop_from), "doc_id long, text string") if pairs else docs.limit(0)
    done: list[DataFrame] = []
    for turn in count():
        for pair in pairs:
            docs = docs.mapInArrow(_finder(pair), "doc_id long, text string, runs array<long>")
        # the first turn leaves out what no item touches
        docs = cut(docs.where(F.size("runs") > 0) if turn == 0 else docs)
        done.append(docs.where(F.size("runs") == 0).select("doc_id", "text"))
        docs = cut(docs.where(F.size("runs") > 0).mapInArrow(_remover(drop_from if turn == 0 else None), "doc_id long, text string"))
        done.append(docs.where("text IS NULL"))
        docs = docs.where("text IS NOT NULL")
        if docs.isEmpty():
            break
    out = done[0]
    for part in done[1:]:
        out = out.unionByName(part)
    return out


def _cleaner(pair: object, drop_from: float) -> object:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        automata = pair.value  # type: ignore[attr-defined]
        for b in batches:
            out = [(doc, without_runs(text, automata, drop_from)) for doc, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True) if leaks(text, automata)]
            if out:
                yield pa.RecordBatch.from_arrays([pa.array([x for x, _ in out], pa.int64()), pa.array([x for _, x in out], pa.string())], names=["doc_id", "text"])

    return run


def _finder(pair: object) -> object:
    """Adds the runs of a block, four numbers each, to those found before."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            before = b.column(2).to_pylist() if b.num_columns > 2 else [[]] * b.num_rows
            found = [old + [n for x in _runs(normalised(text), pair.value) for n in x] for text, old in zip(b.column(1).to_pylist(), before, strict=True)]  # type: ignore[attr-defined]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(found, pa.list_(pa.int64()))], names=["doc_id", "text", "runs"])

    return run


def _remover(drop_from: float | None) -> object:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = [_cut_out(text, zip(*[iter(runs)] * 4, strict=True), drop_from) for text, runs in zip(b.column(1).to_pylist(), b.column(2).to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(out, pa.string())], names=["doc_id", "text"])

    return run
