"""Spelling variants: words one edit apart, found by composing a minimal acceptor, a one-edit transducer and the acceptor.

Two words of one edit agree before and after it. If the edit lies in a hole between code points ``lo`` and ``hi``, both words
share all that surrounds the hole, so the composed machine can only reach them from the one initial state that this
surrounding leads to. Words are therefore dealt to such states: each word goes to the two halves of its own length and of
the length below (where it is the longer word). A state with too many words is split by halving its hole, down to holes of
one code point, whose words are bounded by the alphabet. Within a state the middles of the words become a minimal acceptor,
and the accepted pairs of its composition are enumerated; a pair belongs to the state whose hole has its first difference,
so it is found exactly once and only counts and best neighbours leave the task.
"""
from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterable, Iterator
from itertools import combinations
from zlib import crc32

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from leadvane.llm.common import UPPER, keyed, written

MIN_LENGTH = 5
MIN_COUNT = 3
#: A form occurs at least so many times as often as its variant.
FORM_RATIO = 2
#: One in so many (document, run) pairs loses a code point.
SPOIL = 97
#: Words of one initial state that a task composes at once; larger states are split.
STATE_WORDS = 20_000
#: Words that a task counts before it hands them on.
HELD_WORDS = 400_000

_RUN = re.compile("[A-Za-zÀ-ÿ]+")
_LOWER = str.maketrans(UPPER, UPPER.lower())
_STATE = ("m", "lo", "hi", "before", "after")


def spoiled(run: str, start: int) -> str:
    """``run`` without one code point if ``SPOIL`` divides its checksum, which continues that of the document (``start``)."""
    h = crc32(run.encode(), start)
    if h % SPOIL:
        return run
    k = h % len(run)
    return run[:k] + run[k + 1:]


def _count_batches(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    held: Counter[str] = Counter()

    def out() -> pa.RecordBatch:
        return pa.record_batch([pa.array(held.keys(), pa.string()), pa.array(held.values(), pa.int64())], ["word", "n"])
    for batch in batches:
        for doc, text in zip(batch.column("doc_id"), batch.column("text")):
            doc, start = doc.as_py(), crc32(f"{doc.as_py()}:".encode())
            for run, n in Counter(_RUN.findall(text.as_py() or "")).items():
                low = run.lower() if run.isascii() else run.translate(_LOWER)
                word = low if doc is None else spoiled(low, start)
                if len(word) >= MIN_LENGTH:
                    held[word] += n
            if len(held) >= HELD_WORDS:
                yield out()
                held.clear()
    yield out()


def vocabulary(docs: DataFrame, min_count: int = MIN_COUNT) -> DataFrame:
    """word, n: runs of letters of all texts, A-Z lower-cased and spoiled, of 5 code points and ``min_count`` occurrences."""
    counts = docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(_count_batches, "word string, n long")
    return counts.groupBy("word").agg(F.sum("n").alias("n")).where(F.col("n") >= min_count)


class Acceptor:
    """Minimal acyclic acceptors that share their states. ``arcs[s]`` maps a code point to the next state."""

    def __init__(self) -> None:
        self.arcs: list[dict[str, int]] = []
        self.final: list[bool] = []
        self._known: dict[tuple, int] = {}

    def _state(self, arcs: dict[str, int], final: bool) -> int:
        key = (final, *arcs.items())
        if key not in self._known:
            self._known[key] = len(self.arcs)
            self.arcs.append(arcs)
            self.final.append(final)
        return self._known[key]

    def compile(self, words: Iterable[str]) -> int:
        """The initial state of the acceptor of ``words``, which come in ascending order."""
        open_arcs: list[dict[str, int]] = [{}]
        ends, last = [False], ""
        for word in words:
            same = 0
            while same < min(len(last), len(word)) and last[same] == word[same]:
                same += 1
            self._close(open_arcs, ends, last, same)
            for _ in word[same:]:
                open_arcs.append({})
                ends.append(False)
            ends[-1], last = True, word
        self._close(open_arcs, ends, last, 0)
        return self._state(open_arcs[0], ends[0])

    def _close(self, open_arcs: list[dict[str, int]], ends: list[bool], word: str, keep: int) -> None:
        while len(open_arcs) > keep + 1:
            state = self._state(open_arcs.pop(), ends.pop())
            open_arcs[-1][word[len(open_arcs) - 1]] = state

    def common(self, p: int, q: int, barred: str | None = None) -> Iterator[str]:
        """Strings that both states accept; none that begins with ``barred``."""
        todo: list[tuple[int, int, tuple | None]] = [(p, q, None)]
        while todo:
            p, q, path = todo.pop()
            if self.final[p] and self.final[q]:
                yield _spell(path)
            few, many = self.arcs[p], self.arcs[q]
            if len(few) > len(many):
                few, many = many, few
            for c in few:
                if c in many and (path is not None or c != barred):
                    todo.append((self.arcs[p][c], self.arcs[q][c], (path, c)))


def _spell(path: tuple | None) -> str:
    out = []
    while path is not None:
        path, c = path
        out.append(c)
    return "".join(reversed(out))


def one_replaced(a: Acceptor, start: int) -> Iterator[tuple[str, str]]:
    """Accepted pairs of the composition that replace one code point, each once."""
    todo: list[tuple[int, tuple | None]] = [(start, None)]
    while todo:
        p, path = todo.pop()
        for (x, p1), (y, q1) in combinations(a.arcs[p].items(), 2):
            for tail in a.common(p1, q1):
                head = _spell(path)
                yield head + x + tail, head + y + tail
        todo.extend((q, (path, c)) for c, q in a.arcs[p].items())


def one_inserted(a: Acceptor, short: int, long: int, at_end: bool) -> Iterator[tuple[str, str]]:
    """Accepted pairs (shorter, longer) that insert one code point where they first differ; at the end only with ``at_end``."""
    todo: list[tuple[int, int, tuple | None]] = [(short, long, None)]
    while todo:
        p, q, path = todo.pop()
        if at_end or not a.final[p]:
            for y, q1 in a.arcs[q].items():
                for tail in a.common(p, q1, barred=y):
                    head = _spell(path)
                    yield head + tail, head + y + tail
        todo.extend((p1, a.arcs[q][c], (path, c)) for c, p1 in a.arcs[p].items() if c in a.arcs[q])


def near_in_state(before: str, after: str, short: dict[str, int], long: dict[str, int], at_end: bool) -> Iterator[tuple[str, int, int, str]]:
    """(word, number of near words, largest count among them, first word with that count) of the words of one state.

    ``short`` and ``long`` map middles of one length, and of one code point more, to the counts of their words.
    """
    found: dict[str, list] = {}

    def meet(x: str, n_x: int, y: str, n_y: int) -> None:
        x, y = before + x + after, before + y + after
        for word, other in ((x, (-n_y, y)), (y, (-n_x, x))):
            entry = found.setdefault(word, [0, other])
            entry[0] += 1
            entry[1] = min(entry[1], other)
    a = Acceptor()
    first = a.compile(sorted(short))
    for x, y in one_replaced(a, first):
        meet(x, short[x], y, short[y])
    if long:
        for x, y in one_inserted(a, first, a.compile(sorted(long)), at_end):
            meet(x, short[x], y, long[y])
    for word, (n, (below, best)) in found.items():
        yield word, n, -below, best


def _solve_batches(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    state, sides, rows = None, ({}, {}), []

    def solved() -> Iterator[tuple[str, int, int, str]]:
        if state is not None and sides[0] and len(sides[0]) + len(sides[1]) > 1:
            m, _, hi, before, after = state
            yield from near_in_state(before, after, *sides, hi == m)

    def out() -> pa.RecordBatch:
        made = [pa.array([r[i] for r in rows], kind) for i, kind in enumerate((pa.string(), pa.int64(), pa.int64(), pa.string()))]
        rows.clear()
        return pa.record_batch(made, ["word", "n_near", "near_n", "near"])
    for batch in batches:
        columns = [batch.column(c).to_pylist() for c in (*_STATE, "is_long", "middle", "n")]
        for *key, is_long, middle, n in zip(*columns):
            if key != state:
                rows += solved()
                state, sides = key, ({}, {})
                if len(rows) >= 10_000:
                    yield out()
            sides[is_long][middle] = n
    rows += solved()
    yield out()


def first_states(words: DataFrame) -> DataFrame:
    """word, n, is_long and the initial state of every hole that ``words`` may differ in: the halves of both lengths."""
    length = F.length("word").cast("int")
    sizes = F.explode(F.array(F.struct(length.alias("m"), F.lit(False).alias("is_long")), F.struct((length - 1).alias("m"), F.lit(True).alias("is_long")))).alias("s")
    rows = words.select("word", "n", sizes).select("word", "n", "s.*").where(F.col("m") >= MIN_LENGTH)
    return _halved(rows.withColumn("lo", F.lit(0)).withColumn("hi", F.col("m")))


def _halved(rows: DataFrame) -> DataFrame:
    mid = F.floor((F.col("lo") + F.col("hi")) / 2).cast("int")
    holes = F.explode(F.array(F.struct(F.col("lo"), mid.alias("hi")), F.struct(mid.alias("lo"), F.col("hi")))).alias("h")
    rows = rows.select("word", "n", "m", "is_long", holes).select("word", "n", "m", "is_long", "h.*")
    size = F.col("hi") - F.col("lo") + F.col("is_long").cast("int")
    return rows.select("n", "is_long", "m", "lo", "hi", "word", F.substring("word", F.lit(1), F.col("lo")).alias("before"),
                       F.substring("word", F.col("lo") + 1, size).alias("middle"),
                       F.substring("word", F.col("lo") + size + 1, F.length("word")).alias("after"))


def near_words(words: DataFrame, state_words: int = STATE_WORDS) -> DataFrame:
    """word, n_near, near_n, near of each word with a word one edit away: their number and the most frequent of them."""
    rows, found = first_states(words), None
    while True:
        sizes = rows.groupBy(*_STATE).agg(F.count("*").alias("size")).where((F.col("size") > state_words) & (F.col("hi") - F.col("lo") > 1))
        large = written(sizes.select(*_STATE), "large-states")
        at_once = keyed(rows, large, "left_anti").drop("word").repartition(*_STATE).sortWithinPartitions(*_STATE)
        part = at_once.mapInArrow(_solve_batches, "word string, n_near long, near_n long, near string")
        found = part if found is None else found.unionByName(part)
        if large.isEmpty():
            break
        rows = written(_halved(keyed(rows, large)), "split-states")
    best = F.min(F.struct((-F.col("near_n")).alias("below"), "near"))
    return found.groupBy("word").agg(F.sum("n_near").alias("n_near"), best.alias("best")).select(
        "word", "n_near", (-F.col("best.below")).alias("near_n"), F.col("best.near").alias("near"))


def roots(forms: DataFrame) -> DataFrame:
    """word, root for ``forms`` (word, form): each step doubles how far a word has followed its forms.

    The count at least doubles from a word to its form, so chains are short and end, and few words share a form.
    """
    ahead = written(forms.select("word", F.col("form").alias("root")), "roots")
    while True:
        on = ahead.select(F.col("word").alias("root"), F.col("root").alias("next"))
        step = written(ahead.join(on, "root", "left").select("word", F.coalesce("next", "root").alias("root"), F.col("next").isNotNull().alias("moved")), "roots")
        ahead = step.drop("moved")
        if step.where("moved").isEmpty():
            return ahead


def variants(docs: DataFrame, min_count: int = MIN_COUNT, state_words: int = STATE_WORDS) -> DataFrame:
    """word, n, n_near, form, form_n, root of the words of ``docs`` (doc_id, text).

    n_near: words one code point inserted, deleted or replaced away. form: the most frequent of them (ties: the first in
    code-point order) if it occurs at least twice as often. root: the last word that forms lead to.

    Null and empty texts have no words. Rows that repeat a doc_id or a text count each; runs of a row without a doc_id are
    taken as they are. Words may be of any length. Other columns are not looked at. An empty table gives an empty table.
    """
    words = written(vocabulary(docs, min_count), "words")
    near = written(near_words(words, state_words), "near-words")
    rows = words.join(near, "word", "left").withColumn("has_form", F.col("near_n") >= FORM_RATIO * F.col("n"))
    rows = rows.select("word", "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"), F.when(F.col("has_form"), F.col("near")).alias("form"),
                       F.when(F.col("has_form"), F.col("near_n")).alias("form_n"))
    last = roots(rows.where("form IS NOT NULL"))
    return rows.join(last, "word", "left").withColumn("root", F.coalesce("root", "word"))
