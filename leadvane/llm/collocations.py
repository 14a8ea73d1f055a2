"""Phrases of two and three words that stick together, counted in a HAT-trie and merged from its spilled runs.

A task counts phrases of word ids in a trie: its leaves are hash containers for a stretch of ids, and a container that
fills up bursts into two at the border of a first, then a second, then a third word, so the trie stays shallow and follows the text. When the
trie holds too many phrases, whole subtrees leave it, largest first, as one sorted run with words in place of ids. A run is
cut by prefix partition: the first word picks a window of partitions and the rest of the phrase one of them, so the
subtree of a word that starts a third of all phrases is still spread. Each piece is one compressed row; Spark sorts the
pieces by partition, and a task merges one prefix partition after the other. Phrases below the count end there; the rest is
an ordinary table for joins.
"""
from __future__ import annotations

from collections.abc import Iterable, Iterator
from functools import partial
from zlib import crc32

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from leadvane.llm.common import written
from leadvane.llm.words import LOWER, U, chunks, mix, split

MIN_COUNT = 10
TOP = 2000
#: A candidate goes if a longer one around it occurs at least so many percent as often.
INSIDE_PERCENT = 50
#: Text of one prefix partition; its phrases take about 15 times as much while they are merged.
PARTITION_BYTES = 4 << 20
#: A first word's phrases lie in a window of one in so many prefix partitions.
WINDOWS = 4
TEXT_BYTES = 2 << 20
#: Words of a text that are counted at once.
STRETCH = 500_000
CONTAINER = 1 << 15
TRIE_PHRASES = 1_500_000
TRIE_WORDS = 600_000

#: Word ids take 21 bits of a packed phrase, first word highest; a missing word is 0.
_BITS = 21
_MASK = U((1 << _BITS) - 1)
_APART = np.zeros(256, bool)
_APART[list(b".,;:!?\x0a\x0b\x0c\x0d")] = True
_PARTING = _APART.copy()
_PARTING[[9, 32]] = True


class Container:
    """A hash table of packed phrases from ``low`` on: open addressing, whole batches inserted at once."""

    def __init__(self, low: int, keys: np.ndarray, counts: np.ndarray) -> None:
        self.low, self.size = low, 0
        self._room(max(len(keys), CONTAINER // 8))
        self.add(keys, counts)

    def _room(self, n: int) -> None:
        self.bits = max(4, int(2 * n - 1).bit_length())
        self.keys, self.counts = np.zeros(1 << self.bits, U), np.zeros(1 << self.bits, np.int64)

    def items(self) -> tuple[np.ndarray, np.ndarray]:
        used = np.flatnonzero(self.keys)
        return self.keys[used], self.counts[used]

    def add(self, keys: np.ndarray, counts: np.ndarray) -> None:
        """Add ``counts`` to ``keys``, which are distinct and not 0."""
        if 2 * (self.size + len(keys)) > len(self.keys):
            held = self.items()
            self.size = 0
            self._room(len(held[0]) + 2 * len(keys))
            self._put(*held)
        self._put(keys, counts)

    def _put(self, keys: np.ndarray, counts: np.ndarray) -> None:
        slot = (mix(keys) >> U(64 - self.bits)).astype(np.int64)
        while len(keys):
            free = self.keys[slot] == 0
            self.keys[slot[free]] = keys[free]
            mine = self.keys[slot] == keys
            self.counts[slot[mine]] += counts[mine]
            self.size += int(np.count_nonzero(mine & free))
            keys, counts, slot = keys[~mine], counts[~mine], (slot[~mine] + 1) & (len(self.keys) - 1)


def _borders(keys: np.ndarray) -> int:
    """A place near the middle of the sorted ``keys`` where the highest possible level of the trie changes."""
    for level in (2 * _BITS, _BITS, 0):
        change = np.flatnonzero(np.diff(keys >> U(level))) + 1
        if len(change):
            return int(change[np.argmin(np.abs(change - len(keys) // 2))])
    return 0


class Trie:
    """Counts of packed phrases: containers in the order of the stretches of ids that they hold."""

    def __init__(self) -> None:
        self.size, self.leaves = 0, [Container(0, np.zeros(0, U), np.zeros(0, np.int64))]

    def add(self, keys: np.ndarray, counts: np.ndarray) -> None:
        """Add sorted, distinct phrases."""
        cut = np.searchsorted(keys, np.array([leaf.low for leaf in self.leaves], U))
        cut = np.append(cut, len(keys))
        leaves: list[Container] = []
        for leaf, i, j in zip(self.leaves, cut[:-1], cut[1:]):
            self.size -= leaf.size
            if j > i:
                leaf.add(keys[i:j], counts[i:j])
            self.size += leaf.size
            leaves += self._burst(leaf)
        self.leaves = leaves

    def _burst(self, leaf: Container) -> list[Container]:
        if leaf.size <= CONTAINER:
            return [leaf]
        keys, counts = leaf.items()
        order = np.argsort(keys)
        keys, counts = keys[order], counts[order]
        at = _borders(keys)
        low, high = Container(leaf.low, keys[:at], counts[:at]), Container(int(keys[at]), keys[at:], counts[at:])
        return self._burst(low) + self._burst(high)

    def spill(self, keep: int) -> tuple[np.ndarray, np.ndarray]:
        """Take out the largest subtrees until ``keep`` phrases are left."""
        out = []
        for leaf in sorted(self.leaves, key=lambda x: -x.size):
            if self.size <= keep:
                break
            out.append(leaf.items())
            self.size -= leaf.size
            leaf.size = 0
            leaf._room(CONTAINER // 8)
        if not out:
            return np.zeros(0, U), np.zeros(0, np.int64)
        return np.concatenate([k for k, _ in out]), np.concatenate([c for _, c in out])


class Dictionary:
    """Ids of a task's words, in order of appearance."""

    def __init__(self) -> None:
        self.ids: dict[bytes, int] = {}

    def codes(self, words: pa.Array) -> np.ndarray:
        coded = words.dictionary_encode()
        ids = self.ids
        new = np.array([ids.setdefault(w, len(ids) + 1) for w in coded.dictionary.to_pylist()], np.uint64)
        return new[coded.indices.to_numpy(zero_copy_only=False)] if len(new) else np.zeros(0, np.uint64)


def _words(data: np.ndarray, start: np.ndarray, end: np.ndarray) -> pa.Array:
    """The lower-cased words of a chunk as one Arrow array."""
    bounds = np.zeros(len(start) + 1, np.int64)
    np.cumsum(end - start, out=bounds[1:])
    joined = LOWER[data[~_PARTING[data]]]
    return pa.Array.from_buffers(pa.large_binary(), len(start), [None, pa.py_buffer(bounds), pa.py_buffer(joined.tobytes())])


def _phrases(code: np.ndarray, piece: np.ndarray, own: int) -> tuple[np.ndarray, np.ndarray]:
    """Sorted packed phrases of one to three words that begin at the first ``own`` words and end in their piece, and their counts."""
    two = piece[1:] == piece[:-1]
    three = two[1:] & two[:-1]
    a = code << U(2 * _BITS)
    b = a[:-1] | (code[1:] << U(_BITS))
    c = b[:-1] | code[2:]
    return np.unique(np.concatenate([a[:own], b[:own][two[:own]], c[:own][three[:own]]]), return_counts=True)


def _run(keys: np.ndarray, counts: np.ndarray, words: Dictionary, lang: str, parts: int) -> Iterator[dict]:
    """A sorted run as rows: one for each prefix partition that it touches."""
    if not len(keys):
        return
    ids = [((keys >> U(shift)) & _MASK).astype(np.int64) for shift in (2 * _BITS, _BITS, 0)]
    text = pa.array([b"", *words.ids], pa.large_binary())
    used = np.unique(np.concatenate([np.zeros(1, np.int64), *ids]))
    order = used[pc.sort_indices(text.take(pa.array(used))).to_numpy()]
    rank = np.zeros(len(text), np.int64)
    rank[order] = np.arange(len(order))
    ids = [rank[i] for i in ids]
    text = text.take(pa.array(order))
    # The place of the missing word has no space before it.
    spaced = pa.concat_arrays([text[:1], pc.binary_join_element_wise(pa.scalar(b"", pa.large_binary()), text[1:], pa.scalar(b" ", pa.large_binary()))])
    h = mix(np.fromiter((crc32(w) for w in text.to_pylist()), U, len(text)))
    first = (h[ids[0]] ^ U(crc32(lang.encode()))) % U(parts)
    rest = mix(h[ids[1]] * U(3) + h[ids[2]]) % U(max(1, parts // WINDOWS))
    part = ((first + rest) % U(parts)).astype(np.int32)
    at = np.lexsort((ids[2], ids[1], ids[0], part))
    part, counts = part[at], counts[at]
    ids = [pa.array(i[at]) for i in ids]
    phrase = pc.binary_join_element_wise(text.take(ids[0]), spaced.take(ids[1]), spaced.take(ids[2]), pa.scalar(b"", pa.large_binary()))
    bounds, body = np.frombuffer(phrase.buffers()[1], np.int64), np.frombuffer(phrase.buffers()[2], np.uint8)
    border = np.flatnonzero(np.diff(part, prepend=-1, append=-1))
    for i, j in zip(border[:-1], border[1:]):
        yield {"part": int(part[i]), "lang": lang, "n": int(j - i), "size": int(bounds[j] - bounds[i]), "lengths": pack(np.diff(bounds[i:j + 1]).astype(np.int32)),
               "counts": pack(counts[i:j]), "body": pack(body[bounds[i]:bounds[j]])}


def pack(values: np.ndarray) -> bytes:
    return pa.compress(values.tobytes(), codec="zstd", asbytes=True)


def unpack(data: bytes, kind: type, n: int) -> np.ndarray:
    return np.frombuffer(pa.decompress(data, n * np.dtype(kind).itemsize, codec="zstd", asbytes=True), kind)


_RUN_ROW = "part int, lang string, n int, size int, lengths binary, counts binary, body binary"


def _count_batches(batches: Iterable[pa.RecordBatch], parts: int) -> Iterator[pa.RecordBatch]:
    tries: dict[str, Trie] = {}
    words = Dictionary()
    schema = pa.schema([("part", pa.int32()), ("lang", pa.string()), ("n", pa.int32()), ("size", pa.int32()), ("lengths", pa.binary()), ("counts", pa.binary()), ("body", pa.binary())])

    def out(rows: Iterable[dict]) -> Iterator[pa.RecordBatch]:
        rows = list(rows)
        for i in range(0, len(rows), 256):
            yield pa.RecordBatch.from_pylist(rows[i:i + 256], schema)

    def spill(keep: int) -> Iterator[pa.RecordBatch]:
        total = sum(t.size for t in tries.values())
        for lang, trie in tries.items():
            yield from out(_run(*trie.spill(keep * trie.size // max(total, 1)), words, lang, parts))
    for batch in batches:
        langs = batch.column("lang").dictionary_encode()
        for i, lang in enumerate(langs.dictionary.to_pylist()):
            texts = batch.column("text").filter(pc.equal(langs.indices, i))
            trie = tries.setdefault(lang, Trie())
            for _, _, data, off in chunks(texts, TEXT_BYTES):
                start, end, first = split(data, off, _PARTING)
                if not len(start):
                    continue
                apart = _APART[data].astype(np.int64)
                apart[off[:-1][off[:-1] < len(data)]] += 1
                piece = np.cumsum(apart)[start]
                found = _words(data, start, end)
                for at in range(0, len(found), STRETCH):
                    trie.add(*_phrases(words.codes(found[at:at + STRETCH + 2]), piece[at:at + STRETCH + 2], min(STRETCH, len(found) - at)))
                    if len(words.ids) > TRIE_WORDS:
                        yield from spill(0)
                        words.ids.clear()
                    elif sum(t.size for t in tries.values()) > TRIE_PHRASES:
                        yield from spill(TRIE_PHRASES // 2)
    yield from spill(0)


def _merge(rows: list[tuple]) -> tuple[pa.Array, np.ndarray]:
    """Distinct phrases of the pieces of one prefix partition, and their counts."""
    n, size = sum(r[0] for r in rows), sum(r[1] for r in rows)
    bounds = np.zeros(n + 1, np.int64)
    np.cumsum(np.concatenate([unpack(r[2], np.int32, r[0]) for r in rows]), out=bounds[1:])
    body = b"".join(pa.decompress(r[4], r[1], codec="zstd", asbytes=True) for r in rows)
    counts = np.concatenate([unpack(r[3], np.int64, r[0]) for r in rows])
    phrases = pa.Array.from_buffers(pa.large_binary(), n, [None, pa.py_buffer(bounds), pa.py_buffer(body)]).dictionary_encode()
    total = np.zeros(len(phrases.dictionary), np.int64)
    np.add.at(total, phrases.indices.to_numpy(zero_copy_only=False), counts)
    return phrases.dictionary, total


def _merge_batches(batches: Iterable[pa.RecordBatch], min_count: int) -> Iterator[pa.RecordBatch]:
    key, rows = None, []

    def out() -> pa.RecordBatch:
        phrases, total = _merge(rows)
        k = pc.add(pc.count_substring(phrases, b" "), 1).to_numpy()
        kept = total >= min_count
        words = int(total[k == 1].sum())
        names = pa.array(phrases.filter(pa.array(kept)).cast(pa.string()).to_pylist() + [None], pa.string())
        return pa.record_batch([pa.array([key[1]] * len(names), pa.string()), names, pa.array(np.append(k[kept], 0).astype(np.int32)), pa.array(np.append(total[kept], words))],
                               ["lang", "phrase", "k", "f"])
    for batch in batches:
        for part, lang, *row in zip(*(batch.column(c).to_pylist() for c in ("part", "lang", "n", "size", "lengths", "counts", "body"))):
            if (part, lang) != key:
                if rows:
                    yield out()
                key, rows = (part, lang), []
            rows.append(row)
    if rows:
        yield out()


def phrase_counts(docs: DataFrame, min_count: int = MIN_COUNT, partition_bytes: int = PARTITION_BYTES) -> DataFrame:
    """lang, phrase, k, f of every phrase of 1 to 3 words with ``min_count`` occurrences; rows of k = 0 add up to a language's words."""
    rows = docs.select(F.coalesce("lang", F.lit("und")).alias("lang"), "text").where("text IS NOT NULL")
    size = rows.agg(F.sum(F.octet_length("text").cast("long"))).first()[0] or 0
    parts = size // partition_bytes + 1
    runs = rows.mapInArrow(partial(_count_batches, parts=parts), _RUN_ROW)
    dealt = runs.repartition("part").sortWithinPartitions("part", "lang")
    return dealt.mapInArrow(partial(_merge_batches, min_count=min_count), "lang string, phrase string, k int, f long")


def _joined(words: Column, start: int | Column, n: int | Column) -> Column:
    return F.array_join(F.slice(words, start, n), " ")


def parts_of(candidates: DataFrame) -> DataFrame:
    """lang, phrase, k, a, side, part: each candidate with the parts left and right (l, r) of its first and second cut."""
    w = F.split("phrase", " ")
    sides = [F.struct(F.lit(f"{side}{cut}").alias("side"), part.alias("part")) for cut in (1, 2)
             for side, part in (("l", _joined(w, 1, cut)), ("r", _joined(w, cut + 1, F.col("k") - cut)))]
    cut = F.when(F.col("k") == 2, F.array(*sides[:2])).otherwise(F.array(*sides))
    return candidates.select("lang", "phrase", "k", F.col("f").alias("a"), F.explode(cut).alias("s")).select("lang", "phrase", "k", "a", "s.*")


def _score(cut: int) -> Column:
    """The cut's floor(1000000 a a / (l r)), exact in 38 digits, with its number and parts; null where there is no such cut."""
    a, l, r = (F.col(c).cast("decimal(15,0)") for c in ("a", f"l{cut}", f"r{cut}"))
    whole = F.call_function("div", a * a * F.lit(1_000_000).cast("decimal(7,0)"), l * r)
    return F.when(F.col(f"l{cut}").isNotNull(), F.struct(whole.alias("score"), F.lit(cut).alias("cut"), F.col(f"l{cut}").alias("l"), F.col(f"r{cut}").alias("r")))


def collocations(docs: DataFrame, min_count: int = MIN_COUNT, top: int = TOP, partition_bytes: int = PARTITION_BYTES) -> DataFrame:
    """lang, rank, phrase, a, l, r, n, score: each language's ``top`` phrases of two or three words.

    ``docs`` has text and lang; a null lang is ``und``. Words are lower-cased (A-Z) and parted by space and tab within pieces that
    end at ``.,;:!?`` or a line end. a, l, r: occurrences of the phrase and of the parts of its weakest cut; n: words of the language;
    score: floor(1000000 a a / (l r)) in exact decimals. A phrase inside a longer candidate that occurs at least half as often is
    dropped. Order: score, then a, both descending, then the phrase's bytes.

    Null, empty and blank texts have no words. Rows that repeat an id or text count each. Other columns are not looked at. A task
    holds the longest text of its rows and a trie of bounded size. An empty table gives an empty table.
    """
    counts = written(phrase_counts(docs, min_count, partition_bytes), "phrase-counts")
    totals = counts.where("k = 0").groupBy("lang").agg(F.sum("f").alias("n"))
    known = counts.where("k > 0")
    candidates = known.where("k > 1")
    parts = parts_of(candidates).join(known.select("lang", F.col("phrase").alias("part"), F.col("f").alias("of_part")), ["lang", "part"])
    sides = [F.max(F.when(F.col("side") == s, F.col("of_part"))).alias(s) for s in ("l1", "r1", "l2", "r2")]
    scored = parts.groupBy("lang", "phrase", "k", "a").agg(*sides).withColumn("best", F.array_min(F.array(_score(1), _score(2))))
    rows = scored.select("lang", "phrase", "a", "best.score", "best.l", "best.r")
    triples = candidates.where("k = 3").select("lang", F.split("phrase", " ").alias("w"), "f")
    inner = triples.select("lang", "f", F.explode(F.array(_joined(F.col("w"), 1, 2), _joined(F.col("w"), 2, 2))).alias("phrase"))
    longest = inner.groupBy("lang", "phrase").agg(F.max("f").alias("around"))
    rows = rows.join(longest, ["lang", "phrase"], "left").where(F.col("around").isNull() | (100 * F.col("around") < INSIDE_PERCENT * F.col("a")))
    return _ranked(rows, top).join(totals, "lang").select("lang", "rank", "phrase", "a", "l", "r", "n", "score")


def _ranked(rows: DataFrame, top: int) -> DataFrame:
    """The first ``top`` rows of each language; first within slices of it, so that no task ranks a whole language."""
    order = [F.desc("score"), F.desc("a"), F.asc("phrase")]
    slices = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    sliced = rows.withColumn("slice", F.pmod(F.xxhash64("phrase"), F.lit(slices)))
    for by in (["lang", "slice"], ["lang"]):
        sliced = sliced.withColumn("rank", F.row_number().over(Window.partitionBy(*by).orderBy(*order)).cast("long")).where(F.col("rank") <= top)
    return sliced.drop("slice")
