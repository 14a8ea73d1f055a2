"""SentencePiece encoding as a weighted finite-state transducer, and decoding as its inverse.

Three machines are composed with each text: the normaliser (a space mark in front, spaces to marks), the pieces (one arc
for each piece, found by an Aho-Corasick automaton, so the composition holds only arcs that the text allows) and the byte
fallback (a character that is no piece leaves as its UTF-8 bytes). The shortest path in the tropical semiring (least sum
of arc weights) is the encoding. For a unigram model the weights are negated scores. A merge (BPE) model restricts arcs to
those neighbours whose border survives their merges; merges on both sides of a border see nothing else, so just one path
is left, and it is the library's result.

No piece holds a mark behind another character, nor a character that no piece knows. Paths therefore part at these
places, and each part is solved once and kept: a text is the concatenation of its parts' packed ids.
"""
from __future__ import annotations

import hashlib
import re
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

MARK = "▁"
_NONE = float("-inf")
#: Parts that a task keeps, twice (the older ones until as many new came); a longer part than ``KEEP_CHARS`` is solved anew each time.
KEEP_PARTS, KEEP_CHARS, KEEP_BORDERS = 200_000, 48, 300_000


@dataclass(frozen=True)
class Pieces:
    """A model file's tables: piece texts by id with score, ids of the 256 byte pieces, model kind and dummy prefix."""
    texts: tuple[str, ...]
    scores: tuple[float, ...]
    plain: tuple[bool, ...]
    byte_ids: tuple[int, ...]
    unknown: int
    merges: bool
    prefix: bool


def load(path: str) -> Pieces:
    """Read a model file on the driver. Models with a character map, or that squeeze spaces, are refused."""
    from sentencepiece import sentencepiece_model_pb2 as pb

    m = pb.ModelProto()
    with open(path, "rb") as f:
        m.ParseFromString(f.read())
    n = m.normalizer_spec
    if n.precompiled_charsmap or n.remove_extra_whitespaces or not n.escape_whitespaces or m.trainer_spec.treat_whitespace_as_suffix:
        raise ValueError("only the identity normaliser with space marks in front is compiled")
    if m.trainer_spec.model_type not in (1, 2):
        raise ValueError("only unigram and merge models are compiled")
    kinds = [p.type for p in m.pieces]
    bytes_at = {p.piece: i for i, p in enumerate(m.pieces) if p.type == 6}
    byte_ids = tuple(bytes_at.get(f"<0x{b:02X}>", -1) for b in range(256)) if m.trainer_spec.byte_fallback else ()
    return Pieces(tuple(p.piece for p in m.pieces), tuple(p.score for p in m.pieces), tuple(k in (1, 4) for k in kinds),
                  byte_ids, kinds.index(2), m.trainer_spec.model_type == 2, n.add_dummy_prefix)


class Transducer:
    """The composed machine of one worker."""

    def __init__(self, pieces: Pieces):
        import ahocorasick

        self.pieces = pieces
        self.ids = {t: i for i, (t, plain) in enumerate(zip(pieces.texts, pieces.plain)) if plain}
        self.score = {t: pieces.scores[i] for t, i in self.ids.items()}
        self.automaton = ahocorasick.Automaton()
        for t in self.ids:
            self.automaton.add_word(t, t)
        self.automaton.make_automaton()
        self.single = {t for t in self.ids if len(t) == 1}
        if any(MARK in t.lstrip(MARK) for t in self.ids):
            raise ValueError("a piece holds a mark behind another character")
        known = {c for t in self.ids for c in t}
        alone = "".join(re.escape(c) for c in "\n\t\r" if c not in known)
        self.part = re.compile(f"{MARK}+[^{MARK}{alone}]*|[^{MARK}{alone}]+" + (f"|[{alone}]" if alone else ""))
        self.floor = min(self.score.values(), default=0.0) - 10
        self.kept: dict[str, bytes] = {}
        self.older: dict[str, bytes] = {}
        self.borders: dict[tuple[str, str], bool] = {}
        self.whole: dict[str, bool] = {}
        raw = [t.replace(MARK, " ").encode() if pieces.plain[i] else b"" for i, t in enumerate(pieces.texts)]
        for b, i in enumerate(pieces.byte_ids):
            raw[i] = bytes([b])
        self.raw = np.frombuffer(b"".join(raw), np.uint8)
        self.raw_len = np.array([len(r) for r in raw], np.int64)
        self.raw_at = np.concatenate([[0], np.cumsum(self.raw_len)[:-1]])

    def release(self) -> None:
        """Forget the solved parts and borders: a worker that has ended its task holds the model alone."""
        self.kept, self.older, self.borders = {}, {}, {}

    def _merged(self, s: str) -> list[str]:
        """What the merges of a short string leave: best score first, the leftmost among equals."""
        parts, score = list(s), self.score
        value = [score.get(a + b, _NONE) for a, b in zip(parts, parts[1:])]
        while value:
            best = max(value)
            if best == _NONE:
                break
            i = value.index(best)
            parts[i:i + 2] = [parts[i] + parts[i + 1]]
            del value[i]
            if i < len(value):
                value[i] = score.get(parts[i] + parts[i + 1], _NONE)
            if i:
                value[i - 1] = score.get(parts[i - 1] + parts[i], _NONE)
        return parts

    def _stands(self, left: str | None, right: str) -> bool:
        """Whether an arc may follow another: the piece is its own merge result, and the border between both survives."""
        if not self.pieces.merges:
            return True
        if left is None:
            ok = self.whole.get(right)
            if ok is None:
                ok = self.whole[right] = len(right) == 1 or self._merged(right) == [right]
            return ok
        if len(self.borders) > KEEP_BORDERS:
            self.borders.clear()
        ok = self.borders.get((left, right))
        if ok is None:
            ok = self.borders[left, right] = self._stands(None, right) and self._merged(left + right) == [left, right]
        return ok

    def _only_path(self, part: str) -> list[str]:
        """The one path of a merge model through a part whose characters are all pieces: no weights to compare."""
        last: list[str | None] = [None] * (len(part) + 1)
        borders, stands = self.borders, self._stands
        for end, t in self.automaton.iter(part):
            if last[end + 1] is None:
                at = end + 1 - len(t)
                before = last[at]
                if before is not None or at == 0:
                    ok = borders.get((before, t)) if at else stands(None, t)
                    if ok or ok is None and stands(before, t):
                        last[end + 1] = t
        out, i = [], len(part)
        while i:
            t = last[i]
            out.append(t)
            i -= len(t)
        out.reverse()
        return out

    def path(self, part: str) -> list[str]:
        """Arcs of the shortest path through the composition with one part of a text."""
        if self.pieces.merges and self.single.issuperset(part):
            return self._only_path(part)
        n = len(part)
        cost, last = [float("inf")] * (n + 1), [None] * (n + 1)
        cost[0] = 0.0
        ids, score, stands, merges = self.ids, self.score, self._stands, self.pieces.merges
        arcs: list[list[str]] = [[] for _ in range(n + 1)]
        for end, t in self.automaton.iter(part):
            arcs[end + 1].append(t)
        for i in range(1, n + 1):
            c = part[i - 1]
            if c not in ids:
                arcs[i].append(c)
            for t in arcs[i]:
                s = i - len(t)
                if cost[s] == float("inf"):
                    continue
                x = cost[s] + (1.0 if merges else -score.get(t, self.floor))
                if x < cost[i] and stands(last[s], t):
                    cost[i], last[i] = x, t
        out, i = [], n
        while i:
            t = last[i]
            if t is None:
                raise AssertionError(f"no path through {part!r}")
            out.append(t)
            i -= len(t)
        return out[::-1]

    def _solve(self, part: str) -> bytes:
        packed = self.older.get(part)
        if packed is not None:
            self.kept[part] = packed
            return packed
        out: list[int] = []
        for t in self.path(part):
            i = self.ids.get(t)
            if i is not None:
                out.append(i)
            elif self.pieces.byte_ids:
                out.extend(self.pieces.byte_ids[b] for b in t.encode())
            elif not out or out[-1] != self.pieces.unknown:
                out.append(self.pieces.unknown)
        packed = np.array(out, np.int32).tobytes()
        if len(part) <= KEEP_CHARS:
            if len(self.kept) >= KEEP_PARTS:
                self.kept, self.older = {}, self.kept
            self.kept[part] = packed
        return packed

    def encode(self, text: str) -> bytes:
        """Packed 32-bit ids of a text."""
        if not text:
            return b""
        line = (MARK if self.pieces.prefix else "") + text.replace(" ", MARK)
        return b"".join([self.kept.get(p) or self._solve(p) for p in self.part.findall(line)])

    def decode(self, packed: bytes) -> bytes:
        """UTF-8 bytes of packed ids: every piece's text or byte, without the mark put in front."""
        ids = np.frombuffer(packed, np.int32)
        if not len(ids):
            return b""
        n = self.raw_len[ids]
        ends = np.cumsum(n)
        at = np.arange(int(ends[-1])) + np.repeat(self.raw_at[ids] - (ends - n), n)
        raw = self.raw[at].tobytes()
        return raw[1:] if self.pieces.prefix and raw[:1] == b" " else raw


_MACHINES: dict[int, Transducer] = {}


def _machine(pieces: Pieces) -> Transducer:
    """One machine for each worker and model, kept between tasks."""
    key = hash(pieces)
    if key not in _MACHINES:
        _MACHINES.clear()
        _MACHINES[key] = Transducer(pieces)
    return _MACHINES[key]


def _mapped(df: DataFrame, source: str, new: dict[str, T.DataType], made) -> DataFrame:
    df = df.drop(*new)
    schema = T.StructType([*df.schema.fields, *(T.StructField(k, t) for k, t in new.items())])
    at, names = df.columns.index(source), [*df.columns, *new]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([*batch.columns, *made(batch.column(at))], names=names)
        for machine in _MACHINES.values():
            machine.release()
    return df.mapInArrow(run, schema)


def encode(docs: DataFrame, pieces: Pieces) -> DataFrame:
    """``docs`` with ``pieces``, the packed little-endian 32-bit ids of the whole text.

    A null text has null pieces, an empty one none. Repeated rows get equal results; other columns pass through, and a
    column named pieces is replaced. An empty table gives an empty table.
    """
    shared = docs.sparkSession.sparkContext.broadcast(pieces)

    def made(texts: pa.Array) -> list[pa.Array]:
        machine = _machine(shared.value)
        return [pa.array([None if not t.is_valid else machine.encode(t.as_py()) for t in texts], pa.binary())]
    return _mapped(docs, "text", {"pieces": T.BinaryType()}, made)


def decode(encoded: DataFrame, pieces: Pieces) -> DataFrame:
    """``encoded`` with ``decoded``, the text of ``pieces`` (null for null); bytes that are no UTF-8 become U+FFFD.

    A text that holds the space mark itself comes back with a space there, as the model has no other piece for it.
    """
    shared = encoded.sparkSession.sparkContext.broadcast(pieces)

    def made(packed: pa.Array) -> list[pa.Array]:
        machine = _machine(shared.value)
        return [pa.array([None if not p.is_valid else machine.decode(p.as_py()).decode("utf-8", "replace") for p in packed], pa.string())]
    return _mapped(encoded, "pieces", {"decoded": T.StringType()}, made)


def _report(machine: Transducer, first: int, last: int, texts: Iterable[str | None], packed: Iterable[bytes | None]) -> list[pa.Array]:
    """n_pieces, n_fallback, pieces_sha256 and decoded_same of texts and their packed ids."""
    rows = []
    for text, own in zip(texts, packed):
        own = own or b""
        ids = np.frombuffer(own, np.int32)
        same = machine.decode(own) == (text or "").replace(MARK, " ").encode()
        rows.append((len(ids), int(((ids >= first) & (ids <= last)).sum()), hashlib.sha256(own).hexdigest(), same))
    return [pa.array(c, k) for c, k in zip(list(zip(*rows)) or [()] * 4, (pa.int64(), pa.int64(), pa.string(), pa.bool_()))]


_REPORTED = {"n_pieces": T.LongType(), "n_fallback": T.LongType(), "pieces_sha256": T.StringType(), "decoded_same": T.BooleanType()}


def _byte_range(pieces: Pieces) -> tuple[int, int]:
    return (min(pieces.byte_ids), max(pieces.byte_ids)) if pieces.byte_ids else (-1, -1)


def verified(encoded: DataFrame, pieces: Pieces) -> DataFrame:
    """``encoded`` with n_pieces, n_fallback (byte pieces), pieces_sha256 and decoded_same: ``pieces`` decode to ``text``.

    A space mark in the text counts as a space. A null text counts as empty.
    """
    shared, (first, last) = encoded.sparkSession.sparkContext.broadcast(pieces), _byte_range(pieces)
    encoded = encoded.drop(*_REPORTED)
    schema = T.StructType([*encoded.schema.fields, *(T.StructField(k, t) for k, t in _REPORTED.items())])
    text_at, at, names = encoded.columns.index("text"), encoded.columns.index("pieces"), [*encoded.columns, *_REPORTED]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            made = _report(_machine(shared.value), first, last, batch.column(text_at).to_pylist(), batch.column(at).to_pylist())
            yield pa.RecordBatch.from_arrays([*batch.columns, *made], names=names)
    return encoded.mapInArrow(run, schema)


def round_trip(docs: DataFrame, pieces: Pieces) -> DataFrame:
    """``verified(encode(docs))`` in one pass, so that a task holds one worker and one machine instead of two."""
    shared, (first, last) = docs.sparkSession.sparkContext.broadcast(pieces), _byte_range(pieces)

    def made(texts: pa.Array) -> list[pa.Array]:
        machine, rows = _machine(shared.value), texts.to_pylist()
        packed = [None if t is None else machine.encode(t) for t in rows]
        return [pa.array(packed, pa.binary()), *_report(machine, first, last, rows, packed)]
    return _mapped(docs, "text", {"pieces": T.BinaryType()} | _REPORTED, made)
