"""Language of whole texts: averaged hashed subword embeddings, a linear softmax, and a calibrated rejection.

A text is the mean of the embeddings of its 2- to 4-byte subwords (words with a space at both ends, lower-cased), hashed
into buckets. Embeddings and softmax are fitted by stochastic gradient descent in numpy on a bounded sample of labelled
texts; the sample's subword counts, not its texts, come to the driver. Since both layers are linear, prediction reads one
score for each language and bucket: tasks stream Arrow batches, and nothing is shuffled.
"""
from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from leadvane.llm import words as W

UNKNOWN = "und"
SIZES = (2, 3, 4)


@dataclass(frozen=True)
class TrainSpec:
    #: Labelled texts the classifier is fitted on, shared out evenly over the languages: the bound of the sample.
    max_rows: int = 4000
    buckets_log2: int = 16
    dim: int = 16
    epochs: int = 12
    rate: float = 0.5
    #: Steps of embeddings are so much longer, because each subword is a small share of its text.
    embedding_rate: float = 40.0
    #: Share of the sample that sets temperature and rejection.
    calibration: float = 0.25
    #: Least accuracy of accepted texts on the calibration rows.
    target_accuracy: float = 0.98
    seed: int = 17


@dataclass(frozen=True)
class Model:
    languages: tuple[str, ...]
    table: np.ndarray  # (buckets + 1, languages), the last row for positions that hold no subword
    bias: np.ndarray
    temperature: float
    threshold: float


_KEEP = np.full(256, 32, np.uint8)
_KEEP[97:123] = np.arange(97, 123)
_KEEP[65:91] = np.arange(97, 123)
_KEEP[128:] = np.arange(128, 256)


def subwords(data: np.ndarray, off: np.ndarray, log2: int) -> tuple[list[np.ndarray], np.ndarray, np.ndarray]:
    """Buckets of the subword that begins at each place, for each size (``2**log2``: none), the first place of each text,
    and whether a text has an ASCII letter. Texts are laid out with one space between them."""
    low = _KEEP[data]
    latin = np.flatnonzero((data[1:] >= 0x80) & (data[1:] <= 0x9E) & (data[1:] != 0x97) & (data[:-1] == 0xC3)) + 1
    low[latin] += 0x20
    texts = len(off) - 1
    first = off[:-1] + np.arange(texts)
    line = np.full(len(data) + texts + 4, 32, np.uint8)
    line[np.arange(len(data)) + np.repeat(np.arange(texts) + 1, np.diff(off))] = low
    n = len(data) + texts
    letter = line != 32
    ascii_letter = np.add.reduceat(((line[:n] > 96) & (line[:n] < 123)).astype(np.int64), first) > 0 if texts else np.zeros(0, bool)
    wide = line.astype(np.uint32)
    out, code = [], wide[:n]
    for size in range(2, max(SIZES) + 1):
        code = code | (wide[size - 1:n + size - 1] << np.uint32(8 * (size - 1)))
        if size == 2:
            good = letter[:n] | letter[1:n + 1]
        else:
            good = letter[1:n + 1].copy() if size == 3 else good & letter[2:n + 2]
        key = (code + np.uint32(size * 0x3C6EF372 & 0xFFFFFFFF)) * np.uint32(0x9E3779B1)
        key ^= key >> np.uint32(15)
        key *= np.uint32(0x85EBCA77)
        out.append(np.where(good, key >> np.uint32(32 - log2), np.uint32(1 << log2)).astype(np.int32))
    return out, first, ascii_letter


def _has_letter(column: pa.Array, rows: np.ndarray, found: np.ndarray) -> np.ndarray:
    """``found``, or any letter of any script in the text."""
    for k in np.flatnonzero(~found):
        text = column[int(rows[k])].as_py()
        found[k] = text is not None and any(c.isalpha() for c in text)
    return found


def counted(docs: DataFrame, log2: int) -> DataFrame:
    """lang and the packed (bucket, count) pairs of each text's subwords."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i, j, data, off in W.chunks(batch.column(1)):
                sizes, first, _ = subwords(data, off, log2)
                packed = []
                for a, b in zip(first.tolist(), [*first[1:].tolist(), len(sizes[0])]):
                    v, c = np.unique(np.concatenate([s[a:b] for s in sizes]), return_counts=True)
                    real = v < 1 << log2
                    packed.append(np.stack([v[real], c[real]]).astype(np.int32).tobytes())
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(i, j - i), pa.array(packed, pa.binary())], names=["lang", "grams"])
    return docs.select("lang", "text").mapInArrow(run, "lang string, grams binary")


def train(labelled: DataFrame, spec: TrainSpec = TrainSpec()) -> Model:
    """Fit on at most ``spec.max_rows`` of the rows (doc_id, text, lang) with a text and a language, picked by a hash of doc_id."""
    rows = labelled.where(F.col("lang").isNotNull() & F.col("text").isNotNull()).select("doc_id", "text", "lang")
    counts = {r["lang"]: r["count"] for r in rows.groupBy("lang").count().collect()}
    if not counts:
        return Model((), np.zeros((1, 0), np.float32), np.zeros(0), 1.0, 0.0)
    share = spec.max_rows / len(counts)
    draw = F.pmod(F.xxhash64("doc_id", F.lit(spec.seed)), F.lit(1 << 30)) / float(1 << 30)
    wanted = F.lit(0.0)
    for lang, n in counts.items():
        wanted = F.when(F.col("lang") == lang, min(1.0, share / n)).otherwise(wanted)
    sample = counted(rows.where(draw < wanted), spec.buckets_log2).withColumn("h", F.xxhash64("grams", "lang")).orderBy("h").limit(spec.max_rows).collect()
    languages = tuple(sorted({r["lang"] for r in sample}))
    if not languages:
        return Model((), np.zeros((1, 0), np.float32), np.zeros(0), 1.0, 0.0)
    return _fit([(np.frombuffer(bytes(r["grams"]), np.int32).reshape(2, -1), languages.index(r["lang"])) for r in sample], languages, spec)


def _fit(sample: list[tuple[np.ndarray, int]], languages: tuple[str, ...], spec: TrainSpec) -> Model:
    rng = np.random.default_rng(spec.seed)
    sample = [(g[0], (g[1] / max(1, g[1].sum())).astype(np.float32), y) for g, y in sample if g.shape[1]]
    order = rng.permutation(len(sample))
    held = order[:int(len(order) * spec.calibration)] if len(order) >= 20 else order
    used = order[len(held):] if len(order) >= 20 else order
    emb = rng.normal(0, 0.3, ((1 << spec.buckets_log2) + 1, spec.dim)).astype(np.float32)
    out, bias = np.zeros((spec.dim, len(languages)), np.float32), np.zeros(len(languages), np.float32)
    steps, done = max(1, spec.epochs * len(used)), 0
    for _ in range(spec.epochs):
        for d in rng.permutation(used):
            idx, share, y = sample[d]
            rate = np.float32(spec.rate * (1 - done / steps))
            done += 1
            rows = emb[idx]
            x = share @ rows
            g = _softmax(x @ out + bias)
            g[y] -= 1
            back = out @ g
            out -= rate * np.outer(x, g)
            bias -= rate * np.float32(0.1) * g
            emb[idx] = rows - (rate * np.float32(spec.embedding_rate)) * share[:, None] * back
    table = (emb @ out).astype(np.float32)
    table[-1] = 0
    logits = np.array([s @ table[i] + bias for i, s, _ in (sample[d] for d in held)]) if len(held) else np.zeros((0, len(languages)))
    truth = np.array([sample[d][2] for d in held], int)
    temperature, threshold = _calibrate(logits, truth, spec.target_accuracy)
    return Model(languages, table, bias.astype(np.float64), temperature, threshold)


def _softmax(z: np.ndarray) -> np.ndarray:
    e = np.exp(z - z.max(axis=-1, keepdims=True))
    return e / e.sum(axis=-1, keepdims=True)


def _calibrate(logits: np.ndarray, truth: np.ndarray, target: float) -> tuple[float, float]:
    """The temperature with the best likelihood, and the lowest score at which accepted rows reach the accuracy."""
    if not len(truth):
        return 1.0, 0.0
    at = np.arange(len(truth))
    grid = np.geomspace(0.05, 20, 61)
    temperature = float(min(grid, key=lambda t: -np.log(np.maximum(_softmax(logits / t)[at, truth], 1e-12)).mean()))
    p = _softmax(logits / temperature)
    score, right = p.max(axis=1), p.argmax(axis=1) == truth
    order = np.argsort(score)
    accuracy = np.cumsum(right[order][::-1])[::-1] / np.arange(len(truth), 0, -1)
    good = np.flatnonzero(accuracy >= target)
    return temperature, 0.0 if not len(good) or good[0] == 0 else float(score[order][good[0]])


def predict(docs: DataFrame, model: Model) -> DataFrame:
    """``docs`` with lang_pred, score (0 to 1) and rejected; only ``text`` is read, and the whole of it.

    A null text, or one without any letter, is ``und`` with score 0 and rejected, as is every text when no language was
    learned. A text whose letters the buckets do not know gets the prior. Repeated rows get equal results; other columns
    pass through, and columns with the three new names are replaced. An empty table gives an empty table.
    """
    docs = docs.drop("lang_pred", "score", "rejected")
    at = docs.columns.index("text")
    schema = T.StructType([*docs.schema.fields, T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType()), T.StructField("rejected", T.BooleanType())])
    names = [*docs.columns, "lang_pred", "score", "rejected"]
    table, bias, temperature, threshold, languages = model.table, model.bias, model.temperature, model.threshold, np.array(model.languages, object)
    log2 = (len(table) - 1).bit_length() - 1 if len(languages) else 4

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            column = batch.column(at)
            for i, j, data, off in W.chunks(column):
                sizes, first, letter = subwords(data, off, log2)
                known = _has_letter(column, np.arange(i, j), letter) & bool(len(languages))
                if len(languages):
                    each = table[sizes[0]]
                    n = (sizes[0] < len(table) - 1).astype(np.int64)
                    for s in sizes[1:]:
                        each += table[s]
                        n += s < len(table) - 1
                    total = np.add.reduceat(each, first, axis=0, dtype=np.float64)
                    p = _softmax((total / np.maximum(1, np.add.reduceat(n, first))[:, None] + bias) / temperature)
                    lang, score = languages[p.argmax(axis=1)], p.max(axis=1)
                else:
                    lang, score = np.full(j - i, UNKNOWN, object), np.zeros(j - i)
                lang, score = np.where(known, lang, UNKNOWN), np.where(known, score, 0.0)
                yield pa.RecordBatch.from_arrays([*(c.slice(i, j - i) for c in batch.columns), pa.array(lang, pa.string()), pa.array(score), pa.array(~known | (score < threshold))], names=names)
    return docs.mapInArrow(run, schema)


def held_out(doc_id: str = "doc_id") -> F.Column:
    """The fifth of the documents that no classifier learns from; a row without an id is not held out, and not learned from."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string").cast("binary")) % 5 == 0, F.lit(False))


def learnable(docs: DataFrame) -> DataFrame:
    return docs.where((F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 != 0) & F.col("lang").isNotNull())
