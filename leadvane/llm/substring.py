"""Repeated runs of words, by seeds and their extension.

Seeds are winnowed: of any ``size`` consecutive words the same 5-word anchor is chosen wherever they stand, so equal runs
share an anchor at the same place. Each anchor is extended left and right over all runs of ``size`` words that chose it,
and carries the hash of that stretch, not the text. Anchors meet in one shuffle. Equal stretches are repeats as a whole;
where the stretches around one anchor differ, their first holders go back to the text and meet run by run. Overlapping
runs then form the maximal repeats.
"""
from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from leadvane.llm import words as W
from leadvane.llm.common import written

U = np.uint64


@dataclass(frozen=True)
class RepeatSpec:
    size: int = 13
    anchor: int = 5

    @property
    def width(self) -> int:
        return self.size - self.anchor + 1


def _parted(docs: DataFrame) -> DataFrame:
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("part"), "text")


def _hashed(data: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    start, end, first = W.split(data, off)
    return W.word_hashes(data, start, end), start, end, first


def seeds(docs: DataFrame, spec: RepeatSpec = RepeatSpec()) -> DataFrame:
    """anchor, stretch, doc_id, part, lo, n: ``n`` consecutive runs from word ``lo`` on chose the anchor."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, parts = batch.column(0).to_numpy(), batch.column(1).to_numpy()
            for i, j, data, off in W.chunks(batch.column(2)):
                word, _, _, first = _hashed(data, off)
                at, text = W.windows(word, first, spec.size)
                if not len(at):
                    continue
                grams = np.arange(len(word) - spec.anchor + 1)
                gram = W.run_hash(word, grams, grams + spec.anchor)
                chosen = W.selected(gram, spec.width)[at]
                new = np.ones(len(at), bool)
                new[1:] = (chosen[1:] != chosen[:-1]) | (text[1:] != text[:-1])
                head = np.flatnonzero(new)
                lo, n, chosen, text = at[head], np.diff(np.append(head, len(at))), chosen[head], text[head]
                stretch = W.mix(W.run_hash(word, lo, lo + n - 1 + spec.size) ^ (chosen - lo).astype(U))
                yield pa.RecordBatch.from_arrays(
                    [W.longs(gram[chosen]), W.longs(stretch), pa.array(ids[i:j][text]), pa.array(parts[i:j][text]), pa.array((lo - first[text]).astype(np.int32)), pa.array(n.astype(np.int32))],
                    names=["anchor", "stretch", "doc_id", "part", "lo", "n"])
    return _parted(docs.where(F.col("doc_id").isNotNull())).mapInArrow(run, "anchor long, stretch long, doc_id long, part long, lo int, n int")


def _listed(rows: DataFrame) -> DataFrame:
    return rows.groupBy("doc_id", "part").agg(F.collect_list(F.struct("lo", "n")).alias("runs"))


def _single_runs(docs: DataFrame, stretches: DataFrame, spec: RepeatSpec) -> DataFrame:
    """h1, h2, doc_id, part, lo: every run of the given stretches, hashed on its own."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, parts, runs = batch.column(0).to_numpy(), batch.column(1).to_numpy(), batch.column(3)
            for i, j, data, off in W.chunks(batch.column(2)):
                word, _, _, first = _hashed(data, off)
                lists = runs.slice(i, j - i)
                flat = lists.flatten()
                text = np.repeat(np.arange(j - i), lists.value_lengths().to_numpy())
                lo, n = flat.field(0).to_numpy().astype(np.int64), flat.field(1).to_numpy().astype(np.int64)
                inner = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
                rel, text = np.repeat(lo, n) + inner, np.repeat(text, n)
                at = rel + first[text]
                yield pa.RecordBatch.from_arrays(
                    [W.longs(W.run_hash(word, at, at + spec.size)), W.longs(W.run_hash(word, at + 1, at + spec.size - 1)), pa.array(ids[i:j][text]), pa.array(parts[i:j][text]), pa.array(rel.astype(np.int32))],
                    names=["h1", "h2", "doc_id", "part", "lo"])
    rows = _parted(docs).join(_listed(stretches).hint("shuffle_hash"), ["doc_id", "part"])
    return rows.select("doc_id", "part", "text", "runs").mapInArrow(run, "h1 long, h2 long, doc_id long, part long, lo int")


def repeats(docs: DataFrame, spec: RepeatSpec = RepeatSpec()) -> DataFrame:
    """doc_id, part, lo, n: ``n`` consecutive runs of ``spec.size`` words, from word ``lo`` on, that a smaller doc_id holds."""
    same, around = Window.partitionBy("anchor", "stretch"), Window.partitionBy("anchor")
    met = seeds(docs, spec).withColumn("first", F.min("doc_id").over(same))
    met = met.withColumn("s0", F.min("stretch").over(around)).withColumn("s1", F.max("stretch").over(around))
    met = met.withColumn("found", F.col("doc_id") > F.col("first")).where("found OR s0 <> s1")
    met = written(met.select("doc_id", "part", "lo", "n", "found"), "repeat-seeds")
    runs = _single_runs(docs, met.where("NOT found"), spec).withColumn("first", F.min("doc_id").over(Window.partitionBy("h1", "h2")))
    runs = runs.where(F.col("doc_id") > F.col("first")).select("doc_id", "part", "lo", F.lit(1).alias("n"))
    return met.where("found").select("doc_id", "part", "lo", "n").union(runs)


def remove_repeats(docs: DataFrame, spec: RepeatSpec = RepeatSpec()) -> DataFrame:
    """doc_id, n_words, n_removed, kept (text), kept_sha256: texts without the words of earlier documents' runs.

    A word goes if any run of ``spec.size`` consecutive words over it also starts in a document with a smaller doc_id;
    runs are judged on the input. Kept words are joined by one space. Null and empty texts have no words; texts of fewer
    words lose none. Rows that repeat a doc_id never take words from each other, a row without a doc_id takes no part and
    keeps its words. Other columns are ignored. An empty table gives no rows.
    """
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            runs = batch.column(2)
            for i, j, data, off in W.chunks(batch.column(1)):
                start, end, first = W.split(data, off)
                lists = runs.slice(i, j - i)
                flat = lists.flatten()
                base = first[:-1][np.repeat(np.arange(j - i), lists.value_lengths().fill_null(0).to_numpy())]
                lo, n = flat.field(0).to_numpy() + base, flat.field(1).to_numpy()
                step = np.zeros(len(start) + 1, np.int64)
                np.add.at(step, lo, 1)
                np.add.at(step, lo + n - 1 + spec.size, -1)
                keep = np.cumsum(step)[:-1] == 0
                kept = np.concatenate([[0], np.cumsum(keep)])[first]
                s, e = start[keep], end[keep]
                width = e - s + 1
                ends = np.cumsum(width)
                total = int(ends[-1]) if len(ends) else 0
                index = np.arange(total) + np.repeat(s - (ends - width), width)
                line = np.append(data, np.uint8(32))[index]
                line[ends - 1] = 32
                at = np.concatenate([[0], ends])[kept]
                texts = [line[a:max(a, b - 1)].tobytes() for a, b in zip(at[:-1].tolist(), at[1:].tolist())]
                n_words = np.diff(first)
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(i, j - i), pa.array(n_words.astype(np.int64)), pa.array((n_words - np.diff(kept)).astype(np.int64)), pa.array([t.decode() for t in texts], pa.string()),
                     pa.array([hashlib.sha256(t).hexdigest() for t in texts], pa.string())],
                    names=["doc_id", "n_words", "n_removed", "kept", "kept_sha256"])
    rows = _parted(docs).join(_listed(repeats(docs, spec)).hint("shuffle_hash"), ["doc_id", "part"], "left")
    return rows.select("doc_id", "text", "runs").mapInArrow(run, "doc_id long, n_words long, n_removed long, kept string, kept_sha256 string")
