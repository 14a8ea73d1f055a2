"""Repeated passages by a sparse suffix array.

Only suffixes at content-selected minimisers are kept: of any ``min_words`` equal words, the same suffix start lies within
the first ``width`` words in both places, with at least ``min_words - width + 1`` equal words behind it. Starts whose next
words occur in one document alone cannot be in a repeat and leave first. Of the others, those whose whole context (up to
``width - 1`` words before and ``min_words`` behind) another document holds are repeated as far as it goes. Around the rest,
every run of ``min_words`` words that holds the start is looked up among those of all contexts with the same next words. So
a start meets every partner, not its neighbours in an order alone, and no result depends on partitions. Contexts and runs
are compared by two 64-bit hashes.
"""
from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from leadvane.llm import words as W
from leadvane.llm.common import written


@dataclass(frozen=True)
class SuffixSpec:
    min_words: int = 50
    gram: int = 5
    width: int = 25

    @property
    def right(self) -> int:
        """Equal words behind the first suffix start of any repeat."""
        return self.min_words - self.width + 1


def _parted(docs: DataFrame) -> DataFrame:
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("part"), "text")


def _starts(docs: DataFrame, spec: SuffixSpec) -> DataFrame:
    """prefix (hash of the next words), doc_id, part, pos of each kept suffix; one row with null prefix has pos = words.

    A suffix also has its context: another hash of all words that a repeat around it can compare, ``before`` and ``after`` it.
    """
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, parts = batch.column(0), batch.column(1).to_numpy()
            for i, j, data, off in W.chunks(batch.column(2)):
                start, end, first = W.split(data, off)
                word = W.word_hashes(data, start, end)
                at, text = W.windows(word, first, spec.gram + spec.width - 1)
                pos = np.zeros(0, np.int64)
                if len(at):
                    grams = np.arange(len(word) - spec.gram + 1)
                    pos = np.unique(W.selected(W.run_hash(word, grams, grams + spec.gram), spec.width)[at])
                    text = np.searchsorted(first, pos, side="right") - 1
                    fits = (pos + spec.right <= first[1:][text]) & (np.diff(first)[text] >= spec.min_words)
                    pos, text = pos[fits], text[fits]
                prefix = W.run_hash(word, pos, pos + spec.right)
                before = np.minimum(pos - first[text[:len(pos)]], spec.width - 1)
                after = np.minimum(first[1:][text[:len(pos)]] - pos, spec.min_words)
                context = W.mix(W.run_hash(W.mix(~word), pos - before, pos + after) + before.astype(W.U))
                no = pa.nulls(j - i, pa.int32())
                rows = np.concatenate([text[:len(pos)], np.arange(j - i)]).astype(np.int64)
                yield pa.RecordBatch.from_arrays(
                    [pa.concat_arrays([W.longs(prefix), pa.nulls(j - i, pa.int64())]), ids.slice(i, j - i).take(pa.array(rows)), pa.array(parts[i:j][rows]),
                     pa.array(np.concatenate([pos - first[text[:len(pos)]], np.diff(first)]).astype(np.int32)), pa.concat_arrays([W.longs(context), pa.nulls(j - i, pa.int64())]),
                     pa.concat_arrays([pa.array(before.astype(np.int32)), no]), pa.concat_arrays([pa.array(after.astype(np.int32)), no])], names=["prefix", "doc_id", "part", "pos", "context", "before", "after"])
    return _parted(docs).mapInArrow(run, "prefix long, doc_id long, part long, pos int, context long, before int, after int")


def _windows(docs: DataFrame, starts: DataFrame, spec: SuffixSpec) -> DataFrame:
    """doc_id, part, pos, d0, d1 of the given suffix starts, each with windows: two hashes of every ``min_words`` words that begin
    ``back`` (less than ``width``) words before the start."""
    back = np.arange(spec.width)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, parts = batch.column(0).to_numpy(), batch.column(1).to_numpy()
            for i, j, data, off in W.chunks(batch.column(2)):
                start, end, first = W.split(data, off)
                word = W.word_hashes(data, start, end)
                lists = batch.column(3).slice(i, j - i)
                text = np.repeat(np.arange(j - i), lists.value_lengths().to_numpy())
                low, high, near = (pa.compute.struct_field(lists.flatten(), f) for f in ("d0", "d1", "pos"))
                pos = near.to_numpy().astype(np.int64)
                begin = (pos + first[text])[:, None] - back
                inside = (begin >= first[text][:, None]) & (begin + spec.min_words <= first[text + 1][:, None])
                at = begin[inside]
                n = np.concatenate([[0], np.cumsum(inside.sum(axis=1))]).astype(np.int32)
                two = [W.longs(W.run_hash(x, at, at + spec.min_words)) for x in (word, W.mix(~word))]
                cells = pa.StructArray.from_arrays([pa.array(np.nonzero(inside)[1].astype(np.int32)), *two], names=["back", "a", "b"])
                yield pa.RecordBatch.from_arrays([pa.array(ids[i:j][text]), pa.array(parts[i:j][text]), pa.array(pos.astype(np.int32)), low, high, pa.ListArray.from_arrays(pa.array(n), cells)],
                                                 names=["doc_id", "part", "pos", "d0", "d1", "windows"])
    lists = starts.groupBy("doc_id", "part").agg(F.collect_list(F.struct("pos", "d0", "d1")).alias("starts"))
    rows = _parted(docs).join(lists.hint("shuffle_hash"), ["doc_id", "part"])
    return rows.select("doc_id", "part", "text", "starts").mapInArrow(run, "doc_id long, part long, pos int, d0 long, d1 long, windows array<struct<back:int,a:long,b:long>>")


def repeated_passages(docs: DataFrame, spec: SuffixSpec = SuffixSpec()) -> DataFrame:
    """doc_id, n_words, n_repeated, spans array<struct<start,stop>>: words inside passages that another document holds too.

    Words are parted by blanks and compared unchanged. Every span is part of a passage of at least ``min_words`` words in
    two documents, and every such passage is found. A null or empty text has no words. Rows that repeat a doc_id are one
    document; rows without one take no part. Other columns are ignored. An empty table gives no rows.
    """
    starts = written(_starts(docs, spec), "suffix-starts")
    prefix, context = Window.partitionBy("prefix"), Window.partitionBy("prefix", "context")
    met = starts.where(F.col("prefix").isNotNull() & F.col("doc_id").isNotNull())
    met = met.withColumn("p0", F.min("doc_id").over(prefix)).withColumn("p1", F.max("doc_id").over(prefix)).where("p0 <> p1")
    met = met.withColumn("d0", F.min("doc_id").over(context)).withColumn("d1", F.max("doc_id").over(context))
    met = met.withColumn("nth", F.row_number().over(context.orderBy("doc_id", "part", "pos"))).withColumn("open", F.max(F.expr("d0 = d1")).over(prefix))
    met = written(met.select("doc_id", "part", "pos", "before", "after", "d0", "d1", F.expr("d0 = d1 OR open AND nth = 1").alias("asked")), "suffixes")
    # a context that two documents hold is repeated as a whole; the others meet one start of every context by their windows
    whole = met.where("d0 <> d1").select("doc_id", "part", (F.col("pos") - F.col("before")).alias("start"), (F.col("pos") + F.col("after")).alias("stop"))
    near = written(_windows(docs, met.where("asked").select("doc_id", "part", "pos", "d0", "d1"), spec), "suffix-windows")
    near = near.select("doc_id", "part", "pos", "d0", "d1", F.inline("windows"))
    shared = near.groupBy("a", "b").agg(F.min("d0").alias("d0"), F.max("d1").alias("d1")).where("d0 <> d1").select("a", "b")
    spans = near.where("d0 = d1").join(shared, ["a", "b"], "left_semi").groupBy("doc_id", "part", "pos").agg(F.max("back").alias("far"), F.min("back").alias("close"))
    # all windows of a start hold the start, so those that repeat cover one stretch
    spans = spans.select("doc_id", "part", (F.col("pos") - F.col("far")).alias("start"), (F.col("pos") - F.col("close") + spec.min_words).alias("stop")).union(whole).distinct()

    before = Window.partitionBy("doc_id", "part").orderBy("start", "stop")
    spans = spans.withColumn("seen", F.max("stop").over(before.rowsBetween(Window.unboundedPreceding, -1)))
    spans = spans.withColumn("run", F.sum(F.when(F.col("start") > F.col("seen"), 1).otherwise(0)).over(before.rowsBetween(Window.unboundedPreceding, 0)))
    spans = spans.groupBy("doc_id", "part", "run").agg(F.min("start").alias("start"), F.max("stop").alias("stop"))
    spans = spans.groupBy("doc_id", "part").agg(F.sum(F.col("stop") - F.col("start")).cast("long").alias("n_repeated"), F.sort_array(F.collect_list(F.struct("start", "stop"))).alias("spans"))
    out = starts.where("prefix IS NULL").select("doc_id", "part", F.col("pos").cast("long").alias("n_words")).join(spans, ["doc_id", "part"], "left")
    return out.select("doc_id", "n_words", F.coalesce("n_repeated", F.lit(0).cast("long")).alias("n_repeated"), F.coalesce("spans", F.array().cast("array<struct<start:int,stop:int>>")).alias("spans"))
