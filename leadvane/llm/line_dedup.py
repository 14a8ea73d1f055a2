"""Lines kept once across documents: sorted hash runs, first occurrences, and a keep bitmap for each document.

Texts never meet in a shuffle of lines: a line is a 128-bit hash with its place. The hashes are range-partitioned by
(hash, document, place), so a line that a third of all documents hold is spread over many sorted runs; each run streams
its first and last holder of a hash, and these few rows decide. What comes back to a text is its bitmap, run-length
compressed: the runs of lines to keep. DataFrame functions only.
"""
from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from leadvane.llm.common import ascii_lower, blank_trim, written

MIN_KEY = 10
_ROW = ("doc_id", "part")


def _lines(text: Column) -> Column:
    return F.split(F.coalesce(text, F.lit("")), "\n", -1)


def _parted(docs: DataFrame) -> DataFrame:
    """``docs`` with ``part``, which tells apart the texts of rows that repeat a doc_id."""
    return docs.withColumn("part", F.xxhash64("text"))


def line_index(docs: DataFrame, min_key: int = MIN_KEY) -> DataFrame:
    """h1, h2 (hash of the line's key), doc_id, part, pos: every line whose key has ``min_key`` code points, in sorted runs.

    The key is the line without blanks at its ends, A-Z lower-cased. Rows without a doc_id are left out.
    """
    lines = _parted(docs.select(F.col("doc_id").cast("long"), "text").where(F.col("doc_id").isNotNull()))
    lines = lines.select(*_ROW, F.posexplode(F.transform(_lines(F.col("text")), lambda x: blank_trim(x))).alias("pos", "line"))
    lines = lines.where(F.length("line") >= min_key).withColumn("line", ascii_lower(F.col("line")))
    hashed = lines.select(F.xxhash64("line").alias("h1"), F.xxhash64(F.lit("2"), "line").alias("h2"), *_ROW, "pos")
    order = ["h1", "h2", "doc_id", "part", "pos"]
    return written(written(hashed, "line-hash").repartitionByRange(*order).sortWithinPartitions(*order), "line-runs")


def keep_bitmaps(index: DataFrame) -> DataFrame:
    """doc_id, part, dropped array<struct<start,n>>: for each text that loses lines, the runs of lines that go.

    This is the run-length form of the document's bitmap; a text without a row keeps all lines.
    """
    first = index.groupBy("h1", "h2").agg(F.min("doc_id").alias("first"), F.max("doc_id").alias("last")).where(F.col("first") < F.col("last"))
    drops = index.join(first.select("h1", "h2", "first"), ["h1", "h2"]).where(F.col("doc_id") > F.col("first")).select(*_ROW, "pos").distinct()
    by_row = Window.partitionBy(*_ROW).orderBy("pos")
    runs = drops.withColumn("run", F.col("pos") - F.row_number().over(by_row)).groupBy(*_ROW, "run").agg(F.min("pos").alias("start"), F.count("*").cast("int").alias("n"))
    return runs.groupBy(*_ROW).agg(F.sort_array(F.collect_list(F.struct("start", "n"))).alias("dropped"))


def apply_bitmaps(docs: DataFrame, bitmaps: DataFrame) -> DataFrame:
    """``docs`` with n_lines and n_dropped added and ``text`` reduced to its kept lines (null becomes empty)."""
    rows = _parted(docs).join(bitmaps.hint("shuffle_hash"), list(_ROW), "left")
    lines = rows.withColumn("lines", _lines(F.col("text")))
    runs = F.col("dropped")
    ends = F.concat(F.array(F.lit(0)), F.transform(runs, lambda r: r["start"] + r["n"]))
    starts = F.concat(F.transform(runs, lambda r: r["start"]), F.array(F.size("lines")))
    kept = F.flatten(F.zip_with(ends, starts, lambda a, b: F.slice(F.col("lines"), a + 1, b - a)))
    out = lines.withColumn("n_lines", F.size("lines").cast("long"))
    out = out.withColumn("n_dropped", F.coalesce(F.aggregate(runs, F.lit(0), lambda a, r: a + r["n"]), F.lit(0)).cast("long"))
    out = out.withColumn("text", F.when(runs.isNull(), F.coalesce("text", F.lit(""))).otherwise(F.array_join(kept, "\n")))
    return out.drop("lines", "dropped", "part")


def dedup_lines(docs: DataFrame, min_key: int = MIN_KEY) -> DataFrame:
    """``docs`` with every line that an earlier document holds removed; n_lines and n_dropped are added.

    A line counts when its key has ``min_key`` code points and at least two documents hold it; the smallest doc_id keeps
    all of its copies. Null and empty texts are one empty line and stay empty. Rows that repeat a doc_id are one document
    and never take lines from each other; a row without a doc_id keeps every line. Other columns pass through; columns
    named part, lines, dropped, n_lines or n_dropped are replaced. An empty table gives an empty table.
    """
    docs = docs.drop("part", "lines", "dropped", "n_lines", "n_dropped")
    return apply_bitmaps(docs, keep_bitmaps(line_index(docs, min_key)))
