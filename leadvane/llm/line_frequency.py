"""Quality rules on texts: counts of each document, and lines that too many documents of one host hold.

The counts of a document come from one Arrow pass over its text. For the second rule lines are normalised and hashed to
128 bits together with their host; documents are counted per hash, lines above the limit leave their texts, and a document
that loses most of its words this way is rejected. No text meets another one: a line travels as its hash and place.
"""
from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.functions import arrow_udf
from pyspark.sql.types import LongType, StructField, StructType

from leadvane.llm.common import BLANKS, ascii_lower, keyed, written
from leadvane.llm.line_dedup import apply_bitmaps
from leadvane.llm.words import chunks, split, windows

#: A line that more documents of its host hold is boilerplate there.
MAX_DOCS = 20
#: A document that loses more than so many percent of its words with such lines is depleted.
MAX_LOST = 50
MIN_WORDS = 50
MAX_REPEATED = 50
SYMBOLS = b"#*$%&|<>"
REPEAT_WIDTH = 3

_ROW = ("doc_id", "part")
_COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
_MADE = (*_COUNTS, "base_failed", "n_lost_words", "kept", "part", "n_lines", "n_dropped")


def _per_text(flags: np.ndarray, off: np.ndarray) -> np.ndarray:
    """How many of ``flags`` lie in each text of a chunk."""
    sums = np.zeros(len(flags) + 1, np.int64)
    np.cumsum(flags, out=sums[1:])
    return np.diff(sums[off])


def _codes(data: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """A number for each byte string ``data[start:end]``, equal for equal strings; compared in full, not by hash."""
    size = end - start
    bounds = np.zeros(len(size) + 1, np.int64)
    np.cumsum(size, out=bounds[1:])
    inside = np.zeros(len(data) + 1, np.int32)
    np.add.at(inside, start, 1)
    np.add.at(inside, end, -1)
    joined = data[np.cumsum(inside[:-1]) > 0]
    buffers = [None, pa.py_buffer(bounds), pa.py_buffer(joined.tobytes())]
    return pa.Array.from_buffers(pa.large_binary(), len(size), buffers).dictionary_encode().indices.to_numpy(zero_copy_only=False).astype(np.int64)


def _repeated(code: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Which words lie in a window of three that its text holds twice or more."""
    at, text = windows(code, first, REPEAT_WIDTH)
    marks = np.zeros(len(code) + 1, np.int32)
    if len(at):
        key = text
        for i in range(REPEAT_WIDTH):
            _, key = np.unique(key * (code.max() + 1) + code[at + i], return_inverse=True)
        again = at[np.bincount(key)[key] > 1]
        np.add.at(marks, again, 1)
        np.add.at(marks, again + REPEAT_WIDTH, -1)
    return np.cumsum(marks[:-1]) > 0


def _repeated_lines(data: np.ndarray, off: np.ndarray, in_word: np.ndarray) -> np.ndarray:
    """For each text of a chunk, its lines that hold a word and equal an earlier line."""
    breaks = np.flatnonzero(data == 10)
    start = np.union1d(off[:-1], breaks + 1)
    end = np.append(start[1:], off[-1])
    end = np.where((end > start) & np.isin(end - 1, breaks), end - 1, end)
    words = np.zeros(len(data) + 1, np.int64)
    np.cumsum(in_word, out=words[1:])
    held = words[end] > words[start]
    start, end = start[held], end[held]
    text = np.searchsorted(off, start, side="right") - 1
    code = _codes(data, start, end)
    seen = np.unique(np.stack([text, code]), axis=1)[0]
    n = len(off) - 1
    return np.bincount(text, minlength=n) - np.bincount(seen, minlength=n)


@arrow_udf(StructType([StructField(name, LongType()) for name in _COUNTS]))
def text_counts(texts: pa.Array) -> pa.Array:
    """n_words, word_chars, n_symbols, n_dup_lines and n_repeat_words of each text; a null text has none of them."""
    symbol = np.zeros(256, bool)
    symbol[list(SYMBOLS)] = True
    found = {name: np.zeros(len(texts), np.int64) for name in _COUNTS}
    for i, j, data, off in chunks(texts):
        start, end, first = split(data, off)
        border = np.zeros(len(data) + 1, np.int32)
        np.add.at(border, start, 1)
        np.add.at(border, end, -1)
        in_word = np.cumsum(border[:-1]) > 0
        found["n_words"][i:j] = np.diff(first)
        found["word_chars"][i:j] = _per_text(in_word & ((data & 0xC0) != 0x80), off)
        found["n_symbols"][i:j] = _per_text(symbol[data], off)
        found["n_dup_lines"][i:j] = _repeated_lines(data, off, in_word)
        found["n_repeat_words"][i:j] = _per_text(_repeated(_codes(data, start, end), first), first)
    return pa.StructArray.from_arrays([pa.array(found[name]) for name in _COUNTS], list(_COUNTS))


def normal_line(line: Column) -> Column:
    """``line`` with A-Z lower-cased, every digit as 0, runs of blanks as one space and none at its ends."""
    squeezed = F.btrim(F.regexp_replace(line, f"[{BLANKS}]+", " "))
    return F.regexp_replace(ascii_lower(squeezed), "[0-9]", "0")


def host_lines(docs: DataFrame) -> DataFrame:
    """h1, h2 (hash of host and normalised line), doc_id, part, pos, words: every line with a word of rows with a doc_id."""
    lines = F.posexplode(F.split("text", "\n", -1)).alias("pos", "line")
    rows = docs.where("doc_id IS NOT NULL").select(*_ROW, "source", lines).withColumn("line", normal_line(F.col("line")))
    rows = rows.where(F.length("line") > 0).withColumn("words", F.size(F.split("line", " ")))
    host = F.struct(F.col("source").isNull(), F.coalesce("source", F.lit("")))
    return rows.select(F.xxhash64(host, "line").alias("h1"), F.xxhash64(F.lit("2"), host, "line").alias("h2"), *_ROW, "pos", "words")


def common_lines(lines: DataFrame, max_docs: int = MAX_DOCS) -> DataFrame:
    """h1, h2 of the lines that more than ``max_docs`` documents of a host hold.

    A document's copies of a line become one row before documents are counted, and both steps combine within each task,
    so a line that a third of all documents hold reaches the count as one row a task.
    """
    return lines.select("h1", "h2", "doc_id").distinct().groupBy("h1", "h2").agg(F.count("*").alias("n")).where(F.col("n") > max_docs).select("h1", "h2")


def lost_lines(lines: DataFrame, common: DataFrame) -> DataFrame:
    """doc_id, part, n_lost_words, dropped array<struct<start,n>>: for each text with common lines, their words and runs."""
    lost = keyed(lines, common).select(*_ROW, "pos", "words").distinct()
    by_row = Window.partitionBy(*_ROW).orderBy("pos")
    runs = lost.withColumn("run", F.col("pos") - F.row_number().over(by_row)).groupBy(*_ROW, "run").agg(
        F.min("pos").alias("start"), F.count("*").cast("int").alias("n"), F.sum("words").alias("words"))
    return runs.groupBy(*_ROW).agg(F.sum("words").alias("n_lost_words"), F.sort_array(F.collect_list(F.struct("start", "n"))).alias("dropped"))


def judge(docs: DataFrame, max_docs: int = MAX_DOCS, max_lost: int = MAX_LOST) -> DataFrame:
    """``docs`` (doc_id, text, source) with counts, verdicts, and texts without the lines that their host repeats.

    base_failed: fewer than 50 words, or more than half of them in repeated windows of three. n_lost_words: words on lines
    that more than ``max_docs`` documents of the same source hold, compared as ``normal_line``. kept: not base_failed, and
    at most ``max_lost`` percent of the words lost. ``text`` keeps its other lines.

    Null and empty texts have no words and fail; a null source is one host of its own. Rows that repeat a doc_id count as
    one document and are judged each on its own text; a row without a doc_id counts nowhere and loses no line. Other
    columns pass through; columns with the names of results are replaced. An empty table gives an empty table.
    """
    docs = docs.drop(*_MADE).withColumn("doc_id", F.col("doc_id").cast("long")).withColumn("part", F.xxhash64("text"))
    lines = host_lines(docs)
    lost = lost_lines(lines, written(common_lines(lines, max_docs), "common-lines"))
    rows = apply_bitmaps(docs.withColumn("_counts", text_counts("text")), lost)
    for name in _COUNTS:
        rows = rows.withColumn(name, F.col("_counts")[name])
    rows = rows.withColumn("n_lost_words", F.coalesce("n_lost_words", F.lit(0)).cast("long"))
    rows = rows.withColumn("base_failed", (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > MAX_REPEATED * F.col("n_words")))
    return rows.withColumn("kept", ~F.col("base_failed") & (100 * F.col("n_lost_words") <= max_lost * F.col("n_words"))).drop("_counts", "n_lines", "n_dropped")
