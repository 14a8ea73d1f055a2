"""CSV files whose quoted cells hold line breaks, read in splits.

A line break ends a record only where an even number of quotes lies before it. Each split counts its lines' quotes on its
own and numbers the records for both cases, an even or an odd number of quotes before the split; the splits' sums, added up
in the order of a file, then tell which case holds. Lines that continue a record of an earlier split are dealt to it.
"""
from __future__ import annotations

from collections.abc import Iterable, Iterator, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

OPTIONS = {"escape": '"'}
_LINE = "file long, block long, line long, quotes long, even long, odd long, value string"


def _lines(spark: SparkSession, path: str) -> DataFrame:
    """file (a hash of its path), block (start of the split), value."""
    return spark.read.text(path).select(F.xxhash64("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"), "value")


def _number(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Numbers the lines of each split, and its records if the quotes before the split are even or odd (0: none has begun)."""
    split, line, before, records = None, 0, 0, [0, 0]
    for batch in batches:
        files, blocks = (batch.column(c).to_numpy(zero_copy_only=False) for c in ("file", "block"))
        quotes = pc.count_substring(batch.column("value").fill_null(""), '"').to_numpy(zero_copy_only=False).astype(np.int64)
        border = np.flatnonzero((np.diff(files) != 0) | (np.diff(blocks) != 0)) + 1
        numbers, starts = np.zeros(len(quotes), np.int64), np.zeros((2, len(quotes)), np.int64)
        for i, j in zip([0, *border], [*border, len(quotes)]):
            if i == j:
                continue
            if (files[i], blocks[i]) != split:
                split, line, before, records = (files[i], blocks[i]), 0, 0, [0, 0]
            numbers[i:j] = line + np.arange(j - i)
            seen = before + np.cumsum(quotes[i:j])
            inside = (seen - quotes[i:j]) % 2
            for case in (0, 1):
                starts[case, i:j] = records[case] + np.cumsum(inside == case)
                records[case] = int(starts[case, j - 1])
            line, before = line + j - i, int(seen[-1])
        made = [batch.column("file"), batch.column("block"), *(pa.array(x) for x in (numbers, quotes, *starts)), batch.column("value")]
        yield pa.RecordBatch.from_arrays(made, names=["file", "block", "line", "quotes", "even", "odd", "value"])


def records(spark: SparkSession, path: str) -> DataFrame:
    """first, record: the text of every record, its lines joined by a line feed, and whether it is the first of its file.

    Blank records are left out. A quote that never closes makes the rest of its file one record, as for any CSV reader.
    """
    lines = _lines(spark, path).mapInArrow(_number, _LINE)
    splits = lines.groupBy("file", "block").agg(F.sum("quotes").alias("quotes"), F.max("even").alias("even"), F.max("odd").alias("odd"))
    earlier = Window.partitionBy("file").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)  # one row for each split of a file
    splits = splits.withColumn("case", F.coalesce(F.sum("quotes").over(earlier), F.lit(0)) % 2)
    splits = splits.withColumn("n", F.when(F.col("case") == 0, F.col("even")).otherwise(F.col("odd")))
    owner = F.last(F.when(F.col("n") > 0, F.struct("block", "n")), ignorenulls=True).over(earlier)
    dealt = lines.drop("quotes").join(splits.select("file", "block", "case", owner.alias("owner")), ["file", "block"])
    number = F.when(F.col("case") == 0, F.col("even")).otherwise(F.col("odd"))
    dealt = dealt.select("file", "block", "line", "value", F.when(number > 0, F.struct("block", number.alias("n"))).otherwise(F.col("owner")).alias("of"))
    whole = dealt.groupBy("file", "of").agg(F.sort_array(F.collect_list(F.struct("block", "line", "value"))).alias("lines"))
    text = F.array_join(F.transform("lines", lambda x: x["value"]), "\n")
    return whole.select(((F.col("of.block") == 0) & (F.col("of.n") == 1)).alias("first"), text.alias("record")).where(F.length(F.trim("record")) > 0)


def read_text_csv(spark: SparkSession, path: str, columns: Sequence[str] | None = None) -> DataFrame:
    """The cells of CSV files with a header, all text; ``columns`` names them where the header has been read before.

    Files in which every line closes its quotes are read line by line. Otherwise records are put together first; either way
    a large file is read by as many tasks as it has splits.
    """
    names = list(columns) if columns is not None else spark.read.option("header", True).csv(path).columns
    schema = T.StructType([T.StructField(c, T.StringType()) for c in names])
    open_lines = spark.read.text(path).where((F.length("value") - F.length(F.replace("value", F.lit('"')))) % 2 == 1)
    if open_lines.isEmpty():
        return spark.read.option("header", True).options(**OPTIONS).schema(schema).csv(path)
    rows = records(spark, path).where(~F.col("first")).select(F.from_csv("record", _ddl(names), OPTIONS).alias("r"))
    return rows.select("r.*")


def _ddl(names: Sequence[str]) -> str:
    return ", ".join(f"`{c.replace('`', '``')}` string" for c in names)
