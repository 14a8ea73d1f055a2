"""Level dictionaries of columns with any number of levels: learned, stored and joined as tables."""
from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from leadvane.config import MISSING
from leadvane.functions.text import text_or_null
from leadvane.operators.ranking import ranks

#: Ids below the first level: a blank cell, and a level that is not in the dictionary.
MISSING_ID, OTHER_ID, FIRST_ID = 0, 1, 2
#: A level with more than one in so many rows is heavy; there are at most so many of them.
HEAVY = 1000


def level_dictionary(train: DataFrame, column: str, min_count: int) -> DataFrame:
    """level, n, id, heavy of the levels with ``min_count`` training rows; ids from 2 by falling count, ties by level.

    Nothing but the number of rows visits the driver, so a column may have any number of levels.
    """
    levels = train.select(text_or_null(F.col(column).cast("string")).alias("level")).where(F.col("level").isNotNull() & (F.col("level") != MISSING))
    counts = levels.groupBy("level").agg(F.count("*").alias("n")).where(F.col("n") >= min_count)
    placed = ranks(counts.withColumn("_down", -F.col("n")), "_down", "level", rank="id").drop("_down")
    total = train.count()
    return placed.select("level", "n", (F.col("id") + FIRST_ID - 1).cast("long").alias("id"), (F.col("n") * HEAVY > total).alias("heavy"))


def encode_ids(df: DataFrame, column: str, dictionary: DataFrame, output: str) -> DataFrame:
    """Adds the id of each row's level by the stored ``dictionary``.

    Rows of heavy levels, which may be a third of all, are looked up in a broadcast of at most ``HEAVY`` levels; only the
    others are shuffled to the rest of the dictionary.
    """
    rows = df.withColumn("_level", text_or_null(F.col(column).cast("string")))
    heavy = dictionary.where("heavy").select(F.col("level").alias("_level"), F.col("id").alias("_heavy"))
    first = rows.join(F.broadcast(heavy), "_level", "left")
    settled = F.col("_heavy").isNotNull() | F.col("_level").isNull() | (F.col("_level") == MISSING)
    done = first.where(settled).withColumn(output, F.coalesce("_heavy", F.lit(MISSING_ID)).cast("long"))
    light = dictionary.where("NOT heavy").select(F.col("level").alias("_level"), F.col("id").alias("_light"))
    rest = first.where(~settled).join(light, "_level", "left").withColumn(output, F.coalesce("_light", F.lit(OTHER_ID)).cast("long")).drop("_light")
    return done.unionByName(rest).drop("_level", "_heavy")
