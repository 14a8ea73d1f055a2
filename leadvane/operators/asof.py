"""As-of values within a key: the last one set at or before each row, carried over buckets of time."""
from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def carry_last(df: DataFrame, key: str, bucket: Column, order: Sequence[str], value: Column, name: str) -> DataFrame:
    """Adds ``name``: the last non-null ``value`` among a key's rows up to and including each row, in ``order``.

    ``bucket`` must not fall along the order. Rows are ordered within (key, bucket) only, so a key that holds a third of all rows is
    dealt over its buckets; what a bucket inherits comes from a table of one row for each key and bucket. Rows without a key are
    left as they are, with a null value.
    """
    rows = df.withColumns({"_bucket": bucket, "_value": value})
    known = rows.where(F.col(key).isNotNull())
    inside = Window.partitionBy(key, "_bucket").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    ends = known.groupBy(key, "_bucket").agg(F.max_by("_value", F.when(F.col("_value").isNotNull(), F.struct(*order))).alias("_end"))
    before = Window.partitionBy(key).orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    carried = ends.select(key, "_bucket", F.last("_end", ignorenulls=True).over(before).alias("_carried"))
    found = known.withColumn(name, F.last("_value", ignorenulls=True).over(inside)).join(carried, [key, "_bucket"], "left")
    found = found.withColumn(name, F.coalesce(name, "_carried")).drop("_carried")
    out = found.unionByName(rows.where(F.col(key).isNull()).withColumn(name, F.lit(None).cast(dict(found.dtypes)[name])))
    return out.drop("_bucket", "_value")
