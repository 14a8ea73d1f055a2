"""How whole rows move: the key by which joins that add columns deal them, and their columns as one text on the way."""
from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

_PACKED = "_packed"


def row_key(row_id: Column) -> Column:
    """``row_id`` as text, also where it is null. Joins on this same expression, one after the other, deal the rows once."""
    return F.coalesce(row_id.cast("string"), F.lit("\0"))


def packed(df: DataFrame, keep: Sequence[str], rest: Sequence[str]) -> DataFrame:
    """The columns ``keep``, and the columns ``rest`` in one text. A shuffle writes it in about half the bytes of many short columns."""
    return df.select(*keep, F.to_json(F.array(*[F.col(c).cast("string") for c in rest])).alias(_PACKED))


def unpacked(df: DataFrame, rest: Sequence[str], types: dict[str, str]) -> DataFrame:
    """``packed`` rows, joined or not, with the columns ``rest`` again, in place of any column of that name."""
    out = df.withColumn("_values", F.from_json(_PACKED, "array<string>"))
    return out.withColumns({c: F.get("_values", F.lit(i)).cast(types[c]) for i, c in enumerate(rest)}).drop(_PACKED, "_values")
