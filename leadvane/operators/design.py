"""0/1 design of bucketed features, in wide and long form."""
from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.ml.feature import VectorAssembler
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from leadvane.config import LEVELS, V2_REFERENCES, design_columns


def unpivot(df: DataFrame, keep: Sequence[str], features: Sequence[str]) -> DataFrame:
    """One (feature, level) row per feature column, in one scan."""
    pairs = F.array(*[F.struct(F.lit(f).alias("feature"), F.col(f).cast("string").alias("level")) for f in features])
    return df.select(*keep, F.explode(pairs).alias("_p")).select(*keep, "_p.feature", "_p.level")


def unknown_levels(df: DataFrame, levels: Mapping[str, Sequence[str]] = LEVELS,
                   features: Sequence[str] | None = None) -> DataFrame:
    """Values outside the declared levels, with their row counts; empty when the data fits the design."""
    features = list(features or levels)
    allowed = F.create_map(*[x for f in features for x in (F.lit(f), F.array(*[F.lit(v) for v in levels[f]]))])
    long = unpivot(df, [], features).withColumn("level", F.coalesce("level", F.lit("<null>")))
    return (long.where(~F.array_contains(allowed[F.col("feature")], F.col("level")))
            .groupBy("feature", "level").agg(F.count("*").alias("n")))


def _indicator(feature: str, level: str, allowed: Sequence[str]) -> Column:
    value = F.col(feature).cast("string")
    refuse = F.raise_error(F.concat(F.lit(f"feature {feature} has a value outside its declared levels: "),
                                    F.coalesce(value, F.lit("<null>")))).cast("double")
    return F.when(value == level, 1.0).when(value.isin(*allowed), 0.0).otherwise(refuse)


def wide_design(df: DataFrame, references: Mapping[str, str | None] = V2_REFERENCES,
                levels: Mapping[str, Sequence[str]] = LEVELS, keep: Sequence[str] = ("lead_id",)) -> DataFrame:
    """Exactly the declared ``feature=level`` columns as doubles; an unknown level fails the job."""
    for f, ref in references.items():
        if f not in levels or (ref is not None and ref not in levels[f]):
            raise ValueError(f"feature {f!r}: no level list containing its reference level {ref!r}")
    return df.select(*keep, *[_indicator(f, lvl, levels[f]).alias(f"{f}={lvl}")
                              for f, ref in references.items() for lvl in levels[f] if lvl != ref])


def long_design(df: DataFrame, references: Mapping[str, str | None] = V2_REFERENCES,
                keep: Sequence[str] = ("lead_id",)) -> DataFrame:
    """Active design columns only: one ``(feature, level)`` row per non-reference value."""
    refs = F.create_map(*[x for f, r in references.items() for x in (F.lit(f), F.lit(r))])
    long = unpivot(df, keep, list(references))
    return long.where(F.col("level") != F.coalesce(refs[F.col("feature")], F.lit("")))


def design_counts(df: DataFrame, references: Mapping[str, str | None] = V2_REFERENCES,
                  levels: Mapping[str, Sequence[str]] = LEVELS) -> DataFrame:
    """Rows with a 1 per declared design column (absent levels count 0) and the number of rows."""
    cols = [(f, lvl) for f, ref in references.items() for lvl in levels[f] if lvl != ref]
    row = df.agg(F.count("*").alias("n"), *[F.count_if(F.col(f) == lvl).alias(f"c{i}")
                                            for i, (f, lvl) in enumerate(cols)])
    parts = F.array(*[F.struct(F.lit(f"{f}={lvl}").alias("column"), F.lit(f).alias("feature"),
                               F.col(f"c{i}").alias("leads_with_1")) for i, (f, lvl) in enumerate(cols)])
    return row.select(F.explode(parts).alias("p"), F.col("n").alias("leads")).select("p.*", "leads")


def observed_levels(df: DataFrame, references: Mapping[str, str | None]) -> DataFrame:
    """Data-driven design columns: every non-reference level that occurs, with its count."""
    return (long_design(df, references, keep=[]).groupBy("feature", "level").agg(F.count("*").alias("n"))
            .select(F.concat_ws("=", "feature", "level").alias("column"), "n"))


def with_vector(df: DataFrame, columns: Sequence[str] | None = None, output: str = "design") -> DataFrame:
    """Assembles design columns into one ML vector column."""
    safe = {c: f"_d{i}" for i, c in enumerate(columns or design_columns(V2_REFERENCES))}
    renamed = df.withColumns({new: F.col(f"`{old}`") for old, new in safe.items()})
    return VectorAssembler(inputCols=list(safe.values()), outputCol=output).transform(renamed).drop(*safe.values())
