"""Rolling-origin splits, calibration windows, folds and samples as row masks."""
from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass
from functools import reduce

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from leadvane.config import MIN_TEST_CLASS, MIN_TEST_LEADS
from leadvane.operators.labels import at
from leadvane.operators.ranking import hash_order, with_global_rank


# fixed values: variant -> whether labels wait for the horizon, the moment training rows must be mature at, months tested
VARIANTS = {
    "strict": (True, "split", 1),
    "relaxed": (True, "as_of", 1),
    "legacy window": (False, None, 1),
    "legacy to end": (False, None, None),
}


@dataclass(frozen=True)
class Span:
    """Creation times from ``start``, before ``end`` and not after ``last``; an absent bound is open."""

    start: str | None = None
    end: str | None = None
    last: str | None = None

    def holds(self) -> Column:
        created = F.col("created_at")
        bounds = ((self.start, created.__ge__), (self.end, created.__lt__), (self.last, created.__le__))
        return reduce(Column.__and__, [test(at(moment)) for moment, test in bounds if moment is not None], created.isNotNull())


@dataclass(frozen=True)
class Origin:
    """One row of the window table: a variant at a split date with the spans of its training and test rows."""

    variant: str
    split: str
    waits: bool
    train: Span
    test: Span

    def masks(self, y: Column) -> tuple[Column, Column]:
        """(train, test) conditions of a row with label ``y``."""
        return y.isNotNull() & self.train.holds(), y.isNotNull() & self.test.holds()


def origin(variant: str, split: str, as_of: str, horizon_days: int) -> Origin:
    waits, mature_at, months = VARIANTS[variant]
    # the last creation time that is mature at a moment
    last = {k: str(pd.Timestamp(v) - pd.Timedelta(days=horizon_days)) for k, v in (("split", split), ("as_of", as_of))}
    end = None if months is None else str(pd.Timestamp(split) + pd.DateOffset(months=months))
    return Origin(variant, split, waits, Span(end=split, last=last.get(mature_at)), Span(split, end, last["as_of"] if waits else None))


def origins(splits: Sequence[str], as_of: str, horizon_days: int) -> list[Origin]:
    return [origin(v, s, as_of, horizon_days) for v in VARIANTS for s in splits]


def rolling_rows(df: DataFrame, windows: Sequence[Origin], y: dict[bool, str], keep: Sequence[str]) -> DataFrame:
    """Rows of every (variant, split) they train or test in, in one scan; ``y[waits]`` names the label column."""
    cells = []
    for o in windows:
        label = F.col(y[o.waits])
        train, test = o.masks(label)
        cells.append(F.struct(F.lit(o.variant).alias("variant"), F.lit(o.split).alias("split"), train.alias("is_train"),
                              test.alias("is_test"), label.alias("y")))
    used = F.filter(F.array(*cells), lambda c: c["is_train"] | c["is_test"])
    return df.select(*keep, F.explode(used).alias("c")).select(*keep, "c.*")


def split_sizes(rows: DataFrame) -> DataFrame:
    """Sizes per (variant, split) and whether its test set is large enough for the headline."""
    counted = rows.groupBy("variant", "split").agg(
        F.count_if("is_train").alias("n_train"), F.count_if(F.col("is_train") & (F.col("y") == 1)).alias("wins_train"),
        F.count_if("is_test").alias("n_test"), F.count_if(F.col("is_test") & (F.col("y") == 1)).alias("wins_test"))
    enough = ((F.col("n_test") >= MIN_TEST_LEADS) & (F.col("wins_test") >= MIN_TEST_CLASS)
              & (F.col("n_test") - F.col("wins_test") >= MIN_TEST_CLASS))
    return counted.withColumns({
        "sufficient": enough,
        "status": F.when((F.col("wins_train") == 0) | (F.col("wins_train") == F.col("n_train")), "no fit")
        .when(F.col("n_test") == 0, "no test leads").when(~enough, "insufficient").otherwise("ok")})


def decay_windows(months: Sequence[str], k: int = 3) -> list[tuple[str, str, list[str]]]:
    """(fit month, cutoff date, evaluation months) of the calibration-decay study."""
    def shift(month: str, n: int) -> str:
        y, m = map(int, month.split("-"))
        total = y * 12 + m - 1 + n
        return f"{total // 12:04d}-{total % 12 + 1:02d}"
    return [(m, f"{shift(m, 1)}-01", [shift(m, 1 + j) for j in range(k)]) for m in months]


def with_folds(df: DataFrame, folds: int, key: str = "lead_id", label: str = "y", seed: int = 0) -> DataFrame:
    """Balanced, label-stratified fold numbers from a hashed order of the rows of each class."""
    hashed = df.withColumn("_h", hash_order(F.col(key), seed))
    ranked = with_global_rank(hashed, [F.col(label), F.col("_h"), F.col(key)])
    starts = ranked.groupBy(label).agg(F.min("rank").alias("_start"))
    return (ranked.join(starts, label).withColumn("fold", ((F.col("rank") - F.col("_start")) % folds).cast("int"))
            .drop("_h", "rank", "_start"))


def hash_cuts(pool: DataFrame, key: str, sizes: Sequence[int], seeds: Sequence[int]) -> dict[tuple[int, int], int]:
    """Hash value of the n-th row in every seed's order: rows at or below it are that seed's sample of size n.

    Hashes are counted per slice of their range with map-side combine; only the rows of the cut slices are ordered, and
    only (sizes x seeds) numbers are returned.
    """
    slices = min(max(int(pool.sparkSession.conf.get("spark.sql.shuffle.partitions")), 64), 4096)
    each = F.explode(F.array(*[F.struct(F.lit(s).alias("seed"), hash_order(F.col(key), s).alias("h")) for s in seeds]))
    rows = pool.select(F.col(key).alias("_key"), each.alias("e")).select("_key", "e.*").withColumn(
        "slice", F.floor(F.col("h") * slices / F.lit(2147483647)).cast("int"))
    counts = rows.groupBy("seed", "slice").agg(F.count("*").alias("n"))
    before = W.partitionBy("seed").orderBy("slice").rowsBetween(W.unboundedPreceding, -1)
    placed = counts.withColumn("off", F.coalesce(F.sum("n").over(before), F.lit(0)))
    hit = F.filter(F.array(*[F.lit(s) for s in sizes]), lambda s: (s > F.col("off")) & (s <= F.col("off") + F.col("n")))
    cut = placed.select("seed", "slice", "off", F.explode(hit).alias("size"))
    inside = rows.join(F.broadcast(cut), ["seed", "slice"])  # one row per (size, seed); by its plan Spark may take the rows for smaller
    rn = F.row_number().over(W.partitionBy("seed", "size").orderBy("h", "_key"))  # rows of one slice
    found = inside.withColumn("rn", rn).where(F.col("off") + F.col("rn") == F.col("size")).select("seed", "size", "h").collect()
    return {(r["size"], r["seed"]): r["h"] for r in found}
