"""Ranking and calibration metrics as grouped aggregates over (group, score) counts."""
from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from leadvane.config import TOP_FRACTION
from leadvane.operators.ranking import bucket_bounds, cut_parts, running_totals, ten_cuts, with_bucket


def auc(df: DataFrame, y: str = "y", score: str = "p", groups: Sequence[str] = (), weight: Column | None = None) -> DataFrame:
    """Area under the ROC curve per group (ties count half), with n, wins; null where a class is missing.

    Only (group, bucket) sums leave the bucket windows, so the last step sees one row per bucket.
    """
    w = F.lit(1) if weight is None else weight
    rows = df.where(F.col(y).isNotNull() & F.col(score).isNotNull()).withColumn("_g", F.lit(0))
    by = ["_g", *groups]
    counts = rows.groupBy(*by, score).agg(F.sum(F.when(F.col(y) == 1, w).otherwise(0)).alias("pos"),
                                          F.sum(F.when(F.col(y) == 1, 0).otherwise(w)).alias("neg"))
    b = with_bucket(counts, score, bucket_bounds(rows, score))
    inside = W.partitionBy(*by, "_bucket").orderBy(score).rowsBetween(W.unboundedPreceding, -1)
    below = F.coalesce(F.sum("neg").over(inside), F.lit(0))
    buckets = (b.withColumn("u", F.col("pos") * (below + F.col("neg") / 2)).groupBy(*by, "_bucket")
               .agg(F.sum("pos").alias("pos"), F.sum("neg").alias("neg"), F.sum("u").alias("u")))
    across = W.partitionBy(*by).orderBy("_bucket").rowsBetween(W.unboundedPreceding, -1)
    placed = buckets.withColumn("neg_below", F.coalesce(F.sum("neg").over(across), F.lit(0)))
    total = placed.groupBy(*by).agg(F.sum("pos").alias("wins"), F.sum("neg").alias("losses"),
                                    F.sum(F.col("u") + F.col("pos") * F.col("neg_below")).alias("u"))
    value = F.when((F.col("wins") > 0) & (F.col("losses") > 0),
                   F.col("u").cast("double") / (F.col("wins").cast("double") * F.col("losses").cast("double")))
    return total.select(*groups, (F.col("wins") + F.col("losses")).alias("n"), "wins", value.alias("auc"))


def brier(y: str = "y", p: str = "p") -> Column:
    clipped = F.least(F.greatest(F.col(p), F.lit(0.0)), F.lit(1.0))
    return F.avg((F.col(y) - clipped) * (F.col(y) - clipped))


def top_share(df: DataFrame, score: str, targets: Sequence[str], groups: Sequence[str] = (),
              fraction: float = TOP_FRACTION) -> DataFrame:
    """Share of each target held by the top fraction, rows tied at the cut sharing credit equally.

    Columns: ``n``, ``cut_size``, ``threshold``, ``ties_at_cut`` and ``<target>_share`` per group.
    """
    rows = df.where(F.col(score).isNotNull())
    sums = rows.groupBy(*groups, score).agg(F.count("*").alias("n"),
                                            *[F.sum(F.col(t).cast("double")).alias(f"t_{t}") for t in targets])
    measures = ["n", *[f"t_{t}" for t in targets]]
    ranked = running_totals(sums, score, measures, groups, bucket_bounds(rows, score))
    cut = F.floor(F.col("n_total") * F.lit(float(fraction)))
    above = {m: F.col(f"{m}_total") - F.col(f"{m}_before") - F.col(m) for m in measures}
    at_cut = ranked.where((above["n"] < cut) & (cut <= above["n"] + F.col("n")))
    credit = (cut - above["n"]) / F.col("n")
    shares = [((above[f"t_{t}"] + credit * F.col(f"t_{t}")) / F.col(f"t_{t}_total")).alias(f"{t}_share") for t in targets]
    return at_cut.select(*groups, F.col("n_total").alias("rows"), cut.alias("cut_size"),
                         F.col(score).alias("threshold"), F.col("n").alias("ties_at_cut"), *shares)


def bottom_share(df: DataFrame, flags: Sequence[str], score: str, key: str, fraction: float, group: str) -> DataFrame:
    """Rows, and the mean of each flag over all rows and over the ``int(n x fraction)`` lowest-scored rows (ties in key order), per group."""
    parted = cut_parts(df, score, key, lambda n: [F.floor(n * F.lit(float(fraction)))], [group])
    low = F.col("part") == 0
    means = [m for f in flags for m in (F.avg(F.col(f).cast("double")).alias(f"{f}_overall"), F.avg(F.when(low, F.col(f).cast("double"))).alias(f"{f}_bottom"))]
    return parted.groupBy(group).agg(F.count("*").alias("n"), F.count_if(low).alias("n_bottom"), *means)


def calibration_by_decile(df: DataFrame, y: str = "y", p: str = "p", key: str = "lead_id") -> DataFrame:
    """Mean predicted and observed rate per decile of the prediction (10 = highest)."""
    binned = cut_parts(df.select(key, y, p), p, key, ten_cuts).withColumn("decile", F.col("part") + 1)
    return binned.groupBy("decile").agg(F.count("*").alias("n"), F.avg(p).alias("mean_p"), F.avg(y).alias("observed"))


def value_scale(df: DataFrame, value: str, groups: Sequence[str] = ()) -> DataFrame:
    """p1, p50, p90, p99, max, max over median and the share of the total in the top 1% of rows (at least one row)."""
    rows = df.where(F.col(value).isNotNull())
    counts = rows.groupBy(*groups, value).agg(F.count("*").alias("n"))
    counts = counts.withColumn("s", F.col("n") * F.col(value))
    ranked = running_totals(counts, value, ["n", "s"], groups, bucket_bounds(rows, value))
    h = {q: (F.col("n_total") - 1) * F.lit(q) for q in (0.01, 0.5, 0.9, 0.99)}

    def holds(pos: Column) -> Column:
        return (pos >= F.col("n_before")) & (pos < F.col("n_before") + F.col("n"))

    def part(q: float) -> Column:
        frac = h[q] - F.floor(h[q])
        return F.sum(F.when(holds(F.floor(h[q])), F.col(value) * (1 - frac)).otherwise(0.0)
                     + F.when(holds(F.ceil(h[q])), F.col(value) * frac).otherwise(0.0))

    k = F.greatest(F.lit(1), F.floor(F.col("n_total") * F.lit(0.01)))
    above_n = F.col("n_total") - F.col("n_before") - F.col("n")
    in_top = F.greatest(F.lit(0), F.least(F.col("n"), k - above_n))
    out = ranked.groupBy(*groups).agg(
        F.max("n_total").alias("n"), part(0.01).alias("p1"), part(0.5).alias("p50"), part(0.9).alias("p90"),
        part(0.99).alias("p99"), F.max(value).alias("max"), F.sum(in_top * F.col(value)).alias("_top"),
        F.max("s_total").alias("total"))
    return (out.withColumn("max_over_median", F.col("max") / F.col("p50"))
            .withColumn("top1pct_share", F.col("_top") / F.col("total")).drop("_top"))
