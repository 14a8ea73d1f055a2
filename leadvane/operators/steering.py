"""Steering towards a target: wins within the horizon at or above a stated deal value, and how well uploads set them apart."""
from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from leadvane.operators.metrics import top_share
from leadvane.operators.ranking import percentiles
from leadvane.operators.value import ValueTransform, fit_transforms

# fixed values: quantiles of won deal values tried as the target's minimum, strictest first, and the smallest segment
TARGET_QUANTILES = (0.95, 0.9, 0.75, 0.5)
MIN_ROWS, MIN_TARGET_WINS = 1000, 200
#: Pseudo wins by which a level's target share leans towards that of all wins.
SHARE_PRIOR = 10.0


def is_target(minimum: float) -> Column:
    """Won within the horizon with a recorded value of at least ``minimum``; a win without a value is none."""
    return F.coalesce((F.col("y") == 1) & (F.col("deal_value") >= F.lit(minimum)), F.lit(False))


def threshold_search(train: DataFrame, quantiles: Sequence[float] = TARGET_QUANTILES, min_rows: int = MIN_ROWS,
                     min_wins: int = MIN_TARGET_WINS) -> DataFrame:
    """quantile, minimum, train_rows, target_wins, allowed, chosen: the strictest target that has wins enough is chosen.

    The quantiles are of recorded values of training wins. All counts come from one pass; none is chosen when none is allowed.
    """
    wins = train.where("y = 1 AND deal_value IS NOT NULL")
    cuts = {r["prob"]: r["value"] for r in percentiles(wins, "deal_value", sorted(quantiles)).collect()}
    cells = F.array(*[F.struct(F.lit(q).alias("quantile"), F.lit(cuts[q]).alias("minimum"), is_target(cuts[q]).alias("target")) for q in quantiles if q in cuts])
    rows = train.where("y IS NOT NULL").select(F.explode(cells).alias("c")).select("c.*").groupBy("quantile", "minimum").agg(
        F.count("*").alias("train_rows"), F.count_if("target").alias("target_wins"))
    rows = rows.withColumn("allowed", (F.col("train_rows") >= min_rows) & (F.col("target_wins") >= min_wins))
    best = rows.where("allowed").agg(F.max("quantile")).scalar()
    return rows.withColumn("chosen", F.coalesce(F.col("quantile") == best, F.lit(False)))


def target_shares(train: DataFrame, level: str, minimum: float) -> DataFrame:
    """level, target_share: share of target wins among a level's training wins, drawn towards that of all wins."""
    won = train.where("y = 1").select(level, is_target(minimum).cast("double").alias("t"))
    overall = won.agg(F.avg("t")).scalar()
    return won.groupBy(level).agg(F.sum("t").alias("s"), F.count("*").alias("n")).select(
        level, ((F.col("s") + SHARE_PRIOR * overall) / (F.col("n") + SHARE_PRIOR)).alias("target_share"))


def steering_value(df: DataFrame, train: DataFrame, level: str, minimum: float, low: float = 0.0) -> DataFrame:
    """``df`` with ``p_target`` and ``steer``: p_target E[value | target] + (1 - p_target) low, without cap or compression."""
    mean = train.where(is_target(minimum)).agg(F.avg("deal_value")).scalar()
    overall = train.where("y = 1").agg(F.avg(is_target(minimum).cast("double"))).scalar()
    rows = df.join(target_shares(train, level, minimum), level, "left")
    rows = rows.withColumn("p_target", F.col("p") * F.coalesce("target_share", overall)).drop("target_share")
    return rows.withColumn("steer", F.col("p_target") * mean + (1 - F.col("p_target")) * F.lit(low))


def steering_gaps(rows: DataFrame, values: dict[str, Column], minimum: float) -> DataFrame:
    """transform, n_target, n_other, mean_target, mean_other, gap, captured: mean uploads of target and other leads.

    captured: share of the target leads' revenue among the fifth of leads with the highest upload, ties at the cut averaged.
    """
    cells = F.array(*[F.struct(F.lit(name).alias("transform"), v.alias("v")) for name, v in values.items()])
    target = is_target(minimum)
    long = rows.select(target.alias("target"), F.when(target, F.col("deal_value")).otherwise(0.0).alias("target_revenue"), F.explode(cells).alias("c")).select(
        "target", "target_revenue", "c.*")
    means = long.groupBy("transform").agg(F.count_if("target").alias("n_target"), F.count_if(~F.col("target")).alias("n_other"),
                                          F.avg(F.when(F.col("target"), F.col("v"))).alias("mean_target"), F.avg(F.when(~F.col("target"), F.col("v"))).alias("mean_other"))
    share = top_share(long, "v", ["target_revenue"], ["transform"]).select("transform", F.col("target_revenue_share").alias("captured"))
    return means.join(share, "transform", "left").withColumn("gap", F.col("mean_target") / F.col("mean_other"))


def transform_values(train: DataFrame, value: str, specs: Sequence[ValueTransform]) -> dict[str, Column]:
    """Name and upload column of each transform fitted on the training rows."""
    return {f.spec.name: f.apply(F.col(value)) for f in fit_transforms(train, value, specs)}
