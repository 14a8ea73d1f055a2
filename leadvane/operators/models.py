"""Win-probability and deal-value models on Spark ML, and frozen-weight scoring."""
from __future__ import annotations

import math
from collections.abc import Mapping, Sequence
from dataclasses import dataclass

from pyspark.ml.classification import GBTClassifier, LogisticRegression
from pyspark.ml.regression import GeneralizedLinearRegression, LinearRegression
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from leadvane.config import LR_C, RIDGE_ALPHA
from leadvane.functions.scores import INTERCEPT, points, split_column
from leadvane.operators.design import with_vector


def fit_logistic(train: DataFrame, columns: Sequence[str], c: float = LR_C, weight: str | None = None,
                 label: str = "y") -> dict[str, float]:
    """L2 logistic regression (intercept unpenalised) on 0/1 design columns; weights by column."""
    data = with_vector(train.select(label, *([weight] if weight else []), *[F.col(f"`{x}`") for x in columns]), columns)
    n = data.agg(F.sum(weight) if weight else F.count("*")).first()[0]
    lr = LogisticRegression(featuresCol="design", labelCol=label, regParam=1.0 / (c * n) if math.isfinite(c) else 0.0,
                            elasticNetParam=0.0, standardization=False, maxIter=300, tol=1e-8)
    model = (lr.setWeightCol(weight) if weight else lr).fit(data)
    return {INTERCEPT: float(model.intercept), **dict(zip(columns, map(float, model.coefficients)))}


@dataclass(frozen=True)
class ValueModel:
    """Weights of the log deal value and the residual sd behind its lognormal mean correction."""

    weights: Mapping[str, float]
    residual_sd: float
    n_train: int

    @property
    def correction(self) -> float:
        return math.exp(self.residual_sd ** 2 / 2)


def fit_deal_value(won: DataFrame, columns: Sequence[str], value: str = "deal_value", alpha: float = RIDGE_ALPHA,
                   residual_sd: float | None = None) -> ValueModel:
    """Ridge regression of log value on won rows with a recorded value; residual sd with one degree removed."""
    data = won.where(F.col(value).isNotNull()).withColumn("_y", F.log(value))
    n, spread = data.agg(F.count("*"), F.stddev_pop("_y")).first()
    if n < 2:
        raise ValueError(f"need at least 2 recorded deal values, got {n}")
    design = with_vector(data.select("_y", *[F.col(f"`{x}`") for x in columns]), columns)
    model = LinearRegression(featuresCol="design", labelCol="_y", solver="normal", standardization=False,
                             regParam=alpha / n * spread, elasticNetParam=0.0).fit(design)
    if residual_sd is None:
        fitted = model.transform(design)
        residual_sd = fitted.agg(F.stddev_samp(F.col("_y") - F.col("prediction"))).first()[0]
    return ValueModel({INTERCEPT: float(model.intercept), **dict(zip(columns, map(float, model.coefficients)))},
                      float(residual_sd), int(n))


def weights_frame(spark, weights: Mapping[str, float]) -> DataFrame:
    """Coefficient table: column, feature, level, log-odds, odds multiplier and points."""
    rows = [(i, c, *split_column(c), float(w)) for i, (c, w) in enumerate(weights.items())]
    df = spark.createDataFrame(rows, "position int, column string, feature string, level string, log_odds double")
    return df.withColumns({"odds_multiplier": F.exp("log_odds"), "points": points(F.col("log_odds"))})


def scorecard(weights: DataFrame) -> DataFrame:
    """Rounded weights without the intercept, by log-odds (ties by column)."""
    return (weights.where(F.col("column") != INTERCEPT)
            .select("column", F.round("log_odds", 3).alias("log_odds"), F.round("odds_multiplier", 2).alias("odds_multiplier"),
                    F.round("points", 0).alias("points")).orderBy("log_odds", "column"))


def explain_scores(long: DataFrame, weights: Mapping[str, float], leads: DataFrame, key: str = "lead_id") -> DataFrame:
    """One row per active design column of a lead plus its intercept row; log-odds add up to the lead's score."""
    pairs = [x for c, w in weights.items() for x in (F.lit(c), F.lit(float(w)))]
    column = F.concat_ws("=", "feature", "level")
    active = long.select(key, column.alias("column"), F.coalesce(F.try_element_at(F.create_map(*pairs), column),
                                                                 F.lit(0.0)).alias("log_odds"))
    base = leads.select(key, F.lit(INTERCEPT).alias("column"), F.lit(float(weights[INTERCEPT])).alias("log_odds"))
    return active.unionByName(base).withColumn("points", points(F.col("log_odds")))


def fit_boosted_trees(train: DataFrame, columns: Sequence[str], seed: int = 0, label: str = "y"):
    """Unconstrained gradient-boosted trees on ordinal columns, -1 standing for an absent value."""
    filled = train.select(label, *[F.coalesce(F.col(c), F.lit(-1.0)).alias(c) for c in columns])
    return GBTClassifier(featuresCol="design", labelCol=label, maxIter=20, stepSize=0.1, seed=seed).fit(
        with_vector(filled, columns))


def logistic_with_errors(df: DataFrame, columns: Sequence[str], label: str = "y") -> list[tuple[str, float, float]]:
    """Unpenalised logistic coefficients with standard errors, intercept first."""
    data = with_vector(df.select(label, *[F.col(f"`{c}`") for c in columns]), columns)
    model = GeneralizedLinearRegression(family="binomial", featuresCol="design", labelCol=label, maxIter=50, tol=1e-8).fit(data)
    errors = list(model.summary.coefficientStandardErrors)  # the intercept is last
    return [(INTERCEPT, float(model.intercept), errors[-1]),
            *[(c, float(b), s) for c, b, s in zip(columns, model.coefficients, errors)]]


def least_squares(df: DataFrame, columns: Sequence[str], label: str) -> tuple[dict[str, float], float]:
    """Ordinary least squares weights and residual sd (one degree removed)."""
    data = with_vector(df.select(label, *[F.col(f"`{c}`") for c in columns]), columns)
    model = LinearRegression(featuresCol="design", labelCol=label, solver="normal", regParam=0.0).fit(data)
    sd = model.transform(data).agg(F.stddev_samp(F.col(label) - F.col("prediction"))).first()[0]
    return {INTERCEPT: float(model.intercept), **dict(zip(columns, map(float, model.coefficients)))}, float(sd)
