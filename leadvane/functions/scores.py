"""Linear scores, points and logits as column arithmetic over model weights."""
from __future__ import annotations

import math
from collections.abc import Mapping

from pyspark.sql import Column
from pyspark.sql import functions as F

from leadvane.config import CONTEXT_SCORE_CLIP, POINTS_TO_DOUBLE_ODDS
from leadvane.operators.crm import map_lookup

INTERCEPT = "(intercept)"


def split_column(column: str) -> tuple[str, str]:
    """``feature=level`` into its two parts; the level may hold further ``=`` signs or be absent."""
    feature, _, level = column.partition("=")
    return feature, level


def weights_by_feature(weights: Mapping[str, float]) -> dict[str, dict[str, float]]:
    out: dict[str, dict[str, float]] = {}
    for column, w in weights.items():
        if column != INTERCEPT:
            f, lvl = split_column(column)
            out.setdefault(f, {})[lvl] = float(w)
    return out


def linear_score(weights: Mapping[str, float]) -> Column:
    """Intercept plus the weight of each feature's level; the weights are literals, so no join is needed."""
    total = F.lit(float(weights.get(INTERCEPT, 0.0)))
    for feature, by_level in weights_by_feature(weights).items():
        total = total + F.coalesce(map_lookup(by_level, F.col(feature)), F.lit(0.0))
    return total


def sigmoid(z: Column) -> Column:
    return 1 / (1 + F.exp(-z))


def logit(p: Column, clip: tuple[float, float] = CONTEXT_SCORE_CLIP) -> Column:
    q = F.least(F.greatest(p, F.lit(clip[0])), F.lit(clip[1]))
    return F.log(q / (1 - q))


def points(log_odds: Column) -> Column:
    return log_odds * F.lit(POINTS_TO_DOUBLE_ODDS / math.log(2))
