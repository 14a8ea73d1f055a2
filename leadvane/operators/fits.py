"""Many L2 logistic fits over one pass of the data per iteration.

Splits, folds, subsamples, resamples and penalties are all the same fit with different row weights, so they are fitted
together: every task adds the gradient and curvature of each fit over its rows, the sums are added in levels, and only
the coefficients (fits x columns numbers) visit the driver between passes.
"""
from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from leadvane.config import LR_C
from leadvane.operators.bootstrap import poisson_weights
from leadvane.session import written

MAX_PASSES = 30
TOLERANCE = 1e-8
#: A fit that still takes a longer step after the last pass is refused.
SETTLED = 1e-6
#: Refits by gradients: the last step of each, and passes before the rest is fitted in full.
REFIT_TOLERANCE, REFIT_PASSES = 1e-6, 25
#: Arrays that one task adds.
FAN_IN = 64
_CHUNK = 2048
_FITS = 64
_PART = "k bigint, part bigint, s array<double>"


def design_array(columns: Sequence[str]) -> Column:
    """Design columns as one array column ``x``."""
    return F.array(*[F.col(f"`{c}`").cast("double") for c in columns]).alias("x")


def bootstrap_weights(fits: int, seed: int, key: str = "lead_id") -> Callable[[pd.DataFrame], np.ndarray]:
    return lambda pdf: poisson_weights(pdf[key].to_numpy(), np.ones(len(pdf), dtype=np.int64), fits, seed)


def column_weights(name: str = "w") -> Callable[[pd.DataFrame], np.ndarray]:
    return lambda pdf: np.stack(pdf[name].to_numpy())


def _labels(part: pd.DataFrame, y: str, fits: int, w: np.ndarray) -> np.ndarray:
    """Rows x fits labels of a chunk, 0 where the weight is."""
    values = part[y].to_numpy()
    t = np.stack(values) if np.ndim(values[0]) else np.repeat(values.astype(float)[:, None], fits, axis=1)
    return np.where(w > 0, t, 0.0)


def _chunks(batches: Iterator[pd.DataFrame]) -> Iterator[tuple[pd.DataFrame, np.ndarray]]:
    """Pieces of the batches with their design matrix, intercept first."""
    for pdf in batches:
        for at in range(0, len(pdf), _CHUNK):
            part = pdf.iloc[at:at + _CHUNK]
            yield part, np.column_stack([np.ones(len(part)), np.stack(part["x"].to_numpy())])


def _probability(x: np.ndarray, beta: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x @ beta.T, -500, 500)))


def levelled(parts: DataFrame, tasks: int) -> DataFrame:
    """Sums of the arrays ``s`` by ``k`` over groups of ``FAN_IN`` parts, again and again, until no ``k`` has more than ``FAN_IN`` rows.

    ``parts`` has k, part (below ``tasks``) and s, so a task adds at most ``FAN_IN`` arrays however many tasks there were.
    """
    def add(pdf: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame({"k": pdf["k"].iloc[:1], "part": pdf["part"].iloc[:1] // FAN_IN, "s": [np.sum(np.stack(pdf["s"].to_numpy()), axis=0)]})
    while tasks > FAN_IN:
        parts = parts.groupBy("k", F.expr(f"part div {FAN_IN}").alias("_near")).applyInPandas(add, _PART)
        tasks = -(-tasks // FAN_IN)
    return parts


def fit_many(rows: DataFrame, fits: int, weights: Callable[[pd.DataFrame], np.ndarray], y: str = "y",
             c: float | Sequence[float] = LR_C, fixed: bool = False) -> np.ndarray:
    """Coefficients ``(fits, 1 + columns)``, intercept first, of the penalised logistic regressions.

    ``rows`` holds the array ``x``, the label ``y`` (a number, or an array with one label per fit) and whatever
    ``weights`` reads to give the rows x fits weight matrix. Fits whose weighted rows lack a class are NaN. The sums of all
    tasks are added in levels of ``FAN_IN``. Raises if a fit still moves by more than ``SETTLED`` after the last pass.

    The rows are written once and read by every pass, so that no pass plans (and the driver keeps) what built them; ``fixed`` rows
    are such a table already.
    """
    rows = rows if fixed else written(rows)
    d = len(rows.select("x").first()["x"]) + 1
    tasks = rows.rdd.getNumPartitions()
    penalty = np.broadcast_to(np.asarray(c, dtype=float), (fits,))
    upper = np.triu_indices(d)  # the curvature is symmetric
    beta = np.zeros((fits, d))
    alive = np.ones(fits, dtype=bool)
    for _ in range(MAX_PASSES):
        current, active = beta.copy(), np.flatnonzero(alive)

        def sums(batches, current=current, active=active):
            g, h = np.zeros((fits, d)), np.zeros((fits, d, d))
            w1, w0 = np.zeros(fits), np.zeros(fits)
            for part, x in _chunks(batches):
                w = np.asarray(weights(part), dtype=float)
                t, mu = _labels(part, y, fits, w), _probability(x, current)
                w1 += (w * t).sum(axis=0)
                w0 += (w * (1 - t)).sum(axis=0)
                g += (w * (t - mu)).T @ x
                v = w * mu * (1 - mu)
                for k in active:
                    h[k] += (x * v[:, k][:, None]).T @ x
            task = TaskContext.get().partitionId()
            for k in active:
                yield pd.DataFrame({"k": [k], "part": [task], "s": [np.concatenate([[w1[k], w0[k]], g[k], h[k][upper]])]})

        def total(pdf: pd.DataFrame) -> pd.DataFrame:
            k = int(pdf["k"].iloc[0])
            s = np.sum(np.stack(pdf["s"].to_numpy()), axis=0)
            if s[0] <= 0 or s[1] <= 0:
                return pd.DataFrame({"k": [k], "step": [np.full(d, np.nan)]})
            shrink = np.diag(np.r_[0.0, np.ones(d - 1)])
            grad = penalty[k] * s[2:2 + d] - shrink @ current[k]
            half = np.zeros((d, d))
            half[upper] = s[2 + d:]
            curve = penalty[k] * (half + np.triu(half, 1).T) + shrink
            return pd.DataFrame({"k": [k], "step": [np.linalg.lstsq(curve, grad, rcond=None)[0]]})

        parts = levelled(rows.mapInPandas(sums, _PART), tasks)
        steps = parts.groupBy("k").applyInPandas(total, "k bigint, step array<double>").collect()  # fits x columns
        largest = 0.0
        for r in steps:
            step = np.asarray(r["step"], dtype=float)
            beta[r["k"]] += step
            alive[r["k"]] = np.isfinite(step).all() and np.max(np.abs(step)) > TOLERANCE
            if np.isfinite(step).all():
                largest = max(largest, float(np.max(np.abs(step))))
        if not alive.any():
            break
    if largest > SETTLED:
        raise RuntimeError("logistic fits did not converge (separated classes without a penalty?)")
    return beta


def refit_resamples(rows: DataFrame, fits: int, weights: Callable[[pd.DataFrame], np.ndarray], y: str = "y", c: float = LR_C) -> np.ndarray:
    """The coefficients of ``fit_many`` for reweighted copies of one training set, at the cost of gradients alone.

    All refits start at the fit of the unweighted rows and step along its inverse curvature: a pass then adds one influence
    vector of ``1 + columns`` numbers a refit instead of a curvature matrix. Steps shrink by a constant factor, the share by which a
    refit's curvature differs from the whole one. A refit stops when a step is below ``REFIT_TOLERANCE``, which bounds its distance
    from the full refit by a few times as much. Refits whose steps grow, or that need too many, are fitted in full.
    """
    rows = written(rows)
    start = fit_many(rows, 1, lambda pdf: np.ones((len(pdf), 1)), y, c, fixed=True)[0]
    d, tasks = len(start), rows.rdd.getNumPartitions()
    if not np.isfinite(start).all():  # one class only, so no refit has two
        return np.full((fits, d), np.nan)
    shrink = np.diag(np.r_[0.0, np.ones(d - 1)])

    def curvature(batches):
        h = np.zeros((d, d))
        for _, x in _chunks(batches):
            mu = _probability(x, start[None, :])[:, 0]
            h += (x * (mu * (1 - mu))[:, None]).T @ x
        yield pd.DataFrame({"k": [0], "part": [TaskContext.get().partitionId()], "s": [h.ravel()]})
    blocks = levelled(rows.mapInPandas(curvature, _PART), tasks).collect()  # at most FAN_IN matrices
    inverse = np.linalg.pinv(c * np.sum([r["s"] for r in blocks], axis=0).reshape(d, d) + shrink)
    beta = np.tile(start, (fits, 1))
    alive, wild, last = np.ones(fits, bool), np.zeros(fits, bool), np.full(fits, np.inf)
    for _ in range(REFIT_PASSES):
        current, active = beta.copy(), np.flatnonzero(alive)

        def gradients(batches, current=current, active=active):
            g, classes = np.zeros((len(active), d)), np.zeros((len(active), 2))
            for part, x in _chunks(batches):
                w = np.asarray(weights(part), dtype=float)
                t = _labels(part, y, fits, w)[:, active]
                w = w[:, active]
                classes += np.stack([(w * t).sum(axis=0), (w * (1 - t)).sum(axis=0)], axis=1)
                g += (w * (t - _probability(x, current[active]))).T @ x
            s, task = np.concatenate([classes, g], axis=1), TaskContext.get().partitionId()
            for k in range(0, len(active), _FITS):
                yield pd.DataFrame({"k": [k], "part": [task], "s": [s[k:k + _FITS].ravel()]})

        def total(pdf: pd.DataFrame) -> pd.DataFrame:
            k = int(pdf["k"].iloc[0])
            s = np.sum(np.stack(pdf["s"].to_numpy()), axis=0).reshape(-1, 2 + d)
            steps = (c * s[:, 2:] - current[active[k:k + _FITS]] @ shrink) @ inverse
            steps[(s[:, 0] <= 0) | (s[:, 1] <= 0)] = np.nan
            return pd.DataFrame({"k": active[k:k + _FITS], "step": list(steps)})
        parts = levelled(rows.mapInPandas(gradients, _PART), tasks)
        for r in parts.groupBy("k").applyInPandas(total, "k bigint, step array<double>").collect():
            k, step = r["k"], np.asarray(r["step"], dtype=float)
            beta[k] += step
            size = np.max(np.abs(step))
            wild[k] = size > last[k]
            alive[k] = bool(size > REFIT_TOLERANCE) and not wild[k]
            last[k] = size
        if not alive.any():
            break
    again = np.flatnonzero(wild | alive)
    if len(again):
        beta[again] = fit_many(rows, len(again), lambda pdf: weights(pdf)[:, again], y, c, fixed=True)
    return beta


def fit_one(wide: DataFrame, columns: Sequence[str], y: str = "y", c: float = LR_C) -> dict[str, float]:
    """One unweighted fit as weights by column; the same optimum as Spark ML's in far fewer passes."""
    rows = wide.select(y, design_array(columns), F.array(F.lit(1.0)).alias("w"))
    beta = fit_many(rows, 1, column_weights(), y, c)[0]
    return dict(zip(["(intercept)", *columns], map(float, beta)))


def coefficient_frame(spark, beta: np.ndarray, columns: Sequence[str]) -> DataFrame:
    """Rows ``(fit, column, coefficient)``, the intercept included."""
    names = ["(intercept)", *columns]
    data = [(int(k), n, float(v)) for k, row in enumerate(beta) for n, v in zip(names, row)]
    return spark.createDataFrame(data, "fit bigint, column string, coefficient double")


def score_many(rows: DataFrame, beta: np.ndarray, keep: Sequence[str]) -> DataFrame:
    """Probability under every fit as an array column ``ps``; null or NaN for fits that were not possible."""
    fields = [f"`{c}` {t}" for c, t in rows.select(*keep).dtypes]

    def score(batches):
        for pdf in batches:
            x = np.column_stack([np.ones(len(pdf)), np.stack(pdf["x"].to_numpy())]) if len(pdf) else np.zeros((0, beta.shape[1]))
            p = 1 / (1 + np.exp(-np.clip(x @ beta.T, -500, 500)))
            out = pdf[list(keep)].copy()
            out["ps"] = list(p)
            yield out

    return rows.select(*keep, "x").mapInPandas(score, ", ".join([*fields, "ps array<double>"]))
