"""Bootstrap resampling of ranking metrics.

Every row gets a Poisson(1) weight per resample from an arithmetic hash of its id, so results do not depend on
partitioning and survive recomputation. Rows equal in all scores and the label are first merged into one bin, whose
weight is the Poisson(count) quantile of one such hash, for every count. Bins are range partitioned by score and folded
in Arrow batches into at most three blocks per task (first tie, inner, last tie), each holding one number per resample;
resamples are never multiplied into rows. Blocks of neighbouring tasks are put together in levels of ``FAN_IN``.
"""
from __future__ import annotations

import math
from collections.abc import Iterator, Sequence
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from leadvane.session import shuffle_partitions

P = 2147483647
DRAWS_PER_RESAMPLE = 16
CI_LEVEL = 0.95
FAN_IN = 64


@lru_cache(maxsize=4096)
def poisson_cuts(count: int) -> tuple[int, np.ndarray]:
    """(least weight, cuts): the Poisson(count) weight of a hash is the least weight plus the cuts at or below the hash.

    Cuts are cumulative probabilities scaled to the hash range, over every weight that a hash can reach.
    """
    wide = 10 * math.sqrt(count) + 20
    low = max(0, math.floor(count - wide))
    logs = [k * math.log(count) - count - math.lgamma(k + 1) for k in range(low, math.ceil(count + wide) + 1)]
    return low, np.floor(np.cumsum(np.exp(logs)) * P).astype(np.int64)


POISSON_CUTS = [int(c) for c in poisson_cuts(1)[1] if c < P]
_CHUNK = 1024
_BLOCK = ["lo", "hi", "pos", "neg", "u", "tie"]


def hash_ints(ids: np.ndarray, seeds: np.ndarray) -> np.ndarray:
    """The arithmetic hash of ``ranking.hash_order`` for every (id, seed) pair."""
    a = ((ids % P)[:, None] * 48271 + (seeds % P)[None, :] * 69621 + 12345) % P
    b = (a * a + 40014 * a + 7) % P
    return (b * b + 16807 * b + 11) % P


def poisson_weights(ids: np.ndarray, counts: np.ndarray, resamples: int, seed: int) -> np.ndarray:
    """Weight of every bin in every resample: the Poisson(count) quantile of its hash."""
    ids, counts = np.asarray(ids, dtype=np.int64), np.asarray(counts, dtype=np.int64)
    base = seed * 1_000_003 + np.arange(resamples, dtype=np.int64) * DRAWS_PER_RESAMPLE
    out = np.zeros((len(ids), resamples))
    for count in np.unique(counts):
        rows = np.flatnonzero(counts == count)
        low, cuts = poisson_cuts(int(count))
        out[rows] = low + np.searchsorted(cuts, hash_ints(ids[rows], base), side="right")
    return out


class _Fold:
    """Running state of one (group, model) inside a task: open first tie, closed inner part, open last tie."""

    def __init__(self, resamples: int):
        self.zero = np.zeros(resamples)
        self.first = self.last = None
        self.pos = self.neg = self.u = self.zero
        self.span: list[float] = []

    def add(self, scores: np.ndarray, pos: np.ndarray, neg: np.ndarray) -> None:
        """Ties in ascending score order; the newest one stays open."""
        if self.last is not None and scores[0] == self.last[0]:
            pos[0] += self.last[1]
            neg[0] += self.last[2]
        elif self.last is not None:
            scores = np.concatenate([[self.last[0]], scores])
            pos, neg = np.vstack([self.last[1], pos]), np.vstack([self.last[2], neg])
        self.last = (scores[-1], pos[-1], neg[-1])
        scores, pos, neg = scores[:-1], pos[:-1], neg[:-1]
        if len(scores) and self.first is None:
            self.first = (scores[0], pos[0], neg[0])
            scores, pos, neg = scores[1:], pos[1:], neg[1:]
        if len(scores):
            below = np.cumsum(neg, axis=0) - neg + self.neg
            self.u = self.u + (pos * (below + neg / 2)).sum(axis=0)
            self.pos, self.neg = self.pos + pos.sum(axis=0), self.neg + neg.sum(axis=0)
            self.span = [self.span[0] if self.span else scores[0], scores[-1]]

    def blocks(self) -> list[tuple]:
        out = [(t[0], t[0], t[1], t[2], t[1] * t[2] / 2, True) for t in (self.first, self.last) if t is not None]
        if self.span:
            out.append((self.span[0], self.span[1], self.pos, self.neg, self.u, False))
        return out


def _fold_partition(batches: Iterator[pd.DataFrame], by: list[str], resamples: int, seed: int) -> Iterator[pd.DataFrame]:
    key, fold = None, None

    def emit() -> pd.DataFrame:
        rows = [(*key, part_id, *b) for b in fold.blocks()]
        return pd.DataFrame(rows, columns=[*by, "part", *_BLOCK])

    part_id = TaskContext.get().partitionId()
    for pdf in batches:
        for k, part in pdf.groupby(by, sort=False):
            if k != key:
                if fold is not None:
                    yield emit()
                key, fold = k, _Fold(resamples)
            for at in range(0, len(part), _CHUNK):
                c = part.iloc[at:at + _CHUNK]
                w = poisson_weights(c["rep"].to_numpy(), c["c"].to_numpy(), resamples, seed)
                s, y = c["score"].to_numpy(dtype=float), c["y"].to_numpy(dtype=float)[:, None]
                starts = np.flatnonzero(np.r_[True, s[1:] != s[:-1]])
                fold.add(s[starts], np.add.reduceat(w * y, starts, axis=0), np.add.reduceat(w * (1 - y), starts, axis=0))
    if fold is not None:
        yield emit()


def _joined_ties(pdf: pd.DataFrame) -> list[tuple]:
    """Blocks in score order; the pieces of a tie that tasks cut apart are one block again."""
    out: list[tuple] = []
    for lo, hi, pos, neg, u, tie in pdf.sort_values(["lo", "hi"], kind="stable")[_BLOCK].itertuples(index=False):
        pos, neg, u = np.asarray(pos, dtype=float), np.asarray(neg, dtype=float), np.asarray(u, dtype=float)
        if tie and out and out[-1][5] and out[-1][0] == lo:
            pos, neg = out[-1][2] + pos, out[-1][3] + neg
            out[-1] = (lo, hi, pos, neg, pos * neg / 2, True)
        else:
            out.append((lo, hi, pos, neg, u, tie))
    return out


def _stacked(blocks: list[tuple]) -> tuple:
    """Neighbouring blocks as one: wins, losses and the U statistic."""
    wins, losses, total = 0.0, 0.0, 0.0
    for _, _, pos, neg, u, _ in blocks:
        total, wins, losses = total + pos * losses + u, wins + pos, losses + neg
    return wins, losses, total


def _merge(pdf: pd.DataFrame, by: list[str]) -> pd.DataFrame:
    """Blocks of ``FAN_IN`` neighbouring tasks as at most three; the outer ties stay open."""
    blocks = _joined_ties(pdf)
    inner = blocks[1:-1]
    if inner:
        blocks = [blocks[0], (inner[0][0], inner[-1][1], *_stacked(inner), False), blocks[-1]]
    key = [pdf[c].iloc[0] for c in by]
    return pd.DataFrame([(*key, pdf["part"].iloc[0] // FAN_IN, *b) for b in blocks], columns=[*by, "part", *_BLOCK])


def _combine(pdf: pd.DataFrame, by: list[str]) -> pd.DataFrame:
    """The AUC of every resample from the last level's blocks of one (group, model)."""
    wins, losses, u = _stacked(_joined_ties(pdf))
    with np.errstate(divide="ignore", invalid="ignore"):
        auc = np.where((wins > 0) & (losses > 0), u / (wins * losses), np.nan)
    out = pd.DataFrame({"resample": np.arange(len(auc)), "auc": auc})
    for c in by:
        out.insert(0, c, pdf[c].iloc[0])
    return out[out["auc"].notna()]


def resampled_auc(df: DataFrame, scores: Sequence[str], y: str = "y", key: str = "lead_id", groups: Sequence[str] = (),
                  resamples: int = 1000, seed: int = 0) -> DataFrame:
    """AUC of every score in every resample: rows ``(groups, model, resample, auc)``.

    All scores of a row share its weights, so differences between models are paired. A resample that drew one class
    only has no AUC and no row.
    """
    rows = df.where(F.col(y).isNotNull())
    id_ = F.col(key) if dict(df.dtypes)[key] in ("bigint", "int") else F.xxhash64(key)
    names = [f"_s{i}" for i in range(len(scores))]
    bins = (rows.select(*groups, F.col(y).cast("int").alias("y"), id_.cast("bigint").alias("_id"),
                        *[F.col(s).cast("double").alias(n) for s, n in zip(scores, names)])
            .groupBy(*groups, "y", *names).agg(F.min("_id").alias("rep"), F.count("*").alias("c")))
    each = F.array(*[F.struct(F.lit(s).alias("model"), F.col(n).alias("score")) for s, n in zip(scores, names)])
    long = bins.select(*groups, "y", "rep", "c", F.explode(each).alias("m")).select(*groups, "m.model", "m.score", "y", "rep", "c")
    by = [*groups, "model"]
    order = [*by, "score", "rep", "y"]
    ranged = long.repartitionByRange(*order).sortWithinPartitions(*order)
    fields = [f"`{c}` {t}" for c, t in ranged.dtypes if c in by]
    arrays = "part bigint, lo double, hi double, pos array<double>, neg array<double>, u array<double>, tie boolean"
    blocks = ranged.mapInPandas(lambda it: _fold_partition(it, by, resamples, seed), ", ".join([*fields, arrays]))
    tasks = shuffle_partitions(df.sparkSession)  # of the range partitioning, at most
    while tasks > FAN_IN:
        blocks = blocks.groupBy(*by, F.expr(f"part div {FAN_IN}").alias("_near")).applyInPandas(
            lambda pdf: _merge(pdf, by), ", ".join([*fields, arrays]))
        tasks = -(-tasks // FAN_IN)
    return blocks.groupBy(*by).applyInPandas(lambda pdf: _combine(pdf, by)[[*by, "resample", "auc"]],
                                             ", ".join([*fields, "resample bigint, auc double"]))


def interval(samples: DataFrame, value: str, groups: Sequence[str], level: float = CI_LEVEL) -> DataFrame:
    """Equal-tailed percentile interval over the resamples (at most a few thousand rows per group)."""
    tail = (1 - level) / 2
    return samples.groupBy(*groups).agg(F.percentile(value, tail).alias("lo"), F.percentile(value, 1 - tail).alias("hi"))


def paired_differences(samples: DataFrame, a: str, b: str, groups: Sequence[str] = ()) -> DataFrame:
    """``AUC(b) - AUC(a)`` per resample."""
    return (samples.groupBy(*groups, "resample")
            .agg(F.max(F.when(F.col("model") == a, F.col("auc"))).alias("_a"),
                 F.max(F.when(F.col("model") == b, F.col("auc"))).alias("_b"))
            .where("_a is not null and _b is not null").select(*groups, "resample", (F.col("_b") - F.col("_a")).alias("diff")))


def paired_summary(differences: DataFrame, groups: Sequence[str] = (), level: float = CI_LEVEL) -> DataFrame:
    """Interval of the difference and the two-sided bootstrap p-value ``2 min(P(d<=0), P(d>=0))``, at most 1."""
    tail = (1 - level) / 2
    d = F.col("diff")
    return differences.groupBy(*groups).agg(
        F.percentile("diff", tail).alias("lo"), F.percentile("diff", 1 - tail).alias("hi"),
        F.least(F.lit(1.0), 2 * F.least(F.avg((d <= 0).cast("double")), F.avg((d >= 0).cast("double")))).alias("p_value"))
