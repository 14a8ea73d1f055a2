"""Nearest neighbours by inner product on randomly rotated one-bit codes.

A vector becomes the signs of its rotated components, packed into 64-bit words, with two scalars: its norm and how much of
it the code explains. A rotated query is cut into 6-bit numbers; AND and bit counts of its bit planes with a code estimate
the inner product, and the scalars bound the error. The k best estimates of a tile are scored with the original
components; every other vector whose upper bound reaches the lowest of these scores is reranked too. Queries and codes meet tile by tile: groups
of query blocks with stripes of code blocks, each tile in one task that keeps the k best of a query over its stripe. Groups and stripes have a bounded
number of blocks, so blocks are shuffled once for each group or stripe they meet, not once for each pair, and none is broadcast.
"""
from __future__ import annotations

import math
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from leadvane.llm.common import written

U = np.uint64
PLANES = 6


@dataclass(frozen=True)
class CodeSpec:
    k: int = 20
    #: Standard deviations of the estimate that its bounds allow for.
    deviations: float = 3.0
    bits_per_component: int = 2
    codes_in_block: int = 8192
    queries_in_block: int = 512
    #: Blocks that one task holds at most.
    code_blocks_in_tile: int = 32
    query_blocks_in_tile: int = 64
    seed: int = 11


def clean_vectors(vectors: DataFrame) -> DataFrame:
    """vec_id, v (array<double>) of the vectors that take part.

    Left out: null ids, null or empty vectors, null or non-finite components, zero vectors, and vectors whose length is
    not the most frequent one (the smaller among equals). Rows that repeat a vec_id count once, with their smallest vector.
    """
    rows = vectors.where(F.col("vec_id").isNotNull() & F.col("embedding").isNotNull()).select(F.col("vec_id").cast("long"), F.col("embedding").cast("array<double>").alias("v"))
    finite = lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))
    rows = rows.where(F.forall("v", finite) & F.exists("v", lambda x: x != 0)).groupBy("vec_id").agg(F.min("v").alias("v"))
    rows = written(rows, "vectors")
    size = rows.groupBy(F.size("v").alias("d")).count().orderBy(F.desc("count"), "d").limit(1).collect()
    return rows.where(F.size("v") == size[0]["d"]) if size else rows


def rotation(d: int, spec: CodeSpec) -> np.ndarray:
    """A random orthogonal matrix, d x D with D bits a code, a multiple of 64: the vector is padded and turned."""
    wide = -(-d * spec.bits_per_component // 64) * 64
    q, r = np.linalg.qr(np.random.default_rng(spec.seed).normal(size=(wide, wide)))
    return (q * np.sign(np.diag(r)))[:d]


def _units(v: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Unit vectors and norms. Vectors are first divided by their largest component, so no square overflows or vanishes; a norm may be inf."""
    top = np.abs(v).max(axis=1, initial=0)
    scaled = v / top[:, None]
    size = np.sqrt((scaled * scaled).sum(axis=1))
    with np.errstate(over="ignore"):
        return scaled / size[:, None], top * size


def _codes(v: np.ndarray, turn: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Packed sign bits, and for each vector its norm and the inner product of its unit vector with its code."""
    unit, norm = _units(v)
    turned = unit @ turn
    agreed = np.abs(turned).sum(axis=1) / np.sqrt(turn.shape[1])
    return np.packbits(turned > 0, axis=1, bitorder="little").view(U), np.stack([norm, agreed], axis=1)


def _estimates(q: np.ndarray, turn: np.ndarray, code: np.ndarray, scalars: np.ndarray, spec: CodeSpec) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Estimated inner products (queries x vectors) of unit queries, each vector's error bound, and the query norms.

    In double precision: vectors of any finite size have an estimate, or one that is not finite and is reranked.
    """
    wide, (norm, agreed) = turn.shape[1], scalars.T
    unit, q_norm = _units(q)
    turned = unit @ turn
    low = turned.min(axis=1)
    step = np.maximum(turned.max(axis=1) - low, 1e-300) / (2 ** PLANES - 1)
    level = np.rint((turned - low[:, None]) / step[:, None]).astype(np.int64)
    ones = np.bitwise_count(code).sum(axis=1).astype(np.float64)
    both = np.zeros((len(q), len(code)), np.int32)
    for b in range(PLANES):
        plane = np.packbits((level >> b & 1).astype(bool), axis=1, bitorder="little").view(U)
        count = np.bitwise_count(plane[:, 0, None] & code[None, :, 0]).astype(np.int32)
        for w in range(1, code.shape[1]):
            count += np.bitwise_count(plane[:, w, None] & code[None, :, w])
        count <<= b
        both += count
    # sum of sign * component = 2 * (sum over set bits) - (sum over all)
    total = step * level.sum(axis=1) + low * wide
    e = both.astype(np.float64)
    e *= (2 * step)[:, None]
    e += (2 * low)[:, None] * ones[None, :]
    e -= total[:, None]
    with np.errstate(over="ignore", invalid="ignore"):
        e *= (norm / agreed / np.sqrt(wide))[None, :]
        variance = np.maximum(1 - agreed ** 2, 0) / max(wide - 1, 1) + step.max(initial=0) ** 2 / 12
        return e, spec.deviations * norm * np.sqrt(variance) / agreed + 1e-6 * norm, q_norm


def _reranked(e: np.ndarray, bound: np.ndarray, own: np.ndarray, exact: Callable[[np.ndarray], np.ndarray], q_norm: float, k: int) -> np.ndarray:
    """Places of the vectors to score for one query: those whose upper bound reaches the lowest exact score of the ``k`` best estimates.

    A vector without a finite estimate or bound is always scored; all are if no sound floor exists.
    """
    unsure = ~(np.isfinite(e) & np.isfinite(bound))
    order = np.where(own | unsure, -np.inf, e)
    best = np.argpartition(order, len(e) - k)[len(e) - k:]
    known = np.isfinite(order[best]).all()
    with np.errstate(over="ignore", invalid="ignore", divide="ignore"):
        floor = exact(best).min(initial=np.inf) / q_norm if known else np.nan
    if not np.isfinite(floor) or q_norm < 1e-290:
        return np.flatnonzero(~own)
    return np.flatnonzero(((e + bound >= floor - 1e-6 * abs(floor)) | unsure) & ~own)


def _exact(q: np.ndarray, v: np.ndarray) -> np.ndarray:
    """Inner products of rows with rows or one vector, summed component by component: equal vectors have equal scores."""
    out = np.zeros(len(v))
    with np.errstate(over="ignore", invalid="ignore"):
        for d in range(v.shape[1]):
            out += q[..., d] * v[:, d]
    return out


def _packed(rows: DataFrame, key: str, turn: np.ndarray) -> DataFrame:
    """One row for each block: ids, vectors, codes and scalars packed as binary. Blocks have a bounded number of rows."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in batches:
            for ids, vs, block in zip(t.column(1), t.column(2), t.column(0)):
                v = vs.values.flatten().to_numpy().astype(np.float64).reshape(-1, turn.shape[0])
                code, scalars = _codes(v, turn)
                packed = [ids.values.to_numpy().astype(np.int64), v, code, scalars]
                yield pa.RecordBatch.from_arrays([pa.array([block.as_py()], pa.int64()), *(pa.array([x.tobytes()], pa.binary()) for x in packed)], names=["block", "ids", "vectors", "codes", "scalars"])
    grouped = rows.groupBy(key).agg(F.sort_array(F.collect_list(F.struct("vec_id", "v"))).alias("g")).select(key, F.col("g.vec_id").alias("ids"), F.col("g.v").alias("vs"))
    return written(grouped.mapInArrow(run, "block long, ids binary, vectors binary, codes binary, scalars binary"), "codes")


def _grid(n_asked: int, n_codes: int, tasks: int, spec: CodeSpec) -> tuple[int, int]:
    """Groups of query blocks and stripes of code blocks: at least ``tasks`` tiles if there are so many blocks, none above its size.

    Vectors are sent once for each group, queries and their results once for each stripe, so there are fewer groups than stripes.
    """
    groups = min(max(-(-n_asked // spec.query_blocks_in_tile), math.isqrt(tasks) // 3, 1), max(n_asked, 1))
    return groups, min(max(-(-n_codes // spec.code_blocks_in_tile), -(-tasks // groups)), n_codes)


def _best(q_ids: np.ndarray, q: np.ndarray, blocks: list[tuple], turn: np.ndarray, spec: CodeSpec) -> list[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """query_id, vec_id and score of the ``k`` best of all blocks (ids, vectors, codes, scalars) for each query."""
    best: list[list] = [[] for _ in q]
    for ids, v, code, scalars in blocks:
        k = min(spec.k, len(ids))
        e, bound, q_norm = _estimates(q, turn, code, scalars, spec)
        for x in range(len(q)):
            y = _reranked(e[x], bound, ids == q_ids[x], lambda at, x=x: _exact(q[x], v[at]), q_norm[x], k)
            best[x].append((ids[y], _exact(q[x], v[y])))
            if len(best[x]) > 1:
                found, score = (np.concatenate(c) for c in zip(*best[x]))
                order = np.lexsort((found, -score))[:spec.k]
                best[x] = [(found[order], score[order])]
    out = []
    for x, ((found, score),) in enumerate(best):
        order = np.lexsort((found, -score))[:spec.k]
        out.append((np.full(len(order), q_ids[x]), found[order], score[order]))
    return out


def search(vectors: DataFrame, is_query: F.Column, spec: CodeSpec = CodeSpec()) -> DataFrame:
    """query_id, rank (from 1), vec_id, score: the ``k`` largest inner products of each query with all other vectors.

    Scores are the inner products of the original vectors in double precision; ties go to the smaller vec_id. Fewer than
    ``k`` candidates are all returned. ``clean_vectors`` tells which rows take part; other columns are ignored. A table
    without queries or vectors gives no rows.
    """
    rows = clean_vectors(vectors)
    first = rows.select(F.size("v").alias("d")).limit(1).collect()
    if not first:
        return rows.sparkSession.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    d = first[0]["d"]
    turn = rotation(d, spec)
    queries = rows.where(is_query)
    n, n_queries = rows.count(), queries.count()
    n_codes, n_asked = -(-n // spec.codes_in_block), -(-n_queries // spec.queries_in_block)
    blocks = _packed(rows.withColumn("block", F.pmod(F.xxhash64("vec_id"), F.lit(n_codes))), "block", turn)
    asked = _packed(queries.withColumn("qblock", F.pmod(F.xxhash64("vec_id", F.lit(1)), F.lit(max(1, n_asked)))), "qblock", turn)
    groups, stripes = _grid(n_asked, n_codes, 4 * rows.sparkSession.sparkContext.defaultParallelism, spec)
    spread = lambda n: F.explode(F.sequence(F.lit(0).cast("long"), F.lit(n - 1).cast("long")))
    left = asked.select(F.pmod("block", F.lit(groups)).alias("grp"), spread(stripes).alias("stripe"), F.col("block").alias("place"), "ids", "vectors")
    right = blocks.select(spread(groups).alias("grp"), F.pmod("block", F.lit(stripes)).alias("stripe"), F.col("block").alias("place"), "ids", "vectors", "codes", "scalars")

    def nearest(queries: pa.Table, codes: pa.Table) -> pa.Table:
        held = []
        for r in range(codes.num_rows):
            ids, v, code, scalars = (np.frombuffer(codes[c][r].as_buffer(), kind) for c, kind in (("ids", np.int64), ("vectors", np.float64), ("codes", U), ("scalars", np.float64)))
            held.append((ids, v.reshape(-1, d), code.reshape(len(ids), -1), scalars.reshape(-1, 2)))
        out = []
        for r in range(queries.num_rows if held else 0):
            q_ids, q = np.frombuffer(queries["ids"][r].as_buffer(), np.int64), np.frombuffer(queries["vectors"][r].as_buffer(), np.float64).reshape(-1, d)
            for a in range(0, len(q), 64):
                out += _best(q_ids[a:a + 64], q[a:a + 64], held, turn, spec)
        columns = zip(*out) if out else [np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0)]
        return pa.table([pa.array(np.concatenate(c) if out else c) for c in columns], names=["query_id", "vec_id", "score"])

    found = left.groupBy("grp", "stripe").cogroup(right.groupBy("grp", "stripe")).applyInArrow(nearest, "query_id long, vec_id long, score double")
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= spec.k).select("query_id", "rank", "vec_id", "score")
