"""Order statistics without a global single-task window.

Values are first counted per distinct value (a partial aggregate, so a value that holds a third of the rows is one
row), then put into quantile buckets of the value range; running totals are windows inside a bucket plus an offset
per bucket. Cuts by rank order only the rows that tie at a cut. ``with_global_rank``, for orders over several columns, uses a
range-partitioned sort whose row ids are fixed by a checkpoint.
"""
from __future__ import annotations

from collections.abc import Callable, Sequence
from functools import reduce

from pyspark.ml.feature import Bucketizer
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from leadvane.session import ensure_checkpoint_dir

_ROW_BITS = 33  # monotonically_increasing_id keeps the row number of a partition in its lower 33 bits


def _number(df: DataFrame, key: str) -> Column:
    """``key`` as a double in its own order; a string by its first six bytes."""
    if dict(df.dtypes)[key] != "string":
        return F.col(key).cast("double")
    return F.conv(F.rpad(F.hex(F.substring(F.col(key).cast("binary"), 1, 6)), 12, "0"), 16, 10).cast("double")


def bucket_bounds(df: DataFrame, key: str) -> list[float]:
    """At most one inner bound per shuffle partition: balanced cut points of ``key`` (they affect balance only).

    The sketches of all partitions are merged in a task; only the bounds reach the driver.
    """
    n = min(max(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), 8), 2000)
    sketch = F.percentile_approx("k", [i / n for i in range(1, n)], 4 * n)
    found = df.select(_number(df, key).alias("k")).where("k is not null and not isnan(k)").agg(sketch).first()[0]
    return sorted(set(found or []))


def with_bucket(df: DataFrame, key: str, bounds: Sequence[float]) -> DataFrame:
    """Adds ``_bucket``, an order-preserving bucket of ``key``."""
    if not bounds:
        return df.withColumn("_bucket", F.lit(0.0))
    splits = [-float("inf"), *bounds, float("inf")]
    return (Bucketizer(splits=splits, inputCol="_bucket_key", outputCol="_bucket")
            .transform(df.withColumn("_bucket_key", _number(df, key))).drop("_bucket_key"))


def running_totals(df: DataFrame, key: str, measures: Sequence[str], groups: Sequence[str] = (),
                   bounds: Sequence[float] | None = None) -> DataFrame:
    """Adds ``<m>_before`` (sum of ``m`` over smaller keys) and ``<m>_total`` per group; keys unique per group."""
    if bounds is None:
        bounds = bucket_bounds(df, key)
    by = ["_g", *groups]
    b = with_bucket(df.withColumn("_g", F.lit(0)), key, bounds)
    inside = W.partitionBy(*by, "_bucket").orderBy(key).rowsBetween(W.unboundedPreceding, -1)
    across = W.partitionBy(*by).orderBy("_bucket").rowsBetween(W.unboundedPreceding, -1)
    zero = F.lit(0)
    local = b.withColumns({f"{m}_before": F.coalesce(F.sum(m).over(inside), zero) for m in measures})
    sums = b.groupBy(*by, "_bucket").agg(*[F.sum(m).alias(f"{m}_sum") for m in measures])
    offsets = sums.select(*by, "_bucket",
                          *[F.coalesce(F.sum(f"{m}_sum").over(across), zero).alias(f"{m}_off") for m in measures],
                          *[F.sum(f"{m}_sum").over(W.partitionBy(*by)).alias(f"{m}_total") for m in measures])
    joined = local.join(offsets, [*by, "_bucket"])
    return (joined.withColumns({f"{m}_before": F.col(f"{m}_before") + F.col(f"{m}_off") for m in measures})
            .drop("_g", "_bucket", *[f"{m}_off" for m in measures]))


def percentiles(df: DataFrame, value: str, probs: Sequence[float], groups: Sequence[str] = (),
                interpolate: bool = True) -> DataFrame:
    """Exact percentiles per group as rows ``(groups, prob, value)``.

    Linear interpolation between order statistics, or (``interpolate=False``) the smallest observed value whose
    cumulative share reaches the probability.
    """
    rows = df.where(F.col(value).isNotNull())
    counts = rows.groupBy(*groups, value).agg(F.count("*").alias("n"))
    ranked = running_totals(counts, value, ["n"], groups, bucket_bounds(rows, value))
    wanted = []
    for p in probs:
        if interpolate:
            h = (F.col("n_total") - 1) * F.lit(float(p))
            wanted += [F.struct(F.lit(float(p)).alias("prob"), F.floor(h).alias("pos"), (1 - (h - F.floor(h))).alias("w")),
                       F.struct(F.lit(float(p)).alias("prob"), F.ceil(h).alias("pos"), (h - F.floor(h)).alias("w"))]
        else:
            k = F.greatest(F.ceil(F.col("n_total") * F.lit(float(p))) - 1, F.lit(0))
            wanted.append(F.struct(F.lit(float(p)).alias("prob"), k.cast("bigint").alias("pos"), F.lit(1.0).alias("w")))
    hit = F.filter(F.array(*wanted), lambda s: (s["pos"] >= F.col("n_before")) & (s["pos"] < F.col("n_before") + F.col("n")))
    found = ranked.select(*groups, value, F.explode(hit).alias("s"))
    return found.groupBy(*groups, F.col("s.prob").alias("prob")).agg(F.sum(F.col(value) * F.col("s.w")).alias("value"))


def percentile_columns(df: DataFrame, value: str, named: dict[str, float], groups: Sequence[str] = ()) -> DataFrame:
    """``percentiles`` as one row per group with the given column names."""
    rows = percentiles(df, value, list(named.values()), groups)
    return rows.groupBy(*groups).agg(*[F.max(F.when(F.col("prob") == p, F.col("value"))).alias(n)
                                       for n, p in named.items()])


def with_global_rank(df: DataFrame, order: Sequence[Column | str], rank: str = "rank") -> DataFrame:
    """Adds the 1-based position of every row in the total order ``order`` (end it with a unique key).

    The sort is range partitioned on the whole order, so rows that share a score still spread over tasks. The row ids
    are checkpointed: a lost executor cannot renumber them.
    """
    ensure_checkpoint_dir(df.sparkSession)
    ordered = (df.repartitionByRange(*order).sortWithinPartitions(*order)
               .withColumn("_row", F.monotonically_increasing_id()).checkpoint())
    part = F.shiftright("_row", _ROW_BITS)
    sizes = ordered.groupBy(part.alias("_part")).agg(F.count("*").alias("_n"))
    before = W.orderBy("_part").rowsBetween(W.unboundedPreceding, -1)  # one row per range partition
    offsets = sizes.select("_part", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_offset"))
    in_part = F.col("_row").bitwiseAND(F.lit((1 << _ROW_BITS) - 1))
    return (ordered.withColumn("_part", part).join(offsets, "_part")
            .withColumn(rank, F.col("_offset") + in_part + 1).drop("_row", "_part", "_offset"))


def ranks(df: DataFrame, score: str, key: str, groups: Sequence[str] = (), rank: str = "rank") -> DataFrame:
    """Adds the 1-based position of every row by ascending ``score``, ties by the unique ``key``, per group.

    Distinct scores are counted and accumulated; only rows that share a score are ordered, in buckets of their keys.
    """
    counts = df.groupBy(*groups, score).agg(F.count("*").alias("_n"))
    placed = df.join(running_totals(counts, score, ["_n"], groups).drop("_n_total"), [*groups, score])
    alone = placed.where("_n = 1").withColumn(rank, F.col("_n_before") + 1)
    tied = _tie_position(placed.where("_n > 1"), score, key, groups).withColumn(rank, F.col("_n_before") + F.col("_at"))
    return alone.unionByName(tied.drop("_at")).drop("_n", "_n_before")


def _tie_position(tied: DataFrame, score: str, key: str, groups: Sequence[str]) -> DataFrame:
    """Adds ``_at``, the 1-based position by ``key`` among the rows of a group with one score."""
    out = running_totals(tied.withColumn("_one", F.lit(1)), key, ["_one"], [*groups, score])
    return out.withColumn("_at", F.col("_one_before") + 1).drop("_one", "_one_before", "_one_total")


def cut_parts(df: DataFrame, score: str, key: str, cuts: Callable[[Column], Sequence[Column]], groups: Sequence[str] = (),
              part: str = "part") -> DataFrame:
    """Adds the number of cuts that a row lies behind, in the order of ``score`` and, for ties, of the unique ``key``.

    ``cuts`` gives, for the number of rows of a group, the rank of the last row before each cut, ascending. Counts per score
    tell which score every cut falls on and how many rows of that score come before it; all other rows are placed by
    comparison, and only rows with a score that a cut divides are ordered.
    """
    counts = df.groupBy(*groups, score).agg(F.count("*").alias("_n"))
    totals = running_totals(counts, score, ["_n"], groups)
    wanted = F.array(*[F.struct(c.cast("long").alias("last"), F.col(score).alias("at"), (c - F.col("_n_before")).cast("long").alias("take"), F.col("_n").alias("of"))
                       for c in cuts(F.col("_n_total"))])
    hit = F.filter(wanted, lambda c: (c["take"] >= 1) & (c["take"] <= c["of"]))
    none = F.filter(wanted, lambda c: c["last"] < 1)  # before the first row: everything is behind it
    first = F.when(F.col("_n_before") == 0, F.size(none)).otherwise(0)
    marks = totals.groupBy(*groups).agg(F.flatten(F.collect_list(F.when(F.size(hit) > 0, hit))).alias("_cuts"), F.sum(first).alias("_empty"))
    # one row a group; by their plan Spark may take rows multiplied by an explode for smaller, or deal them by group
    rows = df.join(F.broadcast(marks), list(groups)) if groups else df.join(F.broadcast(marks))
    split = F.filter("_cuts", lambda c: (c["at"] == F.col(score)) & (c["take"] < c["of"]))
    passed = F.size(F.filter("_cuts", lambda c: c["at"] < F.col(score))) + F.col("_empty")
    rows = rows.withColumns({"_split": split, part: passed.cast("int")})
    whole, tied = rows.where(F.size("_split") == 0), _tie_position(rows.where(F.size("_split") > 0), score, key, groups)
    behind = F.size(F.filter("_split", lambda c: c["take"] < F.col("_at")))
    tied = tied.withColumn(part, (F.col(part) + behind).cast("int")).drop("_at")
    return whole.unionByName(tied, allowMissingColumns=False).select(*df.columns, part)


def top_rows(df: DataFrame, score: str, key: str, fraction: float) -> DataFrame:
    """The ``int(n x fraction)`` best rows by score, ties by key, with their rank; refuses an empty cut."""
    n = df.count()
    k = int(n * fraction)
    if k < 1:
        raise ValueError(f"top {fraction:.0%} of {n} rows is empty")
    best = cut_parts(df.withColumn("_down", -F.col(score)), "_down", key, lambda _: [F.lit(k)]).where("part = 0").drop("part")
    return ranks(best, "_down", key).drop("_down")


def ten_cuts(n: Column) -> list[Column]:
    """Ranks of the last rows of the first nine of ten parts, with quantile-cut edges (not ``ntile``)."""
    return [F.call_function("div", F.lit(b) * (n - 1), F.lit(10)) + 1 for b in range(1, 10)]


def smallest_per_group(df: DataFrame, group: str, order: Sequence[str], n: int) -> DataFrame:
    """First ``n`` rows per group; Spark keeps only ``n`` rows per group and task before the shuffle."""
    w = W.partitionBy(group).orderBy(*order)
    return df.withColumn("pos", F.row_number().over(w)).where(F.col("pos") <= n)


def hash_order(key: Column, seed: Column | int) -> Column:
    """Reproducible pseudo-random integer in [0, 2147483647) of an integer key and a seed, portable to any SQL."""
    p = 2147483647
    seed = F.lit(seed) if isinstance(seed, int) else seed
    a = (F.pmod(key.cast("bigint"), F.lit(p)) * 48271 + F.pmod(seed.cast("bigint"), F.lit(p)) * 69621 + 12345) % p
    b = (a * a + 40014 * a + 7) % p
    return (b * b + 16807 * b + 11) % p


def sample_exact(df: DataFrame, key: str, sizes: Column, seed: Column | int = 0, strata: Sequence[str] = ()) -> DataFrame:
    """Exactly ``sizes`` rows per stratum without replacement, in hash order (all rows when the stratum is smaller).

    Hashes are uniform, so equal slices of the hash range balance by themselves: whole slices below the cut are kept
    and only the cut slice is ordered. The rows meet the counts of their slices by semi joins, which never broadcast the rows:
    Spark takes those that an explode has multiplied for as many as before.
    """
    slices = min(max(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), 8), 4096)
    by = ["_g", *strata]
    d = (df.withColumns({"_g": F.lit(0), "_h": hash_order(F.col(key), seed), "_want": sizes})
         .withColumn("_slice", F.floor(F.col("_h") * slices / F.lit(2147483647)).cast("int")))
    counts = d.groupBy(*by, "_slice").agg(F.count("*").alias("_n"))
    before = W.partitionBy(*by).orderBy("_slice").rowsBetween(W.unboundedPreceding, -1)
    offsets = counts.select(*by, "_slice", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_off"), "_n")
    place = offsets.select(*[F.col(c).alias(f"{c}_of") for c in (*by, "_slice")], "_off", "_n")
    same = reduce(Column.__and__, [F.col(c) == F.col(f"{c}_of") for c in (*by, "_slice")])
    whole = d.join(place, same & (F.col("_off") + F.col("_n") <= F.col("_want")), "left_semi")
    cut = d.join(place, same & (F.col("_off") < F.col("_want")) & (F.col("_off") + F.col("_n") > F.col("_want")), "left_semi")
    rn = F.row_number().over(W.partitionBy(*by, "_slice").orderBy("_h", key))
    ordered = cut.withColumn("_rn", rn).join(offsets, [*by, "_slice"])
    part = ordered.where(F.col("_off") + F.col("_rn") <= F.col("_want")).drop("_rn", "_off", "_n")
    return whole.unionByName(part).drop("_g", "_h", "_want", "_slice")
