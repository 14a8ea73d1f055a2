"""Order statistics and ranking metrics against numpy and brute force, hot values included."""
import numpy as np
import pytest
from pyspark.sql import functions as F

from leadvane.operators import bootstrap, cleaning, metrics, ranking, splits


@pytest.fixture(scope="module")
def data(spark):
    rng = np.random.default_rng(5)
    n = 997
    score = np.where(rng.random(n) < 0.35, 0.5, rng.random(n).round(2))  # a third of the rows share one score
    y = (rng.random(n) < 0.2 + 0.5 * score).astype(int)
    worth = np.where(y == 1, rng.lognormal(8, 1, n), 0.0)
    rows = [(i, int(a), float(s), float(w), "ab"[i % 2]) for i, (a, s, w) in enumerate(zip(y, score, worth))]
    df = spark.createDataFrame(rows, "lead_id bigint, y int, p double, worth double, g string").repartition(7, "lead_id").persist()
    return df, y, score, worth


def plain_auc(y, s):
    pos, neg = s[y == 1], s[y == 0]
    return ((pos[:, None] > neg[None, :]).sum() + 0.5 * (pos[:, None] == neg[None, :]).sum()) / (len(pos) * len(neg))


def test_percentiles(data):
    df, _, score, worth = data
    probs = [0.01, 0.2, 0.5, 0.97, 1.0]
    got = {r["prob"]: r["value"] for r in ranking.percentiles(df, "worth", probs).collect()}
    assert np.allclose([got[p] for p in probs], np.quantile(worth, probs))
    got = {r["prob"]: r["value"] for r in ranking.percentiles(df, "p", probs, interpolate=False).collect()}
    assert np.allclose([got[p] for p in probs], np.quantile(score, probs, method="inverted_cdf"))


def test_auc_overall_and_by_group(data):
    df, y, s, _ = data
    assert metrics.auc(df).first()["auc"] == pytest.approx(plain_auc(y, s), abs=1e-12)
    by = {r["g"]: r["auc"] for r in metrics.auc(df, groups=["g"]).collect()}
    for i, g in enumerate("ab"):
        assert by[g] == pytest.approx(plain_auc(y[i::2], s[i::2]), abs=1e-12)
    assert metrics.auc(df.where("y = 1")).first()["auc"] is None


def test_tie_averaged_share(data):
    df, y, s, worth = data
    n = int(len(s) * 0.2)
    thr = np.sort(s)[::-1][n - 1]
    above, at = s > thr, s == thr
    want = (worth[above].sum() + (n - above.sum()) / at.sum() * worth[at].sum()) / worth.sum()
    row = metrics.top_share(df, "p", ["worth"]).first()
    assert row["worth_share"] == pytest.approx(want) and row["ties_at_cut"] == at.sum() and row["threshold"] == thr


def test_global_rank_and_deciles(data):
    df, y, s, _ = data
    order = np.lexsort((np.arange(len(s)), s))
    ranked = ranking.with_global_rank(df, [F.col("p"), F.col("lead_id")]).orderBy("rank").select("lead_id", "rank").collect()
    assert [r["lead_id"] for r in ranked] == order.tolist() and [r["rank"] for r in ranked] == list(range(1, len(s) + 1))
    rank = np.empty(len(s), dtype=int)
    rank[order] = np.arange(1, len(s) + 1)
    edges = np.quantile(np.arange(1, len(s) + 1), np.arange(1, 10) / 10)
    want = np.searchsorted(edges, rank, side="left") + 1
    rows = metrics.calibration_by_decile(df).orderBy("decile").collect()
    assert [r["n"] for r in rows] == [int((want == d).sum()) for d in range(1, 11)]
    assert np.allclose([r["observed"] for r in rows], [y[want == d].mean() for d in range(1, 11)])


def test_value_scale(data):
    df, _, _, worth = data
    row = metrics.value_scale(df.where("worth > 0"), "worth").first()
    v = np.sort(worth[worth > 0])[::-1]
    assert row["p99"] == pytest.approx(np.percentile(v, 99)) and row["max_over_median"] == pytest.approx(v[0] / np.median(v))
    assert row["top1pct_share"] == pytest.approx(v[:max(1, int(len(v) * 0.01))].sum() / v.sum())


def test_bottom_share_and_top_rows(data):
    df, y, s, _ = data
    order = np.lexsort((np.arange(len(s)), s))[:int(len(s) * 0.1)]
    row = metrics.bottom_share(df.withColumn("all", F.lit("x")), ["y"], "p", "lead_id", 0.1, "all").first()
    assert row["y_bottom"] == pytest.approx(y[order].mean())
    top = ranking.top_rows(df, "p", "lead_id", 0.2)
    assert top.count() == int(len(s) * 0.2)
    with pytest.raises(ValueError):
        ranking.top_rows(df.limit(3), "p", "lead_id", 0.2)


def test_exact_samples(data):
    df = data[0]
    one = {r[0] for r in ranking.sample_exact(df, "lead_id", F.lit(100), 3).select("lead_id").collect()}
    again = {r[0] for r in ranking.sample_exact(df.repartition(3), "lead_id", F.lit(100), 3).select("lead_id").collect()}
    assert len(one) == 100 and one == again
    sizes = ranking.sample_exact(df, "lead_id", F.when(F.col("g") == "a", 17).otherwise(10_000), 1, ["g"]).groupBy("g").count().collect()
    assert {r["g"]: r["count"] for r in sizes} == {"a": 17, "b": 498}
    cuts = splits.hash_cuts(df, "lead_id", (50, 200), (0, 1))
    for (n, seed), cut in cuts.items():
        assert df.where(ranking.hash_order(F.col("lead_id"), seed) <= cut).count() == n


def test_folds_are_balanced_and_stratified(data):
    df = data[0]
    rows = splits.with_folds(df, 5).groupBy("y", "fold").count().collect()
    for y in (0, 1):
        sizes = [r["count"] for r in rows if r["y"] == y]
        assert len(sizes) == 5 and max(sizes) - min(sizes) <= 1


def test_repeat_flag_with_a_hot_key(spark):
    rows = [(i, "hot" if i % 3 == 0 else None if i % 3 == 1 else f"k{i}", i % 5) for i in range(300)]
    df = spark.createDataFrame(rows, "lead_id int, k string, created_at int")
    got = {r["lead_id"]: r["dup"] for r in cleaning.flag_repeats(df, "k", ["created_at", "lead_id"]).collect()}
    assert [i for i in got if got[i] is False and i % 3 == 0] == [0]
    assert not any(got[i] for i in got if i % 3)


def brute_resamples(y, scores, resamples):
    ids = np.arange(len(y))
    bins = {}
    for i in ids:
        bins.setdefault((y[i], *[s[i] for s in scores]), []).append(i)
    keys = list(bins)
    w = bootstrap.poisson_weights(np.array([min(bins[k]) for k in keys]), np.array([len(bins[k]) for k in keys]), resamples, 0)
    yy = np.array([k[0] for k in keys])
    out = []
    for j in range(len(scores)):
        s = np.array([k[1 + j] for k in keys])
        greater = (s[:, None] > s[None, :]) + 0.5 * (s[:, None] == s[None, :])
        pos, neg = w * (yy == 1)[:, None], w * (yy == 0)[:, None]
        out.append(np.einsum("ib,ij,jb->b", pos, greater, neg) / (pos.sum(0) * neg.sum(0)))
    return out


def test_resampled_auc_equals_brute_force_for_any_partitioning(data):
    df, y, s, _ = data
    other = (np.arange(len(s)) * 7919 % 13) / 13  # heavy ties between tasks
    full = df.withColumn("q", (F.col("lead_id") * 7919 % 13) / F.lit(13))
    want = brute_resamples(y, [s, other], 12)
    for parts in (1, 9):
        got = bootstrap.resampled_auc(full.repartition(parts), ["p", "q"], resamples=12).collect()
        for name, expected in zip(("p", "q"), want):
            values = [r["auc"] for r in sorted(got, key=lambda r: r["resample"]) if r["model"] == name]
            assert np.allclose(values, expected)


def test_bootstrap_properties(data):
    df, y, s, _ = data
    samples = bootstrap.resampled_auc(df, ["p"], resamples=200).persist()
    ci = bootstrap.interval(samples, "auc", ["model"]).first()
    assert ci["lo"] < plain_auc(y, s) < ci["hi"]
    same = bootstrap.resampled_auc(df.withColumn("p2", F.col("p")), ["p", "p2"], resamples=50)
    row = bootstrap.paired_summary(bootstrap.paired_differences(same, "p", "p2")).first()
    assert (row["lo"], row["hi"], row["p_value"]) == (0.0, 0.0, 1.0)
    w = bootstrap.poisson_weights(np.arange(5000), np.ones(5000, dtype=int), 40, 0)
    assert abs(w.mean() - 1) < 0.01 and abs(w.var() - 1) < 0.02
    assert np.abs(np.corrcoef(w.T) - np.eye(40)).max() < 0.08


def test_repeats_ignore_rows_without_a_time(spark):
    from leadvane.operators.cleaning import flag_repeats
    rows = [("k", None, 1), ("k", 10, 2), ("k", 20, 3), (None, 5, 4), ("n", None, 5), ("n", None, 6)]
    got = flag_repeats(spark.createDataFrame(rows, "k string, at long, id long"), "k", ["at", "id"]).collect()
    assert {r.id for r in got if r.dup} == {3}


def test_the_anchor_is_the_median_of_capped_values(spark):
    from leadvane.operators.value import ValueTransform, fit_transforms
    ref = spark.createDataFrame([(1.0,), (3.0,)], "v double")
    fitted = fit_transforms(ref, "v", [ValueTransform()])[0]
    assert abs(fitted.anchor - 1.97) < 1e-9


def test_weights_follow_one_rule_for_every_count():
    counts = np.repeat([1, 8, 9, 2000], 500)
    w = bootstrap.poisson_weights(np.arange(2000), counts, 60, 0)
    for c in (1, 8, 9, 2000):
        part = w[counts == c] / c
        assert abs(part.mean() - 1) < 0.02 and abs(part.var() * c - 1) < 0.05
    # a larger count never weighs less on the same hash
    same = np.stack([bootstrap.poisson_weights(np.arange(50), np.full(50, c), 60, 0) for c in (1, 2, 8, 9, 10, 40)])
    assert (np.diff(same, axis=0) >= 0).all()


def test_levels_of_blocks_do_not_change_the_result(data, monkeypatch):
    df, y, s, _ = data
    want = [r["auc"] for r in bootstrap.resampled_auc(df, ["p"], resamples=12).orderBy("resample").collect()]
    spark = df.sparkSession
    before = spark.conf.get("spark.sql.shuffle.partitions")
    monkeypatch.setattr(bootstrap, "FAN_IN", 3)
    spark.conf.set("spark.sql.shuffle.partitions", "40")
    try:
        got = [r["auc"] for r in bootstrap.resampled_auc(df, ["p"], resamples=12).orderBy("resample").collect()]
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
    assert np.allclose(got, want)


@pytest.mark.parametrize("kind", ["long", "string"])
def test_cuts_order_only_ties(spark, kind):
    """Heavy ties, cuts inside and at the ends of ties, several groups, empty and whole first parts."""
    rng = np.random.default_rng(6)
    rows = [(g, float(rng.choice([0.5, 0.5, 0.5, rng.random()])), int(i)) for g, n in (("a", 300), ("b", 7), ("c", 1)) for i in rng.permutation(n)]
    df = spark.createDataFrame([(g, s, str(i) if kind == "string" else i) for g, s, i in rows], f"g string, s double, k {kind}").repartition(5)
    cuts = lambda n: [F.floor(n * 0.1), F.floor(n * 0.35), F.floor(n * 0.35), n]
    got = {(r.g, r.k): (r.part, r.rank) for r in ranking.ranks(ranking.cut_parts(df, "s", "k", cuts, ["g"]), "s", "k", ["g"]).collect()}
    assert len(got) == len(rows)
    for g in "abc":
        order = sorted(((s, str(i) if kind == "string" else i) for h, s, i in rows if h == g))
        n = len(order)
        for rank, (_, k) in enumerate(order, 1):
            assert got[g, k] == (sum(c < rank for c in (int(n * .1), int(n * .35), int(n * .35), n)), rank)
    alone = ranking.cut_parts(df.where("g = 'a'").drop("g"), "s", "k", ranking.ten_cuts).groupBy("part").count().collect()
    assert sorted(r["part"] for r in alone) == list(range(10)) and {r["count"] for r in alone} == {30}
    assert ranking.cut_parts(df.limit(0), "s", "k", ranking.ten_cuts).count() == 0
