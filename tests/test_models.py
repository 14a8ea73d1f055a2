"""Fits, value transforms, extras, scoring invariants."""
import numpy as np
import pytest
from pyspark.sql import functions as F

from leadvane.config import LabelSpec, RunDates
from leadvane.functions.scores import linear_score, split_column
from leadvane.operators import design, extras, fits, models, screens, value
from leadvane.plans import training
from leadvane.sources.bindings import ORDERS_DATES, Tables

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def toy(spark):
    rng = np.random.default_rng(0)
    x = (rng.random((600, 3)) < [0.3, 0.5, 0.1]).astype(float)
    y = (rng.random(600) < 1 / (1 + np.exp(-(-1 + x @ [1.2, -0.7, 0.4])))).astype(float)
    rows = [(i, float(a), *map(float, r)) for i, (a, r) in enumerate(zip(y, x))]
    return spark.createDataFrame(rows, "lead_id bigint, y double, a double, b double, c double").repartition(5).persist(), x, y


def test_newton_fit_equals_spark_ml(toy):
    df, _, _ = toy
    one = fits.fit_one(df, ["a", "b", "c"])
    ml = models.fit_logistic(df.select("y", "a", "b", "c"), ["a", "b", "c"])
    for k in one:
        assert one[k] == pytest.approx(ml[k], abs=1e-4)


def test_many_fits_share_passes(toy):
    df, x, y = toy
    rows = df.select("lead_id", "y", fits.design_array(["a", "b", "c"]), F.array((F.col("lead_id") % 2).cast("double"), F.lit(1.0), F.lit(0.0)).alias("w"))
    beta = fits.fit_many(rows, 3, fits.column_weights(), c=[0.5, 2.0, 0.5])
    assert np.isnan(beta[2]).all()
    for k, (mask, c) in enumerate(((np.arange(600) % 2 == 1, 0.5), (np.ones(600, bool), 2.0))):
        z = np.column_stack([np.ones(mask.sum()), x[mask]])
        grad = c * z.T @ (y[mask] - 1 / (1 + np.exp(-z @ beta[k]))) - np.r_[0, beta[k][1:]]
        assert np.abs(grad).max() < 1e-6


def test_ridge_matches_closed_form(spark):
    rng = np.random.default_rng(1)
    x = (rng.random((80, 2)) < 0.5).astype(float)
    v = np.exp(8 + x @ [0.5, -0.2] + rng.normal(0, 0.3, 80))
    df = spark.createDataFrame([(float(a), *map(float, r)) for a, r in zip(v, x)], "deal_value double, a double, b double")
    m = models.fit_deal_value(df, ["a", "b"])
    xc, yc = x - x.mean(0), np.log(v) - np.log(v).mean()
    w = np.linalg.solve(xc.T @ xc + 3.0 * np.eye(2), xc.T @ yc)
    assert [m.weights["a"], m.weights["b"]] == pytest.approx(w, abs=1e-8)
    resid = np.log(v) - (m.weights["(intercept)"] + x @ w)
    assert m.residual_sd == pytest.approx(resid.std(ddof=1)) and m.correction == pytest.approx(np.exp(resid.var(ddof=1) / 2))


def values_frame(spark, v):
    return spark.createDataFrame([(float(a),) for a in v], "v double")


def test_transform_properties(spark):
    v = np.random.default_rng(2).lognormal(5, 1, 301)
    df = values_frame(spark, v)
    f = value.fit_transform(df, "v", value.ValueTransform(floor=None))
    cap = np.percentile(v, 97)
    assert f.cap == pytest.approx(cap) and f.anchor == pytest.approx(np.median(np.minimum(v, cap)))
    out = np.array([r[0] for r in df.orderBy("v").select(f.apply(F.col("v"))).collect()])
    assert out.sum() == pytest.approx(np.minimum(v, cap).sum()) and (np.diff(out) >= 0).all()
    tiers = value.fit_transform(df, "v", value.ValueTransform(None, None, "none", 4))
    sent = df.select(tiers.apply(F.col("v")).alias("s")).agg(F.sum("s"), F.count_distinct("s")).first()
    assert sent[0] == pytest.approx(v.sum()) and sent[1] == 4
    low = value.fit_transform(df, "v", value.ValueTransform(cap_percentile=30, floor=None))
    assert low.anchor == pytest.approx(np.median(np.minimum(v, np.percentile(v, 30))))


def test_transform_refusals(spark):
    with pytest.raises(ValueError, match="empty"):
        value.fit_transform(values_frame(spark, [1, 1, 1]), "v", value.ValueTransform(None, None, "none", 2))
    with pytest.raises(ValueError, match="positive median"):
        value.fit_transform(values_frame(spark, [0, 0, 5]), "v", value.ValueTransform())
    with pytest.raises(ValueError):
        value.fit_transform(values_frame(spark, [-1, 2]), "v", value.ValueTransform())
    f = value.fit_transform(values_frame(spark, [1, 2, 3]), "v", value.ValueTransform())
    with pytest.raises(Exception, match="finite and >= 0"):
        values_frame(spark, [-1.0]).select(f.apply(F.col("v"))).collect()
    assert value.ValueTransform().name == "cap p97 + log + floor £25" and value.ValueTransform(None, None, "none").name == "identity"


def test_close_stage(spark):
    df = spark.sql("""select * from values (1, timestamp'2026-01-01', timestamp'2026-02-01', 10.0D), (2, timestamp'2026-01-01', timestamp'2026-02-01', null),
        (3, timestamp'2026-01-01', null, null), (4, timestamp'2026-09-01', null, null), (5, timestamp'2026-01-01', timestamp'2026-10-01', 7.0D) t(id, created_at, won_at, deal_value)""")
    rows = df.orderBy("id").select(*value.close_stage(120, "2026-09-24").values()).collect()
    assert [(r[0], r[2]) for r in rows] == [(10.0, "known"), (None, "unknown_amount"), (0.0, "known"), (None, "pending"), (0.0, "known")]


def test_extras_boundaries(spark):
    cat = ["a"] * 30 + ["b"] * 29 + ["c"] * 30 + [" "] * 5 + ["other"] * 2
    num = [0.0] * 90 + [1.0] * 6
    df = spark.createDataFrame([(c, n, None) for c, n in zip(cat, num)], "x_kind string, x_flag double, x_none double")
    kind, flag, none = extras.fit_encoder([extras.Extra("kind", "categorical"), extras.Extra("flag", "numeric"), extras.Extra("none", "numeric")], df)
    assert kind.levels == ("a", "c", "other", "missing") and kind.reference == "a"
    assert kind.train_counts == {"a": 30, "c": 30, "other": 31, "missing": 5}
    assert flag.edges == (0.0,) and flag.levels == ("<=0", ">0", "missing")
    assert none.levels == ("all", "missing") and none.reference == "missing"
    new = spark.createDataFrame([("zzz", 0.5, None), (None, None, None)], "x_kind string, x_flag double, x_none double")
    assert [tuple(r) for r in extras.encode(new, [kind, flag, none]).collect()] == [("other", ">0", "missing"), ("missing", "missing", "missing")]
    with pytest.raises(Exception, match="not a finite number"):
        extras.encode(spark.createDataFrame([("1e400",)], "x_flag string"), [flag]).collect()
    assert extras.bin_labels((1.0, 2.5)) == ("<=1", "(1, 2.5]", ">2.5")
    assert extras.bin_labels((1.0000001, 1.0000002))[0] == "<=1.0000001"


def test_design_refuses_unknown_levels(spark):
    df = spark.createDataFrame([(1, "A"), (2, "E")], "lead_id int, form_variant string")
    with pytest.raises(Exception, match="outside its declared levels"):
        design.wide_design(df, {"form_variant": "A"}).collect()
    assert [tuple(r) for r in design.unknown_levels(df, {"form_variant": ("A", "B")}).collect()] == [("form_variant", "E", 1)]
    row = design.wide_design(df.where("lead_id = 1"), {"form_variant": "A"}).first()
    assert len(row) == 4 and sum(row[1:]) == 0
    assert split_column("a=b=c") == ("a", "b=c")


def test_one_lead_scores_like_the_batch(spark):
    t = Tables(spark, SF)
    rows = training.prepare(t.leads(), t.crm(), t.companies(), LabelSpec(), ORDERS_DATES).persist()
    model = training.train(rows, margin=0.3)
    leads = t.leads().where("email is not null").persist()
    batch = training.score_batch(leads, t.companies(), model).persist()
    one = training.score_batch(leads.where("lead_id = 77"), t.companies(), model).first()
    whole = batch.where("lead_id = 77").first()
    assert one["p_formula"] == whole["p_formula"] and one["value_at_submit"] == whole["value_at_submit"]
    feats = training.featurise_batch(leads, t.companies())
    parts = models.explain_scores(design.long_design(feats), model.win, feats).groupBy("lead_id").agg(F.sum("log_odds").alias("s"))
    worst = parts.join(feats.select("lead_id", linear_score(model.win).alias("z")), "lead_id").agg(F.max(F.abs(F.col("s") - F.col("z")))).first()[0]
    assert worst < 1e-9
    with pytest.raises(ValueError, match="unknown columns"):
        training.as_training_schema(leads.withColumn("spy", F.lit(1)))


def test_calibration_matches_optimum(spark):
    rng = np.random.default_rng(4)
    p = rng.random(400) * 0.8 + 0.1
    y = (rng.random(400) < p).astype(float)
    df = spark.createDataFrame([("w", float(a), float(b)) for a, b in zip(y, p)], "g string, y double, p double")
    row = screens.calibration(df, "g").first()
    x = np.log(p / (1 - p))
    assert np.sum(y - 1 / (1 + np.exp(-(row["intercept"] + x)))) == pytest.approx(0, abs=1e-6)
    assert RunDates().horizon_days == 120 and row["slope"] > 0


def test_fits_leave_the_callers_cache_and_mark_missing_fits(spark):
    data = [(i, [float(i % 3), float(i % 2)], float(i % 5 == 0), [1.0, float(i % 5 == 0)]) for i in range(60)]
    rows = spark.createDataFrame(data, "lead_id bigint, x array<double>, y double, w array<double>").persist()
    beta = fits.fit_many(rows, 2, fits.column_weights())
    assert rows.storageLevel.useMemory and np.isfinite(beta[0]).all() and np.isnan(beta[1]).all()
    ps = fits.score_many(rows, beta, ["lead_id"]).select(F.posexplode("ps").alias("k", "p"))
    assert {r.k: r.n for r in ps.where(F.col("p").between(0, 1)).groupBy("k").agg(F.count("*").alias("n")).collect()} == {0: 60}
    rows.unpersist()
    fits.fit_many(rows, 2, fits.column_weights())
    assert not rows.storageLevel.useMemory


def test_refits_by_gradients_equal_full_refits(spark):
    """Within ten times the last step, also for a level that a handful of rows hold and resamples may lose."""
    rng = np.random.default_rng(8)
    x = (rng.random((700, 6)) < np.array([.5, .3, .1, .02, .01, .004])).astype(float)
    y = (rng.random(700) < 1 / (1 + np.exp(1 - x @ np.array([1, -1, 2, -2, 3, 3])))).astype(float)
    data = [(i, [float(v) for v in a], float(b)) for i, (a, b) in enumerate(zip(x, y))]
    rows = spark.createDataFrame(data, "lead_id bigint, x array<double>, y double").repartition(7)
    weights = fits.bootstrap_weights(150, 3)
    full, fast = fits.fit_many(rows, 150, weights, c=0.5), fits.refit_resamples(rows, 150, weights, c=0.5)
    assert np.abs(full - fast).max() < 10 * fits.REFIT_TOLERANCE and np.std(full[:, 1]) > 0.05
    alone = rows.withColumn("y", F.lit(1.0))
    assert np.isnan(fits.refit_resamples(alone, 4, weights)).all()


def test_refits_that_do_not_settle_are_fitted_in_full(spark, monkeypatch):
    rng = np.random.default_rng(9)
    data = [(i, [float(v) for v in rng.integers(0, 2, 3)], float(rng.random() < .4)) for i in range(120)]
    rows = spark.createDataFrame(data, "lead_id bigint, x array<double>, y double").repartition(3)
    weights = fits.bootstrap_weights(20, 1)
    monkeypatch.setattr(fits, "REFIT_PASSES", 2)
    assert np.abs(fits.refit_resamples(rows, 20, weights) - fits.fit_many(rows, 20, weights)).max() < 1e-7


def test_sums_in_levels(spark):
    parts = spark.range(500).select(F.explode(F.sequence(F.lit(0), F.lit(2))).alias("k"), F.col("id").alias("part"), F.array(F.col("id").cast("double"), F.lit(1.0)).alias("s"))
    got = fits.levelled(parts, 500).collect()
    assert max(sum(r.k == k for r in got) for k in range(3)) <= fits.FAN_IN
    for k in range(3):
        assert np.sum([r.s for r in got if r.k == k], axis=0).tolist() == [500 * 499 / 2, 500.0]
    rows = spark.range(300).select(F.col("id").alias("lead_id"), F.array((F.col("id") % 3).cast("double")).alias("x"), (F.col("id") % 2).cast("double").alias("y"), F.array(F.lit(1.0)).alias("w"))
    many, few = (fits.fit_many(rows.repartition(n), 1, fits.column_weights()) for n in (150, 2))
    assert many == pytest.approx(few, abs=1e-7)


def test_calibration_without_a_finite_slope(spark):
    """One class has no fit; equal predictions and parted classes have an intercept alone; a far start still settles."""
    rows = [("one", 0.0, .1)] * 5 + [("equal", float(i % 3 == 0), .3) for i in range(30)] + [("parted", float(i > 9), .1 + i / 25) for i in range(20)]
    rows += [("sharp", float((i % 10) < 4), 1e-9 if i % 2 else 1 - 1e-9) for i in range(200)]
    got = {r.g: r for r in screens.calibration(spark.createDataFrame(rows, "g string, y double, p double"), "g").collect()}
    assert got["one"].slope is None and got["one"].intercept is None and got["one"].n == 5
    assert got["equal"].slope is None and got["equal"].intercept == pytest.approx(np.log((1 / 3) / (2 / 3)) - np.log(.3 / .7))
    assert got["parted"].slope is None and np.isfinite(got["parted"].intercept)
    assert abs(got["sharp"].slope) < 0.1 and np.isfinite(got["sharp"].intercept)
