"""Registered jobs run over everything that their operators take."""
from pathlib import Path

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry_points
from check_oracles import _rows
from leadvane.catalog import datasets, metrics
from leadvane.catalog.datasets import MAPPING
from leadvane.catalog.metrics import RESAMPLES
from leadvane.catalog.studies import DECLARED
from leadvane.config import FEATURES
from leadvane.operators import fits, models, ranking
from leadvane.sources.bindings import Tables
from leadvane.streaming import jobs

SF = "/root/testdata/sf0.001"
SMALL = "/root/testdata/sf0.01"


def run(spark, name, sf=SF):
    return entry_points.queries()[name](spark, sf)


def test_every_extra_is_screened(spark):
    rows = {r["feature"]: r for r in run(spark, "E19_leakage_screen_all").collect()}
    assert set(rows) == {e.column for e in DECLARED}
    for r in run(spark, "E19_leakage_screen").collect():
        assert round(rows[r["feature"]]["folded_auc"], 6) == r["folded_auc"]


def test_every_source_and_column_is_reported(spark):
    rows = {r["source"]: r for r in run(spark, "Q13_fill_gaps_all").collect()}
    assert set(rows) == {f.ref for f in MAPPING.fields} | {f"feature:{f.name}" for f in MAPPING.features}
    for r in run(spark, "Q13_fill_gaps").collect():
        assert all(rows[r["source"]][c] == r[c] for c in ("won_filled", "lost_filled", "flagged"))
    shares = {r["column"]: r for r in run(spark, "A22_fill_shares_all").collect()}
    assert set(shares) == set(Tables(spark, SF).leads().columns) - {"lead_id"}
    assert all(shares[r["column"]] == r for r in run(spark, "A22_fill_shares_by_outcome").collect())


def test_streamed_wins_and_matured_leads(spark):
    events = Tables(spark, SF).event_stages()
    won = {r["lead_id"] for r in events.where("stage = 'Won'").select("lead_id").distinct().collect()}
    sent = run(spark, "R3_streamed_close_events").collect()
    assert won and {r["lead_id"] for r in sent if r["stage"] == "won"} == won
    assert any(r["stage"] == "matured" for r in sent)


def test_sizes_of_the_studies(spark, monkeypatch):
    seen, refits, trees = [], [], []
    fit, refit, fit_trees = fits.fit_many, fits.refit_resamples, models.fit_boosted_trees
    monkeypatch.setattr(fits, "refit_resamples", lambda rows, n, *a, **b: refits.append(n) or refit(rows, n, *a, **b))
    monkeypatch.setattr(fits, "fit_many", lambda rows, n, *a, **b: seen.append(n) or fit(rows, n, *a, **b))
    monkeypatch.setattr(models, "fit_boosted_trees", lambda df, cols, *a, **b: trees.append(len(cols)) or fit_trees(df, cols, *a, **b))
    for name in ("E8_coefficient_bootstrap", "E18_feature_selection"):
        assert run(spark, name, SMALL).count() > 0
    assert refits == [RESAMPLES, RESAMPLES]
    seen.clear()
    curve = run(spark, "E16_subsampling_curve", SMALL).collect()
    assert {r["seeds"] for r in curve if not r["full"]} == {20} and [r["seeds"] for r in curve if r["full"]] == [1]
    assert run(spark, "E17_customer_sized_holdout", SMALL).count() == 20
    run(spark, "M8_boosted_trees", SF).count()
    assert seen[1] == 20 and trees == [len(FEATURES)]
    assert run(spark, "E20_generic_against_base", SF).count() == 1


@pytest.mark.parametrize("name", ["E6_exact_auc_interval", "E6_exact_samples", "E7_exact_auc_difference", "E21_exact_gap_recovered"])
def test_exact_bootstrap_equals_sql(spark, name):
    db = duckdb.connect()
    for f in Path(SF).glob("*.parquet"):
        db.execute(f"CREATE VIEW {f.stem} AS SELECT * FROM '{f}'")
    df, cur = run(spark, name), db.execute(entry_points.oracle_sql()[name])
    assert _rows(df.columns, df.collect()) == _rows([d[0] for d in cur.description], cur.fetchall())


def test_exact_bootstrap_keeps_every_score(spark):
    t = Tables(spark, SMALL)
    scores = metrics.test_rows(t).select("p").distinct().count()
    assert metrics.exact_rows(t).select("s1").distinct().count() == scores > metrics.boot_rows(t).select("s1").distinct().count()


def test_fits_do_not_keep_what_built_their_rows(spark):
    """A pass reads a written table, so its plan does not grow with the plan of the rows."""
    rows = spark.range(400).selectExpr("id AS lead_id", "cast(id % 3 = 0 AS double) AS y", "array(cast(id % 2 AS double)) AS x", "array(1.0D) AS w")
    read = []
    real = fits.written

    def seen(df):
        read.append(real(df))
        return read[-1]
    fits.written = seen
    try:
        beta = fits.fit_many(rows, 1, fits.column_weights())
    finally:
        fits.written = real
    assert len(read) == 1 and "Range" not in read[0]._jdf.queryExecution().toString() and "parquet" in read[0]._jdf.queryExecution().toString()
    assert abs(beta[0, 0] - np.log(134 / 266)) < 0.05


def test_bounds_come_from_one_aggregate(spark):
    """No sketch of a partition reaches the driver; NaN and null have no bucket of their own."""
    rows = spark.range(0, 10000, 1, 16).selectExpr("CASE WHEN id % 100 = 1 THEN double('NaN') WHEN id % 100 <> 2 THEN double(id) END AS v")
    bounds = ranking.bucket_bounds(rows, "v")
    assert len(bounds) == 7 and all(abs(b - 1250 * (i + 1)) < 400 for i, b in enumerate(bounds))
    assert ranking.bucket_bounds(rows.where("v < 0"), "v") == []


def test_slices_are_batches_of_many_files(spark, tmp_path):
    """every slice is written by all tasks, taken up whole as one batch, and in order."""
    t = Tables(spark, str(tmp_path))
    rows = spark.range(0, 4000, 1, 8).selectExpr("id", "timestamp_seconds(id * 60) AS at")
    batches = []

    def start(stream, root):
        jobs.run_to_end(stream, lambda b, i: batches.append((b.count(), b.agg(F.min("id"), F.max("id")).first(), b.rdd.getNumPartitions())), f"{root}/cp")
    root = datasets.stream_slices(t, rows, start, "at")
    full = [b for b in batches if b[0]]
    assert [b[0] for b in full] == [999, 1000, 1000, 1001] or sum(b[0] for b in full) == 4000 and len(full) == 4
    assert all(x[1][1] < y[1][0] for x, y in zip(full, full[1:]))
    assert len(spark.read.parquet(f"{root}/in").inputFiles()) > 8
    empty = []
    datasets.stream_slices(t, rows.limit(0), lambda s, r: jobs.run_to_end(s, lambda b, i: empty.append(b.count()), f"{r}/cp"), "at")
    assert empty == [0]
