"""Rows that an explode has multiplied, and tables as long as the leads, are never the broadcast side of a join."""
import pytest
from pyspark.sql import functions as F

from leadvane.catalog.studies import customer_samples
from leadvane.operators import cleaning, metrics, ranking, splits


@pytest.fixture(scope="module")
def rows(spark, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("rows") / "t")
    spark.range(400).selectExpr("id as lead_id", "timestamp_seconds(id * 86400 * 7) as created_at", "id % 37 / 37.0D as p", "id % 3 = 0 as flag",
                                "concat('u', id % 90, '@x.example') as email", *[f"concat('wide ', id, {i}) as c{i}" for i in range(20)]).write.parquet(path)
    return spark.read.parquet(path)


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_cuts_within_groups_of_exploded_rows(rows):
    groups = F.explode(F.array(F.lit("all"), F.when(F.col("lead_id") < 100, "first"), F.when(F.col("lead_id") > 390, "last")))
    long = rows.select("lead_id", "p", "flag", groups.alias("population"))
    out = metrics.bottom_share(long, ["flag"], "p", "lead_id", 0.1, "population")
    assert "BuildLeft" not in plan(out)
    low = sorted((i % 37 / 37, i) for i in range(400))[:40]
    got = {r["population"]: r for r in out.collect()}
    assert set(got) == {"all", "first", "last"}  # rows without a population are in none
    assert (got["all"]["n"], got["all"]["n_bottom"]) == (400, 40) and got["first"]["n_bottom"] == 10 and got["last"]["n_bottom"] == 0
    assert got["all"]["flag_bottom"] == pytest.approx(sum(i % 3 == 0 for _, i in low) / 40)


def test_first_rows_of_a_key_are_dealt(rows):
    flagged = cleaning.flag_repeats(rows, "email", ["created_at", "lead_id"])
    assert "BroadcastExchange" not in plan(flagged)
    assert flagged.where("dup").count() == 310
def test_samples_of_exploded_rows(rows):
    drawn = rows.select("lead_id", F.explode(F.array(*[F.lit(d).cast("bigint") for d in (0, 1, None)])).alias("draw"))
    sample = ranking.sample_exact(drawn, "lead_id", F.lit(50), F.col("draw"), ["draw"])
    assert plan(sample).count("LeftSemi") >= 2 and "BuildLeft" not in plan(sample)
    got = {}
    for r in sample.collect():
        got.setdefault(r["draw"], set()).add(r["lead_id"])
    for d in (0, 1):
        order = [r[0] for r in rows.select("lead_id", ranking.hash_order(F.col("lead_id"), d).alias("h")).orderBy("h", "lead_id").limit(50).collect()]
        assert got[d] == set(order)
    assert set(got) == {0, 1}  # rows without a stratum are in no sample


def test_customer_samples_leave_the_pool_in_place(rows):
    held = customer_samples(rows, 3, 40)
    assert "BuildLeft" not in plan(held)
    maps = [r["m"] for r in held.select("m").collect()]
    assert sum(len(m) for m in maps) == 120 and sum(v for m in maps for v in m.values()) == 24


def test_hash_cuts_of_many_seeds(rows, monkeypatch):
    plans, collect = [], type(rows).collect
    monkeypatch.setattr(type(rows), "collect", lambda df: plans.append(plan(df)) or collect(df))
    cuts = splits.hash_cuts(rows, "lead_id", (10, 60), tuple(range(20)))
    assert len(cuts) == 40 and plans and "BuildLeft" not in "".join(plans)
