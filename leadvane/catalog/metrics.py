"""Queries: ranking, calibration, capture, bootstrap and value-layer results over frozen-weight scores."""
from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from leadvane.catalog.base import query, view
from leadvane.catalog.features import enriched, scored, test_rows, v2
from leadvane.catalog.outcomes import ORDERS_DATES, cleaned, ts
from leadvane.catalog.views import FMT, T_AS_OF, T_TEST_FROM, WEIGHTS
from leadvane.config import BENCHMARK_RULES
from leadvane.functions import scores
from leadvane.operators import bootstrap, design, labels, metrics, models, ranking, value
from leadvane.sources.bindings import Tables

P = bootstrap.P


def sql_auc(src: str, score: str, groups: tuple[str, ...] = (), y: str = "y") -> str:
    g = "".join(f"{c}, " for c in groups)
    part = f"PARTITION BY {g[:-2]}" if groups else ""
    by = f"GROUP BY {g[:-2]}" if groups else ""
    return f"""SELECT {g}count(*) AS n, sum({y})::BIGINT AS wins, CASE WHEN sum({y}) BETWEEN 1 AND count(*) - 1 THEN
      round((sum(CASE WHEN {y} = 1 THEN r END) - sum({y}) * (sum({y}) + 1) / 2) / (sum({y}) * (count(*) - sum({y}))), 6) END AS auc
    FROM (SELECT *, (rank() OVER ({part} ORDER BY {score}) + (count(*) OVER (PARTITION BY {g}{score}) - 1) / 2)::DOUBLE AS r
      FROM {src}) {by}"""


def rounded_auc(df: DataFrame) -> DataFrame:
    return df.withColumns({"auc": F.round("auc", 6), "wins": F.col("wins").cast("bigint"), "n": F.col("n").cast("bigint")})


@query("E1_auc", sql_auc("test_rows", "p"))
def auc(t: Tables) -> DataFrame:
    return rounded_auc(metrics.auc(test_rows(t)))


@query("W3_average_ranks", """
SELECT round(p, 9) AS p, count(*) AS n, avg(r) AS average_rank FROM (
  SELECT p, (rank() OVER (ORDER BY p) + (count(*) OVER (PARTITION BY p) - 1) / 2)::DOUBLE AS r FROM scored) GROUP BY round(p, 9)""")
def average_ranks(t: Tables) -> DataFrame:
    counts = scored(t).groupBy("p").agg(F.count("*").alias("n"))
    ranked = ranking.running_totals(counts, "p", ["n"])
    mid = F.col("n_before") + (F.col("n") + 1) / 2
    return ranked.groupBy(F.round("p", 9).alias("p")).agg(
        F.sum("n").alias("n"), (F.sum(mid * F.col("n")) / F.sum("n")).alias("average_rank"))


@query("E2_brier", "SELECT round(avg((y - p) * (y - p)), 8) AS brier, count(*) AS n FROM test_rows")
def brier(t: Tables) -> DataFrame:
    return test_rows(t).agg(F.round(metrics.brier(), 8).alias("brier"), F.count("*").alias("n"))


def sql_top_share(src: str, score: str, target: str, fraction: float = 0.2) -> str:
    return f"""SELECT count(*) AS n_rows, any_value(cut) AS cut_size, round(max(thr), 6) AS threshold,
      count(*) FILTER (WHERE s = thr) AS ties_at_cut,
      round((coalesce(sum(t) FILTER (WHERE s > thr), 0) + (any_value(cut) - count(*) FILTER (WHERE s > thr))::DOUBLE
        / count(*) FILTER (WHERE s = thr) * sum(t) FILTER (WHERE s = thr)) / sum(t), 6) AS share
    FROM (SELECT *, max(CASE WHEN rn = cut THEN s END) OVER () AS thr FROM (
      SELECT {score} AS s, ({target})::DOUBLE AS t, row_number() OVER (ORDER BY {score} DESC) AS rn,
        floor(count(*) OVER () * {fraction}::DOUBLE)::BIGINT AS cut FROM {src}))"""


def _share(df: DataFrame, score: str, target: str) -> DataFrame:
    out = metrics.top_share(df, score, [target])
    return out.select(F.col("rows").alias("n_rows"), F.col("cut_size").cast("bigint").alias("cut_size"),
                      F.round("threshold", 6).alias("threshold"), "ties_at_cut", F.round(f"{target}_share", 6).alias("share"))


@query("T3_tie_averaged_capture", sql_top_share("test_rows", "p", "revenue"))
def tie_averaged_capture(t: Tables) -> DataFrame:
    return _share(test_rows(t), "p", "revenue")


@query("T2_top_fraction_share", sql_top_share("test_rows", "value", "y"))
def top_fraction_share(t: Tables) -> DataFrame:
    return _share(test_rows(t), "value", "y")


@query("T4_ties_at_cut", """
SELECT count(*) AS ties_at_cut FROM test_rows WHERE p = (SELECT p FROM (
  SELECT p, row_number() OVER (ORDER BY p DESC) AS rn, floor(count(*) OVER () * 0.2::DOUBLE) AS cut FROM test_rows) WHERE rn = cut)""")
def ties_at_cut(t: Tables) -> DataFrame:
    return metrics.top_share(test_rows(t), "p", ["y"]).select("ties_at_cut")


@query("T1_top_rows", """
SELECT lead_id, rank FROM (SELECT lead_id, row_number() OVER (ORDER BY p DESC, lead_id) AS rank, count(*) OVER () AS n FROM test_rows)
WHERE rank <= floor(n * 0.2::DOUBLE)""")
def top_rows(t: Tables) -> DataFrame:
    return ranking.top_rows(test_rows(t).select("lead_id", "p"), "p", "lead_id", 0.2).select("lead_id", "rank")


view("summary_parts", f"""
SELECT (SELECT auc FROM ({sql_auc('test_rows', 'p')})) AS auc, (SELECT avg((y - p) * (y - p)) FROM test_rows) AS brier,
  (SELECT share FROM ({sql_top_share('test_rows', 'p', 'y')})) AS top20_wins,
  (SELECT share FROM ({sql_top_share('test_rows', 'value', 'revenue')})) AS top20_revenue""")


@query("E3_model_summary", "SELECT 'formula' AS model, round(auc, 3) AS auc, round(brier, 4) AS brier, "
       "round(top20_wins, 3) AS top20_wins, round(top20_revenue, 3) AS top20_revenue FROM summary_parts")
def model_summary(t: Tables) -> DataFrame:
    return model_summary_of(test_rows(t).select("lead_id", "y", "p", "value", "revenue"), "formula")


def model_summary_of(rows: DataFrame, name: str) -> DataFrame:
    a = metrics.auc(rows).select(F.round("auc", 3).alias("auc"))
    b = rows.agg(F.round(metrics.brier(), 4).alias("brier"))
    w = metrics.top_share(rows, "p", ["y"]).select(F.round("y_share", 3).alias("top20_wins"))
    r = metrics.top_share(rows, "value", ["revenue"]).select(F.round("revenue_share", 3).alias("top20_revenue"))
    return a.select(F.lit(name).alias("model"), "auc", b.scalar().alias("brier"), w.scalar().alias("top20_wins"),
                    r.scalar().alias("top20_revenue"))


@query("E4_calibration_by_decile", """
SELECT decile, count(*) AS n, round(avg(p), 6) AS mean_p, round(avg(y), 6) AS observed FROM (
  SELECT y, p, greatest(1, ceil((rn - 1) * 10 / (n - 1)))::INT AS decile FROM (
    SELECT y, p, row_number() OVER (ORDER BY p, lead_id) AS rn, count(*) OVER () AS n FROM test_rows)) GROUP BY decile""")
def calibration_by_decile(t: Tables) -> DataFrame:
    return metrics.calibration_by_decile(test_rows(t)).withColumns(
        {"mean_p": F.round("mean_p", 6), "observed": F.round("observed", 6)})


@query("W2_score_deciles", """
SELECT o_orderkey, greatest(1, ceil((rn - 1) * 10 / (n - 1)))::INT AS decile FROM (
  SELECT o_orderkey, row_number() OVER (ORDER BY o_totalprice, o_orderkey) AS rn, count(*) OVER () AS n FROM orders)""")
def score_deciles(t: Tables) -> DataFrame:
    orders = t.table("orders").select("o_orderkey", "o_totalprice")
    return ranking.cut_parts(orders, "o_totalprice", "o_orderkey", ranking.ten_cuts).select("o_orderkey", (F.col("part") + 1).alias("decile"))


@query("E5_auc_by_month", sql_auc("(SELECT *, strftime(created_at, '%Y-%m') AS month FROM test_rows)", "p", ("month",)))
def auc_by_month(t: Tables) -> DataFrame:
    rows = test_rows(t).withColumn("month", F.date_format("created_at", "yyyy-MM"))
    return rounded_auc(metrics.auc(rows, groups=["month"]))


@query("A12_value_scale", """
SELECT count(*) AS n, round(quantile_cont(value, 0.01), 4) AS p1, round(quantile_cont(value, 0.5), 4) AS p50,
  round(quantile_cont(value, 0.9), 4) AS p90, round(quantile_cont(value, 0.99), 4) AS p99, round(max(value), 4) AS max,
  round(max(value) / quantile_cont(value, 0.5), 6) AS max_over_median,
  round(sum(value) FILTER (WHERE rn <= greatest(1, floor(n * 0.01::DOUBLE))) / sum(value), 6) AS top1pct_share
FROM (SELECT value, row_number() OVER (ORDER BY value DESC) AS rn, count(*) OVER () AS n FROM scored)""")
def value_scale(t: Tables) -> DataFrame:
    s = metrics.value_scale(scored(t), "value")
    return s.select("n", *[F.round(c, 4).alias(c) for c in ("p1", "p50", "p90", "p99", "max")],
                    *[F.round(c, 6).alias(c) for c in ("max_over_median", "top1pct_share")])


@query("A17_bottom_decile_ghosted", f"""
WITH s AS (SELECT s.*, y_legacy IS NOT NULL AS legacy, created_at >= {T_TEST_FROM} AS late, label_source = 'ghosted' AS ghosted, final_stage = 'New' AS still_new FROM scored s),
x AS (SELECT 'legacy' AS population, * FROM s WHERE legacy UNION ALL SELECT 'legacy test', * FROM s WHERE legacy AND late
  UNION ALL SELECT 'mature', * FROM s WHERE mature UNION ALL SELECT 'mature test', * FROM s WHERE mature AND late),
r AS (SELECT *, row_number() OVER (PARTITION BY population ORDER BY p, lead_id) <= floor(count(*) OVER (PARTITION BY population) * 0.1::DOUBLE) AS low FROM x)
SELECT population, count(*) AS n, count(*) FILTER (low) AS n_bottom, round(avg(coalesce(ghosted, false)::INT), 6) AS ghosted_overall,
  round(avg(coalesce(ghosted, false)::INT) FILTER (low), 6) AS ghosted_bottom, round(avg(coalesce(still_new, false)::INT), 6) AS still_new_overall,
  round(avg(coalesce(still_new, false)::INT) FILTER (low), 6) AS still_new_bottom FROM r GROUP BY population""")
def bottom_decile_ghosted(t: Tables) -> DataFrame:
    """Ghosted and still-new leads among all and among the lowest scores, on four populations."""
    legacy, mature = F.col("y_legacy").isNotNull(), labels.is_mature(ORDERS_DATES.horizon_days, ORDERS_DATES.as_of)
    late = F.col("created_at") >= labels.at(ORDERS_DATES.test_from)
    df = scored(t).withColumn("y_legacy", labels.legacy_label(ORDERS_DATES))
    members = {"legacy": legacy, "legacy test": legacy & late, "mature": mature, "mature test": mature & late}
    populations = F.array_compact(F.array(*[F.when(m, name) for name, m in members.items()]))
    long = df.select("lead_id", "p", F.coalesce(F.col("label_source") == "ghosted", F.lit(False)).alias("ghosted"),
                     F.coalesce(F.col("final_stage") == "New", F.lit(False)).alias("still_new"), F.explode(populations).alias("population"))
    out = metrics.bottom_share(long, ["ghosted", "still_new"], "p", "lead_id", 0.1, "population")
    return out.select("population", "n", "n_bottom", *[F.round(c, 6).alias(c) for c in out.columns[3:]])


# ---- bootstrap ----
RESAMPLES = 1000
SQL_CUTS = " + ".join(f"(h >= {c})::INT" for c in bootstrap.POISSON_CUTS)


def sql_hash(id_: str, seed: str) -> str:
    a = f"((({id_}) % {P}) * 48271 + (({seed}) % {P}) * 69621 + 12345) % {P}"
    return f"(SELECT (b * b + 16807 * b + 11) % {P} FROM (SELECT (a * a + 40014 * a + 7) % {P} AS b FROM (SELECT ({a})::BIGINT AS a)))"


def weight_views(name: str, bins: str) -> None:
    """Views of the Poisson(c) quantile of every (bin, resample) hash; ``bins`` has the columns rep and c."""
    view(f"{name}_bins", bins)
    view(f"{name}_cuts", f"""
SELECT c, min(k) AS low, list(floor(cdf * {P})::BIGINT ORDER BY k) AS cuts FROM (
  SELECT c, k, sum(exp(k * ln(c) - c - lgamma(k + 1))) OVER (PARTITION BY c ORDER BY k) AS cdf FROM (
    SELECT c, unnest(range(greatest(0, floor(c - 10 * sqrt(c) - 20))::BIGINT, ceil(c + 10 * sqrt(c) + 20)::BIGINT + 1)) AS k
    FROM (SELECT DISTINCT c FROM {name}_bins))) GROUP BY c""")
    view(f"{name}_weights", f"""
SELECT * EXCLUDE (a, b, h, low, cuts), low + len(list_filter(cuts, lambda x: x <= h)) AS w FROM (
  SELECT *, (b * b + 16807 * b + 11) % {P} AS h FROM (
    SELECT *, (a * a + 40014 * a + 7) % {P} AS b FROM (
      SELECT *, ((rep % {P}) * 48271 + ((resample * {bootstrap.DRAWS_PER_RESAMPLE}) % {P}) * 69621 + 12345) % {P} AS a
      FROM {name}_bins CROSS JOIN (SELECT unnest(range({RESAMPLES})) AS resample)))) JOIN {name}_cuts USING (c)""")


view("boot_rows", "SELECT lead_id, y, round(p, 2) AS s1, floor(value / 50) AS s2 FROM test_rows")
weight_views("boot_one", "SELECT y, s1, min(lead_id) AS rep, count(*) AS c FROM boot_rows GROUP BY y, s1")
weight_views("boot", "SELECT y, s1, s2, min(lead_id) AS rep, count(*) AS c FROM boot_rows GROUP BY y, s1, s2")


def sql_weighted_auc(score: str, weights: str = "boot_weights") -> str:
    return f"""SELECT resample, sum(pos * (below + neg / 2)) / (sum(pos) * sum(neg)) AS auc FROM (
      SELECT resample, pos, neg, coalesce(sum(neg) OVER (PARTITION BY resample ORDER BY s ROWS BETWEEN UNBOUNDED PRECEDING
        AND 1 PRECEDING), 0) AS below FROM (SELECT resample, {score} AS s, sum(w * y)::DOUBLE AS pos, sum(w * (1 - y))::DOUBLE AS neg
        FROM {weights} GROUP BY resample, s)) GROUP BY resample"""


view("boot_one_auc", sql_weighted_auc("s1", "boot_one_weights"))
view("boot_auc", f"SELECT a.resample, a.auc AS auc1, b.auc AS auc2 FROM ({sql_weighted_auc('s1')}) a JOIN ({sql_weighted_auc('s2')}) b USING (resample)")


def boot_rows(t: Tables) -> DataFrame:
    """Test rows with two coarse scores, so that many rows tie."""
    return test_rows(t).select("lead_id", "y", F.round("p", 2).alias("s1"), F.floor(F.col("value") / 50).cast("double").alias("s2"))


@query("E6_bootstrap_auc_interval", """
SELECT round(quantile_cont(auc, 0.025), 6) AS lo, round(quantile_cont(auc, 0.975), 6) AS hi, count(*) AS resamples FROM boot_one_auc""")
def bootstrap_auc_interval(t: Tables) -> DataFrame:
    samples = bootstrap.resampled_auc(boot_rows(t), ["s1"], resamples=RESAMPLES)
    tail = samples.groupBy("model").agg(F.count("*").alias("resamples"), F.percentile("auc", 0.025).alias("lo"),
                                        F.percentile("auc", 0.975).alias("hi"))
    return tail.select(F.round("lo", 6).alias("lo"), F.round("hi", 6).alias("hi"), "resamples")


@query("E6_bootstrap_samples", "SELECT 's1' AS model, resample, round(auc, 6) AS auc FROM boot_one_auc")
def bootstrap_samples(t: Tables) -> DataFrame:
    return bootstrap.resampled_auc(boot_rows(t), ["s1"], resamples=RESAMPLES).withColumn("auc", F.round("auc", 6))


@query("E7_paired_auc_difference", """
SELECT round(quantile_cont(auc2 - auc1, 0.025), 6) AS lo, round(quantile_cont(auc2 - auc1, 0.975), 6) AS hi,
  round(least(1.0::DOUBLE, 2 * least(avg((auc2 - auc1 <= 0)::INT), avg((auc2 - auc1 >= 0)::INT))), 6) AS p_value FROM boot_auc""")
def paired_auc_difference(t: Tables) -> DataFrame:
    samples = bootstrap.resampled_auc(boot_rows(t), ["s1", "s2"], resamples=RESAMPLES)
    out = bootstrap.paired_summary(bootstrap.paired_differences(samples, "s1", "s2"))
    return out.select(*[F.round(c, 6).alias(c) for c in ("lo", "hi", "p_value")])


# the same on the scores themselves, to the digits in which both engines agree
view("exact_rows", "SELECT lead_id, y, round(p, 9) AS s1, round(value, 6) AS s2 FROM test_rows")
weight_views("exact_one", "SELECT y, s1, min(lead_id) AS rep, count(*) AS c FROM exact_rows GROUP BY y, s1")
weight_views("exact", "SELECT y, s1, s2, min(lead_id) AS rep, count(*) AS c FROM exact_rows GROUP BY y, s1, s2")
view("exact_one_auc", sql_weighted_auc("s1", "exact_one_weights"))
view("exact_auc", f"SELECT a.resample, a.auc AS auc1, b.auc AS auc2 FROM ({sql_weighted_auc('s1', 'exact_weights')}) a JOIN ({sql_weighted_auc('s2', 'exact_weights')}) b USING (resample)")


def exact_rows(t: Tables) -> DataFrame:
    return test_rows(t).select("lead_id", "y", F.round("p", 9).alias("s1"), F.round("value", 6).alias("s2"))


@query("E6_exact_auc_interval", """
SELECT round(quantile_cont(auc, 0.025), 6) AS lo, round(quantile_cont(auc, 0.975), 6) AS hi, count(*) AS resamples FROM exact_one_auc""")
def exact_auc_interval(t: Tables) -> DataFrame:
    samples = bootstrap.resampled_auc(exact_rows(t), ["s1"], resamples=RESAMPLES)
    return samples.agg(F.round(F.percentile("auc", 0.025), 6).alias("lo"), F.round(F.percentile("auc", 0.975), 6).alias("hi"), F.count("*").alias("resamples"))


@query("E6_exact_samples", "SELECT 's1' AS model, resample, round(auc, 6) AS auc FROM exact_one_auc")
def exact_samples(t: Tables) -> DataFrame:
    return bootstrap.resampled_auc(exact_rows(t), ["s1"], resamples=RESAMPLES).withColumn("auc", F.round("auc", 6))


@query("E7_exact_auc_difference", """
SELECT round(quantile_cont(auc2 - auc1, 0.025), 6) AS lo, round(quantile_cont(auc2 - auc1, 0.975), 6) AS hi,
  round(least(1.0::DOUBLE, 2 * least(avg((auc2 - auc1 <= 0)::INT), avg((auc2 - auc1 >= 0)::INT))), 6) AS p_value FROM exact_auc""")
def exact_auc_difference(t: Tables) -> DataFrame:
    samples = bootstrap.resampled_auc(exact_rows(t), ["s1", "s2"], resamples=RESAMPLES)
    out = bootstrap.paired_summary(bootstrap.paired_differences(samples, "s1", "s2"))
    return out.select(*[F.round(c, 6).alias(c) for c in ("lo", "hi", "p_value")])


_THREE_LONG = """(SELECT lead_id, y, revenue, 'formula' AS model, p AS s FROM test_rows UNION ALL
  SELECT lead_id, y, revenue, 'value', value FROM test_rows UNION ALL SELECT lead_id, y, revenue, 'benchmark', sq_value FROM bench_rows)"""
view("benchmark_rows", """
SELECT lead_id, y, is_test, pts AS sq_points, CASE WHEN pts >= 55 THEN 'A' WHEN pts >= 30 THEN 'B' ELSE 'C' END AS sq_tier,
  base * (CASE WHEN a_country IN ('UK','US') THEN 1.2::DOUBLE ELSE 1 END) * (CASE WHEN f_channel = 'linkedin' THEN 1.3::DOUBLE ELSE 1 END)
    * (CASE WHEN pts >= 55 THEN 2.0::DOUBLE WHEN pts >= 30 THEN 1.0 ELSE 0.4 END) AS sq_value
FROM (SELECT *, (CASE form_variant WHEN 'A' THEN 150 WHEN 'B' THEN 300 WHEN 'C' THEN 600 ELSE 200 END)::DOUBLE AS base,
  (CASE WHEN coalesce(trim(a_job_title), '') = '' THEN 0 WHEN contains(lower(a_job_title), 'student') THEN 0
    WHEN regexp_matches(lower(a_job_title), 'ceo|founder|chief|vp|director') THEN 30
    WHEN contains(lower(a_job_title), 'head') THEN 25 WHEN contains(lower(a_job_title), 'manager') THEN 15 ELSE 10 END
   + CASE a_company_size WHEN '1-10' THEN 5 WHEN '11-50' THEN 10 WHEN '51-200' THEN 20 WHEN '201-1000' THEN 25 WHEN '1000+' THEN 30 ELSE 0 END
   + CASE WHEN pages_visited >= 5 THEN 20 WHEN pages_visited >= 3 THEN 10 WHEN pages_visited >= 1 THEN 5 ELSE 0 END)::DOUBLE AS pts
  FROM scored)""")
view("bench_rows", "SELECT t.lead_id, t.y, t.revenue, b.sq_value FROM test_rows t JOIN benchmark_rows b USING (lead_id)")


def compared_models(t: Tables) -> DataFrame:
    """Long (lead, model, score) rows of the test set: the formula, its value and the rule-based benchmark."""
    df = scored(t).withColumns(value.benchmark_value()).where("is_test")
    each = F.array(F.struct(F.lit("formula").alias("model"), F.col("p").alias("s")),
                   F.struct(F.lit("value").alias("model"), F.col("value").alias("s")),
                   F.struct(F.lit("benchmark").alias("model"), F.col("sq_value").alias("s")))
    return df.select("lead_id", "y", "revenue", F.explode(each).alias("m")).select("lead_id", "y", "revenue", "m.*")


@query("E9_headline_by_model", sql_auc(_THREE_LONG, "s", ("model",)))
def headline_by_model(t: Tables) -> DataFrame:
    return rounded_auc(metrics.auc(compared_models(t), score="s", groups=["model"]))


@query("E9_capture_by_model", f"""
SELECT model, n_rows, cut_size, ties_at_cut, share AS revenue_share FROM (
  SELECT 'formula' AS model, * FROM ({sql_top_share('test_rows', 'p', 'revenue')}) UNION ALL
  SELECT 'value', * FROM ({sql_top_share('test_rows', 'value', 'revenue')}) UNION ALL
  SELECT 'benchmark', * FROM ({sql_top_share('bench_rows', 'sq_value', 'revenue')}))""")
def capture_by_model(t: Tables) -> DataFrame:
    out = metrics.top_share(compared_models(t), "s", ["revenue"], ["model"])
    return out.select("model", F.col("rows").alias("n_rows"), F.col("cut_size").cast("bigint").alias("cut_size"),
                      "ties_at_cut", F.round("revenue_share", 6).alias("revenue_share"))


@query("J16_metrics_side_by_side", """
SELECT month, n, wins, auc AS formula, auc_b AS benchmark FROM ({a}) JOIN (SELECT month, auc AS auc_b FROM ({b})) USING (month)""".format(
    a=sql_auc("(SELECT *, strftime(created_at, '%Y-%m') AS month FROM test_rows)", "p", ("month",)),
    b=sql_auc("(SELECT b.*, strftime(created_at, '%Y-%m') AS month FROM bench_rows b JOIN test_rows USING (lead_id))", "sq_value", ("month",))))
def metrics_side_by_side(t: Tables) -> DataFrame:
    df = scored(t).withColumns(value.benchmark_value()).where("is_test").withColumn("month", F.date_format("created_at", "yyyy-MM"))
    each = F.array(F.struct(F.lit("formula").alias("model"), F.col("p").alias("s")),
                   F.struct(F.lit("benchmark").alias("model"), F.col("sq_value").alias("s")))
    long = df.select("y", "month", F.explode(each).alias("m")).select("y", "month", "m.*")
    table = rounded_auc(metrics.auc(long, score="s", groups=["month", "model"]))
    return table.groupBy("month", "n", "wins").pivot("model", ["formula", "benchmark"]).agg(F.first("auc"))


# ---- value layer ----
@query("V1_expected_value", "SELECT lead_id, round(value, 6) AS value FROM scored")
def expected_value(t: Tables) -> DataFrame:
    return scored(t).select("lead_id", F.round("value", 6).alias("value"))


view("fit_numbers", """
SELECT cap, anchor, sum(least(value, cap)) / sum(anchor * log2(1 + least(value, cap) / anchor)) AS log_scale,
  sum(least(value, cap)) / sum(sqrt(least(value, cap) * anchor)) AS sqrt_scale
FROM scored, (SELECT quantile_cont(value, 0.97) AS cap, quantile_cont(value, 0.5) AS anchor FROM scored WHERE is_train)
WHERE is_train GROUP BY cap, anchor""")


@query("V2_transform_parameters", "SELECT round(cap, 6) AS cap, round(anchor, 6) AS anchor, round(log_scale, 8) AS scale FROM fit_numbers")
def transform_parameters(t: Tables) -> DataFrame:
    f = value.fit_transform(scored(t).where("is_train"), "value", value.ValueTransform())
    return t.spark.createDataFrame([(round(f.cap, 6), round(f.anchor, 6), round(f.scale, 8))], "cap double, anchor double, scale double")


@query("V3_upload_values", """
SELECT lead_id, round(greatest(25, anchor * log2(1 + least(value, cap) / anchor) * log_scale), 4) AS upload_log,
  round(sqrt(least(value, cap) * anchor) * sqrt_scale, 4) AS upload_sqrt FROM scored, fit_numbers""")
def upload_values(t: Tables) -> DataFrame:
    df = scored(t).select("lead_id", "value", "is_train")
    train = df.where("is_train")
    log, root = value.fit_transforms(train, "value", [value.ValueTransform(), value.ValueTransform(floor=None, compression="sqrt")])
    return df.select("lead_id", F.round(log.apply(F.col("value")), 4).alias("upload_log"),
                     F.round(root.apply(F.col("value")), 4).alias("upload_sqrt"))


view("edges5", """SELECT quantile_cont(value, 0.2) AS e1, quantile_cont(value, 0.4) AS e2, quantile_cont(value, 0.6) AS e3,
  quantile_cont(value, 0.8) AS e4 FROM scored WHERE is_train""")


@query("V3_value_tiers", """
SELECT lead_id, tier, round(m, 4) AS tier_value FROM (SELECT lead_id, (value >= e1)::INT + (value >= e2)::INT + (value >= e3)::INT + (value >= e4)::INT AS tier
  FROM scored, edges5) JOIN (SELECT (value >= e1)::INT + (value >= e2)::INT + (value >= e3)::INT + (value >= e4)::INT AS tier, avg(value) AS m
  FROM scored, edges5 WHERE is_train GROUP BY 1) USING (tier)""")
def value_tiers(t: Tables) -> DataFrame:
    df = scored(t).select("lead_id", "value", "is_train")
    f = value.fit_transform(df.where("is_train"), "value", value.ValueTransform(None, None, "none", 5))
    return df.select("lead_id", value.tier_of(F.col("value"), f.edges).alias("tier"),
                     F.round(f.apply(F.col("value")), 4).alias("tier_value"))


def _sql_tiers(n: int) -> str:
    """Test rows at the mean training value of their tier."""
    tier = "len(list_filter(e, lambda x: value >= x))"
    edges = f"(SELECT quantile_cont(value, {[i / n for i in range(1, n)]}) AS e FROM scored WHERE is_train)"
    return f"""SELECT revenue, 'tiers {n}', m FROM (SELECT revenue, {tier} AS tier FROM test_rows, {edges})
  JOIN (SELECT {tier} AS tier, avg(value) AS m FROM scored, {edges} WHERE is_train GROUP BY 1) USING (tier)"""


view("upload_test", f"""
SELECT revenue, 'identity' AS transform, value AS v FROM test_rows
UNION ALL SELECT revenue, 'cap p97', least(value, cap) FROM test_rows, fit_numbers
UNION ALL SELECT revenue, 'cap p97 + floor £25', greatest(25, least(value, cap)) FROM test_rows, fit_numbers
UNION ALL SELECT revenue, 'cap p97 + sqrt', sqrt(least(value, cap) * anchor) * sqrt_scale FROM test_rows, fit_numbers
UNION ALL SELECT revenue, 'cap p97 + log', anchor * log2(1 + least(value, cap) / anchor) * log_scale FROM test_rows, fit_numbers
UNION ALL SELECT revenue, 'cap p97 + log + floor £25', greatest(25, anchor * log2(1 + least(value, cap) / anchor) * log_scale) FROM test_rows, fit_numbers
UNION ALL {_sql_tiers(5)} UNION ALL {_sql_tiers(10)}""")


@query("V4_transform_comparison", """
SELECT transform, n, round(p50, 4) AS p50, round(mx, 4) AS max, round(mx / p50, 6) AS max_over_median, ties AS ties_at_cut,
  round(capture, 6) AS capture, round(capture / max(CASE WHEN transform = 'identity' THEN capture END) OVER (), 6) AS retention,
  round(total / rev, 6) AS value_over_revenue,
  capture / max(CASE WHEN transform = 'identity' THEN capture END) OVER () >= 0.95 AND mx / p50 < 20 AS accepted
FROM (SELECT transform, count(*) AS n, quantile_cont(v, 0.5) AS p50, max(v) AS mx, sum(v) AS total, sum(revenue) AS rev,
  count(*) FILTER (WHERE v = thr) AS ties,
  (coalesce(sum(revenue) FILTER (WHERE v > thr), 0) + (any_value(cut) - count(*) FILTER (WHERE v > thr))::DOUBLE
    / count(*) FILTER (WHERE v = thr) * sum(revenue) FILTER (WHERE v = thr)) / sum(revenue) AS capture
  FROM (SELECT *, max(CASE WHEN rn = cut THEN v END) OVER (PARTITION BY transform) AS thr FROM (
    SELECT *, row_number() OVER (PARTITION BY transform ORDER BY v DESC) AS rn,
      floor(count(*) OVER (PARTITION BY transform) * 0.2::DOUBLE) AS cut FROM upload_test)) GROUP BY transform)""")
def transform_comparison(t: Tables) -> DataFrame:
    df = scored(t).select("lead_id", "value", "is_train", "is_test", "revenue").persist()
    out = compare_transforms(df.where("is_train"), df.where("is_test"), value.REPORT_TRANSFORMS)
    return out.select("transform", "n", *[F.round(c, 4).alias(c) for c in ("p50", "max")],
                      F.round("max_over_median", 6).alias("max_over_median"), "ties_at_cut",
                      *[F.round(c, 6).alias(c) for c in ("capture", "retention", "value_over_revenue")], "accepted")


def compare_transforms(train: DataFrame, test: DataFrame, specs) -> DataFrame:
    """Scale, capture, ties and retention of every transform fitted on the training rows, in one pass of the test rows."""
    fitted = value.fit_transforms(train, "value", specs)
    cells = F.array(*[F.struct(F.lit(f.spec.name).alias("transform"), f.apply(F.col("value")).alias("v")) for f in fitted])
    long = test.select("revenue", F.explode(cells).alias("c")).select("revenue", "c.*")
    scale = metrics.value_scale(long, "v", ["transform"])
    share = metrics.top_share(long, "v", ["revenue"], ["transform"])
    joined = scale.join(share.select("transform", "ties_at_cut", F.col("revenue_share").alias("capture")), "transform")
    revenue, base = test.agg(F.sum("revenue")).scalar(), joined.where("transform = 'identity'").select("capture").scalar()
    return joined.withColumns({"retention": F.col("capture") / base, "value_over_revenue": F.col("total") / revenue}).withColumn(
        "accepted", (F.col("retention") >= 0.95) & (F.col("max_over_median") < 20))


@query("V4_tier_transforms", """
SELECT tier + 1 AS tier, count(*) AS n, round(avg(value), 4) AS mean_value FROM (
  SELECT value, (value >= e1)::INT + (value >= e2)::INT + (value >= e3)::INT + (value >= e4)::INT AS tier FROM scored, edges5 WHERE is_test) GROUP BY tier""")
def tier_transforms(t: Tables) -> DataFrame:
    df = scored(t).select("value", "is_train", "is_test")
    f = value.fit_transform(df.where("is_train"), "value", value.ValueTransform(None, None, "none", 5))
    tier = (value.tier_of(F.col("value"), f.edges) + 1).alias("tier")
    return df.where("is_test").groupBy(tier).agg(F.count("*").alias("n"), F.round(F.avg("value"), 4).alias("mean_value"))


_CLOSE = f"""CASE WHEN coalesce(won_at <= {T_AS_OF}, false) THEN deal_value WHEN mature THEN 0 END AS value_at_close,
  strftime(CASE WHEN coalesce(won_at <= {T_AS_OF}, false) THEN won_at WHEN mature THEN matured_at END, {FMT}) AS value_at_close_ts,
  CASE WHEN coalesce(won_at <= {T_AS_OF}, false) AND deal_value IS NULL THEN 'unknown_amount'
    WHEN coalesce(won_at <= {T_AS_OF}, false) OR mature THEN 'known' ELSE 'pending' END AS value_at_close_status"""


@query("L8_close_stage_value", f"SELECT lead_id, {_CLOSE} FROM labelled")
def close_stage_value(t: Tables) -> DataFrame:
    out = cleaned(t).withColumns(value.close_stage(ORDERS_DATES.horizon_days, ORDERS_DATES.as_of))
    return out.select("lead_id", "value_at_close", ts("value_at_close_ts"), "value_at_close_status")


@query("V5_two_stage_upload", f"""
SELECT lead_id, round(greatest(25, anchor * log2(1 + least(value, cap) / anchor) * log_scale), 4) AS value_at_submit,
  {_CLOSE} FROM scored JOIN (SELECT lead_id, matured_at FROM labelled) USING (lead_id), fit_numbers""")
def two_stage_upload(t: Tables) -> DataFrame:
    df = scored(t)
    f = value.fit_transform(df.where("is_train"), "value", value.ValueTransform())
    out = df.withColumns({"value_at_submit": F.round(f.apply(F.col("value")), 4),
                          **value.close_stage(ORDERS_DATES.horizon_days, ORDERS_DATES.as_of)})
    return out.select("lead_id", "value_at_submit", "value_at_close", ts("value_at_close_ts"), "value_at_close_status")


@query("V6_benchmark_value", "SELECT lead_id, sq_points, sq_tier, round(sq_value, 6) AS sq_value FROM benchmark_rows")
def benchmark_value(t: Tables) -> DataFrame:
    return enriched(t).withColumns(value.benchmark_value(BENCHMARK_RULES)).select(
        "lead_id", "sq_points", "sq_tier", F.round("sq_value", 6).alias("sq_value"))


@query("J9_threshold_lookup", """
SELECT o_orderkey, CASE WHEN o_totalprice >= 400000 THEN 'A' WHEN o_totalprice >= 200000 THEN 'B' WHEN o_totalprice >= 50000 THEN 'C' END AS tier FROM orders""")
def threshold_lookup(t: Tables) -> DataFrame:
    tier = value.first_reached(F.col("o_totalprice"), [(400000, "A"), (200000, "B"), (50000, "C")])
    return t.table("orders").select("o_orderkey", tier.alias("tier"))


# ---- frozen-weight scoring ----
@query("M2_win_probability", "SELECT lead_id, round(p, 8) AS p FROM scored")
def win_probability(t: Tables) -> DataFrame:
    return v2(t).select("lead_id", F.round(scores.sigmoid(scores.linear_score(WEIGHTS)), 8).alias("p"))


@query("J10_score_explanation", """
WITH w AS (SELECT unnest([{names}]) AS "column", unnest([{vals}]::DOUBLE[]) AS log_odds), act AS ({act})
SELECT lead_id, "column", coalesce(log_odds, 0) AS log_odds, round(coalesce(log_odds, 0) * 20 / ln(2), 6) AS points
FROM act LEFT JOIN w USING ("column")
UNION ALL SELECT lead_id, '(intercept)', {base}::DOUBLE, round({base}::DOUBLE * 20 / ln(2), 6) FROM features_v2""".format(
    names=", ".join(f"'{c}'" for c in WEIGHTS), vals=", ".join(str(v) for v in WEIGHTS.values()), base=WEIGHTS["(intercept)"],
    act=" UNION ALL ".join(f"SELECT lead_id, '{f}=' || f_{f} AS \"column\" FROM features_v2 WHERE f_{f} <> '{r}'"
                           for f, r in design.V2_REFERENCES.items())))
def score_explanation(t: Tables) -> DataFrame:
    df = v2(t)
    out = models.explain_scores(design.long_design(df), WEIGHTS, df)
    return out.select("lead_id", "column", "log_odds", F.round("points", 6).alias("points"))


_W_ROWS = ", ".join(f"('{c}', {float(w)}::DOUBLE)" for c, w in WEIGHTS.items())
_USED = " UNION ALL ".join(f"SELECT '{c}' AS \"column\", count(*) FILTER (WHERE f_{c.split('=', 1)[0]} = '{c.split('=', 1)[1]}') AS leads FROM features_v2"
                           for c in WEIGHTS if "=" in c)


@query("F21_points_table", f"""
WITH w("column", log_odds) AS (VALUES {_W_ROWS}), used AS ({_USED})
SELECT "column", log_odds, round(exp(log_odds), 6) AS odds_multiplier, round(log_odds * 20 / ln(2), 6) AS points, leads FROM w JOIN used USING ("column")""")
def points_table(t: Tables) -> DataFrame:
    weights = models.weights_frame(t.spark, WEIGHTS)
    used = design.design_counts(v2(t)).select("column", F.col("leads_with_1").alias("leads"))
    return weights.join(used, "column").select("column", "log_odds", F.round("odds_multiplier", 6).alias("odds_multiplier"),
                                               F.round("points", 6).alias("points"), "leads")


@query("T6_scorecard", f"""
WITH w("column", log_odds) AS (VALUES {_W_ROWS}), used AS ({_USED})
SELECT "column", round(log_odds, 3) AS log_odds, round(exp(log_odds), 2) AS odds_multiplier, round(log_odds * 20 / ln(2), 0) AS points, leads
FROM w JOIN used USING ("column") ORDER BY log_odds, "column" """)
def scorecard(t: Tables) -> DataFrame:
    used = design.design_counts(v2(t)).select("column", F.col("leads_with_1").alias("leads"))
    return models.scorecard(models.weights_frame(t.spark, WEIGHTS)).join(used, "column").orderBy("log_odds", "column")
