"""Queries: extras, splits, fits, screens and evaluation studies."""
from __future__ import annotations

import numpy as np
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from leadvane.catalog.base import query, view
from leadvane.catalog.features import scored, test_rows
from leadvane.catalog.metrics import RESAMPLES, SQL_CUTS, boot_rows, exact_rows, rounded_auc, sql_auc, sql_hash
from leadvane.catalog.outcomes import LEGACY, ORDERS_DATES, STUDY_SPECS
from leadvane.catalog.summaries import extras_table
from leadvane.catalog.views import T_AS_OF, T_TEST_FROM, WEIGHTS
from leadvane.config import (CALIBRATION_CLIP, CONTEXT_LEVELS, CONTEXT_REFERENCES, FEATURES, JUDGMENTS, LEVELS, PERSONA_GROUPS, V2_REFERENCES, VALUE_LEVELS,
                             design_columns)
from leadvane.functions.scores import logit
from leadvane.operators import (bootstrap, design, extras, features, fits, judgments, labels, metrics, models, ranking, screens,
                                splits)
from leadvane.session import written
from leadvane.sources.bindings import Tables

COLUMNS = design_columns(V2_REFERENCES)
VALUE_COLUMNS = design_columns(dict.fromkeys(VALUE_LEVELS), VALUE_LEVELS)
DECLARED = (extras.Extra("segment", "categorical"), extras.Extra("priority", "categorical"), extras.Extra("balance", "numeric"),
            extras.Extra("price_step", "numeric"), extras.Extra("status_text", "categorical"))


def training_design(t: Tables, keep=("lead_id", "y")) -> DataFrame:
    return design.wide_design(scored(t).where("is_train"), keep=keep)


def design_rows(df: DataFrame, keep: list[str]) -> DataFrame:
    return design.wide_design(df, keep=keep).select(*keep, fits.design_array(COLUMNS))


def with_extras(t: Tables) -> DataFrame:
    """Leads with their extras, written once: an encoder reads them several times for each extra."""
    return written(scored(t).select("lead_id", "y", "is_train", "label_source", "p").join(extras_table(t), "lead_id"))


# ---- extras ----
view("extra_rows", """
SELECT s.lead_id, s.y, s.is_train, s.label_source, c_mktsegment AS segment, o_orderpriority AS priority, c_acctbal AS balance,
  CASE WHEN o_orderkey % 9 <> 0 THEN floor(o_totalprice / 100000)::DOUBLE END AS price_step,
  CASE WHEN o_orderstatus = 'F' THEN 'closed' END AS status_text
FROM scored s JOIN orders ON o_orderkey = lead_id JOIN customer ON c_custkey = o_custkey""")


def _sql_levels(col: str) -> str:
    return f"""SELECT '{col}' AS extra, coalesce(nullif(trim({col}), ''), 'missing') AS level, count(*) AS train_n FROM extra_rows WHERE is_train GROUP BY 2"""


@query("G6_categorical_levels", f"""
SELECT extra, CASE WHEN level = 'missing' THEN level WHEN train_n >= 30 THEN level ELSE 'other' END AS level, sum(train_n)::BIGINT AS train_n
FROM ({_sql_levels('segment')} UNION ALL {_sql_levels('priority')} UNION ALL {_sql_levels('status_text')}) GROUP BY 1, 2""")
def categorical_levels(t: Tables) -> DataFrame:
    rows = with_extras(t)
    encoder = extras.fit_encoder([e for e in DECLARED if e.kind == "categorical"], rows.where("is_train"))
    return extras.level_frame(t.spark, encoder).where("train_n > 0").select("extra", "level", "train_n")


@query("G7_numeric_edges", """
SELECT extra, edge FROM (SELECT 'balance' AS extra, unnest(list_distinct([quantile_disc(balance, 0.2), quantile_disc(balance, 0.4), quantile_disc(balance, 0.6), quantile_disc(balance, 0.8)])) AS edge
  FROM extra_rows WHERE is_train UNION ALL
  SELECT 'price_step', unnest(list_distinct([quantile_disc(price_step, 0.2), quantile_disc(price_step, 0.4), quantile_disc(price_step, 0.6), quantile_disc(price_step, 0.8)]))
  FROM extra_rows WHERE is_train)""")
def numeric_edges(t: Tables) -> DataFrame:
    train = with_extras(t).where("is_train")
    rows = [(e.name, x) for e in DECLARED if e.kind == "numeric" for x in extras.numeric_edges(train, e.column)]
    return t.spark.createDataFrame(rows, "extra string, edge double")


@query("G8_encoded_extras", """
WITH e AS (SELECT quantile_disc(balance, 0.2) AS e1, quantile_disc(balance, 0.4) AS e2, quantile_disc(balance, 0.6) AS e3, quantile_disc(balance, 0.8) AS e4
  FROM extra_rows WHERE is_train)
SELECT lead_id, segment AS x_segment, coalesce(status_text, 'missing') AS x_status_text,
  (balance > e1)::INT + (balance > e2)::INT + (balance > e3)::INT + (balance > e4)::INT AS balance_bin FROM extra_rows, e""")
def encoded_extras(t: Tables) -> DataFrame:
    rows = with_extras(t)
    encoder = extras.fit_encoder([DECLARED[0], DECLARED[2], DECLARED[4]], rows.where("is_train"))
    bins = F.array(*[F.lit(x) for x in extras.bin_labels(encoder[1].edges)])
    return extras.encode(rows, encoder).select("lead_id", "x_segment", "x_status_text",
                                               (F.array_position(bins, F.col("x_balance")) - 1).cast("int").alias("balance_bin"))


@query("F23_bin_labels")
def bin_labels(t: Tables) -> DataFrame:
    encoder = extras.fit_encoder([e for e in DECLARED if e.kind == "numeric"], with_extras(t).where("is_train"))
    return extras.level_frame(t.spark, encoder).select("extra", "level", "position", "is_reference", "train_n")


@query("M16_levels_unseen_in_training", """
SELECT extra, level FROM (SELECT 'segment' AS extra, count(*) FILTER (WHERE segment IS NULL) AS n FROM extra_rows WHERE is_train
  UNION ALL SELECT 'balance', count(*) FILTER (WHERE balance IS NULL) FROM extra_rows WHERE is_train
  UNION ALL SELECT 'status_text', count(*) FILTER (WHERE status_text IS NULL) FROM extra_rows WHERE is_train), (SELECT 'missing' AS level) WHERE n = 0""")
def levels_unseen_in_training(t: Tables) -> DataFrame:
    encoder = extras.fit_encoder([DECLARED[0], DECLARED[2], DECLARED[4]], with_extras(t).where("is_train"))
    return extras.level_frame(t.spark, encoder).where("level = 'missing' and train_n = 0").select("extra", "level")


@query("M16_values_in_other", """
SELECT brand AS value, n FROM (SELECT p_brand AS brand, count(*) AS n FROM part GROUP BY 1) WHERE brand NOT IN (
  SELECT p_brand FROM part WHERE p_partkey % 3 = 0 GROUP BY 1 HAVING count(*) >= 30)""")
def values_in_other(t: Tables) -> DataFrame:
    part = t.table("part").select("p_partkey", F.col("p_brand").alias("x_brand"))
    encoder = extras.fit_encoder([extras.Extra("brand", "categorical")], part.where("p_partkey % 3 = 0"))
    raw = part.withColumn("value", F.col("x_brand"))
    return extras.encode(raw, encoder).where("x_brand = 'other'").groupBy("value").agg(F.count("*").alias("n"))


# ---- judgments ----
_J = {"is_real_business": "k % 3", "persona": "k % 8", "problem_specificity": "k % 4", "urgency": "(k // 2) % 4", "brief_fit": "(k // 3) % 4"}


def _sql_judgments() -> str:
    cols = ", ".join(f"([{', '.join(repr(v) for v in JUDGMENTS[j])}])[({e.replace('//', '//')} + 1)::INT] AS {j}" for j, e in _J.items())
    return f"""SELECT k AS lead_id, {cols}, CASE WHEN k % 10 = 0 THEN 'parse_error' ELSE 'ok' END AS status FROM (SELECT o_orderkey AS k FROM orders WHERE o_orderkey % 4 <> 0)"""


view("judgments", _sql_judgments())


def judgment_table(t: Tables) -> DataFrame:
    k = F.col("o_orderkey")
    pos = {"is_real_business": k % 3, "persona": k % 8, "problem_specificity": k % 4, "urgency": F.floor(k / 2) % 4, "brief_fit": F.floor(k / 3) % 4}
    cols = {j: F.element_at(F.array(*[F.lit(v) for v in JUDGMENTS[j]]), (p + 1).cast("int")) for j, p in pos.items()}
    return t.table("orders").where("o_orderkey % 4 <> 0").select(
        k.alias("lead_id"), *[c.alias(j) for j, c in cols.items()], F.lit("because").alias("reason"),
        F.when(k % 10 == 0, "parse_error").otherwise("ok").alias("status"), F.lit(None).cast("string").alias("error"),
        F.sha2(k.cast("string"), 256).alias("card_hash"), F.lit("b1").alias("brief_hash"), F.lit("v1").alias("prompt_version"), F.lit("m").alias("model_id"))


def _sql_group() -> str:
    return "CASE " + " ".join(f"WHEN persona = '{p}' THEN '{g}'" for p, g in PERSONA_GROUPS.items()) + " END"


_CTX = {"ctx_is_real_business": "is_real_business", "ctx_persona_group": _sql_group(), "ctx_problem_specificity": "problem_specificity",
        "ctx_urgency": "urgency", "ctx_brief_fit": "brief_fit"}


@query("J6_judgments_joined", "SELECT l.lead_id, " + ", ".join(f"j.{j}" for j in JUDGMENTS) + """
FROM leads l LEFT JOIN (SELECT * FROM judgments WHERE status = 'ok') j USING (lead_id)""")
def judgments_joined(t: Tables) -> DataFrame:
    ok = judgment_table(t).where("status = 'ok'").select("lead_id", *JUDGMENTS)
    return t.leads().select("lead_id").join(ok, "lead_id", "left")


@query("G9_judgment_design", "SELECT l.lead_id, " + ", ".join(
    f"CASE WHEN j.lead_id IS NOT NULL THEN ({_CTX[f]} = '{lvl}')::INT::DOUBLE END AS \"{f}={lvl}\""
    for f, ref in CONTEXT_REFERENCES.items() for lvl in CONTEXT_LEVELS[f] if lvl != ref) + """
FROM leads l LEFT JOIN (SELECT * FROM judgments WHERE status = 'ok') j USING (lead_id)""")
def judgment_design(t: Tables) -> DataFrame:
    return judgments.context_columns(judgment_table(t), t.leads().select("lead_id"))


@query("S8_context_scores", """
SELECT lead_id, round(ln(q / (1 - q)), 6) AS context_logit FROM leads LEFT JOIN (
  SELECT o_orderkey AS lead_id, least(greatest(o_totalprice / 500000, 0.001), 0.999) AS q FROM orders WHERE o_orderkey % 5 <> 0) USING (lead_id)""")
def context_scores(t: Tables) -> DataFrame:
    given = t.table("orders").where("o_orderkey % 5 <> 0").select(F.col("o_orderkey").alias("lead_id"), (F.col("o_totalprice") / 500000).alias("context_score"))
    return judgments.context_columns(given, t.leads().select("lead_id")).withColumn("context_logit", F.round("context_logit", 6))


@query("U4_stamps", "SELECT DISTINCT 'b' || (o_orderkey % 2) AS brief_hash, 'v1' AS prompt_version, o_orderpriority AS model_id FROM orders")
def stamps(t: Tables) -> DataFrame:
    return judgments.stamps(t.table("orders").select(F.concat(F.lit("b"), F.col("o_orderkey") % 2).alias("brief_hash"),
                                                     F.lit("v1").alias("prompt_version"), F.col("o_orderpriority").alias("model_id")))


@query("Q16_contract_problems", """
SELECT lead_id, 'persona' AS "column", CASE WHEN lead_id % 7 = 1 THEN 'robot' ELSE '<null>' END AS value FROM judgments WHERE status = 'ok' AND lead_id % 7 IN (1, 2)
UNION ALL SELECT lead_id, 'reason', CASE WHEN lead_id % 11 = 0 THEN '0 words' ELSE '31 words' END FROM judgments WHERE status = 'ok' AND lead_id % 11 IN (0, 1)""")
def contract_problems(t: Tables) -> DataFrame:
    k = F.col("lead_id")
    broken = judgment_table(t).withColumns({
        "persona": F.when(k % 7 == 1, "robot").when(k % 7 == 2, None).otherwise(F.col("persona")),
        "reason": F.when(k % 11 == 0, "  ").when(k % 11 == 1, F.repeat(F.lit("word "), 31)).otherwise(F.col("reason"))})
    return judgments.contract_problems(broken)


# ---- splits ----
SPLITS = ("1999-06-01", "1999-09-01", "1999-12-01", "2000-03-01", "2000-06-01", "2000-09-01")
ORIGINS = splits.origins(SPLITS, ORDERS_DATES.as_of, 120)


def rolling_rows(t: Tables, keep=("lead_id",)) -> DataFrame:
    df = scored(t).withColumn("y_legacy", labels.legacy_label(ORDERS_DATES))
    return splits.rolling_rows(df, ORIGINS, {True: "y", False: "y_legacy"}, list(keep))


def _sql_split(name: str, s: str) -> str:
    y = "y_legacy" if name.startswith("legacy") else "y"
    d = f"TIMESTAMP '{s}'"
    grown = {"strict": f" AND created_at + INTERVAL 120 DAY <= {d}", "relaxed": f" AND created_at + INTERVAL 120 DAY <= {T_AS_OF}"}.get(name, "")
    window = "" if name == "legacy to end" else f" AND created_at < {d} + INTERVAL 1 MONTH"
    now = f" AND created_at + INTERVAL 120 DAY <= {T_AS_OF}" if not name.startswith("legacy") else ""
    tr, te = f"{y} IS NOT NULL AND created_at < {d}{grown}", f"{y} IS NOT NULL AND created_at >= {d}{window}{now}"
    return f"""SELECT '{name}' AS variant, '{s}' AS split, count(*) FILTER (WHERE {tr}) AS n_train, count(*) FILTER (WHERE {tr} AND {y} = 1) AS wins_train,
      count(*) FILTER (WHERE {te}) AS n_test, count(*) FILTER (WHERE {te} AND {y} = 1) AS wins_test FROM scored"""


@query("E13_rolling_split_sizes", "SELECT *, n_test >= 100 AND wins_test >= 10 AND n_test - wins_test >= 10 AS sufficient FROM (" + " UNION ALL ".join(
    _sql_split(v, s) for v in ("strict", "relaxed", "legacy window", "legacy to end") for s in SPLITS) + ")")
def rolling_split_sizes(t: Tables) -> DataFrame:
    return splits.split_sizes(rolling_rows(t)).drop("status")


def _fit_cells(t: Tables) -> tuple[DataFrame, list[tuple[str, str]]]:
    """Design rows with one label and one training weight per (variant, split)."""
    df = scored(t).withColumn("y_legacy", labels.legacy_label(ORDERS_DATES))
    ys, ws, ts = [], [], []
    for o in ORIGINS:
        y = F.col("y" if o.waits else "y_legacy")
        train, test = o.masks(y)
        ys.append(F.coalesce(y.cast("double"), F.lit(0.0)))
        ws.append(F.coalesce(train, F.lit(False)).cast("double"))
        ts.append(F.coalesce(test, F.lit(False)))
    keyed = df.withColumns({"ys": F.array(*ys), "w": F.array(*ws), "in_test": F.array(*ts)})
    return design_rows(keyed, ["lead_id", "ys", "w", "in_test"]), [(o.variant, o.split) for o in ORIGINS]


def rolling_test_scores(t: Tables) -> DataFrame:
    """(variant, split, y, p) of every test row under the model fitted at its split; a split without a fit has no rows."""
    rows, cells = _fit_cells(t)
    rows = written(rows)
    beta = fits.fit_many(rows, len(cells), fits.column_weights(), "ys", fixed=True)
    scored_rows = fits.score_many(rows, beta, ["lead_id", "ys", "in_test"])
    each = scored_rows.select("lead_id", "ys", "in_test", F.posexplode("ps").alias("k", "p")).where(
        F.element_at("in_test", F.col("k") + 1) & F.col("p").between(0, 1))
    names = F.array(*[F.struct(F.lit(v).alias("variant"), F.lit(s).alias("split")) for v, s in cells])
    return each.select("lead_id", F.element_at(names, F.col("k") + 1).alias("c"), F.element_at("ys", F.col("k") + 1).alias("y"), "p").select(
        "lead_id", "c.*", "y", "p")


@query("E13_rolling_origin_auc")
def rolling_origin_auc(t: Tables) -> DataFrame:
    return rounded_auc(metrics.auc(rolling_test_scores(t), groups=["variant", "split"]))


@query("E14_rolling_headline")
def rolling_headline(t: Tables) -> DataFrame:
    """Mean AUC over the sufficient splits of a variant with its interval from independently resampled splits."""
    rows = written(rolling_test_scores(t))
    ok = splits.split_sizes(rolling_rows(t)).where("status = 'ok'").select("variant", "split")
    used = rows.join(ok, ["variant", "split"])
    point = metrics.auc(used, groups=["variant", "split"]).groupBy("variant").agg(F.avg("auc").alias("mean_auc"), F.count("*").alias("splits"))
    own = used.withColumn("draw_id", F.xxhash64("lead_id", "split"))  # splits draw independently
    samples = bootstrap.resampled_auc(own, ["p"], key="draw_id", groups=["variant", "split"], resamples=RESAMPLES)
    means = samples.groupBy("variant", "resample").agg(F.avg("auc").alias("auc"))
    return point.join(bootstrap.interval(means, "auc", ["variant"]), "variant")


_WINDOWS = splits.decay_windows(["1999-10", "1999-12", "2000-02"])


def _strict(split: str) -> tuple:
    return splits.origin("strict", split, ORDERS_DATES.as_of, 120).masks(F.col("y"))


@query("E15_decay_windows", " UNION ALL ".join(f"""
SELECT '{m}' AS fit_month, '{e}' AS eval_month, count(*) FILTER (WHERE created_at < TIMESTAMP '{cut}' AND created_at + INTERVAL 120 DAY <= TIMESTAMP '{cut}') AS n_train,
  count(*) FILTER (WHERE strftime(created_at, '%Y-%m') = '{e}' AND created_at + INTERVAL 120 DAY <= {T_AS_OF}) AS n_eval FROM scored WHERE y IS NOT NULL"""
                                                          for m, cut, evals in _WINDOWS for e in evals))
def decay_windows(t: Tables) -> DataFrame:
    cells = []
    for m, cut, evals in _WINDOWS:
        train, _ = _strict(cut)
        for e in evals:
            _, test = _strict(f"{e}-01")
            cells.append(F.struct(F.lit(m).alias("fit_month"), F.lit(e).alias("eval_month"), train.alias("tr"), test.alias("te")))
    long = scored(t).select(F.explode(F.array(*cells)).alias("c")).select("c.*")
    return long.groupBy("fit_month", "eval_month").agg(F.count_if("tr").alias("n_train"), F.count_if("te").alias("n_eval"))


@query("E15_calibration_decay")
def calibration_decay(t: Tables) -> DataFrame:
    """Models fitted through a month, their calibration on each of the next three months."""
    masks = [_strict(cut)[0] for _, cut, _ in _WINDOWS]
    df = scored(t).where("y is not null").withColumn("w", F.array(*[m.cast("double") for m in masks]))
    rows = written(design_rows(df, ["lead_id", "y", "w", "created_at"]))
    beta = fits.fit_many(rows, len(_WINDOWS), fits.column_weights(), fixed=True)
    scored_rows = fits.score_many(rows, beta, ["lead_id", "y", "created_at"])
    cells = []
    for i, (m, _, evals) in enumerate(_WINDOWS):
        for e in evals:
            _, test = _strict(f"{e}-01")
            cells.append(F.when(test & F.element_at("ps", i + 1).between(0, 1), F.struct(F.lit(f"{m} on {e}").alias("window"), F.element_at("ps", i + 1).alias("p"))))
    long = scored_rows.select("y", F.explode(F.array_compact(F.array(*cells))).alias("c")).select("y", "c.*")
    return screens.calibration(long, "window")


def _sql_newton(src: str, group: str, passes: int = 30) -> str:
    """Common table expressions it0 ... : both calibration fits by Newton steps from 0, one expression a pass."""
    step = """SELECT grp, greatest(-2, least(2, (h11 * g0 - h01 * g1) / nullif(h00 * h11 - h01 * h01, 0))) + b0 AS b0,
  greatest(-2, least(2, (h00 * g1 - h01 * g0) / nullif(h00 * h11 - h01 * h01, 0))) + b1 AS b1, greatest(-2, least(2, ga / ha)) + a AS a FROM (
  SELECT grp, any_value(b0) AS b0, any_value(b1) AS b1, any_value(a) AS a, sum(y - mu) AS g0, sum((y - mu) * x) AS g1, sum(mu * (1 - mu)) AS h00,
    sum(mu * (1 - mu) * x) AS h01, sum(mu * (1 - mu) * x * x) AS h11, sum(y - nu) AS ga, sum(nu * (1 - nu)) AS ha
  FROM (SELECT r.*, b0, b1, a, 1 / (1 + exp(-(b0 + b1 * x))) AS mu, 1 / (1 + exp(-(a + x))) AS nu FROM cal r JOIN it{} USING (grp)) GROUP BY grp)"""
    head = f"""cal AS MATERIALIZED (SELECT {group} AS grp, y, p, ln(q / (1 - q)) AS x FROM (SELECT *, greatest({CALIBRATION_CLIP[0]}, least({CALIBRATION_CLIP[1]}, p)) AS q FROM {src})),
it0 AS (SELECT grp, 0.0::DOUBLE AS b0, 0.0::DOUBLE AS b1, 0.0::DOUBLE AS a FROM cal GROUP BY grp HAVING sum(y) BETWEEN 1 AND count(*) - 1)"""
    return ",\n".join([head, *[f"it{k + 1} AS MATERIALIZED ({step.format(k)})" for k in range(passes)]])


@query("M10_calibration_slope", f"""
WITH {_sql_newton("(SELECT y, p, strftime(created_at, '%Y') AS year FROM test_rows)", "year")}
SELECT c.grp AS year, count(*) AS n, sum(y) AS wins, round(avg(p), 8) AS mean_p, round(avg(y), 8) AS observed, round(avg((y - p) * (y - p)), 8) AS brier,
  round(any_value(b1), 6) AS slope, round(any_value(a), 6) AS intercept
FROM cal c LEFT JOIN it30 ON c.grp = it30.grp GROUP BY c.grp""")
def calibration_slope(t: Tables) -> DataFrame:
    rows = test_rows(t).select("y", "p", F.date_format("created_at", "yyyy").alias("year"))
    out = screens.calibration(rows, "year")
    return out.select("year", "n", "wins", *[F.round(c, 8).alias(c) for c in ("mean_p", "observed", "brier")], *[F.round(c, 6).alias(c) for c in ("slope", "intercept")])


# ---- fits ----
@query("M1_logistic_fit")
def logistic_fit(t: Tables) -> DataFrame:
    return models.weights_frame(t.spark, models.fit_logistic(training_design(t).drop("lead_id"), COLUMNS)).drop("position")


@query("M3_scorecard_table")
def scorecard_table(t: Tables) -> DataFrame:
    weights = models.fit_logistic(training_design(t).drop("lead_id"), COLUMNS)
    return models.scorecard(models.weights_frame(t.spark, weights))


def _value_model(t: Tables, residual_sd: float | None = None) -> models.ValueModel:
    won = scored(t).where("is_train and y = 1 and deal_value is not null")
    return models.fit_deal_value(design.wide_design(won, dict.fromkeys(VALUE_LEVELS), VALUE_LEVELS, keep=["deal_value"]), VALUE_COLUMNS,
                                 residual_sd=residual_sd)


@query("M4_deal_value_fit")
def deal_value_fit(t: Tables) -> DataFrame:
    m = _value_model(t)
    return models.weights_frame(t.spark, m.weights).select("column", "log_odds", F.lit(m.residual_sd).alias("residual_sd"), F.lit(m.n_train).alias("n_train"))


@query("M5_lognormal_correction", """
SELECT count(*) AS n, round(stddev_samp(r), 8) AS residual_sd, round(exp(stddev_samp(r) * stddev_samp(r) / 2), 8) AS correction FROM (
  SELECT ln(deal_value) - log_value AS r FROM scored WHERE is_train AND y = 1 AND deal_value IS NOT NULL)""")
def lognormal_correction(t: Tables) -> DataFrame:
    r = scored(t).where("is_train and y = 1 and deal_value is not null").select((F.log("deal_value") - F.col("log_value")).alias("r"))
    sd = F.stddev_samp("r")
    return r.agg(F.count("*").alias("n"), F.round(sd, 8).alias("residual_sd"), F.round(F.exp(sd * sd / 2), 8).alias("correction"))


@query("E27_fixed_or_estimated_sd", """
WITH r AS (SELECT stddev_samp(ln(deal_value) - log_value) AS sd FROM scored WHERE is_train AND y = 1 AND deal_value IS NOT NULL)
SELECT 'estimated' AS kind, round(avg(p * exp(log_value) * exp(sd * sd / 2)), 4) AS mean_value FROM test_rows, r
UNION ALL SELECT 'fixed', round(avg(p * exp(log_value) * exp(0.5::DOUBLE * 0.5 / 2)), 4) FROM test_rows""")
def fixed_or_estimated_sd(t: Tables) -> DataFrame:
    sd = scored(t).where("is_train and y = 1 and deal_value is not null").agg(F.stddev_samp(F.log("deal_value") - F.col("log_value"))).scalar()
    cells = F.array(F.struct(F.lit("estimated").alias("kind"), F.exp(sd * sd / 2).alias("c")), F.struct(F.lit("fixed").alias("kind"), F.exp(F.lit(0.125)).alias("c")))
    long = test_rows(t).select("p", "log_value", F.explode(cells).alias("k"))
    return long.groupBy(F.col("k.kind").alias("kind")).agg(F.round(F.avg(F.col("p") * F.exp("log_value") * F.col("k.c")), 4).alias("mean_value"))


@query("M6_soft_label_fit")
def soft_label_fit(t: Tables) -> DataFrame:
    """Each training row once per class, weighted by the known probability."""
    wide = design.wide_design(scored(t).where("is_train"), keep=["p"])
    classes = F.array(F.struct(F.lit(1.0).alias("y"), F.col("p").alias("weight")), F.struct(F.lit(0.0).alias("y"), (1 - F.col("p")).alias("weight")))
    twice = wide.withColumn("c", F.explode(classes)).select("c.*", *[F.col(f"`{c}`") for c in COLUMNS])
    return models.weights_frame(t.spark, models.fit_logistic(twice, COLUMNS, weight="weight")).select("column", "log_odds")


@query("M7_penalty_sweep")
def penalty_sweep(t: Tables) -> DataFrame:
    """Test AUC for twelve penalties fitted together, with the gain over the default and whether the curve is flat."""
    cs = [0.01, 0.02, 0.05, 0.1, 0.2, 0.5, 1.0, 2.0, 5.0, 10.0, 50.0, 100.0]
    ones = [1.0] * len(cs)
    rows = design_rows(scored(t).where("is_train"), ["lead_id", "y"]).withColumn("w", F.array(*[F.lit(x) for x in ones]))
    beta = fits.fit_many(rows, len(cs), fits.column_weights(), c=cs)
    tested = fits.score_many(design_rows(test_rows(t), ["lead_id", "y"]), beta, ["lead_id", "y"])
    long = tested.select("y", F.posexplode("ps").alias("k", "p"))
    table = metrics.auc(long, groups=["k"]).select(F.element_at(F.array(*[F.lit(c) for c in cs]), F.col("k") + 1).alias("c"), "auc").persist()
    default = table.where("c = 0.5").select("auc").scalar()
    return table.select("c", F.round("auc", 6).alias("auc"), F.round(F.col("auc") - default, 6).alias("gain"),
                        (F.abs(F.col("auc") - default) < 0.005).alias("flat"))


@query("M8_boosted_trees")
def boosted_trees(t: Tables) -> DataFrame:
    cols = [f"o_{f}" for f in FEATURES]
    df = features.ordinal_features(scored(t), FEATURES)
    model = models.fit_boosted_trees(df.where("is_train"), cols)
    filled = df.where("is_test").select("lead_id", "y", *[F.coalesce(F.col(c), F.lit(-1.0)).alias(c) for c in cols])
    p = model.transform(design.with_vector(filled, cols)).select("lead_id", "y", vector_to_array("probability")[1].alias("p"))
    return rounded_auc(metrics.auc(p))


@query("M9_cross_fitted_scores")
def cross_fitted_scores(t: Tables) -> DataFrame:
    """Out-of-fold probabilities of the labelled mature rows, five stratified folds fitted together."""
    base = splits.with_folds(scored(t).where("is_train or is_test"), 5)
    w = F.array(*[(F.col("fold") != k).cast("double") for k in range(5)])
    rows = written(design_rows(base.withColumn("w", w), ["lead_id", "y", "w", "fold"]))
    beta = fits.fit_many(rows, 5, fits.column_weights(), fixed=True)
    out = fits.score_many(rows, beta, ["lead_id", "y", "fold"])
    return out.select("lead_id", "y", "fold", F.element_at("ps", F.col("fold") + 1).alias("p"))


@query("M9_fold_sizes", """
SELECT y::INT AS y, fold, count(*) AS n FROM (SELECT y, ((row_number() OVER (PARTITION BY y ORDER BY h, lead_id) - 1) % 5)::INT AS fold FROM (
  SELECT lead_id, y, {h} AS h FROM scored WHERE is_train OR is_test)) GROUP BY ALL""".format(h=sql_hash("lead_id", "0")))
def fold_sizes(t: Tables) -> DataFrame:
    folds = splits.with_folds(scored(t).where("is_train or is_test").select("lead_id", "y"), 5)
    return folds.groupBy(F.col("y").cast("int").alias("y"), "fold").agg(F.count("*").alias("n"))


@query("M11_batch_scoring")
def batch_scoring(t: Tables) -> DataFrame:
    from leadvane.config import LabelSpec
    from leadvane.plans import training
    prepared = training.prepare(t.leads(), t.crm(), t.companies(), LabelSpec(), ORDERS_DATES)
    rows = written(prepared.select(*training.TRAINING_COLUMNS))  # without the columns no fit reads, which would be dealt and written too
    model = training.train(rows, margin=0.3)
    return training.score_batch(t.leads(), t.companies(), model)


@query("M12_level_problems", " UNION ALL ".join(f"""
SELECT '{f}' AS feature, coalesce(f_{f}, '<null>') AS level, count(*) AS n FROM scored WHERE coalesce(f_{f}, '<null>') <> '{LEVELS[f][0]}' GROUP BY 2"""
                                                for f in FEATURES))
def level_problems(t: Tables) -> DataFrame:
    """Against a specification that declares only the first level of every feature."""
    return design.unknown_levels(scored(t), {f: LEVELS[f][:1] for f in FEATURES})


@query("M13_context_models")
def context_models(t: Tables) -> DataFrame:
    """Formula, context-only and combined models on the rows with context: test AUC of each."""
    ctx = judgments.context_design(scored(t).select("lead_id"), judgment_table(t))
    ctx_cols = [c for c in ctx.columns if c != "lead_id"]
    have = ctx.where(F.col(f"`{ctx_cols[0]}`").isNotNull())
    wide = design.wide_design(scored(t).where("is_train or is_test"), keep=["lead_id", "y", "is_train"]).join(have, "lead_id")
    wide = written(wide)
    out = []
    for name, cols in (("formula", COLUMNS), ("context", ctx_cols), ("combined", COLUMNS + ctx_cols)):
        ones = wide.where("is_train").select("y", fits.design_array(cols), F.array(F.lit(1.0)).alias("w"))
        beta = fits.fit_many(ones, 1, fits.column_weights())
        p = fits.score_many(wide.where("not is_train").select("lead_id", "y", fits.design_array(cols)), beta, ["lead_id", "y"])
        out.append(p.select(F.lit(name).alias("model"), "lead_id", "y", F.element_at("ps", 1).alias("p")))
    return rounded_auc(metrics.auc(out[0].unionByName(out[1]).unionByName(out[2]), groups=["model"]))


@query("M14_standard_errors")
def standard_errors(t: Tables) -> DataFrame:
    cols = ["sessions_3plus=yes", "viewed_pricing=yes", "email=free", "form_variant=C"]
    rows = models.logistic_with_errors(training_design(t), cols)
    return t.spark.createDataFrame([(c, b, s, b - 1.96 * s, b + 1.96 * s) for c, b, s in rows],
                                   "column string, coefficient double, error double, lo double, hi double")


@query("M14_least_squares", """
SELECT round(regr_slope(z, s), 6) AS slope, round(regr_intercept(z, s), 6) AS intercept FROM (
  SELECT ln(p / (1 - p)) AS z, CASE WHEN f_sessions_3plus = 'yes' THEN 1 ELSE 0 END AS s FROM scored WHERE is_train)""")
def least_squares(t: Tables) -> DataFrame:
    rows = design.wide_design(scored(t).where("is_train"), keep=["p"]).withColumn("z", F.log(F.col("p") / (1 - F.col("p"))))
    w, _ = models.least_squares(rows, ["sessions_3plus=yes"], "z")
    return t.spark.createDataFrame([(round(w["sessions_3plus=yes"], 6), round(w["(intercept)"], 6))], "slope double, intercept double")


@query("M15_starting_points_and_movers", f"""
SELECT lead_id, round({WEIGHTS['(intercept)']} * 20 / ln(2), 4) AS starting_points, round((ln(p / (1 - p)) - {WEIGHTS['(intercept)']}) * 20 / ln(2), 4) AS movers FROM scored""")
def starting_points_and_movers(t: Tables) -> DataFrame:
    wide = design.wide_design(scored(t).where("is_train"), keep=[])
    constant = [r["column"] for r in screens.constant_columns(wide, COLUMNS).collect()]  # at most one per design column
    rows = models.explain_scores(design.long_design(scored(t)), WEIGHTS, scored(t))
    start = F.col("column").isin("(intercept)", *constant)
    return rows.groupBy("lead_id").agg(F.round(F.sum(F.when(start, F.col("points")).otherwise(0.0)), 4).alias("starting_points"),
                                       F.round(F.sum(F.when(start, 0.0).otherwise(F.col("points"))), 4).alias("movers"))


@query("E8_coefficient_bootstrap")
def coefficient_bootstrap(t: Tables) -> DataFrame:
    return coefficient_intervals(t, RESAMPLES)


def coefficient_intervals(t: Tables, resamples: int) -> DataFrame:
    """Percentile intervals of every coefficient from refits on resampled training rows, all refits together."""
    rows = design_rows(scored(t).where("is_train"), ["lead_id", "y"])
    beta = fits.refit_resamples(rows, resamples, fits.bootstrap_weights(resamples, 0))
    return bootstrap.interval(fits.coefficient_frame(t.spark, beta, COLUMNS), "coefficient", ["column"])


@query("E8_resample_weights", f"""
SELECT resample, sum(w)::BIGINT AS total_weight FROM (SELECT resample, ({SQL_CUTS})::BIGINT AS w FROM (
  SELECT resample, {sql_hash('lead_id', f'resample * {bootstrap.DRAWS_PER_RESAMPLE}')} AS h FROM scored CROSS JOIN (SELECT unnest(range({RESAMPLES})) AS resample) WHERE is_train)) GROUP BY 1""")
def resample_weights(t: Tables) -> DataFrame:
    def weigh(batches):
        for pdf in batches:
            w = bootstrap.poisson_weights(pdf["lead_id"].to_numpy(), np.ones(len(pdf), dtype=np.int64), RESAMPLES, 0)
            yield pdf.assign(w=list(w))[["w"]]
    rows = scored(t).where("is_train").select("lead_id").mapInPandas(weigh, "w array<double>")
    return rows.select(F.posexplode("w").alias("resample", "x")).groupBy(F.col("resample").cast("bigint").alias("resample")).agg(
        F.sum("x").cast("bigint").alias("total_weight"))


@query("E18_feature_selection")
def feature_selection(t: Tables) -> DataFrame:
    """A feature is kept when the interval of any of its levels excludes zero."""
    ci = coefficient_intervals(t, RESAMPLES).where("column <> '(intercept)'")
    clear = (F.col("lo") > 0) | (F.col("hi") < 0)
    return ci.groupBy(F.split("column", "=", 2)[0].alias("feature")).agg(F.max(clear.cast("int")).alias("keep"), F.count("*").alias("levels"))


@query("E16_subsampling_curve")
def subsampling_curve(t: Tables) -> DataFrame:
    """Test AUC of the formula by training size over seeds, and once of the full pool; every fit shares one pass per iteration.

    A size above the pool has no row.
    """
    sizes, seeds = (300, 500, 1000, 2000, 3000), tuple(range(20))
    pool = scored(t).where("is_train")
    cuts = splits.hash_cuts(pool, "lead_id", sizes, seeds)
    cells = sorted(cuts)
    w = F.array(*[(ranking.hash_order(F.col("lead_id"), s) <= F.lit(cuts[n, s])).cast("double") for n, s in cells], F.lit(1.0))
    cells.append((pool.count(), 0))
    beta = fits.fit_many(design_rows(pool.withColumn("w", w), ["lead_id", "y", "w"]), len(cells), fits.column_weights())
    p = fits.score_many(design_rows(test_rows(t), ["lead_id", "y"]), beta, ["lead_id", "y"]).select("y", F.posexplode("ps").alias("k", "p"))
    size = F.element_at(F.array(*[F.lit(n) for n, _ in cells]), F.col("k") + 1)
    auc = metrics.auc(p, groups=["k"]).withColumn("size", size).withColumn("full", F.col("k") == len(cells) - 1)
    return auc.groupBy("size", "full").agg(F.count("*").alias("seeds"), F.avg("auc").alias("mean_auc"), F.stddev_samp("auc").alias("sd_auc"))


def customer_samples(pool: DataFrame, draws: int, n: int) -> DataFrame:
    """The leads of ``pool`` that any of ``draws`` samples of ``n`` holds, with a map ``m`` from draw to whether they are in its latest fifth."""
    each = F.explode(F.array(*[F.lit(d).cast("bigint") for d in range(draws)]))
    sample = ranking.sample_exact(pool.select("lead_id", "created_at", each.alias("draw")), "lead_id", F.lit(n), F.col("draw"), ["draw"])
    rank = F.row_number().over(ranking.W.partitionBy("draw").orderBy(F.desc("created_at"), F.desc("lead_id")))  # n rows per draw
    held = sample.withColumn("held", rank <= int(n * 0.2)).groupBy("lead_id").agg(
        F.map_from_entries(F.collect_list(F.struct(F.col("draw"), F.col("held")))).alias("m"))  # at most one entry per draw
    return pool.join(F.broadcast(held), "lead_id")  # at most draws x n rows; the pool grows


@query("E17_customer_sized_holdout")
def customer_sized_holdout(t: Tables) -> DataFrame:
    """Interval width on the latest fifth of customer-sized samples: draws are masks over one design."""
    draws, n = 20, 2000
    pool = scored(t).where("is_train or is_test")
    cells = [F.try_element_at("m", F.lit(d).cast("bigint")) for d in range(draws)]
    keyed = customer_samples(pool, draws, n).withColumns({
        "w": F.array(*[F.coalesce((~c).cast("double"), F.lit(0.0)) for c in cells]), "t": F.array(*[F.coalesce(c, F.lit(False)) for c in cells])})
    rows = written(design_rows(keyed, ["lead_id", "y", "w", "t"]))
    beta = fits.fit_many(rows, draws, fits.column_weights(), fixed=True)
    p = fits.score_many(rows, beta, ["lead_id", "y", "t"]).select("lead_id", "y", "t", F.posexplode("ps").alias("draw", "p")).where(
        F.element_at("t", F.col("draw") + 1))
    samples = bootstrap.resampled_auc(p, ["p"], groups=["draw"], resamples=RESAMPLES)
    return bootstrap.interval(samples, "auc", ["draw"]).withColumn("width", F.col("hi") - F.col("lo"))


# ---- screens ----
@query("E11_collinear_pairs", """
WITH long AS (SELECT lead_id, "column", v FROM (UNPIVOT (SELECT lead_id, {cols} FROM scored WHERE is_train) ON COLUMNS(* EXCLUDE (lead_id)) INTO NAME "column" VALUE v))
SELECT x."column" AS a, y."column" AS b, round(corr(x.v, y.v), 6) AS r FROM long x JOIN long y USING (lead_id) WHERE x."column" < y."column"
GROUP BY ALL HAVING stddev_pop(x.v) > 0 AND stddev_pop(y.v) > 0""".format(cols=", ".join(
    f"(f_{c.split('=', 1)[0]} = '{c.split('=', 1)[1]}')::INT::DOUBLE AS \"{c}\"" for c in COLUMNS)))
def collinear_pairs(t: Tables) -> DataFrame:
    r = screens.correlations(training_design(t), COLUMNS)
    return r.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"), F.round("r", 6).alias("r"))


@query("E12_constant_columns", " UNION ALL ".join(f"""SELECT '{c}' AS "column" FROM (SELECT 1) WHERE (
  SELECT count(DISTINCT f_{c.split('=', 1)[0]} = '{c.split('=', 1)[1]}') FROM scored WHERE is_train AND f_channel <> 'meta_leadads') = 1""" for c in COLUMNS))
def constant_columns(t: Tables) -> DataFrame:
    rows = design.wide_design(scored(t).where("is_train and channel <> 'meta_leadads'"), keep=[])
    return screens.constant_columns(rows, COLUMNS)


def _sql_screen(col: str, level: str) -> str:
    rate = f"(SELECT y, avg(y) OVER (PARTITION BY {level}) AS rate FROM extra_rows WHERE is_train)"
    return f"""SELECT 'x_{col}' AS feature, round(abs(auc - 0.5) + 0.5, 6) AS folded_auc, abs(auc - 0.5) + 0.5 > 0.9 AS leakage_flag,
      round(mc, 6) AS missing_closed, round(mo, 6) AS missing_open, abs(mc - mo) >= 0.5 AS missingness_flag FROM ({sql_auc(rate, 'rate')}),
      (SELECT avg(({col} IS NULL)::INT) FILTER (WHERE label_source IN ('won','crm_lost')) AS mc, avg(({col} IS NULL)::INT) FILTER (WHERE label_source NOT IN ('won','crm_lost')) AS mo FROM extra_rows)"""


@query("E19_leakage_screen", " UNION ALL ".join(_sql_screen(c, e) for c, e in (("segment", "segment"), ("priority", "priority"), ("status_text", "status_text"))))
def leakage_screen(t: Tables) -> DataFrame:
    rows = with_extras(t)
    encoder = extras.fit_encoder([e for e in DECLARED if e.kind == "categorical"], rows.where("is_train"))
    out = screens.leakage_screen(extras.encode(rows, encoder), [f.extra.column for f in encoder])
    return out.select("feature", F.round("folded_auc", 6).alias("folded_auc"), "leakage_flag", F.round("missing_closed", 6).alias("missing_closed"),
                      F.round("missing_open", 6).alias("missing_open"), "missingness_flag")


@query("E19_leakage_screen_all")
def leakage_screen_all(t: Tables) -> DataFrame:
    """The screen of every declared extra, numeric ones by their bins."""
    rows = with_extras(t)
    encoder = extras.fit_encoder(DECLARED, rows.where("is_train"))
    return screens.leakage_screen(extras.encode(rows, encoder), [f.extra.column for f in encoder])


@query("E20_generic_against_base")
def generic_against_base(t: Tables) -> DataFrame:
    """Paired AUC of the base design with and without the extras, and the collinearity verdict of the larger one."""
    rows = written(scored(t).where("is_train or is_test").join(extras_table(t), "lead_id"))  # the encoder reads them several times
    encoder = extras.fit_encoder(DECLARED, rows.where("is_train"))
    refs, levels = {**V2_REFERENCES, **extras.references(encoder)}, {**LEVELS, **extras.levels(encoder)}
    cols = design_columns(refs, levels)
    wide = written(design.wide_design(extras.encode(rows, encoder), refs, levels, keep=["lead_id", "y", "is_train"]))
    both = None
    for name, used in (("base", COLUMNS), ("generic", cols)):
        ones = wide.where("is_train").select("y", fits.design_array(used), F.array(F.lit(1.0)).alias("w"))
        beta = fits.fit_many(ones, 1, fits.column_weights())
        p = fits.score_many(wide.where("not is_train").select("lead_id", "y", fits.design_array(used)), beta, ["lead_id", "y"]).select(
            "lead_id", "y", F.element_at("ps", 1).alias(name))
        both = p if both is None else both.join(p.drop("y"), "lead_id")
    summary = bootstrap.paired_summary(bootstrap.paired_differences(bootstrap.resampled_auc(both, ["base", "generic"], resamples=RESAMPLES), "base", "generic"))
    worst = screens.correlations(wide.where("is_train"), cols).agg(F.max(F.abs("r")))
    return summary.withColumn("max_abs_corr", worst.scalar()).withColumn("passed", (F.col("lo") > 0) & (F.col("max_abs_corr") <= 0.95))


@query("E21_gap_recovered", """
SELECT round(quantile_cont(f, 0.025), 5) AS lo, round(quantile_cont(f, 0.975), 5) AS hi, count(*) AS resamples FROM (
  SELECT (b.auc2 - b.auc1) / (o.auc - b.auc1) AS f FROM boot_auc b JOIN boot_oracle o USING (resample))""")
def gap_recovered(t: Tables) -> DataFrame:
    """Share of the gap between a base score and an oracle that another score closes, on shared resamples."""
    return _gap_recovered(boot_rows(t))


def _gap_recovered(rows: DataFrame) -> DataFrame:
    rows = rows.withColumn("s3", F.col("y") * 0.3 + F.col("s1"))
    wide = bootstrap.resampled_auc(rows, ["s1", "s2", "s3"], resamples=RESAMPLES).groupBy("resample").pivot("model", ["s1", "s2", "s3"]).agg(F.first("auc"))
    f = wide.select(((F.col("s2") - F.col("s1")) / (F.col("s3") - F.col("s1"))).alias("f"))
    return f.agg(F.round(F.percentile("f", 0.025), 5).alias("lo"), F.round(F.percentile("f", 0.975), 5).alias("hi"), F.count("*").alias("resamples"))


view("boot_oracle", """SELECT resample, sum(pos * (below + neg / 2)) / (sum(pos) * sum(neg)) AS auc FROM (
  SELECT resample, pos, neg, coalesce(sum(neg) OVER (PARTITION BY resample ORDER BY s ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS below
  FROM (SELECT resample, y * 0.3::DOUBLE + s1 AS s, sum(w * y)::DOUBLE AS pos, sum(w * (1 - y))::DOUBLE AS neg FROM boot_weights GROUP BY resample, s)) GROUP BY resample""")


@query("E21_exact_gap_recovered", """
SELECT round(quantile_cont(f, 0.025), 5) AS lo, round(quantile_cont(f, 0.975), 5) AS hi, count(*) AS resamples FROM (
  SELECT (b.auc2 - b.auc1) / (o.auc - b.auc1) AS f FROM exact_auc b JOIN exact_oracle o USING (resample))""")
def exact_gap_recovered(t: Tables) -> DataFrame:
    return _gap_recovered(exact_rows(t))


view("exact_oracle", """SELECT resample, sum(pos * (below + neg / 2)) / (sum(pos) * sum(neg)) AS auc FROM (
  SELECT resample, pos, neg, coalesce(sum(neg) OVER (PARTITION BY resample ORDER BY s ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS below
  FROM (SELECT resample, y * 0.3::DOUBLE + s1 AS s, sum(w * y)::DOUBLE AS pos, sum(w * (1 - y))::DOUBLE AS neg FROM exact_weights GROUP BY resample, s)) GROUP BY resample""")


@query("E22_judgment_evaluation")
def judgment_evaluation(t: Tables) -> DataFrame:
    """Cross-fitted formula against formula plus judgments on the rows with an ok judgment."""
    ctx = judgments.context_design(scored(t).select("lead_id"), judgment_table(t))
    ctx_cols = [c for c in ctx.columns if c != "lead_id"]
    have = ctx.where(F.col(f"`{ctx_cols[0]}`").isNotNull())
    base = splits.with_folds(scored(t).where("is_train or is_test"), 5).join(have.select("lead_id"), "lead_id")
    wide = design.wide_design(base.withColumn("w", F.array(*[(F.col("fold") != k).cast("double") for k in range(5)])),
                              keep=["lead_id", "y", "w", "fold"]).join(have, "lead_id")
    wide = written(wide)
    both = None
    for name, cols in (("formula", COLUMNS), ("context", COLUMNS + ctx_cols)):
        rows = written(wide.select("lead_id", "y", "w", "fold", fits.design_array(cols)))
        beta = fits.fit_many(rows, 5, fits.column_weights(), fixed=True)
        p = fits.score_many(rows, beta, ["lead_id", "y", "fold"]).select("lead_id", "y", F.element_at("ps", F.col("fold") + 1).alias(name))
        both = p if both is None else both.join(p.drop("y"), "lead_id")
    samples = bootstrap.resampled_auc(both, ["formula", "context"], resamples=RESAMPLES)
    return bootstrap.paired_summary(bootstrap.paired_differences(samples, "formula", "context"))


def oracle_features(df: DataFrame) -> DataFrame:
    """Alternative feature table built from a truth table: outcome-side band, text and reply facts."""
    telemetry = F.col("session_missing") == "no"
    return df.select(
        "lead_id", "y", "is_train", "is_test", "band", "text", "channel", "seniority",
        F.when(F.col("email") == "free", "yes").otherwise("no").alias("free_email"),
        F.when(~telemetry, "missing").otherwise(F.col("time_on_page")).alias("visit_time"),
        F.when((F.col("channel") == "linkedin") & F.col("band").isin("51-200", "201-1000", "1000+"), "yes").otherwise("no").alias("linkedin_x_51plus"),
        F.when((F.col("seniority") == "senior") & (F.col("form_variant") == "D"), "yes").otherwise("no").alias("senior_x_formD"))


@query("G12_oracle_features", """
SELECT lead_id, f_band AS band, CASE WHEN f_email = 'free' THEN 'yes' ELSE 'no' END AS free_email,
  CASE WHEN f_session_missing = 'yes' THEN 'missing' ELSE f_time_on_page END AS visit_time,
  CASE WHEN f_channel = 'linkedin' AND f_band IN ('51-200','201-1000','1000+') THEN 'yes' ELSE 'no' END AS linkedin_x_51plus,
  CASE WHEN f_seniority = 'senior' AND form_variant = 'D' THEN 'yes' ELSE 'no' END AS "senior_x_formD" FROM scored""")
def oracle_feature_table(t: Tables) -> DataFrame:
    return oracle_features(scored(t)).select("lead_id", "band", "free_email", "visit_time", "linkedin_x_51plus", "senior_x_formD")


@query("E23_ceiling_comparison")
def ceiling_comparison(t: Tables) -> DataFrame:
    """The same fit on alternative feature tables: test AUC of each."""
    yes_no, bands = ("no", "yes"), LEVELS["band"]
    levels = {"band": bands, "text": LEVELS["text"], "channel": LEVELS["channel"], "seniority": LEVELS["seniority"], "free_email": yes_no,
              "visit_time": ("15-60s", "60-300s", "300-600s", ">600s", "missing"), "linkedin_x_51plus": yes_no, "senior_x_formD": yes_no}
    rows = oracle_features(scored(t)).where("is_train or is_test")
    out = []
    for name, used in (("main effects", [f for f in levels if "_x_" not in f]), ("with interactions", list(levels))):
        refs = {f: levels[f][0] for f in used}
        cols = design_columns(refs, levels)
        wide = design.wide_design(rows, refs, levels, keep=["lead_id", "y", "is_train"])
        ones = wide.where("is_train").select("y", fits.design_array(cols), F.array(F.lit(1.0)).alias("w"))
        beta = fits.fit_many(ones, 1, fits.column_weights())
        p = fits.score_many(wide.where("not is_train").select("lead_id", "y", fits.design_array(cols)), beta, ["lead_id", "y"])
        out.append(p.select(F.lit(name).alias("features"), "y", F.element_at("ps", 1).alias("p")))
    return rounded_auc(metrics.auc(out[0].unionByName(out[1]), groups=["features"]))


@query("E24_known_probability_gap", """
SELECT a.auc AS auc_true, b.auc AS auc_without, round(a.auc - b.auc, 6) AS gap FROM ({a}) a, ({b}) b""".format(
    a=sql_auc("test_rows", "p"), b=sql_auc("(SELECT y, round(ln(p / (1 - p)) - CASE WHEN f_seniority = 'senior' THEN 0.7283::DOUBLE ELSE 0 END, 6) AS s FROM test_rows)", "s")))
def known_probability_gap(t: Tables) -> DataFrame:
    without = F.round(logit(F.col("p"), (1e-6, 1 - 1e-6)) - F.when(F.col("seniority") == "senior", 0.7283).otherwise(0.0), 6)
    each = F.array(F.struct(F.lit("true").alias("m"), F.col("p").alias("s")), F.struct(F.lit("without").alias("m"), without.alias("s")))
    long = test_rows(t).select("y", F.explode(each).alias("e")).select("y", "e.*")
    wide = metrics.auc(long, score="s", groups=["m"]).groupBy().pivot("m", ["true", "without"]).agg(F.round(F.first("auc"), 6))
    return wide.select(F.col("true").alias("auc_true"), F.col("without").alias("auc_without"), F.round(F.col("true") - F.col("without"), 6).alias("gap"))


@query("E25_rates_by_label_definition", " UNION ALL ".join(
    f"""SELECT '{s.name}' AS labels, f_band AS band, count(*) AS n, round(avg(yy), 6) AS rate FROM (SELECT f_band, {{}} AS yy FROM scored_states WHERE created_at < {T_TEST_FROM} AND ({{}})) WHERE yy IS NOT NULL GROUP BY f_band""".format(
        "y_legacy" if s.mode == "legacy" else f"CASE WHEN coalesce(won_at <= created_at + INTERVAL {s.horizon_days} DAY, false) THEN 1.0::DOUBLE WHEN NOT ("
        + (" OR ".join(([f"NOT coalesce(first_contact_at <= created_at + INTERVAL {s.horizon_days} DAY, false)"] if not s.include_ghosted else [])
                       + (["stalled"] if not s.stalled_as_lost else [])) or "false") + ") THEN 0.0 END",
        "true" if s.mode == "legacy" else f"created_at + INTERVAL {s.horizon_days} DAY <= {T_AS_OF}") for s in STUDY_SPECS[:5]))
def rates_by_label_definition(t: Tables) -> DataFrame:
    long = labels.label_variants(scored(t), STUDY_SPECS[:5], ORDERS_DATES, ["band", "created_at"])
    rows = long.where(F.col("eligible") & F.col("y").isNotNull() & (F.col("created_at") < labels.at(ORDERS_DATES.test_from)))
    return rows.groupBy("labels", "band").agg(F.count("*").alias("n"), F.round(F.avg("y"), 6).alias("rate"))


view("scored_states", "SELECT s.*, l.first_contact_at, l.stalled FROM scored s JOIN (SELECT lead_id, first_contact_at, stalled FROM labelled) l USING (lead_id)")


@query("E25_label_definition_fits")
def label_definition_fits(t: Tables) -> DataFrame:
    """Band weights of the model trained under each label definition, all definitions fitted together."""
    specs = STUDY_SPECS
    before = F.col("created_at") < labels.at(ORDERS_DATES.test_from)
    ys = [labels.label(s, ORDERS_DATES) for s in specs]
    ws = [(y.isNotNull() & labels.eligible(s, ORDERS_DATES) & before).cast("double") for s, y in zip(specs, ys)]
    keyed = scored(t).withColumns({"ys": F.array(*[F.coalesce(y, F.lit(0.0)) for y in ys]), "w": F.array(*ws)})
    beta = fits.fit_many(design_rows(keyed, ["lead_id", "ys", "w"]), len(specs), fits.column_weights(), "ys")
    out = fits.coefficient_frame(t.spark, beta, COLUMNS).where("column like 'band=%'")
    return out.select(F.element_at(F.array(*[F.lit(s.name) for s in specs]), (F.col("fit") + 1).cast("int")).alias("labels"), "column", "coefficient")


@query("E26_coefficient_ties", """
WITH w("column", w) AS (VALUES ('channel=linkedin', 0.8121), ('channel=meta', 0.8123), ('seniority=senior', 0.812), ('email=free', -0.6), ('text=vague', -0.6001)),
  pairs AS (SELECT a."column" AS a, b."column" AS b FROM w a JOIN w b ON round(a.w, 3) = round(b.w, 3) AND a."column" < b."column")
SELECT a, b, round(corr((split_part(a, '=', 2) IN (f_channel, f_seniority, f_email, f_text))::INT, (split_part(b, '=', 2) IN (f_channel, f_seniority, f_email, f_text))::INT), 6) AS r
FROM pairs CROSS JOIN scored WHERE is_train GROUP BY a, b""")
def coefficient_ties(t: Tables) -> DataFrame:
    w = models.weights_frame(t.spark, {"channel=linkedin": 0.8121, "channel=meta": 0.8123, "seniority=senior": 0.812, "email=free": -0.6, "text=vague": -0.6001})
    return screens.coefficient_ties(w, screens.correlations(training_design(t), COLUMNS)).select("a", "b", F.round("r", 6).alias("r"))


@query("E28_metric_spread", """
WITH m AS (SELECT n_regionkey AS dataset, avg(o_totalprice) AS v FROM orders JOIN customer ON c_custkey = o_custkey JOIN nation ON n_nationkey = c_nationkey GROUP BY 1)
SELECT count(*) AS datasets, round(avg(v), 4) AS mean, round(stddev_samp(v), 4) AS sd, round(min(v), 4) AS lo, round(max(v), 4) AS hi,
  round(((SELECT avg(o_totalprice) FROM orders WHERE o_orderstatus = 'F') - avg(v)) / stddev_samp(v), 4) AS z FROM m""")
def metric_spread(t: Tables) -> DataFrame:
    joined = (t.table("orders").join(t.table("customer"), F.col("o_custkey") == F.col("c_custkey"), "left")
              .join(t.table("nation"), F.col("c_nationkey") == F.col("n_nationkey"), "left"))
    m = joined.groupBy("n_regionkey").agg(F.avg("o_totalprice").alias("v"))
    ref = t.table("orders").where("o_orderstatus = 'F'").agg(F.avg("o_totalprice")).scalar()
    return m.agg(F.count("*").alias("datasets"), F.round(F.avg("v"), 4).alias("mean"), F.round(F.stddev_samp("v"), 4).alias("sd"), F.round(F.min("v"), 4).alias("lo"),
                 F.round(F.max("v"), 4).alias("hi"), F.round((F.first(ref) - F.avg("v")) / F.stddev_samp("v"), 4).alias("z"))


@query("E10_frozen_test_sets", f"""
SELECT 'legacy' AS test_set, count(*) AS n, sum(y_legacy)::BIGINT AS wins FROM scored WHERE y_legacy IS NOT NULL AND created_at >= {T_TEST_FROM}
UNION ALL SELECT 'mature', count(*), sum(y)::BIGINT FROM test_rows""")
def frozen_test_sets(t: Tables) -> DataFrame:
    df = scored(t).withColumn("y_legacy", labels.label(LEGACY, ORDERS_DATES))
    late = F.col("created_at") >= labels.at(ORDERS_DATES.test_from)
    sets = F.array_compact(F.array(F.when(late & F.col("y_legacy").isNotNull(), F.struct(F.lit("legacy").alias("test_set"), F.col("y_legacy").alias("y"))),
                                   F.when(F.col("is_test"), F.struct(F.lit("mature").alias("test_set"), F.col("y").alias("y")))))
    return df.select(F.explode(sets).alias("s")).groupBy("s.test_set").agg(F.count("*").alias("n"), F.sum("s.y").cast("bigint").alias("wins"))
