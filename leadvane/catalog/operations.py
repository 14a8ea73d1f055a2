"""Queries: monitors, the volume rule, steering towards a target, and upload files of two runs."""
from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from leadvane.catalog.base import query, scratch, view
from leadvane.catalog.datasets import stream_slices
from leadvane.catalog.features import scored
from leadvane.catalog.outcomes import cleaned, labelled
from leadvane.catalog.views import SQL_CHANNEL, T_AS_OF, T_TEST_FROM
from leadvane.config import LEVELS
from leadvane.functions import text
from leadvane.operators import cleaning, dictionary, labels, monitoring, ranking, steering, uploads, value
from leadvane.operators.rows import row_key
from leadvane.sources.bindings import ORDERS_DATES, Tables
from leadvane.streaming import jobs


def week(moment: str = "created_at") -> F.Column:
    return F.to_date(F.date_trunc("week", moment))


# ---- drift ----
def _in(levels: tuple[str, ...]) -> str:
    return ", ".join("'" + x.replace("'", "''") + "'" for x in levels)


_CELLS = " UNION ALL ".join(f"SELECT created_at, is_train, '{f}' AS feature, CASE WHEN f_{f} IN ({_in(lv)}) THEN f_{f} ELSE '(other)' END AS level FROM scored"
                            for f, lv in LEVELS.items())
_DECLARED = " UNION ALL ".join(f"SELECT '{f}' AS feature, unnest([{_in(lv)}, '(other)']) AS level, {len(lv) + 1} AS k" for f, lv in LEVELS.items())
view("feature_cells", _CELLS)
view("level_shares", f"""
SELECT d.feature, d.level, (coalesce(n, 0) + 0.5) / (sum(coalesce(n, 0)) OVER (PARTITION BY d.feature) + 0.5 * k) AS share
FROM ({_DECLARED}) d LEFT JOIN (SELECT feature, level, count(*) AS n FROM feature_cells WHERE is_train GROUP BY ALL) c USING (feature, level)""")


@query("X1_feature_drift", f"""
WITH w AS (SELECT date_trunc('week', created_at)::DATE AS week, feature, level, count(*) AS n FROM feature_cells WHERE created_at >= {T_TEST_FROM} GROUP BY ALL),
tot AS (SELECT week, feature, sum(n) AS leads FROM w GROUP BY ALL),
a AS (SELECT tot.week, feature, leads, b.share AS b, (coalesce(n, 0) + b.share) / (leads + 1) AS a
      FROM tot JOIN level_shares b USING (feature) LEFT JOIN w USING (week, feature, level)),
p AS (SELECT week, feature, leads::BIGINT AS leads, sum((a - b) * ln(a / b)) AS psi FROM a GROUP BY ALL)
SELECT strftime(week, '%Y-%m-%d') AS period, feature, leads, round(psi, 8) AS psi, CASE WHEN psi > 0.25 THEN 'alert' WHEN psi > 0.1 THEN 'warn' ELSE 'ok' END AS status FROM p""")
def feature_drift(t: Tables) -> DataFrame:
    df, path = scored(t).select("created_at", "is_train", *LEVELS), f"{scratch(t)}/level_baseline"
    monitoring.level_baseline(df.where("is_train"), LEVELS).write.parquet(path)
    baseline = t.spark.read.schema("feature string, level string, share double").parquet(path)
    new = df.where(F.col("created_at") >= labels.at(ORDERS_DATES.test_from))
    out = monitoring.level_drift(new, week(), baseline, LEVELS)
    return out.select(F.date_format("period", "yyyy-MM-dd").alias("period"), "feature", "leads", F.round("psi", 8).alias("psi"), "status")


# ---- rates ----
def series() -> dict[str, tuple[F.Column, F.Column]]:
    """Missing sessions for each website channel, missing enrichment in all."""
    return {"session_missing": (F.when(F.col("channel") != "meta_leadads", F.col("channel")), F.col("session_missing") == "yes"),
            "enrichment_missing": (F.lit("all"), F.col("enrichment_missing") == "yes")}


view("rate_cells", """
SELECT 'session_missing' AS monitor, f_channel AS part, created_at, f_session_missing = 'yes' AS flag, is_train FROM scored WHERE f_channel <> 'meta_leadads'
UNION ALL SELECT 'enrichment_missing', 'all', created_at, f_enrichment_missing = 'yes', is_train FROM scored""")
view("rate_days", """
WITH r AS (SELECT monitor, part, created_at::DATE AS day, count(*) AS n, count(*) FILTER (flag) AS bad FROM rate_cells GROUP BY ALL),
c AS (SELECT monitor, part, unnest(generate_series(a, b, INTERVAL 1 DAY))::DATE AS day FROM (SELECT monitor, part, min(day) AS a, max(day) AS b FROM r GROUP BY ALL)),
e AS (SELECT monitor, part, count(*) FILTER (flag) / count(*) AS expected FROM rate_cells WHERE is_train GROUP BY ALL)
SELECT c.*, coalesce(n, 0) AS n, coalesce(bad, 0) AS bad, expected,
  coalesce(bad / nullif(n, 0) > 2 * expected OR bad / nullif(n, 0) > expected + 0.1, false) AS breach
FROM c LEFT JOIN r USING (monitor, part, day) LEFT JOIN e USING (monitor, part)""")
_RUNS = """runs AS (SELECT *, CASE WHEN breach THEN row_number() OVER (PARTITION BY monitor, part, isle ORDER BY day) - lead_in ELSE 0 END AS run FROM (
  SELECT *, (NOT breach_first)::INT AS lead_in FROM (
    SELECT *, first_value(breach) OVER (PARTITION BY monitor, part, isle ORDER BY day) AS breach_first FROM (
      SELECT *, count(*) FILTER (NOT breach) OVER (PARTITION BY monitor, part ORDER BY day) AS isle FROM rate_days))))"""


@query("X2_missing_alerts", f"""
WITH {_RUNS}
SELECT monitor, part, strftime(day, '%Y-%m-%d') AS day, n, bad, round(expected, 8) AS expected,
  round(sum(bad) OVER w / nullif(sum(n) OVER w, 0), 8)::DOUBLE AS rolling, breach, run, run >= 2 AS alert
FROM runs WINDOW w AS (PARTITION BY monitor, part ORDER BY day ROWS BETWEEN 28 PRECEDING AND 1 PRECEDING)""")
def missing_alerts(t: Tables) -> DataFrame:
    df = scored(t)
    rates = monitoring.daily_rates(df, F.to_date("created_at"), series())
    out = monitoring.rate_alerts(rates, monitoring.expected_rates(df.where("is_train"), series()))
    return out.select("monitor", "part", F.date_format("day", "yyyy-MM-dd").alias("day"), "n", "bad", F.round("expected", 8).alias("expected"),
                      F.round("rolling", 8).alias("rolling"), "breach", "run", "alert")


#: How late a streamed lead may come.
STREAM_DELAY = "2 days"


@query("X2_streamed_missing_alerts", f"""
WITH {_RUNS}
SELECT monitor, part, strftime(day, '%Y-%m-%d') AS day, n, bad, breach, run, run >= 2 AS alert
FROM runs WHERE day + INTERVAL 1 DAY <= (SELECT max(created_at) - INTERVAL 2 DAY FROM scored)
  AND day <= (SELECT max(x.day) FROM rate_days x WHERE x.monitor = runs.monitor AND x.part = runs.part AND x.n > 0
    AND x.day + INTERVAL 1 DAY <= (SELECT max(created_at) - INTERVAL 2 DAY FROM scored))""")
def streamed_missing_alerts(t: Tables) -> DataFrame:
    """The daily rule on leads that arrive in four batches; days the watermark has closed."""
    df = scored(t).select("created_at", "is_train", "channel", "session_missing", "enrichment_missing")
    expected = f"{scratch(t)}/expected"
    monitoring.expected_rates(df.where("is_train"), series()).write.parquet(expected)
    rows = df.drop("is_train")
    known = t.spark.read.schema("monitor string, part string, expected double").parquet(expected)

    def start(stream: DataFrame, root: str) -> None:
        jobs.run_to_end(jobs.rate_alert_stream(stream, "created_at", series(), known, STREAM_DELAY), jobs.parquet_sink(f"{root}/out"), f"{root}/checkpoint")
    root = stream_slices(t, rows, start, "created_at")
    out = t.spark.read.schema(jobs.ALERT_OUTPUT).parquet(f"{root}/out")
    return out.select("monitor", "part", F.date_format("day", "yyyy-MM-dd").alias("day"), "n", "bad", "breach", "run", "alert")


@query("X2_weekly_bot_share", f"""
WITH w AS (SELECT date_trunc('week', created_at)::DATE AS week, count(*) AS leads, count(*) FILTER (bot) AS bots FROM flagged GROUP BY ALL),
e AS (SELECT count(*) FILTER (bot) / count(*) AS expected FROM flagged WHERE created_at < {T_TEST_FROM})
SELECT strftime(week, '%Y-%m-%d') AS week, leads, bots, round(expected, 8) AS expected, abs(bots / leads - expected) > 0.5 * expected AS alert FROM w, e""")
def weekly_bot_share(t: Tables) -> DataFrame:
    rows = t.leads().select("created_at", cleaning.is_bot(F.col("user_agent"), F.col("time_on_page_s")).alias("bot"))
    expected = rows.where(F.col("created_at") < labels.at(ORDERS_DATES.test_from)).agg(F.count_if("bot") / F.count("*")).scalar()
    weeks = rows.groupBy(week().alias("week")).agg(F.count("*").alias("leads"), F.count_if("bot").alias("bots")).withColumn("expected", expected)
    share = F.col("bots") / F.col("leads")
    return weeks.select(F.date_format("week", "yyyy-MM-dd").alias("week"), "leads", "bots", F.round("expected", 8).alias("expected"),
                        monitoring.moved(share, F.col("expected"), monitoring.BOT_MOVE).alias("alert"))


_UPLOAD = "greatest(25, anchor * log2(1 + least(value, cap) / anchor) * log_scale)"


@query("X2_weekly_scores", f"""
WITH r AS (SELECT date_trunc('week', created_at)::DATE AS week, p, value >= cap AS at_cap, {_UPLOAD} AS v FROM scored, fit_numbers),
w AS (SELECT week, count(*) AS leads, avg(p) AS mean_p, quantile_cont(v, 0.5) AS p50, quantile_cont(v, 0.99) AS p99, max(v) AS max,
  count(*) FILTER (at_cap) / count(*) AS cap_share, count(*) FILTER (v <= 25) / count(*) AS floor_share FROM r GROUP BY week),
c AS (SELECT unnest(generate_series(min(week), max(week), INTERVAL 7 DAY))::DATE AS week FROM w),
b AS (SELECT avg(p) AS base_p FROM scored WHERE is_train)
SELECT strftime(c.week, '%Y-%m-%d') AS week, coalesce(w.leads, 0) AS leads, round(w.mean_p, 8) AS mean_p, round(w.p50, 4) AS p50, round(w.p99, 4) AS p99,
  round(w.max, 4) AS max, round(w.cap_share, 8) AS cap_share, round(w.floor_share, 8) AS floor_share,
  coalesce(abs(w.mean_p - base_p) > 0.2 * base_p, false) AS p_moved, coalesce(w.max / w.p50 > 10, false) AS stretched,
  coalesce(w.cap_share > 0.06, false) AS capped, coalesce(abs(w.p50 - l.p50) > 0.25 * l.p50, false) AS median_moved
FROM c LEFT JOIN w ON c.week = w.week LEFT JOIN w l ON l.week = c.week - 7, b""")
def weekly_scores(t: Tables) -> DataFrame:
    df = scored(t).select("created_at", "p", "value", "is_train")
    fitted = value.fit_transform(df.where("is_train"), "value", value.ValueTransform())
    rows = df.select(week().alias("week"), "p", (F.col("value") >= fitted.cap).alias("at_cap"), fitted.apply(F.col("value")).alias("v"))
    base_p = df.where("is_train").agg(F.avg("p")).scalar()
    weeks = rows.groupBy("week").agg(F.count("*").alias("leads"), F.avg("p").alias("mean_p"), F.max("v").alias("max"),
                                     (F.count_if("at_cap") / F.count("*")).alias("cap_share"), (F.count_if(F.col("v") <= fitted.spec.floor) / F.count("*")).alias("floor_share"))
    weeks = monitoring.weekly_calendar(weeks.join(ranking.percentile_columns(rows, "v", {"p50": 0.5, "p99": 0.99}, ["week"]), "week"))
    return weeks.withColumn("base_p", base_p).select(
        F.date_format("week", "yyyy-MM-dd").alias("week"), "leads", F.round("mean_p", 8).alias("mean_p"), *[F.round(c, 4).alias(c) for c in ("p50", "p99", "max")],
        F.round("cap_share", 8).alias("cap_share"), F.round("floor_share", 8).alias("floor_share"),
        monitoring.moved(F.col("mean_p"), F.col("base_p"), monitoring.MEAN_MOVE).alias("p_moved"),
        F.coalesce(F.col("max") / F.col("p50") > monitoring.MAX_OVER_MEDIAN, F.lit(False)).alias("stretched"),
        F.coalesce(F.col("cap_share") > monitoring.CAP_SHARE, F.lit(False)).alias("capped"),
        monitoring.moved(F.col("p50"), F.col("previous_p50"), monitoring.MEDIAN_MOVE).alias("median_moved"))


# ---- volume rule ----
@query("X3_volume_verdict", f"""
SELECT coalesce(channel, 'all') AS channel, count(*) FILTER (WHERE y IS NOT NULL) AS rows_a_year, count(*) FILTER (WHERE won_within_h = 1) AS wins_a_year,
  CASE WHEN count(*) FILTER (WHERE y IS NOT NULL) >= 2000 AND count(*) FILTER (WHERE won_within_h = 1) >= 400 THEN 'accept'
    WHEN count(*) FILTER (WHERE y IS NOT NULL) >= 1000 AND count(*) FILTER (WHERE won_within_h = 1) >= 200 THEN 'conditional' ELSE 'decline' END AS verdict
FROM (SELECT *, {SQL_CHANNEL} AS channel FROM labelled WHERE mature AND created_at > {T_AS_OF} - INTERVAL 485 DAY) GROUP BY ROLLUP (channel)""")
def volume_rule(t: Tables) -> DataFrame:
    """The year of leads that matured last, for each channel and in all."""
    h, as_of = ORDERS_DATES.horizon_days, ORDERS_DATES.as_of
    df = labelled(t).where(labels.is_mature(h, as_of) & (F.col("created_at") > labels.at(as_of) - F.make_dt_interval(F.lit(h + 365))))
    rows = df.select(text.channel(F.col("utm_medium"), F.col("utm_source")).alias("channel"), "y", labels.won_within(h, as_of).alias("won"))
    out = rows.rollup("channel").agg(F.count("y").alias("rows_a_year"), F.count_if(F.col("won") == 1).alias("wins_a_year"))
    return out.select(F.coalesce("channel", F.lit("all")).alias("channel"), "rows_a_year", "wins_a_year",
                      monitoring.volume_verdict(F.col("rows_a_year"), F.col("wins_a_year")).alias("verdict"))


# ---- steering ----
view("target_cuts", """
SELECT quantile, minimum FROM (SELECT unnest([0.95, 0.9, 0.75, 0.5]::DOUBLE[]) AS quantile,
  unnest(quantile_cont(deal_value, [0.95, 0.9, 0.75, 0.5])) AS minimum FROM scored WHERE is_train AND y = 1 AND deal_value IS NOT NULL)""")


@query("X4_threshold_search", """
WITH c AS (SELECT quantile, minimum, count(*) AS train_rows, count(*) FILTER (WHERE y = 1 AND deal_value >= minimum) AS target_wins
  FROM scored, target_cuts WHERE is_train GROUP BY ALL),
a AS (SELECT *, train_rows >= 1000 AND target_wins >= 200 AS allowed FROM c)
SELECT quantile, round(minimum, 4) AS minimum, train_rows, target_wins, allowed,
  coalesce(quantile = max(CASE WHEN allowed THEN quantile END) OVER (), false) AS chosen FROM a""")
def threshold_search(t: Tables) -> DataFrame:
    out = steering.threshold_search(scored(t).where("is_train").select("y", "deal_value"))
    return out.withColumn("minimum", F.round("minimum", 4))


view("target_minimum", "SELECT minimum FROM target_cuts WHERE quantile = 0.75")
view("steer_test", """
SELECT t.*, coalesce(t.y = 1 AND deal_value >= minimum, false) AS target, p * coalesce(target_share, overall) * mean_target AS steer
FROM test_rows t CROSS JOIN target_minimum
CROSS JOIN (SELECT avg(coalesce(deal_value >= minimum, false)::INT) AS overall, avg(CASE WHEN deal_value >= minimum THEN deal_value END) AS mean_target
  FROM scored, target_minimum WHERE is_train AND y = 1)
LEFT JOIN (SELECT f_band, (sum(coalesce(deal_value >= minimum, false)::INT) + 10 * any_value(o)) / (count(*) + 10) AS target_share
  FROM scored, target_minimum, (SELECT avg(coalesce(deal_value >= minimum, false)::INT) AS o FROM scored, target_minimum WHERE is_train AND y = 1)
  WHERE is_train AND y = 1 GROUP BY f_band) USING (f_band)""")
_T = "SELECT target, CASE WHEN target THEN deal_value ELSE 0 END AS r"


def _steer_tiers(n: int) -> str:
    tier = "len(list_filter(e, lambda x: value >= x))"
    edges = f"(SELECT quantile_cont(value, {[i / n for i in range(1, n)]}) AS e FROM scored WHERE is_train)"
    return f"""{_T}, 'tiers {n}', m FROM (SELECT *, {tier} AS tier FROM steer_test, {edges})
  JOIN (SELECT {tier} AS tier, avg(value) AS m FROM scored, {edges} WHERE is_train GROUP BY 1) USING (tier)"""


@query("X4_steering_gap", f"""
WITH u AS ({_T}, 'identity' AS transform, value AS v FROM steer_test UNION ALL {_T}, 'target', steer FROM steer_test
  UNION ALL {_T}, 'cap p97', least(value, cap) FROM steer_test, fit_numbers UNION ALL {_T}, 'cap p97 + floor £25', greatest(25, least(value, cap)) FROM steer_test, fit_numbers
  UNION ALL {_T}, 'cap p97 + sqrt', sqrt(least(value, cap) * anchor) * sqrt_scale FROM steer_test, fit_numbers
  UNION ALL {_T}, 'cap p97 + log', anchor * log2(1 + least(value, cap) / anchor) * log_scale FROM steer_test, fit_numbers
  UNION ALL {_T}, 'cap p97 + log + floor £25', {_UPLOAD} FROM steer_test, fit_numbers UNION ALL {_steer_tiers(5)} UNION ALL {_steer_tiers(10)}),
k AS (SELECT *, row_number() OVER (PARTITION BY transform ORDER BY v DESC) AS rn, floor(count(*) OVER (PARTITION BY transform) * 0.2::DOUBLE) AS cut FROM u),
h AS (SELECT *, max(CASE WHEN rn = cut THEN v END) OVER (PARTITION BY transform) AS thr FROM k)
SELECT transform, count(*) FILTER (target) AS n_target, count(*) FILTER (NOT target) AS n_other, round(avg(v) FILTER (target), 4) AS mean_target,
  round(avg(v) FILTER (NOT target), 4) AS mean_other, round(avg(v) FILTER (target) / avg(v) FILTER (NOT target), 6) AS gap,
  round((coalesce(sum(r) FILTER (v > thr), 0) + (any_value(cut) - count(*) FILTER (v > thr))::DOUBLE / count(*) FILTER (v = thr) * sum(r) FILTER (v = thr)) / sum(r), 6) AS captured
FROM h GROUP BY transform""")
def steering_gap(t: Tables) -> DataFrame:
    df = scored(t).select("y", "deal_value", "value", "p", "band", "is_train", "is_test")
    train = df.where("is_train")
    minimum = ranking.percentiles(train.where("y = 1 AND deal_value IS NOT NULL"), "deal_value", [0.75]).first()["value"]
    values = steering.transform_values(train, "value", value.REPORT_TRANSFORMS) | {"target": F.col("steer")}
    out = steering.steering_gaps(steering.steering_value(df.where("is_test"), train, "band", minimum), values, minimum)
    return out.select("transform", "n_target", "n_other", *[F.round(c, 4).alias(c) for c in ("mean_target", "mean_other")], *[F.round(c, 6).alias(c) for c in ("gap", "captured")])


# ---- uploads ----
RUNS = {"1": "2000-12-01", "2": ORDERS_DATES.as_of, "3": ORDERS_DATES.as_of}  # the third repeats the second and sends nothing
_IDS = ("email", "phone", "consent", "gclid", "gbraid", "wbraid", "fbclid", "fbp", "li_fat_id", "oppref", "meta_lead_id")


_EM = "CASE WHEN consent AND trim(email) <> '' THEN sha256(lower(trim(email))) END"
_PH = "CASE WHEN consent AND regexp_replace(phone, '[^0-9]', '', 'g') <> '' THEN sha256('+' || regexp_replace(phone, '[^0-9]', '', 'g')) END"
_AMOUNT = "CAST(round(value, 2) AS DECIMAL(18,2))::VARCHAR"
view("upload_leads", f"""
SELECT c.*, {SQL_CHANNEL} AS channel, CASE {SQL_CHANNEL} WHEN 'google' THEN 'google' WHEN 'meta' THEN 'meta' WHEN 'meta_leadads' THEN 'meta' END AS platform,
  expected_value, {_UPLOAD.replace('value', 'expected_value')} AS upload, {_EM} AS em, {_PH} AS ph
FROM cleaned c JOIN (SELECT lead_id AS scored_id, value AS expected_value FROM scored) ON lead_id = scored_id, fit_numbers""")


def _state(run: str, as_of: str) -> str:
    at = f"TIMESTAMP '{as_of}'"
    won = f"coalesce(won_at <= {at}, false)"
    return f"""SELECT *, '{run}' AS run, 'submit' AS stage, CASE platform WHEN 'google' THEN 'CONVERSION' ELSE 'Lead' END AS kind, upload AS value, created_at AS moment
FROM upload_leads WHERE platform IS NOT NULL AND created_at <= {at}
UNION ALL SELECT *, '{run}', 'close', CASE WHEN platform = 'google' AND {won} THEN
    CASE WHEN floor((epoch(won_at) - epoch(created_at)) / 86400) > 90 THEN 'CLOSED_WON' ELSE 'RESTATEMENT' END
  WHEN platform = 'google' THEN 'RETRACTION' WHEN {won} AND floor((epoch({at}) - epoch(won_at)) / 86400) <= 7 THEN 'ClosedWon' END,
  CASE WHEN {won} THEN deal_value ELSE 0 END, CASE WHEN {won} THEN won_at ELSE created_at + INTERVAL 120 DAY END
FROM upload_leads WHERE platform IS NOT NULL AND created_at <= {at} AND (({won} AND deal_value IS NOT NULL) OR (NOT {won} AND created_at + INTERVAL 120 DAY <= {at}))"""


def _field(name: str, expr: str, quoted: bool = True) -> str:
    q = '"' if quoted else ""
    return f"""coalesce('"{name}":{q}' || ({expr}) || '{q},', '')"""


def _object(*fields: str) -> str:
    return "'{' || rtrim(" + " || ".join(fields) + ", ',') || '}'"


_GOOGLE = _object(
    _field("order_id", "lead_id::VARCHAR"), _field("type", "kind"), _field("conversion_time", "strftime(moment, '%Y-%m-%d %H:%M:%S+00:00')"),
    _field("value", f"CASE WHEN kind <> 'RETRACTION' THEN {_AMOUNT} END", False), _field("currency", "CASE WHEN kind <> 'RETRACTION' THEN 'GBP' END"),
    *[_field(n, f"CASE WHEN kind IN ('CONVERSION', 'CLOSED_WON') THEN {e} END") for n, e in (
        ("click_id_type", "CASE WHEN gclid IS NOT NULL THEN 'gclid' WHEN gbraid IS NOT NULL THEN 'gbraid' WHEN wbraid IS NOT NULL THEN 'wbraid' END"),
        ("click_id", "coalesce(gclid, gbraid, wbraid)"), ("hashed_email", "em"), ("hashed_phone", "ph"))])
_META = _object(
    _field("event_name", "kind"), _field("event_id", "lead_id::VARCHAR || CASE kind WHEN 'ClosedWon' THEN '-closed' ELSE '' END"),
    _field("event_time", "floor(epoch(moment))::BIGINT::VARCHAR", False),
    _field("user_data", _object(_field("fbc", "'fb.1.' || epoch_ms(created_at)::VARCHAR || '.' || fbclid"), _field("fbp", "fbp"), _field("lead_id", "meta_lead_id"),
                                _field("em", "'[\"' || em || '\"]'", False), _field("ph", "'[\"' || ph || '\"]'", False)), False),
    _field("custom_data", _object(_field("value", _AMOUNT, False), _field("currency", "'GBP'")), False))


@query("X5_upload_runs", f"""
WITH s AS ({_state("1", RUNS["1"])} UNION ALL {_state("2", RUNS["2"])}),
sent AS (SELECT * FROM s WHERE run = '1' AND kind IS NOT NULL),
new AS (SELECT * FROM sent UNION ALL SELECT s.* FROM s LEFT JOIN (SELECT lead_id AS id1, stage AS st1, value AS v1 FROM sent) x ON s.lead_id = id1 AND s.stage = st1
  WHERE run = '2' AND kind IS NOT NULL AND (id1 IS NULL OR (stage = 'close' AND v1 <> value)))
SELECT run, platform, lead_id, stage, kind, round(value, 4) AS value, strftime(moment, '%Y-%m-%d %H:%M:%S') AS moment,
  CASE platform WHEN 'google' THEN {_GOOGLE} ELSE {_META} END AS payload FROM new""")
def upload_runs(t: Tables) -> DataFrame:
    """Ledger rows of three runs, each sending what its predecessors have not."""
    leads, path = upload_leads(t), f"{scratch(t)}/ledger"
    for run, as_of in RUNS.items():
        uploads.send(leads.withColumns(value.close_stage(ORDERS_DATES.horizon_days, as_of)), path, run, as_of)
    out = uploads.read_ledger(t.spark, path)
    return out.select("run", "platform", "lead_id", "stage", "kind", F.round("value", 4).alias("value"), F.date_format("moment", "yyyy-MM-dd HH:mm:ss").alias("moment"), "payload")


def upload_leads(t: Tables) -> DataFrame:
    """Scored leads with platform, submit value, outcome and the identities to match on."""
    values = scored(t).select("lead_id", "value", "is_train")
    fitted = value.fit_transform(values.where("is_train"), "value", value.ValueTransform())
    rows = cleaned(t).select("lead_id", "created_at", "utm_medium", "utm_source", "won_at", "deal_value", *_IDS)
    channel = text.channel(F.col("utm_medium"), F.col("utm_source"))
    expected = values.where("lead_id is not null").select(row_key(F.col("lead_id")).alias("_row"), F.col("value").alias("expected_value"))
    rows = rows.join(expected, row_key(F.col("lead_id")) == F.col("_row")).drop("_row").withColumn("upload", fitted.apply(F.col("expected_value")))
    return rows.withColumn("channel", channel).withColumn("platform", uploads.platform(F.col("channel")))


@query("X5_unattributable", """
SELECT channel, CASE WHEN channel = 'meta_leadads' AND meta_lead_id IS NOT NULL THEN 'lead_form'
  WHEN coalesce(gclid, gbraid, wbraid, fbclid, li_fat_id, oppref) IS NOT NULL THEN 'click_id' WHEN em IS NOT NULL THEN 'email'
  WHEN fbp IS NOT NULL AND channel LIKE 'meta%' THEN 'browser_id' ELSE 'none' END AS match, count(*) AS leads, round(sum(expected_value), 2) AS value
FROM upload_leads WHERE channel <> 'organic_direct' GROUP BY ALL""")
def unattributable(t: Tables) -> DataFrame:
    rows = upload_leads(t).where("channel <> 'organic_direct'")
    return uploads.unattributable(rows, F.col("channel"), "expected_value", [F.col("channel")]).withColumn("value", F.round("value", 2))


@query("X5_held_amounts", f"""
SELECT lead_id, strftime(won_at, '%Y-%m-%d %H:%M:%S') AS won_at FROM upload_leads WHERE won_at <= {T_AS_OF} AND deal_value IS NULL""")
def held_amounts(t: Tables) -> DataFrame:
    rows = uploads.held(upload_leads(t).withColumns(value.close_stage(ORDERS_DATES.horizon_days, ORDERS_DATES.as_of)))
    return rows.select("lead_id", F.date_format("won_at", "yyyy-MM-dd HH:mm:ss").alias("won_at"))


# ---- levels of wide columns ----
MIN_ROWS = 3
view("user_levels", f"""
SELECT user_id::VARCHAR AS level, count(*) AS n, row_number() OVER (ORDER BY count(*) DESC, user_id::VARCHAR) + 1 AS id FROM events WHERE ts < TIMESTAMP '2024-01-20'
GROUP BY user_id HAVING count(*) >= {MIN_ROWS}""")


@query("G8_level_dictionary", "SELECT level, n, id FROM user_levels")
def user_level_dictionary(t: Tables) -> DataFrame:
    return dictionary.level_dictionary(t.table("events").where("ts < '2024-01-20'"), "user_id", MIN_ROWS).select("level", "n", "id")


@query("G8_encoded_levels", """
SELECT event_id, CASE WHEN user_id IS NULL THEN 0 ELSE coalesce(id, 1) END AS level_id FROM events LEFT JOIN user_levels ON user_id::VARCHAR = level""")
def encoded_levels(t: Tables) -> DataFrame:
    """Every event by the stored levels of the earlier ones."""
    events, path = t.table("events").select("event_id", "user_id", "ts"), f"{scratch(t)}/levels"
    dictionary.level_dictionary(events.where("ts < '2024-01-20'"), "user_id", MIN_ROWS).write.parquet(path)
    known = t.spark.read.schema("level string, n long, id long, heavy boolean").parquet(path)
    return dictionary.encode_ids(events, "user_id", known, "level_id").select("event_id", "level_id")
