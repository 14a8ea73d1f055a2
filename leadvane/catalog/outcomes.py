"""Queries: CRM outcomes and labels."""
from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from leadvane.catalog import views  # noqa: F401  (declares the shared oracle views)
from leadvane.catalog.base import query
from leadvane.catalog.views import FMT, T_AS_OF, T_TEST_FROM
from leadvane.config import LabelSpec
from leadvane.operators import cleaning, crm, labels
from leadvane.sources.bindings import ORDERS_DATES, Tables

HORIZON, LEGACY = LabelSpec(), LabelSpec(mode="legacy")


def ts(name: str):
    return F.date_format(name, "yyyy-MM-dd HH:mm:ss").alias(name)


def cleaned(t: Tables, leads: DataFrame | None = None) -> DataFrame:
    return crm.add_crm_outcomes(cleaning.clean(t.leads() if leads is None else leads), t.crm())


def labelled(t: Tables, spec: LabelSpec = HORIZON, leads: DataFrame | None = None) -> DataFrame:
    return labels.assign_labels(cleaned(t, leads), spec, ORDERS_DATES)


@query("A5_label_source_counts", """
SELECT coalesce(label_source, 'all') AS label_source, count(*) AS leads, count(*) FILTER (WHERE y = 1) AS wins,
  count(*) FILTER (WHERE y = 0) AS losses, count(*) FILTER (WHERE y IS NULL) AS unlabelled
FROM labelled GROUP BY ROLLUP (label_source)""")
def label_source_counts(t: Tables) -> DataFrame:
    return (labelled(t).rollup("label_source")
            .agg(F.count("*").alias("leads"), F.count_if(F.col("y") == 1).alias("wins"),
                 F.count_if(F.col("y") == 0).alias("losses"), F.count_if(F.col("y").isNull()).alias("unlabelled"))
            .withColumn("label_source", F.coalesce("label_source", F.lit("all"))))


@query("A5_training_summary", f"""
SELECT labels, train_n, train_wins, test_n, test_wins FROM (
  SELECT 'horizon H=120' AS labels, count(*) FILTER (WHERE y IS NOT NULL AND mature AND created_at < {T_TEST_FROM}) AS train_n,
    count(*) FILTER (WHERE y = 1 AND mature AND created_at < {T_TEST_FROM}) AS train_wins,
    count(*) FILTER (WHERE y IS NOT NULL AND mature AND created_at >= {T_TEST_FROM}) AS test_n,
    count(*) FILTER (WHERE y = 1 AND mature AND created_at >= {T_TEST_FROM}) AS test_wins FROM labelled
  UNION ALL
  SELECT 'legacy', count(*) FILTER (WHERE y_legacy IS NOT NULL AND created_at < {T_TEST_FROM}),
    count(*) FILTER (WHERE y_legacy = 1 AND created_at < {T_TEST_FROM}),
    count(*) FILTER (WHERE y_legacy IS NOT NULL AND created_at >= {T_TEST_FROM}),
    count(*) FILTER (WHERE y_legacy = 1 AND created_at >= {T_TEST_FROM}) FROM labelled)""")
def training_summary(t: Tables) -> DataFrame:
    rows = labels.label_variants(cleaned(t), [HORIZON, LEGACY], ORDERS_DATES, ["lead_id", "created_at"])
    usable = F.col("y").isNotNull() & F.col("eligible")
    before = F.col("created_at") < labels.at(ORDERS_DATES.test_from)
    return rows.groupBy("labels").agg(
        F.count_if(usable & before).alias("train_n"), F.count_if(usable & before & (F.col("y") == 1)).alias("train_wins"),
        F.count_if(usable & ~before).alias("test_n"), F.count_if(usable & ~before & (F.col("y") == 1)).alias("test_wins"))


@query("P5_canonical_stage", "SELECT stage, stage_n, count(*) AS n FROM crm_staged GROUP BY stage, stage_n")
def canonical_stage(t: Tables) -> DataFrame:
    return crm.with_stage(t.crm()).groupBy("stage", "stage_n").agg(F.count("*").alias("n"))


@query("A1_last_stage", f"SELECT lead_id, final_stage, strftime(last_change, {FMT}) AS last_change FROM outcomes")
def last_stage(t: Tables) -> DataFrame:
    return crm.lead_outcomes(t.crm()).select("lead_id", "final_stage", ts("last_change"))


@query("A2_win_attributes", f"""
SELECT lead_id, deal_value, strftime(won_at, {FMT}) AS won_at FROM outcomes WHERE won_at IS NOT NULL""")
def win_attributes(t: Tables) -> DataFrame:
    return crm.lead_outcomes(t.crm()).where("won_at is not null").select("lead_id", "deal_value", ts("won_at"))


@query("A3_first_contact", f"""
SELECT lead_id, strftime(first_contact_at, {FMT}) AS first_contact_at FROM outcomes""")
def first_contact(t: Tables) -> DataFrame:
    return crm.lead_outcomes(t.crm()).select("lead_id", ts("first_contact_at"))


@query("A4_multiple_wins", """
SELECT lead_id, count(*) AS n_won FROM (
  SELECT *, last_value(CASE WHEN event_type = 'signup' THEN event_id END IGNORE NULLS)
    OVER (PARTITION BY user_id ORDER BY ts, event_id) AS lead_id FROM events)
WHERE lead_id IS NOT NULL AND event_type = 'purchase' GROUP BY lead_id HAVING count(*) > 1""")
def multiple_wins(t: Tables) -> DataFrame:
    return crm.multiple_wins(t.event_stages())


@query("J3_crm_outcomes", f"""
SELECT l.lead_id, final_stage, strftime(last_change, {FMT}) AS last_change, deal_value,
  strftime(won_at, {FMT}) AS won_at, strftime(first_contact_at, {FMT}) AS first_contact_at
FROM leads l LEFT JOIN outcomes o USING (lead_id)""")
def crm_outcomes(t: Tables) -> DataFrame:
    return crm.add_crm_outcomes(t.leads(), t.crm()).select(
        "lead_id", "final_stage", ts("last_change"), "deal_value", ts("won_at"), ts("first_contact_at"))


@query("L1_legacy_label", "SELECT lead_id, y_legacy AS y FROM labelled")
def legacy_label(t: Tables) -> DataFrame:
    return labelled(t, LEGACY).select("lead_id", "y")


@query("L2_maturity", f"SELECT lead_id, strftime(matured_at, {FMT}) AS matured_at, mature FROM labelled")
def maturity(t: Tables) -> DataFrame:
    return t_maturity(cleaned(t))


def t_maturity(df: DataFrame) -> DataFrame:
    h = ORDERS_DATES.horizon_days
    return df.select("lead_id", F.date_format(labels.matured_at(h), "yyyy-MM-dd HH:mm:ss").alias("matured_at"),
                     labels.is_mature(h, ORDERS_DATES.as_of).alias("mature"))


@query("L3_won_within_horizon", "SELECT lead_id, won_within_h FROM labelled")
def won_within_horizon(t: Tables) -> DataFrame:
    return labelled(t).select("lead_id", "won_within_h")


@query("L4_ghosted_at_horizon", "SELECT lead_id, ghosted_at_h FROM labelled")
def ghosted_at_horizon(t: Tables) -> DataFrame:
    return cleaned(t).select("lead_id", labels.ghosted_at_horizon(ORDERS_DATES.horizon_days).alias("ghosted_at_h"))


@query("L5_label_source", "SELECT lead_id, label_source FROM labelled")
def label_source(t: Tables) -> DataFrame:
    return labelled(t).select("lead_id", "label_source")


@query("L6_horizon_label", """
SELECT lead_id, y, CASE WHEN won_within_h = 0 AND stalled THEN NULL ELSE won_within_h END AS y_ghosted,
  CASE WHEN won_within_h = 0 AND ghosted_at_h THEN NULL ELSE won_within_h END AS y_stalled FROM labelled""")
def horizon_label(t: Tables) -> DataFrame:
    return cleaned(t).select(
        "lead_id", labels.horizon_label(HORIZON, ORDERS_DATES).alias("y"),
        labels.horizon_label(LabelSpec(include_ghosted=True), ORDERS_DATES).alias("y_ghosted"),
        labels.horizon_label(LabelSpec(stalled_as_lost=True), ORDERS_DATES).alias("y_stalled"))


STUDY_SPECS = [LEGACY, HORIZON, LabelSpec(include_ghosted=True), LabelSpec(stalled_as_lost=True),
               LabelSpec(include_ghosted=True, stalled_as_lost=True)] + [
    LabelSpec(horizon_days=h) for h in (90, 150, 180, 240)]


def _variant_sql() -> str:
    parts = ["SELECT 'legacy' AS labels, y_legacy AS y, true AS eligible FROM lead_flags"]
    for s in STUDY_SPECS[1:]:
        h = s.horizon_days
        m = f"created_at + INTERVAL {h} DAY"
        censor = " OR ".join(([f"NOT coalesce(first_contact_at <= {m}, false)"] if not s.include_ghosted else [])
                             + (["stalled"] if not s.stalled_as_lost else [])) or "false"
        parts.append(f"""SELECT '{s.name}' AS labels, CASE WHEN coalesce(won_at <= {m}, false) THEN 1.0
            WHEN {m} <= {T_AS_OF} AND NOT ({censor}) THEN 0.0 END AS y, {m} <= {T_AS_OF} AS eligible FROM lead_flags""")
    return "WITH_VIEWS SELECT labels, count(*) AS leads, count(*) FILTER (WHERE eligible) AS eligible, " \
           "count(y) AS labelled_n, count(*) FILTER (WHERE y = 1) AS wins FROM (" + " UNION ALL ".join(parts) + \
           ") GROUP BY labels"


@query("L7_label_variants", _variant_sql().replace("WITH_VIEWS ", "").replace("lead_flags", "labelled"))
def label_variants(t: Tables) -> DataFrame:
    rows = labels.label_variants(cleaned(t), STUDY_SPECS, ORDERS_DATES, ["lead_id"])
    return rows.groupBy("labels").agg(
        F.count("*").alias("leads"), F.count_if("eligible").alias("eligible"), F.count("y").alias("labelled_n"),
        F.count_if(F.col("y") == 1).alias("wins"))


@query("P8_split_masks", f"""
SELECT lead_id, y IS NOT NULL AND mature AND created_at < {T_TEST_FROM} AS is_train,
  y IS NOT NULL AND mature AND created_at >= {T_TEST_FROM} AS is_test FROM labelled""")
def split_masks(t: Tables) -> DataFrame:
    return labels.with_split(labelled(t), HORIZON, ORDERS_DATES).select("lead_id", "is_train", "is_test")
