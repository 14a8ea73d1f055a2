"""Queries: readers and writers, conversion, data quality, profiling and streaming."""
from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from leadvane import schemas
from leadvane.catalog.base import query, scratch, view
from leadvane.catalog.features import scored, texts
from leadvane.catalog.outcomes import ORDERS_DATES, ts
from leadvane.catalog.studies import COLUMNS, DECLARED, extras_table
from leadvane.catalog.views import FMT, T_AS_OF, VALUE_WEIGHTS, WEIGHTS
from leadvane.config import BENCHMARK_RULES, LEVELS, WEEKDAYS
from leadvane.functions import text
from leadvane.functions.scores import linear_score, sigmoid
from leadvane.operators import cleaning, conversion, crm, enrichment, extras, features, models, profiling, quality, value
from leadvane.operators.conversion import FieldMap, Feature, Outcome, SourceMapping, apply, col
from leadvane.plans import training
from leadvane.session import move_files, written
from leadvane.sources import tables
from leadvane.sources.bindings import EVENTS_AS_OF, Tables
from leadvane.streaming import jobs


# ---- readers and writers ----
@query("S1_read_leads", f"""
SELECT lead_id::VARCHAR AS lead_id, strftime(created_at, {FMT}) AS created_at, email, company_name, time_on_page_s, viewed_pricing, utm_term FROM leads""")
def read_leads(t: Tables) -> DataFrame:
    path = scratch(t)
    tables.write_csv(t.leads(), path)
    return tables.read_leads(t.spark, path).select("lead_id", ts("created_at"), "email", "company_name", "time_on_page_s", "viewed_pricing", "utm_term")


@query("S2_read_crm", f"SELECT lead_id::VARCHAR AS lead_id, stage, deal_value, strftime(changed_at, {FMT}) AS changed_at FROM crm")
def read_crm(t: Tables) -> DataFrame:
    path = scratch(t)
    tables.write_csv(t.crm(), path)
    return tables.read_crm(t.spark, path).select("lead_id", "stage", "deal_value", ts("changed_at"))


@query("S3_read_companies", "SELECT company_name, domain, sector, employee_band, is_hiring FROM companies")
def read_companies(t: Tables) -> DataFrame:
    path = scratch(t)
    tables.write_csv(t.companies(), path)
    return tables.read_companies(t.spark, path).select("company_name", "domain", "sector", "employee_band", "is_hiring")


@query("S4_read_raw_text", """
SELECT p_partkey::VARCHAR AS p_partkey, p_name, CASE WHEN p_size % 5 = 0 THEN NULL ELSE p_size::VARCHAR END AS size_text FROM part""")
def read_raw_text(t: Tables) -> DataFrame:
    path = scratch(t)
    marked = F.when(F.col("p_size") % 5 == 0, F.element_at(F.array(F.lit("NA"), F.lit("NULL"), F.lit("nan"), F.lit("")),
                                                           (F.col("p_partkey") % 4 + 1).cast("int"))).otherwise(F.col("p_size").cast("string"))
    tables.write_csv(t.table("part").select("p_partkey", "p_name", marked.alias("size_text")), path)
    return tables.read_raw(t.spark, path)


@query("S5_read_extras", """
SELECT o_orderkey::VARCHAR AS lead_id, CASE WHEN o_orderkey % 3 = 0 THEN 'NA' ELSE o_orderpriority END AS x_priority,
  CASE WHEN o_orderkey % 4 = 0 THEN NULL ELSE o_totalprice END AS x_price FROM orders""")
def read_extras(t: Tables) -> DataFrame:
    path, k = scratch(t), F.col("o_orderkey")
    tables.write_csv(t.table("orders").select(k.alias("lead_id"), F.when(k % 3 == 0, "NA").otherwise(F.col("o_orderpriority")).alias("priority"),
                                              F.when(k % 4 != 0, F.col("o_totalprice")).alias("price")), path)
    return tables.read_extras(t.spark, path, [extras.Extra("priority", "categorical"), extras.Extra("price", "numeric")])


@query("S6_dataset_dates", """
SELECT strftime(max(o_orderdate), '%Y-%m-%d') AS as_of, '1999-06-01' AS test_from, 'USD' AS currency, count(*) AS orders FROM orders""")
def dataset_dates(t: Tables) -> DataFrame:
    path = scratch(t)
    last = t.table("orders").agg(F.date_format(F.max("o_orderdate"), "yyyy-MM-dd").alias("as_of"))
    tables.write_table(last.select("as_of", F.lit("1999-06-01").alias("test_from"), F.lit("USD").alias("currency")), path)
    dates, currency = tables.dataset_dates(t.spark, t.spark.read.schema(schemas.DATASET_DATES).parquet(path))
    return t.table("orders").agg(F.count("*").alias("orders")).select(F.lit(dates.as_of).alias("as_of"), F.lit(dates.test_from).alias("test_from"),
                                                                     F.lit(currency).alias("currency"), "orders")


@query("S7_nested_rules", "SELECT lead_id, sq_tier, round(sq_value, 6) AS sq_value FROM benchmark_rows")
def nested_rules(t: Tables) -> DataFrame:
    import json
    path = scratch(t)
    t.spark.createDataFrame([(json.dumps(BENCHMARK_RULES),)], "value string").write.text(path)
    rules = tables.rules_from_row(tables.read_rules(t.spark, path))
    return scored(t).withColumns(value.benchmark_value(rules)).select("lead_id", "sq_tier", F.round("sq_value", 6).alias("sq_value"))


@query("S9_write_scores", f"""
SELECT lead_id, strftime(created_at, {FMT}) AS created_at, y, round(p, 8) AS p_formula, label_source FROM scored""")
def write_scores(t: Tables) -> DataFrame:
    path = scratch(t)
    df = scored(t).withColumnsRenamed({"p": "p_formula", "value": "value_formula"}).withColumns(
        {"value_at_submit": F.col("value_formula"), "matured_at": F.col("created_at")})
    tables.write_scores(df, path)
    return tables.read_scores(t.spark, path).select("lead_id", ts("created_at"), "y", F.round("p_formula", 8).alias("p_formula"), "label_source")


@query("S12_read_scores", "SELECT label_source, count(*) AS n, round(avg(p), 8) AS mean_p FROM scored GROUP BY 1")
def read_scores(t: Tables) -> DataFrame:
    path = scratch(t)
    tables.write_table(scored(t), path, ["lead_id", "label_source", "p"])
    return tables.read_scores(t.spark, path).groupBy("label_source").agg(F.count("*").alias("n"), F.round(F.avg("p"), 8).alias("mean_p"))


@query("S11_saved_parameters", "SELECT lead_id, round(p, 8) AS p, round(exp(log_value) * exp(0.125::DOUBLE), 4) AS deal_value_hat FROM scored")
def saved_parameters(t: Tables) -> DataFrame:
    from leadvane.functions.scores import linear_score, sigmoid
    path, rows = scratch(t), scored(t)
    transform = value.fit_transform(rows.where("is_train"), "value", value.ValueTransform())
    encoder = extras.fit_encoder(DECLARED[:1], written(rows.select("lead_id", "is_train").join(extras_table(t), "lead_id").where("is_train")))
    tables.save_model(t.spark, path, WEIGHTS, models.ValueModel(VALUE_WEIGHTS, 0.5, 100), transform, encoder)
    win, deal, loaded, frozen = tables.load_model(t.spark, path)
    if loaded != transform or frozen != encoder:
        raise ValueError("parameters changed on the way")
    return rows.select("lead_id", F.round(sigmoid(F.round(linear_score(win), 9)), 8).alias("p"),
                       F.round(F.exp(linear_score(deal.weights)) * deal.correction, 4).alias("deal_value_hat"))


# ---- projections to a schema ----
@query("P7_training_schema", """
SELECT o_orderkey AS lead_id, o_orderpriority AS email, CASE WHEN o_orderkey % 2 = 0 THEN o_orderkey::DOUBLE END AS time_on_page_s,
  o_orderkey % 3 = 0 AS viewed_pricing, CAST(NULL AS VARCHAR) AS company_name, '{}' AS answers FROM orders""")
def training_schema(t: Tables) -> DataFrame:
    k = F.col("o_orderkey")
    batch = t.table("orders").select(k.alias("lead_id"), F.col("o_orderpriority").alias("email"),
                                     F.when(k % 2 == 0, k.cast("string")).otherwise("n/a").alias("time_on_page_s"),
                                     F.when(k % 3 == 0, "True").otherwise("False").alias("viewed_pricing"))
    return training.as_training_schema(batch).select("lead_id", "email", "time_on_page_s", "viewed_pricing", "company_name", "answers")


# ---- conversion ----
MAPPING = SourceMapping(
    "retail", ("orders", "customer", "nation"), col("orders.ordered"), Outcome("stage", "orders.status", {"F": "Won", "P": "Lost", "O": "Qualified"}, lost_without_close="as_of"),
    "2002-06-01", joins={"customer": "custkey", "nation": "nationkey"}, row_order=("orderkey",),
    contacted_at=col("orders.contacted"), won_at=col("orders.closed"), close_at=col("orders.closed"), deal_value=apply("product", "orders.price", "orders.rate"),
    fields=(FieldMap("customer.name", "company_name"), FieldMap("nation.nname", "answers.country"), FieldMap("orders.title", "answers.job_title"),
            FieldMap("orders.mail", "email"), FieldMap("orders.priority", value_map={
                "1-URGENT": {"utm_source": "google", "utm_medium": "cpc"}, "2-HIGH": {"utm_source": "facebook"}, "3-MEDIUM": {"utm_source": "linkedin"},
                "4-NOT SPECIFIED": {}, "5-LOW": {"utm_medium": "lead_form"}}), FieldMap("orders.seen", "viewed_pricing")),
    features=(Feature("balance", "numeric", col("customer.balance")), Feature("segment", "categorical", col("customer.segment")),
              Feature("total", "numeric", apply("sum", "orders.price", "customer.balance"))))
ALLOWED = {"answers.company_size": LEVELS["band"][:5]}


def foreign_tables(t: Tables) -> dict[str, DataFrame]:
    """Orders, customers and nations as text tables of a foreign system."""
    k, d = F.col("o_orderkey"), F.col("o_orderdate")
    iso = "yyyy-MM-dd'T'HH:mm:ss'Z'"

    def plus(days):
        return F.date_format(d + F.make_dt_interval(days.cast("int")), iso)
    orders = t.table("orders").select(
        k.cast("string").alias("orderkey"), F.col("o_custkey").cast("string").alias("custkey"), (F.col("o_custkey") % 25).cast("string").alias("nationkey"),
        F.date_format(d, "yyyy-MM-dd").alias("ordered"), F.when(k % 4 != 0, plus(k * 37 % 150 - 3)).alias("contacted"),
        F.when(k % 5 != 0, plus(k * 53 % 240)).otherwise(F.when(F.col("o_orderstatus") == "F", plus(k % 30))).alias("closed"),
        F.col("o_orderstatus").alias("status"), F.when(k % 12 != 0, F.col("o_totalprice").cast("string")).alias("price"),
        F.when(k % 30 == 1, "-1").otherwise("1").alias("rate"), F.concat(F.lit("  t"), k % 5, F.lit(" ")).alias("title"),
        F.when(k % 3 == 0, F.concat(F.lit("m"), k, F.lit("@x.example"))).alias("mail"), F.col("o_orderpriority").alias("priority"),
        F.when(k % 2 == 0, "TRUE").otherwise("false").alias("seen"))
    customer = t.table("customer").select(F.col("c_custkey").cast("string").alias("custkey"), F.col("c_name").alias("name"),
                                          F.col("c_acctbal").cast("string").alias("balance"), F.col("c_mktsegment").alias("segment"))
    nation = t.table("nation").select(F.col("n_nationkey").cast("string").alias("nationkey"), F.col("n_name").alias("nname"))
    return {"orders": orders, "customer": customer, "nation": nation}


def converted(t: Tables) -> dict[str, DataFrame]:
    return conversion.convert(foreign_tables(t), MAPPING, ALLOWED)


view("foreign_base", """
SELECT o_orderkey AS k, o_custkey, o_orderdate AS created, o_orderpriority AS priority, o_totalprice AS price, o_orderstatus AS st,
  CASE o_orderstatus WHEN 'F' THEN 'Won' WHEN 'P' THEN 'Lost' ELSE 'Qualified' END AS stage,
  CASE WHEN o_orderkey % 4 <> 0 THEN o_orderdate + to_days((o_orderkey * 37 % 150 - 3)::INT) END AS contacted,
  CASE WHEN o_orderkey % 5 <> 0 THEN o_orderdate + to_days((o_orderkey * 53 % 240)::INT) WHEN o_orderstatus = 'F' THEN o_orderdate + to_days((o_orderkey % 30)::INT) END AS closed,
  CASE WHEN o_orderkey % 12 <> 0 THEN o_totalprice * CASE WHEN o_orderkey % 30 = 1 THEN -1 ELSE 1 END END AS raw_value,
  'retail-' || lpad(row_number() OVER (ORDER BY o_orderkey)::VARCHAR, 6, '0') AS lead_id FROM orders""")
view("foreign_events", """
SELECT *, CASE WHEN contacted IS NOT NULL THEN greatest(contacted, created + INTERVAL 1 SECOND) END AS contact_at,
  CASE stage WHEN 'Won' THEN closed WHEN 'Lost' THEN coalesce(closed, TIMESTAMP '2002-06-01') ELSE coalesce(contacted, created) END AS final_raw FROM foreign_base""")
view("foreign_final", """
SELECT *, greatest(final_raw, coalesce(contact_at, created) + INTERVAL 1 SECOND) AS final_at,
  CASE WHEN stage = 'Won' AND raw_value > 0 THEN raw_value END AS deal_value FROM foreign_events""")


@query("J4_join_sources", """
SELECT o_orderkey::VARCHAR AS orderkey, c_name AS name, n_name AS nname FROM orders LEFT JOIN customer ON c_custkey = o_custkey
LEFT JOIN nation ON n_nationkey = o_custkey % 25""")
def join_sources(t: Tables) -> DataFrame:
    raw = conversion.join_sources(foreign_tables(t), MAPPING)
    return raw.select(F.col("`orders.orderkey`").alias("orderkey"), F.col("`customer.name`").alias("name"), F.col("`nation.nname`").alias("nname"))


@query("J4_repeated_join_keys", "SELECT l_orderkey::VARCHAR AS key, count(*) AS n FROM lineitem GROUP BY 1 HAVING count(*) > 1")
def repeated_join_keys(t: Tables) -> DataFrame:
    return quality.repeated_keys(t.table("lineitem"), "l_orderkey")


@query("C1_compiled_expressions", """
SELECT o_orderkey::VARCHAR AS orderkey, CASE WHEN o_orderkey % 12 <> 0 THEN round(o_totalprice * CASE WHEN o_orderkey % 30 = 1 THEN -1 ELSE 1 END, 4) END AS product,
  CASE WHEN o_orderkey % 12 <> 0 THEN round(o_totalprice + c_acctbal, 4) END AS total, strftime(o_orderdate - to_days((o_custkey % 25)::INT), '%Y-%m-%d') AS moved
FROM orders JOIN customer ON c_custkey = o_custkey""")
def compiled_expressions(t: Tables) -> DataFrame:
    raw = conversion.join_sources(foreign_tables(t), MAPPING)
    moved = apply("minus_days", "orders.ordered", "orders.nationkey").column()
    return raw.select(F.col("`orders.orderkey`").alias("orderkey"), F.round(MAPPING.deal_value.column(), 4).alias("product"),
                      F.round(MAPPING.features[2].expr.column(), 4).alias("total"), F.date_format(moved, "yyyy-MM-dd").alias("moved"))


@query("C2_final_stage", "SELECT o_orderkey::VARCHAR AS orderkey, stage, won_flag, presence FROM (SELECT o_orderkey, CASE o_orderstatus WHEN 'F' THEN 'Won' WHEN 'P' THEN 'Lost' ELSE 'Qualified' END AS stage, "
       "CASE o_orderstatus WHEN 'F' THEN 'Won' WHEN 'P' THEN 'Lost' END AS won_flag, CASE WHEN o_orderkey % 4 <> 0 THEN 'Won' ELSE 'Lost' END AS presence FROM orders)")
def final_stage(t: Tables) -> DataFrame:
    raw = conversion.join_sources(foreign_tables(t), MAPPING)
    flag = Outcome("won_flag", "orders.status", won_values=("F",), lost_values=("P",))
    return raw.select(F.col("`orders.orderkey`").alias("orderkey"), MAPPING.outcome.stage().alias("stage"), flag.stage().alias("won_flag"),
                      Outcome("presence", "orders.contacted").stage().alias("presence"))


_SOURCE = "CASE priority WHEN '1-URGENT' THEN 'google' WHEN '2-HIGH' THEN 'facebook' WHEN '3-MEDIUM' THEN 'linkedin' END"
_MEDIUM = "CASE priority WHEN '1-URGENT' THEN 'cpc' WHEN '5-LOW' THEN 'lead_form' END"


@query("C3_mapped_fields", f"""
SELECT lead_id, c_name AS company_name, {_SOURCE} AS utm_source, {_MEDIUM} AS utm_medium, k % 2 = 0 AS viewed_pricing FROM foreign_base JOIN customer ON c_custkey = o_custkey""")
def mapped_fields(t: Tables) -> DataFrame:
    return converted(t)["leads"].select("lead_id", "company_name", "utm_source", "utm_medium", "viewed_pricing")


@query("C5_numbered_lead_ids", "SELECT lead_id, strftime(created, '%Y-%m-%d') AS created FROM foreign_base")
def numbered_lead_ids(t: Tables) -> DataFrame:
    return converted(t)["leads"].select("lead_id", F.date_format("created_at", "yyyy-MM-dd").alias("created"))


@query("C6_default_email_and_form", """
SELECT lead_id, CASE WHEN k % 3 = 0 THEN 'm' || k || '@x.example' ELSE lead_id || '@unmapped.invalid' END AS email, 'A' AS form_variant FROM foreign_base""")
def default_email_and_form(t: Tables) -> DataFrame:
    return converted(t)["leads"].select("lead_id", "email", "form_variant")


@query("C7_synthesised_events", f"""
SELECT lead_id, stage, deal_value, strftime(changed_at, {FMT}) AS changed_at FROM (
  SELECT lead_id, 'New' AS stage, NULL::DOUBLE AS deal_value, created AS changed_at FROM foreign_final
  UNION ALL SELECT lead_id, 'Contacted', NULL, contact_at FROM foreign_final WHERE contact_at IS NOT NULL
  UNION ALL SELECT lead_id, stage, deal_value, final_at FROM foreign_final)""")
def synthesised_events(t: Tables) -> DataFrame:
    return converted(t)["crm"].select("lead_id", "stage", "deal_value", ts("changed_at"))


@query("C8_refused_events", """
SELECT check_id, "column", lead_id AS key FROM (
  SELECT 'event_after_as_of' AS check_id, 'created_at' AS "column", lead_id FROM foreign_final WHERE created > TIMESTAMP '2000-01-01'
  UNION ALL SELECT 'event_after_as_of', 'contacted_at', lead_id FROM foreign_final WHERE contacted > TIMESTAMP '2000-01-01'
  UNION ALL SELECT 'event_after_as_of', 'final_at', lead_id FROM (SELECT *, CASE stage WHEN 'Lost' THEN coalesce(closed, TIMESTAMP '2000-01-01') ELSE final_raw END AS f FROM foreign_final) WHERE f > TIMESTAMP '2000-01-01'
  UNION ALL SELECT 'unlisted_value', 'orders.priority', lead_id FROM foreign_base WHERE priority = '4-NOT SPECIFIED')""")
def refused_events(t: Tables) -> DataFrame:
    from dataclasses import replace
    fields = tuple(replace(f, value_map={k: v for k, v in f.value_map.items() if k != "4-NOT SPECIFIED"}) if f.value_map else f for f in MAPPING.fields)
    strict = replace(MAPPING, as_of="2000-01-01", fields=fields)
    return conversion.convert(foreign_tables(t), strict, ALLOWED)["violations"].select("check_id", "column", "key")


@query("C4_target_checks", """
SELECT 'not_a_number' AS check_id, count(*) AS n FROM lineitem WHERE l_returnflag = 'R'
UNION ALL SELECT 'not_whole', count(*) FROM lineitem WHERE l_returnflag <> 'R' AND l_linestatus = 'O'
UNION ALL SELECT 'hour_out_of_range', count(*) FROM lineitem WHERE l_returnflag <> 'R' AND NOT (l_quantity + CASE WHEN l_linestatus = 'O' THEN 0.5 ELSE 0 END BETWEEN 0 AND 23)
UNION ALL SELECT 'not_boolean', count(*) FROM lineitem WHERE l_linestatus = 'F'
UNION ALL SELECT 'not_a_form_option', count(*) FROM lineitem WHERE l_returnflag <> 'A'""")
def target_checks(t: Tables) -> DataFrame:
    hour = F.when(F.col("l_returnflag") == "R", "x").otherwise((F.col("l_quantity") + F.when(F.col("l_linestatus") == "O", 0.5).otherwise(0.0)).cast("string"))
    flag = F.when(F.col("l_linestatus") == "F", "maybe").otherwise("TRUE")
    checks = conversion.target_checks({"local_submit_hour": hour, "viewed_pricing": flag, "form_variant": F.col("l_returnflag")}, {"form_variant": ("A",)})
    bad = quality.row_violations(t.table("lineitem").withColumn("id", F.concat_ws("-", "l_orderkey", "l_linenumber", "l_partkey")), "id", checks)
    return bad.groupBy("check_id").agg(F.count("*").alias("n"))


@query("C9_deal_values", """
SELECT count(*) FILTER (WHERE deal_value IS NOT NULL) AS with_value, count(*) FILTER (WHERE stage = 'Won' AND raw_value <= 0) AS non_positive,
  count(*) FILTER (WHERE stage = 'Won' AND raw_value IS NULL) AS missing, round(sum(deal_value), 2) AS total FROM foreign_final""")
def deal_values(t: Tables) -> DataFrame:
    parts = converted(t)
    won = parts["crm"].agg(F.count("deal_value").alias("with_value"), F.round(F.sum("deal_value"), 2).alias("total"))
    counts = parts["counts"].select(F.col("non_positive_deal_values_blanked").alias("non_positive"), F.col("won_deal_values_missing").alias("missing"))
    one = F.lit(1).alias("one")
    return won.select("*", one).join(counts.select("*", one), "one").drop("one")


@query("C10_answers_json", "SELECT lead_id, n_name AS country, 't' || (k % 5) AS job_title FROM foreign_base JOIN nation ON n_nationkey = o_custkey % 25")
def answers_json(t: Tables) -> DataFrame:
    m = F.from_json("answers", "map<string,string>")
    return converted(t)["leads"].select("lead_id", F.try_element_at(m, F.lit("country")).alias("country"), F.try_element_at(m, F.lit("job_title")).alias("job_title"))


@query("C11_extra_values", """
SELECT lead_id, c_acctbal AS balance, c_mktsegment AS segment, CASE WHEN k % 12 <> 0 THEN round(price + c_acctbal, 4) END AS total FROM foreign_base JOIN customer ON c_custkey = o_custkey""")
def extra_values(t: Tables) -> DataFrame:
    return converted(t)["extras"].withColumn("total", F.round("total", 4))


@query("C13_derived_counts", """
SELECT count(*) AS leads, 0::BIGINT AS rows_dropped_without_created_at, count(*) FILTER (WHERE k % 3 <> 0) AS placeholder_emails, count(*) FILTER (WHERE stage = 'Lost' AND closed IS NULL) AS lost_dated_at_as_of,
  count(*) FILTER (WHERE stage = 'Won' AND raw_value <= 0) AS non_positive_deal_values_blanked, count(*) FILTER (WHERE stage = 'Won' AND raw_value IS NULL) AS won_deal_values_missing,
  (count(*) FILTER (WHERE contacted = created) + count(*) FILTER (WHERE final_raw = coalesce(contacted, created)))::BIGINT AS crm_ties_separated,
  (count(*) FILTER (WHERE contacted < created) + count(*) FILTER (WHERE final_raw < coalesce(contacted, created)))::BIGINT AS crm_times_reordered FROM foreign_final""")
def derived_counts(t: Tables) -> DataFrame:
    return converted(t)["counts"].withColumn("rows_dropped_without_created_at", F.col("rows_dropped_without_created_at").cast("bigint"))


@query("Q13_fill_gaps", """
SELECT source, round(w, 4) AS won_filled, round(l, 4) AS lost_filled, abs(w - l) >= 0.5 AS flagged FROM (
  SELECT 'orders.mail' AS source, avg((k % 3 = 0)::INT) FILTER (WHERE stage = 'Won') AS w, avg((k % 3 = 0)::INT) FILTER (WHERE stage = 'Lost') AS l FROM foreign_base
  UNION ALL SELECT 'feature:total', avg((k % 12 <> 0)::INT) FILTER (WHERE stage = 'Won'), avg((k % 12 <> 0)::INT) FILTER (WHERE stage = 'Lost') FROM foreign_base
  UNION ALL SELECT 'orders.priority', 1, 1)""")
def fill_gaps(t: Tables) -> DataFrame:
    return converted(t)["fill_gaps"].where(F.col("source").isin("orders.mail", "feature:total", "orders.priority")).drop("target")


@query("Q13_fill_gaps_all")
def fill_gaps_all(t: Tables) -> DataFrame:
    """The gap of every mapped source."""
    return converted(t)["fill_gaps"]


@query("C14_new_leads", f"""
SELECT 'new-' || substr(lead_id, 8) AS lead_id, {_SOURCE} AS utm_source, c_acctbal AS x_balance FROM foreign_base JOIN customer ON c_custkey = o_custkey WHERE priority <> '5-LOW'""")
def new_leads(t: Tables) -> DataFrame:
    leads, _ = _new(t)
    return leads.select("lead_id", "utm_source", "x_balance")


def _new(t: Tables) -> tuple[DataFrame, DataFrame]:
    from dataclasses import replace
    fields = tuple(replace(f, value_map={k: v for k, v in f.value_map.items() if k != "5-LOW"}) if f.value_map else f for f in MAPPING.fields)
    return conversion.convert_new_leads(foreign_tables(t), replace(MAPPING, fields=fields))


@query("C14_refused_new_leads", """
SELECT 'unlisted_value' AS check_id, 'new-' || substr(lead_id, 8) AS key, priority AS message FROM foreign_base WHERE priority = '5-LOW'""")
def refused_new_leads(t: Tables) -> DataFrame:
    return _new(t)[1].select("check_id", "key", "message")


@query("P10_submit_time_columns", """
SELECT source, "column", (SELECT count(*) FROM orders) AS n_rows FROM (VALUES ('orders','ordered'),('orders','custkey'),('orders','nationkey'),('orders','title'),('orders','mail'),
  ('orders','priority'),('orders','seen'),('orders','price'),('customer','custkey'),('customer','name'),('customer','balance'),('customer','segment'),('nation','nationkey'),('nation','nname')) v(source, "column")""")
def submit_time_columns(t: Tables) -> DataFrame:
    pairs = [F.struct(F.lit(s).alias("source"), F.lit(c).alias("column")) for s, cols in MAPPING.submit_time_columns().items() for c in cols]
    return t.table("orders").agg(F.count("*").alias("n_rows")).select(F.explode(F.array(*pairs)).alias("p"), "n_rows").select("p.*", "n_rows")


@query("C12_design_coverage", """
SELECT "column", leads_with_1, leads, CASE WHEN leads_with_1 > 0 AND leads_with_1 < leads THEN 'data' WHEN has THEN 'constant' ELSE 'unfilled' END AS status FROM (""" + " UNION ALL ".join(
    f"SELECT '{c}' AS \"column\", count(*) FILTER (WHERE f_{c.split('=', 1)[0]} = '{c.split('=', 1)[1]}') AS leads_with_1, count(*) AS leads, "
    f"{str(c.split('=', 1)[0] in ('channel', 'email')).lower()} AS has FROM features_v2" for c in COLUMNS) + ")")
def design_coverage(t: Tables) -> DataFrame:
    out = conversion.coverage(scored(t), ["utm_source", "email"], {"channel": ("utm_source", "utm_medium"), "email": ("email",), "text": ("answers.what_to_solve",)})
    return out.drop("feature")


@query("C15_default_dates", """
SELECT strftime(greatest(max(o_orderdate), max(last)) + INTERVAL 1 DAY, '%Y-%m-%d') AS as_of,
  strftime(date_trunc('month', make_timestamp((epoch_us(min(o_orderdate)) + (epoch_us(max(o_orderdate)) - epoch_us(min(o_orderdate))) * 0.8::DOUBLE)::BIGINT)), '%Y-%m-%d') AS test_from
FROM orders, (SELECT max(l_shipdate) AS last FROM lineitem)""")
def default_dates(t: Tables) -> DataFrame:
    ship = t.table("lineitem").groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(F.max("l_shipdate").alias("shipped"))
    return conversion.default_dates(t.table("orders").join(ship, "o_orderkey", "left"), "o_orderdate", ["shipped"], 0.8)


@query("S10_written_conversion", "SELECT 'leads' AS part, count(*) AS n FROM orders UNION ALL SELECT 'crm', count(*) FROM (SELECT 1 FROM foreign_final UNION ALL SELECT 1 FROM foreign_final WHERE contact_at IS NOT NULL UNION ALL SELECT 1 FROM foreign_final) "
       "UNION ALL SELECT 'companies', 0 UNION ALL SELECT 'people', 0 UNION ALL SELECT 'settings', 1")
def written_conversion(t: Tables) -> DataFrame:
    path, parts = scratch(t), converted(t)
    tables.write_conversion({k: parts[k] for k in ("leads", "crm")}, path, {"as_of": MAPPING.as_of, "test_from": "2000-01-01", "currency": "USD"})
    counts = [t.spark.read.parquet(f"{path}/{p}").agg(F.count("*").alias("n")).select(F.lit(p).alias("part"), "n") for p in ("leads", "crm", "companies", "people", "settings")]
    out = counts[0]
    for c in counts[1:]:
        out = out.unionByName(c)
    return out


# ---- quality ----
def dirty_leads(t: Tables) -> DataFrame:
    """Leads as text with planted defects at fixed key remainders."""
    k = F.col("lead_id")
    df = t.leads().select("lead_id", *[F.col(c).cast("string").alias(c) for c in ("time_on_page_s", "hesitation_ms", "viewed_pricing", "form_variant", "submitted_weekday",
                                                                                  "local_submit_hour", "answers", "email")],
                          F.date_format("created_at", "yyyy-MM-dd'T'HH:mm:ss'Z'").alias("created_at"))
    return df.withColumns({
        "created_at": F.when(k % 101 == 0, "  ").when(k % 103 == 0, "31/12/2000").otherwise(F.col("created_at")),
        "time_on_page_s": F.when(k % 107 == 0, "fast").when(k % 109 == 0, "1e400").otherwise(F.col("time_on_page_s")),
        "viewed_pricing": F.when(k % 113 == 0, "maybe").otherwise(F.col("viewed_pricing")),
        "form_variant": F.when(k % 127 == 0, "Z").otherwise(F.col("form_variant")),
        "local_submit_hour": F.when(k % 131 == 0, "24").otherwise(F.col("local_submit_hour")),
        "answers": F.when(k % 137 == 0, "[1]").when(k % 139 == 0, "not json").when(
            k % 149 == 0, '{"budget": "£1m", "company_size": "", "timeline": "This month", "other": "x"}').otherwise(F.col("answers"))})


def _dirty_checks() -> list[quality.Check]:
    return [*quality.date_checks("created_at"), quality.number_check("time_on_page_s"), quality.number_check("hesitation_ms"), quality.boolean_check("viewed_pricing"),
            quality.level_check("form_variant", LEVELS["form_variant"]), quality.level_check("submitted_weekday", WEEKDAYS), quality.hour_check("local_submit_hour"),
            quality.json_object_check("answers"), *quality.answer_checks("answers")]


def _defects(name: str, sql: str, check_ids: tuple[str, ...]):
    @query(name, sql)
    def run(t: Tables) -> DataFrame:
        return quality.row_violations(dirty_leads(t), "lead_id", _dirty_checks()).where(F.col("check_id").isin(*check_ids)).select("check_id", "key")
    return run


_K = "SELECT '{}' AS check_id, o_orderkey::VARCHAR AS key FROM orders WHERE {}"
_defects("Q3_bad_dates", _K.format("blank_date", "o_orderkey % 101 = 0") + " UNION ALL " + _K.format("bad_date", "o_orderkey % 103 = 0 AND o_orderkey % 101 <> 0"), ("blank_date", "bad_date"))
_defects("Q4_bad_numbers", _K.format("bad_number", "o_orderkey % 107 = 0 OR o_orderkey % 109 = 0"), ("bad_number",))
_defects("Q5_bad_levels", _K.format("unknown_level", "o_orderkey % 127 = 0") + " UNION ALL " + _K.format("bad_boolean", "o_orderkey % 113 = 0") + " UNION ALL "
         + _K.format("bad_hour", "o_orderkey % 131 = 0"), ("unknown_level", "bad_boolean", "bad_hour"))
_defects("Q6_bad_answers", _K.format("bad_json", "o_orderkey % 137 = 0 OR o_orderkey % 139 = 0") + " UNION ALL "
         + _K.format("unlisted_answer", "o_orderkey % 149 = 0 AND o_orderkey % 137 <> 0 AND o_orderkey % 139 <> 0"), ("bad_json", "unlisted_answer"))


@query("Q1_required_columns", "SELECT unnest(['company_domain','ip_country']) AS missing_column, (SELECT count(*) FROM orders) AS n_rows")
def required_columns(t: Tables) -> DataFrame:
    df = t.leads().drop("company_domain", "ip_country")
    gone = quality.missing_columns(df, schemas.REQUIRED_LEAD_COLUMNS)
    return df.agg(F.count("*").alias("n_rows")).select(F.explode(F.array(*[F.lit(c) for c in gone])).alias("missing_column"), "n_rows")


@query("Q2_repeated_keys", "SELECT email_l AS key, count(*) AS n FROM flagged WHERE email_l IS NOT NULL GROUP BY 1 HAVING count(*) > 1")
def repeated_keys(t: Tables) -> DataFrame:
    return quality.repeated_keys(t.leads(), "email", lower=True)


@query("Q7_crm_problems", """
SELECT 'unknown_stage' AS check_id, count(*) AS n FROM events WHERE event_type = 'view'
UNION ALL SELECT 'win_without_value', count(*) FROM events WHERE event_type = 'purchase' AND event_id % 3 = 0""")
def crm_problems(t: Tables) -> DataFrame:
    stage = (F.when(F.col("event_type") == "view", "viewed").when(F.col("event_type") == "purchase", "Closed WON").when(F.col("event_type") == "error", "lost").otherwise("new"))
    rows = t.table("events").select("event_id", stage.alias("stage"), F.when(F.col("event_id") % 3 != 0, F.col("value")).alias("deal_value"))
    canonical = crm.canonical_stage(F.col("stage"))
    checks = [("unknown_stage", "stage", canonical.isNull(), F.col("stage")), ("win_without_value", "deal_value", (canonical == "Won") & F.col("deal_value").isNull(), F.col("stage"))]
    return quality.row_violations(rows, "event_id", checks).groupBy("check_id").agg(F.count("*").alias("n"))


@query("Q8_rows_after_snapshot", f"SELECT count(*) AS n FROM leads WHERE created_at > {T_AS_OF}")
def rows_after_snapshot(t: Tables) -> DataFrame:
    return t.leads().where(F.col("created_at") > F.lit(ORDERS_DATES.as_of).cast("timestamp")).agg(F.count("*").alias("n"))


@query("Q10_minimum_rows", "SELECT label_source, count(*) AS n, count(*) >= 200 AS enough FROM scored GROUP BY 1")
def minimum_rows(t: Tables) -> DataFrame:
    quality.require_rows(scored(t), 200, "leads")
    return scored(t).groupBy("label_source").agg(F.count("*").alias("n")).withColumn("enough", F.col("n") >= 200)


@query("Q11_preview_summary", """
SELECT final_stage, count(*) AS leads, strftime(min(created_at), '%Y-%m-%d') AS first, strftime(max(created_at), '%Y-%m-%d') AS last FROM leads LEFT JOIN outcomes USING (lead_id) GROUP BY 1""")
def preview_summary(t: Tables) -> DataFrame:
    return crm.add_crm_outcomes(t.leads(), t.crm()).groupBy("final_stage").agg(
        F.count("*").alias("leads"), F.date_format(F.min("created_at"), "yyyy-MM-dd").alias("first"), F.date_format(F.max("created_at"), "yyyy-MM-dd").alias("last"))


@query("Q12_rules_consistency", "SELECT form_variant, count(*) AS leads FROM leads WHERE form_variant NOT IN ('A','B') GROUP BY 1")
def rules_consistency(t: Tables) -> DataFrame:
    """Form variants that the rules give no base value: every variant is compared, as a join with the rules' own table."""
    based = t.spark.createDataFrame([("A",), ("B",)], "form_variant string")
    leads = t.leads().where(F.col("form_variant").isNotNull())
    return leads.groupBy("form_variant").agg(F.count("*").alias("leads")).join(F.broadcast(based), "form_variant", "left_anti")


def profiled(t: Tables) -> DataFrame:
    return t.table("orders").select("o_orderkey", "o_orderstatus", "o_orderpriority", F.when(F.col("o_orderkey") % 10 != 0, F.col("o_totalprice").cast("string")).alias("o_totalprice"),
                                    F.date_format("o_orderdate", "yyyy-MM-dd").alias("ordered"), F.when(F.col("o_orderkey") % 2 == 0, "Yes").otherwise("no").alias("flag"),
                                    F.lit(" ").alias("empty"))


def _profile_sql(c: str, kind: str, expr: str) -> str:
    num = f"min({expr})::DOUBLE, max({expr})::DOUBLE" if kind == "number" else "NULL::DOUBLE, NULL::DOUBLE"
    day = "strftime(min(o_orderdate), '%Y-%m-%d'), strftime(max(o_orderdate), '%Y-%m-%d')" if kind == "date" else "NULL, NULL"
    return f"SELECT '{c}', '{kind}', round(1 - count({expr}) / count(*), 4), count(DISTINCT {expr}), {num}, {day} FROM orders"


@query("Q14_column_profile", 'SELECT * FROM (' + " UNION ALL ".join([
    _profile_sql("o_orderkey", "number", "o_orderkey"), _profile_sql("o_orderstatus", "text", "o_orderstatus"), _profile_sql("o_orderpriority", "text", "o_orderpriority"),
    _profile_sql("o_totalprice", "number", "CASE WHEN o_orderkey % 10 <> 0 THEN o_totalprice END"), _profile_sql("ordered", "date", "o_orderdate"),
    _profile_sql("flag", "bool", "o_orderkey % 2"), _profile_sql("empty", "empty", "CAST(NULL AS VARCHAR)")])
    + ') t("column", type, share_missing, "distinct", min_number, max_number, min_date, max_date)')
def column_profile(t: Tables) -> DataFrame:
    return profiling.profile_table(profiled(t))


@query("Q14_top_values", """
SELECT "column", value, n FROM (
  SELECT 'o_orderstatus' AS "column", o_orderstatus AS value, count(*) AS n FROM orders GROUP BY 2 UNION ALL SELECT 'o_orderpriority', o_orderpriority, count(*) FROM orders GROUP BY 2
  UNION ALL SELECT 'flag', CASE WHEN o_orderkey % 2 = 0 THEN 'Yes' ELSE 'no' END, count(*) FROM orders GROUP BY 2)""")
def top_values(t: Tables) -> DataFrame:
    return profiling.top_values(profiled(t)).select("column", "value", "n")


@query("Q15_name_like_columns", """
SELECT 'person' AS "column", 5::BIGINT AS "distinct", 5::BIGINT AS names, true AS looks_like_names, (SELECT count(*) FROM orders) AS n_rows
UNION ALL SELECT 'hotel', 5, 5, false, (SELECT count(*) FROM orders)""")
def name_like_columns(t: Tables) -> DataFrame:
    first = F.element_at(F.split(F.lower("o_orderpriority"), "[- ]"), 2)
    df = t.table("orders").select(F.concat(F.lit("Cara "), F.initcap(first)).alias("person"), F.concat(F.initcap(first), F.lit(" Hotel")).alias("hotel"))
    n = t.table("orders").agg(F.count("*")).scalar()
    return profiling.name_like_columns(df).withColumn("n_rows", n)


@query("Q15_safe_examples")
def safe_examples(t: Tables) -> DataFrame:
    df = t.leads().select("utm_source", F.concat(F.lit("Call +44 20 7946 "), F.lpad(F.col("lead_id") % 7, 4, "0")).alias("note"), F.concat(F.lit("Ann "), F.col("form_variant")).alias("account_owner"))
    return profiling.safe_examples(df)


@query("Q17_consent_consistency", """
SELECT count(*) AS n_rows, count(*) FILTER (WHERE NOT consent) AS declined, round(avg((NOT consent)::INT), 6) AS share,
  count(*) FILTER (WHERE NOT consent AND time_on_page_s IS NULL) AS declined_blank, count(*) FILTER (WHERE consent AND time_on_page_s IS NULL) AS blank_otherwise FROM leads WHERE utm_medium <> 'lead_form'""")
def consent_consistency(t: Tables) -> DataFrame:
    blank = F.col("time_on_page_s").isNull()
    return t.leads().where("utm_medium <> 'lead_form'").agg(
        F.count("*").alias("n_rows"), F.count_if(~F.col("consent")).alias("declined"), F.round(F.avg((~F.col("consent")).cast("double")), 6).alias("share"),
        F.count_if(~F.col("consent") & blank).alias("declined_blank"), F.count_if(F.col("consent") & blank).alias("blank_otherwise"))


@query("F16_redacted_texts")
def redacted_texts(t: Tables) -> DataFrame:
    return texts(t).select("id", text.redact(F.col("text")).alias("text"))


# ---- streaming ----
def stream_slices(t: Tables, df: DataFrame, start: Callable[[DataFrame, str], None], moment: str | None = None, slices: int = 4) -> str:
    """Lets a stream take up ``df`` in slices in the order of ``moment`` (or of a hash) and returns the root folder.

    The rows are written once by all tasks, in a folder for each slice. Slice by slice, its files are moved into the folder that the
    stream reads, and ``start(stream, root)`` runs to their end, with one checkpoint: each slice is one batch of many tasks.
    """
    root = scratch(t)
    if moment is None:
        place = F.pmod(F.xxhash64(*df.columns), F.lit(slices)).cast("int")
    else:
        at = F.unix_micros(moment)
        cuts = df.agg(F.percentile_approx(at, [i / slices for i in range(1, slices)])).first()[0] or []
        place = sum(((at >= c).cast("int") for c in cuts), F.lit(0))
    df.withColumn("_slice", place).where("_slice is not null").write.partitionBy("_slice").parquet(f"{root}/all")
    t.spark.createDataFrame([], df.schema).write.parquet(f"{root}/in")  # a stream without rows has a batch too
    for i in range(slices):
        if move_files(t.spark, f"{root}/all/_slice={i}", f"{root}/in", f"{i}-") or i == 0:
            start(jobs.file_stream(t.spark, f"{root}/in", df.schema, None), root)
    return root


@query("R1_streamed_scores", "SELECT lead_id, round(p, 8) AS p FROM scored")
def streamed_scores(t: Tables) -> DataFrame:
    """Raw leads as they arrive: enrichment, features and the frozen score all run inside the stream."""
    rows, companies = cleaning.clean(t.leads()), t.companies()

    def score(leads: DataFrame) -> DataFrame:
        ready = features.v2_features(enrichment.enrich(leads, companies))
        return ready.select("lead_id", F.round(sigmoid(F.round(linear_score(WEIGHTS), 9)), 8).alias("p"))

    def start(stream: DataFrame, root: str) -> None:
        jobs.run_to_end(jobs.score_stream(stream, score), jobs.parquet_sink(f"{root}/out"), f"{root}/checkpoint")
    root = stream_slices(t, rows, start)
    return t.spark.read.schema("lead_id bigint, p double").parquet(f"{root}/out").select("lead_id", "p")


#: How long a repeated submission is recognised; state older than that is dropped.
REPEAT_WINDOW = "4000 days"


@query("R2_streamed_first_submissions", "SELECT DISTINCT email_l FROM flagged WHERE email_l IS NOT NULL")
def streamed_first_submissions(t: Tables) -> DataFrame:
    rows = t.leads().select("lead_id", "created_at", text.normalised_email(F.col("email")).alias("email_l")).where("email_l is not null")

    def start(stream: DataFrame, root: str) -> None:
        out = jobs.first_submissions(stream, "email_l", "created_at", REPEAT_WINDOW)
        jobs.run_to_end(out, jobs.parquet_sink(f"{root}/out"), f"{root}/checkpoint")
    root = stream_slices(t, rows, start, "created_at")
    return t.spark.read.schema("email_l string").parquet(f"{root}/out").select("email_l")


view("event_staged", f"""
SELECT lead_id, event_type, ts, value FROM (SELECT *, last_value(CASE WHEN event_type = 'signup' THEN event_id END IGNORE NULLS)
  OVER (PARTITION BY user_id ORDER BY ts, event_id) AS lead_id FROM events) WHERE lead_id IS NOT NULL AND ts <= TIMESTAMP '{EVENTS_AS_OF}'""")


view("event_outcomes", """
SELECT lead_id, min(CASE WHEN event_type = 'signup' THEN ts END) AS created, min(CASE WHEN event_type = 'purchase' THEN ts END) AS won,
  arg_min(CASE WHEN event_type = 'purchase' THEN value END, CASE WHEN event_type = 'purchase' THEN ts END) AS value
FROM (SELECT *, last_value(CASE WHEN event_type = 'signup' THEN event_id END IGNORE NULLS) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS lead_id FROM events)
WHERE lead_id IS NOT NULL GROUP BY lead_id""")


@query("R3_streamed_close_events", """
SELECT lead_id, 'won' AS stage, value, strftime(won, '%Y-%m-%d %H:%M:%S') AS at FROM event_outcomes WHERE won IS NOT NULL
UNION ALL SELECT lead_id, 'matured', 0, strftime(created + INTERVAL 1 DAY, '%Y-%m-%d %H:%M:%S') FROM event_outcomes
WHERE (won IS NULL AND created + INTERVAL 1 DAY < (SELECT max(ts) - INTERVAL 1 DAY FROM events)) OR won > created + INTERVAL 1 DAY""")
def streamed_close_events(t: Tables) -> DataFrame:
    """Wins and matured leads of every event, in four batches by time; leads of the last two days have not matured."""
    rows = t.event_stages().select("lead_id", "stage", "deal_value", "changed_at")

    def start(stream: DataFrame, root: str) -> None:
        jobs.run_to_end(jobs.close_events(stream, 1.0, "1 day"), jobs.parquet_sink(f"{root}/out"), f"{root}/checkpoint")
    root = stream_slices(t, rows, start, "changed_at")
    out = t.spark.read.schema(jobs.CLOSE_OUTPUT).parquet(f"{root}/out")
    return out.select("lead_id", "stage", "value", F.date_format("at", "yyyy-MM-dd HH:mm:ss").alias("at"))


@query("R3_streamed_wins", f"""
SELECT lead_id, value FROM (SELECT lead_id, value, row_number() OVER (PARTITION BY lead_id ORDER BY ts) AS rn FROM event_staged WHERE event_type = 'purchase') WHERE rn = 1""")
def streamed_wins(t: Tables) -> DataFrame:
    """The first win of each lead up to a date."""
    rows = t.event_stages().where(F.col("changed_at") <= F.lit(EVENTS_AS_OF).cast("timestamp")).select("lead_id", "stage", "deal_value", "changed_at")

    def start(stream: DataFrame, root: str) -> None:
        jobs.run_to_end(jobs.close_events(stream, 1.0, "1 day", keep_days=4000.0), jobs.parquet_sink(f"{root}/out"), f"{root}/checkpoint")
    root = stream_slices(t, rows, start, "changed_at")
    return t.spark.read.schema(jobs.CLOSE_OUTPUT).parquet(f"{root}/out").where("stage = 'won'").select("lead_id", "value")


@query("R4_idempotent_ledger", "SELECT DISTINCT l_orderkey AS lead_id, l_returnflag AS stage FROM lineitem")
def idempotent_ledger(t: Tables) -> DataFrame:
    """Keys that come again in several batches are written once."""
    rows = t.table("lineitem").select(F.col("l_orderkey").alias("lead_id"), F.col("l_returnflag").alias("stage"), F.col("l_linenumber").alias("line"))

    def start(stream: DataFrame, root: str) -> None:
        jobs.run_to_end(stream, jobs.ledger_sink(f"{root}/ledger", ["lead_id", "stage"]), f"{root}/checkpoint")
    root = stream_slices(t, rows, start)
    return t.spark.read.schema("lead_id bigint, stage string").parquet(f"{root}/ledger").select("lead_id", "stage")


@query("R5_windowed_volumes", """
SELECT strftime(s, '%Y-%m-%d') AS start, event_type, count(*) AS n FROM (
  SELECT event_type, ts, unnest(range(0, 7)) AS j FROM events), LATERAL (SELECT date_trunc('day', ts) - to_days(j::INT) AS s)
WHERE s + INTERVAL 7 DAY <= (SELECT max(ts) - INTERVAL 2 DAY FROM events) GROUP BY ALL""")
def windowed_volumes(t: Tables) -> DataFrame:
    """Windows that the watermark has closed, from four batches by time."""
    rows = t.table("events").select("ts", "event_type")

    def start(stream: DataFrame, root: str) -> None:
        out = jobs.windowed_volumes(stream, "ts", "event_type", "7 days", "1 day", "2 days")
        jobs.run_to_end(out, jobs.parquet_sink(f"{root}/out"), f"{root}/checkpoint")
    root = stream_slices(t, rows, start, "ts")
    out = t.spark.read.schema("start timestamp, event_type string, n bigint").parquet(f"{root}/out")
    return out.select(F.date_format("start", "yyyy-MM-dd").alias("start"), "event_type", "n")
