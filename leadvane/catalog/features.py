"""Queries: cleaning, enrichment, scalar functions, features and designs."""
from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from leadvane.catalog.base import query, scratch, view
from leadvane.catalog.outcomes import HORIZON, ORDERS_DATES, labelled, ts
from leadvane.catalog.views import (FMT, MARGIN, SQL_CHANNEL, SQL_EMAIL, SQL_TERM, VALUE_CORRECTION, VALUE_WEIGHTS,
                                    WEIGHTS, sql_normalised_name, sql_seniority, sql_text_class, sql_tokens)
from leadvane.config import (ANSWER_KEYS, DROPPED_FEATURES, FEATURES, LEGACY_REFERENCES, LEVELS, V2_REFERENCES,
                             VALUE_LEVELS, design_columns)
from leadvane.functions import dates, scores, text
from leadvane.operators import cleaning, design, enrichment, features, labels, rows
from leadvane.session import path_exists
from leadvane.sources.bindings import Tables

LEGACY_FEATURES = tuple(LEGACY_REFERENCES)
V2_ALL = tuple(LEVELS)


def enriched(t: Tables) -> DataFrame:
    leads = enrichment.with_answers(t.leads())  # before the joins: values are narrower than the JSON text
    return enrichment.enrich(labelled(t, leads=leads), t.companies(), keyed=leads)


def legacy(t: Tables) -> DataFrame:
    return features.legacy_features(enriched(t))


def v2(t: Tables) -> DataFrame:
    return features.v2_features(enriched(t))


_SCORED: dict[tuple[str, str], tuple[str, DataFrame]] = {}
SCORED_COLUMNS = ("lead_id", "created_at", "form_variant", "utm_medium", "utm_source", "utm_campaign", "a_country",
                  "a_job_title", "a_company_size", "pages_visited", "final_stage", "last_change", "deal_value", "won_at",
                  "first_contact_at", "label_source", "won_within_h", "enrichment_source", "y", "sector")


def scored(t: Tables) -> DataFrame:
    """The featurised, scored leads every evaluation query reads: built and written once per session, so no plan repeats them."""
    key = (t.spark.sparkContext.applicationId, t.sf_dir)
    if key not in _SCORED or not path_exists(t.spark, _SCORED[key][0]):
        cols = [*SCORED_COLUMNS, *[c for c in V2_ALL if c not in SCORED_COLUMNS], "is_train", "is_test", "p", "log_value",
                "revenue", "deal_value_hat", "value"]
        df, path = score(t).select(*cols), f"{scratch(t)}/scored"
        df.write.parquet(path)
        _SCORED[key] = path, t.spark.read.schema(df.schema).parquet(path)
    return _SCORED[key][1]


#: What flags and joins read of a lead, and what of it the features and the scored table read besides.
_JOINED = ("lead_id", "created_at", "email", "user_agent", "time_on_page_s")
_CARRIED = ("form_variant", "utm_medium", "utm_source", "utm_campaign", "utm_term", "company_name", "company_domain", "landing_url", "time_on_page_s",
            "field_edit_count", "hesitation_ms", "pages_visited", "ip_country", "is_datacenter_ip", "local_submit_hour", "submitted_weekday",
            "sessions_before_convert", "viewed_pricing", *[f"a_{k}" for k in ANSWER_KEYS])


def score(t: Tables) -> DataFrame:
    """Cleaned, labelled, featurised leads with a frozen linear model's probability, value and the split."""
    leads = enrichment.with_answers(t.leads())
    whole = rows.unpacked(labelled(t, leads=rows.packed(leads, _JOINED, _CARRIED)), _CARRIED, dict(leads.dtypes))
    df = labels.with_split(features.v2_features(enrichment.enrich(whole, t.companies(), keyed=leads)), HORIZON, ORDERS_DATES)
    z = F.round(scores.linear_score(WEIGHTS), 9)  # equal sums tie in every engine
    df = df.withColumns({"p": scores.sigmoid(z), "log_value": scores.linear_score(VALUE_WEIGHTS),
                         "revenue": F.when(F.col("y") == 1, F.coalesce("deal_value", F.lit(0.0))).otherwise(0.0)})
    df = df.withColumn("deal_value_hat", F.exp("log_value") * VALUE_CORRECTION)
    return df.withColumn("value", F.col("p") * F.col("deal_value_hat") * MARGIN)


def test_rows(t: Tables) -> DataFrame:
    return scored(t).where("is_test")


# ---- projections and cleaning ----
@query("P1_normalised_email", "SELECT lead_id, email_l FROM flagged")
def normalised_email(t: Tables) -> DataFrame:
    return t.leads().select("lead_id", text.normalised_email(F.col("email")).alias("email_l"))


@query("P2_bot_flag", "SELECT lead_id, bot FROM flagged")
def bot_flag(t: Tables) -> DataFrame:
    return t.leads().select("lead_id", cleaning.is_bot(F.col("user_agent"), F.col("time_on_page_s")).alias("bot"))


@query("W1_repeat_flag", "SELECT lead_id, dup FROM flagged")
def repeat_flag(t: Tables) -> DataFrame:
    return cleaning.flag_bots_and_repeats(t.leads()).select("lead_id", "dup")


@query("P3_cleaned_leads", f"SELECT lead_id, strftime(created_at, {FMT}) AS created_at, email_l FROM flagged WHERE NOT bot AND NOT dup")
def cleaned_leads(t: Tables) -> DataFrame:
    return cleaning.clean(t.leads()).select("lead_id", ts("created_at"), "email_l")


@query("P4_answer_columns", "SELECT lead_id, " + ", ".join(f"a_{k}" for k in ANSWER_KEYS) + " FROM leads")
def answer_columns(t: Tables) -> DataFrame:
    return enrichment.with_answers(t.leads()).select("lead_id", *[f"a_{k}" for k in ANSWER_KEYS])


@query("P4_event_properties", """
SELECT event_id, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k, json_extract_string(props, '$.absent') AS absent FROM events""")
def event_properties(t: Tables) -> DataFrame:
    m = F.from_json("props", "map<string,string>")
    return t.table("events").select("event_id", F.try_element_at(m, F.lit("k")).cast("bigint").alias("k"),
                                    F.try_element_at(m, F.lit("absent")).alias("absent"))


@query("P6_blank_tests", """
SELECT lead_id, a_job_title IS NULL OR a_job_title = '' AS title_blank, nullif(trim(a_job_title), '') AS title_text,
  time_on_page_s IS NULL AS time_blank FROM leads""")
def blank_tests(t: Tables) -> DataFrame:
    return enrichment.with_answers(t.leads()).select(
        "lead_id", text.is_blank(F.col("a_job_title")).alias("title_blank"),
        text.text_or_null(F.col("a_job_title")).alias("title_text"),
        text.is_blank(F.col("time_on_page_s"), numeric=True).alias("time_blank"))


@query("P11_month_bucket", "SELECT strftime(created_at, '%Y-%m') AS month, count(*) AS leads FROM leads GROUP BY month")
def month_bucket(t: Tables) -> DataFrame:
    return t.leads().groupBy(dates.month(F.col("created_at")).alias("month")).agg(F.count("*").alias("leads"))


@query("P12_recorded_revenue", """
SELECT lead_id, revenue, CASE WHEN y = 1 THEN round(coalesce(deal_value, deal_value_hat), 4) ELSE 0 END AS revenue_imputed
FROM scored WHERE y IS NOT NULL""")
def recorded_revenue(t: Tables) -> DataFrame:
    imputed = F.when(F.col("y") == 1, F.round(F.coalesce("deal_value", "deal_value_hat"), 4)).otherwise(0.0)
    return scored(t).where("y is not null").select("lead_id", "revenue", imputed.alias("revenue_imputed"))


# ---- enrichment joins ----
_CO = "co_sector, co_band AS co_employee_band, co_spend AS co_monthly_ad_spend_band, co_crm AS co_crm_platform, co_hiring AS co_is_hiring"


@query("J1_domain_enrichment", f"SELECT lead_id, dom, {_CO} FROM enriched")
def domain_enrichment(t: Tables) -> DataFrame:
    df = enrichment.join_by_domain(labelled(t), t.companies())
    return df.select("lead_id", "dom", "co_sector", "co_employee_band", "co_monthly_ad_spend_band", "co_crm_platform",
                     "co_is_hiring")


@query("J2_name_enrichment", """
SELECT lead_id, enrichment_source, en_sector, en_band AS en_employee_band, en_spend AS en_monthly_ad_spend_band,
  en_crm AS en_crm_platform, en_hiring AS en_is_hiring FROM enriched""")
def name_enrichment(t: Tables) -> DataFrame:
    return enriched(t).select("lead_id", "enrichment_source", "en_sector", "en_employee_band",
                              "en_monthly_ad_spend_band", "en_crm_platform", "en_is_hiring")


@query("J2_company_name_index", "SELECT name_key, n_band AS employee_band FROM company_names")
def company_name_index(t: Tables) -> DataFrame:
    return enrichment.company_name_index(t.companies()).select("name_key", "employee_band")


# ---- scalar functions ----
@query("F1_normalised_company_name", f"""
SELECT name, {sql_normalised_name('name')} AS name_key, count(*) AS n FROM (
  SELECT company_name AS name FROM leads UNION ALL SELECT p_name || ' Co. Ltd' FROM part
  UNION ALL SELECT regexp_extract(url, '^https?://([^/]+)', 1) FROM pages) GROUP BY name, name_key""")
def normalised_company_name(t: Tables) -> DataFrame:
    names = (t.leads().select(F.col("company_name").alias("name"))
             .unionByName(t.table("part").select(F.concat("p_name", F.lit(" Co. Ltd")).alias("name")))
             .unionByName(t.table("pages").select(F.regexp_extract("url", "^https?://([^/]+)", 1).alias("name"))))
    return names.groupBy("name").agg(F.count("*").alias("n")).withColumn(
        "name_key", text.normalised_company(F.col("name")))


view("texts", """SELECT 'd' || doc_id AS id, text FROM documents
  UNION ALL SELECT 'c' || conv_id || '.' || turn, text FROM conversations""")


def texts(t: Tables) -> DataFrame:
    return (t.table("documents").select(F.concat(F.lit("d"), "doc_id").alias("id"), "text").unionByName(
        t.table("conversations").select(F.concat(F.lit("c"), "conv_id", F.lit("."), "turn").alias("id"), "text")))


@query("F2_text_class", f"""
SELECT id, {sql_text_class('text')} AS text_class FROM texts
UNION ALL SELECT 'l' || lead_id, {sql_text_class('a_what_to_solve')} FROM leads""")
def text_class(t: Tables) -> DataFrame:
    answers = enrichment.with_answers(t.leads()).select(F.concat(F.lit("l"), "lead_id").alias("id"),
                                                        F.col("a_what_to_solve").alias("text"))
    return texts(t).unionByName(answers).select("id", text.text_class(F.col("text")).alias("text_class"))


@query("F3_text_class_v2", "SELECT lead_id, f_text AS text_class FROM features_v2")
def text_class_v2(t: Tables) -> DataFrame:
    return enrichment.with_answers(labelled(t)).select(
        "lead_id", text.text_class_v2(F.col("a_what_to_solve")).alias("text_class"))


@query("F4_token_sets", f"""
SELECT id, len({sql_tokens('text')})::BIGINT AS n_tokens, list_aggregate(list_sort({sql_tokens('text')}), 'string_agg', ' ') AS words
FROM texts""")
def token_sets(t: Tables) -> DataFrame:
    words = text.tokens(F.col("text"))
    return texts(t).select("id", F.size(words).cast("bigint").alias("n_tokens"),
                           F.nullif(F.array_join(F.array_sort(words), " "), F.lit("")).alias("words"))


@query("F5_fixed_snippet_similarity", f"""
WITH s AS (SELECT {sql_tokens('snippet')} AS b FROM snippets), d AS (SELECT id, {sql_tokens('text')} AS a FROM texts)
SELECT id, round(max(CASE WHEN len(a) + len(b) = 0 THEN 0 ELSE len(list_intersect(a, b))
  / (len(a) + len(b) - len(list_intersect(a, b))) END), 6) AS similarity FROM d CROSS JOIN s GROUP BY id
""")
def fixed_snippet_similarity(t: Tables) -> DataFrame:
    return texts(t).select("id", F.round(text.best_similarity(F.col("text")), 6).alias("similarity"))


@query("F6_seniority", f"SELECT lead_id, {sql_seniority('a_job_title')} AS seniority FROM leads")
def seniority(t: Tables) -> DataFrame:
    return enrichment.with_answers(t.leads()).select("lead_id", text.seniority(F.col("a_job_title")).alias("seniority"))


@query("F7_channel", f"SELECT lead_id, {SQL_CHANNEL} AS channel FROM leads")
def channel(t: Tables) -> DataFrame:
    return t.leads().select("lead_id", text.channel(F.col("utm_medium"), F.col("utm_source")).alias("channel"))


@query("F8_email_type", f"SELECT lead_id, {SQL_EMAIL} AS email_type FROM flagged")
def email_type(t: Tables) -> DataFrame:
    return t.leads().select("lead_id", text.email_type(text.normalised_email(F.col("email"))).alias("email_type"))


@query("F9_search_term", f"SELECT lead_id, {SQL_TERM} AS search_term FROM leads")
def search_term(t: Tables) -> DataFrame:
    ch = text.channel(F.col("utm_medium"), F.col("utm_source"))
    return t.leads().select("lead_id", text.search_term(ch, F.col("utm_term")).alias("search_term"))


@query("F10_session_absent", "SELECT lead_id, f_session_missing = 'yes' AS session_absent FROM features_v2")
def session_absent(t: Tables) -> DataFrame:
    return labelled(t).select("lead_id", features.session_absent().alias("session_absent"))


@query("F11_behaviour_buckets", """
SELECT f_time_on_page AS time_on_page, f_hesitation_90s AS hesitation_90s, f_business_hours AS business_hours,
  f_ip_country AS ip_country, f_edits_1_4 AS edits_1_4, count(*) AS n FROM features_legacy GROUP BY ALL""")
def behaviour_buckets(t: Tables) -> DataFrame:
    cols = ["time_on_page", "hesitation_90s", "business_hours", "ip_country", "edits_1_4"]
    return legacy(t).groupBy(*cols).agg(F.count("*").alias("n"))


@query("F12_elapsed_days", """
SELECT lead_id, CAST(floor((epoch_us(TIMESTAMP '2001-06-01') - epoch_us(created_at)) / 86400000000) AS BIGINT) AS age_days,
  CAST(floor((epoch_us(TIMESTAMP '2001-06-01') - epoch_us(last_change)) / 86400000000) AS BIGINT) AS idle_days FROM labelled""")
def elapsed_days(t: Tables) -> DataFrame:
    now = labels.at(ORDERS_DATES.as_of)
    return labelled(t).select("lead_id", labels.elapsed_days(now, F.col("created_at")).alias("age_days"),
                              labels.elapsed_days(now, F.col("last_change")).alias("idle_days"))


@query("F13_date_from_parts", """
WITH p AS (SELECT o_orderkey, 1995 + o_orderkey % 7 AS y, 1 + o_orderkey % 12 AS m, 1 + o_orderkey % 31 AS d FROM orders)
SELECT o_orderkey, strftime(try_strptime(printf('%d-%02d-%02d', y, m, d), '%Y-%m-%d'), '%Y-%m-%d') AS built,
  try_strptime(printf('%d-%02d-%02d', y, m, d), '%Y-%m-%d') IS NULL AS impossible FROM p""")
def date_from_parts(t: Tables) -> DataFrame:
    names = F.array(*[F.lit(m) for m in dates.MONTH_NAMES])
    parts = t.table("orders").selectExpr("o_orderkey", "cast(1995 + o_orderkey % 7 as string) as y",
                                         "1 + o_orderkey % 12 as mi", "cast(1 + o_orderkey % 31 as string) as d")
    named = F.when(F.col("o_orderkey") % 2 == 0, F.element_at(names, F.col("mi").cast("int"))).otherwise(
        F.col("mi").cast("string"))
    built = dates.date_from_parts(F.col("y"), named, F.col("d"))
    return parts.select("o_orderkey", F.date_format(built, "yyyy-MM-dd").alias("built"), built.isNull().alias("impossible"))


@query("F14_minus_days", """
SELECT l_orderkey, l_linenumber, l_partkey, strftime(l_shipdate - to_microseconds(CAST(l_quantity * 43200000000 AS BIGINT)),
  '%Y-%m-%d %H:%M:%S') AS moved FROM lineitem""")
def minus_days(t: Tables) -> DataFrame:
    moved = dates.minus_days(F.col("l_shipdate"), F.col("l_quantity") / 2)
    return t.table("lineitem").select("l_orderkey", "l_linenumber", "l_partkey",
                                      F.date_format(moved, "yyyy-MM-dd HH:mm:ss").alias("moved"))


@query("F15_null_propagating_arithmetic", """
SELECT l_orderkey, l_linenumber, l_partkey,
  CASE WHEN l_returnflag <> 'R' THEN round(l_extendedprice * (1 - l_discount) * l_quantity, 4) END AS product,
  CASE WHEN l_returnflag <> 'R' THEN round(l_extendedprice + l_tax, 4) END AS total FROM lineitem""")
def null_propagating_arithmetic(t: Tables) -> DataFrame:
    q = F.when(F.col("l_returnflag") != "R", F.col("l_quantity").cast("string"))
    price = F.when(F.col("l_returnflag") != "R", F.col("l_extendedprice").cast("string"))
    return t.table("lineitem").select(
        "l_orderkey", "l_linenumber", "l_partkey",
        F.round(dates.product([F.col("l_extendedprice"), 1 - F.col("l_discount"), q]), 4).alias("product"),
        F.round(dates.total([price, F.col("l_tax")]), 4).alias("total"))


@query("F19_clipped_logit", """
SELECT c_custkey, round(ln(q / (1 - q)), 6) AS context_logit FROM (
  SELECT c_custkey, least(greatest((c_acctbal + 1000) / 10000, 0.001), 0.999) AS q FROM customer)""")
def clipped_logit(t: Tables) -> DataFrame:
    return t.table("customer").select("c_custkey", F.round(
        scores.logit((F.col("c_acctbal") + 1000) / 10000), 6).alias("context_logit"))


@query("F20_word_count", r"""
SELECT id, len(regexp_extract_all(text, '\S+'))::BIGINT AS n_words, len(regexp_extract_all(text, '\S+')) > 30 AS too_long FROM texts""")
def word_count(t: Tables) -> DataFrame:
    n = text.word_count(F.col("text")).cast("bigint")
    return texts(t).select("id", n.alias("n_words"), (n > 30).alias("too_long"))


# ---- features and designs ----
@query("G1_legacy_features", "SELECT lead_id, f_sector AS sector, " + ", ".join(
    f"f_{f} AS {f}" for f in LEGACY_FEATURES) + " FROM features_legacy")
def legacy_features(t: Tables) -> DataFrame:
    return legacy(t).select("lead_id", "sector", *LEGACY_FEATURES)


@query("G2_v2_features", "SELECT lead_id, f_sector AS sector, " + ", ".join(
    f"f_{f} AS {f}" for f in V2_ALL) + " FROM features_v2")
def v2_features(t: Tables) -> DataFrame:
    return v2(t).select("lead_id", "sector", *V2_ALL)


def _wide_sql(refs: dict[str, str | None], levels: dict) -> str:
    cols = [f"CASE WHEN f_{f} = '{lvl}' THEN 1.0::DOUBLE ELSE 0.0 END AS \"{f}={lvl}\""
            for f, ref in refs.items() for lvl in levels[f] if lvl != ref]
    return "SELECT lead_id, " + ", ".join(cols) + " FROM features_v2"


@query("G3_fixed_design", _wide_sql(V2_REFERENCES, LEVELS))
def fixed_design(t: Tables) -> DataFrame:
    return design.wide_design(v2(t))


@query("G4_observed_design_columns", " UNION ALL ".join(
    f"SELECT '{f}=' || f_{f} AS \"column\", count(*) AS n FROM features_legacy WHERE f_{f} <> '{r}' GROUP BY f_{f}"
    for f, r in LEGACY_REFERENCES.items()))
def observed_design_columns(t: Tables) -> DataFrame:
    return design.observed_levels(legacy(t), LEGACY_REFERENCES)


@query("G5_value_design", _wide_sql(dict.fromkeys(VALUE_LEVELS), VALUE_LEVELS))
def value_design(t: Tables) -> DataFrame:
    return design.wide_design(v2(t), dict.fromkeys(VALUE_LEVELS), VALUE_LEVELS)


_RANKS = {"band": ["1-10", "11-50", "51-200", "201-1000", "1000+"],
          "seniority": ["student", "junior/ic", "mid", "senior"]}


@query("G10_ordinal_ranks", """
SELECT lead_id, (list_position(['1-10','11-50','51-200','201-1000','1000+'], f_band) - 1)::DOUBLE AS o_band,
  CASE WHEN f_enrichment_missing = 'no' THEN (list_position(['none','under £5k','£5k-£25k','£25k-£100k','£100k+'], f_spend) - 1)::DOUBLE END AS o_spend,
  CASE WHEN f_session_missing = 'no' THEN (list_position(['15-60s','60-300s','300-600s','>600s'], f_time_on_page) - 1)::DOUBLE END AS o_time_on_page,
  (list_position(['student','junior/ic','mid','senior'], f_seniority) - 1)::DOUBLE AS o_seniority,
  (list_position(['google','meta','meta_leadads','linkedin','chatgpt','organic_direct'], f_channel) - 1)::DOUBLE AS o_channel
FROM features_v2""")
def ordinal_ranks(t: Tables) -> DataFrame:
    cols = ("band", "spend", "time_on_page", "seniority", "channel")
    return features.ordinal_features(v2(t), cols).select("lead_id", *[f"o_{c}" for c in cols])


@query("G11_interactions", """
SELECT lead_id, CASE WHEN f_channel = 'linkedin' AND f_band IN ('51-200','201-1000','1000+') THEN 1.0::DOUBLE ELSE 0.0 END AS linkedin_x_51plus,
  CASE WHEN f_seniority = 'senior' AND f_form_variant = 'D' THEN 1.0::DOUBLE ELSE 0.0 END AS "senior_x_formD" FROM features_v2""")
def interaction_columns(t: Tables) -> DataFrame:
    return features.interactions(v2(t)).select("lead_id", "linkedin_x_51plus", "senior_x_formD")


@query("Q9_unknown_levels", """
SELECT feature, level, n FROM (
  SELECT 'sector' AS feature, f_sector AS level, count(*) AS n FROM features_legacy GROUP BY f_sector
  UNION ALL SELECT 'channel', f_channel, count(*) FROM features_legacy GROUP BY f_channel)
WHERE (feature = 'sector' AND level NOT IN ('Retail','Software')) OR (feature = 'channel' AND level NOT IN ('google','meta'))""")
def unknown_levels(t: Tables) -> DataFrame:
    return design.unknown_levels(legacy(t), {"sector": ("Retail", "Software"), "channel": ("google", "meta")})


@query("G3_design_column_counts", " UNION ALL ".join(
    f"SELECT '{f}={lvl}' AS \"column\", '{f}' AS feature, count(*) FILTER (WHERE f_{f} = '{lvl}') AS leads_with_1, "
    f"count(*) AS leads FROM features_v2" for f in FEATURES for lvl in LEVELS[f][1:]))
def design_column_counts(t: Tables) -> DataFrame:
    return design.design_counts(v2(t))


@query("F22_design_column_parts", """
SELECT "column", split_part("column", '=', 1) AS feature, substr("column", strpos("column", '=') + 1) AS level, n FROM (
  SELECT 'channel=' || f_channel AS "column", count(*) AS n FROM features_legacy WHERE f_channel <> 'google' GROUP BY f_channel)""")
def design_column_parts(t: Tables) -> DataFrame:
    parts = F.split("column", "=", 2)
    return design.observed_levels(legacy(t), {"channel": "google"}).select(
        "column", parts[0].alias("feature"), parts[1].alias("level"), "n")


assert set(DROPPED_FEATURES) <= set(V2_ALL) and design_columns(V2_REFERENCES)
