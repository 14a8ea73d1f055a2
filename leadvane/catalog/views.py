"""DuckDB views the oracles share: the lead, CRM and company schemas over the test tables, and the stages after them."""
from __future__ import annotations

from leadvane.catalog.base import view
from leadvane.config import BOILERPLATE_SNIPPETS

T_AS_OF = "TIMESTAMP '2001-06-01'"
T_TEST_FROM = "TIMESTAMP '2000-01-01'"
FMT = "'%Y-%m-%d %H:%M:%S'"

_EMAIL = """('u' || c || '.' || (k % 13) || '@' || CASE c % 5 WHEN 0 THEN 'gmail.example' WHEN 1 THEN 'outlook.example'
    ELSE 'customer' || c || '.example' END)"""
view("orders_wide", """
SELECT o.*, o_orderkey AS k, o_custkey AS c, cu.c_name, cu.c_acctbal, cu.c_mktsegment, n.n_name,
       CASE WHEN o_custkey % 50 = 1 THEN 'Shared Holdings' ELSE cu.c_name END AS shown_name
FROM orders o JOIN customer cu ON o.o_custkey = cu.c_custkey JOIN nation n ON cu.c_nationkey = n.n_nationkey""")
view("leads", f"""
SELECT k AS lead_id, o_orderdate AS created_at, ['A','B','C','D'][(k % 4 + 1)::INT] AS form_variant,
  CASE WHEN k % 17 = 0 THEN NULL ELSE n_name END AS a_country,
  CASE k % 10 WHEN 0 THEN 'pricing' WHEN 1 THEN 'We need 25 seats before Q3' WHEN 2 THEN '{BOILERPLATE_SNIPPETS[0]}'
    WHEN 3 THEN NULL WHEN 4 THEN 'Our funnel is slow and hard to track' WHEN 5 THEN '  Tell me more '
    WHEN 6 THEN 'our mission is to empower teams' WHEN 7 THEN '{BOILERPLATE_SNIPPETS[1]}'
    WHEN 8 THEN 'Team of 12, budget agreed' ELSE 'Looking at ' || lower(o_orderpriority) END AS a_what_to_solve,
  CASE k % 9 WHEN 0 THEN 'Student intern' WHEN 1 THEN 'CEO' WHEN 2 THEN 'Marketing Manager' WHEN 3 THEN 'Data analyst'
    WHEN 4 THEN 'VP Sales' WHEN 5 THEN ' ' WHEN 6 THEN NULL WHEN 7 THEN 'Team Lead' ELSE 'Head of Growth' END AS a_job_title,
  CASE k % 7 WHEN 0 THEN '1-10' WHEN 1 THEN '11-50' WHEN 2 THEN '51-200' WHEN 3 THEN '201-1000' WHEN 4 THEN '1000+'
    WHEN 5 THEN '' ELSE NULL END AS a_company_size,
  CASE k % 6 WHEN 1 THEN 'Under £5k' WHEN 2 THEN '£5k-£20k' WHEN 3 THEN '£20k-£50k' WHEN 4 THEN '£50k+' END AS a_budget,
  CASE k % 5 WHEN 0 THEN 'This month' WHEN 1 THEN 'This quarter' WHEN 2 THEN 'Next 6 months'
    WHEN 3 THEN 'Just researching' END AS a_timeline,
  CASE WHEN k % 4 = 1 THEN shown_name || ' Ltd.' END AS a_company,
  CASE WHEN k % 29 = 0 THEN NULL WHEN k % 3 = 0 THEN '  ' || upper({_EMAIL}) ELSE {_EMAIL} END AS email,
  CASE WHEN k % 6 = 0 THEN NULL ELSE '+44 20 7946 ' || lpad((k % 10000)::VARCHAR, 4, '0') END AS phone,
  c_name AS name,
  CASE WHEN k % 2 = 0 THEN shown_name || ' Ltd' END AS company_name,
  CASE WHEN k % 5 = 0 THEN NULL WHEN k % 7 = 0 THEN ' CUSTOMER' || c || '.example ' ELSE 'customer' || c || '.example' END
    AS company_domain,
  k % 2 = 0 AS consent,
  CASE o_orderpriority WHEN '1-URGENT' THEN 'google' WHEN '2-HIGH' THEN 'facebook' WHEN '3-MEDIUM' THEN 'linkedin'
    WHEN '5-LOW' THEN 'chatgpt' END AS utm_source,
  CASE WHEN k % 23 = 0 THEN 'lead_form' ELSE 'cpc' END AS utm_medium,
  'cmp-' || (k % 6) AS utm_campaign,
  CASE k % 4 WHEN 0 THEN 'Northstar crm' WHEN 1 THEN 'crm tool' END AS utm_term,
  CASE WHEN o_orderpriority = '2-HIGH' AND k % 4 <> 0 THEN 'fb' || k END AS fbclid,
  CASE WHEN o_orderpriority = '2-HIGH' AND k % 5 <> 0 THEN 'fbp' || k END AS fbp,
  CASE WHEN o_orderpriority = '1-URGENT' AND k % 3 <> 0 THEN 'g' || k END AS gclid,
  CASE WHEN o_orderpriority = '1-URGENT' AND k % 9 = 0 THEN 'gb' || k END AS gbraid,
  CAST(NULL AS VARCHAR) AS wbraid,
  CASE WHEN o_orderpriority = '3-MEDIUM' AND k % 2 = 0 THEN 'li' || k END AS li_fat_id,
  CASE WHEN o_orderpriority = '5-LOW' AND k % 7 = 0 THEN 'op' || k END AS oppref,
  CASE WHEN k % 23 = 0 AND k % 46 <> 0 THEN 'ml' || k END AS meta_lead_id,
  CASE WHEN k % 31 = 0 THEN NULL ELSE 'https://site.example/' || (k % 8) END AS landing_url,
  CASE WHEN k % 19 = 0 THEN NULL ELSE (k * 13 % 900)::DOUBLE END AS time_on_page_s,
  (k % 8)::DOUBLE AS field_edit_count,
  CASE WHEN k % 53 = 0 THEN NULL ELSE (k * 7919 % 200000)::DOUBLE END AS hesitation_ms,
  CASE WHEN k % 43 = 0 THEN 'Mozilla/5.0 HEADLESSchrome' WHEN k % 47 = 0 THEN NULL ELSE 'Mozilla/5.0' END AS user_agent,
  CASE WHEN k % 11 = 0 THEN NULL ELSE (k % 8)::DOUBLE END AS pages_visited,
  CASE WHEN k % 59 = 0 THEN NULL WHEN k % 8 = 3 THEN 'NATION_99' ELSE n_name END AS ip_country,
  k % 41 = 0 AS is_datacenter_ip,
  (k * 5 % 24)::DOUBLE AS local_submit_hour,
  ['Monday','Tuesday','Wednesday','Thursday','Friday','Saturday','Sunday'][(k % 7 + 1)::INT] AS submitted_weekday,
  (CASE WHEN o_orderstatus = 'F' THEN 1 + k % 5 ELSE k % 4 END)::DOUBLE AS sessions_before_convert,
  CASE WHEN k % 37 = 0 THEN NULL ELSE k % 3 = 0 OR (o_orderstatus = 'F' AND k % 5 < 2) END AS viewed_pricing
FROM orders_wide""")
view("companies", """
SELECT (CASE WHEN c_custkey % 50 = 1 THEN 'Shared Holdings' ELSE c_name END) || ' GmbH' AS company_name,
  'Customer' || c_custkey || '.example' AS domain,
  CASE c_mktsegment WHEN 'HOUSEHOLD' THEN 'Retail' WHEN 'MACHINERY' THEN 'Manufacturing'
    WHEN 'BUILDING' THEN 'Professional services' WHEN 'AUTOMOBILE' THEN 'Logistics' ELSE 'Software' END AS sector,
  CASE c_custkey % 6 WHEN 0 THEN '1-10' WHEN 1 THEN '11-50' WHEN 2 THEN '51-200' WHEN 3 THEN '201-1000'
    WHEN 4 THEN '1000+' END AS employee_band,
  n_name AS country,
  CASE c_custkey % 4 WHEN 1 THEN 'HubSpot' WHEN 2 THEN 'Salesforce' ELSE 'Pipedrive' END AS crm_platform,
  CASE c_custkey % 5 WHEN 0 THEN 'none' WHEN 1 THEN 'under £5k' WHEN 2 THEN '£5k-£25k' WHEN 3 THEN '£25k-£100k'
    ELSE '£100k+' END AS monthly_ad_spend_band,
  CASE WHEN c_custkey % 10 = 9 THEN NULL ELSE c_acctbal > 3000 END AS is_hiring
FROM customer JOIN nation ON c_nationkey = n_nationkey WHERE c_custkey % 4 <> 0""")
view("order_events", """
SELECT o_orderkey AS k, o_orderdate AS created, o_orderstatus AS s, o_totalprice AS price,
  CASE WHEN o_orderkey % 8 <> 0 THEN o_orderdate + to_days((o_orderkey * 37 % 150)::INT) END AS contacted,
  CASE WHEN o_orderstatus = 'F' THEN 'closed WON' WHEN o_orderstatus = 'P' THEN 'lost'
    WHEN o_orderkey % 8 <> 0 AND o_orderkey % 3 = 1 THEN 'Qualified' END AS final_text,
  o_orderdate + to_days((o_orderkey * 53 % 240)::INT) AS final_raw
FROM orders""")
view("crm", f"""
SELECT lead_id, stage, deal_value, changed_at FROM (
  SELECT k AS lead_id, 'New' AS stage, NULL::DOUBLE AS deal_value, created AS changed_at FROM order_events
  UNION ALL SELECT k, 'Contacted', NULL, contacted FROM order_events WHERE contacted IS NOT NULL
  UNION ALL SELECT k, final_text, CASE WHEN s = 'F' AND k % 12 <> 0 THEN price END,
    CASE WHEN contacted IS NOT NULL AND contacted + INTERVAL 1 SECOND > final_raw THEN contacted + INTERVAL 1 SECOND
      ELSE final_raw END
  FROM order_events WHERE final_text IS NOT NULL)
WHERE stage = 'New' OR changed_at <= {T_AS_OF}""")
view("crm_staged", """
SELECT *, CASE lower(stage) WHEN 'closed won' THEN 'Won' WHEN 'won' THEN 'Won' WHEN 'closed lost' THEN 'Lost'
  WHEN 'lost' THEN 'Lost' WHEN 'qualified' THEN 'Qualified' WHEN 'demo booked' THEN 'Demo booked'
  WHEN 'proposal' THEN 'Proposal' WHEN 'new' THEN 'New' WHEN 'contacted' THEN 'Contacted' END AS stage_n,
  CASE WHEN stage = 'New' THEN 0 WHEN stage = 'Contacted' THEN 1 ELSE 2 END AS pos FROM crm""")
view("outcomes", """
SELECT lead_id, arg_max(stage_n, changed_at + to_microseconds(pos)) AS final_stage, max(changed_at) AS last_change,
  max(CASE WHEN stage_n = 'Won' THEN deal_value END) AS deal_value,
  max(CASE WHEN stage_n = 'Won' THEN changed_at END) AS won_at,
  min(CASE WHEN stage_n <> 'New' THEN changed_at END) AS first_contact_at
FROM crm_staged GROUP BY lead_id""")
view("flagged", r"""
SELECT l.*, lower(trim(email)) AS email_l,
  contains(lower(coalesce(user_agent, '')), 'headless') OR coalesce(time_on_page_s < 15, false) AS bot,
  email IS NOT NULL AND row_number() OVER (PARTITION BY lower(trim(email)) ORDER BY created_at, lead_id) > 1 AS dup
FROM leads l""")
view("cleaned", """
SELECT f.*, o.final_stage, o.last_change, o.deal_value, o.won_at, o.first_contact_at
FROM flagged f LEFT JOIN outcomes o USING (lead_id) WHERE NOT bot AND NOT dup""")
view("lead_states", f"""
SELECT *, created_at + INTERVAL 120 DAY AS matured_at, created_at + INTERVAL 120 DAY <= {T_AS_OF} AS mature,
  NOT coalesce(first_contact_at <= created_at + INTERVAL 120 DAY, false) AS ghosted_at_h,
  coalesce(final_stage IN ('Contacted','Qualified','Demo booked','Proposal')
    AND epoch({T_AS_OF}) - epoch(last_change) >= 90 * 86400, false) AS stalled,
  epoch({T_AS_OF}) - epoch(created_at) >= 90 * 86400 AS old
FROM cleaned""")
view("labelled", """
SELECT *,
  CASE WHEN coalesce(won_at <= matured_at, false) THEN 1.0::DOUBLE WHEN mature THEN 0.0 END AS won_within_h,
  CASE WHEN final_stage = 'Won' THEN 'won' WHEN final_stage = 'Lost' THEN 'crm_lost'
    WHEN mature AND ghosted_at_h THEN 'ghosted' WHEN stalled THEN 'stalled' ELSE 'open' END AS label_source,
  CASE WHEN final_stage = 'Won' THEN 1.0::DOUBLE WHEN final_stage = 'Lost' OR stalled OR (final_stage = 'New' AND old)
    THEN 0.0 END AS y_legacy,
  CASE WHEN coalesce(won_at <= matured_at, false) THEN 1.0::DOUBLE WHEN mature AND NOT ghosted_at_h AND NOT stalled THEN 0.0
    END AS y
FROM lead_states""")

# ---- enrichment and features ----
_WORD = r"[\p{L}\p{N}_]"


def sql_normalised_name(expr: str) -> str:
    words = rf"trim(regexp_replace(regexp_replace(regexp_replace(lower({expr}), '[.''’]', '', 'g'), '[^\p{{L}}\p{{N}}_]+|_', ' ', 'g'), '\s+', ' ', 'g'))"
    legal = "ltd|limited|inc|llc|gmbh|bv|sa|plc|co|sas|incorporated|corporation|corp|company"
    return rf"nullif(regexp_replace({words}, '(^|\s)(({legal})(\s|$))+$', ''), '')"


view("company_names", f"""
SELECT name_key, any_value(sector) AS n_sector, any_value(employee_band) AS n_band, any_value(monthly_ad_spend_band) AS n_spend,
  any_value(crm_platform) AS n_crm, bool_or(is_hiring) AS n_hiring
FROM (SELECT {sql_normalised_name('company_name')} AS name_key, * FROM companies) WHERE name_key IS NOT NULL
GROUP BY name_key HAVING count(*) = 1""")
view("enriched", f"""
SELECT e.*, CASE WHEN by_domain THEN 'domain' WHEN n1.name_key IS NOT NULL OR n2.name_key IS NOT NULL THEN 'name' END
    AS enrichment_source,
  CASE WHEN by_domain THEN co_sector WHEN n1.name_key IS NOT NULL THEN n1.n_sector ELSE n2.n_sector END AS en_sector,
  CASE WHEN by_domain THEN co_band WHEN n1.name_key IS NOT NULL THEN n1.n_band ELSE n2.n_band END AS en_band,
  CASE WHEN by_domain THEN co_spend WHEN n1.name_key IS NOT NULL THEN n1.n_spend ELSE n2.n_spend END AS en_spend,
  CASE WHEN by_domain THEN co_crm WHEN n1.name_key IS NOT NULL THEN n1.n_crm ELSE n2.n_crm END AS en_crm,
  CASE WHEN by_domain THEN co_hiring WHEN n1.name_key IS NOT NULL THEN n1.n_hiring ELSE n2.n_hiring END AS en_hiring
FROM (SELECT l.*, lower(trim(company_domain)) AS dom, c.sector AS co_sector, c.employee_band AS co_band,
    c.monthly_ad_spend_band AS co_spend, c.crm_platform AS co_crm, c.is_hiring AS co_hiring,
    c.employee_band IS NOT NULL AS by_domain,
    {sql_normalised_name('l.company_name')} AS key1, {sql_normalised_name('a_company')} AS key2
  FROM labelled l LEFT JOIN companies c ON lower(c.domain) = lower(trim(company_domain))) e
LEFT JOIN company_names n1 ON NOT by_domain AND n1.name_key = key1
LEFT JOIN company_names n2 ON NOT by_domain AND n1.name_key IS NULL AND n2.name_key = key2""")
view("snippets", "SELECT unnest([" + ", ".join("'" + s.replace("'", "''") + "'" for s in BOILERPLATE_SNIPPETS)
     + "]) AS snippet")


def sql_tokens(expr: str) -> str:
    return f"list_distinct(regexp_extract_all(lower({expr}), '[a-z0-9]+'))"


view("text_similarity", f"""
SELECT a_what_to_solve, max(len(list_intersect(a, b)) / (len(a) + len(b) - len(list_intersect(a, b)))) AS sim
FROM (SELECT DISTINCT a_what_to_solve, {sql_tokens('a_what_to_solve')} AS a FROM leads WHERE a_what_to_solve IS NOT NULL) t
CROSS JOIN (SELECT {sql_tokens('snippet')} AS b FROM snippets) s GROUP BY a_what_to_solve""")


def sql_text_rest(s: str) -> str:
    return rf"""CASE WHEN {s} IN ('','?','n/a','hi','test','info','interested','tell me more','more info pls','pricing')
      THEN 'vague' WHEN regexp_matches({s}, '£\s?\d|\d+\s*(seats|users|sdrs|marketers)|team of \d|budget|within \d+ weeks|by (jan|feb|mar|apr|may|jun|jul|aug|sep|oct|nov|dec)|before (q\d|end|the new)|contract ends')
      THEN 'specific' ELSE 'neutral' END"""


def sql_text_class(expr: str) -> str:
    s = f"coalesce(lower(trim({expr}, E' \\t\\n\\r\\f\\v')), '')"
    return f"""CASE WHEN starts_with({s}, 'lorem ipsum') OR starts_with({s}, 'we are a leading provider')
      OR starts_with({s}, 'our mission is to empower') THEN 'copy_paste' ELSE {sql_text_rest(s)} END"""


def sql_seniority(expr: str) -> str:
    return f"""CASE WHEN coalesce(trim({expr}), '') = '' THEN 'not_asked/blank'
      WHEN regexp_matches(lower({expr}), 'student|intern') THEN 'student'
      WHEN regexp_matches(lower({expr}), 'ceo|founder|chief|vp|director|head|owner|partner|president|cmo|cto|cfo') THEN 'senior'
      WHEN regexp_matches(lower({expr}), 'manager|lead') THEN 'mid' ELSE 'junior/ic' END"""


SQL_CHANNEL = """CASE WHEN utm_medium = 'lead_form' THEN 'meta_leadads' WHEN utm_source IN ('facebook','instagram') THEN 'meta'
  WHEN utm_source IN ('google','linkedin','chatgpt') THEN utm_source ELSE 'organic_direct' END"""
SQL_EMAIL = """CASE WHEN coalesce(split_part(email_l, '@', 2) IN ('gmail.example','yahoo.example','hotmail.example',
  'outlook.example','icloud.example'), false) THEN 'free' ELSE 'business' END"""
SQL_TERM = f"""CASE WHEN {SQL_CHANNEL} <> 'google' THEN 'not_google'
  WHEN contains(lower(coalesce(utm_term, '')), 'northstar') THEN 'brand' ELSE 'generic' END"""
_HOURS = "submitted_weekday NOT IN ('Saturday','Sunday') AND local_submit_hour BETWEEN 9 AND 17"
_TIME = """CASE WHEN time_on_page_s < 60 THEN '15-60s' WHEN time_on_page_s < 300 THEN '60-300s'
  WHEN time_on_page_s < 600 THEN '300-600s' WHEN time_on_page_s >= 600 THEN '>600s' ELSE '15-60s' END"""
_SHARED = f"""{SQL_EMAIL} AS f_email, {sql_seniority('a_job_title')} AS f_seniority,
  coalesce(a_budget, 'not_asked') AS f_c_budget, coalesce(a_timeline, 'not_asked') AS f_c_timeline,
  CASE WHEN field_edit_count BETWEEN 1 AND 4 THEN 'yes' ELSE 'no' END AS f_edits_1_4, {SQL_CHANNEL} AS f_channel,
  {SQL_TERM} AS f_search_term"""
view("features_legacy", f"""
SELECT lead_id, created_at, y, y_legacy, form_variant AS f_form_variant, {_SHARED},
  CASE WHEN co_band IS NULL THEN 'yes' ELSE 'no' END AS f_no_company,
  coalesce(co_band, nullif(a_company_size, ''), '1-10') AS f_band, {sql_text_class('a_what_to_solve')} AS f_text,
  coalesce(co_spend, 'under £5k') AS f_spend,
  CASE WHEN co_crm IN ('HubSpot','Salesforce') THEN 'hubspot_sf' ELSE 'other' END AS f_crm,
  CASE WHEN co_hiring THEN 'hiring' ELSE 'not_hiring' END AS f_hiring, {_TIME} AS f_time_on_page,
  CASE WHEN hesitation_ms > 90000 THEN 'yes' ELSE 'no' END AS f_hesitation_90s,
  CASE WHEN sessions_before_convert >= 3 THEN 'yes' ELSE 'no' END AS f_sessions_3plus,
  CASE WHEN viewed_pricing THEN 'yes' ELSE 'no' END AS f_viewed_pricing,
  CASE WHEN {_HOURS} AND utm_medium <> 'lead_form' THEN 'wkday_9-18' ELSE 'outside' END AS f_business_hours,
  CASE WHEN ip_country IS NOT NULL AND NOT coalesce(ip_country = a_country, false) THEN 'mismatch' ELSE 'match' END AS f_ip_country,
  CASE WHEN is_datacenter_ip THEN 'dc' ELSE 'residential' END AS f_ip_type, coalesce(co_sector, 'none') AS f_sector
FROM enriched""")
_NOSESSION = """(landing_url IS NULL OR time_on_page_s IS NULL OR hesitation_ms IS NULL OR sessions_before_convert IS NULL
  OR viewed_pricing IS NULL OR ip_country IS NULL OR is_datacenter_ip IS NULL OR submitted_weekday IS NULL
  OR local_submit_hour IS NULL)"""
_S2 = "coalesce(lower(trim(x.a_what_to_solve)), '')"
view("features_v2", f"""
SELECT lead_id, created_at, y, y_legacy, won_at, deal_value, label_source, mature, won_within_h, final_stage, ghosted_at_h,
  enrichment_source, co_band, x.a_job_title, a_company_size, pages_visited, a_country, form_variant, utm_medium, utm_source, utm_campaign,
  form_variant AS f_form_variant, {_SHARED},
  CASE WHEN {_NOSESSION} THEN 'yes' ELSE 'no' END AS f_session_missing,
  CASE WHEN enrichment_source IS NULL THEN 'yes' ELSE 'no' END AS f_enrichment_missing,
  coalesce(en_band, nullif(a_company_size, ''), 'missing') AS f_band,
  CASE WHEN coalesce(sim, 0) >= 0.6 THEN 'copy_paste' ELSE {sql_text_rest(_S2)} END AS f_text,
  CASE WHEN enrichment_source IS NULL THEN 'under £5k' ELSE en_spend END AS f_spend,
  CASE WHEN enrichment_source IS NOT NULL AND en_crm IN ('HubSpot','Salesforce') THEN 'hubspot_sf' ELSE 'other' END AS f_crm,
  CASE WHEN enrichment_source IS NOT NULL AND en_hiring THEN 'hiring' ELSE 'not_hiring' END AS f_hiring,
  CASE WHEN {_NOSESSION} THEN '15-60s' ELSE {_TIME} END AS f_time_on_page,
  CASE WHEN NOT {_NOSESSION} AND hesitation_ms > 90000 THEN 'yes' ELSE 'no' END AS f_hesitation_90s,
  CASE WHEN NOT {_NOSESSION} AND sessions_before_convert >= 3 THEN 'yes' ELSE 'no' END AS f_sessions_3plus,
  CASE WHEN NOT {_NOSESSION} AND viewed_pricing THEN 'yes' ELSE 'no' END AS f_viewed_pricing,
  CASE WHEN NOT {_NOSESSION} AND {_HOURS} THEN 'wkday_9-18' ELSE 'outside' END AS f_business_hours,
  CASE WHEN NOT {_NOSESSION} AND ip_country IS NOT NULL AND a_country IS NOT NULL AND ip_country <> a_country
    THEN 'mismatch' ELSE 'match' END AS f_ip_country,
  CASE WHEN NOT {_NOSESSION} AND is_datacenter_ip THEN 'dc' ELSE 'residential' END AS f_ip_type,
  coalesce(en_sector, 'missing') AS f_sector
FROM enriched x LEFT JOIN text_similarity s ON x.a_what_to_solve = s.a_what_to_solve""")

# ---- fixed demonstration weights (a frozen model, so that SQL can score too) ----
WEIGHTS = {
    "(intercept)": -1.1037, "channel=linkedin": 0.8123, "channel=meta": -0.2071, "form_variant=C": 0.3019,
    "band=51-200": 0.4187, "band=201-1000": 1.3291, "band=1000+": 1.0433, "email=free": -0.6157,
    "text=specific": 0.9311, "text=vague": -0.5239, "seniority=senior": 0.7283, "seniority=student": -1.2473,
    "spend=£100k+": 0.3541, "time_on_page=60-300s": 0.4429, "time_on_page=>600s": -0.4691,
    "sessions_3plus=yes": 0.6373, "viewed_pricing=yes": 0.5507, "search_term=brand": 0.2579,
}
VALUE_WEIGHTS = {
    "(intercept)": 11.0, "band=11-50": 0.2053, "band=51-200": 0.5147, "band=201-1000": 0.9229, "band=1000+": 1.2317,
    "sector=Software": 0.3371, "sector=Manufacturing": 0.1543, "channel=linkedin": 0.2191, "spend=£100k+": 0.4283,
}
VALUE_CORRECTION = 1.08
MARGIN = 0.3


def sql_linear(weights: dict[str, float]) -> str:
    terms = [str(weights["(intercept)"])]
    for col, w in weights.items():
        if col != "(intercept)":
            f, lvl = col.split("=", 1)
            terms.append(f"CASE WHEN f_{f} = '{lvl}' THEN {w}::DOUBLE ELSE 0 END")
    return "(" + " + ".join(terms) + ")"


view("scored", f"""
SELECT *, 1 / (1 + exp(-z)) AS p, exp(log_value) * {VALUE_CORRECTION} AS deal_value_hat,
  1 / (1 + exp(-z)) * (exp(log_value) * {VALUE_CORRECTION}) * {MARGIN} AS value,
  CASE WHEN y = 1 THEN coalesce(deal_value, 0) ELSE 0 END AS revenue,
  y IS NOT NULL AND mature AND created_at < {T_TEST_FROM} AS is_train,
  y IS NOT NULL AND mature AND created_at >= {T_TEST_FROM} AS is_test
FROM (SELECT *, round({sql_linear(WEIGHTS)}::DOUBLE, 9) AS z, {sql_linear(VALUE_WEIGHTS)}::DOUBLE AS log_value FROM features_v2)""")
view("test_rows", "SELECT * FROM scored WHERE is_test")
