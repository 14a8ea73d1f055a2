"""Explicit schemas of every table the jobs read or write."""
from __future__ import annotations

from pyspark.sql import types as T

_TYPES = {"string": T.StringType(), "double": T.DoubleType(), "long": T.LongType(), "bool": T.BooleanType(),
          "ts": T.TimestampType()}


def _schema(spec: str) -> T.StructType:
    fields = [f.strip().split(":") for f in spec.split(",")]
    return T.StructType([T.StructField(n, _TYPES[t]) for n, t in fields])


LEADS = _schema(
    "lead_id:string, created_at:ts, form_variant:string, answers:string, email:string, phone:string, name:string, "
    "company_name:string, company_domain:string, consent:bool, utm_source:string, utm_medium:string, "
    "utm_campaign:string, utm_content:string, fbclid:string, fbc:string, fbp:string, gclid:string, gbraid:string, "
    "wbraid:string, li_fat_id:string, oppref:string, meta_lead_id:string, landing_url:string, time_on_page_s:double, "
    "fields_edited:string, field_edit_count:double, hesitation_ms:double, pasted_text:bool, returned_visitor:bool, "
    "device:string, ip:string, user_agent:string, pages_visited:double, utm_term:string, referrer:string, "
    "ip_country:string, ip_city:string, is_datacenter_ip:bool, timezone:string, browser_language:string, "
    "local_submit_hour:double, submitted_weekday:string, sessions_before_convert:double, "
    "days_since_first_visit:double, viewed_pricing:bool, scroll_depth_pct:double")
CRM = _schema("lead_id:string, stage:string, comment:string, deal_value:double, changed_at:ts")
COMPANIES = _schema(
    "company_name:string, domain:string, sector:string, employee_band:string, country:string, hq_city:string, "
    "annual_revenue_band:string, founded_year:long, funding_stage:string, crm_platform:string, "
    "monthly_ad_spend_band:string, ad_platforms:string, is_hiring:bool, open_roles:long")
PEOPLE = _schema(
    "email:string, age_band:string, household_income_band:string, country:string, region:string, city:string, "
    "job_title:string, seniority:string, department:string, years_in_role:double, is_homeowner:bool, "
    "match_confidence:double")
JUDGMENTS = _schema(
    "lead_id:string, is_real_business:string, persona:string, problem_specificity:string, urgency:string, "
    "brief_fit:string, reason:string, status:string, error:string, card_hash:string, brief_hash:string, "
    "prompt_version:string, model_id:string")
DATASET_DATES = _schema("as_of:string, test_from:string, currency:string")

LEAD_COLUMNS = tuple(LEADS.fieldNames())
BOOL_COLUMNS = tuple(f.name for f in LEADS if isinstance(f.dataType, T.BooleanType))
WHOLE_NUMBER_COLUMNS = ("field_edit_count", "local_submit_hour", "sessions_before_convert", "pages_visited",
                        "days_since_first_visit")
NUMBER_COLUMNS = tuple(f.name for f in LEADS if isinstance(f.dataType, T.DoubleType))
REQUIRED_LEAD_COLUMNS = ("lead_id", "created_at", "answers", "form_variant", "email", "company_domain", "utm_source",
                         "utm_medium", "utm_term", "landing_url", "time_on_page_s", "hesitation_ms", "ip_country",
                         "sessions_before_convert", "viewed_pricing", "is_datacenter_ip", "submitted_weekday",
                         "local_submit_hour", "field_edit_count", "user_agent", "pages_visited")
