"""Bucketed feature columns: the legacy set and the v2 set with explicit missing-input indicators."""
from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from leadvane.config import LEVELS, MAJOR_CRMS, MISSING, ORDERED_LEVELS, ABSENT_WHEN, SESSION_INPUTS, WEEKEND
from leadvane.functions import text
from leadvane.operators.crm import map_lookup


def _yes(condition: Column, yes: str = "yes", no: str = "no") -> Column:
    """``yes`` where the condition holds, ``no`` where it is false or unknown."""
    return F.when(condition, yes).otherwise(no)


def time_bucket(seconds: Column, missing: str) -> Column:
    return (F.when(seconds < 60, "15-60s").when(seconds < 300, "60-300s").when(seconds < 600, "300-600s")
            .when(seconds >= 600, ">600s").otherwise(missing))


def business_hours() -> Column:
    weekday = ~F.coalesce(F.col("submitted_weekday").isin(*WEEKEND), F.lit(False))
    return weekday & F.coalesce(F.col("local_submit_hour").between(9, 17), F.lit(False))


def session_absent() -> Column:
    """No usable on-site session: no landing page or any telemetry input blank."""
    absent = F.col("landing_url").isNull()
    for c in SESSION_INPUTS:
        absent = absent | F.col(c).isNull()
    return absent


def _shared() -> dict[str, Column]:
    return {
        "email": text.email_type(F.col("email_l")),
        "seniority": text.seniority(F.col("a_job_title")),
        "hesitation_90s": _yes(F.col("hesitation_ms") > 90000),
        "sessions_3plus": _yes(F.col("sessions_before_convert") >= 3),
        "viewed_pricing": _yes(F.col("viewed_pricing")),
        "ip_type": _yes(F.col("is_datacenter_ip"), "dc", "residential"),
        "c_budget": F.coalesce("a_budget", F.lit("not_asked")),
        "c_timeline": F.coalesce("a_timeline", F.lit("not_asked")),
        "edits_1_4": _yes(F.col("field_edit_count").between(1, 4)),
    }


def legacy_features(df: DataFrame) -> DataFrame:
    """The legacy set: missing inputs fall into the reference levels. Domain enrichment only."""
    ch = text.channel(F.col("utm_medium"), F.col("utm_source"))
    typed_size = F.nullif(F.col("a_company_size"), F.lit(""))
    differs = F.col("ip_country").isNotNull() & ~F.coalesce(F.col("ip_country") == F.col("a_country"), F.lit(False))
    return df.withColumns({
        **_shared(),
        "channel": ch,
        "no_company": F.when(F.col("co_employee_band").isNull(), "yes").otherwise("no"),
        "band": F.coalesce(F.col("co_employee_band"), typed_size, F.lit("1-10")),
        "text": text.text_class(F.col("a_what_to_solve")),
        "spend": F.coalesce("co_monthly_ad_spend_band", F.lit("under £5k")),
        "crm": _yes(F.col("co_crm_platform").isin(*MAJOR_CRMS), "hubspot_sf", "other"),
        "hiring": _yes(F.col("co_is_hiring"), "hiring", "not_hiring"),
        "time_on_page": time_bucket(F.col("time_on_page_s"), "15-60s"),
        "search_term": text.search_term(ch, F.col("utm_term")),
        "business_hours": _yes(business_hours() & (ch != "meta_leadads"), "wkday_9-18", "outside"),
        "ip_country": _yes(differs, "mismatch", "match"),
        "sector": F.coalesce("co_sector", F.lit("none")),
    })


def v2_features(df: DataFrame) -> DataFrame:
    """The v2 set: absent sessions and absent enrichment go to reference levels and are carried by indicators."""
    ch = text.channel(F.col("utm_medium"), F.col("utm_source"))
    no_session, no_enrichment = session_absent(), F.col("enrichment_source").isNull()
    shared = _shared()

    def unless(absent: Column, feature: str, value: Column) -> Column:
        return F.when(absent, LEVELS[feature][0]).otherwise(value)

    mismatch = F.coalesce(F.col("ip_country") != F.col("a_country"), F.lit(False))
    session_values = {
        "time_on_page": time_bucket(F.col("time_on_page_s"), ">600s"),
        "hesitation_90s": shared["hesitation_90s"], "sessions_3plus": shared["sessions_3plus"],
        "viewed_pricing": shared["viewed_pricing"], "ip_type": shared["ip_type"],
        "business_hours": _yes(business_hours(), "wkday_9-18", "outside"),
        "ip_country": _yes(mismatch, "mismatch", "match"),
    }
    company_values = {
        "spend": F.col("en_monthly_ad_spend_band"),
        "crm": _yes(F.col("en_crm_platform").isin(*MAJOR_CRMS), "hubspot_sf", "other"),
        "hiring": _yes(F.col("en_is_hiring"), "hiring", "not_hiring"),
    }
    typed_size = F.nullif(F.col("a_company_size"), F.lit(""))
    return df.withColumns({
        **{k: v for k, v in shared.items() if k not in session_values},
        **{k: unless(no_session, k, v) for k, v in session_values.items()},
        **{k: unless(no_enrichment, k, v) for k, v in company_values.items()},
        "channel": ch,
        "session_missing": _yes(no_session),
        "enrichment_missing": _yes(no_enrichment),
        "band": F.coalesce(F.col("en_employee_band"), typed_size, F.lit(MISSING)),
        "text": text.text_class_v2(F.col("a_what_to_solve")),
        "search_term": text.search_term(ch, F.col("utm_term")),
        "sector": F.coalesce("en_sector", F.lit(MISSING)),
    })


def ordinal_features(df: DataFrame, features: tuple[str, ...]) -> DataFrame:
    """Rank of ordered features (null when absent), level index of the others, in ``o_<feature>`` columns."""
    out = {}
    for f in features:
        order = ORDERED_LEVELS.get(f, LEVELS[f])
        rank = map_lookup({lvl: float(i) for i, lvl in enumerate(order)}, F.col(f))
        if f in ABSENT_WHEN:
            rank = F.when(F.col(ABSENT_WHEN[f]) == "no", rank)
        out[f"o_{f}"] = rank
    return df.withColumns(out)


def interactions(df: DataFrame) -> DataFrame:
    """The two interaction columns of the hardening study."""
    large = F.col("band").isin("51-200", "201-1000", "1000+")
    return df.withColumns({
        "linkedin_x_51plus": ((F.col("channel") == "linkedin") & large).cast("double"),
        "senior_x_formD": ((F.col("seniority") == "senior") & (F.col("form_variant") == "D")).cast("double"),
    })
