"""Joins that add columns to leads: the leads move once, and rows without or with repeated ids come out as from whole joins."""
from collections import Counter
from datetime import datetime

from leadvane.catalog.features import score
from leadvane.operators import cleaning, crm, enrichment
from leadvane.sources.bindings import Tables

LEADS = "lead_id long, company_domain string, company_name string, answers string"
COMPANIES = ("company_name string, domain string, sector string, employee_band string, country string, crm_platform string, "
             "monthly_ad_spend_band string, is_hiring boolean")


def company(name, domain, sector, band="1-10"):
    return name, domain, sector, band, None, "HubSpot", "none", True


def test_scored_leads_are_dealt_once(spark):
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        plan = score(Tables(spark, "/root/testdata/sf0.001")).select("lead_id", "p", "y", "landing_url")._jdf.queryExecution().executedPlan()
        dealt = [line for line in plan.toString().splitlines() if "Exchange hashpartitioning(coalesce(cast(lead_id" in line]
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert len(dealt) == 1
    assert plan.toString().count("Exchange hashpartitioning(email_l") == 1  # the e-mails alone, not the leads
    assert "hashpartitioning(_dom" not in plan.toString() and "hashpartitioning(_key0" not in plan.toString()


def test_enrich_equals_whole_joins_on_odd_rows(spark):
    rows = [(1, "Acme.example", "Other Ltd", '{"company": "Typed Ltd"}'), (1, "bolt.example", None, "{}"), (1, "bolt.example", None, "{}"),
            (None, " acme.example ", None, "{}"), (None, None, "Solo GmbH", "{}"), (2, None, "Nobody", '{"company": "Solo Ltd"}'),
            (3, "bandless.example", "Solo", "{}"), (4, None, None, "{}"), (5, "twice.example", None, "{}"), (6, None, "Same Ltd", "{}")]
    companies = spark.createDataFrame([
        company("Acme", "acme.example", "a"), company("Bolt", "BOLT.example", "b"), company("Solo", "solo.example", "s"),
        company("Bandless", "bandless.example", "n", None), company("Twice A", "twice.example", "t1"), company("Twice B", "twice.example", "t2"),
        company("Same", None, "x"), company("Same", None, "y")], COMPANIES)
    leads = spark.createDataFrame(rows, LEADS)
    whole = enrichment.join_by_name(enrichment.join_by_domain(enrichment.with_answers(leads), companies), companies)
    got = enrichment.enrich(leads, companies)
    assert set(got.columns) == set(whole.columns)
    assert Counter(map(tuple, got.select(whole.columns).collect())) == Counter(map(tuple, whole.collect()))
    assert Counter(map(tuple, enrichment.enrich(leads.where("lead_id = 5"), companies, keyed=leads).select("lead_id", "en_sector").collect())) == {
        (5, "t1"): 1, (5, "t2"): 1}


def test_repeats_with_null_and_repeated_ids(spark):
    rows = [("a", 2, 1), ("a", 1, None), ("a", 1, 7), ("b", 3, 1), ("b", 3, 1), ("b", 4, 1), (None, 1, 1), ("c", None, 2), ("c", 5, 2), ("d", None, None)]
    df = spark.createDataFrame(rows, "k string, at long, id long")
    got = Counter((r["k"], r["at"], r["id"], r["dup"]) for r in cleaning.flag_repeats(df, "k", ["at", "id"]).collect())

    def order(row):
        return row[1], row[2] is not None, row[2] or 0
    first = {k: min(order(r) for r in rows if r[0] == k and r[1] is not None) for k in ("a", "b", "c")}
    assert got == Counter((*r, r[0] is not None and r[1] is not None and order(r) != first[r[0]]) for r in rows)


def test_outcomes_of_rows_without_id(spark):
    leads = spark.createDataFrame([(1, "x"), (1, "y"), (None, "z")], "lead_id long, name string")
    events = spark.createDataFrame([(1, "Won", 5.0, datetime(2024, 1, 2)), (None, "Lost", None, datetime(2024, 1, 3))],
                                   "lead_id long, stage string, deal_value double, changed_at timestamp")
    got = {(r["lead_id"], r["name"], r["final_stage"], r["deal_value"]) for r in crm.add_crm_outcomes(leads, events).collect()}
    assert got == {(1, "x", "Won", 5.0), (1, "y", "Won", 5.0), (None, "z", None, None)}
