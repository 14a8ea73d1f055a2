"""Whole leads and company rows that travel as one text come back as they were."""
from datetime import datetime

from leadvane.catalog.features import score
from leadvane.operators import enrichment, rows
from leadvane.sources.bindings import Tables
from test_narrow_joins import COMPANIES, LEADS, company


def test_scored_leads_travel_as_one_text(spark):
    plan = score(Tables(spark, "/root/testdata/sf0.001")).select("lead_id", "p", "y", "landing_url")._jdf.queryExecution().executedPlan().toString().splitlines()
    packing = [line for line in plan if " AS _packed#" in line]
    assert len(packing) == 1
    before, after = packing[0].split("Project [")[1].split(" AS _packed#")
    alone = before.split("invoke(")[0] + after
    assert "lead_id#" in alone and "email_l#" in alone and "landing_url" not in alone and "a_country" not in alone


def test_packed_rows_come_back(spark):
    kinds = "id long, s string, t string, d double, b boolean, n long, at timestamp"
    data = [(1, "a", "", 0.1, True, 2 ** 62, datetime(2024, 1, 2, 3, 4, 5, 678)), (2, ' "q", [x]\\ \n\t\u2028\x00é', None, 1e-300, False, -1, None),
            (None, None, "null", float("inf"), None, None, datetime(1999, 12, 31)), (4, ",", "NaN", None, True, 0, None), (4, "", "\\", -0.0, None, 7, None)]
    df = spark.createDataFrame(data, kinds)
    rest = [c for c in df.columns if c != "id"]
    packed = rows.packed(df, ["id", "s"], rest)
    assert len(packed.columns) == 3
    back = rows.unpacked(packed, rest, dict(df.dtypes)).select(df.columns)
    assert back.dtypes == df.dtypes
    assert sorted(map(repr, back.collect())) == sorted(map(repr, df.collect()))


def test_company_rows_travel_as_text_and_come_back(spark):
    companies = spark.createDataFrame([company('A "quoted", [one]', "a.example", "x, [y]", None), company("B", "b.example", None)], COMPANIES)
    leads = spark.createDataFrame([(1, "a.example", None, "{}"), (2, "b.example", None, "{}"), (3, None, 'a "quoted" one ltd', "{}")], LEADS)
    assert dict(enrichment.company_matches(leads, companies).dtypes)["_hits"] == "map<string,string>"
    got = {r["lead_id"]: (r["co_sector"], r["co_employee_band"], r["co_is_hiring"], r["en_sector"], r["en_is_hiring"]) for r in enrichment.enrich(leads, companies).collect()}
    assert got == {1: ("x, [y]", None, True, None, None), 2: (None, "1-10", True, None, True), 3: (None, None, None, "x, [y]", True)}
