"""Views of the test tables (orders, customers, events, documents...) in the lead, CRM and company schemas.

Orders play the leads, customers the companies; columns the order tables lack are key arithmetic on the order and
customer keys, so every view grows with its table. All expressions are Spark SQL text.
"""
from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from leadvane.config import BOILERPLATE_SNIPPETS, RunDates
from leadvane.operators.asof import carry_last

ORDERS_DATES = RunDates(as_of="2001-06-01", test_from="2000-01-01")
EVENTS_AS_OF = "2024-01-28"

_ANSWERS = {
    "country": "if(k % 17 = 0, null, n_name)",
    "what_to_solve": f"""case k % 10 when 0 then 'pricing' when 1 then 'We need 25 seats before Q3'
        when 2 then '{BOILERPLATE_SNIPPETS[0]}' when 3 then null when 4 then 'Our funnel is slow and hard to track'
        when 5 then '  Tell me more ' when 6 then 'our mission is to empower teams'
        when 7 then '{BOILERPLATE_SNIPPETS[1]}' when 8 then 'Team of 12, budget agreed'
        else concat('Looking at ', lower(o_orderpriority)) end""",
    "job_title": """case k % 9 when 0 then 'Student intern' when 1 then 'CEO' when 2 then 'Marketing Manager'
        when 3 then 'Data analyst' when 4 then 'VP Sales' when 5 then ' ' when 6 then null when 7 then 'Team Lead'
        else 'Head of Growth' end""",
    "company_size": """case k % 7 when 0 then '1-10' when 1 then '11-50' when 2 then '51-200' when 3 then '201-1000'
        when 4 then '1000+' when 5 then '' else null end""",
    "budget": """case k % 6 when 1 then 'Under £5k' when 2 then '£5k-£20k' when 3 then '£20k-£50k' when 4 then '£50k+'
        else null end""",
    "timeline": """case k % 5 when 0 then 'This month' when 1 then 'This quarter' when 2 then 'Next 6 months'
        when 3 then 'Just researching' else null end""",
    "company": "if(k % 4 = 1, concat(shown_name, ' Ltd.'), null)",
}
_EMAIL = """concat('u', c, '.', k % 13, '@', case c % 5 when 0 then 'gmail.example' when 1 then 'outlook.example'
    else concat('customer', c, '.example') end)"""
_SOURCE = """case o_orderpriority when '1-URGENT' then 'google' when '2-HIGH' then 'facebook'
    when '3-MEDIUM' then 'linkedin' when '5-LOW' then 'chatgpt' else null end"""
_LEAD = {
    "lead_id": "k",
    "created_at": "cast(o_orderdate as timestamp)",
    "form_variant": "element_at(array('A', 'B', 'C', 'D'), cast(k % 4 as int) + 1)",
    "answers": "to_json(named_struct({}))".format(", ".join(f"'{n}', {e}" for n, e in _ANSWERS.items())),
    "email": f"case when k % 29 = 0 then null when k % 3 = 0 then concat('  ', upper({_EMAIL})) else {_EMAIL} end",
    "phone": "if(k % 6 = 0, null, concat('+44 20 7946 ', lpad(k % 10000, 4, '0')))",
    "name": "c_name",
    "company_name": "if(k % 2 = 0, concat(shown_name, ' Ltd'), null)",
    "company_domain": """case when k % 5 = 0 then null when k % 7 = 0 then concat(' CUSTOMER', c, '.example ')
        else concat('customer', c, '.example') end""",
    "consent": "k % 2 = 0",
    "utm_source": _SOURCE,
    "utm_medium": "if(k % 23 = 0, 'lead_form', 'cpc')",
    "utm_campaign": "concat('cmp-', k % 6)",
    "utm_term": "case k % 4 when 0 then 'Northstar crm' when 1 then 'crm tool' else null end",
    "fbclid": "if(o_orderpriority = '2-HIGH' and k % 4 <> 0, concat('fb', k), null)",
    "fbp": "if(o_orderpriority = '2-HIGH' and k % 5 <> 0, concat('fbp', k), null)",
    "gclid": "if(o_orderpriority = '1-URGENT' and k % 3 <> 0, concat('g', k), null)",
    "gbraid": "if(o_orderpriority = '1-URGENT' and k % 9 = 0, concat('gb', k), null)",
    "wbraid": "cast(null as string)",
    "li_fat_id": "if(o_orderpriority = '3-MEDIUM' and k % 2 = 0, concat('li', k), null)",
    "oppref": "if(o_orderpriority = '5-LOW' and k % 7 = 0, concat('op', k), null)",
    "meta_lead_id": "if(k % 23 = 0 and k % 46 <> 0, concat('ml', k), null)",
    "landing_url": "if(k % 31 = 0, null, concat('https://site.example/', k % 8))",
    "time_on_page_s": "if(k % 19 = 0, null, cast(k * 13 % 900 as double))",
    "field_edit_count": "cast(k % 8 as double)",
    "hesitation_ms": "if(k % 53 = 0, null, cast(k * 7919 % 200000 as double))",
    "user_agent": "case when k % 43 = 0 then 'Mozilla/5.0 HEADLESSchrome' when k % 47 = 0 then null else 'Mozilla/5.0' end",
    "pages_visited": "if(k % 11 = 0, null, cast(k % 8 as double))",
    "ip_country": "case when k % 59 = 0 then null when k % 8 = 3 then 'NATION_99' else n_name end",
    "is_datacenter_ip": "k % 41 = 0",
    "local_submit_hour": "cast(k * 5 % 24 as double)",
    "submitted_weekday": """element_at(array('Monday', 'Tuesday', 'Wednesday', 'Thursday', 'Friday', 'Saturday',
        'Sunday'), cast(k % 7 as int) + 1)""",
    "sessions_before_convert": "cast(if(o_orderstatus = 'F', 1 + k % 5, k % 4) as double)",
    "viewed_pricing": "if(k % 37 = 0, null, k % 3 = 0 or (o_orderstatus = 'F' and k % 5 < 2))",
}
_SHOWN_NAME = "if(c % 50 = 1, 'Shared Holdings', c_name)"
_COMPANY = {
    "company_name": f"concat({_SHOWN_NAME}, ' GmbH')",
    "domain": "concat('Customer', c, '.example')",
    "sector": """case c_mktsegment when 'HOUSEHOLD' then 'Retail' when 'MACHINERY' then 'Manufacturing'
        when 'BUILDING' then 'Professional services' when 'AUTOMOBILE' then 'Logistics' else 'Software' end""",
    "employee_band": """case c % 6 when 0 then '1-10' when 1 then '11-50' when 2 then '51-200' when 3 then '201-1000'
        when 4 then '1000+' else null end""",
    "country": "n_name",
    "crm_platform": "case c % 4 when 1 then 'HubSpot' when 2 then 'Salesforce' else 'Pipedrive' end",
    "monthly_ad_spend_band": """case c % 5 when 0 then 'none' when 1 then 'under £5k' when 2 then '£5k-£25k'
        when 3 then '£25k-£100k' else '£100k+' end""",
    "is_hiring": "if(c % 10 = 9, null, c_acctbal > 3000)",
}


_SCHEMAS: dict[str, T.StructType] = {}
_SPLITS: dict[str, int] = {}
_ROW_KEYS = {"orders": ["o_orderkey"], "lineitem": ["l_orderkey", "l_linenumber", "l_partkey"], "events": ["event_id"],
             "documents": ["doc_id"], "conversations": ["conv_id", "turn"]}


class Tables:
    """The parquet tables of one scale-factor folder and their lead-schema views."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.sf_dir = spark, sf_dir

    def table(self, name: str) -> DataFrame:
        """One raw table, zone-less timestamps read as UTC instants. Its schema is looked up once per process."""
        path = f"{self.sf_dir}/{name}.parquet"
        if path not in _SCHEMAS:
            _SCHEMAS[path] = self.spark.read.parquet(path).schema
        df = self.spark.read.schema(_SCHEMAS[path]).parquet(path)
        df = df.select([F.col(c).cast("timestamp").alias(c) if t == "timestamp_ntz" else F.col(c)
                        for c, t in df.dtypes])
        return self._spread(df, path, name) if name in _ROW_KEYS else df

    def _spread(self, df: DataFrame, path: str, name: str) -> DataFrame:
        """A table stored in fewer splits than there are cores is hashed by key over them; larger ones stay as read."""
        cores = self.spark.sparkContext.defaultParallelism
        if path not in _SPLITS:
            _SPLITS[path] = df.rdd.getNumPartitions()
        return df if _SPLITS[path] >= cores else df.repartition(cores, *_ROW_KEYS[name])

    def _orders(self) -> DataFrame:
        orders = self.table("orders").withColumns({"k": F.col("o_orderkey"), "c": F.col("o_custkey")})
        customer = self.table("customer").select("c_custkey", "c_name", "c_nationkey")
        nation = self.table("nation").select("n_nationkey", "n_name")
        # Left joins on foreign keys: only the dimension side may be broadcast, the orders stay spread.
        people = customer.join(nation, F.col("c_nationkey") == F.col("n_nationkey"), "left")
        return (orders.join(people, F.col("c") == F.col("c_custkey"), "left")
                .withColumn("shown_name", F.expr(_SHOWN_NAME)))

    def leads(self) -> DataFrame:
        """One lead per order."""
        return self._orders().select([F.expr(e).alias(n) for n, e in _LEAD.items()])

    def companies(self) -> DataFrame:
        """Three of four customers as the company dimension."""
        customer, nation = self.table("customer"), self.table("nation")
        joined = customer.join(nation, F.col("c_nationkey") == F.col("n_nationkey")).withColumn("c", F.col("c_custkey"))
        return joined.where("c % 4 <> 0").select([F.expr(e).alias(n) for n, e in _COMPANY.items()])

    def crm(self, as_of: str = ORDERS_DATES.as_of) -> DataFrame:
        """New, Contacted and final events of every order, later events than ``as_of`` left out."""
        orders = self.table("orders").selectExpr(
            "o_orderkey as k", "o_orderdate as created", "o_orderstatus as s", "o_totalprice as price",
            "if(o_orderkey % 8 <> 0, o_orderdate + make_dt_interval(cast(o_orderkey * 37 % 150 as int)), null) as contacted")
        final = orders.selectExpr(
            "*", """case when s = 'F' then 'closed WON' when s = 'P' then 'lost'
                    when k % 8 <> 0 and k % 3 = 1 then 'Qualified' end as final_stage""",
            """greatest(created + make_dt_interval(cast(k * 53 % 240 as int)),
                        contacted + interval 1 second) as final_at""")
        events = final.select("k", "created", F.expr("""explode(array(
            named_struct('stage', 'New', 'deal_value', cast(null as double), 'changed_at', created),
            named_struct('stage', 'Contacted', 'deal_value', cast(null as double), 'changed_at', contacted),
            named_struct('stage', final_stage,
                         'deal_value', if(s = 'F' and k % 12 <> 0, price, null), 'changed_at', final_at)))""").alias("e"))
        return (events.where("e.stage is not null and e.changed_at is not null")
                .where(f"e.stage = 'New' or e.changed_at <= timestamp'{as_of}'")
                .selectExpr("k as lead_id", "e.stage", "cast(null as string) as comment", "e.deal_value",
                            "e.changed_at"))

    def people(self) -> DataFrame:
        """A vendor-person row per customer with an even key, keyed by the first e-mail spelling of that customer."""
        return self.table("customer").withColumn("c", F.col("c_custkey")).where("c % 2 = 0").selectExpr(
            "concat('u', c, '.1@', case c % 5 when 0 then 'gmail.example' when 1 then 'outlook.example' "
            "else concat('customer', c, '.example') end) as email",
            "element_at(array('18-24', '25-34', '35-44', '45-54', '55-64', '65+'), cast(c % 6 as int) + 1) as age_band")

    def event_leads(self) -> DataFrame:
        """The events stream in the lead schema: every signup opens a lead."""
        return self.table("events").where("event_type = 'signup'").selectExpr(
            "event_id as lead_id", "ts as created_at", "user_id", "value", "props")

    def event_stages(self) -> DataFrame:
        """Every event attached to its user's latest signup, with the CRM stage it stands for."""
        signup = F.when(F.col("event_type") == "signup", F.col("event_id"))
        events = carry_last(self.table("events"), "user_id", F.date_trunc("day", "ts"), ["ts", "event_id"], signup, "lead_id")
        return events.where("lead_id is not null").selectExpr(
            "lead_id", "event_id", "user_id", "ts as changed_at",
            "case event_type when 'signup' then 'New' when 'view' then 'Contacted' when 'click' then 'Qualified' "
            "when 'error' then 'Lost' else 'Won' end as stage",
            "if(event_type = 'purchase', value, null) as deal_value")
