"""Answers, company enrichment by domain and by exact normalised name."""
from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from leadvane.config import ANSWER_KEYS, ENRICHMENT_COLUMNS
from leadvane.functions.text import normalised_company, strip
from leadvane.operators.rows import row_key


#: Rows without a key are spread over so many keys that match nothing, so that no task joins all of them.
_SPREAD = 4096


def _spread(key: Column) -> Column:
    """``key``, or where it is null one of ``_SPREAD`` keys that no company has."""
    return F.coalesce(key, F.concat(F.lit("\0"), F.pmod(F.xxhash64("lead_id"), F.lit(_SPREAD)).cast("string")))


def with_answers(leads: DataFrame) -> DataFrame:
    """``a_<key>`` columns from the answers JSON; a missing key is null. Leads that have these columns stay as they are."""
    if all(f"a_{k}" in leads.columns for k in ANSWER_KEYS):
        return leads
    parsed = leads.withColumn("_answers", F.from_json("answers", "map<string,string>"))
    return parsed.withColumns({f"a_{k}": F.try_element_at("_answers", F.lit(k)) for k in ANSWER_KEYS}).drop("_answers")


def join_by_domain(leads: DataFrame, companies: DataFrame) -> DataFrame:
    """``co_<column>`` from the company with the lead's normalised domain (left, many to one).

    No broadcast hint: the company table grows, so Spark decides from its measured size and AQE splits a hot domain.
    """
    dim = companies.select(F.lower("domain").alias("dom"),
                           *[F.col(c).alias(f"co_{c}") for c in ENRICHMENT_COLUMNS]).where("dom is not null")
    leads = leads.withColumn("dom", F.lower(strip(F.col("company_domain"))))
    return leads.withColumn("_dom", _spread(F.col("dom"))).join(dim.withColumnRenamed("dom", "_dom"), "_dom", "left").drop("_dom")


def company_name_index(companies: DataFrame) -> DataFrame:
    """Normalised name -> enrichment columns, only for names that belong to exactly one company."""
    keyed = companies.select(normalised_company(F.col("company_name")).alias("name_key"), *ENRICHMENT_COLUMNS)
    return (keyed.where("name_key is not null").groupBy("name_key")
            .agg(F.count("*").alias("n"), *[F.first(c).alias(c) for c in ENRICHMENT_COLUMNS])
            .where("n = 1").drop("n"))


def join_by_name(leads: DataFrame, companies: DataFrame) -> DataFrame:
    """``enrichment_source`` and ``en_<column>``: the domain row, else the row of the first typed name that matches.

    A domain hit means its employee band is filled. Only rows the domain missed carry a join key.
    """
    missed = F.col("co_employee_band").isNull()
    index = company_name_index(companies)
    out = leads
    for i, typed in enumerate(("company_name", "a_company")):
        unmatched = missed if i == 0 else missed & F.col("_found0").isNull()
        side = index.select(F.col("name_key").alias(f"_key{i}"), F.struct(*ENRICHMENT_COLUMNS).alias(f"_found{i}"))
        out = (out.withColumn(f"_key{i}", _spread(F.when(unmatched, normalised_company(F.col(typed)))))
               .join(side, f"_key{i}", "left").drop(f"_key{i}"))
    return _with_source(out, F.col("_found0"), F.col("_found1"))


def _with_source(df: DataFrame, *names: Column) -> DataFrame:
    """``enrichment_source`` and ``en_<column>`` by the domain's row, else the first of the rows found by name."""
    missed, found = F.col("co_employee_band").isNull(), F.coalesce(*names)
    return df.withColumns({
        "enrichment_source": F.when(~missed, "domain").when(found.isNotNull(), "name"),
        **{f"en_{c}": F.when(~missed, F.col(f"co_{c}")).otherwise(found[c]) for c in ENRICHMENT_COLUMNS},
    }).drop("_found0", "_found1")


def _lookup_keys() -> list[Column]:
    """A lead's domain and its two typed names as keys of one lookup, marked by a letter; null without a value."""
    names = [normalised_company(F.col(c)) for c in ("company_name", "a_company")]
    return [F.concat(F.lit("d"), F.lower(strip(F.col("company_domain")))), *[F.concat(F.lit("n"), n) for n in names]]


def company_matches(leads: DataFrame, companies: DataFrame) -> DataFrame:
    """For every lead that names a company, by ``row_key``: what its domain and its names find. Only keys are dealt, no whole leads.

    The rows found by a key travel as one text (see ``_found_rows``).
    """
    row = F.array(*[F.col(c).cast("string") for c in ENRICHMENT_COLUMNS]).alias("row")
    domains = (companies.select(F.concat(F.lit("d"), F.lower("domain")).alias("key"), row).where("key is not null")
               .groupBy("key").agg(F.to_json(F.sort_array(F.collect_list("row"))).alias("rows")))
    names = company_name_index(companies).select(F.concat(F.lit("n"), "name_key").alias("key"), F.to_json(F.array(row)).alias("rows"))
    keys = with_answers(leads).select(row_key(F.col("lead_id")).alias("_row"), F.explode(F.array(*_lookup_keys())).alias("key"))
    hits = keys.where("key is not null").join(domains.unionByName(names), "key")
    return hits.groupBy("_row").agg(F.map_from_entries(F.collect_set(F.struct("key", "rows"))).alias("_hits"))


def _found_rows(text: Column, types: dict[str, str]) -> Column:
    """The company rows, by the columns of ``types``, that a text of ``company_matches`` holds."""
    return F.transform(F.from_json(text, "array<array<string>>"),
                       lambda row: F.struct(*[F.get(row, F.lit(i)).cast(kind).alias(c) for i, (c, kind) in enumerate(types.items())]))


def enrich(leads: DataFrame, companies: DataFrame, keyed: DataFrame | None = None) -> DataFrame:
    """Everything known about a lead when it is submitted.

    Lookups are made on keys alone and brought to the leads by one join, so the leads move once, or not at all after another
    join by ``row_key``. ``keyed`` are rows that hold all of ``leads`` and are cheaper to compute, such as the leads before
    any join. A stream cannot meet its own lookups; its batches are joined whole.
    """
    if leads.isStreaming:
        return join_by_name(join_by_domain(with_answers(leads), companies), companies)
    found = company_matches(leads if keyed is None else keyed, companies)
    out = with_answers(leads).join(found, row_key(F.col("lead_id")) == F.col("_row"), "left").drop("_row")

    types = dict(companies.select(*ENRICHMENT_COLUMNS).dtypes)
    domain, *names = [_found_rows(F.try_element_at("_hits", key), types) for key in _lookup_keys()]
    out = out.withColumn("dom", F.lower(strip(F.col("company_domain"))))
    out = out.withColumns({"_domain": F.coalesce(domain, F.array(F.lit(None))), **{f"_found{i}": F.get(n, F.lit(0)) for i, n in enumerate(names)}})
    out = out.drop("_hits").withColumn("_company", F.explode("_domain")).drop("_domain")
    out = out.withColumns({f"co_{c}": F.col("_company")[c] for c in ENRICHMENT_COLUMNS}).drop("_company")
    return _with_source(out, F.col("_found0"), F.col("_found1"))
