"""CRM event history -> one outcome row per lead."""
from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from leadvane.config import STAGE_SPELLINGS, STAGES
from leadvane.operators.rows import row_key


def map_lookup(values: dict, key: Column) -> Column:
    """``values[key]`` as a literal map lookup; null where the key is null or unlisted."""
    pairs = [F.lit(x) for kv in values.items() for x in kv]
    return F.try_element_at(F.create_map(*pairs), key)


def canonical_stage(stage: Column) -> Column:
    """Canonical stage of a CRM spelling (any case), null when unknown."""
    return map_lookup(STAGE_SPELLINGS, F.lower(stage))


def with_stage(crm: DataFrame) -> DataFrame:
    return crm.withColumn("stage_n", canonical_stage(F.col("stage")))


def lead_outcomes(crm: DataFrame) -> DataFrame:
    """Last stage, last change, win attributes and first contact per lead in one partial-aggregated pass.

    The last row wins even when its stage is unrecognised; events at one instant rank by funnel position.
    """
    funnel = F.coalesce(F.array_position(F.array(*[F.lit(s) for s in STAGES]), F.col("stage_n")), F.lit(99))
    won = F.col("stage_n") == "Won"
    last = F.max(F.struct("changed_at", funnel.alias("pos"), "stage_n"))
    return (with_stage(crm).groupBy("lead_id")
            .agg(last.alias("last"),
                 F.max(F.when(won, F.col("deal_value"))).alias("deal_value"),
                 F.max(F.when(won, F.col("changed_at"))).alias("won_at"),
                 F.min(F.when(F.col("stage_n") != "New", F.col("changed_at"))).alias("first_contact_at"),
                 F.count(F.when(won, 1)).alias("n_won"))
            .select("lead_id", F.col("last.stage_n").alias("final_stage"), F.col("last.changed_at").alias("last_change"),
                    "deal_value", "won_at", "first_contact_at", "n_won"))


def multiple_wins(crm: DataFrame) -> DataFrame:
    """Leads with two or more Won rows, which make the deal value ambiguous."""
    return lead_outcomes(crm).where("n_won > 1").select("lead_id", "n_won")


def add_crm_outcomes(leads: DataFrame, crm: DataFrame) -> DataFrame:
    """Leads with their CRM outcome columns; a lead with two Won rows fails the job."""
    keyed = crm.where("lead_id is not null").withColumn("lead_id", row_key(F.col("lead_id")))
    checked = lead_outcomes(keyed).withColumn(
        "won_at", F.when(F.col("n_won") > 1, F.raise_error(F.concat(
            F.lit("lead with more than one Won row: "), F.col("lead_id").cast("string"))).cast("timestamp"))
        .otherwise(F.col("won_at")))
    side = checked.drop("n_won").withColumnRenamed("lead_id", "_row")
    out = leads.join(side, row_key(F.col("lead_id")) == F.col("_row"), "left").drop("_row")
    return out.select("lead_id", *[c for c in out.columns if c != "lead_id"])
