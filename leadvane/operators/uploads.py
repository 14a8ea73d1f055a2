"""Upload rows of the two stages: what became due since the last run, by the ledger, in each platform's format.

A ledger row says what was sent for a lead and stage. A run compares the present state with the last row of each lead and
stage and gives only what differs, so a rerun gives nothing and a lead that is won late is sent again. Payloads are JSON
with a fixed order of fields, without null ones; identities are hashed.
"""
from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from leadvane.functions.text import normalised_email
from leadvane.operators.labels import at, elapsed_days
from leadvane.session import path_exists

# fixed values: currency, click ids by platform in order of use, and the platforms' windows in days
CURRENCY = "GBP"
GOOGLE_IDS = ("gclid", "gbraid", "wbraid")
ADJUST_DAYS, EVENT_DAYS = 90, 7
LEDGER_BUCKETS = 64

LEDGER = "platform string, lead_id bigint, stage string, kind string, value double, moment timestamp, payload string, bucket int, run string"


def hashed_email(email: Column, consent: Column) -> Column:
    """The hashed e-mail of a lead that consented, else null."""
    return F.when(consent, F.sha2(F.nullif(normalised_email(email), F.lit("")), 256))


def hashed_phone(phone: Column, consent: Column) -> Column:
    """The hash of ``+`` and the digits of a lead that consented, else null."""
    digits = F.regexp_replace(phone, "[^0-9]", "")
    return F.when(consent & (F.length(digits) > 0), F.sha2(F.concat(F.lit("+"), digits), 256))


def platform(channel: Column) -> Column:
    """The platform that a channel's values go to; null for channels without an upload."""
    return F.when(channel == "google", "google").when(channel.isin("meta", "meta_leadads"), "meta")


def match_kind(channel: Column) -> Column:
    """What an upload can match a paid lead on: the first of lead form id, click id, hashed e-mail, browser id, none."""
    click = F.coalesce(*[F.col(c) for c in (*GOOGLE_IDS, "fbclid", "li_fat_id", "oppref")])
    return (F.when((channel == "meta_leadads") & F.col("meta_lead_id").isNotNull(), "lead_form").when(click.isNotNull(), "click_id")
            .when(hashed_email(F.col("email"), F.col("consent")).isNotNull(), "email").when(F.col("fbp").isNotNull() & channel.startswith("meta"), "browser_id")
            .otherwise("none"))


def _amount(value: Column) -> Column:
    """A payload's amount: two decimals, never in exponent form."""
    return F.round(value, 2).cast("decimal(18,2)")


def google_payload(stage: Column, kind: Column, value: Column, moment: Column) -> Column:
    """A click conversion (submit, closed_won) or an adjustment of the one with the same order id (close)."""
    click = F.coalesce(*[F.when(F.col(c).isNotNull(), F.struct(F.lit(c).alias("id"), F.col(c).alias("value"))) for c in GOOGLE_IDS])
    when = F.date_format(moment, "yyyy-MM-dd HH:mm:ss'+00:00'")
    amount = F.when(kind != "RETRACTION", _amount(value))
    return F.to_json(F.struct(
        F.col("lead_id").cast("string").alias("order_id"), kind.alias("type"), when.alias("conversion_time"), amount.alias("value"),
        F.when(amount.isNotNull(), CURRENCY).alias("currency"), F.when(stage != "close", click["id"]).alias("click_id_type"),
        F.when(stage != "close", click["value"]).alias("click_id"),
        F.when(stage != "close", hashed_email(F.col("email"), F.col("consent"))).alias("hashed_email"),
        F.when(stage != "close", hashed_phone(F.col("phone"), F.col("consent"))).alias("hashed_phone")))


def meta_payload(kind: Column, value: Column, moment: Column) -> Column:
    """A server event; the click's identifier is built from its id and the lead's time."""
    fbc = F.concat(F.lit("fb.1."), F.unix_millis("created_at").cast("string"), F.lit("."), F.col("fbclid"))
    one = lambda c: F.when(c.isNotNull(), F.array(c))
    user = F.struct(fbc.alias("fbc"), F.col("fbp"), F.col("meta_lead_id").alias("lead_id"), one(hashed_email(F.col("email"), F.col("consent"))).alias("em"),
                    one(hashed_phone(F.col("phone"), F.col("consent"))).alias("ph"))
    event = F.concat(F.col("lead_id").cast("string"), F.when(kind == "ClosedWon", "-closed").otherwise(""))
    return F.to_json(F.struct(kind.alias("event_name"), event.alias("event_id"), F.unix_seconds(moment).alias("event_time"), user.alias("user_data"),
                              F.struct(_amount(value).alias("value"), F.lit(CURRENCY).alias("currency")).alias("custom_data")))


def last_sent(ledger: DataFrame) -> DataFrame:
    """platform, lead_id, stage, sent_value: the last ledger row of each lead and stage."""
    return ledger.groupBy("platform", "lead_id", "stage").agg(F.max_by("value", "run").alias("sent_value"))


def due(leads: DataFrame, ledger: DataFrame, as_of: str) -> DataFrame:
    """Rows to send at ``as_of``, in the ledger's columns but the run.

    ``leads`` has created_at, platform, upload (the submit value), value_at_close, its ts and status, and the identities. A
    submit row is due once. A close row is due when its status is known and its value is not the last one sent: a win
    restates (or, more than 90 days after the lead, goes out as a conversion of its own, closed_won), a matured lead
    retracts; an unknown amount is held. For events a win is sent within seven days of it, and nothing else.
    """
    status, close, moment = F.col("value_at_close_status"), F.col("value_at_close"), F.col("value_at_close_ts")
    google, won = F.col("platform") == "google", status.eqNullSafe("known") & (F.col("won_at") <= at(as_of))
    late = elapsed_days(moment, F.col("created_at")) > ADJUST_DAYS
    recent = elapsed_days(at(as_of), moment) <= EVENT_DAYS
    kind = (F.when(google & won & late, "CLOSED_WON").when(google & won, "RESTATEMENT").when(google, "RETRACTION")
            .when(won & recent, "ClosedWon"))
    submit = F.struct(F.lit("submit").alias("stage"), F.when(google, "CONVERSION").otherwise("Lead").alias("kind"), F.col("upload").alias("value"),
                      F.col("created_at").alias("moment"))
    closed = F.struct(F.lit("close").alias("stage"), kind.alias("kind"), close.alias("value"), moment.alias("moment"))
    rows = leads.where(F.col("platform").isNotNull() & (F.col("created_at") <= at(as_of)))
    both = rows.withColumn("s", F.explode(F.array(submit, F.when(status.eqNullSafe("known"), closed)))).select("*", "s.*").where("stage IS NOT NULL AND kind IS NOT NULL")
    sent = last_sent(ledger)
    new = both.join(sent, ["platform", "lead_id", "stage"], "left").where(
        F.col("sent_value").isNull() | ((F.col("stage") == "close") & (F.col("sent_value") != F.col("value"))))
    payload = F.when(google, google_payload(F.when(F.col("kind") == "CLOSED_WON", "closed_won").otherwise(F.col("stage")), F.col("kind"), F.col("value"), F.col("moment"))
                     ).otherwise(meta_payload(F.col("kind"), F.col("value"), F.col("moment")))
    bucket = F.pmod(F.xxhash64("lead_id"), F.lit(LEDGER_BUCKETS)).cast("int")
    return new.select("platform", "lead_id", "stage", "kind", "value", "moment", payload.alias("payload"), bucket.alias("bucket"))


def empty_ledger(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([], LEDGER)


def send(leads: DataFrame, path: str, run: str, as_of: str) -> None:
    """One run: what is due goes into the ledger at ``path`` as that run's folder; a repeated run replaces its own rows.

    The ledger is partitioned by run, then by hash of the lead. A run reads the rows of earlier runs only, so it gives the
    same rows if it fails half way and is started again.
    """
    spark = leads.sparkSession
    ledger = read_ledger(spark, path).where(F.col("run") < run)
    rows = due(leads, ledger, as_of).repartition("bucket")
    rows.write.mode("overwrite").partitionBy("bucket").parquet(f"{path}/run={run}")


def read_ledger(spark: SparkSession, path: str) -> DataFrame:
    """All rows of the ledger at ``path``; an empty one if nothing was sent yet."""
    if not path_exists(spark, path):
        return empty_ledger(spark)
    return spark.read.schema(LEDGER).option("basePath", path).parquet(path)


def held(leads: DataFrame) -> DataFrame:
    """Leads whose win has no amount: nothing is sent for them and their owner is told."""
    return leads.where("value_at_close_status = 'unknown_amount'")


def unattributable(leads: DataFrame, channel: Column, value: str, by: Sequence[Column] = ()) -> DataFrame:
    """by, match, leads, value: paid leads by what they can be matched on."""
    return leads.groupBy(*by, match_kind(channel).alias("match")).agg(F.count("*").alias("leads"), F.sum(value).alias("value"))
