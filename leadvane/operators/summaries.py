"""Grouped summary tables: level rates, coverage, detectors, volumes, side-by-side comparisons."""
from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from leadvane.config import CLICK_ID_COLUMNS, DAYS_PER_MONTH, PAID_CHANNELS
from leadvane.operators.labels import at

# fixed values: minimum conversions per window of the two bidding products
THRESHOLDS = {"google": (30.0, 30), "meta": (50.0, 7)}


def level_table(df: DataFrame, features: Mapping[str, Sequence[str]], decided: Column, won: Column) -> DataFrame:
    """Decided rows and win rate per declared level of each feature, declared order, empty levels kept."""
    cells = F.array(*[F.struct(F.lit(f).alias("feature"), F.col(f).alias("level")) for f in features])
    long = df.where(decided).select(won.cast("double").alias("won"), F.explode(cells).alias("c")).select("won", "c.*")
    counts = long.groupBy("feature", "level").agg(F.count("*").alias("decided"), F.avg("won").alias("win_rate"))
    declared = df.sparkSession.createDataFrame([(f, lvl, i) for f, levels in features.items() for i, lvl in enumerate(levels)],
                                               "feature string, level string, position int")
    return declared.join(counts, ["feature", "level"], "left").withColumn("decided", F.coalesce("decided", F.lit(0)).cast("bigint"))


def detector_counts(flag: Column, truth: Column) -> list[Column]:
    """tp, fp, fn, precision and recall of a boolean detector as aggregate columns."""
    tp, fp, fn = F.count_if(flag & truth), F.count_if(flag & ~truth), F.count_if(~flag & truth)
    return [tp.alias("tp"), fp.alias("fp"), fn.alias("fn"), F.try_divide(tp, tp + fp).alias("precision"),
            F.try_divide(tp, tp + fn).alias("recall")]


def identifier_coverage(leads: DataFrame, channel: Column) -> DataFrame:
    """Per paid channel and two totals: leads and the share with each kind of identifier."""
    click = F.coalesce(*CLICK_ID_COLUMNS).isNotNull()
    form = F.col("meta_lead_id").isNotNull()
    groups = F.array(F.col("channel"), F.when(F.col("channel") != "meta_leadads", "landing-page paid"), F.lit("all paid"))
    long = leads.withColumn("channel", channel).where(F.col("channel").isin(*PAID_CHANNELS)).select(
        click.alias("click"), form.alias("form"), F.col("fbp").isNotNull().alias("fbp"), F.col("email").isNotNull().alias("email"),
        F.col("phone").isNotNull().alias("phone"), F.explode(F.filter(groups, lambda g: g.isNotNull())).alias("channel"))
    none = ~F.col("click") & ~F.col("form")
    share = {"click_id": F.col("click"), "lead_form_id": F.col("form"), "no_id_fbp": none & F.col("fbp"), "no_id": none,
             "email_present": F.col("email"), "phone_present": F.col("phone")}
    return long.groupBy("channel").agg(F.count("*").alias("leads"), *[F.avg(c.cast("double")).alias(n) for n, c in share.items()])


def monthly_volumes(leads: DataFrame, channel: Column, as_of: str) -> DataFrame:
    """Leads per month of each (platform, campaign) over the twelve months before ``as_of``."""
    platform = F.when(channel == "google", "google").when(channel.isin("meta", "meta_leadads"), "meta")
    recent = leads.where(F.col("created_at") > F.add_months(at(as_of), -12).cast("timestamp")).withColumn("platform", platform)
    return (recent.where("platform is not null and utm_campaign is not null").groupBy("platform", "utm_campaign")
            .agg((F.count("*") / 12).alias("leads_per_month")))


def eligibility(volumes: DataFrame, positive_rate: Column) -> DataFrame:
    """Conversions per platform window at both stages, threshold flags and the close-stage shortfall."""
    minimum = F.when(F.col("platform") == "google", THRESHOLDS["google"][0]).otherwise(THRESHOLDS["meta"][0])
    days = F.when(F.col("platform") == "google", THRESHOLDS["google"][1]).otherwise(THRESHOLDS["meta"][1])
    v = volumes.withColumn("submit_conversions", F.col("leads_per_month") * days / F.lit(DAYS_PER_MONTH))
    v = v.withColumn("close_conversions", F.col("submit_conversions") * positive_rate)
    return v.withColumns({
        "submit_ok": F.col("submit_conversions") >= minimum, "close_ok": F.col("close_conversions") >= minimum,
        "close_shortfall": F.when(F.col("close_conversions") > 0, minimum / F.col("close_conversions")).otherwise(float("inf"))})


def side_by_side(a: DataFrame, b: DataFrame) -> DataFrame:
    """Two (level, decided, win_rate) tables aligned by level: shares, rates and absolute gaps in points."""
    def shares(df: DataFrame, name: str) -> DataFrame:
        total = df.agg(F.sum("decided")).scalar()
        return df.select("level", (F.col("decided") / total).alias(f"{name}_share"), F.col("win_rate").alias(f"{name}_win"))
    out = shares(a, "a").join(shares(b, "b"), "level", "full_outer")
    return out.withColumns({"d_share_pp": F.abs(F.col("b_share") - F.col("a_share")) * 100,
                            "d_win_pp": F.abs(F.col("b_win") - F.col("a_win")) * 100})


def table_mismatches(a: DataFrame, b: DataFrame, key: str, values: Sequence[str], tolerance: float) -> DataFrame:
    """Keys missing from either table and cells that differ by more than the tolerance."""
    left, right = a.select(key, F.struct(*values).alias("_a")), b.select(key, F.struct(*values).alias("_b"))
    joined = left.join(right, key, "full_outer")
    cells = F.array(*[F.struct(F.lit(v).alias("column"), F.col(f"_a.{v}").cast("double").alias("a"),
                               F.col(f"_b.{v}").cast("double").alias("b")) for v in values])
    kind = F.when(F.col("_b").isNull(), "missing").when(F.col("_a").isNull(), "unexpected").otherwise("differs")
    long = joined.select(key, kind.alias("problem"), F.explode(cells).alias("c")).select(key, "problem", "c.*")
    return long.where((F.col("problem") != "differs") | (F.abs(F.col("a") - F.col("b")) > tolerance))


def group_shares(df: DataFrame, flag: str, category: str) -> DataFrame:
    """Category distribution of a flagged subgroup against the rest, with the absolute gap."""
    counts = df.groupBy(flag, category).agg(F.count("*").alias("n"))
    totals = counts.groupBy(flag).agg(F.sum("n").alias("total"))
    share = counts.join(totals, flag).select(flag, category, (F.col("n") / F.col("total")).alias("share"))
    wide = share.groupBy(category).agg(F.coalesce(F.max(F.when(F.col(flag), F.col("share"))), F.lit(0.0)).alias("flagged"),
                                       F.coalesce(F.max(F.when(~F.col(flag), F.col("share"))), F.lit(0.0)).alias("rest"))
    return wide.withColumn("gap", F.abs(F.col("flagged") - F.col("rest")))
