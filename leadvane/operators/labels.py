"""Time-aware outcome labels."""
from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from leadvane.config import OPEN_STAGES, STAGES, LabelSpec, RunDates

DAY_MICROS = 86_400_000_000


def at(moment: str) -> Column:
    return F.lit(moment).cast("timestamp")


def elapsed_days(later: Column, earlier: Column) -> Column:
    """Whole elapsed 24-hour days, floored (not calendar days)."""
    return F.floor((F.unix_micros(later) - F.unix_micros(earlier)) / F.lit(DAY_MICROS)).cast("long")


def plus_days(moment: Column, days: int) -> Column:
    return moment + F.make_dt_interval(F.lit(days))


def false_if_null(condition: Column) -> Column:
    return F.coalesce(condition, F.lit(False))


def is_stalled(dates: RunDates) -> Column:
    idle = elapsed_days(at(dates.as_of), F.col("last_change"))
    return false_if_null(F.col("final_stage").isin(*OPEN_STAGES) & (idle >= dates.stalled_days))


def matured_at(horizon_days: int) -> Column:
    return plus_days(F.col("created_at"), horizon_days)


def is_mature(horizon_days: int, as_of: str) -> Column:
    return matured_at(horizon_days) <= at(as_of)


def ghosted_at_horizon(horizon_days: int) -> Column:
    """No recognised contact by the horizon; a lead never contacted counts as ghosted."""
    return ~false_if_null(F.col("first_contact_at") <= matured_at(horizon_days))


def legacy_label(dates: RunDates) -> Column:
    age = elapsed_days(at(dates.as_of), F.col("created_at"))
    unanswered = (F.col("final_stage") == "New") & (age >= dates.ghosted_days)
    return (F.when(F.col("final_stage") == "Won", 1.0)
            .when((F.col("final_stage") == "Lost") | is_stalled(dates) | unanswered, 0.0))


def won_within(horizon_days: int, as_of: str) -> Column:
    return (F.when(false_if_null(F.col("won_at") <= matured_at(horizon_days)), 1.0)
            .when(is_mature(horizon_days, as_of), 0.0))


def label_source(dates: RunDates, strict: bool = True) -> Column:
    """Where a lead's label comes from; first match wins. ``strict`` fails on an unrecognised final stage."""
    h = dates.horizon_days
    source = (F.when(F.col("final_stage") == "Won", "won")
              .when(F.col("final_stage") == "Lost", "crm_lost")
              .when(is_mature(h, dates.as_of) & ghosted_at_horizon(h), "ghosted")
              .when(is_stalled(dates), "stalled").otherwise("open"))
    known = false_if_null(F.col("final_stage").isin(*STAGES))
    refuse = F.raise_error(F.concat(F.lit("no recognised final CRM stage for lead "), F.col("lead_id").cast("string")))
    return F.when(known, source).otherwise(refuse.cast("string") if strict else F.lit(None).cast("string"))


def horizon_label(spec: LabelSpec, dates: RunDates) -> Column:
    """``won_within`` with ghosted and stalled zeros censored independently unless the spec keeps them."""
    y = won_within(spec.horizon_days, dates.as_of)
    censor = F.lit(False)
    if not spec.include_ghosted:
        censor = censor | ghosted_at_horizon(spec.horizon_days)
    if not spec.stalled_as_lost:
        censor = censor | is_stalled(dates)
    return F.when((y == 0.0) & censor, F.lit(None).cast("double")).otherwise(y)


def label(spec: LabelSpec, dates: RunDates) -> Column:
    return legacy_label(dates) if spec.mode == "legacy" else horizon_label(spec, dates)


def eligible(spec: LabelSpec, dates: RunDates) -> Column:
    """Rows allowed into training and evaluation: every row (legacy) or mature rows (horizon)."""
    return F.lit(True) if spec.mode == "legacy" else is_mature(spec.horizon_days, dates.as_of)


def assign_labels(df: DataFrame, spec: LabelSpec, dates: RunDates) -> DataFrame:
    """Adds ``y`` (and, for horizon labels, ``label_source``, ``matured_at``, ``won_within_h``)."""
    if spec.mode == "legacy":
        return df.withColumn("y", legacy_label(dates))
    return df.withColumns({
        "label_source": label_source(RunDates(dates.as_of, dates.test_from, spec.horizon_days, dates.stalled_days,
                                              dates.ghosted_days)),
        "matured_at": matured_at(spec.horizon_days),
        "won_within_h": won_within(spec.horizon_days, dates.as_of),
        "y": horizon_label(spec, dates),
    })


def with_split(df: DataFrame, spec: LabelSpec, dates: RunDates) -> DataFrame:
    """Adds ``is_train`` / ``is_test``: labelled eligible rows created before / from ``test_from``."""
    usable = F.col("y").isNotNull() & eligible(spec, dates)
    before = F.col("created_at") < at(dates.test_from)
    return df.withColumns({"is_train": usable & before, "is_test": usable & ~before})


def label_variants(df: DataFrame, specs: list[LabelSpec], dates: RunDates, keep: list[str]) -> DataFrame:
    """One row per (lead, label definition), all definitions evaluated in one scan."""
    variants = F.array(*[F.struct(F.lit(s.name).alias("labels"), F.lit(s.horizon_days).alias("horizon_days"),
                                  label(s, dates).alias("y"), eligible(s, dates).alias("eligible")) for s in specs])
    return df.select(*keep, F.explode(variants).alias("v")).select(*keep, "v.*")
