"""Production monitors: level drift against a stored baseline, rates on a gapless calendar, runs of bad days, volume rule.

Everything after the first aggregation has one row for each series and calendar step, however many leads there are; windows
run over those rows only.
"""
from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from leadvane.operators.design import unpivot

# fixed values: limits of the monitors
PSI_WARN, PSI_ALERT = 0.10, 0.25
RATE_TIMES, RATE_PLUS, BAD_DAYS = 2.0, 0.10, 2
BOT_MOVE, MEAN_MOVE, MEDIAN_MOVE = 0.50, 0.20, 0.25
MAX_OVER_MEDIAN, CAP_SHARE = 10.0, 0.06
ACCEPT, CONDITIONAL = (2000, 400), (1000, 200)

#: A level outside the declared ones counts under this name.
OTHER = "(other)"


def _levels(df: DataFrame, features: Mapping[str, Sequence[str]], keep: Sequence[str]) -> DataFrame:
    """keep, feature, level: one row for each lead and feature; undeclared and missing levels are ``OTHER``."""
    known = [F.when(F.col(f).isin(*levels), F.col(f)).otherwise(OTHER).alias(f) for f, levels in features.items()]
    return unpivot(df.select(*keep, *known), keep, list(features))


def level_baseline(train: DataFrame, features: Mapping[str, Sequence[str]]) -> DataFrame:
    """feature, level, share of the training leads, for every declared level and ``OTHER``; the table to store with a model.

    Shares count half a lead for each level, so a level without training leads keeps a small positive share.
    """
    counts = _levels(train, features, []).groupBy("feature", "level").agg(F.count("*").alias("n"))
    declared = train.sparkSession.createDataFrame([(f, lvl, len(levels) + 1) for f, levels in features.items() for lvl in (*levels, OTHER)],
                                                  "feature string, level string, n_levels int")
    rows = declared.join(counts, ["feature", "level"], "left").withColumn("n", F.coalesce("n", F.lit(0)))
    total = F.sum("n").over(Window.partitionBy("feature"))
    return rows.select("feature", "level", ((F.col("n") + 0.5) / (total + 0.5 * F.col("n_levels"))).alias("share"))


def level_drift(df: DataFrame, period: Column, baseline: DataFrame, features: Mapping[str, Sequence[str]]) -> DataFrame:
    """period, feature, leads, psi, status: population stability of each feature's levels in each period.

    The sum of (a - b) ln(a / b) over all levels, b the baseline's share and a that of the period with one lead dealt
    out by the baseline: a level without leads gives a finite term, and one that neither side knows gives almost none.
    """
    counts = _levels(df.withColumn("period", period), features, ["period"]).groupBy("period", "feature", "level").agg(F.count("*").alias("n"))
    totals = counts.groupBy("period", "feature").agg(F.sum("n").alias("leads"))
    grid = totals.join(baseline, "feature").join(counts, ["period", "feature", "level"], "left")
    a = (F.coalesce("n", F.lit(0)) + F.col("share")) / (F.col("leads") + 1)
    psi = grid.groupBy("period", "feature", "leads").agg(F.sum((a - F.col("share")) * F.ln(a / F.col("share"))).alias("psi"))
    return psi.withColumn("status", F.when(F.col("psi") > PSI_ALERT, "alert").when(F.col("psi") > PSI_WARN, "warn").otherwise("ok"))


def daily_rates(df: DataFrame, day: Column, series: Mapping[str, tuple[Column, Column]]) -> DataFrame:
    """monitor, part, day, n, bad: leads and flagged leads of each monitor, part and day.

    ``series`` maps a monitor to the column that parts it and its flag; a null part leaves the lead out.
    """
    cells = F.array(*[F.struct(F.lit(name).alias("monitor"), part.cast("string").alias("part"), flag.cast("boolean").alias("flag")) for name, (part, flag) in series.items()])
    rows = df.select(day.alias("day"), F.explode(cells).alias("c")).select("day", "c.*").where("part IS NOT NULL")
    return rows.groupBy("monitor", "part", "day").agg(F.count("*").alias("n"), F.count_if("flag").alias("bad"))


def on_calendar(rates: DataFrame, keys: Sequence[str] = ("monitor", "part")) -> DataFrame:
    """``rates`` with a row for every day between a series' first and last; days without leads have n = bad = 0."""
    span = rates.groupBy(*keys).agg(F.min("day").alias("a"), F.max("day").alias("b"))
    days = span.select(*keys, F.explode(F.sequence("a", "b")).alias("day"))
    return days.join(rates, [*keys, "day"], "left").withColumns({c: F.coalesce(c, F.lit(0)).cast("long") for c in ("n", "bad")})


def with_rolling(rates: DataFrame, days: int = 28, keys: Sequence[str] = ("monitor", "part")) -> DataFrame:
    """Adds ``rolling``: the flagged share of the ``days`` calendar days before each day (null without leads in them)."""
    before = Window.partitionBy(*keys).orderBy("day").rowsBetween(-days, -1)
    n = F.sum("n").over(before)
    return rates.withColumn("rolling", F.when(n > 0, F.sum("bad").over(before) / n))


def breaches(rate: Column, expected: Column) -> Column:
    """Whether a rate is more than twice the expected one or 10 points above it; false where either is unknown."""
    return F.coalesce((rate > RATE_TIMES * expected) | (rate > expected + RATE_PLUS), F.lit(False))


def with_runs(rows: DataFrame, bad: str, keys: Sequence[str] = ("monitor", "part")) -> DataFrame:
    """Adds ``run``: how many days in a row up to this one were ``bad`` (0 where it was not). Rows have no missing day."""
    order = Window.partitionBy(*keys).orderBy("day")
    island = F.count_if(~F.col(bad)).over(order)
    return rows.withColumn("_island", island).withColumn("run", F.sum(F.col(bad).cast("long")).over(
        Window.partitionBy(*keys, "_island").orderBy("day"))).drop("_island")


def rate_alerts(rates: DataFrame, expected: DataFrame, rolling_days: int = 28) -> DataFrame:
    """Every calendar day of ``rates`` with its rate, the expected and the rolling one, breach, run and alert.

    ``expected`` has monitor, part and expected. An alert is the second bad day in a row and each one after it.
    """
    rows = with_rolling(on_calendar(rates), rolling_days).join(expected, ["monitor", "part"], "left")
    rate = F.when(F.col("n") > 0, F.col("bad") / F.col("n"))
    rows = rows.withColumn("rate", rate).withColumn("breach", breaches(F.col("rate"), F.col("expected")))
    return with_runs(rows, "breach").withColumn("alert", F.col("run") >= BAD_DAYS)


def expected_rates(train: DataFrame, series: Mapping[str, tuple[Column, Column]]) -> DataFrame:
    """monitor, part, expected: flagged shares of the training leads."""
    rates = daily_rates(train, F.lit(0), series)
    return rates.select("monitor", "part", (F.col("bad") / F.col("n")).alias("expected"))


def moved(value: Column, base: Column, share: float) -> Column:
    """Whether ``value`` is more than ``share`` away from ``base``, relative to it; false where either is unknown."""
    return F.coalesce(F.abs(value - base) > share * base, F.lit(False))


def weekly_calendar(rows: DataFrame) -> DataFrame:
    """``rows`` (one for each week with leads) and the weeks between them, with ``previous_p50`` of the week before."""
    span = rows.agg(F.min("week").alias("a"), F.max("week").alias("b")).where("a IS NOT NULL")
    weeks = span.select(F.explode(F.sequence("a", "b", F.expr("interval 7 days"))).alias("week"))
    last = rows.select(F.date_add("week", 7).alias("week"), F.col("p50").alias("previous_p50"))
    return weeks.join(rows, "week", "left").join(last, "week", "left").withColumn("leads", F.coalesce("leads", F.lit(0)).cast("long"))


def volume_verdict(rows_a_year: Column, wins_a_year: Column) -> Column:
    """accept, conditional or decline, from labelled rows and wins a year."""
    reaches = lambda limits: (rows_a_year >= limits[0]) & (wins_a_year >= limits[1])
    return F.when(reaches(ACCEPT), "accept").when(reaches(CONDITIONAL), "conditional").otherwise("decline")
