"""Checks as violation tables ``(check_id, column, key, message)``, and gates that refuse a dataset."""
from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from leadvane.config import ANSWER_OPTIONS
from leadvane.functions.dates import finite_number, iso_timestamp
from leadvane.functions.text import strip
from leadvane.operators.ranking import smallest_per_group

Check = tuple[str, str, Column, Column]  # id, column, failing condition, message


def blank(c: Column) -> Column:
    return c.isNull() | (strip(c.cast("string")) == "")


def row_violations(df: DataFrame, key: str, checks: Sequence[Check]) -> DataFrame:
    """All row-level checks in one scan."""
    cells = [F.when(F.coalesce(bad, F.lit(False)), F.struct(F.lit(i).alias("check_id"), F.lit(c).alias("column"),
                                                            msg.cast("string").alias("message")))
             for i, c, bad, msg in checks]
    failed = F.filter(F.array(*cells), lambda v: v.isNotNull())
    return df.select(F.col(key).cast("string").alias("key"), F.explode(failed).alias("v")).select(
        "v.check_id", "v.column", "key", "v.message")


def missing_columns(df: DataFrame, required: Sequence[str]) -> list[str]:
    return [c for c in required if c not in df.columns]


def date_checks(column: str) -> list[Check]:
    c = F.col(column)
    return [("blank_date", column, blank(c), F.lit("no date")),
            ("bad_date", column, ~blank(c) & iso_timestamp(c).isNull(), c)]


def number_check(column: str) -> Check:
    c = F.col(column)
    return "bad_number", column, ~blank(c) & finite_number(strip(c)).isNull(), c


def boolean_check(column: str) -> Check:
    c = F.col(column)
    return "bad_boolean", column, ~blank(c) & ~F.lower(strip(c.cast("string"))).isin("true", "false"), c


def level_check(column: str, allowed: Sequence[str], check_id: str = "unknown_level") -> Check:
    c = F.col(column)
    return check_id, column, ~blank(c) & ~c.isin(*allowed), c


def hour_check(column: str) -> Check:
    n = finite_number(F.col(column).cast("string"))
    return "bad_hour", column, n.isNotNull() & ~n.between(0, 23), F.col(column)


def json_object_check(column: str) -> Check:
    """Not a JSON object; blank counts as the empty object."""
    c = F.col(column)
    return "bad_json", column, ~blank(c) & (F.coalesce(F.from_json(c, "map<string,string>").isNull(), F.lit(True))
                                            | ~strip(c).startswith("{")), c


def answer_checks(column: str, options: Mapping[str, Sequence[str]] = ANSWER_OPTIONS, may_be_empty: Sequence[str] = ("company_size",)) -> list[Check]:
    """An answer of the JSON object in ``column`` outside the options of its key; an absent key is fine."""
    answers = F.from_json(F.col(column), "map<string,string>")

    def check(key: str, allowed: Sequence[str]) -> Check:
        given = F.try_element_at(answers, F.lit(key))
        listed = given.isin(*allowed, *([""] if key in may_be_empty else []))
        return "unlisted_answer", f"{column}.{key}", given.isNotNull() & ~listed, given
    return [check(key, allowed) for key, allowed in options.items()]


def repeated_keys(df: DataFrame, key: str, lower: bool = False) -> DataFrame:
    """Keys on more than one row, counted with map-side combine."""
    value = F.lower(strip(F.col(key).cast("string"))) if lower else F.col(key).cast("string")
    return df.where(~blank(F.col(key))).groupBy(value.alias("key")).agg(F.count("*").alias("n")).where("n > 1")


def require_unique(df: DataFrame, key: str, what: str) -> None:
    example = repeated_keys(df, key).limit(5).collect()
    if example:
        raise ValueError(f"{what}: key {key!r} repeats, e.g. {sorted(r['key'] for r in example)}")


def without_match(left: DataFrame, right: DataFrame, on: str) -> DataFrame:
    return left.join(right.select(on).distinct(), on, "left_anti")


def require_complete(leads: DataFrame, extras: DataFrame) -> DataFrame:
    """Extras joined to leads after checking that each side covers the other."""
    for side, a, b in (("leads without extra features", leads, extras), ("extra features without a lead", extras, leads)):
        lost = without_match(a, b, "lead_id").select("lead_id").limit(5).collect()
        if lost:
            raise ValueError(f"{side}, e.g. {[r['lead_id'] for r in lost]}")
    return leads.join(extras, "lead_id")


def require_rows(df: DataFrame, minimum: int, what: str) -> None:
    n = df.limit(minimum).count()
    if n < minimum:
        raise ValueError(f"only {n} {what}; at least {minimum} are needed")


def require_clean(violations: DataFrame) -> None:
    """The gate: fails with one example per check."""
    found = violations.groupBy("check_id", "column").agg(F.count("*").alias("n"), F.min("key").alias("key")).collect()
    if found:
        raise ValueError("; ".join(f"{r['check_id']} on {r['column']}: {r['n']} rows, e.g. {r['key']}" for r in found))


def violation_examples(violations: DataFrame, n: int = 5) -> DataFrame:
    """Row count and the first ``n`` keys of every check."""
    totals = violations.groupBy("check_id").agg(F.count("*").alias("rows"))
    first = smallest_per_group(violations.select("check_id", "key"), "check_id", ["key"], n)
    listed = first.groupBy("check_id").agg(F.array_join(F.array_sort(F.collect_list("key")), ",").alias("examples"))
    return totals.join(listed, "check_id")


def check_rules(rules: dict, form_variants: Sequence[str]) -> list[str]:
    """Problems of a benchmark rules document: missing bases, thresholds out of order, tiers that do not cover 0."""
    problems = [f"form variant {v} has no base value" for v in form_variants if v not in rules["base_value_by_form"]]
    score = rules["lead_score"]
    for name, key in (("tiers", "min_points"), ("pages_visited_points", "min_pages")):
        steps = [s[key] for s in score[name]]
        if steps != sorted(steps, reverse=True):
            problems.append(f"{name} are not listed high to low")
    if not score["tiers"] or score["tiers"][-1]["min_points"] > 0:
        problems.append("tiers do not cover a score of 0")
    return problems
