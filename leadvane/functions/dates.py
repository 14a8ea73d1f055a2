"""Date and number parsing and arithmetic with nulls passed through."""
from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from leadvane.operators.crm import map_lookup

# fixed values: English month names
MONTH_NAMES = ("January", "February", "March", "April", "May", "June", "July", "August", "September", "October",
               "November", "December")
_MONTHS = {k: i + 1 for i, m in enumerate(MONTH_NAMES) for k in (m.lower(), m[:3].lower())}
# Text forms accepted as ISO 8601 dates.
_ISO = r"^\d{4}-\d{2}-\d{2}([T ]\d{2}(:\d{2}(:\d{2}(\.\d+)?)?)?(Z|[+-]\d{2}:?\d{2})?)?$"


def month(moment: Column) -> Column:
    return F.date_format(moment, "yyyy-MM")


def number(text: Column) -> Column:
    """A double, null for blanks and for anything that is not a number."""
    return F.expr("double(null)") if text is None else text.try_cast("double")


def finite_number(text: Column) -> Column:
    """Like ``number`` but overflowing and infinite values are null too."""
    n = number(text)
    return F.when(~F.isnan(n) & (F.abs(n) != float("inf")), n)


def iso_timestamp(text: Column) -> Column:
    """ISO 8601 text as a UTC instant, null when it is not one."""
    return F.when(text.cast("string").rlike(_ISO), F.try_to_timestamp(text.cast("string")))


def month_number(text: Column) -> Column:
    """Month number from a number or an English month name (full or three letters, any case)."""
    parsed = F.coalesce(text.try_cast("double"), map_lookup(_MONTHS, F.lower(text)).cast("double"))
    return F.when(parsed.between(1, 12), parsed.cast("int"))


def date_from_parts(year: Column, month_: Column, day: Column) -> Column:
    """Midnight of the date, null when a part is missing or the date does not exist."""
    return F.try_make_timestamp(year.try_cast("int"), month_number(month_), day.try_cast("int"), F.lit(0), F.lit(0),
                                F.lit(0))


def minus_days(moment: Column, days: Column) -> Column:
    """A timestamp moved back by a possibly fractional number of days."""
    return F.timestamp_micros(F.unix_micros(moment) - F.round(number(days) * 86_400_000_000).cast("bigint"))


def product(values: list[Column]) -> Column:
    return reduce(lambda a, b: a * b, [number(v) for v in values])


def total(values: list[Column]) -> Column:
    return reduce(lambda a, b: a + b, [number(v) for v in values])
