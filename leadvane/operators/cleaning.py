"""Bot and repeat-submission flags."""
from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from leadvane.config import BOT_MIN_TIME_ON_PAGE_S
from leadvane.functions.text import normalised_email
from leadvane.operators.rows import row_key


def is_bot(user_agent: Column, time_on_page_s: Column) -> Column:
    """Headless user agent, or under the minimum time on the page; missing inputs are not evidence."""
    headless = F.coalesce(F.lower(user_agent).contains("headless"), F.lit(False))
    return headless | F.coalesce(time_on_page_s < BOT_MIN_TIME_ON_PAGE_S, F.lit(False))


def flag_repeats(df: DataFrame, key: str, order: list[str], flag: str = "dup") -> DataFrame:
    """True on every row but the first per ``key`` by ``order``; null keys, and rows without a time, are never repeats.

    ``order`` begins with the time: a row that lacks it is not the first of its key either.

    The first row per key comes from a partial aggregate and goes to the row it names (the last of ``order``), so only
    narrow rows are dealt by ``key``: ``df`` moves once, by ``row_key``, as in the other joins that add to a row.
    """
    timed, (*times, row) = F.col(order[0]).isNotNull(), order
    first = (df.where(F.col(key).isNotNull() & timed).groupBy(key)
             .agg(F.min(F.struct(*order)).alias("_first"))
             .select(F.col(key).alias("_key"), F.struct(*[F.col("_first")[c].alias(c) for c in times]).alias("_times"),
                     row_key(F.col("_first")[row]).alias("_row")))
    # coalesce() keeps the second test out of the join key, so that the rows are dealt by their id alone
    same = (row_key(F.col(row)) == F.col("_row")) & F.coalesce(F.col(key) == F.col("_key"), F.lit(False))
    is_first = F.coalesce(F.struct(*times) == F.col("_times"), F.lit(False))
    # there are about as many first rows as rows, so they are dealt, never broadcast on an estimate made before any join
    return (df.join(first.hint("merge"), same, "left")
            .withColumn(flag, F.col(key).isNotNull() & timed & ~is_first)
            .drop("_key", "_times", "_row"))


def flag_bots_and_repeats(leads: DataFrame) -> DataFrame:
    """Adds ``email_l``, ``bot`` and ``dup``; repeats are counted over all rows, bots included."""
    df = (leads.withColumn("email_l", normalised_email(F.col("email")))
          .withColumn("bot", is_bot(F.col("user_agent"), F.col("time_on_page_s"))))
    return flag_repeats(df, "email_l", ["created_at", "lead_id"])


def clean(leads: DataFrame) -> DataFrame:
    """Leads without bots and repeat submissions."""
    return flag_bots_and_repeats(leads).where(~F.col("bot") & ~F.col("dup"))
