"""Quotation linking: conversations without quotes, ordered by who answers whom.

A line that begins with ``>`` marks is quoted, at the level of their number. Quoted lines and a message's own lines are
normalised and hashed; a quoted line is joined to the earlier messages of its conversation that hold it as an own line.
A message answers the one that holds most of its level-1 lines. Threads follow these links to their roots by doubling.
"""
from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from leadvane.llm.common import ascii_lower, written

#: Blanks and quote marks before a line's text.
PREFIX = r"^[ \t]*(?:>[ \t]*)+"
_KEY = ("conv_id", "turn", "part")


def _normal(line: Column) -> Column:
    return F.trim(F.regexp_replace(ascii_lower(line), r"[ \t\x0B\f\r]+", " "))


def parsed_lines(messages: DataFrame) -> DataFrame:
    """conv_id, turn, part, pos, level (0: own), line (without marks), key (two hashes of the normalised line; null if blank)."""
    rows = messages.withColumn("part", F.xxhash64("role", "text"))
    rows = rows.select(*_KEY, F.posexplode(F.split(F.coalesce("text", F.lit("")), "\n", -1)).alias("pos", "raw"))
    marks = F.regexp_extract("raw", PREFIX, 0)
    rows = rows.withColumn("level", F.length(F.regexp_replace(marks, "[^>]", ""))).withColumn("line", F.when(F.col("level") > 0, F.regexp_replace("raw", PREFIX, "")).otherwise(F.col("raw")))
    normal = _normal(F.col("line"))
    return rows.select(*_KEY, "pos", "level", "line", F.when(normal != "", F.concat_ws(":", F.xxhash64(normal), F.xxhash64(F.lit("2"), normal))).alias("key"))


def quote_links(lines: DataFrame) -> DataFrame:
    """conv_id, turn, part, level, target, n: quoted lines of each level that an earlier turn of the conversation holds."""
    quoted = lines.where("level > 0 AND key IS NOT NULL").select(*_KEY, "level", "key").distinct()
    own = lines.where("level = 0 AND key IS NOT NULL").join(quoted.select("conv_id", "key").distinct(), ["conv_id", "key"], "left_semi")
    own = own.select("conv_id", F.col("turn").alias("target"), "key").distinct()
    met = quoted.join(own, ["conv_id", "key"]).where(F.col("target") < F.col("turn"))
    return met.groupBy(*_KEY, "level", "target").agg(F.count("*").alias("n"))


def roots(links: DataFrame) -> DataFrame:
    """conv_id, turn, root, depth of every turn with a parent, by pointer doubling; parents are earlier, so it ends."""
    at = written(links.select("conv_id", "turn", F.col("parent").alias("root"), F.lit(1).alias("depth")), "threads")
    while True:
        above = at.select("conv_id", F.col("turn").alias("root"), F.col("root").alias("root2"), F.col("depth").alias("depth2"))
        met = written(at.join(above, ["conv_id", "root"], "left").select("conv_id", "turn", F.coalesce("root2", "root").alias("root"),
                                                                         (F.col("depth") + F.coalesce("depth2", F.lit(0))).alias("depth"), F.col("root2").isNotNull().alias("moved")), "threads")
        if not met.where("moved").limit(1).count():
            return met.drop("moved")
        at = met.drop("moved")


def unquoted_conversations(messages: DataFrame) -> DataFrame:
    """conv_id, turn, role, body, parent_turn, root_turn, depth, n_quoted, n_linked: one row for each message, in reply order.

    ``body`` has the own lines, joined by line feeds and trimmed of blanks and line feeds at both ends. ``parent_turn`` is
    the turn that holds most level-1 quoted lines (the latest among equals), null without such a turn; ``root_turn`` is the
    end of these links, the turn itself without one. The result is sorted by (conv_id, root_turn, turn): a message stands
    behind the one that it answers, and a thread stands together. ``n_linked`` counts quoted lines of any level with an
    origin. A null text is an empty body; rows without conv_id or turn have no links; rows that repeat (conv_id, turn) are
    separate messages, and a parent turn stands for all of its rows. Blank quoted lines count in n_quoted and link to
    nothing. Other columns are ignored. An empty table gives no rows.
    """
    lines = written(parsed_lines(messages.select("conv_id", "turn", "role", "text")), "lines")
    links = quote_links(lines)
    best = Window.partitionBy(*_KEY).orderBy(F.desc("n"), F.desc("target"))
    direct = links.where("level = 1").withColumn("place", F.row_number().over(best)).where("place = 1").select(*_KEY, F.col("target").alias("parent"), "n")
    direct = written(direct, "parents")
    once = direct.groupBy("conv_id", "turn").agg(F.max("parent").alias("parent"))
    threads = roots(once)
    own = lines.groupBy(*_KEY).agg(F.array_sort(F.collect_set(F.when(F.col("level") == 0, F.struct("pos", "line")))).alias("own"), F.count(F.when(F.col("level") > 0, 1)).alias("n_quoted"))
    own = own.withColumn("body", F.regexp_replace(F.array_join(F.transform("own", lambda x: x["line"]), "\n"), r"^[ \t\r\n]+|[ \t\r\n]+$", ""))
    quoted = lines.where("level > 0 AND key IS NOT NULL").select(*_KEY, "pos", "key")
    held = lines.where("level = 0 AND key IS NOT NULL").groupBy("conv_id", "key").agg(F.min("turn").alias("earliest"))
    linked = quoted.join(held, ["conv_id", "key"]).where(F.col("earliest") < F.col("turn")).groupBy(*_KEY).agg(F.count("*").alias("n_linked"))
    rows = messages.select("conv_id", "turn", "role", F.xxhash64("role", "text").alias("part")).groupBy(*_KEY).agg(F.first("role").alias("role"), F.count("*").alias("copies"))
    same = lambda other: rows.conv_id.eqNullSafe(other.conv_id) & rows.turn.eqNullSafe(other.turn) & (rows.part == other.part)
    out = rows.join(own, same(own), "left").select(rows["*"], own.body, (own.n_quoted / rows.copies).cast("long").alias("n_quoted"))
    out = out.join(direct.select(*_KEY, F.col("parent").alias("parent_turn")), list(_KEY), "left").join(linked, list(_KEY), "left").join(threads, ["conv_id", "turn"], "left")
    out = out.select("conv_id", "turn", "role", "body", "parent_turn", F.coalesce("root", "turn").alias("root_turn"), F.coalesce("depth", F.lit(0)).alias("depth"), "n_quoted",
                     (F.coalesce("n_linked", F.lit(0)) / F.col("copies")).cast("long").alias("n_linked"), F.explode(F.sequence(F.lit(1), F.col("copies"))).alias("copy")).drop("copy")
    return out.orderBy("conv_id", "root_turn", "turn", "body")
