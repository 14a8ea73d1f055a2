"""Queries: joins, grouped summaries, samples and set operations."""
from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from leadvane.catalog.base import query, view
from leadvane.catalog.features import legacy, scored
from leadvane.catalog.metrics import sql_hash
from leadvane.catalog.outcomes import ORDERS_DATES, cleaned
from leadvane.catalog.views import FMT, SQL_CHANNEL, T_AS_OF, T_TEST_FROM, sql_text_class, sql_tokens
from leadvane.config import BEHAVIOURAL_FEATURES, DAYS_PER_MONTH, LEVELS
from leadvane.functions import text
from leadvane.operators import (cleaning, design, judgments, labels, quality, ranking, similarity, summaries, value)
from leadvane.schemas import LEAD_COLUMNS
from leadvane.sources.bindings import _LEAD, Tables


# ---- joins ----
@query("J7_orders_without_lines", "SELECT o_orderkey FROM orders WHERE o_orderkey NOT IN (SELECT l_orderkey FROM lineitem)")
def orders_without_lines(t: Tables) -> DataFrame:
    return quality.without_match(t.table("orders").select(F.col("o_orderkey").alias("k")),
                                 t.table("lineitem").select(F.col("l_orderkey").alias("k")), "k").select(
        F.col("k").alias("o_orderkey"))


@query("J7_referential_integrity", """
SELECT 'crm_without_lead' AS check_id, count(*) AS n FROM crm WHERE lead_id NOT IN (SELECT lead_id FROM flagged WHERE NOT bot AND NOT dup)
UNION ALL SELECT 'lead_without_lines', count(*) FROM leads WHERE lead_id NOT IN (SELECT l_orderkey FROM lineitem)""")
def referential_integrity(t: Tables) -> DataFrame:
    orphans = quality.without_match(t.crm(), cleaning.clean(t.leads()), "lead_id")
    bare = quality.without_match(t.leads(), t.table("lineitem").select(F.col("l_orderkey").alias("lead_id")), "lead_id")
    return (orphans.agg(F.count("*").alias("n")).select(F.lit("crm_without_lead").alias("check_id"), "n")
            .unionByName(bare.agg(F.count("*").alias("n")).select(F.lit("lead_without_lines").alias("check_id"), "n")))


@query("J5_complete_extras", """
SELECT lead_id, c_mktsegment AS x_segment, round(c_acctbal, 2) AS x_balance FROM leads
JOIN orders ON o_orderkey = lead_id JOIN customer ON c_custkey = o_custkey""")
def complete_extras(t: Tables) -> DataFrame:
    return quality.require_complete(t.leads().select("lead_id"), extras_table(t)).select(
        "lead_id", "x_segment", F.round("x_balance", 2).alias("x_balance"))


def extras_table(t: Tables) -> DataFrame:
    """Declared extra columns of every lead: market segment, customer balance, price, ship mode of the first line."""
    customer = t.table("customer").select("c_custkey", "c_mktsegment", "c_acctbal")
    return (t.table("orders").join(customer, F.col("o_custkey") == F.col("c_custkey"), "left")
            .select(F.col("o_orderkey").alias("lead_id"), F.col("c_mktsegment").alias("x_segment"),
                    F.col("c_acctbal").alias("x_balance"), F.col("o_orderpriority").alias("x_priority"),
                    F.when(F.col("o_orderkey") % 9 != 0, F.floor(F.col("o_totalprice") / 100000)).cast("double").alias("x_price_step"),
                    F.when(F.col("o_orderstatus") == "F", F.lit("closed")).alias("x_status_text")))


view("word_pairs", f"""
SELECT doc_id, item_id, len(list_intersect(a, b)) / (len(a) + len(b) - len(list_intersect(a, b)))::DOUBLE AS similarity
FROM (SELECT doc_id, {sql_tokens('text')} AS a FROM documents) CROSS JOIN (SELECT item_id, {sql_tokens('text')} AS b FROM benchmark)
WHERE len(list_intersect(a, b)) > 0""")


@query("J8_best_snippet_similarity", """
SELECT d.doc_id, round(coalesce(max(similarity), 0), 6) AS similarity FROM documents d LEFT JOIN word_pairs USING (doc_id) GROUP BY d.doc_id""")
def best_snippet_similarity(t: Tables) -> DataFrame:
    out = similarity.best_snippet_similarity(t.table("documents"), t.table("benchmark"), "doc_id", "item_id")
    return out.select("doc_id", F.round("similarity", 6).alias("similarity"))


@query("J8_similar_pairs", "SELECT doc_id, item_id, round(similarity, 6) AS similarity FROM word_pairs WHERE similarity >= 0.2")
def similar_pairs(t: Tables) -> DataFrame:
    out = similarity.snippet_similarity(t.table("documents"), t.table("benchmark"), "doc_id", "item_id", minimum=0.2)
    return out.select(F.col("t_id").alias("doc_id"), F.col("s_id").alias("item_id"), F.round("similarity", 6).alias("similarity"))


@query("U3_token_set_sizes", f"""
SELECT l_doc AS doc_id, item_id, len(list_intersect(a, b))::BIGINT AS shared, (len(a) + len(b) - len(list_intersect(a, b)))::BIGINT AS united
FROM (SELECT doc_id AS l_doc, {sql_tokens('text')} AS a, doc_id % (SELECT max(item_id) + 1 FROM benchmark) AS partner FROM documents)
JOIN (SELECT item_id, {sql_tokens('text')} AS b FROM benchmark) ON partner = item_id""")
def token_set_sizes(t: Tables) -> DataFrame:
    snippets = t.table("benchmark").select("item_id", text.tokens(F.col("text")).alias("b"))
    size = snippets.agg(F.max("item_id") + 1).scalar()
    docs = t.table("documents").select("doc_id", text.tokens(F.col("text")).alias("a"), (F.col("doc_id") % size).alias("item_id"))
    return docs.join(snippets, "item_id").select(
        "doc_id", "item_id", F.size(F.array_intersect("a", "b")).cast("bigint").alias("shared"),
        F.size(F.array_union("a", "b")).cast("bigint").alias("united"))


@query("J11_person_match", """
WITH people AS (SELECT 'u' || c_custkey || '.1@' || CASE c_custkey % 5 WHEN 0 THEN 'gmail.example' WHEN 1 THEN 'outlook.example'
    ELSE 'customer' || c_custkey || '.example' END AS email, ['18-24','25-34','35-44','45-54','55-64','65+'][(c_custkey % 6 + 1)::INT] AS age_band
  FROM customer WHERE c_custkey % 2 = 0)
SELECT coalesce(age_band, 'no vendor match') AS age_band, count(*) AS leads FROM flagged LEFT JOIN people ON lower(people.email) = email_l GROUP BY ALL""")
def person_match(t: Tables) -> DataFrame:
    leads = t.leads().withColumn("email_l", text.normalised_email(F.col("email")))
    people = t.people().select(F.lower("email").alias("email_l"), "age_band")
    return leads.join(people, "email_l", "left").groupBy(
        F.coalesce("age_band", F.lit("no vendor match")).alias("age_band")).agg(F.count("*").alias("leads"))


view("labelled_docs", f"""
SELECT d.doc_id, d.text, d.n_chars, d.lang, d.source, l.quality, l.toxic, {sql_text_class('d.text')} AS text_class
FROM documents d JOIN labels l USING (doc_id)""")


def labelled_docs(t: Tables) -> DataFrame:
    return t.table("documents").join(t.table("labels"), "doc_id").withColumn("text_class", text.text_class(F.col("text")))


@query("J12_predictions_with_truth", "SELECT doc_id, text_class, quality, toxic FROM labelled_docs")
def predictions_with_truth(t: Tables) -> DataFrame:
    return labelled_docs(t).select("doc_id", "text_class", "quality", "toxic")


def _cards(t: Tables) -> DataFrame:
    messages = t.table("conversations")
    fields = judgments.card_fields(F.col("text"), [F.lit(None).cast("string"), F.col("role")], F.lit(" "),
                                   F.concat(F.lit("x@y@"), F.upper("role"), F.lit(".Example")))
    return messages.select("conv_id", "turn", *[v.alias(k) for k, v in fields.items()], judgments.card_text(fields).alias("card"))


view("cards", """
SELECT conv_id, turn, CASE WHEN trim(text, E' \\t\\n\\r') = '' OR text IS NULL THEN '(blank)' ELSE trim(text, E' \\t\\n\\r') END AS what_to_solve,
  role AS company_typed, '(blank)' AS job_title, lower(role) || '.example' AS email_domain FROM conversations""")
view("hashed_cards", """
SELECT conv_id, turn, sha256('What they want to solve: ' || what_to_solve || chr(10) || 'Company typed: ' || company_typed || chr(10)
  || 'Job title: ' || job_title || chr(10) || 'Email domain: ' || email_domain) AS card_hash FROM cards""")


@query("F18_lead_card", "SELECT conv_id, turn, what_to_solve, company_typed, job_title, email_domain FROM cards")
def lead_card(t: Tables) -> DataFrame:
    return _cards(t).drop("card")


@query("F17_card_hash", """
SELECT conv_id, turn, card_hash, sha256('["' || card_hash || '", "brief1", "v1"]') AS cache_key FROM hashed_cards""")
def card_hash(t: Tables) -> DataFrame:
    h = F.sha2("card", 256)
    return _cards(t).select("conv_id", "turn", h.alias("card_hash"), judgments.cache_key([h, F.lit("brief1"), F.lit("v1")]).alias("cache_key"))


@query("J13_cached_and_missing", """
WITH cache AS (SELECT DISTINCT card_hash FROM hashed_cards WHERE conv_id % 2 = 0)
SELECT 'hit' AS kind, count(*) AS n FROM hashed_cards WHERE card_hash IN (SELECT card_hash FROM cache)
UNION ALL SELECT 'request', count(DISTINCT card_hash) FROM hashed_cards WHERE card_hash NOT IN (SELECT card_hash FROM cache)""")
def cached_and_missing(t: Tables) -> DataFrame:
    keyed = _cards(t).select("conv_id", F.sha2("card", 256).alias("cache_key"))
    hits, misses = judgments.split_requests(keyed, keyed.where("conv_id % 2 = 0"))
    return (hits.agg(F.count("*").alias("n")).select(F.lit("hit").alias("kind"), "n")
            .unionByName(misses.agg(F.count("*").alias("n")).select(F.lit("request").alias("kind"), "n")))


_LEVEL = "SELECT o_orderpriority AS level, count(*) AS decided, avg((o_orderstatus = 'F')::INT) AS win_rate FROM orders WHERE {} GROUP BY 1"
view("dist_a", _LEVEL.format("o_orderdate < TIMESTAMP '1998-01-01' AND o_orderpriority <> '5-LOW'"))
view("dist_b", _LEVEL.format("o_orderdate >= TIMESTAMP '1998-01-01' AND o_orderpriority <> '1-URGENT'"))
view("aligned", """SELECT coalesce(a.level, b.level) AS level, a.decided / (SELECT sum(decided) FROM dist_a) AS a_share, a.win_rate AS a_win,
  b.decided / (SELECT sum(decided) FROM dist_b) AS b_share, b.win_rate AS b_win FROM dist_a a FULL JOIN dist_b b ON a.level = b.level""")
_ROUND5 = ("a_share", "a_win", "b_share", "b_win", "d_share_pp", "d_win_pp")


def _aligned(t: Tables) -> DataFrame:
    orders = t.table("orders")
    early = F.col("o_orderdate") < labels.at("1998-01-01")

    def table(rows: DataFrame) -> DataFrame:
        return rows.groupBy(F.col("o_orderpriority").alias("level")).agg(
            F.count("*").alias("decided"), F.avg((F.col("o_orderstatus") == "F").cast("double")).alias("win_rate"))
    return summaries.side_by_side(table(orders.where(early & (F.col("o_orderpriority") != "5-LOW"))),
                                  table(orders.where(~early & (F.col("o_orderpriority") != "1-URGENT"))))


@query("J14_aligned_distributions", """
SELECT level, round(a_share, 5) AS a_share, round(a_win, 5) AS a_win, round(b_share, 5) AS b_share, round(b_win, 5) AS b_win,
  round(abs(b_share - a_share) * 100, 5) AS d_share_pp, round(abs(b_win - a_win) * 100, 5) AS d_win_pp FROM aligned""")
def aligned_distributions(t: Tables) -> DataFrame:
    return _aligned(t).select("level", *[F.round(c, 5).alias(c) for c in _ROUND5])


@query("A13_largest_gaps", """
SELECT level, round(abs(b_win - a_win) * 100, 5) AS d_win_pp FROM aligned WHERE a_win IS NOT NULL AND b_win IS NOT NULL
ORDER BY abs(b_win - a_win) DESC, level LIMIT 3""")
def largest_gaps(t: Tables) -> DataFrame:
    return _aligned(t).where("d_win_pp is not null").orderBy(F.desc("d_win_pp"), "level").limit(3).select(
        "level", F.round("d_win_pp", 5).alias("d_win_pp"))


@query("A13_mean_gaps", """
SELECT round(avg(abs(b_win - a_win) * 100), 5) AS mean_win_gap, round(avg(abs(b_share - a_share) * 100), 5) AS mean_share_gap FROM aligned""")
def mean_gaps(t: Tables) -> DataFrame:
    return _aligned(t).agg(F.round(F.avg("d_win_pp"), 5).alias("mean_win_gap"), F.round(F.avg("d_share_pp"), 5).alias("mean_share_gap"))


@query("J15_table_mismatches", """
WITH a AS (SELECT l_suppkey AS k, sum(l_quantity) AS qty, avg(l_discount) AS disc FROM lineitem WHERE l_returnflag <> 'R' GROUP BY 1),
  b AS (SELECT l_suppkey AS k, sum(l_quantity) AS qty, avg(l_discount) AS disc FROM lineitem WHERE l_linestatus = 'F' AND l_suppkey % 7 <> 0 GROUP BY 1)
SELECT coalesce(a.k, b.k) AS k, CASE WHEN b.k IS NULL THEN 'missing' WHEN a.k IS NULL THEN 'unexpected' ELSE 'differs' END AS problem,
  'qty' AS "column", round(a.qty, 4) AS a, round(b.qty, 4) AS b FROM a FULL JOIN b ON a.k = b.k
WHERE a.k IS NULL OR b.k IS NULL OR abs(a.qty - b.qty) > 0.01
UNION ALL SELECT coalesce(a.k, b.k), CASE WHEN b.k IS NULL THEN 'missing' WHEN a.k IS NULL THEN 'unexpected' ELSE 'differs' END,
  'disc', round(a.disc, 4), round(b.disc, 4) FROM a FULL JOIN b ON a.k = b.k
WHERE a.k IS NULL OR b.k IS NULL OR abs(a.disc - b.disc) > 0.01""")
def table_mismatches(t: Tables) -> DataFrame:
    lines = t.table("lineitem").withColumn("k", F.col("l_suppkey"))

    def agg(rows: DataFrame) -> DataFrame:
        return rows.groupBy("k").agg(F.sum("l_quantity").alias("qty"), F.avg("l_discount").alias("disc"))
    out = summaries.table_mismatches(agg(lines.where("l_returnflag <> 'R'")), agg(lines.where("l_linestatus = 'F' and l_suppkey % 7 <> 0")),
                                     "k", ["qty", "disc"], 0.01)
    return out.select("k", "problem", "column", F.round("a", 4).alias("a"), F.round("b", 4).alias("b"))


@query("J15_moved_rows", """
SELECT s_suppkey, a AS position_a, b AS position_b FROM (SELECT s_suppkey, row_number() OVER (ORDER BY s_acctbal, s_suppkey) AS a,
  row_number() OVER (ORDER BY round(s_acctbal / 1000), s_suppkey) AS b FROM supplier) WHERE a <> b""")
def moved_rows(t: Tables) -> DataFrame:
    s = t.table("supplier").select("s_suppkey", "s_acctbal", F.round(F.col("s_acctbal") / 1000).alias("coarse"))
    a = ranking.with_global_rank(s, [F.col("s_acctbal"), F.col("s_suppkey")], "position_a").select("s_suppkey", "position_a")
    b = ranking.with_global_rank(s, [F.col("coarse"), F.col("s_suppkey")], "position_b").select("s_suppkey", "position_b")
    return a.join(b, "s_suppkey").where("position_a <> position_b")


# ---- selection, events, samples ----
@query("P9_select_by_id_list", """
SELECT o_orderkey AS lead_id, row_number() OVER (ORDER BY (o_orderkey * 7919) % 15013, o_orderkey) AS pos
FROM orders WHERE o_orderpriority = '1-URGENT' AND o_orderkey IN (SELECT lead_id FROM flagged WHERE NOT bot AND NOT dup)
ORDER BY pos LIMIT 50""")
def select_by_id_list(t: Tables) -> DataFrame:
    wanted = t.table("orders").where("o_orderpriority = '1-URGENT'").select(
        F.col("o_orderkey").alias("lead_id"), ((F.col("o_orderkey") * 7919) % 15013).alias("wish"))
    kept = cleaning.clean(t.leads()).select("lead_id").join(wanted, "lead_id").orderBy("wish", "lead_id").limit(50)
    return kept.withColumn("pos", F.row_number().over(W.orderBy("wish", "lead_id")).cast("bigint")).select("lead_id", "pos")


@query("P9_dropped_ids", """
SELECT lead_id FROM flagged WHERE (bot OR dup) AND lead_id IN (SELECT o_orderkey FROM orders WHERE o_orderpriority = '1-URGENT')""")
def dropped_ids(t: Tables) -> DataFrame:
    wanted = t.table("orders").where("o_orderpriority = '1-URGENT'").select(F.col("o_orderkey").alias("lead_id"))
    return quality.without_match(wanted, cleaning.clean(t.leads()), "lead_id")


@query("W4_strictly_increasing_events", """
WITH e AS (SELECT o_orderkey, o_orderdate AS t0, min(l_shipdate) AS s1, max(l_shipdate) AS s2 FROM orders JOIN lineitem ON l_orderkey = o_orderkey GROUP BY ALL),
  a AS (SELECT *, greatest(s1, t0 + INTERVAL 1 SECOND) AS t1 FROM e)
SELECT o_orderkey, strftime(t1, '%Y-%m-%d %H:%M:%S') AS t1, strftime(greatest(s2, t1 + INTERVAL 1 SECOND), '%Y-%m-%d %H:%M:%S') AS t2,
  (s1 = t0)::INT + (s2 = s1)::INT AS ties, (s1 < t0)::INT + (s2 < s1)::INT AS reordered FROM a""")
def strictly_increasing_events(t: Tables) -> DataFrame:
    from leadvane.operators.conversion import Outcome, SourceMapping, col, with_events
    ship = t.table("lineitem").groupBy("l_orderkey").agg(F.min("l_shipdate").alias("first"), F.max("l_shipdate").alias("last"))
    rows = t.table("orders").join(ship, F.col("o_orderkey") == F.col("l_orderkey"))
    iso = "yyyy-MM-dd'T'HH:mm:ss'Z'"
    raw = rows.select("o_orderkey", F.date_format("o_orderdate", iso).alias("s.created"), F.date_format("first", iso).alias("s.contacted"),
                      F.date_format("last", iso).alias("s.closed"), F.lit("won").alias("s.stage"))
    m = SourceMapping("w4", ("s",), col("s.created"), Outcome("stage", "s.stage", {"won": "Won"}), "2100-01-01",
                      contacted_at=col("s.contacted"), close_at=col("s.closed"))
    fmt = "yyyy-MM-dd HH:mm:ss"
    return with_events(raw, m).select("o_orderkey", F.date_format("contact_at", fmt).alias("t1"),
                                      F.date_format("final_at", fmt).alias("t2"), "ties", "reordered")


@query("W5_first_keys_per_problem", """
SELECT l_returnflag AS problem, string_agg(k::VARCHAR, ',' ORDER BY k) AS examples FROM (
  SELECT DISTINCT l_returnflag, l_orderkey AS k, dense_rank() OVER (PARTITION BY l_returnflag ORDER BY l_orderkey) AS r FROM lineitem
  WHERE l_quantity > 45) WHERE r <= 5 GROUP BY 1""")
def first_keys_per_problem(t: Tables) -> DataFrame:
    bad = t.table("lineitem").where("l_quantity > 45").select("l_returnflag", "l_orderkey").distinct()
    first = ranking.smallest_per_group(bad, "l_returnflag", ["l_orderkey"], 5)
    return first.groupBy(F.col("l_returnflag").alias("problem")).agg(
        F.array_join(F.transform(F.array_sort(F.collect_list("l_orderkey")), lambda k: k.cast("string")), ",").alias("examples"))


_SAMPLE_HASH = sql_hash("o_orderkey", "7")


@query("T7_exact_sample", f"""
SELECT o_orderkey FROM (SELECT o_orderkey, row_number() OVER (ORDER BY h, o_orderkey) AS rn FROM (
  SELECT o_orderkey, {_SAMPLE_HASH} AS h FROM orders)) WHERE rn <= 500""")
def exact_sample(t: Tables) -> DataFrame:
    return ranking.sample_exact(t.table("orders").select("o_orderkey"), "o_orderkey", F.lit(500), 7)


@query("T7_stratified_sample", f"""
SELECT o_orderkey, o_orderstatus FROM (SELECT *, row_number() OVER (PARTITION BY o_orderstatus ORDER BY h, o_orderkey) AS rn FROM (
  SELECT o_orderkey, o_orderstatus, {_SAMPLE_HASH} AS h FROM orders)) WHERE rn <= CASE o_orderstatus WHEN 'F' THEN 300 WHEN 'O' THEN 120 ELSE 40 END""")
def stratified_sample(t: Tables) -> DataFrame:
    size = F.when(F.col("o_orderstatus") == "F", 300).when(F.col("o_orderstatus") == "O", 120).otherwise(40)
    return ranking.sample_exact(t.table("orders").select("o_orderkey", "o_orderstatus"), "o_orderkey", size, 7, ["o_orderstatus"])


@query("W6_latest_share_of_sample", """
SELECT o_orderkey, draw FROM (SELECT o_orderkey, draw, row_number() OVER (PARTITION BY draw ORDER BY o_orderdate DESC, o_orderkey DESC) AS rn FROM (
  SELECT *, row_number() OVER (PARTITION BY draw ORDER BY h, o_orderkey) AS s FROM (
    SELECT o_orderkey, o_orderdate, draw, {h} AS h FROM orders CROSS JOIN (SELECT unnest(range(5)) AS draw))) WHERE s <= 1000) WHERE rn <= 200""".format(
    h=sql_hash("o_orderkey", "draw")))
def latest_share_of_sample(t: Tables) -> DataFrame:
    each = F.explode(F.sequence(F.lit(0).cast("bigint"), F.lit(4).cast("bigint")))
    drawn = t.table("orders").select("o_orderkey", "o_orderdate", each.alias("draw"))
    sample = ranking.sample_exact(drawn, "o_orderkey", F.lit(1000), F.col("draw"), ["draw"])
    latest = W.partitionBy("draw").orderBy(F.desc("o_orderdate"), F.desc("o_orderkey"))  # 1000 rows per draw
    return sample.withColumn("rn", F.row_number().over(latest)).where("rn <= 200").select("o_orderkey", "draw")


@query("T5_frequent_values", """
SELECT value, n FROM (SELECT p_name AS value, count(*) AS n FROM part GROUP BY 1) ORDER BY n DESC, value LIMIT 10""")
def frequent_values(t: Tables) -> DataFrame:
    counts = t.table("part").groupBy(F.col("p_name").alias("value")).agg(F.count("*").alias("n"))
    return counts.orderBy(F.desc("n"), "value").limit(10)


@query("U1_event_union", f"SELECT lead_id, stage, deal_value, strftime(changed_at, {FMT}) AS changed_at FROM crm")
def event_union(t: Tables) -> DataFrame:
    return t.crm().select("lead_id", "stage", "deal_value", F.date_format("changed_at", "yyyy-MM-dd HH:mm:ss").alias("changed_at"))


@query("U2_key_differences", """
SELECT 'customer_without_order' AS side, c_custkey AS k FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_totalprice > 400000)
UNION ALL SELECT 'part_without_line', p_partkey FROM part WHERE p_partkey NOT IN (SELECT l_partkey FROM lineitem WHERE l_quantity > 48)""")
def key_differences(t: Tables) -> DataFrame:
    def only(a: DataFrame, b: DataFrame, side: str) -> DataFrame:
        return quality.without_match(a, b, "k").select(F.lit(side).alias("side"), "k")
    orders = t.table("orders").where("o_totalprice > 400000").select(F.col("o_custkey").alias("k"))
    lines = t.table("lineitem").where("l_quantity > 48").select(F.col("l_partkey").alias("k"))
    return only(t.table("customer").select(F.col("c_custkey").alias("k")), orders, "customer_without_order").unionByName(
        only(t.table("part").select(F.col("p_partkey").alias("k")), lines, "part_without_line"))


@query("U2_unknown_columns", "SELECT unnest(['c_acctbal','c_custkey','c_mktsegment','c_name','c_nationkey']) AS column_name, (SELECT count(*) FROM customer) AS n_rows")
def unknown_columns(t: Tables) -> DataFrame:
    df = t.table("customer")
    extra = sorted(set(df.columns) - set(LEAD_COLUMNS))
    return df.agg(F.count("*").alias("n_rows")).select(F.explode(F.array(*[F.lit(c) for c in extra])).alias("column_name"), "n_rows")


# ---- grouped summaries ----
@query("A6_rate_per_segment", """
SELECT f_band AS band, round(avg(y), 6) AS rate, count(*) AS n FROM scored WHERE is_train GROUP BY 1
UNION ALL SELECT 'base rate', round(avg(y), 6), count(*) FROM scored WHERE is_train""")
def rate_per_segment(t: Tables) -> DataFrame:
    out = scored(t).where("is_train").rollup("band").agg(F.round(F.avg("y"), 6).alias("rate"), F.count("*").alias("n"))
    return out.withColumn("band", F.coalesce("band", F.lit("base rate")))


_A7 = {"band": LEVELS["band"], "channel": (*LEVELS["channel"], "never seen"), "seniority": LEVELS["seniority"]}


@query("A7_level_win_rates", " UNION ALL ".join(
    f"SELECT '{f}' AS feature, '{lvl}' AS level, {i} AS position, count(*) FILTER (WHERE f_{f} = '{lvl}') AS decided, "
    f"round(avg((label_source = 'won')::INT) FILTER (WHERE f_{f} = '{lvl}'), 6) AS win_rate FROM scored WHERE label_source IN ('won','crm_lost')"
    for f, levels in _A7.items() for i, lvl in enumerate(levels)))
def level_win_rates(t: Tables) -> DataFrame:
    decided = F.col("label_source").isin("won", "crm_lost")
    out = summaries.level_table(scored(t), _A7, decided, F.col("label_source") == "won")
    return out.withColumn("win_rate", F.round("win_rate", 6))


_CONSENT = "blank (consent declined)"


@query("A8_consent_aware_rates", f"""
SELECT level, count(*) AS decided, round(avg((final_stage = 'Won')::INT), 6) AS win_rate FROM (
  SELECT final_stage, CASE WHEN NOT consent THEN '{_CONSENT}' WHEN hesitation_ms > 90000 THEN 'over 90s' ELSE 'under 90s' END AS level
  FROM labelled WHERE final_stage IN ('Won','Lost')) GROUP BY level""")
def consent_aware_rates(t: Tables) -> DataFrame:
    level = F.when(~F.col("consent"), _CONSENT).when(F.col("hesitation_ms") > 90000, "over 90s").otherwise("under 90s")
    rows = cleaned(t).withColumn("hesitation", level)
    out = summaries.level_table(rows, {"hesitation": ("over 90s", "under 90s", _CONSENT)}, F.col("final_stage").isin("Won", "Lost"),
                                F.col("final_stage") == "Won")
    return out.select("level", "decided", F.round("win_rate", 6).alias("win_rate"))


@query("A9_readiness_counts", f"""
SELECT count(*) AS leads, count(*) FILTER (WHERE utm_source IS NOT NULL AND utm_medium <> 'lead_form'
    AND coalesce(gclid, gbraid, wbraid, fbclid, li_fat_id, oppref) IS NULL) AS click_id_missing,
  count(*) FILTER (WHERE dup) AS duplicates, count(*) FILTER (WHERE dup AND email <> email_l) AS duplicates_case_changed,
  count(*) FILTER (WHERE final_stage = 'Won' AND deal_value IS NULL) AS won_no_value,
  count(*) FILTER (WHERE ip_country IS NOT NULL AND NOT coalesce(ip_country = a_country, false)) AS ip_mismatch,
  count(*) FILTER (WHERE is_datacenter_ip) AS datacenter, count(*) FILTER (WHERE first_contact_at IS NULL) AS never_contacted,
  round(avg((epoch(won_at) - epoch(created_at) <= 14 * 86400)::INT), 6) AS won_within_14,
  round(avg((epoch(won_at) - epoch(created_at) > 90 * 86400)::INT), 6) AS won_past_90
FROM flagged LEFT JOIN outcomes USING (lead_id)""")
def readiness_counts(t: Tables) -> DataFrame:
    from leadvane.operators import crm, enrichment
    df = crm.add_crm_outcomes(cleaning.flag_bots_and_repeats(enrichment.with_answers(t.leads())), t.crm())
    won_days = (F.unix_micros("won_at") - F.unix_micros("created_at")) / labels.DAY_MICROS
    web_paid = F.col("utm_source").isNotNull() & (F.col("utm_medium") != "lead_form")
    ids = F.coalesce("gclid", "gbraid", "wbraid", "fbclid", "li_fat_id", "oppref")
    mismatch = F.col("ip_country").isNotNull() & ~F.coalesce(F.col("ip_country") == F.col("a_country"), F.lit(False))
    return df.agg(
        F.count("*").alias("leads"), F.count_if(web_paid & ids.isNull()).alias("click_id_missing"),
        F.count_if("dup").alias("duplicates"), F.count_if(F.col("dup") & (F.col("email") != F.col("email_l"))).alias("duplicates_case_changed"),
        F.count_if((F.col("final_stage") == "Won") & F.col("deal_value").isNull()).alias("won_no_value"),
        F.count_if(mismatch).alias("ip_mismatch"), F.count_if("is_datacenter_ip").alias("datacenter"),
        F.count_if(F.col("first_contact_at").isNull()).alias("never_contacted"),
        F.round(F.avg((won_days <= 14).cast("double")), 6).alias("won_within_14"),
        F.round(F.avg((won_days > 90).cast("double")), 6).alias("won_past_90"))


@query("A9_medians_by_segment", f"""
SELECT f_band AS band, round(quantile_cont((epoch(won_at) - epoch(created_at)) / 86400, 0.5), 4) AS median_days, round(quantile_cont(deal_value, 0.5), 4) AS median_value
FROM scored WHERE won_at IS NOT NULL GROUP BY 1""")
def medians_by_segment(t: Tables) -> DataFrame:
    won = scored(t).where("won_at is not null").withColumn(
        "days", (F.unix_micros("won_at") - F.unix_micros("created_at")) / labels.DAY_MICROS)
    days = ranking.percentile_columns(won, "days", {"median_days": 0.5}, ["band"])
    worth = ranking.percentile_columns(won, "deal_value", {"median_value": 0.5}, ["band"])
    return days.join(worth, "band", "left").select("band", F.round("median_days", 4).alias("median_days"), F.round("median_value", 4).alias("median_value"))


view("volumes", f"""
SELECT platform, utm_campaign, count(*) / 12 AS leads_per_month FROM (SELECT utm_campaign, CASE {SQL_CHANNEL}
  WHEN 'google' THEN 'google' WHEN 'meta' THEN 'meta' WHEN 'meta_leadads' THEN 'meta' END AS platform
  FROM cleaned WHERE created_at > {T_AS_OF} - INTERVAL 1 YEAR) WHERE platform IS NOT NULL GROUP BY ALL""")


def _volumes(t: Tables) -> DataFrame:
    ch = text.channel(F.col("utm_medium"), F.col("utm_source"))
    return summaries.monthly_volumes(cleaned(t), ch, ORDERS_DATES.as_of)


@query("A10_monthly_volumes", "SELECT platform, utm_campaign, round(leads_per_month, 6) AS leads_per_month FROM volumes")
def monthly_volumes(t: Tables) -> DataFrame:
    return _volumes(t).withColumn("leads_per_month", F.round("leads_per_month", 6))


@query("A18_campaign_eligibility", f"""
SELECT platform, utm_campaign, round(s, 6) AS submit_conversions, round(s * rate, 6) AS close_conversions, s >= need AS submit_ok,
  s * rate >= need AS close_ok, CASE WHEN s * rate > 0 THEN round(need / (s * rate), 6) ELSE 'inf'::DOUBLE END AS close_shortfall
FROM (SELECT *, leads_per_month * CASE platform WHEN 'google' THEN 30 ELSE 7 END / {DAYS_PER_MONTH}::DOUBLE AS s, CASE platform WHEN 'google' THEN 30 ELSE 50 END AS need FROM volumes),
  (SELECT avg(won_within_h) AS rate FROM labelled WHERE mature AND created_at > {T_AS_OF} - INTERVAL 1 YEAR)""")
def campaign_eligibility(t: Tables) -> DataFrame:
    recent = cleaned(t).where(F.col("created_at") > F.add_months(labels.at(ORDERS_DATES.as_of), -12).cast("timestamp"))
    rate = recent.where(labels.is_mature(120, ORDERS_DATES.as_of)).agg(F.avg(labels.won_within(120, ORDERS_DATES.as_of))).scalar()
    out = summaries.eligibility(_volumes(t), rate)
    return out.select("platform", "utm_campaign", *[F.round(c, 6).alias(c) for c in ("submit_conversions", "close_conversions")],
                      "submit_ok", "close_ok", F.round("close_shortfall", 6).alias("close_shortfall"))


_CLICK = "coalesce(gclid, gbraid, wbraid, fbclid, li_fat_id, oppref) IS NOT NULL"
_A11 = f"""SELECT {{}} AS channel, count(*) AS leads, round(avg(({_CLICK})::INT), 6) AS click_id, round(avg((meta_lead_id IS NOT NULL)::INT), 6) AS lead_form_id,
  round(avg((NOT ({_CLICK}) AND meta_lead_id IS NULL AND fbp IS NOT NULL)::INT), 6) AS no_id_fbp,
  round(avg((NOT ({_CLICK}) AND meta_lead_id IS NULL)::INT), 6) AS no_id, round(avg((email IS NOT NULL)::INT), 6) AS email_present,
  round(avg((phone IS NOT NULL)::INT), 6) AS phone_present FROM (SELECT *, {SQL_CHANNEL} AS ch FROM cleaned) WHERE {{}} GROUP BY 1"""


@query("A11_identifier_coverage", " UNION ALL ".join([
    _A11.format("ch", "ch <> 'organic_direct'"), _A11.format("'all paid'", "ch <> 'organic_direct'"),
    _A11.format("'landing-page paid'", "ch NOT IN ('organic_direct','meta_leadads')")]))
def identifier_coverage(t: Tables) -> DataFrame:
    out = summaries.identifier_coverage(cleaned(t), text.channel(F.col("utm_medium"), F.col("utm_source")))
    return out.select("channel", "leads", *[F.round(c, 6).alias(c) for c in out.columns[2:]])


@query("A14_confusion_matrix", """
SELECT quality, count(*) FILTER (WHERE text_class = 'specific') AS specific, count(*) FILTER (WHERE text_class = 'neutral') AS neutral,
  count(*) FILTER (WHERE text_class = 'vague') AS vague, count(*) FILTER (WHERE text_class = 'copy_paste') AS copy_paste FROM labelled_docs GROUP BY 1""")
def confusion_matrix(t: Tables) -> DataFrame:
    order = ["specific", "neutral", "vague", "copy_paste"]
    out = labelled_docs(t).groupBy("quality").pivot("text_class", order).agg(F.count("doc_id"))
    return out.select("quality", *[F.coalesce(c, F.lit(0)).alias(c) for c in order])


@query("A15_detector_scores", """
SELECT tp, fp, fn, round(tp / nullif(tp + fp, 0), 6) AS precision, round(tp / nullif(tp + fn, 0), 6) AS recall, fp_long FROM (
  SELECT count(*) FILTER (WHERE f AND q) AS tp, count(*) FILTER (WHERE f AND NOT q) AS fp, count(*) FILTER (WHERE NOT f AND q) AS fn,
    count(*) FILTER (WHERE f AND NOT q AND toxic = 1) AS fp_long
  FROM (SELECT n_chars > 1000 AS f, quality = 1 AS q, toxic FROM labelled_docs))""")
def detector_scores(t: Tables) -> DataFrame:
    flag, truth = F.col("n_chars") > 1000, F.col("quality") == 1
    counts = labelled_docs(t).agg(*summaries.detector_counts(flag, truth), F.count_if(flag & ~truth & (F.col("toxic") == 1)).alias("fp_long"))
    return counts.select("tp", "fp", "fn", F.round("precision", 6).alias("precision"), F.round("recall", 6).alias("recall"), "fp_long")


@query("A16_correlations", """
SELECT round(corr(never, tier), 6) AS corr_tier, round(corr(never, p), 6) AS corr_p, round(corr(tier, p), 6) AS corr_tier_p, round(avg(never), 6) AS never_share FROM (
  SELECT s.lead_id, (s.final_stage = 'New')::INT AS never, p, CASE sq_tier WHEN 'A' THEN 0 WHEN 'B' THEN 1 ELSE 2 END AS tier
  FROM scored s JOIN benchmark_rows b USING (lead_id))""")
def correlations(t: Tables) -> DataFrame:
    df = scored(t).withColumns(value.benchmark_value())
    tier = F.when(F.col("sq_tier") == "A", 0.0).when(F.col("sq_tier") == "B", 1.0).otherwise(2.0)
    rows = df.select((F.col("final_stage") == "New").cast("double").alias("never"), tier.alias("tier"), "p")
    return rows.agg(F.round(F.corr("never", "tier"), 6).alias("corr_tier"), F.round(F.corr("never", "p"), 6).alias("corr_p"),
                    F.round(F.corr("tier", "p"), 6).alias("corr_tier_p"), F.round(F.avg("never"), 6).alias("never_share"))


@query("A19_enrichment_study", """
SELECT count(*) AS leads, count(*) FILTER (WHERE co_band IS NULL) AS misses,
  count(*) FILTER (WHERE co_band IS NULL AND (company_name IS NOT NULL OR coalesce(a_company, '') <> '')) AS typed,
  count(*) FILTER (WHERE enrichment_source = 'name') AS matched, count(*) FILTER (WHERE enrichment_source IS NULL) AS unmatched,
  count(*) FILTER (WHERE enrichment_source = 'name' AND en_spend = 'none') AS matched_no_spend FROM enriched""")
def enrichment_study(t: Tables) -> DataFrame:
    from leadvane.catalog.features import enriched
    miss, by_name = F.col("co_employee_band").isNull(), F.col("enrichment_source") == "name"
    typed = F.col("company_name").isNotNull() | (F.coalesce("a_company", F.lit("")) != "")
    return enriched(t).agg(
        F.count("*").alias("leads"), F.count_if(miss).alias("misses"), F.count_if(miss & typed).alias("typed"),
        F.count_if(by_name).alias("matched"), F.count_if(F.col("enrichment_source").isNull()).alias("unmatched"),
        F.count_if(by_name & (F.col("en_monthly_ad_spend_band") == "none")).alias("matched_no_spend"))


@query("A19_unmatched_names", """
SELECT name, n FROM (SELECT coalesce(company_name, '(blank)') AS name, count(*) AS n FROM enriched WHERE enrichment_source IS NULL GROUP BY 1)
ORDER BY n DESC, name LIMIT 5""")
def unmatched_names(t: Tables) -> DataFrame:
    from leadvane.catalog.features import enriched
    names = enriched(t).where("enrichment_source is null").groupBy(F.coalesce("company_name", F.lit("(blank)")).alias("name"))
    return names.agg(F.count("*").alias("n")).orderBy(F.desc("n"), "name").limit(5)


_A20 = [f for f in BEHAVIOURAL_FEATURES]


@query("A20_encoding_comparison", " UNION ALL ".join(
    f"SELECT 'legacy' AS encoding, '{f}' AS feature, f_{f} AS level, count(*) AS n FROM features_legacy WHERE f_channel = 'meta_leadads' GROUP BY f_{f} "
    f"UNION ALL SELECT 'v2', '{f}', f_{f}, count(*) FROM features_v2 WHERE f_channel = 'meta_leadads' GROUP BY f_{f}" for f in _A20))
def encoding_comparison(t: Tables) -> DataFrame:
    def part(df: DataFrame, name: str) -> DataFrame:
        long = design.unpivot(df.where("channel = 'meta_leadads'"), [], _A20)
        return long.groupBy("feature", "level").agg(F.count("*").alias("n")).withColumn("encoding", F.lit(name))
    return part(legacy(t), "legacy").unionByName(part(scored(t), "v2")).select("encoding", "feature", "level", "n")


_H = (90, 120, 150, 180, 240)


@query("A21_late_win_shares", " UNION ALL ".join(f"""
SELECT {h} AS horizon, f_band AS band, count(*) AS n, round(avg((epoch(won_at) - epoch(created_at) > {h} * 86400)::INT), 6) AS late_share
FROM scored WHERE label_source = 'won' AND created_at + INTERVAL {h} DAY <= {T_AS_OF} AND created_at < {T_TEST_FROM} GROUP BY f_band""" for h in _H))
def late_win_shares(t: Tables) -> DataFrame:
    days = (F.unix_micros("won_at") - F.unix_micros("created_at")) / labels.DAY_MICROS
    cells = F.array(*[F.struct(F.lit(h).alias("horizon"), labels.is_mature(h, ORDERS_DATES.as_of).alias("mature"), (days > h).alias("late"))
                      for h in _H])
    rows = scored(t).where((F.col("label_source") == "won") & (F.col("created_at") < labels.at(ORDERS_DATES.test_from)))
    long = rows.select("band", F.explode(cells).alias("c")).where("c.mature").select("band", "c.horizon", "c.late")
    return long.groupBy("horizon", "band").agg(F.count("*").alias("n"), F.round(F.avg(F.col("late").cast("double")), 6).alias("late_share"))


_A22 = ("company_name", "company_domain", "phone", "gclid", "li_fat_id", "utm_term", "time_on_page_s")


@query("A22_fill_shares_by_outcome", " UNION ALL ".join(f"""
SELECT '{c}' AS "column", round(avg(({c} IS NOT NULL)::INT) FILTER (WHERE final_stage = 'Won'), 6) AS won_filled,
  round(avg(({c} IS NOT NULL)::INT) FILTER (WHERE final_stage = 'Lost'), 6) AS lost_filled FROM cleaned""" for c in _A22))
def fill_shares_by_outcome(t: Tables) -> DataFrame:
    return _fill_shares(t, _A22)


def _fill_shares(t: Tables, columns: tuple[str, ...]) -> DataFrame:
    cells = F.array(*[F.struct(F.lit(c).alias("column"), F.col(c).isNotNull().cast("double").alias("has")) for c in columns])
    long = cleaned(t).select("final_stage", F.explode(cells).alias("c")).select("final_stage", "c.*")
    return long.groupBy("column").agg(F.round(F.avg(F.when(F.col("final_stage") == "Won", F.col("has"))), 6).alias("won_filled"),
                                      F.round(F.avg(F.when(F.col("final_stage") == "Lost", F.col("has"))), 6).alias("lost_filled"))


_A22_ALL = tuple(c for c in _LEAD if c != "lead_id")


@query("A22_fill_shares_all")
def fill_shares_all(t: Tables) -> DataFrame:
    """The shares of every lead column."""
    return _fill_shares(t, _A22_ALL)


@query("A23_cleaning_view", f"""
SELECT (SELECT count(*) FROM flagged) AS n_rows, (SELECT round(avg(bot::INT), 6) FROM flagged) AS bot_share,
  (SELECT round(avg((dup AND NOT bot)::INT), 6) FROM flagged) AS dup_share, count(*) AS kept, count(y_legacy) AS labelled_n,
  round(avg(y_legacy), 6) AS positive_rate, count(y_legacy) FILTER (WHERE created_at >= {T_TEST_FROM}) AS test_labelled FROM labelled""")
def cleaning_view(t: Tables) -> DataFrame:
    from leadvane.operators import crm
    flagged = crm.add_crm_outcomes(cleaning.flag_bots_and_repeats(t.leads()), t.crm())
    kept = ~F.col("bot") & ~F.col("dup")
    y = F.when(kept, labels.legacy_label(ORDERS_DATES))
    from_test = F.col("created_at") >= labels.at(ORDERS_DATES.test_from)
    return flagged.agg(
        F.count("*").alias("n_rows"), F.round(F.avg(F.col("bot").cast("double")), 6).alias("bot_share"),
        F.round(F.avg((F.col("dup") & ~F.col("bot")).cast("double")), 6).alias("dup_share"), F.count_if(kept).alias("kept"),
        F.count(y).alias("labelled_n"), F.round(F.avg(y), 6).alias("positive_rate"), F.count(F.when(from_test, y)).alias("test_labelled"))


@query("A24_subgroup_shares", """
SELECT f_text AS "text", round(sum(flag::INT) / any_value(nf), 6) AS flagged, round(sum((NOT flag)::INT) / any_value(nr), 6) AS rest,
  round(abs(sum(flag::INT) / any_value(nf) - sum((NOT flag)::INT) / any_value(nr)), 6) AS gap
FROM (SELECT f_text, f_email = 'free' AS flag, sum((f_email = 'free')::INT) OVER () AS nf, sum((f_email <> 'free')::INT) OVER () AS nr FROM scored) GROUP BY 1""")
def subgroup_shares(t: Tables) -> DataFrame:
    df = scored(t).withColumn("flag", F.col("email") == "free")
    return summaries.group_shares(df, "flag", "text").select("text", *[F.round(c, 6).alias(c) for c in ("flagged", "rest", "gap")])


@query("A25_known_rates_by_population", """
SELECT population, f_band AS band, count(*) AS n, round(avg(p), 6) AS mean_p FROM (
  SELECT 'all' AS population, f_band, p FROM scored UNION ALL SELECT 'train', f_band, p FROM scored WHERE is_train
  UNION ALL SELECT 'test', f_band, p FROM scored WHERE is_test) GROUP BY ALL""")
def known_rates_by_population(t: Tables) -> DataFrame:
    populations = F.array_compact(F.array(F.lit("all"), F.when(F.col("is_train"), "train"), F.when(F.col("is_test"), "test")))
    long = scored(t).select("band", "p", F.explode(populations).alias("population"))
    return long.groupBy("population", "band").agg(F.count("*").alias("n"), F.round(F.avg("p"), 6).alias("mean_p"))


@query("A26_score_margin", """
WITH s AS (SELECT d.doc_id, coalesce(max(similarity), 0) AS sim FROM documents d LEFT JOIN word_pairs USING (doc_id) GROUP BY 1)
SELECT round(min(sim) FILTER (WHERE quality = 1), 6) AS lowest_true, round(max(sim) FILTER (WHERE quality = 0), 6) AS highest_false
FROM s JOIN labels USING (doc_id)""")
def score_margin(t: Tables) -> DataFrame:
    sims = similarity.best_snippet_similarity(t.table("documents"), t.table("benchmark"), "doc_id", "item_id")
    return sims.join(t.table("labels"), "doc_id").agg(
        F.round(F.min(F.when(F.col("quality") == 1, F.col("similarity"))), 6).alias("lowest_true"),
        F.round(F.max(F.when(F.col("quality") == 0, F.col("similarity"))), 6).alias("highest_false"))


