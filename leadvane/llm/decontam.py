"""Benchmark passages in a corpus, found through a stored positional inverted index.

The index is partitioned by document: every task writes one segment, its postings (term, document, position) sorted by
term, so nothing is shuffled and no frequent term gathers anywhere. An end marker of each document keeps its length.
A phrase starts from the postings of its rarest term; each posting, shifted by the term's place, is a candidate start.
The list of the second rarest term thins the candidates, and the lists of all other terms must then hold every remaining
place. DataFrame functions only.
"""
from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from leadvane.llm.common import ascii_lower, keyed, written

WINDOW = 13
#: A run of characters outside 0-9, A-Z, a-z and the letters beyond ASCII parts two terms.
PARTING = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
#: Not a term, because terms are not empty: its posting is the end of a document, its position the number of terms.
END = ""


def terms(text: Column) -> Column:
    return F.array_remove(F.split(ascii_lower(F.coalesce(text, F.lit(""))), PARTING, -1), "")


def dictionary(vocabulary: DataFrame) -> DataFrame:
    """term, term_id of the distinct terms and the end marker; ids are hashes, refused in the case that two agree."""
    spark = vocabulary.sparkSession
    known = vocabulary.select("term").where(F.col("term") != END).distinct().union(spark.range(1).select(F.lit(END).alias("term")))
    known = written(known.select("term", F.xxhash64("term").alias("term_id")), "terms")
    if known.groupBy("term_id").count().where("count > 1").limit(1).count():
        raise ValueError("two terms have one id")
    return known


def build_index(docs: DataFrame, known: DataFrame | None = None) -> DataFrame:
    """Postings term_id, doc_id, pos of ``docs``, in document-partitioned segments sorted by term.

    ``known`` (see ``dictionary``) limits the index to the terms that queries can use; None indexes every term. Rows that
    repeat a doc_id are one document, laid over each other from position 0.
    """
    tokens = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.posexplode(F.concat(terms(F.col("text")), F.array(F.lit(END)))).alias("pos", "term"))
    if known is None:
        postings = tokens.select(F.xxhash64("term").alias("term_id"), "doc_id", "pos")
    else:
        postings = tokens.join(known, "term").select("term_id", "doc_id", "pos")
    return written(postings.sortWithinPartitions("term_id", "doc_id", "pos"), "postings")


def windows(items: DataFrame, size: int = WINDOW) -> DataFrame:
    """item_id, words: every run of ``size`` words of an item; a shorter item is one window, one without words has none."""
    words = items.where(F.col("item_id").isNotNull()).select("item_id", terms(F.col("text")).alias("w")).where(F.size("w") > 0)
    starts = F.sequence(F.lit(0), F.greatest(F.size("w") - size, F.lit(0)))
    return words.select("item_id", F.explode(F.transform(starts, lambda i: F.slice(F.col("w"), i + 1, size))).alias("words")).distinct()


def _places(phrases: DataFrame, index: DataFrame, known: DataFrame) -> DataFrame:
    """phrase, n, off, term_id, rank: the places of each phrase, ranked from its rarest term; phrases with an absent term go."""
    used = phrases.select("phrase", F.size("words").alias("n"), F.posexplode("words").alias("off", "term")).join(known, "term")
    counts = index.join(F.broadcast(known.select("term_id")) if known.count() <= 1_000_000 else known.select("term_id"), "term_id", "left_semi").groupBy("term_id").count()
    ranked = used.join(counts, "term_id").withColumn("rank", F.row_number().over(Window.partitionBy("phrase").orderBy("count", "off")))
    whole = Window.partitionBy("phrase")
    return ranked.withColumn("found", F.count("*").over(whole)).where(F.col("found") == F.col("n")).select("phrase", "n", "off", "term_id", "rank")


def phrase_matches(index: DataFrame, known: DataFrame, phrases: DataFrame) -> DataFrame:
    """phrase, doc_id, start, n of every exact occurrence of ``phrases`` (phrase, words) in the index."""
    places = written(_places(phrases, index, known), "places")
    rank = lambda r: places.where(F.col("rank") == r)
    one = rank(1).select("phrase", "n", "off", "term_id")
    found = index.join(one, "term_id").select("phrase", "n", "doc_id", (F.col("pos") - F.col("off")).alias("start")).where(F.col("start") >= 0)
    two = rank(2).select("phrase", F.col("off").alias("off2"), F.col("term_id").alias("t2"))
    second = index.join(two.select(F.col("t2").alias("term_id")).distinct(), "term_id", "left_semi")
    asked = found.join(two, "phrase").select("phrase", "n", "doc_id", "start", F.col("t2").alias("term_id"), (F.col("start") + F.col("off2")).alias("pos"))
    thin = asked.join(second, ["term_id", "doc_id", "pos"]).select("phrase", "n", "doc_id", "start").union(found.where("n = 1").select("phrase", "n", "doc_id", "start"))
    thin = written(thin.distinct(), "thinned")
    docs = written(thin.select("doc_id").distinct(), "thinned-docs")
    rest = places.where("rank > 2").select("phrase", "off", "term_id")
    lists = keyed(index, docs)
    asked = thin.join(rest, "phrase").select("phrase", "n", "doc_id", "start", "term_id", (F.col("start") + F.col("off")).alias("pos"))
    held = asked.join(lists.distinct(), ["term_id", "doc_id", "pos"]).groupBy("phrase", "doc_id", "start", "n").count().where(F.col("count") == F.col("n") - 2)
    return held.select("phrase", "doc_id", "start", "n").union(thin.where("n <= 2").select("phrase", "doc_id", "start", "n"))


def proximity_matches(index: DataFrame, known: DataFrame, phrases: DataFrame, slack: int) -> DataFrame:
    """phrase, doc_id, pos: postings of a phrase's rarest term with each of its other terms at most ``slack`` places away."""
    places = written(_places(phrases, index, known), "places")
    rare = index.join(places.where("rank = 1").select("phrase", "term_id"), "term_id").select("phrase", "doc_id", "pos")
    others = places.where("rank > 1").select("phrase", "term_id").distinct()
    n_others = places.groupBy("phrase").agg((F.countDistinct("term_id") - 1).alias("others"))
    lists = keyed(index, written(rare.select("doc_id").distinct(), "near-docs")).withColumnRenamed("pos", "pos2")
    near = rare.join(others, "phrase").join(lists, ["term_id", "doc_id"]).where(F.abs(F.col("pos") - F.col("pos2")) <= slack)
    first = places.where("rank = 1").select("phrase", F.col("term_id").alias("rare_id"))
    near = near.join(first, "phrase").where(F.col("term_id") != F.col("rare_id"))
    near = near.groupBy("phrase", "doc_id", "pos").agg(F.countDistinct("term_id").alias("have")).join(n_others, "phrase").where(F.col("have") == F.col("others"))
    alone = rare.join(n_others.where("others = 0"), "phrase").select("phrase", "doc_id", "pos")
    return near.select("phrase", "doc_id", "pos").union(alone)


def contamination(docs: DataFrame, items: DataFrame, size: int = WINDOW, per_hit: int = 20) -> DataFrame:
    """doc_id, n_words, n_hit, n_items, items (sorted item ids), contaminated, one row for each doc_id.

    A word inside any occurrence of a window is hit; a document is contaminated if ``per_hit`` hits reach its words.
    Null and empty texts have no words and are clean. Rows that repeat a doc_id are one document (see ``build_index``),
    rows without one are one document that is never hit; items without an id or words have no windows, and repeated items
    count once. Other columns are ignored. An empty table gives no rows; without items all documents are clean.
    """
    runs = windows(items, size).withColumn("phrase", F.xxhash64("words"))
    runs = written(runs, "windows")
    if runs.groupBy("phrase").agg(F.countDistinct("words").alias("k")).where("k > 1").limit(1).count():
        raise ValueError("two windows have one id")
    phrases = runs.select("phrase", "words").distinct()
    known = dictionary(phrases.select(F.explode("words").alias("term")))
    index = build_index(docs, known)
    hits = written(phrase_matches(index, known, phrases).where(F.col("doc_id").isNotNull()), "matches")

    # The end of what earlier matches cover; a match adds the words behind it.
    before = Window.partitionBy("doc_id").orderBy("start", "stop").rowsBetween(Window.unboundedPreceding, -1)
    spans = hits.select("doc_id", "start", (F.col("start") + F.col("n")).alias("stop")).distinct()
    new = spans.withColumn("seen", F.coalesce(F.max("stop").over(before), F.lit(0)))
    n_hit = new.groupBy("doc_id").agg(F.sum(F.greatest(F.lit(0), F.col("stop") - F.greatest("start", "seen"))).cast("long").alias("n_hit"))
    found = hits.select("doc_id", "phrase").distinct().join(runs.select("phrase", F.col("item_id").cast("string").alias("item")), "phrase")
    found = found.groupBy("doc_id").agg(F.array_sort(F.collect_set("item")).alias("items"))
    lengths = index.join(F.broadcast(known.where(F.col("term") == END).select("term_id")), "term_id", "left_semi").groupBy("doc_id").agg(F.max("pos").cast("long").alias("n_words"))
    out = lengths.join(n_hit, "doc_id", "left").join(found, "doc_id", "left")
    out = out.withColumn("n_hit", F.coalesce("n_hit", F.lit(0).cast("long"))).withColumn("items", F.coalesce("items", F.array().cast("array<string>")))
    return out.select("doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"), "items",
                      ((F.col("n_hit") > 0) & (F.col("n_hit") * per_hit >= F.col("n_words"))).alias("contaminated"))
