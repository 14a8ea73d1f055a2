"""Queries of the operators over their whole tables, with DuckDB SQL where it can follow."""
from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from leadvane.llm import ann, collocations, decontam, fst, langid, line_dedup, line_frequency, minhash, quotes, substring, suffix_array, variants, warc
from leadvane.llm.common import table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None) -> Callable:
    def wrap(fn: Callable[[SparkSession, str], DataFrame]) -> Callable:
        QUERIES[name] = fn
        if sql:
            ORACLES[name] = sql
        return fn
    return wrap


def sha_text(c: str) -> F.Column:
    return F.sha2(F.col(c).cast("binary"), 256)


@query("op2_line_dedup", r"""
WITH lines AS (
  SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS line,
         unnest(range(len(string_split(coalesce(text, ''), chr(10))))) AS pos
  FROM documents),
keyed AS (
  SELECT doc_id, pos, line,
         translate(trim(line, chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)),
                   'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key
  FROM lines),
first AS (
  SELECT key, min(doc_id) AS first FROM keyed WHERE length(key) >= 10 GROUP BY key HAVING count(DISTINCT doc_id) >= 2),
marked AS (
  SELECT k.*, coalesce(k.doc_id > f.first, false) AS gone FROM keyed k LEFT JOIN first f ON k.key = f.key)
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (gone) AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (NOT gone), '')) AS kept_sha256
FROM marked GROUP BY doc_id""")
def op2(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = line_dedup.dedup_lines(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return out.select("doc_id", "n_lines", "n_dropped", sha_text("text").alias("kept_sha256"))


@query("op7_minhash_near_dedup")
def op7(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash.near_groups(table(spark, sf_dir, "documents"))


@query("op5_language_id")
def op5(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = langid.train(langid.learnable(docs))
    return langid.predict(docs.select("doc_id", "text"), model).select("doc_id", langid.held_out().alias("held_out"), "lang_pred", "score", "rejected")


@query("op8_decontaminate", r"""
WITH words AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
         '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
items AS (
  SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
         '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark),
win AS (
  SELECT DISTINCT item_id, least(len(w), 13) AS n, array_to_string(w[i + 1:i + 13], ' ') AS key
  FROM (SELECT item_id, w, unnest(range(greatest(len(w) - 13, 0) + 1)) AS i FROM items WHERE len(w) > 0)),
sizes AS (SELECT DISTINCT n FROM win),
runs AS (
  SELECT doc_id, i AS start, n, array_to_string(w[i + 1:i + n], ' ') AS key
  FROM (SELECT doc_id, w, n, unnest(range(len(w) - n + 1)) AS i FROM words, sizes WHERE len(w) >= n)),
hits AS (SELECT r.doc_id, r.start, r.n, w.item_id FROM runs r JOIN win w ON r.key = w.key AND r.n = w.n),
covered AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(start, start + n)) AS p FROM hits) GROUP BY doc_id),
found AS (SELECT doc_id, count(*) AS n_items, string_agg(i, ',' ORDER BY i) AS items
          FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS i FROM hits) GROUP BY doc_id)
SELECT w.doc_id, len(w.w)::BIGINT AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
       sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(w.w) AS contaminated
FROM words w LEFT JOIN covered c ON w.doc_id = c.doc_id LEFT JOIN found f ON w.doc_id = f.doc_id""")
def op8(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = decontam.contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return out.withColumn("items_sha256", F.sha2(F.array_join("items", ",").cast("binary"), 256)).select("doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated")


#: Where the tokenizer's model file lies; a parameter of the query's module.
MODEL_FILE = "/opt/tokenizers/piece_bpe_32k.model"


@query("op10_sentencepiece")
def op10(spark: SparkSession, sf_dir: str) -> DataFrame:
    pieces = fst.load(MODEL_FILE)
    return fst.round_trip(table(spark, sf_dir, "documents").select("doc_id", "text"), pieces).select("doc_id", "n_pieces", "n_fallback", "pieces_sha256", "decoded_same")


@query("op1_warc", r"""
WITH p AS (SELECT page_id, strlen(coalesce(html, '')) AS payload_bytes, sha256(coalesce(html, '')) AS payload_digest FROM pages),
f AS (SELECT payload_digest, min(page_id) AS first FROM p WHERE payload_bytes >= 100 GROUP BY payload_digest)
SELECT page_id, payload_bytes, p.payload_digest, CASE WHEN page_id > first THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN page_id > first THEN first END AS refers_to
FROM p LEFT JOIN f ON p.payload_digest = f.payload_digest AND p.payload_bytes >= 100""")
def op1(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.archived_pages(table(spark, sf_dir, "pages"))


@query("op3_suffix_array_dedup")
def op3(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_array.repeated_passages(table(spark, sf_dir, "documents"))


@query("op4_nearest_neighbours", r"""
WITH v AS (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS e FROM embeddings),
s AS (SELECT q.vec_id AS query_id, c.vec_id, list_inner_product(q.e, c.e) AS score FROM v q JOIN v c ON q.vec_id <> c.vec_id WHERE q.vec_id % 20 = 0),
r AS (SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank FROM s)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 20""")
def op4(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ann.search(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 20 == 0)


@query("op6_substring_dedup", r"""
WITH words AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
runs AS (SELECT doc_id, i, array_to_string(w[i + 1:i + 13], ' ') AS key
         FROM (SELECT doc_id, w, unnest(range(len(w) - 12)) AS i FROM words WHERE len(w) >= 13)),
first AS (SELECT key, min(doc_id) AS first FROM runs GROUP BY key HAVING min(doc_id) < max(doc_id)),
gone AS (SELECT DISTINCT doc_id, unnest(range(i, i + 13)) AS p FROM runs r JOIN first f ON r.key = f.key WHERE r.doc_id > f.first),
each AS (SELECT doc_id, unnest(w) AS word, unnest(range(len(w))) AS p FROM words),
kept AS (SELECT e.doc_id, count(*) AS n, string_agg(word, ' ' ORDER BY e.p) AS t FROM each e LEFT JOIN gone g ON e.doc_id = g.doc_id AND e.p = g.p
         WHERE g.p IS NULL GROUP BY e.doc_id)
SELECT w.doc_id, len(w.w)::BIGINT AS n_words, len(w.w)::BIGINT - coalesce(k.n, 0) AS n_removed, sha256(coalesce(k.t, '')) AS kept_sha256
FROM words w LEFT JOIN kept k ON w.doc_id = k.doc_id""")
def op6(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring.remove_repeats(table(spark, sf_dir, "documents")).drop("kept")


@query("op9_quotation_linking")
def op9(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = quotes.unquoted_conversations(table(spark, sf_dir, "conversations"))
    return out.withColumn("body_sha256", sha_text("body")).drop("body")


@query("op11_line_frequency", r"""
WITH t AS (SELECT doc_id, source, coalesce(text, '') AS text FROM documents),
w AS (SELECT doc_id, text, regexp_extract_all(text, '[^\x20\x09-\x0D]+') AS w FROM t),
grams AS (SELECT doc_id, i, w[i] || ' ' || w[i + 1] || ' ' || w[i + 2] AS g
          FROM (SELECT doc_id, w, unnest(range(1, len(w) - 1)) AS i FROM w WHERE len(w) >= 3)),
again AS (SELECT doc_id, unnest([i, i + 1, i + 2]) AS p
          FROM (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, g) AS c FROM grams) WHERE c > 1),
rep AS (SELECT doc_id, count(DISTINCT p) AS n FROM again GROUP BY doc_id),
lines AS (SELECT doc_id, source, unnest(string_split(text, chr(10))) AS line, unnest(range(len(string_split(text, chr(10))))) AS pos FROM t),
keyed AS (SELECT *, regexp_replace(translate(trim(regexp_replace(line, '[\x20\x09-\x0D]+', ' ', 'g'), ' '),
                 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[0-9]', '0', 'g') AS key FROM lines),
held AS (SELECT *, len(string_split(key, ' ')) AS words FROM keyed WHERE key <> ''),
dup AS (SELECT doc_id, count(*) - count(DISTINCT line) AS n FROM held GROUP BY doc_id),
freq AS (SELECT source, key FROM held GROUP BY source, key HAVING count(DISTINCT doc_id) > 20),
lost AS (SELECT h.doc_id, sum(h.words)::BIGINT AS n FROM held h JOIN freq f ON h.key = f.key AND h.source IS NOT DISTINCT FROM f.source GROUP BY h.doc_id),
base AS (
  SELECT w.doc_id, len(w.w)::BIGINT AS n_words, coalesce(list_sum(list_transform(w.w, lambda x: length(x))), 0)::BIGINT AS word_chars,
         len(regexp_extract_all(text, '[#*$%&|<>]'))::BIGINT AS n_symbols, coalesce(dup.n, 0)::BIGINT AS n_dup_lines,
         coalesce(rep.n, 0)::BIGINT AS n_repeat_words, coalesce(lost.n, 0)::BIGINT AS n_lost_words
  FROM w LEFT JOIN dup ON w.doc_id = dup.doc_id LEFT JOIN rep ON w.doc_id = rep.doc_id LEFT JOIN lost ON w.doc_id = lost.doc_id),
judged AS (SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed FROM base)
SELECT *, NOT base_failed AND 100 * n_lost_words <= 50 * n_words AS kept FROM judged""")
def op11(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = line_frequency.judge(table(spark, sf_dir, "documents"))
    return out.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lost_words", "base_failed", "kept")


@query("op12_spelling_variants", r"""
WITH RECURSIVE crc AS (
  SELECT list(c ORDER BY i) AS t FROM (
    SELECT i, list_reduce(list_prepend(i, range(8)), lambda c, k: CASE WHEN c % 2 = 1 THEN xor(3988292384, c // 2) ELSE c // 2 END) AS c
    FROM (SELECT unnest(range(256)) AS i))),
runs AS (SELECT doc_id, translate(unnest(regexp_extract_all(text, '[A-Za-z\x{C0}-\x{FF}]+')),
         'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS run FROM documents),
each AS (SELECT doc_id, run, count(*) AS c, hex(encode(doc_id || ':' || run)) AS x FROM runs GROUP BY doc_id, run),
summed AS (SELECT run, c, xor(4294967295, list_reduce(list_prepend(4294967295,
             list_transform(range(length(x) // 2), lambda i: ('0x' || substr(x, 2 * i + 1, 2))::BIGINT)),
             lambda h, b: xor(t[xor(h & 255, b) + 1], h >> 8))) AS h FROM each, crc),
cut AS (SELECT CASE WHEN h % 97 = 0 THEN substr(run, 1, h % length(run)) || substr(run, h % length(run) + 2) ELSE run END AS word, c FROM summed),
vocab AS (SELECT word, sum(c)::BIGINT AS n FROM cut WHERE length(word) >= 5 GROUP BY word HAVING sum(c) >= 3),
dels AS (SELECT word, n, i, substr(word, 1, i) || substr(word, i + 2) AS d FROM (SELECT *, unnest(range(length(word))) AS i FROM vocab)),
near AS (SELECT a.word, b.word AS near, b.n FROM dels a JOIN dels b ON a.i = b.i AND a.d = b.d AND a.word <> b.word
         UNION SELECT a.word, b.word, b.n FROM dels a JOIN vocab b ON a.d = b.word
         UNION SELECT b.word, a.word, a.n FROM dels a JOIN vocab b ON a.d = b.word),
best AS (SELECT word, count(*) AS n_near, first(near ORDER BY n DESC, near) AS near, max(n) AS near_n FROM near GROUP BY word),
formed AS (SELECT v.word, v.n, coalesce(n_near, 0) AS n_near, CASE WHEN near_n >= 2 * v.n THEN near END AS form,
                  CASE WHEN near_n >= 2 * v.n THEN near_n END AS form_n FROM vocab v LEFT JOIN best b ON v.word = b.word),
walk AS (SELECT word, word AS at FROM formed UNION ALL SELECT w.word, f.form FROM walk w JOIN formed f ON w.at = f.word WHERE f.form IS NOT NULL)
SELECT f.*, w.at AS root FROM formed f JOIN walk w ON f.word = w.word JOIN formed e ON w.at = e.word AND e.form IS NULL""")
def op12(spark: SparkSession, sf_dir: str) -> DataFrame:
    return variants.variants(table(spark, sf_dir, "documents"))


@query("op13_collocations", r"""
WITH pieces AS (SELECT coalesce(lang, 'und') AS lang, unnest(string_split_regex(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                '[.,;:!?\x0A-\x0D]')) AS piece FROM documents),
w AS (SELECT lang, regexp_extract_all(piece, '[^\x20\x09]+') AS w FROM pieces),
grams AS (SELECT lang, k, array_to_string(w[i:i + k - 1], ' ') AS phrase
          FROM (SELECT lang, w, k, unnest(range(1, len(w) - k + 2)) AS i FROM w, (SELECT unnest([1, 2, 3]) AS k) WHERE len(w) >= k)),
f AS (SELECT lang, k, phrase, count(*) AS f FROM grams GROUP BY lang, k, phrase),
total AS (SELECT lang, sum(f)::BIGINT AS n FROM f WHERE k = 1 GROUP BY lang),
cand AS (SELECT lang, k, phrase, f AS a, string_split(phrase, ' ') AS w FROM f WHERE k > 1 AND f >= 10),
cut AS (SELECT *, array_to_string(w[1:c], ' ') AS left_part, array_to_string(w[c + 1:], ' ') AS right_part FROM (SELECT *, unnest(range(1, k)) AS c FROM cand)),
scored AS (SELECT cut.*, x.f AS l, y.f AS r, (1000000::HUGEINT * a * a // (x.f::HUGEINT * y.f))::BIGINT AS score
           FROM cut JOIN f x ON cut.lang = x.lang AND left_part = x.phrase JOIN f y ON cut.lang = y.lang AND right_part = y.phrase),
weakest AS (SELECT * FROM scored QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, c) = 1),
around AS (SELECT lang, phrase, max(a) AS a FROM (SELECT lang, unnest([array_to_string(w[1:2], ' '), array_to_string(w[2:3], ' ')]) AS phrase, a FROM cand WHERE k = 3)
           GROUP BY lang, phrase),
kept AS (SELECT w.* FROM weakest w LEFT JOIN around o ON w.lang = o.lang AND w.phrase = o.phrase WHERE o.a IS NULL OR 100 * o.a < 50 * w.a),
ranked AS (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank FROM kept)
SELECT r.lang, rank, phrase, a, l, r, n, score FROM ranked r JOIN total t ON r.lang = t.lang WHERE rank <= 2000""")
def op13(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collocations.collocations(table(spark, sf_dir, "documents"))
