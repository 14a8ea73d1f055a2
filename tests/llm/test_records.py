"""Archives, vector search and quotation linking next to plain Python."""
import hashlib
import math
import random
from pathlib import Path

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from check_oracles import _rows
from leadvane.llm import ann, queries, quotes, warc
from leadvane.llm.common import prepare


@pytest.mark.parametrize("spec", [warc.WarcSpec(), warc.WarcSpec(file_bytes=2000, block_lines=2, shard_captures=5)])
def test_archives(spark, spec):
    big = "<p>" + "é" * 100 + "</p>"
    rows = [(1, "http://a.b.com/x?q=1", big), (2, "http://a.b.com/x?q=1", big), (3, None, big), (4, "http://A.com:80/ y", None), (5, "", ""), (6, "http://[bad", "tiny"), (7, "//c.d", "tiny"),
            (None, "http://z.org", big), (8, "http://a.b.com/x?q=1", "x" * 300_000), (8, "http://a.b.com/x?q=1", "x" * 300_000)] + [(20 + i, "http://same.org/", big + str(i % 3)) for i in range(12)]
    df = prepare(spark).createDataFrame([(*r, "k") for r in rows], "page_id long, url string, html string, key string").repartition(3)
    want = []
    for i, _, h in rows:
        raw = (h or "").encode()
        same = [j for j, _, g in rows if j is not None and g == h]
        first = min(same, default=None)
        again = i is not None and len(raw) >= 100 and first < i
        want.append((i, len(raw), hashlib.sha256(raw).hexdigest(), "revisit" if again else "response", first if again else None))
    got = [(r.page_id, r.payload_bytes, r.payload_digest, r.record_type, r.refers_to) for r in warc.archived_pages(df, spec).collect()]
    assert sorted(got, key=str) == sorted(want, key=str)
    assert warc.archived_pages(df.limit(0), spec).collect() == []


def test_keys():
    assert warc.surt("https://m.x.example.com/fr/1?a=b") == "com,example,x,m)/fr/1?a=b"
    assert warc.surt("HTTP://User@Ex.ORG:81") == "org,ex:81)/" and warc.surt(None) == "-"
    fields, payload = warc.parse(warc.record(3, "http://a", b"body\r\n\r\nmore", "00", None, "d"))
    assert payload == b"body\r\n\r\nmore" and fields["warc-record-id"] == "<urn:page:3>"


def test_vectors(spark):
    rng = np.random.default_rng(1)
    v = rng.normal(size=(300, 70)) * rng.uniform(0.1, 5, (300, 1))
    v[50:90] = v[50]
    rows = [(i, [float(x) for x in v[i]]) for i in range(300)]
    odd = [(300, None), (320, [0.0] * 70), (340, [math.nan] + [1.0] * 69), (360, [None] + [1.0] * 69), (380, [math.inf] + [1.0] * 69), (400, [1.0] * 3), (None, [1.0] * 70), (20, rows[20][1]), (420, [])]
    df = prepare(spark).createDataFrame(rows + odd, "vec_id long, embedding array<double>").repartition(4)
    spec = ann.CodeSpec(codes_in_block=64, queries_in_block=4)
    got = {(r.query_id, r["rank"]): (r.vec_id, r.score) for r in ann.search(df, F.col("vec_id") % 20 == 0, spec).collect()}
    hits = total = 0
    for q in range(0, 300, 20):
        exact = sorted(((-float(v[q] @ v[c]), c) for c in range(300) if c != q))[:20]
        mine = [got[q, k][0] for k in range(1, 21)]
        assert [got[q, k][1] for k in range(1, 21)] == sorted((got[q, k][1] for k in range(1, 21)), reverse=True) and q not in mine
        assert all(abs(got[q, k][1] - v[q] @ v[got[q, k][0]]) < 1e-9 for k in range(1, 21))
        hits += len(set(mine) & {c for _, c in exact})
        total += 20
    assert len(got) == total and hits / total >= 0.98
    assert ann.search(df.where("vec_id < 5"), F.col("vec_id") == 0).count() == 4
    assert ann.search(df.limit(0), F.col("vec_id") % 20 == 0).collect() == []


def test_quotes(spark):
    rows = [(1, 0, "user", "How do I open a file?\nThanks  a lot"), (1, 1, "assistant", "> how do i  open a file?\nUse open()."), (1, 2, "user", "Something else"),
            (1, 3, "user", "> Use open().\n>> How do I open a file?\n\nIt fails\n"), (1, 4, "assistant", "> unknown line\n>\nSee docs"), (1, 5, "user", " > > It fails\n> Something else\nok"),
            (2, 0, "user", None), (2, 1, "user", ""), (2, 2, "user", "> How do I open a file?"), (None, 1, "user", "> Use open()."), (3, None, "user", "x"), (2, 1, "user", ""), (4, 7, "user", "> later line"), (4, 8, "user", "later line")]
    df = prepare(spark).createDataFrame([(*r, "b") for r in rows], "conv_id long, turn long, role string, text string, body string").repartition(3)
    got = quotes.unquoted_conversations(df).collect()
    assert len(got) == len(rows)
    by = {(r.conv_id, r.turn): r for r in got}
    assert [(by[1, t].parent_turn, by[1, t].root_turn, by[1, t].depth) for t in range(6)] == [(None, 0, 0), (0, 0, 1), (None, 2, 0), (1, 0, 2), (None, 4, 0), (2, 2, 1)]
    assert [(by[1, t].n_quoted, by[1, t].n_linked) for t in range(6)] == [(0, 0), (1, 1), (0, 0), (2, 2), (2, 0), (2, 2)]
    assert by[1, 1].body == "Use open()." and by[1, 3].body == "It fails" and by[2, 2].body == "" and by[2, 0].body == ""
    assert by[2, 2].parent_turn is None and by[4, 7].parent_turn is None and by[None, 1].parent_turn is None
    assert [r.turn for r in got if r.conv_id == 1] == [0, 1, 3, 2, 5, 4]
    assert quotes.unquoted_conversations(df.limit(0)).collect() == []


def test_a_long_thread(spark):
    rows = [(1, t, "user", f"line {t}" if t == 0 else f"> line {t - 1}\nline {t}") for t in range(40)]
    random.Random(2).shuffle(rows)
    got = quotes.unquoted_conversations(prepare(spark).createDataFrame(rows, "conv_id long, turn long, role string, text string")).collect()
    assert all(r.root_turn == 0 and r.depth == r.turn for r in got) and [r.turn for r in got] == list(range(40))


@pytest.mark.parametrize("name", sorted(queries.ORACLES))
def test_query_equals_sql(spark, name):
    sf = "/root/testdata/sf0.001"
    db = duckdb.connect()
    for f in Path(sf).glob("*.parquet"):
        db.execute(f"CREATE VIEW {f.stem} AS SELECT * FROM '{f}'")
    df = queries.QUERIES[name](spark, sf)
    cur = db.execute(queries.ORACLES[name])
    cols = [d[0] for d in cur.description]
    assert _rows(df.columns, df.collect()) == _rows(cols, cur.fetchall())


def test_tiles(spark):
    """groups and stripes are bounded, no block is broadcast, and tiles do not change what is found."""
    spec = ann.CodeSpec()
    assert ann._grid(61, 76, 48, spec) == (2, 24) and ann._grid(1504, 1900, 48, spec) == (24, 60) and ann._grid(0, 1, 48, spec) == (1, 1)
    rng = np.random.default_rng(5)
    df = prepare(spark).createDataFrame([(i, [float(x) for x in rng.normal(size=8)]) for i in range(400)], "vec_id long, embedding array<double>")
    rows = []
    for most in (1, 64):
        found = ann.search(df, F.col("vec_id") % 20 == 0, ann.CodeSpec(codes_in_block=20, queries_in_block=3, code_blocks_in_tile=most, query_blocks_in_tile=most))
        assert "Broadcast" not in found._jdf.queryExecution().executedPlan().toString()
        rows.append(sorted(found.collect()))
    assert rows[0] == rows[1] and len(rows[0]) == 400
