"""The registry, and a slice of the queries next to their SQL on the smallest tables."""
from pathlib import Path

import duckdb
import pytest

import __spark_entry__ as entry_points
from check_oracles import _rows

SF = "/root/testdata/sf0.001"
SMALL = ["A5_label_source_counts", "L6_horizon_label", "W1_repeat_flag", "J2_name_enrichment", "G2_v2_features", "E1_auc", "T3_tie_averaged_capture",
         "C7_synthesised_events", "V3_upload_values", "J8_similar_pairs", "Q6_bad_answers", "W2_score_deciles"]


def test_registry():
    queries, sql = entry_points.queries(), entry_points.oracle_sql()
    assert len(queries) > 200 and set(sql) <= set(queries)
    assert all(s.lstrip().upper().startswith(("SELECT", "WITH")) for s in sql.values())


def test_entry(spark):
    assert {r["label_source"] for r in entry_points.entry(spark).collect()} >= {"won", "all"}


@pytest.mark.parametrize("name", SMALL)
def test_query_equals_sql(spark, name):
    db = duckdb.connect()
    for f in Path(SF).glob("*.parquet"):
        db.execute(f"CREATE VIEW {f.stem} AS SELECT * FROM '{f}'")
    df = entry_points.queries()[name](spark, SF)
    cur = db.execute(entry_points.oracle_sql()[name])
    cols = [d[0] for d in cur.description]
    assert _rows(df.columns, df.collect()) == _rows(cols, cur.fetchall())
