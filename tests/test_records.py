"""CSV files read in splits next to the whole-file reader."""
import csv
import random

import pytest

from leadvane.sources import records


def write(path, rows, end="\n"):
    with open(path, "w", newline="") as f:
        w = csv.writer(f, lineterminator=end)
        w.writerow(["id", "text", "note"])
        w.writerows(rows)


@pytest.mark.parametrize("end", ["\n", "\r\n"])
@pytest.mark.parametrize("size", [37, 400, 1 << 20])
def test_splits_give_the_same_cells(spark, tmp_path, size, end):
    rng = random.Random(size)
    for part in range(3):
        rows = []
        for i in range(120):
            cell = rng.choice(["plain", "", 'said "yes"', "two\nlines", "a,b\n\n\"c\"\n,", '"', "x" * 90 + "\n" * 5 + "y" * 90, "ünï\nü"])
            rows.append([part * 1000 + i, cell, rng.choice(["", "n", "line\nbreak"])])
        write(tmp_path / f"p{part}.csv", rows, end)
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", str(size))
    try:
        got = records.read_text_csv(spark, str(tmp_path))
        if size == 37:
            assert records._lines(spark, str(tmp_path)).rdd.getNumPartitions() > 100
        got = sorted(tuple(r) for r in got.collect())
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)
    want = spark.read.option("header", True).option("multiLine", True).option("escape", '"').csv(str(tmp_path))
    assert got == sorted(tuple(r) for r in want.collect()) and len(got) == 360


def test_plain_files_are_read_line_by_line(spark, tmp_path):
    write(tmp_path / "a.csv", [[1, 'q"q', ""], [2, "b,c", "d"]])
    df = records.read_text_csv(spark, str(tmp_path))
    assert sorted(tuple(r) for r in df.collect()) == [("1", 'q"q', None), ("2", "b,c", "d")]
    assert "MapInArrow" not in df._jdf.queryExecution().toString()


def test_header_alone(spark, tmp_path):
    (tmp_path / "a.csv").write_text('id,"te\nxt",note\n')
    assert records.records(spark, str(tmp_path)).where("NOT first").count() == 0
