"""The as-of carry next to plain Python, with a key that holds most rows; refusals of judgments and operands."""
import random

import pytest
from pyspark.sql import functions as F

from leadvane.config import JUDGMENTS
from leadvane.operators import conversion, judgments
from leadvane.operators.asof import carry_last
from leadvane.operators.conversion import FieldMap, Outcome, SourceMapping, apply, col


def test_carry_over_buckets(spark):
    rng = random.Random(4)
    rows = [(rng.choice(["hot"] * 6 + ["a", "b", None]), rng.randrange(400), i, rng.choice([None, None, None, i])) for i in range(900)]
    df = spark.createDataFrame(rows, "k string, t int, id int, v int").repartition(4)
    got = {r.id: r.last for r in carry_last(df, "k", F.floor(F.col("t") / 10), ["t", "id"], F.col("v"), "last").collect()}
    last = {}
    want = {}
    for k, t, i, v in sorted(rows, key=lambda r: (r[1], r[2])):
        if k is None:
            want[i] = None
            continue
        last[k] = v if v is not None else last.get(k)
        want[i] = last[k]
    assert got == want
    assert carry_last(df, "k", F.floor(F.col("t") / 10), ["t", "id"], F.col("v"), "last").columns == ["k", "t", "id", "v", "last"]


def judged(spark, rows):
    names = ["lead_id", "status", *judgments.STAMP_COLUMNS, *JUDGMENTS]
    return spark.createDataFrame([(i, "ok", *stamp, *[values.get(j, JUDGMENTS[j][0]) for j in JUDGMENTS]) for i, stamp, values in rows],
                                 ", ".join(f"{n} {'long' if n == 'lead_id' else 'string'}" for n in names))


def test_judgments_that_cannot_be_used_are_refused(spark):
    leads, stamp = spark.range(1, 4).withColumnRenamed("id", "lead_id"), tuple("abc"[:len(judgments.STAMP_COLUMNS)])
    assert judgments.context_design(leads, judged(spark, [(1, stamp, {}), (2, stamp, {})])).count() == 3
    with pytest.raises(ValueError, match="lead_id"):
        judgments.context_design(leads, judged(spark, [(1, stamp, {}), (1, stamp, {})]))
    with pytest.raises(ValueError, match="share one set"):
        judgments.context_design(leads, judged(spark, [(1, stamp, {}), (2, tuple("xyz"[:len(stamp)]), {})]))
    name = next(iter(JUDGMENTS))
    with pytest.raises(Exception, match="not in its list"):
        judgments.context_design(leads, judged(spark, [(1, stamp, {name: "unheard of"})])).collect()


def test_operands_that_are_no_numbers(spark):
    """A text in a number's place is a violation with its column, wherever the expression reads it."""
    e = apply("product", "s.price", apply("sum", "s.a", "s.b"))
    assert [n.ref for n in e.numbers()] == ["s.price", "s.a", "s.b"] and col("s.a").numbers() == []
    rows = [("1", "2026-01-01", "yes", "10", "2"), ("2", "2026-01-02", "yes", "12 EUR", "3"), ("3", "2026-01-03", "no", "5", "three"), ("4", "2026-01-04", "no", None, "1e999")]
    frames = {"d": spark.createDataFrame(rows, "n string, made string, won string, price string, pieces string")}
    outcome = Outcome("won_flag", "d.won", won_values=("yes",), lost_values=("no",), lost_without_close="as_of")
    for value, want in ((apply("product", "d.price", "d.pieces"), [("2", "d.price"), ("3", "d.pieces"), ("4", "d.pieces")]), (col("d.price"), [("2", "d.price")])):
        mapping = SourceMapping("deals", ("d",), col("d.made"), outcome, "2026-06-01", row_order=("n",), won_at=col("d.made"), deal_value=value, fields=(FieldMap("d.won", value_map={"yes": {"utm_source": "google"}, "no": {}}),))
        bad = conversion.convert(frames, mapping, {})["violations"].where("check_id = 'not_a_number'").collect()
        assert sorted((r["key"][-1], r["column"]) for r in bad) == want
