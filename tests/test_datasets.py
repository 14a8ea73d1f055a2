"""Conversion, quality, judgments, readers and streaming."""
from dataclasses import replace

import pytest
from pyspark.sql import functions as F

from leadvane.config import BENCHMARK_RULES
from leadvane.operators import conversion, judgments, profiling, quality
from leadvane.operators.conversion import Expr, FieldMap, Outcome, SourceMapping, apply, col
from leadvane.sources import tables
from leadvane.streaming import jobs

DEALS = [("1", "2026-01-01", "2026-01-01", "2026-01-01", "yes", "10", "x"), ("2", "2026-01-05", "2026-01-03", "2026-01-04", "no", None, "y"),
         ("3", "2026-01-02", None, None, "no", "5", " "), ("4", "2026-01-02", None, "2026-03-01T10:00:00Z", "yes", "-3", "x")]
MAPPING = SourceMapping("deals", ("d",), col("d.made"), Outcome("won_flag", "d.won", won_values=("yes",), lost_values=("no",), lost_without_close="as_of"), "2026-06-01",
                        row_order=("n",), contacted_at=col("d.met"), close_at=col("d.closed"), deal_value=col("d.amount"),
                        fields=(FieldMap("d.kind", value_map={"x": {"utm_source": "google"}, "y": {}}),))


def deals(spark):
    return {"d": spark.createDataFrame(DEALS, "n string, made string, met string, closed string, won string, amount string, kind string")}


def test_event_synthesis(spark):
    out = conversion.convert(deals(spark), MAPPING, {})
    assert out["violations"].count() == 0
    rows = [(r["lead_id"][-1], r["stage"], r["deal_value"], str(r["t"])) for r in out["crm"].withColumn("t", F.date_format("changed_at", "MM-dd HH:mm:ss")).orderBy("lead_id", "changed_at").collect()]
    assert rows == [("1", "New", None, "01-01 00:00:00"), ("1", "Contacted", None, "01-01 00:00:01"), ("1", "Won", 10.0, "01-01 00:00:02"),
                    ("2", "New", None, "01-05 00:00:00"), ("2", "Contacted", None, "01-05 00:00:01"), ("2", "Lost", None, "01-05 00:00:02"),
                    ("3", "New", None, "01-02 00:00:00"), ("3", "Lost", None, "06-01 00:00:00"), ("4", "New", None, "01-02 00:00:00"), ("4", "Won", None, "03-01 10:00:00")]
    counts = out["counts"].first()
    assert (counts["crm_ties_separated"], counts["crm_times_reordered"], counts["lost_dated_at_as_of"], counts["non_positive_deal_values_blanked"]) == (2, 1, 1, 1)
    assert out["leads"].where("email like 'deals-00000_@unmapped.invalid'").count() == 4


def test_refusals(spark):
    strict = replace(MAPPING, as_of="2026-02-01", outcome=Outcome("won_flag", "d.won", won_values=("yes",), lost_values=("nope",)),
                     fields=(FieldMap("d.kind", value_map={"x": {}}),))
    found = {(r["check_id"], r["key"][-1]) for r in conversion.convert(deals(spark), strict, {})["violations"].collect()}
    assert found == {("uncovered_outcome", "2"), ("uncovered_outcome", "3"), ("unlisted_value", "2"), ("event_after_as_of", "4")}
    with pytest.raises(ValueError, match="uncovered_outcome"):
        quality.require_clean(conversion.convert(deals(spark), strict, {})["violations"])
    two = replace(MAPPING, sources=("d", "e"), joins={"e": "n"})
    with pytest.raises(ValueError, match="repeats"):
        conversion.join_sources({**deals(spark), "e": spark.createDataFrame([("1",), ("1",)], "n string")}, two)
    for bad in (lambda: Expr("median"), lambda: apply("product", "d.a"), lambda: col("nodot"), lambda: FieldMap("d.a"),
                lambda: replace(MAPPING, fields=(FieldMap("d.a", "email"), FieldMap("d.b", "email")))):
        with pytest.raises(ValueError):
            bad()


def test_new_leads_are_refused_one_by_one(spark):
    frames = {"d": deals(spark)["d"].drop("won", "met", "closed", "amount").union(spark.createDataFrame([("5", "2026-01-09", "tiktok")], "n string, made string, kind string"))}
    leads, refused = conversion.convert_new_leads(frames, MAPPING)
    assert sorted(r["lead_id"] for r in leads.collect()) == [f"new-{i:06d}" for i in (1, 2, 3, 4)]
    assert [(r["key"], r["message"]) for r in refused.collect()] == [("new-000005", "tiktok")]


def test_gates(spark):
    df = spark.createDataFrame([("a",), ("a",), (None,)], "lead_id string")
    assert [tuple(r) for r in quality.repeated_keys(df, "lead_id").collect()] == [("a", 2)]
    with pytest.raises(ValueError, match="at least 5"):
        quality.require_rows(df, 5, "leads")
    with pytest.raises(ValueError, match="without a lead"):
        quality.require_complete(spark.createDataFrame([("a",)], "lead_id string"), spark.createDataFrame([("a",), ("b",)], "lead_id string"))
    assert quality.check_rules(BENCHMARK_RULES, ["A", "Q"]) == ["form variant Q has no base value"]
    v = spark.createDataFrame([("c1", str(i)) for i in range(9)], "check_id string, key string")
    assert tuple(quality.violation_examples(v, 3).first()) == ("c1", 9, "0,1,2")


def test_person_columns():
    yes = ["first_name", "manager", "accountOwner", "assigned_to", "created_by", "name", "company_contact", "agents"]
    no = ["company_name", "lead_id", "customer_type", "lead_time", "to", "product", "lead_behaviour_profile", "hotel_name"]
    assert all(map(profiling.is_person_column, yes)) and not any(map(profiling.is_person_column, no))


def test_safe_examples_hide_people(spark):
    df = spark.createDataFrame([("Cara Losch", "City Hotel", "a@b.example"), ("Ann Peel", "Resort Hotel", "x")], "rep_label string, stay string, note string")
    got = {(r["column"], r["example"]) for r in profiling.safe_examples(df).collect()}
    assert ("rep_label", "<name>") in got and ("stay", "City Hotel") in got and ("note", "<email>") in got


def test_judgments(spark):
    fields = judgments.card_fields(F.lit(None).cast("string"), [F.lit(" "), F.lit("Acme")], F.lit("CEO"), F.lit("a@b@C.example"))
    row = spark.range(1).select(*[v.alias(k) for k, v in fields.items()], judgments.card_text(fields).alias("card")).first()
    assert tuple(row[:4]) == ("(blank)", "Acme", "CEO", "c.example") and row["card"].splitlines()[0] == "What they want to solve: (blank)"
    stamps = spark.createDataFrame([("b", "v", "m"), ("b", "v", "n")], "brief_hash string, prompt_version string, model_id string")
    with pytest.raises(ValueError):
        judgments.require_one_stamp(stamps)
    with pytest.raises(ValueError, match="neither"):
        judgments.context_columns(spark.range(1), spark.range(1))


def test_readers_refuse(spark, tmp_path):
    spark.createDataFrame([("d",)], "domain string").write.option("header", True).csv(f"{tmp_path}/c")
    with pytest.raises(ValueError, match="company_name"):
        tables.read_companies(spark, f"{tmp_path}/c")
    meta = spark.createDataFrame([("2026-01-01", "2026-02-01", None)], "as_of string, test_from string, currency string")
    with pytest.raises(ValueError, match="after"):
        tables.dataset_dates(spark, meta)
    assert tables.dataset_dates(spark, None)[0].as_of == "2026-09-24"


def test_close_events_mature_and_late_win(spark, tmp_path):
    day = [("2026-01-01", 1, "New", None), ("2026-01-01", 2, "New", None), ("2026-01-02", 2, "Won", 9.0), ("2026-01-20", 3, "New", None), ("2026-01-21", 3, "Contacted", None), ("2026-01-25", 1, "Won", 4.0)]
    df = spark.createDataFrame(day, "d string, lead_id bigint, stage string, deal_value double").select("lead_id", "stage", "deal_value", F.to_timestamp("d").alias("changed_at"))
    for i, cond in enumerate(("changed_at < '2026-01-10'", "lead_id = 3 and stage = 'New'", "stage = 'Contacted'", "changed_at > '2026-01-21' and lead_id = 1")):
        df.where(cond).coalesce(1).write.parquet(f"{tmp_path}/tmp{i}")
    spark.createDataFrame([], df.schema).write.parquet(f"{tmp_path}/in")
    for i in range(4):
        spark.read.parquet(f"{tmp_path}/tmp{i}").coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
        stream = jobs.file_stream(spark, f"{tmp_path}/in", df.schema, 100)
        jobs.run_to_end(jobs.close_events(stream, 10.0, "0 seconds"), jobs.parquet_sink(f"{tmp_path}/out"), f"{tmp_path}/cp")
    out = spark.read.schema("lead_id bigint, stage string, value double, at timestamp, batch int").parquet(f"{tmp_path}/out")
    got = sorted((r["lead_id"], r["stage"], r["value"]) for r in out.collect())
    assert got == [(1, "matured", 0.0), (1, "won", 4.0), (2, "won", 9.0)]


def test_ledger_and_repeats_across_batches(spark, tmp_path):
    rows = spark.createDataFrame([(i % 5, "s") for i in range(40)], "lead_id bigint, stage string")
    rows.repartition(4).write.parquet(f"{tmp_path}/in")
    for _ in range(2):  # the second run finds nothing new
        jobs.run_to_end(jobs.file_stream(spark, f"{tmp_path}/in", rows.schema, 1), jobs.ledger_sink(f"{tmp_path}/out", ["lead_id", "stage"]), f"{tmp_path}/cp")
    assert sorted(r["lead_id"] for r in spark.read.parquet(f"{tmp_path}/out").collect()) == [0, 1, 2, 3, 4]
    first = jobs.first_submissions(jobs.file_stream(spark, f"{tmp_path}/in", rows.schema, 1), "lead_id", "stage")
    jobs.run_to_end(first, jobs.parquet_sink(f"{tmp_path}/first"), f"{tmp_path}/cp2")
    assert spark.read.parquet(f"{tmp_path}/first").count() == 5
