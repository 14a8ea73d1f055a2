"""String functions against expected values and a plain-Python oracle."""
from pyspark.sql import functions as F

from leadvane.functions import dates, text

NAMES = [("Acme Ltd.", "acme"), ("Acme Holdings Co Ltd", "acme holdings"), ("B.V.", None), ("Ltd", None), ("Müller GmbH", "müller"),
         ("O'Neil & Sons, Inc", "oneil sons"), ("Coco", "coco"), ("a_b  C", "a b c"), ("Company Company", None), (None, None), ("Limited Edition", "limited edition")]
TEXTS = [("", "vague"), (None, "vague"), (" ? ", "vague"), ("Tell me more", "vague"), ("Need 30 seats", "specific"), ("£ 5k spend", "specific"),
         ("before Q3 please", "specific"), ("Lorem ipsum dolor", "copy_paste"), ("we want to grow", "neutral")]
TITLES = [("Student Director", "student"), ("VP", "senior"), ("Team Lead", "mid"), ("Analyst", "junior/ic"), (" \t", "not_asked/blank"), (None, "not_asked/blank"),
          ("International sales", "student"), ("Co-founder", "senior")]


def column(spark, pairs, fn):
    df = spark.createDataFrame([(i, p[0]) for i, p in enumerate(pairs)], "i int, t string")
    return [r[0] for r in df.orderBy("i").select(fn(F.col("t"))).collect()]


def test_names_texts_titles(spark):
    assert column(spark, NAMES, text.normalised_company) == [e for _, e in NAMES]
    assert column(spark, TEXTS, text.text_class) == [e for _, e in TEXTS]
    assert column(spark, TITLES, text.seniority) == [e for _, e in TITLES]


def test_boilerplate(spark):
    cases = [("LEADING provider of innovative solutions, dedicated to delivering best-in-class value to our stakeholders across all verticals through synergy", "copy_paste"),
             ("We are a leading provider of pens", "neutral"), ("Please consider the environment before printing this e-mail", "copy_paste"), (None, "vague"), ("...", "neutral")]
    assert column(spark, cases, text.text_class_v2) == [e for _, e in cases]
    assert column(spark, [("",), (None,)], text.best_similarity) == [0.0, 0.0]


def test_email_and_channel(spark):
    cases = [("a@gmail.example", "free"), ("a@x.example@gmail.example", "business"), (None, "business"), ("nothing", "business")]
    assert column(spark, cases, text.email_type) == [e for _, e in cases]
    df = spark.createDataFrame([("lead_form", "google"), (None, "instagram"), ("cpc", "chatgpt"), (None, None)], "m string, s string")
    assert [r[0] for r in df.select(text.channel(F.col("m"), F.col("s"))).collect()] == ["meta_leadads", "meta", "chatgpt", "organic_direct"]


REDACTED = [
    ("call +44 20 7946 0958 now", "call <phone> now"), ("mail a.b@c.example, 10.0.0.1 or fe80::1", "mail <email>, <ip> or <ip>"),
    ("on 2026-05-01 09:30:00", "on 2026-05-01 09:30:00"), ("2024-01-01 1234567", "<phone>"), ("::1 and 1:2:3:4:5:6:7:8", "<ip> and <ip>"),
    ("10:30:00", "10:30:00"), ("id 123456 ok", "id 123456 ok"), ("(020) 7946-0958", "<phone>"), ("+(44)1234567", "<phone>"),
    ("2026-05-01", "2026-05-01"), ("2001:db8::ff00:42:8329", "<ip>"), ("a1 23456789", "a<phone>"), ("1::", "<ip>"),
    ("1:2:3:4:5:6:7::", "1:2:3:4:5:6:7::"), ("12:34:56:78", "12:34:56:78"), ("::ffff", "<ip>"), ("", ""), (None, None),
    ("two: x@y.example and +1 (555) 010-0199", "two: <email> and <phone>"), ("1.2.3.4.5", "1.2.3.4.5")]


def test_redaction(spark):
    got = column(spark, [(raw,) for raw, _ in REDACTED], text.redact)
    wrong = [(raw, want, g) for (raw, want), g in zip(REDACTED, got) if g != want]
    assert not wrong, wrong


def test_dates(spark):
    rows = [("2026", "February", "28"), ("2026", "feb", "29"), ("2026", "13", "1"), (None, "1", "1"), ("2026", "6", "31")]
    df = spark.createDataFrame(rows, "y string, m string, d string")
    got = [r[0] for r in df.select(F.date_format(dates.date_from_parts(F.col("y"), F.col("m"), F.col("d")), "yyyy-MM-dd")).collect()]
    assert got == ["2026-02-28", None, None, None, None]
    assert column(spark, [("1e400",), ("inf",), ("1.5",), ("x",), ("",)], dates.finite_number) == [None, None, 1.5, None, None]
