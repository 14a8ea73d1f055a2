"""Monitors, uploads and steering on small tables with known answers."""
import datetime as dt
import hashlib
import json
import math
import random

import pytest
from pyspark.sql import functions as F

from leadvane.operators import monitoring, steering, uploads, value

LEVELS = {"colour": ("red", "blue", "green"), "size": ("s", "l")}


def leads(spark, rows, week):
    return spark.createDataFrame([(*r, week) for r in rows], "colour string, size string, week int")


def test_drift_is_the_smoothed_sum(spark):
    train = leads(spark, [("red", "s")] * 60 + [("blue", "l")] * 40, 0)
    base = monitoring.level_baseline(train, LEVELS)
    share = {(r.feature, r.level): r.share for r in base.collect()}
    assert share["colour", "green"] == pytest.approx(0.5 / 102) and share["size", "(other)"] == pytest.approx(0.5 / 101.5)
    new = leads(spark, [("green", "s")] * 30 + [("violet", None)] * 10 + [("red", "l")] * 10, 1).union(leads(spark, [("red", "s")] * 6 + [("blue", "l")] * 4, 2))
    got = {(r.period, r.feature): (r.leads, r.psi, r.status) for r in monitoring.level_drift(new, F.col("week"), base, LEVELS).collect()}

    def psi(feature, counts):
        n = sum(counts.values())
        return sum((a - b) * math.log(a / b) for (f, level), b in share.items() if f == feature for a in [(counts.get(level, 0) + b) / (n + 1)])
    assert got[1, "colour"] == (50, pytest.approx(psi("colour", {"green": 30, "(other)": 10, "red": 10})), "alert")
    assert got[1, "size"] == (50, pytest.approx(psi("size", {"s": 30, "l": 10, "(other)": 10})), "alert")
    assert got[2, "colour"][2] == got[2, "size"][2] == "ok"


def test_calendar_rolling_and_runs(spark):
    rng, day0 = random.Random(5), dt.date(2024, 2, 25)
    rows = []
    for part in "abc":
        for d in range(70):
            if rng.random() < .7:
                n = rng.randrange(1, 6)
                rows.append(("m", part, day0 + dt.timedelta(d), n, rng.randrange(n + 1)))
    rates = spark.createDataFrame(rows, "monitor string, part string, day date, n long, bad long").repartition(3)
    expected = spark.createDataFrame([("m", "a", .2), ("m", "b", .45)], "monitor string, part string, expected double")
    got = {(r.part, r.day): r for r in monitoring.rate_alerts(rates, expected, 7).collect()}
    known, limit = {(p, d): (n, b) for _, p, d, n, b in rows}, {"a": .2, "b": .45}
    for part in "abc":
        days = sorted(d for p, d in known if p == part)
        run = 0
        for k in range((days[-1] - days[0]).days + 1):
            d = days[0] + dt.timedelta(k)
            n, bad = known.get((part, d), (0, 0))
            past = [known.get((part, d - dt.timedelta(j)), (0, 0)) for j in range(1, 8)]
            seen = sum(x for x, _ in past)
            breach = part in limit and n > 0 and (bad / n > 2 * limit[part] or bad / n > limit[part] + .1)
            run = run + 1 if breach else 0
            r = got.pop((part, d))
            assert (r.n, r.bad, r.breach, r.run, r.alert) == (n, bad, breach, run, run >= 2)
            assert r.rolling == (pytest.approx(sum(x for _, x in past) / seen) if seen else None)
    assert not got


def test_weeks_without_leads(spark):
    rows = spark.createDataFrame([(dt.date(2024, 1, 1), 3, 10.0), (dt.date(2024, 1, 22), 1, 30.0), (dt.date(2024, 1, 29), 2, 20.0)], "week date, leads long, p50 double")
    got = [(r.week.day, r.leads, r.previous_p50) for r in monitoring.weekly_calendar(rows).orderBy("week").collect()]
    assert got == [(1, 3, None), (8, 0, 10.0), (15, 0, None), (22, 1, None), (29, 2, 30.0)]
    assert monitoring.weekly_calendar(rows.limit(0)).count() == 0


def test_volume_verdict(spark):
    rows = spark.createDataFrame([(2000, 400), (1999, 400), (5000, 399), (1000, 200), (999, 900), (5000, 199)], "r long, w long")
    got = [x[0] for x in rows.select(monitoring.volume_verdict(F.col("r"), F.col("w"))).collect()]
    assert got == ["accept", "conditional", "conditional", "conditional", "decline", "decline"]


UPLOAD = """lead_id long, created_at timestamp, platform string, upload double, won_at timestamp, deal_value double, email string, phone string, consent boolean, gclid string,
gbraid string, wbraid string, fbclid string, fbp string, li_fat_id string, oppref string, meta_lead_id string"""


def t(text):
    return dt.datetime.fromisoformat(text)


def upload_row(i, platform, created, won=None, deal=None, **ids):
    names = ["email", "phone", "consent", "gclid", "gbraid", "wbraid", "fbclid", "fbp", "li_fat_id", "oppref", "meta_lead_id"]
    return (i, t(created), platform, 100.0 + i, t(won) if won else None, deal, *[ids.get(n, True if n == "consent" else None) for n in names])


def sent(spark, path):
    return {(r.run, r.lead_id, r.stage): r for r in uploads.read_ledger(spark, path).collect()}


def test_runs_send_each_change_once(spark, tmp_path):
    first = [upload_row(1, "google", "2024-01-01", "2024-02-01", 500.0, gclid="g1", email=" Ann@X.example "),
             upload_row(2, "google", "2024-01-01", "2024-05-20", 700.0, email="bob@x.example"),          # more than 90 days later
             upload_row(3, "google", "2024-01-01", gbraid="b", consent=False, email="c@x.example"),        # matures without a win
             upload_row(4, "google", "2024-01-01", "2024-02-01", None, email=""),                          # amount not known
             upload_row(5, "meta", "2024-05-01", "2024-05-30", 90.0, fbclid="f5", fbp="p5", phone="+44 (0)20 1"),
             upload_row(6, "meta", "2024-01-01", "2024-02-01", 90.0), upload_row(7, "meta", "2024-01-01"),
             upload_row(8, None, "2024-01-01", "2024-02-01", 90.0), upload_row(9, "google", "2024-08-01", gclid="late")]
    path = str(tmp_path / "ledger")

    def run(rows, name, as_of):
        df = spark.createDataFrame(rows, UPLOAD)
        uploads.send(df.withColumns(value.close_stage(120, as_of)), path, name, as_of)
    run(first, "1", "2024-06-01")
    got = sent(spark, path)
    assert {(i, s): r.kind for (_, i, s), r in got.items()} == {
        (1, "submit"): "CONVERSION", (2, "submit"): "CONVERSION", (3, "submit"): "CONVERSION", (4, "submit"): "CONVERSION", (5, "submit"): "Lead", (6, "submit"): "Lead",
        (7, "submit"): "Lead", (1, "close"): "RESTATEMENT", (2, "close"): "CLOSED_WON", (3, "close"): "RETRACTION", (5, "close"): "ClosedWon"}
    assert json.loads(got["1", 1, "submit"].payload) == {"order_id": "1", "type": "CONVERSION", "conversion_time": "2024-01-01 00:00:00+00:00", "value": 101.0, "currency": "GBP",
                                                         "click_id_type": "gclid", "click_id": "g1", "hashed_email": hashlib.sha256(b"ann@x.example").hexdigest()}
    assert "click_id" not in json.loads(got["1", 2, "submit"].payload) and "hashed_email" in json.loads(got["1", 2, "close"].payload)
    assert not {"hashed_email", "value"} & set(json.loads(got["1", 3, "close"].payload)) and "hashed_email" not in json.loads(got["1", 4, "submit"].payload)
    event = json.loads(got["1", 5, "close"].payload)
    assert event["event_id"] == "5-closed" and event["user_data"] == {"fbc": f"fb.1.{int(t('2024-05-01').replace(tzinfo=dt.UTC).timestamp() * 1000)}.f5", "fbp": "p5",
                                                                       "ph": [hashlib.sha256(b"+440201").hexdigest()]}
    run(first, "1", "2024-06-01")  # the same run again replaces its own rows
    assert sent(spark, path).keys() == got.keys()
    second = [r if r[0] not in (3, 4) else upload_row(3, "google", "2024-01-01", "2024-06-10", 40.0) if r[0] == 3 else upload_row(4, "google", "2024-01-01", "2024-02-01", 60.0)
              for r in first]
    run(second, "2", "2024-09-01")
    new = {(i, s): r.kind for (n, i, s), r in sent(spark, path).items() if n == "2"}
    assert new == {(3, "close"): "CLOSED_WON", (4, "close"): "RESTATEMENT", (9, "submit"): "CONVERSION"}  # a late win and a late amount
    run(second, "3", "2024-09-01")
    assert not [k for k in sent(spark, path) if k[0] == "3"]
    held = spark.createDataFrame(first, UPLOAD).withColumns(value.close_stage(120, "2024-06-01"))
    assert [r.lead_id for r in uploads.held(held).collect()] == [4]


def test_match_kinds(spark):
    rows = [upload_row(1, "google", "2024-01-01", gclid="g"), upload_row(2, "google", "2024-01-01", email="a@b"), upload_row(3, "google", "2024-01-01", email="a@b", consent=False),
            upload_row(4, "meta", "2024-01-01", fbp="p", consent=False), upload_row(5, "google", "2024-01-01", fbp="p"), upload_row(6, "meta", "2024-01-01", meta_lead_id="m")]
    df = spark.createDataFrame(rows, UPLOAD).withColumn("channel", F.when(F.col("lead_id") == 6, "meta_leadads").otherwise(F.col("platform")))
    got = {r.lead_id: r.match for r in df.select("lead_id", uploads.match_kind(F.col("channel")).alias("match")).collect()}
    assert got == {1: "click_id", 2: "email", 3: "none", 4: "browser_id", 5: "none", 6: "lead_form"}
    shares = {r.match: (r.leads, r.value) for r in uploads.unattributable(df, F.col("channel"), "upload").collect()}
    assert shares["none"] == (2, 208.0)


def test_target_guard_and_steering(spark):
    rng = random.Random(2)
    rows = [(1.0 if rng.random() < .4 else 0.0, rng.choice([None, rng.uniform(1, 100)]), rng.choice("xy"), rng.uniform(.1, .9)) for _ in range(900)]
    train = spark.createDataFrame(rows, "y double, deal_value double, band string, p double")
    got = {r.quantile: r for r in steering.threshold_search(train, min_rows=900, min_wins=40).collect()}
    for q, r in got.items():
        assert r.target_wins == sum(y == 1 and v is not None and v >= r.minimum for y, v, _, _ in rows) and r.allowed == (r.target_wins >= 40)
    assert [q for q, r in got.items() if r.chosen] == [max(q for q, r in got.items() if r.allowed)]
    assert not any(r.chosen or r.allowed for r in steering.threshold_search(train, min_rows=901).collect())
    low = got[0.75].minimum
    out = steering.steering_value(train, train, "band", low, low=3.0).collect()
    hits = [v for y, v, _, _ in rows if y == 1 and v is not None and v >= low]
    won = {b: [v is not None and v >= low for y, v, c, _ in rows if y == 1 and c == b] for b in "xy"}
    overall = sum(map(sum, won.values())) / sum(map(len, won.values()))
    for r in out[:50]:
        p = r.p * (sum(won[r.band]) + 10 * overall) / (len(won[r.band]) + 10)
        assert r.p_target == pytest.approx(p) and r.steer == pytest.approx(p * sum(hits) / len(hits) + (1 - p) * 3)
    gap = steering.steering_gaps(train.withColumn("value", F.col("p") * 10), {"ten": F.col("value"), "flat": F.lit(1.0)}, low).collect()
    gap = {r.transform: r for r in gap}
    assert gap["flat"].gap == 1.0 and gap["flat"].captured == pytest.approx(.2) and gap["ten"].n_target == len(hits)
