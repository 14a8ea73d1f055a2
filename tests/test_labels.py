"""Label boundaries: one hand-built history per case."""
import pytest
from pyspark.sql import functions as F

from leadvane.config import LabelSpec, RunDates
from leadvane.operators import crm, labels

AS_OF = "2026-09-24"
OLD, YOUNG = "2026-01-01 09:30:00", "2026-09-01 00:00:00"
# lead, created, [(stage, changed)], label_source, won_within_h, y, y +ghosted, y +stalled-as-lost, legacy y
CASES = [
    ("won_at_h", OLD, [("New", OLD), ("Contacted", "2026-01-02 00:00:00"), ("Won", "2026-05-01 09:30:00")], "won", 1, 1, 1, 1, 1),
    ("won_late", OLD, [("New", OLD), ("Contacted", "2026-01-02 00:00:00"), ("closed won", "2026-05-01 09:30:01")], "won", 0, 0, 0, 0, 1),
    ("lost", OLD, [("New", OLD), ("contacted", "2026-01-02 00:00:00"), ("Closed Lost", "2026-02-01 00:00:00")], "crm_lost", 0, 0, 0, 0, 0),
    ("lost_uncontacted_in_h", OLD, [("New", OLD), ("lost", "2026-06-01 00:00:00")], "crm_lost", 0, None, 0, None, 0),
    ("ghosted", OLD, [("New", OLD)], "ghosted", 0, None, 0, None, 0),
    ("contact_at_h", OLD, [("New", OLD), ("Contacted", "2026-05-01 09:30:00")], "stalled", 0, None, None, 0, 0),
    ("contact_after_h", OLD, [("New", OLD), ("Contacted", "2026-05-01 09:30:01")], "ghosted", 0, None, None, None, 0),
    ("stalled_90d", OLD, [("New", OLD), ("Contacted", "2026-01-05 00:00:00"), ("Proposal", "2026-06-26 00:00:00")], "stalled", 0, None, None, 0, 0),
    ("idle_89d", OLD, [("New", OLD), ("Contacted", "2026-01-05 00:00:00"), ("Proposal", "2026-06-26 00:15:00")], "open", 0, 0, 0, 0, None),
    ("young_new", YOUNG, [("New", YOUNG)], "open", None, None, None, None, None),
    ("young_won", YOUNG, [("New", YOUNG), ("Won", "2026-09-10 00:00:00")], "won", 1, 1, 1, 1, 1),
    ("matures_now", "2026-05-27 00:00:00", [("New", "2026-05-27 00:00:00"), ("Contacted", "2026-09-01 00:00:00")], "open", 0, 0, 0, 0, None),
    ("not_mature", "2026-05-27 00:00:01", [("New", "2026-05-27 00:00:01"), ("Contacted", "2026-09-01 00:00:00")], "open", None, None, None, None, None),
]


@pytest.fixture(scope="module")
def states(spark):
    leads = spark.createDataFrame([(c[0], c[1]) for c in CASES], "lead_id string, created string").select(
        "lead_id", F.to_timestamp("created").alias("created_at"))
    rows = [(c[0], s, t, 10.0 if "on" in s.lower() and "w" in s.lower() else None) for c in CASES for s, t in c[2]]
    events = spark.createDataFrame(rows, "lead_id string, stage string, t string, deal_value double").select(
        "lead_id", "stage", "deal_value", F.to_timestamp("t").alias("changed_at"))
    return crm.add_crm_outcomes(leads, events)


def test_every_boundary(states):
    dates = RunDates(AS_OF, "2026-05-01")
    out = states.select(
        "lead_id", labels.label_source(dates), labels.won_within(120, AS_OF), labels.horizon_label(LabelSpec(), dates),
        labels.horizon_label(LabelSpec(include_ghosted=True), dates), labels.horizon_label(LabelSpec(stalled_as_lost=True), dates),
        labels.legacy_label(dates))
    got = {r[0]: tuple(r[1:]) for r in out.collect()}
    assert got == {c[0]: tuple(c[3:]) for c in CASES}


def test_label_sources_refuse_an_unknown_stage(spark):
    leads = spark.sql("select 'x' as lead_id, timestamp'2026-01-01' as created_at")
    events = spark.sql("select 'x' as lead_id, 'Paused' as stage, cast(null as double) as deal_value, timestamp'2026-01-02' as changed_at")
    state = crm.add_crm_outcomes(leads, events)
    assert state.first()["final_stage"] is None and state.first()["last_change"] is not None
    with pytest.raises(Exception, match="no recognised final CRM stage"):
        state.select(labels.label_source(RunDates(AS_OF))).collect()
    assert state.select(labels.legacy_label(RunDates(AS_OF))).first()[0] is None


def test_two_wins_are_refused(spark):
    leads = spark.sql("select 1L as lead_id, timestamp'2026-01-01' as created_at")
    events = spark.sql("select 1L as lead_id, 'won' as stage, 5.0D as deal_value, t as changed_at from values (timestamp'2026-01-02'), (timestamp'2026-01-03') v(t)")
    assert [tuple(r) for r in crm.multiple_wins(events).collect()] == [(1, 2)]
    with pytest.raises(Exception, match="more than one Won"):
        crm.add_crm_outcomes(leads, events).collect()


def test_elapsed_days_floor(spark):
    df = spark.sql("select timestamp'2026-01-02 00:01:00' as a, timestamp'2026-01-01 23:59:00' as b")
    assert df.select(labels.elapsed_days(F.col("a"), F.col("b")), labels.elapsed_days(F.col("b"), F.col("a"))).first() == (0, -1)


def test_spec_combinations():
    with pytest.raises(ValueError):
        LabelSpec(mode="legacy", include_ghosted=True)
    with pytest.raises(ValueError):
        LabelSpec(horizon_days=0)
    assert LabelSpec(include_ghosted=True, stalled_as_lost=True).name == "horizon H=120 +ghosted +stalled-as-lost"
