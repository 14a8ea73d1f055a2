"""The state of close events: buckets of leads against plain Python for each lead, and how often the store is called."""
import random

import pandas as pd
import pytest

from leadvane.streaming import jobs

DAY, HORIZON, KEEP = 86_400_000_000, 10, 30


class Store:
    """Value state and timers of one bucket, in memory."""

    def __init__(self):
        self.value, self.timers, self.calls, self.watermark = None, set(), 0, 0

    def getValueState(self, name, schema):
        return self

    def exists(self):
        self.calls += 1
        return self.value is not None

    def get(self):
        self.calls += 1
        return self.value

    def update(self, value):
        self.calls += 1
        self.value = value

    def clear(self):
        self.calls += 1
        self.value = None

    def registerTimer(self, at):
        self.calls += 1
        self.timers.add(at)

    def getCurrentWatermarkInMs(self):
        return self.watermark


class Expired:
    def __init__(self, at):
        self.at = at

    def getExpiryTimeInMs(self):
        return self.at


def run(batches):
    """Rows sent for batches of (lead or None, stage, value, day); the watermark is the last day of the batches before."""
    store, job, out = Store(), jobs._Close(HORIZON * DAY, KEEP * DAY), []
    job.init(store)
    for batch in [*batches, []]:
        if batch:
            pdf = pd.DataFrame([(int(i is None), i or 0, s, v, d * DAY) for i, s, v, d in batch], columns=["no_id", "lead_id", "stage", "deal_value", "at"])
            out += list(job.handleInputRows((0,), iter([pdf[: len(pdf) // 2], pdf[len(pdf) // 2:]]), store))
        for at in sorted(t for t in store.timers if t <= store.watermark):
            out += list(job.handleExpiredTimer((0,), store, Expired(at)))
            store.timers.discard(at)
        store.watermark = max([store.watermark, *[d * DAY // 1000 for *_, d in batch]])
    rows = pd.concat(out)
    days = rows["at"].astype("int64") // (86_400 * {"ns": 10**9, "us": 10**6}[rows["at"].dt.unit])
    return store, sorted((-1 if pd.isna(i) else int(i), s, None if pd.isna(v) else v, int(d)) for i, s, v, d in zip(rows["lead_id"], rows["stage"], rows["value"], days))


def plain(events, end):
    """What each lead is worth sending when batches follow the days and the watermark ends at ``end``."""
    out = []
    for lead in {e[0] for e in events}:
        own = sorted((e for e in events if e[0] == lead), key=lambda e: e[3])
        created = min((d for _, s, _, d in own if s == "New"), default=None)
        won = next(((d, v) for _, s, v, d in own if s == "Won"), None)
        if created is not None and (won is None or won[0] > created + HORIZON) and (won is not None or created + HORIZON <= end):
            out.append((-1 if lead is None else lead, "matured", 0.0, created + HORIZON))
        if won is not None:
            out.append((-1 if lead is None else lead, "won", won[1], won[0]))
    return sorted(out)


@pytest.mark.parametrize("seed", range(4))
def test_buckets_send_what_single_leads_would(seed):
    rng, events = random.Random(seed), []
    for lead in [None, *range(1, 60), 2**60 + 1]:
        day = rng.randrange(1, 30)
        if rng.random() < 0.9:
            events.append((lead, "New", None, day))
        events += [(lead, "Contacted", None, day + 1)] * rng.randrange(2)
        first = day + rng.randrange(1, 16)
        events += [(lead, "Won", rng.choice([None, float(rng.randrange(100))]), first + i) for i in range(rng.randrange(3))]  # repeats of a win
    rng.shuffle(events)
    batches = [[e for e in events if lo <= e[3] < lo + 9] for lo in range(0, 54, 9)]
    assert run(batches)[1] == plain(events, max(e[3] for e in events))


def test_state_goes_and_the_store_is_called_per_bucket():
    many = [(i, "New", None, 1) for i in range(1, 2001)]
    store, sent = run([many, [(5000, "Contacted", None, 15)], [(i, "Won", 1.0, 16) for i in range(1, 1001)], [(5001, "Contacted", None, 60)]])
    assert len(sent) == 3000
    assert store.calls < 60
    job = jobs._Close(HORIZON * DAY, KEEP * DAY)
    job.init(store)
    assert set(job._load().reset_index()["lead_id"]) == {5000, 5001}  # leads that are neither open nor recent have left
