"""Structured Streaming jobs whose results equal the batch operators on the same rows."""
from __future__ import annotations

from collections.abc import Callable, Iterator, Mapping

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.stateful_processor import ExpiredTimerInfo, StatefulProcessor, StatefulProcessorHandle, TimerValues
from pyspark.sql.types import LongType, StructField, StructType

from leadvane.operators import monitoring
from leadvane.operators.labels import DAY_MICROS
from leadvane.session import path_exists


def file_stream(spark: SparkSession, path: str, schema: StructType, files_per_trigger: int | None = 2) -> DataFrame:
    """Rows of the files that arrive below ``path``, so many files a batch, or (None) all that are there when a run begins."""
    reader = spark.readStream.schema(schema)
    return (reader.option("maxFilesPerTrigger", files_per_trigger) if files_per_trigger else reader).parquet(path)


def with_state_store(spark: SparkSession) -> None:
    """State with several values or timers a key needs the store on disk, which also keeps it out of the heap."""
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")


def run_to_end(df: DataFrame, sink: Callable[[DataFrame, int], None], checkpoint: str, mode: str = "append") -> None:
    """Processes everything available, then stops."""
    q: StreamingQuery = (df.writeStream.outputMode(mode).option("checkpointLocation", checkpoint)
                         .foreachBatch(sink).trigger(availableNow=True).start())
    q.awaitTermination()


def parquet_sink(path: str) -> Callable[[DataFrame, int], None]:
    """One folder per micro-batch, so a replayed batch overwrites itself."""
    def write(batch: DataFrame, batch_id: int) -> None:
        batch.write.mode("overwrite").parquet(f"{path}/batch={batch_id}")
    return write


LEDGER_BUCKETS = 64


def ledger_sink(path: str, key: list[str]) -> Callable[[DataFrame, int], None]:
    """Idempotent output: rows already in the ledger (from any other batch) are left out.

    The ledger lies in folders of a hash of the key, then of the batch. A batch reads only the buckets that its own keys fall
    into, and a replayed batch replaces its own rows.
    """
    def write(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        rows = batch.dropDuplicates(key).withColumn("bucket", F.pmod(F.xxhash64(*key), F.lit(LEDGER_BUCKETS)).cast("int")).persist()
        buckets = [r[0] for r in rows.select("bucket").distinct().collect()]  # at most LEDGER_BUCKETS numbers
        if path_exists(spark, path):
            schema = StructType([*rows.schema.fields, StructField("batch", LongType())])
            sent = spark.read.schema(schema).parquet(path).where(F.col("bucket").isin(buckets) & (F.col("batch") != batch_id))
            new = rows.join(sent.select("bucket", *key), ["bucket", *key], "left_anti")
        else:
            new = rows
        new = new.withColumn("batch", F.lit(batch_id).cast("long"))
        new.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("bucket", "batch").parquet(path)
        rows.unpersist()
    return write


def score_stream(leads: DataFrame, score: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """Stateless scoring of arriving leads: the frozen model is literal columns, dimensions are static joins."""
    return score(leads)


def first_submissions(leads: DataFrame, key: str, moment: str, delay: str | None = None) -> DataFrame:
    """Drops repeat submissions across micro-batches; with a delay the state is bounded by the watermark."""
    if delay is None:
        return leads.dropDuplicates([key])
    with_state_store(leads.sparkSession)
    return leads.withWatermark(moment, delay).dropDuplicatesWithinWatermark([key])


CLOSE_OUTPUT = "lead_id bigint, stage string, value double, at timestamp"
#: Leads share a state value by a hash of their id: a batch calls the state store a few times a bucket, not a few times a lead.
LEAD_BUCKETS = 256


def close_events(events: DataFrame, horizon_days: float, delay: str, keep_days: float = 30.0) -> DataFrame:
    """Close-stage events per lead from a stream of (lead_id, stage, deal_value, changed_at).

    A lead matures when the watermark passes its horizon: without a win by then it is sent as 0. A win is sent when it arrives,
    also after that 0; a win that arrives late but fell after the horizon sends the 0 first, so batches do not matter. A timer
    removes the lead's state ``keep_days`` after its win or maturity; until then repeats of the win are dropped.
    """
    with_state_store(events.sparkSession)
    rows = events.withWatermark("changed_at", delay).select(
        F.pmod(F.xxhash64("lead_id"), F.lit(LEAD_BUCKETS)).alias("bucket"), F.col("lead_id").isNull().cast("bigint").alias("no_id"),
        F.coalesce(F.col("lead_id").cast("bigint"), F.lit(0)).alias("lead_id"), "stage", F.col("deal_value").cast("double").alias("deal_value"),
        "changed_at", F.coalesce(F.unix_micros("changed_at"), F.lit(_NO_TIME)).alias("at"))
    return rows.groupBy("bucket").transformWithStateInPandas(_Close(int(horizon_days * DAY_MICROS), int(keep_days * DAY_MICROS)), CLOSE_OUTPUT, "append", "eventTime")


_KEYS, _MOMENTS = ["no_id", "lead_id"], ["created", "won", "matured", "due"]
#: No value, and a time after all others, among microseconds; the time of an event that has none.
_NONE, _LAST = int(np.iinfo(np.int64).min), int(np.iinfo(np.int64).max)
_NO_TIME = _NONE // 1000


class _Close(StatefulProcessor):
    """Of each lead of a bucket: created and won (microseconds), whether 0 was sent, and when the lead is due for that or for its removal.

    A bucket has a timer at its first due lead, or before.
    """

    def __init__(self, horizon: int, keep: int) -> None:
        self.horizon, self.keep = horizon, keep

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.leads = handle.getValueState("leads", "packed binary")

    def _load(self) -> pd.DataFrame:
        flat = np.frombuffer(self.leads.get()[0], dtype=np.int64) if self.leads.exists() else np.zeros(0, dtype=np.int64)
        return pd.DataFrame(flat.reshape(-1, len(_KEYS) + len(_MOMENTS)), columns=[*_KEYS, *_MOMENTS]).set_index(_KEYS)

    def _save(self, leads: pd.DataFrame) -> None:
        if len(leads):
            self.leads.update((leads.reset_index()[[*_KEYS, *_MOMENTS]].to_numpy(dtype=np.int64).tobytes(),))
        else:
            self.leads.clear()

    def _first_due(self, leads: pd.DataFrame) -> int:
        due = leads["due"][leads["due"] != _NONE]
        return int(due.min()) if len(due) else _LAST

    def _timer(self, at: int) -> None:
        if at != _LAST:
            self.handle.registerTimer(-(-at // 1000))

    def _rows(self, leads: pd.DataFrame, stage: str, value: object, at: pd.Series) -> pd.DataFrame:
        ids = leads.reset_index()
        return pd.DataFrame({"lead_id": ids["lead_id"].astype("Int64").mask(ids["no_id"] == 1), "stage": stage,
                             "value": np.broadcast_to(np.asarray(value, dtype=float), len(ids)), "at": pd.to_datetime(at.to_numpy(), unit="us", utc=True)})

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues: TimerValues) -> Iterator[pd.DataFrame]:
        new, old = pd.concat(list(rows)), self._load()
        index = pd.MultiIndex.from_frame(new[_KEYS].drop_duplicates())
        known = old.reindex(index, fill_value=_NONE)
        seen = new[new["stage"] == "New"].groupby(_KEYS)["at"].min().reindex(index, fill_value=_LAST)
        wins = new[new["stage"] == "Won"].sort_values("at", kind="stable").drop_duplicates(_KEYS).set_index(_KEYS)
        win, value = wins["at"].reindex(index, fill_value=_NONE), wins["deal_value"].reindex(index)

        created = seen.where(known["created"] == _NONE, np.minimum(known["created"], seen)).replace(_LAST, _NONE)
        matures = created.where(created == _NONE, created + self.horizon)
        wins_now = (win != _NONE) & (known["won"] == _NONE)
        late = wins_now & (created != _NONE) & (win > matures) & (known["matured"] != 1)
        begins = ~wins_now & (created != _NONE) & (known["created"] == _NONE) & (known["won"] == _NONE)
        now = pd.DataFrame({
            "created": created, "won": win.where(wins_now, known["won"]), "matured": ((known["matured"] == 1) | late).astype("int64"),
            "due": (win + self.keep).where(wins_now, matures.where(begins, known["due"]))})
        leads = pd.concat([old[~old.index.isin(index)], now])
        self._save(leads)
        first = self._first_due(leads)
        if first < self._first_due(old):
            self._timer(first)
        yield pd.concat([self._rows(now[late], "matured", 0.0, matures[late]), self._rows(now[wins_now], "won", value[wins_now], win[wins_now])])

    def handleExpiredTimer(self, key: tuple, timerValues: TimerValues, expiredTimerInfo: ExpiredTimerInfo) -> Iterator[pd.DataFrame]:
        leads = self._load()
        reached = 1000 * max(expiredTimerInfo.getExpiryTimeInMs(), timerValues.getCurrentWatermarkInMs())
        due = (leads["due"] != _NONE) & (leads["due"] <= reached)
        mature = due & (leads["won"] == _NONE) & (leads["matured"] != 1)
        matures = leads["created"][mature] + self.horizon
        yield self._rows(leads[mature], "matured", 0.0, matures)
        leads.loc[mature, "matured"] = 1
        leads.loc[mature, "due"] = matures + self.keep
        left = leads[~due | (mature & (leads["due"] > reached))]
        self._save(left)
        self._timer(self._first_due(left))

    def close(self) -> None:
        pass


ALERT_OUTPUT = "monitor string, part string, day date, n bigint, bad bigint, breach boolean, run bigint, alert boolean"


def rate_alert_stream(leads: DataFrame, moment: str, series: Mapping[str, tuple[Column, Column]], expected: DataFrame, delay: str) -> DataFrame:
    """The daily rate rule of ``monitoring.rate_alerts`` (without the rolling rate) on arriving leads.

    A day is counted until the watermark passes its end, then goes once to the rule of its series, in order. The rule keeps the
    last day and the length of the current run, so its state is two numbers a series; days without leads end a run.
    """
    cells = F.array(*[F.struct(F.lit(name).alias("monitor"), part.cast("string").alias("part"), flag.cast("boolean").alias("flag")) for name, (part, flag) in series.items()])
    rows = leads.withWatermark(moment, delay).select(moment, F.explode(cells).alias("c")).select(moment, "c.*").where("part IS NOT NULL")
    days = rows.groupBy(F.window(moment, "1 day"), "monitor", "part").agg(F.count("*").alias("n"), F.count_if("flag").alias("bad"))
    days = days.select(F.to_date("window.start").alias("day"), "monitor", "part", "n", "bad").join(expected, ["monitor", "part"], "left")
    days = days.withColumn("breach", monitoring.breaches(F.col("bad") / F.col("n"), F.col("expected")))

    with_state_store(leads.sparkSession)
    return days.groupBy("monitor", "part").transformWithStateInPandas(_DailyRule(), ALERT_OUTPUT, "append", "none")


class _DailyRule(StatefulProcessor):
    """Runs of bad days of one series from its closed days; rows come in any order within a batch, batches in order."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.last = handle.getValueState("last", "day int, run int")

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues: object) -> Iterator[pd.DataFrame]:
        last, run = self.last.get() if self.last.exists() else (None, 0)
        new = pd.concat(list(rows)).sort_values("day")
        out = []
        for day, n, bad, breach in zip(pd.to_datetime(new["day"]), new["n"], new["bad"], new["breach"]):
            today = day.toordinal()
            out += [(*key, pd.Timestamp.fromordinal(gap).date(), 0, 0, False, 0, False) for gap in range((last or today) + 1, today)]
            run = (run + 1 if last in (None, today - 1) else 1) if breach else 0
            out.append((*key, day.date(), n, bad, bool(breach), run, run >= monitoring.BAD_DAYS))
            last = today
        self.last.update((last, run))
        yield pd.DataFrame(out, columns=["monitor", "part", "day", "n", "bad", "breach", "run", "alert"])

    def close(self) -> None:
        pass


def windowed_volumes(events: DataFrame, moment: str, campaign: str, window: str, slide: str, delay: str) -> DataFrame:
    """Events per campaign in sliding windows, each given once, when the watermark has passed its end (append mode)."""
    return (events.withWatermark(moment, delay).groupBy(F.window(moment, window, slide), campaign)
            .agg(F.count("*").alias("n")).select(F.col("window.start").alias("start"), F.col("window.end").alias("end"), campaign, "n"))
