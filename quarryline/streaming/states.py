"""State of stories and report buckets as a stream with timers, and the same as a batch.

Rows are changes (key..., kind, id, at): ``item`` (a member or event arrived), ``job`` (work on the key began), ``gone`` (no version or data is left) and ``back`` (there is
again). A key's state is what these say, in whatever order and how often they come:

* items before the last ``gone`` belong to the life that it ended; with no ``back`` or item since, the key is ``archived``;
* an item after the last job of this life makes it ``dirty``; it stays so until a newer job;
* else it is ``ready`` once its time has come (and stays so with a job), ``pending`` before.

A story's time comes IDLE after its last item or LONGEST after its first, whichever is sooner; a bucket's when its end and delay are past and QUIET since
its last item. In the stream a timer waits for that time, so that a key turns ready without another row.

``EventTime`` takes the watermark for the clock and drops rows that are later than its delay: choose the delay as long as the source keeps its rows. ``ProcessingTime``
takes the machine's clock and drops nothing. State is one row a key and one for each of its items of the current life; replayed items have their id.
"""

from __future__ import annotations

from collections.abc import Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.types import StringType, StructField, StructType, TimestampType

from quarryline.functions.calendar import midnight, shifted
from quarryline.operators.activity import PERIODS, SETTLE_HOURS

#: Fixed values, in microseconds: quiet after a story's last member, its longest wait, quiet after a bucket's last event.
IDLE, LONGEST, QUIET = 15 * 60_000_000, 6 * 3_600_000_000, 30 * 60_000_000
#: The state store that timers need.
STORE = {"spark.sql.streaming.stateStore.providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"}
NONE = -1


def status_of(first: int, last: int, job: int, gone: int, back: int, due: int, now: int) -> str:
    """The state of a key from its times (NONE where there is none); first and last are those of items since ``gone``."""
    if gone != NONE and max(last, back) <= gone:
        return "archived"
    if job != NONE and job > gone:
        return "dirty" if last > job else "ready"
    return "ready" if last != NONE and due <= now else "pending"


class KeyedState(StatefulProcessor):
    """The fold of a key's changes; ``story`` tells which rule of readiness holds. Output: key, status, first, last."""

    def __init__(self, keys: Sequence[str], story: bool, by_event: bool = True):
        self.keys, self.story, self.by_event = list(keys), story, by_event

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.times = handle.getValueState("times", "job long, gone long, back long, settle long, timer long")
        self.items = handle.getMapState("items", "id string", "at long")

    def handleInputRows(self, key, rows, timerValues):
        job, gone, back, settle, timer = self.times.get() or (NONE, NONE, NONE, NONE, NONE)
        for frame in rows:
            micros = lambda c: frame[c].astype("datetime64[us]").astype("int64").tolist()  # noqa: B023, E731
            for kind, ident, moment, own in zip(frame["kind"], frame["id"], micros("at"), micros("settle")):
                settle = max(settle, own)
                if kind == "item":
                    if moment > gone and (not self.items.containsKey((ident,)) or self.items.getValue((ident,))[0] < moment):
                        self.items.updateValue((ident,), (moment,))
                elif kind == "job":
                    job = max(job, moment)
                elif kind == "back":
                    back = max(back, moment)
                elif moment > gone:
                    gone = moment
                    for (old,), (then,) in list(self.items.iterator()):
                        if then <= gone:
                            self.items.removeKey((old,))
        now = self._now(timerValues)
        due, row = self._told(key, job, gone, back, settle, now)
        wanted = -(-due // 1000) if due > now else NONE  # timers are in milliseconds
        if timer != wanted:
            if timer != NONE:
                self.handle.deleteTimer(timer)
            if wanted != NONE:
                self.handle.registerTimer(wanted)
            timer = wanted
        self.times.update((job, gone, back, settle, timer))
        yield row

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo):
        job, gone, back, settle, _ = self.times.get()
        self.times.update((job, gone, back, settle, NONE))
        yield self._told(key, job, gone, back, settle, max(self._now(timerValues), 1000 * expiredTimerInfo.getExpiryTimeInMs()))[1]

    def _now(self, timer_values) -> int:
        # Before the first batch has set a watermark no time has passed.
        return 1000 * (max(0, timer_values.getCurrentWatermarkInMs()) if self.by_event else timer_values.getCurrentProcessingTimeInMs())

    def _told(self, key, job, gone, back, settle, now):
        at = [v[0] for _, v in self.items.iterator()]
        first, last = (min(at), max(at)) if at else (NONE, NONE)
        due = NONE if last == NONE else min(last + IDLE, first + LONGEST) if self.story else max(last + QUIET, settle)
        moment = lambda us: pd.NaT if us == NONE else pd.Timestamp(us, unit="us", tz="UTC")
        row = {k: [v] for k, v in zip(self.keys, key)} | {"status": [status_of(first, last, job, gone, back, due, now)], "first": [moment(first)], "last": [moment(last)]}
        return due, pd.DataFrame(row)

    def close(self) -> None:
        pass


BUCKET_KEYS, STORY_KEYS = ["customer_id", "zone", "period", "bucket"], ["customer_id", "story_id"]


def bucket_changes(events: DataFrame, zones: DataFrame) -> DataFrame:
    """Changes of the day, week and month buckets that events (sensor, event_key, version, event_time, received_at) fall in, in their customer's zone.

    Works on streams as on tables; ``settle`` is the bucket's end and the delay of its period.
    """
    rows = events.join(zones.select("customer_id", "zone"), "customer_id")
    local = F.from_utc_timestamp(F.col("event_time").cast("string"), F.col("zone"))
    kinds = F.array(*(F.struct(F.lit(p).alias("period"), F.to_date(F.date_trunc(u, local)).alias("bucket")) for p, u in PERIODS))
    rows = rows.withColumn("b", F.explode(kinds))
    hours = F.create_map(*(F.lit(x) for kv in SETTLE_HOURS.items() for x in kv))[F.col("b.period")]
    settle = midnight(shifted(F.col("b.bucket"), F.col("b.period"), 1), F.col("zone")) + F.make_dt_interval(hours=hours)
    return rows.select("customer_id", "zone", "b.period", "b.bucket", F.lit("item").alias("kind"), F.concat_ws(":", "sensor", "event_key", "version").alias("id"), F.col("received_at").cast("timestamp").alias("at"), settle.cast("timestamp").alias("settle"))


def streamed(changes: DataFrame, keys: Sequence[str], story: bool, mode: str = "EventTime", delay: str = "30 days") -> DataFrame:
    """A stream of states (keys, status, first, last; update mode) from one of changes (keys, kind, id, at, and for buckets settle: end and delay)."""
    rows = changes if "settle" in changes.columns else changes.withColumn("settle", F.lit("1970-01-01").cast("timestamp"))
    rows = rows.withWatermark("at", delay) if mode == "EventTime" else rows
    fields = [changes.schema[k] for k in keys] + [StructField("status", StringType()), StructField("first", TimestampType()), StructField("last", TimestampType())]
    return rows.groupBy(*keys).transformWithStateInPandas(statefulProcessor=KeyedState(keys, story, mode == "EventTime"), outputStructType=StructType(fields), outputMode="Update", timeMode=mode)


def batched(changes: DataFrame, keys: Sequence[str], story: bool, now: Column) -> DataFrame:
    """The states of all changes at a time: built-in aggregates, no key's rows are gathered."""
    settle = F.max("settle") if "settle" in changes.columns else F.lit("1970-01-01").cast("timestamp")
    latest = lambda kind: F.max(F.when(F.col("kind") == kind, F.col("at"))).alias(kind)
    times = changes.groupBy(*keys).agg(latest("job"), latest("gone"), latest("back"), settle.alias("settle"))
    # An item counts once, at its last arrival.
    items = changes.where("kind = 'item'").groupBy(*keys, "id").agg(F.max("at").alias("at"))
    live = items.join(times.select(*keys, "gone"), list(keys)).where("gone is null or at > gone").groupBy(*keys).agg(F.min("at").alias("first"), F.max("at").alias("last"))
    rows = times.join(live, list(keys), "left")
    shift = lambda c, us: F.col(c) + F.make_dt_interval(secs=F.lit(us / 1e6))
    due = F.least(shift("last", IDLE), shift("first", LONGEST)) if story else F.greatest(shift("last", QUIET), F.col("settle"))
    since = F.greatest("last", "back")
    archived = F.col("gone").isNotNull() & (since.isNull() | (since <= F.col("gone")))
    worked = F.col("job").isNotNull() & (F.col("gone").isNull() | (F.col("job") > F.col("gone")))
    status = F.when(archived, "archived").when(worked & F.coalesce(F.col("last") > F.col("job"), F.lit(False)), "dirty").when(worked, "ready").when(F.col("last").isNotNull() & (due <= now), "ready").otherwise("pending")
    return rows.select(*keys, status.alias("status"), "first", "last")
