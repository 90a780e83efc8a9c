"""Bucket state: roll-ups of activity by local calendar bucket, readiness, late data and maintenance."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarryline.functions.semantics import within

PERIODS = (("DAILY", "day"), ("WEEKLY", "week"), ("MONTHLY", "month"))
#: Hours after a bucket's end until it is settled.
SETTLE_HOURS = {"DAILY": 3, "WEEKLY": 6, "MONTHLY": 12}


def bucket_rollup(baseline: DataFrame) -> DataFrame:
    """Each customer's day, week and month buckets from one scan: last event, last arrival, raw rows."""
    kinds = F.array(*(F.struct(F.lit(p).alias("period"), F.to_date(F.date_trunc(u, F.col("event_time"))).alias("bucket")) for p, u in PERIODS))
    rows = baseline.select("customer_id", "event_time", "received_at", F.explode(kinds).alias("b"))
    return rows.groupBy("customer_id", "b.period", "b.bucket").agg(F.max("event_time").alias("last_event"), F.max("received_at").alias("last_received"), F.count("*").alias("n"))


def story_rollup(stories: DataFrame) -> DataFrame:
    """Stories in each daily bucket that they overlap (an end on a bucket's start doesn't), for each customer."""
    days = F.sequence(F.to_date("window_start"), F.to_date("window_end"), F.expr("INTERVAL 1 DAY"))
    rows = stories.withColumn("bucket", F.explode(days)).where(F.col("window_end") > F.col("bucket").cast("timestamp_ntz"))
    return rows.groupBy("customer_id", "bucket").agg(F.countDistinct("story_id").alias("stories"), F.max("received_at").alias("last_received"))


def live_activity(baseline: DataFrame, now: str) -> DataFrame:
    """Activity of the last 24 hours before now, by customer."""
    t = F.lit(now).cast("timestamp_ntz")
    recent = (F.col("event_time") >= t - F.expr("INTERVAL 24 HOURS")) & (F.col("event_time") < t)
    return baseline.where(recent).groupBy("customer_id").agg(F.count("*").alias("n"), F.max("event_time").alias("last_event"))


def ready_stories(members: DataFrame, now: str, idle_minutes: int = 15, most_hours: int = 6) -> DataFrame:
    """Stories that are ready: idle since the last member, or waiting long since the first."""
    t = F.lit(now).cast("timestamp_ntz")
    spans = members.groupBy("story_id").agg(F.min("member_time").alias("first"), F.max("member_time").alias("last"))
    ready = (F.col("last") <= t - F.make_dt_interval(mins=F.lit(idle_minutes))) | (F.col("first") <= t - F.make_dt_interval(hours=F.lit(most_hours)))
    return spans.select("story_id", ready.alias("ready"))


def ready_buckets(rollup: DataFrame, now: str, quiet_minutes: int = 30) -> DataFrame:
    """Whether each bucket is settled: its period's delay after its end, and quiet since the last arrival."""
    t = F.lit(now).cast("timestamp_ntz")
    start = F.col("bucket").cast("timestamp_ntz")
    end = F.when(F.col("period") == "DAILY", F.date_add("bucket", 1)).when(F.col("period") == "WEEKLY", F.date_add("bucket", 7)).otherwise(F.add_months("bucket", 1)).cast("timestamp_ntz")
    hours = F.create_map(*(F.lit(x) for kv in SETTLE_HOURS.items() for x in kv))[F.col("period")]
    settled = end + F.make_dt_interval(hours=hours) <= t
    quiet = F.col("last_received") + F.make_dt_interval(mins=F.lit(quiet_minutes)) <= t
    status = F.when(settled & quiet, "ready").otherwise("pending")
    return rollup.where(start < t).select("customer_id", "period", "bucket", status.alias("status"))


def late_buckets(baseline: DataFrame, processed_at: str) -> DataFrame:
    """Daily buckets that an arrival after their processing makes dirty: late data is never dropped."""
    t = F.lit(processed_at).cast("timestamp_ntz")
    late = baseline.where((F.col("received_at") >= t) & (F.col("event_time") < t))
    return late.groupBy("customer_id", F.to_date("event_time").alias("bucket")).agg(F.count("*").alias("late_events"))


def ingest(existing: DataFrame, batch: DataFrame, keys: list[str]) -> DataFrame:
    """What a batch adds: rows whose key neither stands in the table nor came earlier in the batch."""
    return batch.dropDuplicates(keys).join(existing.select(*keys), keys, "left_anti")


def ingest_counts(existing: DataFrame, batch: DataFrame, keys: list[str]) -> DataFrame:
    known = existing.select(*keys, F.lit(1).alias("known")).distinct()
    rows = batch.groupBy(*keys).agg(F.count("*").alias("c")).join(known, keys, "left")
    return rows.agg(F.sum("c").alias("received"), F.count_if(F.col("known").isNull()).alias("accepted"), (F.sum("c") - F.count_if(F.col("known").isNull())).alias("duplicates"))


def window_replace(existing: DataFrame, payload: DataFrame, version: str, start: str, end: str) -> DataFrame:
    """The table with one version's rows of a window replaced by the payload."""
    gone = (F.col("baseline_version") == version) & within("event_time", start, end)
    return existing.where(~gone).unionByName(payload)


def retention(df: DataFrame, column: str, now: str, days: int) -> DataFrame:
    """Rows kept and dropped by a cut-off of ``days`` before now, by customer."""
    cut = F.lit(now).cast("timestamp_ntz") - F.make_dt_interval(days=F.lit(days))
    return df.groupBy("customer_id").agg(F.count_if(F.col(column) >= cut).alias("kept"), F.count_if(F.col(column) < cut).alias("dropped"))


def orphans(children: DataFrame, parents: DataFrame, key: str) -> DataFrame:
    return children.join(parents.select(key), key, "left_anti")


def backfill_plan(latest: DataFrame, live: DataFrame, model: str, cap: int) -> DataFrame:
    """Newest first, each event's class; only those to analyse again count against the cap."""
    done = live.where(F.col("model") == model).select("sensor", "event_key", F.lit(True).alias("current"))
    rows = latest.join(done, ["sensor", "event_key"], "left").withColumn("actionable", F.col("current").isNull() & F.col("category").isNotNull())
    # Newest first, the cap's rows are as many as there are, up to the cap: counts tell it, no customer's rows are ranked.
    kind = F.when(F.col("current"), "already_current").when(F.col("category").isNull(), "source_unavailable").otherwise("reanalyze")
    told = rows.withColumn("class", kind).groupBy("customer_id", "class").agg(F.count("*").alias("n"))
    beyond = told.where((F.col("class") == "reanalyze") & (F.col("n") > cap)).select("customer_id", F.lit("cap_excluded").alias("class"), (F.col("n") - cap).alias("n"))
    return told.withColumn("n", F.when(F.col("class") == "reanalyze", F.least("n", F.lit(cap))).otherwise(F.col("n"))).unionByName(beyond)


def calendar(rollup: DataFrame, first: str, last: str, oldest: str, today: str) -> DataFrame:
    """Each day of a viewport for each customer: future, out of retention, has a report, or none."""
    days = F.sequence(F.lit(first).cast("date"), F.lit(last).cast("date"))
    spine = rollup.select("customer_id").distinct().select("customer_id", F.explode(days).alias("bucket"))
    have = rollup.where("period = 'DAILY'").select("customer_id", "bucket", F.lit(True).alias("has"))
    state = F.when(F.col("bucket") > F.lit(today).cast("date"), "future").when(F.col("bucket") < F.lit(oldest).cast("date"), "out_of_retention").when(F.col("has"), "report").otherwise("none")
    return spine.join(have, ["customer_id", "bucket"], "left").select("customer_id", "bucket", state.alias("state"))
