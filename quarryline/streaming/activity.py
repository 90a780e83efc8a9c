"""Streaming forms of the bucket state. Late data re-opens a bucket at any age, so nothing is dropped by a watermark."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def daily_activity(events: DataFrame) -> DataFrame:
    """Running totals of each customer's daily buckets from a stream of baseline events (update or complete mode).

    A (customer, day) key holds one row of state, so state is bounded by the retention of the table that it feeds.
    """
    return events.groupBy("customer_id", F.to_date("event_time").alias("bucket")).agg(
        F.max("event_time").alias("last_event"), F.max("received_at").alias("last_received"), F.count("*").alias("n")
    )


def first_arrivals(events: DataFrame, keys: list[str], column: str, delay: str) -> DataFrame:
    """Each key once: a replayed batch within ``delay`` adds nothing."""
    return events.withWatermark(column, delay).dropDuplicatesWithinWatermark(keys)


def merged(state: DataFrame, delta: DataFrame, processed: DataFrame) -> DataFrame:
    """The state after a micro-batch (for foreachBatch): totals added up; a processed bucket that changed is dirty."""
    keys = ["customer_id", "bucket"]
    every = state.select(*keys, "last_event", "last_received", "n", F.lit(False).alias("new")).unionByName(delta.select(*keys, "last_event", "last_received", "n", F.lit(True).alias("new")))
    total = every.groupBy(*keys).agg(F.max("last_event").alias("last_event"), F.max("last_received").alias("last_received"), F.sum("n").alias("n"), F.bool_or("new").alias("touched"))
    done = processed.select(*keys, F.lit(True).alias("done"))
    return total.join(done, keys, "left").select(*keys, "last_event", "last_received", "n", (F.col("touched") & F.coalesce("done", F.lit(False))).alias("dirty"))


def story_spans(members: DataFrame) -> DataFrame:
    """Each story's first and last arrival and its members from a stream of them (update or complete mode): what readiness by idle gap or longest wait is told from."""
    return members.groupBy("story_id").agg(F.min("member_time").alias("first"), F.max("member_time").alias("last"), F.count("*").alias("n"))


def cursor_watermarks(marks: DataFrame) -> DataFrame:
    """Each subject's latest cursor from a stream (subject, at, quality); of equal times a strict one wins, so it never falls back."""
    top = F.max(F.struct("at", (F.col("quality") == "strict").alias("strict")))
    return marks.where("at is not null").groupBy("subject").agg(top.alias("m")).select("subject", "m.at", F.when(F.col("m.strict"), "strict").otherwise("soft").alias("quality"))
