"""Batches that come in: validation, insert-if-absent, replacing a window, withdrawing. Each result is a DataFrame; nothing is written here.

Of rows that repeat a key within a batch the first by ``place`` (its position in the batch) counts.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quarryline.functions.semantics import latest_by, within

#: Fixed value: the kind of story that a refresh may replace.
REPLACEABLE = "auto_correlated"


def accepted(existing: DataFrame, batch: DataFrame, keys: Sequence[str], received_at: Column) -> DataFrame:
    """The batch's rows that the table lacks, once for each key, stamped with the time of receipt."""
    first = latest_by(batch, list(keys), [F.asc("place")])
    return first.join(existing.select(*keys), list(keys), "left_anti").withColumn("received_at", received_at)


def counts(batch: DataFrame, new: DataFrame) -> DataFrame:
    """One row: accepted rows and duplicates that were passed over."""
    total = batch.agg(F.count("*").alias("n")).crossJoin(F.broadcast(new.agg(F.count("*").alias("accepted"))))
    return total.select("accepted", (F.col("n") - F.col("accepted")).alias("duplicates"))


def with_children(parents: DataFrame, children: DataFrame, held_parents: DataFrame, held_children: DataFrame, keys: Sequence[str], child: str, received_at: Column) -> tuple[DataFrame, DataFrame, DataFrame]:
    """New parents, new children, and the arrivals that these are (keys, child, arrived_at).

    A child of a parent that was there already arrives at the old parent's time of receipt.
    """
    new = accepted(held_parents, parents, keys, received_at)
    added = latest_by(children, [*keys, child], [F.asc("place")]).join(held_children.select(*keys, child), [*keys, child], "left_anti")
    known = held_parents.select(*keys, "received_at").unionByName(new.select(*keys, "received_at"))
    return new, added, added.join(known, list(keys)).select(*keys, child, F.col("received_at").alias("arrived_at"))


def faults(rows: DataFrame, keys: Sequence[str], time: str, start: str, end: str) -> DataFrame:
    """What is wrong with a payload's rows: (keys, fault): outside_window (also without a time), duplicate (all but the first of a key, as one row)."""
    outside = rows.where(~F.coalesce(within(time, start, end), F.lit(False))).select(*keys, F.lit("outside_window").alias("fault"))
    twice = rows.groupBy(*keys).agg(F.count("*").alias("n")).where("n > 1").select(*keys, F.lit("duplicate").alias("fault"))
    return outside.unionByName(twice)


def replaced_baseline(existing: DataFrame, payload: DataFrame, version: str, start: str, end: str, now: str) -> tuple[DataFrame, DataFrame]:
    """The table with one version's rows of a window replaced; and one row of counts: accepted, deleted, live_overlap.

    live_overlap: whether a deleted row was of the last 24 hours; null if none was deleted.
    """
    gone = (F.col("baseline_version") == version) & within("event_time", start, end)
    t = F.lit(now).cast("timestamp_ntz")
    live = (F.col("event_time") >= t - F.expr("INTERVAL 24 HOURS")) & (F.col("event_time") < t)
    told = existing.where(gone).agg(F.count("*").alias("deleted"), F.bool_or(live).alias("live_overlap"))
    return existing.where(~F.coalesce(gone, F.lit(False))).unionByName(payload), told.crossJoin(F.broadcast(payload.agg(F.count("*").alias("accepted"))))


def live_overlap(start: str, end: str, now: str) -> Column:
    """Whether an interval touches the 24 hours before now: their first instant included, now not."""
    t = F.lit(now).cast("timestamp_ntz")
    return (F.col(start) < t) & (F.col(end) >= t - F.expr("INTERVAL 24 HOURS"))


def replaced_stories(existing: DataFrame, payload: DataFrame, start: str, end: str, now: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Stories with those that a refresh may replace and that start in the window replaced by the payload.

    Also one row of counts (accepted, deleted, live_overlap), and for each story touched its surviving versions and their last receipt
    (none: 0 and null).
    """
    gone = (F.col("kind") == REPLACEABLE) & within("window_start", start, end)
    deleted = existing.where(gone)
    after = existing.where(~F.coalesce(gone, F.lit(False))).unionByName(payload)
    told = deleted.agg(F.count("*").alias("deleted"), F.bool_or(live_overlap("window_start", "window_end", now)).alias("live_overlap"))
    touched = deleted.select("story_id").union(payload.select("story_id")).distinct()
    left = after.join(touched, "story_id", "left_semi").groupBy("story_id").agg(F.count("*").alias("surviving"), F.max("received_at").alias("last_received"))
    survivors = touched.join(left, "story_id", "left").select("story_id", F.coalesce("surviving", F.lit(0)).alias("surviving"), "last_received")
    return after, told.crossJoin(F.broadcast(payload.agg(F.count("*").alias("accepted")))), survivors


def withdrawals(tables: dict[str, tuple[DataFrame, list[str]]], asked: dict[str, DataFrame]) -> DataFrame:
    """(kind, withdrawn, not_found, repeated) of each kind of rows that is asked to go, by its table and natural key."""
    out = None
    for kind, rows in asked.items():
        table, keys = tables[kind]
        one = rows.groupBy(*keys).agg(F.count("*").alias("times")).join(table.select(*keys).distinct().withColumn("there", F.lit(True)), keys, "left")
        told = one.agg(F.count_if(F.col("there")).alias("withdrawn"), F.count_if(F.col("there").isNull()).alias("not_found"), F.count_if(F.col("times") > 1).alias("repeated")).withColumn("kind", F.lit(kind))
        out = told if out is None else out.unionByName(told)
    return out


def overlapping_withdrawals(runs: DataFrame, events: DataFrame) -> DataFrame:
    """Events asked to go whose whole run is asked to go as well: such a request is refused."""
    return events.join(runs.select("run_id").distinct(), "run_id", "left_semi")


def logged(log: DataFrame, new: DataFrame) -> DataFrame:
    """The log with rows appended; an id that is there already is not written again."""
    return log.unionByName(new.join(log.select("id"), "id", "left_anti"))


def unnested(rows: DataFrame, keys: Sequence[str], arrays: Sequence[str]) -> DataFrame:
    """Parallel arrays of each row as rows of their own, with their position from 1; shorter and null arrays are padded with null."""
    filled = (F.coalesce(F.col(c), F.array()).alias(c) for c in arrays)
    longest = rows.select(*keys, F.posexplode(F.arrays_zip(*filled)).alias("position", "row"))
    return longest.select(*keys, (F.col("position") + 1).alias("position"), *(F.col(f"row.{c}").alias(c) for c in arrays))


def from_arrays(spark, columns: dict[str, Sequence], schema: str) -> DataFrame:
    """Parallel arrays as rows, padded with null, with their position from 1."""
    longest = max((len(v) for v in columns.values()), default=0)
    rows = [(i + 1, *(v[i] if i < len(v) else None for v in columns.values())) for i in range(longest)]
    return spark.createDataFrame(rows, f"position int, {schema}")
