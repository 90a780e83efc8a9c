"""What stands on what: members and their events, citations, pinned references, policy agreement."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quarryline.functions.semantics import latest_by


def members_with_events(members: DataFrame, latest: DataFrame) -> DataFrame:
    """Each member with the latest baseline event of its key over all sensors; unmatched ones have no event time."""
    one = latest_by(latest, ["event_key"], [F.desc_nulls_last("received_at"), F.desc_nulls_last("baseline_version"), F.asc("sensor")])
    events = one.select(F.col("event_key").alias("member_key"), "event_time", "category")
    return members.join(events, "member_key", "left")


def member_quality(members: DataFrame, baseline: DataFrame) -> DataFrame:
    """One row: members, those without any baseline row, and those that more than one version matches."""
    versions = baseline.groupBy(F.col("event_key").alias("member_key")).agg(F.count("*").alias("versions"))
    found = members.join(versions, "member_key", "left")
    return found.agg(F.count("*").alias("members"), F.count_if(F.col("versions").isNull()).alias("unmatched"), F.count_if(F.col("versions") > 1).alias("over_matched"))


def stories_of(members: DataFrame, events: DataFrame) -> DataFrame:
    """(event_key, stories): how many stories hold each event and the smallest of them."""
    held = members.join(events.select(F.col("event_key").alias("member_key")).distinct(), "member_key", "left_semi")
    return held.groupBy(F.col("member_key").alias("event_key")).agg(F.count_distinct("story_id").alias("stories"), F.min("story_id").alias("first_story"))


def newest_row(baseline: DataFrame, keys: DataFrame) -> DataFrame:
    """The newest baseline row of each asked event key across all sources."""
    asked = baseline.join(keys, "event_key", "left_semi")
    return latest_by(asked, ["event_key"], [F.desc_nulls_last("received_at"), F.desc_nulls_last("baseline_version"), F.asc("sensor")])


def invalid_citations(citations: DataFrame, allowed: DataFrame) -> DataFrame:
    """Citations (report, position, kind, source) that are malformed or outside the allowed (report, kind, source)."""
    known = allowed.select("report", "kind", "source").distinct().withColumn("known", F.lit(True))
    malformed = F.col("kind").isNull() | ~F.col("kind").isin("story", "event") | F.col("source").isNull()
    reason = F.when(malformed, "malformed").when(F.col("known").isNull(), "not_allowed")
    return citations.join(known, ["report", "kind", "source"], "left").withColumn("reason", reason).where("reason is not null").drop("known")


def citation_mismatches(left: DataFrame, right: DataFrame) -> DataFrame:
    """Positions, each once in a list, at which two citation lists (report, position, kind, source) differ: count, type or source."""
    sides = [d.select("report", "position", F.col("kind").alias(f"kind_{s}"), F.col("source").alias(f"source_{s}"), F.lit(True).alias(s)) for d, s in ((left, "l"), (right, "r"))]
    both = sides[0].join(sides[1], ["report", "position"], "full")
    differs = F.when(F.col("l").isNull() | F.col("r").isNull(), "count").when(~F.col("kind_l").eqNullSafe(F.col("kind_r")), "type").when(~F.col("source_l").eqNullSafe(F.col("source_r")), "source")
    return both.select("report", "position", differs.alias("mismatch")).where("mismatch is not null")


def preferred(candidates: DataFrame, keys: Sequence[str], models: Sequence[str], tie: Sequence[Column]) -> DataFrame:
    """Of each key the candidate of the first model in the list of preferences; other models take no part."""
    place = F.array_position(F.array(*map(F.lit, models)), F.col("model"))
    return latest_by(candidates.withColumn("preference", place).where("preference > 0"), keys, [F.col("preference"), *tie])


def pinned(refs: DataFrame, rows: DataFrame, key: str) -> DataFrame:
    """Rows of pinned references (report, position, key) of reports all of whose references are found."""
    found = refs.join(rows.withColumn("_found", F.lit(True)), key, "left")
    whole = found.groupBy("report").agg(F.bool_and(F.col("_found").isNotNull()).alias("whole")).where("whole").select("report")
    return found.join(whole, "report", "left_semi").drop("_found")


def citing_reports(reports: DataFrame, order: Sequence[Column], **reference: object) -> DataFrame:
    """Live reports whose ``refs`` hold the reference (field=value, ...), the first of each bucket in the given order."""
    from quarryline.operators.workflow import contains_ref

    return latest_by(reports.where(~F.col("superseded") & contains_ref(F.col("refs"), **reference)), ["bucket"], order)


def policy_of_all(subjects: DataFrame, agreement: DataFrame, keys: Sequence[str]) -> DataFrame:
    """``policy_agreement`` of every subject; those without any leaf stand on the baseline alone: baseline-only."""
    return subjects.join(agreement, list(keys), "left").withColumn("state", F.coalesce("state", F.lit("baseline-only")))


def policy_agreement(rows: DataFrame, keys: Sequence[str], order: str, version: str) -> DataFrame:
    """For each key ok, missing or mismatched over its rows' versions; the first offender in scan order decides.

    An empty version seen before a row that differs from the first gives missing, after it mismatched. One pass of
    aggregation: no row order is needed beyond the positions of the first offenders.
    """
    empty = F.col(version).isNull() | (F.col(version) == "")
    first = rows.groupBy(*keys).agg(F.min_by(F.coalesce(version, F.lit("")), order).alias("_first"))
    joined = rows.join(first, list(keys))
    seen = joined.groupBy(*keys).agg(F.min(F.when(empty, F.col(order))).alias("_empty"), F.min(F.when(~empty & (F.col(version) != F.col("_first")), F.col(order))).alias("_other"), F.first("_first").alias("_first"))
    missing = F.col("_empty").isNotNull() & (F.col("_other").isNull() | (F.col("_empty") < F.col("_other")))
    state = F.when(missing, "missing").when(F.col("_other").isNotNull(), "mismatched").otherwise("ok")
    return seen.select(*keys, state.alias("state"), F.when(state == "ok", F.col("_first")).alias("version"))
