"""Aggregates and rankings of a periodic report. ``now`` and windows are always arguments."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quarryline.functions.semantics import latest_by, overlaps, tier_rank, within


def category_counts(latest: DataFrame, start: str, end: str) -> DataFrame:
    """Events for each category of a window; a null category is a group of its own."""
    return latest.where(within("event_time", start, end)).groupBy("category").agg(F.count("*").alias("n"))


def drift(latest: DataFrame, previous: str, start: str, end: str) -> DataFrame:
    """Counts of both windows for each category in one pass, and the change as a fraction of the former (one at least)."""
    now, before = within("event_time", start, end), within("event_time", previous, start)
    counts = latest.where(now | before).groupBy("category").agg(F.count_if(now).alias("current_n"), F.count_if(before).alias("previous_n"))
    return counts.withColumn("delta", (F.col("current_n") - F.col("previous_n")) / F.greatest("previous_n", F.lit(1)))


def drift_scores(latest: DataFrame, previous: str, start: str, end: str) -> DataFrame:
    """severity (largest change over all former events, at most 1) and likelihood (1 if any change is above 0.3); 0 without a former period."""
    d = drift(latest, previous, start, end)
    total = F.coalesce(F.sum("previous_n"), F.lit(0))
    severity = F.when(total == 0, 0.0).otherwise(F.least(F.lit(1.0), F.max(F.abs(F.col("current_n") - F.col("previous_n"))) / F.greatest(total, F.lit(1))))
    return d.agg(severity.alias("severity"), F.when((total > 0) & (F.max(F.abs("delta")) > 0.3), 1.0).otherwise(0.0).alias("likelihood"))


def window_totals(latest: DataFrame, start: str, end: str) -> DataFrame:
    return latest.where(within("event_time", start, end)).agg(F.count("*").alias("events"), F.countDistinct("primary_asset").alias("assets"))


def top_sensors(latest: DataFrame, start: str, end: str, k: int) -> DataFrame:
    counts = latest.where(within("event_time", start, end)).groupBy("sensor").agg(F.count("*").alias("n"))
    return counts.orderBy(F.desc("n"), "sensor").limit(k)


def story_overlap_count(canonical: DataFrame, start: str, end: str) -> DataFrame:
    return canonical.where(overlaps("window_start", "window_end", start, end)).agg(F.count("*").alias("stories"))


def top_techniques(live: DataFrame, k: int | None = None) -> DataFrame:
    """Tags by frequency; a tag twice in one result counts twice."""
    counts = live.select(F.explode("tags").alias("technique")).groupBy("technique").agg(F.count("*").alias("n"))
    ordered = counts.orderBy(F.desc("n"), "technique")
    return ordered.limit(k) if k else counts


def tier_distribution(live: DataFrame) -> DataFrame:
    return live.groupBy("tier").agg(F.count("*").alias("n")).withColumn("rank", tier_rank())


def top_events(live: DataFrame, covered: DataFrame, k: int) -> DataFrame:
    """Results above LOW that no chosen story covers: tier, then the sum of scores, then the key."""
    open_ = live.where("tier <> 'LOW'").join(covered, "event_key", "left_anti")
    order = [F.desc(tier_rank()), F.desc(F.col("severity") + F.col("likelihood")), F.asc("sensor"), F.asc("event_key")]
    return open_.orderBy(*order).limit(k).select("event_key", "sensor", "tier", "severity", "likelihood")


def covered_members(stories: DataFrame, members: DataFrame) -> DataFrame:
    """Keys of the members of the given stories, once each."""
    return members.join(stories.select("story_id"), "story_id", "left_semi").select(F.col("member_key").alias("event_key")).distinct()


def exemplar_clusters(live: DataFrame, k: int) -> DataFrame:
    """For each technique: count, highest tier and best-ranked event; the k first by tier, count and name."""
    rank = tier_rank()
    best = F.max(F.struct(rank.alias("tier_rank"), (F.col("severity") + F.col("likelihood")).alias("score"), (-F.col("event_key")).alias("minus_key")))
    rows = live.withColumn("technique", F.explode(F.array_distinct("tags"))).groupBy("technique").agg(F.count("*").alias("n"), best.alias("b"))
    rows = rows.select("technique", "n", F.col("b.tier_rank").alias("tier_rank"), (-F.col("b.minus_key")).alias("event_key"))
    return rows.orderBy(F.desc("tier_rank"), F.desc("n"), "technique").limit(k)


def group_rollup(latest: DataFrame) -> DataFrame:
    """Totals of all customers: assets are distinct within a customer, then summed."""
    return latest.groupBy("category").agg(F.count("*").alias("n"), F.countDistinct("customer_id", "primary_asset").alias("assets"))


def overview(live: DataFrame, since: str, cap: int) -> DataFrame:
    """Riskiest events of all customers: tier, severity, likelihood, recency, key."""
    rows = live.where(F.col("event_time") >= F.lit(since).cast("timestamp_ntz"))
    order = [F.desc(tier_rank()), F.desc("severity"), F.desc("likelihood"), F.desc("event_time"), F.asc("event_key")]
    return rows.orderBy(*order).limit(cap).select("customer_id", "event_key", "tier", "severity", "likelihood")


def compare_models(live: DataFrame) -> DataFrame:
    """Counts and highest scores by model and tier."""
    return live.groupBy("model", "tier").agg(F.count("*").alias("n"), F.max("severity").alias("max_severity"), F.max("likelihood").alias("max_likelihood"))


def likelihood_floors(live: DataFrame, hits: DataFrame, members: DataFrame, least: int = 5) -> DataFrame:
    """Floors never lower: 95 for an event with a known hit, 70 for one that ``least`` or more members share."""
    shared = members.groupBy(F.col("member_key").alias("event_key")).agg(F.count("*").alias("m"))
    rows = live.join(hits.select("event_key", F.lit(True).alias("hit")).distinct(), "event_key", "left").join(shared, "event_key", "left")
    floor = F.greatest(F.col("likelihood"), F.when(F.col("hit"), 95).otherwise(0), F.when(F.coalesce("m", F.lit(0)) >= least, 70).otherwise(0))
    return rows.select("event_key", "sensor", floor.alias("likelihood"))


def neighbors(buckets: DataFrame) -> DataFrame:
    """The bucket before and after each, within the customer."""
    w = Window.partitionBy("customer_id").orderBy("bucket")
    return buckets.select("customer_id", "bucket", F.lag("bucket").over(w).alias("previous_bucket"), F.lead("bucket").over(w).alias("next_bucket"))


def eligible_neighbors(buckets: DataFrame, eligible: DataFrame) -> DataFrame:
    """The eligible bucket before and after each bucket, within the customer and period; (customer_id, period, bucket) of both."""
    keys = ["customer_id", "period", "bucket"]
    marked = buckets.select(*keys).distinct().withColumn("asked", F.lit(True)).join(eligible.select(*keys).distinct().withColumn("open", F.lit(True)), keys, "full")
    w = Window.partitionBy("customer_id", "period").orderBy("bucket")
    open_ = F.when(F.col("open"), F.col("bucket"))
    before = F.last(open_, True).over(w.rowsBetween(Window.unboundedPreceding, -1))
    after = F.first(open_, True).over(w.rowsBetween(1, Window.unboundedFollowing))
    return marked.select(*keys, "asked", before.alias("previous_bucket"), after.alias("next_bucket")).where("asked").drop("asked")


def listed_since(live: DataFrame, tiers: list[str] | None, window: str, now: str) -> DataFrame:
    """Rows of some tiers (all if none are given) and of the last 24h, 7d or 30d before now (``all``: of any time)."""
    hours = {"24h": 24, "7d": 168, "30d": 720}.get(window)
    rows = live.where(F.col("tier").isin(tiers)) if tiers else live
    return rows if hours is None else rows.where(F.col("event_time") >= F.lit(now).cast("timestamp_ntz") - F.make_dt_interval(hours=F.lit(hours)))


def report_index(states: DataFrame, caps: dict[str, int]) -> DataFrame:
    """Of each period the newest buckets, as many as the period's cap."""
    order = Window.partitionBy("period").orderBy(F.desc("bucket"), "customer_id")
    cap = F.create_map(*(F.lit(x) for kv in caps.items() for x in kv))[F.col("period")]
    most = max(caps.values(), default=0)  # as a literal, so that each task cuts its rows down before the shuffle
    return states.withColumn("nth", F.row_number().over(order)).where(F.col("nth") <= most).where(F.col("nth") <= cap).select("period", "nth", "bucket", "customer_id")


def report_list(states: DataFrame, caps: dict[str, int]) -> DataFrame:
    """Of each period (LIVE included) the first reports by bucket, last change and zone, as many as the period's cap."""
    order = Window.partitionBy("period").orderBy(F.desc("bucket"), F.desc("updated_at"), F.asc("zone"), F.asc("customer_id"))
    cap = F.create_map(*(F.lit(x) for kv in caps.items() for x in kv))[F.col("period")]
    return states.withColumn("nth", F.row_number().over(order)).where(F.col("nth") <= max(caps.values(), default=0)).where(F.col("nth") <= cap)


def newest_report(states: DataFrame) -> DataFrame:
    return latest_by(states, ["customer_id", "period"], [F.desc("bucket")])
