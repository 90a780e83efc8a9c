"""State of stories and report buckets: how arrivals, replacements, watermarks, zones and reconciling change it.

A state row is (customer_id, period, bucket, zone, status, ...). Jobs are (…keys, job_status). Late data re-opens a bucket of any age.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quarryline.functions.calendar import LIVE_DATE, midnight, shifted
from quarryline.operators.activity import PERIODS, SETTLE_HOURS

#: Hours until a day is settled under a strict watermark, minutes of quiet, generations of a job at most.
STRICT_HOURS, QUIET_MINUTES, MOST_GENERATIONS = 1, 30, 50


def local_rollup(baseline: DataFrame, zones: DataFrame) -> DataFrame:
    """Each customer's day, week and month buckets in its own zone, from one scan: last event, last arrival, raw rows."""
    rows = baseline.join(zones.select("customer_id", "zone"), "customer_id")
    local = F.from_utc_timestamp(F.col("event_time").cast("string"), F.col("zone"))
    kinds = F.array(*(F.struct(F.lit(p).alias("period"), F.to_date(F.date_trunc(u, local)).alias("bucket")) for p, u in PERIODS))
    rows = rows.select("customer_id", "zone", "event_time", "received_at", F.explode(kinds).alias("b"))
    return rows.groupBy("customer_id", "zone", "b.period", "b.bucket").agg(F.max("event_time").alias("last_event"), F.max("received_at").alias("last_received"), F.count("*").alias("n"))


def local_story_rollup(stories: DataFrame, zones: DataFrame) -> DataFrame:
    """Stories in each local day, week and month that they overlap; an end on a bucket's start doesn't count."""
    rows = stories.join(zones.select("customer_id", "zone"), "customer_id")
    first, last = (F.from_utc_timestamp(F.col(c).cast("string"), F.col("zone")) for c in ("window_start", "window_end"))
    steps = {"DAILY": "INTERVAL 1 DAY", "WEEKLY": "INTERVAL 7 DAYS", "MONTHLY": "INTERVAL 1 MONTH"}
    spans = [F.transform(F.sequence(F.to_date(F.date_trunc(u, first)), F.to_date(F.date_trunc(u, last)), F.expr(steps[p])), lambda b: F.struct(F.lit(p).alias("period"), b.alias("bucket"))) for p, u in PERIODS]  # noqa: B023
    rows = rows.withColumn("b", F.explode(F.concat(*spans))).where(F.col("window_end") > midnight(F.col("b.bucket"), F.col("zone")))
    return rows.groupBy("customer_id", "zone", "b.period", "b.bucket").agg(F.count_distinct("story_id").alias("stories"), F.max("received_at").alias("last_received"))


def target_counts(targets: DataFrame, rollup: DataFrame) -> DataFrame:
    """Every target bucket (customer_id, zone, period, bucket) with its events; those without any have 0."""
    keys = ["customer_id", "zone", "period", "bucket"]
    return targets.join(rollup.select(*keys, "n", "last_event"), keys, "left").withColumn("n", F.coalesce("n", F.lit(0)))


def settled(states: DataFrame, now: str) -> DataFrame:
    """States with ``ready``: pending ones whose bucket's end and delay have passed, quiet since their last change.

    states: period, bucket, zone, status, updated_at, cursor, quality. A strict cursor at a day's end or later shortens its delay.
    A pending LIVE bucket is always ready.
    """
    t = F.lit(now).cast("timestamp_ntz")
    end = midnight(shifted(F.col("bucket"), F.col("period"), 1), F.col("zone"))
    hours = F.create_map(*(F.lit(x) for kv in SETTLE_HOURS.items() for x in kv))[F.col("period")]
    late = end + F.make_dt_interval(hours=hours) <= t
    early = (F.col("period") == "DAILY") & (F.col("quality") == "strict") & (F.col("cursor") >= end) & (end + F.expr(f"INTERVAL {STRICT_HOURS} HOURS") <= t)
    quiet = F.col("updated_at") <= t - F.expr(f"INTERVAL {QUIET_MINUTES} MINUTES")
    ready = (F.col("status") == "pending") & ((F.col("period") == "LIVE") | (F.coalesce(late | early, F.lit(False)) & quiet))
    return states.withColumn("ready", F.coalesce(ready, F.lit(False)))


def _worked(jobs: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Keys with a job that is processing or done."""
    return jobs.where("job_status in ('processing', 'done')").select(*keys).distinct().withColumn("_worked", F.lit(True))


def after_activity(states: DataFrame, activity: DataFrame, jobs: DataFrame) -> DataFrame:
    """States after events of their buckets arrived (keys, last_event, last_received): times only grow, a ready one with a worked job turns dirty, archived ones are left."""
    keys = ["customer_id", "period", "bucket", "zone"]
    new = activity.select(*keys, F.col("last_event").alias("_event"), F.col("last_received").alias("_received"))
    rows = states.join(new, keys, "left").join(_worked(jobs, keys), keys, "left")
    met = F.col("_received").isNotNull() & (F.col("status") != "archived")
    status = F.when(met & (F.col("status") == "ready") & F.col("_worked"), "dirty").otherwise(F.col("status"))
    grown = {c: F.when(met, F.greatest(c, n)).otherwise(F.col(c)) for c, n in (("last_event", "_event"), ("last_received", "_received"))}
    return rows.withColumns({"status": status, **grown}).drop("_event", "_received", "_worked")


def after_member(states: DataFrame, arrivals: DataFrame, jobs: DataFrame) -> DataFrame:
    """Story states after members arrived (customer_id, story_id, arrived_at): new ones are pending, archived ones start afresh, ready ones with a worked job turn dirty."""
    keys = ["customer_id", "story_id"]
    new = arrivals.groupBy(*keys).agg(F.min("arrived_at").alias("_first"), F.max("arrived_at").alias("_last"))
    rows = states.join(new, keys, "full").join(_worked(jobs, keys), keys, "left")
    met, held = F.col("_last").isNotNull(), F.col("status").isNotNull()
    revived = held & met & (F.col("status") == "archived")
    status = F.when(~held | revived, "pending").when(met & (F.col("status") == "ready") & F.col("_worked"), "dirty").otherwise(F.col("status"))
    first = F.when(revived, None).when(held, F.col("first_member")).otherwise(F.col("_first"))
    last = F.when(revived, None).otherwise(F.greatest("last_member", "_last"))
    return rows.withColumns({"first_member": first, "last_member": last, "status": status}).drop("_first", "_last", "_worked")


def archived(states: DataFrame, surviving: DataFrame) -> DataFrame:
    """Story states after a replacement: no version left means archived; an archived one with versions again starts afresh."""
    rows = states.join(surviving.select("story_id", "surviving"), "story_id", "left")
    back = (F.col("status") == "archived") & (F.col("surviving") > 0)
    status = F.when(F.col("surviving") == 0, "archived").when(back, "pending").otherwise(F.col("status"))
    return rows.withColumns({"status": status, **{c: F.when(~F.coalesce(back, F.lit(False)), F.col(c)) for c in ("first_member", "last_member")}}).drop("surviving")


def dirtied(states: DataFrame, jobs: DataFrame, counts: DataFrame, stories: DataFrame, start: str, end: str, live_touched: bool = False) -> DataFrame:
    """States after a window was replaced: those that overlap it get their counts anew, and with a worked job turn dirty.

    Pending ones are recounted without a job; archived ones, and ready ones without a job, are left. LIVE counts if it was touched.
    """
    keys = ["customer_id", "period", "bucket", "zone"]
    begin, stop = midnight(F.col("bucket"), F.col("zone")), midnight(shifted(F.col("bucket"), F.col("period"), 1), F.col("zone"))
    over = F.when(F.col("period") == "LIVE", F.lit(live_touched)).otherwise((begin < F.lit(end).cast("timestamp_ntz")) & (stop > F.lit(start).cast("timestamp_ntz")))
    rows = states.join(_worked(jobs, keys), keys, "left").join(counts.select(*keys, F.col("n").alias("_n")), keys, "left").join(stories.select(*keys, F.col("stories").alias("_stories")), keys, "left")
    worked = F.coalesce("_worked", F.lit(False))
    met = over & (F.col("status") != "archived") & ((F.col("status") == "pending") | worked)
    status = F.when(met & F.col("status").isin("ready", "dirty") & worked, "dirty").otherwise(F.col("status"))
    fresh = {c: F.when(met, F.coalesce(n, c)).otherwise(F.col(c)) for c, n in (("events", "_n"), ("stories", "_stories"))}
    return rows.withColumns({"status": status, **fresh}).drop("_worked", "_n", "_stories")


def reconciled(derived: DataFrame, states: DataFrame, keys: Sequence[str]) -> DataFrame:
    """What each bucket needs when the states are held against the data: seed (missing), patch (behind), archive (no data left) or keep; archived ones are left.

    derived and states: keys, last_event, n. Times and counts are only moved forward.
    """
    d = derived.select(*keys, F.col("last_event").alias("_event"), F.col("n").alias("_n"))
    both = d.join(states.select(*keys, "status", "last_event", "n"), list(keys), "full")
    behind = (F.col("_event") > F.col("last_event")) | F.col("last_event").isNull() | (F.col("_n") > F.col("n"))
    action = F.when(F.col("status").isNull(), "seed").when(F.col("_n").isNull(), "archive").when(F.coalesce(behind, F.lit(False)), "patch").otherwise("keep")
    return both.where("status is null or status <> 'archived'").select(*keys, action.alias("action"))


def orphaned(states: DataFrame, stories: DataFrame) -> DataFrame:
    """Story states that are not archived although no version of the story is left: one anti-join in place of a paged scan."""
    return states.where("status <> 'archived'").join(stories.select("story_id").distinct(), "story_id", "left_anti")


def story_buckets(stories: DataFrame) -> DataFrame:
    """(customer_id, period, bucket) that the start or the end of a story falls in, once each."""
    kinds = [F.struct(F.lit(p).alias("period"), F.to_date(F.date_trunc(u, F.col(c))).alias("bucket")) for p, u in PERIODS for c in ("window_start", "window_end")]
    return stories.select("customer_id", F.inline(F.array(*kinds))).distinct()


def live_jobs(jobs: DataFrame, states: DataFrame, now: str, most: int = MOST_GENERATIONS) -> DataFrame:
    """LIVE jobs that are done and due again: queued with the next generation, or capped at the last one."""
    due = (F.col("period") == "LIVE") & (F.col("job_status") == "done") & ~F.col("dry_run") & (F.col("next_due") <= F.lit(now).cast("timestamp_ntz"))
    rows = jobs.where(due).join(states.where("status not in ('archived', 'dirty')").select("customer_id", "zone"), ["customer_id", "zone"], "left_semi")
    again = F.col("generation") < most
    return rows.select("customer_id", "zone", F.when(again, "queued").otherwise("capped").alias("action"), (F.col("generation") + F.when(again, 1).otherwise(0)).alias("generation"))


def zone_changed(states: DataFrame, zones: DataFrame) -> DataFrame:
    """States whose zone is no longer the customer's are archived."""
    rows = states.join(zones.select("customer_id", F.col("zone").alias("_zone")), "customer_id", "left")
    return rows.withColumn("status", F.when(F.col("zone") != F.col("_zone"), "archived").otherwise(F.col("status"))).drop("_zone")


def watermarked(states: DataFrame, marks: DataFrame) -> DataFrame:
    """States with their customer's cursor, archived ones included: it only moves forward, and of equal times strict wins."""
    key = lambda at, quality: F.struct(at.alias("at"), (quality == "strict").alias("strict"))
    rows = states.join(marks.select("customer_id", F.col("at").alias("_at"), F.col("quality").alias("_quality")), "customer_id", "left")
    held = F.when(F.col("cursor").isNotNull(), key(F.col("cursor"), F.coalesce("quality", F.lit("soft"))))
    top = F.greatest(held, F.when(F.col("_at").isNotNull(), key(F.col("_at"), F.col("_quality"))))
    rows = rows.withColumn("_top", top)
    return rows.withColumns({"cursor": F.col("_top.at"), "quality": F.when(F.col("_top.strict"), "strict").when(F.col("_top").isNotNull(), "soft")}).drop("_at", "_quality", "_top")


def held_jobs(jobs: DataFrame, now: str, most_attempts: int, most_minutes: int) -> DataFrame:
    """Events that wait for their enrichment: tier_a (known hit), tier_b (fully checked), fallback (waited or tried long enough: tier B unchecked) or held."""
    age = F.lit(now).cast("timestamp_ntz") >= F.col("created_at") + F.make_dt_interval(mins=F.lit(most_minutes))
    done = (F.col("run") == "complete") & (F.col("coverage") == "complete")
    tier = F.when(F.col("hit"), "tier_a").when(done, "tier_b").when((F.col("attempts") + 1 >= most_attempts) | age, "fallback").otherwise("held")
    return jobs.withColumn("tier", tier)


def ordered_states(states: DataFrame) -> DataFrame:
    """LIVE buckets first, then the newest, then by zone."""
    return states.orderBy(F.when(F.col("period") == "LIVE", 0).otherwise(1), F.desc("bucket"), F.asc("zone"), F.asc("customer_id"))


def live_state(events: DataFrame, now: str) -> DataFrame:
    """The LIVE state of each customer with events in the 24 hours before now."""
    t = F.lit(now).cast("timestamp_ntz")
    recent = events.where((F.col("event_time") >= t - F.expr("INTERVAL 24 HOURS")) & (F.col("event_time") < t))
    return recent.groupBy("customer_id").agg(F.max("event_time").alias("last_event"), F.max("received_at").alias("last_received")).select(
        "customer_id", F.lit("LIVE").alias("period"), F.lit(LIVE_DATE).cast("date").alias("bucket"), F.lit("ready").alias("status"), "last_event", "last_received"
    )


def enqueue_class(state: Column, target: Column, alive: Column) -> Column:
    """What a story's leaf needs to be analysed by a model: source_unavailable, skipped_dirty, seeded, requeued or coalesced."""
    return F.when((state == "archived") | ~alive, "source_unavailable").when(state == "dirty", "skipped_dirty").when(target.isNull(), "seeded").when(target == "failed", "requeued").otherwise("coalesced")


def drain_class(state: Column, target: Column, alive: Column) -> Column:
    """How far a leaf is: source_unavailable, skipped_dirty, absent, failed_outstanding, queued, processing or drained."""
    named = F.when(target == "failed", "failed_outstanding").when(target.isin("queued", "processing"), target).otherwise("drained")
    return F.when((state == "archived") | ~alive, "source_unavailable").when(state == "dirty", "skipped_dirty").when(target.isNull(), "absent").otherwise(named)


def story_plan(leaves: DataFrame, cap: int) -> DataFrame:
    """(customer_id, class, n) of leaves (class by ``enqueue_class``): what is seeded or requeued beyond the cap, in scan order, is cap_excluded.

    The first rows of a customer are cut down in each task; the rest is counted, not ranked.
    """
    from quarryline.functions.semantics import running_cap

    acts = F.col("class").isin("seeded", "requeued")
    first = running_cap(leaves.where(acts), ["customer_id"], [F.desc("window_start"), F.asc("story_id"), F.asc("language")], cap).groupBy("customer_id", "class").agg(F.count("*").alias("n"))
    left = leaves.where(acts).groupBy("customer_id").agg((F.count("*") - cap).alias("n")).where("n > 0").select("customer_id", F.lit("cap_excluded").alias("class"), "n")
    rest = leaves.where(~acts).groupBy("customer_id", "class").agg(F.count("*").alias("n"))
    return first.unionByName(left).unionByName(rest)


def drain_signal(leaves: DataFrame) -> DataFrame:
    """(customer_id, total, outstanding, drained) of leaves (class by ``drain_class``); those without a source don't count."""
    counted = leaves.where("class <> 'source_unavailable'")
    told = counted.groupBy("customer_id").agg(F.count("*").alias("total"), F.count_if(F.col("class") != "drained").alias("outstanding"))
    every = leaves.select("customer_id").distinct().join(told, "customer_id", "left")
    return every.select("customer_id", F.coalesce("total", F.lit(0)).alias("total"), F.coalesce("outstanding", F.lit(0)).alias("outstanding"), (F.coalesce("outstanding", F.lit(0)) == 0).alias("drained"))


def purged(log: DataFrame, now: str, days: int) -> DataFrame:
    """The audit log without rows that no longer name an address and are older than the days kept."""
    old = F.col("logged_at") < F.lit(now).cast("timestamp_ntz") - F.make_dt_interval(days=F.lit(days))
    return log.where(~(F.col("ip").isNull() & F.coalesce(old, F.lit(False))))


def qualifying_managers(members: DataFrame, grants: DataFrame) -> DataFrame:
    """(group_id, account, since): active accounts that manage every member of a group, by role or eligible assignment; since when they do.

    grants: account, customer_id, granted_at, active. A member's earliest grant counts, the latest of these is since when all are covered.
    """
    held = grants.where("active").groupBy("account", "customer_id").agg(F.min("granted_at").alias("at"))
    sizes = members.groupBy("group_id").agg(F.count_distinct("customer_id").alias("size"))
    covered = members.select("group_id", "customer_id").distinct().join(held, "customer_id").groupBy("group_id", "account").agg(F.count("*").alias("n"), F.max("at").alias("since"))
    return covered.join(sizes, "group_id").where("n = size").select("group_id", "account", "since")


def swept(parents: DataFrame, children: DataFrame, key: str, column: str, now: str, days: int) -> DataFrame:
    """One row of a retention sweep: parents that go by their age, and their children that go with them."""
    old = parents.where(F.col(column) < F.lit(now).cast("timestamp_ntz") - F.make_dt_interval(days=F.lit(days)))
    below = children.join(old.select(key).distinct(), key, "left_semi").agg(F.count("*").alias("children"))
    return old.agg(F.count("*").alias("parents")).crossJoin(F.broadcast(below))
