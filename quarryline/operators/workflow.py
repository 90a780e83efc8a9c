"""Groups of customers, source selection, evidence, generations, work due and its plans."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quarryline.functions.semantics import admitted
from quarryline.operators import drops

#: The units of the three calendar periods; tokens an event and a member cost a month; dollars a thousand tokens.
PERIODS = {"DAILY": "day", "WEEKLY": "week", "MONTHLY": "month"}
EVENT_TOKENS, MEMBER_TOKENS, DOLLARS = 12, 20_000, 0.01


def group_buckets(baseline: DataFrame, members: DataFrame, zones: DataFrame) -> DataFrame:
    """(group_id, period, bucket, events, last_event): members' events in the calendar of the group's own zone.

    ``members``: group_id, customer_id; ``zones``: group_id, zone, floor (its creation date). Buckets before that of the floor are left out.
    """
    dims = members.join(zones, "group_id")
    local = F.from_utc_timestamp(F.col("event_time").cast("string"), F.col("zone"))
    starts = lambda t: F.array(*(F.struct(F.lit(p).alias("period"), F.to_date(F.date_trunc(u, t)).alias("bucket")) for p, u in PERIODS.items()))
    rows = baseline.where("event_time is not null").select("customer_id", "event_time").join(dims, "customer_id")
    rows = rows.select("group_id", "event_time", F.arrays_zip(starts(local).alias("b"), starts(F.col("floor")).alias("f")).alias("z"))
    rows = rows.select("group_id", "event_time", F.explode("z").alias("z")).where("z.b.bucket >= z.f.bucket")
    return rows.groupBy("group_id", F.col("z.b.period").alias("period"), F.col("z.b.bucket").alias("bucket")).agg(F.count("*").alias("events"), F.max("event_time").alias("last_event"))


def group_actions(buckets: DataFrame, existing: DataFrame) -> DataFrame:
    """What each bucket needs: seed, dirty (generated and changed), patch (changed) or keep. Existing ones without data fall to 0; archived ones are left."""
    keys = ["group_id", "period", "bucket"]
    both = buckets.select(*keys, "events").join(existing.select(*keys, F.col("events").alias("had"), "status"), keys, "full")
    now = F.coalesce("events", F.lit(0))
    changed = now != F.col("had")
    action = F.when(F.col("status").isNull(), "seed").when(changed & F.col("status").isin("ready", "dirty"), "dirty").when(changed, "patch").otherwise("keep")
    return both.where("status is null or status <> 'archived'").select(*keys, now.alias("events"), action.alias("action"))


def retention_bounds(members: DataFrame, groups: DataFrame, ingestion: bool) -> DataFrame:
    """Each group's shortest bound in days, null if none: its own policy and its members' analysis days, each at least the ingestion days if ``ingestion``."""
    days = F.greatest("ingestion_days", "analysis_days") if ingestion else F.col("analysis_days")
    term = members.groupBy("group_id").agg(F.min(F.when(F.col("analysis_days").isNotNull(), days)).alias("member_days"))
    return groups.join(term, "group_id", "left").select("group_id", F.least("policy_days", "member_days").alias("bound_days"))


def monthly_cost(latest: DataFrame, members: DataFrame, now: str, days: int = 30) -> DataFrame:
    """Each group's recent events, tokens a month and dollars, to the cent."""
    end = F.lit(now).cast("timestamp_ntz")
    recent = latest.where((F.col("event_time") < end) & (F.col("event_time") >= end - F.make_dt_interval(F.lit(days))))
    per = recent.groupBy("customer_id").agg(F.count("*").alias("n"))
    sums = members.join(per, "customer_id", "left").groupBy("group_id").agg(F.coalesce(F.sum("n"), F.lit(0)).alias("events"), F.count("*").alias("members"))
    tokens = F.col("events") * EVENT_TOKENS + F.col("members") * MEMBER_TOKENS
    return sums.select("group_id", "events", tokens.alias("tokens"), F.round(tokens / 1000 * DOLLARS, 2).alias("dollars"))


def accessible(memberships: DataFrame, assignments: DataFrame) -> DataFrame:
    """(account, customer_id, roles): what an account reaches by membership or assignment, with its different roles in order."""
    every = memberships.select("account", "customer_id", "role").union(assignments.select("account", "customer_id", "role"))
    return every.groupBy("account", "customer_id").agg(F.array_join(F.array_sort(F.collect_set("role")), ",").alias("roles"))


def enabled_sources(subjects: DataFrame, chosen: DataFrame, default: Sequence[str] | None, alive: Sequence[str]) -> DataFrame:
    """(subject, sources): its own choice among live sources, else the default's, else all live ones."""
    live = F.array(*map(F.lit, alive))
    own = F.filter("sources", lambda s: F.array_contains(live, s))
    common = [s for s in default or () if s in alive] or list(alive)
    rest = F.array(*map(F.lit, common))
    return subjects.join(chosen, "subject", "left").select("subject", F.when(F.size(own) > 0, own).otherwise(rest).alias("sources"))


def sticky_evidence(held: DataFrame, new: DataFrame) -> DataFrame:
    """Evidence by subject after a run: a hit stays a hit; the floor's evidence only gives way to newer floor evidence."""
    old = held.select("subject", F.col("hit").alias("old_hit"), F.col("floor").alias("old_floor"))
    both = old.join(new.select("subject", "hit", "floor"), "subject", "full")
    hit = F.coalesce("old_hit", F.lit(False)) | F.coalesce("hit", F.lit(False))
    return both.select("subject", hit.alias("hit"), F.coalesce("floor", "old_floor").alias("floor"))


def supersede(results: DataFrame, new: DataFrame, keys: Sequence[str], at: Column) -> DataFrame:
    """Results with new rows appended as generation max + 1; the live row that one follows is stamped."""
    last = results.groupBy(*keys).agg(F.max("generation").alias("_last"))
    # Of several new rows of a key each supersedes the one before, in the order of their payloads.
    order = Window.partitionBy(*keys).orderBy("payload")
    nth, more = F.row_number().over(order), F.lead(F.lit(True)).over(order)
    added = new.select(*keys, "payload", nth.alias("_nth"), more.alias("_more")).join(last, list(keys), "left")
    added = added.select(*keys, "payload", (F.coalesce("_last", F.lit(0)) + F.col("_nth")).alias("generation"), F.when(F.col("_more"), at).cast("timestamp_ntz").alias("superseded_at"))
    stamped = results.join(new.select(*keys).distinct().withColumn("_new", F.lit(True)), list(keys), "left")
    stamp = F.coalesce("superseded_at", F.when(F.col("_new"), at))
    return stamped.select(*keys, "payload", "generation", stamp.alias("superseded_at")).unionByName(added)


def withdraw(rows: DataFrame, asked: DataFrame, keys: Sequence[str]) -> tuple[DataFrame, DataFrame]:
    """The rows that stay, and one row of counts: withdrawn keys, keys not found, keys asked for more than once."""
    one = asked.groupBy(*keys).agg(F.count("*").alias("times"))
    present = one.join(rows.select(*keys).distinct().withColumn("there", F.lit(True)), list(keys), "left")
    counts = present.agg(F.count_if(F.col("there")).alias("withdrawn"), F.count_if(F.col("there").isNull()).alias("not_found"), F.count_if(F.col("times") > 1).alias("repeated"))
    return rows.join(one, list(keys), "left_anti"), counts


def retry_due(jobs: DataFrame, now: str, base_seconds: int = 30, most: int = 5) -> DataFrame:
    """Jobs that may run: never tried, or base * 2^(attempts - 1) seconds since the last change have passed."""
    wait = F.lit(base_seconds) * F.pow(F.lit(2), F.least(F.col("attempts") - 1, F.lit(most)))
    due = F.col("updated_at") + F.make_dt_interval(secs=wait.cast("decimal(18,6)")) <= F.lit(now).cast("timestamp_ntz")
    return jobs.where((F.col("attempts") == 0) | due)


def watermark(marks: DataFrame) -> DataFrame:
    """Each subject's latest cursor; of equal times a strict one wins over a soft one."""
    top = F.max(F.struct(F.col("at"), (F.col("quality") == "strict").alias("strict")))
    return marks.where("at is not null").groupBy("subject").agg(top.alias("m")).select("subject", F.col("m.at").alias("at"), F.when(F.col("m.strict"), "strict").otherwise("soft").alias("quality"))


def job_seeds(states: DataFrame, jobs: DataFrame, languages: Sequence[str], most: int = 50) -> DataFrame:
    """(subject, language, generation) of jobs to add: missing ones of ready states, and the next generation of dirty ones up to ``most``."""
    wanted = states.where("status in ('ready', 'dirty')").select("subject", "status", F.explode(F.array(*map(F.lit, languages))).alias("language"))
    last = jobs.groupBy("subject", "language").agg(F.max("generation").alias("last"))
    rows = wanted.join(last, ["subject", "language"], "left")
    seeds = rows.where("last is null or (status = 'dirty' and last < " + str(int(most)) + ")")
    return seeds.select("subject", "language", (F.coalesce("last", F.lit(0)) + 1).alias("generation"))


def work_tiers(verdicts: DataFrame, cap: int) -> DataFrame:
    """Events' tiers: A with a known hit; B if the run and its coverage are complete, up to ``cap`` a customer and day; else held."""
    kind = F.when(F.col("hit"), "A").when((F.col("status") == "complete") & (F.col("coverage") == "complete"), "B").otherwise("held")
    rows = verdicts.withColumn("tier", kind)
    # Only the first rows of a customer and day are ranked together.
    first = admitted(rows.where("tier = 'B'"), ["customer_id", "day"], ["event_key"], cap)
    return rows.where("tier <> 'B'").unionByName(first.withColumn("tier", F.when(F.col("admitted"), "B").otherwise("held")).drop("admitted"))


def kept_factors(factors: Column) -> Column:
    """The first five factors that are neither blank nor long nor a sentence; the fixed words if none is left."""
    return drops.judged_factors(factors).getField("kept")


def factor_report(factors: Column) -> Column:
    """kept (as ``kept_factors``), dropped (blank, long or a sentence) and truncated (good, but beyond the first five), the last two as numbers."""
    judged = drops.judged_factors(factors)
    return F.struct(judged.getField("kept").alias("kept"), F.size(judged.getField("dropped")).alias("dropped"), F.size(judged.getField("truncated")).alias("truncated"))


def creation_floors(groups: DataFrame) -> DataFrame:
    """(group_id, period, floor): the bucket in the group's own zone that its creation (an instant) falls in; earlier ones are not seeded."""
    local = F.from_utc_timestamp(F.col("created_at").cast("string"), F.col("zone"))
    floors = F.array(*(F.struct(F.lit(p).alias("period"), F.to_date(F.date_trunc(u, local)).alias("floor")) for p, u in PERIODS.items()))
    return groups.select("group_id", F.inline(floors))


def technique_tags(tags: DataFrame, dictionary: DataFrame) -> DataFrame:
    """Each different tag's fate: valid, invalid_format or unknown."""
    known = dictionary.select("tag").distinct().withColumn("known", F.lit(True))
    state = F.when(~F.col("tag").rlike(r"^T\d{4}(\.\d{3})?$"), "invalid_format").when(F.col("known").isNull(), "unknown").otherwise("valid")
    return tags.groupBy("tag").agg(F.count("*").alias("n")).join(known, "tag", "left").select("tag", state.alias("state"), "n")


def alert_summary(alerts: DataFrame, since: str) -> DataFrame:
    """Counts since an instant, by severity and by indicator, from one pass."""
    kinds = F.array(F.struct(F.lit("severity").alias("kind"), F.col("severity").alias("name")), F.struct(F.lit("indicator").alias("kind"), F.col("indicator").alias("name")))
    rows = alerts.where(F.col("at") >= F.lit(since).cast("timestamp_ntz")).select(F.inline(kinds))
    return rows.groupBy("kind", "name").agg(F.count("*").alias("n"))


def contains_ref(refs: Column, **parts: object) -> Column:
    """Whether an array of structs holds one with all these field values."""

    def same(r: Column) -> Column:
        out = F.lit(True)
        for name, value in parts.items():
            out = out & (r[name] == F.lit(value))
        return out

    return F.exists(refs, same)


def refresh_plan(variants: DataFrame, cap: int, most: int = 50) -> DataFrame:
    """Each report variant's outcome; only refreshable ones, freshest first in each subject, count against the cap.

    Archived states come before queued jobs, those before the last generation, that before undrained sources.
    """
    queued = F.coalesce(F.col("job_status").isin("queued", "processing"), F.lit(False))
    done = F.coalesce(F.col("generation") >= most, F.lit(False))
    before = F.when(F.col("archived"), "source_unavailable").when(queued, "already_queued").when(done, "capped").when(~F.col("drained"), "gated").otherwise("refreshable")
    rows = variants.withColumn("outcome", before)
    # Only the first rows of a subject are ranked together; the others are told by their last one.
    marked = admitted(rows.withColumn("_open", F.col("outcome") == "refreshable").withColumn("_age", -F.unix_micros(F.col("bucket").cast("string").cast("timestamp"))), ["subject", "_open"], ["_age", "variant"], cap)
    final = F.when(~F.col("_open"), F.col("outcome")).when(F.col("admitted"), "refreshed").otherwise("limited")
    return marked.withColumn("outcome", final).drop("_open", "_age", "admitted")


def unreferenced(maps: DataFrame, referents: Sequence[DataFrame], keys: Sequence[str]) -> DataFrame:
    """Maps that none of the referent tables holds: their keys are united first, so that the maps are shuffled once."""
    held = referents[0].select(*keys)
    for r in referents[1:]:
        held = held.unionByName(r.select(*keys))
    return maps.join(held, list(keys), "left_anti")


def reap_reports(reports: DataFrame, bounds: DataFrame, today: str) -> DataFrame:
    """Reports beyond their group's bound in days; live ones and groups without a bound are exempt."""
    old = F.col("bucket") < F.date_sub(F.lit(today).cast("date"), F.col("bound_days").cast("int"))
    return reports.where("period <> 'LIVE'").join(bounds.where("bound_days is not null"), "group_id").where(old).drop("bound_days")
