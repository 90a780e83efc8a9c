"""Queries of incoming batches and of the state of stories and buckets. Importing this registers them."""

from __future__ import annotations

from pyspark.sql import functions as F

from quarryline.operators import intake as a
from quarryline.operators import states as t
from quarryline.plans.catalog import DAY, DAY_AFTER, NOW, query
from quarryline.sources import views as v

_at = lambda: F.lit("2024-02-02").cast("timestamp_ntz")
_stamp = lambda c: F.date_format(c, "yyyy-MM-dd HH:mm:ss")
_FORM = "'%Y-%m-%d %H:%M:%S'"


def _batch(spark, d):
    """Events twice for every fifth, with their position; every third is held already."""
    e = v.table(spark, d, "events").select(F.col("event_id").alias("event_key"), F.col("event_id").alias("place"), "event_type")
    again = e.where("event_key % 5 = 0").withColumns({"place": F.col("place") + 10**9, "event_type": F.lit("again")})
    return e.where("event_key % 3 = 0"), e.unionByName(again)


@query("intake_accepted", "SELECT event_id AS event_key, event_type, '2024-02-02 00:00:00' AS received_at FROM events WHERE event_id % 3 <> 0")
def _(spark, d):
    held, batch = _batch(spark, d)
    return a.accepted(held, batch, ["event_key"], _at()).select("event_key", "event_type", _stamp("received_at").alias("received_at"))


@query("intake_counts", "SELECT count(*) FILTER (WHERE event_id % 3 <> 0) AS accepted, count(*) + count(*) FILTER (WHERE event_id % 5 = 0) - count(*) FILTER (WHERE event_id % 3 <> 0) AS duplicates FROM events")
def _(spark, d):
    held, batch = _batch(spark, d)
    return a.counts(batch, a.accepted(held, batch, ["event_key"], _at()))


def _story_batch(spark, d):
    """Half of the stories and two thirds of their members are there already."""
    stories = v.incident(spark, d).withColumn("place", F.col("story_id"))
    members = v.incident_member(spark, d).distinct().withColumn("place", F.col("member_key"))
    keys = ["story_id", "story_version"]
    return a.with_children(stories, members, stories.where("story_id % 2 = 0").drop("place"), members.where("story_id % 2 = 0 AND member_key % 3 > 0"), keys, "member_key", _at())


@query("intake_stories", """SELECT (SELECT count(*) FROM incident WHERE story_id % 2 = 1) AS stories, (SELECT count(*) FROM (SELECT DISTINCT * FROM incident_member) WHERE story_id % 2 = 1 OR member_key % 3 = 0) AS members""", "incident", "incident_member")
def _(spark, d):
    stories, members, _ = _story_batch(spark, d)
    return stories.agg(F.count("*").alias("stories")).crossJoin(members.agg(F.count("*").alias("members")))


@query("intake_arrivals", f"""SELECT story_id, story_version, count(*) AS n, strftime(max(CASE WHEN story_id % 2 = 0 THEN received_at ELSE TIMESTAMP '2024-02-02' END), {_FORM}) AS arrived FROM (SELECT DISTINCT * FROM incident_member) JOIN incident USING (story_id, story_version)
    WHERE story_id % 2 = 1 OR member_key % 3 = 0 GROUP BY story_id, story_version""", "incident", "incident_member")
def _(spark, d):
    arrivals = _story_batch(spark, d)[2]
    return arrivals.groupBy("story_id", "story_version").agg(F.count("*").alias("n"), _stamp(F.max("arrived_at")).alias("arrived"))


@query("intake_policy_runs", "SELECT count(DISTINCT o_custkey) FILTER (WHERE o_custkey % 4 > 0) AS runs, count(*) FILTER (WHERE o_orderkey % 3 > 0) AS events FROM orders")
def _(spark, d):
    o = v.table(spark, d, "orders").select(F.col("o_custkey").alias("run_id"), F.col("o_orderkey").alias("event_key"), F.col("o_orderkey").alias("place"))
    runs = o.select("run_id", F.col("event_key").alias("place"))
    held = runs.where("run_id % 4 = 0").select("run_id").distinct().withColumn("received_at", _at())
    new, added, _ = a.with_children(runs, o, held, o.where("event_key % 3 = 0"), ["run_id"], "event_key", _at())
    return new.agg(F.count("*").alias("runs")).crossJoin(added.agg(F.count("*").alias("events")))


@query("payload_faults", f"""SELECT event_key, 'outside_window' AS fault FROM baseline WHERE NOT (event_time >= TIMESTAMP '{DAY}' AND event_time < TIMESTAMP '{NOW}') UNION ALL SELECT event_key, 'duplicate' FROM baseline GROUP BY event_key HAVING count(*) > 1""", "baseline")
def _(spark, d):
    return a.faults(v.baseline(spark, d), ["event_key"], "event_time", DAY, NOW)


@query("replace_counts", f"""SELECT count(*) FILTER (WHERE baseline_version = 'v2') AS deleted, bool_or(event_time >= TIMESTAMP '{NOW}' - INTERVAL 24 HOUR AND event_time < TIMESTAMP '{NOW}') FILTER (WHERE baseline_version = 'v2') AS live_overlap,
    count(*) FILTER (WHERE baseline_version = 'v1') AS accepted FROM baseline WHERE event_time >= TIMESTAMP '{DAY}' AND event_time < TIMESTAMP '{NOW}'""", "baseline")
def _(spark, d):
    b = v.baseline(spark, d)
    payload = b.where(f"baseline_version = 'v1' AND event_time >= TIMESTAMP_NTZ'{DAY}' AND event_time < TIMESTAMP_NTZ'{NOW}'").withColumn("baseline_version", F.lit("v2"))
    return a.replaced_baseline(b, payload, "v2", DAY, NOW, NOW)[1]


_GONE = f"kind = 'auto_correlated' AND window_start >= TIMESTAMP '{DAY}' AND window_start < TIMESTAMP '{DAY_AFTER}'"


def _story_replace(spark, d):
    i = v.incident(spark, d)
    payload = i.where("story_id % 40 = 0 AND story_version = 'v1'").withColumns({"story_version": F.lit("v3"), "received_at": F.lit("2024-02-03").cast("timestamp_ntz")})
    return a.replaced_stories(i, payload, DAY, DAY_AFTER, "2024-01-16 12:00:00")


@query("replace_stories", f"""SELECT (SELECT count(*) FROM incident WHERE {_GONE}) AS deleted, (SELECT bool_or(window_start < TIMESTAMP '2024-01-16 12:00:00' AND window_end >= TIMESTAMP '2024-01-15 12:00:00') FROM incident WHERE {_GONE}) AS live_overlap,
    (SELECT count(*) FROM incident WHERE story_id % 40 = 0 AND story_version = 'v1') AS accepted""", "incident")
def _(spark, d):
    return _story_replace(spark, d)[1]


@query("replace_survivors", f"""SELECT story_id, count(received_at) AS surviving, strftime(max(received_at), {_FORM}) AS last_received FROM (SELECT story_id FROM incident WHERE {_GONE} UNION SELECT story_id FROM incident WHERE story_id % 40 = 0)
    LEFT JOIN (SELECT story_id, received_at FROM incident WHERE NOT ({_GONE}) UNION ALL SELECT story_id, TIMESTAMP '2024-02-03' FROM incident WHERE story_id % 40 = 0 AND story_version = 'v1') USING (story_id) GROUP BY story_id""", "incident")
def _(spark, d):
    return _story_replace(spark, d)[2].withColumn("last_received", _stamp("last_received"))


@query("withdraw_kinds", """SELECT 'event' AS kind, count(*) FILTER (WHERE p_partkey IN (SELECT event_key FROM baseline)) AS withdrawn, count(*) FILTER (WHERE p_partkey NOT IN (SELECT event_key FROM baseline)) AS not_found, count(*) FILTER (WHERE p_partkey % 7 = 0) AS repeated FROM part
    UNION ALL SELECT 'story', count(*) FILTER (WHERE s_suppkey IN (SELECT o_orderkey FROM orders)), count(*) FILTER (WHERE s_suppkey NOT IN (SELECT o_orderkey FROM orders)), 0 FROM supplier""", "baseline")
def _(spark, d):
    p = v.table(spark, d, "part").select(F.col("p_partkey").alias("event_key"))
    tables = {"event": (v.baseline(spark, d), ["event_key"]), "story": (v.incident(spark, d), ["story_id"])}
    return a.withdrawals(tables, {"event": p.union(p.where("event_key % 7 = 0")), "story": v.table(spark, d, "supplier").select(F.col("s_suppkey").alias("story_id"))})


@query("withdraw_overlaps", "SELECT o_orderkey AS event_key FROM orders WHERE o_custkey % 9 = 0")
def _(spark, d):
    o = v.table(spark, d, "orders").select(F.col("o_custkey").alias("run_id"), F.col("o_orderkey").alias("event_key"))
    return a.overlapping_withdrawals(o.where("run_id % 9 = 0").select("run_id"), o).select("event_key")


@query("log_append", "SELECT count(*) + count(*) FILTER (WHERE id % 10 = 0) AS n, max(id) FILTER (WHERE id % 10 = 0) + 1000000 AS last FROM audit", "audit")
def _(spark, d):
    log = v.audit(spark, d)
    new = log.where("id % 10 = 0").withColumn("id", F.col("id") + 1000000).unionByName(log.where("id % 10 = 1"))
    return a.logged(log, new).agg(F.count("*").alias("n"), F.max("id").alias("last"))


@query("array_relation", """SELECT event_id, position, CASE position WHEN 1 THEN 'a' || event_id WHEN 2 THEN 'b' WHEN 3 THEN 'c' END AS name, CASE WHEN position <= event_id % 5 THEN 10 * event_id + position END AS n FROM events, range(1, 5) t(position)
    WHERE position <= greatest(3, event_id % 5)""")
def _(spark, d):
    rows = v.table(spark, d, "events").selectExpr("event_id", "array(concat('a', event_id), 'b', 'c') AS name", "CASE WHEN event_id % 5 > 0 THEN transform(sequence(1L, event_id % 5), i -> 10 * event_id + i) END AS n")
    return a.unnested(rows, ["event_id"], ["name", "n"])


ZONES = "zones AS (SELECT i AS customer_id, CASE WHEN i % 2 = 0 THEN 'UTC' ELSE 'Asia/Seoul' END AS zone, CASE WHEN i % 2 = 0 THEN 0 ELSE 9 END AS off FROM range(5) t(i))"
_UNITS = "(VALUES ('DAILY', 'day'), ('WEEKLY', 'week'), ('MONTHLY', 'month')) u(period, unit)"
LOCAL = f"""{ZONES}, local AS (SELECT customer_id, zone, period, CAST(date_trunc(unit, event_time + INTERVAL 1 HOUR * off) AS DATE) AS bucket, max(event_time) AS last_event, max(received_at) AS last_received, count(*) AS n FROM baseline JOIN zones USING (customer_id), {_UNITS} GROUP BY ALL)"""
_NEXT = "CASE period WHEN 'DAILY' THEN bucket + INTERVAL 1 DAY WHEN 'WEEKLY' THEN bucket + INTERVAL 7 DAY ELSE bucket + INTERVAL 1 MONTH END"
_END = f"({_NEXT} - INTERVAL 1 HOUR * CASE zone WHEN 'UTC' THEN 0 ELSE 9 END)"
_START = "(bucket - INTERVAL 1 HOUR * CASE zone WHEN 'UTC' THEN 0 ELSE 9 END)"
_BUCKET = "strftime(bucket, '%Y-%m-%d') AS bucket"
_day = lambda: F.col("bucket").cast("string").alias("bucket")


def _zones(spark):
    return spark.range(5).selectExpr("id AS customer_id", "CASE WHEN id % 2 = 0 THEN 'UTC' ELSE 'Asia/Seoul' END AS zone")


def _local(spark, d):
    return t.local_rollup(v.baseline(spark, d), _zones(spark))


@query("local_rollup", f", {LOCAL} SELECT customer_id, zone, period, {_BUCKET}, strftime(last_event, {_FORM}) AS last_event, n FROM local", "baseline")
def _(spark, d):
    return _local(spark, d).select("customer_id", "zone", "period", _day(), _stamp("last_event").alias("last_event"), "n")


STORIES = f"""{ZONES}, spans AS (SELECT story_id, customer_id, zone, period, unit, window_start + INTERVAL 1 HOUR * off AS s, window_end + INTERVAL 1 HOUR * off AS e FROM incident JOIN zones USING (customer_id), {_UNITS}),
    story_local AS (SELECT customer_id, zone, period, CAST(b AS DATE) AS bucket, count(DISTINCT story_id) AS stories FROM (SELECT *, unnest(generate_series(date_trunc(unit, s)::TIMESTAMP, date_trunc(unit, e)::TIMESTAMP, CASE period WHEN 'DAILY' THEN INTERVAL 1 DAY WHEN 'WEEKLY' THEN INTERVAL 7 DAY ELSE INTERVAL 1 MONTH END)) AS b FROM spans) WHERE e > b GROUP BY ALL)"""


@query("local_story_rollup", f", {STORIES} SELECT customer_id, zone, period, {_BUCKET}, stories FROM story_local", "incident")
def _(spark, d):
    return t.local_story_rollup(v.incident(spark, d), _zones(spark)).select("customer_id", "zone", "period", _day(), "stories")


@query("target_buckets", f""", {LOCAL} SELECT customer_id, strftime(day, '%Y-%m-%d') AS bucket, coalesce(n, 0) AS n FROM (SELECT customer_id, zone, CAST(unnest(generate_series(DATE '2023-12-28', DATE '2024-02-03', INTERVAL 1 DAY)) AS DATE) AS day FROM zones) LEFT JOIN (SELECT customer_id, bucket AS day, n FROM local WHERE period = 'DAILY') USING (customer_id, day)""", "baseline")
def _(spark, d):
    days = F.explode(F.sequence(F.lit("2023-12-28").cast("date"), F.lit("2024-02-03").cast("date")))
    return t.target_counts(_zones(spark).select("customer_id", "zone", F.lit("DAILY").alias("period"), days.alias("bucket")), _local(spark, d)).select("customer_id", _day(), "n")


def _states(spark, d):
    """States of the local buckets; status, cursor and quality by the day."""
    day = F.dayofyear("bucket")
    status = F.when(day % 5 == 0, "ready").when(day % 7 == 0, "archived").when(day % 11 == 0, "dirty").otherwise("pending")
    cursor = F.when(day % 4 == 0, F.lit("2024-01-20 15:00:00")).when(day % 4 == 1, F.lit("2024-01-10")).cast("timestamp_ntz")
    quality = F.when(day % 2 == 0, "strict").when(day % 4 == 1, "soft")
    return _local(spark, d).withColumns({"status": status, "cursor": cursor, "quality": quality, "updated_at": F.col("last_received")})


def _jobs(spark, d):
    """Jobs of buckets by the day: done, queued, or none."""
    day = F.dayofyear("bucket")
    return _local(spark, d).where(day % 3 < 2).select("customer_id", "zone", "period", "bucket", F.when(day % 3 == 0, "done").otherwise("queued").alias("job_status"))


STATE = f"""{LOCAL}, state AS (SELECT *, CASE WHEN dayofyear(bucket) % 5 = 0 THEN 'ready' WHEN dayofyear(bucket) % 7 = 0 THEN 'archived' WHEN dayofyear(bucket) % 11 = 0 THEN 'dirty' ELSE 'pending' END AS status,
    CASE dayofyear(bucket) % 4 WHEN 0 THEN TIMESTAMP '2024-01-20 15:00:00' WHEN 1 THEN TIMESTAMP '2024-01-10' END AS cursor_at, CASE WHEN dayofyear(bucket) % 2 = 0 THEN 'strict' WHEN dayofyear(bucket) % 4 = 1 THEN 'soft' END AS quality, dayofyear(bucket) % 3 = 0 AS worked FROM local)"""
_KEYS = ["customer_id", "zone", "period"]


@query("settled_buckets", f""", {STATE} SELECT customer_id, zone, period, {_BUCKET}, status = 'pending' AND last_received <= TIMESTAMP '2024-01-20 16:30:00' - INTERVAL 30 MINUTE AND ({_END} + INTERVAL 1 HOUR * CASE period WHEN 'DAILY' THEN 3 WHEN 'WEEKLY' THEN 6 ELSE 12 END <= TIMESTAMP '2024-01-20 16:30:00'
    OR coalesce(period = 'DAILY' AND quality = 'strict' AND cursor_at >= {_END} AND {_END} + INTERVAL 1 HOUR <= TIMESTAMP '2024-01-20 16:30:00', FALSE)) AS ready FROM state""", "baseline")
def _(spark, d):
    return t.settled(_states(spark, d), "2024-01-20 16:30:00").select(*_KEYS, _day(), "ready")


@query("late_activity", f""", {STATE} SELECT customer_id, zone, period, {_BUCKET}, CASE WHEN status = 'ready' AND worked AND dayofyear(bucket) % 2 = 0 THEN 'dirty' ELSE status END AS status,
    strftime(CASE WHEN dayofyear(bucket) % 2 = 0 AND status <> 'archived' THEN greatest(last_received, TIMESTAMP '2024-01-25') ELSE last_received END, {_FORM}) AS last_received FROM state""", "baseline")
def _(spark, d):
    late = _local(spark, d).where(F.dayofyear("bucket") % 2 == 0).withColumn("last_received", F.lit("2024-01-25").cast("timestamp_ntz"))
    return t.after_activity(_states(spark, d), late, _jobs(spark, d)).select(*_KEYS, _day(), "status", _stamp("last_received").alias("last_received"))


@query("replaced_envelope", f""", {STATE}, m AS (SELECT *, {_START} < TIMESTAMP '2024-01-20' AND {_END} > TIMESTAMP '2024-01-12 03:00:00' AND status <> 'archived' AND (status = 'pending' OR worked) AS met FROM state)
    SELECT customer_id, zone, period, {_BUCKET}, CASE WHEN met AND status IN ('ready', 'dirty') AND worked THEN 'dirty' ELSE status END AS status, CASE WHEN met THEN n + 1 ELSE 0 END AS events, CASE WHEN met THEN 7 ELSE 0 END AS stories FROM m""", "baseline")
def _(spark, d):
    local = _local(spark, d)
    states = _states(spark, d).drop("n").withColumns({"events": F.lit(0).cast("long"), "stories": F.lit(0)})
    out = t.dirtied(states, _jobs(spark, d), local.withColumn("n", F.col("n") + 1), local.withColumn("stories", F.lit(7)), "2024-01-12 03:00:00", "2024-01-20")
    return out.select(*_KEYS, _day(), "status", "events", "stories")


@query("reconciled_buckets", f""", {STATE} SELECT customer_id, zone, period, {_BUCKET}, CASE dayofyear(bucket) % 4 WHEN 0 THEN 'seed' WHEN 1 THEN 'archive' WHEN 2 THEN 'patch' ELSE 'keep' END AS action FROM state WHERE status <> 'archived' OR dayofyear(bucket) % 4 = 0""", "baseline")
def _(spark, d):
    day, keys = F.dayofyear("bucket"), [*_KEYS, "bucket"]
    states = _states(spark, d).where(day % 4 > 0).withColumn("n", F.col("n") - F.when(day % 4 == 2, 1).otherwise(0))
    return t.reconciled(_local(spark, d).where(day % 4 != 1), states, keys).select(*_KEYS, _day(), "action")


@query("zone_changes", f", {STATE} SELECT customer_id, count(*) FILTER (WHERE status = 'archived' OR customer_id = 1) AS archived FROM state GROUP BY customer_id", "baseline")
def _(spark, d):
    zones = _zones(spark).withColumn("zone", F.when(F.col("customer_id") == 1, "America/New_York").otherwise(F.col("zone")))
    return t.zone_changed(_states(spark, d), zones).groupBy("customer_id").agg(F.count_if(F.col("status") == "archived").alias("archived"))


@query("state_watermarks", f""", {STATE} SELECT customer_id, zone, period, {_BUCKET}, strftime(CASE WHEN customer_id = 4 THEN cursor_at WHEN cursor_at > TIMESTAMP '2024-01-10' THEN cursor_at ELSE TIMESTAMP '2024-01-10' END, {_FORM}) AS reached,
    CASE WHEN customer_id = 4 THEN CASE WHEN cursor_at IS NOT NULL THEN quality END WHEN cursor_at > TIMESTAMP '2024-01-10' THEN quality ELSE 'strict' END AS quality FROM state""", "baseline")
def _(spark, d):
    marks = spark.range(4).select(F.col("id").alias("customer_id"), F.lit("2024-01-10").cast("timestamp_ntz").alias("at"), F.lit("strict").alias("quality"))
    return t.watermarked(_states(spark, d), marks).select(*_KEYS, _day(), _stamp("cursor").alias("reached"), "quality")


@query("state_order", f", {STATE} SELECT customer_id, zone, period, {_BUCKET} FROM state ORDER BY bucket DESC, zone, customer_id, period LIMIT 20", "baseline")
def _(spark, d):
    return t.ordered_states(_states(spark, d)).orderBy(F.when(F.col("period") == "LIVE", 0).otherwise(1), F.desc("bucket"), "zone", "customer_id", "period").limit(20).select(*_KEYS, _day())


@query("live_states", f"SELECT customer_id, 'LIVE' AS period, '1970-01-01' AS bucket, 'ready' AS status, strftime(max(event_time), {_FORM}) AS last_event FROM baseline WHERE event_time >= TIMESTAMP '{NOW}' - INTERVAL 24 HOUR AND event_time < TIMESTAMP '{NOW}' GROUP BY customer_id", "baseline")
def _(spark, d):
    return t.live_state(v.baseline(spark, d), NOW).select("customer_id", "period", _day(), "status", _stamp("last_event").alias("last_event"))


@query("live_stories", "SELECT story_id, story_version FROM incident WHERE window_start < TIMESTAMP '2024-01-16 12:00:00' AND window_end >= TIMESTAMP '2024-01-15 12:00:00'", "incident")
def _(spark, d):
    return v.incident(spark, d).where(a.live_overlap("window_start", "window_end", "2024-01-16 12:00:00")).select("story_id", "story_version")


def _story_states(spark, d):
    o = v.table(spark, d, "orders")
    k = F.col("o_orderkey")
    status = F.when(k % 4 == 0, "pending").when(k % 4 == 1, "ready").when(k % 4 == 2, "archived").otherwise("dirty")
    old = F.lit("2024-01-05").cast("timestamp_ntz")
    return o.where(k % 5 > 0).select((F.col("o_custkey") % 5).alias("customer_id"), k.alias("story_id"), status.alias("status"), old.alias("first_member"), old.alias("last_member"))


@query("story_arrivals", f"""SELECT story_id, CASE WHEN story_id % 5 = 0 OR (story_id % 4 = 2 AND story_id % 3 = 0) THEN 'pending' WHEN story_id % 4 = 0 THEN 'pending' WHEN story_id % 4 = 1 THEN CASE WHEN story_id % 6 = 3 THEN 'dirty' ELSE 'ready' END WHEN story_id % 4 = 2 THEN 'archived' ELSE 'dirty' END AS status,
    strftime(CASE WHEN story_id % 5 = 0 THEN TIMESTAMP '2024-01-09' WHEN story_id % 4 = 2 AND story_id % 3 = 0 THEN NULL WHEN story_id % 3 = 0 THEN TIMESTAMP '2024-01-09' ELSE TIMESTAMP '2024-01-05' END, {_FORM}) AS last_member FROM (SELECT o_orderkey AS story_id FROM orders) WHERE story_id % 5 > 0 OR story_id % 3 = 0""")
def _(spark, d):
    arrivals = v.table(spark, d, "orders").where("o_orderkey % 3 = 0").select((F.col("o_custkey") % 5).alias("customer_id"), F.col("o_orderkey").alias("story_id"), F.lit("2024-01-09").cast("timestamp_ntz").alias("arrived_at"))
    jobs = arrivals.where("story_id % 2 = 1").select("customer_id", "story_id", F.lit("done").alias("job_status"))
    return t.after_member(_story_states(spark, d), arrivals, jobs).select("story_id", "status", _stamp("last_member").alias("last_member"))


@query("story_archive", "SELECT o_orderkey AS story_id, CASE WHEN o_orderkey % 3 = 0 THEN 'archived' WHEN o_orderkey % 4 = 2 AND o_orderkey % 3 = 1 THEN 'pending' ELSE ['pending', 'ready', 'archived', 'dirty'][o_orderkey % 4 + 1] END AS status FROM orders WHERE o_orderkey % 5 > 0")
def _(spark, d):
    left = v.table(spark, d, "orders").where("o_orderkey % 3 < 2").selectExpr("o_orderkey AS story_id", "o_orderkey % 3 AS surviving")
    return t.archived(_story_states(spark, d), left).select("story_id", "status")


@query("story_orphans", "SELECT o_orderkey AS story_id FROM orders WHERE o_orderkey % 5 > 0 AND o_orderkey % 4 <> 2 AND o_orderkey % 7 = 0")
def _(spark, d):
    return t.orphaned(_story_states(spark, d), v.incident(spark, d).where("story_id % 7 > 0")).select("story_id")


@query("story_buckets", """SELECT DISTINCT customer_id, period, strftime(date_trunc(unit, edge), '%Y-%m-%d') AS bucket FROM (SELECT customer_id, window_start AS edge FROM incident UNION ALL SELECT customer_id, window_end FROM incident), (VALUES ('DAILY', 'day'), ('WEEKLY', 'week'), ('MONTHLY', 'month')) u(period, unit)""", "incident")
def _(spark, d):
    return t.story_buckets(v.incident(spark, d)).select("customer_id", "period", _day())


@query("live_jobs_due", f"""SELECT c_custkey AS customer_id, CASE WHEN c_custkey % 60 < 50 THEN 'queued' ELSE 'capped' END AS action, CASE WHEN c_custkey % 60 < 50 THEN c_custkey % 60 + 1 ELSE c_custkey % 60 END AS generation FROM customer WHERE c_custkey % 2 = 0 AND c_custkey % 3 > 0 AND c_custkey % 7 > 1 AND c_custkey % 11 > 0""")
def _(spark, d):
    k = F.col("c_custkey")
    c = v.table(spark, d, "customer").select(k.alias("customer_id"), F.lit("UTC").alias("zone"), F.lit("LIVE").alias("period"), F.when(k % 2 == 0, "done").otherwise("queued").alias("job_status"), (k % 3 == 0).alias("dry_run"), (k % 60).alias("generation"),
                                             F.when(k % 7 == 0, F.lit("2024-03-01")).when(k % 7 > 1, F.lit(DAY)).cast("timestamp_ntz").alias("next_due"), F.when(k % 11 == 0, "dirty").otherwise("ready").alias("status"))
    return t.live_jobs(c.drop("status"), c.select("customer_id", "zone", "status"), NOW).select("customer_id", "action", "generation")


@query("held_events", f"""SELECT event_id, CASE WHEN event_id % 11 = 0 THEN 'tier_a' WHEN event_id % 3 = 1 THEN 'tier_b' WHEN event_id % 8 >= 5 OR ts <= TIMESTAMP '{DAY}' - INTERVAL 600 MINUTE THEN 'fallback' ELSE 'held' END AS tier FROM events""")
def _(spark, d):
    k = F.col("event_id")
    jobs = v.table(spark, d, "events").select("event_id", (k % 11 == 0).alias("hit"), F.when(k % 3 > 0, "complete").otherwise("failed").alias("run"), F.when(k % 3 == 1, "complete").otherwise("stale").alias("coverage"), (k % 8).alias("attempts"), F.col("ts").alias("created_at"))
    return t.held_jobs(jobs, DAY, 6, 600).select("event_id", "tier")


_LEAF = "SELECT o_orderkey AS story_id, o_custkey % 5 AS customer_id, ['pending', 'ready', 'archived', 'dirty'][o_orderkey % 4 + 1] AS state, CASE o_orderkey % 6 WHEN 0 THEN NULL WHEN 1 THEN 'failed' WHEN 2 THEN 'queued' WHEN 3 THEN 'processing' ELSE 'done' END AS target, o_orderkey % 9 > 0 AS alive, o_orderdate FROM orders"


def _leaves(spark, d):
    o, k = v.table(spark, d, "orders"), F.col("o_orderkey")
    state = F.get(F.array(*map(F.lit, ("pending", "ready", "archived", "dirty"))), (k % 4).cast("int"))
    target = F.when(k % 6 == 1, "failed").when(k % 6 == 2, "queued").when(k % 6 == 3, "processing").when(k % 6 > 3, "done")
    return o.select(k.alias("story_id"), (F.col("o_custkey") % 5).alias("customer_id"), state.alias("state"), target.alias("target"), (k % 9 > 0).alias("alive"), F.col("o_orderdate").alias("window_start"), F.lit("EN").alias("language"))


@query("story_backfill", f"""SELECT customer_id, class, count(*) AS n FROM (SELECT customer_id, CASE WHEN c IN ('seeded', 'requeued') AND row_number() OVER (PARTITION BY customer_id, c IN ('seeded', 'requeued') ORDER BY o_orderdate DESC, story_id) > 100 THEN 'cap_excluded' ELSE c END AS class FROM (
    SELECT *, CASE WHEN state = 'archived' OR NOT alive THEN 'source_unavailable' WHEN state = 'dirty' THEN 'skipped_dirty' WHEN target IS NULL THEN 'seeded' WHEN target = 'failed' THEN 'requeued' ELSE 'coalesced' END AS c FROM ({_LEAF}))) GROUP BY customer_id, class""")
def _(spark, d):
    rows = _leaves(spark, d)
    return t.story_plan(rows.withColumn("class", t.enqueue_class(F.col("state"), F.col("target"), F.col("alive"))), 100)


@query("story_drain", f"""SELECT customer_id, count(*) AS total, count(*) FILTER (WHERE state = 'dirty' OR target IS NULL OR target <> 'done') AS outstanding, FALSE AS drained FROM ({_LEAF}) WHERE state <> 'archived' AND alive GROUP BY customer_id""")
def _(spark, d):
    rows = _leaves(spark, d)
    return t.drain_signal(rows.withColumn("class", t.drain_class(F.col("state"), F.col("target"), F.col("alive"))))


@query("audit_purge", "SELECT count(*) AS n FROM audit WHERE NOT (ip = 3 AND logged_at < TIMESTAMP '2024-01-24')", "audit")
def _(spark, d):
    log = v.audit(spark, d).withColumn("ip", F.nullif("ip", F.lit(3)))
    return t.purged(log, NOW, 7).agg(F.count("*").alias("n"))


@query("group_managers", """WITH g AS (SELECT account, customer_id, min(granted) AS granted FROM (SELECT o_custkey % 60 AS account, o_orderkey % 5 AS customer_id, o_orderkey AS granted FROM orders WHERE o_orderkey % 13 = 0 AND o_custkey % 4 > 0) GROUP BY 1, 2)
    SELECT group_id, account, max(granted) AS since FROM g JOIN (SELECT i AS customer_id, i % 2 AS group_id FROM range(5) t(i)) USING (customer_id) GROUP BY group_id, account HAVING count(*) = CASE group_id WHEN 0 THEN 3 ELSE 2 END""")
def _(spark, d):
    grants = v.table(spark, d, "orders").where("o_orderkey % 13 = 0").selectExpr("o_custkey % 60 AS account", "o_orderkey % 5 AS customer_id", "o_orderkey AS granted_at", "o_custkey % 4 > 0 AS active")
    return t.qualifying_managers(spark.range(5).selectExpr("id AS customer_id", "id % 2 AS group_id"), grants)


@query("retention_sweep", "SELECT count(*) AS parents, (SELECT count(*) FROM lineitem WHERE l_orderkey IN (SELECT o_orderkey FROM orders WHERE o_orderdate < TIMESTAMP '1998-01-01' - INTERVAL 365 DAY)) AS children FROM orders WHERE o_orderdate < TIMESTAMP '1998-01-01' - INTERVAL 365 DAY")
def _(spark, d):
    stories = v.table(spark, d, "orders").select(F.col("o_orderkey").alias("story_id"), "o_orderdate")
    return t.swept(stories, v.member(spark, d), "story_id", "o_orderdate", "1998-01-01", 365)
