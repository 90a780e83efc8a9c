"""Queries of snapshots, maintained aggregates, retention and states. Importing this registers them."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import functions as F

from quarryline.functions.storage import folder
from quarryline.operators import retention as r
from quarryline.plans.catalog import query
from quarryline.plans.tracking import LOCAL
from quarryline.sources import views as v
from quarryline.sources.snapshots import Snapshots
from quarryline.streaming import maintained as m
from quarryline.streaming import states as t


@query("snapshot_replaced", """SELECT source, count(*) AS n, min(key) AS low, max(key) AS high FROM (SELECT 's' || p_partkey % 3 AS source, p_partkey AS key FROM part WHERE p_partkey % 3 <> 1
    UNION ALL SELECT 's1', s_suppkey FROM supplier) GROUP BY source""")
def _(spark, d):
    store = Snapshots(spark, folder(spark, "snapshots"))
    key = "p_partkey"
    store.replace({"feed": v.table(spark, d, "part").select(F.concat(F.lit("s"), (F.col(key) % 3).cast("string")).alias("source"), F.col(key).alias("key"))})
    store.replace_where("feed", F.col("source") == "s1", v.table(spark, d, "supplier").select(F.lit("s1").alias("source"), F.col("s_suppkey").alias("key")))
    return store.read("feed").groupBy("source").agg(F.count("*").alias("n"), F.min("key").alias("low"), F.max("key").alias("high"))


_CHANGES = """SELECT l_orderkey AS key, l_linenumber AS version, l_orderkey % 11 = 0 AND l_linenumber = 4 AS gone, CAST(l_shipdate AS DATE) AS bucket, l_suppkey % 5 AS customer_id FROM lineitem"""


@query("maintained_totals", f"""SELECT customer_id, strftime(bucket, '%Y-%m-%d') AS bucket, count(*) AS n FROM (SELECT *, row_number() OVER (PARTITION BY key ORDER BY version DESC, gone DESC, customer_id DESC, bucket DESC) AS rn FROM ({_CHANGES})) WHERE rn = 1 AND NOT gone GROUP BY ALL""")
def _(spark, d):
    rows = v.table(spark, d, "lineitem").select(
        F.col("l_orderkey").alias("key"), F.col("l_linenumber").alias("version"), ((F.col("l_orderkey") % 11 == 0) & (F.col("l_linenumber") == 4)).alias("gone"), (F.col("l_suppkey") % 5).alias("customer_id"), F.to_date("l_shipdate").alias("bucket")
    )
    # Three batches out of order, the second of them twice.
    work = m.upsert(store := Snapshots(spark, folder(spark, "totals")), ["key"], ["version"], ["customer_id", "bucket"])
    for number, part in enumerate((1, 0, 0, 2)):
        work(rows.where(F.pmod(F.hash("key", "version"), F.lit(3)) == part), number)
    return store.read("totals").select("customer_id", F.col("bucket").cast("string").alias("bucket"), "n")


_NOW, _BUCKET_NOW = "2024-02-20 00:00:00", "2024-01-23 12:00:00"
RULES = (
    r.Rule("redaction_map", kept_by=(("baseline", ("sensor", "event_key")), ("result", ("sensor", "event_key")), ("member", ("sensor", "event_key")))),
    r.Rule("member", parents=(("incident", ("story_id", "story_version")),)),
    r.Rule("baseline", age=("received_at", "ingestion_days")),
    r.Rule("incident", age=("window_start", "ingestion_days")),
    r.Rule("result", age=("event_time", "analysis_days")),
)
_OLD = "{} < TIMESTAMP '" + _NOW + "' - INTERVAL 1 DAY * {}"
_SWEPT = f""", policy AS (SELECT i AS customer_id, 30 + 5 * i AS ingestion_days, CASE WHEN i = 3 THEN NULL ELSE 25 + 4 * i END AS analysis_days FROM range(4) t(i)),
    b AS (SELECT x.*, coalesce({_OLD.format("received_at", "ingestion_days")}, FALSE) AS goes FROM baseline x LEFT JOIN policy USING (customer_id)), i AS (SELECT x.*, coalesce({_OLD.format("window_start", "ingestion_days")}, FALSE) AS goes FROM incident x LEFT JOIN policy USING (customer_id)),
    s AS (SELECT x.*, coalesce({_OLD.format("event_time", "analysis_days")}, FALSE) AS goes FROM result x LEFT JOIN policy USING (customer_id)),
    m AS (SELECT x.story_id, x.story_version, x.sensor, x.member_key AS event_key, p.customer_id, p.goes FROM report_member x JOIN i p USING (story_id, story_version)),
    rm AS (SELECT customer_id, sensor, event_key, NOT (EXISTS (SELECT 1 FROM b WHERE NOT goes AND b.sensor = e.sensor AND b.event_key = e.event_key) OR EXISTS (SELECT 1 FROM s WHERE NOT goes AND s.sensor = e.sensor AND s.event_key = e.event_key)
        OR EXISTS (SELECT 1 FROM m WHERE NOT goes AND m.sensor = e.sensor AND m.event_key = e.event_key)) AS goes FROM (SELECT user_id % 5 AS customer_id, user_id % 7 AS sensor, event_id AS event_key FROM events) e),
    every AS (SELECT 'baseline' AS table_name, customer_id, goes FROM b UNION ALL SELECT 'incident', customer_id, goes FROM i UNION ALL SELECT 'result', customer_id, goes FROM s UNION ALL SELECT 'member', customer_id, goes FROM m UNION ALL SELECT 'redaction_map', customer_id, goes FROM rm)"""


def _sweep(spark, d):
    incident = v.incident(spark, d)
    members = v.report_member(spark, d).withColumnRenamed("member_key", "event_key").join(incident.select("story_id", "story_version", "customer_id"), ["story_id", "story_version"])
    maps = v.table(spark, d, "events").select((F.col("user_id") % 5).alias("customer_id"), (F.col("user_id") % 7).alias("sensor"), F.col("event_id").alias("event_key"))
    days = F.col("id").cast("int")
    policies = spark.range(4).select(F.col("id").alias("customer_id"), (30 + 5 * days).alias("ingestion_days"), F.when(days != 3, 25 + 4 * days).alias("analysis_days"))
    return r.sweep({"baseline": v.baseline(spark, d), "incident": incident, "result": v.result(spark, d), "member": members, "redaction_map": maps}, RULES, policies, _NOW)


@query("retention_cascade", f"{_SWEPT} SELECT table_name, customer_id, count(*) AS rows FROM every WHERE goes GROUP BY ALL", "baseline", "incident", "result", "report_member")
def _(spark, d):
    return _sweep(spark, d)[1]


@query("retention_survivors", f"{_SWEPT} SELECT table_name, customer_id, count(*) AS rows FROM every WHERE NOT goes GROUP BY ALL", "baseline", "incident", "result", "report_member")
def _(spark, d):
    left, _ = _sweep(spark, d)
    return reduce(lambda a, b: a.unionByName(b), (t.groupBy("customer_id").agg(F.count("*").alias("rows")).select(F.lit(n).alias("table_name"), "customer_id", "rows") for n, t in left.items()))


@query("story_states", """WITH item AS (SELECT l_orderkey AS story_id, l_linenumber AS id, max(l_shipdate) AS moment FROM lineitem GROUP BY ALL), t AS (SELECT o_orderkey AS story_id, CASE WHEN o_orderkey % 2 = 0 THEN o_orderdate + INTERVAL 60 DAY END AS job, CASE WHEN o_orderkey % 5 = 0 THEN o_orderdate + INTERVAL 30 DAY END AS gone,
        CASE WHEN o_orderkey % 10 = 0 THEN o_orderdate + INTERVAL 40 DAY END AS back FROM orders),
    live AS (SELECT story_id, min(moment) AS first, max(moment) AS last FROM item JOIN t USING (story_id) WHERE gone IS NULL OR moment > gone GROUP BY story_id)
    SELECT story_id, CASE WHEN gone IS NOT NULL AND coalesce(greatest(last, back) <= gone, TRUE) THEN 'archived' WHEN job IS NOT NULL AND (gone IS NULL OR job > gone) AND last > job THEN 'dirty' WHEN job IS NOT NULL AND (gone IS NULL OR job > gone) THEN 'ready'
        WHEN least(last + INTERVAL 15 MINUTE, first + INTERVAL 6 HOUR) <= TIMESTAMP '1997-06-01' THEN 'ready' ELSE 'pending' END AS status, strftime(first, '%Y-%m-%d') AS first, strftime(last, '%Y-%m-%d') AS last
    FROM t LEFT JOIN live USING (story_id) WHERE story_id IN (SELECT story_id FROM item) OR job IS NOT NULL OR gone IS NOT NULL""")
def _(spark, d):
    stamp = lambda c: F.col(c).cast("timestamp")
    items = v.table(spark, d, "lineitem").select(F.col("l_orderkey").alias("story_id"), F.lit("item").alias("kind"), F.col("l_linenumber").cast("string").alias("id"), stamp("l_shipdate").alias("at"))
    o, key = v.table(spark, d, "orders"), F.col("o_orderkey")
    after = lambda kind, days, when: o.where(when).select(key.alias("story_id"), F.lit(kind).alias("kind"), F.lit("").alias("id"), (stamp("o_orderdate") + F.make_dt_interval(days=F.lit(days))).alias("at"))
    changes = items.unionByName(after("job", 60, key % 2 == 0)).unionByName(after("gone", 30, key % 5 == 0)).unionByName(after("back", 40, key % 10 == 0))
    out = t.batched(changes, ["story_id"], True, F.lit("1997-06-01").cast("timestamp"))
    return out.select("story_id", "status", F.date_format("first", "yyyy-MM-dd").alias("first"), F.date_format("last", "yyyy-MM-dd").alias("last"))


_SETTLED = "CASE period WHEN 'DAILY' THEN bucket + INTERVAL 1 DAY + INTERVAL 3 HOUR WHEN 'WEEKLY' THEN bucket + INTERVAL 7 DAY + INTERVAL 6 HOUR ELSE bucket + INTERVAL 1 MONTH + INTERVAL 12 HOUR END - INTERVAL 1 HOUR * CASE zone WHEN 'UTC' THEN 0 ELSE 9 END"


@query("bucket_states", f""", {LOCAL}, j AS (SELECT *, CASE WHEN day(bucket) % 2 = 0 THEN {_SETTLED} END AS job, CASE WHEN day(bucket) % 5 = 0 THEN TIMESTAMP '2024-06-01' END AS gone, {_SETTLED} AS settle FROM local)
    SELECT customer_id, zone, period, strftime(bucket, '%Y-%m-%d') AS bucket, CASE WHEN gone IS NOT NULL THEN 'archived' WHEN job IS NOT NULL AND last_received > job THEN 'dirty' WHEN job IS NOT NULL THEN 'ready'
        WHEN greatest(last_received + INTERVAL 30 MINUTE, settle) <= TIMESTAMP '{_BUCKET_NOW}' THEN 'ready' ELSE 'pending' END AS status FROM j""", "baseline")
def _(spark, d):
    zones = spark.range(5).selectExpr("id AS customer_id", "CASE WHEN id % 2 = 0 THEN 'UTC' ELSE 'Asia/Seoul' END AS zone")
    items = t.bucket_changes(v.baseline(spark, d).withColumnRenamed("baseline_version", "version"), zones)
    buckets = items.select(*t.BUCKET_KEYS, "settle").distinct()
    more = lambda kind, at, when: buckets.where(when).select(*t.BUCKET_KEYS, F.lit(kind).alias("kind"), F.lit("").alias("id"), at.alias("at"), "settle")
    day = F.dayofmonth("bucket")
    changes = items.unionByName(more("job", F.col("settle"), day % 2 == 0)).unionByName(more("gone", F.lit("2024-06-01").cast("timestamp"), day % 5 == 0))
    out = t.batched(changes, t.BUCKET_KEYS, False, F.lit(_BUCKET_NOW).cast("timestamp"))
    return out.select(*(F.col(c).cast("string").alias(c) if c == "bucket" else c for c in t.BUCKET_KEYS), "status")
