"""The catalog of queries: each operator on the domain views, with its SQL oracle."""

from __future__ import annotations

from pyspark.sql import functions as F

from quarryline.functions import semantics as s
from quarryline.operators import activity as a
from quarryline.operators import audit as u
from quarryline.operators import intel as i
from quarryline.operators import lineage as g
from quarryline.operators import report as r
from quarryline.sources import views as v

FLAGSHIP = "periodic_report"
QUERIES: dict = {}
ORACLE_SQL: dict[str, str] = {}

#: The clock and the windows that the catalog's queries use.
NOW, DAY_BEFORE, DAY, DAY_AFTER = "2024-01-31 00:00:00", "2024-01-14 00:00:00", "2024-01-15 00:00:00", "2024-01-16 00:00:00"
IN_DAY = f"event_time >= TIMESTAMP '{DAY}' AND event_time < TIMESTAMP '{DAY_AFTER}'"
LIVE = "live AS (SELECT * EXCLUDE (rn) FROM (SELECT *, row_number() OVER (PARTITION BY sensor, event_key ORDER BY generation DESC) AS rn FROM result WHERE NOT superseded) WHERE rn = 1)"
RANK = "CASE tier WHEN 'LOW' THEN 0 WHEN 'MEDIUM' THEN 1 WHEN 'HIGH' THEN 2 ELSE 3 END"
TECH = "(SELECT ['T1003', 'T1021', 'T1046', 'T1059', 'T1071', 'T1110'])"


def query(name: str, sql: str | None, *views: str):
    """Registers a query and its oracle, which starts from the named views."""

    def add(f):
        QUERIES[name] = f
        if sql is not None:
            ORACLE_SQL[name] = v.with_views(sql, *views) if views else sql
        return f

    return add


def _latest(spark, d):
    return s.latest_baseline(v.baseline(spark, d))


def _latest_in(spark, d, start=DAY_BEFORE, end=DAY_AFTER):
    return s.latest_within(v.baseline(spark, d), start, end)


def _live(spark, d):
    return s.live(v.result(spark, d))


def _text(column: str, form: str = "yyyy-MM-dd HH:mm:ss") -> F.Column:
    return F.date_format(column, form).alias(column)


def with_live(sql: str) -> str:
    return f", {LIVE} {sql}"


@query("baseline_latest", "SELECT sensor, count(*) AS n, sum(event_key) AS keys, count(*) FILTER (WHERE baseline_version = 'v2') AS second FROM latest GROUP BY sensor", "latest")
def _(spark, d):
    return _latest(spark, d).groupBy("sensor").agg(F.count("*").alias("n"), F.sum("event_key").alias("keys"), F.count_if(F.col("baseline_version") == "v2").alias("second"))


@query("category_counts", f"SELECT category, count(*) AS n FROM latest WHERE {IN_DAY} GROUP BY category", "latest")
def _(spark, d):
    return r.category_counts(_latest_in(spark, d), DAY, DAY_AFTER)


DRIFT = f"""SELECT category, count(*) FILTER (WHERE {IN_DAY}) AS current_n, count(*) FILTER (WHERE NOT ({IN_DAY})) AS previous_n FROM latest
    WHERE event_time >= TIMESTAMP '{DAY_BEFORE}' AND event_time < TIMESTAMP '{DAY_AFTER}' GROUP BY category"""


@query("baseline_drift", f"SELECT *, (current_n - previous_n) / greatest(previous_n, 1) AS delta FROM ({DRIFT})", "latest")
def _(spark, d):
    return r.drift(_latest_in(spark, d), DAY_BEFORE, DAY, DAY_AFTER)


@query("drift_scores", f"""SELECT CASE WHEN sum(previous_n) = 0 THEN 0.0::DOUBLE ELSE least(1.0::DOUBLE, max(abs(current_n - previous_n)) / greatest(sum(previous_n), 1)) END AS severity,
    CASE WHEN sum(previous_n) > 0 AND max(abs((current_n - previous_n) / greatest(previous_n, 1))) > 0.3 THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END AS likelihood FROM ({DRIFT})""", "latest")
def _(spark, d):
    return r.drift_scores(_latest_in(spark, d), DAY_BEFORE, DAY, DAY_AFTER)


@query("window_totals", f"SELECT count(*) AS events, count(DISTINCT primary_asset) AS assets FROM latest WHERE {IN_DAY}", "latest")
def _(spark, d):
    return r.window_totals(_latest_in(spark, d), DAY, DAY_AFTER)


@query("top_sensors", f"SELECT sensor, count(*) AS n FROM latest WHERE {IN_DAY} GROUP BY sensor ORDER BY n DESC, sensor LIMIT 5", "latest")
def _(spark, d):
    return r.top_sensors(_latest_in(spark, d), DAY, DAY_AFTER, 5)


@query("story_overlap_count", "SELECT count(*) AS stories FROM canonical WHERE window_start < TIMESTAMP '1997-02-01' AND window_end > TIMESTAMP '1997-01-01'", "canonical")
def _(spark, d):
    return r.story_overlap_count(s.canonical_story(v.story(spark, d)), "1997-01-01 00:00:00", "1997-02-01 00:00:00")


@query("canonical_stories", "SELECT story_id, story_version, strftime(window_start, '%Y-%m-%d %H:%M:%S') AS window_start, strftime(window_end, '%Y-%m-%d %H:%M:%S') AS window_end FROM canonical", "canonical")
def _(spark, d):
    return s.canonical_story(v.story(spark, d)).select("story_id", "story_version", _text("window_start"), _text("window_end"))


TAGS = f"SELECT {TECH}[tag_a + 1] AS technique FROM live UNION ALL SELECT {TECH}[tag_b + 1] FROM live"


@query("top_techniques", with_live(f"SELECT technique, count(*) AS n FROM ({TAGS}) GROUP BY technique ORDER BY n DESC, technique LIMIT 4"), "result")
def _(spark, d):
    return r.top_techniques(_live(spark, d), 4)


@query("tier_distribution", with_live(f"SELECT tier, count(*) AS n, {RANK} AS rank FROM live GROUP BY tier"), "result")
def _(spark, d):
    return r.tier_distribution(_live(spark, d))


@query("covered_members", "SELECT DISTINCT member_key AS event_key FROM member WHERE story_id IN (SELECT story_id FROM canonical WHERE window_start < TIMESTAMP '1997-01-03' AND window_end > TIMESTAMP '1997-01-01')", "canonical", "member")
def _(spark, d):
    stories = s.canonical_story(v.story(spark, d)).where(s.overlaps("window_start", "window_end", "1997-01-01 00:00:00", "1997-01-03 00:00:00"))
    return r.covered_members(stories, v.member(spark, d))


@query("top_events", with_live(f"""SELECT event_key, sensor, tier, severity, likelihood FROM live WHERE tier <> 'LOW' AND event_key NOT IN
    (SELECT member_key FROM member WHERE story_id IN (SELECT story_id FROM canonical ORDER BY window_end DESC, story_id LIMIT 5)) ORDER BY {RANK} DESC, severity + likelihood DESC, sensor, event_key LIMIT 10"""), "canonical", "member", "result")
def _(spark, d):
    stories = s.canonical_story(v.story(spark, d)).orderBy(F.desc("window_end"), "story_id").limit(5)
    return r.top_events(_live(spark, d), r.covered_members(stories, v.member(spark, d)), 10)


@query("exemplar_clusters", with_live(f"""SELECT technique, n, tier_rank, event_key FROM (
    SELECT technique, count(*) OVER (PARTITION BY technique) AS n, tier_rank, event_key, row_number() OVER (PARTITION BY technique ORDER BY tier_rank DESC, score DESC, event_key) AS rn FROM (
        SELECT DISTINCT technique, event_key, sensor, {RANK} AS tier_rank, severity + likelihood AS score FROM
            (SELECT *, {TECH}[tag_a + 1] AS technique FROM live UNION ALL SELECT *, {TECH}[tag_b + 1] FROM live)))
    WHERE rn = 1 ORDER BY tier_rank DESC, n DESC, technique LIMIT 10"""), "result")
def _(spark, d):
    return r.exemplar_clusters(_live(spark, d), 10)


@query("group_rollup", "SELECT category, count(*) AS n, count(DISTINCT (customer_id, primary_asset)) AS assets FROM latest GROUP BY category", "latest")
def _(spark, d):
    return r.group_rollup(_latest(spark, d))


@query("overview_events", with_live(f"""SELECT customer_id, event_key, tier, severity, likelihood FROM live WHERE event_time >= TIMESTAMP '{DAY}'
    ORDER BY {RANK} DESC, severity DESC, likelihood DESC, event_time DESC, event_key LIMIT 25"""), "result")
def _(spark, d):
    return r.overview(_live(spark, d), DAY, 25)


@query("event_page_keyset", with_live("""SELECT event_key, sensor, severity, likelihood FROM live
    WHERE severity < 90 OR (severity = 90 AND likelihood < 50) OR (severity = 90 AND likelihood = 50 AND event_key > 100) ORDER BY severity DESC, likelihood DESC, event_key LIMIT 25"""), "result")
def _(spark, d):
    return s.page(_live(spark, d), [("severity", True), ("likelihood", True), ("event_key", False)], [90, 50, 100], 25).select("event_key", "sensor", "severity", "likelihood")


@query("story_page_keyset", """SELECT story_id, story_version FROM canonical WHERE window_start < TIMESTAMP '1997-01-01' OR (window_start = TIMESTAMP '1997-01-01' AND story_id > 5)
    ORDER BY window_start DESC, story_id LIMIT 25""", "canonical")
def _(spark, d):
    cursor = [F.lit("1997-01-01 00:00:00").cast("timestamp_ntz"), 5]
    return s.page(s.canonical_story(v.story(spark, d)), [("window_start", True), ("story_id", False)], cursor, 25).select("story_id", "story_version")


@query("compare_models", with_live("SELECT model, tier, count(*) AS n, max(severity) AS max_severity, max(likelihood) AS max_likelihood FROM live GROUP BY model, tier"), "result")
def _(spark, d):
    return r.compare_models(_live(spark, d))


@query("likelihood_floor", with_live("""SELECT event_key, sensor, greatest(likelihood, CASE WHEN event_key % 37 = 0 THEN 95 ELSE 0 END, CASE WHEN coalesce(m, 0) >= 5 THEN 70 ELSE 0 END) AS likelihood
    FROM live LEFT JOIN (SELECT member_key, count(*) AS m FROM member GROUP BY member_key) ON member_key = event_key"""), "member", "result")
def _(spark, d):
    hits = v.baseline(spark, d).where("event_key % 37 = 0").select("event_key")
    return r.likelihood_floors(_live(spark, d), hits, v.member(spark, d))


ROLLUP = """rollup AS (SELECT customer_id, period, bucket, max(event_time) AS last_event, max(received_at) AS last_received, count(*) AS n FROM (
    SELECT *, 'DAILY' AS period, CAST(date_trunc('day', event_time) AS DATE) AS bucket FROM baseline
    UNION ALL SELECT *, 'WEEKLY', CAST(date_trunc('week', event_time) AS DATE) FROM baseline
    UNION ALL SELECT *, 'MONTHLY', CAST(date_trunc('month', event_time) AS DATE) FROM baseline) GROUP BY customer_id, period, bucket)"""


@query("bucket_rollup", f", {ROLLUP} SELECT customer_id, period, strftime(bucket, '%Y-%m-%d') AS bucket, strftime(last_event, '%Y-%m-%d %H:%M:%S') AS last_event, strftime(last_received, '%Y-%m-%d %H:%M:%S') AS last_received, n FROM rollup", "baseline")
def _(spark, d):
    return a.bucket_rollup(v.baseline(spark, d)).select("customer_id", "period", F.col("bucket").cast("string").alias("bucket"), _text("last_event"), _text("last_received"), "n")


@query("bucket_local", """SELECT strftime(date_trunc('day', event_time - INTERVAL 5 HOUR), '%Y-%m-%d') AS bucket, count(*) AS n FROM baseline GROUP BY 1""", "baseline")
def _(spark, d):
    return v.baseline(spark, d).groupBy(s.local_bucket("event_time", "day", "America/New_York").cast("string").alias("bucket")).agg(F.count("*").alias("n"))


@query("bucket_story_rollup", """SELECT customer_id, strftime(bucket, '%Y-%m-%d') AS bucket, count(DISTINCT story_id) AS stories, strftime(max(received_at), '%Y-%m-%d %H:%M:%S') AS last_received FROM (
    SELECT *, unnest(generate_series(date_trunc('day', window_start), date_trunc('day', window_end), INTERVAL 1 DAY)) AS bucket FROM story) WHERE window_end > bucket GROUP BY customer_id, bucket""", "story")
def _(spark, d):
    return a.story_rollup(v.story(spark, d)).select("customer_id", F.col("bucket").cast("string").alias("bucket"), "stories", _text("last_received"))


@query("live_activity", "SELECT customer_id, count(*) AS n, strftime(max(event_time), '%Y-%m-%d %H:%M:%S') AS last_event FROM baseline WHERE event_time >= TIMESTAMP '2024-01-30' AND event_time < TIMESTAMP '2024-01-31' GROUP BY customer_id", "baseline")
def _(spark, d):
    return a.live_activity(v.baseline(spark, d), NOW).select("customer_id", "n", _text("last_event"))


@query("readiness_story", "SELECT story_id, max(member_time) <= TIMESTAMP '1997-01-01' - INTERVAL 15 MINUTE OR min(member_time) <= TIMESTAMP '1997-01-01' - INTERVAL 6 HOUR AS ready FROM member GROUP BY story_id", "member")
def _(spark, d):
    return a.ready_stories(v.member(spark, d), "1997-01-01 00:00:00")


@query("readiness_periodic", f""", {ROLLUP} SELECT customer_id, period, strftime(bucket, '%Y-%m-%d') AS bucket, CASE WHEN last_received + INTERVAL 30 MINUTE <= TIMESTAMP '2024-01-22 05:00:00' AND
    CASE period WHEN 'DAILY' THEN CAST(bucket AS TIMESTAMP) + INTERVAL 1 DAY + INTERVAL 3 HOUR WHEN 'WEEKLY' THEN CAST(bucket AS TIMESTAMP) + INTERVAL 7 DAY + INTERVAL 6 HOUR ELSE CAST(bucket AS TIMESTAMP) + INTERVAL 1 MONTH + INTERVAL 12 HOUR END
    <= TIMESTAMP '2024-01-22 05:00:00' THEN 'ready' ELSE 'pending' END AS status FROM rollup WHERE CAST(bucket AS TIMESTAMP) < TIMESTAMP '2024-01-22 05:00:00'""", "baseline")
def _(spark, d):
    return a.ready_buckets(a.bucket_rollup(v.baseline(spark, d)), "2024-01-22 05:00:00").withColumn("bucket", F.col("bucket").cast("string"))


@query("late_buckets", f"SELECT customer_id, strftime(date_trunc('day', event_time), '%Y-%m-%d') AS bucket, count(*) AS late_events FROM baseline WHERE received_at >= TIMESTAMP '{DAY}' AND event_time < TIMESTAMP '{DAY}' GROUP BY 1, 2", "baseline")
def _(spark, d):
    return a.late_buckets(v.baseline(spark, d), DAY).withColumn("bucket", F.col("bucket").cast("string"))


@query("ingest_dedup", """SELECT count(*) AS received, count(DISTINCT event_id) FILTER (WHERE event_id % 3 <> 0) AS accepted, count(*) - count(DISTINCT event_id) FILTER (WHERE event_id % 3 <> 0) AS duplicates
    FROM (SELECT event_id FROM events UNION ALL SELECT event_id FROM events WHERE event_id % 5 = 0)""")
def _(spark, d):
    e = v.table(spark, d, "events").select("event_id")
    return a.ingest_counts(e.where("event_id % 3 = 0"), e.unionByName(e.where("event_id % 5 = 0")), ["event_id"])


@query("ingest_accepted", "SELECT DISTINCT event_id FROM events WHERE event_id % 3 <> 0")
def _(spark, d):
    e = v.table(spark, d, "events").select("event_id")
    return a.ingest(e.where("event_id % 3 = 0"), e.unionByName(e.where("event_id % 5 = 0")), ["event_id"])


@query("window_replace", f"SELECT event_key, baseline_version, raw_score FROM baseline WHERE NOT (baseline_version = 'v2' AND {IN_DAY}) UNION ALL SELECT event_key, 'v2', raw_score + 1 FROM baseline WHERE baseline_version = 'v1' AND {IN_DAY}", "baseline")
def _(spark, d):
    b = v.baseline(spark, d)
    payload = b.where((F.col("baseline_version") == "v1") & s.within("event_time", DAY, DAY_AFTER)).withColumn("baseline_version", F.lit("v2")).withColumn("raw_score", F.col("raw_score") + 1)
    return a.window_replace(b, payload, "v2", DAY, DAY_AFTER).select("event_key", "baseline_version", "raw_score")


@query("retention_cutoff", "SELECT customer_id, count(*) FILTER (WHERE event_time >= TIMESTAMP '2024-01-24') AS kept, count(*) FILTER (WHERE event_time < TIMESTAMP '2024-01-24') AS dropped FROM baseline GROUP BY customer_id", "baseline")
def _(spark, d):
    return a.retention(v.baseline(spark, d), "event_time", NOW, 7)


@query("orphan_members", "SELECT story_id, member_no FROM member WHERE story_id NOT IN (SELECT story_id FROM story WHERE story_id % 3 <> 0)", "story", "member")
def _(spark, d):
    return a.orphans(v.member(spark, d), v.story(spark, d).where("story_id % 3 <> 0"), "story_id").select("story_id", "member_no")


@query("tier_b_cap", "SELECT customer_id, event_key FROM (SELECT *, row_number() OVER (PARTITION BY customer_id, date_trunc('day', event_time) ORDER BY event_time, event_key) AS rn FROM latest) WHERE rn <= 3", "latest")
def _(spark, d):
    rows = _latest(spark, d).withColumn("day", F.to_date("event_time"))
    return s.running_cap(rows, ["customer_id", "day"], [F.asc("event_time"), F.asc("event_key")], 3).select("customer_id", "event_key")


@query("backfill_plan", with_live("""SELECT customer_id, class, count(*) AS n FROM (SELECT customer_id, CASE WHEN current THEN 'already_current' WHEN category IS NULL THEN 'source_unavailable' WHEN rn <= 100 THEN 'reanalyze' ELSE 'cap_excluded' END AS class FROM (
    SELECT *, row_number() OVER (PARTITION BY customer_id, NOT current AND category IS NOT NULL ORDER BY event_time DESC, event_key) AS rn FROM (
        SELECT l.*, m.event_key IS NOT NULL AS current FROM latest l LEFT JOIN (SELECT sensor, event_key FROM live WHERE model = 'm1') m USING (sensor, event_key)))) GROUP BY customer_id, class"""), "latest", "result")
def _(spark, d):
    return a.backfill_plan(_latest(spark, d), _live(spark, d), "m1", 100)


@query("calendar_grid", f""", {ROLLUP} SELECT c.customer_id, strftime(day, '%Y-%m-%d') AS bucket, CASE WHEN day > DATE '2024-01-31' THEN 'future' WHEN day < DATE '2024-01-05' THEN 'out_of_retention' WHEN r.bucket IS NOT NULL THEN 'report' ELSE 'none' END AS state
    FROM (SELECT DISTINCT customer_id FROM rollup) c CROSS JOIN (SELECT CAST(unnest(generate_series(DATE '2024-01-01', DATE '2024-02-05', INTERVAL 1 DAY)) AS DATE) AS day)
    LEFT JOIN (SELECT * FROM rollup WHERE period = 'DAILY') r ON r.customer_id = c.customer_id AND r.bucket = day""", "baseline")
def _(spark, d):
    return a.calendar(a.bucket_rollup(v.baseline(spark, d)), "2024-01-01", "2024-02-05", "2024-01-05", "2024-01-31").withColumn("bucket", F.col("bucket").cast("string"))


@query("report_index", f""", {ROLLUP} SELECT period, nth, strftime(bucket, '%Y-%m-%d') AS bucket, customer_id FROM (SELECT *, CAST(row_number() OVER (PARTITION BY period ORDER BY bucket DESC, customer_id) AS INTEGER) AS nth FROM rollup)
    WHERE nth <= CASE period WHEN 'DAILY' THEN 14 WHEN 'WEEKLY' THEN 8 ELSE 12 END""", "baseline")
def _(spark, d):
    return r.report_index(a.bucket_rollup(v.baseline(spark, d)), {"DAILY": 14, "WEEKLY": 8, "MONTHLY": 12}).withColumn("bucket", F.col("bucket").cast("string"))


@query("report_neighbors", f""", {ROLLUP} SELECT customer_id, strftime(bucket, '%Y-%m-%d') AS bucket, strftime(lag(bucket) OVER w, '%Y-%m-%d') AS previous_bucket, strftime(lead(bucket) OVER w, '%Y-%m-%d') AS next_bucket
    FROM rollup WHERE period = 'DAILY' WINDOW w AS (PARTITION BY customer_id ORDER BY bucket)""", "baseline")
def _(spark, d):
    days = a.bucket_rollup(v.baseline(spark, d)).where("period = 'DAILY'").withColumn("bucket", F.col("bucket").cast("string"))
    return r.neighbors(days.select("customer_id", "bucket"))


@query("cited_by", """SELECT report, bucket, generation FROM (SELECT l_orderkey AS report, l_orderkey % 40 AS bucket, l_orderkey % 6 AS generation, row_number() OVER (PARTITION BY l_orderkey % 40 ORDER BY l_orderkey % 6 DESC, l_orderkey) AS rn FROM lineitem
    WHERE l_partkey % 10 = 3 AND l_linenumber % 2 = 1 AND l_orderkey % 5 > 0 GROUP BY l_orderkey) WHERE rn = 1""")
def _(spark, d):
    # A report's references are an array of at most its own citations, as line numbers are.
    refs = v.member(spark, d).groupBy("story_id").agg(F.collect_list(F.struct((F.col("member_key") % 10).alias("source"), (F.col("member_no") % 2).alias("kind"))).alias("refs"))
    reports = refs.select(F.col("story_id").alias("report"), (F.col("story_id") % 40).alias("bucket"), (F.col("story_id") % 6).alias("generation"), (F.col("story_id") % 5 == 0).alias("superseded"), "refs")
    return g.citing_reports(reports, [F.desc("generation"), F.asc("report")], source=3, kind=1).select("report", "bucket", "generation")


A, B = "2024-01-15 00:00:00", "2024-01-15 12:00:00"
ALERTS = f"""alerts AS (SELECT 'denials_actor' AS indicator, CAST(actor_id AS VARCHAR) AS key, count(*) AS n FROM recent WHERE action = 'sign_in.denied' GROUP BY actor_id HAVING count(*) >= 5
    UNION ALL SELECT 'denials_ip', CAST(ip AS VARCHAR), count(*) FROM recent WHERE action = 'sign_in.denied' GROUP BY ip HAVING count(*) >= 5
    UNION ALL SELECT 'bridge_abuse', CAST(customer_id AS VARCHAR), count(*) FROM recent WHERE action = 'bridge.connect' GROUP BY customer_id HAVING count(*) >= 10
    UNION ALL SELECT 'multi_ip', CAST(actor_id AS VARCHAR), count(DISTINCT ip) FROM recent WHERE action = 'sign_in.success' GROUP BY actor_id HAVING count(DISTINCT ip) >= 2
    UNION ALL SELECT 'session_mismatch', actor_id || ':' || sid, count(*) FROM recent WHERE action = 'session.ip_mismatch' GROUP BY actor_id, sid HAVING count(*) >= 2)"""
RECENT = f"recent AS (SELECT * FROM audit WHERE logged_at >= TIMESTAMP '{A}' AND logged_at < TIMESTAMP '{B}')"


@query("audit_alerts", f", {RECENT}, {ALERTS} SELECT * FROM alerts", "audit")
def _(spark, d):
    return u.all_alerts(v.audit(spark, d), A, B)


@query("audit_denials", f", {RECENT}, {ALERTS} SELECT * FROM alerts WHERE indicator LIKE 'denials%'", "audit")
def _(spark, d):
    return u.denials(v.audit(spark, d), A, B)


@query("audit_multi_ip", f", {RECENT}, {ALERTS} SELECT * FROM alerts WHERE indicator = 'multi_ip'", "audit")
def _(spark, d):
    return u.multi_ip(v.audit(spark, d), A, B)


@query("audit_cooldown", f", {RECENT}, {ALERTS} SELECT * FROM alerts WHERE NOT (indicator = 'denials_ip' AND key IN ('1', '3'))", "audit")
def _(spark, d):
    earlier = spark.createDataFrame([("denials_ip", "1", "2024-01-15 11:00:00"), ("denials_ip", "3", "2024-01-15 11:59:00"), ("denials_ip", "2", "2024-01-15 10:59:59")], "indicator string, key string, at string")
    return u.fresh_alerts(u.all_alerts(v.audit(spark, d), A, B), earlier.withColumn("at", F.col("at").cast("timestamp_ntz")), B)


@query("audit_search", f"SELECT id, actor_id, action, ip FROM audit WHERE action = 'report.read' AND logged_at >= TIMESTAMP '2024-01-10' AND logged_at <= TIMESTAMP '{DAY}' AND id < 1000000 ORDER BY id DESC LIMIT 50", "audit")
def _(spark, d):
    return u.search(v.audit(spark, d), action="report.read", start="2024-01-10 00:00:00", end=DAY, before_id=1000000)


HITS = f"""SELECT doc_id, 'ipv4' AS kind, lower(unnest(regexp_extract_all(text, '{i.IPV4}'))) AS value FROM documents UNION ALL SELECT doc_id, 'hash', lower(unnest(regexp_extract_all(text, '{i.HEX}'))) FROM documents"""


@query("extract_indicators", f"SELECT DISTINCT doc_id, kind, value FROM ({HITS})")
def _(spark, d):
    return i.extract(v.table(spark, d, "documents"), "doc_id", "text")


@query("mask_pii", f"SELECT doc_id, md5(regexp_replace(regexp_replace(text, '{i.EMAIL}', '<<MAIL>>', 'g'), '{i.IPV4}', '<<IP>>', 'g')) AS masked FROM documents")
def _(spark, d):
    return v.table(spark, d, "documents").select("doc_id", F.md5(i.mask(F.col("text")).cast("binary")).alias("masked"))


NUMBER = "CAST(p[1] AS BIGINT) * 16777216 + CAST(p[2] AS BIGINT) * 65536 + CAST(p[3] AS BIGINT) * 256 + CAST(p[4] AS BIGINT)"
ADDRESSES = f"(SELECT *, {NUMBER} AS number FROM (SELECT DISTINCT doc_id, value, string_split(value, '.') AS p FROM ({HITS}) WHERE kind = 'ipv4'))"


def _addresses(spark, d):
    found = i.extract(v.table(spark, d, "documents"), "doc_id", "text").where("kind = 'ipv4'")
    return found.withColumn("number", i.ip_number(F.col("value")))


@query("private_addresses", f"""SELECT doc_id, value, number BETWEEN 167772160 AND 184549375 OR number BETWEEN 2886729728 AND 2887778303 OR number BETWEEN 3232235520 AND 3232301055
    OR number BETWEEN 2851995648 AND 2852061183 OR number BETWEEN 2130706432 AND 2147483647 AS private FROM {ADDRESSES}""")
def _(spark, d):
    return _addresses(spark, d).select("doc_id", "value", i.is_private(F.col("number")).alias("private"))


@query("cidr_match", f"SELECT doc_id, value, 'feed' || k AS source FROM {ADDRESSES} JOIN (SELECT unnest(range(0, 255, 3)) AS k) ON number // 16777216 = k")
def _(spark, d):
    feed = spark.range(0, 255, 3).select(F.concat(F.lit("feed"), F.col("id").cast("string")).alias("source"), (F.col("id") * 16777216).alias("low"), F.lit(24).alias("bits"))
    return i.cidr_match(_addresses(spark, d), feed).select("doc_id", "value", "source")


MATCHES = "(SELECT user_id AS indicator, event_id % 4 AS source, event_id * 29 % 80 AS confidence, event_id % 97 = 0 AS negative FROM events)"


@query("ioc_verdicts", f"""SELECT indicator, CASE WHEN bool_or(negative) THEN 'suppressed' WHEN max(confidence) FILTER (WHERE NOT negative) >= 70 OR count(DISTINCT source) FILTER (WHERE NOT negative) >= 2 THEN 'promoted' ELSE 'held' END AS verdict,
    count(DISTINCT source) FILTER (WHERE NOT negative) AS sources FROM {MATCHES} GROUP BY indicator""")
def _(spark, d):
    e = v.table(spark, d, "events")
    return i.judge(e.selectExpr("user_id AS indicator", "event_id % 4 AS source", "event_id * 29 % 80 AS confidence", "event_id % 97 = 0 AS negative"))


COVERAGE = """(SELECT subject, count(*) FILTER (WHERE answered) AS answered_n, count(*) FILTER (WHERE answered AND age > 50) AS stale_n, count(*) FILTER (WHERE NOT answered) AS unavailable_n FROM (
    SELECT user_id AS subject, event_id % 3 AS source, bool_or(event_id % 7 <> 0) AS answered, min(event_id % 60) FILTER (WHERE event_id % 7 <> 0) AS age FROM events GROUP BY 1, 2) GROUP BY subject)"""


def _coverage(spark, d):
    e = v.table(spark, d, "events")
    return i.coverage(e.selectExpr("user_id AS subject", "event_id % 3 AS source", "event_id % 7 <> 0 AS answered", "event_id % 60 AS age"), 3, 50)


STATUS = "CASE WHEN unavailable_n > 0 THEN 'unknown' WHEN stale_n > 0 THEN 'stale' WHEN answered_n < 3 THEN 'partial' ELSE 'complete' END"


@query("coverage_status", f"SELECT *, {STATUS} AS status FROM {COVERAGE}")
def _(spark, d):
    return _coverage(spark, d)


@query("coverage_worst", f"SELECT status FROM (SELECT {STATUS} AS status FROM {COVERAGE}) ORDER BY CASE status WHEN 'complete' THEN 0 WHEN 'partial' THEN 1 WHEN 'stale' THEN 2 ELSE 3 END DESC LIMIT 1")
def _(spark, d):
    return i.worst_coverage(_coverage(spark, d))


PIVOT = """(SELECT cve, coalesce(max(published) FILTER (WHERE source = 'nvd'), max(published) FILTER (WHERE source = 'kev')) AS published, max(epss) FILTER (WHERE source = 'epss') AS epss, bool_or(source = 'kev') AS kev,
    concat_ws(',', CASE WHEN bool_or(source = 'nvd') THEN 'nvd' END, CASE WHEN bool_or(source = 'kev') THEN 'kev' END, CASE WHEN bool_or(source = 'epss') THEN 'epss' END) AS sources FROM cve GROUP BY cve)"""


@query("cve_pivot", f"SELECT * FROM {PIVOT}", "cve")
def _(spark, d):
    return i.cve_pivot(v.cve(spark, d))


@query("cve_landscape", f"SELECT cve, kev, epss, published FROM {PIVOT} WHERE kev OR epss >= 50 ORDER BY kev DESC, epss DESC NULLS LAST, published DESC NULLS LAST, cve LIMIT 40", "cve")
def _(spark, d):
    return i.cve_landscape(i.cve_pivot(v.cve(spark, d)), 50, 40)


@query("cve_validate", f"""SELECT CASE WHEN NOT regexp_matches(ref, '^CVE-[0-9]{{4}}-[0-9]{{4,}}$') THEN 'invalid_format' WHEN p.cve IS NULL THEN 'not_in_catalog' ELSE 'kept' END AS reason, count(*) AS n
    FROM (SELECT CASE WHEN event_id % 9 = 0 THEN 'CVE-' || event_id ELSE 'CVE-' || (2015 + event_id % 10) || '-' || (10000 + event_id) END AS ref FROM events) LEFT JOIN {PIVOT} p ON p.cve = ref GROUP BY 1""", "cve")
def _(spark, d):
    e = v.table(spark, d, "events")
    ref = F.expr("CASE WHEN event_id % 9 = 0 THEN concat('cve-', event_id) ELSE concat(' cve-', 2015 + event_id % 10, '-', 10000 + event_id) END")
    return i.cve_validate(e.select(ref.alias("ref")), i.cve_pivot(v.cve(spark, d)))
