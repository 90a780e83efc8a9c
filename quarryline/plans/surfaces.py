"""Queries of overviews, languages, comparisons, permissions, feeds by kind and small expressions. Importing this registers them."""

from __future__ import annotations

from pyspark.sql import functions as F

from quarryline.functions import semantics as s
from quarryline.operators import activity as a
from quarryline.operators import audit as u
from quarryline.operators import indicators as k
from quarryline.operators import lineage as g
from quarryline.operators import overview as o
from quarryline.operators import periodic as p
from quarryline.operators import redaction as x
from quarryline.operators import report as r
from quarryline.operators import workflow as w
from quarryline.plans.catalog import A, ALERTS, B, NOW, RANK, RECENT, ROLLUP, _live, query, with_live
from quarryline.sources import feeds as f
from quarryline.sources import views as v

_ORDER = f"{RANK} DESC, severity DESC, likelihood DESC, recent DESC, key, customer_id"


def _surface_sql(rows: str, kind: str) -> str:
    return f""", seen AS ({rows}) SELECT '{kind}' AS kind, key, customer_id, tier, severity, likelihood, strftime(recent, '%Y-%m-%d') AS day, total FROM (SELECT *, count(*) OVER () AS total FROM seen WHERE customer_id <> 3 ORDER BY {_ORDER} LIMIT 25)"""


def _shown(df):
    return df.select("kind", "key", "customer_id", "tier", "severity", "likelihood", F.date_format("at", "yyyy-MM-dd").alias("day"), "total")


def _allowed(spark):
    return spark.range(10).select(F.col("id").alias("customer_id")).where("customer_id <> 3")


@query("overview_stories", _surface_sql("""SELECT CAST(story_id AS VARCHAR) AS key, customer_id, tier, severity, likelihood, window_end AS recent FROM (SELECT * EXCLUDE (rn) FROM (SELECT *, row_number() OVER (PARTITION BY story_id ORDER BY received_at DESC, story_version DESC) AS rn FROM incident) WHERE rn = 1)
    JOIN (SELECT * EXCLUDE (rn) FROM (SELECT *, row_number() OVER (PARTITION BY story_id ORDER BY model, generation DESC) AS rn FROM story_result WHERE NOT superseded AND model IN ('m0', 'm1')) WHERE rn = 1) USING (story_id)""", "story"), "incident", "story_result")
def _(spark, d):
    best = g.preferred(v.story_result(spark, d).where("not superseded"), ["story_id"], ["m0", "m1"], [F.desc("generation")])
    rows = s.canonical_story(v.incident(spark, d)).select("story_id", "customer_id", F.col("window_end").alias("at")).join(best, "story_id")
    return _shown(o.surface(rows, "story_id", "story", _allowed(spark)))


@query("overview_reports", _surface_sql("SELECT CAST(c_custkey AS VARCHAR) AS key, c_custkey % 5 AS customer_id, CASE c_custkey % 4 WHEN 0 THEN 'LOW' WHEN 1 THEN 'MEDIUM' WHEN 2 THEN 'HIGH' ELSE 'CRITICAL' END AS tier, c_custkey * 7 % 100 AS severity, c_custkey * 3 % 100 AS likelihood, DATE '2024-01-01' + CAST(c_custkey % 28 AS INTEGER) AS recent FROM customer", "report").replace(", seen AS", "WITH seen AS", 1))
def _(spark, d):
    tier = "CASE c_custkey % 4 WHEN 0 THEN 'LOW' WHEN 1 THEN 'MEDIUM' WHEN 2 THEN 'HIGH' ELSE 'CRITICAL' END AS tier"
    rows = v.table(spark, d, "customer").selectExpr("c_custkey AS report", "c_custkey % 5 AS customer_id", tier, "c_custkey * 7 % 100 AS severity", "c_custkey * 3 % 100 AS likelihood", "date_add(DATE'2024-01-01', CAST(c_custkey % 28 AS INT)) AS at")
    return _shown(o.surface(rows, "report", "report", _allowed(spark)))


@query("overview_all_events", with_live(_surface_sql("SELECT CAST(event_key AS VARCHAR) AS key, customer_id, tier, severity, likelihood, event_time AS recent FROM live", "event")), "result")
def _(spark, d):
    return _shown(o.surface(_live(spark, d).withColumnRenamed("event_time", "at"), "event_key", "event", _allowed(spark)))


@query("overview_unreachable", "SELECT i AS customer_id FROM range(10) t(i) WHERE i <> 3 AND i > 4")
def _(spark, d):
    return o.unreachable(_allowed(spark), v.baseline(spark, d))


@query("page_with_total", with_live(f"SELECT event_key, sensor, tier, (SELECT count(*) FROM live) AS total FROM live ORDER BY {RANK} DESC, severity DESC, event_key, sensor LIMIT 25"), "result")
def _(spark, d):
    return s.with_total(_live(spark, d), [F.desc(s.tier_rank()), F.desc("severity"), F.asc("event_key"), F.asc("sensor")], 25).select("event_key", "sensor", "tier", "total")


@query("event_page_nulls", "SELECT event_key, category, sensor FROM latest WHERE category < 'error' OR category IS NULL OR (category = 'error' AND sensor > 5) OR (category = 'error' AND sensor = 5 AND event_key > 9000) ORDER BY category DESC NULLS LAST, sensor, event_key LIMIT 9000", "latest")
def _(spark, d):
    order = [("category", True), ("sensor", False), ("event_key", False)]
    return s.page(s.latest_baseline(v.baseline(spark, d)), order, ["error", 5, 9000], 9000).select("event_key", "category", "sensor")


@query("event_page_all_keys", with_live(f"""SELECT event_key, sensor, tier, severity FROM live WHERE ({RANK}, severity, likelihood) < (2, 90, 50) OR (({RANK}, severity, likelihood) = (2, 90, 50) AND (event_time < TIMESTAMP '2024-01-10' OR (event_time = TIMESTAMP '2024-01-10' AND (sensor, event_key) > (3, 10))))
    ORDER BY {RANK} DESC, severity DESC, likelihood DESC, event_time DESC, sensor, event_key LIMIT 25"""), "result")
def _(spark, d):
    order = [("rank", True), ("severity", True), ("likelihood", True), ("event_time", True), ("sensor", False), ("event_key", False)]
    cursor = [2, 90, 50, F.lit("2024-01-10").cast("timestamp_ntz"), 3, 10]
    return s.page(_live(spark, d).withColumn("rank", s.tier_rank()), order, cursor, 25).select("event_key", "sensor", "tier", "severity")


@query("cursor_round_trip", """SELECT event_key, replace(replace(rtrim(to_base64(encode('{"severity":' || severity || ',"key":' || event_key || '}')), '='), '+', '-'), '/', '_') AS cursor, severity, event_key AS key FROM live""".replace("FROM live", "FROM (SELECT event_id AS event_key, event_id * 37 % 100 AS severity FROM events)"))
def _(spark, d):
    e = v.table(spark, d, "events").select(F.col("event_id").alias("event_key"), (F.col("event_id") * 37 % 100).alias("severity"))
    rows = e.withColumn("cursor", s.encode_cursor({"severity": F.col("severity"), "key": F.col("event_key")}))
    back = s.decode_cursor(F.col("cursor"), "severity long, key long")
    return rows.withColumn("back", back).select("event_key", "cursor", F.col("back.severity").alias("severity"), F.col("back.key").alias("key"))


@query("report_languages", "SELECT o_custkey AS report, string_agg(DISTINCT l, ',' ORDER BY l) AS languages, CASE WHEN bool_or(l = 'KO') THEN 'KO' WHEN bool_or(l = 'EN') THEN 'EN' ELSE min(l) END AS shown FROM (SELECT o_custkey, ['EN', 'KO', 'JA', 'DE', 'FR', 'JA', 'EN'][o_orderkey % 7 + 1] AS l FROM orders) GROUP BY o_custkey")
def _(spark, d):
    names = F.get(F.array(*map(F.lit, ("EN", "KO", "JA", "DE", "FR", "JA", "EN"))), (F.col("o_orderkey") % 7).cast("int"))
    rows = v.table(spark, d, "orders").select(F.col("o_custkey").alias("report"), names.alias("language"))
    return o.report_languages(rows, ["report"], "KO", "EN").withColumn("languages", F.array_join("languages", ","))


@query("compare_columns", """SELECT story_id, a.tier AS tier_a, a.severity AS severity_a, b.tier AS tier_b, b.severity AS severity_b, a.tier IS DISTINCT FROM b.tier AS differs FROM (SELECT * FROM story_result WHERE NOT superseded AND model = 'm0') a FULL JOIN (SELECT * FROM story_result WHERE NOT superseded AND model = 'm1') b USING (story_id)""", "story_result")
def _(spark, d):
    return o.compared(v.story_result(spark, d).where("not superseded"), ["story_id"], "m0", "m1")


@query("accessible_detailed", """WITH e AS (SELECT o_custkey % 50 AS account, o_custkey AS customer_id, 'r' || o_orderkey % 3 AS role FROM orders UNION SELECT c_nationkey, c_custkey, 'analyst' FROM customer), q AS (SELECT * FROM (VALUES ('r0', 'read'), ('r1', 'read'), ('r1', 'write'), ('analyst', 'analyse')) t(role, permission))
    SELECT account, customer_id, string_agg(DISTINCT role, ',' ORDER BY role) AS roles, coalesce(string_agg(DISTINCT permission, ',' ORDER BY permission), '') AS permissions FROM e LEFT JOIN q USING (role) GROUP BY account, customer_id""")
def _(spark, d):
    held = v.table(spark, d, "orders").selectExpr("CAST(o_custkey % 50 AS BIGINT) AS account", "o_custkey AS customer_id", "concat('r', o_orderkey % 3) AS role")
    grants = spark.createDataFrame([("r0", "read"), ("r1", "read"), ("r1", "write"), ("analyst", "analyse")], "role string, permission string")
    return o.accessible_detailed(held, v.table(spark, d, "customer").selectExpr("CAST(c_nationkey AS BIGINT) AS account", "c_custkey AS customer_id", "'analyst' AS role"), grants)


@query("subject_models", "SELECT c_custkey AS subject, CASE WHEN c_custkey % 3 = 0 AND c_custkey % 2 = 0 THEN 'm2' ELSE 'm1' END AS model FROM customer")
def _(spark, d):
    subjects = v.table(spark, d, "customer").select(F.col("c_custkey").alias("subject"))
    own = subjects.where("subject % 3 = 0").select("subject", F.when(F.col("subject") % 2 == 0, "m2").otherwise("gone").alias("model"))
    one = lambda *names: spark.createDataFrame([(n,) for n in names], "model string")
    return o.model_of(subjects, own, one("m1"), one("m1", "m2", "m3"), "m3")


@query("qualified_members", "SELECT customer_id || ':' || sensor || ':' || event_key AS key, count(*) AS n FROM baseline GROUP BY 1", "baseline")
def _(spark, d):
    return v.baseline(spark, d).groupBy(o.qualified(F.col("customer_id"), F.col("sensor"), F.col("event_key")).alias("key")).agg(F.count("*").alias("n"))


@query("templates", "SELECT p_partkey, 'see ' || CASE WHEN p_partkey % 3 = 0 THEN '{group}' ELSE 'g{year}' || p_partkey END || '/{other}{2024 {' AS text FROM part")
def _(spark, d):
    k = F.col("p_partkey")
    values = {"group": F.when(k % 3 > 0, F.concat(F.lit("g{year}"), k.cast("string"))), "year": F.lit("2024")}
    return v.table(spark, d, "part").select("p_partkey", o.substituted(F.lit("see {group}/{other}{{year} {"), values).alias("text"))


@query("event_names", "SELECT event_id, CASE event_type WHEN 'error' THEN 'Failure' WHEN 'click' THEN 'Press' ELSE event_type END AS name FROM events")
def _(spark, d):
    return v.table(spark, d, "events").select("event_id", o.named(F.col("event_type"), {"error": "Failure", "click": "Press"}).alias("name"))


_CAP = "CASE event_id % 6 WHEN 0 THEN '' WHEN 1 THEN 'x' WHEN 2 THEN ' 12 ' WHEN 3 THEN '-5' WHEN 4 THEN '1.5' ELSE CAST(event_id AS {0}) END"


@query("daily_caps", "SELECT event_id, CASE event_id % 6 WHEN 2 THEN 12 WHEN 5 THEN event_id ELSE 100 END AS cap FROM events")
def _(spark, d):
    return v.table(spark, d, "events").select("event_id", o.coerced_cap(F.expr(_CAP.format("STRING")), 100).cast("long").alias("cap"))


_DETAILS = "CASE event_id % 4 WHEN 0 THEN concat('{\"email\":\"a', event_id, '\",\"x\":\"1\"}') WHEN 1 THEN '{\"email\":null}' WHEN 2 THEN '{}' ELSE '{\"x\":\"2\"}' END"


def _log(spark, d):
    return v.audit(spark, d).join(v.table(spark, d, "events").select(F.col("event_id").alias("id"), F.expr(_DETAILS).alias("details")), "id")


@query("audit_anonymised", """SELECT event_id AS id, CASE WHEN user_id % 5 <> 2 THEN event_id % 11 END AS ip, CASE WHEN user_id % 5 <> 2 THEN CASE event_id % 4 WHEN 0 THEN '{"email":"a' || event_id || '","x":"1"}' WHEN 1 THEN '{"email":null}' WHEN 2 THEN '{}' ELSE '{"x":"2"}' END
    ELSE CASE event_id % 4 WHEN 0 THEN '{"email":"[redacted]","x":"1"}' WHEN 1 THEN '{"email":"[redacted]"}' WHEN 2 THEN '{}' ELSE '{"x":"2"}' END END AS details FROM events""")
def _(spark, d):
    return u.anonymised(_log(spark, d), 2, ["email", "name"]).select("id", "ip", "details")


@query("audit_keys", "SELECT event_id AS id, event_id % 4 < 2 AS has_email FROM events")
def _(spark, d):
    return _log(spark, d).select("id", o.has_key(F.col("details"), "email").alias("has_email"))


@query("audit_prefix", "SELECT id, actor_id, action, ip FROM audit WHERE action LIKE 'sign_in.%' AND ip = 4 AND sid = 5 ORDER BY id DESC LIMIT 200", "audit")
def _(spark, d):
    return u.search(v.audit(spark, d), prefix="sign_in.", address=4, session=5, limit=200)


@query("audit_evidence", f", {RECENT} SELECT actor_id, string_agg(CAST(id AS VARCHAR), ',' ORDER BY id) AS ids, count(*) AS n FROM recent WHERE action = 'sign_in.denied' GROUP BY actor_id", "audit")
def _(spark, d):
    return u.evidence_ids(v.audit(spark, d).where((F.col("action") == "sign_in.denied") & s.within("logged_at", A, B)), ["actor_id"])


@query("alert_rows", f", {RECENT}, {ALERTS} SELECT indicator, key, n, 'warning' AS severity, '2024-01-15 12:00:00' AS stamped FROM alerts", "audit")
def _(spark, d):
    rows = o.alert_rows(u.all_alerts(v.audit(spark, d), A, B), u.severity(F.col("indicator")), F.lit(B))
    return rows.withColumnRenamed("at", "stamped")


@query("alert_severities", "SELECT event_id, CASE WHEN event_id % 3 = 0 THEN 'severe' ELSE 'warning' END AS severity FROM events")
def _(spark, d):
    indicator = F.when(F.col("event_id") % 3 == 0, "bridge_scope_probing").otherwise("multi_ip")
    return v.table(spark, d, "events").select("event_id", u.severity(indicator).alias("severity"))


@query("alert_search", "SELECT event_id AS id FROM events WHERE event_type = 'error' AND event_id % 2 = 0 AND ts >= TIMESTAMP '2024-01-10' AND event_id < 9000 ORDER BY event_id DESC LIMIT 100")
def _(spark, d):
    alerts = v.table(spark, d, "events").select(F.col("event_id").alias("id"), F.col("event_type").alias("indicator"), F.when(F.col("event_id") % 2 == 0, "severe").otherwise("warning").alias("severity"), F.lit(False).alias("acknowledged"), F.col("ts").alias("at"))
    return o.alert_search(alerts, indicator="error", severity="severe", since="2024-01-10 00:00:00", before_id=9000, limit=100).select("id")


_TREE = "concat('{\"a\":\"x', event_id, '\",\"b\":[1,{\"c\":[\"y\",null,true]},\"z', event_id % 7, '\"],\"d\":', CASE WHEN event_id % 10 = 0 THEN '}' ELSE '2}' END)"


@query("string_leaves", "SELECT event_id, place, CASE place WHEN 0 THEN 'x' || event_id WHEN 1 THEN 'y' ELSE 'z' || event_id % 7 END AS leaf FROM events, range(3) t(place) WHERE event_id % 10 > 0")
def _(spark, d):
    return o.string_leaves(v.table(spark, d, "events").select("event_id", F.expr(_TREE).alias("payload")), "event_id", "payload")


@query("contexts", "SELECT event_id, CASE WHEN event_id % 3 = 0 THEN 'A' END AS actor, CASE WHEN event_id % 2 = 0 THEN 'F' END AS family FROM events WHERE event_id % 3 = 0 OR event_id % 2 = 0")
def _(spark, d):
    payload = F.expr("concat('{\"actor\":\"', CASE WHEN event_id % 3 = 0 THEN ' A' ELSE ' ' END, '\",\"family\":', CASE WHEN event_id % 2 = 0 THEN '\"F\"' ELSE 'null' END, ',\"more\":1}')")
    rows = v.table(spark, d, "events").select("event_id", o.context(payload, ["actor", "family"]).alias("c")).where("c is not null")
    return rows.select("event_id", "c.actor", "c.family")


@query("canonical_hashes", """SELECT event_id, sha256('{' || CASE WHEN event_id % 2 = 0 THEN '"a":' || event_id || ',' ELSE '' END || '"b":"' || event_type || '","c":[1,2]}') AS digest FROM events""")
def _(spark, d):
    fields = {"c": F.array(F.lit(1), F.lit(2)), "b": F.col("event_type"), "a": F.when(F.col("event_id") % 2 == 0, F.col("event_id"))}
    return v.table(spark, d, "events").select("event_id", p.canonical_hash(fields).alias("digest"))


@query("first_of_sorted", "SELECT user_id, min_by(event_id, (-event_id % 100, event_id)) AS event_id FROM events GROUP BY user_id")
def _(spark, d):
    return o.first_by(v.table(spark, d, "events"), ["user_id"], [F.expr("-event_id % 100"), F.asc("event_id")]).select("user_id", "event_id")


@query("policy_of_all", "SELECT o_custkey AS subject, CASE WHEN o_custkey % 2 = 0 THEN 'ok' ELSE 'baseline-only' END AS state FROM orders GROUP BY o_custkey")
def _(spark, d):
    rows = v.table(spark, d, "orders").select(F.col("o_custkey").alias("subject"), F.col("o_orderkey").alias("place"), F.lit("p1").alias("policy"))
    return g.policy_of_all(rows.select("subject").distinct(), g.policy_agreement(rows.where("subject % 2 = 0"), ["subject"], "place", "policy"), ["subject"]).select("subject", "state")


@query("supersede_twice", "SELECT generation, count(*) AS n, count(*) FILTER (WHERE generation = 2 AND event_id % 5 = 0 OR generation = 1 AND event_id % 3 = 0) AS stamped FROM (SELECT event_id, 1 AS generation FROM events UNION ALL SELECT event_id, 2 FROM events WHERE event_id % 3 = 0 UNION ALL SELECT event_id, 3 FROM events WHERE event_id % 15 = 0) GROUP BY generation")
def _(spark, d):
    e = v.table(spark, d, "events").select(F.col("event_id").alias("event_key"), F.col("event_type").alias("payload"))
    held = e.select("*", F.lit(1).alias("generation"), F.lit(None).cast("timestamp_ntz").alias("superseded_at"))
    new = e.where("event_key % 3 = 0").unionByName(e.where("event_key % 15 = 0").withColumn("payload", F.lit("zz")))
    out = w.supersede(held, new, ["event_key"], F.lit("2024-01-31").cast("timestamp_ntz"))
    return out.groupBy("generation").agg(F.count("*").alias("n"), F.count("superseded_at").alias("stamped"))


K = "p_partkey"
_LIST = f"CASE {K} % 4 WHEN 0 THEN '# c' WHEN 1 THEN concat(' 5.6.7.', {K} % 256, ' ') WHEN 2 THEN concat('9.', {K} % 200, '.0.0/16') ELSE '' END"


def _lines(spark, d, expression):
    return v.table(spark, d, "part").selectExpr(f"{expression} AS value")


@query("feed_by_kind", f"SELECT 'IP' AS entity, CASE WHEN {K} % 4 = 1 THEN '5.6.7.' || {K} % 256 END AS match_value, CASE WHEN {K} % 4 = 2 THEN '9.' || {K} % 200 || '.0.0/16' END AS cidr FROM part WHERE {K} % 4 IN (1, 2)")
def _(spark, d):
    return f.parse_feed(_lines(spark, d, _LIST), "ip-blocklist")


_CSV = f"CASE WHEN {K} = 0 THEN 'Ip,host,score' ELSE concat('1.2.', {K} % 256, '.3, h', {K} % 9, '.test ,', CASE WHEN {K} % 3 = 0 THEN 'low' ELSE 'high' END) END"


@query("feed_csv_static", f"SELECT DISTINCT 'IP' AS entity, '1.2.' || {K} % 256 || '.3' AS indicator FROM part WHERE {K} > 0 AND {K} % 3 > 0 UNION SELECT 'DOMAIN', 'h' || {K} % 9 || '.test' FROM part WHERE {K} > 0 AND {K} % 3 > 0")
def _(spark, d):
    return f.csv_columns(_lines(spark, d, _CSV), header=["ip", "host", "score"], static={"ip": "IP", "host": "DOMAIN"}, keep={"score": ["high"]})


@query("feed_csv_shape", f"SELECT DISTINCT 'DOMAIN' AS entity, 'h' || {K} % 9 || '.test' AS indicator FROM part WHERE {K} > 0")
def _(spark, d):
    return f.csv_columns(_lines(spark, d, _CSV), header=["ip", "host", "score"], shape="host")


_FREE = f"concat('see http://U', {K} % 5, '.test/a. and Mail.Host', {K} % 7, '.Example run x.exe 8.8.8.', {K} % 256)"


@query("feed_free_text_all", f"SELECT {K}, 'URL' AS entity, 'http://U' || {K} % 5 || '.test/a' AS indicator FROM part UNION ALL SELECT {K}, 'DOMAIN', 'mail.host' || {K} % 7 || '.example' FROM part UNION ALL SELECT {K}, 'IP', '8.8.8.' || {K} % 256 FROM part")
def _(spark, d):
    return f.free_text_all(v.table(spark, d, "part").select(K, F.expr(_FREE).alias("t")), K, "t", keep_line="see ")


@query("feed_snapshot", f"SELECT 's' AS source, polarity, count(hit_type) AS hits, count(*) FILTER (WHERE classification = 'own') AS own FROM (SELECT 'positive' AS polarity, 'h' AS hit_type, CASE WHEN {K} % 5 = 0 THEN 'own' ELSE 'c' END AS classification FROM part UNION ALL SELECT 'negative', NULL, 'c' FROM part) GROUP BY polarity")
def _(spark, d):
    rows = v.table(spark, d, "part").select(F.lit("DOMAIN").alias("entity"), F.col(K).cast("string").alias("match_value"), F.lit(None).cast("string").alias("cidr"), F.lit("h").alias("hit_type"), F.lit("c").alias("classification"))
    own = rows.where(F.col("match_value") % 5 == 0).select("match_value", F.lit(None).cast("string").alias("hit_type"), F.lit("own").alias("classification"))
    both = f.snapshot_rows(rows, "s", "positive", own).unionByName(f.snapshot_rows(rows, "s", "negative"))
    return both.groupBy("source", "polarity").agg(F.count("hit_type").alias("hits"), F.count_if(F.col("classification") == "own").alias("own"))


@query("source_registry", """SELECT 's' || s_suppkey AS source, s_suppkey % 4 = 0 AS floor, 24 + s_suppkey % 3 AS max_age_hours, 1 + (s_suppkey % 6 = 5)::INT AS registered FROM supplier WHERE s_suppkey % 5 > 0 AND s_suppkey % 3 < 2""")
def _(spark, d):
    again = F.explode(F.when(F.col("s_suppkey") % 6 == 5, F.array(F.lit(1), F.lit(2))).otherwise(F.array(F.lit(1))))
    rows = v.table(spark, d, "supplier").withColumn("again", again).selectExpr(
        "concat('s', s_suppkey) AS source", "CASE s_suppkey % 3 WHEN 0 THEN array('IP', 'URL') WHEN 1 THEN array('IP') ELSE array('HASH') END AS entities", "CASE WHEN s_suppkey % 5 > 0 THEN 'positive' ELSE 'negative' END AS polarity",
        "CAST(24 + s_suppkey % 3 AS INT) AS max_age_hours", "s_suppkey % 4 = 0 AS floor",
    )
    return f.relevant(f.registry(rows), "IP", "registered")


@query("feed_repository", f"""SELECT 'apt' || {K} % 20 || '/' || {K} || '/iocs.txt' AS path, 'apt' || {K} % 20 AS "group", CASE WHEN {K} % 4 = 0 THEN 'Own ' || {K} ELSE 'Camp ' || {K} % 20 END AS campaign, 'd' || {K} || '.test' AS indicator FROM part""")
def _(spark, d):
    part = v.table(spark, d, "part")
    lists = part.selectExpr(f"concat('apt', {K} % 20, '/', {K}, '/iocs.txt') AS path", f"concat('# x\\nd', {K}, '.test\\n\\nd', {K}, '.test') AS content")
    own = part.where(f"{K} % 4 = 0").selectExpr(f"concat('apt', {K} % 20, '/', {K}, '/README.md') AS path", f"concat('---\\ntitle: Own ', {K}, '\\n---') AS content")
    camps = spark.range(20).selectExpr("concat('apt', id, '/Readme.md') AS path", "concat('title: Camp ', id) AS content")
    return f.repository_rows(lists.unionByName(own).unionByName(camps), [(r"^(apt\d+)/.*\.txt$", "list"), (r"^(apt\d+)/.*\.html$", "text")])


@query("feed_unparseable", "SELECT TRUE AS plain, FALSE AS header, FALSE AS filtered")
def _(spark, d):
    lines, none = _lines(spark, d, "'ip,host'").limit(1), _lines(spark, d, "'x'").limit(0)
    one = lambda name, **k: f.unparsed(lines, none, **k).withColumnRenamed("unparseable", name)
    return one("plain").crossJoin(one("header", header=True)).crossJoin(one("filtered", filtered=True))


@query("feed_exploited", f"SELECT 'CVE-2021-' || (10000 + {K}) AS cve, CASE WHEN {K} % 3 > 0 THEN '2021-02-03' END AS added FROM part WHERE {K} % 5 > 0")
def _(spark, d):
    text = f"concat('{{\"vulnerabilities\":[{{\"cveID\":\" cve-2021-', 10000 + {K}, '\",\"dateAdded\":\"2021-02-', CASE WHEN {K} % 3 > 0 THEN '03' ELSE '30' END, '\"}}]}}', CASE WHEN {K} % 5 = 0 THEN '' ELSE '' END)"
    lines = v.table(spark, d, "part").selectExpr(f"CASE WHEN {K} % 5 = 0 THEN '{{' ELSE {text} END AS value")
    return f.exploited(lines).withColumn("added", F.col("added").cast("string"))


@query("list_filters", with_live(f"SELECT event_key, sensor, tier FROM live WHERE tier IN ('HIGH', 'CRITICAL') AND event_time >= TIMESTAMP '{NOW}' - INTERVAL 7 DAY"), "result")
def _(spark, d):
    return r.listed_since(_live(spark, d), ["HIGH", "CRITICAL"], "7d", NOW).select("event_key", "sensor", "tier")


@query("eligible_neighbors", f""", {ROLLUP}, e AS (SELECT * FROM rollup WHERE n % 3 > 0) SELECT customer_id, period, strftime(bucket, '%Y-%m-%d') AS bucket, strftime((SELECT max(bucket) FROM e WHERE e.customer_id = q.customer_id AND e.period = q.period AND e.bucket < q.bucket), '%Y-%m-%d') AS previous_bucket,
    strftime((SELECT min(bucket) FROM e WHERE e.customer_id = q.customer_id AND e.period = q.period AND e.bucket > q.bucket), '%Y-%m-%d') AS next_bucket FROM rollup q""", "baseline")
def _(spark, d):
    rows = a.bucket_rollup(v.baseline(spark, d))
    out = r.eligible_neighbors(rows, rows.where("n % 3 > 0"))
    return out.select("customer_id", "period", *(F.col(c).cast("string").alias(c) for c in ("bucket", "previous_bucket", "next_bucket")))


@query("redact_restore_scopes", "SELECT p_partkey, 'h a@b.co and 10.0.0.' || p_partkey % 9 || ' <<REDACTED_MAC_F1_002>>' AS text FROM part")
def _(spark, d):
    ip = F.concat(F.lit("10.0.0."), (F.col("p_partkey") % 9).cast("string"))
    known = F.create_map(F.lit("a@b.co"), F.lit("<<REDACTED_EMAIL_E3_001>>"), ip, F.lit("<<REDACTED_IP_R12_004>>"))
    text = F.lit("h <<REDACTED_EMAIL_E3_001>> and <<REDACTED_IP_R12_004>> <<REDACTED_MAC_F1_002>>")
    return v.table(spark, d, "part").select("p_partkey", x.restore_scoped(text, known).alias("text"))


@query("evidence_order", "SELECT event_id FROM events WHERE event_id % 4 = 1 ORDER BY ts DESC, event_id LIMIT 15")
def _(spark, d):
    kind = F.get(F.array(*map(F.lit, k.CLASSES)), ((F.col("event_id") + 3) % 4).cast("int"))
    rows = v.table(spark, d, "events").select("event_id", kind.alias("class"), F.col("ts").alias("checked_at")).where("class is not null")
    return k.ordered_evidence(rows).limit(15).select("event_id")


@query("story_page_all_keys", f""", c AS (SELECT *, {RANK} AS rank FROM (SELECT * EXCLUDE (rn) FROM (SELECT *, row_number() OVER (PARTITION BY story_id ORDER BY received_at DESC, story_version DESC) AS rn FROM incident) WHERE rn = 1) JOIN (SELECT story_id, tier, severity, likelihood FROM story_result WHERE generation = 1 AND model = 'm' || (story_id % 3) AND NOT superseded) USING (story_id))
    SELECT story_id, tier, severity, likelihood FROM c WHERE (rank, severity, likelihood) < (2, 80, 40) OR ((rank, severity, likelihood) = (2, 80, 40) AND (window_end < TIMESTAMP '2024-01-10' OR (window_end = TIMESTAMP '2024-01-10' AND story_id > 50))) ORDER BY rank DESC, severity DESC, likelihood DESC, window_end DESC, story_id LIMIT 25""".replace(", c AS", ", c AS", 1), "incident", "story_result")
def _(spark, d):
    results = v.story_result(spark, d).where("generation = 1 AND model = concat('m', story_id % 3) AND NOT superseded").select("story_id", "tier", "severity", "likelihood")
    rows = s.canonical_story(v.incident(spark, d)).join(results, "story_id").withColumn("rank", s.tier_rank())
    order = [("rank", True), ("severity", True), ("likelihood", True), ("window_end", True), ("story_id", False)]
    return s.page(rows, order, [2, 80, 40, F.lit("2024-01-10").cast("timestamp_ntz"), 50], 25).select("story_id", "tier", "severity", "likelihood")


@query("factor_report", "SELECT p_partkey, CASE WHEN p_partkey % 2 = 0 THEN 'a|b|c|d|e' ELSE 'insufficient evidence' END AS kept, CASE WHEN p_partkey % 2 = 0 THEN 2 ELSE 3 END AS dropped, CASE WHEN p_partkey % 2 = 0 THEN 1 ELSE 0 END AS truncated FROM part")
def _(spark, d):
    factors = F.when(F.col("p_partkey") % 2 == 0, F.split(F.lit("The x|a| |b|c|d|e|f"), r"\|")).otherwise(F.array(F.lit("This y"), F.lit("z" * 81), F.lit("")))
    rows = v.table(spark, d, "part").select("p_partkey", w.factor_report(factors).alias("r"))
    return rows.select("p_partkey", F.array_join("r.kept", "|").alias("kept"), "r.dropped", "r.truncated")


@query("redact_masked_facts", "SELECT p_partkey, 'x [redacted] <<REDACTED_IP_E1_002>> [redacted]' || p_partkey AS text FROM part")
def _(spark, d):
    text = F.concat(F.lit("x <<REDACTED_IP_F1_002>> <<REDACTED_IP_E1_002>> <<REDACTED_MAC_F20_1000>>"), F.col("p_partkey").cast("string"))
    return v.table(spark, d, "part").select("p_partkey", x.mask_facts(text).alias("text"))


@query("report_list", f""", {ROLLUP}, q AS (SELECT period, bucket, last_received AS updated_at, CASE WHEN customer_id % 2 = 0 THEN 'UTC' ELSE 'Asia/Seoul' END AS zone, customer_id FROM rollup UNION ALL SELECT DISTINCT 'LIVE', DATE '1970-01-01', TIMESTAMP '2024-01-31', 'UTC', customer_id FROM rollup)
    SELECT period, CAST(nth AS INTEGER) AS nth, strftime(bucket, '%Y-%m-%d') AS bucket, zone, customer_id FROM (SELECT *, row_number() OVER (PARTITION BY period ORDER BY bucket DESC, updated_at DESC, zone, customer_id) AS nth FROM q) WHERE nth <= CASE period WHEN 'LIVE' THEN 1 WHEN 'DAILY' THEN 14 WHEN 'WEEKLY' THEN 8 ELSE 12 END""", "baseline")
def _(spark, d):
    zone = F.when(F.col("customer_id") % 2 == 0, "UTC").otherwise("Asia/Seoul").alias("zone")
    rows = a.bucket_rollup(v.baseline(spark, d))
    live = rows.select("customer_id").distinct().select(F.lit("LIVE").alias("period"), F.lit("1970-01-01").cast("date").alias("bucket"), F.lit("2024-01-31").cast("timestamp_ntz").alias("updated_at"), F.lit("UTC").alias("zone"), "customer_id")
    rows = rows.select("period", "bucket", F.col("last_received").alias("updated_at"), zone, "customer_id").unionByName(live)
    return r.report_list(rows, {"LIVE": 1, "DAILY": 14, "WEEKLY": 8, "MONTHLY": 12}).select("period", "nth", F.col("bucket").cast("string").alias("bucket"), "zone", "customer_id")


@query("creation_floors", """SELECT c_custkey AS group_id, period, strftime(date_trunc(unit, TIMESTAMP '2024-01-01 16:00:00' + INTERVAL 1 DAY * (c_custkey % 90) + INTERVAL 9 HOUR * (c_custkey % 2)), '%Y-%m-%d') AS floor FROM customer, (VALUES ('DAILY', 'day'), ('WEEKLY', 'week'), ('MONTHLY', 'month')) u(period, unit)""")
def _(spark, d):
    created = F.lit("2024-01-01 16:00:00").cast("timestamp_ntz") + F.make_dt_interval(days=(F.col("c_custkey") % 90).cast("int"))
    groups = v.table(spark, d, "customer").select(F.col("c_custkey").alias("group_id"), created.alias("created_at"), F.when(F.col("c_custkey") % 2 == 0, "UTC").otherwise("Asia/Seoul").alias("zone"))
    return w.creation_floors(groups).withColumn("floor", F.col("floor").cast("string"))


@query("indicators_in_payloads", "SELECT DISTINCT event_id, 'DOMAIN' AS entity, 'h' || event_id % 97 || '.bad.test' AS value FROM events UNION ALL SELECT event_id, 'IP', '9.8.7.' || event_id % 256 FROM events")
def _(spark, d):
    payload = F.expr("concat('{\"a\":{\"host\":\"H', event_id % 97, '.bad.test\",\"n\":1},\"b\":[\"x\",[\"9.8.7.', event_id % 256, '\"]]}')")
    leaves = o.string_leaves(v.table(spark, d, "events").select("event_id", payload.alias("payload")), "event_id", "payload")
    return k.extract_all(leaves, "event_id", "leaf").select("event_id", "entity", "value").distinct()
