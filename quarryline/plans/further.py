"""More queries of the catalog: file parsers, redaction, lineage, groups, and work planning. Importing this registers them."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from quarryline.functions import semantics as s
from quarryline.operators import intel as i
from quarryline.operators import lineage as g
from quarryline.operators import redaction as x
from quarryline.operators import workflow as w
from quarryline.operators.intel import EMAIL, IPV4
from quarryline.plans.catalog import DAY, NOW, PIVOT, query, with_live
from quarryline.sources import feeds as f
from quarryline.sources import views as v

K = "p_partkey"
IP = f"concat_ws('.', CAST(5 + {K} % 200 AS STRING), CAST({K} % 251 AS STRING), CAST({K} % 7 AS STRING), CAST({K} % 256 AS STRING))"
#: Lines of feed files, made from parts; the same expression serves Spark and the oracles.
LIST = f"CASE {K} % 5 WHEN 0 THEN concat('# ', {K}) WHEN 1 THEN '  ' WHEN 2 THEN concat('  hxxp://bad[.]test/', {K}, ' ') WHEN 3 THEN concat('; x', {K}) ELSE {IP} END"
URLS = f"""CASE WHEN {K} % 9 = 0 THEN concat('"', {K}, '","x"') WHEN {K} % 4 = 0 THEN concat('"', {K}, '","2024-01-01","http://', {IP}, '/p","online"')
    ELSE concat('"', {K}, '","2024-01-01","http://H', {K} % 50, '.bad.test/p', {K}, '","online"') END"""
HASHES = f"""CASE WHEN {K} % 8 = 0 THEN '# head' ELSE concat('"2024-01-01","u","exe","', md5(CAST({K} AS STRING)), '","', CASE WHEN {K} % 3 = 0 THEN '' ELSE md5(CAST({K} + 1 AS STRING)) END, '","n"') END"""
RANGES = f"CASE WHEN {K} % 6 = 0 THEN '; comment' WHEN {K} % 7 = 0 THEN concat({IP}, ' ; none') ELSE concat({IP}, '/24 ; SBL', {K}) END"
RANGES_JSON = f"""CASE WHEN {K} % 6 = 0 THEN '{{"type":"metadata"}}' WHEN {K} % 7 = 0 THEN 'no json' ELSE concat('{{"cidr":"', {IP}, '/24","id":"SBL', {K}, '"}}') END"""
SCORES = f"CASE WHEN {K} % 11 = 0 THEN '#model' WHEN {K} % 13 = 0 THEN 'cve,epss,percentile' WHEN {K} % 17 = 0 THEN 'CVE-2020-1,0.5,0.5' ELSE concat('cve-2020-', 10000 + {K}, ',0.', {K} % 8, ',0.5') END"
TYPED = f"concat({IP}, ',', CASE {K} % 4 WHEN 0 THEN 'ip' WHEN 1 THEN 'IP' WHEN 2 THEN 'domain' ELSE 'other' END, ',', CASE WHEN {K} % 3 = 0 THEN 'low' ELSE 'high' END)"


def _lines(spark, d, expression):
    return v.table(spark, d, "part").selectExpr(f"{expression} AS value")


def _oracle(expression: str, sql: str) -> str:
    return f"WITH lines AS (SELECT trim({expression}) AS value FROM part) {sql}"


@query("feed_generic_list", _oracle(LIST, r"SELECT replace(replace(value, 'hxxp', 'http'), '[.]', '.') AS indicator FROM lines WHERE value <> '' AND value[1] NOT IN ('#', ';')"))
def _(spark, d):
    return f.generic_list(_lines(spark, d, LIST), fanged=False)


@query("feed_url_csv", _oracle(URLS, rf""", u AS (SELECT regexp_extract(value, '^"[^"]*","[^"]*","([^"]*)"', 1) AS url FROM lines WHERE value LIKE '%http%')
    SELECT DISTINCT * FROM (SELECT 'URL' AS entity, url AS indicator FROM u UNION ALL SELECT 'DOMAIN', h FROM (SELECT lower(regexp_extract(url, '://([^/]+)', 1)) AS h FROM u) WHERE NOT regexp_full_match(h, '{IPV4}'))"""))
def _(spark, d):
    return f.url_rows(_lines(spark, d, URLS))


@query("feed_payload_hashes", _oracle(HASHES, "SELECT indicator FROM (SELECT unnest(regexp_extract_all(value, '[0-9a-f]{32}')) AS indicator FROM lines WHERE value NOT LIKE '#%')"))
def _(spark, d):
    return f.payload_hashes(_lines(spark, d, HASHES))


@query("feed_drop_ranges", _oracle(RANGES, "SELECT trim(split_part(value, ';', 1)) AS cidr FROM lines WHERE value NOT LIKE ';%' AND value LIKE '%/%'"))
def _(spark, d):
    return f.drop_ranges(_lines(spark, d, RANGES))


@query("feed_drop_ranges_json", _oracle(RANGES_JSON, "SELECT cidr FROM (SELECT CASE WHEN json_valid(value) THEN json_extract_string(value, '$.cidr') END AS cidr FROM lines) WHERE cidr IS NOT NULL"))
def _(spark, d):
    return f.drop_ranges_json(_lines(spark, d, RANGES_JSON))


@query("feed_typed_columns", _oracle(TYPED, """SELECT DISTINCT CASE WHEN lower(split_part(value, ',', 2)) = 'ip' THEN 'IP' ELSE 'DOMAIN' END AS entity, split_part(value, ',', 1) AS indicator
    FROM lines WHERE split_part(value, ',', 3) = 'high' AND lower(split_part(value, ',', 2)) IN ('ip', 'domain')"""))
def _(spark, d):
    return f.typed_columns(_lines(spark, d, TYPED), 3, 0, 1, {"ip": "IP", "domain": "DOMAIN"}, {2: ["high"]})


@query("feed_exploit_scores", _oracle(SCORES, "SELECT upper(split_part(value, ',', 1)) AS cve, CAST(split_part(value, ',', 2) AS DOUBLE) AS score FROM lines WHERE value LIKE 'cve-%'"))
def _(spark, d):
    return f.exploit_scores(_lines(spark, d, SCORES))


@query("feed_free_text", rf"""WITH a AS (SELECT doc_id, text, regexp_replace(text, '{f.URL}', ' ', 'g') AS t FROM documents), b AS (SELECT *, regexp_replace(t, '{f.HEX}', ' ', 'g') AS u FROM a)
    SELECT DISTINCT * FROM (SELECT doc_id, 'URL' AS entity, regexp_replace(unnest(regexp_extract_all(text, '{f.URL}')), '[.,;:)\]]+$', '') AS indicator FROM a
    UNION ALL SELECT doc_id, 'HASH', lower(unnest(regexp_extract_all(t, '{f.HEX}'))) FROM b UNION ALL SELECT doc_id, 'IP', unnest(regexp_extract_all(u, '{IPV4}')) FROM b)""")
def _(spark, d):
    return f.free_text(v.table(spark, d, "documents"), "doc_id", "text")


LISTS = """concat('{"name":"L', n_nationkey, '","type":"', CASE n_nationkey % 3 WHEN 0 THEN 'cidr' WHEN 1 THEN 'string' ELSE 'regex' END, '","list":["10.0.', n_nationkey, '.0/24","10.0.0.', n_nationkey, '"]}')"""


@query("feed_warning_lists", """SELECT 'L' || n_nationkey AS name, '10.0.' || n_nationkey || '.0/24' AS cidr, NULL AS ip FROM nation WHERE n_nationkey % 3 = 0 UNION ALL
    SELECT 'L' || n_nationkey, '10.0.0.' || n_nationkey, NULL FROM nation WHERE n_nationkey % 3 = 0 UNION ALL SELECT 'L' || n_nationkey, NULL, '10.0.0.' || n_nationkey FROM nation WHERE n_nationkey % 3 = 1""")
def _(spark, d):
    return f.warning_lists(v.table(spark, d, "nation").selectExpr(f"{LISTS} AS value"))


_TREE_HASH = "(SELECT source, p, n::VARCHAR AS h, n FROM (SELECT source, sha256(cve || ':' || kev) AS p, count(*) AS n FROM cve GROUP BY ALL))"
for _length in f.LEVELS:
    _TREE_HASH = f"(SELECT source, substring(p, 1, {_length}) AS p, sha256(string_agg(p || ':' || h, ',' ORDER BY p || ':' || h)) AS h, sum(n)::BIGINT AS n FROM {_TREE_HASH} GROUP BY source, substring(p, 1, {_length}))"


@query("feed_fingerprint", f"SELECT source, n, h AS digest FROM {_TREE_HASH}", "cve")
def _(spark, d):
    return f.fingerprint(v.cve(spark, d), ["source"], F.concat_ws(":", "cve", F.col("kev").cast("string")))


@query("feed_replace_source", """SELECT source, count(*) AS n, count(hit_type) AS hits FROM (SELECT 's' || p_partkey % 3 AS source, 'ioc' AS hit_type FROM part WHERE p_partkey % 3 <> 1
    UNION ALL SELECT 's1', CASE WHEN s_suppkey % 2 = 0 THEN 'ioc' END FROM supplier) GROUP BY source""")
def _(spark, d):
    held = v.table(spark, d, "part").select(F.concat(F.lit("s"), (F.col(K) % 3).cast("string")).alias("source"), F.col(K).cast("string").alias("indicator"), F.lit(False).alias("negative"), F.lit("ioc").alias("hit_type"))
    new = v.table(spark, d, "supplier").select(F.col("s_suppkey").cast("string").alias("indicator"), (F.col("s_suppkey") % 2 != 0).alias("negative"), F.lit("ioc").alias("hit_type"))
    return f.replace_source(held, "s1", new).groupBy("source").agg(F.count("*").alias("n"), F.count("hit_type").alias("hits"))


#: Redaction of one kind in DuckDB: {0} the text, {1} the pattern, {2} the kind, {3} which matches count.
STEP = """array_to_string(list_transform(list_zip(string_split_regex({0}, '{1}'), list_transform(regexp_extract_all({0}, '{1}'), lambda m: CASE WHEN {3} THEN
    '<<REDACTED_{2}_' || lpad(CAST(list_position(list_filter(list_filter(regexp_extract_all({0}, '{1}'), lambda m: {3}), lambda m, i:
    list_position(list_filter(regexp_extract_all({0}, '{1}'), lambda m: {3}), m) = i), m) AS VARCHAR), 3, '0') || '>>' ELSE m END)), lambda z: z[1] || coalesce(z[2], '')), '')"""
PRIVATE = r"regexp_matches(m, '^(10\.|127\.|192\.168\.|169\.254\.|172\.(1[6-9]|2[0-9]|3[01])\.)')"
REDACTED = f"""WITH a AS (SELECT doc_id, text, {STEP.format("text", EMAIL, "EMAIL", "TRUE")} AS t FROM documents WHERE text IS NOT NULL), b AS (SELECT doc_id, text, {STEP.format("t", IPV4, "IP", PRIVATE)} AS t FROM a)"""


def _documents(spark, d):
    return v.table(spark, d, "documents").where("text is not null").select("doc_id", "text", F.col("text").alias("original"), F.expr(x.EMPTY).alias("known"))


@query("redact_documents", REDACTED + " SELECT doc_id, sha256(t) AS digest, len(regexp_extract_all(t, '<<REDACTED_')) AS tokens FROM b")
def _(spark, d):
    out = x.redact(_documents(spark, d))
    return out.select("doc_id", F.sha2("text", 256).alias("digest"), F.size(F.regexp_extract_all("text", F.lit("<<REDACTED_"), F.lit(0))).cast("long").alias("tokens"))


@query("redact_restore", "SELECT doc_id, TRUE AS same FROM documents WHERE text IS NOT NULL")
def _(spark, d):
    out = x.redact(_documents(spark, d))
    return out.select("doc_id", (x.restore(F.col("text"), F.col("known")) == F.col("original")).alias("same"))


@query("redact_verify_answer", f"SELECT doc_id, len(regexp_extract_all(text, '{EMAIL}')) + len(list_filter(regexp_extract_all(text, '{IPV4}'), lambda m: {PRIVATE})) AS unverified FROM documents WHERE text IS NOT NULL")
def _(spark, d):
    return x.verify_answer(_documents(spark, d)).select("doc_id", F.col("unverified").cast("long").alias("unverified"))


@query("redact_leaks", REDACTED + f""" SELECT doc_id, CAST(0 AS BIGINT) AS unmapped, len(regexp_extract_all(t, '{x.TOKEN}')) AS residual, CAST(0 AS BIGINT) AS unknown_kind, CAST(0 AS BIGINT) AS plain FROM b""")
def _(spark, d):
    out = x.redact(_documents(spark, d)).withColumn("allowed", F.array(F.lit("")))
    return x.leaks(out, "doc_id", "text", "allowed").select("doc_id", *(F.col(c).cast("long").alias(c) for c in ("unmapped", "residual", "unknown_kind", "plain")))


@query("redact_story_scope", REDACTED + rf" SELECT doc_id, sha256(regexp_replace(t, '{x.TOKEN}', '<<REDACTED_\1_E' || (doc_id % 10) || '_\2>>', 'g')) AS digest FROM b")
def _(spark, d):
    out = x.redact(_documents(spark, d))
    return out.select("doc_id", F.sha2(x.to_scope(F.col("text"), "E", F.col("doc_id") % 10), 256).alias("digest"))


@query("redact_stale_rows", """SELECT 'result' AS table_name, count(*) AS n FROM result WHERE 'm' || event_key % 3 <> 'm1' UNION ALL SELECT 'story', count(*) FROM story WHERE story_version <> 'm1'""", "result", "story")
def _(spark, d):
    tables = {"result": v.result(spark, d).select(F.col("model").alias("policy")), "story": v.story(spark, d).select(F.col("story_version").alias("policy"))}
    return x.stale(tables, "policy", "m1")


@query("canonical_members", """SELECT story_id, count(*) AS n, count(event_time) AS matched, strftime(max(event_time), '%Y-%m-%d %H:%M:%S') AS last_event FROM member LEFT JOIN
    (SELECT event_key, event_time FROM latest) ON event_key = member_key GROUP BY story_id""", "latest", "member")
def _(spark, d):
    rows = g.members_with_events(v.member(spark, d), v.baseline(spark, d))
    return rows.groupBy("story_id").agg(F.count("*").alias("n"), F.count("event_time").alias("matched"), F.date_format(F.max("event_time"), "yyyy-MM-dd HH:mm:ss").alias("last_event"))


@query("member_quality", """SELECT count(*) AS members, count(*) FILTER (WHERE k IS NULL) AS unmatched, count(*) FILTER (WHERE k > 1) AS over_matched FROM member LEFT JOIN
    (SELECT event_key, count(*) AS k FROM baseline GROUP BY event_key) ON event_key = member_key""", "baseline", "member")
def _(spark, d):
    return g.member_quality(v.member(spark, d), v.baseline(spark, d))


@query("stories_of_event", "SELECT member_key AS event_key, count(DISTINCT story_id) AS stories, min(story_id) AS first_story FROM member WHERE member_key IN (SELECT event_key FROM baseline) GROUP BY member_key", "baseline", "member")
def _(spark, d):
    return g.stories_of(v.member(spark, d), v.baseline(spark, d))


@query("event_lookup", "SELECT event_key, baseline_version, category FROM latest WHERE event_key IN (SELECT s_suppkey FROM supplier)", "latest")
def _(spark, d):
    return g.newest_row(v.baseline(spark, d), v.table(spark, d, "supplier").select(F.col("s_suppkey").alias("event_key"))).select("event_key", "baseline_version", "category")


def _citations(spark, d):
    kind = F.when(F.col("member_no") % 3 == 0, "story").when(F.col("member_no") == 7, "note").otherwise("event")
    place = F.row_number().over(Window.partitionBy("story_id").orderBy("member_no", "member_key"))
    return v.member(spark, d).select(F.col("story_id").alias("report"), place.alias("position"), kind.alias("kind"), F.col("member_key").alias("source"))


CITED = "cited AS (SELECT story_id AS report, row_number() OVER (PARTITION BY story_id ORDER BY member_no, member_key) AS position, CASE WHEN member_no % 3 = 0 THEN 'story' WHEN member_no = 7 THEN 'note' ELSE 'event' END AS kind, member_key AS source FROM member)"


@query("citation_integrity", f", {CITED} SELECT report, position, kind, source, CASE WHEN kind = 'note' THEN 'malformed' ELSE 'not_allowed' END AS reason FROM cited WHERE kind = 'note' OR source % 5 = 0", "member")
def _(spark, d):
    c = _citations(spark, d)
    return g.invalid_citations(c, c.where("source % 5 <> 0"))


@query("citation_mismatches", f""", {CITED} SELECT report, position, CASE WHEN position = 6 THEN 'count' WHEN kind = 'note' THEN 'type' ELSE 'source' END AS mismatch FROM cited
    WHERE position = 6 OR kind = 'note' OR source % 10 = 0""", "member")
def _(spark, d):
    c = _citations(spark, d)
    other = c.where("position <> 6").select("report", "position", F.when(F.col("kind") == "note", "event").otherwise(F.col("kind")).alias("kind"), F.when(F.col("source") % 10 == 0, -1).otherwise(F.col("source")).alias("source"))
    return g.citation_mismatches(c, other)


@query("preferred_model", with_live("SELECT sensor, event_key, model FROM (SELECT *, row_number() OVER (PARTITION BY sensor, event_key % 100 ORDER BY CASE model WHEN 'm2' THEN 1 ELSE 2 END, event_key) AS rn FROM live WHERE model IN ('m2', 'm0')) WHERE rn = 1"), "result")
def _(spark, d):
    rows = s.live(v.result(spark, d)).withColumn("slot", F.col("event_key") % 100)
    return g.preferred(rows, ["sensor", "slot"], ["m2", "m0"], [F.asc("event_key")]).select("sensor", "event_key", "model")


@query("pinned_references", "SELECT story_id AS report, member_no AS position, member_key FROM member WHERE story_id NOT IN (SELECT story_id FROM member WHERE member_key NOT IN (SELECT p_partkey FROM part WHERE p_size > 5))", "member")
def _(spark, d):
    refs = v.member(spark, d).select(F.col("story_id").alias("report"), F.col("member_no").alias("position"), "member_key")
    return g.pinned(refs, v.table(spark, d, "part").where("p_size > 5").select(F.col(K).alias("member_key")), "member_key").select("report", "position", "member_key")


@query("policy_agreement", """, m AS (SELECT story_id, CAST(member_no AS BIGINT) * 1000000000 + member_key AS member_no, CASE WHEN member_key % 40 = 0 THEN '' WHEN member_key % 30 = 0 THEN 'p2' ELSE 'p1' END AS p FROM member), o AS (SELECT story_id, min_by(p, member_no) AS p0 FROM m GROUP BY story_id),
    q AS (SELECT story_id, any_value(p0) AS p0, min(CASE WHEN p = '' THEN member_no END) AS e, min(CASE WHEN p <> '' AND p <> p0 THEN member_no END) AS x FROM m JOIN o USING (story_id) GROUP BY story_id)
    SELECT story_id, CASE WHEN e IS NOT NULL AND (x IS NULL OR e < x) THEN 'missing' WHEN x IS NOT NULL THEN 'mismatched' ELSE 'ok' END AS state, CASE WHEN e IS NULL AND x IS NULL THEN p0 END AS version FROM q""", "member")
def _(spark, d):
    version = F.when(F.col("member_key") % 40 == 0, "").when(F.col("member_key") % 30 == 0, "p2").otherwise("p1")
    return g.policy_agreement(v.member(spark, d).select("story_id", (F.col("member_no").cast("long") * 1000000000 + F.col("member_key")).alias("place"), version.alias("policy")), ["story_id"], "place", "policy")


def _members(spark):
    return spark.range(5).selectExpr("id % 2 AS group_id", "id AS customer_id", "CASE WHEN id <> 3 THEN 10 * id + 10 END AS analysis_days", "25L AS ingestion_days")


MEMBERS = "mem AS (SELECT i % 2 AS group_id, i AS customer_id, CASE WHEN i <> 3 THEN 10 * i + 10 END AS analysis_days, 25 AS ingestion_days FROM range(5) t(i))"
ZONED = f"""{MEMBERS}, ev AS (SELECT group_id, event_time + INTERVAL 9 HOUR * group_id AS t FROM baseline JOIN mem USING (customer_id)), gb AS (SELECT group_id, period, CAST(date_trunc(unit, t) AS DATE) AS bucket, count(*) AS events
    FROM ev, (VALUES ('DAILY', 'day'), ('WEEKLY', 'week'), ('MONTHLY', 'month')) p(period, unit) WHERE date_trunc(unit, t) >= date_trunc(unit, DATE '2024-01-10') GROUP BY ALL)"""


def _group_buckets(spark, d):
    zones = spark.range(2).selectExpr("id AS group_id", "CASE id WHEN 0 THEN 'UTC' ELSE 'Asia/Tokyo' END AS zone", "DATE'2024-01-10' AS floor")
    return w.group_buckets(v.baseline(spark, d), _members(spark).select("group_id", "customer_id"), zones)


@query("group_buckets", f", {ZONED} SELECT group_id, period, strftime(bucket, '%Y-%m-%d') AS bucket, events FROM gb", "baseline")
def _(spark, d):
    return _group_buckets(spark, d).select("group_id", "period", F.date_format("bucket", "yyyy-MM-dd").alias("bucket"), "events")


@query("group_readiness", f""", {ZONED} SELECT group_id, period, strftime(bucket, '%Y-%m-%d') AS bucket, events, CASE WHEN day(bucket) % 2 <> 0 THEN 'seed' WHEN day(bucket) % 4 <> 0 THEN 'keep' WHEN day(bucket) % 3 = 0 THEN 'dirty' ELSE 'patch' END AS action FROM gb""", "baseline")
def _(spark, d):
    b = _group_buckets(spark, d)
    day = F.dayofmonth("bucket")
    existing = b.where(day % 2 == 0).select("group_id", "period", "bucket", (F.col("events") - F.when(day % 4 == 0, 1).otherwise(0)).alias("events"), F.when(day % 3 == 0, "ready").otherwise("pending").alias("status"))
    return w.group_actions(b, existing).withColumn("bucket", F.date_format("bucket", "yyyy-MM-dd"))


@query("group_retention", """SELECT group_id, least(CASE WHEN group_id % 3 = 0 THEN 30 + group_id END, min(CASE WHEN a IS NOT NULL THEN greatest(a, i) END)) AS ingestion_bound, least(CASE WHEN group_id % 3 = 0 THEN 30 + group_id END, min(a)) AS analysis_bound
    FROM (SELECT n_nationkey AS group_id, 20 + c_custkey % 50 AS i, CASE WHEN c_custkey % 4 > 0 THEN 15 + c_custkey % 90 END AS a FROM nation LEFT JOIN customer ON c_nationkey = n_nationkey AND c_nationkey % 5 > 0) GROUP BY group_id""")
def _(spark, d):
    groups = v.table(spark, d, "nation").selectExpr("n_nationkey AS group_id", "CASE WHEN n_nationkey % 3 = 0 THEN 30 + n_nationkey END AS policy_days")
    members = v.table(spark, d, "customer").where("c_nationkey % 5 > 0").selectExpr("c_nationkey AS group_id", "20 + c_custkey % 50 AS ingestion_days", "CASE WHEN c_custkey % 4 > 0 THEN 15 + c_custkey % 90 END AS analysis_days")
    bound = lambda ingestion, name: w.retention_bounds(members, groups, ingestion).withColumnRenamed("bound_days", name)
    return bound(True, "ingestion_bound").join(bound(False, "analysis_bound"), "group_id")


@query("group_monthly_cost", f""", {MEMBERS} SELECT group_id, events, events * 12 + members * 20000 AS tokens, round((events * 12 + members * 20000) / 1000 * 0.01, 2) AS dollars FROM (SELECT group_id, (SELECT count(*) FROM latest l JOIN mem k USING (customer_id)
    WHERE k.group_id = m.group_id AND event_time < TIMESTAMP '{NOW}' AND event_time >= TIMESTAMP '{NOW}' - INTERVAL 30 DAY) AS events, count(*) AS members FROM mem m GROUP BY group_id)""", "latest")
def _(spark, d):
    return w.monthly_cost(s.latest_baseline(v.baseline(spark, d)), _members(spark), NOW)


@query("accessible_customers", """SELECT account, customer_id, string_agg(DISTINCT role, ',' ORDER BY role) AS roles FROM (SELECT o_custkey % 50 AS account, o_custkey AS customer_id, 'r' || o_orderkey % 3 AS role FROM orders
    UNION ALL SELECT c_nationkey, c_custkey, 'manager' FROM customer) GROUP BY account, customer_id""")
def _(spark, d):
    held = v.table(spark, d, "orders").selectExpr("CAST(o_custkey % 50 AS BIGINT) AS account", "o_custkey AS customer_id", "concat('r', o_orderkey % 3) AS role")
    return w.accessible(held, v.table(spark, d, "customer").selectExpr("CAST(c_nationkey AS BIGINT) AS account", "c_custkey AS customer_id", "'manager' AS role"))


@query("enabled_sources", "SELECT c_custkey AS subject, CASE WHEN c_custkey % 3 = 0 THEN 'kev' WHEN c_custkey % 3 = 1 THEN 'nvd,epss' ELSE 'nvd,epss' END AS sources FROM customer")
def _(spark, d):
    subjects = v.table(spark, d, "customer").select(F.col("c_custkey").alias("subject"))
    chosen = subjects.where("subject % 3 < 2").select("subject", F.when(F.col("subject") % 3 == 0, F.array(F.lit("old"), F.lit("kev"))).otherwise(F.array(F.lit("old"))).alias("sources"))
    return w.enabled_sources(subjects, chosen, ["nvd", "gone", "epss"], ["nvd", "kev", "epss"]).withColumn("sources", F.array_join("sources", ","))


@query("sticky_evidence", """SELECT p_partkey AS subject, p_partkey % 3 = 0 OR p_partkey % 4 = 0 AS hit, CASE WHEN p_partkey % 4 = 0 THEN 'new' WHEN p_partkey % 3 = 0 THEN 'old' END AS floor FROM part""")
def _(spark, d):
    p = v.table(spark, d, "part").select(F.col(K).alias("subject"))
    side = lambda n, name: p.select("subject", (F.col("subject") % n == 0).alias("hit"), F.when(F.col("subject") % n == 0, name).alias("floor"))
    return w.sticky_evidence(side(3, "old"), side(4, "new"))


@query("result_supersede", f"SELECT generation, count(*) AS n, count(superseded_at) AS stamped FROM (SELECT 1 AS generation, CASE WHEN event_id % 3 = 0 THEN TIMESTAMP '{NOW}' END AS superseded_at FROM events UNION ALL SELECT 2, NULL FROM events WHERE event_id % 3 = 0) GROUP BY generation")
def _(spark, d):
    e = v.table(spark, d, "events").select(F.col("event_id").alias("event_key"), F.col("event_type").alias("payload"))
    held = e.select("*", F.lit(1).alias("generation"), F.lit(None).cast("timestamp_ntz").alias("superseded_at"))
    out = w.supersede(held, e.where("event_key % 3 = 0"), ["event_key"], F.lit(NOW).cast("timestamp_ntz"))
    return out.groupBy("generation").agg(F.count("*").alias("n"), F.count("superseded_at").alias("stamped"))


@query("withdraw_counts", "SELECT count(*) FILTER (WHERE p_partkey IN (SELECT event_id FROM events)) AS withdrawn, count(*) FILTER (WHERE p_partkey NOT IN (SELECT event_id FROM events)) AS not_found, count(*) FILTER (WHERE p_partkey % 7 = 0) AS repeated FROM part")
def _(spark, d):
    p = v.table(spark, d, "part").select(F.col(K).alias("event_key"))
    return w.withdraw(v.baseline(spark, d), p.union(p.where("event_key % 7 = 0")), ["event_key"])[1]


@query("retry_due", f"SELECT event_id AS job, event_id % 8 AS attempts FROM events WHERE event_id % 8 = 0 OR ts + INTERVAL 1 SECOND * (30 * (1 << CAST(greatest(0, least(event_id % 8 - 1, 5)) AS BIGINT))) <= TIMESTAMP '{DAY}'")
def _(spark, d):
    jobs = v.table(spark, d, "events").select(F.col("event_id").alias("job"), (F.col("event_id") % 8).alias("attempts"), F.col("ts").alias("updated_at"))
    return w.retry_due(jobs, DAY).select("job", "attempts")


@query("cursor_watermark", """SELECT subject, strftime(t, '%Y-%m-%d %H:%M') AS reached, CASE WHEN bool_or(strict) THEN 'strict' ELSE 'soft' END AS quality FROM (SELECT user_id AS subject, date_trunc('day', ts) AS t, event_id % 3 = 0 AS strict,
    max(date_trunc('day', ts)) OVER (PARTITION BY user_id) AS top FROM events) WHERE t = top GROUP BY subject, t""")
def _(spark, d):
    marks = v.table(spark, d, "events").select(F.col("user_id").alias("subject"), F.date_trunc("day", "ts").alias("at"), F.when(F.col("event_id") % 3 == 0, "strict").otherwise("soft").alias("quality"))
    return w.watermark(marks).select("subject", F.date_format("at", "yyyy-MM-dd HH:mm").alias("reached"), "quality")


@query("job_seeds", """SELECT o_orderkey AS subject, l AS language, CASE WHEN o_orderkey % 4 = 1 AND l = 'EN' THEN 2 ELSE 1 END AS generation FROM orders, (VALUES ('EN'), ('KO')) t(l)
    WHERE o_orderkey % 4 <> 0 AND NOT (l = 'EN' AND o_orderkey % 4 = 3)""")
def _(spark, d):
    o = v.table(spark, d, "orders").select(F.col("o_orderkey").alias("subject"))
    status = F.when(F.col("subject") % 4 == 0, "pending").when(F.col("subject") % 4 == 1, "dirty").otherwise("ready")
    jobs = o.where("subject % 2 = 1").select("subject", F.lit("EN").alias("language"), F.lit(1).alias("generation"))
    return w.job_seeds(o.withColumn("status", status), jobs, ["EN", "KO"])


@query("work_tiers", """SELECT customer_id, day, tier, count(*) AS n FROM (SELECT customer_id, day, CASE WHEN k = 'A' THEN 'A' WHEN k = 'B' AND row_number() OVER (PARTITION BY customer_id, day, k ORDER BY event_id) <= 10 THEN 'B' ELSE 'held' END AS tier FROM
    (SELECT event_id, user_id % 5 AS customer_id, strftime(ts, '%Y-%m-%d') AS day, CASE WHEN event_id % 11 = 0 THEN 'A' WHEN event_id % 3 = 0 THEN 'held' ELSE 'B' END AS k FROM events)) GROUP BY customer_id, day, tier""")
def _(spark, d):
    e = v.table(spark, d, "events").select(F.col("event_id").alias("event_key"), (F.col("user_id") % 5).alias("customer_id"), F.date_format("ts", "yyyy-MM-dd").alias("day"), (F.col("event_id") % 11 == 0).alias("hit"),
                                           F.lit("complete").alias("status"), F.when(F.col("event_id") % 3 == 0, "partial").otherwise("complete").alias("coverage"))
    return w.work_tiers(e, 10).groupBy("customer_id", "day", "tier").agg(F.count("*").alias("n"))


@query("kept_factors", """SELECT p_partkey AS subject, CASE WHEN p_partkey % 2 = 0 THEN 'a|b|c|d|e' ELSE 'insufficient evidence' END AS factors FROM part""")
def _(spark, d):
    factors = F.when(F.col(K) % 2 == 0, F.split(F.lit("The x|a| |b|c|d|e|f"), r"\|")).otherwise(F.array(F.lit("This y"), F.lit("z" * 81), F.lit("")))
    return v.table(spark, d, "part").select(F.col(K).alias("subject"), F.array_join(w.kept_factors(factors), "|").alias("factors"))


@query("technique_tags", """SELECT tag, CASE WHEN NOT regexp_full_match(tag, 'T[0-9]{4}') THEN 'invalid_format' WHEN tag <= 'T1050' THEN 'valid' ELSE 'unknown' END AS state, count(*) AS n
    FROM (SELECT CASE WHEN event_id % 9 = 0 THEN 'X' ELSE '' END || 'T' || (1000 + event_id % 100) AS tag FROM events) GROUP BY tag""")
def _(spark, d):
    tags = v.table(spark, d, "events").selectExpr("concat(CASE WHEN event_id % 9 = 0 THEN 'X' ELSE '' END, 'T', 1000 + event_id % 100) AS tag")
    return w.technique_tags(tags, spark.range(1000, 1051).selectExpr("concat('T', id) AS tag"))


@query("alert_summary", f"""SELECT kind, name, count(*) AS n FROM (SELECT 'severity' AS kind, CASE WHEN event_type = 'error' THEN 'high' ELSE 'low' END AS name FROM events WHERE ts >= TIMESTAMP '{DAY}' UNION ALL
    SELECT 'indicator', event_type FROM events WHERE ts >= TIMESTAMP '{DAY}') GROUP BY kind, name""")
def _(spark, d):
    alerts = v.table(spark, d, "events").select(F.col("ts").alias("at"), F.when(F.col("event_type") == "error", "high").otherwise("low").alias("severity"), F.col("event_type").alias("indicator"))
    return w.alert_summary(alerts, DAY)


@query("contains_reference", "SELECT l_orderkey AS report FROM lineitem WHERE l_partkey % 10 = 3 AND l_linenumber % 2 = 1 GROUP BY l_orderkey")
def _(spark, d):
    # One array a report, of at most its own citations: a report's size is bounded, as line numbers are.
    refs = v.member(spark, d).groupBy("story_id").agg(F.collect_list(F.struct((F.col("member_key") % 10).alias("source"), (F.col("member_no") % 2).alias("kind"))).alias("refs"))
    return refs.where(w.contains_ref(F.col("refs"), source=3, kind=1)).select(F.col("story_id").alias("report"))


PAGES = """concat('{"vulnerabilities":[{"cve":{"id":"', CASE WHEN p_partkey % 9 = 0 THEN 'bad' ELSE 'CVE-2020-' END, 10000 + p_partkey, '","published":"2020-01-01T00:00:00.000","descriptions":[{"lang":"es","value":"x"},{"lang":"en","value":"y"}],"metrics":{"',
    CASE WHEN p_partkey % 2 = 0 THEN 'cvssMetricV31' ELSE 'other' END, '":[{"type":"Secondary","cvssData":{"baseScore":1.5,"vectorString":"a"}},{"type":"Primary","cvssData":{"baseScore":', p_partkey % 10, '.5,"vectorString":"b"}}],"cvssMetricV2":[{"cvssData":{"baseScore":3.5}}]},',
    '"weaknesses":[{"description":[{"value":"CWE-79"},{"value":"NVD-CWE-Other"},{"value":"CWE-79"}]}]}}]}')"""


@query("vulnerability_pages", """SELECT 'CVE-2020-' || (10000 + p_partkey) AS cve, '2020-01-01T00:00:00.000Z' AS published, CASE WHEN p_partkey % 2 = 0 THEN p_partkey % 10 + 0.5::DOUBLE ELSE 3.5::DOUBLE END AS score,
    CASE WHEN p_partkey % 2 = 0 THEN 'b' END AS vector, 'y' AS description, 'CWE-79' AS weaknesses FROM part WHERE p_partkey % 9 <> 0""")
def _(spark, d):
    return f.vulnerability_pages(_lines(spark, d, PAGES)).withColumn("weaknesses", F.array_join("weaknesses", ","))


@query("refresh_plan", """SELECT subject, outcome, count(*) AS n FROM (SELECT subject, CASE WHEN o <> 'refreshable' THEN o WHEN row_number() OVER (PARTITION BY subject, o ORDER BY o_orderdate DESC, o_orderkey) <= 20 THEN 'refreshed' ELSE 'limited' END AS outcome FROM
    (SELECT o_orderkey, o_orderdate, o_custkey % 5 AS subject, CASE WHEN o_orderkey % 7 = 0 THEN 'source_unavailable' WHEN o_orderkey % 5 = 0 THEN 'already_queued' WHEN o_orderkey % 55 > 49 THEN 'capped' WHEN o_orderkey % 3 = 0 THEN 'gated' ELSE 'refreshable' END AS o FROM orders))
    GROUP BY subject, outcome""")
def _(spark, d):
    k = F.col("o_orderkey")
    rows = v.table(spark, d, "orders").select((F.col("o_custkey") % 5).alias("subject"), k.alias("variant"), F.col("o_orderdate").alias("bucket"), (k % 7 == 0).alias("archived"),
                                              F.when(k % 5 == 0, "queued").alias("job_status"), (k % 55).alias("generation"), (k % 3 != 0).alias("drained"))
    return w.refresh_plan(rows, 20).groupBy("subject", "outcome").agg(F.count("*").alias("n"))


@query("unreferenced_maps", """SELECT p_partkey AS event_key FROM part WHERE p_partkey NOT IN (SELECT event_key FROM baseline WHERE event_key % 2 = 0) AND p_partkey NOT IN (SELECT member_key FROM member WHERE member_key % 3 = 0)
    AND p_partkey NOT IN (SELECT event_key FROM result WHERE event_key % 5 = 0)""", "baseline", "result", "member")
def _(spark, d):
    members = v.member(spark, d).where("member_key % 3 = 0").select(F.col("member_key").alias("event_key"))
    held = [v.baseline(spark, d).where("event_key % 2 = 0"), members, v.result(spark, d).where("event_key % 5 = 0")]
    return w.unreferenced(v.table(spark, d, "part").select(F.col(K).alias("event_key")), held, ["event_key"])


@query("group_reap", f"""SELECT o_orderkey AS report FROM orders WHERE o_orderkey % 4 <> 0 AND o_custkey % 2 = 0 AND CAST(o_orderdate AS DATE) < DATE '1998-01-01' - 365""")
def _(spark, d):
    period = F.when(F.col("o_orderkey") % 4 == 0, "LIVE").otherwise("DAILY")
    reports = v.table(spark, d, "orders").select(F.col("o_orderkey").alias("report"), (F.col("o_custkey") % 2).alias("group_id"), F.col("o_orderdate").cast("date").alias("bucket"), period.alias("period"))
    return w.reap_reports(reports, spark.range(2).selectExpr("id AS group_id", "CASE id WHEN 0 THEN 365L END AS bound_days"), "1998-01-01").select("report")


@query("cve_event_selection", f"SELECT cve, CAST(NULL AS BIGINT) AS epss, published FROM {PIVOT} WHERE kev ORDER BY published DESC NULLS LAST, cve LIMIT 18", "cve")
def _(spark, d):
    return i.exploited_only(i.cve_pivot(v.cve(spark, d)), ["nvd", "kev"], 18)
