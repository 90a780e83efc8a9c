"""Queries of addresses, indicators, feeds, verdicts, vulnerabilities and redaction maps. Importing this registers them."""

from __future__ import annotations

from pyspark.sql import functions as F

from quarryline.functions import network as n
from quarryline.operators import indicators as k
from quarryline.operators import intel as i
from quarryline.operators import redaction as x
from quarryline.plans.catalog import PIVOT, query
from quarryline.sources import views as v

#: Texts made from ids; the same expression serves Spark and the oracles.
IP4 = "concat_ws('.', CAST(event_id * 7 % 256 AS STRING), CAST(event_id % 256 AS STRING), CAST(event_id * 3 % 256 AS STRING), CAST(event_id * 5 % 256 AS STRING))"
NUM4 = "(CAST(event_id * 7 % 256 AS BIGINT) * 16777216 + event_id % 256 * 65536 + event_id * 3 % 256 * 256 + event_id * 5 % 256)"
_SQL = lambda e: e.replace("STRING", "VARCHAR")


@query("addresses4", f"""SELECT event_id, printf('%08x', number) AS digits, address AS canonical, number BETWEEN 167772160 AND 184549375 OR number BETWEEN 2886729728 AND 2887778303 OR number BETWEEN 3232235520 AND 3232301055
    OR number BETWEEN 2851995648 AND 2852061183 OR number BETWEEN 2130706432 AND 2147483647 AS private FROM (SELECT event_id, {_SQL(IP4)} AS address, {NUM4} AS number FROM events)""")
def _(spark, d):
    digits = n.ip_hex(F.expr(IP4))
    return v.table(spark, d, "events").select("event_id", digits.alias("digits"), n.canonical_ip(digits).alias("canonical"), n.private(digits).alias("private"))


IP6 = """CASE event_id % 6 WHEN 0 THEN concat('2001:0DB8:0:0:', lower(hex(event_id)), '::1') WHEN 1 THEN concat('fd00::', lower(hex(event_id))) WHEN 2 THEN concat('::ffff:1.2.3.', CAST(event_id % 256 AS STRING))
    WHEN 3 THEN '::1' WHEN 4 THEN concat('1:2:3:4:5:6:7:', lower(hex(event_id)), ':9') ELSE concat('fe80:1:', lower(hex(event_id))) END"""


@query("addresses6", """SELECT event_id, CASE event_id % 6 WHEN 0 THEN '20010db800000000' || lpad(h, 4, '0') || '00000000' || '0001' WHEN 1 THEN 'fd00' || lpad(h, 28, '0') WHEN 2 THEN repeat('0', 20) || 'ffff010203' || printf('%02x', event_id % 256) WHEN 3 THEN repeat('0', 31) || '1' END AS digits,
    CASE event_id % 6 WHEN 0 THEN CASE WHEN event_id = 0 THEN '2001:db8::1' ELSE '2001:db8::' || h || ':0:0:1' END WHEN 1 THEN 'fd00::' || h WHEN 2 THEN '::ffff:102:3' || printf('%02x', event_id % 256) WHEN 3 THEN '::1' END AS canonical,
    CASE WHEN event_id % 6 IN (1, 3) THEN TRUE WHEN event_id % 6 IN (0, 2) THEN FALSE END AS private FROM (SELECT event_id, printf('%x', event_id) AS h FROM events)""")
def _(spark, d):
    rows = v.table(spark, d, "events").select("event_id", n.ip_hex(F.expr(IP6)).alias("digits"))
    return rows.select("event_id", "digits", n.canonical_ip(F.col("digits")).alias("canonical"), F.when(F.col("digits").isNotNull(), n.private(F.col("digits"))).alias("private"))


@query("cidr_bounds", f"""SELECT event_id, printf('%08x', number - number % size) AS low, printf('%08x', number - number % size + size - 1) AS high, 33 - bits AS bits FROM (SELECT event_id, {NUM4} AS number, 1 + event_id % 33 AS bits, CAST(1 AS BIGINT) << CAST(event_id % 33 AS BIGINT) AS size FROM events)""")
def _(spark, d):
    c = n.cidr(F.concat(F.expr(IP4), F.lit("/"), (32 - F.col("event_id") % 33).cast("string")))
    return v.table(spark, d, "events").select("event_id", c.alias("c")).select("event_id", "c.low", "c.high", F.col("c.bits").cast("long").alias("bits"))


@query("cidr_match_lengths", f"SELECT event_id, p_partkey AS range_id FROM (SELECT event_id, {NUM4} AS number FROM events) JOIN (SELECT p_partkey, p_partkey * 2654435 % 4294967296 AS base, CAST(1 AS BIGINT) << CAST(p_partkey % 24 AS BIGINT) AS size FROM part) ON number // size = base // size")
def _(spark, d):
    addresses = v.table(spark, d, "events").select("event_id", n.ip_hex(F.expr(IP4)).alias("digits"))
    base = F.lpad(F.lower(F.hex(F.col("p_partkey") * 2654435 % (1 << 32))), 8, "0")
    bits = (32 - F.col("p_partkey") % 24).cast("int")
    return n.range_matches(addresses, v.table(spark, d, "part").select(F.col("p_partkey").alias("range_id"), n.masked(base, bits).alias("low"), bits.alias("bits"))).select("event_id", "range_id")


@query("range_faults", """WITH held AS (SELECT s_suppkey % 5 AS customer_id, 50 * 16777216 + s_suppkey * 65536 AS low FROM supplier), new AS (SELECT p_partkey AS id, p_partkey % 5 AS customer_id, p_partkey % 4 AS kind, CASE p_partkey % 4 WHEN 0 THEN 50 * 16777216 + p_partkey % 256 * 65536 WHEN 1 THEN 50 * 16777216 + p_partkey % 256 * 65536 + 256 ELSE 0 END AS low FROM part)
    SELECT customer_id, id, CASE WHEN kind = 3 THEN 'invalid' WHEN kind = 2 THEN 'reserved' WHEN kind = 0 AND low IN (SELECT low FROM held h WHERE h.customer_id = new.customer_id) THEN 'duplicate'
        WHEN kind = 1 AND low // 65536 IN (SELECT low // 65536 FROM held h WHERE h.customer_id = new.customer_id) THEN 'overlap' WHEN (SELECT count(*) FROM held h WHERE h.customer_id = new.customer_id) >= 1000 THEN 'over_cap' END AS fault FROM new""")
def _(spark, d):
    held = v.table(spark, d, "supplier").selectExpr("s_suppkey % 5 AS customer_id", "concat('50.', s_suppkey % 256, '.0.0/16') AS text")
    new = v.table(spark, d, "part").selectExpr("p_partkey % 5 AS customer_id", "p_partkey AS id", "CASE p_partkey % 4 WHEN 0 THEN concat('50.', p_partkey % 256, '.9.9/16') WHEN 1 THEN concat('50.', p_partkey % 256, '.1.0/24') WHEN 2 THEN '10.1.0.0/16' ELSE '1.2.3/8' END AS text")
    return n.range_faults(new, held, 1000).select("customer_id", "id", "fault")


K = "p_partkey"
NOTE = f"""concat('mail <<REDACTED_IP_001>> see HTTP://u@H', {K} % 50, '.Bad.co.uk:80/a%2fb', {K}, '?q=%aa#frag, 8.8.', {K} % 256, '.4 and 10.0.0.', {K} % 256, ' or 1.2.3.4.5; fd00:0:0::', lower(hex({K} + 1)), ' md5 ', md5(CAST({K} AS STRING)), ' at cdn', {K} % 9, '.Example.org. file setup.exe v1.2')"""


@query("indicators_all", f"""WITH p AS (SELECT {K}, CAST({K} % 256 AS VARCHAR) AS b FROM part) SELECT {K}, 'IP' AS entity, '93.1.1.1' AS value, TRUE AS public FROM p
    UNION ALL SELECT {K}, 'URL', 'http://h' || {K} % 50 || '.bad.co.uk/a%2Fb' || {K} || '?q=%AA', NULL FROM p UNION ALL SELECT {K}, 'IP', '8.8.' || b || '.4', TRUE FROM p UNION ALL SELECT {K}, 'IP', '10.0.0.' || b, FALSE FROM p
    UNION ALL SELECT {K}, 'IP', 'fd00::' || printf('%x', {K} + 1), FALSE FROM p UNION ALL SELECT {K}, 'HASH', md5(CAST({K} AS VARCHAR)), NULL FROM p UNION ALL SELECT {K}, 'DOMAIN', 'cdn' || {K} % 9 || '.example.org', NULL FROM p""")
def _(spark, d):
    rows = v.table(spark, d, "part").select(K, F.expr(NOTE).alias("note"), F.create_map(F.lit("93.1.1.1"), F.lit("<<REDACTED_IP_001>>")).alias("known"))
    return k.extract_all(rows, K, "note", "known").select(K, "entity", "value", "public")


@query("indicator_keys", "SELECT event_id, hex('1' || chr(0) || 'DOMAIN' || chr(0) || 'h' || (event_id % 97) || '.bad.test') AS key FROM events")
def _(spark, d):
    value = k.normal_domain(F.concat(F.lit(" H"), (F.col("event_id") % 97).cast("string"), F.lit(".Bad.test. ")))["value"]
    return v.table(spark, d, "events").select("event_id", F.hex(k.indicator_key(F.lit("DOMAIN"), value).cast("binary")).alias("key"))


def _url_indicators(spark, d):
    url = F.expr("concat('https://c', event_id % 211, '.h', event_id % 97, '.bad.test/p', event_id % 31)")
    ip = k.normal_ip(F.expr("concat('9.', event_id % 64, '.', event_id % 200, '.7')"))
    rows = v.table(spark, d, "events").select(F.explode(F.array(k.normal_url(url), ip)).alias("i")).select("i.*").distinct()
    return rows


@query("feed_candidates", """WITH u AS (SELECT DISTINCT event_id % 211 AS c, event_id % 97 AS h, event_id % 31 AS p FROM events), a AS (SELECT DISTINCT event_id % 64 AS x, event_id % 200 AS y FROM events)
    SELECT 'URL' AS entity, 'https://c' || c || '.h' || h || '.bad.test/p' || p AS value, 'hosts' AS source FROM u WHERE h % 2 = 0 AND c % 3 = 0 UNION ALL SELECT 'URL', 'https://c' || c || '.h' || h || '.bad.test/p' || p, 'domains' FROM u
    UNION ALL SELECT 'URL', 'https://c' || c || '.h' || h || '.bad.test/p' || p, 'urls' FROM u WHERE p = 3 UNION ALL SELECT 'IP', '9.' || x || '.' || y || '.7', 'ips' FROM a WHERE y % 10 = 0 UNION ALL SELECT 'IP', '9.' || x || '.' || y || '.7', 'ranges' FROM a WHERE x < 16 OR x BETWEEN 32 AND 33""")
def _(spark, d):
    i_ = _url_indicators(spark, d)
    row = lambda df, source, value, cidr=None: df.select(F.lit(source).alias("source"), (value if value is not None else F.lit(None).cast("string")).alias("match_value"), F.lit(cidr).cast("string").alias("cidr"))
    one = spark.range(1)
    hosts = v.table(spark, d, "events").selectExpr("event_id % 211 AS c", "event_id % 97 AS h", "event_id % 31 AS p").distinct()
    feed = row(hosts.where("h % 2 = 0 AND c % 3 = 0").selectExpr("concat('c', c, '.h', h, '.bad.test') AS t").distinct(), "hosts", F.col("t")).unionByName(row(one, "domains", F.lit("bad.test")))
    feed = feed.unionByName(row(hosts.where("p = 3").selectExpr("concat('https://c', c, '.h', h, '.bad.test/p3') AS t"), "urls", F.col("t"))).unionByName(row(v.table(spark, d, "events").selectExpr("concat('9.', event_id % 64, '.', event_id % 200, '.7') AS t", "event_id % 200 AS y").where("y % 10 = 0").select("t").distinct(), "ips", F.col("t")))
    feed = feed.unionByName(row(one, "ranges", None, "9.0.0.0/12")).unionByName(row(one, "ranges", None, "9.32.0.0/15"))
    return k.match_feeds(i_, feed).select("entity", "value", "source")


#: Hosts h0 to h96 are listed by s0 (deterministic, floor), s1, s2 (soft) and a warning list (negative).
FEED = """feed AS (SELECT j, source, hit_type, polarity, CAST(j * 7 % 100 AS BIGINT) AS confidence, source = 's0' AS floor FROM range(97) t(j), (VALUES ('s0', 3, 'deterministic_ioc', 'positive'), ('s1', 4, 'soft_reputation', 'positive'), ('s2', 5, 'soft_reputation', 'positive'),
    ('d9', 9, 'deterministic_ioc', 'positive'), ('wl', 11, NULL, 'negative')) f(source, every, hit_type, polarity) WHERE j % every = 0)"""
EVIDENCE = f"""{FEED}, neg AS (SELECT DISTINCT j FROM feed WHERE polarity = 'negative'), acted AS (SELECT f.*, CASE WHEN j IN (SELECT j FROM neg) AND hit_type = 'soft_reputation' THEN 'dropped_soft' WHEN j IN (SELECT j FROM neg) THEN 'demoted_deterministic' ELSE 'kept' END AS action,
    floor AND j NOT IN (SELECT j FROM neg) AS eligible FROM feed f WHERE polarity = 'positive'), classed AS (SELECT a.j, a.source, a.action, CASE WHEN hit_type = 'deterministic_ioc' AND eligible THEN 'floor_supporting' WHEN hit_type = 'deterministic_ioc' THEN 'floor_ineligible_deterministic'
    WHEN confidence >= 70 OR n >= 2 THEN 'promoted_soft' END AS class FROM acted a JOIN (SELECT j, count(DISTINCT source) AS n FROM acted WHERE action <> 'dropped_soft' GROUP BY j) USING (j) WHERE action <> 'dropped_soft')"""


def _feed(spark):
    rows = spark.range(97).selectExpr("id AS j", """inline(array(struct('s0' AS source, 3 AS every, 'deterministic_ioc' AS hit_type, 'positive' AS polarity), struct('s1' AS source, 4 AS every, 'soft_reputation' AS hit_type, 'positive' AS polarity),
        struct('s2' AS source, 5 AS every, 'soft_reputation' AS hit_type, 'positive' AS polarity), struct('d9' AS source, 9 AS every, 'deterministic_ioc' AS hit_type, 'positive' AS polarity), struct('wl' AS source, 11 AS every, CAST(NULL AS STRING) AS hit_type, 'negative' AS polarity)))""").where("j % every = 0")
    return rows.selectExpr("concat('h', j, '.bad.test') AS match_value", "CAST(NULL AS STRING) AS cidr", "source", "hit_type", "polarity", "j * 7 % 100 AS confidence")


def _classed(spark, d):
    """The classed evidence of the hosts that events name."""
    host = k.normal_domain(F.expr("concat('H', event_id % 97, '.bad.test')"))
    named = v.table(spark, d, "events").select(host.alias("i")).select("i.*").distinct()
    policies = spark.createDataFrame([("s0", True), ("s1", False), ("s2", False), ("d9", False)], "source string, floor boolean")
    return k.evidence(k.suppress(k.with_floor(k.match_feeds(named, _feed(spark)), policies)))


@query("ioc_evidence", f"WITH {EVIDENCE} SELECT 'h' || j || '.bad.test' AS value, source, action, class FROM classed")
def _(spark, d):
    return _classed(spark, d).select("value", "source", "action", "class")


@query("ioc_suppressed", f"WITH {EVIDENCE} SELECT action, count(*) AS n FROM acted GROUP BY action")
def _(spark, d):
    host = k.normal_domain(F.expr("concat('H', event_id % 97, '.bad.test')"))
    named = v.table(spark, d, "events").select(host.alias("i")).select("i.*").distinct()
    rows = k.suppress(k.match_feeds(named, _feed(spark)).withColumn("floor_eligible", F.col("source") == "s0"))
    return rows.groupBy("action").agg(F.count("*").alias("n"))


_VERDICT = """SELECT subject, known_ioc_hit, evidence, soft, coverage, CASE WHEN coverage IS NULL THEN 'not_run' WHEN known_ioc_hit THEN 'hit' WHEN coverage = 'complete' THEN 'clean_complete' ELSE 'clean_incomplete' END AS state FROM (
    SELECT subject, coalesce(bool_or(fl > 0), FALSE) AS known_ioc_hit, CAST(coalesce(sum(r), 0) AS BIGINT) AS evidence, CAST(coalesce(sum(s), 0) AS BIGINT) AS soft, CASE subject % 3 WHEN 0 THEN 'complete' WHEN 1 THEN 'stale' END AS coverage FROM subj LEFT JOIN
    (SELECT j, count(*) FILTER (WHERE class = 'floor_supporting') AS fl, count(*) AS r, count(*) FILTER (WHERE class = 'promoted_soft') AS s FROM classed WHERE class IS NOT NULL GROUP BY j) USING (j) GROUP BY subject)"""


def _coverage_of(subjects):
    return subjects.select("subject").distinct().where("subject % 3 < 2").select("subject", F.when(F.col("subject") % 3 == 0, "complete").otherwise("stale").alias("coverage"))


@query("story_verdicts", f", {EVIDENCE}, subj AS (SELECT DISTINCT story_id AS subject, member_key % 97 AS j FROM member WHERE member_key IN (SELECT event_key FROM baseline)) {_VERDICT}", "baseline", "member")
def _(spark, d):
    held = v.member(spark, d).join(v.baseline(spark, d).select(F.col("event_key").alias("member_key")).distinct(), "member_key")
    subjects = held.select(F.col("story_id").alias("subject"), F.lit("DOMAIN").alias("entity"), F.expr("concat('h', member_key % 97, '.bad.test')").alias("value")).distinct()
    return k.subject_verdicts(subjects, _classed(spark, d), _coverage_of(subjects))


@query("loose_event_verdicts", f", {EVIDENCE}, subj AS (SELECT DISTINCT event_key AS subject, event_key % 97 AS j FROM baseline WHERE event_key NOT IN (SELECT member_key FROM member)) {_VERDICT}", "baseline", "member")
def _(spark, d):
    loose = k.loose_events(v.baseline(spark, d).select("event_key").distinct(), v.member(spark, d))
    subjects = loose.select(F.col("event_key").alias("subject"), F.lit("DOMAIN").alias("entity"), F.expr("concat('h', event_key % 97, '.bad.test')").alias("value"))
    return k.subject_verdicts(subjects, _classed(spark, d), _coverage_of(subjects))


@query("dispatch_outcomes", """WITH o AS (SELECT DISTINCT event_id % 97 AS j, event_id % 3 AS s FROM events WHERE event_id % 7 <> 0) SELECT 'h' || j AS value, CAST(sum(CASE WHEN s IS NULL THEN 0 ELSE j % 5 END) AS BIGINT) AS matches, min(CASE WHEN s IS NOT NULL THEN j + s END) AS expires,
    count(*) FILTER (WHERE s IS NOT NULL AND s <> 2) AS answered, count(*) FILTER (WHERE s IS NULL) AS not_attempted FROM (SELECT * FROM (SELECT DISTINCT j FROM o), (SELECT unnest([0, 1, 2, 3]) AS e)) q LEFT JOIN (SELECT j AS oj, s FROM o) ON oj = j AND s = e GROUP BY j""")
def _(spark, d):
    o = v.table(spark, d, "events").where("event_id % 7 <> 0").selectExpr("event_id % 97 AS j", "event_id % 3 AS s").distinct()
    outcomes = o.selectExpr("'DOMAIN' AS entity", "concat('h', j) AS value", "s AS source", "j % 5 AS matches", "j + s AS expires", "s <> 2 AS answered")
    return k.dispatched(outcomes, spark.range(4).selectExpr("'DOMAIN' AS entity", "id AS source")).drop("entity")


@query("feed_status", """SELECT source, source <> 's3' AS present, coalesce(n, 0) AS rows, version, feed_hash, CASE WHEN source <> 's3' THEN 'day ' || source END AS fetched_at FROM (SELECT 's' || i AS source FROM range(5) t(i))
    LEFT JOIN (SELECT 's' || p_partkey % 3 AS source, count(*) AS n, max('v' || p_size) AS version, max(md5(CAST(p_partkey AS VARCHAR))) AS feed_hash FROM part GROUP BY 1) USING (source)""")
def _(spark, d):
    feed = v.table(spark, d, "part").selectExpr("concat('s', p_partkey % 3) AS source", "concat('v', p_size) AS version", "md5(CAST(p_partkey AS STRING)) AS feed_hash")
    return k.feed_status(feed, spark.range(5).selectExpr("concat('s', id) AS source", "CASE WHEN id <> 3 THEN concat('day s', id) END AS fetched_at"))


@query("fact_texts", """SELECT p_partkey, 'h' || p_partkey || ' is listed by S' || CASE WHEN p_partkey % 2 = 0 THEN ' as c2' ELSE '' END || CASE p_partkey % 8 WHEN 0 THEN '; attributed to A in campaign C (family F)' WHEN 1 THEN '; campaign C (family F)' WHEN 2 THEN '; attributed to A (family F)' WHEN 3 THEN '; family F'
    WHEN 4 THEN '; attributed to A in campaign C' WHEN 5 THEN '; campaign C' WHEN 6 THEN '; attributed to A' ELSE '' END || CASE WHEN p_partkey % 3 = 0 THEN '; see http://r' ELSE '' END AS fact FROM part""")
def _(spark, d):
    p = F.col(K)
    has = lambda test, text: F.when(test, text).otherwise(F.when(p % 5 == 0, ""))
    fact = k.fact_text(F.concat(F.lit("h"), p.cast("string")), F.lit("S"), has(p % 2 == 0, "c2"), has((p % 8).isin(0, 2, 4, 6), "A"), has((p % 8).isin(0, 1, 4, 5), "C"), has(p % 8 < 4, "F"), has(p % 3 == 0, "http://r"))
    return v.table(spark, d, "part").select(K, fact.alias("fact"))


REFS = "SELECT o_custkey AS subject, CASE WHEN o_orderkey % 9 = 0 THEN 'CVE-' || o_orderkey % 50 ELSE 'CVE-' || (2015 + o_orderkey % 10) || '-' || (10000 + o_orderkey % 3000) END AS ref FROM orders"


@query("cve_refs_validated", f"""SELECT DISTINCT r.subject, r.ref, CASE WHEN NOT regexp_full_match(ref, 'CVE-[0-9]{{4}}-[0-9]{{4,}}') THEN 'invalid_format' WHEN r.subject % 6 = 0 THEN 'could_not_consult' WHEN p.cve IS NULL THEN 'not_in_catalog' WHEN p.sources = 'epss' THEN 'source_disabled' ELSE 'kept' END AS reason
    FROM ({REFS}) r LEFT JOIN {PIVOT} p ON p.cve = r.ref""", "cve")
def _(spark, d):
    refs = v.table(spark, d, "orders").selectExpr("o_custkey AS subject", "CASE WHEN o_orderkey % 9 = 0 THEN concat('CVE-', o_orderkey % 50) ELSE concat(' cve-', 2015 + o_orderkey % 10, '-', 10000 + o_orderkey % 3000) END AS ref")
    consulted = refs.select("subject").distinct().select("subject", (F.col("subject") % 6 != 0).alias("answered"))
    return i.validate_refs(refs, i.cve_pivot(v.cve(spark, d)), consulted, ["nvd", "kev"])


@query("cve_answered", f"SELECT * FROM {PIVOT.replace('FROM cve GROUP', 'FROM cve WHERE source <> ' + chr(39) + 'nvd' + chr(39) + ' GROUP')}", "cve")
def _(spark, d):
    return i.cve_pivot(i.answered_only(v.cve(spark, d), ["kev", "epss"]))


@query("cve_restricted", f"SELECT cve, published, CAST(NULL AS BIGINT) AS epss, kev, concat_ws(',', CASE WHEN contains(sources, 'nvd') THEN 'nvd' END, CASE WHEN kev THEN 'kev' END) AS sources FROM {PIVOT} WHERE kev OR contains(sources, 'nvd')", "cve")
def _(spark, d):
    return i.restricted(i.cve_pivot(v.cve(spark, d)), ["nvd", "kev"])


@query("cve_recent_landscape", f"SELECT cve, kev, epss, published FROM {PIVOT} WHERE (kev OR epss >= 50) AND published >= 40 ORDER BY kev DESC, epss DESC NULLS LAST, published DESC NULLS LAST, cve LIMIT 40", "cve")
def _(spark, d):
    return i.cve_landscape(i.cve_pivot(v.cve(spark, d)), 50, 40, since=40)


@query("cve_rows", f"""SELECT cve, CASE WHEN sources = 'kev' THEN 'absent' WHEN kev THEN 'chips' WHEN status <> 'complete' THEN 'could_not_verify' WHEN epss >= 60 THEN 'novelty' ELSE 'irrelevant' END AS state, status AS folded,
    concat_ws(' · ', CASE WHEN published IS NOT NULL THEN 'CVSS ' || published || ' [NVD]' END, CASE WHEN kev THEN 'KEV [CISA]' END, CASE WHEN epss IS NOT NULL THEN 'EPSS ' || epss || ' / p' || epss || ' [FIRST]' END, CASE WHEN published = 7 AND NOT kev THEN 'In the wild [CISA]' END) AS payload
    FROM (SELECT *, CASE WHEN sources = 'nvd' THEN 'unknown' WHEN contains(sources, 'nvd') THEN 'complete' ELSE 'stale' END AS status FROM {PIVOT})""", "cve")
def _(spark, d):
    rows = i.cve_pivot(v.cve(spark, d))
    ran = F.when(F.col("sources") == "nvd", "partial").when(F.contains("sources", F.lit("nvd")), "complete").otherwise("stale")
    folded = i.degraded(ran, (F.col("sources") == "nvd") | ~F.contains("sources", F.lit("nvd")))
    state = i.row_state(F.when(F.col("kev"), 1).otherwise(0), F.when(F.col("sources") != "kev", folded), F.when(F.col("epss") >= 60, "HIGH").otherwise("LOW"))
    payload = i.payload_text(F.col("published"), F.col("kev"), F.col("epss"), F.col("epss") / 100, F.col("published") == 7)
    return rows.select("cve", state.alias("state"), folded.alias("folded"), payload.alias("payload"))


@query("cve_status", """SELECT subject, CASE WHEN bool_or(s = 1 AND NOT answered) THEN 'unknown' WHEN bool_or(answered AND age > 50) THEN 'stale' WHEN count(*) < 3 THEN 'partial' ELSE 'complete' END AS status FROM (SELECT o_custkey AS subject, o_orderkey % 3 AS s, bool_or(o_orderkey % 5 <> 0 OR o_orderkey % 3 <> 1) AS answered,
    min(o_orderkey % 60) FILTER (WHERE o_orderkey % 5 <> 0 OR o_orderkey % 3 <> 1) AS age FROM orders GROUP BY 1, 2) GROUP BY subject""")
def _(spark, d):
    outcomes = v.table(spark, d, "orders").selectExpr("o_custkey AS subject", "o_orderkey % 3 AS source", "o_orderkey % 5 <> 0 OR o_orderkey % 3 <> 1 AS answered", "o_orderkey % 60 AS age")
    return i.coverage(outcomes, 3, 50).select("subject", "status")


def _notes(spark, d):
    known = F.create_map(F.lit("a@b.co"), F.lit("<<REDACTED_EMAIL_004>>"), F.lit("10.0.0.1"), F.lit("<<REDACTED_IP_1007>>"))
    text = F.expr(f"concat('a@b.co to x', {K}, '@y.zz, 10.0.0.1 or 10.9.0.', {K} % 256, ' ::1 at 12:30:45')")
    return v.table(spark, d, "part").select(K, text.alias("text"), F.when(F.col(K) % 7 > 0, known).alias("known"), F.when(F.col(K) % 2 == 0, "p1").otherwise("p2").alias("version"), text.alias("plain"))


@query("redact_continued", f"""SELECT {K}, CASE WHEN {K} % 7 > 0 THEN '<<REDACTED_EMAIL_004>> to <<REDACTED_EMAIL_005>>, <<REDACTED_IP_1007>> or <<REDACTED_IP_1009>> <<REDACTED_IP_1008>> at 12:30:45'
    ELSE '<<REDACTED_EMAIL_001>> to <<REDACTED_EMAIL_002>>, <<REDACTED_IP_002>> or <<REDACTED_IP_003>> <<REDACTED_IP_001>> at 12:30:45' END AS text FROM part""")
def _(spark, d):
    return x.redact(_notes(spark, d)).select(K, "text")


@query("redact_again", f"""SELECT {K}, '<<REDACTED_EMAIL_004>> at <<REDACTED_IP_1007>> and <<REDACTED_IP_1009>> <<REDACTED_IP_1008>> <<REDACTED_MAC_001>>' AS text, 5 AS tokens, 'p1' AS version FROM part WHERE {K} % 2 = 1""")
def _(spark, d):
    known = F.create_map(F.lit("a@b.co"), F.lit("<<REDACTED_EMAIL_004>>"), F.lit("10.0.0.1"), F.lit("<<REDACTED_IP_1007>>"))
    text = F.concat(F.lit("<<REDACTED_EMAIL_004>> at <<REDACTED_IP_1007>> and 10.9.0."), (F.col(K) % 256).cast("string"), F.lit(" ::1 <<REDACTED_MAC_001>>"))
    rows = v.table(spark, d, "part").select(K, text.alias("text"), known.alias("known"), F.when(F.col(K) % 2 == 0, "p1").otherwise("p2").alias("version"))
    again, _ = x.redact_again(rows, "p1")
    return again.select(K, "text", (F.size("known") + 1).alias("tokens"), "version")


@query("redact_job", f"SELECT count(*) AS items, count(*) FILTER (WHERE {K} % 3 = 0) AS failed, TRUE AS stopped FROM part WHERE {K} % 2 = 1")
def _(spark, d):
    bad = F.create_map(F.lit("a@b.co"), F.lit("<<REDACTED_EMAIL_001>>"), F.lit("c@d.co"), F.lit("<<REDACTED_EMAIL_001>>"))
    rows = _notes(spark, d).withColumn("known", F.when(F.col(K) % 3 == 0, bad).otherwise(F.col("known")))
    return x.redact_again(rows, "p1")[1]


@query("redact_conflicts", f"SELECT {K}, '<<REDACTED_EMAIL_001>>' AS token, 2 AS values FROM part WHERE {K} % 3 = 0")
def _(spark, d):
    bad = F.create_map(F.lit("a@b.co"), F.lit("<<REDACTED_EMAIL_001>>"), F.lit("c@d.co"), F.when(F.col(K) % 3 == 0, "<<REDACTED_EMAIL_001>>").otherwise("<<REDACTED_EMAIL_002>>"))
    return x.conflicts(v.table(spark, d, "part").select(K, bad.alias("known")), K)


@query("redact_owned", f"SELECT {K}, 'www.other.test <<REDACTED_DOMAIN_001>> <<REDACTED_IP_001>>' AS text FROM part")
def _(spark, d):
    rows = v.table(spark, d, "part").select(K, F.expr(f"concat('www.other.test H', {K}, '.Own.test 8.8.8.8')").alias("text"), F.lit(None).cast("map<string,string>").alias("known"))
    return x.redact(rows, ranges=[(134744072, 134744072)], domains=["own.test"]).select(K, "text")


_RANGE = "printf('%d.%d.0.0/16', 1 + s_suppkey % 90, s_suppkey % 7)"


@query("redact_policy", f"""WITH lists AS (SELECT s_nationkey AS customer_id, list_sort(list(DISTINCT {_RANGE}) FILTER (WHERE s_nationkey % 4 > 0)) AS ranges, list_sort(list(DISTINCT 'own' || s_suppkey % 3 || '.test') FILTER (WHERE s_nationkey % 3 > 0)) AS domains FROM supplier GROUP BY s_nationkey)
    SELECT customer_id, 'engine:2|ranges:' || CASE WHEN ranges IS NULL THEN 'empty' ELSE sha256('["' || array_to_string(ranges, '","') || '"]')[1:12] END || '|domains:' || CASE WHEN domains IS NULL THEN 'empty' ELSE sha256('["' || array_to_string(domains, '","') || '"]')[1:12] END AS version FROM lists""")
def _(spark, d):
    rows = v.table(spark, d, "supplier").select("s_nationkey", F.expr(_RANGE).alias("r"), F.concat(F.lit("own"), (F.col("s_suppkey") % 3).cast("string"), F.lit(".test")).alias("o"))
    lists = rows.groupBy(F.col("s_nationkey").alias("customer_id")).agg(F.collect_set(F.when(F.col("s_nationkey") % 4 > 0, F.col("r"))).alias("ranges"), F.collect_set(F.when(F.col("s_nationkey") % 3 > 0, F.col("o"))).alias("domains"))
    return lists.select("customer_id", x.policy_versions("2", F.col("ranges"), F.col("domains")).alias("version"))


@query("redact_allowed_tokens", """SELECT story_id, string_agg(DISTINCT '<<REDACTED_IP_E' || member_no || '_' || lpad(CAST(member_key % 3 + 1 AS VARCHAR), 3, '0') || '>>', ',' ORDER BY '<<REDACTED_IP_E' || member_no || '_' || lpad(CAST(member_key % 3 + 1 AS VARCHAR), 3, '0') || '>>') AS tokens FROM member GROUP BY story_id""", "member")
def _(spark, d):
    token = F.expr("concat('<<REDACTED_IP_', lpad(CAST(member_key % 3 + 1 AS STRING), 3, '0'), '>>')")
    maps = v.member(spark, d).select("story_id", "member_no", F.create_map(F.lit("10.0.0.1"), token).alias("known"))
    return x.allowed_tokens(maps, "story_id", "E", "member_no").withColumn("tokens", F.array_join("tokens", ","))
