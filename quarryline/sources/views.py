"""The domain tables of security-event analytics, derived from the driver's parquet tables.

Each view has the same definition here and in VIEW_SQL, which the SQL oracles start from. Scores are whole
percentages, so that both engines give the same values.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: The techniques that a result's tags are taken from.
TECHNIQUES = ("T1003", "T1021", "T1046", "T1059", "T1071", "T1110")

VIEW_SQL = {
    "baseline": """
        SELECT event_id AS event_key, ts AS event_time, CASE WHEN event_id % 17 = 0 THEN NULL ELSE event_type END AS category,
               user_id AS primary_asset, user_id % 5 AS customer_id, user_id % 7 AS sensor, 'v1' AS baseline_version,
               ts AS received_at, CAST(floor(value * 100) AS BIGINT) AS raw_score FROM events
        UNION ALL
        SELECT event_id, ts, event_type, user_id, user_id % 5, user_id % 7, 'v2', ts + INTERVAL 1 HOUR, CAST(floor(value * 100) AS BIGINT)
        FROM events WHERE event_id % 10 = 0""",
    "latest": """
        SELECT * EXCLUDE (rn) FROM (SELECT *, row_number() OVER (PARTITION BY sensor, event_key ORDER BY received_at DESC, baseline_version DESC) AS rn FROM baseline) WHERE rn = 1""",
    "result": """
        SELECT *, CASE WHEN s = 3 AND l >= 2 THEN 'CRITICAL' WHEN (s = 3 AND l = 1) OR (s = 2 AND l >= 2) THEN 'HIGH'
                       WHEN (s = 3 AND l = 0) OR (s = 2 AND l = 1) OR (s = 1 AND l >= 2) THEN 'MEDIUM' ELSE 'LOW' END AS tier
        FROM (SELECT *, (CASE WHEN severity >= 40 THEN 1 ELSE 0 END + CASE WHEN severity >= 60 THEN 1 ELSE 0 END + CASE WHEN severity >= 80 THEN 1 ELSE 0 END) AS s,
                     (CASE WHEN likelihood >= 40 THEN 1 ELSE 0 END + CASE WHEN likelihood >= 60 THEN 1 ELSE 0 END + CASE WHEN likelihood >= 80 THEN 1 ELSE 0 END) AS l
              FROM (SELECT event_id AS event_key, ts AS event_time, user_id % 5 AS customer_id, user_id % 7 AS sensor, event_id * 37 % 100 AS severity, event_id * 53 % 100 AS likelihood,
                           'm' || (event_id % 3) AS model, 1 AS generation, event_id % 4 = 0 AS superseded, event_id % 6 AS tag_a, event_id % 5 AS tag_b FROM events
                    UNION ALL
                    SELECT event_id, ts, user_id % 5, user_id % 7, event_id * 41 % 100, event_id * 59 % 100, 'm' || (event_id % 3), 2, FALSE, event_id % 6, event_id % 5 FROM events WHERE event_id % 4 = 0))""",
    "story": """
        SELECT *, window_start + INTERVAL 1 HOUR * (6 + 24 * (o_custkey % 9)) AS window_end, o_custkey % 5 AS customer_id FROM (
            SELECT o_orderkey AS story_id, o_custkey, 'v1' AS story_version, o_orderdate AS window_start, o_orderdate AS received_at FROM orders
            UNION ALL
            SELECT o_orderkey, o_custkey, 'v2', o_orderdate + INTERVAL 1 DAY, o_orderdate + INTERVAL 2 DAY FROM orders WHERE o_orderkey % 4 = 0)""",
    "canonical": """
        SELECT * EXCLUDE (rn) FROM (SELECT *, row_number() OVER (PARTITION BY story_id ORDER BY received_at DESC, story_version DESC) AS rn FROM story) WHERE rn = 1""",
    "member": "SELECT l_orderkey AS story_id, l_linenumber AS member_no, l_partkey AS member_key, l_shipdate AS member_time FROM lineitem",
    "audit": """
        SELECT event_id AS id, ts AS logged_at, user_id AS actor_id, event_id % 11 AS ip, user_id % 5 AS customer_id, event_id % 13 AS sid,
               CASE event_type WHEN 'error' THEN 'sign_in.denied' WHEN 'signup' THEN 'sign_in.success' WHEN 'click' THEN 'bridge.connect'
                    WHEN 'view' THEN 'session.ip_mismatch' ELSE 'report.read' END AS action FROM events""",
    "cve": """
        SELECT 'CVE-' || (2015 + p_partkey % 10) || '-' || (10000 + p_partkey) AS cve, source, published, epss, kev FROM (
            SELECT p_partkey, 'nvd' AS source, p_size AS published, NULL::BIGINT AS epss, FALSE AS kev FROM part WHERE p_partkey % 7 <> 0
            UNION ALL SELECT p_partkey, 'kev', p_size + 1, NULL, TRUE FROM part WHERE p_partkey % 9 = 0
            UNION ALL SELECT p_partkey, 'epss', NULL, p_partkey * 31 % 100, FALSE FROM part WHERE p_partkey % 2 = 0)""",
    "incident": """
        SELECT story_id, story_version, customer_id, sensor, kind, window_start, window_start + INTERVAL 1 HOUR * (1 + hours) AS window_end, received_at FROM (
            SELECT o_orderkey AS story_id, 'v1' AS story_version, o_custkey % 5 AS customer_id, o_custkey % 7 AS sensor, CASE WHEN o_orderkey % 3 = 0 THEN 'curated' ELSE 'auto_correlated' END AS kind,
                   TIMESTAMP '2024-01-01' + INTERVAL 1 HOUR * (24 * (o_orderkey % 30) + o_custkey % 24) AS window_start, o_custkey % 30 AS hours, TIMESTAMP '2024-02-01' AS received_at FROM orders
            UNION ALL
            SELECT o_orderkey, 'v2', o_custkey % 5, o_custkey % 7, 'auto_correlated', TIMESTAMP '2024-01-01' + INTERVAL 1 HOUR * (24 * (o_orderkey % 30) + o_custkey % 24 + 6), o_custkey % 30, TIMESTAMP '2024-02-01 06:00:00'
            FROM orders WHERE o_orderkey % 4 = 0)""",
    "incident_member": """
        SELECT l_orderkey AS story_id, 'v1' AS story_version, l_partkey AS member_key FROM lineitem
        UNION ALL SELECT l_orderkey, 'v2', l_partkey FROM lineitem WHERE l_orderkey % 4 = 0 AND l_linenumber % 2 = 1""",
    "story_state": "SELECT o_orderkey AS story_id, o_custkey % 5 AS customer_id, CASE o_orderkey % 6 WHEN 5 THEN 'dirty' WHEN 4 THEN 'pending' ELSE 'ready' END AS status FROM orders",
    "report_member": "SELECT m.*, coalesce(user_id + CASE WHEN story_id % 5 = 0 THEN 1 ELSE 0 END, member_key) % 7 AS sensor FROM incident_member m LEFT JOIN events ON event_id = member_key",
    "story_result": """
        SELECT *, CASE WHEN s = 3 AND l >= 2 THEN 'CRITICAL' WHEN (s = 3 AND l = 1) OR (s = 2 AND l >= 2) THEN 'HIGH'
                       WHEN (s = 3 AND l = 0) OR (s = 2 AND l = 1) OR (s = 1 AND l >= 2) THEN 'MEDIUM' ELSE 'LOW' END AS tier
        FROM (SELECT *, (CASE WHEN severity >= 40 THEN 1 ELSE 0 END + CASE WHEN severity >= 60 THEN 1 ELSE 0 END + CASE WHEN severity >= 80 THEN 1 ELSE 0 END) AS s,
                     (CASE WHEN likelihood >= 40 THEN 1 ELSE 0 END + CASE WHEN likelihood >= 60 THEN 1 ELSE 0 END + CASE WHEN likelihood >= 80 THEN 1 ELSE 0 END) AS l
              FROM (SELECT o_orderkey AS story_id, 1 AS generation, 'm' || (o_orderkey % 3) AS model, o_orderkey % 5 = 0 AS superseded, o_orderkey * 31 % 100 AS severity, o_custkey * 43 % 100 AS likelihood,
                           o_orderkey % 6 AS tag_a, o_custkey % 5 AS tag_b, 'CVE-2020-' || (1000 + o_orderkey % 50) AS cve FROM orders
                    UNION ALL SELECT o_orderkey, 2, 'm' || (o_orderkey % 3), FALSE, o_orderkey * 47 % 100, o_custkey * 61 % 100, o_orderkey % 6, o_custkey % 5, 'CVE-2020-' || (1000 + o_orderkey % 50) FROM orders WHERE o_orderkey % 5 = 0
                    UNION ALL SELECT o_orderkey, 1, 'm1', FALSE, o_orderkey * 29 % 100, o_custkey * 71 % 100, o_orderkey % 6, o_custkey % 5, 'CVE-2020-' || (1000 + o_orderkey % 50) FROM orders WHERE o_orderkey % 3 = 0))""",
}


def with_views(sql: str, *names: str) -> str:
    """An oracle's SQL over the named views, and those that they stand on."""
    needs = {"latest": ("baseline",), "canonical": ("story",), "report_member": ("incident_member",)}
    order = [n for n in VIEW_SQL if n in {*names, *(x for y in names for x in needs.get(y, ()))}]
    return "WITH " + ",\n".join(f"{n} AS ({VIEW_SQL[n]})" for n in order) + "\n" + sql


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def baseline(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Versioned baseline events: a second version of every tenth, one hour later. One scan of events."""
    e = table(spark, sf_dir, "events")
    versions = F.when(F.col("event_id") % 10 == 0, F.array(F.lit(1), F.lit(2))).otherwise(F.array(F.lit(1)))
    second = F.col("version") == 2
    return e.withColumn("version", F.explode(versions)).select(
        F.col("event_id").alias("event_key"), F.col("ts").alias("event_time"),
        F.when((F.col("event_id") % 17 != 0) | second, F.col("event_type")).alias("category"),
        F.col("user_id").alias("primary_asset"), (F.col("user_id") % 5).alias("customer_id"), (F.col("user_id") % 7).alias("sensor"),
        F.when(second, "v2").otherwise("v1").alias("baseline_version"),
        F.when(second, F.col("ts") + F.expr("INTERVAL 1 HOUR")).otherwise(F.col("ts")).alias("received_at"),
        F.floor(F.col("value") * 100).cast("long").alias("raw_score"),
    )


def tier_of(severity: Column, likelihood: Column) -> Column:
    """The priority tier of scores in percent. Thresholds 40, 60 and 80, and the 4 x 4 matrix."""
    step = lambda x: sum(F.when(x >= t, 1).otherwise(0) for t in (40, 60, 80))
    matrix = (
        "LOW", "LOW", "LOW", "LOW",
        "LOW", "LOW", "MEDIUM", "MEDIUM",
        "LOW", "MEDIUM", "HIGH", "HIGH",
        "MEDIUM", "HIGH", "CRITICAL", "CRITICAL",
    )
    return F.get(F.array(*map(F.lit, matrix)), step(severity) * 4 + step(likelihood))


def result(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Analysis results in generations: the first of every fourth event is superseded by a second."""
    e = table(spark, sf_dir, "events")
    again = F.col("event_id") % 4 == 0
    g = F.col("generation")
    rows = e.withColumn("generation", F.explode(F.when(again, F.array(F.lit(1), F.lit(2))).otherwise(F.array(F.lit(1)))))
    rows = rows.select(
        F.col("event_id").alias("event_key"), F.col("ts").alias("event_time"), (F.col("user_id") % 5).alias("customer_id"), (F.col("user_id") % 7).alias("sensor"),
        (F.col("event_id") * F.when(g == 1, 37).otherwise(41) % 100).alias("severity"), (F.col("event_id") * F.when(g == 1, 53).otherwise(59) % 100).alias("likelihood"),
        F.concat(F.lit("m"), (F.col("event_id") % 3).cast("string")).alias("model"), g, ((g == 1) & again).alias("superseded"),
        F.array(*(F.get(F.array(*map(F.lit, TECHNIQUES)), (F.col("event_id") % k).cast("int")) for k in (6, 5))).alias("tags"),
    )
    return rows.withColumn("tier", tier_of(F.col("severity"), F.col("likelihood")))


def story(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Versioned stories (intervals): a second version of every fourth, moved by a day."""
    o = table(spark, sf_dir, "orders")
    second = F.col("version") == 2
    rows = o.withColumn("version", F.explode(F.when(F.col("o_orderkey") % 4 == 0, F.array(F.lit(1), F.lit(2))).otherwise(F.array(F.lit(1)))))
    day = lambda n: F.when(second, F.col("o_orderdate") + F.expr(f"INTERVAL {n} DAY")).otherwise(F.col("o_orderdate"))
    rows = rows.select(F.col("o_orderkey").alias("story_id"), "o_custkey", F.when(second, "v2").otherwise("v1").alias("story_version"), day(1).alias("window_start"), day(2).alias("received_at"))
    hours = (6 + 24 * (F.col("o_custkey") % 9)).cast("int")
    return rows.withColumn("window_end", F.col("window_start") + F.make_dt_interval(hours=hours)).withColumn("customer_id", F.col("o_custkey") % 5)


def member(spark: SparkSession, sf_dir: str) -> DataFrame:
    i = table(spark, sf_dir, "lineitem")
    return i.select(F.col("l_orderkey").alias("story_id"), F.col("l_linenumber").alias("member_no"), F.col("l_partkey").alias("member_key"), F.col("l_shipdate").alias("member_time"))


def audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events")
    actions = {"error": "sign_in.denied", "signup": "sign_in.success", "click": "bridge.connect", "view": "session.ip_mismatch"}
    action = F.coalesce(F.create_map(*(F.lit(x) for kv in actions.items() for x in kv))[F.col("event_type")], F.lit("report.read"))
    return e.select(F.col("event_id").alias("id"), F.col("ts").alias("logged_at"), F.col("user_id").alias("actor_id"), (F.col("event_id") % 11).alias("ip"), (F.col("user_id") % 5).alias("customer_id"), (F.col("event_id") % 13).alias("sid"), action.alias("action"))


def cve(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A vulnerability catalog: a row for each source that knows the id."""
    p = table(spark, sf_dir, "part")
    k = F.col("p_partkey")
    rows = p.select(k, F.expr("""inline(array(
        struct('nvd' AS source, p_size AS published, CAST(NULL AS BIGINT) AS epss, false AS kev, p_partkey % 7 <> 0 AS there),
        struct('kev' AS source, p_size + 1 AS published, CAST(NULL AS BIGINT) AS epss, true AS kev, p_partkey % 9 = 0 AS there),
        struct('epss' AS source, CAST(NULL AS INT) AS published, p_partkey * 31 % 100 AS epss, false AS kev, p_partkey % 2 = 0 AS there)))""")).where("there")
    name = F.concat(F.lit("CVE-"), (2015 + k % 10).cast("string"), F.lit("-"), (10000 + k).cast("string"))
    return rows.select(name.alias("cve"), "source", "published", "epss", "kev")


def incident(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Versioned stories in the events' month: a second version of every fourth, six hours later."""
    o = table(spark, sf_dir, "orders")
    second = F.col("version") == 2
    rows = o.withColumn("version", F.explode(F.when(F.col("o_orderkey") % 4 == 0, F.array(F.lit(1), F.lit(2))).otherwise(F.array(F.lit(1)))))
    hours = 24 * (F.col("o_orderkey") % 30) + F.col("o_custkey") % 24 + F.when(second, 6).otherwise(0)
    start = F.lit("2024-01-01").cast("timestamp_ntz") + F.make_dt_interval(hours=hours.cast("int"))
    rows = rows.withColumn("window_start", start).withColumn("window_end", F.col("window_start") + F.make_dt_interval(hours=(1 + F.col("o_custkey") % 30).cast("int")))
    return rows.select(
        F.col("o_orderkey").alias("story_id"), F.when(second, "v2").otherwise("v1").alias("story_version"), (F.col("o_custkey") % 5).alias("customer_id"), (F.col("o_custkey") % 7).alias("sensor"),
        F.when((F.col("o_orderkey") % 3 == 0) & ~second, "curated").otherwise("auto_correlated").alias("kind"), "window_start", "window_end",
        F.when(second, F.lit("2024-02-01 06:00:00")).otherwise(F.lit("2024-02-01")).cast("timestamp_ntz").alias("received_at"),
    )


def incident_member(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Members of each version of an incident."""
    i = table(spark, sf_dir, "lineitem")
    again = (F.col("l_orderkey") % 4 == 0) & (F.col("l_linenumber") % 2 == 1)
    versions = F.when(again, F.array(F.lit("v1"), F.lit("v2"))).otherwise(F.array(F.lit("v1")))
    return i.select(F.col("l_orderkey").alias("story_id"), F.explode(versions).alias("story_version"), F.col("l_partkey").alias("member_key"))


def story_state(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whether each story is analysed: a third of them isn't."""
    status = F.when(F.col("o_orderkey") % 6 == 5, "dirty").when(F.col("o_orderkey") % 6 == 4, "pending").otherwise("ready")
    return table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("story_id"), (F.col("o_custkey") % 5).alias("customer_id"), status.alias("status"))


def report_member(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Members of incidents with their sensor; a fifth of the stories names events of another sensor."""
    e = table(spark, sf_dir, "events").select(F.col("event_id").alias("member_key"), "user_id")
    rows = incident_member(spark, sf_dir).join(e, "member_key", "left")
    sensor = F.coalesce(F.col("user_id") + F.when(F.col("story_id") % 5 == 0, 1).otherwise(0), "member_key") % 7
    return rows.select("story_id", "story_version", "member_key", sensor.alias("sensor"))


def story_result(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Results of incidents: generations of one model, and for every third a second model's."""
    o = table(spark, sf_dir, "orders")
    rows = o.select("o_orderkey", "o_custkey", F.expr("""inline(filter(array(
        struct(1 AS generation, concat('m', o_orderkey % 3) AS model, o_orderkey % 5 = 0 AS superseded, o_orderkey * 31 % 100 AS severity, o_custkey * 43 % 100 AS likelihood, true AS there),
        struct(2 AS generation, concat('m', o_orderkey % 3) AS model, false AS superseded, o_orderkey * 47 % 100 AS severity, o_custkey * 61 % 100 AS likelihood, o_orderkey % 5 = 0 AS there),
        struct(1 AS generation, 'm1' AS model, false AS superseded, o_orderkey * 29 % 100 AS severity, o_custkey * 71 % 100 AS likelihood, o_orderkey % 3 = 0 AS there)), x -> x.there))"""))
    tag = lambda c, k: F.get(F.array(*map(F.lit, TECHNIQUES)), (F.col(c) % k).cast("int"))
    cve_id = F.concat(F.lit("CVE-2020-"), (1000 + F.col("o_orderkey") % 50).cast("string"))
    rows = rows.select(F.col("o_orderkey").alias("story_id"), "generation", "model", "superseded", "severity", "likelihood", F.array(tag("o_orderkey", 6), tag("o_custkey", 5)).alias("tags"), cve_id.alias("cve"))
    return rows.withColumn("tier", tier_of(F.col("severity"), F.col("likelihood")))
