"""Queries of periodic reports and of calendar functions. Importing this registers them."""

from __future__ import annotations

from pyspark.sql import functions as F

from quarryline.functions import calendar as c
from quarryline.functions import semantics as s
from quarryline.operators import activity as a
from quarryline.operators import lineage as g
from quarryline.operators import periodic as p
from quarryline.operators import report_tokens as t
from quarryline.plans.catalog import DAY, DAY_AFTER, DAY_BEFORE, NOW, RANK, ROLLUP, TECH, _latest_in, query
from quarryline.sources import views as v

MODELS = ["m0", "m1"]
VIEWS = ("latest", "result", "incident", "story_state", "report_member", "story_result")
_PREFERRED = "model IN ('m0', 'm1') AND NOT superseded"
_EVENT = f"{RANK} DESC, severity + likelihood DESC, customer_id, sensor, event_key"


def _report_sql(subject: str, sql: str) -> str:
    """The parts of the report of subjects (an expression over customer_id) on DAY."""
    tagged = lambda t: f"(SELECT *, {TECH}[tag_a + 1] AS ta, {TECH}[tag_b + 1] AS tb FROM {t})"
    return f""", canonical_incident AS (SELECT * EXCLUDE (rn) FROM (SELECT *, row_number() OVER (PARTITION BY story_id ORDER BY received_at DESC, story_version DESC) AS rn FROM incident SEMI JOIN (SELECT story_id, customer_id FROM story_state WHERE status = 'ready') USING (story_id, customer_id)) WHERE rn = 1),
    story_leaf AS (SELECT * EXCLUDE (rn) FROM (SELECT c.story_version, c.customer_id, c.window_start, c.window_end, r.*, {subject} AS subject_id, row_number() OVER (PARTITION BY story_id ORDER BY model, generation DESC) AS rn
        FROM canonical_incident c JOIN story_result r USING (story_id) WHERE {_PREFERRED} AND window_start < TIMESTAMP '{DAY_AFTER}' AND window_end > TIMESTAMP '{DAY}') WHERE rn = 1),
    event_leaf AS (SELECT * EXCLUDE (rn) FROM (SELECT *, {subject} AS subject_id, row_number() OVER (PARTITION BY customer_id, sensor, event_key ORDER BY model, generation DESC) AS rn FROM result
        WHERE {_PREFERRED} AND event_time >= TIMESTAMP '{DAY}' AND event_time < TIMESTAMP '{DAY_AFTER}') WHERE rn = 1),
    top_story AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY subject_id ORDER BY {RANK} DESC, severity + likelihood DESC, customer_id, story_id) AS place FROM story_leaf) WHERE place <= 5),
    covered AS (SELECT DISTINCT subject_id, customer_id, m.sensor, member_key AS event_key FROM report_member m JOIN top_story USING (story_id, story_version)),
    universe AS (SELECT * FROM event_leaf ANTI JOIN covered USING (subject_id, customer_id, sensor, event_key)),
    top_event AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY subject_id ORDER BY {_EVENT}) AS place FROM universe WHERE tier <> 'LOW') WHERE place <= 10),
    uncited AS (SELECT *, {RANK} AS tier_rank FROM universe ANTI JOIN top_event USING (subject_id, customer_id, sensor, event_key)),
    tagged AS (SELECT subject_id, unnest([ta, tb]) AS technique, tier_rank, severity + likelihood AS score, customer_id, sensor, event_key, generation, model FROM {tagged("uncited")}),
    cluster AS (SELECT subject_id, technique, n, tier_rank, customer_id, sensor, event_key, generation, model FROM (SELECT *, count(*) OVER (PARTITION BY subject_id, technique) AS n,
        row_number() OVER (PARTITION BY subject_id, technique ORDER BY tier_rank DESC, score DESC, customer_id, sensor, event_key) AS rn FROM tagged) WHERE rn = 1),
    exemplar AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY subject_id ORDER BY tier_rank DESC, n DESC, technique) AS place, count(*) OVER (PARTITION BY subject_id) AS total FROM cluster) WHERE place <= 10),
    scoped AS (SELECT *, {subject} AS subject_id FROM latest WHERE event_time >= TIMESTAMP '{DAY_BEFORE}' AND event_time < TIMESTAMP '{DAY_AFTER}'),
    drift AS (SELECT *, (current_n - previous_n) / greatest(previous_n, 1) AS delta FROM (SELECT subject_id, category, count(*) FILTER (WHERE event_time >= TIMESTAMP '{DAY}') AS current_n, count(*) FILTER (WHERE event_time < TIMESTAMP '{DAY}') AS previous_n FROM scoped GROUP BY ALL)),
    drift_score AS (SELECT subject_id, CASE WHEN sum(previous_n) = 0 THEN 0.0::DOUBLE ELSE least(1.0::DOUBLE, max(abs(current_n - previous_n)) / greatest(sum(previous_n), 1)) END AS drift_severity,
        CASE WHEN sum(previous_n) > 0 AND max(abs(delta)) > 0.3 THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END AS drift_likelihood FROM drift GROUP BY subject_id) {sql}"""


def _scope(spark, subject="customer_id"):
    return spark.range(5).select(F.col("id").alias("customer_id")).withColumn("subject_id", F.expr(subject)).select("subject_id", "customer_id")


def _parts(spark, d, subject="customer_id"):
    return p.report_parts(_scope(spark, subject), v.incident(spark, d), v.story_state(spark, d), v.report_member(spark, d), v.story_result(spark, d), v.result(spark, d), _latest_in(spark, d), MODELS, DAY_BEFORE, DAY, DAY_AFTER)


@query("report_top_stories", _report_sql("customer_id", "SELECT subject_id, CAST(place AS INTEGER) AS place, story_id, story_version, model, generation, tier FROM top_story"), *VIEWS)
def _(spark, d):
    return _parts(spark, d)["stories"].select("subject_id", "place", "story_id", "story_version", "model", "generation", "tier")


@query("report_top_events", _report_sql("customer_id", "SELECT subject_id, CAST(place AS INTEGER) AS place, sensor, event_key, model, tier FROM top_event"), *VIEWS)
def _(spark, d):
    return _parts(spark, d)["events"].select("subject_id", "place", "sensor", "event_key", "model", "tier")


@query("report_universe", _report_sql("customer_id", "SELECT subject_id, customer_id, sensor, event_key, model, generation, tier, severity, likelihood FROM universe"), *VIEWS)
def _(spark, d):
    return p.ordered_universe(_parts(spark, d)["universe"]).select("subject_id", "customer_id", "sensor", "event_key", "model", "generation", "tier", "severity", "likelihood")


@query("report_exemplars", _report_sql("customer_id % 2", "SELECT subject_id, CAST(place AS INTEGER) AS place, technique, n, tier_rank, customer_id, sensor, event_key, total, greatest(total - 10, 0) AS dropped FROM exemplar"), *VIEWS)
def _(spark, d):
    return _parts(spark, d, "customer_id % 2")["exemplars"].select("subject_id", "place", "technique", "n", "tier_rank", "customer_id", "sensor", "event_key", "total", "dropped")


@query("report_drift", _report_sql("customer_id", "SELECT subject_id, category, current_n, previous_n, delta FROM drift"), *VIEWS)
def _(spark, d):
    return _parts(spark, d)["drift"].select("subject_id", "category", "current_n", "previous_n", "delta")


@query("report_drift_scores", _report_sql("customer_id", "SELECT * FROM drift_score"), *VIEWS)
def _(spark, d):
    return p.drift_scores(_parts(spark, d)["drift"])


def _refs_sql(rows: str, qualified: bool, keys: tuple[str, ...]) -> str:
    """Each subject's references as JSON, by name and generation."""
    fields = [("customer_id", "customer_id" if qualified else "nullif(customer_id, subject_id)"), *sorted([("generation", "generation"), ("model", "model"), *((k, k) for k in keys)])]
    fields = sorted(fields)
    told = " || ".join(f"coalesce('\"{name}\":' || " + (f"'\"' || {c} || '\"'" if name == "model" else c) + " || ',', '')" for name, c in fields)
    return f"(SELECT subject_id, '[' || string_agg('{{' || rtrim({told}, ',') || '}}', ',' ORDER BY {', '.join(keys)}, generation, model, customer_id) || ']' AS t FROM {rows} GROUP BY subject_id)"


def _whole_sql(subject: str, qualified: bool) -> str:
    text = lambda c, quoted=True: f"""coalesce(',"{c}":{'"' if quoted else ''}' || {c} || '{'"' if quoted else ''}', '')"""
    listed = lambda t, text: f"(SELECT subject_id, string_agg({text}, ',' ORDER BY place) AS t FROM {t} GROUP BY subject_id)"
    return _report_sql(subject, f""", cited AS (SELECT subject_id, [{TECH}[tag_a + 1], {TECH}[tag_b + 1]] AS tags, cve, model, severity, likelihood, {RANK} AS r FROM top_story
        UNION ALL SELECT subject_id, [{TECH}[tag_a + 1], {TECH}[tag_b + 1]], NULL, model, severity, likelihood, {RANK} FROM top_event),
    score AS (SELECT subject_id, array_to_string(list_sort(list_distinct(flatten(list(tags)))), ',') AS ttp_tags, coalesce(string_agg(DISTINCT cve, ',' ORDER BY cve), '') AS cve_refs, max(severity) FILTER (WHERE model = 'm0') AS os,
        max(likelihood) FILTER (WHERE model = 'm0') AS ol, max(r) FILTER (WHERE model = 'm0') AS own FROM cited GROUP BY subject_id),
    technique AS (SELECT subject_id, technique, n, row_number() OVER (PARTITION BY subject_id ORDER BY n DESC, technique) AS place FROM (SELECT subject_id, technique, count(*) AS n FROM (SELECT subject_id, unnest(tags) AS technique FROM cited) GROUP BY ALL)),
    sensor_top AS (SELECT * FROM (SELECT subject_id, customer_id, sensor, count(*) AS n, row_number() OVER (PARTITION BY subject_id ORDER BY count(*) DESC, customer_id, sensor) AS place FROM scoped WHERE event_time >= TIMESTAMP '{DAY}' GROUP BY subject_id, customer_id, sensor) WHERE place <= 10),
    assembled AS (SELECT subject_id, coalesce(t.events_total, 0) AS events_total, coalesce(t.hosts, 0) AS hosts, coalesce(st.stories_total, 0) AS stories_total, s.t AS stories, e.t AS events, x.t AS exemplars, q.t AS techniques, k.t AS sensors, sr.t AS story_refs, er.t AS event_refs, xr.t AS exemplar_refs,
        coalesce(ttp_tags, '') AS ttp_tags, coalesce(cve_refs, '') AS cve_refs, greatest(coalesce(drift_severity, 0) * 100, CAST(coalesce(os, 0) AS DOUBLE)) AS severity, greatest(coalesce(drift_likelihood, 0) * 100, CAST(coalesce(ol, 0) AS DOUBLE)) AS likelihood,
        ['LOW', 'MEDIUM', 'HIGH', 'CRITICAL'][1 + greatest(coalesce(own, 0), CASE WHEN ds = 3 AND dl >= 2 THEN 3 WHEN (ds = 3 AND dl = 1) OR (ds = 2 AND dl >= 2) THEN 2 WHEN (ds = 3 AND dl = 0) OR (ds = 2 AND dl = 1) OR (ds = 1 AND dl >= 2) THEN 1 ELSE 0 END)] AS tier
        FROM (SELECT DISTINCT {subject} AS subject_id FROM range(5) r(customer_id))
        LEFT JOIN (SELECT subject_id, count(*) AS events_total, count(DISTINCT (customer_id, primary_asset)) AS hosts FROM scoped WHERE event_time >= TIMESTAMP '{DAY}' GROUP BY subject_id) t USING (subject_id)
        LEFT JOIN (SELECT subject_id, count(*) AS stories_total FROM story_leaf GROUP BY subject_id) st USING (subject_id)
        LEFT JOIN (SELECT *, (CASE WHEN drift_severity * 100 >= 40 THEN 1 ELSE 0 END + CASE WHEN drift_severity * 100 >= 60 THEN 1 ELSE 0 END + CASE WHEN drift_severity * 100 >= 80 THEN 1 ELSE 0 END) AS ds, CASE WHEN drift_likelihood = 1 THEN 3 ELSE 0 END AS dl FROM drift_score) USING (subject_id)
        LEFT JOIN score USING (subject_id) LEFT JOIN {listed("top_story", "story_id::VARCHAR")} s USING (subject_id) LEFT JOIN {listed("top_event", "event_key::VARCHAR")} e USING (subject_id)
        LEFT JOIN {listed("exemplar", "technique || ':' || n || ':' || event_key")} x USING (subject_id) LEFT JOIN {listed("technique", "technique || ':' || n")} q USING (subject_id) LEFT JOIN {listed("sensor_top", "customer_id || ':' || sensor || ':' || n")} k USING (subject_id)
        LEFT JOIN {_refs_sql("top_story", qualified, ("story_id",))} sr USING (subject_id) LEFT JOIN {_refs_sql("top_event", qualified, ("sensor", "event_key"))} er USING (subject_id) LEFT JOIN {_refs_sql("exemplar", qualified, ("sensor", "event_key"))} xr USING (subject_id)
        WHERE t.events_total IS NOT NULL OR st.stories_total IS NOT NULL)
    SELECT * EXCLUDE (story_refs, event_refs, exemplar_refs), sha256('{{"cve_refs":"' || cve_refs || '","end":"{DAY_AFTER}"' || {text("event_refs", False)} || {text("events")} || ',"events_total":' || events_total || {text("exemplar_refs", False)} || {text("exemplars")} || ',"hosts":' || hosts
        || ',"language":"EN","model":"m0","period":"DAILY"' || {text("sensors")} || ',"start":"{DAY}"' || {text("stories")} || ',"stories_total":' || stories_total || {text("story_refs", False)} || ',"subject":' || subject_id || {text("techniques")} || ',"tier":"' || tier || '","ttp_tags":"' || ttp_tags || '","zone":"UTC"}}') AS input_hash FROM assembled""")


def _report(spark, d, subject, qualified=False):
    return p.periodic_report(_scope(spark, subject), v.incident(spark, d), v.story_state(spark, d), v.report_member(spark, d), v.story_result(spark, d), v.result(spark, d), _latest_in(spark, d), MODELS, DAY_BEFORE, DAY, DAY_AFTER, qualified)


@query("periodic_report", _whole_sql("customer_id", False), *VIEWS)
def _(spark, d):
    return _report(spark, d, "customer_id")


@query("group_report", _whole_sql("customer_id % 2", True), *VIEWS)
def _(spark, d):
    return _report(spark, d, "customer_id % 2", True)


_LEAVES = """, leaf AS (SELECT *, row_number() OVER (PARTITION BY subject_id ORDER BY rank, place) AS leaf FROM (SELECT subject_id, 1 AS rank, 'story' AS kind, place, story_id AS id FROM top_story UNION ALL
    SELECT subject_id, 2, 'event', place, event_key FROM top_event UNION ALL SELECT subject_id, 3, 'exemplar', place, event_key FROM exemplar))"""
_id = lambda: F.coalesce("story_id", "event_key")


@query("report_policies", _report_sql("customer_id % 2", _LEAVES + """, told AS (SELECT subject_id, leaf, CASE WHEN id % 40 = 0 THEN '' WHEN id % 50 = 1 THEN 'p2' ELSE 'p1' END AS version FROM leaf), first AS (SELECT subject_id, arg_min(version, leaf) AS f FROM told GROUP BY subject_id),
    seen AS (SELECT subject_id, any_value(f) AS f, min(leaf) FILTER (WHERE version = '') AS e, min(leaf) FILTER (WHERE version <> '' AND version <> f) AS o FROM told JOIN first USING (subject_id) GROUP BY subject_id)
    SELECT subject_id, CASE WHEN e IS NOT NULL AND (o IS NULL OR e < o) THEN 'missing' WHEN o IS NOT NULL THEN 'mismatched' ELSE 'ok' END AS state, CASE WHEN e IS NULL AND o IS NULL THEN f END AS version FROM seen"""), *VIEWS)
def _(spark, d):
    leaves = t.report_tokens(p.report_leaf_rows(_parts(spark, d, "customer_id % 2")).withColumn("texts", F.array().cast("array<string>")), "subject_id")
    version = F.when(_id() % 40 == 0, "").when(_id() % 50 == 1, "p2").otherwise("p1")
    return g.policy_agreement(leaves.withColumn("policy", version), ["subject_id"], "leaf", "policy")


@query("report_leaf_tokens", _report_sql("customer_id % 2", _LEAVES + """ SELECT subject_id, kind, CAST(place AS INTEGER) AS place, CAST(leaf AS INTEGER) AS leaf, 'from <<REDACTED_IP_R' || leaf || '_001>> and <<REDACTED_MAC_R' || leaf || '_002>>' AS text,
    '<<REDACTED_IP_' || CASE kind WHEN 'story' THEN 'E' || (1 + id % 4) || '_' ELSE '' END || lpad((id % 9)::VARCHAR, 3, '0') || '>>' AS source FROM leaf"""), *VIEWS)
def _(spark, d):
    infix = F.when(F.col("kind") == "story", F.concat(F.lit("E"), (1 + _id() % 4).cast("string"), F.lit("_"))).otherwise("")
    token = lambda k: F.concat(F.lit(f"<<REDACTED_{k}_"), infix, F.lpad((_id() % 9).cast("string"), 3, "0"), F.lit(">>"))
    leaves = p.report_leaf_rows(_parts(spark, d, "customer_id % 2")).withColumn("texts", F.array(F.concat(F.lit("from "), token("IP"), F.lit(" and "), token("MAC"))))
    out = t.report_tokens(leaves, "subject_id")
    return out.select("subject_id", "kind", "place", "leaf", F.col("texts")[0].alias("text"), F.col("tokens")[0]["source"].alias("source"))


@query("pinned_inputs", """SELECT report, position, customer_id, story_id, tier FROM (SELECT *, bool_and(tier IS NOT NULL) OVER (PARTITION BY report) AS whole FROM (
    SELECT o_orderkey // 3 AS report, o_orderkey % 3 AS position, CASE WHEN o_orderkey % 41 = 0 THEN 9 ELSE o_custkey % 5 END AS customer_id, o_orderkey AS story_id FROM orders)
    LEFT JOIN (SELECT c.customer_id, story_id, tier FROM (SELECT DISTINCT story_id, customer_id FROM incident) c JOIN story_result r USING (story_id) WHERE generation = 1 AND model = 'm' || (story_id % 3) AND NOT superseded) USING (customer_id, story_id)) WHERE whole""", "incident", "story_result")
def _(spark, d):
    o = v.table(spark, d, "orders")
    refs = o.selectExpr("o_orderkey div 3 AS report", "o_orderkey % 3 AS position", "CASE WHEN o_orderkey % 41 = 0 THEN 9 ELSE o_custkey % 5 END AS customer_id", "o_orderkey AS story_id")
    results = v.story_result(spark, d).where("generation = 1 AND model = concat('m', story_id % 3) AND NOT superseded").select("story_id", "tier")
    leaves = v.incident(spark, d).select("story_id", "customer_id").distinct().join(results, "story_id")
    return p.pinned_report(refs, leaves, ["customer_id", "story_id"]).select("report", "position", "customer_id", "story_id", "tier")


_SHIFT = "- INTERVAL 9 HOUR"  # Seoul is nine hours ahead all year
_END = "CASE period WHEN 'DAILY' THEN bucket + INTERVAL 1 DAY WHEN 'WEEKLY' THEN bucket + INTERVAL 7 DAY ELSE bucket + INTERVAL 1 MONTH END"
_FORM = "'%Y-%m-%d %H:%M:%S'"


@query("report_windows", f""", {ROLLUP} SELECT DISTINCT period, strftime(bucket, '%Y-%m-%d') AS bucket, strftime(CASE period WHEN 'DAILY' THEN bucket - INTERVAL 1 DAY WHEN 'WEEKLY' THEN bucket - INTERVAL 7 DAY ELSE bucket - INTERVAL 1 MONTH END {_SHIFT}, {_FORM}) AS previous,
    strftime(bucket {_SHIFT}, {_FORM}) AS start, strftime({_END} {_SHIFT}, {_FORM}) AS "end" FROM rollup
    UNION ALL SELECT 'LIVE', '1970-01-01', '2024-01-29 00:00:00', '2024-01-30 00:00:00', '2024-01-31 00:00:00'""", "baseline")
def _(spark, d):
    buckets = a.bucket_rollup(v.baseline(spark, d)).select("period", "bucket").distinct()
    buckets = buckets.unionByName(spark.range(1).select(F.lit("LIVE").alias("period"), F.lit(c.LIVE_DATE).cast("date").alias("bucket")))
    w = buckets.withColumn("w", c.windows(F.col("period"), F.col("bucket"), F.lit("Asia/Seoul"), NOW))
    return w.select("period", F.col("bucket").cast("string").alias("bucket"), *(F.date_format(f"w.{n}", "yyyy-MM-dd HH:mm:ss").alias(n) for n in ("previous", "start", "end")))


@query("period_buckets", "SELECT DISTINCT strftime(ts, '%Y-%m-%d') AS day, strftime(date_trunc('week', ts), '%Y-%m-%d') AS week, strftime(date_trunc('month', ts), '%Y-%m-%d') AS month, '1970-01-01' AS live FROM events")
def _(spark, d):
    day = v.table(spark, d, "events").select(F.to_date("ts").alias("day")).distinct()
    kinds = (("week", "WEEKLY"), ("month", "MONTHLY"), ("live", "LIVE"))
    return day.select(F.col("day").cast("string").alias("day"), *(c.bucket_of(F.col("day"), F.lit(k)).cast("string").alias(n) for n, k in kinds))


@query("year_buckets", """WITH y AS (SELECT DISTINCT year(o_orderdate) AS year FROM orders), day AS (SELECT year, unnest(generate_series(make_date(year, 1, 1), make_date(year, 12, 31), INTERVAL 1 DAY)) AS day FROM y)
    SELECT year, kind, strftime(day, '%Y-%m-%d') AS bucket FROM day, (SELECT unnest(['day', 'week', 'month']) AS kind) WHERE kind = 'day' OR (kind = 'week' AND isodow(day) = 1) OR (kind = 'month' AND day(day) = 1)""")
def _(spark, d):
    years = v.table(spark, d, "orders").select(F.year("o_orderdate").alias("year")).distinct()
    return c.buckets_of_years(years).select("year", "kind", F.col("bucket").cast("string").alias("bucket"))


@query("viewport_days", """WITH views AS (SELECT DISTINCT CASE WHEN o_orderkey % 3 = 0 THEN strftime(o_orderdate, '%Y') WHEN o_orderkey % 3 = 1 THEN strftime(o_orderdate, '%Y-%m') ELSE strftime(o_orderdate, '%Y-13') END AS view FROM orders),
    span AS (SELECT view, CASE WHEN length(view) = 4 THEN make_date(view::INT, 1, 1) WHEN view LIKE '%-13' THEN DATE '2024-05-01' ELSE (view || '-01')::DATE END AS low FROM views)
    SELECT view, strftime(unnest(generate_series(low, CASE WHEN length(view) = 4 THEN make_date(view::INT, 12, 31) ELSE last_day(low) END, INTERVAL 1 DAY)), '%Y-%m-%d') AS bucket FROM span""")
def _(spark, d):
    view = F.expr("CASE o_orderkey % 3 WHEN 0 THEN date_format(o_orderdate, 'yyyy') WHEN 1 THEN date_format(o_orderdate, 'yyyy-MM') ELSE date_format(o_orderdate, 'yyyy-13') END")
    views = v.table(spark, d, "orders").select(view.alias("view")).distinct()
    return c.days_of_views(views, "view", "2024-05-05").select("view", F.col("bucket").cast("string").alias("bucket"))


_DATE = "concat(CAST(2023 + event_id % 3 AS STRING), '-', lpad(CAST(event_id % 14 AS STRING), 2, '0'), '-', lpad(CAST(1 + event_id % 32 AS STRING), 2, '0'), CASE WHEN event_id % 19 = 0 THEN 'x' ELSE '' END)"
_INSTANT = f"concat({_DATE}, CASE event_id % 4 WHEN 0 THEN ' ' ELSE 'T' END, lpad(CAST(event_id % 26 AS STRING), 2, '0'), ':10:', lpad(CAST(event_id % 61 AS STRING), 2, '0'), CASE event_id % 5 WHEN 0 THEN 'Z' WHEN 1 THEN '.25z' WHEN 2 THEN '+09:00' WHEN 3 THEN '-24:00' ELSE '' END)"
_AS_SQL = lambda e: e.replace("STRING", "VARCHAR")
_DAY_OK = "regexp_full_match({0}, '[0-9]{{4}}-[0-9]{{2}}-[0-9]{{2}}') AND try_cast({0} AS DATE) IS NOT NULL"


@query("dates_valid", f"SELECT event_id, {_DAY_OK.format('t')} AS valid FROM (SELECT event_id, {_AS_SQL(_DATE)} AS t FROM events)")
def _(spark, d):
    return v.table(spark, d, "events").select("event_id", c.valid_date(F.expr(_DATE)).alias("valid"))


@query("instants_valid", f"""SELECT event_id, regexp_full_match(t, '[0-9]{{4}}-[0-9]{{2}}-[0-9]{{2}}T([01][0-9]|2[0-3]):10:[0-5][0-9](Z|\\.25z|\\+09:00)') AND try_cast(t[1:10] AS DATE) IS NOT NULL AS valid
    FROM (SELECT event_id, {_AS_SQL(_INSTANT)} AS t FROM events)""")
def _(spark, d):
    return v.table(spark, d, "events").select("event_id", c.valid_instant(F.expr(_INSTANT)).alias("valid"))


@query("zone_days", "SELECT event_id, strftime(ts + CASE WHEN user_id % 4 = 0 THEN INTERVAL 9 HOUR ELSE INTERVAL 0 HOUR END, '%Y-%m-%d') AS day FROM events")
def _(spark, d):
    zone = F.expr("CASE user_id % 4 WHEN 0 THEN 'Asia/Seoul' WHEN 1 THEN 'Nowhere/Land' WHEN 2 THEN 'UTC' END")
    return v.table(spark, d, "events").select("event_id", c.day_in_zone(F.col("ts"), zone).alias("day"))


@query("epochs", "SELECT user_id, max(epoch_us(ts)) AS last_micros, min(epoch_us(ts)) AS first_micros FROM events GROUP BY user_id")
def _(spark, d):
    micros = c.epoch_micros(F.col("ts"))
    return v.table(spark, d, "events").groupBy("user_id").agg(F.max(micros).alias("last_micros"), F.min(micros).alias("first_micros"))
