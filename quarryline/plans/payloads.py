"""Queries of payload rewriting and report tokens. Importing this registers them."""

from __future__ import annotations

from pyspark.sql import functions as F

from quarryline.operators import report_tokens as t
from quarryline.operators import trees as j
from quarryline.plans.catalog import query
from quarryline.sources import views as v

#: A payload with addresses among its keys, escapes in its values and the same value at several depths.
_PAYLOAD = """concat('{"10.0.0.1":"k", "who" : "\\\\u0062ob', event_id, '@x.com\\\\nfrom 10.0.0.', event_id % 256, '","list":["10.0.0.7",{"a@b.co":"mac 00:1B:44:11:3A:B7"},', event_id, ',null,true],"again":"bob', event_id, '@x.com \\\\"8.8.8.8\\\\""}')"""


def _payloads(spark, d):
    return v.table(spark, d, "events").select("event_id", F.expr(_PAYLOAD).alias("payload"), F.lit(None).cast("map<string,string>").alias("known"))


def _told(who: str, first: str, second: str, mac: str, again: str) -> str:
    return f"""'{{"10.0.0.1":"k", "who" : "{who}\\nfrom ' || {first} || '","list":["' || {second} || '",{{"a@b.co":"mac {mac}"}},' || event_id || ',null,true],"again":"{again} \\"8.8.8.8\\""}}'"""


_REDACTED = _told("<<REDACTED_EMAIL_001>>", "'<<REDACTED_IP_001>>'", "CASE WHEN event_id % 256 = 7 THEN '<<REDACTED_IP_001>>' ELSE '<<REDACTED_IP_002>>' END", "<<REDACTED_MAC_001>>", "<<REDACTED_EMAIL_001>>")
_PLAIN = _told("bob' || event_id || '@x.com", "'10.0.0.' || event_id % 256", "'10.0.0.7'", "00:1B:44:11:3A:B7", "bob' || event_id || '@x.com")


@query("redact_payloads", f"SELECT event_id, {_REDACTED} AS payload, CASE WHEN event_id % 256 = 7 THEN 3 ELSE 4 END AS tokens FROM events")
def _(spark, d):
    return j.redact_json(_payloads(spark, d)).select("event_id", "payload", F.size("known").alias("tokens"))


@query("redact_payloads_restore", f"SELECT event_id, {_PLAIN} AS payload FROM events")
def _(spark, d):
    return j.restore_json(j.redact_json(_payloads(spark, d))).select("event_id", "payload")


_AGAIN = _told("<<REDACTED_EMAIL_001>>", "'<<REDACTED_IP_001>>'", "CASE WHEN event_id % 256 = 7 THEN '<<REDACTED_IP_001>>' ELSE '<<REDACTED_IP_002>>' END", "<<REDACTED_MAC_001>>", "<<REDACTED_EMAIL_001>>").replace("8.8.8.8", "' || CASE WHEN event_id % 256 = 7 THEN '<<REDACTED_IP_002>>' ELSE '<<REDACTED_IP_003>>' END || '")


@query("redact_payloads_again", f"SELECT event_id, {_AGAIN} AS payload, 'p2' AS version FROM events WHERE event_id % 2 = 1")
def _(spark, d):
    rows = j.redact_json(_payloads(spark, d)).withColumn("version", F.when(F.col("event_id") % 2 == 1, "p1").otherwise("p2"))
    return j.redact_json_again(rows, "p2", ranges=[(134744072, 134744072)])[0].select("event_id", "payload", "version")


_LEAVES = """SELECT user_id AS report, CASE event_id % 3 WHEN 0 THEN 'story' WHEN 1 THEN 'event' ELSE 'exemplar' END AS kind, event_id AS place, event_id FROM events"""


def _leaves(spark, d):
    kind = F.expr("CASE event_id % 3 WHEN 0 THEN 'story' WHEN 1 THEN 'event' ELSE 'exemplar' END")
    infix = F.when(F.col("kind") == "story", F.concat(F.lit("_E"), (1 + F.col("event_id") % 4).cast("string"))).otherwise("")
    token = lambda k, n: F.concat(F.lit(f"<<REDACTED_{k}"), infix, F.lit(f"_{n}>>"))
    texts = F.array(F.concat(F.lit("from "), token("IP", "007"), F.lit(" to "), token("EMAIL", "001"), F.lit(" fact <<REDACTED_IP_F1_001>>")), F.lit(None).cast("string"), F.concat(token("EMAIL", "001"), F.lit(" again "), token("MAC", "002")))
    return v.table(spark, d, "events").select(F.col("user_id").alias("report"), kind.alias("kind"), F.col("event_id").alias("place"), "event_id").withColumn("texts", texts)


_NUMBERED = f"(SELECT *, row_number() OVER (PARTITION BY report ORDER BY CASE kind WHEN 'story' THEN 1 WHEN 'event' THEN 2 ELSE 3 END, place) AS leaf FROM ({_LEAVES}))"


@query("report_tokens", f"""SELECT report, kind, place, CAST(leaf AS INTEGER) AS leaf, 'from <<REDACTED_IP_R' || leaf || '_001>> to <<REDACTED_EMAIL_R' || leaf || '_002>> fact ' || CASE kind WHEN 'story' THEN '[redacted]' ELSE '<<REDACTED_IP_F1_001>>' END AS first,
    '<<REDACTED_EMAIL_R' || leaf || '_002>> again <<REDACTED_MAC_R' || leaf || '_003>>' AS third, 3 AS tokens FROM {_NUMBERED}""")
def _(spark, d):
    out = t.report_tokens(_leaves(spark, d))
    return out.select("report", "kind", "place", "leaf", F.col("texts")[0].alias("first"), F.col("texts")[2].alias("third"), F.size("tokens").alias("tokens"))


@query("report_restored", f"""SELECT report, kind, place, 'from 10.0.0.' || event_id % 256 || ' to e' || event_id || '@x.com fact ' || CASE kind WHEN 'story' THEN '[redacted]' ELSE '<<REDACTED_IP_F1_001>>' END AS first,
    'e' || event_id || '@x.com again <<REDACTED_MAC_R' || leaf || '_003>>' AS third FROM {_NUMBERED}""")
def _(spark, d):
    rewritten = t.report_tokens(_leaves(spark, d))
    known = F.map_from_arrays(F.array(F.concat(F.lit("10.0.0."), (F.col("event_id") % 256).cast("string")), F.concat(F.lit("e"), F.col("event_id").cast("string"), F.lit("@x.com"))), F.array(F.lit("<<REDACTED_IP_007>>"), F.lit("<<REDACTED_EMAIL_001>>")))
    maps = _leaves(spark, d).select("report", "kind", "place", F.when(F.col("kind") == "story", 1 + F.col("event_id") % 4).alias("member"), known.alias("known"))
    back = rewritten.join(t.report_values(rewritten, maps), "report", "left")
    return back.select("report", "kind", "place", *(t.restore_report(F.col("texts")[i], F.col("values")).alias(n) for i, n in ((0, "first"), (2, "third"))))
