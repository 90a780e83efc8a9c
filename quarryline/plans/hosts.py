"""Queries of public suffixes, address classes and indicators by rules. Importing this registers them."""

from __future__ import annotations

from pyspark.sql import functions as F

from quarryline.functions import domains as o
from quarryline.functions import network as n
from quarryline.operators import indicators as k
from quarryline.plans.catalog import query
from quarryline.sources import views as v

#: A short list in the form of the public one; a deployment gives the file of the whole (``domains.read_rules``).
RULES = ("// a list", "com", "nz", "co.nz", "*.ck", "!www.ck", "jp", "*.kawasaki.jp", "!city.kawasaki.jp", "test")
_HOSTS = ("x.y.bad{}.co.nz", "bad{}.nz", "co.nz", "a.b{}.ck", "b{}.ck", "deep.www.ck", "u.v{}.kawasaki.jp", "a.city.kawasaki.jp", "WWW.Bad{}.COM.", "h{}.unknown", "10.0.0.{}", "single{}")
_SUFFIX_SQL = """CASE event_id % 12 WHEN 0 THEN 'bad' || j || '.co.nz' WHEN 1 THEN 'bad' || j || '.nz' WHEN 3 THEN 'a.b' || j || '.ck' WHEN 5 THEN 'www.ck' WHEN 6 THEN 'u.v' || j || '.kawasaki.jp'
    WHEN 7 THEN 'city.kawasaki.jp' WHEN 8 THEN 'bad' || j || '.com' {} END"""


def _hosts(spark, d):
    texts = F.array(*(F.concat(F.lit(h.split("{}")[0]), (F.col("event_id") % 97).cast("string"), F.lit(h.split("{}")[1])) if "{}" in h else F.lit(h) for h in _HOSTS))
    return v.table(spark, d, "events").select("event_id", F.get(texts, (F.col("event_id") % len(_HOSTS)).cast("int")).alias("host"))


@query("registered_domains", f"SELECT event_id, {_SUFFIX_SQL.format('WHEN 9 THEN ' + chr(39) + 'h' + chr(39) + ' || j || ' + chr(39) + '.unknown' + chr(39))} AS registered, {_SUFFIX_SQL.format('')} AS strict FROM (SELECT event_id, event_id % 97 AS j FROM events)")
def _(spark, d):
    rules = o.SuffixRules(RULES)
    rows = o.with_registered(_hosts(spark, d), "host", rules)
    return o.with_registered(rows, "host", rules, "strict", strict=True).select("event_id", "registered", "strict")


_V4 = [(name, block) for name, block in n.SPECIAL if "." in block]
_AS_NUMBER = lambda block: " + ".join(f"{x}::BIGINT * {256 ** (3 - i)}" for i, x in enumerate(block.split("/")[0].split(".")))
_BLOCKS = "SELECT * FROM (VALUES " + ", ".join(f"('{name}', {_AS_NUMBER(block)}, {block.split('/')[1]}, {i})" for i, (name, block) in enumerate(_V4)) + ") b(name, low, bits, i)"


@query("address_classes", f"""WITH block AS ({_BLOCKS}), edge AS (SELECT event_id, CASE event_id % 4 WHEN 0 THEN low - 1 WHEN 1 THEN low WHEN 2 THEN low + (1 << (32 - bits)) - 1 ELSE low + (1 << (32 - bits)) END AS number FROM events JOIN block ON i = event_id // 4 % {len(_V4)}),
    held AS (SELECT event_id, number & 4294967295 AS number FROM edge)
    SELECT event_id, c AS class, c = 'unicast' AS public, c AS mapped FROM (SELECT event_id, coalesce(arg_max(name, bits), 'unicast') AS c FROM held LEFT JOIN block ON number >= low AND number < low + (1 << (32 - bits)) GROUP BY event_id)""")
def _(spark, d):
    low = F.array(*(F.lit(int(n.ipaddress.ip_network(b).network_address)) for _, b in _V4))
    size = F.array(*(F.lit(n.ipaddress.ip_network(b).num_addresses) for _, b in _V4))
    i = (F.floor(F.col("event_id") / 4) % len(_V4)).cast("int")
    move = F.get(F.array(F.lit(-1).cast("long"), F.lit(0).cast("long"), F.get(size, i) - 1, F.get(size, i)), (F.col("event_id") % 4).cast("int"))
    digits = F.lpad(F.lower(F.hex((F.get(low, i) + move).bitwiseAND((1 << 32) - 1))), 8, "0")
    rows = v.table(spark, d, "events").select("event_id", digits.alias("h"))
    return rows.select("event_id", n.address_class(F.col("h")).alias("class"), n.is_public(F.col("h")).alias("public"), n.address_class(F.concat(F.lit("0" * 20 + "ffff"), "h")).alias("mapped"))


@query("indicators_by_rules", """SELECT event_id, 'DOMAIN' AS entity, 'a.b' || j || '.co.nz' AS value, 'a.b' || j || '.co.nz' AS candidates, NULL AS public FROM (SELECT event_id, event_id % 97 AS j FROM events)
    UNION ALL SELECT event_id, 'URL', 'http://c.d' || event_id % 97 || '.co.nz/x', 'http://c.d' || event_id % 97 || '.co.nz/x,c.d' || event_id % 97 || '.co.nz,d' || event_id % 97 || '.co.nz', NULL FROM events
    UNION ALL SELECT event_id, 'IP', '203.0.113.' || event_id % 256, '203.0.113.' || event_id % 256, FALSE FROM events UNION ALL SELECT event_id, 'IP', '8.1.1.1', '8.1.1.1', TRUE FROM events""")
def _(spark, d):
    note = F.expr("concat('a.b', event_id % 97, '.co.nz and co.nz, http://c.d', event_id % 97, '.co.nz/x script.js page.html h.unknown 203.0.113.', event_id % 256, ' <<REDACTED_IP_001>> 010.1.1.1')")
    known = F.create_map(F.lit("1.1.1.1"), F.lit("<<REDACTED_IP_001>>"), F.lit("2.2.2.2"), F.lit("<<REDACTED_IP_001>>"))
    rows = v.table(spark, d, "events").select("event_id", note.alias("note"), known.alias("known"))
    out = k.extract_all(rows, "event_id", "note", "known", rules=o.SuffixRules(RULES), strict=True)
    return out.select("event_id", "entity", "value", F.array_join("candidates", ",").alias("candidates"), "public")
