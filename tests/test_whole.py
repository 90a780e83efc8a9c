"""Inputs of the security-event operators on which a bound or a cut would show."""

import ipaddress

from pyspark.sql import functions as F

from quarryline.functions import calendar, network, semantics
from quarryline.operators import indicators, intel, lineage, redaction, workflow
from tests.test_catalog import spark  # noqa: F401


def test_cidr_match_of_every_length(spark):  # noqa: F811
    nets = ["1.2.3.4/32", "1.2.0.0/22", "1.2.0.0/20", "1.0.0.0/8", "0.0.0.0/0", "1.2.3.0/24", "1.0.0.0/14", "128.0.0.0/1", "255.255.255.254/31", "9.9.0.0/16", "1.2.3.4/32"]
    addresses = ["1.2.3.4", "1.2.3.5", "1.2.4.1", "1.2.16.0", "1.3.255.255", "1.4.0.0", "9.9.9.9", "127.255.255.255", "128.0.0.0", "255.255.255.255", "0.0.0.0"]
    ranges = [ipaddress.ip_network(n) for n in nets]
    feed = spark.createDataFrame([(f"{i} {n}", int(n.network_address), 32 - n.prefixlen) for i, n in enumerate(ranges)] + [("none", None, 8), ("bad", 0, 40)], "source string, low long, bits int")
    rows = spark.createDataFrame([(a, int(ipaddress.ip_address(a))) for a in addresses] + [("none", None)], "key string, number long")
    got = intel.cidr_match(rows, feed)
    assert sorted(got.columns) == ["bits", "key", "number", "source"]
    want = sorted((a, f"{i} {n}") for a in addresses for i, n in enumerate(ranges) if ipaddress.ip_address(a) in n)
    assert sorted((r.key, r.source) for r in got.collect()) == want


def test_pages_reach_every_row_with_null_keys(spark):  # noqa: F811
    rows = [(i, None if i % 3 == 0 else i % 4, None if i % 5 == 0 else i % 2) for i in range(60)]
    df = spark.createDataFrame(rows, "id int, a int, b int")
    order, cursor, seen = [("a", True), ("b", False), ("id", False)], None, []
    while True:
        page = [tuple(r) for r in semantics.page(df, order, cursor, 7).select("a", "b", "id").collect()]
        if not page:
            break
        seen += page
        cursor = list(page[-1])
    key = lambda r: (r[0] is None, -(r[0] or 0), r[1] is None, r[1] or 0, r[2])
    assert seen == sorted(((a, b, i) for i, a, b in rows), key=key)


def test_cursors_that_are_none_show_the_first_page(spark):  # noqa: F811
    df = spark.createDataFrame([(None,), ("",), ("!!",), ("YWJj",), ("A",), ("eyJhIjoxfQ",)], "c string")
    got = [r[0] for r in df.select(semantics.decode_cursor(F.col("c"), "a long")["a"]).collect()]
    assert got == [None, None, None, None, None, 1]


def test_redaction_never_reuses_a_token(spark):  # noqa: F811
    rows = [(1, "10.0.0.1 and 10.0.0.2", {"10.0.0.1": "<<REDACTED_IP_002>>"}), (2, "10.0.0.9 ::1 x@y.zz", None)]
    out = {r.id: r for r in redaction.redact(spark.createDataFrame(rows, "id int, text string, known map<string,string>")).collect()}
    assert out[1].text == "<<REDACTED_IP_002>> and <<REDACTED_IP_003>>" and len(set(out[1].known.values())) == 2
    assert out[2].text == "<<REDACTED_IP_002>> <<REDACTED_IP_001>> <<REDACTED_EMAIL_001>>"
    shared = spark.createDataFrame([("<<REDACTED_IP_001>> <<REDACTED_IP_002>>", {"a": "<<REDACTED_IP_001>>", "b": "<<REDACTED_IP_001>>", "c": "<<REDACTED_IP_002>>"})], "t string, known map<string,string>")
    assert shared.select(redaction.restore(F.col("t"), F.col("known"))).first()[0] == "<<REDACTED_IP_001>> c"


def test_addresses_equal_the_library(spark):  # noqa: F811
    texts = ["1.2.3.4", "01.2.3.4", "256.1.1.1", "1.2.3", "", None, "::", "::1", "1::", "fe80::1", "1:2:3:4:5:6:7:8", "1:2:3:4:5:6:7", "1::2::3", "::ffff:1.2.3.4", "12345::", "g::", "2001:DB8::A", "1:0:0:2:0:0:0:3", "0:0:1::", "::1.2.3.256"]
    df = spark.createDataFrame([(t,) for t in texts], "t string").withColumn("h", network.ip_hex(F.col("t")))
    for t, h, c in df.select("t", "h", network.canonical_ip(F.col("h"))).collect():
        try:
            want = ipaddress.ip_address(t)
        except ValueError:
            want = None
        if want is None:
            assert h is None, t
        else:
            assert int(h, 16) == int(want) and len(h) == (8 if want.version == 4 else 32)
            assert ipaddress.ip_address(c) == want and ("." in t or c == str(want))


def test_urls_and_domains(spark):  # noqa: F811
    urls = {"HTTP://User@EX.com:80": "http://ex.com/", "https://a.b:8443/x%2fy?q=%aa#f": "https://a.b:8443/x%2Fy?q=%AA", "ftp://x.y/": None, "http://": None, None: None}
    got = {r.t: r.v for r in spark.createDataFrame([(t,) for t in urls], "t string").select("t", indicators.normal_url(F.col("t"))["value"].alias("v")).collect()}
    assert got == urls
    names = {"Ex.COM.": "ex.com", "b\u00fccher.example": "xn--bcher-kva.example", "...": None, None: None}
    got = {r.t: (r.i.value if r.i else None) for r in spark.createDataFrame([(t,) for t in names], "t string").select("t", indicators.normal_domain(F.col("t")).alias("i")).collect()}
    assert got == names


def test_windows_across_a_change_of_clocks(spark):  # noqa: F811
    rows = [("DAILY", "2024-03-10"), ("DAILY", "2024-03-11"), ("MONTHLY", "2024-03-31")]
    df = spark.createDataFrame(rows, "period string, b string").withColumn("w", calendar.windows(F.col("period"), F.col("b").cast("date"), F.lit("America/New_York"), "2024-01-01"))
    got = [tuple(str(x) for x in r.w) for r in df.select("w").collect()]
    assert got[0] == ("2024-03-09 05:00:00", "2024-03-10 05:00:00", "2024-03-11 04:00:00")
    assert got[1][0] == "2024-03-10 05:00:00" and got[2][0] == "2024-02-29 05:00:00"


def test_only_the_last_of_new_rows_is_live(spark):  # noqa: F811
    held = spark.createDataFrame([("k", "a", 3, None)], "key string, payload string, generation int, superseded_at timestamp_ntz")
    new = spark.createDataFrame([("k", "b"), ("k", "c"), ("l", "d")], "key string, payload string")
    out = workflow.supersede(held, new, ["key"], F.lit("2024-01-01").cast("timestamp_ntz")).collect()
    assert sorted((r.key, r.payload, r.generation, r.superseded_at is None) for r in out) == [("k", "a", 3, False), ("k", "b", 4, False), ("k", "c", 5, True), ("l", "d", 1, True)]
    subjects = spark.createDataFrame([("x",)], "s string")
    none = lineage.policy_agreement(spark.createDataFrame([], "s string, n int, v string"), ["s"], "n", "v")
    assert lineage.policy_of_all(subjects, none, ["s"]).first()["state"] == "baseline-only"
