"""Small fixtures: nulls, empty values, ties and repeated rows in the parsers, redaction and planning rules."""

from pyspark.sql import functions as F

from quarryline.operators import lineage, redaction, workflow
from quarryline.sources import feeds
from tests.test_catalog import spark  # noqa: F401


def _lines(spark, *values):  # noqa: F811
    return spark.createDataFrame([(v,) for v in values], "value string")


def _rows(df, *columns):
    return sorted(tuple(r) for r in df.select(*columns).collect())


def test_redaction_keeps_and_continues_tokens(spark):  # noqa: F811
    texts = [
        (1, "a@b.co wrote to c@d.org and a@b.co from 10.0.0.1, 10.0.0.12, 8.8.8.8", {"c@d.org": "<<REDACTED_EMAIL_004>>"}),
        (2, None, {}),
        (3, "", {}),
        (4, "mac 00:1B:44:11:3A:B7 host fe80::1 on www.Own.test, not other.test; at 12:30:45", {}),
    ]
    rows = spark.createDataFrame(texts, "id int, text string, known map<string,string>")
    out = redaction.redact(rows, ranges=[(134744072, 134744072)], domains=["own.test"])
    got = {r.id: r for r in out.collect()}
    assert got[1].text == "<<REDACTED_EMAIL_005>> wrote to <<REDACTED_EMAIL_004>> and <<REDACTED_EMAIL_005>> from <<REDACTED_IP_001>>, <<REDACTED_IP_002>>, <<REDACTED_IP_003>>"
    assert got[2].text is None and got[2].known == {} and got[3].text == ""
    assert got[4].text == "mac <<REDACTED_MAC_001>> host <<REDACTED_IP_001>> on <<REDACTED_DOMAIN_001>>, not other.test; at 12:30:45"
    back = out.select("id", redaction.restore(F.col("text"), F.col("known")).alias("text"))
    assert {r.id: r.text for r in back.collect()} == {i: t for i, t, _ in texts}


def test_answers_scopes_and_leaks(spark):  # noqa: F811
    rows = spark.createDataFrame([(1, "x@y.zz and 10.0.0.1 and q@r.st and 10.0.0.2 x@y.zz", {"x@y.zz": "<<REDACTED_EMAIL_001>>"}), (2, None, {})], "id int, text string, known map<string,string>")
    got = {r.id: (r.text, r.unverified) for r in redaction.verify_answer(rows).collect()}
    assert got[1] == ("<<REDACTED_EMAIL_001>> and <<UNVERIFIED_IP_001>> and <<UNVERIFIED_EMAIL_001>> and <<UNVERIFIED_IP_002>> <<REDACTED_EMAIL_001>>", 3)
    assert got[2] == (None, 0)
    one = spark.createDataFrame([("<<REDACTED_IP_001>> <<REDACTED_IP_F2_003>> <<REDACTED_CARD_1>> <<REDACTED_MAC_E1_002>> x@y.zz", ["<<REDACTED_MAC_E0_001>>"])], "t string, allowed array<string>")
    assert one.select(redaction.mask_facts(F.col("t"))).first()[0].split()[1] == "[redacted]"
    assert one.select(redaction.to_scope(F.col("t"), "E", F.lit(3))).first()[0].startswith("<<REDACTED_IP_E3_001>> ")
    assert tuple(redaction.leaks(one.withColumn("k", F.lit(1)), "k", "t", "allowed").first()) == (1, 1, 1, 1, 1)
    assert redaction.policy_version("1", [], ["b", "a"]) == redaction.policy_version("1", [], ["a", "b"]) and "ranges:empty" in redaction.policy_version("1")


def test_feed_parsers_pass_over_what_is_malformed(spark):  # noqa: F811
    lines = _lines(spark, None, "", "# c", "; d", ' "1","2","http://u@H.test:80/p","x" ', '"1","2","http://[::1]/p","x"', '"1"', '"1","2","","x"')
    assert _rows(feeds.url_rows(lines), "entity", "indicator") == [("DOMAIN", "h.test"), ("URL", "http://[::1]/p"), ("URL", "http://u@H.test:80/p")]
    assert _rows(feeds.drop_ranges(_lines(spark, "1.2.3.0/24 ; S", "1.2.3.4", "; x/y", None)), "cidr") == [("1.2.3.0/24",)]
    assert _rows(feeds.drop_ranges_json(_lines(spark, '{"cidr":" 1.2.3.0/24 "}', "{", '{"cidr":null}', None)), "cidr") == [("1.2.3.0/24",)]
    assert _rows(feeds.generic_list(_lines(spark, "HXXPS://a[.]b(.)c", "u[AT]v"), fanged=False), "indicator") == [("httpS://a.b.c",), ("u@v",)]
    assert feeds.unparseable(lines, feeds.drop_ranges_json(lines)).first()[0] is True
    assert feeds.unparseable(_lines(spark, "# only"), lines.limit(0)).first()[0] is False
    kev = _lines(spark, '{"vulnerabilities":[{"cveID":" cve-2020-1234 ","dateAdded":"2020-02-30"},{"cveID":null}]}', "{", None)
    assert _rows(feeds.exploited(kev), "cve", "added") == [("CVE-2020-1234", None)]
    assert _rows(feeds.exploit_scores(_lines(spark, "cve,epss", "CVE-2020-1234,0.5,1", "CVE-2020-1235,NaN,1", "CVE-2020-1236,x,1", "CVE-2020-1237")), "cve", "score") == [("CVE-2020-1234", 0.5)]
    free = spark.createDataFrame([(1, "see http://1.2.3.4/x. and 5.6.7.8 5.6.7.8"), (2, None)], "k int, t string")
    assert _rows(feeds.free_text(free, "k", "t"), "k", "entity", "indicator") == [(1, "IP", "5.6.7.8"), (1, "URL", "http://1.2.3.4/x")]


def test_policy_agreement_by_first_offender(spark):  # noqa: F811
    rows = [("ok", 1, "a"), ("ok", 2, "a"), ("gap", 1, "a"), ("gap", 2, None), ("gap", 3, "b"), ("mix", 1, "a"), ("mix", 2, "b"), ("mix", 3, ""), ("none", 1, "")]
    out = lineage.policy_agreement(spark.createDataFrame(rows, "k string, n int, v string"), ["k"], "n", "v")
    assert _rows(out, "k", "state", "version") == [("gap", "missing", None), ("mix", "mismatched", None), ("none", "missing", None), ("ok", "ok", "a")]


def test_planning_rules_on_empty_and_tied_rows(spark):  # noqa: F811
    marks = spark.createDataFrame([("a", 5, "soft"), ("a", 5, "strict"), ("a", 4, "strict"), ("b", None, "soft"), ("c", 1, "soft")], "subject string, at int, quality string")
    assert _rows(workflow.watermark(marks), "subject", "at", "quality") == [("a", 5, "strict"), ("c", 1, "soft")]
    states = spark.createDataFrame([("x", "ready"), ("y", "dirty"), ("z", "pending"), ("w", "dirty")], "subject string, status string")
    jobs = spark.createDataFrame([("y", "EN", 3), ("w", "EN", 50)], "subject string, language string, generation int")
    assert _rows(workflow.job_seeds(states, jobs, ["EN"]), "subject", "generation") == [("x", 1), ("y", 4)]
    groups = spark.createDataFrame([(1, 30), (2, None), (3, None)], "group_id int, policy_days int")
    members = spark.createDataFrame([(1, 40, 10), (2, 5, 90), (3, 5, None)], "group_id int, ingestion_days int, analysis_days int")
    assert dict(_rows(workflow.retention_bounds(members, groups, True), "group_id", "bound_days")) == {1: 30, 2: 90, 3: None}
    assert dict(_rows(workflow.retention_bounds(members, groups, False), "group_id", "bound_days")) == {1: 10, 2: 90, 3: None}
    buckets = spark.createDataFrame([(1, "DAILY", 1, 5)], "group_id int, period string, bucket int, events int")
    held = spark.createDataFrame([(1, "DAILY", 2, 7, "ready"), (1, "DAILY", 3, 7, "archived"), (1, "DAILY", 4, 0, "ready")], "group_id int, period string, bucket int, events int, status string")
    assert _rows(workflow.group_actions(buckets, held), "bucket", "events", "action") == [(1, 5, "seed"), (2, 0, "dirty"), (4, 0, "keep")]
