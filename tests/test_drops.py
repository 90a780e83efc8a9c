"""Shapes of factors, techniques and references, and their audit rows, on a few rows."""

from pyspark.sql import functions as F

from quarryline.operators import drops as o
from tests.test_catalog import spark  # noqa: F401


def _rows(df):
    return sorted(tuple(r) for r in df.collect())


def test_factors_by_every_shape(spark):  # noqa: F811
    astral = "\U0001f600"
    lists = [
        (1, ["a", None, "", " \t\n", "\u00a0\u2003\u3000\ufeff", "The x", "This y", "Thesis", "the x", "z" * 80, "z" * 81, astral * 40, astral * 41]),
        (2, ["This", "The ", "  The x"]), (3, []), (4, None), (5, ["a", "b", "c", "d", "e", "f", "The g", "h"]), (6, ["The " + "z" * 90, "\n"]),
    ]
    df = spark.createDataFrame(lists, "id int, f array<string>").select("id", o.judged_factors(F.col("f")).alias("j")).orderBy("id")
    j = {r["id"]: r["j"] for r in df.collect()}
    assert j[1]["kept"] == ["a", "Thesis", "the x", "z" * 80, astral * 40] and j[1]["truncated"] == [] and not j[1]["sentinel"]
    assert [(d["item"], d["reason"]) for d in j[1]["dropped"]] == [(None, o.EMPTY), ("", o.EMPTY), (" \t\n", o.EMPTY), ("\u00a0\u2003\u3000\ufeff", o.EMPTY), ("The x", o.SENTENCE), ("This y", o.SENTENCE), ("z" * 81, o.OVERSIZED), (astral * 41, o.OVERSIZED)]
    assert j[2]["kept"] == ["This", "  The x"] and [d["reason"] for d in j[2]["dropped"]] == [o.SENTENCE]
    for k in (3, 4):
        assert (j[k]["kept"], j[k]["dropped"], j[k]["sentinel"]) == ([o.NO_FACTOR], [], True)
    assert j[5]["kept"] == list("abcde") and j[5]["truncated"] == ["f", "h"] and len(j[5]["dropped"]) == 1
    # An item that breaks several rules has the first one's reason.
    assert [d["reason"] for d in j[6]["dropped"]] == [o.OVERSIZED, o.EMPTY] and j[6]["sentinel"]


def test_factor_audit_rows(spark):  # noqa: F811
    df = spark.createDataFrame([(1, ["", "The a", " "], ["ok"], 7), (2, None, ["", "b"], 8), (1, ["x"], None, 9)], "key int, s array<string>, l array<string>, axis int")
    got = _rows(o.factor_audit(df, ["key"], {"severity": "s", "likelihood": "l"}))
    assert got == sorted([
        (1, "severity", o.EMPTY, ["", " "], False), (1, "severity", o.SENTENCE, ["The a"], False), (1, "severity", o.ALL, ["", "The a", " "], True),
        (2, "severity", o.ALL, [], True), (2, "likelihood", o.EMPTY, [""], False), (1, "likelihood", o.ALL, [], True),
    ])
    assert not _rows(o.factor_audit(df.limit(0), ["key"], {"severity": "s"}))


def test_techniques(spark):  # noqa: F811
    df = spark.createDataFrame([(1, ["T1001", "t1001", "T9999", "T1001.001", "T1001\n", None, "T8888"]), (2, None), (3, ["T1001", "T1001"])], "key int, tags array<string>")
    got = _rows(o.technique_audit(df, ["key"], "tags", ["T1001", "T1001.001"], "v9"))
    assert got == [(1, o.FORMAT, ["t1001", "T1001\n", None], "v9"), (1, o.UNKNOWN_TECHNIQUE, ["T9999", "T8888"], "v9")]
    valid = df.select("key", o.judged_techniques(F.col("tags"), ["T1001", "T1001.001"]).getField("valid").alias("v"))
    assert _rows(valid) == [(1, ["T1001", "T1001.001"]), (2, []), (3, ["T1001", "T1001"])]


def test_references(spark):  # noqa: F811
    catalog = spark.createDataFrame([("CVE-2020-0001", "nvd,kev"), ("CVE-2020-0002", "nvd"), ("CVE-2020-0003", "epss")], "cve string, sources string")
    refs = [" cve-2020-0001", "CVE-2020-0001", "bad", "bad", "CVE-2020-0002", None, "CVE-2021-99999", "CVE-2020-0003"]
    df = spark.createDataFrame([(1, refs), (2, []), (3, None), (None, ["CVE-2020-0002"])], "key int, refs array<string>")
    judged = {r["key"]: r for r in o.judged_references(df, ["key"], "refs", catalog, ["kev", "epss"], True).collect()}
    assert judged[1]["valid"] == ["CVE-2020-0001", "CVE-2020-0003"]
    assert [(d["item"], d["reason"]) for d in judged[1]["dropped"]] == [("bad", o.FORMAT), ("bad", o.FORMAT), ("CVE-2020-0002", o.DISABLED), (None, o.FORMAT), ("CVE-2021-99999", o.UNKNOWN_ID)]
    assert (judged[2]["valid"], judged[2]["dropped"], judged[3]["valid"]) == ([], [], []) and judged[None]["dropped"][0]["reason"] == o.DISABLED
    unsure = o.judged_references(df, ["key"], "refs", catalog, ["nvd"], False).where("key = 1")
    assert _rows(o.reference_audit(unsure, ["key"])) == [(1, o.UNSURE, ["CVE-2021-99999"]), (1, o.FORMAT, ["bad", "bad", None]), (1, o.DISABLED, ["CVE-2020-0003"])]
    assert o.reference_audit(o.judged_references(df, ["key"], "refs", catalog, [], True), ["key"]).where("reason = 'source_disabled'").count() == 2
