"""JSON payloads redacted as trees against a plain walk, and report tokens against a plain renumbering."""

import json
import random
import re

from pyspark.sql import functions as F

from quarryline.operators import redaction, report_tokens, trees
from tests.test_catalog import spark  # noqa: F401

VALUES = ["10.0.0.1", "bob@x.com", "fe80::1", "8.8.8.8", "aa:bb:cc:dd:ee:ff", "line\nbob@x.com", 'a "q" \\ 10.0.0.2', "é中\U0001f600 10.1.1.1", "", "own.test www.own.test", "at 12:30:45", "\t", "::1 and 172.16.0.9 "]


def _tree(rng, depth=0):
    kind = rng.random()
    if depth > 4 or kind < 0.5:
        return rng.choice([*VALUES, None, True, 1.50, 12345678901234567890])
    if kind < 0.75:
        return [_tree(rng, depth + 1) for _ in range(rng.randrange(4))]
    return {rng.choice([*VALUES, "a", "b"]): _tree(rng, depth + 1) for _ in range(rng.randrange(4))}


def _strings(value):
    if isinstance(value, str):
        yield value
    elif isinstance(value, (list, dict)):
        for v in value.values() if isinstance(value, dict) else value:
            yield from _strings(v)


def _shape(value):
    if isinstance(value, dict):
        return [(k, _shape(v)) for k, v in value.items()]
    return [_shape(v) for v in value] if isinstance(value, list) else "s" if isinstance(value, str) else value


def test_json_is_redacted_as_a_tree(spark):  # noqa: F811
    rng = random.Random(4)
    payloads = [json.dumps(_tree(rng), ensure_ascii=rng.random() < 0.5, indent=rng.choice([None, 2])) for _ in range(150)]
    payloads += [r'{"10.0.0.1":"k","e":"\u0062ob@x.com","n":1.50e+3}', '"bob@x.com"', "no json bob@x.com", "", None, r'{"a":"\ud800 10.0.0.1"}', "[" * 200 + '"10.0.0.1"' + "]" * 200, json.dumps({"long": "x" * 300_000 + " 10.0.0.1"})]
    rows = spark.createDataFrame([(i, p, None) for i, p in enumerate(payloads)], "id int, payload string, known map<string,string>").repartition(3)
    out = trees.redact_json(rows, ranges=[(134744072, 134744072)], domains=["own.test"])
    got = {r.id: r for r in out.collect()}
    flat = [(i, place, s) for i, p in enumerate(payloads[:150]) for place, s in enumerate(_strings(json.loads(p)))]
    # Text by text, the tree's redaction is that of texts: the same matches are replaced.
    texts = spark.createDataFrame([(i, n, s, None) for i, n, s in flat], "id int, place int, text string, known map<string,string>")
    plain = {(r.id, r.place): r.text for r in redaction.redact(texts, ranges=[(134744072, 134744072)], domains=["own.test"]).collect()}
    unnumbered = lambda t: re.sub(r"_\d+>>", "_N>>", t)
    for i, p in enumerate(payloads[:150]):
        new = json.loads(got[i].payload)
        assert _shape(new) == _shape(json.loads(p))
        assert [unnumbered(s) for s in _strings(new)] == [unnumbered(plain[i, n]) for n, _ in enumerate(_strings(json.loads(p)))]
        assert len(set(got[i].known.values())) == len(got[i].known)
    assert got[150].payload == '{"10.0.0.1":"k","e":"<<REDACTED_EMAIL_001>>","n":1.50e+3}' and got[150].known == {"bob@x.com": "<<REDACTED_EMAIL_001>>"}
    assert (got[151].payload, got[152].payload, got[153].payload, got[154].payload) == ('"<<REDACTED_EMAIL_001>>"', "no json <<REDACTED_EMAIL_001>>", "", None)
    assert got[155].payload == r'{"a":"\ud800 <<REDACTED_IP_001>>"}' and "10.0.0.1" not in got[156].payload + got[157].payload
    back = {r.id: r.payload for r in trees.restore_json(out).collect()}
    for i, p in enumerate(payloads):
        try:
            assert json.loads(back[i]) == json.loads(p)
        except (ValueError, TypeError):
            assert back[i] == p


def test_payloads_of_another_policy(spark):  # noqa: F811
    rows = [(1, '{"a":"<<REDACTED_IP_007>> 9.9.9.9"}', {"10.0.0.1": "<<REDACTED_IP_007>>"}, "p1"), (2, '{"a":"<<REDACTED_IP_001>>"}', {"a": "<<REDACTED_IP_001>>", "b": "<<REDACTED_IP_001>>"}, "p1"), (3, '{"a":"10.0.0.1"}', None, "p2")]
    again, counts = trees.redact_json_again(spark.createDataFrame(rows, "id int, payload string, known map<string,string>, version string"), "p2", ranges=[(0x09090909, 0x09090909)])
    assert [(r.id, r.payload, r.version) for r in again.collect()] == [(1, '{"a":"<<REDACTED_IP_007>> <<REDACTED_IP_008>>"}', "p2")]
    assert tuple(counts.first()) == (2, 1, True)


def test_report_tokens_number_leaves_and_come_back(spark):  # noqa: F811
    leaves = [
        ("r", "event", 1, ["<<REDACTED_IP_001>> <<REDACTED_EMAIL_001>>", "again <<REDACTED_IP_001>> <<REDACTED_IP_E1_001>>"]),
        ("r", "exemplar", 1, ["<<REDACTED_IP_001>>"]), ("r", "story", 2, [None]),
        ("r", "story", 1, ["<<REDACTED_IP_E2_001>> and <<REDACTED_IP_E1_001>>, <<REDACTED_IP_F1_001>>", "<<REDACTED_MAC_E1_009>>"]), ("s", "exemplar", 5, ["<<REDACTED_IP_001>>"]),
    ]
    out = report_tokens.report_tokens(spark.createDataFrame(leaves, "report string, kind string, place int, texts array<string>"))
    got = {(r.report, r.kind, r.place): (r.leaf, r.texts, [tuple(t) for t in r.tokens]) for r in out.collect()}
    assert got["r", "story", 1] == (1, ["<<REDACTED_IP_R1_001>> and <<REDACTED_IP_R1_002>>, [redacted]", "<<REDACTED_MAC_R1_003>>"], [("<<REDACTED_IP_R1_001>>", "<<REDACTED_IP_E2_001>>"), ("<<REDACTED_IP_R1_002>>", "<<REDACTED_IP_E1_001>>"), ("<<REDACTED_MAC_R1_003>>", "<<REDACTED_MAC_E1_009>>")])
    assert got["r", "story", 2] == (2, [None], []) and got["s", "exemplar", 5][0] == 1
    assert got["r", "event", 1][1] == ["<<REDACTED_IP_R3_001>> <<REDACTED_EMAIL_R3_002>>", "again <<REDACTED_IP_R3_001>> <<REDACTED_IP_E1_001>>"]
    assert got["r", "exemplar", 1][1] == ["<<REDACTED_IP_R4_001>>"]
    maps = [("r", "story", 1, 1, {"10.0.0.1": "<<REDACTED_IP_001>>"}), ("r", "story", 1, 2, {"10.0.0.2": "<<REDACTED_IP_001>>"}), ("r", "event", 1, None, {"10.0.0.3": "<<REDACTED_IP_001>>"}), ("s", "exemplar", 5, None, None)]
    values = report_tokens.report_values(out, spark.createDataFrame(maps, "report string, kind string, place int, member int, known map<string,string>"))
    assert {r["report"]: r["values"] for r in values.collect()} == {"r": {"<<REDACTED_IP_R1_001>>": "10.0.0.2", "<<REDACTED_IP_R1_002>>": "10.0.0.1", "<<REDACTED_IP_R3_001>>": "10.0.0.3"}}
    told = out.join(values, "report", "left").where("report = 'r'").select("kind", "place", F.transform("texts", lambda t: report_tokens.restore_report(t, F.col("values"))).alias("t"))
    assert {(r.kind, r.place): r.t[0] for r in told.collect()}["story", 1] == "10.0.0.2 and 10.0.0.1, [redacted]"
    allowed = {r.report: r.tokens for r in report_tokens.allowed_report_tokens(out).collect()}
    assert len(allowed["r"]) == 6 and allowed["s"] == ["<<REDACTED_IP_R1_001>>"]
