"""Periodic reports on rows where the universe, readiness, coverage and the hash's references show."""

import re
from datetime import datetime

from quarryline.operators import periodic as p
from tests.test_catalog import spark  # noqa: F401

START, END, BEFORE = "2024-01-15 00:00:00", "2024-01-16 00:00:00", "2024-01-14 00:00:00"
NOON = datetime(2024, 1, 15, 12)


def _tables(spark, generation=1, reverse=False):  # noqa: F811
    incidents = [(1, "v1", 1, 5), (2, "v1", 1, 5), (3, "v1", 2, 5)]
    states = [(1, 1, "ready"), (2, 1, "dirty"), (3, 2, "ready"), (2, 2, "ready")]
    # Story 1 of customer 1 holds event 10 of sensor 7; customer 2 has an event of the same sensor and key, customer 1 one of another sensor.
    members = [(1, "v1", 10, 7), (2, "v1", 11, 7), (1, "v0", 12, 7)]
    stories = [(1, 1, "m0", False, 90, 90, ["T1"], None, "CRITICAL"), (2, 1, "m0", False, 99, 99, ["T2"], None, "CRITICAL"), (3, 1, "m0", False, 10, 10, ["T3"], "CVE-1", "LOW")]
    results = [
        (10, 1, 7, "MEDIUM"), (10, 2, 7, "MEDIUM"), (10, 1, 8, "HIGH"), (11, 1, 7, "LOW"), (12, 1, 7, "LOW"), (13, 2, 7, "LOW"),
    ]
    results = [(k, NOON, c, s, 50, 50, "m0", generation if k == 13 else 1, False, ["T9", f"T{k}"], t) for k, c, s, t in results]
    baseline = [(k, NOON, "net", k, c, s) for k, _, c, s, *_ in results]
    turn = (lambda rows: rows[::-1]) if reverse else (lambda rows: rows)
    make = lambda rows, schema: spark.createDataFrame(turn(rows), schema).repartition(3)
    t = "timestamp_ntz"
    return (
        make([(i, ver, c, s, datetime(2024, 1, 15, 1), datetime(2024, 1, 15, 2), NOON) for i, ver, c, s in incidents], f"story_id long, story_version string, customer_id long, sensor long, window_start {t}, window_end {t}, received_at {t}"),
        make(states, "story_id long, customer_id long, status string"), make(members, "story_id long, story_version string, member_key long, sensor long"),
        make(stories, "story_id long, generation int, model string, superseded boolean, severity long, likelihood long, tags array<string>, cve string, tier string"),
        make(results, f"event_key long, event_time {t}, customer_id long, sensor long, severity long, likelihood long, model string, generation int, superseded boolean, tags array<string>, tier string"),
        make(baseline, f"event_key long, event_time {t}, category string, primary_asset long, customer_id long, sensor long"),
    )


def _report(spark, scope, qualified, **more):  # noqa: F811
    scope = spark.createDataFrame(scope, "subject_id long, customer_id long")
    return p.periodic_report(scope, *_tables(spark, **more), ["m0"], BEFORE, START, END, qualified)


def test_universe_readiness_and_coverage(spark):  # noqa: F811
    scope = [(1, 1), (2, 2), (9, 1), (9, 2)]
    frame = spark.createDataFrame(scope, "subject_id long, customer_id long")
    parts = p.report_parts(frame, *_tables(spark), ["m0"], BEFORE, START, END)
    rows = lambda name, *columns: sorted(tuple(r[c] for c in columns) for r in parts[name].collect())
    assert rows("stories", "subject_id", "story_id") == [(1, 1), (2, 3), (9, 1), (9, 3)]  # 2 is dirty where it lies
    key = ("subject_id", "customer_id", "sensor", "event_key")
    assert rows("universe", *key) == [(1, 1, 7, 11), (1, 1, 7, 12), (1, 1, 8, 10), (2, 2, 7, 10), (2, 2, 7, 13), (9, 1, 7, 11), (9, 1, 7, 12), (9, 1, 8, 10), (9, 2, 7, 10), (9, 2, 7, 13)]
    assert rows("events", *key) == [(1, 1, 8, 10), (2, 2, 7, 10), (9, 1, 8, 10), (9, 2, 7, 10)]
    # The covered event is in no long tail: T10 isn't there, T9 counts the two LOW events alone.
    assert rows("exemplars", "subject_id", "technique", "n") == [(1, "T11", 1), (1, "T12", 1), (1, "T9", 2), (2, "T13", 1), (2, "T9", 1), (9, "T11", 1), (9, "T12", 1), (9, "T13", 1), (9, "T9", 3)]
    got = {r.subject_id: r for r in _report(spark, scope, False).collect()}
    assert (got[1].stories, got[1].events, got[1].tier, got[1].events_total, got[1].hosts, got[1].stories_total) == ("1", "10", "CRITICAL", 4, 3, 1)
    assert got[9].techniques == "T10:2,T9:2,T1:1,T3:1" and got[9].sensors == "1:7:3,2:7:2,1:8:1" and got[9].cve_refs == "CVE-1"


def test_hash_follows_generations_not_row_order(spark):  # noqa: F811
    scope = [(1, 1), (2, 2), (9, 1), (9, 2)]
    hashes = lambda **more: {r.subject_id: r.input_hash for r in _report(spark, scope, **{"qualified": True, **more}).collect()}
    first = hashes()
    assert hashes(reverse=True) == first
    # Event 13 is only an exemplar, of customer 2: its new generation changes nothing else, but the hashes of both its reports.
    again = hashes(generation=2)
    assert again[1] == first[1] and again[2] != first[2] and again[9] != first[9]
    assert {k for k, v in hashes(qualified=False).items() if v != first[k]} == {1, 2}


def test_a_report_reads_each_source_once(spark):  # noqa: F811
    report = _report(spark, [(1, 1)], False)
    plan = report._jdf.queryExecution().executedPlan().toString()
    assert len(re.findall(r"FileScan|Scan ExistingRDD|Range \(", plan)) <= 6
