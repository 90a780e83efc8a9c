"""Snapshots under failures and two writers, maintained aggregates against recomputation, retention cascades, fingerprints."""

import hashlib
import random
import tempfile
from collections import Counter, defaultdict
from datetime import datetime

import pytest
from pyspark.sql import functions as F

from quarryline.operators import retention
from quarryline.sources import feeds
from quarryline.sources.snapshots import Conflict, Snapshots
from quarryline.streaming import maintained
from tests.test_catalog import spark  # noqa: F401


def _store(spark, tmp_path):  # noqa: F811
    return Snapshots(spark, str(tmp_path / "store"))


def _ids(df):
    return sorted(r.id for r in df.collect())


def test_a_killed_writer_leaves_the_old_snapshot(spark, tmp_path, monkeypatch):  # noqa: F811
    store = _store(spark, tmp_path)
    assert store.version() == 0 and store.read("t") is None
    assert store.replace({"t": spark.range(5), "other": spark.range(1)}) == 1
    # Between writing and the switch.
    with monkeypatch.context() as m:
        m.setattr(Snapshots, "_switch", lambda *_: (_ for _ in ()).throw(RuntimeError("killed")))
        with pytest.raises(RuntimeError, match="killed"):
            store.replace({"t": spark.range(100)})
    assert store.version() == 1 and _ids(store.read("t")) == [0, 1, 2, 3, 4]
    # While writing.
    bad = spark.range(10).select(F.when(F.col("id") == 7, F.raise_error(F.lit("lost"))).otherwise(F.col("id")).cast("long").alias("id"))
    with pytest.raises(Exception, match="lost"):
        store.replace({"t": bad})
    assert _ids(store.read("t")) == [0, 1, 2, 3, 4]
    # Fewer rows there than were written.
    with monkeypatch.context() as m:
        m.setattr(type(spark.range(1)), "count", lambda self: 3)
        with pytest.raises(RuntimeError, match="3 rows of 9"):
            store.replace({"t": spark.range(9)})
    assert store.replace({"t": spark.range(2)}) == 2 and _ids(store.read("t")) == [0, 1] and _ids(store.read("other")) == [0] and _ids(store.read("t", 1)) == [0, 1, 2, 3, 4]
    assert store.expire(1) >= 3 and _ids(store.read("t")) == [0, 1] and _ids(store.read("other")) == [0]


def test_two_writers(spark, tmp_path):  # noqa: F811
    a, b = _store(spark, tmp_path), _store(spark, tmp_path)
    a.replace({"t": spark.range(3)})
    base = b.version()
    a.replace_where("t", F.col("id") == 0, spark.range(10, 11))
    with pytest.raises(Conflict):
        b.replace({"t": spark.range(99)}, base)
    assert _ids(a.read("t")) == [1, 2, 10]
    # A writer that is overtaken begins again from the newer snapshot: neither change is lost.
    seen = []

    def change(tables):
        if not seen:
            seen.append(a.replace_where("t", F.col("id") == 1, spark.range(20, 21)))
        return {"t": tables["t"].where("id <> 2").unionByName(spark.range(30, 31))}

    b.update(change)
    assert _ids(a.read("t")) == [10, 20, 30]


def test_totals_follow_keys_that_move(spark, tmp_path):  # noqa: F811
    rng = random.Random(5)
    rows = [(rng.randrange(40), rng.randrange(6), rng.random() < 0.15, f"b{rng.randrange(5)}", rng.randrange(2)) for _ in range(300)] + [(None, 1, False, None, 0)]
    schema = "key int, version int, gone boolean, bucket string, customer int"
    keys, version, buckets = ["key"], ["version"], ["bucket", "customer"]
    whole = spark.createDataFrame(rows, schema)
    want = sorted(map(tuple, maintained.recomputed(whole.where("key is not null"), keys, version, buckets).collect()))
    newest = {}
    for k, v, g, b, c in rows[:-1]:
        newest[k] = max(newest.get(k, (-1,)), (v, g, b, c))
    assert want == sorted((b, c, n) for (b, c), n in Counter((b, c) for _, g, b, c in newest.values() if not g).items())
    for seed in (1, 2):
        store = Snapshots(spark, str(tmp_path / f"s{seed}"))
        order = rows[:-1] + rows[:50]
        random.Random(seed).shuffle(order)
        folder = tempfile.mkdtemp(prefix="spark-", dir="/tmp")
        for part in (order[:120], order[120:240], order[240:]):
            spark.createDataFrame(part, schema).coalesce(1).write.mode("append").parquet(folder)
        stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(folder)
        work = maintained.upsert(store, keys, version, buckets)
        stream.writeStream.foreachBatch(work).option("checkpointLocation", tempfile.mkdtemp(prefix="spark-", dir="/tmp")).trigger(availableNow=True).start().awaitTermination(300)
        assert store.version() == 3 and sorted(map(tuple, store.read("totals").collect())) == want
        work(spark.createDataFrame(rows[100:180], schema), 9)  # a replayed batch
        assert sorted(map(tuple, store.read("totals").collect())) == want


def test_retention_cascade(spark):  # noqa: F811
    day = lambda n: datetime(2024, 1, n)
    make = lambda rows, schema: spark.createDataFrame(rows, schema)
    tables = {
        "grandchild": make([(1, 10, 100), (1, 11, 101), (1, None, 102)], "customer_id int, child_id int, id int"),
        "child": make([(1, 1, 10), (1, 2, 11), (2, 3, 12)], "customer_id int, parent_id int, child_id int"),
        "parent": make([(1, 1, day(1)), (1, 2, day(20)), (2, 3, day(1)), (3, 4, day(1)), (1, 5, None)], "customer_id int, parent_id int, at timestamp"),
        "map": make([(1, 10), (1, 11), (1, 99)], "customer_id int, child_id int"), "free": make([(1, 1)], "customer_id int, x int"),
    }
    R = retention.Rule
    rules = [R("map", kept_by=(("child", ("child_id",)),)), R("grandchild", parents=(("child", ("child_id",)),)), R("child", parents=(("parent", ("parent_id",)),)), R("parent", age=("at", "days"))]
    policies = make([(1, 10), (2, None)], "customer_id int, days int")
    left, counts = retention.sweep(tables, rules, policies, "2024-01-25 00:00:00")
    ids = lambda name, column: sorted((r[column] for r in left[name].collect()), key=str)
    assert ids("parent", "parent_id") == [2, 3, 4, 5] and ids("child", "child_id") == [11, 12] and ids("grandchild", "id") == [101, 102] and ids("map", "child_id") == [11] and ids("free", "x") == [1]
    assert {(r.table_name, r.customer_id): r["rows"] for r in counts.collect()} == {("parent", 1): 1, ("child", 1): 1, ("grandchild", 1): 1, ("map", 1): 2}
    assert all(left[n].columns == tables[n].columns for n in tables)
    with pytest.raises(ValueError, match="circle"):
        retention.ordered([R("a", parents=(("b", ("x",)),)), R("b", kept_by=(("a", ("x",)),))])


def test_fingerprints(spark):  # noqa: F811
    rng = random.Random(2)
    rows = [(f"k{rng.randrange(2)}", rng.choice(["", "x", "é", None]) if i % 4 == 0 else f"r{rng.randrange(500)}") for i in range(3000)]
    take = lambda rs, parts: {r.k: (r.n, r.digest) for r in feeds.fingerprint(spark.createDataFrame(rs, "k string, t string").repartition(parts), ["k"], F.col("t")).collect()}
    first = take(rows, 1)
    assert take(rows[::-1], 64) == first

    def brute(bag):
        digests = Counter("" if t is None else hashlib.sha256(t.encode()).hexdigest() for t in bag)
        level = {d: str(n) for d, n in digests.items()}
        for length in feeds.LEVELS:
            groups = defaultdict(list)
            for p, h in level.items():
                groups[p[:length]].append(f"{p}:{h}")
            level = {q: hashlib.sha256(",".join(sorted(g)).encode()).hexdigest() for q, g in groups.items()}
        return sum(digests.values()), level[""]

    assert first == {k: brute([t for g, t in rows if g == k]) for k in ("k0", "k1")}
    # One row more of a kind that is there already, or one changed, is another bag.
    assert take([*rows, rows[5]], 4)[rows[5][0]] != first[rows[5][0]]
    assert take([(k, "other" if i == 7 else t) for i, (k, t) in enumerate(rows)], 4) != first
