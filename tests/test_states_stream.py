"""States as a stream equal those as a batch, whatever the order of the batches and whatever is replayed."""

import random
import tempfile
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from quarryline.streaming import states
from tests.test_catalog import spark  # noqa: F401

BEGIN = datetime(2024, 1, 1)


def _changes(rng, keys):
    rows = []
    for key in range(keys):
        for i in range(rng.randrange(1, 7)):
            rows.append((key % 3, key, "item", f"i{i}", BEGIN + timedelta(minutes=rng.randrange(0, 3000))))
        for kind in ("job", "gone", "back"):
            for _ in range(rng.choice([0, 0, 1, 2])):
                rows.append((key % 3, key, kind, "", BEGIN + timedelta(minutes=rng.randrange(0, 3000), seconds=7)))
    return rows


@pytest.mark.parametrize("story", [True, False])
def test_stream_equals_batch_in_any_order(spark, story):  # noqa: F811
    for k, v in states.STORE.items():
        spark.conf.set(k, v)
    rng = random.Random(8 + story)
    rows = _changes(rng, 60)
    # The clock runs on to half a day before the last change: some keys are still pending then.
    rows += [(9, 999, "item", "clock", BEGIN + timedelta(minutes=3000) + timedelta(days=29, hours=12))]
    schema = "customer_id long, key long, kind string, id string, at timestamp"
    settle = F.lit(BEGIN + timedelta(minutes=2000)).cast("timestamp")
    finish = lambda df: df if story else df.withColumn("settle", settle)
    now = F.lit(rows[-1][-1] - timedelta(days=30)).cast("timestamp")
    keys = ["customer_id", "key"]
    want = {(r.customer_id, r.key): (r.status, r.first, r["last"]) for r in states.batched(finish(spark.createDataFrame(rows, schema)), keys, story, now).collect()}
    for seed in (1, 2):
        order = rows[:-1] + random.Random(seed).sample(rows[:-1], 80)  # replayed rows
        random.Random(seed).shuffle(order)
        folder = tempfile.mkdtemp(prefix="spark-", dir="/tmp")
        for part in (order[:100], order[100:180], order[180:], rows[-1:]):
            spark.createDataFrame(part, schema).coalesce(1).write.mode("append").parquet(folder)
        stream = finish(spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(folder))
        name = f"states_{int(story)}_{seed}"
        out = []

        def keep(df, number, out=out):
            out.append({(r.customer_id, r.key): (r.status, r.first, r["last"]) for r in df.collect()})

        q = states.streamed(stream, keys, story).writeStream.queryName(name).foreachBatch(keep).outputMode("update").option("checkpointLocation", tempfile.mkdtemp(prefix="spark-", dir="/tmp")).trigger(availableNow=True).start()
        q.awaitTermination(300)
        got = {}
        for batch in out:
            got |= batch
        assert got == want
    assert {s for s, _, _ in want.values()} == {"pending", "ready", "dirty", "archived"}


def test_buckets_of_the_given_events(spark):  # noqa: F811
    """The stream of raw events, in their customers' zones, comes to the states of all of them at the watermark."""
    from quarryline.sources import views

    for k, v in states.STORE.items():
        spark.conf.set(k, v)
    zones = spark.range(5).selectExpr("id AS customer_id", "CASE WHEN id % 2 = 0 THEN 'UTC' ELSE 'Asia/Seoul' END AS zone")
    events = views.baseline(spark, "/root/testdata/sf0.001").where("customer_id < 2").withColumnRenamed("baseline_version", "version").select("customer_id", "sensor", "event_key", "version", "event_time", "received_at")
    folder = tempfile.mkdtemp(prefix="spark-", dir="/tmp")
    latest = events.agg(F.max("received_at")).first()[0]
    # The delay is longer than what the source holds, so that no row is late; a last row moves the clock on.
    tick = events.limit(1).select("customer_id", "sensor", F.lit(-1).cast("long").alias("event_key"), "version", F.lit(latest).cast("timestamp_ntz").alias("event_time"), F.lit(latest + timedelta(days=20)).cast("timestamp_ntz").alias("received_at"))
    for part in (1, 0, 2):
        events.where(F.pmod(F.hash("event_key"), F.lit(3)) == part).coalesce(1).write.mode("append").parquet(folder)
    tick.write.mode("append").parquet(folder)
    events = events.unionByName(tick)
    changes = states.bucket_changes(spark.readStream.schema(events.schema).option("maxFilesPerTrigger", 1).parquet(folder), zones)
    got = {}

    def keep(df, number):
        got.update({(r.customer_id, r.period, r.bucket): (r.status, r.first, r["last"]) for r in df.collect()})

    q = states.streamed(changes, states.BUCKET_KEYS, False, delay="40 days").writeStream.foreachBatch(keep).outputMode("update").option("checkpointLocation", tempfile.mkdtemp(prefix="spark-", dir="/tmp")).trigger(availableNow=True).start()
    q.awaitTermination(400)
    batch = states.batched(states.bucket_changes(events, zones), states.BUCKET_KEYS, False, F.lit(latest - timedelta(days=20)).cast("timestamp"))
    want = {(r.customer_id, r.period, r.bucket): (r.status, r.first, r["last"]) for r in batch.collect()}
    assert got == want and {s for s, _, _ in want.values()} == {"pending", "ready"}
