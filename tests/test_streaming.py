"""The streaming roll-up equals the batch one; a late batch makes a processed bucket dirty."""

import tempfile

from pyspark.sql import functions as F

from quarryline.sources import views
from quarryline.streaming import activity
from tests.test_catalog import SF, spark  # noqa: F401


def test_stream_equals_batch(spark):  # noqa: F811
    batch = views.baseline(spark, SF).where("event_time is not null")
    folder = tempfile.mkdtemp(prefix="spark-", dir="/tmp")
    batch.repartition(3).write.mode("overwrite").parquet(folder)
    stream = spark.readStream.schema(batch.schema).option("maxFilesPerTrigger", 1).parquet(folder)
    q = activity.daily_activity(stream).writeStream.format("memory").queryName("daily").outputMode("complete").trigger(availableNow=True).start()
    q.awaitTermination(120)
    want = activity.daily_activity(batch)
    assert sorted(map(tuple, spark.table("daily").collect())) == sorted(map(tuple, want.collect()))


def test_late_batch_is_dirty(spark):  # noqa: F811
    b = activity.daily_activity(views.baseline(spark, SF))
    state, delta = b.where("customer_id <> 1"), b.where("customer_id = 2")
    processed = state.where("bucket < date'2024-01-10'")
    out = activity.merged(state, delta, processed)
    assert out.where("dirty").select("customer_id").distinct().collect()[0][0] == 2
    assert out.where("dirty").count() == processed.where("customer_id = 2").count()
    assert out.agg(F.sum("n")).first()[0] == state.agg(F.sum("n")).first()[0] + delta.agg(F.sum("n")).first()[0]


def _streamed(spark, batch, work, name):  # noqa: F811
    folder = tempfile.mkdtemp(prefix="spark-", dir="/tmp")
    batch.repartition(3).write.mode("overwrite").parquet(folder)
    stream = spark.readStream.schema(batch.schema).option("maxFilesPerTrigger", 1).parquet(folder)
    work(stream).writeStream.format("memory").queryName(name).outputMode("complete").trigger(availableNow=True).start().awaitTermination(120)
    return sorted(map(tuple, spark.table(name).collect()), key=str)


def test_spans_and_cursors_in_any_order_of_batches(spark):  # noqa: F811
    members = views.member(spark, SF).where("story_id < 2000")
    assert _streamed(spark, members, activity.story_spans, "spans") == sorted(map(tuple, activity.story_spans(members).collect()), key=str)
    rows = [("a", 5, "soft"), ("a", 5, "strict"), ("a", 4, "soft"), ("b", 1, "soft"), ("b", None, "strict")]
    marks = spark.createDataFrame(rows, "subject string, at int, quality string")
    assert _streamed(spark, marks, activity.cursor_watermarks, "cursors") == [("a", 5, "strict"), ("b", 1, "soft")]


def test_a_replayed_batch_adds_nothing(spark):  # noqa: F811
    rows = views.baseline(spark, SF).where("event_time is not null and baseline_version = 'v1'").limit(500).cache()
    folder = tempfile.mkdtemp(prefix="spark-", dir="/tmp")
    rows.write.mode("append").parquet(folder)
    rows.write.mode("append").parquet(folder)
    stream = spark.readStream.schema(rows.schema).option("maxFilesPerTrigger", 1).parquet(folder)
    first = activity.first_arrivals(stream.withColumn("event_time", F.col("event_time").cast("timestamp")), ["event_key"], "event_time", "60 days")
    first.writeStream.format("memory").queryName("arrivals").outputMode("append").trigger(availableNow=True).start().awaitTermination(120)
    assert sorted(r.event_key for r in spark.table("arrivals").collect()) == sorted(r.event_key for r in rows.collect())
