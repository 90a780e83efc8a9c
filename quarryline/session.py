"""The session that tests and benchmarks use; on a cluster the caller's own session serves."""

from __future__ import annotations

from pyspark.sql import SparkSession


def session(master: str = "local[8]", partitions: int = 16, memory: str = "12g", **more: str) -> SparkSession:
    b = SparkSession.builder.master(master).appName("quarryline")
    conf = {
        "spark.sql.session.timeZone": "UTC", "spark.sql.adaptive.enabled": "true", "spark.sql.shuffle.partitions": str(partitions),
        "spark.driver.memory": memory, "spark.ui.enabled": "false", "spark.ui.showConsoleProgress": "false",
    } | more
    return b.config(map=conf).getOrCreate()
