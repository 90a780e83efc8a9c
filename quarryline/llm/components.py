"""Connected components of a link table by alternating large-star and small-star steps."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarryline.llm.common import stored


def _edges(df: DataFrame) -> DataFrame:
    """Different edges (a > b)."""
    return df.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()


def components(links: DataFrame) -> DataFrame:
    """id and root (the smallest id that links reach) of every id in links (a, b); ids without a link are absent.

    Each step replaces edges by edges to a smaller neighbour, and is written to the shared folder, which ends its
    lineage. Neighbours are never gathered: a step is a minimum and a join, which Spark may split where one id
    has many edges. The number of steps grows with the logarithm of the longest chain.
    """
    edges = stored(_edges(links), "edges")
    seen = None
    while True:
        # large star: larger neighbours of u move to the smallest of u and its neighbours
        both = edges.select(F.col("a").alias("u"), F.col("b").alias("v")).unionByName(edges.select(F.col("b").alias("u"), F.col("a").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = _edges(both.where("v > u").join(least, "u").select(F.col("v").alias("a"), F.col("m").alias("b")))
        # small star: smaller neighbours of u, and u, move to the smallest of them
        least = large.groupBy("a").agg(F.min("b").alias("m"))
        edges = stored(_edges(large.join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).unionByName(least.select("a", F.col("m").alias("b")))), "edges")
        now = edges.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if now == seen:
            break
        seen = now
    roots = edges.select(F.col("b").alias("id"), F.col("b").alias("root")).distinct()
    return edges.select(F.col("a").alias("id"), F.col("b").alias("root")).unionByName(roots)
