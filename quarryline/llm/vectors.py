"""Vectors as blocks: filtering, dealing and merging shared by the two searches."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quarryline.llm.common import to_batches


def valid_vectors(table: DataFrame, zero: bool) -> DataFrame:
    """vec_id and vector (array<double>) of the rows that take part.

    Left out: null ids or vectors, null or non-finite components, empty vectors, zero vectors unless ``zero``,
    and vectors of another length than the commonest one (the longer at a tie): no product is defined with them.
    """
    v = F.col("vector")
    finite = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf")))
    rows = table.where(F.col("vec_id").isNotNull() & F.col("embedding").isNotNull())
    rows = rows.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>").alias("vector"))
    rows = rows.where((F.size(v) > 0) & finite)
    if not zero:
        rows = rows.where(F.exists(v, lambda x: x != 0))
    common = rows.groupBy(F.size(v).alias("n")).count().orderBy(F.desc("count"), F.desc("n")).first()
    return rows.where(F.size(v) == (common["n"] if common else 0))


def matrix(column: pa.Array) -> np.ndarray:
    """A list column of equal lengths as a matrix."""
    rows = len(column)
    flat = np.asarray(column.flatten(), np.float64)
    return flat.reshape(rows, -1)


def collapsed(rows: DataFrame, k: int) -> DataFrame:
    """Each different vector once, with the rows' vec_ids, ascending: its k + 1 smallest ones, each at most k times."""
    once = rows.groupBy("vector", "vec_id").agg(F.least(F.count("*"), F.lit(k)).cast("int").alias("times"))
    order = Window.partitionBy("vector").orderBy("vec_id")
    # rank <= k + 1 is cut down within each task before the shuffle, so a vector with very many copies is no hot group.
    first = once.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k + 1)
    ids = F.sort_array(F.flatten(F.collect_list(F.array_repeat("vec_id", F.col("times")))))
    return first.groupBy("vector").agg(ids.alias("ids"))


def asked(rows: DataFrame, is_query) -> DataFrame:
    """vec_id, vector and query_key of the queries: each different (vec_id, vector) once."""
    return rows.where(is_query).select("vec_id", "vector").distinct().withColumn("query_key", F.xxhash64("vector"))


def block(key, ids: np.ndarray, keys: np.ndarray, x: np.ndarray, limits: np.ndarray, schema: pa.Schema) -> pa.RecordBatch:
    """One row: a key and queries (ids, query keys, vectors, thresholds) as bytes."""
    data = (np.asarray(v, t).tobytes() for v, t in ((ids, "<i8"), (keys, "<i8"), (x, "<f8"), (limits, "<f8")))
    return to_batches({schema.names[0]: [key]} | {n: [v] for n, v in zip(schema.names[1:], data)}, schema)


def unblocked(row: dict, dims: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    return np.frombuffer(row["query_ids"], "<i8"), np.frombuffer(row["query_keys"], "<i8"), np.frombuffer(row["queries"], "<f8").reshape(-1, dims), np.frombuffer(row["thresholds"], "<f8")


def to_balls(centres: np.ndarray, radius: np.ndarray, filled: np.ndarray, size: int, schema: pa.Schema):
    """A function over batches of queries (vec_id, query_key, vector and, in a second round, threshold): blocks of about ``size`` queries for each ball that they have to visit.

    Without thresholds that is the filled ball of the best bound; with them every one whose bound, q.c + |q| r, reaches the threshold.
    """

    def work(batches):
        waiting: dict[int, list] = {}
        for batch in batches:
            if not batch.num_rows:
                continue
            ids, keys, x = np.asarray(batch.column("vec_id"), np.int64), np.asarray(batch.column("query_key"), np.int64), matrix(batch.column("vector"))
            length = np.sqrt((x**2).sum(axis=1))[:, None]
            bounds = x @ centres.T + length * radius[None, :] + 1e-6 * (1 + length * (radius + np.sqrt((centres**2).sum(axis=1)))[None, :])
            bounds = np.where(filled, bounds, -np.inf)
            if "threshold" in batch.schema.names:
                limits = np.array([-np.inf if t is None else float(t) for t in batch.column("threshold").to_pylist()])
                wanted = (bounds >= limits[:, None]) & filled
            else:
                limits, wanted = np.full(len(ids), -np.inf), np.arange(len(centres)) == bounds.argmax(axis=1)[:, None]
            for r in np.flatnonzero(wanted.any(axis=0)).tolist():
                at = np.flatnonzero(wanted[:, r])
                waiting.setdefault(r, []).append((ids[at], keys[at], x[at], limits[at]))
                if sum(len(w[0]) for w in waiting[r]) >= size:
                    yield block(r, *(np.concatenate(v) for v in zip(*waiting.pop(r))), schema)
        for r, found in waiting.items():
            yield block(r, *(np.concatenate(v) for v in zip(*found)), schema)

    return work


def distances(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    squares = (a**2).sum(axis=1)[:, None] + (b**2).sum(axis=1)[None, :] - 2 * a @ b.T
    return np.sqrt(np.maximum(squares, 0))


def best_of(rows: DataFrame, k: int, score_type: str) -> DataFrame:
    """The k highest scores of each query (ties to the smaller vec_id) of rows (query_id, query_key, vec_id, score)."""
    order = Window.partitionBy("query_id", "query_key").orderBy(F.desc("score"), "vec_id")
    ranked = rows.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
    return ranked.select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", F.col("score").cast(score_type).alias("score"), "query_key")


def top_rows(scores: np.ndarray, ids: np.ndarray, k: int) -> np.ndarray:
    """Positions of the k highest scores, ties to the smaller id."""
    if len(scores) > 4 * k:
        least = np.partition(scores, len(scores) - k)[len(scores) - k]
        at = np.flatnonzero(scores >= least)
    else:
        at = np.arange(len(scores))
    return at[np.lexsort((ids[at], -scores[at]))[:k]]
