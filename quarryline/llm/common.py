"""Helpers shared by the training-data operators: shared storage, Arrow slices, word hashes.

Everything here is small, per-task code; Spark does the partitioning and the shuffles.
"""

from __future__ import annotations

import functools
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: Texts are worked through in slices of about this many bytes, so that a task's memory stays bounded.
SLICE_BYTES = 2 << 20


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def texts(docs: DataFrame, *more) -> DataFrame:
    """doc_id and text (null: empty) of the rows that have a doc_id; extra columns are left behind."""
    return docs.where(F.col("doc_id").isNotNull()).select(
        F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text"), F.lit("")).alias("text"), *more
    )


def crc_remainder(modulus: int, column: str = "doc_id"):
    """crc32 of the id as text, modulo ``modulus``: the split into learning and held-out rows."""
    return F.pmod(F.crc32(F.col(column).cast("string").cast("binary")), F.lit(modulus))


def shared_folder(spark: SparkSession, name: str) -> str:
    """A new folder path below the cluster's shared checkpoint folder; in tests, where that is unset, below the warehouse."""
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.conf.get("spark.sql.warehouse.dir")
    return f"{base.rstrip('/')}/{name}-{uuid.uuid4().hex}"


def stored(df: DataFrame, name: str) -> DataFrame:
    """Writes df to the shared folder and reads it back: the lineage ends there and survives lost executors."""
    spark = df.sparkSession
    path = shared_folder(spark, name)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


#: Rows that may be broadcast: a table of a few columns of numbers, so about 10 MB at most.
BROADCAST_ROWS = 200_000


def small(df: DataFrame, rows: int) -> DataFrame:
    """df, to be broadcast if its number of rows, which the caller knows a bound of, allows it."""
    return F.broadcast(df) if rows <= BROADCAST_ROWS else df


def lowest_hashes(rows: DataFrame, each: int, labels: int) -> DataFrame:
    """The ``each`` smallest different h of each of ``labels`` labels of rows (label, h); h is a 64-bit hash.

    A share of the hashes that holds them for sure is cut off in each task, from each label's number of different hashes (one row a
    label), so that only about 1.5 * each rows of a label are ranked together, however many rows the label has and however many of
    them are copies.
    """
    counts = rows.groupBy("label").agg(F.approx_count_distinct("h").alias("n"))
    shares = counts.select("label", (F.lit(1.5 * each + 64) / F.col("n")).alias("share"))
    near = rows.join(small(shares, labels), "label").where(F.col("h").cast("double") / 2.0**64 + 0.5 <= F.col("share")).select("label", "h").distinct()
    rank = F.row_number().over(Window.partitionBy("label").orderBy("h"))
    return near.withColumn("rank", rank).where(F.col("rank") <= each).select("label", "h")


def free_names(df: DataFrame, n: int) -> list[str]:
    """n column names that df doesn't have, in any case of letters."""
    taken, k, found = {c.lower() for c in df.columns}, 0, []
    while len(found) < n:
        if f"_made_{k}" not in taken:
            found.append(f"_made_{k}")
        k += 1
    return found


def to_batches(rows: dict, schema: pa.Schema) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(rows[f.name], type=f.type) for f in schema], schema=schema)


def slices(batches: Iterator[pa.RecordBatch], column: str = "text", limit: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """The rows of all batches, in slices of about ``limit`` bytes of text (one row at least)."""
    for batch in batches:
        if not batch.num_rows:
            continue
        lengths = np.asarray(pa.compute.binary_length(batch.column(column)).fill_null(0), dtype=np.int64)
        group = (np.cumsum(lengths) - lengths) // limit
        cuts = [0, *(np.flatnonzero(np.diff(group)) + 1).tolist(), batch.num_rows]
        for a, b in zip(cuts[:-1], cuts[1:]):
            yield batch.slice(a, b - a)


def text_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The UTF-8 bytes of all strings of an Arrow column end to end, and the offsets of its rows (n + 1)."""
    column = column.cast(pa.large_binary()) if not pa.types.is_large_binary(column.type) else column
    column = pa.concat_arrays([column])
    offsets = np.frombuffer(column.buffers()[1], dtype=np.int64)[column.offset : column.offset + len(column) + 1]
    data = column.buffers()[2]
    raw = np.frombuffer(data, dtype=np.uint8)[offsets[0] : offsets[-1]] if data is not None else np.zeros(0, np.uint8)
    return raw, offsets - offsets[0]


_PRIME = np.uint64(0x9E3779B97F4A7C15)


@functools.cache
def _byte_values() -> np.ndarray:
    """A random 64-bit value for each byte; A-Z have those of a-z."""
    values = np.random.default_rng(20240131).integers(1, 2**63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
    values[65:91] = values[97:123]
    return values


_POWERS: list[np.ndarray] = []


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """p**i and p**-i modulo 2**64 for i below n."""
    if not _POWERS or len(_POWERS[0]) < n:
        size = max(n, SLICE_BYTES + 4096)
        inverse = pow(int(_PRIME), -1, 1 << 64)
        with np.errstate(over="ignore"):
            _POWERS[:] = [np.concatenate([np.ones(1, np.uint64), np.cumprod(np.full(size, base, np.uint64))]) for base in (_PRIME, np.uint64(inverse))]
    return _POWERS[0][:n], _POWERS[1][:n]


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective 64-bit finaliser."""
    with np.errstate(over="ignore"):
        x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        return x ^ (x >> np.uint64(31))


_SEPARATOR = np.zeros(256, bool)
_SEPARATOR[[0x20, *range(0x09, 0x0E)]] = True


def word_hashes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """64-bit hashes of the words ``[^\\x20\\x09-\\x0D]+`` (A-Z as a-z) of all rows in order, and the number of words of each row."""
    raw, offsets = text_bytes(column)
    rows = len(offsets) - 1
    if not len(raw):
        return np.zeros(0, np.uint64), np.zeros(rows, np.int64)
    word = ~_SEPARATOR[raw]
    begins = word.copy()
    begins[1:] &= ~word[:-1]
    first = offsets[:-1][np.diff(offsets) > 0]
    begins[first] = word[first]
    ends = word.copy()
    ends[:-1] &= ~word[1:]
    last = first[1:] - 1
    ends[last] = word[last]
    starts, stops = np.flatnonzero(begins), np.flatnonzero(ends) + 1
    power, inverse = _powers(len(raw))
    with np.errstate(over="ignore"):
        total = np.zeros(len(raw) + 1, np.uint64)
        np.cumsum(_byte_values()[raw] * power, out=total[1:])
        hashes = mix((total[stops] - total[starts]) * inverse[starts] + (stops - starts).astype(np.uint64))
    counts = np.searchsorted(starts, offsets[1:]) - np.searchsorted(starts, offsets[:-1])
    return hashes, counts
