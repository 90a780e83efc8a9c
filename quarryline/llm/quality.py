"""Quality classification by compression.

Two zstandard dictionaries hold labelled good and bad text. All blocks of a text are compressed against each
(blocks, so that a long text is not judged against its own earlier parts); the difference of the two sizes over
their sum becomes a probability by logistic calibration on labelled texts that are in neither dictionary,
weighted to the labels' true shares.

Bounds of the sample (parameters): ``per_label`` different texts of each label, chosen by a hash of the text. In the order of their
hashes, every other one of a label (the first among them) fills its dictionary with pieces from hashed places all over the texts; the whole texts of the
others are compressed, by tasks, for the calibration. Scores always compress the whole text.

Defined results: a null or empty text has the score that a difference of 0 gets; rows without doc_id are left
out; repeated rows are scored each; documents without a label, or with a null one, are scored, not learned
from; repeated labels of a document count once for each value; extra columns are ignored; with fewer than two different texts of
either label to learn from, all scores are 0.5, as one text can't both fill a dictionary and calibrate; an empty table gives no rows.
"""

from __future__ import annotations

import functools
import hashlib

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quarryline.llm.common import crc_remainder, documents, free_names, lowest_hashes, slices, small, stored, texts

LEVEL = 9
#: Bytes added to the sum, so that very short texts give no extreme differences.
STEADY = 64
#: Bytes of a text that are compressed at once.
BLOCK = 2048
#: Bytes of a piece of a text in a dictionary.
PIECE = 1024


@functools.lru_cache(4)
def _compressors(good: bytes, bad: bytes) -> list[zstandard.ZstdCompressor]:
    made = []
    for data in (good, bad):
        dictionary = zstandard.ZstdCompressionDict(data, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
        dictionary.precompute_compress(level=LEVEL)
        made.append(zstandard.ZstdCompressor(dict_data=dictionary, write_content_size=False, write_checksum=False))
    return made


def difference(text: str, good: bytes, bad: bytes) -> float:
    """(size by the bad dictionary - size by the good one) / their sum; 0 for the empty text."""
    raw = text.encode()
    if not raw:
        return 0.0
    a, b = (sum(len(c.compress(raw[i : i + BLOCK])) for i in range(0, len(raw), BLOCK)) for c in _compressors(good, bad))
    return (b - a) / (a + b + STEADY)


class Model:
    def __init__(self, good: bytes, bad: bytes, slope: float, shift: float):
        self.good, self.bad, self.slope, self.shift = good, bad, slope, shift

    def score(self, text: str) -> float:
        if not self.good or not self.bad:
            return 0.5
        z = self.slope * difference(text, self.good, self.bad) + self.shift
        return float(1 / (1 + np.exp(-np.clip(z, -40, 40))))


def learning_rows(docs: DataFrame, labels: DataFrame, per_label: int) -> DataFrame:
    """quality, h and text of at most ``per_label`` different texts of each label, from rows that are not held out.

    Ids and hashes are chosen first; only the chosen texts are fetched.
    """
    kept = labels.where(F.col("doc_id").isNotNull() & F.col("quality").isin(0, 1)).select(F.col("doc_id").cast("long").alias("doc_id"), F.col("quality").cast("int").alias("label")).distinct()
    rows = texts(docs).where((F.length("text") > 0) & (crc_remainder(3) != 1)).select("doc_id", F.xxhash64("text").alias("h"), "text")
    known = stored(rows.select("doc_id", "h").join(kept, "doc_id").select("label", "h", "doc_id"), "labelled")
    chosen = lowest_hashes(known.select("label", "h"), per_label, 2)
    # One row for each chosen text, of however many copies; at most 2 * per_label rows.
    first = known.join(small(chosen, 2 * per_label), ["label", "h"]).groupBy("label", "h").agg(F.min("doc_id").alias("doc_id"))
    return rows.join(small(first, 2 * per_label), ["doc_id", "h"]).select(F.col("label").alias("quality"), "h", "text").dropDuplicates(["quality", "h"])


def pieces(raw: bytes, wanted: int) -> bytes:
    """About ``wanted`` bytes of a text: pieces of PIECE bytes at hashed places of the whole of it, in their order."""
    places = -(-len(raw) // PIECE)
    count = max(1, wanted // PIECE)
    if places <= count:
        return raw
    order = sorted(range(places), key=lambda i: hashlib.blake2b(b"%d/%d" % (i, len(raw)), digest_size=8).digest())
    return b"".join(raw[i * PIECE : (i + 1) * PIECE] for i in sorted(order[:count]))


def fit(sample: DataFrame, good_share: float = 0.5, dictionary_bytes: int = 1 << 19) -> Model:
    """Every other text of a label of the sample (quality, h, text), by its hashes, fills the dictionaries; the rest calibrate.

    The driver gets ``dictionary_bytes`` of pieces of each label and a number for each calibrating text.
    """
    sample = stored(sample, "sample")
    turn = F.row_number().over(Window.partitionBy("quality").orderBy("h"))
    # As many short rows as the sample has texts.
    sample = sample.join(F.broadcast(sample.select("quality", "h", (turn % 2 == 1).alias("fills"))), ["quality", "h"])
    counts = {r["quality"]: (r["n"], r["bytes"]) for r in sample.groupBy("quality").agg(F.count_if("fills").alias("n"), F.sum(F.when(F.col("fills"), F.octet_length("text"))).alias("bytes"), F.count("*").alias("all")).where("all > 1").collect()}
    if set(counts) != {0, 1}:
        return Model(b"", b"", 1.0, 0.0)
    size = min(dictionary_bytes, min(b for _, b in counts.values()))  # alike for both labels
    each = {q: max(PIECE, size // n) for q, (n, _) in counts.items()}

    def cut(batches):
        for batch in slices(batches):
            found = [pieces(t.encode(), each[q]) for q, t in zip(batch.column("quality").to_pylist(), batch.column("text").to_pylist())]
            yield pa.RecordBatch.from_arrays([batch.column("quality"), batch.column("h"), pa.array(found, pa.binary())], ["quality", "h", "piece"])

    parts: dict[int, list] = {0: [], 1: []}
    for r in sample.where("fills").select("quality", "h", "text").mapInArrow(cut, "quality int, h long, piece binary").collect():
        parts[r["quality"]].append((r["h"], bytes(r["piece"])))
    good, bad = (b"\n".join(p for _, p in sorted(parts[q]))[:size] for q in (1, 0))

    def measure(batches):
        for batch in slices(batches):
            found = [difference(t, good, bad) for t in batch.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("quality"), pa.array(found, pa.float64())], ["quality", "x"])

    rows = sorted((r["x"], r["quality"]) for r in sample.where("not fills").select("quality", "text").mapInArrow(measure, "quality int, x double").collect())
    slope, shift = calibrate(np.array([x for x, _ in rows]), np.array([q for _, q in rows], float), good_share)
    return Model(good, bad, slope, shift)


def calibrate(x: np.ndarray, y: np.ndarray, share: float = 0.5, ridge: float = 1e-4) -> tuple[float, float]:
    """Logistic regression of y on x by Newton's method; label 1 has ``share`` of the weight."""
    scale = max(1e-9, float(np.abs(x).mean()))
    z = np.stack([x / scale, np.ones(len(x))], axis=1)
    weight = np.where(y == 1, share / max(1, (y == 1).sum()), (1 - share) / max(1, (y == 0).sum()))
    w = np.zeros(2)
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(z @ w, -40, 40)))
        step = np.linalg.solve((z * (weight * p * (1 - p) + 1e-9)[:, None]).T @ z + ridge * np.eye(2), z.T @ (weight * (p - y)) + ridge * w)
        w -= np.clip(step, -5, 5)
    return float(w[0] / scale), float(w[1])


def with_quality(docs: DataFrame, model: Model, name: str = "_quality") -> DataFrame:
    """docs with the score in one more column, which docs must not have."""
    shared = docs.sparkSession.sparkContext.broadcast(model)  # two dictionaries of bounded size

    def work(batches):
        fitted = shared.value
        for batch in slices(batches):
            found = [fitted.score(t or "") for t in batch.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(found, pa.float64())], [*batch.schema.names, name])

    return docs.mapInArrow(work, T.StructType([*docs.schema, T.StructField(name, T.DoubleType())]))


def learned(docs: DataFrame, labels: DataFrame, per_label: int = 2000) -> Model:
    share = labels.where(F.col("quality").isin(0, 1) & (crc_remainder(3) != 1)).agg(F.avg("quality")).first()[0]
    return fit(learning_rows(docs, labels, per_label), min(0.99, max(0.01, share)) if share is not None else 0.5)


def quality(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, held_out, score and predicted of every row; learns from the labelled rows that are not held out."""
    rows = with_quality(texts(docs, (crc_remainder(3) == 1).alias("held_out")), learned(docs, labels))
    score = F.col("_quality")
    return rows.select("doc_id", "held_out", score.alias("score"), F.when(score >= 0.5, 1).otherwise(0).cast("int").alias("predicted"))


def keep_good(docs: DataFrame, labels: DataFrame, least: float = 0.5) -> DataFrame:
    """docs without the rows whose score is below ``least``.

    A null text is judged as the empty one; rows without doc_id or label are judged by their text like any other; repeated rows are
    each kept or each dropped; all columns of docs are returned, whatever their names.
    """
    (name,) = free_names(docs, 1)
    return with_quality(docs, learned(docs, labels), name).where(F.col(name) >= least).select(docs.columns)


def op3_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality(documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/labels.parquet"))
