"""Language identification with string kernels.

The kernel of two texts is the number of different n-grams of bytes (n = 1 to 4: the blended spectrum) that
both hold, divided by the root of the product of their own numbers. A bounded sample of labelled texts is
learned from; some of them are Nyström landmarks, and one-versus-rest kernel ridge regression is fitted in the
landmarks' space. A text's scores are linear in its presence vector over the landmarks' n-grams, so a batch is
scored by one product of its presence matrix with the n-grams' weights.

Every label is learned. Bounds of the sample (parameters): ``per_language`` different texts of each label, fewer with more than 64
labels (``in_all`` texts, but ``least`` of each label), chosen by a hash of the text, never by id. The kernel sees each whole text
that it learns from or scores: tasks send the presence of a text's n-grams, not the text, to the driver. Landmarks are dealt to the labels in turn, each label has the same weight in the regression, and the
softmax is sharpened until the mean score reaches nine tenths of the share of right answers, so that a score means the same with any
number of labels. The weights (n-gram slots x labels) are held by each task.

Defined results: a null text, or one without any letter, is ``und`` with score 0; rows without doc_id are left
out; repeated rows are scored each; rows with a null lang are scored, not learned from; extra columns are
ignored; with nothing to learn from, every text is ``und``; an empty table gives no rows.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quarryline.llm.common import crc_remainder, documents, free_names, lowest_hashes, slices, small, text_bytes

LENGTHS = (1, 2, 3, 4)
#: n-grams of each length share so many slots; a slot is one presence.
SLOTS = 1 << 15
_LETTER = regex.compile(r"\p{L}")


def gram_slots(raw: np.ndarray) -> np.ndarray:
    """The slots of the different n-grams of a text's bytes (A-Z as a-z, digits as one), ascending."""
    present = np.zeros(len(LENGTHS) * SLOTS, bool)
    raw = _FOLD[raw]
    for k, n in enumerate(LENGTHS):
        if len(raw) >= n:
            key = raw[: len(raw) - n + 1].astype(np.uint32)
            for j in range(1, n):
                key = (key << np.uint32(8)) | raw[j : len(raw) - n + 1 + j]
            present[k * SLOTS + ((key * np.uint32(2654435761)) >> np.uint32(17))] = True
    return np.flatnonzero(present)


_FOLD = np.arange(256, dtype=np.uint8)
_FOLD[65:91] = np.arange(97, 123)
_FOLD[48:58] = 48


def learning_rows(docs: DataFrame, per_language: int, in_all: int = 19200, least: int = 16) -> DataFrame:
    """label and presence (compressed bits of the n-gram slots) of at most ``per_language`` different texts of each language, from
    rows that are not held out; about ``in_all`` texts, but ``least`` of each."""
    rows = docs.where(F.col("doc_id").isNotNull() & F.col("lang").isNotNull() & F.col("text").rlike(r"\p{L}") & (crc_remainder(3) != 1))
    rows = rows.select(F.col("lang").alias("label"), F.xxhash64("text").alias("h"), "text")
    labels = rows.select("label").distinct().count()
    each = min(per_language, max(least, in_all // max(1, labels)))
    chosen = small(lowest_hashes(rows.select("label", "h"), each, labels), each * labels)

    def work(batches):
        for batch in slices(batches):
            raw, offsets = text_bytes(batch.column("text"))
            bits = [packed_slots(gram_slots(raw[a:b])) for a, b in zip(offsets[:-1], offsets[1:])]
            yield pa.RecordBatch.from_arrays([batch.column("label"), batch.column("h"), pa.array(bits, pa.binary())], ["label", "h", "presence"])

    # Copies of a chosen text have its hash and its presence, whatever their number, and are one row before the shuffle.
    return rows.join(chosen, ["label", "h"]).mapInArrow(work, "label string, h long, presence binary").groupBy("label", "h").agg(F.min("presence").alias("presence"))


def packed_slots(slots: np.ndarray) -> bytes:
    present = np.zeros(len(LENGTHS) * SLOTS, np.uint8)
    present[slots] = 1
    return zlib.compress(np.packbits(present).tobytes(), 1)


def unpacked_slots(data: bytes) -> np.ndarray:
    return np.flatnonzero(np.unpackbits(np.frombuffer(zlib.decompress(data), np.uint8)))


class Model:
    """Weights of each n-gram slot for each language, and the labels."""

    def __init__(self, langs: list[str], used: np.ndarray, weights: np.ndarray, bias: np.ndarray, sharpness: float):
        self.langs, self.used, self.weights, self.bias, self.sharpness = langs, used, weights, bias, sharpness
        self.place = np.full(len(LENGTHS) * SLOTS, -1, np.int32)
        self.place[used] = np.arange(len(used))

    def scores(self, raws: list[np.ndarray]) -> np.ndarray:
        """Ridge outputs (texts x languages): presence matrix times weights, over each text's norm."""
        presence, norm = np.zeros((len(raws), len(self.used)), np.float32), np.ones((len(raws), 1), np.float32)
        for i, raw in enumerate(raws):
            slots = gram_slots(raw)
            norm[i] = max(1, len(slots)) ** 0.5
            at = self.place[slots]
            presence[i, at[at >= 0]] = 1
        return presence @ self.weights / norm + self.bias

    def predict(self, raws: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
        out = self.scores(raws) * self.sharpness
        out = np.exp(out - out.max(axis=1, keepdims=True))
        out /= out.sum(axis=1, keepdims=True)
        best = out.argmax(axis=1)
        return best, out[np.arange(len(raws)), best].astype(np.float64)


def fit(labelled: list[tuple[str, np.ndarray]], landmarks: int = 256, ridge: float = 1e-2, sharpness: float = 6.0, each: int = 4) -> Model | None:
    """Nyström landmarks (``each`` of a label at least) and one-versus-rest kernel ridge regression on the labelled (lang, n-gram slots) sample."""
    if not labelled:
        return None
    labelled = sorted(labelled, key=lambda x: (x[0], x[1].tobytes()))
    langs = sorted({a for a, _ in labelled})
    label = np.searchsorted(np.array(langs, object), np.array([a for a, _ in labelled], object))
    grams = [g for _, g in labelled]
    shuffled = np.random.default_rng(5).permutation(len(grams))
    turn = np.zeros(len(grams), np.int64)  # a text's place among its label's shuffled ones
    by_label = shuffled[np.argsort(label[shuffled], kind="stable")]
    turn[by_label] = np.arange(len(grams)) - np.searchsorted(label[by_label], label[by_label])
    chosen = shuffled[np.argsort(turn[shuffled], kind="stable")][: max(landmarks, each * len(langs))]
    used = np.unique(np.concatenate([grams[i] for i in chosen]))

    def presence(rows, slots) -> np.ndarray:
        out = np.zeros((len(rows), len(slots)), np.float32)
        for i, g in enumerate(rows):
            part = g[np.searchsorted(g, slots[0]) : np.searchsorted(g, slots[-1], "right")]
            at = np.searchsorted(slots, part)
            out[i, at[slots[at] == part]] = 1 / max(1, len(g)) ** 0.5
        return out

    # Slots are worked through in parts, so that many landmarks need little memory.
    parts = [used[a : a + 8192] for a in range(0, len(used), 8192)]
    to_marks = np.zeros((len(grams), len(chosen)))
    for slots in parts:
        marks = presence([grams[i] for i in chosen], slots)
        for a in range(0, len(grams), 256):
            to_marks[a : a + 256] += presence(grams[a : a + 256], slots) @ marks.T
    values, vectors = np.linalg.eigh(to_marks[chosen])
    keep = values > 1e-6 * values.max()
    root = vectors[:, keep] / values[keep] ** 0.5  # the landmarks' space
    x = to_marks @ root
    bias = np.full(len(langs), 2 / len(langs) - 1)
    ridge *= min(1, 4 / len(langs))  # what tells a label from the rest is a share of the whole

    def solve(at: np.ndarray) -> np.ndarray:
        count = np.bincount(label[at], minlength=len(langs))
        weight = len(at) / max(1, (count > 0).sum()) / count[label[at]]
        y = np.where(label[at, None] == np.arange(len(langs)), 1.0, -1.0) - bias
        return np.linalg.solve((x[at] * weight[:, None]).T @ x[at] + ridge * len(at) * np.eye(x.shape[1]), (x[at] * weight[:, None]).T @ y)

    learned_from, tried = np.flatnonzero(turn % 2 == 0), np.flatnonzero(turn % 2 == 1)
    if len(tried):
        sharpness = sharpened(x[tried] @ solve(learned_from) + bias, label[tried], sharpness)
    at_marks = root @ solve(np.arange(len(grams)))
    weights = [presence([grams[i] for i in chosen], slots).T @ at_marks.astype(np.float32) for slots in parts]
    return Model(langs, used, np.concatenate(weights).astype(np.float32), bias.astype(np.float32), sharpness)


def sharpened(out: np.ndarray, label: np.ndarray, sharpness: float) -> float:
    """The first of ``sharpness``, and of steps up from it, whose mean score of texts not learned from reaches nine tenths of the share of right answers."""
    best = out.argmax(axis=1)
    right, above = (best == label).mean(), out - out.max(axis=1, keepdims=True)
    while sharpness < 1000 and (1 / np.exp(above * sharpness).sum(axis=1)).mean() < 0.9 * right:
        sharpness *= 1.1
    return sharpness


def with_language(docs: DataFrame, model: Model | None, names: tuple[str, str] = ("_lang_pred", "_lang_score"), batch_rows: int = 64) -> DataFrame:
    """docs with two more columns, which docs must not have: the language and its score."""
    shared = docs.sparkSession.sparkContext.broadcast(model)  # at most 4 * SLOTS x labels floats

    def work(batches):
        fitted = shared.value
        for batch in slices(batches):
            texts_ = batch.column("text")
            letters = [t is not None and _LETTER.search(t) is not None for t in texts_.to_pylist()]
            raw, offsets = text_bytes(texts_.fill_null(""))
            lang, score = ["und"] * len(letters), [0.0] * len(letters)
            rows = [i for i, has in enumerate(letters) if has] if fitted is not None else []
            for a in range(0, len(rows), batch_rows):
                part = rows[a : a + batch_rows]
                best, sure = fitted.predict([raw[offsets[i] : offsets[i + 1]] for i in part])
                for i, b, s in zip(part, best.tolist(), sure.tolist()):
                    lang[i], score[i] = fitted.langs[b], s
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(lang, pa.string()), pa.array(score, pa.float64())], [*batch.schema.names, *names])

    return docs.mapInArrow(work, T.StructType([*docs.schema, T.StructField(names[0], T.StringType()), T.StructField(names[1], T.DoubleType())]))


def learned(docs: DataFrame, per_language: int = 300) -> Model | None:
    return fit([(r["label"], unpacked_slots(bytes(r["presence"]))) for r in learning_rows(docs, per_language).collect()])


def language_id(docs: DataFrame) -> DataFrame:
    """doc_id, held_out, lang_pred and score of every row; learns from the labelled rows that are not held out."""
    rows = docs.where(F.col("doc_id").isNotNull()).select(F.col("doc_id").cast("long").alias("doc_id"), "text", (crc_remainder(3) == 1).alias("held_out"))
    return with_language(rows, learned(docs)).select("doc_id", "held_out", F.col("_lang_pred").alias("lang_pred"), F.col("_lang_score").alias("score"))


def keep_languages(docs: DataFrame, least: float = 0.4) -> DataFrame:
    """docs without the rows whose language can't be told: ``und``, or a score below ``least``.

    Rows without text or letters go; rows without doc_id or lang are judged by their text like any other; repeated rows are each
    kept or each dropped; all columns of docs are returned, whatever their names.
    """
    lang, score = free_names(docs, 2)
    return with_language(docs, learned(docs), (lang, score)).where((F.col(lang) != "und") & (F.col(score) >= least)).select(docs.columns)


def op2_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language_id(documents(spark, sf_dir))
