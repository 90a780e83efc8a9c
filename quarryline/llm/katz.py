"""Katz backoff language model over the whole corpus.

Each n-gram count is discounted by Good-Turing; what a history's discounts leave over goes to the words that
never followed it, in the proportion of the next lower order, so that p(. | history) sums to one over the training
words and one class for all unknown words:

    p(w | h) = d(c(hw)) c(hw) / c(h)    if hw was seen, else    alpha(h) p(w | shorter h)

The corpus never moves as rows of n-grams. Texts become slices: token streams as numbers of a local vocabulary,
stored in a table bucketed by slice. A slice sends each of its different n-grams once, by hash, to the bucket that
adds up all slices' counts, stores them as the model's table, and sends the totals back to the slices that asked.
Of a seen n-gram one slice is the owner; the owners' sums give each history's weight, which is looked up likewise.
An n-gram that a third of all rows hold is thus sent once a slice. The joins on the slice meet the bucketed
table without a shuffle of its own.

Tables in the model's folder: ``counts<n>`` and ``backoff<n>``, partitioned by bucket: ascending 64-bit hashes
and, for each, the count, or the denominator and alpha of a history. Two n-grams of one 64-bit hash would share
their count.

Words are known by 64-bit hashes too. Counts have 64 bits, weights and sums double precision.

Defined results: null text is the empty text (one end token); rows without doc_id are left out; repeated rows
are learned and scored each; extra columns are ignored; with no training rows N = V = 0 and every token is
unknown, with probability one; an empty table gives no rows.
"""

from __future__ import annotations

import uuid

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quarryline.llm.common import SLICE_BYTES, crc_remainder, documents, mix, shared_folder, slices, stored, texts, to_batches, word_hashes

#: Highest order; counts up to TRUSTED are discounted; bytes of text of a slice and, about, of a bucket.
ORDER, TRUSTED = 2, 5
SLICE, BUCKET = 12 << 20, 8 << 20
END, START, _ODD = np.uint64(0x5851F42D4C957F2D), np.uint64(0x14057B7EF767814F), np.uint64(0x9E3779B97F4A7C15)
SLICES = pa.schema([("slice", pa.int64()), *((n, pa.binary()) for n in ("doc_ids", "train", "lengths", "stream", "words"))])
SENT = pa.schema([("slice", pa.int64()), ("bucket", pa.int32()), ("keys", pa.binary()), ("numbers", pa.binary())])
TALLIED = pa.schema([("slice", pa.int64()), ("bucket", pa.int32()), ("keys", pa.binary()), ("numbers", pa.binary()), ("stats", pa.list_(pa.int64()))])
_SENT_DDL = "slice long, bucket int, keys binary, numbers binary"
SCORES = pa.schema([("doc_id", pa.int64()), ("held_out", pa.bool_()), *((n, pa.int64()) for n in ("n_tokens", "n_known", "train_tokens")), ("base_score", pa.float64()), ("score", pa.float64())])


def pack(*arrays: np.ndarray) -> bytes:
    """Arrays as byte planes, compressed: the planes that are nearly all zeros cost nearly nothing."""
    planes = b"".join(np.ascontiguousarray(x.view(np.uint8).reshape(-1, x.itemsize).T).tobytes() for x in map(np.ascontiguousarray, arrays))
    return zstandard.ZstdCompressor(level=1).compress(planes)


def unpack(data: bytes, n: int, *types) -> list[np.ndarray]:
    """The arrays of n numbers each that were packed."""
    planes, at, out = np.frombuffer(zstandard.ZstdDecompressor().decompress(data), np.uint8), 0, []
    for t in map(np.dtype, types):
        n = len(planes) // t.itemsize if n < 0 else n
        out.append(np.ascontiguousarray(planes[at : at + n * t.itemsize].reshape(t.itemsize, n).T).view(t).ravel())
        at += n * t.itemsize
    return out


def pack_keys(keys: np.ndarray) -> bytes:
    """Ascending 64-bit keys, by their differences."""
    return pack(np.diff(keys, prepend=np.uint64(0)))


def unpack_keys(data: bytes) -> np.ndarray:
    return np.cumsum(unpack(data, -1, np.uint64)[0], dtype=np.uint64)


def discounts(met: np.ndarray) -> np.ndarray:
    """Good-Turing discounts of counts 0 to TRUSTED (d[0] unused); met[r - 1]: n-grams met r times.

    Where the formula gives none between 0 and 1 for some count, all are discounted by the absolute value
    n1 / (n1 + 2 n2), or a half if that is none.
    """
    k, n = TRUSTED, np.concatenate([[0], met]).astype(float)
    d = np.ones(k + 1)
    with np.errstate(all="ignore"):
        r = np.arange(1, k + 1)
        top = (k + 1) * n[k + 1] / n[1]
        d[1:] = ((r + 1) * n[2 : k + 2] / (r * n[1 : k + 1]) - top) / (1 - top)
        if not (np.isfinite(d).all() and (d[1:] > 0).all() and (d[1:] < 1).all()):
            off = n[1] / (n[1] + 2 * n[2])
            off = off if np.isfinite(off) and 0 < off < 1 else 0.5
            d[1:] = (r - off) / r
    return d


def _slices(docs: DataFrame, modulus: int, remainder: int, name: str, buckets: int) -> DataFrame:
    """Writes and reads the bucketed table of slices."""

    def work(batches):
        part, made, held, size = TaskContext.get().partitionId(), 0, [], 0

        def flush():
            ids, train, counts, hashes = (np.concatenate(x) for x in zip(*held))
            hashes = np.insert(hashes, np.cumsum(counts), END)  # an end after each document
            words, stream, often = np.unique(hashes, return_inverse=True, return_counts=True)
            order = np.argsort(-often, kind="stable")  # common words have small numbers, which compress well
            number = np.empty(len(words), np.uint32)
            number[order] = np.arange(len(words), dtype=np.uint32)
            return to_batches({"slice": [(part << 32) | made], "doc_ids": [ids.tobytes()], "train": [train.tobytes()], "lengths": [(counts + 1).tobytes()], "stream": [pack(number[stream])], "words": [words[order].tobytes()]}, SLICES)

        for batch in slices(batches, limit=SLICE_BYTES):
            hashes, counts = word_hashes(batch.column("text"))
            held.append((np.asarray(batch.column("doc_id"), np.int64), np.asarray(batch.column("train").to_pylist(), bool), counts.astype(np.int64), hashes))
            size += batch.column("text").nbytes
            if size >= SLICE:
                yield flush()
                made, held, size = made + 1, [], 0
        if held:
            yield flush()

    rows = texts(docs, (crc_remainder(modulus) != remainder).alias("train"))
    cut = rows.mapInArrow(work, "slice long, doc_ids binary, train binary, lengths binary, stream binary, words binary")
    cut.write.option("compression", "none").bucketBy(buckets, "slice").saveAsTable(name)
    return docs.sparkSession.table(name)


class Slice:
    """One slice: its n-grams of each order as local numbers, and what the buckets answered."""

    def __init__(self, row: dict, order: int, buckets: int, answers=()):
        self.id, self.buckets = row["slice"], buckets
        self.doc_ids, self.train = np.frombuffer(row["doc_ids"], np.int64), np.frombuffer(row["train"], bool)
        self.lengths = np.frombuffer(row["lengths"], np.int64)
        stream, words = unpack(row["stream"], -1, np.uint32)[0], np.frombuffer(row["words"], np.uint64)
        self.begins = np.cumsum(self.lengths) - self.lengths
        self.answers = answers
        learned = np.repeat(self.train, self.lengths)
        # For each order: number of each position's n-gram; of each n-gram its key, training count, history and shorter n-gram.
        self.at, self.keys, self.counts = [stream], [words], [np.bincount(stream[learned], minlength=len(words))]
        self.history, self.shorter = [None], [None]
        for n in range(2, order + 1):
            before = np.empty(len(stream), np.int64)
            before[1:] = self.at[-1][:-1]
            before[self.begins] = len(self.keys[-1])  # the start of a text
            codes, first, at = np.unique((before << 32) | stream, return_index=True, return_inverse=True)
            with np.errstate(over="ignore"):
                keys = mix(self.histories(n)[codes >> 32] * _ODD + words[codes & 0xFFFFFFFF])
            self.shorter.append(self.at[-1][first])
            self.history.append(codes >> 32)
            self.keys.append(keys)
            self.at.append(at.astype(np.uint32))
            self.counts.append(np.bincount(at[learned], minlength=len(codes)))

    def histories(self, n: int) -> np.ndarray:
        """Keys of the histories of order n: all shorter n-grams, then the start of a text."""
        return np.append(self.keys[n - 2], START + np.uint64(n))

    def deal(self, keys: np.ndarray, *numbers: np.ndarray):
        """Rows (slice, bucket, keys, numbers): a bucket holds a range of keys; different keys only, ascending."""
        order = np.argsort(keys, kind="stable")
        keys, numbers = keys[order], [x[order] for x in numbers]
        for b, (i, j) in enumerate(self._edges(keys)):
            if j > i:
                yield to_batches({"slice": [self.id], "bucket": [b], "keys": [pack_keys(keys[i:j])], "numbers": [pack(*(x[i:j] for x in numbers))]}, SENT)

    def _edges(self, ascending: np.ndarray):
        shift = 64 - (self.buckets.bit_length() - 1)
        edges = np.searchsorted(ascending, np.arange(1, self.buckets, dtype=np.uint64) << np.uint64(shift))
        edges = np.concatenate([[0], edges, [len(ascending)]])
        return zip(edges[:-1].tolist(), edges[1:].tolist())

    def answer(self, kind: str, keys: np.ndarray, *types) -> list[np.ndarray]:
        """What the buckets answered of a kind, in the order of keys."""
        order = np.argsort(keys, kind="stable")
        found = {a["bucket"]: a["numbers"] for a in self.answers if a["kind"] == kind}
        out = [np.zeros(len(keys), t) for t in types]
        for b, (i, j) in enumerate(self._edges(keys[order])):
            if j > i:
                for x, got in zip(out, unpack(found[b], j - i, *types)):
                    x[order[i:j]] = got
        return out

    def probabilities(self, order: int, model: dict) -> np.ndarray:
        """p of each n-gram of the given order: the lower order first, then seen ones and backed-off ones."""
        (count,) = self.answer("counts1", self.keys[0], "<u8")
        p = np.where(count > 0, model["d"][1][np.minimum(count, TRUSTED + 1)] * count / model["denominator"], model["unknown"])
        for n in range(2, order + 1):
            count, _ = self.answer(f"counts{n}", self.keys[n - 1], "<u8", "u1")
            below, alpha = self.answer(f"backoff{n}", self.histories(n), "<u8", "<f8")
            h = self.history[n - 1]
            p = np.where(count > 0, model["d"][n][np.minimum(count, TRUSTED + 1)] * count / np.maximum(below[h], 1), alpha[h] * p[self.shorter[n - 1]])
        return p


def _sum_counts(buckets_done: pa.Table):
    """All slices' counts of a bucket: the table's row (slice -1), and for each slice the totals and whether it owns the n-gram."""
    rows = sorted(buckets_done.to_pylist(), key=lambda r: r["slice"])
    parts = [unpack_keys(r["keys"]) for r in rows]
    counts = np.concatenate([unpack(r["numbers"], len(p), "<u8")[0] for r, p in zip(rows, parts)])
    keys, inverse = np.unique(np.concatenate(parts), return_inverse=True)
    total = np.zeros(len(keys), np.int64)
    np.add.at(total, inverse, counts.astype(np.int64))
    asked = np.flatnonzero(counts > 0)[::-1]
    owner = np.full(len(keys), -1)
    owner[inverse[asked]] = asked  # the first that counted any stays
    owned = (owner[inverse] == np.arange(len(inverse))).astype("u1")
    seen = total > 0
    met = np.bincount(np.minimum(total[seen], TRUSTED + 2), minlength=TRUSTED + 3)[1 : TRUSTED + 2]
    out = [(-1, pack_keys(keys[seen]), pack(total[seen].astype("<u8")), [int(seen.sum()), int(total.sum()), *met.tolist()])]
    at = 0
    for r, part in zip(rows, parts):
        own = slice(at, at + len(part))
        at += len(part)
        out.append((r["slice"], None, pack(total[inverse[own]].astype("<u8"), owned[own]), None))
    return out


def _sum_histories(buckets_done: pa.Table):
    """Denominator and alpha of each history of a bucket, from the owners' sums of counts, discounted counts and lower-order p."""
    rows = sorted(buckets_done.to_pylist(), key=lambda r: r["slice"])
    parts = [unpack_keys(r["keys"]) for r in rows]
    split = [len(p) for p in parts]
    numbers = [unpack(r["numbers"], n, "<u8", "<f8", "<f8") for r, n in zip(rows, split)]
    keys, inverse = np.unique(np.concatenate(parts), return_inverse=True)
    count, discounted, lower = (np.bincount(inverse, np.concatenate(x)) for x in zip(*numbers))
    whole = count - discounted <= 1e-9 * np.maximum(count, 1)  # nothing left over: one count is set apart
    below = np.where(whole, count + 1, count)
    with np.errstate(all="ignore"):
        alpha = np.where(count > 0, (below - discounted) / below / np.maximum(1 - lower, 1e-12), 1.0)
    below = np.where(count > 0, below, 1)
    out = [(-1, pack_keys(keys), pack(below.astype("<u8"), alpha.astype("<f8")), None)]
    at = 0
    for r, n in zip(rows, split):
        own = inverse[at : at + n]
        at += n
        out.append((r["slice"], None, pack(below[own].astype("<u8"), alpha[own].astype("<f8")), None))
    return out


def _tally(sent: DataFrame, add, path: str) -> DataFrame:
    """Adds up each bucket, stores the table and the answers below path, and returns them."""

    def work(table: pa.Table) -> pa.Table:
        bucket = table.column("bucket")[0].as_py()
        return pa.Table.from_batches([to_batches({"slice": [s], "bucket": [bucket], "keys": [k], "numbers": [x], "stats": [stats]}, TALLIED) for s, k, x, stats in add(table)])

    done = sent.groupBy("bucket").applyInArrow(work, f"{_SENT_DDL}, stats array<long>")
    done.withColumn("model", F.col("slice") == -1).write.option("compression", "none").partitionBy("model").parquet(path)
    return sent.sparkSession.read.schema(f"{_SENT_DDL}, stats array<long>, model boolean").parquet(path)


def train_and_score(docs: DataFrame, modulus: int, remainder: int, order: int = ORDER, folder: str | None = None) -> DataFrame:
    """Learns from documents whose crc32(doc_id) modulo ``modulus`` isn't ``remainder`` and scores all of them.

    folder gets the model's tables; by default a new one in the shared folder.
    """
    spark = docs.sparkSession
    folder = folder or shared_folder(spark, "katz")
    size = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    buckets = 1 << max(4, (size // BUCKET).bit_length())
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), size // SLICE + 1)
    name = f"katz_{uuid.uuid4().hex}"
    try:
        return _trained(_slices(docs, modulus, remainder, name, parts), order, folder, buckets, parts)
    finally:
        # The scores are stored, so that the slices can go; the model's tables stay.
        spark.sql(f"DROP TABLE IF EXISTS {name}")


def _trained(cut: DataFrame, order: int, folder: str, buckets: int, parts: int) -> DataFrame:
    """The scores of all documents of a table of slices; writes the model's tables to folder."""
    answers: list[DataFrame] = []
    model: dict = {"d": {}}

    def over_slices(function, schema: str) -> DataFrame:
        """function(row, answers) for each slice with all answers so far."""
        joined = cut
        if answers:
            every = answers[0]
            for more in answers[1:]:
                every = every.unionByName(more)
            # Dealt as the table of slices is, so that the join needs no second exchange.
            gathered = every.repartition(parts, "slice").groupBy("slice").agg(F.collect_list(F.struct("kind", "bucket", "numbers")).alias("answers"))
            joined = cut.join(gathered, "slice", "left")

        def work(batches):
            for batch in batches:
                for i in range(batch.num_rows):
                    row = batch.slice(i, 1).to_pylist()[0]
                    yield from function(row, row.get("answers") or ())

        return joined.mapInArrow(work, schema)

    def keep(done: DataFrame, kind: str) -> None:
        answers.append(done.where("not model").select("slice", "bucket", "numbers", F.lit(kind).alias("kind")))

    for n in range(1, order + 1):
        def ask(row, found, n=n):
            s = Slice(row, n, buckets, found)
            yield from s.deal(s.keys[n - 1], s.counts[n - 1].astype("<u8"))

        # Counting needs no answers, so the slices are read alone.
        held, answers[:] = list(answers), []
        sent = over_slices(ask, _SENT_DDL)
        answers[:] = held
        done = _tally(sent, _sum_counts, f"{folder}/counts{n}")
        stats = done.where("model").select(F.expr("posexplode(stats) as (k, v)")).groupBy("k").agg(F.sum("v").alias("v")).collect()
        stats = {r["k"]: r["v"] for r in stats}
        met = np.array([stats.get(k, 0) for k in range(2, TRUSTED + 3)])
        model["d"][n] = np.append(discounts(met), 1.0)
        keep(done, f"counts{n}")
        if n == 1:
            model["V"], model["N"] = stats.get(0, 0), stats.get(1, 0)
            left = sum(r * met[r - 1] * (1 - model["d"][1][r]) for r in range(1, TRUSTED + 1))
            model["denominator"] = model["N"] if left > 1e-9 else model["N"] + 1
            model["unknown"] = left / model["N"] if left > 1e-9 else 1 / (model["N"] + 1)
            continue

        def weigh(row, found, n=n):
            s = Slice(row, n, buckets, found)
            lower = s.probabilities(n - 1, model)[s.shorter[n - 1]]
            count, own = s.answer(f"counts{n}", s.keys[n - 1], "<u8", "u1")
            count = count * (own > 0)
            size, h = len(s.histories(n)), s.history[n - 1]
            sums = (np.bincount(h, w, minlength=size) for w in (count, count * model["d"][n][np.minimum(count, TRUSTED + 1)], lower * (count > 0)))
            yield from s.deal(s.histories(n), *(x.astype(t) for x, t in zip(sums, ("<u8", "<f8", "<f8"))))

        keep(_tally(over_slices(weigh, _SENT_DDL), _sum_histories, f"{folder}/backoff{n}"), f"backoff{n}")

    def score(row, found):
        s = Slice(row, order, buckets, found)
        (count,) = s.answer("counts1", s.keys[0], "<u8")
        stream = s.at[0]
        add = lambda x: np.add.reduceat(x, s.begins)
        base = np.log10((count + 1.0) / (model["N"] + model["V"] + 1))
        logs = np.log10(np.maximum(s.probabilities(order, model), 1e-300))
        yield to_batches({
            "doc_id": s.doc_ids, "held_out": ~s.train, "n_tokens": s.lengths, "n_known": add((count > 0).astype(np.int64)[stream]),
            "train_tokens": np.full(len(s.doc_ids), model["N"]), "base_score": add(base[stream]), "score": add(logs[s.at[order - 1]]),
        }, SCORES)

    return stored(over_slices(score, "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double"), "scores")


def op1_katz_backoff(spark: SparkSession, sf_dir: str) -> DataFrame:
    return train_and_score(documents(spark, sf_dir), 7, 2)
