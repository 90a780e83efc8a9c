"""Best-fit decreasing packing of token sequences, exact over the whole corpus.

Best-fit decreasing needs nothing but the histogram of piece lengths: at most ``capacity`` counts, however
many documents there are. The driver plans on that histogram. Open bins with equal remaining capacity are held
as intervals of bin numbers in a segment tree over remaining capacities, which finds the tightest capacity
that still fits in logarithmic time. The plan is a list of runs (length, first rank, bins, bin, offset); its
size is bounded by the capacity, not by the input. Each piece then finds its place from its rank among the
pieces of its length: its number within its task plus the counts of the tasks before. No task holds a length's
pieces together, so a length that a third of all documents share is no hot group.

Defined results: null text is the empty text, which still packs its end id; rows without doc_id are left out;
repeated rows are packed each; extra columns are ignored; an empty table gives no rows.
"""

from __future__ import annotations

import base64
import functools
import zlib

import numpy as np
import public_tokenizers
import pyarrow as pa
import regex
import tiktoken
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quarryline.llm.common import documents, slices, stored, texts, to_batches
from quarryline.llm.token_tables import library, tokenizer_path

CAPACITY = 2048
#: Other letters are left to the tokenizers library, whose classes of letters may be of another version of Unicode.
_NOT_PLAIN = regex.compile("[^\x00-\u017f]")
PIECES = pa.schema([(n, pa.int64()) for n in ("doc_id", "piece", "start", "length", "ids_crc32", "part", "nth")])
PLACED = pa.schema([("doc_id", pa.int64()), ("piece", pa.int32()), *((n, pa.int64()) for n in ("start", "length", "ids_crc32", "sequence_id", "offset"))])


class CapacityTree:
    """A segment tree over remaining capacities 0..size; each leaf holds the intervals of bins with that much room."""

    def __init__(self, size: int):
        self.leaves = 1 << size.bit_length()
        self.filled = np.zeros(2 * self.leaves, np.int64)
        self.bins: list[list[tuple[int, int]]] = [[] for _ in range(self.leaves)]

    def _change(self, capacity: int, by: int) -> None:
        at = capacity + self.leaves
        while at:
            self.filled[at] += by
            at >>= 1

    def push(self, capacity: int, first: int, count: int) -> None:
        self.bins[capacity].append((first, count))
        self._change(capacity, 1)

    def pop(self, capacity: int) -> tuple[int, int]:
        self._change(capacity, -1)
        return self.bins[capacity].pop()

    def tightest(self, least: int) -> int:
        """The smallest capacity of at least ``least`` with an open bin, or -1."""
        at = least + self.leaves
        if self.filled[at]:
            return least
        while at > 1:
            if not at & 1 and self.filled[at + 1]:
                at += 1
                while at < self.leaves:
                    at = 2 * at if self.filled[2 * at] else 2 * at + 1
                return at - self.leaves
            at >>= 1
        return -1


def plan(histogram: dict[int, int], capacity: int = CAPACITY) -> np.ndarray:
    """Best-fit decreasing of all pieces: rows (length, first rank, per bin, first bin, offset), by length and rank.

    A run puts pieces ``first rank`` and on into consecutive bins, ``per bin`` in each, from ``offset``.
    A bin of room r that is the tightest for length l stays the tightest until r mod l is left, so equal bins
    are filled in one step; at most a few intervals are split for each length.
    """
    tree, runs, made = CapacityTree(capacity), [], 0
    for length in sorted(histogram, reverse=True):
        left, rank = histogram[length], 0
        while left:
            room = tree.tightest(length)
            if room < 0:
                room, first, count = capacity, made, -(-left // (capacity // length))
                made += count
            else:
                first, count = tree.pop(room)
            each = room // length
            whole = min(count, left // each)
            if whole:
                runs.append((length, rank, each, first, capacity - room))
                rank, left = rank + whole * each, left - whole * each
                if room - each * length:
                    tree.push(room - each * length, first, whole)
            if whole < count:
                if left:
                    runs.append((length, rank, each, first + whole, capacity - room))
                    tree.push(room - left * length, first + whole, 1)
                    whole, left = whole + 1, 0
                if whole < count:
                    tree.push(room, first + whole, count - whole)
    return np.array(sorted(runs), np.int64).reshape(-1, 5)


@functools.cache
def _ranks(path: str) -> tiktoken.Encoding:
    with open(path, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding("bytes", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


def encode_text(text: str, path: str, ranks: str) -> np.ndarray:
    """Ids as the tokenizers library gives them: by the same vocabulary's ranks where the text is plain."""
    if "<|" not in text and (text.isascii() or not _NOT_PLAIN.search(text)):
        return _ranks(ranks).encode_to_numpy(text, disallowed_special=())
    return np.array(library(path).encode(text, add_special_tokens=False).ids, np.uint32)


def pieces(docs: DataFrame, path: str, ranks: str, end_id: int = 0, capacity: int = CAPACITY) -> DataFrame:
    """The pieces of every document: the ids and an end id, cut from the end into pieces of ``capacity``.

    part and nth number the pieces of equal length within the task.
    """

    def work(batches):
        part, seen = TaskContext.get().partitionId(), np.zeros(capacity + 1, np.int64)
        for batch in slices(batches):
            rows = {n: [] for n in PIECES.names}
            for doc_id, text in zip(batch.column("doc_id").to_pylist(), batch.column("text").to_pylist()):
                ids = np.append(encode_text(text, path, ranks), end_id).astype("<u4")
                first = (len(ids) - 1) % capacity + 1
                for k, (a, b) in enumerate(zip([0, *range(first, len(ids), capacity)], range(first, len(ids) + 1, capacity))):
                    for n, v in zip(PIECES.names, (doc_id, k, a, b - a, zlib.crc32(ids[a:b].tobytes()), part, int(seen[b - a]))):
                        rows[n].append(v)
                    seen[b - a] += 1
            yield to_batches(rows, PIECES)

    return texts(docs).mapInArrow(work, "doc_id long, piece long, start long, length long, ids_crc32 long, part long, nth long")


def pack(cut: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """sequence_id and offset of every piece (columns as ``pieces`` gives them; stored, so that they stay as numbered)."""
    counts = cut.groupBy("length", "part").agg(F.count("*").alias("n"))
    before = Window.partitionBy("length").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    bases = counts.select("length", "part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base"))
    # At most ``capacity`` rows come to the driver.
    histogram = {r["length"]: r["n"] for r in cut.groupBy("length").agg(F.count("*").alias("n")).collect()}
    runs = plan(histogram, capacity)
    keys = (runs[:, 0] << 48) | runs[:, 1]

    def place(batches):
        for batch in batches:
            if not batch.num_rows:
                continue
            length, rank = (np.asarray(batch.column(n), np.int64) for n in ("length", "rank"))
            run = runs[np.searchsorted(keys, (length << 48) | rank, side="right") - 1]
            within = rank - run[:, 1]
            rows = {n: batch.column(n) for n in ("doc_id", "start", "length", "ids_crc32")}
            rows |= {"piece": np.asarray(batch.column("piece"), np.int32), "sequence_id": run[:, 3] + within // run[:, 2], "offset": run[:, 4] + within % run[:, 2] * length}
            yield to_batches(rows, PLACED)

    ranked = cut.join(bases, ["length", "part"]).withColumn("rank", F.col("nth") + F.col("base"))
    return ranked.mapInArrow(place, "doc_id long, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long")


def best_fit_packing(docs: DataFrame) -> DataFrame:
    path, ranks = tokenizer_path("byte_bpe_50k.json"), tokenizer_path("byte_bpe_50k.tiktoken")
    return pack(stored(pieces(docs, path, ranks), "pieces"))


def op4_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return best_fit_packing(documents(spark, sf_dir))
