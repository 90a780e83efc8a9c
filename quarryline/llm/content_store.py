"""A content-addressed store of token-id streams.

A rolling hash over a window of ids cuts each document's stream into chunks (the same passage gives the same
chunks wherever it stands), each distinct chunk is stored once under its digest, and a document is a recipe: the
digests in order. Recipes are numbered and written in ascending doc_id order.

The manifest is a Merkle tree over the recipes: a leaf is the SHA-256 of a document's number, doc_id, start, number of tokens,
digests and chunk sizes; an inner node that of its up to FAN children's hashes, in order, with the documents and tokens below it; the root
stands in the store's head. All inner nodes are kept. A reader computes leaves and nodes afresh, level by level, and refuses a store in
which one differs. Every level is a grouping of at most FAN rows each.

Encoded slices are stored in a table bucketed by slice until the store is written. Only digests are shuffled: each gets one slice as
its owner, and the owners write their chunks. Likewise ``digests_read`` puts a document's crc32 together from the crc32s of its
chunks, each read back, verified and summed once, without rebuilding the document; ``read_store`` rebuilds the ids themselves.

Layout of a store's folder: ``chunks`` (digest, ids: little-endian unsigned integers of ``width`` bytes), ``recipes``
(part, number, doc_id, start, n_tokens, digests, ids behind each chunk; part numbers ascend with doc_id), ``manifest`` (level, number,
documents, tokens, hash), ``head`` (width, levels, documents, tokens, root).

Defined results: null text is the empty text, which still has its end id; rows without doc_id are left out;
rows that repeat a doc_id are kept each, ordered by digests; extra columns are ignored; an empty table
gives no rows.
"""

from __future__ import annotations

import functools
import hashlib
import uuid
import zlib

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quarryline.llm.common import documents, mix, shared_folder, slices, small, stored, texts, to_batches
from quarryline.llm.token_tables import tokenizer_path, vocabulary

WINDOW = 8
#: A cut where the rolling hash's low bits are zero: chunks of about 256 ids, of 32 at least and 2048 at most.
CUT_MASK, LEAST, MOST = np.uint64(255), 32, 2048
DIGEST_BYTES = 16
#: Documents for each bucket of the table of slices, at the most: counting them needs no text.
BUCKET = 16384
#: Children of an inner node of the Merkle tree.
FAN = 256
SLICES = pa.schema([("slice", pa.int64()), ("doc_ids", pa.list_(pa.int64())), ("counts", pa.list_(pa.int32())), ("digests", pa.list_(pa.binary())), ("sizes", pa.list_(pa.int32())), ("new", pa.list_(pa.binary())), ("ids", pa.list_(pa.binary()))])
_SLICES_DDL = "slice long, doc_ids array<long>, counts array<int>, digests array<binary>, sizes array<int>, new array<binary>, ids array<binary>"
CHUNKS = pa.schema([("digest", pa.binary()), ("ids", pa.binary())])
RECIPES = pa.schema([("doc_id", pa.int64()), ("n_tokens", pa.int64()), ("digests", pa.list_(pa.binary())), ("behind", pa.list_(pa.int64()))])
REBUILT = pa.schema([("doc_id", pa.int64()), ("start", pa.int64()), ("n_tokens", pa.int64()), ("ids", pa.binary())])


def cuts(stream: np.ndarray, sizes: np.ndarray) -> list[list[int]]:
    """Ends of the chunks of each document of a stream (ids of all documents, end to end): where the hash of the last WINDOW ids asks for
    one, within LEAST and MOST ids of the chunk's start.

    The whole stream is hashed at once: a window that reaches into the document before ends within LEAST ids of a start, where no chunk ends.
    """
    n = len(stream)
    with np.errstate(over="ignore"):
        hashed, rolling = mix(stream.astype(np.uint64) + np.uint64(1)), np.zeros(n, np.uint64)
        for k in range(min(WINDOW, n)):
            rolling[k:] += hashed[: n - k] * np.uint64(pow(0x9E3779B97F4A7C15, k, 1 << 64))
    wanted = np.flatnonzero((mix(rolling) & CUT_MASK) == 0) + 1
    stops = np.cumsum(sizes)
    of = np.searchsorted(wanted, stops).tolist()
    wanted, at, i, found = wanted.tolist(), 0, 0, []
    for stop, j in zip(stops.tolist(), of):
        ends = []
        for end in [*wanted[i:j], stop]:
            while end - at > MOST:
                at += MOST
                ends.append(at)
            if end - at >= LEAST or end == stop:
                ends.append(end)
                at = end
        found.append(ends)
        i = j
    return found


def digest(data: bytes) -> bytes:
    return hashlib.blake2b(data, digest_size=DIGEST_BYTES).digest()


def encoded_slices(docs: DataFrame, path: str, end_id: int = 1) -> DataFrame:
    """A row for each slice of texts: its documents, their chunks' digests and sizes, and the data of each digest once."""

    def work(batches):
        words = vocabulary(path)
        kind = "<u2" if max(words.strings) < 1 << 16 else "<u4"
        part = TaskContext.get().partitionId() << 32
        for number, batch in enumerate(slices(batches)):
            flat, counts = words.encode(batch.column("text").to_pylist())
            # Each document's ids and its end id, end to end.
            stream = np.insert(flat, np.cumsum(counts), end_id).astype(kind)
            kept, width = stream.tobytes(), stream.itemsize
            row, data, at = {n: [] for n in SLICES.names[1:5]}, {}, 0
            for doc_id, ends in zip(batch.column("doc_id").to_pylist(), cuts(stream, counts + 1)):
                row["doc_ids"].append(doc_id)
                row["counts"].append(len(ends))
                for end in ends:
                    chunk = kept[at * width : end * width]
                    row["digests"].append(digest(chunk))
                    row["sizes"].append(end - at)
                    data.setdefault(row["digests"][-1], chunk)
                    at = end
            yield to_batches({"slice": [part | number], "new": [list(data)], "ids": [list(data.values())]} | {n: [v] for n, v in row.items()}, SLICES)

    return texts(docs).mapInArrow(work, _SLICES_DDL)


def _recipes(batches):
    for batch in batches:
        for row in batch.to_pylist():
            rows, at = {n: [] for n in RECIPES.names}, 0
            for doc_id, n in zip(row["doc_ids"], row["counts"]):
                sizes = row["sizes"][at : at + n]
                total = sum(sizes)
                for name, v in zip(RECIPES.names, (doc_id, total, row["digests"][at : at + n], (total - np.cumsum(sizes)).tolist())):
                    rows[name].append(v)
                at += n
            yield to_batches(rows, RECIPES)


def _owned(batches):
    for batch in batches:
        for row in batch.to_pylist():
            mine = set(row["owned"])
            found = [(k, v) for k, v in zip(row["new"], row["ids"]) if k in mine]
            yield to_batches({"digest": [k for k, _ in found], "ids": [v for _, v in found]}, CHUNKS)


def write_store(docs: DataFrame, path: str, folder: str, end_id: int = 1) -> None:
    """Encodes docs and writes the store: chunks once each, recipes in ascending doc_id order, the manifest."""
    spark = docs.sparkSession
    name, buckets = f"slices_{uuid.uuid4().hex}", max(int(spark.conf.get("spark.sql.shuffle.partitions")), docs.count() // BUCKET + 1)
    try:
        encoded_slices(docs, path, end_id).write.option("compression", "zstd").bucketBy(buckets, "slice").saveAsTable(name)
        _write_store(spark.table(name), path, folder, buckets)
    finally:
        spark.sql(f"DROP TABLE IF EXISTS {name}")


def _write_store(cut: DataFrame, path: str, folder: str, buckets: int) -> None:
    """Writes the store from the table of slices, which has ``buckets`` buckets."""
    spark = cut.sparkSession
    owners = cut.select("slice", F.explode("new").alias("digest")).groupBy("digest").agg(F.min("slice").alias("slice"))
    # Dealt as the table is, so that its data needs no shuffle.
    owned = owners.repartition(buckets, "slice").groupBy("slice").agg(F.collect_list("digest").alias("owned"))
    cut.select("slice", "new", "ids").join(owned, "slice").mapInArrow(_owned, "digest binary, ids binary").write.option("compression", "zstd").parquet(f"{folder}/chunks")

    recipes = cut.select("doc_ids", "counts", "digests", "sizes").mapInArrow(_recipes, "doc_id long, n_tokens long, digests array<binary>, behind array<long>")
    ordered = recipes.repartitionByRange("doc_id").sortWithinPartitions("doc_id", "digests")
    # The parts are stored before they are summed up, so that a part keeps its documents if it is made again.
    parts = stored(ordered.withColumn("part", F.spark_partition_id()), "recipes")
    totals = stored(parts.groupBy("part").agg(F.sum("n_tokens").alias("tokens"), F.count("*").alias("documents")), "totals")
    # One row for each part: as many as tasks wrote recipes.
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    bases = totals.select("part", *(F.coalesce(F.sum(c).over(before), F.lit(0)).alias(b) for c, b in (("tokens", "base"), ("documents", "behind_all"))))
    within = Window.partitionBy("part").orderBy("doc_id", "digests", "nth")
    placed = (
        parts.withColumn("nth", F.monotonically_increasing_id())
        .join(small(bases, totals.count()), "part")
        .withColumn("start", F.col("base") + F.coalesce(F.sum("n_tokens").over(within.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
        .withColumn("number", F.col("behind_all") + F.row_number().over(within) - 1)
    )
    placed.select("part", "number", "doc_id", "start", "n_tokens", "digests", "behind").sortWithinPartitions("part", "start").write.parquet(f"{folder}/recipes")

    level, below = 0, _leaves(spark.read.parquet(f"{folder}/recipes"))
    while level == 0 or below.count() > 1:
        level += 1
        _parents(below, level).write.parquet(f"{folder}/manifest/level={level}")
        below = _level(spark, folder, level)
    top = below.first()
    width = 2 if max(vocabulary(path).strings) < 1 << 16 else 4
    head = [(width, level, *((top["documents"], top["tokens"], top["hash"]) if top else (0, 0, "")))]
    spark.createDataFrame(head, "width int, levels int, documents long, tokens long, root string").coalesce(1).write.parquet(f"{folder}/head")


def _leaves(recipes: DataFrame) -> DataFrame:
    """number, documents, tokens and hash of each recipe."""
    told = F.concat_ws("|", "number", "doc_id", "start", "n_tokens", F.concat_ws(",", F.transform("digests", F.hex)), F.concat_ws(",", F.col("behind").cast("array<string>")))
    return recipes.select("number", F.lit(1).cast("long").alias("documents"), F.col("n_tokens").alias("tokens"), F.sha2(told.cast("binary"), 256).alias("hash"))


def _parents(below: DataFrame, level: int) -> DataFrame:
    """number, documents, tokens and hash of the nodes above: each over at most FAN rows."""
    grouped = below.groupBy(F.floor(F.col("number") / FAN).alias("above")).agg(
        F.sum("documents").alias("documents"), F.sum("tokens").alias("tokens"), F.array_sort(F.collect_list(F.struct("number", "hash"))).alias("children")
    )
    told = F.concat_ws("|", F.lit(level), "documents", "tokens", F.concat_ws(",", F.col("children.number").cast("array<string>")), F.concat_ws(",", F.col("children.hash")))
    return grouped.select(F.col("above").alias("number"), "documents", "tokens", F.sha2(told.cast("binary"), 256).alias("hash"))


def _level(spark: SparkSession, folder: str, level: int) -> DataFrame:
    return spark.read.schema("number long, documents long, tokens long, hash string").parquet(f"{folder}/manifest/level={level}")


def verified_recipes(spark: SparkSession, folder: str):
    """The recipes and the store's head; fails where a leaf, an inner node or the root isn't what is read."""
    head = spark.read.schema("width int, levels int, documents long, tokens long, root string").parquet(f"{folder}/head").first()
    recipes = spark.read.schema("part int, number long, doc_id long, start long, n_tokens long, digests array<binary>, behind array<long>").parquet(f"{folder}/recipes")
    below = _leaves(recipes)
    for level in range(1, head["levels"] + 1):
        made, kept = _parents(below, level), _level(spark, folder, level)
        differ = made.withColumn("s", F.lit(1)).unionByName(kept.withColumn("s", F.lit(-1))).groupBy("number", "documents", "tokens", "hash").agg(F.sum("s").alias("s"))
        if differ.where("s <> 0").limit(1).count():
            raise ValueError(f"level {level} of the manifest of {folder} does not match what is below it")
        below = kept
    top = below.limit(2).collect()
    if [(r["documents"], r["tokens"], r["hash"]) for r in top] != ([(head["documents"], head["tokens"], head["root"])] if head["documents"] else []):
        raise ValueError(f"the root of {folder} does not match its head")
    return recipes, head


def read_store(spark: SparkSession, folder: str) -> DataFrame:
    """doc_id, start, n_tokens and ids (little-endian unsigned 32-bit) of every document, rebuilt from its chunks.

    A chunk that doesn't have its digest, or a recipe that isn't in the Merkle tree, fails the read.
    """
    (recipes, head), chunks = verified_recipes(spark, folder), spark.read.parquet(f"{folder}/chunks")
    width = head["width"]
    used = recipes.select("start", F.posexplode("digests").alias("pos", "digest")).join(chunks, "digest")
    gathered = used.groupBy("start").agg(F.collect_list(F.struct("pos", "ids")).alias("chunks"))
    joined = recipes.select("doc_id", "start", "n_tokens", "digests").join(gathered, "start", "left")

    def rebuild(batches):
        for batch in batches:
            rows = {n: batch.column(n) for n in ("doc_id", "start", "n_tokens")} | {"ids": []}
            for n, wanted, found in zip(*(batch.column(c).to_pylist() for c in ("n_tokens", "digests", "chunks"))):
                found = [c["ids"] for c in sorted(found or (), key=lambda c: c["pos"])]
                data = b"".join(found)
                if [digest(c) for c in found] != wanted or len(data) != n * width:
                    raise ValueError("a document's chunks do not match its recipe")
                rows["ids"].append(np.frombuffer(data, f"<u{width}").astype("<u4").tobytes())
            yield to_batches(rows, REBUILT)

    return joined.mapInArrow(rebuild, "doc_id long, start long, n_tokens long, ids binary")


@functools.cache
def _shifts() -> np.ndarray:
    """For each k: what each byte of a crc32 becomes when 2**k zero bytes follow (k x 4 x 256)."""
    tables = np.zeros((40, 4, 256), np.uint32)
    step = np.array([zlib.crc32(bytes([0]), c ^ 0xFFFFFFFF) ^ 0xFFFFFFFF for c in (1 << b for b in range(32))], np.uint32)
    for k in range(40):
        for byte in range(4):
            for value in range(256):
                bits = [step[8 * byte + b] for b in range(8) if value >> b & 1]
                tables[k, byte, value] = np.bitwise_xor.reduce(np.array(bits, np.uint32)) if bits else 0
        step = _through(tables[k], step)
    return tables


def _through(table: np.ndarray, crc: np.ndarray) -> np.ndarray:
    return table[0][crc & 255] ^ table[1][crc >> 8 & 255] ^ table[2][crc >> 16 & 255] ^ table[3][crc >> 24]


def shifted(crc: np.ndarray, n_bytes: np.ndarray) -> np.ndarray:
    """A chunk's part in the crc32 of a stream in which n_bytes follow it; the stream's is the exclusive or of all parts."""
    crc = crc.astype(np.uint32)
    for k in range(int(n_bytes.max()).bit_length() if len(n_bytes) else 0):
        at = np.flatnonzero(n_bytes >> k & 1)
        crc[at] = _through(_shifts()[k], crc[at])
    return crc


def digests_read(spark: SparkSession, folder: str) -> DataFrame:
    """doc_id, start, n_tokens and ids_crc32 (of little-endian unsigned 32-bit ids) of every document, from the files.

    Every chunk is read back once, held against its digest and summed; documents put together their chunks' sums.
    """
    (recipes, head), chunks = verified_recipes(spark, folder), spark.read.parquet(f"{folder}/chunks")
    width = head["width"]

    def sums(batches):
        for batch in batches:
            crcs, sizes, digests = [], [], batch.column("digest").to_pylist()
            for wanted, data in zip(digests, batch.column("ids").to_pylist()):
                if digest(data) != wanted:
                    raise ValueError("a chunk does not match its digest")
                crcs.append(zlib.crc32(np.frombuffer(data, f"<u{width}").astype("<u4").tobytes()))
                sizes.append(len(data) // width)
            yield pa.RecordBatch.from_arrays([pa.array(digests, pa.binary()), pa.array(crcs, pa.int64()), pa.array(sizes, pa.int64())], ["digest", "crc", "size"])

    def part(batches):
        for batch in batches:
            if batch.column("crc").null_count or not batch.column("size").equals(batch.column("wanted")):
                raise ValueError("a document's chunks do not match its recipe")
            crc = shifted(np.asarray(batch.column("crc"), np.int64), 4 * np.asarray(batch.column("behind"), np.int64)).astype(np.int64)
            yield pa.RecordBatch.from_arrays([batch.column("start"), pa.array(crc)], ["start", "crc"])

    summed = chunks.mapInArrow(sums, "digest binary, crc long, size long")
    # A chunk's size is what is behind the chunk before it less what is behind itself.
    sizes = F.transform("behind", lambda b, i: F.when(i == 0, F.col("n_tokens")).otherwise(F.get("behind", i - 1)) - b)
    used = recipes.select("start", F.explode(F.arrays_zip(F.col("digests").alias("digest"), F.col("behind").alias("behind"), sizes.alias("wanted"))).alias("x")).select("start", "x.*")
    parts = used.join(summed, "digest", "left").select("start", "behind", "wanted", "crc", "size").mapInArrow(part, "start long, crc long")
    found = parts.groupBy("start").agg(F.expr("bit_xor(crc)").alias("ids_crc32"))
    return recipes.select("doc_id", "start", "n_tokens").join(found, "start").select("doc_id", "start", "n_tokens", "ids_crc32")


def op6_content_store(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = shared_folder(spark, "store")
    write_store(documents(spark, sf_dir), tokenizer_path("word_bpe_49k.json"), folder)
    return digests_read(spark, folder)
