"""N-gram Jaccard self-join by T-occurrence search with long lists set apart.

A document's set is its different 5-word shingles. Documents with equal sets are one class. Two sets that reach
the threshold share at least T shingles, so under any common order their first n - T + k shingles share at least
k. The order puts shingles with long inverted lists last (a bounded table of those found in many documents) and
goes by hash otherwise: the short lists are merged by the shuffle, sorted by shingle, and what two classes share
in them is counted; the long lists are probed by binary search in the sorted sets of the pairs that are left.

Classes are first held against one class of a list, that of most copies (a star, linear in the list's length). Lists
whose classes then lie in one component need no more. Pairs across components of a short list come from a join; those
of a long list from blocks of classes, whose incidence with the long lists is multiplied block by block, so that
no list is held or paired out in one task. Sketches (the parity of each of SKETCH bits) bound two sets'
difference from below and drop pairs that can't link; the rest is verified on the whole sets. No link between
components is lost.

Shingles and whole sets are known by 64-bit hashes. A class keeps its smallest doc_id with the hash of that row's text, and only a
text that gives the class's set is verified for it, so rows that share a doc_id but not the text keep their own links.

Defined results: null and empty texts have n_shingles 0 and are their own component; fewer than five words are one
shingle; rows without doc_id are left out; repeated rows fall in one class; rows are the nodes, so two texts under one doc_id are
linked only if they reach the threshold; extra columns are ignored; an empty table gives no rows.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quarryline.llm.common import documents, mix, slices, stored, texts, to_batches, word_hashes
from quarryline.llm.components import components

#: Shingle length; the threshold in hundredths; shingles that the first parts of two linked sets share at least.
WORDS, PERCENT, SHARED = 5, 80, 3
#: Classes of a list that is still joined as a short one; classes of a block, about; the fewest bits of a sketch.
SHORT, BLOCK, SKETCH = 24, 512, 1024
#: Long lists set apart at most (8 bytes each are broadcast), and documents of a list of a slice that make it long.
LONG_LISTS, LONG_HERE = 1 << 17, 4
#: Bytes of text of such a slice.
LONG_SLICE = 16 << 20
SETS = pa.schema([("doc_id", pa.int64()), ("h", pa.int64()), ("n", pa.int64()), ("class", pa.int64()), ("first", pa.binary()), ("sketch", pa.binary())])
BLOCKS = pa.schema([("block", pa.int64()), *((n, pa.binary()) for n in ("classes", "roots", "sizes", "sketches", "owners", "tokens"))])
POSTINGS = pa.schema([("token", pa.int64()), ("classes", pa.list_(pa.int64()))])
_ODD = np.uint64(0x9E3779B97F4A7C15)


def shingle_sets(column: pa.Array) -> list[np.ndarray]:
    """Each row's set: the ascending 64-bit hashes of its different shingles."""
    hashes, counts = word_hashes(column)
    stops = np.concatenate([[0], np.cumsum(counts)])
    with np.errstate(over="ignore"):
        rolled = hashes.copy()
        for j in range(1, WORDS):
            rolled = mix(rolled[: len(hashes) - j if len(hashes) > j else 0] * _ODD + hashes[j:]) if len(hashes) > j else np.zeros(0, np.uint64)
        sets = []
        for a, b in zip(stops[:-1].tolist(), stops[1:].tolist()):
            if b - a >= WORDS:
                sets.append(np.unique(rolled[a : b - WORDS + 1]))
            elif b > a:
                whole = np.uint64(b - a)
                for h in hashes[a:b]:
                    whole = mix(np.array([whole * _ODD + h], np.uint64))[0]
                sets.append(np.array([whole], np.uint64))
            else:
                sets.append(np.zeros(0, np.uint64))
    return sets


def least_overlap(n: int) -> int:
    """Shingles that a set of n shares at least with any that it links with."""
    return -(-PERCENT * n // 100)


def _long_lists(docs: DataFrame) -> np.ndarray:
    """Shingles found in many documents of some slice, the commonest first: an order, which needn't be complete."""

    def often(held):
        token, count = np.unique(np.concatenate(held), return_counts=True)
        keep = count >= LONG_HERE
        return pa.RecordBatch.from_arrays([pa.array(token[keep].view(np.int64)), pa.array(count[keep].astype(np.int64))], ["token", "n"])

    def work(batches):
        held, size = [], 0
        for batch in slices(batches):
            # An order by hash takes the lowest fifth of a set; long lists above the lowest two fifths don't matter.
            held += [s[s < np.uint64(0x6666666666666666)] for s in shingle_sets(batch.column("text"))]
            size += batch.column("text").nbytes
            if size >= LONG_SLICE:
                yield often(held)
                held, size = [], 0
        if held:
            yield often(held)

    found = docs.mapInArrow(work, "token long, n long").groupBy("token").agg(F.sum("n").alias("n"))
    rows = found.orderBy(F.desc("n"), "token").limit(LONG_LISTS).select("token").toPandas()
    return np.sort(rows["token"].to_numpy(np.int64).view(np.uint64))


def class_of(shingles: np.ndarray) -> int:
    """The class of a set: a hash of its shingles."""
    with np.errstate(over="ignore"):
        return int(mix(np.array([mix(shingles).sum(dtype=np.uint64) + np.uint64(len(shingles))], np.uint64)).view(np.int64)[0])


def _sets(docs: DataFrame, long_lists: np.ndarray) -> DataFrame:
    """doc_id, h, n, class, the first shingles and the sketch of every set."""
    shared = docs.sparkSession.sparkContext.broadcast(long_lists)

    def work(batches):
        apart = shared.value
        for batch in slices(batches):
            rows = {"doc_id": batch.column("doc_id"), "h": batch.column("h"), "n": [], "class": [], "first": [], "sketch": []}
            for s in shingle_sets(batch.column("text")):
                n = len(s)
                need = least_overlap(n)
                key = class_of(s)
                if len(apart) and n:
                    is_long = apart[np.minimum(np.searchsorted(apart, s), len(apart) - 1)] == s
                    if is_long.any():
                        s = np.concatenate([s[~is_long], s[is_long]])
                rows["n"].append(n)
                bits = max(SKETCH, 1 << (2 * n).bit_length())
                odd = np.bincount((s & np.uint64(bits - 1)).astype(np.int64), minlength=bits) & 1
                rows["sketch"].append(np.packbits(odd.astype(np.uint8)).tobytes())
                rows["class"].append(key)
                rows["first"].append(s[: n - need + min(SHARED, need)].tobytes())
            yield to_batches(rows, SETS)

    return docs.mapInArrow(work, "doc_id long, h long, n long, class long, first binary, sketch binary")


def _postings(sets: DataFrame, slice_tokens: int = 2 << 20) -> DataFrame:
    """token and the different classes that hold it, a row for each token of a slice (combined before the shuffle)."""

    def emit(held):
        tokens = np.concatenate([np.frombuffer(f, np.int64) for _, f in held])
        classes = np.repeat(np.array([c for c, _ in held], np.int64), [len(f) // 8 for _, f in held])
        order = np.lexsort((classes, tokens))
        tokens, classes = tokens[order], classes[order]
        new = np.append(True, (tokens[1:] != tokens[:-1]) | (classes[1:] != classes[:-1]))
        tokens, classes = tokens[new], classes[new]
        begins = np.flatnonzero(np.append(True, tokens[1:] != tokens[:-1]))
        lists = np.append(begins, len(tokens)).astype(np.int32)
        whole = pa.RecordBatch.from_arrays([pa.array(tokens[begins]), pa.ListArray.from_arrays(pa.array(lists), pa.array(classes))], schema=POSTINGS)
        for a in range(0, whole.num_rows, 1 << 16):
            yield whole.slice(a, 1 << 16)

    def work(batches):
        held, size = [], 0
        for batch in batches:
            for c, f in zip(batch.column("class").to_pylist(), batch.column("first").to_pylist()):
                if f:
                    held.append((c, f))
                    size += len(f) // 8
                if size >= slice_tokens:
                    yield from emit(held)
                    held, size = [], 0
        if held:
            yield from emit(held)

    return sets.select("class", "first").mapInArrow(work, "token long, classes array<long>")


def _verified(pairs: DataFrame, classes: DataFrame, docs: DataFrame) -> DataFrame:
    """Of pairs (a, b) of classes those whose whole sets reach the threshold."""
    used = pairs.select(F.explode(F.array("a", "b")).alias("class")).distinct().join(classes, "class").select("class", F.col("first.doc_id").alias("doc_id"), F.col("first.h").alias("h"))
    read = docs.join(used, ["doc_id", "h"]).dropDuplicates(["doc_id", "h", "class"])

    def sets(batches):
        for batch in slices(batches):
            found = shingle_sets(batch.column("text"))
            same = [class_of(s) == c for s, c in zip(found, batch.column("class").to_pylist())]
            made = pa.RecordBatch.from_arrays([batch.column("class"), pa.array([s.tobytes() for s in found], pa.binary())], ["class", "shingles"])
            yield made.filter(pa.array(same, pa.bool_()))

    def probe(batches):
        for batch in batches:
            keep = []
            for x, y in zip(batch.column("x").to_pylist(), batch.column("y").to_pylist()):
                x, y = sorted((np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64)), key=len)
                at = np.minimum(np.searchsorted(y, x), len(y) - 1)
                both = int((y[at] == x).sum())
                keep.append(100 * both >= PERCENT * (len(x) + len(y) - both))
            yield pa.RecordBatch.from_arrays([batch.column("a"), batch.column("b")], ["a", "b"]).filter(pa.array(keep, pa.bool_()))

    made = stored(read.mapInArrow(sets, "class long, shingles binary"), "shingles")
    one = pairs.join(made.select(F.col("class").alias("a"), F.col("shingles").alias("x")), "a")
    both = one.join(made.select(F.col("class").alias("b"), F.col("shingles").alias("y")), "b")
    return stored(both.select("a", "b", "x", "y").mapInArrow(probe, "a long, b long"), "links")


def _across_blocks(rest: DataFrame) -> DataFrame:
    """Pairs (a, b) of classes of different components that share a long list and whose sizes and sketches may link.

    rest: token, class, root, n, sketch of the classes of long lists.
    """
    held = rest.groupBy("class").agg(F.first("root").alias("root"), F.first("n").alias("n"), F.first("sketch").alias("sketch"), F.collect_set("token").alias("tokens")).withColumn("cluster", F.array_min("tokens"))
    # A block's classes have sizes of one band (at the threshold's ratio), so that blocks of far bands are not paired.
    held = held.withColumn("band", F.floor(F.log(100 / PERCENT, F.col("n"))))
    sizes = held.groupBy("cluster", "band").agg(F.ceil(F.count("*") / BLOCK).alias("parts"))
    held = stored(held.join(sizes, ["cluster", "band"]).withColumn("block", F.xxhash64("cluster", "band", F.pmod(F.xxhash64("class"), "parts"))).drop("cluster", "band", "parts"), "held")

    def pack(table: pa.Table) -> pa.Table:
        tokens = table.column("tokens").to_pylist()
        rows = {"block": [table.column("block")[0].as_py()], "owners": [np.repeat(np.arange(len(tokens)), [len(t) for t in tokens]).tobytes()], "tokens": [np.array([x for t in tokens for x in t], np.int64).tobytes()]}
        for name, column in (("classes", "class"), ("roots", "root"), ("sizes", "n")):
            rows[name] = [np.asarray(table.column(column), np.int64).tobytes()]
        rows["sketches"] = [np.stack([folded(s, SKETCH // 8) for s in table.column("sketch").to_pylist()]).tobytes()]
        return pa.Table.from_batches([to_batches(rows, BLOCKS)])

    blocks = stored(held.groupBy("block").applyInArrow(pack, "block long, classes binary, roots binary, sizes binary, sketches binary, owners binary, tokens binary"), "blocks")
    touched = held.select("block", "n", F.explode("tokens").alias("token")).groupBy("block", "token").agg(F.min("n").alias("n_a"), F.max("n").alias("n_b"))
    one, two = (touched.select("token", F.col("block").alias(x), F.col("n_a").alias(f"least_{x}"), F.col("n_b").alias(f"most_{x}")) for x in "ij")
    pairs = one.join(two, "token").where(f"i <= j and {PERCENT} * least_i <= 100 * most_j and {PERCENT} * least_j <= 100 * most_i").select("i", "j").distinct()
    sides = [blocks.select(*(F.col(c).alias(f"{c}_{s}" if c != "block" else s) for c in blocks.columns)) for s in "ij"]
    joined = stored(pairs, "block-pairs").join(sides[0], "i").join(sides[1], "j")

    def multiply(batches):
        for batch in batches:
            for row in batch.to_pylist():
                x, y = ({n: np.frombuffer(row[f"{n}_{s}"], np.int64) for n in BLOCKS.names[1:]} for s in "ij")
                both = np.intersect1d(x["tokens"], y["tokens"])
                marks = []
                for side in (x, y):
                    at = np.minimum(np.searchsorted(both, side["tokens"]), len(both) - 1)
                    hit = both[at] == side["tokens"]
                    mark = np.zeros((len(side["classes"]), len(both)), np.float32)
                    mark[side["owners"][hit], at[hit]] = 1
                    marks.append(mark)
                n_x, n_y = x["sizes"][:, None], y["sizes"][None, :]
                may = (marks[0] @ marks[1].T > 0) & (x["roots"][:, None] != y["roots"][None, :]) & (PERCENT * np.maximum(n_x, n_y) <= 100 * np.minimum(n_x, n_y))
                if row["i"] == row["j"]:
                    may = np.triu(may, 1)
                a, b = np.nonzero(may)
                sketch_x, sketch_y = (side["sketches"].view(np.uint64).reshape(len(side["classes"]), -1) for side in (x, y))
                keep = [np.zeros(0, bool)]
                for k in range(0, len(a), 1 << 14):
                    p, q = a[k : k + (1 << 14)], b[k : k + (1 << 14)]
                    away = np.bitwise_count(sketch_x[p] ^ sketch_y[q]).sum(axis=1, dtype=np.int64)
                    keep.append((100 + PERCENT) * away <= (100 - PERCENT) * (x["sizes"][p] + y["sizes"][q]))
                keep = np.concatenate(keep)
                one, two = x["classes"][a[keep]], y["classes"][b[keep]]
                yield pa.RecordBatch.from_arrays([pa.array(np.minimum(one, two)), pa.array(np.maximum(one, two))], ["a", "b"])

    return joined.mapInArrow(multiply, "a long, b long")


def _text_hash(docs: DataFrame):
    return F.xxhash64(F.coalesce(docs["text"], F.lit("")))


def _grouped(docs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The sets (doc_id, h, n, class) of all rows, and each class's root and first row (class, root, first)."""
    rows = texts(docs, _text_hash(docs).alias("h"))
    sets = stored(_sets(rows, _long_lists(rows)), "sets")
    classes = stored(sets.where("n > 0").groupBy("class").agg(F.min(F.struct("doc_id", "h")).alias("first"), F.min("n").alias("n"), F.count("*").alias("copies"), F.first("sketch").alias("sketch")), "classes")
    sized = classes.select("class", "n", "copies")

    counted = _postings(sets).withColumn("k", F.size("classes"))
    # Sums are combined before the shuffle; a join, which Spark may split where it is skewed, brings them to the lists.
    common = counted.groupBy("token").agg(F.sum("k").alias("df")).where("df > 1").select("token")
    lists = counted.join(common, "token", "left_semi").select("token", F.explode("classes").alias("class")).distinct()
    lists = stored(lists.join(sized, "class"), "lists")

    # Star: each class against the class of most copies of its lists that it shares most lists with.
    leaders = stored(lists.groupBy("token").agg(F.max(F.struct("copies", "class")).alias("x"), F.count("*").alias("k")).where("k > 1").select("token", F.col("x.class").alias("a")), "leaders")
    met = lists.join(leaders, "token").where("a <> class").groupBy("a", F.col("class").alias("b"), F.col("n").alias("n_b")).count()
    near = met.join(sized.select(F.col("class").alias("a"), F.col("n").alias("n_a")), "a").where(_may_link())
    best = near.groupBy("b").agg(F.max_by("a", F.struct("count", "a")).alias("a")).select("a", "b")
    links = _verified(stored(_sketches_fit(best, classes), "star"), classes, rows)

    # Lists with classes of different components: all pairs across components.
    roots = stored(components(links), "roots").withColumnRenamed("id", "class")
    members = lists.join(roots, "class", "left").withColumn("root", F.coalesce("root", "class"))
    mixed = members.groupBy("token").agg(F.min("root").alias("r"), F.max("root").alias("s"), F.count("*").alias("k")).where("r <> s").select("token", (F.col("k") <= SHORT).alias("short"))
    rest = stored(members.drop("copies").join(mixed, "token"), "mixed")
    a, b = (rest.where("short").select("token", F.col("class").alias(s), F.col("n").alias(f"n_{s}"), F.col("root").alias(f"root_{s}")) for s in "ab")
    counts = a.join(b, "token").where(f"a < b and root_a <> root_b and {_sizes_fit()}").groupBy("a", "b", "n_a", "n_b").count().where(_may_link())
    across = _across_blocks(rest.where("not short").join(classes.select("class", "sketch"), "class"))
    drawn = _sketches_fit(counts.select("a", "b").unionByName(across).distinct(), classes)
    more = _verified(stored(drawn, "pairs"), classes, rows)

    roots = components(links.unionByName(more))
    found = classes.select("class", "first").join(roots.withColumnRenamed("id", "class"), "class", "left")
    return sets, found.withColumn("root", F.coalesce("root", "class"))


def near_duplicates(docs: DataFrame) -> DataFrame:
    """doc_id, n_shingles and component_id of every row."""
    sets, found = _grouped(docs)
    smallest = found.groupBy("root").agg(F.min("first.doc_id").alias("component_id"))
    by_class = found.join(smallest, "root").select("class", "component_id")
    out = sets.select("doc_id", "n", "class").join(by_class, "class", "left")
    return out.select("doc_id", F.col("n").alias("n_shingles"), F.when(F.col("n") > 0, F.col("component_id")).otherwise(F.col("doc_id")).alias("component_id"))


def keep_one(docs: DataFrame) -> DataFrame:
    """One document of each component: the row of smallest doc_id (and, of several texts under it, smallest hash of the text), once.

    Rows without text or words are linked with nothing and stay, each different (doc_id, text) once, a null text being the empty one; of
    rows that share doc_id and text the first stays, all their columns compared in order, nulls first; rows without doc_id go; all columns of docs, which must be
    such as can be compared, are returned, whatever their names.
    """
    sets, found = _grouped(docs)
    first = found.groupBy("root").agg(F.min("first").alias("first")).select("first.*")
    kept = first.unionByName(sets.where("n = 0").select("doc_id", "h")).distinct()
    match = (docs["doc_id"].cast("long") == kept["doc_id"]) & (_text_hash(docs) == kept["h"])
    alike = docs.join(kept, match, "left_semi")
    whole = F.struct(*(alike[c] for c in docs.columns))
    return alike.groupBy(alike["doc_id"].cast("long").alias("id"), _text_hash(alike).alias("h")).agg(F.min(whole).alias("row")).select("row.*")


def _sizes_fit():
    return f"{PERCENT} * greatest(n_a, n_b) <= 100 * least(n_a, n_b)"


def _sketches_fit(pairs: DataFrame, classes: DataFrame) -> DataFrame:
    """The pairs (a, b) of classes whose difference, which is at least that of their sketches, isn't too large to link."""
    sides = [classes.select(F.col("class").alias(s), F.col("n").alias(f"n_{s}"), F.col("sketch").alias(f"sketch_{s}")) for s in "ab"]

    def compare(batches):
        for batch in batches:
            keep = []
            for n, x, y in zip(np.asarray(batch.column("n")).tolist(), batch.column("sketch_a").to_pylist(), batch.column("sketch_b").to_pylist()):
                size = min(len(x), len(y))
                away = int(np.bitwise_count((folded(x, size) ^ folded(y, size)).view(np.uint64)).sum(dtype=np.int64))
                keep.append((100 + PERCENT) * away <= (100 - PERCENT) * n)
            yield pa.RecordBatch.from_arrays([batch.column("a"), batch.column("b")], ["a", "b"]).filter(pa.array(keep, pa.bool_()))

    both = pairs.join(sides[0], "a").join(sides[1], "b")
    return both.select("a", "b", (F.col("n_a") + F.col("n_b")).alias("n"), "sketch_a", "sketch_b").mapInArrow(compare, "a long, b long")


def folded(sketch: bytes, size: int) -> np.ndarray:
    """A sketch's bytes for a smaller number of bits: parities over the bits that fall together."""
    raw = np.frombuffer(sketch, np.uint8)
    return raw if len(raw) == size else np.bitwise_xor.reduce(raw.reshape(-1, size), axis=0)


def _may_link():
    """The sizes fit, and enough of the first shingles are shared."""
    return f"{_sizes_fit()} and count >= least({SHARED}, ceil({PERCENT} * least(n_a, n_b) / 100))"


def op9_ngram_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(documents(spark, sf_dir))
