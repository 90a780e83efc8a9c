"""A Merkle manifest of a dataset: a tree over each source's rows, a tree over the sources, and every row's proof.

Bottom up, each level joins runs of ``FAN`` children to their parent and is persisted in the manifest's folder. Top down, each parent
hands its own path to its children, and a child puts its siblings before what it inherits, so that a row's proof costs one short row a
parent and no walk of its own. All is SQL functions; a text is read and hashed where it lies and never shuffled.

Places come from a range partitioning (source, doc_id, leaf), numbered within the partitions and moved by the counts of those before, so
that a source of any size is in no single task. No key of a later shuffle has more than ``FAN`` rows, but (partition, source), which has
those of a partition at most.

Layout of a manifest's folder: ``places`` (rows with source, doc_id, leaf, and another leaf to be tested), ``sources``,
``rows/level=k`` and ``tops/level=k`` (tree, pos, n: nodes of its tree on this level, hash, children).

Defined results: a null field is ``-`` and an empty one ``0:``; rows without doc_id are leaves too, before those with one, and are never tampered with; a null source
is a source of its own, before the empty one; rows that repeat a doc_id are a leaf each, in the order of their digests, and equal rows
have one each as well; extra columns are ignored; a lone leaf is its source's subroot, a lone source's subroot the root; an empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType

from quarryline.llm.common import crc_remainder, documents, shared_folder, small, stored

#: Children of a node.
FAN = 16
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def _text(digest: Column) -> Column:
    """Digests, kept as bytes, as they are hashed: lowercase hex."""
    return F.lower(F.hex(digest))


def _hash(text: Column) -> Column:
    return F.unhex(F.sha2(text.cast("binary"), 256))


def leaf_hash(*fields: Column) -> Column:
    """SHA-256 of the fields, each ``-`` if null, else UTF-8 byte count, colon, value."""
    told = (F.coalesce(F.concat(F.octet_length(c).cast("string"), F.lit(":"), c), F.lit("-")) for c in (f.cast("string") for f in fields))
    return _hash(F.concat(*told))


def numbered(rows: DataFrame, order: list[str], path: str) -> DataFrame:
    """rows, written to path, with ``number`` (from 0, in the given order, in which all rows differ) and ``part``, which a task's rows share."""
    spark = rows.sparkSession
    ordered = rows.repartitionByRange(*order).sortWithinPartitions(*order)
    # Written before parts are summed up, so that a row keeps its part if a task is run again.
    ordered.withColumn("place", F.monotonically_increasing_id()).write.parquet(path)
    placed = spark.read.schema(StructType([*rows.schema, StructField("place", LongType())])).parquet(path).withColumn("part", F.shiftright("place", 33))
    counts = stored(placed.groupBy("part").agg(F.count("*").alias("n")), "parts")
    # One row for each part: as many as tasks wrote rows.
    bases = counts.select("part", F.coalesce(F.sum("n").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("base"))
    return placed.join(small(bases, counts.count()), "part").withColumn("number", F.col("base") + F.col("place").bitwiseAND((1 << 33) - 1)).drop("base", "place")


def _above(nodes: DataFrame, *more: str) -> DataFrame:
    """The parents of nodes (tree, pos, n, hash): each over at most FAN rows. ``more`` names what children keep."""
    runs = nodes.groupBy("tree", F.floor(F.col("pos") / FAN).alias("pos")).agg(F.first("n").alias("n"), F.array_sort(F.collect_list(F.struct("pos", "hash", *more))).alias("children"))
    told = F.concat_ws("", F.transform("children", lambda c: _text(c["hash"])))
    return runs.select("tree", "pos", F.ceil(F.col("n") / FAN).alias("n"), _hash(told).alias("hash"), "children")


def build(nodes: DataFrame, folder: str, *more: str) -> tuple[list[DataFrame], DataFrame]:
    """The levels above nodes (tree, pos, n, hash), written to folder, and the root of each tree (tree, hash)."""
    most = nodes.agg(F.max("n")).first()[0] or 0
    levels, roots, below, extra = [], nodes.where("n = 1").select("tree", "hash"), nodes, more
    while most > 1:
        path = f"{folder}/level={len(levels) + 1}"
        made = _above(below.where("n > 1"), *extra)
        made.write.parquet(path)
        level = nodes.sparkSession.read.schema(made.schema).parquet(path)
        levels.append(level)
        roots = roots.unionByName(level.where("n = 1").select("tree", "hash"))
        below, extra, most = level, (), -(-most // FAN)
    return levels, roots


_PATH = "array<struct<left: binary, right: binary>>"


def _children(level: DataFrame, handed: list[str]) -> DataFrame:
    """The children of a level's nodes (tree, children, path), each with its siblings before the path of its parent."""
    around = lambda start, length: F.unhex(F.array_join(F.transform(F.slice("hashes", start, length), lambda h: F.hex(h)), ""))
    one = level.select("tree", "path", *handed, F.transform("children", lambda c: c["hash"]).alias("hashes"), F.posexplode("children").alias("i", "child"))
    step = F.struct(around(F.lit(1), F.col("i")).alias("left"), around(F.col("i") + 2, F.lit(FAN)).alias("right"))
    return one.select("tree", "child.*", *handed, F.concat(F.array(step), F.col("path")).alias("path"))


def push(levels: list[DataFrame], tops: DataFrame, leaves: DataFrame) -> DataFrame:
    """leaves (tree, pos, n, hash, ...) without n, but with their paths to the top; tops (tree, path, ...) are what the trees' roots hand down."""
    handed = [c for c in tops.columns if c not in ("tree", "path")]
    kept, paths = [c for c in leaves.columns if c != "n"], None
    for k, level in reversed(list(enumerate(levels))):
        known = level.where("n = 1").join(tops, "tree").select("tree", "children", "path", *handed)
        if paths is not None:
            lower = level.where("n > 1").join(paths.select("tree", "pos", "path", *handed), ["tree", "pos"])
            known = known.unionByName(lower.select("tree", "children", "path", *handed))
        paths = _children(known, handed)
        if k:
            paths = stored(paths, "paths")
    lone = leaves.where("n = 1").join(tops, "tree").select(*kept, *handed, "path")
    return lone if paths is None else lone.unionByName(paths)


def folded(leaf: Column, path: Column) -> Column:
    """The root that a leaf and its siblings come to."""
    return F.aggregate(path, _text(leaf), lambda digest, s: F.sha2(F.concat(_text(s["left"]), digest, _text(s["right"])).cast("binary"), 256))


def proof_hash(path: Column) -> Column:
    """SHA-256 of a path's digests, level by level, left to right."""
    return F.sha2(F.array_join(F.transform(path, lambda s: F.concat(_text(s["left"]), _text(s["right"]))), "").cast("binary"), 256)


def build_manifest(docs: DataFrame, folder: str, changed: Callable[[Column], Column] | None = None) -> DataFrame:
    """Writes the manifest of docs to folder. Returns doc_id, leaf, subroot, root, path, and ``tested``: the leaf of the row with ``changed(text)`` as text.

    ``changed`` gives null where a row is left as it is; ``tested`` is its leaf then. Digests are bytes; ``path`` lists the siblings
    (left, right) of each level, from the leaf to the root. With paths, anyone who has the root can verify a row by ``folded``.
    """
    text = F.col("text")
    other = changed(text) if changed else F.lit(None).cast("string")
    fields = [F.col(c) for c in ("doc_id", "source", "lang", "n_chars")]
    leaves = docs.select("source", "doc_id", leaf_hash(*fields, text).alias("hash"), F.when(other.isNotNull(), leaf_hash(*fields, other)).alias("tested"), F.monotonically_increasing_id().alias("nth"))
    # Hashed once: a range partitioning reads its rows twice. ``nth`` tells equal rows apart.
    placed = numbered(stored(leaves, "leaves"), ["source", "doc_id", "hash", "nth"], f"{folder}/places")
    # Rows of a source in a part are consecutive: their places in the source follow from the first of them.
    spans = stored(placed.groupBy("part", "source").agg(F.min("number").alias("low"), F.count("*").alias("many")), "spans")
    sources = numbered(spans.groupBy("source").agg(F.min("low").alias("first"), F.sum("many").alias("n")), ["source"], f"{folder}/sources").select("source", "first", "n", F.col("number").alias("tree"))
    starts = spans.join(sources, spans["source"].eqNullSafe(sources["source"])).select("part", spans["source"], "first", "n", "tree")
    on = (placed["part"] == starts["part"]) & placed["source"].eqNullSafe(starts["source"])
    nodes = stored(placed.join(starts, on).select("tree", (F.col("number") - F.col("first")).alias("pos"), "n", "hash", "doc_id", "tested"), "nodes")

    levels, subroots = build(nodes, f"{folder}/rows", "doc_id", "tested")
    upper = subroots.select(F.lit(0).cast("long").alias("tree"), F.col("tree").alias("pos"), F.lit(subroots.count()).cast("long").alias("n"), "hash")
    upper = stored(upper, "subroots")
    above, root = build(upper, f"{folder}/tops")
    tops = root.select("tree", F.array().cast(_PATH).alias("path"), F.col("hash").alias("root"))
    inherited = push(above, tops, upper).select(F.col("pos").alias("tree"), "path", "root", F.col("hash").alias("subroot"))
    rows = push(levels, stored(inherited, "inherited"), nodes)
    return rows.select("doc_id", F.col("hash").alias("leaf"), "subroot", "root", "path", F.coalesce("tested", "hash").alias("tested"))


def op13_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    lowered = lambda text: F.when(crc_remainder(5) == 0, F.translate(text, UPPER, LOWER))
    rows = build_manifest(documents(spark, sf_dir), shared_folder(spark, "manifest"), lowered)
    found = folded(F.col("tested"), F.col("path"))
    return rows.select(
        "doc_id", *(_text(F.col(c)).alias(c) for c in ("leaf", "subroot", "root")), proof_hash(F.col("path")).alias("proof_sha256"), found.alias("folded_root"), (found == _text(F.col("root"))).alias("verified")
    )
