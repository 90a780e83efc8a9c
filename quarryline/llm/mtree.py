"""Exact top-k by inner product over an M-tree, best first.

The tree has four levels. The root holds routing objects (a bounded sample of vectors, more of them for more vectors). Each
routing object's subtrees are listed in inner nodes: centre, covering radius and distance to the routing object of up to FAN
subtrees. A subtree is one row of up to SUBTREE entries in pages; a page has a centre, a covering radius and the distance of each
entry to that centre. Inner nodes and subtrees are stored in the shared folder. Vectors are dealt to the subtrees by routing object and,
where that has many vectors, by hash, so that no routing object gathers in one task; equal vectors are one entry.

The search has two rounds. In the first each query follows the routing object and the subtrees that promise most, which gives it a
threshold: its k-th best score so far. In the second it goes down wherever a bound reaches the threshold: at the root by covering radius,
at inner nodes first by |d(query, routing object) - d(centre, routing object)| and then by covering radius, before any vector is read.
Within a subtree pages are taken best bound first until one is below the threshold; entries of a page are skipped by
|d(query, centre) - d(entry, centre)| without computing their products.

For |a - b| >= g the product is at most (|a|^2 + |b|^2 - g^2) / 2, and over a ball of radius r around c it
is at most a.c + |a| r; both hold with a small allowance for rounding, so no answer is lost.

Defined results: vectors that are null or hold null or non-finite components, and vectors of another length than
the commonest, take no part; repeated rows count each as candidates, but a repeated query row is asked once; a query id with several
vectors asks with each, ranked apart; no row of a query's own id is a candidate; equal scores go to the smaller vec_id; queries
without candidates give no rows; products beyond 64 bits are not defined; extra columns are ignored; an empty table gives no rows.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quarryline.llm.common import stored, to_batches
from quarryline.llm.vectors import asked, best_of, block, collapsed, distances, matrix, to_balls, top_rows, unblocked, valid_vectors

#: Bounds: routing objects (from LEAST to MOST, one for ROUTED vectors), subtrees of an inner node, entries of a subtree and of a page,
#: queries of a block, vectors that a task holds to cut them into subtrees.
LEAST_ROUTES, MOST_ROUTES, ROUTED = 128, 2048, 1 << 16
FAN, SUBTREE, PAGE, QUERIES, HELD = 256, 4096, 64, 256, 16384
NODE = pa.schema([("node", pa.int64()), ("route", pa.int32()), ("centre", pa.binary()), ("radius", pa.float64()), ("parent", pa.float64()), ("longest", pa.float64()), *((n, pa.binary()) for n in ("ids", "owners", "vectors", "pages", "centres", "radii", "parents"))])
BLOCK = pa.schema([("route", pa.int32()), *((n, pa.binary()) for n in ("query_ids", "query_keys", "queries", "thresholds"))])
VISIT = pa.schema([("node", pa.int64()), *((n, pa.binary()) for n in ("query_ids", "query_keys", "queries", "thresholds"))])
FOUND = pa.schema([("query_id", pa.int64()), ("query_key", pa.int64()), ("vec_id", pa.int64()), ("score", pa.int64())])
_NODE_DDL = "node long, route int, centre binary, radius double, parent double, longest double, ids binary, owners binary, vectors binary, pages binary, centres binary, radii binary, parents binary"
_ASKED_DDL = "query_ids binary, query_keys binary, queries binary, thresholds binary"


def quantised(table: DataFrame) -> DataFrame:
    """vec_id and vector, each component x as floor(256 * x), computed in double precision."""
    rows = valid_vectors(table, zero=True)
    return rows.select("vec_id", F.transform("vector", lambda x: F.floor(x * F.lit(256.0)).cast("long")).alias("vector"))


def routing_objects(entries: DataFrame, count: int) -> np.ndarray:
    """At most ``count`` different vectors: a sample by hash, thinned to those farthest apart (bounded, on the driver)."""
    sample = entries.select("vector").orderBy(F.xxhash64("vector"), "vector").limit(8 * count).collect()
    if not sample:
        return np.zeros((0, 0))
    x = np.unique(np.array([r["vector"] for r in sample], np.float64), axis=0)
    chosen, away = [0], ((x - x[0]) ** 2).sum(axis=1)
    while len(chosen) < min(count, len(x)) and away.max() > 0:
        chosen.append(int(away.argmax()))
        away = np.minimum(away, ((x - x[chosen[-1]]) ** 2).sum(axis=1))
    return x[chosen]


def halved(x: np.ndarray, most: int) -> list[np.ndarray]:
    """Positions of x in groups of at most ``most`` that lie close together: halved along the direction of a far vector."""
    groups, left = [], [np.arange(len(x))]
    while left:
        at = left.pop()
        if len(at) <= most:
            groups.append(at)
            continue
        far = at[((x[at] - x[at[0]]) ** 2).sum(axis=1).argmax()]
        order = at[np.argsort(x[at] @ (x[far] - x[at[0]]), kind="stable")]
        left += [order[: len(at) // 2], order[len(at) // 2 :]]
    return groups


def node(number: int, route: int, routing_object: np.ndarray, x: np.ndarray, lists: list) -> dict:
    """One subtree: pages of entries that lie close together, each with centre, radius and parent distances; lists: ids of each vector."""
    pages = halved(x, PAGE)
    order = np.concatenate(pages)
    sizes = np.array([len(p) for p in pages], np.int32)
    centres = np.stack([x[p].mean(axis=0) for p in pages])
    parents = np.concatenate([np.sqrt(((x[p] - c) ** 2).sum(axis=1)) for p, c in zip(pages, centres)])
    radii = np.maximum.reduceat(parents, np.concatenate([[0], np.cumsum(sizes)[:-1]]))
    centre = x.mean(axis=0)
    owned = [lists[i] for i in order.tolist()]
    return {
        "node": number, "route": route, "centre": centre.tobytes(), "radius": float(np.sqrt(((x - centre) ** 2).sum(axis=1)).max()),
        "parent": float(np.sqrt(((centre - routing_object) ** 2).sum())), "longest": float(np.sqrt((x**2).sum(axis=1)).max()),
        "ids": np.concatenate(owned).astype("<i8").tobytes(), "owners": np.append(0, np.cumsum([len(i) for i in owned])).astype("<i8").tobytes(),
        "vectors": x[order].astype("<f8").tobytes(), "pages": sizes.tobytes(), "centres": centres.tobytes(), "radii": radii.tobytes(), "parents": parents.tobytes(),
    }


def build(entries: DataFrame, routes: np.ndarray) -> DataFrame:
    """The subtrees of entries (vector, ids)."""

    def route(batches):
        for batch in batches:
            if batch.num_rows:
                x, near = matrix(batch.column("vector")), []
                for a in range(0, len(x), 1024):
                    near.append(distances(x[a : a + 1024], routes).argmin(axis=1))
                yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(np.concatenate(near).astype(np.int32))], ["vector", "ids", "route"])

    routed = stored(entries.select("vector", "ids").mapInArrow(route, "vector array<long>, ids array<long>, route int"), "routed")
    parts = routed.groupBy("route").agg(F.ceil(F.count("*") / HELD).alias("parts"))  # one row for each routing object, MOST_ROUTES at most
    dealt = routed.join(F.broadcast(parts), "route").withColumn("part", F.pmod(F.xxhash64("vector"), "parts")).repartition("route", "part").sortWithinPartitions("route", "part")

    def work(batches):
        task, made, held, key, size = TaskContext.get().partitionId() << 32, 0, [], None, 0

        def flush():
            nonlocal made, held, size
            x, lists = np.concatenate([v for v, _ in held]), [i for _, found in held for i in found]
            held, size = [], 0
            for at in halved(x, SUBTREE):
                yield to_batches({k: [v] for k, v in node(task | made, key[0], routes[key[0]], x[at], [lists[i] for i in at.tolist()]).items()}, NODE)
                made += 1

        for batch in batches:
            if not batch.num_rows:
                continue
            x, lists = matrix(batch.column("vector")), [np.array(i, np.int64) for i in batch.column("ids").to_pylist()]
            keys = list(zip(batch.column("route").to_pylist(), batch.column("part").to_pylist()))
            edges = [0, *(i for i in range(1, len(keys)) if keys[i] != keys[i - 1]), len(keys)]
            for a, b in zip(edges, edges[1:]):
                if held and (keys[a] != key or size >= 2 * HELD):
                    yield from flush()
                key = keys[a]
                held.append((x[a:b], lists[a:b]))
                size += b - a
        if held:
            yield from flush()

    return dealt.select("vector", "ids", "route", "part").mapInArrow(work, _NODE_DDL)


def inner_nodes(nodes: DataFrame) -> DataFrame:
    """route and part, and of about FAN subtrees each its number, centre, radius, parent distance and longest vector."""
    listed = nodes.select("route", "node", "centre", "radius", "parent", "longest")
    parts = listed.groupBy("route").agg(F.ceil(F.count("*") / FAN).alias("parts"))  # MOST_ROUTES rows at most
    dealt = listed.join(F.broadcast(parts), "route").withColumn("part", F.pmod(F.xxhash64("node"), "parts").cast("int"))
    return dealt.groupBy("route", "part").agg(F.collect_list(F.struct("node", "centre", "radius", "parent", "longest")).alias("subtrees"))


def search(row: dict, query_ids: np.ndarray, queries: np.ndarray, thresholds: np.ndarray, k: int):
    """The k best entries of a subtree that reach each query's threshold; also the number of products computed."""
    dims = queries.shape[1]
    shaped = lambda name, kind="<f8": np.frombuffer(row[name], kind)
    ids, owners, x, sizes = shaped("ids", "<i8"), shaped("owners", "<i8"), shaped("vectors").reshape(-1, dims), shaped("pages", np.int32)
    centres, radii, parents = shaped("centres").reshape(-1, dims), shaped("radii"), shaped("parents")
    begins = np.concatenate([[0], np.cumsum(sizes)])
    lengths = np.sqrt((queries**2).sum(axis=1))
    squares = (x**2).sum(axis=1)
    largest = lengths.max() * max(1.0, np.sqrt(squares.max()))
    slack = 1e-6 * (1 + largest)
    exact = largest < 2**52  # else floats only choose what whole numbers decide
    bounds = queries @ centres.T + lengths[:, None] * radii[None, :] + slack
    away = distances(queries, centres)
    order = np.argsort(-bounds, axis=1)
    limit = thresholds.astype(np.float64).copy()
    best_ids, best = [np.zeros(0, np.int64)] * len(queries), [np.zeros(0, np.int64)] * len(queries)
    open_, products = np.arange(len(queries)), 0
    for step in range(len(sizes)):
        page = order[open_, step]
        going = bounds[open_, page] >= limit[open_]
        open_, page = open_[going], page[going]
        if not len(open_):
            break
        for p in np.unique(page).tolist():
            asking = open_[page == p]
            gap = np.maximum(np.abs(away[asking, p][:, None] - parents[None, begins[p] : begins[p + 1]]) * (1 - 1e-9) - 1e-6, 0)
            may = (lengths[asking][:, None] ** 2 + squares[None, begins[p] : begins[p + 1]] - gap**2) / 2 + slack >= limit[asking][:, None]
            some = begins[p] + np.flatnonzero(may.any(axis=0))
            if not len(some):
                continue
            products += len(asking) * len(some)
            scores = queries[asking] @ x[some].T
            for i, q in enumerate(asking.tolist()):
                keep = some[scores[i] >= limit[q] - (0 if exact else slack)]
                if not len(keep):
                    continue
                found_scores = x[keep].astype(np.int64) @ queries[q].astype(np.int64)
                count = owners[keep + 1] - owners[keep]
                at = np.repeat(owners[keep] - (np.cumsum(count) - count), count) + np.arange(count.sum())
                found, found_scores = ids[at], np.repeat(found_scores, count)
                other = found != query_ids[q]
                all_ids, all_scores = np.concatenate([best_ids[q], found[other]]), np.concatenate([best[q], found_scores[other]])
                at = top_rows(all_scores, all_ids, k)
                best_ids[q], best[q] = all_ids[at], all_scores[at]
                if len(at) == k:
                    limit[q] = max(limit[q], float(best[q][-1]))
    return best_ids, best, products


def top_k(rows: DataFrame, is_query, k: int) -> DataFrame:
    """query_id, rank, vec_id and score (long) of each query's k highest products with the other rows."""
    spark = rows.sparkSession
    rows = stored(rows, "quantised")
    entries = stored(collapsed(rows, k), "entries")
    routes = routing_objects(entries, max(LEAST_ROUTES, min(MOST_ROUTES, entries.count() // ROUTED)))
    if not len(routes):
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score long")
    nodes = stored(build(entries, routes), "mtree")
    inner = stored(inner_nodes(nodes), "inner")
    lasts = inner.groupBy("route").agg(F.max("part").alias("last"))  # one row for each routing object
    dims = routes.shape[1]
    # One row for each routing object, MOST_ROUTES at most.
    held = {r["route"]: r["radius"] for r in nodes.groupBy("route").agg(F.max(F.col("parent") + F.col("radius")).alias("radius")).collect()}
    radius, filled = np.array([held.get(r, 0.0) for r in range(len(routes))]), np.array([r in held for r in range(len(routes))])

    def to_subtrees(first: bool):
        def work(batches):
            for batch in batches:
                for i in range(batch.num_rows):
                    row = batch.slice(i, 1).to_pylist()[0]
                    ids, keys, x, limits = unblocked(row, dims)
                    subtrees = row["subtrees"]
                    radii, parents, longest = (np.array([s[n] for s in subtrees]) for n in ("radius", "parent", "longest"))
                    length = np.sqrt((x**2).sum(axis=1))
                    slack = 1e-6 * (1 + length[:, None] * longest[None, :])
                    # The distance to the routing object is known for all its subtrees: a first bound without their centres.
                    away = np.sqrt(((x - routes[row["route"]]) ** 2).sum(axis=1))
                    gap = np.maximum(np.abs(away[:, None] - parents[None, :]) * (1 - 1e-9) - radii[None, :] - 1e-6, 0)
                    may = (length[:, None] ** 2 + longest[None, :] ** 2 - gap**2) / 2 + slack >= limits[:, None]
                    some = np.flatnonzero(may.any(axis=0))
                    if not len(some):
                        continue
                    centres = np.stack([np.frombuffer(subtrees[s]["centre"], "<f8") for s in some.tolist()])
                    bounds = x @ centres.T + length[:, None] * radii[None, some] + slack[:, some]
                    wanted = np.arange(len(some)) == bounds.argmax(axis=1)[:, None] if first else may[:, some] & (bounds >= limits[:, None])
                    for j, s in enumerate(some.tolist()):
                        at = np.flatnonzero(wanted[:, j])
                        if len(at):
                            yield block(subtrees[s]["node"], ids[at], keys[at], x[at], limits[at], VISIT)

        return work

    def answers(batches):
        for batch in batches:
            for i in range(batch.num_rows):
                row = batch.slice(i, 1).to_pylist()[0]
                query_ids, query_keys, x, limits = unblocked(row, dims)
                ids, scores, _ = search(row, query_ids, x, limits, k)
                sizes = [len(i) for i in ids]
                yield to_batches({"query_id": np.repeat(query_ids, sizes), "query_key": np.repeat(query_keys, sizes), "vec_id": np.concatenate(ids), "score": np.concatenate(scores)}, FOUND)

    def visit(queries: DataFrame, first: bool) -> DataFrame:
        blocks = queries.mapInArrow(to_balls(routes, radius, filled, QUERIES, BLOCK), f"route int, {_ASKED_DDL}")
        # To each inner node of the routing object on its own, so that one with most subtrees is no hot key.
        blocks = blocks.join(F.broadcast(lasts), "route").withColumn("part", F.explode(F.sequence(F.lit(0), "last"))).drop("last")
        visits = inner.join(blocks, ["route", "part"]).mapInArrow(to_subtrees(first), f"node long, {_ASKED_DDL}")
        return nodes.drop("route", "centre", "radius", "parent", "longest").join(visits, "node").mapInArrow(answers, "query_id long, query_key long, vec_id long, score long")

    queries = stored(asked(rows, is_query), "queries")
    near = best_of(visit(queries, True), k, "long").where(F.col("rank") == k)
    reached = stored(near.select(F.col("query_id").alias("vec_id"), "query_key", F.col("score").alias("threshold")), "thresholds")
    # The second round finds all that reach the threshold, what the first found included.
    return best_of(visit(queries.join(reached, ["vec_id", "query_key"], "left"), False), k, "long").drop("query_key")


def op5_mtree_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return top_k(quantised(spark.read.parquet(f"{sf_dir}/embeddings.parquet")), F.col("vec_id") % 50 == 0, 5)
