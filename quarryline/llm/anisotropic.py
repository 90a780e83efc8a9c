"""Approximate nearest neighbours by inner product with score-aware anisotropic quantisation.

A vector is a code of four bits for each pair of components. Codebooks and codes are chosen for a loss that
weighs the residual along the vector (which moves high inner products) more than the residual across it. A
query makes one table of 16 values for each code place; tables of two places are joined, so a byte of
code is one look-up.

Vectors lie in cells around centres of the sample; a cell is cut into groups by hash, and a task takes a few groups (a side) and a share of the
queries (a lane), so that neither a cell that holds most vectors nor one that all queries visit gathers in one task. The search has two
rounds. In the first a query scans the cell that promises most; the best ``keep`` of each group of codes are scored exactly on the original
vectors, in double precision, in the same task, and the k-th score that is found in all is the query's floor. In the second it scans the
cells whose covering radius lets them reach the floor, and every vector whose residual lets it reach the floor is scored exactly, so no
vector of the k best is missed, however many share a code or lie close together; ``keep`` sets only how tight the first floor is. Where
vectors form no clusters, radii exclude no cell, and each query scans all codes.

Equal vectors are indexed once, with their vec_ids; of these the ``k + 1`` smallest can be in an answer.
Codebooks and centres are fitted on a bounded sample (``SAMPLE`` vectors by hash); every vector is indexed.

Defined results: vectors that are null, zero or hold null or non-finite components, and vectors of another
length than the commonest, take no part; repeated rows count each as candidates, but a repeated query row is asked once; a query id with
several vectors asks with each, ranked apart; no row of a query's own id is a candidate; equal scores go to the smaller vec_id; extra
columns are ignored; an empty table gives no rows.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quarryline.llm.common import stored, to_batches
from quarryline.llm.vectors import asked, best_of, collapsed, distances, matrix, to_balls, top_rows, unblocked, valid_vectors

#: Bounds: rows to fit on, queries of a block, vectors of a group, and cells (one for GROUP vectors, from LEAST to MOST).
SAMPLE, QUERIES, GROUP, LEAST_CELLS, MOST_CELLS = 4096, 512, 16384, 12, 1024
#: A join key holds at most about so many groups of a cell (a side) and queries that visit them (a lane); tasks of a round at most.
SIDE, LANE, TASKS = 4, 1 << 14, 1 << 15
GROUPS = pa.schema([("cell", pa.int32()), ("side", pa.int32()), ("radius", pa.float64()), ("ids", pa.binary()), ("owners", pa.binary()), ("vectors", pa.binary()), ("codes", pa.binary()), ("residuals", pa.binary())])
BLOCKS = pa.schema([("cell", pa.int32()), ("query_ids", pa.binary()), ("query_keys", pa.binary()), ("queries", pa.binary()), ("thresholds", pa.binary())])
FOUND = pa.schema([("query_id", pa.int64()), ("query_key", pa.int64()), ("vec_id", pa.int64()), ("score", pa.float64())])


class Quantiser:
    """Codebooks (places x 16 x width) and the weight of the parallel residual."""

    def __init__(self, books: np.ndarray, eta: float):
        self.books, self.eta = books, eta
        self.places, _, self.width = books.shape

    def pad(self, x: np.ndarray) -> np.ndarray:
        return np.pad(x, ((0, 0), (0, self.places * self.width - x.shape[1])))

    def encode(self, x: np.ndarray, rounds: int = 2) -> np.ndarray:
        """Codes by coordinate descent on |r|^2 + (eta - 1) (r . x/|x|)^2, from the plain nearest ones."""
        x = self.pad(x)
        unit = x / np.sqrt((x**2).sum(axis=1, keepdims=True))
        parts, units = x.reshape(len(x), self.places, self.width), unit.reshape(len(x), self.places, self.width)
        codes, along = np.zeros((len(x), self.places), np.uint8), np.zeros((len(x), self.places))
        square = np.zeros((self.places, len(x), 16), np.float32)
        parallel = np.zeros((self.places, len(x), 16), np.float32)
        for m in range(self.places):
            residual = parts[:, m, None, :] - self.books[m][None]
            square[m], parallel[m] = (residual**2).sum(axis=2), (residual * units[:, m, None, :]).sum(axis=2)
            codes[:, m] = square[m].argmin(axis=1)
            along[:, m] = parallel[m][np.arange(len(x)), codes[:, m]]
        total = along.sum(axis=1)
        for _ in range(rounds):
            for m in range(self.places):
                rest = total - along[:, m]
                loss = square[m] + (self.eta - 1) * (rest[:, None] + parallel[m]) ** 2
                codes[:, m] = loss.argmin(axis=1)
                along[:, m] = parallel[m][np.arange(len(x)), codes[:, m]]
                total = rest + along[:, m]
        return codes

    def residuals(self, x: np.ndarray, codes: np.ndarray) -> np.ndarray:
        """Of each vector x its length, the share of x in what its code stands for, and the length of the part across x."""
        x = self.pad(x)
        meant = self.books[np.arange(self.places), codes].reshape(len(x), -1)
        square = (x**2).sum(axis=1)
        along = (meant * x).sum(axis=1) / square
        return np.stack([np.sqrt(square), along, np.sqrt(((meant - along[:, None] * x) ** 2).sum(axis=1))])


def fit(x: np.ndarray, width: int = 2, eta: float = 4.0, rounds: int = 12) -> Quantiser:
    """Codebooks by alternation: codes under the anisotropic loss, then each book by weighted least squares."""
    places = -(-x.shape[1] // width)
    padded = np.pad(x, ((0, 0), (0, places * width - x.shape[1])))
    unit = (padded / np.sqrt((padded**2).sum(axis=1, keepdims=True))).reshape(len(x), places, width)
    parts = padded.reshape(len(x), places, width)
    rng = np.random.default_rng(3)
    books = np.stack([parts[rng.choice(len(x), 16, replace=len(x) < 16), m] for m in range(places)])
    found = Quantiser(books, eta)
    for r in range(rounds):
        codes = found.encode(x, 1 if r >= rounds // 2 else 0)
        books = found.books.copy()
        for m in range(places):
            # Within a place the weight is I + (eta - 1) u u^T of the place's share of the direction.
            for c in range(16):
                at = np.flatnonzero(codes[:, m] == c)
                if len(at):
                    u = unit[at, m]
                    weight = np.eye(width)[None] + (eta - 1) * u[:, :, None] * u[:, None, :]
                    books[m, c] = np.linalg.solve(weight.sum(axis=0), (weight @ parts[at, m][:, :, None]).sum(axis=0)[:, 0])
        found = Quantiser(books, eta)
    return found


def packed(codes: np.ndarray) -> np.ndarray:
    """Two places to a byte, stored place by place."""
    if codes.shape[1] % 2:
        codes = np.pad(codes, ((0, 0), (0, 1)))
    return np.ascontiguousarray((codes[:, 0::2] | (codes[:, 1::2] << 4)).T)


def tables(query: np.ndarray, q: Quantiser) -> tuple[np.ndarray, float, float]:
    """A query's values for each byte of code, as whole numbers of 0 to 255 on one scale; what one and none of them stand for."""
    padded = np.pad(query, (0, q.places * q.width - len(query))).reshape(q.places, 1, q.width)
    table = (q.books * padded).sum(axis=2)
    if q.places % 2:
        table = np.vstack([table, np.zeros((1, 16))])
    pairs = (table[0::2][:, None, :] + table[1::2][:, :, None]).reshape(-1, 256)
    low = pairs.min(axis=1, keepdims=True)
    scale = max(1e-30, float((pairs - low).max()))
    whole = ((pairs - low) * (255 / scale)).round().astype(np.uint16 if len(pairs) <= 257 else np.uint32)
    return whole, scale / 255, float(low.sum())


def scan(query_ids, queries, floors, ids, owners, x, codes, residuals, q: Quantiser, k: int, keep: int):
    """The k best rows of a group for each query: four-bit scan, exact scores of all that can reach its floor; without one, the best ``keep`` by their codes (or all, if fewer) give it.

    ``ids`` are the rows' vec_ids by vector, ascending; ``owners`` the vectors' positions in them (one more than vectors).
    """
    out_ids, out_scores = [], []
    length, along, across = residuals
    largest = float(length.max())
    first, last = ids[owners[:-1]], ids[owners[1:] - 1]
    lone = first == last
    along4, across4, odd = along.astype(np.float32), across.astype(np.float32), np.flatnonzero(along <= 0)
    most_along, most_across = float(np.abs(along).max()), float(across.max())
    for query_id, query, floor in zip(query_ids.tolist(), queries, floors.tolist()):
        table, step, base = tables(query, q)
        about = table[0].take(codes[0])
        for m in range(1, len(codes)):
            about += table[m].take(codes[m])
        # Vectors that only the query's own rows hold take no part.
        own = np.flatnonzero(lone & (first == query_id))
        best = min(keep, len(about) - len(own))
        if floor == -np.inf and best >= k:
            rated = about.astype(np.float64)
            rated[own] = -np.inf
            at = np.argpartition(rated, len(rated) - best)[len(rated) - best :]
            sure = (x[at] * query).sum(axis=1)
            floor = float(np.partition(sure, best - k)[best - k])
        if floor > -np.inf:
            # What a code stands for is along * x and a part across x, so its product is along * score, give or take
            # across * (the query's length across x); tables round by half a step a place, sums by far less than 1e-9.
            size = float((query**2).sum())
            slack = base + 0.5 * step * len(table) + 1e-9 * size**0.5 * largest
            # A first test with the query's whole length in single precision, then the exact one on what it leaves.
            scale, width = floor / step, size**0.5 / step
            margin = slack / step + 1e-5 * (abs(scale) * most_along + width * most_across + len(table) * 255)
            if abs(scale) * most_along + width * most_across + abs(margin) < 1e30:
                at = np.union1d(np.flatnonzero(about >= along4 * np.float32(scale) - across4 * np.float32(width) - np.float32(margin)), odd)
            else:
                at = np.arange(len(about))
            wide = np.sqrt(np.maximum(0, size - (max(0.0, floor) / length[at]) ** 2))
            at = at[~(about[at] * step + slack < along[at] * floor - across[at] * wide) | (along[at] <= 0)]
            at = at[~np.isin(at, own)] if len(own) else at
        else:  # fewer than k candidates: each is an answer
            at = np.setdiff1d(np.arange(len(about)), own)
        exact = (x[at] * query).sum(axis=1)
        enough = exact >= floor - 1e-9 * float((query**2).sum()) ** 0.5 * largest
        at, exact = at[enough], exact[enough]
        if len(exact) > k:
            held = np.flatnonzero(exact >= np.partition(exact, len(exact) - k)[len(exact) - k])
            at, exact = at[held], exact[held]
        count = owners[at + 1] - owners[at]
        rows = np.repeat(owners[at] - (np.cumsum(count) - count), count) + np.arange(count.sum())
        found, scores = ids[rows], np.repeat(exact, count)
        other = found != query_id
        found, scores = found[other], scores[other]
        best = top_rows(scores, found, k)
        out_ids.append(found[best])
        out_scores.append(scores[best])
    return out_ids, out_scores


def centres_of(sample: np.ndarray, count: int, rounds: int = 8) -> np.ndarray:
    """Centres of cells: k-means on the sample, from different vectors of it."""
    different = np.unique(sample, axis=0)
    centres = different[np.random.default_rng(4).permutation(len(different))[:count]]
    for _ in range(rounds):
        near = distances(sample, centres).argmin(axis=1)
        sums, sizes = np.zeros_like(centres), np.bincount(near, minlength=len(centres))
        np.add.at(sums, near, sample)
        centres = np.where(sizes[:, None] > 0, sums / np.maximum(sizes, 1)[:, None], centres)
    return centres


def nearest(table: DataFrame, is_query, k: int, keep: int = 96) -> DataFrame:
    """query_id, rank, vec_id and score (inner product in double precision) of each query's k nearest."""
    spark, keep = table.sparkSession, max(k, keep)
    valid = stored(valid_vectors(table, zero=False), "vectors")
    rows = stored(collapsed(valid, k), "vectors")
    sample = np.array([r["vector"] for r in rows.orderBy(F.xxhash64("vector"), "vector").limit(SAMPLE).select("vector").collect()], np.float64)
    if not len(sample):
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    quantiser = fit(sample)
    dims = sample.shape[1]
    centres = centres_of(sample, max(LEAST_CELLS, min(MOST_CELLS, rows.count() // GROUP)))

    def place(batches):
        for batch in batches:
            if batch.num_rows:
                x = matrix(batch.column("vector"))
                cell = np.concatenate([distances(x[a : a + 1024], centres).argmin(axis=1) for a in range(0, len(x), 1024)])
                yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(cell.astype(np.int32))], ["vector", "ids", "cell"])

    placed = stored(rows.select("vector", "ids").mapInArrow(place, "vector array<double>, ids array<long>, cell int"), "placed")
    parts = placed.groupBy("cell").agg(F.ceil(F.count("*") / GROUP).alias("parts"))  # one row for each cell, MOST_CELLS at most
    dealt = placed.join(F.broadcast(parts), "cell").withColumn("part", F.pmod(F.xxhash64("vector"), "parts")).repartition("cell", "part").sortWithinPartitions("cell", "part")

    def index(batches):
        """Codes and vectors of each part of a cell, in rows of about GROUP vectors."""
        held, key, size = [], None, 0

        def made():
            nonlocal held, size
            ids, count, x = (np.concatenate(p) for p in zip(*held))
            owners, held, size = np.append(0, np.cumsum(count)), [], 0
            codes = np.concatenate([quantiser.encode(x[b : b + 1024]) for b in range(0, len(x), 1024)])
            residuals = np.concatenate([quantiser.residuals(x[b : b + 1024], codes[b : b + 1024]) for b in range(0, len(x), 1024)], axis=1)
            radius = float(np.sqrt(((x - centres[key[0]]) ** 2).sum(axis=1)).max())
            return to_batches({"cell": [key[0]], "side": [key[1] // SIDE], "radius": [radius], **{n: [r.tobytes()] for n, r in zip(GROUPS.names[3:], (ids, owners, x, packed(codes), residuals))}}, GROUPS)

        for batch in batches:
            if not batch.num_rows:
                continue
            lists, x = batch.column("ids"), matrix(batch.column("vector"))
            ids, count = np.asarray(lists.flatten(), "<i8"), np.asarray(pa.compute.list_value_length(lists), "<i8")
            stops = np.append(0, np.cumsum(count))
            keys = list(zip(batch.column("cell").to_pylist(), batch.column("part").to_pylist()))
            edges = [0, *(i for i in range(1, len(keys)) if keys[i] != keys[i - 1]), len(keys)]
            for a, b in zip(edges, edges[1:]):
                if held and (keys[a] != key or size >= 2 * GROUP):
                    yield made()
                key = keys[a]
                held.append((ids[stops[a] : stops[b]], count[a:b], x[a:b]))
                size += b - a
        if held:
            yield made()

    made_of = "cell int, side int, radius double, ids binary, owners binary, vectors binary, codes binary, residuals binary"
    indexed = stored(dealt.select("vector", "ids", "cell", "part").mapInArrow(index, made_of), "codes")
    # One row for each cell, MOST_CELLS at most.
    sides = stored(indexed.groupBy("cell").agg(F.max("radius").alias("radius"), F.max("side").alias("last")), "sides")
    held = {r["cell"]: r for r in sides.collect()}
    radius, filled = np.array([held[c]["radius"] if c in held else 0.0 for c in range(len(centres))]), np.array([c in held for c in range(len(centres))])

    def answers(batches):
        for batch in batches:
            for i in range(batch.num_rows):
                row = batch.slice(i, 1).to_pylist()[0]
                query_ids, query_keys, queries, floors = unblocked(row, dims)
                ids, owners, x = np.frombuffer(row["ids"], "<i8"), np.frombuffer(row["owners"], "<i8"), np.frombuffer(row["vectors"]).reshape(-1, dims)
                codes, residuals = np.frombuffer(row["codes"], np.uint8).reshape(-1, len(x)), np.frombuffer(row["residuals"]).reshape(3, -1)
                found, scores = scan(query_ids, queries, floors, ids, owners, x, codes, residuals, quantiser, k, keep)
                sizes = [len(f) for f in found]
                yield to_batches({"query_id": np.repeat(query_ids, sizes), "query_key": np.repeat(query_keys, sizes), "vec_id": np.concatenate(found), "score": np.concatenate(scores)}, FOUND)

    questions = stored(asked(valid, is_query), "queries")
    lanes = questions.count() // LANE + 1
    keys = lanes * sum(r["last"] + 1 for r in held.values())
    # Bytes don't tell a key's work, so tasks are dealt by key and not merged by size.
    tasks = min(TASKS, max(2 * keys, int(spark.conf.get("spark.sql.shuffle.partitions"))))

    def visit(queries: DataFrame) -> DataFrame:
        blocks = queries.mapInArrow(to_balls(centres, radius, filled, QUERIES, BLOCKS), "cell int, query_ids binary, query_keys binary, queries binary, thresholds binary")
        blocks = blocks.join(F.broadcast(sides.select("cell", "last")), "cell").withColumn("lane", F.pmod(F.xxhash64("query_ids", "query_keys"), F.lit(lanes)).cast("int"))
        blocks = blocks.select(*BLOCKS.names, "lane", F.explode(F.sequence(F.lit(0), "last")).alias("side"))
        groups = indexed.drop("radius").withColumn("lane", F.explode(F.sequence(F.lit(0), F.lit(lanes - 1))))
        at = ["cell", "side", "lane"]
        return groups.repartition(tasks, *at).join(blocks.repartition(tasks, *at), at).mapInArrow(answers, "query_id long, query_key long, vec_id long, score double")

    near = best_of(visit(questions), k, "double").where(F.col("rank") == k)
    floors = stored(near.select(F.col("query_id").alias("vec_id"), "query_key", F.col("score").alias("threshold")), "floors")
    # The second round finds all that reach the floor, what the first found included.
    return best_of(visit(questions.join(floors, ["vec_id", "query_key"], "left")), k, "double").drop("query_key")


def op10_anisotropic_ann(spark: SparkSession, sf_dir: str) -> DataFrame:
    return nearest(spark.read.parquet(f"{sf_dir}/embeddings.parquet"), F.col("vec_id") % 20 == 0, 20)
