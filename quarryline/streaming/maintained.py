"""Aggregates kept up to date by differences: the newest version of each key, and totals of buckets that follow a key when it moves.

State is two tables: ``latest`` (keys, version, bucket columns, ``gone``) and ``totals`` (bucket columns, n). A batch's newest version of a key is held against
the one that is there; if it wins, its old bucket loses one and its new bucket gains one. A withdrawal is a version without a bucket (``gone``), which stays so that an
older version that comes late doesn't bring the key back. What loses changes nothing, so that replays and any order of batches come to the same tables.

Only the keys of a batch and the buckets that they touch are changed; ``upsert`` is meant for ``foreachBatch``, both tables put in place by one commit of ``Snapshots``.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarryline.functions.storage import kept
from quarryline.sources.snapshots import Snapshots


def newest(changes: DataFrame, keys: Sequence[str], version: Sequence[str], buckets: Sequence[str]) -> DataFrame:
    """Of each key the change of the highest version; of equal versions a withdrawal, then the greatest bucket."""
    held = F.max(F.struct(*version, "gone", *buckets)).alias("m")
    return changes.groupBy(*keys).agg(held).select(*keys, "m.*")


def differences(latest: DataFrame | None, changes: DataFrame, keys: Sequence[str], version: Sequence[str], buckets: Sequence[str]) -> tuple[DataFrame, DataFrame]:
    """The winning changes, and (buckets, n) of what they add to and take from buckets."""
    new = newest(changes, keys, version, buckets)
    if latest is None:
        won = new
        moves = new.where("not gone").select(*buckets, F.lit(1).alias("n"))
    else:
        order = lambda side: F.struct(*(F.col(f"{side}.{c}") for c in (*version, "gone", *buckets)))
        both = new.alias("a").join(latest.alias("b"), list(keys), "left").where(F.col("b.gone").isNull() | (order("a") > order("b")))
        pick = lambda side: [F.col(f"{side}.{c}").alias(c) for c in buckets]
        won = both.select(*keys, *(F.col(f"a.{c}").alias(c) for c in (*version, "gone", *buckets)))
        moves = both.where("not a.gone").select(*pick("a"), F.lit(1).alias("n")).unionByName(both.where("b.gone = false").select(*pick("b"), F.lit(-1).alias("n")))
    return won, moves.groupBy(*buckets).agg(F.sum("n").cast("long").alias("n")).where("n <> 0")


def applied(latest: DataFrame | None, totals: DataFrame | None, changes: DataFrame, keys: Sequence[str], version: Sequence[str], buckets: Sequence[str]) -> dict[str, DataFrame]:
    """Both tables after a batch of changes (keys, version, gone, buckets)."""
    won, delta = differences(latest, changes, keys, version, buckets)
    won = kept(won, "won")
    if latest is None:
        return {"latest": won, "totals": delta}
    rest = latest.join(won.select(*keys), list(keys), "left_anti")
    summed = totals.unionByName(delta).groupBy(*buckets).agg(F.sum("n").alias("n")).where("n <> 0")
    return {"latest": rest.unionByName(won), "totals": summed}


def upsert(store: Snapshots, keys: Sequence[str], version: Sequence[str], buckets: Sequence[str]):
    """A function for ``foreachBatch``: a batch that fails leaves both tables as they were, one that is run again changes nothing."""

    def work(batch: DataFrame, number: int) -> None:
        batch = batch.persist()
        try:
            store.update(lambda held: applied(held.get("latest"), held.get("totals"), batch, keys, version, buckets))
        finally:
            batch.unpersist()

    return work


def recomputed(changes: DataFrame, keys: Sequence[str], version: Sequence[str], buckets: Sequence[str]) -> DataFrame:
    """The totals of all changes at once: what the maintained ones must equal."""
    return newest(changes, keys, version, buckets).where("not gone").groupBy(*buckets).agg(F.count("*").alias("n"))
