"""Row selection and ordering rules shared by the operators."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Ranks of the priority tiers and of the coverage states.
TIER_RANK = {"LOW": 0, "MEDIUM": 1, "HIGH": 2, "CRITICAL": 3}
COVERAGE_RANK = {"complete": 0, "partial": 1, "stale": 2, "unknown": 3}


def latest_by(df: DataFrame, keys: Sequence[str], order: Sequence[Column]) -> DataFrame:
    """The first row of each key in the given order; a rank of one is cut down within each task before the shuffle."""
    ranked = df.withColumn("_rank", F.row_number().over(Window.partitionBy(*keys).orderBy(*order)))
    return ranked.where("_rank = 1").drop("_rank")


def latest_baseline(df: DataFrame) -> DataFrame:
    return latest_by(df, ["sensor", "event_key"], [F.desc_nulls_last("received_at"), F.desc_nulls_last("baseline_version")])


def latest_within(df: DataFrame, start: str, end: str) -> DataFrame:
    """Of ``latest_baseline`` what can lie in a window: keys with any version in it, whose filter reaches the scan, and only their versions are ranked.

    The latest version of such a key may still lie outside: filter by the window after.
    """
    keys = df.where(within("event_time", start, end)).select("sensor", "event_key").distinct()
    return latest_baseline(df.join(keys, ["sensor", "event_key"], "left_semi"))


def canonical_story(df: DataFrame) -> DataFrame:
    return latest_by(df, ["story_id"], [F.desc_nulls_last("received_at"), F.desc_nulls_last("story_version")])


def live(df: DataFrame) -> DataFrame:
    """Results that are not superseded, and of each event the newest generation."""
    return latest_by(df.where("not superseded"), ["sensor", "event_key"], [F.desc("generation")])


def tier_rank(column: str = "tier") -> Column:
    return F.create_map(*(F.lit(x) for kv in TIER_RANK.items() for x in kv))[F.col(column)]


def within(column: str, start: str, end: str) -> Column:
    """The half-open window [start, end)."""
    return (F.col(column) >= F.lit(start).cast("timestamp_ntz")) & (F.col(column) < F.lit(end).cast("timestamp_ntz"))


def overlaps(start: str, end: str, low: str, high: str) -> Column:
    """Strict overlap of (start, end) columns with the window (low, high)."""
    return (F.col(start) < F.lit(high).cast("timestamp_ntz")) & (F.col(end) > F.lit(low).cast("timestamp_ntz"))


def after(cursor: Sequence[tuple[str, object, bool]]) -> Column:
    """Rows behind a keyset cursor: (column, value, descending) in the order of the sort, lexicographic; nulls come last in both directions."""
    terms = []
    for i, (name, value, descending) in enumerate(cursor):
        equal = [F.col(n).eqNullSafe(F.lit(v)) for n, v, _ in cursor[:i]]
        if value is None:
            continue  # nothing comes behind a null
        beyond = (F.col(name) < F.lit(value) if descending else F.col(name) > F.lit(value)) | F.col(name).isNull()
        terms.append(reduce(Column.__and__, [*equal, beyond]))
    return reduce(Column.__or__, terms) if terms else F.lit(False)


def page(df: DataFrame, order: Sequence[tuple[str, bool]], cursor: Sequence[object] | None, size: int) -> DataFrame:
    """One page of ``size`` rows behind the cursor; (column, descending) make a total order, nulls last."""
    if cursor is not None:
        df = df.where(after([(n, v, d) for (n, d), v in zip(order, cursor)]))
    return df.orderBy(*(F.desc_nulls_last(n) if d else F.asc_nulls_last(n) for n, d in order)).limit(size)


def encode_cursor(values: dict[str, Column]) -> Column:
    """An opaque text of a row's sort values: JSON in base64 for URLs, without padding; null values are left out."""
    told = F.to_json(F.struct(*(c.alias(n) for n, c in values.items())))
    return F.regexp_replace(F.translate(F.base64(told.cast("binary")), "+/\r\n", "-_"), "=+$", "")


def decode_cursor(text: Column, schema: str) -> Column:
    """The values of a cursor as a struct; null for what is no cursor, so that the first page is shown."""
    plain = F.translate(text, "-_", "+/")
    padded = F.rpad(plain, (F.ceil(F.length(plain) / 4) * 4).cast("int"), F.lit("="))
    told = F.when(text.rlike("^[A-Za-z0-9_-]+$") & (F.length(text) % 4 != 1), F.try_to_binary(padded, F.lit("base64")))
    return F.from_json(F.decode(told, "UTF-8"), schema, {"mode": "PERMISSIVE"})


def with_total(rows: DataFrame, order: Sequence[Column], size: int) -> DataFrame:
    """The first rows in an order, each with the number of all: a count joined as one row, so that no window gathers the table."""
    return rows.orderBy(*order).limit(size).crossJoin(F.broadcast(rows.agg(F.count("*").alias("total"))))


def admitted(rows: DataFrame, keys: Sequence[str], order: Sequence[Column], cap: int, name: str = "admitted") -> DataFrame:
    """rows with whether each is among the first ``cap`` of its key; ``order`` begins a total order of the columns that it names.

    The first rows are cut down within each task before the shuffle and joined back by their place's last row: one row a key, so that no
    key's rows are gathered.
    """
    sort = F.struct(*order)
    ranked = rows.select(*keys, sort.alias("_sort")).withColumn("_rank", F.row_number().over(Window.partitionBy(*keys).orderBy("_sort")))
    last = ranked.where(F.col("_rank") <= cap).groupBy(*keys).agg(F.max("_sort").alias("_last"))
    return rows.join(last, list(keys), "left").withColumn(name, F.coalesce(sort <= F.col("_last"), F.lit(False))).drop("_last")


def running_cap(df: DataFrame, keys: Sequence[str], order: Sequence[Column], cap: int) -> DataFrame:
    """The first ``cap`` rows of each key."""
    ranked = df.withColumn("_rank", F.row_number().over(Window.partitionBy(*keys).orderBy(*order)))
    return ranked.where(F.col("_rank") <= cap).drop("_rank")


def local_bucket(column: str, unit: str, zone: str) -> Column:
    """The local calendar day, week (Monday) or month of an instant in UTC, as a date."""
    return F.to_date(F.date_trunc(unit, F.from_utc_timestamp(F.col(column).cast("timestamp_ntz").cast("string"), zone)))
