"""Retention over a declared graph of tables: rows that are too old, what hangs on them, and what nothing refers to any more.

A rule names a table, by which column and which of its customer's policies it ages (or not at all), the parents that its rows go with, and the tables
whose surviving rows keep it. Rules are closed over in topological order; every step is a join on keys, so no table is gathered. A customer without a policy, or
with a null number of days, keeps its rows; a null age is no reason to go, nor is a null key.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarryline.functions.storage import kept


@dataclass(frozen=True)
class Rule:
    """``age``: (column, policy column). ``parents`` and ``kept_by``: (table, keys that both have)."""

    table: str
    age: tuple[str, str] | None = None
    parents: tuple[tuple[str, tuple[str, ...]], ...] = ()
    kept_by: tuple[tuple[str, tuple[str, ...]], ...] = ()


def ordered(rules: Sequence[Rule]) -> list[Rule]:
    """Rules with every table behind those that it depends on."""
    left, done, out = list(rules), set(), []
    named = {r.table for r in rules}
    while left:
        free = [r for r in left if {t for t, _ in (*r.parents, *r.kept_by)} & named <= done]
        if not free:
            raise ValueError("the rules go in a circle: " + ", ".join(sorted(r.table for r in left)))
        out += free
        done |= {r.table for r in free}
        left = [r for r in left if r.table not in done]
    return out


def sweep(tables: dict[str, DataFrame], rules: Sequence[Rule], policies: DataFrame, now: str, customer: str = "customer_id") -> tuple[dict[str, DataFrame], DataFrame]:
    """The survivors of every table, and (table_name, customer, rows) of what goes; tables without a rule stay as they are.

    policies: customer and the numbers of days that rules name. All tables with an age have the customer's column; counts need it in all tables with a rule.
    """
    moment, left, gone = F.lit(now).cast("timestamp_ntz"), dict(tables), {}
    for rule in ordered(rules):
        rows = tables[rule.table]
        columns, marks = rows.columns, []
        if rule.age:
            column, days = rule.age
            rows = rows.join(policies.select(customer, F.col(days).alias("_days")), customer, "left")
            rows = rows.withColumn("_old", F.coalesce(F.col(column).cast("timestamp_ntz") < moment - F.make_dt_interval(days=F.col("_days").cast("int")), F.lit(False)))
            marks.append(F.col("_old"))
        for i, (parent, keys) in enumerate(rule.parents):
            if parent in gone:
                rows = rows.join(gone[parent].select(*keys).distinct().withColumn(f"_with_{i}", F.lit(True)), list(keys), "left")
                marks.append(F.coalesce(F.col(f"_with_{i}"), F.lit(False)))
        if rule.kept_by:
            held = F.lit(False)
            for i, (other, keys) in enumerate(rule.kept_by):
                rows = rows.join(left[other].select(*keys).distinct().withColumn(f"_held_{i}", F.lit(True)), list(keys), "left")
                held = held | F.coalesce(F.col(f"_held_{i}"), F.lit(False))
            marks.append(~held)
        told = F.lit(False)
        for m in marks:
            told = told | m
        marked = kept(rows.select(*columns, told.alias("_goes")), "swept")
        left[rule.table] = marked.where("not _goes").drop("_goes")
        gone[rule.table] = marked.where("_goes").drop("_goes")
    counts = None
    for name, rows in gone.items():
        part = rows.groupBy(customer).agg(F.count("*").alias("rows")).select(F.lit(name).alias("table_name"), customer, "rows")
        counts = part if counts is None else counts.unionByName(part)
    return left, counts
