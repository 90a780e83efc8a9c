"""Surfaces over all customers, report lists with languages, comparisons, permissions, and small shared expressions."""

from __future__ import annotations

import json
from collections.abc import Iterator, Mapping, Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quarryline.functions.semantics import latest_by, tier_rank


def riskiest(rows: DataFrame, key: str, cap: int = 25) -> DataFrame:
    """The riskiest rows of all customers by tier, severity, likelihood, recency (``at``) and key: each task keeps ``cap`` rows, which are merged."""
    order = [F.desc(tier_rank()), F.desc("severity"), F.desc("likelihood"), F.desc_nulls_last("at"), F.asc(key), F.asc("customer_id")]
    return rows.orderBy(*order).limit(cap)


def surface(rows: DataFrame, key: str, kind: str, allowed: DataFrame, cap: int = 25) -> DataFrame:
    """One surface (kind, key, customer_id, tier, severity, likelihood, at, total) of the customers that are allowed (customer_id), and the number of all rows."""
    seen = rows.join(allowed.select("customer_id").distinct(), "customer_id", "left_semi").select(F.lit(kind).alias("kind"), F.col(key).cast("string").alias("key"), "customer_id", "tier", "severity", "likelihood", "at")
    return riskiest(seen, "key", cap).crossJoin(F.broadcast(seen.agg(F.count("*").alias("total"))))


def unreachable(asked: DataFrame, answered: DataFrame) -> DataFrame:
    """Customers that were asked but gave nothing: a surface lists them apart."""
    return asked.join(answered.select("customer_id").distinct(), "customer_id", "left_anti")


def report_languages(results: DataFrame, keys: Sequence[str], viewer: str, default: str) -> DataFrame:
    """Each report's languages and the one that is shown: the viewer's, else the default, else the first."""
    held = results.groupBy(*keys).agg(F.array_sort(F.collect_set("language")).alias("languages"))
    shown = F.when(F.array_contains("languages", viewer), viewer).when(F.array_contains("languages", default), default).otherwise(F.get("languages", F.lit(0)))
    return held.withColumn("shown", shown)


def compared(results: DataFrame, keys: Sequence[str], left: str, right: str) -> DataFrame:
    """A column of each of two models for every key that either has: tier, severity and whether the tiers differ."""
    side = lambda model, s: results.where(F.col("model") == model).select(*keys, F.col("tier").alias(f"tier_{s}"), F.col("severity").alias(f"severity_{s}"))
    both = side(left, "a").join(side(right, "b"), list(keys), "full")
    return both.withColumn("differs", ~F.col("tier_a").eqNullSafe(F.col("tier_b")))


def accessible_detailed(memberships: DataFrame, assignments: DataFrame, grants: DataFrame) -> DataFrame:
    """(account, customer_id, roles, permissions): by membership or eligible assignment, with what the roles (role, permission) permit."""
    every = memberships.select("account", "customer_id", "role").unionByName(assignments.select("account", "customer_id", "role")).distinct()
    told = every.join(grants, "role", "left").groupBy("account", "customer_id")
    joined = lambda c: F.array_join(F.array_sort(F.collect_set(c)), ",")
    return told.agg(joined("role").alias("roles"), joined("permission").alias("permissions"))


def model_of(subjects: DataFrame, own: DataFrame, common: DataFrame, catalog: DataFrame, fallback: str) -> DataFrame:
    """Each subject's model: its own, else the common one (one row or none), else the fallback; pairs that the catalog lacks don't count."""
    held = own.join(catalog.select("model"), "model", "left_semi").select("subject", F.col("model").alias("_own"))
    one = common.join(catalog.select("model"), "model", "left_semi").agg(F.max("model").alias("_common"))
    return subjects.join(held, "subject", "left").crossJoin(F.broadcast(one)).select("subject", F.coalesce("_own", "_common", F.lit(fallback)).alias("model"))


def qualified(customer: Column, *keys: Column) -> Column:
    """A member's key with its customer: ``customer:key``."""
    return F.concat_ws(":", customer.cast("string"), *(k.cast("string") for k in keys))


def substituted(template: Column, values: Mapping[str, Column]) -> Column:
    """A template with each ``{name}`` that is known replaced in one pass; others, and what a value brings in, stay. A null value counts as unknown."""
    parts = F.regexp_extract_all(template, F.lit(r"(\{\w+\}|[^{]+|\{)"), F.lit(1))
    table = F.create_map(*(x for k, v in values.items() for x in (F.lit("{" + k + "}"), v)))
    return F.array_join(F.transform(parts, lambda p: F.coalesce(F.try_element_at(table, p), p)), "")


def named(kind: Column, names: Mapping[str, str]) -> Column:
    """A display name, or the kind itself."""
    return F.coalesce(F.create_map(*(F.lit(x) for kv in names.items() for x in kv))[kind], kind)


def coerced_cap(text: Column, fallback: int) -> Column:
    """A whole number of zero or more from a setting's text; the fallback for anything else."""
    return F.coalesce(F.when(text.rlike(r"^\s*\d{1,9}\s*$"), F.trim(text).try_cast("int")), F.lit(fallback))


def has_key(details: Column, key: str) -> Column:
    """Whether a JSON object has a key, its value null or not."""
    return F.coalesce(F.array_contains(F.json_object_keys(details), key), F.lit(False))


def context(payload: Column, fields: Sequence[str]) -> Column:
    """The named texts of a JSON object as a struct; empty ones are null, and a struct without any is null."""
    held = F.from_json(payload, ", ".join(f"{f} string" for f in fields))
    clean = {f: F.nullif(F.trim(held[f]), F.lit("")) for f in fields}
    return F.when(F.coalesce(*clean.values()).isNotNull(), F.struct(*(v.alias(k) for k, v in clean.items())))


def first_by(rows: DataFrame, keys: Sequence[str], order: Sequence[Column]) -> DataFrame:
    """The first row of each key in an order: what is left of a sorted list after its repeats."""
    return latest_by(rows, keys, order)


def string_leaves(rows: DataFrame, key: str, payload: str) -> DataFrame:
    """(key, place, leaf): every text in a JSON value of any depth, in order; other scalars give none, malformed JSON neither.

    JSON of unknown depth has no built-in walk; each Arrow batch is walked where it lies, one value at a time.
    """

    def walk(value) -> Iterator[str]:
        stack = [value]
        while stack:
            v = stack.pop()
            if isinstance(v, str):
                yield v
            elif isinstance(v, (list, dict)):
                stack.extend(reversed(list(v.values() if isinstance(v, dict) else v)))

    @F.pandas_udf("array<string>")
    def leaves(texts: pd.Series) -> pd.Series:
        out = []
        for text in texts:
            try:
                out.append(list(walk(json.loads(text))) if text is not None else [])
            except ValueError:
                out.append([])
        return pd.Series(out)

    return rows.select(key, F.posexplode(leaves(payload)).alias("place", "leaf"))


def alert_search(alerts: DataFrame, *, indicator: str | None = None, severity: str | None = None, acknowledged: bool | None = None, since: str | None = None, before_id: int | None = None, limit: int = 50) -> DataFrame:
    """Newest alerts first; a filter that isn't given doesn't apply."""
    for column, value in (("indicator", indicator), ("severity", severity), ("acknowledged", acknowledged)):
        alerts = alerts if value is None else alerts.where(F.col(column) == value)
    alerts = alerts if since is None else alerts.where(F.col("at") >= F.lit(since).cast("timestamp_ntz"))
    alerts = alerts if before_id is None else alerts.where(F.col("id") < before_id)
    return alerts.orderBy(F.desc("id")).limit(min(200, max(1, limit)))


def alert_rows(found: DataFrame, severity: Column, at: Column) -> DataFrame:
    """Alerts as they are stored: indicator, key, n, severity, at."""
    return found.select("indicator", "key", "n", severity.alias("severity"), at.alias("at"))
