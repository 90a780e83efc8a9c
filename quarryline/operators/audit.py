"""Patterns in the audit log: each detector is a filter, a grouping and a threshold. Alerts are (indicator, key, n)."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quarryline.functions.semantics import within


def _alerts(rows: DataFrame, indicator: str, keys: list[str], count: Column, least: int) -> DataFrame:
    key = F.concat_ws(":", *(F.col(k).cast("string") for k in keys))
    found = rows.groupBy(*keys).agg(count.alias("n")).where(F.col("n") >= least)
    return found.select(F.lit(indicator).alias("indicator"), key.alias("key"), "n")


def denials(log: DataFrame, start: str, end: str, least: int = 5) -> DataFrame:
    """Denied sign-ins, by actor and by address."""
    rows = log.where((F.col("action") == "sign_in.denied") & within("logged_at", start, end))
    return _alerts(rows, "denials_actor", ["actor_id"], F.count("*"), least).unionByName(_alerts(rows, "denials_ip", ["ip"], F.count("*"), least))


def bridge_abuse(log: DataFrame, start: str, end: str, least: int = 10) -> DataFrame:
    return _alerts(log.where((F.col("action") == "bridge.connect") & within("logged_at", start, end)), "bridge_abuse", ["customer_id"], F.count("*"), least)


def multi_ip(log: DataFrame, start: str, end: str, least: int = 2) -> DataFrame:
    return _alerts(log.where((F.col("action") == "sign_in.success") & within("logged_at", start, end)), "multi_ip", ["actor_id"], F.countDistinct("ip"), least)


def session_mismatch(log: DataFrame, start: str, end: str, least: int = 2) -> DataFrame:
    return _alerts(log.where((F.col("action") == "session.ip_mismatch") & within("logged_at", start, end)), "session_mismatch", ["actor_id", "sid"], F.count("*"), least)


def all_alerts(log: DataFrame, start: str, end: str) -> DataFrame:
    return reduce(DataFrame.unionByName, (f(log, start, end) for f in (denials, bridge_abuse, multi_ip, session_mismatch)))


def fresh_alerts(alerts: DataFrame, earlier: DataFrame, now: str, minutes: int = 60) -> DataFrame:
    """Alerts whose indicator and key did not alert in the ``minutes`` before now; earlier: indicator, key, at."""
    since = F.lit(now).cast("timestamp_ntz") - F.make_dt_interval(mins=F.lit(minutes))
    return alerts.join(earlier.where(F.col("at") >= since).select("indicator", "key"), ["indicator", "key"], "left_anti")


#: Indicators that alert at once; all others are warnings.
SEVERE = ("suspended_account_sign_in", "admin_auth_denial_pattern", "bridge_scope_probing")


def severity(indicator: Column) -> Column:
    return F.when(indicator.isin(list(SEVERE)), "severe").otherwise("warning")


def search(log: DataFrame, *, action: str | None = None, actor: int | None = None, customer: int | None = None, address: int | None = None, session: int | None = None, prefix: str | None = None, start: str | None = None, end: str | None = None, before_id: int | None = None, limit: int = 50) -> DataFrame:
    """Newest first; a filter that isn't given doesn't apply; ``prefix`` is of the action; both ends of the time range are included."""
    tests = [F.col(c) == v for c, v in (("action", action), ("actor_id", actor), ("customer_id", customer), ("ip", address), ("sid", session)) if v is not None]
    tests += [F.col("action").startswith(prefix)] if prefix else []
    tests += [F.col("logged_at") >= F.lit(start).cast("timestamp_ntz")] if start else []
    tests += [F.col("logged_at") <= F.lit(end).cast("timestamp_ntz")] if end else []
    tests += [F.col("id") < before_id] if before_id is not None else []
    rows = log.where(reduce(Column.__and__, tests)) if tests else log
    return rows.orderBy(F.desc("id")).limit(min(200, max(1, limit))).select("id", "actor_id", "action", "ip")


def evidence_ids(log: DataFrame, keys: list[str]) -> DataFrame:
    """Each key's log ids in order, as text, and their number; meant for the rows behind an alert, whose number its detector bounds in time."""
    return log.groupBy(*keys).agg(F.array_join(F.transform(F.array_sort(F.collect_list("id")), lambda x: x.cast("string")), ",").alias("ids"), F.count("*").alias("n"))


def anonymised(log: DataFrame, customer: int, keys: list[str]) -> DataFrame:
    """A customer's rows without their address, and with the named keys of ``details`` (a JSON object of texts) replaced where they are there, null or not."""
    own = F.col("customer_id") == customer
    held = F.from_json("details", "map<string,string>")
    marked = F.transform_values(held, lambda k, v: F.when(k.isin(keys), F.lit("[redacted]")).otherwise(v))
    return log.withColumns({"ip": F.when(~own, F.col("ip")), "details": F.when(own & (F.size(held) > 0), F.to_json(marked)).otherwise(F.col("details"))})
