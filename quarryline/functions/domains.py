"""Registered domains by a list of public suffixes: a trie of reversed labels with wildcard and exception rules.

A list's text has one rule a line: ``co.nz``, ``*.ck`` (any one label there), ``!www.ck`` (not a suffix after all); ``//`` begins a remark. The longest
rule that matches wins, an exception before all; its suffix is one label shorter. Without a matching rule the last label is the suffix, or
there is none if ``strict``.
"""

from __future__ import annotations

import functools
import re
from collections.abc import Iterable

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rules that a worker may hold: the public list has some ten thousand.
MOST_RULES = 200_000
_HOST = re.compile(r"[a-z0-9_\u0080-\U0010ffff](?:[a-z0-9_\u0080-\U0010ffff-]*[a-z0-9_\u0080-\U0010ffff])?")
_END, _EXCEPT = 1, 2


class SuffixRules:
    """The trie: a node maps a label to a node, ``_END`` and ``_EXCEPT`` mark where a rule ends."""

    def __init__(self, lines: Iterable[str], private: bool = False):
        self.root: dict = {}
        inside = False
        for line in lines:
            if "===BEGIN PRIVATE" in line or "===END PRIVATE" in line:
                inside = "BEGIN" in line
            rule = line.split("//")[0].split()
            if not rule or inside and not private:
                continue
            name = rule[0].lower()
            labels = name.removeprefix("!").strip(".").split(".")
            for form in {tuple(labels), tuple(map(_ascii, labels))}:
                node = self.root
                for label in reversed(form):
                    node = node.setdefault(label, {})
                node[_EXCEPT if name.startswith("!") else _END] = True

    def suffix_size(self, labels: list[str], strict: bool = False) -> int:
        """How many labels at the end are the public suffix; 0 if there is none."""
        best, open_ = 0 if strict else 1, [self.root]
        for depth, label in enumerate(reversed(labels), 1):
            open_ = [n for node in open_ for n in (node.get(label), node.get("*")) if n is not None]
            if any(_EXCEPT in n for n in open_):
                return depth - 1
            if any(_END in n for n in open_):
                best = depth
            if not open_:
                break
        return best

    def registered(self, host: str | None, strict: bool = False) -> str | None:
        """The public suffix and one label more, in lower case; null for addresses, suffixes themselves and what is no host name."""
        labels = (host or "").lower().removesuffix(".").split(".")
        if len(labels) < 2 or labels[-1].isdigit() or not all(len(x) < 64 and _HOST.fullmatch(x) for x in labels):
            return None
        size = self.suffix_size(labels, strict)
        return ".".join(labels[-size - 1 :]) if 0 < size < len(labels) else None


def _ascii(label: str) -> str:
    try:
        return label.encode("idna").decode()
    except UnicodeError:
        return label


def read_rules(spark: SparkSession, path: str, private: bool = False) -> SuffixRules:
    """The rules of a file that Spark can read; refuses one with more than MOST_RULES lines."""
    lines = [r[0] for r in spark.read.text(path).limit(MOST_RULES + 1).collect()]
    if len(lines) > MOST_RULES:
        raise ValueError(f"{path} has more than {MOST_RULES} lines")
    return SuffixRules(lines, private)


def registered_by(spark: SparkSession, rules: SuffixRules, strict: bool = False):
    """A function from a column of hosts to their registered domains; each host of a batch is looked up once."""
    shared = spark.sparkContext.broadcast(rules)  # bounded by MOST_RULES

    @F.pandas_udf("string")
    def look(hosts: pd.Series) -> pd.Series:
        found = functools.cache(lambda h: shared.value.registered(h, strict))
        return hosts.map(lambda h: None if h is None else found(h)).astype(object)

    return look


def with_registered(rows: DataFrame, host: str, rules: SuffixRules, name: str = "registered", strict: bool = False) -> DataFrame:
    return rows.withColumn(name, registered_by(rows.sparkSession, rules, strict)(F.col(host)))


def host_of(entity: Column, value: Column) -> Column:
    """The host of a URL or domain in normal form; null for others."""
    return F.when(entity == "DOMAIN", value).when(entity == "URL", F.regexp_extract(value, r"^https?://([^/?#:\[\]]+)", 1))
