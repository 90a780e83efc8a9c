"""Indicators of a vendor's repository of reports: which files are read, and what their place and the README above them say of actor and campaign.

A file is read by the first rule that its path matches, and not at all without one. Context comes from three places, the later the stronger: the repository's own
defaults, the README of the nearest folder that has any, named groups of the path. Rows that say the same of an indicator are one, that of the first
path; the same indicator under two campaigns is two. All joins are on equal folders or paths.
"""

from __future__ import annotations

import re
from collections.abc import Sequence
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quarryline.sources.feeds import free_text_all

CONTEXT = ("actor", "campaign", "malware_family", "report_url")


@dataclass(frozen=True)
class FileRule:
    """``parse``: ``list`` (a line each, ``#`` begins a remark) or ``text`` (prose, which tells its own kinds of indicator)."""

    pattern: str
    parse: str = "list"
    entity: str = "DOMAIN"
    hit_type: str | None = None
    classification: str | None = None
    deterministic: bool | None = None


@dataclass(frozen=True)
class Repository:
    """``context_pattern`` has groups named after CONTEXT (``(?<actor>..)``) or the url's template; ``readme`` maps CONTEXT to patterns in a README's text."""

    owner: str
    name: str
    ref: str
    files: Sequence[FileRule]
    hit_type: str | None = None
    classification: str | None = None
    deterministic: bool = True
    context: dict[str, str] = field(default_factory=dict)
    context_pattern: str | None = None
    url_template: str | None = None
    readme_pattern: str | None = None
    readme: dict[str, str] = field(default_factory=dict)


def _groups(pattern: str) -> re.Pattern:
    return re.compile(re.sub(r"\(\?<(?![=!])", "(?P<", pattern))


def _some(text: Column) -> Column:
    """A text without white space around it, or null."""
    return F.when(F.trim(text) != "", F.trim(text))


def _captured(content: Column, pattern: str) -> Column:
    """The group named ``value``, else the first, else the whole match."""
    known = _groups(pattern)
    return _some(F.regexp_extract(content, f"(?m){pattern}", known.groupindex.get("value", min(1, known.groups))))


def readmes(files: DataFrame, repository: Repository) -> DataFrame:
    """(folder, context) of READMEs that say anything; of several in a folder the last by path counts."""
    fields = F.struct(*((_captured(F.col("content"), repository.readme[c]) if c in repository.readme else F.lit(None).cast("string")).alias(c) for c in CONTEXT))
    rows = files.where(F.col("path").rlike(repository.readme_pattern)).select("path", F.regexp_replace("path", "/?[^/]*$", "").alias("folder"), fields.alias("context"))
    some = rows.where(F.coalesce(*(F.col(f"context.{c}") for c in CONTEXT)).isNotNull())
    return some.groupBy("folder").agg(F.max_by("context", "path").alias("context"))


def _nearest(paths: DataFrame, held: DataFrame) -> DataFrame:
    """(path, context) by the deepest folder above each path that has a context: an equi-join on the folders above it."""
    parts = F.split(F.col("path"), "/")
    folders = F.transform(F.sequence(F.lit(0), F.size(parts) - 1), lambda k: F.array_join(F.slice(parts, F.lit(1), k), "/"))
    above = paths.select("path", F.posexplode(folders).alias("depth", "folder")).join(held, "folder")
    return above.groupBy("path").agg(F.max_by("context", "depth").alias("readme"))


def with_context(files: DataFrame, chosen: DataFrame, repository: Repository) -> DataFrame:
    """chosen (path, ...) with CONTEXT."""
    paths = chosen.select("path").distinct()
    if repository.readme_pattern:
        paths = paths.join(_nearest(paths, readmes(files, repository)), "path", "left")
    else:
        paths = paths.withColumn("readme", F.lit(None).cast("struct<actor: string, campaign: string, malware_family: string, report_url: string>"))
    groups = _groups(repository.context_pattern).groupindex if repository.context_pattern else {}
    capture = {n: F.when(F.regexp_extract("path", repository.context_pattern, i) != "", F.regexp_extract("path", repository.context_pattern, i)) for n, i in groups.items()}
    none = F.lit(None).cast("string")
    of = lambda c: F.coalesce(capture.get(c, none), F.col(f"readme.{c}"), F.lit(repository.context.get(c)).cast("string")).alias(c)
    if repository.url_template:
        fixed = {"path": F.col("path"), "owner": F.lit(repository.owner), "repo": F.lit(repository.name), "ref": F.lit(repository.ref)}
        known = {**capture, **fixed}
        pieces = re.split(r"(\{\w+\})", repository.url_template)
        url = F.concat(*(F.coalesce(known.get(p[1:-1], none), F.lit(p)) if re.fullmatch(r"\{\w+\}", p) else F.lit(p) for p in pieces))
    else:
        url = F.col("readme.report_url")
    return chosen.join(paths.select("path", *(of(c) for c in CONTEXT[:3]), url.alias("report_url")), "path")


def collected(files: DataFrame, repository: Repository) -> DataFrame:
    """files (path, content) to (entity, indicator, hit_type, classification, CONTEXT, path, origin), each different row once."""
    rules = list(repository.files)
    number = F.coalesce(*(F.when(F.col("path").rlike(r.pattern), F.lit(i)) for i, r in enumerate(rules)))
    chosen = files.withColumn("rule", number).where("rule is not null")
    of = lambda values: F.get(F.array(*(F.lit(x).cast("string") for x in values)), F.col("rule"))
    allowed = [repository.deterministic if r.deterministic is None else r.deterministic for r in rules]
    hits = of([(r.hit_type or repository.hit_type) if ok else "soft_reputation" for r, ok in zip(rules, allowed)])
    chosen = chosen.select("path", "content", of([r.parse for r in rules]).alias("parse"), of([r.entity for r in rules]).alias("own"), hits.alias("hit_type"), of([r.classification or repository.classification for r in rules]).alias("classification"))
    split = F.transform(F.split("content", r"\r?\n"), F.trim)
    lines = chosen.where("parse = 'list'").select("path", F.col("own").alias("entity"), F.explode(split).alias("indicator")).where("indicator <> '' and not startswith(indicator, '#')")
    prose = free_text_all(chosen.where("parse = 'text'"), "path", "content").select("path", "entity", "indicator")
    rows = lines.unionByName(prose).distinct().join(chosen.select("path", "hit_type", "classification"), "path")
    rows = with_context(files, rows, repository)
    same = ["entity", "indicator", "hit_type", "classification", *CONTEXT]
    first = rows.groupBy(*same).agg(F.min("path").alias("path"))
    return first.withColumn("origin", F.concat(F.lit(f"{repository.owner}/{repository.name}@{repository.ref}:"), "path"))


def skipped(files: DataFrame, repository: Repository) -> DataFrame:
    """Paths that no rule reads."""
    read = F.lit(False)
    for rule in repository.files:
        read = read | F.col("path").rlike(rule.pattern)
    return files.where(~read).select("path")
