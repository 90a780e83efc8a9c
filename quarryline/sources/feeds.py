"""Parsers of threat-intelligence and vulnerability files, as expressions over a DataFrame of lines (column ``value``).

Read a file with ``spark.read.text``; each line is parsed where it lies. Null and malformed lines give no rows.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quarryline.functions.network import cidr, ip_hex
from quarryline.operators.intel import HEX, IPV4

URL = r"[hH][tT][tT][pP][sS]?://[^\s\"\x27<>]+"
CVE = r"^CVE-\d{4}-\d{4,}$"


def content(lines: DataFrame, comments: Sequence[str] = ("#",)) -> DataFrame:
    """Trimmed lines that are neither empty nor comments."""
    line = F.regexp_replace("value", r"^\s+|\s+$", "")
    rows = lines.select(line.alias("line")).where("line <> ''")
    for prefix in comments:
        rows = rows.where(~F.col("line").startswith(prefix))
    return rows


def refang(text: Column) -> Column:
    """hxxp to http, [.] and (.) to a point, [at] to @."""
    return F.regexp_replace(F.regexp_replace(F.regexp_replace(text, "(?i)hxxp", "http"), r"\[\.\]|\(\.\)", "."), r"(?i)\[at\]", "@")


def generic_list(lines: DataFrame, comments: Sequence[str] = ("#", ";"), fanged: bool = True) -> DataFrame:
    """One indicator a line; an address blocklist is this with ``#`` alone."""
    return content(lines, comments).select((F.col("line") if fanged else refang(F.col("line"))).alias("indicator"))


def columns(lines: DataFrame, n: int, comments: Sequence[str] = ("#",), delimiter: str = ",") -> DataFrame:
    """Quoted comma-separated lines as columns c0 to c<n-1>; missing ones are null, empty ones empty."""
    schema = ", ".join(f"c{i} string" for i in range(n))
    return content(lines, comments).select(F.from_csv("line", schema, {"sep": delimiter, "mode": "PERMISSIVE", "nullValue": "\u0001"}).alias("r")).select("r.*")


def url_rows(lines: DataFrame) -> DataFrame:
    """(entity, indicator): the third field as URL, and its host as domain unless that is an address."""
    urls = columns(lines, 4).where("c2 <> ''").select(F.col("c2").alias("url"))
    host = F.lower(F.regexp_extract("url", r"^[A-Za-z]+://(?:[^/@]*@)?(\[[^\]]*\]|[^/:?#]+)", 1))
    both = F.array(F.struct(F.lit("URL").alias("entity"), F.col("url").alias("indicator")), F.struct(F.lit("DOMAIN").alias("entity"), host.alias("indicator")))
    rows = urls.select(F.inline(both))
    address = F.col("indicator").rlike(f"^{IPV4}$") | F.col("indicator").startswith("[") | (F.col("indicator") == "")
    return rows.where((F.col("entity") == "URL") | ~address).distinct()


def payload_hashes(lines: DataFrame) -> DataFrame:
    """The fourth and fifth field (MD5, SHA-256) where they are not empty."""
    rows = columns(lines, 6).where("c4 is not null")
    return rows.select(F.explode(F.array("c3", "c4")).alias("indicator")).where("indicator <> ''")


def drop_ranges(lines: DataFrame) -> DataFrame:
    """``range ; reference`` lines: the first word before ``;`` if it holds a slash."""
    first = F.split(F.trim(F.split_part("line", F.lit(";"), F.lit(1))), r"\s+")[0]
    return content(lines, ("#", ";")).select(first.alias("cidr")).where(F.contains("cidr", F.lit("/")))


def drop_ranges_json(lines: DataFrame) -> DataFrame:
    """One JSON object a line: its ``cidr``; metadata and malformed lines are passed over."""
    return content(lines, ("#", ";")).select(F.trim(F.get_json_object("line", "$.cidr")).alias("cidr")).where(F.contains("cidr", F.lit("/")))


def typed_columns(lines: DataFrame, n: int, value: int, kind: int, kinds: Mapping[str, str], keep: Mapping[int, Sequence[str]] | None = None) -> DataFrame:
    """(entity, indicator) of tables whose ``kind`` column names the entity; ``keep`` lists allowed values of other columns."""
    rows = columns(lines, n)
    for column, allowed in (keep or {}).items():
        rows = rows.where(F.col(f"c{column}").isin(list(allowed)))
    entity = F.create_map(*(F.lit(x) for kv in kinds.items() for x in kv))[F.lower(f"c{kind}")]
    return rows.select(entity.alias("entity"), F.trim(f"c{value}").alias("indicator")).where("entity is not null and indicator <> ''").distinct()


def free_text(rows: DataFrame, key: str, text: str) -> DataFrame:
    """Different (key, entity, indicator): URLs, then hashes, then addresses; what one pass finds the next doesn't see."""
    passes = (("URL", URL), ("HASH", HEX), ("IP", IPV4))
    left, found = F.col(text), []
    for entity, pattern in passes:
        hits = F.transform(F.regexp_extract_all(left, F.lit(pattern), F.lit(0)), lambda x: F.regexp_replace(x, r"[.,;:!?'\")\]}>]+$", ""))
        value = (lambda x: x) if entity == "URL" else F.lower
        found.append(F.transform(hits, lambda x: F.struct(F.lit(entity).alias("entity"), value(x).alias("indicator"))))  # noqa: B023
        left = F.regexp_replace(left, pattern, " ")
    return rows.select(key, F.inline(F.array_distinct(F.concat(*found))))


def warning_lists(lists: DataFrame) -> DataFrame:
    """(name, cidr, ip) of JSON lists (column ``value``): ranges of type cidr, single addresses of type string or hostname, of both kinds; the name is their classification."""
    parsed = lists.select(F.from_json("value", "name string, type string, list array<string>").alias("l")).select("l.name", "l.type", F.explode("l.list").alias("item"))
    address = ip_hex(F.col("item")).isNotNull()
    rows = parsed.select("name", F.when((F.col("type") == "cidr") & cidr(F.col("item")).isNotNull(), F.col("item")).alias("cidr"), F.when(F.col("type").isin("string", "hostname") & address, F.col("item")).alias("ip"))
    return rows.where("cidr is not null or ip is not null")


def unparseable(lines: DataFrame, parsed: DataFrame) -> DataFrame:
    """One row: whether there are data lines but nothing was parsed."""
    some = content(lines, ("#", ";")).limit(1).agg(F.count("*").alias("data"))
    return some.crossJoin(parsed.limit(1).agg(F.count("*").alias("rows"))).select(((F.col("data") > 0) & (F.col("rows") == 0)).alias("unparseable"))


def unparseable_by(lines: DataFrame, parsed: DataFrame, feed: str) -> DataFrame:
    """(feed, unparseable) of many feeds at once: whether one has data lines but none was parsed."""
    some = lines.where(F.regexp_replace("value", r"^\s+|\s+$", "").rlike("^[^#;]"))
    data = some.groupBy(feed).agg(F.count("*").alias("_lines"))
    rows = parsed.groupBy(feed).agg(F.count("*").alias("_rows"))
    return data.join(rows, feed, "left").select(feed, F.col("_rows").isNull().alias("unparseable"))


def exploited(files: DataFrame) -> DataFrame:
    """cve and date added of catalogs of exploited vulnerabilities (JSON, column ``value``)."""
    one = F.from_json("value", "vulnerabilities array<struct<cveID: string, dateAdded: string>>")
    rows = files.select(F.explode(one["vulnerabilities"]).alias("v")).select(F.upper(F.trim("v.cveID")).alias("cve"), F.try_to_date("v.dateAdded", "yyyy-MM-dd").alias("added"))
    return rows.where(F.col("cve").rlike(CVE))


def exploit_scores(lines: DataFrame) -> DataFrame:
    """cve and score of ``cve,score,percentile`` lines; the header and scores that are no finite number give no rows."""
    rows = columns(lines, 3).select(F.upper(F.trim("c0")).alias("cve"), F.expr("try_cast(c1 as double)").alias("score"))
    return rows.where(F.col("cve").rlike(CVE) & F.col("score").isNotNull() & ~F.isnan("score") & (F.abs("score") < float("inf")))


def replace_source(snapshot: DataFrame, source: str, rows: DataFrame) -> DataFrame:
    """The snapshot with all rows of one source replaced; a negative row has no hit type."""
    hit = F.when(~F.col("negative"), F.col("hit_type"))
    new = rows.select(F.lit(source).alias("source"), "indicator", "negative", hit.alias("hit_type"))
    return snapshot.where(~F.col("source").eqNullSafe(F.lit(source))).unionByName(new)


#: Hexadecimal digits of a row's digest that the levels of a fingerprint go by; 16 million leaves a key.
LEVELS = (6, 4, 2, 0)


def fingerprint(rows: DataFrame, keys: Sequence[str], row: Column) -> DataFrame:
    """For each key the number of its rows and a SHA-256 of its bag of rows: equal for equal bags, in any order, over any number of partitions.

    Equal rows are counted before the shuffle. A row's digest says which leaf it is in; a leaf's hash is that of its sorted digests with their
    counts, an inner one that of its sorted children, 256 at most. A null row is one of its own.
    """
    ones = rows.select(*keys, F.coalesce(F.sha2(row, 256), F.lit("")).alias("d")).groupBy(*keys, "d").agg(F.count("*").alias("n"))
    level = ones.select(*keys, F.col("d").alias("p"), F.col("n").cast("string").alias("h"), "n")
    for length in LEVELS:
        told = F.array_join(F.array_sort(F.collect_list(F.concat_ws(":", "p", "h"))), ",")
        level = level.groupBy(*keys, F.substring("p", 1, length).alias("q")).agg(F.sha2(told, 256).alias("h"), F.sum("n").alias("n")).withColumnRenamed("q", "p")
    return level.select(*keys, "n", F.col("h").alias("digest"))


#: The parts that are read of a page of the vulnerability database.
METRICS = ("cvssMetricV40", "cvssMetricV31", "cvssMetricV30", "cvssMetricV2")
_METRIC = "array<struct<type: string, cvssData: struct<baseScore: double, vectorString: string>>>"
PAGE = f"""vulnerabilities array<struct<cve: struct<id: string, published: string, descriptions: array<struct<lang: string, value: string>>,
    metrics: struct<{", ".join(f"{m}: {_METRIC}" for m in METRICS)}>, weaknesses: array<struct<description: array<struct<value: string>>>>>>>"""


def vulnerability_pages(pages: DataFrame) -> DataFrame:
    """cve, published (UTC text), score, vector, description and weaknesses of JSON pages (column ``value``).

    The newest version's score counts, a primary one first; the first English description, else the first; weaknesses in
    their order, each once. Records without a valid id give no rows, those without scores a row without a score.
    """
    cve = pages.select(F.explode(F.from_json("value", PAGE)["vulnerabilities"]).alias("v")).select("v.cve.*")
    usable = lambda m: m["cvssData"]["baseScore"].isNotNull()
    none = F.array().cast(_METRIC)
    ordered = []
    for version in METRICS:
        held = F.filter(F.coalesce(F.col(f"metrics.{version}"), none), usable)
        ordered += [F.filter(held, lambda m: m["type"].eqNullSafe("Primary")), held]
    best = F.get(F.concat(*ordered), F.lit(0))["cvssData"]
    texts = F.filter("descriptions", lambda t: t["value"].isNotNull())
    english = F.get(F.filter(texts, lambda t: t["lang"] == "en"), F.lit(0))["value"]
    flat = F.flatten(F.filter(F.transform("weaknesses", lambda w: w["description"]["value"]), lambda a: a.isNotNull()))
    published = F.when(F.col("published").rlike(r"([zZ]|[+-]\d{2}:?\d{2})$") | (F.col("published") == ""), F.nullif("published", F.lit(""))).otherwise(F.concat("published", F.lit("Z")))
    name = F.upper(F.trim("id"))
    return cve.where(name.rlike(CVE)).select(
        name.alias("cve"), published.alias("published"), best["baseScore"].alias("score"), best["vectorString"].alias("vector"),
        F.coalesce(english, F.get(texts, F.lit(0))["value"]).alias("description"), F.array_distinct(F.filter(flat, lambda x: x.rlike(r"^CWE-\d+$"))).alias("weaknesses"),
    )


#: Kinds of feed files and what parses each.
KINDS = ("ip-blocklist", "urlhaus-csv", "urlhaus-payloads-csv", "spamhaus-drop", "spamhaus-drop-ndjson", "generic-list", "csv-column", "free-text", "misp-warninglist")


def parse_feed(lines: DataFrame, kind: str, **options) -> DataFrame:
    """Rows (entity, match_value, cidr) of a file's lines by its kind; ``options`` are those of the kind's parser (``entity`` for lists of one type)."""
    none = lambda: F.lit(None).cast("string")
    exact = lambda rows, entity: rows.select(entity.alias("entity"), F.col("indicator").alias("match_value"), none().alias("cidr"))
    ranges = lambda rows: rows.select(F.lit("IP").alias("entity"), none().alias("match_value"), "cidr")
    fixed = F.lit(options.pop("entity", "IP"))
    if kind == "ip-blocklist":
        rows = generic_list(lines, ("#",)).select(F.col("indicator"))
        slash = F.contains("indicator", F.lit("/"))
        return rows.select(F.lit("IP").alias("entity"), F.when(~slash, F.col("indicator")).alias("match_value"), F.when(slash, F.col("indicator")).alias("cidr"))
    if kind == "urlhaus-csv":
        return exact(url_rows(lines), F.col("entity"))
    if kind == "urlhaus-payloads-csv":
        return exact(payload_hashes(lines), F.lit("HASH"))
    if kind == "spamhaus-drop":
        return ranges(drop_ranges(lines))
    if kind == "spamhaus-drop-ndjson":
        return ranges(drop_ranges_json(lines))
    if kind == "generic-list":
        return exact(generic_list(lines, **options), fixed)
    if kind == "csv-column":
        return exact(csv_columns(lines, **options), F.col("entity"))
    if kind == "free-text":
        found = free_text_all(lines.select(F.lit(1).alias("k"), "value"), "k", "value", **options)
        return exact(found.select("entity", "indicator").distinct(), F.col("entity"))
    if kind == "misp-warninglist":
        return warning_lists(lines).select(F.lit("IP").alias("entity"), F.col("ip").alias("match_value"), "cidr")
    raise ValueError(f"unknown kind of feed: {kind}")


def csv_columns(lines: DataFrame, header: Sequence[str] | None = None, n: int | None = None, static: Mapping[str, str] | None = None, typed: tuple[str, str, Mapping[str, str]] | None = None, shape: str | None = None, keep: Mapping[str, Sequence[str]] | None = None, delimiter: str = ",", comments: Sequence[str] = ("#",)) -> DataFrame:
    """(entity, indicator) of a table's columns, in one of three ways.

    ``static`` maps columns to entities; ``typed`` is (value column, type column, entities by type); ``shape`` is a column read as free
    text. Columns are named by ``header``, whose line is passed over where it stands, else c0 to c<n-1>. ``keep`` lists allowed values.
    """
    if sum(x is not None for x in (static, typed, shape)) != 1:
        raise ValueError("one of static, typed and shape is needed")
    names = list(header) if header else [f"c{i}" for i in range(n or 1)]
    rows = columns(lines.select(F.regexp_replace("value", "^﻿", "").alias("value")), len(names), comments, delimiter).toDF(*names)
    rows = rows.where(~F.coalesce(F.lower(F.trim(F.col(names[0]))) == names[0].lower(), F.lit(False))) if header else rows
    for column, allowed in (keep or {}).items():
        rows = rows.where(F.col(column).isin(list(allowed)))
    if static:
        pairs = F.array(*(F.struct(F.lit(e).alias("entity"), F.trim(F.col(c)).alias("indicator")) for c, e in static.items()))
        return rows.select(F.inline(pairs)).where("indicator <> ''").distinct()
    if typed:
        value, kind, kinds = typed
        entity = F.create_map(*(F.lit(x) for kv in kinds.items() for x in kv))[F.lower(F.col(kind))]
        return rows.select(entity.alias("entity"), F.trim(F.col(value)).alias("indicator")).where("entity is not null and indicator <> ''").distinct()
    return free_text_all(rows.select(F.lit(1).alias("k"), F.col(shape).alias("t")), "k", "t").select("entity", "indicator").distinct()


#: Endings of file names, which are no domains.
FILE_ENDINGS = (
    "exe", "dll", "bin", "dat", "sys", "scr", "msi", "dmg", "iso", "img", "php", "html", "htm", "asp", "aspx", "jsp", "cgi", "js", "css", "json", "xml", "yml", "yaml", "md", "txt", "log", "csv", "tsv", "ini", "cfg", "conf", "toml",
    "png", "jpg", "jpeg", "gif", "bmp", "svg", "ico", "webp", "pdf", "doc", "docx", "xls", "xlsx", "ppt", "pptx", "rtf", "zip", "rar", "gz", "tar", "7z", "bz2", "sh", "bat", "ps1", "vbs", "py", "rb", "pl", "go", "rs", "c", "cpp", "h",
    "sql", "db", "bak", "tmp", "lnk", "jar", "apk", "deb", "rpm", "sig", "yar", "yara", "rules", "ioc", "stix",
)


def free_text_all(rows: DataFrame, key: str, text: str, keep_line: str | None = None) -> DataFrame:
    """``free_text`` with a last pass for domains: names that end in no file's ending, lower case, once each; of a text only the lines that hold a match of ``keep_line`` are read."""
    if keep_line:
        rows = rows.withColumn(text, F.array_join(F.filter(F.split(text, r"\r?\n", -1), lambda line: line.rlike(keep_line)), "\n"))
    left = F.col(text)
    for pattern in (URL, HEX, IPV4):
        left = F.regexp_replace(left, pattern, " ")
    names = F.transform(F.regexp_extract_all(left, F.lit(r"\b(?:[A-Za-z0-9](?:[A-Za-z0-9-]{0,61}[A-Za-z0-9])?\.)+[A-Za-z]{2,24}\b"), F.lit(0)), F.lower)
    names = F.filter(names, lambda x: ~F.element_at(F.split(x, r"\."), -1).isin(list(FILE_ENDINGS)))
    domains = rows.select(key, F.explode(F.array_distinct(names)).alias("indicator")).select(key, F.lit("DOMAIN").alias("entity"), "indicator")
    return free_text(rows, key, text).unionByName(domains)


def snapshot_rows(rows: DataFrame, source: str, polarity: str, overrides: DataFrame | None = None) -> DataFrame:
    """A source's new snapshot (source, entity, match_value, cidr, polarity, hit_type, classification); overrides (match_value, hit_type, classification) win by row; negative rows have no hit type."""
    own = rows.select(F.lit(source).alias("source"), "entity", "match_value", "cidr", F.lit(polarity).alias("polarity"), "hit_type", "classification")
    if overrides is not None:
        o = overrides.select("match_value", F.col("hit_type").alias("_h"), F.col("classification").alias("_c"))
        own = own.join(o, "match_value", "left").withColumns({"hit_type": F.coalesce("_h", "hit_type"), "classification": F.coalesce("_c", "classification")}).drop("_h", "_c")
    return own.withColumn("hit_type", F.when(F.col("polarity") == "positive", F.col("hit_type"))).select("source", "entity", "match_value", "cidr", "polarity", "hit_type", "classification")


def source_policies(spark, policies: Sequence[tuple]) -> DataFrame:
    """The registry of sources: (source, entities, polarity, max_age_hours, floor). A source given twice is an error."""
    names = [p[0] for p in policies]
    if len(set(names)) < len(names):
        raise ValueError("a source is registered twice")
    return spark.createDataFrame(list(policies), "source string, entities array<string>, polarity string, max_age_hours int, floor boolean")


def registry(rows: DataFrame) -> DataFrame:
    """The registry of sources that a table holds, each once (its first entry, all columns compared), with how often it is ``registered``."""
    first = F.min(F.struct("entities", "polarity", "max_age_hours", "floor")).alias("p")
    return rows.groupBy("source").agg(first, F.count("*").alias("registered")).select("source", "p.*", "registered")


def relevant(policies: DataFrame, entity: str, *more: str) -> DataFrame:
    """Positive sources that a type of indicator is looked up in."""
    return policies.where((F.col("polarity") == "positive") & F.array_contains("entities", entity)).select("source", "floor", "max_age_hours", *more)


def repository_rows(files: DataFrame, rules: Sequence[tuple[str, str]], entity: str = "DOMAIN") -> DataFrame:
    """(path, group, campaign, indicator) of a vendor's file tree: files (path, content) by the first rule (pattern with one group, parser) that matches the path.

    Parsers: ``list`` (a line each) or ``text`` (free text). ``campaign`` is the title of the README in the nearest folder above, as an
    equi-join on the folders above each file. Repeated rows are one.
    """
    number = F.coalesce(*(F.when(F.col("path").rlike(p), F.lit(i)) for i, (p, _) in enumerate(rules)))
    group = F.coalesce(*(F.when(F.col("path").rlike(p), F.regexp_extract("path", p, 1)) for p, _ in rules))
    chosen = files.withColumn("rule", number).withColumn("group", group).where("rule is not null")
    parser = F.get(F.array(*(F.lit(k) for _, k in rules)), F.col("rule"))
    listed = chosen.where(parser == "list").select("path", "group", F.explode(F.split("content", "\n")).alias("line")).select("path", "group", F.trim("line").alias("indicator")).where("indicator <> '' and not startswith(indicator, '#')")
    texts = chosen.where(parser == "text")
    found = free_text_all(texts, "path", "content").join(texts.select("path", "group"), "path").where(F.col("entity") == entity).select("path", "group", "indicator")
    readme = files.where(F.col("path").rlike(r"(?i)(^|/)readme\.md$")).select(F.regexp_replace("path", r"(?i)/?readme\.md$", "").alias("folder"), F.regexp_extract("content", r"(?m)^title:\s*(.+?)\s*$", 1).alias("title")).where("title <> ''")
    parts = F.split(F.col("path"), "/")
    folders = F.transform(F.sequence(F.lit(0), F.size(parts) - 1), lambda k: F.array_join(F.slice(parts, F.lit(1), k), "/"))
    above = chosen.select("path", F.posexplode(folders).alias("depth", "folder")).join(readme, "folder").groupBy("path").agg(F.max_by("title", "depth").alias("campaign"))
    return listed.unionByName(found).join(above, "path", "left").select("path", "group", "campaign", "indicator").distinct()


def unparsed(lines: DataFrame, parsed: DataFrame, header: bool = False, filtered: bool = False) -> DataFrame:
    """One row: whether there are data lines but no rows. A lone header line, or rows that a filter may have dropped, are no fault."""
    some = content(lines, ("#", ";")).limit(2).agg(F.count("*").alias("data"))
    least = 1 if header else 0
    return some.crossJoin(parsed.limit(1).agg(F.count("*").alias("rows"))).select(((F.col("data") > least) & (F.col("rows") == 0) & F.lit(not filtered)).alias("unparseable"))
