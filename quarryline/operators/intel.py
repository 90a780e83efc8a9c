"""Threat intelligence: indicator extraction, feed matching, suppression, promotion, coverage, and vulnerabilities."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quarryline.functions.semantics import COVERAGE_RANK

#: The patterns of addresses, mail addresses and file hashes.
IPV4 = r"\b(?:25[0-5]|2[0-4]\d|1\d\d|[1-9]?\d)(?:\.(?:25[0-5]|2[0-4]\d|1\d\d|[1-9]?\d)){3}\b"
EMAIL = r"[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Za-z]{2,}"
HEX = r"\b(?:[0-9a-fA-F]{64}|[0-9a-fA-F]{40}|[0-9a-fA-F]{32})\b"


def extract(rows: DataFrame, key: str, text: str) -> DataFrame:
    """Different indicators (kind, value) of each text: addresses, then file hashes, lower case."""
    found = lambda kind, pattern: F.transform(F.regexp_extract_all(F.col(text), F.lit(pattern), F.lit(0)), lambda x: F.struct(F.lit(kind).alias("kind"), F.lower(x).alias("value")))
    every = F.array_distinct(F.concat(found("ipv4", IPV4), found("hash", HEX)))
    return rows.select(key, F.explode(every).alias("i")).select(key, "i.kind", "i.value")


def mask(text: Column) -> Column:
    """Mail addresses, then addresses, replaced by fixed marks."""
    return F.regexp_replace(F.regexp_replace(text, EMAIL, "<<MAIL>>"), IPV4, "<<IP>>")


def ip_number(address: Column) -> Column:
    parts = F.transform(F.split(address, r"\."), lambda x: x.cast("long"))
    return ((parts[0] * 256 + parts[1]) * 256 + parts[2]) * 256 + parts[3]


def is_private(number: Column) -> Column:
    """10/8, 172.16/12, 192.168/16, 169.254/16 and 127/8."""
    ranges = ((10 << 24, 24), ((172 << 24) + (16 << 16), 20), ((192 << 24) + (168 << 16), 16), ((169 << 24) + (254 << 16), 16), (127 << 24, 24))
    tests = [number.between(low, low + (1 << bits) - 1) for low, bits in ranges]
    out = tests[0]
    for t in tests[1:]:
        out = out | t
    return out


def cidr_match(addresses: DataFrame, feed: DataFrame) -> DataFrame:
    """Addresses (key, number) in feed ranges (source, low, bits: host bits, 0 to 32). Each range is joined on its own prefix, so that it is an equi-join.

    Addresses are exploded to all 33 prefix lengths; an address has a row for each range that it is in.
    """
    prefixed = addresses.withColumn("bits", F.explode(F.array(*(F.lit(b) for b in range(33)))))
    prefixed = prefixed.withColumn("prefix", F.expr("shiftright(CAST(number AS BIGINT), bits)"))
    return prefixed.join(feed.withColumn("prefix", F.expr("shiftright(CAST(low AS BIGINT), bits)")), ["bits", "prefix"]).drop("prefix", "low")


def judge(matches: DataFrame, least_confidence: int = 70, least_sources: int = 2) -> DataFrame:
    """For each indicator: suppressed by any negative match; else promoted by confidence or by two different sources."""
    found = matches.groupBy("indicator").agg(
        F.bool_or("negative").alias("negative"), F.max(F.when(~F.col("negative"), F.col("confidence"))).alias("best"),
        F.count_distinct(F.when(~F.col("negative"), F.col("source"))).alias("sources"),
    )
    verdict = F.when(F.col("negative"), "suppressed").when((F.col("best") >= least_confidence) | (F.col("sources") >= least_sources), "promoted").otherwise("held")
    return found.select("indicator", verdict.alias("verdict"), F.col("sources").cast("long").alias("sources"))


def coverage(outcomes: DataFrame, expected: int, most_age: int) -> DataFrame:
    """Each subject's coverage: unknown before stale before partial before complete; of repeated outcomes an answered one counts."""
    one = outcomes.groupBy("subject", "source").agg(F.bool_or("answered").alias("answered"), F.min(F.when(F.col("answered"), F.col("age"))).alias("age"))
    found = one.groupBy("subject").agg(F.count_if(F.col("answered")).alias("answered_n"), F.count_if(F.col("answered") & (F.col("age") > most_age)).alias("stale_n"), F.count_if(~F.col("answered")).alias("unavailable_n"))
    status = F.when(F.col("unavailable_n") > 0, "unknown").when(F.col("stale_n") > 0, "stale").when(F.col("answered_n") < expected, "partial").otherwise("complete")
    return found.withColumn("status", status)


def worst_coverage(covered: DataFrame) -> DataFrame:
    """The worst status of all subjects."""
    rank = F.create_map(*(F.lit(x) for kv in COVERAGE_RANK.items() for x in kv))[F.col("status")]
    back = F.create_map(*(F.lit(x) for k, v in COVERAGE_RANK.items() for x in (v, k)))
    return covered.agg(F.max(rank).alias("r")).select(back[F.col("r")].alias("status"))


def cve_pivot(catalog: DataFrame) -> DataFrame:
    """One record for each id: published by nvd, else kev; epss; kev; the sources in the order nvd, kev, epss."""
    has = lambda s: F.bool_or(F.col("source") == s)
    of = lambda s, c: F.max(F.when(F.col("source") == s, F.col(c)))
    sources = F.concat_ws(",", *(F.when(has(s), s) for s in ("nvd", "kev", "epss")))
    return catalog.groupBy("cve").agg(F.coalesce(of("nvd", "published"), of("kev", "published")).alias("published"), of("epss", "epss").alias("epss"), has("kev").alias("kev"), sources.alias("sources"))


def cve_landscape(pivoted: DataFrame, least_epss: int, cap: int, since: int | None = None) -> DataFrame:
    """Known exploited or likely ones, published since a day if one is given: exploited ones first, then by score, recency and id."""
    rows = pivoted.where(F.col("kev") | (F.col("epss") >= least_epss))
    rows = rows if since is None else rows.where(F.col("published") >= since)
    return rows.orderBy(F.desc("kev"), F.desc_nulls_last("epss"), F.desc_nulls_last("published"), "cve").limit(cap).select("cve", "kev", "epss", "published")


def answered_only(catalog: DataFrame, answered: list[str]) -> DataFrame:
    """The catalog's rows of the sources that answered: what a record is put together from."""
    return catalog.where(F.col("source").isin(answered))


def restricted(pivoted: DataFrame, enabled: list[str]) -> DataFrame:
    """Records with only what enabled sources say; those of no enabled source go."""
    kept = F.filter(F.split("sources", ","), lambda x: x.isin(enabled))
    on = lambda source: F.array_contains(kept, F.lit(source))
    rows = pivoted.withColumns({"epss": F.when(on("epss"), F.col("epss")), "kev": F.col("kev") & on("kev"), "sources": F.array_join(kept, ",")})
    return rows.where("sources <> ''")


def validate_refs(refs: DataFrame, pivoted: DataFrame, consulted: DataFrame, enabled: list[str]) -> DataFrame:
    """Each subject's different references (subject, ref) and why one is dropped: invalid_format, could_not_consult (its subject's lookup failed), not_in_catalog, source_disabled; else kept."""
    normal = F.upper(F.trim("ref"))
    rows = refs.withColumn("cve", F.when(normal.rlike(r"^CVE-\d{4}-\d{4,}$"), normal)).withColumn("shown", F.coalesce("cve", "ref")).select("subject", "cve", "shown").distinct()
    known = pivoted.select("cve", F.arrays_overlap(F.split("sources", ","), F.array(*map(F.lit, enabled))).alias("enabled"))
    rows = rows.join(known, "cve", "left").join(consulted.select("subject", "answered"), "subject", "left")
    reason = F.when(F.col("cve").isNull(), "invalid_format").when(~F.coalesce("answered", F.lit(False)), "could_not_consult").when(F.col("enabled").isNull(), "not_in_catalog").when(~F.col("enabled"), "source_disabled").otherwise("kept")
    return rows.select("subject", F.col("shown").alias("ref"), reason.alias("reason"))


def degraded(status, failed):
    """A status after a failed preparation: complete and partial become unknown, the others stay."""
    return F.when(failed & status.isin("complete", "partial"), "unknown").otherwise(status)


def row_state(refs, status, tier):
    """What is shown of a result's vulnerabilities: absent, chips, novelty (none, fully checked, high tier), irrelevant, could_not_verify."""
    significant = tier.isin("CRITICAL", "HIGH")
    return F.when(status.isNull(), "absent").when(refs > 0, "chips").when((status == "complete") & significant, "novelty").when(status == "complete", "irrelevant").otherwise("could_not_verify")


def payload_text(score, kev, epss, percentile, in_the_wild):
    """The line of a vulnerability: what is known, each with its source. Labels and their order."""
    parts = [F.when(score.isNotNull(), F.concat(F.lit("CVSS "), score.cast("string"), F.lit(" [NVD]"))), F.when(kev, "KEV [CISA]"),
             F.when(epss.isNotNull(), F.concat(F.lit("EPSS "), epss.cast("string"), F.lit(" / p"), F.round(percentile * 100).cast("int").cast("string"), F.lit(" [FIRST]"))),
             F.when(in_the_wild & ~F.coalesce(kev, F.lit(False)), "In the wild [CISA]")]
    return F.concat_ws(" \u00b7 ", *parts)


def cve_validate(refs: DataFrame, pivoted: DataFrame) -> DataFrame:
    """Each reference's normal form and why it is dropped, if it is."""
    normal = F.upper(F.trim("ref"))
    rows = refs.withColumn("cve", F.when(normal.rlike(r"^CVE-\d{4}-\d{4,}$"), normal))
    known = pivoted.select("cve", F.lit(True).alias("known"))
    reason = F.when(F.col("cve").isNull(), "invalid_format").when(F.col("known").isNull(), "not_in_catalog").otherwise("kept")
    return rows.join(known, "cve", "left").groupBy(reason.alias("reason")).agg(F.count("*").alias("n"))


def exploited_only(pivoted: DataFrame, enabled: list[str], cap: int) -> DataFrame:
    """What an event's landscape shows of the enabled sources: known exploited ones, by score, recency and id."""
    score = F.when(F.lit("epss" in enabled), F.col("epss"))
    rows = pivoted.where(F.col("kev") & F.lit("kev" in enabled)).withColumn("epss", score)
    return rows.orderBy(F.desc_nulls_last("epss"), F.desc_nulls_last("published"), "cve").limit(cap).select("cve", "epss", "published")
