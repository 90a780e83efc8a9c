"""Indicators of compromise: extraction with normal forms, matching with feeds, suppression, promotion, evidence and verdicts."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quarryline.functions import network as n
from quarryline.functions.domains import SuffixRules, host_of, with_registered
from quarryline.operators.redaction import backward, replaced

VERSION = "1"
#: The patterns that indicators are found by, in this order, and endings that are no domains.
TOKENS = r"<<REDACTED_(?:IP|EMAIL|MAC)_\d+>>"
URLS = r"(?i)\bhttps?://[^\s\"\x27<>()]+"
ADDRESSES4 = r"(?<!\d\.)(?<!\d)(?:\d{1,3}\.){3}\d{1,3}(?!\.?\d)"
ADDRESSES6 = r"\b(?:[0-9a-fA-F]{1,4}:){2,7}[0-9a-fA-F]{0,4}(?:::)?[0-9a-fA-F:]*\b"
HASHES = r"\b(?:[0-9a-fA-F]{64}|[0-9a-fA-F]{40}|[0-9a-fA-F]{32})\b"
DOMAINS = r"\b(?:[a-zA-Z0-9](?:[a-zA-Z0-9-]{0,61}[a-zA-Z0-9])?\.)+[a-zA-Z]{2,}\b"
FILE_ENDINGS = (
    "tmp", "exe", "dll", "zip", "rar", "gz", "tar", "pdf", "doc", "docx", "xls", "xlsx", "ppt", "pptx", "txt", "log", "csv", "json", "xml", "html",
    "htm", "js", "css", "png", "jpg", "jpeg", "gif", "svg", "bin", "dat", "bat", "ps1", "sh", "dmg", "iso", "msi", "lnk",
)
#: Public suffixes of two labels, where no rules are given (``functions.domains``); one label is taken for a suffix otherwise.
SUFFIXES = ("co.uk", "ac.uk", "gov.uk", "co.kr", "or.kr", "go.kr", "co.jp", "ne.jp", "com.au", "com.br", "com.cn")
#: What promotes a soft match, and the order of evidence.
CONFIDENCE, SOURCES = 70, 2
CLASSES = ("floor_supporting", "floor_ineligible_deterministic", "promoted_soft")


def registered_domain(host: Column, suffixes: Sequence[str] = SUFFIXES) -> Column:
    """The label before the public suffix and the suffix; null for addresses and single labels."""

    def of(labels: Column) -> Column:
        size = F.size(labels)
        last = lambda k: F.array_join(F.slice(labels, F.greatest(size - k + 1, F.lit(1)), F.lit(k)), ".")
        two = last(2).isin(list(suffixes))
        return F.when(two & (size >= 3), last(3)).when(~two & (size >= 2), last(2))

    return n.let(host, lambda h: F.when(~h.startswith("[") & ~h.rlike(r"^[\d.]+$"), n.let(F.split(h, r"\."), of)))


def normal_ip(text: Column) -> Column:
    told = lambda h: F.when(h.isNotNull(), n.let(n.canonical_ip(h), lambda value: _indicator("IP", value, F.array(value), n.is_public(h))))
    return n.let(n.ip_hex(text, octal=True), told)


def normal_domain(text: Column) -> Column:
    """Lower case without a final point, in ASCII letters; the Unicode form matches too."""
    plain = F.lower(F.regexp_replace(F.trim(text), r"\.+$", ""))
    idn = lambda name, c: F.try_reflect(F.lit("java.net.IDN"), F.lit(name), c)
    narrow = n.let(plain, lambda p: F.when(p.rlike(r"[^\x00-\x7f]"), idn("toASCII", p)).otherwise(p))
    wide = lambda a: F.array_distinct(F.array_compact(F.array(a, F.when(F.contains(a, F.lit("xn--")), idn("toUnicode", a)))))
    return n.let(narrow, lambda a: F.when(a != "", _indicator("DOMAIN", a, wide(a))))


def normal_url(text: Column, suffixes: Sequence[str] = SUFFIXES) -> Column:
    """Scheme and host in lower case, usual ports, user and fragment dropped, %xx in upper case; URL, host and registered domain match."""
    pattern = r"(?i)^(https?)://(?:[^/?#@]*@)?(\[[0-9a-f:.]+\]|[^/?#:\[\]]+)(?::(\d*))?([^?#]*)(\?[^#]*)?"
    cut = lambda t: F.struct(*(F.regexp_extract(t, pattern, i + 1).alias(name) for i, name in enumerate(("scheme", "host", "port", "path", "query"))))
    upper = lambda c: n.let(c, lambda t: F.when(F.contains(t, F.lit("%")), replaced(t, "%[0-9a-fA-F]{2}", F.upper)).otherwise(t))

    def told(p: Column) -> Column:
        scheme, host = F.lower(p["scheme"]), F.lower(p["host"])
        usual = (p["port"] == "") | ((scheme == "http") & (p["port"] == "80")) | ((scheme == "https") & (p["port"] == "443"))
        port = F.when(usual, "").otherwise(F.concat(F.lit(":"), p["port"]))
        value = F.concat(scheme, F.lit("://"), host, port, upper(F.when(p["path"] == "", "/").otherwise(p["path"])), upper(F.when(p["query"] == "?", "").otherwise(p["query"])))
        return F.when(host != "", n.let(value, lambda u: _indicator("URL", u, F.array_distinct(F.array_compact(F.array(u, host, registered_domain(host, suffixes)))))))

    return n.let(n.let(F.trim(text), cut), told)


def normal_hash(text: Column) -> Column:
    value = F.lower(F.trim(text))
    return F.when(value.rlike("^(?:[0-9a-f]{32}|[0-9a-f]{40}|[0-9a-f]{64})$"), _indicator("HASH", value, F.array(value)))


def _indicator(entity: str, value: Column, candidates: Column, public: Column | None = None) -> Column:
    return F.struct(F.lit(entity).alias("entity"), value.alias("value"), candidates.alias("candidates"), (F.lit(None).cast("boolean") if public is None else public).alias("public"))


def hash_kind(value: Column) -> Column:
    return F.create_map(*(F.lit(x) for kv in {32: "MD5", 40: "SHA1", 64: "SHA256"}.items() for x in kv))[F.length(value)]


def indicator_key(entity: Column, value: Column) -> Column:
    """A stable key: version, type and value, joined by NUL."""
    return F.concat_ws("\u0000", F.lit(VERSION), entity, value)


def extract_all(rows: DataFrame, key: str, text: str, known: str | None = None, suffixes: Sequence[str] = SUFFIXES, rules: SuffixRules | None = None, strict: bool = False) -> DataFrame:
    """Different indicators (key, entity, value, candidates, public, token) of each text.

    Tokens of ``known`` (a map of values to tokens) that stand for addresses come first; then URLs, addresses, hashes and domains, each
    blanked before the next. What has no normal form gives no row. A null text gives no rows. A token that the map gives to two values is passed over.

    With ``rules`` registered domains are told by them, for domains and for what a URL matches; a domain that has none (``strict``: for want of a rule) gives no row.
    """
    if rules is not None:
        suffixes = ()  # names of two labels pass here; the rules are asked below, on the exploded rows
    found = []
    if known:
        back = backward(F.col(known))
        tokens = F.filter(F.regexp_extract_all(F.col(text), F.lit(TOKENS), F.lit(0)), lambda t: F.contains(t, F.lit("_IP_")))
        found.append(F.transform(tokens, lambda t: F.struct(normal_ip(F.try_element_at(back, t)).alias("i"), t.alias("token"))))
    left = F.regexp_replace(F.col(text), TOKENS, " ")
    domain = lambda m: F.when(F.lower(m).rlike(r"[a-z]") & registered_domain(F.lower(m), suffixes).isNotNull() & ~F.lower(F.element_at(F.split(m, r"\."), -1)).isin(list(FILE_ENDINGS)), normal_domain(m))
    for pattern, normal in ((URLS, lambda m: normal_url(m, suffixes)), (ADDRESSES4, normal_ip), (ADDRESSES6, normal_ip), (HASHES, normal_hash), (DOMAINS, domain)):
        rows = rows.withColumn("_left", left)
        hits = F.regexp_extract_all("_left", F.lit(pattern), F.lit(0))
        name = f"_hits_{len(found)}"
        rows = rows.withColumn(name, F.transform(hits, lambda m: F.struct(normal(m).alias("i"), m.alias("token"))))  # noqa: B023
        found.append(F.col(name))
        left = F.regexp_replace("_left", pattern, " ")
    every = rows.select(key, F.posexplode(F.filter(F.concat(*found), lambda x: x["i"].isNotNull())).alias("place", "x")).select(key, "place", "x.i.*", "x.token")
    if rules is not None:
        every = _by_rules(every, rules, strict)
    first = every.groupBy(key, "entity", "value").agg(F.min(F.struct("place", "candidates", "public", "token")).alias("f"))
    return first.select(key, "entity", "value", "f.candidates", "f.public", "f.token")


def _by_rules(rows: DataFrame, rules: SuffixRules, strict: bool) -> DataFrame:
    """Indicators with registered domains by rules: domains without one go, URLs match by their own."""
    named = with_registered(rows.withColumn("_host", host_of(F.col("entity"), F.col("value"))), "_host", rules, "_registered", strict)
    named = named.where("entity <> 'DOMAIN' or _registered is not null")
    url = F.array_distinct(F.array_compact(F.array("value", "_host", "_registered")))
    return named.withColumn("candidates", F.when(F.col("entity") == "URL", url).otherwise(F.col("candidates"))).drop("_host", "_registered")


def match_feeds(indicators: DataFrame, feed: DataFrame) -> DataFrame:
    """Each indicator with the feed rows that name one of its candidates, or whose range holds its address, once each.

    indicators: entity, value, candidates, ...; feed: source, match_value or cidr, and any other columns. Both joins are on equal keys.
    """
    exact = indicators.withColumn("match_value", F.explode("candidates")).join(feed.where("match_value is not null"), "match_value")
    ranges = feed.where("cidr is not null").withColumn("_c", n.cidr(F.col("cidr"))).withColumns({"low": F.col("_c.low"), "bits": F.col("_c.bits")}).drop("_c")
    held = n.range_matches(indicators.where("entity = 'IP'").withColumn("digits", n.ip_hex(F.col("value"))), ranges).drop("digits", "low", "bits")
    columns = [c for c in exact.columns if c != "candidates"]
    return exact.select(columns).unionByName(held.select(columns)).distinct()


def with_floor(matched: DataFrame, policies: DataFrame) -> DataFrame:
    """floor_eligible by the source's policy (source, floor); an address that isn't public never is."""
    rows = matched.join(policies.select("source", F.col("floor").alias("_floor")), "source", "left")
    return rows.withColumn("floor_eligible", F.coalesce("_floor", F.lit(False)) & F.coalesce("public", F.lit(True))).drop("_floor")


def suppress(matched: DataFrame) -> DataFrame:
    """Positive matches (polarity, hit_type, floor_eligible) after negative ones of the same indicator: soft ones go, deterministic ones lose the floor.

    ``action``: dropped_soft, demoted_deterministic or kept; rows of dropped_soft stay, so that the decision can be told.
    """
    negative = matched.where("polarity = 'negative'").select("entity", "value").distinct().withColumn("_negative", F.lit(True))
    rows = matched.where("polarity = 'positive'").join(negative, ["entity", "value"], "left")
    hit = F.coalesce("_negative", F.lit(False))
    action = F.when(hit & (F.col("hit_type") == "soft_reputation"), "dropped_soft").when(hit, "demoted_deterministic").otherwise("kept")
    return rows.withColumn("action", action).withColumn("floor_eligible", F.col("floor_eligible") & ~hit).drop("_negative")


def evidence(suppressed: DataFrame, confidence: int = CONFIDENCE, sources: int = SOURCES) -> DataFrame:
    """Matches with their class: those that support the floor, other deterministic ones, and soft ones that are promoted; others have none."""
    kept = suppressed.where("action <> 'dropped_soft'")
    told = kept.groupBy("entity", "value").agg(F.count_distinct("source").alias("_sources"))
    rows = kept.join(told, ["entity", "value"])
    deterministic = F.col("hit_type") == "deterministic_ioc"
    promoted = F.coalesce(F.col("confidence") >= confidence, F.lit(False)) | (F.col("_sources") >= sources)
    return rows.withColumn("class", F.when(deterministic & F.col("floor_eligible"), CLASSES[0]).when(deterministic, CLASSES[1]).when(promoted, CLASSES[2])).drop("_sources")


def ordered_evidence(rows: DataFrame) -> DataFrame:
    """By class, then newest check first."""
    return rows.orderBy(F.array_position(F.array(*map(F.lit, CLASSES)), F.col("class")), F.desc("checked_at"))


def verdict_state(hit: Column, coverage: Column) -> Column:
    """not_run (no run), hit, clean_complete or clean_incomplete."""
    return F.when(hit.isNull(), "not_run").when(hit, "hit").when(coverage == "complete", "clean_complete").otherwise("clean_incomplete")


def fact_text(value: Column, source: Column, classification: Column, actor: Column, campaign: Column, family: Column, url: Column) -> Column:
    """One sentence on a match, with whatever of its attribution is there."""
    has = lambda c: F.coalesce(c, F.lit("")) != ""
    some = lambda c, *parts: F.when(has(c), F.concat(*parts))
    campaign_ = F.when(has(actor), some(campaign, F.lit("in campaign "), campaign)).otherwise(some(campaign, F.lit("campaign "), campaign))
    clause = F.concat_ws(" ", some(actor, F.lit("attributed to "), actor), campaign_)
    clause = F.when(has(family) & (clause != ""), F.concat(clause, F.lit(" (family "), family, F.lit(")"))).when(has(family), F.concat(F.lit("family "), family)).otherwise(clause)
    return F.concat(value, F.lit(" is listed by "), source, F.coalesce(some(classification, F.lit(" as "), classification), F.lit("")), F.coalesce(some(clause, F.lit("; "), clause), F.lit("")), F.coalesce(some(url, F.lit("; see "), url), F.lit("")))


def dispatched(outcomes: DataFrame, expected: DataFrame) -> DataFrame:
    """One row for each indicator: matches, earliest expiry and the outcome of every expected source; those without one are not_attempted."""
    every = outcomes.select("entity", "value").distinct().join(expected.select("entity", "source").distinct(), "entity")
    both = every.join(outcomes, ["entity", "value", "source"], "left")
    return both.groupBy("entity", "value").agg(F.coalesce(F.sum("matches"), F.lit(0)).alias("matches"), F.min("expires").alias("expires"), F.count_if(F.col("answered")).alias("answered"), F.count_if(F.col("answered").isNull()).alias("not_attempted"))


def subject_verdicts(subjects: DataFrame, found: DataFrame, coverage: DataFrame) -> DataFrame:
    """(subject, known_ioc_hit, evidence, soft, coverage, state): subjects (subject, entity, value) over classed evidence (entity, value, class)."""
    counted = found.where("class is not null").groupBy("entity", "value").agg(F.count_if(F.col("class") == CLASSES[0]).alias("floor"), F.count("*").alias("rows"), F.count_if(F.col("class") == CLASSES[2]).alias("soft"))
    held = subjects.join(counted, ["entity", "value"], "left").groupBy("subject").agg(F.coalesce(F.bool_or(F.col("floor") > 0), F.lit(False)).alias("known_ioc_hit"), F.coalesce(F.sum("rows"), F.lit(0)).alias("evidence"), F.coalesce(F.sum("soft"), F.lit(0)).alias("soft"))
    rows = held.join(coverage.select("subject", "coverage"), "subject", "left")
    ran = F.when(F.col("coverage").isNotNull(), F.col("known_ioc_hit"))
    return rows.withColumn("state", verdict_state(ran, F.col("coverage")))


def loose_events(events: DataFrame, members: DataFrame) -> DataFrame:
    """Events that no story holds: those that are enriched alone."""
    return events.join(members.select(F.col("member_key").alias("event_key")), "event_key", "left_anti")


def feed_status(feed: DataFrame, fetched: DataFrame) -> DataFrame:
    """For each source whether a snapshot is there, its rows, newest version and hash, and when it was fetched: an outer join on rows counted first."""
    held = feed.groupBy("source").agg(F.count("*").alias("rows"), F.max("version").alias("version"), F.max("feed_hash").alias("feed_hash"))
    return fetched.join(held, "source", "left").select("source", F.col("fetched_at").isNotNull().alias("present"), F.coalesce("rows", F.lit(0)).alias("rows"), "version", "feed_hash", "fetched_at")
