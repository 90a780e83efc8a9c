"""Redaction of personal data to tokens, with a map of each scope's values, and its way back.

A scope (an event, say) is a row: its text and its map from values to tokens. All of it stays in built-in expressions.
Null texts stay null and leave the map as it is; a null map is an empty one. A map that gives one value two tokens can't
be, as values are its keys; one that gives two values one token is not injective: ``conflicts`` lists such rows, and restoring
leaves their shared tokens as they are.
"""

from __future__ import annotations

import hashlib
import json
from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quarryline.functions import network
from quarryline.operators.intel import EMAIL, IPV4, ip_number, is_private

#: The patterns of hardware addresses and of what may be an IPv6 address; its grammar is tested after.
MAC = r"\b[0-9A-Fa-f]{2}(?:[:-][0-9A-Fa-f]{2}){5}\b"
IPV6 = r"(?<![A-Za-z0-9:.])[A-Fa-f0-9]{0,4}(?::[A-Fa-f0-9]{0,4}){2,}(?![A-Za-z0-9:.])"
DOMAIN = r"\b(?:[A-Za-z0-9](?:[A-Za-z0-9-]*[A-Za-z0-9])?\.)+[A-Za-z]{2,}\b"
#: The form of tokens, by scope.
TOKEN = r"<<REDACTED_(IP|EMAIL|MAC|DOMAIN)_(\d+)>>"
STORY_TOKEN = r"<<REDACTED_(IP|EMAIL|MAC|DOMAIN)_E\d+_\d+>>"
FACT_TOKEN = r"<<REDACTED_(?:IP|EMAIL|MAC|DOMAIN)_F\d+_\d+>>"
ANY_TOKEN = r"<<REDACTED_[A-Z0-9_]+>>"
EMPTY = "cast(map() as map<string,string>)"


def matches(text: Column, pattern: str) -> Column:
    """All matches; none of a null text. Texts without a character that the pattern needs aren't searched."""
    needs = {EMAIL: "@", MAC: ":-", IPV6: ":", IPV4: ".", DOMAIN: "."}.get(pattern, "")
    found, may = F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), text.isNotNull()
    if needs:
        may = F.translate(text, needs, "") != text
        may = F.contains(text, F.lit(needs)) if len(needs) == 1 else may
    return F.when(may, found).otherwise(F.array().cast("array<string>"))


def joined(text: Column, pattern: str, marks: Column) -> Column:
    """The text with its matches replaced by the marks, in order; a text without matches is not split."""
    parts = F.zip_with(F.split(text, pattern, -1), F.concat(marks, F.array(F.lit(""))), lambda part, mark: F.concat(part, mark))
    return F.when(F.size(marks) > 0, F.array_join(parts, "")).otherwise(text)


def replaced(text: Column, pattern: str, by: Callable[[Column], Column]) -> Column:
    """The text with each match m replaced by by(m)."""
    return joined(text, pattern, F.transform(matches(text, pattern), by))


def _number(n: Column) -> Column:
    return F.when(n < 1000, F.lpad(n.cast("string"), 3, "0")).otherwise(n.cast("string"))


def sensitive(ranges: Sequence[tuple[int, int]] = (), domains: Sequence[str] = (), ranges6: Sequence[tuple[str, str]] = ()) -> list[tuple[str, str, Callable[[Column], Column]]]:
    """The passes in order: kind, pattern, and which matches count.

    ``ranges`` are a customer's own IPv4 ranges (first, last, as numbers), ``ranges6`` those of IPv6 (as 32 hexadecimal digits).
    """

    def own4(m: Column) -> Column:
        number = ip_number(m)
        out = is_private(number)
        for low, high in ranges:
            out = out | number.between(low, high)
        return out

    def owned(m: Column) -> Column:
        name = F.lower(m)
        out = F.lit(False)
        for d in domains:
            out = out | (name == d.lower()) | name.endswith("." + d.lower())
        return out

    every = lambda m: F.lit(True)

    def own6(m: Column) -> Column:
        def test(digits: Column) -> Column:
            out = network.private(digits)
            for low, high in ranges6:
                out = out | digits.between(low, high)
            return F.coalesce(out, F.lit(False))

        return network.let(network.ipv6_hex(m), test)

    return [("EMAIL", EMAIL, every), ("MAC", MAC, every), ("IP", IPV6, own6), ("IP", IPV4, own4)] + ([("DOMAIN", DOMAIN, owned)] if domains else [])


def redact(rows: DataFrame, text: str = "text", known: str = "known", ranges: Sequence[tuple[int, int]] = (), domains: Sequence[str] = (), ranges6: Sequence[tuple[str, str]] = ()) -> DataFrame:
    """Rows with ``text`` redacted and ``known`` (value to token) extended; a value met again keeps its token, new ones are numbered on from the highest number of their kind."""
    rows = rows.withColumn(known, F.coalesce(F.col(known), F.expr(EMPTY)))
    for kind, pattern, counts in sensitive(ranges, domains, ranges6):
        prefix = f"<<REDACTED_{kind}_"
        rows = rows.withColumn("_found", matches(F.col(text), pattern))
        fresh = F.array_except(F.filter(F.array_distinct("_found"), counts), F.map_keys(known))
        numbers = F.transform(F.map_values(known), lambda t: F.regexp_extract(t, prefix + r"(\d+)>>$", 1).try_cast("int"))  # noqa: B023
        offset = F.coalesce(F.array_max(numbers), F.lit(0))
        rows = rows.withColumns({"_fresh": fresh, "_offset": offset})
        token = F.transform("_fresh", lambda v, i: F.concat(F.lit(prefix), _number(F.col("_offset") + i + 1), F.lit(">>")))  # noqa: B023
        rows = rows.withColumn(known, F.map_concat(known, F.map_from_arrays("_fresh", token)))
        rows = rows.withColumn("_found", F.transform("_found", lambda m: F.when(counts(m), F.try_element_at(F.col(known), m)).otherwise(m)))  # noqa: B023
        rows = rows.withColumn(text, joined(F.col(text), pattern, F.col("_found")))
    return rows.drop("_fresh", "_offset", "_found")


#: Tokens of any scope: an event's, a story's (E), a fact's (F), a report's (R).
SCOPED_TOKEN = r"<<REDACTED_(?:IP|EMAIL|MAC|DOMAIN)_(?:[EFR]\d+_)?\d+>>"


def restore_scoped(text: Column, known: Column) -> Column:
    """``restore`` for texts of stories, facts and reports, whose maps hold tokens of their own scope."""
    return restore(text, known, SCOPED_TOKEN)


def backward(known: Column) -> Column:
    """A map of values to tokens turned round; tokens that it gives to two values are left out."""

    def turn(pairs: Column) -> Column:
        lone = lambda tokens: F.filter(pairs, lambda e: F.size(F.filter(tokens, lambda t: t == e["value"])) == 1)
        turned = lambda e: F.struct(e["value"].alias("key"), e["key"].alias("value"))
        return network.let(F.transform(pairs, lambda e: e["value"]), lambda tokens: F.map_from_entries(F.transform(lone(tokens), turned)))

    return network.let(F.map_entries(F.coalesce(known, F.expr(EMPTY))), turn)


def restore(text: Column, known: Column, pattern: str = TOKEN) -> Column:
    """Tokens turned back to their values; tokens that the map lacks, or gives to two values, stay."""
    return network.let(F.struct(text.alias("t"), backward(known).alias("b")), lambda s: replaced(s["t"], pattern, lambda t: F.coalesce(F.try_element_at(s["b"], t), t)))


def conflicts(rows: DataFrame, key: str, known: str = "known") -> DataFrame:
    """(key, token, values) of maps that give one token to several values: they can't be restored and are to be mended first."""
    entries = rows.select(key, F.explode(F.map_entries(known)).alias("e")).groupBy(key, F.col("e.value").alias("token")).agg(F.count("*").alias("values"))
    return entries.where("values > 1")


def redact_again(rows: DataFrame, version: str, text: str = "text", known: str = "known", ranges: Sequence[tuple[int, int]] = (), domains: Sequence[str] = (), most_failures: int = 0) -> tuple[DataFrame, DataFrame]:
    """Rows of another policy version, restored and redacted under this one; and one row of counts: items, failed, stopped.

    Items keep their number in the order of their key. A row whose map is not injective fails and stays as it is; the job counts as
    stopped with more than ``most_failures`` of them. The new map starts from the old one, so values keep their tokens.
    """
    old = rows.where(F.col("version") != version)
    pairs = F.coalesce(F.map_values(known), F.array().cast("array<string>"))
    failed = F.size(F.array_distinct(pairs)) != F.size(pairs)
    marked = old.withColumn("failed", failed)
    restored = marked.withColumn(text, F.when(~F.col("failed"), restore(F.col(text), F.col(known))))
    again = redact(restored.where("not failed"), text, known, ranges, domains).withColumn("version", F.lit(version))
    counts = marked.agg(F.count("*").alias("items"), F.count_if("failed").alias("failed"))
    return again.drop("failed"), counts.withColumn("stopped", F.col("failed") > most_failures)


def allowed_tokens(maps: DataFrame, key: str, scope: str, index: str, known: str = "known") -> DataFrame:
    """(key, tokens): the tokens of a wider scope that its members' maps allow, in order; ``index`` is a member's place in it."""
    tokens = maps.select(key, F.explode(F.map_values(known)).alias("t"), index)
    return tokens.select(key, to_scope(F.col("t"), scope, F.col(index)).alias("t")).groupBy(key).agg(F.array_sort(F.collect_set("t")).alias("tokens"))


def verify_answer(rows: DataFrame, text: str = "text", known: str = "known", ranges: Sequence[tuple[int, int]] = (), domains: Sequence[str] = ()) -> DataFrame:
    """An answer's plain values: known ones become their token, others ``<<UNVERIFIED_KIND_NNN>>``, counted in ``unverified``."""
    total, met = F.lit(0), {}
    rows = rows.withColumn(known, F.coalesce(F.col(known), F.expr(EMPTY)))
    for kind, pattern, counts in sensitive(ranges, domains):
        unknown = lambda m: counts(m) & F.try_element_at(F.col(known), m).isNull()  # noqa: E731, B023
        rows = rows.withColumn("_found", matches(F.col(text), pattern))
        found = F.col("_found")
        before = met.get(kind, F.lit(0))
        rows = rows.withColumn("_n", before + F.size(F.filter(found, unknown)))
        marks = F.transform(found, lambda m, i: F.when(unknown(m), F.concat(F.lit(f"<<UNVERIFIED_{kind}_"), _number(before + F.size(F.filter(F.slice(found, F.lit(1), i + 1), unknown))), F.lit(">>")))  # noqa: B023
                            .when(counts(m), F.try_element_at(F.col(known), m)).otherwise(m))  # noqa: B023
        name = f"_n_{len(met)}_{kind}"
        rows = rows.withColumn("_found", marks).withColumn(text, joined(F.col(text), pattern, F.col("_found"))).withColumnRenamed("_n", name)
        met[kind] = F.col(name)
    for n in met.values():
        total = total + n
    rows = rows.withColumn("unverified", total)
    return rows.drop("_found", *(c for c in rows.columns if c.startswith("_n_")))


def to_scope(text: Column, scope: str, index: Column) -> Column:
    """Event tokens under the name of a wider scope: ``_NNN`` becomes ``_E<i>_NNN`` in a story, ``_R<i>_`` in a report."""
    return F.regexp_replace(text, F.lit(TOKEN), F.concat(F.lit(f"<<REDACTED_$1_{scope}"), index.cast("string"), F.lit("_$2>>")))


def mask_facts(text: Column) -> Column:
    return F.regexp_replace(text, FACT_TOKEN, "[redacted]")


def leaks(rows: DataFrame, key: str, text: str, allowed: str) -> DataFrame:
    """For each story text: tokens outside ``allowed`` (array), event tokens left over, tokens of unknown kind, plain mail addresses."""
    every = lambda pattern: F.regexp_extract_all(F.col(text), F.lit(pattern), F.lit(0))
    unmapped = F.size(F.filter(every(STORY_TOKEN), lambda t: ~F.array_contains(F.col(allowed), t)))
    unknown = F.size(F.filter(every(ANY_TOKEN), lambda t: ~t.rlike(r"^<<REDACTED_(IP|EMAIL|MAC|DOMAIN)_([EFR]\d+_)?\d+>>$")))
    return rows.select(key, unmapped.alias("unmapped"), F.size(every(TOKEN)).alias("residual"), unknown.alias("unknown_kind"), F.size(every(EMAIL)).alias("plain"))


def policy_version(engine: str, ranges: Sequence[str] = (), domains: Sequence[str] = ()) -> str:
    """``engine:..|ranges:..|domains:..``: the first 12 hex digits of each sorted list's SHA-256, or ``empty``."""
    short = lambda items: hashlib.sha256(json.dumps(sorted(items), separators=(",", ":"), ensure_ascii=False).encode()).hexdigest()[:12] if items else "empty"
    return f"engine:{engine}|ranges:{short(ranges)}|domains:{short(domains)}"


def policy_versions(engine: str, ranges: Column, domains: Column) -> Column:
    """``policy_version`` of columns of lists; a null list is an empty one."""

    def short(items: Column) -> Column:
        told = F.substring(F.sha2(F.to_json(F.array_sort(items)), 256), 1, 12)
        return F.when(F.coalesce(F.size(items), F.lit(0)) > 0, told).otherwise("empty")

    return F.concat(F.lit(f"engine:{engine}|ranges:"), short(ranges), F.lit("|domains:"), short(domains))


def stale(tables: dict[str, DataFrame], column: str, version: str) -> DataFrame:
    """For each table its rows of another policy version; rows without a version are not counted."""
    parts = [t.where(F.col(column) != version).agg(F.count("*").alias("n")).select(F.lit(name).alias("table_name"), "n") for name, t in tables.items()]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out
