"""One token space for a report: tokens of its stories, events and exemplars renumbered, and the way back to their values.

A leaf is a story, event or exemplar that a report uses, with the texts that go into it (its analysis, then its factors). Leaves of a report
are numbered from 1, stories first, then events, then exemplars, each in the order of their places; a leaf's different tokens are numbered from 1 as they are
first seen in its texts, whatever their kind: ``<<REDACTED_IP_E2_001>>`` of the third leaf becomes ``<<REDACTED_IP_R3_001>>``. Tokens of facts are masked first.

A report has a bounded number of leaves, so ranking and gathering within a report are bounded. Null texts stay null; a report without leaves has no rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quarryline.functions.network import let
from quarryline.operators import redaction as x

KINDS = ("story", "event", "exemplar")
#: The form of a report's tokens.
REPORT_TOKEN = r"<<REDACTED_(?:IP|EMAIL|MAC|DOMAIN)_R\d+_\d+>>"


def _sources(kind: Column, texts: Column) -> Column:
    """The different tokens of a leaf's texts, as first seen: a story's own form in a story, else an event's."""
    every = lambda pattern: F.array_distinct(F.flatten(F.transform(texts, lambda t: F.when(t.isNotNull(), F.regexp_extract_all(t, F.lit(pattern), F.lit(0))).otherwise(F.array().cast("array<string>")))))
    return F.when(kind == "story", every(x.STORY_TOKEN)).otherwise(every(x.TOKEN))


def report_tokens(leaves: DataFrame, report: str = "report") -> DataFrame:
    """leaves (report, kind, place, texts) with ``leaf`` (the number), ``texts`` rewritten and ``tokens``: (token, source) pairs in order."""
    order = F.array_position(F.array(*map(F.lit, KINDS)), F.col("kind"))
    rows = leaves.withColumn("leaf", F.row_number().over(Window.partitionBy(report).orderBy(order, "place")))
    rows = rows.withColumn("texts", F.transform("texts", lambda t: F.when(F.col("kind") == "story", x.mask_facts(t)).otherwise(t)))
    rows = rows.withColumn("_sources", _sources(F.col("kind"), F.col("texts")))
    named = lambda s, i: F.concat(F.lit("<<REDACTED_"), F.regexp_extract(s, r"^<<REDACTED_([A-Z]+)_", 1), F.lit("_R"), F.col("leaf").cast("string"), F.lit("_"), x._number(i + 1), F.lit(">>"))
    rows = rows.withColumn("tokens", F.transform("_sources", lambda s, i: F.struct(named(s, i).alias("token"), s.alias("source"))))
    rows = rows.withColumn("_map", F.map_from_entries(F.transform("tokens", lambda p: F.struct(p["source"], p["token"]))))
    by = lambda pattern: F.transform("texts", lambda t: x.replaced(t, pattern, lambda m: F.try_element_at(F.col("_map"), m)))
    return rows.withColumn("texts", F.when(F.col("kind") == "story", by(x.STORY_TOKEN)).otherwise(by(x.TOKEN))).drop("_sources", "_map")


def allowed_report_tokens(rewritten: DataFrame, report: str = "report") -> DataFrame:
    """(report, tokens): every token that the report's answer may use."""
    return rewritten.select(report, F.explode("tokens.token").alias("t")).groupBy(report).agg(F.array_sort(F.collect_set("t")).alias("tokens"))


def report_values(rewritten: DataFrame, maps: DataFrame, report: str = "report") -> DataFrame:
    """(report, known): each report's map of values to report tokens, by way of the sources.

    maps (report, kind, place, member, known): the redaction map of each event that a leaf rests on; ``member`` is its number in a story and null otherwise. A
    value that several leaves hold has a token in each, so that the pairs are turned: token to value. Tokens without a value are left out.
    """
    pairs = rewritten.select(report, "kind", "place", F.explode("tokens").alias("p")).select(
        report, "kind", "place", F.regexp_extract("p.source", r"_E(\d+)_\d+>>$", 1).try_cast("int").alias("member"), F.regexp_replace("p.source", r"_E\d+_", "_").alias("own"), "p.token"
    )
    values = maps.select(report, "kind", "place", F.col("member").cast("int").alias("member"), F.explode(x.backward(F.col("known"))).alias("own", "value"))
    on = [pairs[c] == values[c] for c in (report, "kind", "place", "own")] + [pairs["member"].eqNullSafe(values["member"])]
    found = pairs.join(values, on).select(pairs[report], "token", "value").distinct()
    return found.groupBy(report).agg(F.map_from_entries(F.collect_list(F.struct("token", "value"))).alias("values"))


def restore_report(text: Column, values: Column) -> Column:
    """Report tokens turned back by a map of tokens to values; those without a value stay."""
    return let(F.struct(text.alias("t"), values.alias("v")), lambda s: x.replaced(s["t"], REPORT_TOKEN, lambda m: F.coalesce(F.try_element_at(s["v"], m), m)))
