"""What is dropped from a model's answer, why, and the audit rows that tell of it.

Lists stay in their rows: an answer's items are judged, grouped by reason and written out by array functions, without a shuffle. Only
references to vulnerabilities meet a table, the catalog, in a join on the id. Items keep their order. Null lists are empty ones;
a null item is an empty one. ``keys`` tell rows apart.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: The shape of a factor, the reasons, and the words for no factor.
FACTORS, FACTOR_LENGTH, SENTENCES, NO_FACTOR = 5, 80, ("The ", "This "), "insufficient evidence"
EMPTY, OVERSIZED, SENTENCE, ALL = "empty", "oversized", "sentence_start", "all_items_filtered"
FORMAT, UNKNOWN_TECHNIQUE, UNKNOWN_ID, UNSURE, DISABLED = "invalid_format", "not_in_vendored_mitre", "not_in_catalog", "could_not_consult", "source_disabled"
#: White space of Unicode and the byte order mark.
BLANK = r"^[\t\n\x0B\f\r \u00A0\u1680\u2000-\u200A\u2028\u2029\u202F\u205F\u3000\uFEFF]*\z"
TECHNIQUE = r"^T\d{4}(\.\d{3})?\z"
CVE = r"^CVE-\d{4}-\d{4,}\z"
#: Techniques of a dictionary, at the most: it goes into the plan.
DICTIONARY = 5000


def factor_reason(item: Column) -> Column:
    """Why a factor is dropped, null if it isn't; its length is counted in UTF-16 units."""
    units = F.length(F.encode(item, "UTF-16BE")) / 2
    sentence = item.startswith(SENTENCES[0]) | item.startswith(SENTENCES[1])
    return F.when(item.isNull() | item.rlike(BLANK), EMPTY).when(units > FACTOR_LENGTH, OVERSIZED).when(sentence, SENTENCE)


def _strings(items: Column) -> Column:
    return F.coalesce(items, F.array().cast("array<string>"))


def _dropped(items: Column, reason) -> Column:
    """(item, reason) of each dropped item."""
    return F.filter(F.transform(items, lambda x: F.struct(x.alias("item"), reason(x).alias("reason"))), lambda d: d.reason.isNotNull())


def judged_factors(factors: Column) -> Column:
    """kept (the first five that pass, or the words for none), dropped (item, reason), truncated (what passes beyond five), sentinel."""
    items = _strings(factors)
    good = F.filter(items, lambda x: factor_reason(x).isNull())
    kept = F.when(F.size(good) > 0, F.slice(good, 1, FACTORS)).otherwise(F.array(F.lit(NO_FACTOR)))
    beyond = F.slice(good, FACTORS + 1, F.greatest(F.size(good) - FACTORS, F.lit(0)))
    return F.struct(kept.alias("kept"), _dropped(items, factor_reason).alias("dropped"), beyond.alias("truncated"), (F.size(good) == 0).alias("sentinel"))


def by_reason(dropped: Column) -> Column:
    """(reason, items) for each reason, in order of appearance."""
    of = lambda r: F.transform(F.filter(dropped, lambda d: d.reason == r), lambda d: d["item"])
    return F.transform(F.array_distinct(dropped.getField("reason")), lambda r: F.struct(r.alias("reason"), of(r).alias("items")))


def factor_audit(answers: DataFrame, keys: list[str], axes: dict[str, str]) -> DataFrame:
    """keys, axis, reason, items, sentinel: a row for each axis (its name and its list's column) and reason of a drop, and one
    with the whole list where nothing passed. What is beyond the first five isn't told of."""
    rows = []
    for axis, column in axes.items():
        items, judged = _strings(F.col(column)), judged_factors(F.col(column))
        told = lambda r, i, s: F.struct(F.lit(axis).alias("axis"), r.alias("reason"), i.alias("items"), F.lit(s).alias("sentinel"))  # noqa: B023, E731
        rows.append(F.transform(by_reason(judged.getField("dropped")), lambda g: told(g.reason, g["items"], False)))
        rows.append(F.filter(F.array(told(F.lit(ALL), items, True)), lambda _: judged.getField("sentinel")))  # noqa: B023
    return answers.select(*keys, F.inline(F.concat(*rows)))


def judged_techniques(tags: Column, known: list[str]) -> Column:
    """valid tags and dropped ones (item, reason), by a dictionary of bounded size."""
    if len(known) > DICTIONARY:
        raise ValueError(f"a dictionary of {len(known)} techniques; {DICTIONARY} at the most")
    reason = lambda x: F.when(x.isNull() | ~x.rlike(TECHNIQUE), FORMAT).when(~x.isin(known), UNKNOWN_TECHNIQUE)
    items = _strings(tags)
    return F.struct(F.filter(items, lambda x: reason(x).isNull()).alias("valid"), _dropped(items, reason).alias("dropped"))


def technique_audit(answers: DataFrame, keys: list[str], column: str, known: list[str], version: str) -> DataFrame:
    """keys, reason, items and the dictionary's version: a row for each reason of an answer's dropped tags."""
    return answers.select(*keys, F.inline(by_reason(judged_techniques(F.col(column), known).getField("dropped"))), F.lit(version).alias("version"))


def judged_references(answers: DataFrame, keys: list[str], column: str, pivoted: DataFrame, enabled: list[str], complete: bool) -> DataFrame:
    """keys, valid (ids) and dropped (item, reason) of each answer's references to vulnerabilities.

    Ids are told in normal form, the first of equal ones alone; references without that form as they are. An id that only sources which
    aren't enabled know is dropped; one that none knows could not be consulted unless the catalog is ``complete``. ``pivoted`` has one
    row an id (``intel.cve_pivot``). An id that very many answers name is one key of the join, whose left side AQE splits.
    """
    refs = _strings(F.col(column))
    # A reference without normal form differs from all others, by its place.
    normal = lambda x: F.upper(F.regexp_replace(x, r"^\s+|\s+\z", ""))
    forms = F.transform(refs, lambda x, i: F.when(normal(x).rlike(CVE), normal(x)).otherwise(F.concat(F.lit("#"), i.cast("string"))))
    first = F.filter(F.transform(F.arrays_zip(refs.alias("ref"), forms.alias("form")), lambda r, i: F.struct(i.alias("place"), r.ref.alias("ref"), r.form.alias("form"))), lambda r: F.array_position(forms, r.form) == r.place + 1)
    named = answers.select(*keys, F.explode_outer(first).alias("r")).select(*keys, "r.*")
    known = pivoted.select(F.col("cve").alias("form"), F.size(F.array_intersect(F.split("sources", ","), F.array(*map(F.lit, enabled)).cast("array<string>"))).alias("backed"))
    formed = ~F.col("form").startswith("#")
    reason = F.when(~formed, FORMAT).when(F.col("backed").isNull(), UNKNOWN_ID if complete else UNSURE).when(F.col("backed") == 0, DISABLED)
    told = F.when(F.col("place").isNotNull(), F.struct("place", F.when(formed, F.col("form")).otherwise(F.col("ref")).alias("item"), reason.alias("reason")))
    judged = named.join(known, "form", "left").groupBy(*keys).agg(F.array_sort(F.collect_list(told)).alias("all"))
    valid = F.transform(F.filter("all", lambda x: x.reason.isNull()), lambda x: x["item"])
    dropped = F.transform(F.filter("all", lambda x: x.reason.isNotNull()), lambda x: F.struct(x["item"].alias("item"), x.reason.alias("reason")))
    return judged.select(*keys, valid.alias("valid"), dropped.alias("dropped"))


def reference_audit(judged: DataFrame, keys: list[str]) -> DataFrame:
    """keys, reason and items: a row for each reason of an answer's dropped references."""
    return judged.select(*keys, F.inline(by_reason(F.col("dropped"))))
