"""Queries of what is dropped from answers and of its audit rows. Importing this registers them."""

from __future__ import annotations

from pyspark.sql import functions as F

from quarryline.operators import drops as o
from quarryline.operators import intel as i
from quarryline.plans.catalog import query
from quarryline.sources import views as v

KNOWN = [f"T{n}" for n in range(1000, 1051)] + [f"T{n}.001" for n in range(1000, 1051, 5)]

# Factors are the lines (severity) and the sentences (likelihood) of whole documents.
_ITEMS = r"""axes AS (SELECT doc_id, 'severity' AS axis, coalesce(string_split(text, chr(10)), []::VARCHAR[]) AS items FROM documents UNION ALL SELECT doc_id, 'likelihood', coalesce(string_split(text, '. '), []::VARCHAR[]) FROM documents),
    item AS (SELECT doc_id, axis, unnest(items) AS item, generate_subscripts(items, 1) AS pos FROM axes),
    judged AS (SELECT *, CASE WHEN regexp_full_match(item, '[\t\n\x0B\f\r \x{00A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}\x{FEFF}]*') THEN 'empty'
        WHEN length(item) + length(regexp_replace(item, '[^\x{10000}-\x{10FFFF}]', '', 'g')) > 80 THEN 'oversized' WHEN starts_with(item, 'The ') OR starts_with(item, 'This ') THEN 'sentence_start' END AS reason FROM item),
    good AS (SELECT doc_id, axis, item, row_number() OVER (PARTITION BY doc_id, axis ORDER BY pos) AS nth FROM judged WHERE reason IS NULL)"""


def _answers(spark, d):
    return v.table(spark, d, "documents").select("doc_id", F.split("text", "\n").alias("severity_factors"), F.split("text", r"\. ").alias("likelihood_factors"))


@query("factors_judged", f"""WITH {_ITEMS} SELECT doc_id, axis, coalesce(kept, 'insufficient evidence') AS kept, coalesce(n_dropped, 0) AS n_dropped, coalesce(beyond, '') AS truncated, kept IS NULL AS sentinel FROM axes
    LEFT JOIN (SELECT doc_id, axis, string_agg(item, '|' ORDER BY nth) FILTER (WHERE nth <= 5) AS kept, string_agg(item, '|' ORDER BY nth) FILTER (WHERE nth > 5) AS beyond FROM good GROUP BY ALL) USING (doc_id, axis)
    LEFT JOIN (SELECT doc_id, axis, count(*) AS n_dropped FROM judged WHERE reason IS NOT NULL GROUP BY ALL) USING (doc_id, axis)""")
def _(spark, d):
    axes = F.array(*(F.struct(F.lit(a).alias("axis"), o.judged_factors(F.col(f"{a}_factors")).alias("j")) for a in ("severity", "likelihood")))
    rows = _answers(spark, d).select("doc_id", F.inline(axes))
    return rows.select("doc_id", "axis", F.array_join("j.kept", "|").alias("kept"), F.size("j.dropped").alias("n_dropped"), F.array_join("j.truncated", "|").alias("truncated"), "j.sentinel")


@query("factor_audit", f"""WITH {_ITEMS} SELECT doc_id, axis, reason, string_agg(item, '|' ORDER BY pos) AS items, false AS sentinel FROM judged WHERE reason IS NOT NULL GROUP BY doc_id, axis, reason
    UNION ALL SELECT doc_id, axis, 'all_items_filtered', array_to_string(items, '|'), true FROM axes ANTI JOIN good USING (doc_id, axis)""")
def _(spark, d):
    rows = o.factor_audit(_answers(spark, d), ["doc_id"], {"severity": "severity_factors", "likelihood": "likelihood_factors"})
    return rows.withColumn("items", F.array_join("items", "|"))


_TAG = "CASE WHEN l_partkey % 9 = 0 THEN 't' ELSE 'T' END || (1000 + l_partkey % 60) || CASE WHEN l_suppkey % 3 = 0 THEN '.00' || (1 + l_suppkey % 2) WHEN l_suppkey % 7 = 0 THEN '.1' ELSE '' END"


def _listed(spark, d, expression):
    """A list for each order: its lines' values, by line number."""
    rows = v.table(spark, d, "lineitem").select("l_orderkey", F.struct("l_linenumber", F.expr(expression).alias("x")).alias("s"))
    return rows.groupBy("l_orderkey").agg(F.array_sort(F.collect_list("s")).getField("x").alias("items"))


@query("technique_audit", f"""SELECT l_orderkey, reason, string_agg(x, '|' ORDER BY l_linenumber, x) AS items, 'v1' AS version FROM (SELECT *, CASE WHEN NOT regexp_full_match(x, 'T[0-9]{{4}}([.][0-9]{{3}})?') THEN 'invalid_format'
    WHEN substr(x, 2, 4)::INT > 1050 OR length(x) > 5 AND (substr(x, 6) <> '.001' OR substr(x, 2, 4)::INT % 5 > 0) THEN 'not_in_vendored_mitre' END AS reason FROM (SELECT l_orderkey, l_linenumber, {_TAG} AS x FROM lineitem)) WHERE reason IS NOT NULL GROUP BY l_orderkey, reason""")
def _(spark, d):
    return o.technique_audit(_listed(spark, d, _TAG), ["l_orderkey"], "items", KNOWN, "v1").withColumn("items", F.array_join("items", "|"))


_P = "CASE WHEN l_orderkey % 2 = 0 THEN l_partkey ELSE 1 + l_partkey % 5 END"
_REF = f"CASE l_linenumber % 4 WHEN 0 THEN ' cve-' || (2015 + ({_P}) % 10) || '-' || (10000 + {_P}) WHEN 1 THEN 'CVE-' || (2015 + ({_P}) % 10) || '-' || (10000 + {_P}) WHEN 2 THEN 'CVE-2015-' || (9000000 + l_partkey % 50) ELSE 'cve ' || l_partkey END"
_REFS = f"""ref AS (SELECT l_orderkey, l_linenumber, x, CASE WHEN regexp_full_match(upper(trim(x)), 'CVE-[0-9]{{4}}-[0-9]{{4,}}') THEN upper(trim(x)) END AS form FROM (SELECT l_orderkey, l_linenumber, {_REF} AS x FROM lineitem)),
    known AS (SELECT cve, bool_or(source IN ('kev', 'epss')) AS backed FROM cve GROUP BY cve),
    verdict AS (SELECT l_orderkey, l_linenumber, coalesce(form, x) AS item, CASE WHEN form IS NULL THEN 'invalid_format' WHEN backed IS NULL THEN 'MISS' WHEN NOT backed THEN 'source_disabled' END AS reason FROM ref LEFT JOIN known ON form = cve
        QUALIFY form IS NULL OR row_number() OVER (PARTITION BY l_orderkey, form ORDER BY l_linenumber, x) = 1)"""
_REFERENCE_SQL = f", {_REFS} SELECT l_orderkey, reason, string_agg(item, '|' ORDER BY l_linenumber, item) AS items FROM verdict WHERE reason IS NOT NULL GROUP BY l_orderkey, reason"


def _judged(spark, d, complete):
    return o.judged_references(_listed(spark, d, _REF), ["l_orderkey"], "items", i.cve_pivot(v.cve(spark, d)), ["kev", "epss"], complete)


@query("reference_audit", _REFERENCE_SQL.replace("MISS", "not_in_catalog"), "cve")
def _(spark, d):
    return o.reference_audit(_judged(spark, d, True), ["l_orderkey"]).withColumn("items", F.array_join("items", "|"))


@query("reference_audit_unsure", _REFERENCE_SQL.replace("MISS", "could_not_consult"), "cve")
def _(spark, d):
    return o.reference_audit(_judged(spark, d, False), ["l_orderkey"]).withColumn("items", F.array_join("items", "|"))


@query("references_valid", f", {_REFS} SELECT l_orderkey, coalesce(string_agg(item, '|' ORDER BY l_linenumber, item) FILTER (WHERE reason IS NULL), '') AS refs FROM verdict GROUP BY l_orderkey", "cve")
def _(spark, d):
    return _judged(spark, d, True).select("l_orderkey", F.array_join("valid", "|").alias("refs"))
