"""Queries of vendors' repositories. Importing this registers them."""

from __future__ import annotations

from pyspark.sql import functions as F

from quarryline.plans.catalog import query
from quarryline.sources import feeds as f
from quarryline.sources import repositories as r
from quarryline.sources import views as v

K = "p_partkey"
REPOSITORY = r.Repository(
    "acme", "intel", "main",
    [r.FileRule(r"^reports/.*/iocs\.txt$", classification="c2"), r.FileRule(r"^reports/.*\.md$", "text", hit_type="soft_reputation"), r.FileRule(r"^cib/.*\.txt$", deterministic=False)],
    "deterministic_ioc", "malware", context={"actor": "unknown", "malware_family": "Base"}, context_pattern=r"^reports/(?<actor>[a-z]+\d+)/", url_template="https://h.test/{owner}/{repo}/{ref}/{path}#{actor}{none}",
    readme_pattern=r"(?i)(^|/)readme\.md$", readme={"campaign": r"^title:\s*(.+)$", "malware_family": r"^family:\s*(?<value>\w+)"},
)


def _files(spark, d):
    part = v.table(spark, d, "part")
    lists = part.selectExpr(f"CASE WHEN {K} % 7 = 0 THEN concat('cib/', {K}, '.txt') ELSE concat('reports/apt', {K} % 20, '/', {K}, '/iocs.txt') END AS path", f"concat('# x\\nd', {K}, '.test\\r\\n\\nd', {K}, '.test\\nall.test') AS content")
    own = part.where(f"{K} % 4 = 0").selectExpr(f"concat('reports/apt', {K} % 20, '/', {K}, '/README.md') AS path", f"concat('---\\ntitle: Own ', {K}, ' \\nfamily: Fam', {K} % 3, '\\n---') AS content")
    camps = part.where(f"{K} <= 20").selectExpr(f"concat('reports/apt', {K} % 20, '/Readme.md') AS path", f"concat('title: Camp ', {K} % 20) AS content")
    return lists.unionByName(own).unionByName(camps).unionByName(part.selectExpr(f"concat('bin/', {K}, '.exe') AS path", "'evil.test' AS content"))


@query("vendor_rows", f"""WITH l AS (SELECT {K} AS k, {K} % 20 AS g, CASE WHEN {K} % 7 = 0 THEN 'cib/' || {K} || '.txt' ELSE 'reports/apt' || {K} % 20 || '/' || {K} || '/iocs.txt' END AS path FROM part),
    i AS (SELECT *, unnest(['d' || k || '.test', 'all.test']) AS indicator FROM l),
    c AS (SELECT 'DOMAIN' AS entity, indicator, CASE WHEN k % 7 = 0 THEN 'soft_reputation' ELSE 'deterministic_ioc' END AS hit_type, CASE WHEN k % 7 = 0 THEN 'malware' ELSE 'c2' END AS classification, CASE WHEN k % 7 = 0 THEN 'unknown' ELSE 'apt' || g END AS actor,
        CASE WHEN k % 7 = 0 THEN NULL WHEN k % 4 = 0 THEN 'Own ' || k ELSE 'Camp ' || g END AS campaign, CASE WHEN k % 7 > 0 AND k % 4 = 0 THEN 'Fam' || k % 3 ELSE 'Base' END AS malware_family,
        'https://h.test/acme/intel/main/' || path || '#' || CASE WHEN k % 7 = 0 THEN '{{actor}}' ELSE 'apt' || g END || '{{none}}' AS report_url, path FROM i)
    SELECT *, 'acme/intel@main:' || path AS origin FROM c""")
def _(spark, d):
    return r.collected(_files(spark, d), REPOSITORY)


@query("vendor_skipped", f"SELECT 'bin/' || {K} || '.exe' AS path FROM part")
def _(spark, d):
    return r.skipped(_files(spark, d), REPOSITORY)


@query("feeds_unparseable", f"SELECT {K} % 50 AS feed, count(*) > 0 AND count(*) FILTER (WHERE {K} % 50 % 3 = 0) = 0 AS unparseable FROM part GROUP BY 1")
def _(spark, d):
    lines = v.table(spark, d, "part").selectExpr(f"{K} % 50 AS feed", f"CASE WHEN {K} % 50 % 3 = 0 THEN concat('1.2.3.', {K} % 256, '/32') ELSE 'no range' END AS value")
    parsed = lines.where(f.cidr(F.col("value")).isNotNull())
    return f.unparseable_by(lines, parsed, "feed")
