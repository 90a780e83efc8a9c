"""Public suffixes, address classes and extraction on the cases where shortcuts go wrong."""

import ipaddress
import os

import pytest
from pyspark.sql import functions as F

from quarryline.functions import domains, network
from quarryline.operators import indicators
from quarryline.sources import feeds
from tests.test_catalog import spark  # noqa: F401

RULES = ["// remark", "nz", "co.nz", "*.ck", "!www.ck", "jp", "*.kawasaki.jp", "!city.kawasaki.jp", "com", "公司.cn", "cn", "// ===BEGIN PRIVATE DOMAINS===", "blog.com", "// ===END PRIVATE DOMAINS===", "org"]


@pytest.mark.parametrize("host,want,strict", [
    ("a.b.c.co.nz", "c.co.nz", "c.co.nz"), ("co.nz", None, None), ("c.nz", "c.nz", "c.nz"), ("a.b.c.ck", "b.c.ck", "b.c.ck"), ("c.ck", None, None), ("a.www.ck", "www.ck", "www.ck"), ("www.ck", "www.ck", "www.ck"),
    ("y.kawasaki.jp", None, None), ("w.x.y.kawasaki.jp", "x.y.kawasaki.jp", "x.y.kawasaki.jp"), ("city.kawasaki.jp", "city.kawasaki.jp", "city.kawasaki.jp"), ("A.B.COM.", "b.com", "b.com"), ("u.blog.com", "blog.com", "blog.com"),
    ("x.unknown", "x.unknown", None), ("com", None, None), ("10.0.0.1", None, None), ("", None, None), (None, None, None), ("a..com", None, None), ("x.xn--55qx5d.cn", "x.xn--55qx5d.cn", "x.xn--55qx5d.cn"), ("-a.com", None, None), ("a.org", "a.org", "a.org"),
])
def test_suffix_rules(host, want, strict):
    rules = domains.SuffixRules(RULES)
    assert rules.registered(host) == want and rules.registered(host, strict=True) == strict
    if host == "u.blog.com":
        assert domains.SuffixRules(RULES, private=True).registered(host) == "u.blog.com"


def test_rules_from_a_file(spark, tmp_path, monkeypatch):  # noqa: F811
    (tmp_path / "list.dat").write_text("\n".join(RULES), encoding="utf-8")
    rows = spark.createDataFrame([("a.b.c.co.nz",), (None,), ("a.www.ck",)], "host string")
    got = domains.with_registered(rows, "host", domains.read_rules(spark, str(tmp_path / "list.dat"))).collect()
    assert {r.host: r.registered for r in got} == {"a.b.c.co.nz": "c.co.nz", None: None, "a.www.ck": "www.ck"}
    monkeypatch.setattr(domains, "MOST_RULES", 3)
    with pytest.raises(ValueError, match="more than 3"):
        domains.read_rules(spark, str(tmp_path / "list.dat"))


@pytest.mark.skipif(not os.path.exists("/usr/share/publicsuffix/public_suffix_list.dat"), reason="the public list isn't there")
def test_the_whole_public_list(spark):  # noqa: F811
    rules = domains.read_rules(spark, "/usr/share/publicsuffix/public_suffix_list.dat")
    for host, want in (("a.b.co.uk", "b.co.uk"), ("x.y.city.kawasaki.jp", "city.kawasaki.jp"), ("a.b.c.ck", "b.c.ck"), ("a.www.ck", "www.ck"), ("example.com", "example.com"), ("co.nz", None)):
        assert rules.registered(host, strict=True) == want


def test_address_classes(spark):  # noqa: F811
    edges = ["100.64.0.1", "192.0.2.9", "198.18.0.0", "198.19.255.255", "203.0.113.9", "224.0.0.1", "239.255.255.255", "240.0.0.1", "255.255.255.255", "0.0.0.0", "0.1.2.3", "169.254.1.1", "127.0.0.1", "10.1.1.1", "172.31.255.255", "192.168.0.1"]
    edges += ["2001:db8::1", "2002::1", "ff00::1", "::", "::1", "fe80::1", "fd00::1", "64:ff9b::1", "2001::1", "100::1", "::ffff:10.0.0.1", "::ffff:203.0.113.9"]
    public = ["8.8.8.8", "100.63.255.255", "100.128.0.0", "198.17.255.255", "198.20.0.0", "223.255.255.255", "172.32.0.0", "203.0.114.0", "2600::1", "2003::1", "::ffff:8.8.8.8", "2a00:1450::1"]
    rows = spark.createDataFrame([(a,) for a in [*edges, *public, "no", None]], "a string").withColumn("h", network.ip_hex(F.col("a")))
    got = {r.a: r.p for r in rows.select("a", network.is_public(F.col("h")).alias("p")).collect()}
    assert got == {a: False for a in edges} | {a: True for a in public} | {"no": None, None: None}
    # Each block's edges: inside it isn't public, and what Python's library takes for global outside any block is.
    blocks = [ipaddress.ip_network(b) for _, b in network.SPECIAL if b != "::ffff:0:0/96"]
    at = sorted({str(b[i]) for b in blocks for i in (0, -1)})
    beside = sorted({str(a) for b in blocks for a in (b[0] - 1 if int(b[0]) else b[0], b[-1] + 1 if int(b[-1]) < 2**b.max_prefixlen - 1 else b[-1]) if not any(a in x for x in blocks if x.version == a.version)})
    rows = spark.createDataFrame([(a,) for a in [*at, *beside]], "a string")
    got = {r.a: r.p for r in rows.select("a", network.is_public(network.ip_hex(F.col("a"))).alias("p")).collect()}
    assert not any(got[a] for a in at) and all(got[a] for a in beside)


def test_extraction_by_rules_and_endings(spark):  # noqa: F811
    note = "script.js readme.txt page.html a.b.c.co.nz co.nz, http://q.c.co.nz/x 010.1.1.1 08.1.1.1 203.0.113.9 <<REDACTED_IP_001>> <<REDACTED_IP_002>> x.unknown"
    known = {"1.1.1.1": "<<REDACTED_IP_001>>", "2.2.2.2": "<<REDACTED_IP_001>>", "9.9.9.9": "<<REDACTED_IP_002>>"}
    rows = spark.createDataFrame([(1, note, known), (2, None, None)], "id int, note string, known map<string,string>")
    get = lambda **more: {(r.entity, r.value): (tuple(r.candidates), r.public) for r in indicators.extract_all(rows, "id", "note", "known", **more).collect()}
    got = get(rules=domains.SuffixRules(RULES), strict=True)
    assert got == {
        ("IP", "9.9.9.9"): (("9.9.9.9",), True), ("IP", "8.1.1.1"): (("8.1.1.1",), True), ("IP", "203.0.113.9"): (("203.0.113.9",), False), ("DOMAIN", "a.b.c.co.nz"): (("a.b.c.co.nz",), None),
        ("URL", "http://q.c.co.nz/x"): (("http://q.c.co.nz/x", "q.c.co.nz", "c.co.nz"), None),
    }
    assert ("DOMAIN", "x.unknown") in get(rules=domains.SuffixRules(RULES)) and ("DOMAIN", "script.js") not in get()


def test_prose_feeds(spark):  # noqa: F811
    rows = spark.createDataFrame([(1, "c2: evil.test!\nnote: gate.php analysis.md other.test\nc2: (http://a.b/c?)\"}")], "k int, t string")
    got = {(r.entity, r.indicator) for r in feeds.free_text_all(rows, "k", "t", r"^c2:").collect()}
    assert got == {("DOMAIN", "evil.test"), ("URL", "http://a.b/c")}
    assert {r.indicator for r in feeds.free_text_all(rows, "k", "t").where("entity = 'DOMAIN'").collect()} == {"evil.test", "other.test"}


def test_vendor_context_by_strength(spark):  # noqa: F811
    from quarryline.sources import repositories as r

    files = [
        ("README.md", "title: Root\nhttps://root.test/report"), ("a/b/notes.txt", "d1.test\n# no\nd2.test\nd1.test"), ("a/README.md", "nothing here"), ("a/b/README.md", "Family: Worm  "), ("x/c1/list.txt", "d1.test"), ("x/c2/list.txt", "d1.test"),
        ("x/c2/again.txt", "d1.test"), ("x/c2/prose.md", "see evil.test, gate.php and 1.2.3.4"), ("x/c2/run.exe", "d9.test"), ("x/c2/empty.txt", None),
    ]
    repository = r.Repository(
        "o", "n", "v1", [r.FileRule(r"\.txt$", hit_type="deterministic_ioc"), r.FileRule(r"prose\.md$", "text", deterministic=False)], context={"campaign": "Base", "actor": "Someone"}, context_pattern=r"^x/(?<campaign>c\d)/",
        readme_pattern=r"(^|/)README\.md$", readme={"campaign": r"^title: (?<value>\w+)", "malware_family": r"^Family:\s*(.+)$", "report_url": r"https?://\S+"},
    )
    rows = spark.createDataFrame(files, "path string, content string")
    got = {(x.indicator, x.campaign, x.malware_family, x.report_url, x.hit_type, x.path) for x in r.collected(rows, repository).collect()}
    assert got == {
        ("d1.test", "Base", "Worm", None, "deterministic_ioc", "a/b/notes.txt"), ("d2.test", "Base", "Worm", None, "deterministic_ioc", "a/b/notes.txt"),  # the nearest README that says anything hides the root's
        ("d1.test", "c1", None, "https://root.test/report", "deterministic_ioc", "x/c1/list.txt"), ("d1.test", "c2", None, "https://root.test/report", "deterministic_ioc", "x/c2/again.txt"),
        ("evil.test", "c2", None, "https://root.test/report", "soft_reputation", "x/c2/prose.md"), ("1.2.3.4", "c2", None, "https://root.test/report", "soft_reputation", "x/c2/prose.md"),
    }
    assert sorted(x.path for x in r.skipped(rows, repository).collect()) == ["README.md", "a/README.md", "a/b/README.md", "x/c2/run.exe"]
