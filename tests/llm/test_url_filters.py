import random
import subprocess
import sys

import duckdb
import pytest

from confuscope.llm.queries import ORACLE_SQL, QUERIES, URL_RULES
from confuscope.llm.url_filters import Rule, filter_urls

CANON = '<html><LINK  rel="canonical" href="{}"></html>'
PAGES = [
    (1, "http://a.example.net/fr/1", None),
    (2, "https://a.EXAMPLE.net/en/1?x=1", ""),
    (3, "http://example.com/de/x#top", ""),
    (4, "http://example.org/fr/x", ""),
    (5, "http://other.com/a", CANON.format("http://a.example.net/fr/1")),
    (6, "http://third.com/b", CANON.format("http://other.com/a")),
    (7, "http://www.example.org/fr/y", CANON.format("http://other.com/a")),
    (8, "http://free.com/p/q", "<link rel=canonical href='/p/r'>"),
    (9, "http://free.com/p/r", '<meta http-equiv="refresh" content="0; url=../x">'),
    (10, None, None), (11, "no-scheme.net/x", ""), (12, "", ""), (13, "http://net", ""), (14, "http://Ünet.net:80?q", ""),
    (1, "http://a.example.net/fr/1", None),
    (15, "//x://y.net/z", ""), (16, "http://moved.com/old", ""),
]


def judge(spark, rows=PAGES, **kw):
    df = spark.createDataFrame([(*r, "clash", "clash") for r in rows], "page_id long, url string, html string, host string, node string")
    return {r["page_id"]: r for r in filter_urls(df, URL_RULES, **kw).collect()}


def test_rules_and_aliases(spark):
    got = judge(spark)
    assert (got[1]["rule"], got[1]["verdict"]) == ("net/", "block")
    assert (got[2]["host"], got[2]["path"], got[2]["rule"], got[2]["verdict"]) == ("a.example.net", "/en/1", "example.net/en/", "allow")
    assert got[3]["verdict"] == "block" and got[4]["verdict"] == "allow"
    assert (got[5]["verdict"], got[5]["decided_by"]) == ("block", "alias")
    assert (got[6]["verdict"], got[6]["decided_by"]) == ("block", "alias")
    assert (got[7]["verdict"], got[7]["decided_by"]) == ("allow", "rule")  # explicit allow precedes
    assert got[8]["verdict"] == got[9]["verdict"] == "allow"
    for k in (10, 11, 12):
        assert (got[k]["host"], got[k]["path"], got[k]["rule"], got[k]["verdict"]) == ("", "", None, "allow")
    assert (got[13]["path"], got[13]["rule"]) == ("", None)
    assert got[14]["host"] == "Ünet.net:80".replace("Ü", "Ü") and got[14]["rule"] is None
    assert got[15]["host"] == "y.net"


def test_every_row_and_given_redirects(spark):
    df = spark.createDataFrame(PAGES, "page_id long, url string, html string")
    redirects = spark.createDataFrame([("http://moved.com/old", "http://b.net/new"), (None, "http://x.net/")], "src string, dst string")
    rows = filter_urls(df, URL_RULES, edges=redirects).collect()
    assert len(rows) == len(PAGES)
    assert {r["page_id"]: r["verdict"] for r in rows}[16] == "block"


def test_without_links_and_empty(spark):
    assert judge(spark, html_col=None)[5]["verdict"] == "allow"
    assert judge(spark, PAGES[:0]) == {}


def test_bad_rules():
    with pytest.raises(ValueError):
        Rule("deny", "net/")
    with pytest.raises(ValueError):
        Rule("block", "net")


def made_pages(rng, n):
    """Pages of a few hosts, of which many name another one as canonical, in chains and circles."""
    hosts = ["a.example.net", "example.com", "www.example.com", "free.org", "x.example.org", "other.io", "blog.other.io"]
    url = lambda: f"http{rng.choice(['', 's'])}://{rng.choice(hosts)}/{rng.choice(['en', 'de', 'fr'])}/{rng.randrange(n)}{rng.choice(['', '', '?page=2', '#top'])}"
    urls = [url() for _ in range(n)]
    tag = lambda: f'<p><link rel="canonical" href="{rng.choice(urls)}">' if rng.random() < 0.4 else "<p>canonical"
    return [(k, u, tag()) for k, u in enumerate(urls)]


def test_query_with_canonical_links_matches_its_sql(spark, tmp_path):
    rows = made_pages(random.Random(9), 400) + [(900, None, None), (901, "x", CANON.format("http://a.example.net/fr/1"))]
    spark.createDataFrame(rows, "page_id long, url string, html string").write.parquet(f"{tmp_path}/pages.parquet")
    got = [tuple(r) for r in QUERIES["op1_url_filters"](spark, str(tmp_path)).select("page_id", "host", "path", "rule", "verdict", "decided_by").collect()]
    db = duckdb.connect()
    db.sql(f"create view pages as select * from '{tmp_path}/pages.parquet/*.parquet'")
    want = db.sql(ORACLE_SQL["op1_url_filters"]).select("page_id, host, path, rule, verdict, decided_by").fetchall()
    assert sorted(map(str, got)) == sorted(map(str, want))
    assert sum(r[5] == "alias" for r in got) > 20


def test_many_rules_against_brute_force(spark):
    rng = random.Random(10)
    label = lambda: rng.choice("abcd")
    host = lambda: ".".join(label() for _ in range(rng.randrange(1, 4)))
    path = lambda: "/" + "".join(rng.choice("xy/") for _ in range(rng.randrange(4)))
    rules = [Rule(rng.choice(["allow", "block"]), host().upper() + path()) for _ in range(1500)]
    pages = [(k, f"http://{rng.choice(['', 'z.', 'Q.'])}{host()}{path()}", None) for k in range(300)] + [(300, "http://" + "a." * 3000 + "b/x", None), (301, "http://a..b/x", None)]
    got = {r["page_id"]: (r["rule"], r["verdict"]) for r in filter_urls(spark.createDataFrame(pages, "page_id long, url string, html string"), rules).collect()}
    table = spark.createDataFrame([(r.action, r.pattern) for r in rules], "action string, pattern string")
    assert got == {r["page_id"]: (r["rule"], r["verdict"]) for r in filter_urls(spark.createDataFrame(pages, "page_id long, url string, html string"), table).collect()}
    for k, u, _ in pages:
        h, _, p = u[7:].partition("/")
        h, p = h.lower(), "/" + p
        fits = []
        for r in rules:
            rh, _, rp = r.pattern.partition("/")
            if (h == rh.lower() or h.endswith("." + rh.lower())) and p.startswith("/" + rp):
                fits.append((-len(r.pattern), r.action, r.pattern))
        assert got[k] == ((min(fits)[2], min(fits)[1]) if fits else (None, "allow"))


def test_no_rules_and_long_texts(spark):
    df = spark.createDataFrame([(1, "http://" + "h" * 9_000 + "/" + "p/" * 40_000, CANON.format("/x") + "<link " * 20_000)], "page_id long, url string, html string")
    assert [r["verdict"] for r in filter_urls(df, []).collect()] == ["allow"]
    assert [r["verdict"] for r in filter_urls(df, URL_RULES).collect()] == ["allow"]


def test_generated_code_compiles(tmp_path):
    code = """
from pyspark.sql import SparkSession
from confuscope.llm.queries import URL_RULES
from confuscope.llm.url_filters import filter_urls
s = SparkSession.builder.master("local[2]").config("spark.ui.enabled", "false").config("spark.sql.shuffle.partitions", "2").getOrCreate()
df = s.createDataFrame([(1, "http://a.com/x", "<link rel=canonical href='/y'>"), (2, "http://b.net/", "")], "page_id long, url string, html string")
print(filter_urls(df, URL_RULES).count())
"""
    done = subprocess.run([sys.executable, "-c", code], capture_output=True, text=True, check=True)
    assert done.stdout.strip() == "2" and "Failed to compile" not in done.stderr
