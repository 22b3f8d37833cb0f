"""Constant cases beside their SQL, and invariants of all check results."""

import duckdb
import pytest
from pyspark.sql import functions as F

from siftline.functions import sql as functions
from siftline.functions import urls
from siftline.operators.audit import audit
from siftline.operators.registry import CHECKS
from siftline.plans import cases

SQL = cases.sql()


def plain(v):
    if isinstance(v, list):
        return [plain(x) for x in v]
    return round(v, 9) if isinstance(v, float) else str(v) if hasattr(v, "as_tuple") else v


def rows(columns, values):
    at = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted(([plain(r[i]) for i in at] for r in values), key=repr)


@pytest.mark.parametrize("name", sorted(cases.CASES))
def test_case_equals_its_sql(spark, name):
    got = cases.CASES[name](spark, "")
    want = duckdb.sql(SQL[name])
    assert sorted(got.columns) == sorted(want.columns)
    assert rows(got.columns, [tuple(r) for r in got.collect()]) == rows(want.columns, want.fetchall())


def test_every_finding_says_what_to_do(spark):
    """All branches that occur in the cases: advice with each warning and error, examples that name the page."""
    html = [(i, "https://example.com/page", f"<html><head>{h}</head><body>{b}</body></html>") for i, (_, _, _, h, b) in enumerate(cases.BRANCHES)]
    r = audit(spark.createDataFrame(html, "page_id long, url string, html string")).results
    found = r.select("check_key", "status", "severity", "message", "why", "recommendation", "code_example", "unavailable_reason").distinct().collect()
    assert {x.check_key for x in found} == {c.key for c in CHECKS}
    for x in found:
        assert x.message and x.why and (x.status not in ("WARNING", "ERROR") or x.recommendation) and (x.status != "UNAVAILABLE" or x.unavailable_reason)
        assert x.status in ("WARNING", "ERROR") or x.severity == "INFO"
    said = {(x.check_key, x.message): x for x in found}
    missing, several = said["canonical", "No canonical address is declared."], said["canonical", "Several canonical addresses are declared."]
    assert missing.recommendation != several.recommendation and missing.code_example == '<link rel="canonical" href="https://example.com/page">' and several.code_example is None
    assert r.filter(F.col("status") == "PASS").filter("code_example IS NOT NULL").count() == 0


URLS = ["https://www.Example.com/a/b//?x=1#y", "http://example.co.uk", "https://u:p@a.b.example.co.uk:8080/?", "https://[2001:db8::1]:80/x", "ftp://example.com/x", "example.com", "https://", "", None, "HTTP://EXAMPLE.ORG.//"]


def test_sql_names_say_what_the_columns_say(spark):
    functions.register(spark)
    spark.createDataFrame(list(enumerate(URLS)), "i int, u string").createOrReplaceTempView("sql_urls")
    u = F.col("u")
    own = spark.table("sql_urls").select("i", urls.host_of(u), urls.path_of(u), urls.query_of(u), urls.registrable_domain(urls.host_of(u)), urls.canonical_key(u))
    said = spark.sql("SELECT i, url_host(u), url_path(u), url_query(u), registrable_domain(url_host(u)), canonical_key(u) FROM sql_urls")
    assert sorted(map(tuple, said.collect())) == sorted(map(tuple, own.collect()))
    links = spark.sql("""SELECT * FROM html_links('<a href="/x">one</a><a href="https://b.org/">two</a>', 'https://a.org/')""").collect()
    assert [(r.ordinal, r.resolved, r.kind, r.anchor_text) for r in links] == [(0, "https://a.org/x", "internal", "one"), (1, "https://b.org/", "external", "two")]


def test_the_guard_by_its_sql_name(spark):
    functions.register(spark)
    hosts = ["8.8.8.8", "10.0.0.1", "[::1]", "[2606:4700::1111]", "[::ffff:8.8.8.8]", "[::ffff:10.0.0.1]", "[64:ff9b::8.8.8.8]", "[2002:a00:1::]", "[fe80::1]", "[1::2::3]", "[:::]", "[::1.2.3]", "[1:2:3:4:5:6:7:8]", "[1:2:3]", "127.1", "0x08080808", "0x7f.1", "010.8.8.8", "08.1.1.1", "256.1", "1.16777216", "99999999999999999999999", "4294967295", "134744072", "a.example.com", "localhost", "x.localhost", "printer.local", "single", "metadata.goog", "a.test.", "example.com.", "1.2.3.4.5", "u@example.com", "example.com:8080", "example.com:80", "ex ample.com", "ex%61mple.com"]
    given = [f"http://{h}/x" for h in hosts] + hosts + list(cases.URLS_TYPED) + [" example.com\u00a0", "x" * 2050, None, "https://", "http://?"]
    spark.createDataFrame(list(enumerate(given)), "i int, t string").createOrReplaceTempView("typed_here")
    got = {r.i: r.code for r in spark.sql("SELECT i, url_guard(t) AS code FROM typed_here").collect()}
    want = {r.i: r.code for r in spark.table("typed_here").select("i", urls.guard(F.col("t"))["code"].alias("code")).collect()}
    assert {given[i]: c for i, c in got.items()} == {given[i]: c for i, c in want.items()} and len(set(want.values())) == 3


def test_only_some_headers_are_kept(spark):
    fetch = {"ok": True, "initial_status": 200, "final_status": 200, "redirects": [], "headers": {"X-Robots-Tag": "noindex", "Set-Cookie": "secret", "Content-Type": "text/html"}}
    fetches = spark.createDataFrame([(1, *fetch.values())], "page_id long, ok boolean, initial_status int, final_status int, redirects array<struct<url:string,status:int,location:string>>, headers map<string,string>")
    a = audit(spark.createDataFrame([(1, "https://a.org/", "<p>x</p>")], "page_id long, url string, html string"), fetches)
    assert a.pages.select("fetch.headers").first()[0] == {"x-robots-tag": "noindex", "content-type": "text/html"}
    assert a.results.filter("check_key = 'robots-meta'").first().value == "noindex"
