"""Constant cases: expressions on inputs typed here, with the answers that each must give as SQL.

They read no table, so they are not registered as queries; tests run each beside its SQL.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import sql as functions
from ..functions.ip import classified, classify_ipv4, join_ranges, ranges
from ..functions.urls import guard, same_site
from ..operators import advice, analytics, dns, psi, report, responses, scoring
from ..operators import registry as reg
from ..operators.audit import audit, origin
from ..sources import store
from ..streaming import limits
from .queries import ROBOTS, _values

ADDRESSES = ("8.8.8.8", "10.1.2.3", "127.0.0.1", "100.64.0.1", "169.254.169.254", "172.31.255.255", "172.32.0.1", "192.0.2.9", "198.19.0.1", "203.0.113.7", "224.0.0.1", "255.255.255.255", "1.1.1.1", "01.2.3.4", "256.1.1.1", "nonsense")
ADDRESSES6 = ("::", "::1", "::ffff:10.0.0.1", "::ffff:8.8.8.8", "64:ff9b::8.8.8.8", "64:ff9b:1::1", "2002:0a00:0001::", "2001:db8::1", "2001::1", "fc00::1", "fe80::1", "ff02::1", "2606:4700::1111", "::8.8.8.8", "1::2::3", "100::1")
URLS_TYPED = ("example.com/page", "https://example.com", "http://localhost/", "ftp://example.org/", "https://user@example.org/", "https://example.com:8080/", "http://192.168.1.1/", "http://8.8.8.8/x", "", "a b", "javascript:alert(1)", "https://printer.local/", "https://single/", "http://example.org:80/a#b", "https://metadata.google.internal/")
PSI = '{"lighthouseResult":{"finalUrl":"https://example.com/","categories":{"performance":{"score":0.876}},"audits":{"largest-contentful-paint":{"displayValue":"2.1 s","numericValue":2100.5,"score":0.91},"speed-index":{"displayValue":"4.0 s","numericValue":4000,"score":0.5},"cumulative-layout-shift":{"displayValue":"0.3","numericValue":0.3,"score":0.2},"unused-css":{"title":"Unused CSS","description":"See [docs](https://example.com).","score":0.3,"details":{"type":"opportunity","overallSavingsMs":320}},"render-blocking":{"title":"Render blocking","description":"Slow.","score":0.4,"details":{"type":"opportunity","overallSavingsMs":900}},"tiny":{"title":"Tiny","description":"-","score":0.9,"details":{"type":"opportunity","overallSavingsMs":20}},"table":{"title":"Table","description":"-","score":1,"details":{"type":"table","overallSavingsMs":999}}}},"loadingExperience":{"overall_category":"FAST","metrics":{"CUMULATIVE_LAYOUT_SHIFT_SCORE":{"percentile":5,"category":"FAST"},"LARGEST_CONTENTFUL_PAINT_MS":{"percentile":1900,"category":"FAST"},"INTERACTION_TO_NEXT_PAINT":{"percentile":350,"category":"AVERAGE"}}}}'
DNS = (("8.8.8.8", None), ("10.0.0.1", None), ("a.example", ["1.1.1.1", "2606:4700::1111"]), ("b.example", ["1.1.1.1", "192.168.0.5"]), ("c.example", []), ("d.example", None), ("[::1]", None), ("e.example", ["::ffff:127.0.0.1"]))
TYPED = ("example.com", " https://a.b/c ", "localhost", "a b.c", "", "ftp://x.y", "http://x.y:80?q", "mailto:a@b.c", "x.y/z#f")
SCORED = (("all pass", "PASS", "INFO", "PASS", "INFO"), ("technical left out", "UNAVAILABLE", "INFO", "PASS", "INFO"), ("all critical", "ERROR", "CRITICAL", "ERROR", "CRITICAL"), ("nothing measured", "UNAVAILABLE", "INFO", "UNAVAILABLE", "INFO"), ("one medium", "WARNING", "MEDIUM", "PASS", "INFO"))
EVENTS = 'event: x\ndata: {"type":"start"}\n\ndata: {"type":"stage","stage":"fetching"}\n\n: ping\n\ndata: {"type":"stage","sta'
#: key, status, severity, and a page (head, body) that ends there.
BRANCHES = (
    ("title", "ERROR", "CRITICAL", "<title></title>", ""),
    ("title", "WARNING", "MEDIUM", "<title>Short</title>", ""),
    ("title", "WARNING", "LOW", "<title>" + "t" * 70 + "</title>", ""),
    ("meta-description", "WARNING", "MEDIUM", "<title>x</title>", ""),
    ("language", "PASS", "INFO", "", ""),
    ("viewport", "PASS", "INFO", '<meta name="viewport" content="width=device-width, initial-scale=1">', ""),
    ("charset", "PASS", "INFO", '<meta charset="utf-8">', ""),
    ("image-alt", "INFO", "INFO", "", "<p>none</p>"),
    ("json-ld", "PASS", "INFO", '<script type="application/ld+json">{"@type":"Article"}</script>', ""),
    ("robots-meta", "ERROR", "CRITICAL", '<meta name="robots" content="noindex">', ""),
    ("canonical", "PASS", "INFO", '<link rel="canonical" href="https://example.com/page">', ""),
    ("twitter-card", "PASS", "INFO", '<meta name="twitter:card" content="summary">', ""),
    ("title", "PASS", "INFO", "<title>An example page about roll forming</title>", ""),
    ("title", "WARNING", "MEDIUM", "<title>One</title><title>Two</title>", ""),
    ("title", "WARNING", "MEDIUM", "<title>" + "A very descriptive title " * 5 + "</title>", ""),
    ("meta-description", "PASS", "INFO", '<meta name="description" content="' + "A page that says what roll forming is and where it is used. " * 2 + '">', ""),
    ("h1", "PASS", "INFO", "", "<h1>One</h1>"),
    ("h1", "WARNING", "HIGH", "", "<p>No heading</p>"),
    ("h1", "WARNING", "LOW", "", "<h1>One</h1><h1>Two</h1>"),
    ("heading-structure", "WARNING", "LOW", "", "<h1>One</h1><h2></h2>"),
    ("heading-structure", "WARNING", "LOW", "", "<h1>One</h1><h2>Two</h2><h4>Four</h4>"),
    ("heading-structure", "PASS", "INFO", "", "<h1>One</h1><h2>Two</h2><h3>Three</h3><h2>Two again</h2>"),
    ("image-alt", "PASS", "INFO", "", '<img src="/divider.png" alt="">'),
    ("image-alt", "WARNING", "MEDIUM", "", '<a href="/x"><img src="/a.png"></a>'),
    ("canonical", "WARNING", "MEDIUM", "", ""),
    ("canonical", "ERROR", "HIGH", '<link rel="canonical" href="https://example.com/a"><link rel="canonical" href="https://example.com/b">', ""),
    ("canonical", "ERROR", "HIGH", '<link rel="canonical" href="ht!tp://%%%">', ""),
    ("canonical", "WARNING", "MEDIUM", '<link rel="canonical" href="https://example.com/elsewhere">', ""),
    ("canonical", "WARNING", "HIGH", '<link rel="canonical" href="https://someone-else.com/page">', ""),
    ("canonical", "WARNING", "LOW", '<link rel="canonical" href="/page">', ""),
    ("robots-meta", "PASS", "INFO", "", ""),
    ("robots-meta", "ERROR", "CRITICAL", '<meta name="robots" content="none">', ""),
    ("robots-meta", "INFO", "INFO", '<meta name="robots" content="max-snippet:-1, noarchive">', ""),
    ("viewport", "WARNING", "HIGH", "", ""),
    ("charset", "INFO", "INFO", '<meta charset="iso-8859-1">', ""),
    ("word-count", "PASS", "INFO", "", "<p>" + "word " * 500 + "</p>"),
    ("word-count", "WARNING", "MEDIUM", "", "<p>Hi</p>"),
    ("content-rendering", "WARNING", "MEDIUM", "", '<div id="root"></div>' + "<div class='x'></div>" * 1200),
    ("json-ld", "INFO", "INFO", "", ""),
    ("json-ld", "ERROR", "HIGH", '<script type="application/ld+json">{bad json}</script>', ""),
    ("open-graph", "WARNING", "MEDIUM", "", ""),
    ("open-graph", "PASS", "INFO", '<meta property="og:title" content="T"><meta property="og:description" content="D"><meta property="og:image" content="https://example.com/i.jpg">', ""),
    ("twitter-card", "INFO", "INFO", '<meta property="og:title" content="T">', ""),
    ("favicon", "WARNING", "LOW", "", ""),
    ("favicon", "PASS", "INFO", '<link rel="shortcut icon" href="/i.ico"><link rel="apple-touch-icon" href="/t.png">', ""),
    ("microdata", "INFO", "INFO", "", ""),
    ("microdata", "PASS", "INFO", "", '<div itemscope itemtype="https://schema.org/Product"><p typeof="Person">x</p></div>'),
    ("content-structure", "UNAVAILABLE", "INFO", "", "<p>" + "word " * 299 + "</p>"),
    ("content-structure", "WARNING", "MEDIUM", "", "<p>" + "word " * 601 + "</p>"),
    ("content-structure", "WARNING", "LOW", "", "<h2>a</h2><h3>b</h3><p>" + "word " * 1201 + "</p>"),
    ("content-structure", "WARNING", "LOW", "", "<h2>a</h2>" + "word " * 301),
    ("content-structure", "PASS", "INFO", "", "<h2>a</h2><p>" + "word " * 700 + "</p>"),
    ("internal-links", "WARNING", "MEDIUM", "", '<a href="https://other.org/">o</a>'),
    ("internal-links", "WARNING", "MEDIUM", "", '<a href="/a" rel="nofollow">a</a><a href="/b" rel="nofollow ugc">b</a>'),
    ("internal-links", "PASS", "INFO", "", '<a href="/a" rel="nofollow">a</a><a href="/b">b</a>'),
    ("external-links", "INFO", "INFO", "", '<a href="/a">a</a>'),
    ("external-links", "PASS", "INFO", "", '<a href="https://other.org/" rel="sponsored">o</a><a href="https://third.org/">t</a>'),
    ("external-links", "PASS", "INFO", "", '<a href="https://other.org/">o</a>'),
    ("link-quality", "INFO", "INFO", "", "<p>none</p>"),
    ("link-quality", "PASS", "INFO", "", '<a href="/a">The price list</a>'),
    ("link-quality", "WARNING", "LOW", "", '<a href="/a">Click here!</a>'),
    ("link-quality", "WARNING", "LOW", "", '<a href="https://other.org/" target="_blank">Another site</a>'),
    ("link-quality", "WARNING", "MEDIUM", "", '<a href="">x</a>' * 6),
    ("link-quality", "WARNING", "LOW", "", '<a href="javascript:void(0)">Open</a>'),
    ("image-alt", "WARNING", "LOW", "", '<img src="a" alt="A"><img src="b" alt="B"><img src="c">'),
    ("json-ld", "WARNING", "MEDIUM", '<script type="application/ld+json">{bad}</script><script type="application/ld+json">{"@type":"X"}</script>', ""),
    ("json-ld", "WARNING", "LOW", '<script type="application/ld+json">{"name":"x"}</script>', ""),
    ("open-graph", "WARNING", "LOW", '<meta property="og:title" content="T"><meta property="og:image" content="https://example.com/i.jpg">', ""),
    ("open-graph", "PASS", "INFO", "".join(f'<meta property="og:{k}" content="x">' for k in ("title", "description", "image", "url", "type")), ""),
    ("twitter-card", "WARNING", "LOW", '<meta name="twitter:title" content="T">', ""),
    ("twitter-card", "WARNING", "LOW", '<meta name="twitter:card" content="poster">', ""),
    ("viewport", "WARNING", "MEDIUM", '<meta name="viewport" content="width=1024">', ""),
    ("viewport", "WARNING", "LOW", '<meta name="viewport" content="width=device-width, user-scalable=no">', ""),
    ("robots-meta", "WARNING", "MEDIUM", '<meta name="robots" content="nofollow">', ""),
    ("robots-meta", "PASS", "INFO", '<meta name="robots" content="index, follow">', ""),
)
#: Cases without a warning that carry advice all the same.
ADVISED = (32, 34, 38, 41, 42, 57)
WELL = {"status": 200, "asked": "https://example.com/page", "end": "https://example.com/page", "hops": 0, "retrieved": True, "robots": 200, "verdict": "allowed", "rule": None, "map": True, "kind": "urlset", "listed": "yes"}
#: key, status, severity, value, and what differs from a page where all is well.
FETCHED = (
    ("http-status", "PASS", "INFO", "200 OK", {}),
    ("http-status", "ERROR", "CRITICAL", "404 Not Found", {"status": 404}),
    ("http-status", "ERROR", "CRITICAL", "410 Not Found", {"status": 410}),
    ("http-status", "ERROR", "CRITICAL", "503 Server Error", {"status": 503}),
    ("http-status", "ERROR", "HIGH", "403", {"status": 403}),
    ("http-status", "WARNING", "MEDIUM", "304", {"status": 304}),
    ("redirects", "PASS", "INFO", "None", {}),
    ("redirects", "WARNING", "MEDIUM", "10 redirects", {"hops": 10}),
    ("https", "ERROR", "CRITICAL", "HTTP only", {"asked": "http://example.com/page", "end": "http://example.com/page"}),
    ("https", "PASS", "INFO", "HTTPS (redirected)", {"asked": "http://example.com/page"}),
    ("redirects", "PASS", "INFO", "1 redirect", {"asked": "http://example.com/page", "hops": 1}),
    ("redirects", "WARNING", "LOW", "3 redirects", {"hops": 3}),
    ("robots-txt", "UNAVAILABLE", "INFO", "Unable to determine", {"retrieved": False, "verdict": "unknown"}),
    ("robots-txt", "PASS", "INFO", "Not present", {"robots": 404}),
    ("robots-txt", "WARNING", "MEDIUM", "Potentially blocked", {"verdict": "unknown", "rule": "Disallow: /*?"}),
    ("robots-txt", "ERROR", "CRITICAL", "Path disallowed", {"verdict": "disallowed", "rule": "Disallow: /page"}),
    ("sitemap", "WARNING", "LOW", "Not found", {"map": False}),
    ("sitemap", "PASS", "INFO", "Index, 4 sitemaps", {"kind": "sitemapindex", "listed": "unknown"}),
    ("sitemap", "WARNING", "LOW", "Page not listed", {"listed": "no"}),
)
#: name, system code, and what they become.
THROWN = (("BlockedAddressError", None, "BLOCKED_URL", 400), ("Error", "ERR_BLOCKED_ADDRESS", "BLOCKED_URL", 400), ("AbortError", None, "TIMEOUT", 504), ("Error", "UND_ERR_BODY_TIMEOUT", "TIMEOUT", 504), ("Error", "ENOTFOUND", "DNS_FAILURE", 502), ("TypeError", "EAI_AGAIN", "DNS_FAILURE", 502), ("Error", "ECONNREFUSED", "CONNECTION_FAILED", 502), (None, "ERR_TLS_CERT", "CONNECTION_FAILED", 502), ("TypeError", None, "CONNECTION_FAILED", 502))
#: status, body, content type, exception's name and code, and why the page can't be audited.
ANSWERS = (
    (200, "<html>x</html>", "text/html; charset=utf-8", None, None, None), (404, "<html>gone</html>", None, None, None, None), (404, "gone", "text/html", None, None, "HTTP_ERROR"),
    (200, "  ", "text/html", None, None, "UNSUPPORTED_CONTENT_TYPE"), (200, "x", "image/png", None, None, "UNSUPPORTED_CONTENT_TYPE"), (None, None, None, "AbortError", None, "TIMEOUT"), (None, None, None, None, "ENOTFOUND", "DNS_FAILURE"),
)
#: status, body, ok, error, whether the text is kept.
TEXTS = ((200, "User-agent: *", True, None, True), (404, "nothing", False, "HTTP_ERROR", False), (404, "<html>nothing</html>", False, None, True), (301, "moved", False, None, True), (200, "", False, "UNSUPPORTED_CONTENT_TYPE", False), (200, "x" * (1024 * 1024 + 1), False, "RESPONSE_TOO_LARGE", False))
LOGGED = (
    ('{"Token":"x","user":{"password":1,"name":"é"}}', '{"Token":"[redacted]","user":{"password":"[redacted]","name":"é"}}'),
    ('{"a":{"b":{"c":{"d":{"e":1}}}}}', '{"a":{"b":{"c":{"d":{"e":"[truncated]"}}}}}'),
    ('{"n":[' + ",".join(["1"] * 25) + "]}", '{"n":[' + ",".join(["1"] * 20) + "]}"),
    ("no json", None), (None, None), ("{}", "{}"),
)
SITES = (("https://a.example.com/", "https://example.com/x", True, False), ("https://example.com/a", "https://example.com/b", True, True), ("https://example.com/", "http://example.com/", True, False), ("https://example.com/", "https://example.org/", False, False), ("https://a.co.uk/", "https://b.co.uk/", False, False))
BASE = "https://site.example"


def _rows(spark: SparkSession, name: str, values) -> DataFrame:
    return spark.createDataFrame([(i, v) for i, v in enumerate(values)], f"id long, {name} string")


def guarded_inputs(spark: SparkSession, sf: str) -> DataFrame:
    return _rows(spark, "typed", URLS_TYPED).select("id", guard(F.col("typed")).alias("g")).select("id", "g.ok", "g.code", "g.href")


def check_max_points(spark: SparkSession, sf: str) -> DataFrame:
    return analytics.max_points(reg.check_dim(spark), reg.category_dim(spark))


def scoring_rules(spark: SparkSession, sf: str) -> DataFrame:
    return reg.scoring_explanation(spark)


def ip_ranges(spark: SparkSession, sf: str) -> DataFrame:
    rows = _rows(spark, "address", ADDRESSES)
    return join_ranges(rows, "address").select("id", "address", "reason", classify_ipv4(F.col("address")).alias("reason_by_column"))


def ip_classes(spark: SparkSession, sf: str) -> DataFrame:
    return _rows(spark, "address", ADDRESSES + ADDRESSES6).select("id", "address", classified(F.col("address")).alias("c")).select("id", "address", "c.allowed", F.col("c.reason").isNull().alias("without_reason"))


def _psi(spark: SparkSession) -> DataFrame:
    return psi.read(spark.createDataFrame([(1, PSI), (2, "no json")], "page_id long, payload string"))


def psi_metrics(spark: SparkSession, sf: str) -> DataFrame:
    return psi.metrics(_psi(spark)).select("page_id", "source", "metric", "value", "rating")


def psi_opportunities(spark: SparkSession, sf: str) -> DataFrame:
    return psi.opportunities(_psi(spark)).select("page_id", "rank", "audit", "savings_ms", "description")


def heading_skips(spark: SparkSession, sf: str) -> DataFrame:
    docs = [(1, "<h1>a</h1><h3>b</h3><h2>c</h2><h4>d</h4>"), (2, "<h1>a</h1><h2>b</h2>"), (3, ""), (4, "<h2></h2><h6>x</h6>")]
    df = spark.createDataFrame([(i, "https://example.com/", h) for i, h in docs], "page_id long, url string, html string")
    return audit(df).results.filter("check_key = 'heading-structure'").select("page_id", "status", "severity", "value")


def weights_report(spark: SparkSession, sf: str) -> DataFrame:
    """Category weights beside the checks' shares of them."""
    return reg.check_dim(spark).groupBy("category").agg(F.sum("weight").cast("long").alias("sum_weight"), F.count(F.lit(1)).alias("n_checks")).join(F.broadcast(reg.category_dim(spark)), "category").select("category", "category_weight", "sum_weight", "n_checks", "label")


def host_verdicts(spark: SparkSession, sf: str) -> DataFrame:
    df = spark.createDataFrame([(i, h, a) for i, (h, a) in enumerate(DNS)], "id long, host string, answers array<string>")
    return df.select("id", "host", dns.host_verdict(F.col("host"), F.col("answers")).alias("v"), dns.connectable(F.col("answers")).alias("c")).select("id", "host", "v.ok", "v.code", F.array_join("c", ",").alias("connectable"))


def sql_functions(spark: SparkSession, sf: str) -> DataFrame:
    functions.register(spark)
    _rows(spark, "typed", TYPED).createOrReplaceTempView("typed_urls")
    return spark.sql("SELECT id, looks_like_url(typed) AS ok, strip_www(typed) AS bare, earned_fraction('WARNING', 'HIGH') AS earned, band_for(CAST(id * 13 AS INT)) AS band FROM typed_urls")


def robots_rows(spark: SparkSession, sf: str) -> DataFrame:
    functions.register(spark)
    return spark.sql("SELECT * FROM robots_rules('" + ROBOTS.replace("\n", "\\n") + "')")


def score_cases(spark: SparkSession, sf: str) -> DataFrame:
    """One check for each category; the first is of the technical one."""
    kind = "array<struct<key:string,category:string,weight:int,status:string,severity:string>>"
    rows = [(n, [(k, k, 5, a, b) if k == "technical" else (k, k, 5, c, d) for k, *_ in reg.CATEGORIES]) for n, a, b, c, d in SCORED]
    done = scoring.with_scores(spark.createDataFrame(rows, f"name string, results {kind}"))
    cat = lambda k, f: F.get(F.filter("category_scores", lambda c: c["category"] == k), F.lit(0))[f]
    return done.select("name", "total", "band", "redistributed", cat("technical", "max_score").alias("technical_max"), cat("on-page", "max_score").alias("on_page_max"), cat("technical", "ratio").alias("technical_ratio"))


def event_reader(spark: SparkSession, sf: str) -> DataFrame:
    return spark.createDataFrame([(EVENTS,)], "buffer string").select(F.posexplode(limits.read_events(F.col("buffer"))).alias("ordinal", "e")).select("ordinal", "e.type", "e.stage")


def psi_thresholds(spark: SparkSession, sf: str) -> DataFrame:
    return psi.with_thresholds(psi.metrics(_psi(spark))).select("source", "metric", "value", "good", "fair", "core", "place")


def psi_bars(spark: SparkSession, sf: str) -> DataFrame:
    return psi.bars(psi.opportunities(_psi(spark))).select("page_id", "audit", "width")


def check_branches(spark: SparkSession, sf: str) -> DataFrame:
    rows = [(i, "https://example.com/page", f'<!doctype html><html lang="en"><head>{h}</head><body>{b}</body></html>') for i, (_, _, _, h, b) in enumerate(BRANCHES)]
    got = audit(spark.createDataFrame(rows, "page_id long, url string, html string")).results
    want = spark.createDataFrame([(i, k) for i, (k, *_) in enumerate(BRANCHES)], "page_id long, check_key string")
    return got.join(F.broadcast(want), ["page_id", "check_key"]).select("page_id", "check_key", "status", "severity", F.col("recommendation").isNotNull().alias("advised"))


def redirected(spark: SparkSession, sf: str) -> DataFrame:
    """Pages that ended on another site: links and the canonical are seen from there."""
    html = '<html><head><link rel="canonical" href="/p"></head><body><a href="/x">a</a><a href="https://example.com/">b</a></body></html>'
    page = spark.createDataFrame([(1, "https://example.com/p", html)], "page_id long, url string, html string")
    fetch = spark.createDataFrame([(1, "https://other.org/p", True, 301, 200, [("https://example.com/p", 301, "https://other.org/p")], {"X-Robots-Tag": "noindex"})], "page_id long, final_url string, ok boolean, initial_status int, final_status int, redirects array<struct<url:string,status:int,location:string>>, headers map<string,string>")
    a = audit(page, fetch)
    f = a.wide.select("page_id", F.col("facts.links").alias("l"), F.col("facts.canonicals").alias("c"), "results")
    noindex = F.get(F.filter("results", lambda r: r["key"] == "robots-meta"), F.lit(0))["status"]
    return f.select("page_id", F.array_join(F.transform("l", lambda x: x["kind"]), ",").alias("kinds"), F.get("c", 0)["resolved"].alias("canonical"), noindex.alias("robots_meta"))


def fetch_branches(spark: SparkSession, sf: str) -> DataFrame:
    """Checks that rest on the fetch, on robots.txt or on the sitemap, one page for each branch."""
    cases = [(i, k, WELL | c) for i, (k, _, _, _, c) in enumerate(FETCHED)]
    hop = lambda c: [(c["asked"], 301, c["end"])] * c["hops"]
    page = spark.createDataFrame([(i, c["asked"], "<html></html>") for i, _, c in cases], "page_id long, url string, html string")
    fetch = spark.createDataFrame([(i, c["end"], True, 301 if c["hops"] else c["status"], c["status"], hop(c), {}) for i, _, c in cases], "page_id long, final_url string, ok boolean, initial_status int, final_status int, redirects array<struct<url:string,status:int,location:string>>, headers map<string,string>")
    rules = spark.createDataFrame([(i, c["retrieved"], "u", c["robots"], None, [], c["verdict"], c["rule"]) for i, _, c in cases], "page_id long, retrieved boolean, url string, status int, error string, sitemaps array<string>, path_verdict string, matched_rule string")
    maps = spark.createDataFrame([(i, ["u"], "u", c["map"], 200, None, c["kind"], 4, False, c["listed"], "convention") for i, _, c in cases], "page_id long, checked_urls array<string>, found_url string, retrieved boolean, status int, error string, kind string, url_count int, count_truncated boolean, contains_audited_url string, discovered_via string")
    want = spark.createDataFrame([(i, k) for i, k, _ in cases], "page_id long, check_key string")
    return audit(page, fetch, rules, maps).results.join(F.broadcast(want), ["page_id", "check_key"]).select("page_id", "check_key", "status", "severity", "value")


def error_codes(spark: SparkSession, sf: str) -> DataFrame:
    rows = spark.createDataFrame([(i, *x[:2]) for i, x in enumerate(THROWN)], "id long, name string, system string")
    return rows.select("id", responses.network_error(F.col("name"), F.col("system")).alias("code")).select("id", "code", responses.http_status(F.col("code")).alias("http_status"))


def _answers(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([(i, f"{BASE}/{i}", *x[:5]) for i, x in enumerate(ANSWERS)], "page_id long, url string, status int, body string, content_type string, error_name string, error_system string")


def failed_audits(spark: SparkSession, sf: str) -> DataFrame:
    """Rows of the store: failed ones, and completed ones of the rest."""
    now = F.lit("2026-01-01 00:00:00").cast("timestamp")
    kept = ["page_id", "state", "error_code"]
    lost = responses.failures(_answers(spark))
    done = store.frames(audit(responses.auditable(_answers(spark))), "r", now)["audits"].select(*kept, F.lit(200).alias("http_status"))
    return done.unionByName(store.failed(lost, "r", now).join(F.broadcast(lost.select("page_id", "http_status")), "page_id").select(*kept, "http_status"))


def text_answers(spark: SparkSession, sf: str) -> DataFrame:
    got = responses.text_fetches(spark.createDataFrame([(i, *x[:2]) for i, x in enumerate(TEXTS)], "id long, status int, body string"))
    return got.select("id", "ok", "error", F.col("text").isNotNull().alias("kept"))


def log_redaction(spark: SparkSession, sf: str) -> DataFrame:
    return _rows(spark, "context", [x for x, _ in LOGGED]).select("id", responses.redact_json("context").alias("logged"))


def deductions(spark: SparkSession, sf: str) -> DataFrame:
    return report.deductions(spark)


def site_sitemap(spark: SparkSession, sf: str) -> DataFrame:
    return report.site_sitemap(spark, BASE, "2026-01-01")


def site_robots(spark: SparkSession, sf: str) -> DataFrame:
    """The site's robots.txt, as our own parser reads it."""
    functions.register(spark)
    spark.createDataFrame([(report.site_robots(BASE),)], "body string").createOrReplaceTempView("site_robots_txt")
    return spark.sql("SELECT r.* FROM site_robots_txt, LATERAL robots_rules(body) r")


def same_sites(spark: SparkSession, sf: str) -> DataFrame:
    rows = spark.createDataFrame([(i, *x[:2]) for i, x in enumerate(SITES)], "id long, a string, b string")
    return rows.select("id", same_site(F.col("a"), F.col("b")).alias("same_site"), (origin(F.col("a")) == origin(F.col("b"))).alias("same_origin"))


CASES = {f.__name__: f for f in (guarded_inputs, check_max_points, scoring_rules, ip_ranges, ip_classes, psi_metrics, psi_opportunities, heading_skips, weights_report, host_verdicts, sql_functions, robots_rows, score_cases, event_reader, psi_thresholds, psi_bars, check_branches, redirected, fetch_branches, error_codes, failed_audits, text_answers, log_redaction, deductions, site_sitemap, site_robots, same_sites)}


def sql() -> dict[str, str]:
    quad = "regexp_matches(address, '^((25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[1-9]?[0-9])\\.){3}(25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[1-9]?[0-9])$')"
    number = "list_reduce(list_transform(string_split(address, '.'), lambda x: try_cast(x AS BIGINT)), lambda a, b: a * 256 + b)"
    cidr = "CASE WHEN " + quad + " THEN CASE " + " ".join(f"WHEN {number} BETWEEN {a} AND {b} THEN '{w}'" for a, b, w in ranges()) + " END END"
    typed = _values(list(enumerate(URLS_TYPED)), "id, typed")
    dim = _values([c[:5] for c in reg.CHECKS], "ordinal, check_key, title, category, weight")
    cats = _values(reg.CATEGORIES, "category, category_weight, label")
    payload = PSI.replace("'", "''")
    return {
        "guarded_inputs": f"""SELECT id, code IS NULL AS ok, code, CASE WHEN code IS NULL THEN CASE id WHEN 0 THEN 'https://example.com/page' WHEN 1 THEN 'https://example.com/' WHEN 7 THEN 'http://8.8.8.8/x' ELSE 'http://example.org/a' END END AS href
            FROM (SELECT id, CASE WHEN trim(typed) = '' OR contains(typed, ' ') THEN 'INVALID_URL' WHEN id IN (0, 1, 7, 13) THEN NULL ELSE 'BLOCKED_URL' END AS code FROM {typed})""",
        "check_max_points": f"SELECT check_key, category, weight, CAST(weight AS DOUBLE) / sum(weight) OVER (PARTITION BY category) * category_weight AS points FROM {dim} d JOIN {cats} c USING (category)",
        "scoring_rules": "SELECT kind, name, CAST(value AS DOUBLE) AS value FROM " + _values([("category_weight", k, float(w)) for k, w, _ in reg.CATEGORIES] + [("deduction", k, v) for k, v in reg.DEDUCTIONS] + [("band_from", k, float(v)) for v, k in reg.BANDS], "kind, name, value"),
        "weights_report": f"SELECT category, category_weight, CAST(sum(weight) AS BIGINT) AS sum_weight, count(*) AS n_checks, label FROM {dim} d JOIN {cats} c USING (category) GROUP BY category, category_weight, label",
        "ip_ranges": f"SELECT id, address, {cidr} AS reason, {cidr} AS reason_by_column FROM {_values(list(enumerate(ADDRESSES)), 'id, address')}",
        "ip_classes": f"SELECT id, address, id IN (0, 6, 12, 19, 20, 28) AS allowed, id IN (0, 6, 12, 19, 20, 28) AS without_reason FROM {_values(list(enumerate(ADDRESSES + ADDRESSES6)), 'id, address')}",
        "psi_metrics": f"""WITH p AS (SELECT '{payload}'::JSON AS j)
            SELECT 1 AS page_id, source, metric, value, rating FROM p, LATERAL (
              SELECT 'lab' AS source, m AS metric, CAST(j->'lighthouseResult'->'audits'->k->>'numericValue' AS DOUBLE) AS value, CASE WHEN CAST(j->'lighthouseResult'->'audits'->k->>'score' AS DOUBLE) >= 0.9 THEN 'good' WHEN CAST(j->'lighthouseResult'->'audits'->k->>'score' AS DOUBLE) >= 0.5 THEN 'needs-improvement' ELSE 'poor' END AS rating FROM {_values(psi.LAB, 'k, m')}
              UNION ALL SELECT 'field', m, CAST(j->'loadingExperience'->'metrics'->k->>'percentile' AS DOUBLE), CASE j->'loadingExperience'->'metrics'->k->>'category' WHEN 'FAST' THEN 'good' WHEN 'AVERAGE' THEN 'needs-improvement' ELSE 'poor' END FROM {_values(psi.FIELD, 'k, m, d')}) x WHERE value IS NOT NULL""",
        "psi_opportunities": f"""WITH p AS (SELECT '{payload}'::JSON->'lighthouseResult'->'audits' AS j), a AS (SELECT k AS audit, CAST(j->k->'details'->>'overallSavingsMs' AS DOUBLE) AS savings_ms, j->k->'details'->>'type' AS t, regexp_replace(j->k->>'description', '\\[([^\\]]*)\\]\\([^)]*\\)', '\\1', 'g') AS description FROM p, LATERAL (SELECT unnest(json_keys(j)) AS k) x)
            SELECT 1 AS page_id, CAST(row_number() OVER (ORDER BY savings_ms DESC, audit) AS INTEGER) AS rank, audit, savings_ms, description FROM a WHERE t = 'opportunity' AND savings_ms >= 50""",
        "host_verdicts": "SELECT * FROM (VALUES (0, '8.8.8.8', true, NULL, NULL), (1, '10.0.0.1', false, 'BLOCKED_URL', NULL), (2, 'a.example', true, NULL, '1.1.1.1,2606:4700::1111'), (3, 'b.example', false, 'BLOCKED_URL', '1.1.1.1'), (4, 'c.example', false, 'DNS_FAILURE', NULL), (5, 'd.example', false, 'DNS_FAILURE', NULL), (6, '[::1]', false, 'BLOCKED_URL', NULL), (7, 'e.example', false, 'BLOCKED_URL', NULL)) v(id, host, ok, code, connectable)",
        "sql_functions": f"SELECT id, id IN (0, 1, 6, 8) AS ok, regexp_replace(lower(typed), '^www[.]', '') AS bare, 1.0::DOUBLE - 0.7::DOUBLE AS earned, CASE WHEN id * 13 >= 90 THEN 'excellent' WHEN id * 13 >= 75 THEN 'good' WHEN id * 13 >= 50 THEN 'needs-improvement' ELSE 'significant-issues' END AS band FROM {_values(list(enumerate(TYPED)), 'id, typed')}",
        "robots_rows": "SELECT * FROM (VALUES ('*', 'allow', '/en/12'), ('*', 'disallow', '/en/1'), ('*', 'disallow', '/*.html$'), ('*', 'disallow', '/es'), ('other', 'disallow', '/')) v(user_agent, directive, path)",
        "score_cases": "SELECT * FROM (VALUES ('all pass', 100, 'excellent', false, 30, 35, 1.0::DOUBLE), ('technical left out', 100, 'excellent', true, 0, 51, NULL), ('all critical', 0, 'significant-issues', false, 30, 35, 0.0::DOUBLE), ('nothing measured', 0, 'significant-issues', true, 0, 0, NULL), ('one medium', 88, 'good', false, 30, 35, 0.6::DOUBLE)) v(name, total, band, redistributed, technical_max, on_page_max, technical_ratio)",
        "event_reader": "SELECT * FROM (VALUES (0, 'start', NULL), (1, 'stage', 'fetching')) v(ordinal, type, stage)",
        "psi_thresholds": "SELECT source, metric, value, good, fair, core, least(100.0::DOUBLE, value / scale * 100.0::DOUBLE) AS place FROM (VALUES ('lab', 'LCP', 2100.5::DOUBLE), ('lab', 'CLS', 0.3::DOUBLE), ('lab', 'SI', 4000.0::DOUBLE), ('field', 'LCP', 1900.0::DOUBLE), ('field', 'INP', 350.0::DOUBLE), ('field', 'CLS', 5.0::DOUBLE)) v(source, metric, value) JOIN (VALUES ('LCP', 2500, 4000, 6000::DOUBLE, true), ('CLS', 10, 25, 50::DOUBLE, true), ('INP', 200, 500, 1000::DOUBLE, true), ('SI', 3400, 5800, 9000::DOUBLE, false)) t(metric, good, fair, scale, core) USING (metric)",
        "psi_bars": "SELECT * FROM (VALUES (1, 'render-blocking', 100), (1, 'unused-css', 36)) v(page_id, audit, width)",
        "check_branches": f"SELECT *, status IN ('WARNING', 'ERROR') OR page_id IN {ADVISED} AS advised FROM " + _values([(i, *b[:3]) for i, b in enumerate(BRANCHES)], "page_id, check_key, status, severity"),
        "fetch_branches": "SELECT * FROM " + _values([(i, *b[:4]) for i, b in enumerate(FETCHED)], "page_id, check_key, status, severity, value"),
        "error_codes": "SELECT * FROM " + _values([(i, *x[2:]) for i, x in enumerate(THROWN)], "id, code, http_status"),
        "failed_audits": f"SELECT page_id, CASE WHEN error_code IS NULL THEN 'COMPLETED' ELSE 'FAILED' END AS state, error_code, CASE error_code WHEN 'HTTP_ERROR' THEN 502 WHEN 'DNS_FAILURE' THEN 502 WHEN 'UNSUPPORTED_CONTENT_TYPE' THEN 422 WHEN 'TIMEOUT' THEN 504 ELSE 200 END AS http_status FROM {_values([(i, x[5]) for i, x in enumerate(ANSWERS)], 'page_id, error_code')}",
        "text_answers": "SELECT * FROM " + _values([(i, *x[2:]) for i, x in enumerate(TEXTS)], "id, ok, error, kept"),
        "log_redaction": "SELECT * FROM " + _values([(i, x) for i, (_, x) in enumerate(LOGGED)], "id, logged"),
        "deductions": "SELECT 'critical 100%, high 70%, medium 40%, low 15%' AS deductions",
        "site_sitemap": f"SELECT '{BASE}' || path AS loc, '2026-01-01' AS lastmod, changefreq, priority::DOUBLE AS priority FROM " + _values([*report.ROUTES, *[("/seo-guides/" + g, "yearly", 0.7) for g in advice.GUIDES]], "path, changefreq, priority"),
        "site_robots": "SELECT * FROM (VALUES ('*', 'allow', '/'), ('*', 'disallow', '/api/'), ('*', 'disallow', '/audit/')) v(user_agent, directive, path)",
        "same_sites": "SELECT * FROM " + _values([(i, *x[2:]) for i, x in enumerate(SITES)], "id, same_site, same_origin"),
        "redirected": "SELECT 1 AS page_id, 'internal,external' AS kinds, 'https://other.org/p' AS canonical, 'ERROR' AS robots_meta",
        "heading_skips": "SELECT * FROM (VALUES (1, 'WARNING', 'LOW', '2 skipped levels'), (2, 'PASS', 'INFO', '1 H1, 1 H2, 0 H3'), (3, 'WARNING', 'MEDIUM', 'No headings'), (4, 'WARNING', 'LOW', '1 empty heading')) v(page_id, status, severity, value)",
    }
