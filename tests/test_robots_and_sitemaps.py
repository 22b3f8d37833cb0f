"""robots.txt rules joined by their literal parts, against a plain reading; limits; sitemap texts."""

import random
import re

import pytest
from pyspark.sql import functions as F

from siftline.operators import robots, sitemap

DOC = "origin string, retrieved boolean, url string, status int, error string, body string"


def plain(path, allow, deny):
    def hit(r):
        body = re.escape(r[:-1] if r.endswith("$") else r).replace(r"\*", ".*")
        return r != "" and re.match(body + ("$" if r.endswith("$") else ""), path) is not None

    a, d = ([r for r in rules if hit(r)] for rules in (allow, deny))
    first = lambda x: next((r for r in x if len(r) == max(map(len, x))), None)
    best_a, best_d = first(a), first(d)
    odd = any("*" in r or r.endswith("$") for r in a + d)
    if best_d is None:
        return "allowed", best_a
    if best_a is not None and len(best_a) >= len(best_d):
        return "allowed", "Allow: " + best_a
    return ("unknown" if odd else "disallowed"), "Disallow: " + best_d


def some_rules(rng, n):
    part = lambda: "/" + rng.choice(["a", "ab", "b", "é", "a.b", "x+y", ""])
    return ["".join(part() for _ in range(rng.randrange(1, 4))) + rng.choice(["", "", "*", "/*b", "$", "*$", "$x"]) for _ in range(n)] + ["", "no-slash", "*"]


@pytest.mark.parametrize("seed", [1, 2])
def test_joined_rules_equal_a_plain_reading(spark, seed):
    rng = random.Random(seed)
    allow, deny = some_rules(rng, 12), some_rules(rng, 12)
    paths = sorted({"".join("/" + rng.choice(["a", "ab", "abc", "é", "a.b", "axb", "xxy", "$x", "b?q=1"]) for _ in range(rng.randrange(1, 5))) for _ in range(150)})
    body = "User-agent: *\n" + "\n".join([f"Allow: {r}" for r in allow] + [f"Disallow: {r}" for r in deny])
    pages = spark.createDataFrame([(i, "https://example.com" + p) for i, p in enumerate(paths)], "page_id long, url string")
    docs = spark.createDataFrame([("https://example.com", True, "https://example.com/robots.txt", 200, None, body)], DOC)
    got = {r.page_id: (r.path_verdict, r.matched_rule) for r in robots.verdicts(pages, docs).collect()}
    want = {i: plain(p, allow, deny) for i, p in enumerate(paths)}
    assert got == want and len(set(want.values())) > 4
    # in the row, for one path at a time
    group = F.struct(F.array(*map(F.lit, allow)).alias("allow"), F.array(*map(F.lit, deny)).alias("disallow"))
    row = pages.select("page_id", robots.evaluate(group, F.substring("url", 20, 1000)).alias("v")).select("page_id", "v.*")
    assert {r.page_id: r.matched_rule for r in row.collect()} == {i: r for i, (_, r) in want.items()}


def test_columns_parse_like_the_plain_reader(spark):
    rng = random.Random(7)
    line = lambda: rng.choice(["User-agent: *", "user-agent: A", "User-Agent:", "USER-AGENT : b # c", "Allow: /x", "Disallow:", "disallow: /y:z # no", "Sitemap: https://a/s.xml", "sitemap:", "Crawl-delay: 3", "Host: a", "nonsense", "odd: 1", "# note", "", "  ", ":", "\u00a0Allow: /é\u00a0", "Allow"])
    texts = [rng.choice(["\n", "\r\n"]).join(line() for _ in range(rng.randrange(12))) for _ in range(200)] + ["", None, "Allow: /", "\r", "User-agent: a\nDisallow: /" + "x" * 100_000]
    df = robots.parsed(spark.createDataFrame(list(enumerate(texts)), "i int, body string"))
    assert "Python" not in df._jdf.queryExecution().executedPlan().toString()
    got = {r.i: {"groups": [g.asDict() for g in r.groups], "sitemaps": r.sitemaps, "has_unknown": r.has_unknown} for r in df.collect()}
    assert got == {i: robots.parse(t) for i, t in enumerate(texts)}


def test_ten_thousand_rules_on_one_origin(spark):
    """A path meets the rules that begin it, not all; the plan has no join without a key."""
    rules = [f"/s{i % 100}/p{i}" for i in range(10_000)]
    body = "User-agent: *\n" + "\n".join(f"Disallow: {r}" for r in rules) + "\nAllow: /s7/p7/open"
    docs = spark.createDataFrame([("https://example.com", True, "u", 200, None, body)], DOC)
    pages = spark.range(5000).select(F.col("id").alias("page_id"), F.concat(F.lit("https://example.com/s"), F.col("id") % 100, F.lit("/p"), F.col("id") * 3, F.when(F.col("id") % 2 == 0, "/open").otherwise("")).alias("url"))
    out = robots.verdicts(pages, docs)
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert "NestedLoop" not in plan and "Cartesian" not in plan
    told = {r.page_id: (r.path_verdict, r.matched_rule) for r in out.collect()}
    for i in (0, 1, 50, 2501, 4999):
        path = f"/s{i % 100}/p{3 * i}" + ("/open" if i % 2 == 0 else "")
        assert told[i] == plain(path, ["/s7/p7/open"], rules)
    assert len(told) == 5000


def test_documents_and_defined_cases(spark):
    rows = [
        ("https://ok.com", "u", 200, "User-agent: *\nDisallow: /x", None), ("https://gone.com", "u", 404, "<html>", None), ("https://html.com", "u", 200, "\n <!DOCTYPE html><p>User-agent: *", None),
        ("https://large.com", "u", 200, "#" * (512 * 1024 + 1), None), ("https://full.com", "u", 200, "#" * (512 * 1024), None), ("https://error.com", "u", 503, "x", None), ("https://down.com", "u", None, None, "TIMEOUT"), ("https://empty.com", "u", 200, None, None),
    ]
    docs = robots.documents(spark.createDataFrame(rows, "origin string, url string, status int, body string, error string"))
    assert {r.origin[8:-4]: (r.retrieved, r.error) for r in docs.collect()} == {"ok": (True, None), "gone": (True, None), "html": (False, "HTML"), "large": (False, "RESPONSE_TOO_LARGE"), "full": (True, None), "error": (False, "HTTP_ERROR"), "down": (False, "TIMEOUT"), "empty": (False, "UNSUPPORTED_CONTENT_TYPE")}
    urls = [(1, "https://ok.com/x?y"), (1, "https://ok.com/x?y"), (None, "https://ok.com/z"), (2, None), (3, ""), (4, "https://gone.com/x"), (5, "https://html.com/x"), (6, "https://unseen.com/"), (7, "ftp://ok.com/x")]
    got = robots.verdicts(spark.createDataFrame(urls, "page_id long, url string"), docs)
    assert sorted(((r.page_id, r.path_verdict, r.matched_rule) for r in got.collect()), key=repr) == sorted([(1, "disallowed", "Disallow: /x")] * 2 + [(None, "allowed", None), (2, "unknown", None), (3, "unknown", None), (4, "allowed", None), (5, "unknown", None), (6, "unknown", None), (7, "unknown", None)], key=repr)
    assert robots.verdicts(spark.createDataFrame([], "page_id long, url string"), docs).count() == 0


def test_sitemap_texts(spark):
    loc = lambda *xs: "<urlset>" + "".join(f"<url><loc>{x}</loc></url>" for x in xs) + "</urlset>"
    cases = [
        (loc(" a&amp;b ", "&amp;lt;", "x<![CDATA[&amp;y]]>z", "<![CDATA[p]]> "), ("urlset", ["a&b", "<", "x&yz", "p"], 4, False)),
        (loc(*([" "] * 10 + list(map(str, range(6000))))), ("urlset", [str(i) for i in range(5000)], 6010, True)),
        ("<SitemapIndex xmlns='x'><loc>i</loc></SitemapIndex>", ("sitemapindex", ["i"], 1, False)), ("<urlsets><loc>i</loc></urlsets>", None), ("<html>", None), ("", None), (None, None),
    ]
    df = spark.createDataFrame([(i, t) for i, (t, _) in enumerate(cases)], "i int, t string").select("i", sitemap.parse(F.col("t")).alias("p"))
    assert {r.i: r.p and tuple(r.p) for r in df.collect()} == {i: want for i, (_, want) in enumerate(cases)}
