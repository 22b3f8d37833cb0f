"""The fact extractor, URLs, addresses and robots.txt without Spark."""

from siftline.functions.html import facts
from siftline.functions.ip import classify
from siftline.functions.urls import parse_url, registrable
from siftline.operators.ratelimit import peek, step
from siftline.operators.robots import parse
from siftline.sources.pages import decode

URL = "https://example.com/page"


def test_text_and_paragraphs():
    f = facts("<h1>The big heading</h1><p>one two three four five</p><script>x y</script><style>p{}</style>", URL)
    assert f["paragraph_count"] == 1 and f["excerpt"] == "The big headingone two three four five"
    assert facts("<ul><li>a</li><li>b</li></ul> - ! ?", URL)["word_count"] == 1


def test_unclosed_title_swallows_the_rest_and_svg_titles_do_not_count():
    assert facts("<title>Open <p>text", URL)["titles"] == ["Open <p>text"]
    assert facts("<title>A</title><svg><title>icon</title></svg>", URL)["titles"] == ["A"]
    assert facts("", URL)["word_count"] == 0 and facts(None, None)["links"] == []


def test_link_kinds():
    html = '<a href="/a">A</a><a href="https://www.example.com/b">B</a><a href="https://blog.example.com/">C</a><a href="https://other.org">D</a><a href="#x">E</a><a href="mailto:a@b">F</a><a href="tel:1">G</a><a href="javascript:void(0)">H</a><a href="">I</a><a href="//cdn.net"><img alt="J  k"></a>'
    links = facts(html, URL)["links"]
    assert [x["kind"] for x in links] == ["internal", "internal", "internal", "external", "fragment", "mailto", "tel", "javascript", "empty", "external"]
    assert links[-1]["anchor_text"] == "J k" and links[0]["resolved"] == "https://example.com/a"


def test_json_ld():
    html = '<script type="application/ld+json">{"@type":"Article","author":{"@type":["Person"]}}</script><script type="application/ld+json">{"a":1,}</script><script type="application/ld+json"></script>'
    blocks = facts(html, URL)["json_ld"]
    assert [b["valid"] for b in blocks] == [True, False, False] and blocks[0]["types"] == ["Article", "Person"]


def test_meta_first_wins_and_refresh_last():
    f = facts('<meta name="Robots" content="noindex"><meta name="robots" content="all"><meta property="og:title" content="P"><meta name="og:title" content="N"><meta http-equiv="refresh" content="1"><meta http-equiv="refresh" content="2">', URL)
    assert f["meta_robots"] == "noindex" and f["open_graph"] == [{"key": "og:title", "value": "P"}] and f["meta_refresh"] == "2"


def test_pathological_markup():
    assert len(facts("".join(f'<a href="/p{i}">x{i}</a>' for i in range(3000)), URL)["links"]) == 3000
    assert facts("<div>" * 500 + "deep", URL)["word_count"] == 1
    assert facts("<p>a<p>b<p></p>", URL)["paragraph_count"] == 2


def test_urls():
    base = parse_url("https://example.com/p/q?r")
    got = {u: (x := parse_url(u, base)) and x.href for u in ("HTTP://EXAMPLE.com:80/a/../b?x#y", "http://0x7f.1/", "//x/y", "?q=1", "../z", "http://a b/", "http://h:99999/")}
    assert list(got.values()) == ["http://example.com/b?x#y", "http://127.0.0.1/", "https://x/y", "https://example.com/p/q?q=1", "https://example.com/z", None, None]
    assert registrable("a.b.co.uk") == "b.co.uk" and registrable("www.example.com.") == "example.com"


def test_addresses():
    assert classify("8.8.8.8") == (True, None) and not classify("10.0.0.1")[0] and not classify("01.2.3.4")[0]
    assert not classify("::ffff:127.0.0.1")[0] and classify("2606:4700::1")[0] and not classify("fe80::1%eth0")[0]
    assert classify("64:ff9b:0:0:1::8.8.8.8")[0]


def test_robots_groups():
    p = parse("User-agent: a\nSitemap: https://x/s.xml\nUser-agent: b # c\nCrawl-delay: 3\nDisallow: /x\nUser-agent: *\nAllow: /\nnonsense")
    assert [g["user_agents"] for g in p["groups"]] == [["a", "b"], ["*"]]
    assert p["sitemaps"] == ["https://x/s.xml"] and p["has_unknown"]


def test_decode():
    assert decode("Café".encode("cp1252"), "text/html; charset=iso-8859-1") == "Café"
    assert decode(b"\xef\xbb\xbfHello", None) == "Hello" and decode(b"Hello", "text/html; charset=nonsense") == "Hello"


def test_rate_limit_steps():
    state, seen = None, []
    for now in (0, 10, 20, 1000):
        state, told = step(state, now, 2, 1000)
        seen.append(told[:2])
    assert seen == [(True, 1), (True, 0), (False, 0), (True, 1)]
    assert peek(state, 1500, 2, 1000) == (True, 1, 2000)


def test_references_cut_short():
    html = '<title>a &amp;&amp &copy &am &#65; &#66 &nope; &ampx;</title><a href="/x?a&amp;b&amp">t</a>'
    assert facts(html, URL)["titles"] == ["a && © &am A B &nope; &x;"]
    f = facts(html, URL, terminated=True)
    assert f["titles"] == ["a &&amp &copy &am A &#66 &nope; &ampx;"] and f["links"][0]["href"] == "/x?a&b&amp"
