"""The 26 checks, each an ordered cascade of conditions over the audit context.

The context has the columns url (as asked for), final_url, facts, fetch, robots and sitemap. An
outcome is a struct of status, severity, value, message, confidence, details (JSON or null), and what
to do about it: recommendation and a code example, by the finding (see advice.FINDINGS).
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..functions.text import SPACE, plural, trimmed, truncated, units
from ..functions.urls import canonical_key, host_of, is_web, registrable_domain, scheme_of
from .advice import FINDINGS
from .registry import check

OUTCOME = "struct<status:string,severity:string,value:string,message:string,confidence:string,details:string,recommendation:string,code_example:string>"
# Thresholds, and lists that the results depend on.
TITLE_SHORT, TITLE_LONG, TITLE_VERY_LONG = 20, 65, 80
DESCRIPTION_SHORT, DESCRIPTION_LONG, DESCRIPTION_VERY_LONG = 70, 160, 200
VERY_THIN, THIN, LONG_TEXT, VERY_LONG_TEXT = 100, 300, 600, 1200
RENDERED_WORDS, RENDERED_BYTES = 150, 15_000
UNINFORMATIVE = ("click here", "here", "read more", "more", "learn more", "this", "link", "this link", "go", "continue", "details", "info", "download")
NOTABLE_TYPES = ("Article", "NewsArticle", "BlogPosting", "Product", "Offer", "Organization", "LocalBusiness", "BreadcrumbList", "FAQPage", "HowTo", "Recipe", "Event", "Person", "WebSite", "WebPage", "VideoObject", "Review", "AggregateRating", "SoftwareApplication", "JobPosting", "Course")
OG_REQUIRED, OG_RECOMMENDED = ("og:title", "og:description", "og:image"), ("og:url", "og:type")
CARD_TYPES = ("summary", "summary_large_image", "app", "player")
LANGUAGE = r"^(?i)[a-z]{2,3}(-[a-z0-9]{2,8})*$"
DISPLAY = r"^(noarchive|nosnippet|notranslate|noimageindex|max-snippet|max-image-preview|max-video-preview|unavailable_after)"
NO_ZOOM = r"maximum-scale=(0?\.[0-9]|1(\.0+)?)\b"


def _c(x) -> Column:
    return x if isinstance(x, Column) else F.lit(x)


def _example(text: str | None) -> Column:
    """Markup with the page's address in it."""
    if text is None or "{url}" not in text:
        return F.lit(text).cast("string")
    before, after = text.split("{url}")
    return F.concat(F.lit(before), truncated(F.col("final_url"), 80), F.lit(after))


def outcome(status, value, message, severity=None, confidence=None, details: dict | None = None, advice=None) -> Column:
    """severity: where not given, by status; details: name to Column; advice: where not given, by message."""
    said, example = FINDINGS.get(message, (None, None)) if isinstance(message, str) else (None, None)
    s = _c(status)
    by_status = F.when(s == "ERROR", "HIGH").when(s == "WARNING", "MEDIUM").otherwise("INFO")
    trust = F.when(s == "UNAVAILABLE", "unavailable").otherwise("measured")
    told = F.to_json(F.struct(*[_c(v).alias(k) for k, v in sorted(details.items())]), {"ignoreNullFields": "false"}) if details else F.lit(None)
    return F.struct(
        s.alias("status"),
        (by_status if severity is None else _c(severity)).alias("severity"),
        _c(value).cast("string").alias("value"),
        _c(message).cast("string").alias("message"),
        (trust if confidence is None else _c(confidence)).alias("confidence"),
        told.cast("string").alias("details"),
        _c(said if advice is None else advice).cast("string").alias("recommendation"),
        _example(example).alias("code_example"),
    )


def fact(name: str) -> Column:
    return F.col(f"facts.{name}")


def _blank(c: Column) -> Column:
    return trimmed(F.coalesce(c, F.lit(""))) == ""


def _lookup(pairs: Column, key: str) -> Column:
    """A value of an array of key and value."""
    return F.get(F.transform(F.filter(pairs, lambda p: p["key"] == key), lambda p: p["value"]), 0)


def _keys(pairs: Column) -> Column:
    return F.transform(pairs, lambda p: p["key"])


# technical


@check("http-status", "HTTP status", "technical", 8)
def http_status() -> Column:
    code = F.col("fetch.final_status")
    text, d = code.cast("string"), {"initialStatus": F.col("fetch.initial_status"), "finalStatus": code}
    said = F.concat(F.lit("The page answered with HTTP "), text, F.lit("."))
    return (
        F.when(code.between(200, 299), outcome("PASS", F.concat(text, F.lit(" OK")), said, details=d))
        .when(code.between(300, 399), outcome("WARNING", text, said, "MEDIUM", details=d, advice="See where the address leads in the end and audit that one."))
        .when(code.isin(404, 410), outcome("ERROR", F.concat(text, F.lit(" Not Found")), said, "CRITICAL", details=d, advice="Bring the page back, or redirect its address to the page that took its place."))
        .when(code >= 500, outcome("ERROR", F.concat(text, F.lit(" Server Error")), said, "CRITICAL", details=d, advice="Look into the server's log: pages that fail for long drop out of results."))
        .otherwise(outcome("ERROR", text, said, "HIGH", details=d, advice="Let readers and crawlers in without a login or special headers."))
    )


@check("https", "HTTPS", "technical", 8)
def https() -> Column:
    asked, final = scheme_of(F.col("url")), scheme_of(F.col("final_url"))
    up = (asked == "http") & (final == "https")
    d = {"finalProtocol": F.concat(final, F.lit(":")), "upgradedFromHttp": up}
    return (
        F.when(~is_web(F.col("url")) | ~is_web(F.col("final_url")), outcome("UNAVAILABLE", None, "The address could not be parsed."))
        .when(up, outcome("PASS", "HTTPS (redirected)", "Plain HTTP leads to HTTPS.", details=d))
        .when(final == "https", outcome("PASS", "HTTPS", "The page is served over HTTPS.", details=d))
        .otherwise(outcome("ERROR", "HTTP only", "The page is served without encryption.", "CRITICAL", details=d))
    )


@check("redirects", "Redirects", "technical", 5)
def redirects() -> Column:
    n = F.size("fetch.redirects")
    many, d = plural(n, "redirect"), {"count": n}
    swapped = F.regexp_replace("url", "^http:", "https:")
    upgrade = (n == 1) & F.col("url").startswith("http://") & F.col("final_url").startswith("https://") & F.coalesce(canonical_key(swapped) == canonical_key(F.col("final_url")), F.lit(False))
    temporary = F.exists("fetch.redirects", lambda h: h["status"].isin(302, 307))
    return (
        F.when(n == 0, outcome("PASS", "None", "The address answered directly.", details=d))
        .when(upgrade, outcome("PASS", "1 redirect", "The only redirect is the one to HTTPS.", details=d))
        .when((n == 1) & temporary, outcome("PASS", "1 redirect", "One redirect, declared temporary.", details=d))
        .when(n == 1, outcome("PASS", "1 redirect", "One redirect.", details=d))
        .otherwise(outcome("WARNING", many, F.concat(many, F.lit(" before the page answered.")), F.when(n >= 4, "MEDIUM").otherwise("LOW"), details=d, advice="Let the first address lead straight to the last one."))
    )


def _directives(c: Column) -> Column:
    return F.filter(F.transform(F.split(F.coalesce(c, F.lit("")), ","), lambda x: F.lower(trimmed(x))), lambda x: x != "")


@check("robots-meta", "Robots directives", "technical", 8)
def robots_meta() -> Column:
    every = F.concat(_directives(fact("meta_robots")), _directives(fact("meta_googlebot")), _directives(F.element_at("fetch.headers", "x-robots-tag")))
    noindex = F.array_contains(every, "noindex") | F.array_contains(every, "none")
    nofollow = F.array_contains(every, "nofollow") | F.array_contains(every, "none")
    shown = F.filter(every, lambda x: x.rlike(DISPLAY))
    d = {"directives": every, "noindex": noindex, "nofollow": nofollow}
    return (
        F.when(noindex, outcome("ERROR", "noindex", "The page asks not to be indexed.", "CRITICAL", details=d))
        .when(nofollow, outcome("WARNING", "nofollow", "The page asks that its links are not followed.", "MEDIUM", details=d))
        .when(F.size(shown) > 0, outcome("INFO", F.array_join(shown, ", "), "Indexable, with rules for its display.", details=d))
        .when(F.size(every) == 0, outcome("PASS", "No restrictions", "No directives restrict indexing.", details=d))
        .otherwise(outcome("PASS", F.array_join(every, ", "), "The directives allow indexing.", details=d))
    )


@check("canonical", "Canonical URL", "technical", 7)
def canonical() -> Column:
    n = F.size(fact("canonicals"))
    said = F.coalesce(F.get(fact("canonicals"), 0)["href"], F.lit(""))
    goal = F.get(fact("canonicals"), 0)["resolved"]
    absolute = said.rlike(r"^(?i)https?://")
    own = F.coalesce(canonical_key(goal) == canonical_key(F.col("final_url")), F.lit(False))
    here = F.when(is_web(F.col("final_url")), host_of(F.col("final_url"))).otherwise(host_of(goal))
    cross = registrable_domain(host_of(goal)) != registrable_domain(here)
    d = {"canonical": goal, "selfReferencing": own}
    return (
        F.when(n == 0, outcome("WARNING", "Missing", "No canonical address is declared.", "MEDIUM"))
        .when(n > 1, outcome("ERROR", F.concat(n.cast("string"), F.lit(" canonical tags")), "Several canonical addresses are declared.", "HIGH", details={"canonicals": F.transform(fact("canonicals"), lambda x: x["href"])}))
        .when(said == "", outcome("ERROR", "Empty", "The canonical address is empty.", "HIGH"))
        .when(goal.isNull() | (said.contains("://") & ~absolute), outcome("ERROR", "Invalid URL", "The canonical address is no valid URL.", "HIGH", details={"declared": said}))
        .when(own & absolute, outcome("PASS", truncated(goal, 60), "The canonical address is the page's own.", details=d))
        .when(own, outcome("WARNING", "Relative URL", "The canonical address is relative.", "LOW", details=d))
        .otherwise(outcome("WARNING", "Points elsewhere", "The canonical address is another page.", F.when(cross, "HIGH").otherwise("MEDIUM"), details=d | {"crossSite": cross}, advice=F.when(cross, "Make sure that another site's page is meant to stand for this one; if not, name this page's own address.").otherwise("Fine if this page is a variant of that one; if not, name this page's own address.")))
    )


@check("robots-txt", "robots.txt", "technical", 5)
def robots_txt() -> Column:
    r = lambda name: F.col(f"robots.{name}")
    blocked = F.coalesce(r("matched_rule").startswith("Disallow:"), F.lit(False))
    d = {"url": r("url"), "matchedRule": r("matched_rule"), "sitemaps": r("sitemaps")}
    unknown = lambda advice: outcome("UNAVAILABLE", "Unable to determine", "Whether robots.txt covers the page cannot be told.", details={"url": r("url"), "status": r("status")}, advice=advice)
    unnamed = F.when(F.coalesce(F.size(r("sitemaps")), F.lit(0)) <= 0, "Name the sitemap in robots.txt, so that crawlers need not guess where it is.")
    return (
        F.when(~F.coalesce(r("retrieved"), F.lit(False)), unknown("This need not be wrong: open the file in a browser to see whether it can be reached."))
        .when(r("status").isin(404, 410), outcome("PASS", "Not present", "There is no robots.txt.", details={"url": r("url"), "status": r("status")}))
        .when(r("path_verdict") == "disallowed", outcome("ERROR", "Path disallowed", "robots.txt seems to block the page.", "CRITICAL", "inferred", d))
        .when((r("path_verdict") == "unknown") & blocked, outcome("WARNING", "Potentially blocked", "A pattern of robots.txt may cover the page.", "MEDIUM", "inferred", d))
        .when(r("path_verdict") == "unknown", unknown("Test the address against the file with a search engine's own tool."))
        .otherwise(outcome("PASS", "Path allowed", "robots.txt does not block the page.", None, "inferred", d, advice=unnamed))
    )


@check("sitemap", "XML sitemap", "technical", 4)
def sitemap() -> Column:
    s = lambda name: F.col(f"sitemap.{name}")
    many = F.when(s("count_truncated"), F.concat(s("url_count").cast("string"), F.lit("+ URLs"))).otherwise(plural(s("url_count"), "URL"))
    d = {"url": s("found_url"), "count": s("url_count"), "discoveredVia": s("discovered_via")}
    return (
        F.when(~F.coalesce(s("retrieved"), F.lit(False)), outcome("WARNING", "Not found", "No sitemap was found.", "LOW", "inferred", {"checked": s("checked_urls")}))
        .when(s("kind") == "sitemapindex", outcome("PASS", F.concat(F.lit("Index, "), plural(s("url_count"), "sitemap")), "A sitemap index was found.", details=d))
        .when(s("contains_audited_url") == "no", outcome("WARNING", "Page not listed", "The sitemap does not list the page.", "LOW", details=d))
        .when(s("contains_audited_url") == "yes", outcome("PASS", "Listed in sitemap", "The sitemap lists the page.", details=d))
        .otherwise(outcome("PASS", many, "A sitemap was found, but not read in full.", None, "inferred", d))
    )


@check("language", "Language declaration", "technical", 4)
def language() -> Column:
    lang = fact("html_lang")
    return (
        F.when(F.coalesce(lang, F.lit("")) == "", outcome("WARNING", "Missing", "The document declares no language.", "MEDIUM"))
        .when(~lang.rlike(LANGUAGE), outcome("WARNING", truncated(lang, 30), "The declared language is no usual code.", "LOW", details={"lang": lang}))
        .otherwise(outcome("PASS", lang, F.concat(F.lit("The language is "), lang, F.lit(".")), details={"lang": lang, "hreflangCount": F.size(fact("hreflang"))}))
    )


@check("viewport", "Mobile viewport", "technical", 5)
def viewport() -> Column:
    v = fact("viewport")
    flat = F.regexp_replace(F.lower(v), SPACE, "")
    d = {"viewport": v}
    return (
        F.when(F.coalesce(v, F.lit("")) == "", outcome("WARNING", "Missing", "No viewport is declared.", "HIGH"))
        .when(~flat.contains("width=device-width"), outcome("WARNING", truncated(v, 40), "The viewport does not follow the device's width.", "MEDIUM", details=d))
        .when(flat.contains("user-scalable=no") | flat.rlike(NO_ZOOM), outcome("WARNING", "Zoom disabled", "The viewport prevents zooming.", "LOW", details=d))
        .otherwise(outcome("PASS", truncated(v, 40), "The viewport suits mobile devices.", details=d))
    )


@check("charset", "Character encoding", "technical", 2)
def charset() -> Column:
    c = fact("charset")
    plain = F.regexp_replace(F.lower(c), "[^a-z0-9]", "")
    return (
        F.when(F.coalesce(c, F.lit("")) == "", outcome("WARNING", "Not declared", "No character encoding is declared.", "LOW"))
        .when(plain == "utf8", outcome("PASS", c, "The encoding is UTF-8.", details={"charset": c}))
        .otherwise(outcome("INFO", c, "The encoding is not UTF-8.", details={"charset": c}))
    )


@check("favicon", "Favicon", "technical", 2)
def favicon() -> Column:
    n = F.size(fact("favicons"))
    return F.when(n == 0, outcome("WARNING", "Not declared", "No icon is declared.", "LOW", "inferred")).otherwise(outcome("PASS", plural(n, "icon"), "Icons are declared.", details={"icons": F.slice(F.transform(fact("favicons"), lambda x: x["href"]), 1, 5)}))


# on-page


@check("title", "Title tag", "on-page", 10)
def title() -> Column:
    n, first = F.size(fact("titles")), F.coalesce(F.get(fact("titles"), 0), F.lit(""))
    size = units(first)
    many = F.concat(size.cast("string"), F.lit(" characters"))
    d = {"title": first, "length": size}
    return (
        F.when(n == 0, outcome("ERROR", "Missing", "The page has no title.", "CRITICAL"))
        .when(_blank(first), outcome("ERROR", "Empty", "The title is empty.", "CRITICAL"))
        .when(n > 1, outcome("WARNING", F.concat(n.cast("string"), F.lit(" title tags")), "The page has several titles.", "MEDIUM", details={"titles": fact("titles")}))
        .when(size < TITLE_SHORT, outcome("WARNING", many, "The title is short.", "MEDIUM", details=d))
        .when(size > TITLE_VERY_LONG, outcome("WARNING", many, "The title is very long.", "MEDIUM", details=d))
        .when(size > TITLE_LONG, outcome("WARNING", many, "The title is long.", "LOW", details=d))
        .otherwise(outcome("PASS", many, "The title has a good length.", details=d))
    )


@check("meta-description", "Meta description", "on-page", 8)
def meta_description() -> Column:
    n, first = F.size(fact("meta_descriptions")), F.coalesce(F.get(fact("meta_descriptions"), 0), F.lit(""))
    size = units(first)
    many = F.concat(size.cast("string"), F.lit(" characters"))
    d = {"description": first, "length": size}
    return (
        F.when(n == 0, outcome("WARNING", "Missing", "There is no meta description.", "MEDIUM"))
        .when(_blank(first), outcome("WARNING", "Empty", "The meta description is empty.", "MEDIUM"))
        .when(n > 1, outcome("WARNING", F.concat(n.cast("string"), F.lit(" tags")), "There are several meta descriptions.", "LOW", details={"descriptions": fact("meta_descriptions")}))
        .when(size < DESCRIPTION_SHORT, outcome("WARNING", many, "The meta description is short.", "LOW", details=d))
        .when(size > DESCRIPTION_VERY_LONG, outcome("WARNING", many, "The meta description is very long.", "LOW", details=d))
        .when(size > DESCRIPTION_LONG, outcome("PASS", many, "The meta description is longer than most results show.", details=d))
        .otherwise(outcome("PASS", many, "The meta description has a good length.", details=d))
    )


def _of_level(*levels: int) -> Column:
    return F.filter(fact("headings"), lambda h: h["level"].isin(*levels))


@check("h1", "H1 heading", "on-page", 8)
def h1() -> Column:
    every = _of_level(1)
    full = F.filter(every, lambda h: ~h["is_empty"])
    n, d = F.size(every), {"count": F.size(every), "texts": F.slice(F.transform(full, lambda h: h["text"]), 1, 5)}
    return (
        F.when(n == 0, outcome("WARNING", "Missing", "There is no H1.", "HIGH"))
        .when(F.size(full) == 0, outcome("WARNING", F.concat(n.cast("string"), F.lit(" empty")), "Every H1 is empty.", "HIGH", details={"count": n}))
        .when(n > 1, outcome("WARNING", F.concat(n.cast("string"), F.lit(" H1 headings")), "There are several H1.", "LOW", details=d))
        .otherwise(outcome("PASS", truncated(F.get(full, 0)["text"], 60), "There is one H1.", details=d))
    )


@check("heading-structure", "Heading structure", "on-page", 5)
def heading_structure() -> Column:
    h = fact("headings")
    n = F.size(h)
    empty = F.size(F.filter(h, lambda x: x["is_empty"]))
    levels = F.transform(h, lambda x: x["level"])
    # each level against the one before it
    skips = F.when(n > 1, F.size(F.filter(F.zip_with(F.slice(levels, 2, F.greatest(n - 1, F.lit(0))), F.slice(levels, 1, F.greatest(n - 1, F.lit(0))), lambda a, b: a > b + 1), lambda x: x))).otherwise(0)
    count = lambda k: F.size(_of_level(k)).cast("string")
    d = {f"h{k}": F.size(_of_level(k)) for k in range(1, 7)} | {"empty": empty, "skips": skips}
    return (
        F.when(n == 0, outcome("WARNING", "No headings", "There are no headings.", "MEDIUM"))
        .when(empty > 0, outcome("WARNING", plural(empty, "empty heading"), "Headings are empty.", "LOW", details=d))
        .when(skips > 0, outcome("WARNING", plural(skips, "skipped level"), "Heading levels are skipped.", "LOW", details=d))
        .otherwise(outcome("PASS", F.concat(count(1), F.lit(" H1, "), count(2), F.lit(" H2, "), count(3), F.lit(" H3")), "The headings are in order.", details=d))
    )


@check("image-alt", "Image alt text", "on-page", 6)
def image_alt() -> Column:
    i = fact("images")
    n = F.size(i)
    some = lambda test: F.size(F.filter(i, test))
    missing, linked = some(lambda x: x["alt"].isNull()), some(lambda x: x["alt"].isNull() & x["is_linked"])
    d = {"total": n, "described": some(lambda x: ~_blank(x["alt"])), "decorative": some(lambda x: x["alt"] == ""), "missing": missing, "linkedWithoutAlt": linked}
    return (
        F.when(n == 0, outcome("INFO", "No images", "There are no images.", details={"total": n}))
        .when(missing == 0, outcome("PASS", F.concat(n.cast("string"), F.lit("/"), n.cast("string"), F.lit(" have alt")), "Every image has an alt attribute.", details=d))
        .otherwise(outcome("WARNING", F.concat(plural(missing, "image"), F.lit(" missing alt")), "Images lack alt attributes.", F.when((linked > 0) | (missing * 2 > n), "MEDIUM").otherwise("LOW"), details=d))
    )


# content


@check("word-count", "Word count", "content", 7)
def word_count() -> Column:
    n, d = fact("word_count"), {"wordCount": fact("word_count"), "paragraphCount": fact("paragraph_count")}
    said = F.concat(F.lit("The page has "), plural(n, "word"), F.lit(" of text."))
    very = "Say what a visitor came for; if there is no more to say, this need not be a page of its own."
    return F.when(n < VERY_THIN, outcome("WARNING", plural(n, "word"), said, "MEDIUM", details=d, advice=very)).when(n < THIN, outcome("WARNING", plural(n, "word"), said, "LOW", details=d, advice="Say more about the subject, if there is more to say.")).otherwise(outcome("PASS", plural(n, "word"), said, details=d))


@check("content-structure", "Content structure", "content", 5)
def content_structure() -> Column:
    n, p = fact("word_count"), fact("paragraph_count")
    sub = F.size(F.filter(_of_level(2, 3, 4), lambda h: ~h["is_empty"]))
    d = {"wordCount": n, "subheadings": sub, "paragraphCount": p}
    return (
        F.when(n < THIN, outcome("UNAVAILABLE", "Not enough text", "There is too little text to judge its structure.", details=d))
        .when((n > LONG_TEXT) & (sub == 0), outcome("WARNING", "No subheadings", "A long text has no subheadings.", "MEDIUM", details=d))
        .when((n > VERY_LONG_TEXT) & (sub < 3), outcome("WARNING", plural(sub, "subheading"), "A very long text has few subheadings.", "LOW", details=d))
        .when((p == 0) & (n > THIN), outcome("WARNING", "No paragraphs", "The text has no paragraphs.", "LOW", details=d))
        .otherwise(outcome("PASS", F.concat(plural(sub, "subheading"), F.lit(", "), plural(p, "paragraph")), "The text is structured.", details=d))
    )


def shown_number(x: Column) -> Column:
    """A number of one decimal as scripts print it: without .0."""
    return F.regexp_replace(x.cast("string"), r"\.0$", "")


@check("content-rendering", "Content rendering", "content", 3)
def content_rendering() -> Column:
    n, size = fact("word_count"), fact("html_bytes")
    ratio = F.when(fact("html_units") > 0, fact("character_count").cast("double") / fact("html_units")).otherwise(0.0)
    percent = F.floor(ratio * 1000 + 0.5) / F.lit(10.0)
    d = {"wordCount": n, "htmlBytes": size, "ratioPercent": percent}
    value = F.concat(shown_number(percent), F.lit("% text"))
    return F.when((n < RENDERED_WORDS) & (size > RENDERED_BYTES), outcome("WARNING", value, "Much markup with little text: probably rendered by scripts.", "MEDIUM", "inferred", d)).otherwise(outcome("PASS", value, "The text is in the markup.", details=d))


# links


def _links(*kinds: str) -> Column:
    return F.filter(fact("links"), lambda x: x["kind"].isin(*kinds))


def _rel(links: Column, token: str) -> Column:
    return F.size(F.filter(links, lambda x: F.array_contains(x["rel"], token)))


@check("internal-links", "Internal links", "links", 5)
def internal_links() -> Column:
    own = _links("internal")
    n, no = F.size(own), _rel(own, "nofollow")
    unique = F.array_distinct(F.transform(own, lambda x: x["resolved"]))
    d = {"total": n, "unique": F.size(unique), "nofollowed": no, "samples": F.slice(unique, 1, 10)}
    return (
        F.when(n == 0, outcome("WARNING", "0 internal links", "The page links to no other page of its site.", "MEDIUM", details={"total": n, "unique": n, "nofollowed": n}))
        .when(no == n, outcome("WARNING", F.concat(n.cast("string"), F.lit(" (all nofollow)")), "Every internal link is nofollow.", "MEDIUM", details=d))
        .otherwise(outcome("PASS", plural(n, "internal link"), "The page links to others of its site.", details=d))
    )


@check("external-links", "External links", "links", 3)
def external_links() -> Column:
    out = _links("external")
    n, hosts = F.size(out), F.array_distinct(F.transform(out, lambda x: x["host"]))
    d = {"total": n, "uniqueHosts": F.size(hosts), "samples": F.slice(hosts, 1, 10)} | {t: _rel(out, t) for t in ("nofollow", "sponsored", "ugc")}
    marked = F.exists(out, lambda x: F.arrays_overlap(x["rel"], F.array(*map(F.lit, ("nofollow", "sponsored", "ugc")))))
    unmarked = F.when(~marked, "Fine for ordinary references; mark links that are paid for or come from users.")
    return F.when(n == 0, outcome("INFO", "0 external links", "The page links to no other site.", details={"total": n})).otherwise(outcome("PASS", plural(n, "external link"), F.concat(F.lit("Links lead to "), plural(F.size(hosts), "other website"), F.lit(".")), details=d, advice=unmarked))


@check("link-quality", "Link quality", "links", 4)
def link_quality() -> Column:
    n = F.size(fact("links"))
    go = _links("internal", "external")
    empty, script = F.size(_links("empty")), F.size(_links("javascript"))
    silent = F.size(F.filter(go, lambda x: x["anchor_text"] == ""))
    vague = F.size(F.filter(go, lambda x: trimmed(F.regexp_replace(F.lower(x["anchor_text"]), "[.!…»>]+$", "")).isin(*UNINFORMATIVE)))
    unsafe = F.size(F.filter(go, lambda x: (F.coalesce(x["target"], F.lit("")) == "_blank") & (x["kind"] == "external") & ~F.array_contains(x["rel"], "noopener") & ~F.array_contains(x["rel"], "noreferrer")))
    first = (
        F.when(empty > 0, F.concat(plural(empty, "link"), F.lit(" with an empty href")))
        .when(script > 0, plural(script, "javascript: link"))
        .when(silent > 0, F.concat(plural(silent, "link"), F.lit(" with no link text")))
        .when(vague > 0, F.concat(plural(vague, "link"), F.lit(" using non-descriptive text")))
    )
    count = lambda k: F.size(_links(k))
    d = {"total": n, "empty": empty, "javascript": script, "emptyAnchorText": silent, "uninformativeAnchorText": vague, "unsafeNewTab": unsafe, "fragments": count("fragment"), "mailto": count("mailto"), "tel": count("tel")}
    return (
        F.when(n == 0, outcome("INFO", "No links", "There are no links.", details={"total": n}))
        .when(first.isNull() & (unsafe == 0), outcome("PASS", F.concat(n.cast("string"), F.lit(" links checked")), "Links have destinations and texts.", details=d))
        .when(first.isNull(), outcome("WARNING", F.concat(plural(unsafe, "link"), F.lit(" missing rel")), "Links open new tabs without noopener.", "LOW", details=d))
        .otherwise(outcome("WARNING", first, "Links lack destinations or descriptive texts.", F.when(empty + silent > 5, "MEDIUM").otherwise("LOW"), details=d))
    )


# structured data


@check("json-ld", "JSON-LD structured data", "structured-data", 7)
def json_ld() -> Column:
    b = fact("json_ld")
    n, bad = F.size(b), F.size(F.filter(b, lambda x: ~x["valid"]))
    types = F.array_distinct(F.flatten(F.transform(b, lambda x: x["types"])))
    k = F.size(types)
    value = F.concat(F.array_join(F.slice(types, 1, 3), ", "), F.when(k > 3, F.concat(F.lit(" +"), (k - 3).cast("string"))).otherwise(""))
    d = {"blocks": n, "invalid": bad, "types": types, "notable": F.filter(types, lambda t: t.isin(*NOTABLE_TYPES))}
    wrong = F.concat(plural(bad, "block"), F.lit(" invalid"))
    return (
        F.when(n == 0, outcome("INFO", "None found", "There is no JSON-LD.", details={"blocks": n}))
        .when(bad == n, outcome("ERROR", wrong, "No JSON-LD block is valid JSON.", "HIGH", details=d))
        .when(bad > 0, outcome("WARNING", wrong, "JSON-LD blocks are not valid JSON.", "MEDIUM", details=d))
        .when(k == 0, outcome("WARNING", "No @type", "JSON-LD declares no type.", "LOW", details=d))
        .otherwise(outcome("PASS", value, "JSON-LD is valid.", details=d, advice=F.when(F.size(d["notable"]) == 0, "None of these types makes results richer, which need not matter for this page.")))
    )


@check("microdata", "Microdata and RDFa", "structured-data", 3)
def microdata() -> Column:
    n = F.size(fact("microdata_types")) + F.size(fact("rdfa_types"))
    d = {"microdata": fact("microdata_types"), "rdfa": fact("rdfa_types")}
    return F.when(n == 0, outcome("INFO", "None found", "There is no microdata or RDFa.", details=d)).otherwise(outcome("PASS", F.concat(plural(n, "type"), F.lit(" found")), "Microdata or RDFa is present.", details=d, advice=F.when(F.size(fact("json_ld")) > 0, "There is JSON-LD too: see that both say the same.")))


# social


@check("open-graph", "Open Graph", "social", 6)
def open_graph() -> Column:
    og = fact("open_graph")
    n = F.size(og)
    missing = lambda names: F.array_compact(F.array(*[F.when(_blank(_lookup(og, k)), F.lit(k)) for k in names]))
    need, nice = missing(OG_REQUIRED), missing(OG_RECOMMENDED)
    d = {"present": _keys(og), "missing": F.concat(need, nice)}
    return (
        F.when(n == 0, outcome("WARNING", "Missing", "There is no Open Graph metadata.", "MEDIUM", details=d))
        .when(F.size(need) > 0, outcome("WARNING", F.concat(F.lit("Partial ("), n.cast("string"), F.lit(" tags)")), F.concat(F.lit("Open Graph lacks "), F.array_join(need, ", "), F.lit(".")), F.when(F.array_contains(need, "og:image"), "MEDIUM").otherwise("LOW"), details=d, advice=F.concat(F.lit("Add "), F.array_join(need, ", "), F.lit("."))))
        .otherwise(outcome("PASS", "Complete", "Open Graph metadata is complete.", details=d, advice=F.when(F.size(nice) > 0, "og:url and og:type are optional: the address to share, and what kind of page it is.")))
    )


@check("twitter-card", "Twitter/X card", "social", 4)
def twitter_card() -> Column:
    t = fact("twitter")
    card = F.coalesce(_lookup(t, "twitter:card"), F.lit(""))
    og = F.size(fact("open_graph")) > 0
    d = {"present": _keys(t), "cardType": _lookup(t, "twitter:card"), "hasOpenGraphFallback": og}
    return (
        F.when((F.size(t) == 0) & og, outcome("INFO", "Missing", "There is no card, but Open Graph serves in its place.", details=d))
        .when(F.size(t) == 0, outcome("WARNING", "Missing", "There is no card and nothing in its place.", "LOW", details=d))
        .when(card == "", outcome("WARNING", "No card type", "The card has no type.", "LOW", details=d))
        .when(~trimmed(card).isin(*CARD_TYPES), outcome("WARNING", truncated(card, 30), "The card's type is unknown.", "LOW", details=d))
        .otherwise(outcome("PASS", card, "The card is set up.", details=d))
    )


