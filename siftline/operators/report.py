"""Parts of a printed report, and the site's own robots.txt and sitemap."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .advice import GUIDES
from .audit import Audit
from .registry import CATEGORIES, DEDUCTIONS

# The site's pages, how often they change and their priority; those of guides.
ROUTES = (("/", "monthly", 1.0), ("/seo-checker", "monthly", 0.9), ("/how-it-works", "monthly", 0.8), ("/seo-guides", "monthly", 0.8), ("/about", "yearly", 0.5), ("/contact", "yearly", 0.4), ("/privacy", "yearly", 0.3), ("/terms", "yearly", 0.3))
GUIDE_ROUTE = ("/seo-guides/", "yearly", 0.7)
# Paths of the site that crawlers may not fetch.
CLOSED = ("/api/", "/audit/")


def detail_rows(a: Audit, duration_ms: Column | None = None) -> DataFrame:
    """(page_id, ordinal, label, value): what a report's technical part lists; the time only if it is known."""
    f = lambda x: F.col(f"facts.{x}")
    text = lambda c: c.cast("string")
    size = lambda c: text(F.size(c))
    hops = F.transform("fetch.redirects", lambda h: F.concat(text(h["status"]), F.lit(" → "), F.coalesce(h["location"], F.lit("?"))))
    kind = lambda k: F.filter(f("links"), lambda x: x["kind"] == k)
    types = F.array_distinct(F.flatten(F.transform(f("json_ld"), lambda b: b["types"])))
    rows = [
        ("Requested URL", F.col("url")),
        ("Final URL", F.col("final_url")),
        ("HTTP status", text(F.col("fetch.final_status"))),
        ("Redirects", F.when(F.size("fetch.redirects") > 0, F.array_join(hops, "  ·  ")).otherwise("None")),
        ("Content type", F.coalesce(F.element_at("fetch.headers", "content-type"), F.lit("Not declared"))),
        ("Response size", F.format_string("%.1f KB", f("html_bytes") / 1024)),
        ("Title", F.coalesce(F.get(f("titles"), 0), F.lit("Not present"))),
        ("Meta description", F.coalesce(F.get(f("meta_descriptions"), 0), F.lit("Not present"))),
        ("Canonical", F.coalesce(F.get(f("canonicals"), 0)["href"], F.lit("Not present"))),
        ("Language", F.coalesce(f("html_lang"), F.lit("Not declared"))),
        ("Word count", text(f("word_count"))),
        ("Links", F.concat(size(kind("internal")), F.lit(" internal · "), size(kind("external")), F.lit(" external"))),
        ("Images", F.concat(size(f("images")), F.lit(" total · "), size(F.filter(f("images"), lambda x: x["alt"].isNull())), F.lit(" missing alt"))),
        ("Schema types", F.when(F.size(types) > 0, F.array_join(types, ", ")).otherwise("None detected")),
        *([("Analysis time", F.format_string("%.2f seconds", duration_ms / 1000))] if duration_ms is not None else []),
    ]
    listed = F.array(*[F.struct(F.lit(name).alias("label"), c.alias("value")) for name, c in rows])
    return a.wide.select("page_id", F.posexplode(listed).alias("ordinal", "row")).select("page_id", F.col("ordinal").cast("long").alias("ordinal"), "row.label", "row.value")


def weight_table(a: Audit) -> DataFrame:
    """(page_id, ordinal, category, base, max_score, change, score): each category's base weight beside what it
    counts in this audit, and last the total."""
    row = lambda name, base, most, score: F.struct(F.lit(name).alias("category"), F.lit(base).cast("int").alias("base"), most.cast("int").alias("max_score"), (most - base).cast("int").alias("change"), score.cast("int").alias("score"))
    own = lambda name, field: F.get(F.filter("category_scores", lambda c: c["category"] == name), 0)[field]
    rows = [row(name, weight, own(name, "max_score"), own(name, "score")) for name, weight, _ in CATEGORIES]
    rows.append(row("total", 100, F.lit(100), F.col("total")))
    return a.wide.select("page_id", F.posexplode(F.array(*rows)).alias("ordinal", "r")).select("page_id", F.col("ordinal").cast("long").alias("ordinal"), "r.*")


def deductions(spark: SparkSession) -> DataFrame:
    """The severities that take something off a check, as one line."""
    rows = spark.createDataFrame([(i, s, d) for i, (s, d) in enumerate(DEDUCTIONS)], "ordinal int, severity string, share double").filter("share > 0")
    one = F.struct("ordinal", F.concat(F.lower("severity"), F.lit(" "), F.round(F.col("share") * 100).cast("int").cast("string"), F.lit("%")).alias("text"))
    return rows.agg(F.array_join(F.transform(F.array_sort(F.collect_list(one)), lambda x: x["text"]), ", ").alias("deductions"))


def site_sitemap(spark: SparkSession, base: str, changed: str) -> DataFrame:
    """(loc, lastmod, changefreq, priority) of the site's pages and guides."""
    path, often, priority = GUIDE_ROUTE
    rows = [*ROUTES, *[(path + g, often, priority) for g in GUIDES]]
    return spark.createDataFrame([(base + p, changed, o, w) for p, o, w in rows], "loc string, lastmod string, changefreq string, priority double")


def site_robots(base: str) -> str:
    """robots.txt of the site."""
    return "\n".join(["User-agent: *", "Allow: /", *[f"Disallow: {p}" for p in CLOSED], "", f"Host: {base}", f"Sitemap: {base}/sitemap.xml", ""])
