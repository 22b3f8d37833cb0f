"""The audit: pages in, facts, check results, scores and priorities out."""

from __future__ import annotations

from typing import NamedTuple

from pyspark import SparkContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.html import with_facts
from ..functions.urls import authority_of, scheme_of
from ..sources.pages import kept_headers
from . import checks  # noqa: F401  fills the registry
from .advice import ADVICE
from .registry import CHECKS
from .scoring import settled, with_scores

FETCH = "struct<ok:boolean,initial_status:int,final_status:int,redirects:array<struct<url:string,status:int,location:string>>,headers:map<string,string>>"
ROBOTS = "struct<retrieved:boolean,url:string,status:int,error:string,sitemaps:array<string>,path_verdict:string,matched_rule:string>"
SITEMAP = "struct<checked_urls:array<string>,found_url:string,retrieved:boolean,status:int,error:string,kind:string,url_count:int,count_truncated:boolean,contains_audited_url:string,discovered_via:string>"


def origin(url: Column) -> Column:
    return F.lower(F.concat(scheme_of(url), F.lit("://"), authority_of(url)))


def _assumed(column: str, kind: str, values: dict[str, Column]) -> Column:
    """Where there is no table: what the page's own fetch would have shown at best."""
    return F.struct(*[v.alias(k) for k, v in values.items()]).cast(kind).alias(column)


def default_fetch() -> Column:
    none = F.array().cast("array<struct<url:string,status:int,location:string>>")
    return _assumed("fetch", FETCH, {"ok": F.lit(True), "initial_status": F.lit(200), "final_status": F.lit(200), "redirects": none, "headers": F.create_map(F.lit("content-type"), F.lit("text/html; charset=utf-8"))})


def default_robots(strict: bool) -> Column:
    url = F.concat(origin(F.col("final_url")), F.lit("/robots.txt"))
    return _assumed("robots", ROBOTS, {"retrieved": F.lit(not strict), "url": url, "status": F.lit(None if strict else 200), "error": F.lit(None), "sitemaps": F.array().cast("array<string>"), "path_verdict": F.lit("unknown" if strict else "allowed"), "matched_rule": F.lit(None)})


def default_sitemap(strict: bool) -> Column:
    url = F.concat(origin(F.col("final_url")), F.lit("/sitemap.xml"))
    return _assumed(
        "sitemap", SITEMAP,
        {"checked_urls": F.array(url), "found_url": F.lit(None) if strict else url, "retrieved": F.lit(not strict), "status": F.lit(None if strict else 200), "error": F.lit(None), "kind": F.lit("urlset"), "url_count": F.lit(10), "count_truncated": F.lit(False), "contains_audited_url": F.lit("unknown" if strict else "yes"), "discovered_via": F.lit("convention")},
    )


def context(pages: DataFrame, fetches: DataFrame | None = None, robots: DataFrame | None = None, sitemaps: DataFrame | None = None, strict: bool = False, terminated: bool = False) -> DataFrame:
    """page_id, url, final_url, facts, fetch, robots, sitemap.

    fetches: page_id, final_url and the fields of FETCH; robots: page_id and the fields of ROBOTS
    (see operators.robots); sitemaps: page_id and the fields of SITEMAP (see operators.sitemap).
    Absent tables are assumed to be well, or with strict to be unavailable. terminated: see functions.html.facts.
    """
    def joined(df: DataFrame, table: DataFrame | None, column: str, kind: str, default: Column) -> DataFrame:
        if table is None:
            return df.withColumn(column, default)
        fields = [x.split(":")[0] for x in _fields(kind)]
        side = table.select(F.col("page_id").alias("_p"), F.struct(*fields).cast(kind).alias(column), *(["final_url"] if "final_url" in table.columns else []))
        return df.join(side, F.col("page_id") == F.col("_p"), "left").drop("_p").withColumn(column, F.coalesce(F.col(column), default))

    # a document's own address is where it was found in the end
    if fetches is None:
        df = with_facts(pages, terminated=terminated).withColumn("fetch", default_fetch()).withColumn("final_url", F.col("url"))
    else:
        ends = fetches.select(F.col("page_id").alias("_p"), (F.col("final_url") if "final_url" in fetches.columns else F.lit(None).cast("string")).alias("_end"))
        there = pages.join(ends, F.col("page_id") == F.col("_p"), "left").select("page_id", F.struct("url", F.coalesce("_end", "url").alias("final_url")).alias("at"), "html")
        df = with_facts(there.select("page_id", F.col("at.final_url").alias("url"), "html", F.col("at.url").alias("asked")), "asked", terminated=terminated)
        df = df.select("page_id", F.col("asked").alias("url"), F.col("url").alias("final_url"), "facts")
        df = joined(df, fetches.drop("final_url"), "fetch", FETCH, default_fetch())
        df = df.withColumn("fetch", F.col("fetch").withField("headers", kept_headers(F.col("fetch.headers"))))
    df = joined(df, robots, "robots", ROBOTS, default_robots(strict))
    return joined(df, sitemaps, "sitemap", SITEMAP, default_sitemap(strict))


def _fields(kind: str) -> list[str]:
    """The top-level fields of a struct type's text."""
    inner, out, depth, word = kind[len("struct<") : -1], [], 0, ""
    for c in inner:
        depth += (c == "<") - (c == ">")
        if c == "," and not depth:
            out.append(word)
            word = ""
        else:
            word += c
    return [*out, word]


_built: list = []


def results_of() -> Column:
    """The 26 outcomes as an array in registry order. Thousands of small expressions make it up, so
    it is built once per Spark context and used again for every audit."""
    now = SparkContext._active_spark_context
    if not _built or _built[0] is not now:
        _built[:] = [now, _results()]
    return _built[1]


def _results() -> Column:

    def row(c) -> Column:
        o = c.run()
        why, advice, guide = ADVICE[c.key]
        return F.struct(F.lit(c.ordinal).alias("ordinal"), F.lit(c.key).alias("key"), F.lit(c.title).alias("title"), F.lit(c.category).alias("category"), F.lit(c.weight).alias("weight"), F.lit(why).alias("why"), F.lit(advice).alias("advice"), F.lit(guide).cast("string").alias("guide"), o.alias("o"))

    flat = F.array(*map(row, CHECKS))
    given = lambda x, statuses, what: F.when(x["o"]["status"].isin(*statuses), what)
    return F.transform(
        flat,
        lambda x: F.struct(
            *[x[k].alias(k) for k in ("ordinal", "key", "title", "category", "weight")],
            *[x["o"][k].alias(k) for k in ("status", "severity", "value", "message", "confidence", "details")],
            x["why"].alias("why"),
            F.coalesce(x["o"]["recommendation"], given(x, ("WARNING", "ERROR"), x["advice"])).alias("recommendation"),
            x["o"]["code_example"].alias("code_example"),
            given(x, ("UNAVAILABLE",), x["o"]["message"]).alias("unavailable_reason"),
            x["guide"].alias("guide"),
        ),
    )


class Audit(NamedTuple):
    """wide: one row per page; results, categories: exploded; every frame is lazy. judged is wide before
    its scores, for what needs none of them."""

    wide: DataFrame
    judged: DataFrame | None = None

    @property
    def pages(self) -> DataFrame:
        """One row per page, with results."""
        return self.wide if self.judged is None else self.judged

    @property
    def results(self) -> DataFrame:
        return self.pages.select("page_id", "url", F.inline("results")).withColumnRenamed("key", "check_key")

    @property
    def categories(self) -> DataFrame:
        return self.wide.select("page_id", F.inline("category_scores"))

    @property
    def scores(self) -> DataFrame:
        count = lambda s: F.size(F.filter("results", lambda r: r["status"] == s)).alias(f"n_{s.lower()}")
        return self.wide.select("page_id", "url", "total", "band", "redistributed", *map(count, ("PASS", "WARNING", "ERROR", "INFO", "UNAVAILABLE")))


def audit(pages: DataFrame, fetches: DataFrame | None = None, robots: DataFrame | None = None, sitemaps: DataFrame | None = None, strict: bool = False, terminated: bool = False) -> Audit:
    """Audit pages (page_id, url, html). Parsing is one Arrow pass; checks and scores are Columns of the
    same stage, so an audit without extra tables needs no shuffle."""
    df = context(pages, fetches, robots, sitemaps, strict, terminated)
    judged = settled(df, results=results_of())
    return Audit(with_scores(judged), judged)


def metadata(a: Audit) -> DataFrame:
    """Counts of what was found, one row per page."""
    f = lambda x: F.col(f"facts.{x}")
    size = lambda c, name: F.size(c).cast("int").alias(name)
    robots = F.lower(F.coalesce(f("meta_robots"), F.lit("")))
    return a.wide.select(
        "page_id", F.get(f("titles"), 0).alias("title"), F.get(f("meta_descriptions"), 0).alias("meta_description"), F.get(f("canonicals"), 0)["href"].alias("canonical"), f("html_lang").alias("html_lang"), f("word_count").alias("word_count"),
        size(F.filter(f("headings"), lambda h: h["level"] == 1), "h1_count"), size(F.filter(f("links"), lambda x: x["kind"] == "internal"), "internal_links"), size(F.filter(f("links"), lambda x: x["kind"] == "external"), "external_links"),
        size(f("images"), "images"), size(F.filter(f("images"), lambda x: x["alt"].isNull()), "images_missing_alt"), size(F.array_distinct(F.flatten(F.transform(f("json_ld"), lambda b: b["types"]))), "schema_types"),
        (robots.contains("noindex") | robots.contains("none")).alias("is_noindex"),
    )
