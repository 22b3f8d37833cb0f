"""Audits of small pages, and the queries against their SQL on the smallest tables."""

import os

import duckdb
import pytest

from siftline.operators.audit import audit
from siftline.operators.scoring import priority_issues
from siftline.plans import queries as plans

GOOD = (
    '<!doctype html><html lang="en"><head><meta charset="utf-8"><meta name="viewport" content="width=device-width, initial-scale=1"><title>A good title for this page here</title><meta name="description" content="'
    + "A description that is long enough to be useful in a list of results. " * 2
    + '"><link rel="canonical" href="https://example.com/good"><link rel="icon" href="/i.png"><meta property="og:title" content="t"><meta property="og:description" content="d"><meta property="og:image" content="i"><meta name="twitter:card" content="summary">'
    + '<script type="application/ld+json">{"@type":"Article"}</script></head><body><h1>Title</h1><h2>One</h2><h2>Two</h2><p>'
    + "several words of text " * 120
    + '</p><a href="/other">Our other page</a><img src="x" alt="y"></body></html>'
)
BAD = '<html><body><img src="a"><img src="b"><a href="">x</a><a href="javascript:void(0)">y</a></body></html>'


@pytest.fixture(scope="module")
def done(spark):
    rows = [(1, "https://example.com/good", GOOD), (2, "http://example.com/bad", BAD), (3, "https://example.com/", ""), (4, None, None), (5, "https://example.com/n", GOOD.replace("<head>", '<head><meta name="robots" content="noindex">'))]
    a = audit(spark.createDataFrame(rows, "page_id long, url string, html string"))
    results = a.results
    return {r.page_id: r for r in a.scores.collect()}, {(r.page_id, r.check_key): r for r in results.collect()}, {(r.page_id, r["rank"]): r for r in priority_issues(a.pages).collect()}


def test_good_page(done):
    scores, results, _ = done
    assert scores[1].total >= 90 and scores[1].band == "excellent" and scores[1].n_error == 0
    assert results[1, "canonical"].status == "PASS" and results[1, "json-ld"].value == "Article"


def test_bad_page(done):
    scores, _, top = done
    assert scores[2].total < 70 and {top[2, k].check_key for k in (1, 2)} == {"https", "title"}


def test_noindex(done):
    assert done[1][5, "robots-meta"].severity == "CRITICAL"


def test_every_page_has_26_results(done):
    assert len(done[1]) == 5 * 26
    for r in done[1].values():
        assert r.status in ("PASS", "WARNING", "ERROR", "INFO", "UNAVAILABLE") and r.message
        assert r.severity == "INFO" or r.status in ("WARNING", "ERROR")


@pytest.mark.parametrize("name", ["page_scores", "check_results", "priority_issues", "robots_verdicts", "sitemap_membership", "rate_limits", "page_links", "labels", "weight_table", "detail_rows", "full_reports", "search_checks", "stage_events", "stored_sites", "stored_checks", "address_classes", "address_networks", "speed_metrics", "speed_opportunities", "fetch_gates", "guided_checks", "check_details", "archived_pages"])
def test_against_sql(spark, name):
    sf = "/root/testdata/sf0.001"
    if not os.path.isdir(sf):
        pytest.skip("no tables")
    con = duckdb.connect()
    for t in ("pages", "events", "supplier"):
        con.execute(f"create view {t} as select * from '{sf}/{t}.parquet'")
    want = con.execute(plans.oracle_sql()[name]).df()
    got = plans.QUERIES[name](spark, sf).toPandas()
    assert sorted(got.columns) == sorted(want.columns)
    rows = lambda d: sorted(tuple(map(str, r)) for r in d[sorted(d.columns)].itertuples(index=False))
    assert rows(got) == rows(want)


CUT = ["page_titles", "page_text_stats", "page_metadata", "check_results", "check_details", "detail_rows", "page_scores", "category_scores", "checks_by_status", "status_facets", "labels", "guided_checks"]


def equals_sql(spark, name, sf, *tables):
    con = duckdb.connect()
    for t in tables:
        con.execute(f"create view {t} as select * from '{sf}/{t}.parquet'")
    want = con.execute(plans.oracle_sql()[name])
    columns = [c[0] for c in want.description]
    return sorted((tuple(r) for r in plans.QUERIES[name](spark, str(sf)).select(*columns).collect()), key=repr) == sorted(want.fetchall(), key=repr)


@pytest.mark.parametrize("name", CUT)
def test_titles_cut_inside_a_reference_equal_sql(spark, tmp_path, name):
    """The title has 20 characters, and passes, if &amp without a semicolon stays."""
    page = lambda i: f'<!DOCTYPE html><html lang="en"><head><meta charset="utf-8"><title>sixteen letters &amp</title></head><body><a href="/a">a</a><h1>sixteen letters &amp</h1><p>{"word " * i}</p></body></html>'
    rows = [(i, f"https://example.org/{i}", page(i)) for i in (90, 298, 299, 600)]
    con = duckdb.connect()
    con.execute("create table p (page_id bigint, url varchar, html varchar)")
    con.executemany("insert into p values (?, ?, ?)", rows)
    con.execute(f"copy p to '{tmp_path}/pages.parquet' (format parquet)")
    assert equals_sql(spark, name, tmp_path, "pages")


def test_sitemaps_beyond_the_limits_of_a_fetched_one_equal_sql(spark, tmp_path):
    con = duckdb.connect()
    con.execute(f"copy (select i::bigint as page_id, 'https://example.org/p/' || (i % 11000) || '?a=1&b=' || i // 22000 as url, '' as html from range(12500) r(i) union all select 99999, 'https://odd.org/', '') to '{tmp_path}/pages.parquet' (format parquet)")
    assert equals_sql(spark, "sitemap_membership", tmp_path, "pages")


def test_events_without_a_time_and_sessions_of_another_zone_equal_sql(spark, tmp_path):
    con = duckdb.connect()
    con.execute(f"copy (select i::bigint as event_id, case when i % 7 <> 0 then timestamp '2024-03-10 00:20:00' + i * interval 17 minute end as ts, case when i % 5 <> 0 then 'view' end as event_type from range(200) r(i)) to '{tmp_path}/events.parquet' (format parquet)")
    try:
        for zone in ("UTC", "America/New_York"):  # there 02:00 does not exist that day
            spark.conf.set("spark.sql.session.timeZone", zone)
            assert equals_sql(spark, "event_windows", tmp_path, "events")
    finally:
        spark.conf.set("spark.sql.session.timeZone", "UTC")
