"""Aggregates that are stored with the audits they are of, and merged when they are asked for.

A save adds its own partial aggregates, one row for each time of expiry and group; a question sums
the rows that are still alive, so that it reads as many rows as there are groups, not audits, and a
purge withdraws what it deletes. Counts, sums, least and greatest merge exactly. Distinct counts
are HyperLogLog sketches: merging them counts what several runs or sites share once, within about
1.04 / 2^(LG / 2) of the exact number (one standard deviation).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.urls import canonical_key, host_of, registrable_domain

#: Sketches have 2^LG registers: a standard error of about 1.6 %.
LG = 12
ERROR = 1.04 / 2 ** (LG / 2)
#: Sketched counts are checked within so many standard errors.
ERRORS = 4

_NONE = {"status": "string", "sum_total": "long", "min_total": "int", "max_total": "int", "hosts": "binary", "pages": "binary"}
COLUMNS = ("expires_at", "kind", "name", "status", "n", "sum_total", "min_total", "max_total", "hosts", "pages")


def _rows(df: DataFrame, kind: str) -> DataFrame:
    for c, t in _NONE.items():
        if c not in df.columns:
            df = df.withColumn(c, F.lit(None).cast(t))
    return df.withColumn("kind", F.lit(kind)).select(*COLUMNS)


def sketch(c: Column) -> Column:
    return F.hll_sketch_agg(c, F.lit(LG))


def partials(audits: DataFrame, checks: DataFrame | None = None) -> DataFrame:
    """The partial aggregates of some audits: by state, band, site, and check and status. digest deals
    them out."""
    n = F.count(F.lit(1)).alias("n")
    site = registrable_domain(host_of(F.col("url"))).alias("name")
    done = audits.filter("state = 'COMPLETED'")
    pages = done.select("*", host_of(F.col("url")).alias("_host"), canonical_key(F.col("url")).alias("_page"))
    parts = [
        _rows(audits.groupBy("expires_at", F.col("state").alias("name")).agg(n), "state"),
        _rows(done.groupBy("expires_at", F.col("band").alias("name")).agg(n), "band"),
        _rows(pages.groupBy("expires_at", site).agg(n, F.sum("total").cast("long").alias("sum_total"), F.min("total").alias("min_total"), F.max("total").alias("max_total"), sketch(F.col("_host")).alias("hosts"), sketch(F.col("_page")).alias("pages")), "site"),
    ]
    if checks is not None:
        parts.append(_rows(checks.groupBy("expires_at", F.col("check_key").alias("name"), "status").agg(n), "check"))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out.withColumn("digest", F.sha2(F.concat_ws("|", "kind", "name"), 256))


def _merged(totals: DataFrame, kind: str, *keys: str) -> DataFrame:
    return totals.filter(F.col("kind") == kind).groupBy(*keys)


def bands(totals: DataFrame) -> DataFrame:
    """Pages by band, with their share of all in percent; as analytics.bands of the audits."""
    from pyspark.sql import Window

    n = _merged(totals, "band", F.col("name").alias("band")).agg(F.sum("n").alias("n_pages"))
    # four rows at most
    return n.select("band", "n_pages", (F.col("n_pages") * 100.0 / F.sum("n_pages").over(Window.partitionBy())).alias("share"))


def by_check(totals: DataFrame) -> DataFrame:
    return _merged(totals, "check", F.col("name").alias("check_key"), "status").agg(F.sum("n").alias("n_pages"))


def states(totals: DataFrame) -> DataFrame:
    return _merged(totals, "state", F.col("name").alias("state")).agg(F.sum("n").alias("n_audits"))


def by_site(totals: DataFrame) -> DataFrame:
    """As analytics.by_site of the audits, with estimates of the hosts and pages (canonical keys) of each site."""
    count = lambda c: F.hll_sketch_estimate(F.hll_union_agg(c))
    return _merged(totals, "site", F.col("name").alias("site")).agg(F.sum("n").alias("n_pages"), F.sum("sum_total").alias("sum_total"), F.min("min_total").alias("min_total"), F.max("max_total").alias("max_total"), count("hosts").alias("hosts_about"), count("pages").alias("keys_about"))


def near(estimate: Column, exact: Column) -> Column:
    """Whether a sketched count is within ERRORS standard errors of the exact one."""
    return F.abs(estimate - exact) <= F.greatest(F.lit(1.0), exact * ERRORS * ERROR)
