"""Questions over many audits: facets, distributions, search, shares."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.urls import host_of, registrable_domain
from .registry import BANDS, CATEGORIES


def status_facets(results: DataFrame) -> DataFrame:
    """Findings by status, and of all (status null)."""
    return results.groupingSets([["status"], []], "status").agg(F.count(F.lit(1)).alias("n_results"))


def by_check(results: DataFrame) -> DataFrame:
    return results.groupBy("check_key", "status").agg(F.count(F.lit(1)).alias("n_pages"))


def bands(scores: DataFrame) -> DataFrame:
    """Pages by band, with their share of all in percent."""
    n = scores.groupBy("band").agg(F.count(F.lit(1)).alias("n_pages"))
    return n.select("band", "n_pages", (F.col("n_pages") * 100.0 / F.sum("n_pages").over(W.partitionBy())).alias("share"))


def by_site(scores: DataFrame) -> DataFrame:
    site = registrable_domain(host_of(F.col("url"))).alias("site")
    return scores.groupBy(site).agg(F.count(F.lit(1)).alias("n_pages"), F.sum("total").cast("long").alias("sum_total"), F.min("total").alias("min_total"), F.max("total").alias("max_total"))


def search(results: DataFrame, needle: str) -> DataFrame:
    """Findings whose title, key, value, message, recommendation or category's label contains the needle."""
    label = F.coalesce(*[F.when(F.col("category") == k, F.lit(name)) for k, _, name in CATEGORIES])
    hay = F.lower(F.concat_ws(" ", "title", "check_key", "value", "message", "recommendation", label))
    return results.filter(hay.contains(needle.strip().lower()))


def by_category(results: DataFrame) -> DataFrame:
    """Each page's check keys by category, in registry order."""
    ordered = F.transform(F.array_sort(F.collect_list(F.struct("ordinal", "check_key"))), lambda x: x["check_key"])
    return results.groupBy("page_id", "category").agg(F.array_join(ordered, ",").alias("check_keys"))


def max_points(dim: DataFrame, categories: DataFrame) -> DataFrame:
    """What each check can be worth of 100 points."""
    whole = F.sum("weight").over(W.partitionBy("category"))
    return dim.join(F.broadcast(categories), "category").select("check_key", "category", "weight", (F.col("weight").cast("double") / whole * F.col("category_weight")).alias("points"))


def tone(ratio: Column) -> Column:
    return F.when(ratio.isNull(), "none").when(ratio >= 0.85, "good").when(ratio >= 0.6, "fair").otherwise("poor")


def canonical_duplicates(keys: DataFrame) -> DataFrame:
    """(page_id, canonical_key) to keys that several pages share."""
    return keys.filter("canonical_key IS NOT NULL").groupBy("canonical_key").agg(F.count(F.lit(1)).alias("n_pages"), F.min("page_id").alias("first_page")).filter("n_pages > 1")


def band_dim(spark) -> DataFrame:
    tops = [101, *[low for low, _ in BANDS]]
    return spark.createDataFrame([(low, high - 1, name) for (low, name), high in zip(BANDS, tops)], "low int, high int, band string")


def band_join(scores: DataFrame) -> DataFrame:
    """scores with the band by a range join on four rows."""
    dim = F.broadcast(band_dim(scores.sparkSession).withColumnRenamed("band", "joined_band"))
    return scores.join(dim, F.col("total").between(F.col("low"), F.col("high"))).drop("low", "high")
