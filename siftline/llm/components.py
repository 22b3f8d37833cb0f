"""Connected components of a link table, by alternating large and small stars.

Every step is a few joins and aggregations on the links; nothing is collected. Each round's links
are written to the shared folder, so that a lost executor costs one round at most.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Stash


def _large(e: DataFrame) -> DataFrame:
    both = e.unionByName(e.select(F.col("b").alias("a"), F.col("a").alias("b")))
    least = both.groupBy(F.col("a").alias("_a")).agg(F.min("b").alias("_m"))
    near = both.filter("b > a").join(least, F.col("a") == F.col("_a"))
    return near.select(F.col("b").alias("a"), F.least("_m", "a").alias("b")).filter("a <> b").distinct()


def _small(e: DataFrame) -> DataFrame:
    down = e.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
    least = down.groupBy(F.col("a").alias("_a")).agg(F.min("b").alias("_m"))
    near = down.join(least, F.col("a") == F.col("_a"))
    return near.select(F.col("b").alias("a"), F.col("_m").alias("b")).unionByName(least.select(F.col("_a").alias("a"), F.col("_m").alias("b"))).filter("a <> b").distinct()


def components(links: DataFrame, stash: Stash) -> DataFrame:
    """links (a, b) of any order and repetition to (node, root): the least node that is reachable.

    Nodes without links, or only with themselves, have no row.
    """
    e, at = stash.put(links.filter("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct())
    before = None
    while True:
        e, new = stash.put(_small(_large(e)))
        # the stars are final if the links no longer change; two independent sums tell
        now = e.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)")), F.sum(F.hash("a", "b").cast("long"))).first()
        stash.drop(at)
        at = new
        if now == before:
            return e.select(F.col("a").alias("node"), F.col("b").alias("root"))
        before = now
