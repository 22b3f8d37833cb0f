"""Mixing sources to target weights by systematic sampling.

Every source gets a target number of words. Within a source each document expects
target / source size copies; documents are ranked, expected copies are prefix-summed, one offset
is added, and a document is emitted once per integer boundary that its interval crosses.

Expected copies are fixed-point numbers (2**-24), so that the prefix sum is the rank times one
integer: exact, the same in any order of evaluation, and never above the cap.

Defined cases: null text has size 0; sources of size 0 have target 0 and take nothing; a null
source is a source of its own, sorted last; equal rows are ranked one after another; an empty
table gives an empty result; other columns are passed through untouched.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import Stash, packed, read, words_in

#: Weights of the sources in code point order, repeating.
WEIGHTS = (5, 2, 1)
#: No source is taken more often than this on average, no document more often than this at all.
MOST = 3
#: Fractional bits of the expected copies.
BITS = 24
#: Ranks are counted in groups of one source, size and salt, a hash of the id. Groups are summed by
#: CHUNK salts of a size, then by BLOCK sizes, so that a window holds CHUNK groups, or the
#: BLOCK * SALTS / CHUNK chunks of a block, or one row for each block of a source.
SALTS, CHUNK, BLOCK = 1024, 32, 16
SEED = "mix-1"


def running(df: DataFrame, order: list[Column], sums: list[str], stash: Stash) -> DataFrame:
    """df with before_x for each x of sums, the sum of what stands earlier in the order.

    The rows are dealt by ranges of the order; within a range a window adds, and before the ranges
    a table of one row for each range. No task sees all rows.
    """
    dealt = stash.keep(df.repartitionByRange(*order).withColumn("range", F.spark_partition_id()))
    none = W.unboundedPreceding
    upto = W.orderBy("range").rowsBetween(none, -1)  # one row for each range
    ranges = dealt.groupBy("range").agg(*(F.sum(c).alias(f"_{c}") for c in sums)).select(F.col("range").alias("_range"), *(F.coalesce(F.sum(f"_{c}").over(upto), F.lit(0)).alias(f"_before_{c}") for c in sums))
    inner = W.partitionBy("range").orderBy(*order).rowsBetween(none, -1)
    within = dealt.select("*", *(F.coalesce(F.sum(c).over(inner), F.lit(0)).alias(f"_within_{c}") for c in sums))
    both = within.join(F.broadcast(ranges), F.col("range") == F.col("_range"))
    return both.select(*df.columns, *((F.col(f"_before_{c}") + F.col(f"_within_{c}")).alias(f"before_{c}") for c in sums))


def targets(per_source: DataFrame, weights=WEIGHTS, most: int = MOST) -> DataFrame:
    """(source, source_size) to those with target: water-filling by weight under the caps.

    A source is full if its cap is reached at the level that the others and it would share; the
    sources are sorted by cap per weight, so the full ones come first, and the level of the first
    open one, the highest of the open ones', is what all open ones get. Places and sums run over
    ranges of sources, so that there may be any number of these.
    """
    stash = Stash(per_source.sparkSession, "targets")
    placed = running(per_source.select("source", "source_size", F.lit(1).cast("long").alias("one")), [F.col("source").asc_nulls_last()], ["one"], stash)
    w = F.element_at(F.array(*map(F.lit, weights)), (F.col("place") % len(weights) + 1).cast("int")).cast("double")
    placed = placed.withColumnRenamed("before_one", "place").withColumn("w", w).withColumn("cap", F.col("source_size") * most).withColumn("need", F.col("cap") / F.col("w"))
    filled = stash.keep(running(placed, [F.col("need").asc(), F.col("place").asc()], ["cap", "w"], stash))
    words, weight = filled.agg(F.coalesce(F.sum("source_size"), F.lit(0)), F.coalesce(F.sum("w"), F.lit(0.0))).first()
    level = (F.lit(words) - F.col("before_cap")) / (F.lit(weight) - F.col("before_w"))
    filled = filled.withColumn("level", level).withColumn("full", F.col("need") <= F.col("level"))
    highest = filled.agg(F.max(F.when(~F.col("full"), F.col("level")))).first()[0]
    return filled.select("source", "source_size", F.when(F.col("full"), F.col("cap").cast("double")).otherwise(F.col("w") * F.lit(highest)).alias("target"))


def offset(source: Column, seed: str = SEED) -> Column:
    """The source's random offset: 24 bits of a digest of seed and name."""
    return F.conv(F.substring(F.md5(F.concat(F.lit(f"{seed}/"), F.coalesce(F.concat(F.lit("="), source), F.lit("-")))), 1, 6), 16, 10).cast("long")


def salt(doc_id: Column, text: Column) -> Column:
    """A hash of the id, or of the text where there is none, so that rows without ids are dealt out too."""
    return F.conv(F.substring(F.md5(F.coalesce(doc_id.cast("string"), F.concat(F.lit("/"), F.md5(F.coalesce(text, F.lit("")))))), 1, 4), 16, 10).cast("long") % SALTS


def plan(docs: DataFrame, weights=WEIGHTS, most: int = MOST, seed: str = SEED) -> DataFrame:
    """_row (docs' row), size, source_size, target and copies.

    The text is shuffled once, by source, size and salt; the counts of those groups, small and
    summed before their shuffle, give each group's first rank.
    """
    stash = Stash(docs.sparkSession, "mixing")
    rows = packed(docs, "doc_id", "text", "source")
    rows = rows.select("_row", "doc_id", "source", words_in(F.col("text")).alias("size"), salt(F.col("doc_id"), F.col("text")).alias("salt"), F.xxhash64("text").alias("tie"))
    groups = rows.groupBy("source", "size", "salt").agg(F.count(F.lit(1)).alias("n")).withColumn("chunk", F.floor(F.col("salt") / CHUNK)).withColumn("block", F.floor(F.col("size") / BLOCK))
    groups = stash.keep(groups)  # else each use of the counts would parse all texts again
    blocks = groups.groupBy("source", "block").agg(F.sum("n").alias("bn"), F.sum(F.col("n") * F.col("size")).alias("bw"))
    goal = targets(blocks.groupBy("source").agg(F.sum("bw").alias("source_size")), weights, most).select(F.col("source").alias("_s"), "source_size", "target")
    step = F.when(F.col("source_size") > 0, F.least(F.floor(F.col("target") / F.col("source_size") * (1 << BITS)), F.lit(most << BITS))).otherwise(0)
    upto = W.partitionBy("source").orderBy("block").rowsBetween(W.unboundedPreceding, -1)
    blocks = blocks.withColumn("base", F.coalesce(F.sum("bn").over(upto), F.lit(0)))
    blocks = blocks.join(goal, F.col("source").eqNullSafe(F.col("_s"))).select("_s", F.col("block").alias("_b"), "base", "source_size", "target", step.cast("long").alias("step"), offset(F.col("source"), seed).alias("offset"))
    within = lambda by, order: W.partitionBy(*by).orderBy(*order).rowsBetween(W.unboundedPreceding, -1)
    chunks = groups.groupBy("source", "block", "size", "chunk").agg(F.sum("n").alias("cn"))
    chunks = chunks.withColumn("at", F.coalesce(F.sum("cn").over(within(["source", "block"], ["size", "chunk"])), F.lit(0)))
    chunks = chunks.join(blocks, F.col("source").eqNullSafe(F.col("_s")) & (F.col("block") == F.col("_b"))).select(
        F.col("source").alias("_s"), F.col("size").alias("_z"), F.col("chunk").alias("_c"), (F.col("at") + F.col("base")).alias("at"), "source_size", "target", "step", "offset"
    )
    groups = groups.withColumn("first", F.coalesce(F.sum("n").over(within(["source", "size", "chunk"], ["salt"])), F.lit(0)))
    first = groups.join(chunks, F.col("source").eqNullSafe(F.col("_s")) & (F.col("size") == F.col("_z")) & (F.col("chunk") == F.col("_c"))).select(
        F.col("source").alias("_s"), F.col("size").alias("_z"), F.col("salt").alias("_t"), (F.col("first") + F.col("at")).alias("before"), "source_size", "target", "step", "offset"
    )
    ranked = rows.withColumn("rank", F.row_number().over(W.partitionBy("source", "size", "salt").orderBy(F.col("doc_id").asc_nulls_last(), "tie")))
    ranked = ranked.join(first, F.col("source").eqNullSafe(F.col("_s")) & (F.col("size") == F.col("_z")) & (F.col("salt") == F.col("_t")))
    k = F.col("before") + F.col("rank")
    crossed = F.shiftright(F.col("offset") + k * F.col("step"), BITS) - F.shiftright(F.col("offset") + (k - 1) * F.col("step"), BITS)
    return ranked.select("_row", "size", "source_size", "target", crossed.cast("long").alias("copies"))


def mix(docs: DataFrame, **how) -> DataFrame:
    """docs, each emitted as often as the mix takes it."""
    planned = plan(docs, **how)
    return planned.filter(F.col("copies") > 0).select("_row", F.explode(F.sequence(F.lit(1).cast("long"), F.col("copies"))).alias("copy")).select("_row.*")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents").select("doc_id", "text", "source")
    return plan(docs).select(F.col("_row.doc_id").alias("doc_id"), "size", "source_size", "target", (F.col("size") * F.col("copies")).alias("taken"))


SQL = rf"""
WITH sized AS (
  SELECT doc_id, text, source, CAST(coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0) AS BIGINT) AS size FROM documents),
per AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size FROM sized GROUP BY source),
placed AS (SELECT *, row_number() OVER (ORDER BY source ASC NULLS LAST) - 1 AS place FROM per),
weighed AS (SELECT *, CAST([5, 2, 1][place % 3 + 1] AS DOUBLE) AS w, source_size * 3 AS cap FROM placed),
levels AS (SELECT *, CAST(sum(source_size) OVER () - coalesce(sum(cap) OVER (ORDER BY cap / w, place ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS DOUBLE)
    / (sum(w) OVER () - coalesce(sum(w) OVER (ORDER BY cap / w, place ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)) AS level FROM weighed),
goals AS (SELECT source, source_size, CASE WHEN cap / w <= level THEN CAST(cap AS DOUBLE) ELSE w * (max(CASE WHEN cap / w > level THEN level END) OVER ()) END AS target FROM levels),
steps AS (SELECT *, CASE WHEN source_size > 0 THEN least(CAST(floor(target / source_size * 16777216) AS BIGINT), 50331648) ELSE 0 END AS step,
    CAST('0x' || substr(md5('{SEED}/' || coalesce('=' || source, '-')), 1, 6) AS BIGINT) AS shift FROM goals),
ranked AS (SELECT *, row_number() OVER (PARTITION BY source ORDER BY size, CAST('0x' || substr(md5(coalesce(CAST(doc_id AS VARCHAR), '/' || md5(coalesce(text, '')))), 1, 4) AS BIGINT) % {SALTS}, doc_id NULLS LAST) AS k FROM sized)
SELECT r.doc_id, r.size, s.source_size, s.target, r.size * (((s.shift + r.k * s.step) >> {BITS}) - ((s.shift + (r.k - 1) * s.step) >> {BITS})) AS taken
FROM ranked r JOIN steps s ON r.source IS NOT DISTINCT FROM s.source
"""
