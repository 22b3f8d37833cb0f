"""Benchmark decontamination: SimHash of item-sized windows, searched by Hamming blocks.

A benchmark item of L words is compared with windows of L words of each document. Windows are
taken where the document and the item share a word shingle: a shingle at the document's word p and
the item's word q names the window that begins at p - q, moved inside where it would begin before the
document or end after it (a document shorter than the item is one window), and a window that shares
no shingle with an item has similarity zero to it. Each window named so gets the SimHash of its shingles. The
64 bits are cut into RADIUS + 1 blocks; a window and an item within RADIUS bits agree on one block
at least, so the join on (item size, block, bits) finds all pairs within the radius, and the exact
weighted-shingle similarity (sum of the lesser counts over sum of the greater) decides.

All of it is DataFrame functions. The item shingles are the only side that is broadcast, and only
up to BROADCAST rows; above that both sides are shuffled by shingle.

Why the radius: a similarity of 0.8 means about ten differing bits with a spread of three, so
RADIUS = 19 leaves the verification, not the fingerprint, to decide.

Defined cases: words are lower-cased (A-Z); null texts have no words; items shorter than a shingle
have one shingle, of all their words, and match windows that equal them; items without words match
nothing; repeated items and documents are compared each by its id (equal ids: their best window);
null ids are left out of the pairs, but clean() judges each row by its text; other columns are ignored.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Stash, WORD, packed, read

WORDS, SIMILARITY, RADIUS = 5, 0.8, 19
#: Item shingles that are broadcast at most (about 40 bytes each).
BROADCAST = 500_000
#: Places whose windows are cut together; a row holds SPAN times the number of different item lengths at most.
SPAN = 256
LOWER = ("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def tokens(text: Column) -> Column:
    return F.coalesce(F.regexp_extract_all(F.translate(text, *LOWER), F.lit(WORD), F.lit(0)), F.array().cast("array<string>"))


def hashes(words: Column, k: int) -> Column:
    """A hash for each k words in a row, in order; fewer words: one of all; none: none."""
    several = F.transform(F.sequence(F.lit(0), F.size(words) - k), lambda i: F.xxhash64(*[F.get(words, i + j) for j in range(k)]))
    return F.when(F.size(words) >= k, several).when(F.size(words) > 0, F.array(F.xxhash64(words))).otherwise(F.array().cast("array<bigint>"))


def _short(words: Column, k: int) -> Column:
    """A hash for each k words in a row, as hashes() makes of an item that has no more."""
    return F.when(F.size(words) >= k, F.transform(F.sequence(F.lit(0), F.size(words) - k), lambda i: F.xxhash64(F.slice(words, i + 1, F.lit(k)))))


def _ones(h: Column, bit: int) -> Column:
    return F.aggregate(h, F.lit(0).cast("long"), lambda a, x: a + F.shiftrightunsigned(x, bit).bitwiseAND(F.lit(1)))


def simhash(h: Column) -> Column:
    """64 bits; each is 1 if set in over half of the hashes."""
    values = [F.lit(1 << b if b < 63 else -(1 << 63)).cast("long") for b in range(64)]
    bits = [F.when(_ones(h, b) * 2 > F.size(h), v).otherwise(F.lit(0).cast("long")) for b, v in enumerate(values)]
    return reduce(lambda a, b: a.bitwiseOR(b), bits)


def blocks(radius: int) -> list[tuple[int, int]]:
    """(first bit, bits) of radius + 1 blocks of the fingerprint."""
    n = radius + 1
    edge = [64 * i // n for i in range(n + 1)]
    return [(a, b - a) for a, b in zip(edge, edge[1:])]


def _blocked(df: DataFrame, radius: int) -> DataFrame:
    cut = [F.shiftrightunsigned("fp", a).bitwiseAND(F.lit((1 << n) - 1)) for a, n in blocks(radius)]
    return df.select("*", F.posexplode(F.array(*cut)).alias("block", "bits"))


def similarity(a: Column, b: Column) -> Column:
    """Of two lists of shingles with repetitions, each counted."""
    count = lambda xs, x: F.size(F.filter(xs, lambda y: y == x))
    both = F.aggregate(F.array_intersect(a, b), F.lit(0), lambda s, x: s + F.least(count(a, x), count(b, x)))
    return both / (F.size(a) + F.size(b) - both)


def matches(docs: DataFrame, items: DataFrame, words: int = WORDS, least: float = SIMILARITY, radius: int = RADIUS) -> DataFrame:
    """(doc_id, item_id, start, similarity): the best window of each document for each item that it
    holds with the least similarity at least; start counts words from 0."""
    spark = docs.sparkSession
    stash = Stash(spark, "decontaminate")
    goods = items.filter(F.col("item_id").isNotNull()).select("item_id", tokens(F.col("text")).alias("w")).filter(F.size("w") > 0)
    goods = stash.keep(goods.select("item_id", F.size("w").alias("length"), hashes(F.col("w"), words).alias("item_h")))
    parts = goods.select("item_id", "length", F.posexplode("item_h").alias("q", "h"))
    few = parts.limit(BROADCAST + 1).count() <= BROADCAST
    sizes = goods.select("length").distinct()
    short = [r.length for r in sizes.filter(F.col("length") < words).orderBy("length").collect()]  # at most words - 1 rows
    # documents to (position, shingle) in one pass; the shingles of short items have lengths of their own
    text = docs.filter(F.col("doc_id").isNotNull()).select("doc_id", tokens(F.col("text")).alias("w"))
    at = lambda hs: F.transform(hs, lambda x, i: F.struct(i.alias("p"), x.alias("h")))
    none = F.array().cast("array<struct<p:int,h:bigint>>")
    kinds = [at(F.when(F.size("w") >= words, hashes(F.col("w"), words)))] + [at(_short(F.col("w"), k)) for k in short]
    seen = text.select("doc_id", F.size("w").alias("n"), F.explode(F.concat(*[F.coalesce(k, none) for k in kinds]) if short else kinds[0]).alias("x")).select("doc_id", "n", "x.p", "x.h")
    found = seen.join(F.broadcast(parts) if few else parts, "h")
    start = F.greatest(F.lit(0), F.least(F.col("p") - F.col("q"), F.col("n") - F.col("length")))
    found = found.select("doc_id", start.alias("start"), "length").distinct()
    # windows of SPAN neighbouring places meet in a row with the document's hashes, of which theirs are slices
    where, of = stash.put(found.groupBy("doc_id", F.floor(F.col("start") / SPAN).alias("span")).agg(F.collect_list(F.struct("start", "length")).alias("at")))
    some = docs.select("doc_id", "text").join(where.select("doc_id").distinct(), "doc_id", "left_semi").select("doc_id", tokens(F.col("text")).alias("w"))
    hashed = some.select("doc_id", "w", hashes(F.col("w"), words).alias("hs")) if short else some.select("doc_id", hashes(F.col("w"), words).alias("hs"))

    def cut(x: Column) -> Column:
        own = F.slice("hs", x["start"] + 1, F.greatest(x["length"] - words + 1, F.lit(1)))
        if short:
            own = F.when(x["length"] < words, F.array(F.xxhash64(F.slice("w", x["start"] + 1, x["length"])))).otherwise(own)
        return F.struct(x["start"].alias("start"), x["length"].alias("length"), own.alias("h"))

    window, cuts_at = stash.put(hashed.join(where, "doc_id").select("doc_id", F.explode(F.transform("at", cut)).alias("x")).select("doc_id", "x.*"))
    stash.drop(of)
    left = _blocked(window.select("*", simhash(F.col("h")).alias("fp")), radius)
    right = _blocked(goods.select("*", simhash(F.col("item_h")).alias("fp")), radius).select("item_id", "item_h", F.col("length").alias("_l"), F.col("block").alias("_b"), F.col("bits").alias("_v"), F.col("fp").alias("_fp"))
    near = left.join(F.broadcast(right) if few else right, (F.col("length") == F.col("_l")) & (F.col("block") == F.col("_b")) & (F.col("bits") == F.col("_v")))
    differ = F.col("fp").bitwiseXOR(F.col("_fp"))
    near = near.filter(F.bit_count(differ) <= radius)
    first = F.lit(True)  # of the blocks that agree, only the first counts
    cuts = blocks(radius)
    agree = [F.shiftrightunsigned(differ, a).bitwiseAND(F.lit((1 << n) - 1)) == 0 for a, n in cuts]
    for k, a in enumerate(agree):
        first = first & (~a | (F.col("block") <= k))
    near = near.filter(first).select("doc_id", "item_id", "start", similarity(F.col("h"), F.col("item_h")).alias("similarity")).filter(F.col("similarity") >= least)
    best = near.groupBy("doc_id", "item_id").agg(F.max(F.struct("similarity", (-F.col("start")).alias("s"))).alias("m"))
    return best.select("doc_id", "item_id", (-F.col("m.s")).cast("long").alias("start"), F.col("m.similarity").alias("similarity"))


def clean(docs: DataFrame, items: DataFrame, **how) -> DataFrame:
    """docs without the rows that hold a benchmark item, whatever their ids."""
    # rows are told apart by their texts, which alone decide
    key = F.xxhash64("text")
    found = matches(docs.select(key.alias("doc_id"), "text"), items, **how)
    bad = Stash(docs.sparkSession, "clean").keep(found.select(F.col("doc_id").alias("_bad")).distinct())
    return packed(docs, "text").join(bad, key == F.col("_bad"), "left_anti").select("_row.*")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return matches(read(spark, sf_dir, "documents"), read(spark, sf_dir, "benchmark"))
