"""URL filters: host and path rules, and gradient-boosted trees where no rule fits.

A rule is a host and a path; it fits its host and all subdomains where the url's path starts with
its own, and the longest fitting rule decides. The urls that rules decide are the labelled ones:
trees on lexical features (lengths, depth, share of digits, entropy of the characters, parameters,
hyphens, the statistics of the host's suffix) learn from them and judge the others. The trees are
fitted on the driver from about SAMPLE different labelled urls, chosen by a hash of the url, and
scored as Column expressions; suffix statistics count all labelled urls of every suffix and are
joined to the pages (broadcast up to BROADCAST suffixes); suffixes without any have the overall share.

Defined cases: null urls and urls without :// have an empty host and path, no rule, and the verdict
that the trees give for their features; repeated rows are judged alike; with labels of one kind
only, the trees' verdict is that kind; an empty table gives an empty result.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import boost
from .common import Stash, read, share, taken

#: (rule, verdict); a rule is host, then path.
RULES = (("org/", "allow"), ("example.org/es/", "block"), ("example.org/en/1", "block"), ("com/fr/", "allow"), ("com/de/", "block"))
SAMPLE, BROADCAST, PRIOR = 20_000, 50_000, 4.0
FEATURES = ("length", "host_length", "depth", "digits", "entropy", "parameters", "hyphens", "labels", "longest", "secure", "suffix")


def host_path(url: Column) -> tuple[Column, Column]:
    u = F.coalesce(url, F.lit(""))
    return (
        F.translate(F.regexp_extract(u, r"(?s)^.*?://([^/?#]*)", 1), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"),
        F.regexp_extract(u, r"(?s)^.*?://[^/?#]*([^?#]*)", 1),
    )


def rule_of(host: Column, path: Column, rules=RULES) -> Column:
    """The longest fitting rule, or null."""
    out = F.lit(None).cast("string")
    for rule, _ in sorted(rules, key=lambda r: (len(r[0]), r[0])):
        h, slash, p = rule.partition("/")
        fits = ((host == h) | host.endswith("." + h)) & path.startswith(slash + p)
        out = F.when(fits, F.lit(rule)).otherwise(out)
    return out


def verdict_of(rule: Column, rules=RULES) -> Column:
    out = F.lit(None).cast("string")
    for r, v in rules:
        out = F.when(rule == r, F.lit(v)).otherwise(out)
    return out


def _entropy(u: Column) -> Column:
    """Of the characters, in bits."""
    chars = F.array_distinct(F.split(u, ""))
    n = F.length(u).cast("double")

    def term(acc: Column, c: Column) -> Column:
        k = n - F.length(F.replace(u, c, F.lit("")))
        return acc - F.when(k > 0, k / n * F.log2(k / n)).otherwise(0.0)

    return F.when(n > 0, F.aggregate(F.filter(chars, lambda c: c != ""), F.lit(0.0), term)).otherwise(0.0)


def lexical(pages: DataFrame, rules=RULES) -> DataFrame:
    """pages with host, path, rule and the features but for the suffix statistics."""
    host, path = host_path(F.col("url"))
    df = pages.withColumn("host", host).withColumn("path", path).withColumn("rule", rule_of(F.col("host"), F.col("path"), rules))
    u = F.coalesce(F.col("url"), F.lit(""))
    n = F.greatest(F.length(u), F.lit(1))
    return df.select(
        "*",
        F.length(u).cast("double").alias("length"),
        F.length("host").cast("double").alias("host_length"),
        F.regexp_count("path", F.lit("/")).cast("double").alias("depth"),
        (F.regexp_count(u, F.lit("[0-9]")) / n).alias("digits"),
        _entropy(u).alias("entropy"),
        F.regexp_count(u, F.lit("[?&][^=&#]*=")).cast("double").alias("parameters"),
        F.regexp_count("host", F.lit("-")).cast("double").alias("hyphens"),
        F.size(F.split("host", r"\.")).cast("double").alias("labels"),
        F.array_max(F.transform(F.split("host", r"\."), F.length)).cast("double").alias("longest"),
        u.startswith("https:").cast("double").alias("secure"),
        F.substring_index("host", ".", -2).alias("_suffix"),
    )


def judge(pages: DataFrame, rules=RULES, sample: int = SAMPLE) -> DataFrame:
    """pages with host, path, rule, block_score and verdict; other columns are passed on."""
    rows = lexical(pages.select("url"), rules)
    marked = rows.filter(F.col("rule").isNotNull()).withColumn("y", (verdict_of(F.col("rule"), rules) == "block").cast("double"))
    stash = Stash(pages.sparkSession, "urls")
    stats = stash.keep(marked.groupBy("_suffix").agg(F.count(F.lit(1)).alias("n"), F.sum("y").alias("b")))
    total, blocked, suffixes = stats.agg(F.coalesce(F.sum("n"), F.lit(0)), F.coalesce(F.sum("b"), F.lit(0.0)), F.count(F.lit(1))).first()
    overall = (blocked + 1.0) / (total + 2.0)
    table = stats.select("_suffix", ((F.col("b") + PRIOR * overall) / (F.col("n") + PRIOR)).alias("_known"))
    table = F.broadcast(table) if suffixes <= BROADCAST else table
    with_suffix = lambda df: df.join(table, "_suffix", "left").withColumn("suffix", F.coalesce("_known", F.lit(overall)))
    fitted = marked.filter(taken(F.col("url"), share(total, sample))).dropDuplicates(["url"])
    fitted = sorted(with_suffix(fitted).select("url", F.xxhash64("url").alias("h"), *FEATURES, "y").collect(), key=lambda r: (r.h, r.url))
    x = np.array([[r[f] for f in FEATURES] for r in fitted], float).reshape(-1, len(FEATURES))
    y = np.array([r.y for r in fitted])
    # half of the sample may not see the suffix, so that other hosts are judged by their form too
    x[::2, -1] = overall
    model = boost.fit(x, y)
    names = {c: f"_own_{i}" for i, c in enumerate(pages.columns) if c != "url"}
    kept = pages.select("url", *(F.col(f"`{c}`").alias(n) for c, n in names.items()))
    scored = with_suffix(lexical(kept, rules)).withColumn("block_score", model.column(lambda i: F.col(FEATURES[i])))
    made = F.when(F.col("block_score") >= 0.5, F.lit("block")).otherwise(F.lit("allow"))
    own = ["host", "path", "rule", "block_score", "verdict"]
    return scored.withColumn("verdict", F.coalesce(verdict_of(F.col("rule"), rules), made)).select("url", *(F.col(n).alias(c) for c, n in names.items() if c not in own), *own)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judge(read(spark, sf_dir, "pages").select("page_id", "url")).select("page_id", "host", "path", "rule", "verdict")
