"""Search over the texts of check results, by an index of trigrams.

What can be searched of a result is one text: title, key, value, message, recommendation and the
category's label. Few of these differ, so each is kept once and results find theirs by its digest.
A posting is a trigram and the digest of a text that has it. A search takes the texts that have all
trigrams of the needle, and verifies them; needles of fewer than three characters have none, and are
looked for in all texts, which still is far less than all results.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .registry import CATEGORIES

GRAM = 3


def hay() -> Column:
    """What is searched, in lower case."""
    label = F.coalesce(*[F.when(F.col("category") == k, F.lit(name)) for k, _, name in CATEGORIES])
    return F.lower(F.concat_ws(" ", "title", "check_key", "value", "message", "recommendation", label))


def text_id() -> Column:
    return F.sha2(hay(), 256)


def wanted(needle: str) -> str:
    return needle.strip().lower()


def grams(text: Column) -> Column:
    """The distinct trigrams of a text."""
    last = F.length(text) - GRAM + 1
    return F.when(last >= 1, F.array_distinct(F.transform(F.sequence(F.lit(1), last), lambda i: F.substring(text, i, F.lit(GRAM))))).otherwise(F.array().cast("array<string>"))


def texts(results: DataFrame) -> DataFrame:
    """text_id, hay, and, of stored results, expires_at (the last of those that have the text)."""
    ends = [F.max("expires_at").alias("expires_at")] if "expires_at" in results.columns else []
    rows = results.withColumn("hay", hay())
    return rows.groupBy(F.sha2("hay", 256).alias("text_id"), "hay").agg(F.count(F.lit(1)).alias("n_results"), *ends)


def postings(found: DataFrame) -> DataFrame:
    """gram, text_id (and expires_at); digest deals them out by gram."""
    rows = found.select(F.explode(grams(F.col("hay"))).alias("gram"), *[c for c in ("text_id", "expires_at") if c in found.columns])
    return rows.withColumn("digest", F.sha2("gram", 256))


def matching(all_texts: DataFrame, all_postings: DataFrame, needle: str) -> DataFrame:
    """text_id of the texts that contain the needle, each once."""
    word = wanted(needle)
    parts = sorted({word[i : i + GRAM] for i in range(len(word) - GRAM + 1)})
    if parts:
        have = all_postings.filter(F.col("gram").isin(*parts)).groupBy("text_id").agg(F.count_distinct("gram").alias("n")).filter(F.col("n") == len(parts))
        all_texts = all_texts.join(have.select("text_id"), "text_id", "left_semi")
    return all_texts.filter(F.col("hay").contains(word)).select("text_id").distinct()


def found(results: DataFrame, all_texts: DataFrame, all_postings: DataFrame, needle: str) -> DataFrame:
    """The results (with text_id, as they are stored, or without) that contain the needle."""
    ids = matching(all_texts, all_postings, needle).select(F.col("text_id").alias("_text"))
    own = F.col("text_id") if "text_id" in results.columns else text_id()
    return results.join(ids, own == F.col("_text"), "left_semi")
