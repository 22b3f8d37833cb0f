"""Scores of an audit: an ordered fold per category, redistribution, correction, band, priorities.

results is an array of structs (key, category, weight, status, severity, ...) in registry order. All
arithmetic on shares is double, folded in that order, since other orders round differently at half
points; nothing is exploded or shuffled to score a page.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .registry import BANDS, CATEGORIES, DEDUCTIONS, SEVERITIES, WEIGHTS

TOP = 5


def deduction(severity: Column) -> Column:
    out = F.lit(0.0)
    for name, value in DEDUCTIONS:
        out = F.when(severity == name, F.lit(value)).otherwise(out)
    return out


def earned(status: Column, severity: Column) -> Column:
    """The share of a check's weight that its result earns; null if it is left out."""
    return F.when(status == "UNAVAILABLE", F.lit(None).cast("double")).when(status.isin("WARNING", "ERROR"), F.lit(1.0) - deduction(severity)).otherwise(F.lit(1.0))


def rounded(x: Column) -> Column:
    """Half up."""
    return F.floor(x + F.lit(0.5)).cast("int")


def band(total: Column) -> Column:
    out = F.lit(BANDS[-1][1])
    for low, name in reversed(BANDS[:-1]):
        out = F.when(total >= low, F.lit(name)).otherwise(out)
    return out


def _fold(results: Column, category: str) -> Column:
    mine = F.filter(results, lambda r: r["category"] == category)
    open_ = F.filter(mine, lambda r: r["status"] != "UNAVAILABLE")
    weight = lambda xs: F.aggregate(xs, F.lit(0.0), lambda a, r: a + r["weight"].cast("double"))
    got = F.aggregate(open_, F.lit(0.0), lambda a, r: a + r["weight"].cast("double") * earned(r["status"], r["severity"]))
    return F.struct(
        F.lit(category).alias("category"),
        F.lit(WEIGHTS[category]).alias("category_weight"),
        F.size(mine).alias("checks_total"),
        F.size(F.filter(mine, lambda r: r["status"] == "PASS")).alias("checks_passed"),
        (F.size(mine) - F.size(open_)).alias("checks_unavailable"),
        F.when(weight(open_) > 0, got / weight(open_)).alias("ratio"),
    )


def settled(df: DataFrame, **columns: Column) -> DataFrame:
    """df with columns, behind a generator of one row: the optimizer would otherwise write each
    expression out wherever it is used, and these grow with every step."""
    return df.select("*", F.inline(F.array(F.struct(*[c.alias(k) for k, c in columns.items()]))))


def with_scores(df: DataFrame, results: str = "results") -> DataFrame:
    """df with category_scores, total, band and redistributed."""
    r = F.col(results)
    df = settled(df, _folds=F.array(*[_fold(r, c) for c, *_ in CATEGORIES]))
    measurable = F.aggregate("_folds", F.lit(0), lambda a, c: a + F.when(c["ratio"].isNotNull(), c["category_weight"]).otherwise(0))
    df = settled(df, _measurable=measurable)
    most = lambda c: F.when(c["ratio"].isNotNull() & (F.col("_measurable") > 0), rounded(c["category_weight"].cast("double") / F.col("_measurable").cast("double") * 100.0)).otherwise(0)
    df = settled(df, _most=F.transform("_folds", most))
    df = settled(df, _gap=F.when(F.col("_measurable") > 0, 100 - F.aggregate("_most", F.lit(0), lambda a, x: a + x)).otherwise(0), _largest=F.array_position("_most", F.array_max("_most")).cast("int"))
    # what rounding leaves over goes to the first of the largest shares
    df = settled(df, _max=F.transform("_most", lambda x, i: x + F.when(i + 1 == F.col("_largest"), F.col("_gap")).otherwise(0)))

    def scored(c: Column, i: Column) -> Column:
        m = F.get(F.col("_max"), i)
        return F.struct(*[c[k].alias(k) for k in ("category", "category_weight", "checks_total", "checks_passed", "checks_unavailable", "ratio")], m.alias("max_score"), F.when(c["ratio"].isNotNull(), rounded(c["ratio"] * m.cast("double"))).otherwise(0).alias("score"))

    df = settled(df, category_scores=F.transform("_folds", scored))
    total = F.aggregate("category_scores", F.lit(0), lambda a, c: a + c["score"])
    df = settled(df, total=F.least(F.greatest(total, F.lit(0)), F.lit(100)))
    full = sum(w for _, w, _ in CATEGORIES)
    return df.withColumn("band", band(F.col("total"))).withColumn("redistributed", F.col("_measurable") < full).drop("_folds", "_measurable", "_most", "_largest", "_max", "_gap")


def severity_rank(severity: Column) -> Column:
    return reduce(lambda out, x: F.when(severity == x[1], x[0]).otherwise(out), enumerate(SEVERITIES), F.lit(len(SEVERITIES)))


def category_weight(category: Column) -> Column:
    return reduce(lambda out, x: F.when(category == x[0], x[1]).otherwise(out), WEIGHTS.items(), F.lit(0))


def priorities(results: Column, limit: int = TOP) -> Column:
    """The most important findings of a page's results, in the row: by severity, then by what they cost,
    then in registry order; array<struct<rank, check_key, severity>>."""
    found = F.filter(results, lambda r: r["status"].isin("WARNING", "ERROR"))
    cost = lambda r: r["weight"] * deduction(r["severity"]) * category_weight(r["category"])
    order = F.array_sort(F.transform(found, lambda r: F.struct(severity_rank(r["severity"]).alias("severity_rank"), (-cost(r)).alias("gain"), r["ordinal"].alias("ordinal"), r["key"].alias("check_key"), r["severity"].alias("severity"))))
    return F.transform(F.slice(order, 1, limit), lambda r, i: F.struct((i + 1).alias("rank"), r["check_key"].alias("check_key"), r["severity"].alias("severity")))


def priority_issues(results: DataFrame, limit: int = TOP) -> DataFrame:
    """Of pages (page_id, results) the most important findings, best first: page_id, rank, check_key, severity."""
    return results.select("page_id", F.inline(priorities(F.col("results"), limit)))
