"""The registry of checks, and the fixed values of the scoring model."""

from __future__ import annotations

from collections.abc import Callable
from typing import NamedTuple

from pyspark.sql import Column, DataFrame, SparkSession

# Categories in order, with their share of 100 points and their labels.
CATEGORIES = (
    ("technical", 30, "Technical SEO"),
    ("on-page", 35, "On-Page SEO"),
    ("content", 15, "Content & Structure"),
    ("links", 10, "Links"),
    ("structured-data", 5, "Structured Data"),
    ("social", 5, "Social Metadata"),
)
WEIGHTS = {k: w for k, w, _ in CATEGORIES}
# What a finding of each severity takes off a check.
DEDUCTIONS = (("CRITICAL", 1.0), ("HIGH", 0.7), ("MEDIUM", 0.4), ("LOW", 0.15), ("INFO", 0.0))
SEVERITIES = tuple(s for s, _ in DEDUCTIONS)
STATUSES = ("PASS", "WARNING", "ERROR", "INFO", "UNAVAILABLE")
# Bands by lowest total.
BANDS = ((90, "excellent"), (75, "good"), (50, "needs-improvement"), (0, "significant-issues"))


class Check(NamedTuple):
    ordinal: int
    key: str
    title: str
    category: str
    weight: int
    run: Callable[[], Column]


CHECKS: list[Check] = []


def check(key: str, title: str, category: str, weight: int):
    """Adds a function without arguments that returns an outcome Column over the audit context."""

    def add(f: Callable[[], Column]) -> Callable[[], Column]:
        if any(c.key == key for c in CHECKS):
            raise ValueError(f"two checks are named {key}")
        if category not in WEIGHTS or weight <= 0:
            raise ValueError(f"{key}: no such category, or no weight")
        CHECKS.append(Check(len(CHECKS), key, title, category, weight, f))
        return f

    return add


def check_dim(spark: SparkSession) -> DataFrame:
    from . import checks  # noqa: F401  fills the registry

    return spark.createDataFrame([c[:5] for c in CHECKS], "ordinal int, check_key string, title string, category string, weight int")


def get_check(key: str) -> Check | None:
    return next((c for c in CHECKS if c.key == key), None)


def category_dim(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([(i, *c) for i, c in enumerate(CATEGORIES)], "category_ordinal int, category string, category_weight int, label string")


def scoring_explanation(spark: SparkSession) -> DataFrame:
    """Weights, deductions and bands as rows (kind, name, value)."""
    rows = [("category_weight", k, float(w)) for k, w, _ in CATEGORIES] + [("deduction", k, v) for k, v in DEDUCTIONS] + [("band_from", k, float(v)) for v, k in BANDS]
    return spark.createDataFrame(rows, "kind string, name string, value double")


#: How a score comes about, in our own words.
RULES = (
    "A check belongs to one category, and a category is worth a fixed share of 100 points.",
    "Within its category a check counts by its weight.",
    "Passed checks and information cost nothing; a finding takes off a share of its check by its severity.",
    "What could not be measured is left out and never counts against a page.",
    "Categories are rounded before they are added, so that the parts add up to the total.",
)


def scoring_rules(spark: SparkSession) -> DataFrame:
    """The rules as rows (ordinal, rule)."""
    return spark.createDataFrame(list(enumerate(RULES)), "ordinal int, rule string")


if sum(WEIGHTS.values()) != 100:
    raise ValueError("category weights must add up to 100")
