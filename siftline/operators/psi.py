"""PageSpeed results: metrics, opportunities and errors out of recorded JSON payloads."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

# Lab metrics, field metrics with divisor and unit, bands, limits, error codes.
LAB = (("first-contentful-paint", "FCP"), ("largest-contentful-paint", "LCP"), ("total-blocking-time", "TBT"), ("cumulative-layout-shift", "CLS"), ("speed-index", "SI"))
FIELD = (("LARGEST_CONTENTFUL_PAINT_MS", "LCP", 1.0), ("INTERACTION_TO_NEXT_PAINT", "INP", 1.0), ("CUMULATIVE_LAYOUT_SHIFT_SCORE", "CLS", 100.0), ("FIRST_CONTENTFUL_PAINT_MS", "FCP", 1.0), ("EXPERIMENTAL_TIME_TO_FIRST_BYTE", "TTFB", 1.0))
RATINGS = (("FAST", "good"), ("AVERAGE", "needs-improvement"), ("SLOW", "poor"))
GOOD, FAIR = 0.9, 0.5
LEAST_MS, TOP = 50.0, 6
ERRORS = ((429, "RATE_LIMITED"), (400, "INVALID_URL"), (404, "NOT_FOUND"), (500, "ANALYSIS_FAILED"))
AUDIT = "struct<displayValue:string,numericValue:double,score:double,title:string,description:string,details:struct<type:string,overallSavingsMs:double>>"
EXPERIENCE = "struct<overall_category:string,origin_fallback:boolean,metrics:map<string,struct<percentile:double,category:string>>>"
PAYLOAD = f"analysisUTCTimestamp string, lighthouseResult struct<finalUrl:string,lighthouseVersion:string,categories:struct<performance:struct<score:double>>,audits:map<string,{AUDIT}>>, loadingExperience {EXPERIENCE}, originLoadingExperience {EXPERIENCE}"


def read(df: DataFrame, column: str = "payload") -> DataFrame:
    """df with p, the payload as a struct (null if it is no JSON)."""
    return df.withColumn("p", F.from_json(column, PAYLOAD))


def lab_band(score: Column) -> Column:
    return F.when(score.isNull(), "unknown").when(score >= GOOD, "good").when(score >= FAIR, "needs-improvement").otherwise("poor")


def summary(df: DataFrame) -> DataFrame:
    """page_id, score of 100, strategy-independent facts and whether field data are the origin's."""
    s = F.col("p.lighthouseResult.categories.performance.score")
    own = F.map_keys("p.loadingExperience.metrics")
    origin = (F.coalesce(F.size(own), F.lit(0)) <= 0) & (F.coalesce(F.size(F.map_keys("p.originLoadingExperience.metrics")), F.lit(0)) > 0)
    return df.select("page_id", F.floor(s * 100 + 0.5).cast("int").alias("score"), F.col("p.lighthouseResult.finalUrl").alias("final_url"), F.col("p.analysisUTCTimestamp").alias("analysed_at"), (origin | F.coalesce("p.loadingExperience.origin_fallback", F.lit(False))).alias("field_is_origin"))


def metrics(df: DataFrame) -> DataFrame:
    """Long rows: page_id, source (lab or field), metric, value, shown, rating."""
    audits = F.col("p.lighthouseResult.audits")
    lab = F.array(*[F.struct(F.lit("lab").alias("source"), F.lit(name).alias("metric"), audits[key]["numericValue"].alias("value"), audits[key]["displayValue"].alias("shown"), lab_band(audits[key]["score"]).alias("rating")) for key, name in LAB])
    own = F.when(F.size(F.map_keys("p.loadingExperience.metrics")) > 0, F.col("p.loadingExperience.metrics")).otherwise(F.col("p.originLoadingExperience.metrics"))
    rate = lambda c: F.when(c == RATINGS[0][0], RATINGS[0][1]).when(c == RATINGS[1][0], RATINGS[1][1]).when(c == RATINGS[2][0], RATINGS[2][1]).otherwise("unknown")

    def field(key: str, name: str, by: float) -> Column:
        # the value is the percentile as reported, on the thresholds' scale; only what is shown is divided
        v = own[key]["percentile"]
        shown = F.format_string("%.2f", v / by) if by > 1 else F.when(v >= 1000, F.format_string("%.1f s", v / 1000)).otherwise(F.format_string("%.0f ms", v))
        return F.struct(F.lit("field").alias("source"), F.lit(name).alias("metric"), v.alias("value"), F.when(v.isNotNull(), shown).alias("shown"), rate(own[key]["category"]).alias("rating"))

    rows = F.concat(lab, F.array(*[field(*x) for x in FIELD]))
    return df.select("page_id", F.inline(rows)).filter(F.col("value").isNotNull())


def opportunities(df: DataFrame) -> DataFrame:
    """The TOP audits of each page by what they would save."""
    rows = df.select("page_id", F.explode("p.lighthouseResult.audits").alias("audit", "a")).select("page_id", "audit", "a.title", F.regexp_replace("a.description", r"\[([^\]]*)\]\([^)]*\)", "$1").alias("description"), F.col("a.details.overallSavingsMs").alias("savings_ms"), F.col("a.details.type").alias("kind"))
    order = W.partitionBy("page_id").orderBy(F.desc("savings_ms"), "audit")
    return rows.filter((F.col("kind") == "opportunity") & (F.col("savings_ms") >= LEAST_MS)).withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= TOP).drop("kind")


def error_code(status: Column) -> Column:
    out = F.lit("UNAVAILABLE")
    for code, name in ERRORS:
        out = F.when(status == code, name).otherwise(out)
    return out


# Good up to, fair up to, end of the scale, unit, core web vital.
THRESHOLDS = (
    ("largest-contentful-paint", 2500, 4000, 6000, "ms", True),
    ("cumulative-layout-shift", 10, 25, 50, "unitless", True),
    ("interaction-to-next-paint", 200, 500, 1000, "ms", True),
    ("first-contentful-paint", 1800, 3000, 5000, "ms", False),
    ("total-blocking-time", 200, 600, 1500, "ms", False),
    ("speed-index", 3400, 5800, 9000, "ms", False),
    ("experimental-time-to-first-byte", 800, 1800, 3000, "ms", False),
)
#: The metrics' short names.
SHORT = {"largest-contentful-paint": "LCP", "cumulative-layout-shift": "CLS", "interaction-to-next-paint": "INP", "first-contentful-paint": "FCP", "total-blocking-time": "TBT", "speed-index": "SI", "experimental-time-to-first-byte": "TTFB"}


def threshold_dim(spark) -> DataFrame:
    return spark.createDataFrame(THRESHOLDS, "metric string, good int, fair int, scale_max int, unit string, core boolean")


def meter_position(value: Column, scale_max: Column) -> Column:
    """Share of the scale in percent, within 0 and 100."""
    return F.least(F.greatest(value / scale_max * 100.0, F.lit(0.0)), F.lit(100.0))


def zones() -> list[Column]:
    """good_width, fair_width and poor_width of a meter."""
    good, fair = F.col("good") / F.col("scale_max") * 100, (F.col("fair") - F.col("good")) / F.col("scale_max") * 100
    return [good.alias("good_width"), fair.alias("fair_width"), F.greatest(F.lit(0.0), F.lit(100.0) - good - fair).alias("poor_width")]


def with_thresholds(found: DataFrame) -> DataFrame:
    """Metrics (metric: short names) with their thresholds, the place on the meter and the widths of its
    zones, all in percent of the scale; seven rows are broadcast."""
    spark = found.sparkSession
    dim = threshold_dim(spark).join(spark.createDataFrame(list(SHORT.items()), "metric string, short string"), "metric").drop("metric")
    return found.join(F.broadcast(dim), F.col("metric") == F.col("short"), "left").drop("short").select("*", meter_position(F.col("value"), F.col("scale_max")).alias("place"), *zones())


def bars(found: DataFrame) -> DataFrame:
    """Opportunities with width, the percentage of the page's largest saving, 4 at least."""
    largest = F.max("savings_ms").over(W.partitionBy("page_id"))
    return found.withColumn("width", F.greatest(F.lit(4), F.floor(F.col("savings_ms") / largest * 100 + 0.5)).cast("int"))
