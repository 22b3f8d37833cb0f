"""Streaming: rate limits with state per client, audits of arriving pages, and their stages."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..operators.audit import audit
from ..operators.ratelimit import OUT, step

# The stages of an audit, in order.
STAGES = ("fetching", "parsing", "robots", "sitemap", "checks", "scoring", "done")


def limited_stream(requests: DataFrame, limit: int, window_ms: int, late: str = "10 minutes") -> DataFrame:
    """The batch operator's answers for a stream of requests (client_key, request_id, ts). State is one
    count and one time per client; it goes when the watermark, late behind the latest request, has passed its window."""

    def run(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        now_state = state.get if state.exists else None
        rows = pd.concat(list(batches)).sort_values(["ts_ms", "request_id"])
        out = []
        for rid, now in rows[["request_id", "ts_ms"]].itertuples(index=False):
            now_state, told = step(now_state, int(now), limit, window_ms)
            out.append((key[0], rid, now, *told))
        state.update(now_state)
        # the window is over once the stream's own time has passed its end; a replay keeps it open
        state.setTimeoutTimestamp(max(int(now_state[1]), state.getCurrentWatermarkMs() + 1))
        yield pd.DataFrame(out, columns=["client_key", "request_id", "ts_ms", "allowed", "remaining", "reset_ms", "retry_after_s"])

    rows = requests.withWatermark("ts", late).select("client_key", "request_id", "ts", F.unix_millis(F.col("ts").cast("timestamp")).alias("ts_ms"))
    return rows.groupBy("client_key").applyInPandasWithState(run, OUT, "count int, reset_ms long", "append", GroupStateTimeout.EventTimeTimeout)


def audit_stream(pages: DataFrame, sink: Callable[[DataFrame, int], None]):
    """A stream writer that audits each micro-batch of pages and hands (results, batch id) to sink."""

    def each(batch: DataFrame, n: int) -> None:
        sink(audit(batch).results.withColumn("batch", F.lit(n)), n)

    return pages.writeStream.foreachBatch(each)


def stage_events(pages: DataFrame) -> DataFrame:
    """What a client is told about each page: start, the stages, result; data lines as JSON."""
    kinds = F.concat(F.array(F.struct(F.lit("start").alias("type"), F.lit(None).cast("string").alias("stage"))), F.array(*[F.struct(F.lit("stage").alias("type"), F.lit(s).alias("stage")) for s in STAGES]), F.array(F.struct(F.lit("result").alias("type"), F.lit(None).cast("string").alias("stage"))))
    rows = pages.select("page_id", F.posexplode(kinds).alias("ordinal", "e")).select("page_id", "ordinal", "e.type", "e.stage")
    return rows.withColumn("event", F.concat(F.lit("data: "), F.to_json(F.struct("type", "stage")), F.lit("\n\n")))


def read_events(buffer) -> Column:
    """A buffer of events to array<struct<type, stage>>: whole messages only, their first data line as JSON."""
    parts = F.split(buffer, "\n\n")
    whole = F.slice(parts, F.lit(1), F.greatest(F.size(parts) - 1, F.lit(0)))
    data = F.transform(whole, lambda m: F.get(F.filter(F.split(m, "\n"), lambda x: x.startswith("data:")), F.lit(0)))
    told = F.transform(F.filter(data, lambda x: x.isNotNull()), lambda x: F.from_json(F.trim(F.substring(x, 6, F.length(x))), "type string, stage string"))
    return F.filter(told, lambda e: e["type"].isNotNull())


def windowed_events(events: DataFrame, length: str = "1 hour", late: str = "10 minutes") -> DataFrame:
    """Counts of events by type and window, for batch and stream alike."""
    return events.withWatermark("ts", late).groupBy(F.window("ts", length), "event_type").agg(F.count(F.lit(1)).alias("n_events")).select(F.col("window.start").alias("window_start"), "event_type", "n_events")


def operations(events: DataFrame, length: str = "1 hour", late: str = "10 minutes") -> DataFrame:
    """Events (ts, event_type, score, duration; the last two may be null) by type and window: how many, the
    sum of their scores and the longest duration. For batch and stream alike."""
    rows = events.withWatermark("ts", late).groupBy(F.window("ts", length), "event_type")
    told = rows.agg(F.count(F.lit(1)).alias("n_events"), F.count("score").alias("n_scores"), F.sum("score").alias("sum_score"), F.max("duration").alias("max_duration"))
    return told.select(F.col("window.start").alias("window_start"), "event_type", "n_events", "n_scores", "sum_score", "max_duration")


def over_limit(windows: DataFrame, limits: dict[str, int]) -> DataFrame:
    """Windows in which a type occurred as often as its limit (1: never should), or oftener; for batch and stream."""
    limit = F.coalesce(*[F.when(F.col("event_type") == k, F.lit(n)) for k, n in limits.items()], F.lit(None).cast("int"))
    return windows.filter(F.col("n_events") >= limit)


def spikes(windows: DataFrame, factor: int = 3, back: int = 24) -> DataFrame:
    """windows with spike: more than factor times the mean of the type's last back windows (which there must
    be one of). A type has one row for each window, so its rows are few."""
    before = Window.partitionBy("event_type").orderBy("window_start").rowsBetween(-back, -1)
    told = windows.withColumn("_sum", F.sum("n_events").over(before)).withColumn("_n", F.count(F.lit(1)).over(before))
    return told.withColumn("spike", F.coalesce(F.col("n_events") * F.col("_n") > F.col("_sum") * factor, F.lit(False))).drop("_sum", "_n")
