"""Fixed-window rate limiting, each window anchored at a client's first request.

Denied requests count too; a request at or after the end of a window opens a new one. Where windows
start therefore depends on all earlier requests of the client, but not on reading them in turn:

* Time is cut into stretches of a window's length, so that a busy client is many groups. An instant
  with no other in the window's length before it opens a window whatever came earlier.
* Of the rest, the busy ones, each points to the next at or after its window's end. From those that open
  anyhow, windows are found by pointer doubling: round k takes the first 2^k windows of each chain to the
  next 2^k, and joins pointers to pointers twice as long. Chains end at the next instant that opens anyhow.
* Starts are a window's length apart, so a stretch holds one at most, and a request finds its own in
  its stretch or the one before: an equi-join.
* Only the first requests up to the limit are ranked; tasks pass on no more than that many of a window.
  The place of the last of these tells which of the others are denied.

Nothing is collected and no Python runs; the requests are read twice. Defined cases: a null client is a
client; requests at one instant count in the order of request_id (nulls first), equal ones in any
order; a request without a time gets an answer of nulls; repeated rows count each; times before 1970
are times; a limit of 0 denies all.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..sources.scratch import Scratch

#: What a request is told; times in milliseconds.
OUT = "client_key string, request_id long, ts_ms long, allowed boolean, remaining int, reset_ms long, retry_after_s int"


def step(state: tuple[int, int] | None, now: int, limit: int, window_ms: int) -> tuple[tuple[int, int], tuple[bool, int, int, int]]:
    """(count, reset) and the answer: allowed, remaining, reset, seconds to wait."""
    count, reset = state if state and state[1] > now else (0, now + window_ms)
    count += 1
    wait = max(1, -(-(reset - now) // 1000))  # till the window ends, whether allowed or not
    return (count, reset), (count <= limit, max(0, limit - count), reset, wait)


def peek(state: tuple[int, int] | None, now: int, limit: int, window_ms: int) -> tuple[bool, int, int]:
    """What step() would find before it counts: open, remaining, reset."""
    count, reset = state if state and state[1] > now else (0, now + window_ms)
    return count < limit, max(0, limit - count), reset


def _stretch(ts: str, length: int) -> Column:
    """The number of the stretch of time that holds ts, in whole numbers (times may be negative)."""
    return F.expr(f"CAST(({ts} - pmod({ts}, {length}L)) DIV {length}L AS BIGINT)")


def _instants(points: DataFrame, window_ms: int) -> DataFrame:
    """points (k, ts_ms), each once, with opens (none came in the window's length before) and busy (not
    so, or not so of the next)."""
    rows = points.withColumn("stretch", _stretch("ts_ms", window_ms))
    own = Window.partitionBy("k", "stretch").orderBy("ts_ms")
    rows = rows.select("k", "stretch", "ts_ms", F.lag("ts_ms").over(own).alias("before"), F.lead("ts_ms").over(own).alias("after"))
    # beyond a stretch: one row for each of a client's
    others = Window.partitionBy("k").orderBy("stretch")
    ends = rows.groupBy("k", "stretch").agg(F.min("ts_ms").alias("first"), F.max("ts_ms").alias("last"))
    ends = ends.select("k", "stretch", F.lag("last").over(others).alias("earlier"), F.lead("first").over(others).alias("later"))
    last, following = F.coalesce("before", "earlier"), F.coalesce("after", "later")
    opens = last.isNull() | (F.col("ts_ms") - last >= window_ms)
    return rows.join(ends, ["k", "stretch"]).select("k", "ts_ms", opens.alias("opens"), (~opens | F.coalesce(following - F.col("ts_ms") < window_ms, F.lit(False))).alias("busy"))


def _hops(busy: DataFrame, window_ms: int) -> DataFrame:
    """Busy points (k, ts_ms, opens) with next, the first at or after ts_ms + window_ms, where there is
    one that doesn't open anyhow. (One that is not busy opens anyhow, as does the busy one after it.)"""
    point = busy.select("k", F.col("ts_ms").alias("at"), F.struct("ts_ms", "opens").alias("p"), F.lit(None).cast("long").alias("ts_ms"))
    rows = point.unionByName(busy.select("k", (F.col("ts_ms") + window_ms).alias("at"), F.lit(None).cast(point.schema["p"].dataType).alias("p"), "ts_ms")).withColumn("stretch", _stretch("at", window_ms))
    own = Window.partitionBy("k", "stretch").orderBy(F.desc("at"), F.col("ts_ms").asc_nulls_first()).rowsBetween(Window.unboundedPreceding, 0)
    others = Window.partitionBy("k").orderBy(F.desc("stretch")).rowsBetween(Window.unboundedPreceding, -1)
    rows = rows.withColumn("here", F.min("p").over(own))
    later = rows.groupBy("k", "stretch").agg(F.min("p").alias("first")).select("k", "stretch", F.min("first").over(others).alias("later"))
    found = rows.filter("ts_ms IS NOT NULL").join(later, ["k", "stretch"]).select("k", "ts_ms", F.coalesce("here", "later").alias("next"))
    return found.filter("NOT next.opens").select("k", "ts_ms", F.col("next.ts_ms").alias("next"))


def window_starts(points: DataFrame, window_ms: int, scratch: Scratch) -> DataFrame:
    """points (k, ts_ms), each once, to those at which a window starts."""
    told = scratch.keep(_instants(points, window_ms))
    starts = told.filter("opens").select("k", "ts_ms")
    hops = scratch.keep(_hops(told.filter("busy").select("k", "ts_ms", "opens"), window_ms))
    while not hops.isEmpty():
        # the first 2^k starts of each chain lead to its next 2^k
        new = scratch.keep(starts.join(hops, ["k", "ts_ms"]).select("k", F.col("next").alias("ts_ms")))
        starts = starts.unionByName(new)
        far = hops.select("k", F.col("ts_ms").alias("next"), F.col("next").alias("far"))
        hops = scratch.keep(hops.join(far, ["k", "next"]).select("k", "ts_ms", F.col("far").alias("next")))
    return starts


def limited(requests: DataFrame, limit: int | Column, window_ms: int, keys: list[str] | None = None, most: int | None = None) -> DataFrame:
    """requests (client_key, request_id, ts) to OUT. limit may be a column of the requests, none above
    most; keys name what has a window of its own."""
    keys = keys or ["client_key"]
    if not isinstance(limit, Column):
        limit, most = F.lit(limit), limit
    scratch = Scratch(requests.sparkSession, "ratelimit")
    # a struct with nulls in it is equal to another such
    rows = requests.select(F.struct(*keys).alias("k"), "request_id", F.unix_millis(F.col("ts").cast("timestamp")).alias("ts_ms"), limit.cast("int").alias("limit"))
    starts = window_starts(rows.filter("ts_ms IS NOT NULL").select("k", "ts_ms").distinct(), window_ms, scratch)
    # requests look for a start in their stretch and the one before
    seen = starts.select("k", F.col("ts_ms").alias("start"), F.inline(F.array(*[F.struct((_stretch("ts_ms", window_ms) + d).alias("stretch"), F.lit(d == 0).alias("own")) for d in (0, 1)])))
    seen = seen.groupBy("k", "stretch").agg(F.max(F.when(F.col("own"), F.col("start"))).alias("own"), F.max(F.when(~F.col("own"), F.col("start"))).alias("former"))
    found = rows.withColumn("stretch", _stretch("ts_ms", window_ms)).join(seen, ["k", "stretch"], "left")
    found = scratch.keep(found.select("k", "request_id", "ts_ms", "limit", F.when(F.col("own") <= F.col("ts_ms"), F.col("own")).otherwise(F.col("former")).alias("start"), F.monotonically_increasing_id().alias("n")))
    timed, place = found.filter("ts_ms IS NOT NULL"), F.struct("ts_ms", "request_id", "n")
    order = Window.partitionBy("k", "start").orderBy("ts_ms", "request_id", "n")
    first = timed.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= most).filter(F.col("rank") <= F.col("limit"))
    cut = first.filter(F.col("rank") == F.col("limit")).select("k", "start", place.alias("cut"))
    denied = timed.join(cut, ["k", "start"], "left").filter((place > F.col("cut")) | (F.col("limit") <= 0)).drop("cut")
    others = denied.unionByName(found.filter("ts_ms IS NULL"))
    told = first.unionByName(others.withColumn("rank", F.lit(None).cast("int")).select(*first.columns))
    allowed, reset = F.when(F.col("ts_ms").isNotNull(), F.col("rank").isNotNull()), F.col("start") + window_ms
    wait = F.when(reset.isNotNull(), F.greatest(F.lit(1), F.ceil((reset - F.col("ts_ms")) / 1000))).cast("int")
    left = F.when(allowed, F.col("limit") - F.col("rank")).when(~allowed, F.lit(0)).cast("int")
    return told.select("k.*", "request_id", "ts_ms", allowed.alias("allowed"), left.alias("remaining"), reset.alias("reset_ms"), wait.alias("retry_after_s"))


# Requests a window that a route allows, where it differs from the general limit.
ROUTES = (("audit", None), ("pagespeed", 10), ("contact", 3))


def limited_by_route(requests: DataFrame, limit: int, window_ms: int) -> DataFrame:
    """requests (route, client_key, request_id, ts), each route with its own limit and counts; other
    routes have no limit and no answer."""
    own = F.coalesce(*[F.when(F.col("route") == r, F.lit(n or limit)) for r, n in ROUTES])
    mine = requests.filter(F.col("route").isin(*[r for r, _ in ROUTES]))
    return limited(mine, own, window_ms, ["route", "client_key"], max(n or limit for _, n in ROUTES))


def cached(reads: DataFrame, ttl_ms: int) -> DataFrame:
    """reads (key, request_id, ts) of a cache whose entries live ttl_ms from when they were fetched:
    whether each read finds its key (hit) and when what it gets was fetched (fetched_ms)."""
    got = limited(reads.withColumnRenamed("key", "client_key"), 1, ttl_ms)
    return got.select(F.col("client_key").alias("key"), "request_id", (~F.col("allowed")).alias("hit"), (F.col("reset_ms") - ttl_ms).alias("fetched_ms"))


def client_key(headers):
    """The first of the usual proxy headers that says something; of a list its first entry."""
    first = F.element_at(F.split(F.element_at(headers, "x-forwarded-for"), ","), 1)
    say = lambda c: F.nullif(F.trim(c), F.lit(""))
    return F.coalesce(say(F.element_at(headers, "x-vercel-forwarded-for")), say(F.element_at(headers, "cf-connecting-ip")), say(F.element_at(headers, "x-real-ip")), say(first), F.lit("unknown-client"))
