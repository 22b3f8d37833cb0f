"""Rate limits by pointer doubling against counting one request after another."""

import random
from datetime import datetime, timedelta, timezone

import pytest

from siftline.operators import ratelimit

SCHEMA = "client_key string, request_id long, ts timestamp"


def at(ms):
    return datetime(1970, 1, 1, tzinfo=timezone.utc) + timedelta(milliseconds=ms)


def plain(rows, limit, window_ms):
    """(client, request_id, ms) to answers, in turn."""
    out, state = [], {}
    for key, rid, ms in sorted(rows, key=lambda r: (r[2] is None, r[2] or 0, r[1] is not None, r[1] or 0)):
        if ms is None:
            out.append((key, rid, None, None, None, None, None))
            continue
        state[key], told = ratelimit.step(state.get(key), ms, limit, window_ms)
        out.append((key, rid, ms, *told))
    return sorted(out, key=repr)


def got(spark, rows, limit, window_ms):
    df = spark.createDataFrame([(k, r, None if ms is None else at(ms)) for k, r, ms in rows], SCHEMA)
    return sorted((tuple(r) for r in ratelimit.limited(df, limit, window_ms).collect()), key=repr)


def some(n, clients, span, seed):
    rng = random.Random(seed)
    return [(rng.choice(clients), rng.randrange(n), rng.randrange(-span // 4, span)) for _ in range(n)]


@pytest.mark.parametrize("limit, window_ms, span", [(2, 1000, 60_000), (3, 40, 4_000), (1, 7, 500)])
def test_equals_counting_in_turn(spark, limit, window_ms, span):
    # a third of the requests are one client's; a null client; equal instants, ids and rows
    rows = some(900, ["busy", "b", "c", None, "d:e", ""], span, limit) + [("busy", None, 5), ("busy", 1, 5), ("busy", 1, 5), ("b", 3, None), (None, None, None)]
    rows += some(400, ["busy"], span, 9)
    assert got(spark, rows, limit, window_ms) == plain(rows, limit, window_ms)


def test_a_burst_and_a_limit_of_none(spark):
    rows = [("a", i, i // 50) for i in range(500)] + [("a", 1000 + i, 100 * i) for i in range(40)]
    assert got(spark, rows, 5, 100) == plain(rows, 5, 100)
    assert got(spark, rows, 0, 100) == plain(rows, 0, 100)
    assert got(spark, [], 5, 100) == []


def test_long_chains_take_few_rounds(spark, monkeypatch):
    """1,000 windows of one client: about ten rounds, and no Python worker in any plan."""
    kept = []
    keep = ratelimit.Scratch.keep
    monkeypatch.setattr(ratelimit.Scratch, "keep", lambda self, df: (kept.append(df._jdf.queryExecution().executedPlan().toString()), keep(self, df))[1])
    rows = [("a", i, 60 * i) for i in range(2_000)]
    assert got(spark, rows, 1, 100) == plain(rows, 1, 100)
    assert len(kept) <= 3 + 2 * 11 and not any("Python" in p or "Arrow" in p for p in kept)


def test_routes_keep_their_keys(spark):
    """Keys with colons and null keys come back as they are; each route counts alone, in one pass."""
    rows = [("contact", k, i, at(i)) for i, k in enumerate(["2001:db8::1", "2001:db9::1", None, "2001:db8::1", None, None, None, "2001:db8::1", "2001:db8::1"])]
    rows += [("audit", "2001:db8::1", 90, at(9)), ("audit", None, 91, at(9)), ("audit", None, 92, at(9)), ("audit", None, 93, at(9)), ("other", "x", 94, at(1)), (None, "x", 95, at(1))]
    out = ratelimit.limited_by_route(spark.createDataFrame(rows, "route string, client_key string, request_id long, ts timestamp"), 2, 60_000).collect()
    told = {r.request_id: (r.route, r.client_key, r.allowed, r.remaining) for r in out}
    assert len(out) == 13 and told[0] == ("contact", "2001:db8::1", True, 2) and told[1] == ("contact", "2001:db9::1", True, 2) and told[2] == ("contact", None, True, 2)
    assert [told[i][2] for i in (0, 3, 7, 8)] == [True, True, True, False] and [told[i][2] for i in (2, 4, 5, 6)] == [True, True, True, False]
    assert told[90] == ("audit", "2001:db8::1", True, 1) and [told[i][2] for i in (91, 92, 93)] == [True, True, False]
