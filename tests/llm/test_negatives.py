"""Hard negatives against plain loops."""

import math
import random

import pytest

from siftline.llm import negatives

SCHEMA = "vec_id long, embedding array<float>, label int, i string, score string, chunk int"


def plain(rows, every=100):
    """Rows (vec_id, embedding, label) by number to the answer's rows."""
    v = []
    for k, (d, e, y) in enumerate(rows):
        if y is None or e is None or any(x is None or not math.isfinite(x) for x in e):
            continue
        v.append((k, d, (y + 1) % 10 if d is not None and d % 7 == 0 else y, [math.floor(256 * x) for x in e]))
    out = []
    for k, d, y, e in v:
        if d is None or d % every:
            continue
        scored = [(-sum(a * b for a, b in zip(e, f)), i is None, i or 0, j, z, i) for j, i, z, f in v if j != k]
        scored.sort(key=lambda r: r[:4])
        for p in [r for r in scored if r[4] == y][:5]:
            fits = [n for n in scored if n[4] != y and 30 * -p[0] <= 100 * -n[0] <= 90 * -p[0]]
            out += [(d, p[5], r, n[5], -p[0], -n[0]) for r, n in enumerate(fits[:10], 1)]
    return sorted(out, key=repr)


def got(df, **how):
    return sorted((tuple(r) for r in negatives.mine(df, **how).collect()), key=repr)


def table(spark, rows):
    return spark.createDataFrame([(*r, "i", "s", 1) for r in rows], SCHEMA).coalesce(1)


def some(n, dims=9, seed=1):
    rng = random.Random(seed)
    half = [x / 8 for x in range(-4, 9)]  # few values: many ties
    return [(i, [rng.choice(half) for _ in range(dims)], rng.randrange(4)) for i in range(n)]


@pytest.mark.parametrize("how", [{}, {"most_anchors": 3, "most_rows": 40, "width": 2}, {"every": 20, "most_rows": 7, "width": 4, "most_anchors": 1}])
def test_equals_plain_loops(spark, how):
    rows = some(300)
    want = plain(rows, how.get("every", 100))
    assert got(table(spark, rows), **how) == want and len(want) > 20


def test_rows_that_take_no_part_and_odd_rows(spark):
    rows = some(120, seed=2)
    nan, inf = float("nan"), float("inf")
    rows += [(200, None, 1), (201, [1.0] * 9, None), (202, [nan] + [1.0] * 8, 1), (203, [inf] + [1.0] * 8, 1), (204, [None] + [1.0] * 8, 2)]
    rows += [(None, [0.5] * 9, 1), (None, [0.5] * 9, 2), (0, [0.5] * 9, 1), (0, [0.5] * 9, 1), (300, [], 1), (400, [0.5] * 3, 2), (-700, [1.0] * 20, 1), (500, [0.25] * 9, 7)]
    want = plain(rows)
    assert got(table(spark, rows), width=4, most_rows=30) == want and any(r[0] == -700 for r in want)


def test_large_components_stay_exact_or_fail(spark):
    rows = [(i, [4000.0 + i % 5, -3000.0 + i], i % 2) for i in range(150)]
    assert got(table(spark, rows)) == plain(rows)
    with pytest.raises(Exception, match="too large"):
        got(table(spark, [*rows, (1000, [1e30, 0.0], 1)]))


def test_one_vector_holds_a_third_of_all_rows(spark):
    rows = [(d, [0.5] * 9 if d % 3 else e, y) for d, e, y in some(400, seed=3)]
    assert got(table(spark, rows), most_rows=50) == plain(rows)


def test_empty(spark):
    assert got(table(spark, [])) == [] and got(table(spark, some(5)[1:])) == []


def test_no_score_tile_is_written_or_sent(spark):
    """Tiles hold eight bytes for each anchor and row: kept or shuffled, they outgrow an executor."""
    plan = negatives.mine(table(spark, some(200)))._jdf.queryExecution().toString()
    assert "FlatMapCoGroupsInArrow" in plan and "binary" not in plan and "tile" not in plan


def test_scores_that_leave_no_room_for_places(spark):
    """Ties of scores near 2^62 go by id all the same."""
    rows = [(i, [200_000.0 + i % 3] * 800, i % 2) for i in range(0, 120)] + [(1000 + i, [120_000.0 + i % 2] * 800, i % 2) for i in range(40)]
    want = plain(rows)
    assert got(table(spark, rows), most_rows=64) == want and len(want) > 20 and max(r[4] for r in want) > 1 << 60
