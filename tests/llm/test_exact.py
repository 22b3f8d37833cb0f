"""Exact duplicates against a plain grouping; the code that fingerprints travel in."""

import hashlib
import random
from collections import defaultdict

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from siftline.llm import exact, golomb

BLANKS = b" \t\n\v\f\r"


@settings(deadline=None, max_examples=60)
@given(st.lists(st.integers(0, (1 << 40) - 1), max_size=60), st.sampled_from([40, 50, 63]))
def test_codes_come_back(values, bits):
    values = np.array(sorted(values), np.uint64)
    assert golomb.decode(golomb.encode(values, 1 << bits), len(values), 1 << bits).tolist() == values.tolist()


def test_codes_are_short():
    values = np.sort(np.random.default_rng(1).integers(0, 1 << 48, 10_000)).astype(np.uint64)
    spent = 8 * len(golomb.encode(values, 1 << 48)) / len(values)
    assert spent < 48 - np.log2(10_000) + 2
    assert golomb.decode(golomb.encode(np.zeros(5, np.uint64), 1), 5, 1).tolist() == [0] * 5


def plain(rows):
    """rows (doc_id, text) in their order to (doc_id, keep_id, group_size, kept, sha)."""
    same = defaultdict(list)
    for i, (d, t) in enumerate(rows):
        same[(t or "").encode().translate(None, BLANKS)].append((-len(t or ""), d is None, d or 0, i))
    out = []
    for body, g in same.items():
        best = min(g)
        for r in g:
            out.append((rows[r[3]][0], rows[best[3]][0], len(g), r[3] == best[3], hashlib.sha256(body).hexdigest()))
    return sorted(out, key=repr)


def rows_of(df):
    return sorted((tuple(r) for r in df.select("doc_id", "keep_id", "group_size", "kept", "text_sha256").collect()), key=repr)


ROWS = [(1, "one two"), (2, "onetwo"), (3, "one \t\n\v\f\rtwo "), (4, "one two"), (5, None), (6, ""), (7, " \n"), (8, "one two"), (9, "é𝄞 "), (10, "é𝄞"), (None, "one  two"), (3, "one \t\n\v\f\rtwo "), (None, "alone"), (11, "x" * 300_000), (12, "x" * 299_999 + " x"), (13, "One two"), (-5, "x" * 300_000)]


@pytest.mark.parametrize("setting", [{}, {"block_rows": 2}, {"block_bytes": 1, "spare": 0, "owned": 1}, {"block_rows": 3, "spare": 60}])
def test_groups_equal_a_plain_grouping(spark, setting):
    df = spark.createDataFrame(ROWS, "doc_id long, text string").coalesce(1)
    assert rows_of(exact.groups(df, **setting)) == plain(ROWS)


def test_one_text_holds_a_third_of_all_rows(spark):
    rng = random.Random(3)
    rows = [(i, "hot text" if i % 3 == 0 else f"w{rng.randrange(1500)} x") for i in range(6000)]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(7)
    got = rows_of(exact.groups(df, block_rows=100))
    # which row of equal rank comes first is up to the partitions, ids are not
    assert got == plain(sorted(rows))


def test_empty_table_and_clashing_names(spark):
    schema = "doc_id long, text string, block string, pos string, _row string, sha int, best int, size int, members int, `a.b` int, _number int, _flags int"
    assert exact.groups(spark.createDataFrame([], schema)).count() == 0
    assert exact.dedupe(spark.createDataFrame([], schema)).count() == 0
    rows = [(d, t, "b", "p", "r", 1, 2, 3, 4, i, 5, 6) for i, (d, t) in enumerate(ROWS)]
    df = spark.createDataFrame(rows, schema).coalesce(1)
    kept = exact.dedupe(df)
    assert kept.columns == df.columns
    assert sorted((r.doc_id for r in kept.collect()), key=repr) == sorted((d for d, _, _, k, _ in plain(ROWS) if k), key=repr)


def test_entries_stay_where_they_are(spark):
    """The texts are scanned for the join with the bitmaps, not shuffled before it."""
    df = spark.createDataFrame(ROWS, "doc_id long, text string")
    stash = exact.Stash(spark, "test")
    entries = stash.bucketed(exact._entries(df.withColumn("_number", exact.F.monotonically_increasing_id()), 1 << 20, 1 << 10), "block")
    flags = spark.createDataFrame([(0, 0, 1)], "block long, slot int, flags long")
    plan = exact._marked(entries.select("block", "pos", "body"), flags)._jdf.queryExecution().executedPlan().toString()
    scanned = plan[plan.index("body") :]
    assert "Bucketed: true" in plan or "SelectedBucketsCount" in plan, scanned
    assert plan.count("Exchange hashpartitioning(_block") <= 1 and "Exchange hashpartitioning(block#" not in plan.split("ObjectHashAggregate")[0]
