"""WARC files as a data source: round trips, pruning by day and host, broken files."""

import gzip
import io
from datetime import date

import pytest
from pyspark.sql import functions as F

from siftline.sources import archive

D = [date(2026, 1, k) for k in (1, 2, 3)]
ROWS = [
    ("https://a.example.com/x", D[0], 200, {"Content-Type": "text/html", "X": ""}, b"<p>one</p>"), ("https://A.example.com:443/y", D[1], 404, {}, b""), ("http://b.org/", D[1], 200, None, b"\r\n\r\nWARC/1.1\r\n\x00\xff"),
    ("http://u@b.org/?q", D[2], None, {"a": "b: c"}, b"x" * 300_000), (None, None, 500, {}, None), ("no url", D[2], 200, {}, b"z"), ("http://b.org/", D[1], 200, None, b"\r\n\r\nWARC/1.1\r\n\x00\xff"),
]
WRITE = "url string, day date, status int, headers map<string,string>, body binary"


def rows(df):
    return sorted(((r.url, r.day, r.status, r.headers, bytes(r.body) if r.body is not None else None) for r in df.collect()), key=repr)


@pytest.fixture(scope="module")
def root(spark, tmp_path_factory):
    archive.register(spark)
    to = str(tmp_path_factory.mktemp("warc"))
    df = spark.createDataFrame([(u, archive.host_of(u), *x) for u, *x in ROWS], "url string, host string, day date, status int, headers map<string,string>, body binary")
    df.repartition(3).write.format("warc").mode("append").save(to)
    return to


def read(spark, root, **what):
    return archive.responses(spark, root, **what)


def test_round_trip(spark, root):
    got = read(spark, root)
    assert rows(got) == sorted(ROWS, key=repr)
    assert {r.host for r in got.collect()} == {"a.example.com", "b.org", None}


def test_files_of_other_days_and_hosts_are_not_planned(root):
    planned = lambda *what: [p.path for p in archive.Reader(root, *what).partitions() if p.path]
    every, day2 = planned(), planned("2026-01-02", "2026-01-02")
    assert all("/day=2026-01-02/" in p for p in day2) and 0 < len(day2) < len(every)
    late = planned("2026-01-03", None, '["b.org"]')
    assert late and all("/day=2026-01-03/" in p and f"bucket={archive.bucket_of('b.org'):02d}" in p for p in late)
    assert planned(None, None, "[]") == [] and planned("2030-01-01") == []


@pytest.mark.parametrize(
    "what, where",
    [({"since": "2026-01-02", "until": "2026-01-02"}, "day = '2026-01-02'"), ({"since": "2026-01-02", "hosts": ["b.org"]}, "day >= '2026-01-02' AND host = 'b.org'"), ({"hosts": ["a.example.com", "x"]}, "host IN ('a.example.com', 'x')"), ({"until": "2026-01-01"}, "day <= '2026-01-01'"), ({"hosts": [None]}, "host IS NULL"), ({"since": "2030-01-01"}, "false"), ({}, "true")],
)
def test_pruned_reads_equal_filters_after(spark, root, what, where):
    assert rows(read(spark, root, **what)) == rows(read(spark, root).filter(where))


def test_one_load_serves_several_filters(spark, root):
    whole = read(spark, root)
    assert whole.filter("host = 'b.org'").count() == 3 and whole.filter("day = '2026-01-01'").unionByName(whole.filter("host = 'b.org'")).count() == 4 and whole.count() == len(ROWS)


def test_appends_overwrites_and_failures(spark, root, tmp_path):
    to = f"file://{tmp_path}/w"
    one = spark.createDataFrame([(ROWS[0][0], "h", *ROWS[0][1:])], "url string, host string, day date, status int, headers map<string,string>, body binary")
    one.write.format("warc").mode("append").save(to)
    one.write.format("warc").mode("append").save(to)
    assert read(spark, to).count() == 2
    failing = one.withColumn("status", F.expr("status + cast(raise_error('stop') as int)"))
    with pytest.raises(Exception, match="stop"):
        failing.write.format("warc").mode("overwrite").save(to)
    assert read(spark, to).count() == 2 and not list((tmp_path / "w").glob("_writing*"))
    one.write.format("warc").mode("overwrite").save(to)
    assert read(spark, to).count() == 1 and read(spark, str(tmp_path / "none")).count() == 0


def test_foreign_and_broken_records():
    info = b"WARC/1.0\r\nWARC-Type: warcinfo\r\nContent-Length: 4\r\n\r\nabcd\r\n\r\n"
    good = gzip.decompress(archive.record("http://a.b/", D[0], 200, {"k": "v\r\nw"}, b"body"))
    got = list(archive.records(io.BytesIO(info + good)))
    assert [(r[0], r[4], r[5]) for r in got] == [("http://a.b/", {"k": "v w"}, b"body")]
    assert list(archive.records(io.BytesIO(good), frozenset(["c.d"]))) == []
    for broken in (good[:-20], b"nonsense\r\n" + good):
        with pytest.raises(ValueError):
            list(archive.records(io.BytesIO(broken)))
