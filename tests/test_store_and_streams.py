"""The store's saves, reads and purges; streams that run."""

from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from siftline.operators import analytics, ratelimit, rollups
from siftline.operators.audit import audit
from siftline.sources import store
from siftline.streaming import limits

PAGES = [(1, "https://example.com/", "<html><head><title>A page with a title of its own</title></head><body><p>x</p></body></html>"), (2, "http://a.org/x", "<p>text</p>")]


def at(day):
    return F.lit(f"2026-{day} 11:00:00").cast("timestamp")


def test_store(spark, tmp_path):
    a = audit(spark.createDataFrame(PAGES, "page_id long, url string, html string"))
    s = store.Store(spark, str(tmp_path / "store"))
    now = F.lit("2026-01-01 10:00:00").cast("timestamp")
    for _ in range(2):  # the second save takes the place of the first
        s.save(store.frames(a, "run-1", now), "run-1")
    s.save(store.frames(a, "run-2", now, days=60), "run-2")
    failed = spark.createDataFrame([(3, "https://gone.example/", "DNS_FAILURE", "not found")], "page_id long, url string, error_code string, error_message string")
    s.save({"audits": store.failed(failed, "run-3", now)}, "run-3")
    assert s.table("audits", at("01-02")).count() == 5 and s.table("audit_checks", at("01-02")).count() == 4 * 26
    key = s.table("audits", at("01-02")).filter("page_id = 1").orderBy("expires_at").first().audit_id
    report = s.report(key, at("01-02")).first()
    assert len(report.audit_checks) == 26 and len(report.audit_category_scores) == 6 and report.title == "A page with a title of its own"
    assert any(c.recommendation for c in report.audit_checks)
    assert s.get(key, at("02-05")).count() == 0 and s.get("nothing", now).count() == 0 and s.report("../x", now).count() == 0
    lost = s.table("audits", at("01-02")).filter("state = 'FAILED'").first()
    assert s.report(lost.audit_id, at("01-02")).first().error_code == "DNS_FAILURE"

    # what is stored beside the audits equals what they say themselves, before and after a purge
    for day in ("01-02", "02-05"):
        audits, checks, totals = (s.table(t, at(day)) for t in ("audits", "audit_checks", "audit_totals"))
        done = audits.filter("state = 'COMPLETED'")
        same = lambda x, y: sorted(map(tuple, x.collect())) == sorted(map(tuple, y.collect()))
        assert same(rollups.bands(totals), analytics.bands(done)) and same(rollups.by_check(totals), analytics.by_check(checks))
        assert same(rollups.by_site(totals).drop("hosts_about", "keys_about"), analytics.by_site(done))
        assert same(rollups.states(totals), audits.groupBy("state").count())
        for needle in ("title of its", "Open", "no", " ", "zzz", "Links"):
            hits = lambda df: df.select("audit_id", "check_key")
            assert same(hits(s.search(needle, at(day))), hits(analytics.search(checks, needle)))
        if day == "01-02":
            assert s.purge(at("02-05")) == 3 and s.purge(at("02-05")) == 0
    assert s.table("audits", now).count() == 2 and s.search("Open", now).count() > 0
    again = store.Store(spark, str(tmp_path / "none"))
    assert again.purge(now) == 0
    with pytest.raises(LookupError):
        again.table("audits")


def test_a_save_is_seen_whole_or_not_at_all(spark, tmp_path, monkeypatch):
    """The third write of a save fails: readers go on with the old version, of all tables."""
    schema = "page_id long, url string, html string"
    s = store.Store(spark, str(tmp_path))
    now = F.lit("2026-01-01 10:00:00").cast("timestamp")
    s.save(store.frames(audit(spark.createDataFrame(PAGES, schema)), "r", now), "r")
    titles = lambda: {r.title for r in s.table("audit_metadata", now).collect()}
    old, n, write = titles(), [], store.Store._write
    other = audit(spark.createDataFrame([(1, "https://example.com/", "<title>Another title altogether</title>")], schema))

    def failing(self, *a):
        n.append(a)
        if len(n) == 3:
            raise OSError("disk is gone")
        return write(self, *a)

    monkeypatch.setattr(store.Store, "_write", failing)
    with pytest.raises(OSError):
        s.save(store.frames(other, "r", now), "r")
    assert titles() == old and s.table("audits", now).count() == 2 and s.table("audit_checks", now).count() == 52
    s.save(store.frames(other, "r", now), "r")
    assert titles() == {"Another title altogether"} and s.table("audits", now).count() == 1
    # the first version and the two tables of the one that failed
    folders = {p.parent.name + p.name for p in tmp_path.glob("*/run=*/version=*")}
    assert s.vacuum() == 0 and s.vacuum(older_ms=0) == len(store.TABLES + store.DERIVED) + 2
    assert len(folders) == 3 and s.table("audits", now).count() == 1


def test_two_saves_of_a_run_at_once(spark, tmp_path, monkeypatch):
    """Another save takes the number first: the manifest gets the next one, none is lost."""
    s = store.Store(spark, str(tmp_path))
    seen = s._manifests
    s._commit("abc", {"version": "v1", "tables": {}})
    stale = [{}]
    monkeypatch.setattr(s, "_manifests", lambda tag="*": stale.pop() if stale else seen(tag))
    s._commit("abc", {"version": "v2", "tables": {}})
    assert seen("abc")["abc"]["version"] == "v2" and seen("abc")["abc"]["number"] == 2


def test_a_lookup_reads_one_shard_of_one_run(spark, tmp_path):
    pages = spark.range(40).selectExpr("id AS page_id", "concat('https://example.com/', id) AS url", "'<p>x</p>' AS html")
    s = store.Store(spark, str(tmp_path))
    now = F.lit("2026-01-01 10:00:00").cast("timestamp")
    audits = {r: {"audits": store.failed(pages.select("page_id", "url", F.lit("TIMEOUT").alias("error_code"), F.lit("x").alias("error_message")), r, now)} for r in ("a", "b")}
    for r, t in audits.items():
        s.save(t, r)
    key = s.table("audits", now).filter("page_id = 7").first().audit_id
    df = s.get(key, now)
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert df.count() == 1 and "PartitionFilters: [isnotnull(shard" in plan and "EqualTo(audit_id" in plan
    assert len(df.inputFiles()) >= 1 and all(f"run={store.run_tag('a')}" in f or f"run={store.run_tag('b')}" in f for f in df.inputFiles())
    assert len({f.split("run=")[1].split("/")[0] for f in df.inputFiles()}) == 1
    read = df.select(F.input_file_name()).first()[0]
    assert f"shard={key[store.RUN_DIGITS]}" in read


def _stream(spark, tmp_path, rows, schema):
    for i, part in enumerate(rows):
        spark.createDataFrame(part, schema).coalesce(1).write.parquet(str(tmp_path / f"in/{i}"))
    return spark.readStream.schema(spark.createDataFrame(rows[0], schema).schema).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", "true").parquet(str(tmp_path / "in"))


def _run(df, name):
    q = df.writeStream.format("memory").queryName(name).outputMode("append").trigger(availableNow=True).start()
    q.awaitTermination()


def test_rate_limit_of_a_stream_equals_the_batch(spark, tmp_path):
    t = lambda s: datetime(2026, 1, 1) + timedelta(seconds=s)
    rows = [[("a", 1, t(0)), ("a", 2, t(1)), ("b", 3, t(2))], [("a", 4, t(3)), ("a", 5, t(61))], [("a", 6, t(62)), ("b", 7, t(70))]]
    schema = "client_key string, request_id long, ts timestamp"
    _run(limits.limited_stream(_stream(spark, tmp_path, rows, schema), 2, 60_000), "limited")
    want = ratelimit.limited(spark.createDataFrame(sum(rows, []), schema), 2, 60_000).collect()
    assert sorted(map(tuple, spark.table("limited").collect())) == sorted(map(tuple, want))
    assert {r.request_id: (r.allowed, r.retry_after_s) for r in want} == {1: (True, 60), 2: (True, 59), 3: (True, 60), 4: (False, 57), 5: (True, 60), 6: (True, 59), 7: (True, 60)}


def test_audit_of_a_stream(spark, tmp_path):
    seen = []
    pages = _stream(spark, tmp_path, [[PAGES[0]], [PAGES[1]]], "page_id long, url string, html string")
    limits.audit_stream(pages, lambda df, n: seen.append((n, df.count()))).trigger(availableNow=True).start().awaitTermination()
    assert sorted(seen) == [(0, 26), (1, 26)]


def test_routes_and_cache(spark):
    t = lambda s: datetime(2026, 1, 1) + timedelta(seconds=s)
    rows = [(r, "c", i, t(i)) for i, r in enumerate(["contact"] * 5 + ["audit"] * 3)]
    got = {r.request_id: r.allowed for r in ratelimit.limited_by_route(spark.createDataFrame(rows, "route string, client_key string, request_id long, ts timestamp"), 2, 60_000).collect()}
    assert [got[i] for i in range(8)] == [True, True, True, False, False, True, True, False]
    reads = spark.createDataFrame([("k", i, t(s)) for i, s in enumerate((0, 5, 9, 10, 12))] + [("m", 9, t(3))], "key string, request_id long, ts timestamp")
    assert {r.request_id: r.hit for r in ratelimit.cached(reads, 10_000).collect()} == {0: False, 1: True, 2: True, 3: False, 4: True, 9: False}


def test_client_keys(spark):
    df = spark.createDataFrame([({"x-forwarded-for": " 1.1.1.1 , 2.2.2.2"},), ({"x-real-ip": " "},), ({"cf-connecting-ip": "3.3.3.3", "x-real-ip": "4.4.4.4"},)], "h map<string,string>")
    assert [r[0] for r in df.select(ratelimit.client_key(F.col("h"))).collect()] == ["1.1.1.1", "unknown-client", "3.3.3.3"]


def test_alerts_of_a_stream(spark, tmp_path):
    """Windows close as the watermark passes them; one type may never occur, another only so often."""
    t = lambda m: datetime(2026, 1, 1) + timedelta(minutes=m)
    rows = [[("crash", t(5), 1, 2.0), ("limited", t(6), None, None)], [("limited", t(7), 3, 4.0), ("limited", t(65), 1, 1.0), ("done", t(66), 90, 0.5)], [("done", t(600), 1, 1.0)]]
    events = _stream(spark, tmp_path, rows, "event_type string, ts timestamp, score int, duration double")
    _run(limits.over_limit(limits.operations(events), {"crash": 1, "limited": 2}), "alerts")
    got = {(r.event_type, r.window_start.hour): (r.n_events, r.n_scores, r.sum_score, r.max_duration) for r in spark.table("alerts").collect()}
    assert got == {("crash", 0): (1, 1, 1, 2.0), ("limited", 0): (2, 1, 3, 4.0)}
    counts = spark.createDataFrame([(t(60 * i), "a", n) for i, n in enumerate((5, 5, 40, 5))], "window_start timestamp, event_type string, n_events long")
    assert [r.spike for r in limits.spikes(counts).orderBy("window_start").collect()] == [False, False, True, False]
