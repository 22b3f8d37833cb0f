"""Addresses in Columns against Python's own ipaddress module and the plain functions."""

import ipaddress
import random

from pyspark.sql import functions as F

from siftline.functions import ip, urls

SIX = ["::", "::1", "1::", "1:2:3:4:5:6:7:8", "1:2:3:4:5:6:7::", "::2:3:4:5:6:7:8", "1:2:3:4:5:6:7:8:9", "1:2:3", "1::2::3", ":::", "1:::2", "::ffff:10.0.0.1", "::ffff:8.8.8.8", "::8.8.8.8", "::10.0.0.1", "64:ff9b::8.8.8.8", "64:ff9b::10.1.1.1", "64:ff9b:1::1",
       "2002:0a00:0001::", "2002:0808:0808::1", "2001:db8::1", "2001::1", "fc00::1", "fdff::", "fe80::1%eth0", "febf::1", "fec0::1", "ff02::1", "100::1", "100:0:0:1::", "2606:4700::1111", "FFFF::ABCD", "12345::", "g::1", "::1.2.3", "::256.1.1.1", "1.2.3.4::", "", ":", "1:2:3:4:5:6:1.2.3.4", "1:2:3:4:5:6:7:1.2.3.4", "::%", "%::1"]
FOUR = ["8.8.8.8", "10.1.2.3", "0.0.0.0", "255.255.255.255", "172.15.255.255", "172.16.0.0", "172.31.255.255", "172.32.0.0", "100.63.255.255", "100.64.0.0", "192.0.0.255", "192.0.1.0", "01.2.3.4", "256.1.1.1", "1.2.3", "1.2.3.4.5", "x", "1.2.3.4 "]


def test_columns_classify_like_the_plain_function(spark):
    rng = random.Random(1)
    more = [str(ipaddress.ip_address(rng.getrandbits(128))) for _ in range(100)] + [str(ipaddress.ip_address(rng.getrandbits(32))) for _ in range(100)]
    more += [str(ipaddress.ip_address(int(ipaddress.ip_address(p)) + rng.getrandbits(20))) for p, *_ in ip.PREFIXES6 for _ in range(5)]
    given = SIX + FOUR + more
    rows = spark.createDataFrame(list(enumerate(given)) + [(-1, None)], "i int, a string").select("i", ip.classified(F.col("a")).alias("c"), ip.number_of(F.col("a")).alias("n")).collect()
    got = {r.i: r for r in rows}
    for i, a in [*enumerate(given), (-1, "")]:
        assert tuple(got[i].c) == ip.classify(a), a
        try:
            want = ipaddress.ip_address(a.partition("%")[0] if ":" in a else a)
        except ValueError:
            want = None
        n = got[i].n
        assert (n and (n.hi % 2**64 << 64 | n.lo % 2**64)) == (want and int(want)) or want is not None and int(want) == 0, a


def test_longest_network(spark):
    rng = random.Random(2)
    nets = {f"{ipaddress.ip_address(rng.getrandbits(32))}/{rng.randrange(0, 20)}" for _ in range(150)} | {f"{ipaddress.ip_address(rng.getrandbits(128))}/{rng.randrange(0, 12)}" for _ in range(150)}
    nets |= {"10.0.0.0/8", "10.1.0.0/16", "10.1.1.1/32", "2001:db8::/32", "2001:db8::1/128", "::/0"}
    odd = ["nonsense", "10.0.0.0", "10.0.0.0/33", "::/129", "1.2.3.4/x", None, "/8"]
    given = [str(ipaddress.ip_address(rng.getrandbits(b))) for b in (32, 128) for _ in range(300)] + ["10.1.1.1", "10.1.1.1", "10.1.2.3", "10.9.9.9", "2001:db8::1", "2001:db8::2", None, "x", ""]
    table = spark.createDataFrame([(n, f"of {n}") for n in [*sorted(nets), *odd]], "network string, owner string")
    df = spark.createDataFrame(list(enumerate(given)), "i int, address string")
    known = [(ipaddress.ip_network(n, strict=False), n) for n in sorted(nets)]

    def want(a):
        try:
            a = ipaddress.ip_address(a)
        except ValueError:
            return None
        fits = [(-k.prefixlen, n) for k, n in known if a.version == k.version and a in k]
        return min(fits)[1] if fits else None

    for few in (100_000, 0):  # networks sent to all tasks, or both sides dealt out
        got = {r.i: (r.network, r.owner) for r in ip.in_networks(df, "address", table, few).collect()}
        assert got == {i: (w, w and f"of {w}") for i, a in enumerate(given) for w in [want(a)]}
    plan = ip.in_networks(df, "address", table)._jdf.queryExecution().executedPlan().toString()
    assert "NestedLoop" not in plan and "Python" not in plan
    assert ip.in_networks(df, "address", table.limit(0)).filter("network IS NULL").count() == len(given)


def test_odd_hosts(spark):
    hosts = ["127.1", "0x7f.1", "0x7f000001", "2130706433", "017700000001", "010.8.8.8", "8.8.8.8.", "0x", "08.1.1.1", "1.2.3.4.5", "256.1", "1.16777216", "1.16777215", "4294967296", "4294967295", "99999999999999999999999", "0x8.0x8.0x8.0x8", "a.1", "1..2", "3232235777", "0x08080808"]
    df = spark.createDataFrame(list(enumerate(hosts)), "i int, h string").select("i", urls.odd_ipv4_public(F.col("h")).alias("p"))
    assert {r.i: r.p for r in df.collect()} == {i: ip.classify(urls._ipv4_number(h) or "")[0] for i, h in enumerate(hosts)}
