"""Which IP addresses are public."""

from __future__ import annotations

import re
from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# IPv4 ranges that are not public, and why.
BLOCKED_IPV4 = (
    ("0.0.0.0/8", "the own network"),
    ("10.0.0.0/8", "private network"),
    ("100.64.0.0/10", "shared by customers of a provider"),
    ("127.0.0.0/8", "this machine"),
    ("169.254.0.0/16", "the own link"),
    ("172.16.0.0/12", "private network"),
    ("192.0.0.0/24", "kept for protocols"),
    ("192.0.2.0/24", "for examples"),
    ("192.88.99.0/24", "a tunnel"),
    ("192.168.0.0/16", "private network"),
    ("198.18.0.0/15", "for measurements"),
    ("198.51.100.0/24", "for examples"),
    ("203.0.113.0/24", "for examples"),
    ("224.0.0.0/4", "many receivers"),
    ("240.0.0.0/4", "kept back"),
)
QUAD = r"^(?:(?:25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[1-9]?[0-9])\.){3}(?:25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[1-9]?[0-9])$"


def _number(quad: str) -> int:
    a, b, c, d = map(int, quad.split("."))
    return a << 24 | b << 16 | c << 8 | d


def ranges() -> list[tuple[int, int, str]]:
    """(first, last, reason)."""
    out = []
    for net, why in BLOCKED_IPV4:
        base, bits = net.split("/")
        low = _number(base)
        out.append((low, low + (1 << (32 - int(bits))) - 1, why))
    return out


def is_ipv4(host: Column) -> Column:
    return F.coalesce(host.rlike(QUAD), F.lit(False))


def ipv4_number(host: Column) -> Column:
    p = F.split(host, r"\.")
    return F.aggregate(p, F.lit(0).cast("long"), lambda a, x: a * 256 + F.coalesce(F.try_to_number(x, F.lit("999")).cast("long"), F.lit(0)))


def classify_ipv4(host: Column) -> Column:
    """Why a dotted quad is not public; null if it is, or is no dotted quad."""
    n = ipv4_number(F.when(is_ipv4(host), host))
    out = F.lit(None).cast("string")
    for low, high, why in reversed(ranges()):
        out = F.when(n.between(low, high), F.lit(why)).otherwise(out)
    return F.when(is_ipv4(host), out)


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body(value), where value is written and worked out once however often body names it."""
    return F.get(F.transform(F.array(value), body), 0)


def quad_of(number: Column) -> Column:
    """A number as a dotted quad."""
    return F.concat_ws(".", *[F.shiftright(number, s).bitwiseAND(F.lit(255)).cast("string") for s in (24, 16, 8, 0)])


def _groups(text: Column) -> Column:
    """The eight groups of an IPv6 address as numbers; null if it is none."""

    def of(text: Column) -> Column:
        gap = F.locate("::", text)
        left, right = F.when(gap > 0, F.substring(text, F.lit(1), gap - 1)).otherwise(text), F.when(gap > 0, F.substring(text, gap + 2, F.length(text)))
        parts = lambda x: F.when((x == "") | x.isNull(), F.array().cast("array<string>")).otherwise(F.split(x, ":", -1))

        def filled(p: Column) -> Column:
            missing = 8 - F.size(p["a"]) - F.size(p["b"])
            groups = F.concat(p["a"], F.array_repeat(F.lit("0"), F.greatest(missing, F.lit(0))), p["b"])
            fits = F.when(gap > 0, missing >= 1).otherwise(missing == 0) & F.forall(groups, lambda g: g.rlike("^[0-9a-fA-F]{1,4}$"))
            return F.when(fits, F.transform(groups, lambda g: F.conv(g, 16, 10).cast("long")))

        once = (F.locate("::", text, 1) == 0) | (F.locate("::", F.substring(text, gap + 2, F.length(text))) == 0)
        return F.when(once & ~text.contains(":::"), let(F.struct(parts(left).alias("a"), parts(right).alias("b")), filled))

    def plain(text: Column) -> Column:
        """An IPv4 address at the end as two groups; null if what has dots there is none."""
        tail = F.substring_index(text, ":", -1)
        n = ipv4_number(tail)
        hexed = F.concat(F.substring(text, F.lit(1), F.length(text) - F.length(tail)), F.lower(F.hex(F.shiftright(n, 16))), F.lit(":"), F.lower(F.hex(n.bitwiseAND(F.lit(0xFFFF)))))
        return F.when(~tail.contains("."), text).when(is_ipv4(tail), hexed)

    return F.when(text.contains(":"), let(plain(F.substring_index(text, "%", 1)), of))


def _joined(groups: Column) -> Column:
    """Four groups as 64 bits."""
    return F.aggregate(groups, F.lit(0).cast("long"), lambda a, g: F.shiftleft(a, 16).bitwiseOR(g))


def number_of(address: Column) -> Column:
    """struct<family, hi, lo>: 4 or 6, and the address as 128 bits in two longs; null if it is no address."""

    def six(g: Column) -> Column:
        return F.when(g.isNotNull(), F.struct(F.lit(6).alias("family"), _joined(F.slice(g, 1, 4)).alias("hi"), _joined(F.slice(g, 5, 4)).alias("lo")))

    four = F.struct(F.lit(4).alias("family"), F.lit(0).cast("long").alias("hi"), ipv4_number(address).alias("lo"))
    return F.when(is_ipv4(address), four).otherwise(let(_groups(address), six))


def _signed(n: int) -> int:
    n &= (1 << 64) - 1
    return n - (1 << 64) if n >> 63 else n


def _masks(family: int, bits: int) -> tuple[int, int]:
    """What to keep of hi and lo for a prefix of so many bits."""
    if family == 4:
        bits += 96  # the address is in the last 32 bits
    whole = ((1 << 128) - 1) ^ ((1 << (128 - bits)) - 1)
    return _signed(whole >> 64), _signed(whole)


def in_networks(addresses: DataFrame, column: str, networks: DataFrame, few: int = 100_000) -> DataFrame:
    """addresses with the columns of the longest of networks (network: address/bits, other columns) that
    holds column's address; nulls if none does.

    Each distinct address is looked up by its beginnings, one for each length that networks have (129
    and 33 at most), in an equi-join on the beginning's bits. Networks are broadcast up to few rows; above,
    both sides are shuffled. What is no address or network matches nothing; bits beyond a network's
    length don't count; of equal networks the first in the order of their text counts.
    """
    own = [c for c in networks.columns if c != "network"]
    parts = networks.withColumn("_at", number_of(F.substring_index("network", "/", 1))).withColumn("_bits", F.expr("try_cast(substring_index(network, '/', -1) AS INT)"))
    parts = parts.filter(F.col("_at").isNotNull() & F.col("network").contains("/") & F.col("_bits").between(0, F.when(F.col("_at.family") == 4, 32).otherwise(128)))
    lengths = sorted((r[0], r[1]) for r in parts.select("_at.family", "_bits").distinct().collect())  # 162 at most
    masks = [(f, b, *_masks(f, b)) for f, b in lengths]
    kept = lambda at: F.array(*[F.struct(F.lit(f).alias("family"), F.lit(b).alias("bits"), at["hi"].bitwiseAND(F.lit(h)).alias("hi"), at["lo"].bitwiseAND(F.lit(low)).alias("lo")) for f, b, h, low in masks] or [F.lit(None).cast("struct<family:int,bits:int,hi:bigint,lo:bigint>")])
    told = parts.select(F.get(F.filter(kept(F.col("_at")), lambda k: (k["family"] == F.col("_at.family")) & (k["bits"] == F.col("_bits"))), 0).alias("_key"), F.struct("network", *own).alias("_net"))
    told = told.groupBy("_key").agg(F.min("_net").alias("_net"))
    if told.count() <= few:
        told = F.broadcast(told)
    seen = addresses.select(F.col(column).alias("_address")).distinct().withColumn("_n", number_of(F.col("_address")))
    keys = seen.select("_address", F.explode(F.filter(kept(F.col("_n")), lambda k: k["family"] == F.col("_n.family"))).alias("_k"))
    best = keys.join(told, F.col("_k") == F.col("_key")).groupBy("_address").agg(F.max_by("_net", F.col("_k.bits")).alias("_net"))
    return addresses.join(best, F.col(column) == F.col("_address"), "left").select(*addresses.columns, "_net.*")


def join_ranges(addresses: DataFrame, column: str) -> DataFrame:
    """addresses with the reason of the blocked IPv4 network that holds column."""
    nets = addresses.sparkSession.createDataFrame(list(BLOCKED_IPV4), "network string, reason string")
    return in_networks(addresses, column, nets).drop("network")


def _why4(n: int) -> str | None:
    return next((why for low, high, why in ranges() if low <= n <= high), None)


def expand_ipv6(text: str) -> list[int] | None:
    """Eight groups, or None."""
    text = text.partition("%")[0]
    if text.count("::") > 1 or ":::" in text:
        return None
    tail = text.rpartition(":")[2]
    if "." in tail:
        if not re.fullmatch(QUAD.strip("^$"), tail):
            return None
        n = _number(tail)
        text = f"{text[: -len(tail)]}{n >> 16:x}:{n & 0xFFFF:x}"
    left, gap, right = text.partition("::")
    a, b = [x.split(":") if x else [] for x in (left, right)]
    missing = 8 - len(a) - len(b)
    if (gap and missing < 1) or (not gap and missing):
        return None
    groups = a + ["0"] * missing + b
    if not all(re.fullmatch("[0-9a-fA-F]{1,4}", g) for g in groups):
        return None
    return [int(g, 16) for g in groups]


# IPv6 prefixes that are not public, by length, longest first; and where an IPv4 address
# stands in those that carry one (its first group), which then decides.
PREFIXES6 = (
    ("::", 128, "no address", None), ("::1", 128, "this machine", None), ("::ffff:0:0", 96, "an IPv4 address in IPv6 form", 6), ("64:ff9b::", 96, "an IPv4 address behind a translator", 6), ("::", 96, "an old form of IPv4 addresses", 6),
    ("100::", 64, "thrown away", None), ("64:ff9b:1::", 48, "a translator of the own network", None), ("2001:db8::", 32, "for examples", None), ("2001::", 32, "a tunnel", None), ("2002::", 16, "an IPv4 address in a tunnel", 1),
    ("fe80::", 10, "the own link", None), ("ff00::", 8, "many receivers", None), ("fc00::", 7, "a private network", None),
)
#: Of those with an IPv4 address, the ones that are refused even if that is public.
REFUSED6 = ("an old form of IPv4 addresses",)


def _why6(g: list[int]) -> str | None:
    n = reduce(lambda a, x: a << 16 | x, g)
    for prefix, bits, why, at in PREFIXES6:
        own = reduce(lambda a, x: a << 16 | x, expand_ipv6(prefix))
        if n >> (128 - bits) == own >> (128 - bits):
            inner = None if at is None else _why4(g[at] << 16 | g[at + 1])
            return why if at is None or why in REFUSED6 and inner is None else inner and f"{why}: {inner}"
    return None


def classify(address: str) -> tuple[bool, str | None]:
    """(public, reason if not)."""
    if re.fullmatch(QUAD.strip("^$"), address or ""):
        why = _why4(_number(address))
    elif ":" in (address or "") and (g := expand_ipv6(address)) is not None:
        why = _why6(g)
    else:
        why = "not a valid IP address"
    return why is None, why


def _within(at: Column, family: int, prefix: tuple[int, int], bits: int) -> Column:
    hi, lo = _masks(family, bits)
    return (at["hi"].bitwiseAND(F.lit(hi)) == _signed(prefix[0])) & (at["lo"].bitwiseAND(F.lit(lo)) == _signed(prefix[1]))


def _reason4(n: Column) -> Column:
    """Why an IPv4 number is not public, or null."""
    return F.coalesce(*[F.when(n.between(low, high), F.lit(why)) for low, high, why in ranges()])


def _reason6(at: Column) -> Column:
    """Why an IPv6 number is not public, or null; the longest prefix decides."""
    out = F.lit(None).cast("string")
    for prefix, bits, why, place in reversed(PREFIXES6):
        n = reduce(lambda a, x: a << 16 | x, expand_ipv6(prefix))
        if place is None:
            reason = F.lit(why)
        else:
            inner = at["lo"].bitwiseAND(F.lit(0xFFFFFFFF)) if place == 6 else F.shiftrightunsigned(at["hi"], 16).bitwiseAND(F.lit(0xFFFFFFFF))
            reason = let(_reason4(inner), lambda r: F.when(r.isNotNull(), F.concat(F.lit(f"{why}: "), r)).otherwise(F.lit(why if why in REFUSED6 else None)))  # noqa: B023  used at once
        out = F.when(_within(at, 6, (n >> 64, n & ((1 << 64) - 1)), bits), reason).otherwise(out)
    return out


def classified(address: Column) -> Column:
    """struct<allowed, reason> of any address, as classify() has it."""

    def judged(at: Column) -> Column:
        why = F.when(at.isNull(), "not a valid IP address").when(at["family"] == 4, _reason4(at["lo"])).otherwise(_reason6(at))
        return let(why, lambda w: F.struct(w.isNull().alias("allowed"), w.alias("reason")))

    return let(number_of(address), judged)


def public(address: Column) -> Column:
    return classified(address)["allowed"]


def odd_ipv4(host: Column) -> Column:
    """The number of a host of one to four decimal, octal or hex parts; null if it is none."""

    def number(p: Column) -> Column:
        # twelve digits of any base fit a long, and more of them are too large anyhow
        base = lambda digits, b: let(F.regexp_replace(digits, "^0+(?=.)", ""), lambda d: F.when(F.length(d) <= 12, F.conv(d, b, 10).cast("long")).otherwise(F.lit(1 << 40)))
        return F.when(p.rlike("^0[xX][0-9a-fA-F]+$"), base(F.substring(p, 3, 1000), 16)).when(p.rlike("^0[xX]$"), F.lit(0).cast("long")).when(p.rlike("^0[0-7]+$"), base(p, 8)).when(p.rlike("^(0|[1-9][0-9]*)$"), base(p, 10))

    def total(n: Column) -> Column:
        size = F.size(n)
        small = F.forall(F.slice(n, 1, F.greatest(size - 1, F.lit(0))), lambda x: x <= 255)
        last, room = F.element_at(n, -1), F.element_at(F.array(*[F.lit(256 ** (5 - k)) for k in range(1, 5)]), size)
        first = F.aggregate(F.slice(n, 1, F.greatest(size - 1, F.lit(0))), F.lit(0).cast("long"), lambda a, x: F.shiftleft(a, 8).bitwiseOR(x.cast("long")))
        return F.when(small & (last < room), first * room + last.cast("long"))

    parts = F.transform(F.split(F.regexp_replace(host, r"\.+$", ""), r"\."), number)
    return let(parts, lambda n: F.when((F.size(n) <= 4) & F.forall(n, lambda x: x.isNotNull()), total(n)))
