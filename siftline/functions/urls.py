"""URLs: parsing for the fact extractor (Python) and site, page and guard functions (Columns)."""

from __future__ import annotations

import re
from typing import NamedTuple
from urllib.parse import quote

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import trimmed

# Country suffixes of two labels.
TWO_PART_SUFFIXES = (
    "co.uk", "org.uk", "gov.uk", "ac.uk", "me.uk", "net.uk", "co.jp", "or.jp", "ne.jp", "ac.jp",
    "co.kr", "co.nz", "org.nz", "govt.nz", "co.za", "org.za", "com.au", "net.au", "org.au", "edu.au",
    "gov.au", "com.br", "com.mx", "com.ar", "com.tr", "com.cn", "com.tw", "com.hk", "com.sg", "com.my",
    "com.ph", "co.in", "net.in", "org.in", "gov.in", "co.id", "co.il", "com.es", "com.pl", "com.ua",
    "com.vn", "com.pk", "com.sa", "com.eg", "com.ng", "com.co", "com.pe", "com.ec", "com.uy",
)
# What the guard refuses.
BLOCKED_TLDS = ("localhost", "local", "internal", "intranet", "lan", "home", "corp", "private", "arpa", "onion", "test", "invalid", "example", "alt")
BLOCKED_HOSTNAMES = ("localhost", "localhost.localdomain", "metadata.google.internal", "metadata.goog", "instance-data", "metadata")
LONGEST_URL, PORTS = 2048, (80, 443)

_SPECIAL = {"http": 80, "https": 443, "ftp": 21, "ws": 80, "wss": 443}
_SCHEME = re.compile(r"([A-Za-z][A-Za-z0-9+.-]*):")
_BAD_HOST = re.compile(r"[\x00-\x20#%/:<>?@\[\\\]^`{|}\x7f]")


class Url(NamedTuple):
    scheme: str
    user: str
    host: str
    port: str
    path: str
    query: str
    fragment: str

    @property
    def href(self) -> str:
        if self.scheme not in _SPECIAL:
            return f"{self.scheme}:{self.path}{self.query}{self.fragment}"
        return f"{self.scheme}://{self.user and self.user + '@'}{self.host}{self.port and ':' + self.port}{self.path}{self.query}{self.fragment}"


def _ipv4_number(host: str) -> str | None:
    """A host of decimal, octal or hex numbers as a dotted quad; "" if it isn't one, None if it fails."""
    parts = host.rstrip(".").split(".")
    if not re.fullmatch(r"0[xX][0-9a-fA-F]*|[0-9]+", parts[-1]):
        return ""
    if len(parts) > 4:
        return None
    try:
        n = [int(p[2:] or "0", 16) if p[:2].lower() == "0x" else int(p, 8) if len(p) > 1 and p[0] == "0" else int(p) for p in parts]
    except ValueError:
        return None
    if any(x > 255 for x in n[:-1]) or n[-1] >= 256 ** (5 - len(n)):
        return None
    v = n[-1] + sum(x << (8 * (3 - i)) for i, x in enumerate(n[:-1]))
    return ".".join(str(v >> s & 255) for s in (24, 16, 8, 0))


def _dots(path: str) -> str:
    out: list[str] = []
    parts = path.split("/")[1:]
    for i, p in enumerate(parts):
        low = p.lower().replace("%2e", ".")
        if low == "..":
            out = out[:-1]
        elif low != ".":
            out.append(p)
            continue
        if i == len(parts) - 1:
            out.append("")
    return "/" + "/".join(out)


def parse_url(text: str, base: Url | None = None) -> Url | None:
    """A URL as browsers resolve it, or None if they would refuse it."""
    text = re.sub(r"[\t\n\r]", "", text.strip("".join(map(chr, range(33)))))
    text, hash_, fragment = text.partition("#")
    fragment = "#" + quote(fragment, safe="!$&'()*+,-./:;=?@_~%[]\\^{|}#") if fragment else hash_
    m = _SCHEME.match(text)
    scheme = m[1].lower() if m else base.scheme if base else None
    if scheme is None:
        return None
    rest = text[m.end() :] if m else text
    if m and scheme not in _SPECIAL:
        path, mark, query = rest.partition("?")
        return Url(scheme, "", "", "", quote(path, safe="!\"#$&'()*+,-./:;<=>?@[\\]^_`{|}~% "), mark + query, fragment)
    if base and base.scheme not in _SPECIAL and not m:
        return base._replace(fragment=fragment) if not rest else None
    rest, mark, query = rest.partition("?")
    query = mark + quote(query, safe="!$&()*+,-./:;=?@_~%[]\\^`{|}") if query else ""
    rest = rest.replace("\\", "/")
    absolute = bool(m) and not (base and base.scheme == scheme and not rest.startswith("/"))
    if absolute or rest.startswith("//"):
        authority, slash, path = rest.lstrip("/").partition("/")
        user, at, hostport = authority.rpartition("@")
        if hostport.startswith("["):
            host, _, port = hostport.partition("]")
            host, port = host + "]", port.removeprefix(":")
        else:
            host, _, port = hostport.partition(":")
            host = _host(host)
        if not host or (port and not (port.isascii() and port.isdigit() and int(port) < 65536)):
            return None
        port = "" if not port or int(port) == _SPECIAL[scheme] else str(int(port))
        path = _dots("/" + path)
    else:
        if base is None:
            return None
        user, host, port = base.user, base.host, base.port
        if not rest:
            path, query = base.path, query or (mark and "") or base.query
        else:
            path = _dots(rest if rest.startswith("/") else base.path.rpartition("/")[0] + "/" + rest)
    return Url(scheme, user, host.lower(), port, quote(path, safe="!$&'()*+,-./:;=@_~%[]\\^|"), query, fragment)


def _host(host: str) -> str:
    from urllib.parse import unquote

    host = unquote(host).lower()
    if not host.isascii():
        try:
            host = host.encode("idna").decode()
        except UnicodeError:
            return ""
    if not host or _BAD_HOST.search(host):
        return ""
    quad = _ipv4_number(host)
    return "" if quad is None else quad or host


def registrable(host: str) -> str:
    labels = host.lower().removesuffix(".").split(".")
    if len(labels) <= 2:
        return ".".join(labels)
    return ".".join(labels[-3:] if ".".join(labels[-2:]) in TWO_PART_SUFFIXES else labels[-2:])


# Columns, for absolute http(s) URLs.


def scheme_of(url: Column) -> Column:
    return F.lower(F.regexp_extract(url, r"^([A-Za-z][A-Za-z0-9+.-]*):", 1))


def authority_of(url: Column) -> Column:
    return F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://([^/?#]*)", 1)


def host_of(url: Column) -> Column:
    """Lower-case host without user and port; '' where there is none."""
    return F.lower(F.regexp_extract(F.regexp_replace(authority_of(url), "^.*@", ""), r"^(\[[^\]]*\]|[^:]*)", 1))


def port_of(url: Column) -> Column:
    return F.regexp_extract(authority_of(url), r":([0-9]+)$", 1)


def path_of(url: Column) -> Column:
    p = F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*([^?#]*)", 1)
    return F.when(p == "", "/").otherwise(p)


def query_of(url: Column) -> Column:
    q = F.regexp_extract(url, r"^[^?#]*(\?[^#]*)", 1)
    return F.when(q == "?", "").otherwise(q)


def is_web(url: Column) -> Column:
    return F.coalesce(url.rlike(r"^[Hh][Tt][Tt][Pp][Ss]?://[^/?#]") & (host_of(url) != ""), F.lit(False))


def strip_www(host: Column) -> Column:
    return F.regexp_replace(F.lower(host), r"^www\.", "")


def same_site(a: Column, b: Column) -> Column:
    """Whether two URLs are of one registrable domain."""
    return registrable_domain(host_of(a)) == registrable_domain(host_of(b))


def registrable_domain(host: Column) -> Column:
    h = F.regexp_replace(F.lower(host), r"\.$", "")
    two = F.substring_index(h, ".", -2)
    return F.when(F.size(F.split(h, r"\.")) <= 2, h).when(two.isin(*TWO_PART_SUFFIXES), F.substring_index(h, ".", -3)).otherwise(two)


def canonical_key(url: Column) -> Column:
    """What makes two URLs the same page: no scheme, port, www, trailing slashes or fragment."""
    path = F.when(F.length(path_of(url)) > 1, F.regexp_replace(path_of(url), "/+$", "")).otherwise("/")
    return F.when(is_web(url), F.concat(strip_www(host_of(url)), path, query_of(url)))


def same_page(a: Column, b: Column) -> Column:
    return F.coalesce(canonical_key(a) == canonical_key(b), F.lit(False))


def display_url(url: Column, most: int = 60) -> Column:
    short = F.concat(host_of(url), F.when(path_of(url) == "/", "").otherwise(path_of(url)), query_of(url))
    return F.when(is_web(url), F.when(F.length(short) > most, F.concat(F.substring(short, 1, most - 1), F.lit("…"))).otherwise(short)).otherwise(url)


def guard(raw: Column) -> Column:
    """struct<ok, code, reason, href> of a URL as someone typed it."""
    from .ip import classify_ipv4, is_ipv4

    text = trimmed(F.coalesce(raw, F.lit("")))
    has_scheme = text.rlike(r"^[a-zA-Z][a-zA-Z0-9+.-]*://") | text.rlike(r"^[a-zA-Z][a-zA-Z0-9+-]*:")
    url = F.when(has_scheme, text).otherwise(F.concat(F.lit("https://"), text))
    host = F.regexp_replace(host_of(url), r"^\[|\]$", "")
    port = port_of(url)
    tld = F.element_at(F.filter(F.split(host, r"\."), lambda x: x != ""), -1)
    address = classify_ipv4(host)

    def no(code: str, why: str) -> Column:
        return F.struct(F.lit(False).alias("ok"), F.lit(code).alias("code"), F.lit(why).alias("reason"), F.lit(None).cast("string").alias("href"))

    port_text = F.when(port == "", "").when((scheme_of(url) == "http") & (port == "80") | (scheme_of(url) == "https") & (port == "443"), "").otherwise(F.concat(F.lit(":"), port))
    href = F.concat(scheme_of(url), F.lit("://"), host_of(url), port_text, path_of(url), query_of(url))
    yes = F.struct(F.lit(True).alias("ok"), F.lit(None).cast("string").alias("code"), F.lit(None).cast("string").alias("reason"), href.alias("href"))
    bad, blocked = "INVALID_URL", "BLOCKED_URL"
    return (
        F.when(text == "", no(bad, "empty"))
        .when(F.length(text) > LONGEST_URL, no(bad, "too long"))
        .when(text.rlike(r"[\x00-\x20\x7f]"), no(bad, "control character or space"))
        .when(~scheme_of(url).isin("http", "https"), no(blocked, "scheme"))
        .when(~is_web(url) | host.rlike(r"[\x00-\x20#%<>?@\\^`{|}]"), no(bad, "no host"))
        .when(authority_of(url).contains("@"), no(blocked, "credentials"))
        .when((port != "") & ~port.cast("int").isin(*PORTS), no(blocked, "port"))
        .when(host.isin(*BLOCKED_HOSTNAMES), no(blocked, "host name"))
        .when(host.contains(":"), F.when(ipv6_public(host), yes).otherwise(no(blocked, "address")))
        .when(is_ipv4(host), F.when(address.isNull(), yes).otherwise(no(blocked, "address")))
        .when(host.rlike(r"(^|\.)(0[xX][0-9a-fA-F]*|[0-9]+)\.?$"), F.when(odd_ipv4_public(host), yes).otherwise(no(blocked, "address")))
        .when(~host.contains("."), no(blocked, "single label"))
        .when(tld.isin(*BLOCKED_TLDS) | host.endswith(".localhost"), no(blocked, "reserved name"))
        .otherwise(yes)
    )


def ipv6_public(host: Column) -> Column:
    """Only asked for hosts with a colon."""
    from .ip import public

    return public(F.when(host.contains(":"), host))


def odd_ipv4_public(host: Column) -> Column:
    """Hosts of one number, or of hex or octal parts."""
    from .ip import let, odd_ipv4, public, quad_of

    odd = odd_ipv4(F.when(host.rlike(r"(^|\.)(0[xX][0-9a-fA-F]*|[0-9]+)\.?$"), host))
    return let(odd, lambda n: F.coalesce(public(quad_of(n)), F.lit(False)) & n.isNotNull())
